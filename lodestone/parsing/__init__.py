"""Symbols of source files, language by language."""
