"""Retrieval operators as DataFrame plans."""
