"""Spark-native retrieval and corpus analytics: declarative plans over DataFrames."""
