"""Extraction analytics on PySpark: DataFrame in, DataFrame out."""
