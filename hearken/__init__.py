"""Keyword spotting over chunked streams, and training-data preparation, as Spark jobs."""
