"""Ranked-list history analytics on Spark.

Lists ("charts") are published per period as ranks 1..N of (title, artist).
Every operator is a function from DataFrames to a DataFrame; compose them with
``DataFrame.transform``.
"""
