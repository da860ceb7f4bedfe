"""Operators for preparing training text: scoring, deduplication, packing,
tokenisation, vector search and language-model scoring as Spark jobs.

Nothing outside this package imports it.  Every operator takes DataFrames,
reads only the columns it names (extra columns never clash) and returns one.
"""
