"""Preparing text corpora for language-model training, on Spark.

Every operator takes DataFrames and returns DataFrames.  Rows stand for documents; a NULL
text counts as an empty one, and an id that occurs twice is treated as each operator says.
"""
