"""Corpus building and retrieval as plain Spark jobs.

Every operator is a function from DataFrames to DataFrames (or from Columns
to Columns), so it can be used with ``DataFrame.transform`` and mixed freely
with ordinary Spark code.
"""
