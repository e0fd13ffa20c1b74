"""Ledgerloom: governed knowledge-base analytics as PySpark DataFrame pipelines.

Every operator is a function from DataFrames (and parameters) to a DataFrame. Nothing here starts a
session, collects rows of unbounded number or keeps state between calls.
"""

__version__ = "0.1.0"
