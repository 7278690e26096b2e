"""Operators of a training-data pipeline over a table of documents.

Every operator takes and returns DataFrames, selects the columns that it needs by
name (other columns never reach a plan) and leaves the session's settings alone.
Nothing else in the library imports this subpackage.
"""
