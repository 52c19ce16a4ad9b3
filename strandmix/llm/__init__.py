"""Operators for training-data pipelines over text tables.

Every operator takes a DataFrame and the names of the columns it reads, selects
only those, and returns a DataFrame of its own columns; extra input columns
never clash with what it makes.
"""
