"""Operators of a training-data pipeline over web documents.

Each module is one operator with an interface of its own; ``queries.py`` registers a query per
operator.  Nothing else in the library imports this package.
"""
