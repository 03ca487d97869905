"""Operators of a training-data pipeline over text, URL and vector tables.

Nothing else in the library imports this subpackage.
"""
