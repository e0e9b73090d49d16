"""Operators of a training-data pipeline over a table of documents.

Nothing outside this subpackage imports it.  Every module holds one operator
with its general interface; ``queries`` applies them to the test tables.
"""
