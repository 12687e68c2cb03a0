"""Operators of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage. Each module holds one operator, the query that applies it
to its whole table and, where SQL can express it, the SQL of that query.
"""
