"""Operators of a training-data pipeline, and their queries (see ``queries.py``).

Nothing outside this subpackage imports it.
"""
