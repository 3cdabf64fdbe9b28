"""Operators for preparing training text at scale.

Nothing outside this folder imports it; ``queries.py`` registers one query
per operator.  Operators written with Arrow functions work on whole batches
with numpy; the two native ones (``pii`` and ``sharding``) use only DataFrame
and SQL functions.
"""
