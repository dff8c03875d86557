"""Operators for large text corpora, their registered queries and SQL counterparts."""
