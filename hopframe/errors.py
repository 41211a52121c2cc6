"""Errors of the query layer."""

from __future__ import annotations


class QueryError(ValueError):
    """A traversal that cannot be parsed, bound to the mapping or compiled."""
