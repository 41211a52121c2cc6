"""Rows as the service's JSON: scalars, lists for paths, maps of one-element lists."""

from __future__ import annotations

import datetime as dt
import decimal
from collections.abc import Iterator

from pyspark.sql import DataFrame


def plain(v):
    """A value that JSON can hold."""
    if isinstance(v, decimal.Decimal):
        return int(v) if v == v.to_integral_value() else float(v)
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    return v.hex() if isinstance(v, (bytes, bytearray)) else v


def shaped(names: list[str], shape: str, r) -> object:
    """One row as the client sees it."""
    if shape == "path":
        return [plain(v) for v in r]
    if shape == "value" and len(names) == 1:
        return plain(r[0])
    if shape == "map":
        return {n: plain(v) for n, v in zip(names, r, strict=True)}
    return {n: [plain(v)] for n, v in zip(names, r, strict=True) if v is not None}


def to_results(df: DataFrame, shape: str, most: int | None = None) -> list:
    """Collect the result for a client; ``most`` bounds the rows that reach it."""
    rows = (df if most is None else df.limit(most)).collect()
    return [shaped(df.columns, shape, r) for r in rows]


def stream(df: DataFrame, shape: str) -> Iterator:
    """The whole result, a partition at a time."""
    names = df.columns
    return (shaped(names, shape, r) for r in df.toLocalIterator(prefetchPartitions=True))
