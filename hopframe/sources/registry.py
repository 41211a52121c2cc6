"""Named backends and the resolution of table references.

A backend is a dict with a ``type`` (or a JDBC ``url`` from which it follows):

- ``files``: ``path`` of a folder with one file or folder a table, ``format`` (parquet, csv,
  json, orc, delta, iceberg ...), reader ``options``;
- ``jdbc``: ``url``, optional ``user``, ``password``, ``driver`` and reader ``options``;
- ``catalog``: tables and views of the session, with an optional ``prefix``.

A reference may name its format itself: ``parquet:<path>``, ``csv:<path>``, ``iceberg:<path>``
or ``iceberg:<catalog.schema.table>``. Readers are lazy, so filters, columns and partitions are
pushed into every one of them by the planner.
"""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame, SparkSession

from hopframe.errors import QueryError

#: JDBC drivers by the name in the url.
DRIVERS = {"h2": "org.h2.Driver", "trino": "io.trino.jdbc.TrinoDriver", "postgresql": "org.postgresql.Driver", "mysql": "com.mysql.cj.jdbc.Driver"}
_FORMATS = ("parquet", "csv", "json", "orc", "iceberg")
_PATH = re.compile(r"^(?:s3a?|gs|abfss?|hdfs|file|viewfs)://|^/|^\.{1,2}/|/")


class Registry:
    """Backends by name; the first one registered is the default until another is named so."""

    def __init__(self, spark: SparkSession, backends: str | list | None = None):
        self.spark, self.backends = spark, {"catalog": {"type": "catalog"}}
        self.default = "catalog"
        for b in json.loads(backends) if isinstance(backends, str) else backends or []:
            self.register(b)

    @classmethod
    def from_env(cls, spark: SparkSession) -> Registry:
        """Backends from the JSON list in the environment variable BACKENDS."""
        return cls(spark, os.environ.get("BACKENDS") or None)

    def register(self, backend: dict) -> str:
        """Add or replace a backend; returns its name."""
        name = str(backend.get("id") or backend.get("name") or "").strip()
        if not name:
            raise QueryError("a backend has an id")
        told = {k: v for k, v in backend.items() if k not in ("id", "name")}
        kind = told.setdefault("type", "jdbc" if str(told.get("url", "")).startswith("jdbc:") else "files" if told.get("path") else "")
        if kind not in ("jdbc", "files", "catalog") or (kind == "jdbc" and not told.get("url")) or (kind == "files" and not told.get("path")):
            raise QueryError(f"backend {name}: give a jdbc url, a path or type catalog")
        if kind == "jdbc" and not told.get("driver"):
            told["driver"] = DRIVERS.get(told["url"].split(":")[1])
        if list(self.backends) == ["catalog"]:
            self.default = name
        self.backends[name] = told
        return name

    def described(self) -> list[dict]:
        hide = ("password", "user")
        return [{"id": n, "default": n == self.default, **{k: v for k, v in b.items() if k not in hide}} for n, b in self.backends.items()]

    def read(self, table: str, datasource: str | None = None) -> DataFrame:
        """The DataFrame of a table reference in a backend."""
        kind, _, rest = table.partition(":")
        if rest and kind in _FORMATS:
            if not _PATH.search(rest):
                return self.spark.table(rest)
            reader = self.spark.read.format(kind)
            return (reader.option("header", True).option("inferSchema", True) if kind == "csv" else reader).load(rest)
        name = datasource or self.default
        if name not in self.backends:
            raise QueryError(f"no backend {name!r} is registered")
        b = self.backends[name]
        if b["type"] == "catalog":
            return self.spark.table(".".join(x for x in (b.get("prefix"), table) if x))
        if b["type"] == "jdbc":
            options = {k: v for k, v in b.items() if k in ("url", "user", "password", "driver") and v}
            return self.spark.read.format("jdbc").options(dbtable=table, **options, **b.get("options", {})).load()
        form = b.get("format", "parquet")
        suffix = b.get("suffix", f".{form}")
        return self.spark.read.format(form).options(**b.get("options", {})).load(f"{b['path'].rstrip('/')}/{table}{suffix}")
