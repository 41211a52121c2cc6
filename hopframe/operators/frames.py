"""Vertex and edge tables of a mapping as frames with position-wise column names."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hopframe.errors import QueryError
from hopframe.plans.mapping import Edge, GraphMapping

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@dataclass
class Position:
    """A place on a path: an element whose columns are ``_{n}_*`` of the frame.

    ``loaded`` tells whether the table's columns are there, not just the id; ``sure`` whether
    the element is known to exist.
    """

    n: int
    kind: str
    labels: tuple[str, ...]
    loaded: bool = True
    sure: bool = True

    @property
    def id(self) -> str:
        return f"_{self.n}_id"

    @property
    def label(self) -> str:
        return f"_{self.n}_label"

    def raw(self, column: str) -> str:
        return f"_{self.n}_c_{column}"

    def end(self, name: str) -> str:
        return f"_{self.n}_{name}"


@dataclass
class Frames:
    """Reads the tables of a mapping. ``read(table, datasource)`` gives a table's DataFrame."""

    mapping: GraphMapping
    read: object
    cache: dict = field(default_factory=dict)
    used: set[str] = field(default_factory=set)  # labels whose tables were asked for

    def table(self, table: str, datasource: str | None) -> DataFrame:
        key = (table, datasource or self.mapping.datasource)
        if key not in self.cache:
            self.cache[key] = self.read(*key)
        return self.cache[key]

    def _key(self, df: DataFrame, column: str):
        """Whole-number keys as long: tables differ in their widths."""
        names = {f.name.lower(): f.dataType for f in df.schema}
        if column.lower() not in names:
            raise QueryError(f"the table has no column {column!r}")
        c = F.col(f"`{column}`")
        return c.cast("long") if isinstance(names[column.lower()], _WHOLE) else c

    def key_type(self, labels: tuple[str, ...]) -> T.DataType:
        v = self.mapping.vertex(labels[0])
        kind = next(f.dataType for f in self.table(v.table, v.datasource).schema if f.name.lower() == v.id.lower())
        return T.LongType() if isinstance(kind, _WHOLE) else kind

    def vertices(self, p: Position) -> DataFrame:
        """All vertices of a position's labels, with their tables' columns."""
        parts = []
        self.used.update(p.labels)
        for label in p.labels:
            v = self.mapping.vertex(label)
            df = self.table(v.table, v.datasource)
            columns = [self._key(df, v.id).alias(p.id)] + ([F.lit(label).alias(p.label)] if len(p.labels) > 1 else [])
            parts.append(df.select(*columns, *(F.col(f"`{c}`").alias(p.raw(c)) for c in df.columns)))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def ids(self, label: str, name: str) -> DataFrame:
        v = self.mapping.vertex(label)
        df = self.table(v.table, v.datasource)
        return df.select(self._key(df, v.id).alias(name))

    def edges(self, p: Position) -> DataFrame:
        """All edges of a position's labels: id, src, dst, other columns."""
        parts = []
        self.used.update(p.labels)
        for label in p.labels:
            e = self.mapping.edge(label)
            df = self.table(e.table, e.datasource)
            key = self._key(df, e.id) if e.id else F.lit(None).cast("long")
            columns = [key.alias(p.id), self._key(df, e.src).alias(p.end("src")), self._key(df, e.dst).alias(p.end("dst"))]
            if len(p.labels) > 1:
                columns.append(F.lit(label).alias(p.label))
            parts.append(df.select(*columns, *(F.col(f"`{c}`").alias(p.raw(c)) for c in df.columns)))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def sure_end(self, e: Edge, out: bool, label: str) -> bool:
        """Whether the endpoint's existence needs no check: declared, or the row is the vertex."""
        v = self.mapping.vertex(label)
        return e.integrity or (e.table == v.table and e.datasource == v.datasource and (e.src if out else e.dst) == v.id)

    def column_type(self, p: Position, prop: str) -> tuple[list[str], T.DataType]:
        """The frame's columns of a property, of which each row has one, and its type."""
        special = {"id": p.id} if p.kind == "vertex" else {"id": p.id, "outV": p.end("src"), "inV": p.end("dst")}
        found: list[str] = []
        first: T.DataType = T.StringType()
        for label in p.labels:
            told = self.mapping.vertex(label) if p.kind == "vertex" else self.mapping.edge(label)
            df = self.table(told.table, told.datasource)
            if prop in told.properties:
                column = told.properties[prop]
            elif prop in special:
                name = {p.id: told.id, p.end("src"): getattr(told, "src", None), p.end("dst"): getattr(told, "dst", None)}[special[prop]]
                kind = next((f.dataType for f in df.schema if name and f.name.lower() == name.lower()), T.LongType())
                return [special[prop]], T.LongType() if isinstance(kind, _WHOLE) else kind
            else:
                continue
            field_ = next((f for f in df.schema if f.name.lower() == column.lower()), None)
            if field_ is None:
                raise QueryError(f"table {told.table} has no column {column!r}, to which {label}.{prop} is mapped")
            if p.raw(field_.name) not in found:
                found.append(p.raw(field_.name))
            first = first if len(found) > 1 else field_.dataType
        if not found:
            raise QueryError(f"{' or '.join(p.labels)} has no property {prop!r}")
        return found, first

    def has_property(self, p: Position, prop: str) -> bool:
        try:
            self.column_type(p, prop)
        except QueryError:
            return False
        return True

    def properties(self, p: Position) -> list[str]:
        names: dict[str, None] = {}
        for label in p.labels:
            told = self.mapping.vertex(label) if p.kind == "vertex" else self.mapping.edge(label)
            names.update(dict.fromkeys(told.properties))
        return list(names)
