"""Graph mappings: which tables, columns and keys act as vertex and edge labels."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field

from hopframe.errors import QueryError


@dataclass(frozen=True)
class Vertex:
    label: str
    table: str
    id: str
    properties: Mapping[str, str]
    datasource: str | None = None


@dataclass(frozen=True)
class Edge:
    """``integrity`` declares that every endpoint exists, so hops need not check."""

    label: str
    table: str
    id: str | None
    src: str
    dst: str
    properties: Mapping[str, str]
    out_label: str | None = None
    in_label: str | None = None
    datasource: str | None = None
    integrity: bool = False


def _first(d: Mapping, *names: str):
    return next((d[n] for n in names if str(d.get(n) or "").strip()), None)


def _tokens(name: str) -> list[str]:
    return [t for t in name.split(".")[-1].split("/")[-1].lower().split("_") if t]


@dataclass(frozen=True)
class GraphMapping:
    vertices: Mapping[str, Vertex]
    edges: Mapping[str, Edge]
    datasource: str | None = None
    backends: tuple = ()
    source: Mapping = field(default_factory=dict, compare=False)

    @classmethod
    def parse(cls, told: str | Mapping) -> GraphMapping:
        """From a JSON text or the same as a dict; labels and tables must not be blank."""
        try:
            told = json.loads(told) if isinstance(told, str) else told
        except json.JSONDecodeError as e:
            raise QueryError(f"a mapping is a JSON object: {e}") from None
        if not isinstance(told, Mapping):
            raise QueryError("a mapping is a JSON object")
        vertices, edges = {}, {}
        for kind, into in (("vertices", vertices), ("edges", edges)):
            for label, d in (told.get(kind) or {}).items():
                if not label.strip() or not str(d.get("table") or "").strip():
                    raise QueryError(f"{kind}: a label and its table must not be blank")
                props = dict(d.get("properties") or {})
                if kind == "vertices":
                    into[label] = Vertex(label, d["table"], d.get("idColumn") or "id", props, _first(d, "datasource"))
                else:
                    into[label] = Edge(
                        label, d["table"], _first(d, "idColumn"), d.get("outColumn") or "out_id", d.get("inColumn") or "in_id", props,
                        _first(d, "outVertexLabel", "sourceLabel", "outLabel"), _first(d, "inVertexLabel", "targetLabel", "inLabel"),
                        _first(d, "datasource"), bool(d.get("integrity")),
                    )
        if not vertices and not edges:
            raise QueryError("a mapping has at least one label")
        for e in edges.values():
            for end in (e.out_label, e.in_label):
                if end and end not in vertices:
                    raise QueryError(f"edge {e.label} names the unknown vertex label {end}")
        return cls(vertices, edges, _first(told, "defaultDatasource"), tuple(told.get("backends") or ()), told)

    def vertex(self, label: str) -> Vertex:
        if label not in self.vertices:
            raise QueryError(f"no vertex label {label!r} is mapped")
        return self.vertices[label]

    def edge(self, label: str) -> Edge:
        if label not in self.edges:
            raise QueryError(f"no edge label {label!r} is mapped")
        return self.edges[label]

    def only_vertex(self) -> str:
        if len(self.vertices) != 1:
            raise QueryError("g.V() needs hasLabel() where several vertex labels are mapped")
        return next(iter(self.vertices))

    def edge_for(self, names: set[str]) -> str:
        """The edge label of an edge query without hasLabel(): the only one, or the only one with all these properties."""
        names = names - {"id", "outV", "inV"}
        fit = [e.label for e in self.edges.values() if names <= set(e.properties)]
        if len(self.edges) == 1 and fit:
            return fit[0]
        if not names or len(fit) != 1:
            raise QueryError(f"g.E() needs hasLabel(): {len(fit)} edge labels fit")
        return fit[0]

    def endpoint(self, edge: Edge, out: bool, fallback: str | None = None) -> str:
        """The vertex label at an end of an edge: declared, else by the names of columns and tables."""
        told = edge.out_label if out else edge.in_label
        if told:
            return told
        if len(self.vertices) == 1:
            return next(iter(self.vertices))
        column = (edge.src if out else edge.dst).lower()
        stem = ([*_tokens(column.removesuffix("_id")), ""])[-1 if not _tokens(column.removesuffix("_id")) else -2]
        table = lambda v: v.table.split(".")[-1].split("/")[-1].lower()
        ends = _tokens(edge.table)
        end = ends[0 if out else -1] if ends else ""
        tests = (
            lambda v: bool(stem) and (table(v) == stem or table(v).startswith(stem) or _tokens(table(v))[-1].startswith(stem)),
            lambda v: v.label.lower() == stem,
            lambda v: v.id.lower() == column,
            lambda v: v.label.lower() == end,
            lambda v: bool(end) and table(v).startswith(end),
        )
        for test in tests:
            fit = [v.label for v in self.vertices.values() if test(v)]
            if len(fit) == 1:
                return fit[0]
        if fallback:
            return fallback
        raise QueryError(f"the {'out' if out else 'in'} vertex label of edge {edge.label} cannot be told; declare it")
