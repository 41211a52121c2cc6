"""Compiles ordered steps, left to right, into one DataFrame.

A small state goes along: the frame, the positions of the path with their columns, aliases and
what the current object is. Three ways of following hops give the same answer at different
cost, and the steps that are still to come tell which is allowed:

- ``paths``: a join for each hop, a row for each path;
- ``frontier``: where a dedup() comes before anything that can tell paths apart, each hop's
  result is reduced to distinct elements;
- ``walks``: where only count() follows, each hop's result is one row an element with the
  number of walks that reach it.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hopframe.errors import QueryError
from hopframe.functions.predicates import compare, literal, predicate
from hopframe.operators.frames import Frames, Position
from hopframe.plans.parser import Literal, Name, Step, Traversal, render
from hopframe.plans.steps import EDGES, ENDS, HOPS, Plan

WALKS = "_walks"
_ELEMENTS = ("vertex", "edge")


@dataclass
class State:
    df: DataFrame
    path: list[Position]
    kind: str
    way: str = "paths"
    aliases: dict[str, Position] = field(default_factory=dict)
    names: list[str] = field(default_factory=list)  # output columns of a value or row
    value_of: tuple[Position, str] | None = None
    edge_root: bool = False
    shared: dict[tuple, str] = field(default_factory=dict)
    fresh: int = 0
    simple: int = 0  # positions that are known to differ
    shape: str = "elements"

    @property
    def here(self) -> Position:
        return self.path[-1]


class Compiler:
    def __init__(self, frames: Frames, beam: int | None = None):
        """``beam`` bounds the partial paths that go into each hop; see :func:`hopframe.engine.Engine.query`."""
        self.frames, self.mapping, self.beam = frames, frames.mapping, beam
        self.notes: list[str] = []

    # --- entry

    def compile(self, plan: list[Plan]) -> tuple[DataFrame, str]:
        """The result's frame and its shape: elements, value, row, count or path."""
        state, rest = self._root(plan)
        while rest:
            step, rest = rest[0], rest[1:]
            getattr(self, f"_do_{step.name}", self._hop if step.name in HOPS else None)(state, step, rest)
        return self._finish(state), state.shape

    def _root(self, plan: list[Plan]) -> tuple[State, list[Plan]]:
        first, rest = plan[0], plan[1:]
        cut = next((i for i, s in enumerate(rest) if s.name in (*HOPS, *EDGES, *ENDS)), len(rest))
        told = [s for s in rest[:cut] if s.name == "hasLabel"]
        rest = [s for i, s in enumerate(rest) if not (i < cut and s.name == "hasLabel")]
        kind = "vertex" if first.name == "V" else "edge"
        if told:
            label = str(literal(told[-1].args[0]))
        elif kind == "vertex":
            label = self.mapping.only_vertex()
        else:
            label = self.mapping.edge_for({str(literal(s.args[0])) for s in rest[:cut] if s.name in ("has", "hasNot")})
        p = Position(0, kind, (label,))
        df = self.frames.vertices(p) if kind == "vertex" else self.frames.edges(p)
        state = State(df, [p], kind, edge_root=kind == "edge")
        if first.args:
            self._keep(state, self._test(state, p, "id", first.args[0]))
        return state, rest

    def _choose(self, state: State, rest: list[Plan]) -> None:
        """Settle how the next hop is followed. What holds walks already cannot go back to paths."""
        way = self._way(rest)
        if WALKS in state.df.columns and way == "paths":
            raise QueryError("count() cannot be told apart here")
        if way != state.way or not self.notes:
            self.notes.append(f"hops are followed as {way}")
        state.way = way

    def _way(self, rest: list[Plan]) -> str:
        """How a hop may be followed, from the steps after it."""
        for i, s in enumerate(rest):
            if s.name in ("as", "select", "path", "simplePath", "limit", "order", "project", "valueMap", "groupCount", "sum", "mean", "max", "min", "bothE"):
                return "paths"
            if s.name == "where" and isinstance(s.args[0], (Literal,)):
                return "paths"
            if s.name == "where" and isinstance(s.args[0], Traversal) and s.args[0].steps[0].name in ("eq", "neq"):
                return "paths"
            if s.name == "values":
                return "frontier" if [x.name for x in rest[i + 1 :]][:1] == ["dedup"] and not any(x.name in ("sum", "mean") for x in rest[i:]) else "paths"
            if s.name == "dedup":
                return "frontier"
            if s.name == "count":
                return "walks"
        return "paths"

    # --- small helpers

    def _name(self, state: State, what: str) -> str:
        state.fresh += 1
        return f"_{what}{state.fresh}"

    def _keep(self, state: State, condition: Column) -> None:
        state.df = state.df.where(condition)

    def _element(self, state: State, step: str) -> Position:
        if state.kind not in _ELEMENTS:
            raise QueryError(f"{step}() needs a vertex or an edge before it")
        return state.here

    def _load(self, state: State, p: Position) -> None:
        """Join a position's table columns when something first asks for them."""
        if not p.loaded:
            there = self.frames.vertices(p)
            on = [p.id, p.label] if len(p.labels) > 1 else [p.id]
            state.df = state.df.join(there, on)
            p.loaded = p.sure = True

    def _settle(self, state: State, p: Position) -> None:
        """Drop rows whose element at this position does not exist."""
        if not p.sure:
            on = [p.id, p.label] if len(p.labels) > 1 else [p.id]
            state.df = state.df.join(self.frames.vertices(p).select(*on), on, "left_semi")
            p.sure = True

    def _prop(self, state: State, p: Position, prop: str) -> tuple[Column, T.DataType]:
        columns, kind = self.frames.column_type(p, prop)
        if columns != [p.id]:
            self._load(state, p)
        return (F.col(f"`{columns[0]}`") if len(columns) == 1 else F.coalesce(*(F.col(f"`{c}`") for c in columns))), kind

    def _test(self, state: State, p: Position, prop: str, arg) -> Column:
        op, value = predicate(arg)
        column, kind = self._prop(state, p, prop)
        return compare(column, kind, op, value)

    @staticmethod
    def _text(arg) -> str:
        if isinstance(arg, (Literal, Name)):
            return str(arg.value if isinstance(arg, Literal) else arg.text)
        raise QueryError(f"{render(arg)} is no name")

    # --- filters

    def _do_hasLabel(self, state: State, step: Plan, rest: list[Plan]) -> None:
        p, label = self._element(state, "hasLabel"), self._text(step.args[0])
        (self.mapping.vertex if p.kind == "vertex" else self.mapping.edge)(label)
        if label not in p.labels:
            self._keep(state, F.lit(False))
        elif len(p.labels) > 1:
            self._keep(state, F.col(p.label) == label)

    def _do_has(self, state: State, step: Plan, rest: list[Plan]) -> None:
        self._keep(state, self._test(state, self._element(state, "has"), self._text(step.args[0]), step.args[1]))

    def _do_hasId(self, state: State, step: Plan, rest: list[Plan]) -> None:
        self._keep(state, self._test(state, self._element(state, "hasId"), "id", step.args[0]))

    def _do_hasNot(self, state: State, step: Plan, rest: list[Plan]) -> None:
        self._keep(state, self._prop(state, self._element(state, "hasNot"), self._text(step.args[0]))[0].isNull())

    def _do_is(self, state: State, step: Plan, rest: list[Plan]) -> None:
        (name,) = state.names
        op, value = predicate(step.args[0])
        self._keep(state, compare(F.col(f"`{name}`"), state.df.schema[name].dataType, op, value))

    def _do_identity(self, state: State, step: Plan, rest: list[Plan]) -> None:
        pass

    def _do_simplePath(self, state: State, step: Plan, rest: list[Plan]) -> None:
        """The current element differs from each earlier one of its kind; so do all pairs at the top level."""
        pairs = [(a, b) for b in state.path[state.simple :] for a in state.path[: b.n] if a.kind == b.kind]
        state.simple = len(state.path)
        for a, b in pairs:
            if set(a.labels) & set(b.labels):
                differs = F.col(a.id) != F.col(b.id)
                if len(a.labels) > 1 or len(b.labels) > 1:
                    of = lambda p: F.col(p.label) if len(p.labels) > 1 else F.lit(p.labels[0])
                    differs = differs | (of(a) != of(b))
                self._keep(state, differs)

    # --- hops

    def _edge_labels(self, args: tuple) -> tuple[str, ...]:
        labels = tuple(dict.fromkeys(self._text(a) for a in args))
        if not labels:
            if len(self.mapping.edges) != 1:
                raise QueryError("an edge step needs a label where several are mapped")
            labels = (next(iter(self.mapping.edges)),)
        for label in labels:
            self.mapping.edge(label)
        return labels

    def _sides(self, label: str, direction: str, at: Position, n: int) -> list[tuple[str, str, str]]:
        """(key column, other column, other label) of each way to leave by an edge label."""
        e = self.mapping.edge(label)
        fall = at.labels[0]
        ends = {True: self.mapping.endpoint(e, True, fall), False: self.mapping.endpoint(e, False, fall)}
        ways = []
        if direction in ("out", "both") and ends[True] in at.labels:
            ways.append(("src", "dst", ends[False]))
        if direction in ("in", "both") and ends[False] in at.labels:
            ways.append(("dst", "src", ends[True]))
        return ways

    def _leave(self, state: State, labels: tuple[str, ...], direction: str, keep_edge: bool) -> tuple[DataFrame, tuple[str, ...], bool]:
        """Edges by which the current vertex is left, keyed by it: (frame, labels reached, whether they surely exist)."""
        at, n = state.here, len(state.path)
        parts, reached, sure = [], {}, True
        for label in labels:
            e = self.mapping.edge(label)
            p, ways = Position(n, "edge", (label,)), []
            for key, other, to in self._sides(label, direction, at, n):
                own = [F.lit(self.mapping.endpoint(e, key == "src", at.labels[0])).alias("_from")] if len(at.labels) > 1 else []
                ways.append(F.struct(F.col(p.end(key)).alias("_key"), F.col(p.end(other)).alias("_other"), F.lit(to).alias("_to"), *own))
                reached[to] = None
                sure &= self.frames.sure_end(e, other == "src", to)
            if not ways:
                continue
            df = self.frames.edges(p)
            if len(ways) == 1:
                df = df.withColumn("_way", ways[0])
            else:  # both directions of an edge in one scan
                each = F.array(*ways)
                if keep_edge:  # a loop is one edge
                    each = F.when(F.col(p.end("src")) == F.col(p.end("dst")), F.array(ways[0])).otherwise(each)
                df = df.withColumn("_way", F.explode(each))
            kept = [c for c in df.columns if c != "_way"] if keep_edge else []
            parts.append(df.select(*kept, "_way.*", F.lit(label).alias("_edge")))
        if not parts:
            raise QueryError(f"{' or '.join(at.labels)} has no {direction} edge {' or '.join(labels)}")
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), tuple(reached), sure

    def _join_left(self, state: State, left: DataFrame) -> None:
        at = state.here
        on = F.col(at.id) == F.col("_key")
        if len(at.labels) > 1:
            on = on & (F.col(at.label) == F.col("_from"))
        state.df = state.df.join(left, on).drop("_key", "_from")

    def _hop(self, state: State, step: Plan, rest: list[Plan]) -> None:
        at = self._element(state, step.name)
        if at.kind != "vertex":
            raise QueryError(f"{step.name}() needs a vertex before it")
        self._settle(state, at)
        self._choose(state, rest)
        if self.beam and at.n:
            state.df = state.df.limit(self.beam)
        labels = self._edge_labels(step.args)
        left, reached, sure = self._leave(state, labels, step.name, keep_edge=False)
        p = Position(len(state.path), "vertex", reached, loaded=False, sure=sure)
        left = left.select("_key", *(["_from"] if "_from" in left.columns else []), F.col("_other").alias(p.id), *([F.col("_to").alias(p.label)] if len(reached) > 1 else []))
        self._join_left(state, left)
        state.df = state.df.where(F.col(p.id).isNotNull())
        state.path.append(p)
        state.kind = "vertex"
        if state.way != "paths":
            self._narrow(state, p)

    def _narrow(self, state: State, p: Position) -> None:
        """Reduce rows to elements of the current position: once each, or with a number of walks."""
        on = [p.id, p.label] if len(p.labels) > 1 else [p.id]
        if state.way == "frontier":
            state.df = state.df.select(*on).distinct()
        else:
            n = F.col(WALKS) if WALKS in state.df.columns else F.lit(1).cast("decimal(38,0)")
            state.df = state.df.groupBy(*on).agg(F.sum(n).cast("decimal(38,0)").alias(WALKS))
        p.loaded = False
        state.shared.clear()

    def _edge_step(self, state: State, step: Plan, rest: list[Plan]) -> None:
        at = self._element(state, step.name)
        if at.kind != "vertex":
            raise QueryError(f"{step.name}() needs a vertex before it")
        self._settle(state, at)
        self._choose(state, rest)
        labels = self._edge_labels(step.args)
        left, _, _ = self._leave(state, labels, step.name[:-1], keep_edge=True)
        p = Position(len(state.path), "edge", labels)
        if len(labels) > 1:
            left = left.withColumn(p.label, F.col("_edge"))
        left = left.withColumnsRenamed({"_other": p.end("other"), "_to": p.end("to")}).drop("_edge")
        if state.way == "frontier":
            state.df = state.df.select(at.id, *([at.label] if len(at.labels) > 1 else []))
        self._join_left(state, left)
        state.path.append(p)
        state.kind = "edge"

    _do_outE = _do_inE = _do_bothE = _edge_step

    def _end(self, state: State, step: Plan, rest: list[Plan]) -> None:
        e = self._element(state, step.name)
        if e.kind != "edge":
            raise QueryError(f"{step.name}() needs an edge before it")
        ends = {"outV": [("src", True)], "inV": [("dst", False)], "bothV": [("src", True), ("dst", False)], "otherV": [("other", None)]}[step.name]
        n, parts, reached = len(state.path), [], {}
        sure = True
        for column, out in ends:
            if out is None:
                if e.end("other") not in state.df.columns:
                    raise QueryError("otherV() needs outE(), inE() or bothE() before it")
                to = F.col(e.end("to"))
                found = {self.mapping.endpoint(self.mapping.edge(x), o) for x in e.labels for o in (True, False)}
                sure &= all(self.frames.sure_end(self.mapping.edge(x), o, self.mapping.endpoint(self.mapping.edge(x), o)) for x in e.labels for o in (True, False))
            else:
                by = {x: self.mapping.endpoint(self.mapping.edge(x), out) for x in e.labels}
                found = set(by.values())
                sure &= all(self.frames.sure_end(self.mapping.edge(x), out, v) for x, v in by.items())
                to = F.lit(next(iter(by.values())))
                for x, v in by.items():
                    to = F.when(F.col(e.label) == x, F.lit(v)).otherwise(to) if len(e.labels) > 1 else to
            reached.update(dict.fromkeys(sorted(found)))
            parts.append((F.col(e.end(column)), to))
        p = Position(n, "vertex", tuple(reached), loaded=False, sure=sure)
        if len(parts) == 1:
            state.df = state.df.withColumn(p.id, parts[0][0]).withColumn(p.label, parts[0][1])
        else:  # both ends of an edge in one scan
            ends = F.explode(F.array(*(F.struct(c.alias("id"), t.alias("to")) for c, t in parts)))
            state.df = state.df.withColumn("_end", ends).withColumn(p.id, F.col("_end.id")).withColumn(p.label, F.col("_end.to")).drop("_end")
        if len(reached) == 1:
            state.df = state.df.drop(p.label)
        state.df = state.df.where(F.col(p.id).isNotNull())
        state.path.append(p)
        state.kind = "vertex"
        later = {s.name for s in rest} & {"as", "path", "select"}
        if state.edge_root and len(state.path) == 2 and not later and not state.aliases:  # endpoint vertices of an edge query are distinct
            on = [p.id, p.label] if len(reached) > 1 else [p.id]
            state.df = state.df.select(*on).distinct()
            state.shared.clear()
        else:
            self._choose(state, rest)
            if state.way != "paths":
                self._narrow(state, p)

    _do_outV = _do_inV = _do_bothV = _do_otherV = _end

    # --- where

    def _do_where(self, state: State, step: Plan, rest: list[Plan]) -> None:
        first = step.args[0]
        if len(step.args) == 2:
            return self._where_alias(state, self._alias(state, self._text(first)), step.args[1], step.bys)
        if not isinstance(first, Traversal):
            raise QueryError(f"unsupported where({render(first)})")
        head = first.steps[0]
        if head.name in ("eq", "neq") and len(first.steps) == 1:
            return self._where_alias(state, self._element(state, "where"), first, step.bys)
        if head.name == "select":
            name = self._text(head.args[0])
            if len(first.steps) != 2 or first.steps[1].name != "is":
                raise QueryError(f"unsupported where({render(first)})")
            op, value = predicate(first.steps[1].args[0])
            if name in state.names:
                return self._keep(state, compare(F.col(f"`{name}`"), state.df.schema[name].dataType, op, value))
            raise QueryError(f"where(select()) names the unknown column {name!r}")
        self._element(state, "where")
        self._settle(state, state.here)
        self._semi(state, first, False)

    def _alias(self, state: State, name: str) -> Position:
        if name not in state.aliases:
            raise QueryError(f"no step is called {name!r}")
        return state.aliases[name]

    def _where_alias(self, state: State, left: Position, right, bys: tuple) -> None:
        op, arg = predicate(right)
        if op not in ("eq", "neq"):
            raise QueryError("where() compares positions with eq() or neq()")
        other = self._alias(state, self._text(arg))
        if bys:
            a, b = (self._prop(state, p, self._text(bys[0][0]))[0] for p in (left, other))
        else:
            a, b = F.col(left.id), F.col(other.id)
        self._keep(state, a == b if op == "eq" else a != b)

    def _semi(self, state: State, t: Traversal, negate: bool) -> None:
        """Filter by one condition: semi and anti joins where it is a test of existence, else a marker."""
        head = t.steps[0]
        if head.name == "and" and not negate:
            if len(head.args) < 2:
                raise QueryError("and() takes at least two conditions")
            for x in head.args:
                self._semi(state, x, False)
        elif head.name == "not":
            if len(head.args) != 1:
                raise QueryError("not() takes one condition")
            self._semi(state, head.args[0], not negate)
        elif head.name not in ("and", "or", "has", "hasNot", "values") and not self._counted(t):
            keys = self._neighbours(state, t).select("_k", *(["_l"] if len(state.here.labels) > 1 else [])).distinct()
            state.df = state.df.join(keys, self._on(state), "left_anti" if negate else "left_semi")
        else:
            mark = self._mark(state, t)
            self._keep(state, ~mark if negate else mark)

    @staticmethod
    def _counted(t: Traversal) -> bool:
        return len(t.steps) >= 2 and t.steps[-1].name == "is" and t.steps[-2].name == "count"

    def _on(self, state: State) -> Column:
        on = F.col(state.here.id) == F.col("_k")
        return on & (F.col(state.here.label) == F.col("_l")) if len(state.here.labels) > 1 else on

    def _mark(self, state: State, t: Traversal) -> Column:
        """A boolean column, never null, that tells whether the current element meets a condition."""
        head = t.steps[0]
        if head.name in ("and", "or"):
            if len(head.args) < 2:
                raise QueryError(f"{head.name}() takes at least two conditions")
            marks = [self._mark(state, x) for x in head.args]
            return reduce((lambda a, b: a & b) if head.name == "and" else (lambda a, b: a | b), marks)
        if head.name == "not":
            return ~self._mark(state, head.args[0])
        p = state.here
        if head.name == "has" and len(t.steps) == 1 and len(head.args) == 2:
            return F.coalesce(self._test(state, p, self._text(head.args[0]), head.args[1]), F.lit(False))
        if head.name == "hasNot" and len(t.steps) == 1:
            return self._prop(state, p, self._text(head.args[0]))[0].isNull()
        if head.name == "values" and len(t.steps) == 2 and t.steps[1].name == "is":
            return F.coalesce(self._test(state, p, self._text(head.args[0]), t.steps[1].args[0]), F.lit(False))
        if self._counted(t):
            n = self._degree(state, Traversal(t.steps[:-2]))
            op, value = predicate(t.steps[-1].args[0])
            return compare(n, T.LongType(), op, value)
        name = self._name(state, "has")
        keys = self._neighbours(state, t).select("_k", *(["_l"] if len(p.labels) > 1 else [])).distinct().withColumn(name, F.lit(True))
        state.df = state.df.join(keys, self._on(state), "left").drop("_k", "_l")
        return F.coalesce(F.col(name), F.lit(False))

    def _around(self, state: State, head: Step) -> tuple[State, Position]:
        """Edges or neighbours of the current element, as a state of their own keyed by ``_k``."""
        if head.name not in (*HOPS, *EDGES) or state.here.kind != "vertex":
            raise QueryError(f"unsupported condition {render(head)}")
        if not head.args:
            raise QueryError(f"{head.name}() needs an edge label here")
        labels = self._edge_labels(head.args)
        edge = head.name in EDGES
        left, reached, sure = self._leave(State(state.df, list(state.path), "vertex"), labels, head.name.removesuffix("E"), keep_edge=edge)
        n = len(state.path)
        p = Position(n, "edge", labels) if edge else Position(n, "vertex", reached, loaded=False, sure=sure)
        left = left.withColumnRenamed("_key", "_k")
        left = left.withColumnRenamed("_from", "_l") if "_from" in left.columns else left
        if edge:
            left = left.withColumn(p.label, F.col("_edge")) if len(labels) > 1 else left
        else:
            left = left.withColumn(p.id, F.col("_other"))
            left = left.withColumn(p.label, F.col("_to")) if len(reached) > 1 else left
        return State(left.drop("_other", "_to", "_edge").where("_k is not null"), [*state.path, p], p.kind), p

    def _neighbours(self, state: State, t: Traversal) -> DataFrame:
        """Rows (_k, the neighbour's or edge's columns) of ``outE|inE|bothE|out|in|both(l)[.has()…]``, keyed by the element's id."""
        if any(s.name not in ("has", "hasNot", "hasId", "hasLabel") for s in t.steps[1:]):
            raise QueryError(f"unsupported condition {render(t)}")
        inner, p = self._around(state, t.steps[0])
        for s in t.steps[1:]:
            getattr(self, f"_do_{s.name}")(inner, Plan(s.name, s.args), [])
        self._settle(inner, p)
        return inner.df

    def _degrees(self, state: State, asked: list[Traversal]) -> None:
        """Compute degrees over the same edges, with different filters, in one aggregation."""
        alike: dict[str, dict[str, Traversal]] = {}
        for t in asked:
            if t.steps[0].name in EDGES and all(s.name == "has" for s in t.steps[1:]):
                alike.setdefault(render(t.steps[0]), {})[render(t)] = t
        for some in alike.values():
            if len(some) < 2:
                continue
            inner, p = self._around(state, next(iter(some.values())).steps[0])
            counts = []
            for text, t in some.items():
                name = state.shared["degree", state.here.n, text] = self._name(state, "n")
                tests = [self._test(inner, p, self._text(s.args[0]), s.args[1]) for s in t.steps[1:]]
                counts.append((F.count_if(reduce(lambda a, b: a & b, tests)) if tests else F.count("*")).alias(name))
            by = ["_k", *(["_l"] if len(state.here.labels) > 1 else [])]
            state.df = state.df.join(inner.df.groupBy(*by).agg(*counts), self._on(state), "left").drop("_k", "_l")

    def _degree(self, state: State, t: Traversal) -> Column:
        """The number of neighbours or edges, 0 where none; equal ones are computed once."""
        key = ("degree", state.here.n, render(t))
        if key not in state.shared:
            name = state.shared[key] = self._name(state, "n")
            by = ["_k", *(["_l"] if len(state.here.labels) > 1 else [])]
            counts = self._neighbours(state, t).groupBy(*by).agg(F.count("*").alias(name))
            state.df = state.df.join(counts, self._on(state), "left").drop("_k", "_l")
        return F.coalesce(F.col(state.shared[key]), F.lit(0).cast("long"))

    # --- projections

    def _do_as(self, state: State, step: Plan, rest: list[Plan]) -> None:
        state.aliases[self._text(step.args[0])] = self._element(state, "as")

    def _rows(self, state: State, columns: list[Column], names: list[str], kind: str, shape: str) -> None:
        if len({n.lower() for n in names}) != len(names):
            raise QueryError(f"{', '.join(names)}: names must differ")
        extra = [WALKS] if WALKS in state.df.columns else []
        tie = [F.col(state.here.id).alias("_tie")] if state.kind in _ELEMENTS else [F.col("_tie")] * ("_tie" in state.df.columns)
        state.df = state.df.select(*(c.alias(n) for c, n in zip(columns, names, strict=True)), *tie, *extra)
        state.kind, state.names, state.shape = kind, names, shape

    def _do_values(self, state: State, step: Plan, rest: list[Plan]) -> None:
        p, prop = self._element(state, "values"), self._text(step.args[0])
        column, _ = self._prop(state, p, prop)
        self._settle(state, p)
        state.value_of = (p, prop)
        self._rows(state, [column], [prop], "value", "value")

    def _do_valueMap(self, state: State, step: Plan, rest: list[Plan]) -> None:
        p = self._element(state, "valueMap")
        asked = [self._text(a) for a in step.args]
        names = [n for n in self.frames.properties(p) if not asked or n in asked]
        if not names:
            raise QueryError(f"valueMap() names no property of {' or '.join(p.labels)}")
        columns = [self._prop(state, p, n)[0] for n in names]
        self._settle(state, p)
        self._rows(state, columns, names, "row", "map")

    def _do_project(self, state: State, step: Plan, rest: list[Plan]) -> None:
        self._element(state, "project")
        self._settle(state, state.here)
        counted = [b[0] for b in step.bys if isinstance(b[0], Traversal) and b[0].steps[-1].name == "count"]
        self._degrees(state, [Traversal(t.steps[:-1]) for t in counted if len(t.steps) > 1])
        columns = [self._by(state, b[0]) for b in step.bys]
        self._rows(state, columns, [self._text(a) for a in step.args], "row", "map")

    def _by(self, state: State, arg) -> Column:
        p = state.here
        if isinstance(arg, Name) and arg.text in ("id", "T.id"):
            return F.col(p.id)
        if not isinstance(arg, Traversal):
            return self._prop(state, p, self._text(arg))[0]
        names = [s.name for s in arg.steps]
        head = arg.steps[0]
        if names == ["identity"]:
            return F.col(p.id)
        if names == ["values"]:
            return self._prop(state, p, self._text(head.args[0]))[0]
        if names == ["constant"]:
            return F.lit(literal(head.args[0]))
        if names[-1] == "count" and head.name in (*HOPS, *EDGES):
            return self._degree(state, Traversal(arg.steps[:-1]))
        if names[-2:] == ["values", "fold"] and head.name in HOPS:
            return self._fold(state, Traversal(arg.steps[:-2]), self._text(arg.steps[-2].args[0]))
        if names == ["choose"] and len(head.args) == 3:
            test, yes, no = head.args
            given = self._mark(state, test) if isinstance(test, Traversal) else None
            if given is None or not all(isinstance(x, Traversal) for x in (yes, no)):
                raise QueryError("choose() takes a condition and two constants")
            return F.when(given, self._by(state, yes)).otherwise(self._by(state, no))
        if names in (["outV", "values"], ["inV", "values"]) and p.kind == "edge":
            return self._endpoint_value(state, head.name, self._text(arg.steps[1].args[0]))
        raise QueryError(f"unsupported by({render(arg)})")

    def _fold(self, state: State, t: Traversal, prop: str) -> Column:
        """Neighbours' values in order, joined by commas; null where there is none."""
        key = ("fold", state.here.n, render(t), prop)
        if key not in state.shared:
            name = state.shared[key] = self._name(state, "fold")
            rows = self._neighbours(state, t)
            n = len(state.path)
            head = t.steps[0]
            labels = tuple(dict.fromkeys(to for x in self._edge_labels(head.args) for _, _, to in self._sides(x, head.name, state.here, n)))
            q = Position(n, "vertex", labels, loaded=any(c.startswith(f"_{n}_c_") for c in rows.columns))
            inner = State(rows, [*state.path, q], "vertex")
            column, _ = self._prop(inner, q, prop)
            by = ["_k", *(["_l"] if len(state.here.labels) > 1 else [])]
            folded = inner.df.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(column.cast("string"))), ",").alias(name), F.count(column).alias("_some"))
            folded = folded.select(*by, F.when(F.col("_some") > 0, F.col(name)).alias(name))
            state.df = state.df.join(folded, self._on(state), "left").drop("_k", "_l")
        return F.col(state.shared[key])

    def _endpoint_value(self, state: State, end: str, prop: str) -> Column:
        e = state.here
        if len(e.labels) > 1:
            raise QueryError("endpoint values need one edge label")
        label = self.mapping.endpoint(self.mapping.edge(e.labels[0]), end == "outV")
        key = ("end", e.n, end)
        if key not in state.shared:
            state.shared[key] = str(100 + len(state.shared))
            q = Position(int(state.shared[key]), "vertex", (label,))
            state.df = state.df.join(self.frames.vertices(q), F.col(e.end("src" if end == "outV" else "dst")) == F.col(q.id))
        return F.col(f"`{self.frames.column_type(Position(int(state.shared[key]), 'vertex', (label,)), prop)[0][0]}`")

    def _do_path(self, state: State, step: Plan, rest: list[Plan]) -> None:
        self._element(state, "path")
        for p in state.path:
            self._settle(state, p)
        columns, names = [], []
        for i, p in enumerate(state.path):
            if not step.bys:
                columns.append(F.col(p.id))
                names.append(f"id{i}")
                continue
            arg = step.bys[min(i, len(step.bys) - 1)][0]
            if isinstance(arg, Traversal) and [s.name for s in arg.steps] == ["identity"]:
                columns.append(F.col(p.id))
                names.append(f"id{i}")
                continue
            prop = self._text(arg)
            columns.append(self._prop(state, p, prop)[0] if self.frames.has_property(p, prop) else F.lit(None).cast("string"))
            names.append(f"{prop}{i}")
        self._rows(state, columns, names, "row", "path")

    def _do_select(self, state: State, step: Plan, rest: list[Plan]) -> None:
        names = [self._text(a) for a in step.args]
        if state.kind in ("row", "value"):
            missing = [n for n in names if n not in state.names]
            if missing:
                raise QueryError(f"select() names the unknown column {missing[0]!r}")
            return self._rows(state, [F.col(f"`{n}`") for n in names], names, "value" if len(names) == 1 else "row", "value" if len(names) == 1 else "map")
        places = [self._alias(state, n) for n in names]
        for p in {id(p): p for p in (*places, state.here)}.values():
            self._settle(state, p)
        bys = step.bys * len(names) if len(step.bys) == 1 else step.bys
        columns = []
        for i, p in enumerate(places):
            arg = bys[i][0] if bys else None
            if arg is None or (isinstance(arg, Traversal) and [s.name for s in arg.steps] == ["identity"]):
                columns.append(F.col(p.id))
            else:
                columns.append(self._prop(state, p, self._text(arg))[0])
        root = state.edge_root
        self._rows(state, columns, names, "value" if len(names) == 1 else "row", "value" if len(names) == 1 else "map")
        if root and not any(s.name in ("sum", "mean", "count", "order") for s in rest):  # an edge query's positions are distinct
            state.df = state.df.select(*(f"`{n}`" for n in names)).distinct()

    # --- aggregation, order, limits

    def _do_count(self, state: State, step: Plan, rest: list[Plan]) -> None:
        if state.kind in _ELEMENTS:
            for p in state.path:
                self._settle(state, p)
        n = F.sum(WALKS) if WALKS in state.df.columns else F.count("*")
        state.df = state.df.agg(F.coalesce(n, F.lit(0)).cast("long").alias("count"))
        state.kind, state.names, state.shape = "value", ["count"], "value"

    def _fold_values(self, state: State, name: str, f) -> None:
        if len(state.names) != 1:
            raise QueryError(f"{name}() needs one property")
        state.df = state.df.agg(f(F.col(f"`{state.names[0]}`")).alias(name))
        state.kind, state.names, state.shape = "value", [name], "value"

    def _do_sum(self, state: State, step: Plan, rest: list[Plan]) -> None:
        self._fold_values(state, "sum", F.sum)

    def _do_mean(self, state: State, step: Plan, rest: list[Plan]) -> None:
        self._fold_values(state, "mean", F.avg)

    def _do_max(self, state: State, step: Plan, rest: list[Plan]) -> None:
        self._fold_values(state, "max", F.max)

    def _do_min(self, state: State, step: Plan, rest: list[Plan]) -> None:
        self._fold_values(state, "min", F.min)

    def _do_groupCount(self, state: State, step: Plan, rest: list[Plan]) -> None:
        arg = step.bys[0][0]
        self._element(state, "groupCount")
        for p in state.path:
            self._settle(state, p)
        if isinstance(arg, Traversal) and arg.steps[0].name == "select":
            inner = arg.steps[1:]
            if len(inner) != 1 or inner[0].name != "by":
                raise QueryError("groupCount().by(select('a').by('p')) is the form")
            column, name = self._prop(state, self._alias(state, self._text(arg.steps[0].args[0])), self._text(inner[0].args[0]))[0], self._text(inner[0].args[0])
        elif isinstance(arg, Traversal):
            column, name = self._by(state, arg), "key"
        else:
            name = self._text(arg)
            column = self._prop(state, state.here, name)[0]
        if name == "count":
            raise QueryError("groupCount() by a property called count is ambiguous")
        state.df = state.df.groupBy(column.alias(name)).agg(F.count("*").alias("count"))
        state.kind, state.names, state.shape = "row", [name, "count"], "map"

    def _do_order(self, state: State, step: Plan, rest: list[Plan]) -> None:
        by = step.bys[0]
        arg, down = by[0], len(by) > 1 and "desc" in self._text(by[1]).lower()
        if isinstance(arg, Name) and arg.text in ("values", "keys") and state.names and state.names[-1] == "count":
            column = F.col("count") if arg.text == "values" else F.col(f"`{state.names[0]}`")
        elif isinstance(arg, Traversal) and arg.steps[0].name == "select":
            column = self._out(state, self._text(arg.steps[0].args[0]))
        elif state.kind in _ELEMENTS:
            column = self._by(state, arg)
        elif isinstance(arg, Name) and arg.text in ("asc", "desc", "Order.asc", "Order.desc") and len(state.names) == 1:
            column, down = F.col(f"`{state.names[0]}`"), "desc" in arg.text
        else:
            column = self._out(state, self._text(arg))
        ties = [F.col(state.here.id)] if state.kind in _ELEMENTS else [F.col("_tie")] if "_tie" in state.df.columns else [F.col(f"`{n}`") for n in state.names]
        keys = [column.desc_nulls_last() if down else column.asc_nulls_last(), *(t.asc_nulls_last() for t in ties)]
        state.df = state.df.orderBy(*keys)

    def _out(self, state: State, name: str) -> Column:
        if name not in state.names:
            raise QueryError(f"order() names the unknown column {name!r}")
        return F.col(f"`{name}`")

    def _do_limit(self, state: State, step: Plan, rest: list[Plan]) -> None:
        if state.kind in _ELEMENTS:
            self._settle(state, state.here)
        state.df = state.df.limit(int(literal(step.args[-1])))

    def _do_dedup(self, state: State, step: Plan, rest: list[Plan]) -> None:
        if state.kind not in _ELEMENTS:
            state.df = state.df.select(*(f"`{n}`" for n in state.names)).distinct()
            return
        p = state.here
        self._settle(state, p)
        on = [p.id, p.label] if len(p.labels) > 1 else [p.id]
        if p.kind == "edge" and any(self.mapping.edge(x).id is None for x in p.labels):
            on = [c for c in state.df.columns if c.startswith(f"_{p.n}_")]
        if any(s.name in ("select", "path", "where") for s in rest):
            state.df = state.df.dropDuplicates(on)
        elif p.loaded:
            state.df = state.df.dropDuplicates(on).select(*(c for c in state.df.columns if c.startswith(f"_{p.n}_")))
        else:
            state.df = state.df.select(*on).distinct()

    # --- result

    def _finish(self, state: State) -> DataFrame:
        if state.kind not in _ELEMENTS:
            return state.df.select(*(F.col(f"`{n}`") for n in state.names))
        for p in state.path:
            self._settle(state, p)
        p = state.here
        self._load(state, p)
        start = f"_{p.n}_c_"
        raw = [c for c in state.df.columns if c.startswith(start)]
        return state.df.select(*(F.col(f"`{c}`").alias(c.removeprefix(start)) for c in raw))
