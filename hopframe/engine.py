"""The engine: traversal text in, a lazy DataFrame out."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from hopframe.operators.compiler import Compiler
from hopframe.operators.frames import Frames
from hopframe.plans.mapping import GraphMapping
from hopframe.plans.parser import parse, render
from hopframe.plans.steps import HOPS, Plan, ordered
from hopframe.results import stream, to_results
from hopframe.sources.registry import Registry
from hopframe.sources.store import MappingStore
from hopframe.streaming.refresh import FreshTables


#: Partial paths that go into a hop, tried in turn where a limit asks for a few deep paths.
BEAMS = (2_000, 50_000)
#: A limit up to which a result is held by the driver, and hops from which paths count as deep.
FEW, DEEP = 10_000, 4


def deep_limit(plan: list[Plan]) -> int | None:
    """n where the plan asks for any n of the paths over many hops, else None."""
    names = [p.name for p in plan]
    if names[-1] != "limit" or sum(n in HOPS for n in names) < DEEP:
        return None
    first = next(i for i, n in enumerate(names) if n in HOPS)
    between, shown = names[first:-2], names[-2]
    n = plan[-1].args[-1].value
    fits = all(x in (*HOPS, "simplePath") for x in between) and shown in ("path", "values", "valueMap", "project") and 0 < n <= FEW
    return n if fits else None


@dataclass
class Explanation:
    """What a traversal becomes; nothing has run."""

    query: str
    steps: list[str]
    labels: list[str]
    notes: list[str]
    columns: list[str]
    physical: str

    def as_dict(self) -> dict:
        return vars(self).copy()


class Engine:
    """Compiles traversals over a mapping. One mapping may be given, or a store with an active one."""

    def __init__(self, spark: SparkSession, mapping: GraphMapping | str | dict | None = None, registry: Registry | None = None, store: MappingStore | None = None, read=None, fresh_seconds: float | None = None):
        """``fresh_seconds`` keeps tables in executor memory for that long; see :class:`FreshTables`."""
        self.spark, self.registry, self.store = spark, registry or Registry(spark), store or MappingStore()
        self.read = read or self.registry.read
        if fresh_seconds:
            self.read = FreshTables(self.read, fresh_seconds).read
        if mapping is not None:
            told = dict(mapping.source) if isinstance(mapping, GraphMapping) else mapping
            self.store.put(told, id="default")
            self.adopt(self.store.get())

    def adopt(self, mapping: GraphMapping) -> None:
        """Register the backends that a mapping declares."""
        for b in mapping.backends:
            self.registry.register(dict(b))

    def _frames(self, mapping: str | None, backend: str | None) -> Frames:
        return Frames(self.store.get(mapping), (lambda table, _: self.read(table, backend)) if backend else self.read)

    def _compiled(self, query: str, mapping: str | None, backend: str | None = None) -> tuple[DataFrame, str, list[Plan], Compiler]:
        plan = ordered(parse(query))
        compiler = Compiler(self._frames(mapping, backend))
        df, shape = compiler.compile(plan)
        return df, shape, plan, compiler

    def query(self, query: str, mapping: str | None = None, backend: str | None = None) -> DataFrame:
        """The traversal's result as a DataFrame, over the active mapping or the one of this id.

        All tables are read from ``backend`` if one is named, else as the mapping says.

        A few paths of many hops (a limit, nothing that needs all paths) are looked for at once,
        with a bounded number of partial paths going into each hop. If fewer are found than
        asked for, the bound grows, and at last there is none: the answer has as many rows as
        it has without bounds.
        """
        plan = ordered(parse(query))
        most = deep_limit(plan)
        if most is not None:
            for beam in BEAMS:
                df, _ = Compiler(self._frames(mapping, backend), beam).compile(plan)
                rows = df.collect()
                if len(rows) == most:
                    return self.spark.createDataFrame(rows, df.schema)
        return self._compiled(query, mapping, backend)[0]

    def results(self, query: str, mapping: str | None = None, most: int | None = None, backend: str | None = None) -> list:
        """The result as plain Python values for a client."""
        df, shape, plan, _ = self._compiled(query, mapping, backend)
        if deep_limit(plan) is not None:
            df = self.query(query, mapping, backend)
        return to_results(df, shape, most)

    def stream(self, query: str, mapping: str | None = None, backend: str | None = None, most: int | None = None) -> Iterator:
        """The rows of the result as :meth:`results` gives them, a partition at a time, at most ``most`` if it is given."""
        df, shape, plan, _ = self._compiled(query, mapping, backend)
        if deep_limit(plan) is not None:
            df = self.query(query, mapping, backend)
        return stream(df if most is None else df.limit(most), shape)

    def explain(self, query: str, mapping: str | None = None) -> Explanation:
        df, _, plan, compiler = self._compiled(query, mapping)
        labels = sorted(compiler.frames.used)
        mode = self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        return Explanation(render(parse(query)), [str(p) for p in plan], labels, compiler.notes, df.columns, df._jdf.queryExecution().explainString(mode))
