"""What the operators of this subpackage share: table access, shared storage, words."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Every ASCII byte that is neither a letter nor a digit becomes a space; A-Z become a-z.
ALNUM_LOWER = bytes(
    (c + 32 if 65 <= c <= 90 else c) if (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128) else 32
    for c in range(256)
)

#: Rows and bytes that a Python function gets at a time; one row may have more bytes.
BATCH_ROWS, BATCH_BYTES = 1000, 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """The column of this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(taken: list[str], name: str) -> str:
    """``name``, with underscores added until no taken name equals it in any case."""
    have = {t.lower() for t in taken}
    while name.lower() in have:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that the driver and all executors share.

    The cluster names the folder in ``spark.checkpoint.dir``. Only where that is unset and all
    tasks run in the driver's process, as in tests, a folder below the warehouse is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return f"{base.rstrip('/')}/hopframe-{uuid.uuid4().hex}"


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


#: Paths of the tables written so far for the table that :func:`settled` is making.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def written(df: DataFrame) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder: its lineage ends there.

    The table goes with :func:`drop_written`, when its writing fails, or at the latest when the application ends.
    """
    spark = df.sparkSession
    name = shared_dir(spark)
    path, files = _path(spark, name)
    try:
        df.write.parquet(name)
    except BaseException:
        files.delete(path, True)
        raise
    files.deleteOnExit(path)
    if (made := _MADE.get()) is not None:
        made.append(name)
    return spark.read.schema(df.schema).parquet(name)


def drop_written(df: DataFrame) -> None:
    """Remove the files behind a table that :func:`written` made and nothing reads any more."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path, files = _path(spark, name)
        files.delete(path, True)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives, as a written table; all else that was written for it is removed, also when it fails."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        out = written(make())
        made.pop()
        return out
    finally:
        _MADE.reset(token)
        for name in made:
            path, files = _path(spark, name)
            files.delete(path, True)


class Scratch:
    """Written tables that are all removed when the block ends, also if it fails."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def __call__(self, df: DataFrame) -> DataFrame:
        self.tables.append(written(df))
        return self.tables[-1]

    def adopt(self, df: DataFrame) -> DataFrame:
        self.tables.append(df)
        return df

    def drop(self, df: DataFrame) -> None:
        self.tables = [t for t in self.tables if t is not df]
        drop_written(df)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for t in self.tables:
            drop_written(t)
        self.tables = []


def release(spark: SparkSession) -> None:
    """Let Spark remove shuffle files of finished jobs now: it does so once its driver has collected their handles."""
    gc.collect()
    spark._jvm.System.gc()


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about BATCH_ROWS and BATCH_BYTES at most."""
    n = batch.num_rows
    step = max(1, min(BATCH_ROWS, n * BATCH_BYTES // max(1, batch.nbytes)))
    for lo in range(0, n, step):
        yield batch.slice(lo, step)


def give_back() -> None:
    """Return freed memory to the machine: Spark keeps a Python worker for later tasks, beside those that run."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def map_rows(
    docs: DataFrame,
    columns: list[tuple[str, str]],
    out: list[tuple[str, T.DataType | str]],
    fn: Callable[[Iterator[tuple]], Iterator[tuple]],
) -> DataFrame:
    """Arrow-batched map. ``columns``: (column of docs, Spark type) that ``fn`` gets as lists, in order.

    ``fn`` takes an iterator of tuples of Python lists and yields tuples of lists or Arrow
    arrays in the order of ``out``. Other columns of docs never reach Python, so their names
    cannot clash with those of the result.
    """
    picked = docs.select(*[column(c).cast(t).alias(f"_{i}") for i, (c, t) in enumerate(columns)])
    schema = T.StructType([T.StructField(n, T.DataType.fromDDL(t) if isinstance(t, str) else t) for n, t in out])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for cols in fn(tuple(c.to_pylist() for c in part.columns) for b in batches for part in slices(b)):
            arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(cols, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from mapped(batches)
        give_back()

    return picked.mapInArrow(run, schema)


def alnum_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z, as UTF-8."""
    return text.translate(ALNUM_LOWER).split() if text else []


def ascii_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, as UTF-8."""
    return text.lower().split() if text else []
