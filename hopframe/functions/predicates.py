"""Comparison predicates over columns, with literals typed as the language asks.

Equality compares in the column's type: a literal that is no value of that type matches
nothing and differs from everything. Ordered comparisons are numeric where both sides are,
else by text. A null never matches.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hopframe.errors import QueryError
from hopframe.plans.parser import Literal, Name, Traversal

ORDERED = {"gt": "__gt__", "gte": "__ge__", "lt": "__lt__", "lte": "__le__"}
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def literal(arg) -> str | int | float | bool:
    """The Python value of an argument: strings stay strings, true and false are booleans."""
    if isinstance(arg, Literal):
        return arg.value
    if isinstance(arg, Name) and arg.text in ("true", "false"):
        return arg.text == "true"
    raise QueryError(f"{arg} is no literal")


def predicate(arg) -> tuple[str, object]:
    """(operator, literal) of a value or of ``gt(5)``, ``eq('x')`` and so on."""
    if isinstance(arg, Traversal):
        if len(arg.steps) != 1 or arg.steps[0].name not in (*ORDERED, "eq", "neq") or len(arg.steps[0].args) != 1:
            raise QueryError(f"unsupported predicate {arg}")
        return arg.steps[0].name, arg.steps[0].args[0]
    return "eq", arg


def compare(column: Column, kind: T.DataType, op: str, arg) -> Column:
    """The condition ``column op literal`` for a column of this type."""
    value, quoted = literal(arg), isinstance(arg, Literal) and arg.quoted
    if op in ("eq", "neq"):
        text = str(value).lower() if isinstance(value, bool) else str(value)
        if isinstance(kind, T.StringType):
            same = column == F.lit(text)
        elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):  # 5 equals 5.0, but not 5.5
            same = column.cast("decimal(38,10)") == F.lit(text).try_cast("decimal(38,10)") if "." in text else column == F.lit(text).try_cast(kind)
        else:
            same = column == F.lit(text).try_cast(kind)
        if op == "eq":
            return same
        return column.isNotNull() & ~F.coalesce(same, F.lit(False))
    if isinstance(value, str) and not quoted:
        raise QueryError(f"{op}() takes a literal")
    if isinstance(value, str) and isinstance(kind, NUMERIC):
        right = F.lit(value).try_cast("double")
    elif isinstance(value, str) and not isinstance(kind, T.StringType):
        right = F.lit(value).try_cast(kind)
    elif not isinstance(value, str) and isinstance(kind, T.StringType):
        column, right = column.try_cast("double"), F.lit(float(value))
    else:
        right = F.lit(value)
    return getattr(column, ORDERED[op])(right)
