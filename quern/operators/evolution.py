"""Schemas that change between batches: one type that holds the values of all, column by column.

Types form a lattice: void < anything; byte < short < int < long < decimal < double; float < double; decimals widen to
hold both; date < timestamp without zone. A column that a frame lacks is null there. Any other pair of types is an error,
so nothing is turned into text or lost in silence.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}
"""Whole numbers, narrow to wide, with the digits that hold them."""


def joined(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """The least type that holds the values of both, or None."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    whole = [*_DIGITS]
    if type(a) in _DIGITS and type(b) in _DIGITS:
        return max(a, b, key=lambda t: whole.index(type(t)))
    number = lambda t: type(t) in _DIGITS or isinstance(t, (T.DecimalType, T.FloatType, T.DoubleType))
    if number(a) and number(b):
        if isinstance(a, (T.FloatType, T.DoubleType)) or isinstance(b, (T.FloatType, T.DoubleType)):
            return T.DoubleType()
        (p, s), (q, r) = ((t.precision, t.scale) if isinstance(t, T.DecimalType) else (_DIGITS[type(t)], 0) for t in (a, b))
        digits = max(p - s, q - r) + max(s, r)
        return T.DecimalType(digits, max(s, r)) if digits <= 38 else T.DoubleType()
    if {type(a), type(b)} == {T.DateType, T.TimestampNTZType}:
        return T.TimestampNTZType()
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        inner = joined(a.elementType, b.elementType)
        return None if inner is None else T.ArrayType(inner)
    return None


def reconciled(schemas: list[T.StructType]) -> T.StructType:
    """All columns, in the order in which they first appear, with types that hold the values of every schema."""
    found: dict[str, T.StructField] = {}
    for schema in schemas:
        for field in schema:
            known = found.get(field.name.lower())
            kind = field.dataType if known is None else joined(known.dataType, field.dataType)
            if kind is None:
                raise TypeError(f"column {field.name}: no type holds {known.dataType.simpleString()} and {field.dataType.simpleString()}")
            found[field.name.lower()] = T.StructField(field.name if known is None else known.name, kind)
    return T.StructType([*found.values()])


def conformed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of a schema: cast where the frame has another type, null where it lacks them."""
    own = {f.name.lower(): f for f in df.schema}
    column = lambda f: F.lit(None).cast(f.dataType) if f.name.lower() not in own else F.col(f.name) if own[f.name.lower()].dataType == f.dataType else F.col(f.name).cast(f.dataType)
    return df.select(*(column(f).alias(f.name) for f in schema))


def evolved_union(frames: list[DataFrame]) -> DataFrame:
    """The rows of all frames under their reconciled schema."""
    schema = reconciled([df.schema for df in frames])
    return functools.reduce(lambda a, b: a.union(b), (conformed(df, schema) for df in frames))
