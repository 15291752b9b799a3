"""Small column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    """A top-level column by its exact name, dots and blanks included."""
    return F.col(quoted(name))


def find_name(df: DataFrame, name: str) -> str | None:
    """The frame's own spelling of a column name; Spark ignores case, so do we."""
    lowered = name.lower()
    return next((c for c in df.columns if c.lower() == lowered), None)


def has_column(df: DataFrame, name: str) -> bool:
    return find_name(df, name) is not None


def without(names: Iterable[str], dropped: Iterable[str]) -> list[str]:
    gone = {d.lower() for d in dropped}
    return [n for n in names if n.lower() not in gone]


def document(names: Sequence[str]) -> Column:
    return F.struct(*[column(n).alias(n) for n in names])


def orderable(dtype: T.DataType) -> bool:
    """Whether Spark can compare two values of this type."""
    if isinstance(dtype, T.StructType):
        return all(orderable(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return orderable(dtype.elementType)
    return not isinstance(dtype, (T.MapType, T.VariantType, T.CalendarIntervalType))


def hashable(dtype: T.DataType) -> bool:
    """Whether Spark can group by this type."""
    return orderable(dtype)


def orderable_names(df: DataFrame, names: Sequence[str]) -> list[str]:
    types = {f.name.lower(): f.dataType for f in df.schema.fields}
    return [n for n in names if orderable(types[n.lower()])]


def empty_array(dtype: T.ArrayType) -> Column:
    return F.array().cast(dtype)


_INTEGRAL_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}


def common_key_type(left: T.DataType, right: T.DataType) -> T.DataType:
    """The one type two join keys are compared in.

    Text against anything else is compared as text, so that an ANSI session never tries to
    read a text key as a number.
    """
    if left == right:
        return left
    if isinstance(left, T.StringType) or isinstance(right, T.StringType):
        return T.StringType()
    digits = [_INTEGRAL_DIGITS.get(type(t)) for t in (left, right)]
    if all(digits):
        return T.LongType() if T.LongType() in (left, right) else T.IntegerType()
    if all(d or isinstance(t, T.DecimalType) for d, t in zip(digits, (left, right), strict=True)):
        scale = max(getattr(t, "scale", 0) for t in (left, right))
        whole = max(d or t.precision - t.scale for d, t in zip(digits, (left, right), strict=True))
        return T.DecimalType(min(38, whole + scale), scale)
    floats = (T.FloatType, T.DoubleType)
    if isinstance(left, floats) and isinstance(right, floats):
        return T.DoubleType()
    if isinstance(left, T.NumericType) and isinstance(right, T.NumericType):
        # Exact on both sides: as doubles, large whole numbers would meet their neighbours.
        return T.DecimalType(38, max(getattr(t, "scale", 0) for t in (left, right)))
    temporal = (T.DateType, T.TimestampType, T.TimestampNTZType)
    if isinstance(left, temporal) and isinstance(right, temporal):
        return T.TimestampType()
    return T.StringType()


def as_type(col: Column, current: T.DataType, wanted: T.DataType) -> Column:
    """A key in the compared type. A float that is no such decimal becomes null and matches nothing; a number that meets
    text is written without an exponent and without zeros after its last digit."""
    if current == wanted:
        return col
    if isinstance(current, (T.FloatType, T.DoubleType)) and isinstance(wanted, T.DecimalType):
        made = col.try_cast(wanted)
        return F.when(made.cast("double") == col.cast("double"), made)
    if isinstance(wanted, T.StringType):
        if isinstance(current, (T.FloatType, T.DoubleType)):
            whole = col.try_cast("decimal(38,0)")
            return F.when(whole.cast("double") == col.cast("double"), whole.cast("string")).otherwise(col.cast("string"))
        if isinstance(current, T.DecimalType) and current.scale:
            return F.regexp_replace(F.regexp_replace(col.cast("string"), "0+$", ""), "[.]$", "")
    return col.cast(wanted)
