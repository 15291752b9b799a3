"""Type normalisation of source columns and of stored documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def needs_instant(dtype: T.DataType) -> bool:
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return True
    if isinstance(dtype, T.ArrayType):
        return needs_instant(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return any(needs_instant(f.dataType) for f in dtype.fields)
    return False


def to_instant(col: Column, dtype: T.DataType) -> Column:
    """Dates and times as millisecond instants, at any depth; other types unchanged.

    A date is midnight UTC whatever the session zone; a zone-less timestamp is read in the
    session zone (keep it at UTC).
    """
    if isinstance(dtype, T.DateType):
        return F.timestamp_seconds(F.unix_date(col).cast("bigint") * 86400)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.date_trunc("MILLISECOND", col.cast("timestamp"))
    if isinstance(dtype, T.ArrayType) and needs_instant(dtype):
        return F.transform(col, lambda x: to_instant(x, dtype.elementType))
    if isinstance(dtype, T.StructType) and needs_instant(dtype):
        parts = [to_instant(col.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(col.isNotNull(), F.struct(*parts))
    return col


def _whole_json(col: Column) -> tuple[Column, Column]:
    """The text's JSON value, and whether all of the text is that value.

    Spark's parser stops after the first value and ignores what follows. The text is therefore
    parsed as the first element of an array whose second is the text's own hash: only if nothing
    follows the value is the hash found there.
    """
    mark = F.xxhash64(col)
    pair = F.try_parse_json(F.concat(F.lit("["), col, F.lit(","), mark.cast("string"), F.lit("]")))
    whole = F.coalesce(F.try_variant_get(pair, "$[1]", "bigint") == mark, F.lit(False))
    return F.variant_get(pair, "$[0]", "variant"), whole


def is_json(col: Column) -> Column:
    return _whole_json(col)[1]


def parsed_json(col: Column) -> Column:
    """JSON text as a VARIANT; text that does not parse as a whole is kept as a string inside it."""
    value, whole = _whole_json(col)
    return F.when(whole, value).otherwise(col.cast("variant"))


def stored_type(dtype: T.DataType) -> T.DataType:
    """The type a document field is stored in: decimals become doubles at any depth."""
    if isinstance(dtype, T.DecimalType):
        return T.DoubleType()
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(stored_type(dtype.elementType), dtype.containsNull)
    if isinstance(dtype, T.MapType):
        return T.MapType(dtype.keyType, stored_type(dtype.valueType), dtype.valueContainsNull)
    if isinstance(dtype, T.StructType):
        return T.StructType([T.StructField(f.name, stored_type(f.dataType), f.nullable) for f in dtype.fields])
    return dtype
