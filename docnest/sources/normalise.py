"""Column types as the documents need them, in one projection per table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docnest.functions.columns import column, find_name
from docnest.functions.values import is_json, needs_instant, parsed_json, to_instant
from docnest.plans.model import PlanError

UNPARSED = "_unparsed"
#: Instead of a schema: the one that all of the column's own values have together.
INFER = "infer"


def _as_ddl(schema: str) -> str | None:
    """A variant's schema as a type of Spark: objects are structs, what is only ever null in them is text; None for values that are not all objects
    with fields, or all arrays."""
    parts = schema.split("`")  # names with odd characters are between back-ticks
    parts[::2] = [p.replace("OBJECT<", "STRUCT<").replace("VOID", "STRING") for p in parts[::2]]
    made = "`".join(parts)
    return made if made.startswith(("STRUCT<", "ARRAY<")) and made != "STRUCT<>" else None


def inferred_schemas(df: DataFrame, names: Sequence[str]) -> dict[str, str | None]:
    """The schema of the JSON in each text column, merged over all its values in one pass; text that is no JSON as a whole does not count.

    Objects become structs of all their fields, numbers the narrowest type that holds them all, fields of different kinds a VARIANT.
    A column of single values, of values of several kinds or of none at all is a VARIANT itself (None).
    """
    if not names:
        return {}
    found = df.agg(*[F.schema_of_variant_agg(F.when(is_json(column(c)), F.try_parse_json(column(c)))).alias(f"s{i}") for i, c in enumerate(names)]).first()
    return {c: _as_ddl(found[f"s{i}"]) for i, c in enumerate(names)}


def normalise(df: DataFrame, json_columns: Mapping[str, str | T.DataType | None] | None = None) -> DataFrame:
    """Dates and times become millisecond instants; arrays, binary and the rest pass through.

    ``json_columns`` names text columns that hold JSON. With a schema the column becomes that
    type, and text that does not parse is kept in ``<column>_unparsed``; with ``INFER`` the schema is taken from the column's
    values, by a job over it. With ``None`` it becomes a VARIANT, in which such text is kept as a string.
    """
    wanted = {}
    for name, schema in (json_columns or {}).items():
        found = find_name(df, name)
        if found is None or not isinstance(df.schema[found].dataType, T.StringType):
            raise PlanError(f"{name} is not a text column")
        wanted[found] = schema
    wanted |= inferred_schemas(df, [c for c, schema in wanted.items() if schema == INFER])
    selected = []
    for field in df.schema.fields:
        col = column(field.name)
        if field.name not in wanted:
            changed = to_instant(col, field.dataType) if needs_instant(field.dataType) else col
            selected.append(changed.alias(field.name))
        elif wanted[field.name] is None:
            selected.append(parsed_json(col).alias(field.name))
        else:
            bad = col.isNotNull() & ~is_json(col)
            selected.append(F.when(~bad, F.from_json(col, wanted[field.name])).alias(field.name))
            selected.append(F.when(bad, col).alias(field.name + UNPARSED))
    return df.select(*selected)


def normalise_all(
    tables: Mapping[str, DataFrame], json_columns: Mapping[str, Mapping[str, str | T.DataType | None]] | None = None
) -> dict[str, DataFrame]:
    declared = json_columns or {}
    return {n: normalise(t, declared.get(n)) for n, t in tables.items()}
