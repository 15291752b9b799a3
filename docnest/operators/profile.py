"""Column and relationship profiles: what the data says about keys, uniqueness and fan-out."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docnest.functions.columns import as_type, column, hashable
from docnest.operators import grouping as g
from docnest.plans.model import DEFAULT_MAX_CHILDREN, ONE_TO_MANY, ONE_TO_ONE, Catalogue, Edge
from docnest.sources.tables import union_all

# Values fall into so many slots by their hash; a column with equal values in the first slot is not looked at any further.
SLOTS = 64

PROFILE_SCHEMA = (
    "table_name string, position int, column_name string, type string, is_pk boolean,"
    " row_count bigint, value_count bigint, is_nullable boolean, is_unique boolean"
)


def _column_counts(name: str, df: DataFrame) -> DataFrame:
    """One row per column out of one scan: rows and non-null values."""
    parts = [F.count(F.lit(1)).alias("rows"), *[F.count(column(c)).alias(f"values_{i}") for i, c in enumerate(df.columns)]]
    entries = [F.struct(F.lit(i).alias("position"), F.col(f"values_{i}").alias("value_count")) for i in range(len(df.columns))]
    exploded = df.agg(*parts).select("rows", F.explode(F.array(*entries)).alias("e"))
    return exploded.select(F.lit(name).alias("table_name"), F.col("rows").alias("row_count"), "e.*")


def _as_whole(col: Column, dtype: T.DataType) -> Column | None:
    """The value itself as a BIGINT, for types no wider than that."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return col.cast("bigint")
    if isinstance(dtype, T.DateType):
        return F.unix_date(col).cast("bigint")
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(col)
    return None


def _codes(col: Column, dtype: T.DataType) -> tuple[Column, Column]:
    """Two BIGINTs that stand for a value: itself and 0, or two hashes of it with different seeds."""
    whole = _as_whole(col, dtype)
    if whole is not None:
        return whole, F.lit(0).cast("bigint")
    return F.when(col.isNotNull(), F.xxhash64(col)), F.xxhash64(F.lit(7), col)


def _coded(df: DataFrame, positions: Sequence[int], values: bool) -> DataFrame:
    """Per row and column: position, code, check and slot; with ``values`` also the value, where the code is not the value itself
    and its text stands for it."""
    entries = []
    for i, f in enumerate(df.schema.fields):
        if i in positions:
            code, check = _codes(column(f.name), f.dataType)
            parts = [F.lit(i).alias("position"), code.alias("code"), check.alias("check")]
            if values:
                told = _as_whole(column(f.name), f.dataType) is None and isinstance(f.dataType, T.AtomicType)
                parts.append((column(f.name).cast("string") if told else F.lit(None).cast("string")).alias("value"))
            entries.append(F.struct(*parts))
    codes = df.select(F.inline(F.array(*entries))).filter(F.col("code").isNotNull())
    return codes.withColumn("slot", F.pmod(F.xxhash64("code"), F.lit(SLOTS)))


def _first_slot(name: str, df: DataFrame, positions: Sequence[int]) -> DataFrame:
    """Per column, how many rows of the first slot share their most frequent code, and how many are known to share the value."""
    codes = _coded(df, positions, True).filter("slot = 0").drop("slot")
    counted = codes.groupBy("position", "code", "check").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    equal = F.max(F.when(F.col("low") == F.col("high"), F.col("n")))
    widest = counted.groupBy("position").agg(F.max("n").alias("most"), F.max_by("code", "n").alias("code"), equal.alias("equal"))
    return widest.withColumn("table_name", F.lit(name))


def _shared_codes(name: str, df: DataFrame, positions: Sequence[int]) -> DataFrame:
    """Per column, how many rows of the other slots share the most frequent code, and that code: one scan and
    one shuffle of 16 bytes a value for all columns of a table, whatever their width."""
    codes = _coded(df, positions, False).filter("slot <> 0").drop("slot")
    counted = codes.groupBy("position", "code", "check").agg(F.count(F.lit(1)).alias("n"))
    widest = counted.groupBy("position").agg(F.max("n").alias("most"), F.max_by("code", "n").alias("code"))
    return widest.withColumn("table_name", F.lit(name))


def _most_equal(name: str, position: int, rows: DataFrame, col: str) -> DataFrame:
    """How often the most frequent value of a column occurs."""
    counted = rows.filter(column(col).isNotNull()).groupBy(column(col).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    found = counted.agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"))
    return found.select(F.lit(name).alias("table_name"), F.lit(position).alias("position"), "most")


def _unique_columns(tables: Mapping[str, DataFrame]) -> set[tuple[str, int]]:
    """Which columns have no value twice, exactly.

    Equal values share a slot, so the first slot alone settles every column that has equal values in it, at 1/SLOTS of the shuffle; the
    others are looked at whole. Distinct codes prove distinct values, and for narrow types shared ones prove equal values. Where hashes
    are shared, the values are compared; only if those turn out to differ is the whole column grouped by value.
    """
    hashables = {n: [i for i, f in enumerate(t.schema.fields) if hashable(f.dataType)] for n, t in tables.items()}
    unique = {(name, i) for name, found in hashables.items() for i in found}

    def largest(frames: list[DataFrame]) -> dict[tuple[str, int], Row]:
        # one row per candidate column
        return {(r["table_name"], r["position"]): r for r in union_all(frames).collect()} if frames else {}

    def field(name: str, i: int) -> str:
        return tables[name].schema.fields[i].name

    def kind(name: str, i: int) -> T.DataType:
        return tables[name].schema.fields[i].dataType

    def whole(name: str, i: int) -> bool:
        return _as_whole(F.lit(0), kind(name, i)) is not None

    first = largest([_first_slot(name, tables[name], found) for name, found in hashables.items() if found])
    settled = {key for key, r in first.items() if r["most"] > 1 and (whole(*key) or (r["equal"] or 0) > 1)}
    left = {name: [i for i in found if (name, i) not in settled] for name, found in hashables.items()}
    coded = largest([_shared_codes(name, tables[name], found) for name, found in left.items() if found])
    shared = [(key, r["code"]) for found in (first, coded) for key, r in found.items() if key not in settled and r["most"] > 1]
    equal = settled | {key for key, _ in shared if whole(*key)}
    hashed = [(key, code) for key, code in shared if key not in equal]

    def compared(key: tuple[str, int], code: int) -> DataFrame:
        name, i = key
        rows = tables[name].filter(_codes(column(field(name, i)), kind(name, i))[0] == F.lit(code))
        return _most_equal(name, i, rows, field(name, i))

    by_value = union_all([compared(*pair) for pair in hashed]).collect() if hashed else []  # one or two rows per column
    repeated = {(r["table_name"], r["position"]) for r in by_value if r["most"] > 1}
    collided = {key for key, _ in hashed} - repeated
    grouped = largest([_most_equal(n, i, tables[n], field(n, i)) for n, i in collided])
    repeated |= {key for key, r in grouped.items() if r["most"] > 1}
    return unique - repeated - equal


def column_profile(spark: SparkSession, tables: Mapping[str, DataFrame], catalogue: Catalogue) -> DataFrame:
    """Per column: type, primary-key flag, counts, whether it has nulls and whether its values
    are unique.

    ``is_unique`` is exact, and null for types that cannot be compared.
    """
    measured = {
        (r["table_name"], r["position"]): r
        for r in union_all(_column_counts(n, t) for n, t in tables.items()).collect()  # one row per column
    }
    unique = _unique_columns(tables)
    rows = []
    for name, t in tables.items():
        pk = {k.lower() for k in catalogue.spec(name).pk}
        for i, f in enumerate(t.schema.fields):
            m = measured[name, i]
            rows.append(
                (
                    name, i + 1, f.name, f.dataType.simpleString(), f.name.lower() in pk,
                    m["row_count"], m["value_count"], m["value_count"] < m["row_count"],
                    (name, i) in unique if hashable(f.dataType) else None,
                )
            )
    return spark.createDataFrame(rows, PROFILE_SCHEMA)


def fan_outs(tables: Mapping[str, DataFrame], edges: Iterable[Edge]) -> dict[Edge, int]:
    """The largest number of children per parent of each edge: one job over the key columns."""
    edges = list(edges)
    if not edges:
        return {}
    frames = [g.fan_out(tables[e.child], e.fk).withColumn("edge", F.lit(i)) for i, e in enumerate(edges)]
    return {edges[r["edge"]]: r["max_children"] for r in union_all(frames).collect()}  # one row per edge


def _edge_counts(tables: Mapping[str, DataFrame], edge: Edge) -> DataFrame:
    """Both sides are counted per key before they meet, so a hot key is one row in the join."""
    child, parent = tables[edge.child], tables[edge.parent]
    wanted = g.key_type(parent, edge.pk, child, edge.fk)

    def counted(df: DataFrame, key: str, count: str, name: str) -> DataFrame:
        value = as_type(column(key), g.field_type(df, key), wanted)
        return df.groupBy(value.alias(name)).agg(F.count(F.lit(1)).alias(count))

    children = counted(child, edge.fk, "n", "ck")
    parents = counted(parent.filter(column(edge.pk).isNotNull()), edge.pk, "p", "pk")
    both = children.join(parents, F.col("ck") == F.col("pk"), "full_outer")
    with_key = F.col("ck").isNotNull()
    dangling = with_key & F.col("pk").isNull()

    def total(value: Column, when: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, value)), F.lit(0)).cast("bigint")

    one = F.lit(1)
    return both.agg(
        total(F.col("n"), F.col("n").isNotNull()).alias("child_rows"),
        total(F.col("n"), F.col("ck").isNull()).alias("null_key_rows"),
        total(one, with_key).alias("distinct_keys"),
        F.coalesce(F.max(F.when(with_key, F.col("n"))), F.lit(0)).cast("bigint").alias("max_children"),
        total(F.col("n"), dangling).alias("orphan_rows"),
        total(one, dangling).alias("orphan_keys"),
        total(F.col("p"), F.col("ck").isNull()).alias("childless_parents"),
    )


def edge_profile(
    tables: Mapping[str, DataFrame], catalogue: Catalogue, max_children: int = DEFAULT_MAX_CHILDREN
) -> DataFrame:
    """Per edge: declared and observed cardinality, fan-out, orphans, childless parents, and
    whether the nesting limit turns it into a reference."""
    frames = []
    for e in catalogue.edges:
        declared = catalogue.cardinality(e)
        limited = F.col("max_children") > max_children if declared != ONE_TO_ONE and not e.is_self else F.lit(False)
        frames.append(
            _edge_counts(tables, e).select(
                F.lit(e.child).alias("child"),
                F.lit(e.fk).alias("fk"),
                F.lit(e.parent).alias("parent"),
                F.lit(e.pk).alias("pk"),
                F.lit(catalogue.table_class(e.child)).alias("child_class"),
                F.lit(declared).alias("declared"),
                F.when(F.col("max_children") <= 1, ONE_TO_ONE).otherwise(ONE_TO_MANY).alias("observed"),
                "child_rows", "null_key_rows", "distinct_keys", "max_children",
                "orphan_rows", "orphan_keys", "childless_parents",
                limited.alias("downgrade"),
            )
        )
    return union_all(frames)


def edge_cardinality(tables: Mapping[str, DataFrame], catalogue: Catalogue) -> DataFrame:
    """Per edge: cardinality by the declared keys and as observed in the data."""
    frames = [
        g.fan_out(tables[e.child], e.fk).select(
            F.lit(e.child).alias("child"),
            F.lit(e.fk).alias("fk"),
            F.lit(e.parent).alias("parent"),
            F.lit(catalogue.cardinality(e)).alias("declared"),
            F.when(F.col("max_children") <= 1, ONE_TO_ONE).otherwise(ONE_TO_MANY).alias("observed"),
            "max_children",
        )
        for e in catalogue.edges
    ]
    return union_all(frames)


