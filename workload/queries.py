"""One query per operator over the sample tables. Nested results are flattened to keys, sizes and
ordered digests, so that two engines can be compared value by value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docnest import (
    Approximation,
    Attribute,
    Catalogue,
    Computed,
    Custom,
    Edge,
    Outlier,
    Settings,
    Subset,
    TableSpec,
    embed_chunks,
    embed_junction,
    embed_levels,
    embed_one,
    migrate,
    plan_for,
    register_pattern,
)
from docnest.functions.columns import has_column
from docnest.functions.naming import dataset_name
from docnest.operators import patterns as p
from docnest.operators.keys import references
from docnest.operators.profile import column_profile, edge_cardinality, edge_profile
from docnest.reports.overview import (
    column_overview,
    migration_summary,
    relationship_map,
    source_overview,
    target_overview,
)
from docnest.reports.reconcile import reconciled
from docnest.session import delete_at_end, shared_folder
from docnest.sinks.documents import read_documents
from docnest.sinks.versions import read_current
from docnest.sources.normalise import INFER, normalise, normalise_all
from docnest.sources.tables import row_counts, sample_rows, sql_rows, union_all
from workload.tables import CATALOGUE, COLUMNS, EDGES, KEYS, WHOLE_KEYS, columns_of, load, part_of

LINE_KEY = KEYS["lineitem"]


def text_of(array: Column, item: Callable[[Column], Column], between: str = ",") -> Column:
    return F.array_join(F.transform(array, item), between)


def fields(*names: str) -> Callable[[Column], Column]:
    """An item of a digest: the named fields of a nested document, ``:`` between them."""
    return lambda x: F.concat_ws(":", *[x.getField(n).cast("string") for n in names])


def nested(field: str, size: str, digest: str, item: Callable[[Column], Column]) -> list[Column]:
    """Size and digest of a nested array."""
    return [F.size(field).cast("bigint").alias(size), text_of(F.col(field), item).alias(digest)]


# --- sources ---------------------------------------------------------------------------------


def scan_orders(spark: SparkSession, sf: str) -> DataFrame:
    orders = normalise(load(spark, sf, "orders")["orders"])
    return orders.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
        F.unix_millis("o_orderdate").alias("o_orderdate_ms"), "o_orderpriority",
    )


def sql_rich_customers(spark: SparkSession, sf: str) -> DataFrame:
    return sql_rows(
        spark, load(spark, sf, "customer", "nation"),
        "SELECT c_custkey AS id, n_name AS nation, CAST(c_acctbal AS DECIMAL(18,2)) AS balance"
        " FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 5000",
    )


def normalised_events(spark: SparkSession, sf: str) -> DataFrame:
    events = normalise(load(spark, sf, "events")["events"], {"props": "struct<k:bigint>"})
    return events.select(
        "event_id", F.unix_micros("ts").alias("ts_us"), F.col("props.k").alias("k"),
        F.col("props_unparsed").isNull().alias("parsed"),
    )


def inferred_events(spark: SparkSession, sf: str) -> DataFrame:
    """The properties of events as a struct that nobody declared."""
    events = normalise(load(spark, sf, "events")["events"], {"props": INFER})
    return events.select(
        "event_id", F.typeof("props").alias("type"), F.col("props.k").alias("k"), F.col("props_unparsed").isNull().alias("parsed")
    )


def normalised_dates(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders")["orders"].select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return normalise(orders).select("o_orderkey", F.unix_millis("day").alias("day_ms"))


def normalised_nested_dates(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "lineitem")["lineitem"].select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.array(F.to_date("l_shipdate"), F.to_date(F.lit(None).cast("string"))).alias("days"),
    )
    return normalise(rows).select(
        "l_orderkey", "l_linenumber", "l_partkey", F.size("days").cast("bigint").alias("n_days"),
        F.unix_millis(F.col("days")[0]).alias("first_ms"),
    )


def array_and_binary_passthrough(spark: SparkSession, sf: str) -> DataFrame:
    """Arrays and bytes come out as they are: sizes and digests of every element and byte."""
    tables = load(spark, sf, "embeddings", "documents")
    vectors = normalise(tables["embeddings"]).select(
        F.lit("embeddings").alias("kind"), F.col("vec_id").alias("id"), F.size("embedding").cast("bigint").alias("n"),
        F.md5(told("embedding", "array<float>", F.col("embedding")).cast("binary")).alias("digest"),
    )
    raw = tables["documents"].select("doc_id", F.encode("text", "UTF-8").alias("body"))
    bodies = normalise(raw).select(
        F.lit("documents").alias("kind"), F.col("doc_id").alias("id"), F.octet_length("body").cast("bigint").alias("n"), F.md5("body").alias("digest")
    )
    return vectors.unionByName(bodies)


def normalised_instants(spark: SparkSession, sf: str) -> DataFrame:
    """Instants with a zone lose what is below a millisecond, before and after 1970."""
    micros = F.unix_micros(F.col("ts").cast("timestamp")) + F.col("event_id") % 1000
    rows = load(spark, sf, "events")["events"].select("event_id", F.timestamp_micros(micros).alias("ts_in"), F.timestamp_micros(-micros).alias("before"))
    return normalise(rows).select("event_id", F.unix_micros("ts_in").alias("ts_us"), F.unix_micros("before").alias("before_us"))


def json_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Parsable text becomes a nested value, other text stays a string inside the VARIANT."""
    tables = load(spark, sf, "events", "documents")
    events = normalise(tables["events"], {"props": None}).select(
        F.lit("events").alias("kind"), F.col("event_id").alias("id"),
        F.variant_get("props", "$.k", "bigint").alias("number"), F.lit(None).cast("bigint").alias("kept_chars"),
    )
    texts = normalise(tables["documents"], {"text": None}).select(
        F.lit("documents").alias("kind"), F.col("doc_id").alias("id"), F.lit(None).cast("bigint").alias("number"),
        F.length(F.try_variant_get("text", "$", "string")).cast("bigint").alias("kept_chars"),
    )
    return events.unionByName(texts)


def table_row_counts(spark: SparkSession, sf: str) -> DataFrame:
    return row_counts(load(spark, sf))


def told(c: str, kind: str, value: Column) -> Column:
    """A value of the sample tables as text that two engines write alike; nulls as a minus."""
    if kind == "double":
        value = F.round(value * 100).cast("bigint")
    elif kind.startswith("timestamp"):
        value = F.unix_millis(value.cast("timestamp"))
    elif kind.startswith("array"):
        value = F.array_join(F.transform(value, lambda x: F.floor(x.cast("double") * 1048576).cast("string")), " ")
    return F.coalesce(value.cast("string"), F.lit("-"))


def table_samples(spark: SparkSession, sf: str) -> DataFrame:
    """The first five rows of every table: all their columns, read back from the JSON."""
    tables = load(spark, sf)
    samples = sample_rows(tables, Catalogue.of([TableSpec(t, k) for t, k in WHOLE_KEYS.items()]), 5)
    out = []
    for t in COLUMNS:
        row = F.from_json("row_json", ", ".join(f"{c} {k}" for c, k in columns_of(t)))
        mine = samples.filter(F.col("table_name") == t).select("table_name", row.alias("r"))
        text = F.concat_ws("|", *[told(c, k, F.col("r").getField(c)) for c, k in columns_of(t)])
        out.append(mine.select("table_name", F.md5(text.cast("binary")).alias("row_digest")))
    return union_all(out)


# --- profiles --------------------------------------------------------------------------------


def profile_columns(spark: SparkSession, sf: str) -> DataFrame:
    return column_profile(spark, load(spark, sf), CATALOGUE)


def profile_cardinality(spark: SparkSession, sf: str) -> DataFrame:
    return edge_cardinality(load(spark, sf), CATALOGUE)


def profile_edges(spark: SparkSession, sf: str) -> DataFrame:
    return edge_profile(load(spark, sf), CATALOGUE, 500)


def profile_orphans(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of customers below a balance have lost their parent; some keys are null."""
    tables = load(spark, sf, "customer", "orders")
    tables["customer"] = tables["customer"].filter("c_acctbal >= 1000")
    key = F.when(F.col("o_orderstatus") == "P", None).otherwise(F.col("o_custkey"))
    tables["orders"] = tables["orders"].withColumn("o_custkey", key)
    found = edge_profile(tables, part_of("customer", "orders"))
    return found.select("child_rows", "null_key_rows", "distinct_keys", "orphan_rows", "orphan_keys", "childless_parents")


def discovered_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The edges of all tables, found without a catalogue; a user is a customer by another name."""
    return references(spark, load(spark, sf), {"user_id": "custkey"})


# --- nesting ---------------------------------------------------------------------------------


def embed_one_label(spark: SparkSession, sf: str) -> DataFrame:
    t = load(spark, sf, "documents", "labels")
    docs = embed_one(t["documents"], t["labels"], pk="doc_id", fk="doc_id", field="labels", child_pk=["doc_id"])
    return docs.select(
        "doc_id", F.col("labels").isNotNull().alias("has_label"), F.col("labels.quality").alias("quality"),
        F.col("labels.toxic").alias("toxic"), F.length("text").cast("bigint").alias("text_chars"),
    )


def embed_one_first_match(spark: SparkSession, sf: str) -> DataFrame:
    """Declared 1:1 with several matches: the smallest primary key wins."""
    t = load(spark, sf, "customer", "orders")
    docs = embed_one(t["customer"], t["orders"], pk="c_custkey", fk="o_custkey", field="orders", child_pk=["o_orderkey"])
    return docs.select("c_custkey", F.col("orders.o_orderkey").alias("first_order"))


CHUNK = 1000


def embed_many_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    t = load(spark, sf, "orders", "lineitem")
    docs = embed_chunks(t["orders"], t["lineitem"], pk="o_orderkey", fk="l_orderkey", field="lineitem", child_pk=LINE_KEY, size=CHUNK)
    return docs.select("o_orderkey", "chunk", *nested("lineitem", "n_lines", "lines", fields("l_linenumber", "l_partkey")))


def embed_two_children(spark: SparkSession, sf: str) -> DataFrame:
    """Nations with two kinds of children, each in chunks of 40, so that most have several."""
    t = load(spark, sf, "nation", "supplier", "customer")
    out = []
    for child, fk, key in (("supplier", "s_nationkey", "s_suppkey"), ("customer", "c_nationkey", "c_custkey")):
        docs = embed_chunks(t["nation"], t[child], pk="n_nationkey", fk=fk, field=child, child_pk=[key], size=40)
        out.append(docs.select("n_nationkey", F.lit(child).alias("kind"), "chunk", *nested(child, "n_members", "members", fields(key))))
    return union_all(out)


def embed_levels_customer(spark: SparkSession, sf: str) -> DataFrame:
    t = load(spark, sf, "customer", "orders", "lineitem")
    docs = embed_levels(
        [(t["lineitem"], "lineitem", LINE_KEY), (t["orders"], "orders", ["o_orderkey"]), (t["customer"], "customer", [])],
        [("l_orderkey", "o_orderkey"), ("o_custkey", "c_custkey")],
        chunk=CHUNK,
    )

    def order(o: Column) -> Column:
        lines = text_of(o.getField("lineitem"), fields("l_linenumber", "l_partkey"))
        return F.concat(o.getField("o_orderkey").cast("string"), F.lit("["), lines, F.lit("]"))

    return docs.select("c_custkey", "chunk", *nested("orders", "n_orders", "orders_digest", order))


def embed_levels_region(spark: SparkSession, sf: str) -> DataFrame:
    t = load(spark, sf, "region", "nation", "supplier")
    docs = embed_levels(
        [(t["supplier"], "supplier", ["s_suppkey"]), (t["nation"], "nation", ["n_nationkey"]), (t["region"], "region", [])],
        [("s_nationkey", "n_nationkey"), ("n_regionkey", "r_regionkey")],
        chunk=CHUNK,
    )
    inner = docs.select("r_regionkey", F.explode_outer("nation").alias("n"))
    return inner.select(
        "r_regionkey", "n.n_nationkey", F.col("n.chunk").alias("chunk"), *nested("n.supplier", "n_suppliers", "suppliers", fields("s_suppkey"))
    )


def embed_junction_part(spark: SparkSession, sf: str) -> DataFrame:
    t = load(spark, sf, "part", "lineitem")
    docs = embed_junction(
        t["part"], t["lineitem"], pk="p_partkey", fk="l_partkey", other_fks=["l_orderkey", "l_suppkey"], field="part",
        child_pk=LINE_KEY, chunk=CHUNK,
    )
    names = docs.schema["part"].dataType.elementType.names
    return docs.select(
        "p_partkey", "chunk",
        F.lit(",".join(names)).alias("payload_fields"),
        *nested("part", "n_rows", "rows_digest", fields("l_linenumber", "l_returnflag", "l_linestatus")),
    )


def embed_junction_keys(spark: SparkSession, sf: str) -> DataFrame:
    """A junction without payload keeps its partner key."""
    t = load(spark, sf, "customer", "nation")
    pairs = t["customer"].select("c_custkey", "c_nationkey")
    docs = embed_junction(
        t["nation"], pairs, pk="n_nationkey", fk="c_nationkey", other_fks=["c_custkey"], field="nation",
        child_pk=["c_custkey", "c_nationkey"], chunk=CHUNK,
    )
    return docs.select("n_nationkey", "chunk", *nested("nation", "n_customers", "customers", fields("c_custkey")))


def embed_fan_in(spark: SparkSession, sf: str) -> DataFrame:
    """One child nested into each of its parents, in chunks."""
    t = load(spark, sf, "orders", "part", "supplier", "lineitem")
    out = []
    for e in EDGES:
        if e.child == "lineitem":
            docs = embed_chunks(t[e.parent], t["lineitem"], pk=e.pk, fk=e.fk, field="lineitem", child_pk=LINE_KEY, size=100)
            quantity = F.aggregate("lineitem", F.lit(0).cast("bigint"), lambda a, x: a + x.l_quantity.cast("bigint"))
            size = F.size("lineitem").cast("bigint").alias("n_lines")
            out.append(
                docs.select(F.lit(e.parent).alias("parent"), F.col(e.pk).cast("bigint").alias("id"), "chunk", size, quantity.alias("quantity"))
            )
    return union_all(out)


def trade_lanes(t: dict[str, DataFrame]) -> DataFrame:
    """Lines per (customer nation, supplier nation): a child with two keys to the same parent.

    Lines are counted per order and supplier before they meet either, so that a hot order brings
    at most one row per supplier into the joins.
    """
    lines = t["lineitem"].groupBy("l_orderkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    customers = t["customer"].select("c_custkey", F.col("c_nationkey").alias("buyer_id"))
    suppliers = t["supplier"].select("s_suppkey", F.col("s_nationkey").alias("seller_id"))
    orders = t["orders"].select("o_orderkey", "o_custkey")
    sold = lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_orderkey", "seller_id").agg(F.sum("n").alias("n"))
    bought = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "buyer_id")
    return (
        sold.join(bought, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("buyer_id", "seller_id").agg(F.sum("n").alias("n_lines"))
        .withColumn("id", (F.col("buyer_id") * 1000 + F.col("seller_id")).cast("bigint"))
    )


def embed_role_names(spark: SparkSession, sf: str) -> DataFrame:
    t = load(spark, sf, "nation", "lineitem", "orders", "customer", "supplier")
    catalogue = Catalogue.of(
        [TableSpec("nation", "n_nationkey"), TableSpec("lane", "id")],
        [Edge("lane", "buyer_id", "nation", "n_nationkey"), Edge("lane", "seller_id", "nation", "n_nationkey")],
    )
    docs = migrate({"nation": t["nation"], "lane": trade_lanes(t)}, catalogue).documents["nation"]
    return docs.select(
        "n_nationkey",
        *nested("lane_by_buyer_id", "n_bought", "bought", fields("seller_id", "n_lines")),
        *nested("lane_by_seller_id", "n_sold", "sold", fields("buyer_id", "n_lines")),
    )


def self_join_referrals(spark: SparkSession, sf: str) -> DataFrame:
    """A table counted as its own child; such an edge is never nested."""
    customer = load(spark, sf, "customer")["customer"]
    referred = customer.withColumn("c_referrer", F.when(F.col("c_custkey") >= 10, F.floor(F.col("c_custkey") / 10)))
    catalogue = Catalogue.of([TableSpec("customer", "c_custkey")], [Edge("customer", "c_referrer", "customer", "c_custkey")])
    settings = Settings(patterns={"customer": [Computed("referrals", "COUNT", "customer", "c_custkey")]})
    docs = migrate({"customer": referred}, catalogue, settings).documents["customer"]
    return docs.select("c_custkey", "c_referrer", "referrals")


def reference_edge(spark: SparkSession, sf: str) -> DataFrame:
    """A referenced child keeps its key and its own dataset; the parent gets nothing."""
    t = load(spark, sf, "nation", "customer")
    moved = migrate(t, part_of("nation", "customer"), Settings({"customer.nation": "REFERENCE"}))
    nations = moved.datasets["nation"].select(
        F.lit("nation").alias("dataset"), F.col("n_nationkey").cast("bigint").alias("id"),
        F.lit(None).cast("int").alias("fk"), F.lit(len(moved.datasets["nation"].columns)).alias("n_fields"),
    )
    customers = moved.datasets["customer"].select(
        F.lit("customer").alias("dataset"), F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("fk"),
        F.lit(len(moved.datasets["customer"].columns)).alias("n_fields"),
    )
    return nations.unionByName(customers)


# --- patterns --------------------------------------------------------------------------------


def computed_count_orders(spark: SparkSession, sf: str) -> DataFrame:
    t = load(spark, sf, "customer", "orders")
    docs = p.computed(t["customer"], t["orders"], pk="c_custkey", fk="o_custkey", field="order_count", function="COUNT")
    return docs.select("c_custkey", "order_count")


def computed_sum_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    t = load(spark, sf, "orders", "lineitem")
    reader = p.ChildReader(
        t["lineitem"], "l_orderkey", "o_orderkey", LINE_KEY,
        [
            Computed("revenue", "SUM", "lineitem", "l_extendedprice", scale=2),
            Computed("line_numbers", "sum", "lineitem", "l_linenumber"),
            Computed("part_keys", "SUM", "lineitem", "l_partkey", wide=True),
            Computed("flags", "SUM", "lineitem", "l_returnflag"),
            Computed("n_lines", "COUNT", "lineitem", "l_tax"),
        ],
    )
    docs = reader.apply(t["orders"])
    return docs.select(
        "o_orderkey", F.col("revenue").cast("decimal(38,2)").alias("revenue"), "line_numbers",
        F.col("part_keys").cast("decimal(38,2)").alias("part_keys"), F.col("flags").cast("decimal(38,2)").alias("flags"),
        "n_lines",
    )


def computed_count_through_junction(spark: SparkSession, sf: str) -> DataFrame:
    """Counts junction rows, not distinct partners."""
    t = load(spark, sf, "part", "lineitem")
    docs = p.computed(t["part"], t["lineitem"], pk="p_partkey", fk="l_partkey", field="supplies", function="count")
    return docs.select("p_partkey", "supplies")


def computed_sum_text(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers in text are summed exactly, other text is skipped."""
    t = load(spark, sf, "customer", "events")
    k = F.get_json_object("props", "$.k")
    text = F.when(F.col("event_type") == "error", F.concat(k, F.lit("x"))).when(
        F.col("event_type") == "click", F.concat(k, F.lit(".25"))
    ).otherwise(k)
    events = t["events"].select("event_id", "user_id", text.alias("amount"))
    docs = p.computed(
        t["customer"], events, pk="c_custkey", fk="user_id", field="amount", function="SUM", column="amount", scale=4
    )
    return docs.select("c_custkey", F.col("amount").cast("decimal(38,4)").alias("amount"))


def subset_recent_orders(spark: SparkSession, sf: str) -> DataFrame:
    t = load(spark, sf, "customer", "orders")
    docs = p.subset(
        t["customer"], t["orders"], pk="c_custkey", fk="o_custkey", child_pk=["o_orderkey"], limit=3, field="recent_orders"
    )
    return docs.select("c_custkey", *nested("recent_orders", "n_recent", "recent", fields("o_orderkey", "o_orderstatus")))


def outlier_events(spark: SparkSession, sf: str) -> DataFrame:
    t = load(spark, sf, "customer", "events")
    docs = p.outlier(
        t["customer"], t["events"], pk="c_custkey", fk="user_id", child_pk=["event_id"], threshold=60, field="events"
    )
    return docs.select("c_custkey", *nested("events", "n_kept", "kept", fields("event_id", "event_type")), "has_extras")


def customer_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """Count, sum, subset and capped array over the same child rows, planned together."""
    t = load(spark, sf, "customer", "orders")
    reader = p.ChildReader(
        t["orders"], "o_custkey", "c_custkey", ["o_orderkey"],
        [
            Computed("order_count", "COUNT", "orders"),
            Computed("order_total", "SUM", "orders", "o_totalprice", scale=2),
            Subset("orders", 3),
            Outlier("orders", 5),
        ],
    )
    docs = reader.apply(t["customer"])
    return docs.select(
        "c_custkey", "order_count", F.col("order_total").cast("decimal(38,2)").alias("order_total"),
        *nested("recent_orders", "n_recent", "recent", fields("o_orderkey")),
        *nested("orders", "n_kept", "kept", fields("o_orderkey")),
        "has_extras",
    )


def attribute_part(spark: SparkSession, sf: str) -> DataFrame:
    part = load(spark, sf, "part")["part"].withColumn("p_type", F.when(F.col("p_size") >= 10, F.col("p_type")))
    docs = p.attribute(
        part, Attribute("traits", [("p_brand", "Brand"), ("p_type", "Type"), ("p_missing", "Missing"), ("p_brand", "Again")])
    )
    return docs.select("p_partkey", F.lit(len(docs.columns)).alias("n_fields"), *nested("traits", "n_traits", "traits_digest", fields("key", "value")))


def attribute_mixed_part(spark: SparkSession, sf: str) -> DataFrame:
    """Values of several types share one VARIANT field."""
    part = load(spark, sf, "part")["part"]
    docs = p.attribute(part, Attribute("facts", {"p_name": "Name", "p_size": "Size", "p_partkey": "Key"}))

    def fact(x: Column) -> Column:
        return F.concat_ws(":", x.getField("key"), F.variant_get(x.getField("value"), F.lit("$"), "string"))

    return docs.select("p_brand", "p_type", *nested("facts", "n_facts", "facts_digest", fact))


def approximation_types(spark: SparkSession, sf: str) -> DataFrame:
    part = load(spark, sf, "part")["part"].select(
        "p_partkey", F.col("p_partkey").alias("key"), "p_size",
        (F.col("p_retailprice") * F.when(F.col("p_size") % 2 == 0, -1).otherwise(1)).alias("p_retailprice"),
        F.col("p_retailprice").cast("decimal(18,2)").alias("price"),
        F.when(F.col("p_size") > 40, F.concat(F.lit("n/a "), F.col("p_brand"))).otherwise(
            F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(".5 "))
        ).alias("text"),
        "p_brand",
    )
    rounding = Approximation({"key": 7, "p_size": 4, "p_retailprice": 50, "price": 3, "text": 10, "p_brand": 5, "none": 5, "p_name": 0})
    docs = p.approximation(part, rounding)
    return docs.select(
        "p_partkey", "key", F.col("p_size").cast("bigint").alias("size"),
        F.col("p_retailprice").cast("decimal(38,2)").alias("retail"), F.col("price").cast("decimal(38,2)").alias("price"),
        "text", "p_brand",
    )


CHAIN = [
    Attribute("contact", {"c_name": "Name", "c_mktsegment": "Segment"}),
    Computed("order_total", "SUM", "orders", "o_totalprice", scale=2),
    Computed("order_count", "COUNT", "orders"),
    Subset("orders", 2),
    Outlier("orders", 4),
    Approximation({"c_acctbal": 100, "order_total": 1000}),
]


def pattern_chain(spark: SparkSession, sf: str) -> DataFrame:
    """All five patterns on one table, in their fixed order: the sum is computed, then rounded."""
    t = load(spark, sf, "customer", "orders")
    settings = Settings({"orders.customer": "REFERENCE"}, patterns={"customer": CHAIN})
    docs = migrate(t, part_of("customer", "orders"), settings).documents["customer"]
    return docs.select(
        "c_custkey", F.col("c_acctbal").cast("decimal(38,2)").alias("balance"),
        text_of(F.col("contact"), fields("key", "value")).alias("contact"),
        F.col("order_total").cast("decimal(38,2)").alias("order_total"), "order_count",
        *nested("recent_orders", "n_recent", "recent", fields("o_orderkey")),
        *nested("orders", "n_kept", "kept", fields("o_orderkey")),
        "has_extras",
    )


def initials(df: DataFrame, context: p.PatternContext, column: str, field: str) -> DataFrame:
    return df.withColumn(field, F.substring(column, 1, 1))


def custom_pattern(spark: SparkSession, sf: str) -> DataFrame:
    register_pattern("initials", initials)
    t = load(spark, sf, "customer")
    settings = Settings(patterns={"customer": [Custom("initials", {"column": "c_mktsegment", "field": "segment"})]})
    docs = migrate(t, part_of("customer"), settings).documents["customer"]
    return docs.select("c_custkey", "segment")


# --- whole runs, writing, reports ------------------------------------------------------------

SALES = ("region", "nation", "supplier", "customer", "part", "orders", "lineitem", "events")
SALES_SETTINGS = {
    "strategies": {
        "orders.customer": "REFERENCE", "lineitem.part": "REFERENCE", "lineitem.supplier": "REFERENCE", "events.customer": "REFERENCE",
        "customer.nation": "REFERENCE", "supplier.nation": "REFERENCE", "nation.region": "EMBED",
    },
    "patterns": {
        "orders": [Computed("line_count", "COUNT", "lineitem"), Computed("revenue", "SUM", "lineitem", "l_extendedprice", scale=2)],
        "customer": [Computed("order_count", "COUNT", "orders"), Subset("events", 3), Approximation({"c_acctbal": 10})],
        "part": [Computed("supplies", "COUNT", "lineitem"), Attribute("traits", {"p_brand": "Brand", "p_type": "Type"})],
        "supplier": [Outlier("lineitem", 5)],
    },
}


def migrate_sales(spark: SparkSession, sf: str) -> DataFrame:
    """The sales tables in one run: one row per document of every dataset. Lines are a dataset of their own whatever their
    number per order, so the limit that may leave them out of the orders loses none."""
    moved = migrate(load(spark, sf, *SALES), part_of(*SALES), Settings(**SALES_SETTINGS), stage_folder=shared_folder(spark, "stage"))
    no_text, none = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    d = moved.documents
    lines = F.size("lineitem") if has_column(d["orders"], "lineitem") else none
    shown = {
        "region": ("r_regionkey", F.lit(0), F.size("nation"), text_of(F.col("nation"), fields("n_nationkey"))),
        "customer": ("c_custkey", F.col("c_acctbal"), F.size("recent_events"), text_of(F.col("recent_events"), fields("event_id"))),
        "part": ("p_partkey", F.col("supplies"), F.size("traits"), text_of(F.col("traits"), fields("key", "value"))),
        "supplier": ("s_suppkey", F.col("has_extras").cast("int"), F.size("lineitem"), no_text),
        "orders": ("o_orderkey", F.col("revenue"), lines, F.col("line_count").cast("string")),
        "lineitem": ("l_orderkey", F.col("l_extendedprice"), none, F.concat_ws(":", F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"))),
        "events": ("event_id", F.lit(0), none, F.col("event_type")),
    }
    return union_all(
        moved.datasets[name].select(
            F.lit(name).alias("dataset"), F.col(shown[name][0]).cast("bigint").alias("id"), shown[name][1].cast("decimal(38,2)").alias("amount"),
            shown[name][2].cast("bigint").alias("n_nested"), shown[name][3].alias("detail"),
        )
        for name in moved.datasets
    )


def strategies_under_limit(spark: SparkSession, sf: str) -> DataFrame:
    """The measured fan-out of every edge against a limit of 500."""
    tables = normalise_all(load(spark, sf))
    return relationship_map(tables, plan_for(tables, CATALOGUE, Settings(max_children=500)))


def strategies_with_cycle(spark: SparkSession, sf: str) -> DataFrame:
    """Customers name their last order, orders name their customer: the first edge is broken."""
    t = load(spark, sf, "customer", "orders")
    last = t["orders"].groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("last_order"))
    t["customer"] = t["customer"].join(last, F.col("c_custkey") == F.col("k"), "left").drop("k")
    catalogue = Catalogue.of(
        [TableSpec("customer", "c_custkey"), TableSpec("orders", "o_orderkey")],
        [Edge("customer", "last_order", "orders", "o_orderkey"), Edge("orders", "o_custkey", "customer", "c_custkey")],
    )
    plan = plan_for(t, catalogue, Settings({"orders.customer": "EMBED"}))
    found = relationship_map(t, plan)
    return found.withColumn("written", F.col("child").isin(plan.written))


def kept_folder(spark: SparkSession, purpose: str) -> str:
    """A shared folder that goes when the driver ends."""
    folder = shared_folder(spark, purpose)
    delete_at_end(spark, folder)
    return folder


WRITTEN = ("documents", "labels", "customer", "orders", "lineitem")


def written_run(spark: SparkSession, sf: str, source: str):
    settings = Settings(
        patterns={
            "orders": [Computed("revenue", "SUM", "lineitem", "l_extendedprice", scale=2)],
            "customer": [Computed("order_count", "COUNT", "orders")],
        }
    )
    moved = migrate(load(spark, sf, *WRITTEN), part_of(*WRITTEN), settings)
    folder = kept_folder(spark, "documents")
    written = moved.write(spark, folder, source)
    return moved, {t: f for t, f in read_documents(spark, folder, moved.datasets, source).items() if t in written}, folder


def write_parquet_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as written under their customers and read back, with the revenue as the double it is stored as; from the
    orders' own dataset where the limit has left them there."""
    _, back, _ = written_run(spark, sf, "parquet")
    docs = back["customer"]
    if has_column(docs, "orders"):
        stored = docs.select("c_custkey", "order_count", F.explode_outer("orders").alias("o"))
        return stored.select("c_custkey", "order_count", "o.o_orderkey", "o.revenue")
    orders = back["orders"].select("o_custkey", "o_orderkey", "revenue")
    return docs.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "order_count", "o_orderkey", "revenue")


def write_json_keeps_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """The JSON text itself: documents without a label spell the null out."""
    _, _, folder = written_run(spark, sf, "json")
    lines = spark.read.text(f"{folder}/document")
    return lines.select(
        F.get_json_object("value", "$.doc_id").cast("bigint").alias("doc_id"),
        F.col("value").contains('"labels":null').alias("null_written"),
        F.get_json_object("value", "$.labels.quality").cast("int").alias("quality"),
    )


def report_migration(spark: SparkSession, sf: str) -> DataFrame:
    moved, back, _ = written_run(spark, sf, "parquet")
    return migration_summary(moved, back)


def report_target(spark: SparkSession, sf: str) -> DataFrame:
    """The first three documents of each dataset, by content: their own columns, and how many rows are nested in them."""
    _, back, _ = written_run(spark, sf, "parquet")
    found = target_overview(spark, back, 3, {t: TableSpec(t, k).pk for t, k in WHOLE_KEYS.items()})
    out = []
    for t, frame in back.items():
        name = dataset_name(t)
        doc = F.from_json("doc", frame.schema).alias("d")
        mine = found.filter(F.col("dataset") == name).select("dataset", "documents", F.explode("samples").alias("doc")).select("dataset", "documents", doc)
        text = F.concat_ws("|", *[told(c, k, F.col("d").getField(c)) for c, k in columns_of(t)])
        nested_rows = F.size(F.col("d").getField("orders")) if has_column(frame, "orders") else F.lit(None)
        out.append(mine.select("dataset", "documents", F.md5(text.cast("binary")).alias("digest"), nested_rows.cast("bigint").alias("n_orders")))
    return union_all(out)


def report_reconciled(spark: SparkSession, sf: str) -> DataFrame:
    """Every written row against its source, by content."""
    moved, back, _ = written_run(spark, sf, "parquet")
    return reconciled(moved, back)


def replaced_set(spark: SparkSession, sf: str) -> DataFrame:
    """Two sets of datasets, one after the other, in one folder: readers see the second one as a whole, and nothing of the first."""
    folder = kept_folder(spark, "versions")
    tables = load(spark, sf, "customer", "orders")
    migrate(tables, part_of("customer", "orders"), Settings({"orders.customer": "REFERENCE"})).replace(spark, folder, "parquet")
    migrate(tables, part_of("customer", "orders"), Settings(patterns={"customer": [Computed("order_count", "COUNT", "orders")]})).replace(spark, folder, "parquet")
    found = read_current(spark, folder)
    listed = F.lit(",".join(sorted(found)))
    docs = found["customer"]
    n = F.size("orders").cast("bigint") if has_column(docs, "orders") else F.lit(None).cast("bigint")
    return docs.select("c_custkey", "order_count", n.alias("n_orders"), listed.alias("datasets"))


def report_source(spark: SparkSession, sf: str) -> DataFrame:
    return source_overview(load(spark, sf), CATALOGUE)


def report_columns(spark: SparkSession, sf: str) -> DataFrame:
    return column_overview(spark, load(spark, sf), CATALOGUE)


def report_relationships(spark: SparkSession, sf: str) -> DataFrame:
    tables = normalise_all(load(spark, sf))
    return relationship_map(tables, plan_for(tables, CATALOGUE, Settings({"events.customer": "REFERENCE"})))


def customer_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: customer documents with an order count, revenue, and the latest three orders."""
    t = load(spark, sf, "customer", "orders")
    settings = Settings(
        {"orders.customer": "REFERENCE"},
        patterns={
            "customer": [
                Computed("order_count", "COUNT", "orders"),
                Computed("order_total", "SUM", "orders", "o_totalprice", scale=2),
                Subset("orders", 3),
            ]
        },
    )
    docs = migrate(t, part_of("customer", "orders"), settings).documents["customer"]
    return docs.select(
        "c_custkey", "c_name", "order_count", F.col("order_total").cast("decimal(38,2)").alias("order_total"),
        text_of(F.col("recent_orders"), fields("o_orderkey", "o_orderstatus")).alias("recent_orders"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        customer_documents, scan_orders, sql_rich_customers, normalised_events, inferred_events, normalised_dates, normalised_nested_dates,
        array_and_binary_passthrough, normalised_instants, json_variants, table_row_counts, table_samples, profile_columns,
        profile_cardinality, profile_edges, profile_orphans, discovered_keys, embed_one_label, embed_one_first_match,
        embed_many_lineitem, embed_two_children, embed_levels_customer, embed_levels_region, embed_junction_part,
        embed_junction_keys, embed_fan_in, embed_role_names, self_join_referrals, reference_edge,
        computed_count_orders, computed_sum_lineitem, computed_count_through_junction, computed_sum_text,
        subset_recent_orders, outlier_events, customer_patterns, attribute_part, attribute_mixed_part,
        approximation_types, pattern_chain, custom_pattern, migrate_sales, strategies_under_limit,
        strategies_with_cycle, write_parquet_round_trip, write_json_keeps_nulls, report_migration, report_target,
        report_reconciled, replaced_set,
        report_source, report_columns, report_relationships,
    )
}
