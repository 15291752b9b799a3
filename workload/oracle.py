"""The same results in SQL, over whole tables."""

from __future__ import annotations

from docnest import TableSpec
from workload.tables import CATALOGUE, COLUMNS, EDGES, KEYS, WHOLE_KEYS, columns_of

LIMIT = 1000

LINE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


def widest(child: str, fk: str) -> str:
    return f"(SELECT coalesce(max(n), 0) FROM (SELECT count(*) AS n FROM {child} WHERE {fk} IS NOT NULL GROUP BY {fk}))"


def chunked(child: str, fk: str, item: str, order: str, size: int = 1000, more: str = "") -> str:
    """Per key and chunk of at most ``size`` rows: how many, and their digest."""
    return (
        f"(SELECT {fk} AS k, chunk, count(*) AS n, string_agg({item}, ',' ORDER BY {order}) AS d{more}"
        f" FROM (SELECT *, (row_number() OVER (PARTITION BY {fk} ORDER BY {order}) - 1) // {size} AS chunk FROM {child} WHERE {fk} IS NOT NULL)"
        f" GROUP BY 1, 2) g"
    )


def nested(size: str, digest: str) -> str:
    return f"coalesce(g.chunk, 0) AS chunk, coalesce(g.n, 0) AS {size}, coalesce(g.d, '') AS {digest}"


def grouped(child: str, fk: str, item: str, order: str) -> str:
    return (
        f"(SELECT {fk} AS k, count(*) AS n, string_agg({item}, ',' ORDER BY {order}) AS d"
        f" FROM {child} WHERE {fk} IS NOT NULL GROUP BY {fk}) g"
    )


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def latest(child: str, fk: str, pk: str, n: int, item: str) -> str:
    """Per key: how many of the last n rows there are, and their digest, largest key first."""
    ranked = f"SELECT *, row_number() OVER (PARTITION BY {fk} ORDER BY {pk} DESC) AS rn FROM {child} WHERE {fk} IS NOT NULL"
    return (
        f"(SELECT {fk} AS k, count(*) AS n, string_agg({item}, ',' ORDER BY {pk} DESC) AS d"
        f" FROM ({ranked}) WHERE rn <= {n} GROUP BY {fk})"
    )


def rounded(x: str, g: int, kind: str = "DECIMAL(38,2)") -> str:
    v = f"CAST({x} AS {kind})"
    near = f"(abs({v}) - abs({v}) % {g} + CASE WHEN (abs({v}) % {g}) * 2 >= {g} THEN {g} ELSE 0 END)"
    return f"CASE WHEN {v} < 0 THEN -{near} ELSE {near} END"


# The profiled columns' type names are fixed values of the tables' declared schema.
def column_profile_sql(tables, full: bool) -> str:
    parts = []
    for t in tables:
        pk = KEYS[t] if isinstance(KEYS[t], tuple) else (KEYS[t],)
        for i, (c, kind) in enumerate(columns_of(t)):
            counts = ", count(*) AS row_count, count({c}) AS value_count".format(c=c) if full else ""
            unique = f", count(DISTINCT {c}) = count({c}) AS is_unique" if full else ""
            parts.append(
                f"SELECT '{t}' AS table_name, CAST({i + 1} AS INTEGER) AS position, '{c}' AS column_name, '{kind}' AS type,"
                f" {'TRUE' if c in pk else 'FALSE'} AS is_pk{counts}, count({c}) < count(*) AS is_nullable{unique} FROM {t}"
            )
    return union(parts)


def edge_counts(e, child: str | None = None, parent: str | None = None) -> str:
    child, parent = child or e.child, parent or e.parent
    return (
        f"(SELECT count(*) FROM {child}) AS child_rows,"
        f" (SELECT count(*) FROM {child} WHERE {e.fk} IS NULL) AS null_key_rows,"
        f" (SELECT count(DISTINCT {e.fk}) FROM {child}) AS distinct_keys,"
        f" CAST({widest(child, e.fk)} AS BIGINT) AS max_children,"
        f" (SELECT count(*) FROM {child} WHERE {e.fk} IS NOT NULL AND {e.fk} NOT IN (SELECT {e.pk} FROM {parent})) AS orphan_rows,"
        f" (SELECT count(DISTINCT {e.fk}) FROM {child} WHERE {e.fk} NOT IN (SELECT {e.pk} FROM {parent})) AS orphan_keys,"
        f" (SELECT count(*) FROM {parent} WHERE {e.pk} NOT IN (SELECT {e.fk} FROM {child} WHERE {e.fk} IS NOT NULL)) AS childless_parents"
    )


def observed(e) -> str:
    return f"CASE WHEN {widest(e.child, e.fk)} <= 1 THEN 'ONE_TO_ONE' ELSE 'ONE_TO_MANY' END AS observed"


def relationship_sql(limit: int, references: tuple = ()) -> str:
    parts = []
    for e in EDGES:
        declared = CATALOGUE.cardinality(e)
        if (e.child, e.parent) in references:
            strategy = "'REFERENCE'"
        elif declared == "ONE_TO_ONE":
            strategy = "'EMBED'"
        else:
            strategy = f"CASE WHEN {widest(e.child, e.fk)} > {limit} THEN 'REFERENCE' ELSE 'EMBED' END"
        parts.append(
            f"SELECT '{e.child}' AS child, '{e.fk}' AS fk, '{e.parent}' AS parent, '{declared}' AS declared, {observed(e)},"
            f" CAST({widest(e.child, e.fk)} AS BIGINT) AS max_children, {strategy} AS strategy"
        )
    return union(parts)


def source_overview_sql() -> str:
    return union(
        [
            f"SELECT '{t}' AS table_name, '{CATALOGUE.table_class(t)}' AS table_class, count(*) AS row_count,"
            f" CAST({len(columns_of(t))} AS INTEGER) AS column_count, CAST({len(CATALOGUE.outgoing(t))} AS INTEGER) AS fk_count FROM {t}"
            for t in COLUMNS
        ]
    )


def told(c: str, kind: str) -> str:
    """A value as text; nulls as a minus."""
    if kind == "double":
        c = f"CAST(round({c} * 100) AS BIGINT)"
    elif kind.startswith("timestamp"):
        c = f"epoch_us({c}) // 1000"
    elif kind.startswith("array"):
        c = f"array_to_string([floor(CAST(x AS DOUBLE) * 1048576)::BIGINT FOR x IN {c}], ' ')"
    return f"coalesce(CAST({c} AS VARCHAR), '-')"


def row_digest(table: str) -> str:
    return "md5(" + " || '|' || ".join(told(c, k) for c, k in columns_of(table)) + ")"


def order_of(table: str) -> str:
    return ", ".join(TableSpec(table, WHOLE_KEYS[table]).pk)


def target_sql(table: str, dataset: str, n_orders: str = "CAST(NULL AS BIGINT)", where: str = "true") -> str:
    """The first three documents of a dataset."""
    return (
        f"SELECT * FROM (SELECT '{dataset}' AS dataset, (SELECT count(*) FROM {table}) AS documents, {row_digest(table)} AS digest, {n_orders} AS n_orders"
        f" FROM {table} WHERE {where} ORDER BY {order_of(table)} LIMIT 3)"
    )


TRADE_LANES = """
  SELECT c.c_nationkey AS buyer_id, s.s_nationkey AS seller_id, count(*) AS n_lines
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey GROUP BY 1, 2
"""

REVENUE = "sum(CAST(l_extendedprice AS DECIMAL(18,2)))"

ORACLE: dict[str, str] = {
    "customer_documents": f"""
SELECT c.c_custkey, c.c_name, coalesce(t.n, 0) AS order_count, CAST(coalesce(t.s, 0) AS DECIMAL(38,2)) AS order_total,
       coalesce(r.d, '') AS recent_orders
FROM customer c
LEFT JOIN (SELECT o_custkey AS k, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS s FROM orders GROUP BY 1) t ON t.k = c.c_custkey
LEFT JOIN {latest("orders", "o_custkey", "o_orderkey", 3, "o_orderkey || ':' || o_orderstatus")} r ON r.k = c.c_custkey
""",
    "scan_orders": """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, epoch_ms(o_orderdate) AS o_orderdate_ms, o_orderpriority FROM orders
""",
    "sql_rich_customers": """
SELECT c_custkey AS id, n_name AS nation, CAST(c_acctbal AS DECIMAL(18,2)) AS balance
FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 5000
""",
    "normalised_events": """
SELECT event_id, epoch_us(date_trunc('milliseconds', ts)) AS ts_us, CAST(json_extract(props, '$.k') AS BIGINT) AS k, TRUE AS parsed FROM events
""",
    "inferred_events": """
SELECT event_id, 'struct<k:bigint>' AS type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, TRUE AS parsed FROM events
""",
    "normalised_dates": """
SELECT o_orderkey, epoch_ms(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) AS day_ms FROM orders
""",
    "normalised_nested_dates": """
SELECT l_orderkey, l_linenumber, l_partkey, CAST(2 AS BIGINT) AS n_days, epoch_ms(CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP)) AS first_ms FROM lineitem
""",
    "array_and_binary_passthrough": f"""
SELECT 'embeddings' AS kind, vec_id AS id, len(embedding) AS n, md5({told("embedding", "array<float>")}) AS digest FROM embeddings
UNION ALL SELECT 'documents', doc_id, CAST(strlen(text) AS BIGINT), md5(text) FROM documents
""",
    "normalised_instants": """
SELECT event_id, us - (us % 1000 + 1000) % 1000 AS ts_us, -us - (-us % 1000 + 1000) % 1000 AS before_us
FROM (SELECT event_id, epoch_us(ts) + event_id % 1000 AS us FROM events)
""",
    "json_variants": """
SELECT 'events' AS kind, event_id AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS number, CAST(NULL AS BIGINT) AS kept_chars FROM events
UNION ALL SELECT 'documents', doc_id, NULL, length(text) FROM documents
""",
    "table_row_counts": union([f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in COLUMNS]),
    "table_samples": union(
        [f"SELECT * FROM (SELECT '{t}' AS table_name, {row_digest(t)} AS row_digest FROM {t} ORDER BY {order_of(t)} LIMIT 5)" for t in COLUMNS]
    ),
    "profile_columns": column_profile_sql(COLUMNS, True),
    "report_columns": column_profile_sql(COLUMNS, False),
    "profile_cardinality": union(
        [
            f"SELECT '{e.child}' AS child, '{e.fk}' AS fk, '{e.parent}' AS parent, '{CATALOGUE.cardinality(e)}' AS declared,"
            f" {observed(e)}, CAST({widest(e.child, e.fk)} AS BIGINT) AS max_children"
            for e in EDGES
        ]
    ),
    "profile_edges": union(
        [
            f"SELECT '{e.child}' AS child, '{e.fk}' AS fk, '{e.parent}' AS parent, '{e.pk}' AS pk,"
            f" '{CATALOGUE.table_class(e.child)}' AS child_class, '{CATALOGUE.cardinality(e)}' AS declared, {observed(e)},"
            f" {edge_counts(e)},"
            f" {'FALSE' if CATALOGUE.cardinality(e) == 'ONE_TO_ONE' else widest(e.child, e.fk) + ' > 500'} AS downgrade"
            for e in EDGES
        ]
    ),
    "profile_orphans": f"""
WITH child AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey END AS o_custkey FROM orders),
     parent AS (SELECT * FROM customer WHERE c_acctbal >= 1000)
SELECT child_rows, null_key_rows, distinct_keys, orphan_rows, orphan_keys, childless_parents
FROM (SELECT {edge_counts(EDGES[3], "child", "parent")})
""",
    "embed_one_label": """
SELECT d.doc_id, l.doc_id IS NOT NULL AS has_label, l.quality, l.toxic, length(d.text) AS text_chars
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
""",
    "embed_one_first_match": """
SELECT c_custkey, min(o_orderkey) AS first_order FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1
""",
    "embed_many_lineitem": f"""
SELECT o.o_orderkey, {nested("n_lines", "lines")} FROM orders o
LEFT JOIN {chunked("lineitem", "l_orderkey", "l_linenumber || ':' || l_partkey", LINE_ORDER)} ON g.k = o.o_orderkey
""",
    "embed_two_children": union(
        [
            f"SELECT n_nationkey, '{child}' AS kind, {nested('n_members', 'members')} FROM nation"
            f" LEFT JOIN {chunked(child, fk, f'CAST({key} AS VARCHAR)', key, 40)} ON g.k = n_nationkey"
            for child, fk, key in (("supplier", "s_nationkey", "s_suppkey"), ("customer", "c_nationkey", "c_custkey"))
        ]
    ),
    "embed_levels_customer": f"""
WITH o AS (SELECT o_custkey, o_orderkey, coalesce(g.chunk, 0) AS part, o_orderkey || '[' || coalesce(g.d, '') || ']' AS item
  FROM orders LEFT JOIN {chunked("lineitem", "l_orderkey", "l_linenumber || ':' || l_partkey", LINE_ORDER)} ON g.k = o_orderkey)
SELECT c.c_custkey, {nested("n_orders", "orders_digest")} FROM customer c
LEFT JOIN {chunked("o", "o_custkey", "item", "o_orderkey, part")} ON g.k = c.c_custkey
""",
    "embed_levels_region": f"""
SELECT r.r_regionkey, n.n_nationkey, CASE WHEN n.n_nationkey IS NOT NULL THEN coalesce(g.chunk, 0) END AS chunk,
  CASE WHEN n.n_nationkey IS NOT NULL THEN coalesce(g.n, 0) END AS n_suppliers, CASE WHEN n.n_nationkey IS NOT NULL THEN coalesce(g.d, '') END AS suppliers
FROM region r LEFT JOIN nation n ON r.r_regionkey = n.n_regionkey
LEFT JOIN {chunked("supplier", "s_nationkey", "CAST(s_suppkey AS VARCHAR)", "s_suppkey")} ON g.k = n.n_nationkey
""",
    "embed_junction_part": f"""
SELECT p.p_partkey, 'l_linenumber,l_quantity,l_extendedprice,l_discount,l_tax,l_returnflag,l_linestatus,l_shipdate' AS payload_fields,
  {nested("n_rows", "rows_digest")}
FROM part p
LEFT JOIN {chunked("lineitem", "l_partkey", "l_linenumber || ':' || l_returnflag || ':' || l_linestatus", "l_orderkey, " + LINE_ORDER.replace("l_partkey, l_suppkey, ", ""))}
  ON g.k = p.p_partkey
""",
    "embed_junction_keys": f"""
SELECT n.n_nationkey, {nested("n_customers", "customers")} FROM nation n
LEFT JOIN {chunked("customer", "c_nationkey", "CAST(c_custkey AS VARCHAR)", "c_custkey")} ON g.k = n.n_nationkey
""",
    "embed_fan_in": union(
        [
            f"SELECT '{e.parent}' AS parent, CAST(p.{e.pk} AS BIGINT) AS id, coalesce(g.chunk, 0) AS chunk, coalesce(g.n, 0) AS n_lines,"
            f" CAST(coalesce(g.q, 0) AS BIGINT) AS quantity FROM {e.parent} p LEFT JOIN"
            f" {chunked('lineitem', e.fk, chr(39) * 2, ('l_orderkey, ' + LINE_ORDER).replace(f'{e.fk}, ', ''), 100, ', sum(CAST(l_quantity AS BIGINT)) AS q')} ON g.k = p.{e.pk}"
            for e in EDGES
            if e.child == "lineitem"
        ]
    ),
    "embed_role_names": f"""
WITH lane AS ({TRADE_LANES}),
b AS (SELECT buyer_id AS k, count(*) AS n, string_agg(coalesce(seller_id || ':', '') || n_lines, ',' ORDER BY seller_id NULLS FIRST) AS d FROM lane GROUP BY 1),
s AS (SELECT seller_id AS k, count(*) AS n, string_agg(coalesce(buyer_id || ':', '') || n_lines, ',' ORDER BY buyer_id NULLS FIRST) AS d FROM lane GROUP BY 1)
SELECT n_nationkey, coalesce(b.n, 0) AS n_bought, coalesce(b.d, '') AS bought, coalesce(s.n, 0) AS n_sold, coalesce(s.d, '') AS sold
FROM nation LEFT JOIN b ON b.k = n_nationkey LEFT JOIN s ON s.k = n_nationkey
""",
    "self_join_referrals": """
WITH c AS (SELECT c_custkey, CASE WHEN c_custkey >= 10 THEN c_custkey // 10 END AS c_referrer FROM customer)
SELECT c.c_custkey, c.c_referrer, coalesce(g.n, 0) AS referrals
FROM c LEFT JOIN (SELECT c_referrer AS k, count(*) AS n FROM c WHERE c_referrer IS NOT NULL GROUP BY 1) g ON g.k = c.c_custkey
""",
    "reference_edge": """
SELECT 'nation' AS dataset, CAST(n_nationkey AS BIGINT) AS id, CAST(NULL AS INTEGER) AS fk, CAST(3 AS INTEGER) AS n_fields FROM nation
UNION ALL SELECT 'customer', c_custkey, c_nationkey, 5 FROM customer
""",
    "computed_count_orders": """
SELECT c_custkey, count(o_orderkey) AS order_count FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1
""",
    "computed_sum_lineitem": f"""
SELECT o.o_orderkey, CAST(coalesce(g.r, 0) AS DECIMAL(38,2)) AS revenue, CAST(coalesce(g.a, 0) AS BIGINT) AS line_numbers,
  CAST(coalesce(g.b, 0) AS DECIMAL(38,2)) AS part_keys, CAST(0 AS DECIMAL(38,2)) AS flags, coalesce(g.n, 0) AS n_lines
FROM orders o LEFT JOIN (SELECT l_orderkey AS k, {REVENUE} AS r, sum(l_linenumber) AS a, sum(l_partkey) AS b, count(*) AS n
  FROM lineitem GROUP BY 1) g ON g.k = o.o_orderkey
""",
    "computed_count_through_junction": """
SELECT p_partkey, count(l_partkey) AS supplies FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1
""",
    "computed_sum_text": """
SELECT c.c_custkey, CAST(coalesce(g.s, 0) AS DECIMAL(38,4)) AS amount FROM customer c
LEFT JOIN (SELECT user_id AS k, sum(CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN v + 0.25 ELSE v END) AS s
  FROM (SELECT user_id, event_type, CAST(json_extract(props, '$.k') AS DECIMAL(18,4)) AS v FROM events) GROUP BY 1) g ON g.k = c.c_custkey
""",
    "subset_recent_orders": f"""
SELECT c_custkey, coalesce(r.n, 0) AS n_recent, coalesce(r.d, '') AS recent FROM customer
LEFT JOIN {latest("orders", "o_custkey", "o_orderkey", 3, "o_orderkey || ':' || o_orderstatus")} r ON r.k = c_custkey
""",
    "outlier_events": f"""
SELECT c_custkey, coalesce(r.n, 0) AS n_kept, coalesce(r.d, '') AS kept, coalesce(t.n, 0) > 60 AS has_extras FROM customer
LEFT JOIN {latest("events", "user_id", "event_id", 60, "event_id || ':' || event_type")} r ON r.k = c_custkey
LEFT JOIN (SELECT user_id AS k, count(*) AS n FROM events GROUP BY 1) t ON t.k = c_custkey
""",
    "customer_patterns": f"""
SELECT c_custkey, coalesce(t.n, 0) AS order_count, CAST(coalesce(t.s, 0) AS DECIMAL(38,2)) AS order_total,
  coalesce(r.n, 0) AS n_recent, coalesce(r.d, '') AS recent, coalesce(o.n, 0) AS n_kept, coalesce(o.d, '') AS kept,
  coalesce(t.n, 0) > 5 AS has_extras
FROM customer
LEFT JOIN (SELECT o_custkey AS k, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS s FROM orders GROUP BY 1) t ON t.k = c_custkey
LEFT JOIN {latest("orders", "o_custkey", "o_orderkey", 3, "CAST(o_orderkey AS VARCHAR)")} r ON r.k = c_custkey
LEFT JOIN {latest("orders", "o_custkey", "o_orderkey", 5, "CAST(o_orderkey AS VARCHAR)")} o ON o.k = c_custkey
""",
    "attribute_part": """
SELECT p_partkey, CAST(5 AS INTEGER) AS n_fields, CAST(CASE WHEN p_size >= 10 THEN 2 ELSE 1 END AS BIGINT) AS n_traits,
  'Brand:' || p_brand || CASE WHEN p_size >= 10 THEN ',Type:' || p_type ELSE '' END AS traits_digest FROM part
""",
    "attribute_mixed_part": """
SELECT p_brand, p_type, CAST(3 AS BIGINT) AS n_facts, 'Name:' || p_name || ',Size:' || p_size || ',Key:' || p_partkey AS facts_digest FROM part
""",
    "approximation_types": f"""
SELECT p_partkey, CAST({rounded("p_partkey", 7)} AS BIGINT) AS "key", CAST({rounded("p_size", 4)} AS BIGINT) AS size,
  CAST({rounded("p_retailprice * CASE WHEN p_size % 2 = 0 THEN -1 ELSE 1 END", 50)} AS DECIMAL(38,2)) AS retail,
  CAST({rounded("p_retailprice", 3)} AS DECIMAL(38,2)) AS price,
  CASE WHEN p_size > 40 THEN 'n/a ' || p_brand ELSE CAST(CAST({rounded("p_size + 0.5", 10)} AS BIGINT) AS VARCHAR) END AS text,
  p_brand FROM part
""",
    "pattern_chain": f"""
SELECT c_custkey, CAST({rounded("c_acctbal", 100)} AS DECIMAL(38,2)) AS balance, 'Name:' || c_name || ',Segment:' || c_mktsegment AS contact,
  CAST({rounded("coalesce(t.s, 0)", 1000)} AS DECIMAL(38,2)) AS order_total, coalesce(t.n, 0) AS order_count,
  coalesce(r.n, 0) AS n_recent, coalesce(r.d, '') AS recent, coalesce(o.n, 0) AS n_kept, coalesce(o.d, '') AS kept,
  coalesce(t.n, 0) > 4 AS has_extras
FROM customer
LEFT JOIN (SELECT o_custkey AS k, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS s FROM orders GROUP BY 1) t ON t.k = c_custkey
LEFT JOIN {latest("orders", "o_custkey", "o_orderkey", 2, "CAST(o_orderkey AS VARCHAR)")} r ON r.k = c_custkey
LEFT JOIN {latest("orders", "o_custkey", "o_orderkey", 4, "CAST(o_orderkey AS VARCHAR)")} o ON o.k = c_custkey
""",
    "custom_pattern": "SELECT c_custkey, substr(c_mktsegment, 1, 1) AS segment FROM customer",
    "migrate_sales": f"""
SELECT 'region' AS dataset, CAST(r_regionkey AS BIGINT) AS id, CAST(0 AS DECIMAL(38,2)) AS amount,
  coalesce(g.n, 0) AS n_nested, coalesce(g.d, '') AS detail
FROM region LEFT JOIN {grouped("nation", "n_regionkey", "CAST(n_nationkey AS VARCHAR)", "n_nationkey")} ON g.k = r_regionkey
UNION ALL
SELECT 'customer', c_custkey, CAST({rounded("c_acctbal", 10)} AS DECIMAL(38,2)), coalesce(r.n, 0), coalesce(r.d, '')
FROM customer LEFT JOIN {latest("events", "user_id", "event_id", 3, "CAST(event_id AS VARCHAR)")} r ON r.k = c_custkey
UNION ALL
SELECT 'part', p_partkey, CAST(coalesce(t.n, 0) AS DECIMAL(38,2)), 2, 'Brand:' || p_brand || ',Type:' || p_type
FROM part LEFT JOIN (SELECT l_partkey AS k, count(*) AS n FROM lineitem GROUP BY 1) t ON t.k = p_partkey
UNION ALL
SELECT 'supplier', s_suppkey, CAST(CASE WHEN coalesce(t.n, 0) > 5 THEN 1 ELSE 0 END AS DECIMAL(38,2)), least(coalesce(t.n, 0), 5), NULL
FROM supplier LEFT JOIN (SELECT l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY 1) t ON t.k = s_suppkey
UNION ALL
SELECT 'orders', o_orderkey, CAST(coalesce(t.s, 0) AS DECIMAL(38,2)),
  CASE WHEN {widest("lineitem", "l_orderkey")} <= {LIMIT} THEN coalesce(t.n, 0) END, CAST(coalesce(t.n, 0) AS VARCHAR)
FROM orders LEFT JOIN (SELECT l_orderkey AS k, count(*) AS n, {REVENUE} AS s FROM lineitem GROUP BY 1) t ON t.k = o_orderkey
UNION ALL
SELECT 'lineitem', l_orderkey, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DECIMAL(38,2)), NULL, l_linenumber || ':' || l_partkey || ':' || l_suppkey FROM lineitem
UNION ALL
SELECT 'events', event_id, CAST(0 AS DECIMAL(38,2)), NULL, event_type FROM events
""",
    "strategies_under_limit": relationship_sql(500),
    "report_relationships": relationship_sql(LIMIT, (("events", "customer"),)),
    "strategies_with_cycle": f"""
SELECT 'customer' AS child, 'last_order' AS fk, 'orders' AS parent, 'ONE_TO_MANY' AS declared,
  CASE WHEN count(DISTINCT o_custkey) > 0 THEN 'ONE_TO_ONE' END AS observed, CAST(1 AS BIGINT) AS max_children,
  'REFERENCE' AS strategy, TRUE AS written FROM orders
UNION ALL
SELECT 'orders', 'o_custkey', 'customer', 'ONE_TO_MANY', CASE WHEN {widest("orders", "o_custkey")} <= 1 THEN 'ONE_TO_ONE' ELSE 'ONE_TO_MANY' END,
  CAST({widest("orders", "o_custkey")} AS BIGINT), CASE WHEN {widest("orders", "o_custkey")} > {LIMIT} THEN 'REFERENCE' ELSE 'EMBED' END,
  {widest("orders", "o_custkey")} > {LIMIT}
""",
    "discovered_keys": union(
        [
            f"SELECT '{e.child}' AS child, '{e.fk}' AS fk, '{e.parent}' AS parent, '{e.pk}' AS pk, TRUE AS same_name, count(DISTINCT {e.fk}) AS distinct_keys,"
            f" (SELECT count(*) FROM {e.parent}) AS parent_rows FROM {e.child}"
            for e in EDGES
        ]
    ),
    "write_parquet_round_trip": f"""
SELECT c_custkey, coalesce(n, 0) AS order_count, o_orderkey, CASE WHEN o_orderkey IS NOT NULL THEN CAST(coalesce(s, 0) AS DOUBLE) END AS revenue
FROM customer LEFT JOIN (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) ON o_custkey = c_custkey
LEFT JOIN (SELECT l_orderkey AS k, {REVENUE} AS s FROM lineitem GROUP BY 1) ON k = o_orderkey
""",
    "write_json_keeps_nulls": """
SELECT d.doc_id, l.doc_id IS NULL AS null_written, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
""",
    "report_migration": f"""
WITH w AS (SELECT {widest("orders", "o_custkey")} <= {LIMIT} AS o, {widest("lineitem", "l_orderkey")} <= {LIMIT} AS l),
a AS (SELECT count(*) AS rows_all, count(c_custkey) AS taken FROM orders LEFT JOIN customer ON c_custkey = o_custkey),
b AS (SELECT count(*) AS rows_all, count(o_orderkey) AS taken FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey),
c AS (SELECT count(*) AS rows_all, count(d.doc_id) AS taken FROM labels x LEFT JOIN documents d ON d.doc_id = x.doc_id)
SELECT 'orders' AS table_name, rows_all AS rows_read, CASE WHEN o THEN taken ELSE 0 END AS rows_nested,
  CASE WHEN o THEN rows_all - taken ELSE 0 END AS rows_orphaned, CASE WHEN o THEN NULL ELSE rows_all END AS docs_written FROM a, w
UNION ALL SELECT 'lineitem', rows_all, CASE WHEN l THEN taken ELSE 0 END, CASE WHEN l THEN rows_all - taken ELSE 0 END,
  CASE WHEN l THEN NULL ELSE rows_all END FROM b, w
UNION ALL SELECT 'labels', rows_all, taken, rows_all - taken, NULL FROM c
UNION ALL SELECT 'documents', count(*), 0, 0, count(*) FROM documents
UNION ALL SELECT 'customer', count(*), 0, 0, count(*) FROM customer
""",
    "report_target": union(
        [
            target_sql("documents", "document"),
            target_sql(
                "customer", "customer", f"CASE WHEN {widest('orders', 'o_custkey')} <= {LIMIT} THEN (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) END"
            ),
            target_sql("orders", "order", where=f"{widest('orders', 'o_custkey')} > {LIMIT}"),
            target_sql("lineitem", "lineitem", where=f"{widest('lineitem', 'l_orderkey')} > {LIMIT}"),
        ]
    ),
    "report_reconciled": f"""
WITH w AS (SELECT {widest("orders", "o_custkey")} <= {LIMIT} AS o, {widest("lineitem", "l_orderkey")} <= {LIMIT} AS l),
inner_orders AS (SELECT o_orderkey FROM orders, w WHERE NOT o OR o_custkey IN (SELECT c_custkey FROM customer)),
counted AS (
  SELECT 'documents' AS table_name, 'documents' AS place, 5 AS columns_compared, count(*) AS n FROM documents
  UNION ALL SELECT 'customer', 'customer', 5, count(*) FROM customer
  UNION ALL SELECT 'labels', 'labels.doc_id->documents.doc_id', 3, count(*) FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)
  UNION ALL SELECT 'orders', CASE WHEN any_value(o) THEN 'orders.o_custkey->customer.c_custkey' ELSE 'orders' END, 6, count(*) FROM orders, w
    WHERE NOT o OR o_custkey IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT 'lineitem', CASE WHEN any_value(l) THEN 'lineitem.l_orderkey->orders.o_orderkey' ELSE 'lineitem' END, 11, count(*) FROM lineitem, w
    WHERE NOT l OR l_orderkey IN (SELECT o_orderkey FROM inner_orders)
)
SELECT table_name, place, columns_compared, n AS rows_expected, n AS rows_found, TRUE AS same FROM counted
""",
    "replaced_set": f"""
WITH w AS (SELECT {widest("orders", "o_custkey")} <= {LIMIT} AS o)
SELECT c_custkey, coalesce(n, 0) AS order_count, CASE WHEN o THEN coalesce(n, 0) END AS n_orders, CASE WHEN o THEN 'customer' ELSE 'customer,orders' END AS datasets
FROM customer LEFT JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) ON k = c_custkey, w
""",
    "report_source": source_overview_sql(),
}
