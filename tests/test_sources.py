import datetime as dt
import json

import pytest

from docnest import Catalogue, PlanError, TableSpec
from docnest.operators.profile import column_profile
from docnest.session import shared_folder, size_shuffles
from docnest.sinks.documents import stored
from docnest.sources.database import catalogue_of, jdbc_options, user_tables
from docnest.sources.normalise import normalise
from docnest.sources.tables import read_tables, row_counts, sample_rows, sql_rows
from tests.helpers import rows

UTC = dt.timezone.utc


def test_dates_are_utc_midnight_in_any_session_zone(spark):
    df = spark.createDataFrame([(dt.date(1990, 1, 1),), (dt.date(1969, 12, 31),), (None,)], "d date")
    for zone in ("UTC", "America/New_York", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        got = [r[0] for r in normalise(df).selectExpr("unix_millis(d)").collect()]
        assert got == [631152000000, -86400000, None]
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_times_lose_what_is_below_a_millisecond(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01 00:00:07.179575' n, TIMESTAMP'1969-12-31 23:59:59.9999' t")
    out = normalise(df)
    assert {f.dataType.typeName() for f in out.schema.fields} == {"timestamp"}
    assert tuple(out.selectExpr("unix_micros(n)", "unix_micros(t)").first()) == (1704067207179000, -1000)


def test_nested_values_and_passthrough(spark):
    df = spark.sql("SELECT array(DATE'2020-01-01', NULL) a, struct(DATE'2020-01-01' AS d, 1 AS n) s, X'0102' b, map('k', 1) m")
    out = normalise(df)
    r = out.selectExpr("unix_millis(a[0])", "a[1]", "unix_millis(s.d)", "s.n", "b", "m").first()
    assert tuple(r) == (1577836800000, None, 1577836800000, 1, b"\x01\x02", {"k": 1})
    missing = normalise(spark.sql("SELECT CAST(NULL AS struct<d:date>) s, CAST(NULL AS array<date>) a")).first()
    assert missing["s"] is None and missing["a"] is None


def test_json_columns(spark):
    df = spark.createDataFrame([('{"k": 1, "l": [2]}',), ("{bad",), ("7",), (None,)], "j string")
    typed = rows(normalise(df, {"j": "struct<k:int,l:array<int>>"}))
    assert typed[0] == {"j": {"k": 1, "l": [2]}, "j_unparsed": None}
    assert typed[1] == {"j": None, "j_unparsed": "{bad"} and typed[3] == {"j": None, "j_unparsed": None}
    loose = normalise(df, {"j": None}).selectExpr("to_json(struct(j)) AS x").collect()
    assert [json.loads(r.x).get("j") for r in loose] == [{"k": 1, "l": [2]}, "{bad", 7, None]
    with pytest.raises(PlanError):
        normalise(df, {"nope": None})


def test_json_followed_by_more_text_is_kept_whole(spark):
    texts = ["829484 In the end", '{"k": 1} and more', '"a"] x', '"a",0] x', "1,2", "", "null", " [1, {}] ", "-1.5e3", '"x"', "true"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, j string")
    got = [json.loads(r.x) for r in normalise(df, {"j": None}).orderBy("i").selectExpr("to_json(struct(j), map('ignoreNullFields', 'false')) AS x").collect()]
    assert [g["j"] for g in got] == [*texts[:6], None, [1, {}], -1500, "x", True]
    kept = rows(normalise(df, {"j": "struct<k:int>"}), "i")
    assert kept[1]["j"] is None and kept[1]["j_unparsed"] == texts[1]


def test_sql_keeps_aliases(spark):
    users = spark.createDataFrame([(1, "a", 25), (2, "b", 30), (3, "c", 35)], "id int, name string, age int")
    assert rows(sql_rows(spark, {"users": users}, "SELECT name AS who FROM users WHERE age > 28"), "who") == [
        {"who": "b"}, {"who": "c"}
    ]


def test_counts_samples_and_files(spark, tmp_path):
    spark.range(20).selectExpr("20 - id AS id", "CAST(NULL AS STRING) AS v").write.parquet(f"{tmp_path}/t.parquet")
    tables = read_tables(spark, str(tmp_path), ["t"])
    assert rows(row_counts(tables)) == [{"table_name": "t", "row_count": 20}]
    catalogue = Catalogue.of([TableSpec("t", "id")])
    sampled = [json.loads(r["row_json"]) for r in rows(sample_rows(tables, catalogue, 3))]
    assert sampled == [{"id": 1, "v": None}, {"id": 2, "v": None}, {"id": 3, "v": None}]
    assert rows(sample_rows({"t": tables["t"].limit(0)}, catalogue)) == []


def test_jdbc_options():
    assert jdbc_options("u", table="t") == {"url": "u", "dbtable": "t"}
    split = jdbc_options("u", table="t", column="id", bounds=(1, 9), partitions=4, properties={"user": "x"})
    assert split["partitionColumn"] == "id" and split["numPartitions"] == "4" and split["user"] == "x"
    for bad in ({}, {"table": "t", "query": "q"}, {"table": "t", "column": "id"}):
        with pytest.raises(PlanError):
            jdbc_options("u", **bad)


def test_catalogue_from_a_database(spark):
    listed = spark.createDataFrame(
        [("emp", "BASE TABLE"), ("dep", "BASE TABLE"), ("pg_x", "BASE TABLE"), ("sql_y", "TABLE"), ("v", "VIEW"), ("system_columns", "TABLE")],
        "table_name string, table_type string",
    )
    names = sorted(r["table_name"] for r in user_tables(listed).collect())
    assert names == ["dep", "emp"]
    keys = spark.createDataFrame(
        [
            ("emp", "emp_pk", "PRIMARY KEY", "b", 2), ("emp", "emp_pk", "PRIMARY KEY", "a", 1), ("dep", "dep_pk", "PRIMARY KEY", "id", 1),
            ("emp", "u1", "UNIQUE", "mail", 1), ("emp", "u2", "UNIQUE", "x", 1), ("emp", "u2", "UNIQUE", "y", 2),
        ],
        "table_name string, constraint_name string, constraint_type string, column_name string, ordinal_position int",
    )
    references = spark.createDataFrame(
        [("emp", "boss", "emp", "a", 4), ("emp", "dep_id", "dep", "id", 3)],
        "table_name string, column_name string, parent_table string, parent_column string, ordinal_position int",
    )
    found = catalogue_of(names, keys, references)
    assert found.tables["emp"].pk == ("a", "b") and found.tables["emp"].unique == ("mail",)
    assert [e.fk for e in found.edges] == ["dep_id", "boss"]
    assert found.table_class("emp") == "JUNCTION_TABLE" and found.table_class("dep") == "PRIMARY_ENTITY"


def test_column_profile(spark):
    df = spark.createDataFrame(
        [(1, "a", 0.0, [1], None), (2, "b", -0.0, [1, 2], None), (3, None, 1.0, None, None)],
        "id int, s string, f double, l array<int>, n int",
    )
    found = {r["column_name"]: r for r in rows(column_profile(spark, {"t": df}, Catalogue.of([TableSpec("t", "id")])))}
    assert {c: (r["is_nullable"], r["is_unique"], r["is_pk"]) for c, r in found.items()} == {
        "id": (False, True, True), "s": (True, True, False), "f": (False, False, False), "l": (True, True, False), "n": (True, True, False)
    }
    assert found["l"]["value_count"] == 2 and found["f"]["type"] == "double"


def test_cardinality_is_declared_by_single_column_keys():
    from docnest import Edge

    catalogue = Catalogue.of(
        [TableSpec("a", "id"), TableSpec("b", ("a_id", "n")), TableSpec("c", "a_id"), TableSpec("d", "id", unique="a_id")],
        [Edge("b", "a_id", "a", "id"), Edge("c", "a_id", "a", "id"), Edge("d", "a_id", "a", "id")],
    )
    assert [catalogue.cardinality(e) for e in catalogue.edges] == ["ONE_TO_MANY", "ONE_TO_ONE", "ONE_TO_ONE"]
    with pytest.raises(PlanError):
        TableSpec(" ", "id")
    with pytest.raises(PlanError):
        Catalogue.of([TableSpec("a", "id")], [Edge("zz", "a_id", "a", "id")])


def test_stored_types(spark):
    df = spark.sql(
        "SELECT CAST(1.5 AS DECIMAL(3,1)) a, array(CAST(2.5 AS DECIMAL(3,1))) b,"
        " array(struct(CAST(3.5 AS DECIMAL(3,1)) AS x, 'k' AS y)) c, map('m', CAST(4.5 AS DECIMAL(3,1))) d"
    )
    out = stored(df)
    assert out.schema.simpleString() == "struct<a:double,b:array<double>,c:array<struct<x:double,y:string>>,d:map<string,double>>"
    assert rows(out) == [{"a": 1.5, "b": [2.5], "c": [{"x": 3.5, "y": "k"}], "d": {"m": 4.5}}]


def test_shared_folder_and_shuffle_size(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    first, second = shared_folder(spark, "x"), shared_folder(spark, "x")
    assert first.startswith(root) and first != second
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    assert size_shuffles(spark, [spark.range(10)]) == 4 and spark.conf.get(key, None) is None
    assert size_shuffles(spark, [spark.range(10**12)]) == 89406
    spark.conf.unset(key)
    assert size_shuffles(spark, [spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").select("a")]) == 4 and spark.conf.get(key, None) is None
    spark.conf.unset(key)


@pytest.mark.parametrize("code", [None, 7, 64])
def test_uniqueness_is_exact_and_survives_hash_collisions(spark, monkeypatch, code):
    """In the first slot, in others, and with every value in one of them."""
    from docnest.operators import profile

    n = 300
    data = [(i, f"v{i}", "same", float(i), [i], None, i // 2 if i > 296 else -i, f"{max(i, 1)}") for i in range(n)]
    df = spark.createDataFrame(data, "id int, s string, c string, d double, a array<int>, e string, k long, t string").repartition(3)
    if code is not None:
        monkeypatch.setattr(profile.F, "xxhash64", lambda *cols: profile.F.lit(code).cast("bigint"))
    unique = profile._unique_columns({"t": df, "u": df.limit(0)})
    assert unique == {("t", i) for i in (0, 1, 3, 4, 5)} | {("u", i) for i in range(8)}


def test_samples_keep_null_keys(spark):
    tables = {"t": spark.createDataFrame([(k,) for k in (3, None, 2, 1)], "id int")}
    catalogue = Catalogue.of([TableSpec("t", "id")])
    assert [r["row_json"] for r in rows(sample_rows(tables, catalogue, 3))] == ['{"id":null}', '{"id":1}', '{"id":2}']


def test_caller_sql_leaves_views_as_they_were(spark):
    spark.range(3).createOrReplaceTempView("mine")
    found = sql_rows(spark, {"mine": spark.range(1), "other_rows": spark.range(5)}, "SELECT count(*) AS n FROM mine CROSS JOIN other_rows")
    assert rows(found) == [{"n": 5}] and spark.table("mine").count() == 3
    assert not spark.catalog.tableExists("other_rows")
    spark.catalog.dropTempView("mine")


def test_json_schemas_come_from_the_data(spark):
    from docnest.sources.normalise import INFER, inferred_schemas, normalise

    values = ['{"k": 1, "a": {"b": [1, 2.5]}, "odd `OBJECT<` name": "x"}', '{"k": 3000000000, "n": null, "v": 1}', '{"v": [1]}', "oops", '{"k": 1} x', None]
    df = spark.createDataFrame([(i, v, "7", "{}" if i else "[1]", None) for i, v in enumerate(values)], "i int, t string, n string, mixed string, none string")
    schemas = inferred_schemas(df, ["t", "n", "mixed", "none"])
    assert schemas["t"].startswith("STRUCT<") and schemas["n"] is schemas["mixed"] is schemas["none"] is None
    made = normalise(df, {"t": INFER, "mixed": INFER, "none": INFER})
    assert made.schema["mixed"].dataType.simpleString() == made.schema["none"].dataType.simpleString() == "variant"
    assert made.schema["t"].dataType["k"].dataType.simpleString() == "bigint" and made.schema["t"].dataType["v"].dataType.simpleString() == "variant"
    found = made.selectExpr("i", "t.k", "t.a.b[1] AS b", "t.`odd ``OBJECT<`` name` AS odd", "to_json(t.v) AS v", "t_unparsed AS bad").orderBy("i").collect()
    assert [(r.k, None if r.b is None else float(r.b), r.odd, r.v, r.bad) for r in found] == [
        (1, 2.5, "x", None, None), (3000000000, None, None, "1", None), (None, None, None, "[1]", None), (None, None, None, None, "oops"),
        (None, None, None, None, '{"k": 1} x'), (None, None, None, None, None),
    ]
    assert inferred_schemas(df.limit(0), ["t"]) == {"t": None} and inferred_schemas(df, []) == {}
