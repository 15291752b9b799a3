"""Hot keys against brute force, and the shape of the plans."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from docnest import Catalogue, Computed, Edge, Outlier, Settings, Subset, TableSpec, embed_many, migrate
from docnest.functions.columns import document
from docnest.operators import grouping as g
from docnest.operators import patterns as p
from docnest.operators.profile import edge_profile
from tests.helpers import rows


def hot_rows(n=3000):
    """A third of all rows under one key, a third of those exact copies, some null keys."""
    rnd = random.Random(3)
    data = []
    for i in range(n):
        key = 0 if i % 3 == 0 else (None if i % 50 == 1 else rnd.randrange(1, 200))
        data.append((5 if i % 9 == 0 else i, key, rnd.randrange(10)))
    return data


@pytest.fixture(scope="module")
def hot(spark):
    return spark.createDataFrame(hot_rows(), "id int, p_id int, v int").repartition(6).cache()


def brute(data):
    groups = collections.defaultdict(list)
    for i, key, v in data:
        if key is not None:
            groups[key].append((i, v))
    return {k: sorted(v, reverse=True) for k, v in groups.items()}


@pytest.mark.parametrize("spread", [1, 2, 7])
@pytest.mark.parametrize("n", [1, 4, 50, 1200])
def test_last_docs_of_a_hot_key(spark, hot, spread, n):
    keyed = g.keyed(hot, "p_id", hot.schema["p_id"].dataType)
    found = g.last_docs(keyed, ["id"], ["id", "v"], n, spread)
    got = {r[g.KEY]: [(d["id"], d["v"]) for d in r[g.DOCS]] for r in found.collect()}
    assert got == {k: v[:n] for k, v in brute(hot_rows()).items()}


def test_spread_balances_both_passes():
    assert g.spread_for(None, 3) == 1 and g.spread_for(g.HOT_KEY_ROWS, 3) == 1
    widest, n = 10**10, 100
    spread = g.spread_for(widest, n)
    assert spread == 10**4 and widest / spread == n * spread
    assert g.spread_for(g.HOT_KEY_ROWS + 1, 10**9) == 2


def test_measured_hot_keys_are_spread(hot, monkeypatch):
    monkeypatch.setattr(g, "HOT_KEY_ROWS", 100)
    reader = p.ChildReader(hot, "p_id", "id", ["id"], [Subset("c", 40)])
    assert reader._spread(40) == 5  # sqrt(1000 / 40)
    reader.widest = 50
    assert reader._spread(40) == 1
    assert p.ChildReader(hot, "p_id", "id", ["id"], [])._spread(g.PRUNED_ROWS) == 1


def test_patterns_over_a_hot_key(spark, hot, monkeypatch):
    monkeypatch.setattr(g, "HOT_KEY_ROWS", 100)
    parent = spark.range(0, 210).selectExpr("CAST(id AS INT) AS id")
    patterns = [Computed("n", "COUNT", "c"), Computed("s", "SUM", "c", "v"), Subset("c", 3), Outlier("c", 30)]
    got = p.ChildReader(hot, "p_id", "id", ["id"], patterns).apply(parent)
    truth = brute(hot_rows())
    for r in got.collect():
        docs = truth.get(r["id"], [])
        assert (r["n"], r["s"]) == (len(docs), sum(v for _, v in docs))
        assert [(d["id"], d["v"]) for d in r["recent_c"]] == docs[:3]
        assert [(d["id"], d["v"]) for d in r["c"]] == docs[:30] and r["has_extras"] == (len(docs) > 30)


def test_hot_edge_becomes_a_reference_and_loses_nothing(spark, hot):
    catalogue = Catalogue.of([TableSpec("p", "id"), TableSpec("c", "id")], [Edge("c", "p_id", "p", "id")])
    tables = {"p": spark.range(0, 210), "c": hot}
    moved = migrate(tables, catalogue, Settings(max_children=900))
    assert moved.plan.written == ["p", "c"] and moved.documents["c"].count() == 3000
    nested = migrate(tables, catalogue, Settings(max_children=1000))
    assert nested.plan.written == ["p"]
    profile = rows(edge_profile(nested.raw, catalogue))[0]
    inside = nested.documents["p"].agg(F.sum(F.size("c"))).first()[0]
    assert inside + profile["null_key_rows"] + profile["orphan_rows"] == profile["child_rows"] == 3000


def test_profile_of_a_hot_key(spark, hot):
    catalogue = Catalogue.of([TableSpec("p", "id"), TableSpec("c", "id")], [Edge("c", "p_id", "p", "id")])
    r = rows(edge_profile({"p": spark.range(0, 150), "c": hot}, catalogue))[0]
    data = hot_rows()
    keys = [k for _, k, _ in data if k is not None]
    assert r["max_children"] == 1000 and r["null_key_rows"] == sum(k is None for _, k, _ in data)
    assert r["orphan_rows"] == sum(k >= 150 for k in keys) and r["orphan_keys"] == len({k for k in keys if k >= 150})
    assert r["childless_parents"] == len(set(range(150)) - set(keys)) and r["distinct_keys"] == len(set(keys))
    assert r["downgrade"] is False


# --- plans -----------------------------------------------------------------------------------


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("plans"))
    spark.range(100).selectExpr("id", "id * 2 AS a", "'x' AS unused").write.parquet(f"{folder}/p")
    spark.range(1000).selectExpr("id", "id % 90 AS p_id", "id AS v", "'y' AS w").write.parquet(f"{folder}/c")
    return spark.read.parquet(f"{folder}/p"), spark.read.parquet(f"{folder}/c")


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "BatchEvalPython", "ArrowEvalPython", "Exchange SinglePartition")


def test_nesting_shuffles_each_side_once(files, no_broadcast):
    parent, child = files
    plan = plan_of(embed_many(parent, child, pk="id", fk="p_id", field="c", child_pk=["id"], measured=12))
    assert plan.count("Exchange hashpartitioning") == 2 and not any(f in plan for f in FORBIDDEN)
    assert "IsNotNull(p_id)" in plan


def test_totals_share_the_nesting_shuffle(files, no_broadcast):
    parent, child = files
    totals = [Computed("n", "COUNT", "c"), Computed("s", "SUM", "c", "v")]
    plan = plan_of(embed_many(parent, child, pk="id", fk="p_id", field="c", child_pk=["id"], totals=totals, measured=12))
    assert plan.count("Exchange hashpartitioning") == 2


def test_totals_add_nothing_to_the_nesting_shuffle(files, no_broadcast):
    """What the sums read is made of nested columns after the shuffle, and not sent beside them."""
    parent, child = files
    child = child.withColumn("x", F.col("v") / 8)
    totals = [Computed("s", "SUM", "c", "v"), Computed("t", "SUM", "c", "x", scale=3)]
    found = embed_many(parent, child, pk="id", fk="p_id", field="c", child_pk=["id"], totals=totals, measured=12)
    above, shuffled = plan_of(found).split("Exchange hashpartitioning(__parent_key")
    assert "__total_" in above and "__total_" not in shuffled
    for r in found.collect():
        assert r["s"] == sum(c["v"] for c in r["c"]) and float(r["t"]) == sum(c["x"] for c in r["c"])


def test_patterns_prune_before_the_shuffle(files, no_broadcast):
    parent, child = files
    patterns = [Computed("n", "COUNT", "c"), Subset("c", 3), Outlier("c", 5)]
    plan = plan_of(p.ChildReader(child, "p_id", "id", ["id"], patterns).apply(parent))
    # parent once, counts once, and one shared top-N whose group limit runs on both sides of its shuffle
    assert plan.count("Exchange hashpartitioning") == 3 and not any(f in plan for f in FORBIDDEN)
    assert "WindowGroupLimit" in plan and "Partial" in plan and "Final" in plan


def test_counts_read_the_key_column_only(files, no_broadcast):
    parent, child = files
    docs = p.computed(parent, child, pk="id", fk="p_id", field="n", function="COUNT").select("id", "n")
    plan = plan_of(docs)
    assert "ReadSchema: struct<p_id:bigint>" in plan and "ReadSchema: struct<id:bigint>" in plan


def test_document_is_a_struct_of_the_named_columns(files):
    parent, _ = files
    assert parent.select(document(["a", "id"]).alias("d")).schema["d"].dataType.names == ["a", "id"]
