import random

import pytest
from docnest.operators import keys as k
from tests.helpers import rows


@pytest.fixture(scope="module")
def lake(spark):
    r = random.Random(1)
    ports = spark.createDataFrame([(i, f"port {i}", i % 7) for i in range(400)], "p_portkey int, p_name string, p_zone int")
    ships = spark.createDataFrame([(1000 + i, r.randrange(400), r.choice([None, 3])) for i in range(900)], "s_shipkey long, s_portkey long, s_size int")
    calls = spark.createDataFrame([(i, 1000 + r.randrange(900), r.randrange(500)) for i in range(3000)], "c_id long, c_shipkey long, c_portkey int")
    logs = spark.createDataFrame([(r.randrange(3000) // 90 * 90, "x") for _ in range(50)], "call_no int, note string")
    return {"ports": ports, "ships": ships, "calls": calls, "logs": logs}


def test_references_without_a_catalogue(spark, lake):
    found = rows(k.references(spark, lake))
    assert [(f["child"], f["fk"], f["parent"], f["pk"]) for f in found] == [("calls", "c_shipkey", "ships", "s_shipkey"), ("ships", "s_portkey", "ports", "p_portkey")]
    named = {(f["child"], f["parent"]) for f in rows(k.references(spark, lake, {"call_no": "id"}))}
    assert ("logs", "calls") in named  # and calls.c_portkey, of which some values are no port, is none


def test_a_catalogue_from_the_data(spark, lake):
    made = k.discovered(spark, lake, {"call_no": "id"})
    assert made.spec("ports").pk == ("p_portkey",) and made.spec("calls").pk == ("c_id",) and made.spec("logs").pk == ("call_no", "note")
    assert {e.label for e in made.edges} == {"calls.c_shipkey->ships.s_shipkey", "ships.s_portkey->ports.p_portkey", "logs.call_no->calls.c_id"}


def test_inclusion_alone(spark):
    a = spark.range(100).selectExpr("id AS a_key", "id % 3 AS few")
    b = spark.range(1000).selectExpr("id AS b_key", "id % 99 AS most", "id % 50 AS half", "CAST(id AS STRING) AS word")
    found = {(f["child"], f["fk"], f["parent"]) for f in rows(k.references(spark, {"a": a, "b": b}, by_name=False))}
    assert found == {("b", "most", "a")}


def test_sketches_only_rule_out_what_is_missing(spark):
    assert k.may_include(list(range(0, 512, 2)), [4, 1000]) and not k.may_include(list(range(0, 512, 2)), [3])
    assert not k.may_include([1, 2], [9]) and k.may_include([], []) and not k.may_include([], [1])
    r = random.Random(2)
    for _ in range(50):
        every = sorted(r.sample(range(10**6), 2000))
        part = sorted(r.sample(every, 300))
        assert k.may_include(every[: k.SKETCH], part[: k.SKETCH])


def test_empty_tables_and_nulls(spark):
    t = {"a": spark.createDataFrame([], "x_key int"), "b": spark.createDataFrame([(None,)], "y_key int")}
    assert rows(k.references(spark, t)) == []
