import datetime as dt
import random
from decimal import ROUND_HALF_UP, Decimal

import pytest

from docnest import Attribute, Computed, Outlier, PlanError, Subset
from docnest.operators import patterns as p
from tests.helpers import rows


def parents(spark):
    return spark.createDataFrame([(1,), (2,)], "id int")


def total(spark, kind, values, **how):
    child = spark.createDataFrame([(i, 1, v) for i, v in enumerate(values)], f"id int, parent_id int, price {kind}")
    docs = p.computed(parents(spark), child, pk="id", fk="parent_id", field="t", function="SUM", column="price", **how)
    return [r["t"] for r in rows(docs, "id")]


def test_count_counts_rows_even_with_null_values(spark):
    child = spark.createDataFrame([(1, 1), (None, 1), (3, 1), (4, None), (5, 9)], "id int, parent_id int")
    docs = p.computed(parents(spark), child, pk="id", fk="parent_id", field="n", function="count", column="id")
    assert rows(docs, "id") == [{"id": 1, "n": 3}, {"id": 2, "n": 0}]


def test_sums(spark):
    assert total(spark, "int", [31, 7, -4]) == [34, 0]
    assert total(spark, "double", [0.1] * 10, scale=2) == [Decimal("1.00"), 0]
    assert total(spark, "double", [0.1, float("nan"), float("inf"), None]) == [Decimal("0.1"), 0]
    assert total(spark, "float", [0.1, 0.2], scale=4) == [Decimal("0.3"), 0]
    assert total(spark, "decimal(5,2)", [Decimal("1.25"), Decimal("2.50")]) == [Decimal("3.75"), 0]
    assert total(spark, "string", ["1.5", "x", " 2 ", "2e1", None], scale=1) == [Decimal("21.5"), 0]
    assert total(spark, "boolean", [True, True]) == [0, 0]


def test_sums_of_doubles_are_those_of_their_printed_decimals(spark):
    rnd = random.Random(5)
    values = [round(rnd.uniform(-1e7, 1e7), rnd.randint(0, 9)) for _ in range(3000)]
    values += [1.005, 2.675, 1e15, -1e15, 35184372088832.0, 0.1 + 0.2, 123456789012.3456, 1e-7]
    for scale in (0, 2, 4, 12):
        unit = Decimal(1).scaleb(-scale)
        exact = sum((Decimal(repr(v)) for v in values), Decimal(0)).quantize(unit, ROUND_HALF_UP)
        assert total(spark, "double", values, scale=scale) == [exact, 0], scale
    assert total(spark, "int", [2**31 - 1, -(2**31), -1, None]) == [-2, 0]
    assert total(spark, "int", [-5, 3], wide=True) == [Decimal(-2), 0]


def test_sum_out_of_range_is_loud_or_wide(spark):
    big = [2**63 - 1, 1]
    assert total(spark, "bigint", big, wide=True) == [Decimal(2**63), 0]
    with pytest.raises(Exception, match="BIGINT range"):
        total(spark, "bigint", big)
    with pytest.raises(Exception, match="out of range"):
        total(spark, "double", [1e30])
    with pytest.raises(Exception, match="does not fit"):
        total(spark, "double", [1e200])


def test_sums_are_rounded_once(spark):
    for kind, value in (("double", 0.004), ("float", 0.004), ("string", "0.004")):
        assert total(spark, kind, [value] * 1000, scale=2) == [Decimal("4.00"), 0], kind
    assert total(spark, "string", ["0.004", "1.2345"], scale=2) == [Decimal("1.24"), 0]
    assert total(spark, "double", [1e25, 0.004, 0.004], scale=2) == [Decimal("10000000000000000000000000.01"), 0]


@pytest.mark.parametrize(("function", "column"), [("AVG", "price"), ("SUM", None)])
def test_bad_expressions_fail_when_planned(function, column):
    with pytest.raises(PlanError):
        Computed("t", function, "children", column)


def test_unknown_sum_column_fails_when_planned(spark):
    child = spark.createDataFrame([(1, 1)], "id int, parent_id int")
    with pytest.raises(PlanError):
        p.computed(parents(spark), child, pk="id", fk="parent_id", field="t", function="SUM", column="nope")


PUMP = "pump string, bar_spring string, bar_autumn string, bar_winter string"


def test_attribute_folds_and_drops(spark):
    df = spark.createDataFrame([("p-4", None, "3.5", "2.25")], PUMP)
    mapping = {"bar_winter": "w", "bar_spring": "s", "bar_summer": "u", "bar_autumn": "a"}
    assert rows(p.attribute(df, Attribute("pressures", mapping))) == [
        {"pump": "p-4", "pressures": [{"key": "w", "value": "2.25"}, {"key": "a", "value": "3.5"}]}
    ]


def test_attribute_edges(spark):
    df = spark.createDataFrame([("p-4", None, None, None)], PUMP)
    again = [("bar_spring", "s"), ("BAR_spring", "again"), ("broken",), ("", "x"), 5]
    got = p.attribute(df, Attribute("pump", again))  # replaces a field of that name, in place
    assert got.columns == ["pump", "bar_autumn", "bar_winter"] and got.first()["pump"] == []
    assert p.attribute(df, Attribute("none", {})).first()["none"] == []


def test_attribute_with_mixed_types(spark):
    df = spark.createDataFrame([("x", 5, dt.date(2020, 1, 2), [1, 2])], "a string, b int, c date, d array<int>")
    mapping = {"a": "A", "b": "B", "c": "C", "d": "D"}
    mixed = p.attribute(df, Attribute("all", mapping))
    assert mixed.selectExpr("to_json(all) AS j").first()["j"] == (
        '[{"key":"A","value":"x"},{"key":"B","value":5},{"key":"C","value":"2020-01-02"},{"key":"D","value":[1,2]}]'
    )
    text = p.attribute(df, Attribute("all", {"a": "A", "b": "B", "c": "C"}, "string")).first()["all"]
    assert [e["value"] for e in text] == ["x", "5", "2020-01-02"]


def reviews(spark, n):
    return spark.range(1, n + 1).selectExpr("id", "concat('t', id) AS text", "CAST(1 AS INT) AS product_id")


@pytest.mark.parametrize(("n", "limit", "expected"), [(100, 3, [100, 99, 98]), (2, 5, [2, 1]), (4, 0, [])])
def test_subset(spark, n, limit, expected):
    docs = p.subset(
        parents(spark), reviews(spark, n), pk="id", fk="product_id", child_pk=["id"], limit=limit, field="recent_reviews"
    )
    first, second = rows(docs, "id")
    assert [r["id"] for r in first["recent_reviews"]] == expected and second["recent_reviews"] == []
    assert all(set(r) == {"id", "text"} for r in first["recent_reviews"])


@pytest.mark.parametrize(
    ("n", "threshold", "kept", "extras"),
    [(5, 3, [5, 4, 3], True), (3, 3, [3, 2, 1], False), (2, 3, [2, 1], False), (1, 0, [], True)],
)
def test_outlier(spark, n, threshold, kept, extras):
    docs = p.outlier(
        parents(spark), reviews(spark, n), pk="id", fk="product_id", child_pk=["id"], threshold=threshold, field="reviews"
    )
    first, second = rows(docs, "id")
    assert [r["id"] for r in first["reviews"]] == kept and first["has_extras"] is extras
    assert second["reviews"] == [] and second["has_extras"] is False


@pytest.mark.parametrize("bad", [-1, "x", 1.5, None, True])
def test_limits_are_whole_and_not_negative(bad):
    with pytest.raises(PlanError):
        Subset("c", bad)
    with pytest.raises(PlanError):
        Outlier("c", bad)


def test_latest_children_with_variant_fields(spark):
    child = reviews(spark, 4).selectExpr("id", "product_id", "parse_json(concat('{\"n\":', id, '}')) AS v")
    docs = p.subset(parents(spark), child, pk="id", fk="product_id", child_pk=["id"], limit=2, field="r")
    assert docs.selectExpr("id", "to_json(r) AS j").filter("id = 1").first()["j"] == (
        '[{"id":4,"v":{"n":4}},{"id":3,"v":{"n":3}}]'
    )


def test_a_key_nobody_has_gives_empty_results(spark):
    child = reviews(spark, 3)
    docs = p.computed(parents(spark), child, pk="id", fk="missing_id", field="n", function="COUNT")
    assert [r["n"] for r in rows(docs, "id")] == [0, 0]
    docs = p.outlier(parents(spark), child, pk="gone", fk="product_id", child_pk=["id"], threshold=2, field="r")
    assert all(r["r"] == [] and r["has_extras"] is False for r in rows(docs))
