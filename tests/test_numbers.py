import random
from decimal import ROUND_HALF_UP, Decimal, localcontext

import pytest
from pyspark.sql import functions as F

from docnest import Approximation
from docnest.functions.naming import dataset_name
from docnest.operators.patterns import approximation
from tests.helpers import rows


def one(spark, kind, value, step, wide=False):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return approximation(df, Approximation({"x": step}, wide)).first()[0]


@pytest.mark.parametrize(
    ("kind", "value", "step", "expected"),
    [
        ("int", 31872, 100, 31900),
        ("int", 7350, 100, 7400),
        ("int", -45, 10, -50),
        ("int", 53, 10, 50),
        ("smallint", 7, 5, 5),
        ("bigint", 7350, 100, 7400),
        ("double", 64.25, 10, 60.0),
        ("double", 18.3, 5, 20.0),
        ("float", 18.3, 5, 20.0),
        ("decimal(10,2)", Decimal("149.99"), 100, Decimal(100)),
        ("decimal(38,18)", Decimal("149.999999999999999999"), 100, Decimal(100)),
        ("string", "123.456", 10, "120"),
        ("string", " 95 ", 10, "100"),
        ("string", "1.25e2", 10, "130"),
        ("string", "149." + "9" * 30, 100, "100"),
        ("string", "about 7", 10, "about 7"),
        ("string", "123456789012345678901234.5", 10, "123456789012345678901230"),
        ("string", "123456789012345678901234.50001", 1, "123456789012345678901235"),
        ("string", "9" * 37, 10, "1" + "0" * 37),
        ("int", None, 10, None),
        ("double", float("inf"), 10, float("inf")),
    ],
)
def test_nearest_multiple(spark, kind, value, step, expected):
    assert one(spark, kind, value, step) == expected


def test_not_a_number_stays(spark):
    assert str(one(spark, "double", float("nan"), 10)) == "nan"


def test_negative_zero_does_not_appear(spark):
    assert str(one(spark, "double", -1.0, 10)) == "0.0"


def test_out_of_range_is_loud_or_wide(spark):
    largest = 2**63 - 1
    assert one(spark, "bigint", largest, 10, wide=True) == Decimal("9223372036854775810")
    with pytest.raises(Exception, match="BIGINT range"):
        one(spark, "bigint", largest, 10)


def test_malformed_entries_are_skipped(spark):
    df = spark.createDataFrame([(7, "x", [1])], "a int, b string, c array<int>")
    kept = approximation(df, Approximation([("a", 0), ("a", -5), ("a", "x"), ("b", 5), ("c", 5), ("zz", 5), "junk", ("", 5)]))
    assert rows(kept) == [{"a": 7, "b": "x", "c": [1]}]
    assert approximation(df, Approximation([("a", 5), ("a", 10)])).first()["a"] == 10


def test_doubles_round_as_their_printed_decimals(spark):
    rnd = random.Random(7)
    values = [round(rnd.uniform(-1e6, 1e6), rnd.randint(0, 6)) for _ in range(2000)]
    values += [k / 2 for k in range(-60, 60)] + [0.49999999999999994, 2.5 - 2**-51, 1e15 + 0.5]
    step = 5
    df = spark.createDataFrame([(v,) for v in values], "x double").withColumn("raw", F.col("x"))
    for r in approximation(df, Approximation({"x": step})).collect():
        exact = (Decimal(repr(r["raw"])) / step).quantize(Decimal(1), ROUND_HALF_UP) * step
        assert r["x"] == float(exact), r


# Table names and the datasets they are written to.
@pytest.mark.parametrize(
    ("table", "expected"),
    [
        ("employees", "employee"), ("addresses", "address"), ("categories", "category"), ("boxes", "box"),
        ("quizzes", "quizz"), ("class", "class"), ("Users", "user"), ("data", "data"),
    ],
)
def test_dataset_name(table, expected):
    assert dataset_name(table) == expected


def summed(spark, kind, values, scale=None, wide=False):
    from docnest import Computed
    from docnest.operators.patterns import ChildReader

    child = spark.createDataFrame([(1, v) for v in values], f"p int, x {kind}")
    return ChildReader(child, "p", "id", (), [Computed("s", "SUM", "c", "x", scale=scale, wide=wide)]).apply(spark.createDataFrame([(1,)], "id int")).first()["s"]


def random_number(rnd):
    whole, part = ("".join(rnd.choice("0123456789") for _ in range(rnd.choice(n))) for n in ((0, 1, 3, 12, 22), (0, 1, 2, 4, 9, 35)))
    text = rnd.choice(["", "-", "+"]) + ((whole + "." + part if part else whole) or "7")
    return text + (f"e{rnd.randint(-12, 6)}" if rnd.random() < 0.2 else "")


@pytest.mark.parametrize("scale", [0, 2, 5, 9])
def test_sums_of_text_are_exact_whatever_its_length(spark, scale):
    rnd = random.Random(scale)
    for n in (1, 5, 200):
        values = [random_number(rnd) for _ in range(n)]
        with localcontext() as context:
            context.prec = 200
            exact = sum(map(Decimal, values), Decimal(0)).quantize(Decimal(1).scaleb(-scale), ROUND_HALF_UP)
        assert summed(spark, "string", [*values, "x", "", None, "1.2.3"], scale) == exact


def test_sums_of_large_numbers_keep_their_places(spark):
    assert summed(spark, "string", ["12345678901234567890.004"] * 1000, 2) == Decimal("12345678901234567890004.00")
    assert summed(spark, "double", [0.1] * 10 + [1e-18] * 5 + [2.0**60, -(2.0**60)], 18) == Decimal("1.000000000000000005")
    assert summed(spark, "double", [float("nan"), float("inf"), None], 2) == 0
    assert summed(spark, "float", [0.1, 0.2, 1e10], 2) == Decimal("10000000000.30")
    assert summed(spark, "bigint", [2**63 - 1, 2**63 - 1, -(2**63)], wide=True) == Decimal(2**63 - 2)


def test_halves_go_away_from_zero_and_places_far_out_count(spark):
    assert summed(spark, "string", ["-2.5"], 0) == -3 and summed(spark, "string", ["2.5"], 0) == 3
    assert summed(spark, "string", ["0.4" + "9" * 30, "0." + "0" * 30 + "1"], 0) == 1
    assert summed(spark, "string", ["-0.4" + "9" * 30], 0) == 0
    assert summed(spark, "string", ["1." + "3" * 60, "1e-400"], 2) == Decimal("1.33")
    with pytest.raises(Exception, match="decide the last"):
        summed(spark, "string", ["0.5", "-1e-60"], 0)


def test_sums_out_of_range_are_loud(spark):
    for values in (["1e50"], ["9" * 37] * 20):
        with pytest.raises(Exception, match="range|fit"):
            summed(spark, "string", values, 2)


@pytest.mark.parametrize("step", [1, 3, 10, 999_999_937, 2**31 - 1])
def test_text_of_any_length_is_rounded(spark, step):
    rnd = random.Random(step)
    values = [random_number(rnd) for _ in range(150)]
    values += ["9" * 60, "1" + "0" * 60 + ".5", "-" + "9" * 40 + ".49", "1e30", "-0.4", ".5", "5e40", "0" * 50, "7e-99999999999", "0e99999999999"]
    df = spark.createDataFrame([(v,) for v in values], "x string").withColumn("raw", F.col("x"))
    with localcontext() as context:
        context.prec = 2000
        for r in approximation(df, Approximation({"x": step})).collect():
            exact = (Decimal(r["raw"].replace("e99999999999", "").replace("e-99999999999", "e-999")) / step).quantize(Decimal(1), ROUND_HALF_UP) * step
            assert r["x"] == str(int(exact)), r
    with pytest.raises(Exception, match="too long to round"):
        approximation(spark.createDataFrame([("1e99999",)], "x string"), Approximation({"x": step})).collect()
