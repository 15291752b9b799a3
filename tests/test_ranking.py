import random

from docnest.functions.ranking import BEFORE, RANK, ranked
from pyspark.sql import functions as F


def brute(data):
    groups = {}
    for g, o, w in data:
        groups.setdefault(g, []).append((o is not None, o or 0, w))
    return groups


def test_ranks_and_running_weights_of_any_group(spark):
    r = random.Random(5)
    data = [(r.choice(["a", "a", "a", "b", None]), r.choice([None, *range(40)]), r.randrange(9)) for _ in range(3000)]
    df = spark.createDataFrame(data, "g string, o int, w long").repartition(7)
    found = [tuple(x) for x in ranked(df, ["g"], ["o", "w"], F.col("w")).collect()]
    assert len(found) == len(data)
    for g, rows in brute(data).items():
        rows.sort()
        mine = sorted((rank, o is not None, o or 0, w, before) for gg, o, w, rank, before in found if gg == g)
        assert [m[0] for m in mine] == list(range(len(rows)))
        assert [m[1:4] for m in mine] == rows
        total = 0
        for m in mine:
            assert m[4] == total
            total += m[3]


def test_a_group_over_many_partitions_and_no_group_at_all(spark):
    df = spark.range(5000).selectExpr("id % 10 AS o", "id AS v").repartition(8)
    found = ranked(df, [], ["o"]).orderBy(RANK).collect()
    assert [x[RANK] for x in found] == list(range(5000)) and [x.o for x in found] == sorted(x.o for x in found)
    assert ranked(df.where("false"), ["o"], ["v"]).count() == 0


def test_equal_rows_do_not_meet_in_one_task(spark):
    same = spark.range(8000).selectExpr("1 AS g", "1 AS o").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = ranked(same, ["g"], ["o"])
        assert sorted(x[RANK] for x in found.collect()) == list(range(8000))
        assert len([f for f in found.inputFiles() if "ranges" in f]) > 2
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
