"""Replacing a whole set, and finding out what became of every row."""

import pytest
from docnest import Catalogue, Computed, Edge, PlanError, Settings, TableSpec, migrate
from docnest.reports.overview import target_overview
from docnest.reports.reconcile import reconciled
from docnest.sinks.documents import read_documents
from docnest.sinks.versions import MANIFESTS, current, read_current, replace_documents
from docnest.sources.tables import sample_rows
from pyspark.sql import functions as F
from tests.helpers import rows


@pytest.mark.parametrize("source", ["json", "parquet"])
def test_readers_follow_the_manifest(spark, tmp_path, source):
    folder = str(tmp_path)
    with pytest.raises(PlanError, match="committed"):
        read_current(spark, folder)
    first = replace_documents(spark, {"ships": spark.range(3), "logs": spark.range(2), "none": spark.range(0)}, folder, source)
    assert first.number == 1 and set(read_current(spark, folder)) == {"ships", "logs"}
    replace_documents(spark, {"ships": spark.range(5)}, folder, source)
    found = read_current(spark, folder)
    assert set(found) == {"ships"} and found["ships"].count() == 5 and found["ships"].dtypes == [("id", "bigint")]
    assert read_current(spark, folder, first)["logs"].count() == 2  # for those who still read it
    replace_documents(spark, {"ships": spark.range(6)}, folder, source)
    assert len([p for p in tmp_path.iterdir() if p.name.startswith("data-")]) == 2 and read_current(spark, folder)["ships"].count() == 6


def test_a_failed_write_leaves_the_old_set(spark, tmp_path):
    folder = str(tmp_path)
    replace_documents(spark, {"ships": spark.range(3)}, folder, "parquet")
    broken = spark.range(3).select(F.when(F.col("id") < 2, F.col("id")).otherwise(F.raise_error(F.lit("broken"))).alias("id"))
    with pytest.raises(Exception, match="broken"):
        replace_documents(spark, {"logs": spark.range(9), "ships": broken}, folder, "parquet")
    assert read_current(spark, folder)["ships"].count() == 3 and set(read_current(spark, folder)) == {"ships"}
    assert len([p for p in tmp_path.iterdir() if p.name.startswith("data-")]) == 1
    # a writer that died while it wrote its manifest
    (tmp_path / MANIFESTS / f"{2:012d}.json").write_text('{"number": 2, "fol')
    assert current(spark, folder).number == 1
    assert replace_documents(spark, {"ships": spark.range(4)}, folder, "parquet").number == 3
    assert read_current(spark, folder)["ships"].count() == 4


def test_of_two_writers_one_fails(spark, tmp_path, monkeypatch):
    from docnest.sinks import versions

    folder = str(tmp_path)
    replace_documents(spark, {"ships": spark.range(1)}, folder, "parquet")
    seen = versions._manifests
    monkeypatch.setattr(versions, "_manifests", lambda store: [n for n in seen(store) if n < 1])
    with pytest.raises(PlanError, match="another writer"):
        replace_documents(spark, {"ships": spark.range(2)}, folder, "parquet")
    monkeypatch.setattr(versions, "_manifests", seen)
    assert read_current(spark, folder)["ships"].count() == 1


CATALOGUE = Catalogue.of(
    [TableSpec("ports", "id"), TableSpec("ships", "id"), TableSpec("cards", "id", ("ship",)), TableSpec("calls", "id")],
    [Edge("ships", "port", "ports", "id"), Edge("cards", "ship", "ships", "id"), Edge("calls", "ship", "ships", "id")],
)


def tables(spark):
    return {
        "ports": spark.createDataFrame([(1, "a"), (2, None)], "id int, name string"),
        "ships": spark.createDataFrame([(i, i % 4 or None, i / 4) for i in range(20)], "id int, port int, size double"),
        "cards": spark.createDataFrame([(i, i, f"c{i}") for i in range(5, 12)], "id int, ship int, text string"),
        "calls": spark.createDataFrame([(i, i % 25, [i, None]) for i in range(200)], "id int, ship int, marks array<int>"),
    }


def test_every_row_is_found_again(spark, tmp_path):
    settings = Settings({"calls.ships": "REFERENCE"}, patterns={"ports": [Computed("n", "COUNT", "ships")]})
    for chosen in (Settings(), settings):
        moved = migrate(tables(spark), CATALOGUE, chosen)
        folder = str(tmp_path / str(len(chosen.patterns)))
        written = moved.write(spark, folder, "parquet")
        back = {t: f for t, f in read_documents(spark, folder, moved.datasets, "parquet").items() if t in written}
        found = {(r["table_name"], r["place"]): r for r in rows(reconciled(moved, back))}
        assert all(r["same"] for r in found.values())
        ships = found["ships", "ships.port->ports.id"]
        assert ships["rows_expected"] == ships["rows_found"] == 10 and ships["columns_compared"] == 3
        assert found["cards", "cards.ship->ships.id"]["rows_found"] == 4


@pytest.mark.parametrize("damage", ["changed", "lost", "doubled", "moved", "null"])
def test_damage_shows(spark, damage):
    moved = migrate(tables(spark), CATALOGUE)
    change = {
        "changed": lambda c: F.transform(c, lambda x: x.withField("size", x["size"] + (x["id"] == 5).cast("int"))),
        "lost": lambda c: F.filter(c, lambda x: x["id"] != 5),
        "doubled": lambda c: F.concat(c, F.filter(c, lambda x: x["id"] == 5)),
        "moved": lambda c: F.transform(c, lambda x: x.withField("size", F.when(x["id"] == 5, 9 / 4).when(x["id"] == 9, 5 / 4).otherwise(x["size"]))),
        "null": lambda c: F.transform(c, lambda x: x.withField("size", F.when(x["id"] == 5, None).otherwise(x["size"]))),
    }[damage]
    back = {"ports": moved.documents["ports"].withColumn("ships", change(F.col("ships")))}
    found = {r["table_name"]: r["same"] for r in rows(reconciled(moved, back))}
    assert found["ships"] is False and found["ports"] is True


def test_samples_by_key_and_bounded(spark):
    t = {"t": spark.createDataFrame([(3, "x" * 500), (1, None), (2, "y")], "id int, s string")}
    found = rows(sample_rows(t, Catalogue.of([TableSpec("t", "id")]), 3, 100))
    assert [r["row_json"][:8] for r in found] == ['{"id":1,', '{"id":2,', '{"id":3,'] and [r["n_bytes"] for r in found][2] > 500
    assert all(len(r["row_json"]) <= 100 for r in found)
    seen = rows(target_overview(spark, t, 2, {"t": ("id",)}))
    assert seen == [{"dataset": "t", "documents": 3, "samples": ['{"id":1,"s":null}', '{"id":2,"s":"y"}']}]
    assert rows(target_overview(spark, {"t": t["t"].limit(0)}, 2))[0]["samples"] == []


def test_datasets_that_are_nested_now_are_removed(spark, tmp_path):
    migrate(tables(spark), CATALOGUE, Settings({"calls.ships": "REFERENCE"})).write(spark, str(tmp_path), "parquet")
    assert {p.name for p in tmp_path.iterdir()} == {"port", "call"}
    migrate(tables(spark), CATALOGUE).write(spark, str(tmp_path), "parquet")
    assert {p.name for p in tmp_path.iterdir()} == {"port"}
