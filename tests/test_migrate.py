"""End to end on the seed database, against documents worked out by hand."""

import json

import pytest
from docnest import Catalogue, Computed, Custom, Edge, Outlier, PlanError, Settings, TableSpec, migrate, register_pattern
from docnest.reports.overview import migration_summary, relationship_map, target_overview
from docnest.session import shared_folder
from docnest.sinks.documents import read_documents
from tests import seed
from tests.helpers import rows


@pytest.fixture(scope="module")
def moved(spark):
    return migrate(seed.tables(spark), seed.CATALOGUE, seed.SETTINGS, seed.JSON_COLUMNS)


def test_datasets_and_order(moved):
    assert set(moved.datasets) == {"soundings", "signals", "berths", "ships", "routes", "sailings"}
    at = {t: i for i, t in enumerate(moved.plan.order)}
    assert at["papers"] < at["ships"] < at["berths"]


def test_ships(moved):
    found = {r["hull"]: r for r in rows(moved.documents["ships"])}
    assert [found[h]["tows"] for h in (10, 20, 30, 40, 50)] == [0, 0, 3, 0, 0]
    assert [s["seq"] for s in found[40]["recent_signals"]] == [5, 4, 3, 2]
    assert [s["seq"] for s in found[40]["signals"]] == [5, 4, 3]
    assert [s["seq"] for s in found[10]["signals"]] == [7, 6] and not found[10]["has_extras"] and found[40]["has_extras"]
    assert set(found[40]["signals"][0]) == {"seq", "body"} and found[20]["signals"] == found[20]["recent_signals"] == []
    assert found[20]["papers"] is None and found[10]["papers"]["folio"] == 8
    assert [x["key"] for x in found[40]["papers"]["stamps"]] == ["issued", "flag state"]
    assert [x["key"] for x in found[10]["papers"]["stamps"]] == ["issued"]


def test_berths_nest_ships_with_their_patterns(moved):
    east, west = rows(moved.documents["berths"], "code")
    assert [s["hull"] for s in east["ships"]] == [40, 50] and [s["hull"] for s in west["ships"]] == [10, 30]
    assert (east["tonnage"], east["moored"], west["tonnage"], west["moored"]) == (710, 2, 790, 2)
    assert west["ships"][1]["tows"] == 3 and west["ships"][1]["tug"] is None and "berth" not in west["ships"][1]
    assert east["ships"][0]["papers"]["folio"] == 7


def test_other_tables(moved):
    depths = [r["depth"] for r in rows(moved.documents["soundings"], "no")]
    assert [None if d is None else int(d) for d in depths] == [12, -4, None, 0]
    assert rows(moved.documents["soundings"], "no")[0]["taken"].microsecond == 789000
    assert {r["route"]: r["calls"] for r in rows(moved.documents["routes"])} == {"north": 3, "south": 1}
    assert [r["sender"] for r in rows(moved.documents["signals"], "seq")] == [40] * 5 + [10, 10, None]


@pytest.mark.parametrize("source", ["json", "parquet"])
def test_written_and_reconciled(spark, moved, source, tmp_path):
    written = moved.write(spark, str(tmp_path), source)
    assert set(written) == set(moved.datasets)
    assert {p.name for p in tmp_path.iterdir()} == {"sounding", "signal", "berth", "ship", "route", "sailing"}
    back = read_documents(spark, str(tmp_path), moved.datasets, source)
    summary = {r.pop("table_name"): r for r in rows(migration_summary(moved, back))}
    assert summary["ships"] == {"rows_read": 5, "rows_nested": 4, "rows_orphaned": 1, "docs_written": 5}
    assert summary["papers"] == {"rows_read": 3, "rows_nested": 3, "rows_orphaned": 0, "docs_written": None}
    overview = {r["dataset"]: r for r in rows(target_overview(spark, back, 2))}
    assert overview["signal"]["documents"] == 8 and len(overview["signal"]["samples"]) == 2
    assert "papers" in json.loads(overview["ship"]["samples"][0])


def test_json_keeps_nulls_and_variants(spark, moved, tmp_path):
    moved.write(spark, str(tmp_path))
    read = lambda name: [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/{name}").collect()]
    assert {d["code"]: d["metres"] for d in read("berth")} == {"B-east": 120, "B-west": None}
    charts = {d["route"]: d["chart"] for d in read("route")}
    assert charts == {"north": {"legs": [3, 5]}, "south": "{oops"}
    assert sorted(d["depth"] for d in read("sounding") if d["depth"] is not None) == [-4.0, 0.0, 12.0]


def test_json_is_compressed_unless_asked_otherwise(spark, tmp_path):
    n = 2000
    catalogue = Catalogue.of([TableSpec("ports", "id"), TableSpec("calls", "call_number")], [Edge("calls", "port", "ports", "id")])
    calls = spark.range(n).selectExpr("id AS call_number", "id % 20 AS port", "if(id % 3 = 0, NULL, id / 7) AS tonnage_on_arrival")
    moved = migrate({"ports": spark.range(21), "calls": calls}, catalogue)
    text, size = {}, {}
    for name, options in (("default", None), ("plain", {"compression": "none"})):
        moved.write(spark, f"{tmp_path}/{name}", options=options)
        files = [f for f in (tmp_path / name / "port").iterdir() if f.name.startswith("part-")]
        assert files and all(f.name.endswith(".json.gz") == (name == "default") for f in files)
        size[name] = sum(f.stat().st_size for f in files)
        text[name] = sorted(r.value for r in spark.read.text(f"{tmp_path}/{name}/port").collect())
        back = read_documents(spark, f"{tmp_path}/{name}", moved.datasets)["ports"]
        assert back.selectExpr("sum(size(calls))").first()[0] == n
    assert text["default"] == text["plain"] and len(text["plain"]) == 21 and sum(t.count('"tonnage_on_arrival":null') for t in text["plain"]) == 667
    assert size["plain"] == sum(len(t) + 1 for t in text["plain"]) > 3 * size["default"]


def test_staged_run_gives_the_same_documents(spark, moved):
    again = migrate(
        seed.tables(spark), seed.CATALOGUE, seed.SETTINGS, seed.JSON_COLUMNS, stage_folder=shared_folder(spark, "stage")
    )
    as_json = "to_json(struct(*), map('ignoreNullFields', 'false')) AS j"
    for name, frame in moved.documents.items():
        assert sorted(r.j for r in frame.selectExpr(as_json).collect()) == sorted(
            r.j for r in again.documents[name].selectExpr(as_json).collect()
        ), name


def test_empty_table_leaves_no_dataset(spark, tmp_path):
    catalogue = Catalogue.of([TableSpec("lamps", "id"), TableSpec("blanks", "id")])
    tables = {"lamps": spark.range(2), "blanks": spark.range(0)}
    assert migrate({**tables, "blanks": spark.range(1)}, catalogue).write(spark, str(tmp_path)) == ["lamps", "blanks"]
    assert migrate(tables, catalogue).write(spark, str(tmp_path)) == ["lamps"]
    assert {p.name for p in tmp_path.iterdir()} == {"lamp"}


def test_names_must_not_collide(spark, tmp_path):
    catalogue = Catalogue.of([TableSpec("lamp", "id"), TableSpec("lamps", "id")])
    with pytest.raises(PlanError):
        migrate({"lamp": spark.range(1), "lamps": spark.range(1)}, catalogue).write(spark, str(tmp_path))


def test_capped_array_needs_reference(spark):
    settings = Settings(patterns={"ships": [Outlier("signals", 2)]})
    with pytest.raises(PlanError, match="REFERENCE"):
        migrate(seed.tables(spark), seed.CATALOGUE, settings)


def parent_child(spark, n, fks=("p_id",)):
    catalogue = Catalogue.of(
        [TableSpec("parents", "id"), TableSpec("children", "id")], [Edge("children", k, "parents", "id") for k in fks]
    )
    keys = [f"CAST(id % 2 AS INT) AS {k}" for k in fks]
    return catalogue, {"parents": spark.range(3), "children": spark.range(n).selectExpr("id", *keys, "id * 10 AS v")}


def test_limit_downgrades_only_above_it(spark):
    catalogue, tables = parent_child(spark, 6)
    at_limit = migrate(tables, catalogue, Settings(max_children=3))
    assert at_limit.plan.written == ["parents"] and "children" in at_limit.documents["parents"].columns
    above = migrate(tables, catalogue, Settings(max_children=2))
    assert above.plan.written == ["parents", "children"] and above.documents["parents"].columns == ["id"]
    assert "p_id" in above.documents["children"].columns
    # the capped array is allowed once the limit has made the edge a reference
    capped = Settings(max_children=2, patterns={"parents": [Outlier("children", 1)]})
    got = rows(migrate(tables, catalogue, capped).documents["parents"], "id")
    assert [[c["id"] for c in r["children"]] for r in got] == [[4], [5], []]
    assert [r["has_extras"] for r in got] == [True, True, False]


def test_two_keys_to_one_parent_get_role_names(spark):
    catalogue, tables = parent_child(spark, 4, ("buyer_id", "seller_id"))
    doc = migrate(tables, catalogue).documents["parents"]
    assert doc.columns == ["id", "children_by_buyer_id", "children_by_seller_id"]
    first = rows(doc, "id")[0]
    assert first["children_by_buyer_id"] == [{"id": 0, "seller_id": 0, "v": 0}, {"id": 2, "seller_id": 0, "v": 20}]
    with pytest.raises(PlanError, match="fk="):
        migrate(tables, catalogue, Settings(patterns={"parents": [Computed("n", "COUNT", "children")]}))


def test_nothing_is_overwritten_in_silence(spark):
    catalogue, tables = parent_child(spark, 4)
    with pytest.raises(PlanError, match="name a field"):
        migrate({**tables, "parents": tables["parents"].withColumn("Children", tables["parents"].id)}, catalogue)
    flags = Settings({"children.parents": "REFERENCE"}, patterns={"parents": [Outlier("children", 1), Outlier("children", 2, field="more")]})
    with pytest.raises(PlanError, match="flag"):
        migrate(tables, catalogue, flags)


def test_two_junctions_on_one_parent(spark):
    specs = [TableSpec("bands", "id"), TableSpec("gigs", "id"), TableSpec("tours", "id")]
    edges = [Edge(t, "band", "bands", "id", "MANY_TO_MANY") for t in ("gigs", "tours")]
    tables = {"bands": spark.range(2), "gigs": spark.range(3).selectExpr("id", "id % 2 AS band"), "tours": spark.range(1).selectExpr("id", "1L AS band")}
    with pytest.raises(PlanError, match="both be bands"):
        migrate(tables, Catalogue.of(specs, edges))
    named = [Edge(t, "band", "bands", "id", "MANY_TO_MANY", field=t) for t in ("gigs", "tours")]
    got = rows(migrate(tables, Catalogue.of(specs, named)).documents["bands"], "id")
    assert [[len(r["gigs"]), len(r["tours"])] for r in got] == [[2, 0], [1, 1]]


def test_cycle_is_broken_and_no_rows_are_lost(spark):
    catalogue = Catalogue.of(
        [TableSpec("a", "id"), TableSpec("b", "id")], [Edge("a", "b_id", "b", "id"), Edge("b", "a_id", "a", "id")]
    )
    tables = {"a": spark.sql("SELECT 1L id, 1L b_id"), "b": spark.sql("SELECT 1L id, 1L a_id")}
    moved = migrate(tables, catalogue)
    # the broken pair is looked up in both directions, so both tables stay datasets of their own
    assert moved.plan.written == ["a", "b"] and len(moved.plan.notes) == 1


def test_junction_payload_in_a_plan(spark):
    catalogue = Catalogue.of(
        [TableSpec("bands", "id"), TableSpec("halls", "id"), TableSpec("gigs", "id")],
        [Edge("gigs", "band", "bands", "id", "MANY_TO_MANY"), Edge("gigs", "hall", "halls", "id", "MANY_TO_MANY")],
    )
    tables = {
        "bands": spark.range(5, 7),
        "halls": spark.range(9, 10),
        "gigs": spark.sql("SELECT * FROM VALUES (3L,5L,9L,40.5D),(4L,6L,9L,0.0D) AS t(id,band,hall,fee)"),
    }
    moved = migrate(tables, catalogue)
    assert rows(moved.documents["bands"], "id")[0]["bands"] == [{"id": 3, "fee": 40.5}]
    assert rows(moved.documents["halls"])[0]["halls"] == [{"id": 3, "fee": 40.5}, {"id": 4, "fee": 0.0}]
    assert moved.plan.written == ["bands", "halls"]


def test_child_patterns_show_in_the_nest_and_totals_read_raw_rows(spark):
    from docnest import Approximation, Attribute, Subset

    catalogue, tables = parent_child(spark, 4)
    settings = Settings(
        patterns={
            "children": [Approximation({"v": 100})],
            "parents": [Computed("total", "SUM", "children", "v"), Computed("n", "COUNT", "children")],
        }
    )
    got = rows(migrate(tables, catalogue, settings).documents["parents"], "id")
    assert [[c["v"] for c in r["children"]] for r in got] == [[0, 0], [0, 0], []]
    assert [(r["total"], r["n"]) for r in got] == [(20, 2), (40, 2), (0, 0)]

    swallowed = Settings(patterns={"parents": [Attribute("ids", {"id": "ID"}), Computed("n", "COUNT", "children")]})
    got = rows(migrate(tables, catalogue, swallowed).documents["parents"])
    assert {r["n"] for r in got} == {0} and sorted(len(r["children"]) for r in got) == [0, 2, 2]

    lost_key = Settings(patterns={"children": [Attribute("keys", {"p_id": "P"})]})
    got = rows(migrate(tables, catalogue, lost_key).documents["parents"])
    assert all(r["children"] == [] for r in got)
    with pytest.raises(PlanError):
        migrate(tables, catalogue, Settings(patterns={"parents": [Subset("children", -1)]}))


def test_custom_pattern_runs_after_the_others(spark):
    register_pattern("shout", lambda df, ctx, column: df.withColumn(column, df[column] * 2))
    catalogue, tables = parent_child(spark, 4)
    settings = Settings(patterns={"parents": [Custom("shout", {"column": "n"}), Computed("n", "COUNT", "children")]})
    assert [r["n"] for r in rows(migrate(tables, catalogue, settings).documents["parents"], "id")] == [4, 4, 0]
    with pytest.raises(PlanError):
        migrate(tables, catalogue, Settings(patterns={"parents": [Custom("nobody")]}))


def test_relationship_map_shows_resolved_strategies(spark, moved):
    found = {(r["child"], r["parent"]): r for r in rows(relationship_map(moved.raw, moved.plan))}
    assert found["ships", "ships"]["strategy"] == "REFERENCE" and found["ships", "berths"]["strategy"] == "EMBED"
    assert found["papers", "ships"]["declared"] == "ONE_TO_ONE" and found["signals", "ships"]["max_children"] == 5
