import pytest

from docnest import PlanError, embed_chunks, embed_junction, embed_levels, embed_many, embed_one
from tests.helpers import rows


def frame(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


def test_one_to_one(spark):
    employees = frame(spark, "id int, name string", (1, "Ada"), (2, "Bo"))
    details = frame(spark, "id int, employee_id int, code string", (9, 1, "b"), (8, 1, "a"), (7, None, "c"))
    for unique in (False, True):
        source = details.filter("id <> 9") if unique else details
        docs = embed_one(employees, source, pk="id", fk="employee_id", field="d", child_pk=["id"], proven_unique=unique)
        assert rows(docs, "id") == [
            {"id": 1, "name": "Ada", "d": {"id": 8, "code": "a"}}, {"id": 2, "name": "Bo", "d": None}
        ]


def test_one_to_many_orders_and_drops_the_key(spark):
    departments = frame(spark, "id int", (1,), (2,), (None,))
    employees = frame(spark, "name string, dep int, id int", ("c", 1, 3), ("a", 1, 1), ("x", None, 4), ("y", 8, 5), ("b", 1, 2))
    docs = embed_many(departments, employees, pk="id", fk="dep", field="employees", child_pk=["id"])
    found = {r["id"]: r["employees"] for r in rows(docs)}
    assert found == {1: [{"name": "a", "id": 1}, {"name": "b", "id": 2}, {"name": "c", "id": 3}], 2: [], None: []}


def test_equal_keys_order_by_the_rest(spark):
    parent = frame(spark, "id int", (1,))
    child = frame(spark, "p int, k int, v string", (1, 1, "b"), (1, 1, "a"), (1, 0, "z"), (1, 1, "a"))
    docs = embed_many(parent, child, pk="id", fk="p", field="c", child_pk=["k"])
    assert [(c["k"], c["v"]) for c in rows(docs)[0]["c"]] == [(0, "z"), (1, "a"), (1, "a"), (1, "b")]


def test_children_with_variants_keep_key_order(spark):
    parent = frame(spark, "id int", (1,))
    child = frame(spark, "p int, k int, s string", (1, 3, "3"), (1, 1, '"x"'), (1, 2, "[2]"))
    child = child.selectExpr("p", "k", "parse_json(s) AS v")
    docs = embed_many(parent, child, pk="id", fk="p", field="c", child_pk=["k"])
    assert docs.selectExpr("to_json(c) AS j").first()["j"] == '[{"k":1,"v":"x"},{"k":2,"v":[2]},{"k":3,"v":3}]'


@pytest.mark.parametrize(
    ("parent_kind", "child_kind"),
    [("int", "bigint"), ("bigint", "int"), ("string", "int"), ("int", "string"), ("decimal(10,0)", "int"), ("double", "int")],
)
def test_keys_of_different_types_meet(spark, parent_kind, child_kind):
    parent = frame(spark, "id int", (1,), (2,)).selectExpr(f"CAST(id AS {parent_kind}) AS id")
    child = frame(spark, "k int, p int", (5, 1), (6, 3)).selectExpr("k", f"CAST(p AS {child_kind}) AS p")
    docs = embed_many(parent, child, pk="id", fk="p", field="c", child_pk=["k"])
    assert [len(r["c"]) for r in rows(docs, "id")] == [1, 0]
    assert docs.schema["id"].dataType == parent.schema["id"].dataType


def test_keys_meet_exactly(spark):
    def pairs(parent_kind, parents, child_kind, children):
        parent = spark.createDataFrame([(x,) for x in parents], "s string").selectExpr(f"CAST(s AS {parent_kind}) AS id")
        child = spark.createDataFrame([(x,) for x in children], "s string").selectExpr(f"CAST(s AS {child_kind}) AS p", "s AS k")
        return [len(r["c"]) for r in embed_many(parent, child, pk="id", fk="p", field="c").collect()]

    assert pairs("bigint", ["9007199254740992", "9007199254740993"], "double", ["9007199254740992"]) == [1, 0]
    assert pairs("double", ["1.5", "2"], "bigint", ["1", "2"]) == [0, 1]
    assert pairs("string", ["1", "2.5", "x"], "double", ["1.0", "2.50"]) == [1, 1, 0]
    assert pairs("decimal(9,2)", ["1.00", "2.50"], "string", ["1", "2.5"]) == [1, 1]


def test_text_keys_that_are_no_numbers_do_not_fail(spark):
    parent = frame(spark, "id int", (1,))
    child = frame(spark, "k int, p string", (5, "abc"), (6, "1"))
    docs = embed_many(parent, child, pk="id", fk="p", field="c", child_pk=["k"])
    assert rows(docs)[0]["c"] == [{"k": 6}]


def test_a_field_of_the_same_name_is_replaced_in_place(spark):
    parent = frame(spark, "C int, id int", (7, 1))
    child = frame(spark, "k int, p int", (5, 1))
    docs = embed_many(parent, child, pk="id", fk="p", field="c", child_pk=["k"])
    assert docs.columns == ["C", "id"] and rows(docs) == [{"C": [{"k": 5}], "id": 1}]


def test_column_names_with_dots(spark):
    parent = frame(spark, "id int", (1,)).withColumnRenamed("id", "the.id")
    child = frame(spark, "k int, p int", (5, 1)).withColumnsRenamed({"k": "a.k", "p": "the.p"})
    docs = embed_many(parent, child, pk="the.id", fk="the.p", field="c", child_pk=["a.k"])
    assert docs.first()["c"][0]["a.k"] == 5


def test_over_the_limit_is_an_error_and_chunks_take_any_number(spark):
    parent = frame(spark, "id int", (1,), (2,), (3,))
    child = frame(spark, "k int, p int", *[(k, 1) for k in range(7, 0, -1)], (8, 2), (9, 4), (10, None))
    with pytest.raises(PlanError, match="chunks"):
        embed_many(parent, child, pk="id", fk="p", field="c", max_children=6)
    assert embed_many(parent, child, pk="id", fk="p", field="c", max_children=7).schema == embed_many(parent, child, pk="id", fk="p", field="c", max_children=None).schema
    docs = embed_chunks(parent, child, pk="id", fk="p", field="c", child_pk=["k"], size=3)
    assert [(r["id"], r["chunk"], [c["k"] for c in r["c"]]) for r in rows(docs, "id", "chunk")] == [
        (1, 0, [1, 2, 3]), (1, 1, [4, 5, 6]), (1, 2, [7]), (2, 0, [8]), (3, 0, [])
    ]
    assert embed_chunks(parent, child.limit(0), pk="id", fk="p", field="c", child_pk=["k"], size=3).schema == docs.schema
    with pytest.raises(PlanError, match="chunk_field"):
        embed_chunks(parent.withColumn("Chunk", parent.id), child, pk="id", fk="p", field="c")


@pytest.mark.parametrize("max_bytes", [None, 40, 400])
def test_a_hot_key_changes_no_chunk(spark, monkeypatch, max_bytes):
    from docnest.operators import grouping

    child = spark.range(400).selectExpr("IF(id % 7 = 0, 5, id) AS k", "IF(id % 3 = 0, id % 20, 1) AS p", "repeat('x', CAST(id % 11 * 7 AS INT)) AS t").repartition(5)
    parent = spark.range(25)
    nest = lambda: rows(embed_chunks(parent, child, pk="id", fk="p", field="c", child_pk=["k"], size=4, max_bytes=max_bytes), "id", "chunk")
    narrow = nest()
    monkeypatch.setattr(grouping, "HOT_KEY_ROWS", 50)
    monkeypatch.setattr(grouping, "SALT_CHUNKS", 3)
    assert nest() == narrow
    by_parent = {}
    for r in narrow:
        by_parent.setdefault(r["id"], []).append(r)
    assert sum(len(r["c"]) for r in narrow) == 400 and len(by_parent) == 25
    for docs in by_parent.values():
        assert [r["chunk"] for r in docs] == list(range(len(docs)))
        order = [(c["k"], c["t"]) for r in docs for c in r["c"]]
        assert order == sorted(order)
    assert max(len(r["c"]) for r in narrow) == (2 if max_bytes == 40 else 4)


def test_chunks_stay_within_bytes(spark):
    import json

    child = spark.range(500).selectExpr("id AS k", "id % 3 AS p", "repeat('é', CAST(pmod(id * 37, 90) AS INT)) AS t")
    docs = rows(embed_chunks(spark.range(4), child, pk="id", fk="p", field="c", child_pk=["k"], size=1000, max_bytes=300), "id", "chunk")
    size = lambda d: len(json.dumps(d, ensure_ascii=False, separators=(",", ":")).encode())
    assert all(sum(map(size, r["c"])) <= 300 or len(r["c"]) == 1 for r in docs)
    assert any(len(r["c"]) > 1 for r in docs) and [c["k"] for r in docs if r["id"] == 1 for c in r["c"]] == list(range(1, 500, 3))
    with pytest.raises(PlanError, match="one byte"):
        embed_chunks(spark.range(4), child, pk="id", fk="p", field="c", max_bytes=0)


def test_inner_rows_are_in_a_document_once(spark):
    top, middle = frame(spark, "id int", (1,), (2,)), frame(spark, "id int, t int", (1, 1), (2, 1), (3, 1), (4, 2))
    low = spark.range(60).selectExpr("CAST(id AS INT) AS id", "CAST(id % 2 + 1 AS INT) AS m")
    chain = [(low, "low", ["id"]), (middle, "middle", ["id"]), (top, "top", ["id"])], [("m", "id"), ("t", "id")]
    found = rows(embed_levels(*chain, chunk=5), "id", "chunk")
    for r in found:
        inner = [m["id"] for m in r["middle"]]
        assert len(inner) == len(set(inner)) and inner == sorted(inner)
    first = [m["id"] for r in found for m in r["middle"] if m["chunk"] == 0]
    assert first == [1, 2, 3, 4] and {r["id"]: r["chunk"] for r in found} == {1: 2, 2: 0}
    assert [x["id"] for r in found for m in r["middle"] if m["id"] == 2 for x in m["low"]] == list(range(1, 60, 2))
    small = rows(embed_levels(*chain, chunk=100, max_bytes=90), "id", "chunk")
    assert [x["id"] for r in small for m in r["middle"] if m["id"] == 1 for x in m["low"]] == list(range(0, 60, 2))


def test_a_chain_is_bounded_as_a_whole(spark):
    top, middle = frame(spark, "id int", (1,)), frame(spark, "id int, t int", (1, 1), (2, 1))
    low = frame(spark, "id int, m int", (1, 1), (2, 1), (3, 2), (4, 2))
    chain = [(low, "low", ["id"]), (middle, "middle", ["id"]), (top, "top", ["id"])], [("m", "id"), ("t", "id")]
    with pytest.raises(PlanError, match="6 rows"):
        embed_levels(*chain, max_children=5)
    assert rows(embed_levels(*chain, max_children=6))[0]["middle"][0]["low"] == [{"id": 1}, {"id": 2}]
    found = rows(embed_levels(*chain, chunk=1), "chunk")
    assert [(r["chunk"], r["middle"][0]["id"], r["middle"][0]["low"][0]["id"]) for r in found] == [(0, 1, 1), (1, 1, 2), (2, 2, 3), (3, 2, 4)]


def test_junctions(spark):
    cook = frame(spark, "id int", (1,), (2,))
    pure = frame(spark, "cook int, dish int", (1, 42), (1, 41))
    keys = {"pk": "id", "fk": "cook", "other_fks": ["dish"], "field": "s", "child_pk": ["cook", "dish"]}
    assert [r["s"] for r in rows(embed_junction(cook, pure, **keys), "id")] == [[{"dish": 41}, {"dish": 42}], []]
    salted = frame(spark, "cook int, dish int, salt int", (1, 42, 4), (1, 41, 5))
    assert [r["s"] for r in rows(embed_junction(cook, salted, **keys), "id")] == [[{"salt": 5}, {"salt": 4}], []]
    assert [r["s"] for r in rows(embed_junction(cook, salted, chunk=1, **keys), "id", "chunk")] == [[{"salt": 5}], [{"salt": 4}], []]


def test_levels(spark):
    top, middle = frame(spark, "id int", (1,)), frame(spark, "id int, t int", (1, 1), (2, 1))
    low = frame(spark, "id int, m int", (1, 2), (2, 2))
    docs = embed_levels([(low, "low", ["id"]), (middle, "middle", ["id"]), (top, "top", ["id"])], [("m", "id"), ("t", "id")])
    assert rows(docs) == [{"id": 1, "middle": [{"id": 1, "low": []}, {"id": 2, "low": [{"id": 1}, {"id": 2}]}]}]
    with pytest.raises(PlanError):
        embed_levels([(low, "low", [])], [("m", "id")])


def test_self_lookup(spark):
    staff = frame(spark, "id int, boss int", (1, None), (2, 1), (3, 1))
    docs = embed_many(staff, staff, pk="id", fk="boss", field="team", child_pk=["id"])
    assert [[c["id"] for c in r["team"]] for r in rows(docs, "id")] == [[2, 3], [], []]


def test_nothing_left_to_nest(spark):
    with pytest.raises(PlanError):
        embed_many(frame(spark, "id int", (1,)), frame(spark, "p int", (1,)), pk="id", fk="p", field="c")
