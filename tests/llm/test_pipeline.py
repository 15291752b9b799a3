import os
import re

import pytest

import corpus_pipeline
from docnest.llm import mixing
from docnest.llm.oracle import ORACLE
from docnest.llm.queries import QUERIES
from tests.llm.test_neardup import brute, family
from tests.llm.texts import frame, odd_rows, prose
from workload.check import canonical_rows, connect

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables")


@pytest.fixture(scope="module")
def corpus(spark):
    clean = [(100 + i, prose(i, 80, 300, "abc"[i % 3]), "en", f"s{i % 4}", 0) for i in range(60)]
    secret = [(500, prose(900, 40, 300, "a") + ' token = "qX7t-9Lm2_vB4kRz" end', "en", "s1", 0)]
    digits = [(600, "12 34 56", "en", "s1", 0)]
    return odd_rows() + clean + secret + digits + family(1000, prose(77, 150, 300, "b"), 20, 0.01)


def test_stages(spark, corpus):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "secret_scan", "mixing", "packing"]
    docs = frame(spark, corpus)
    stages = dict(corpus_pipeline.STAGES)
    spoken = stages["language_id"](spark, docs, "").cache()
    kept = {r.doc_id for r in spoken.collect()}
    assert spoken.columns == docs.columns and not kept & {1, 2, 3, 600} and {100 + i for i in range(60)} | {500} <= kept
    rows = [tuple(r) for r in spoken.collect()]
    single = stages["near_dedup"](spark, spoken, "").cache()
    groups = {c for _, n, c, _ in brute(rows) if n}
    assert single.columns == docs.columns and {r.doc_id for r in single.collect()} == groups
    masked = stages["secret_scan"](spark, single, "").cache()
    text = masked.where("doc_id = 500").first()
    assert masked.count() == single.count() and "qX7t" not in text.text and text.n_chars == len(text.text)
    mix = stages["mixing"](spark, masked, "").cache()
    copies = {r.doc_id: r.copies for r in mixing.mix(masked).collect()}
    assert mix.columns == docs.columns and mix.count() == sum(copies.values())
    packed = stages["packing"](spark, mix, "")
    assert {r.doc_id for r in packed.collect()} == {d for d, n in copies.items() if n}


def test_stages_take_empty_tables_and_clashing_columns(spark):
    for rows, clashing in (([], False), (odd_rows(), True)):
        docs = frame(spark, rows, clashing)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "")
            assert name == "packing" or out.columns == docs.columns
            docs = out if name == "packing" else spark.createDataFrame(out.collect(), out.schema)


@needs_tables
def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
    want = sum(len(re.findall(r"\S", r.text)) > 0 for r in docs.collect())
    got = corpus_pipeline.run(spark, SF)
    assert got.where("start = 0").count() == want


@needs_tables
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    df = QUERIES[name](spark, SF)
    result = connect(SF).execute(ORACLE[name])
    assert canonical_rows(df.columns, [tuple(r) for r in df.collect()]) == canonical_rows([d[0] for d in result.description], result.fetchall())
