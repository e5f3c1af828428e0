import inspect

import pytest

import __spark_entry__
import corpus_pipeline
from quillspark.llm import decontaminate, entries, quality, secrets, shared, simhash

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(entries.oracle_sql()))
def test_oracle(spark, compare, name):
    a, b, names, want = compare(spark, SF, entries.queries()[name], entries.oracle_sql()[name])
    assert names == want and a == b


@pytest.mark.parametrize("name, table", [(n, "pages" if n.startswith("op2") else "documents") for n in sorted(entries.queries()) if n.startswith("op")])
def test_whole_table(spark, name, table):
    n = entries.queries()[name](spark, SF).count()
    rows = spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert n == rows if not name.startswith("op3") else n <= rows


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()} == set(range(1, 11)) and "pipeline" in names


def test_leaks_found(spark):
    import duckdb

    con = duckdb.connect()
    want = set(con.sql(f"select d.doc_id, b.item_id from '{SF}/documents.parquet' d join '{SF}/benchmark.parquet' b on contains(d.text, b.text)").fetchall())
    got = {(r.doc_id, r.item_id) for r in decontaminate.op3_query(spark, SF).collect()}
    assert want <= got


def test_pipeline_stages(spark):
    docs = shared.table(spark, SF, "documents")
    counts, names = [docs.count()], docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert list(inspect.signature(stage).parameters) == ["spark", "docs", "sf_dir"]
        after = shared.written(stage(spark, docs, SF), "test")
        before = {r.doc_id: r.text for r in docs.collect()}
        if i + 1 < len(corpus_pipeline.STAGES):
            assert after.columns == names
        got = after.collect()
        if i == 0:
            model = quality.fit(docs, shared.table(spark, SF, "labels"))
            want = {r.doc_id for r in quality.score(docs, model).collect() if r.score >= quality.THRESHOLD}
            assert {r.doc_id for r in got} == want
        elif i == 1:
            assert {r.doc_id for r in got} == {r.component_id for r in simhash.near_duplicates(docs).collect()}
        elif i == 2:
            leaks = {r.doc_id for r in decontaminate.find(docs, shared.table(spark, SF, "benchmark")).collect()}
            assert {r.doc_id for r in got} == before.keys() - leaks
        elif i == 3:
            hit = {r.doc_id for r in secrets.scan(docs).where("size(_assign) + size(_access) + size(_hex) + size(_markov) > 0").collect()}
            assert {r.doc_id for r in got} == before.keys()
            assert {r.doc_id for r in got if r.text != before[r.doc_id]} == hit
        else:
            assert {r.doc_id for r in got} == before.keys()
        docs = after
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, docs.collect()))
