"""Every pipeline stage and the whole pipeline on nulls, empty and long texts, ties, repeats, clashing columns and an empty table."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import decontaminate, mixing, quality, secrets, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, digest long, key string, _id long"


def rows_of(rng):
    words = "river stone cloud light wind harbour meadow lantern copper signal winter garden".split()
    prose = lambda k: " ".join(rng.choice(words) + rng.choice(("", "", ",", ".")) for _ in range(k)).capitalize() + "."
    junk = lambda k: " ".join(rng.choice(("BUY", "NOW", "WIN")) + rng.choice(("!!", "$$$", "***")) for _ in range(k))
    leak = "The capital of the old river country was moved twelve times before the copper bridge was built over it."
    rows = [(i, prose(rng.randint(30, 90)) if i % 4 else junk(50)) for i in range(400)]
    rows += [(500 + i, rows[1][1]) for i in range(5)] + [(600, leak), (601, prose(40) + " " + leak), (602, prose(40) + " token=abcdEFGH12345678 end."), (603, prose(12000))]
    rows += [(700, prose(50)), (700, prose(50)), (None, prose(50)), (None, prose(50)), (None, None), (701, None), (702, ""), (703, " \n\t"), (1, rows[1][1])]
    rng.shuffle(rows)
    return rows, leak


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows, leak = rows_of(random.Random(31))
    made = {}
    for name, some in (("full", rows), ("empty", [])):
        path = str(tmp_path_factory.mktemp(name))
        docs = spark.createDataFrame([(i, t, "en" if n % 3 else None, ("a", "b", None)[n % 3], None if t is None else len(t), 0.5, n, "k", n) for n, (i, t) in enumerate(some)], SCHEMA)
        docs.write.parquet(path + "/documents.parquet")
        labels = [(i, int(bool(i % 4)), 0) for i in range(400)] + [(3, 1, 0), (None, 1, 0), (5, None, None)] if some else []
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(path + "/labels.parquet")
        spark.createDataFrame([(1, leak), (2, leak), (3, None), (None, "")] if some else [], "item_id long, text string").write.parquet(path + "/benchmark.parquet")
        made[name] = path
    return made


def bag(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages(spark, tables):
    path = tables["full"]
    docs = spark.read.parquet(path + "/documents.parquet")
    labels, benchmark = spark.read.parquet(path + "/labels.parquet"), spark.read.parquet(path + "/benchmark.parquet")
    before = docs.collect()
    stages = [f for _, f in corpus_pipeline.STAGES]
    good = stages[0](spark, docs, path)
    model = quality.fit(docs, labels)
    at = model.scores(np.array([quality.statistics((r.text or "").encode()) for r in before])) >= quality.THRESHOLD
    assert good.columns == docs.columns and bag(good) == sorted((tuple(r) for r, ok in zip(before, at) if ok), key=repr)
    prose = [r for r in before if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 4]
    assert {r.doc_id for r in prose} <= {r.doc_id for r in good.collect()}, "clean documents stay"
    one = stages[1](spark, docs, path)
    roots = {}
    for r in before:
        roots.setdefault(simhash.fingerprint((r.text or "").encode()), []).append(r)
    assert one.columns == docs.columns and bag(one) == bag(stages[1](spark, docs.repartition(5), path))
    kept = {tuple(r) for r in one.collect()}
    assert kept <= {tuple(r) for r in before} and all(sum(tuple(r) in kept for r in same) <= 1 for same in roots.values())
    assert sum(r.text is not None and r.doc_id is None for r in one.collect()) == 2
    clean = stages[2](spark, docs, path)
    leaks = [r for r in before if decontaminate.brute_force(r.text, benchmark.where("item_id = 1").first().text) >= decontaminate.COVER]
    assert {r.doc_id for r in leaks} == {600, 601} and clean.columns == docs.columns
    assert bag(clean) == sorted((tuple(r) for r in before if r not in leaks), key=repr)
    safe = stages[3](spark, docs, path)
    assert safe.columns == docs.columns and safe.count() == len(before)
    changed = {r.doc_id: r.text for r in safe.collect()}
    assert changed[602].endswith(" <SECRET> end.") and changed[701] is None and changed[702] == ""
    assert bag(safe.where("NOT doc_id <=> 602")) == sorted((tuple(r) for r in before if r.doc_id != 602), key=repr)
    mixed = stages[4](spark, docs, path)
    assert mixed.count() == len(before) and bag(mixed) == bag(stages[4](spark, docs.repartition(3), path))
    assert all(0 <= r.taken <= 2 * r.size for r in mixed.collect())
    assert {r.size for r in mixed.collect() if r.doc_id in (701, 702, 703)} == {0}


def test_whole_pipeline_by_hand(spark, tables):
    """run() against the operators applied one after the other to rows in memory."""
    path = tables["full"]
    docs, labels = spark.read.parquet(path + "/documents.parquet"), spark.read.parquet(path + "/labels.parquet")
    item = spark.read.parquet(path + "/benchmark.parquet").where("item_id = 1").first().text
    model = quality.fit(docs, labels)
    rows = [r for r in docs.collect() if model.scores(np.array([quality.statistics((r.text or "").encode())]))[0] >= quality.THRESHOLD]
    fp = [simhash.fingerprint((r.text or "").encode()) for r in rows]
    label = list(range(len(rows)))
    for _ in range(8):
        for i in range(len(rows)):
            for j in range(i):
                if (fp[i] ^ fp[j]).bit_count() <= 3:
                    label[i] = label[j] = min(label[i], label[j])
    groups = {}
    for r, x in zip(rows, label):
        groups.setdefault(x, []).append(r)
    least = {(min((r.doc_id is None, r.doc_id or 0) for r in g)) for g in groups.values()}
    result = corpus_pipeline.run(spark, path).collect()
    first = [min(g, key=lambda r: (r.doc_id is None, r.doc_id or 0)) for g in groups.values()]
    hidden = [r for r in first if decontaminate.brute_force(r.text, item) >= decontaminate.COVER]
    assert len(result) == len(groups) - len(hidden)
    assert {(r.doc_id is None, r.doc_id or 0) for r in result} <= least
    assert {r.source_size for r in result} == {sum(r.size for r in result if r.source == s) for s in ("a", "b", None)}


def test_empty_tables(spark, tables):
    docs = spark.read.parquet(tables["empty"] + "/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, tables["empty"])
        assert out.count() == 0 and (i == 4 or out.columns == docs.columns)
    assert corpus_pipeline.run(spark, tables["empty"]).count() == 0
    assert secrets.scan(docs).where(F.size("_assign") > 0).count() == 0 and mixing.mix(docs).count() == 0
