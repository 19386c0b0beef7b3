"""Registered queries against their SQL twins, and the pipeline stage by stage."""

import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import corpus_pipeline  # noqa: E402
from bidweave.llm.queries import QUERIES, SQL  # noqa: E402
from compare import check, connect  # noqa: E402

from .conftest import words  # noqa: E402
from .test_operators import brute_components  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    ok, note = check(spark, connect(FOLDER), QUERIES[name], SQL[name], FOLDER)
    assert ok, note


def test_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_on_odd_rows(spark, docs, rows_, empty):
    """Null keys and texts, very long texts, ties, copies, columns named like helpers and columns of maps, through all stages."""
    from pyspark.sql import functions as F
    clash = {c: F.col("n_chars") for c in ["__size", "__source", "__copies", "__order", "__row", "__hash", "__all", "tie", "words", "row", "block"]}
    odd = docs.withColumns({**clash, "tags": F.create_map(F.lit("k"), "lang"), "nested": F.struct(F.array(F.create_map(F.lit(1), "source")).alias("m"))})
    frame, sizes = odd, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, FOLDER).cache()
        sizes.append(out.count())
        if k < 4:
            assert out.columns == odd.columns
            frame = out
    assert 0 < sizes[2] <= sizes[1] <= sizes[0] <= len(rows_) and sizes[4] >= sizes[3] > 0
    assert frame.filter("doc_id is null").count() <= 4 and frame.select(F.max("n_chars")).first()[0] > 500_000
    again = corpus_pipeline.mixed_sources(spark, corpus_pipeline.without_near_copies(spark, corpus_pipeline.without_copies(
        spark, corpus_pipeline.good_documents(spark, odd.repartition(3), FOLDER), FOLDER), FOLDER), FOLDER)
    key = ["doc_id", "text"]
    assert sorted(map(str, again.select(*key).collect())) == sorted(map(str, frame.select(*key).collect()))  # also among rows without an id
    none = empty
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        none = stage(spark, none, FOLDER)
        assert none.count() == 0


def test_pipeline(spark):
    """Every stage acts on what the one before kept."""
    import re
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, seen = docs.columns, [docs.toPandas()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, FOLDER)
        assert k == 4 or out.columns == columns
        docs = out.cache()
        seen.append(docs.toPandas())
    start, good, single, apart, mixed, packed = seen
    scores = {r["doc_id"]: r["predicted"] for r in QUERIES["op3_quality_scores"](spark, FOLDER).collect()}
    assert set(good.doc_id) == {d for d, p in scores.items() if p} and 0.7 * len(start) < len(good) < len(start)
    clean = {}
    for doc_id, text in sorted(zip(good.doc_id, good.text)):
        clean.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text), doc_id)
    assert sorted(single.doc_id) == sorted(clean.values())
    rows = sorted(zip(single.doc_id.tolist(), single.text))
    first = {}
    for (doc_id, _), group, found in zip(rows, *reversed(brute_components(rows, 5, 80))):
        first.setdefault(group if found else ("empty", doc_id), doc_id)
    assert sorted(apart.doc_id) == sorted(first.values())
    total = sum(len(words(t)) for t in apart.text)
    assert set(mixed.doc_id) <= set(apart.doc_id) and max(Counter(mixed.doc_id).values()) <= 2
    assert sum(len(words(t)) for t in mixed.text) == pytest.approx(1.5 * total, rel=0.02)
    ends = packed[packed.start + packed.length == packed.doc_tokens]
    assert Counter(ends.doc_id) == Counter(mixed.doc_id)
    assert corpus_pipeline.run(spark, FOLDER).count() == len(packed)
