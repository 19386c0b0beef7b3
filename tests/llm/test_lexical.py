"""Ranked lexical search (operator 13) against scores of all documents, on odd texts, ties, nulls and repeated rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from bidweave.llm import lexical as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    docs = [(doc_id, Counter(terms(text)), len(terms(text))) for doc_id, text in docs]
    docs = [d for d in docs if d[2]]
    count, length, df = len(docs), sum(d[2] for d in docs), Counter(t for d in docs for t in d[1])
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, tf, n in docs:
            m = 100 - 75 + (75 * n * count) // length
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in terms(text) if t in tf)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        out += [(item_id, r, doc_id, -s) for r, (s, _, doc_id) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


def tables(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "é", "漢字", "ß", "x y", "KK"]
    word = lambda: vocabulary[min(int(rng.expovariate(0.02)), len(vocabulary) - 1)]
    text = lambda n: rng.choice([" ", "-", "\n", "_"]).join(rng.choice([str.upper, str])(word()) for _ in range(n))
    docs = [(rng.choice([i, i, None]), text(rng.choice([0, 1, 5, 40, 200]))) for i in range(300)]
    docs += [(1000 + k, docs[7][1]) for k in range(40)] + [(5, docs[5][1])] * 2 + [(2000, None), (2001, ""), (2002, "-- __ !"), (None, None)]
    docs += [(3000, " ".join(f"w{i % 290}" for i in range(300_000))), (3001, "w1" * 700_000), (3002, ("only " * 300_000) + "w5")]
    rng.shuffle(docs)
    items = [(i, text(rng.choice([1, 3, 30, 80]))) for i in range(30)] + [(40, None), (41, ""), (42, "unknownterm"), (None, text(20)), (43, "w1 w1 w1 W1"), (7, "w7 w9"), (7, "w7 w9"),
                                                                        (44, docs[3][1])]
    return docs, items


@pytest.mark.parametrize("seed,block,group", [(1, 1 << 16, 1 << 25), (2, 40, 1 << 25), (3, 90, 6000)])
def test_against_all_scores(spark, monkeypatch, seed, block, group):
    monkeypatch.setattr(L, "BLOCK_DOCS", block)
    docs, items = tables(seed)
    frame = spark.createDataFrame([(*d, "x", 1, 2) for d in docs], "doc_id long, text string, n string, ids int, row int").repartition(3)
    asked = spark.createDataFrame([(*i, "x", 1) for i in items], "item_id long, text string, term string, row int")
    got = sorted((tuple(r) for r in L.search(frame, asked, group_bytes=group).collect()), key=repr)
    assert got == brute(docs, items) and len(got) > 200


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert L.search(docs, items).collect() == [] and L.search(items.withColumnRenamed("item_id", "doc_id"), items.limit(0)).collect() == []


def test_parts_of_a_long_text(monkeypatch):
    monkeypatch.setattr(L, "_PART", 7)
    for text in ["", "a", "abc defghijklmnop q", "x" * 50, "é" * 9 + " A-b", "a b c d e f g h ", " " * 30]:
        assert [t.decode() for part in L.terms(text.encode()) for t in part] == terms(text)


def test_accumulators_stop_and_nothing_is_lost():
    rng = np.random.default_rng(4)
    n, made = 3000, 0
    sizes = rng.integers(3, 30, n)
    ids = np.concatenate([rng.choice(60, s, replace=False, p=(p := 1 / np.arange(1, 61)) / p.sum()) for s in sizes])
    tfs = rng.integers(1, 5, len(ids))
    df = np.bincount(ids, minlength=60)
    weights = np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)
    block = L.Block(np.arange(n), sizes.astype(np.int64), ids, tfs, sizes, weights, n, int(sizes.sum()))
    for _ in range(20):
        asked = sorted(((int(t), 1) for t in rng.choice(60, 8, replace=False)), key=lambda a: df[a[0]])
        whole = np.zeros(n, np.int64)
        for t, _times in asked:
            a, b = block.places[t]
            whole[block.docs[a:b]] += block.parts[a:b]
        hit, scores, accumulators = block.best(asked, 10)
        kth = np.sort(whole)[-10]
        assert set(np.flatnonzero(whole >= max(kth, 1))) == set(hit) and (whole[hit] == scores).all()
        made += accumulators / np.count_nonzero(whole)
    assert made / 20 < 0.95
