"""Hard negatives (operator 12) against all pairs, on vectors with ties, copies, nulls and odd values."""

import math
import random

import numpy as np
import pytest

from bidweave.llm import negatives as N

SCHEMA = "vec_id long, embedding array<float>, label int, row string, score int, part int"


def brute(rows, every=100, positives=5, negatives=10, low=30, high=90):
    items = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        v = [math.floor(256 * float(np.float32(x))) for x in vector]
        items.append((vec_id, (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label, v))
    out = []
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    for i, (anchor, label, q) in enumerate(items):
        if anchor is None or anchor % every:
            continue
        scored = [(sum(a * b for a, b in zip(q, v)), vec_id, other) for j, (vec_id, other, v) in enumerate(items) if j != i]
        for p, p_id, _ in sorted((s for s in scored if s[2] == label), key=order)[:positives]:
            hit = sorted((s for s in scored if s[2] != label and low * p <= 100 * s[0] <= high * p), key=order)[:negatives]
            out += [(anchor, p_id, k, n_id, p, n) for k, (n, n_id, _) in enumerate(hit, 1)]
    return sorted(out, key=repr)


def vectors(seed, n=700, dim=6):
    rng = random.Random(seed)
    rows = [(k, [rng.choice([rng.gauss(0, 1), 0.0, 0.25, -0.5]) for _ in range(dim)], rng.randrange(4)) for k in range(n)]
    same = rows[11][1]
    rows += [(1000 + k, same, k % 3) for k in range(150)]  # one vector that many rows hold
    rows += [(2000, None, 1), (2100, [1.0] * dim, None), (2200, [float("nan")] + [1.0] * (dim - 1), 1), (2300, [float("inf")] * dim, 2), (2400, [None] * dim, 3)]
    rows += [(None, [0.5] * dim, 1), (None, same, 2), (300, rows[300][1], rows[300][2]), (300, rows[300][1], rows[300][2]), (2500, [0.0] * dim, 1)]
    rows += [(2600, [1.0, 1.0], 1), (2700, [], 2), (-100, [0.3] * dim, 0), (-7, [0.3] * dim, -3), (2800, [60000.0] * dim, 3), (2801, [1e30] * dim, 3)]
    rng.shuffle(rows)
    return rows


def clamped(rows):
    top = 2.0**24 / 256
    return [(i, v and [x if x is None or not math.isfinite(x) else max(-top, min(top, x)) for x in v], label) for i, v, label in rows]


@pytest.mark.parametrize("blocks,parts,seed", [(64, 3, 1), (10_000, 10_000, 2), (200, 4, 3)])
def test_against_all_pairs(spark, blocks, parts, seed):
    rows = vectors(seed)
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in N.hard_negatives(frame, block_rows=blocks, part_anchors=parts).collect()), key=repr)
    assert got == brute(clamped(rows)) and len(got) > 100


def test_empty_tables(spark):
    assert N.hard_negatives(spark.createDataFrame([], SCHEMA)).collect() == []
    assert N.hard_negatives(spark.createDataFrame([(100, None, 1, "", 1, 1), (200, [1.0], 1, "", 1, 1)], SCHEMA)).collect() == []


def test_search_stops_early_and_loses_nothing():
    rng = np.random.default_rng(1)
    vectors = np.floor(rng.gamma(0.3, 100, (4000, 4)))
    lists, scored = N.SortedLists(vectors), []
    for query in np.floor(rng.normal(0, 50, (20, 4))):
        (found, _), n = lists.search(query, np.ones(4000, bool), [(-math.inf, math.inf)], 10)[0][0], lists.search(query, np.ones(4000, bool), [(-math.inf, math.inf)], 10)[1]
        scores = vectors @ query
        kth = np.sort(scores)[-10]
        assert set(np.flatnonzero(scores >= kth)) <= set(found)
        scored.append(n)
    assert np.mean(scored) < 2000
