"""The quality classifier (operator 3) against a version without partial sums: statistics in plain Python, one ridge solution
over all rows, and isotonic levels by their minimax form."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa

from bidweave.llm import rffquality as Q

from .conftest import sentence, words


def brute_features(text):
    raw = (text or "").encode()
    sets = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\t\n\x0b\x0c\r", ".,;:?'\"()-"]
    kind = lambda b: next((i for i, s in enumerate(sets) if chr(b) in s), 6) if b < 128 else 7
    counts = [0] * 8
    for b in raw:
        counts[kind(b)] += 1
    w = [x.encode() for x in words(text)]
    some = max(len(w), 1)
    distinct = sum(len(set(w[i:i + Q.WINDOW])) for i in range(0, len(w), Q.WINDOW))
    return [*(c / max(len(raw), 1) for c in counts), math.log1p(len(raw)), math.log1p(len(w)), sum(map(len, w)) / some,
            math.log1p(max(map(len, w), default=0)), sum(a == b for a, b in zip(w, w[1:])) / some, distinct / some,
            sum(len(x) <= 3 for x in w) / some, sum(kind(x[-1]) in (2, 6) for x in w) / some, math.log1p(len(raw) / (1 + counts[4]))]


def test_statistics_equal_plain_python(rows_):
    texts = [r[1] for r in rows_ if r[1] is None or len(r[1]) < 20_000] + ["a a a a", "A1 $$ x$ 9", "é É \t\n\n b."]
    assert np.allclose(Q.features(pa.array(texts)), [brute_features(t) for t in texts])


def test_model_equals_one_solution_over_all_rows(spark):
    rng = random.Random(2)
    rows = [(i, sentence(rng, rng.randrange(5, 120)) if i % 3 else " ".join(["BUY!!", sentence(rng, 6).upper()] * rng.randrange(2, 9))) for i in range(400)]
    marks = {i: float(i % 3 > 0) if rng.random() > 0.05 else float(i % 3 == 0) for i, _ in rows if i % 7}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, int(y)) for i, y in marks.items()], "doc_id long, quality int")
    model = Q.fit(Q.text_features(docs), labels, components=40)

    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    known = [(i, t) for i, t in rows if i in marks and fold(i)]
    stats, y = np.array([brute_features(t) for _, t in known]), np.array([marks[i] for i, _ in known])
    folds = np.array([fold(i) for i, _ in known])
    assert np.allclose(model.mean, stats.mean(0)) and np.allclose(model.scale, np.maximum(stats.std(0), 1e-6))
    x = np.clip((stats - stats.mean(0)) / np.maximum(stats.std(0), 1e-6), -8, 8)
    z = np.hstack([np.sqrt(2 / 40) * np.cos(x @ model.directions + model.phases), np.ones((len(x), 1))])
    # the features stand for a Gaussian kernel: the mean of many products comes near it
    wide = np.random.default_rng(0)
    d, p = wide.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], 40_000)), wide.uniform(0, 2 * np.pi, 40_000)
    inner = Q.cosines(x[:5], d, p)[:, :-1] @ Q.cosines(x[:5], d, p)[:, :-1].T
    gauss = np.exp(-((x[:5, None] - x[None, :5]) ** 2).sum(-1) / (2 * x.shape[1]))
    assert np.abs(inner - gauss).max() < 0.05

    penalty = np.diag([1e-2] * 40 + [1e-6])
    ridge = lambda m: np.linalg.solve(z[m].T @ z[m] + penalty, z[m].T @ y[m])
    assert np.allclose(model.weights, ridge(np.ones(len(y), bool)), atol=1e-6)
    raw = np.array([z[i] @ ridge(folds != folds[i]) for i in range(len(y))])
    cells = np.floor(np.clip(raw, -1, 2) * Q.GRID / 3).astype(int)
    places = np.unique(cells)
    total, count = (np.array([f(cells == c) for c in places]) for f in (lambda m: y[m].sum(), lambda m: m.sum()))
    mean = lambda a, b: total[a:b + 1].sum() / count[a:b + 1].sum()
    level = np.array([max(min(mean(j, k) for k in range(i, len(places))) for j in range(i + 1)) for i in range(len(places))])
    pool = np.searchsorted(model.levels, level - 1e-9)
    assert np.allclose(model.levels[pool], level) and (np.diff(model.levels) > 0).all()
    centres = np.array([((places + 0.5) * 3 / Q.GRID * count)[pool == i].sum() / count[pool == i].sum() for i in range(len(model.levels))])
    assert np.allclose(model.steps, centres)

    got = {r["doc_id"]: r["score"] for r in Q.score(Q.text_features(docs), model).collect()}
    for i, t in rows[:60]:
        v = np.clip((np.array(brute_features(t)) - model.mean) / model.scale, -8, 8)
        raw = np.append(np.sqrt(2 / 40) * np.cos(v @ model.directions + model.phases), 1) @ model.weights
        assert abs(got[i] - np.interp(raw, centres, model.levels)) < 1e-6
