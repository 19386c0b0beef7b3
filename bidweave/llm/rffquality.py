"""Quality scores from random Fourier features (operator 3).

Statistics of the whole text (character classes, word shapes, repetition) are standardised and mapped
to random cosine features, whose inner products approximate a Gaussian kernel. Ridge regression on
them needs only the sums Z'Z and Z'y, so each partition adds up its own rows and the model is
solved from the few partial sums. Sums are kept per fold: leaving one fold out gives scores
of rows that the weights have not seen, and an isotonic fit of the labels on those scores
calibrates the result to 0 to 1.

All labelled rows outside the held-out part are learned from; there is no sample.

Defined results: null and empty texts have statistics 0 and get a score like any other text. Labels that
are null or without document are ignored, several labels of one doc_id count as their mean. A null
doc_id is not held out and never learned from. Without any label every score is 0.5. Repeated
rows are scored each for itself. Other columns are ignored, or kept by keep_good.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidweave.llm import words as W
from bidweave.llm.common import stored

FOLDS = 5  # fold 0 is held out
WINDOW = 64  # words in which repetition is measured
GRID = 4096  # steps of the raw score for calibration
SUMS = 16  # tasks that add up the normal equations

_CLASSES = np.full(256, 7, np.int64)  # 7: bytes of letters beyond ASCII
_CLASSES[:128] = 6  # other ASCII signs
for _i, _chars in enumerate(["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\t\n\x0b\x0c\r", ".,;:?'\"()-"]):
    _CLASSES[[ord(c) for c in _chars]] = _i
FEATURES = ["lower", "upper", "digits", "blanks", "breaks", "stops", "signs", "beyond", "log_bytes", "log_words", "word_length",
            "longest_word", "repeats_last", "variety", "short_words", "sign_ends", "line_length"]


def features(column: pa.Array) -> np.ndarray:
    """One row of statistics per text. Texts are read a slice and a segment at a time."""
    data, offsets = W.utf8(column)
    out = np.zeros((len(offsets) - 1, len(FEATURES)))
    for first, last in W.slices(offsets):
        edges = offsets[first:last + 1] - offsets[first]
        part = data[offsets[first]:offsets[last]]
        n = last - first
        kinds = np.zeros((n, 8))
        for low in range(0, len(part), W.SEGMENT):
            high = min(low + W.SEGMENT, len(part))
            row = np.searchsorted(edges, np.arange(low, high), "right") - 1
            kinds += np.bincount(row * 8 + _CLASSES[part[low:high]], minlength=n * 8).reshape(n, 8)
        starts, ends, hashes = W.words(part, edges)
        owner = np.searchsorted(edges, starts, "right") - 1
        per_row = lambda mask: np.bincount(owner[mask], minlength=n).astype(float)
        size = (edges[1:] - edges[:-1]).astype(float)
        words = np.bincount(owner, minlength=n).astype(float)
        some, bytes_ = np.maximum(words, 1), np.maximum(size, 1)
        length = ends - starts
        longest = np.zeros(n)
        np.maximum.at(longest, owner, length)
        same = np.zeros(len(hashes), bool)
        same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
        begin = np.searchsorted(starts, edges[:-1])
        window = (np.arange(len(hashes)) - begin[owner]) // WINDOW
        # distinct words of each window of a text: sort by (text, window, word) and count the changes
        place = owner * (len(hashes) // WINDOW + 2) + window
        order = np.lexsort((hashes, place))
        fresh = np.ones(len(hashes), bool)
        fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (place[order][1:] != place[order][:-1])
        distinct = np.bincount(owner[order][fresh], minlength=n)
        last_kind = _CLASSES[part[ends - 1]] if len(ends) else ends
        f = out[first:last]
        f[:, :8] = kinds / bytes_[:, None]
        f[:, 8], f[:, 9] = np.log1p(size), np.log1p(words)
        f[:, 10], f[:, 11] = np.bincount(owner, length, n) / some, np.log1p(longest)
        f[:, 12], f[:, 13], f[:, 14] = per_row(same) / some, distinct / some, per_row(length <= 3) / some
        f[:, 15] = per_row((last_kind == 6) | (last_kind == 2)) / some
        f[:, 16] = np.log1p(size / (1 + kinds[:, 4]))
    return out


@dataclass
class Model:
    """Weights of the scorer; plain arrays, small and of fixed size."""
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps: np.ndarray  # raw scores
    levels: np.ndarray  # calibrated values at the steps, rising

    def cosines(self, stats: np.ndarray) -> np.ndarray:
        return cosines((stats - self.mean) / self.scale, self.directions, self.phases)

    def score(self, stats: np.ndarray) -> np.ndarray:
        if len(self.levels) == 0:
            return np.full(len(stats), 0.5)
        return np.interp(self.cosines(stats) @ self.weights, self.steps, self.levels)


def cosines(x: np.ndarray, directions: np.ndarray, phases: np.ndarray) -> np.ndarray:
    z = np.sqrt(2.0 / len(phases)) * np.cos(np.clip(x, -8, 8) @ directions + phases)
    return np.hstack([z, np.ones((len(x), 1))])


def rising_fit(x: np.ndarray, total: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling adjacent violators: (centre, level) of each pool; x is sorted."""
    pools: list[list[float]] = []
    for place, t, c in zip(x, total, count):
        pools.append([place * c, t, c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            top = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], top)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS)).cast("int")


def text_features(docs: DataFrame) -> DataFrame:
    """(doc_id, stats): the statistics of every row."""
    def run(batches):
        for batch in batches:
            stats = features(batch.column(1))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, stats.size + 1, stats.shape[1]), pa.int32()), pa.array(stats.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), flat], names=["doc_id", "stats"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, stats array<double>")


def _matrix(column) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1) if len(column) else np.zeros((0, len(FEATURES)))


def fit(stats: DataFrame, labels: DataFrame, components: int = 192, ridge: float = 1e-2, width: float = 1.0, seed: int = 7) -> Model:
    """Model from (doc_id, stats) and (doc_id, quality)."""
    marks = (labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(F.col("quality").cast("double")).alias("y")))
    rows = stored(stats.join(marks, "doc_id").withColumn("fold", fold(F.col("doc_id"))).filter("fold <> 0"), "labelled")
    n = len(FEATURES)
    row = rows.agg(F.count("*").alias("n"), *[F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(n)],
                   *[F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(n)]).first()
    rng = np.random.default_rng(seed)
    directions = rng.normal(0, 1 / (width * np.sqrt(n)), (n, components))
    phases = rng.uniform(0, 2 * np.pi, components)
    none = np.zeros(0)
    if not row["n"]:
        return Model(np.zeros(n), np.ones(n), directions, phases, np.zeros(components + 1), none, none)
    mean = np.array([row[f"m{i}"] for i in range(n)])
    scale = np.maximum(np.array([row[f"s{i}"] for i in range(n)]), 1e-6)

    def add_up(batches):
        size = components + 1
        a, b = np.zeros((FOLDS, size, size)), np.zeros((FOLDS, size))
        for batch in batches:
            y, folds = np.asarray(batch.column(1)), np.asarray(batch.column(2))
            z = cosines((_matrix(batch.column(0)) - mean) / scale, directions, phases)
            for k in range(1, FOLDS):
                z_k = z[folds == k]
                a[k] += z_k.T @ z_k
                b[k] += z_k.T @ y[folds == k]
        for k in range(1, FOLDS):
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([a[k].ravel().tolist()], pa.list_(pa.float64())),
                                              pa.array([b[k].tolist()], pa.list_(pa.float64()))], names=["fold", "a", "b"])

    sums = rows.select("stats", "y", "fold").repartition(SUMS).mapInArrow(add_up, "fold long, a array<double>, b array<double>").toArrow()
    size = components + 1
    a, b = np.zeros((FOLDS, size, size)), np.zeros((FOLDS, size))
    for k, x, y in zip(sums["fold"].to_pylist(), sums["a"].to_pylist(), sums["b"].to_pylist()):
        a[k] += np.array(x).reshape(size, size)
        b[k] += np.array(y)
    total_a, total_b = a.sum(0), b.sum(0)
    penalty = ridge * np.eye(size)
    penalty[-1, -1] = 1e-6
    solve = lambda x, y: np.linalg.solve(x + penalty, y)
    weights = solve(total_a, total_b)
    unseen = np.array([solve(total_a - a[k], total_b - b[k]) for k in range(FOLDS)])

    def raw_scores(batches):
        for batch in batches:
            z = cosines((_matrix(batch.column(0)) - mean) / scale, directions, phases)
            raw = np.einsum("ij,ij->i", z, unseen[np.asarray(batch.column(2))])
            cell = np.floor(np.clip(raw, -1, 2) * GRID / 3).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column(1)], names=["cell", "y"])

    cells = (rows.select("stats", "y", "fold").mapInArrow(raw_scores, "cell long, y double")
             .groupBy("cell").agg(F.sum("y").alias("y"), F.count("*").alias("n")).toArrow().sort_by("cell"))  # GRID + 1 rows at most
    steps, levels = rising_fit((np.asarray(cells["cell"]) + 0.5) * 3 / GRID, np.asarray(cells["y"]), np.asarray(cells["n"]).astype(float))
    return Model(mean, scale, directions, phases, weights, steps, levels)


def score(stats: DataFrame, model: Model) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_matrix(batch.column(1))))], names=["doc_id", "score"])
    return stats.select("doc_id", "stats").mapInArrow(run, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Per row: (doc_id, held_out, score, predicted)."""
    stats = stored(text_features(docs), "stats")
    model = fit(stats, labels)
    return score(stats, model).select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score",
                                      (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that score `threshold` or more, with all their columns, without a shuffle of texts."""
    model = fit(stored(text_features(docs), "stats"), labels)
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            good = model.score(features(batch.column(place))) >= threshold
            yield batch.filter(pa.array(good))
    return docs.mapInArrow(run, docs.schema)
