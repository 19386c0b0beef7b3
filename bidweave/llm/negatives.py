"""Hard negatives by Fagin's threshold algorithm (operator 12).

Vectors become integers, scores are integer inner products, so every comparison is exact. Rows are dealt into blocks of bounded
size. A block keeps one list of its rows per dimension, sorted by that component. An anchor reads the lists from the end that
its own sign prefers, all to the same depth; rows met for the first time are scored whole by random access. The threshold is
the score of a row that had the last value read in every list: no unread row scores higher. An anchor stops as soon as the
threshold lies strictly below the k-th score of each of its windows, or below their lower ends, so ties are never cut off.

Anchors are the query set: they meet the blocks on a grid of (block, part of the anchors), both of bounded size. A cell passes
on k rows per window, and the best k of all cells count. First the positives are found, then the windows that their scores open.

Defined results: rows with a null label, vector or component, or a component that is not finite, take no part. Every other row is
an item of its own, also if it repeats a vec_id: an anchor never meets its own row, but may meet another row of its id. A null
vec_id is never an anchor and comes last among equal scores. A shorter vector counts as filled up with zeros. Scaled components
end at 2**24 in size, so sums of up to 3000 dimensions are exact. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from bidweave.llm.common import stored
from bidweave.operators.keys import top_k

ROWS = 4096  # rows in a block
ANCHORS = 4096  # anchors in a part
FIRST = 16  # depth of the first step; every step doubles the depth
_LIMIT = 1 << 24
_LAST = np.iinfo(np.int64).max  # stands for a null vec_id
FOUND = pa.schema([("anchor", pa.int64()), ("place", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])


def items(vectors: DataFrame, scale: int, relabel: int, labels: int) -> DataFrame:
    """(row, vec_id, label, v): the rows that take part, components as integers; where `relabel` divides vec_id the label is the next one."""
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    whole = lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(_LIMIT))), F.lit(-float(_LIMIT)))).cast("int")
    label = F.when(F.col("vec_id") % relabel == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return vectors.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite).select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"),
        label.cast("long").alias("label"), F.transform("embedding", whole).alias("v"))


def matrix(column, dim: int) -> np.ndarray:
    """Rows of the lists, filled up with zeros to `dim`."""
    lengths = pc.list_value_length(column).to_numpy().astype(np.int64)
    values = pa.chunked_array([c.flatten() for c in column.chunks], pa.int32()).to_numpy()
    out = np.zeros((len(lengths), dim), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


class SortedLists:
    """Per dimension the rows of a block in ascending order of that component."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.order = np.argsort(vectors, axis=0, kind="stable").T
        self.values = np.take_along_axis(vectors.T, self.order, 1)

    def search(self, query: np.ndarray, eligible: np.ndarray, windows: list[tuple], k: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
        """Per window (low, high) the rows that may be among its k best, with their scores, and the number of rows scored.

        All rows of a window above its k-th score, and all that tie with it, are in the answer.
        """
        n = len(self.vectors)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        seen, scores = np.zeros(n, bool), np.zeros(n, query.dtype)
        depth, step = 0, FIRST
        best: list = [None] * len(windows)
        while True:
            to = min(n, depth + step) if len(up) + len(down) else n
            new = np.zeros(n, bool)
            new[self.order[up, n - to:n - depth]] = True
            new[self.order[down, depth:to]] = True
            if to == n:
                new[:] = True
            new = np.flatnonzero(new & ~seen)
            scores[new] = self.vectors[new] @ query
            seen[new] = True
            depth, step = to, to
            hit = np.flatnonzero(seen & eligible)
            ended = seen.all()
            threshold = None if ended else query[up] @ self.values[up, n - depth] + query[down] @ self.values[down, depth - 1]
            settled = True
            for i, (low, high) in enumerate(windows):
                inside = hit[(scores[hit] >= low) & (scores[hit] <= high)]
                if len(inside) > k:
                    kth = np.partition(scores[inside], len(inside) - k)[len(inside) - k]
                    inside = inside[scores[inside] >= kth]
                full = len(inside) >= k and scores[inside].min() > (threshold if not ended else 0)
                best[i] = (inside, scores[inside])
                settled &= ended or full or threshold < low
            if settled:
                return best, int(seen.sum())


def _ranked(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids[rows], -scores))[:k]
    return rows[order], scores[order]


def _cell(dim: int, k: int, same: bool):
    """Best rows of a block for the windows of a part of the anchors: of the same label, or of the others."""
    def cell(block: pa.Table, asked: pa.Table) -> pa.Table:
        if not block.num_rows or not asked.num_rows:
            return FOUND.empty_table()
        vectors, queries = matrix(block["v"], dim), matrix(asked["v"], dim)
        exact = dim * max(1, int(np.abs(vectors).max(initial=0))) * max(1, int(np.abs(queries).max(initial=0))) < 2**53
        kind = np.float64 if exact else np.int64  # sums below 2**53 are exact in doubles, which multiply faster
        lists, queries = SortedLists(vectors.astype(kind)), queries.astype(kind)
        rows, labels, ids = block["row"].to_numpy(), block["label"].to_numpy(), pc.fill_null(block["vec_id"], _LAST).to_numpy()
        limits = asked["windows"].to_pylist() if not same else [[(-math.inf, math.inf)]] * asked.num_rows
        out = []
        for anchor, label, query, opened in zip(asked["row"].to_pylist(), asked["label"].to_pylist(), queries, limits):
            eligible = (labels == label) & (rows != anchor) if same else labels != label
            windows = opened if same else [(w["low"], w["high"]) for w in opened]
            for place, (hit, scores) in enumerate(lists.search(query, eligible, windows, k)[0]):
                hit, scores = _ranked(hit, scores, ids, k)
                out.append((np.full(len(hit), anchor), np.full(len(hit), place), ids[hit], scores.astype(np.int64)))
        anchor, place, found, score = (np.concatenate(c) for c in zip(*out))
        return pa.table([pa.array(anchor, pa.int64()), pa.array(place, pa.int32()), pa.array(found, pa.int64(), mask=found == _LAST), pa.array(score, pa.int64())],
                        names=FOUND.names)
    return cell


def _grid(rows: DataFrame, anchors: DataFrame, blocks: int, parts: int, dim: int, k: int, same: bool) -> DataFrame:
    dealt = lambda df, name, n: df.withColumn(name, F.pmod(F.xxhash64("row"), F.lit(n)).cast("int"))
    every = lambda df, name, n: df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    left = every(dealt(rows, "block", blocks), "part", parts)
    right = every(dealt(anchors, "part", parts), "block", blocks)
    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(_cell(dim, k, same), from_arrow_schema(FOUND))
    return top_k(found, k, [F.col("score").desc(), F.col("id").asc_nulls_last()], ["anchor", "place"], "rank")


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
                   scale: int = 256, relabel: int = 7, labels: int = 10, block_rows: int = ROWS, part_anchors: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor (`every` divides its vec_id) and
    each of its best `positives` rows of the same label, the best `negatives` rows of other labels that score `low` to `high`
    percent of the positive."""
    rows = stored(items(vectors, scale, relabel, labels), "vectors")
    sizes = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.count_if(F.col("vec_id") % every == 0).alias("anchors")).first()
    blocks, parts = max(1, math.ceil(sizes["n"] / block_rows)), max(1, math.ceil(sizes["anchors"] / part_anchors))
    anchors = rows.filter(F.col("vec_id") % every == 0)
    dim = max(1, sizes["dim"] or 0)
    friends = stored(_grid(rows, anchors, blocks, parts, dim, positives, same=True), "positives")
    # the window of a positive score p holds the scores n with low * p <= 100 * n <= high * p; below 0 it is empty
    low, over_low = low // math.gcd(low, 100), 100 // math.gcd(low, 100)
    high, over_high = high // math.gcd(high, 100), 100 // math.gcd(high, 100)
    window = F.struct("rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"),
                      F.expr(f"(score * {low} + {over_low - 1}) div {over_low}").alias("low"), F.expr(f"(score * {high}) div {over_high}").alias("high"))
    opened = friends.filter("score >= 0").groupBy("anchor").agg(F.sort_array(F.collect_list(window)).alias("windows"))
    asked = stored(anchors.join(opened, F.col("row") == F.col("anchor")).drop("anchor"), "anchors")
    found = _grid(rows, asked, blocks, parts, dim, negatives, same=False)
    named = asked.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"), F.posexplode("windows").alias("place", "window"))
    return found.join(named, ["anchor", "place"]).select(
        "anchor_id", "window.positive_id", "rank", F.col("id").alias("negative_id"), "window.positive_score", F.col("score").alias("negative_score"))
