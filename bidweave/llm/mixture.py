"""Mixing sources to target weights by subset-sum fitting (operator 5).

The budget is shared among sources by weight; no target exceeds `most` times its source's size, and
what is cut off is shared again by weight. A source takes every document `floor(target / size)` times;
the rest of its target is filled by a subset of its documents. Documents are counted by exact token length,
so the subset is a number of documents per length: first the same part of every length, then one more of
single lengths while the rest is large, and for the remaining budget a bounded-knapsack program
finds the lengths that fill it best (larger rests in a common grain). Which documents of a length are taken is decided by a seeded hash.

A source's plan is made from its length counts alone (one row per distinct length), by one task
per source. Rows are numbered within (source, length) without bringing such a group together.

Defined results: a null text has size 0 and adds nothing. A null source is a source of its own, last in the order. A
null doc_id is a row like any other. Repeated rows count each for itself. Documents with size 0 are taken as
often as their source's whole repeats; that adds no word. Sources of size 0 have target 0. Other
columns are kept by mix and ignored otherwise. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidweave.llm.common import WORD, bin_ranks, packed, sorted_positions, stored

KNAPSACK = 1 << 14  # the remaining budget that the exact program fills
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A source as a text that is never null: null and the word null stay apart."""
    return F.coalesce(F.concat(F.lit("+"), source.cast("string")), F.lit("-"))


def _program(lengths: np.ndarray, left: np.ndarray, limit: int, goal: int) -> tuple[int, list]:
    """Bits of the sums up to `limit` that at most `left` of each length make, and the steps to them; ends when `goal` is reached."""
    reach, steps, mask = 1, [], (1 << (limit + 1)) - 1
    for i in np.flatnonzero((lengths > 0) & (lengths <= limit) & (left > 0)).tolist():
        free, chunk = min(int(left[i]), limit // int(lengths[i])), 1
        while free and not reach >> goal & 1:
            part = min(chunk, free)
            steps.append((i, part, reach))
            reach |= reach << (part * int(lengths[i])) & mask
            free, chunk = free - part, chunk * 2
        if reach >> goal & 1:
            break
    return reach, steps


def _trace(lengths: np.ndarray, steps: list, goal: int) -> np.ndarray:
    """How many of each length make the sum `goal`."""
    taken = np.zeros(len(lengths), np.int64)
    for i, part, before in reversed(steps):
        if not before >> goal & 1:
            taken[i] += part
            goal -= part * int(lengths[i])
    return taken


def _coarse(lengths: np.ndarray, left: np.ndarray, rest: int, knapsack: int) -> list[np.ndarray]:
    """Plans for a rest above `knapsack`: the program on lengths divided by their common divisor, or if that is too fine
    rounded to a grain of rest / knapsack, for the sums next to the rest."""
    use = (lengths > 0) & (lengths < 2 * rest) & (left > 0)  # a sum beyond 2 * rest is no nearer than none
    if not use.any():
        return []
    grain, exact = int(np.gcd.reduce(lengths[use])), True
    if rest // grain > knapsack:
        grain, exact = -(-rest // max(1, knapsack)), False
    short = np.where(use, lengths // grain if exact else np.maximum(1, (lengths + grain // 2) // grain), 0)
    goal, limit = rest // grain, 2 * (rest // grain) + 1
    reach, steps = _program(short, left, limit, goal if exact and goal * grain == rest else limit)
    sums = np.array([k for k, bit in enumerate(reversed(bin(reach)[2:])) if bit == "1"])
    near = sums[np.argsort(np.abs(sums * grain - rest), kind="stable")[:2 if exact else 16]]
    return [_trace(short, steps, int(k)) for k in near]


def _finish(lengths: np.ndarray, counts: np.ndarray, taken: np.ndarray, budget: int, knapsack: int) -> np.ndarray:
    """`taken` with the exact program on a rest of at most `knapsack`, and one document more if that comes nearer."""
    taken = taken.copy()
    rest = budget - int((taken * lengths).sum())
    if 0 < rest <= knapsack:
        reach, steps = _program(lengths, counts - taken, rest, rest)
        taken += _trace(lengths, steps, reach.bit_length() - 1)
    rest = budget - int((taken * lengths).sum())
    longer = np.flatnonzero((lengths > rest) & (taken < counts))
    if rest > 0 and len(longer) and lengths[longer[-1]] - rest < rest:
        taken[longer[-1]] += 1  # lengths fall, so this is the shortest
    return taken


def fill(lengths: np.ndarray, counts: np.ndarray, budget: int, knapsack: int = KNAPSACK) -> np.ndarray:
    """How many documents of each length to take, so that their sum comes near `budget`.

    The proportional part, one more of single lengths, and then as many as fit leave a rest of at most
    `knapsack` (or one that no document fits); the bounded knapsack over the documents that are left fills it as
    far as they can. If that leaves more than the shortest remaining document would exceed, that one is taken too.
    Where the result is not the budget and the rest after the proportional part was above `knapsack`, the
    program is also run on that rest in a common grain; the nearest plan counts.
    """
    order = np.argsort(-lengths, kind="stable")
    lengths, counts = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    total = int((lengths * counts).sum())
    budget = min(max(0, int(budget)), total)
    start = np.array([int(c) * budget // max(1, total) for c in counts], np.int64)
    taken, first = start.copy(), budget - int((start * lengths).sum())
    rest = first
    for most in (1, total):
        for i in range(len(lengths)):
            if rest <= knapsack:
                break
            if 0 < lengths[i] <= rest:
                more = min(int(counts[i] - taken[i]), rest // int(lengths[i]), most)
                taken[i] += more
                rest -= more * int(lengths[i])
    off = lambda plan: abs(budget - int((plan * lengths).sum()))
    taken = _finish(lengths, counts, taken, budget, knapsack)
    if first > knapsack and off(taken):
        for more in _coarse(lengths, counts - start, first, knapsack):
            taken = min(taken, _finish(lengths, counts, start + more, budget, knapsack), key=off)
    out = np.zeros(len(order), np.int64)
    out[order] = taken
    return out


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(key, source_size, target) from rows (source, key, size).

    One row per source; the level at which shares are cut off is found by repeated sums over these rows.
    """
    sums = sizes.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    placed = sorted_positions(sums, [F.col("source").isNull(), F.col("source")], "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rows = stored(placed.select("key", F.col("source_size").cast("long").alias("source_size"), weight.alias("weight")), "sources")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level, cut = None, -1
    while True:  # ends: a source that is cut off stays cut off, as the level only rises
        capped = F.lit(False) if level is None else (most * F.col("source_size") <= F.lit(level) * F.col("weight"))
        got = rows.agg(F.count_if(capped).alias("n"), F.sum(F.when(capped, most * F.col("source_size")).otherwise(0.0)).alias("fixed"),
                       F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))).alias("weight")).first()
        if got["n"] == cut or not got["weight"]:
            break
        cut, level = got["n"], (share * total - got["fixed"]) / got["weight"]
    target = most * F.col("source_size") if level is None else F.least(most * F.col("source_size"), F.lit(level) * F.col("weight"))
    return rows.select("key", "source_size", target.cast("double").alias("target"))


def plan(sizes: DataFrame, goals: DataFrame, most: float = 2.0) -> DataFrame:
    """(key, size, source_size, target, whole, extra): repeats of all documents of a length, and how many more."""
    lengths = sizes.groupBy("key", "size").agg(F.count("*").alias("n"))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        target, total = float(group["target"].iloc[0]), int(group["source_size"].iloc[0])
        whole = min(int(most), math.floor(target / total)) if total else 0
        extra = np.zeros(len(group), np.int64)
        if whole < most:
            extra = fill(group["size"].to_numpy(), group["n"].to_numpy(), round(target - whole * total))
        return group[["key", "size", "source_size", "target"]].assign(whole=whole, extra=extra)

    return (lengths.join(goals, "key").groupBy("key")
            .applyInPandas(fit, "key string, size long, source_size long, target double, whole long, extra long"))


def _placed(docs: DataFrame, seed: int, weights, share: float, most: float) -> DataFrame:
    """docs (doc_id, source, words, tie, and others) with __source, __size, the plan of its source and length, and __copies of the row."""
    rows = docs.withColumn("__source", source_key(F.col("source"))).withColumnRenamed("words", "__size")
    sizes = stored(rows.select(F.col("source").cast("string").alias("source"), F.col("__source").alias("key"), F.col("__size").alias("size")), "sizes")
    plans = stored(plan(sizes, targets(sizes, weights, share, most), most), "plan")
    seeded = rows.withColumn("__seed", F.xxhash64(F.lit(seed), "doc_id"))
    chosen = plans.select(F.col("key").alias("__source"), F.col("size").alias("__size"), F.col("source_size").alias("__source_size"),
                          F.col("target").alias("__target"), F.col("whole").alias("__whole"), F.col("extra").alias("__extra"))
    numbered = bin_ranks(seeded, ["__source", "__size"], ["__seed", "tie"], "__place", nulls=False, attach=chosen)
    return numbered.withColumn("__copies", (F.col("__whole") + (F.col("__place") < F.col("__extra")).cast("long")).cast("int"))


def _measures() -> list[Column]:
    """Words of a text, and its hash, which decides between rows of one doc_id or without one."""
    return [word_count(F.col("text")).alias("words"), F.xxhash64("text").alias("tie")]


def mix_report(docs: DataFrame, seed: int = 11, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Per row: (doc_id, size, source_size, target, taken)."""
    # sizes first, so that texts are read once and never shuffled
    light = stored(docs.select("doc_id", F.col("source").cast("string").alias("source"), *_measures()), "words")
    rows = _placed(light, seed, weights, share, most)
    return rows.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
                       (F.col("__size") * F.col("__copies")).cast("long").alias("taken"))


def mix(docs: DataFrame, seed: int = 11, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mixed rows with all their columns; a row that is taken twice comes twice."""
    whole = docs.select(packed(docs), "doc_id", F.col("source").cast("string").alias("source"), *_measures())
    rows = _placed(whole, seed, weights, share, most).filter("__copies > 0")
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select("__all.*")
