"""Exact vector search that leaves out what cannot be among the best: vectors grouped in balls.

Unit vectors are dealt to the nearest of some pivots (the first vectors in the order of a hash, a bounded number). A ball knows its
pivot, its radius (the largest distance of a member) and its size. A member v of a ball with pivot c and radius r scores
q.v <= q.c + |q| r, so a ball whose bound lies below the k-th score of a query holds none of its best k. A search takes a lower bound of
that score from some members (pilots) of the balls of highest bound, and then scores the balls whose bound reaches it. The result is that of a
search over all vectors; how much is left out depends on how well the vectors cluster. Queries and vectors stay distributed; the
driver and the tasks hold what belongs to the balls (MOST_BALLS pivots, PILOT_BYTES of pilots) and blocks of both sides.

An index is a folder: `vectors`, sorted by ball, so a scan of some balls opens their row groups only, and `balls`, one row each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidweave.operators import search as SE
from bidweave.operators.keys import top_k, top_k_staged
from bidweave.session import cut

MOST_BALLS = 4096
FIRST_BALLS = 2  # balls per query whose pilots are scored first, more if they hold fewer than k
PILOT_BYTES = 32 * 1024 * 1024
MARGIN = 1e-8  # for the grid of scores and the order of summation


@dataclass
class BallIndex:
    vectors: DataFrame | None  # (ball, doc_id, v)
    pivots: np.ndarray
    radius: np.ndarray
    sizes: np.ndarray
    dim: int


def write_ball_index(vectors: DataFrame, path: str, dim: int, key: str = "id", vector: str = "embedding", balls: int | None = None) -> None:
    """Deal the valid vectors, scaled to length 1, to balls."""
    base = SE.vector_table(vectors, dim, key, vector).select(F.col(key).alias("doc_id"), F.col(vector).alias("v"))
    many = balls or min(MOST_BALLS, max(1, math.isqrt(base.count())))
    pivots = SE._matrix(base.orderBy(F.xxhash64("doc_id"), "doc_id").limit(many).toArrow()["v"].combine_chunks(), dim)
    block = base.sparkSession.sparkContext.broadcast(pivots)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = block.value
        for batch in batches:
            rows = SE._matrix(batch.column(1), dim)
            ball = np.argmax(rows @ centres.T, axis=1)
            far = np.linalg.norm(rows - centres[ball], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(ball, pa.int32()), *batch.columns, pa.array(far)], names=["ball", "doc_id", "v", "far"])

    kind = base.schema["doc_id"].dataType.simpleString()
    dealt = base.mapInArrow(deal, f"ball int, doc_id {kind}, v array<double>, far double")
    # a ball with very many members spans several files
    dealt.repartitionByRange("ball", F.xxhash64("doc_id")).sortWithinPartitions("ball").write.mode("overwrite").option(
        "parquet.block.size", str(8 * 1024 * 1024)).parquet(f"{path}/vectors")
    spark = base.sparkSession
    sizes = spark.read.parquet(f"{path}/vectors").groupBy("ball").agg(F.max("far").alias("radius"), F.count("*").alias("n"))
    table = spark.createDataFrame(pa.table({"ball": pa.array(range(len(pivots)), pa.int32()), "pivot": pa.array(list(pivots), pa.list_(pa.float64()))}))
    table.join(sizes, "ball", "left").na.fill(0, ["n"]).coalesce(1).write.mode("overwrite").parquet(f"{path}/balls")


def read_ball_index(spark: SparkSession, path: str, dim: int) -> BallIndex:
    balls = spark.read.parquet(f"{path}/balls").orderBy("ball").toArrow()  # MOST_BALLS rows at most
    radius = np.nan_to_num(balls["radius"].to_numpy())
    pivots = SE._matrix(balls["pivot"].combine_chunks(), dim) if balls.num_rows else np.zeros((0, dim))
    return BallIndex(spark.read.parquet(f"{path}/vectors").drop("far"), pivots, radius, balls["n"].to_numpy(), dim)


def _pilots(index: BallIndex) -> tuple[np.ndarray, np.ndarray]:
    """Some vectors of each ball, in the order of balls, and where those of a ball begin: a bounded number in all."""
    most = max(1, PILOT_BYTES // (index.dim * 8) // max(1, len(index.sizes)))
    rows = top_k(index.vectors.select("ball", "v", F.xxhash64("doc_id").alias("_h")), most, [F.col("_h")], ["ball"]).select("ball", "v").toArrow()
    ball = rows["ball"].to_numpy()
    vectors = SE._matrix(rows["v"].combine_chunks(), index.dim)[np.argsort(ball, kind="stable")] if rows.num_rows else np.zeros((0, index.dim))
    return vectors, np.searchsorted(np.sort(ball), np.arange(len(index.sizes) + 1))


def _bounds(index: BallIndex, questions: np.ndarray) -> np.ndarray:
    """The most that a member of each ball can score; empty balls reach nothing."""
    bounds = questions @ index.pivots.T + np.linalg.norm(questions, axis=1)[:, None] * index.radius + MARGIN
    bounds[:, index.sizes == 0] = -np.inf
    return bounds


def _prepared(index: BallIndex, asked: DataFrame, k: int) -> DataFrame:
    """(qid, q, floor, scored): a score that the k-th of the query reaches, from pilots of its best balls, and how many balls can reach it."""
    bare = BallIndex(None, index.pivots, index.radius, index.sizes, index.dim)
    block = asked.sparkSession.sparkContext.broadcast((bare, *_pilots(index)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, pilots, starts = block.value
        held = np.diff(starts)
        for batch in batches:
            questions, floor = SE._matrix(batch.column(1), index.dim), np.full(batch.num_rows, -np.inf)
            bounds = _bounds(index, questions)
            for i, rank in enumerate(np.argsort(-bounds, axis=1, kind="stable")):
                n = max(FIRST_BALLS, int(np.searchsorted(np.cumsum(held[rank]), k)) + 1)
                some = np.concatenate([pilots[starts[b]:starts[b + 1]] for b in rank[:n]])
                if len(some) >= k:
                    floor[i] = np.partition(SE._products(questions[i:i + 1], some)[0], len(some) - k)[len(some) - k]
            scored = (bounds >= floor[:, None]) & (index.sizes > 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floor), pa.array(scored.sum(1))], names=["qid", "q", "floor", "scored"])

    return asked.mapInArrow(run, f"qid {asked.schema['qid'].dataType.simpleString()}, q array<double>, floor double, scored long")


def _placed(index: BallIndex, rows: int) -> tuple[DataFrame, int]:
    """The vectors with a block of about `rows` rows each: neighbouring balls share a block, a larger ball spans several."""
    before = np.cumsum(index.sizes) - index.sizes
    first, last = before // rows, np.maximum(before, before + index.sizes - 1) // rows
    table = pa.table({"ball": pa.array(range(len(first)), pa.int32()), "_first": pa.array(first, pa.int64()), "_many": pa.array(last - first + 1, pa.int64())})
    where = F.broadcast(index.vectors.sparkSession.createDataFrame(table))  # MOST_BALLS rows at most
    block = (F.col("_first") + F.pmod(F.xxhash64("doc_id"), F.col("_many"))).cast("int")
    return index.vectors.join(where, "ball").select("ball", "doc_id", "v", block.alias("vb")), int(last.max()) + 1


def ball_search(index: BallIndex, queries: DataFrame, k: int = 10, qid: str = "qid", vector: str = "embedding",
                block_bytes: int = SE.BROADCAST_BYTES) -> tuple[DataFrame, float]:
    """((qid, doc_id, score, rank), share of the (query, ball) pairs that were left out): the rows of vector_search. Blocks of queries
    and of balls, both of bounded size, meet on a grid; a query is held against the balls that can reach its k-th score."""
    asked = SE.vector_table(queries, index.dim, qid, vector).select(F.col(qid).alias("qid"), F.col(vector).alias("q"))
    types = (f"qid {asked.schema['qid'].dataType.simpleString()}, doc_id {index.vectors.schema['doc_id'].dataType.simpleString()}, score double")
    spark, dim = index.vectors.sparkSession, index.dim
    if not len(index.sizes) or not index.sizes.sum():
        return spark.createDataFrame([], types + ", rank int"), 0.0
    asked = cut(_prepared(index, asked, k))
    whole = asked.agg(F.count("*").alias("n"), F.sum("scored").alias("scored")).first()
    left_out = 1 - (whole["scored"] or 0) / max(1, whole["n"] * int((index.sizes > 0).sum()))
    left, v_blocks = _placed(index, SE.grid_rows(dim))
    block = spark.sparkContext.broadcast(BallIndex(None, index.pivots, index.radius, index.sizes, dim))

    def score(docs: pa.Table, questions: pa.Table) -> pa.Table:
        ball = docs["ball"].to_numpy()
        order = np.argsort(ball, kind="stable")
        held, starts = np.unique(ball[order], return_index=True)
        ids, vectors = docs["doc_id"].to_numpy()[order], SE._matrix(docs["v"].combine_chunks(), dim)[order]
        whole = block.value
        some = BallIndex(None, whole.pivots[held], whole.radius[held], whole.sizes[held], dim)
        best = SE.Best(SE._matrix(questions["q"].combine_chunks(), dim), k, questions["floor"].to_numpy())
        step, most = max(1, SE.RESULT_CELLS // len(held)), min(SE.BLOCK_VECTORS, SE.RESULT_CELLS)
        for low in range(0, questions.num_rows, step):  # some queries against the bounds of all balls of the block
            part = np.arange(low, min(low + step, questions.num_rows))
            bounds = _bounds(some, best.questions[part])
            for i in np.argsort(-bounds.max(axis=0), kind="stable"):
                asking = part[bounds[:, i] >= np.maximum(best.floor[part], best.scores[part, -1])]
                end = starts[i + 1] if i + 1 < len(starts) else len(ids)
                for at in range(starts[i], end if len(asking) else starts[i], most):
                    best.add(vectors[at:min(at + most, end)], ids[at:min(at + most, end)], asking)
        return best.rows(questions["qid"].combine_chunks())

    found = SE.on_grid(left, asked.drop("scored"), v_blocks, SE.grid_rows(dim, k, block_bytes), score, types)
    return top_k_staged(found, k, [F.col("score").desc(), F.col("doc_id")], ["qid"], "doc_id", "rank"), left_out
