"""First-fit decreasing packing with a tournament tree of bin capacities (operator 7).

Documents are encoded where they lie. A document is cut into full sequences and one remainder;
full pieces are sequences of their own. Remainders are dealt at random into groups of about
`group_pieces`, and each group is packed by itself: largest first, each into the first bin that
has room. A tournament tree over the bins holds the largest free capacity below each node, so the
first bin with room is found in a walk from the root. Groups are independent, so a lost task
costs one group, and no task sees more than its group.

Defined results: a null or empty text is one piece holding the end id. Rows that repeat a doc_id
are packed each for itself. Rows with a null doc_id are packed too. Other columns are ignored. An
empty table gives no pieces.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidweave.llm import words as W
from bidweave.llm.common import stored
from bidweave.llm.encoding import Encoder, crc

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, deal long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def first_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in the bin) of each item; no item is longer than `size`.

    free[1] is the root of the tournament tree, free[leaves + b] the room of bin b.
    """
    n = len(lengths)
    leaves = 1 << max(0, (n - 1).bit_length())
    free = [size] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for item in np.argsort(-lengths, kind="stable").tolist():
        need, node = int(lengths[item]), 1
        while node < leaves:
            node *= 2
            if free[node] < need:
                node += 1
        bins[item], offsets[item] = node - leaves, size - free[node]
        free[node] -= need
        node //= 2
        while node:
            most = max(free[2 * node], free[2 * node + 1])
            if free[node] == most:
                break
            free[node] = most
            node //= 2
    return bins, offsets


def pieces(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 2) -> DataFrame:
    """Token pieces of at most `size` ids, each with a random number that deals it to a group.

    The number comes from the place of the row in its task, so copies of one row are spread too.
    """
    def cut(batches):
        encoder = Encoder(tokenizer, end_id)
        seed, count = np.uint64(TaskContext.get().partitionId() + 1) << np.uint64(40), 0
        for batch in batches:
            out = []
            for key, raw in zip(batch.column(0).to_pylist(), encoder.rows(batch.column(1))):
                total = len(raw) // 4
                for start in range(0, total, size):
                    part = raw[4 * start:4 * (start + size)]
                    out.append((key, start, len(part) // 4, crc(part), total))
            places = seed + np.arange(count, count + len(out), dtype=np.uint64)
            count += len(out)
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in columns), pa.array((W.mix(places) >> np.uint64(1)).astype(np.int64))],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "deal"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 2, group_pieces: int = 20_000) -> DataFrame:
    """Every piece with its sequence and its offset there."""
    cut = stored(pieces(docs, tokenizer, size, end_id), "pieces")
    groups = max(1, math.ceil(cut.filter(F.col("length") < size).count() / group_pieces))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("deal", kind="stable")
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), size)
        out = group[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].copy()
        out["sequence_id"] = (group["part"].to_numpy().astype(np.int64) << 32) + bins
        out["offset"] = offsets
        return out

    part = F.pmod("deal", F.lit(groups)).cast("long")
    packed = cut.filter(F.col("length") < size).withColumn("part", part).groupBy("part").applyInPandas(fit, PACKED)
    # a full piece is a sequence of its own, numbered by its place in the stored table
    full = cut.filter(F.col("length") >= size).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.lit(1 << 62) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)
