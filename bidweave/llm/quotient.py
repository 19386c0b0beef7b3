"""Exact duplicates by counting quotient filters (operator 9).

Every text gets a 64-bit fingerprint. A counting quotient filter holds fingerprints with counts:
the high bits (quotient) name a run, the low bits (remainder) are kept sorted inside the run, so
a filter loses nothing and two filters merge by merging their sorted runs. Each partition builds
the filter of its own rows and sends it in blocks of neighbouring quotients; the blocks of one
range are merged by one task as they stream in. Fingerprints counted once are unique texts and need
nothing more. The others are verified: only their texts are grouped, by fingerprint and bytes,
copies being combined before the shuffle. A bit table of the repeated fingerprints keeps the texts that are
certainly unique out of these joins.

Equal means identical after each run of 0x20 and 0x09 to 0x0D became one space; nothing is trimmed.

Defined results: a null text counts as empty, and empty texts are equal. Of equal texts the row
with the smallest doc_id stays; a null doc_id comes last; among rows that also share the doc_id one
row stays, by the hash of the whole row. Rows are never merged in the result: repeated rows give repeated
rows. Other columns are untouched. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidweave.llm.bitfilter import bit_table, may_meet
from bidweave.llm.common import packed, partitions, row_hash, stored

# a run that is one plain space already is left alone, which gives the same text with fewer matches
_RUNS = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUNS, " ")


class QuotientFilter:
    """Counting quotient filter over 64-bit fingerprints of one quotient range.

    low_bits: bits of a remainder; quotients are counted from `first`. Held as the sorted
    remainders, the length of the run of each quotient, and the counts.
    """

    def __init__(self, low_bits: int, first: int, runs: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.low_bits, self.first, self.runs, self.remainders, self.counts = low_bits, first, runs, remainders, counts

    @classmethod
    def of(cls, low_bits: int, first: int, width: int, values: np.ndarray, counts: np.ndarray) -> QuotientFilter:
        """From sorted distinct fingerprints (uint64) whose quotients lie in first .. first + width - 1."""
        quotients = (values >> np.uint64(low_bits)).astype(np.int64) - first
        return cls(low_bits, first, np.bincount(quotients, minlength=width).astype(np.uint32),
                   values & np.uint64((1 << low_bits) - 1), counts.astype(np.int64))

    def fingerprints(self) -> np.ndarray:
        quotients = np.repeat(np.arange(len(self.runs)), self.runs).astype(np.uint64) + np.uint64(self.first)
        return (quotients << np.uint64(self.low_bits)) | self.remainders

    def merge(self, *others: QuotientFilter) -> QuotientFilter:
        """Lossless union: counts of equal fingerprints add up."""
        values = np.concatenate([self.fingerprints(), *[o.fingerprints() for o in others]])
        counts = np.concatenate([self.counts, *[o.counts for o in others]])
        order = np.argsort(values, kind="stable")  # merges the sorted pieces
        values, counts = values[order], counts[order]
        starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, int)
        return QuotientFilter.of(self.low_bits, self.first, len(self.runs), values[starts],
                                 np.add.reduceat(counts, starts) if len(starts) else counts)

    def to_bytes(self) -> bytes:
        """Occupied quotients and run ends as bits, then remainders, then counts above one with their places."""
        occupied = self.runs > 0
        ends = np.zeros(len(self.remainders), bool)
        ends[np.cumsum(self.runs[occupied]) - 1] = True
        many = np.flatnonzero(self.counts > 1)
        head = np.array([self.low_bits, self.first, len(self.runs), len(self.remainders), len(many)], "<i8")
        return b"".join([head.tobytes(), np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(), self.remainders.astype("<u8").tobytes(),
                         many.astype("<i8").tobytes(), self.counts[many].astype("<i8").tobytes()])

    @classmethod
    def from_bytes(cls, raw: bytes) -> QuotientFilter:
        low_bits, first, width, n, many = (int(x) for x in np.frombuffer(raw, "<i8", 5))
        at = 40
        occupied = np.unpackbits(np.frombuffer(raw, np.uint8, -(-width // 8), at))[:width].astype(bool)
        at += -(-width // 8)
        ends = np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8, -(-n // 8), at))[:n])
        at += -(-n // 8)
        remainders = np.frombuffer(raw, "<u8", n, at)
        at += 8 * n
        counts = np.ones(n, np.int64)
        counts[np.frombuffer(raw, "<i8", many, at)] = np.frombuffer(raw, "<i8", many, at + 8 * many)
        runs = np.zeros(width, np.uint32)
        runs[occupied] = np.diff(ends, prepend=-1)
        return cls(low_bits, first, runs, remainders, counts)


def repeated(values: DataFrame, column: str, expected: int, block_quotients: int = 1 << 16, batch_rows: int = 1 << 17) -> DataFrame:
    """(column, copies): the 64-bit values found more than once.

    There is about one quotient per expected row; `block_quotients` of them make the block that one
    step merges, so a block stays as large at any size of the input.
    """
    bits = max(4, int(max(1, expected) * 1.4).bit_length())
    width_bits = min(bits - 4, block_quotients.bit_length() - 1)  # 16 blocks at least
    width, low_bits = 1 << width_bits, 64 - bits

    def blocks_of(parts):
        found, counts = np.unique(np.concatenate(parts), return_counts=True)
        block = (found >> np.uint64(low_bits + width_bits)).astype(np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))
        for low, high in zip(cuts[:-1], cuts[1:]):
            yield int(block[low]), QuotientFilter.of(low_bits, int(block[low]) << width_bits, width, found[low:high], counts[low:high]).to_bytes()

    def build(batches):
        parts, rows = [], 0

        def flush():
            out = list(blocks_of(parts))
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int64()), pa.array([f for _, f in out], pa.binary())],
                                              names=["block", "filter"])
        for batch in batches:
            parts.append(np.asarray(batch.column(0)).astype(np.int64).view(np.uint64))
            rows += batch.num_rows
            if rows >= batch_rows:
                yield flush()
                parts, rows = [], 0
        if rows:
            yield flush()

    def merge(batches):
        current, merged = None, None

        def many():
            keep = merged.counts > 1
            return pa.RecordBatch.from_arrays([pa.array(merged.fingerprints()[keep].view(np.int64)), pa.array(merged.counts[keep])],
                                              names=[column, "copies"])
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = QuotientFilter.from_bytes(raw.as_py())
                if block == current:
                    merged = merged.merge(part)
                    continue
                if merged is not None:
                    yield many()
                current, merged = block, part
        if merged is not None:
            yield many()

    n = partitions(values.sparkSession)
    filters = values.select(F.col(column).cast("long")).mapInArrow(build, "block long, filter binary")
    return filters.repartition(n, "block").sortWithinPartitions("block").mapInArrow(merge, f"`{column}` long, copies long")


def _keyed(docs: DataFrame) -> DataFrame:
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").cast("long").alias("id"), row_hash(docs).alias("h"))
    rows = docs.select(packed(docs), order.alias("__order"), normalised(F.col("text")).alias("__text"))
    return rows.withColumn("__fp", F.xxhash64("__text")).withColumn("__sha", F.sha2("__text", 256))


def copy_groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, groups). rows: one light row per row of docs. groups(__fp, __sha, __keep, __size): the
    verified groups of two or more equal texts and the order value of the row that stays."""
    rows = stored(_keyed(docs).select("__order", "__fp", "__sha", F.monotonically_increasing_id().alias("__row")), "fingerprints")
    many = stored(repeated(rows, "__fp", rows.count()).select("__fp"), "repeated")
    # texts behind fingerprints counted more than once, compared byte by byte
    texts = docs.select(normalised(F.col("text")).alias("__text")).withColumn("__fp", F.xxhash64("__text"))
    suspects = texts.filter(may_meet(texts, F.col("__fp"), bit_table(many, "__fp"))).join(many, "__fp", "left_semi")
    texts = suspects.groupBy("__fp", "__text").agg(F.count("*").alias("__size")).select("__fp", F.sha2("__text", 256).alias("__sha"), "__size")
    proof = texts.groupBy("__fp", "__sha").agg(F.count("*").alias("__texts"), F.sum("__size").alias("__size"))
    keepers = (rows.join(many, "__fp", "left_semi").groupBy("__fp", "__sha")
               .agg(F.min(F.struct("__order", "__row")).alias("__keep")))
    groups = keepers.join(proof, ["__fp", "__sha"]).filter("__size > 1")
    alone = F.when(F.col("__texts") == 1, F.col("__size")).otherwise(F.raise_error(F.lit("two texts share a SHA-256 value")).cast("long"))
    return rows, stored(groups.select("__fp", "__sha", "__keep", alone.alias("__size")), "copies")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Per row: (doc_id, keep_id, group_size, kept, text_sha256)."""
    rows, groups = copy_groups(docs)
    one = F.col("__size").isNull()
    return rows.join(groups, ["__fp", "__sha"], "left").select(
        F.col("__order.id").alias("doc_id"), F.when(one, F.col("__order.id")).otherwise(F.col("__keep.__order.id")).alias("keep_id"),
        F.coalesce("__size", F.lit(1)).cast("long").alias("group_size"),
        (one | (F.col("__keep.__row") == F.col("__row"))).alias("kept"), F.col("__sha").alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    _, groups = copy_groups(docs)
    rows = _keyed(docs).drop("__text")
    meets = may_meet(rows, F.col("__fp"), bit_table(groups, "__fp"))
    joined = rows.filter(meets).join(groups, ["__fp", "__sha"], "left")
    alone = joined.filter(F.col("__size").isNull())
    first = joined.filter(F.col("__keep.__order") == F.col("__order")).dropDuplicates(["__fp", "__sha"])
    return rows.filter(~meets).select("__all.*").unionByName(alone.select("__all.*")).unionByName(first.select("__all.*"))
