"""Token-id files with a minimal perfect hash index (operator 10).

A shard is two files: the raw little-endian unsigned ids of its documents one after the other (16 bits
each if the vocabulary allows it, else 32), and an index of the document keys. The index is a cascade of bit arrays: a key that has a cell of a
level to itself owns that bit, the others go on to the next, smaller level; the number of set bits
before a key's bit is its slot. A slot holds a 32-bit fingerprint of the key, the offset and the
number of ids, so a look-up reads a few cells whatever the size of the shard.

Defined results: a null text counts as empty (the end id alone). Rows are kept as they are, also
rows that repeat a doc_id: they get consecutive places, told apart by their occurrence in the shard.
A null doc_id comes after all others. Other columns are ignored. An empty table makes no files.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidweave.llm import words as W
from bidweave.llm.common import partitions, scratch, stored
from bidweave.llm.encoding import Encoder, crc

MAGIC = b"IDX1"
_LEVELS = 48


def key_hash(ids: np.ndarray, nulls: np.ndarray, occurrence: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit keys of (doc_id, occurrence); for a plain doc_id the mapping is one to one."""
    extra = (occurrence.astype(np.uint64) << np.uint64(1)) | nulls.astype(np.uint64)
    extra = np.where(extra > 0, W.mix(extra), extra)
    return W.mix(np.where(nulls, 0, ids).astype(np.int64).view(np.uint64) ^ extra ^ np.uint64(seed))


def _cells(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    step = np.uint64(level * int(W._BASE) % 2**64)
    return (W.mix(keys + step) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.ranks = np.concatenate([[0], np.cumsum(bits)]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, spare: float = 1.6) -> PerfectHash:
        sizes, bits = [], []
        while len(keys):
            if len(sizes) == _LEVELS:
                raise ValueError("keys are not distinct")
            size = max(8, int(len(keys) * spare))
            cells = _cells(keys, len(sizes), size)
            alone = np.bincount(cells, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            keys = keys[~alone[cells]]
        return cls(sizes, np.concatenate(bits) if bits else np.zeros(0, bool))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 for some keys that were not built in."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            cells = self.starts[level] + _cells(keys[open_], level, size)
            hit = self.bits[cells]
            out[open_[hit]] = self.ranks[cells[hit]]
            open_ = open_[~hit]
            if not len(open_):
                break
        return out


def pack_index(ids: np.ndarray, nulls: np.ndarray, occurrence: np.ndarray, offsets: np.ndarray, lengths: np.ndarray, width: int = 4) -> bytes:
    seed = 0
    keys = key_hash(ids, nulls, occurrence, seed)
    while len(np.unique(keys)) < len(keys):
        seed += 1
        keys = key_hash(ids, nulls, occurrence, seed)
    index = PerfectHash.build(keys)
    slots = index.slots(keys)
    marks, places, counts = (np.zeros(len(keys), t) for t in ("<u4", "<u8", "<u8"))
    marks[slots], places[slots], counts[slots] = W.mix(keys ^ W._BASE) >> np.uint64(32), offsets, lengths
    head = MAGIC + struct.pack("<QQQQ", len(keys), seed, width, len(index.sizes)) + np.array(index.sizes, "<u8").tobytes()
    return head + np.packbits(index.bits).tobytes() + marks.tobytes() + places.tobytes() + counts.tobytes()


class Index:
    """Look-ups in the bytes of an index file."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not an index of token ids")
        n, self.seed, self.width, levels = struct.unpack_from("<QQQQ", raw, 4)
        at = 36 + 8 * levels
        sizes = [int(x) for x in np.frombuffer(raw, "<u8", levels, 36)]
        size = -(-sum(sizes) // 8)
        bits = np.unpackbits(np.frombuffer(raw, np.uint8, size, at))[:sum(sizes)].astype(bool)
        self.hash = PerfectHash(sizes, bits)
        at += size
        self.marks = np.frombuffer(raw, "<u4", n, at)
        self.places = np.frombuffer(raw, "<u8", n, at + 4 * n)
        self.counts = np.frombuffer(raw, "<u8", n, at + 12 * n)

    def find(self, ids: np.ndarray, nulls: np.ndarray, occurrence: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(offset, number of ids, found) of each key, in ids from the start of the shard."""
        keys = key_hash(ids, nulls, occurrence, self.seed)
        slots = self.hash.slots(keys)
        if len(self.marks) == 0:
            return slots, slots, np.zeros(len(slots), bool)
        safe = np.maximum(slots, 0)
        found = (slots >= 0) & (self.marks[safe] == (W.mix(keys ^ W._BASE) >> np.uint64(32)).astype(np.uint32))
        return self.places[safe].astype(np.int64), self.counts[safe].astype(np.int64), found


def _numbers(column) -> tuple[np.ndarray, np.ndarray]:
    nulls = np.asarray(column.is_null())
    return np.asarray(column.fill_null(0)).astype(np.int64), nulls


def write_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, shards: int | None = None) -> DataFrame:
    """Write the ids of all documents in ascending doc_id order; return (doc_id, occurrence, file).

    Documents are range-partitioned by doc_id; a partition is encoded and appended batch by batch,
    so a task holds one batch and the index of its shard. A file's name holds the task attempt, and
    only names in the returned table count: a repeated task leaves an unused file and no fault.
    """
    def write(batches):
        from pyarrow import fs
        store, root = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        name = f"{task.partitionId():06d}-{task.taskAttemptId()}"
        encoder, out, at = Encoder(tokenizer, end_id), None, 0
        width = 2 if max(len(encoder.ends), end_id + 1) <= 1 << 16 else 4
        ids, nulls, occurrences, offsets, lengths = [], [], [], [], []
        last, seen = None, 0
        for batch in batches:
            if out is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(f"{root}/{name}.ids")
            keys = batch.column(0).to_pylist()
            order = []
            for key, raw in zip(keys, encoder.rows(batch.column(1))):
                seen = seen + 1 if ids and key == last else 0
                last = key
                out.write(raw if width == 4 else np.frombuffer(raw, "<u4").astype("<u2").tobytes())
                ids.append(key or 0)
                nulls.append(key is None)
                occurrences.append(seen)
                order.append(seen)
                offsets.append(at)
                lengths.append(len(raw) // 4)
                at += len(raw) // 4
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(order, pa.int64()), pa.array([name] * len(keys), pa.string())],
                                             names=["doc_id", "occurrence", "file"])
        if out is not None:
            out.close()
            with store.open_output_stream(f"{root}/{name}.idx") as index:
                index.write(pack_index(np.array(ids, np.int64), np.array(nulls, bool), np.array(occurrences, np.int64),
                                       np.array(offsets, np.int64), np.array(lengths, np.int64), width))

    n = shards or partitions(docs.sparkSession)
    order = [F.col("doc_id").isNull(), F.col("doc_id")]
    placed = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_tie", F.monotonically_increasing_id())
              .repartitionByRange(n, *order, "_tie").sortWithinPartitions(*order, "_tie").select("doc_id", "text"))
    return placed.mapInArrow(write, "doc_id long, occurrence long, file string")


def read_files(keys: DataFrame, folder: str, shards: int | None = None) -> DataFrame:
    """Look the keys (doc_id, occurrence, file) up in the files: (doc_id, file, place, n_tokens, ids_crc32)."""
    def read(batches):
        from pyarrow import fs
        store, root = fs.FileSystem.from_uri(folder)
        name = index = payload = None
        for batch in batches:
            files = batch.column(2).to_pylist()
            ids, nulls = _numbers(batch.column(0))
            occurrence = np.asarray(batch.column(1)).astype(np.int64)
            low = 0
            while low < len(files):
                high = low
                while high < len(files) and files[high] == files[low]:
                    high += 1
                if files[low] != name:
                    if payload is not None:
                        payload.close()
                    name = files[low]
                    with store.open_input_file(f"{root}/{name}.idx") as f:
                        index = Index(f.read())
                    payload = store.open_input_file(f"{root}/{name}.ids")
                places, counts, found = index.find(ids[low:high], nulls[low:high], occurrence[low:high])
                if not found.all():
                    raise ValueError(f"{name} lacks a document")
                wide = index.width
                ids_of = (payload.read_at(wide * int(c), wide * int(p)) for p, c in zip(places, counts))
                sums = [crc(raw if wide == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes()) for raw in ids_of]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), batch.column(2).slice(low, high - low), pa.array(places, pa.int64()),
                     pa.array(counts, pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "file", "place", "n_tokens", "ids_crc32"])
                low = high
        if payload is not None:
            payload.close()

    n = shards or partitions(keys.sparkSession)
    routed = keys.select("doc_id", "occurrence", "file").repartition(n, "file").sortWithinPartitions("file")
    return routed.mapInArrow(read, "doc_id long, file string, place long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 2, shards: int | None = None) -> DataFrame:
    """Write the files, read every document back by key: (doc_id, start, n_tokens, ids_crc32).

    `start` counts the ids of all documents before it: a file's ids are summed, files are in
    ascending doc_id order (there are as many files as partitions).
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "ids")
    keys = stored(write_files(docs, folder, tokenizer, end_id, shards), "keys")
    found = stored(read_files(keys, folder, shards), "found")
    sizes = found.groupBy("file").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("file").alias("_file"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return found.join(starts, F.col("file") == F.col("_file")).select(
        "doc_id", (F.col("place") + F.col("_start")).cast("long").alias("start"), "n_tokens", "ids_crc32")
