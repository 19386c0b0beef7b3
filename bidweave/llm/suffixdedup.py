"""Removal of passages that an earlier document holds, by bucket-pointer refinement of suffixes (operator 11).

A byte goes if a string of `width` bytes that covers it also starts in a document with a smaller doc_id.

1. Documents are stored once, where they lie, in blocks of bounded size, and each later step works block by block.
2. All windows of `width` bytes are cut into runs that share their least gram hash (minimizer). Equal windows have
   equal minimizers, so runs can be routed by it. A block first asks which of its minimizers occur in another block
   (5 bytes each); the answer is a bit each. Runs whose minimizer is in one document only are done.
3. What is left is collapsed inside the block: of equal runs only those of the smallest doc_id travel, with their bytes;
   the others are covered at once. So a passage that many documents share is sent once a block.
4. A task gathers the runs of its minimizers, collapses them again and sorts the suffixes of the distinct ones: buckets of
   equal 8-grams are refined by sorting on the bucket pointers of later positions (8, 16, 32, ... bytes, reusing the
   pointers of the round before) until a bucket holds equal windows; a window is covered if its bucket has a smaller doc_id.
5. Covered windows go back to their block, where the bytes are taken out.

A minimizer that very many documents hold (a common line among different words) is hot: its runs are cut into single windows,
which are routed by the hash of all their bytes. Hashes only route; every comparison is of bytes.

Defined results: a null text is empty. A null doc_id counts as larger than all others. Documents are told apart by doc_id:
rows that repeat one are judged each for itself and take nothing from each other. Texts shorter than `width` stay whole. One
row per row, other columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from bidweave.llm import words as W
from bidweave.llm.common import scratch

BLOCK = 4 << 20  # bytes of texts in a block
STEP = 1 << 20  # windows looked at together
BATCH = 2 << 20  # bytes of runs whose suffixes are sorted together
HOT = 1 << 15  # documents that make a minimizer hot
_LAST = np.iinfo(np.int64).max  # stands for a null doc_id
_LOW = np.uint64((1 << 40) - 1)
_PRIME = np.uint64(0x9E3779B97F4A7C15)

_INTS, _LONGS = pa.list_(pa.int32()), pa.list_(pa.int64())  # a text has less than 2**31 bytes
ASKED = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("grams", pa.binary()), ("weights", pa.binary())])
ANSWERS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("shared", pa.binary()), ("hot", pa.binary())])
COVERED = pa.schema([("block", pa.int64()), ("rows", _INTS), ("starts", _INTS), ("sizes", _INTS)])
RUNS = pa.schema([("block", pa.int64()), ("slot", pa.int32()), ("rows", _INTS), ("starts", _INTS), ("sizes", _INTS), ("keys", _INTS),
                  ("docs", _LONGS), ("bytes", pa.binary())])
KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()),
                  ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])


def gram_length(width: int) -> int:
    return max(8, 2 * width // 5)


def hashes(data: np.ndarray, length: int) -> np.ndarray:
    """64-bit hash of the `length` bytes (8 at least) from each position."""
    count = len(data) - length + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    eights = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), 0, (1,))
    out = np.full(count, np.uint64(length))
    for at in [*range(0, length - 8, 8), length - 8]:
        out = (out ^ eights[at:at + count]) * _PRIME
        out ^= out >> np.uint64(29)
    return W.mix(out)


def minima(data: np.ndarray, width: int) -> np.ndarray:
    """The least gram hash of every window of `width` bytes."""
    found = hashes(data, gram_length(width))
    reach = width - gram_length(width) + 1
    count = len(found) - reach + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    rows = np.concatenate([found, np.full(-len(found) % reach, np.iinfo(np.uint64).max)]).reshape(-1, reach)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:count], left[reach - 1:reach - 1 + count])


def runs_of(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of windows, spread minimizer and row of the runs of neighbouring windows of one minimizer. Windows never
    cross rows; of the temporary arrays there is only a bounded piece at a time, also inside one long row."""
    parts = []
    for low in range(0, max(0, len(data) - width + 1), STEP):
        high = min(low + STEP, len(data) - width + 1)
        least = minima(data[low:high + width - 1], width)
        # windows that start within width - 1 bytes before the end of a row
        ends = offsets[np.searchsorted(offsets, low, "right"):np.searchsorted(offsets, high + width - 1)] - low
        crossing = np.zeros(high - low + 1, np.int64)
        np.add.at(crossing, np.maximum(ends - width + 1, 0), 1)
        np.add.at(crossing, np.minimum(ends, high - low), -1)
        valid = np.cumsum(crossing[:-1]) == 0
        new = np.ones(high - low, bool)
        new[1:] = (least[1:] != least[:-1]) | ~valid[:-1]
        first = np.flatnonzero(new & valid)
        last = np.ones(high - low, bool)
        last[:-1] = new[1:] | ~valid[1:]
        parts.append((first + low, np.flatnonzero(last & valid) - first + 1, W.mix(least[first] + np.uint64(1))))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), none
    starts, sizes, keys = (np.concatenate(c) for c in zip(*parts))
    return starts, sizes, keys, np.searchsorted(offsets, starts, "right") - 1


def spread(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... counts[0] - 1, 0, 1, ... counts[1] - 1, ..."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def gathered(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The pieces of `data` as an Arrow column."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    part = data[np.repeat(starts, lengths) + spread(lengths)]
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(part)])


def collapsed(pieces: pa.Array, docs: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct pieces, the number of each piece among them, and the smallest doc_id of each distinct piece."""
    found = pc.dictionary_encode(pieces)
    codes = found.indices.to_numpy(zero_copy_only=False)
    owners = np.full(len(found.dictionary), _LAST)
    np.minimum.at(owners, codes, docs)
    return found.dictionary, codes, owners


def batches_of(keys: np.ndarray, lengths: np.ndarray, limit: int = BATCH):
    """Ranges of sorted keys of about `limit` bytes that never part equal keys."""
    heads = np.concatenate([np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])), [len(keys)]]) if len(keys) else np.zeros(1, int)
    before = np.concatenate([[0], np.cumsum(lengths)])[heads]
    at = 0
    while at < len(heads) - 1:
        to = max(at + 1, int(np.searchsorted(before, before[at] + limit, "right")) - 1)
        yield int(heads[at]), int(heads[to])
        at = to


def refine(data: np.ndarray, width: int) -> np.ndarray:
    """Bucket pointer of each position: equal where the next `width` bytes are equal, in the order of these bytes.

    The pointer of a bucket is the place of its first suffix in the sorted order. A round sorts the members of each
    bucket that still has several by the pointers `size` bytes later, which doubles the depth that pointers stand for.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    keys = np.ndarray((n,), ">u8", padded, 0, (1,)).astype(np.uint64)
    pointers, live = np.zeros(n + width, np.int64), np.arange(n)
    bases = np.zeros(n, np.int64)  # pointer of the bucket that a live position comes from
    size = 8
    while True:
        order = np.argsort(keys, kind="stable") if size == 8 else np.lexsort((keys, bases))
        live, keys, bases = live[order], keys[order], bases[order]
        moved = np.concatenate([[True], bases[1:] != bases[:-1]]) if len(live) else np.zeros(0, bool)
        head = moved.copy()
        head[1:] |= keys[1:] != keys[:-1]
        places = np.arange(len(live))
        heads = np.flatnonzero(head)
        members = np.diff(np.concatenate([heads, [len(live)]]))
        bucket_start = np.maximum.accumulate(np.where(moved, places, 0))
        pointers[live] = bases + np.repeat(heads, members) - bucket_start
        if size >= width:
            return pointers[:n]
        live = live[np.repeat(members > 1, members)]
        step = min(size, width - size)
        bases, keys = pointers[live], pointers[live + step]
        size += step


def covered_windows(pieces: pa.Array, owners: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Piece, first window and number of windows of the runs of windows that a piece of a smaller owner holds as well."""
    data, offsets = W.utf8(pieces)
    sizes = np.diff(offsets) - width + 1
    piece, at = np.repeat(np.arange(len(sizes)), sizes), spread(sizes)
    bucket = refine(data, width)[offsets[:-1][piece] + at]
    best = np.full(len(data), _LAST)
    np.minimum.at(best, bucket, owners[piece])
    hit = np.flatnonzero(best[bucket] < owners[piece])
    if not len(hit):
        return hit, hit, hit
    new = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (piece[hit[1:]] != piece[hit[:-1]])])
    return piece[hit[new]], at[hit[new]], np.diff(np.concatenate([np.flatnonzero(new), [len(hit)]]))


def merged(starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal ranges of each row, in order; ranges that touch are one."""
    order = np.lexsort((starts, rows))
    starts, ends, rows = starts[order], ends[order], rows[order]
    if not len(starts):
        return starts, ends, rows
    base = np.concatenate([[0], np.cumsum(rows[1:] != rows[:-1])]) * (int(ends.max()) + 1)  # rows lie apart
    reach = np.maximum.accumulate(ends + base)
    new = np.concatenate([[True], (starts + base)[1:] > reach[:-1]])
    new[1:] |= rows[1:] != rows[:-1]
    heads = np.flatnonzero(new)
    return starts[heads], (reach - base)[np.concatenate([heads[1:], [len(starts)]]) - 1], rows[heads]


def _numbers(column) -> np.ndarray:
    return pc.fill_null(column, _LAST).to_numpy()


def _flat(column) -> np.ndarray:
    return pa.chunked_array([c.flatten() for c in column.chunks], column.type.value_type).to_numpy()


def _lists(values: list[np.ndarray], kind=np.int32) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*values, np.zeros(0, kind)]).astype(kind)))


def _raw(values: list) -> pa.Array:
    return pa.array([v.tobytes() if isinstance(v, np.ndarray) else v for v in values], pa.binary())


def _minimizers(table: pa.Table, width: int) -> tuple:
    """Bytes, offsets, row numbers and ids of a block; its runs; its distinct minimizers with the number of their documents,
    and the minimizer of each run."""
    data, offsets = W.utf8(table["text"])
    docs = _numbers(table["doc_id"])
    starts, sizes, keys, rows = runs_of(data, offsets, width)
    order = np.lexsort((docs[rows], keys))
    k, d = keys[order], docs[rows][order]
    key_head = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
    head = key_head.copy()
    head[1:] |= d[1:] != d[:-1]
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(key_head) - 1
    count = np.bincount(np.cumsum(key_head)[head] - 1, minlength=int(key_head.sum()))
    return data, offsets, docs, (starts, sizes, keys, rows), k[key_head], count, number


def _dealt(grams: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each distinct minimizer, and their order by bucket."""
    bucket = ((grams >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
    return bucket, np.argsort(bucket, kind="stable")


def asking(width: int, buckets: int):
    def ask(table: pa.Table) -> pa.Table:
        *_, grams, count, _ = _minimizers(table, width)
        bucket, order = _dealt(grams, buckets)
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0, [True]])) if len(order) else np.zeros(1, int)
        low = (grams & _LOW)[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
        weight = np.rint(8 * np.log2(count[order])).astype(np.uint8)
        parts = list(zip(cuts[:-1], cuts[1:]))
        return pa.table({"block": pa.array([table["block"][0].as_py()] * len(parts), pa.int64()),
                         "bucket": pa.array([int(bucket[order[a]]) for a, _ in parts], pa.int32()),
                         "grams": _raw([low[a:b] for a, b in parts]), "weights": _raw([weight[a:b] for a, b in parts])})
    return ask


def answering(hot: int):
    def answer(table: pa.Table) -> pa.Table:
        raw, ends = W.utf8(table["grams"])
        wide = np.zeros((len(raw) // 5, 8), np.uint8)
        wide[:, :5] = raw.reshape(-1, 5)
        grams, weights = wide.view("<u8").ravel(), 2.0 ** (W.utf8(table["weights"])[0] / 8)
        order = np.argsort(grams, kind="stable")
        head = np.concatenate([[True], np.diff(grams[order]) != 0]) if len(order) else np.zeros(0, bool)
        number = np.empty(len(grams), np.int64)
        number[order] = np.cumsum(head) - 1
        shared = (np.bincount(number) > 1)[number]
        heavy = (np.bincount(number, weights) > hot)[number]
        cuts = ends // 5
        bits = lambda flags: _raw([np.packbits(flags[a:b]) for a, b in zip(cuts[:-1], cuts[1:])])
        return pa.table({"block": table["block"], "bucket": table["bucket"], "shared": bits(shared), "hot": bits(heavy)})
    return answer


def sending(width: int, buckets: int, slots: int):
    def single(data, starts, sizes, keys, rows, heavy):
        """Runs of hot minimizers as single windows, keyed by all their bytes."""
        place, lone = spread(sizes[heavy]), np.repeat(np.flatnonzero(heavy), sizes[heavy])
        begins = starts[lone] + place
        own = np.zeros(len(begins), np.uint64)
        for low in range(0, len(begins), STEP):
            part = begins[low:low + STEP]
            text = gathered(data, part, np.full(len(part), width))
            own[low:low + STEP] = hashes(np.frombuffer(text.buffers()[2], np.uint8), width)[::width]
        cold = ~heavy
        return (np.concatenate([starts[cold], begins]), np.concatenate([sizes[cold], np.ones(len(begins), np.int64)]),
                np.concatenate([keys[cold], own]), np.concatenate([rows[cold], rows[lone]]))

    def send(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return RUNS.empty_table()
        data, offsets, docs, runs, grams, count, number = _minimizers(table, width)
        bucket, order = _dealt(grams, buckets)
        shared, hot = count > 1, np.zeros(len(grams), bool)
        for name, a, b in zip(answers["bucket"].to_pylist(), answers["shared"].to_pylist(), answers["hot"].to_pylist()):
            low, high = np.searchsorted(bucket[order], [name, name + 1])
            at = order[low:high]
            shared[at] |= np.unpackbits(np.frombuffer(a, np.uint8), count=len(at)).astype(bool)
            hot[at] = np.unpackbits(np.frombuffer(b, np.uint8), count=len(at)).astype(bool)
        take = shared[number]
        runs = tuple(c[take] for c in runs)
        heavy = hot[number[take]]
        if heavy.any():
            runs = single(data, *runs, heavy)
        starts, sizes, keys, rows = runs
        block = table["block"][0].as_py()
        slot = (keys % np.uint64(slots)).astype(np.int64)
        order = np.lexsort((keys, slot))
        starts, sizes, keys, rows, slot = starts[order], sizes[order], keys[order], rows[order], slot[order]
        names, sent, done, pack = np.argsort(np.argsort(table["row"].to_numpy())), [], [], pa.Codec("zstd")
        for a, b in batches_of(keys, sizes + width - 1):
            pieces = gathered(data, starts[a:b], sizes[a:b] + width - 1)
            _, codes, owners = collapsed(pieces, docs[rows[a:b]])
            late = docs[rows[a:b]] > owners[codes]
            done.append(a + np.flatnonzero(late))
            own = a + np.flatnonzero(~late)
            for part in np.split(own, np.flatnonzero(np.diff(slot[own])) + 1):
                if len(part):
                    text = W.utf8(pc.take(pieces, pa.array(part - a)))[0]
                    sent.append((int(slot[part[0]]), names[rows[part]], starts[part] - offsets[rows[part]], sizes[part],
                                 (keys[part] >> np.uint64(33)).astype(np.int32), docs[rows[part]], pack.compress(text.tobytes(), asbytes=True)))
        done = np.concatenate([*done, np.zeros(0, np.int64)]).astype(np.int64)
        start, end, row = merged((starts - offsets[rows])[done], (starts - offsets[rows] + sizes)[done], rows[done])
        sent.append((-1 - block % slots, names[row], start, end - start, row[:0], row[:0], b""))
        slots_, *lists, owners, packed = zip(*sent)
        return pa.table([pa.array([block] * len(sent), pa.int64()), pa.array(slots_, pa.int32()),
                         *[_lists(c) for c in lists], _lists(owners, np.int64), pa.array(packed, pa.binary())], names=RUNS.names)
    return send


def sorting(width: int):
    def sort(table: pa.Table) -> pa.Table:
        if table["slot"][0].as_py() < 0:  # ranges that their block has covered by itself pass
            return table.select(COVERED.names)
        rows, starts, sizes, docs, keys = (_flat(table[c]) for c in ("rows", "starts", "sizes", "docs", "keys"))
        lengths, unpack = sizes.astype(np.int64) + width - 1, pa.Codec("zstd")
        data = np.concatenate([np.zeros(0, np.uint8), *[
            np.frombuffer(unpack.decompress(raw, decompressed_size=len(n) * (width - 1) + sum(n)), np.uint8)
            for raw, n in zip(table["bytes"].to_pylist(), table["sizes"].to_pylist())]])
        begins = np.cumsum(lengths) - lengths
        blocks = np.repeat(table["block"].to_numpy(), pc.list_value_length(table["rows"]).to_numpy())
        order = np.argsort(keys, kind="stable")
        found = []
        for a, b in batches_of(keys[order], lengths[order]):
            part = order[a:b]
            pieces, codes, owners = collapsed(gathered(data, begins[part], lengths[part]), docs[part])
            late = docs[part] > owners[codes]
            found.append((part[late], starts[part[late]], sizes[part[late]]))
            own, own_code = part[~late], codes[~late]
            piece, at, many = covered_windows(pieces, owners, width)
            first, number = np.searchsorted(piece, own_code), np.bincount(piece, minlength=len(owners))[own_code]
            run = np.repeat(first, number) + spread(number)
            own = np.repeat(own, number)
            found.append((own, starts[own] + at[run], many[run]))
        who, start, size = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        order = np.argsort(blocks[who], kind="stable")
        who, start, size = who[order], start[order], size[order]
        cuts = np.concatenate([np.flatnonzero(np.concatenate([[True], np.diff(blocks[who]) != 0])), [len(who)]]) if len(who) else np.zeros(1, int)
        spans = list(zip(cuts[:-1], cuts[1:]))
        return pa.table([pa.array([int(blocks[who[a]]) for a, _ in spans], pa.int64()),
                         *[_lists([c[a:b] for a, b in spans]) for c in (rows[who], start, size)]], names=COVERED.names)
    return sort


def taking_out(width: int):
    def take_out(table: pa.Table, covered: pa.Table) -> pa.Table:
        data, offsets = W.utf8(table["text"]) if table.num_rows else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
        rows, starts, sizes = (_flat(covered[c]).astype(np.int64) for c in ("rows", "starts", "sizes"))
        place = np.argsort(table["row"].to_numpy())[rows]  # rows of a block are counted in the order of their numbers
        start, end, row = merged(starts, starts + sizes - 1 + width, place)
        first = np.searchsorted(row, np.arange(table.num_rows + 1))
        # the kept parts of a row lie before, between and after its ranges
        kept = []
        for i, (a, b) in enumerate(zip(first[:-1], first[1:])):
            whole = data[offsets[i]:offsets[i + 1]]
            cuts = np.concatenate([[0], np.stack([start[a:b], end[a:b]], 1).ravel(), [len(whole)]])
            kept.append(b"".join(whole[x:y].tobytes() for x, y in zip(cuts[::2], cuts[1::2])))
        spans = pa.StructArray.from_arrays([pa.array(start), pa.array(end)], names=["start", "end"])
        return pa.table([table["doc_id"], pa.array(np.diff(offsets)), pa.ListArray.from_arrays(first.astype(np.int32), spans), pa.array(kept, pa.binary())],
                        names=KEPT.names)
    return take_out


def in_blocks(docs: DataFrame, block: int) -> tuple[DataFrame, int, str]:
    """The texts as a table bucketed by block, the number of blocks, and the table's name. A task cuts its own rows into blocks, so
    texts are not shuffled, neither here nor when later steps read the table by block."""
    def number(batches):
        part, count, size, rows = TaskContext.get().partitionId() << 24, 0, 0, 0
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64) + 16
            names = np.empty(len(lengths), np.int64)
            for i, length in enumerate(lengths.tolist()):
                if size and size + length > block:
                    count, size = count + 1, 0
                names[i], size = part + count, size + length
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.arange(rows, rows + len(names))), pa.array(names)],
                                             names=["doc_id", "text", "row", "block"])
            rows += len(names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    blocks = max(1, math.ceil(total / block))
    files, name = max(1, math.ceil(blocks / 4)), f"blocks_{uuid.uuid4().hex}"
    (rows.mapInArrow(number, "doc_id long, text string, row long, block long").write.format("parquet").option("compression", "zstd")
     .option("path", scratch(docs.sparkSession, "blocks")).bucketBy(files, "block").saveAsTable(name))
    return docs.sparkSession.table(name), blocks, name


def drop_repeats(docs: DataFrame, width: int = 50, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): removed byte ranges, which neither touch nor overlap, and the bytes that stay."""
    if width < 8:
        raise ValueError("strings have 8 bytes at least")
    base, blocks, name = in_blocks(docs, block)
    buckets, slots = max(1, math.ceil(blocks * block / (32 << 20))), blocks
    asked = base.groupBy("block").applyInArrow(asking(width, buckets), from_arrow_schema(ASKED))
    answers = asked.groupBy("bucket").applyInArrow(answering(hot), from_arrow_schema(ANSWERS))
    runs = base.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(sending(width, buckets, slots), from_arrow_schema(RUNS))
    covered = runs.groupBy("slot").applyInArrow(sorting(width), from_arrow_schema(COVERED))
    kept = base.groupBy("block").cogroup(covered.groupBy("block")).applyInArrow(taking_out(width), from_arrow_schema(KEPT))
    docs.sparkSession.sql(f"DROP TABLE {name}")  # the files stay as long as the session, and the plan names them
    return kept
