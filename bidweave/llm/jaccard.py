"""Grouped prefix join: documents whose word shingles are similar (operator 8).

Sets: distinct runs of `size` words of the whole text (A to Z lower-cased), as 64-bit hashes.
Documents link when `percent` or more of the union is shared.

1. All shingles are counted in a table of counters of fixed size. The order of shingles is (level of
   the counter, hash). Any order that all documents share makes the prefix filter exact; this one puts
   frequent shingles last, so passages that many documents share stay out of the prefixes.
2. Documents with equal sets are one class. Two similar sets share a shingle of their prefixes (the first
   n - ceil(t n) + 1 in the order). Classes with the same prefix and size are collapsed into one group,
   and only groups enter the join on prefix shingles; shingles of a single group drop out there.
3. The groups that meet at a shingle, or the members of one group, are expanded to a cell of classes (a bounded block
   against a bounded block). Inside its task a cell compares sizes and parity bitmaps of the sets: differing bits are at
   most the differing shingles, so a pair that fails cannot link. Of the pairs that pass, a cell passes on a spanning
   forest, best first, and tells if it held others back. These pairs are verified and make components.
4. Shingles that held pairs back and still lie in several components are compared again, and now every pair of different
   components that passes is verified. So no link between components is lost, and pairs inside a component need
   no further look.

Verification compares whole sets, made again from the texts of the documents concerned.

Defined results: a null text, or one without a word, has an empty set and links with nothing. Fewer words than
`size` make one shingle. Rows are kept as they are; rows of equal sets are linked. component_id ignores
null doc_ids unless there is no other; a document with an empty set is its own component. Other columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidweave.llm import words as W
from bidweave.llm.bitfilter import bit_table, may_meet
from bidweave.llm.common import components, packed, partitions, row_hash, stored

SKETCH_BITS = 22  # 16 MiB of counters, whatever the size of the input
_BLOCK = 1 << 14  # counters in a block that is sent
CELL = 1024  # members of a shingle that a block holds


def text_sets(column, size: int):
    """Yield the sorted distinct shingle hashes of each text."""
    data, offsets = W.utf8(column)
    for first, last in W.slices(offsets):
        edges = offsets[first:last + 1] - offsets[first]
        starts, _, hashes = W.words(data[offsets[first]:offsets[last]], edges, fold=True)
        bounds = np.searchsorted(starts, edges)
        for row in range(last - first):
            yield W.shingles(hashes[bounds[row]:bounds[row + 1]], size)


def set_key(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


# ---- counters ------------------------------------------------------------------------------------

def add_counters(partial: DataFrame, bits: int) -> np.ndarray:
    """Sum of partial counters (block, counts), block by block as they stream in."""
    def merge(batches):
        total = {}
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts = np.frombuffer(raw.as_py(), "<u4").astype(np.uint64)
                total[block] = total[block] + counts if block in total else counts
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int64()), pa.array([np.minimum(v, 2**32 - 1).astype("<u4").tobytes() for v in total.values()], pa.binary())],
            names=["block", "counts"])

    blocks = partial.repartition(min(1 << 8, max(1, (1 << bits) // _BLOCK)), "block").mapInArrow(merge, "block long, counts binary").toArrow()
    out = np.zeros(1 << bits, np.uint32)
    width = min(_BLOCK, 1 << bits)
    for block, raw in zip(blocks["block"].to_pylist(), blocks["counts"].to_pylist()):
        out[block * width:(block + 1) * width] = np.frombuffer(raw, "<u4")
    return out


def _emit_counters(counts: np.ndarray):
    width = min(_BLOCK, len(counts))
    parts = counts.reshape(-1, width)
    for block in np.flatnonzero(parts.any(1)):
        yield pa.RecordBatch.from_arrays([pa.array([int(block)], pa.int64()), pa.array([parts[block].astype("<u4").tobytes()], pa.binary())],
                                         names=["block", "counts"])


def shingle_counters(docs: DataFrame, size: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """How often each cell of the hash space occurs in the sets of all documents."""
    def count(batches):
        counts = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            pending, rows = [], 0
            for values in text_sets(batch.column(0), size):
                pending.append(values >> np.uint64(64 - bits))
                rows += len(values)
                if rows > 1 << 18:
                    counts += np.bincount(np.concatenate(pending).astype(np.int64), minlength=1 << bits).astype(np.uint32)
                    pending, rows = [], 0
            if pending:
                counts += np.bincount(np.concatenate(pending).astype(np.int64), minlength=1 << bits).astype(np.uint32)
        yield from _emit_counters(counts)

    return add_counters(docs.select("text").mapInArrow(count, "block long, counts binary"), bits)


# ---- sets, prefixes, bitmaps -----------------------------------------------------------------

def need(n: int, percent: int) -> int:
    """Smallest overlap that a set of n shingles needs with any similar set: ceil(t n)."""
    return -(-percent * n // 100)


def bitmap(values: np.ndarray) -> np.ndarray:
    """Parity of the shingles that fall on each bit; one to two bits per shingle, a power of two of them."""
    size = max(64, 1 << (len(values) - 1).bit_length())
    odd = np.bincount((values & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<u8")


def fold_bitmap(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmap of the same set with fewer bits; rows of a matrix at once."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def may_link(n_a, n_b, differing, percent: int):
    """Whether sets of these sizes can link when at least `differing` shingles are in one of them only."""
    # overlap <= (n_a + n_b - differing) / 2, and 100 overlap >= percent (n_a + n_b - overlap)
    total = n_a + n_b
    return (100 + percent) * (total - differing) >= 2 * percent * total


def set_rows(docs: DataFrame, counters: np.ndarray, size: int, percent: int, bits: int = SKETCH_BITS) -> DataFrame:
    """Per row (doc_id, hash, n, set, gid, prefix, bitmap); prefix and bitmap are null in repeats of a set within a task.
    `hash` is that of the whole row, `gid` that of prefix and size (equal ids of different prefixes would only add candidates)."""
    shared = docs.sparkSession.sparkContext.broadcast(np.floor(2 * np.log2(np.maximum(counters, 1))).astype(np.uint8))

    def run(batches):
        levels, seen = shared.value, {}
        for batch in batches:
            rows = []

            def flush(done):
                cols = list(zip(*rows)) or [[]] * 5
                own = batch.slice(done - len(rows), len(rows))
                return pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(1), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int64()),
                     *(pa.array(c, pa.binary()) for c in cols[3:])], names=["doc_id", "hash", "n", "set", "gid", "prefix", "bitmap"])
            for at, values in enumerate(text_sets(batch.column(2), size)):
                n = len(values)
                key = set_key(values) if n else None
                if n == 0:
                    rows.append((0, None, None, None, None))
                elif key in seen:
                    rows.append((n, key, seen[key], None, None))
                else:
                    order = np.argsort(levels[(values >> np.uint64(64 - bits)).astype(np.int64)], kind="stable")
                    prefix = np.sort(values[order[:n - need(n, percent) + 1]]).astype("<u8").tobytes()
                    gid = int.from_bytes(hashlib.blake2b(prefix + n.to_bytes(8, "little"), digest_size=8).digest(), "little", signed=True)
                    if len(seen) < 1 << 18:
                        seen[key] = gid
                    rows.append((n, key, gid, prefix, bitmap(values).tobytes()))
                if len(rows) == 1000:
                    yield flush(at + 1)
                    rows = []
            yield flush(batch.num_rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash(docs).alias("hash"), "text").mapInArrow(
        run, "doc_id long, hash long, n long, set binary, gid long, prefix binary, bitmap binary")


def prefix_tokens(rows: DataFrame) -> DataFrame:
    """(token, gid): one row per prefix shingle of each group and task."""
    def run(batches):
        seen = set()
        for batch in batches:
            for low in range(0, batch.num_rows, 2000):
                part = batch.slice(low, 2000)
                gids, raw = [], []
                for gid, prefix in zip(part.column(0).to_pylist(), part.column(1)):
                    if gid not in seen:
                        if len(seen) < 1 << 20:
                            seen.add(gid)
                        gids.append(gid)
                        raw.append(np.frombuffer(prefix.as_py(), "<i8"))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(raw) if raw else np.zeros(0, np.int64)),
                                                  pa.array(np.repeat(np.array(gids, np.int64), [len(x) for x in raw]))], names=["token", "gid"])
    return rows.filter(F.col("prefix").isNotNull()).select("gid", "prefix").mapInArrow(run, "token long, gid long")


def shared_tokens(tokens: DataFrame) -> DataFrame:
    """The rows (token, gid) of tokens that two groups or more hold.

    Rows stream by in the order of (token, gid); of a token only its first group is held back, until a
    second one shows that the token is shared.
    """
    def run(batches):
        token = gid = None
        open_ = False  # the token's first group is still held back
        for batch in batches:
            if not batch.num_rows:
                continue
            t, g = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            fresh = np.ones(len(t), bool)  # not a repeat of the row before
            fresh[1:] = (t[1:] != t[:-1]) | (g[1:] != g[:-1])
            fresh[0] = (t[0], g[0]) != (token, gid)
            t, g = t[fresh], g[fresh]
            if not len(t):
                continue
            starts = np.ones(len(t), bool)
            starts[1:] = t[1:] != t[:-1]
            starts[0] = t[0] != token
            followed = np.zeros(len(t), bool)
            followed[:-1] = ~starts[1:]
            keep = ~starts | followed
            out_t, out_g = t[keep], g[keep]
            if open_ and not starts[0]:
                out_t, out_g = np.concatenate([[token], out_t]), np.concatenate([[gid], out_g])
            token, gid, open_ = t[-1], g[-1], bool(starts[-1])
            yield pa.RecordBatch.from_arrays([pa.array(out_t.astype(np.int64)), pa.array(out_g.astype(np.int64))], names=["token", "gid"])

    n = partitions(tokens.sparkSession)
    return tokens.repartition(n, "token").sortWithinPartitions("token", "gid").mapInArrow(run, "token long, gid long")


# ---- pairs -------------------------------------------------------------------------------------

def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int, bits: int = SKETCH_BITS) -> DataFrame:
    """The pairs whose whole sets are similar enough. Sets are made again for the documents concerned:
    a bit table of their doc_ids (fixed size) passes over the others, and a join on the set decides."""
    pairs = stored(pairs, "candidates")
    ends = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()
    wanted = stored(classes.join(ends, "cls").select("cls", "set", "rep"), "wanted")

    def mark(batches):
        counts = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            ids = W.mix(np.asarray(batch.column(0).fill_null(0)).astype(np.int64).view(np.uint64))
            counts[(ids >> np.uint64(64 - bits)).astype(np.int64)] = 1
        yield from _emit_counters(counts)

    marks = add_counters(wanted.select("rep").mapInArrow(mark, "block long, counts binary"), bits) > 0
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(marks))

    def again(batches):
        marked = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            ids = W.mix(np.asarray(batch.column(0).fill_null(0)).astype(np.int64).view(np.uint64))
            texts = batch.column(1).filter(pa.array(marked[(ids >> np.uint64(64 - bits)).astype(np.int64)]))
            for low in range(0, len(texts), 500):
                sets = [x for x in text_sets(texts.slice(low, 500), size) if len(x)]
                yield pa.RecordBatch.from_arrays([pa.array([set_key(x) for x in sets], pa.binary()),
                                                  pa.array([x.astype("<u8").tobytes() for x in sets], pa.binary())], names=["set", "shingles"])

    sets = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(again, "set binary, shingles binary")
    sets = stored(sets.join(wanted, "set").groupBy("cls").agg(F.first("shingles").alias("shingles")), "sets")

    def compare(batches):
        for batch in batches:
            keep = []
            last, x = None, None
            for a, raw_x, raw_y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if a != last:
                    last, x = a, np.frombuffer(raw_x.as_py(), "<u8")
                y = np.frombuffer(raw_y.as_py(), "<u8")
                shared_ = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared_ >= percent * (len(x) + len(y) - shared_))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    both = (pairs.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("s_a")), "a")
            .join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("s_b")), "b"))
    return both.select("a", "b", "s_a", "s_b").mapInArrow(compare, "a long, b long")


def _passing(side, cls, n, comp, raw, percent: int):
    """(i, j, differing) of the pairs of a cell, of different components, that sizes and bitmaps allow to link."""
    m = len(n)
    if m <= 6:  # most cells: plain integers
        out = []
        maps = [None] * m
        for i in range(m):
            for j in range(i + 1, m):
                small, large = min(n[i], n[j]), max(n[i], n[j])
                if comp[i] == comp[j] or 100 * small < percent * large or (side[i] == side[j] and side[i] != 2):
                    continue
                for k in (i, j):
                    if maps[k] is None:
                        maps[k] = int.from_bytes(raw[k], "little")
                x, y, wide_x, wide_y = maps[i], maps[j], len(raw[i]), len(raw[j])
                while wide_x > wide_y:
                    wide_x //= 2
                    x = (x >> 8 * wide_x) ^ (x & (1 << 8 * wide_x) - 1)
                while wide_y > wide_x:
                    wide_y //= 2
                    y = (y >> 8 * wide_y) ^ (y & (1 << 8 * wide_y) - 1)
                differing = (x ^ y).bit_count()
                if may_link(n[i], n[j], differing, percent):
                    out.append((i, j, differing))
        return out
    order = sorted(range(m), key=lambda i: n[i])
    sizes, comps, sides = np.array(n)[order], np.array(comp)[order], np.array(side)[order]
    maps = [np.frombuffer(raw[i], "<u8") for i in order]
    widths = np.array([len(x) for x in maps])
    tables = {int(w): np.array([fold_bitmap(x, int(w)) if len(x) >= w else np.zeros(int(w), np.uint64) for x in maps]) for w in np.unique(widths)}
    last = np.searchsorted(sizes, 100 * sizes // percent, "right")
    out = []
    for i in range(m - 1):
        others = np.arange(i + 1, last[i])
        others = others[(comps[others] != comps[i]) & ((sides[others] != sides[i]) | (sides[i] == 2))]
        if len(others):
            table = tables[int(widths[i])]
            differing = np.bitwise_count(table[others] ^ table[i]).sum(1).astype(np.int64)
            good = may_link(sizes[i], sizes[others], differing, percent)
            out.extend((order[i], order[j], d) for j, d in zip(others[good].tolist(), differing[good].tolist()))
    return out


def _forest(pairs, n, comp):
    """(pairs of a spanning forest over the components, the most similar first; whether others were left out)."""
    parent: dict = {}

    def root(x):
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x
    kept = []
    for i, j, differing in sorted(pairs, key=lambda p: p[2] / (n[p[0]] + n[p[1]])):
        a, b = root(comp[i]), root(comp[j])
        if a != b:
            parent[a] = b
            kept.append((i, j, differing))
    return kept, len(kept) < len(pairs)


def cell_pairs(rows: DataFrame, percent: int, forest: bool) -> DataFrame:
    """(a, b, token): pairs of classes to verify (token null), and tokens that held pairs back (a, b null).

    rows: (token, cell, side, cls, n, component, bitmap). Side 0 meets side 1 of its cell; in a
    cell with side 2 only, all rows meet each other. Rows of a cell come sorted next to each other, and a cell is bounded.
    """
    def run(batches):
        held, key = [], None
        found, back = set(), set()

        def close():
            if len(held) > 1:
                side, cls, n, comp, raw = zip(*held)
                pairs = _passing(side, cls, n, comp, raw, percent)
                if forest and len(pairs) > 1:
                    pairs, more = _forest(pairs, n, comp)
                    if more:
                        back.add(key[0])
                found.update((min(cls[i], cls[j]), max(cls[i], cls[j])) for i, j, _ in pairs)

        def flush():
            a, b = zip(*found) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array([*a, *[None] * len(back)], pa.int64()), pa.array([*b, *[None] * len(back)], pa.int64()),
                                               pa.array([*[None] * len(a), *back], pa.int64())], names=["a", "b", "token"])
        for batch in batches:
            for token, cell, *row in zip(*[c.to_pylist() for c in batch.columns]):
                if (token, cell) != key:
                    close()
                    held, key = [], (token, cell)
                held.append(row)
            if len(found) > 1 << 18:
                yield flush()
                found, back = set(), set()
        close()
        yield flush()

    n = partitions(rows.sparkSession)
    routed = rows.select("token", "cell", "side", "cls", "n", "component", "bitmap").repartition(n, "token", "cell").sortWithinPartitions("token", "cell")
    return routed.mapInArrow(run, "a long, b long, token long")


def _cells(shared: DataFrame, placed: DataFrame, cell: int) -> DataFrame:
    """Rows of cell_pairs for the tokens of `shared` (token, gid) whose classes lie in several components.
    A token with more than `cell` classes is cut into blocks, and every two blocks meet in a cell of their own."""
    span = placed.groupBy("gid").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"))
    wide = (shared.join(span, "gid").groupBy("token").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("size").alias("m"))
            .filter("low <> high").select("token", F.ceil(F.col("m") / cell).cast("int").alias("blocks")))
    return (shared.join(wide, "token").join(placed, "gid")
            .withColumn("mine", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("cell", F.least("mine", "other") * F.col("blocks") + F.greatest("mine", "other"))
            .withColumn("side", F.when(F.col("mine") == F.col("other"), 2).otherwise((F.col("mine") > F.col("other")).cast("int"))))


def linked_rows(docs: DataFrame, size: int, percent: int, bits: int = SKETCH_BITS, cell: int = CELL) -> DataFrame:
    """Per row: (doc_id, hash, n, component, component_id); component numbers the linked sets, null for an empty one."""
    counters = shingle_counters(docs, size, bits)
    rows = stored(set_rows(docs, counters, size, percent, bits), "shingles")

    # classes of equal sets, numbered; groups are their prefix and size
    classes = rows.filter(F.col("set").isNotNull()).groupBy("set").agg(
        F.first("n").alias("n"), F.first("gid").alias("gid"), F.first("bitmap", True).alias("bitmap"), F.min("doc_id").alias("rep"))
    classes = stored(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    several = classes.groupBy("gid").agg(F.count("*").alias("m")).filter("m > 1").select(F.col("gid").alias("token"), "gid")
    shared = stored(shared_tokens(prefix_tokens(rows)).union(several), "shared")

    placed = classes.select("cls", "gid", "n", "bitmap", F.col("cls").alias("component"))
    for forest in (True, False):
        cells = stored(cell_pairs(_cells(shared, placed, cell), percent, forest), "cells")
        links = verified(cells.filter("token is null").select("a", "b").distinct(), classes, docs, size, percent, bits)
        part = placed.select("cls", "component")
        crossing = (links.join(part.select(F.col("cls").alias("a"), F.col("component").alias("ca")), "a")
                    .join(part.select(F.col("cls").alias("b"), F.col("component").alias("cb")), "b")
                    .select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        merged = components(crossing).select(F.col("node").alias("component"), F.col("component").alias("whole"))
        placed = stored(placed.join(merged, "component", "left").select("cls", "gid", "n", "bitmap", F.coalesce("whole", "component").alias("component")),
                        "placed")
        shared = shared.join(cells.filter("token is not null").select("token").distinct(), "token", "left_semi")

    named = classes.select("cls", "set", "rep").join(placed.select("cls", "component"), "cls")
    smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_set = named.join(smallest, "component").select(F.col("set").alias("_set"), "component", "component_id")
    return rows.join(by_set, F.col("set") == F.col("_set"), "left").select(
        "doc_id", "hash", "n", "component", F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def similar_documents(docs: DataFrame, size: int = 4, percent: int = 85, bits: int = SKETCH_BITS, cell: int = CELL) -> DataFrame:
    """Per row: (doc_id, n_shingles, component_id)."""
    return linked_rows(docs, size, percent, bits, cell).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def drop_similar(docs: DataFrame, size: int = 5, percent: int = 80, bits: int = SKETCH_BITS, cell: int = CELL) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each component the row with the smallest doc_id
    (null last, then by the hash of the row); documents with an empty set stay."""
    rows = stored(linked_rows(docs, size, percent, bits, cell).filter(F.col("component").isNotNull()), "linked")
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id"), F.col("hash").alias("h"))
    heads = rows.groupBy("component").agg(F.min(order).alias("first"), F.count("*").alias("rows")).filter("rows > 1")
    # rows of components of several rows, and whether they stay
    decided = stored(rows.join(heads, "component").select(F.col("hash").alias("__hash"), (order == F.col("first")).alias("__stays")).distinct(), "decided")
    keyed = docs.select(packed(docs), row_hash(docs).alias("__row"))
    meets = may_meet(keyed, F.col("__row"), bit_table(decided, "__hash"))  # the others have no similar document
    joined = keyed.filter(meets).join(decided, F.col("__row") == F.col("__hash"), "left")
    alone = joined.filter(F.col("__stays").isNull())
    first = joined.filter("__stays").dropDuplicates(["__row"])
    return keyed.filter(~meets).select("__all.*").unionByName(alone.select("__all.*")).unionByName(first.select("__all.*"))
