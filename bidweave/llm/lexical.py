"""Ranked lexical search, term at a time with limited accumulators (operator 13).

Documents are read once: their terms are counted inside the row and only those that an item asks for are stored, as numbers.
Counts of documents per term then give the weights. A task turns its stored rows into blocks of postings and ranks every item in
each block: terms are taken from the rarest to the most frequent, and each adds its part to the accumulators of its documents. As
soon as the bounds of the terms still to come add up to less than the k-th partial score, a document without an accumulator
cannot reach the best k any more: no new ones are made, and the rest of the terms only update those that exist, exactly. The best k of
a task so far are a lower bound for its next block. Every task passes on k rows per item at most.

The terms of all items are known to every task, so items are dealt into groups whose terms fit; the groups run one after the other,
and each group reads the documents anew. An item itself is never cut.

Scores are integers, so the order of addition does not matter. Products that leave 64 bits are taken in Python integers.

Defined results: a null or empty text has no terms. Each row of either table counts for itself, also if it repeats an id: an item that
occurs twice is ranked twice. Null ids are ranked too; a null doc_id comes last among equal scores. An item without a known term, or
over an empty table, has no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from bidweave.llm import words as W
from bidweave.llm.common import stored
from bidweave.operators.keys import top_k

GROUP_BYTES = 32 << 20  # terms of the items that are asked together
BLOCK_POSTINGS = 1 << 21
BLOCK_DOCS = 1 << 16
_PART = 1 << 20  # bytes of a text that are split at once
_LAST = np.iinfo(np.int64).max  # stands for a null doc_id
# letters and digits of ASCII and every byte of a longer character belong to terms; A to Z are lower-cased
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

COUNTED = pa.schema([("row", pa.int64()), ("term", pa.binary()), ("times", pa.int64())])
POSTINGS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])
RANKED = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of a bounded part of it."""
    rest = b""
    for low in range(0, len(text), _PART):
        part = rest + text[low:low + _PART].translate(_FOLD)
        cut = part.rfind(b" ") + 1 if low + _PART < len(text) else len(part)
        rest = part[cut:]
        yield part[:cut].split()


def count_terms(text: bytes) -> tuple[int, Counter]:
    """Number of terms and how often each occurs."""
    n, found = 0, Counter()
    for part in terms(text):
        n += len(part)
        found.update(part)
    return n, found


def _texts(column) -> Iterator[bytes]:
    data, offsets = W.utf8(column)
    for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield data[low:high].tobytes()


def item_terms(items: DataFrame) -> DataFrame:
    """(row, term, times) of each item."""
    def count(batches):
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), _texts(batch.column(1))):
                found = count_terms(text)[1]
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(found), pa.int64()), pa.array(list(found), pa.binary()),
                                                  pa.array(list(found.values()), pa.int64())], schema=COUNTED)
    return items.select("row", "text").mapInArrow(count, from_arrow_schema(COUNTED))


def postings(docs: DataFrame, vocabulary) -> DataFrame:
    """(doc_id, n, ids, tfs) of each document that has a term: the number of its terms, and those of the broadcast vocabulary."""
    def count(batches):
        known = vocabulary.value
        for batch in batches:
            ids, lengths, numbers, times, sizes = batch.column(0).to_numpy(zero_copy_only=False), [], [], [], []
            keep = []
            for place, text in enumerate(_texts(batch.column(1))):
                n, found = count_terms(text)
                if n:
                    hit = known.keys() & found.keys()
                    keep.append(place)
                    lengths.append(n)
                    sizes.append(len(hit))
                    numbers += [known[t] for t in hit]
                    times += [found[t] for t in hit]
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep, pa.int64())), pa.array(lengths, pa.int64()),
                 pa.ListArray.from_arrays(ends, pa.array(numbers, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(times, pa.int32()))], schema=POSTINGS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, from_arrow_schema(POSTINGS))


def _times(a: np.ndarray, b: int) -> np.ndarray:
    """a * b, in Python integers where 64 bits are too few."""
    return a * b if int(a.max(initial=0)) * abs(b) < 2**63 else a.astype(object) * b


class Block:
    """Postings of some documents, by term, with the part of a score that each posting stands for."""

    def __init__(self, doc_ids: np.ndarray, n: np.ndarray, ids: np.ndarray, tfs: np.ndarray, sizes: np.ndarray, weights: np.ndarray, count: int, length: int):
        self.doc_ids = doc_ids
        norm = 100 - 75 + (_times(n, 75 * count) // length).astype(np.int64)
        docs = np.repeat(np.arange(len(n)), sizes)
        order = np.argsort(ids, kind="stable")
        ids, self.docs, tf = ids[order], docs[order], tfs[order].astype(np.int64)
        self.parts = weights[ids] * ((1_000_000_000 * tf) // (1000 * tf + 8 * norm[self.docs]))
        heads = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
        self.places = {t: (a, b) for t, a, b in zip(ids[heads].tolist(), heads.tolist(), [*heads[1:].tolist(), len(ids)])}
        self.bounds = dict(zip(self.places, np.maximum.reduceat(self.parts, heads).tolist() if len(heads) else []))

    def best(self, asked: list[tuple[int, int]], k: int, floor: int = 1) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents that reach `floor` and may be among the best k, their scores, and how many accumulators were made.

        asked: (term, times) from the rarest term on.
        """
        asked = [(t, times, self.bounds[t] * times) for t, times in asked if t in self.places]
        left, so_far, kth, creating = sum(a[2] for a in asked), 0, floor, True
        scores = np.zeros(len(self.doc_ids), np.int64)
        held = np.zeros(len(self.doc_ids), bool)
        for t, times, bound in asked:
            if creating and left < kth:
                creating = False
            a, b = self.places[t]
            docs, parts = self.docs[a:b], self.parts[a:b]
            if not creating:
                stay = held[docs]
                docs, parts = docs[stay], parts[stay]
            else:
                held[docs] = True
            scores[docs] += parts * times
            left, so_far = left - bound, so_far + bound
            if creating and left < so_far and len(scores) >= k:  # the k-th partial score can be above what is left
                kth = max(kth, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
        if len(scores) >= k:
            kth = max(kth, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
        hit = np.flatnonzero(scores >= max(kth, 1))
        return hit, scores[hit], int(held.sum())


def rank(found: DataFrame, asked, weights, count: int, length: int, k: int) -> DataFrame:
    """(item, doc_id, score): the best k of every task. asked and weights are broadcast."""
    def scan(batches):
        items, weight = asked.value, weights.value
        tops = {item: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for item in items}

        def flush(parts):
            doc_ids = np.concatenate([pc.fill_null(p.column(0), _LAST).to_numpy() for p in parts])
            n = np.concatenate([p.column(1).to_numpy() for p in parts])
            ids, tfs = (np.concatenate([p.column(c).flatten().to_numpy() for p in parts]) for c in (2, 3))
            sizes = np.concatenate([pc.list_value_length(p.column(2)).to_numpy() for p in parts])
            block = Block(doc_ids, n, ids, tfs, sizes, weight, count, length)
            for item, wanted in items.items():
                top_ids, top_scores = tops[item]
                hit, scores, _ = block.best(wanted, k, int(top_scores[-1]) if len(top_scores) == k else 1)
                ids_, scores = np.concatenate([top_ids, doc_ids[hit]]), np.concatenate([top_scores, scores])
                order = np.lexsort((ids_, -scores))[:k]
                tops[item] = ids_[order], scores[order]

        parts, rows, size = [], 0, 0
        for batch in batches:
            parts.append(batch)
            rows, size = rows + batch.num_rows, size + len(batch.column(2).flatten())
            if rows >= BLOCK_DOCS or size >= BLOCK_POSTINGS:
                flush(parts)
                parts, rows, size = [], 0, 0
        if rows:
            flush(parts)
        for item, (ids, scores) in tops.items():
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(ids), pa.int64()), pa.array(ids, mask=ids == _LAST), pa.array(scores)], schema=RANKED)

    return found.mapInArrow(scan, from_arrow_schema(RANKED))


def search(docs: DataFrame, items: DataFrame, k: int = 10, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item."""
    spark = docs.sparkSession
    named = stored(items.select(F.monotonically_increasing_id().alias("row"), F.col("item_id").cast("long").alias("item_id"), "text"), "items")
    wanted = stored(item_terms(named), "terms")
    size = wanted.agg(F.sum(F.octet_length("term") + 100)).first()[0] or 0
    groups = max(1, math.ceil(2 * size / group_bytes))
    results = []
    for group in range(groups):
        asked = wanted.filter(F.pmod(F.xxhash64("row"), F.lit(groups)) == group).toArrow()
        terms_ = pc.unique(asked["term"]).to_pylist()
        if not terms_:
            continue
        number = {t: i for i, t in enumerate(terms_)}
        found = stored(postings(docs, spark.sparkContext.broadcast(number)), "postings")
        whole = found.agg(F.count("*").alias("count"), F.sum("n").alias("length")).first()
        count, length = whole["count"], whole["length"]
        if not count:
            break
        df = F.col("df")
        known = found.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("df")).select(
            "id", "df", F.floor(1000 * F.log((2 * F.lit(float(count)) + 2) / (2 * df + 1))).alias("weight")).toArrow()
        weights, frequency = np.zeros(len(terms_), np.int64), np.zeros(len(terms_), np.int64)
        weights[known["id"].to_numpy()], frequency[known["id"].to_numpy()] = known["weight"].to_numpy(), known["df"].to_numpy()
        questions: dict[int, list] = {}
        for row, term, times in zip(asked["row"].to_pylist(), asked["term"].to_pylist(), asked["times"].to_pylist()):
            questions.setdefault(row, []).append((number[term], times))
        for row in questions:
            questions[row].sort(key=lambda a: (frequency[a[0]], a[0]))
        results.append(rank(found, spark.sparkContext.broadcast(questions), spark.sparkContext.broadcast(weights), count, length, k))
    if not results:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = results[0]
    for more in results[1:]:
        best = best.unionByName(more)
    best = top_k(best, k, [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], ["item"], "rank")
    return best.join(named.select(F.col("row").alias("item"), "item_id"), "item").select("item_id", "rank", "doc_id", "score")
