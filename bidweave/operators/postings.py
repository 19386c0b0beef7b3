"""Inverted postings in blocks of documents, with the largest part of a score that each list holds.

A block is a run of documents that one task sees together, in the order of their ids. It is one row of bounded size: its terms, for each
term the places of its documents and how often they name it, and the ids and lengths of all its documents. An index that is
built and searched in one session stays like this, and no posting is ever moved.

A stored index holds one row per term and block: places, counts, lengths and `best`, the most that the term can add to the score of a
document of the block. Lists are as long as a block at most, so a frequent term has many rows. The rows are bucketed and
sorted by term: a search opens the buckets of its terms and reads nothing else, and it knows from `best` which blocks it can leave out.

Scoring adds up the parts of all queries in one matrix of bounded size per block. A task holds the best k of its blocks, so that a
wide k, which no block can cut, does not pass on every document that shares a term with a query.

Where many queries ask a small index, the index goes to the queries: a query becomes the numbers of the terms that the index holds, and a
task scores some queries at a time against all blocks. Neither texts nor pairs of a query and a document are moved.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BLOCK_DOCS, BLOCK_TOKENS = 1000, 2_000_000  # a block ends with either
CELLS = 4 * 1024 * 1024  # scores, or postings, that a step holds at once: 32 MiB
HELD_ROWS = 1024 * 1024  # hits that a task holds before it passes them on
OUT_ROWS = 64 * 1024
PUSHED_TERMS = 500  # up to so many terms are pushed into the scan
HELD_BYTES = 16 * 1024 * 1024  # rows of one query that a task gathers before it adds them up

# Okapi constants: term saturation and length weight
K1, B = 1.5, 0.75


def part(tf, dl, avgdl: float):
    """What a term that occurs tf times adds to the score of a document of dl terms, before its weight; columns or arrays."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def _ints(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values.astype(np.int32)))


def _flat(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays([pa.array([], column.type.value_type), *[c.flatten() for c in column.chunks]])


def invert(rows: DataFrame, keep: tuple[str, ...] = (), block_docs: int = BLOCK_DOCS) -> DataFrame:
    """One row per block: terms, ends (of the lists of the terms in places and tfs), places, tfs, dls (lengths of the documents), and the
    ids and kept columns of the documents as arrays with a leading underscore. rows: doc_id, kept columns, _tokens."""
    named = ["doc_id", *keep]
    kinds = [f"`_{c}` array<{rows.schema[c].dataType.simpleString()}>" for c in named]
    ddl = ", ".join(["block long, terms array<string>, ends array<int>, places array<int>, tfs array<int>, dls array<int>", *kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            held = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(len(named))), 0).to_numpy().astype(np.int64))
            low = 0
            while low < batch.num_rows:
                most = int(np.searchsorted(held, (held[low - 1] if low else 0) + BLOCK_TOKENS, "right"))
                high = min(low + block_docs, max(low + 1, most))
                piece = batch.slice(low, high - low)
                piece = piece.take(pc.sort_indices(piece.column(0), null_placement="at_start"))
                tokens, n = piece.column(len(named)), piece.num_rows
                lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy().astype(np.int64)
                found = pc.dictionary_encode(tokens.flatten())
                codes = pc.fill_null(found.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
                keys = (codes * n + np.repeat(np.arange(n), lengths))[codes >= 0]
                keys, tfs = np.unique(keys, return_counts=True)
                ends = np.searchsorted(keys, (np.arange(len(found.dictionary)) + 1) * n)
                one = pa.array([0, n], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ends)], pa.int32()), found.dictionary.cast(pa.string())),
                     _ints(ends), _ints(keys % n), _ints(tfs), _ints(lengths), *[pa.ListArray.from_arrays(one, piece.column(i)) for i in range(len(named))]],
                    names=["block", "terms", "ends", "places", "tfs", "dls", *[f"_{c}" for c in named]])
                block, low = block + 1, high

    return rows.select(*named, "_tokens").mapInArrow(run, ddl)


def term_counts(blocks: DataFrame) -> DataFrame:
    """(term, df) rows; a task adds up what its blocks have in common, as far as HELD_ROWS terms reach."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, least = [], 0, HELD_ROWS // 8
        for batch in batches:
            for i in range(batch.num_rows):
                terms, ends = (batch.column(c).slice(i, 1).flatten() for c in range(2))
                held.append(pa.table([terms, pa.array(np.diff(ends.to_numpy().astype(np.int64), prepend=0))], names=["term", "df"]))
                rows += len(terms)
                if rows <= least:
                    continue
                whole = _added(held)
                held, rows = [whole], whole.num_rows
                least = max(least, 2 * rows)
                if rows > HELD_ROWS // 2:
                    yield from whole.to_batches(max_chunksize=OUT_ROWS)
                    held, rows, least = [], 0, HELD_ROWS // 2
        if held:
            yield from _added(held).to_batches(max_chunksize=OUT_ROWS)

    return blocks.select("terms", "ends").mapInArrow(run, "term string, df long")


def _added(counts: list[pa.Table]) -> pa.Table:
    whole = pa.concat_tables(counts).group_by("term", use_threads=False).aggregate([("df", "sum")])
    return whole.select(["term", "df_sum"]).rename_columns(["term", "df"])


def lists_of(blocks: DataFrame, avgdl: float) -> DataFrame:
    """(term, block, places, tfs, dls, best): the form of a stored index, one row per term and block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                terms, ends, places, tfs, dls = (batch.column(c).slice(i, 1).flatten() for c in range(1, 6))
                starts = np.append(0, ends.to_numpy())
                lengths = dls.to_numpy()[places.to_numpy()]
                best = part(tfs.to_numpy().astype(np.float64), lengths.astype(np.float64), avgdl)
                best = np.maximum.reduceat(best, starts[:-1]) if len(terms) else best  # every term of a block has a document
                lists = [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), c) for c in (places, tfs, pa.array(lengths, pa.int32()))]
                yield from pa.table([terms, pa.array([batch.column(0)[i].as_py()] * len(terms), pa.int64()), *lists, pa.array(best)],
                                    names=["term", "block", "places", "tfs", "dls", "best"]).to_batches(10_000)

    return blocks.select("block", "terms", "ends", "places", "tfs", "dls").mapInArrow(
        run, "term string, block long, places array<int>, tfs array<int>, dls array<int>, best double")


def documents(blocks: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, dl, kept columns), one row per document."""
    named = ["doc_id", *keep]
    rows = F.arrays_zip(F.col("dls").alias("dl"), *[F.col(f"_{c}").alias(c) for c in named])
    return blocks.select(F.explode(rows).alias("d")).select(*[F.col("d")[c].alias(c) for c in named], F.col("d")["dl"].cast("long").alias("dl"))


class Catalogue:
    """An index that a task holds whole: its terms, their idf, and per block the numbers of its terms, where their lists start in places and how
    long they are, places, parts, and the columns of its documents.

    terms: term, idf; lists as in a stored index; blocks: block and the columns.
    """

    def __init__(self, terms: pa.Table, lists: pa.Table, blocks: pa.Table, avgdl: float):
        self.terms, self.idf = terms["term"].combine_chunks(), terms["idf"].to_numpy()
        self.blocks, named = [], [c for c in blocks.column_names if c != "block"]
        lists = lists.take(pc.sort_indices(lists["block"])).combine_chunks()
        places, tfs, dls = (_flat(lists[c]).to_numpy() for c in ("places", "tfs", "dls"))
        parts = part(tfs.astype(np.float64), dls.astype(np.float64), avgdl)
        numbers = pc.index_in(lists["term"], value_set=self.terms).to_numpy().astype(np.int64)
        lengths = pc.list_value_length(lists["places"]).to_numpy().astype(np.int64)
        ends = np.append(0, np.cumsum(lengths))
        block = lists["block"].to_numpy()
        for i, name in enumerate(blocks["block"].to_numpy()):
            low, high = np.searchsorted(block, [name, name + 1])
            a, b = ends[low], ends[high]
            columns = [_flat(blocks[c].slice(i, 1)) for c in named]
            self.blocks.append((numbers[low:high], ends[low:high] - a, lengths[low:high], places[a:b], parts[a:b], columns))


def _summed(qids: pa.Array, line: np.ndarray, terms: np.ndarray, tfs: np.ndarray | None = None) -> pa.RecordBatch:
    """(qid, terms, tfs), one row per query that names a term; entry i says that query qids[line[i]] names terms[i] tfs[i] times, or once."""
    found = pc.dictionary_encode(qids, null_encoding="encode")
    codes, size = found.indices.to_numpy(), int(terms.max(initial=0)) + 1
    keys = codes[line].astype(np.int64) * size + terms
    if tfs is None:
        keys, tfs = np.unique(keys, return_counts=True)
    else:
        keys, at = np.unique(keys, return_inverse=True)
        tfs = np.bincount(at, tfs, len(keys))
    asking, starts = np.unique(keys // size, return_index=True)
    ends = pa.array(np.append(starts, len(keys)), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, pa.array(c.astype(np.int32))) for c in (keys % size, tfs)]
    return pa.RecordBatch.from_arrays([found.dictionary.take(pa.array(asking)), *lists], names=["qid", "terms", "tfs"])


def _sum_of(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """The rows of each query of (qid, terms, tfs) batches in one."""
    rows = pa.Table.from_batches(batches).combine_chunks()
    line = np.repeat(np.arange(rows.num_rows), pc.list_value_length(rows["terms"]).to_numpy())
    return _summed(rows["qid"].combine_chunks(), line, *(_flat(rows[c]).to_numpy() for c in ("terms", "tfs")))


def numbered(rows: DataFrame, catalogue) -> DataFrame:
    """(qid, terms, tfs): the numbers of the terms of a catalogue (broadcast) that a query names, and how often. rows: qid, _tokens. The rows
    of a query that lie in a batch are added up, so that a frequent query id is rare in what is passed on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column(1)
            lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy()
            number = pc.index_in(tokens.flatten(), value_set=catalogue.value.terms)
            known = number.is_valid().to_numpy(zero_copy_only=False)
            yield _summed(batch.column(0), np.repeat(np.arange(batch.num_rows), lengths)[known], pc.fill_null(number, 0).to_numpy()[known])

    kind = rows.schema["qid"].dataType.simpleString()
    return rows.select("qid", "_tokens").mapInArrow(run, f"qid {kind}, terms array<int>, tfs array<int>")


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(qid, terms, tfs) with one row per query, of rows that come in the order of their queries."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        # what lies before the last query of the batch is complete
        codes = pc.dictionary_encode(batch.column(0), null_encoding="encode").indices.to_numpy()
        last = int(np.argmax(codes == codes[-1]))
        if held and (last or batch.column(0)[0] != held[-1].column(0)[-1]):
            yield _sum_of([*held, batch.slice(0, last)])
            held = []
        elif last:
            yield _sum_of([batch.slice(0, last)])
        held.append(batch.slice(last))
        if len(held) > 1 and sum(b.nbytes for b in held) > HELD_BYTES:
            held = [_sum_of(held)]
    if held:
        yield _sum_of(held)


class _Held:
    """The best k hits per query and group of the blocks of a task so far; ties by id, nulls first.

    Hits are (line, kept columns, score), a line per group and query. `floor` is the k-th score of a line, once it is known. What
    exceeds HELD_ROWS goes on; the floors still hold then, as the k hits that reach them have gone on too.
    """

    def __init__(self, lines: int, k: int):
        self.k, self.floor = k, np.full(lines, -np.inf)
        self.hits, self.rows, self.least = [], 0, HELD_ROWS // 16

    def add(self, hits: pa.Table) -> pa.Table | None:
        """Some more hits. Returns hits that are held no longer."""
        self.hits.append(hits)
        self.rows += hits.num_rows
        if self.rows <= self.least:
            return None
        best = self.take()
        if best.num_rows <= HELD_ROWS // 2:
            self.hits, self.rows = [best], best.num_rows
            self.least = max(self.least, 2 * self.rows)
            return None
        return best

    def take(self) -> pa.Table | None:
        """The best of the hits, which are held no longer."""
        if not self.hits:
            return None
        hits = pa.concat_tables(self.hits).combine_chunks()
        self.hits, self.rows = [], 0
        lines, score = hits["line"].to_numpy(), hits["score"].to_numpy()
        place = np.empty(len(lines), np.int64)
        place[pc.sort_indices(hits["doc_id"], null_placement="at_start").to_numpy()] = np.arange(len(lines))
        order = np.lexsort((place, -score, lines))
        line = lines[order]
        rank = np.arange(len(line)) - np.searchsorted(line, line)
        last = order[rank == self.k - 1]
        self.floor[lines[last]] = np.maximum(self.floor[lines[last]], score[last])
        return hits.take(pa.array(order[rank < self.k]))


class Scorer:
    """Scores of the documents of a block for many queries: (qid, doc_id, kept columns, score) of those that share a term with a query.

    asked: broadcast (qids, terms, numbers of the queries and weights per term). With k, a block or a task passes on its best k per query,
    of the accepted and of the other documents where `accept` names a kept boolean.
    """

    def __init__(self, asked, avgdl: float, qid_type: str, blocks: DataFrame, keep: tuple[str, ...] = (), k: int | None = None, accept: str | None = None):
        self.asked, self.avgdl, self.k, self.accept, self.named = asked, avgdl, k, accept, ["doc_id", *keep]
        types = {c: blocks.schema[f"_{c}"].dataType.elementType.simpleString() for c in self.named}
        self.ddl = ", ".join([f"qid {qid_type}", *[f"`{c}` {types[c]}" for c in self.named], "score double"])
        self.schema = to_arrow_schema(StructType.fromDDL(self.ddl))

    def _choose(self, scores: np.ndarray, at: np.ndarray) -> np.ndarray:
        k = self.k
        if k is not None and len(at) > k:
            kth = np.partition(scores[at], len(at) - k)[len(at) - k]
            at = at[scores[at] >= kth]
            at = at[np.argsort(-scores[at], kind="stable")[:k]]  # places follow the ids, so ties go to the lower id
        return at

    def score(self, numbers: np.ndarray, starts: np.ndarray, lengths: np.ndarray, places: np.ndarray, parts: Callable[[np.ndarray], np.ndarray],
              columns: list[pa.Array], only: list[int] | None = None, floor: np.ndarray | None = None) -> Iterator[pa.Table]:
        """numbers: the asked terms that the block holds; their lists lie at starts in places and are lengths long. With the floors of _Held
        the rows name lines in place of queries, and hits below the floor of their line are left out. One table per matrix."""
        qids, _, known = self.asked.value
        wanted = [known[n] for n in numbers.tolist()]
        size = len(columns[0])
        if not wanted or not size:
            return
        row = np.repeat(np.arange(len(wanted)), [len(q) for q, _ in wanted])
        number, weight = (np.concatenate(c) for c in zip(*wanted))
        order = np.argsort(number, kind="stable")
        if only is not None:
            order = order[np.isin(number[order], np.asarray(only))]
        row, number, weight = row[order], number[order], weight[order]
        groups = [np.ones(size, bool)]
        if self.accept:
            ok = pc.fill_null(columns[self.named.index(self.accept)], False).to_numpy(zero_copy_only=False)
            groups = [ok, ~ok]
        heads = np.append(np.flatnonzero(np.append(True, np.diff(number) != 0)), len(number)) if len(number) else np.zeros(1, np.int64)
        step = max(1, CELLS // (8 * size))
        for low in range(0, len(heads) - 1, step):  # some queries, in a matrix of bounded size
            a, b = heads[low], heads[min(low + step, len(heads) - 1)]
            asking, line = np.unique(number[a:b], return_inverse=True)
            scores, touched = np.zeros(len(asking) * size), np.zeros(len(asking) * size, bool)
            done, first = np.cumsum(lengths[row[a:b]]), 0
            while first < b - a:  # some of their postings
                last = max(first + 1, int(np.searchsorted(done, (done[first - 1] if first else 0) + CELLS // 4, "right")))
                take = row[a + first:a + last]
                n = lengths[take]
                at = np.repeat(starts[take] - np.cumsum(n) + n, n) + np.arange(n.sum())
                target = np.repeat(line[first:last] * size, n) + places[at]
                scores += np.bincount(target, np.repeat(weight[a + first:a + last], n) * parts(at), len(scores))
                touched[target] = True
                first = last
            # the same grid as `settle`: results must not depend on the order of summation
            scores, touched = (np.rint(scores * 1e9) / 1e9).reshape(-1, size), touched.reshape(-1, size)
            for g, group in enumerate(groups):
                lines = g * len(qids) + asking
                good = touched & group if floor is None else touched & group & (scores >= floor[lines][:, None])
                for i in np.flatnonzero(good.sum(1) > self.k) if self.k is not None else ():
                    at = self._choose(scores[i], np.flatnonzero(good[i]))
                    good[i] = False
                    good[i, at] = True
                i, at = np.nonzero(good)
                first, name = (qids.take(pa.array(asking[i])), "qid") if floor is None else (pa.array(lines[i]), "line")
                yield pa.table([first, *[c.take(pa.array(at)) for c in columns], pa.array(scores[i, at])], names=[name, *self.named, "score"])

    def _named(self, hits: pa.Table | None) -> Iterator[pa.RecordBatch]:
        """Held hits with their queries."""
        if hits is not None:
            qids = self.asked.value[0]
            names = qids.take(pa.array(hits["line"].to_numpy() % max(1, len(qids))))
            yield from hits.set_column(0, "qid", names).to_batches(max_chunksize=OUT_ROWS)

    def in_place(self, blocks: DataFrame) -> DataFrame:
        """Scores of blocks where they lie."""
        me = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, terms, _ = me.asked.value
            best = _Held(len(qids) * (2 if me.accept else 1), me.k) if me.k is not None else None
            for batch in batches:
                for i in range(batch.num_rows):
                    held, ends, places, tfs, dls = (batch.column(c).slice(i, 1).flatten() for c in range(1, 6))
                    number = pc.index_in(held, value_set=terms)
                    at = np.flatnonzero(number.is_valid().to_numpy(zero_copy_only=False))
                    number = pc.fill_null(number, 0).to_numpy(zero_copy_only=False)[at]
                    ends = ends.to_numpy().astype(np.int64)
                    starts = np.append(0, ends[:-1])[at]
                    places, tfs, dls = places.to_numpy(), tfs.to_numpy(), dls.to_numpy()
                    parts = lambda p: part(tfs[p].astype(np.float64), dls[places[p]].astype(np.float64), me.avgdl)  # noqa: B023, E731
                    columns = [batch.column(c).slice(i, 1).flatten() for c in range(6, 6 + len(me.named))]
                    for hits in me.score(number, starts, ends[at] - starts, places, parts, columns, floor=best.floor if best else None):
                        yield from me._named(best.add(hits)) if best else hits.to_batches()
            if best is not None:
                yield from me._named(best.take())

        return blocks.select("block", "terms", "ends", "places", "tfs", "dls", *[f"_{c}" for c in self.named]).mapInArrow(run, self.ddl)

    def of_lists(self, lists: DataFrame, blocks: DataFrame) -> DataFrame:
        """Scores from the lists of a stored index. Where blocks have a column `asking`, a block scores the queries with those numbers."""
        me = self

        def cell(rows: pa.Table, block: pa.Table) -> pa.Table:
            if not rows.num_rows or not block.num_rows:
                return me.schema.empty_table()
            numbers = pc.index_in(rows["term"], value_set=me.asked.value[1]).to_numpy()
            lengths = pc.list_value_length(rows["places"]).to_numpy().astype(np.int64)
            places, tfs, dls = (_flat(rows[c]).to_numpy() for c in ("places", "tfs", "dls"))
            parts = lambda p: part(tfs[p].astype(np.float64), dls[p].astype(np.float64), me.avgdl)
            only = block["asking"][0].as_py() if "asking" in block.column_names else None
            hits = me.score(numbers, np.cumsum(lengths) - lengths, lengths, places, parts, [_flat(block[f"_{c}"]) for c in me.named], only)
            return pa.concat_tables([me.schema.empty_table(), *(h.cast(me.schema) for h in hits)])

        rows = lists.select("block", "term", "places", "tfs", "dls")
        return rows.groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(cell, self.ddl)

    def of_queries(self, queries: DataFrame) -> DataFrame:
        """Scores of the documents of a catalogue, the broadcast `asked`, for queries as in `numbered`: the best k per query."""
        me = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            catalogue = me.asked.value
            for batch in _gathered(batches):
                qids, terms, tfs = batch.column(0), batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy()
                order = np.argsort(terms, kind="stable")
                line, weight = np.repeat(np.arange(len(qids)), pc.list_value_length(batch.column(1)).to_numpy())[order], (tfs * catalogue.idf[terms])[order]
                asked, heads = np.unique(terms[order], return_index=True)
                known = [(line[a:b], weight[a:b]) for a, b in zip(heads, np.append(heads[1:], len(terms)))]
                some = copy.copy(me)
                some.asked = SimpleNamespace(value=(qids, None, known))
                best = _Held(len(qids) * (2 if me.accept else 1), me.k)
                for numbers, starts, lengths, places, parts, columns in catalogue.blocks:
                    _, here, at = np.intersect1d(asked, numbers, return_indices=True)
                    for hits in some.score(here, starts[at], lengths[at], places, lambda p: parts[p], columns, floor=best.floor):  # noqa: B023
                        yield from some._named(best.add(hits))
                yield from some._named(best.take())

        # rows of a query meet and follow each other
        return queries.repartition("qid").sortWithinPartitions("qid").mapInArrow(run, self.ddl)


def of_terms(lists: DataFrame, terms: list[str]) -> DataFrame:
    """The lists of some terms. A short choice is pushed into the scan, where it selects buckets and row groups."""
    if len(terms) <= PUSHED_TERMS:
        return lists.filter(F.col("term").isin(terms))
    wanted = lists.sparkSession.createDataFrame(pa.table({"term": pa.array(terms, pa.string())}))
    return lists.join(F.broadcast(wanted), "term", "left_semi")  # as many as a task holds of the queries
