"""Keyword (BM25) and vector search for many queries at once.

The keyword index holds inverted postings in blocks of documents (operators.postings); texts and tokens never move.
A block is scored for all queries at once and passes on its best k. A stored index is read by term; a large one bounds
the scores of each block first, and blocks that cannot reach the k-th score are neither read nor scored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from bidweave.functions.text import col, let
from bidweave.operators import postings as P
from bidweave.operators.filters import valid_vectors
from bidweave.operators.keys import BROADCAST_ROWS, ROWS_PER_SALT, top_k, top_k_staged
from bidweave.session import cut

EPSILON = 0.25  # Okapi constant: the floor for terms in most documents
PRUNE_DOCS = 64_000  # a larger stored index is searched in two rounds
FIRST_BLOCKS = 4  # blocks per query in the first round
TASK_POSTINGS, BUCKET_FILES = 2 * 1024 * 1024, 4  # of a stored index: what a task sorts and writes, and tasks per bucket
BROADCAST_BYTES = 64 * 1024 * 1024
CATALOGUE_DOCS = 100_000  # a larger index is never copied to the queries
RESULT_CELLS = 4 * 1024 * 1024  # scores that a step holds at once: 32 MiB
BLOCK_VECTORS = 8192
PAIRS = 64 * 1024  # pairs of vectors that are scored one by one at once
OUT_ROWS = 64 * 1024

_HAN = r"一-鿿"
WORDS = rf"[{_HAN}]|[\p{{L}}\p{{N}}&&[^{_HAN}]]+"
HAN_PAIRS = rf"(?=([{_HAN}]{{2}}))"


def settle(score: Column) -> Column:
    """Score on a grid of 1e-9, so that the order of summation cannot decide between equals."""
    return F.rint(score * 1e9) / F.lit(1e9)


def tokens(c: Column | str, mode: str | Callable[[Column], Column] = "words") -> Column:
    """Array of tokens. words: letter/digit runs, single Han characters and Han pairs; chars: every
    lower-case character; or a function of the text column, such as the Arrow UDF of a word segmenter."""
    if callable(mode):
        return F.coalesce(mode(F.coalesce(col(c), F.lit(""))), F.array().cast("array<string>"))
    text = F.lower(F.coalesce(col(c), F.lit("")))
    if mode == "chars":
        return F.filter(F.split(text, ""), lambda t: t != "")

    def words(t: Column) -> Column:
        pairs = F.when(F.rlike(t, F.lit(f"[{_HAN}]")), F.regexp_extract_all(t, F.lit(HAN_PAIRS), F.lit(1)))
        return F.concat(F.regexp_extract_all(t, F.lit(WORDS), F.lit(0)),
                        F.coalesce(pairs, F.array().cast("array<string>")))
    return let(text, words)


def counted(tokens_: Column) -> Column:
    """array<struct<term, tf>> of a token array: sorted, then the runs of equal tokens are measured."""
    def runs(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda t, i: F.when((i == 0) | (F.get(s, i - 1) != t), i)), lambda i: i.isNotNull())
        return let(starts, lambda at: F.transform(at, lambda p, k: F.struct(
            F.get(s, p).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s)) - p).cast("long").alias("tf"))))
    return let(F.array_sort(F.filter(tokens_, lambda t: t.isNotNull())), runs)


def tokenize(df: DataFrame, key: str, text: str = "text", mode: str | Callable[[Column], Column] = "words") -> DataFrame:
    """(key, term, tf) rows; the rows of a key are counted by themselves and then added up."""
    rows = df.select(key, F.inline(counted(tokens(text, mode))))
    return rows.groupBy(key, "term").agg(F.sum("tf").alias("tf"))


# Stands for "every document" among the terms; no token can be empty.
EVERY = ""


@dataclass
class BM25Index:
    """blocks and, of a stored index, lists as in operators.postings, counts(term, df, length), and three numbers:
    documents, mean length, mean raw idf. keep: further columns of the documents."""

    blocks: DataFrame
    counts: DataFrame
    n_docs: int
    avgdl: float
    mean_idf: float
    keep: tuple[str, ...] = ()
    lists: DataFrame | None = None

    @property
    def docs(self) -> DataFrame:
        return P.documents(self.blocks, self.keep)

    @property
    def postings(self) -> DataFrame:
        """(term, block, places, tfs, dls, best), one row per term and block."""
        return P.lists_of(self.blocks, self.avgdl) if self.lists is None else self.lists

    @property
    def terms(self) -> DataFrame:
        """(term, df, idf). A negative idf (term in more than half of the documents) is replaced
        by EPSILON x mean idf."""
        raw = _raw_idf(self.n_docs)
        idf = F.when(raw < 0, F.lit(EPSILON * self.mean_idf)).otherwise(raw)
        return self.counts.filter(F.col("term") != EVERY).select("term", "df", idf.alias("idf"))


def _raw_idf(n_docs: int) -> Column:
    return F.log(F.lit(float(n_docs)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def document_counts(blocks: DataFrame) -> DataFrame:
    """(term, df, length): the blocks that hold a term add up its documents; the empty term that stands for all
    documents carries the lengths."""
    length = F.aggregate("dls", F.lit(0).cast("long"), lambda n, x: n + x)
    whole = blocks.agg(F.sum(F.size("dls")).alias("df"), F.sum(length).alias("length")).select(F.lit(EVERY).alias("term"), "df", "length")
    terms = P.term_counts(blocks).groupBy("term").agg(F.sum("df").alias("df"))
    return terms.withColumn("length", F.lit(None).cast("long")).unionByName(whole.filter("df > 0"))


def corpus_stats(counts: DataFrame) -> DataFrame:
    """Number of documents and mean length, one row."""
    return counts.filter(F.col("term") == EVERY).select(
        F.col("df").alias("n_docs"), (F.col("length") / F.col("df")).alias("avgdl"))


def bm25_index(df: DataFrame, key: str, text: str = "text", mode: str | Callable[[Column], Column] = "words", keep: tuple[str, ...] = (),
               block_docs: int = P.BLOCK_DOCS) -> BM25Index:
    """Index of a corpus. Documents are tokenised once, where they lie, and inverted block by block; the blocks and
    the term table are stored. Use write_index to keep them under a name."""
    rows = df.select(F.col(key).alias("doc_id"), *keep, tokens(text, mode).alias("_tokens"))
    blocks = cut(P.invert(rows, keep, block_docs))
    counts = cut(document_counts(blocks))
    whole = corpus_stats(counts).first()
    n, avgdl = (whole["n_docs"], whole["avgdl"]) if whole else (0, 0.0)
    mean = counts.filter(F.col("term") != EVERY).agg(F.avg(_raw_idf(n))).first()[0]
    return BM25Index(blocks, counts, n, avgdl or 1.0, mean or 0.0, tuple(keep))


def write_index(index: BM25Index, name: str, buckets: int, path: str | None = None) -> None:
    """Store the index, below `path` or in the warehouse, as the tables `<name>_postings` and `<name>_counts`, bucketed and sorted by term, so that a search opens the
    buckets of its terms only, `<name>_blocks` (ids and kept columns) and the one-row table `<name>_numbers`.

    A task sorts about TASK_POSTINGS postings, however many there are: a larger index has more buckets than asked, and up to
    BUCKET_FILES tasks share a bucket, by block, so that the lists of a frequent term do not lie in one task either."""
    def writer(rows: DataFrame, part: str):
        out = rows.write.mode("overwrite").format("parquet")
        return out if path is None else out.option("path", f"{path.rstrip('/')}/{name}_{part}")

    held = index.counts.filter(F.col("term") != EVERY).agg(F.sum("df")).first()[0] or 0
    tasks = -(-held // TASK_POSTINGS)
    buckets = max(buckets, -(-tasks // BUCKET_FILES))
    files = max(1, -(-tasks // buckets))
    bucket = F.pmod(F.hash("term"), F.lit(buckets))  # the bucket that the writer gives a term
    spread = {"postings": [bucket, F.pmod(F.xxhash64("block"), F.lit(files))], "counts": [F.col("term")]}
    for part, by in spread.items():
        rows = getattr(index, part).repartition(buckets * (files if part == "postings" else 1), *by)
        writer(rows, part).bucketBy(buckets, "term").sortBy("term").saveAsTable(f"{name}_{part}")
    slim = index.blocks.drop("terms", "ends", "places", "tfs").repartitionByRange(buckets, "block").sortWithinPartitions("block")
    writer(slim, "blocks").saveAsTable(f"{name}_blocks")
    numbers = [(index.n_docs, index.avgdl, index.mean_idf, list(index.keep))]
    spark = index.counts.sparkSession
    writer(spark.createDataFrame(numbers, "n_docs long, avgdl double, mean_idf double, keep array<string>").coalesce(1), "numbers").saveAsTable(f"{name}_numbers")


def read_index(spark: SparkSession, name: str) -> BM25Index:
    """A stored index; search it any number of times."""
    n = spark.read.table(f"{name}_numbers").first()
    postings, blocks, counts = (spark.read.table(f"{name}_{part}") for part in ("postings", "blocks", "counts"))
    return BM25Index(blocks, counts, n["n_docs"], n["avgdl"], n["mean_idf"], tuple(n["keep"]), postings)


def _query_terms(queries: DataFrame, qid: str, text: str, mode: str | Callable[[Column], Column]) -> DataFrame:
    """(qid, term, tf); the rows of a query id are counted by themselves and then added up."""
    return tokenize(queries.select(F.col(qid).alias("qid"), F.col(text).alias("text")), "qid", "text", mode)


def query_weights(index: BM25Index, queries: DataFrame, qid: str, text: str, mode: str | Callable[[Column], Column] = "words") -> DataFrame:
    """(qid, term, weight, df): idf times how often the query names the term."""
    return _query_terms(queries, qid, text, mode).join(index.terms, "term").select("qid", "term", (F.col("tf") * F.col("idf")).alias("weight"), "df")


def _spread(postings: DataFrame, weights: DataFrame, rows_per_salt: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with salts for hot terms. Documents of a term are dealt over df / rows_per_salt salts and its queries
    over (number of queries) / rows_per_salt; each side is repeated over the salts of the other."""
    salts = lambda c: F.ceil(F.col(c) / rows_per_salt).cast("int")
    hot = (weights.groupBy("term").agg(F.first("df").alias("df"), F.count("*").alias("asked"))
           .select("term", salts("df").alias("_ds"), salts("asked").alias("_qs")).filter("_ds > 1 or _qs > 1"))
    one = lambda c: F.coalesce(c, F.lit(1))
    every = lambda n: F.explode(F.sequence(F.lit(0), one(n) - 1))
    left = (postings.join(hot, "term", "left").withColumn("_d", F.pmod(F.xxhash64("doc_id"), one("_ds")).cast("int"))
            .withColumn("_q", every("_qs")).drop("_ds", "_qs"))
    right = (weights.join(hot, "term", "left").withColumn("_q", F.pmod(F.xxhash64("qid"), one("_qs")).cast("int"))
             .withColumn("_d", every("_ds")).drop("_ds", "_qs"))
    return left, right, ["term", "_d", "_q"]


class _Asked:
    """Weighted terms of some queries, as a broadcast for the scorer if they fit, else as a stored table."""

    def __init__(self, index: BM25Index, queries: DataFrame, qid: str, text: str, mode, broadcast_rows: int):
        weights = query_weights(index, queries, qid, text, mode)
        self.kind = weights.schema["qid"].dataType.simpleString()
        # one row more than fits: the size is checked by the job that fetches them
        table = weights.select("qid", "term", "weight").limit(broadcast_rows + 1).toArrow()
        self.fits = table.num_rows <= broadcast_rows and table.nbytes <= BROADCAST_BYTES
        if not self.fits:
            self.weights = cut(weights)
            return
        self.table = table
        numbers, terms = (pc.dictionary_encode(table[c].combine_chunks()) for c in ("qid", "term"))
        order = np.argsort(terms.indices.to_numpy(), kind="stable")
        number, weight = numbers.indices.to_numpy().astype(np.int64)[order], table["weight"].to_numpy()[order]
        cuts = np.searchsorted(terms.indices.to_numpy()[order], np.arange(len(terms.dictionary) + 1))
        known = [(number[a:b], weight[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
        self.qids, self.terms = numbers.dictionary, terms.dictionary.to_pylist()
        self.block = index.counts.sparkSession.sparkContext.broadcast((numbers.dictionary, terms.dictionary, known))


def _scored(index: BM25Index, asked: _Asked, keep: tuple[str, ...], k: int | None = None, accept: str | None = None) -> DataFrame:
    scorer = P.Scorer(asked.block, index.avgdl, asked.kind, index.blocks, keep, k, accept)
    return scorer.in_place(index.blocks) if index.lists is None else scorer.of_lists(P.of_terms(index.lists, asked.terms), index.blocks)


def bm25_scores(index: BM25Index, queries: DataFrame, qid: str, text: str = "text", mode: str | Callable[[Column], Column] = "words",
                keep: tuple[str, ...] = (), broadcast_rows: int = BROADCAST_ROWS, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """(qid, doc_id, score) of every document that shares a term with the query."""
    asked = _Asked(index, queries, qid, text, mode, broadcast_rows)
    return _scored(index, asked, keep) if asked.fits else _joined_scores(index, asked.weights, keep, rows_per_salt)


def _joined_scores(index: BM25Index, weights: DataFrame, keep: tuple[str, ...], rows_per_salt: int) -> DataFrame:
    """Scores for more query terms than a task can hold: postings join them by term, hot terms spread over salts."""
    named = ["doc_id", *keep]
    rows = index.postings.join(index.blocks.select("block", *[f"_{c}" for c in named]), "block")
    rows = rows.select("term", *[f"_{c}" for c in named], F.explode(F.arrays_zip("places", "tfs", "dls")).alias("p")).select(
        "term", *[F.get(f"_{c}", F.col("p.places")).alias(c) for c in named], F.col("p.tfs").alias("tf"), F.col("p.dls").alias("dl"))
    left, right, on = _spread(rows, weights, rows_per_salt)
    parts = F.col("weight") * P.part(F.col("tf"), F.col("dl"), float(index.avgdl))
    return left.join(right, on).groupBy("qid", "doc_id", *keep).agg(settle(F.sum(parts)).alias("score"))


def bm25_best(index: BM25Index, queries: DataFrame, qid: str, text: str, k: int, mode: str | Callable[[Column], Column] = "words",
              accept: str | None = None, prune_docs: int = PRUNE_DOCS) -> DataFrame:
    """(qid, doc_id, accepted, score): rows that hold the best k of the accepted and of the other documents of each query.
    A stored index of more than `prune_docs` documents is searched in two rounds; a small one goes to the queries where these are more."""
    keep = (accept,) if accept else ()
    if _is_catalogue(index, queries):
        return _catalogue_best(index, queries, qid, text, k, mode, keep, accept)
    asked = _Asked(index, queries, qid, text, mode, BROADCAST_ROWS)
    if not asked.fits:
        return _joined_scores(index, asked.weights, keep, ROWS_PER_SALT)
    if index.lists is None or index.n_docs <= prune_docs:
        return _scored(index, asked, keep, k, accept)
    return _pruned(index, asked, keep, k, accept)


def _is_catalogue(index: BM25Index, queries: DataFrame) -> bool:
    """Whether there are more queries than documents, and a task can hold all of these."""
    if not 0 < index.n_docs <= CATALOGUE_DOCS or queries.limit(index.n_docs + 1).count() <= index.n_docs:
        return False
    held = F.col("df") * (F.octet_length("term") + 16)  # places, parts and lengths, and the term once per list at most
    return (index.counts.filter(F.col("term") != EVERY).agg(F.sum(held)).first()[0] or 0) <= BROADCAST_BYTES


def _catalogue_best(index: BM25Index, queries: DataFrame, qid: str, text: str, k: int, mode: str | Callable[[Column], Column],
                    keep: tuple[str, ...], accept: str | None) -> DataFrame:
    """Best documents of a small index for any number of queries: only the numbers of their known terms move, to meet the other rows of their id."""
    named = [f"_{c}" for c in ("doc_id", *keep)]
    tables = (df.toArrow() for df in (index.terms.select("term", "idf"), index.postings.select("term", "block", "places", "tfs", "dls"),
                                      index.blocks.select("block", *named)))
    catalogue = index.counts.sparkSession.sparkContext.broadcast(P.Catalogue(*tables, float(index.avgdl)))
    asked = P.numbered(queries.select(F.col(qid).alias("qid"), tokens(text, mode).alias("_tokens")), catalogue)
    return P.Scorer(catalogue, index.avgdl, asked.schema["qid"].dataType.simpleString(), index.blocks, keep, k, accept).of_queries(asked)


def block_bounds(index: BM25Index, asked: _Asked) -> DataFrame:
    """(qid, block, bound): the most that a document of the block can score. Reads the bounds of the lists, not the lists."""
    weights = F.broadcast(index.counts.sparkSession.createDataFrame(asked.table))
    rows = P.of_terms(index.postings, asked.terms).select("term", "block", "best").join(weights, "term")
    # a margin for the order of summation and for the grid that scores are put on
    bound = F.sum(F.greatest(F.col("weight"), F.lit(0.0)) * F.col("best")) * (1 + 1e-9) + 1e-8
    return rows.groupBy("qid", "block").agg(bound.alias("bound"))


def _pruned(index: BM25Index, asked: _Asked, keep: tuple[str, ...], k: int, accept: str | None) -> DataFrame:
    """The blocks of highest bound are scored first; their k-th score then rules out blocks whose bound lies below it."""
    numbers = F.broadcast(index.counts.sparkSession.createDataFrame(
        pa.table({"qid": asked.qids, "number": pa.array(range(len(asked.qids)), pa.int32())})))
    scorer, lists = P.Scorer(asked.block, index.avgdl, asked.kind, index.blocks, keep, k, accept), P.of_terms(index.lists, asked.terms)

    def score(pairs: DataFrame) -> DataFrame:
        asking = cut(pairs.join(numbers, "qid").groupBy("block").agg(F.collect_list("number").alias("asking")))
        some = lists.join(asking.select("block"), "block", "left_semi")
        return scorer.of_lists(some, index.blocks.join(asking, "block"))

    bounds = cut(block_bounds(index, asked))
    first = cut(top_k(bounds, FIRST_BLOCKS, [F.col("bound").desc(), F.col("block")], ["qid"]))
    hits = cut(score(first))
    good = hits.filter(F.coalesce(F.col(accept), F.lit(False))) if accept else hits
    kth = top_k(good, k, [F.col("score").desc()], ["qid"], "_rank").filter(F.col("_rank") == k).select("qid", F.col("score").alias("kth"))
    rest = (bounds.join(first.select("qid", "block"), ["qid", "block"], "left_anti").join(kth, "qid", "left")
            .filter(F.col("kth").isNull() | (F.col("bound") >= F.col("kth"))))
    return hits.unionByName(score(rest.select("qid", "block")))


def bm25_search(index: BM25Index, queries: DataFrame, qid: str, text: str = "text", k: int = 10,
                mode: str | Callable[[Column], Column] = "words", prune_docs: int = PRUNE_DOCS) -> DataFrame:
    """Top k documents per query with a positive score; ties by id. `rank` is 1-based."""
    scores = bm25_best(index, queries, qid, text, k, mode, prune_docs=prune_docs).filter(F.col("score") > 0)
    return top_k_staged(scores, k, [F.col("score").desc(), F.col("doc_id")], ["qid"], "doc_id", "rank")


def bm25_request(index: BM25Index, text: str, k: int = 10, mode: str | Callable[[Column], Column] = "words") -> DataFrame:
    """(doc_id, score, rank) for a single text, as from one user: the text is tokenised without a job, its terms are looked
    up in their buckets of the term table, and only their buckets of the postings are read."""
    spark = index.counts.sparkSession
    asked = _query_terms_of(spark, text, mode)
    known = index.terms.filter(F.col("term").isin(list(asked))).select("term", "idf").toArrow() if asked else None
    if not known:
        return index.docs.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    weight = F.create_map(*[F.lit(x) for t, idf in zip(known["term"].to_pylist(), known["idf"].to_pylist()) for x in (t, asked[t] * idf)])
    # the lists of a block meet once; its documents are scored and the best of them chosen there
    lists = index.postings.filter(F.col("term").isin(known["term"].to_pylist())).repartition("block")
    rows = lists.select("block", weight[F.col("term")].alias("weight"), F.explode(F.arrays_zip("places", "tfs", "dls")).alias("p"))
    parts = F.col("weight") * P.part(F.col("p.tfs"), F.col("p.dls"), float(index.avgdl))
    scores = rows.groupBy("block", F.col("p.places").alias("place")).agg(settle(F.sum(parts)).alias("score")).filter("score > 0")
    # places follow the ids inside a block only, so the k best of each block go on and the ids decide between them
    best = top_k(scores, k, [F.col("score").desc(), F.col("place")], ["block"])
    named = best.join(index.blocks.select("block", "_doc_id"), "block").select(F.get("_doc_id", "place").alias("doc_id"), "score")
    order = [F.col("score").desc(), F.col("doc_id")]
    return named.orderBy(*order).limit(k).select("doc_id", "score", F.row_number().over(Window.orderBy(*order)).alias("rank"))


def _query_terms_of(spark: SparkSession, text: str, mode) -> dict[str, int]:
    found = spark.sql("SELECT :text AS text", {"text": text}).select(tokens("text", mode).alias("t")).first()["t"]
    return dict(Counter(t for t in found if t is not None))


# --- vectors ---------------------------------------------------------------------------

def vector_table(df: DataFrame, dim: int, key: str = "id", vector: str = "embedding") -> DataFrame:
    """Valid vectors, scaled to length 1 (zero vectors stay zero), in double precision."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return valid_vectors(df, dim, key, vector).withColumn(vector, v).withColumn("_norm", norm).withColumn(
        vector, F.when(F.col("_norm") > 0, F.transform(vector, lambda x: x / F.col("_norm"))).otherwise(F.col(vector))
    ).drop("_norm")


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> list[np.ndarray]:
    """Per row the positions of the k best scores, ties by id. Ties at the border are kept
    until ids decide, so the choice does not depend on the batch."""
    out = []
    for row in scores:
        at = np.arange(len(row))
        if len(row) > k:
            at = np.nonzero(row >= np.partition(row, len(row) - k)[len(row) - k])[0]
        out.append(at[np.lexsort((ids[at], -row[at]))[:k]])
    return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)


def vector_search(vectors: DataFrame, queries: DataFrame, dim: int, k: int = 10, key: str = "id", qid: str = "qid",
                  vector: str = "embedding", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Exact inner-product top k per query over unit vectors; (qid, doc_id, score, rank).

    Queries within the byte bound are copied to the tasks: vectors never move, each task
    multiplies its batches with slices of the query block and keeps k rows per query. Beyond the bound
    both sides are cut into blocks that meet on a grid. Either way a product holds RESULT_CELLS scores at most, and so do the kept rows.
    """
    base = vector_table(vectors, dim, key, vector).select(F.col(key).alias("doc_id"), F.col(vector).alias("v"))
    asked = vector_table(queries, dim, qid, vector).select(F.col(qid).alias("qid"), F.col(vector).alias("q"))
    types = f"qid {asked.schema['qid'].dataType.simpleString()}, doc_id {base.schema['doc_id'].dataType.simpleString()}, score double"
    block = max(1, min(broadcast_bytes // (dim * 8), RESULT_CELLS // k))
    table = asked.limit(block + 1).toArrow()  # never more than one block comes to the driver
    local = (_search_copied(base, table, dim, k, types) if table.num_rows <= block
             else _search_grid(base, asked, dim, k, types, broadcast_bytes))
    return top_k_staged(local, k, [F.col("score").desc(), F.col("doc_id")], ["qid"], "doc_id", "rank")


def _products(questions: np.ndarray, docs: np.ndarray) -> np.ndarray:
    # the same grid as `settle`: results must not depend on how rows fall into batches
    if len(questions) * len(docs) > RESULT_CELLS:
        raise ValueError("a product holds more scores than the bound")
    return np.rint((questions @ docs.T) * 1e9) / 1e9


class Best:
    """The k best of each of some queries (unit vectors) so far; ties by id.

    A product in single precision, whose error is bounded, tells which pairs can reach the k-th score; only those are scored in double
    precision. `floor` holds scores that the k-th of a query is known to reach.
    """

    def __init__(self, questions: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.questions, self.narrow, self.k = questions, questions.astype(np.float32), k
        self.error = (questions.shape[1] + 8) * 2.4e-7 + 1e-9
        self.floor = np.full(len(questions), -np.inf) if floor is None else floor.astype(np.float64)
        self.scores, self.ids = np.full((len(questions), k), -np.inf), None

    def add(self, vectors: np.ndarray, ids: np.ndarray, asking: np.ndarray | None = None) -> None:
        """Some more vectors, for all queries or for those with the numbers `asking`."""
        if self.ids is None:
            self.ids = np.empty((len(self.questions), self.k), ids.dtype)
        narrow = vectors.astype(np.float32)
        asking = np.arange(len(self.questions)) if asking is None else asking
        step = max(1, RESULT_CELLS // max(1, len(vectors)))
        for low in range(0, len(asking) if len(vectors) else 0, step):
            self._some(asking[low:low + step], vectors, narrow, ids)

    def _some(self, asking: np.ndarray, vectors: np.ndarray, narrow: np.ndarray, ids: np.ndarray) -> None:
        k, near = self.k, self.narrow[asking] @ narrow.T
        least = np.maximum(self.floor[asking], self.scores[asking, -1]) - self.error
        new = np.flatnonzero(least == -np.inf)
        if len(new) and len(vectors) > k:
            least[new] = np.partition(near[new], len(vectors) - k, axis=1)[:, len(vectors) - k] - 2 * self.error
        hit = near >= least.astype(np.float32)[:, None] - np.float32(1e-7)
        many = np.count_nonzero(hit, axis=1)
        full = np.flatnonzero(many > min(4 * k + 64, max(8, len(vectors) // 16)))  # a whole line costs less than so many pairs
        hit[full] = False
        row, at = np.nonzero(hit)
        found = [np.einsum("ij,ij->i", self.questions[asking[row[i:i + PAIRS]]], vectors[at[i:i + PAIRS]]) for i in range(0, len(row), PAIRS)]
        score = np.rint(np.concatenate(found) * 1e9) / 1e9 if found else np.zeros(0)
        if len(full):
            exact = _products(self.questions[asking[full]], vectors)
            held = _best(exact, ids, k)
            line = np.repeat(np.arange(len(full)), [len(h) for h in held])
            row, at = np.concatenate([row, full[line]]), np.concatenate([at, *held])
            score = np.concatenate([score, exact[line, np.concatenate(held)]])
        if len(row):
            self._merge(asking[row], ids[at], score)

    def _merge(self, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        touched = np.unique(row)
        old = self.scores[touched] > -np.inf
        row = np.concatenate([row, np.repeat(touched, old.sum(1))])
        ids, score = np.concatenate([ids, self.ids[touched][old]]), np.concatenate([score, self.scores[touched][old]])
        order = np.lexsort((np.unique(ids, return_inverse=True)[1] if ids.dtype == object else ids, -score, row))
        row, ids, score = row[order], ids[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < self.k
        self.scores[touched] = -np.inf
        self.scores[row[kept], place[kept]], self.ids[row[kept], place[kept]] = score[kept], ids[kept]

    def rows(self, names: pa.Array) -> pa.Table:
        """(qid, doc_id, score) with the names of the queries."""
        row, place = np.nonzero(self.scores > -np.inf)
        ids = pa.array(self.ids[row, place]) if self.ids is not None else pa.array([])
        return pa.table([names.take(pa.array(row)), ids, pa.array(self.scores[row, place])], names=["qid", "doc_id", "score"])


def _blocks(batches: Iterator[pa.RecordBatch], rows: int, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of (doc_id, v) batches, gathered to blocks of up to `rows` rows."""
    held: list[pa.RecordBatch] = []

    def block():
        table = pa.Table.from_batches(held).combine_chunks()
        return table.column(0).to_numpy(), _matrix(table.column(1).combine_chunks(), dim)

    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            part = batch.slice(low, rows)
            if held and sum(b.num_rows for b in held) + part.num_rows > rows:
                yield block()
                held = []
            held.append(part)
    if held:
        yield block()


def _search_copied(base: DataFrame, table: pa.Table, dim: int, k: int, types: str) -> DataFrame:
    block = base.sparkSession.sparkContext.broadcast(
        (table.column("qid").combine_chunks(), _matrix(table.column("q").combine_chunks(), dim) if table.num_rows else None))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, matrix = block.value
        if matrix is None:
            return
        best = Best(matrix, k)
        for ids, vectors in _blocks(batches, min(BLOCK_VECTORS, RESULT_CELLS), dim):
            best.add(vectors, ids)
        if best.ids is not None:
            yield from best.rows(qids).to_batches(max_chunksize=OUT_ROWS)

    return base.mapInArrow(scan, types)


def _in_type(rows: pa.Table, schema: pa.Schema) -> pa.Table:
    return rows.select(schema.names).cast(schema)


def _search_grid(base: DataFrame, asked: DataFrame, dim: int, k: int, types: str, query_bytes: int = BROADCAST_BYTES) -> DataFrame:
    v_blocks = max(1, -(-base.count() // grid_rows(dim)))
    left = base.withColumn("vb", F.pmod(F.xxhash64("doc_id", "v"), F.lit(v_blocks)).cast("int"))

    def score(docs: pa.Table, questions: pa.Table) -> pa.Table:
        best = Best(_matrix(questions["q"].combine_chunks(), dim), k)
        for ids, vectors in _blocks(docs.select(["doc_id", "v"]).to_batches(), min(BLOCK_VECTORS, RESULT_CELLS), dim):
            best.add(vectors, ids)
        return best.rows(questions["qid"].combine_chunks())

    return on_grid(left, asked, v_blocks, grid_rows(dim, k, query_bytes), score, types)


def grid_rows(dim: int, k: int = 1, block_bytes: int = BROADCAST_BYTES) -> int:
    """Rows of a block of a grid: a fourth of the byte bound, and no more kept rows than the bound."""
    return max(1, min(block_bytes // (4 * dim * 8), RESULT_CELLS // k))


def on_grid(left: DataFrame, asked: DataFrame, v_blocks: int, q_rows: int, score: Callable[[pa.Table, pa.Table], pa.Table], types: str) -> DataFrame:
    """Rows of `score` of every block of vectors (numbered by `vb`) with every block of about q_rows queries, a task call each."""
    q_blocks = max(1, -(-asked.count() // q_rows))
    left = left.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    right = asked.withColumn("qb", F.pmod(F.xxhash64("qid", "q"), F.lit(q_blocks)).cast("int")).withColumn(
        "vb", F.explode(F.sequence(F.lit(0), F.lit(v_blocks - 1))))
    schema = to_arrow_schema(StructType.fromDDL(types))

    def cell(docs: pa.Table, questions: pa.Table) -> pa.Table:
        return _in_type(score(docs, questions), schema) if docs.num_rows and questions.num_rows else schema.empty_table()

    return left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb")).applyInArrow(cell, types)
