"""The operators of this subpackage bound to the driver tables, next to their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bidweave.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql.strip()
        return fn
    return add


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@query("op7_pack_sequences")
def op7_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bidweave.llm.packing import pack
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op10_token_files")
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bidweave.llm.tokenfiles import token_files
    return token_files(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op3_quality_scores")
def op3_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bidweave.llm.rffquality import quality_scores
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_exact_duplicates", r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM t JOIN g USING (norm)""")
def op9_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bidweave.llm.quotient import exact_duplicates
    return exact_duplicates(table(spark, sf_dir, "documents"))


@query("op1_shard_documents")
def op1_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bidweave.llm.sharding import shard_documents
    return shard_documents(table(spark, sf_dir, "documents"), shards=16)


@query("op5_mix_sources")
def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bidweave.llm.mixture import mix_report
    return mix_report(table(spark, sf_dir, "documents"))


@query("op8_similar_documents")
def op8_similar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bidweave.llm.jaccard import similar_documents
    return similar_documents(table(spark, sf_dir, "documents"), size=4, percent=85)


def _divergence_sql() -> str:
    from bidweave.llm.divergence import SQL as text
    return text


@query("op2_divergence_rules", _divergence_sql())
def op2_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bidweave.llm.divergence import divergence_rules
    return divergence_rules(table(spark, sf_dir, "documents"))


def _license_sql() -> str:
    from bidweave.llm.licenses import sql
    return sql()


@query("op4_license_scan", _license_sql())
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bidweave.llm.licenses import license_scan
    return license_scan(table(spark, sf_dir, "documents"))


def _chat_sql() -> str:
    from bidweave.llm.chat import SQL as text
    return text


@query("op6_rotate_perspectives", _chat_sql())
def op6_rotate_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mask as text, `start-end` joined by semicolons."""
    from pyspark.sql import functions as F

    from bidweave.llm.chat import rotate
    spans = F.transform("mask", lambda m: F.concat(m["start"].cast("string"), F.lit("-"), m["end"].cast("string")))
    return rotate(table(spark, sf_dir, "conversations")).withColumn("mask", F.array_join(spans, ";"))


@query("op11_repeated_passages", r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(doc_id, 9223372036854775807) AS owner, hex(encode(coalesce(text, ''))) AS hex FROM documents),
c AS (SELECT row, owner, k, substr(hex, CAST(2000 * k + 1 AS BIGINT), 2098) AS hex FROM d, unnest(range(0, CAST(len(hex) // 2000 + 1 AS BIGINT))) AS t(k)),
w AS MATERIALIZED (SELECT row, owner, 1000 * k + j AS i, sha256(substr(hex, CAST(2 * j + 1 AS BIGINT), 100)) AS part
  FROM c, unnest(range(0, least(1000, CAST(len(hex) // 2 - 49 AS BIGINT)))) AS t(j) WHERE len(hex) >= 100),
m AS (SELECT part, min(owner) AS least FROM w GROUP BY part),
hit AS MATERIALIZED (SELECT row, i FROM w JOIN m USING (part) WHERE least < owner),
cut AS (SELECT *, i - lag(i, 1, -1000) OVER (PARTITION BY row ORDER BY i) > 50 AS new FROM hit),
run AS (SELECT row, min(i) AS a, max(i) + 50 AS b FROM (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY row ORDER BY i) AS k FROM cut) GROUP BY row, k),
gap AS (SELECT row, lag(b, 1, 0) OVER (PARTITION BY row ORDER BY a) AS x, a AS y, b FROM run),
piece AS (SELECT g.row, x, string_agg(substr(hex, CAST(2 * x + 1 AS BIGINT), CAST(2 * (y - x) AS BIGINT)), '' ORDER BY x) AS part FROM gap g JOIN d USING (row) GROUP BY 1, 2),
kept AS (SELECT row, string_agg(part, '' ORDER BY x) AS front FROM piece GROUP BY row),
sums AS (SELECT row, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last FROM run GROUP BY row)
SELECT doc_id, CAST(len(hex) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(front, '') || substr(hex, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM d LEFT JOIN sums USING (row) LEFT JOIN kept USING (row)""")
def op11_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from bidweave.llm.suffixdedup import drop_repeats
    cut = drop_repeats(table(spark, sf_dir, "documents"), width=50)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op12_hard_negatives", r"""
WITH r AS (SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.row AS anchor, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.row <> b.row WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id NULLS LAST) AS n FROM s WHERE same) WHERE n <= 5),
w AS (SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, s.id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor, p.n ORDER BY s.score DESC, s.id NULLS LAST) AS rank
  FROM p JOIN s USING (anchor) WHERE NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM w WHERE rank <= 10""")
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bidweave.llm.negatives import hard_negatives
    return hard_negatives(table(spark, sf_dir, "embeddings"))


@query("op13_ranked_search", r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS terms FROM documents),
b AS (SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS terms FROM benchmark),
q AS MATERIALIZED (SELECT item, item_id, term, count(*) AS times FROM (SELECT item, item_id, unnest(terms) AS term FROM b) GROUP BY ALL),
n AS MATERIALIZED (SELECT row, doc_id, CAST(len(terms) AS BIGINT) AS n FROM d WHERE len(terms) > 0),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM n),
tf AS MATERIALIZED (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY term, docs),
m AS (SELECT row, doc_id, 100 - 75 + ((75 * n * docs) // length) AS m FROM n, s),
r AS (SELECT item, item_id, doc_id, row, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (row) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM r WHERE score > 0) WHERE rank <= 10""")
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bidweave.llm.lexical import search
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
