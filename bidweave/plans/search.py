"""Chunks, keyword search, vector search and their fusion."""

import uuid

from pyspark.sql import functions as F

from bidweave.functions.jsonx import metadata_json
from bidweave.operators import balls as BA
from bidweave.operators import chunks as CH
from bidweave.operators import fusion as FU
from bidweave.operators import search as SE
from bidweave.operators import segment as SG
from bidweave.operators.projects import project_events
from bidweave.operators.stats import chunk_stats
from bidweave.plans.projects import LIFECYCLE, projects
from bidweave.plans.registry import NOTICES, query
from bidweave.session import shared_dir

DIM = 64


def bm25_sql(docs: str, key: str, queries: str, qid: str) -> str:
    """CTEs up to sc(qid, doc_id, score): every document that shares a term with the query."""
    words = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
    return f"""tok AS MATERIALIZED (SELECT {key} AS doc_id, unnest({words}) AS term FROM {docs}),
  tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY 1, 2),
  dl AS (SELECT {key} AS doc_id, len({words}) AS dl FROM {docs}), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
  raw AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), st),
  mean AS MATERIALIZED (SELECT avg(r) AS m FROM raw), idf AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * m ELSE r END AS idf FROM raw, mean),
  q AS (SELECT qid, term, count(*) AS qf FROM (SELECT {qid} AS qid, unnest({words}) AS term FROM {queries}) GROUP BY 1, 2),
  sc AS (SELECT qid, doc_id, round(sum(qf * idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))) * 1e9) / 1e9 AS score
    FROM q JOIN idf USING (term) JOIN tf USING (term) JOIN dl USING (doc_id), st GROUP BY 1, 2)"""


BM25 = bm25_sql("documents", "doc_id", "benchmark", "item_id")
UNIT = """e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
  unit AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM e)"""


def vector_sql(ids: str, k: int, known: str = "SELECT doc_id FROM documents") -> str:
    return f"""{UNIT}, vs AS (SELECT a.vec_id AS qid, b.vec_id AS doc_id, round(list_inner_product(a.v, b.v) * 1e9) / 1e9 AS score
    FROM unit a, unit b WHERE a.vec_id IN ({ids}) AND b.vec_id IN ({known})),
  vr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM vs QUALIFY rank <= {k})"""


def index(t):
    return SE.bm25_index(t.documents, "doc_id")


def asked(t):
    """Benchmark texts as products, each with the stored vector of its number."""
    vectors = t.embeddings.select(F.col("vec_id").alias("qid"), "embedding")
    return t.benchmark.select(F.col("item_id").alias("qid"), "text").join(vectors, "qid", "left")


def vectors(t):
    """Vectors of the documents that exist."""
    known = t.documents.select(F.col("doc_id").alias("id"))
    return t.embeddings.select(F.col("vec_id").alias("id"), "embedding").join(known, "id", "left_semi")


@query("term_stats", r"""WITH t AS MATERIALIZED (SELECT list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS terms FROM documents),
  d AS MATERIALIZED (SELECT term, count(*) AS df FROM (SELECT unnest(terms) AS term FROM t) GROUP BY 1),
  r AS MATERIALIZED (SELECT term, df, ln((SELECT count(*) FROM t) - df + 0.5) - ln(df + 0.5) AS r FROM d)
  SELECT term, df, round(CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM r) ELSE r END, 6) AS idf FROM r""")
def term_stats(t):
    return index(t).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query("corpus_stats", f"WITH {BM25} SELECT n AS n_docs, round(avgdl, 6) AS avgdl FROM st")
def corpus_stats(t):
    return SE.corpus_stats(index(t).counts).select("n_docs", F.round("avgdl", 6).alias("avgdl"))


@query("tokenize", f"WITH {BM25} SELECT doc_id, term, tf FROM tf")
def tokenize(t):
    return SE.tokenize(t.documents, "doc_id")


@query("tokenize_han", """SELECT o_orderkey, term, count(*) AS tf FROM (SELECT o_orderkey, unnest(list_concat(['采', '购', '采购', '公', '告', '公告'],
  regexp_extract_all(lower(o_orderpriority), '[a-z0-9]+'))) AS term FROM orders) GROUP BY ALL""")
def tokenize_han(t):
    """Han characters come alone and in pairs, between words of another script."""
    return SE.tokenize(t.orders.select("o_orderkey", F.concat(F.lit("采购"), "o_orderpriority", F.lit("公告")).alias("text")), "o_orderkey")


@query("tokenize_words", """WITH n AS (SELECT o_orderkey, o_orderstatus AS s FROM orders)
  SELECT o_orderkey, term, count(*) AS tf FROM (SELECT o_orderkey, unnest(list_concat(['p' || (o_orderkey % 3)], CASE s WHEN 'F' THEN ['中标公告', '采购']
    WHEN 'O' THEN ['公开招标公告', '采购'] ELSE ['更正公告', '采', '购'] END)) AS term FROM n) GROUP BY ALL""")
def tokenize_words(t):
    """Titles cut by a dictionary that is learned from the titles; a word that it lacks falls apart into characters."""
    words = SG.learn_words(t.notices.filter("project_name IS NOT NULL"), ["project_name"])
    buying = t.orders.filter("o_orderstatus <> 'P'").select(F.lit("采购").alias("word"), F.lit(1).alias("n"))
    cut = {True: SG.segmenter(words.unionByName(buying.groupBy("word").agg(F.sum("n").alias("n")))), False: SG.segmenter(words)}
    rows = t.notices.select(F.col("tender_id").alias("o_orderkey"), F.concat("project_name", F.lit("采购")).alias("text"), (F.col("technical_requirements_summary") == "P").alias("rest"))
    found = [SE.tokenize(rows.filter(F.col("rest") != known), "o_orderkey", "text", cut[known]) for known in cut]
    return found[0].unionByName(found[1])


@query("bm25_topk", f"""WITH {BM25} SELECT qid, doc_id, round(score, 4) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank
  FROM sc WHERE score > 0 QUALIFY rank <= 10""")
def bm25_topk(t):
    found = SE.bm25_search(index(t), t.benchmark, "item_id", "text", 10)
    return found.select("qid", "doc_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


def stored_index(t):
    name = f"words_{uuid.uuid4().hex}"
    SE.write_index(index(t), name, 8, f"{shared_dir(t.spark).rstrip('/')}/index")
    return SE.read_index(t.spark, name)


@query("bm25_stored", f"""WITH {BM25} SELECT qid, doc_id, round(score, 4) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank
  FROM sc WHERE score > 0 QUALIFY rank <= 10""")
def bm25_stored(t):
    """The same search on an index kept by name: lists are read by term, and blocks below the k-th score are left out."""
    found = SE.bm25_search(stored_index(t), t.benchmark, "item_id", "text", 10, prune_docs=0)
    return found.select("qid", "doc_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("bm25_request", f"""WITH {BM25} SELECT doc_id, round(score, 4) AS score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank
  FROM sc WHERE score > 0 AND qid = (SELECT min(item_id) FROM benchmark) QUALIFY rank <= 10""")
def bm25_request(t):
    """One text asked of a stored index."""
    text = t.benchmark.orderBy("item_id").select("text").first()["text"]
    return SE.bm25_request(stored_index(t), text, 10).select("doc_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("vector_topk", f"WITH {vector_sql('SELECT vec_id FROM embeddings', 10, 'SELECT vec_id FROM embeddings')} SELECT qid, doc_id, round(score, 6) AS score, rank FROM vr")
def vector_topk(t):
    every = t.embeddings.select(F.col("vec_id").alias("id"), "embedding")
    found = SE.vector_search(every, every.withColumnRenamed("id", "qid"), DIM, 10)
    return found.select("qid", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("vector_topk_balls", f"WITH {vector_sql('SELECT vec_id FROM embeddings', 10, 'SELECT vec_id FROM embeddings')} SELECT qid, doc_id, round(score, 6) AS score, rank FROM vr")
def vector_topk_balls(t):
    """The same search over a stored index of balls."""
    path = f"{shared_dir(t.spark).rstrip('/')}/balls/{uuid.uuid4().hex}"
    every = t.embeddings.select(F.col("vec_id").alias("id"), "embedding")
    BA.write_ball_index(every, path, DIM)
    found, _ = BA.ball_search(BA.read_ball_index(t.spark, path, DIM), every.withColumnRenamed("id", "qid"), 10)
    return found.select("qid", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("vector_table", f"WITH {UNIT} SELECT vec_id AS id, round(v[1], 6) AS first, round(list_inner_product(v, v), 6) AS norm FROM unit")
def vector_table(t):
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    return SE.vector_table(t.embeddings.withColumnRenamed("vec_id", "id"), DIM).select("id", F.round(F.col("embedding")[0], 6).alias("first"), F.round(norm, 6).alias("norm"))


def fused_sql(width: int, docs: str = "true") -> str:
    return f"""{BM25}, {vector_sql('SELECT item_id FROM benchmark', width)},
  br AS (SELECT qid, doc_id, score, score / max(score) OVER (PARTITION BY qid) AS norm FROM sc WHERE score > 0),
  bt AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM br WHERE {docs} QUALIFY rank <= {width}),
  fused AS (SELECT coalesce(v.qid, b.qid) AS qid, coalesce(v.doc_id, b.doc_id) AS doc_id,
    coalesce(0.5::DOUBLE / (60 + v.rank), 0.0::DOUBLE) + coalesce(0.5::DOUBLE / (60 + b.rank), 0.0::DOUBLE) AS rrf,
    coalesce(v.score, 0.0) AS vector_score, coalesce(b.score, 0.0) AS bm25_score, coalesce(b.norm, 0.0) AS bm25_norm
    FROM vr v FULL JOIN bt b ON v.qid = b.qid AND v.doc_id = b.doc_id)"""


SHOWN = """round(rrf * 1000, 4) AS score, round(rrf, 6) AS rrf_raw_score, round(vector_score, 4) AS vector_score, round(bm25_score, 2) AS bm25_score,
  round(bm25_norm, 4) AS bm25_norm_score"""


@query("hybrid_rrf", f"""WITH {fused_sql(50)} SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, doc_id) AS rank, {SHOWN}
  FROM fused QUALIFY rank <= 10""")
def hybrid_rrf(t):
    return FU.hybrid_search(index(t), vectors(t), asked(t), 10, DIM).withColumn("rank", F.col("rank").cast("long"))


@query("hybrid_bm25_only", f"""WITH {BM25}, b AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0 QUALIFY rank <= 10)
  SELECT qid, doc_id, rank, round(500::DOUBLE / (60 + rank), 4) AS score FROM b""")
def hybrid_bm25_only(t):
    return FU.hybrid_search(index(t), None, asked(t), 10).select("qid", "doc_id", F.col("rank").cast("long").alias("rank"), "score")


@query("hybrid_filtered", f"""WITH {BM25}, br AS (SELECT qid, doc_id, score, score / max(score) OVER (PARTITION BY qid) AS norm FROM sc WHERE score > 0)
  SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) - 1 AS bm25_rank, round(score, 4) AS bm25_score, round(norm, 6) AS bm25_norm
  FROM br JOIN documents USING (doc_id) WHERE contains(source, 'src1') AND lang = 'en' QUALIFY bm25_rank < 20""")
def hybrid_filtered(t):
    docs = t.documents.withColumn("accepted", F.contains("source", F.lit("src1")) & (F.col("lang") == "en"))
    found = FU.bm25_channel(SE.bm25_index(docs, "doc_id", keep=("accepted",)), asked(t), 20, accept="accepted")
    return found.select("qid", "doc_id", F.col("bm25_rank").cast("long").alias("bm25_rank"), F.round("bm25_score", 4).alias("bm25_score"),
                        F.round("bm25_norm", 6).alias("bm25_norm"))


@query("linear_fusion", f"""WITH {BM25}, {vector_sql('SELECT item_id FROM benchmark', 20)}, m AS (SELECT qid, max(score) AS m FROM sc GROUP BY 1),
  al AS (SELECT b.item_id AS qid, d.doc_id, coalesce(v.score, 0.0::DOUBLE) AS vector_score, coalesce(sc.score, 0.0) / m AS bm25_score
    FROM benchmark b CROSS JOIN documents d LEFT JOIN m ON b.item_id = m.qid LEFT JOIN sc ON sc.qid = b.item_id AND sc.doc_id = d.doc_id
    LEFT JOIN vr v ON v.qid = b.item_id AND v.doc_id = d.doc_id),
  x AS (SELECT *, 0.5::DOUBLE * vector_score + 0.5::DOUBLE * bm25_score AS total FROM al)
  SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY total DESC, doc_id) AS rank, round(total, 6) AS score, round(vector_score, 6) AS vector_score,
    round(bm25_score, 6) AS bm25_score FROM x WHERE total >= 0 QUALIFY rank <= 10""")
def linear_fusion(t):
    return FU.linear_search(index(t), vectors(t), asked(t), 10, DIM).withColumn("rank", F.col("rank").cast("long"))


BACK = bm25_sql("benchmark", "item_id", "documents", "doc_id")


@query("products_for_tenders", f"""WITH {BACK}, m AS (SELECT qid, max(score) AS m FROM sc GROUP BY 1),
  al AS (SELECT d.doc_id AS qid, b.item_id AS doc_id, coalesce(sc.score / m, 0.0) AS bm25_score FROM documents d CROSS JOIN benchmark b
    LEFT JOIN m ON m.qid = d.doc_id LEFT JOIN sc ON sc.qid = d.doc_id AND sc.doc_id = b.item_id)
  SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY bm25_score DESC, doc_id) AS rank, round(bm25_score, 6) AS score FROM al QUALIFY rank <= 5""")
def products_for_tenders(t):
    """Documents ask, the benchmark items are the small catalogue."""
    found = FU.linear_search(SE.bm25_index(t.benchmark, "item_id"), None, t.documents.select(F.col("doc_id").alias("qid"), "text"), 5)
    return found.select("qid", "doc_id", F.col("rank").cast("long").alias("rank"), "score")


PROJECT_HITS = f"""{LIFECYCLE.replace('WITH ', '', 1)}, {fused_sql(500)},
  rolled AS (SELECT qid, n.project_name_std, n.buyer_name_std AS buyer_name, avg(rrf) AS rrf, avg(vector_score) AS vector_score, avg(bm25_score) AS bm25_score,
    avg(bm25_norm) AS bm25_norm, count(*) AS match_count FROM fused JOIN notices n ON n.tender_id = doc_id GROUP BY 1, 2, 3)"""


def project_hits(t, k):
    hits = FU.fused_hits(index(t), vectors(t), asked(t), k, DIM, by_project=True)
    where = t.notices.select(F.col("tender_id").alias("doc_id"), F.col("source_url").alias("url"))
    return hits, where, project_events(t.notices)


@query("project_search", f"""WITH {PROJECT_HITS},
  s AS (SELECT r.*, p.status, p.total_budget, round(r.rrf * 1000 * b, 4) AS score, round(b, 4) AS client_boost FROM rolled r JOIN projects p USING (project_name_std, buyer_name),
    LATERAL (SELECT CASE WHEN p.opportunity_score <> 0 THEN 1.0::DOUBLE + (0.8::DOUBLE + p.opportunity_score / 100.0::DOUBLE * 0.4::DOUBLE - 1.0::DOUBLE) * 0.5::DOUBLE ELSE 1.0::DOUBLE END AS b)
    WHERE p.status <> '已中标')
  SELECT qid, project_name_std, buyer_name, match_count, status, total_budget, score, client_boost,
    row_number() OVER (PARTITION BY qid ORDER BY score DESC, project_name_std, buyer_name) AS rank FROM s QUALIFY rank <= 10""")
def project_search(t):
    found = FU.project_search(*project_hits(t, 10), projects(t), 10, exclude_won=True, client_value_weight=0.5)
    return found.select("qid", "project_name_std", "buyer_name", "match_count", "status", "total_budget", "score", "client_boost",
                        F.col("rank").cast("long").alias("rank"))


@query("project_search_by_date", f"""WITH {PROJECT_HITS},
  s AS (SELECT r.*, p.latest_publish_date, round(r.rrf * 1000, 4) AS score FROM rolled r JOIN projects p USING (project_name_std, buyer_name)),
  k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, project_name_std, buyer_name) <= 10)
  SELECT qid, project_name_std, buyer_name, latest_publish_date, score,
    row_number() OVER (PARTITION BY qid ORDER BY latest_publish_date DESC, score DESC, project_name_std, buyer_name) AS rank FROM k""")
def project_search_by_date(t):
    found = FU.project_search(*project_hits(t, 10), projects(t), 10, sort_by="date")
    return found.select("qid", "project_name_std", "buyer_name", "latest_publish_date", "score", F.col("rank").cast("long").alias("rank"))


@query("direct_search", f"""WITH {PROJECT_HITS.replace('<= 500', '<= 1500')},
  s AS (SELECT r.*, p.total_budget, p.status, p.event_count, p.latest_publish_date, round(r.rrf * 1000, 4) AS score FROM rolled r JOIN projects p USING (project_name_std, buyer_name)),
  k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, project_name_std, buyer_name) <= 30)
  SELECT qid, project_name_std || '@' || buyer_name AS tender_id, score, CASE WHEN total_budget <> 0 THEN printf('%.2f万元', total_budget / 10000) ELSE '未知' END AS budget_display,
    '项目: ' || project_name_std || ' | 状态: ' || status || ' | 包含 ' || event_count || ' 条相关公告' AS document_preview, strftime(latest_publish_date, '%Y-%m-%d') AS publish_date,
    row_number() OVER (PARTITION BY qid ORDER BY score DESC, project_name_std, buyer_name) AS rank
  FROM k WHERE total_budget / 10000 >= 5 AND total_budget / 10000 <= 40 QUALIFY rank <= 10""")
def direct_search(t):
    wide = FU.project_search(*project_hits(t, 30), projects(t), 30)
    cards = FU.result_cards(FU.direct_search(wide, 10, min_budget=5, max_budget=40))
    return cards.select("qid", "tender_id", "score", "budget_display", "document_preview", "publish_date", F.col("rank").cast("long").alias("rank"))


@query("hit_links", f"""WITH {NOTICES}, {BM25}, b AS (SELECT qid, doc_id, score FROM sc WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) <= 5)
  SELECT qid, CAST(doc_id AS VARCHAR) AS id, source_url AS detail_url FROM b LEFT JOIN notices ON tender_id = doc_id""")
def hit_links(t):
    hits = SE.bm25_search(index(t), t.benchmark, "item_id", "text", 5)
    where = t.notices.select(F.col("tender_id").alias("doc_id"), F.col("source_url").alias("url"))
    linked = FU.with_detail_url(hits, where)
    return FU.serialise_hits(linked).join(linked.select("qid", F.col("doc_id").cast("string").alias("id"), "detail_url"), ["qid", "id"]).select("qid", "id", "detail_url")


@query("notice_cards", f"""WITH {NOTICES}, {fused_sql(50)}, h AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, doc_id) AS rank, {SHOWN} FROM fused QUALIFY rank <= 10)
  SELECT qid, rank, CAST(doc_id AS VARCHAR) AS tender_id, score, buyer_name_std, '采购项目: ' || project_name || ' | 需求: ' || application_scenario AS document_preview,
    source_url AS detail_url, strftime(publish_date, '%Y-%m-%d') AS publish_date FROM h JOIN notices n ON n.tender_id = doc_id WHERE score >= 8""")
def notice_cards(t):
    found = FU.hybrid_search(index(t), vectors(t), asked(t), 10, DIM)
    cards = FU.notice_cards(found, t.notices.withColumnRenamed("tender_id", "doc_id"), min_score=8)
    return cards.select("qid", F.col("rank").cast("long").alias("rank"), "tender_id", "score", "buyer_name_std", "document_preview", "detail_url", "publish_date")


# --- chunks ---

@query("field_chunks", f"""WITH {NOTICES}, c AS (
  SELECT tender_id, 'title' AS chunk_type, project_name AS chunk_text, 1 AS chunk_order FROM notices
  UNION ALL SELECT tender_id, 'content_summary', content_summary, 2 FROM notices
  UNION ALL SELECT tender_id, 'contact_chunk', contact_person, 3 FROM notices WHERE contact_person <> ''
  UNION ALL SELECT tender_id, 'requirement_chunk', announce_type, 4 FROM notices UNION ALL SELECT tender_id, 'requirement_chunk', city, 5 FROM notices
  UNION ALL SELECT tender_id, 'attachment_summary', 'A' || tender_id, 99 FROM notices WHERE technical_requirements_summary <> 'P')
  SELECT c.*, json_extract_string(CASE chunk_type
    WHEN 'contact_chunk' THEN '{{}}' ELSE '{{"buyer_name_std":"' || buyer_name_std || '"}}' END, '$.buyer_name_std') AS buyer
  FROM c JOIN notices USING (tender_id)""")
def field_chunks(t):
    none = F.array().cast("array<struct<name:string,phone:string>>")
    rows = t.notices.select(
        "tender_id", "announce_type", "buyer_name_std", "province", "city", "content_summary", F.col("contact_person").alias("contact_chunk"),
        F.array(F.struct(F.lit("technical_params").alias("type"), F.col("announce_type").alias("text")),
                F.struct(F.lit("other").alias("type"), F.col("city").alias("text"))).alias("requirement_chunks"),
        F.when(F.col("technical_requirements_summary") == "P", "无附件").otherwise(F.concat(F.lit("A"), F.col("tender_id").cast("string"))).alias("attachment_summary"),
        none.alias("buyer_contacts"), none.alias("agency_contacts"), none.alias("project_contacts"))
    out = CH.field_chunks(rows, t.notices.select("tender_id", "project_name"))
    return out.select("tender_id", "chunk_type", "chunk_text", "chunk_order", F.get_json_object("metadata_json", "$.buyer_name_std").alias("buyer"))


def _last(sign: str) -> str:
    """0-based position of the last occurrence in w, -1 when absent."""
    return f"CASE WHEN contains(w, {sign}) THEN length(w) - strpos(reverse(w), reverse({sign})) - length({sign}) + 1 ELSE -1 END"


SIGNS = ["chr(10)", "'。'", "'！'", "'？'", "'.'", "'!'", "'?'"]
CHUNKS = rf"""RECURSIVE s AS (SELECT doc_id, regexp_replace(text, '^[\s\x{{00A0}}\x{{3000}}]+|[\s\x{{00A0}}\x{{3000}}]+$', '', 'g') AS s FROM documents),
  step AS (SELECT doc_id, s, 0 AS a, 0 AS b, 0 AS n FROM s
    UNION ALL SELECT doc_id, s, a2, CASE WHEN length(s) <= 1500 THEN length(s) WHEN a2 + 1500 >= length(s) THEN a2 + 1500
      WHEN {_last('chr(10) || chr(10)')} > 500 THEN a2 + {_last('chr(10) || chr(10)')} + 2
      {' '.join(f"WHEN {_last(x)} > 750 THEN a2 + {_last(x)} + 1" for x in SIGNS)} ELSE a2 + 1500 END, n + 1
    FROM (SELECT doc_id, s, n, CASE WHEN n = 0 THEN 0 ELSE b - 150 END AS a2, substr(s, CASE WHEN n = 0 THEN 1 ELSE b - 149 END, 1500) AS w
      FROM step WHERE n = 0 OR length(s) > 1500) WHERE a2 < length(s)),
  pieces AS (SELECT doc_id, n, regexp_replace(substr(s, a + 1, b - a), '^[\s\x{{00A0}}\x{{3000}}]+|[\s\x{{00A0}}\x{{3000}}]+$', '', 'g') AS chunk_text FROM step WHERE n > 0),
  chunked AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) AS INTEGER) AS chunk_order, chunk_text FROM pieces WHERE chunk_text <> '')"""


@query("chunk_text", f"WITH {CHUNKS} SELECT * FROM chunked")
def chunk_text(t):
    return CH.chunk_text(t.documents, "doc_id")


@query("chunk_stats", f"""WITH {CHUNKS} SELECT doc_id AS tender_id, count(*) AS chunks, 'f' || doc_id AS source_file FROM chunked GROUP BY 1
  ORDER BY chunks DESC, tender_id LIMIT 10""")
def chunk_counts(t):
    key = F.col("doc_id").cast("string")
    parsed = t.documents.select(F.col("doc_id").alias("tender_id"), F.concat(F.lit("f"), key).alias("file_name"), "source", "text").withColumnRenamed("source", "source_path")
    return chunk_stats(CH.attachment_chunks(parsed))


@query("metadata_json", """SELECT event_id, '{"event_type":"' || event_type || '","user_id":' || user_id || ',"none":null}' AS meta FROM events""")
def metadata(t):
    return t.events.select("event_id", metadata_json(event_type="event_type", user_id="user_id", none=F.lit(None).cast("string")).alias("meta"))
