"""Batch inference jobs with offline models."""

import json

from pyspark.sql import functions as F

from bidweave.functions.names import cache_key
from bidweave.functions.text import product_text, search_text, spec_text, tender_text
from bidweave.operators import infer as I
from bidweave.operators.search import vector_search
from bidweave.plans.registry import NOTICES, query


HASHED = r"""tok AS MATERIALIZED (SELECT doc_id, md5(tok) AS h FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS tok FROM documents)),
  cell AS (SELECT doc_id, CAST('0x' || substr(h, 1, 8) AS BIGINT) % 64 AS k, sum(CASE WHEN substr(h, 9, 1) >= '8' THEN 1 ELSE -1 END) AS v FROM tok GROUP BY 1, 2)"""


@query("embed", f"""WITH {HASHED} SELECT d.doc_id, string_agg(CAST(coalesce(v, 0) AS BIGINT), ',' ORDER BY r.k) AS vector
  FROM documents d CROSS JOIN (SELECT range AS k FROM range(64)) r LEFT JOIN cell c ON c.doc_id = d.doc_id AND c.k = r.k GROUP BY 1""")
def embed(t):
    """Document vectors of the offline encoder, not scaled, so that every number is whole."""
    made = I.embed(t.documents, "doc_id", "text", I.hashing_encoder(64, unit=False))
    return made.select("doc_id", F.array_join(F.transform("embedding", lambda x: x.cast("long").cast("string")), ",").alias("vector"))


@query("embed_search")
def embed_search(t):
    """Benchmark texts against documents, both embedded offline."""
    docs = I.embed(t.documents, "doc_id", "text", I.hashing_encoder(64)).select(F.col("doc_id").alias("id"), "embedding")
    asked = I.embed(t.benchmark, "item_id", "text", I.hashing_encoder(64)).select(F.col("item_id").alias("qid"), "embedding")
    return vector_search(docs, asked, 64, 5).select("qid", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("extract_structured", """SELECT 'http://d/' || o_orderkey AS source_url, c_name AS buyer_name_std, n_name AS province,
  CASE WHEN o_orderstatus = 'F' THEN NULL ELSE round(floor(o_totalprice) * 10000, 2) END AS budget_amount,
  CASE WHEN o_orderstatus = 'F' THEN round(floor(o_totalprice) * 10000, 2) END AS winning_amount,
  CAST(least(100, CASE WHEN floor(o_totalprice) * 10000 >= 5000000 THEN 30 WHEN floor(o_totalprice) * 10000 >= 1000000 THEN 20 ELSE 10 END + 20 + 10) AS INTEGER) AS opportunity_score,
  'rules' AS llm_model, 700 + length(c_name) AS chars
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def extract_structured(t):
    """Orders as detail pages; pages already extracted (with returned packages) are left out."""
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    url = F.concat(F.lit("http://d/"), F.col("o_orderkey").cast("string"))
    # longer than a former summary
    text = F.concat(F.lit("招标" * 350), "c_name", F.lit("\n公开招标\n采购人："), "c_name", F.lit("（总部）\n地区："), "n_name", F.lit("\n预算金额：人民币"),
                    F.floor("o_totalprice").cast("string"), F.lit(" 万元整\n"))
    pages = rows.select(url.alias("url"), F.when(F.col("o_orderstatus") == "F", "中标公告").otherwise("招标公告").alias("title"),
                        F.col("o_orderdate").alias("publish_date"), text.alias("content"))
    done = t.lineitem.filter("l_returnflag = 'R'").select(F.concat(F.lit("http://d/"), F.col("l_orderkey").cast("string")).alias("source_url"))
    made = I.extract_structured(pages, done)
    return made.select("source_url", "buyer_name_std", "province", "budget_amount", "winning_amount", "opportunity_score", "llm_model",
                       F.length(F.substring_index("content_summary", " 公开招标", 1)).cast("long").alias("chars"))


def _spec_model():
    """Stands for a model: one readable item about each text, and one broken item."""
    def answer(prompts):
        return ["好的 {\"items\": [" + json.dumps({"产品名称": p[-8:], "数量": str(len(p))}, ensure_ascii=False) + ", {bad}]" for p in prompts]
    return answer


@query("extract_specs", """SELECT doc_id, right(text, 8) AS product_name, '数量: ' || length(text) AS requirement FROM documents
  WHERE length(trim(text)) >= 50 AND NOT regexp_matches(right(text, 8), '[{}]')""")
def extract_specs(t):
    return I.extract_specs(t.documents.select("doc_id", "text"), _spec_model, "doc_id").select("doc_id", "product_name", "requirement")


def _advice_model():
    return lambda prompts: [f"Thinking: about it\n切入点 {p}" for p in prompts]


@query("suggest", f"""WITH {NOTICES}, r AS (SELECT DISTINCT md5(buyer_name_std || '|' || city) AS cache_key, buyer_name_std AS prompt, city FROM notices)
  SELECT cache_key, prompt, CASE city WHEN 'MACHINERY' THEN 'known' ELSE '切入点 ' || prompt END AS suggestions FROM r""")
def suggest(t):
    requests = t.notices.select(cache_key("buyer_name_std", "city").alias("cache_key"), F.col("buyer_name_std").alias("prompt"), "city").distinct()
    cache = requests.filter(F.col("city") == "MACHINERY").select("cache_key", F.lit("known").alias("suggestions"), F.lit(0).alias("created_at"))
    answers, _ = I.suggest(requests, cache, _advice_model)
    strip = F.regexp_replace("suggestions", r"^about it\s*", "")
    return answers.select("cache_key", "prompt", strip.alias("suggestions"))


def _verdict_model():
    def answer(prompts):
        return [None if len(p) % 7 == 0 else "不清楚" if len(p) % 7 == 1 else
                json.dumps({"intent_verdict": "具体产品", "matched_products": ["甲"], "reason": "r"}, ensure_ascii=False) for p in prompts]
    return answer


@query("ask_intent", r"""WITH b AS (SELECT conv_id, turn, length(trim(regexp_replace(text, '[\s\x0B\x{00A0}\x{3000}]+', ' ', 'g'))) AS n, length(role) AS m FROM conversations), x AS (SELECT *, (n + m + 7) % 7 AS k FROM b)
  SELECT conv_id, turn, CASE WHEN n < 50 THEN '正文缺失' WHEN k = 0 THEN 'LLM调用失败' WHEN k = 1 THEN '解析失败' ELSE '具体产品' END AS intent_verdict,
    CASE WHEN n >= 50 AND k > 1 THEN '甲' ELSE '' END AS matched FROM x""")
def ask_intent(t):
    rows = t.conversations.withColumn("key", F.concat_ws("-", "conv_id", "turn"))
    got = I.ask_intent(rows, "key", _verdict_model, "role", "text")
    return got.select("conv_id", "turn", "intent_verdict", F.array_join("matched_products", "").alias("matched"))


@query("embedding_texts", f"""WITH {NOTICES} SELECT tender_id, '采购关键词: ' || announce_type || ', ' || city || ' | 应用场景: ' || application_scenario || ' | 技术要求摘要: '
  || technical_requirements_summary || ' | 内容摘要: ' || content_summary || ' | 中标产品: ' || coalesce(winning_bidder, '') AS text FROM notices""")
def embedding_texts(t):
    rows = t.notices.withColumn("winning_product", F.array_compact(F.array("winning_bidder")))
    return rows.select("tender_id", tender_text().alias("text"))


@query("search_texts", """SELECT p_partkey, p_name || ' ' || p_brand || ' ' || p_type || ' x' AS text, p_name || ' | ' || p_type AS spec FROM part""")
def search_texts(t):
    rows = t.part.withColumn("features", F.array(F.col("p_type"), F.lit("x"))).withColumn("product_names", F.array("p_name")).withColumn(
        "specifications", F.array().cast("array<string>")).withColumn("technical_params", F.array("p_type"))
    return rows.select("p_partkey", search_text(["p_name", "p_brand"], ["features"]).alias("text"), spec_text().alias("spec"))


@query("product_texts", "SELECT p_partkey, p_name || ' ' || p_brand || ' ' || p_type || ' ' || p_size AS text FROM part")
def product_texts(t):
    return t.part.select("p_partkey", product_text(["p_name", "p_brand", "p_type", "p_size"]).alias("text"))
