"""Column expressions inside table jobs."""

from pyspark.sql import functions as F

from bidweave.functions import jsonx as J
from bidweave.functions import names as N
from bidweave.functions import text as X
from bidweave.plans.registry import query


@query("normalize_names", """SELECT c_custkey, c_name || 'A' AS project, c_name AS org FROM customer""")
def normalize_names(t):
    name = F.concat("c_name", F.lit("（二次）A(包1)中标公告招标公告"))
    org = F.concat("c_name", F.lit("（"), "c_mktsegment", F.lit("）"), F.lit("(x)"))
    return t.customer.select("c_custkey", F.replace(N.normalize_project_name(name), F.lit("中标公告"), F.lit("")).alias("project"),
                             N.standardize_org(org).alias("org"))


@query("money", """SELECT o_orderkey, round(floor(o_totalprice) * CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 10000 ELSE 100000000 END, 2) AS yuan,
  printf('%.2f万元', floor(o_totalprice) * CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 10000 ELSE 100000000 END / 10000) AS shown,
  CASE WHEN y >= 500 THEN '大额' WHEN y >= 100 THEN '中等' ELSE '小额' END AS level
  FROM (SELECT *, floor(o_totalprice) * CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 10000 ELSE 100000000 END / 10000 AS y FROM orders)""")
def money(t):
    unit = F.when(F.col("o_orderstatus") == "F", " 元").when(F.col("o_orderstatus") == "O", "万元").otherwise(" 亿元")
    rows = t.orders.select("o_orderkey", N.parse_money(F.concat(F.lit("人民币 "), F.format_number(F.floor("o_totalprice"), 0), unit)).alias("yuan"))
    return rows.select("o_orderkey", "yuan", N.budget_display("yuan").alias("shown"), N.budget_level("yuan").alias("level"))


@query("opportunity_scores", """WITH r AS (SELECT o_orderkey, least(100, CASE WHEN o_totalprice * 20 >= 5000000 THEN 30 WHEN o_totalprice * 20 >= 1000000 THEN 20 ELSE 10 END
    + CASE o_orderstatus WHEN 'F' THEN 30 WHEN 'O' THEN 25 ELSE 20 END + CASE WHEN o_orderpriority = '1-URGENT' THEN 30 WHEN o_orderpriority = '2-HIGH' THEN 20 ELSE 10 END + 20) AS s FROM orders)
  SELECT o_orderkey, CAST(s AS INTEGER) AS score, CASE WHEN s >= 80 THEN '高' WHEN s >= 60 THEN '中' ELSE '低' END AS level FROM r""")
def opportunity_scores(t):
    buyer = F.when(F.col("o_orderstatus") == "F", "东南大学").when(F.col("o_orderstatus") == "O", "应急管理局").otherwise("某公司")
    method = F.when(F.col("o_orderpriority") == "1-URGENT", "单一来源").when(F.col("o_orderpriority") == "2-HIGH", "竞争性磋商").otherwise("公开招标")
    score = N.opportunity_score(F.col("o_totalprice") * 20, buyer, method, F.lit(20))
    return t.orders.select("o_orderkey", score.alias("score")).withColumn("level", N.opportunity_level("score"))


@query("text_cuts", """SELECT doc_id, CASE WHEN length(text) > 3000 THEN left(text, 2000) || ' ... ' || right(text, 500) ELSE text END AS middle,
  CASE WHEN length(text) > 100 THEN left(text, 99) || '…' ELSE text END AS cell, CASE WHEN length(text) > 20 THEN left(text, 20) || '...' ELSE text END AS dots,
  left('#' || doc_id || ' ' || source || ' — ' || lang, 200) AS label, length(trim(text)) < 50 AS short FROM documents""")
def text_cuts(t):
    from bidweave.operators.filters import text_gate
    return t.documents.select("doc_id", X.truncate_middle("text", 3000, 2000, 500, " ... ").alias("middle"), X.shorten("text", 100).alias("cell"),
                              X.preview("text", 20, True).alias("dots"), X.label("doc_id", "source", "lang").alias("label"),
                              text_gate("text", 50).alias("short"))


@query("clean_texts", r"""SELECT doc_id, trim(regexp_replace(text, '[\s\x0B\x{0085}\x{00A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) AS line,
  CASE WHEN trim(text) = '' THEN 'None' ELSE text END AS filled FROM documents""")
def clean_texts(t):
    return t.documents.select("doc_id", X.clean_text("text").alias("line"), X.nonblank("text").alias("filled"))


@query("reply_cleaning", """SELECT conv_id, turn, CAST(turn AS VARCHAR) AS answer, 1 AS good_items, 'ok ' || conv_id AS advice FROM conversations""")
def reply_cleaning(t):
    reply = F.concat(F.lit("<think>{a}"), F.regexp_replace("text", r"[{}<>]", ""), F.lit("</think> Sure: {\"answer\": \""), F.col("turn").cast("string"),
                     F.lit("\"} done"))
    items = F.concat(F.lit("[{\"k\": \"1\"}, {\"k\": oops}, {"), F.regexp_replace("text", r"[{}\"]", ""), F.lit("}"))
    advice = F.concat(F.lit("Thinking Process: "), "text", F.lit("</thought> ok "), F.col("conv_id").cast("string"), F.lit(" * Avoid fluff and more"))
    return t.conversations.select("conv_id", "turn", J.reply_to_struct(reply, "struct<answer:string>")["answer"].alias("answer"),
                                  F.size(J.salvage_items(items, "struct<k:string>")).alias("good_items"), X.strip_markers(advice).alias("advice"))


@query("json_fields", """SELECT o_orderkey, 2 AS listed, 1 AS single, '["u' || o_orderkey || '","v"]' AS urls, CAST(2 AS INTEGER) AS attachments FROM orders""")
def json_fields(t):
    key = F.col("o_orderkey").cast("string")
    link = F.array(F.struct(F.concat(F.lit("u"), key).alias("download_url"), F.lit("x").alias("url")),
                   F.struct(F.lit("").alias("download_url"), F.lit("v").alias("url")))
    urls = J.attachment_urls(link)
    return t.orders.select("o_orderkey", F.size(J.as_array(F.concat(F.lit('["a","'), key, F.lit('"]')))).alias("listed"),
                           F.size(J.as_array("o_orderpriority")).alias("single"), urls.alias("urls"), J.attachment_count(urls).alias("attachments"))


@query("nested_totals", """SELECT o_orderkey, 3 AS n, round(o_totalprice * 2, 2) AS total FROM orders""")
def nested_totals(t):
    value = F.col("o_totalprice").cast("string")
    items = F.array(*[F.struct(v.alias("value")) for v in (value, F.lit("n/a"), value)])
    return t.orders.select("o_orderkey", J.nested_count(items).alias("n"), F.round(J.nested_sum(items, "value"), 2).alias("total"))


@query("safe_casts", """SELECT event_id, coalesce(TRY_CAST(CASE WHEN event_type = 'error' THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS DOUBLE), 0.0) AS number,
  event_type = 'click' AS flag, md5(event_type || '||' || user_id) AS cache_key, event_type NOT IN ('', 'nan') AS real FROM events""")
def safe_casts(t):
    raw = F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("value").cast("string"))
    flag = F.when(F.col("event_type") == "click", "是").otherwise("否")
    return t.events.select("event_id", N.safe_float(raw).alias("number"), N.yes_no(flag).alias("flag"),
                           N.cache_key("event_type", F.lit(None), "user_id").alias("cache_key"), X.not_nan("event_type").alias("real"))


@query("contacts", """SELECT c_custkey, c_name AS main_name, '采购单位：' || c_name || ' 1；代理机构：无；项目联系人：' || CASE WHEN c_mktsegment = 'BUILDING' THEN '无' ELSE c_mktsegment || ' 2' END AS chunk,
  CASE WHEN c_mktsegment = 'BUILDING' THEN c_name ELSE c_mktsegment END AS chosen, CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE c_mktsegment END AS first FROM customer""")
def contacts(t):
    kind = "array<struct<name:string,phone:string>>"
    buyer = N.fill_contacts(F.array(F.struct(F.lit("").alias("name"), F.lit("1").alias("phone"))), "c_name")
    person = F.array(F.struct(F.col("c_mktsegment").alias("name"), F.lit("2").alias("phone")))
    project = F.when(F.col("c_mktsegment") == "BUILDING", F.array().cast(kind)).otherwise(person)
    return t.customer.select("c_custkey", buyer[0]["name"].alias("main_name"),
                             N.contact_chunk(buyer, F.array().cast(kind), project).alias("chunk"),
                             N.main_contact(project, buyer)["name"].alias("chosen"), N.first_contact(project, "name").alias("first"))


@query("project_contexts", """SELECT o_orderkey, '项目名称：' || o_orderpriority || chr(10) || '采购单位：' || o_custkey || chr(10) || '预算金额：未知' || chr(10) || '内容摘要：无' || chr(10) || '技术要点：无'
  || chr(10) || '应用场景：' || o_orderstatus || chr(10) || '产品关键词：' || o_orderstatus AS context FROM orders""")
def project_contexts(t):
    none = F.lit(None).cast("string")
    rows = t.orders.select("o_orderkey", F.col("o_orderpriority").alias("project_name_std"), F.col("o_custkey").alias("buyer_name"), none.alias("total_budget"),
                           none.alias("content_summary"), none.alias("technical_requirements_summary"), F.col("o_orderstatus").alias("application_scenario"),
                           F.array("o_orderstatus").alias("product_keywords"))
    return rows.select("o_orderkey", X.project_context().alias("context"))
