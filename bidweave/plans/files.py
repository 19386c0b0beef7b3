"""Files in and out: the tables are written to the shared folder in the form a source expects, and read back."""

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructType

from bidweave.functions import html as H
from bidweave.operators import pages as G
from bidweave.operators import tables as T
from bidweave.plans.registry import LEADS, OPPORTUNITIES, query
from bidweave.rules import LEAD_COLUMNS, OPPORTUNITY_COLUMNS
from bidweave.session import cut, shared_dir
from bidweave.sources import crm as CRM
from bidweave.sources import files as S
from bidweave.streaming import notices as N


def _place(t, name):
    return f"{shared_dir(t.spark).rstrip('/')}/files/{name}-{uuid.uuid4().hex}"


ORDER = StructType().add("o_orderkey", LongType()).add("o_orderpriority", StringType()).add("o_totalprice", DoubleType())


def _lines(t):
    """Orders as JSON lines; every tenth line is broken."""
    path = _place(t, "lines")
    whole = F.to_json(F.struct("o_orderkey", "o_orderpriority", "o_totalprice"))
    broken = F.concat(F.lit("{broken "), F.col("o_orderkey").cast("string"))
    t.orders.select(F.when(F.col("o_orderkey") % 10 == 0, broken).otherwise(whole).alias("value")).write.text(path)
    return path


@query("jsonl_rows", """SELECT CASE WHEN o_orderkey % 10 <> 0 THEN o_orderkey END AS o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice END AS o_totalprice,
  CASE WHEN o_orderkey % 10 = 0 THEN '{broken ' || o_orderkey END AS bad FROM orders""")
def jsonl_rows(t):
    rows = cut(S.read_jsonl(t.spark, _lines(t), ORDER))  # Spark refuses to read the bad lines alone
    return rows.select("o_orderkey", "o_totalprice", F.col("_bad").alias("bad"))


@query("jsonl_good_rows", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderkey % 10 <> 0")
def jsonl_good_rows(t):
    return S.read_jsonl(t.spark, _lines(t), ORDER, "drop")


@query("jsonl_round_trip", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem")
def jsonl_round_trip(t):
    path, rows = _place(t, "rows"), t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    S.write_jsonl(rows, path)
    return S.read_json_any(t.spark, path, rows.schema)


def _parts(df, rows):
    """Number of parts of about `rows` rows."""
    return max(1, -(-df.count() // rows))


@query("json_arrays", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def json_arrays(t):
    """Files of about 500 customers, an array each; their number follows the table."""
    path, parts = _place(t, "arrays"), _parts(t.customer, 500)
    row, part = F.to_json(F.struct("c_custkey", "c_name", "c_acctbal")), F.pmod(F.xxhash64("c_custkey"), F.lit(parts)).alias("part")
    arrays = t.customer.groupBy(part).agg(F.concat(F.lit("["), F.array_join(F.collect_list(row), ","), F.lit("]")).alias("value"))
    arrays.repartition("part").write.partitionBy("part").text(path)
    return S.read_json_any(t.spark, path, t.customer.select("c_custkey", "c_name", "c_acctbal").schema).drop("part")


@query("table_fallback", """SELECT 'absent' AS asked, c_custkey, c_name FROM customer UNION ALL SELECT 'empty', c_custkey, c_name FROM customer
  UNION ALL SELECT 'found', c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0""")
def table_fallback(t):
    """A table that is absent, one that is empty, and one that is there."""
    rows = t.customer.select("c_custkey", "c_name")
    rows.limit(0).createOrReplaceTempView("bidweave_empty")
    rows.filter("c_custkey % 2 = 0").createOrReplaceTempView("bidweave_found")
    asked = {"absent": "no_table_of_this_name", "empty": "bidweave_empty", "found": "bidweave_found"}
    found = [S.read_table_or(t.spark, name, rows).select(F.lit(k).alias("asked"), "c_custkey", "c_name") for k, name in asked.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


_TABLES = ["customer", "documents", "events", "nation", "orders", "region", "supplier"]


@query("list_tables", f"SELECT table_name AS name FROM information_schema.tables WHERE table_name IN ({', '.join(repr(n) for n in _TABLES)})")
def list_tables(t):
    for name in _TABLES:
        getattr(t, name).createOrReplaceTempView(name)
    return T.list_tables(t.spark).filter(F.col("name").isin(_TABLES))


def _export(t, rows, mapping, name):
    """Rows as a CSV export with the headers of the CRM; columns that the rows lack are left out."""
    path = _place(t, name)
    rows.select(*[F.col(c).cast("string").alias(h) for h, c in mapping.items() if c in rows.columns]).write.option("header", "true").csv(path)
    return CRM.read_export(t.spark, path)


@query("opportunity_export", f"""WITH {OPPORTUNITIES} SELECT credit_code, opportunity_id, customer_name, value, CASE WHEN CAST(opportunity_id AS BIGINT) % 2 = 0 THEN true ELSE false END AS is_linked, '' AS lead_name
  FROM opps WHERE CAST(opportunity_id AS BIGINT) % 9 <> 0""")
def opportunity_export(t):
    key = F.col("opportunity_id").cast("long")
    rows = t.opportunities.withColumn("is_linked", F.when(key % 2 == 0, "是").otherwise("否")).withColumn(
        "credit_code", F.when(key % 9 != 0, F.col("credit_code")))
    return CRM.load_opportunities(_export(t, rows, OPPORTUNITY_COLUMNS, "opportunities")).select(
        "credit_code", "opportunity_id", "customer_name", "value", "is_linked", "lead_name")


@query("lead_export", f"WITH {LEADS} SELECT credit_code, lead_id, customer_name, lead_status, salesperson FROM leads")
def lead_export(t):
    return CRM.load_leads(_export(t, t.leads, LEAD_COLUMNS, "leads")).select("credit_code", "lead_id", "customer_name", "lead_status", "salesperson")


# number of folders: about 20 documents each, however many there are
FOLDERS = "(SELECT greatest(1, ceil(count(*) / 20))::BIGINT FROM documents)"


def _folders(t):
    """Documents as text files, one folder (notice) for about 20 of them."""
    path = _place(t, "folders")
    rows = t.documents.select("doc_id", F.col("text").alias("value"), (F.col("doc_id") % _parts(t.documents, 20)).alias("notice"))
    rows.repartition("notice").sortWithinPartitions("notice", "doc_id").select("value", "notice").write.partitionBy("notice").text(path)
    return path


@query("attachment_files", f"""WITH d AS (SELECT doc_id % {FOLDERS} AS notice, text FROM documents)
  SELECT 'notice=' || notice AS tender_id, CAST(sum(strlen(text) + 1) AS BIGINT) AS file_size, 'txt' AS file_kind FROM d GROUP BY notice""")
def attachment_files(t):
    files = S.with_file_kind(S.scan_attachments(t.spark, _folders(t), content=True))
    return files.filter(F.endswith("file_name", F.lit(".txt"))).select("tender_id", "file_size", "file_kind")


@query("output_files", f"SELECT count(DISTINCT doc_id % {FOLDERS}) AS files, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes FROM documents")
def output_files(t):
    return S.list_output_files(t.spark, _folders(t), "*.txt").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query("decoded_texts", "SELECT doc_id, text FROM documents")
def decoded_texts(t):
    """Texts as bytes in two encodings."""
    wide = F.encode("text", "UTF-8")
    plain = F.encode("text", "ISO-8859-1")
    return S.decode_text(t.documents.select("doc_id", F.when(F.col("text").rlike(r"^\p{ASCII}*$"), plain).otherwise(wide).alias("content")), "doc_id")


@query("decoded_notices", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '中标' || o_orderpriority WHEN 1 THEN '中标' || o_orderpriority
  WHEN 2 THEN chr(131072) || o_orderpriority ELSE o_orderpriority END AS text FROM orders""")
def decoded_notices(t):
    """UTF-8, GBK, a character that only GB18030 has, and a byte that no encoding allows."""
    head = F.lit("中标").cast("binary")
    for k, code in ((1, "D6D0B1EA"), (2, "95328236"), (3, "FF")):  # 中标 in GBK, U+20000 in GB18030
        head = F.when(F.col("o_orderkey") % 4 == k, F.unhex(F.lit(code))).otherwise(head)
    return S.decode_text(t.orders.select("o_orderkey", F.concat(head, F.encode("o_orderpriority", "UTF-8")).alias("content")), "o_orderkey")


@query("parsed_texts", f"""WITH d AS (SELECT doc_id, doc_id % {FOLDERS} AS notice, text FROM documents)
  SELECT 'notice=' || notice AS tender_id, string_agg(text || chr(10), '' ORDER BY doc_id) AS text FROM d GROUP BY notice""")
def parsed_texts(t):
    root = _folders(t)
    manifest = S.scan_attachments(t.spark, root).filter(F.endswith("file_name", F.lit(".txt"))).select(
        "tender_id", "file_name", F.col("local_path").alias("parsed_path"))
    return S.load_parsed_text(t.spark, manifest, root).select("tender_id", "text")


@query("split_outputs", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'matched' ELSE 'filtered' END AS status FROM orders")
def split_outputs(t):
    path = _place(t, "split")
    S.write_split(t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "matched").otherwise("filtered").alias("status")), path)
    return t.spark.read.parquet(f"{path}/status=matched").withColumn("status", F.lit("matched")).unionByName(
        t.spark.read.parquet(f"{path}/status=filtered").withColumn("status", F.lit("filtered")))


@query("announce_types", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '中标公告' WHEN 'O' THEN '公开招标公告' ELSE o_orderpriority END AS kind FROM orders""")
def announce_types(t):
    """Type from the title's ending, else from the last channel of the breadcrumb."""
    title = F.concat("o_orderpriority", F.when(F.col("o_orderstatus") == "F", "项目中标公告").when(F.col("o_orderstatus") == "O", "公开招标公告").otherwise("说明"))
    html = F.concat(F.lit('<a class="CurrChnlCls">首页</a> <a href="x" class="a CurrChnlCls">'), "o_orderpriority", F.lit("</a>"))
    return t.orders.select("o_orderkey", H.announce_type(title, html).alias("kind"))


@query("body_segments", """SELECT o_orderkey, '采购内容 ' || o_orderpriority AS first, '技术需求 ' || o_orderstatus AS last FROM orders""")
def body_segments(t):
    html = F.concat(F.lit("<body><h1>x</h1><p>采购内容</p>"), "o_orderpriority", F.lit("</body>"))
    late = F.concat(F.lit("<p>采购需求</p>"), "o_orderpriority", F.lit("<p>技术需求</p>"), "o_orderstatus")
    return t.orders.select("o_orderkey", H.segment_first(html).alias("first"), H.segment_last(late).alias("last"))


@query("blocked_pages", """SELECT page_id, page_id % 3 <> 1 AS blocked, CASE page_id % 3 WHEN 2 THEN 0 ELSE page_id END AS found FROM pages""")
def blocked_pages(t):
    """A refused page, a result page, and a page without any result marker."""
    n = F.concat(F.lit("共找到 <b>"), F.col("page_id").cast("string"), F.lit("</b> 条"))
    text = F.when(F.col("page_id") % 3 == 0, F.concat(n, F.lit("访问频率"))).when(F.col("page_id") % 3 == 1, F.concat(F.col("html"), n)).otherwise("<p>x</p>")
    return t.pages.select("page_id", H.is_blocked(text).alias("blocked"), H.result_count(text).alias("found"))


@query("evolved_table", "SELECT o_orderkey, o_orderpriority, CAST(NULL AS DOUBLE) AS score, CAST(NULL AS VARCHAR) AS reason FROM orders")
def evolved_table(t):
    schema = StructType.fromDDL("o_orderkey long, score double, reason string")
    return T.evolve(t.orders.select("o_orderkey", "o_orderpriority"), schema)


_LONG = "采购需求说明" * 20


@query("stream_upsert", f"""WITH f AS (SELECT user_id, arg_max(event_type, event_id) AS kind FROM events GROUP BY 1)
  SELECT 'u' || user_id AS url, '{_LONG}' || kind AS content, CASE kind WHEN 'click' THEN 'matched' ELSE 'filtered' END AS status FROM f""")
def stream_upsert(t):
    """Events arrive as notices in three folders, one micro-batch each; the last one of a user decides."""
    place = _place(t, "upsert")
    rows = t.events.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"), F.lit("notice").alias("project_name"),
                           F.concat(F.lit(_LONG), "event_type").alias("content"), F.col("event_id").alias("seq"))
    third = -(-t.events.count() // 3)
    for k in range(3):
        rows.filter(F.least(F.floor(F.col("seq") / third), F.lit(2)) == k).write.json(f"{place}/in/{k}")
    schema = "url string, project_name string, content string, content_seq long, status string, category string, match_reason string"
    store = N.upsert_store(f"{place}/out", "url", ["content_seq"], {"clicks": {"keywords": ["click"], "exclude": []}}, schema)
    for k in range(3):
        stream = N.notice_stream(t.spark, f"{place}/in/[0-{k}]", rows.schema).withColumnRenamed("seq", "content_seq")
        stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{place}/checkpoint").foreachBatch(store).start().awaitTermination()
    return N.open_store(t.spark, f"{place}/out", "url", schema).read().select("url", "content", "status")
