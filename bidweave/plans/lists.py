"""Notice lists, counts and summaries."""

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from bidweave import rules
from bidweave.operators import filters as L
from bidweave.operators import stats as S
from bidweave.operators import tables as T
from bidweave.plans.registry import NOTICES, query
from bidweave.plans.updates import CANON
from bidweave.session import shared_dir


@query("tender_list_filtered", f"""WITH {NOTICES} SELECT tender_id, project_name, publish_date, announce_type, province, city, budget_amount,
  opportunity_score, buyer_name_std FROM notices
  WHERE (contains(lower(project_name), 'urgent') OR contains(lower(buyer_name_std), 'urgent') OR contains(lower(content_summary), 'urgent'))
    AND city = 'MACHINERY' AND budget_amount >= 50000 AND budget_amount <= 400000 AND opportunity_score >= 20
    AND publish_date >= TIMESTAMP '1996-01-01' AND publish_date <= TIMESTAMP '2000-12-31'""")
def tender_list_filtered(t):
    found = L.list_tenders(t.notices, keyword="urgent", city="MACHINERY", min_budget=50000, max_budget=400000, min_score=20,
                           start_date=datetime(1996, 1, 1), end_date=datetime(2000, 12, 31))
    return found.select("tender_id", "project_name", "publish_date", "announce_type", "province", "city", "budget_amount",
                        "opportunity_score", "buyer_name_std")


@query("tender_page", """SELECT o_orderkey AS tender_id, o_orderdate AS publish_date, o_totalprice AS budget_amount FROM orders
  ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 40""")
def tender_page(t):
    rows = t.orders.select(F.col("o_orderkey").alias("tender_id"), F.col("o_orderdate").alias("publish_date"),
                           F.col("o_totalprice").alias("budget_amount"))
    return T.page(rows, [F.col("publish_date").desc(), F.col("tender_id").desc()], 3, 20)


@query("deep_page", """SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 20 OFFSET 39980""")
def deep_page(t):
    """Page 2000 from a table of positions: one folder of it is read."""
    path = f"{shared_dir(t.spark).rstrip('/')}/positions/{uuid.uuid4().hex}"
    T.write_positions(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"),
                      [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")], path, 5000)
    return T.page_at(t.spark, path, 2000, 20, 5000).drop("l_partkey")


@query("key_lookup", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_orderkey IN (1, 7, 33, 1000000007)")
def key_lookup(t):
    """A few keys from a table sorted by key; other row groups are not read."""
    path = f"{shared_dir(t.spark).rstrip('/')}/lookups/{uuid.uuid4().hex}"
    T.write_lookup(t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_orderkey", path, 256 * 1024)
    return T.rows_of(t.spark, path, "l_orderkey", 1, 7, 33, 1_000_000_007)


@query("latest_notices", "SELECT o_orderkey AS tender_id FROM orders ORDER BY o_orderkey DESC LIMIT 100")
def latest_notices(t):
    return T.latest(t.orders.select(F.col("o_orderkey").alias("tender_id")), 100, "tender_id")


@query("browse_page", "SELECT * FROM part ORDER BY p_partkey LIMIT 50 OFFSET 100")
def browse_page(t):
    return T.browse(t.part, "p_partkey", 50, 100)["rows"]


@query("lookup", "SELECT c_custkey, c_name FROM customer WHERE c_name = 'Customer#000000007'")
def lookup(t):
    return T.lookup(t.customer.select("c_custkey", "c_name"), "c_name", "Customer#000000007", "c_custkey")


@query("query_by_ids", f"""WITH {NOTICES} SELECT tender_id, project_name, content_summary FROM notices
  WHERE tender_id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND (contains(lower(content_summary), 'low') OR contains(lower(content_summary), 'furniture'))""")
def query_by_ids(t):
    ids = t.lineitem.filter(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("tender_id"))
    return L.query_tenders(t.notices, ids, ["LOW", "furniture"]).select("tender_id", "project_name", "content_summary")


@query("tender_with_structured", """SELECT o_orderkey AS tender_id, o_orderdate AS publish_date, c_name AS buyer, count(l_linenumber) AS packages
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL""")
def tender_with_structured(t):
    packages = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("packages"))
    buyers = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("buyer"))
    rows = t.orders.join(buyers, "o_custkey", "left").join(packages, "o_orderkey", "left")
    return rows.select(F.col("o_orderkey").alias("tender_id"), F.col("o_orderdate").alias("publish_date"), "buyer",
                       F.coalesce("packages", F.lit(0)).alias("packages"))


@query("stats_overview", """SELECT (SELECT count(*) FROM orders) AS total_tenders, (SELECT count(*) FROM orders) AS total_structured,
  (SELECT count(*) FROM lineitem) AS total_chunks, (SELECT round(avg(o_orderkey % 101), 2) FROM orders) AS avg_opportunity_score,
  (SELECT min(o_orderdate) FROM orders) AS min_date, (SELECT max(o_orderdate) FROM orders) AS max_date""")
def stats_overview(t):
    return S.stats_overview(t.orders.select(F.col("o_orderdate").alias("publish_date")),
                            t.orders.select((F.col("o_orderkey") % 101).alias("opportunity_score")), t.lineitem)


@query("stats_by_province", f"WITH {NOTICES} SELECT province, count(*) AS count FROM notices GROUP BY 1")
def stats_by_province(t):
    return S.stats_by(t.notices, "province")


@query("stats_by_type", "SELECT o_orderpriority AS announce_type, count(*) AS count FROM orders GROUP BY 1")
def stats_by_type(t):
    return S.stats_by(t.orders.select(F.col("o_orderpriority").alias("announce_type")), "announce_type")


@query("filter_options", "SELECT DISTINCT n_name FROM nation JOIN customer ON n_nationkey = c_nationkey")
def filter_options(t):
    return T.filter_options(t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")), "n_name")


@query("product_options", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, p_type AS description FROM part")
def product_options(t):
    return T.options(t.part, "p_partkey", name="p_name", description="p_type")


@query("top_keywords", "SELECT p_name, count(*) AS count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_keywords(t):
    return S.top_counts(t.part, "p_name", 10)


@query("table_stats", """SELECT coalesce(nullif(o_orderpriority, ''), '(无)') AS category, count(*) AS total,
  count(*) FILTER (o_orderstatus = 'O') AS new, count(*) FILTER (o_orderstatus <> 'O') AS processed FROM orders GROUP BY 1""")
def table_stats(t):
    status = F.when(F.col("o_orderstatus") == "O", "new").otherwise("processed")
    return S.table_stats(t.orders.select(F.col("o_orderpriority").alias("category"), status.alias("status")))


@query("usage_cost", """WITH u AS (SELECT role AS model, length(text) AS p, turn + 1 AS c FROM conversations),
  s AS (SELECT model, count(*) AS calls, CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(sum(c) AS BIGINT) AS completion_tokens FROM u GROUP BY 1),
  m AS (SELECT *, prompt_tokens + completion_tokens AS total_tokens,
    (prompt_tokens * CASE model WHEN 'user' THEN 0.5::DOUBLE ELSE 0.2::DOUBLE END + completion_tokens * CASE model WHEN 'user' THEN 5.0::DOUBLE ELSE 3.0::DOUBLE END) / 1e6 AS lo,
    (prompt_tokens * CASE model WHEN 'user' THEN 4.0::DOUBLE ELSE 2.0::DOUBLE END + completion_tokens * CASE model WHEN 'user' THEN 5.0::DOUBLE ELSE 3.0::DOUBLE END) / 1e6 AS hi FROM s)
  SELECT model, calls, prompt_tokens, completion_tokens, total_tokens, round((lo + hi) / 2, 4) AS cost, round(lo, 4) AS cost_min, round(hi, 4) AS cost_max FROM m""")
def usage_cost(t):
    usage = t.conversations.select(F.col("role").alias("model"), F.length("text").alias("prompt_tokens"),
                                   (F.col("turn") + 1).alias("completion_tokens"))
    return S.usage_cost(usage, {**rules.TOKEN_PRICE, "user": (0.5, 4.0, 5.0)})


@query("keyword_scoring", """WITH k AS (SELECT p_name AS keyword, count(*) AS result_count, CAST(count(DISTINCT p_brand) % 11 AS DOUBLE) AS semantic FROM part GROUP BY 1),
  s AS (SELECT *, CASE WHEN result_count >= 100 THEN 10 WHEN result_count >= 50 THEN 8 WHEN result_count >= 20 THEN 6 WHEN result_count >= 6 THEN 4 WHEN result_count >= 1 THEN 2 ELSE 0 END AS count_score FROM k),
  x AS (SELECT *, round(0.4::DOUBLE * semantic + 0.6::DOUBLE * count_score, 1) AS total_score FROM s)
  SELECT keyword, result_count, semantic, count_score, total_score, CASE WHEN total_score >= 6 THEN 'A' WHEN total_score >= 4 THEN 'B' ELSE 'C' END AS tier,
    rank() OVER (ORDER BY total_score DESC) AS rank FROM x""")
def keyword_scoring(t):
    counts = t.part.groupBy(F.col("p_name").alias("keyword")).agg(
        F.count("*").alias("result_count"), (F.countDistinct("p_brand") % 11).cast("double").alias("semantic"))
    return S.score_keywords(counts)


@query("winning_rollup", """SELECT l_orderkey AS tender_id, count(*) AS packages, count(DISTINCT s_name) AS bidders, count(DISTINCT l_partkey) AS products,
  round(sum(l_extendedprice), 2) AS winning_amount FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1""")
def winning_rollup(t):
    return S.winning_rollup(packages(t))


def packages(t):
    return t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_orderkey").alias("tender_id"), F.col("s_name").alias("winning_bidder"),
        F.col("l_partkey").cast("string").alias("winning_product"), F.col("l_extendedprice").alias("amount"))


PARTIES = """p AS (SELECT l_orderkey AS tender_id, 'winning_bidder' AS field, s_name AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  UNION SELECT l_orderkey, 'winning_product', CAST(l_partkey AS VARCHAR) FROM lineitem)"""


@query("winning_parties", f"WITH {PARTIES} SELECT * FROM p")
def winning_parties(t):
    return S.winning_parties(packages(t))


@query("winning_parties_nested", f"""WITH {PARTIES}, n AS (SELECT *, row_number() OVER (PARTITION BY tender_id, field ORDER BY value) - 1 AS i FROM p)
  SELECT tender_id, field, i // 3 AS part, string_agg(value, '|' ORDER BY i) AS vals FROM n GROUP BY ALL""")
def winning_parties_nested(t):
    return S.winning_parties_nested(packages(t), part_rows=3).select("tender_id", "field", "part", F.array_join("items", "|").alias("vals"))


def _structured(t):
    """Packages with flag R as the structured records of their order."""
    return t.lineitem.filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("tender_id")).agg(
        F.count("*").alias("packages"), F.round(F.sum("l_extendedprice"), 2).alias("amount"))


STRUCTURED = """s AS (SELECT l_orderkey AS tender_id, count(*) AS packages, round(sum(l_extendedprice), 2) AS amount FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)"""


@query("tender_detail", f"WITH {STRUCTURED} SELECT o_orderkey AS id, o_orderpriority, packages, amount FROM orders LEFT JOIN s ON o_orderkey = tender_id")
def tender_detail(t):
    tenders = t.orders.select(F.col("o_orderkey").alias("id"), "o_orderpriority")
    return T.with_structured(tenders, _structured(t), nested=True).select("id", "o_orderpriority", "structured.packages", "structured.amount")


@query("latest_structured", f"WITH {STRUCTURED} SELECT o_orderkey AS id, o_orderdate FROM orders WHERE o_orderkey IN (SELECT tender_id FROM s) ORDER BY o_orderdate DESC, id DESC LIMIT 30")
def latest_structured(t):
    return T.latest_structured(t.orders.select(F.col("o_orderkey").alias("id"), "o_orderdate"), _structured(t), 30, ["o_orderdate", "id"])


@query("link_structured", """SELECT 'u' || l_orderkey AS source_url, l_linenumber, l_partkey, o_orderkey AS tender_id,
  CASE WHEN o_orderkey IS NULL THEN sha256('u' || l_orderkey) ELSE o_orderpriority END AS uuid FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus <> 'P'""")
def link_structured(t):
    key = F.concat(F.lit("u"), F.col("o_orderkey").cast("string"))
    """Every open notice also has an older row with the same URL."""
    tenders = t.orders.filter(F.col("o_orderstatus") != "P").select(F.col("o_orderkey").alias("id"), key.alias("detail_url"), F.col("o_orderpriority").alias("uuid"), F.col("o_orderdate").alias("publish_date"))
    older = tenders.filter(F.col("id") % 2 == 0).withColumn("id", -F.col("id") - 1).withColumn("uuid", F.lit("older"))
    tenders = tenders.unionByName(older)
    rows = t.lineitem.select(F.concat(F.lit("u"), F.col("l_orderkey").cast("string")).alias("source_url"), "l_linenumber", "l_partkey")
    return T.link_structured(rows, tenders).select("source_url", "l_linenumber", "l_partkey", "tender_id", "uuid")


@query("chunks_of", """SELECT l_orderkey AS tender_id, l_returnflag AS chunk_type, l_linenumber AS chunk_order, l_partkey FROM lineitem
  WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def chunks_of(t):
    chunks = t.lineitem.select(F.col("l_orderkey").alias("tender_id"), F.col("l_returnflag").alias("chunk_type"), F.col("l_linenumber").alias("chunk_order"), "l_partkey")
    return T.chunks_of(chunks, t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("tender_id")))


@query("suggestion_requests", """SELECT o_orderkey, c_name AS customer_name, c_acctbal AS balance FROM orders JOIN customer ON o_custkey = c_custkey""")
def suggestion_requests(t):
    requests = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_name").alias("customer_name"))
    profiles = t.customer.select(F.col("c_name").alias("customer_name"), F.col("c_acctbal").alias("balance"))
    profiles = profiles.unionByName(profiles.withColumn("balance", F.col("balance") - 1))  # an older profile of each name
    return T.with_profile(requests, profiles, order=["balance"]).select("o_orderkey", "customer_name", "profile.balance")


@query("category_counts", """SELECT k AS category, count(*) AS count FROM (SELECT unnest([o_orderpriority, o_orderstatus]) AS k FROM orders) GROUP BY 1""")
def category_counts(t):
    return S.count_values(t.orders.select(F.array("o_orderpriority", "o_orderstatus").alias("category")), "category")


SITE = r"^(https?)://(?:www\.|m\.|blog\.)?([^/?#]*)"


@query("dedup_stats", f"""WITH u AS (SELECT {CANON} AS page FROM (SELECT CASE WHEN page_id % 9 = 0 THEN NULL ELSE url END AS url FROM pages UNION ALL SELECT url FROM pages WHERE page_id % 4 = 0)),
  g AS (SELECT page, count(*) AS n FROM u GROUP BY 1)
  SELECT CAST(sum(n) AS BIGINT) AS raw, count(page) AS "unique", CAST(coalesce(sum(n - 1) FILTER (page IS NOT NULL), 0) AS BIGINT) AS duplicate,
    CAST(coalesce(sum(n) FILTER (page IS NULL), 0) AS BIGINT) AS no_url FROM g""")
def dedup_stats(t):
    """Whole URLs; every ninth row has none, and every fourth page is listed again."""
    listed = t.pages.select(F.when(F.col("page_id") % 9 != 0, F.col("url")).alias("url"))
    return S.dedup_stats(listed.unionByName(t.pages.filter("page_id % 4 = 0").select("url")))
