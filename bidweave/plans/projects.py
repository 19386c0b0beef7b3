"""Projects: lifecycle, events, timeline."""

from pyspark.sql import functions as F

from bidweave.operators import projects as P
from bidweave.operators.profiles import customer_profiles
from bidweave.operators.stats import stats_by
from bidweave.operators.tables import page
from bidweave.plans.registry import NOTICES, query

LIFECYCLE = f"""WITH {NOTICES}, seq AS (
  SELECT *, row_number() OVER (PARTITION BY project_name_std, buyer_name_std ORDER BY publish_date, source_url) AS rn FROM notices),
projects AS (
  SELECT project_name_std, buyer_name_std AS buyer_name, max(tender_id) FILTER (rn = 1) AS project_id,
    max(province) FILTER (rn = 1) AS province, max(city) FILTER (rn = 1) AS city,
    CASE WHEN bool_or(type = '中标') THEN '已中标' ELSE '进行中' END AS status,
    coalesce(arg_max(budget_amount, rn) FILTER (type <> '中标' AND budget_amount <> 0), 0.0) AS total_budget,
    arg_max(winning_bidder, rn) FILTER (type = '中标') AS win_bidder,
    arg_max(winning_amount, rn) FILTER (type = '中标') AS win_amount,
    arg_max(source_url, rn) FILTER (type = '中标') AS win_url,
    min(publish_date) AS publish_date, max(publish_date) AS latest_publish_date, count(*) AS event_count,
    max(opportunity_score) FILTER (rn = 1) AS opportunity_score
  FROM seq GROUP BY 1, 2)"""


def projects(t):
    return P.aggregate_projects(t.notices, ["opportunity_score", "content_summary"])


@query("project_lifecycle", LIFECYCLE + " SELECT * FROM projects")
def project_lifecycle(t):
    return projects(t).select(
        "project_name_std", "buyer_name", "project_id", "province", "city", "status", "total_budget",
        F.col("winning_info.bidder").alias("win_bidder"), F.col("winning_info.amount").alias("win_amount"),
        F.col("winning_info.url").alias("win_url"), "publish_date", "latest_publish_date", "event_count", "opportunity_score")


@query("project_page", LIFECYCLE + """ SELECT project_name_std, buyer_name, status, latest_publish_date FROM projects
  ORDER BY latest_publish_date DESC, buyer_name, project_name_std LIMIT 20 OFFSET 20""")
def project_page(t):
    order = [F.col("latest_publish_date").desc(), F.col("buyer_name"), F.col("project_name_std")]
    return page(projects(t).select("project_name_std", "buyer_name", "status", "latest_publish_date"), order, 2, 20)


@query("event_type_counts", f"WITH {NOTICES} SELECT type, count(*) AS count FROM notices GROUP BY 1")
def event_type_counts(t):
    return stats_by(P.project_events(t.notices), "type")


@query("project_events", f"""WITH {NOTICES} SELECT project_name_std, buyer_name_std AS buyer_name, type, project_name AS title,
  source_url AS url, budget_amount AS budget, winning_amount, publish_date AS date FROM notices""")
def project_events(t):
    return P.project_events(t.notices)


@query("timeline", f"""WITH {NOTICES} SELECT project_name_std, buyer_name_std AS buyer_name, source_url AS url, type, publish_date AS date,
  row_number() OVER w AS position, lag(publish_date) OVER w AS previous_date,
  CASE WHEN bool_or(type = '中标') OVER w THEN '已中标' ELSE '进行中' END AS status_so_far
  FROM notices WINDOW w AS (PARTITION BY project_name_std, buyer_name_std ORDER BY publish_date, source_url)""")
def timeline(t):
    return P.project_timeline(P.project_events(t.notices)).select(
        "project_name_std", "buyer_name", "url", "type", "date", "position", "previous_date", "status_so_far")


@query("events_nested", f"""WITH {NOTICES}, seq AS (
  SELECT project_name_std, buyer_name_std AS buyer_name, source_url AS url,
    row_number() OVER (PARTITION BY project_name_std, buyer_name_std ORDER BY publish_date, source_url) - 1 AS p FROM notices)
  SELECT project_name_std, buyer_name, p // 3 AS part, count(*) AS events, string_agg(url, ' ' ORDER BY p) AS urls
  FROM seq GROUP BY ALL""")
def events_nested(t):
    parts = P.events_nested(P.project_events(t.notices), part_rows=3)
    return parts.select("project_name_std", "buyer_name", "part", F.size("events").cast("long").alias("events"),
                        F.array_join(F.transform("events", lambda e: e["url"]), " ").alias("urls"))


@query("project_buyer_summary", LIFECYCLE + """, prof AS (
  SELECT buyer_name_std, count(*) AS n, round(avg(opportunity_score) FILTER (opportunity_score <> 0), 2) AS s FROM notices GROUP BY 1)
  SELECT project_name_std, buyer_name, status, n AS tender_count, coalesce(s, 0.0) AS avg_score
  FROM projects LEFT JOIN prof ON buyer_name = buyer_name_std""")
def project_buyer_summary(t):
    found = P.with_buyer_summary(projects(t), customer_profiles(t.notices))
    return found.select("project_name_std", "buyer_name", "status", "buyer_profile_summary.tender_count",
                        "buyer_profile_summary.avg_score")


@query("with_publish_date", """WITH late AS (
  SELECT l_orderkey, arg_max(l_shipdate, (l_shipdate, l_linenumber)) AS d FROM lineitem GROUP BY 1)
  SELECT o_orderkey AS tender_id, coalesce(d, o_orderdate) AS publish_date FROM orders LEFT JOIN late ON o_orderkey = l_orderkey""")
def with_publish_date(t):
    details = t.lineitem.select(F.col("l_orderkey").cast("string").alias("url"), F.col("l_shipdate").alias("publish_date"),
                                F.col("l_shipdate").alias("crawl_time"))
    rows = t.orders.select(F.col("o_orderkey").alias("tender_id"), F.col("o_orderdate").alias("publish_date"),
                           F.col("o_orderkey").cast("string").alias("source_url"))
    return P.with_publish_date(rows, details).select("tender_id", "publish_date")
