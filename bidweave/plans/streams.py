"""Streaming forms, driven over the tables until they are used up."""

import uuid

from pyspark.sql import functions as F

from bidweave.plans.projects import LIFECYCLE
from bidweave.plans.registry import query
from bidweave.session import shared_dir
from bidweave.streaming import notices as N
from bidweave.streaming import projects as S


def _stream(t, name):
    return N.notice_stream(t.spark, t.folder, getattr(t, name).schema, "parquet", f"{name}.parquet")


def _place(t):
    root = f"{shared_dir(t.spark)}/streams/{uuid.uuid4().hex}"
    return f"{root}/out", f"{root}/checkpoint"


@query("windowed_counts", """SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, event_type, count(*) AS n
  FROM events GROUP BY ALL""")
def windowed_counts(t):
    return N.windowed_counts(t.events, "ts", "event_type", "1 day")


@query("windowed_counts_sliding", """WITH e AS (SELECT event_type, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s FROM events)
  SELECT s AS window_start, s + INTERVAL 2 HOUR AS window_end, event_type, count(*) AS n FROM e GROUP BY ALL""")
def windowed_counts_sliding(t):
    return N.windowed_counts(t.events, "ts", "event_type", "2 hours", "1 hour")


@query("blocked_counts", """SELECT date_trunc('day', ts) AS day, user_id, count(*) FILTER (event_type = 'error') AS blocked, count(*) AS attempts FROM events GROUP BY ALL""")
def blocked_counts(t):
    found = N.blocked_counts(t.events, F.col("event_type") == "error", "ts", "user_id", "1 day")
    return found.select(F.col("w.start").alias("day"), "user_id", "blocked", "attempts")


@query("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(t):
    """First event per user and type within a delay that covers the table."""
    out, checkpoint = _place(t)
    events = N.dedup_stream(_stream(t, "events"), "ts", "60 days", key=["user_id", "event_type"])
    N.run_to_parquet(events.select("user_id", "event_type"), out, checkpoint)
    return t.spark.read.parquet(out)


@query("stream_windowed_counts", """WITH m AS (SELECT max(ts) - INTERVAL 1 DAY AS w FROM events)
  SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events, m WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= w GROUP BY ALL""")
def stream_windowed_counts(t):
    """Windows that the watermark has closed."""
    out, checkpoint = _place(t)
    N.run_to_parquet(N.windowed_counts(_stream(t, "events"), "ts", "event_type", "1 day", delay="1 day"), out, checkpoint)
    return t.spark.read.parquet(out).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


STATES = LIFECYCLE + " SELECT project_name_std, buyer_name, status, latest_publish_date, event_count, win_amount AS winning_amount, total_budget FROM projects"


def _orders(t):
    """Orders as a stream of notices."""
    buyers = t.customer.select("c_custkey", "c_name")
    kind = F.when(F.col("o_orderstatus") == "F", "中标公告").when(F.col("o_orderstatus") == "O", "公开招标公告").otherwise("更正公告")
    return _stream(t, "orders").join(buyers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.concat(F.lit("P"), (F.col("o_orderkey") % 3).cast("string"), kind).alias("project_name"), F.col("c_name").alias("buyer_name_std"),
        F.concat(F.lit("http://notices.example.com/n/"), F.col("o_orderkey").cast("string")).alias("source_url"),
        F.col("o_orderdate").alias("publish_date"), F.col("o_totalprice").alias("budget_amount"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("winning_amount"))


@query("project_episodes", STATES)
def project_episodes(t):
    """The state machine with expiry: closed projects leave the state, and the rows sent still add up to the batch aggregation."""
    out, checkpoint = _place(t)
    N.run_to_parquet(S.project_episodes(_orders(t)), out, checkpoint, "update")
    found = S.combined(t.spark.read.parquet(out))
    return found.withColumn("latest_publish_date", F.col("latest_publish_date").cast(t.orders.schema["o_orderdate"].dataType))


@query("stream_blocked_keywords", """SELECT event_id, user_id FROM events WHERE user_id IN
  (SELECT user_id FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'error') < 14)""")
def stream_blocked_keywords(t):
    """Events arrive in three batches; users with 14 errors so far are dropped whole."""
    out, checkpoint = _place(t)
    third = -(-t.events.count() // 3)
    for k in range(3):
        t.events.filter(F.least(F.floor(F.col("event_id") / third), F.lit(2)) == k).select("event_id", "user_id", "event_type").write.parquet(f"{out}/in/{k}")
    run = N.drop_blocked_stream(f"{out}/deny", F.col("event_type") == "error", "user_id", 14)
    for k in range(3):
        stream = N.notice_stream(t.spark, f"{out}/in/[0-{k}]", t.spark.read.parquet(f"{out}/in/0").schema, "parquet")
        stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(run).start().awaitTermination()
    return N.allowed_rows(t.spark, f"{out}/deny", "user_id", 14).select("event_id", "user_id")


@query("project_state", STATES)
def project_state(t):
    """Orders arrive as a stream of notices; the final state equals the batch aggregation."""
    out, checkpoint = _place(t)
    N.run_to_parquet(N.project_state(_orders(t)), out, checkpoint, "update")
    return N.last_update(t.spark, out, ["project_name_std", "buyer_name"])


@query("stream_enrich", """SELECT o_orderkey, c_name AS buyer_name_std, n AS tender_count FROM orders JOIN customer ON o_custkey = c_custkey
  LEFT JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) ON k = o_custkey""")
def stream_enrich(t):
    out, checkpoint = _place(t)
    names = t.customer.select("c_custkey", F.col("c_name").alias("buyer_name_std"))
    rows = _stream(t, "orders").join(names, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "buyer_name_std")
    profiles = t.orders.groupBy("o_custkey").agg(F.count("*").alias("tender_count")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_name").alias("customer_name"), "tender_count", F.lit(0.0).alias("avg_opportunity_score"))
    N.run_to_parquet(N.enrich_stream(rows, profiles), out, checkpoint)
    return t.spark.read.parquet(out).select("o_orderkey", "buyer_name_std", "tender_count")
