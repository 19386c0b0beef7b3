"""Streams of notices: arrival, dedup, upsert, project state, counts, enrichment.

State is always bounded by a watermark or by the number of keys, and every sink is idempotent
per batch, so a lost executor or a restarted query repeats work without changing results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from bidweave import rules
from bidweave.functions.names import normalize_project_name
from bidweave.functions.text import number_truthy
from bidweave.functions.urls import canonical_url
from bidweave.operators.filters import filter_records
from bidweave.operators.keys import keep_last, one_per_key
from bidweave.operators.projects import event_type
from bidweave.operators.store import BucketStore
from bidweave.operators.tables import apply_verdict, mark, upsert_nonempty
from bidweave.session import cut


def notice_stream(spark: SparkSession, path: str, schema: StructType, fmt: str = "json", pattern: str | None = None,
                  files_per_batch: int | None = None) -> DataFrame:
    """New files of a folder as a stream."""
    reader = spark.readStream.schema(schema).format(fmt)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def _timed(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """Watermark for a stream (times without a zone are read in the session zone); batches pass."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay) if df.isStreaming else df


def dedup_stream(df: DataFrame, ts: str, delay: str, url: str | None = None, key: Sequence[str] = ()) -> DataFrame:
    """First arrival per key (canonical URL by default) within the delay."""
    if url:
        df, key = df.withColumn("canonical", canonical_url(url)), ["canonical"]
    return _timed(df, ts, delay).dropDuplicatesWithinWatermark(list(key))


def open_store(spark: SparkSession, path: str, key: str, schema: str | StructType, buckets: int = 64) -> BucketStore:
    return BucketStore(spark, path, schema, key, buckets)


def upsert_store(path: str, key: str, order: Sequence[str], category_rules: dict, schema: str | StructType, buckets: int = 64,
                 stream: str = "stream", **filter_options):
    """foreachBatch function: merge the batch (empty values keep the old ones), judge the new rows, store status
    matched or filtered. A batch reads and writes only the buckets that it touches; its number is the token of the merge, so a
    batch that the stream repeats changes nothing, and other writers (mark_processed) need no number of their own."""
    def change(target: DataFrame, batch: DataFrame) -> DataFrame:
        merged = upsert_nonempty(target, batch, key, order)
        verdicts = filter_records(merged.filter(F.col("status") == "new"), category_rules=category_rules, **filter_options).select(
            key, "keep", "reason", "categories")
        return apply_verdict(merged, verdicts, key).select(*target.columns)

    def run(batch: DataFrame, batch_id: int) -> None:
        open_store(batch.sparkSession, path, key, schema, buckets).merge(batch, change, (stream, batch_id))
    return run


def mark_processed(spark: SparkSession, path: str, key: str, schema: str | StructType, buckets: int = 64) -> None:
    """Matched rows have been handed on: a version that rewrites the buckets with such rows."""
    store = open_store(spark, path, key, schema, buckets)
    store.rewrite(F.col("status") == "matched", lambda rows: mark(rows, "processed", "matched"))


def project_state(df: DataFrame, ts: str = "publish_date") -> DataFrame:
    """Running state per (project, buyer): sticky won, latest date, last winner and budget, all
    by event time, so late notices land in the right place. Use update mode. The state is one
    small row per project."""
    rows = df.withColumn("project_name_std", normalize_project_name("project_name")).withColumn(
        "buyer_name", F.coalesce("buyer_name_std", F.lit(""))).withColumn("_win", event_type() == rules.EVENT_WIN)
    seq = F.struct(ts, "source_url")
    return rows.groupBy("project_name_std", "buyer_name").agg(
        F.when(F.max("_win"), F.lit(rules.STATUS_WON)).otherwise(F.lit(rules.STATUS_OPEN)).alias("status"),
        F.max(ts).alias("latest_publish_date"), F.count("*").alias("event_count"),
        F.max_by("winning_amount", F.when(F.col("_win"), seq)).alias("winning_amount"),
        F.coalesce(F.max_by("budget_amount", F.when(~F.col("_win") & number_truthy("budget_amount"), seq)), F.lit(0.0)
                   ).alias("total_budget"))


def windowed_counts(df: DataFrame, ts: str, category: str, size: str, slide: str | None = None, delay: str = "1 day") -> DataFrame:
    """Counts per category and time bucket (tumbling, or sliding when `slide` is given)."""
    span = F.window(ts, size, slide) if slide else F.window(ts, size)
    marked = _timed(df, ts, delay)
    return marked.groupBy(span.alias("w"), category).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), category, "n")


def enrich_stream(df: DataFrame, profiles: DataFrame, buyer: str = "buyer_name_std") -> DataFrame:
    """Notices with the profile of their buyer (stream-static left join), one row each also where a profile is repeated."""
    side = one_per_key(profiles.select(F.col("customer_name").alias(buyer), "tender_count", "avg_opportunity_score"), buyer)
    return df.join(side, buyer, "left")


def blocked_counts(df: DataFrame, blocked: Column, ts: str, keyword: str = "keyword", size: str = "1 hour",
                   delay: str = "10 minutes") -> DataFrame:
    """Blocked pages per keyword and window of a running crawl."""
    marked = _timed(df, ts, delay)
    return marked.groupBy(F.window(ts, size).alias("w"), keyword).agg(F.count_if(blocked).alias("blocked"),
                                                                    F.count("*").alias("attempts"))


DENY = "keyword string, blocked long"


def deny_store(spark: SparkSession, path: str, buckets: int = 16) -> BucketStore:
    """Blocked attempts per keyword since the stream began."""
    return BucketStore(spark, f"{path.rstrip('/')}/counts", DENY, "keyword", buckets)


def drop_blocked_stream(path: str, blocked: Column, keyword: str = "keyword", most: int = 3, buckets: int = 16, stream: str = "stream"):
    """foreachBatch function: the cumulative rule that drops a keyword with `most` blocked attempts, on the stream itself.

    Counts are kept per keyword without windows, for good; those of a batch are combined in each task, so a keyword that holds most
    attempts is cheap. They are merged under the number of the batch, so a repeated batch counts once. Then the rows of
    the batch whose keyword is still allowed are sent to `path`/sent. Rows that were sent before their keyword fell cannot be called back
    there: `allowed_rows` leaves them out, and its result is that of drop_blocked_keywords over all attempts so far.
    """
    def add(rows: DataFrame, batch: DataFrame) -> DataFrame:
        both = rows.unionByName(batch)
        return both.groupBy("keyword").agg(F.sum("blocked").alias("blocked"))

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = cut(batch)  # counted and sent; computed once
        store = deny_store(spark, path, buckets)
        counts = batch.groupBy(F.col(keyword).cast("string").alias("keyword")).agg(F.count_if(blocked).alias("blocked"))
        store.merge(counts.filter("keyword IS NOT NULL AND blocked > 0"), add, (stream, batch_id))
        denied = store.read().filter(F.col("blocked") >= most).select(F.col("keyword").alias("_denied"))
        sent = batch.join(denied, F.col(keyword).cast("string") == F.col("_denied"), "left_anti")
        sent.write.mode("overwrite").parquet(f"{path}/sent/batch={batch_id}")
    return run


def allowed_rows(spark: SparkSession, path: str, keyword: str = "keyword", most: int = 3, buckets: int = 16) -> DataFrame:
    """Rows sent so far whose keyword has not fallen since."""
    denied = deny_store(spark, path, buckets).read().filter(F.col("blocked") >= most).select(F.col("keyword").alias("_denied"))
    rows = spark.read.parquet(f"{path}/sent").drop("batch")
    return rows.join(denied, F.col(keyword).cast("string") == F.col("_denied"), "left_anti")


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there, then stop. In update mode every batch is written beside the others
    with its number; `last_update` reads the final row per key."""
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").option("path", path).start()
    else:
        def save(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        query = writer.outputMode("update").foreachBatch(save).start()
    query.awaitTermination()


def last_update(spark: SparkSession, path: str, key: Sequence[str]) -> DataFrame:
    """Final row per key of an update-mode result."""
    return keep_last(spark.read.parquet(path), list(key), ["batch"]).drop("batch")
