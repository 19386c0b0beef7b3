from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from bidweave.streaming import notices as N

SCHEMA = StructType([StructField(n, StringType()) for n in ("url", "project_name", "content")] + [StructField("seq", IntegerType())])
RULES = {"sat": {"keywords": ["卫星"], "exclude": ["柴油"]}}


def test_stream_upsert_equals_batch(spark, tmp_path):
    long = "采购需求说明" * 20
    days = [[("u1", "a", long + "卫星", 1), ("u2", "b", "短", 2)], [("u1", "", "", 3), ("u3", "c", long, 4)], [("u2", "b2", long + "卫星", 5)]]
    schema, place = "url string, project_name string, content string, status string, category string, match_reason string", str(tmp_path / "store")
    source = str(tmp_path / "in")
    run = N.upsert_store(place, "url", ["seq"], RULES, schema, buckets=4)
    for i, rows in enumerate(days):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(source)
        stream = N.notice_stream(spark, source, SCHEMA)
        stream.writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(run).start().awaitTermination()
    store = N.open_store(spark, place, "url", schema, 4)
    got = {r.url: (r.project_name, r.status, r.category) for r in store.read().collect()}
    assert got == {"u1": ("a", "matched", "sat"), "u2": ("b2", "matched", "sat"), "u3": ("c", "filtered", None)}
    version = store.manifest()["version"]
    run(spark.createDataFrame(days[-1], SCHEMA), 2)  # a repeated batch changes nothing
    assert store.manifest()["version"] == version
    # marks between the batches of the stream have versions of their own
    N.mark_processed(spark, place, "url", schema, 4)
    assert {r.url: r.status for r in store.read().collect()} == {"u1": "processed", "u2": "processed", "u3": "filtered"}
    spark.createDataFrame([("u3", "c2", long + "卫星", 6)], SCHEMA).coalesce(1).write.mode("append").json(source)
    stream = N.notice_stream(spark, source, SCHEMA)
    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(run).start().awaitTermination()
    N.mark_processed(spark, place, "url", schema, 4)
    assert {r.url: (r.project_name, r.status) for r in store.read().collect()} == {"u1": ("a", "processed"), "u2": ("b2", "processed"), "u3": ("c2", "processed")}


def test_project_state_takes_late_notices(spark, tmp_path):
    schema = StructType.fromDDL("project_name string, buyer_name_std string, source_url string, publish_date timestamp, budget_amount double, winning_amount double")
    source = str(tmp_path / "in")
    for rows in ([("P中标公告", "甲", "u3", datetime(2026, 1, 3), None, 9.0)], [("P招标公告", "甲", "u1", datetime(2026, 1, 1), 10.0, None)],
                 [("P更正公告", "甲", "u2", datetime(2026, 1, 2), 12.0, None), ("Q", "乙", "u4", datetime(2026, 1, 5), 0.0, None)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = N.notice_stream(spark, source, schema, "parquet", files_per_batch=1)
    N.run_to_parquet(N.project_state(stream), str(tmp_path / "out"), str(tmp_path / "cp"), "update")
    got = {r.project_name_std: (r.status, r.latest_publish_date, r.event_count, r.winning_amount, r.total_budget)
           for r in N.last_update(spark, str(tmp_path / "out"), ["project_name_std", "buyer_name"]).collect()}
    assert got == {"P": ("已中标", datetime(2026, 1, 3), 3, 9.0, 12.0), "Q": ("进行中", datetime(2026, 1, 5), 1, None, 0.0)}


def test_dedup_by_canonical_url(spark, tmp_path):
    schema = StructType.fromDDL("url string, ts timestamp")
    source = str(tmp_path / "in")
    spark.createDataFrame([("http://H/a/", datetime(2026, 1, 1)), ("http://h/a#x", datetime(2026, 1, 1)), ("http://h/b", datetime(2026, 1, 1))], schema).write.json(source)
    stream = N.dedup_stream(N.notice_stream(spark, source, schema), "ts", "1 day", url="url")
    N.run_to_parquet(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r.canonical for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["http://h/a", "http://h/b"]


@pytest.mark.parametrize("slide,want", [(None, 2), ("30 minutes", 4)])
def test_windows(spark, slide, want):
    df = spark.createDataFrame([("k", datetime(2026, 1, 1, 0, 10)), ("k", datetime(2026, 1, 1, 1, 20))], "c string, ts timestamp")
    got = N.windowed_counts(df, "ts", "c", "1 hour", slide)
    assert got.count() == want and got.agg(F.sum("n")).first()[0] == want


def test_blocked_keywords_of_a_stream(spark, tmp_path):
    """Rows sent before their keyword fell are left out by the reader; the result is that of the batch."""
    from bidweave.operators.pages import drop_blocked_keywords
    schema = StructType([StructField("keyword", StringType()), StructField("page", IntegerType()), StructField("error", StringType())])
    days = [[("a", 1, "x"), ("a", 2, None), ("b", 1, None), (None, 1, "x")], [("a", 3, "x"), ("b", 2, "x"), ("c", 1, "x"), ("c", 2, "x"), (None, 2, "x")],
            [("a", 4, "x"), ("a", 5, None), ("b", 3, None), (None, 3, "x")], [("a", 6, None), ("c", 3, None), ("c", 4, "x")]]
    place, source, blocked = str(tmp_path / "deny"), str(tmp_path / "in"), F.col("error").isNotNull()
    run, seen = N.drop_blocked_stream(place, blocked, most=3, buckets=2), []
    for i, rows in enumerate(days):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(source)
        stream = N.notice_stream(spark, source, schema)
        stream.writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(run).start().awaitTermination()
        run(spark.createDataFrame(rows, schema), i)  # the batch comes again
        seen += rows
        every = drop_blocked_keywords(spark.createDataFrame(seen, schema), blocked)
        got = N.allowed_rows(spark, place)
        assert sorted(map(str, got.select(*every.columns).collect())) == sorted(map(str, every.collect()))
    assert {r.keyword for r in got.collect()} == {"b", None}
    assert spark.read.parquet(f"{place}/sent/batch=3").filter("keyword = 'a'").count() == 0  # a fell before


def test_projects_leave_the_state(spark, tmp_path):
    from bidweave.streaming import projects as S
    schema = StructType([StructField(n, StringType()) for n in ("project_name", "buyer_name_std", "source_url", "publish_date")]
                        + [StructField(n, DoubleType()) for n in ("winning_amount", "budget_amount")])
    days = [[("A招标公告", "b", "u1", "2024-01-01", None, 5.0), ("A中标公告", "b", "u2", "2024-01-05", 4.0, None), ("B招标公告", "b", "u3", "2024-01-03", None, 7.0)],
            [("C招标公告", None, "u4", "2024-03-01", None, 1.0)],
            [("A更正公告", "b", "u5", "2024-03-02", None, 9.0), ("B中标公告", "b", "u6", "2024-02-29", 6.0, None), ("D招标公告", "b", "u7", "2023-12-01", None, 3.0)]]
    out, source, place = str(tmp_path / "out"), str(tmp_path / "in"), str(tmp_path / "cp")
    for rows in days:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(source)
        stream = S.project_episodes(N.notice_stream(spark, source, schema), "2 days", "10 days", "400 days")
        N.run_to_parquet(stream, out, place, "update")
    sent = spark.read.parquet(out)
    finished = [(r.project_name_std, r.events) for r in sent.filter("finished").collect()]
    assert finished == [("A", 2)]  # won, and event time has passed its delay; its notice of March opens a second episode
    assert sent.filter("project_name_std = 'A'").select("episode").distinct().count() == 2
    got = {(r.project_name_std, r.buyer_name): (r.status, str(r.latest_publish_date)[:10], r.event_count, r.winning_amount, r.total_budget) for r in S.combined(sent).collect()}
    kept = [r for day in days for r in day if r[2] != "u7"]  # older than the watermark: not taken
    batch = N.project_state(spark.createDataFrame(kept, schema).withColumn("publish_date", F.col("publish_date").cast("timestamp")))
    assert got == {(r.project_name_std, r.buyer_name): (r.status, str(r.latest_publish_date)[:10], r.event_count, r.winning_amount, r.total_budget) for r in batch.collect()}
    assert got["A", "b"] == ("已中标", "2024-03-02", 3, 4.0, 9.0) and ("D", "b") not in got


def test_projects_of_a_group_share_a_call(spark, tmp_path):
    """Hundreds of projects in one group: Python is called per group and batch, and the sum of the episodes is that of the batch."""
    from bidweave.streaming import projects as S
    schema = StructType([StructField(n, StringType()) for n in ("project_name", "buyer_name_std", "source_url", "publish_date")]
                        + [StructField(n, DoubleType()) for n in ("winning_amount", "budget_amount")])
    out, source, place, seen = str(tmp_path / "out"), str(tmp_path / "in"), str(tmp_path / "cp"), []
    for month in (1, 2, 3):
        rows = [(None if i == 7 else f"N{i}{'中标公告' if i % 3 == month % 3 else '招标公告'}", None if i % 5 else f"b{i % 4}", f"u{month}-{i}-{j}", f"2024-0{month}-{10 + j:02}",
                 float(i) if i % 3 == month % 3 else None, None if i % 2 else float(j)) for i in range(300) if i % 4 != month for j in range(3)]
        spark.createDataFrame(rows, schema).repartition(3).write.mode("append").json(source)
        N.run_to_parquet(S.project_episodes(N.notice_stream(spark, source, schema), "20 days", "10 days", "400 days", groups=1), out, place, "update")
        seen += rows
    sent = spark.read.parquet(out)
    assert sent.filter("finished AND NOT won").count() == 0 and sent.filter("finished").count() > 20
    fields = ("project_name_std", "buyer_name", "status", "event_count", "winning_amount", "total_budget")
    batch = N.project_state(spark.createDataFrame(seen, schema).withColumn("publish_date", F.col("publish_date").cast("timestamp")))
    assert sorted(map(str, S.combined(sent).select(*fields).collect())) == sorted(map(str, batch.select(*fields).collect()))
