"""Fusion of keyword and vector hits, roll-up of hits to projects, result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidweave import rules
from bidweave.functions.names import budget_display
from bidweave.functions.text import first_text, preview
from bidweave.operators.filters import post_filter
from bidweave.operators.keys import keep_last, one_per_key, top_k, top_k_staged
from bidweave.operators.search import BM25Index, bm25_best, bm25_scores, vector_search
from bidweave.session import cut

RRF_K = 60
WIDE, NARROW = 50, 5


def search_k(k: int, filtered: bool, by_project: bool) -> int:
    """Candidates per channel: wide when filters or the project roll-up will drop some."""
    return max(1, k) * (WIDE if filtered or by_project else NARROW)


def bm25_channel(index: BM25Index, queries: DataFrame, k: int, qid: str = "qid", text: str = "text",
                 mode: str = "words", accept: str | None = None) -> DataFrame:
    """(qid, doc_id, bm25_score, bm25_norm, bm25_rank): best k accepted documents, 0-based rank,
    score divided by the query's maximum over all documents. `accept` names a boolean column
    of the index."""
    scores = bm25_best(index, queries, qid, text, k, mode, accept)
    ok = F.coalesce(F.col(accept), F.lit(False)) if accept else F.lit(True)
    scores = scores.withColumn("_ok", ok)
    # one pass: the best rows of accepted and of rejected documents; the first of both is the maximum
    best = top_k_staged(scores, k, [F.col("score").desc(), F.col("doc_id")], ["qid", "_ok"], "doc_id", "_rank")
    top = best.groupBy("qid").agg(F.max("score").alias("_max"))
    hits = best.filter(F.col("_ok") & (F.col("score") > 0))
    return hits.join(top, "qid").select(
        "qid", "doc_id", F.col("score").alias("bm25_score"),
        (F.col("score") / F.when(F.col("_max") == 0, 1.0).otherwise(F.col("_max"))).alias("bm25_norm"),
        (F.col("_rank") - 1).alias("bm25_rank"))


def vector_channel(vectors: DataFrame, queries: DataFrame, k: int, dim: int, key: str = "id", qid: str = "qid",
                   vector: str = "embedding", accept: Column | None = None, late_filter: bool = False) -> DataFrame:
    """(qid, doc_id, vector_score, vector_rank), 0-based rank among the accepted documents.
    late_filter takes the top k first and filters then, which may leave fewer than k."""
    base = vectors if accept is None or late_filter else vectors.filter(accept)
    hits = vector_search(base, queries, dim, k, key, qid, vector)
    if accept is not None and late_filter:
        good = vectors.filter(accept).select(F.col(key).alias("doc_id"))
        hits = top_k(hits.drop("rank").join(good, "doc_id", "left_semi"), k,
                     [F.col("score").desc(), F.col("doc_id")], ["qid"], "rank")
    return hits.select("qid", "doc_id", F.col("score").alias("vector_score"), (F.col("rank") - 1).alias("vector_rank"))


def rrf(vector_hits: DataFrame | None, bm25_hits: DataFrame | None, vector_weight: float = 0.5,
        bm25_weight: float = 0.5) -> DataFrame:
    """Reciprocal rank fusion: sum of weight / (60 + rank + 1) over the channels that found the
    document; either channel may be off."""
    if vector_hits is None and bm25_hits is None:
        raise ValueError("at least one channel is needed")
    if vector_hits is None:
        both = bm25_hits.withColumns({"vector_score": F.lit(None).cast("double"), "vector_rank": F.lit(None).cast("long")})
    elif bm25_hits is None:
        both = vector_hits.withColumns({c: F.lit(None).cast(t) for c, t in (
            ("bm25_score", "double"), ("bm25_norm", "double"), ("bm25_rank", "long"))})
    else:
        both = vector_hits.join(bm25_hits, ["qid", "doc_id"], "full")

    def part(rank: str, weight: float) -> Column:
        return F.coalesce(F.lit(float(weight)) / (F.col(rank) + float(RRF_K + 1)), F.lit(0.0))

    zero = [F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("vector_score", "bm25_score", "bm25_norm")]
    return both.select("qid", "doc_id", (part("vector_rank", vector_weight) + part("bm25_rank", bm25_weight)).alias("rrf"), *zero)


def _rounded(prefix: Column | None = None) -> list[Column]:
    boost = prefix if prefix is not None else F.lit(1.0)
    return [F.round(F.col("rrf") * 1000 * boost, 4).alias("score"), F.round(F.col("rrf") * boost, 6).alias("rrf_raw_score"),
            F.round("vector_score", 4).alias("vector_score"), F.round("bm25_score", 2).alias("bm25_score"),
            F.round("bm25_norm", 4).alias("bm25_norm_score")]


def fused_hits(index: BM25Index | None, vectors: DataFrame | None, queries: DataFrame, k: int, dim: int = 0,
               vector_weight: float = 0.5, bm25_weight: float = 0.5, by_project: bool = False,
               accept: str | None = None, late_filter: bool = False, mode: str = "words") -> DataFrame:
    """All fused candidates. queries: qid, text and, for the vector channel, embedding.
    `accept` names a boolean column present in the index and in the vector table."""
    width = search_k(k, accept is not None, by_project)
    v = None if vectors is None else vector_channel(
        vectors, queries.filter(F.col("embedding").isNotNull()), width, dim,
        accept=F.col(accept) if accept else None, late_filter=late_filter)
    b = None if index is None else bm25_channel(index, queries, width, mode=mode, accept=accept)
    return rrf(v, b, vector_weight, bm25_weight)


def hybrid_search(index, vectors, queries: DataFrame, k: int = 10, dim: int = 0, **options) -> DataFrame:
    """Top k notices per query by fused score; ties by id."""
    hits = fused_hits(index, vectors, queries, k, dim, **options)
    best = top_k(hits, k, [F.col("rrf").desc(), F.col("doc_id")], ["qid"], "rank")
    return best.select("qid", "doc_id", "rank", *_rounded())


def linear_search(index: BM25Index | None, vectors: DataFrame | None, queries: DataFrame, k: int = 20, dim: int = 0,
                  vector_weight: float = 0.5, bm25_weight: float = 0.5, min_score: float = 0.0,
                  mode: str = "words") -> DataFrame:
    """Weighted sum of the vector score (top 2k, else 0) and the keyword score divided by the
    query's maximum; single channel when the other is absent. With min_score <= 0 documents
    without any evidence fill up a short result, lowest ids first."""
    v = None if vectors is None else vector_search(vectors, queries.filter(F.col("embedding").isNotNull()), dim, 2 * k).select(
        "qid", "doc_id", F.col("score").alias("vector_score"))
    if index is None:
        rows = v.withColumn("bm25_score", F.lit(None).cast("double")).withColumn("total", F.col("vector_score"))
    else:
        best_first = [F.col("score").desc(), F.col("doc_id")]
        if v is None:
            part = top_k(bm25_best(index, queries, "qid", "text", 3 * k, mode), 3 * k, best_first, ["qid"])
        else:
            scores = bm25_scores(index, queries, "qid", mode=mode).join(v.select("qid", "doc_id", F.lit(True).alias("_v")), ["qid", "doc_id"], "left")
            # a document outside the vector list is ranked by its keyword score alone, so its best 3k suffice
            part = top_k(scores, 3 * k, best_first, ["qid", "_v"])
        top = F.max("score").over(Window.partitionBy("qid"))
        part = part.filter(F.col("qid").isNotNull()).withColumn("_max", top).select(
            "qid", "doc_id", (F.col("score") / F.when(F.col("_max") > 0, F.col("_max")).otherwise(1.0)).alias("bm25_score"))
        rows = part if v is None else part.join(v, ["qid", "doc_id"], "full")
        if v is None:
            rows = rows.withColumn("vector_score", F.lit(None).cast("double")).withColumn("total", F.col("bm25_score"))
        else:
            rows = rows.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("vector_score", "bm25_score")})
            rows = rows.withColumn("total", vector_weight * F.col("vector_score") + bm25_weight * F.col("bm25_score"))
        if min_score <= 0:
            rows = _with_free(index, queries, rows, k)
    best = top_k(rows.filter(F.col("total") >= min_score), k, [F.col("total").desc(), F.col("doc_id")], ["qid"], "rank")
    return best.select("qid", "doc_id", "rank", F.round("total", 6).alias("score"), F.round("vector_score", 6).alias("vector_score"),
                       F.round("bm25_score", 6).alias("bm25_score"))


def _with_free(index: BM25Index, queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """The rows and, for queries with fewer than k above 0, score-0 rows of the lowest ids that are no candidate yet. A candidate list holds at most
    5k documents, so k free ids are always among the lowest 6k. Rows and queries meet once, by query."""
    names = [c for c in rows.columns if c != "qid"]
    found = rows.select("qid", F.struct(*names).alias("_row"))
    asked = queries.select("qid", F.lit(None).cast(found.schema["_row"].dataType).alias("_row"))
    groups = found.unionByName(asked).groupBy("qid").agg(F.collect_list("_row").alias("_rows"), F.count_if(F.col("_row").isNull()).alias("_asked"))
    lowest = index.docs.select("doc_id").orderBy("doc_id").limit(6 * k).agg(F.array_sort(F.collect_list("doc_id")).alias("_ids"))
    have = F.transform("_rows", lambda r: r["doc_id"])
    free = F.filter("_ids", lambda i: ~F.coalesce(F.array_contains(have, i), F.lit(False)))
    # a query that comes twice gets each of them twice
    each = F.flatten(F.transform(free, lambda i: F.array_repeat(i, F.least("_asked", F.lit(k)).cast("int"))))
    lacking = F.greatest(F.lit(k) - F.size(F.filter("_rows", lambda r: r["total"] > 0)), F.lit(0))
    zero = F.transform(F.slice(each, F.lit(1), lacking), lambda i: F.struct(*[(i if c == "doc_id" else F.lit(0.0)).alias(c) for c in names]))
    return groups.crossJoin(F.broadcast(lowest)).select("qid", F.inline(F.concat("_rows", zero)))


# --- projects --------------------------------------------------------------------------

def hits_to_projects(hits: DataFrame, notices: DataFrame, events: DataFrame) -> DataFrame:
    """Hits with the project of their notice: notices (doc_id, url) meet project events by URL.
    Where a URL occurs in several projects the last one (by key) stands."""
    # hits are few (queries x candidates): stored once, they thin out the events before the sort
    located = cut(hits.join(notices.select("doc_id", "url"), "doc_id"))
    wanted = events.select("url", "project_name_std", "buyer_name").join(located.select("url").distinct(), "url", "left_semi")
    return located.join(keep_last(wanted, "url", ["project_name_std", "buyer_name"]), ["url"])


def client_boost(avg: Column, weight: float) -> Column:
    """1 + (0.8 + avg/100 * 0.4 - 1) * weight; no or zero average leaves 1."""
    boost = F.lit(1.0) + (F.lit(0.8) + avg / 100.0 * 0.4 - 1.0) * F.lit(float(weight))
    return F.when(F.coalesce(avg, F.lit(0.0)) != 0, boost).otherwise(F.lit(1.0)) if weight > 0 else F.lit(1.0)


def rollup_hits(hits: DataFrame) -> DataFrame:
    """Mean scores and number of hits per query and project."""
    return hits.groupBy("qid", "project_name_std", "buyer_name").agg(
        F.avg("rrf").alias("rrf"), F.avg("vector_score").alias("vector_score"), F.avg("bm25_score").alias("bm25_score"),
        F.avg("bm25_norm").alias("bm25_norm"), F.count("*").alias("match_count"))


def project_search(hits: DataFrame, notices: DataFrame, events: DataFrame, projects: DataFrame, k: int = 10,
                   exclude_won: bool = False, client_value_weight: float = 0.0, sort_by: str = "score") -> DataFrame:
    """Top k projects per query. The client average comes from the buyer summary, else from the
    project's own opportunity score. sort_by 'date' re-orders those k by latest date."""
    key = ["project_name_std", "buyer_name"]
    rolled = rollup_hits(hits_to_projects(hits, notices, events))
    joined = rolled.join(projects, key)
    if exclude_won:
        joined = post_filter(joined, exclude_won=True)
    summary = F.col("buyer_profile_summary.avg_score") if "buyer_profile_summary" in projects.columns else F.lit(None)
    own = F.col("opportunity_score") if "opportunity_score" in projects.columns else F.lit(None)
    avg = F.coalesce(F.when(summary != 0, summary), own).cast("double")
    scored = joined.withColumn("_boost", client_boost(avg, client_value_weight))
    shown = _rounded(F.col("_boost"))
    names = ("score", "rrf_raw_score", "vector_score", "bm25_score", "bm25_norm_score")
    scored = scored.select("qid", *key, *[c for c in projects.columns if c not in key], "match_count", *shown,
                           F.round("_boost", 4).alias("client_boost"))
    best = top_k(scored, k, [F.col("score").desc(), *key], ["qid"], "rank")
    if sort_by == "date":
        best = top_k(best.drop("rank"), k, [F.col("latest_publish_date").desc_nulls_last(), F.col("score").desc(), *key],
                     ["qid"], "rank")
    return best.select("qid", "rank", *key, "match_count", *names, "client_boost",
                       *[c for c in projects.columns if c not in key])


def direct_search(found: DataFrame, k: int, min_budget: float | None = None, max_budget: float | None = None,
                  city: str | None = None) -> DataFrame:
    """Budget and city filters on 3k candidates, then the best k per query."""
    kept = post_filter(found, min_budget=min_budget, max_budget=max_budget, city=city)
    return top_k(kept.drop("rank"), k, [F.col("score").desc(), F.col("project_name_std"), F.col("buyer_name")], ["qid"], "rank")


def result_cards(found: DataFrame, min_score: float = 0.0) -> DataFrame:
    """Display rows of project results."""
    has = set(found.columns)

    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in has else F.lit("")

    return found.filter(F.col("score") >= min_score).select(
        "qid", "rank", F.concat(F.col("project_name_std"), F.lit("@"), F.col("buyer_name")).alias("tender_id"), "score",
        "vector_score", "bm25_score", "bm25_norm_score", "rrf_raw_score", "match_count",
        first_text("buyer_name", F.lit("未知单位")).alias("buyer_name_std"), F.col("project_name_std").alias("project_name"),
        F.coalesce("status", F.lit(rules.STATUS_OPEN)).alias("status"), text("province").alias("province"),
        text("city").alias("city"), F.col("total_budget").alias("budget_amount"), F.lit("元").alias("budget_unit"),
        budget_display("total_budget").alias("budget_display"),
        F.concat(F.lit("项目: "), text("project_name_std"), F.lit(" | 状态: "), text("status"), F.lit(" | 包含 "),
                 F.col("event_count").cast("string"), F.lit(" 条相关公告")).alias("document_preview"),
        F.coalesce(F.date_format("latest_publish_date", "yyyy-MM-dd"), F.lit("未知时间")).alias("publish_date"),
        preview(text("content_summary")).alias("summary"))


def notice_cards(found: DataFrame, notices: DataFrame, min_score: float = 0.0) -> DataFrame:
    """Display rows of single notices: hits with the fields of their notice."""
    def text(name: str, missing: str = "") -> Column:
        return F.coalesce(F.nullif(F.col(name).cast("string"), F.lit("")), F.lit(missing))

    rows = found.filter(F.col("score") >= min_score).join(notices, "doc_id")
    return rows.select(
        "qid", "rank", F.col("doc_id").cast("string").alias("tender_id"), "score", "vector_score", "bm25_score", "bm25_norm_score",
        "rrf_raw_score", text("buyer_name_std", "未知单位").alias("buyer_name_std"), "project_name",
        F.concat(F.lit("采购项目: "), text("project_name"), F.lit(" | 需求: "), text("application_scenario", "暂无")).alias("document_preview"),
        text("source_url", "#").alias("detail_url"), F.coalesce(F.date_format("publish_date", "yyyy-MM-dd"), F.lit("未知时间")).alias("publish_date"),
        text("province").alias("province"), text("city").alias("city"), "budget_amount", budget_display("budget_amount").alias("budget_display"),
        preview(text("content_summary")).alias("summary"))


def with_detail_url(hits: DataFrame, notices: DataFrame) -> DataFrame:
    """Hits with the page of their notice, the last by URL of a repeated notice."""
    side = one_per_key(notices.select("doc_id", F.col("url").alias("detail_url")), "doc_id", ["detail_url"])
    return hits.join(side, ["doc_id"], "left")


def serialise_hits(hits: DataFrame) -> DataFrame:
    """Ids as text and scores as doubles; missing scores stay null."""
    scores = [c for c in hits.columns if c.endswith("score")]
    return hits.select("qid", F.col("doc_id").cast("string").alias("id"), *[F.col(c).cast("double").alias(c) for c in scores])
