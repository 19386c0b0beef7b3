"""Counts and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidweave import rules
from bidweave.functions.jsonx import meta
from bidweave.functions.names import tier
from bidweave.functions.text import text_truthy
from bidweave.functions.urls import canonical_url
from bidweave.operators.keys import collect_parts
from bidweave.operators.tables import STATUS_NEW


def stats_overview(tenders: DataFrame, structured: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: three counts, mean score, first and last date. Each table is aggregated to one
    row first; the one-row results are joined on a constant."""
    one = F.lit(1).alias("_one")
    t = tenders.agg(F.count("*").alias("total_tenders"), F.min("publish_date").alias("min_date"),
                    F.max("publish_date").alias("max_date")).select(one, "*")
    s = structured.agg(F.count("*").alias("total_structured"),
                       F.round(F.avg("opportunity_score"), 2).alias("avg_opportunity_score")).select(one, "*")
    c = chunks.agg(F.count("*").alias("total_chunks")).select(one, "*")
    return t.join(s, "_one").join(c, "_one").select(
        "total_tenders", "total_structured", "total_chunks", "avg_opportunity_score", "min_date", "max_date")


def stats_by(df: DataFrame, column: str) -> DataFrame:
    """Rows per filled value, most frequent first."""
    return (df.filter(text_truthy(column)).groupBy(column).agg(F.count("*").alias("count"))
            .orderBy(F.col("count").desc(), column))


def top_counts(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k most frequent values; ties by value."""
    return df.groupBy(column).agg(F.count("*").alias("count")).orderBy(F.col("count").desc(), column).limit(k)


def count_values(df: DataFrame, column: str) -> DataFrame:
    """Rows per item of an array column."""
    return df.select(F.explode(column).alias(column)).groupBy(column).agg(F.count("*").alias("count"))


def table_stats(df: DataFrame, status: str = "status", category: str = "category") -> DataFrame:
    """Per category (missing = 无): rows, new rows and processed rows."""
    name = F.coalesce(F.nullif(F.col(category), F.lit("")), F.lit("(无)"))
    return df.groupBy(name.alias(category)).agg(
        F.count("*").alias("total"), F.count_if(F.col(status) == STATUS_NEW).alias("new"),
        F.count_if(F.col(status) != STATUS_NEW).alias("processed"))


def verdict_stats(df: DataFrame) -> DataFrame:
    """Rows per intent verdict, and how many of them matched a product."""
    return df.groupBy("intent_verdict").agg(
        F.count("*").alias("total"), F.count_if(F.size("matched_products") > 0).alias("matched"))


def match_stats(df: DataFrame, known: Sequence[str] = tuple(rules.PRODUCT_LINES)) -> DataFrame:
    """Matches per known product line, over product purchases only."""
    hits = df.filter(F.col("intent_verdict") == rules.VERDICT_PRODUCT)
    return count_values(hits, "matched_products").filter(F.col("matched_products").isin(*known))


def chunk_stats(chunks: DataFrame, k: int = 10, kind: str = "attachment_content") -> DataFrame:
    """The k notices with the most chunks of a kind, with their first source file."""
    return (chunks.filter(F.col("chunk_type") == kind).groupBy("tender_id")
            .agg(F.count("*").alias("chunks"), F.min(meta("metadata_json", "source_file")).alias("source_file"))
            .orderBy(F.col("chunks").desc(), "tender_id").limit(k))


def hit_rate(df: DataFrame, keep: str = "keep") -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.count_if(F.col(keep)).alias("kept"),
                  F.round(F.avg(F.col(keep).cast("int")) * 100, 1).alias("hit_rate"))


def usage_cost(usage: DataFrame, prices: dict[str, tuple[float, float, float]] = rules.TOKEN_PRICE,
               default: str = "standard") -> DataFrame:
    """Calls, tokens and the cost range per model. Prices are per million tokens:
    (cached input, fresh input, output); the estimate is the middle of the range."""
    out = usage.groupBy("model").agg(
        F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        (F.sum("prompt_tokens") + F.sum("completion_tokens")).alias("total_tokens"))

    def price(i: int):
        col = F.lit(prices[default][i])
        for model, p in prices.items():
            col = F.when(F.col("model") == model, F.lit(p[i])).otherwise(col)
        return col

    made = F.col("completion_tokens") * price(2)
    low = (F.col("prompt_tokens") * price(0) + made) / 1e6
    high = (F.col("prompt_tokens") * price(1) + made) / 1e6
    return out.select("*", F.round((low + high) / 2, 4).alias("cost"), F.round(low, 4).alias("cost_min"),
                      F.round(high, 4).alias("cost_max"))


def dedup_stats(df: DataFrame, url: str = "url") -> DataFrame:
    """Raw, unique, duplicate and URL-less row counts. Distinct pages are counted after a
    per-URL pre-aggregation, so no single task sees all URLs."""
    per_page = df.select(canonical_url(url).alias("page")).groupBy("page").agg(F.count("*").alias("n"))
    has = F.col("page").isNotNull()
    return per_page.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("raw"), F.count_if(has).alias("unique"),
        F.coalesce(F.sum(F.when(has, F.col("n") - 1)), F.lit(0)).alias("duplicate"),
        F.coalesce(F.sum(F.when(~has, F.col("n"))), F.lit(0)).alias("no_url"))


def score_keywords(counts: DataFrame, keyword: str = "keyword", n: str = "result_count",
                   semantic: str = "semantic") -> DataFrame:
    """Keyword score from result count and semantic closeness, tier, and rank (ties share one).

    The rank is 1 + the number of keywords with a higher score. It is taken over the distinct
    scores, of which there are few, so keywords are never sorted in one task.
    """
    points = tier(F.col(n), rules.COUNT_BUCKETS, 0)
    total = F.round(F.lit(rules.SEMANTIC_WEIGHT) * F.col(semantic) + F.lit(rules.COUNT_WEIGHT) * points, 1)
    scored = counts.withColumn("count_score", points).withColumn("total_score", total).withColumn(
        "tier", tier(F.col("total_score"), rules.KEYWORD_TIERS, rules.KEYWORD_TIER_REST))
    levels = scored.groupBy("total_score").agg(F.count("*").alias("_n"))
    above = Window.orderBy(F.col("total_score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranks = levels.select("total_score", (F.coalesce(F.sum("_n").over(above), F.lit(0)) + 1).alias("rank"))
    return scored.join(ranks, "total_score")


def winning_rollup(packages: DataFrame, key: str = "tender_id") -> DataFrame:
    """Multi-package notices: number of packages, winners and products, and the amount sum.
    The winners and products themselves are the distinct rows of `winning_parties`.

    Rows are folded to distinct (notice, field, value) first, in each task before the shuffle; what is left is counted per
    notice. So no task collects the values of a notice, and a row is sent twice at most, not three times as by two distinct counts."""
    field = lambda n, c, amount, one: F.struct(F.lit(n).alias("field"), F.col(c).cast("string").alias("value"), amount.alias("amount"), F.lit(one).alias("n"))
    rows = packages.select(key, F.inline(F.array(field(0, "winning_bidder", F.col("amount").cast("double"), 1),
                                                 field(1, "winning_product", F.lit(None).cast("double"), 0))))
    distinct = rows.groupBy(key, "field", "value").agg(F.sum("n").alias("n"), F.sum("amount").alias("amount"))
    known = F.col("value").isNotNull()
    return distinct.groupBy(key).agg(
        F.sum("n").alias("packages"), F.count_if(known & (F.col("field") == 0)).alias("bidders"),
        F.count_if(known & (F.col("field") == 1)).alias("products"), F.round(F.sum("amount"), 2).alias("winning_amount"))


def winning_parties(packages: DataFrame, key: str = "tender_id") -> DataFrame:
    """Distinct (notice, field, value) rows: all winning bidders and all winning products."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("winning_bidder", "winning_product")])
    return packages.select(key, F.inline(pairs)).filter(text_truthy("value")).distinct()


def winning_parties_nested(packages: DataFrame, key: str = "tender_id", part_rows: int = 1000) -> DataFrame:
    """The same values as sorted arrays, in numbered parts of bounded size."""
    parts = collect_parts(winning_parties(packages, key), [key, "field"], ["value"], ["value"], part_rows)
    return parts.withColumn("items", F.transform("items", lambda i: i["value"]))
