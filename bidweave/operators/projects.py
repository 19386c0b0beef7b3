"""Project lifecycles: notices of one project and buyer become one project row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidweave import rules
from bidweave.functions.names import normalize_project_name
from bidweave.functions.text import number_truthy, text_truthy
from bidweave.operators.keys import collect_parts, keep_last, one_per_key, scan_groups

PROJECT_KEY = ["project_name_std", "buyer_name"]


def event_type(name: str = "project_name", url: str = "source_url", amount: str = "winning_amount") -> Column:
    """A winning amount decides first, then URL part or name word in rule order."""
    text, link = F.coalesce(F.col(name), F.lit("")), F.coalesce(F.col(url), F.lit(""))
    out = F.when(F.coalesce(F.col(amount) > 0, F.lit(False)), F.lit(rules.EVENT_WIN))
    for label, part, word in rules.EVENT_RULES:
        out = out.when(F.contains(link, F.lit(part)) | F.contains(text, F.lit(word)), F.lit(label))
    return out.otherwise(F.lit(rules.EVENT_UNKNOWN))


def with_publish_date(structured: DataFrame, details: DataFrame, url: str = "source_url") -> DataFrame:
    """Notices take the date of their detail page (the last one read) when there is one."""
    dated = details.filter(text_truthy("url") & F.col("publish_date").isNotNull())
    last = keep_last(dated, "url", ["crawl_time", "publish_date"]).select(
        F.col("url").alias(url), F.col("publish_date").alias("_date"))
    joined = structured.join(last, [url], "left")
    old = F.col("publish_date") if "publish_date" in structured.columns else F.lit(None)
    return joined.withColumn("publish_date", F.coalesce(F.col("_date"), old)).drop("_date")


def project_events(notices: DataFrame) -> DataFrame:
    """One event row per notice, keyed by project. This is the event list of a project as a
    table: it is never gathered into one row, so a project may have any number of notices."""
    return notices.select(
        normalize_project_name("project_name").alias("project_name_std"),
        F.coalesce(F.col("buyer_name_std"), F.lit("")).alias("buyer_name"),
        event_type().alias("type"), F.col("project_name").alias("title"), F.col("source_url").alias("url"),
        F.col("budget_amount").alias("budget"), "winning_amount", F.col("publish_date").alias("date"))


def events_nested(events: DataFrame, part_rows: int = 1000) -> DataFrame:
    """Event arrays per project in time order, in numbered parts of bounded size."""
    return collect_parts(events, PROJECT_KEY, ["date", "url"],
                         ["type", "title", "url", "budget", "winning_amount", "date"], part_rows, "events")


def aggregate_projects(notices: DataFrame, template: Sequence[str] = ()) -> DataFrame:
    """One row per (normalised name, buyer).

    Order within a project is data: (publish date, URL). The first notice lends the template
    fields; the state is won as soon as any notice is a winning one; winner and budget come
    from the last winning / last budgeted non-winning notice. All aggregates combine before
    the shuffle, so a project with very many notices costs no more than its neighbours.
    """
    seq = F.struct("publish_date", "source_url")
    rows = notices.select(
        normalize_project_name("project_name").alias("project_name_std"),
        F.coalesce(F.col("buyer_name_std"), F.lit("")).alias("buyer_name"),
        (event_type() == rules.EVENT_WIN).alias("_win"), seq.alias("_seq"),
        "publish_date", "source_url", "budget_amount", "winning_amount", "winning_bidder",
        "tender_id", "province", "city", *template)
    first = F.min_by(F.struct("tender_id", "province", "city", "publish_date", *template), "_seq")
    win = F.max_by(F.struct(F.col("winning_bidder").alias("bidder"), F.col("winning_amount").alias("amount"),
                            F.col("source_url").alias("url")), F.when(F.col("_win"), F.col("_seq")))
    budget = F.max_by("budget_amount", F.when(~F.col("_win") & number_truthy("budget_amount"), F.col("_seq")))
    grouped = rows.groupBy(*PROJECT_KEY).agg(
        first.alias("_first"), F.max("publish_date").alias("latest_publish_date"), F.max("_win").alias("_won"),
        win.alias("winning_info"), F.coalesce(budget, F.lit(0.0)).alias("total_budget"),
        F.count("*").alias("event_count"))
    return grouped.select(
        F.col("_first.tender_id").alias("project_id"), *PROJECT_KEY,
        F.col("_first.province").alias("province"), F.col("_first.city").alias("city"), "total_budget",
        F.when(F.col("_won"), F.lit(rules.STATUS_WON)).otherwise(F.lit(rules.STATUS_OPEN)).alias("status"),
        "event_count", "winning_info", F.col("_first.publish_date").alias("publish_date"), "latest_publish_date",
        *[F.col(f"_first.{c}").alias(c) for c in template])


def with_buyer_summary(projects: DataFrame, profiles: DataFrame) -> DataFrame:
    """Projects with count and average score of their buyer (null when the buyer is unknown). Of a repeated profile the
    one with the highest counts stands."""
    side = one_per_key(profiles.select("customer_name", "tender_count", "avg_opportunity_score"), "customer_name")
    side = side.select(F.col("customer_name").alias("buyer_name"), F.struct(
        "tender_count", F.col("avg_opportunity_score").alias("avg_score")).alias("buyer_profile_summary"))
    return projects.join(side, ["buyer_name"], "left")


def project_timeline(events: DataFrame) -> DataFrame:
    """Events with their position, the previous date and the state reached so far."""
    scanned = scan_groups(
        events, PROJECT_KEY, ["date", "url"], "position",
        running_max={"_won": F.col("type") == rules.EVENT_WIN}, previous={"previous_date": F.col("date")})
    status = F.when(F.col("_won"), F.lit(rules.STATUS_WON)).otherwise(F.lit(rules.STATUS_OPEN))
    return scanned.withColumn("status_so_far", status).drop("_won")
