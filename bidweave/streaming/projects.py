"""The state of projects as a stateful operator with expiry.

Each (project, buyer) has one small entry in the state. A project that is won leaves the state when event time has passed its latest
notice by `closed_delay`, any other one by `idle_delay`; its last row is sent once more, marked as finished. So the state holds the
projects of the last while, not all there ever were.

Spark keeps the state by groups of projects (the hash of project and buyer), whose entries are columns of one value: a call of Python and a
timeout cost milliseconds, so they are made per group and batch, not per project. The notices of a group come in bounded parts.

Late notices: one that is older than the watermark is not taken (Spark drops it and counts it). One that comes in time, but for a
project that has left, opens a new episode of the project; `combined` adds up the episodes of a project, and its result is that of
the batch aggregation over all notices taken.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from bidweave import rules
from bidweave.functions.names import normalize_project_name
from bidweave.operators.keys import keep_last
from bidweave.operators.projects import PROJECT_KEY, event_type

# times are microseconds here: plain numbers pass the state and Arrow as they are, in any time zone
ENTRY = ("project_name_std string, buyer_name string, episode long, won boolean, latest long, events long, win_at long, win_url string, "
         "win_amount double, budget_at long, budget_url string, budget double")
TIMES = ("latest", "win_at", "budget_at")
STATE = ", ".join("{} array<{}>".format(*f.split(" ")) for f in ENTRY.split(", "))
COLUMNS = [*[f.split(" ")[0] for f in ENTRY.split(", ")], "finished"]
EPISODE, WON, LATEST, EVENTS, WIN_AT, WIN_URL, WIN_AMOUNT, BUDGET_AT, BUDGET_URL, BUDGET = range(2, 12)
GROUPS = 4096
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _fold(entry: list, at: int, url: str, win: bool, won_for: float, budget: float) -> None:
    """One notice into the entry of its project."""
    entry[EVENTS] += 1
    entry[LATEST] = at if entry[LATEST] is None else max(entry[LATEST], at)
    if win:
        entry[WON] = True
        if entry[WIN_AT] is None or (at, url) > (entry[WIN_AT], entry[WIN_URL]):
            entry[WIN_AT], entry[WIN_URL] = at, url
            entry[WIN_AMOUNT] = None if won_for != won_for else won_for
    elif budget == budget and budget != 0 and (entry[BUDGET_AT] is None or (at, url) > (entry[BUDGET_AT], entry[BUDGET_URL])):
        entry[BUDGET_AT], entry[BUDGET_URL], entry[BUDGET] = at, url, budget


def fold_group(closed_ms: int, idle_ms: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """Function that folds the notices of a group into the entries of its projects and lets those go whose time has come; see the module."""
    def rows(entries: list[list], finished: bool) -> pd.DataFrame:
        return pd.DataFrame([[*e, finished] for e in entries], columns=COLUMNS, dtype=object)

    def due(entry: list) -> int:
        return max(1, entry[LATEST] // 1000 + (closed_ms if entry[WON] else idle_ms))

    def fold(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs()
        held = {e[:2]: list(e) for e in zip(*state.get)} if state.exists else {}
        touched = {}
        for part in parts if not state.hasTimedOut else ():
            names = ("project_name_std", "buyer_name", "at", "source_url", "win", "winning_amount", "budget_amount")
            for project, buyer, at, url, win, won_for, budget in zip(*(part[c].tolist() for c in names)):
                entry = held.get((project, buyer))
                if entry is None:
                    # an episode is named by the watermark at its begin, which moves on before the next one can begin
                    entry = held[project, buyer] = [project, buyer, watermark, False, None, 0, *[None] * 6]
                touched[project, buyer] = entry
                _fold(entry, at, url or "", win, won_for, budget)
        if touched:
            yield rows(list(touched.values()), False)
        gone = [e for e in held.values() if due(e) < watermark]
        if gone:
            yield rows(gone, True)
        kept = [e for e in held.values() if due(e) >= watermark]
        if kept:
            state.update(tuple(list(c) for c in zip(*kept)))
            state.setTimeoutTimestamp(min(due(e) for e in kept))
        elif state.exists:
            state.remove()

    return fold


def project_episodes(df: DataFrame, delay: str = "1 day", closed_delay: str = "90 days", idle_delay: str = "730 days", groups: int = GROUPS) -> DataFrame:
    """Running rows of a stream of notices, one per touched project and batch. Use update mode. The number of groups stays as it is
    for the life of a checkpoint."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # keeps the state on disk, not in the heap
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c)
    rows = df.select(normalize_project_name("project_name").alias("project_name_std"), F.coalesce("buyer_name_std", F.lit("")).alias("buyer_name"),
                     F.col("publish_date").cast("timestamp").alias("publish_date"), "source_url", (event_type() == rules.EVENT_WIN).alias("win"),
                     number("winning_amount"), number("budget_amount"))
    rows = rows.filter("publish_date IS NOT NULL").withWatermark("publish_date", delay).withColumn("at", F.unix_micros("publish_date"))
    rows = rows.withColumn("_group", F.pmod(F.xxhash64(*PROJECT_KEY), F.lit(groups)))
    ms = lambda span: int(pd.Timedelta(span).total_seconds() * 1000)
    found = rows.groupBy("_group").applyInPandasWithState(
        fold_group(ms(closed_delay), ms(idle_delay)), f"{ENTRY}, finished boolean", STATE, "update", GroupStateTimeout.EventTimeTimeout)
    return found.select(*[F.timestamp_micros(c).alias(c) if c in TIMES else F.col(c) for c in COLUMNS])


def combined(rows: DataFrame, order: str = "batch") -> DataFrame:
    """The state of each project from all rows sent so far: the last row of each episode, then the episodes added up."""
    last = keep_last(rows.withColumn("_finished", F.col("finished").cast("int")), [*PROJECT_KEY, "episode"], [order, "_finished"])
    win, budget = F.struct("win_at", "win_url"), F.struct("budget_at", "budget_url")
    return last.groupBy(*PROJECT_KEY).agg(
        F.when(F.max("won"), F.lit(rules.STATUS_WON)).otherwise(F.lit(rules.STATUS_OPEN)).alias("status"),
        F.max("latest").alias("latest_publish_date"), F.sum("events").alias("event_count"),
        F.max_by("win_amount", F.when(F.col("win_at").isNotNull(), win)).alias("winning_amount"),
        F.coalesce(F.max_by("budget", F.when(F.col("budget_at").isNotNull(), budget)), F.lit(0.0)).alias("total_budget"))
