"""Balanced label propagation: linked documents move to one shard, sizes stay even (operator 1).

Documents start spread evenly over the shards. In a round, the members of a link are counted by shard;
the shards with most members are its targets (as many as its size needs at an even filling), and members elsewhere
move there. A document of several links follows the wish with most votes. Then every shard gets back to its quota, the
number of documents that it had: a shard that is too full passes on what is beyond its quota, and the free places of the others are
filled from that. What is passed on is chosen in an order that keeps the members of a link together and takes documents without links
first, so whole groups move, also where no document is unlinked. Rounds go on as long as the cut (members of links outside their
targets) falls; the state of the smallest cut stands.

Which documents are beyond the quota is decided by exact positions over hash bins, never by one task per shard: a link of very many
members is spread over bins of its own. DataFrame operations only. Quotas are a table of one row per shard.

Defined results of shard_documents (law `rows`: counts differ by one at most): a null text has size 1 and
the checksum of no bytes; null texts and empty texts are linked. Rows that repeat a doc_id, and rows with a
null doc_id, are documents like any other. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidweave.llm.common import bin_ranks, partitions, stored

SPLIT_MEMBERS = 100_000  # a link with more members is spread over bins


def _targets(placed: DataFrame, room: float) -> DataFrame:
    """(link, to, members): the shards that a link gathers in, best first, with their votes."""
    votes = placed.groupBy("link", "shard").agg(F.count("*").alias("votes"))
    # at most one entry per shard in the array of a link
    targets = votes.groupBy("link").agg(F.sum("votes").alias("members"), F.array_sort(F.collect_list(F.struct(
        (-F.col("votes")).alias("v"), F.xxhash64("link", "shard").alias("h"), F.col("shard").alias("s")))).alias("ranked"))
    wanted = F.greatest(F.lit(1), F.ceil(F.col("members") / F.lit(room))).cast("int")
    return targets.select("link", "members", F.slice(F.transform("ranked", lambda r: F.struct(r["s"].alias("s"), (-r["v"]).alias("v"))), 1, wanted).alias("to"))


def _wishes(placed: DataFrame, targets: DataFrame, step: int) -> DataFrame:
    """(node, wish): where each linked node wants to be."""
    seen = placed.join(targets, "link")
    here = F.get(F.filter("to", lambda t: t["s"] == F.col("shard")), F.lit(0))
    drawn = F.get("to", F.pmod(F.xxhash64("node", "link", F.lit(step)), F.size("to")).cast("int"))
    asked = seen.select("node", F.coalesce(here, drawn).alias("t"))
    return (asked.groupBy("node", F.col("t.s").alias("wish")).agg(F.sum("t.v").alias("votes"))
            .groupBy("node").agg(F.max_by("wish", F.struct("votes", -F.col("wish"))).alias("wish")))


def cut_size(targets: DataFrame) -> int:
    """Members of links outside the targets of their link."""
    held = F.aggregate("to", F.lit(0).cast("long"), lambda n, t: n + t["v"])
    return targets.agg(F.sum(F.col("members") - held)).first()[0] or 0


def _balanced(state: DataFrame, quotas: DataFrame, step: int) -> DataFrame:
    """state (node, shard, unit, large, ...) with the documents beyond the quota of a shard moved to shards with free places."""
    bins = 8 * partitions(state.sparkSession)
    part = lambda *c: F.pmod(F.xxhash64(*c, F.lit(step)), F.lit(bins)).cast("int")
    # units first, by their hash; a large unit is spread behind the small ones of its bin; documents without links come last
    rows = state.withColumn("__bin", F.when(F.col("unit").isNull(), bins + part("node")).otherwise(part("unit"))).withColumn(
        "__sub", F.when(F.col("unit").isNotNull() & F.col("large"), 1 + part("node", "unit")).otherwise(0))
    counts = rows.groupBy("shard", "__bin", "__sub").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__bin", "__sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "__bin", "__sub", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("shard", "__bin", "__sub").orderBy(F.xxhash64("unit", F.lit(step)), "unit", "node")
    placed = rows.withColumn("__in", F.row_number().over(inside) - 1).join(offsets, ["shard", "__bin", "__sub"])
    placed = placed.withColumn("__at", F.col("__in") + F.col("__before")).drop("__bin", "__sub", "__in", "__before")
    # one row per shard: places beyond the quota and free places, each with their number so far
    full = quotas.join(state.groupBy("shard").agg(F.count("*").alias("held")), "shard", "left").na.fill(0, ["held"])
    so_far = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    full = full.withColumns({"over": F.greatest(F.col("held") - F.col("quota"), F.lit(0)), "free": F.greatest(F.col("quota") - F.col("held"), F.lit(0))})
    full = stored(full.withColumns({"over_before": F.coalesce(F.sum("over").over(so_far), F.lit(0)), "free_before": F.coalesce(F.sum("free").over(so_far), F.lit(0))}), "full")
    out = F.broadcast(full.select("shard", "quota", "over_before"))
    spots = F.broadcast(full.filter("free > 0").select(F.col("shard").alias("__to"), F.col("free_before").alias("__low"), (F.col("free_before") + F.col("free")).alias("__high")))
    ranked = placed.join(out, "shard").withColumn("__leaver", F.when(F.col("__at") >= F.col("quota"), F.col("__at") - F.col("quota") + F.col("over_before")))
    moved = ranked.join(spots, (F.col("__leaver") >= F.col("__low")) & (F.col("__leaver") < F.col("__high")), "left")
    return moved.withColumn("shard", F.coalesce("__to", "shard")).select(*state.columns)


def propagate(state: DataFrame, links: DataFrame, shards: int, rounds: int = 8) -> DataFrame:
    """state (node unique, shard, ...) after at most `rounds` rounds; links (node, link). The number of nodes of each shard stays."""
    names, links = state.columns, stored(links, "links")
    room = max(1.0, state.count() / shards)
    # a node moves with the smallest of its links
    sizes = links.groupBy("link").agg((F.count("*") > min(room, SPLIT_MEMBERS)).alias("large"))
    units = links.groupBy("node").agg(F.min("link").alias("unit")).join(sizes.withColumnRenamed("link", "unit"), "unit")
    state = stored(state.join(units, "node", "left"), "state")
    quotas = stored(state.groupBy("shard").agg(F.count("*").alias("quota")), "quotas")  # one row per shard
    placed = links.join(state.select("node", "shard"), "node")
    targets = stored(_targets(placed, room), "targets")
    least = cut_size(targets)
    for step in range(rounds):
        if not least:
            break
        wishes = _wishes(placed, targets, step)
        wished = state.join(wishes, "node", "left").withColumn("shard", F.coalesce("wish", "shard")).drop("wish")
        tried = stored(_balanced(stored(wished, "wished"), quotas, step), "state")
        placed = links.join(tried.select("node", "shard"), "node")
        targets = stored(_targets(placed, room), "targets")
        cut = cut_size(targets)
        if cut >= least:
            break
        state, least = tried, cut
    return state.select(*names)


def shard_documents(docs: DataFrame, shards: int = 16, rounds: int = 8) -> DataFrame:
    """Per row: (doc_id, size, text_crc32, law, shard, slot, grown_shard); equal texts are linked."""
    text = F.coalesce("text", F.lit(""))
    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                              F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("sha"),
                              F.monotonically_increasing_id().alias("node")), "rows")
    same = (rows.groupBy("sha", "size").agg(F.count("*").alias("n"), F.min("node").alias("link")).filter("n > 1").select("sha", "size", "link"))
    links = rows.join(same, ["sha", "size"]).select("node", "link")
    start = bin_ranks(rows.select("node"), [], ["node"], "place").select("node", F.pmod("place", F.lit(shards)).cast("int").alias("shard"))
    state = propagate(start, links, shards, rounds)
    placed = rows.select("doc_id", "size", "text_crc32", "node").join(state, "node")
    return bin_ranks(placed, ["shard"], ["node"], "slot").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
