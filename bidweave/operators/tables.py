"""Lookups, pages of rows, pending work, and merge-style table updates.

Updates are expressed as `(target, batch) -> new target`. They never write the path they
read; `replace_table` writes beside the old table and swaps names.
"""

from __future__ import annotations

from functools import reduce
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from bidweave.functions.names import row_key
from bidweave.functions.text import filled, text_truthy
from bidweave.functions.urls import canonical_url
from bidweave.operators.keys import keep_first, keep_last, once, one_per_key, union_all
from bidweave.operators.store import OLD, TIMES
from bidweave.session import cut

STATUS_NEW, STATUS_DONE, STATUS_MATCHED, STATUS_FILTERED = "new", "processed", "matched", "filtered"


# --- reading tables ---------------------------------------------------------------

def page(df: DataFrame, order: Sequence[Column], number: int = 1, size: int = 20) -> DataFrame:
    """One page of rows; the order must be total. Spark keeps only the first rows of each task."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def write_lookup(df: DataFrame, key: str, path: str, group_bytes: int = 4 * 1024 * 1024) -> None:
    """The rows sorted by key over range partitions, in small row groups with Bloom filters of the key: a request for one key opens the
    row group that can hold it, and none for a key that is not there."""
    ranged = df.repartitionByRange(key).sortWithinPartitions(key)
    (ranged.write.mode("overwrite").option("parquet.bloom.filter.enabled", "false").option(f"parquet.bloom.filter.enabled#{key}", "true")
     .option("parquet.block.size", str(group_bytes)).parquet(path))


def rows_of(spark: SparkSession, path: str, key: str, *values) -> DataFrame:
    """Rows of some keys from a lookup table; the keys are pushed into the scan."""
    return spark.read.parquet(path).filter(F.col(key).isin(*values))


CHUNK_ROWS = 100_000


def write_positions(df: DataFrame, order: Sequence[Column], path: str, chunk_rows: int = CHUNK_ROWS) -> None:
    """The rows with their `position` in the order, which must be total, in folders of `chunk_rows` neighbouring positions. Rows are
    range-partitioned and numbered by partition; only the counts of the partitions meet in one place."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(*order)
    numbered = rows.withColumn("_in", F.row_number().over(inside) - 1).join(starts, "_part").withColumn("position", F.col("_in") + F.col("_before"))
    numbered = numbered.drop("_part", "_in", "_before").withColumn("_chunk", F.floor(F.col("position") / chunk_rows))
    numbered.write.mode("overwrite").partitionBy("_chunk").parquet(path)


def page_at(spark: SparkSession, path: str, number: int, size: int = 20, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """A page of a table of positions: only the folders of its rows are read, whatever its number."""
    first = (number - 1) * size
    chunks = range(first // chunk_rows, (first + size - 1) // chunk_rows + 1)
    rows = spark.read.parquet(path).filter(F.col("_chunk").isin(*chunks) & F.col("position").between(first, first + size - 1))
    return rows.orderBy("position").drop("_chunk", "position")


def latest(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The n latest rows by the named columns, descending."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def browse(df: DataFrame, key: str, limit: int, offset: int = 0) -> dict:
    """Columns, one page of rows (ordered by key) and the total."""
    return {"columns": df.columns, "rows": df.orderBy(key).offset(offset).limit(limit), "total": df.count()}


def list_tables(spark: SparkSession) -> DataFrame:
    return spark.sql("SHOW TABLES").select(F.col("tableName").alias("name")).orderBy("name")


def lookup(df: DataFrame, key: str, value, fallback_key: str | None = None, order: Sequence[str] = ()) -> DataFrame:
    """The row whose key equals the value; with a fallback key, a match on it counts second."""
    hit = F.when(F.col(key) == value, 0)
    if fallback_key:
        # keys of different types are compared as text
        hit = hit.when(F.col(fallback_key).cast("string") == str(value), 1)
    ranked = df.withColumn("_hit", hit).filter(F.col("_hit").isNotNull())
    return ranked.orderBy("_hit", *order).limit(1).drop("_hit")


def chunks_of(chunks: DataFrame, ids: DataFrame, key: str = "tender_id") -> DataFrame:
    """Chunks of the given notices, by type and order."""
    return chunks.join(ids.select(key).distinct(), key, "left_semi").orderBy(key, "chunk_type", "chunk_order")


def options(df: DataFrame, *keys: str, name: str = "name", description: str | None = None) -> DataFrame:
    """(id, name, description) rows for a choice list; a missing name falls back to the id."""
    key = F.coalesce(*[F.col(k).cast("string") for k in keys])
    text = F.col(description) if description else F.lit(None).cast("string")
    return df.select(key.alias("id"), F.coalesce(F.nullif(F.col(name), F.lit("")), key).alias("name"),
                     text.alias("description"))


def filter_options(df: DataFrame, column: str) -> DataFrame:
    """Distinct filled values, sorted."""
    return df.filter(text_truthy(column)).select(column).distinct().orderBy(column)


# --- pending work -------------------------------------------------------------------

def with_canonical(df: DataFrame, url: str, name: str = "canonical") -> DataFrame:
    return once(df, **{name: canonical_url(url)})


def pending(listed: DataFrame, done: DataFrame, url: str, done_url: str | None = None,
            order: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """Listed rows (first per page) whose canonical URL has not been done yet."""
    todo = keep_first(with_canonical(listed, url), "canonical", [F.col(c) for c in order or [url]])
    seen = with_canonical(done, done_url or url).select("canonical")
    todo = todo.join(seen, "canonical", "left_anti")
    return todo.orderBy(*(order or [url])).limit(limit) if limit else todo


def new_rows(batch: DataFrame, existing: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Batch rows with a key that is neither repeated in the batch nor present already."""
    return keep_first(batch, key, [F.col(c) for c in order]).join(existing.select(key), key, "left_anti")


def is_failed(model: str = "llm_model", buyer: str = "buyer_name_std") -> Column:
    """A record that carries only its basic data."""
    return ~text_truthy(model) | ~text_truthy(buyer)


def without_failed(df: DataFrame, model: str = "llm_model", buyer: str = "buyer_name_std") -> DataFrame:
    """Rows worth keeping; the failed ones become pending again."""
    return df.filter(~is_failed(model, buyer))


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return child.join(parent.select(key), key, "left_anti")


def propagate_key(child: DataFrame, parent: DataFrame, on: str, key: str, order: Sequence[str] = ()) -> DataFrame:
    """Child rows take the key of their (last) parent when they have none."""
    up = one_per_key(parent.select(*dict.fromkeys([on, key, *order])), on, order).select(on, F.col(key).alias("_key"))
    return child.join(up, on, "left").withColumn(key, F.coalesce(F.col(key), F.col("_key"))).drop("_key")


def with_row_key(df: DataFrame, url: str, key: str = "uuid") -> DataFrame:
    """Fill a missing key with the hash of the canonical URL."""
    have = F.col(key) if key in df.columns else F.lit(None).cast("string")
    return df.withColumn(key, F.coalesce(F.nullif(have, F.lit("")), row_key(canonical_url(url))))


def link_structured(structured: DataFrame, tenders: DataFrame, url: str = "source_url", order: Sequence[str] = ("id",)) -> DataFrame:
    """Structured rows with id, key and date of their notice, the last one of a repeated URL;
    unmatched rows get their own key."""
    side = keep_last(tenders, "detail_url", order).select(F.col("detail_url").alias(url), F.col("id").alias("tender_id"), "uuid", "publish_date")
    return with_row_key(structured.join(side, url, "left"), url)


def with_structured(tenders: DataFrame, structured: DataFrame, key: str = "id", nested: bool = False) -> DataFrame:
    """Notices with their structured record, as columns or as one struct; notices without a
    record stay. structured carries the notice key as tender_id."""
    side = structured.withColumnRenamed("tender_id", key)
    fields = [c for c in side.columns if c != key]
    if nested:
        side = side.select(key, F.struct(*fields).alias("structured"))
    else:
        side = side.select(key, *[c for c in fields if c not in tenders.columns])
    return tenders.join(side, key, "left")


def latest_structured(tenders: DataFrame, structured: DataFrame, n: int, order: Sequence[str], key: str = "id") -> DataFrame:
    """The n newest notices that have a structured record."""
    have = tenders.join(structured.select(F.col("tender_id").alias(key)), key, "left_semi")
    return latest(have, n, *order)


def with_profile(requests: DataFrame, profiles: DataFrame, name: str = "customer_name", order: Sequence[str] = ()) -> DataFrame:
    """Requests with the (last) profile of the customer they name; null when there is none."""
    side = one_per_key(profiles, name, order).select(name, F.struct(*[c for c in profiles.columns if c != name]).alias("profile"))
    return requests.join(side, name, "left")


def split_cached(requests: DataFrame, cache: DataFrame, key: str, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(requests answered by the first cached row of their key, requests still to do)."""
    first = keep_first(cache, key, [F.col(c) for c in order])
    extra = [c for c in first.columns if c == key or c not in requests.columns]
    return requests.join(first.select(*extra), key, "inner"), requests.join(cache.select(key), key, "left_anti")


# --- merges -----------------------------------------------------------------------------

def _suffix(df: DataFrame, key: str, tag: str) -> DataFrame:
    return df.select(F.col(key), *[F.col(c).alias(f"{c}{tag}") for c in df.columns if c != key],
                     F.lit(True).alias(f"_has{tag}"))


def _paired(target: DataFrame, batch: DataFrame, key: str, how: str) -> DataFrame:
    return _suffix(target, key, "_old").join(_suffix(batch, key, "_new"), key, how)


def insert_absent(target: DataFrame, batch: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    return union_all(target, new_rows(batch, target, key, order))


def update_by_key(target: DataFrame, batch: DataFrame, key: str, columns: Sequence[str], order: Sequence[str],
                  set_values: dict[str, object] | None = None) -> DataFrame:
    """Matched rows take the named columns of the batch (its last row per key) and fixed
    values; rows that are only in the batch are not inserted."""
    side = keep_last(batch, key, order).select(key, *columns)
    both = _paired(target, side, key, "left")
    hit = F.col("_has_new").isNotNull()
    out = [F.col(key)]
    for c in target.columns:
        if c == key:
            continue
        old = F.col(f"{c}_old")
        if c in columns:
            old = F.when(hit, F.col(f"{c}_new")).otherwise(old)
        if set_values and c in set_values:
            old = F.when(hit, F.lit(set_values[c])).otherwise(old)
        out.append(old.alias(c))
    return both.select(*out).select(*target.columns)


def upsert_nonempty(target: DataFrame, batch: DataFrame, key: str, order: Sequence[str],
                    status: str | None = "status", counted: bool = False) -> DataFrame:
    """Insert or update: an empty new value (null, or '' in a text) keeps the old one; touched rows are new again.

    Several batch rows of one key are folded first: the last filled value of each column wins. With `counted` the rows
    also tell whether the key was there (_old) and how many batch rows it had (_times).
    """
    cols = [c for c in target.columns if c not in (key, status)]
    seq = F.struct(*order)
    folded = batch.filter(text_truthy(key)).groupBy(key).agg(
        F.count("*").alias(TIMES),
        *[F.max_by(F.col(c), F.when(filled(F.col(c), batch.schema[c].dataType), seq)).alias(c) for c in cols if c in batch.columns])
    both = _paired(target, folded, key, "full")
    touched = F.col("_has_new").isNotNull()
    out = [F.col(key)]
    for c in cols:
        old = F.col(f"{c}_old")
        out.append((F.coalesce(F.col(f"{c}_new"), old) if c in batch.columns else old).alias(c))
    if status:
        out.append(F.when(touched, F.lit(STATUS_NEW)).otherwise(F.col(f"{status}_old")).alias(status))
    if counted:
        marks = [F.col("_has_old").isNotNull().alias(OLD), F.coalesce(F.col(f"{TIMES}_new"), F.lit(0)).alias(TIMES)]
        return both.select(*out, *marks).select(*target.columns, OLD, TIMES)
    return both.select(*out).select(*target.columns)


def upsert(target: DataFrame, batch: DataFrame, key: str, order: Sequence[str], mode: str = "replace") -> DataFrame:
    """replace: batch rows (last per key) stand in for old ones; append: known keys are skipped."""
    if mode == "append":
        return insert_absent(target, batch, key, order)
    last = keep_last(batch, key, order)
    return union_all(target.join(last.select(key), key, "left_anti"), last).select(*target.columns)


def mark(df: DataFrame, to: str = STATUS_DONE, frm: str = STATUS_NEW, status: str = "status") -> DataFrame:
    return df.withColumn(status, F.when(F.col(status) == frm, F.lit(to)).otherwise(F.col(status)))


def apply_verdict(target: DataFrame, verdicts: DataFrame, key: str, order: Sequence[str] = ()) -> DataFrame:
    """Write keep / reason / categories of the filter (the last verdict of a key) into status,
    category and match_reason."""
    side = one_per_key(verdicts, key, order).select(key, F.col("keep").alias("_keep"), F.col("reason").alias("_reason"),
                           F.array_join("categories", ",").alias("_cats"))
    joined = target.join(side, key, "left")
    hit = F.col("_keep").isNotNull()
    reason = F.col("match_reason") if "match_reason" in target.columns else F.lit(None).cast("string")
    out = (joined
           .withColumn("status", F.when(F.col("_keep"), F.lit(STATUS_MATCHED)).when(hit, F.lit(STATUS_FILTERED))
                       .otherwise(F.col("status")))
           .withColumn("category", F.when(F.col("_keep"), F.col("_cats")).otherwise(F.col("category")))
           .withColumn("match_reason", F.when(hit, F.col("_reason")).otherwise(reason)))
    return out.drop("_keep", "_reason", "_cats")


def merge_counts(batch: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Inserted / updated / skipped row counts of an insert-or-update batch, and the new total.
    The first row of a new key inserts, later rows of it update; a row without key is skipped."""
    per_key = batch.groupBy(key).agg(F.count("*").alias("n"))
    known = target.select(key).distinct().withColumn("_old", F.lit(True))
    sides = per_key.join(known, key, "full")
    here, old, n = F.col("n").isNotNull() & text_truthy(key), F.col("_old").isNotNull(), F.coalesce(F.col("n"), F.lit(0))
    inserted = F.coalesce(F.sum(F.when(here & ~old, 1)), F.lit(0))
    return sides.agg(
        inserted.alias("inserted"),
        F.coalesce(F.sum(F.when(here & old, n).when(here, n - 1)), F.lit(0)).alias("updated"),
        F.coalesce(F.sum(F.when(~text_truthy(key), n)), F.lit(0)).alias("skipped"),
        (F.count(F.when(old, 1)) + inserted).alias("total"))


def evolve(df: DataFrame, schema: StructType) -> DataFrame:
    """The frame with every column of the schema, new ones as null; extra columns stay."""
    for field in schema.fields:
        if field.name not in df.columns:
            df = df.withColumn(field.name, F.lit(None).cast(field.dataType))
    return df


def replace_rows(target: DataFrame, batch: DataFrame, keys: Sequence[str], replace: bool = True) -> DataFrame:
    """Child rows by parent key: either the batch replaces all rows of its parents, or
    parents that already have rows are skipped."""
    keys = list(keys)
    if replace:
        return union_all(target.join(batch.select(*keys).distinct(), keys, "left_anti"), batch)
    return union_all(target, batch.join(target.select(*keys).distinct(), keys, "left_anti"))


def replace_table(df: DataFrame, table: str) -> None:
    """Write the new content beside the table, then swap names. If a run is lost between the
    two renames, `recover_table` completes the swap."""
    spark = df.sparkSession
    recover_table(spark, table)
    df.write.mode("overwrite").format("parquet").saveAsTable(f"{table}__next")
    if spark.catalog.tableExists(table):
        spark.sql(f"ALTER TABLE {table} RENAME TO {table}__old")
    spark.sql(f"ALTER TABLE {table}__next RENAME TO {table}")
    spark.sql(f"DROP TABLE IF EXISTS {table}__old")


def recover_table(spark: SparkSession, table: str) -> None:
    """Finish or undo an interrupted swap."""
    has = {n: spark.catalog.tableExists(n) for n in (table, f"{table}__next", f"{table}__old")}
    if has[f"{table}__old"] and not has[table]:
        spark.sql(f"ALTER TABLE {table}__old RENAME TO {table}")
    elif has[f"{table}__old"]:
        spark.sql(f"DROP TABLE {table}__old")
    if has[f"{table}__next"]:
        spark.sql(f"DROP TABLE {table}__next")


def compare_runs(left: DataFrame, right: DataFrame, key: str, fields: Sequence[str],
                 intersection_only: bool = False, cell: int | None = None) -> DataFrame:
    """Two extraction runs side by side, one row per key with left, right and a changed flag
    per field; keys of either run, or only of both. `cell` shortens long values for display."""
    side = _suffix(left.select(key, *fields), key, "_old").join(
        _suffix(right.select(key, *fields), key, "_new"), key, "inner" if intersection_only else "full")
    out: list[Column] = [F.col(key), F.col("_has_old").isNotNull().alias("in_left"),
                         F.col("_has_new").isNotNull().alias("in_right")]
    for f in fields:
        a, b = F.col(f"{f}_old"), F.col(f"{f}_new")
        changed = ~a.eqNullSafe(b)
        if cell:
            a, b = F.left(a.cast("string"), F.lit(cell)), F.left(b.cast("string"), F.lit(cell))
        out += [a.alias(f"{f}_left"), b.alias(f"{f}_right"), changed.alias(f"{f}_changed")]
    return side.select(*out)


def add_matches(conditions: Sequence[Column]) -> Column:
    """All given conditions; none means every row."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
