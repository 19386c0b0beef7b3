"""Keyed row selection and joins that stay even when one key holds a third of the rows.

- keep_first / keep_last / top_k rank with row_number and a bound, so Spark keeps at
  most k rows per key and task *before* the shuffle.
- salted_join splits hot keys with known counts over several tasks; other joins rely on
  the adaptive skew join, which splits a hot side by measured size.
- once adds columns that later filters and expressions do not compute again.
- scan_groups numbers rows and carries running values; a group too large for one task is
  spread over range partitions.
"""

from __future__ import annotations

from functools import reduce
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidweave.session import cut

BROADCAST_ROWS = 1_000_000
ROWS_PER_SALT = 5_000_000
SPLIT_ROWS = 2_000_000  # a group up to this size is sorted by one task


def _list(x) -> list:
    return list(x) if isinstance(x, (list, tuple)) else [x]


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once per row, however often later steps name them. They come as the one generated row of each row:
    a filter behind them is not pushed below the generator, so it does not repeat their expressions, as it does with withColumn."""
    others = [f"`{c}`" for c in df.columns if c not in columns] if set(columns) & set(df.columns) else ["*"]
    return df.select(*others, F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def top_k(df: DataFrame, k: int, by: Sequence[Column], group: Sequence[str], rank_col: str | None = None) -> DataFrame:
    """The first k rows of each group in the order `by`; rank_col keeps the 1-based rank."""
    name = rank_col or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*by))).filter(F.col(name) <= k)
    return out if rank_col else out.drop(name)


def top_k_staged(df: DataFrame, k: int, by: Sequence[Column], group: Sequence[str], spread: str, rank_col: str | None = None,
                 salts: int = 32) -> DataFrame:
    """top_k for few groups with very many rows: the best k of each part of a group (parts by the hash of
    `spread`), then the best k of those, so the last task of a group sorts k x salts rows."""
    parts = df.withColumn("_part", F.pmod(F.xxhash64(spread), F.lit(salts)))
    return top_k(top_k(parts, k, by, [*group, "_part"]).drop("_part"), k, by, group, rank_col)


def keep_first(df: DataFrame, key, order: Sequence[Column], null_keys: str = "drop") -> DataFrame:
    """One row per key, the first in `order`. Rows with a null key are dropped or all kept."""
    keys = _list(key)
    has_key = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    kept = top_k(df.filter(has_key), 1, order, keys)
    return kept.unionByName(df.filter(~has_key)) if null_keys == "keep" else kept


def keep_last(df: DataFrame, key, order: Sequence[str], null_keys: str = "drop") -> DataFrame:
    """One row per key, the last in the order of the named columns."""
    return keep_first(df, key, [F.col(c).desc_nulls_last() for c in order], null_keys)


def one_per_key(df: DataFrame, key, order: Sequence[str] = ()) -> DataFrame:
    """The row that a lookup by key meets: the last in `order`, or without one the largest by all
    other columns. Rows without a key cannot be met and are dropped."""
    others = [c for c in df.columns if c not in _list(key)]
    if not order and not others:
        return df.distinct()
    return keep_last(df, key, order or others)


def limit_unique(df: DataFrame, key, order: Sequence[str], n: int) -> DataFrame:
    """The first n distinct keys in the order of the named columns, one row each."""
    return keep_first(df, key, [F.col(c) for c in order]).orderBy(*order).limit(n)


def salted_join(left: DataFrame, right: DataFrame, on: Sequence[str], counts: DataFrame, how: str = "inner",
                rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Equi-join (inner or left) whose left side has hot keys that are already counted.

    counts(on..., count) holds the left rows per key. Keys above `rows_per_salt` rows get a
    salt computed from the row, and their right rows are repeated once per salt; other keys
    keep salt 0. There are at most rows / rows_per_salt hot keys, so their list is broadcast.
    Joins without such counts at hand are left to the adaptive skew join (see session.tune).
    """
    on = _list(on)
    hot = F.broadcast(counts.filter(F.col("count") > rows_per_salt)
                      .select(*on, F.ceil(F.col("count") / rows_per_salt).cast("int").alias("_salts")))
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    l2 = left.join(hot, on, "left").withColumn("_salt", F.pmod(F.xxhash64(*left.columns), salts).cast("int")).drop("_salts")
    r2 = right.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return l2.join(r2, [*on, "_salt"], how).drop("_salt")


def scan_groups(df: DataFrame, group: Sequence[str], order: Sequence[str], position: str = "position",
                running_max: dict[str, Column] | None = None, previous: dict[str, Column] | None = None,
                split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Row number, running maxima and previous values per group, for groups of any size.

    Groups up to `split_rows` rows go through a window; the few larger ones (at most rows / split_rows of them) are
    cut into range slices, see _scan_slices. Groups are counted only if there are more rows than that at all.
    `order` must identify a row within its group.
    """
    running_max, previous = running_max or {}, previous or {}
    group, order = list(group), list(order)
    inputs = {f"_in_{name}": expr for name, expr in {**running_max, **previous}.items()}
    rows = df.withColumns(inputs) if inputs else df
    if df.select(*group).limit(split_rows + 1).count() <= split_rows:
        return _scan_window(rows, group, order, position, list(running_max), list(previous)).drop(*inputs)
    large = cut(df.groupBy(*group).count().filter(F.col("count") > split_rows).select(
        *[F.col(c).alias(f"_g_{c}") for c in group]))
    if large.isEmpty():
        out = _scan_window(rows, group, order, position, list(running_max), list(previous))
    else:
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in group])
        small = rows.join(F.broadcast(large), same, "left_anti")
        hot = rows.join(F.broadcast(large), same, "left_semi")
        out = _scan_window(small, group, order, position, list(running_max), list(previous)).unionByName(
            _scan_slices(hot, group, order, position, list(running_max), list(previous)))
    return out.drop(*inputs)


def _scan_window(rows: DataFrame, group: list[str], order: list[str], position: str, maxima: list[str],
                 previous: list[str]) -> DataFrame:
    inside = Window.partitionBy(*group).orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({
        position: F.row_number().over(inside).cast("long"),
        **{c: F.max(f"_in_{c}").over(so_far) for c in maxima},
        **{c: F.lag(f"_in_{c}").over(inside) for c in previous}})


def _scan_slices(rows: DataFrame, group: list[str], order: list[str], position: str, maxima: list[str],
                 previous: list[str]) -> DataFrame:
    """Rows are range-partitioned by (group, order), so a group spans many partitions. Each
    slice of a group is summarised to one row; the summaries (groups x partitions at most)
    carry the values across slices, and a window inside each slice does the rest."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(rows.repartitionByRange(n, *group, *order).withColumn("_slice", F.spark_partition_id()))
    slices = rows.groupBy("_slice", *group).agg(
        F.count("*").alias("_n"),
        *[F.max(f"_in_{c}").alias(f"_top_{c}") for c in maxima],
        *[F.max_by(F.struct(f"_in_{c}"), F.struct(*order)).alias(f"_end_{c}") for c in previous])
    across = Window.partitionBy(*group).orderBy("_slice")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(
        "_slice", *group, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        *[F.max(f"_top_{c}").over(before).alias(f"_top_{c}") for c in maxima],
        *[F.lag(f"_end_{c}").over(across).alias(f"_end_{c}") for c in previous])

    same = reduce(lambda a, b: a & b, [rows[c].eqNullSafe(slices[c]) for c in ["_slice", *group]])
    joined = rows.join(slices, same, "inner").drop(*[slices[c] for c in ["_slice", *group]])
    inside = Window.partitionBy("_slice", *group).orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    out = joined.withColumns({
        position: (F.row_number().over(inside) + F.col("_offset")).cast("long"),
        **{c: F.greatest(F.max(f"_in_{c}").over(so_far), F.col(f"_top_{c}")) for c in maxima},
        **{c: F.coalesce(F.lag(F.struct(f"_in_{c}")).over(inside), F.col(f"_end_{c}"))[f"_in_{c}"] for c in previous}})
    return out.drop("_slice", "_offset", *[f"_top_{c}" for c in maxima], *[f"_end_{c}" for c in previous])


def collect_parts(df: DataFrame, group: Sequence[str], order: Sequence[str], fields: Sequence[str],
                  part_rows: int = 1000, items: str = "items", split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Nested form of child rows: arrays of at most `part_rows` items, numbered by `part`.

    A group with more items simply has more parts, so no array grows with the data and no
    item is lost.
    """
    numbered = scan_groups(df, group, order, "_position", split_rows=split_rows)
    part = F.floor((F.col("_position") - 1) / part_rows).cast("long")
    nested = (numbered.withColumn("part", part).groupBy(*group, "part")
              .agg(F.sort_array(F.collect_list(F.struct("_position", *fields))).alias("_items")))
    return nested.select(*group, "part", F.transform(
        "_items", lambda i: F.struct(*[i[f].alias(f) for f in fields])).alias(items))


def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of all frames by column name; missing columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_union(*frames: DataFrame) -> DataFrame:
    return union_all(*frames).distinct()


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of `left` that are not in `right` (null equals null)."""
    return left.subtract(right)


def intersection(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.intersect(right)
