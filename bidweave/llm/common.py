"""Helpers shared by the operators: stored intermediate tables, exact ranks, components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from bidweave.session import shared_dir

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder on the shared storage; it is removed when the session's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(place)  # deleteOnExit ignores a path that is not there yet
    files.deleteOnExit(place)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read back: its lineage ends there, a lost executor
    costs nothing but a re-read, and joins know its size."""
    path = scratch(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(docs: DataFrame) -> Column:
    """All columns of a row as one, so that helper columns cannot clash with any of them; `select("__all.*")` unpacks."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__all")


def row_hash(docs: DataFrame) -> Column:
    """64-bit hash of a whole row. Columns that hold maps, which have no hash, count by their JSON text."""
    def holds_map(kind: DataType) -> bool:
        if isinstance(kind, ArrayType):
            return holds_map(kind.elementType)
        return isinstance(kind, MapType) or (isinstance(kind, StructType) and any(holds_map(f.dataType) for f in kind.fields))
    return F.xxhash64(*[F.to_json(F.struct(F.col(f"`{f.name}`"))) if holds_map(f.dataType) else F.col(f"`{f.name}`") for f in docs.schema.fields])


def let(value: Column, use) -> Column:
    """`use(value)` with `value` computed once per row, also inside higher-order functions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bin_ranks(df: DataFrame, keys: list[str], spread: list[str], position: str, bins: int | None = None, nulls: bool = True,
              attach: DataFrame | None = None) -> DataFrame:
    """Exact 0-based position of each row within its key, in the order of (hash of `spread`, `spread`).

    A key may hold most rows: rows are cut into hash bins, bins are counted (combined before the
    shuffle), and a window numbers the rows of one bin only. Keys compare null-safe; with `nulls` off they are
    known to be filled, and the offsets join without moving the rows again. `attach` (one row per key, columns named as
    the keys and others) brings its other columns along with the offsets. Rows that agree in `spread` change places freely.
    """
    bins = bins or 8 * partitions(df.sparkSession)
    rows = df.withColumn("__h", F.xxhash64(*spread)).withColumn("__bin", F.pmod("__h", F.lit(bins)).cast("int"))
    counts = rows.groupBy(*keys, "__bin").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.col("__bin").alias("__b"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    if attach is not None:
        offsets = offsets.join(attach, keys)
    offsets = offsets.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    inside = Window.partitionBy(*keys, "__bin").orderBy("__h", *spread)
    same = F.col("__bin") == F.col("__b")
    for k in keys:
        same = same & (F.col(k).eqNullSafe(F.col(f"__k_{k}")) if nulls else F.col(k) == F.col(f"__k_{k}"))
    ranked = rows.withColumn("__in", F.row_number().over(inside) - 1)
    return (ranked.join(offsets, same).withColumn(position, (F.col("__in") + F.col("__before")).cast("long"))
            .drop("__h", "__bin", "__in", "__b", "__before", *[f"__k_{k}" for k in keys]))


def sorted_positions(df: DataFrame, order: list[Column], position: str) -> DataFrame:
    """Exact 0-based position of each row in the order, which must be total.

    Rows are range-partitioned and each partition is numbered by itself; only the counts of the
    partitions are added up in one place.
    """
    n = partitions(df.sparkSession)
    rows = stored(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "sorted")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("__part").agg(F.count("*").alias("__n")).select(
        F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__part").orderBy(*order)
    return (rows.withColumn("__in", F.row_number().over(inside) - 1).join(starts, F.col("__part") == F.col("__p"))
            .withColumn(position, (F.col("__in") + F.col("__before")).cast("long")).drop("__part", "__p", "__in", "__before"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over the undirected edges (a, b).

    Every node points to a smaller one or itself. A round links the roots of the two ends of each
    edge that still crosses trees to the smaller root, then shortcuts all pointers; edges inside a
    tree drop out. Nothing is collected; each round is stored.
    """
    spark = edges.sparkSession
    left = stored(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    parent = left.select(F.col("a").alias("node")).union(left.select(F.col("b").alias("node"))).distinct().withColumn(
        "component", F.col("node"))
    for _ in range(rounds):
        if left.isEmpty():
            return parent
        hook = left.groupBy(F.col("b").alias("root")).agg(F.min("a").alias("to"))  # larger root -> smallest neighbour
        tree = stored(hook, "hooks")
        while True:  # follow hooks to their end
            step = tree.alias("x").join(tree.alias("y"), F.col("x.to") == F.col("y.root"), "left").select(
                F.col("x.root"), F.coalesce(F.col("y.to"), F.col("x.to")).alias("to"), F.col("y.to").isNotNull().alias("moved"))
            step = stored(step, "hooks")
            tree = step.drop("moved")
            if step.filter("moved").isEmpty():
                break
        parent = stored(parent.join(tree, F.col("component") == F.col("root"), "left").select(
            "node", F.coalesce("to", "component").alias("component")), "parents")
        ends = tree.select(F.col("root").alias("_r"), F.col("to").alias("_t"))
        moved = left.join(ends, F.col("a") == F.col("_r"), "left").select(F.coalesce("_t", "a").alias("a"), "b")
        moved = moved.join(ends, F.col("b") == F.col("_r"), "left").select("a", F.coalesce("_t", "b").alias("b"))
        left = stored(moved.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    raise RuntimeError("components did not settle")
