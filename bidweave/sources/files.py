"""JSON lines, JSON arrays, attachments and parsed texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from bidweave.functions.text import col

BAD = "_bad"
ENCODINGS = ("utf-8", "gbk", "gb2312", "gb18030")


def _missing(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def read_jsonl(spark: SparkSession, path: str, schema: StructType, on_bad: str = "keep") -> DataFrame:
    """JSON lines. An absent file is an empty table. Bad lines are kept in `_bad` or dropped."""
    try:
        if on_bad == "drop":
            return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
        wide = StructType([*schema.fields, StructField(BAD, StringType())])
        return spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).json(path)
    except AnalysisException as error:
        if not _missing(error):
            raise
        return spark.createDataFrame([], schema if on_bad == "drop" else wide)


def read_texts(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A Parquet table of long texts. When its files give fewer splits than there are cores (one
    big row group, say), rows are spread by key so that text work uses all cores; a table
    with enough splits is read as it is."""
    table, cores = spark.read.parquet(path), spark.sparkContext.defaultParallelism
    # a bare scan: asking for its partitions runs nothing
    return table.repartition(cores, key) if table.rdd.getNumPartitions() < cores else table


def read_json_any(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A .jsonl file by lines; any other file as a JSON array, or by lines when it is none."""
    if path.lower().endswith(".jsonl"):
        return read_jsonl(spark, path, schema, "drop")
    first = spark.read.text(path).filter(F.trim("value") != "").select(F.left(F.trim("value"), F.lit(1))).head()
    if first and first[0] == "[":
        return spark.read.schema(schema).option("multiLine", "true").json(path)
    return read_jsonl(spark, path, schema, "drop")


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def read_table_or(spark: SparkSession, table: str, fallback: DataFrame) -> DataFrame:
    """The table, or the fallback when it is absent or empty."""
    if spark.catalog.tableExists(table):
        found = spark.read.table(table)
        if not found.isEmpty():
            return found
    return fallback


def write_split(df: DataFrame, path: str, by: str = "status", mode: str = "overwrite") -> None:
    """One folder per status, so matched and filtered rows are read apart."""
    df.write.mode(mode).partitionBy(by).parquet(path)


def list_output_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Name, size and time of files; the contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"),
                        F.col("modificationTime").alias("modified"))


def scan_attachments(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """Attachments below `root/<tender_id>/<file>`: notice, name, path and size."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    out = [F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1).alias("tender_id"),
           F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("path").alias("local_path"),
           F.col("length").alias("file_size")]
    return files.select(*out, "content") if content else files.select(*out)


def file_kind(path: Column | str, content: Column | str) -> Column:
    """pdf by its magic bytes, otherwise the group of the extension."""
    ext = F.lower(F.regexp_extract(col(path), r"\.([^./]+)$", 1))
    return (F.when(F.substring(col(content), 1, 5) == F.lit(bytearray(b"%PDF-")), "pdf")
            .when(ext.isin("doc", "docx", "txt", "pdf"), ext).when(ext.isin("xls", "xlsx", "csv"), "sheet")
            .when(ext.isin("zip", "rar", "7z", "tar", "gz"), "archive").otherwise("other"))


def with_file_kind(df: DataFrame, path: str = "local_path", content: str = "content") -> DataFrame:
    return df.withColumn("file_kind", file_kind(path, content))


def _decode(data: bytes | None) -> str | None:
    if data is None:
        return None
    for name in ENCODINGS:
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", errors="ignore")


def decode_text(df: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, text) of binary rows: the first encoding that fits, else lossy UTF-8."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array([_decode(b) for b in rows.column(1).to_pylist()], pa.string())], names=["key", "text"])
    kind = df.schema[key].dataType.simpleString()
    return df.select(key, content).mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)


def load_parsed_text(spark: SparkSession, manifest: DataFrame, root: str) -> DataFrame:
    """Manifest rows (tender_id, file_name, parsed_path) with the text of their parsed file: the file at the same path
    below the root, else the file of that name in the folder of the notice. Equal names of two notices stay apart."""
    base = root.rstrip("/") + "/"
    below = lambda c: F.regexp_replace(F.substring_index(F.concat(F.lit("/"), c), base, -1), r"^/+", "")
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("_file"), F.col("value").alias("text"))
    path = F.try_url_decode(F.replace(F.col("_file"), F.lit("+"), F.lit("%2B")))
    texts = files.select(below(path).alias("_path"), "text")
    own = F.concat_ws("/", F.col("tender_id").cast("string"), F.element_at(F.split("parsed_path", "/"), -1))
    named = manifest.withColumns({"_path": below(F.col("parsed_path")), "_own": own})
    first = named.join(texts.withColumnRenamed("text", "_at_path"), "_path", "left").drop("_path")
    found = first.join(texts.select(F.col("_path").alias("_own"), "text"), "_own", "left").drop("_own")
    return found.withColumn("text", F.coalesce("_at_path", "text")).drop("_at_path").withColumnRenamed("parsed_path", "source_path")
