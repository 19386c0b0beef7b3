"""A table in buckets with versions: merges read and write only the buckets of their keys.

Rows are dealt to buckets by the hash of their key. A merge reads the buckets that its batch touches, writes their new content beside the
old one and then publishes a manifest: a small file that names, for every bucket, the folder that holds its rows now. Nothing is replaced
in place, so a run that is lost before its manifest leaves the old state, and a reader opens the files of the last manifest only, however
many versions there were. `compact` removes what no manifest names any more.

Merges of numbered batches carry a token (name of the stream, number): the manifest remembers the last number of each stream, and a batch
that comes again changes nothing. One writer at a time is assumed; two that publish the same version collide on its file, and the
second one fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from bidweave.functions.text import text_truthy
from bidweave.session import cut

BUCKET = "_bucket"
# what a merge may tell of its rows; see tables.upsert_nonempty
OLD, TIMES = "_old", "_times"

Change = Callable[[DataFrame, DataFrame], DataFrame]


class BucketStore:
    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._paths(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- manifests ---

    def _manifest_path(self, version: int):
        return self._paths(f"{self.path}/manifests/{version:012d}.json")

    def versions(self) -> list[int]:
        """Numbers of the manifests, newest first."""
        folder = self._paths(f"{self.path}/manifests")
        found = self._files.listStatus(folder) if self._files.exists(folder) else []
        names = [f.getPath().getName() for f in found]
        return sorted((int(n[:-5]) for n in names if n.endswith(".json")), reverse=True)

    def _load(self, version: int) -> dict | None:
        stream = self._files.open(self._manifest_path(version))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return json.loads(text)
        except ValueError:  # its writer was lost while it wrote
            return None

    def manifest(self) -> dict:
        """The newest whole manifest: folders of the buckets, tokens, number of rows."""
        for version in self.versions():
            found = self._load(version)
            if found is not None:
                return found
        return {"version": 0, "folders": {}, "tokens": {}, "rows": 0}

    def _publish(self, manifest: dict) -> None:
        out = self._files.create(self._manifest_path(manifest["version"]), False)  # refuses a version that exists
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()

    # --- reading ---

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def read(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """Current rows, of some buckets or of all; files of other buckets and versions are not opened."""
        folders = self.manifest()["folders"]
        wanted = folders if buckets is None else [str(b) for b in buckets if str(b) in folders]
        paths = [f"{self.path}/data/{folders[b]}/{BUCKET}={b}" for b in wanted]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    # --- writing ---

    def merge(self, batch: DataFrame, change: Change, token: tuple[str, int] | None = None) -> dict[str, int] | None:
        """Apply change(rows, batch) to the buckets that the batch touches. Returns counts of the merge, or None if the
        token was merged already. Counts are taken in the job that writes, behind its last shuffle, so tasks that run again count once.

        rows: after the merge; skipped: batch rows without a key; inserted, updated: if the change marks its rows with
        `_old` (the key was there) and `_times` (batch rows of the key)."""
        if token and self.manifest()["tokens"].get(token[0], -1) >= token[1]:
            return None
        batch = cut(batch)  # read twice; the batch of a stream must be computed once
        touched = batch.groupBy(self.bucket().alias(BUCKET)).agg(F.count_if(~text_truthy(F.col(self.key).cast("string"))).alias("bare")).collect()
        counts = self._write([r[BUCKET] for r in touched], lambda rows: change(rows, batch), token)
        return {**counts, "skipped": sum(r["bare"] for r in touched)}

    def rewrite(self, where: Column, change: Callable[[DataFrame], DataFrame]) -> dict[str, int]:
        """Apply change(rows) to the buckets that hold a row with `where`."""
        touched = self.read().filter(where).select(self.bucket().alias(BUCKET)).distinct().collect()
        return self._write([r[BUCKET] for r in touched], change, None)

    def _write(self, touched: list[int], change: Callable[[DataFrame], DataFrame], token: tuple[str, int] | None) -> dict[str, int]:
        old = self.manifest()
        version = max([0, *self.versions()]) + 1
        folder, seen = f"{version:012d}-{uuid.uuid4().hex[:8]}", Observation()
        tokens = {**old["tokens"], **({token[0]: token[1]} if token else {})}
        if not touched:
            self._publish({**old, "version": version, "tokens": tokens})
            return {"rows": old["rows"], "inserted": 0, "updated": 0}
        before = self.read(touched)
        out = change(before)
        marked = OLD in out.columns
        rows = out.withColumn(BUCKET, self.bucket()).repartition(BUCKET)
        here = F.col(TIMES) if marked else F.lit(None).cast("long")
        known = F.col(OLD) if marked else F.lit(None).cast("boolean")
        rows = rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if((here > 0) & ~known).alias("inserted"),
                            F.coalesce(F.sum(F.when(known, here).otherwise(here - 1)), F.lit(0)).alias("updated"))
        rows.select(*self.schema.names, BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/data/{folder}")
        found = seen.get
        written = {f.getPath().getName().split("=")[1] for f in self._files.listStatus(self._paths(f"{self.path}/data/{folder}"))
                   if f.getPath().getName().startswith(f"{BUCKET}=")}
        folders = {b: f for b, f in old["folders"].items() if int(b) not in touched} | {b: folder for b in written}
        # a marked merge removes nothing; else the old rows are counted from the footers of their files
        total = old["rows"] + (found.get("inserted", 0) if marked else found.get("rows", 0) - before.count())
        self._publish({"version": version, "folders": folders, "tokens": tokens, "rows": total})
        return {"rows": total, "inserted": found.get("inserted", 0), "updated": found.get("updated", 0)}

    def compact(self, keep: int = 1) -> None:
        """Keep the last `keep` manifests and what they name; remove the rest. Not while a reader uses an older version."""
        whole = [m for m in (self._load(v) for v in self.versions()) if m is not None]
        live = {(folder, b) for m in whole[:keep] for b, folder in m["folders"].items()}
        kept = {m["version"] for m in whole[:keep]}
        for version in self.versions():
            if version not in kept:
                self._files.delete(self._manifest_path(version), False)
        data = self._paths(f"{self.path}/data")
        for folder in self._files.listStatus(data) if self._files.exists(data) else []:
            name = folder.getPath().getName()
            if name not in {f for f, _ in live}:
                self._files.delete(folder.getPath(), True)
                continue
            for part in self._files.listStatus(folder.getPath()):
                bucket = part.getPath().getName().split("=")[-1]
                if part.isDirectory() and (name, bucket) not in live:
                    self._files.delete(part.getPath(), True)
