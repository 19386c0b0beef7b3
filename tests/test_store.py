"""The table in buckets: merges touch only their buckets, lost runs leave the old state, compaction keeps what is live."""

import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from bidweave.operators import tables as T
from bidweave.operators.store import BucketStore

SCHEMA = "key string, name string, price double, status string"


def files(path):
    return {str(p): hashlib.sha256(p.read_bytes()).hexdigest() for p in Path(path).rglob("*.parquet")}


def content(store):
    return sorted(map(tuple, store.read().collect()), key=str)


@pytest.fixture
def store(spark, tmp_path):
    found = BucketStore(spark, str(tmp_path / "s"), SCHEMA, "key", 8)
    found.merge(spark.createDataFrame([(f"k{i}", f"n{i}", float(i), "old") for i in range(200)], SCHEMA), lambda rows, batch: batch)
    return found


@pytest.mark.parametrize("change", [
    lambda rows, batch: T.upsert_nonempty(rows, batch, "key", ["seq"]),
    lambda rows, batch: T.update_by_key(rows, batch, "key", ["name"], ["seq"], {"status": "processed"}),
    lambda rows, batch: T.upsert(rows, batch.withColumn("status", F.lit("new")), "key", ["seq"]),
    lambda rows, batch: T.replace_rows(rows, batch.withColumn("status", F.lit("new")).drop("seq"), ["key"])])
def test_merges_open_and_write_only_touched_buckets(spark, store, change):
    whole = store.read()
    batch = spark.createDataFrame([("k7", "x", None, 1), ("k7", "", 5.0, 2)], "key string, name string, price double, seq int")
    want = sorted(map(tuple, change(whole, batch).select(*whole.columns).collect()), key=str)
    before, folders = files(store.path), store.manifest()["folders"]
    opened = []

    def watched(rows, new):
        opened.extend(rows.inputFiles())
        return change(rows, new)
    store.merge(batch, watched)
    assert content(store) == want
    after = files(store.path)
    assert all(after[p] == h for p, h in before.items())  # other files are the same bytes
    changed = {b for b, f in store.manifest()["folders"].items() if folders.get(b) != f}
    assert len(changed) == 1 and len(after) - len(before) == 1
    assert len(opened) == 1 and f"_bucket={changed.pop()}/" in opened[0]


def test_counts_of_the_write(spark, store):
    batch = spark.createDataFrame([("k7", "x", None, 1), ("k7", "y", 5.0, 2), ("new", "z", 1.0, 3), ("new", "z", 1.0, 4), ("", "bare", 1.0, 5), (None, "bare", 1.0, 6)],
                                  "key string, name string, price double, seq int")
    plain = T.merge_counts(batch, store.read(), "key").first().asDict()
    found = store.merge(batch, lambda rows, new: T.upsert_nonempty(rows, new, "key", ["seq"], counted=True))
    assert found == {"inserted": plain["inserted"], "updated": plain["updated"], "skipped": plain["skipped"], "rows": plain["total"]}
    assert store.manifest()["rows"] == store.read().count() == 201
    store.rewrite(F.col("key") == "k7", lambda rows: rows.filter("key <> 'k7'"))
    assert store.manifest()["rows"] == store.read().count() == 200


def test_many_versions_open_the_live_files_only(spark, store):
    for i in range(12):
        row = spark.createDataFrame([(f"k{i % 3}", f"v{i}", None, i)], "key string, name string, price double, seq int")
        assert store.merge(row, lambda rows, new: T.upsert_nonempty(rows, new, "key", ["seq"]), ("s", i)) is not None
        assert store.merge(row, lambda rows, new: rows, ("s", i)) is None  # a batch that comes again
        if i % 4 == 1:
            store.rewrite(F.col("status") == "new", lambda rows: T.mark(rows, "processed"))
    assert len(store.versions()) == 16 and len(store.read().inputFiles()) == 8 < len(files(store.path))
    want = content(store)
    store.compact()
    assert content(store) == want and len(files(store.path)) == 8 and len(store.versions()) == 1
    assert store.merge(row, lambda rows, new: rows, ("s", 11)) is None
    assert {n for k, n, *_ in want if k in ("k0", "k1", "k2")} == {"v9", "v10", "v11"}


def test_a_run_lost_before_its_manifest_leaves_the_old_state(spark, store, monkeypatch):
    want, row = content(store), spark.createDataFrame([("k1", "x", 1.0, 1)], "key string, name string, price double, seq int")
    change = lambda rows, new: T.upsert_nonempty(rows, new, "key", ["seq"])
    publish = BucketStore._publish

    def lost(self, manifest):
        raise RuntimeError("lost")
    monkeypatch.setattr(BucketStore, "_publish", lost)
    with pytest.raises(RuntimeError):
        store.merge(row, change, ("s", 0))
    assert content(store) == want
    monkeypatch.setattr(BucketStore, "_publish", publish)
    Path(store.path, "manifests", f"{2:012d}.json").write_text('{"version": 2, "fol')  # lost while it wrote
    assert content(store) == want
    assert store.merge(row, change, ("s", 0))["rows"] == 200 and ("k1", "x", 1.0, "new") in content(store)
    with pytest.raises(Exception):  # a second writer of the same version
        store._publish(store.manifest())


def test_empty_store_and_empty_batch(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path / "e"), SCHEMA, "key", 4)
    assert store.read().collect() == [] and store.versions() == []
    none = spark.createDataFrame([], SCHEMA)
    assert store.merge(none, lambda rows, batch: batch, ("s", 0)) == {"rows": 0, "inserted": 0, "updated": 0, "skipped": 0}
    assert store.merge(none, lambda rows, batch: batch, ("s", 0)) is None
    store.rewrite(F.lit(True), lambda rows: rows)
    store.compact()
    assert store.read().collect() == []
