import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from bidweave.operators import keys as K
from bidweave.operators import tables as T
from bidweave.operators import textjoin
from bidweave.operators.textjoin import contains_pairs, gram_pairs


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key."""
    rng = random.Random(7)
    data = [(0 if i % 3 == 0 else rng.randrange(40), i, rng.randrange(1000)) for i in range(3000)]
    return spark.createDataFrame(data, "k int, id int, v int").repartition(8)


def test_keep_first_is_idempotent_and_limits_before_the_shuffle(skewed):
    kept = K.keep_first(skewed, "k", [F.col("v"), F.col("id")])
    again = K.keep_first(kept, "k", [F.col("v"), F.col("id")])
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, again.collect()))
    plan = kept._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("a", 4)], "k string, id int")
    assert K.keep_first(df, "k", [F.col("id")]).count() == 1
    assert sorted(r.id for r in K.keep_last(df, "k", ["id"], null_keys="keep").collect()) == [1, 2, 4]


@pytest.mark.parametrize("split_rows", [10_000, 500, 1])
def test_scan_groups_equals_window(skewed, split_rows):
    """All groups whole, only the hot one sliced, all sliced."""
    w = Window.partitionBy("k").orderBy("v", "id")
    want = skewed.select("k", "id", F.row_number().over(w).cast("long"), F.max(F.col("v") % 7).over(w.rowsBetween(Window.unboundedPreceding, 0)),
                         F.lag("id").over(w))
    got = K.scan_groups(skewed, ["k"], ["v", "id"], "n", {"m": F.col("v") % 7}, {"p": F.col("id")}, split_rows).select("k", "id", "n", "m", "p")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


@pytest.mark.parametrize("split_rows", [10_000, 500])
def test_collect_parts_keeps_everything(skewed, split_rows):
    parts = K.collect_parts(skewed, ["k"], ["id"], ["id", "v"], part_rows=50, split_rows=split_rows)
    rows = parts.collect()
    assert max(len(r["items"]) for r in rows) <= 50
    flat = sorted((r.k, i.id, i.v) for r in rows for i in r["items"])
    assert flat == sorted(map(tuple, skewed.collect()))
    hot = [i.id for r in sorted((r for r in rows if r.k == 0), key=lambda r: r.part) for i in r["items"]]
    assert hot == sorted(hot)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_join(spark, skewed, how):
    right = spark.createDataFrame([(k, f"n{k}") for k in range(0, 40, 2)] + [(0, "second")], "k int, name string")
    counts = skewed.groupBy("k").count()
    got = K.salted_join(skewed, right, ["k"], counts, how, rows_per_salt=100)
    assert sorted(map(str, got.collect())) == sorted(map(str, skewed.join(right, "k", how).collect()))


@pytest.mark.parametrize("way", [contains_pairs, gram_pairs, lambda p, t: gram_pairs(p, t, rows_per_salt=5)])
def test_contains_pairs_equals_brute_force(spark, way):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab市") for _ in range(rng.randrange(1, 12))) for _ in range(60)]
    patterns = ["".join(rng.choice("ab市") for _ in range(rng.randrange(0, 7))) for _ in range(60)]
    got = way(spark.createDataFrame([(p,) for p in patterns], "pattern string"),
              spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "text string, i int"))
    want = {(p, i) for p in patterns if p for i, t in enumerate(texts) if p in t}
    rows = [(r.pattern, r.i) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


@pytest.mark.parametrize("bytes_", [textjoin.PATTERN_BYTES, 3])
def test_first_matches_equal_brute_force(spark, monkeypatch, bytes_):
    """One row per pattern, or per text, by the automaton and by grams; overlapping and one-character patterns."""
    monkeypatch.setattr(textjoin, "PATTERN_BYTES", bytes_)
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("ab市") for _ in range(n))
    texts = sorted({word(rng.randrange(0, 12)) for _ in range(60)})
    patterns = [(word(rng.randrange(0, 6)), f"v{rng.randrange(30):02d}") for _ in range(80)] + [("a", "v05"), ("a", "v01"), ("zz", "v00"), (None, "v00")]
    valued = [(t, f"c{rng.randrange(40):02d}" if i % 5 else None) for i, t in enumerate(texts)] + [(None, "c00")]
    p, t = spark.createDataFrame(patterns, "pattern string, v string"), spark.createDataFrame(valued, "text string, c string")
    got = {r.pattern: r.c for r in textjoin.least_by_pattern(p, t, "c").collect() if r.c is not None}
    words = {w for w, _ in patterns if w}
    assert got == {w: min(c) for w in words if (c := [c for x, c in valued if c and x and w in x])}
    got = {r.text: r.v for r in textjoin.least_by_text(p, t.select("text").filter("text IS NOT NULL"), "v").collect()}
    assert got == {x: min(v) for x in texts if (v := [v for w, v in patterns if w and w in x])}
    places = spark.createDataFrame([(w, "p", "c") for w in words], "name string, province string, city string")
    got = {r.org: r.matched_name for r in textjoin.infer_region(spark.createDataFrame([(x,) for x in texts], "org string"), places).collect()}
    assert got == {x: min((w for w in words if w in x), key=lambda w: (-len(w), w), default=None) for x in texts}


def test_sets(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "c int"), spark.createDataFrame([(2,), (3,)], "c int")
    assert sorted(r.c for r in K.distinct_union(a, b).collect()) == [1, 2, 3]
    assert [r.c for r in K.difference(a, b).collect()] == [1] and [r.c for r in K.intersection(a, b).collect()] == [2]
    assert K.limit_unique(a.withColumn("o", F.col("c")), "c", ["o"], 1).count() == 1


TARGET = [("u1", "old", "5", "matched"), ("u2", "keep", "", "filtered")]
BATCH = [("u1", "", "7", 1), ("u3", "new", "", 2), ("u3", "", "9", 3), ("", "x", "x", 4)]


@pytest.fixture
def merge(spark):
    return (spark.createDataFrame(TARGET, "url string, project_name string, budget string, status string"),
            spark.createDataFrame(BATCH, "url string, project_name string, budget string, seq int"))


def test_upsert_nonempty_is_idempotent(merge):
    target, batch = merge
    once = T.upsert_nonempty(target, batch, "url", ["seq"])
    want = [("u1", "old", "7", "new"), ("u2", "keep", "", "filtered"), ("u3", "new", "9", "new")]
    assert sorted(map(tuple, once.collect())) == want
    assert sorted(map(tuple, T.upsert_nonempty(once, batch, "url", ["seq"]).collect())) == want


def test_other_merges(merge):
    target, batch = merge
    counts = T.merge_counts(batch, target, "url").first()
    assert (counts.inserted, counts.updated, counts.skipped, counts.total) == (1, 2, 1, 3)
    updated = T.update_by_key(target, batch, "url", ["budget"], ["seq"], {"status": "processed"})
    assert sorted(map(tuple, updated.collect())) == [("u1", "old", "7", "processed"), ("u2", "keep", "", "filtered")]
    replaced = T.upsert(target, batch.filter("url <> ''").selectExpr("url", "project_name", "budget", "'new' AS status", "seq"), "url", ["seq"])
    assert sorted(map(tuple, replaced.collect())) == [("u1", "", "7", "new"), ("u2", "keep", "", "filtered"), ("u3", "", "9", "new")]
    assert T.mark(target, "done", "matched").filter("status = 'done'").count() == 1
    assert T.evolve(target, batch.schema).columns == ["url", "project_name", "budget", "status", "seq"]


def test_replace_table_survives_an_interrupted_swap(spark, merge):
    target, _ = merge
    T.replace_table(target, "swap_me")
    T.replace_table(spark.read.table("swap_me").filter("url = 'u1'"), "swap_me")
    assert spark.read.table("swap_me").count() == 1
    spark.sql("ALTER TABLE swap_me RENAME TO swap_me__old")  # a run was lost between the renames
    T.recover_table(spark, "swap_me")
    assert spark.read.table("swap_me").count() == 1 and not spark.catalog.tableExists("swap_me__old")
    assert "swap_me" in [r.name for r in T.list_tables(spark).collect()]


def test_lookup_prefers_the_first_key(spark):
    df = spark.createDataFrame([("a", "9"), ("9", "x"), ("b", "9")], "name string, code string")
    assert tuple(T.lookup(df, "name", "9", "code").first()) == ("9", "x")
    assert tuple(T.lookup(df, "name", "zz", "code", ["name"]).head(1) or ()) == ()


def test_pending(spark):
    listed = spark.createDataFrame([("http://h/a", 1), ("http://H/a/", 2), ("http://h/b#x", 3), (None, 4)], "url string, id int")
    done = spark.createDataFrame([("http://h/b",)], "url string")
    assert [r.id for r in T.pending(listed, done, "url", order=["id"]).collect()] == [1]
    assert T.pending(listed, done.limit(0), "url", order=["id"], limit=1).count() == 1


def test_chunk_replacement_keeps_all_new_rows(spark):
    old = spark.createDataFrame([(1, "o1"), (1, "o2"), (2, "o3")], "tender_id int, c string")
    new = spark.createDataFrame([(1, "n1"), (1, "n2"), (3, "n3")], "tender_id int, c string")
    assert sorted(r.c for r in T.replace_rows(old, new, ["tender_id"]).collect()) == ["n1", "n2", "n3", "o3"]
    assert sorted(r.c for r in T.replace_rows(old, new, ["tender_id"], replace=False).collect()) == ["n3", "o1", "o2", "o3"]


def test_scan_groups_with_null_keys(spark):
    df = spark.createDataFrame([(None, i) for i in range(20)] + [("a", i) for i in range(3)], "k string, id int")
    got = K.scan_groups(df, ["k"], ["id"], "n", split_rows=5).collect()
    assert sorted((r.k or "", r.id, r.n) for r in got) == sorted([("", i, i + 1) for i in range(20)] + [("a", i, i + 1) for i in range(3)])


def _scanned(df):
    """Rows that the file scan of a plan handed on."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), []
    leaves = plan.collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName().startswith("FileSourceScan"):
            found.append(leaf.metrics().apply("numOutputRows").value())
    return sum(found)


def test_lookups_and_pages_read_only_their_part(spark, tmp_path):
    from bidweave.operators import tables as T
    rows = spark.range(0, 60_000).select((F.col("id") * 2).alias("key"), F.concat(F.lit("row"), F.col("id").cast("string")).alias("v"), F.xxhash64("id").alias("o"))
    path = str(tmp_path / "keys")
    T.write_lookup(rows, "key", path, 64 * 1024)
    one = T.rows_of(spark, path, "key", 4242)
    assert [tuple(r)[:2] for r in one.collect()] == [(4242, "row2121")] and 0 < _scanned(T.rows_of(spark, path, "key", 4242)) < 30_000
    assert _scanned(T.rows_of(spark, path, "key", 4243)) == 0 and one.count() == 1  # a key between others: the Bloom filter tells
    path = str(tmp_path / "pages")
    T.write_positions(rows, [F.col("o")], path, 1000)
    want = [r.key for r in rows.orderBy("o").offset(41_990).limit(20).collect()]
    page = T.page_at(spark, path, 4200 // 2, 20, 1000)
    assert [r.key for r in page.collect()] == [r.key for r in rows.orderBy("o").offset(2099 * 20).limit(20).collect()]
    assert [r.key for r in T.page_at(spark, path, 1, 30, 1000).offset(0).collect()] == [r.key for r in rows.orderBy("o").limit(30).collect()]
    assert len(want) == 20 and _scanned(page) <= 2000 and T.page_at(spark, path, 10_000, 20, 1000).collect() == []
