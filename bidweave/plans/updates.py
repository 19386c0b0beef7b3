"""Dedup, pending work and merges."""

import uuid

from pyspark.sql import functions as F

from bidweave.functions.jsonx import meta
from bidweave.operators import keys as K
from bidweave.operators import tables as T
from bidweave.operators.pages import stop_at_repeat
from bidweave.operators.store import BucketStore
from bidweave.plans.registry import QUERIES, query
from bidweave.session import shared_dir


@query("dedup_keep_first", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) = 1""")
def dedup_keep_first(t):
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return K.keep_first(t.lineitem.select(*cols), "l_orderkey", [F.col(c) for c in cols[1:]])


@query("dedup_keep_last", """SELECT user_id, event_id, event_type FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def dedup_keep_last(t):
    return K.keep_last(t.events, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("limit_unique", """WITH f AS (SELECT o_custkey, o_orderdate, o_orderkey FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1)
  SELECT * FROM f ORDER BY o_orderdate, o_orderkey LIMIT 25""")
def limit_unique(t):
    return K.limit_unique(t.orders.select("o_custkey", "o_orderdate", "o_orderkey"), "o_custkey", ["o_orderdate", "o_orderkey"], 25)


CANON = r"""CASE WHEN regexp_extract(url, '^https?://([^/?#]*)', 1) = '' THEN url ELSE lower(regexp_extract(url, '^(https?):', 1)) || '://' || lower(regexp_extract(url, '^https?://([^/?#]*)', 1))
  || CASE WHEN regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) IN ('', '/') THEN '/' ELSE regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/+$', '') END
  || CASE WHEN regexp_extract(url, '^[^?#]*[?]([^#]*)', 1) = '' THEN '' ELSE '?' || regexp_extract(url, '^[^?#]*[?]([^#]*)', 1) END END"""


@query("canonical_url", f"SELECT page_id, {CANON} AS canonical FROM pages")
def canonical(t):
    return T.with_canonical(t.pages.select("page_id", "url"), "url").select("page_id", "canonical")


@query("pending_anti", f"""WITH c AS (SELECT page_id, {CANON} AS canonical FROM pages),
  done AS (SELECT DISTINCT regexp_replace(canonical, '[?].*$', '') AS canonical FROM c)
  SELECT canonical, page_id FROM c WHERE canonical NOT IN (SELECT canonical FROM done)
  QUALIFY row_number() OVER (PARTITION BY canonical ORDER BY page_id) = 1""")
def pending_anti(t):
    done = t.pages.select(F.regexp_replace("url", r"[?].*$", "").alias("done_url"))
    return T.pending(t.pages, done, "url", "done_url", ["page_id"]).select("canonical", "page_id")


@query("insert_absent", """WITH b AS (SELECT l_orderkey AS key, l_shipdate AS d, 'batch' AS source FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber) = 1),
  x AS (SELECT o_orderkey AS key, o_orderdate AS d, 'target' AS source FROM orders WHERE o_orderstatus = 'F')
  SELECT * FROM x UNION ALL SELECT * FROM b WHERE key NOT IN (SELECT key FROM x)""")
def insert_absent(t):
    batch = t.lineitem.select(F.col("l_orderkey").alias("key"), F.col("l_shipdate").alias("d"), F.lit("batch").alias("source"), "l_linenumber")
    target = t.orders.filter(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("d"), F.lit("target").alias("source"))
    return T.insert_absent(target, batch, "key", ["d", "l_linenumber"]).select("key", "d", "source")


def _target(t):
    return t.customer.select(F.col("c_name").alias("url"), F.col("c_mktsegment").alias("project_name"),
                             F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.col("c_mktsegment")).alias("budget"), F.lit("matched").alias("status"))


def _batch(t):
    names = t.customer.select("c_custkey", "c_name")
    rows = t.events.join(names, F.col("user_id") == F.col("c_custkey"), "left")
    return rows.select(F.coalesce("c_name", F.concat(F.lit("new"), F.col("user_id").cast("string"))).alias("url"),
                       F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("project_name"),
                       F.lit("").alias("budget"), F.col("event_id").alias("seq"))


BATCH = """target AS (SELECT c_name AS url, c_mktsegment AS project_name, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_mktsegment END AS budget, 'matched' AS status FROM customer),
  batch AS (SELECT coalesce(c_name, 'new' || user_id) AS url, CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS project_name, '' AS budget, event_id AS seq
    FROM events LEFT JOIN customer ON user_id = c_custkey)"""


@query("upsert_nonempty", f"""WITH {BATCH}, f AS (SELECT url, arg_max(nullif(project_name, ''), seq) FILTER (project_name <> '') AS project_name,
    max(seq) FILTER (seq % 3 = 0) / 2 AS price FROM batch GROUP BY 1)
  SELECT coalesce(t.url, f.url) AS url, coalesce(f.project_name, t.project_name) AS project_name, t.budget,
    coalesce(CAST(f.price AS DOUBLE), CASE WHEN t.url IS NOT NULL THEN 7.5::DOUBLE END) AS price, CASE WHEN f.url IS NULL THEN t.status ELSE 'new' END AS status
  FROM target t FULL JOIN f ON t.url = f.url""")
def upsert_nonempty(t):
    price = F.when(F.col("seq") % 3 == 0, F.col("seq") / 2)
    return T.upsert_nonempty(_target(t).withColumn("price", F.lit(7.5)), _batch(t).withColumn("price", price), "url", ["seq"])


@query("update_by_key", f"""WITH {BATCH}, l AS (SELECT url, project_name FROM batch QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq DESC) = 1)
  SELECT t.url, CASE WHEN l.url IS NULL THEN t.project_name ELSE l.project_name END AS project_name, t.budget, CASE WHEN l.url IS NULL THEN t.status ELSE 'processed' END AS status
  FROM target t LEFT JOIN l ON t.url = l.url""")
def update_by_key(t):
    return T.update_by_key(_target(t), _batch(t), "url", ["project_name"], ["seq"], {"status": "processed"})


@query("upsert_replace", f"""WITH {BATCH}, l AS (SELECT url, project_name, budget, 'new' AS status FROM batch QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq DESC) = 1)
  SELECT * FROM target WHERE url NOT IN (SELECT url FROM l) UNION ALL SELECT * FROM l""")
def upsert_replace(t):
    return T.upsert(_target(t), _batch(t).withColumn("status", F.lit("new")), "url", ["seq"])


@query("merge_counts", f"""WITH {BATCH}, k AS (SELECT url, count(*) AS n, url IN (SELECT url FROM target) AS old FROM batch GROUP BY 1)
  SELECT count(*) FILTER (NOT old) AS inserted, CAST(sum(CASE WHEN old THEN n ELSE n - 1 END) AS BIGINT) AS updated, CAST(0 AS BIGINT) AS skipped,
    (SELECT count(*) FROM target) + count(*) FILTER (NOT old) AS total FROM k""")
def merge_counts(t):
    return T.merge_counts(_batch(t), _target(t), "url")


CHUNKS = """WITH b AS (SELECT l_orderkey AS tender_id, l_linenumber AS chunk_order, l_shipdate AS d FROM lineitem WHERE l_returnflag = 'R'),
  x AS (SELECT l_orderkey AS tender_id, l_linenumber AS chunk_order, l_shipdate AS d FROM lineitem WHERE l_returnflag = 'A')
  SELECT * FROM x WHERE tender_id NOT IN (SELECT tender_id FROM b) UNION ALL SELECT * FROM b"""


# --- the same merges on a table in buckets ---

def _stored(t, target, key="url", buckets=16):
    """The target as a store, written by a merge into an empty one."""
    store = BucketStore(t.spark, f"{shared_dir(t.spark).rstrip('/')}/stores/{uuid.uuid4().hex}", target.schema, key, buckets)
    store.merge(target, lambda rows, batch: batch.select(*rows.columns))
    return store


def _few(t):
    """A batch that touches some of the customers and buckets only."""
    return _batch(t).filter(F.col("seq") % 50 == 0)


FEW = BATCH.replace("FROM events LEFT JOIN customer ON user_id = c_custkey)", "FROM events LEFT JOIN customer ON user_id = c_custkey WHERE event_id % 50 = 0)")


@query("store_upsert_nonempty", f"""WITH {FEW}, f AS (SELECT url, arg_max(project_name, seq) FILTER (project_name <> '') AS project_name FROM batch GROUP BY 1)
  SELECT coalesce(t.url, f.url) AS url, coalesce(f.project_name, t.project_name) AS project_name, t.budget, CASE WHEN f.url IS NULL THEN t.status ELSE 'new' END AS status
  FROM target t FULL JOIN f ON t.url = f.url""")
def store_upsert_nonempty(t):
    store = _stored(t, _target(t))
    store.merge(_few(t), lambda rows, batch: T.upsert_nonempty(rows, batch, "url", ["seq"]))
    return store.read()


@query("store_update_by_key", QUERIES["update_by_key"][1].replace(BATCH, FEW))
def store_update_by_key(t):
    store = _stored(t, _target(t))
    store.merge(_few(t), lambda rows, batch: T.update_by_key(rows, batch, "url", ["project_name"], ["seq"], {"status": "processed"}))
    return store.read()


@query("store_upsert_replace", QUERIES["upsert_replace"][1].replace(BATCH, FEW))
def store_upsert_replace(t):
    store = _stored(t, _target(t))
    store.merge(_few(t).withColumn("status", F.lit("new")), lambda rows, batch: T.upsert(rows, batch, "url", ["seq"]))
    return store.read()


@query("store_merge_counts", f"""WITH {FEW}, k AS (SELECT url, count(*) AS n, url IN (SELECT url FROM target) AS old FROM batch GROUP BY 1)
  SELECT count(*) FILTER (NOT old) AS inserted, CAST(coalesce(sum(CASE WHEN old THEN n ELSE n - 1 END), 0) AS BIGINT) AS updated, CAST(0 AS BIGINT) AS skipped,
    (SELECT count(*) FROM target) + count(*) FILTER (NOT old) AS total FROM k""")
def store_merge_counts(t):
    """Counts that the job which writes has taken."""
    store = _stored(t, _target(t))
    found = store.merge(_few(t), lambda rows, batch: T.upsert_nonempty(rows, batch, "url", ["seq"], counted=True))
    return t.spark.createDataFrame([(found["inserted"], found["updated"], found["skipped"], found["rows"])], "inserted long, updated long, skipped long, total long")


@query("store_replace_chunks", CHUNKS.replace("l_returnflag = 'R'", "l_returnflag = 'R' AND l_orderkey % 64 = 1"))
def store_replace_chunks(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("tender_id"), F.col("l_linenumber").alias("chunk_order"), F.col("l_shipdate").alias("d"), "l_returnflag")
    store = _stored(t, rows.filter("l_returnflag = 'A'").drop("l_returnflag"), "tender_id")
    batch = rows.filter("l_returnflag = 'R' AND tender_id % 64 = 1").drop("l_returnflag")
    store.merge(batch, lambda old, new: T.replace_rows(old, new, ["tender_id"]))
    return store.read()


@query("mark_status", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'processed' ELSE o_orderstatus END AS status FROM orders")
def mark_status(t):
    return T.mark(t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status")), "processed", "O")


@query("apply_verdict", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'matched' WHEN 'O' THEN 'filtered' ELSE 'new' END AS status,
  CASE o_orderstatus WHEN 'F' THEN o_orderpriority || ',x' ELSE 'none' END AS category, CASE o_orderstatus WHEN 'P' THEN NULL ELSE o_orderpriority END AS match_reason FROM orders""")
def apply_verdict(t):
    target = t.orders.select("o_orderkey", F.lit("new").alias("status"), F.lit("none").alias("category"))
    verdicts = t.orders.filter(F.col("o_orderstatus") != "P").select(
        "o_orderkey", (F.col("o_orderstatus") == "F").alias("keep"), F.col("o_orderpriority").alias("reason"),
        F.array(F.col("o_orderpriority"), F.lit("x")).alias("categories"))
    verdicts = verdicts.withColumn("seq", F.lit(2)).unionByName(verdicts.withColumns({"keep": ~F.col("keep"), "reason": F.lit("older"), "seq": F.lit(1)}))
    return T.apply_verdict(target, verdicts, "o_orderkey", ["seq"])


@query("replace_chunks", CHUNKS)
def replace_chunks(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("tender_id"), F.col("l_linenumber").alias("chunk_order"), F.col("l_shipdate").alias("d"), "l_returnflag")
    return T.replace_rows(rows.filter("l_returnflag = 'A'").drop("l_returnflag"), rows.filter("l_returnflag = 'R'").drop("l_returnflag"), ["tender_id"])


@query("orphans", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def orphans(t):
    child = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    return T.orphans(child, t.orders.filter(F.col("o_orderstatus") != "P").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")


@query("propagate_key", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'N' THEN 'own' ELSE o_orderpriority END AS uuid
  FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey""")
def propagate_key(t):
    child = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_returnflag") == "N", "own").alias("uuid"))
    parents = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("uuid"), F.lit(2).alias("seq"))
    parents = parents.unionByName(parents.withColumns({"uuid": F.lit("older"), "seq": F.lit(1)}))
    return T.propagate_key(child, parents, "l_orderkey", "uuid", ["seq"])


@query("row_keys", f"SELECT page_id, sha256({CANON}) AS uuid FROM pages")
def row_keys(t):
    return T.with_row_key(t.pages.select("page_id", "url"), "url").select("page_id", "uuid")


@query("run_compare", """WITH a AS (SELECT o_custkey AS key, count(*) AS n, max(o_orderpriority) AS p FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
  b AS (SELECT o_custkey AS key, count(*) AS n, max(o_orderpriority) AS p FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
  SELECT coalesce(a.key, b.key) AS key, a.key IS NOT NULL AS in_left, b.key IS NOT NULL AS in_right, a.n AS n_left, b.n AS n_right, a.n IS DISTINCT FROM b.n AS n_changed,
    a.p AS p_left, b.p AS p_right, a.p IS DISTINCT FROM b.p AS p_changed FROM a FULL JOIN b ON a.key = b.key""")
def run_compare(t):
    def run(status):
        return t.orders.filter(F.col("o_orderstatus") == status).groupBy(F.col("o_custkey").alias("key")).agg(
            F.count("*").alias("n"), F.max("o_orderpriority").alias("p"))
    return T.compare_runs(run("F"), run("O"), "key", ["n", "p"])


@query("cached_split", """WITH c AS (SELECT event_type AS cache_key, arg_min(value, event_id) AS answer FROM events WHERE event_type IN ('click', 'view') GROUP BY 1)
  SELECT event_id, cache_key, answer FROM (SELECT event_id, event_type AS cache_key FROM events) JOIN c USING (cache_key)
  UNION ALL SELECT event_id, event_type, NULL FROM events WHERE event_type NOT IN (SELECT cache_key FROM c)""")
def cached_split(t):
    cache = t.events.filter(F.col("event_type").isin("click", "view")).select(
        F.col("event_type").alias("cache_key"), F.col("value").alias("answer"), F.col("event_id").alias("seq"))
    requests = t.events.select("event_id", F.col("event_type").alias("cache_key"))
    hits, misses = T.split_cached(requests, cache, "cache_key", ["seq"])
    return K.union_all(hits, misses).select("event_id", "cache_key", "answer")


@query("without_failed", "SELECT event_id FROM events WHERE event_type <> 'error' AND user_id % 10 <> 0")
def without_failed(t):
    rows = t.events.select("event_id", F.when(F.col("event_type") == "error", "").otherwise("m").alias("llm_model"),
                           F.when(F.col("user_id") % 10 != 0, "b").alias("buyer_name_std"))
    return T.without_failed(rows).select("event_id")


@query("repeat_page_stop", """WITH r AS (SELECT user_id AS keyword, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS page, event_type AS url, event_id FROM events),
  p AS (SELECT keyword, page, string_agg(url, ',' ORDER BY url) AS fp FROM r GROUP BY 1, 2),
  s AS (SELECT a.keyword, min(a.page) AS stop FROM p a JOIN p b ON a.keyword = b.keyword AND a.page = b.page + 1 AND a.fp = b.fp GROUP BY 1)
  SELECT event_id, keyword, page FROM r LEFT JOIN s USING (keyword) WHERE stop IS NULL OR page < stop""")
def repeat_page_stop(t):
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long")
    rows = t.events.select(F.col("user_id").alias("keyword"), day.alias("page"), F.col("event_type").alias("url"), "event_id")
    return stop_at_repeat(rows).select("event_id", "keyword", "page")


@query("code_sets", """SELECT 'union' AS op, count(*) AS n FROM (SELECT o_custkey FROM orders UNION SELECT user_id FROM events)
  UNION ALL SELECT 'difference', count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT user_id FROM events)
  UNION ALL SELECT 'intersection', count(*) FROM (SELECT o_custkey FROM orders INTERSECT SELECT user_id FROM events)""")
def code_sets(t):
    a, b = t.orders.select(F.col("o_custkey").alias("c")), t.events.select(F.col("user_id").alias("c"))
    return K.union_all(*[df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n") for name, df in (
        ("union", K.distinct_union(a, b)), ("difference", K.difference(a, b)), ("intersection", K.intersection(a, b)))])


@query("props_meta", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def props_meta(t):
    return t.events.select("event_id", meta("props", "k").cast("long").alias("k"))
