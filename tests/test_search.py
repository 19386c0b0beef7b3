import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bidweave.operators import chunks as CH
from bidweave.operators import fusion as FU
from bidweave.operators import postings as P
from bidweave.operators import search as SE

WORDS = "alpha beta gamma delta eps 天通 卫星 设备".split()


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    docs = {i: " ".join(rng.choice(WORDS[: 2 + i % 7]) for _ in range(rng.randrange(1, 30))) for i in range(80)}
    docs[80] = docs[3]  # an exact copy: equal scores, the lower id first
    queries = {0: "alpha beta beta", 1: "天通卫星 gamma", 2: "nothing here", 3: "delta eps"}
    return docs, queries


def toks(text):
    text = text.lower()
    return re.findall(r"[一-鿿]|[^\W_一-鿿]+", text) + re.findall(r"(?=([一-鿿]{2}))", text)


def brute(docs, queries):
    tf = {i: Counter(toks(t)) for i, t in docs.items()}
    dl = {i: sum(c.values()) for i, c in tf.items()}
    n, avgdl = len(docs), sum(dl.values()) / len(docs)
    df = Counter(t for c in tf.values() for t in c)
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: r if r >= 0 else 0.25 * mean for t, r in raw.items()}
    out = {}
    for q, text in queries.items():
        for i in docs:
            s = sum(idf[t] * tf[i][t] * 2.5 / (tf[i][t] + 1.5 * (0.25 + 0.75 * dl[i] / avgdl)) for t in toks(text) if t in tf[i])
            if any(t in tf[i] for t in toks(text)):
                out[q, i] = s
    return out


def frames(spark, corpus):
    docs, queries = corpus
    return (spark.createDataFrame(list(docs.items()), "id int, text string").repartition(5),
            spark.createDataFrame(list(queries.items()), "qid int, text string"))


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
def test_bm25_equals_brute_force_on_both_plans(spark, corpus, broadcast_rows, monkeypatch):
    monkeypatch.setattr(SE, "ROWS_PER_SALT", 20)  # frequent terms are salted
    docs, queries = frames(spark, corpus)
    got = {(r.qid, r.doc_id): r.score for r in SE.bm25_scores(SE.bm25_index(docs, "id"), queries, "qid", broadcast_rows=broadcast_rows).collect()}
    want = brute(*corpus)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-8 for k in want)


def test_stored_index_reads_the_buckets_of_its_terms(spark, corpus):
    docs, queries = frames(spark, corpus)
    index = SE.bm25_index(docs, "id")
    SE.write_index(index, "words", 8)
    stored = SE.read_index(spark, "words")
    plan = SE.bm25_scores(stored, queries.filter("qid = 3"), "qid")._jdf.queryExecution().executedPlan().toString()
    assert "SelectedBucketsCount: 2 out of 8" in plan and "In(term" in plan
    hits = [sorted(map(tuple, SE.bm25_search(ix, queries, "qid", k=5).collect())) for ix in (index, stored)]
    assert hits[0] == hits[1] and len(hits[0]) == 15
    for qid, text in corpus[1].items():
        one = [tuple(r) for r in SE.bm25_request(stored, text, 5).collect()]
        assert one == sorted(((d, s, r) for q, d, s, r in hits[0] if q == qid), key=lambda x: x[2])


@pytest.mark.parametrize("k", [1, 4, 30])
def test_blocks_below_the_kth_score_are_left_out(spark, k):
    """Two rounds give the rows of one, with and without a filter; a rare term makes most blocks hopeless."""
    rng = random.Random(k)
    data = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 20))) + (" rare" if i in (7, 150, 390) else ""), i % 3 == 0) for i in range(400)]
    docs = spark.createDataFrame(data, "id int, text string, ok boolean").repartition(3)
    queries = spark.createDataFrame([(0, "rare alpha"), (1, "beta gamma 卫星"), (2, "rare"), (3, "nothing"), (4, "alpha")], "qid int, text string")
    built = SE.bm25_index(docs, "id", keep=("ok",), block_docs=10)
    SE.write_index(built, f"pruned{k}", 4)
    index = SE.read_index(spark, f"pruned{k}")
    for accept in (None, "ok"):
        channel = []
        for ix, most in ((index, 0), (index, 10_000), (built, 0)):
            found = SE.bm25_best(ix, queries, "qid", "text", k, accept=accept, prune_docs=most).filter("score > 0")
            if accept:
                found = found.filter("ok")
            channel.append(sorted(map(tuple, SE.top_k(found, k, [F.col("score").desc(), F.col("doc_id")], ["qid"], "rank").collect())))
        assert channel[0] == channel[1] == channel[2] and channel[0]
    asked = SE._Asked(index, queries, "qid", "text", "words", 1000)
    bounds = {(r.qid, r.block): r.bound for r in SE.block_bounds(index, asked).collect()}
    blocks = {r.doc_id: r.block for r in index.blocks.select("block", F.explode("_doc_id").alias("doc_id")).collect()}
    assert len(set(blocks.values())) >= 40
    scores = SE.bm25_scores(index, queries, "qid").collect()
    assert all(r.score <= bounds[r.qid, blocks[r.doc_id]] for r in scores)
    if k == 1:  # what the first round leaves for the query with a rare term
        best = max(r.score for r in scores if r.qid == 0)
        assert sum(b >= best for (q, _), b in bounds.items() if q == 0) <= 3


def test_char_tokens(spark):
    got = SE.tokenize(spark.createDataFrame([(1, "Aab 天")], "id int, t string"), "id", "t", "chars").collect()
    assert {(r.term, r.tf) for r in got} == {("a", 2), ("b", 1), (" ", 1), ("天", 1)}


@pytest.fixture(scope="module")
def vecs():
    rng = np.random.default_rng(5)
    data = rng.normal(size=(150, 8)).astype(np.float32)
    data[40] = data[7]
    return data


@pytest.mark.parametrize("block", [64 * 1024 * 1024, 8 * 8 * 6])
def test_vector_search_equals_brute_force_on_both_plans(spark, vecs, block):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "id int, embedding array<float>").repartition(6)
    qs = df.filter("id < 20").withColumnRenamed("id", "qid")
    got = SE.vector_search(df, qs, 8, 5, broadcast_bytes=block).collect()
    unit = vecs.astype(np.float64) / np.linalg.norm(vecs.astype(np.float64), axis=1, keepdims=True)
    scores = np.rint(unit[:20] @ unit.T * 1e9) / 1e9
    want = {(q, int(d), r + 1) for q in range(20) for r, d in enumerate(np.lexsort((np.arange(150), -scores[q]))[:5])}
    assert {(r.qid, r.doc_id, r["rank"]) for r in got} == want


def test_invalid_vectors_are_left_out(spark):
    df = spark.createDataFrame([("a", [3.0, 4.0]), ("b", [1.0]), (None, [1.0, 1.0]), ("z", [0.0, 0.0])], "id string, embedding array<float>")
    got = {r.id: [round(x, 6) for x in r.embedding] for r in SE.vector_table(df, 2).collect()}
    assert got == {"a": [0.6, 0.8], "z": [0.0, 0.0]}


def test_rrf_values(spark):
    v = spark.createDataFrame([(1, 10, 0.9, 0), (1, 11, 0.8, 1)], "qid int, doc_id int, vector_score double, vector_rank int")
    b = spark.createDataFrame([(1, 12, 5.0, 1.0, 0), (1, 10, 4.0, 0.8, 1)], "qid int, doc_id int, bm25_score double, bm25_norm double, bm25_rank int")
    got = {r.doc_id: r.rrf for r in FU.rrf(v, b).collect()}
    assert got == pytest.approx({10: 0.5 / 61 + 0.5 / 62, 11: 0.5 / 62, 12: 0.5 / 61})
    assert {r.doc_id for r in FU.rrf(None, b).collect()} == {10, 12} and {r.doc_id for r in FU.rrf(v, None).collect()} == {10, 11}
    with pytest.raises(ValueError):
        FU.rrf(None, None)


def test_rrf_does_not_depend_on_partitions(spark, corpus, vecs):
    docs, queries = frames(spark, corpus)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs[:80])], "id int, embedding array<float>")
    asked = queries.join(vectors.withColumnRenamed("id", "qid"), "qid")
    runs = []
    for n in (1, 7):
        index = SE.bm25_index(docs.repartition(n), "id")
        runs.append(sorted(map(tuple, FU.hybrid_search(index, vectors.repartition(n), asked, 5, 8).collect())))
    assert runs[0] == runs[1]


def test_linear_fills_with_documents_without_evidence(spark):
    docs = spark.createDataFrame([(1, "x"), (2, "a"), (3, "y"), (4, "z")], "id int, text string")
    asked = spark.createDataFrame([(0, "a"), (9, "none")], "qid int, text string")
    got = FU.linear_search(SE.bm25_index(docs, "id"), None, asked, 3).orderBy("qid", "rank").collect()
    assert [(r.qid, r.doc_id, r.score) for r in got] == [(0, 2, 1.0), (0, 1, 0.0), (0, 3, 0.0), (9, 1, 0.0), (9, 2, 0.0), (9, 3, 0.0)]
    assert FU.linear_search(SE.bm25_index(docs, "id"), None, asked, 3, min_score=0.1).count() == 1


def test_client_boost(rows):
    got = rows([(100.0,), (50.0,), (None,), (0.0,)], "a double", FU.client_boost(F.col("a"), 1.0), FU.client_boost(F.col("a"), 0.0))
    assert [(round(a, 6), b) for a, b in got] == [(1.2, 1.0), (1.0, 1.0), (1.0, 1.0), (1.0, 1.0)]
    assert FU.search_k(10, False, False) == 50 and FU.search_k(10, True, False) == 500 and FU.search_k(0, False, True) == 50


def test_chunks_cover_the_text(spark):
    text = "。".join(f"第{i}句话内容" for i in range(100))
    rng = random.Random(2)
    mixed = "".join(rng.choice(["词语", "。", "\n", "\n\n", "a. ", "!"]) for _ in range(4000))
    data = [(1, text), (2, "短文"), (3, ""), (4, None), (5, mixed), (6, "  ")]
    got = CH.chunk_text(spark.createDataFrame(data, "id int, text string"), "id", size=200, overlap=20).collect()
    by_id = {i: [r.chunk_text for r in sorted(got, key=lambda r: r.chunk_order) if r.id == i] for i, _ in data}
    assert by_id[2] == ["短文"] and by_id[3] == by_id[4] == by_id[6] == []
    assert len(by_id[1]) > 1 and all(c in text and len(c) <= 200 for c in by_id[1])
    for i, source in ((1, text), (5, mixed.strip())):
        at = 0
        for c in by_id[i]:
            found = source.find(c, max(0, at - 40))
            assert found >= 0 and source[at:found].strip() == "" or found <= at
            at = max(at, found + len(c))
        assert source[at:].strip() == ""
    with pytest.raises(ValueError):
        CH.chunk_text(spark.createDataFrame(data, "id int, text string"), "id", size=200, overlap=80)


def test_field_chunks(spark):
    schema = ("tender_id int, announce_type string, buyer_name_std string, province string, city string, content_summary string, contact_chunk string, "
              "attachment_summary string, requirement_chunks array<struct<type:string,text:string>>, buyer_contacts array<struct<name:string,phone:string>>, "
              "agency_contacts array<struct<name:string,phone:string>>, project_contacts array<struct<name:string,phone:string>>")
    data = [(1, "采购公告", "某大学", "省", "市", "摘要", "联系", "附件", [("technical_params", "参数"), ("other", None)], [("王", "1")], [], None),
            (2, None, None, None, None, "", None, "无附件", None, None, None, None)]
    out = CH.field_chunks(spark.createDataFrame(data, schema), spark.createDataFrame([(1, "项目"), (2, None)], "tender_id int, project_name string"))
    got = out.orderBy("tender_id", "chunk_order").collect()
    assert [(r.chunk_type, r.chunk_text, r.chunk_order) for r in got] == [
        ("title", "项目", 1), ("content_summary", "摘要", 2), ("contact_chunk", "联系", 3), ("requirement_chunk", "参数", 4), ("requirement_chunk", "", 5),
        ("attachment_summary", "附件", 99)]
    assert got[0].metadata_json == '{"announce_type":"采购公告","buyer_name_std":"某大学","province":"省","city":"市"}'
    assert '"requirement_type":"technical_params"' in got[3].metadata_json


def test_products_stay_below_the_bound(spark, vecs, monkeypatch):
    """_products refuses a larger matrix, so passing means that both plans slice."""
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "id int, embedding array<float>").repartition(2)
    qs = df.withColumnRenamed("id", "qid")
    want = sorted(map(tuple, SE.vector_search(df, qs, 8, 3).collect()))
    monkeypatch.setattr(SE, "RESULT_CELLS", 400)
    monkeypatch.setattr(SE, "BLOCK_VECTORS", 40)
    for block in (64 * 1024 * 1024, 8 * 8 * 6):
        assert sorted(map(tuple, SE.vector_search(df, qs, 8, 3, broadcast_bytes=block).collect())) == want


def test_scores_do_not_depend_on_salts(spark, corpus):
    docs, queries = frames(spark, corpus)
    index = SE.bm25_index(docs, "id")
    want = sorted(map(tuple, SE.bm25_scores(index, queries, "qid").collect()))
    for salt in (1, 7):
        assert sorted(map(tuple, SE.bm25_scores(index, queries, "qid", broadcast_rows=0, rows_per_salt=salt).collect())) == want


def test_own_segmenter(spark):
    split = lambda c: F.split(c, "-")
    got = SE.tokenize(spark.createDataFrame([(1, "a b-c-a b")], "id int, t string"), "id", "t", split).collect()
    assert {(r.term, r.tf) for r in got} == {("a b", 2), ("c", 1)}


@pytest.mark.parametrize("block", [SE.BROADCAST_BYTES, 8 * 6 * 20])
def test_ball_search_equals_a_full_search(spark, tmp_path, block):
    """Clusters, copies, a zero vector and equal scores; most balls are left out."""
    from bidweave.operators import balls as BA
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 6))
    data = np.concatenate([c + rng.normal(scale=0.05, size=(40, 6)) for c in centres]).astype(np.float32)
    data[17] = data[3]
    data[500] = 0
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id int, embedding array<float>").repartition(5)
    asked = frame.filter("id % 13 = 0 or id = 500").withColumnRenamed("id", "qid")
    path = str(tmp_path / "balls")
    for balls in (None, 1, 60):
        BA.write_ball_index(frame, path, 6, balls=balls)
        found, left_out = BA.ball_search(BA.read_ball_index(spark, path, 6), asked, 7, block_bytes=block)
        want = SE.vector_search(frame, asked, 6, 7)
        assert sorted(map(tuple, found.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
        assert left_out == 0 if balls == 1 else left_out > 0.5
    few, _ = BA.ball_search(BA.read_ball_index(spark, path, 6), asked.limit(3), 5000)
    assert few.count() == 3 * len(data)
    BA.write_ball_index(frame.limit(0), path, 6)
    assert BA.ball_search(BA.read_ball_index(spark, path, 6), asked, 3)[0].count() == 0


@pytest.mark.parametrize("cells", [None, 60])
def test_best_of_chunks_equals_brute_force(spark, monkeypatch, cells):
    """Copies, equal scores and a known floor; single precision decides nothing (F2, F4)."""
    if cells:
        monkeypatch.setattr(SE, "RESULT_CELLS", cells * 50)
        monkeypatch.setattr(SE, "PAIRS", 7)
    rng = np.random.default_rng(5)
    data = rng.normal(size=(400, 16))
    data[100:300] = data[99]  # copies, more than are listed
    data[300:350] = data[:50] * (1 + 1e-12)
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    ids, asked = rng.permutation(400), data[[0, 7, 99, 200, 310]]
    scores = np.rint(asked @ data.T * 1e9) / 1e9
    want = {(q, int(ids[at]), scores[q][at]) for q in range(5) for at in np.lexsort((ids, -scores[q]))[:6]}
    for floor in (None, np.sort(scores, axis=1)[:, -6]):
        best = SE.Best(asked, 6, floor)
        for low in range(0, 400, 50):
            best.add(data[low:low + 50], ids[low:low + 50])
        got = best.rows(pa.array(range(5)))
        assert set(zip(*(got[c].to_pylist() for c in ("qid", "doc_id", "score")))) == want


def test_grids_of_many_blocks(spark, tmp_path, vecs, monkeypatch):
    from bidweave.operators import balls as BA
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "id string, embedding array<float>").repartition(3)
    qs = df.withColumnRenamed("id", "qid").limit(40)
    want = sorted(map(tuple, SE.vector_search(df, qs, 8, 4).collect()))
    BA.write_ball_index(df, str(tmp_path), 8)
    monkeypatch.setattr(SE, "RESULT_CELLS", 4 * 50)  # blocks of 50 vectors or queries
    monkeypatch.setattr(SE, "BLOCK_VECTORS", 16)
    monkeypatch.setattr(SE, "grid_rows", lambda dim, k=1, block_bytes=0: 40)
    assert sorted(map(tuple, SE.vector_search(df, qs, 8, 4, broadcast_bytes=64).collect())) == want
    assert sorted(map(tuple, BA.ball_search(BA.read_ball_index(spark, str(tmp_path), 8), qs, 4)[0].select("qid", "doc_id", "score", "rank").collect())) == want


def test_a_large_index_has_more_buckets(spark, corpus, tmp_path, monkeypatch):
    """What a task sorts stays as it is when the index grows; the search finds the same (F6, F7)."""
    docs, queries = frames(spark, corpus)
    index = SE.bm25_index(docs, "id", block_docs=5)
    want = sorted(map(tuple, SE.bm25_search(index, queries, "qid", "text", 5).collect()))
    n = index.postings.selectExpr("sum(size(places))").first()[0]
    monkeypatch.setattr(SE, "TASK_POSTINGS", n // 20)
    SE.write_index(index, "grown", 2, str(tmp_path))
    stored = SE.read_index(spark, "grown")
    files = stored.postings.groupBy(F.input_file_name()).agg(F.sum(F.size("places")).alias("n")).collect()
    assert sum(f.n for f in files) == n and len(files) > 10 and max(f.n for f in files) < n / 4
    assert sorted(map(tuple, SE.bm25_search(stored, queries, "qid", "text", 5, prune_docs=0).collect())) == want
    for part in ("postings", "counts", "blocks", "numbers"):
        spark.sql(f"DROP TABLE grown_{part}")


@pytest.mark.parametrize("held", [1024 * 1024, 200])
def test_a_task_passes_on_the_best_of_its_blocks(spark, monkeypatch, held):
    """Fewer rows than documents that share a term, with copies, a null id and rejected documents; what a task cannot hold goes on early (F9)."""
    monkeypatch.setattr(P, "HELD_ROWS", held)
    rng = random.Random(held)
    data = [(i, "alpha beta" if i % 4 == 0 else " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 20))), i % 3 == 0) for i in range(1, 601)]
    data.append((None, "alpha beta", True))
    rng.shuffle(data)
    docs = spark.createDataFrame(data, "id int, text string, ok boolean").repartition(2)
    queries = spark.createDataFrame([(0, "alpha beta"), (1, "gamma 卫星 alpha"), (2, "nothing"), (3, "delta")], "qid int, text string")
    index = SE.bm25_index(docs, "id", keep=("ok",), block_docs=20)
    order = [F.col("score").desc(), F.col("doc_id")]
    for k in (7, 1000):
        for accept, group in ((None, ["qid"]), ("ok", ["qid", "ok"])):
            passed = SE.bm25_best(index, queries, "qid", "text", k, accept=accept)
            every = SE.bm25_scores(index, queries, "qid", keep=(accept,) if accept else ())
            got, want = (sorted(map(str, SE.top_k(df, k, order, group, "rank").select(*every.columns, "rank").collect())) for df in (passed, every))
            assert got == want and got
            if held > 1000:  # two tasks, three queries with hits
                assert passed.count() <= 2 * k * 3 * len(group) and (k > 30 or passed.count() < every.count() / 2)


@pytest.mark.parametrize("held", [1024 * 1024, 8])
def test_a_task_adds_up_the_terms_of_its_blocks(spark, corpus, monkeypatch, held):
    """A row per term and task, not per term and block; what exceeds the bound goes on early (F9)."""
    monkeypatch.setattr(P, "HELD_ROWS", held)
    rows = frames(spark, corpus)[0].select(F.col("id").alias("doc_id"), SE.tokens("text").alias("_tokens")).repartition(2)
    found = P.term_counts(P.invert(rows, block_docs=4)).collect()
    got, want = Counter(), Counter(t for text in corpus[0].values() for t in set(toks(text)))
    for r in found:
        got[r.term] += r.df
    assert got == want and (held == 8 or len(found) <= 2 * len(want))


def test_a_small_index_goes_to_many_queries(spark, monkeypatch):
    """Neither texts nor pairs are moved to a join; rows of a query id add up, wherever they lie, also without an id (F1)."""
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(n)))
    data = [(i, text(12), i % 3 == 0) for i in range(40)] + [(5, "alpha", True), (None, "alpha beta", True), (50, "alpha beta", None), (51, "", False)]
    index = SE.bm25_index(spark.createDataFrame(data, "id int, text string, ok boolean").repartition(2), "id", keep=("ok",), block_docs=9)
    asked = [(rng.choice((f"q{i}", f"q{i // 3}", "hot")), rng.choice((text(9), text(9), "nothing", None))) for i in range(300)] + [("none", "alpha 天通"), ("none", "gamma")]
    queries = spark.createDataFrame(asked, "qid string, text string").repartition(5)
    unnamed = queries.withColumn("qid", F.when(F.col("qid") != "none", F.col("qid")))
    order = [F.col("score").desc(), F.col("doc_id")]
    SE.write_index(index, "small", 4)
    stored = SE.read_index(spark, "small")
    for k in (4, 100):
        for accept, group in ((None, ["qid"]), ("ok", ["qid", "ok"])):
            def best(found):
                rows = found if accept is None else found.withColumn("ok", F.coalesce("ok", F.lit(False)))
                ranked = SE.top_k(rows.withColumn("qid", F.coalesce("qid", F.lit("none"))), k, order, group, "rank")
                return sorted(map(str, ranked.select(*group, "doc_id", "score", "rank").collect()))
            want = best(SE.bm25_scores(index, queries, "qid", keep=(accept,) if accept else ()))
            with monkeypatch.context() as m:
                m.setattr(SE, "BROADCAST_ROWS", 0)  # the terms of the queries are more than a task holds
                m.setattr(SE, "_joined_scores", None)
                for ix in (index, stored):
                    found = SE.bm25_best(ix, unnamed, "qid", "text", k, accept=accept)
                    assert best(found) == want and len(want) > 250
                    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
                    assert found.groupBy(*group[:1], *[F.coalesce(c, F.lit(False)) for c in group[1:]]).count().filter(F.col("count") > k).isEmpty()
    for part in ("postings", "counts", "blocks", "numbers"):
        spark.sql(f"DROP TABLE small_{part}")


def test_rows_of_a_query_are_added_up_before_they_move(spark, corpus):
    """A frequent query id is a row per batch, with the numbers of its known terms only (F1)."""
    docs, _ = frames(spark, corpus)
    index = SE.bm25_index(docs, "id")
    terms = index.terms.select("term", "idf").toArrow()
    blocks = index.blocks.select("block", "_doc_id").toArrow()
    catalogue = spark.sparkContext.broadcast(P.Catalogue(terms, index.postings.select("term", "block", "places", "tfs", "dls").toArrow(), blocks, index.avgdl))
    rows = spark.range(0, 4000, 1, 2).select(F.lit(7).alias("qid"), SE.tokens(F.lit("alpha beta beta unknown")).alias("_tokens"))
    found = P.numbered(rows, catalogue).collect()
    assert len(found) <= 10
    got = Counter()
    for r in found:
        got.update(dict(zip((terms["term"][t].as_py() for t in r.terms), r.tfs)))
    assert got == {"alpha": 4000, "beta": 8000}
    queries = spark.range(0, 300, 1, 2).select(F.lit(7).alias("qid"), F.lit("alpha beta beta unknown").alias("text"))
    assert SE.bm25_best(index, queries, "qid", "text", 3).count() == 3
    none = SE.bm25_index(spark.createDataFrame([(1, ""), (2, None)], "id int, text string"), "id")
    assert SE.bm25_best(none, queries, "qid", "text", 3).count() == 0


@pytest.mark.parametrize("held", [P.HELD_BYTES, 1])
def test_rows_of_a_query_meet_across_batches(monkeypatch, held):
    """In the order of their ids, nulls first; the rows of a query that span several batches are added up on the way (F1)."""
    monkeypatch.setattr(P, "HELD_BYTES", held)
    rng = random.Random(4)
    rows = sorted(((rng.choice((None, "a", "hot", "hot", "hot", f"q{i}")), rng.randrange(6), 1 + rng.randrange(3)) for i in range(400)), key=lambda r: (r[0] is not None, r[0] or ""))
    want = Counter()
    for q, t, n in rows:
        want[q, t] += n
    for size in (1, 3, 50, 400):
        batches = []
        for low in range(0, 400, size):
            q, t, n = zip(*rows[low:low + size])
            batches.append(P._summed(pa.array(q, pa.string()), np.arange(len(q)), np.array(t), np.array(n)))
        got = [b for b in P._gathered(iter([batches[0].slice(0, 0), *batches]))]
        names = [q for b in got for q in b["qid"].to_pylist()]
        assert len(names) == len(set(names))
        assert {(q, t): n for b in got for q, ts, ns in zip(*(c.to_pylist() for c in b.columns)) for t, n in zip(ts, ns)} == want


@pytest.mark.parametrize("docs", [SE.CATALOGUE_DOCS, 0])
def test_linear_search_fills_repeated_queries(spark, monkeypatch, docs):
    """A query id that comes twice gets documents without evidence twice, with either plan (F1)."""
    monkeypatch.setattr(SE, "CATALOGUE_DOCS", docs)
    index = SE.bm25_index(spark.createDataFrame([(1, "x"), (2, "a"), (3, "y"), (4, "z"), (5, "a b b"), (None, "w")], "id int, text string"), "id")
    asked = [(0, "a"), (0, "none"), (9, "none"), (9, ""), (7, "x y"), (3, "a"), (6, "x y z a w")]
    asked = spark.createDataFrame(asked + [(None, "x")] * (docs > 0), "qid int, text string")
    got = FU.linear_search(index, None, asked, 3).collect()
    by_id = {q: [(r.doc_id, r.score > 0) for r in sorted(got, key=lambda r: r["rank"]) if r.qid == q] for q in {r.qid for r in got}}
    free = {None: [(1, False), (2, False), (3, False)]} if docs else {}
    assert by_id == {0: [(2, True), (5, True), (1, False)], 9: [(1, False), (1, False), (2, False)], 7: [(1, True), (3, True), (2, False)],
                     3: [(2, True), (5, True), (1, False)], 6: [(None, True), (1, True), (3, True)], **free}
