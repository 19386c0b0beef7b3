import itertools
import math
import random

from pyspark.sql import functions as F

from bidweave.operators import search as SE
from bidweave.operators import segment as G


def test_best_path_equals_all_paths():
    rng = random.Random(3)
    for _ in range(300):
        words = {"".join(rng.choice("天地人") for _ in range(rng.randrange(1, 5))): rng.randrange(1, 50) for _ in range(rng.randrange(1, 12))}
        total = sum(words.values())
        logs, floor = {w: math.log(n / total) for w, n in words.items()}, math.log(0.5 / total)
        run = "".join(rng.choice("天地人") for _ in range(rng.randrange(0, 9)))
        best = -math.inf
        for cuts in itertools.product([0, 1], repeat=max(0, len(run) - 1)):
            at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(run)]
            parts = [run[a:b] for a, b in zip(at, at[1:])]
            if all(p in logs or len(p) == 1 for p in parts):
                best = max(best, sum(logs.get(p, floor) for p in parts))
        got = G.cut_run(run, logs, max(map(len, words)), floor)
        assert "".join(got) == run and (not run or abs(sum(logs.get(p, floor) for p in got) - best) < 1e-9)


def test_words_of_texts(spark):
    titles = spark.createDataFrame([("卫星通信 终端", ["卫星", "通信"]), ("卫星通信", ["设备"]), ("设备", None), (None, ["采购"])], "title string, keywords array<string>")
    words = G.learn_words(titles, ["title", "keywords"])
    assert {r.word: r.n for r in words.collect()} == {"卫星通信": 2, "终端": 1, "卫星": 1, "通信": 1, "设备": 2, "采购": 1}
    data = [(1, "采购卫星通信设备ABC12 x_y"), (2, None), (3, ""), (4, "未知卫星通"), (5, "É漢字采购")]
    frame = spark.createDataFrame(data, "id int, t string")
    got = {r.id: r.w for r in frame.select("id", G.segmenter(words)("t").alias("w")).collect()}
    assert got == {1: ["采购", "卫星通信", "设备", "abc12", "x", "y"], 2: [], 3: [], 4: ["未", "知", "卫星", "通"], 5: ["é", "漢", "字", "采购"]}
    index = SE.bm25_index(frame, "id", "t", G.segmenter(words))
    assert {r.term for r in index.terms.collect()} >= {"卫星通信", "采购"}
    found = SE.bm25_search(index, spark.createDataFrame([(0, "卫星通信")], "qid int, text string"), "qid", k=3, mode=G.segmenter(words)).collect()
    assert [r.doc_id for r in found] == [1]
    none = words.limit(0)
    assert frame.filter("id = 5").select(G.segmenter(none)(F.col("t"))).first()[0] == ["é", "漢", "字", "采", "购"]
