"""Model jobs that are interrupted: every key is asked once, and usage is kept."""

import json

import pytest
from pyspark.sql import functions as F

from bidweave.operators import infer as I
from bidweave.operators import stats as S


def counting(spark, flag):
    """A model that counts its prompts and, as long as a file is there, fails at some of them."""
    calls = spark.sparkContext.accumulator(0)

    def make():
        from pathlib import Path

        def answer(prompts):
            if Path(flag).exists() and any(int(p.split()[-1]) % 10 == 7 for p in prompts):
                raise TimeoutError("no answer")
            calls.add(len(prompts))
            return [(f"re {p}", len(p), 3) for p in prompts]
        return answer
    return calls, make


def test_a_second_run_asks_only_what_is_missing(spark, tmp_path):
    flag, folder = tmp_path / "down", str(tmp_path / "replies")
    flag.touch()
    calls, model = counting(spark, str(flag))
    rows = spark.createDataFrame([(i, f"p {i}") for i in range(200)] + [(3, "p 3"), (None, "p 1")], "id int, prompt string").repartition(3)
    with pytest.raises(I.Unanswered):
        I.ask_once(rows, "id", "prompt", model, folder, "m", batch=4, range_rows=30, wave=3)
    first = calls.value
    assert 0 < first < 200 and I.stored_replies(spark, folder, "int").count() == first
    flag.unlink()
    found = I.ask_once(rows, "id", "prompt", model, folder, "m", batch=4, range_rows=30, wave=3)
    assert {r.id: r.reply for r in found.collect()} == {i: f"re p {i}" for i in range(200)}
    assert calls.value == 200  # each key once over both runs
    assert I.ask_once(rows, "id", "prompt", model, folder).count() == 200 and calls.value == 200
    used = I.stored_replies(spark, folder, "int").agg(F.sum("prompt_tokens").alias("p"), F.sum("completion_tokens").alias("c")).first()
    assert (used.p, used.c) == (sum(len(f"p {i}") for i in range(200)), 600)


def test_jobs_with_a_folder(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def model():
        def answer(prompts):
            calls.add(len(prompts))
            return [json.dumps({"buyer_name_std": "b", "opportunity_score": 5}) if "公告内容" in p else '{"items": [{"产品名称": "x", "数量": "1"}]}' if len(p) > 60 else "s" for p in prompts]
        return answer
    details = spark.createDataFrame([("u", "t1", "d", "c"), ("u", "t2", "d", "c"), ("v", "t1", "d", None)], "url string, title string, publish_date string, content string")
    files = spark.createDataFrame([(1, "text " * 20), (2, "short")], "attachment_id int, text string")
    asked = spark.createDataFrame([("k1", "p"), ("k1", "p"), ("k2", "q")], "cache_key string, prompt string")
    cache = spark.createDataFrame([("k2", "known", 1)], "cache_key string, suggestions string, created_at int")
    for _ in range(2):  # the second run asks nothing
        records = I.extract_structured(details, model=("m", model), folder=str(tmp_path / "a"))
        assert sorted((r.source_url, r.project_name, r.buyer_name_std, r.llm_model) for r in records.collect()) == [
            ("u", "t1", "b", "m"), ("u", "t2", "b", "m"), ("v", "t1", "b", "m")]
        assert [r.attachment_id for r in I.extract_specs(files, model, folder=str(tmp_path / "b")).collect()] == [1]
        answers, fresh = I.suggest(asked, cache, model, folder=str(tmp_path / "c"))
        assert sorted(map(tuple, answers.collect())) == [("k1", "p", "s"), ("k1", "p", "s"), ("k2", "q", "known")] and fresh.count() == 1
        assert calls.value == 5  # three records, one attachment, one key
