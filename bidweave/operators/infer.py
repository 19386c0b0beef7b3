"""Batch inference jobs: embedding, structured extraction, attachment specs, suggestions.

A model is given as a *factory*: a function without arguments that builds the callable. It is
shipped to the executors and called once per task, so no client object ever crosses over from
the driver. The defaults need no network.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidweave import rules
from bidweave.functions import html as H
from bidweave.functions import jsonx as J
from bidweave.functions import names as N
from bidweave.functions.text import clean_text, nonblank, strip_markers, text_truthy
from bidweave.operators.keys import once, one_per_key
from bidweave.operators.tables import pending, split_cached, union_all
from bidweave.session import cut

Encoder = Callable[[list[str]], list[list[float]]]
Model = Callable[[list[str]], list[str | None]]


def hashing_encoder(dim: int = 64, unit: bool = True) -> Callable[[], Encoder]:
    """Deterministic offline encoder: signed counts of hashed tokens, scaled to length 1 unless `unit` is off."""
    def make() -> Encoder:
        word = re.compile(r"[一-鿿]|[^\W_一-鿿]+")

        @lru_cache(1 << 18)
        def place(token: str) -> tuple[int, float]:
            h = hashlib.md5(token.encode()).digest()
            return int.from_bytes(h[:4], "big") % dim, 1.0 if h[4] >> 7 else -1.0

        def one(text: str) -> list[float]:
            v = [0.0] * dim
            for token, n in Counter(word.findall(text.lower())).items():
                at, sign = place(token)
                v[at] += sign * n
            norm = math.sqrt(sum(x * x for x in v)) if unit else 0.0
            return [x / norm for x in v] if norm else v

        return lambda texts: [one(t) for t in texts]
    return make


def embed(df: DataFrame, key: str, text: str, encoder: Callable[[], Encoder], batch: int = 20) -> DataFrame:
    """(key, embedded_content, embedding); blank texts are embedded as a placeholder word."""
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for rows in batches:
            texts = rows.column(1).to_pylist()
            vectors: list[list[float]] = []
            for i in range(0, len(texts), batch):
                vectors += encode(texts[i:i + batch])
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array(vectors, pa.list_(pa.float32()))],
                names=["key", "embedded_content", "embedding"])

    source = df.select(key, nonblank(text).alias("_text"))
    return source.mapInArrow(run, f"key {key_type}, embedded_content string, embedding array<float>").withColumnRenamed("key", key)


def ask(df: DataFrame, key: str, prompt: str, model: Callable[[], Model], batch: int = 20) -> DataFrame:
    """(key, reply): the model's answer per prompt, null when the call failed."""
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answer = model()
        for rows in batches:
            prompts = rows.column(1).to_pylist()
            replies: list[str | None] = []
            for i in range(0, len(prompts), batch):
                replies += answer(prompts[i:i + batch])
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(replies, pa.string())], names=["key", "reply"])

    return df.select(key, prompt).mapInArrow(run, f"key {key_type}, reply string").withColumnRenamed("key", key)


REPLIES = "reply string, prompt_tokens long, completion_tokens long, error string"


class Unanswered(RuntimeError):
    """A model failed for some prompts; all other replies are stored, and the next run asks the rest."""


def stored_replies(spark: SparkSession, folder: str, key_type: str = "string") -> DataFrame:
    """(key, reply, prompt_tokens, completion_tokens) of the answered prompts in a folder, one row per key."""
    kind = f"key {key_type}, {REPLIES}, model string"
    try:
        rows = spark.read.schema(kind).parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], kind)
    return one_per_key(rows.filter("error IS NULL").drop("error"), "key", ["reply", "model"])


def ask_once(df: DataFrame, key: str, prompt: str, model: Callable[[], Model], folder: str, name: str = "", batch: int = 20,
             range_rows: int = 500, wave: int = 256) -> DataFrame:
    """`ask` for jobs that may be interrupted: (key, reply), every key asked once over all runs on the same folder.

    Keys without a stored reply are cut into ranges of about `range_rows` keys, a task each; a wave of ranges is a job whose output is
    committed before the next begins. Where the model raises, the task keeps the replies it has, the failed batch is noted, and
    the rest of its range waits for the next run, which starts from what is missing; Unanswered tells the caller. An executor that is
    lost costs the replies of the ranges it was asking. A reply may be a text, or (text, prompt tokens, completion tokens): usage is kept
    beside the reply (stats.usage_cost reads it). Equal keys must have equal prompts.
    """
    spark, key_type = df.sparkSession, df.schema[key].dataType.simpleString()
    known = stored_replies(spark, folder, key_type).select("key")
    asked = one_per_key(df.select(F.col(key).alias("key"), F.col(prompt).alias("prompt")), "key", ["prompt"])
    todo = cut(asked.join(known, "key", "left_anti"))
    ranges = max(1, math.ceil(todo.count() / range_rows))
    place = F.pmod(F.xxhash64("key"), F.lit(ranges))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answer, failed = None, None
        for rows in batches:
            keys, prompts = rows.column(0), rows.column(1).to_pylist()
            at, replies = [], []
            for i in range(0, len(prompts) if failed is None else 0, batch):
                part = prompts[i:i + batch]
                try:
                    answer = answer or model()
                    got = [(r, None, None, None) if r is None or isinstance(r, str) else (*r, None) for r in answer(part)]
                except Exception as error:  # of any kind: the model is foreign code
                    failed = f"{type(error).__name__}: {error}"
                    got = [(None, None, None, failed)] * len(part)
                at += range(i, i + len(part))
                replies += got
                if failed is not None:
                    break
            columns = list(zip(*replies)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()),
                                              pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string()), pa.array([name] * len(at), pa.string())],
                                             names=["key", "reply", "prompt_tokens", "completion_tokens", "error", "model"])

    for first in range(0, ranges, wave):
        many = min(wave, ranges - first)
        rows = todo.withColumn("_range", place).filter(F.col("_range").between(first, first + many - 1)).repartition(many, "_range")
        rows.select("key", "prompt").mapInArrow(run, f"key {key_type}, {REPLIES}, model string").write.mode("append").parquet(folder)
    found = stored_replies(spark, folder, key_type)
    missing = todo.join(found.select("key"), "key", "left_anti").count()
    if missing:
        raise Unanswered(f"{missing} prompts have no reply yet; run again with the same folder")
    return asked.select("key").join(found.select("key", "reply"), "key").withColumnRenamed("key", key)


def _replies(df: DataFrame, key: str, prompt: str, model: Callable[[], Model], folder: str | None, name: str = "") -> DataFrame:
    return ask(df, key, prompt, model) if folder is None else ask_once(df, key, prompt, model, folder, name)


def rule_extract(details: DataFrame, name: str = "title", content: str = "content") -> DataFrame:
    """Default extractor: labelled fields, standard names, money and score as column rules."""
    labels = dict(zip(rules.FIELD_LABELS, H.labelled_fields(content)))
    fields = once(details, _both=F.concat_ws(" ", F.col(name), F.col(content)), **{f"_{n}": labels[n] for n in ("buyer", "agency", "region", "amount")})
    # names, amounts and the kind of page are found once; the score and both amounts ask for them many times
    fields = once(fields, _org=N.standardize_org("_buyer"), _money=N.parse_money("_amount"), _method=H.page_type("_both"),
                  _win=H.title_type(name).isin("中标公告", "成交公告"))
    buyer, amount, is_win, method = (F.col(c) for c in ("_org", "_money", "_win", "_method"))
    return fields.select(
        F.col("url").alias("source_url"), F.col(name).alias("project_name"), buyer.alias("buyer_name_std"),
        N.standardize_org("_agency").alias("agency_name_std"), F.col("_region").alias("province"),
        F.col("_amount").alias("budget_raw"), N.null_budget_if_won(amount, is_win).alias("budget_amount"),
        F.lit("元").alias("budget_unit"), F.when(is_win, amount).alias("winning_amount"),
        clean_text(content).alias("content_summary"),
        N.opportunity_score(amount, buyer, method, F.lit(0)).alias("opportunity_score"), F.lit("rules").alias("llm_model"))


def ask_intent(records: DataFrame, key: str, model: Callable[[], Model], title: str = "list_title",
               body: str = "detail_body_preview", min_chars: int = 50) -> DataFrame:
    """Model form of the intent check: intent_verdict, matched_products and reason per record.
    Too short texts are not asked; a failed call and an unreadable reply are verdicts of their own."""
    rows = records.withColumn("_body", H.segment_intent(body)).withColumn("_short", F.length("_body") < min_chars)
    prompt = F.concat(F.lit("标题："), F.coalesce(F.col(title), F.lit("")), F.lit("\n需求："), F.col("_body"))
    replies = ask(rows.filter(~F.col("_short")).withColumn("_prompt", prompt), key, "_prompt", model)
    reply = J.reply_to_struct("reply", "struct<intent_verdict:string,matched_products:array<string>,reason:string>")
    told = replies.select(key, F.col("reply").isNull().alias("_failed"), reply.alias("r"))
    verdict = (F.when(F.col("_short"), rules.VERDICT_MISSING).when(F.col("_failed"), rules.VERDICT_FAILED)
               .when(F.col("r").isNull() | F.col("r.intent_verdict").isNull(), rules.VERDICT_UNREADABLE)
               .otherwise(F.col("r.intent_verdict")))
    empty = F.array().cast("array<string>")
    return rows.join(told, key, "left").select(
        *records.columns, verdict.alias("intent_verdict"), F.coalesce("r.matched_products", empty).alias("matched_products"),
        F.coalesce("r.reason", F.lit("")).alias("reason"))


EXTRACT_FIELDS = ("buyer_name_std string, agency_name_std string, province string, city string, budget_raw string, "
                  "budget_amount double, winning_bidder array<string>, winning_amount double, product_keywords array<string>, "
                  "application_scenario string, technical_requirements_summary string, content_summary string, "
                  "opportunity_score int, opportunity_reason string, next_action string")


def extract_structured(details: DataFrame, done: DataFrame | None = None, model: tuple[str, Callable[[], Model]] | None = None,
                       folder: str | None = None) -> DataFrame:
    """Structured records of the pending detail rows. Without a model the column rules are used;
    with one, a row whose reply cannot be read stays as a bare record and is retried later. With a folder the
    replies are kept there as they come (ask_once)."""
    todo = details if done is None else pending(details, done, "url", "source_url")
    if model is None:
        return rule_extract(todo)
    name, factory = model
    prompt = F.concat(F.lit("项目名称："), F.coalesce("title", F.lit("")), F.lit("\n发布日期："),
                      F.coalesce(F.col("publish_date").cast("string"), F.lit("")), F.lit("\n公告内容：\n"),
                      F.coalesce("content", F.lit("")))
    # the record travels with its prompt, so equal URLs stay rows of their own and nothing is joined back
    own = F.struct(F.col("url").alias("source_url"), F.col("title").alias("project_name"), "publish_date")
    rows = todo.select(own.alias("_own"), prompt.alias("_prompt"))
    if folder is None:
        replies = ask(rows, "_own", "_prompt", factory)
    else:
        rows = rows.withColumn("_key", F.sha2("_prompt", 256))
        replies = rows.join(ask_once(rows, "_key", "_prompt", factory, folder, name), "_key")
    parsed = replies.select("_own", J.reply_to_struct("reply", f"struct<{_colon(EXTRACT_FIELDS)}>").alias("r"))
    return parsed.select("_own.*", "r.*", F.when(F.col("r").isNotNull(), F.lit(name)).alias("llm_model"))


def _colon(ddl: str) -> str:
    return ", ".join(f"{part.split(' ', 1)[0]}:{part.split(' ', 1)[1]}" for part in ddl.split(", "))


def extract_specs(attachments: DataFrame, model: Callable[[], Model], key: str = "attachment_id", min_chars: int = 50,
                  folder: str | None = None) -> DataFrame:
    """One row per product of an attachment text: name and requirement. Too short texts are
    skipped; of a broken reply the readable items are kept. With a folder the replies are kept there as they come."""
    todo = attachments.filter(F.length(F.trim("text")) >= min_chars)
    replies = _replies(todo, key, "text", model, folder)
    items = J.format_items(J.salvage_items("reply", J.SPEC_SCHEMA))
    rows = replies.select(key, F.inline(items))
    return todo.drop("text").join(rows, key)


def suggest(requests: DataFrame, cache: DataFrame, model: Callable[[], Model], prompt: str = "prompt",
            folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(all answers, new cache rows). Requests carry cache_key and prompt; known keys are
    answered from the cache, the rest once per key by the model. With a folder the replies are kept there as they come."""
    hits, misses = split_cached(requests, cache, "cache_key", ["created_at"])
    todo = misses.groupBy("cache_key").agg(F.min(prompt).alias(prompt))
    fresh = _replies(todo, "cache_key", prompt, model, folder).select("cache_key", strip_markers("reply").alias("suggestions"))
    fresh = cut(fresh.filter(text_truthy("suggestions")))  # both results read it; the model is asked once
    answered = misses.join(fresh, "cache_key", "left")
    return union_all(hits.select("cache_key", prompt, "suggestions"), answered.select("cache_key", prompt, "suggestions")), fresh
