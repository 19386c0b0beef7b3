"""Words of Han text by a dictionary: the most likely way to cut a run of characters into words.

A dictionary gives words with their counts. Of all ways to cut a run, the one with the largest product of word frequencies stands
(Viterbi over the lattice of dictionary words; a character that begins no word is a word by itself, rarer than any other). Ties go to the
longer first word. Letters and digits of other scripts are words as they stand.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HAN = "一-鿿"
WORD_ROWS, WORD_CHARS = 1_000_000, 32 * 1024 * 1024  # what a task holds of a dictionary


def learn_words(df: DataFrame, columns: list[str], low: int = 2, high: int = 8, at_least: int = 1) -> DataFrame:
    """(word, n): runs of `low` to `high` Han characters in columns of names, titles or keywords (texts or arrays of texts)."""
    parts = []
    for c in columns:
        text = F.array_join(c, " ") if df.schema[c].dataType.typeName() == "array" else F.col(c)
        parts.append(df.select(F.explode(F.regexp_extract_all(text, F.lit(f"[{HAN}]+"), F.lit(0))).alias("word")))
    words = parts[0]
    for more in parts[1:]:
        words = words.unionByName(more)
    return words.filter(F.length("word").between(low, high)).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= at_least)


def cut_run(run: str, logs: dict[str, float], longest: int, floor: float) -> list[str]:
    """The most likely words of a run."""
    n = len(run)
    best = [0.0] * (n + 1)  # best[i]: of the text from i on
    step = [1] * (n + 1)
    for i in range(n - 1, -1, -1):
        top, chosen = -math.inf, 1
        for size in range(min(longest, n - i), 0, -1):
            word = logs.get(run[i:i + size], floor if size == 1 else None)
            if word is not None and word + best[i + size] > top + 1e-12:
                top, chosen = word + best[i + size], size
        best[i], step[i] = top, chosen
    out, i = [], 0
    while i < n:
        out.append(run[i:i + step[i]])
        i += step[i]
    return out


def segmenter(dictionary: DataFrame) -> Callable[[Column], Column]:
    """Column function text -> array of words, for the `mode` of search.tokens and bm25_index."""
    rows = dictionary.groupBy("word").agg(F.sum("n").alias("n")).filter((F.length("word") > 0) & (F.col("n") > 0))
    size = rows.agg(F.count("*").alias("n"), F.sum(F.length("word")).alias("chars")).first()
    if size["n"] > WORD_ROWS or (size["chars"] or 0) > WORD_CHARS:
        raise ValueError(f"a dictionary holds {WORD_ROWS} words at most; raise the least count of learn_words")
    table = rows.toArrow()
    total = sum(table["n"].to_pylist()) or 1
    logs = {w: math.log(n / total) for w, n in zip(table["word"].to_pylist(), table["n"].to_pylist())}
    block = rows.sparkSession.sparkContext.broadcast((logs, max(map(len, logs), default=1), math.log(0.5 / total)))

    @F.arrow_udf("array<string>")
    def words(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, longest, floor = block.value
        token = re.compile(rf"[{HAN}]+|[^\W_{HAN}]+")
        for texts in batches:
            found = []
            for text in texts.to_pylist():
                out: list[str] = []
                for run in token.findall((text or "").lower()):
                    out += cut_run(run, known, longest, floor) if "一" <= run[0] <= "鿿" else [run]
                found.append(out)
            yield pa.array(found, pa.list_(pa.string()))
    return words
