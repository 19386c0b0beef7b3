"""Joins on `text contains pattern`, and rule tables, without a nested loop.

A pattern table of bounded size becomes an Aho-Corasick automaton that every task receives once: one pass over a text finds all
patterns, however many there are. What a caller needs of the hits is decided inside the pass, so a join that keeps the first match
sends one row per pattern or text from a task, not all pairs.

A larger pattern table is joined by n-grams: every pattern is routed through its rarest gram and the candidate pairs are verified.
Patterns shorter than a gram are equal to one of the text's shorter grams. Both ways are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidweave import rules as R
from bidweave.operators.keys import salted_join

GRAM = 4
PATTERN_ROWS, PATTERN_BYTES = 500_000, 8 * 1024 * 1024  # what one automaton holds


def pattern_list(patterns: DataFrame, pattern: str = "pattern") -> list[str] | None:
    """The distinct patterns that are not empty, or None if they are too many for an automaton."""
    wanted = patterns.select(F.col(pattern).alias("p")).filter(F.length("p") > 0).distinct()
    size = wanted.agg(F.count("*").alias("n"), F.sum(F.octet_length("p")).alias("bytes")).first()
    if size["n"] > PATTERN_ROWS or (size["bytes"] or 0) > PATTERN_BYTES:
        return None
    return sorted(wanted.toArrow()["p"].to_pylist())


class Finder:
    """Patterns, numbered in their order, as an automaton that travels to the tasks once."""

    def __init__(self, spark: SparkSession, words: list[str], values: list | None = None):
        machine = ahocorasick.Automaton()
        for n, word in enumerate(words):
            machine.add_word(word, n)
        if words:
            machine.make_automaton()
        self.block = spark.sparkContext.broadcast((machine if words else None, words, values))

    def column(self, kind: str, choose: Callable[[set[int], list[str], list | None], object]) -> Callable[[Column], Column]:
        """A column of what `choose` makes of the numbers of the patterns in a text; null for a null text."""
        block, type_ = self.block, _arrow_type(kind)

        @F.arrow_udf(kind)
        def found(texts: pa.Array) -> pa.Array:
            machine, words, values = block.value
            hits = (None if t is None else set() if machine is None else {n for _, n in machine.iter(t)} for t in texts.to_pylist())
            return pa.array([None if h is None else choose(h, words, values) for h in hits], type_)
        return found

    def patterns(self) -> Callable[[Column], Column]:
        """The patterns in a text, in their order."""
        return self.column("array<string>", lambda hits, words, _: [words[n] for n in sorted(hits)])

    def first(self) -> Callable[[Column], Column]:
        """The first pattern that a text contains, else null."""
        return self.column("string", lambda hits, words, _: words[min(hits)] if hits else None)

    def longest(self) -> Callable[[Column], Column]:
        """The longest pattern in a text, the lesser of equally long ones."""
        return self.column("string", lambda hits, words, _: min((words[n] for n in hits), key=lambda w: (-len(w), w)) if hits else None)

    def least_value(self, kind: str) -> Callable[[Column], Column]:
        """The least value of the patterns in a text."""
        return self.column(kind, lambda hits, _, values: min((values[n] for n in hits), default=None))


def _arrow_type(kind: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import DataType
    return to_arrow_type(DataType.fromDDL(kind))


def grams(c: Column, n: int) -> Column:
    """Distinct n-grams of a text; none when it is shorter than n."""
    starts = F.when(F.length(c) >= n, F.sequence(F.lit(1), F.length(c) - (n - 1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(c, i, F.lit(n))))


def contains_pairs(patterns: DataFrame, texts: DataFrame) -> DataFrame:
    """(pattern, all columns of `texts`) for every non-empty pattern contained in `texts.text`."""
    words = pattern_list(patterns)
    if words is None:
        return gram_pairs(patterns, texts)
    inside = Finder(texts.sparkSession, words).patterns()
    return texts.withColumn("pattern", F.explode(inside(F.col("text")))).select("pattern", *texts.columns)


def gram_pairs(patterns: DataFrame, texts: DataFrame, n: int = GRAM, rows_per_salt: int | None = None) -> DataFrame:
    """contains_pairs for pattern tables of any size. Gram counts are known, so hot grams are salted, short patterns included."""
    salt = {} if rows_per_salt is None else {"rows_per_salt": rows_per_salt}
    wanted = patterns.select("pattern").filter(F.length("pattern") > 0).distinct()
    distinct_texts = texts.select("text").distinct()

    index = distinct_texts.select("text", F.explode(grams(F.col("text"), n)).alias("gram"))
    counts = index.groupBy("gram").count()
    long = wanted.filter(F.length("pattern") >= n)
    routed = (long.select("pattern", F.explode(grams(F.col("pattern"), n)).alias("gram"))
              .join(counts, "gram", "left")
              .groupBy("pattern").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("k"), "gram")).alias("best"))
              .filter(F.col("best.k") > 0).select("pattern", F.col("best.gram").alias("gram")))
    pairs = salted_join(index, routed, ["gram"], counts, **salt).filter(F.contains("text", F.col("pattern"))).select("pattern", "text")

    short = wanted.filter(F.length("pattern") < n)
    sizes = F.flatten(F.array(*[F.coalesce(grams(F.col("text"), i), F.array().cast("array<string>")) for i in range(1, n)]))
    small = distinct_texts.select("text", F.explode(sizes).alias("pattern"))
    pairs = pairs.unionByName(salted_join(small, short, ["pattern"], small.groupBy("pattern").count(), **salt).select("pattern", "text"))
    return pairs.join(texts, ["text"])


def least_by_pattern(patterns: DataFrame, texts: DataFrame, value: str) -> DataFrame:
    """(pattern, value): of the texts that contain a pattern the least value. A task passes on one row per pattern."""
    words = pattern_list(patterns)
    if words is None:
        return gram_pairs(patterns, texts).groupBy("pattern").agg(F.min(value).alias(value))
    finder = Finder(texts.sparkSession, words)
    kind = texts.schema[value].dataType
    block, type_ = finder.block, _arrow_type(kind.simpleString())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, names, _ = block.value
        best: dict = {}
        for batch in batches:
            for text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if machine is not None and text is not None and found is not None:
                    for _, n in machine.iter(text):
                        if n not in best or found < best[n]:
                            best[n] = found
        yield pa.RecordBatch.from_arrays([pa.array([names[n] for n in best], pa.string()), pa.array(list(best.values()), type_)], names=["pattern", value])

    rows = texts.select("text", value).mapInArrow(scan, f"pattern string, `{value}` {kind.simpleString()}")
    return rows.groupBy("pattern").agg(F.min(value).alias(value))


def least_by_text(patterns: DataFrame, texts: DataFrame, value: str) -> DataFrame:
    """(text, value): of the patterns that a text contains the least value. texts: one column `text`, distinct; one row each."""
    table = patterns.groupBy("pattern").agg(F.min(value).alias(value))
    if pattern_list(patterns) is None:
        return gram_pairs(table, texts).join(table, "pattern").groupBy("text").agg(F.min(value).alias(value))
    rows = table.filter(F.length("pattern") > 0).toArrow()
    finder = Finder(texts.sparkSession, rows["pattern"].to_pylist(), rows[value].to_pylist())
    least = finder.least_value(patterns.schema[value].dataType.simpleString())
    return texts.select("text", least(F.col("text")).alias(value)).filter(F.col(value).isNotNull())


def infer_region(orgs: DataFrame, gazetteer: DataFrame, org: str = "org", name: str = "name",
                 fields: tuple[str, ...] = ("province", "city")) -> DataFrame:
    """Organisations with the place of the longest gazetteer name they contain (ties by name), one row each.
    A name that several places share stands for the place whose first field the text also names, else for the first place."""
    names, texts = gazetteer.select(F.col(name).alias("pattern")), orgs.select(F.col(org).alias("text")).distinct()
    words = pattern_list(names)
    if words is None:
        longest = gram_pairs(names, texts).groupBy("text").agg(F.min(F.struct((-F.length("pattern")).alias("len"), "pattern"))["pattern"].alias("matched_name"))
    else:
        longest = texts.select("text", Finder(orgs.sparkSession, words).longest()(F.col("text")).alias("matched_name")).filter("matched_name IS NOT NULL")
    longest = longest.withColumnRenamed("text", org)
    places = gazetteer.select(F.col(name).alias("matched_name"), *fields).distinct()
    named = F.coalesce(F.contains(F.col(org), F.col(fields[0])), F.lit(False))
    place = longest.join(places, "matched_name").groupBy(org, "matched_name").agg(
        F.min(F.struct((~named).alias("_other"), *fields)).alias("_place")).select(org, "matched_name", *[F.col(f"_place.{f}").alias(f) for f in fields])
    return orgs.join(place, [org], "left")


# --- rule tables ------------------------------------------------------------------------------

RULES = "category string, keyword string, excluded boolean, position int"


def rule_rows(spark: SparkSession, table: dict) -> DataFrame:
    """A rule table from word lists: category -> keywords, or category -> {keywords, exclude}."""
    rows, position = [], 0
    for category, rule in table.items():
        lists = rule if isinstance(rule, dict) else {"keywords": rule}
        for excluded, words in ((False, lists["keywords"]), (True, lists.get("exclude", []))):
            for word in words:
                rows.append((category, word, excluded, position))
                position += 1
    return spark.createDataFrame(rows, RULES)


class RuleTable:
    """Rules that come as rows (category, keyword, excluded, position), thousands of them if need be. A category holds for a text that
    contains one of its keywords and none of its excluding words; positions give the order of categories and words."""

    def __init__(self, rules: DataFrame):
        rows = rules.filter(F.length("keyword") > 0)
        size = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("keyword")).alias("bytes")).first()
        if size["n"] > PATTERN_ROWS or (size["bytes"] or 0) > PATTERN_BYTES:
            raise ValueError(f"a rule table holds {PATTERN_ROWS} rules and {PATTERN_BYTES} bytes of words at most")
        table = sorted(rows.select("position", "category", "keyword", "excluded").distinct().collect(), key=lambda r: (r["position"], r["category"], r["keyword"]))
        self.names = list(dict.fromkeys(r["category"] for r in table))
        number = {c: i for i, c in enumerate(self.names)}
        uses: dict[str, dict[tuple[int, bool], int]] = {}  # word -> (category, excluded) -> place in the table
        for place, r in enumerate(table):
            uses.setdefault(r["keyword"], {}).setdefault((number[r["category"]], bool(r["excluded"])), place)
        self.finder = Finder(rules.sparkSession, list(uses), [[(*use, place) for use, place in u.items()] for u in uses.values()])

    def _counted(self):
        names = self.names

        def count(hits: set[int], words: list[str], uses: list) -> dict[int, list[str]]:
            found: dict[int, list[tuple[int, str]]] = {}
            stopped = set()
            for n in hits:
                for category, excluded, place in uses[n]:
                    if excluded:
                        stopped.add(category)
                    else:
                        found.setdefault(category, []).append((place, words[n]))
            return {c: [w for _, w in sorted(held)] for c, held in found.items() if c not in stopped}
        return names, count

    def terms(self) -> Callable[[Column], Column]:
        """The keywords in a text, in rule order."""
        return self.finder.column("array<string>", lambda hits, words, uses: [words[n] for n in sorted(hits) if any(not excluded for _, excluded, _ in uses[n])])

    def categories(self) -> Callable[[Column], Column]:
        """The categories of a text, in rule order."""
        names, count = self._counted()
        return self.finder.column("array<string>", lambda hits, words, uses: [names[c] for c in sorted(count(hits, words, uses))])

    def matches(self) -> Callable[[Column], Column]:
        """(category, score, reason) of a text, best score first, then rule order; the score is the number of keywords that occur."""
        names, count = self._counted()
        hit = R.REASON_HIT

        def ranked(hits: set[int], words: list[str], uses: list) -> list[dict]:
            found = sorted(count(hits, words, uses).items(), key=lambda x: (-len(x[1]), x[0]))
            return [{"category": names[c], "score": len(w), "reason": "; ".join(hit + x for x in w)} for c, w in found]
        return self.finder.column("array<struct<category: string, score: int, reason: string>>", ranked)
