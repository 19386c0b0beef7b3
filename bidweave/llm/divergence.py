"""Quality rules by distribution divergence (operator 2), DataFrame operations only.

Every text is compared with the reference of its language: the histogram of its character classes and that of
the language's common words are each held against the sums over all documents of the language, by
Jensen-Shannon distance (base 2, 0 to 1). Short texts have noisy histograms, so each distance counts only from
a minimum length on, and the word distance has a wider limit below `long_words` words, at most `short_reach` of what a text
without any common word reaches in the language. Common words are the most frequent words of up to four letters between blanks, so a script
without blanks has no word histogram: only its characters are compared. Every value of lang has its own reference, kept in a table with a row
per language. A language of fewer than `min_documents` documents would judge itself; it is held against the sums over all documents.
Basic rules come first: too few words, or too many words inside repeated five-word windows.

Windows are compared inside the row by 64-bit hashes of their words; nothing is exploded but the short words
that are counted for the references.

Defined results: a null text has no words and fails the basic rules, like an empty one. A null lang is a
language of its own. A null doc_id and repeated rows are rows like any other. Other columns are ignored. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidweave.llm.common import let, stored

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
BROADCAST_LANGS = 100_000  # rows of some 200 bytes; with more languages their table is joined like any other
# classes in the order in which they are taken out of the text; the last class is what is left
CLASSES = [("lower", "[a-z]+"), ("upper", "[A-Z]+"), ("digits", "[0-9]+"), ("symbols", f"{SYMBOLS}+"), ("signs", r"[!-/:-@\[-`{-~]+")]


def split_words(text: Column) -> Column:
    inner = F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")
    return F.when(F.length(inner) == 0, F.array().cast("array<string>")).otherwise(F.split(inner, f"{SPACE}+"))


def repeated_words(words: Column, size: int = 5) -> Column:
    """Number of words inside windows of `size` words that occur twice or more in the text."""
    def covered(windows: Column) -> Column:
        def flagged(pairs: Column) -> Column:
            twin = lambda e, k: F.coalesce(F.get(pairs, k - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(pairs, k + 1)["h"] == e["h"], F.lit(False))
            return F.array_sort(F.transform(F.filter(pairs, twin), lambda e: e["i"]))

        def total(places: Column) -> Column:
            step = F.transform(places, lambda p, k: F.least(F.lit(size), F.coalesce(F.get(places, k + 1) - p, F.lit(size))))
            return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)
        pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(let(pairs, flagged), total)

    def check(hashes: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(hashes) - size), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(size)]))
        return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(covered(w)))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < size, F.lit(0).cast("long")).otherwise(let(hashes, check))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts; 0 if one of them has no counts."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double"))

    def halves(a: Column, b: Column) -> Column:
        part = lambda x: F.when(x > 0, x * F.log2(2 * x / (a + b))).otherwise(0.0)
        return part(a) + part(b)
    n_p, n_q = total(p), total(q)
    terms = let(F.struct(n_p.alias("p"), n_q.alias("q")), lambda n: F.aggregate(
        F.zip_with(p, q, lambda a, b: halves(a / n["p"], b / n["q"])), F.lit(0.0), lambda s, v: s + v))
    return F.when((n_p > 0) & (n_q > 0), F.sqrt(F.greatest(F.lit(0.0), terms / 2))).otherwise(0.0)


def per_language(rows: DataFrame, table: DataFrame) -> DataFrame:
    """`rows` with the columns of `table`, which has one row per lang at most; null is a lang like any other."""
    table = table.withColumnRenamed("lang", "__lang")
    if table.count() <= BROADCAST_LANGS:
        table = F.broadcast(table)
    return rows.join(table, F.col("lang").eqNullSafe(F.col("__lang")), "left").drop("__lang")


def word_lists(docs: DataFrame, top: int = 10, min_documents: int = 20) -> DataFrame:
    """(lang, own, listed, counts): the `top` most frequent short words of each language, the most frequent first, and how often they
    occur in the documents that they stand for. own: the language has a reference of its own; else the words are those of all documents."""
    words = docs.select("lang", F.explode(split_words(F.coalesce("text", F.lit("")))).alias("word")).filter(
        (F.length("word") <= 4) & F.col("word").rlike(r"^\p{L}+$"))
    counts = stored(words.groupBy("lang", "word").agg(F.count("*").alias("n")), "counts")

    def lists(rows: DataFrame, key: list[str]) -> DataFrame:
        best = Window.partitionBy(*key).orderBy(F.desc("n"), "word")
        ranked = rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
        held = ranked.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("rank", "word", "n"))).alias("held"))  # `top` words at most
        return held.select(*key, F.col("held.word").alias("listed"), F.col("held.n").alias("counts"))
    # a language is a row here; the words of all documents are added up before they are ranked, one row per part of the words and then one
    spread = counts.groupBy("word").agg(F.sum("n").alias("n")).withColumn("part", F.pmod(F.xxhash64("word"), F.lit(64)))
    first = Window.partitionBy("part").orderBy(F.desc("n"), "word")
    every = lists(spread.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= top).drop("r", "part"), []).first()  # `top` words
    every = every.asDict() if every else {"listed": [], "counts": []}
    langs = docs.groupBy("lang").agg((F.count("*") >= min_documents).alias("own"))
    rows = per_language(langs, lists(counts, ["lang"]))

    def pick(name: str, kind: str) -> Column:
        own = F.coalesce(name, F.array().cast(kind))
        return F.when(F.col("own"), own).otherwise(F.array(*[F.lit(x) for x in every[name]]).cast(kind)).alias(name)
    return stored(rows.select("lang", "own", pick("listed", "array<string>"), pick("counts", "array<bigint>")), "words")


def measured(docs: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, lang, counts of the basic rules, classes, common): the numbers of each text."""
    rows = per_language(docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text")), words.select("lang", "listed"))
    rows = rows.withColumn("words", split_words(F.col("text"))).withColumn("left0", F.regexp_replace("text", f"{SPACE}+", ""))
    for k, (_, pattern) in enumerate(CLASSES):
        rows = rows.withColumn(f"left{k + 1}", F.regexp_replace(f"left{k}", pattern, ""))
    sizes = [F.char_length(f"left{k}").cast("long") for k in range(len(CLASSES) + 1)]
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(f"[^{SPACE[1:]}"))
    chosen = F.filter("words", lambda w: F.array_contains("listed", w))
    return rows.select(
        "doc_id", "lang", F.size("words").cast("long").alias("n_words"), sizes[0].alias("word_chars"),
        (sizes[3] - sizes[4]).alias("n_symbols"), let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.array(*[sizes[k] - sizes[k + 1] for k in range(len(CLASSES))], sizes[-1]).alias("classes"),
        let(chosen, lambda c: F.transform("listed", lambda r: F.size(F.filter(c, lambda w: w == r)).cast("long"))).alias("common"))


def references(rows: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, by_class, by_word): the sums over all documents of each language, or over all documents where the language has no
    reference of its own; the last of by_word is all other words."""
    width = len(CLASSES) + 1
    sums = [F.coalesce(F.sum(F.get("classes", F.lit(i))), F.lit(0)).alias(f"c{i}") for i in range(width)]
    by_lang = stored(rows.groupBy("lang").agg(*sums, F.sum("n_words").alias("n")), "sums")  # a row per language
    whole = by_lang.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in by_lang.columns if c != "lang"]).first()  # some numbers
    table = per_language(by_lang, words)
    of = lambda own, every: F.when(F.col("own"), own).otherwise(every)
    listed = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    return stored(table.select("lang", of(F.array(*[F.col(f"c{i}") for i in range(width)]), F.array(*[F.lit(whole[f"c{i}"]) for i in range(width)])).alias("by_class"),
                               F.concat("counts", F.array(of(F.col("n"), F.lit(whole["n"])) - listed)).alias("by_word")), "references")


def divergence_rules(docs: DataFrame, top: int = 10, min_words: int = 10, repeat_percent: int = 20, min_chars: int = 100,
                     max_class_distance: float = 0.35, short_words: int = 25, long_words: int = 100, max_word_distance: float = 0.25,
                     max_short_distance: float = 0.40, short_reach: float = 0.95, min_documents: int = 20) -> DataFrame:
    """Per row: (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)."""
    words = word_lists(docs, top, min_documents)
    rows = stored(measured(docs, words), "measured")
    rows = per_language(rows, references(rows, words))
    rows = rows.withColumn("class_distance", distance(F.col("classes"), F.col("by_class")))
    counted = F.concat("common", F.array(F.col("n_words") - F.aggregate("common", F.lit(0).cast("long"), lambda a, x: a + x)))
    rows = rows.withColumn("word_distance", distance(counted, F.col("by_word")))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    without = F.transform("by_word", lambda _, i: F.when(i == F.size("by_word") - 1, 1).otherwise(0).cast("long"))
    short_limit = F.least(F.lit(max_short_distance), short_reach * distance(without, F.col("by_word")))
    limit = F.when(F.col("n_words") >= long_words, max_word_distance).otherwise(short_limit)
    strange = (((F.col("word_chars") >= min_chars) & (F.col("class_distance") > max_class_distance))
               | ((F.col("n_words") >= short_words) & (F.col("word_distance") > limit)))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       failed.alias("base_failed"), (~failed & ~strange).alias("kept"))


SQL = r"""
WITH docs AS (SELECT doc_id, CASE WHEN count(*) OVER (PARTITION BY lang) >= 20 THEN coalesce(lang, chr(1)) ELSE chr(2) END AS lang,
    coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, lang, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM docs),
pos AS (SELECT doc_id, lang, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
every AS (SELECT lang, word FROM pos WHERE lang <> chr(2) UNION ALL SELECT chr(2), word FROM pos),
top AS (SELECT lang, word FROM (
  SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS r FROM every
  WHERE length(word) <= 4 AND regexp_full_match(word, '\p{L}+') GROUP BY lang, word) WHERE r <= 10),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, key) AS c FROM (
  SELECT doc_id, i, concat_ws(' ', word, lead(word, 1) OVER d, lead(word, 2) OVER d, lead(word, 3) OVER d, lead(word, 4) OVER d) AS key,
    lead(word, 4) OVER d AS fifth FROM pos WINDOW d AS (PARTITION BY doc_id ORDER BY i)) WHERE fifth IS NOT NULL),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM win, range(5) AS r(k) WHERE c > 1 GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
cls AS (SELECT doc_id, lang, length(t) AS n, [length(regexp_replace(t, '[^a-z]', '', 'g')), length(regexp_replace(t, '[^A-Z]', '', 'g')),
    length(regexp_replace(t, '[^0-9]', '', 'g')), length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')),
    length(regexp_replace(t, '[a-zA-Z0-9#*$%&|<>]|[^!-~]', '', 'g')), length(regexp_replace(t, '[!-~]', '', 'g'))] AS v
  FROM (SELECT doc_id, lang, regexp_replace(text, '[\x20\x09-\x0D]', '', 'g') AS t FROM docs)),
cflat AS (SELECT doc_id, lang, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM cls),
wflat AS (SELECT doc_id, lang, k, sum(x) AS x FROM (
    SELECT p.doc_id, p.lang, coalesce(t.word, '') AS k, 1 AS x FROM pos p LEFT JOIN top t ON p.lang = t.lang AND p.word = t.word
    UNION ALL SELECT d.doc_id, d.lang, t.word, 0 FROM docs d JOIN top t ON d.lang = t.lang
    UNION ALL SELECT doc_id, lang, '', 0 FROM docs) GROUP BY ALL),
cp AS (SELECT doc_id, lang, CAST(k AS VARCHAR) AS k, x / nullif(sum(x) OVER (PARTITION BY doc_id), 0) AS p FROM cflat),
cq AS (SELECT lang, CAST(k AS VARCHAR) AS k, sum(x) / nullif(sum(sum(x)) OVER (PARTITION BY lang), 0) AS q
  FROM (SELECT lang, k, x FROM cflat WHERE lang <> chr(2) UNION ALL SELECT chr(2), k, x FROM cflat) GROUP BY lang, k),
wp AS (SELECT doc_id, lang, k, x / nullif(sum(x) OVER (PARTITION BY doc_id), 0) AS p FROM wflat),
wq AS (SELECT lang, k, sum(x) / nullif(sum(sum(x)) OVER (PARTITION BY lang), 0) AS q
  FROM (SELECT e.lang, coalesce(t.word, '') AS k, count(*) AS x FROM every e LEFT JOIN top t ON e.lang = t.lang AND e.word = t.word GROUP BY ALL) GROUP BY lang, k),
lim AS (SELECT lang, least(0.40, 0.95 * sqrt(greatest(0, sum(CASE WHEN k <> '' THEN q ELSE log2(2 / (1 + q)) + q * log2(2 * q / (1 + q)) END) / 2))) AS d FROM wq GROUP BY lang),
js AS (SELECT kind, doc_id, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END
    + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS d
  FROM (SELECT 'c' AS kind, doc_id, p, q FROM cp JOIN cq USING (lang, k) UNION ALL SELECT 'w', doc_id, p, q FROM wp JOIN wq USING (lang, k))
  GROUP BY kind, doc_id),
base AS (SELECT w.doc_id, lim.d AS short_limit, CAST(len(words) AS BIGINT) AS n_words, CAST(cls.n AS BIGINT) AS word_chars, CAST(cls.v[4] AS BIGINT) AS n_symbols,
    CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    coalesce(jc.d, 0) AS dc, coalesce(jw.d, 0) AS dw
  FROM w JOIN cls USING (doc_id) LEFT JOIN lim ON lim.lang = w.lang LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)
  LEFT JOIN js jc ON jc.doc_id = w.doc_id AND jc.kind = 'c' LEFT JOIN js jw ON jw.doc_id = w.doc_id AND jw.kind = 'w'),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (word_chars >= 100 AND dc > 0.35)
    AND NOT (n_words >= 25 AND dw > CASE WHEN n_words >= 100 THEN 0.25 ELSE short_limit END) AS kept
FROM judged"""
