"""Predicates, rule matching and the filter cascade. Short word lists become per-row expressions; rules that
come as a table (a DataFrame of any length up to a bound) are found by an automaton. No join or shuffle is needed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidweave import rules
from bidweave.functions.html import drop_scripts, segment_intent, strip_tags
from bidweave.functions.text import (blank_to_null, clean_text, col, contained_words, contains_any, count_contained, filled,
                                     first_contained, let, text_truthy, trim_blanks)
from bidweave.functions.names import has_budget_between
from bidweave.operators.keys import once, top_k
from bidweave.operators.tables import add_matches
from bidweave.operators.textjoin import RuleTable


def is_meaningful(c: Column | str, low: int = 100) -> Column:
    """Long enough, and more than the bare announcement of a notice."""
    text = F.coalesce(col(c), F.lit(""))
    bare = F.contains(text, F.lit("招标公告")) & ~F.contains(text, F.lit("采购"))
    return (F.length(text) >= low) & ~bare


def is_service(title: Column | str, content: Column | str, title_words: Sequence[str] = tuple(rules.SERVICE_TITLE_WORDS),
               content_words: Sequence[str] = tuple(rules.SERVICE_CONTENT_WORDS)) -> Column:
    """A service rather than goods, by title word or content word."""
    return contains_any(title, title_words) | contains_any(content, content_words)


def excluded_by(c: Column | str, words: Sequence[str] | RuleTable = tuple(rules.EXCLUDE_WORDS)) -> Column:
    """The first excluding word, null when none occurs. Of a rule table all keywords count."""
    return words.finder.first()(col(c)) if isinstance(words, RuleTable) else first_contained(c, words)


def match_categories(c: Column | str, category_rules: dict | RuleTable = rules.CATEGORY_RULES) -> Column:
    """Array of (category, score, reason), best score first, then rule order.

    A category is skipped when one of its excluding words occurs; the score is the number of
    its keywords that occur.
    """
    if isinstance(category_rules, RuleTable):
        return category_rules.matches()(F.coalesce(col(c), F.lit("")))
    hits = []
    for i, (name, rule) in enumerate(category_rules.items()):
        words = contained_words(c, rule["keywords"])
        reason = F.array_join(F.transform(words, lambda w: F.concat(F.lit(rules.REASON_HIT), w)), "; ")
        one = F.struct((-F.size(words)).alias("_neg"), F.lit(i).alias("_at"), F.lit(name).alias("category"),
                       F.size(words).alias("score"), reason.alias("reason"))
        hits.append(F.when((F.size(words) > 0) & ~contains_any(c, rule.get("exclude", [])), one))
    ranked = F.sort_array(F.array_compact(F.array(*hits)))
    return F.transform(ranked, lambda m: F.struct(m["category"].alias("category"), m["score"].alias("score"),
                                                  m["reason"].alias("reason")))


def filter_records(df: DataFrame, title: str = "project_name", content: str = "content",
                   category_rules: dict | RuleTable = rules.CATEGORY_RULES, exclude: Sequence[str] | RuleTable = tuple(rules.EXCLUDE_WORDS),
                   title_words: Sequence[str] = tuple(rules.SERVICE_TITLE_WORDS),
                   content_words: Sequence[str] = tuple(rules.SERVICE_CONTENT_WORDS)) -> DataFrame:
    """Adds keep, reason and categories. Steps, first failure decides: no real content, a
    service, an excluding word, no category. Texts are used whole."""
    both = F.concat(F.coalesce(F.col(title), F.lit("")), F.lit(" "), F.coalesce(F.col(content), F.lit("")))
    matches = match_categories(both, category_rules)
    out = df.withColumn("_word", excluded_by(both, exclude))
    stop = (F.when(~is_meaningful(content), F.lit(rules.REASON_EMPTY))
            .when(is_service(title, content, title_words, content_words), F.lit(rules.REASON_SERVICE))
            .when(F.col("_word").isNotNull(), F.concat(F.lit(rules.REASON_EXCLUDED), F.col("_word"))))
    # the costly step runs only for rows that pass the cheap ones
    out = out.withColumn("_stop", stop).withColumn("_matches", F.when(F.col("_stop").isNull(), matches))
    text = F.array_join(F.transform("_matches", lambda m: F.concat(
        m["category"], F.lit("("), m["score"].cast("string"), F.lit("分:"), m["reason"], F.lit(")"))), "; ")
    kept = F.coalesce(F.size("_matches") > 0, F.lit(False))
    reason = F.coalesce(F.col("_stop"), F.when(kept, text).otherwise(F.lit(rules.REASON_NO_MATCH)))
    empty = F.array().cast("array<string>")
    return (out.withColumn("keep", kept).withColumn("reason", reason)
            .withColumn("categories", F.when(kept, F.transform("_matches", lambda m: m["category"])).otherwise(empty))
            .drop("_word", "_stop", "_matches"))


def rough_match(df: DataFrame, html: str = "html", terms: dict[str, Sequence[str]] | RuleTable = rules.ROUGH_TERMS,
                address: Sequence[str] = tuple(rules.ADDRESS_WORDS), footer: Sequence[str] = tuple(rules.FOOTER_WORDS),
                markers: Sequence[str] = tuple(rules.ROUGH_MARKERS), footer_chars: int = rules.FOOTER_CHARS) -> DataFrame:
    """Adds matched, matched_categories and matched_terms of a page.

    Title or body hit counts. Body parts (divided by full-width blanks) that look like an
    address and hold a term are ignored. A footer is a footer word and the `footer_chars` characters
    behind it; the text after that counts. Order is rule order.
    """
    title = F.trim(F.regexp_extract(html, r"<title>([^<]+)</title>", 1))
    # \s leaves the full-width blank alone, it divides the parts
    text = F.trim(F.regexp_replace(strip_tags(drop_scripts(html)), r"\s+", " "))
    body = let(text, lambda t: F.substring(t, F.coalesce(*[F.when(F.contains(t, F.lit(m)), F.instr(t, F.lit(m)))
                                                           for m in markers], F.lit(1)), F.length(t)))
    table = isinstance(terms, RuleTable)
    every = [] if table else list(dict.fromkeys(t for ts in terms.values() for t in ts))
    # in a part with an address word a term counts for nothing, so with a rule table such parts go as a whole
    held = (lambda line: F.lit(True)) if table else (lambda line: contains_any(line, every))
    parts = F.filter(F.split(body, "　"), lambda line: ~(contains_any(line, address) & held(line)))
    body = F.array_join(F.transform(parts, trim_blanks), " ")
    for word in footer:
        body = F.regexp_replace(body, f"{word.replace('.', chr(92) + '.')}[^\\n]{{0,{footer_chars}}}", "")
    out = df.withColumn("_title", title).withColumn("_body", body)
    if table:
        both = F.concat(F.coalesce("_title", F.lit("")), F.lit("\0"), F.coalesce("_body", F.lit("")))
        out = out.withColumn("matched_terms", terms.terms()(both)).withColumn("matched_categories", terms.categories()(both))
    else:
        out = out.withColumn("matched_terms", F.array_compact(F.array(*[
            F.when(F.contains("_title", F.lit(t)) | F.contains("_body", F.lit(t)), F.lit(t)) for t in every])))
        out = out.withColumn("matched_categories", F.array_compact(F.array(*[
            F.when(F.arrays_overlap("matched_terms", F.array(*[F.lit(t) for t in ts])), F.lit(name)) for name, ts in terms.items()])))
    return out.withColumn("matched", F.size("matched_terms") > 0).drop("_title", "_body")


def match_intent(df: DataFrame, title: str = "list_title", body: str = "detail_body_preview",
                 lines: dict[str, Sequence[str]] | RuleTable = rules.PRODUCT_LINES, min_chars: int = 50) -> DataFrame:
    """Rule form of the intent check: verdict, matched product lines and reason.

    Too little text is its own verdict; a text that names a product line and is not a service
    is a product purchase.
    """
    out = once(df, _body=segment_intent(body))
    both = F.concat_ws(" ", F.col(title), F.col("_body"))
    hits = (lines.categories()(both) if isinstance(lines, RuleTable) else
            F.array_compact(F.array(*[F.when(contains_any(both, words), F.lit(name)) for name, words in lines.items()])))
    out = once(out, _short=text_gate("_body", min_chars), _hits=hits)
    service = is_service(title, F.col("_body"))
    product = (F.size("_hits") > 0) & ~service
    verdict = (F.when(F.col("_short"), rules.VERDICT_MISSING).when(product, rules.VERDICT_PRODUCT)
               .otherwise(rules.VERDICT_OTHER))
    empty = F.array().cast("array<string>")
    return (out.withColumn("intent_verdict", verdict)
            .withColumn("matched_products", F.when(~F.col("_short") & product, F.col("_hits")).otherwise(empty))
            .withColumn("reason", F.when(F.col("_short"), F.format_string("正文太短(%d字)，无法判断", F.length("_body")))
                        .otherwise(F.array_join("matched_products", "; ")))
            .drop("_body", "_short", "_hits"))


def text_gate(c: Column | str, n: int = 50) -> Column:
    """True when a text is too short to judge."""
    return F.length(trim_blanks(F.coalesce(col(c), F.lit("")))) < n


def matches_filters(province: str | None = None, city: str | None = None, notice_type: str | None = None,
                    province_col: str = "province", city_col: str = "city",
                    type_cols: Sequence[str] = ("project_name", "announce_type")) -> Column:
    """Substring filters of a search; an absent filter accepts all."""
    conds = []
    if province:
        conds.append(F.contains(F.coalesce(F.col(province_col), F.lit("")), F.lit(province)))
    if city:
        conds.append(F.contains(F.coalesce(F.col(city_col), F.lit("")), F.lit(city)))
    if notice_type:
        conds.append(F.contains(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in type_cols]), F.lit(notice_type)))
    return add_matches(conds)


def list_tenders(df: DataFrame, keyword: str | None = None, announce_type: str | None = None,
                 province: str | None = None, city: str | None = None, min_budget: float | None = None,
                 max_budget: float | None = None, min_score: int | None = None, start_date=None, end_date=None,
                 keyword_cols: Sequence[str] = ("project_name", "buyer_name_std", "content_summary")) -> DataFrame:
    """Notice list with any combination of filters; absent ones cost nothing in the plan."""
    conds = []
    if keyword:
        hit = F.lit(False)
        for c in keyword_cols:
            hit = hit | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(keyword.lower()))
        conds.append(hit)
    for name, value in (("announce_type", announce_type), ("province", province), ("city", city)):
        if value:
            conds.append(F.col(name) == value)
    if min_budget is not None:
        conds.append(F.col("budget_amount") >= min_budget)
    if max_budget is not None:
        conds.append(F.col("budget_amount") <= max_budget)
    if min_score is not None:
        conds.append(F.col("opportunity_score") >= min_score)
    if start_date:
        conds.append(F.col("publish_date") >= F.lit(start_date))
    if end_date:
        conds.append(F.col("publish_date") <= F.lit(end_date))
    return df.filter(add_matches(conds))


def query_tenders(df: DataFrame, ids: DataFrame | None = None, keywords: Sequence[str] = (), key: str = "tender_id",
                  text_cols: Sequence[str] = ("project_name", "content_summary")) -> DataFrame:
    """Rows of an id list (a frame, so it may be long) that contain any of the keywords."""
    out = df.join(ids.select(key), key, "left_semi") if ids is not None else df
    if keywords:
        hit = F.lit(False)
        for c in text_cols:
            hit = hit | contains_any(F.lower(c), [k.lower() for k in keywords])
        out = out.filter(hit)
    return out


def post_filter(df: DataFrame, exclude_won: bool = False, min_score: float | None = None,
                min_budget: float | None = None, max_budget: float | None = None, city: str | None = None,
                budget: str = "total_budget", status: str = "status", score: str = "score",
                city_col: str = "city") -> DataFrame:
    """Filters on search results; budgets in 万元, a missing budget counts as 0."""
    conds = []
    if exclude_won:
        conds.append(F.coalesce(F.col(status), F.lit("")) != rules.STATUS_WON)
    if min_score is not None:
        conds.append(F.col(score) >= min_score)
    if min_budget is not None or max_budget is not None:
        conds.append(has_budget_between(budget, min_budget, max_budget))
    if city:
        conds.append(F.contains(F.coalesce(F.col(city_col), F.lit("")), F.lit(city)))
    return df.filter(add_matches(conds))


def table_pages(pages: DataFrame, doc: str = "doc_id", page: str = "page", text: str = "text",
                words: Sequence[str] = tuple(rules.TABLE_WORDS), need: int = 2, most: int = 10,
                fallback: int = 5) -> DataFrame:
    """Pages likely to hold a table: at least `need` words, the first `most` of a document;
    the first `fallback` pages where a document has none. A selection rule, not a row cap."""
    marked = pages.withColumn("_hit", count_contained(text, words) >= need)
    hits = top_k(marked.filter("_hit"), most, [F.col(page)], [doc])
    first = top_k(marked, fallback, [F.col(page)], [doc]).join(hits.select(doc).distinct(), doc, "left_anti")
    return hits.unionByName(first).drop("_hit")


def validate(df: DataFrame, version: str = rules.SCHEMA_VERSION, types: Sequence[str] = tuple(rules.ANNOUNCE_TYPES),
             required: Sequence[str] = tuple(rules.REQUIRED_FIELDS), requirement_types: Sequence[str] = tuple(rules.REQUIREMENT_TYPES)) -> DataFrame:
    """Adds `errors`, the broken rules of a structured record; quarantine with size(errors) > 0.
    Required fields are there and filled; a record with requirement_chunks has known types and texts in them."""
    score = F.col("opportunity_score")
    checks = [(~filled(F.col(c), df.schema[c].dataType) if c in df.columns else F.lit(True), f"missing:{c}") for c in required]
    if "requirement_chunks" in df.columns:
        broken = F.exists("requirement_chunks", lambda r: ~F.coalesce(r["type"].isin(*requirement_types), F.lit(False)) | ~text_truthy(r["text"]))
        checks.append((F.coalesce(broken, F.lit(False)), "requirement_chunks"))
    checks += [
        (F.coalesce(F.exists("product_keywords", lambda k: k.isNull()), F.lit(True)), "product_keywords"),
        (~F.coalesce(F.col("announce_type").isin(*types), F.lit(True)), "announce_type"),
        (F.coalesce(F.col("budget_amount") < 0, F.lit(False)), "budget_amount"),
        (F.coalesce((score < 0) | (score > 100) | (score != F.floor(score)), F.lit(False)), "opportunity_score"),
        (~F.col("schema_version").eqNullSafe(F.lit(version)), "schema_version"),
        (~text_truthy(F.col("extracted_at").cast("string")), "extracted_at"),
    ]
    return df.withColumn("errors", F.array_compact(F.array(*[F.when(bad, F.lit(msg)) for bad, msg in checks])))


def valid_vectors(df: DataFrame, dim: int, key: str = "id", vector: str = "embedding") -> DataFrame:
    return df.filter((F.size(vector) == dim) & F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
