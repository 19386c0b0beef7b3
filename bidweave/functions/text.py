"""Text expressions: blanks, first matches, word lists, cuts and labels."""

from __future__ import annotations

from functools import reduce
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType

from bidweave import rules

# Unicode blanks: Java's \s knows only ASCII, crawled text has nbsp and full-width blanks.
BLANK = r"[\s\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value) with the value computed once per row, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_truthy(c: Column | str) -> Column:
    """Present and not the empty string."""
    return F.coalesce(col(c) != "", F.lit(False))


def number_truthy(c: Column | str) -> Column:
    """Present and not zero."""
    return F.coalesce(col(c) != 0, F.lit(False))


def array_truthy(c: Column | str) -> Column:
    """Present and not empty."""
    return F.coalesce(F.size(col(c)) > 0, F.lit(False))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(""))


def first_text(*cs: Column | str) -> Column:
    """First non-empty text, else ''."""
    return F.coalesce(*[blank_to_null(c) for c in cs], F.lit(""))


def trim_blanks(c: Column | str) -> Column:
    return F.regexp_replace(col(c), f"^{BLANK}+|{BLANK}+$", "")


def clean_text(c: Column | str) -> Column:
    """Every run of blanks becomes one space; ends are trimmed; null becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), f"{BLANK}+", " "))


def clean_lines(c: Column | str) -> Column:
    """Squeeze blanks inside each line and drop empty lines."""
    text = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\r\n?|[\x0B\f\u0085\u2028\u2029]", "\n")
    text = F.regexp_replace(text, r"[\t\u00A0\u1680\u2000-\u200A\u202F\u205F\u3000 ]+", " ")
    text = F.regexp_replace(text, r" ?\n[ \n]*", "\n")
    return F.regexp_replace(text, r"^[ \n]+|[ \n]+$", "")


def contains_any(c: Column | str, words: Sequence[str]) -> Column:
    """True when one of the words occurs; null text contains nothing."""
    text = F.coalesce(col(c), F.lit(""))
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words], F.lit(False))


def count_contained(c: Column | str, words: Sequence[str]) -> Column:
    """How many of the words occur (each counts once)."""
    text = F.coalesce(col(c), F.lit(""))
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(w)).cast("int") for w in words], F.lit(0))


def first_contained(c: Column | str, words: Sequence[str]) -> Column:
    """The first word of the list that occurs, else null."""
    text = F.coalesce(col(c), F.lit(""))
    return F.coalesce(*[F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in words], F.lit(None).cast("string"))


def contained_words(c: Column | str, words: Sequence[str]) -> Column:
    """All words of the list that occur, in list order."""
    text = F.coalesce(col(c), F.lit(""))
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in words]))


def classify_first(c: Column | str, type_rules: Sequence[tuple[str, Sequence[str]]], default: str = "") -> Column:
    """Label of the first rule with a contained word."""
    out = F.lit(default)
    for label, words in reversed(list(type_rules)):
        out = F.when(contains_any(c, words), F.lit(label)).otherwise(out)
    return out


def filled(c: Column, kind: DataType) -> Column:
    """Has a value: texts are not empty, values of other types not null."""
    return text_truthy(c) if isinstance(kind, StringType) else c.isNotNull()


def not_nan(c: Column | str) -> Column:
    """Filled, and not the literal text 'nan' that spreadsheet exports leave behind."""
    return F.coalesce(~col(c).isin("", "nan"), F.lit(False))


def nonblank(c: Column | str, placeholder: str = "None") -> Column:
    """Placeholder for a blank text, so an encoder never sees an empty input."""
    return F.when(F.coalesce(trim_blanks(c), F.lit("")) == "", F.lit(placeholder)).otherwise(col(c))


def truncate_middle(c: Column | str, limit: int = 15000, head: int = 10000, tail: int = 5000,
                    mark: str = rules.CUT_MARK) -> Column:
    """Keep both ends of an over-long text. For prompts only; jobs work on whole texts."""
    c = col(c)
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(head)), F.lit(mark), F.right(c, F.lit(tail)))).otherwise(c)


def shorten(c: Column | str, limit: int = 12000) -> Column:
    """Table-cell form of a text: LF line ends, cut with an ellipsis."""
    text = F.replace(col(c).cast("string"), F.lit("\r\n"), F.lit("\n"))
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit - 1)), F.lit("…"))).otherwise(text)


def shorten_binary(c: Column | str) -> Column:
    return F.when(col(c).isNotNull(), F.format_string("<binary %d bytes>", F.octet_length(col(c))))


def preview(c: Column | str, n: int = 200, dots: bool = False) -> Column:
    c = col(c)
    cut = F.left(c, F.lit(n))
    return F.when(F.length(c) > n, F.concat(cut, F.lit("..."))).otherwise(c) if dots else cut


def label(key: Column | str, name: Column | str, buyer: Column | str, n: int = 200) -> Column:
    """`#id name — buyer`, cut to n characters."""
    return F.left(
        F.concat(F.lit("#"), col(key).cast("string"), F.lit(" "), F.coalesce(col(name), F.lit("")),
                 F.lit(" — "), F.coalesce(col(buyer), F.lit(""))),
        F.lit(n))


def strip_markers(c: Column | str, after: Sequence[str] = tuple(rules.THOUGHT_MARKERS),
                  before: Sequence[str] = tuple(rules.INSTRUCTION_MARKERS)) -> Column:
    """Text after the last `after` marker and before the first `before` marker."""
    text = F.coalesce(col(c), F.lit(""))
    for marker in after:
        text = F.substring_index(text, marker, -1)
    for marker in before:
        text = F.substring_index(text, marker, 1)
    return trim_blanks(text)


def labelled(parts: Sequence[tuple[str, Column]], sep: str = " | ") -> Column:
    """`label: value` pieces joined by a separator; null values become ''."""
    return F.concat_ws(sep, *[F.concat(F.lit(f"{name}: "), F.coalesce(value, F.lit(""))) for name, value in parts])


def context_text(fields: Sequence[tuple[str, Column, str]]) -> Column:
    """`label：value` lines for a prompt; each field names its value for null."""
    lines = [F.concat(F.lit(f"{name}："), F.coalesce(value.cast("string"), F.lit(missing)))
             for name, value, missing in fields]
    return F.concat_ws("\n", *lines)


def project_context() -> Column:
    """Prompt context of a project row."""
    return context_text([
        ("项目名称", F.col("project_name_std"), ""), ("采购单位", F.col("buyer_name"), ""),
        ("预算金额", F.col("total_budget"), "未知"), ("内容摘要", F.col("content_summary"), "无"),
        ("技术要点", F.col("technical_requirements_summary"), "无"),
        ("应用场景", F.col("application_scenario"), "无"),
        ("产品关键词", F.array_join("product_keywords", ", "), ""),
    ])


def profile_context(n_keywords: int = 10) -> Column:
    """Prompt context of a customer summary row (the keyword list is short by design)."""
    return context_text([
        ("历史招标次数", F.col("tender_count"), "0"), ("平均机会评分", F.col("avg_opportunity_score"), "0"),
        ("核心技术偏好", F.array_join(F.slice("tech_keywords", 1, n_keywords), ", "), ""),
        ("历史中标单位", F.array_join("past_winners", ", "), ""),
        ("联系人", F.array_join("persons", ", "), ""),
    ])


def product_text(columns: Sequence[str], skip: Sequence[str] = ("embedding",)) -> Column:
    """All filled values of a product row joined by blanks (array columns are joined first)."""
    return F.concat_ws(" ", *[blank_to_null(F.col(c).cast("string")) for c in columns if c not in skip])


def tender_text() -> Column:
    """Five labelled parts of a structured notice, the text that is embedded."""
    return labelled([
        ("采购关键词", F.array_join("product_keywords", ", ")),
        ("应用场景", F.col("application_scenario")),
        ("技术要求摘要", F.col("technical_requirements_summary")),
        ("内容摘要", F.col("content_summary")),
        ("中标产品", F.array_join("winning_product", ", ")),
    ])


def search_text(scalars: Sequence[str], arrays: Sequence[str]) -> Column:
    """Keyword-search text: scalar fields, then array items, joined by blanks."""
    parts = [blank_to_null(F.col(c).cast("string")) for c in scalars]
    return F.concat_ws(" ", *parts, *[F.array_join(F.col(a), " ") for a in arrays])


def spec_text(arrays: Sequence[str] = ("product_names", "specifications", "technical_params")) -> Column:
    """Text of an attachment specification: array parts joined by ' | ', empty parts skipped."""
    return F.concat_ws(" | ", *[blank_to_null(F.array_join(F.col(a), " ")) for a in arrays])
