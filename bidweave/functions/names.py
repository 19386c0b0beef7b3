"""Names, keys, money and scores."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from bidweave import rules
from bidweave.functions.text import col, contains_any, let, number_truthy, text_truthy, trim_blanks


def normalize_project_name(c: Column | str, suffixes: Sequence[str] = tuple(rules.NAME_SUFFIXES)) -> Column:
    """Strip announcement endings in list order, then bracketed parts, then blanks."""
    # one after another from the end: the first listed ending is the outermost
    endings = "".join(f"(?:{re.escape(s)})?" for s in reversed(list(suffixes))) + r"\z"
    name = F.regexp_replace(F.coalesce(col(c), F.lit("")), endings, "")
    return trim_blanks(F.regexp_replace(name, r"（.*?）|\(.*?\)", ""))


def standardize_org(c: Column | str) -> Column:
    """Organisation name without bracket notes."""
    return trim_blanks(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"（[^）]*）|\([^)]*\)", ""))


def parse_money(c: Column | str) -> Column:
    """Money text to yuan; null when no number is found. Knows 元, 万 and 亿, and thousands commas."""
    pattern = r"([0-9][0-9,，]*(?:\.[0-9]+)?)\s*(亿|万)?"
    digits = F.regexp_replace(F.regexp_extract(col(c), pattern, 1), "[,，]", "")
    unit = F.regexp_extract(col(c), pattern, 2)
    factor = F.when(unit == "亿", F.lit(100000000.0)).when(unit == "万", F.lit(10000.0)).otherwise(F.lit(1.0))
    return F.round(F.nullif(digits, F.lit("")).try_cast("double") * factor, 2)


def to_wan(c: Column | str) -> Column:
    """Yuan to 万元; missing counts as 0."""
    return F.coalesce(col(c), F.lit(0.0)) / F.lit(10000.0)


def two_digits(c: Column) -> Column:
    """Fixed two-digit text of a double. Exact as C's printf: Java rounds the shortest decimal
    form half up, so a value like 13.565 needs the sign of its binary remainder."""
    def exact(x: Column) -> Column:
        m = F.rint(x * 1000.0)
        near_tie = (m / 1000.0 == x) & (F.abs(m % 10) == 5)
        high = F.rint(x * 65536.0) / 65536.0
        rest = (high * 1000.0 - m) + (x - high) * 1000.0
        down, up = (m - 5.0) / 10.0, (m + 5.0) / 10.0
        even = F.when(down % 2 == 0, down).otherwise(up)
        tie = F.when(rest > 0, up).when(rest < 0, down).otherwise(even) / 100.0
        return F.format_string("%.2f", F.when(near_tie, tie).otherwise(x))
    return let(c, exact)


def budget_display(c: Column | str) -> Column:
    return F.when(number_truthy(c), F.concat(two_digits(col(c) / F.lit(10000.0)), F.lit("万元"))).otherwise(F.lit("未知"))


def tier(c: Column, bounds: Sequence[tuple], rest) -> Column:
    """Value of the first lower bound reached; bounds go from high to low."""
    out = F.lit(rest)
    for low, value in reversed(list(bounds)):
        out = F.when(c >= low, F.lit(value)).otherwise(out)
    return out


def _word_points(c: Column | str, points, rest) -> Column:
    out = F.lit(rest)
    for words, value in reversed(list(points)):
        out = F.when(contains_any(c, words), F.lit(value)).otherwise(out)
    return out


def opportunity_score(budget: Column | str, buyer: Column | str, method: Column | str,
                      fit: Column | str) -> Column:
    """Rule score 0-100: budget size + customer kind + competition + product fit (0, 10 or 20)."""
    total = (tier(F.coalesce(col(budget), F.lit(0.0)), rules.BUDGET_POINTS, rules.BUDGET_POINTS_REST)
             + _word_points(buyer, rules.CUSTOMER_POINTS, rules.CUSTOMER_POINTS_REST)
             + _word_points(method, rules.COMPETITION_POINTS, 0)
             + F.coalesce(col(fit), F.lit(0)))
    return F.least(F.lit(100), total).cast("int")


def opportunity_level(score: Column | str) -> Column:
    return tier(F.coalesce(col(score), F.lit(0)), [(80, "高"), (60, "中")], "低")


def budget_level(yuan: Column | str) -> Column:
    return tier(to_wan(yuan), [(500, "大额"), (100, "中等")], "小额")


def safe_float(c: Column | str) -> Column:
    return F.coalesce(col(c).try_cast("double"), F.lit(0.0))


def safe_str(c: Column | str) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit(""))


def yes_no(c: Column | str) -> Column:
    return F.coalesce(col(c) == rules.YES, F.lit(False))


def cache_key(*cs: Column | str) -> Column:
    """md5 over the parts; a missing part counts as ''."""
    return F.md5(F.concat_ws("|", *[safe_str(c) for c in cs]))


def row_key(c: Column | str) -> Column:
    """Stable row key of a canonical URL: the same URL always gets the same key."""
    return F.sha2(col(c), 256)


def customer_type_label(has_crm: Column | str, has_tender: Column | str) -> Column:
    return (F.when(col(has_crm) & ~col(has_tender), rules.TYPE_COMPANY)
            .when(col(has_tender), rules.TYPE_PUBLIC).otherwise(rules.TYPE_UNKNOWN))


def null_budget_if_won(budget: Column | str, is_win: Column | str) -> Column:
    """A winning notice carries no budget."""
    return F.when(col(is_win), F.lit(None)).otherwise(col(budget))


def fill_contacts(contacts: Column | str, org: Column | str) -> Column:
    """Contacts without a person name take the organisation name."""
    return F.transform(
        F.coalesce(col(contacts), F.array().cast("array<struct<name:string,phone:string>>")),
        lambda c: F.struct(F.coalesce(F.nullif(c["name"], F.lit("")), col(org)).alias("name"),
                           c["phone"].alias("phone")))


def main_contact(project: Column | str, agency: Column | str) -> Column:
    """First project contact, else first agency contact."""
    return F.coalesce(F.get(col(project), F.lit(0)), F.get(col(agency), F.lit(0)))


def _party(contacts: Column) -> Column:
    text = F.array_join(F.transform(contacts, lambda c: F.concat_ws(" ", c["name"], c["phone"])), "，")
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(rules.NO_CONTACT))


def contact_chunk(buyer: Column | str, agency: Column | str, project: Column | str) -> Column:
    """One text with the three parties; a missing party reads 无."""
    return F.concat(F.lit("采购单位："), _party(col(buyer)), F.lit("；代理机构："), _party(col(agency)),
                    F.lit("；项目联系人："), _party(col(project)))


def first_contact(contacts: Column | str, field: str) -> Column:
    return F.coalesce(F.get(col(contacts), F.lit(0))[field], F.lit(""))


def has_budget_between(yuan: Column | str, low: float | None, high: float | None) -> Column:
    """Budget within [low, high] in 万元; missing budget counts as 0."""
    wan = to_wan(yuan)
    ok = F.lit(True)
    if low is not None:
        ok = ok & (wan >= low)
    if high is not None:
        ok = ok & (wan <= high)
    return ok


def filled_name(c: Column | str) -> Column:
    """A usable group key: not empty and not the word for unknown."""
    return text_truthy(c) & ~col(c).isin(*rules.UNKNOWN_NAMES)
