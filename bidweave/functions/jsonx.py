"""JSON expressions: model replies, broken items, arrays kept as text, metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bidweave import rules
from bidweave.functions.text import col


def reply_json(c: Column | str) -> Column:
    """Reasoning blocks removed, then first `{` to last `}`; null when there is none."""
    text = F.regexp_replace(col(c), r"(?s)<think>.*?</think>", "")
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def reply_to_struct(c: Column | str, schema: str) -> Column:
    return F.from_json(reply_json(c), schema)


def salvage_items(c: Column | str, schema: str) -> Column:
    """Flat `{...}` items of a broken reply, one by one; items that do not parse are skipped."""
    found = F.regexp_extract_all(col(c), F.lit(r"\{[^{}]*\}"), F.lit(0))
    good = F.filter(found, lambda x: F.try_parse_json(x).isNotNull())
    return F.transform(good, lambda x: F.from_json(x, schema))


def as_array(c: Column | str) -> Column:
    """Text that holds a JSON array becomes that array, any other text a one-item array."""
    text = col(c)
    parsed = F.from_json(text, "array<string>")
    single = F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array(text))
    return F.when(F.startswith(F.coalesce(text, F.lit("")), F.lit("[")), F.coalesce(parsed, single)).otherwise(single)


def attachment_urls(c: Column | str) -> Column:
    """JSON text with the download links of an attachment array."""
    links = F.transform(col(c), lambda a: F.coalesce(F.nullif(a["download_url"], F.lit("")), a["url"]))
    return F.coalesce(F.to_json(F.array_compact(links)), F.lit("[]"))


def attachment_count(c: Column | str) -> Column:
    return F.coalesce(F.json_array_length(col(c)), F.lit(0))


def nested_count(c: Column | str) -> Column:
    return F.coalesce(F.array_size(col(c)), F.lit(0))


def nested_sum(c: Column | str, field: str) -> Column:
    """Sum of a field over nested rows; values that are no number count as 0."""
    items = F.coalesce(F.transform(col(c), lambda x: F.coalesce(x[field].try_cast("double"), F.lit(0.0))),
                       F.array().cast("array<double>"))
    return F.aggregate(items, F.lit(0.0), lambda a, x: a + x)


def metadata_json(**fields: Column | str) -> Column:
    return F.to_json(F.struct(*[col(c).alias(name) for name, c in fields.items()]), {"ignoreNullFields": "false"})


def meta(c: Column | str, path: str) -> Column:
    return F.get_json_object(col(c), f"$.{path}")


def format_items(c: Column | str) -> Column:
    """Specification items as (name, need): need is `key: value; ...` over the filled keys."""
    def one(item: Column) -> Column:
        parts = [F.when(F.coalesce(item[k], F.lit("")) != "", F.concat(F.lit(f"{k}: "), item[k]))
                 for k in rules.SPEC_KEYS]
        return F.struct(F.coalesce(item[rules.SPEC_NAME], F.lit("")).alias("product_name"),
                        F.concat_ws("; ", *parts).alias("requirement"))
    return F.transform(col(c), one)


SPEC_SCHEMA = "struct<" + ",".join(f"`{k}`:string" for k in [rules.SPEC_NAME, *rules.SPEC_KEYS]) + ">"
