"""Chunk rows of notices and texts."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidweave import rules
from bidweave.functions.jsonx import metadata_json
from bidweave.functions.text import text_truthy

CHUNK_KIND = "attachment_content"
_EMPTY = "array<struct<type:string,text:string>>"


def field_chunks(structured: DataFrame, names: DataFrame | None = None, key: str = "tender_id") -> DataFrame:
    """Chunks of the fixed fields: title 1, summary 2, contacts 3, requirements from 4,
    attachment summary 99. `names` (key, project_name) supplies the titles."""
    df = structured
    if names is not None:
        df = df.drop("project_name").join(names.select(key, "project_name"), [key], "left")
    place = metadata_json(announce_type="announce_type", buyer_name_std="buyer_name_std", province="province", city="city")
    who = metadata_json(announce_type="announce_type", buyer_name_std="buyer_name_std")
    contacts = metadata_json(**{c: F.coalesce(F.to_json(c), F.lit("[]"))
                                for c in ("buyer_contacts", "agency_contacts", "project_contacts")})

    def chunk(kind: str, text: Column, order: Column, meta: Column) -> Column:
        return F.struct(F.lit(kind).alias("chunk_type"), text.alias("chunk_text"), order.cast("int").alias("chunk_order"),
                        meta.alias("metadata_json"))

    def single(kind: str, column: str, order: int, meta: Column, ok: Column | None = None) -> Column:
        good = text_truthy(column) if ok is None else text_truthy(column) & ok
        return F.when(good, chunk(kind, F.col(column), F.lit(order), meta))

    fixed = F.array(
        single("title", "project_name", 1, place), single("content_summary", "content_summary", 2, place),
        single("contact_chunk", "contact_chunk", 3, contacts),
        single("attachment_summary", "attachment_summary", 99, who, F.col("attachment_summary") != rules.NO_ATTACHMENT))
    reqs = F.transform(
        F.coalesce(F.col("requirement_chunks"), F.array().cast(_EMPTY)),
        lambda r, i: chunk("requirement_chunk", F.coalesce(r["text"], F.lit("")), i + 4,
                           metadata_json(requirement_type=r["type"], announce_type="announce_type",
                                         buyer_name_std="buyer_name_std")))
    return df.select(key, F.inline(F.concat(F.array_compact(fixed), reqs)))


# Where a chunk may end, best first: how far the end lies behind the sign, and the part of the size it must exceed.
_BOUNDARIES = [("\n\n", 3), ("\n", 2), ("。", 2), ("！", 2), ("？", 2), (".", 2), ("!", 2), ("?", 2)]


def _ends(text: str) -> list[tuple[list[int], int, int]]:
    """For each kind of boundary: places of its signs in order, their length, and the divisor of the size."""
    return [([m.start() for m in re.finditer(f"(?={re.escape(sign)})", text)], len(sign), part) for sign, part in _BOUNDARIES]


def _pieces(text: str, size: int, overlap: int) -> Iterator[str]:
    """Spans between boundaries. All boundaries are listed once; a chunk ends at the last one of the first
    kind that lies inside it and far enough in, else at its full size."""
    text = text.strip()
    listed = _ends(text) if len(text) > size else []
    start, whole = 0, len(text)
    while start < whole:
        end = start + size
        if start == 0 and whole <= size:
            end = whole
        elif end < whole:
            for places, width, part in listed:
                k = bisect_right(places, end - width) - 1
                if k >= 0 and places[k] - start > size // part:
                    end = places[k] + width
                    break
        if piece := text[start:end].strip():
            yield piece
        if whole <= size:
            return
        start = end - overlap


def chunk_text(df: DataFrame, key: str, text: str = "text", size: int = 1500, overlap: int = 150) -> DataFrame:
    """(key, chunk_order, chunk_text) of whole texts. Where a chunk ends decides where the next
    begins, so each text is walked in Python; texts arrive in Arrow batches and never shuffle."""
    if not 0 <= overlap < size // 3:
        raise ValueError("overlap must be below a third of the size")
    key_type = df.schema[key].dataType

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            rows, orders, out = [], [], []
            for i, value in enumerate(texts.to_pylist()):
                for n, piece in enumerate(_pieces(value or "", size, overlap), start=1):
                    rows.append(i)
                    orders.append(n)
                    out.append(piece)
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(rows, pa.int64())), pa.array(orders, pa.int32()), pa.array(out, pa.string())],
                names=["key", "chunk_order", "chunk_text"])

    schema = f"key {key_type.simpleString()}, chunk_order int, chunk_text string"
    return df.select(key, text).mapInArrow(walk, schema).withColumnRenamed("key", key)


def attachment_chunks(parsed: DataFrame, key: str = "tender_id", size: int = 1500, overlap: int = 150) -> DataFrame:
    """Chunk rows of parsed attachments with their metadata. Needs tender_id, file_name,
    source_path and text."""
    named = parsed.select(F.struct(F.col(key).cast("string").alias("id"), "file_name", "source_path").alias("_k"), "text")
    flat = named.withColumn("_key", F.to_json("_k"))
    rows = chunk_text(flat, "_key", "text", size, overlap)
    k = F.from_json("_key", "id string, file_name string, source_path string")
    return rows.withColumn("_k", k).select(
        F.col("_k.id").cast(parsed.schema[key].dataType).alias(key), F.lit(CHUNK_KIND).alias("chunk_type"), "chunk_text",
        "chunk_order", metadata_json(source_file=F.col("_k.file_name"), source_path=F.col("_k.source_path"),
                                     chunk_size=F.length("chunk_text")).alias("metadata_json"))
