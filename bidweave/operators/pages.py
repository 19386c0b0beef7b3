"""Rows out of pages: list items, links, attachments, detail records; crawl bookkeeping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidweave import rules
from bidweave.functions import html as H
from bidweave.functions.names import row_key
from bidweave.functions.text import clean_text, first_text, trim_blanks
from bidweave.functions.urls import (canonical_url, channel_url, drop_fragment, is_attachment, is_skipped_href,
                                     on_site, resolve_url, url_path, url_uuid)
from bidweave.operators.keys import one_per_key

ANCHOR = r"(?is)<a\b[^>]*href=[\"'][^\"']+[\"'][^>]*>.*?</a>"
HREF = r"(?is)<a\b[^>]*href=[\"']([^\"']+)[\"']"
INNER = r"(?is)^<a\b[^>]*>(.*?)</a>"
MARKDOWN = r"\[([^\]]{2,})\]\(([^)\s]+)(?:\s+\"[^\"]*\")?\)"


def list_items(pages: DataFrame, key: str, html: str = "html", host: str = r"http://www\.ccgp\.gov\.cn") -> DataFrame:
    """Items of a result list page: URL, title, date, buyer, agency, type and region."""
    at = F.instr(html, F.lit(rules.LIST_REGION_CLASS))
    rest = F.substring(F.col(html), at, F.length(html))
    # an unclosed list runs to the last character but one
    area = F.when(F.contains(rest, F.lit("</ul>")), F.substring_index(rest, "</ul>", 1)).otherwise(
        F.substring(rest, F.lit(1), F.length(rest) - 1))
    items = pages.filter(at > 0).select(
        key, F.posexplode(F.regexp_extract_all(area, F.lit(r"(?s)<li>(.*?)</li>"), F.lit(1))).alias("pos", "_li"))
    span = F.substring_index(F.substring_index(F.substring_index("_li", "</span>", 1), "<span", -1), "<strong", 1)
    cells = F.transform(F.split(F.regexp_replace(span, r"^[^>]*>", ""), r"[|\n<]"), trim_blanks)
    # type and region stand behind the first <strong>, divided by bars and line ends
    tail = F.split(F.regexp_replace(F.regexp_extract("_li", r"(?s)<strong[^>]*>(.*?)(?:</span>|\z)", 1), r"</strong>", "|"), r"[|\n<]")
    told = F.filter(F.transform(tail, trim_blanks), lambda x: x != "")

    def labelled(label: str):
        mine = F.filter("_cells", lambda x: F.rlike(x, F.lit(f"^{label}[：:]")))
        return F.coalesce(trim_blanks(F.regexp_replace(F.get(mine, F.lit(0)), f"^{label}[：:]", "")), F.lit(""))

    stamp = F.transform("_cells", lambda x: F.regexp_extract(x, r"\d{4}[./]\d{2}[./]\d{2}\s*\d{2}:\d{2}:\d{2}", 0))
    # anchors with the text that follows them
    anchors = F.regexp_extract_all("_li", F.lit(r"(?i)<a\s[^>]*>[^<\n]*(?:\n[^<\n]*)*"), F.lit(0))
    new_page = F.get(F.filter(anchors, lambda a: H.attribute(F.substring_index(a, ">", 1), "target") == "_blank"), F.lit(0))
    shown = F.substring_index(F.regexp_replace(F.substring_index(new_page, ">", -1), r"^\s+", ""), "\n", 1)
    linked = F.get(F.filter(F.transform(anchors, lambda a: H.attribute(F.substring_index(a, ">", 1), "href")), lambda u: F.rlike(u, F.lit(f"^{host}."))), F.lit(0))
    return (items.withColumns({"_cells": cells, "_told": told})
            .withColumn("list_url", F.trim(F.coalesce(linked, F.lit(""))))
            .filter(F.col("list_url") != "")
            .select(key, "pos", "list_url", trim_blanks(shown).alias("title"),
                    F.coalesce(F.get(F.filter(stamp, lambda x: x != ""), F.lit(0)), F.lit("")).alias("pub_date"),
                    labelled("采购人").alias("buyer"), labelled("代理机构").alias("agency"),
                    F.coalesce(F.get("_told", F.lit(0)), F.lit("")).alias("ann_type"),
                    F.coalesce(F.get("_told", F.lit(1)), F.lit("")).alias("region")))


def _first_per(entries, field: str):
    """Entries whose `field` no earlier entry of the array has."""
    known = F.transform(entries, lambda e: e[field])
    return F.filter(entries, lambda e, i: F.array_position(known, e[field]) == i + 1)


def _anchor_structs(html: str):
    found = F.regexp_extract_all(F.col(html), F.lit(ANCHOR), F.lit(0))
    return F.transform(found, lambda a: F.struct(F.trim(F.regexp_extract(a, HREF, 1)).alias("href"), F.regexp_extract(a, INNER, 1).alias("inner")))


def extract_links(pages: DataFrame, key: str, html: str = "html", url: str = "url", site: str | None = rules.NOTICE_HOST,
                  path: str | None = None, markdown: bool = True) -> DataFrame:
    """Links of a page as rows, first per target: Markdown links, then HTML anchors. Keeps links
    on the site (and below the path) with a real title. Targets lose their fragment. A page is one row,
    so nothing is shuffled."""
    entries = F.transform(_anchor_structs(html), lambda a: F.struct(clean_text(H.strip_tags(a["inner"])).alias("title"), a["href"].alias("href")))
    if markdown:
        found = F.regexp_extract_all(F.col(html), F.lit(MARKDOWN), F.lit(0))
        marks = F.transform(found, lambda m: F.struct(clean_text(F.regexp_extract(m, MARKDOWN, 1)).alias("title"),
                                                      F.regexp_extract(m, MARKDOWN, 2).alias("href")))
        entries = F.concat(marks, entries)
    entries = F.filter(entries, lambda e: F.coalesce(H.is_title_ok(e["title"]) & ~is_skipped_href(e["href"]), F.lit(False)))
    placed = F.transform(entries, lambda e: F.struct(e["title"].alias("title"), drop_fragment(resolve_url(e["href"], F.col(url))).alias("link")))
    if site:
        placed = F.filter(placed, lambda e: on_site(e["link"], site))
    if path:
        placed = F.filter(placed, lambda e: F.contains(url_path(e["link"]), F.lit(path)))
    placed = F.filter(placed, lambda e: e["link"].isNotNull())
    return pages.select(key, placed.alias("_l")).select(key, F.inline(_first_per(F.col("_l"), "link")))


def detail_urls(pages: DataFrame, key: str, html: str = "html", host: str = r"http://www\.ccgp\.gov\.cn/") -> DataFrame:
    """Distinct detail links of a list page that belong to a known channel."""
    found = F.array_distinct(F.regexp_extract_all(F.col(html), F.lit(f'href="({host}[^"]+)"'), F.lit(1)))
    return pages.select(key, F.explode(found).alias("detail_url")).filter(channel_url("detail_url"))


def extract_attachments(pages: DataFrame, key: str, html: str = "html", url: str = "url") -> DataFrame:
    """Attachment rows: download anchors with an id first, then anchors that look like a file;
    the first row per download link stays. A page is one row, so nothing is shuffled."""
    tags = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<a\b[^>]*>.*?</a>"), F.lit(0))

    def download(tag):
        uuid = F.regexp_extract(tag, r"(?is)^<a\b[^>]*id=[\"']([0-9A-Fa-f]+)[\"']", 1)
        css = F.regexp_extract(tag, r"(?is)^<a\b[^>]*class=[\"']([^\"']*)[\"']", 1)
        text = H.anchor_text(F.regexp_extract(tag, INNER, 1))
        return F.when(F.contains(css, F.lit("bizDownload")) & (uuid != ""), F.struct(
            first_text(text, uuid).alias("file_name"), F.concat(F.lit(rules.DOWNLOAD_URL), uuid).alias("download_url"), uuid.alias("uuid")))

    def plain(a):
        text = H.anchor_text(a["inner"])
        target = F.when(F.coalesce(F.trim(url), F.lit("")) == "", a["href"]).otherwise(resolve_url(a["href"], F.col(url)))
        base = F.substring_index(url_path(target), "/", -1)
        return F.when(F.coalesce(~is_skipped_href(a["href"]) & is_attachment(a["href"], text), F.lit(False)), F.struct(
            first_text(text, base, target).alias("file_name"), target.alias("download_url"), url_uuid(target).alias("uuid")))

    every = F.array_compact(F.concat(F.transform(tags, download), F.transform(_anchor_structs(html), plain)))
    every = F.filter(every, lambda e: e["download_url"].isNotNull())
    return pages.select(key, every.alias("_f")).select(key, F.inline(_first_per(F.col("_f"), "download_url")))


def parse_pages(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Detail record of each page: canonical URL, title, time, type, budget text, content."""
    return (pages.withColumn("title", H.page_title(html))
            .select(canonical_url(url).alias("url"), "title", H.iso(H.publish_time(html)).alias("publish_date"),
                    H.announce_type("title", html).alias("announce_type"), H.budget_raw(html).alias("budget"),
                    H.content_region(html).alias("content")))


def parse_reader(pages: DataFrame, text: str = "text", url: str = "url") -> DataFrame:
    """Detail record of pages that come as reader text."""
    return (pages.withColumn("title", H.reader_title(text))
            .select(canonical_url(url).alias("url"), "title", H.reader_time(H.reader_body(text)).alias("publish_date"),
                    H.title_type("title").alias("announce_type"),
                    H.budget_raw(H.reader_body(text), rules.READER_BUDGET_LABELS, rules.READER_BUDGET_UNIT).alias("budget"),
                    H.reader_text(text).alias("content")))


def detail_fields(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """Labelled fields, page type and body segment of a detail page."""
    return pages.select(key, clean_text(F.regexp_extract(html, r"<title>([^<]+)</title>", 1)).alias("title"),
                        *H.labelled_fields(html), H.page_type(html).alias("type"), H.segment_last(html).alias("body"))


def bind_list_detail(lists: DataFrame, details: DataFrame, url: str = "list_url", order: Sequence[str] = ()) -> DataFrame:
    """List rows with the fields of their (last) detail; a row whose detail failed stays, with the error text."""
    names = [c for c in details.columns if c not in (url, "error")]
    side = one_per_key(details, url, order).select(F.col(url), *[F.col(c).alias(f"detail_{c}") for c in names],
                          *([F.col("error").alias("detail_error")] if "error" in details.columns else []))
    joined = lists.join(side, [url], "left")
    return joined.select(*lists.columns, *[F.coalesce(F.col(f"detail_{c}").cast("string"), F.lit("")).alias(f"detail_{c}")
                                           for c in names + (["error"] if "error" in details.columns else [])])


def to_tenders(raw: DataFrame) -> DataFrame:
    """Raw crawl records to table rows: list value first, then detail value, else ''."""
    return raw.filter(F.coalesce("detail_url", F.lit("")) != "").select(
        row_key(canonical_url("detail_url")).alias("uuid"), "detail_url",
        first_text("list_title", "detail_title").alias("project_name"),
        first_text("list_pub_date", "detail_date").alias("publish_date"),
        first_text("detail_body_preview").alias("content"),
        first_text("list_buyer", "detail_buyer").alias("buyer_name"),
        first_text("list_agency", "detail_agency").alias("agency_name"),
        first_text("detail_amount").alias("budget"),
        first_text("list_region", "detail_region").alias("region"),
        first_text("list_ann_type", "detail_type").alias("ann_type"),
        F.coalesce(F.array_join("source_keywords", ","), F.lit("")).alias("source_keywords"),
        first_text("category").alias("category"), F.lit("new").alias("status"))


def crawl_plan(keywords: DataFrame, max_pages: int, keyword: str = "keyword",
               params: Sequence[tuple[str, str]] = tuple(rules.SEARCH_PARAMS), base: str = rules.SEARCH_URL) -> DataFrame:
    """One search URL per keyword and page."""
    rows = keywords.select(F.trim(keyword).alias("keyword")).filter(F.length("keyword") > 0).select(
        "keyword", F.explode(F.sequence(F.lit(1), F.lit(max_pages))).alias("page"))
    parts = []
    for name, value in params:
        v = {"{keyword}": F.url_encode("keyword"), "{page}": F.col("page").cast("string")}.get(
            value, F.url_encode(F.lit(value)))
        parts.append(F.concat(F.lit(f"{name}="), v))
    return rows.withColumn("url", F.concat(F.lit(base + "?"), F.concat_ws("&", *parts)))


def stop_at_repeat(rows: DataFrame, keyword: str = "keyword", page: str = "page", url: str = "url") -> DataFrame:
    """Rows of the pages before a keyword's first page that lists the same URLs as the page
    before it. Pages are compared as multisets, URL by URL, so no page is gathered."""
    here = rows.groupBy(keyword, page, url).agg(F.count("*").alias("n"))
    before = here.select(keyword, (F.col(page) + 1).alias(page), url, F.col("n").alias("n_before"))
    same = here.join(before, [keyword, page, url], "full").groupBy(keyword, page).agg(
        F.bool_and(F.col("n").eqNullSafe(F.col("n_before"))).alias("same"))
    stop = same.filter("same").groupBy(keyword).agg(F.min(page).alias("_stop"))
    return rows.join(stop, [keyword], "left").filter(
        F.col("_stop").isNull() | (F.col(page) < F.col("_stop"))).drop("_stop")


def drop_blocked_keywords(attempts: DataFrame, blocked, keyword: str = "keyword", most: int = 3) -> DataFrame:
    """All attempts of keywords with fewer than `most` blocked pages."""
    bad = attempts.groupBy(keyword).agg(F.count_if(blocked).alias("n")).filter(F.col("n") >= most).select(keyword)
    return attempts.join(bad, keyword, "left_anti")


def first_useful(attempts: DataFrame, methods: Sequence[str], url: str = "url", method: str = "method",
                 content: str = "content", success: str = "success", order: Sequence[str] = ()) -> DataFrame:
    """Per URL: content and method of the first method (in the given order) that succeeded with
    text, and how many attempts and failures there were. Null content when none did."""
    rank = F.lit(len(methods))
    for i, m in reversed(list(enumerate(methods))):
        rank = F.when(F.col(method) == m, F.lit(i)).otherwise(rank)
    useful = F.coalesce(F.col(success), F.lit(False)) & (F.coalesce(trim_blanks(content), F.lit("")) != "")
    best = F.min_by(F.struct(method, content), F.when(useful, F.struct(rank.alias("r"), *order)))
    return attempts.groupBy(url).agg(best.alias("_best"), F.count("*").alias("attempts"),
                                     F.count_if(~useful).alias("failures")).select(
        url, F.col(f"_best.{method}").alias(method), F.col(f"_best.{content}").alias(content), "attempts", "failures")


def attempt_log(attempts: DataFrame, useful_items: str = "item_count") -> DataFrame:
    """Attempt rows of the log: URL, method, success, item count, error."""
    return attempts.select("url", "method", "success", F.coalesce(F.col(useful_items), F.lit(0)).alias("item_count"), "error")
