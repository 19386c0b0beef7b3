"""URL expressions. Regex based, so a malformed URL yields a value instead of an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bidweave import rules
from bidweave.functions.text import blank_to_null, col, contains_any, let, trim_blanks

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
_AFTER_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?"
_HOST = r"^(?:[^@]*@)?([^:@]*)"
_PORT = r":([0-9]+)$"


def url_scheme(u: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(u), _SCHEME, 1))


def url_authority(u: Column | str) -> Column:
    return F.regexp_extract(col(u), _AUTHORITY, 1)


def url_host(u: Column | str) -> Column:
    return F.lower(F.regexp_extract(url_authority(u), _HOST, 1))


def url_path(u: Column | str) -> Column:
    return F.regexp_extract(col(u), _AFTER_AUTHORITY + r"([^?#]*)", 1)


def url_query(u: Column | str) -> Column:
    return F.regexp_extract(col(u), r"^[^?#]*\?([^#]*)", 1)


def canonical_url(u: Column | str, site_aliases: dict[str, tuple[str, str]] = rules.SITE_ALIASES) -> Column:
    """One spelling per page: lower-case host, one scheme and host per known site, no
    fragment, no default port, no trailing slash. Text without a host stays as it is;
    a blank becomes null."""
    # the parts are computed once; named again and again they would be the text of one very large expression
    def parts(u: Column) -> Column:
        return let(url_authority(u), lambda authority: F.struct(
            u.alias("u"), F.lower(F.regexp_extract(authority, _HOST, 1)).alias("host"), F.regexp_extract(authority, _PORT, 1).alias("port"),
            url_scheme(u).alias("scheme"), F.regexp_replace(url_path(u), r";[^/]*$", "").alias("path"), url_query(u).alias("query")))

    def joined(p: Column) -> Column:
        host, port, path, query = p["host"], p["port"], p["path"], p["query"]
        site_scheme = F.when(p["scheme"] == "", F.lit("http")).otherwise(F.coalesce(p["scheme"], F.lit("http")))
        site_host = host
        for name, (to_scheme, to_host) in site_aliases.items():
            site_scheme = F.when(host == name, F.lit(to_scheme)).otherwise(site_scheme)
            site_host = F.when(host == name, F.lit(to_host)).otherwise(site_host)
        default_port = ((site_scheme == "http") & (port == "80")) | ((site_scheme == "https") & (port == "443"))
        netloc = F.concat(site_host, F.when((port == "") | default_port, F.lit("")).otherwise(F.concat(F.lit(":"), port)))
        path = F.when(path.isin("", "/"), F.lit("/")).otherwise(F.regexp_replace(path, "/+$", ""))
        full = F.concat(site_scheme, F.lit("://"), netloc, path, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))
        return F.when(host == "", p["u"]).otherwise(full)

    return let(let(let(trim_blanks(u), parts), joined), lambda v: F.when(v != "", v))


def _without_dots(path: Column) -> Column:
    """Resolve `.` and `..` segments of an absolute path."""
    parts = F.split(path, "/")
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1))))
        .when(s == ".", acc).otherwise(F.concat(acc, F.array(s))))
    ends_dir = F.element_at(parts, -1).isin(".", "..")
    return F.when(F.contains(path, F.lit("/.")),
                  F.concat(F.array_join(kept, "/"), F.when(ends_dir, F.lit("/")).otherwise(F.lit("")))).otherwise(path)


def is_skipped_href(href: Column | str) -> Column:
    h = F.coalesce(F.trim(col(href)), F.lit(""))
    return (h == "") | F.startswith(h, F.lit("javascript:")) | F.startswith(h, F.lit("mailto:")) | F.startswith(h, F.lit("#"))


def resolve_url(href: Column | str, base: Column | str) -> Column:
    """Absolute form of a link on page `base`; '' for script, mail and in-page links."""
    h, b = F.trim(col(href)), col(base)
    scheme, authority = url_scheme(b), url_authority(b)
    origin = F.concat(scheme, F.lit("://"), authority)
    path_only = F.regexp_extract(h, r"^([^?#]*)", 1)
    tail = F.regexp_replace(h, r"^[^?#]*", "")
    folder = F.regexp_replace(url_path(b), r"[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (F.when(is_skipped_href(h), F.lit(""))
            .when(F.regexp_extract(h, _SCHEME, 1) != "", h)
            .when(F.startswith(h, F.lit("//")), F.concat(scheme, F.lit(":"), h))
            .when(F.startswith(h, F.lit("?")), F.concat(origin, url_path(b), h))
            .when(F.startswith(h, F.lit("/")), F.concat(origin, _without_dots(path_only), tail))
            .otherwise(F.concat(origin, _without_dots(F.concat(folder, path_only)), tail)))


def drop_fragment(u: Column | str) -> Column:
    return F.regexp_replace(col(u), "#.*$", "")


def url_uuid(u: Column | str) -> Column:
    """The uuid parameter of a download link, null when absent."""
    return blank_to_null(F.regexp_extract(col(u), r"[?&]uuid=([0-9A-Fa-f]+)", 1))


def on_site(u: Column | str, site: str = rules.NOTICE_HOST) -> Column:
    return F.endswith(url_authority(u), F.lit(site))


def is_notice_url(u: Column | str, site: str = rules.NOTICE_HOST, path: str = rules.NOTICE_PATH) -> Column:
    return on_site(u, site) & F.contains(url_path(u), F.lit(path))


def is_attachment(href: Column | str, text: Column | str) -> Column:
    """A link that looks like a file: by extension of link or text, or by a known download path."""
    ends = "(?i)(?:" + "|".join(e.replace(".", r"\.") for e in rules.ATTACHMENT_EXTENSIONS) + ")$"
    known = "(?i)" + "|".join(rules.ATTACHMENT_URL_PATTERNS)
    text = F.coalesce(col(text), F.lit(""))
    return F.rlike(col(href), F.lit(ends)) | F.rlike(text, F.lit(ends)) | F.rlike(col(href), F.lit(known))


def safe_filename(name: Column | str, limit: int = 200) -> Column:
    """File name with unsafe characters replaced; over-long names keep their extension."""
    unsafe = rules.UNSAFE_FILE_CHARS
    clean = F.translate(col(name), unsafe, "_" * len(unsafe))
    ext = file_extension(clean)
    cut = F.concat(F.substring(clean, F.lit(1), F.lit(limit) - F.length(ext)), ext)
    return trim_blanks(F.when(F.length(clean) > limit, cut).otherwise(clean))


def file_extension(name: Column | str) -> Column:
    return F.regexp_extract(col(name), r"[^.](\.[^./]*)$", 1)


def filename_from_url(u: Column | str) -> Column:
    last = F.substring_index(F.coalesce(F.try_url_decode(col(u)), col(u)), "/", -1)
    last = F.substring_index(last, "?", 1)
    uuid = F.regexp_extract(col(u), r"uuid=([0-9A-Fa-f]+)", 1)
    bare = (last == "") | (last == "download")
    name = F.when(bare & (uuid != ""), F.concat(F.lit("attachment_"), uuid, F.lit(".pdf"))).otherwise(last)
    return F.when(name == "", F.lit("unknown.pdf")).otherwise(safe_filename(name))


def storage_path(key: Column | str, name: Column | str, u: Column | str, root: str = "attachments") -> Column:
    """`root/key/name`; a very short name gets a hash of the URL so that it stays unique."""
    chosen = F.when(F.coalesce(col(name), F.lit("")) == "", filename_from_url(u)).otherwise(safe_filename(name))
    ext = file_extension(chosen)
    stem = F.substring(chosen, F.lit(1), F.length(chosen) - F.length(ext))
    unique = F.concat(stem, F.lit("_"), F.left(F.md5(col(u)), F.lit(8)), ext)
    return F.concat_ws("/", F.lit(root), col(key).cast("string"),
                       F.when(F.length(chosen) < 10, unique).otherwise(chosen))


def channel_url(u: Column | str) -> Column:
    return contains_any(u, rules.DETAIL_CHANNELS)
