"""Raw pages: titles, text, links, attachments, crawl bookkeeping."""

from pyspark.sql import functions as F

from bidweave.functions import html as H
from bidweave.functions.urls import filename_from_url, is_notice_url, resolve_url, storage_path, url_uuid
from bidweave.operators import pages as G
from bidweave.plans.registry import query

WS = r"[\s\x0B\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
UNESC = "replace(replace(replace(replace({0}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')"
TITLE = "trim(regexp_replace(" + UNESC.format(
    r"regexp_replace(coalesce(nullif(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), ''), regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '<[^>]+>', ' ', 'g')"
) + f", '{WS}', ' ', 'g'))"


def to_text(source: str) -> str:
    """SQL of fragment-to-text for pages whose leaked style rules are known to be absent."""
    x = f"regexp_replace({source}, '(?is)<style[^>]*>.*?</style>|<script[^>]*>.*?</script>', '', 'g')"
    x = f"regexp_replace({x}, '(?i)<(p|div|br|tr|li|h[1-6])[^>]*>', chr(10), 'g')"
    x = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    x = UNESC.format(x)
    x = rf"regexp_replace({x}, '[\t ]+', ' ', 'g')"
    x = rf"regexp_replace({x}, ' ?\n[ \n]*', chr(10), 'g')"
    return rf"regexp_replace({x}, '^[ \n]+|[ \n]+$', '', 'g')"


@query("page_title", f"SELECT page_id, {TITLE} AS title FROM pages")
def page_title(t):
    return t.pages.select("page_id", H.page_title("html").alias("title"))


@query("html_text", f"SELECT page_id, {to_text('html')} AS body FROM pages")
def html_text(t):
    return t.pages.select("page_id", H.html_to_text("html").alias("body"))


_P = r"array_to_string(regexp_extract_all(html, '(?is)<p(?:\s[^>]*)?>.*?</p>'), '')"


@query("content_region", f"SELECT page_id, {to_text(_P)} AS content FROM pages")
def content_region(t):
    return t.pages.select("page_id", H.content_region("html").alias("content"))


@query("content_regions", f"""SELECT page_id, CASE page_id % 5 WHEN 4 THEN {to_text(_P)} ELSE (CASE page_id % 5 WHEN 0 THEN 'notice ' WHEN 1 THEN 'detail ' WHEN 2 THEN 'old ' ELSE 'detail ' END)
  || page_id || chr(10) || 'inner' END AS content FROM pages""")
def content_regions(t):
    """Pages with each of the regions, with an empty notice area before a detail block, and without any."""
    block = lambda attribute, text: F.concat(F.lit(f"<div {attribute}>{text} "), F.col("page_id").cast("string"), F.lit("<div>inner</div></div>"))
    notice, detail, old = block('id="noticeArea"', "notice"), block('class="a vF_detail_content"', "detail"), block('class="detail_content"', "old")
    empty = F.lit('<div id="noticeArea"><style>p{}</style> </div>')
    page = F.col("html")
    for k, parts in enumerate(([old, detail, notice], [old, detail], [old], [empty, detail])):
        page = F.when(F.col("page_id") % 5 == k, F.concat(*parts, F.col("html"))).otherwise(page)
    return t.pages.select("page_id", H.content_region(page).alias("content"))


@query("detail_urls", """SELECT page_id, 'http://www.example.com/' || c || '/' || page_id || '.htm' AS detail_url FROM pages, (VALUES ('cggg'), ('zxgg')) AS v(c)
  WHERE c = 'cggg' OR page_id % 3 = 0""")
def detail_urls(t):
    """List pages with a repeated detail link, one of another channel, one of an unknown channel and one of another host."""
    link = lambda host, channel: F.concat(F.lit(f'<a href="http://{host}/{channel}/'), F.col("page_id").cast("string"), F.lit('.htm">x</a>'))
    here = "www.example.com"
    second = F.when(F.col("page_id") % 3 == 0, link(here, "zxgg")).otherwise(F.lit(""))
    page = F.concat("html", link(here, "cggg"), second, link(here, "cggg"), link(here, "news"), link("other.example.com", "cggg"))
    return G.detail_urls(t.pages.select("page_id", page.alias("html")), "page_id", host=r"http://www\.example\.com/")


@query("page_records", f"SELECT page_id, {TITLE} AS title, {to_text(_P)} AS content FROM pages")
def page_records(t):
    return (G.parse_pages(t.pages.withColumn("url", F.concat(F.lit("http://p/"), F.col("page_id").cast("string"))))
            .select(F.substring("url", 10, 30).cast("long").alias("page_id"), "title", "content"))


LINKS = rf"""a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*href=["'']([^"'']+)["''][^>]*>(.*?)</a>', 1)) AS href,
    unnest(regexp_extract_all(html, '(?is)<a\b[^>]*href=["'']([^"'']+)["''][^>]*>(.*?)</a>', 2)) AS inner_html,
    generate_subscripts(regexp_extract_all(html, '(?is)<a\b[^>]*href=["'']([^"'']+)["''][^>]*>(.*?)</a>', 1), 1) AS pos FROM pages),
  links AS (SELECT page_id, trim(regexp_replace(regexp_replace(inner_html, '<[^>]+>', ' ', 'g'), '{WS}', ' ', 'g')) AS title,
    regexp_replace(regexp_extract(url, '^(https?://[^/?#]*)', 1) || trim(href), '#.*$', '') AS link, pos FROM a WHERE NOT starts_with(trim(href), '#'))"""


@query("page_links", f"""WITH {LINKS} SELECT page_id, title, link FROM links
  WHERE length(title) >= 2 AND NOT regexp_full_match(title, '[》"'')\\s]+') QUALIFY row_number() OVER (PARTITION BY page_id, link ORDER BY pos) = 1""")
def page_links(t):
    return G.extract_links(t.pages, "page_id", site=None)


@query("site_links", f"""WITH {LINKS} SELECT page_id, title, link FROM links
  WHERE length(title) >= 2 AND NOT regexp_full_match(title, '[》"'')\\s]+') AND ends_with(regexp_extract(link, '^https?://([^/?#]*)', 1), 'example.com')
    AND contains(regexp_extract(link, '^https?://[^/?#]*([^?#]*)', 1), '/th')
  QUALIFY row_number() OVER (PARTITION BY page_id, link ORDER BY pos) = 1""")
def site_links(t):
    return G.extract_links(t.pages, "page_id", site="example.com", path="/th")


@query("attachments", r"""WITH l AS (SELECT doc_id, 'file' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.html' ELSE '.DOCX' END AS f, source FROM documents)
  SELECT doc_id, 'spec' AS file_name, 'http://a.example.com/' || source || '/' || f AS download_url, CAST(NULL AS VARCHAR) AS uuid FROM l WHERE doc_id % 3 <> 1
  UNION ALL SELECT doc_id, 'all', 'https://download.ccgp.gov.cn/oss/download?uuid=AB' || doc_id, 'AB' || doc_id FROM l""")
def attachments(t):
    """Each document becomes a page with one relative link and one download anchor."""
    kind = F.when(F.col("doc_id") % 3 == 0, ".pdf").when(F.col("doc_id") % 3 == 1, ".html").otherwise(".DOCX")
    key = F.col("doc_id").cast("string")
    html = F.concat(F.lit('<a href="file'), key, kind, F.lit('">spec</a><p>'), "text", F.lit("</p><a class='bizDownload' href='' id='AB"),
                    key, F.lit("'>all</a>"))
    pages = t.documents.select("doc_id", html.alias("html"), F.concat(F.lit("http://a.example.com/"), "source", F.lit("/index.htm")).alias("url"))
    return G.extract_attachments(pages, "doc_id")


@query("list_items", """SELECT o_orderkey, 'http://www.ccgp.gov.cn/cggg/t' || o_orderkey || '.htm' AS list_url, o_orderpriority AS title,
  strftime(o_orderdate, '%Y.%m.%d %H:%M:%S') AS pub_date, c_name AS buyer, c_mktsegment AS agency, o_orderstatus AS ann_type, n_name AS region
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def list_items(t):
    """Each order becomes a one-item result list page."""
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    html = F.concat(F.lit('<ul class="vT-srch-result-list-bid"><li><a href="http://www.ccgp.gov.cn/cggg/t'), F.col("o_orderkey").cast("string"),
                    F.lit('.htm" target="_blank">\n '), "o_orderpriority", F.lit("</a><span>"), F.date_format("o_orderdate", "yyyy.MM.dd HH:mm:ss"),
                    F.lit(" | 采购人："), "c_name", F.lit(" | 代理机构："), "c_mktsegment", F.lit("<br><strong>"), "o_orderstatus",
                    F.lit("</strong> | "), "n_name", F.lit("</span></li></ul>"))
    items = G.list_items(rows.select("o_orderkey", html.alias("html")), "o_orderkey")
    return items.select("o_orderkey", "list_url", "title", "pub_date", "buyer", "agency", "ann_type", "region")


@query("detail_fields", """SELECT o_orderkey, o_orderpriority AS title, repeat(c_name || ' ', 9) || 'x' AS buyer, repeat(c_mktsegment || '-', 15) || 'x' AS agency,
  CAST(o_totalprice AS VARCHAR) || '元' AS amount, strftime(o_orderdate, '%Y-%m-%d') AS date, repeat(n_name || ' ', 8) || 'x' AS region, '公开招标' AS type
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def detail_fields(t):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    html = F.concat(F.lit("<title>"), "o_orderpriority", F.lit("</title><p>公开招标</p><p>采购单位："), F.repeat(F.concat("c_name", F.lit(" ")), F.lit(9)), F.lit("x</p><p>代理机构: "),
                    F.repeat(F.concat("c_mktsegment", F.lit("-")), F.lit(15)), F.lit("x"),
                    F.lit("</p><p>预算金额："), F.format_string("%.2f", "o_totalprice"), F.lit("元</p><p>发布日期："), F.date_format("o_orderdate", "yyyy-MM-dd"),
                    F.lit("</p><p>地区："), F.repeat(F.concat("n_name", F.lit(" ")), F.lit(8)), F.lit("x</p>"))
    fields = G.detail_fields(rows.select("o_orderkey", html.alias("html")), "o_orderkey")
    money = F.regexp_replace("amount", r"\.?0+元$", "元")
    whole = F.when(F.contains(money, F.lit(".")), money).otherwise(F.replace(money, F.lit("元"), F.lit(".0元")))
    return fields.select("o_orderkey", "title", "buyer", "agency", whole.alias("amount"), "date", "region", "type")


@query("publish_times", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT00:00:00') AS iso FROM orders""")
def publish_times(t):
    written = F.concat(F.lit("<p>发布时间："), F.date_format("o_orderdate", "yyyy年MM月dd日"), F.lit(" 00:00</p>"))
    meta = F.concat(F.lit('<meta name="PubDate" content="'), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm"), F.lit('">'))
    bare = F.concat(F.lit("<p>"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("</p>"))
    html = F.when(F.col("o_orderstatus") == "F", written).when(F.col("o_orderstatus") == "O", meta).otherwise(bare)
    return t.orders.select("o_orderkey", H.iso(H.publish_time(html)).alias("iso"))


@query("resolve_links", r"""SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) || '/x/y.html?z=1' AS up,
  regexp_extract(url, '^(https?):', 1) || '://h.example.com/a' AS other, regexp_extract(url, '^(https?://[^/?#]*)', 1) || '/b/c' AS root FROM pages""")
def resolve_links(t):
    base = F.col("url")
    return t.pages.select("page_id", resolve_url(F.lit("../../../x/./y.html?z=1"), base).alias("up"),
                          resolve_url(F.lit("//h.example.com/a"), base).alias("other"), resolve_url(F.lit("/b/q/../c"), base).alias("root"))


@query("url_names", """SELECT l_orderkey, l_linenumber, l_partkey, 'AB' || l_orderkey AS uuid, 'attachment_AB' || l_orderkey || '.pdf' AS file_name,
  'attachments/' || l_orderkey || '/a_b_' || substr(md5('http://x.example.com/download?uuid=AB' || l_orderkey), 1, 8) || '.pdf' AS path, l_linenumber % 2 = 0 AS notice
  FROM lineitem""")
def url_names(t):
    url = F.concat(F.lit("http://x.example.com/download?uuid=AB"), F.col("l_orderkey").cast("string"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", url_uuid(url).alias("uuid"), filename_from_url(url).alias("file_name"),
                             storage_path("l_orderkey", F.lit("a/b.pdf"), url).alias("path"),
                             is_notice_url(F.concat(F.when(F.col("l_linenumber") % 2 == 0, "http://www.ccgp.gov.cn/cggg/").otherwise("http://x.example.com/cggg/"),
                                                    F.col("l_orderkey").cast("string"))).alias("notice"))


@query("crawl_plan", """SELECT k.keyword, p.page, 'http://s.example.com/q?kw=' || replace(k.keyword, ' ', '+') || '&page_index=' || p.page AS url
  FROM (SELECT DISTINCT p_name AS keyword FROM part) k, (SELECT CAST(range AS INTEGER) AS page FROM range(1, 4)) p""")
def crawl_plan(t):
    words = t.part.select(F.col("p_name").alias("keyword")).distinct()
    return G.crawl_plan(words, 3, params=[("kw", "{keyword}"), ("page_index", "{page}")], base="http://s.example.com/q")


@query("first_useful", """WITH a AS (SELECT conv_id, turn, role, text, CASE role WHEN 'assistant' THEN 0 WHEN 'system' THEN 1 ELSE 2 END AS rk FROM conversations),
  b AS (SELECT conv_id, role AS method, text AS content FROM a WHERE turn > 0 AND trim(text) <> '' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY rk, turn) = 1)
  SELECT conv_id, max(method) AS method, max(content) AS content, count(*) AS attempts, count(*) FILTER (NOT (turn > 0 AND trim(text) <> '')) AS failures
  FROM a LEFT JOIN b USING (conv_id) GROUP BY 1""")
def first_useful(t):
    tries = t.conversations.select("conv_id", "turn", F.col("role").alias("method"), F.col("text").alias("content"), (F.col("turn") > 0).alias("success"))
    return G.first_useful(tries, ["assistant", "system", "user"], url="conv_id", order=["turn"])


@query("blocked_keywords", """SELECT event_id, user_id FROM events WHERE user_id IN
  (SELECT user_id FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'error') < 14)""")
def blocked_keywords(t):
    return G.drop_blocked_keywords(t.events, F.col("event_type") == "error", "user_id", 14).select("event_id", "user_id")


@query("bind_list_detail", """SELECT o_orderkey AS list_url, o_orderpriority AS list_title, CASE WHEN d.n IS NULL THEN '' ELSE CAST(d.n AS VARCHAR) END AS detail_amount,
  CASE WHEN d.n IS NULL THEN '' WHEN d.e THEN 'returned' ELSE '' END AS detail_error
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, bool_or(l_returnflag = 'R') AS e FROM lineitem GROUP BY 1) d ON o_orderkey = l_orderkey""")
def bind_list_detail(t):
    details = t.lineitem.groupBy(F.col("l_orderkey").alias("list_url")).agg(
        F.count("*").alias("amount"), F.when(F.bool_or(F.col("l_returnflag") == "R"), "returned").alias("error"))
    details = details.unionByName(details.withColumn("amount", F.col("amount") - 1))  # an older, smaller detail of each URL
    return G.bind_list_detail(t.orders.select(F.col("o_orderkey").alias("list_url"), F.col("o_orderpriority").alias("list_title")), details)


@query("to_tenders", """SELECT sha256('http://n.example.com/' || o_orderkey) AS uuid, 'http://n.example.com/' || o_orderkey AS detail_url,
  CASE o_orderstatus WHEN 'F' THEN o_orderpriority ELSE 'detail' END AS project_name, strftime(o_orderdate, '%Y-%m-%d') AS publish_date, 'body of ' || o_orderkey AS content,
  c_name AS buyer_name, c_mktsegment AS agency_name, CAST(o_custkey AS VARCHAR) AS budget, CASE o_orderstatus WHEN 'F' THEN n_name ELSE 'N' || n_nationkey END AS region,
  CASE o_orderstatus WHEN 'P' THEN '' ELSE o_orderstatus END AS ann_type, 'a,' || o_orderstatus AS source_keywords, 'k' || o_orderpriority AS category, 'new' AS status
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def to_tenders(t):
    """List value first, then detail value, else empty."""
    f, p, day = F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "P", F.date_format("o_orderdate", "yyyy-MM-dd")
    fields = {"list_pub_date": F.when(f, day), "detail_date": day, "list_agency": F.lit(""), "detail_agency": F.col("c_mktsegment"),
              "detail_amount": F.col("o_custkey").cast("string"), "list_region": F.when(f, F.col("n_name")).otherwise(""),
              "detail_region": F.concat(F.lit("N"), F.col("n_nationkey").cast("string")), "list_ann_type": F.when(~p, F.col("o_orderstatus")),
              "detail_type": F.lit(""), "category": F.concat(F.lit("k"), "o_orderpriority")}
    raw = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("http://n.example.com/"), F.col("o_orderkey").cast("string")).alias("detail_url"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).otherwise("").alias("list_title"), F.lit("detail").alias("detail_title"),
        F.lit(None).cast("string").alias("list_buyer"), F.col("c_name").alias("detail_buyer"),
        F.concat(F.lit("body of "), F.col("o_orderkey").cast("string")).alias("detail_body_preview"),
        F.array(F.lit("a"), F.col("o_orderstatus")).alias("source_keywords"), *[v.alias(c) for c, v in fields.items()])
    return G.to_tenders(raw)


@query("reader_pages", r"""SELECT o_orderkey, 'N' || o_orderkey || '招标公告' AS title, strftime(o_orderdate, '%Y-%m-%d') || ' 10:0' || (o_orderkey % 10) AS publish_date,
  '招标公告' AS announce_type, o_custkey || '.5万元' AS budget, '当前位置 招标公告' || chr(10) || 'N' || o_orderkey || '招标公告' || chr(10) || '发布时间：' || strftime(o_orderdate, '%Y年%-m月%-d日')
    || ' 10:0' || (o_orderkey % 10) || chr(10) || '预算金额：' || o_custkey || '.5万元' || chr(10) || o_orderpriority AS content FROM orders""")
def reader_pages(t):
    key = F.col("o_orderkey").cast("string")
    clock = F.concat(F.lit(" 10:0"), (F.col("o_orderkey") % 10).cast("string"))
    text = F.concat(F.lit("Title: converted content\nURL: u\nMarkdown Content:\n当前位置 招标公告\n\n# N"), key, F.lit("招标公告\n发布时间："),
                    F.date_format("o_orderdate", "yyyy年M月d日"), clock, F.lit("\n预算金额："), F.col("o_custkey").cast("string"), F.lit(".5万元\n  ## "),
                    "o_orderpriority")
    pages = t.orders.select(F.concat(F.lit("http://r/"), key).alias("url"), text.alias("text"))
    return G.parse_reader(pages).select(F.substring("url", 10, 20).cast("long").alias("o_orderkey"), "title", "publish_date", "announce_type", "budget", "content")


@query("reader_documents", r"""SELECT doc_id, 'N' || doc_id || '招标公告' AS title, '2024-03-05 10:07' AS publish_date, '招标公告' AS announce_type, '12.5万元' AS budget FROM documents""")
def reader_documents(t):
    key = F.col("doc_id").cast("string")
    text = F.concat(F.lit("Title: converted content\nURL: u\nMarkdown Content:\n当前位置 招标公告\nN"), key,
                    F.lit("招标公告\n发布时间：2024年3月5日 10:07\n预算金额：12.5万元\n"), F.regexp_replace("text", r"(?m)^\s*#", ""))
    pages = t.documents.select("doc_id", F.concat(F.lit("http://r/"), key).alias("url"), text.alias("text"))
    return G.parse_reader(pages).select(F.substring("url", 10, 20).cast("long").alias("doc_id"), "title", "publish_date", "announce_type", "budget")
