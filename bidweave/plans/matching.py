"""Filters, categories and verdicts over documents and pages."""

from pyspark.sql import functions as F

from bidweave.operators import filters as L
from bidweave.operators import stats as S
from bidweave.operators.textjoin import RuleTable, rule_rows
from bidweave.plans.registry import query

# Word rules in the invented languages of the documents.
CATEGORIES = {
    "alpha": {"keywords": ["thanedble", "thintion", "theaeati"], "exclude": ["worthless"]},
    "beta": {"keywords": ["étion", "queque", "outre"], "exclude": ["disgusting"]},
    "gamma": {"keywords": ["einheit", "schkeit", "unglich"], "exclude": []},
    "delta": {"keywords": ["ciónción", "ciónado"], "exclude": ["pathetic"]},
}
EXCLUDE = ["password", "token = ", "ofonrereer"]
TITLE_SERVICE = ["src3", "src17"]
CONTENT_SERVICE = ["bleist", "theanble"]
TERMS = {"alpha": ["thanedble", "thintion"], "beta": ["étion", "outre"], "gamma": ["einheit"]}
LINES = {"one": ["thanedble", "thintion"], "two": ["étion", "queque"], "three": ["einheit", "schkeit"]}


def _any(col, words):
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")" if words else "false"


def _hits(col, words):
    return "list_filter([" + ", ".join(f"'{w}'" for w in words) + f"], lambda w: contains({col}, w))"


def _cats():
    out = []
    for i, (name, rule) in enumerate(CATEGORIES.items()):
        hits = _hits("body", rule["keywords"])
        out.append(f"SELECT doc_id, '{name}' AS category, {i} AS pos, len({hits}) AS score, "
                   f"list_aggregate(list_transform({hits}, lambda w: '命中:' || w), 'string_agg', '; ') AS reason "
                   f"FROM d WHERE len({hits}) > 0 AND NOT {_any('body', rule['exclude'])}")
    return " UNION ALL ".join(out)


DOCS = "d AS (SELECT doc_id, source, text, coalesce(source, '') || ' ' || coalesce(text, '') AS body FROM documents)"
CATS = f"{DOCS}, cats AS ({_cats()})"
_FIRST = "CASE " + " ".join(f"WHEN contains(body, '{w}') THEN '{w}'" for w in EXCLUDE) + " END"
CASCADE = f"""{CATS}, best AS (
  SELECT doc_id, string_agg(category || '(' || score || '分:' || reason || ')', '; ' ORDER BY score DESC, pos) AS reason,
    string_agg(category, ',' ORDER BY score DESC, pos) AS categories FROM cats GROUP BY 1),
verdict AS (SELECT doc_id, CASE
    WHEN length(text) < 100 OR (contains(text, '招标公告') AND NOT contains(text, '采购')) THEN '正文无实质采购需求内容'
    WHEN {_any('source', TITLE_SERVICE)} OR {_any('text', CONTENT_SERVICE)} THEN '服务类采购(非产品)'
    WHEN {_FIRST} IS NOT NULL THEN '排除词:' || {_FIRST} END AS stop FROM d),
cascade AS (SELECT v.doc_id, stop IS NULL AND b.doc_id IS NOT NULL AS keep, coalesce(stop, b.reason, '无产品匹配') AS reason,
    CASE WHEN stop IS NULL THEN coalesce(b.categories, '') ELSE '' END AS categories FROM verdict v LEFT JOIN best b ON v.doc_id = b.doc_id)"""


def judged(t):
    return L.filter_records(t.documents, "source", "text", CATEGORIES, EXCLUDE, TITLE_SERVICE, CONTENT_SERVICE)


@query("match_categories", f"WITH {CATS} SELECT doc_id, category, score, reason FROM cats")
def match_categories(t):
    body = F.concat(F.col("source"), F.lit(" "), F.coalesce("text", F.lit("")))
    return t.documents.select("doc_id", F.inline(L.match_categories(body, CATEGORIES))).withColumn("score", F.col("score").cast("long"))


@query("filter_cascade", f"WITH {CASCADE} SELECT * FROM cascade")
def filter_cascade(t):
    return judged(t).select("doc_id", "keep", "reason", F.array_join("categories", ",").alias("categories"))


@query("hit_rate", f"WITH {CASCADE} SELECT count(*) AS total, count(*) FILTER (keep) AS kept, round(avg(CAST(keep AS INT)) * 100, 1) AS hit_rate FROM cascade")
def hit_rate(t):
    return S.hit_rate(judged(t))


@query("keep_against_labels", f"""WITH {CASCADE} SELECT quality, count(*) AS documents, count(*) FILTER (keep) AS kept
  FROM cascade JOIN labels USING (doc_id) GROUP BY 1""")
def keep_against_labels(t):
    return judged(t).join(t.labels, "doc_id").groupBy("quality").agg(F.count("*").alias("documents"), F.count_if("keep").alias("kept"))


_TERM = [w for ws in TERMS.values() for w in ws]
ADDRESS, FOOTER = ["haben", "for the"], ["avec", "with th", "queon"]
_PARTS = f"""list_transform(list_filter(string_split(whole, '　'), lambda x: NOT ({_any('x', ADDRESS)} AND {_any('x', _TERM)})), lambda x: trim(x))"""
_BODY = f"array_to_string({_PARTS}, ' ')"
for _word in FOOTER:
    _BODY = rf"regexp_replace({_BODY}, '{_word}[^\n]{{0,50}}', '', 'g')"
ROUGH = rf"""w AS (SELECT page_id, trim(regexp_extract(html, '<title>([^<]+)</title>', 1)) AS title,
    trim(regexp_replace(regexp_replace(regexp_replace(replace(html, '</p>', '　</p>'), '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', ' ', 'g'), '[\s\x0B]+', ' ', 'g')) AS whole FROM pages),
  p AS (SELECT page_id, title, {_BODY} AS body FROM w)"""


def _paragraphs(t):
    """Pages whose paragraphs are parts, divided by full-width blanks."""
    return t.pages.withColumn("html", F.replace("html", F.lit("</p>"), F.lit("　</p>")))


def _rough(t, terms):
    return L.rough_match(_paragraphs(t), "html", terms, address=ADDRESS, footer=FOOTER).select(
        "page_id", "matched", F.array_join("matched_terms", "|").alias("terms"), F.array_join("matched_categories", "|").alias("categories"))


ROUGH_SQL = f"""WITH {ROUGH}, h AS (SELECT page_id, list_filter([{', '.join(f"'{w}'" for w in _TERM)}], lambda w: contains(title, w) OR contains(body, w)) AS terms FROM p)
  SELECT page_id, len(terms) > 0 AS matched, array_to_string(terms, '|') AS terms,
    array_to_string(list_filter([{', '.join("CASE WHEN " + " OR ".join(f"list_contains(terms, '{w}')" for w in ws) + f" THEN '{n}' END" for n, ws in TERMS.items())}], lambda c: c IS NOT NULL), '|') AS categories FROM h"""


@query("rough_match", ROUGH_SQL)
def rough_match(t):
    return _rough(t, TERMS)


@query("rough_match_table", ROUGH_SQL)
def rough_match_table(t):
    """The same rules as a table."""
    return _rough(t, RuleTable(rule_rows(t.spark, TERMS)))


@query("rule_table", r"""WITH r AS (SELECT DISTINCT 'c' || (item_id % 7) AS category, unnest(regexp_extract_all(text, '\p{L}{6,}')) AS keyword, item_id % 97 = 13 AS excluded FROM benchmark),
  h AS (SELECT doc_id, category, keyword, excluded FROM documents JOIN r ON contains(text, keyword))
  SELECT doc_id, category, count(DISTINCT keyword) FILTER (NOT excluded) AS score FROM h GROUP BY ALL HAVING count(*) FILTER (excluded) = 0""")
def rule_table(t):
    """Thousands of rules that come from a table: the longer words of the items, in seven categories."""
    words = F.regexp_extract_all("text", F.lit(r"\p{L}{6,}"), F.lit(0))
    rules = t.benchmark.select(F.concat(F.lit("c"), (F.col("item_id") % 7).cast("string")).alias("category"), F.explode(words).alias("keyword"),
                               (F.col("item_id") % 97 == 13).alias("excluded"), F.col("item_id").cast("int").alias("position"))
    found = t.documents.select("doc_id", F.inline(L.match_categories("text", RuleTable(rules))))
    return found.select("doc_id", "category", F.col("score").cast("long").alias("score"))


INTENT = r"""b AS (SELECT doc_id, source,
    trim(regexp_replace(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '&[a-zA-Z]+;', ' ', 'g'), '[\s\x0B\x{0085}\x{00A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{3000}]+', ' ', 'g')) AS body FROM documents),
""" + f"""i AS (SELECT doc_id, length(body) < 50 AS short, {_any("(source || ' ' || body)", [w for ws in LINES.values() for w in ws])} AND NOT ({_any('source', [])} OR {_any('body', ['车辆维修'])}) AS product,
    list_filter([{', '.join("CASE WHEN " + _any("(source || ' ' || body)", ws) + f" THEN '{n}' END" for n, ws in LINES.items())}], lambda x: x IS NOT NULL) AS hits FROM b),
v AS (SELECT doc_id, CASE WHEN short THEN '正文缺失' WHEN product THEN '具体产品' ELSE '非具体产品' END AS intent_verdict,
    CASE WHEN product AND NOT short THEN hits ELSE [] END AS matched_products FROM i)"""


def intents(t):
    return L.match_intent(t.documents, "source", "text", LINES)


@query("match_intent", f"WITH {INTENT} SELECT doc_id, intent_verdict, array_to_string(matched_products, '|') AS matched FROM v")
def match_intent(t):
    return intents(t).select("doc_id", "intent_verdict", F.array_join("matched_products", "|").alias("matched"))


@query("verdict_stats", f"WITH {INTENT} SELECT intent_verdict, count(*) AS total, count(*) FILTER (len(matched_products) > 0) AS matched FROM v GROUP BY 1")
def verdict_stats(t):
    return S.verdict_stats(intents(t))


@query("match_stats", f"WITH {INTENT}, u AS (SELECT unnest(matched_products) AS matched_products FROM v) SELECT matched_products, count(*) AS count FROM u GROUP BY 1")
def match_stats(t):
    return S.match_stats(intents(t), list(LINES))


@query("search_filter", "SELECT doc_id FROM documents WHERE contains(source, 'src1') AND contains(source || ' ' || lang, 'en')")
def search_filter(t):
    return t.documents.filter(L.matches_filters(province="src1", notice_type="en", province_col="source", type_cols=["source", "lang"])).select("doc_id")


@query("post_filter", """SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_totalprice / 10000 >= 10 AND o_totalprice / 10000 <= 30
  AND contains(o_orderpriority, 'HIGH')""")
def post_filter(t):
    rows = t.orders.withColumn("status", F.when(F.col("o_orderstatus") == "F", "已中标").otherwise("进行中"))
    return L.post_filter(rows, exclude_won=True, min_budget=10, max_budget=30, city="HIGH", budget="o_totalprice",
                         city_col="o_orderpriority").select("o_orderkey")


@query("validate", """WITH r AS (SELECT o_orderkey, o_totalprice - 1000 AS b, o_orderkey % 113 AS s, o_orderpriority AS a, o_orderdate AS e FROM orders)
  SELECT o_orderkey, concat_ws('|', CASE WHEN o_orderkey % 7 = 0 THEN 'missing:project_name' END, CASE WHEN o_orderkey % 5 = 0 THEN 'requirement_chunks' END, CASE WHEN a NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'announce_type' END,
    CASE WHEN b < 0 THEN 'budget_amount' END, CASE WHEN s > 100 THEN 'opportunity_score' END) AS errors FROM r""")
def validate(t):
    rows = t.orders.select("o_orderkey", (F.col("o_totalprice") - 1000).alias("budget_amount"),
                           (F.col("o_orderkey") % 113).alias("opportunity_score"), F.col("o_orderpriority").alias("announce_type"),
                           F.array("o_orderstatus").alias("product_keywords"), F.lit("tender-structured-v1").alias("schema_version"),
                           F.col("o_orderdate").alias("extracted_at"), F.lit("u").alias("source_url"), F.lit("b").alias("buyer_name_std"),
                           F.lit("s").alias("content_summary"), F.when(F.col("o_orderkey") % 7 != 0, "o_orderstatus").otherwise("").alias("project_name"),
                           F.array(F.struct(F.when(F.col("o_orderkey") % 5 == 0, "unknown").otherwise("other").alias("type"), F.lit("t").alias("text"))
                                   ).alias("requirement_chunks"))
    return L.validate(rows, types=["1-URGENT", "2-HIGH", "3-MEDIUM"]).select("o_orderkey", F.array_join("errors", "|").alias("errors"))


@query("table_pages", """WITH p AS (SELECT conv_id AS doc_id, turn AS page, CAST(contains(text, 'tion') AS INT) + CAST(contains(text, 'the') AS INT) + CAST(contains(text, 'ein') AS INT) >= 2 AS hit FROM conversations),
  h AS (SELECT doc_id, page FROM p WHERE hit QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY page) <= 2),
  f AS (SELECT doc_id, page FROM p WHERE doc_id NOT IN (SELECT doc_id FROM h) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY page) <= 1)
  SELECT * FROM h UNION ALL SELECT * FROM f""")
def table_pages(t):
    pages = t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text")
    return L.table_pages(pages, words=["tion", "the", "ein"], most=2, fallback=1).select("doc_id", "page")


@query("valid_vectors", "SELECT vec_id FROM embeddings WHERE len(embedding) = 64 AND vec_id IS NOT NULL")
def valid_vectors(t):
    return L.valid_vectors(t.embeddings, 64, "vec_id").select("vec_id")
