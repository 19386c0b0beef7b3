import random
from datetime import datetime

import pytest

from pyspark.sql import functions as F

from bidweave import rules
from bidweave.functions import html as H
from bidweave.functions import jsonx as J
from bidweave.functions import names as N
from bidweave.functions import text as X
from bidweave.functions import urls as U
from bidweave.operators import filters as L
from bidweave.operators import textjoin as TJ


def test_project_names(rows):
    names = ["应急设备采购项目（二次）公开招标公告", "A(包1)中标公告", "某项目成交结果公告", "更正公告中标公告", None, " B（a）x(b) "]
    assert rows([(n,) for n in names], "x string", N.normalize_project_name("x")) == [
        "应急设备采购项目", "A", "某项目", "", "", "Bx"]
    assert rows([("北京大学（校本部）",), ("清华大学",), (None,)], "x string", N.standardize_org("x")) == ["北京大学", "清华大学", ""]


def test_money(rows):
    texts = ["人民币 1.2 亿元", "90 万元", "3600000 元", "1,234.5元", "无", None]
    assert rows([(t,) for t in texts], "x string", N.parse_money("x")) == [120000000.0, 900000.0, 3600000.0, 1234.5, None, None]
    yuan = [135650.0, 1250.0, 3750.0, 10050.0, 331250.0, 0.0, None, 1e10]
    shown = rows([(v,) for v in yuan], "x double", N.budget_display("x"))
    assert shown == [f"{v / 10000:.2f}万元" if v else "未知" for v in yuan]


def test_display_matches_printf_on_ties(rows):
    yuan = [float(50 + 100 * i) for i in range(0, 40000, 7)]
    assert rows([(v,) for v in yuan], "x double", N.budget_display("x")) == [f"{v / 10000:.2f}万元" for v in yuan]


def test_levels_and_scores(rows):
    assert rows([(59,), (60,), (80,), (None,)], "x int", N.opportunity_level("x")) == ["低", "中", "高", "低"]
    assert rows([(5e6,), (1e6,), (9e5,), (None,)], "x double", N.budget_level("x")) == ["大额", "中等", "小额", "小额"]
    data = [(6e6, "东南大学", "单一来源采购", 20), (2e6, "某局", "竞争性磋商", 10), (1e5, "某公司", "公开招标", 0)]
    assert rows(data, "b double, o string, m string, f int", N.opportunity_score("b", "o", "m", "f")) == [100, 75, 40]


def test_canonical_urls(rows):
    urls = ["https://CCGP.gov.cn:443/a/b/#x", "http://www.ccgp.gov.cn/a/b/", "HTTPS://Host.com:8443/p/?q=1#f", "https://h.com:443", " ",
            "no host", "http://h.com:80/x//"]
    assert rows([(u,) for u in urls], "x string", U.canonical_url("x")) == [
        "http://www.ccgp.gov.cn:443/a/b", "http://www.ccgp.gov.cn/a/b", "https://host.com:8443/p?q=1", "https://h.com/", None,
        "no host", "http://h.com/x"]


def test_resolve_urls(rows):
    base = "http://h.com/a/b/c.html?q=1"
    hrefs = {"../d.html": "http://h.com/a/d.html", "./e": "http://h.com/a/b/e", "/f": "http://h.com/f", "//g.com/x": "http://g.com/x",
             "https://z.com/": "https://z.com/", "#top": "", "javascript:void(0)": "", "mailto:a@b": "", "?p=2": "http://h.com/a/b/c.html?p=2",
             "../../../../k": "http://h.com/k", "": ""}
    assert rows([(h, base) for h in hrefs], "h string, b string", U.resolve_url("h", "b")) == list(hrefs.values())


def test_file_names(rows):
    assert rows([('a<b>:"c".pdf',), ("x" * 250 + ".docx",)], "x string", U.safe_filename("x")) == [
        "a_b___c_.pdf", "x" * 195 + ".docx"]
    urls = ["http://h/f/%E6%A0%87.pdf?x=1", "http://h/download?uuid=AB12", "http://h/"]
    assert rows([(u,) for u in urls], "x string", U.filename_from_url("x")) == ["标.pdf", "attachment_AB12.pdf", "unknown.pdf"]
    assert rows([("http://h/download?a=1&uuid=0aF",), ("http://h/",)], "x string", U.url_uuid("x")) == ["0aF", None]


def test_attachment_links(rows):
    data = [("x.PDF", ""), ("x", "表.docx"), ("/oss/download?uuid=1", ""), ("/page.html", "more"), ("/a/fileapi/x", None)]
    assert rows(data, "h string, t string", U.is_attachment("h", "t")) == [True, True, True, False, True]


PAGE = """<html><head><meta name="ArticleTitle" content="某大学设备采购公开招标公告"><meta content='2026-03-24 10:43' name='PubDate'>
<title>t</title><style>p{}</style></head><body><a class="x CurrChnlCls" href="#">中央公告</a><a class="CurrChnlCls"> 更多 </a>
<div id="noticeArea"><style>#a{b:c}</style><div class="in"><p>采购人： 某大学（本部）</p><p>预算金额：90 万元&nbsp;整</p></div>#noticeArea .x { color: red }</div>
<p>outside</p><a href='f/spec.docx'>说明</a></body></html>"""


def test_detail_page(rows):
    got = rows([(PAGE,)], "h string", H.page_title("h"), H.iso(H.publish_time("h")), H.announce_type(H.page_title("h"), "h"),
               H.content_region("h"), H.budget_raw("h"))
    assert got == [("某大学设备采购公开招标公告", "2026-03-24T10:43:00", "公开招标公告", "采购人： 某大学（本部）\n预算金额：90 万元 整", "90 万元&nbsp;整")]
    assert rows([("<p>a</p><a class='CurrChnlCls'>x</a><a class='CurrChnlCls'> 其他 </a>",)], "h string", H.announce_type(F.lit("无"), "h")) == ["其他"]


def test_content_falls_back(rows):
    pages = ['<div class="vF_detail_content"><div>a</div>b</div><p>c</p>', '<div id="noticeArea"> </div><div class="detail_content">d</div>',
             "<p>e<p>f</p><script>x</script>", "<b>g</b>"]
    assert rows([(p,) for p in pages], "h string", H.content_region("h")) == ["a b", "d", "e\nf", ""]


def test_times(rows):
    texts = ["2026-03-24 10:43", "2026年3月4日 9:05:07", "2026-13-24 10:43", "2026-03-24", "x", None]
    assert rows([(t,) for t in texts], "x string", H.parse_time("x")) == [
        datetime(2026, 3, 24, 10, 43), datetime(2026, 3, 4, 9, 5, 7), None, None, None, None]
    pages = ["<p>发布时间：2026年3月4日 9:05</p>", "<b>2026年3月4日</b>", "<i>2026-03-24</i>", "<u>none</u>"]
    assert rows([(p,) for p in pages], "h string", H.iso(H.publish_time("h"))) == [
        "2026-03-04T09:05:00", "2026-03-04T00:00:00", "2026-03-24T00:00:00", ""]


def test_types_and_blocks(rows):
    assert rows([("某项目更正招标",), ("成交",), ("无",)], "x string", H.title_type("x")) == ["更正公告", "成交公告", ""]
    pages = ["共找到 <b>12</b> 条", "请输入验证码 条", "", None, "plain"]
    assert rows([(p,) for p in pages], "h string", H.is_blocked("h"), H.result_count("h")) == [
        (False, 12), (True, 0), (True, 0), (True, 0), (True, 0)]


def test_reader_text(rows):
    text = "Title: Converted Content\n\nMarkdown Content:\n当前位置 招标公告\n## 某大学中标公告\n发布时间：2026年3月4日 9:05\n预算金额：90.5万元\n* 中标公告"
    got = rows([(text,)], "x string", H.reader_title("x"), H.reader_time("x"), H.budget_raw("x", rules.READER_BUDGET_LABELS, rules.READER_BUDGET_UNIT))
    assert got == [("某大学中标公告", "2026-03-04 09:05", "90.5万元")]
    assert rows([("Title: 真标题\nMarkdown Content:\nx",), ("# 头\n正文",), ("a\nb",)], "x string", H.reader_title("x")) == ["真标题", "头", "a"]


def test_segments(rows):
    page = "<html><body><p>开头</p><p>采购需求：<b>设备</b>&nbsp;一台</p><p>招标公告 尾</p></body></html>"
    assert rows([(page,)], "h string", H.segment_first("h"), H.segment_last("h"), H.segment_intent("h")) == [
        ("采购需求： 设备 &nbsp;一台 招标公告 尾", "招标公告 尾", "设备 一台 招标公告 尾")]
    assert rows([("<body>x <i>y</i></body>",), (None,)], "h string", H.segment_first("h")) == ["x y", ""]


def test_text_helpers(rows):
    assert rows([("a  b　c\n",), (None,)], "x string", X.clean_text("x")) == ["a b c", ""]
    assert rows([("  a\t b \r\n\r\n 　c d",)], "x string", X.clean_lines("x")) == ["a b\nc\nd"]
    assert rows([("abcdefghij",), ("abc",)], "x string", X.truncate_middle("x", 5, 2, 2, "..")) == ["ab..ij", "abc"]
    assert rows([("a\r\nb" * 2,)], "x string", X.shorten("x", 4)) == ["a\nb…"]
    assert rows([(" ",), (None,), ("x",)], "x string", X.nonblank("x")) == ["None", "None", "x"]
    assert rows([(7, "名", "人")], "i int, a string, b string", X.label("i", "a", "b")) == ["#7 名 — 人"]
    noisy = "Thinking Process: 想\n思考过程：再想</thought> 正文 * Avoid fluff * x"
    assert rows([(noisy,), ("正文",)], "x string", X.strip_markers("x")) == ["正文", "正文"]
    assert rows([("nan",), ("",), (None,), ("王",)], "x string", X.not_nan("x")) == [False, False, False, True]


def test_json_helpers(rows):
    reply = '<think>{"a": 1}</think>好的：{"answer": "x"} 完'
    assert rows([(reply,), ("none",)], "x string", J.reply_to_struct("x", "struct<answer:string>")["answer"]) == ["x", None]
    broken = '{"items": [{"产品名称": "头盔", "数量": "2"}, {"产品名称": bad}, {"产品名称": "灯", "单价": "3", "单位": ""}]}'
    items = rows([(broken,)], "x string", J.format_items(J.salvage_items("x", J.SPEC_SCHEMA)))[0]
    assert [tuple(i) for i in items] == [("头盔", "数量: 2"), ("灯", "单价: 3")]
    assert rows([('["a","b"]',), ("c",), (None,), ("",), ("[bad",)], "x string", J.as_array("x")) == [["a", "b"], ["c"], [], [], ["[bad"]]
    assert rows([('["a"]',), ("x",), (None,)], "x string", J.attachment_count("x")) == [1, 0, 0]
    assert rows([("a", None)], "a string, b string", J.metadata_json(a="a", b="b")) == ['{"a":"a","b":null}']


def test_safe_casts(rows):
    assert rows([("1.5",), ("x",), (None,)], "x string", N.safe_float("x"), N.safe_str("x"), N.yes_no(F.lit("是"))) == [
        (1.5, "1.5", True), (0.0, "x", True), (0.0, "", True)]
    import hashlib
    assert rows([("甲", None, 5)], "a string, b string, c int", N.cache_key("a", "b", "c")) == [hashlib.md5("甲||5".encode()).hexdigest()]


def test_category_match(rows):
    texts = ["采购卫星电话和天通终端", "卫星电话与柴油", "星闪SLE模组", "桌椅", None]
    got = rows([(t,) for t in texts], "x string", L.match_categories("x"))
    assert [[tuple(m) for m in g] for g in got] == [
        [("satellite", 2, "命中:天通; 命中:卫星电话")], [], [("sparklink", 2, "命中:星闪; 命中:SLE")], [], []]


def test_filter_cascade(spark):
    pad = "采购需求说明" * 20
    data = [("a", "短"), ("b", pad + "招标"), ("保洁服务采购", pad), ("c", pad + "物业"), ("d", pad + "卫星电话与应急通信和应急指挥"), ("e", "招标公告" * 30)]
    got = L.filter_records(spark.createDataFrame(data, "project_name string, content string")).collect()
    assert [(r.keep, r.reason, r.categories) for r in got] == [
        (False, rules.REASON_EMPTY, []), (False, rules.REASON_NO_MATCH, []), (False, rules.REASON_SERVICE, []), (False, "排除词:物业", []),
        (True, "emergency(2分:命中:应急通信; 命中:应急指挥); satellite(1分:命中:卫星电话)", ["emergency", "satellite"]),
        (False, rules.REASON_EMPTY, [])]


def test_rough_match_ignores_addresses(spark):
    data = [("<title>无人机</title><p>x</p>",), ("<p>采购需求 地址：天通大厦　桌椅</p>",), ("<p>采购需求 天通终端　地址：某路</p>",), ("<p>服务热线 北斗</p>",)]
    got = L.rough_match(spark.createDataFrame(data, "html string")).collect()
    assert [(r.matched, r.matched_categories, r.matched_terms) for r in got] == [
        (True, ["scene"], ["无人机"]), (False, [], []), (True, ["satellite"], ["天通"]), (False, [], [])]


def test_rough_match_goes_on_behind_a_footer(spark):
    data = [("<p>服务热线 " + "x" * 180 + " 卫星通信</p>",), ("<p>中国政府采购网 " + "y" * 50 + "北斗</p>",), ("<p>服务热线 " + "x" * 30 + "北斗</p>",),
            ("<p>京ICP备 1 服务热线 2" + "z" * 160 + "　无人机　地址：天通路</p>",), (None,)]
    frame = spark.createDataFrame(data, "html string")
    want = [["卫星通信"], ["北斗"], [], ["无人机"], []]
    table = TJ.RuleTable(TJ.rule_rows(spark, rules.ROUGH_TERMS))
    for terms in (rules.ROUGH_TERMS, table):
        assert [r.matched_terms for r in L.rough_match(frame, terms=terms).collect()] == want


def test_rule_tables_equal_word_lists(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("ab市") for _ in range(rng.randrange(1, 5)))
    lists = {f"c{i}": {"keywords": list(dict.fromkeys(word() for _ in range(8))), "exclude": [word() + "z"]} for i in range(5)}
    data = [(i, " ".join(word() + rng.choice(["", "", "z"]) for _ in range(12)), word()) for i in range(60)] + [(90, None, None), (91, "", "")]
    frame = spark.createDataFrame(data, "i int, content string, project_name string")
    table = TJ.RuleTable(TJ.rule_rows(spark, lists))
    stop = TJ.RuleTable(TJ.rule_rows(spark, {"stop": ["市市市b", "bbb市"]}))
    found = [sorted(map(tuple, frame.select("i", L.match_categories("content", r)).collect()), key=str) for r in (lists, table)]
    assert found[0][:-2] == found[1][:-2] and any(m for _, m in found[1])
    kept = [sorted(map(str, L.filter_records(frame.withColumn("content", F.concat("content", F.lit("x" * 100))), category_rules=r, exclude=e).collect()))
            for r, e in ((lists, ["市市市b", "bbb市"]), (table, stop))]
    assert kept[0] == kept[1]
    lines = {c: r["keywords"] for c, r in lists.items()}
    judged = [sorted(map(str, L.match_intent(frame, "project_name", "content", r, 5).collect())) for r in (lines, TJ.RuleTable(TJ.rule_rows(spark, lines)))]
    assert judged[0] == judged[1]
    with pytest.raises(ValueError):
        TJ.RuleTable(spark.range(1).select(F.lit("c").alias("category"), F.repeat(F.lit("k"), F.lit(TJ.PATTERN_BYTES + 1)).alias("keyword"),
                                          F.lit(False).alias("excluded"), F.lit(1).alias("position")))


def test_many_rules_find_what_brute_force_finds(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdé") for _ in range(n))
    rows = [(f"c{i % 40}", word(rng.randrange(1, 7)), i % 90 == 0, i) for i in range(10_000)]
    texts = [" ".join(word(rng.randrange(1, 9)) for _ in range(10)) for _ in range(30)]
    got = {r.t: r.m for r in spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", TJ.RuleTable(spark.createDataFrame(rows, TJ.RULES)).matches()(F.col("t")).alias("m")).collect()}
    for text in texts:
        order = {c: i for i, c in enumerate(dict.fromkeys(r[0] for r in rows))}
        hits = {}
        for c, w, out, _ in rows:
            if w in text:
                hits.setdefault(c, [[], False])
                hits[c][1] |= out
                if not out and w not in hits[c][0]:
                    hits[c][0].append(w)
        want = sorted(((c, len(w)) for c, (w, out) in hits.items() if w and not out), key=lambda x: (-x[1], order[x[0]]))
        assert [(m["category"], m["score"]) for m in got[text]] == want


def test_intent(spark):
    long = "技术参数：" + "设备一台" * 20
    data = [("卫星终端采购", long), ("物业管理", long + "机器人"), ("x", "短"), ("y", long)]
    got = L.match_intent(spark.createDataFrame(data, "list_title string, detail_body_preview string")).collect()
    assert [(r.intent_verdict, r.matched_products) for r in got] == [
        ("具体产品", ["卫星移动通信"]), ("非具体产品", []), ("正文缺失", []), ("非具体产品", [])]


def test_costly_texts_are_computed_once(spark):
    """A filter or a score behind a text expression does not repeat it (F3, F5)."""
    from bidweave.operators import filters as L
    from bidweave.operators import infer as I
    from bidweave.operators import stats as S
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    docs = spark.createDataFrame([("t", "<b>采购需求：</b>泵" + "x" * 60), (None, None)], "list_title string, detail_body_preview string")
    counts = S.match_stats(L.match_intent(docs, lines={"pump": ["泵"]}), ["pump"])
    assert plan(counts).count("<[^>]+>") == 1 and [tuple(r) for r in counts.collect()] == [("pump", 1)]
    pages = spark.createDataFrame([("HTTP://A.com/x/#y", "招标公告", "2024-01-01", "采购人：甲（总部）\n预算金额：20 万元"), ("http://b.com", "中标公告", None, None)],
                                  "url string, title string, publish_date string, content string")
    made = I.extract_structured(pages, spark.createDataFrame([("http://b.com/",)], "source_url string"))
    text = plan(made)
    assert text.count("(?:[^@]*@)?") == 2 and text.count("采购单位名称") == 1  # one canonical URL on each side, one look for a label
    assert [(r.source_url, r.buyer_name_std, r.budget_amount, r.winning_amount) for r in made.collect()] == [("HTTP://A.com/x/#y", "甲", 200000.0, None)]
