import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from bidweave import rules
from bidweave.operators import infer as I
from bidweave.operators import pages as G
from bidweave.sources import crm as R
from bidweave.sources import files as S


def test_attachments(spark):
    html = ("<a class='bizDownload' href='' id='AB12'>标书.pdf</a><a class='x bizDownload' id='zz'>no</a><a class='bizDownload' id='AB12'>twice</a>"
            "<a href='f/a.doc'><b>规格</b></a><a href='#'>x.pdf</a><a href='/page'>more</a><a href='/oss/download?uuid=0F'></a><a href='f/a.doc'>again</a>")
    df = spark.createDataFrame([(1, "http://h/d/p.htm", html), (2, "", "<a href='b.zip'></a>"), (3, "http://h/", "<p>none</p>")], "id int, url string, html string")
    got = {(r.id, r.download_url): (r.file_name, r.uuid) for r in G.extract_attachments(df, "id").collect()}
    assert got == {(1, rules.DOWNLOAD_URL + "AB12"): ("标书.pdf", "AB12"), (1, "http://h/d/f/a.doc"): ("规格", None),
                   (1, "http://h/oss/download?uuid=0F"): ("download", "0F"), (2, "b.zip"): ("b.zip", None)}


def test_links(spark):
    text = '[公告一](/cggg/1.htm "t") [x](/cggg/2.htm) <a href="http://www.ccgp.gov.cn/cggg/1.htm#a">again</a><a href="/cggg/3.htm"><b>公告三</b></a><a href="/cggg/4.htm">》</a>' \
           '<a href="http://other.com/cggg/5.htm">外部</a><a href="/zcfg/6.htm">政策</a>'
    df = spark.createDataFrame([(1, "http://www.ccgp.gov.cn/list/", text)], "id int, url string, html string")
    got = {(r.title, r.link) for r in G.extract_links(df, "id", path="/cggg/").collect()}
    assert got == {("公告一", "http://www.ccgp.gov.cn/cggg/1.htm"), ("公告三", "http://www.ccgp.gov.cn/cggg/3.htm")}
    urls = G.detail_urls(spark.createDataFrame([(1, 'href="http://www.ccgp.gov.cn/cggg/1" href="http://www.ccgp.gov.cn/cggg/1" href="http://www.ccgp.gov.cn/x/2"')], "id int, html string"), "id")
    assert [r.detail_url for r in urls.collect()] == ["http://www.ccgp.gov.cn/cggg/1"]


def test_list_items(spark):
    li = ('<li><a href="http://www.ccgp.gov.cn/cggg/{0}.htm" target="_blank">\n 标题{0}</a><span>2026.03.04 10:00:00 | 采购人：甲{0} | 代理机构：乙<br>'
          '<strong style="x"> 公开招标公告 </strong> | 江苏 </span></li>')
    html = '<li>no</li><ul class="vT-srch-result-list-bid">' + li.format(1) + "<li>bad</li>" + li.format(2) + "</ul>" + li.format(3)
    got = G.list_items(spark.createDataFrame([("k", html), ("none", "<p>")], "id string, html string"), "id").orderBy("pos").collect()
    assert [tuple(r)[2:] for r in got] == [(f"http://www.ccgp.gov.cn/cggg/{i}.htm", f"标题{i}", "2026.03.04 10:00:00", f"甲{i}", "乙", "公开招标公告", "江苏") for i in (1, 2)]


def test_repeated_pages(spark):
    data = [("k", 1, "a"), ("k", 1, "b"), ("k", 2, "b"), ("k", 2, "c"), ("k", 3, "c"), ("k", 3, "b"), ("k", 4, "z"), ("m", 1, "a"), ("m", 2, "a"), ("m", 2, "a"), ("n", 1, "a")]
    got = G.stop_at_repeat(spark.createDataFrame(data, "keyword string, page int, url string"))
    assert sorted(map(tuple, got.select("keyword", "page", "url").collect())) == sorted(data[:4] + data[7:])


def test_first_useful(spark):
    data = [("u", "reader", " ", True), ("u", "direct", "x", False), ("u", "browser", "正文", True), ("v", "direct", None, True)]
    got = {r.url: tuple(r)[1:] for r in G.first_useful(spark.createDataFrame(data, "url string, method string, content string, success boolean"), ["reader", "direct", "browser"]).collect()}
    assert got == {"u": ("browser", "正文", 3, 2), "v": (None, None, 1, 1)}


def test_crawl_plan(spark):
    got = G.crawl_plan(spark.createDataFrame([(" 卫星 通信",), (" ",)], "keyword string"), 2).orderBy("page").collect()
    assert [r.page for r in got] == [1, 2]
    assert got[1].url.startswith("http://search.ccgp.gov.cn/bxsearch?searchtype=2&page_index=2&bidSort=0&") and "kw=%E5%8D%AB%E6%98%9F+%E9%80%9A%E4%BF%A1&" in got[1].url


def test_json_lines(spark, tmp_path):
    schema = StructType.fromDDL("a int, b string")
    path = tmp_path / "x.jsonl"
    path.write_text('{"a": 1, "b": "x"}\n{bad\n{"a": 2}\n')
    kept = S.read_jsonl(spark, str(path), schema).cache()
    assert kept.count() == 3 and kept.filter("_bad IS NOT NULL").count() == 1
    assert S.read_jsonl(spark, str(path), schema, "drop").collect() and len(S.read_jsonl(spark, str(path), schema, "drop").collect()) == 2
    assert S.read_jsonl(spark, str(tmp_path / "none"), schema, "drop").count() == 0
    array = tmp_path / "y.json"
    array.write_text(json.dumps([{"a": 1}, {"a": 2}], indent=1))
    lines = tmp_path / "z.json"
    lines.write_text('{"a": 5}\n{"a": 6}\n')
    assert sorted(r.a for r in S.read_json_any(spark, str(array), schema).collect()) == [1, 2]
    assert sorted(r.a for r in S.read_json_any(spark, str(lines), schema).collect()) == [5, 6]
    out = str(tmp_path / "out")
    S.write_jsonl(kept.filter("_bad IS NULL").drop("_bad"), out)
    S.write_jsonl(spark.createDataFrame([(9, "z")], schema), out, "append")
    assert S.read_jsonl(spark, out, schema, "drop").count() == 3
    assert S.list_output_files(spark, out, "*.json").filter("size > 0").count() >= 2


def test_attachment_files(spark, tmp_path):
    (tmp_path / "att" / "12").mkdir(parents=True)
    for name, data in {"a.bin": b"%PDF-1.7", "b.txt": "中文说明".encode("gbk"), "c.txt": "文".encode(), "d.xlsx": b"\xff\xfe\xff"}.items():
        (tmp_path / "att" / "12" / name).write_bytes(data)
    files = S.with_file_kind(S.scan_attachments(spark, str(tmp_path / "att"), content=True))
    got = {r.file_name: (r.tender_id, r.file_size, r.file_kind) for r in files.collect()}
    assert got == {"a.bin": ("12", 8, "pdf"), "b.txt": ("12", 8, "txt"), "c.txt": ("12", 3, "txt"), "d.xlsx": ("12", 3, "sheet")}
    texts = {r.file_name: r.text for r in S.decode_text(files.filter("file_kind = 'txt'"), "file_name").collect()}
    assert texts == {"b.txt": "中文说明", "c.txt": "文"}
    parsed = spark.createDataFrame([("12", "c.txt", "/x/c.txt"), ("13", "n", "/x/none.txt")], "tender_id string, file_name string, parsed_path string")
    loaded = {r.tender_id: r.text for r in S.load_parsed_text(spark, parsed, str(tmp_path / "att")).collect()}
    assert loaded == {"12": "文", "13": None}
    (tmp_path / "att" / "13").mkdir()
    (tmp_path / "att" / "13" / "c.txt").write_text("other", "utf-8")
    twins = spark.createDataFrame([("12", "c.txt", "/x/c.txt"), ("13", "c.txt", f"{tmp_path}/att/13/c.txt")], "tender_id string, file_name string, parsed_path string")
    assert {r.tender_id: r.text for r in S.load_parsed_text(spark, twins, str(tmp_path / "att")).collect()} == {"12": "文", "13": "other"}
    (tmp_path / "att" / "13" / "c.txt").write_text("two\nlines", "utf-8")
    assert {r.tender_id: r.text for r in S.load_parsed_text(spark, twins, str(tmp_path / "att")).collect()}["13"] == "two\nlines"


def test_tables_and_split(spark, tmp_path):
    fallback = spark.range(1)
    assert S.read_table_or(spark, "no_such_table", fallback) is fallback
    spark.range(0).write.mode("overwrite").saveAsTable("empty_table")
    assert S.read_table_or(spark, "empty_table", fallback) is fallback
    S.write_split(spark.createDataFrame([("matched", 1), ("filtered", 2)], "status string, id int"), str(tmp_path / "s"))
    assert [r.id for r in spark.read.parquet(str(tmp_path / "s")).filter("status = 'matched'").collect()] == [1]


def test_texts_are_spread(spark, tmp_path):
    spark.createDataFrame([(i, "x" * i) for i in range(50)], "id int, text string").coalesce(1).write.parquet(str(tmp_path / "t"))
    got = S.read_texts(spark, str(tmp_path / "t"), "id")
    assert got.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and got.count() == 50


def test_crm_exports(spark, tmp_path):
    path = tmp_path / "opps.csv"
    path.write_text("商机编号,客户统一信用代码,商机规模（元）,是否重复客户,客户名称\no1,c1,12.5,是,甲\no2,,3,否,乙\no3,c3,x,否,丙\n", encoding="utf-8")
    got = R.load_opportunities(R.read_export(spark, str(path)))
    assert len(got.columns) == 26 and [(r.opportunity_id, r.value, r.is_duplicate, r.owner) for r in got.orderBy("opportunity_id").collect()] == [
        ("o1", 12.5, True, ""), ("o3", 0.0, False, "")]
    assert len(R.load_leads(R.read_export(spark, str(path))).columns) == 27


def test_embedding_and_extraction(spark):
    df = spark.createDataFrame([(1, "卫星 通信"), (2, " "), (3, "通信 卫星")], "id int, t string")
    made = {r.id: r for r in I.embed(df, "id", "t", I.hashing_encoder(16), batch=2).collect()}
    assert made[2].embedded_content == "None" and made[1].embedding == made[3].embedding and len(made[1].embedding) == 16
    pages = spark.createDataFrame([("http://h/1", "某公开招标公告", "d", "公开招标 采购人：某大学（本部）\n预算金额：600 万元整\n地区：江苏"), ("http://h/2", "x中标公告", "d", "预算金额：人民币 3 万元")],
                                  "url string, title string, publish_date string, content string")
    got = {r.source_url: r for r in I.extract_structured(pages).collect()}
    one, two = got["http://h/1"], got["http://h/2"]
    assert (one.buyer_name_std, one.budget_amount, one.winning_amount, one.opportunity_score, one.province) == ("某大学", 6000000.0, None, 70, "江苏")
    assert (two.budget_amount, two.winning_amount) == (None, 30000.0)


def test_extraction_with_a_model(spark):
    def model():
        return lambda prompts: ['<think>x</think>{"buyer_name_std": "甲", "budget_amount": 5.0, "product_keywords": ["a"]}' if "好" in p else None for p in prompts]

    pages = spark.createDataFrame([("http://h/1", "好", "d", "c"), ("http://h/2", "坏", "d", "c"), ("http://h/3", "好", "d", "c")], "url string, title string, publish_date string, content string")
    done = spark.createDataFrame([("http://H/3/",)], "source_url string")
    got = {r.source_url: (r.buyer_name_std, r.budget_amount, r.product_keywords, r.llm_model) for r in I.extract_structured(pages, done, ("m", model)).collect()}
    assert got == {"http://h/1": ("甲", 5.0, ["a"], "m"), "http://h/2": (None, None, None, None)}


def test_suggestions_use_the_cache(spark):
    def model():
        return lambda prompts: [f"Thinking: x 建议{p}" if p != "p3" else "" for p in prompts]

    requests = spark.createDataFrame([("k1", "p1"), ("k2", "p2"), ("k2", "p2"), ("k3", "p3")], "cache_key string, prompt string")
    cache = spark.createDataFrame([("k1", "旧", 2), ("k1", "最旧", 1)], "cache_key string, suggestions string, created_at int")
    answers, fresh = I.suggest(requests, cache, model)
    assert sorted((r.cache_key, r.suggestions or "") for r in answers.collect()) == [("k1", "最旧"), ("k2", "x 建议p2"), ("k2", "x 建议p2"), ("k3", "")]
    assert [r.cache_key for r in fresh.collect()] == ["k2"]
