from datetime import datetime

import pytest
from pyspark.sql import functions as F

from bidweave.operators import filters as L
from bidweave.operators import profiles as C
from bidweave.operators import projects as P
from bidweave.operators import stats as S
from bidweave.operators.textjoin import infer_region

D = [datetime(2026, 1, d) for d in range(1, 10)]
SCHEMA = ("tender_id int, project_name string, buyer_name_std string, province string, city string, source_url string, publish_date timestamp, "
          "budget_amount double, winning_amount double, winning_bidder string, opportunity_score int, product_keywords array<string>, contact_person string")
NOTICES = [
    (1, "仪器公开招标公告", "甲", "", None, "http://h/gkzb/1", D[0], 100.0, None, None, 80, ["a", "b"], "王"),
    (2, "仪器更正公告", "甲", "省", "市", "http://h/gzgg/2", D[2], 120.0, None, None, 0, ["b"], ""),
    (3, "仪器中标公告", "甲", "省", "市", "http://h/zbgg/3", D[1], 999.0, 110.0, '["x","y"]', 60, [], None),
    (4, "仪器公开招标公告", "乙", "省2", "市2", "http://h/4", D[3], None, None, None, None, None, "李"),
    (5, "车辆更正公告", "甲", "省", "市", "http://h/5", D[4], 0.0, 5.0, "x", 71, ["c"], "王"),
    (6, "其他", "未知", "省", "市", "http://h/6", D[5], 1.0, None, None, 1, ["z"], "无名"),
]


@pytest.fixture(scope="module")
def notices(spark):
    return spark.createDataFrame(NOTICES, SCHEMA).repartition(3)


def test_event_types(notices):
    got = {r.tender_id: r.t for r in notices.select("tender_id", P.event_type().alias("t")).collect()}
    assert got == {1: "招标", 2: "更正", 3: "中标", 4: "招标", 5: "中标", 6: "未知"}


def test_lifecycle(notices):
    rows = {(r.project_name_std, r.buyer_name): r for r in P.aggregate_projects(notices, ["opportunity_score"]).collect()}
    main = rows["仪器", "甲"]
    assert (main.project_id, main.status, main.total_budget, main.event_count, main.opportunity_score) == (1, "已中标", 120.0, 3, 80)
    assert tuple(main.winning_info) == ('["x","y"]', 110.0, "http://h/zbgg/3")
    assert (main.publish_date, main.latest_publish_date) == (D[0], D[2])
    other = rows["仪器", "乙"]
    assert (other.status, other.total_budget, other.winning_info) == ("进行中", 0.0, None)
    assert rows["车辆", "甲"].status == "已中标" and len(rows) == 4


def test_lifecycle_does_not_depend_on_partitions(notices):
    runs = [sorted(map(str, P.aggregate_projects(notices.repartition(n)).collect())) for n in (1, 5)]
    assert runs[0] == runs[1]


def test_timeline(notices):
    got = P.project_timeline(P.project_events(notices)).filter("project_name_std = '仪器' AND buyer_name = '甲'").orderBy("position").collect()
    assert [(r.position, r.type, r.previous_date, r.status_so_far) for r in got] == [
        (1, "招标", None, "进行中"), (2, "中标", D[0], "已中标"), (3, "更正", D[1], "已中标")]


def test_dates_from_details(spark, notices):
    details = spark.createDataFrame([("http://h/4", D[6], 1), ("http://h/4", D[7], 2), ("http://h/5", None, 1)], "url string, publish_date timestamp, crawl_time int")
    got = {r.tender_id: r.publish_date for r in P.with_publish_date(notices, details).collect()}
    assert got[4] == D[7] and got[5] == D[4] and len(got) == 6


def test_profiles(notices):
    rows = {r.customer_name: r for r in C.customer_profiles(notices).collect()}
    assert set(rows) == {"甲", "乙"}
    a = rows["甲"]
    assert (a.province, a.city, a.tender_count, a.total_budget, a.avg_opportunity_score) == ("省", "市", 4, 1219.0, 70.33)
    assert rows["乙"].avg_opportunity_score == 0.0
    values = {(r.field, r.value) for r in C.profile_values(notices).filter("customer_name = '甲'").collect()}
    assert values == {("tech_keywords", k) for k in "abc"} | {("past_winners", w) for w in "xy"} | {("persons", "王")}
    nested = {(r.field, r.part): r["items"] for r in C.nest_values(C.profile_values(notices), 2).filter("customer_name = '甲'").collect()}
    assert nested["tech_keywords", 0] == ["a", "b"] and nested["tech_keywords", 1] == ["c"]
    summary = C.profile_summary(C.customer_profiles(notices), C.profile_values(notices)).filter("customer_name = '乙'").first()
    assert summary.demand_profile.tech_keywords == [] and summary.value_profile.tender_count == 1


def test_win_rates(notices):
    got = {(r.customer_name, r.winner): (r.wins, r.win_rate) for r in C.win_rates(notices).collect()}
    assert got == {("甲", "x"): (2, 1.0), ("甲", "y"): (1, 0.5)}  # shares of two won notices


OPPS = [("c1", "o1", "甲公司", "进行中", "签约", 10.0, "nan", "张", "经理", "toG", "2026-01-02"), ("c1", "o2", "甲公司", "关闭", "", 5.0, "钱", "张", "总", "", "2026-01-01"),
        ("c1", "o3", "甲公司", "进行中", "", 1.5, "孙", "nan", "", "toB", "nan"), ("c1", "o4", "甲公司", "x", "", 0.0, "孙", "", "", "", "")]
LEADS = [("c1", "l1", "甲公司", "已转化", 3.0, "李", "张", "x", "toX", "2026-02-01"), ("c2", "l2", "乙", "跟进中", None, "nan", "周", "y", "nan", "2026-02-02")]


@pytest.fixture(scope="module")
def crm(spark):
    return (spark.createDataFrame(OPPS, "credit_code string, opportunity_id string, customer_name string, opportunity_status string, followup_status string, value double, "
                                        "owner string, contact_person string, contact_position string, customer_type string, report_time string"),
            spark.createDataFrame(LEADS, "credit_code string, lead_id string, customer_name string, lead_status string, lead_value double, salesperson string, "
                                         "contact_person string, contact_position string, customer_segment string, lead_acquisition_time string"))


def test_crm_summaries(crm):
    opps, leads = crm
    assert tuple(C.opportunity_summary(opps).first()) == ("c1", 4, 16.5, 2, 1, 1, 0.25)
    got = {r.credit_code: tuple(r)[1:] for r in C.lead_summary(leads).collect()}
    assert got == {"c1": (1, 3.0, 0, 1, 0, 1.0), "c2": (1, 0.0, 1, 0, 0, 0.0)}
    rel = {r.credit_code: r for r in C.sales_relationship(opps, leads).collect()}
    assert (rel["c1"].primary_sales, rel["c1"].secondary_sales, rel["c1"].first_contact_date, rel["c1"].last_followup_date, rel["c1"].relationship_level) == (
        "钱", "李", "2026-01-01", "2026-02-01", "深度合作")
    assert (rel["c2"].primary_sales, rel["c2"].secondary_sales, rel["c2"].relationship_level) == (None, None, "初步接触")
    contacts = {(r.credit_code, r.name): (r.position, r.source) for r in C.crm_contacts(opps, leads).collect()}
    assert contacts == {("c1", "张"): ("经理", "商机列表"), ("c2", "周"): ("y", "线索列表")}
    seg = {r.credit_code: r.customer_segment for r in C.customer_segment(opps, leads).collect()}
    assert seg == {"c1": "toG", "c2": None}
    by_code = {r.credit_code: r for r in C.crm_by_code(opps, leads).collect()}
    assert by_code["c2"].opportunity_summary is None and by_code["c1"].lead_summary.total_count == 1
    assert {(r.role, r.person) for r in C.sales_people(opps, leads).collect()} == {("owner", "钱"), ("owner", "孙"), ("salesperson", "李")}


def test_unify(spark):
    tender = spark.createDataFrame([("甲", "c1", "政", 2), ("乙", "", "", 1), ("丙", "c9", "", 1), ("丁", "", "", 1)],
                                   "customer_name string, credit_code string, customer_type string, tender_count long")
    crm = spark.createDataFrame([("别名", "c1", "toG", 1), ("乙", "c2", "", 2), ("戊", "c3", "toB", 3), ("丁", "c9", "", 4), ("己", "", "toB", 5)],
                                "customer_name string, credit_code string, customer_type string, lead_count long")
    got = {r.customer_name: (r.customer_type, r.tender_count, r.lead_count, r.has_crm_data, r.has_tender_data, r.customer_kind)
           for r in C.unify_profiles(tender, crm, fields=["lead_count"]).collect()}
    assert got == {"甲": ("toG", 2, 1, True, True, "政府客户"), "乙": ("", 1, 2, True, True, "政府客户"), "丙": ("", 1, 4, True, True, "政府客户"),
                   "丁": ("", 1, 4, True, True, "政府客户"), "戊": ("toB", None, 3, True, False, "企业客户"), "己": ("toB", None, 5, True, False, "企业客户")}


def test_customer_lists(spark):
    df = spark.createDataFrame([(f"客户{i:02d}A", "省", i % 3, float(i), 50.0) for i in range(7)],
                               "customer_name string, province string, tender_count int, total_budget double, avg_opportunity_score double")
    got = C.list_customers(C.filter_customers(df, "a"), 2, 3)
    assert (got["total"], got["pages"], [r.customer_name for r in got["rows"].collect()]) == (7, 3, ["客户03A", "客户04A", "客户05A"])
    assert [r.customer_name for r in C.top_customers(df, "tender_count", 2).collect()] == ["客户02A", "客户05A"]
    assert C.top_customers(df, "avg_score", 9, province="省", min_tender_count=1).count() == 4


def test_find_customer(spark):
    names = spark.createDataFrame([("甲大学",), ("大学",), ("甲大学附属医院",), ("ABC",), ("无",)], "name string")
    known = spark.createDataFrame([("甲大学",), ("乙大学",), ("abc集团",)], "customer_name string")
    got = {r.name: (r.found, r.exact) for r in C.find_customer(names, known).collect()}
    assert got == {"甲大学": ("甲大学", True), "大学": ("乙大学", False), "甲大学附属医院": ("甲大学", False), "ABC": ("abc集团", False)}


def test_code_by_name(spark):
    profiles = spark.createDataFrame([("大学",), ("甲大学",), ("无",)], "customer_name string")
    crm = spark.createDataFrame([("甲大学本部", "c2"), ("乙大学", "c1"), ("甲大学本部", "c3")], "customer_name string, credit_code string")
    assert {r.customer_name: r.found_code for r in C.code_by_name(profiles, crm).collect()} == {"大学": "c1", "甲大学": "c2", "无": None}


def test_region(spark):
    orgs = spark.createDataFrame([("南京市东南大学",), ("江苏省厅",), ("某公司",)], "org string")
    places = spark.createDataFrame([("江苏", "江苏省", None), ("南京", "江苏省", "南京市"), ("东南大学", "江苏省", "南京市"), ("南", "错", "错")], "name string, province string, city string")
    got = {r.org: (r.matched_name, r.city) for r in infer_region(orgs, places).collect()}
    assert got == {"南京市东南大学": ("东南大学", "南京市"), "江苏省厅": ("江苏", None), "某公司": (None, None)}


def test_keyword_scores(spark):
    # documented examples: result count, semantic score -> total, tier
    data = [("应急救援设备", 58, 8), ("卫星通信", 11, 8), ("卫星移动通信", 1, 8), ("应急通信设备", 0, 9), ("机器人", 215, 4), ("工业互联网", 24, 6), ("卫星定位", 8, 5)]
    got = {r.keyword: (r.total_score, r.tier, r["rank"]) for r in S.score_keywords(spark.createDataFrame(data, "keyword string, result_count int, semantic int")).collect()}
    assert got == {"应急救援设备": (8.0, "A", 1), "机器人": (7.6, "A", 2), "工业互联网": (6.0, "A", 3), "卫星通信": (5.6, "B", 4), "卫星移动通信": (4.4, "B", 5),
                   "卫星定位": (4.4, "B", 5), "应急通信设备": (3.6, "C", 7)}


def test_stats(spark):
    usage = spark.createDataFrame([("m", 1_000_000, 500_000), ("m", 0, 500_000)], "model string, prompt_tokens long, completion_tokens long")
    assert tuple(S.usage_cost(usage).first()) == ("m", 2, 1_000_000, 1_000_000, 2_000_000, 4.1, 3.2, 5.0)
    urls = spark.createDataFrame([("http://a/x",), ("http://A/x/",), (None,), (" ",), ("http://b",)], "url string")
    assert tuple(S.dedup_stats(urls).first()) == (5, 2, 1, 2)
    packages = spark.createDataFrame([(1, "甲", "灯", 2.0), (1, "乙", "灯", 3.5), (1, "甲", "车", None)], "tender_id int, winning_bidder string, winning_product string, amount double")
    assert tuple(S.winning_rollup(packages).first()) == (1, 3, 2, 2, 5.5)
    parties = {(r.field, r.value) for r in S.winning_parties(packages).collect()}
    assert parties == {("winning_bidder", "甲"), ("winning_bidder", "乙"), ("winning_product", "灯"), ("winning_product", "车")}


def test_lists_and_validation(spark, notices):
    rows = notices.withColumn("announce_type", F.lit("采购公告")).withColumn("content_summary", F.lit("ABC"))
    assert L.list_tenders(rows).count() == 6 and L.list_tenders(rows, keyword="abc", min_budget=100, end_date=D[1]).count() == 2
    bad = spark.createDataFrame([(["a"], "采购公告", 1.0, 50, "tender-structured-v1", "t"), ([None], "x", -1.0, 101, "v0", ""), (None, None, None, None, None, None)],
                                "product_keywords array<string>, announce_type string, budget_amount double, opportunity_score int, schema_version string, extracted_at string")
    assert L.validate(bad).first().errors == ["missing:source_url", "missing:project_name", "missing:buyer_name_std", "missing:content_summary"]
    got = [r.errors for r in L.validate(bad, required=()).collect()]
    assert got == [[], ["product_keywords", "announce_type", "budget_amount", "opportunity_score", "schema_version", "extracted_at"],
                   ["product_keywords", "schema_version", "extracted_at"]]
    pages = spark.createDataFrame([(1, i, "序号 单价" if i % 2 else "x") for i in range(30)] + [(2, i, "x") for i in range(8)], "doc_id int, page int, text string")
    got = [(r.doc_id, r.page) for r in L.table_pages(pages).orderBy("doc_id", "page").collect()]
    assert got == [(1, i) for i in range(1, 21, 2)] + [(2, i) for i in range(5)]


def test_lookups_give_one_row_for_repeated_keys(spark):
    from bidweave.operators import tables as T
    from bidweave.operators.textjoin import infer_region
    one = lambda df: [tuple(r) for r in df.collect()]
    target = spark.createDataFrame([("k", "new", "")], "key string, status string, category string")
    verdicts = spark.createDataFrame([("k", False, "a", ["x"], 1), ("k", True, "b", ["y"], 2)], "key string, keep boolean, reason string, categories array<string>, seq int")
    assert one(T.apply_verdict(target, verdicts, "key", ["seq"])) == [("k", "matched", "y", "b")]
    child, parent = spark.createDataFrame([("u", None)], "on string, uuid string"), spark.createDataFrame([("u", "p1"), ("u", "p2")], "on string, uuid string")
    assert one(T.propagate_key(child, parent, "on", "uuid").select("on", "uuid")) == [("u", "p2")]
    notices = spark.createDataFrame([("u", 1, "a", "d"), ("u", 2, "b", "d")], "detail_url string, id int, uuid string, publish_date string")
    assert one(T.link_structured(spark.createDataFrame([("u",)], "source_url string"), notices).select("tender_id", "uuid")) == [(2, "b")]
    places = spark.createDataFrame([("鼓楼区", "福建", "福州"), ("鼓楼区", "江苏", "南京")], "name string, province string, city string")
    orgs = spark.createDataFrame([("江苏省鼓楼区学校",), ("鼓楼区学校",)], "org string")
    assert {r.org: r.province for r in infer_region(orgs, places).collect()} == {"江苏省鼓楼区学校": "江苏", "鼓楼区学校": min("福建", "江苏")}
    crm = spark.createDataFrame([("c", "n", 1), ("c", "n", 2)], "credit_code string, customer_name string, lead_count int")
    found = C.enhance_profiles(spark.createDataFrame([("c", "n")], "credit_code string, customer_name string"), crm).collect()
    assert len(found) == 1 and found[0].crm_profile.lead_count == 2


def test_joined_lookups_do_not_multiply_rows(spark):
    from bidweave.operators import fusion as FU
    from bidweave.operators import projects as P
    from bidweave.streaming import notices as N
    profiles = spark.createDataFrame([("b", 1, 5.0), ("b", 3, 2.0), (None, 9, 9.0)], "customer_name string, tender_count int, avg_opportunity_score double")
    projects = spark.createDataFrame([("p", "b"), ("q", "x"), ("r", None)], "project_name_std string, buyer_name string")
    got = {r.project_name_std: r.buyer_profile_summary for r in P.with_buyer_summary(projects, profiles).collect()}
    assert len(got) == 3 and got["p"].tender_count == 3 and got["q"] is None and got["r"] is None
    rows = spark.createDataFrame([(1, "b"), (2, None)], "id int, buyer_name_std string")
    assert sorted((r.id, r.tender_count) for r in N.enrich_stream(rows, profiles).collect()) == [(1, 3), (2, None)]
    hits = spark.createDataFrame([(0, 7), (0, 8)], "qid int, doc_id int")
    pages = spark.createDataFrame([(7, "a"), (7, "b")], "doc_id int, url string")
    assert sorted((r.doc_id, r.detail_url) for r in FU.with_detail_url(hits, pages).collect()) == [(7, "b"), (8, None)]


def test_winning_rollup_counts_values_once(spark):
    from bidweave.operators import stats as S
    rows = [("t", "a", "x", 1.5), ("t", "a", "y", 2.0), ("t", None, "y", None), ("t", "b", None, 1.0), ("u", None, None, None)]
    got = {r.tender_id: (r.packages, r.bidders, r.products, r.winning_amount) for r in S.winning_rollup(
        spark.createDataFrame(rows, "tender_id string, winning_bidder string, winning_product string, amount double")).collect()}
    assert got == {"t": (4, 2, 2, 4.5), "u": (1, 0, 0, None)}


def test_upsert_with_numbers_and_one_model_call_per_miss(spark):
    from bidweave.operators import infer as I
    from bidweave.operators import tables as T
    target = spark.createDataFrame([("a", 1.0, "x", "old")], "key string, price double, name string, status string")
    batch = spark.createDataFrame([("a", None, "y", 1), ("a", 3.0, "", 2), ("b", None, "z", 3)], "key string, price double, name string, seq int")
    got = {r.key: (r.price, r.name, r.status) for r in T.upsert_nonempty(target, batch, "key", ["seq"]).collect()}
    assert got == {"a": (3.0, "y", "new"), "b": (None, "z", "new")}
    calls = spark.sparkContext.accumulator(0)

    def model():
        def answer(prompts):
            calls.add(len(prompts))
            return [f"切入点 {p}" for p in prompts]
        return answer
    requests = spark.createDataFrame([(f"k{i % 6}", f"p{i % 6}") for i in range(12)], "cache_key string, prompt string")
    cache = spark.createDataFrame([("k0", "known", 1)], "cache_key string, suggestions string, created_at int")
    answers, fresh = I.suggest(requests, cache, model)
    assert answers.count() == 12 and fresh.count() == 5 and calls.value == 5
    details = spark.createDataFrame([("u", "t1", "d", "c"), ("u", "t2", "d", "c")], "url string, title string, publish_date string, content string")
    assert I.extract_structured(details, model=("m", model)).count() == 2
