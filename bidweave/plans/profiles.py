"""Customers: profiles, CRM summaries, matching and merging."""

from pyspark.sql import functions as F

from bidweave.operators import profiles as C
from bidweave.operators.keys import union_all
from bidweave.operators.textjoin import infer_region
from bidweave.plans.registry import (LEAD_STATUS, LEADS, NOTICES, OPPORTUNITIES, OPPORTUNITY_STATUS, query)

PROFILES = f"""{NOTICES}, prof AS (
  SELECT buyer_name_std AS customer_name, arg_min(province, tender_id) AS province, arg_min(city, tender_id) AS city,
    count(*) AS tender_count, round(sum(budget_amount), 2) AS total_budget,
    coalesce(round(avg(opportunity_score) FILTER (opportunity_score <> 0), 2), 0.0) AS avg_opportunity_score
  FROM notices GROUP BY 1)"""
VALUES = f"""{NOTICES}, vals AS (
  SELECT DISTINCT buyer_name_std AS customer_name, field, value FROM (
    SELECT buyer_name_std, 'tech_keywords' AS field, announce_type AS value FROM notices
    UNION ALL SELECT buyer_name_std, 'tech_keywords', city FROM notices
    UNION ALL SELECT buyer_name_std, 'application_scenarios', application_scenario FROM notices
    UNION ALL SELECT buyer_name_std, 'past_winners', winning_bidder FROM notices
    UNION ALL SELECT buyer_name_std, 'persons', contact_person FROM notices) WHERE value <> '')"""


@query("customer_profile", f"WITH {PROFILES} SELECT * FROM prof")
def customer_profile(t):
    return C.customer_profiles(t.notices)


@query("profile_values", f"WITH {VALUES} SELECT * FROM vals")
def profile_values(t):
    return C.profile_values(t.notices)


@query("profile_values_nested", f"""WITH {VALUES}, seq AS (
  SELECT *, row_number() OVER (PARTITION BY customer_name, field ORDER BY value) - 1 AS p FROM vals)
  SELECT customer_name, field, p // 4 AS part, string_agg(value, '|' ORDER BY p) AS vals FROM seq GROUP BY ALL""")
def profile_values_nested(t):
    return C.nest_values(C.profile_values(t.notices), part_rows=4).select(
        "customer_name", "field", "part", F.array_join("items", "|").alias("vals"))


@query("profile_history", f"""WITH {NOTICES} SELECT buyer_name_std AS customer_name, project_name, budget_amount AS budget, winning_amount,
  publish_date AS date, source_url AS url FROM notices""")
def profile_history(t):
    return C.profile_history(t.notices)


@query("profile_summary", f"""WITH {VALUES.replace('notices AS', 'notices AS', 1)}, prof AS (
  SELECT buyer_name_std AS customer_name, count(*) AS tender_count FROM notices GROUP BY 1),
  seq AS (SELECT *, row_number() OVER (PARTITION BY customer_name, field ORDER BY value) AS p FROM vals),
  w AS (SELECT customer_name,
    coalesce(string_agg(value, '|' ORDER BY p) FILTER (field = 'tech_keywords' AND p <= 5), '') AS tech_keywords,
    coalesce(string_agg(value, '|' ORDER BY p) FILTER (field = 'application_scenarios' AND p <= 3), '') AS application_scenarios,
    coalesce(string_agg(value, '|' ORDER BY p) FILTER (field = 'past_winners' AND p <= 5), '') AS past_winners
    FROM seq GROUP BY 1)
  SELECT customer_name, tender_count, coalesce(tech_keywords, '') AS tech_keywords,
    coalesce(application_scenarios, '') AS application_scenarios, coalesce(past_winners, '') AS past_winners
  FROM prof LEFT JOIN w USING (customer_name)""")
def profile_summary(t):
    s = C.profile_summary(C.customer_profiles(t.notices), C.profile_values(t.notices))
    return s.select("customer_name", F.col("value_profile.tender_count").alias("tender_count"),
                    F.array_join("demand_profile.tech_keywords", "|").alias("tech_keywords"),
                    F.array_join("demand_profile.application_scenarios", "|").alias("application_scenarios"),
                    F.array_join("competitive_landscape.past_winners", "|").alias("past_winners"))


@query("profile_rows", f"""WITH {PROFILES} SELECT customer_name, province, city, tender_count FROM prof""")
def profile_rows(t):
    s = C.profile_summary(C.customer_profiles(t.notices), C.profile_values(t.notices))
    return C.flatten_profiles(s).select("customer_name", "province", "city", "tender_count")


@query("win_rates", f"""WITH {NOTICES}, n AS (
  SELECT tender_id, buyer_name_std AS customer_name, winning_bidder, tender_id % 4 = 0 AS two FROM notices WHERE winning_bidder IS NOT NULL),
  w AS (SELECT customer_name, winner, count(*) AS wins FROM (SELECT customer_name, winning_bidder AS winner FROM n
    UNION ALL SELECT customer_name, 'partner' FROM n WHERE two) GROUP BY 1, 2)
  SELECT w.*, round(wins / a.notices, 4) AS win_rate FROM w JOIN (SELECT customer_name, count(*) AS notices FROM n GROUP BY 1) a USING (customer_name)""")
def win_rates(t):
    """Every fourth won notice has two winners."""
    partner = F.when(F.col("winning_bidder").isNotNull() & (F.col("tender_id") % 4 == 0), F.lit("partner"))
    return C.win_rates(t.notices.withColumn("winning_bidder", F.array_compact(F.array("winning_bidder", partner))))


@query("top_customers", f"""WITH {PROFILES} SELECT customer_name, province, tender_count, total_budget FROM prof
  ORDER BY total_budget DESC, customer_name LIMIT 20""")
def top_customers(t):
    return C.top_customers(C.customer_profiles(t.notices), "total_budget", 20).select(
        "customer_name", "province", "tender_count", "total_budget")


@query("customer_page", f"""WITH {PROFILES} SELECT customer_name, tender_count FROM prof
  WHERE contains(lower(customer_name), '00001') ORDER BY customer_name LIMIT 20 OFFSET 20""")
def customer_page(t):
    found = C.filter_customers(C.customer_profiles(t.notices), search="00001")
    return C.list_customers(found, 2, 20)["rows"].select("customer_name", "tender_count")


# --- CRM ---

OPP_SUMMARY = """SELECT credit_code, count(*) AS total_count, round(sum(value), 2) AS total_value,
  count(*) FILTER (opportunity_status IN ('1-URGENT', '2-HIGH')) AS active_count,
  count(*) FILTER (opportunity_status = '5-LOW') AS closed_count, count(*) FILTER (followup_status = 'F') AS signed_count,
  round(count(*) FILTER (followup_status = 'F') / count(*), 2) AS conversion_rate FROM opps GROUP BY 1"""
LEAD_SUMMARY = """SELECT credit_code, count(*) AS total_count, round(sum(lead_value), 2) AS total_value,
  count(*) FILTER (lead_status IN ('click', 'view')) AS active_count,
  count(*) FILTER (lead_status = 'purchase') AS converted_count, count(*) FILTER (lead_status = 'error') AS abandoned_count,
  round(count(*) FILTER (lead_status = 'purchase') / count(*), 2) AS conversion_rate FROM leads GROUP BY 1"""
RELATIONSHIP = """both_rows AS (
  SELECT credit_code, 0 AS src, opportunity_id AS seq, owner AS person, report_time AS time FROM opps
  UNION ALL SELECT credit_code, 1, lead_id, salesperson, lead_acquisition_time FROM leads)"""


@query("opportunity_summary", f"WITH {OPPORTUNITIES} {OPP_SUMMARY}")
def opportunity_summary(t):
    return C.opportunity_summary(t.opportunities, status=OPPORTUNITY_STATUS)


@query("lead_summary", f"WITH {LEADS} {LEAD_SUMMARY}")
def lead_summary(t):
    return C.lead_summary(t.leads, status=LEAD_STATUS)


@query("sales_relationship", f"""WITH {OPPORTUNITIES}, {LEADS}, {RELATIONSHIP}
  SELECT credit_code, arg_min(person, seq) FILTER (src = 0 AND person <> 'nan') AS primary_sales,
    arg_min(person, seq) FILTER (src = 1 AND person <> 'nan') AS secondary_sales,
    min(time) AS first_contact_date, max(time) AS last_followup_date,
    CASE WHEN count(*) >= 5 THEN '深度合作' WHEN count(*) >= 2 THEN '正常合作' ELSE '初步接触' END AS relationship_level,
    count(*) AS total_interactions FROM both_rows GROUP BY 1""")
def sales_relationship(t):
    return C.sales_relationship(t.opportunities, t.leads)


@query("sales_people", f"""WITH {OPPORTUNITIES}, {LEADS}, {RELATIONSHIP}
  SELECT DISTINCT credit_code, CASE src WHEN 0 THEN 'owner' ELSE 'salesperson' END AS role, person FROM both_rows WHERE person <> 'nan'""")
def sales_people(t):
    return C.sales_people(t.opportunities, t.leads)


@query("crm_contacts", f"""WITH {OPPORTUNITIES}, {LEADS}, c AS (
  SELECT credit_code, contact_person AS name, contact_position AS position, customer_name, '商机列表' AS source, 0 AS src, opportunity_id AS seq FROM opps
  UNION ALL SELECT credit_code, contact_person, contact_position, customer_name, '线索列表', 1, lead_id FROM leads)
  SELECT credit_code, name, position, customer_name, source FROM c
  QUALIFY row_number() OVER (PARTITION BY credit_code, name ORDER BY src, seq) = 1""")
def crm_contacts(t):
    return C.crm_contacts(t.opportunities, t.leads)


@query("customer_segment", f"""WITH {OPPORTUNITIES}, {LEADS}, c AS (
  SELECT credit_code, customer_type AS s, 0 AS src, opportunity_id AS seq FROM opps
  UNION ALL SELECT credit_code, customer_segment, 1, lead_id FROM leads)
  SELECT credit_code, s AS customer_segment FROM c QUALIFY row_number() OVER (PARTITION BY credit_code ORDER BY src, seq) = 1""")
def customer_segment(t):
    return C.customer_segment(t.opportunities, t.leads)


@query("crm_by_code", f"""WITH {OPPORTUNITIES}, {LEADS}, o AS (SELECT credit_code, count(*) AS n, round(sum(value), 2) AS v FROM opps GROUP BY 1),
  l AS (SELECT credit_code, count(*) AS n, round(sum(lead_value), 2) AS v FROM leads GROUP BY 1)
  SELECT coalesce(o.credit_code, l.credit_code) AS credit_code, o.n AS opportunities, o.v AS opportunity_value,
    l.n AS leads, l.v AS lead_value, coalesce(o.n, 0) + coalesce(l.n, 0) AS total_interactions
  FROM o FULL JOIN l ON o.credit_code = l.credit_code""")
def crm_by_code(t):
    return C.crm_by_code(t.opportunities, t.leads).select(
        "credit_code", F.col("opportunity_summary.total_count").alias("opportunities"),
        F.col("opportunity_summary.total_value").alias("opportunity_value"), F.col("lead_summary.total_count").alias("leads"),
        F.col("lead_summary.total_value").alias("lead_value"), "sales_relationship.total_interactions")


@query("all_codes", f"""WITH {OPPORTUNITIES}, {LEADS} SELECT credit_code FROM opps UNION SELECT credit_code FROM leads""")
def all_codes(t):
    return C.all_codes(t.opportunities, t.leads)


@query("crm_only_anti", f"""WITH {OPPORTUNITIES}, {LEADS} SELECT DISTINCT credit_code FROM opps
  WHERE credit_code NOT IN (SELECT credit_code FROM leads)""")
def crm_only_anti(t):
    return C.crm_only_codes(t.opportunities, t.leads)


# Customers with leads and all suppliers are the CRM side of the merge.
CRM_SIDE = f"""{LEADS}, crm AS (
  SELECT max(customer_name) AS customer_name, credit_code, 'lead' AS customer_type, CAST(0 AS BIGINT) AS opportunity_count,
    0.0::DOUBLE AS opportunity_value, count(*) AS lead_count, round(sum(lead_value), 2) AS lead_value FROM leads GROUP BY credit_code
  UNION ALL SELECT s_name, 'S' || s_suppkey, 'supplier', count(l_orderkey), round(coalesce(sum(l_extendedprice), 0.0), 2), 0, 0.0
  FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey GROUP BY s_name, s_suppkey)"""
TENDER_SIDE = f"""{PROFILES}, tender AS (
  SELECT prof.*, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE '' END AS credit_code, '' AS customer_type
  FROM prof JOIN customer ON c_name = customer_name)"""


def crm_side(t):
    leads = t.leads.groupBy("credit_code").agg(
        F.max("customer_name").alias("customer_name"), F.count("*").alias("lead_count"),
        F.round(F.sum("lead_value"), 2).alias("lead_value"))
    leads = leads.select("customer_name", "credit_code", F.lit("lead").alias("customer_type"),
                         F.lit(0).cast("long").alias("opportunity_count"), F.lit(0.0).alias("opportunity_value"), "lead_count", "lead_value")
    sold = t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("l_extendedprice").alias("v"))
    suppliers = t.supplier.join(sold, F.col("s_suppkey") == F.col("l_suppkey"), "left").select(
        F.col("s_name").alias("customer_name"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("credit_code"),
        F.lit("supplier").alias("customer_type"), F.coalesce("n", F.lit(0)).alias("opportunity_count"),
        F.round(F.coalesce("v", F.lit(0.0)), 2).alias("opportunity_value"), F.lit(0).cast("long").alias("lead_count"),
        F.lit(0.0).alias("lead_value"))
    return union_all(leads, suppliers)


def tender_side(t):
    key = F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey").cast("string")).otherwise("")
    codes = t.customer.select(F.col("c_name").alias("customer_name"), key.alias("credit_code"), F.lit("").alias("customer_type"))
    return C.customer_profiles(t.notices).join(codes, "customer_name")


@query("profile_merge", f"""WITH {TENDER_SIDE}, {OPPORTUNITIES}, {LEADS},
  o AS (SELECT credit_code, max(customer_name) AS name, count(*) AS n, arg_min(owner, opportunity_id) FILTER (owner <> 'nan') AS owner FROM opps GROUP BY 1),
  l AS (SELECT credit_code, max(customer_name) AS name, count(*) AS n FROM leads GROUP BY 1),
  crm AS (SELECT coalesce(o.credit_code, l.credit_code) AS code, coalesce(o.name, l.name) AS name, o.n AS o, l.n AS l, o.owner FROM o FULL JOIN l ON o.credit_code = l.credit_code)
  SELECT t.customer_name, t.province, t.tender_count, coalesce(c.o, n.o, 0) AS opportunity_count, coalesce(c.l, n.l, 0) AS lead_count, coalesce(c.owner, n.owner) AS primary_sales,
    coalesce(c.o, n.o, 0) + coalesce(c.l, n.l, 0) AS total_interactions
  FROM tender t LEFT JOIN crm c ON t.credit_code <> '' AND t.credit_code = c.code LEFT JOIN crm n ON t.customer_name = n.name""")
def profile_merge(t):
    """Notice profiles with the counts and the sales relationship of their CRM customer."""
    crm = C.crm_by_code(t.opportunities, t.leads).select(
        "customer_name", "credit_code", F.col("customer_segment").alias("customer_type"), F.col("opportunity_summary.total_count").alias("opportunity_count"),
        F.col("lead_summary.total_count").alias("lead_count"), "sales_relationship")
    both = C.unify_profiles(tender_side(t), crm, ["opportunity_count", "lead_count"], ["sales_relationship"]).filter("has_tender_data")
    return both.select("customer_name", "province", "tender_count", "opportunity_count", "lead_count", "sales_relationship.primary_sales",
                       "sales_relationship.total_interactions")


@query("profile_unify", f"""WITH {TENDER_SIDE}, {CRM_SIDE}, hit AS (
  SELECT t.customer_name, t.credit_code, t.tender_count, t.total_budget,
    coalesce(c.customer_type, n.customer_type) AS customer_type, coalesce(c.opportunity_count, n.opportunity_count, 0) AS opportunity_count,
    coalesce(c.opportunity_value, n.opportunity_value, 0) AS opportunity_value, coalesce(c.lead_count, n.lead_count, 0) AS lead_count,
    coalesce(c.lead_value, n.lead_value, 0) AS lead_value, coalesce(c.credit_code, n.credit_code) IS NOT NULL AS has_crm_data
  FROM tender t LEFT JOIN crm c ON t.credit_code <> '' AND t.credit_code = c.credit_code
    LEFT JOIN crm n ON t.customer_name = n.customer_name)
  SELECT customer_name, credit_code AS customer_id, coalesce(customer_type, '') AS customer_type, tender_count, total_budget,
    opportunity_count, opportunity_value, lead_count, lead_value, has_crm_data, true AS has_tender_data, '政府客户' AS customer_kind FROM hit
  UNION ALL SELECT customer_name, credit_code, customer_type, NULL, NULL, opportunity_count, opportunity_value, lead_count, lead_value,
    true, false, '企业客户' FROM crm WHERE customer_name NOT IN (SELECT customer_name FROM tender)
    AND credit_code NOT IN (SELECT credit_code FROM tender WHERE credit_code <> '')""")
def profile_unify(t):
    return C.unify_profiles(tender_side(t), crm_side(t)).drop("province", "city", "avg_opportunity_score")


@query("enhance_profiles", f"""WITH {TENDER_SIDE}, {CRM_SIDE}
  SELECT t.customer_name, t.credit_code, c.lead_count, c.credit_code IS NOT NULL AS has_crm_data,
    CASE WHEN c.credit_code IS NULL THEN 'tender' ELSE 'tender+crm' END AS source, true AS has_tender_data
  FROM tender t LEFT JOIN crm c ON t.credit_code = c.credit_code
  UNION ALL SELECT customer_name, credit_code, lead_count, true, 'crm', false FROM crm
    WHERE credit_code NOT IN (SELECT credit_code FROM tender)""")
def enhance_profiles(t):
    crm = crm_side(t)
    crm = crm.unionByName(crm.withColumn("lead_count", F.col("lead_count") - 1))  # an older row of each code
    found = C.enhance_profiles(tender_side(t).drop("customer_type"), crm)
    return found.select("customer_name", "credit_code", "crm_profile.lead_count", "has_crm_data", "source", "has_tender_data")


@query("merge_contacts", f"""WITH {NOTICES}, {OPPORTUNITIES}, {LEADS}, c AS (
  SELECT DISTINCT buyer_name_std AS customer_name, contact_person AS name, '' AS position, '招标' AS source, 0 AS src FROM notices WHERE contact_person <> ''
  UNION ALL SELECT customer_name, contact_person, contact_position, '商机列表', 1 FROM opps)
  SELECT customer_name, name, position, source FROM c QUALIFY row_number() OVER (PARTITION BY customer_name, name ORDER BY src, source, position) = 1""")
def merge_contacts(t):
    tender = t.notices.select(F.col("buyer_name_std").alias("customer_name"), F.col("contact_person").alias("name"),
                              F.lit("").alias("position"), F.lit("招标").alias("source")).distinct()
    crm = t.opportunities.select("customer_name", F.col("contact_person").alias("name"),
                                 F.col("contact_position").alias("position"), F.lit("商机列表").alias("source"))
    return C.merge_contacts(tender, crm)


@query("code_by_name", """WITH names AS (SELECT DISTINCT substr(c_name, 8, 10) AS customer_name FROM customer)
  SELECT n.customer_name, min(c_custkey) AS found_code FROM names n LEFT JOIN customer ON contains(c_name, n.customer_name) GROUP BY 1""")
def code_by_name(t):
    names = t.customer.select(F.substring("c_name", 8, 10).alias("customer_name")).distinct()
    crm = t.customer.select(F.col("c_name").alias("customer_name"), F.col("c_custkey").alias("credit_code"))
    return C.code_by_name(names, crm)


@query("fuzzy_customer", """WITH names AS (
    SELECT DISTINCT lower(substr(s_name, 10, 9)) AS name FROM supplier UNION SELECT DISTINCT c_name || ' branch' FROM customer
    UNION SELECT c_name FROM customer),
  pairs AS (SELECT name, c_name AS found FROM names JOIN customer
    ON contains(lower(c_name), lower(name)) OR contains(lower(name), lower(c_name)))
  SELECT name, arg_min(found, CASE WHEN found = name THEN '0' ELSE '1' || found END) AS found, bool_or(found = name) AS exact
  FROM pairs GROUP BY 1""")
def fuzzy_customer(t):
    names = union_all(t.supplier.select(F.lower(F.substring("s_name", 10, 9)).alias("name")),
                      t.customer.select(F.concat("c_name", F.lit(" branch")).alias("name")),
                      t.customer.select(F.col("c_name").alias("name")))
    return C.find_customer(names, t.customer.select(F.col("c_name").alias("customer_name")))


@query("infer_region", """WITH o AS (SELECT s_suppkey, s_name || ' of ' || n_name || ' office' AS org FROM supplier JOIN nation ON s_nationkey = n_nationkey),
  g AS (SELECT n_name AS name, r_name AS province, n_name AS city FROM nation JOIN region ON n_regionkey = r_regionkey)
  SELECT s_suppkey, org, name AS matched_name, province, city FROM o LEFT JOIN g ON contains(org, name)
  QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY length(name) DESC, name) = 1""")
def region(t):
    orgs = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", F.concat("s_name", F.lit(" of "), "n_name", F.lit(" office")).alias("org"))
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("name"), F.col("r_name").alias("province"), F.col("n_name").alias("city"))
    twins = places.withColumns({"province": F.lit("ZZ"), "city": F.lit("other")})  # every name also stands for a second place
    return infer_region(orgs, places.unionByName(twins)).select("s_suppkey", "org", "matched_name", "province", "city")
