"""Customer profiles from notices, CRM summaries, and their merge.

A profile is three tables instead of one nested document, because a buyer may own a large
share of all notices: a flat row per customer, a long table of its distinct values
(keywords, scenarios, winners, ...), and its history rows. `nest_values` builds the nested
form in bounded parts when a document is wanted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidweave import rules
from bidweave.functions.jsonx import as_array
from bidweave.functions.names import customer_type_label, filled_name, tier
from bidweave.functions.text import (array_truthy, first_text, not_nan, number_truthy, text_truthy)
from bidweave.operators.keys import collect_parts, keep_first, keep_last, one_per_key, top_k, union_all
from bidweave.operators.textjoin import least_by_pattern, least_by_text

# Value kinds of a profile: field name -> (source column, is it text that may hold a JSON array)
VALUE_FIELDS = {
    "tech_keywords": ("product_keywords", True),
    "application_scenarios": ("application_scenario", False),
    "past_winners": ("winning_bidder", True),
    "past_winning_products": ("winning_product", False),
    "persons": ("contact_person", False),
    "phones": ("contact_phone", False),
}


def _rows(structured: DataFrame, buyer: str) -> DataFrame:
    return structured.filter(filled_name(buyer)).withColumnRenamed(buyer, "customer_name")


def customer_profiles(structured: DataFrame, buyer: str = "buyer_name_std",
                      order: Sequence[str] = ("publish_date", "source_url")) -> DataFrame:
    """Flat profile per buyer: first filled place, notice count, budget sum, mean score."""
    seq = F.struct(*order)
    return _rows(structured, buyer).groupBy("customer_name").agg(
        F.min_by("province", F.when(text_truthy("province"), seq)).alias("province"),
        F.min_by("city", F.when(text_truthy("city"), seq)).alias("city"),
        F.count("*").alias("tender_count"),
        F.round(F.coalesce(F.sum("budget_amount"), F.lit(0.0)), 2).alias("total_budget"),
        F.coalesce(F.round(F.avg(F.when(number_truthy("opportunity_score"), F.col("opportunity_score"))), 2),
                   F.lit(0.0)).alias("avg_opportunity_score"))


def profile_values(structured: DataFrame, buyer: str = "buyer_name_std",
                   fields: dict[str, tuple[str, bool]] | None = None) -> DataFrame:
    """Distinct (customer, field, value) rows. Arrays and JSON-array texts are unfolded."""
    fields = fields or VALUE_FIELDS
    types = dict(structured.dtypes)
    kinds = []
    for field, (source, is_list) in fields.items():
        if source not in types:
            continue
        values = F.col(source) if types[source].startswith("array") else (
            as_array(source) if is_list else F.array(F.col(source)))
        kinds.append(F.struct(F.lit(field).alias("field"), values.alias("_values")))
    rows = _rows(structured, buyer).select("customer_name", F.inline(F.array(*kinds)))
    return (rows.select("customer_name", "field", F.explode("_values").alias("value"))
            .filter(text_truthy("value")).distinct())


def profile_history(structured: DataFrame, buyer: str = "buyer_name_std") -> DataFrame:
    """One row per notice of a customer: name, budget, winning amount, date, URL."""
    return _rows(structured, buyer).select(
        "customer_name", "project_name", F.col("budget_amount").alias("budget"), "winning_amount",
        F.col("publish_date").alias("date"), F.col("source_url").alias("url"))


def nest_values(values: DataFrame, part_rows: int = 1000) -> DataFrame:
    """Sorted value arrays per (customer, field), in parts of bounded size."""
    return collect_parts(values, ["customer_name", "field"], ["value"], ["value"], part_rows, "items").withColumn(
        "items", F.transform("items", lambda i: i["value"]))


def first_values(values: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """The first n values per customer and field, one array column per field (summary form)."""
    size = F.lit(0)
    for field, n in sizes.items():
        size = F.when(F.col("field") == field, n).otherwise(size)
    ranked = top_k(values, max(sizes.values()), [F.col("value")], ["customer_name", "field"], "_rank")
    ranked = ranked.filter(F.col("_rank") <= size)
    return ranked.groupBy("customer_name").agg(
        *[F.sort_array(F.collect_list(F.when(F.col("field") == f, F.col("value")))).alias(f) for f in sizes])


def profile_summary(profiles: DataFrame, values: DataFrame) -> DataFrame:
    """Profile row with its first 5 keywords, 3 scenarios and 5 past winners."""
    sizes = {"tech_keywords": 5, "application_scenarios": 3, "past_winners": 5}
    wide = profiles.join(first_values(values, sizes), "customer_name", "left")
    empty = F.array().cast("array<string>")
    return wide.select(
        "customer_name", F.struct("province", "city").alias("basic_info"),
        F.struct("tender_count", "total_budget", "avg_opportunity_score").alias("value_profile"),
        F.struct(*[F.coalesce(F.col(c), empty).alias(c) for c in ("tech_keywords", "application_scenarios")]
                 ).alias("demand_profile"),
        F.struct(F.coalesce(F.col("past_winners"), empty).alias("past_winners")).alias("competitive_landscape"))


def flatten_profiles(nested: DataFrame) -> DataFrame:
    """Nested profile documents to the flat table row; lists become JSON text."""
    return nested.select(
        "customer_name", F.col("basic_info.province").alias("province"), F.col("basic_info.city").alias("city"),
        F.to_json("demand_profile.tech_keywords").alias("tech_keywords"),
        F.to_json("demand_profile.application_scenarios").alias("application_scenarios"),
        F.col("value_profile.tender_count").alias("tender_count"),
        F.col("value_profile.total_budget").alias("total_budget"),
        F.col("value_profile.avg_opportunity_score").alias("avg_opportunity_score"),
        F.to_json("competitive_landscape.past_winners").alias("past_winners"),
        F.to_json(F.struct(*nested.columns)).alias("full_profile_json"))


def win_rates(structured: DataFrame, buyer: str = "buyer_name_std", winner: str = "winning_bidder") -> DataFrame:
    """Share of a buyer's winning notices that each winner holds."""
    value = F.col(winner) if dict(structured.dtypes)[winner].startswith("array") else as_array(winner)
    rows = _rows(structured, buyer).select("customer_name", F.filter(F.array_distinct(value), text_truthy).alias("_won")).filter(F.size("_won") > 0)
    wins = rows.select("customer_name", F.explode("_won").alias("winner")).groupBy("customer_name", "winner").agg(F.count("*").alias("wins"))
    totals = rows.groupBy("customer_name").agg(F.count("*").alias("_all"))
    return wins.join(totals, ["customer_name"]).select(
        "customer_name", "winner", "wins", F.round(F.col("wins") / F.col("_all"), 4).alias("win_rate"))


# --- customer lists -------------------------------------------------------------------

def filter_customers(profiles: DataFrame, search: str | None = None, kind: str | None = None) -> DataFrame:
    """Name contains the text (any case); kind 'tender' or 'crm' asks for that kind of data."""
    out = profiles
    if search:
        out = out.filter(F.contains(F.lower("customer_name"), F.lit(search.lower())))
    if kind in ("tender", "crm"):
        flag = F.coalesce(F.col(f"has_{kind}_data"), F.lit(False))
        if kind == "tender" and "tech_keywords" in out.columns:
            flag = flag | array_truthy("tech_keywords")
        if kind == "crm":
            for c in ("opportunity_count", "lead_count"):
                flag = flag | (number_truthy(c) if c in out.columns else F.lit(False))
        out = out.filter(flag)
    return out


def list_customers(profiles: DataFrame, number: int = 1, size: int = 20) -> dict:
    """One page of customers by name, with total and page count."""
    total = profiles.count()
    rows = profiles.orderBy("customer_name").offset((number - 1) * size).limit(size)
    return {"rows": rows, "total": total, "page": number, "size": size, "pages": -(-total // size)}


def top_customers(profiles: DataFrame, metric: str = "tender_count", k: int = 20, province: str | None = None,
                  min_tender_count: int = 0) -> DataFrame:
    """The k customers with the highest metric; ties by name."""
    name = {"avg_score": "avg_opportunity_score"}.get(metric, metric)
    out = profiles.filter(F.col("tender_count") >= min_tender_count)
    if province:
        out = out.filter(F.contains(F.coalesce(F.col("province"), F.lit("")), F.lit(province)))
    return out.orderBy(F.col(name).desc(), F.col("customer_name")).limit(k)


# --- CRM ----------------------------------------------------------------------------------

def _share(part: Column, whole: Column) -> Column:
    return F.round(part / whole, 2)


def _opportunity_numbers(status: dict[str, Sequence[str]], mine: Column) -> list[Column]:
    n, signed = F.count_if(mine), F.count_if(mine & F.col("followup_status").isin(*status["signed"]))
    return [n.alias("total_count"), F.round(F.coalesce(F.sum(F.when(mine, F.col("value"))), F.lit(0.0)), 2).alias("total_value"),
            F.count_if(mine & F.col("opportunity_status").isin(*status["active"])).alias("active_count"),
            F.count_if(mine & F.col("opportunity_status").isin(*status["closed"])).alias("closed_count"),
            signed.alias("signed_count"), _share(signed, n).alias("conversion_rate")]


def _lead_numbers(status: dict[str, Sequence[str]], mine: Column) -> list[Column]:
    n, converted = F.count_if(mine), F.count_if(mine & F.col("lead_status").isin(*status["converted"]))
    return [n.alias("total_count"), F.round(F.coalesce(F.sum(F.when(mine, F.col("lead_value"))), F.lit(0.0)), 2).alias("total_value"),
            F.count_if(mine & F.col("lead_status").isin(*status["active"])).alias("active_count"),
            converted.alias("converted_count"),
            F.count_if(mine & F.col("lead_status").isin(*status["abandoned"])).alias("abandoned_count"),
            _share(converted, n).alias("conversion_rate")]


def opportunity_summary(opps: DataFrame, by: Sequence[str] = ("credit_code",),
                        status: dict[str, Sequence[str]] = rules.OPPORTUNITY_STATUS) -> DataFrame:
    """Counts, value and conversion rate of opportunities."""
    return opps.groupBy(*by).agg(*_opportunity_numbers(status, F.lit(True)))


def lead_summary(leads: DataFrame, by: Sequence[str] = ("credit_code",),
                 status: dict[str, Sequence[str]] = rules.LEAD_STATUS) -> DataFrame:
    """Counts, value and conversion rate of leads."""
    return leads.groupBy(*by).agg(*_lead_numbers(status, F.lit(True)))


def _sourced(opps: DataFrame, leads: DataFrame, opp_cols: dict[str, str], lead_cols: dict[str, str]) -> DataFrame:
    """Opportunity rows before lead rows, the named columns mapped to common names."""
    def side(df: DataFrame, cols: dict[str, str], rank: int, seq: str, source: str) -> DataFrame:
        return df.select("credit_code", F.lit(rank).alias("_src"), F.col(seq).cast("string").alias("_seq"),
                         F.lit(source).alias("source"),
                         *[(F.col(c) if c else F.lit(None).cast("string")).alias(n) for n, c in cols.items()])
    return union_all(side(opps, opp_cols, 0, "opportunity_id", rules.SOURCE_OPPORTUNITY),
                     side(leads, lead_cols, 1, "lead_id", rules.SOURCE_LEAD))


def crm_contacts(opps: DataFrame, leads: DataFrame) -> DataFrame:
    """One contact per (code, person): opportunities before leads, first wins."""
    cols = {"name": "contact_person", "position": "contact_position", "customer_name": "customer_name"}
    rows = _sourced(opps, leads, cols, cols).filter(not_nan("name"))
    return keep_first(rows, ["credit_code", "name"], [F.col("_src"), F.col("_seq")]).drop("_src", "_seq")


def _segment() -> Column:
    return F.min_by("segment", F.when(not_nan("segment"), F.struct("_src", "_seq"))).alias("customer_segment")


def _relationship() -> list[Column]:
    usable, is_opp = not_nan("person"), F.col("_src") == 0
    time = F.when(not_nan(F.col("time").cast("string")), F.col("time"))
    return [F.min_by("person", F.when(usable & is_opp, F.col("_seq"))).alias("primary_sales"),
            F.min_by("person", F.when(usable & ~is_opp, F.col("_seq"))).alias("secondary_sales"),
            F.min(time).alias("first_contact_date"), F.max(time).alias("last_followup_date"),
            tier(F.count("*"), rules.RELATION_TIERS, rules.RELATION_REST).alias("relationship_level"),
            F.count("*").alias("total_interactions")]


def customer_segment(opps: DataFrame, leads: DataFrame) -> DataFrame:
    """First usable customer type per code."""
    rows = _sourced(opps, leads, {"segment": "customer_type"}, {"segment": "customer_segment"})
    return rows.groupBy("credit_code").agg(_segment())


def sales_relationship(opps: DataFrame, leads: DataFrame) -> DataFrame:
    """First owner and salesperson, first and last contact, closeness by number of interactions."""
    rows = _sourced(opps, leads, {"person": "owner", "time": "report_time"},
                    {"person": "salesperson", "time": "lead_acquisition_time"})
    return rows.groupBy("credit_code").agg(*_relationship())


def sales_people(opps: DataFrame, leads: DataFrame) -> DataFrame:
    """Distinct (code, role, person) rows: all owners and all salespersons."""
    rows = _sourced(opps, leads, {"person": "owner"}, {"person": "salesperson"}).filter(not_nan("person"))
    role = F.when(F.col("_src") == 0, F.lit("owner")).otherwise(F.lit("salesperson"))
    return rows.select("credit_code", role.alias("role"), "person").distinct()


def all_codes(opps: DataFrame, leads: DataFrame) -> DataFrame:
    return (opps.select("credit_code").union(leads.select("credit_code"))
            .filter(text_truthy(F.col("credit_code").cast("string"))).distinct())


def crm_only_codes(crm: DataFrame, tender: DataFrame, code: str = "credit_code") -> DataFrame:
    """CRM codes that no notice profile carries."""
    return crm.select(code).distinct().join(tender.select(code), code, "left_anti")


def crm_by_code(opps: DataFrame, leads: DataFrame) -> DataFrame:
    """One row per code in either source, the two summaries and the sales relationship side by side. Both
    sources are read once, as one union, and grouped once."""
    opp = {"customer_name": "customer_name", "segment": "customer_type", "person": "owner", "time": "report_time", "value": "value",
           "opportunity_status": "opportunity_status", "followup_status": "followup_status"}
    lead = {"customer_name": "customer_name", "segment": "customer_segment", "person": "salesperson", "time": "lead_acquisition_time",
            "lead_value": "lead_value", "lead_status": "lead_status"}
    rows = _sourced(opps, leads, opp, lead)
    is_opp, is_lead = F.col("_src") == 0, F.col("_src") == 1
    return rows.groupBy("credit_code").agg(
        F.when(F.count_if(is_opp) > 0, F.struct(*_opportunity_numbers(rules.OPPORTUNITY_STATUS, is_opp))).alias("opportunity_summary"),
        F.when(F.count_if(is_lead) > 0, F.struct(*_lead_numbers(rules.LEAD_STATUS, is_lead))).alias("lead_summary"),
        F.struct(*_relationship()).alias("sales_relationship"), _segment(),
        F.min_by("customer_name", F.when(text_truthy("customer_name"), F.struct("_src", "_seq"))).alias("customer_name"))


def crm_history(opps: DataFrame, leads: DataFrame) -> DataFrame:
    """Opportunities and leads of a code as rows of one table."""
    return union_all(opps.withColumn("kind", F.lit("opportunity")), leads.withColumn("kind", F.lit("lead")))


# --- matching profiles with CRM ---------------------------------------------------------------

def code_by_name(profiles: DataFrame, crm: DataFrame, name: str = "customer_name", crm_name: str = "customer_name",
                 code: str = "credit_code") -> DataFrame:
    """Code of the first CRM customer (lowest code) whose name contains the given name."""
    known = crm.groupBy(F.col(crm_name).alias("text")).agg(F.min(code).alias("found_code"))
    found = least_by_pattern(profiles.select(F.col(name).alias("pattern")), known, "found_code")
    return profiles.join(found.withColumnRenamed("pattern", name), [name], "left")


def find_customer(names: DataFrame, profiles: DataFrame, name: str = "name", customer: str = "customer_name") -> DataFrame:
    """Profile for each name: the same name, else the first customer (by name) where one name
    contains the other, any case."""
    asked = names.select(F.col(name).alias("asked")).distinct().withColumn("pattern", F.lower("asked"))
    known = profiles.select(F.col(customer).alias("found")).distinct().withColumn("text", F.lower("found"))
    inside = least_by_pattern(asked.select("pattern"), known, "found")
    around = least_by_text(known.select(F.col("text").alias("pattern"), "found"), asked.select(F.col("pattern").alias("text")).distinct(), "found")
    # the same name is a row of its own, the others keep one customer per side
    near = inside.unionByName(around.withColumnRenamed("text", "pattern")).join(asked, "pattern").select("asked", "found")
    same = asked.select("asked").join(known.select("found"), F.col("asked") == F.col("found")).filter(F.length("asked") > 0)
    best = near.unionByName(same).groupBy("asked").agg(F.min(F.struct((F.col("found") != F.col("asked")).alias("far"), "found")).alias("best"))
    return best.select(F.col("asked").alias(name), F.col("best.found").alias("found"),
                       (~F.col("best.far")).alias("exact"))


def unify_profiles(tender: DataFrame, crm: DataFrame, fields: Sequence[str] = ("opportunity_count", "opportunity_value",
                                                                             "lead_count", "lead_value"),
                   carry: Sequence[str] = ()) -> DataFrame:
    """Notice profiles joined with CRM by code, else by name, plus CRM-only customers. All columns of the notice profile
    stay (demand, competition, places), and `carry` names CRM columns of any type that come along as they are, such as
    sales_relationship; histories and contacts are rows of their own (crm_history, merge_contacts).

    tender: customer_name, credit_code, customer_type and value columns; crm: customer_name,
    credit_code, customer_type and `fields`. A CRM row is CRM-only when neither its name nor
    its code occurs among the notice profiles; empty keys do not count as a match.
    """
    payload = F.struct(F.col("credit_code"), F.col("customer_type"), *fields, *carry)
    order = ["credit_code", "customer_name"]
    by_code = keep_last(crm.filter(text_truthy("credit_code")), "credit_code", order).select(
        "credit_code", payload.alias("_by_code"))
    by_name = keep_last(crm.filter(text_truthy("customer_name")), "customer_name", order).select(
        "customer_name", payload.alias("_by_name"))
    # profiles without a code meet nothing by code: they stay out of that join, where they would be one hot key
    coded = tender.filter(text_truthy("credit_code")).join(by_code, ["credit_code"], "left")
    bare = tender.filter(~text_truthy("credit_code")).withColumn("_by_code", F.lit(None).cast(by_code.schema["_by_code"].dataType))
    matched = coded.unionByName(bare).join(by_name, ["customer_name"], "left")
    hit = F.coalesce(F.col("_by_code"), F.col("_by_name"))
    rest = [c for c in tender.columns if c not in ("customer_name", "credit_code", "customer_type")]
    merged = matched.select(
        "customer_name", F.coalesce(F.col("credit_code"), F.lit("")).alias("customer_id"),
        first_text(hit["customer_type"], "customer_type").alias("customer_type"), *rest,
        *[hit[f].alias(f) for f in [*fields, *carry]], hit.isNotNull().alias("has_crm_data"),
        F.lit(True).alias("has_tender_data"))
    only = (crm.join(tender.filter(text_truthy("customer_name")).select("customer_name"), "customer_name", "left_anti")
            .join(tender.filter(text_truthy("credit_code")).select("credit_code"), "credit_code", "left_anti")
            .select("customer_name", F.coalesce(F.col("credit_code"), F.lit("")).alias("customer_id"),
                    F.coalesce(F.col("customer_type"), F.lit("")).alias("customer_type"), *fields, *carry,
                    F.lit(True).alias("has_crm_data"), F.lit(False).alias("has_tender_data")))
    both = union_all(merged, only)
    zero = [F.coalesce(F.col(f), F.lit(0)).alias(f) for f in fields]
    return both.select("customer_name", "customer_id", "customer_type", *rest, *zero, *carry, "has_crm_data",
                       "has_tender_data", customer_type_label("has_crm_data", "has_tender_data").alias("customer_kind"))


def merge_contacts(tender_contacts: DataFrame, crm: DataFrame, customer: str = "customer_name") -> DataFrame:
    """Contacts per customer: those of notices first, then CRM contacts whose name is new."""
    both = union_all(tender_contacts.withColumn("_src", F.lit(0)), crm.withColumn("_src", F.lit(1)))
    return keep_first(both.filter(text_truthy("name")), [customer, "name"],
                      [F.col("_src"), F.col("source"), F.col("position")]).drop("_src")


def enhance_profiles(profiles: DataFrame, crm: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Profiles with the (last) CRM row of their code (flagged when missing), plus CRM-only customers."""
    side = one_per_key(crm, "credit_code", order).select("credit_code", F.struct(*[c for c in crm.columns if c not in ("credit_code", "customer_name")]
                                              ).alias("crm_profile"),
                      F.col("customer_name").alias("_name"))
    known = profiles.join(side, ["credit_code"], "left").withColumn(
        "has_crm_data", F.col("crm_profile").isNotNull()).withColumn(
        "source", F.when(F.col("has_crm_data"), F.lit("tender+crm")).otherwise(F.lit("tender"))).withColumn(
        "has_tender_data", F.lit(True)).drop("_name")
    only = side.join(profiles.select("credit_code"), "credit_code", "left_anti").select(
        "credit_code", F.coalesce(F.nullif(F.col("_name"), F.lit("")), F.lit("未知客户")).alias("customer_name"),
        "crm_profile", F.lit(True).alias("has_crm_data"), F.lit("crm").alias("source"),
        F.lit(False).alias("has_tender_data"))
    return union_all(known, only)
