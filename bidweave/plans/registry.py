"""Registry of queries and the roles the driver tables play."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidweave.sources.files import read_texts

Query = Callable[["Tables"], DataFrame]
TEXTS = {"documents": "doc_id", "pages": "page_id"}  # tables of long texts and their keys
QUERIES: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with its SQL twin where SQL can say it."""
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = (fn, sql.strip() if sql else None)
        return fn
    return add


class Tables:
    """Lazy access to the tables of one folder, plain and in their roles."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        path = f"{self.folder}/{name}.parquet"
        return read_texts(self.spark, path, TEXTS[name]) if name in TEXTS else self.spark.read.parquet(path)

    @property
    def notices(self) -> DataFrame:
        """Orders as structured notices, customers as buyers, nations as provinces."""
        buyers = self.customer.join(self.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
            "c_custkey", "c_name", "c_mktsegment", "n_name")
        rows = self.orders.join(buyers, F.col("o_custkey") == F.col("c_custkey"))
        kind = (F.when(F.col("o_orderstatus") == "F", "中标公告").when(F.col("o_orderstatus") == "O", "公开招标公告")
                .otherwise("更正公告"))
        won = F.col("o_orderstatus") == "F"
        return rows.select(
            F.col("o_orderkey").alias("tender_id"),
            F.concat(F.lit("P"), (F.col("o_orderkey") % 3).cast("string"), kind).alias("project_name"),
            F.col("c_name").alias("buyer_name_std"), F.col("n_name").alias("province"), F.col("c_mktsegment").alias("city"),
            F.col("o_orderpriority").alias("announce_type"), F.col("o_totalprice").alias("budget_amount"),
            F.col("o_orderdate").alias("publish_date"), F.when(won, F.col("o_totalprice")).alias("winning_amount"),
            F.when(won, F.concat(F.lit("W"), (F.col("o_custkey") % 7).cast("string"))).alias("winning_bidder"),
            (F.col("o_orderkey") % 101).alias("opportunity_score"),
            F.concat(F.lit("http://notices.example.com/n/"), F.col("o_orderkey").cast("string")).alias("source_url"),
            F.concat_ws(" ", "o_orderpriority", "c_mktsegment").alias("content_summary"),
            F.col("c_mktsegment").alias("application_scenario"), F.col("o_orderstatus").alias("technical_requirements_summary"),
            F.array("o_orderpriority", "c_mktsegment").alias("product_keywords"),
            F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.concat(F.lit("C"), (F.col("o_custkey") % 11).cast("string"))
                                                              ).alias("contact_person"))

    @property
    def opportunities(self) -> DataFrame:
        """Orders as CRM opportunities."""
        buyers = self.customer.select("c_custkey", "c_name", "c_mktsegment")
        return self.orders.join(buyers, F.col("o_custkey") == F.col("c_custkey")).select(
            F.col("o_custkey").cast("string").alias("credit_code"), F.col("o_orderkey").cast("string").alias("opportunity_id"),
            F.col("c_name").alias("customer_name"), F.col("o_orderpriority").alias("opportunity_status"),
            F.col("o_orderstatus").alias("followup_status"), F.col("o_totalprice").alias("value"),
            F.when(F.col("o_orderstatus") == "P", "nan").otherwise(F.col("o_orderpriority")).alias("owner"),
            F.concat(F.lit("C"), (F.col("o_orderkey") % 13).cast("string")).alias("contact_person"),
            F.col("o_orderstatus").alias("contact_position"), F.col("c_mktsegment").alias("customer_type"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("report_time"))

    @property
    def leads(self) -> DataFrame:
        """Events as CRM leads of the customer with the same number."""
        buyers = self.customer.select("c_custkey", "c_name")
        return self.events.join(buyers, F.col("user_id") == F.col("c_custkey"), "left").select(
            F.col("user_id").cast("string").alias("credit_code"), F.col("event_id").cast("string").alias("lead_id"),
            F.coalesce("c_name", F.lit("")).alias("customer_name"), F.col("event_type").alias("lead_status"),
            F.col("value").alias("lead_value"),
            F.concat(F.lit("S"), (F.col("event_id") % 9).cast("string")).alias("salesperson"),
            F.concat(F.lit("C"), (F.col("event_id") % 17).cast("string")).alias("contact_person"),
            F.col("event_type").alias("contact_position"), F.col("event_type").alias("customer_segment"),
            F.date_format("ts", "yyyy-MM-dd").alias("lead_acquisition_time"))


NOTICES = """notices AS (
  SELECT o_orderkey AS tender_id,
    'P' || (o_orderkey % 3) || CASE o_orderstatus WHEN 'F' THEN '中标公告' WHEN 'O' THEN '公开招标公告' ELSE '更正公告' END AS project_name,
    'P' || (o_orderkey % 3) AS project_name_std,
    c_name AS buyer_name_std, n_name AS province, c_mktsegment AS city, o_orderpriority AS announce_type,
    o_totalprice AS budget_amount, o_orderdate AS publish_date,
    CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS winning_amount,
    CASE WHEN o_orderstatus = 'F' THEN 'W' || (o_custkey % 7) END AS winning_bidder,
    o_orderkey % 101 AS opportunity_score, 'http://notices.example.com/n/' || o_orderkey AS source_url,
    o_orderpriority || ' ' || c_mktsegment AS content_summary, c_mktsegment AS application_scenario,
    o_orderstatus AS technical_requirements_summary,
    CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'C' || (o_custkey % 11) END AS contact_person,
    CASE o_orderstatus WHEN 'F' THEN '中标' WHEN 'O' THEN '招标' ELSE '更正' END AS type
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

OPPORTUNITIES = """opps AS (
  SELECT CAST(o_custkey AS VARCHAR) AS credit_code, CAST(o_orderkey AS VARCHAR) AS opportunity_id, c_name AS customer_name,
    o_orderpriority AS opportunity_status, o_orderstatus AS followup_status, o_totalprice AS value,
    CASE WHEN o_orderstatus = 'P' THEN 'nan' ELSE o_orderpriority END AS owner, 'C' || (o_orderkey % 13) AS contact_person,
    o_orderstatus AS contact_position, c_mktsegment AS customer_type, strftime(o_orderdate, '%Y-%m-%d') AS report_time
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

LEADS = """leads AS (
  SELECT CAST(user_id AS VARCHAR) AS credit_code, CAST(event_id AS VARCHAR) AS lead_id, coalesce(c_name, '') AS customer_name,
    event_type AS lead_status, value AS lead_value, 'S' || (event_id % 9) AS salesperson, 'C' || (event_id % 17) AS contact_person,
    event_type AS contact_position, event_type AS customer_segment, strftime(ts, '%Y-%m-%d') AS lead_acquisition_time
  FROM events LEFT JOIN customer ON user_id = c_custkey)"""

OPPORTUNITY_STATUS = {"active": ["1-URGENT", "2-HIGH"], "closed": ["5-LOW"], "signed": ["F"]}
LEAD_STATUS = {"active": ["click", "view"], "converted": ["purchase"], "abandoned": ["error"]}
