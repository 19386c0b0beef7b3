"""CRM exports: header mapping, text defaults, numbers and yes/no fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidweave import rules
from bidweave.functions.names import safe_float, safe_str, yes_no
from bidweave.functions.text import text_truthy


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """A CRM export saved as CSV with a header; all columns are text."""
    return spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)


def _load(raw: DataFrame, mapping: dict[str, str]) -> DataFrame:
    out = []
    for header, field in mapping.items():
        source = F.col(f"`{header}`") if header in raw.columns else F.lit(None).cast("string")
        value = safe_float if field in rules.CRM_NUMBERS else yes_no if field in rules.CRM_FLAGS else safe_str
        out.append(value(source).alias(field))
    return raw.select(*out).filter(text_truthy("credit_code"))


def load_opportunities(raw: DataFrame, mapping: dict[str, str] = rules.OPPORTUNITY_COLUMNS) -> DataFrame:
    """Opportunity rows that carry a credit code."""
    return _load(raw, mapping)


def load_leads(raw: DataFrame, mapping: dict[str, str] = rules.LEAD_COLUMNS) -> DataFrame:
    """Lead rows that carry a credit code."""
    return _load(raw, mapping)
