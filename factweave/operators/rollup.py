"""Pre-aggregates computed on demand: group counts, running statistics, last-seen times and absences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.facts import DocTable, FactTable


def group_counts(facts: FactTable | DocTable, attrs: list[str] | None = None) -> DataFrame:
    """(item_id, attr, value, n, first_at, last_at): documents per item and value; times are 0 where no document is dated.

    Repeated (document, attribute) rows count once.
    """
    rows = facts.scalars()
    if attrs is not None:
        rows = rows.where(F.col("attr").isin(*attrs))
    rows = rows.groupBy("item_id", "attr", "value", "doc_id").agg(F.min("at").alias("lo"), F.max("at").alias("hi")) if isinstance(facts, DocTable) else rows.select("item_id", "attr", "value", "doc_id", F.col("at").alias("lo"), F.col("at").alias("hi"))
    return rows.groupBy("item_id", "attr", "value").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.min("lo"), F.lit(0)).alias("first_at"), F.coalesce(F.max("hi"), F.lit(0)).alias("last_at"))


def group_count(facts: FactTable | DocTable, item_id, attr: str, value: str) -> DataFrame:
    """One row (n, first_at, last_at) for one cell; zeros if it has no document. The scan is filtered by item first."""
    rows = facts.scalars().where((F.col("item_id") == item_id) & (F.col("attr") == attr) & (F.col("value") == value))
    return rows.agg(F.count_distinct("doc_id").alias("n"), F.coalesce(F.min("at"), F.lit(0)).alias("first_at"), F.coalesce(F.max("at"), F.lit(0)).alias("last_at"))


def group_members(facts: FactTable | DocTable, item_id, attr: str, value: str) -> DataFrame:
    rows = facts.scalars().where((F.col("item_id") == item_id) & (F.col("attr") == attr) & (F.col("value") == value))
    return rows.select("doc_id").distinct()


def stats(facts: FactTable | DocTable, *attrs: str) -> DataFrame:
    """(path, n, mean, m2, min, max) of numeric attributes: distinct (document, value) pairs in document mode."""
    rows = facts.numerics(*attrs)
    if isinstance(facts, DocTable):
        rows = rows.distinct()
    v = F.col("value")
    return rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(F.lit(1))).alias("m2"), F.min(v).alias("min"), F.max(v).alias("max"))


def last_seen(facts: FactTable | DocTable) -> DataFrame:
    """(item_id, type, last_at) for all items and types."""
    return facts.events().groupBy("item_id", "type").agg(F.max("at").alias("last_at"))


def absences(facts: FactTable | DocTable, gap: int) -> DataFrame:
    """(item_id, type, last_at, gap): what was last seen more than ``gap`` nanoseconds before the log's latest event.

    One pass over the log: the latest time is taken from the aggregated rows.
    """
    seen = last_seen(facts)
    latest = seen.agg(F.max("last_at").alias("latest"))  # one row
    rows = seen.join(F.broadcast(latest)).withColumn("gap", F.col("latest") - F.col("last_at"))
    return rows.where(F.col("gap") > gap).drop("latest")
