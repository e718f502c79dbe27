"""Constraints as DataFrames of violations: empty means valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

IDENTIFIER = r"^[A-Za-z0-9][A-Za-z0-9_.:-]*$"


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    return child.join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def bad_identifiers(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNull() | ~F.col(key).rlike(IDENTIFIER))


def bad_spans(spans: DataFrame, docs: DataFrame, by: str = "doc_id") -> DataFrame:
    """Spans whose text isn't the document's slice, by code points; a missing document counts."""
    d = docs.select(by, F.col("text").alias("body"))
    same = F.substring("body", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("text")
    return spans.join(d, by, "left").where(~F.coalesce(same & (F.col("end") > F.col("start")) & (F.length("text") == F.col("end") - F.col("start")), F.lit(False))).drop("body")


def gaps_in_order(df: DataFrame, by: str, ordinal: str = "ordinal") -> DataFrame:
    """Rows whose ordinal isn't its place from 0."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(by).orderBy(ordinal)) - 1).where(F.col("_place") != F.col(ordinal)).drop("_place")


def changed(df: DataFrame, text: str, digest: str) -> DataFrame:
    return df.where(~F.coalesce(F.sha2(text, 256) == F.col(digest), F.lit(False)))


def spanning(df: DataFrame, group: str, split: str) -> DataFrame:
    """Groups that lie in more than one split."""
    return df.groupBy(group).agg(F.count_distinct(split).alias("n")).where("n > 1")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side that the other lacks, with repeats: empty if a replay equals its record."""
    return a.exceptAll(b).withColumn("side", F.lit("first")).unionAll(b.exceptAll(a).withColumn("side", F.lit("second")))


def decision_fault(decision: Column, checks: Column, independent: Column) -> Column:
    """Pending rows attest nothing; approved ones have every check and an independent reviewer."""
    return F.when(decision == "pending", independent | F.exists(checks, lambda c: c)).when(decision == "approved", ~independent | ~F.forall(checks, lambda c: c)).otherwise(F.lit(False))
