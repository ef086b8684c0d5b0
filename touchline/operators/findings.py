"""Findings: one row per emitted rule, with severity, count and JSON details."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Why each severity matters.
SEVERITIES = {
    "info": "Descriptive evidence that does not invalidate the data by itself.",
    "warning": "Anomaly that needs review or explicit treatment before the data is reused.",
    "critical": "Missing coverage or meaning that can create fictitious signal.",
}


def finding(code: str, severity: str, count: Column, message: str, details: Sequence[Column] = ()) -> Column:
    """A finding struct, NULL when its count is not positive."""
    if severity not in SEVERITIES:
        raise ValueError(f"unknown severity {severity}")
    extra = F.to_json(F.struct(*details)) if details else F.lit(None).cast("string")
    return F.when(
        count > 0,
        F.struct(
            F.lit(code).alias("code"), F.lit(severity).alias("severity"),
            F.lit(SEVERITIES[severity]).alias("severity_rationale"), F.lit(message).alias("message"),
            count.cast("bigint").alias("count"), extra.alias("details"),
        ),
    )


def collect_findings(facts: DataFrame, rules: Sequence[Column]) -> DataFrame:
    """Rules over a one-row table of facts to one row per finding."""
    # The outer form keeps the rules from being copied into an inferred filter.
    return facts.select(F.inline_outer(F.array(*rules))).filter(F.col("code").isNotNull())


def side_by_side(parts: Sequence[DataFrame]) -> DataFrame:
    """One-row aggregates as one row: a union and one aggregate over as many rows, no joins."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return every.agg(*[F.first(c, ignorenulls=True).alias(c) for c in every.columns])


def union_findings(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def severity_summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count(F.lit(1)).alias("findings"))
