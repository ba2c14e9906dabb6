"""Metrics tables to findings tables (one row per finding)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline import fixed_values as V
from gaugeline.functions.render import general4, percent_text, quoted, short_float

FINDING_FIELDS = ("issue", "severity", "column", "evidence", "impact", "recommendation")
FINDING_TYPE = "struct<" + ",".join(f"`{f}`:string" for f in FINDING_FIELDS) + ">"


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _finding(
    metrics: DataFrame, tool: str, texts: tuple[str, str, str], severity: Column, column: Column,
    evidence: Column, issue: Column | None = None, position: Column | None = None,
) -> DataFrame:
    return metrics.select(
        F.lit(tool).alias("source_tool"),
        (F.lit(0) if position is None else position).cast("int").alias("position"),
        (F.lit(texts[0]) if issue is None else issue).alias("issue"),
        severity.alias("severity"),
        column.cast("string").alias("column"),
        evidence.alias("evidence"),
        F.lit(texts[1]).alias("impact"),
        F.lit(texts[2]).alias("recommendation"),
    )


def missing_findings(metrics: DataFrame) -> DataFrame:
    evidence = _text(
        F.col("missing_count"), "/", F.col("row_count"), " values missing (",
        short_float(F.col("missing_pct"), 2), "%)",
    )
    return _finding(
        metrics, "missing_values_check", V.MISSING_TEXT, F.col("severity"), F.col("column"),
        evidence, position=F.col("position"),
    )


def duplicate_findings(metrics: DataFrame) -> DataFrame:
    evidence = _text(
        F.col("duplicate_count"), "/", F.col("row_count"), " rows duplicate earlier rows (",
        short_float(F.col("duplicate_pct"), 2), "%)",
    )
    return _finding(
        metrics.filter(F.col("duplicate_count") > 0), "duplicate_rows_check", V.DUPLICATE_TEXT,
        F.lit("medium"), F.lit(None), evidence,
    )


def constant_findings(metrics: DataFrame) -> DataFrame:
    evidence = _text(
        F.col("unique_count_including_null"), " distinct values including null; dominant fraction ",
        percent_text(F.col("dominant_ratio")),
    )
    constant = F.col("kind") == "constant"
    return _finding(
        metrics, "constant_columns_check", V.CONSTANT_TEXT,
        F.when(constant, "medium").otherwise("low"), F.col("column"), evidence,
        issue=F.when(constant, V.CONSTANT_TEXT[0]).otherwise(V.NEAR_CONSTANT_ISSUE),
        position=F.col("position"),
    )


def cardinality_findings(metrics: DataFrame) -> DataFrame:
    evidence = _text(
        F.col("unique_count"), "/", F.col("non_null_count"), " non-null values unique (ratio ",
        short_float(F.col("unique_ratio")), ")",
    )
    return _finding(
        metrics, "high_cardinality_check", V.CARDINALITY_TEXT, F.lit("low"), F.col("column"),
        evidence, position=F.col("position"),
    )


def outlier_findings(metrics: DataFrame) -> DataFrame:
    evidence = _text(
        F.col("outlier_count"), "/", F.col("non_null_count"), " values outside [",
        general4(F.col("raw_lower")), ", ", general4(F.col("raw_upper")), "] (",
        short_float(F.col("outlier_pct"), 2), "%)",
    )
    return _finding(
        metrics.filter(F.col("outlier_count") > 0), "outlier_check", V.OUTLIER_TEXT,
        F.lit("medium"), F.col("column"), evidence, position=F.col("position"),
    )


def imbalance_findings(distribution: DataFrame, summary: DataFrame, target: str) -> DataFrame:
    """``distribution`` holds at most fifty classes, so they fit one evidence text."""
    entry = _text(
        "{'class': ", quoted(F.col("class")), ", 'count': ", F.col("count"), ", 'proportion': ",
        short_float(F.col("proportion")), ", 'percentage': ", short_float(F.col("percentage")), "}",
    )
    entries = distribution.agg(
        F.array_sort(F.collect_list(F.struct("position", entry.alias("entry")))).alias("entries")
    )
    counts = F.concat(
        F.lit("["), F.array_join(F.transform("entries", lambda e: e["entry"]), ", "), F.lit("]")
    )
    joined = summary.filter(F.col("severity").isNotNull()).join(F.broadcast(entries))
    evidence = _text(
        "Majority/minority ratio ", short_float(F.col("majority_minority_ratio")), ":1; counts ",
        counts,
    )
    return _finding(
        joined, "class_imbalance_check", V.IMBALANCE_TEXT, F.col("severity"), F.lit(target), evidence
    )


def correlation_findings(metrics: DataFrame) -> DataFrame:
    pair = _text(F.col("left"), ", ", F.col("right"))
    evidence = _text("Pearson r(", pair, ") = ", short_float(F.col("correlation")))
    return _finding(
        metrics, "correlation_check", V.CORRELATION_TEXT, F.lit("medium"), pair, evidence,
        position=F.col("position"),
    )


def leading_rows(df: DataFrame, keys: list[str], order: str, limit: int) -> DataFrame:
    """First ``limit`` rows of each group with their rank.

    The filter on the rank lets Spark keep only that many rows per group and task
    before the shuffle, so a group holding most of the rows stays cheap.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("rank", rank).filter(F.col("rank") <= limit)


def top_findings(findings: DataFrame, keys: list[str], order: str, limit: int) -> DataFrame:
    """First ``limit`` findings of each group with the group's total and omitted counts."""
    totals = findings.groupBy(*keys).agg(F.count("*").alias("findings_total"))
    kept = leading_rows(findings, keys, order, limit).join(totals, keys)
    return kept.withColumn("findings_omitted", F.greatest(F.lit(0), F.col("findings_total") - limit))


def findings_within_bytes(findings: DataFrame, keys: list[str], order: str, budget: int) -> DataFrame:
    """Leading findings of each group whose JSON texts together fit the byte budget.

    A JSON object takes at least two bytes, so no more than half the budget in rows
    can fit; the running sum only sees that many rows per group.
    """
    size = F.octet_length(F.to_json(F.struct(*FINDING_FIELDS)))
    running = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        leading_rows(findings, keys, order, budget // 2)
        .withColumn("bytes", size)
        .withColumn("running_bytes", F.sum("bytes").over(running))
        .filter(F.col("running_bytes") <= budget)
    )
