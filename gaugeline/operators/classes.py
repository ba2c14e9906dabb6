"""Class distribution and imbalance of a target column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline import fixed_values as V
from gaugeline.columns import present, ref
from gaugeline.operators.metrics import ratio
from gaugeline.operators.ranking import ranked_rows


SCAN_POSITION = ("_metadata.file_path", "_metadata.row_index")


def has_scan_position(df: DataFrame) -> bool:
    """True for a Parquet scan, whose rows know their file and place in it."""
    if not df.inputFiles():
        return False
    try:
        df.select(*SCAN_POSITION)
    except AnalysisException:
        return False
    return True


def source_order(df: DataFrame, order_by: Sequence[str] | None) -> Column | None:
    """Key of the source position: given columns, or file and row of a Parquet scan."""
    if order_by:
        return F.struct(*[ref(c) for c in order_by])
    return F.struct(*SCAN_POSITION) if has_scan_position(df) else None


def class_counts(df: DataFrame, target: str, order_by: Sequence[str] | None = None) -> DataFrame:
    """(label, n, first_seen): one row per observed class, partial counts before the shuffle.

    The scan position is minimised per file first: a plain number per group keeps the
    hash aggregate, where a minimum of (file, row) pairs would sort every row.
    """
    label = present(df, target).alias("label")
    filled = F.col("label").isNotNull()
    counted = F.count("*").alias("n")
    if order_by and len(order_by) == 1:
        rows = df.select(label, ref(order_by[0]).alias("seen")).filter(filled)
        return rows.groupBy("label").agg(counted, F.min("seen").alias("first_seen"))
    if order_by or not has_scan_position(df):
        order = source_order(df, order_by)
        rows = df.select(label, (F.lit(None) if order is None else order).alias("seen")).filter(filled)
        return rows.groupBy("label").agg(counted, F.min("seen").alias("first_seen"))
    file, row = SCAN_POSITION
    rows = df.select(label, F.col(file).alias("file"), F.col(row).alias("row")).filter(filled)
    per_file = rows.groupBy("label", "file").agg(counted, F.min("row").alias("row"))
    return per_file.groupBy("label").agg(
        F.sum("n").alias("n"), F.min(F.struct("file", "row")).alias("first_seen")
    )


def target_guard(df: DataFrame, target: str) -> DataFrame:
    """One row: classes, longest label in bytes, observed rows."""
    counts = (
        df.select(present(df, target).alias("label"))
        .filter(F.col("label").isNotNull())
        .groupBy("label")
        .agg(F.count("*").alias("n"))
    )
    return counts.agg(
        F.count("*").alias("unique_classes"),
        F.coalesce(F.max(F.octet_length(F.col("label").cast("string"))), F.lit(0)).alias(
            "max_label_bytes"
        ),
        F.coalesce(F.sum("n"), F.lit(0)).alias("observed_rows"),
    )


def too_many_classes(unique: int, rows: int, limit: int) -> bool:
    """With a limit: more classes than it, or than a share of the rows allows."""
    share = max(V.CLASS_MIN_ALLOWED, rows * V.CLASS_MAX_FRACTION)
    return bool(limit) and unique > min(limit, share)


def class_order() -> list[Column]:
    """Most frequent first; ties keep the order in which the classes first occur."""
    return [F.desc("n"), F.asc_nulls_last("first_seen"), F.col("label").cast("string").asc()]


def ranked_classes(df: DataFrame, target: str, order_by: Sequence[str] | None = None) -> DataFrame:
    """(position, class, count, proportion, percentage), most frequent first.

    Ties keep the order in which the classes first occur in the source.  Classes are ranked
    by ranges, so any number of them works.
    """
    ranked = ranked_rows(class_counts(df, target, order_by), class_order())
    total = F.lit(ranked.agg(F.sum("n")).first()[0])
    return ranked.select(
        F.col("position").cast("bigint").alias("position"),
        F.col("label").cast("string").alias("class"),
        F.col("n").alias("count"),
        ratio(F.col("n"), total, 4).alias("proportion"),
        ratio(F.col("n"), total, 4, 100.0).alias("percentage"),
    )


def class_distribution(df: DataFrame, target: str, order_by: Sequence[str] | None = None) -> DataFrame:
    """Ranked classes of a target, however many there are."""
    return ranked_classes(df, target, order_by)


def summarize_classes(distribution: DataFrame) -> DataFrame:
    """One row: classes, majority, minority, ratio and severity (NULL below medium)."""
    summary = distribution.agg(
        F.count("*").alias("classes"),
        F.min_by("class", "position").alias("majority_class"),
        F.max_by("class", "position").alias("minority_class"),
        ratio(F.max("count"), F.min("count"), 4).alias("majority_minority_ratio"),
    )
    return _graded(summary)


def _graded(summary: DataFrame) -> DataFrame:
    r = F.col("majority_minority_ratio")
    return summary.withColumn(
        "severity", F.when(r >= V.IMBALANCE_HIGH, "high").when(r >= V.IMBALANCE_MEDIUM, "medium")
    )


def class_imbalance(df: DataFrame, target: str, order_by: Sequence[str] | None = None) -> DataFrame:
    """:func:`summarize_classes` from the counts alone: the ends of the ranking need no ranking."""
    counts = class_counts(df, target, order_by)
    place = F.struct(
        (-F.col("n")).alias("n"), F.col("first_seen").isNull().alias("unseen"), F.col("first_seen"),
        F.col("label").cast("string").alias("label"),
    )
    ends = counts.agg(
        F.count("*").alias("classes"), F.min(place).alias("first"), F.max(place).alias("last"),
        F.max("n").alias("most"), F.min("n").alias("least"),
    )
    return _graded(ends.select(
        "classes", F.col("first.label").alias("majority_class"), F.col("last.label").alias("minority_class"),
        ratio(F.col("most"), F.col("least"), 4).alias("majority_minority_ratio"),
    ))
