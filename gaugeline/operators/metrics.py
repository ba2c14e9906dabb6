"""Metrics tables of the column-wise checks: profile, missing, duplicates, constants, cardinality."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline import fixed_values as V
from gaugeline.columns import (
    dtype_label,
    eligible_columns,
    is_numeric,
    present_sql,
    sql_text,
    leading_columns,
)
from gaugeline.functions.local import small_table
from gaugeline.operators.distinct import (
    column_dominance,
    distinct_counts,
    long_text_columns,
    repeated_rows,
)
from gaugeline.settings import DEFAULTS, Settings


def ratio(part: Column, whole: Column, digits: int, scale: float = 1.0) -> Column:
    """Rounded share; 0.0 for an empty table."""
    return F.coalesce(
        F.round(F.try_divide(part * F.lit(float(scale)), whole.cast("double")), digits), F.lit(0.0)
    )


def unpivot_row(row: DataFrame, names: Sequence[str], fields: Mapping[str, str], keep=()) -> DataFrame:
    """Turn one wide aggregate row into one row per column.

    ``fields`` maps an output field to the prefix of its aggregates ``<prefix><i>``.
    """
    items = ", ".join(
        f"struct({i} AS position, {sql_text(name)} AS column, "
        + ", ".join(f"{prefix}{i} AS {field}" for field, prefix in fields.items())
        + ")"
        for i, name in enumerate(names)
    )
    return row.selectExpr(*keep, f"inline(array({items}))")


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(row_count, position, column, missing_count) in a single scan."""
    names = list(columns) if columns is not None else df.columns
    row = df.selectExpr(
        "count(*) AS row_count",
        *[f"count({present_sql(df, c)}) AS k{i}" for i, c in enumerate(names)],
    )
    return unpivot_row(row, names, {"kept": "k"}, keep=("row_count",)).selectExpr(
        "row_count", "position", "column", "row_count - kept AS missing_count"
    )


def missing_values(
    df: DataFrame, settings: Settings = DEFAULTS, counts: DataFrame | None = None
) -> DataFrame:
    """Columns with missing values; severity compares the rounded percentage.

    ``counts`` takes null counts known from ingest, which answers without a scan.
    """
    source = null_counts(df) if counts is None else counts
    pct = F.col("missing_pct")
    return (
        source.filter(F.col("missing_count") > 0)
        .withColumn("missing_pct", ratio(F.col("missing_count"), F.col("row_count"), 2, 100.0))
        .withColumn(
            "severity",
            F.when(pct > settings.missing_high_pct, "high")
            .when(pct >= settings.missing_medium_pct, "medium")
            .otherwise("low"),
        )
        .select("position", "column", "missing_count", "row_count", "missing_pct", "severity")
    )


def duplicate_rows(df: DataFrame, rows: int | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    counted = repeated_rows(df, rows, settings)
    return counted.withColumn(
        "duplicate_pct", ratio(F.col("duplicate_count"), F.col("row_count"), 2, 100.0)
    )


def dataset_profile(
    df: DataFrame, target: str | None = None, types: Mapping[str, str] | None = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """One row per column: type, distinct values, missing values."""
    names = leading_columns(df.columns, settings.max_profile_columns, target)
    labels = [(types or {}).get(c) or dtype_label(df.schema[c].dataType) for c in names]
    kinds = ["numeric" if is_numeric(df.schema[c].dataType) else "categorical" for c in names]
    counted = distinct_counts(df, names, long_text_columns(df, names, settings))
    place = _position(names)
    return counted.select(
        place.alias("position"), "column",
        F.array(*[F.lit(x) for x in labels])[place].alias("dtype"),
        F.array(*[F.lit(x) for x in kinds])[place].alias("kind"),
        "row_count", "unique_count", (F.col("row_count") - F.col("non_null_count")).alias("null_count"),
    )


# A sketch tracking 64 items errs by under 3 % of the rows, so a value above this
# share is always reported; the margin widens the candidate test by more than that.
SKETCH_ITEMS = 64
SKETCH_GROUPS = 256
SKETCH_SAFE_RATIO = 0.6
SKETCH_MARGIN = 0.05


def constant_columns(
    df: DataFrame, settings: Settings = DEFAULTS, columns: Sequence[str] | None = None
) -> DataFrame:
    """Constant and near-constant columns.

    A column is only reported when one value fills almost all rows.  Such a value
    cannot escape a frequent-items sketch, so one scan (values as 64-bit hashes)
    finds the few columns that can qualify, and only those are counted exactly.
    Columns of many different values are never shuffled.  Thresholds too low for
    the sketch guarantee use the full value counts of every column instead.
    """
    names = list(columns) if columns is not None else df.columns
    if settings.near_constant_ratio >= SKETCH_SAFE_RATIO:
        suspects = _dominated_columns(df, names, settings.near_constant_ratio - SKETCH_MARGIN)
    else:
        suspects = names
    if suspects:
        counted = column_dominance(df, suspects)
    else:
        counted = small_table(
            df.sparkSession, [],
            "column string, unique_count_including_null bigint, dominant_count bigint, "
            "row_count bigint",
        )
    kind = F.when(F.col("unique_count_including_null") <= 1, "constant").when(
        F.col("dominant_ratio") >= settings.near_constant_ratio, "near_constant"
    )
    return (
        counted.withColumn("dominant_ratio", ratio(F.col("dominant_count"), F.col("row_count"), 4))
        .withColumn("kind", kind)
        .filter(F.col("kind").isNotNull())
        .withColumn("position", _position(names))
    )


def _dominated_columns(df: DataFrame, names: Sequence[str], share: float) -> list[str]:
    """Columns where one value, or NULL, may fill at least ``share`` of the rows."""
    hashed = df.selectExpr(
        *[
            f"CASE WHEN {v} IS NOT NULL THEN xxhash64({v}) END AS h{i}"
            for i, v in enumerate(present_sql(df, c) for c in names)
        ]
    )
    places = range(len(names))
    # one row without values keeps the merge defined for a table without rows
    blank = df.sparkSession.range(1).selectExpr(*[f"CAST(NULL AS BIGINT) AS h{i}" for i in places])
    hashed = hashed.unionByName(blank)
    # sketches are merged in two steps, so that the last task sees a bounded number of
    # them however many tasks scanned the table
    grouped = hashed.selectExpr("*", f"pmod(spark_partition_id(), {SKETCH_GROUPS}) AS part").groupBy("part")
    partial = grouped.agg(
        F.expr("count(*) AS total"),
        *[F.expr(f"count(h{i}) AS k{i}") for i in places],
        *[F.expr(f"approx_top_k_accumulate(h{i}, {SKETCH_ITEMS}) AS c{i}") for i in places],
    )
    row = partial.selectExpr(
        "sum(total) - 1 AS total",
        *[f"sum(k{i}) AS k{i}" for i in places],
        *[
            f"get(approx_top_k_estimate(approx_top_k_combine(c{i}, {SKETCH_ITEMS}), 1), 0).count AS c{i}"
            for i in places
        ],
    ).first()
    floor = share * row["total"]
    return [
        c
        for i, c in enumerate(names)
        if max(row["total"] - row[f"k{i}"], row[f"c{i}"] or 0) >= floor
    ]


def _position(names: Sequence[str]) -> Column:
    listed = ", ".join(sql_text(c) for c in names)
    return F.expr(f"CAST(array_position(array({listed}), column) - 1 AS INT)")


def high_cardinality(
    df: DataFrame, settings: Settings = DEFAULTS, columns: Sequence[str] | None = None
) -> DataFrame:
    """Text or identifier-named columns whose values are almost all different."""
    names = list(columns) if columns is not None else eligible_columns(df, "high_cardinality_check")
    if not names:
        return small_table(
            df.sparkSession, [],
            "position int, column string, unique_count bigint, non_null_count bigint, unique_ratio double",
        )
    counted = distinct_counts(df, names, long_text_columns(df, names, settings))
    return (
        counted.filter(F.col("non_null_count") >= settings.high_cardinality_min_non_null)
        .withColumn("unique_ratio", ratio(F.col("unique_count"), F.col("non_null_count"), 4))
        .filter(F.col("unique_ratio") >= settings.high_cardinality_ratio)
        .select(_position(names).alias("position"), "column", "unique_count", "non_null_count",
                "unique_ratio")
    )
