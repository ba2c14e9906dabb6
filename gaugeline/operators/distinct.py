"""Exact counting of distinct values and rows, value histograms, dominant values.

Each column is counted in its own column-pruned aggregate and the small results
are unioned.  A columnar scan reads every column once in total either way, while
one aggregate over all columns (``count(distinct a), count(distinct b), ...`` or
grouping sets) would multiply each row by the number of columns before the
shuffle.  Partial aggregation runs before every exchange, so a value that fills a
third of the table travels once per task.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.columns import dtype_label, present_sql, ref, sql_name, sql_text
from gaugeline.settings import DEFAULTS, Settings


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def column_counts(df: DataFrame, name: str) -> DataFrame:
    """(value, n) for one column; missing values form one group."""
    values = df.selectExpr(f"{present_sql(df, name)} AS value")
    return values.groupBy("value").agg(F.expr("count(*) AS n"))


def value_histogram(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, value, n): every distinct value of every column with its count.

    Counting happens on the typed value; only the grouped rows are rendered as text.
    """
    names = list(columns) if columns is not None else df.columns
    return union_all(
        column_counts(df, c).select(
            F.lit(c).alias("column"), F.col("value").cast("string").alias("value"), "n"
        )
        for c in names
    )


def column_dominance(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: distinct values including null, rows of the most frequent one."""
    names = list(columns) if columns is not None else df.columns
    return union_all(
        column_counts(df, c).selectExpr(
            f"{sql_text(c)} AS column", "count(*) AS unique_count_including_null",
            "coalesce(max(n), 0) AS dominant_count", "coalesce(sum(n), 0) AS row_count",
        )
        for c in names
    )


def distinct_counts(
    df: DataFrame, columns: Sequence[str], hashed: Sequence[str] = ()
) -> DataFrame:
    """(column, unique_count, non_null_count, row_count), exact.

    ``hashed`` names long-text columns.
    """
    return union_all(
        _hashed_distinct(df, c) if c in hashed else _plain_distinct(df, c) for c in columns
    )


def _plain_distinct(df: DataFrame, name: str) -> DataFrame:
    return column_counts(df, name).selectExpr(
        f"{sql_text(name)} AS column", "count(value) AS unique_count",
        "coalesce(sum(n) FILTER (WHERE value IS NOT NULL), 0) AS non_null_count",
        "coalesce(sum(n), 0) AS row_count",
    )


def _hashed_distinct(df: DataFrame, name: str) -> DataFrame:
    """Distinct long values by their SHA-256: one exchange, of digests and counts only.

    Digests are taken where values are read, equal ones are folded in each task, and no text
    is shuffled.
    """
    value = df.selectExpr(f"{present_sql(df, name)} AS value")
    digest = F.unhex(F.sha2(F.col("value").cast("string"), 256)).alias("digest")
    groups = value.select(digest).groupBy("digest").agg(F.count("*").alias("n"))
    return groups.selectExpr(
        f"{sql_text(name)} AS column", "count(digest) AS unique_count",
        "coalesce(sum(n) FILTER (WHERE digest IS NOT NULL), 0) AS non_null_count",
        "coalesce(sum(n), 0) AS row_count",
    )


STEER_ROWS = 1000


def long_text_columns(df: DataFrame, columns: Sequence[str], settings: Settings = DEFAULTS) -> list[str]:
    """Text columns whose values look long.

    A glance at the first rows is enough: it only picks between two exact plans.
    """
    texts = [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]
    if not texts:
        return []
    glance = df.select(*[ref(c) for c in texts]).limit(STEER_ROWS)
    row = glance.agg(*[F.avg(F.octet_length(ref(c))).alias(f"b{i}") for i, c in enumerate(texts)]).first()
    return [c for i, c in enumerate(texts) if (row[i] or 0) > settings.long_text_bytes]


def distinct_row_count(df: DataFrame) -> DataFrame:
    """One row: distinct full rows, nulls equal to nulls, NaN treated as null."""
    return _canonical(df).distinct().agg(F.count("*").alias("distinct_rows"))


def _canonical(df: DataFrame) -> DataFrame:
    return df.selectExpr(*[f"{present_sql(df, c)} AS {sql_name(c)}" for c in df.columns])


def repeated_rows(df: DataFrame, rows: int | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """One row (row_count, duplicate_count): rows beyond the first of each group of copies.

    Small tables are grouped by the whole row.  Large ones are grouped by an
    eight-byte hash first; rows under a hash that occurs once have no copy, so only
    the rest is compared in full.  When very many hashes repeat, the full grouping
    is the cheaper plan again, as its partial aggregation folds the copies.
    """
    source = _canonical(df)
    total = df.count() if rows is None else rows
    if total >= settings.duplicate_hash_min_rows:
        keyed = source.withColumn("__row_hash", F.xxhash64(*[ref(c) for c in df.columns]))
        repeats = (
            keyed.select("__row_hash")
            .groupBy("__row_hash")
            .agg(F.count("*").alias("n"))
            .filter(F.col("n") > 1)
            .select("__row_hash")
        )
        found = repeats.count()
        if found == 0:
            source = keyed.drop("__row_hash").limit(0)
        elif found <= settings.broadcast_max_rows:
            source = keyed.join(F.broadcast(repeats), "__row_hash", "left_semi").drop("__row_hash")
    groups = source.groupBy(*[ref(c) for c in df.columns]).agg(F.count("*").alias("__copies"))
    return groups.agg(
        F.lit(total).cast("bigint").alias("row_count"),
        F.coalesce(F.sum(F.col("__copies") - 1), F.lit(0)).alias("duplicate_count"),
    )


def table_digest(df: DataFrame) -> DataFrame:
    """Order-free fingerprint of a table: count, xor and sum of row hashes, then SHA-256."""
    hashed = _canonical(df).select(F.xxhash64(*[ref(c) for c in df.columns]).alias("h"))
    parts = hashed.agg(
        F.count("*").alias("n"),
        F.coalesce(F.bit_xor("h"), F.lit(0)).alias("x"),
        F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).alias("s"),
    )
    names = ",".join(f"{f.name}:{dtype_label(f.dataType)}" for f in df.schema.fields)
    text = F.concat_ws("|", F.lit(names), "n", "x", "s")
    return parts.select(F.col("n").alias("row_count"), F.sha2(text, 256).alias("fingerprint"))
