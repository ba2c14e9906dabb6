"""Positions of rows in a given order, without a task that sees all rows of a table or key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.functions.local import small_table
from gaugeline.sources.files import materialized

#: A key of more rows than this, and of more than 1 / HOT_KEYS of all, is numbered in parts.
HOT_ROWS, HOT_KEYS = 1_000_000, 1000
SKETCH_ITEMS, SKETCH_GROUPS = 8192, 64
PLACE_BITS = 33


def _sorted_parts(df: DataFrame, order: Sequence[Column | str], label: str) -> DataFrame:
    """Rows dealt by range of ``order`` and sorted, with ``__part`` and ``__place`` (from 0) in it."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    written = materialized(dealt.withColumn("__id", F.monotonically_increasing_id()), label)
    inside = F.col("__id").bitwiseAND((1 << PLACE_BITS) - 1)
    return written.withColumns({"__part": F.shiftright("__id", PLACE_BITS), "__place": inside}).drop("__id")


def ranked_rows(df: DataFrame, order: Sequence[Column | str], name: str = "position") -> DataFrame:
    """``df`` with each row's position, from 1, in the total order of ``order``.

    Rows are dealt by range and sorted; a row's position is the number of rows in earlier
    parts, one number a part, and its place in its own.
    """
    placed = _sorted_parts(df, order, "ranked")
    counts = placed.groupBy("__part").agg(F.count("*").alias("n")).collect()  # a row per partition
    offsets, before = [], 0
    for r in sorted(counts):
        offsets.append((r["__part"], before))
        before += r["n"]
    table = small_table(df.sparkSession, offsets, "__part bigint, __before bigint")
    joined = placed.join(F.broadcast(table), "__part")
    return joined.select(*df.columns, (F.col("__before") + F.col("__place") + 1).alias(name))


def hot_keys(df: DataFrame, keys: Sequence[str], least_rows: int = HOT_ROWS) -> list[int]:
    """Hashes of the keys that may hold more than ``least_rows`` and ``1 / HOT_KEYS`` of the rows.

    A frequent-items sketch, merged in two steps; no such key escapes it, and a few others
    may be named.
    """
    hashed = df.select(F.xxhash64(*keys).alias("h"), F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("g"))
    partial = hashed.groupBy("g").agg(
        F.count("*").alias("n"), F.expr(f"approx_top_k_accumulate(h, {SKETCH_ITEMS})").alias("s")
    )
    # grouped by nothing but a constant, so that a table without rows gives no row
    row = partial.groupBy(F.lit("all").alias("all")).agg(
        F.sum("n").alias("n"),
        F.expr(f"approx_top_k_estimate(approx_top_k_combine(s, {SKETCH_ITEMS}), {HOT_KEYS})").alias("top"),
    ).first()
    if row is None:
        return []
    least = max(least_rows, row["n"] / HOT_KEYS)
    return [t["item"] for t in row["top"] if t["count"] > least]


def numbered_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "sequence", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``df`` with each row's position within its key.

    Rows of hot keys are dealt by range of key and order, so that one key spreads over many
    tasks; counts per key and part, few as hot keys are few, turn places into positions.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    hot = hot_keys(df, keys, hot_rows)
    if not hot:
        return df.withColumn(name, place)
    is_hot = F.xxhash64(*keys).isin(hot)
    placed = _sorted_parts(df.filter(is_hot), [*keys, *order], "hot-keys")
    runs = placed.groupBy("__part", *keys).agg(F.count("*").alias("n"), F.min("__place").alias("__first"))
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("__before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    runs = runs.select("__first", "__before", F.col("__part").alias("__run"), *[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)])
    on = F.col("__part") == F.col("__run")
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"__key{i}"))
    spread = placed.join(F.broadcast(runs), on).select(
        *df.columns, (F.col("__before") + F.col("__place") - F.col("__first") + 1).alias(name)
    )
    return df.filter(~is_hot).withColumn(name, place).select(*df.columns, F.col(name).cast("bigint")).unionAll(spread)
