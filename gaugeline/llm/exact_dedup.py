"""Exact duplicates of whole texts, with frequent texts split off before the shuffle.

1. Every text is read once, for its SHA-256; (doc_id, digest, place) is written and all that
   follows reads these rows.
2. Misra-Gries counters of every task are added up by hash.  A digest of more than
   ``1 / FREQUENT`` of all rows always has a counter left, and few others can reach the
   threshold, so the candidates are bounded by the two constants and not by the data.
3. The candidates' digests are counted exactly, which verifies them and finds their winners.
   This table is broadcast: rows of a frequent text get their answer in the task that reads
   them and are never shuffled.
4. All other digests are grouped by one ordinary shuffle; none of its groups can hold more
   than about ``1 / FREQUENT`` of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.sources.files import materialized

#: A digest of at least 1 / FREQUENT of the rows is split off; COUNTERS are kept by a task.
FREQUENT, COUNTERS = 4096, 8192


def reduce_counters(values: np.ndarray, counts: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``keep`` counters: all lose the largest count that has to go (Misra-Gries merge)."""
    if len(values) <= keep:
        return values, counts
    left = counts - np.partition(counts, len(counts) - keep - 1)[len(counts) - keep - 1]
    return values[left > 0], left[left > 0]


def _counters(keep: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            both = np.concatenate([values, batch.column(0).to_numpy(zero_copy_only=False)])
            weight = np.concatenate([counts, np.ones(batch.num_rows, np.int64)])
            values, place = np.unique(both, return_inverse=True)
            counts = np.zeros(len(values), np.int64)
            np.add.at(counts, place, weight)
            values, counts = reduce_counters(values, counts, keep)
        if len(values):
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts)], names=["h", "n"])

    return count


def _last(doc_id: Column, place: Column) -> Column:
    """Orders rows of one text: the largest doc_id is last, null ids first, then the earliest place."""
    return F.struct(doc_id.isNotNull().alias("known"), doc_id.alias("doc_id"), (-place).alias("place"))


def frequent_digests(rows: DataFrame, frequent: int = FREQUENT, counters: int = COUNTERS) -> DataFrame:
    """(digest, keep, group_size) of the digests of at least ``1 / frequent`` of the rows, exactly.

    ``rows`` has doc_id, digest and place.  A counter that a digest of the threshold's size
    lost is at most ``rows / counters``, so candidates are the hashes whose counters add up to
    the threshold less that; all counters add up to ``rows`` at most, so there are at most
    ``1 / (1 / frequent - 1 / counters)`` of them.
    """
    counters = max(counters, 2 * frequent)
    hashed = rows.select(F.xxhash64("digest").alias("h"))
    summed = hashed.mapInArrow(_counters(counters), "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    total = rows.count()
    least = max(1, total / frequent - total / counters)
    candidates = summed.where(F.col("n") >= least).select("h")
    exact = (
        rows.withColumn("h", F.xxhash64("digest"))
        .join(F.broadcast(candidates), "h", "left_semi")
        .groupBy("digest")
        .agg(F.max(_last(F.col("doc_id"), F.col("place"))).alias("keep"), F.count("*").alias("group_size"))
    )
    return exact.where((F.col("group_size") > 1) & (F.col("group_size") * frequent >= total))


def mark_copies(docs: DataFrame, frequent: int = FREQUENT, counters: int = COUNTERS) -> DataFrame:
    """One row per row of ``docs``: (doc_id, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical; a null text counts as empty.  The largest doc_id of a
    group stays (null only when all are null); when that row is repeated, one of the repeats
    stays and the others are dropped.  Other columns are not read; an empty table gives no row.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = materialized(rows.withColumn("place", F.monotonically_increasing_id()), "text-digests")
    winners = materialized(frequent_digests(rows, frequent, counters), "frequent-digests")
    marked = rows.join(F.broadcast(winners), "digest", "left")
    same = Window.partitionBy("digest")
    rest = marked.where(F.col("group_size").isNull()).select(
        "doc_id", "digest", "place",
        F.max(_last(F.col("doc_id"), F.col("place"))).over(same).alias("keep"),
        F.count("*").over(same).alias("group_size"),
    )
    both = marked.where(F.col("group_size").isNotNull()).select(rest.columns).unionAll(rest)
    return both.select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size",
        (F.col("keep.place") == -F.col("place")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns.

    Rows that repeat both doc_id and text may differ in other columns; one of them stays.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    same = F.count_if(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("same")
    wanted = mark_copies(docs).groupBy(F.col("text_sha256").alias("digest"), F.col("keep_id").alias("keep"))
    wanted = materialized(wanted.agg(same), "kept-texts")
    # the row's own columns travel in one struct, so their names cannot clash
    keyed = docs.select(F.struct("*").alias("row"), F.sha2(text, 256).alias("digest"), F.col("doc_id").cast("bigint").alias("id"))
    joined = keyed.join(wanted, "digest").where(F.col("id").eqNullSafe(F.col("keep")))
    once = joined.where(F.col("same") == 1)
    repeated = joined.where(F.col("same") > 1).dropDuplicates(["digest", "id"])
    return once.unionAll(repeated).select("row.*")


ORACLE = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
