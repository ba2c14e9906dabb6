"""Expected against observed, and rollups of run logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline import fixed_values as V
from gaugeline.functions.text import repeat_number
from gaugeline.operators.ranking import numbered_rows


def latest_per_key(df: DataFrame, keys: list[str], *recency: str) -> DataFrame:
    """The most recent row of each key.

    ``max_by`` keeps one row per key and task before the shuffle, so a key holding a
    large share of the rows costs no more than any other.
    """
    row = F.struct(*df.columns)
    newest = F.max_by(row, F.struct(*recency)).alias("row")
    return df.groupBy(*keys).agg(newest).select("row.*")


def first_positions(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Distinct values per key with the position of their first occurrence."""
    return df.groupBy(*keys, value).agg(F.min(order).alias("first_position"))


def event_sequence(
    df: DataFrame, keys: list[str], *order: str, bucket: Column | None = None
) -> DataFrame:
    """Position of each row within its key.

    Keys with very many rows are found by a sketch and numbered in parts by ranges of the
    order.  ``bucket``, a coarse, never decreasing function of the order columns, gives the
    parts beforehand: the rows of earlier buckets are counted, and only those small counts are
    summed up per key.
    """
    if bucket is None:
        return numbered_rows(df, keys, order)
    parts = [*keys, "__bucket"]
    cut = df.withColumn("__bucket", bucket)
    earlier = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*parts)
        .agg(F.count("*").alias("__n"))
        .select(*parts, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    )
    place = F.row_number().over(Window.partitionBy(*parts).orderBy(*order))
    numbered = cut.withColumn("__place", place).join(offsets, parts)
    return numbered.select(*df.columns, (F.col("__before") + F.col("__place")).alias("sequence"))


# -- full outer comparison ------------------------------------------------------------


def reconcile(expected: DataFrame, observed: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer comparison: matches, differs, missing (not observed) or unexpected."""
    left = expected.select(*keys, F.col(value).alias("expected"), F.lit(True).alias("__wanted"))
    right = observed.select(*keys, F.col(value).alias("observed"), F.lit(True).alias("__seen"))
    joined = left.join(right, keys, "full")
    status = (
        F.when(F.col("__seen").isNull(), "missing")
        .when(F.col("__wanted").isNull(), "unexpected")
        .when(F.col("expected").eqNullSafe(F.col("observed")), "matches")
        .otherwise("differs")
    )
    return joined.select(*keys, "expected", "observed", status.alias("status"))


def guard_pass(profile: Column, tool: Column, status: Column, summary: Column) -> Column:
    """An expected skip of a wide table: the guard held, the statistic stays unassessed."""
    text = F.lower(F.coalesce(summary, F.lit("")))
    named = reduce(lambda a, b: a | b, [text.contains(t) for t in V.GUARD_TERMS])
    return (
        (profile == "wide_numeric") & tool.isin(*V.GUARDED_CHECKS) & (status == "skipped")
        & text.contains("column") & named
    )


def judge_observations(observations: DataFrame, comparisons: DataFrame) -> DataFrame:
    """Three-valued verdict per observation: true, false, or NULL for unassessed.

    ``observations(run_id, profile, tool, status, summary)`` and ``comparisons(run_id,
    tool, status)`` from :func:`reconcile`; checks without ground truth stay unassessed.
    """
    compared = comparisons.groupBy("run_id", "tool").agg(
        F.bool_and(F.col("status") == "matches").alias("all_match")
    )
    joined = observations.join(compared, ["run_id", "tool"], "left")
    guarded = guard_pass(F.col("profile"), F.col("tool"), F.col("status"), F.col("summary"))
    excused = (
        (F.col("status") == "skipped") & F.col("tool").isin(*V.UNASSESSED_CHECKS)
        & (F.col("profile") != "wide_numeric")
    )
    unknown = F.lit(None).cast("boolean")
    verdict = (
        F.when(F.col("status") == "ok", F.col("all_match"))
        .when(guarded | excused, unknown)
        .otherwise(F.lit(False))
    )
    return joined.withColumn("correctness_pass", verdict).withColumn("guard_pass", guarded).drop("all_match")


def reverify(log: DataFrame, verdicts: DataFrame) -> DataFrame:
    """New verdicts beside the original ones; the original columns stay untouched."""
    new = verdicts.select(
        "run_id", "tool",
        F.col("correctness_pass").alias("verified_correctness_pass"),
        F.col("guard_pass").alias("verified_guard_pass"),
    )
    exact = F.when(F.col("status") == "ok", "exact").otherwise("unassessed")
    return log.join(new, ["run_id", "tool"], "left").withColumn("verified_exactness", exact)


def scenario_verdicts(expectations: DataFrame, observed: DataFrame) -> DataFrame:
    """Scenario status: partial when a required check never ran, else pass or fail with reasons.

    ``expectations(scenario, tool, key, value, reason)``: a NULL key only requires the
    check.  ``observed(scenario, tool, key, value)`` holds what the checks measured.
    """
    ran = observed.select("scenario", "tool").distinct().withColumn("ran", F.lit(True))
    measured = observed.select("scenario", "tool", "key", F.col("value").alias("seen"))
    joined = expectations.join(ran, ["scenario", "tool"], "left").join(
        measured, ["scenario", "tool", "key"], "left"
    )
    absent = F.col("ran").isNull()
    wrong = ~absent & F.col("key").isNotNull() & ~F.col("value").eqNullSafe(F.col("seen"))
    reason = F.when(absent, F.concat(F.lit("Required diagnostic never called: "), "tool")).when(
        wrong, F.col("reason")
    )
    # rules per scenario are few, so the list of reasons is short
    return joined.groupBy("scenario").agg(
        F.when(F.bool_or(absent), "partial").when(F.bool_or(wrong), "fail").otherwise("pass").alias("status"),
        F.array_sort(F.collect_set(reason)).alias("reasons"),
    )


def group_set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows in only one of two group sets; empty when the sets are equal."""
    a, b = left.distinct(), right.distinct()
    return (
        a.exceptAll(b).withColumn("only_in", F.lit("left"))
        .unionByName(b.exceptAll(a).withColumn("only_in", F.lit("right")))
    )


def file_differences(listed: DataFrame, actual: DataFrame) -> DataFrame:
    """Manifest check: listed(path, sha256, bytes) against digests of the files present."""
    seen = actual.select("path", F.col("sha256").alias("actual_sha256"), F.col("length").alias("actual_bytes"))
    joined = listed.join(seen, "path", "left")
    changed = ~F.col("sha256").eqNullSafe(F.col("actual_sha256")) | (
        F.col("bytes").isNotNull() & ~F.col("bytes").eqNullSafe(F.col("actual_bytes"))
    )
    status = F.when(F.col("actual_sha256").isNull(), "missing").when(changed, "differs").otherwise("matches")
    return joined.select("path", status.alias("status"))


# -- run log ----------------------------------------------------------------------------
# log(run_id, utc_time, profile, file_bytes, tool, status, ingest_seconds, tool_seconds,
#     rss_bytes, temp_bytes, ingest_limit, correctness_pass, verified_correctness_pass,
#     guard_pass, budget_pass)


def with_budget(log: DataFrame) -> DataFrame:
    """Per row: within the ingest, check and memory limits; and the first ingest goal."""
    limit = F.when(F.col("tool").isin(*V.SLOW_CHECKS), V.SLOW_CHECK_SECONDS).otherwise(
        V.FAST_CHECK_SECONDS
    )
    within = (
        (F.col("ingest_seconds") <= F.col("ingest_limit")) & (F.col("tool_seconds") <= limit)
        & (F.col("status") != "error") & (F.col("rss_bytes") <= V.MAX_RSS_BYTES)
    )
    return log.withColumn("budget_pass", F.coalesce(within, F.lit(False))).withColumn(
        "initial_goal_pass", F.col("ingest_seconds") <= V.INITIAL_INGEST_SECONDS
    )


def _failures(name: str) -> Column:
    return F.count_if(F.col(name) == F.lit(False))


def attempt_rollup(log: DataFrame) -> DataFrame:
    """All attempts per profile and size."""
    return log.groupBy("profile", "file_bytes").agg(
        F.count_distinct("run_id").alias("imports"),
        F.max("ingest_seconds").alias("max_ingest_seconds"),
        F.max("tool_seconds").alias("max_check_seconds"),
        F.max("rss_bytes").alias("peak_rss_bytes"),
        F.max("temp_bytes").alias("peak_temp_bytes"),
        _failures("correctness_pass").alias("correctness_failures"),
        _failures("budget_pass").alias("budget_failures"),
    )


def release_rollup(log: DataFrame) -> DataFrame:
    """Attempts under the release limit, with runs that missed the first goal."""
    release = log.filter(F.col("ingest_limit") == V.RELEASE_INGEST_SECONDS)
    return release.groupBy("profile", "file_bytes").agg(
        F.count_distinct("run_id").alias("imports"),
        F.max("ingest_seconds").alias("max_ingest_seconds"),
        F.count_distinct(
            F.when(F.col("initial_goal_pass") == F.lit(False), F.col("run_id"))
        ).alias("initial_goal_misses"),
        _failures("correctness_pass").alias("correctness_failures"),
        _failures("budget_pass").alias("budget_failures"),
    )


def verified_rollup(log: DataFrame) -> DataFrame:
    """Imports, failures, passes and guards by the verified judgement."""
    ok = F.col("status") == "ok"
    imported = F.col("tool") == "import_or_run"
    return log.groupBy("profile", "file_bytes").agg(
        F.count_distinct(F.when(ok, F.col("run_id"))).alias("successful_imports"),
        F.count_distinct(F.when(imported, F.col("run_id"))).alias("import_failures"),
        F.coalesce(F.max(F.when(ok, F.col("ingest_seconds"))), F.lit(0.0)).alias("max_ingest_seconds"),
        F.max("rss_bytes").alias("peak_rss_bytes"),
        F.count_if(F.col("verified_correctness_pass")).alias("passed"),
        F.count_if(F.col("guard_pass")).alias("guards"),
        F.count_if((F.col("verified_correctness_pass") == F.lit(False)) & ~imported).alias("failures"),
    )


def latest_benchmarks(runs: DataFrame, log: DataFrame) -> DataFrame:
    """Latest run of each repeat, joined to its log rows, with one status per group.

    ``runs(run_id, utc_time, profile, size, observations, error_type, ...)``.
    """
    repeat = F.coalesce(repeat_number(F.col("run_id")).cast("string"), F.col("run_id"))
    newest = latest_per_key(
        runs.withColumn("repeat", repeat), ["profile", "size", "repeat"], "utc_time", "run_id"
    )
    judged = log.join(newest.select("run_id"), "run_id", "left_semi").select(
        "run_id", F.coalesce("verified_correctness_pass", "correctness_pass").alias("verdict"),
        "guard_pass", "budget_pass",
    )
    rows = judged.groupBy("run_id").agg(
        F.coalesce(F.bool_or("verdict"), F.lit(False)).alias("some_true"),
        F.coalesce(F.bool_or(~F.col("verdict")), F.lit(False)).alias("some_false"),
        F.coalesce(F.bool_or("guard_pass"), F.lit(False)).alias("guarded"),
        F.bool_and("budget_pass").alias("in_budget"),
    )
    joined = newest.join(rows, "run_id", "left")
    grouped = joined.groupBy("profile", "size").agg(
        F.count("*").alias("runs"),
        F.max("ingest_seconds").alias("max_ingest_seconds"),
        F.max("rss_bytes").alias("peak_rss_bytes"),
        F.bool_and((F.col("observations") > 0) & F.col("error_type").isNull()).alias("success"),
        F.coalesce(F.bool_or("some_true"), F.lit(False)).alias("some_true"),
        F.coalesce(F.bool_or("some_false"), F.lit(False)).alias("some_false"),
        F.coalesce(F.bool_or("guarded"), F.lit(False)).alias("guarded"),
        F.coalesce(F.bool_and("in_budget"), F.lit(False)).alias("in_budget"),
    )
    good = F.col("success") & F.col("some_true") & ~F.col("some_false") & F.col("in_budget")
    status = F.when(good & F.col("guarded"), "guarded").when(good, "pass").otherwise("failed/limited")
    return grouped.select(
        "profile", "size", "runs", "max_ingest_seconds", "peak_rss_bytes", status.alias("status")
    )
