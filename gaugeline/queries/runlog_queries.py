"""Run-log rollups and reconciliation, with the events table read as a run log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.plans import reconcile
from gaugeline.queries.registry import Tables, query, select_sql
from gaugeline.sources import files
from gaugeline.sources.store import Store

TOOL = (
    "CASE event_id % 4 WHEN 0 THEN 'missing_values_check' WHEN 1 THEN 'duplicate_rows_check' "
    "WHEN 2 THEN 'outlier_check' ELSE 'import_or_run' END"
)
LOG = [
    "'run_' || event_type || '_r' || (user_id % 3) || '_' || user_id AS run_id",
    "ts AS utc_time", "event_type AS profile", "user_id % 5 AS file_bytes", f"{TOOL} AS tool",
    "CASE WHEN event_id % 11 = 0 THEN 'error' WHEN event_id % 11 = 1 THEN 'skipped' ELSE 'ok' END AS status",
    "value AS ingest_seconds", "value / 2 AS tool_seconds", "event_id * 1000003 % 3000000000 AS rss_bytes",
    "event_id * 7919 % 1000000 AS temp_bytes",
    "CASE WHEN user_id % 2 = 0 THEN 120.0 ELSE 60.0 END AS ingest_limit",
    "CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS correctness_pass",
    "CASE event_id % 5 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END AS verified_correctness_pass",
    "event_id % 13 = 0 AS guard_pass",
]
_WITHIN = (
    "coalesce(ingest_seconds <= ingest_limit AND tool_seconds <= (CASE WHEN tool IN ('duplicate_rows_check', 'outlier_check') "
    "THEN 120 ELSE 30 END) AND status <> 'error' AND rss_bytes <= 2147483648, false)"
)
LOG_SQL = (
    f"(SELECT *, {_WITHIN} AS budget_pass, ingest_seconds <= 60 AS initial_goal_pass FROM ({select_sql('events', LOG)}) l) t"
)


def log(t: Tables) -> DataFrame:
    typed = t.events.selectExpr(*LOG).withColumn("ingest_limit", F.col("ingest_limit").cast("double"))
    return reconcile.with_budget(typed)


@query(
    "budget_flags",
    "SELECT tool, status, budget_pass, initial_goal_pass, count(*) AS n "
    f"FROM {LOG_SQL} GROUP BY ALL",
)
def budget_flags(t: Tables) -> DataFrame:
    return log(t).groupBy("tool", "status", "budget_pass", "initial_goal_pass").agg(F.count("*").alias("n"))


@query(
    "attempt_rollup",
    "SELECT profile, file_bytes, count(DISTINCT run_id) AS imports, max(ingest_seconds) AS max_ingest_seconds, "
    "max(tool_seconds) AS max_check_seconds, max(rss_bytes) AS peak_rss_bytes, max(temp_bytes) AS peak_temp_bytes, "
    "count(*) FILTER (WHERE correctness_pass = false) AS correctness_failures, "
    f"count(*) FILTER (WHERE budget_pass = false) AS budget_failures FROM {LOG_SQL} GROUP BY profile, file_bytes",
)
def attempt_rollup(t: Tables) -> DataFrame:
    return reconcile.attempt_rollup(log(t))


@query(
    "release_rollup",
    "SELECT profile, file_bytes, count(DISTINCT run_id) AS imports, max(ingest_seconds) AS max_ingest_seconds, "
    "count(DISTINCT run_id) FILTER (WHERE initial_goal_pass = false) AS initial_goal_misses, "
    "count(*) FILTER (WHERE correctness_pass = false) AS correctness_failures, "
    f"count(*) FILTER (WHERE budget_pass = false) AS budget_failures FROM {LOG_SQL} WHERE ingest_limit = 120 GROUP BY profile, file_bytes",
)
def release_rollup(t: Tables) -> DataFrame:
    return reconcile.release_rollup(log(t))


@query(
    "verified_rollup",
    "SELECT profile, file_bytes, count(DISTINCT run_id) FILTER (WHERE status = 'ok') AS successful_imports, "
    "count(DISTINCT run_id) FILTER (WHERE tool = 'import_or_run') AS import_failures, "
    "coalesce(max(ingest_seconds) FILTER (WHERE status = 'ok'), 0.0) AS max_ingest_seconds, max(rss_bytes) AS peak_rss_bytes, "
    "count(*) FILTER (WHERE verified_correctness_pass) AS passed, count(*) FILTER (WHERE guard_pass) AS guards, "
    "count(*) FILTER (WHERE verified_correctness_pass = false AND tool <> 'import_or_run') AS failures "
    f"FROM {LOG_SQL} GROUP BY profile, file_bytes",
)
def verified_rollup(t: Tables) -> DataFrame:
    return reconcile.verified_rollup(log(t))


RUNS = [
    "'run_' || event_type || '_r' || (user_id % 3) || '_' || user_id AS run_id", "ts AS utc_time", "event_id",
    "event_type AS profile", "user_id % 5 AS size", "event_id % 17 AS observations",
    "CASE WHEN event_id % 19 = 0 THEN 'Timeout' END AS error_type", "value AS ingest_seconds",
    "event_id * 1000003 % 3000000000 AS rss_bytes",
]
_NEWEST = (
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY profile, size, regexp_extract(run_id, '_r(\\d+)_\\d+$', 1) "
    f"ORDER BY utc_time DESC, run_id DESC, event_id DESC) AS k FROM ({select_sql('events', RUNS)}) r) s WHERE k = 1"
)


@query(
    "latest_benchmarks",
    f"WITH newest AS ({_NEWEST}), judged AS (SELECT run_id, coalesce(bool_or(coalesce(verified_correctness_pass, correctness_pass)), false) AS some_true, "
    "coalesce(bool_or(NOT coalesce(verified_correctness_pass, correctness_pass)), false) AS some_false, "
    f"coalesce(bool_or(guard_pass), false) AS guarded, bool_and(budget_pass) AS in_budget FROM {LOG_SQL} "
    "WHERE run_id IN (SELECT run_id FROM newest) GROUP BY run_id) "
    "SELECT profile, size, runs, max_ingest_seconds, peak_rss_bytes, CASE WHEN good AND guarded THEN 'guarded' WHEN good THEN 'pass' ELSE 'failed/limited' END AS status "
    "FROM (SELECT profile, size, count(*) AS runs, max(ingest_seconds) AS max_ingest_seconds, max(rss_bytes) AS peak_rss_bytes, "
    "bool_and(observations > 0 AND error_type IS NULL) AND bool_or(some_true) AND NOT bool_or(some_false) AND bool_and(in_budget) AS good, "
    "bool_or(guarded) AS guarded FROM newest LEFT JOIN judged USING (run_id) GROUP BY profile, size) g",
)
def latest_benchmarks(t: Tables) -> DataFrame:
    runs = t.events.selectExpr(*RUNS)
    newest = reconcile.latest_per_key(runs, ["run_id"], "utc_time", "event_id")
    return reconcile.latest_benchmarks(newest, log(t))


@query(
    "latest_per_key",
    "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER "
    "(PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) e WHERE k = 1",
)
def latest_per_key(t: Tables) -> DataFrame:
    newest = reconcile.latest_per_key(t.events, ["user_id", "event_type"], "ts", "event_id")
    return newest.select("user_id", "event_type", "event_id", "value")


@query(
    "latest_runs_rank_ordered",
    "SELECT profile, file_bytes, count(*) AS n FROM "
    f"{LOG_SQL} GROUP BY profile, file_bytes ORDER BY file_bytes, profile",
)
def latest_runs_rank_ordered(t: Tables) -> DataFrame:
    return log(t).groupBy("profile", "file_bytes").agg(F.count("*").alias("n")).orderBy("file_bytes", "profile")


# -- expected against observed -----------------------------------------------------------------


@query(
    "reconcile_groups",
    "SELECT coalesce(e.k, o.k) AS k, expected, observed, CASE WHEN o.k IS NULL THEN 'missing' WHEN e.k IS NULL THEN 'unexpected' "
    "WHEN expected IS NOT DISTINCT FROM observed THEN 'matches' ELSE 'differs' END AS status FROM "
    "(SELECT o_custkey AS k, count(*) AS expected FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1) e FULL JOIN "
    "(SELECT o_custkey AS k, count(*) AS observed FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY 1) o ON e.k = o.k",
)
def reconcile_groups(t: Tables) -> DataFrame:
    k = F.col("o_custkey").alias("k")
    expected = t.orders.filter("o_orderstatus <> 'F'").groupBy(k).agg(F.count("*").alias("n"))
    observed = t.orders.filter("o_orderpriority <> '1-URGENT'").groupBy(k).agg(F.count("*").alias("n"))
    return reconcile.reconcile(expected, observed, ["k"], "n")


VERDICTS = [
    "'r' || user_id AS run_id", "event_type || '_check' AS tool", "event_id",
    "CASE WHEN user_id % 4 = 0 THEN 'wide_numeric' ELSE 'tall_numeric' END AS profile",
    "CASE WHEN event_id % 7 = 0 THEN 'skipped' WHEN event_id % 7 = 1 THEN 'error' ELSE 'ok' END AS status",
    "CASE WHEN event_id % 2 = 0 THEN 'Limited to 50 COLUMNS; select fewer.' ELSE 'Skipped.' END AS summary",
    "CASE WHEN event_id % 3 = 0 THEN 'matches' WHEN event_id % 3 = 1 THEN 'differs' END AS match",
]
_TOOLS = (
    "CASE tool WHEN 'click_check' THEN 'duplicate_rows_check' WHEN 'error_check' THEN 'outlier_check' "
    "WHEN 'purchase_check' THEN 'class_imbalance_check' ELSE 'dataset_profile' END"
)
_VERDICT_SQL = (
    "(SELECT CAST(event_id AS VARCHAR) AS run_id, "
    f"{_TOOLS} AS tool, profile, status, summary, match FROM ({select_sql('events', VERDICTS)}) v) w"
)
_GUARD = (
    "(profile = 'wide_numeric' AND tool IN ('duplicate_rows_check', 'outlier_check', 'correlation_check') AND status = 'skipped' "
    "AND contains(lower(summary), 'column') AND regexp_matches(lower(summary), 'limit|most|select'))"
)
_JUDGED = (
    "SELECT run_id, tool, status, CASE WHEN status = 'ok' THEN match = 'matches' "
    f"WHEN {_GUARD} OR (status = 'skipped' AND profile <> 'wide_numeric' AND tool IN "
    "('outlier_check', 'correlation_check', 'constant_columns_check', 'high_cardinality_check')) THEN NULL ELSE false END AS correctness_pass, "
    f"{_GUARD} AS guard_pass FROM {_VERDICT_SQL}"
)


def _judged(t: Tables) -> DataFrame:
    rows = t.events.selectExpr(*VERDICTS).selectExpr(
        "CAST(event_id AS STRING) AS run_id", f"{_TOOLS} AS tool", "profile", "status", "summary", "match"
    )
    comparisons = rows.filter("match IS NOT NULL").select("run_id", "tool", F.col("match").alias("status"))
    return reconcile.judge_observations(rows.drop("match"), comparisons)


@query("judge_observations", f"SELECT run_id, tool, correctness_pass, guard_pass FROM ({_JUDGED}) j")
def judge_observations(t: Tables) -> DataFrame:
    return _judged(t).select("run_id", "tool", "correctness_pass", "guard_pass")


@query(
    "reverify",
    "SELECT run_id, tool, original, correctness_pass AS verified_correctness_pass, "
    f"guard_pass AS verified_guard_pass, CASE WHEN status = 'ok' THEN 'exact' ELSE 'unassessed' END AS verified_exactness "
    f"FROM (SELECT *, status = 'ok' AS original FROM ({_JUDGED}) j) k",
)
def reverify(t: Tables) -> DataFrame:
    judged = _judged(t)
    original = judged.select("run_id", "tool", "status", (F.col("status") == "ok").alias("original"))
    return reconcile.reverify(original, judged).drop("status")


@query(
    "scenario_verdicts",
    "WITH o AS (SELECT user_id AS scenario, event_type AS tool, count(*) AS n FROM events WHERE event_id % 9 <> 0 GROUP BY 1, 2), "
    "x AS (SELECT user_id AS scenario, event_type AS tool, count(*) AS n, "
    "'Unexpected count for ' || event_type AS reason FROM events GROUP BY 1, 2), "
    "j AS (SELECT x.scenario, x.tool, o.n IS NULL AS absent, o.n IS NOT NULL AND o.n <> x.n AS wrong, reason FROM x LEFT JOIN o USING (scenario, tool)) "
    "SELECT scenario, CASE WHEN bool_or(absent) THEN 'partial' WHEN bool_or(wrong) THEN 'fail' ELSE 'pass' END AS status, "
    "coalesce(string_agg(r, '; ' ORDER BY r), '') AS reasons FROM (SELECT *, CASE WHEN absent THEN 'Required diagnostic never called: ' || tool "
    "WHEN wrong THEN reason END AS r FROM j) k GROUP BY scenario",
)
def scenario_verdicts(t: Tables) -> DataFrame:
    grouped = t.events.groupBy(F.col("user_id").alias("scenario"), F.col("event_type").alias("tool"))
    expected = grouped.agg(F.count("*").alias("value")).select(
        "scenario", "tool", F.lit("count").alias("key"), "value",
        F.concat(F.lit("Unexpected count for "), "tool").alias("reason"),
    )
    seen = t.events.filter("event_id % 9 <> 0").groupBy(
        F.col("user_id").alias("scenario"), F.col("event_type").alias("tool")
    )
    observed = seen.agg(F.count("*").alias("value")).select(
        "scenario", "tool", F.lit("count").alias("key"), "value"
    )
    verdicts = reconcile.scenario_verdicts(expected, observed)
    return verdicts.withColumn("reasons", F.array_join("reasons", "; "))


@query(
    "stored_results",
    "SELECT user_id, event_type AS tool FROM (SELECT DISTINCT user_id, event_type FROM events) r WHERE NOT EXISTS "
    "(SELECT 1 FROM events s WHERE s.event_id % 10 = 0 AND s.event_id % 4 <> 0 AND s.user_id = r.user_id AND s.event_type = r.event_type)",
)
def stored_results(t: Tables) -> DataFrame:
    """Requested checks without a usable stored result."""
    from gaugeline.checks import missing_requests

    def keyed(df: DataFrame) -> DataFrame:
        return df.select(
            F.col("user_id").cast("string").alias("fingerprint"), F.col("event_type").alias("tool"),
            F.lit(None).cast("string").alias("target"), F.lit("").alias("subset"),
            F.lit("default").alias("settings_key"), "user_id",
            F.when(F.col("event_id") % 4 == 0, "error").otherwise("ok").alias("status"),
        )

    requested = keyed(t.events).drop("status").distinct()
    stored = keyed(t.events.filter("event_id % 10 = 0")).drop("user_id")
    return missing_requests(requested, stored).select("user_id", "tool")


@query(
    "stored_results_appended",
    "SELECT user_id, event_type AS tool, CASE WHEN bool_or(event_id % 3 = 0) THEN count(*) FILTER (WHERE event_id % 3 = 0) "
    "ELSE count(*) END AS found, CASE WHEN bool_or(event_id % 3 = 0) THEN 1 ELSE 2 END AS run, 0 AS added_again "
    "FROM events GROUP BY user_id, event_type",
)
def stored_results_appended(t: Tables) -> DataFrame:
    """A second run adds the results the first one lacks; a third one finds nothing to add."""
    store, keys = Store(t.spark, files.work_dir(t.spark, "results")), ["user_id", "tool"]

    def results(events: DataFrame, run: int) -> DataFrame:
        counted = events.groupBy("user_id", F.col("event_type").alias("tool")).agg(F.count("*").alias("found"))
        return counted.withColumn("run", F.lit(run))

    store.append_missing(results(t.events.filter("event_id % 3 = 0"), 1), keys)
    store.append_missing(results(t.events, 2), keys)
    again = store.append_missing(results(t.events, 3), keys)
    return store.read().withColumn("added_again", F.lit(again))


_FILES = "(SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || ' ' ELSE text END AS text FROM documents WHERE doc_id % 11 <> 0) d"


@query(
    "file_differences",
    "SELECT 'docs/' || l.doc_id AS path, CASE WHEN d.doc_id IS NULL THEN 'missing' WHEN d.text <> l.text THEN 'differs' ELSE 'matches' END AS status "
    f"FROM documents l LEFT JOIN {_FILES} ON l.doc_id = d.doc_id",
)
def file_differences(t: Tables) -> DataFrame:
    """A manifest of all documents against a later copy that lost and changed some."""
    path = F.concat(F.lit("docs/"), F.col("doc_id").cast("string")).alias("path")
    listed = t.documents.select(
        path, F.sha2("text", 256).alias("sha256"), F.octet_length("text").alias("bytes")
    )
    later = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    actual = t.documents.filter("doc_id % 11 <> 0").select(
        path, F.sha2(later, 256).alias("sha256"), F.octet_length(later).alias("length")
    )
    return reconcile.file_differences(listed, actual)
