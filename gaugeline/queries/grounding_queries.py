"""Grounding rules on reports derived from the events table.

A run is a user; its checks are the event types seen for that user, with the number of
events and the last event id as result.  Reports repeat those facts, and keys decide
which of them are altered, so every rule finds cases in every size of table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.operators import findings, ranking
from gaugeline.plans import evidence, grounding, reconcile
from gaugeline.queries.registry import Tables, query
from gaugeline.settings import Settings
from gaugeline.sources import files

SEVERITY = "CASE WHEN n >= 15 THEN 'high' WHEN n >= 10 THEN 'medium' ELSE 'low' END"
CLAIMED = f"CASE WHEN n % 6 = 0 THEN 'high' ELSE {SEVERITY} END"
COLUMN = "CASE WHEN n % 2 = 0 THEN NULL ELSE tool END"
STATUS = "CASE WHEN n % 5 = 0 THEN 'skipped' ELSE 'ok' END"
SPOKEN = "CASE WHEN n % 9 = 0 THEN n + 500000 ELSE n END"
CITED = "CASE WHEN n % 8 = 0 THEN 'unknown_tool' ELSE tool END"

BASE_SQL = (
    "WITH base AS (SELECT CAST(user_id AS VARCHAR) AS run_id, user_id, event_type AS tool, count(*) AS n, "
    "max(event_id) AS last_id, row_number() OVER (PARTITION BY user_id ORDER BY min(event_id)) AS sequence, "
    "min(event_id) AS first_id FROM events GROUP BY user_id, event_type), "
    f"obs AS (SELECT *, {STATUS} AS status, {SEVERITY} AS severity, {COLUMN} AS \"column\", "
    "n || ' events, last ' || last_id AS evidence FROM base), "
    "issues AS (SELECT run_id, user_id, sequence, tool AS source_tool, n, "
    f"{CLAIMED} AS severity, {COLUMN} AS \"column\", n || ' events, last ' || last_id AS evidence "
    "FROM base WHERE n % 4 <> 0), "
    "good AS (SELECT i.* FROM issues i JOIN obs o ON i.run_id = o.run_id AND i.source_tool = o.tool "
    "AND o.status = 'ok' AND i.severity = o.severity) "
)


def base(t: Tables) -> DataFrame:
    per = t.events.groupBy("user_id", F.col("event_type").alias("tool")).agg(
        F.count("*").alias("n"), F.max("event_id").alias("last_id"), F.min("event_id").alias("first_id")
    )
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("first_id"))
    return per.withColumn("run_id", F.col("user_id").cast("string")).withColumn("sequence", order)


def observations(t: Tables) -> DataFrame:
    text = F.concat(F.col("n").cast("string"), F.lit(" events, last "), F.col("last_id").cast("string"))
    source = base(t).withColumn("severity", F.expr(SEVERITY)).withColumn("evidence", text)
    finding = F.struct(
        F.lit("Activity").alias("issue"), "severity", F.expr(COLUMN).alias("column"), "evidence",
        F.lit("Volume differs by type.").alias("impact"), F.lit("Review it.").alias("recommendation"),
    )
    return source.select(
        "run_id", "sequence", "tool", F.expr(STATUS).alias("status"),
        F.concat("tool", F.lit(" looked at "), F.col("n").cast("string"), F.lit(" events.")).alias("summary"),
        F.to_json(
            F.struct(F.lit("424242").alias("dataset_hash"), F.col("n").alias("events7"), "evidence")
        ).alias("result"),
        F.array(finding).alias("findings"),
        F.struct(
            (F.col("n") % 3).alias("columns_omitted"),
            F.when(F.col("n") % 7 == 0, "Output is bounded.").alias("output_limitation"),
            F.lit(None).cast("string").alias("coverage_limitation"),
        ).alias("execution"),
    )


def reports(t: Tables) -> DataFrame:
    source = base(t)
    text = F.concat(F.col("n").cast("string"), F.lit(" events, last "), F.col("last_id").cast("string"))
    issue = F.struct(
        F.col("tool").alias("source_tool"), F.lit("Activity").alias("issue"),
        F.expr(CLAIMED).alias("severity"), F.expr(COLUMN).alias("column"), text.alias("evidence"),
        F.lit("Volume differs by type.").alias("impact"), F.lit("Review it.").alias("recommendation"),
    )
    note = F.struct(
        F.concat("tool", F.lit(" has "), F.expr(SPOKEN).cast("string"), F.lit(" events.")).alias("text"),
        F.array(F.expr(CITED)).alias("source_tools"),
    )

    def ordered(value, keep=None):
        entry = F.struct("sequence", value.alias("v"))
        listed = F.array_sort(F.collect_list(entry if keep is None else F.when(keep, entry)))
        return F.transform(listed, lambda x: x["v"])

    # a run holds one entry per event type, so these lists are short
    rows = source.groupBy("run_id", "user_id").agg(
        ordered(issue, F.col("n") % 4 != 0).alias("issues"),
        ordered(note).alias("interpretation"),
        F.max("last_id").alias("last_id"),
    )
    user = F.col("user_id")
    said = F.when(user % 3 == 0, F.col("last_id") + 1000000).otherwise(F.col("last_id"))
    extra = (
        F.when(user % 7 == 0, F.array(F.lit("The data is fully clean.")))
        .when(user % 7 == 1, F.array(F.lit("It is not fully balanced.")))
        .otherwise(F.array().cast("array<string>"))
    )
    steps = F.when(user % 10 == 0, F.array().cast("array<string>")).otherwise(
        F.array_append(extra, F.lit("Review the data."))
    )
    return rows.select(
        "run_id",
        F.when(user % 2 == 0, "Is my TARGET distribution a problem?").otherwise("Any missing data?").alias("question"),
        F.when(user % 4 != 0, "label").alias("target"),
        F.concat(F.lit("The last event is "), said.cast("string"), F.lit(".")).alias("summary"),
        "issues", "interpretation", steps.alias("next_steps"),
    )


def _stored(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Reports and observations as written tables, the form in which runs are kept."""
    return files.materialized(reports(t), "reports"), files.materialized(observations(t), "observations")


_ISSUE_COLUMNS = "run_id, source_tool, severity, \"column\", evidence"


@query("issues_supported", f"{BASE_SQL} SELECT {_ISSUE_COLUMNS} FROM good")
def issues_supported(t: Tables) -> DataFrame:
    found = grounding.supported_issues(reports(t), observations(t))
    return found.select("run_id", "source_tool", "severity", "column", "evidence")


@query(
    "issues_unsupported",
    f"{BASE_SQL} SELECT {_ISSUE_COLUMNS} FROM issues i WHERE NOT EXISTS "
    "(SELECT 1 FROM good g WHERE g.run_id = i.run_id AND g.source_tool = i.source_tool)",
)
def issues_unsupported(t: Tables) -> DataFrame:
    found = grounding.unsupported_issues(reports(t), observations(t))
    return found.select("run_id", "source_tool", "severity", "column", "evidence")


_RESTORED = (
    "SELECT run_id, tool AS source_tool, severity, evidence, 'restored' AS origin FROM obs o WHERE status = 'ok' "
    "AND NOT EXISTS (SELECT 1 FROM issues i WHERE i.run_id = o.run_id AND i.source_tool = o.tool)"
)
_FINAL = f"SELECT run_id, source_tool, severity, evidence, 'report' AS origin FROM issues UNION ALL {_RESTORED}"


@query("findings_restored", f"{BASE_SQL} {_FINAL}")
def findings_restored(t: Tables) -> DataFrame:
    found = grounding.final_issues(reports(t), observations(t))
    return found.select("run_id", "source_tool", "severity", "evidence", "origin")


@query(
    "tools_used",
    f"{BASE_SQL} SELECT run_id, string_agg(tool, ',' ORDER BY sequence) AS tools FROM obs GROUP BY run_id",
)
def tools_used(t: Tables) -> DataFrame:
    used = grounding.tools_used(observations(t))
    return used.select("run_id", F.array_join("tools_used", ",").alias("tools"))


@query(
    "report_limitations",
    BASE_SQL + ", notes AS (SELECT run_id, sequence * 10 + 0 AS place, tool || ' looked at ' || n || ' events.' AS limitation FROM obs WHERE status = 'skipped' "
    "UNION ALL SELECT run_id, sequence * 10 + 1, 'Output is bounded.' FROM obs WHERE n % 7 = 0 "
    "UNION ALL SELECT run_id, sequence * 10 + 3, tool || ' did not assess ' || (n % 3) || ' columns; inspect its coverage.' FROM obs WHERE n % 3 > 0 "
    "UNION ALL SELECT DISTINCT run_id, 1000000, 'Select a target column to assess class imbalance.' FROM obs WHERE user_id % 4 = 0) "
    "SELECT run_id, limitation, row_number() OVER (PARTITION BY run_id ORDER BY min(place)) AS position "
    "FROM notes GROUP BY run_id, limitation",
)
def report_limitations(t: Tables) -> DataFrame:
    return grounding.limitations(reports(t), observations(t))


@query(
    "report_assessments",
    f"{BASE_SQL}, f AS (SELECT run_id, count(*) AS findings FROM ({_FINAL}) x GROUP BY run_id), "
    "d AS (SELECT run_id, count(*) FILTER (WHERE status = 'ok') AS completed FROM obs GROUP BY run_id) "
    "SELECT d.run_id, coalesce(findings, 0) AS findings, completed, coalesce(findings, 0) || ' verified finding(s) from ' || "
    "completed || ' completed diagnostic(s). Results apply to the selected checks and their stated coverage.' AS assessment_summary "
    "FROM d LEFT JOIN f USING (run_id)",
)
def report_assessments(t: Tables) -> DataFrame:
    return grounding.assessments(reports(t), observations(t))


_RULES = {
    "unsupported_issue": "SELECT run_id, 'unsupported_issue' AS rule FROM issues i WHERE NOT EXISTS "
    "(SELECT 1 FROM good g WHERE g.run_id = i.run_id AND g.source_tool = i.source_tool)",
    "next_step_missing": "SELECT DISTINCT run_id, 'next_step_missing' FROM obs WHERE user_id % 10 = 0",
    "unknown_tool": "SELECT run_id, 'unknown_tool' FROM obs WHERE n % 8 = 0",
    "ungrounded_number": "SELECT run_id, 'ungrounded_number' FROM (SELECT run_id, user_id, max(last_id) AS m FROM obs GROUP BY 1, 2) s "
    "WHERE user_id % 3 = 0 UNION ALL SELECT run_id, 'ungrounded_number' FROM obs WHERE n % 9 = 0 OR n % 8 = 0",
    "unsupported_assurance": "SELECT DISTINCT run_id, 'unsupported_assurance' FROM obs WHERE user_id % 7 = 0 AND user_id % 10 <> 0",
}
_VIOLATIONS = " UNION ALL ".join(_RULES.values())


@query(
    "narrative_violations",
    f"{BASE_SQL} SELECT run_id, rule, count(*) AS n FROM ({_VIOLATIONS}) v GROUP BY run_id, rule",
)
def narrative_violations(t: Tables) -> DataFrame:
    found = grounding.violations(*_stored(t))
    return found.groupBy("run_id", "rule").agg(F.count("*").alias("n"))


@query(
    "accepted_reports",
    f"{BASE_SQL} SELECT run_id FROM obs GROUP BY run_id HAVING run_id NOT IN (SELECT run_id FROM ({_VIOLATIONS}) v)",
)
def accepted_reports(t: Tables) -> DataFrame:
    accepted = grounding.validated_reports(*_stored(t))
    return accepted.select("run_id")


@query("ungrounded_turns")
def ungrounded_turns(t: Tables) -> DataFrame:
    """Numbers an assistant turn uses that no other turn of its conversation holds.

    Totals are added to the texts: written differently but equal in every third turn,
    wrong in the others.
    """
    turns = t.conversations.withColumn(
        "text",
        F.expr(
            "CASE WHEN role <> 'assistant' THEN text || ' Total 1,' || lpad(conv_id % 1000, 3, '0') || '.50' "
            "WHEN turn % 3 = 0 THEN text || ' Total ' || (1000 + conv_id % 1000) || '.5' "
            "ELSE text || ' Total ' || (7000 + turn) || '.25' END"
        ),
    )
    facts = turns.filter("role <> 'assistant'").select(
        F.col("conv_id").cast("string").alias("run_id"), F.col("turn").alias("sequence"),
        F.col("role").alias("tool"), F.lit("ok").alias("status"),
        F.to_json(F.struct("text")).alias("result"),
    )
    spoken = turns.filter("role = 'assistant'").select(
        F.col("conv_id").cast("string").alias("run_id"), F.col("text").alias("summary"),
        F.array().cast("array<struct<text:string,source_tools:array<string>>>").alias("interpretation"),
        F.array().cast("array<string>").alias("next_steps"),
    )
    return grounding.number_violations(spoken, facts).select("run_id", "rule", "detail")


# -- choosing and bounding observations ------------------------------------------------------


_LAST_OK = (
    "SELECT CAST(user_id AS VARCHAR) AS run_id, event_type AS tool, event_id AS sequence FROM "
    "(SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY "
    "CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END, CASE WHEN event_id % 3 = 0 THEN {s}event_id END NULLS LAST, event_id) AS k FROM events) e WHERE k = 1"
)


def _event_observations(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("tool"),
        F.col("event_id").alias("sequence"),
        F.when(F.col("event_id") % 3 == 0, "ok").otherwise("skipped").alias("status"),
    )


@query("supplied_last_ok", _LAST_OK.format(s="-"))
def supplied_last_ok(t: Tables) -> DataFrame:
    return grounding.supplied(_event_observations(t)).drop("status")


@query("supplied_first_ok", _LAST_OK.format(s=""))
def supplied_first_ok(t: Tables) -> DataFrame:
    return grounding.supplied(_event_observations(t), "first").drop("status")


def _event_findings(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("event_type").alias("source_tool"), F.col("event_id").alias("position"),
        F.lit("Event").alias("issue"), F.lit("low").alias("severity"),
        F.col("user_id").cast("string").alias("column"),
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("evidence"),
        F.lit("i").alias("impact"), F.lit("r").alias("recommendation"),
    )


@query(
    "findings_topn",
    "SELECT source_tool, position, rank, findings_total, greatest(0, findings_total - 20) AS findings_omitted FROM "
    "(SELECT event_type AS source_tool, event_id AS position, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rank, "
    "count(*) OVER (PARTITION BY event_type) AS findings_total FROM events) e WHERE rank <= 20",
)
def findings_topn(t: Tables) -> DataFrame:
    """The first twenty findings of each tool: the limit is the feature."""
    kept = findings.top_findings(_event_findings(t), ["source_tool"], "position", 20)
    return kept.select("source_tool", "position", "rank", "findings_total", "findings_omitted")


_SIZE = (
    "strlen('{\"issue\":\"Event\",\"severity\":\"low\",\"column\":\"' || user_id || '\",\"evidence\":\"e' || event_id || "
    "'\",\"impact\":\"i\",\"recommendation\":\"r\"}')"
)


@query(
    "findings_byte_budget",
    "SELECT source_tool, \"column\", position, running_bytes FROM (SELECT event_type AS source_tool, "
    "CAST(user_id AS VARCHAR) AS \"column\", event_id AS position, CAST(sum("
    f"{_SIZE}) OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS BIGINT) AS running_bytes FROM events) e WHERE running_bytes <= 600",
)
def findings_byte_budget(t: Tables) -> DataFrame:
    kept = findings.findings_within_bytes(_event_findings(t), ["source_tool", "column"], "position", 600)
    return kept.select("source_tool", "column", "position", "running_bytes")


@query(
    "bounded_observations",
    "SELECT tool, total AS findings_total, least(total, 5) AS kept, greatest(total - 5, 0) AS findings_omitted, "
    "total > 5 AS output_limited FROM (SELECT event_type || '_' || user_id AS tool, count(*) AS total FROM events GROUP BY event_type, user_id) e",
)
def bounded_observations(t: Tables) -> DataFrame:
    """Five of all findings of a tool are passed on; the others are counted."""
    named = _event_findings(t).withColumn("tool", F.concat("source_tool", F.lit("_"), F.col("column")))
    observed = named.select("tool", F.lit("ok").alias("status"), F.lit("Events.").alias("summary")).distinct()
    five = Settings(max_findings_per_tool=5)
    bounded = evidence.bound_observations(evidence.observed_findings(observed, named, ["tool"], five), five)
    return bounded.select(
        "tool", F.col("findings_total").cast("bigint").alias("findings_total"),
        F.size("findings").cast("bigint").alias("kept"),
        F.col("findings_omitted").cast("bigint").alias("findings_omitted"), "output_limited",
    )


_HEAD = "strlen('{\"tool\":\"' || tool || '\",\"status\":\"ok\",\"summary\":\"Events.\"}')"


@query(
    "observation_byte_budget",
    "SELECT tool, n AS findings_total, data_omitted, CASE WHEN data_omitted THEN fitting ELSE n END AS kept, "
    "n - CASE WHEN data_omitted THEN fitting ELSE n END AS findings_omitted, nonfinite FROM (SELECT tool, "
    "count(*) AS n, min(head) + min(data) + sum(size) > 2048 AS data_omitted, min(u) % 4 = 0 AS nonfinite, "
    "count(*) FILTER (WHERE running + head <= 2048) AS fitting FROM (SELECT *, "
    f"{_HEAD} AS head, 10 * (u % 130) + 4 AS data FROM (SELECT event_type || '_' || user_id AS tool, user_id AS u, {_SIZE} AS size, "
    f"sum({_SIZE}) OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS running FROM events) r) h GROUP BY tool) k",
)
def observation_byte_budget(t: Tables) -> DataFrame:
    """Details go first, then findings from the last on, until 2 KiB hold the rest."""
    named = _event_findings(t).withColumn("tool", F.concat("source_tool", F.lit("_"), F.col("column")))
    user = F.col("column").cast("bigint")
    observed = named.select(
        "tool", F.lit("ok").alias("status"), F.lit("Events.").alias("summary"),
        F.concat(F.lit('["'), F.repeat(F.lit("details..."), (user % 130).cast("int")), F.lit('"]')).alias("data"),
        (user % 4 == 0).cast("int").alias("nonfinite"),
    ).distinct()
    small = Settings(max_findings_per_tool=1_000_000, max_observation_bytes=2048)
    bounded = evidence.bound_observations(evidence.observed_findings(observed, named, ["tool"], small), small)
    return bounded.select(
        "tool", F.col("findings_total").cast("bigint").alias("findings_total"), (F.col("data") == "{}").alias("data_omitted"),
        F.size("findings").cast("bigint").alias("kept"), F.col("findings_omitted").cast("bigint").alias("findings_omitted"),
        F.col("coverage_limitation").isNotNull().alias("nonfinite"),
    )


@query(
    "event_sequence",
    "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events",
)
def event_sequence(t: Tables) -> DataFrame:
    """Numbering within a user, split by hour so that a busy user spreads over tasks."""
    hour = F.date_trunc("hour", F.col("ts"))
    return reconcile.event_sequence(
        t.events.select("event_id", "user_id", "ts"), ["user_id"], "ts", "event_id", bucket=hour
    ).drop("ts")


@query(
    "event_sequence_by_type",
    "SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS sequence FROM events",
)
def event_sequence_by_type(t: Tables) -> DataFrame:
    """A few keys with most of the rows, numbered in parts that the order's own ranges give."""
    events = t.events.select("event_id", "event_type", "ts")
    return ranking.numbered_rows(events, ["event_type"], ["ts", "event_id"], hot_rows=1).drop("ts")


@query(
    "evidence_bundles",
    f"{BASE_SQL} SELECT run_id, count(*) AS events, 1 AS schema_version, "
    "CASE WHEN user_id % 3 = 0 THEN '1 non-finite statistics were represented as null.' END AS note FROM obs GROUP BY run_id, user_id",
)
def evidence_bundles(t: Tables) -> DataFrame:
    users = t.events.select("user_id").distinct()
    facts = users.select(
        F.col("user_id").cast("string").alias("run_id"), F.lit("events").alias("filename"),
        F.when(F.col("user_id") % 3 == 0, F.lit(float("inf"))).otherwise(F.lit(1.0)).alias("import_seconds"),
    )
    bundles = evidence.evidence_bundle(observations(t), reports(t), facts)
    return bundles.select(
        "run_id",
        F.expr("json_array_length(get_json_object(bundle, '$.trace'))").cast("bigint").alias("events"),
        F.get_json_object("bundle", "$.schema_version").cast("int").alias("schema_version"),
        F.get_json_object("bundle", "$.serialization_note").alias("note"),
    )
