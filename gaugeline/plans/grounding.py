"""Do written reports claim only what the checks found?  All runs are judged in one job.

Inputs (one row per run, or per run and check):

``observations(run_id, sequence, tool, status, summary, result, findings, execution)``
with ``result`` as JSON text, and ``reports(run_id, question, target, summary, issues,
interpretation, next_steps)`` with arrays of structs.  Every rule is an equi join or an
expression; all joins carry the run id, so runs spread over the cluster.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline import fixed_values as V
from gaugeline.functions.text import json_number_keys, number_keys, unsupported_assurance
from gaugeline.sources.files import materialized

ISSUE_FIELDS = (
    "source_tool", "issue", "severity", "column", "evidence", "impact", "recommendation",
)
RESTORE_FIELDS = ("source_tool", "issue", "column", "evidence")
VIOLATION = ("run_id", "part", "position", "rule", "detail")


def _same(left: DataFrame, right: DataFrame, fields: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a & b, [left[f].eqNullSafe(right[f]) for f in ("run_id", *fields)])


def observed_findings(observations: DataFrame) -> DataFrame:
    """(run_id, sequence, position, issue fields) of completed checks."""
    ok = observations.filter(F.col("status") == "ok")
    return ok.select(
        "run_id", "sequence", F.col("tool").alias("source_tool"),
        F.posexplode("findings").alias("position", "f"),
    ).select("run_id", "sequence", "position", "source_tool", *[f"f.{c}" for c in ISSUE_FIELDS[1:]])


def report_issues(reports: DataFrame) -> DataFrame:
    listed = reports.select("run_id", F.posexplode("issues").alias("position", "i"))
    return listed.select("run_id", "position", *[f"i.{c}" for c in ISSUE_FIELDS])


def supported_issues(reports: DataFrame, observations: DataFrame) -> DataFrame:
    issues, known = report_issues(reports), observed_findings(observations)
    return issues.join(known, _same(issues, known, ISSUE_FIELDS), "left_semi")


def unsupported_issues(reports: DataFrame, observations: DataFrame) -> DataFrame:
    issues, known = report_issues(reports), observed_findings(observations)
    return issues.join(known, _same(issues, known, ISSUE_FIELDS), "left_anti")


def final_issues(reports: DataFrame, observations: DataFrame) -> DataFrame:
    """Report issues without repeats, then the findings the report left out, in order."""
    issues = report_issues(reports).withColumn("origin", F.lit("report"))
    issues = issues.withColumn("sequence", F.lit(0))
    first_issue = Window.partitionBy("run_id", *ISSUE_FIELDS).orderBy("position")
    kept = issues.withColumn("n", F.row_number().over(first_issue)).filter("n = 1").drop("n")
    found = observed_findings(observations).withColumn("origin", F.lit("restored"))
    first_found = Window.partitionBy("run_id", *RESTORE_FIELDS).orderBy("sequence", "position")
    found = found.withColumn("n", F.row_number().over(first_found)).filter("n = 1").drop("n")
    missing = found.join(kept, _same(found, kept, RESTORE_FIELDS), "left_anti")
    return kept.unionByName(missing)


def tools_used(observations: DataFrame) -> DataFrame:
    """(run_id, tools_used): distinct checks in the order of their first event."""
    ordered = F.array_sort(F.collect_list(F.struct("first", "tool")))
    firsts = observations.groupBy("run_id", "tool").agg(F.min("sequence").alias("first"))
    return firsts.groupBy("run_id").agg(
        F.transform(ordered, lambda x: x["tool"]).alias("tools_used")
    )


def supplied(observations: DataFrame, prefer: str = "last") -> DataFrame:
    """One observation per run and check: completed ones first, the last or first of them."""
    ok = F.col("status") == "ok"
    late = F.when(ok, F.col("sequence") if prefer == "first" else -F.col("sequence"))
    order = Window.partitionBy("run_id", "tool").orderBy(
        ok.desc(), late.asc_nulls_last(), F.col("sequence")
    )
    return observations.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")


def limitations(reports: DataFrame, observations: DataFrame) -> DataFrame:
    """(run_id, position, limitation): skipped checks, bounded output, missing target."""
    unfinished = F.when(F.col("status").isin("skipped", "error"), F.col("summary"))
    run = F.col("execution")
    gap = F.when(
        run["columns_omitted"] > 0,
        F.concat(
            "tool", F.lit(" did not assess "), run["columns_omitted"].cast("string"),
            F.lit(" columns; inspect its coverage."),
        ),
    )
    notes = F.array(unfinished, run["output_limitation"], run["coverage_limitation"], gap)
    listed = observations.select("run_id", "sequence", F.posexplode(notes).alias("place", "limitation"))
    asked = reduce(
        lambda a, b: a | b, [F.lower("question").contains(t) for t in V.TARGET_QUESTION_TERMS]
    )
    hint = reports.filter(F.col("target").isNull() & asked).select(
        "run_id", F.lit(2**31 - 1).alias("sequence"), F.lit(0).alias("place"),
        F.lit(V.TARGET_LIMITATION).alias("limitation"),
    )
    every = listed.unionByName(hint).filter(F.col("limitation").isNotNull() & (F.col("limitation") != ""))
    firsts = every.groupBy("run_id", "limitation").agg(
        F.min(F.struct("sequence", "place")).alias("first")
    )
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("first"))
    return firsts.select("run_id", place.alias("position"), "limitation")


def assessments(reports: DataFrame, observations: DataFrame) -> DataFrame:
    """(run_id, findings, completed, assessment_summary)."""
    found = final_issues(reports, observations).groupBy("run_id").agg(F.count("*").alias("findings"))
    done = observations.groupBy("run_id").agg(
        F.count_distinct(F.when(F.col("status") == "ok", F.col("tool"))).alias("completed")
    )
    joined = reports.select("run_id").join(found, "run_id", "left").join(done, "run_id", "left")
    joined = joined.na.fill(0, ["findings", "completed"])
    text = F.concat(
        F.col("findings").cast("string"), F.lit(" verified finding(s) from "),
        F.col("completed").cast("string"),
        F.lit(" completed diagnostic(s). Results apply to the selected checks and their stated coverage."),
    )
    return joined.withColumn("assessment_summary", text)


# -- narrative rules ------------------------------------------------------------------


def narrative_parts(reports: DataFrame) -> DataFrame:
    """(run_id, part, position, text, sources); NULL sources mean all observations."""
    every = F.lit(None).cast("array<string>")
    summary = reports.select(
        "run_id", F.lit("summary").alias("part"), F.lit(0).alias("position"),
        F.col("summary").alias("text"), every.alias("sources"),
    )
    notes = reports.select("run_id", F.posexplode("interpretation").alias("position", "i")).select(
        "run_id", F.lit("interpretation").alias("part"), "position", F.col("i.text").alias("text"),
        F.array_distinct("i.source_tools").alias("sources"),
    )
    steps = reports.select("run_id", F.posexplode("next_steps").alias("position", "text")).select(
        "run_id", F.lit("next_steps").alias("part"), "position", "text", every.alias("sources")
    )
    return summary.unionByName(notes).unionByName(steps)


def _violation(frame: DataFrame, rule: str, detail: Column, part=None, position=None) -> DataFrame:
    return frame.select(
        "run_id",
        (F.col("part") if part is None else F.lit(part)).alias("part"),
        (F.col("position") if position is None else F.lit(position)).cast("int").alias("position"),
        F.lit(rule).alias("rule"), detail.cast("string").alias("detail"),
    )


def shape_violations(reports: DataFrame, observations: DataFrame) -> DataFrame:
    """Missing interpretation or next steps, empty or overlong texts, overlong lists."""
    runs = observations.select("run_id").distinct()
    nothing = F.coalesce(F.size("interpretation"), F.lit(0)) <= 0
    silent = reports.filter(nothing).join(runs, "run_id", "left_semi")
    stuck = reports.filter(F.coalesce(F.size("next_steps"), F.lit(0)) <= 0)
    length = F.char_length("text")
    limit = F.when(F.col("part") == "interpretation", V.MAX_INTERPRETATION_CHARS).otherwise(
        V.MAX_NARRATIVE_CHARS
    )
    bad_text = narrative_parts(reports).filter(
        F.col("text").isNull() | (F.trim(F.regexp_replace("text", r"(?U)\s+", " ")) == "")
        | (length > limit)
    )
    bad_sources = narrative_parts(reports).filter(
        (F.col("part") == "interpretation")
        & (F.coalesce(F.size("sources"), F.lit(0)).between(1, V.MAX_LIST_ITEMS) == F.lit(False))
    )
    crowded = reports.filter(
        (F.size("interpretation") > V.MAX_LIST_ITEMS) | (F.size("next_steps") > V.MAX_LIST_ITEMS)
    )
    return reduce(
        DataFrame.unionByName,
        [
            _violation(silent, "interpretation_missing", F.lit(None), "interpretation", 0),
            _violation(stuck, "next_step_missing", F.lit(None), "next_steps", 0),
            _violation(bad_text, "text_shape", length),
            _violation(bad_sources, "source_list", F.size("sources")),
            _violation(crowded, "list_too_long", F.lit(None), "report", 0),
        ],
    )


def citation_violations(reports: DataFrame, observations: DataFrame) -> DataFrame:
    """Interpretations citing a check that did not run."""
    cited = narrative_parts(reports).select(
        "run_id", "part", "position", F.explode("sources").alias("tool")
    )
    ran = observations.select("run_id", "tool").distinct()
    return _violation(cited.join(ran, ["run_id", "tool"], "left_anti"), "unknown_tool", F.col("tool"))


def evidence_numbers(observations: DataFrame) -> DataFrame:
    """(run_id, tool, number) of the result each check supplied."""
    return supplied(observations).select(
        "run_id", "tool", F.explode(json_number_keys(F.col("result"))).alias("number")
    ).distinct()


def number_violations(reports: DataFrame, observations: DataFrame) -> DataFrame:
    """Numbers in a text that its evidence does not hold.

    Interpretations may use numbers of the checks they cite, other texts any number of
    the run.
    """
    parts = narrative_parts(reports).select(
        "run_id", "part", "position", "sources", F.explode(number_keys(F.col("text"))).alias("number")
    )
    anywhere = observations.select(
        "run_id", F.explode(json_number_keys(F.col("result"))).alias("number")
    ).distinct()
    open_parts = parts.filter(F.col("sources").isNull())
    loose = open_parts.join(anywhere, ["run_id", "number"], "left_anti")
    claims = parts.filter(F.col("sources").isNotNull())
    backed = (
        claims.select("run_id", "part", "position", "number", F.explode("sources").alias("tool"))
        .join(evidence_numbers(observations), ["run_id", "tool", "number"], "left_semi")
        .select("run_id", "part", "position", "number")
    )
    unbacked = claims.join(backed, ["run_id", "part", "position", "number"], "left_anti")
    return _violation(loose.unionByName(unbacked), "ungrounded_number", F.col("number"))


def assurance_violations(reports: DataFrame) -> DataFrame:
    bold = narrative_parts(reports).filter(unsupported_assurance(F.col("text")))
    return _violation(bold, "unsupported_assurance", F.lit(None))


def issue_violations(reports: DataFrame, observations: DataFrame) -> DataFrame:
    wrong = unsupported_issues(reports, observations)
    return _violation(wrong, "unsupported_issue", F.col("issue"), part="issues")


def violations(reports: DataFrame, observations: DataFrame) -> DataFrame:
    """Every broken rule of every run."""
    return reduce(
        DataFrame.unionByName,
        [
            issue_violations(reports, observations),
            shape_violations(reports, observations),
            citation_violations(reports, observations),
            number_violations(reports, observations),
            assurance_violations(reports),
        ],
    )


def validated_reports(reports: DataFrame, observations: DataFrame) -> DataFrame:
    """Runs that break no rule, with issues, tools, limitations and assessment filled in."""
    # four joins below start from the accepted runs, so the verdict is written once
    broken = materialized(
        violations(reports, observations).select("run_id").distinct(), "rejected-runs"
    )
    accepted = reports.join(broken, "run_id", "left_anti")
    entry = F.struct("origin", "sequence", "position", F.struct(*ISSUE_FIELDS).alias("issue"))
    issues = final_issues(accepted, observations).groupBy("run_id").agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["issue"]).alias("final_issues")
    )
    limits = limitations(accepted, observations).groupBy("run_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("position", "limitation"))),
            lambda x: x["limitation"],
        ).alias("limitations")
    )
    assessed = assessments(accepted, observations).select("run_id", "assessment_summary")
    return (
        accepted.select("run_id", "summary", "interpretation", "next_steps")
        .join(issues, "run_id", "left")
        .join(tools_used(observations), "run_id", "left")
        .join(limits, "run_id", "left")
        .join(assessed, "run_id", "left")
    )
