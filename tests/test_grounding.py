import json

import pytest
from pyspark.sql import functions as F

from gaugeline import checks as C
from gaugeline.plans import evidence, grounding, reconcile
from gaugeline.settings import Settings

FINDING = ("Class imbalance", "high", "label", "Majority/minority ratio 9.0:1", "impact", "advice")
ISSUE = ("class_imbalance_check", *FINDING)
OBS = (
    "run_id string, sequence int, tool string, status string, summary string, result string, "
    f"findings array<{C.findings.FINDING_TYPE}>, "
    "execution struct<columns_omitted:int,output_limitation:string,coverage_limitation:string>"
)
REP = (
    "run_id string, question string, target string, summary string, "
    "issues array<struct<source_tool:string,issue:string,severity:string,`column`:string,evidence:string,impact:string,recommendation:string>>, "
    "interpretation array<struct<text:string,source_tools:array<string>>>, next_steps array<string>"
)


def observation(sequence=1, tool="class_imbalance_check", status="ok", findings=(FINDING,), **result):
    body = json.dumps({"dataset_hash": "777", "summary": "ratio 1.5:1.", "data": result or {"rows": 100}})
    return ("r", sequence, tool, status, f"{tool} {status}", body, list(findings), (0, None, None))


def report(summary="The ratio is 1.5:1.", issues=(ISSUE,), notes=(("Ratio 1.5 over 100 rows.", ["class_imbalance_check"]),),
           steps=("Collect more data.",), question="Is it fine?", target="label"):
    return ("r", question, target, summary, list(issues), list(notes), list(steps))


def rules(spark, rep, *obs):
    reports = spark.createDataFrame([rep], REP)
    observed = spark.createDataFrame(list(obs) or [observation()], OBS)
    return sorted({r["rule"] for r in grounding.violations(reports, observed).collect()})


@pytest.mark.parametrize(
    "change, expected",
    [
        ({}, []),
        ({"summary": "The ratio is 7.25:1."}, ["ungrounded_number"]),
        ({"summary": "Exactly 777 rows."}, ["ungrounded_number"]),
        ({"steps": ("Look at .77 of it.",)}, ["ungrounded_number"]),
        ({"notes": (("Ratio 0.77.", ["class_imbalance_check"]),)}, ["ungrounded_number"]),
        ({"notes": (("Strong.", ["correlation_check"]),)}, ["unknown_tool"]),
        ({"summary": "The table is completely clean."}, ["unsupported_assurance"]),
        ({"summary": "It is not bad. It is completely clean."}, ["unsupported_assurance"]),
        ({"summary": "It cannot be described as fully balanced."}, []),
        ({"notes": ()}, ["interpretation_missing"]),
        ({"steps": ()}, ["next_step_missing"]),
        ({"summary": "  "}, ["text_shape"]),
        ({"summary": "x" * 2401}, ["text_shape"]),
        ({"notes": (("Fine.", []),)}, ["source_list"]),
        ({"steps": ("go",) * 7}, ["list_too_long"]),
        ({"issues": (("class_imbalance_check", "Invented", *FINDING[1:]),)}, ["unsupported_issue"]),
        ({"issues": ()}, []),
    ],
)
def test_one_mutation_per_rule(spark, change, expected):
    assert rules(spark, report(**change)) == expected


def test_numbers_only_from_cited_checks(spark):
    other = observation(2, "outlier_check", findings=(), bound=44.5)
    note = (("Bound 44.5.", ["class_imbalance_check"]),)
    assert rules(spark, report(notes=note), observation(), other) == ["ungrounded_number"]
    cited = (("Bound 44.50.", ["class_imbalance_check", "outlier_check"]),)
    assert rules(spark, report(notes=cited, summary="Up to 44.5."), observation(), other) == []


def test_earlier_success_still_counts(spark):
    repeat = observation(2, status="skipped", findings=(), note="again")
    assert rules(spark, report(), observation(), repeat) == []


def test_validated_report(spark):
    skipped = observation(2, "outlier_check", "skipped", ())
    second = observation(3, "missing_values_check", "ok", [("Missing values", "low", None, "1/30", "i", "r")] * 2, n=1)
    observed = spark.createDataFrame([observation(), skipped, second], OBS)
    reports = spark.createDataFrame([report(issues=(ISSUE, ISSUE), question="Class DISTRIBUTION?", target=None)], REP)
    row = grounding.validated_reports(reports, observed).first()
    assert [i["issue"] for i in row["final_issues"]] == ["Class imbalance", "Missing values"]
    assert row["tools_used"] == ["class_imbalance_check", "outlier_check", "missing_values_check"]
    assert row["limitations"] == ["outlier_check skipped", "Select a target column to assess class imbalance."]
    assert row["assessment_summary"].startswith("2 verified finding(s) from 2 completed diagnostic(s).")


def test_bounded_observations(spark):
    many = [("Missing values", "low", f"c{i}", "1/30", "i" * 50, "r" * 50) for i in range(45)]
    observed = spark.createDataFrame([observation(findings=many), observation(2, "x" * 3000, findings=many[:1])], OBS)
    rows = evidence.bound_observations(observed, Settings(max_observation_bytes=2048)).orderBy("sequence").collect()
    first, second = rows
    assert first["findings_total"] == 45 and 0 < len(first["findings"]) < 20
    assert first["findings_omitted"] == 45 - len(first["findings"]) and first["output_limited"]
    assert [f["column"] for f in first["findings"]] == [f"c{i}" for i in range(len(first["findings"]))]
    assert second["status"] == "skipped" and second["findings"] == [] and second["findings_omitted"] == 1
    loose = evidence.bound_observations(observed).orderBy("sequence").first()
    assert len(loose["findings"]) == 20 and loose["findings_omitted"] == 25


def test_bounded_data_and_entries(spark):
    data = {"rows": 5, "pairs": list(range(25)), "dtypes": {f"c{i}": "int64" for i in range(60)}}
    kept, omitted = evidence.bounded_data(data, Settings.interactive())
    assert (len(kept["pairs"]), len(kept["dtypes"]), kept["rows"]) == (20, 50, 5)
    assert omitted == {"pairs": 5, "dtypes": 10}
    assert len(evidence.bounded_data(data)[0]["dtypes"]) == 60
    entries = spark.range(30).selectExpr("id % 2 AS k", "id AS place")
    rows = evidence.bounded_entries(entries, ["k"], "place", 4).collect()
    assert len(rows) == 8 and {r["entries_omitted"] for r in rows} == {11}
    assert sorted(r["place"] for r in rows) == list(range(8))


def test_suite_feeds_grounding(spark):
    df = spark.range(100).selectExpr("CASE WHEN id % 4 = 0 THEN NULL ELSE id END AS v", "IF(id >= 90, 'p', 'n') AS label")
    observed = C.suite(df, ["missing_values_check", "class_imbalance_check"], "label", run_id="r")
    notes = (("A quarter, 25.0%, is missing.", ["missing_values_check"]), ("The ratio is 9:1.", ["class_imbalance_check"]))
    reports = spark.createDataFrame([report("25 of 100 values are missing.", (), notes)], REP)
    assert grounding.violations(reports, observed).collect() == []
    final = grounding.validated_reports(reports, observed).first()
    assert [i["severity"] for i in final["final_issues"]] == ["medium", "high"]
    facts = spark.createDataFrame([("r", "t.csv", float("nan"))], "run_id string, filename string, import_seconds double")
    bundle = json.loads(evidence.evidence_bundle(observed, reports, facts).first()["bundle"])
    assert len(bundle["trace"]) == 2 and "1 non-finite" in bundle["serialization_note"]


def test_schema_context_hides_values(spark):
    df = spark.createDataFrame([("private", 1)], "name string, n long")
    context = evidence.schema_context(df, "n", Settings(max_schema_columns=1)).collect()
    assert [tuple(r) for r in context] == [(1, "n", "int64", "numeric", True, 1, 1)]
    assert "private" not in str(context)


def test_event_sequence_split_equals_plain(spark):
    df = spark.range(300).selectExpr("IF(id % 3 = 0, 0, id % 20) AS k", "(id * 37) % 300 AS t")
    plain = reconcile.event_sequence(df, ["k"], "t")
    split = reconcile.event_sequence(df, ["k"], "t", bucket=F.floor(F.col("t") / 25))
    assert sorted(plain.collect()) == sorted(split.collect())


def test_file_and_scenario_status(spark):
    listed = spark.createDataFrame([("a", "h1", 1), ("b", "h2", None), ("c", "h3", 3)], "path string, sha256 string, bytes long")
    actual = spark.createDataFrame([("a", "h1", 1), ("b", "other", 5)], "path string, sha256 string, length long")
    got = {r["path"]: r["status"] for r in reconcile.file_differences(listed, actual).collect()}
    assert got == {"a": "matches", "b": "differs", "c": "missing"}
    expected = spark.createDataFrame(
        [("T1", "m", "age", 6, "ages"), ("T1", "m", None, None, None), ("T2", "d", "n", 2, "copies"), ("T3", "o", "x", 1, "x")],
        "scenario string, tool string, key string, value long, reason string",
    )
    seen = spark.createDataFrame([("T1", "m", "age", 6), ("T2", "d", "n", 3)], "scenario string, tool string, key string, value long")
    got = {r["scenario"]: (r["status"], r["reasons"]) for r in reconcile.scenario_verdicts(expected, seen).collect()}
    assert got == {"T1": ("pass", []), "T2": ("fail", ["copies"]), "T3": ("partial", ["Required diagnostic never called: o"])}


def test_judgements_are_three_valued(spark):
    rows = [
        ("1", "tall_numeric", "missing_values_check", "ok", ""), ("2", "wide_numeric", "outlier_check", "skipped", "at most 20 columns"),
        ("3", "tall_numeric", "correlation_check", "skipped", "memory"), ("4", "tall_numeric", "missing_values_check", "error", "x"),
        ("5", "tall_numeric", "outlier_check", "ok", ""),
    ]
    observed = spark.createDataFrame(rows, "run_id string, profile string, tool string, status string, summary string")
    compared = spark.createDataFrame([("1", "missing_values_check", "matches")], "run_id string, tool string, status string")
    got = {r["run_id"]: (r["correctness_pass"], r["guard_pass"]) for r in reconcile.judge_observations(observed, compared).collect()}
    assert got == {"1": (True, False), "2": (None, True), "3": (None, False), "4": (False, False), "5": (None, False)}
