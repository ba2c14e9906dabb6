import json
import math

import pytest

from gaugeline import checks as C
from gaugeline.operators import classes, distinct, metrics, numeric
from gaugeline.settings import Settings
from gaugeline.sources import synthetic


def gaps_and_copies(spark):
    rows = [
        (
            None if i % 4 == 1 and i < 24 else i / 8,
            None if i % 9 == 0 and i < 27 else 7.5 * i - 3,
            "north east south west".split()[i * i % 4 + i % 2],
            "fixed",
        )
        for i in range(28)
    ]
    rows += [rows[2], rows[6]]
    return spark.createDataFrame(rows, "depth double, flow double, side string, plant string")


def test_missing_duplicates_constants(spark):
    ds = C.Dataset(gaps_and_copies(spark))
    missing = ds.run_check("missing_values_check")
    assert missing.data["affected_columns"] == [
        {"column": "depth", "missing_count": 6, "missing_pct": 20.0, "severity": "medium"},
        {"column": "flow", "missing_count": 3, "missing_pct": 10.0, "severity": "medium"},
    ]
    assert missing.findings[0]["evidence"] == "6/30 values missing (20.0%)"
    copies = ds.run_check("duplicate_rows_check")
    assert copies.data == {"duplicate_count": 2, "duplicate_pct": 6.67}
    assert copies.findings[0]["column"] is None
    constant = ds.run_check("constant_columns_check")
    assert [c["column"] for c in constant.data["constant_columns"]] == ["plant"]
    assert "100.00%" in constant.findings[0]["evidence"]
    json.dumps([missing.to_dict(), copies.to_dict(), constant.to_dict()])


def test_class_imbalance(spark):
    rows = [(f"R{i:03d}", i % 9, 7 * i % 13, "positive" if i >= 90 else "negative") for i in range(100)]
    ds = C.Dataset(spark.createDataFrame(rows, "record_id string, a long, b long, label string"))
    seen = ds.run_check("class_imbalance_check", "label")
    assert seen.data["majority_minority_ratio"] == 9.0
    assert seen.data["classes"][1] == {"class": "positive", "count": 10, "proportion": 0.1, "percentage": 10.0}
    assert seen.findings[0]["severity"] == "high"
    assert seen.findings[0]["evidence"] == (
        "Majority/minority ratio 9.0:1; counts [{'class': 'negative', 'count': 90, 'proportion': 0.9, "
        "'percentage': 90.0}, {'class': 'positive', 'count': 10, 'proportion': 0.1, 'percentage': 10.0}]"
    )
    unique = ds.run_check("high_cardinality_check")
    assert [c["column"] for c in unique.data["candidates"]] == ["record_id"]
    many = ds.run_check("class_imbalance_check", "record_id", Settings.interactive())
    assert many.status == "skipped" and many.data == {"unique_classes": 100}
    assert ds.run_check("class_imbalance_check").status == "skipped"
    assert ds.run_check("class_imbalance_check", "nowhere").status == "skipped"


def test_moderate_classes_give_no_finding(spark):
    rows = [(f"row_{i:03d}", i, "negative" if i < 60 else "positive") for i in range(100)]
    seen = C.run_check(spark.createDataFrame(rows, "record_id string, f long, label string"), "class_imbalance_check", "label")
    assert seen.data["majority_minority_ratio"] == 1.5 and seen.findings == []


def test_outliers_and_correlation(spark):
    xs = [*range(1, 30), 200]
    rows = [(x, 2 * x + 1, 3 * i % 11) for i, x in enumerate(xs)]
    ds = C.Dataset(spark.createDataFrame(rows, "feature_x long, feature_y long, feature_z long"))
    seen = ds.run_check("outlier_check")
    got = {c["column"]: (c["outlier_count"], c["lower_bound"], c["upper_bound"]) for c in seen.data["columns"]}
    assert got == {"feature_x": (1, -13.5, 44.5), "feature_y": (1, -26.0, 90.0), "feature_z": (0, -6.0, 16.0)}
    assert seen.findings[0]["evidence"] == "1/30 values outside [-13.5, 44.5] (3.33%)"
    pairs = ds.run_check("correlation_check")
    assert pairs.data["pairs"] == [{"left": "feature_x", "right": "feature_y", "correlation": 1.0}]
    assert pairs.findings[0]["column"] == "feature_x, feature_y"
    assert ds.run_check("correlation_check", target="feature_y").data["pairs"] == []


def test_adversarial_table(spark):
    inf = math.inf
    rows = [(float(i), v, f"0{i}", ["a", "b"][i % 2], f'x,"{i}"\né', None) for i, v in enumerate([1.0, inf, -inf, 2.0, 3.0, 4.0, 5.0, 6.0])]
    rows.append(rows[0])
    df = spark.createDataFrame(rows, '`odd"name` double, x double, id string, label string, text string, empty double')
    ds = C.Dataset(df)
    assert ds.run_check("duplicate_rows_check").data["duplicate_count"] == 1
    outliers = {c["column"]: c["non_null_count"] for c in ds.run_check("outlier_check").data["columns"]}
    assert outliers == {'odd"name': 9, "x": 7}
    assert [c["column"] for c in ds.run_check("constant_columns_check").data["constant_columns"]] == ["empty"]
    assert ds.run_check("dataset_profile").data["unique_counts"]["x"] == 8
    r = {(p["left"], p["right"]): p["r"] for p in numeric.pearson_pairs(df).collect()}
    assert r[('odd"name', "empty")] is None and abs(r[('odd"name', "x")]) <= 1


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (1.0,), (1.0,)], "v double")
    assert C.run_check(df, "missing_values_check").data["affected_columns"][0]["missing_count"] == 2
    assert C.run_check(df, "duplicate_rows_check").data["duplicate_count"] == 2
    row = distinct.column_dominance(df).first()
    assert (row["unique_count_including_null"], row["dominant_count"]) == (2, 2)


def test_empty_table(spark):
    df = spark.createDataFrame([], "a long, b string")
    constant = C.run_check(df, "constant_columns_check")
    assert [c["dominant_ratio"] for c in constant.data["constant_columns"]] == [0.0, 0.0]
    assert C.run_check(df, "duplicate_rows_check").data == {"duplicate_count": 0, "duplicate_pct": 0.0}
    assert C.run_check(df, "missing_values_check").data["affected_columns"] == []
    assert C.run_check(df, "outlier_check").data["columns"] == []


def test_wide_guards_and_subset(spark):
    df = spark.createDataFrame([tuple(i * (k + 1) for k in range(51)) for i in range(6)], ", ".join(f"v{k} long" for k in range(51)))
    ds = C.Dataset(df, settings=Settings.interactive())
    for name in ("duplicate_rows_check", "outlier_check", "correlation_check"):
        seen = ds.run_check(name)
        assert seen.status == "skipped" and seen.execution["columns_checked"] == []
    pair = ds.run_check("correlation_check", columns=["v0", "v50"])
    assert len(pair.data["pairs"]) == 1 and pair.execution["columns_omitted"] == 49
    profile = ds.run_check("dataset_profile", "v50")
    assert profile.data["truncated"] and "v50" in profile.data["unique_counts"] and len(profile.data["dtypes"]) == 50
    with pytest.raises(ValueError):
        ds.run_check("correlation_check", columns=["v0", "v0"])
    with pytest.raises(ValueError):
        ds.run_check("nothing")


def test_wide_tables_are_checked_whole_by_default(spark):
    rows = [tuple(float((i * (k + 3) + k * k) % (5 + k)) if (i + k) % 9 else None for k in range(60)) for i in range(200)]
    df = spark.createDataFrame([*rows, rows[0]], ", ".join(f"v{k} double" for k in range(60)))
    ds = C.Dataset(df)
    assert ds.run_check("duplicate_rows_check").data["duplicate_count"] == 1
    assert len(ds.run_check("outlier_check").data["columns"]) == 60
    assert len(ds.run_check("dataset_profile").data["unique_counts"]) == 60
    want = df.toPandas().corr(min_periods=1)
    got = {(r["left"], r["right"]): r["r"] for r in numeric.pearson_pairs(df).collect()}
    assert len(got) == 60 * 59 // 2
    assert all(abs(got[a, b] - want.loc[a, b]) < 1e-9 for a, b in got)
    assert ds.run_check("correlation_check").status == "ok"
    trace = C.run_checks(ds, target="v0")
    assert [e["status"] for e in trace.events] == ["ok"] * len(C.V.CHECK_NAMES)


def test_many_classes(spark):
    df = spark.range(900).selectExpr("id % 300 AS k")
    seen = C.run_check(df, "class_imbalance_check", "k", Settings(max_listed_classes=100))
    assert seen.status == "ok" and seen.data["classes_omitted"] == 199
    assert classes.class_distribution(df, "k").count() == 300

def test_coverage_lists(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, "a")] * 4, "x double, y double, z double, label string")
    seen = C.run_check(df, "outlier_check", columns=["x"])
    assert seen.execution["coverage"]["columns_omitted"] == ["y", "z"]
    assert seen.execution["coverage"]["ignored_columns"] == ["label"]


def test_long_labels_never_appear(spark):
    label = "é" * 200
    df = spark.createDataFrame([(label,), ("b",)] * 5, "label string")
    seen = C.run_check(df, "class_imbalance_check", "label", Settings.interactive())
    assert seen.status == "skipped" and label not in json.dumps(seen.to_dict(), ensure_ascii=False)


def test_identifier_columns(spark):
    rows = [(20 + i, 1000.5 + i, 7000 + i, f"C{i}") for i in range(25)]
    df = spark.createDataFrame(rows, "level long, weight double, member_id long, batch_code string")
    seen = C.run_check(df, "high_cardinality_check")
    assert [c["column"] for c in seen.data["candidates"]] == ["member_id", "batch_code"]


def test_memo_is_isolated(spark):
    ds = C.Dataset(gaps_and_copies(spark))
    first = ds.run_check("missing_values_check")
    first.data["affected_columns"].clear()
    again = ds.run_check("missing_values_check")
    assert again.execution["cache_hit"] and len(again.data["affected_columns"]) == 2
    other = ds.run_check("missing_values_check", settings=Settings(missing_medium_pct=15))
    assert not other.execution["cache_hit"] and other.data["affected_columns"][1]["severity"] == "low"


def test_suite_budgets_and_errors(spark):
    ds = C.Dataset(gaps_and_copies(spark))

    if "broken_check" not in C._REGISTRY:
        @C.register_check("broken_check")
        def broken(request):
            raise RuntimeError("secret detail")

    trace = C.run_checks(ds, ["missing_values_check", "missing_values_check", "broken_check", "duplicate_rows_check"],
                         settings=Settings(max_tool_calls=2), reasons={"missing_values_check": "  why\u0007 not "})
    assert [e["status"] for e in trace.events] == ["ok", "skipped", "error", "skipped"]
    assert trace.events[2]["summary"] == "Diagnostic failed: RuntimeError"
    assert trace.events[0]["selection_reason"] == "why not"
    table = C.observations_table(spark, trace)
    assert table.count() == 4 and table.first()["findings"][0]["column"] == "depth"


def test_duplicate_plans_agree(spark):
    df = spark.range(500).selectExpr("id % 90 AS a", "CASE WHEN id % 3 = 0 THEN NULL ELSE id % 45 END AS b", "'t' || id % 90 AS c")
    direct = metrics.duplicate_rows(df).first()
    for limit in (1, 10_000):
        hashed = metrics.duplicate_rows(df, settings=Settings(duplicate_hash_min_rows=0, broadcast_max_rows=limit)).first()
        assert hashed == direct
    assert metrics.duplicate_rows(spark.range(50).toDF("id"), settings=Settings(duplicate_hash_min_rows=0)).first()["duplicate_count"] == 0


def test_hot_values_and_hashed_text(spark):
    df = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 7 = 0 THEN NULL ELSE 't' || id % 800 END AS t")
    plain = distinct.distinct_counts(df, ["t"]).first()
    assert distinct.distinct_counts(df, ["t"], hashed=["t"]).first() == plain
    rows = [r["t"] for r in df.collect()]
    assert plain["unique_count"] == len({r for r in rows if r is not None})
    assert plain["non_null_count"] == sum(r is not None for r in rows)


def test_near_constant_sketch_equals_full_counts(spark):
    df = spark.range(2000).selectExpr(
        "CASE WHEN id % 20 = 0 THEN id ELSE -1 END AS edge", "CASE WHEN id % 21 = 0 THEN id ELSE -1 END AS near",
        "CASE WHEN id % 10 = 0 THEN 'x' END AS nulls", "id AS key", "7 AS fixed", "CASE WHEN id % 50 = 0 THEN id END AS mostly")
    got = {r["column"]: (r["kind"], r["unique_count_including_null"]) for r in metrics.constant_columns(df).collect()}
    assert got == {"edge": ("near_constant", 101), "near": ("near_constant", 97), "fixed": ("constant", 1), "mostly": ("near_constant", 41)}


def test_class_order_without_order_columns(spark, tmp_path):
    path = str(tmp_path / "ties")
    spark.createDataFrame([("b",), ("a",), ("c",), ("a",), ("b",), ("c",)], "k string").coalesce(1).write.parquet(path)
    rows = classes.class_distribution(spark.read.parquet(path), "k").orderBy("position").collect()
    assert [r["class"] for r in rows] == ["b", "a", "c"]


@pytest.mark.parametrize("profile", synthetic.V.SYNTH_PROFILES)
def test_synthetic_truth(spark, profile):
    df = synthetic.synthetic_range(spark, 301, profile)
    truth = {(r["kind"], r["key"]): r["expected"] for r in synthetic.manifest(spark.range(301), "id", profile).collect()}
    assert truth[("duplicate_count", "rows")] == 3 and truth[("class", "positive")] == 27
    pdf = df.toPandas()
    assert len(pdf) == 301 and int(pdf.duplicated().sum()) == 3
    nulls = {c: int(n) for c, n in pdf.isna().sum().items() if n}
    assert nulls == {key: n for (kind, key), n in truth.items() if kind == "null_count" and n}
    if profile in ("tall_numeric", "high_unique_strings", "quoted_unicode"):
        assert nulls == {"nullable": 31}


def test_settings_validation():
    for bad in ({"missing_medium_pct": 40.0}, {"near_constant_ratio": 0.0}, {"max_tool_calls": -1},
                {"max_observation_bytes": 100}, {"max_local_compute_seconds": -1.0}):
        with pytest.raises(ValueError):
            Settings(**bad)
    assert Settings.from_env({"MISSING_HIGH_PCT": "50", "MAX_TOOL_CALLS": "3"}).max_tool_calls == 3


def test_preview_reads_the_first_files_in_order(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 400).repartitionByRange(20, "id").write.parquet(path)
    df = spark.read.parquet(path)
    files = sorted(df.inputFiles())
    first = [r["id"] for r in spark.read.parquet(files[0]).collect()]
    shown = C.preview_rows(df, 10)
    assert [int(r["id"]) for r in shown.collect()] == first[:10]
    assert C.preview_rows(df, 500).count() == C.V.FRAME_PREVIEW_ROWS
    few = spark.range(3).coalesce(1)
    few.write.parquet(str(tmp_path / "few"))
    assert C.preview_rows(spark.read.parquet(str(tmp_path / "few")), 10).count() == 3
