import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from gaugeline.operators import numeric
from gaugeline.operators.quantiles import exact_quantiles, quantile_values
from gaugeline.settings import Settings
from gaugeline.sources import files

TIGHT = Settings(quantile_accuracy=20, quantile_finish_rows=5)


def check(spark, columns, active):
    names = list(columns)
    rows = list(zip(*columns.values()))
    df = spark.createDataFrame([tuple(None if v is None else float(v) for v in r) for r in rows], ", ".join(f"{n} double" for n in names))
    for name, n, found in quantile_values(df, names, (0.25, 0.5, 0.75), active):
        kept = [v for v in columns[name] if v is not None and math.isfinite(v)]
        assert n == len(kept)
        if kept:
            assert found == pytest.approx(list(np.quantile(np.array(kept, float), [0.25, 0.5, 0.75])), rel=1e-12, abs=1e-12)
        else:
            assert found == [None] * 3


@pytest.mark.parametrize("active", [Settings(), TIGHT])
def test_hard_shapes(spark, active):
    rnd = random.Random(3)
    n = 700
    columns = {
        "spread": [rnd.gauss(0, 1e6) for _ in range(n)],
        "hot": [5.0 if i % 3 else rnd.random() for i in range(n)],
        "two": [float(i % 2) for i in range(n)],
        "same": [1.25] * n,
        "gaps": [None if i % 2 else float(i * 37 % 101) for i in range(n)],
        "infinite": [math.inf if i % 5 == 0 else (-math.inf if i % 7 == 0 else i / 3) for i in range(n)],
        "nothing": [None] * n,
        "few": [float(i) if i < 3 else None for i in range(n)],
        "heavy_tail": [10.0 ** (i % 300) * (-1) ** i for i in range(n)],
    }
    check(spark, columns, active)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5).map(float), st.floats(-1e9, 1e9)), min_size=1, max_size=120))
def test_any_column(spark, values):
    check(spark, {"v": values}, TIGHT)


def test_small_tables(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,)], "v double")
    assert numeric.outliers(df).collect() == []
    got = {r["prob"]: r["quantile"] for r in exact_quantiles(df, ["v"]).collect()}
    assert got == {0.25: 1.25, 0.75: 1.75}


def test_correlation_matches_numpy(spark):
    rnd = np.random.default_rng(5)
    n = 400
    a = rnd.normal(1e9, 1.0, n)
    data = {
        "a": a, "b": 3 * a + rnd.normal(0, 2, n), "c": rnd.normal(size=n), "d": np.full(n, 7.1),
        "e": np.where(np.arange(n) % 3 == 0, np.nan, a), "f": np.where(np.arange(n) % 4 == 0, np.inf, rnd.normal(size=n)),
        "g": np.where(np.arange(n) % 3 == 0, 1.0, np.where(np.arange(n) % 2 == 0, 2.0, 5.0)),
    }
    names = list(data)
    df = spark.createDataFrame([tuple(float(data[k][i]) for k in names) for i in range(n)], ", ".join(f"{k} double" for k in names))
    for row in numeric.pearson_pairs(df).collect():
        x, y = data[row["left"]], data[row["right"]]
        ok = np.isfinite(x) & np.isfinite(y)
        x, y = x[ok], y[ok]
        if x.min() == x.max() or y.min() == y.max():
            assert row["r"] is None
        else:
            assert row["r"] == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-6)


@pytest.mark.parametrize("task_columns", [1024, 20])
def test_wide_correlation_in_blocks(spark, monkeypatch, task_columns):
    monkeypatch.setattr(numeric, "BLOCK_COLUMNS", 7)
    monkeypatch.setattr(numeric, "FAN_IN", 2)
    monkeypatch.setattr(numeric, "TASK_COLUMNS", task_columns)
    rnd = np.random.default_rng(9)
    n, p = 240, 31
    data = rnd.normal(size=(n, p))
    data[:, 1] = 3.3
    data[:, 2] = data[:, 0] * 2 + 1e9
    data[rnd.random((n, p)) < 0.2] = np.nan
    data[:, 3], data[:, 4] = np.nan, np.where(np.arange(n) % 2 == 0, 1.0, np.nan)
    data[:, 5] = np.where(np.arange(n) % 2 == 0, np.nan, rnd.normal(size=n))
    names = [f"c{i}" for i in range(p)]
    rows = [tuple(None if math.isnan(v) else float(v) for v in r) for r in data]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(5)
    got = numeric.pearson_pairs(df).orderBy("position").collect()
    pairs = [(i, j) for i in range(p) for j in range(i + 1, p)]
    assert [(r["position"], r["left"], r["right"]) for r in got] == [(k, names[i], names[j]) for k, (i, j) in enumerate(pairs)]
    for row, (i, j) in zip(got, pairs):
        ok = ~np.isnan(data[:, i]) & ~np.isnan(data[:, j])
        x, y = data[ok, i], data[ok, j]
        if len(x) < 2 or x.min() == x.max() or y.min() == y.max():
            assert row["r"] is None
        else:
            assert row["r"] == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-6)


def test_wide_correlation_scans_once_and_in_short_methods(spark, monkeypatch):
    n, p = 600, 26
    rnd = np.random.default_rng(3)
    data = rnd.normal(size=(n, p)) + np.where(np.arange(n) < 300, 0.0, 1e6)[:, None]
    data[:, 0] = np.arange(n) // 100  # the same in each part
    data[:, 1], data[::3, 2], data[::7, 3], data[::5, 4] = 4.5, np.nan, np.inf, np.nan
    data[:, 5] = np.where(np.isnan(data[:, 4]), 1.0, 2.0)  # varies only where column 4 has gaps
    seen, limits, key = spark.sparkContext.accumulator(0), [], "spark.sql.codegen.hugeMethodLimit"

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    def written(df, label):
        limits.append(spark.conf.get(key))
        return files.materialized(df, label)

    names = [f"c{i}" for i in range(p)]
    rows = [tuple(float(v) for v in r) for r in data]
    schema = ", ".join(f"{c} double" for c in names)
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 6), schema).mapInArrow(counted, schema)
    monkeypatch.setattr(numeric, "materialized", written)
    before = spark.conf.get(key)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "30")
    try:
        got = {(r["left"], r["right"]): r["r"] for r in numeric.pearson_pairs(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert seen.value == n and limits == ["8000"] and spark.conf.get(key) == before
    assert got["c4", "c5"] is None and got["c0", "c1"] is None and len(got) == p * (p - 1) // 2
    for (a, b), r in got.items():
        x, y = data[:, int(a[1:])], data[:, int(b[1:])]
        ok = np.isfinite(x) & np.isfinite(y)
        if np.ptp(x[ok]) and np.ptp(y[ok]):
            assert r == pytest.approx(np.corrcoef(x[ok], y[ok])[0, 1], abs=1e-9)
        else:
            assert r is None


def test_outliers_come_from_the_scans_of_the_quartiles(spark):
    rnd = np.random.default_rng(4)
    columns = {
        "gauss": rnd.normal(size=5000), "tail": rnd.standard_t(1.5, size=5000), "int": rnd.integers(0, 50, 5000).astype(float),
        "same": np.full(5000, 2.0), "odd": np.where(rnd.random(5000) < 0.98, 1.0, rnd.normal(size=5000)),
    }
    df = spark.createDataFrame([tuple(float(v) for v in r) for r in zip(*columns.values())], ", ".join(f"{c} double" for c in columns))
    for active in (Settings(), TIGHT):
        for row in numeric.outliers(df, settings=active).collect():
            x = columns[row["column"]]
            q1, q3 = np.quantile(x, [0.25, 0.75])
            bad = int(((x < q1 - 1.5 * (q3 - q1)) | (x > q3 + 1.5 * (q3 - q1))).sum())
            assert (row["column"], row["outlier_count"]) == (row["column"], bad)
