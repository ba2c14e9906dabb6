"""Ordinal regression: held-out ranking, order of thresholds, odd rows."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline.llm import toxicity as tox


@pytest.mark.parametrize(("size", "right", "ranked", "caught", "alarms"), [
    ("check_s", 0.985, 0.99, 0.95, 0.005),
    # a sixth of the labels to learn from; measured 0.956 right, 0.62 of the toxic ones, 0.006 alarms
    ("sf0.1", 0.94, 0.95, 0.55, 0.01),
])
def test_held_out_documents(spark, size, right, ranked, caught, alarms):
    if not os.path.exists(f"/root/testdata/{size}"):
        pytest.skip("not on this machine")
    docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet")
    labels = spark.read.parquet(f"/root/testdata/{size}/labels.parquet")
    apart = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = tox.fit(tox.examples(docs, labels.where(~apart)), 3)
    assert (np.diff(model.thresholds) > 0).all()
    judged = labels.where(apart).select("doc_id", F.col("toxic").alias("label"))
    got = tox.score(docs, model).join(judged, "doc_id").select("expected_severity", "toxic", "label")
    rows = got.collect()
    assert len(rows) > 500 and np.mean([r[1] == (r.label == 1) for r in rows]) > right
    bad = [r[0] for r in rows if r.label == 1]
    good = [r[0] for r in rows if r.label == 0]
    assert np.mean([(b > np.array(good)).mean() for b in bad]) > ranked
    assert np.mean([r[1] for r in rows if r.label == 1]) > caught
    assert np.mean([r[1] for r in rows if r.label == 0]) < alarms


def test_gradient_reaches_separated_grades():
    rng = np.random.default_rng(5)
    grades = rng.integers(0, 4, 600)
    rows = [np.unique(np.concatenate([rng.integers(100, 400, 10), np.zeros(0, int), [g] * int(g > 0), [50] * int(g > 1)]).astype(int)) for g in grades]
    model = tox.fit_arrays(rows, grades, 4)
    eta = np.array([model.weights[r].sum() for r in rows])
    predicted = (eta[:, None] > model.thresholds).sum(axis=1)
    assert (np.diff(model.thresholds) > 0).all() and (predicted == grades).mean() > 0.85


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None), (2, ""), (3, "you utter idiot"), (3, "you utter idiot"), (None, "a kind word")],
        "doc_id bigint, text string",
    ).selectExpr("*", "1 AS grade", "2 AS toxic", "3 AS quality")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (3, 0, 1), (3, 1, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    assert sorted((r.doc_id, r.grade) for r in tox.examples(docs, labels).collect()) == [(1, 0), (3, 2), (3, 2)]
    got = tox.grade_documents(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r.expected_severity <= 2 for r in got)
    assert [r.toxic for r in tox.grade_documents(docs, labels.where("false")).collect()] == [False] * 5
    assert tox.grade_documents(docs.where("false"), labels).collect() == []


def test_fit_reaches_the_optimum_of_a_plain_search():
    """Cumulative-link likelihood less the ridge, climbed by trying steps of every parameter."""
    rng = np.random.default_rng(11)
    grades = rng.integers(0, 3, 300)
    rows = [np.unique([f for f in range(6) if rng.random() < 0.15 + 0.2 * (g > 0) * (f == 1) + 0.3 * (g > 1) * (f == 2)]).astype(int) for g in grades]
    model = tox.fit_arrays(rows, grades, 3)

    def value(params):
        w, first, gap = params[:6], params[6], np.exp(params[7])
        eta = np.array([w[r].sum() for r in rows])
        below = 1 / (1 + np.exp(-(np.array([first, first + gap])[None, :] - eta[:, None])))
        whole = np.column_stack([np.zeros(len(eta)), below, np.ones(len(eta))])
        p = whole[np.arange(len(eta)), grades + 1] - whole[np.arange(len(eta)), grades]
        return np.log(np.maximum(p, 1e-12)).mean() - tox.RIDGE / 2 * (w**2).sum()

    best, step = np.zeros(8), 1.0
    while step > 1e-4:
        moved = False
        for i in range(8):
            for change in (step, -step):
                other = best.copy()
                other[i] += change
                if value(other) > value(best):
                    best, moved = other, True
        step = step if moved else step / 2
    got = np.concatenate([model.weights[:6], model.thresholds[:1], np.log(np.diff(model.thresholds))])
    assert value(got) > value(best) - 1e-3
    assert np.abs(got - best).max() < 0.15
