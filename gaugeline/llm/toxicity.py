"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

Features are the presence of hashed character n-grams.  One weight vector serves all
thresholds: P(grade > k) = logistic(w . x - threshold_k) with ascending thresholds, so
grades keep their order.  The model is fitted on at most ``SAMPLE`` labelled documents, the
ones with the smallest hash; of the features, the ``FEATURES`` whose counts deviate most
from what the grades' shares let expect get a weight.  Scoring reads every whole text once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.ngrams import buckets, folded

SIZES, BITS = (5,), 20
SAMPLE, FEATURES = 8_000, 2_048
STEPS, RATE, RIDGE = 300, 0.05, 1e-4


@dataclass(frozen=True)
class Model:
    """``weights`` by bucket (zero: unused) and ascending ``thresholds`` between grades."""

    weights: np.ndarray
    thresholds: np.ndarray


def features(text: str | None) -> np.ndarray:
    """Distinct hashed n-grams of a text, ascending."""
    found = list(buckets(folded(text or ""), SIZES, BITS))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint32)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [features(x.as_py()).astype(np.int32).tobytes() for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(packed, pa.binary())], names=["grade", "features"]
        )


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_arrays(rows: list[np.ndarray], grades: np.ndarray, n_grades: int) -> Model:
    """Fit by full-batch gradient steps with moments (Adam) on the mean log-likelihood."""
    size, n = 1 << BITS, len(rows)
    totals = np.bincount(grades, minlength=n_grades).astype(float)
    seen = np.stack([
        np.bincount(np.concatenate([r for r, g in zip(rows, grades, strict=True) if g == k] or [np.zeros(0, int)]), minlength=size)
        for k in range(n_grades)
    ])
    # deviation of a feature's count above each threshold; one row more in the variance keeps
    # features of few documents and rare grades from looking telling
    over = np.cumsum(seen[::-1], axis=0)[::-1][1:]
    expected = seen.sum(axis=0) * (np.cumsum(totals[::-1])[::-1][1:, None] / n)
    telling = (np.abs(over - expected) / np.sqrt(expected + 1)).max(axis=0)
    chosen = np.sort(np.argsort(-telling, kind="stable")[:FEATURES])
    place = np.full(size, -1, np.int64)
    place[chosen] = np.arange(len(chosen))
    columns = [place[r] for r in rows]
    columns = [c[c >= 0] for c in columns]
    owner = np.repeat(np.arange(n), [len(c) for c in columns])
    column = np.concatenate(columns)
    w = np.zeros(len(chosen))
    above = np.clip(1 - np.cumsum(totals)[:-1] / n, 1e-6, 1 - 1e-6)
    first = -np.log(above / (1 - above))  # thresholds that give the grades' shares
    gaps = np.log(np.maximum(np.diff(first), 1e-3))
    params = np.concatenate([w, first[:1], gaps])
    m, v = np.zeros_like(params), np.zeros_like(params)
    k = len(w)
    for step in range(1, STEPS + 1):
        cuts = params[k] + np.concatenate([[0], np.cumsum(np.exp(params[k + 1 :]))])
        eta = np.bincount(owner, weights=params[column], minlength=n)
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        with np.errstate(invalid="ignore"):
            upper = np.where(grades == n_grades - 1, 1.0, _logistic(edges[grades + 1] - eta))
            lower = np.where(grades == 0, 0.0, _logistic(edges[grades] - eta))
        p = np.maximum(upper - lower, 1e-12)
        d_eta = (upper + lower - 1) / n
        by_cut = np.bincount(grades, weights=upper * (1 - upper) / p, minlength=n_grades)[:-1]
        by_cut -= np.bincount(grades, weights=lower * (1 - lower) / p, minlength=n_grades)[1:]
        d_first, d_gaps = by_cut.sum() / n, np.cumsum(by_cut[::-1])[::-1][1:] / n * np.exp(params[k + 1 :])
        up = np.concatenate([
            np.bincount(column, weights=d_eta[owner], minlength=k) - RIDGE * params[:k], [d_first], d_gaps
        ])
        m, v = 0.9 * m + 0.1 * up, 0.999 * v + 0.001 * up * up
        params = params + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    weights = np.zeros(size, np.float32)
    weights[chosen] = params[:k]
    return Model(weights, params[k] + np.concatenate([[0], np.cumsum(np.exp(params[k + 1 :]))]))


def fit(examples: DataFrame, n_grades: int, sample: int = SAMPLE) -> Model:
    """Learn from (doc_id, text, grade) rows, at most ``sample`` of them.

    Rows without a grade in 0 .. n_grades - 1 are left out.  Without examples the model
    gives grade 0 to every text.
    """
    graded = examples.where(F.col("grade").between(0, n_grades - 1)).select(
        F.col("grade").cast("int"), F.col("text").cast("string"), F.xxhash64("doc_id", "grade").alias("h")
    )
    chosen = graded.orderBy("h", "text").limit(sample).select("grade", "text")
    table = chosen.repartition(16).mapInArrow(_extract, "grade int, features binary").toArrow()
    if not table.num_rows:
        return Model(np.zeros(1 << BITS, np.float32), np.full(n_grades - 1, 35.0))
    rows = [np.frombuffer(x, np.int32) for x in table["features"].to_pylist()]
    order = sorted(range(len(rows)), key=lambda i: (table["grade"][i].as_py(), rows[i].tobytes()))
    grades = table["grade"].to_numpy().astype(np.int64)[order]
    return fit_arrays([rows[i] for i in order], grades, n_grades)


def above(model: Model, text: str | None) -> np.ndarray:
    """P(grade > k) of one text for every threshold k."""
    eta = 0.0
    used = [h[model.weights[h] != 0] for h in buckets(folded(text or ""), SIZES, BITS)]
    if used:
        eta = float(model.weights[np.unique(np.concatenate(used))].sum(dtype=np.float64))
    return _logistic(eta - model.thresholds)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, grade, expected_severity, p_toxic, toxic) of every row of (doc_id, text).

    ``expected_severity`` is the mean grade, ``grade`` the most probable one (the smaller
    on ties), ``p_toxic`` the probability of a grade above 0 and ``toxic`` whether it is
    the likelier case.  Null and empty texts have no features, and thus the base rate of
    the examples.  Ids may be null or repeated; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            p = np.array([above(known, x.as_py()) for x in batch.column(1)]).reshape(batch.num_rows, -1)
            whole = np.column_stack([np.ones(len(p)), p, np.zeros(len(p))])
            grade = (whole[:, :-1] - whole[:, 1:]).argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(grade.astype(np.int32)), pa.array(p.sum(axis=1)),
                    pa.array(p[:, 0]), pa.array(p[:, 0] > 0.5),
                ],
                names=["doc_id", "grade", "expected_severity", "p_toxic", "toxic"],
            )

    return rows.mapInArrow(
        work, "doc_id bigint, grade int, expected_severity double, p_toxic double, toxic boolean"
    )


def severity() -> Column:
    """Grade of a labelled document: 0 not toxic, 1 toxic, 2 toxic and of low quality."""
    toxic, quality = F.col("toxic").cast("int"), F.col("quality").cast("int")
    return F.when(toxic == 0, 0).when((toxic == 1) & (quality == 0), 2).when(toxic == 1, 1)


def examples(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, grade) of at most ``sample`` labelled ids, those with the smallest hash.

    An id with several labels has its highest grade; null ids and labels give none.
    """
    graded = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(severity()).alias("grade"))
    chosen = graded.where("grade is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def grade_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(examples(docs, labels), n_grades=3))
