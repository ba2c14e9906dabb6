"""Neighbours against brute force: exact scores, order, and recall."""

import numpy as np
import pytest

from gaugeline.llm import ann


def brute(ids, x, k=20):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = (x[i] * x).sum(axis=1)
        order = [j for j in np.lexsort((ids, -s)) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_recall_and_scores(spark, size):
    table = spark.read.parquet(f"/root/testdata/{size}/embeddings.parquet")
    got = {}
    for r in ann.search(table).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    rows = table.select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    want = brute(ids, x)
    assert set(got) == set(want)
    place = {int(v): i for i, v in enumerate(ids)}
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and len({f[1] for f in found}) == 20
        assert [f[1:] for f in found] == sorted((f[1:] for f in found), key=lambda f: (-f[1], f[0]))
        for _, v, s in found:
            assert abs(s - float((x[place[q]] * x[place[v]]).sum())) < 1e-12
        hits += len({f[1] for f in found} & {w[0] for w in want[q]})
    assert hits / (20 * len(want)) >= 0.9


def test_scan_keeps_the_best():
    rng = np.random.default_rng(3)
    x, q = rng.standard_normal((3000, 48)), rng.standard_normal((40, 48))
    rotation = np.linalg.qr(rng.standard_normal((48, 48)))[0]
    ids = rng.permutation(3000)
    found = ann.scan(q, np.arange(40), x, ids, rotation, 20)
    s = np.where(np.arange(40)[:, None] == ids[None, :], -np.inf, q @ x.T)
    hits = sum(len(set(f[0]) & set(ids[np.argsort(-s[i])[:20]])) for i, f in enumerate(found))
    assert hits >= 0.99 * 800


@pytest.mark.parametrize("dims", [8, 64, 384, 768])
@pytest.mark.parametrize("cosine", [0.3, 0.6, 0.9, 0.999, 1.0])
def test_scan_is_exact_in_tight_clusters(dims, cosine):
    rng = np.random.default_rng(dims)
    common = rng.standard_normal(dims)
    common /= np.linalg.norm(common)
    own = rng.standard_normal((1000, dims))
    own /= np.linalg.norm(own, axis=1, keepdims=True)
    x = (cosine**0.5 * common + (1 - cosine) ** 0.5 * own) * 1000
    ids = rng.permutation(1000)
    rotation = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
    found = ann.scan(x[:30], ids[:30], x, ids, rotation, 20)
    for i, (got, scores) in enumerate(found):
        s = np.where(ids == ids[i], -np.inf, (x[i] * x).sum(axis=1))
        want = np.lexsort((ids, -s))[:20]
        assert got.tolist() == ids[want].tolist() and scores.tolist() == s[want].tolist()


def test_scan_of_equal_vectors_takes_the_smaller_ids():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((2000, 64))
    x[100:2000:3] = x[100]
    rotation = np.linalg.qr(rng.standard_normal((64, 64)))[0]
    ((ids, scores),) = ann.scan(x[1999:], np.array([1999]), x, np.arange(2000), rotation, 20)
    s = (x[1999] * x).sum(axis=1)
    s[1999] = -np.inf
    assert ids.tolist() == np.lexsort((np.arange(2000), -s))[:20].tolist() and len(scores) == 20
    ((ids, _),) = ann.scan(x[100:101], np.array([100]), x, np.arange(2000), rotation, 20)
    assert ids.tolist() == list(range(103, 163, 3))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (20, [0.0, 2.0]), (20, [0.0, 2.0]), (3, [0.0, 0.0]),
        (4, [nan, 1.0]), (5, [inf, 1.0]), (6, None), (7, [None, 1.0]), (None, [1.0, 1.0]), (8, [1.0]), (9, []),
        (40, [0.0, 0.0]),
    ]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 AS id", "2 AS v", "3 AS list")
    got = sorted(tuple(r) for r in ann.search(table).collect())
    assert got == [
        (0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 2, 0.0),
    ]
    assert ann.search(table.where("false")).collect() == []


def test_every_query_gets_its_number_of_rows(spark):
    rng = np.random.default_rng(9)
    centers = np.linalg.qr(rng.standard_normal((32, 32)))[0][:12]
    of = np.concatenate([np.repeat(np.arange(10), 150), np.full(8, 10), np.full(3, 11)])
    x = centers[of] + 0.01 * rng.standard_normal((len(of), 32))
    x[:500] = x[0]  # a third of the rows are equal
    ids = rng.permutation(len(of)) * 5
    table = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id bigint, embedding array<double>")
    found, want = {}, brute(ids, x)
    for r in ann.search(table).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    small = set(ids[of >= 10].tolist()) & set(want)
    assert small and set(found) == set(want) and all(sorted(f) == list(range(1, 21)) for f in found.values())
    for q in small:  # its own cluster first
        near = set(ids[of == of[np.flatnonzero(ids == q)[0]]].tolist()) - {q}
        assert {found[q][i + 1] for i in range(len(near))} == near
    few = table.orderBy("vec_id").limit(9)
    assert {r.query_id: r["count"] for r in ann.search(few).groupBy("query_id").count().collect()} == {0: 8, 20: 8, 40: 8}


def test_centres_are_different_and_have_vectors():
    x = np.random.default_rng(2).standard_normal((900, 16))
    x[:600] = x[0]
    found = ann._kmeans(x, 30, np.random.default_rng(7))
    assert len(np.unique(found, axis=0)) == len(found) == len(np.unique(ann._lists(x, found)))
    assert len(ann._kmeans(np.ones((50, 3)), 5, np.random.default_rng(7))) == 1
