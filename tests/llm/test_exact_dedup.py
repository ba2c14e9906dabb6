"""Heavy texts and all others against grouping in Python; counters against exact counts."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gaugeline.llm import exact_dedup as ed


@settings(deadline=None)
@given(st.lists(st.lists(st.integers(0, 12), max_size=60), max_size=6), st.integers(1, 8))
def test_counters_lose_at_most_their_share(batches, keep):
    values, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        exact = Counter(batch) + Counter(dict(zip(values.tolist(), counts.tolist(), strict=True)))
        pairs = sorted(exact.items())
        values, counts = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
        values, counts = ed.reduce_counters(values, counts, keep)
        assert len(values) <= keep
    true, left = Counter(x for b in batches for x in b), dict(zip(values.tolist(), counts.tolist(), strict=True))
    lost = sum(map(len, batches)) / (keep + 1)
    assert all(n - lost <= left.get(v, 0) <= n for v, n in true.items())


def expected(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        sha = hashlib.sha256(text.encode()).hexdigest()
        first = True
        for i in sorted(ids, key=lambda x: (x != keep, x is None, x or 0)):
            out.append((i, keep, len(ids), first, sha))
            first = False
    return out


ROWS = [
    (1, "a"), (2, "a"), (2, "a"), (9, None), (8, ""), (None, "b"), (None, "b"), (None, "c"), (3, "c"), (4, "A"), (5, "a "),
    (6, "é"), (7, "é"), (20, "long " * 200_000), (21, "long " * 200_000), (22, "long " * 199_999),
] + [(100 + i, "hot") for i in range(60)] + [(200 + i, f"x{i % 40}") for i in range(70)]


@pytest.mark.parametrize("frequent", [2, 8, 4096])
def test_odd_rows(spark, frequent):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string").repartition(5)
    docs = docs.selectExpr("*", "1 AS digest", "2 AS place", "3 AS keep", "4 AS h")
    got = ed.mark_copies(docs, frequent, 2 * frequent).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, expected(ROWS)))
    assert ed.mark_copies(docs.where("false")).collect() == []


def test_frequent_texts_only_are_split_off(spark):
    rows = spark.createDataFrame(ROWS, "doc_id bigint, text string").selectExpr(
        "doc_id", "unhex(sha2(coalesce(text, ''), 256)) AS digest", "monotonically_increasing_id() AS place"
    )
    heavy = ed.frequent_digests(rows, 4, 8).collect()
    assert [(bytes(r.digest), r.group_size, r.keep.doc_id) for r in heavy] == [(hashlib.sha256(b"hot").digest(), 60, 159)]


def test_rows_that_stay(spark):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string").selectExpr("*", "uuid() AS __same", "1 AS lang")
    kept = ed.deduplicate(docs)
    assert kept.columns == docs.columns
    want = sorted(str((i, t)) for i, t in {(r[0], r[4]) for r in expected(ROWS) if r[3]})
    got = [(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in kept.collect()]
    assert sorted(map(str, got)) == want


def test_hot_text_is_not_shuffled(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'hot', 'text ' || id) AS text")
    got = ed.mark_copies(docs)
    assert got.where("kept").count() == 4000 - 1334 + 1
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.count("Exchange hashpartitioning(digest") == 1
