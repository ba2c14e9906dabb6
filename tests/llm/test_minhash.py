"""Near duplicates against brute force over full shingle sets."""

from collections import defaultdict

import numpy as np
import pytest

from gaugeline.llm import minhash


def words(text):
    return (text or "").encode().lower().split()


def shingle_set(text, width=4):
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows):
    """(doc_id, n_shingles, component, kept) by comparing every pair that shares a shingle."""
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders, common = defaultdict(list), defaultdict(int)
    for i in sorted(sets):
        for s in sets[i]:
            for j in holders[s]:
                common[j, i] += 1
            holders[s].append(i)
    for (i, j), c in common.items():
        if 100 * c >= 80 * (len(sets[i]) + len(sets[j]) - c):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return {(i, len(sets[i]), root(i), root(i) == i) for i in sets}


def test_documents_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {tuple(r) for r in minhash.near_duplicates(docs).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_chains_ties_and_empty_texts(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "two three")]
    for k in range(12):  # each differs from the next in few words, the ends in many
        rows.append((20 + k, " ".join(["x"] * 3 * k + base[3 * k :] + [f"y{i}" for i in range(3 * k)])))
    rows += [(100 + k, " ".join(f"{(i * 7 + k) % 50}z" for i in range(40))) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {tuple(r) for r in minhash.near_duplicates(docs).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("limit", [0, 400_000])
def test_large_group_with_stragglers(spark, monkeypatch, limit):
    import random

    monkeypatch.setattr(minhash, "BROADCAST_IDS", limit)
    pick = random.Random(4)
    base = [f"b{i}" for i in range(50)]
    rows = []
    for i in range(400):
        text = list(base)
        for _ in range(pick.choice((0, 1, 2, 3, 5))):
            text[pick.randrange(50)] = f"n{pick.randrange(30)}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {tuple(r) for r in minhash.near_duplicates(docs).collect()} == brute(rows)


def test_null_ids_repeated_rows_and_other_columns(spark):
    rows = [(None, "a b c d e", 1), (7, "a b c d e", 2), (7, "a b c d e", 2), (9, "f g h i", 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n bigint")
    docs = docs.withColumn("k1", docs.n).withColumn("bands", docs.n).withColumn("component_id", docs.n)
    got = sorted(map(tuple, minhash.near_duplicates(docs).collect()), key=str)
    assert got == [(7, 2, 7, True), (7, 2, 7, True), (9, 1, 9, True), (None, 2, None, True)]
    kept = minhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["7", "9", "None"]
    empty = docs.where("false")
    assert minhash.near_duplicates(empty).collect() == [] and minhash.keep_one_of_each(empty).count() == 0


@pytest.mark.parametrize("links", [[], [(1, 2)], [(5, 4), (4, 3), (3, 2), (9, 8), (8, 2), (7, 6)]])
def test_components(spark, links):
    found = minhash.components(spark.createDataFrame(links, "a bigint, b bigint"))
    want = {2: 1} if len(links) == 1 else {5: 2, 4: 2, 3: 2, 9: 2, 8: 2, 7: 6} if links else {}
    assert {r.id: r.component for r in found.collect()} == want


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(300):
        base = rng.integers(0, 2**63, rng.integers(0, 900), dtype=np.uint64)
        a = np.unique(np.concatenate([base, rng.integers(0, 2**63, rng.integers(0, 60), dtype=np.uint64)]))
        b = np.unique(np.concatenate([base, rng.integers(0, 2**63, rng.integers(0, 60), dtype=np.uint64)]))
        odd = int(np.bitwise_count((minhash.parities(a) ^ minhash.parities(b)).view(np.uint64)).sum())
        assert odd <= len(np.setxor1d(a, b)) and odd % 2 == len(np.setxor1d(a, b)) % 2
