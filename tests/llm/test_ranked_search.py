"""Buckets, blocks and thresholds against scoring every document."""

import math
import random
import re
from collections import Counter

import pytest

from gaugeline.llm import ranked_search as rs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def expected(docs, items, top=10):
    cut = [(d, terms(t)) for d, t in docs]
    cut = [(d, c, Counter(c)) for d, c in cut if c]
    n_docs, words = len(cut), sum(len(c) for _, c, _ in cut)
    df = Counter(t for *_, c in cut for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, all_terms, tf in cut:
            m = 100 - 75 + ((75 * len(all_terms) * n_docs) // words)
            score = 0
            for t in terms(text):
                if t in tf:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scored)[:top])]
    return sorted(map(str, out))


def test_terms():
    for text in ("Don't STOP, É9é x_y \x85   ×ÀZ", "", None, "ẞ İ\tA1"):
        assert [t.decode() for t in rs.terms_of(text)] == terms(text)


@pytest.mark.parametrize(("postings", "head", "characters"), [(1 << 18, 4096, 10**6), (200, 3, 9_500)])
def test_all_sizes_of_buckets_and_blocks(spark, postings, head, characters):
    chance = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["É", "ß", "the", "a"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(chance.choices(words, weights, k=chance.choice([1, 5, 30, 200])))) for i in range(300)]
    docs += [(1000 + i, "w1 W2, w3! the") for i in range(40)]  # ties
    docs += [(7, docs[7][1]), (None, "w1 w2 w3"), (None, None), (2000, ""), (2001, " ,"), (2002, "w1 w3 " * 40_000)]
    items = [(i, " ".join(chance.choices(words, weights, k=12))) for i in range(8)]
    items += [(3, "w1 w2"), (3, "w1 w2"), (None, "the w59"), (50, None), (51, ""), (52, "absent"), (53, "w1 " * 9000)]
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3).selectExpr("*", "1 AS item", "2 AS n", "3 AS terms")
    asked = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 AS item", "2 AS rank", "3 AS doc_id", "4 AS key")
    got = rs.search(table, asked, 10, characters, postings, head)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(str(tuple(r)) for r in got.collect()) == expected(docs, items)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert rs.search(docs.where("false"), items).collect() == []
    assert rs.search(docs, items.where("false")).collect() == []
    assert [tuple(r)[:3] for r in rs.search(docs, items).collect()] == [(1, 1, 1)]


def test_bounds_leave_most_documents_out(spark):
    """Inside a bucket only few documents are scored in full."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    calls = []
    original = rs.Bucket.scores

    def counted(self, wanted, terms_, weighted):
        calls.append((len(wanted), len(self.docs)))
        return original(self, wanted, terms_, weighted)

    import numpy as np

    block = rs.Items.of([(r.item_id, r.text) for r in items.collect()])
    cut = [(d, rs.terms_of(t)) for d, t in rows]
    weight = np.zeros(len(block.vocabulary), np.int64)
    df = Counter(block.vocabulary[t] for _, c in cut for t in set(c) if t in block.vocabulary)
    for term, n in df.items():
        weight[term] = math.floor(1000 * math.log((2 * len(cut) + 2) / (2 * n + 1)))
    weights = rs.Weights(weight, len(cut), sum(len(c) for _, c in cut))
    row, terms_, impacts, lengths = [], [], [], []
    for k, (_, c) in enumerate(cut):
        tf = Counter(block.vocabulary[t] for t in c if t in block.vocabulary)
        numbers = np.array(list(tf), np.int64)
        found = weights.impacts(np.full(len(tf), len(c)), np.array(list(tf.values()), np.int64))
        row += [k] * len(tf)
        terms_ += numbers.tolist()
        impacts += found.tolist()
        lengths.append(math.sqrt(float((weight[numbers] * found.astype(float) ** 2).sum())) if len(tf) else 0.0)
    bucket = rs.Bucket(np.arange(len(cut)), [d for d, _ in cut], *map(np.array, (lengths, row, terms_, impacts)), weight)
    rs.Bucket.scores = counted
    try:
        for numbers, counts in zip(block.terms, block.counts, strict=True):
            weighted = weight[numbers] * counts
            length = math.sqrt(float((weighted * counts).sum()))
            every, scores = bucket.search(numbers, weighted, length, 1)
            tenth = int(np.sort(scores)[-10])
            again, _ = bucket.search(numbers, weighted, length, tenth)
            assert set(again.tolist()) == set(every[scores >= tenth].tolist())
            assert not len(bucket.search(numbers, weighted, length, int(length * bucket.longest * 1.01))[0])
    finally:
        rs.Bucket.scores = original
    assert sum(n for n, _ in calls) < 0.5 * len(cut) * len(block.keys)
