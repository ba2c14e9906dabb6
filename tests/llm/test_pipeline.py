"""The pipeline against brute-force versions of its stages."""

from collections import Counter

import numpy as np
import public_tokenizers
import test_decontaminate
import test_minhash
from tokenizers import Tokenizer

import corpus_pipeline as cp
from gaugeline.llm import mixing
from gaugeline.sources.files import materialized

DIRECTORY = "/root/testdata/sf0.01"


def brute_kept(rows, width):
    sets = {i: test_minhash.shingle_set(t, width) for i, t in rows}
    ids, parent = sorted(sets), {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if min(len(a), len(b)) * 5 >= max(len(a), len(b)) * 4 and root(i) != root(j):
                c = len(a & b)
                if c and 100 * c >= 80 * (len(a) + len(b) - c):
                    x, y = sorted((root(i), root(j)))
                    parent[y] = x
    return {i for i in ids if root(i) == i}


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{DIRECTORY}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in cp.STAGES:
        before, docs = docs, materialized(stage(spark, docs, DIRECTORY), name)
        seen[name] = (before, docs)
        assert docs.columns == columns or name == "token_ids"

    def ids(frame):
        return [r.doc_id for r in frame.select("doc_id").collect()]

    before, after = seen["language_id"]
    letterless = {r.doc_id for r in before.collect() if not any(c.isalpha() for c in r.text or "")}
    assert letterless.isdisjoint(ids(after)) and len(ids(after)) >= 0.99 * len(ids(before))
    before, after = seen["near_dedup"]
    assert set(ids(after)) == brute_kept([(r.doc_id, r.text) for r in before.collect()], 5)
    before, after = seen["decontamination"]
    items = spark.read.parquet(f"{DIRECTORY}/benchmark.parquet").select("item_id", "text").collect()
    found = test_decontaminate.brute([(r.doc_id, r.text) for r in before.collect()], items)
    assert found and set(ids(after)) == set(ids(before)) - {d for d, _ in found}
    before, after = seen["source_mixing"]
    sizes = {r.doc_id: r for r in mixing.mixed_sizes(before).collect()}
    times = Counter(ids(after))
    assert all(times[d] == int(r.taken / r["size"] + 0.5) for d, r in sizes.items() if r["size"])
    words = Counter()
    for r in after.collect():
        words[r.source] += sizes[r.doc_id]["size"]
    longest = max(r["size"] for r in sizes.values())
    targets = {r.source: r.target for r in sizes.values()}
    assert all(abs(words[s] - t) <= longest + 0.02 * t for s, t in targets.items())
    before, after = seen["token_ids"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter((r.doc_id, len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in before.collect())
    rows = sorted(after.collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, r.n_tokens) for r in rows) == want
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1]]


def test_run_on_rows_with_gaps(spark, tmp_path):
    rows = [(1, None, None, None, 0), (2, "", "en", "a", 0), (None, "some words of a text here", None, "b", 3)] * 2
    rows += [(i, f"text number {i} has its own words {i * 7} and more of {i % 5} them", "en", None, 9) for i in range(10, 30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs = docs.selectExpr("*", "1 AS key", "2 AS sid", "3 AS bands", "4 AS score", "5 AS component_id", "6 AS size")
    path = str(tmp_path)
    docs.write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{DIRECTORY}/benchmark.parquet").write.parquet(f"{path}/benchmark.parquet")
    assert cp.run(spark, path).count() > 0
    docs.where("false").write.mode("overwrite").parquet(f"{path}/documents.parquet")
    assert cp.run(spark, path).collect() == []
