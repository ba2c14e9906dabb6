"""Language ID, licences, mixing and chat on hand-made rows; held-out accuracy."""

import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gaugeline.llm import chat, langid, licenses, mixing

DOCS = "doc_id bigint, text string, lang string, source string"


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    rows = found.select("lang", "lang_pred", "score").collect()
    assert len(rows) > 1500 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(spark):
    rows = [(i, t, lang, None) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 20)]
    odd = [(100, None, "en", None), (101, "", None, None), (102, "123 !? ___", "de", None), (None, "the dog", None, None), (3, "the dog", "en", None), (3, "the dog", "en", None)]
    docs = spark.createDataFrame(rows + odd, DOCS).selectExpr("*", "1 AS score", "2 AS lang_pred", "3 AS __text")
    got = langid.identify(docs).collect()
    assert len(got) == len(rows) + len(odd)
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert und == {100, 101, 102} and all(r.score == 0 for r in got if r.lang_pred == "und")
    assert [r.held_out for r in got if r.doc_id is None] == [True]
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) + 3
    assert langid.identify(docs.where("false")).collect() == [] and langid.keep_identified(docs.where("false")).count() == 0
    nobody = langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in nobody} == {"und"}
    many = spark.range(90).selectExpr("id AS doc_id", "repeat(char(97 + cast(id % 26 AS int)), 3 + cast(id / 26 AS int)) AS text", "'l' || id AS lang")
    model = langid.fit(many)
    assert len(model.languages) == 90 and model.bits == 14 and model.weights.size <= langid.CELLS
    assert langid.posterior(model, "zzz")[0] in {"l25", "l51", "l77"}
    with pytest.raises(ValueError, match="languages"):
        langid.fit(many, max_languages=89)


def bayes(examples, texts, smoothing=0.5):
    """Multinomial naive Bayes with dictionaries of hashed n-grams."""
    def grams(text):
        found = Counter()
        for h in langid.buckets(langid.folded(text or ""), langid.SIZES, langid.BITS):
            found.update(h.tolist())
        return found

    counts, docs = {}, Counter()
    for text, lang in examples:
        counts.setdefault(lang, Counter()).update(grams(text))
        docs[lang] += 1
    out = []
    for text in texts:
        found = grams(text)
        if not any(c.isalpha() for c in text or ""):
            out.append(("und", 0.0))
            continue
        logs = {}
        for lang in sorted(counts):
            whole = sum(counts[lang].values()) + smoothing * 2**langid.BITS
            logs[lang] = math.log((docs[lang] + 1) / (sum(docs.values()) + len(docs)))
            logs[lang] += sum(n * math.log((counts[lang][g] + smoothing) / whole) for g, n in found.items())
        best = max(logs, key=lambda k: logs[k])
        out.append((best, 1 / sum(math.exp(v - logs[best]) for v in logs.values())))
    return out


def test_every_score_equals_naive_bayes_by_dictionaries(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.unionAll(spark.createDataFrame([(-1, None, "en"), (-2, "", None), (-3, "§§ 12", "de"), (-4, "le chat", None)], docs.schema))
    rows = docs.withColumn("held", langid.held_out()).collect()
    want = bayes([(r.text, r.lang) for r in rows if not r.held and r.lang is not None], [r.text for r in rows])
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs).collect()}
    assert len(got) == len(rows)
    for r, (lang, score) in zip(rows, want, strict=True):
        assert got[r.doc_id][0] == lang and math.isclose(got[r.doc_id][1], score, rel_tol=1e-3, abs_tol=1e-6)


def test_long_text_is_read_to_its_end(spark):
    model = langid.Model(("a", "b"), *_weights())
    text = "x" * 3_000_000 + "zzzz" * 1_500_000
    assert langid.posterior(model, text)[0] == "b"


def _weights():
    import numpy as np

    from gaugeline.llm.ngrams import buckets, folded

    weights = np.zeros((1 << langid.BITS, 2), np.float32)
    for letter, side in (("x", 0), ("z", 1)):
        for h in buckets(folded(letter * 9), langid.SIZES, langid.BITS):
            weights[h, side] = 1
    return np.zeros(2), weights


def test_licences(spark):
    mit = dict(licenses.KNOWN)["MIT"]
    body = next(b for a, b in licenses.KNOWN if a == "MIT" and len(b) > 500)
    rows = [
        (1, f"Copyright (c) 2019 Some Person\n\n{body.upper()}"), (2, body.replace("license", "licence").replace(", ", " , ")),
        (3, f"prose\n{mit}\nmore\nAll Rights RESERVED!\n(c) 1999 nobody"), (4, None), (5, ""), (6, "\n \n"), (7, body[:-9]),
        (3, "Licenced under the Apache Licence, version 2.0"), (None, "all rights reserved"), (8, "Copyright 2020 X"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS license", "2 AS digest")
    got = {(r.doc_id, r.license, r.scope): r.n for r in licenses.licenses(docs).collect()}
    assert got == {
        (1, "MIT", "document"): 1, (1, "MIT", "line"): 1, (2, "MIT", "document"): 1, (3, "MIT", "line"): 1,
        (3, "All rights reserved", "line"): 1, (3, "Apache-2.0", "document"): 1, (None, "All rights reserved", "document"): 1,
    }
    own = spark.createDataFrame([("own", "Prose"), ("none", None)], "license string, text string")
    assert [tuple(r) for r in licenses.licenses(docs, own).collect()] == [(3, "own", "line", 1)]
    assert licenses.licenses(docs.where("false")).collect() == []


def filled(sizes, weights=(5, 2, 1), most=3):
    """Targets by resharing again and again, as the rule says it."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {}, list(order), sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


@pytest.mark.parametrize("sources", [3, 40])
def test_mix_of_odd_rows(spark, sources):
    rows = [(i, "w " * (i * i % 37 + (400 if i % 7 == 0 else 0)), None, None if i % 11 == 0 else f"s{i % sources}é") for i in range(300)]
    rows += [(7, "w w w", None, "s1é"), (7, "w w w", None, "s1é"), (None, "a b", None, None), (None, None, None, "zero"), (500, "x " * 50_000, None, "big")]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS size", "2 AS target", "3 AS rank", "4 AS sid", "5 AS bin")
    got = mixing.mixed_sizes(docs).collect()
    assert len(got) == len(rows)
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r["size"]
    want = filled(dict(sizes))
    total = sum(sizes.values())
    for r in got:
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9) and r.source_size == sizes[r.source]
    assert all(abs(taken[s] - want[s]) <= max(3 * mixing.block_words(total), 0.01 * want[s]) for s in want)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed_sizes(docs.repartition(7)).collect()))
    assert mixing.mixed_sizes(docs.where("false")).collect() == []
    assert mixing.mixed_sizes(docs.where("text is null")).first().taken == 0
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_schedule_prefixes_are_mixed(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    _, sources, pieces = mixing.schedule(docs)
    share = {r.sid: r.high - r.low for r in sources.collect()}
    rows = pieces.groupBy("slot", "sid").agg(F.sum("words")).collect()
    for n in (1000, 20_000, len(rows)):
        seen = Counter(r.sid for r in rows if r.slot < n)
        assert all(abs(seen[s] - share[s] * n) <= 4 for s in share)


def test_chat_of_odd_rows(spark):
    rows = [
        (1, 0, "user", "a<b>\\l \\\\b </turn> <turn assistant>"), (1, 1, "assistant", "x<\\g>\n\ny"), (1, 2, "user", "tail"),
        (2, 0, "assistant", None), (2, 1, None, "q"), (2, 1, None, "q"), (3, 0, "system", ""), (3, None, "we>ird<\\", "é😀"),
        (None, 0, "user", "alone"), (None, 1, "assistant", "apart"),
    ]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    turns = turns.selectExpr("*", "1 AS example", "2 AS formatted", "3 AS said")
    examples = chat.examples(turns)
    got = {r.conv_id: r for r in chat.digests(examples.where("conv_id is not null")).collect()}

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    for conv in (1, 2, 3):
        said = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv), key=lambda s: (s[0] is not None, s))
        told = "".join(f"{r}\n{x}\n" for _, r, x in said)
        loss = "".join(x for _, r, x in said if r == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(said), sha(told))
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), sha(loss))
    first = examples.where("conv_id = 1").orderBy("example").collect()
    assert len(first) == 2 and first[0].formatted[first[0].loss_start : first[0].loss_end] == "x\\l\\bg\\g\n\ny"
    assert first[1].loss_start is None and first[1].formatted.startswith(first[0].formatted)
    assert examples.where("conv_id is null").count() == 2
    assert chat.examples(turns.where("false")).collect() == [] and chat.digests(examples.where("false")).collect() == []


def test_chat_rows_without_conversation_agree_with_the_sql(spark):
    import compare
    import duckdb

    rows = [
        (None, 0, "user", "al<o>ne"), (None, 1, "assistant", "a\\part"), (None, 1, "assistant", "a\\part"), (None, None, None, None),
        (None, 7, "user", "last"), (None, 3, "assistant", ""), (5, 0, "user", "q"), (5, 1, "assistant", "r"),
        (-7, 0, "user", chat.CHALLENGE), (-7, 1, "assistant", chat.CHALLENGE),
    ]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows[:-2])
    for last in (len(rows), 4):
        con.execute("DELETE FROM conversations WHERE turn = 7" if last == 4 else "SELECT 1")
        got = chat.digests(chat.examples(turns.where("turn is null or turn <> 7") if last == 4 else turns))
        assert compare.spark_rows(got) == compare.duck_rows(con, chat.ORACLE)


def test_chat_query_writes_prefixes_for_rows_without_conversation(spark, tmp_path, monkeypatch):
    from gaugeline.llm import queries

    rows = [
        (None, 0, "user", "one<"), (None, 1, "assistant", "a\\"), (None, 2, "user", "two"), (None, 3, "assistant", "b</turn>"),
        (None, 4, None, None), (8, 0, "user", "q"), (8, 1, "assistant", "r"),
    ]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    kept = []

    def written(df, label):
        kept.append(queries_materialized(df, label))
        return kept[-1]

    queries_materialized = queries.materialized
    monkeypatch.setattr(queries, "materialized", written)
    got = {r.conv_id: r for r in queries.op10_chat_formatting(spark, str(tmp_path)).collect()}
    out = kept[0].where("conv_id is null").orderBy("example").collect()
    assert len(out) == 3 and all(b.formatted.startswith(a.formatted) for a, b in zip(out, out[1:]))
    assert [r.formatted[r.loss_start : r.loss_end] for r in out[:2]] == ["a\\b", "b\\l/turn\\g"] and out[2].loss_start is None
    loss = "a\\b</turn>"
    assert (got[None].n_turns, got[None].formatted_chars) == (5, sum(len(r.formatted) for r in out))
    assert (got[None].loss_chars, got[None].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert set(got) == {None, 8, -7}
