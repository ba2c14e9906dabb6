"""Groups, links and counts against a plain program over whole-text encodings."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from gaugeline.llm import token_alignment as ta

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = [
    "Don't stop, they'll say: it's ÉCOLE naïve", "<|endoftext|> in<|endoftext|>side <s> </s><unk>", "  two  spaces \n\n and\tlines ",
    " ", "▁ lower", "a b　c  d", "你好 世界。 漢字", "\U0001f600\U0001f468‍\U0001f469 x", "x" * 300, "ab" * 90 + " " + "=" * 200,
    "a\x00b \x1c c\x85 d", "", None, "tab\t \tmix \r\n end", "ＡＢ ﬁ é", "word", "word", "é" * 80,
]


def brute(texts):
    a, b = ta.ByteLevel(A), ta.Pieces(B)
    docs, held = [], defaultdict(int)
    for text in texts:
        whole = " " + (text or "")
        x, y = a.tokenizer.encode(whole, add_special_tokens=False).ids, b.model.encode(text or "")
        if not text or any(b"".join(t.bytes[i] for i in ids) != whole.encode() for t, ids in ((a, x), (b, y))):
            docs.append(None)
            continue
        ends = []
        for t, ids in ((a, x), (b, y)):
            at, found = 0, []
            for i in ids:
                at += len(t.bytes[i])
                found.append(at)
            ends.append(found)
        groups, i, j = [], 0, 0
        place = [{end: k + 1 for k, end in enumerate(found)} for found in ends]
        for cut in sorted(place[0].keys() & place[1].keys()):
            p, q = place[0][cut], place[1][cut]
            groups.append((x[i:p], y[j:q]))
            i, j = p, q
        links = Counter((u, v) for g in groups for u in g[0] for v in g[1])
        docs.append((len(x), len(y), groups, links))
        for pair in links:
            held[pair] += 1
    best = defaultdict(int)
    for (u, _), n in held.items():
        best[u] = max(best[u], n)
    rows = []
    for d in docs:
        if d is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = d
        shown = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        rows.append((
            n_a, n_b, len(groups), sum(links.values()), sum(n for p, n in links.items() if held[p] == best[p[0]]),
            sum(n * held[p] for p, n in links.items()), hashlib.sha256(shown.encode()).hexdigest(),
        ))
    return rows


def plain(df):
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted(str((r.doc_id, *(r[n] for n in names))) for r in df.collect())


def want(rows):
    return sorted(str((d, *r)) for (d, _), r in zip(rows, brute([t for _, t in rows]), strict=True))


@pytest.mark.parametrize("most", [10**6, 0])
def test_odd_rows(spark, most):
    rows = [*enumerate(ODD), (None, "null id"), (3, "again"), (3, "again"), (90, "Lorem, ipsum! " * 90_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).selectExpr("*", "1 AS row", "2 AS pairs", "3 AS links", "4 AS n_a")
    got = ta.alignment(docs, A, B, most)
    fast = [r for r in rows if r[0] != 90]
    # the long text repeats one line, so its numbers follow from two short ones
    short = brute(["Lorem, ipsum! " * n for n in (5, 6)])
    long = next(r for r in got.collect() if r.doc_id == 90)
    for k, name in enumerate(("n_a", "n_b", "n_groups")):
        assert long[name] == short[0][k] + (short[1][k] - short[0][k]) * (90_000 - 5)
    others = ta.alignment(docs.where("doc_id is null or doc_id <> 90"), A, B, most)
    assert plain(others) == want(fast)
    assert ta.alignment(docs.where("false"), A, B, most).collect() == []


def test_documents_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert plain(ta.alignment(docs, A, B)) == want([(r.doc_id, r.text) for r in docs.collect()])


@settings(deadline=None, max_examples=300)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\taé'.,1x"), st.characters(exclude_categories=["Cs"])), max_size=30))
@example("a ᠎ b")
def test_chunks_give_the_ids_of_whole_texts(text):
    encoder = globals().setdefault("_encoder", None) or ta.Encoder(A, B)
    globals()["_encoder"] = encoder
    assert encoder.chunked
    got = encoder.encode([text])[0]
    x = encoder.a.tokenizer.encode(" " + text, add_special_tokens=False).ids
    y = encoder.b.model.encode(text)
    whole = (" " + text).encode()
    same = b"".join(map(encoder.a.bytes.__getitem__, x)) == b"".join(map(encoder.b.bytes.__getitem__, y)) == whole
    if not text or not same:
        assert got is None
    else:
        assert (got[0].tolist(), got[1].tolist()) == (x, y)


@settings(deadline=None, max_examples=300)
@given(st.lists(st.tuples(st.sets(st.integers(1, 39)), st.sets(st.integers(1, 39))), min_size=1, max_size=4))
def test_cuts_are_the_shared_ends(texts):
    a_ends, b_ends, starts = [], [], [0]
    for k, (a, b) in enumerate(texts):
        a_ends += [40 * k + e for e in sorted(a | {40})]
        b_ends += [40 * k + e for e in sorted(b | {40})]
        starts.append(len(a_ends))
    got = ta.shared_cuts(np.array(a_ends), np.array(b_ends), np.array(starts))
    assert [a_ends[i] for i in got] == sorted(set(a_ends) & set(b_ends))


def test_links_in_parts(monkeypatch):
    a_group, b_group = np.array([0, 0, 1, 2, 2, 2]), np.array([0, 1, 1, 1, 2, 2])
    a, b = np.arange(6), np.arange(10, 16)
    want_ = sorted((x, y, g) for x, g in zip(a, a_group) for y, h in zip(b, b_group) if g == h)
    for size in (1, 3, 100):
        monkeypatch.setattr(ta, "PAIRS_AT_ONCE", size)
        got = sorted(t for part in ta._links(a, b, a_group, b_group, 3) for t in zip(*part))
        assert got == want_
