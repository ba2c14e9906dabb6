"""Packed ids against whole-text encoding by the library, and exact round trips."""

import itertools
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gaugeline.llm import token_files as tf
from gaugeline.sources.files import work_dir

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "Don't stop, they'll say; it's ÉCOLE İstanbul ΣΣ naïve",
    "<|endoftext|> in<|startoftext|>side", "é a b\x1cc\x85d 　 12²½", "!!'s 's!'t\t\r\nx'", "", " ",
    "你好 \U0001f600‍ ­soft ªº", None,
]


@settings(deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=40), st.data())
def test_bits_round_trip(bits, values, data):
    ids = np.array([v % 2**bits for v in values], np.uint32)
    packed = tf.pack(ids, bits)
    assert len(packed) == -(-len(ids) * bits // 8)
    start = data.draw(st.integers(0, len(ids)))
    count = data.draw(st.integers(0, len(ids) - start))
    assert tf.unpack(packed, bits, start, count).tolist() == ids[start : start + count].tolist()


def test_pieces_give_the_librarys_ids():
    with open(TOKENIZER, encoding="utf-8") as f:
        encoder = tf.Encoder(f.read())
    assert encoder.pattern is not None
    texts = [x or "" for x in ODD]
    for text, ids in zip(texts, encoder.encode(iter(texts)), strict=True):
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


@settings(deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x24F, exclude_categories=["Cs"])))
def test_latin_texts(text):
    if "encoder" not in globals():
        with open(TOKENIZER, encoding="utf-8") as f:
            globals()["encoder"] = tf.Encoder(f.read())
    want = encoder.tokenizer.encode(text, add_special_tokens=False).ids  # noqa: F821
    assert next(encoder.encode(iter([text]))).tolist() == want  # noqa: F821


def expected(rows):
    tokenizer, start = Tokenizer.from_file(TOKENIZER), 0
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        yield doc_id, start, len(ids), ids
        start += len(ids)


def test_documents_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = list(expected(sorted((r.doc_id, r.text) for r in docs.collect())))
    path = work_dir(spark, "blocks")
    tf.write_blocks(docs, path, TOKENIZER)
    got = sorted(map(tuple, tf.read_digests(spark, path).collect()))
    crc = [(d, s, n, zlib.crc32(np.array(i, "<u4").tobytes())) for d, s, n, i in want]
    assert got == crc
    whole = list(itertools.chain.from_iterable(i for *_, i in want))
    assert tf.read_range(spark, path, 12_345, 40_000).tolist() == whole[12_345:52_345]


def test_odd_rows(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "a"), (3, "!!"), (3, "!!"), (50, "long " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "text AS ids", "1 AS part")
    path = work_dir(spark, "blocks")
    tf.write_blocks(docs, path, TOKENIZER)
    got = sorted(tf.read_ids(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 0, 1, 2, 3, 3, 3, 4, 5, 6, 7, 50]
    assert got[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in itertools.pairwise(got))
    texts = {i: sorted(x.ids for x in got if x.doc_id == i) for i in (3, 7, 50)}
    assert texts[7] == [[1]] and len(texts[50][0]) > 30_000
    assert len(texts[3]) == 3 and any(texts[3][i] == texts[3][i + 1] for i in range(2))


def test_a_worker_remembers_for_one_operator():
    from gaugeline.llm import worker_memory

    log = []
    worker_memory.remember_for("one", lambda: log.append("one"))
    worker_memory.remember_for("one", lambda: log.append("again"))
    worker_memory.remember_for("two", lambda: log.append("two"))
    worker_memory.remember_for("one", lambda: log.append("one"))
    assert log[-2:] == ["one", "two"]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert tf.encode_documents(docs, TOKENIZER).collect() == []
