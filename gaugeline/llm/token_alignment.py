"""Alignment of two tokenizers' tokens: groups between shared cuts, links and their counts.

Every text is encoded by both tokenizers in the task that reads it.  Divide and conquer finds
the groups: an interval of tokens looks, from its middle outwards, for an end of A that a
bisection of B's ends finds there too, and is split into two intervals at it; an interval
without such a cut is a group.  All intervals of a batch of texts take their steps together.

The distinct linked id pairs of every document are written with their number of links.
Their document counts come from one grouping with partial sums, and are looked up in a
broadcast table while its counted size allows, by a join with the pairs of each document
beyond that (hot pairs are then split by adaptive execution).
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.worker_memory import remember_for
from gaugeline.sources.files import materialized

#: Id pairs whose counts are broadcast (13 bytes each) and not joined.
BROADCAST_PAIRS = 2_000_000
#: Chunks remembered by a worker, their longest length, characters aligned at a time, and
#: pairs of one group that are made at a time.
REMEMBERED, LONGEST, CHARACTERS, PAIRS_AT_ONCE = 500_000, 64, 1 << 20, 1 << 20
#: A space after one of these starts a new chunk: neither tokenizer joins tokens across it.
_CUT = re.compile(r"(?<=[!-~\w])(?= )")
_UNSURE = re.compile(r"[^!-~\w] ")


@functools.cache
def _byte_alphabet() -> dict[str, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for 256 and on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """Tokenizer A: a byte-level BPE file of the tokenizers library; special strings are text."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        alphabet, vocabulary = _byte_alphabet(), self.tokenizer.get_vocab()
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            known = all(c in alphabet for c in entry)
            self.bytes[i] = bytes(alphabet[c] for c in entry) if known else entry.encode()
        with open(path, encoding="utf-8") as f:
            definition = json.load(f)
        level = definition["pre_tokenizer"] or {}
        #: True if chunks can be encoded one by one
        self.splits = definition["normalizer"] is None and level.get("type") == "ByteLevel" and level["use_regex"]

    def encode(self, chunks: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]


class Pieces:
    """Tokenizer B: a sentencepiece model, which puts a space before what it encodes."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.bytes, names = [], []
        for i in range(self.model.vocab_size()):
            name = self.model.id_to_piece(i)
            names.append(name)
            self.bytes.append(bytes([int(name[3:5], 16)]) if self.model.is_byte(i) else name.replace("▁", " ").encode())
        #: True if no piece goes on after a word's end
        self.splits = not any(re.search("[^▁]▁", n) for n in names)

    def encode(self, chunks: list[str]) -> list[list[int]]:
        """Each chunk begins with the space that the model adds."""
        return self.model.encode([c[1:] for c in chunks], num_threads=1)


def _lengths(entries: list[bytes]) -> np.ndarray:
    return np.array([len(b) for b in entries], np.int64)


class Encoder:
    """Ids of " " + text by both tokenizers, or None where their bytes differ from it."""

    def __init__(self, a: str, b: str) -> None:
        self.a, self.b = ByteLevel(a), Pieces(b)
        self.known: tuple[dict[str, bytes | None], dict[str, bytes | None]] = ({}, {})
        self.chunked = self.a.splits and self.b.splits

    def _sides(self, chunks: list[str]) -> list[list[bytes | None]]:
        """Each chunk's ids in both tokenizers as bytes, None twice where bytes differ from the chunk."""
        wanted = [c.encode() for c in chunks]
        lengths = np.array([len(w) for w in wanted])
        sides, good = [], np.ones(len(chunks), bool)
        for tokenizer in (self.a, self.b):
            ids = tokenizer.encode(chunks)
            flat = list(itertools.chain.from_iterable(ids))
            entries = [tokenizer.bytes[i] for i in flat]
            ends = np.cumsum([len(i) for i in ids])
            sizes = np.concatenate([[0], np.cumsum([len(e) for e in entries])])[np.concatenate([[0], ends])]
            if b"".join(entries) != b"".join(wanted) or (np.diff(sizes) != lengths).any():
                starts = [0, *ends[:-1].tolist()]
                good &= [b"".join(entries[x:y]) == w for x, y, w in zip(starts, ends.tolist(), wanted, strict=True)]
            packed, cuts = np.array(flat, np.uint32).tobytes(), [0, *(4 * ends).tolist()]
            sides.append([packed[x:y] for x, y in itertools.pairwise(cuts)])
        for i in np.flatnonzero(~good):
            sides[0][i] = sides[1][i] = None
        return sides

    def _chunks(self, text: str) -> list[str]:
        if not self.chunked:
            return [text]
        if not _UNSURE.search(text):
            return [" " + c for c in text[1:].split(" ")]
        return _CUT.split(text)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        cut = [self._chunks(" " + t) if t else [] for t in texts]
        if len(self.known[0]) > REMEMBERED:
            for known in self.known:
                known.clear()
        fresh = list(set().union(*cut) - self.known[0].keys())
        for known, side in zip(self.known, self._sides(fresh) if fresh else ((), ()), strict=True):
            known.update(zip(fresh, side, strict=True))
        found: list[tuple[np.ndarray, np.ndarray] | None] = []
        for text, chunks in zip(texts, cut, strict=True):
            sides = [list(map(known.__getitem__, chunks)) for known in self.known]
            if None in sides[0]:  # the whole text decides
                sides = self._sides([" " + text])
            if not sides[0] or None in sides[0]:
                found.append(None)
            else:
                found.append(tuple(np.frombuffer(b"".join(side), np.uint32) for side in sides))
        for chunk in fresh:
            if len(chunk) > LONGEST:
                for known in self.known:
                    del known[chunk]
        return found


def shared_cuts(a_ends: np.ndarray, b_ends: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Numbers of the A tokens that end a group, ascending.

    Ends ascend through all texts of a batch; ``starts`` has the number of each text's first
    A token and at last the number of all.  A text's last token ends a group.  Intervals are
    (low, high): tokens low .. high - 1, of which high - 1 is known to end a group.
    """
    low, high = starts[:-1], starts[1:]
    low, high = low[high > low], high[high > low]
    cuts = [high - 1]
    while len(low):
        wide = high - low > 1
        low, high = low[wide], high[wide]
        middle = (low + high - 2) // 2
        at = np.full(len(low), -1)
        open_, step = np.arange(len(low)), 0
        while len(open_):
            left = []
            for try_ in (middle[open_] + step, middle[open_] - step)[: 1 + (step > 0)]:
                inside = (try_ >= low[open_]) & (try_ < high[open_] - 1) & (at[open_] < 0)
                tried, end = open_[inside], a_ends[try_[inside]]
                place = np.minimum(np.searchsorted(b_ends, end), len(b_ends) - 1)
                hit = b_ends[place] == end
                at[tried[hit]] = try_[inside][hit]
            step += 1
            missing = at[open_] < 0
            left = (middle[open_] - step >= low[open_]) | (middle[open_] + step < high[open_] - 1)
            open_ = open_[missing & left]
        found = at >= 0
        cut, low, high = at[found], low[found], high[found]
        cuts.append(cut)
        # halves stay in the order of the text, so that searches run through memory in order
        low, high = np.stack([low, cut + 1], 1).ravel(), np.stack([cut + 1, high], 1).ravel()
    return np.sort(np.concatenate(cuts))


def _parts(encoded: list[tuple[np.ndarray, np.ndarray]], a_lengths: np.ndarray, b_lengths: np.ndarray):
    """Ids of a batch in one array a side, with each token's group and each text's first token."""
    a, b = (np.concatenate([e[k] for e in encoded]).astype(np.int64) for k in (0, 1))
    starts = [np.concatenate([[0], np.cumsum([len(e[k]) for e in encoded])]) for k in (0, 1)]
    a_ends, b_ends = np.cumsum(a_lengths[a]), np.cumsum(b_lengths[b])
    cuts = shared_cuts(a_ends, b_ends, starts[0])
    a_group = np.zeros(len(a), np.int64)
    a_group[cuts[:-1] + 1] = 1
    a_group = np.cumsum(a_group)
    b_group = np.searchsorted(a_ends[cuts], b_ends)
    return a, b, a_group, b_group, starts, len(cuts)


def _links(a, b, a_group, b_group, groups: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a id, b id, group) of all links, in parts of bounded size."""
    n_a, n_b = np.bincount(a_group, minlength=groups), np.bincount(b_group, minlength=groups)
    b_first = np.cumsum(n_b) - n_b
    per_token = n_b[a_group]
    before = np.cumsum(per_token)
    start = 0
    while start < len(a):
        limit = (before[start - 1] if start else 0) + PAIRS_AT_ONCE
        stop = max(start + 1, int(np.searchsorted(before, limit, side="right")))
        token = np.repeat(np.arange(start, stop), per_token[start:stop])
        first = np.repeat(before[start:stop] - per_token[start:stop], per_token[start:stop])
        other = b_first[a_group[token]] + np.arange(len(token)) + (before[start - 1] if start else 0) - first
        yield a[token], b[other], a_group[token]
        start = stop


class Aligner:
    """Rows of a batch of texts: sizes, the digest of the groups, distinct pairs with their links."""

    def __init__(self, a: str, b: str) -> None:
        self.encoder = Encoder(a, b)
        self.lengths = [_lengths(t.bytes) for t in (self.encoder.a, self.encoder.b)]
        sizes = [len(x) for x in self.lengths]
        # an id's text with what follows it: A inside and at the end of its group, then B
        self.shown = [f"{i}{after}".encode() for side, n in zip((",|", ",;"), sizes, strict=True) for after in side for i in range(n)]
        self.sizes = sizes

    def rows(self, texts: list[str]) -> list[tuple]:
        encoded = self.encoder.encode(texts)
        held = [e for e in encoded if e is not None]
        rows = iter(self._aligned(held) if held else ())
        return [(0, 0, 0, 0, "", [], []) if e is None else next(rows) for e in encoded]

    def _aligned(self, encoded: list) -> Iterator[tuple]:
        a, b, a_group, b_group, (a_start, b_start), groups = _parts(encoded, *self.lengths)
        n_a, n_b = np.bincount(a_group, minlength=groups), np.bincount(b_group, minlength=groups)
        last_a, last_b = (np.append(g[1:] != g[:-1], True) for g in (a_group, b_group))
        # the place of every token when a group's A ids come first and then its B ids
        order = np.empty(len(a) + len(b), np.int64)
        b_before, a_until = np.cumsum(n_b) - n_b, np.cumsum(n_a)
        order[np.arange(len(a)) + b_before[a_group]] = a + self.sizes[0] * last_a
        order[np.arange(len(b)) + a_until[b_group]] = b + 2 * self.sizes[0] + self.sizes[1] * last_b
        text_of_group = np.searchsorted(a_start, np.cumsum(n_a) - n_a, side="right") - 1
        group_start = np.searchsorted(text_of_group, np.arange(len(encoded) + 1))
        links = np.bincount(text_of_group, n_a * n_b, len(encoded)).astype(np.int64)
        codes, counts, bounds = self._distinct(a, b, a_group, b_group, groups, text_of_group, len(encoded))
        for i in range(len(encoded)):
            first, end = a_start[i] + b_start[i], a_start[i + 1] + b_start[i + 1]
            shown = b"".join(map(self.shown.__getitem__, order[first:end].tolist()))
            pairs = slice(bounds[i], bounds[i + 1])
            yield (
                int(a_start[i + 1] - a_start[i]), int(b_start[i + 1] - b_start[i]), int(group_start[i + 1] - group_start[i]),
                int(links[i]), hashlib.sha256(shown[:-1]).hexdigest(), codes[pairs], counts[pairs],
            )

    def _distinct(self, a, b, a_group, b_group, groups: int, text_of_group, texts: int):
        """Distinct (text, id pair) with their number of links, ascending."""
        base = self.sizes[0] * self.sizes[1]
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for x, y, g in _links(a, b, a_group, b_group, groups):
            some, n = np.unique(text_of_group[g] * base + x * self.sizes[1] + y, return_counts=True)
            keys, place = np.unique(np.concatenate([keys, some]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([counts, n]), len(keys)).astype(np.int64)
        return keys % base, counts, np.searchsorted(keys // base, np.arange(texts + 1))


_aligners: dict[tuple[str, str], Aligner] = {}


def _aligner(a: str, b: str) -> Aligner:
    remember_for("token alignment", _aligners.clear)
    if (a, b) not in _aligners:
        _aligners.clear()
        _aligners[a, b] = Aligner(a, b)
    return _aligners[a, b]


NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]
ALIGNED = (
    "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
    "pairs array<bigint>, links array<bigint>"
)


def _align(a: str, b: str):
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, row = _aligner(a, b), TaskContext.get().partitionId() << 33
        names = [x.split()[0] for x in ALIGNED.split(", ")]

        def made(ids: list, texts: list[str]) -> pa.RecordBatch:
            rows = aligner.rows(texts)
            n_a, n_b, n_groups, n_links, digests, pairs, links = zip(*rows, strict=True)
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in pairs])]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64))) for x in (pairs, links)]
            numbers = [pa.array(x, pa.int64()) for x in (range(row, row + len(ids)), ids, n_a, n_b, n_groups, n_links)]
            return pa.RecordBatch.from_arrays([*numbers, pa.array(digests), *lists], names=names)

        ids, texts, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc_id)
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size >= CHARACTERS or len(ids) >= 4096:
                    yield made(ids, texts)
                    row += len(ids)
                    ids, texts, size = [], [], 0
        if ids:
            yield made(ids, texts)

    return align


def aligned(docs: DataFrame, a: str, b: str) -> DataFrame:
    """A row per document: sizes, digest of the groups, and its distinct id pairs with their links.

    ``a`` and ``b`` are paths of the tokenizer files, the same on every machine.  A pair's code
    is ``a_id * size_of_b + b_id``.  See ``alignment`` for the rows of odd texts.
    """
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(_align(a, b), ALIGNED)


def pair_counts(rows: DataFrame, b_size: int) -> DataFrame:
    """(pair, n_docs, best): documents that hold a pair linked, and whether no pair of its A id has more."""
    counted = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n_docs"))
    counted = materialized(counted, "pair-counts").withColumn("a", F.floor(F.col("pair") / b_size))
    most = counted.groupBy("a").agg(F.max("n_docs").alias("most"))
    return counted.join(most, "a").select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def _looked_up(shared):
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, best = shared.value
        for batch in batches:
            lists = batch.column(6)
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            at = np.searchsorted(pairs, lists.flatten().to_numpy())
            links = batch.column(7).flatten().to_numpy()
            sums = []
            for value in (best[at] * links, counts[at] * links):
                total = np.zeros(batch.num_rows, np.int64)
                np.add.at(total, row, value)
                sums.append(pa.array(total))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:6], *sums], names=["doc_id", *NUMBERS, "groups_sha256", "n_best", "count_sum"]
            )

    return look


def alignment(docs: DataFrame, a: str, b: str, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    Texts that are null or empty, or whose tokens' bytes differ from space + text in one of the
    tokenizers, have no tokens: zeros and an empty digest.  Repeated rows count as documents of
    their own; other columns are not read; an empty table gives no row.
    """
    spark = docs.sparkSession
    rows = materialized(aligned(docs, a, b), "aligned")
    counts = materialized(pair_counts(rows, len(_aligner(a, b).lengths[1])), "pair-facts")
    if counts.count() <= broadcast_pairs:
        table = counts.orderBy("pair").toArrow()
        shared = spark.sparkContext.broadcast(tuple(table.column(i).to_numpy() for i in range(3)))
        schema = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
        chosen = rows.select("doc_id", *NUMBERS, "groups_sha256", "pairs", "links")
        return chosen.mapInArrow(_looked_up(shared), f"{schema}, n_best bigint, count_sum bigint")
    each = rows.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("p"))
    each = each.select("row", F.col("p.pairs").alias("pair"), F.col("p.links").alias("links"))
    summed = each.join(counts, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"),
        F.sum(F.col("n_docs") * F.col("links")).alias("count_sum"),
    )
    zero = F.lit(0).cast("bigint")
    return rows.join(summed, "row", "left").select(
        "doc_id", *NUMBERS, "groups_sha256",
        F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"),
    )
