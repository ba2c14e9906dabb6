"""Near-duplicate documents: universal hash minima in bands, verification, components.

1. One pass over the texts gives each document its shingle set's size and digest and, once
   per set and task, 288 minima in 48 bands of 6 plus one bit of each minimum.  Two sets of
   Jaccard similarity 0.8 share no band with probability (1 - 0.8**6)**48 < 5e-7.
2. Equal sets form a class that goes on as its smallest document, so exact copies never
   meet each other in pairs.
3. Every class is compared with the smallest class of each of its buckets (a star, never
   all pairs): set sizes, signature bits and parities first, then the full shingle sets.
4. Alternating large-star and small-star steps turn the links into components.
5. Buckets that still hold several components are settled: what lies outside a bucket's
   largest component is compared with the rest of the bucket.  Signature bits and parities
   are part of the join condition, so only likely pairs leave the join.

Parities bound the difference of two sets from below: every shingle flips one of 512 bits, so
sets whose bits differ in d places differ in d shingles at least.  This refutes near copies
that fall a little short of the similarity, and never a link.

Sets travel as hash arrays of classes that occur in a likely pair; labels, links and sets
stay in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.worker_memory import remember_for
from gaugeline.sources.files import materialized

BANDS, ROWS = 48, 6
HASHES = BANDS * ROWS
WORDS_OF_BITS = -(-HASHES // 64)
#: Unequal signature bits of two sets of similarity 0.8 are binomial (288, 0.1): 28.8 on
#: average with a deviation of 5.1.  More than this has a probability below 1e-7.
MOST_UNEQUAL = 58
#: Bits of a set's parity sketch.
PARITIES = 512
#: Ids (8 bytes each) that may be broadcast; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Word hashes remembered by a Python worker.
REMEMBERED = 400_000

_seeds = np.random.default_rng(20240229)
_A = (_seeds.integers(0, 2**31, HASHES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _seeds.integers(0, 2**32, HASHES, dtype=np.uint32)
_MIX = (_seeds.integers(0, 2**62, ROWS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_PLACES = (_seeds.integers(0, 2**62, 64, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_BAND_SEEDS = _seeds.integers(0, 2**63, BANDS, dtype=np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _WordHashes()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, width: int = 4) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles.

    Words are runs of other characters than ASCII white space, A-Z in lower case.  Fewer
    words than ``width`` make one shingle; no words make none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(width, len(h))
    total = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        total += h[i : len(h) - n + 1 + i] * _PLACES[i]
    return np.unique(_mixed(total + np.uint64(n)))


def minima(hashes: np.ndarray) -> np.ndarray:
    """Minimum of each universal hash function over a set."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(x), 2048):
        values = x[None, start : start + 2048] * _A[:, None]
        values += _B[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(BANDS, ROWS).astype(np.uint64)
    return _mixed((rows * _MIX).sum(axis=1, dtype=np.uint64) ^ _BAND_SEEDS).view(np.int64)


def signature_bits(least: np.ndarray) -> np.ndarray:
    bits = np.zeros(WORDS_OF_BITS * 64, np.uint8)
    bits[:HASHES] = (least * np.uint32(0x9E3779B1)) >> np.uint32(31)
    return np.packbits(bits, bitorder="little").view(np.int64)


def parities(hashes: np.ndarray) -> np.ndarray:
    """For each of ``PARITIES`` cells whether an odd number of shingles falls into it."""
    cells = np.bincount((hashes % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES)
    return np.packbits((cells & 1).astype(np.uint8), bitorder="little").view(np.int64)


def _signer(width: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember_for("near-dedup", _words.clear)
        seen: set[bytes] = set()
        for batch in batches:
            sizes, high, low, bits, bands, odd = [], [], [], [], [], []
            for text in batch.column(1):
                found = shingles(text.as_py(), width)
                sizes.append(len(found))
                if not len(found):
                    high.append(None), low.append(None), bits.append(None), bands.append(None), odd.append(None)
                    continue
                digest = xxhash.xxh3_128_digest(found.tobytes())
                high.append(int.from_bytes(digest[:8], "little", signed=True))
                low.append(int.from_bytes(digest[8:], "little", signed=True))
                if digest in seen:
                    bits.append(None), bands.append(None), odd.append(None)
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(digest)
                least = minima(found)
                bits.append(signature_bits(least))
                bands.append(band_keys(least))
                odd.append(parities(found))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(sizes, pa.int64()), pa.array(high, pa.int64()),
                    pa.array(low, pa.int64()), pa.array(bits, longs), pa.array(bands, longs), pa.array(odd, longs),
                ],
                names=["doc_id", "n", "k1", "k2", "bits", "bands", "odd"],
            )

    return sign


def _hashed(width: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember_for("near-dedup", _words.clear)
        for batch in batches:
            found = [shingles(text.as_py(), width).tobytes() for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.binary())], names=["id", "hashes"]
            )

    return sets


def _confirmer(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for left, right in zip(batch.column(2), batch.column(3), strict=True):
                a = np.frombuffer(left.as_buffer(), np.uint64)
                b = np.frombuffer(right.as_buffer(), np.uint64)
                common = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
                linked.append(100 * common >= percent * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(
                pa.array(linked, pa.bool_())
            )

    return confirm


def rows_of(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose key is among the distinct ``ids`` (a column of the same name).

    The ids are broadcast only when their count is small; otherwise both sides shuffle.
    """
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, key, "left_semi")


def _unequal(a: str, b: str, words: int) -> Column:
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(words)), F.lit(0))


def _likely(percent: int) -> Column:
    """Whether classes with facts na, bits_a, odd_a and nb, bits_b, odd_b may be similar enough."""
    sizes = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    differ = (100 + percent) * _unequal("odd_a", "odd_b", PARITIES // 64) <= (100 - percent) * (F.col("na") + F.col("nb"))
    return sizes & (_unequal("bits_a", "bits_b", WORDS_OF_BITS) <= MOST_UNEQUAL) & differ


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of the distinct ids; of several texts of an id the first in string order."""
    return rows_of(docs.select("doc_id", "text"), ids).groupBy("doc_id").agg(F.min("text").alias("text"))


def confirmed(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of document ids whose full shingle sets are similar enough."""
    ids = pairs.select("a").distinct().unionAll(pairs.select("b").distinct()).toDF("doc_id").distinct()
    sets = materialized(
        _texts(docs, materialized(ids, "pair-ids")).mapInArrow(_hashed(width), "id bigint, hashes binary"), "shingle-sets"
    )
    both = pairs.join(sets.withColumnsRenamed({"id": "b", "hashes": "hb"}), "b").join(
        sets.withColumnsRenamed({"id": "a", "hashes": "ha"}), "a"
    )
    return both.select("a", "b", "ha", "hb").mapInArrow(_confirmer(percent), "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable from every id that has a link.

    Each step is two aggregates and two joins; the edges of a step are written out, so a
    lost executor costs one step.  Rows are (u, v) with u > v.
    """
    edges = materialized(
        links.where("a != b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "links",
    )
    print_of = (F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    before = None
    while True:
        now = tuple(edges.agg(*print_of).first())
        if now == before or not now[0]:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = now
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # every large-star edge points from a node to a smaller one
        large = materialized(large.distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        edges = materialized(
            small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "small-star"
        )


def _bucket_rows(classes: DataFrame) -> DataFrame:
    """(key, rep, pivot, size) of every bucket that several classes share."""
    rows = classes.select("rep", F.explode("bands").alias("key"))
    shared = (
        rows.groupBy("key")
        .agg(F.count("*").alias("size"), F.min("rep").alias("pivot"))
        .where("size > 1")
    )
    return rows.join(shared, "key")


def _open_pairs(buckets: DataFrame, classes: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Likely pairs across the components that still share a bucket."""
    named = (
        buckets.where("size > 2")
        .join(labels, F.col("rep") == F.col("id"), "left")
        .select("key", "rep", "pivot", F.coalesce("component", "rep").alias("component"))
    )
    parts = named.groupBy("key", "component").agg(F.count("*").alias("n"))
    mixed = (
        parts.groupBy("key")
        .agg(F.count("*").alias("parts"), F.max(F.struct("n", "component")).alias("top"))
        .where("parts > 1")
        .select("key", F.col("top.component").alias("top"))
    )
    rows = named.where("rep != pivot").join(mixed, "key")
    rows = materialized(rows.join(classes.select("rep", "n", "bits", "odd"), "rep"), "open-buckets")
    left = rows.where("component != top").select(
        "key", F.col("rep").alias("a"), F.col("component").alias("ca"), F.col("top").alias("t"),
        F.col("n").alias("na"), F.col("bits").alias("bits_a"), F.col("odd").alias("odd_a"),
    )
    right = rows.select(
        "key", F.col("rep").alias("b"), F.col("component").alias("cb"),
        F.col("n").alias("nb"), F.col("bits").alias("bits_b"), F.col("odd").alias("odd_b"),
    )
    once = (F.col("cb") == F.col("t")) | (F.col("a") < F.col("b"))
    return (
        left.join(right, "key")
        .where((F.col("ca") != F.col("cb")) & once & _likely(percent))
        .select("a", "b", "ca", "cb")
        .distinct()
    )


def near_duplicates(docs: DataFrame, width: int = 4, percent: int = 80) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_shingles, component_id and kept.

    Documents are linked when ``100 * intersection >= percent * union`` of their shingle
    sets; ``component_id`` is the smallest doc_id reachable by links and ``kept`` marks it.
    Null, empty and blank texts have no shingles and stand alone.  A null doc_id has no
    component (null) and is kept.  An id that occurs in several rows is treated row by row;
    where texts are compared in full, its first text in string order stands for it.
    Other columns are not read.
    """
    plain = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    signed = materialized(
        plain.mapInArrow(
            _signer(width),
            "doc_id bigint, n bigint, k1 bigint, k2 bigint, bits array<bigint>, bands array<bigint>, "
            "odd array<bigint>",
        ),
        "signatures",
    )
    classes = materialized(
        signed.where("k1 is not null")
        .groupBy("k1", "k2")
        .agg(
            F.min("doc_id").alias("rep"), F.first("n").alias("n"),
            F.first("bits", ignorenulls=True).alias("bits"),
            F.first("bands", ignorenulls=True).alias("bands"), F.first("odd", ignorenulls=True).alias("odd"),
        )
        .where("rep is not null"),
        "classes",
    )
    buckets = materialized(_bucket_rows(classes), "buckets")
    stars = buckets.where("rep != pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    facts = classes.select("rep", "n", "bits", "odd")
    stars = (
        stars.join(facts.toDF("b", "nb", "bits_b", "odd_b"), "b")
        .join(facts.toDF("a", "na", "bits_a", "odd_a"), "a")
        .where(_likely(percent))
        .select("a", "b")
    )
    labels = components(confirmed(plain, materialized(stars, "star-pairs"), width, percent))
    pairs = materialized(_open_pairs(buckets, classes, labels, percent), "open-pairs")
    found = confirmed(plain, pairs.select("a", "b"), width, percent)
    joined = pairs.join(found, ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    merged = components(joined).toDF("component", "merged")
    named = (
        classes.select("k1", "k2", "rep")
        .join(labels, F.col("rep") == F.col("id"), "left")
        .select("k1", "k2", F.coalesce("component", "rep").alias("component"))
        .join(merged, "component", "left")
        .select("k1", "k2", F.coalesce("merged", "component").alias("component"))
    )
    return (
        signed.select("doc_id", F.col("n").alias("n_shingles"), "k1", "k2")
        .join(named, ["k1", "k2"], "left")
        .select(
            "doc_id", "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def keep_one_of_each(docs: DataFrame, width: int = 4, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with one document of each group of near copies.

    Rows without an id stay.  Of several equal rows of one id one stays.
    """
    told = near_duplicates(docs, width, percent).where("doc_id is not null").groupBy(F.col("doc_id").alias("__id"))
    told = materialized(told.agg(F.count("*").alias("__n"), F.bool_or("kept").alias("kept")), "told-ids")
    dropped = told.where("not kept").select("__id")
    if dropped.count() <= BROADCAST_IDS:
        dropped = F.broadcast(dropped)
    known = docs.where("doc_id is not null")
    chosen = known.join(dropped, F.col("doc_id").cast("bigint") == F.col("__id"), "left_anti")
    if not told.where("kept and __n > 1").isEmpty():
        chosen = chosen.dropDuplicates(docs.columns)
    return chosen.unionAll(docs.where("doc_id is null"))
