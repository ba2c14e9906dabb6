"""Ranked lexical search: the highest inner products by buckets of vector length (LEMP).

A document is a sparse vector of term impacts, an item a sparse vector of term frequencies;
both carry the square root of a term's weight in their lengths, and their inner product is
the integer score.  The work is done in three passes of Spark:

1. Every whole text is cut into terms once; terms of the items stay as (term, frequency).
   Document counts, total lengths and document frequencies come from all rows.
2. Impact vectors are dealt out by range of their length, longest first, ties spread by a
   hash, and each task cuts its vectors into buckets of similar length.
3. For each item a task goes through its buckets.  A bucket whose longest vector cannot reach
   the score of the k-th best so far is skipped (Cauchy-Schwarz); inside the others, bounds
   of the coordinates leave the documents that hold one of the item's heaviest terms and
   whose partial score can still reach it.  Survivors are scored exactly in integers.  The
   k-th best of the longest vectors is found first, so that every task starts from it.

A document is left out only where a bound proves that its score is too low, so the rows are
those of scoring everything.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeline.sources.files import materialized

TOP = 10
#: Characters of a block of items, which bound what is broadcast.
BLOCK_CHARACTERS = 2_000_000
#: Postings of a bucket, and documents of the bucket that is read first.
BUCKET_POSTINGS, HEAD_DOCUMENTS = 1 << 18, 4096
#: Bytes that end a term become spaces, A-Z become a-z; bytes of other scripts stay.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    """Terms of a whole text in UTF-8: runs of ASCII letters and digits and other scripts."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


@dataclass
class Items:
    """A block of items: the vocabulary, and each item's term numbers and frequencies."""

    keys: list[int]
    vocabulary: dict[bytes, int]
    terms: list[np.ndarray]
    counts: list[np.ndarray]

    @staticmethod
    def of(rows: list[tuple[int, str | None]]) -> Items:
        vocabulary: dict[bytes, int] = {}
        keys, terms, counts = [], [], []
        for key, text in rows:
            numbers = np.array([vocabulary.setdefault(t, len(vocabulary)) for t in terms_of(text)], np.int64)
            found, n = np.unique(numbers, return_counts=True)
            keys.append(key)
            terms.append(found)
            counts.append(n.astype(np.int64))
        return Items(keys, vocabulary, terms, counts)


def _vectors(shared):
    """Tasks that cut texts: (doc, doc_id, n, terms, tf); doc is a number of the row."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            lengths, terms, counts, offsets = [], [], [], [0]
            for text in batch.column(1):
                words = terms_of(text.as_py())
                lengths.append(len(words))
                seen = Counter(map(vocabulary.get, words))
                seen.pop(None, None)
                terms.extend(seen)
                counts.extend(seen.values())
                offsets.append(len(terms))
            offsets = pa.array(offsets, pa.int32())
            columns = [
                pa.array(range(row, row + batch.num_rows), pa.int64()), batch.column(0), pa.array(lengths, pa.int64()),
                pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())),
                pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64())),
            ]
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "doc_id", "n", "terms", "tf"])

    return cut


@dataclass
class Weights:
    """Integer term weights of a block, and the corpus counts that impacts need."""

    weight: np.ndarray
    documents: int
    words: int

    def impacts(self, n: np.ndarray, tf: np.ndarray) -> np.ndarray:
        m = 25 + (75 * n * self.documents) // max(self.words, 1)
        return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _weighted(shared):
    """Tasks that turn frequencies into impacts: adds each vector's length."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights: Weights = shared.value
        for batch in batches:
            lists = batch.column(3)
            sizes = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), sizes)
            terms = lists.flatten().to_numpy()
            impact = weights.impacts(batch.column(2).to_numpy()[row], batch.column(4).flatten().to_numpy())
            kept = (weights.weight[terms] > 0) & (impact > 0)
            row, terms, impact = row[kept], terms[kept], impact[kept]
            squares = np.bincount(row, weights.weight[terms] * impact.astype(float) ** 2, batch.num_rows)
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))]), pa.int32())
            columns = [
                batch.column(0), batch.column(1), pa.array(np.sqrt(squares)),
                pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())),
                pa.ListArray.from_arrays(offsets, pa.array(impact, pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "doc_id", "length", "terms", "impacts"])

    return weigh


class Bucket:
    """Vectors of similar length, by document (rows) and by term (postings)."""

    def __init__(self, docs, ids, lengths, row, terms, impacts, weight: np.ndarray) -> None:
        self.docs, self.ids, self.lengths, self.weight = docs, ids, lengths, weight
        self.longest = float(lengths.max(initial=0))
        order = np.argsort(terms, kind="stable")
        self.posted, self.row, self.impacts = terms[order], row[order], impacts[order]
        self.terms, first = np.unique(self.posted, return_index=True)
        self.first = np.append(first, len(self.posted))
        self.most = np.maximum.reduceat(self.impacts, first) if len(first) else np.zeros(0, np.int64)
        # postings are in the order of (term, row), so one search finds a pair
        self.pair = self.posted.astype(np.int64) * len(docs) + self.row

    def scores(self, rows: np.ndarray, terms: np.ndarray, weighted: np.ndarray) -> np.ndarray:
        """Exact integer scores of some documents."""
        total = np.zeros(len(rows), np.int64)
        for term, weight in zip(terms.tolist(), weighted.tolist(), strict=True):
            wanted = term * len(self.docs) + rows
            at = np.minimum(np.searchsorted(self.pair, wanted), len(self.pair) - 1)
            total += np.where(self.pair[at] == wanted, self.impacts[at] * weight, 0)
        return total

    def search(self, terms: np.ndarray, weighted: np.ndarray, length: float, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of at least ``least`` (above 0); ``length`` is the item's."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        slack = 1 + 1e-9  # of sums in doubles
        if length * self.longest * slack < least or not len(self.terms):
            return none
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        held = self.terms[at] == terms
        at, terms, weighted = at[held], terms[held], weighted[held]
        bound = self.most[at] * weighted
        order = np.argsort(-bound, kind="stable")
        at, terms, weighted, bound = at[order], terms[order], weighted[order], bound[order]
        # what the coordinates from each place on can add at most
        rest = np.append(np.cumsum(bound[::-1])[::-1], 0)
        focus = int(np.searchsorted(-rest, -least, side="right"))  # rest[focus] < least
        focus = min(focus, len(terms))
        partial = np.zeros(len(self.docs), np.int64)
        for i in range(focus):
            a, b = self.first[at[i]], self.first[at[i] + 1]
            partial[self.row[a:b]] += self.impacts[a:b] * weighted[i]
        rows = np.flatnonzero((partial > 0) & (partial + rest[focus] >= least))
        if not len(rows):
            return none
        scores = partial[rows]
        if focus < len(terms):
            # and by Cauchy-Schwarz over the other coordinates of the item
            other = math.sqrt(float((weighted[focus:].astype(float) ** 2 / self.weight[terms[focus:]]).sum()))
            rows = rows[(scores + other * self.lengths[rows]) * slack >= least]
            scores = self.scores(rows, terms, weighted)
        good = scores >= least
        return rows[good], scores[good]

def _buckets(batches: Iterator[pa.RecordBatch], weight: np.ndarray, postings: int) -> Iterator[Bucket]:
    waiting, held = [], 0

    def made() -> Bucket:
        columns = [[] for _ in range(6)]
        start = 0
        for b in waiting:
            sizes = np.diff(b.column(3).offsets.to_numpy())
            parts = (
                b.column(0).to_numpy(), b.column(1).to_pylist(), b.column(2).to_numpy(),
                np.repeat(np.arange(start, start + b.num_rows), sizes),
                b.column(3).flatten().to_numpy(), b.column(4).flatten().to_numpy(),
            )
            start += b.num_rows
            for column, part in zip(columns, parts, strict=True):
                column.append(part)
        docs, ids, lengths, row, terms, impacts = columns
        return Bucket(
            np.concatenate(docs), [x for part in ids for x in part], np.concatenate(lengths), np.concatenate(row),
            np.concatenate(terms), np.concatenate(impacts), weight,
        )

    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            piece = batch.slice(start, 1024)
            waiting.append(piece)
            held += len(piece.column(3).flatten())
            if held >= postings:
                yield made()
                waiting, held = [], 0
    if waiting:
        yield made()


def _later(doc_id: int | None) -> tuple[bool, int]:
    return doc_id is None, doc_id or 0


def _searched(shared, top: int, postings: int):
    """Tasks that search their buckets: the best ``top`` documents of each item."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, least = shared.value
        best: list[list[tuple]] = [[] for _ in items.keys]
        floor = list(least)
        for bucket in _buckets(batches, weights.weight, postings):
            for i, (terms, counts) in enumerate(zip(items.terms, items.counts, strict=True)):
                useful = weights.weight[terms] > 0
                terms, weighted = terms[useful], weights.weight[terms[useful]] * counts[useful]
                length = math.sqrt(float((weighted.astype(float) * counts[useful]).sum()))
                rows, scores = bucket.search(terms, weighted, length, floor[i])
                if len(rows) > 4 * top:  # ties of the last score stay
                    cut = np.partition(scores, len(scores) - top)[len(scores) - top]
                    rows, scores = rows[scores >= cut], scores[scores >= cut]
                found = [(-s, _later(bucket.ids[r]), int(bucket.docs[r])) for r, s in zip(rows.tolist(), scores.tolist(), strict=True)]
                best[i] = sorted(best[i] + found)[:top]
                if len(best[i]) == top:
                    floor[i] = max(floor[i], -best[i][-1][0])
        rows = [(i, doc, None if no else doc_id, -s) for i, found in enumerate(best) for s, (no, doc_id), doc in found]
        if rows:
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=FOUND.replace(" bigint", "").split(", "))

    return search


FOUND = "item, doc, doc_id, score"
FOUND_SCHEMA = "item bigint, doc bigint, doc_id bigint, score bigint"


def _best(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "doc")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _longest(vectors: DataFrame, documents: int, head: int) -> DataFrame:
    """About ``head`` of the longest vectors (at least a ten-thousandth), left where they are."""
    share = min(1.0, max(head / max(documents, 1), 1e-4))
    least = vectors.agg(F.percentile_approx("length", 1 - share, 10_000)).first()[0]
    return vectors.where(F.col("length") >= (least or 0.0))


def _search_block(docs: DataFrame, rows: list[tuple[int, str | None]], top: int, postings: int, head: int) -> DataFrame:
    spark = docs.sparkSession
    sc, items = spark.sparkContext, Items.of(rows)
    vocabulary = sc.broadcast(items.vocabulary)
    schema = "doc bigint, doc_id bigint, n bigint, terms array<int>, tf array<bigint>"
    cut = materialized(docs.mapInArrow(_vectors(vocabulary), schema).where("n > 0"), "term-vectors")
    total = cut.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weight = np.zeros(max(len(items.vocabulary), 1), np.int64)
    frequencies = cut.select(F.explode("terms").alias("term")).groupBy("term").count()
    for r in frequencies.toLocalIterator():  # at most one row per term of the block
        weight[r["term"]] = math.floor(1000 * math.log((2 * total[0] + 2) / (2 * r["count"] + 1)))
    weights = Weights(weight, total[0], total[1])
    shared = sc.broadcast(weights)
    schema = "doc bigint, doc_id bigint, length double, terms array<int>, impacts array<bigint>"
    vectors = materialized(cut.mapInArrow(_weighted(shared), schema).where("size(terms) > 0"), "impact-vectors")

    first = sc.broadcast((items, weights, [1] * len(items.keys)))
    longest = _longest(vectors, total[0], head)
    seen = _best(longest.mapInArrow(_searched(first, top, postings), FOUND_SCHEMA), top)
    least = [1] * len(items.keys)
    for r in seen.where(F.col("rank") == top).select("item", "score").toLocalIterator():
        least[r["item"]] = r["score"]

    again = sc.broadcast((items, weights, least))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    by_length = vectors.repartitionByRange(parts, F.desc("length"), F.hash("doc")).sortWithinPartitions(F.desc("length"))
    found = by_length.mapInArrow(_searched(again, top, postings), FOUND_SCHEMA)
    return materialized(_best(found, top).select("item", "rank", "doc_id", "score"), "ranked")


def search(
    docs: DataFrame, items: DataFrame, top: int = TOP, block_characters: int = BLOCK_CHARACTERS,
    postings: int = BUCKET_POSTINGS, head: int = HEAD_DOCUMENTS,
) -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``top`` documents of every item with a score above 0.

    Every row of ``items`` is an item, rows with the same item_id included; every row of
    ``docs`` is a document.  Null and empty texts have no term: such documents do not count,
    such items have no rows.  Equal scores rank by ascending doc_id, null last.  Other columns
    are not read; empty tables give no rows.

    Items are read in blocks of about ``block_characters`` characters, so that what is broadcast is
    bounded by that number or by one item's text; each block reads all documents.
    """
    spark = docs.sparkSession
    numbered = items.select("item_id", F.col("text").cast("string").alias("text"))
    numbered = materialized(numbered.where("text <> ''").withColumn("item", F.monotonically_increasing_id()), "search-items")
    chosen = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    size = numbered.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_characters))
    ranked = spark.createDataFrame([], "key bigint, rank int, doc_id bigint, score bigint")
    for block in range(blocks):
        mine = numbered.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        rows = [(r.item, r.text) for r in mine.select("item", "text").toLocalIterator()]
        if rows:
            found = _search_block(chosen, rows, top, postings, head)
            keys = _keys(spark, [k for k, _ in rows])
            ranked = ranked.unionAll(found.join(F.broadcast(keys), "item").select("key", "rank", "doc_id", "score"))
    return ranked.join(numbered.select("item_id", F.col("item").alias("key")), "key").select(
        "item_id", "rank", "doc_id", "score"
    )


def _keys(spark: SparkSession, keys: list[int]) -> DataFrame:
    return spark.createDataFrame(
        pa.table({"item": pa.array(range(len(keys)), pa.int64()), "key": pa.array(keys, pa.int64())})
    )


ORACLE = r"""
WITH cut AS (
  SELECT row_number() OVER () AS doc, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL),
docs AS (SELECT doc, doc_id, terms, len(terms) AS n FROM cut WHERE len(terms) > 0),
total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_words FROM docs),
wanted AS (
  SELECT item, item_id, term, count(*) AS times FROM (
    SELECT item, item_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT row_number() OVER () AS item, item_id, text FROM benchmark))
  GROUP BY ALL),
postings AS (
  SELECT doc, doc_id, n, term, count(*) AS tf
  FROM (SELECT doc, doc_id, n, unnest(terms) AS term FROM docs)
  WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM postings, total GROUP BY term, n_docs),
impacts AS (
  SELECT doc, doc_id, term,
    (1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * n_docs) // n_words))) AS impact
  FROM postings, total),
scored AS (
  SELECT item, item_id, doc, doc_id, CAST(sum(times * w * impact) AS BIGINT) AS score
  FROM wanted JOIN weights USING (term) JOIN impacts USING (term) GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST, doc) AS rank
  FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
