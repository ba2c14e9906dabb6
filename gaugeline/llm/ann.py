"""Nearest neighbours by inner product: inverted lists with an adaptive dimension scan.

The index is fitted on a bounded sample: k-means centres, and the number of lists to probe,
chosen so that the sample's own neighbours are found with ``RECALL``.  Every vector goes to
its list; a query whose lists hold too few vectors goes on to its next ones.  Vectors and queries are turned by one random rotation; inside a list, products
are summed block of columns by block of columns, and after each block a bound that always
holds (the rest of a product is at most the product of the rest norms) abandons pairs that
cannot reach the query's twentieth best, so a list gives exactly its best.  Survivors are
scored in double precision on the original vectors.

A list is cut into pieces of at most ``PIECE`` vectors and its queries into groups of at
most ``PIECE``, so a task never holds a whole list; each pair of pieces returns at most k
rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.sources.files import materialized

SAMPLE, SAMPLE_QUERIES = 20_000, 400
MAX_LISTS, PIECE, COLUMNS = 1024, 4096, 16
RECALL = 0.97
#: Share of a block's pairs below which the rest is read pair by pair.
FEW = 0.05
#: Rounding of a product, as a share of the norms.
ROUNDING = 1e-12


@dataclass(frozen=True)
class Index:
    centers: np.ndarray
    rotation: np.ndarray
    probes: int
    dims: int
    #: Vectors in every list, once they are placed.
    sizes: np.ndarray | None = None


def usable(vector: Column) -> Column:
    """True for vectors with components, all finite and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """At most k centres, all different and each nearest to some row of ``x``."""
    different = np.sort(np.unique(x, axis=0, return_index=True)[1])
    centers = x[different[rng.permutation(len(different))[:k]]].copy()
    k = len(centers)
    for _ in range(rounds):
        near = _lists(x, centers)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centers[n > 0] = sums[n > 0] / n[n > 0, None]
    return centers[np.unique(_lists(x, centers))]


def _lists(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return (x @ centers.T - 0.5 * (centers * centers).sum(axis=1)).argmax(axis=1)


def fit(vectors: DataFrame, k: int, sample: int = SAMPLE, seed: int = 7) -> Index | None:
    """Centres, rotation and number of probed lists from at most ``sample`` vectors.

    ``vectors`` is (id, v) with usable vectors; the sample is the rows with the smallest
    hash of their id.  None without vectors.
    """
    chosen = vectors.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow()["v"]
    if not len(chosen):
        return None
    x = np.array(chosen.to_pylist(), np.float64)
    rng = np.random.default_rng(seed)
    dims = x.shape[1]
    rotation = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
    lists = int(min(MAX_LISTS, max(1, round(len(x) ** 0.5 / 2))))
    centers = _kmeans(x, lists, rng)
    lists = len(centers)
    home = _lists(x, centers)
    queries = x[: SAMPLE_QUERIES]
    scores = queries @ x.T
    scores[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
    top = np.argsort(-scores, axis=1)[:, : min(k, max(1, len(x) - 1))]
    ranks = np.argsort(np.argsort(-(queries @ centers.T), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(ranks, home[top], axis=1).ravel())
    probes = int(needed[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))))]) + 1
    return Index(centers, rotation, min(probes, lists), dims)


def probed(x: np.ndarray, index: Index, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of x, list) of the lists that every query reads.

    These are its first ``probes``, and further ones until they hold k vectors besides its
    own.
    """
    near = np.argsort(-(x @ index.centers.T), axis=1, kind="stable")
    enough = (index.sizes[near].cumsum(axis=1) <= k).sum(axis=1) + 1
    rows, place = np.nonzero(np.arange(near.shape[1]) < np.maximum(index.probes, enough)[:, None])
    return rows, near[rows, place]


def _assigner(shared, k: int | None = None):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.array(batch.column(1).to_pylist(), np.float64).reshape(len(ids), index.dims)
            if k is not None:
                rows, near = probed(x, index, k)
            else:
                near, rows = _lists(x, index.centers), np.arange(len(ids))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(near.astype(np.int32)), pa.array(ids[rows], pa.int64()),
                    batch.column(1).take(pa.array(rows)),
                ],
                names=["list", "id", "v"],
            )

    return assign


def scan(
    queries: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, rotation: np.ndarray, k: int,
    columns: int = COLUMNS,
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the ids and scores of the k best vectors, without the query's own.

    Thresholds come from full products with the first vectors; every further block of
    columns is only read for pairs that can still reach them, as whole matrices while these
    are many.
    """
    turned, turned_queries = x @ rotation, queries @ rotation
    dims, n = x.shape[1], len(x)
    start = min(n, max(4 * k, 64))
    own = query_ids[:, None] == ids[None, :]
    head = np.where(own[:, :start], -np.inf, turned_queries @ turned[:start].T)
    level = np.partition(head, start - k, axis=1)[:, start - k] if start >= k else np.full(len(queries), -np.inf)
    rest_x = np.sqrt((turned[:, ::-1] ** 2).cumsum(axis=1)[:, ::-1])
    rest_q = np.sqrt((turned_queries[:, ::-1] ** 2).cumsum(axis=1)[:, ::-1])
    close = ROUNDING * dims * rest_q[:, 0] * rest_x[:, 0].max(initial=0)
    level = level - close
    partial, alive, stop = np.zeros((len(queries), n)), ~own, 0
    while stop < dims and alive.sum() > FEW * alive.size:
        at, stop = stop, min(stop + columns, dims)
        partial += turned_queries[:, at:stop] @ turned[:, at:stop].T
        rest = rest_q[:, stop, None] * rest_x[None, :, stop] if stop < dims else 0
        alive &= partial + rest >= level[:, None]
    q, c = np.nonzero(alive)
    total = partial[q, c]
    for at in range(stop, dims, columns):
        stop = min(at + columns, dims)
        total = total + np.einsum("ij,ij->i", turned_queries[q, at:stop], turned[c, at:stop])
        rest = rest_q[q, stop] * rest_x[c, stop] if stop < dims else 0
        keep = total + rest >= level[q]
        q, c, total = q[keep], c[keep], total[keep]
    out = []
    bounds = np.searchsorted(q, np.arange(len(queries) + 1))
    for i in range(len(queries)):
        part, sums = c[bounds[i] : bounds[i + 1]], total[bounds[i] : bounds[i + 1]]
        if len(part) > k:  # with all ties, as rotation rounds the sums
            least = np.partition(sums, len(sums) - k)[len(sums) - k]
            part = part[sums >= least - 2 * close[i]]
        exact = (queries[i] * x[part]).sum(axis=1)
        order = np.lexsort((ids[part], -exact))[:k]
        out.append((ids[part][order], exact[order]))
    return out


def _scanner(shared, k: int):
    def work(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        rows = {"query_id": [], "vec_id": [], "score": []}
        if len(queries) and len(vectors):
            q, x = (np.array(t["v"].tolist(), np.float64) for t in (queries, vectors))
            qi, xi = queries["id"].to_numpy(), vectors["id"].to_numpy()
            for at in range(0, len(q), 256):
                found = scan(q[at : at + 256], qi[at : at + 256], x, xi, shared.value.rotation, k)
                for query, (ids, scores) in zip(qi[at : at + 256], found, strict=True):
                    rows["query_id"] += [query] * len(ids)
                    rows["vec_id"] += ids.tolist()
                    rows["score"] += scores.tolist()
        return pd.DataFrame(rows)

    return work


def neighbours(vectors: DataFrame, is_query: Column, k: int = 20, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every query row.

    ``vectors`` is (vec_id, embedding); ``is_query`` is a condition on ``id``, the vec_id.  Null,
    zero and non-finite vectors, null ids and vectors of another length than the commonest
    take no part.  Rows that repeat an id and a vector count once; an id with several
    vectors counts as its smallest one.  Ties go to the smaller vec_id.  Other columns are
    not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").cast("array<double>").alias("v")
    ).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    rows = rows.groupBy("id").agg(F.min("v").alias("v"))
    lengths = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c"))
    common = lengths.orderBy(F.desc("c"), "n").first()
    rows = materialized(rows.where(F.size("v") == (common.n if common else 0)), "vectors")
    index = fit(rows, k, sample)
    schema = "query_id bigint, vec_id bigint, score double"
    if index is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    shared = spark.sparkContext.broadcast(index)
    kinds = "list int, id bigint, v array<double>"
    placed = materialized(rows.mapInArrow(_assigner(shared), kinds), "lists")
    sizes = np.zeros(len(index.centers), np.int64)
    for r in placed.groupBy("list").count().collect():  # at most MAX_LISTS rows
        sizes[r["list"]] = r["count"]
    shared = spark.sparkContext.broadcast(replace(index, sizes=sizes))
    chosen = rows.where(F.coalesce(is_query, F.lit(False)))
    asked = materialized(chosen.mapInArrow(_assigner(shared, k), kinds), "probes")

    def pieces(of: DataFrame, name: str) -> DataFrame:
        """Number of pieces of every list: a small table, one row per list."""
        return of.groupBy("list").agg(F.ceil(F.count("*") / PIECE).cast("int").alias(name))

    cut = pieces(placed, "xs").join(pieces(asked, "qs"), "list")
    cut = F.broadcast(cut)  # at most MAX_LISTS rows

    def dealt(of: DataFrame, own: str, other: str) -> DataFrame:
        piece = F.pmod(F.xxhash64("id"), F.col(own)).cast("int").alias(own[0])
        every = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other[0])
        return of.join(cut, "list").select("list", "id", "v", piece, every).select("list", "x", "q", "id", "v")

    keys = ("list", "x", "q")
    found = (
        dealt(asked, "qs", "xs")
        .groupBy(*keys)
        .cogroup(dealt(placed, "xs", "qs").groupBy(*keys))
        .applyInPandas(_scanner(shared, k), schema)
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def search(embeddings: DataFrame) -> DataFrame:
    """The 20 nearest of every vector whose vec_id is divisible by 20."""
    return neighbours(embeddings, F.col("id") % 20 == 0)
