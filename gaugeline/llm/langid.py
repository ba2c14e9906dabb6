"""Language identification: multinomial naive Bayes over hashed character n-grams.

One pass counts n-grams by language with a count matrix per task and sums the matrices in
Spark; the log-probability matrix has ``languages x 2**bits`` entries whatever the input
size, at most ``CELLS`` as more languages share fewer buckets, and is broadcast.  A second pass scores whole texts
in sparse batches: per document the hashed n-grams gather rows of the matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.ngrams import SPACE, buckets, folded
from gaugeline.llm.worker_memory import remember_for

UNDETERMINED = "und"
SIZES = (1, 2, 3)
BITS = 15
#: Entries of the matrix, and languages at most (more than ISO 639 lists).
CELLS, MAX_LANGUAGES = 1 << 21, 8192


@dataclass(frozen=True)
class Model:
    """Learned languages and ``log P(n-gram | language)`` with one row per bucket."""

    languages: tuple[str, ...]
    prior: np.ndarray
    weights: np.ndarray
    sizes: tuple[int, ...] = SIZES
    bits: int = BITS


def _counter(sizes: tuple[int, ...], bits: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember_for("language ID", lambda: None)
        totals: dict[str, np.ndarray] = {}
        documents: dict[str, int] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                lang = lang.as_py()
                if lang not in totals:
                    totals[lang] = np.zeros(1 << bits, np.int64)
                    documents[lang] = 0
                documents[lang] += 1
                for h in buckets(folded(text.as_py() or ""), sizes, bits):
                    totals[lang] += np.bincount(h, minlength=1 << bits)
        for lang, counts in totals.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * (len(used) + 1), pa.string()),
                    pa.array(np.append(used, -1), pa.int32()),
                    pa.array(np.append(counts[used], documents[lang]), pa.int64()),
                ],
                names=["lang", "bucket", "n"],
            )

    return count


def fit(
    examples: DataFrame, text: str = "text", lang: str = "lang", sizes: tuple[int, ...] = SIZES,
    bits: int = BITS, smoothing: float = 0.5, max_languages: int = MAX_LANGUAGES,
) -> Model:
    """Learn from every row with a language; a null text adds to the prior only.

    Without examples the model knows no language and predicts ``und`` everywhere.  From 65
    languages on, n-grams are hashed to fewer bits, so that the matrix stays within ``CELLS``.
    More than ``max_languages`` values are no list of languages and raise.
    """
    rows = examples.where(F.col(lang).isNotNull()).select(
        F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")
    )
    languages = rows.select("lang").distinct().limit(max_languages + 1).count()
    if languages > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    bits = min(bits, (CELLS // max(languages, 1)).bit_length() - 1)
    table = (
        rows.mapInArrow(_counter(sizes, bits), "lang string, bucket int, n bigint")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    names = sorted(set(table["lang"].to_pylist()))
    place = {name: i for i, name in enumerate(names)}
    column = np.array([place[x] for x in table["lang"].to_pylist()], np.int64)
    bucket = table["bucket"].to_numpy().astype(np.int64)
    n = table["n"].to_numpy()
    documents = np.zeros(len(names))
    counts = np.full((1 << bits, len(names)), smoothing)
    head = bucket < 0
    documents[column[head]] = n[head]
    counts[bucket[~head], column[~head]] += n[~head]
    weights = np.log(counts) - np.log(counts.sum(axis=0, keepdims=True))
    prior = np.log((documents + 1) / (documents.sum() + len(names))) if names else documents
    return Model(tuple(names), prior, weights.astype(np.float32), sizes, bits)


def posterior(model: Model, text: str | None) -> tuple[str, float]:
    """Most probable language of one text and its posterior; ties go to the first name."""
    codes = folded(text or "")
    if not model.languages or not (codes != SPACE).any():
        return UNDETERMINED, 0.0
    logs = model.prior.copy()
    for h in buckets(codes, model.sizes, model.bits):
        logs += model.weights[h].sum(axis=0, dtype=np.float64)
    best = int(logs.argmax())
    return model.languages[best], float(1 / np.exp(logs - logs[best]).sum())


def predict(docs: DataFrame, model: Model, *carry: Column, text: str = "text") -> DataFrame:
    """``carry`` columns of every row with ``lang_pred`` and ``score`` (0 to 1).

    Null, empty and letterless texts give ``und`` with score 0.  Rows are scored one by
    one, so repeated rows and null ids need no rule; other columns are not read.
    """
    kept = docs.select(*carry, F.col(text).cast("string").alias("__text"))
    names = kept.columns[:-1]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            found = [posterior(known, x.as_py()) for x in batch.column(len(names))]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in range(len(names))),
                    pa.array([x[0] for x in found], pa.string()),
                    pa.array([x[1] for x in found], pa.float64()),
                ],
                names=[*names, "lang_pred", "score"],
            )

    schema = kept.drop("__text").schema.add("lang_pred", "string").add("score", "double")
    return kept.mapInArrow(score, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fifth of the ids that is never learned from; so are null ids."""
    remainder = F.crc32(F.col(doc_id).cast("string")) % 5
    return F.coalesce(remainder == 0, F.lit(True))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document (see ``predict``)."""
    model = fit(docs.where(~held_out()))
    return predict(docs, model, F.col("doc_id"), held_out().alias("held_out"))


def keep_identified(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """The documents with a language: neither ``und`` nor below ``min_score``.

    Rows and columns stay as they are, whatever their names; ``doc_id`` may be null or
    repeated.
    """
    model = fit(docs.where(~held_out()))
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    scored = predict(docs, model, whole)
    return scored.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= min_score)).select("row.*")
