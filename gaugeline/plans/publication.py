"""Checks of a tree of text files before it is published."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline import fixed_values as V
from gaugeline.functions.text import forbidden_path, has_credential
from gaugeline.sources.files import materialized


def link_targets(text: Column, pattern: str = V.MARKDOWN_LINK_PATTERN) -> Column:
    """Distinct link destinations, decoded and without fragment; anchors and mail links drop out.

    ``+`` stands for itself; a destination with a broken escape stays as it is written.
    """
    raw = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    cut = F.transform(raw, lambda d: F.regexp_replace(F.regexp_replace(d, "^<+|>+$", ""), "#.*$", ""))
    bare = F.transform(
        cut, lambda d: F.coalesce(F.try_url_decode(F.replace(d, F.lit("+"), F.lit("%2B"))), d)
    )
    return F.array_distinct(F.filter(bare, lambda d: (d != "") & ~d.startswith("mailto:")))


def is_external(target: Column) -> Column:
    return target.rlike(r"^[a-zA-Z]+://")


def dangling_links(pages: DataFrame, key: str, links: Column, known: DataFrame) -> DataFrame:
    """(key, target) of links to a target outside ``known(target)``.

    Each target is looked up once however many pages link to it; only the dangling ones
    meet the links again, and there a popular one is an inner join that Spark can split.
    """
    listed = pages.select(key, F.explode(links).alias("target"))
    missing = listed.select("target").distinct().join(known.select("target").distinct(), "target", "left_anti")
    return listed.join(missing, "target").select(key, "target")


def resolved(target: Column, page: Column) -> Column:
    """A link's path from the root of the tree, for a link written on ``page``.

    A leading slash means the root; ``.`` and ``..`` are followed; a path that leaves the
    tree keeps its leading ``..``.
    """
    folder = F.regexp_replace(page, "[^/]*$", "")
    whole = F.when(target.startswith("/"), target).otherwise(F.concat(folder, target))
    steps = F.filter(F.split(whole, "/"), lambda s: (s != "") & (s != "."))
    none = F.array().cast("array<string>")
    climbed = F.aggregate(
        steps, none,
        lambda path, s: F.when(
            (s == "..") & (F.size(path) > 0) & (F.element_at(path, -1) != ".."),
            F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0))),
        ).otherwise(F.concat(path, F.array(s))),
    )
    return F.array_join(climbed, "/")


def link_problems(pages: DataFrame, page: str, links: Column, known: DataFrame) -> DataFrame:
    """(page, target, path, status) of local links that lead nowhere or to an untracked file.

    ``known(path, tracked)`` holds every file and folder of the tree once.  A link that leaves
    the tree is missing; links to other hosts are not looked at.  Each path is looked up once
    however many pages link to it.
    """
    listed = pages.select(F.col(page).alias("page"), F.explode(links).alias("target")).filter(~is_external(F.col("target")))
    listed = listed.withColumn("path", resolved(F.col("target"), F.col("page")))
    looked_up = listed.select("path").distinct().join(known, "path", "left")
    status = F.when(F.col("tracked").isNull() | F.col("path").startswith(".."), "missing").when(~F.col("tracked"), "untracked")
    problems = looked_up.select("path", status.alias("status")).filter(F.col("status").isNotNull())
    return listed.join(problems, "path").select("page", "target", "path", "status")


def usable_secrets(settings_table: DataFrame) -> DataFrame:
    """(name, value) entries whose name marks a secret and whose value is long enough."""
    named = F.upper("name").rlike("|".join(V.SECRET_NAME_WORDS))
    return settings_table.filter(named & (F.length("value") >= V.SECRET_MIN_LENGTH))


#: Bytes of a gram; shorter values are a gram of their own length.
GRAM_BYTES = 8
#: Rows of gram tables that are broadcast; larger ones meet the texts' grams in a shuffle.
BROADCAST_GRAMS = 500_000
#: A gram with more than this share of all looked-up occurrences is dealt to several tasks.
HOT_SHARE = 1 / 1000


def _hash(width: int | Column, gram: Column) -> Column:
    return F.xxhash64(F.lit(width) if isinstance(width, int) else width, gram)


def _text_grams(source: DataFrame, widths: list[int]) -> DataFrame:
    """(k, pos, h): every byte gram of the texts; cut in the scan's own stage, texts are not copied."""
    parts = []
    for width in widths:
        long = source.filter(F.octet_length("t") >= width)
        places = long.select("k", "t", F.explode(F.sequence(F.lit(1), F.octet_length("t") - (width - 1))).alias("pos"))
        parts.append(places.select("k", "pos", _hash(width, F.substr("t", F.col("pos"), F.lit(width))).alias("h")))
    return reduce(DataFrame.unionAll, parts)


def _dealt(grams: DataFrame, table: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Grams joined with ``table`` on h; grams named in ``hot(h, salts)`` go to several tasks."""
    if hot is None:
        return grams.join(F.broadcast(table), "h")
    salts = F.coalesce("salts", F.lit(1))
    left = grams.join(F.broadcast(hot), "h", "left")
    left = left.withColumn("salt", F.pmod(F.xxhash64("k", "pos"), salts)).drop("salts")
    right = table.join(F.broadcast(hot), "h", "left")
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1))).drop("salts")
    return left.join(right, ["h", "salt"]).drop("salt")


def known_secret_hits(
    files: DataFrame, key: str, text: str, secrets: DataFrame, name: str, value: str,
    broadcast_grams: int = BROADCAST_GRAMS,
) -> DataFrame:
    """(key, name) for every secret value that occurs in a text.

    An index of rare grams: the occurrences of the values' byte grams in all texts are
    counted, and each value is then sought by its rarest gram only.  A value with a gram that
    occurs nowhere is in no text.  Texts that hold a value's rarest gram are tested for the
    whole value.  UTF-8 lets bytes be compared in place of characters.
    """
    kept = secrets.select(F.col(name).alias("n"), F.col(value).alias("v")).filter(F.length("v") > 0).distinct()
    kept = materialized(kept, "known-values")
    size = F.octet_length("v")
    width = F.least(size, F.lit(GRAM_BYTES))
    wanted = kept.select("v").distinct().select("v", size.alias("size"), width.alias("width"))
    places = wanted.select("v", "width", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("width") + 1)).alias("pos"))
    gram = F.substr(F.col("v").cast("binary"), F.col("pos"), F.col("width"))
    grams = materialized(places.select("v", _hash(F.col("width"), gram).alias("h")).distinct(), "value-grams")
    widths = sorted(r["width"] for r in wanted.select("width").distinct().collect())  # GRAM_BYTES numbers at most
    if not widths:
        widths = [GRAM_BYTES]
    source = files.select(F.col(key).alias("k"), F.col(text).alias("t")).filter(F.col("t").isNotNull())
    found = _text_grams(source.withColumn("t", F.col("t").cast("binary")), widths)

    listed = grams.select("h").distinct()
    small = grams.count() <= broadcast_grams
    met = found.join(F.broadcast(listed) if small else listed, "h", "left_semi")
    counts = materialized(met.groupBy("h").agg(F.count("*").alias("n")), "gram-counts")
    rare = grams.join(counts, "h", "left").groupBy("v").agg(
        F.count_if(F.col("n").isNull()).alias("absent"), F.min(F.struct("n", "h")).alias("rarest")
    )
    anchors = rare.filter("absent = 0").select("v", F.col("rarest.h").alias("h"), F.col("rarest.n").alias("n"))
    anchors = materialized(anchors, "anchors")
    hot = None
    if not small:
        total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        share = max(1.0, total * HOT_SHARE)
        # at most 1 / HOT_SHARE grams can have that many occurrences
        hot = anchors.filter(F.col("n") > share).select("h", F.ceil(F.col("n") / share).cast("bigint").alias("salts")).distinct()
    pairs = materialized(_dealt(found, anchors.select("h", "v"), hot).select("k", "v").distinct(), "gram-hits")
    hits = source.join(pairs.withColumnRenamed("k", "k2"), F.col("k").eqNullSafe(F.col("k2")))
    hits = hits.filter(F.contains("t", F.col("v"))).select("k", "v").join(kept, "v")
    return hits.select(F.col("k").alias(key), F.col("n").alias(name))


def file_problems(files: DataFrame) -> DataFrame:
    """(path, problem) for files that must not be published; ``files(path, text)``."""
    local = files.filter(forbidden_path(F.col("path"))).select(
        "path", F.lit("Local-only file is tracked").alias("problem")
    )
    shaped = files.filter(has_credential(F.col("text"))).select(
        "path", F.lit("Credential-shaped value occurs").alias("problem")
    )
    return local.unionByName(shaped)
