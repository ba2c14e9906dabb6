"""Mixing sources to target weights by a low-discrepancy schedule.

Golden-ratio points fall into the cumulative target shares and so name the source of every
slot; a slot's rank among its source's slots names the block of ``B`` words it takes from
the source's shuffled stream of documents, which starts anew when it ends.  Counts of slots
differ from the exact shares by a few slots whatever their number, and every prefix of the
schedule is mixed as well as the whole.

All running sums have two levels: sums of bins of about ``BIN_ROWS`` rows, then rows inside
a bin.  A source with a third of all rows therefore spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.sources.files import materialized

WORD = r"[^\x20\x09-\x0D]+"
GOLDEN = 0.6180339887498949
BIN_ROWS = 20_000
SHARE_BINS = 1024


def block_words(total: int) -> int:
    """Words of a block: 1 to 1024, so that small mixes still have many slots."""
    return max(1, min(1024, total >> 18))


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Shuffle key of a row: an md5 of its id and text."""
    parts = [F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.md5(text), F.lit(""))]
    return F.md5(F.concat_ws("|", *parts))


def _sized(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", F.col("source").cast("string"), text.alias("text"))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    return materialized(rows.select("doc_id", "source", size.alias("size"), row_key().alias("key")), "sizes")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """(sid, source, source_size, weight, target, low, high) of every source.

    Sources in code point order, null last, get the weights in turn.  A target stops at
    ``most`` times its source's size; the rest goes to the others by weight.  In ascending
    order of cap / weight the first source that its fair share does not fill sets the level
    for all after it.  ``low`` and ``high`` bound its part of the unit interval.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*(F.lit(w) for w in weights))
    ranked = by_source.withColumn("sid", F.row_number().over(order)).withColumn(
        "weight", F.get(cycle, (F.col("sid") - 1) % len(weights))
    )
    every = Window.partitionBy()
    cap, weight = most * F.col("source_size"), F.col("weight")
    fill = Window.orderBy(cap / weight, "sid")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    capped = F.coalesce(F.sum(cap).over(before), F.lit(0))
    heavier = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    leveled = ranked.withColumn("total", F.sum("source_size").over(every)).withColumn(
        "level", (F.col("total") - capped) / heavier
    )
    open_ = F.when(cap > F.col("level") * weight, F.struct(cap / weight, "sid", "level"))
    chosen = F.min(open_).over(every)["level"]
    filled = leveled.withColumn("target", F.coalesce(F.least(cap.cast("double"), chosen * weight), F.lit(0.0)))
    share = F.coalesce(F.try_divide(F.col("target"), F.sum("target").over(every)), F.lit(0.0))
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    return filled.withColumn("share", share).select(
        "sid", "source", "source_size", "weight", "target",
        (F.sum("share").over(upto) - F.col("share")).alias("low"), F.sum("share").over(upto).alias("high"),
    )


def running(rows: DataFrame, group: str, bin_: str, order: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows of the group before each row."""
    sums = rows.groupBy(group, bin_).agg(F.sum(value).alias("__bin"))
    earlier = Window.partitionBy(group).orderBy(bin_).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(group, bin_, F.coalesce(F.sum("__bin").over(earlier), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(group, bin_).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("__in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return placed.join(sums, [group, bin_]).withColumn(name, F.col("__base") + F.col("__in")).drop("__base", "__in", bin_)


def _slots(spark, sources: DataFrame, count: int) -> DataFrame:
    """(sid, rank, slot): the source of every slot and the slot's rank among its source's."""
    point = ((F.col("slot") + 0.5) * GOLDEN) % 1
    points = spark.range(count).withColumnRenamed("id", "slot").withColumn("x", point)
    points = points.withColumn("cell", F.floor(F.col("x") * SHARE_BINS))
    last = F.least(F.floor(F.col("high") * SHARE_BINS), F.lit(SHARE_BINS))
    cells = sources.where("target > 0").select(
        "sid", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * SHARE_BINS), last)).alias("cell")
    )
    dealt = points.join(cells, "cell").where("x >= low and x < high").select("sid", "slot")
    dealt = dealt.withColumn("span", F.floor(F.col("slot") / BIN_ROWS))
    return running(materialized(dealt, "slots"), "sid", "span", ["slot"], F.lit(1), "rank")


def schedule(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3):
    """(sized documents, sources, pieces) of a mix as large as the documents together.

    Pieces are (slot, sid, doc_id, start, size, words, offset): ``words`` words from word
    ``offset`` of the document that starts at word ``start`` of its source's stream.  Rows
    with equal ids are separate documents.
    """
    spark = docs.sparkSession
    sized = _sized(docs)
    facts = sized.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("words"), F.count("*").alias("n")).first()
    block = block_words(facts.words)
    sources = materialized(targets(sized, weights, most), "sources")
    bins = -(-facts.n // BIN_ROWS) or 1
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint")
    rows = sized.join(sources.select("sid", "source", "source_size", "target"), sized.source.eqNullSafe(sources.source))
    rows = rows.drop(sources.source).withColumn("bin", F.floor(place * bins / 2.0**32))
    ordered = materialized(
        running(rows, "sid", "bin", ["key", "doc_id", "size"], F.col("size"), "start"), "streams"
    )
    slots = _slots(spark, sources, -(-facts.words // block))
    slots = slots.withColumn("begin", F.col("rank") * block)
    ends = slots.groupBy("sid").agg((F.max("begin") + block).alias("wanted"))
    occurrences = (
        ordered.where("size > 0")
        .join(ends, "sid")
        .withColumn("wanted", F.least("wanted", most * F.col("source_size")))
        .withColumn("round", F.explode(F.sequence(F.lit(0), F.ceil(F.col("wanted") / F.col("source_size")) - 1)))
        .withColumn("from", F.col("round") * F.col("source_size") + F.col("start"))
        .where("from < wanted")
        .withColumn("to", F.least(F.col("from") + F.col("size"), F.col("wanted")))
        .withColumn(
            "rank", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block)))
        )
    )
    pieces = occurrences.join(slots, ["sid", "rank"]).select(
        "slot", "sid", "doc_id", "start", "size",
        (F.least("to", F.col("begin") + block) - F.greatest("from", "begin")).alias("words"),
        (F.greatest("from", "begin") - F.col("from")).alias("offset"),
    )
    return ordered, sources, pieces


def mixed_sizes(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words, repeats counted) of every row.

    Null and empty texts have size 0 and are never taken; a null source is a source of its
    own; null and repeated ids are separate documents; other columns are not read.
    """
    ordered, _, pieces = schedule(docs, weights, most)
    taken = pieces.groupBy("sid", "start", "size").agg(F.sum("words").alias("taken"))
    return ordered.join(taken, ["sid", "start", "size"], "left").select(
        "doc_id", "source", "key", "size", "source_size", "target",
        F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"),
    )


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them.

    A document comes out once per time its words are taken in full; the one document of a
    source at which the mix stops counts from half of its words on.  Rows of the same id,
    text and source share their copies evenly, rounded.
    """
    names = docs.columns
    copies = F.when(F.col("size") > 0, F.col("taken") / F.col("size"))
    times = (
        mixed_sizes(docs, weights, most)
        .groupBy(F.col("key").alias("__key"), F.col("source").alias("__source"))
        .agg(F.round(F.sum(copies) / F.count("*")).cast("int").alias("__times"))
        .where("__times > 0")
    )
    keyed = docs.withColumn("__key_", row_key(text="text"))
    same = (keyed["__key_"] == times["__key"]) & docs["source"].cast("string").eqNullSafe(times["__source"])
    taken = keyed.join(times, same).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times"))))
    return taken.select(*(F.col(f"`{c}`") for c in names))


ORACLE = rf"""
WITH sized AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(md5(text), '')) AS key
  FROM documents),
ranked AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source ASC NULLS LAST) AS sid
  FROM sized GROUP BY source),
weighted AS (
  SELECT *, CASE (sid - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
         3 * source_size AS cap, sum(source_size) OVER () AS total FROM ranked),
leveled AS (
  SELECT *, (total - coalesce(sum(cap) OVER before, 0))::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighted
  WINDOW before AS (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
filled AS (
  SELECT *, coalesce(least(cap::DOUBLE, weight * (
    SELECT level FROM leveled WHERE cap > level * weight ORDER BY cap / weight, sid LIMIT 1)), 0) AS target
  FROM leveled),
cut AS (
  SELECT *, sum(share) OVER (ORDER BY sid) - share AS low, sum(share) OVER (ORDER BY sid) AS high
  FROM (SELECT *, target / sum(target) OVER () AS share FROM filled)),
size_of_block AS (
  SELECT greatest(1, least(1024, sum(size)::BIGINT >> 18)) AS block, sum(size)::BIGINT AS total FROM sized),
slots AS (
  SELECT block, ((k + 0.5::DOUBLE) * {GOLDEN}::DOUBLE) % 1 AS x
  FROM (SELECT block, unnest(range((total + block - 1) // block)) AS k FROM size_of_block)),
wanted AS (
  SELECT sid, least(count(*) * max(block), max(cap)) AS words
  FROM slots JOIN cut ON x >= low AND x < high GROUP BY sid),
streams AS (
  SELECT s.*, c.sid, c.source_size, c.target, coalesce(w.words, 0) AS words,
         sum(size) OVER (PARTITION BY c.sid ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start
  FROM sized s JOIN cut c ON s.source IS NOT DISTINCT FROM c.source LEFT JOIN wanted w USING (sid))
SELECT doc_id, source, key, size, source_size, target, (
  greatest(0, least(words, start + size) - start)
  + greatest(0, least(words, source_size + start + size) - source_size - start)
  + greatest(0, least(words, 2 * source_size + start + size) - 2 * source_size - start))::BIGINT AS taken
FROM streams
"""
