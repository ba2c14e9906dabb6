"""Records of quoted, multi-line CSV files, read by many tasks however large a file is.

A task that starts in the middle of a file cannot know whether it stands inside quotes.  So
every physical line is read as a function from "inside or outside before it" to "inside or
outside after it".  The functions of a block are composed where the block is read; a prefix
over one small row per block gives the state at each block's start, a running sum inside the
block gives the state at each line, and lines are stitched to records.  Records are numbered
by counts per block, their offsets and the place inside the block.  All of it is built-in
expressions; a file is scanned twice and its text shuffled once.

A line that breaks the quoting rules ends its record as an error, and reading goes on with
the next line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeline import fixed_values as V
from gaugeline.functions.text import windows_text
from gaugeline.sources.files import materialized

#: Characters of a record; the rest of a longer one (such as a file whose quote is never
#: closed) is not gathered and the record is an error.
MAX_RECORD_CHARACTERS = 1 << 26
#: Rows of the table of blocks that are broadcast; more are joined by a shuffle.
BROADCAST_BLOCKS = 200_000

# States of a reader: 0 at the start of a field, 1 in a plain field, 2 inside quotes,
# 3 after a quote inside quotes, 4 a character after a closing quote (an error).
_AFTER_QUOTE = "CASE {s} WHEN 0 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 2 ELSE {s} END"
_AFTER_TEXT = (
    "CASE WHEN {t} = '' OR {s} = 2 OR {s} = 4 THEN {s} WHEN {s} = 3 AND NOT startswith({t}, ',') THEN 4 "
    "WHEN endswith({t}, ',') THEN 0 ELSE 1 END"
)


def _text_step(state: str, text: str) -> str:
    return _AFTER_TEXT.format(s=f"({state})", t=text)


def _end_state(parts: str, start: int) -> str:
    """SQL: the state after the parts between the quotes of a text."""
    step = _text_step(_AFTER_QUOTE.format(s="s"), "t")
    first = _text_step(str(start), f"{parts}[0]")
    return f"aggregate(slice({parts}, 2, size({parts})), {first}, (s, t) -> {step})"


def _segments(spark: SparkSession, files: list[str], windows: list[str]) -> DataFrame:
    """(file, block, place, pos, text, sep, outside, inside): lines, also cut at carriage returns.

    ``outside`` and ``inside`` tell whether the reader is inside quotes after the segment when
    it was outside, or inside, before.
    """
    raw = spark.read.option("lineSep", "\n").text(files).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
    )
    value = F.col("value")
    if windows:
        value = F.when(F.col("file").isin(windows), windows_text(value)).otherwise(value)
    pieces = raw.select("file", "block", "place", F.split(value, "\r", -1).alias("pieces"))
    cut = pieces.select("file", "block", "place", F.size("pieces").alias("n"), F.posexplode("pieces").alias("pos", "text"))
    quoted = F.col("text").contains('"')
    cut = cut.withColumn("parts", F.when(quoted, F.split("text", '"', -1)))
    for name, start, same in (("outside", 0, 0), ("inside", 2, 1)):
        end = F.expr(f"CASE WHEN {_end_state('parts', start)} = 2 THEN 1 ELSE 0 END")
        cut = cut.withColumn(name, F.when(quoted, end).otherwise(same))
    sep = F.when(F.col("pos") < F.col("n") - 1, F.lit("\r")).otherwise(F.lit("\n"))
    return cut.select("file", "block", "place", "pos", "text", sep.alias("sep"), "outside", "inside")


def _state_before(start: Column, window: Window) -> tuple[Column, Column]:
    """(swaps before, state before) of rows with functions ``outside`` and ``inside``.

    A function either fixes the state or keeps or swaps it, so the state is that of the last
    row that fixed it (or ``start``), swapped as often as rows since then have swapped it.
    """
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.col("outside") == F.col("inside")
    swaps = F.coalesce(F.sum((F.col("outside") > F.col("inside")).cast("bigint")).over(before), F.lit(0))
    last = F.last(F.when(fixed, F.struct(F.col("outside").alias("state"), F.col("swaps"))), ignorenulls=True).over(before)
    base = F.coalesce(last["state"], start) + F.col("swaps") - F.coalesce(last["swaps"], F.lit(0))
    return swaps, (base % 2).cast("int")


def block_states(segments: DataFrame) -> DataFrame:
    """(file, block, start, end): whether a block starts and ends inside quotes; a row per block."""
    changes = F.when(
        (F.col("outside") != 0) | (F.col("inside") != 1), F.struct("place", "pos", "outside", "inside")
    )
    composed = F.expr(
        "aggregate(array_sort(changes), named_struct('o', 0, 'i', 1), (a, x) -> named_struct("
        "'o', IF(a.o = 0, x.outside, x.inside), 'i', IF(a.i = 0, x.outside, x.inside)))"
    )
    blocks = segments.groupBy("file", "block").agg(F.collect_list(changes).alias("changes"))
    blocks = blocks.select("file", "block", composed.alias("f")).select(
        "file", "block", F.col("f.o").alias("outside"), F.col("f.i").alias("inside")
    )
    swaps, state = _state_before(F.lit(0), Window.partitionBy("file").orderBy("block"))
    blocks = blocks.withColumn("swaps", swaps).withColumn("start", state)
    end = F.when(F.col("start") == 0, F.col("outside")).otherwise(F.col("inside"))
    return blocks.select("file", "block", "start", end.alias("end"))


def _block_records(segments: DataFrame, blocks: DataFrame, most: int) -> DataFrame:
    """(file, block, rec, raw, size): the parts of records that lie in a block; 0 continues an earlier block's."""
    joined = segments.join(blocks.select("file", "block", "start"), ["file", "block"])
    order = Window.partitionBy("file", "block").orderBy("place", "pos")
    swaps, state = _state_before(F.col("start"), order)
    lined = joined.withColumn("swaps", swaps).withColumn("state", state)
    opens = (F.col("state") == 0) & (F.col("text") != "")
    lined = lined.withColumn("opens", opens.cast("bigint")).withColumn("length", F.length("text") + 1)
    lined = lined.select(
        "file", "block", "place", "pos", "text", "sep", "state", "opens", "length",
        F.sum("opens").over(order).alias("rec"), F.sum("length").over(order).alias("until"),
    )
    begun = F.last(F.when(F.col("opens") == 1, F.col("until") - F.col("length")), ignorenulls=True).over(order)
    lined = lined.withColumn("size", F.col("until") - F.coalesce(begun, F.lit(0)))
    # blank lines outside of quotes belong to no record
    kept = lined.where((F.col("state") == 1) | (F.col("text") != ""))
    line = F.when(F.col("size") <= most, F.concat("text", "sep")).otherwise(F.lit(""))
    grouped = kept.groupBy("file", "block", "rec").agg(
        F.array_sort(F.collect_list(F.struct("place", "pos", line.alias("line")))).alias("lines"),
        F.max("size").alias("size"),
    )
    return grouped.select(
        "file", "block", "rec", F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("raw"), "size"
    )


def _stitched(pieces: DataFrame, most: int) -> DataFrame:
    """(file, record, raw, size): whole records, numbered through each file from 1."""
    counts = pieces.groupBy("file", "block").agg(F.max("rec").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    if counts.count() <= BROADCAST_BLOCKS:
        counts = F.broadcast(counts)
    numbered = pieces.join(counts, ["file", "block"]).withColumn("record", F.col("offset") + F.col("rec"))
    edge = (F.col("rec") == 0) | (F.col("rec") == F.col("n"))
    whole = numbered.where(~edge).select("file", "record", "raw", "size")
    # at most two parts a block: the record it starts in and the one it ends in
    running = Window.partitionBy("file", "record").orderBy("block")
    edges = numbered.where(edge).withColumn("total", F.sum("size").over(running))
    part = F.struct("block", F.when(F.col("total") <= most, F.col("raw")).otherwise(F.lit("")).alias("raw"))
    edges = edges.groupBy("file", "record").agg(
        F.array_sort(F.collect_list(part)).alias("parts"), F.sum("size").alias("size")
    )
    raw = F.array_join(F.transform("parts", lambda x: x["raw"]), "")
    return whole.unionByName(edges.select("file", "record", raw.alias("raw"), "size"))


_STATE = _AFTER_QUOTE.format(s="a.s")
#: The fold over ``parts``, what is between the quotes of a record, that tells whether a
#: quote stands in a plain field, where it is a character like others.
_STRAY = (
    f"aggregate(slice(parts, 2, size(parts)), named_struct('s', {_text_step('0', 'parts[0]')}, 'stray', false), "
    f"(a, t) -> named_struct('s', {_text_step(_STATE, 't')}, 'stray', a.stray OR a.s = 1), a -> a.stray)"
)
#: Commas outside of quotes as marks to split at: without quotes in plain fields, every second
#: part stands outside of quotes; otherwise a fold knows the state of each part.
_EVEN = "transform(parts, (t, i) -> IF(i % 2 = 0, replace(t, ',', char(0)), t))"
_GENERAL = (
    f"aggregate(slice(parts, 2, size(parts)), named_struct('s', {_text_step('0', 'parts[0]')}, "
    "'out', array(replace(parts[0], ',', char(0)))), "
    f"(a, t) -> named_struct('s', {_text_step(_STATE, 't')}, "
    f"'out', concat(a.out, array(IF(({_STATE}) = 2, t, replace(t, ',', char(0)))))), a -> a.out)"
)
_FIELDS = (
    f"transform(split(array_join(IF(stray, {_GENERAL}, {_EVEN}), '\"'), char(0), -1), x -> "
    "IF(startswith(x, '\"'), replace(substring(x, 2, length(x) - 2), '\"\"', '\"'), x))"
)


def parse_records(
    spark: SparkSession, files: list[str], windows: list[str] = (), most: int = MAX_RECORD_CHARACTERS
) -> DataFrame:
    """(file, record, raw, fields, error) of every record of files in UTF-8 or Windows-1252.

    ``files`` and ``windows`` (those of them in Windows-1252) are paths as a scan's metadata
    shows them.  Records count from 1, the header, without blank lines.  A record with an
    error has no fields: text after a closing quote, quotes open at the file's end, more than
    ``most`` characters, or a cell above the cell limit.
    """
    segments = _segments(spark, files, list(windows))
    blocks = materialized(block_states(segments), "csv-blocks")
    small = F.broadcast(blocks) if blocks.count() <= BROADCAST_BLOCKS else blocks
    pieces = materialized(_block_records(segments, small, most), "csv-pieces")
    # the last character is the separator that ended the record
    records = _stitched(pieces, most).withColumn("raw", F.expr("left(raw, length(raw) - 1)"))
    quoted = F.col("raw").contains('"')
    records = records.withColumn("parts", F.when(quoted, F.split("raw", '"', -1)))
    records = records.withColumn("state", F.when(quoted, F.expr(_end_state("parts", 0))).otherwise(0))
    records = records.withColumn("stray", F.when(quoted, F.expr(_STRAY)).otherwise(False))
    error = (
        F.when(F.col("size") > most, F.lit(f"a record has more than {most:,} characters"))
        .when(F.col("state") == 4, F.lit("a comma was expected after a closing quote"))
        .when(F.col("state") == 2, F.lit("unexpected end of data inside quotes"))
    )
    records = records.withColumn("error", error)
    fields = F.when(quoted, F.expr(_FIELDS)).otherwise(F.split("raw", ",", -1))
    records = records.withColumn("fields", F.when(F.col("error").isNull(), fields))
    long = F.exists("fields", lambda x: F.length(x) > V.MAX_CELL_BYTES)
    records = records.withColumn("error", F.when(long, F.lit("a cell is too large")).otherwise(F.col("error")))
    return records.select(
        "file", "record", "raw", F.when(F.col("error").isNull(), F.col("fields")).alias("fields"), "error"
    )
