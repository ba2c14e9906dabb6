"""File-level facts: sizes, digests, encodings, and a shared folder for job outputs."""

from __future__ import annotations

import codecs
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gaugeline import fixed_values as V
from gaugeline.functions import sha256
from gaugeline.functions.text import UNDEFINED, normalized_digest, windows_text
from gaugeline.settings import DEFAULTS, Settings

# binaryFile keeps one file in one value, so digests of whole files stop here
MAX_WHOLE_FILE_BYTES = 2**31 - 1024


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh path under the checkpoint folder that the cluster names.

    Only local sessions without that setting fall back to a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="gaugeline-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


_made: list[str] = []


def work_mark() -> int:
    """A mark for :func:`take_work`: folders made from now on lie after it."""
    return len(_made)


def take_work(mark: int) -> list[str]:
    """The folders made since ``mark``; the caller drops them, :func:`drop_work` no longer does."""
    taken = _made[mark:]
    del _made[mark:]
    return taken


def drop_paths(spark: SparkSession, paths: list[str]) -> int:
    """Delete folders and empty the list; returns how many there were."""
    hadoop, n = spark._jvm.org.apache.hadoop.fs, 0
    while paths:
        path = hadoop.Path(paths.pop())
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def drop_work(spark: SparkSession) -> int:
    """Delete the folders that jobs of this process have written under the shared folder.

    To be called when no frame that reads them is needed any more; returns their number.
    """
    return drop_paths(spark, _made)


def materialized(df: DataFrame, label: str) -> DataFrame:
    """The same rows read back from a written table: later steps do not recompute them."""
    path = work_dir(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def binary_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, length, content); content is only read when a query uses it."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return reader.load(path)


#: Files above this size are digested in steps of about this many bytes, each by a task of its own.
STEP_BYTES = 128 * 2**20
BROADCAST_FILES = 100_000
# scans of text decompress files of these names, so they are read whole
PACKED_NAME = r"\.(gz|bz2|deflate|snappy|lz4|zst|lzo|lzo_deflate)$"
_CUT = "path string, length long, block long, place long, size long, data binary, step int"
_CHAIN = "path string, length long, part int, total long, seen long, state binary, sha256 string"


def file_digests(spark: SparkSession, path: str | list[str], line_feeds: bool = False) -> DataFrame:
    """(path, length, sha256) of whole files, optionally with CRLF read as LF.

    A file above ``STEP_BYTES`` is cut by the tasks of one scan; then step by step a task takes up
    the state that the step before has stored, see :func:`_chained_digests`.
    """
    content = F.col("content")
    if line_feeds:
        digest = normalized_digest(content.cast("string"))
    else:
        digest = F.sha2(content, 256)
    packed = F.col("_metadata.file_name").rlike(PACKED_NAME)
    large = (F.col("_metadata.file_size") > STEP_BYTES) & ~packed
    listing = binary_files(spark, path)
    whole = listing.filter(~large).select("path", "length", digest.alias("sha256"))
    named = listing.filter(large).select("path", "length", F.col("_metadata.file_path").alias("file"))
    if named.isEmpty():
        return whole
    lines = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(path).filter(large)
    found = named.join(_chained_digests(lines, line_feeds), "file").select("path", "length", "sha256")
    return whole.unionAll(found)


def _cut(step_bytes: int):
    """Task function: the lines of a scan as pieces of one block of a file each, a line feed after every line."""
    schema = to_arrow_schema(T.StructType.fromDDL(_CUT), prefers_large_types=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 0
        for batch in batches:
            paths, blocks = batch.column("path"), batch.column("block")
            other = pc.or_(pc.not_equal(paths[1:], paths[:-1]), pc.not_equal(blocks[1:], blocks[:-1]))
            ends = [*(np.flatnonzero(other.to_numpy(zero_copy_only=False)) + 1).tolist(), batch.num_rows]
            for first, end in zip([0, *ends], ends):
                if first == end:
                    continue
                data = b"\n".join([*batch.column("value")[first:end].to_pylist(), b""])
                block = blocks[first].as_py()
                row = (paths[first].as_py(), batch.column("length")[first].as_py(), block, place, len(data), data, block // step_bytes)
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)
                place += 1

    return run


def _chain_task(line_feeds: bool):
    """For each file the stored state, fed with the pieces of a step; at a file's end its digest."""
    schema = to_arrow_schema(T.StructType.fromDDL(_CHAIN), prefers_large_types=False)

    def stored(file: dict) -> pa.RecordBatch:
        if file["seen"] == file["total"]:
            file |= {"state": None, "sha256": sha256.hex_digest(file["state"])}
        return pa.RecordBatch.from_pylist([file], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["block"] < 0:
                    if file:
                        yield stored(file)
                    file = {name: row.get(name) for name in schema.names}
                    continue
                data, file["seen"] = row["data"], file["seen"] + row["size"]
                if file["seen"] == file["total"] and file["total"] - file["length"] in (1, -2):
                    data = data[:-1]  # the file does not end in a line feed
                if line_feeds:
                    data = data.replace(b"\r\n", b"\n")
                file["state"] = sha256.fed(file["state"], data)
        if file:
            yield stored(file)

    return run


def _chained_digests(lines: DataFrame, line_feeds: bool) -> DataFrame:
    """(file, sha256) of the files of a scan of lines, none of them read by one task as a whole.

    One scan writes the lines as pieces, by steps of ``STEP_BYTES`` of their files.  A digest is a
    chain, so step follows step: a task for each file feeds the pieces of the step to the stored
    state.  The pieces are dropped at the end.
    """
    spark = lines.sparkSession
    cut, chain = work_dir(spark, "digest-pieces"), work_dir(spark, "digest-states")
    places = lines.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("length"),
        F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"),
    )
    places.mapInArrow(_cut(STEP_BYTES), _CUT).write.partitionBy("step").parquet(cut)
    pieces = spark.read.schema(_CUT).parquet(cut)
    files = pieces.groupBy("path", "length").agg(F.sum("size").alias("total"))
    # the last line has got a line feed too, and scans of text leave out a byte order mark
    more = F.col("total") - F.col("length")
    start = F.when(more.between(0, 1), F.lit(sha256.START)).when(
        more.between(-3, -2), F.lit(sha256.fed(sha256.START, codecs.BOM_UTF8))
    ).otherwise(F.raise_error(F.concat(F.lit("Not the bytes that were listed: "), "path")).cast("binary"))
    # one row for each large file; the longest come first, so that those of a step are 0, 1, 2, ...
    part = F.row_number().over(Window.orderBy(F.desc("total"), "path")) - 1
    files.select(
        "path", "length", part.alias("part"), "total", F.lit(0).cast("long").alias("seen"), start.alias("state"),
        F.lit(None).cast("string").alias("sha256"),
    ).write.parquet(f"{chain}/step=0")
    step, read = 0, spark.read.schema(_CHAIN)
    while n := (states := read.parquet(f"{chain}/step={step}").filter("sha256 IS NULL")).count():
        known = states.select("path", "part")
        known = F.broadcast(known) if n <= BROADCAST_FILES else known
        fed = pieces.filter(F.col("step") == step).select("path", "block", "place", "size", "data").join(known, "path")
        states = states.withColumn("block", F.lit(-1).cast("long"))
        dealt = states.unionByName(fed, allowMissingColumns=True).repartitionById(n, F.col("part"))
        dealt = dealt.sortWithinPartitions("path", "block", "place")
        step += 1
        dealt.mapInArrow(_chain_task(line_feeds), _CHAIN).write.parquet(f"{chain}/step={step}")
    drop_paths(spark, [cut])
    _made.remove(cut)
    return read.parquet(chain).filter("sha256 IS NOT NULL").select(F.col("path").alias("file"), "sha256")


#: Children of a node of a digest tree.
TREE_FAN = 1024


def tree_digests(spark: SparkSession, path: str | list[str], fan: int = TREE_FAN) -> DataFrame:
    """(path, length, sha256) of files of any size, each read by many tasks.

    The root of a tree of SHA-256: leaves are the digests of the lines (cut at line feeds),
    each ``fan`` neighbours are joined as lower-case hex and digested, level by level, and the
    root is digested once more with the length in bytes.  It does not depend on how files are
    cut into blocks, and it is not the SHA-256 of the content.  Scans show no empty files.
    """
    listing = binary_files(spark, path).select("path", "length")
    lines = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"), F.sha2("value", 256).alias("digest"),
    )
    lines = materialized(lines, "leaf-digests")
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = lines.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    # the rows of a block are read by one task, so their ids follow each other
    place = F.col("before") + F.col("id") - F.col("first")
    nodes = lines.join(counts, ["path", "block"]).select("path", place.alias("place"), "digest")
    done = None
    while True:
        parent = F.floor(F.col("place") / fan)
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "digest"))), lambda x: x["digest"]), "")
        nodes = nodes.groupBy("path", parent.alias("parent")).agg(F.sha2(joined, 256).alias("digest"))
        nodes = materialized(nodes.withColumnRenamed("parent", "place"), "node-digests")
        ends = nodes.groupBy("path").agg(F.max("place").alias("last"))
        tops = nodes.join(ends.filter("last = 0"), "path").select("path", "digest")
        done = tops if done is None else done.unionAll(tops)
        more = ends.filter("last > 0")
        if more.isEmpty():
            break
        nodes = nodes.join(more.select("path"), "path", "left_semi")
    named = F.concat("digest", F.lit(" "), F.col("length").cast("string"))
    return listing.join(done, "path").select("path", "length", F.sha2(named, 256).alias("sha256"))


def content_fingerprint(digests: DataFrame) -> str:
    """SHA-256 of one file, or of the sorted file digests of several."""
    row = digests.agg(
        F.count("*").alias("files"),
        F.max("sha256").alias("only"),
        F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), ""), 256).alias("combined"),
    ).first()
    return row["only"] if row["files"] == 1 else row["combined"]


MASK = "\u0001"


def _single_line(line: Column) -> Column:
    """True when a physical line is surely one whole, well-quoted CSV record.

    Quoted runs are masked; what is left must hold no quote, and each mask must be an
    entire field.  Everything else is left to the strict record parser.
    """
    masked = F.regexp_replace(line, '"[^"]*"', MASK)
    neat = ~masked.contains('"') & ~masked.rlike(f"[^,{MASK}]{MASK}|{MASK}[^,{MASK}]")
    plain = ~line.rlike(r"^\s+$") & ~line.contains(MASK)
    return plain & (F.octet_length(line) <= V.MAX_CELL_BYTES) & (~line.contains('"') | neat)


def inspect_files(spark: SparkSession, path: str | list[str], settings: Settings = DEFAULTS) -> DataFrame:
    """One row per file: size, encoding, header line, layout and the reason for a rejection.

    A single splittable text scan; no file is held in memory as a whole.  ``layout`` is
    ``lines`` when every line is one record (splittable parsing) and ``records`` when
    quoting or encoding needs the record parser.
    """
    listing = binary_files(spark, path).select(
        F.col("path").alias("file"), F.col("length").alias("bytes")
    )
    lines = (
        spark.read.option("recursiveFileLookup", "true")
        .text(path)
        .select(
            "value",
            F.col("_metadata.file_path").alias("file"),
            (F.col("_metadata.file_block_start") == 0).alias("first_block"),
            F.monotonically_increasing_id().alias("place"),
        )
    )
    value = F.col("value")
    filled = value != ""
    head = F.when(filled & F.col("first_block"), F.col("place"))
    # The header text needs a buffer of changing size, for which Spark would sort every
    # line by file.  A typed aggregate beside it (a set of at most one flag) keeps the
    # object-hash plan, which only holds one entry per file and task.
    scanned = lines.groupBy("file").agg(
        F.collect_set(F.when(F.col("first_block"), True)).alias("starts"),
        F.count_if(filled).alias("lines"),
        F.bool_and(F.is_valid_utf8(value)).alias("utf8"),
        F.bool_or(value.contains("\u0000")).alias("binary"),
        F.bool_or(~F.is_valid_utf8(value) & windows_text(value).rlike(UNDEFINED)).alias("neither"),
        F.bool_and(_single_line(value)).alias("neat"),
        F.min_by(value, head).alias("header"),
    )
    reason = (
        F.when(~F.lower("file").endswith(".csv"), "The name does not end in .csv.")
        .when(
            (F.coalesce("lines", F.lit(0)) == 0) | (F.size("starts") == 0), "There is no record in the file."
        )
        .when(F.col("binary"), "The file holds NUL characters, so it is no text.")
        .when(~F.col("utf8") & F.col("neither"), "The bytes are neither UTF-8 nor Windows-1252.")
    )
    return listing.join(scanned, "file", "left").select(
        "file", "bytes", F.coalesce("lines", F.lit(0)).alias("lines"),
        F.when(F.col("utf8"), "utf-8").otherwise("windows-1252").alias("encoding"),
        F.when(F.col("utf8") & F.col("neat"), "lines").otherwise("records").alias("layout"),
        "header", reason.alias("rejected"),
    )
