r"""Benchmark decontamination by template windows with a slot check.

Numbers, units after numbers and capitalised words inside sentences become placeholders, so
a question keeps its template when it is asked with other values.  Windows of five template
tokens are hashed and joined to the windows of the benchmark; a document that holds at least
``share`` of an item's windows is a candidate.  At one offset of a candidate that holds
enough windows, the item's slot values must map to the document's as a function (equal
values stay equal): this tells a re-parameterised question from a text that merely follows
the template.

A capitalised word at the start of a sentence, or after a quote or bracket, may be a name or
not.  Texts are read both ways: windows in which the readings differ are hashed in both, and
the slots are checked in the reading that gave the windows.

An item of fewer tokens is one window, sought among the windows of its length.  An item
whose windows hold too few literal words to tell anything (``Compute 12 + 7 * 3``) is sought
with its own values: its windows show what the placeholders stand for.

DataFrame functions only.  The benchmark's windows are broadcast when they are counted to be
few, and joined by a shuffle otherwise; rows of documents and items meet in sums only.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.sources.files import materialized

WINDOW = 5
#: Literal words that a window must hold to count.
LITERALS = 2
#: Windows of the benchmark (24 bytes each) and ids that may be broadcast.
BROADCAST_WINDOWS, BROADCAST_IDS = 1_000_000, 500_000
UNITS = (
    "mm cm dm m km mg g kg t ml cl dl l s sec min h hr hrs day days week weeks month months year years "
    "second seconds minute minutes hour hours meter meters metre metres kilometer kilometers mile miles "
    "foot feet inch inches yard yards gram grams kilogram kilograms pound pounds ounce ounces ton tons "
    "liter liters litre litres gallon gallons dollar dollars euro euros cent cents percent degrees mph kmh"
).split()

#: A name: a capitalised word whose sentence has begun before it.  The patterns test the
#: word's own first letter before they look back, as that settles most places.
_NAME = r"\p{Lu}(?<=[\p{L}\p{N},;:]\s\p{Lu})\p{Ll}+(?![\p{L}\p{N}])"
_NUMBER = r"\p{Nd}+(?:[.,:/]\p{Nd}+)*"
#: Any other capitalised word; a name in the second reading.
_CAPITALISED = r"\p{Lu}(?<![\p{L}\p{N}=]\p{Lu})\p{Ll}+(?![\p{L}\p{N}])"
_UNIT = r"(?i)(?<=\p{Nd}\s|#n\s|\p{Nd}|#n)(?:" + "|".join(UNITS) + r")(?![\p{L}\p{N}#])"


def _spaced(text: Column, values: bool = False) -> Column:
    """Template tokens between spaces with their letters' case, capitalised words at sentence starts left as they are."""
    shown = "=$0" if values else ""
    text = F.replace(F.replace(text, F.lit("#")), F.lit("="))
    measured = F.regexp_replace(F.regexp_replace(text, _NUMBER, f"#n{shown}"), _UNIT, f" #u{shown}")
    text = F.when(text.rlike(r"\p{Nd}"), measured).otherwise(text)
    text = F.regexp_replace(text, _NAME, f"#a{shown}")
    # punctuation stays between digits only, and templates have none left
    between = r"(?<!\p{Nd})[^\p{L}\p{N}#=]+|[^\p{L}\p{N}#=]+(?!\p{Nd})" if values else r"[^\p{L}\p{N}#=]+"
    return F.regexp_replace(text, between, " ")


def _named(spaced: Column, values: bool = False) -> Column:
    """Spaced tokens in the second reading, in which every capitalised word is a name."""
    return F.regexp_replace(spaced, _CAPITALISED, "#a=$0" if values else "#a")


def _cut(spaced: Column) -> Column:
    """Lower-case tokens; a space ends what a letter's lower case depends on, so whole texts are lowered."""
    return F.filter(F.split(F.lower(spaced), " "), lambda t: t != "")


def tokens(text: Column, values: bool = False, every: bool = False) -> Column:
    """Template tokens; with ``values`` each placeholder also shows what it stands for.

    With ``every`` all capitalised words are names, also where a sentence starts.  All forms
    have the same tokens at the same places.
    """
    spaced = _spaced(text, values)
    return _cut(_named(spaced, values) if every else spaced)


def with_windows(rows: DataFrame, widths: list[int], values: bool = False) -> DataFrame:
    """A row (columns of ``rows`` but text, pos, w, sure, every) per window of the text's tokens, of every width asked for.

    ``sure`` and ``every`` tell the reading; a window that is the same in both comes once.
    With ``values`` the windows show the values, in one reading, and never equal those
    without.  Arrays hold tokens only: a lambda runs interpreted, and one for each window costs
    several times what the cut of the text does.  Rows of places are hashed in generated code.
    The generator is an outer one, as Spark would filter by the array's size before it is
    computed otherwise.
    """
    kept = [c for c in rows.columns if c != "text"]
    rows = rows.withColumn("spaced", _spaced(F.col("text"), values))
    # the second reading follows the first and has as many tokens
    both = F.col("spaced") if values else F.concat_ws(" ", "spaced", _named(F.col("spaced")))
    rows = rows.withColumn("words", _cut(both)).select(*kept, "words")
    rows = rows.withColumn("n_words", F.size("words") if values else F.shiftright(F.size("words"), 1))
    rows = rows.select("*", F.explode(F.array(*map(F.lit, widths))).alias("of_width"))
    rows = rows.select("*", F.posexplode_outer("words").alias("place", "word"))
    place, n_words, of_width = F.col("place"), F.col("n_words"), F.col("of_width")
    again = place >= n_words
    pos = F.when(again, place - n_words).otherwise(place)
    rows = rows.where(pos <= n_words - of_width)

    def at(k: int) -> Column:
        """Token ``k`` of the window; null beyond its width, which a hash passes over."""
        token = F.get("words", place + k)
        return token if k < min(widths) else F.when(of_width > k, token)

    def alike(other: Column) -> Column:
        """Whether the window is the same in the other reading."""
        same = (F.get("words", place + k) == F.get("words", other + k) for k in range(max(widths)))
        return functools.reduce(
            lambda a, b: a & b, [s if k < min(widths) else (of_width <= k) | s for k, s in enumerate(same)]
        )

    if not values:
        rows = rows.where(~again | ~alike(place - n_words))
    kind = [F.lit("values")] if values else []
    return rows.select(
        *kept, pos.alias("pos"), F.xxhash64(*kind, *map(at, range(max(widths)))).alias("w"), (~again).alias("sure"),
        (F.lit(True) if values else again | alike(place + n_words)).alias("every"),
    )


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, item_hash, ipos, w, sure, every, n_windows, width, valued): windows of every item.

    These are its template windows that hold enough literal words, or nothing but such; an
    item with none of them has all its windows with values.  An item with fewer tokens than
    a window has one of its own width; each distinct text of an item_id is an item of its own.
    """
    rows = benchmark.where("item_id is not null").select("item_id", F.col("text").cast("string").alias("text"))
    rows = rows.where("text is not null").distinct().withColumn("t", tokens(F.col("text")))
    rows = rows.withColumn("item_hash", F.xxhash64("text"))
    rows = rows.withColumn("te", tokens(F.col("text"), every=True))
    rows = rows.withColumn("width", F.least(F.size("t"), F.lit(WINDOW)))

    def windows(of: DataFrame, values: bool) -> DataFrame:
        parts = [
            with_windows(of.where(F.col("width") == width), [width], values).select(
                "item_id", "item_hash", "t", "te", "width", F.lit(values).alias("valued"), F.col("pos").alias("ipos"), "w", "sure", "every"
            )
            for width in range(1, WINDOW + 1)
        ]
        return functools.reduce(DataFrame.unionAll, parts)

    shown = F.when(F.col("sure"), F.col("t")).otherwise(F.col("te"))
    literal = F.size(F.filter(F.slice(shown, F.col("ipos") + 1, F.col("width")), lambda t: ~F.contains(t, F.lit("#"))))
    telling = windows(rows, False).where(literal >= F.least(F.col("width"), F.lit(LITERALS)))
    telling = materialized(telling, "item-templates")
    rest = rows.join(telling.select("item_id", "item_hash").distinct(), ["item_id", "item_hash"], "left_anti")
    kept = telling.unionAll(windows(rest, True)).select(
        "item_id", "item_hash", "ipos", "w", "sure", "every", "width", "valued"
    ).distinct()
    counts = kept.where("sure").groupBy("item_id", "item_hash").agg(F.count("*").alias("n_windows"))
    return kept.join(counts, ["item_id", "item_hash"])


def document_windows(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, text_hash, dpos, w, sure, every): windows of the kinds that occur among the items."""
    kinds: dict[bool, list[int]] = {False: [], True: []}
    for r in known.select("width", "valued").distinct().collect():  # at most two of each width
        kinds[r.valued].append(r.width)
    if not kinds[False] and not kinds[True]:
        kinds[False] = [WINDOW]
    parts = [
        with_windows(rows, sorted(widths), values)
        for values, widths in kinds.items()
        if widths
    ]
    return functools.reduce(DataFrame.unionAll, parts).withColumnRenamed("pos", "dpos")


def _small(rows: DataFrame, limit: int) -> DataFrame:
    """The rows, marked for broadcast when they are counted to be few."""
    return F.broadcast(rows) if rows.count() <= limit else rows


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = 0.8) -> DataFrame:
    """One row per document text and benchmark item found in it.

    Columns: doc_id, item_id, windows (of the item found), n_windows, start (token of the
    document where the item begins), slots, verbatim (all slot values are the item's own)
    and text_hash.  Items are the distinct texts of each item_id.  Null, empty and wordless texts match nothing; a null doc_id is reported
    as null; rows of one id with different texts are separate.  Other columns are not read.
    """
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", text.alias("text")).where(F.length("text") > 0)
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    known = materialized(item_windows(benchmark), "item-windows")
    places = document_windows(rows, known)
    known = known.select("item_id", "item_hash", "ipos", "w", "n_windows", F.col("sure").alias("isure"), F.col("every").alias("ievery"))
    hits = places.join(_small(known, BROADCAST_WINDOWS), "w").select(
        "doc_id", "text_hash", "item_id", "item_hash", "n_windows", "ipos", (F.col("dpos") - F.col("ipos")).alias("offset"),
        (F.col("sure") & F.col("isure")).alias("sure"), (F.col("every") & F.col("ievery")).alias("every"),
    ).where("sure or every")
    by_offset = hits.groupBy("doc_id", "text_hash", "item_id", "item_hash", "n_windows", "offset").agg(
        F.collect_set("ipos").alias("found"), F.collect_set(F.when(F.col("sure"), F.col("ipos"))).alias("found_sure")
    )
    enough = share * F.col("n_windows")

    def union(of: str) -> Column:
        return F.size(F.array_distinct(F.flatten(F.collect_list(of))))

    found = by_offset.groupBy("doc_id", "text_hash", "item_id", "item_hash", "n_windows").agg(
        union("found").alias("windows"), union("found_sure").alias("windows_sure"),
        F.collect_list(F.struct("offset", F.size("found").alias("n"), F.size("found_sure").alias("n_sure"))).alias("places"),
    ).where(F.col("windows") >= enough)

    def most(of: str) -> Column:
        return F.least(enough, F.array_max(F.transform("places", lambda p: p[of])))

    # every offset with enough windows, or with the most when they are spread over several
    found = found.withColumn("least", most("n")).withColumn("least_sure", most("n_sure"))
    at_each = found.select("*", F.inline("places")).select(
        "doc_id", "text_hash", "item_id", "item_hash", "windows", "n_windows", F.col("offset").cast("int").alias("start"), "n",
        ((F.col("windows_sure") >= enough) & (F.col("n_sure") >= F.col("least_sure"))).alias("sure"),
        (F.col("n") >= F.col("least")).alias("every"),
    )
    candidates = materialized(at_each.where("sure or every"), "leak-candidates")
    hashes = materialized(candidates.select("text_hash").distinct(), "leak-texts")
    texts = rows.join(_small(hashes, BROADCAST_IDS), "text_hash", "left_semi")
    texts = texts.groupBy("text_hash").agg(F.min("text").alias("text"))
    def forms(prefix: str) -> list[Column]:
        return [
            tokens(F.col("text"), values, every).alias(prefix + kind)
            for kind, values, every in (("t", False, False), ("v", True, False), ("et", False, True), ("ev", True, True))
        ]

    valued = texts.select("text_hash", *forms("d"))
    items = benchmark.where("item_id is not null and text is not null").select("item_id", F.col("text").cast("string").alias("text"))
    items = items.distinct().select("item_id", F.xxhash64("text").alias("item_hash"), *forms("i"))
    aligned = candidates.join(valued, "text_hash").join(items, ["item_id", "item_hash"])
    at = F.col("start")

    def pairs(t: str, v: str) -> Column:
        def same(i: Column) -> Column:
            placed = (i + at >= 0) & F.contains(F.get(f"i{t}", i), F.lit("#"))
            return placed & (F.get(f"i{t}", i) == F.get(f"d{t}", F.greatest(i + at, F.lit(0))))

        slots = F.transform(
            F.filter(F.sequence(F.lit(0), F.size(f"i{t}") - 1), same),
            lambda i: F.struct(F.get(f"i{v}", i).alias("item"), F.get(f"d{v}", i + at).alias("doc")),
        )
        return F.array_distinct(slots)

    def own(of: str) -> Column:
        return F.size(F.array_distinct(F.transform(of, lambda p: p["item"])))

    judged = aligned.withColumn("pairs", pairs("t", "v")).withColumn("epairs", pairs("et", "ev"))
    judged = judged.withColumn("sure", F.col("sure") & (F.size("pairs") == own("pairs")))
    judged = judged.where(F.col("sure") | (F.col("every") & (F.size("epairs") == own("epairs"))))
    slots = F.when(F.col("sure"), own("pairs")).otherwise(own("epairs"))
    verbatim = F.forall("epairs", lambda p: p["item"] == p["doc"])
    best = F.max(F.struct(verbatim.alias("verbatim"), "n", (-at).alias("back"), slots.alias("slots"))).alias("best")
    return judged.groupBy("doc_id", "text_hash", "item_id", "item_hash", "windows", "n_windows").agg(best).select(
        "doc_id", "item_id", "windows", "n_windows", (-F.col("best.back")).alias("start"), "best.slots", "best.verbatim",
        "text_hash",
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, share: float = 0.8) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item; columns stay as they are."""
    found = leaks(docs, benchmark, share).select(F.col("text_hash").alias("__leak")).distinct()
    found = materialized(found, "leaks")
    key = F.xxhash64(F.col("text").cast("string"))
    return docs.join(_small(found, BROADCAST_IDS), key == F.col("__leak"), "left_anti")
