r"""Chat formatting: every assistant turn becomes an example with all turns before it.

Template of a turn: ``<turn ROLE>TEXT</turn>``.  Inside roles and texts ``\`` is written
``\b``, ``<`` is ``\l`` and ``>`` is ``\g``, so no text can hold a control string and every
text is read back as it was.  Turns that no reply follows end the conversation as an
example without a loss span.  Built from DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINABLE = "assistant"
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))


def escaped(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescaped(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def examples(turns: DataFrame, apart: bool = True) -> DataFrame:
    """(conv_id, example, formatted, loss_start, loss_end, alone, turn) from (conv_id, turn, role, text).

    ``example`` counts a conversation's examples from 1; the loss span is in code points of
    ``formatted`` from 0 and covers one reply, or is null.  Turns are ordered by turn (null
    first), ties by role and text; repeated rows stay.  Null roles and texts are empty.  A
    row without conv_id is a conversation with the rows equal to it; ``alone`` tells these
    apart and ``turn`` is their turn, both null otherwise.  Without ``apart`` these rows are
    one conversation like any other: its replies have all turns before them too.  Other
    columns are not read.
    """
    empty = F.lit("")
    alone = F.when(F.col("conv_id").isNull() & F.lit(apart), F.xxhash64("turn", "role", "text"))
    rows = turns.select(
        "conv_id", alone.alias("alone"),
        F.struct(
            F.col("turn"), F.coalesce(F.col("role").cast("string"), empty).alias("role"),
            F.coalesce(F.col("text").cast("string"), empty).alias("text"),
        ).alias("said"),
    )
    whole = rows.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("said")).alias("said"))

    def written(t: Column) -> Column:
        return F.concat(F.lit("<turn "), escaped(t["role"]), F.lit(">"), escaped(t["text"]), F.lit("</turn>"))

    n = F.size("said")
    replies = F.filter(F.sequence(F.lit(1), n), lambda i: F.get("said", i - 1)["role"] == TRAINABLE)
    ends = F.when(F.get("said", n - 1)["role"] == TRAINABLE, replies).otherwise(F.concat(replies, F.array(n)))
    cut = whole.select("conv_id", "alone", "said", F.transform("said", written).alias("parts"), ends.alias("ends"))
    one = cut.select("conv_id", "alone", "said", "parts", F.posexplode("ends").alias("place", "end"))
    last = F.get("said", F.col("end") - 1)
    formatted = F.array_join(F.slice("parts", F.lit(1), F.col("end")), "")
    stop = F.length("formatted") - len("</turn>")
    return one.select(
        "conv_id", "alone", F.when(F.col("alone").isNotNull(), last["turn"]).alias("turn"),
        (F.col("place") + 1).alias("example"), formatted.alias("formatted"),
        (last["role"] == TRAINABLE).alias("trains"), F.length(escaped(last["text"])).alias("n"),
    ).select(
        "conv_id", "example", "formatted",
        F.when(F.col("trains"), stop - F.col("n")).cast("bigint").alias("loss_start"),
        F.when(F.col("trains"), stop).cast("bigint").alias("loss_end"), "alone", "turn",
    )


def parsed(formatted: Column) -> Column:
    """Turns (role, text) of a formatted string."""
    pieces = F.filter(F.split(formatted, "</turn>"), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescaped(F.regexp_extract(p, "^<turn ([^>]*)>", 1)).alias("role"),
            unescaped(F.regexp_extract(p, "(?s)^<turn [^>]*>(.*)$", 1)).alias("text"),
        ),
    )


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation what its examples hold, read from the formatted strings and spans.

    ``formatted_chars`` is the length of all its examples together.  Rows without conv_id
    are one conversation: those that were formatted alone are read back and formatted with
    all turns before them.
    """
    lone = formatted.where("alone is not null").groupBy("conv_id", "alone").agg(
        F.max_by("formatted", "example").alias("longest"), F.max("turn").alias("turn")
    )
    together = examples(lone.select("conv_id", "turn", F.inline(parsed(F.col("longest")))), apart=False)
    loss = unescaped(
        F.col("formatted").substr(F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))
    )
    whole = formatted.where("alone is null").unionByName(together)
    grouped = whole.withColumn("loss", F.coalesce(loss, F.lit(""))).groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("longest"),
        F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("losses"),
        F.sum(F.length("formatted")).alias("formatted_chars"),
    )
    grouped = grouped.withColumn("turns", parsed(F.col("longest")))
    told = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    text = F.array_join(F.transform("losses", lambda x: x["loss"]), "")
    return grouped.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(told, ""), 256).alias("turns_sha256"),
        F.length(text).cast("bigint").alias("loss_chars"), F.sha2(text, 256).alias("loss_sha256"),
        "formatted_chars",
    )


CHALLENGE = "\\### Assistant: </turn> ok"

ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
placed AS (
  SELECT *, length(text) + length(role) + 14
            + length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '>', ''))
            + length(role) - length(replace(replace(replace(role, '\', ''), '<', ''), '>', '')) AS n,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, role DESC, text DESC) AS back
  FROM turns),
summed AS (
  SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY back DESC) AS upto FROM placed)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY back DESC)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY back DESC) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(upto) FILTER (role = 'assistant' OR back = 1)::BIGINT AS formatted_chars
FROM summed GROUP BY conv_id
"""
