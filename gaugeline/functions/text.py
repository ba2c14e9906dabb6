"""Text rules as column expressions: cleaning, redaction, credential shapes, digests."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugeline import fixed_values as V


# \w, \d, \s and \b follow Unicode, as the fixed patterns expect
UNICODE = "(?U)"


# Windows-1252 differs from Latin-1 in the range 80-9F only; five bytes there mean nothing
_C1 = "".join(chr(c) for c in range(0x80, 0xA0) if bytes([c]).decode("cp1252", "ignore"))
_WINDOWS = _C1.encode("latin-1").decode("cp1252")
UNDEFINED = "[\u0081\u008d\u008f\u0090\u009d]"


def windows_text(value: Column) -> Column:
    """Bytes as Windows-1252 text; bytes without a meaning stay in the range of ``UNDEFINED``."""
    return F.translate(F.decode(value.cast("binary"), "ISO-8859-1"), _C1, _WINDOWS)


def cleaned(text: Column) -> Column:
    """Control and format characters become spaces, white space collapses, ends are trimmed."""
    return F.trim(
        F.regexp_replace(F.regexp_replace(text, r"\p{C}", " "), r"(?U)\s+", " ")
    )


def reason_accepted(text: Column) -> Column:
    return F.char_length(cleaned(text)) <= V.MAX_REASON_CHARS


def clean_reason(reason: str) -> str:
    """The same rule for a single call argument."""
    if not isinstance(reason, str):
        raise ValueError("A reason has to be a text.")
    visible = "".join(" " if unicodedata.category(ch)[0] == "C" else ch for ch in reason)
    result = " ".join(visible.split())
    if len(result) > V.MAX_REASON_CHARS:
        raise ValueError(f"A reason may have {V.MAX_REASON_CHARS} characters.")
    return result


def redacted(
    text: Column, secrets: tuple[str, ...] = (), root: str | None = None,
    limit: int | None = None,
) -> Column:
    """Known secrets, credential shapes, bearer tokens and local paths become placeholders."""
    out = text
    for secret in secrets:
        out = F.replace(out, F.lit(secret), F.lit("[redacted credential]"))
    for i, (pattern, shown) in enumerate(V.REDACTIONS):
        if i == 2 and root:
            out = F.replace(out, F.lit(root), F.lit("[repository]"))
        out = F.regexp_replace(out, UNICODE + pattern, shown)
    return out if limit is None else F.left(out, F.lit(limit))


def has_credential(text: Column) -> Column:
    return text.rlike(V.CREDENTIAL_PATTERN)


def normalized_digest(content: Column) -> Column:
    """SHA-256 with CRLF read as LF."""
    return F.sha2(F.replace(content, F.lit("\r\n"), F.lit("\n")), 256)


def forbidden_path(path: Column) -> Column:
    """Paths that must not be published: caches, environments, secret files."""
    parts = F.split(F.regexp_replace(path, r"\\", "/"), "/")
    name = F.element_at(parts, -1)
    return (
        F.arrays_overlap(parts, F.array(*[F.lit(p) for p in V.FORBIDDEN_PATH_PARTS]))
        | name.startswith(V.FORBIDDEN_NAME_PREFIX)
        | path.isin(*V.FORBIDDEN_PATHS)
        | path.startswith(V.FORBIDDEN_PATH_PREFIX)
    )


def repeat_number(run_id: Column) -> Column:
    """Repeat number inside a run id, NULL when the id has none."""
    return F.nullif(F.regexp_extract(run_id, V.REPEAT_PATTERN, 1), F.lit("")).cast("int")


# -- unsupported assurance ------------------------------------------------------------


def _guarded_assurance() -> str:
    """An assurance with no negation before it in its clause.

    The look-behind is bounded: each negation word may start at most the window
    length before the assurance, and no clause break may lie in between.
    """
    gap = f"(?:(?!{V.CLAUSE_BREAK_PATTERN})[\\s\\S])"
    options = "|".join(
        f"\\b{re.escape(w)}\\b{gap}{{0,{V.NEGATION_WINDOW - len(w)}}}" for w in V.NEGATION_WORDS
    )
    return f"{UNICODE}(?i)(?={V.ASSURANCE_PATTERN})(?<!{options})"


ASSURANCE = UNICODE + "(?i)" + V.ASSURANCE_PATTERN
GUARDED_ASSURANCE = _guarded_assurance()


def unsupported_assurance(text: Column) -> Column:
    """True when the text promises cleanliness without a negation in the same clause."""
    return F.when(text.rlike(ASSURANCE), text.rlike(GUARDED_ASSURANCE)).otherwise(F.lit(False))


# -- numeric literals -----------------------------------------------------------------


#: Sign, whole digits, decimals and power of a number.
NUMBER_PARTS = r"^([+-]?)(?=\.?[0-9])([0-9]*)\.?([0-9]*)(?:[eE]([+-]?[0-9]+))?$"


def number_texts(text: Column) -> Column:
    """Array of the numeric literals in a text, as written."""
    return F.regexp_extract_all(text, F.lit(UNICODE + V.NUMBER_PATTERN), F.lit(0))


def number_key(literal: Column) -> Column:
    """Comparison key: equal numbers give equal keys however they are written.

    The key is made of digits, exactly and at any length: sign, digits without outer zeros
    and the power of ten of the last one.  Zero is ``0`` with any sign; texts that are no
    plain ASCII number, such as digits of other scripts, are their own keys.
    """
    plain = F.regexp_replace(literal, ",", "")

    def part(group: int) -> Column:
        return F.regexp_extract(plain, NUMBER_PARTS, group)

    power = F.coalesce(F.nullif(part(4), F.lit("")), F.lit("0")).try_cast("decimal(38,0)")
    digits = F.regexp_replace(F.concat(part(2), part(3)), "^0+", "")
    short = F.regexp_replace(digits, "0+$", "")
    last = power - F.length(part(3)) + F.length(digits) - F.length(short)
    sign = F.when(part(1) == "-", "-").otherwise("")
    key = F.when(short == "", "0").otherwise(F.concat(sign, short, F.lit("e"), last.cast("string")))
    return F.coalesce(F.when(plain.rlike(NUMBER_PARTS), key), plain)


def number_keys(text: Column) -> Column:
    return F.array_distinct(F.transform(number_texts(text), number_key))


_KEY_OR_STRING = r'("(?:[^"\\]++|\\.)*+")(?!\s*:)|"(?:[^"\\]++|\\.)*+"\s*+:'
_HASH_ENTRY = r'"dataset_hash"\s*:\s*(?:"(?:[^"\\]++|\\.)*+"|[^,}\]]*)'


def json_values_text(document: Column) -> Column:
    """The values of a JSON text without its keys and without the table fingerprint."""
    without_hash = F.regexp_replace(document, _HASH_ENTRY, "")
    values = F.regexp_replace(without_hash, _KEY_OR_STRING, "$1")
    return F.regexp_replace(values, r"\\(?:[nrtbf]|u00[01][0-9a-fA-F])", " ")


def json_number_keys(document: Column) -> Column:
    return number_keys(json_values_text(document))


def header_facts(name: Column) -> Column:
    """What the header rules look at when names come as a table column."""
    return F.struct(
        F.lower(name).alias("folded"),
        F.octet_length(name).alias("bytes"),
        (F.trim(name) == "").alias("blank"),
        name.startswith(V.UNNAMED_PREFIX).alias("unnamed"),
        (F.octet_length(name) > V.MAX_HEADER_BYTES).alias("too_long"),
    )
