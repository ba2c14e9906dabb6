"""Numbers and labels as the text that findings quote."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _strip_zeros(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def short_float(value: Column, digits: int = 4) -> Column:
    """A rounded float in plain notation with at least one decimal: 20.0, 6.67, 0.0001."""
    text = _strip_zeros(value.cast(f"decimal(38,{digits})").cast("string"))
    return F.when(text.contains("."), text).otherwise(F.concat(text, F.lit(".0")))


def percent_text(value: Column, digits: int = 2) -> Column:
    """A fraction as a percentage with fixed decimals: 0.9333 -> 93.33%."""
    scaled = F.round(value * 100, digits).cast(f"decimal(38,{digits})").cast("string")
    return F.concat(scaled, F.lit("%"))


def general4(value: Column) -> Column:
    """Four significant digits, plain between 1e-4 and 1e4, otherwise an exponent."""
    sci = F.format_string("%.3e", value)
    sign = F.when(value < 0, "-").otherwise("")
    digits = F.regexp_replace(F.regexp_extract(sci, r"^-?([\d.]+)e", 1), r"\.", "")
    power_text = F.regexp_extract(sci, r"e([+-]\d+)$", 1)
    power = power_text.cast("int")
    # cut points are clamped so the unused branch of the case stays valid
    cut = F.greatest(F.lit(0), F.least(F.lit(3), power)) + 1
    large = F.concat(
        F.substring(digits, F.lit(1), cut), F.lit("."), F.substring(digits, cut + 1, F.lit(4))
    )
    small = F.concat(
        F.lit("0."), F.repeat(F.lit("0"), F.greatest(F.lit(0), -power - 1)), digits
    )
    mantissa = _strip_zeros(F.concat(F.left(digits, F.lit(1)), F.lit("."), F.substring(digits, 2, 3)))
    return (
        F.when(value.isNull(), F.lit(None))
        .when(value == 0, "0")
        .when((power >= 0) & (power < 4), F.concat(sign, _strip_zeros(large)))
        .when((power < 0) & (power >= -4), F.concat(sign, _strip_zeros(small)))
        .otherwise(F.concat(sign, mantissa, F.lit("e"), power_text))
    )


def quoted(text: Column) -> Column:
    """A label in quotes: single ones unless only those occur inside."""
    escaped = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(shown))
    double = F.concat(F.lit('"'), escaped, F.lit('"'))
    single = F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(text.contains("'") & ~text.contains('"'), double).otherwise(single)
