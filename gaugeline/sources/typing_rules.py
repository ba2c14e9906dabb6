"""Full-column type inference from text, as one aggregate over all columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline import fixed_values as V
from gaugeline.columns import sql_name, sql_text
from gaugeline.functions.local import small_table

INT, FLOAT, TEXT, LEADING_ZERO, TOO_BIG, PADDED, BOOL = 1, 2, 4, 8, 16, 32, 64

# white space a lexeme may carry around a number
_SPACE = "".join(
    chr(c)
    for c in (
        *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
        0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    )
)
_QUICK_INT = r"^[+-]?(?:0|[1-9][0-9]{0,17})$"
_QUICK_FLOAT = r"^[+-]?[0-9]+[.][0-9]+$"
# first letters that start neither a number word nor a boolean
_QUICK_TEXT = r"^[A-EGHJ-MO-SU-Za-eghj-mo-su-z]"
_ANY_INT = r"^[+-]?[0-9]+$"
_FLOAT = r"^[+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?$|^(?i)[+-]?inf(?:inity)?$"
_TOKENS = ", ".join(sql_text(token) for token in V.NULL_TOKENS)


def null_tokens_sql(value: str) -> str:
    return f"CASE WHEN {value} NOT IN ({_TOKENS}) THEN {value} END"


def null_tokens_to_null(value: Column) -> Column:
    """Exact null tokens become NULL; nothing is trimmed."""
    return F.when(~value.isin(*V.NULL_TOKENS), value)


def trimmed_sql(value: str) -> str:
    return f"btrim({value}, {sql_text(_SPACE)})"


def _quick_class(v: str) -> str:
    """Flags of the common lexemes; 0 sends a lexeme to the full rules."""
    return (
        f"CASE WHEN {v} IS NULL THEN NULL WHEN rlike({v}, r'{_QUICK_INT}') THEN {INT} "
        f"WHEN rlike({v}, r'{_QUICK_FLOAT}') THEN {FLOAT} WHEN rlike({v}, r'{_QUICK_TEXT}') THEN {TEXT} ELSE 0 END"
    )


def _slow_class(v: str, token: str) -> str:
    """Flags of any other lexeme; ``token`` is the trimmed value."""
    digits = f"ltrim('+-', {token})"
    return (
        f"(CASE WHEN rlike({token}, r'{_ANY_INT}') THEN CASE "
        f"WHEN length({digits}) > 1 AND startswith({digits}, '0') THEN {LEADING_ZERO} "
        f"WHEN try_cast({token} AS BIGINT) IS NOT NULL THEN {INT} ELSE {TOO_BIG} END "
        f"WHEN rlike({token}, r'{_FLOAT}') THEN {FLOAT} "
        f"WHEN {v} IN ('True', 'False', 'TRUE', 'FALSE', 'true', 'false') THEN {TEXT | BOOL} "
        f"ELSE {TEXT} END | CASE WHEN {token} <> {v} THEN {PADDED} ELSE 0 END)"
    )


@dataclass(frozen=True)
class ColumnFacts:
    name: str
    flags: int
    nulls: int
    rows: int
    plain_text: bool = True

    @property
    def dtype(self) -> str:
        if self.flags & (TEXT | LEADING_ZERO | TOO_BIG):
            return "object"
        if self.flags & FLOAT or not self.flags or self.nulls:
            return "float64"
        return "int64"

    @property
    def permissive_dtype(self) -> str:
        """Looser rule: leading zeros are numbers and a column of booleans is one."""
        if self.flags & TEXT:
            pure = not self.plain_text and not self.flags & (INT | FLOAT | LEADING_ZERO | TOO_BIG)
            return "bool" if pure and not self.nulls else "object"
        if self.flags & (FLOAT | TOO_BIG) or not self.flags or self.nulls:
            return "float64"
        return "int64"

    @property
    def leading_zero(self) -> bool:
        return bool(self.flags & LEADING_ZERO)

    @property
    def mixed(self) -> bool:
        """Numbers and text in one column (independent of the order they occur in)."""
        text = self.flags & (TEXT | TOO_BIG)
        return bool(text and self.flags & (INT | FLOAT) and not self.leading_zero)

    @property
    def padded(self) -> bool:
        return bool(self.flags & PADDED)


def flags_row(df: DataFrame, names: list[str]) -> DataFrame:
    """One row of lexeme flags, null counts and boolean purity for text columns."""
    # each step keeps its result in a column: later steps use it several times
    places = range(len(names))
    values = df.selectExpr(*[f"{null_tokens_sql(sql_name(c))} AS v{i}" for i, c in enumerate(names)])
    quick = values.selectExpr("*", *[f"{_quick_class(f'v{i}')} AS q{i}" for i in places])
    tokens = quick.selectExpr(
        "*", *[f"CASE WHEN q{i} = 0 THEN {trimmed_sql(f'v{i}')} END AS t{i}" for i in places]
    )
    kinds = tokens.selectExpr(
        *[f"CASE WHEN q{i} = 0 THEN {_slow_class(f'v{i}', f't{i}')} ELSE q{i} END AS k{i}" for i in places]
    )
    return kinds.selectExpr(
        "count(*) AS rows",
        *[f"coalesce(bit_or(k{i}), 0) AS f{i}" for i in places],
        *[f"count(k{i}) AS n{i}" for i in places],
        *[f"coalesce(bool_or((k{i} & {TEXT | BOOL}) = {TEXT}), false) AS t{i}" for i in places],
    )


def infer_columns(df: DataFrame, names: list[str] | None = None) -> list[ColumnFacts]:
    chosen = names or df.columns
    row = flags_row(df, chosen).first()
    return [
        ColumnFacts(c, row[f"f{i}"], row["rows"] - row[f"n{i}"], row["rows"], row[f"t{i}"])
        for i, c in enumerate(chosen)
    ]


def column_types(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(column, dtype, null_count, leading_zero, mixed) as a small table."""
    rows = [(f.name, f.dtype, f.nulls, f.leading_zero, f.mixed) for f in infer_columns(df, names)]
    return small_table(df.sparkSession, rows,
        "column string, dtype string, null_count bigint, leading_zero boolean, mixed boolean",
    )


_SQL_TYPES = {"int64": "bigint", "float64": "double", "object": "string", "bool": "boolean"}


def typed(df: DataFrame, facts: list[ColumnFacts], permissive: bool = False) -> DataFrame:
    """Cast text columns to their inferred types; lexemes were checked, so casts cannot fail."""
    out = []
    for fact in facts:
        dtype = fact.permissive_dtype if permissive else fact.dtype
        value = null_tokens_sql(sql_name(fact.name))
        if dtype in ("int64", "float64") and fact.padded:
            value = trimmed_sql(f"({value})")
        out.append(f"CAST({value} AS {_SQL_TYPES[dtype]}) AS {sql_name(fact.name)}")
    return df.selectExpr(*out)


def type_warnings(facts: list[ColumnFacts]) -> list[str]:
    notes = []
    zeros = sorted(f.name for f in facts if f.leading_zero)[: V.MAX_WARNING_NAMES]
    mixed = sorted(f.name for f in facts if f.mixed)[: V.MAX_WARNING_NAMES]
    if zeros:
        notes.append("Digits with a leading zero stay text in: " + ", ".join(zeros))
    if mixed:
        notes.append(
            "Numbers among other texts stay text in: " + ", ".join(mixed)
        )
    return notes
