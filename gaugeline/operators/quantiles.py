"""Exact quantiles and tail counts of many columns without sorting or shuffling them.

1. One scan builds a mergeable KLL sketch of every column, with its count and range.  The
   sketch brackets each wanted quantile between two values a few thousandths of the ranks
   apart, and so brackets the outlier bounds that follow from the quartiles.
2. One scan counts the rows below, on and inside all brackets.  A wanted rank on an end
   point is known now.
3. One scan groups the values inside the brackets, a sliver of the table; wanted ranks are
   read off the groups, and so are the rows between a tail's certain part and its bound.

A bracket that is too big to be grouped is narrowed by a sketch of its inside, and one that
missed its rank is widened.  Sketches only steer: every answer is settled by counts over
the whole table.  All columns share each scan; the driver holds a few numbers per column.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.columns import finite_sql
from gaugeline.functions.local import small_table
from gaugeline.settings import DEFAULTS, Settings
from gaugeline.sources.files import materialized


@dataclass
class _Bracket:
    column: int
    prob: float
    ranks: tuple[int, ...]
    low: float
    high: float
    known: dict[int, float] = field(default_factory=dict)
    below_low: int = 0
    upto_low: int = 0
    below_high: int = 0
    upto_high: int = 0

    @property
    def open_ranks(self) -> list[int]:
        return [r for r in self.ranks if r not in self.known]

    @property
    def inside(self) -> int:
        return max(0, self.below_high - self.upto_low)

    def settle(self, counts: tuple[int, int, int, int], minimum: float, maximum: float) -> bool:
        """Use exact counts; return True when the bracket had to be widened."""
        self.below_low, self.upto_low, self.below_high, self.upto_high = counts
        missed_low = missed_high = False
        for r in self.open_ranks:
            if self.below_low <= r < self.upto_low:
                self.known[r] = self.low
            elif self.below_high <= r < self.upto_high:
                self.known[r] = self.high
            elif r < self.below_low:
                missed_low = True
            elif r >= self.upto_high:
                missed_high = True
        if missed_low:
            self.low = minimum
        if missed_high:
            self.high = maximum
        return missed_low or missed_high


@dataclass
class _Tail:
    """Rows beyond an outlier bound that is known to lie from ``low`` to ``high``."""

    column: int
    upper: bool
    low: float
    high: float
    beyond: int = 0
    inside: int = 0

    def test(self) -> str:
        """SQL: certainly beyond the bound."""
        x = f"x{self.column}"
        return f"{x} > {_number(self.high)}" if self.upper else f"{x} < {_number(self.low)}"

    def between(self) -> str:
        x = f"x{self.column}"
        return f"{x} >= {_number(self.low)} AND {x} <= {_number(self.high)}"


#: Sizes of sketches; a rank is off by about 2.3 / size ** 0.9 of all ranks at most (99 %).
SMALLEST_SKETCH, LARGEST_SKETCH = 8, 4096


def _sketch_size(settings: Settings) -> int:
    return max(SMALLEST_SKETCH, min(LARGEST_SKETCH, settings.quantile_accuracy))


def _spans(alias: str, column: str, spans: Sequence[tuple[float, float]], size: int) -> str:
    """SQL: two values around each span of ranks, from the sketch in ``column``."""
    margin = 4.6 / size**0.9
    points = ", ".join(
        f"{point!r}D" for low, high in spans for point in (max(0.0, low - margin), min(1.0, high + margin))
    )
    return f"kll_sketch_get_quantile_double({column}, array({points})) AS {alias}"


@dataclass
class Quantiles:
    """Finite rows of a column, its quantiles, and its rows outside of the outlier bounds."""

    column: str
    rows: int
    values: list[float | None]
    outliers: int | None = None


def solve(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], settings: Settings = DEFAULTS,
    reach: float | None = None,
) -> list[Quantiles]:
    """Interpolated quantiles of every column; values are None without rows.

    With ``reach`` and two quantiles, the rows that lie more than ``reach`` times their
    distance below the first or above the second are counted as well, in the same scans.
    ``outliers`` stays None where the sketch missed a rank or left too much between.
    """
    values = df.selectExpr(*[f"{finite_sql(df, c)} AS x{i}" for i, c in enumerate(columns)])
    size = _sketch_size(settings)
    places = range(len(columns))
    spans = [(p, p) for p in probs]
    first = values.selectExpr(
        *[f"{f}(x{i}) AS {tag}{i}" for i in places for tag, f in (("n", "count"), ("lo", "min"), ("hi", "max"))],
        *[f"kll_sketch_agg_double(x{i}, {size}) AS k{i}" for i in places],
    ).selectExpr(
        *[f"{tag}{i}" for i in places for tag in ("n", "lo", "hi")],
        # a sketch without values has no quantiles
        *[_spans(f"q{i}", f"CASE WHEN n{i} > 0 THEN k{i} END", spans, size) for i in places],
    ).first()
    brackets: list[_Bracket] = []
    for i in places:
        for j, p in enumerate(probs) if first[f"n{i}"] else ():
            place = p * (first[f"n{i}"] - 1)
            ranks = tuple(sorted({math.floor(place), math.ceil(place)}))
            brackets.append(_Bracket(i, p, ranks, *first[f"q{i}"][2 * j : 2 * j + 2]))
    tails = _tails(brackets, reach) if reach is not None else []
    groups = _search(values, brackets, tails, first, settings)
    solved = {(b.column, b.prob): b for b in brackets}
    out = []
    for i, name in enumerate(columns):
        n = first[f"n{i}"]
        found = [_interpolate(solved[i, p], p, n) if (i, p) in solved else None for p in probs]
        out.append(Quantiles(name, n, found))
    if reach is not None:
        _count_outliers(out, tails, groups, reach)
    return out


def quantile_values(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float] = (0.25, 0.75),
    settings: Settings = DEFAULTS,
) -> list[tuple[str, int, list[float | None]]]:
    """[(column, finite rows, interpolated quantiles)], values None without rows."""
    return [(q.column, q.rows, q.values) for q in solve(df, columns, probs, settings)]


def _tails(brackets: list[_Bracket], reach: float) -> list[_Tail]:
    """Where the bounds of outliers can lie, given the brackets of both quartiles."""
    tails = []
    for first, third in zip(brackets[::2], brackets[1::2]):
        nearest, farthest = third.low - first.high, third.high - first.low
        bounds = (first.low - reach * farthest, first.high - reach * nearest,
                  third.low + reach * nearest, third.high + reach * farthest)
        tails.append(_Tail(first.column, False, *bounds[:2]))
        tails.append(_Tail(first.column, True, *bounds[2:]))
    return tails


def _count_outliers(found: list[Quantiles], tails: list[_Tail], groups: DataFrame | None, reach: float) -> None:
    """Fill in the outliers of columns whose bounds lie in their tails' ranges."""
    bounds = {}
    for t, tail in enumerate(tails):
        q1, q3 = found[tail.column].values
        bound = q3 + reach * (q3 - q1) if tail.upper else q1 - reach * (q3 - q1)
        if tail.low <= bound <= tail.high:
            bounds[t] = bound
    between = dict.fromkeys(bounds, 0)
    open_ = [(t, b) for t, b in bounds.items() if tails[t].inside]
    if open_ and groups is not None:
        test = " OR ".join(
            f"(k = {_tail_number(t)} AND v {'>' if tails[t].upper else '<'} {_number(b)})" for t, b in open_
        )
        for row in groups.filter(test).groupBy("k").agg(F.sum("n").alias("n")).collect():
            between[-1 - row["k"]] = row["n"]
    for t in range(0, len(tails), 2):
        if t in bounds and t + 1 in bounds and (groups is not None or not (tails[t].inside or tails[t + 1].inside)):
            found[tails[t].column].outliers = sum(tails[k].beyond + between[k] for k in (t, t + 1))


def _tail_number(t: int) -> int:
    return -1 - t


def _number(value: float) -> str:
    """A double literal that keeps every digit."""
    return f"double('{value!r}')"


def _inside(b: _Bracket) -> str:
    return f"x{b.column} > {_number(b.low)} AND x{b.column} < {_number(b.high)}"


def _search(
    values: DataFrame, brackets: list[_Bracket], tails: list[_Tail], first, settings: Settings
) -> DataFrame | None:
    """Settle all brackets; returns the grouped values inside the tails, if they were grouped."""
    todo, groups, most = brackets, None, settings.quantile_finish_rows
    waiting = list(tails)
    while todo:
        exprs = []
        for k, b in enumerate(todo):
            x, low, high = f"x{b.column}", _number(b.low), _number(b.high)
            tests = (f"{x} < {low}", f"{x} <= {low}", f"{x} < {high}", f"{x} <= {high}")
            exprs += [f"count_if({test}) AS {tag}{k}" for tag, test in zip("abcd", tests)]
        for t, tail in enumerate(waiting):
            exprs += [f"count_if({tail.test()}) AS o{t}", f"count_if({tail.between()}) AS i{t}"]
        row = values.selectExpr(*exprs).first()
        for t, tail in enumerate(waiting):
            tail.beyond, tail.inside = row[f"o{t}"], row[f"i{t}"]
        widened = [
            b
            for k, b in enumerate(todo)
            if b.settle(
                tuple(row[f"{tag}{k}"] for tag in "abcd"),
                first[f"lo{b.column}"], first[f"hi{b.column}"],
            )
        ]
        left = [b for b in todo if b.open_ranks]
        small = [b for b in left if b not in widened and b.inside <= most]
        shown = [] if any(t.inside > most for t in waiting) else [(i, t) for i, t in enumerate(waiting) if t.inside]
        if small or shown:
            grouped = _grouped(values, small, shown)
            if shown:
                groups = grouped
            _rank_inside(grouped, small)
        big = [b for b in left if b not in widened and b.inside > most]
        if big:
            _narrow(values, big, settings)
        todo, waiting = widened + big, []
    return groups


def _narrow(values: DataFrame, brackets: list[_Bracket], settings: Settings) -> None:
    """Replace each bracket by a tighter one around the same ranks, from a sketch of its inside."""
    size = _sketch_size(settings)
    row = values.selectExpr(
        *[
            f"kll_sketch_agg_double(CASE WHEN {_inside(b)} THEN x{b.column} END, {size}) AS k{k}"
            for k, b in enumerate(brackets)
        ]
    ).selectExpr(
        *[
            _spans(f"q{k}", f"k{k}", [tuple((r - b.upto_low) / b.inside for r in (min(b.open_ranks), max(b.open_ranks)))], size)
            for k, b in enumerate(brackets)
        ]
    ).first()
    for k, b in enumerate(brackets):
        b.low, b.high = row[f"q{k}"]


def _grouped(values: DataFrame, brackets: list[_Bracket], tails: list[tuple[int, _Tail]]) -> DataFrame:
    """(k, v, n): how often each value inside a bracket (k from 0) or tail (k below 0) occurs."""
    hits = [f"CASE WHEN {_inside(b)} THEN struct({k} AS k, x{b.column} AS v) END" for k, b in enumerate(brackets)]
    hits += [
        f"CASE WHEN {t.between()} THEN struct({_tail_number(i)} AS k, x{t.column} AS v) END" for i, t in tails
    ]
    kept = values.selectExpr(f"inline(array_compact(array({', '.join(hits)})))")
    return materialized(kept.groupBy("k", "v").agg(F.count("*").alias("n")), "inside-brackets")


def _rank_inside(grouped: DataFrame, brackets: list[_Bracket]) -> None:
    """Read the wanted ranks off the grouped values.

    The input is bounded by ``quantile_finish_rows`` per bracket, so one window
    partition per bracket is bounded too.
    """
    if not brackets:
        return
    upto = F.sum("n").over(
        Window.partitionBy("k").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    )
    wanted = [(k, r, r - b.upto_low) for k, b in enumerate(brackets) for r in b.open_ranks]
    targets = small_table(grouped.sparkSession, wanted, "k int, rank bigint, local bigint")
    ranked = grouped.filter("k >= 0").withColumn("upto", upto)
    found = ranked.join(F.broadcast(targets), "k").filter(
        (F.col("local") < F.col("upto")) & (F.col("local") >= F.col("upto") - F.col("n"))
    )
    for hit in found.select("k", "rank", "v").collect():
        brackets[hit["k"]].known[hit["rank"]] = hit["v"]


def _interpolate(b: _Bracket, prob: float, n: int) -> float:
    place = prob * (n - 1)
    low, high = b.known[math.floor(place)], b.known[math.ceil(place)]
    return low + (high - low) * (place - math.floor(place))


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float] = (0.25, 0.75),
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """(column, finite_count, prob, quantile) as a small table."""
    rows = [
        (name, n, float(p), None if v is None else float(v))
        for name, n, found in quantile_values(df, columns, probs, settings)
        for p, v in zip(probs, found)
    ]
    return small_table(df.sparkSession, rows, "column string, finite_count bigint, prob double, quantile double"
    )
