"""IQR outliers and Pearson correlation over all numeric columns at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline import fixed_values as V
from gaugeline.columns import finite_sql, numeric_columns, sql_name, sql_text
from gaugeline.functions.local import small_table
from gaugeline.operators.distinct import union_all
from gaugeline.operators.metrics import ratio
from gaugeline.operators.quantiles import solve
from gaugeline.settings import DEFAULTS, Settings
from gaugeline.sources.files import materialized

def outliers(
    df: DataFrame, columns: Sequence[str] | None = None, settings: Settings = DEFAULTS
) -> DataFrame:
    """Outlier counts of every column against its exact bounds, from the scans of the quartiles.

    Columns whose bounds those scans left open share one scan more.
    """
    names = list(columns) if columns is not None else numeric_columns(df)
    solved = solve(df, names, (0.25, 0.75), settings, V.IQR_FACTOR)
    kept = [q for q in solved if q.rows >= V.OUTLIER_MIN_VALUES]
    bounds = []
    for q in kept:
        q1, q3 = q.values
        reach = V.IQR_FACTOR * (q3 - q1)
        bounds.append((q1 - reach, q3 + reach))
    open_ = [i for i, q in enumerate(kept) if q.outliers is None]
    if open_:
        row = df.selectExpr(*[f"{finite_sql(df, kept[i].column)} AS x{i}" for i in open_]).selectExpr(
            *[f"count_if(x{i} < double('{bounds[i][0]!r}') OR x{i} > double('{bounds[i][1]!r}')) AS o{i}" for i in open_]
        ).first()
        for i in open_:
            kept[i].outliers = row[f"o{i}"]
    rows = [(i, q.column, q.outliers, q.rows, *map(float, bounds[i])) for i, q in enumerate(kept)]
    table = small_table(
        df.sparkSession, rows,
        "position int, column string, outlier_count bigint, non_null_count bigint, raw_lower double, raw_upper double",
    )
    return table.select(
        "position", "column", "outlier_count",
        ratio(F.col("outlier_count"), F.col("non_null_count"), 2, 100.0).alias("outlier_pct"),
        F.round("raw_lower", 4).alias("lower_bound"),
        F.round("raw_upper", 4).alias("upper_bound"),
        "non_null_count", "raw_lower", "raw_upper",
    )


# pairs per aggregate when columns have gaps; each pair then needs its own sums
GAPPED_PAIRS_PER_PASS = 40


def pearson_pairs(
    df: DataFrame, columns: Sequence[str] | None = None, target: str | None = None
) -> DataFrame:
    """(position, left, right, r) for every pair of columns, pairwise-complete finite rows.

    A first scan takes count, mean and range of each column.  The second sums products
    of deviations from those means, which keeps the sums well conditioned and in plain
    generated code.  Two columns without gaps share their column sums with every other
    such pair; a pair with gaps sums over its own complete rows.  r is NULL when a
    column does not vary over the rows of the pair.  Tables of more than ``CODE_COLUMNS``
    columns are scanned once: each batch of rows gives the moments of all pairs about its own
    means as matrix products, and moments are merged in packed blocks.
    """
    names = [c for c in (columns if columns is not None else numeric_columns(df)) if c != target]
    if len(names) > CODE_COLUMNS:
        values = df.selectExpr(*[f"CAST({sql_name(c)} AS DOUBLE) AS x{i}" for i, c in enumerate(names)])
        return _pearson(_gram_moments(values, names))
    pairs = list(combinations(range(len(names)), 2))
    values = df.selectExpr(*[f"{finite_sql(df, c)} AS x{i}" for i, c in enumerate(names)])
    stats = [("n", "count"), ("m", "avg"), ("lo", "min"), ("hi", "max")]
    first = values.selectExpr(
        "count(*) AS total",
        *[f"{f}(x{i}) AS {tag}{i}" for i in range(len(names)) for tag, f in stats],
    ).first()
    total = first["total"]
    whole = {i for i in range(len(names)) if first[f"n{i}"] == total}
    varying = [first[f"lo{i}"] != first[f"hi{i}"] for i in range(len(names))]
    shifted = values.selectExpr(
        *[f"x{i} - double('{first[f'm{i}'] or 0.0!r}') AS d{i}" for i in range(len(names))]
    )
    shared = [(k, i, j) for k, (i, j) in enumerate(pairs) if i in whole and j in whole]
    gapped = [(k, i, j) for k, (i, j) in enumerate(pairs) if not (i in whole and j in whole)]
    jobs = []
    if shared:
        sums = [f"sum(d{i}) AS s{i}" for i in sorted(whole)]
        sums += [f"sum(d{i} * d{i}) AS q{i}" for i in sorted(whole)]
        sums += [f"sum(d{i} * d{j}) AS p{k}" for k, i, j in shared]
        rows = [
            _moments(
                k, names[i], names[j], f"{total}L", f"s{i}", f"s{j}", f"q{i}", f"q{j}", f"p{k}",
                str(varying[i] and varying[j]),
            )
            for k, i, j in shared
        ]
        jobs.append((sums, rows))
    for start in range(0, len(gapped), GAPPED_PAIRS_PER_PASS):
        sums, rows = [], []
        for k, i, j in gapped[start : start + GAPPED_PAIRS_PER_PASS]:
            left = f"CASE WHEN d{j} IS NOT NULL THEN d{i} END"
            right = f"CASE WHEN d{i} IS NOT NULL THEN d{j} END"
            sums += [
                f"count(d{i} * d{j}) AS n{k}", f"sum(d{i} * d{j}) AS p{k}",
                f"sum({left}) AS a{k}", f"sum({right}) AS b{k}",
                f"sum(({left}) * ({left})) AS u{k}", f"sum(({right}) * ({right})) AS v{k}",
                f"min({left}) < max({left}) AND min({right}) < max({right}) AS f{k}",
            ]
            rows.append(
                _moments(
                    k, names[i], names[j], f"n{k}", f"a{k}", f"b{k}", f"u{k}", f"v{k}", f"p{k}", f"f{k}"
                )
            )
        jobs.append((sums, rows))
    moments = union_all(
        shifted.selectExpr(*sums).selectExpr(f"inline(array({', '.join(rows)}))")
        for sums, rows in jobs
    )
    return _pearson(moments)


# columns above which generated code for all pairs grows too large
CODE_COLUMNS = 24
#: Columns of a block, columns whose matrices a task holds, and blocks merged by a task.
BLOCK_COLUMNS, TASK_COLUMNS, FAN_IN = 128, 1024, 32
#: Layers of a block for columns i (rows) and j over rows that have both: their number, the
#: means of i and j, sums of products of deviations from these, values that are the least and
#: greatest seen of i and of j.  The last four only tell whether i and j vary.
SUMS = ("n", "mx", "my", "sxx", "syy", "sxy")
LEAST, MOST = ("lox", "loy"), ("hix", "hiy")
LAYERS = (*SUMS, *LEAST, *MOST)
BLOCKS = "part bigint, left_block int, right_block int, data binary"
#: HotSpot runs longer methods uncompiled; Spark then evaluates expressions in smaller ones.
METHOD_BYTES = "8000"


@contextmanager
def _short_methods(spark: SparkSession):
    """Wide projections are not generated as one method that is too long to be compiled."""
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key, None)
    spark.conf.set(key, METHOD_BYTES)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def _merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two stacks of layers over different rows as one."""
    n = a[0] + b[0]
    share = b[0] / np.maximum(n, 1)
    dx, dy, weight = b[1] - a[1], b[2] - a[2], a[0] * share
    return np.stack([
        n, a[1] + dx * share, a[2] + dy * share,
        a[3] + b[3] + dx * dx * weight, a[4] + b[4] + dy * dy * weight, a[5] + b[5] + dx * dy * weight,
        *np.minimum(a[6:8], b[6:8]), *np.maximum(a[8:], b[8:]),
    ])


def _ranges(values: np.ndarray, there: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest values of columns i over rows that have i and j, for ``open_`` pairs (i, j).

    Other pairs get empty ranges.  Pairs that are known to vary stay so and need no look.
    """
    least, most = np.full(open_.shape, np.inf), np.full(open_.shape, -np.inf)
    asked = np.flatnonzero(open_.any(axis=1))
    if asked.size:
        low = np.where(there[:, asked], values[:, asked], np.inf)
        high = np.where(there[:, asked], values[:, asked], -np.inf)
        least[asked], most[asked] = low.min(axis=0)[:, None], high.max(axis=0)[:, None]
        # over all rows so far; columns with gaps restrict the rows of their pairs
        for j in np.flatnonzero(~there.all(axis=0)):
            least[:, j], most[:, j] = np.inf, -np.inf
            kept = np.flatnonzero(open_[asked, j])
            if kept.size:
                place = np.ix_(there[:, j], kept)
                least[asked[kept], j] = low[place].min(axis=0, initial=np.inf)
                most[asked[kept], j] = high[place].max(axis=0, initial=-np.inf)
    return least, most


def _gram_task(edge: int):
    """Task function: packed blocks of the moments of all pairs of columns, over finite values."""

    def square(values: np.ndarray, open_: np.ndarray) -> np.ndarray:
        there = np.isfinite(values)
        m = there.astype(float)
        x = np.where(there, values, 0.0)
        centre = x.sum(axis=0) / np.maximum(m.sum(axis=0), 1)
        x = np.where(there, x - centre, 0.0)
        n, s, q, p = m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x
        off = s / np.maximum(n, 1)
        mean = np.where(n > 0, centre[:, None] + off, 0.0)
        q = np.maximum(q - s * off, 0.0)
        least, most = _ranges(values, there, open_)
        return np.stack([n, mean, mean.T, q, q.T, p - s * off.T, least, least.T, most, most.T])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                values = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float, copy=False) for c in batch.columns])
                if total is None:
                    total = square(values, np.ones((values.shape[1],) * 2, bool))
                else:
                    total = _merge(total, square(values, ~(total[6] < total[8])))
        if total is None:
            return
        part, n = TaskContext.get().partitionId(), total.shape[1]
        for i in range(0, n, edge):
            for j in range(i, n, edge):
                data = np.ascontiguousarray(total[:, i : i + edge, j : j + edge]).tobytes()
                columns = [pa.array([part], pa.int64()), pa.array([i // edge], pa.int32()),
                           pa.array([j // edge], pa.int32()), pa.array([data], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "left_block", "right_block", "data"])

    return blocks


def _merger(columns: int, edge: int):
    """Group function: the packed blocks of one place as one."""

    def merged(table: pa.Table) -> pa.Table:
        i, j = table["left_block"][0].as_py(), table["right_block"][0].as_py()
        shape = len(LAYERS), min(edge, columns - i * edge), min(edge, columns - j * edge)
        total = None
        for data in table["data"]:
            found = np.frombuffer(data.as_buffer(), float).reshape(shape)
            total = found if total is None else _merge(total, found)
        first = table.slice(0, 1)
        return first.set_column(first.schema.get_field_index("data"), "data", pa.array([total.tobytes()], pa.binary()))

    return merged


def _unpacked(columns: int, edge: int):
    """Task function: a row for each pair of columns of merged blocks."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(batch.num_rows):
                i, j = batch.column("left_block")[b].as_py(), batch.column("right_block")[b].as_py()
                shape = len(LAYERS), min(edge, columns - i * edge), min(edge, columns - j * edge)
                data = np.frombuffer(batch.column("data")[b].as_buffer(), float).reshape(shape)
                x, y = np.indices(shape[1:])
                kept = (x + i * edge) < (y + j * edge)
                ids = [pa.array((v[kept] + k * edge).astype(np.int64)) for v, k in ((x, i), (y, j))]
                yield pa.RecordBatch.from_arrays(
                    [*ids, *[pa.array(layer[kept]) for layer in data]], names=["i", "j", *LAYERS]
                )

    return rows


def _gram_blocks(values: DataFrame, columns: int) -> DataFrame:
    """(i, j, moments) of all pairs of ``columns`` columns.

    A task sends its moments as packed blocks, which are merged ``FAN_IN`` at a time, level by
    level; no task holds more than that many blocks, however many tasks scan the table.
    """
    with _short_methods(values.sparkSession):
        blocks = materialized(values.mapInArrow(_gram_task(BLOCK_COLUMNS), BLOCKS), "gram-blocks")
    parts = (blocks.agg(F.max("part")).first()[0] or 0) + 1
    merge = _merger(columns, BLOCK_COLUMNS)
    while parts > 1:
        blocks = blocks.withColumn("part", F.floor(F.col("part") / FAN_IN))
        blocks = blocks.groupBy("part", "left_block", "right_block").applyInArrow(merge, BLOCKS)
        parts = -(-parts // FAN_IN)
    schema = "i bigint, j bigint, " + ", ".join(f"{s} double" for s in LAYERS)
    return blocks.mapInArrow(_unpacked(columns, BLOCK_COLUMNS), schema)


def _gram_moments(values: DataFrame, names: Sequence[str]) -> DataFrame:
    """Moments of all pairs; more than ``TASK_COLUMNS`` columns are taken two groups at a time."""
    half = TASK_COLUMNS // 2 if len(names) > TASK_COLUMNS else max(1, len(names))
    groups = [list(range(g, min(g + half, len(names)))) for g in range(0, len(names), half)]
    last, parts = len(groups) - 1, []
    for a, b in combinations(range(len(groups)), 2) if last else [(0, 0)]:
        chosen, n = (groups[a] + groups[b], len(groups[a])) if last else (groups[0], 0)
        found = _gram_blocks(values.select(*[f"x{i}" for i in chosen]), len(chosen))
        # pairs inside a group are taken from one of its jobs
        kept = (F.col("i") < n) & (F.col("j") >= n)
        if b == a + 1:
            kept |= F.col("j") < n
        if b == last and a >= last - 1:
            kept |= F.col("i") >= n
        place = F.array(*[F.lit(i).cast("bigint") for i in chosen])
        parts.append(found.filter(kept).withColumns({"i": F.get(place, "i"), "j": F.get(place, "j")}))
    moments = union_all(parts)
    listed = F.array(*[F.lit(n) for n in names])
    before = F.col("i") * len(names) - F.col("i") * (F.col("i") + 1) / 2
    # deviations from the means add up to zero
    zero = F.lit(0.0)
    varies = (F.col("lox") < F.col("hix")) & (F.col("loy") < F.col("hiy"))
    return moments.select(
        (before + F.col("j") - F.col("i") - 1).cast("int").alias("position"),
        F.get(listed, F.col("i")).alias("left"), F.get(listed, F.col("j")).alias("right"),
        "n", zero.alias("sx"), zero.alias("sy"), "sxx", "syy", "sxy", varies.alias("varies"),
    )


def _moments(k: int, left: str, right: str, *values: str) -> str:
    fields = ("n", "sx", "sy", "sxx", "syy", "sxy", "varies")
    shown = ", ".join(f"{v} AS {f}" for v, f in zip(values, fields))
    return f"struct({k} AS position, {sql_text(left)} AS `left`, {sql_text(right)} AS `right`, {shown})"


def _pearson(moments: DataFrame) -> DataFrame:
    varied = moments.selectExpr(
        "*", "n * sxx - sx * sx AS vx", "n * syy - sy * sy AS vy", "n * sxy - sx * sy AS vxy"
    )
    r = "greatest(-1.0D, least(1.0D, try_divide(vxy, sqrt(vx) * sqrt(vy))))"
    return varied.selectExpr(
        "position", "`left`", "`right`", f"CASE WHEN varies AND vx > 0 AND vy > 0 THEN {r} END AS r"
    )


def strong_correlations(
    df: DataFrame, columns: Sequence[str] | None = None, target: str | None = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Pairs whose unrounded |r| reaches the threshold."""
    return (
        pearson_pairs(df, columns, target)
        .filter(~F.isnan("r") & (F.abs("r") >= settings.correlation_threshold))
        .select("position", "left", "right", F.round("r", 4).alias("correlation"))
    )
