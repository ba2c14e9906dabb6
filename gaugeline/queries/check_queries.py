"""The eight checks over whole tables.

The given tables hold no gaps, copies or constants, so expressions valid in both
engines put some in by key.  They change values and never drop rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline import checks
from gaugeline.columns import identifier_named_column, inf_to_null
from gaugeline.operators import classes, distinct, findings, metrics, numeric, quantiles
from gaugeline.operators.distinct import union_all
from gaugeline.queries.registry import Tables, query, select_sql, union_sql

INF = "CAST('inf' AS DOUBLE)"
GAP_ORDERS = [
    "o_orderkey", "o_custkey",
    "CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice",
    "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority",
    "CASE WHEN o_orderkey % 40 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus",
    "o_orderdate",
]
FLAT_CUSTOMER = [
    "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment",
    "'same' AS fixed_text",
    "CASE WHEN c_custkey % 50 = 0 THEN 'rare' ELSE 'usual' END AS near_fixed",
    "CASE WHEN c_custkey % 40 = 0 THEN 1.5 ELSE NULL END AS mostly_null",
    "CAST(NULL AS DOUBLE) AS empty_column",
]
INF_EVENTS = [
    "event_id", "user_id",
    f"CASE WHEN event_id % 97 = 0 THEN {INF} WHEN event_id % 89 = 0 THEN -{INF} "
    "WHEN event_id % 13 = 0 THEN NULL ELSE value END AS value",
]
PAIR_LINES = [
    "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "2 * l_quantity + 1 AS quantity_line",
    "CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE -3 * l_extendedprice END AS price_line",
    "5 AS fixed_number",
]
NULLABLE = [
    "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus", "o_orderdate",
]
LINE_COLUMNS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]
LINE_NUMERIC = LINE_COLUMNS[:8]
CUSTOMER_COLUMNS = [e.rsplit(" ", 1)[-1] for e in FLAT_CUSTOMER]

GAPS_SQL = f"({select_sql('orders', GAP_ORDERS)}) t"
FLAT_SQL = f"({select_sql('customer', FLAT_CUSTOMER)}) t"


def _gaps(t: Tables) -> DataFrame:
    return t.orders.selectExpr(*GAP_ORDERS)


def _flat(t: Tables) -> DataFrame:
    return t.customer.selectExpr(*FLAT_CUSTOMER)


# -- profile and missing values ---------------------------------------------------------


def _profile_sql(source: str, columns: list[str]) -> str:
    return union_sql(
        [
            f"SELECT {i} AS position, '{c}' AS \"column\", count(*) AS row_count, "
            f"count(DISTINCT {c}) AS unique_count, count(*) - count({c}) AS null_count FROM {source}"
            for i, c in enumerate(columns)
        ]
    )


@query("profile_lineitem", _profile_sql("lineitem", LINE_COLUMNS))
def profile_lineitem(t: Tables) -> DataFrame:
    return metrics.dataset_profile(t.lineitem).drop("dtype", "kind")


@query("profile_orders_gaps", _profile_sql(GAPS_SQL, NULLABLE))
def profile_orders_gaps(t: Tables) -> DataFrame:
    return metrics.dataset_profile(_gaps(t)).drop("dtype", "kind")


_COUNTS = union_sql(
    [
        f"SELECT {i} AS position, '{c}' AS \"column\", count(*) AS row_count, "
        f"count(*) - count({c}) AS missing_count FROM {GAPS_SQL}"
        for i, c in enumerate(NULLABLE)
    ]
)
MISSING_SQL = (
    "SELECT position, \"column\", missing_count, row_count, missing_pct, "
    "CASE WHEN missing_pct > 30 THEN 'high' WHEN missing_pct >= 5 THEN 'medium' ELSE 'low' END AS severity "
    "FROM (SELECT *, round(missing_count * 100.0 / row_count, 2)::DOUBLE AS missing_pct "
    f"FROM ({_COUNTS}) c WHERE missing_count > 0) p"
)


@query("null_counts", _COUNTS)
def null_counts(t: Tables) -> DataFrame:
    return metrics.null_counts(_gaps(t))


@query("missing_values", MISSING_SQL)
def missing_values(t: Tables) -> DataFrame:
    return metrics.missing_values(_gaps(t))


@query(
    "missing_labels",
    "SELECT 'quality' AS \"column\", count(*) - count(l.quality) AS missing_count, count(*) AS row_count, "
    "round((count(*) - count(l.quality)) * 100.0 / count(*), 2)::DOUBLE AS missing_pct "
    "FROM documents d LEFT JOIN labels l USING (doc_id)",
)
def missing_labels(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("quality")
    return metrics.missing_values(joined).select("column", "missing_count", "row_count", "missing_pct")


# -- duplicates ---------------------------------------------------------------------------

_COPIES = "(SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 100 = 0) t"
DUPLICATE_SQL = (
    "SELECT count(*) AS row_count, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {s})) "
    "AS duplicate_count, round((count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {s}))) "
    "* 100.0 / count(*), 2)::DOUBLE AS duplicate_pct FROM {s}"
)


def _with_copies(t: Tables) -> DataFrame:
    return t.orders.unionByName(t.orders.filter("o_orderkey % 100 = 0"))


@query("duplicate_rows", DUPLICATE_SQL.format(s=_COPIES))
def duplicate_rows(t: Tables) -> DataFrame:
    return metrics.duplicate_rows(_with_copies(t))


@query("duplicate_rows_by_hash", DUPLICATE_SQL.format(s=_COPIES))
def duplicate_rows_by_hash(t: Tables) -> DataFrame:
    """The plan for large tables: hashes first, full rows only where a hash repeats."""
    return metrics.duplicate_rows(
        _with_copies(t), settings=checks.Settings(duplicate_hash_min_rows=0)
    )


_TEXTS = "(SELECT text, lang, source FROM documents) t"


@query("duplicate_documents", DUPLICATE_SQL.format(s=_TEXTS))
def duplicate_documents(t: Tables) -> DataFrame:
    texts = t.documents.select("text", "lang", "source")
    return metrics.duplicate_rows(texts, settings=checks.Settings(duplicate_hash_min_rows=0))


@query("distinct_row_count", f"SELECT count(*) AS distinct_rows FROM (SELECT DISTINCT * FROM {_COPIES})")
def distinct_row_count(t: Tables) -> DataFrame:
    return distinct.distinct_row_count(_with_copies(t))


# -- constants ------------------------------------------------------------------------------

DOMINANCE_SQL = union_sql(
    [
        f"SELECT {i} AS position, '{c}' AS \"column\", count(*) AS unique_count_including_null, "
        "max(n) AS dominant_count, CAST(sum(n) AS BIGINT) AS row_count "
        f"FROM (SELECT count(*) AS n FROM {FLAT_SQL} GROUP BY {c}) g"
        for i, c in enumerate(CUSTOMER_COLUMNS)
    ]
)
CONSTANT_SQL = (
    "SELECT *, CASE WHEN unique_count_including_null <= 1 THEN 'constant' ELSE 'near_constant' END AS kind "
    "FROM (SELECT *, round(dominant_count * 1.0 / row_count, 4)::DOUBLE AS dominant_ratio "
    f"FROM ({DOMINANCE_SQL}) d) r WHERE unique_count_including_null <= 1 OR dominant_ratio >= 0.95"
)


@query(
    "column_dominance",
    f'SELECT "column", unique_count_including_null, dominant_count, row_count FROM ({DOMINANCE_SQL}) d',
)
def column_dominance(t: Tables) -> DataFrame:
    return distinct.column_dominance(_flat(t))


@query("constant_columns", CONSTANT_SQL)
def constant_columns(t: Tables) -> DataFrame:
    return metrics.constant_columns(_flat(t))


@query("constant_columns_low_threshold", CONSTANT_SQL.replace(">= 0.95", ">= 0.2"))
def constant_columns_low_threshold(t: Tables) -> DataFrame:
    """Below the sketch guarantee every column is counted in full."""
    return metrics.constant_columns(_flat(t), checks.Settings(near_constant_ratio=0.2))


# -- cardinality, histograms, distinct counts --------------------------------------------------


def _cardinality_sql(table: str, columns: list[str]) -> str:
    parts = union_sql(
        [
            f"SELECT {i} AS position, '{c}' AS \"column\", count(DISTINCT {c}) AS unique_count, "
            f"count({c}) AS non_null_count FROM {table}"
            for i, c in enumerate(columns)
        ]
    )
    return (
        f"SELECT * FROM (SELECT *, round(unique_count * 1.0 / non_null_count, 4)::DOUBLE AS unique_ratio "
        f"FROM ({parts}) p WHERE non_null_count >= 20) r WHERE unique_ratio >= 0.9"
    )


@query("high_cardinality_customer", _cardinality_sql("customer", ["c_name", "c_mktsegment"]))
def high_cardinality_customer(t: Tables) -> DataFrame:
    return metrics.high_cardinality(t.customer)


@query("high_cardinality_events", _cardinality_sql("events", ["event_id", "ts", "user_id", "event_type", "props"]))
def high_cardinality_events(t: Tables) -> DataFrame:
    return metrics.high_cardinality(t.events)


@query("high_cardinality_documents", _cardinality_sql("documents", ["doc_id", "text", "lang", "source"]))
def high_cardinality_documents(t: Tables) -> DataFrame:
    """Long texts are counted by hash and compared in full only where hashes repeat."""
    return metrics.high_cardinality(t.documents)


@query(
    "distinct_counts",
    union_sql(
        [
            f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS unique_count, "
            f"count({c}) AS non_null_count, count(*) AS row_count FROM {GAPS_SQL}"
            for c in NULLABLE
        ]
    ),
)
def distinct_counts(t: Tables) -> DataFrame:
    return distinct.distinct_counts(_gaps(t), NULLABLE)


@query(
    "value_histogram",
    union_sql(
        [
            f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS n "
            f"FROM {GAPS_SQL} GROUP BY {c}"
            for c in ["o_custkey", "o_orderpriority", "o_orderstatus", "o_orderdate"]
        ]
    ),
)
def value_histogram(t: Tables) -> DataFrame:
    return distinct.value_histogram(_gaps(t), ["o_custkey", "o_orderpriority", "o_orderstatus", "o_orderdate"])


@query(
    "identifier_named_types",
    "SELECT p_type, count(*) AS n, count(*) FILTER (WHERE "
    "regexp_matches(lower(p_type || '_' || p_name), '(^|_)(id|key|uuid|code)($|_)') "
    "OR contains(lower(p_type || '_' || p_name), 'identifier')) AS identifier_named "
    "FROM (SELECT p_type, CASE WHEN p_partkey % 5 = 0 THEN replace(p_name, ' ', '_') || '_id' "
    "WHEN p_partkey % 5 = 1 THEN 'IDENTIFIER' || p_name ELSE replace(p_name, ' ', '_') END AS p_name "
    "FROM part) q GROUP BY p_type",
)
def identifier_named_types(t: Tables) -> DataFrame:
    names = t.part.selectExpr(
        "p_type",
        "CASE WHEN p_partkey % 5 = 0 THEN replace(p_name, ' ', '_') || '_id' "
        "WHEN p_partkey % 5 = 1 THEN 'IDENTIFIER' || p_name ELSE replace(p_name, ' ', '_') END AS p_name",
    )
    full = F.concat_ws("_", "p_type", "p_name")
    return names.groupBy("p_type").agg(
        F.count("*").alias("n"), F.count_if(identifier_named_column(full)).alias("identifier_named")
    )


# -- quartiles and outliers -------------------------------------------------------------------


def _finite_sql(column: str) -> str:
    return f"isfinite(CAST({column} AS DOUBLE))"


def _quartile_sql(source: str, columns: list[str]) -> str:
    return union_sql(
        [
            f"SELECT '{c}' AS \"column\", count(*) AS finite_count, {p}::DOUBLE AS prob, "
            f"round(quantile_cont(CAST({c} AS DOUBLE), {p}), 6) AS quantile FROM {source} "
            f"WHERE {_finite_sql(c)}"
            for c in columns
            for p in (0.25, 0.75)
        ]
    )


def _outlier_sql(source: str, columns: list[str]) -> str:
    parts = []
    for i, c in enumerate(columns):
        v = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT {i} AS position, '{c}' AS \"column\", count(*) FILTER (WHERE v < lo OR v > hi) AS outlier_count, "
            "round(count(*) FILTER (WHERE v < lo OR v > hi) * 100.0 / count(*), 2)::DOUBLE AS outlier_pct, "
            "round(any_value(lo), 6) AS lower_bound, round(any_value(hi), 6) AS upper_bound, "
            "count(*) AS non_null_count FROM "
            f"(SELECT {v} AS v, q[1] - 1.5 * (q[2] - q[1]) AS lo, q[2] + 1.5 * (q[2] - q[1]) AS hi FROM {source}, "
            f"(SELECT quantile_cont({v}, [0.25, 0.75]) AS q FROM {source} WHERE {_finite_sql(c)}) b "
            f"WHERE {_finite_sql(c)}) x HAVING count(*) >= 4"
        )
    return union_sql(parts)


def _outliers(df: DataFrame) -> DataFrame:
    """Bounds to six digits: quartiles of cents often end in a tie at the fifth."""
    found = numeric.outliers(df)
    return found.select(
        "position", "column", "outlier_count", "outlier_pct", F.round("raw_lower", 6).alias("lower_bound"),
        F.round("raw_upper", 6).alias("upper_bound"), "non_null_count",
    )


@query("iqr_outliers_lineitem", _outlier_sql("lineitem", LINE_NUMERIC))
def iqr_outliers_lineitem(t: Tables) -> DataFrame:
    return _outliers(t.lineitem)


@query("iqr_outliers_customer", _outlier_sql("customer", ["c_custkey", "c_nationkey", "c_acctbal"]))
def iqr_outliers_customer(t: Tables) -> DataFrame:
    return _outliers(t.customer)


@query(
    "iqr_outliers_infinite",
    _outlier_sql(f"({select_sql('events', INF_EVENTS)}) t", ["event_id", "user_id", "value"]),
)
def iqr_outliers_infinite(t: Tables) -> DataFrame:
    return _outliers(t.events.selectExpr(*INF_EVENTS))


@query("exact_quartiles", _quartile_sql("lineitem", LINE_NUMERIC))
def exact_quartiles(t: Tables) -> DataFrame:
    found = quantiles.exact_quantiles(t.lineitem, LINE_NUMERIC)
    return found.withColumn("quantile", F.round("quantile", 6))


@query(
    "infinite_to_null",
    "SELECT event_type, count(*) AS n, count(v) AS kept, count(*) FILTER (WHERE raw IS NOT NULL AND v IS NULL) AS replaced "
    "FROM (SELECT event_type, raw, CASE WHEN isinf(raw) THEN NULL ELSE raw END AS v FROM "
    f"(SELECT event_type, {INF_EVENTS[2].rsplit(' AS ', 1)[0]} AS raw FROM events) r) s GROUP BY event_type",
)
def infinite_to_null(t: Tables) -> DataFrame:
    raw = t.events.selectExpr("event_type", INF_EVENTS[2])
    clean = raw.withColumn("v", inf_to_null(F.col("value")))
    return clean.groupBy("event_type").agg(
        F.count("*").alias("n"), F.count("v").alias("kept"),
        F.count_if(F.col("value").isNotNull() & F.col("v").isNull()).alias("replaced"),
    )


# -- classes ----------------------------------------------------------------------------------


def _classes_sql(source: str, target: str, order: str) -> str:
    return (
        "SELECT row_number() OVER (ORDER BY n DESC, seen) AS position, class, n AS count, "
        "round(n * 1.0 / sum(n) OVER (), 4)::DOUBLE AS proportion, "
        "round(n * 100.0 / sum(n) OVER (), 4)::DOUBLE AS percentage FROM "
        f"(SELECT CAST({target} AS VARCHAR) AS class, count(*) AS n, min({order}) AS seen FROM {source} "
        f"WHERE {target} IS NOT NULL GROUP BY {target}) g"
    )


def _imbalance_sql(source: str, target: str, order: str) -> str:
    return (
        "SELECT *, CASE WHEN majority_minority_ratio >= 9 THEN 'high' "
        "WHEN majority_minority_ratio >= 3 THEN 'medium' END AS severity FROM "
        "(SELECT count(*) AS classes, min_by(class, position) AS majority_class, "
        "max_by(class, position) AS minority_class, "
        "round(max(count) * 1.0 / min(count), 4)::DOUBLE AS majority_minority_ratio "
        f"FROM ({_classes_sql(source, target, order)}) c) s"
    )


@query("class_distribution_events", _classes_sql("events", "event_type", "event_id"))
def class_distribution_events(t: Tables) -> DataFrame:
    return classes.class_distribution(t.events, "event_type", ["event_id"])


@query("class_distribution_scan_order", _classes_sql("lineitem", "l_returnflag", "l_orderkey * 0"))
def class_distribution_scan_order(t: Tables) -> DataFrame:
    """Ties, were there any, follow file and row position of the scan."""
    return classes.class_distribution(t.lineitem, "l_returnflag")


@query("class_order_ties", _classes_sql("nation", "n_regionkey", "n_nationkey"))
def class_order_ties(t: Tables) -> DataFrame:
    """All regions hold the same number of nations: only the source order decides."""
    return classes.class_distribution(t.nation, "n_regionkey", ["n_nationkey"])


@query("class_distribution_customers", _classes_sql("orders", "o_custkey", "o_orderkey"))
def class_distribution_customers(t: Tables) -> DataFrame:
    """A target with a class for every customer, ranked in full."""
    return classes.class_distribution(t.orders, "o_custkey", ["o_orderkey"])


@query("class_imbalance_customers", _imbalance_sql("orders", "o_custkey", "o_orderkey"))
def class_imbalance_customers(t: Tables) -> DataFrame:
    return classes.class_imbalance(t.orders, "o_custkey", ["o_orderkey"])


@query("class_imbalance_toxic", _imbalance_sql("labels", "toxic", "doc_id"))
def class_imbalance_toxic(t: Tables) -> DataFrame:
    return classes.class_imbalance(t.labels, "toxic", ["doc_id"])


_ROLE_SQL = (
    "(SELECT o_orderkey, CASE WHEN o_orderkey % 12 = 0 THEN 'rare' WHEN o_orderkey % 5 = 0 THEN NULL "
    "ELSE 'usual' END AS flag FROM orders) t"
)


@query("class_imbalance_gaps", _imbalance_sql(_ROLE_SQL, "flag", "o_orderkey"))
def class_imbalance_gaps(t: Tables) -> DataFrame:
    flagged = t.orders.selectExpr(
        "o_orderkey",
        "CASE WHEN o_orderkey % 12 = 0 THEN 'rare' WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'usual' END AS flag",
    )
    return classes.class_imbalance(flagged, "flag", ["o_orderkey"])


@query(
    "target_guard",
    "SELECT count(DISTINCT text) AS unique_classes, max(strlen(text)) AS max_label_bytes, "
    "count(text) AS observed_rows FROM documents",
)
def target_guard(t: Tables) -> DataFrame:
    return classes.target_guard(t.documents, "text")


# -- correlation -------------------------------------------------------------------------------


def _pairs_sql() -> str:
    names = [e.rsplit(" ", 1)[-1] for e in PAIR_LINES]
    source = f"({select_sql('lineitem', PAIR_LINES)}) t"
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    corr = ", ".join(
        f"corr({a}, {b}) FILTER (WHERE {_finite_sql(a)} AND {_finite_sql(b)}) AS r{k}"
        for k, (a, b) in enumerate(pairs)
    )
    rows = union_sql(
        [f"SELECT {k} AS position, '{a}' AS \"left\", '{b}' AS \"right\", r{k} AS r FROM w" for k, (a, b) in enumerate(pairs)]
    )
    return (
        f"WITH w AS (SELECT {corr} FROM {source}) SELECT position, \"left\", \"right\", "
        f"CASE WHEN isnan(r) THEN NULL ELSE round(r, 6) + 0.0 END AS r FROM ({rows}) p"
    )


@query("pearson_pairs", _pairs_sql())
def pearson_pairs(t: Tables) -> DataFrame:
    pairs = numeric.pearson_pairs(t.lineitem.selectExpr(*PAIR_LINES))
    return pairs.withColumn("r", F.round("r", 6) + F.lit(0.0))


@query(
    "strong_correlations",
    f"SELECT position, \"left\", \"right\", round(r, 4) AS correlation FROM ({_pairs_sql()}) s WHERE abs(r) >= 0.95",
)
def strong_correlations(t: Tables) -> DataFrame:
    return numeric.strong_correlations(t.lineitem.selectExpr(*PAIR_LINES))


# 60 columns, a third of them with gaps; the divisors make some pairs related
_WIDE = [
    f"CASE WHEN {k} % 3 = 0 AND (l_orderkey + {k}) % 5 = 0 THEN NULL ELSE "
    f"CAST((l_partkey * {1 + k % 7} + l_suppkey * {k % 4} + l_linenumber * {k}) % {50 + 3 * k} AS DOUBLE) END AS w{k:02d}"
    for k in range(60)
]


def _wide_sql() -> str:
    pairs = [(f"w{i:02d}", f"w{j:02d}") for i in range(60) for j in range(i + 1, 60)]
    found = ", ".join(f"round(corr({a}, {b}), 6)" for a, b in pairs)
    listed = ", ".join(f"'{a} {b}'" for a, b in pairs)
    return (
        f"SELECT CAST(p - 1 AS INTEGER) AS position, pair[1:3] AS \"left\", pair[5:7] AS \"right\", r + 0.0 AS r FROM (SELECT "
        f"unnest(range(1, {len(pairs) + 1})) AS p, unnest([{listed}]) AS pair, unnest(rs) AS r FROM "
        f"(SELECT [{found}] AS rs FROM (SELECT {', '.join(_WIDE)} FROM lineitem) w) s) u"
    )


@query("pearson_pairs_wide", _wide_sql())
def pearson_pairs_wide(t: Tables) -> DataFrame:
    """All 1,770 pairs of 60 columns by matrix products."""
    pairs = numeric.pearson_pairs(t.lineitem.selectExpr(*_WIDE))
    return pairs.withColumn("r", F.round("r", 6) + F.lit(0.0))


# -- findings and the suite -----------------------------------------------------------------------


@query(
    "findings_missing",
    "SELECT 'Missing values' AS issue, severity, \"column\", "
    "missing_count || '/' || row_count || ' values missing (' || missing_pct || '%)' AS evidence "
    f"FROM ({MISSING_SQL}) m",
)
def findings_missing(t: Tables) -> DataFrame:
    found = findings.missing_findings(metrics.missing_values(_gaps(t)))
    return found.select("issue", "severity", "column", "evidence")


@query(
    "findings_constant",
    "SELECT CASE WHEN kind = 'constant' THEN 'Constant column' ELSE 'Near-constant column' END AS issue, "
    "CASE WHEN kind = 'constant' THEN 'medium' ELSE 'low' END AS severity, \"column\", "
    "unique_count_including_null || ' distinct values including null; dominant fraction ' || "
    "CAST(CAST(dominant_ratio * 100 AS DECIMAL(10, 2)) AS VARCHAR) || '%' AS evidence "
    f"FROM ({CONSTANT_SQL}) c",
)
def findings_constant(t: Tables) -> DataFrame:
    found = findings.constant_findings(metrics.constant_columns(_flat(t)))
    return found.select("issue", "severity", "column", "evidence")


@query(
    "findings_cardinality",
    "SELECT 'High-cardinality feature' AS issue, 'low' AS severity, \"column\", unique_count || '/' || "
    "non_null_count || ' non-null values unique (ratio ' || unique_ratio || ')' AS evidence "
    f"FROM ({_cardinality_sql('documents', ['doc_id', 'text', 'lang', 'source'])}) c",
)
def findings_cardinality(t: Tables) -> DataFrame:
    found = findings.cardinality_findings(metrics.high_cardinality(t.documents))
    return found.select("issue", "severity", "column", "evidence")


@query(
    "findings_duplicates",
    "SELECT 'Duplicate rows' AS issue, 'medium' AS severity, CAST(NULL AS VARCHAR) AS \"column\", "
    "duplicate_count || '/' || row_count || ' rows duplicate earlier rows (' || duplicate_pct || '%)' AS evidence "
    f"FROM ({DUPLICATE_SQL.format(s=_COPIES)}) d WHERE duplicate_count > 0",
)
def findings_duplicates(t: Tables) -> DataFrame:
    found = findings.duplicate_findings(metrics.duplicate_rows(_with_copies(t)))
    return found.select("issue", "severity", "column", "evidence")


@query(
    "findings_outliers",
    "SELECT 'IQR outliers' AS issue, 'medium' AS severity, \"column\", outlier_count || '/' || non_null_count || ' values outside [' || "
    "printf('%.4g', lower_bound) || ', ' || printf('%.4g', upper_bound) || '] (' || outlier_pct || '%)' AS evidence FROM "
    f"({_outlier_sql('orders', ['o_orderkey', 'o_custkey', 'o_totalprice'])} UNION ALL "
    f"{_outlier_sql('(SELECT event_id, user_id, value FROM events) t', ['event_id', 'user_id', 'value'])}) o "
    "WHERE outlier_count > 0",
)
def findings_outliers(t: Tables) -> DataFrame:
    both = numeric.outliers(t.orders).unionByName(numeric.outliers(t.events.select("event_id", "user_id", "value")))
    return findings.outlier_findings(both).select("issue", "severity", "column", "evidence")


@query(
    "findings_correlation",
    "SELECT 'Strong feature correlation' AS issue, \"left\" || ', ' || \"right\" AS \"column\", "
    "'Pearson r(' || \"left\" || ', ' || \"right\" || ') = ' || CAST(round(r, 4) AS VARCHAR) AS evidence "
    f"FROM ({_pairs_sql()}) s WHERE abs(r) >= 0.95",
)
def findings_correlation(t: Tables) -> DataFrame:
    pairs = numeric.strong_correlations(t.lineitem.selectExpr(*PAIR_LINES))
    return findings.correlation_findings(pairs).select("issue", "column", "evidence")


@query(
    "findings_imbalance",
    "SELECT 'Class imbalance' AS issue, severity, 'flag' AS \"column\", 'Majority/minority ratio ' || "
    "majority_minority_ratio || ':1; counts [' || entries || ']' AS evidence FROM "
    f"({_imbalance_sql(_ROLE_SQL, 'flag', 'o_orderkey')}) s, (SELECT string_agg('{{''class'': ''' || class || "
    "''', ''count'': ' || count || ', ''proportion'': ' || proportion || ', ''percentage'': ' || percentage || '}', "
    f"', ' ORDER BY position) AS entries FROM ({_classes_sql(_ROLE_SQL, 'flag', 'o_orderkey')}) c) e "
    "WHERE severity IS NOT NULL".replace("{{", "{"),
)
def findings_imbalance(t: Tables) -> DataFrame:
    flagged = t.orders.selectExpr(
        "o_orderkey",
        "CASE WHEN o_orderkey % 12 = 0 THEN 'rare' WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'usual' END AS flag",
    )
    spread = classes.class_distribution(flagged, "flag", ["o_orderkey"])
    found = findings.imbalance_findings(spread, classes.summarize_classes(spread), "flag")
    return found.select("issue", "severity", "column", "evidence")


def _count_sql(tool: str, sql: str) -> str:
    return f"SELECT '{tool}' AS tool, 'ok' AS status, count(*) AS findings FROM ({sql}) q"


@query(
    "suite_observations",
    union_sql(
        [
            _count_sql("missing_values_check", MISSING_SQL),
            "SELECT 'dataset_profile', 'ok', count(*) * 0 FROM orders",
            f"SELECT 'duplicate_rows_check', 'ok', count(*) FROM ({DUPLICATE_SQL.format(s=GAPS_SQL)}) d WHERE duplicate_count > 0",
            "SELECT 'constant_columns_check', 'ok', count(*) FROM (SELECT max(n) * 1.0 / sum(n) AS share FROM "
            f"(SELECT count(*) AS n FROM {GAPS_SQL} GROUP BY o_orderstatus) g) h WHERE share >= 0.95",
            _count_sql(
                "high_cardinality_check",
                _cardinality_sql(GAPS_SQL, ["o_orderpriority", "o_orderstatus", "o_orderdate"]),
            ),
            "SELECT 'outlier_check', 'ok', count(*) FROM "
            f"({_outlier_sql(GAPS_SQL, ['o_orderkey', 'o_custkey', 'o_totalprice'])}) o WHERE outlier_count > 0",
            f"SELECT 'class_imbalance_check', 'ok', count(*) FROM ({_imbalance_sql(GAPS_SQL, 'o_orderstatus', 'o_orderkey')}) i WHERE severity IS NOT NULL",
            "SELECT 'correlation_check', 'ok', count(*) FROM (SELECT corr(o_orderkey, o_custkey) AS a, "
            f"corr(o_orderkey, o_totalprice) AS b, corr(o_custkey, o_totalprice) AS c FROM {GAPS_SQL}) k "
            "WHERE greatest(abs(a), abs(b), abs(c)) >= 0.95",
        ]
    ),
)
def suite_observations(t: Tables) -> DataFrame:
    observed = checks.suite(_gaps(t), target="o_orderstatus")
    return observed.select("tool", "status", F.size("findings").cast("bigint").alias("findings"))


@query(
    "skip_reasons",
    "SELECT 'class_imbalance_check' AS tool, CASE WHEN max(strlen(text)) > 256 THEN 'skipped' ELSE 'ok' END AS status, "
    "1 AS columns_checked, 0 AS columns_omitted FROM documents UNION ALL "
    "SELECT 'correlation_check', CASE WHEN count(*) > 0 THEN 'skipped' ELSE 'ok' END, 0, 2 FROM documents",
)
def skip_reasons(t: Tables) -> DataFrame:
    """A free-text target and more numeric columns than the limit allows."""
    tight = checks.Settings(max_numeric_columns=1, max_label_bytes=256)
    observed = checks.suite(t.documents, ["class_imbalance_check", "correlation_check"], "text", tight)
    return observed.select(
        "tool", "status", F.size("execution.columns_checked").alias("columns_checked"),
        F.col("execution.columns_omitted").alias("columns_omitted"),
    )


@query(
    "quartile_admission",
    union_sql([
        f"SELECT {step} AS step, CASE WHEN count(*) FILTER (WHERE o_orderkey % {step} = 0) * 24 > 24000 THEN 'skipped' ELSE 'ok' END AS status FROM orders"
        for step in (1, 5, 40)
    ]),
)
def quartile_admission(t: Tables) -> DataFrame:
    """Whether quartiles are admitted depends on the finite values of a column, not on the rows."""
    tight, found = checks.Settings(max_quantile_bytes=48_000), []
    for step in (1, 5, 40):
        column = t.orders.selectExpr(f"CASE WHEN o_orderkey % {step} = 0 THEN o_totalprice END AS v")
        found.append(checks.suite(column, ["outlier_check"], settings=tight).select(F.lit(step).alias("step"), "status"))
    return union_all(found)


@query("flagship_suite")
def flagship_suite(t: Tables) -> DataFrame:
    """Every check over lineitem: status, coverage and findings."""
    observed = checks.suite(t.lineitem, target="l_returnflag")
    return observed.select(
        "sequence", "tool", "status", "summary", F.size("findings").alias("findings"),
        F.size("execution.columns_checked").alias("columns_checked"),
        F.col("execution.columns_omitted").alias("columns_omitted"),
    )
