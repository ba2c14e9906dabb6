"""Bounded observations, schema context and the JSON evidence export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline import fixed_values as V
from gaugeline.checks import Dataset, as_dataset
from gaugeline.columns import categorical_columns, leading_columns, numeric_columns
from gaugeline.functions.local import small_table
from gaugeline.functions.sanitize import nonfinite_to_null
from gaugeline.operators.findings import FINDING_FIELDS, leading_rows
from gaugeline.settings import DEFAULTS, Settings


def bound_observations(observations: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Limit what each observation carries and disclose what was left out.

    At most ``max_findings_per_tool`` findings stay.  Beyond the byte budget, the details in
    ``data`` (JSON text, if there is such a column) go first, then findings from the last on,
    and an observation whose header alone is too long is passed on as skipped.  A column
    ``nonfinite`` counts statistics that were replaced by null.  ``findings_total`` is the
    number of findings there are, if the array is short of some already
    (:func:`observed_findings`).  The complete findings remain in the input table.
    """
    if "findings_total" in observations.columns:
        total = F.col("findings_total")
    else:
        total = F.coalesce(F.size("findings"), F.lit(0))
    listed = F.slice(F.coalesce("findings", F.array()), 1, settings.max_findings_per_tool)
    head = F.octet_length(F.to_json(F.struct("tool", "status", "summary")))
    sizes = F.transform("kept", lambda f: F.octet_length(F.to_json(f)))
    budget = settings.max_observation_bytes
    data = F.col("data") if "data" in observations.columns else F.lit(None).cast("string")
    data_size = F.coalesce(F.octet_length(data), F.lit(0))
    all_sizes = F.aggregate(sizes, F.lit(0).cast("bigint"), lambda acc, s: acc + s)
    # running total of sizes: fold to (sum, fitting), stop growing at the first overflow
    zero = F.struct(F.col("head").cast("bigint").alias("used"), F.lit(0).alias("fitting"))
    step = F.aggregate(
        sizes, zero,
        lambda acc, s: F.struct(
            (acc["used"] + s).alias("used"),
            F.when(
                acc["used"] + s <= budget, acc["fitting"] + 1
            ).otherwise(acc["fitting"]).alias("fitting"),
        ),
        lambda acc: acc["fitting"],
    )
    out = (
        observations.withColumn("findings_total", total)
        .withColumn("kept", listed)
        .withColumn("head", head)
        .withColumn("data_omitted", (data_size > 0) & (F.col("head") + data_size + all_sizes > budget))
        .withColumn("fitting", F.when(F.col("data_omitted") | (data_size == 0), step).otherwise(F.size("kept")))
        .withColumn("oversize", F.col("head") > budget)
    )
    kept = F.when(F.col("oversize"), F.slice("kept", 1, 0)).otherwise(F.slice("kept", 1, F.col("fitting")))
    omitted = F.col("findings_total") - F.size("findings")
    return (
        out.withColumn("findings", kept)
        .withColumn("findings_omitted", omitted)
        .withColumn("output_limited", F.col("oversize") | F.col("data_omitted") | (F.col("findings_omitted") > 0))
        .withColumns({"data": F.when(F.col("data_omitted") | F.col("oversize"), F.lit("{}")).otherwise(data)} if "data" in observations.columns else {})
        .withColumns(
            {"coverage_limitation": F.when(F.col("nonfinite") > 0, F.lit(V.NONFINITE_LIMITATION))}
            if "nonfinite" in observations.columns else {}
        )
        .withColumn("status", F.when(F.col("oversize"), "skipped").otherwise(F.col("status")))
        .withColumn(
            "summary", F.when(F.col("oversize"), V.OVERSIZE_SUMMARY).otherwise(F.col("summary"))
        )
        .withColumn(
            "output_limitation",
            F.when(F.col("oversize"), V.OVERSIZE_LIMITATION).when(
                F.col("output_limited"), V.OUTPUT_LIMITATION
            ),
        )
        .drop("kept", "head", "fitting", "oversize")
    )


def observed_findings(
    observations: DataFrame, findings: DataFrame, keys: list[str], settings: Settings = DEFAULTS
) -> DataFrame:
    """Observations with the leading findings of each as an array, and ``findings_total`` of all.

    Only the rows that may stay are gathered: a rank filter keeps them before the shuffle.
    """
    totals = findings.groupBy(*keys).agg(F.count("*").alias("findings_total"))
    top = leading_rows(findings, keys, "position", settings.max_findings_per_tool)
    joined = observations.join(finding_array(top, keys), keys, "left").join(totals, keys, "left")
    return joined.withColumn("findings_total", F.coalesce("findings_total", F.lit(0)))


def bounded_data(data: dict, settings: Settings = DEFAULTS) -> tuple[dict, dict]:
    """Trim long lists and mappings of one check's data; also returns how much was left out."""
    caps = {list: settings.max_findings_per_tool, dict: settings.max_schema_columns or None}
    kept, omitted = {}, {}
    for name, value in data.items():
        cap = caps.get(type(value))
        if cap is not None and len(value) > cap:
            omitted[name] = len(value) - cap
            value = dict(list(value.items())[:cap]) if isinstance(value, dict) else value[:cap]
        kept[name] = value
    return kept, omitted


def bounded_entries(entries: DataFrame, keys: list[str], order: str, limit: int) -> DataFrame:
    """First ``limit`` entries of each list plus the number left out, for long data lists."""
    totals = entries.groupBy(*keys).agg(F.count("*").alias("total"))
    kept = leading_rows(entries, keys, order, limit).drop("rank").join(totals, keys)
    return kept.withColumn("entries_omitted", F.greatest(F.lit(0), F.col("total") - limit)).drop("total")


def schema_context(
    source: DataFrame | Dataset, target: str | None = None, settings: Settings = DEFAULTS
) -> DataFrame:
    """(position, name, dtype, kind, is_target, rows, columns_omitted) of the columns shown.

    Column types only; cell values never enter it.  A target is always among the columns.
    """
    ds = as_dataset(source)
    numeric, categorical = set(numeric_columns(ds.df)), set(categorical_columns(ds.df))
    shown = leading_columns(ds.columns, settings.max_schema_columns, target)
    rows = [
        (
            ds.columns.index(c), c, ds.dtypes[c],
            "numeric" if c in numeric else "categorical" if c in categorical else "other",
            c == target, ds.row_count, len(ds.columns) - len(shown),
        )
        for c in shown
    ]
    return small_table(
        ds.df.sparkSession, rows,
        "position int, name string, dtype string, kind string, is_target boolean, rows bigint, columns_omitted int",
    )


def evidence_bundle(
    observations: DataFrame, reports: DataFrame, datasets: DataFrame, exported_utc: Column | None = None
) -> DataFrame:
    """(run_id, bundle): one strict-JSON document per run, non-finite numbers as null.

    ``datasets`` holds one row of dataset facts per run.  A run's events are bounded by
    the attempt limit, so the collected list per run is too.
    """
    clean = nonfinite_to_null(observations, "replaced")
    fields = [c for c in observations.columns if c != "run_id"]
    traces = clean.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct("sequence", *[c for c in fields if c != "sequence"]))).alias("trace"),
        F.sum("replaced").alias("replaced"),
    )
    facts = nonfinite_to_null(datasets, "replaced_facts")
    about = F.struct(*[c for c in datasets.columns if c != "run_id"]).alias("dataset")
    described = facts.select("run_id", "replaced_facts", about)
    report = F.struct(*[c for c in reports.columns if c not in ("run_id", "question", "target")])
    written = reports.select("run_id", "question", "target", report.alias("report"))
    joined = traces.join(described, "run_id").join(written, "run_id", "left")
    count = F.col("replaced") + F.col("replaced_facts")
    note = F.when(
        count > 0, F.concat(count.cast("string"), F.lit(" non-finite statistics were represented as null."))
    )
    stamp = exported_utc if exported_utc is not None else F.current_timestamp()
    body = F.struct(
        F.lit(1).alias("schema_version"), stamp.cast("string").alias("exported_utc"), "dataset",
        "question", "target", "trace", "report", note.alias("serialization_note"),
    )
    return joined.select("run_id", F.to_json(body).alias("bundle"))


def write_evidence(bundles: DataFrame, path: str) -> None:
    """One JSON document per line."""
    bundles.select("bundle").write.mode("overwrite").text(path)


def finding_array(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Findings rows folded into one array per key, in position order.

    Callers bound the rows per key first (:func:`top_findings`).
    """
    entry = F.struct("position", F.struct(*FINDING_FIELDS).alias("f"))
    ordered = F.array_sort(F.collect_list(entry))
    return findings.groupBy(*keys).agg(F.transform(ordered, lambda x: x["f"]).alias("findings"))
