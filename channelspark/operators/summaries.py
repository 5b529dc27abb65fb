"""Summaries over metric tables: descriptive statistics, reports, normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from channelspark.functions import complex as C
from channelspark.functions import geometry as G
from channelspark.functions.grid import histogram_bin
from channelspark.operators.quantiles import exact_quantiles, quantile_summary
from channelspark.session import stored


def unpivot_metrics(table: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return table.unpivot(list(ids), list(metrics), "metric", "value")


def metric_summary(long: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Finite count, min, median, mean and max per group."""
    rows = long.select(*keys, C.nan_to_null(F.col(value)).alias("v"))
    found = quantile_summary(rows, keys, "v", {"median": 0.5})
    return found.select(*keys, F.col("n").alias("finite_count"), "min", F.try_divide("sum", "n").alias("mean"), "max", "median")


def ranging_summary(ranging: DataFrame) -> DataFrame:
    """Per estimator: success share and mean, median, 80th and 95th percentile absolute error."""
    error = F.abs(F.col("range_m") - F.col("truth_m"))
    ok = F.col("success") & C.is_finite(error)
    rows = ranging.select("estimator", "success", F.when(ok, error).alias("e"))
    found = quantile_summary(
        rows, ["estimator"], "e", {"median_abs_m": 0.5, "p80_abs_m": 0.8, "p95_abs_m": 0.95}, {"successes": F.col("success")}
    )
    return found.select(
        "estimator", F.col("rows").alias("total"), "successes", (F.col("n") / F.col("rows")).alias("finite_rate"),
        F.try_divide("sum", "n").alias("mean_abs_m"), "median_abs_m", "p80_abs_m", "p95_abs_m",
    )


def estimator_vs_truth(ranging: DataFrame) -> DataFrame:
    """Truth, estimate and error of the successful estimates."""
    return ranging.where("success").select(
        "estimator", "truth_m", "range_m", (F.col("range_m") - F.col("truth_m")).alias("error_m")
    )


def worst_link(evaluation: DataFrame, link: Sequence[str]) -> Column:
    """Link with the largest NMSE over all links; the first link wins a tie."""
    return F.min_by(
        F.struct(*link, "nmse_db"),
        F.struct((-F.col("nmse_db")).alias("neg"), *[F.col(c) for c in link]),
    )


def diagnostics_report(evaluation: DataFrame, link: Sequence[str], success: str = "valid") -> DataFrame:
    """Run report: medians over valid links, rates, failures and the worst link of all.

    A link failed if its estimation did not succeed, which ``success`` tells; validity is the
    default where the table keeps no estimation outcome.
    """
    valid = F.col("valid")
    report = evaluation.agg(
        F.count(F.lit(1)).alias("num_links"), F.count_if(~F.col(success)).alias("num_failed_links"),
        F.avg(valid.cast("double")).alias("detection_rate"),
        worst_link(evaluation, link).alias("w"),
    )
    values = evaluation.select(
        F.when(valid, F.col("nmse_db")).alias("median_nmse_db"),
        F.when(valid, F.col("snr_db")).alias("median_snr_db"),
        F.when(valid, F.abs("phase_err_rad")).alias("median_phase_error_rad"),
    )
    names = values.columns
    medians = exact_quantiles(
        values.unpivot([], names, "metric", "value"), ["metric"], "value", {"m": 0.5}
    )

    row = medians.agg(F.struct(*[
        F.coalesce(F.max(F.when(F.col("metric") == n, F.col("m"))), F.lit(0.0)).alias(n)
        for n in names
    ])).scalar()
    return report.select(
        "num_links", "num_failed_links", "detection_rate",
        (1 - F.col("detection_rate")).alias("failure_rate"),
        *[F.col(f"w.{c}").alias(f"worst_{c}") for c in link],
        F.col("w.nmse_db").alias("worst_nmse_db"), *[row[n].alias(n) for n in names],
    )


def run_compare_summary(links: DataFrame) -> DataFrame:
    """Per run over files: link-weighted valid rate, median of file medians, p95 of file p95s.

    ``links`` has run, file, standard, spectrum, nmse_db, valid.
    """
    rows = links.withColumn("nmse_db", C.nan_to_null(F.col("nmse_db")))
    files = rows.groupBy("run", "file").agg(
        F.count(F.lit(1)).alias("links"), F.count_if("valid").alias("valid_links")
    )
    tails = exact_quantiles(rows, ["run", "file"], "nmse_db", {"med": 0.5, "p95": 0.95}).drop("n")
    tails = stored(tails, "file-tails")  # one row per file, summarised twice below
    standards = rows.groupBy("run").agg(
        F.array_sort(F.collect_set("standard")).alias("standards"),
        F.array_sort(F.collect_set("spectrum")).alias("spectra"),
    )
    totals = files.groupBy("run").agg(
        F.count(F.lit(1)).alias("file_count"), F.sum("links").alias("link_count"),
        (F.sum("valid_links") / F.sum("links")).alias("valid_rate"),
    )
    med = exact_quantiles(tails, ["run"], "med", {"median_nmse_db": 0.5}).drop("n")
    p95 = exact_quantiles(tails, ["run"], "p95", {"p95_nmse_db": 0.95}).drop("n")
    return totals.join(standards, "run").join(med, "run", "left").join(p95, "run", "left")


def resource_summary(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per file: element counts, NMSE mean and median, absolute error, power range.

    ``samples`` has l_* (truth) and r_* (estimate) columns.
    """
    l2 = C.abs2(F.col("l_re"), F.col("l_im"))
    r2 = C.abs2(F.col("r_re"), F.col("r_im"))
    err = C.abs2(F.col("r_re") - F.col("l_re"), F.col("r_im") - F.col("l_im"))
    nmse = 10 * F.log10(F.greatest(err / F.greatest(l2, F.lit(1e-30)), F.lit(1e-30)))
    rows = samples.select(*keys, l2.alias("l2"), r2.alias("r2"), F.sqrt(err).alias("abs_err"),
                          nmse.alias("nmse"))
    stats = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("re_count"), F.count_if(F.col("r2") > 0).alias("nonzero_count"),
        F.avg("nmse").alias("nmse_mean_db"), F.avg("abs_err").alias("abs_error_mean"),
        F.max("abs_err").alias("abs_error_max"), F.bool_or(F.col("r2") > 0).alias("estimate_nonzero"),
        F.min("r2").alias("power_min"), F.avg("r2").alias("power_mean"),
        F.max("r2").alias("power_max"),
    )
    median = exact_quantiles(rows, keys, "nmse", {"nmse_median_db": 0.5}).drop("n")
    return stats.join(median, list(keys), "left")


def resource_total(per_file: DataFrame) -> DataFrame:
    """Roll-up of :func:`resource_summary` over files."""
    return per_file.agg(
        F.count(F.lit(1)).alias("files"), F.sum("re_count").alias("re_count"),
        F.bool_and("estimate_nonzero").alias("all_nonzero"),
        F.avg("nmse_mean_db").alias("nmse_mean_db"), F.max("abs_error_max").alias("abs_error_max"),
    )


def drop_metric_zeros(table: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Finite values <= 0 become missing."""
    return table.withColumns({
        m: F.when(C.is_finite(F.col(m)) & (F.col(m) > 0), F.col(m)) for m in metrics
    })


def count_metric_zeros(table: DataFrame, metrics: Sequence[str]) -> DataFrame:
    return table.agg(*[
        F.count_if(C.is_finite(F.col(m)) & (F.col(m) <= 0)).alias(m) for m in metrics
    ])


SCOPES = {
    "per_metric_global": ("metric",),
    "all_metrics_global": (),
    "per_comparison_metric": ("comparison", "metric"),
}


def normalize_minmax(long: DataFrame, scope: str) -> DataFrame:
    """Scale ``value`` into [0, 1] by the range of its scope; a constant range gives 1.

    Ranges come from a combined aggregate (a handful of rows) joined back, not from a window,
    so a scope covering the whole table stays distributed.
    """
    keys = list(SCOPES[scope])
    rows = long.withColumn("value", C.nan_to_null(F.col("value")))
    lo, hi = F.min("value").alias("lo"), F.max("value").alias("hi")
    if keys:
        ranged = rows.join(rows.groupBy(*keys).agg(lo, hi), keys)
    else:
        limits = rows.agg(F.struct(lo, hi)).scalar()
        ranged = rows.withColumns({"lo": limits["lo"], "hi": limits["hi"]})
    width = F.col("hi") - F.col("lo")
    scaled = F.least(F.greatest((F.col("value") - F.col("lo")) / width, F.lit(0.0)), F.lit(1.0))
    result = F.when(F.col("value").isNotNull(), F.when(width > 0, scaled).otherwise(F.lit(1.0)))
    return ranged.withColumn("normalized", result).drop("lo", "hi")


def exclude_rect(points: DataFrame, xmin: float, xmax: float, ymin: float, ymax: float
                 ) -> DataFrame:
    return points.where(~G.inside_rect(F.col("x"), F.col("y"), xmin, xmax, ymin, ymax))


def rect_counts(points: DataFrame, xmin: float, xmax: float, ymin: float, ymax: float
                ) -> DataFrame:
    inside = G.inside_rect(F.col("x"), F.col("y"), xmin, xmax, ymin, ymax)
    return points.agg(F.count_if(inside).alias("inside"), F.count_if(~inside).alias("outside"))


def nmse_vs_snr(evaluation: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Links with both values finite."""
    both = C.is_finite(F.col("snr_db")) & C.is_finite(F.col("nmse_db"))
    return evaluation.where(both).select(*keys, "snr_db", "nmse_db")


def block_error_rate(rows: DataFrame, keys: Sequence[str], errors: str, total: str) -> DataFrame:
    """Summed errors over summed blocks; NULL without blocks."""
    return rows.groupBy(*keys).agg(
        F.sum(errors).alias("errors"), F.sum(total).alias("total"),
        F.try_divide(F.sum(errors), F.sum(total)).alias("rate"),
    )


def histogram(rows: DataFrame, keys: Sequence[str], value: str, count: int) -> DataFrame:
    """Counts per bin over the range of each key's own finite values, so that none is outside.

    Columns: keys, bin, lo and hi (the range), n. Equal values all fall into bin 0.
    """
    finite = rows.where(C.is_finite(F.col(value))).select(*keys, F.col(value).alias("_v"))
    ends = F.struct(F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    if keys:
        placed = finite.join(finite.groupBy(*keys).agg(ends.alias("_e")), list(keys))
    else:
        placed = finite.withColumn("_e", finite.agg(ends.alias("_e")).scalar())
    lo, hi = F.col("_e.lo"), F.col("_e.hi")
    bin_ = F.when(hi > lo, histogram_bin(F.col("_v"), lo, hi, count)).otherwise(F.lit(0).cast("bigint"))
    return placed.groupBy(*keys, bin_.alias("bin"), lo.alias("lo"), hi.alias("hi")).agg(F.count(F.lit(1)).alias("n"))
