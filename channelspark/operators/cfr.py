"""Channel-response metrics: estimation error, similarity between runs, variant comparison.

Inputs are array rows (one per antenna pair). They are unnested and reduced by one aggregate whose
map-side combine leaves a single row per group and task, so arrays are shuffled only for joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from channelspark.functions import complex as C
from channelspark.functions import power as PW

EPS = 1e-30
METRICS = ("magnitude", "phase", "i", "q")


def paired_samples(pairs: DataFrame, keys: Sequence[str], left: str, right: str) -> DataFrame:
    """One row per subcarrier with l_re, l_im, r_re, r_im."""
    named = pairs.select(*keys, F.col(left).alias("l"), F.col(right).alias("r"))
    zipped = named.select(*keys, F.posexplode(F.arrays_zip("l", "r")).alias("k", "s"))
    return zipped.select(
        *keys, "k", F.col("s.l.re").alias("l_re"), F.col("s.l.im").alias("l_im"),
        F.col("s.r.re").alias("r_re"), F.col("s.r.im").alias("r_im"),
    )


def _pair_columns() -> dict[str, Column]:
    l_re, l_im, r_re, r_im = (F.col(c) for c in ("l_re", "l_im", "r_re", "r_im"))
    cross_re, cross_im = C.conj_product(r_re, r_im, l_re, l_im)
    return {
        "signal": C.abs2(l_re, l_im), "estimate": C.abs2(r_re, r_im),
        "error": C.abs2(r_re - l_re, r_im - l_im), "cross_re": cross_re, "cross_im": cross_im,
    }


def nmse_db(error: Column, signal: Column) -> Column:
    return PW.db(error / F.greatest(signal, F.lit(EPS)), EPS)


def cfr_metrics(
    pairs: DataFrame, link: Sequence[str], truth: str = "h", estimate: str = "est",
    valid: str | None = None,
) -> DataFrame:
    """Error metrics per link over antennas and subcarriers; zeros on invalid links."""
    flags = [valid] if valid else []
    p = _pair_columns()
    sums = paired_samples(pairs, [*link, *flags], truth, estimate).groupBy(*link).agg(
        F.sum(p["signal"]).alias("signal"), F.sum(p["estimate"]).alias("estimate"),
        F.sum(p["error"]).alias("error"), F.avg(F.sqrt(p["error"])).alias("abs_error"),
        F.avg(C.angle(p["cross_re"], p["cross_im"])).alias("phase"),
        F.sum(p["cross_re"]).alias("cross_re"), F.sum(p["cross_im"]).alias("cross_im"),
        *[F.bool_and(v).alias(v) for v in flags],
    )
    denominator = F.sqrt("signal") * F.sqrt("estimate")
    out = {
        "nmse_db": nmse_db(F.col("error"), F.col("signal")),
        "amp_err_db": PW.amplitude_db(F.col("abs_error")),
        "phase_err_rad": F.col("phase"),
        "corr": C.magnitude(F.col("cross_re"), F.col("cross_im"))
        / F.greatest(denominator, F.lit(EPS)),
    }
    ok = F.col(valid) if valid else F.lit(True)
    snr = F.when(F.col("error") > 0, 10 * F.log10(F.col("signal") / F.col("error")))
    return sums.select(
        *link, ok.alias("valid"),
        *[F.when(ok, c).otherwise(F.lit(0.0)).alias(n) for n, c in out.items()],
        snr.alias("snr_db"),
    )


def similarity_sums(samples: DataFrame, keys: Sequence[str], valid: Column | None = None
                    ) -> DataFrame:
    """Additive sums behind :func:`similarity`; only samples finite on both sides count."""
    names = ("l_re", "l_im", "r_re", "r_im")
    usable = C.is_finite(F.col("l_re")) & C.is_finite(F.col("l_im")) \
        & C.is_finite(F.col("r_re")) & C.is_finite(F.col("r_im"))
    if valid is not None:
        usable = usable & valid
    rows = samples.withColumns({n: F.when(usable, F.col(n)) for n in names})
    l_re, l_im, r_re, r_im = (F.col(n) for n in names)
    l_mag, r_mag = C.magnitude(l_re, l_im), C.magnitude(r_re, r_im)
    cross_re, cross_im = C.conj_product(r_re, r_im, l_re, l_im)
    score = 0.5 * (1 + F.cos(C.angle(cross_re, cross_im)))
    weight = F.sqrt(l_mag * r_mag)
    sums = [F.count("l_re").alias("_n"), F.sum(weight * score).alias("_ws"),
            F.sum(weight).alias("_w"), F.sum(score).alias("_s")]
    for name, (left, right) in {
        "magnitude": (l_mag, r_mag), "i": (l_re, r_re), "q": (l_im, r_im)
    }.items():
        sums += [F.sum((left - right) * (left - right)).alias(f"_{name}_d2"),
                 F.sum(left * left).alias(f"_{name}_l2"),
                 F.sum(right * right).alias(f"_{name}_r2")]
    return rows.groupBy(*keys).agg(*sums)


def _scores(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    def clip(value: Column) -> Column:
        return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))

    some = F.col("_n") > 0
    out = {}
    for name in ("magnitude", "i", "q"):
        norms = F.sqrt(f"_{name}_l2") + F.sqrt(f"_{name}_r2")
        score = clip(1 - F.sqrt(f"_{name}_d2") / norms)
        out[name] = F.when(some & (norms > EPS), score).when(some, F.lit(1.0))
    out["phase"] = F.when(F.col("_w") > EPS, clip(F.col("_ws") / F.col("_w"))).when(
        some, clip(F.col("_s") / F.col("_n"))
    )
    return sums.select(*keys, *[out[m].alias(m) for m in METRICS])


def similarity(samples: DataFrame, keys: Sequence[str], valid: Column | None = None) -> DataFrame:
    """Magnitude, I, Q (normalised L2) and weighted phase similarity per group.

    ``samples`` has l_re, l_im, r_re, r_im. A group with no usable sample gives NULL.
    """
    return _scores(similarity_sums(samples, keys, valid), keys)


def similarity_levels(samples: DataFrame, outer: Sequence[str], inner: Sequence[str],
                      valid: Column | None = None) -> DataFrame:
    """Scores per ``outer`` and per ``outer + inner`` group in one table (``inner`` NULL = outer).

    Samples are reduced once to the finest level; the grouping sets run over those few sums.
    """
    fine = similarity_sums(samples, [*outer, *inner], valid)
    measures = [c for c in fine.columns if c not in (*outer, *inner)]
    levels = fine.groupingSets(
        [[F.col(c) for c in outer], [F.col(c) for c in (*outer, *inner)]],
        *[F.col(c) for c in (*outer, *inner)],
    ).agg(*[F.sum(m).alias(m) for m in measures])
    return _scores(levels, [*outer, *inner])


def pair_shards(
    left: DataFrame, right: DataFrame, keys: Sequence[str], sample_keys: Sequence[str]
) -> DataFrame:
    """Similarity per ``keys`` of two runs; groups present on one side only score 0.

    Rows are array rows with column ``h``; the runs meet on ``sample_keys`` in a full outer join.
    """
    both = left.withColumnRenamed("h", "l").join(
        right.withColumnRenamed("h", "r"), list(sample_keys), "full_outer"
    )
    sided = both.withColumn("_both", F.col("l").isNotNull() & F.col("r").isNotNull())
    present = sided.groupBy(*keys).agg(
        F.bool_or(F.col("l").isNotNull()).alias("in_left"),
        F.bool_or(F.col("r").isNotNull()).alias("in_right"),
    )
    scores = similarity(
        paired_samples(sided.where("_both"), list(keys), "l", "r"), keys
    )
    one_sided = ~(F.col("in_left") & F.col("in_right"))
    joined = present.join(scores, list(keys), "left")
    return joined.select(
        *keys, "in_left", "in_right",
        *[F.when(one_sided, F.lit(0.0)).otherwise(F.col(m)).alias(m) for m in METRICS],
    )


def station_mean(per_station: DataFrame, keys: Sequence[str], chosen: Column | None = None
                 ) -> DataFrame:
    """Mean over (chosen) stations; a missing value makes the mean missing."""
    rows = per_station if chosen is None else per_station.where(chosen)

    def mean(metric: str) -> Column:
        return F.when(F.count(metric) == F.count(F.lit(1)), F.avg(metric))

    return rows.groupBy(*keys).agg(*[mean(m).alias(m) for m in METRICS])


def variant_metrics(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pooled comparison of reference (l) and candidate (r) samples."""
    finite = C.is_finite(F.col("l_re")) & C.is_finite(F.col("l_im")) \
        & C.is_finite(F.col("r_re")) & C.is_finite(F.col("r_im"))
    p = _pair_columns()
    angle = C.angle(p["cross_re"], p["cross_im"])
    gap = F.abs(20 * F.log10(F.sqrt(p["estimate"]) + EPS) - 20 * F.log10(F.sqrt(p["signal"]) + EPS))
    sums = pairs.where(finite).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_count"), F.sum(p["signal"]).alias("s"),
        F.sum(p["estimate"]).alias("e"), F.sum(p["error"]).alias("err"),
        F.sum(p["cross_re"]).alias("cr"), F.sum(p["cross_im"]).alias("ci"),
        F.avg(gap).alias("magnitude_mae_db"), F.avg(F.abs(angle)).alias("phase_mae_rad"),
        F.sqrt(F.avg(angle * angle)).alias("phase_rmse_rad"),
    )
    return sums.select(
        *keys, "sample_count", nmse_db(F.col("err"), F.col("s")).alias("nmse_db"),
        (C.magnitude(F.col("cr"), F.col("ci"))
         / F.greatest(F.sqrt(F.col("s") * F.col("e")), F.lit(EPS))).alias("correlation"),
        "magnitude_mae_db", "phase_mae_rad", "phase_rmse_rad",
    )
