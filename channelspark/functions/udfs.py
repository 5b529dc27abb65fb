"""User-function surface: SQL table functions and a grouped aggregate.

The native expressions in :mod:`functions.grid` and :mod:`operators.sequences` are faster; these
exist for SQL text that wants to call the operators by name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

#: SQL table functions: name -> (parameters, columns, body). They are expanded into the calling query.
TABLE_FUNCTIONS = {
    # SELECT * FROM frequency_grid(3.5e9D, 20e6D, 64)
    "frequency_grid": (
        "center_hz DOUBLE, bandwidth_hz DOUBLE, points BIGINT", "k BIGINT, f_hz DOUBLE",
        "SELECT k, center_hz + (k - (points - 1) / 2) * (bandwidth_hz / points)"
        " FROM explode(CASE WHEN points > 0 THEN sequence(0L, points - 1) END) AS t(k)",
    ),
    # resource elements of every symbol
    "srs_re_grid": (
        "symbols BIGINT, start_prb BIGINT, prb_count BIGINT, comb BIGINT, shift BIGINT, total BIGINT",
        "symbol BIGINT, k BIGINT",
        "SELECT e.symbol, e.k FROM inline(flatten(transform("
        "CASE WHEN symbols > 0 THEN sequence(0L, symbols - 1) ELSE array() END, s -> transform("
        "CASE WHEN start_prb * 12 + shift < least((start_prb + prb_count) * 12, total)"
        " THEN sequence(start_prb * 12 + shift, least((start_prb + prb_count) * 12, total) - 1, comb)"
        " ELSE array() END, e -> struct(s AS symbol, e AS k))))) AS e",
    ),
}


@pandas_udf(T.DoubleType())
def weighted_median(value: pd.Series, weight: pd.Series) -> float:
    """Grouped aggregate: first sorted value whose cumulative weight reaches half of the total."""
    order = np.argsort(value.to_numpy(), kind="stable")
    upto = np.cumsum(weight.to_numpy()[order])
    if not len(upto):
        return float("nan")
    return float(value.to_numpy()[order][np.searchsorted(upto, 0.5 * upto[-1])])


def register_functions(spark: SparkSession) -> None:
    for name, (parameters, columns, body) in TABLE_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE({columns}) RETURN {body}")
    spark.udf.register("weighted_median", weighted_median)
