"""Block and halo: values at earlier positions of very long series.

A series is cut into blocks of ``BLOCK`` positions.  Every row goes to its own
block, and as a halo to the following blocks as far as the largest lag
reaches; inside a block a value k positions back is a window over the exact
position ``t - k`` (gaps in t stay gaps).  One series of any length is thus
spread over as many tasks as it has blocks, and about n * (1 + reach / BLOCK)
rows are shuffled, whatever the number of lags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 8192


def with_lags(series: DataFrame, keys: list[str], lags: list[int], value, block: int = BLOCK) -> DataFrame:
    """``series`` with a column ``_lag{k}`` per lag k > 0: ``value`` of the
    row of the same key at ``t - k``, NULL where there is none.

    ``value`` is a Column over the columns of ``series``; (keys, t) is unique."""
    if not lags or min(lags) < 1:
        raise ValueError("lags must be positive")
    if block < 1:
        raise ValueError("a block must hold at least one position")
    own = F.floor(F.col("t") / block).cast("bigint")
    last = F.floor((F.col("t") + max(lags)) / block).cast("bigint")
    cut = series.select("*", own.alias("_own"), value.alias("_value"), F.explode(F.sequence(own, last)).alias("_block"))
    w = W.partitionBy(*keys, "_block").orderBy("t")

    def back(k: int) -> Column:
        return F.max("_value").over(w.rangeBetween(-k, -k)).alias(f"_lag{k}")

    return cut.select(*series.columns, "_own", "_block", *map(back, lags)).filter("_own = _block").drop("_own", "_block")
