"""Keyed time series (T1-T14): many series at once, one row per
(keys, period) in long form.

Conventions: a series frame has the key columns, ``period`` (period start),
``t`` (1-based position from the series start), ``season`` (1..m),
``cycle`` (start of the seasonal cycle) and one or more value columns.

Scale notes: raw rows are reduced to periods by a partial aggregate (hot keys
combine map-side); the calendar spine holds one row per period, so its size
is set by the calendar, not by the data.  Lags and autocorrelations run over
blocks of positions with halos (``blocks``) instead of a window over a whole
series, so a single long series is still spread over many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardcast.functions.calendar import (DATE_UNITS, add_periods, cycle_of, period_start,
                                         season_of, step)
from wardcast.operators.blocks import with_lags
from wardcast.operators.quantiles import quantiles, sketch_agg
from wardcast.session import stage_table

SERIES_COLS = ("period", "t", "season", "cycle")


def spine(bounds: DataFrame, keys: list[str], unit: str,
          lo: str = "lo", hi: str = "hi") -> DataFrame:
    """One row per key and period between ``lo`` and ``hi`` (inclusive),
    with ``t`` = 1-based position."""
    seq = F.sequence(F.col(lo), F.col(hi), step(unit))
    return (bounds.select(*keys, F.posexplode(seq).alias("pos", "period"))
                  .select(*keys, "period", (F.col("pos") + 1).cast("int").alias("t")))


def build_series(df: DataFrame, keys: list[str], ts: str, values: dict[str, Column],
                 unit: str, start=None, end=None, fill=None, last: str = "keep") -> DataFrame:
    """Aggregate raw rows to a regular series per key.

    ``values`` maps output names to aggregate expressions.  Periods without
    rows are kept (values NULL, or ``fill``) so lags and ``t`` stay aligned
    to the calendar.  ``start``/``end`` (period starts, inclusive) override
    the per-key observed range.

    ``last``: what becomes of a last period that the data do not cover to its
    end (no row on its last day): "keep" it, "drop" it, or "flag" every period
    in a column ``is_complete``.  The bound is taken from the aggregated rows,
    which are staged for it: the raw rows are read once.
    """
    if last not in ("keep", "drop", "flag"):
        raise ValueError(last)
    if last != "keep" and unit not in DATE_UNITS:
        raise ValueError(f"periods of unit {unit} have no last day")
    per = period_start(F.col(ts), unit)
    seen = [] if last == "keep" else [F.max(F.to_date(F.col(ts))).alias("_seen")]
    agg = df.groupBy(*keys, per.alias("period")).agg(
        *[e.alias(n) for n, e in values.items()], *seen)
    if seen:
        agg = stage_table(agg, "periods")
        # the period that holds the day after the last one is not complete
        cut = agg.agg(period_start(F.date_add(F.max("_seen"), 1), unit)).scalar()
        if last == "drop":
            agg = agg.filter(F.col("period") < cut)
        agg = agg.drop("_seen")
    if start is not None:
        agg = agg.filter(F.col("period") >= F.lit(start).cast(agg.schema["period"].dataType))
    if end is not None:
        agg = agg.filter(F.col("period") <= F.lit(end).cast(agg.schema["period"].dataType))
    bounds = agg.groupBy(*keys).agg(F.min("period").alias("lo"), F.max("period").alias("hi"))
    if start is not None:
        bounds = bounds.withColumn("lo", F.lit(start).cast(agg.schema["period"].dataType))
    if end is not None:
        bounds = bounds.withColumn("hi", F.lit(end).cast(agg.schema["period"].dataType))
    sp = spine(bounds, keys, unit)
    out = sp.join(agg, [*keys, "period"], "left")
    if fill is not None:
        out = out.fillna({n: fill for n in values})
    flag = [(F.col("period") < cut).alias("is_complete")] if last == "flag" else []
    return out.select(*keys, "period", "t",
                      season_of(F.col("period"), unit).alias("season"),
                      cycle_of(F.col("period"), unit).alias("cycle"), *values.keys(), *flag)


def time_window(series: DataFrame, keys: list[str], start=None, end=None,
                renumber: bool = True) -> DataFrame:
    """Cut every series to [start, end] (inclusive, T3); ``t`` restarts at 1
    so a trend fitted on the window starts at the window."""
    out = series
    dt = series.schema["period"].dataType
    if start is not None:
        out = out.filter(F.col("period") >= F.lit(start).cast(dt))
    if end is not None:
        out = out.filter(F.col("period") <= F.lit(end).cast(dt))
    if renumber:
        first = out.groupBy(*keys).agg(F.min("t").alias("_t0"))
        out = (out.join(first, keys).withColumn("t", (F.col("t") - F.col("_t0") + 1).cast("int"))
                  .drop("_t0"))
    return out


def gaps(series: DataFrame, keys: list[str], value: str, unit: str, zeros: bool = False) -> DataFrame:
    """Runs of missing periods per series (T5): gap_start, gap_end, n_missing.
    With ``zeros``, the runs of periods that were observed as 0 instead: a
    different kind of gap (nothing happened, rather than nothing was recorded).

    Consecutive missing positions share ``t - rank``; ranking is done only
    over the missing rows of one series (bounded by its calendar).
    """
    from pyspark.sql import Window as W
    miss = series.filter(F.col(value) == 0 if zeros else F.col(value).isNull()).select(*keys, "period", "t")
    w = W.partitionBy(*keys).orderBy("t")
    runs = miss.withColumn("_grp", F.col("t") - F.row_number().over(w))
    return (runs.groupBy(*keys, "_grp")
                .agg(F.min("period").alias("gap_start"), F.max("period").alias("gap_end"),
                     F.count("*").cast("bigint").alias("n_missing"))
                .drop("_grp"))


def to_long(df: DataFrame, ids: list[str], values: list[str],
            name: str = "variable", value: str = "value") -> DataFrame:
    """Facet / long form: one row per (ids, variable) (T4)."""
    return df.select(*ids, *[F.col(v).cast("double").alias(v) for v in values]) \
             .unpivot(ids, values, name, value)


def seasonal_wide(series: DataFrame, keys: list[str], value: str, m: int) -> DataFrame:
    """Seasonal-plot data (T6): one row per (series, cycle), one column per
    season s01..sm (pivot with explicit values: a single aggregate)."""
    return (series.groupBy(*keys, "cycle").pivot("season", list(range(1, m + 1)))
                  .agg(F.first(value))
                  .select(*keys, "cycle", *[F.col(str(s)).alias(f"s{s:02d}")
                                           for s in range(1, m + 1)]))


def seasonal_subseries(series: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sub-series data (T7/A7): each value with its season mean."""
    means = series.groupBy(*keys, "season").agg(F.avg(value).alias("season_mean"))
    return series.select(*keys, "season", "period", value).join(means, [*keys, "season"])


def lagged(series: DataFrame, keys: list[str], value: str, lags: list[int],
           out: str = "y_lag") -> DataFrame:
    """Lag pairs (T8/J9/W4): one row per (series, t, k) with y_t and y_{t-k}.

    Blocks with halos: a row is shuffled once (twice near a block's end),
    whatever the number of lags, and multiplies only afterwards.
    """
    if "k" in keys or "t" in keys:
        raise ValueError("key columns named 'k' or 't' collide with the lag / time columns")
    rest = [c for c in series.columns if c not in (*keys, "t")]
    # a struct tells a missing row (NULL) from a row with a missing value
    wide = with_lags(series, keys, lags, F.struct(F.col(value).alias(out)))
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_lag{k}").alias("row")) for k in lags]))
    return (wide.select(*keys, "t", *rest, pairs.alias("_p")).filter(F.col("_p.row").isNotNull())
                .select(*keys, "t", *rest, F.col(f"_p.row.{out}").alias(out), F.col("_p.k").alias("k")))


def acf(series: DataFrame, keys: list[str], value: str, max_lag: int) -> DataFrame:
    """Sample autocorrelation r_k, k = 1..max_lag (T11):

        r_k = sum_{t>k} (y_t - ybar)(y_{t-k} - ybar) / sum_t (y_t - ybar)^2

    with the full-sample mean and denominator (not corr(y, lag y)).
    Also returns n (observations) for the +-2/sqrt(n) bound.

    One pass: blocks with halos give every y_t its earlier values, and all sums
    are mergeable moments (centred about their own means, then moved to the
    series mean), so neither an exploded self-join nor a pass for the mean is
    needed, and one long series is summed by many tasks.
    """
    if set(keys) & {"k", "t", "n", "r"}:
        raise ValueError("key columns named k, t, n or r collide with the ACF output")
    lags = list(range(1, max_lag + 1))
    y = F.col("_y")
    obs = series.filter(F.col(value).isNotNull()).select(*keys, "t", F.col(value).cast("double").alias("_y"))
    aggs = [F.count("*").alias("n"), F.avg(y).alias("_mean"), F.var_pop(y).alias("_var")]
    for k in lags:
        z = F.col(f"_lag{k}")
        aggs += [F.count(z).alias(f"_m{k}"), F.covar_pop(y, z).alias(f"_c{k}"),
                 F.avg(F.when(z.isNotNull(), y)).alias(f"_a{k}"), F.avg(z).alias(f"_b{k}")]
    g = with_lags(obs, keys, lags, y).groupBy(*keys).agg(*aggs)
    # sum of (y - mean)(z - mean) over the pairs, from their own centred moment
    num = [F.struct(F.lit(k).alias("k"), F.coalesce(F.col(f"_m{k}") * (F.col(f"_c{k}") + (
        F.col(f"_a{k}") - F.col("_mean")) * (F.col(f"_b{k}") - F.col("_mean"))), F.lit(0.0)).alias("s")) for k in lags]
    return g.select(*keys, "n", "_var", F.explode(F.array(*num)).alias("_p")).select(
        *keys, F.col("_p.k").alias("k"), F.try_divide(F.col("_p.s"), F.col("n") * F.col("_var")).alias("r"), "n")


def acf_bounds(acf_df: DataFrame) -> DataFrame:
    """Correlogram limits (T12): bound = 2/sqrt(n), significant = |r| > bound."""
    bound = F.lit(2.0) / F.sqrt(F.col("n").cast("double"))
    return acf_df.withColumn("bound", bound).withColumn(
        "significant", F.abs(F.col("r")) > F.col("bound"))


def acf_signature(acf_b: DataFrame, keys: list[str], m: int) -> DataFrame:
    """Trend / seasonality / white-noise reading of a correlogram.

    * trend: r_1 significant and positive, and r_k > 0 for every k <= m
      (slow positive decay);
    * seasonal: r_m significant and a local peak (r_m > r_{m-1}, r_{m+1});
    * white_noise: at least 95% of spikes inside the bound.
    """
    r = F.col("r")
    k = F.col("k")
    g = acf_b.groupBy(*keys).agg(
        F.max(F.when(k == 1, r)).alias("r1"),
        F.max(F.when(k == m - 1, r)).alias("_rm1"),
        F.max(F.when(k == m, r)).alias("rm"),
        F.max(F.when(k == m + 1, r)).alias("_rp1"),
        F.max(F.when(k == m, F.col("bound"))).alias("_bm"),
        F.max(F.when(k == 1, F.col("bound"))).alias("_b1"),
        F.min(F.when(k <= m, r)).alias("_minr"),
        F.avg(F.when(~F.col("significant"), 1.0).otherwise(0.0)).alias("share_inside"))
    return g.select(
        *keys, "r1", "rm", "share_inside",
        ((F.col("r1") > F.col("_b1")) & (F.col("_minr") > 0)).alias("trend"),
        ((F.col("rm") > F.col("_bm")) & (F.col("rm") > F.coalesce(F.col("_rm1"), F.lit(-2.0)))
         & (F.col("rm") > F.coalesce(F.col("_rp1"), F.lit(-2.0)))).alias("seasonal"),
        (F.col("share_inside") >= 0.95).alias("white_noise"))


def head(series: DataFrame, keys: list[str], n: int = 6) -> DataFrame:
    """First n observations of every series (S8/O5; the limit is the feature)."""
    return series.filter(F.col("t") <= n)


def align(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Time-index alignment of two series sets (J8): inner join on period."""
    return left.join(right, on, "inner")


def corr_matrix(df: DataFrame, keys: list[str], variables: list[str]) -> DataFrame:
    """Pairwise Pearson correlations per key (A8/T10), upper triangle, long:
    (keys, var_a, var_b, r).  One aggregate pass for all pairs."""
    pairs = [(a, b) for i, a in enumerate(variables) for b in variables[i + 1:]]
    agg = df.groupBy(*keys).agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    stack = F.explode(F.array(*[F.struct(F.lit(a).alias("var_a"), F.lit(b).alias("var_b"),
                                         F.col(f"{a}__{b}").alias("r"))
                                for a, b in pairs]))
    return agg.select(*keys, stack.alias("_p")).select(*keys, "_p.var_a", "_p.var_b", "_p.r")


def pair_scatter(df: DataFrame, ids: list[str], variables: list[str]) -> DataFrame:
    """Scatter-plot matrix panels (T10): for every observation and every pair
    of variables a < b, the point (x = a, y = b).  A projection of each row
    into its k(k-1)/2 pairs - no join, so a key of any size stays local."""
    pairs = [(a, b) for i, a in enumerate(variables) for b in variables[i + 1:]]
    pts = F.explode(F.array(*[F.struct(F.lit(a).alias("var_x"), F.lit(b).alias("var_y"),
                                       F.col(a).cast("double").alias("x"),
                                       F.col(b).cast("double").alias("y"))
                              for a, b in pairs]))
    return df.select(*ids, pts.alias("_p")).select(*ids, "_p.var_x", "_p.var_y", "_p.x", "_p.y")


def histogram(df: DataFrame, keys: list[str], value: str, bins: int = 10) -> DataFrame:
    """Equal-width histogram per key between its min and max (A9): bin
    1..bins, [lo, hi), the last bin closed; exact counts, empty bins kept."""
    from wardcast.operators.regress import attach
    stats = stage_table(df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")), "bounds")
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.when(F.col("_hi") == F.col("_lo"), F.lit(1)).otherwise(
        F.least(F.floor((F.col(value) - F.col("_lo")) / width) + 1, F.lit(bins))).cast("int")
    # a key with many rows meets its bounds in many tasks, and is counted partially
    counts = (attach(df.filter(F.col(value).isNotNull()).select(*keys, value), stats, keys)
              .groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n")))
    grid = stats.withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    return (grid.join(counts, [*keys, "bin"], "left")
                .select(*keys, F.col("bin").cast("int"),
                        (F.col("_lo") + (F.col("bin") - 1) * width).alias("lo"),
                        (F.col("_lo") + F.col("bin") * width).alias("hi"),
                        F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n")))


def density(df: DataFrame, keys: list[str], value: str, grid: int = 32) -> DataFrame:
    """Gaussian kernel density per key on an even grid over [min, max] (A10).

    Bandwidth: 0.9 * min(sd, IQR/1.34) * n^(-1/5) (falls back to sd when the
    IQR is 0); the quartiles come from a mergeable sketch, so no key's distinct
    values are held together.  Each observation meets only the ``grid`` points
    of its own key, so work is n * grid, never quadratic in n, and a key with
    many rows is spread over many tasks and summed partially.
    """
    if grid < 2:
        raise ValueError("grid must have at least 2 points")
    from wardcast.operators.regress import attach
    obs = df.filter(F.col(value).isNotNull())
    st = obs.groupBy(*keys).agg(
        F.min(value).alias("_lo"), F.max(value).alias("_hi"),
        F.stddev_samp(value).alias("_sd"), F.count("*").alias("_rows"),
        sketch_agg(F.col(value)).alias("_sk"))
    st = quantiles(st, "_sk", {"_q1": 0.25, "_q3": 0.75}).drop("_sk")
    iqr = (F.col("_q3") - F.col("_q1")) / 1.34
    spread = F.when(iqr > 0, F.least(F.col("_sd"), iqr)).otherwise(F.col("_sd"))
    st = st.withColumn("_h", 0.9 * spread * F.pow(F.col("_rows").cast("double"), -0.2))
    st = stage_table(st.select(*keys, "_lo", "_hi", "_h", F.col("_rows").alias("_n")), "bandwidths")
    x = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("g") / (grid - 1)
    # a constant series has zero bandwidth: density undefined (NULL), not an error
    z = F.try_divide(x - F.col("_v"), F.col("_h"))
    j = attach(obs.select(*keys, F.col(value).alias("_v")), st, keys).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("g"))
    sums = j.groupBy(*keys, "g").agg(F.sum(F.exp(-0.5 * z * z)).alias("_s"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"),
                                     F.first("_h").alias("_h"), F.first("_n").alias("_n"))
    return sums.select(*keys, F.col("g").cast("int").alias("g"), x.alias("x"),
                       F.try_divide(F.col("_s"), F.col("_n") * F.col("_h") * F.lit(math.sqrt(2 * math.pi))).alias("density"))


def from_values(spark, values: list[float], start: str, unit: str,
                series_id: str = "s") -> DataFrame:
    """A literal regular series (S6): values from ``start`` one per period,
    e.g. ``from_values(spark, [123, 39, 78, 52, 110], "2012-01-01", "year")``."""
    from wardcast.functions.calendar import add_periods
    base = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, y double")
    per = add_periods(F.lit(start).cast("date"), F.col("i"), unit)
    return base.select(F.lit(series_id).alias("series_id"), per.alias("period"),
                       (F.col("i") + 1).cast("int").alias("t"),
                       season_of(per, unit).alias("season"), cycle_of(per, unit).alias("cycle"), "y")


def white_noise(spark, n: int, seed: int, keys: int = 1, partitions: int = 1) -> DataFrame:
    """Seeded standard-normal series (S7/T14): ``keys`` series of length n,
    generated in parallel; fixed ``partitions`` keep the draws reproducible.
    Statistically (not bit-for-bit) equal to other generators."""
    base = spark.range(0, n * keys, numPartitions=partitions)
    return base.select((F.col("id") % keys).cast("bigint").alias("series_id"),
                       (F.floor(F.col("id") / keys) + 1).cast("int").alias("t"),
                       F.randn(seed).alias("y"))


def seasonal_period(unit: str) -> float:
    """Primary number of observations per cycle for a period unit."""
    from wardcast.functions.codes import FREQUENCY
    return FREQUENCY[unit][0]
