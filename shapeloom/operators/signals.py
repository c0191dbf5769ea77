"""Scalar series as graphs: phase-space embedding and trajectories. A series is signal(series_id, i, x); i orders it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions import kernels
from .graphs import Graphs


def _by() -> WindowSpec:
    return Window.partitionBy("series_id")


def _in_order() -> WindowSpec:
    return _by().orderBy("i")


def bandpass(signal: DataFrame, fs: float, low: float, high: float) -> DataFrame:
    """Zero-phase filter of each series; a Fourier transform needs a whole series, so each is one task's."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("i")
        return df.assign(x=kernels.bandpass(df["x"].to_numpy(), fs, low, high))

    return signal.select("series_id", "i", "x").groupBy("series_id").applyInPandas(run, "series_id string, i long, x double")


def autocorrelation(signal: DataFrame, max_lag: int = 100) -> DataFrame:
    """series_id, lag, r for lags from 1 to below min(max_lag, n - 1), r over the sum of squares (1 if that is 0)."""
    centred = signal.select("series_id", "i", (F.col("x") - F.avg("x").over(_by())).alias("d"), F.count("*").over(_by()).alias("n"))
    lags = F.sequence(F.lit(1), F.lit(max(1, max_lag - 1)))
    # Each value meets its max_lag - 1 followers through an equi-join on the place.
    later = centred.select("series_id", F.col("d").alias("d0"), "n", F.explode(lags).alias("lag"), "i").withColumn("i", F.col("i") - F.col("lag"))
    pairs = centred.select("series_id", "i", "d").join(later, ["series_id", "i"]).where(F.col("lag") < F.col("n") - 1)
    total = centred.groupBy("series_id").agg(F.sum(F.col("d") * F.col("d")).alias("total"))
    sums = pairs.groupBy("series_id", "lag").agg(F.sum(F.col("d") * F.col("d0")).alias("s")).join(total, "series_id")
    return sums.select("series_id", "lag", (F.col("s") / F.when(F.col("total") == 0, 1.0).otherwise(F.col("total"))).alias("r"))


def estimate_tau(signal: DataFrame, max_lag: int = 100) -> DataFrame:
    """series_id, tau: the first lag whose autocorrelation isn't positive, else a quarter of max_lag, 1 at least."""
    first = autocorrelation(signal, max_lag).where("r <= 0").groupBy("series_id").agg(F.min("lag").alias("tau"))
    return signal.select("series_id").distinct().join(first, "series_id", "left").select("series_id", F.coalesce("tau", F.lit(max(1, max_lag // 4))).alias("tau"))


def phase_space(signal: DataFrame, tau: int, normalize: bool = True) -> DataFrame:
    """series_id, i, px, py: the points (x[i], x[i + tau]), with mean 0 and population deviation 1 in each series if asked."""
    if tau < 1:
        raise ValueError("tau is 1 at least")
    points = signal.select("series_id", "i", F.col("x").alias("px"), F.lead("x", tau).over(_in_order()).alias("py"), F.lead("i", tau).over(_in_order()).alias("there"))
    points = points.where("there IS NOT NULL").drop("there")
    if normalize:
        unit = lambda c: ((F.col(c) - F.avg(c).over(_by())) / (F.stddev_pop(c).over(_by()) + 1e-12)).alias(c)
        points = points.select("series_id", "i", unit("px"), unit("py"))
    return points


def trajectory(points: DataFrame, start: int = 0, count: int | None = None) -> Graphs:
    """A path along the points (series_id, i, px, py) of each series from place `start` on, `count` of them; ids from 0."""
    place = points.select("*", (F.row_number().over(_in_order()) - 1 - start).cast("long").alias("v")).where("v >= 0")
    place = place if count is None else place.where(F.col("v") < count)
    vertices = place.select(F.col("series_id").alias("graph_id"), "v", F.col("px").alias("x"), F.col("py").alias("y"))
    edges = vertices.select("graph_id", F.col("v").alias("u"), F.lead("v").over(Window.partitionBy("graph_id").orderBy("v")).alias("w")).where("w IS NOT NULL")
    return Graphs(vertices, edges)


def signal_graph(signal: DataFrame, fs: float, tau: int | None = None, count: int = 600, start: int = 0, band: tuple[float, float] | None = None) -> tuple[Graphs, DataFrame]:
    """Filter, embed and link each series; and a row of what was done for each. Without tau each series gets its own estimate."""
    x = signal if band is None else bandpass(signal, fs, *band)
    taus = estimate_tau(x) if tau is None else x.select("series_id").distinct().withColumn("tau", F.lit(tau))
    later = x.select("series_id", "i", F.col("x").alias("py"))
    pairs = x.join(taus, "series_id").select("series_id", "i", F.col("x").alias("px"), (F.col("i") + F.col("tau")).alias("there"))
    points = pairs.join(later.withColumnRenamed("i", "there"), ["series_id", "there"]).select("series_id", "i", "px", "py")
    unit = lambda c: ((F.col(c) - F.avg(c).over(_by())) / (F.stddev_pop(c).over(_by()) + 1e-12)).alias(c)
    graphs = trajectory(points.select("series_id", "i", unit("px"), unit("py")), start, count)
    n = points.groupBy("series_id").agg(F.count("*").alias("n_points"))
    return graphs, taus.join(n, "series_id").select("series_id", F.lit(fs).alias("fs"), "tau", "n_points", F.lit(start).alias("start"), F.lit(count).alias("count"))


