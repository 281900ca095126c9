"""Portfolio risk from long price tables: aligned returns, covariance, tail risk, beta, concentration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAYS = 252


def normalised(holdings: DataFrame) -> DataFrame:
    """symbol, weight (summing to one) and whether the weights given did not."""
    w = Window.partitionBy(F.lit(1))  # the holdings of one portfolio
    total = F.sum("weight").over(w)
    return holdings.select("symbol", (F.col("weight") / total).alias("weight"), (F.abs(F.round(total, 4) - 1) > 0.01).alias("rescaled"))


def aligned_returns(daily: DataFrame, holdings: DataFrame) -> DataFrame:
    """symbol, d, r, weight on the days on which every holding has a price. Inner alignment by counting
    holdings per day, without a pivot."""
    held = daily.join(holdings.select("symbol", "weight"), "symbol").select("symbol", "d", "close", "weight")
    n = holdings.agg(F.count_distinct("symbol").alias("n"))
    days = held.groupBy("d").agg(F.count_distinct("symbol").alias("k")).join(F.broadcast(n), F.col("k") == F.col("n")).select("d")
    both = held.join(days, "d")
    prior = F.lag("close").over(Window.partitionBy("symbol").orderBy("d"))
    return both.withColumn("r", F.col("close") / prior - 1).filter("r is not null")


def covariance(returns: DataFrame) -> DataFrame:
    """a, b, cov (annual), corr for each pair of holdings with a <= b; paired on the day."""
    x, y = returns.select(F.col("symbol").alias("a"), "d", F.col("r").alias("ra")), returns.select(F.col("symbol").alias("b"), "d", F.col("r").alias("rb"))
    pairs = x.join(y, "d").filter("a <= b")
    return pairs.groupBy("a", "b").agg((F.covar_samp("ra", "rb") * DAYS).alias("cov"), F.corr("ra", "rb").alias("corr"), F.count(F.lit(1)).alias("n"))


def portfolio_series(returns: DataFrame) -> DataFrame:
    return returns.groupBy("d").agg(F.sum(F.col("r") * F.col("weight")).alias("r"))


def tail_risk(series: DataFrame, levels: tuple[float, ...] = (0.95, 0.99)) -> DataFrame:
    """level, var, cvar: the linear percentile, and the mean of the lowest int((n-1)(1-level))+1 returns."""
    ranked = series.withColumns({"i": F.row_number().over(Window.orderBy("r")), "n": F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))})
    out = None
    for level in levels:
        cut = 1 - level
        row = ranked.agg(
            F.lit(level).alias("level"), F.percentile("r", F.lit(cut)).alias("var"),
            F.avg(F.when(F.col("i") <= F.floor((F.col("n") - 1) * F.lit(cut)) + 1, F.col("r"))).alias("cvar"),
        )
        row = row.filter("var is not null")  # an empty series has no tail
        out = row if out is None else out.unionByName(row)
    return out


def ratios(series: DataFrame, risk_free: float = 0.0) -> DataFrame:
    """annual return, volatility, Sharpe, Sortino, maximum drawdown (from a base of one), Calmar."""
    daily_rf = (1 + risk_free) ** (1 / DAYS) - 1
    w = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    s = series.withColumn("v", F.exp(F.sum(F.log1p("r")).over(w)))
    s = s.withColumn("dd", F.col("v") / F.greatest(F.max("v").over(w), F.lit(1.0)) - 1)
    a = s.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.log1p("r")).alias("lg"), F.stddev_samp("r").alias("sd"), F.avg(F.col("r") - daily_rf).alias("ex"),
        F.sqrt(F.avg(F.pow(F.least(F.col("r") - daily_rf, F.lit(0.0)), 2))).alias("down"), F.min("dd").alias("max_drawdown"),
    )
    annual = F.exp(F.col("lg") * DAYS / F.col("n")) - 1
    return a.select(
        "n", annual.alias("annual_return"), (F.col("sd") * DAYS**0.5).alias("volatility"), (F.col("ex") / F.col("sd") * DAYS**0.5).alias("sharpe"),
        (F.col("ex") * DAYS / (F.col("down") * DAYS**0.5)).alias("sortino"), "max_drawdown", (annual / F.abs("max_drawdown")).alias("calmar"),
    )


def beta(series: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Slope of portfolio on benchmark returns over the days both have."""
    b = benchmark.select("d", (F.col("close") / F.lag("close").over(Window.orderBy("d")) - 1).alias("rb")).filter("rb is not null")
    return series.join(b, "d").agg(F.regr_slope("r", "rb").alias("beta"), F.count(F.lit(1)).alias("n"))


def concentration(holdings: DataFrame) -> DataFrame:
    return holdings.agg(F.sum(F.col("weight") * F.col("weight")).alias("hhi")).withColumn("effective_n", 1 / F.col("hhi"))
