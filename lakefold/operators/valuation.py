"""Valuation: multiples, two-stage value, implied growth by bisection, scenarios, peer and own PE bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def two_stage_value(eps: Column, growth: Column, years: Column, terminal: float, cost: float) -> Column:
    """Value of a share whose earnings grow by ``growth`` for ``years`` and by ``terminal`` ever after,
    discounted at ``cost``: a geometric series in closed form; null unless cost exceeds terminal growth."""
    if cost <= terminal:
        return F.lit(None).cast("double")
    q = (1 + growth) / (1 + cost)
    stage1 = F.when(F.abs(q - 1) < 1e-12, years.cast("double")).otherwise(q * (1 - F.pow(q, years)) / (1 - q))
    stage2 = F.pow(q, years) * (1 + terminal) / (cost - terminal)
    return eps * (stage1 + stage2)


def implied_growth(price: Column, eps: Column, years: int, terminal: float, cost: float, low: float = -0.2, high: float = 0.6, rounds: int = 60) -> Column:
    """The growth at which the two-stage value equals the price: bisection as a fold, all in the JVM.
    Null if price or earnings are not positive."""
    def step(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2
        over = two_stage_value(eps, mid, F.lit(years), terminal, cost) > price
        return F.struct(F.when(over, acc["lo"]).otherwise(mid).alias("lo"), F.when(over, mid).otherwise(acc["hi"]).alias("hi"))

    start = F.struct(F.lit(low).alias("lo"), F.lit(high).alias("hi"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)
    return F.when((price > 0) & (eps > 0), (end["lo"] + end["hi"]) / 2)


def graham_number(eps: Column, book: Column) -> Column:
    return F.when((eps > 0) & (book > 0), F.sqrt(22.5 * eps * book))


def multiples(df: DataFrame) -> DataFrame:
    """pe, ps, earnings yield and net margin from price, eps, mcap, revenue and profit columns; a
    denominator that is zero or missing gives null."""
    return df.withColumns({
        "pe_now": F.when(F.col("eps") > 0, F.col("price") / F.col("eps")),
        "ps": F.when(F.col("revenue") > 0, F.col("mcap") / F.col("revenue")),
        "earnings_yield_pct": F.when(F.col("price") > 0, F.col("eps") / F.col("price") * 100),
        "net_margin_pct": F.when(F.col("revenue") > 0, F.col("profit") / F.col("revenue") * 100),
    })


def scenarios(df: DataFrame, years: int, terminal: float, cost: float) -> DataFrame:
    """Bear, base and bull per row (columns symbol, price, eps, hist_growth): base growth is the known
    growth, or ten percent if unknown or zero, held within 0 and 25 percent; the others are five points
    off. scenario, growth, value, upside_pct."""
    known = F.when(F.col("hist_growth").isNull() | (F.col("hist_growth") == 0), 0.10).otherwise(F.col("hist_growth"))
    base = F.least(F.greatest(known, F.lit(0.0)), F.lit(0.25))
    rows = F.array(
        F.struct(F.lit("bear").alias("scenario"), F.greatest(base - 0.05, F.lit(0.0)).alias("growth")),
        F.struct(F.lit("base").alias("scenario"), base.alias("growth")),
        F.struct(F.lit("bull").alias("scenario"), (base + 0.05).alias("growth")),
    )
    out = df.select("symbol", "price", "eps", F.inline(rows))
    out = out.withColumn("value", two_stage_value(F.col("eps"), F.col("growth"), F.lit(years), terminal, cost))
    return out.select("symbol", "scenario", "growth", "value", F.when(F.col("price") > 0, (F.col("value") / F.col("price") - 1) * 100).alias("upside_pct"))


def peer_pe(universe: DataFrame, by: str, least: int = 3, most_pe: float = 200.0) -> DataFrame:
    """Median pe per group over sensible values, null with fewer than ``least`` of them."""
    ok = (F.col("pe") > 0) & (F.col("pe") < most_pe)
    g = universe.groupBy(by).agg(F.count_if(ok).alias("n_peers"), F.median(F.when(ok, F.col("pe"))).alias("m"))
    return g.select(by, "n_peers", F.when(F.col("n_peers") >= least, F.col("m")).alias("peer_pe"))


def own_pe_band(points: DataFrame, key: str, least: int = 4, most_pe: float = 300.0) -> DataFrame:
    """Median, lowest and highest of a company's own past pe, from rows with price and eps."""
    pe = points.withColumn("_pe", F.when(F.col("eps") > 0, F.col("price") / F.col("eps"))).filter((F.col("_pe") > 0) & (F.col("_pe") < most_pe))
    g = pe.groupBy(key).agg(F.count(F.lit(1)).alias("n_points"), F.median("_pe").alias("median_pe"), F.min("_pe").alias("low_pe"), F.max("_pe").alias("high_pe"))
    return g.filter(F.col("n_points") >= least)
