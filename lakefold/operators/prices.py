"""Price-series operators: daily bars, moving averages, oscillators, returns, risk, resampling, as-of."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRADING_DAYS = 252


def _series():
    return Window.partitionBy("symbol").orderBy("d")


def daily_bars(bars: DataFrame) -> DataFrame:
    """One row per symbol and day (symbol, d, open, high, low, close, volume) from bars that may be
    intraday, redelivered (same px_id) or halted (null close). One shuffle by symbol and day serves both
    the removal of redeliveries and the aggregation; a symbol with many rows is spread over its days."""
    clean = bars.filter("close is not null and symbol is not null and date is not null")
    clean = clean.select("px_id", "symbol", F.col("date").cast("date").alias("d"), "date", "open", "high", "low", "close", "volume")
    clean = clean.repartition("symbol", "d").dropDuplicates(["symbol", "d", "px_id"])
    at = F.struct("date", "px_id")
    return clean.groupBy("symbol", "d").agg(
        F.min_by("open", at).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", at).alias("close"), F.sum("volume").alias("volume"),
    )


def sma(column: str, n: int) -> Column:
    """Simple moving average, null until the window is full."""
    w = _series().rowsBetween(-n + 1, 0)
    return F.when(F.count(column).over(w) == n, F.avg(column).over(w))


def pct_change(column: str, n: int = 1) -> Column:
    return F.col(column) / F.lag(column, n).over(_series()) - 1


def last_rows(df: DataFrame, n: int = 1, out: str = "back") -> DataFrame:
    """The last ``n`` rows per symbol, numbered from 1 (newest) in ``out``."""
    w = Window.partitionBy("symbol").orderBy(F.col("d").desc())
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= n)


def _ewm_last(series: Column, alpha: float) -> Column:
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w"))

    def step(acc: Column, x: Column) -> Column:
        return F.struct((acc["s"] * (1 - alpha) + x).alias("s"), (acc["w"] * (1 - alpha) + 1).alias("w"))

    end = F.aggregate(series, start, step)
    return F.when(end["w"] > 0, end["s"] / end["w"])


def _macd_start() -> Column:
    return F.struct(*[F.lit(0.0).alias(k) for k in ("fs", "fw", "ss", "sw", "gs", "gw", "m")])


def _macd_step(fast: int, slow: int, signal: int):
    """One close folded into both averages and the signal average; weights are normalised by the history
    there is, and the history itself is not kept."""
    a, b, c = 2 / (fast + 1), 2 / (slow + 1), 2 / (signal + 1)

    def step(acc: Column, x: Column) -> Column:
        fs, fw = acc["fs"] * (1 - a) + x, acc["fw"] * (1 - a) + 1
        ss, sw = acc["ss"] * (1 - b) + x, acc["sw"] * (1 - b) + 1
        m = fs / fw - ss / sw
        return F.struct(fs.alias("fs"), fw.alias("fw"), ss.alias("ss"), sw.alias("sw"), (acc["gs"] * (1 - c) + m).alias("gs"), (acc["gw"] * (1 - c) + 1).alias("gw"), m.alias("m"))

    return step


def _wilder_start() -> Column:
    return F.struct(F.lit(None).cast("double").alias("g"), F.lit(None).cast("double").alias("l"))


def _wilder_step(n: int):
    alpha = 1 / n

    def step(acc: Column, x: Column) -> Column:
        up, down = F.greatest(x, F.lit(0.0)), F.greatest(-x, F.lit(0.0))
        return F.struct(
            F.when(acc["g"].isNull(), up).otherwise(acc["g"] * (1 - alpha) + up * alpha).alias("g"),
            F.when(acc["l"].isNull(), down).otherwise(acc["l"] * (1 - alpha) + down * alpha).alias("l"),
        )

    return step


def _wilder_rsi(end: Column) -> Column:
    return F.when(end["l"] > 0, 100 - 100 / (1 + end["g"] / end["l"]))


def macd_last(daily: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """symbol, n, macd, macd_signal at the last row of each symbol, by one fold of its closes."""
    series = daily.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("d", "close"))).alias("s"))
    closes = F.transform("s", lambda x: x["close"])
    end = series.select("symbol", F.size("s").alias("n"), F.aggregate(closes, _macd_start(), _macd_step(fast, slow, signal)).alias("e"))
    return end.select("symbol", "n", F.col("e.m").alias("macd"), (F.col("e.gs") / F.col("e.gw")).alias("macd_signal"))


def technicals(daily: DataFrame, short: int = 50, long: int = 200, year: int = TRADING_DAYS, least: int = 30) -> DataFrame:
    """All last-row figures of every symbol in one row: n_days, close, dma_short, dma_long, state, rsi,
    macd, macd_signal, high_n, low_n, from_high_pct, max_drawdown_pct, drawdown_pct, n_returns,
    annual_vol_pct. The series of a symbol is brought together once and folded; no figure shuffles or
    scans on its own. Definitions as in the single operators."""
    s = daily.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("d", "close"))).alias("s"))
    s = s.select("symbol", F.transform("s", lambda x: x["close"]).alias("c")).withColumn("n", F.size("c"))
    one, n = F.lit(1), F.col("n")
    later, earlier = F.slice("c", F.lit(2), n - 1), F.slice("c", one, n - 1)
    s = s.withColumns({
        "_x": F.zip_with(later, earlier, lambda b, a: b - a), "_r": F.zip_with(later, earlier, lambda b, a: b / a - 1),
        "_y": F.slice("c", F.greatest(n - year + 1, one), year),
    })

    def mean_of_last(k: int) -> Column:
        return F.when(n >= k, F.aggregate(F.slice("c", F.greatest(n - k + 1, one), k), F.lit(0.0), lambda a, x: a + x) / k)

    def fall(acc: Column, x: Column) -> Column:
        peak = F.greatest(acc["peak"], x)
        now = (x / peak - 1) * 100
        return F.struct(peak.alias("peak"), F.least(acc["worst"], now).alias("worst"), now.alias("now"))

    start = F.struct(F.lit(float("-inf")).alias("peak"), F.lit(0.0).alias("worst"), F.lit(0.0).alias("now"))
    s = s.withColumns({
        "dma_short": mean_of_last(short), "dma_long": mean_of_last(long), "_m": F.aggregate("c", _macd_start(), _macd_step(12, 26, 9)),
        "_w": F.aggregate("_x", _wilder_start(), _wilder_step(14)), "_d": F.aggregate("c", start, fall), "high_n": F.array_max("_y"), "low_n": F.array_min("_y"),
        "_r": F.slice("_r", F.greatest(F.size("_r") - year + 1, one), year),
    }).withColumns({"n_returns": F.size("_r"), "_mean": F.aggregate("_r", F.lit(0.0), lambda a, x: a + x) / F.size("_r")})
    spread = F.aggregate("_r", F.lit(0.0), lambda a, x: a + (x - F.col("_mean")) * (x - F.col("_mean")))
    close = F.element_at("c", -1)
    return s.select(
        "symbol", n.cast("bigint").alias("n_days"), close.alias("close"), "dma_short", "dma_long",
        F.when(F.col("dma_long").isNotNull(), F.when(F.col("dma_short") > F.col("dma_long"), "golden").otherwise("death")).alias("state"),
        _wilder_rsi(F.col("_w")).alias("rsi"), F.col("_m.m").alias("macd"), (F.col("_m.gs") / F.col("_m.gw")).alias("macd_signal"),
        "high_n", "low_n", ((close / F.col("high_n") - 1) * 100).alias("from_high_pct"), F.col("_d.worst").alias("max_drawdown_pct"), F.col("_d.now").alias("drawdown_pct"),
        F.col("n_returns").cast("bigint").alias("n_returns"), F.when(F.col("n_returns") >= least, F.sqrt(spread / (F.col("n_returns") - 1)) * (TRADING_DAYS**0.5) * 100).alias("annual_vol_pct"),
    )


def _moves(daily: DataFrame) -> DataFrame:
    change = F.col("close") - F.lag("close").over(_series())
    moved = daily.withColumn("_x", change).filter("_x is not null")
    return moved.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("d", "_x"))).alias("s"))


def rsi_live(daily: DataFrame, n: int = 14) -> DataFrame:
    """symbol, rsi at the last row: Wilder smoothing that starts at the first move; no losses gives null."""
    moves = F.transform("s", lambda x: x["_x"])
    return _moves(daily).select("symbol", F.aggregate(moves, _wilder_start(), _wilder_step(n)).alias("e")).select("symbol", _wilder_rsi(F.col("e")).alias("rsi"))


def rsi_batch(daily: DataFrame, n: int = 14) -> DataFrame:
    """symbol, rsi at the last row: smoothing with normalised weights, needs ``n`` moves."""
    alpha = 1 / n
    m = _moves(daily).filter(F.size("s") >= n)
    gain = _ewm_last(F.transform("s", lambda x: F.greatest(x["_x"], F.lit(0.0))), alpha)
    loss = _ewm_last(F.transform("s", lambda x: F.greatest(-x["_x"], F.lit(0.0))), alpha)
    return m.select("symbol", gain.alias("g"), loss.alias("l")).select("symbol", F.when(F.col("l") > 0, 100 - 100 / (1 + F.col("g") / F.col("l"))).alias("rsi"))


def offset_returns(daily: DataFrame, offsets: dict[str, int]) -> DataFrame:
    """symbol, one percentage per row offset back from the last row; null where the history is shorter.
    Only the rows at the offsets are kept, by rank, in one aggregation."""
    ranked = last_rows(daily, max(offsets.values()) + 1)
    pick = {k: F.max(F.when(F.col("back") == n + 1, F.col("close"))) for k, n in offsets.items()}
    now = F.max(F.when(F.col("back") == 1, F.col("close")))
    return ranked.groupBy("symbol").agg(*[((now / v - 1) * 100).alias(k) for k, v in pick.items()])


def range_stats(daily: DataFrame, n: int = TRADING_DAYS) -> DataFrame:
    """symbol, last close, high and low over the last ``n`` rows, distances in percent, all-time high
    and low."""
    ranked = daily.withColumn("back", F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("d").desc())))
    recent = F.col("back") <= n
    agg = ranked.groupBy("symbol").agg(
        F.max(F.when(F.col("back") == 1, F.col("close"))).alias("close"),
        F.max(F.when(recent, F.col("close"))).alias("high_n"), F.min(F.when(recent, F.col("close"))).alias("low_n"),
        F.max("close").alias("ath"), F.min("close").alias("atl"),
    )
    return agg.withColumns({
        "from_high_pct": (F.col("close") / F.col("high_n") - 1) * 100, "from_low_pct": (F.col("close") / F.col("low_n") - 1) * 100,
    })


def drawdowns(daily: DataFrame) -> DataFrame:
    """symbol, max_drawdown_pct, drawdown_pct (at the last row)."""
    peak = F.max("close").over(_series().rowsBetween(Window.unboundedPreceding, 0))
    dd = daily.withColumn("dd", (F.col("close") / peak - 1) * 100)
    return dd.groupBy("symbol").agg(F.min("dd").alias("max_drawdown_pct"), F.max_by("dd", "d").alias("drawdown_pct"))


def volatility(daily: DataFrame, n: int = TRADING_DAYS, least: int = 30) -> DataFrame:
    """symbol, n_returns, annual_vol_pct of the last ``n`` daily returns; null below ``least`` returns."""
    r = last_rows(daily.withColumn("r", pct_change("close")), n).filter("r is not null")
    return r.groupBy("symbol").agg(F.count("r").alias("n_returns"), (F.stddev_samp("r") * (TRADING_DAYS**0.5) * 100).alias("v")).select(
        "symbol", "n_returns", F.when(F.col("n_returns") >= least, F.col("v")).alias("annual_vol_pct")
    )


def dma_state(daily: DataFrame, short: int = 50, long: int = 200) -> DataFrame:
    """symbol, dma_short, dma_long, state at the last row: golden if the short average is above the long
    one, else death; null without a long average."""
    both = daily.withColumns({"dma_short": sma("close", short), "dma_long": sma("close", long)})
    return last_rows(both).select(
        "symbol", "dma_short", "dma_long",
        F.when(F.col("dma_long").isNotNull(), F.when(F.col("dma_short") > F.col("dma_long"), "golden").otherwise("death")).alias("state"),
    )


def volume_trend(daily: DataFrame, short: int = 20, long: int = 200) -> DataFrame:
    """symbol, average volume of the last ``short`` and ``long`` rows (whole numbers), their ratio in
    percent; only symbols with ``long`` rows."""
    r = last_rows(daily, long)
    out = r.groupBy("symbol").agg(
        F.count("*").alias("n"), F.avg(F.when(F.col("back") <= short, F.col("volume"))).alias("s"), F.avg("volume").alias("l")
    ).filter(F.col("n") >= long)
    return out.select("symbol", F.floor("s").alias("avg_short"), F.floor("l").alias("avg_long"), (F.col("s") / F.col("l") * 100 - 100).alias("trend_pct"))


def relative_strength(daily: DataFrame, benchmark: DataFrame, offsets: dict[str, int]) -> DataFrame:
    """symbol, per offset the return less that of the benchmark series (d, close); the benchmark is one
    row after aggregation."""
    mine = offset_returns(daily, offsets)
    bench = offset_returns(benchmark.withColumn("symbol", F.lit("_")), offsets).drop("symbol")
    bench = bench.select(*[F.col(k).alias(f"_b_{k}") for k in offsets])
    return mine.crossJoin(F.broadcast(bench)).select("symbol", *[(F.col(k) - F.col(f"_b_{k}")).alias(k) for k in offsets])


def market_series(daily: DataFrame) -> DataFrame:
    """d, close: the equally weighted mean close of all symbols per day."""
    return daily.groupBy("d").agg(F.avg("close").alias("close"))


def resample(daily: DataFrame, rule: str) -> DataFrame:
    """OHLCV per calendar week (label: Sunday) or month (label: last day)."""
    end = {"week": F.date_add(F.trunc("d", "week"), 6), "month": F.last_day("d")}[rule]
    return daily.groupBy("symbol", end.alias("period_end")).agg(
        F.min_by("open", "d").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "d").alias("close"), F.sum("volume").alias("volume"),
    )


def yearly_returns(daily: DataFrame) -> DataFrame:
    """symbol, calendar_year, start_price, end_price, trading_days, return_pct; start must be positive."""
    y = daily.groupBy("symbol", F.year("d").alias("calendar_year")).agg(
        F.min_by("close", "d").alias("start_price"), F.max_by("close", "d").alias("end_price"), F.count("*").alias("trading_days")
    ).filter("start_price > 0")
    return y.withColumn("return_pct", (F.col("end_price") / F.col("start_price") - 1) * 100)


def as_of(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """``left`` with ``values`` of the last right row of the same ``by`` at or before ``left_time``; null if
    none. Union and carry forward, one shuffle; no pair of rows is formed."""
    def side(df: DataFrame, time: str, number: int) -> DataFrame:
        base = [F.col(by).alias("_by"), F.col(time).alias("_t"), F.lit(number).alias("_side")]
        if number == 1:
            return df.select(*base, F.struct(*[F.col(c) for c in left.columns]).alias("_left"), *[F.lit(None).cast(dict(right.dtypes)[v]).alias(v) for v in values])
        return df.select(*base, F.lit(None).cast(left_type).alias("_left"), *values)

    left_type = left.select(F.struct(*left.columns).alias("s")).schema["s"].dataType
    both = side(right, right_time, 0).unionByName(side(left, left_time, 1))
    w = Window.partitionBy("_by").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    row = F.when(F.col("_side") == 0, F.struct(*values))
    both = both.withColumn("_row", F.last(row, ignorenulls=True).over(w)).filter("_side = 1")
    return both.select("_left.*", *[F.col(f"_row.{v}").alias(v) for v in values])


def stack_columns(parts: list[DataFrame], key: str = "symbol") -> DataFrame:
    """One row per key with the columns of all parts (full outer)."""
    return reduce(lambda a, b: a.join(b, key, "full"), parts)
