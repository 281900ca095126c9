"""Price-series queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakefold.operators import prices as P
from lakefold.sources import table

DAILY = """
  px as (select distinct px_id, symbol, date, open, high, low, close, volume from prices
         where close is not null and symbol is not null and date is not null),
  daily as (select symbol, date::date as d, first(open order by date, px_id) as open, max(high) as high, min(low) as low,
         last(close order by date, px_id) as close, sum(volume)::bigint as volume from px group by 1, 2),
  ranked as (select *, row_number() over (partition by symbol order by d desc) as back,
         row_number() over (partition by symbol order by d) as rn from daily)
"""
OFFSETS = {"r_1w": 5, "r_1m": 21, "r_3m": 63, "r_6m": 126, "r_1y": 252, "r_3y": 756, "r_5y": 1260}
_OFFSET_SQL = ", ".join(
    f"round((max(close) filter (back = 1) / max(close) filter (back = {n + 1}) - 1) * 100, 6) as {k}" for k, n in OFFSETS.items()
)


def _daily(spark: SparkSession, root: str) -> DataFrame:
    return P.daily_bars(table(spark, root, "prices", "px_id", "symbol", "date", "open", "high", "low", "close", "volume"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded so that the order of summation does not show."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def price_history(spark, root):
    return rounded(_daily(spark, root).filter("d between date'2024-01-01' and date'2024-12-31'"))


def sma_50_200(spark, root):
    d = _daily(spark, root).withColumns({"sma50": P.sma("close", 50), "sma200": P.sma("close", 200)})
    return rounded(d.select("symbol", "d", "sma50", "sma200"))


def macd(spark, root):
    return rounded(P.macd_last(_daily(spark, root)))


def rsi_live(spark, root):
    return rounded(P.rsi_live(_daily(spark, root)))


def rsi_batch(spark, root):
    return rounded(P.rsi_batch(_daily(spark, root)))


def returns_offset(spark, root):
    return rounded(P.offset_returns(_daily(spark, root), OFFSETS))


def range_52w(spark, root):
    return rounded(P.range_stats(_daily(spark, root)))


def drawdown(spark, root):
    return rounded(P.drawdowns(_daily(spark, root)))


def volatility(spark, root):
    return rounded(P.volatility(_daily(spark, root)))


def dma_state(spark, root):
    return rounded(P.dma_state(_daily(spark, root)))


def volume_trend(spark, root):
    return rounded(P.volume_trend(_daily(spark, root)))


def relative_strength(spark, root):
    d = _daily(spark, root)
    return rounded(P.relative_strength(d, P.market_series(d), {"rs_3m": 63, "rs_1y": 252}))


def resample_week(spark, root):
    return rounded(P.resample(_daily(spark, root), "week"))


def resample_month(spark, root):
    return rounded(P.resample(_daily(spark, root), "month"))


def yearly_return(spark, root):
    return rounded(P.yearly_returns(_daily(spark, root)))


def asof_price(spark, root):
    """Last close on or before each filing's period end."""
    filings = table(spark, root, "xbrl", "xbrl_id", "symbol", "period_end").withColumn("on_day", F.col("period_end").cast("date")).drop("period_end")
    px = _daily(spark, root).select("symbol", "d", "close")
    return rounded(P.as_of(filings, px, "symbol", "on_day", "d", ["close"]).select("xbrl_id", "close"))


def price_analytics(spark, root):
    """Range, drawdown, volatility and averages of every symbol with 30 rows or more."""
    t = P.technicals(_daily(spark, root)).filter("n_days >= 30")
    return rounded(t.select("symbol", "n_days", "close", "from_high_pct", "max_drawdown_pct", "drawdown_pct", "annual_vol_pct", "state"))


def technical_snapshot(spark, root):
    """The technical view per symbol with 20 rows or more: averages, oscillators, position and zone."""
    t = P.technicals(_daily(spark, root)).filter("n_days >= 20")
    zone = F.when(F.col("rsi") < 30, "oversold").when(F.col("rsi") > 70, "overbought").when(F.col("rsi").isNotNull(), "neutral")
    above50, above200 = F.coalesce(F.col("close") > F.col("dma_short"), F.lit(False)), F.coalesce(F.col("close") > F.col("dma_long"), F.lit(False))
    bullish = F.coalesce(F.col("macd") > F.col("macd_signal"), F.lit(False))
    return rounded(t.select("symbol", "n_days", "rsi", "macd", "macd_signal", zone.alias("zone"), above50.alias("above_dma50"), above200.alias("above_dma200"), bullish.alias("macd_bullish")))


def _ewm_sql(x: str, alpha: str, w: str = "(partition by symbol order by rn)") -> str:
    return f"(sum({x} * pow(1 - {alpha}, -rn)) over {w} / sum(pow(1 - {alpha}, -rn)) over {w})"


_MACD = f"""
  emas as (select symbol, d, rn, back, {_ewm_sql('close', '2.0/13')} - {_ewm_sql('close', '2.0/27')} as m from ranked),
  signals as (select *, {_ewm_sql('m', '2.0/10')} as sg from emas),
  macd as (select symbol, rn as n, m as macd, sg as macd_signal from signals where back = 1)
"""
_MOVES = """
  moves as (select symbol, d, rn - 1 as rn, back, close - lag(close) over (partition by symbol order by d) as x from ranked),
  mv as (select *, greatest(x, 0) as up, greatest(-x, 0) as down from moves where x is not null)
"""
_RSI = f"""
  {_MOVES},
  wilder as (select symbol, sum(up * case when rn = 1 then 1 else 1.0/14 end * pow(13.0/14, -rn)) as g,
     sum(down * case when rn = 1 then 1 else 1.0/14 end * pow(13.0/14, -rn)) as l from mv group by 1),
  rsi as (select symbol, case when l > 0 then 100 - 100 / (1 + g / l) end as rsi from wilder)
"""
_VOL = """
  rets as (select symbol, back, close / lag(close) over (partition by symbol order by d) - 1 as r from ranked),
  vol as (select symbol, count(r) as n_returns, stddev_samp(r) * sqrt(252) * 100 as v from rets where back <= 252 and r is not null group by 1)
"""
_DMA = """
  av as (select symbol, back, close, case when count(close) over w50 = 50 then avg(close) over w50 end as s,
     case when count(close) over w200 = 200 then avg(close) over w200 end as l from ranked
     window w50 as (partition by symbol order by d rows 49 preceding), w200 as (partition by symbol order by d rows 199 preceding)),
  dma as (select symbol, close, s as dma_short, l as dma_long, case when l is not null then case when s > l then 'golden' else 'death' end end as state from av where back = 1)
"""
_RANGE = """
  rng as (select symbol, max(close) filter (back = 1) as close, max(close) filter (back <= 252) as high_n, min(close) filter (back <= 252) as low_n,
    max(close) as ath, min(close) as atl from ranked group by 1)
"""
_DD = """
  dds as (select symbol, d, (close / max(close) over (partition by symbol order by d rows unbounded preceding) - 1) * 100 as dd from ranked),
  ddx as (select symbol, min(dd) as max_drawdown_pct, arg_max(dd, d) as drawdown_pct from dds group by 1)
"""


def _resample_sql(end: str) -> str:
    return f"""with {DAILY} select symbol, {end} as period_end, round(arg_min(open, d), 6) as open, round(max(high), 6) as high,
      round(min(low), 6) as low, round(arg_max(close, d), 6) as close, sum(volume)::bigint as volume from daily group by 1, 2"""


QUERIES = {
    "price_history": price_history, "sma": sma_50_200, "ema_macd": macd, "rsi_live": rsi_live, "rsi_batch": rsi_batch,
    "returns_lag": returns_offset, "range_52w": range_52w, "drawdown": drawdown, "volatility": volatility, "dma_state": dma_state,
    "volume_trend": volume_trend, "relative_strength": relative_strength, "resample_week": resample_week, "resample_month": resample_month,
    "yearly_return": yearly_return, "asof_price": asof_price, "price_analytics": price_analytics, "technicals_momentum": technical_snapshot,
}
SQL = {
    "price_history": f"with {DAILY} select symbol, d, open, high, low, close, volume from daily where d between '2024-01-01' and '2024-12-31'",
    "sma": f"""with {DAILY} select symbol, d,
        round(case when count(close) over w50 = 50 then avg(close) over w50 end, 6) as sma50,
        round(case when count(close) over w200 = 200 then avg(close) over w200 end, 6) as sma200 from daily
        window w50 as (partition by symbol order by d rows 49 preceding), w200 as (partition by symbol order by d rows 199 preceding)""",
    "ema_macd": f"with {DAILY}, {_MACD} select symbol, n::int as n, round(macd, 6) as macd, round(macd_signal, 6) as macd_signal from macd",
    "rsi_live": f"with {DAILY}, {_RSI} select symbol, round(rsi, 6) as rsi from rsi",
    "rsi_batch": f"""with {DAILY}, {_MOVES}, s as (select symbol, sum(up * pow(13.0/14, -rn)) as g, sum(down * pow(13.0/14, -rn)) as l from mv group by 1 having count(*) >= 14)
        select symbol, round(case when l > 0 then 100 - 100 / (1 + g / l) end, 6) as rsi from s""",
    "returns_lag": f"with {DAILY} select symbol, {_OFFSET_SQL} from ranked group by 1",
    "range_52w": f"""with {DAILY}, {_RANGE} select symbol, round(close, 6) as close, round(high_n, 6) as high_n, round(low_n, 6) as low_n, round(ath, 6) as ath, round(atl, 6) as atl,
        round((close / high_n - 1) * 100, 6) as from_high_pct, round((close / low_n - 1) * 100, 6) as from_low_pct from rng""",
    "drawdown": f"with {DAILY}, {_DD} select symbol, round(max_drawdown_pct, 6) as max_drawdown_pct, round(drawdown_pct, 6) as drawdown_pct from ddx",
    "volatility": f"with {DAILY}, {_VOL} select symbol, n_returns, round(case when n_returns >= 30 then v end, 6) as annual_vol_pct from vol",
    "dma_state": f"with {DAILY}, {_DMA} select symbol, round(dma_short, 6) as dma_short, round(dma_long, 6) as dma_long, state from dma",
    "volume_trend": f"""with {DAILY}, v as (select symbol, count(*) as n, avg(volume) filter (back <= 20) as s, avg(volume) as l from ranked where back <= 200 group by 1)
        select symbol, floor(s)::bigint as avg_short, floor(l)::bigint as avg_long, round(s / l * 100 - 100, 6) as trend_pct from v where n >= 200""",
    "relative_strength": f"""with {DAILY}, bm as (select d, avg(close) as close from daily group by 1), br as (select *, row_number() over (order by d desc) as back from bm),
        b as (select (max(close) filter (back = 1) / max(close) filter (back = 64) - 1) * 100 as b3, (max(close) filter (back = 1) / max(close) filter (back = 253) - 1) * 100 as b1 from br)
        select symbol, round((max(close) filter (back = 1) / max(close) filter (back = 64) - 1) * 100 - any_value(b3), 6) as rs_3m,
        round((max(close) filter (back = 1) / max(close) filter (back = 253) - 1) * 100 - any_value(b1), 6) as rs_1y from ranked, b group by 1""",
    "resample_week": _resample_sql("(date_trunc('week', d) + interval 6 day)::date"),
    "resample_month": _resample_sql("last_day(d)"),
    "yearly_return": f"""with {DAILY}, y as (select symbol, year(d)::int as calendar_year, arg_min(close, d) as start_price, arg_max(close, d) as end_price, count(*) as trading_days from daily group by 1, 2)
        select symbol, calendar_year, round(start_price, 6) as start_price, round(end_price, 6) as end_price, trading_days, round((end_price / start_price - 1) * 100, 6) as return_pct from y where start_price > 0""",
    "asof_price": f"""with {DAILY}, f as (select xbrl_id, symbol, period_end::date as on_day from xbrl)
        select f.xbrl_id, round(daily.close, 6) as close from f asof left join daily on f.symbol = daily.symbol and f.on_day >= daily.d""",
    "price_analytics": f"""with {DAILY}, {_RANGE}, {_DD}, {_VOL}, {_DMA}, n as (select symbol, count(*) as n_days from daily group by 1 having count(*) >= 30)
        select n.symbol, n_days, round(rng.close, 6) as close, round((rng.close / high_n - 1) * 100, 6) as from_high_pct, round(max_drawdown_pct, 6) as max_drawdown_pct,
        round(drawdown_pct, 6) as drawdown_pct, round(case when n_returns >= 30 then v end, 6) as annual_vol_pct, state
        from n left join rng using (symbol) left join ddx using (symbol) left join vol using (symbol) left join dma using (symbol)""",
    "technicals_momentum": f"""with {DAILY}, {_MACD}, {_RSI}, {_DMA}, n as (select symbol, count(*) as n_days from daily group by 1 having count(*) >= 20)
        select n.symbol, n_days, round(rsi, 6) as rsi, round(macd, 6) as macd, round(macd_signal, 6) as macd_signal,
        case when rsi < 30 then 'oversold' when rsi > 70 then 'overbought' when rsi is not null then 'neutral' end as zone,
        coalesce(close > dma_short, false) as above_dma50, coalesce(close > dma_long, false) as above_dma200, coalesce(macd > macd_signal, false) as macd_bullish
        from n join dma using (symbol) join rsi using (symbol) join macd using (symbol)""",
}
