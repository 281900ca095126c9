"""Valuation and portfolio queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakefold.operators import fundamentals as A
from lakefold.operators import portfolio as R
from lakefold.operators import prices as P
from lakefold.operators import valuation as V
from lakefold.plans.fundamentals import WIDE, _PREFERRED, _wide
from lakefold.plans.prices import DAILY, _daily, rounded
from lakefold.plans.screening import ENT, _entities

TERMINAL, COST, YEARS = 0.05, 0.1234, 10


def _points(spark: SparkSession, root: str) -> DataFrame:
    """symbol, q, eps (last four quarters), revenue, profit, price (last close on or before q)."""
    w = A.prefer_basis(_wide(spark, root))
    t = w.select("symbol", "consolidated", "q", A.trailing_sum("eps").alias("eps"), A.trailing_sum("revenue").alias("revenue"), A.trailing_sum("profit").alias("profit"))
    return P.as_of(t, _daily(spark, root).select("symbol", "d", F.col("close").alias("price")), "symbol", "q", "d", ["price"])


def _latest(spark: SparkSession, root: str) -> DataFrame:
    known = _points(spark, root).filter("eps is not null and price is not null")
    return A.newest(known, ["symbol"], F.col("q").desc())


def multiples(spark, root):
    e = _entities(spark, root).select("symbol", F.col("market_cap_cr").alias("mcap"))
    m = V.multiples(_latest(spark, root).join(e, "symbol", "left"))
    return rounded(m.select("symbol", "q", "pe_now", "ps", "earnings_yield_pct", "net_margin_pct"), 5)


def dcf_two_stage(spark, root):
    rows = _latest(spark, root).select("symbol", "eps", F.explode(F.array(*map(F.lit, (0.058, 0.108, 0.158, 0.246)))).alias("growth"))
    return rounded(rows.withColumn("value", V.two_stage_value(F.col("eps"), F.col("growth"), F.lit(YEARS), TERMINAL, COST)), 5)


def reverse_dcf(spark, root):
    p = _latest(spark, root)
    return rounded(p.select("symbol", V.implied_growth(F.col("price"), F.col("eps"), YEARS, TERMINAL, COST).alias("implied_growth")), 7)


def dcf_scenarios(spark, root):
    growth = A.cagr(A.prefer_basis(_wide(spark, root)), "eps").select("symbol", (F.col("cagr_pct") / 100).alias("hist_growth"))
    p = _latest(spark, root).select("symbol", "price", "eps").join(growth, "symbol", "left")
    return rounded(V.scenarios(p, YEARS, TERMINAL, COST), 4)


def graham(spark, root):
    w = _latest(spark, root)
    return rounded(w.select("symbol", V.graham_number(F.col("eps"), F.col("revenue") / 10).alias("graham")), 5)


def peer_pe(spark, root):
    return rounded(V.peer_pe(_entities(spark, root), "industry"))


def own_pe_band(spark, root):
    return rounded(V.own_pe_band(_points(spark, root), "symbol"), 5)


def pe_against_anchors(spark, root):
    """Text saying how far a company's pe is from that of its peers."""
    e = _entities(spark, root).select("symbol", "industry", "pe").join(V.peer_pe(_entities(spark, root), "industry"), "industry")
    gap = F.col("pe") / F.col("peer_pe") * 100 - 100
    return e.filter("pe > 0 and peer_pe > 0").select("symbol", F.format_string("%+.0f%% vs peers", F.round(gap, 0) + 0.0).alias("note"))


def _holdings(spark: SparkSession, root: str) -> DataFrame:
    """The four symbols with the most days of prices, weights 4:3:2:1 to be normalised."""
    n = _daily(spark, root).groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "symbol").limit(4)
    ranked = n.withColumn("weight", (5 - F.row_number().over(R.Window.orderBy(F.col("n").desc(), "symbol"))).cast("double"))
    return R.normalised(ranked.select("symbol", "weight"))


def _returns(spark: SparkSession, root: str) -> DataFrame:
    return R.aligned_returns(_daily(spark, root), _holdings(spark, root))


def weights(spark, root):
    return rounded(_holdings(spark, root))


def portfolio_cov(spark, root):
    return rounded(R.covariance(_returns(spark, root)))


def portfolio_var_cvar(spark, root):
    return rounded(R.tail_risk(R.portfolio_series(_returns(spark, root))), 7)


def portfolio_ratios(spark, root):
    return rounded(R.ratios(R.portfolio_series(_returns(spark, root)), 0.065), 5)


def portfolio_beta(spark, root):
    return rounded(R.beta(R.portfolio_series(_returns(spark, root)), P.market_series(_daily(spark, root))))


def hhi(spark, root):
    return rounded(R.concentration(_holdings(spark, root)))


QUERIES = {f.__name__: f for f in (
    multiples, dcf_two_stage, reverse_dcf, dcf_scenarios, graham, peer_pe, own_pe_band, pe_against_anchors, weights, portfolio_cov, portfolio_var_cvar, portfolio_ratios, portfolio_beta, hhi,
)}
QUERIES["portfolio_weights"] = QUERIES.pop("weights")

_POINTS = f"""{WIDE}, {_PREFERRED}, {DAILY},
  tt as (select symbol, consolidated, q, {', '.join(f"case when count({c}) over w = 4 then sum({c}) over w end as {c}" for c in ('eps', 'revenue', 'profit'))} from pw window w as (partition by symbol, consolidated order by q rows 3 preceding)),
  pts as (select tt.*, daily.close as price from tt asof left join daily on tt.symbol = daily.symbol and tt.q >= daily.d),
  lat as (select * from (select *, row_number() over (partition by symbol order by q desc) as n_ from pts where eps is not null and price is not null) where n_ = 1)"""


def _value(eps: str, g: str) -> str:
    q = f"((1 + {g}) / (1 + {COST}))"
    return f"({eps} * ({q} * (1 - pow({q}, {YEARS})) / (1 - {q}) + pow({q}, {YEARS}) * (1 + {TERMINAL}) / ({COST} - {TERMINAL})))"


_PORT = f"""{DAILY}, hn as (select symbol, count(*) as n from daily group by 1 order by n desc, symbol limit 4),
  hw as (select symbol, (5 - row_number() over (order by n desc, symbol))::double as w0 from hn), h as (select symbol, w0 / sum(w0) over () as weight, abs(round(sum(w0) over (), 4) - 1) > 0.01 as rescaled from hw),
  hd as (select symbol, d, close, weight from daily join h using (symbol)), days as (select d from hd group by 1 having count(distinct symbol) = (select count(*) from h)),
  rr as (select * from (select symbol, d, weight, close / lag(close) over (partition by symbol order by d) - 1 as r from hd join days using (d)) where r is not null),
  ser as (select d, sum(r * weight) as r from rr group by 1)"""
_RF = (1 + 0.065) ** (1 / 252) - 1

SQL = {
    "multiples": f"""with {_POINTS}, {ENT.strip()} select lat.symbol, q, round(case when eps > 0 then lat.price / eps end, 5) as pe_now, round(case when revenue > 0 then market_cap_cr / revenue end, 5) as ps,
        round(case when lat.price > 0 then eps / lat.price * 100 end, 5) as earnings_yield_pct, round(case when revenue > 0 then profit / revenue * 100 end, 5) as net_margin_pct from lat left join ent on lat.symbol = ent.symbol""",
    "dcf_two_stage": f"with {_POINTS}, g as (select symbol, eps, unnest([0.058, 0.108, 0.158, 0.246])::double as growth from lat) select symbol, round(eps, 5) as eps, growth, round({_value('eps', 'growth')}, 5) as value from g",
    "reverse_dcf": f"""with recursive {_POINTS}, b as (select symbol, price, eps, -0.2::double as lo, 0.6::double as hi, 0 as i from lat where price > 0 and eps > 0
        union all select symbol, price, eps, case when {_value('eps', '((lo + hi) / 2)')} > price then lo else (lo + hi) / 2 end, case when {_value('eps', '((lo + hi) / 2)')} > price then (lo + hi) / 2 else hi end, i + 1 from b where i < 60)
        select lat.symbol, round((lo + hi) / 2, 7) as implied_growth from lat left join (select * from b where i = 60) b using (symbol)""",
    "dcf_scenarios": f"""with {_POINTS}, ends as (select symbol, count(eps) as n, arg_min(eps, q) filter (eps is not null) as a, arg_max(eps, q) filter (eps is not null) as z from pw group by 1),
        hg as (select symbol, case when n > 1 and a > 0 and z > 0 then pow(z / a, 4.0 / (n - 1)) - 1 end as g from ends),
        b as (select symbol, price, eps, least(greatest(case when g is null or g = 0 then 0.1 else g end, 0), 0.25) as base from lat left join hg using (symbol)),
        s as (select symbol, price, eps, 'bear' as scenario, greatest(base - 0.05, 0) as growth from b union all select symbol, price, eps, 'base', base from b union all select symbol, price, eps, 'bull', base + 0.05 from b)
        select symbol, scenario, round(growth, 4) as growth, round({_value('eps', 'growth')}, 4) as value, round(case when price > 0 then ({_value('eps', 'growth')} / price - 1) * 100 end, 4) as upside_pct from s""",
    "graham": f"with {_POINTS} select symbol, round(case when eps > 0 and revenue > 0 then sqrt(22.5 * eps * revenue / 10) end, 5) as graham from lat",
    "peer_pe": f"with {ENT} select industry, count(*) filter (pe > 0 and pe < 200) as n_peers, round(case when count(*) filter (pe > 0 and pe < 200) >= 3 then median(pe) filter (pe > 0 and pe < 200) end, 6) as peer_pe from ent group by 1",
    "own_pe_band": f"""with {_POINTS}, x as (select symbol, price / eps as pe from pts where eps > 0 and price / eps > 0 and price / eps < 300)
        select symbol, count(*) as n_points, round(median(pe), 5) as median_pe, round(min(pe), 5) as low_pe, round(max(pe), 5) as high_pe from x group by 1 having count(*) >= 4""",
    "pe_against_anchors": f"""with {ENT}, p as (select industry, case when count(*) filter (pe > 0 and pe < 200) >= 3 then median(pe) filter (pe > 0 and pe < 200) end as peer_pe from ent group by 1)
        select symbol, printf('%+.0f%% vs peers', round(pe / peer_pe * 100 - 100, 0) + 0.0) as note from ent join p using (industry) where pe > 0 and peer_pe > 0""",
    "portfolio_weights": f"with {_PORT} select symbol, round(weight, 6) as weight, rescaled from h",
    "portfolio_cov": f"""with {_PORT} select x.symbol as a, y.symbol as b, round(covar_samp(x.r, y.r) * 252, 6) as cov, round(corr(x.r, y.r), 6) as corr, count(*) as n from rr x join rr y on x.d = y.d and x.symbol <= y.symbol group by 1, 2""",
    "portfolio_var_cvar": f"""with {_PORT}, k as (select r, row_number() over (order by r) as i, count(*) over () as n from ser), l as (select unnest([0.95, 0.99])::double as level)
        select level, round(case when level = 0.95 then quantile_cont(r, 0.05) else quantile_cont(r, 0.01) end, 7) as var, round(avg(r) filter (i <= floor((n - 1) * (1 - level)) + 1), 7) as cvar from k, l group by level""",
    "portfolio_ratios": f"""with {_PORT}, c as (select d, r, exp(sum(ln(1 + r)) over (order by d)) as v from ser), dd as (select *, v / greatest(max(v) over (order by d), 1) - 1 as dd from c),
        a as (select count(*) as n, sum(ln(1 + r)) as lg, stddev_samp(r) as sd, avg(r - {_RF}) as ex, sqrt(avg(pow(least(r - {_RF}, 0), 2))) as down, min(dd) as mdd from dd)
        select n, round(exp(lg * 252 / n) - 1, 5) as annual_return, round(sd * sqrt(252), 5) as volatility, round(ex / sd * sqrt(252), 5) as sharpe, round(ex * 252 / (down * sqrt(252)), 5) as sortino,
        round(mdd, 5) as max_drawdown, round((exp(lg * 252 / n) - 1) / abs(mdd), 5) as calmar from a""",
    "portfolio_beta": f"""with {_PORT}, bm as (select d, avg(close) as close from daily group by 1), br as (select d, close / lag(close) over (order by d) - 1 as rb from bm)
        select round(regr_slope(r, rb), 6) as beta, count(*) as n from ser join br using (d) where rb is not null""",
    "hhi": f"with {_PORT} select round(sum(weight * weight), 6) as hhi, round(1 / sum(weight * weight), 6) as effective_n from h",
}
