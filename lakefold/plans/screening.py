"""Screening queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakefold.operators import prices as P
from lakefold.operators import screening as S
from lakefold.plans.prices import _DMA, DAILY, _daily, rounded
from lakefold.sources import table


def _num(x: str) -> str:
    return f"try_cast(regexp_replace(regexp_replace(trim({x}), '\\s*Cr\\.?$', '', 'i'), '[,%₹ ]', '', 'g') as double)"


ENT = f"""
  e0 as (select *, row_number() over (partition by symbol order by loaded_at desc nulls last, rec_id desc) as n_ from entities where symbol is not null),
  ent as (select * exclude (n_, market_cap_cr, price, pe), {_num('market_cap_cr')} as market_cap_cr, {_num('price')} as price, {_num('pe')} as pe from e0 where n_ = 1)
"""
_UNIVERSE = f"""{ENT}, {DAILY}, {_DMA},
  uni as (select ent.*, coalesce(dma.close > dma_short, false) as above_dma50, coalesce(dma.close > dma_long, false) as above_dma200 from ent left join dma using (symbol))"""
#: A screen used throughout: one text condition, three thresholds, one flag.
SPEC = {"text": {"industry": "a"}, "least": {"market_cap_cr": 300.0, "price": 50.0}, "most": {"pe": 40.0}}
_T = "coalesce(industry ilike '%a%', false)"
_S = [("universe", "true"), ("industry~a", _T), ("market_cap_cr>=300", "coalesce(market_cap_cr >= 300, true)"), ("price>=50", "coalesce(price >= 50, true)"), ("pe<=40", "coalesce(pe <= 40, true)")]
_ALL = " and ".join(c for _, c in _S)
EXCLUDED = {"metals and mining": ["metal", "mining"], "finance": ["financ", "nbfc"], "health": ["pharma", "laborator"]}
_TEXTS = ["industry", "sector", "nse_industry", "company_name", "about"]


def _entities(spark: SparkSession, root: str) -> DataFrame:
    return S.entity_master(table(spark, root, "entities"))


def _universe(spark: SparkSession, root: str) -> DataFrame:
    tech = P.technicals(_daily(spark, root)).select("symbol", (F.col("close") > F.col("dma_short")).alias("a50"), (F.col("close") > F.col("dma_long")).alias("a200"))
    out = _entities(spark, root).join(tech, "symbol", "left")
    return out.withColumns({"above_dma50": F.coalesce("a50", F.lit(False)), "above_dma200": F.coalesce("a200", F.lit(False))}).drop("a50", "a200")


def entity_master(spark, root):
    return rounded(_entities(spark, root).select("symbol", "company_name", "nse_symbol", "bse_code", "market_cap_cr", "price", "pe"))


def resolve_company_exact_then_contains(spark, root):
    return rounded(S.resolve_company(_entities(spark, root), "Gekkafur"))


def resolve_company_words(spark, root):
    return rounded(S.resolve_company(_entities(spark, root), "limited paper"))


def screen_funnel(spark, root):
    return S.Screen(_universe(spark, root), **SPEC, flags={"above_dma50": True}).funnel().select("step", "stage", "remaining")


def screen_null_pass(spark, root):
    return rounded(S.Screen(_entities(spark, root), **SPEC).matches().select("symbol", "market_cap_cr", "price", "pe"))


def screen_passed_unknown(spark, root):
    return S.Screen(_entities(spark, root), **SPEC).passed_unknown()


def screen_near_miss(spark, root):
    return rounded(S.Screen(_entities(spark, root), **SPEC).near_misses("symbol", 25.0, 15))


def screen_topn(spark, root):
    return rounded(S.Screen(_entities(spark, root), **SPEC).top("market_cap_cr", "symbol", 25).select("symbol", "market_cap_cr"))


def screen_drop_null(spark, root):
    return rounded(S.Screen(_entities(spark, root), **SPEC, null_policy="drop").matches().select("symbol", "market_cap_cr", "price", "pe"))


def ethics_exclusion_split(spark, root):
    e = _entities(spark, root).withColumn("reason", S.exclusion_reason(EXCLUDED, _TEXTS))
    return e.select("symbol", "reason", F.col("reason").isNotNull().alias("excluded"))


def ethics_exclusion_counts(spark, root):
    e = _entities(spark, root).withColumn("reason", S.exclusion_reason(EXCLUDED, _TEXTS)).filter("reason is not null")
    return e.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def sector_aggregate(spark, root):
    return rounded(S.sector_summary(_entities(spark, root), "industry"), 4)


def sector_leaders(spark, root):
    top = S.top_per_group(_entities(spark, root).filter("industry is not null"), "industry", [F.col("market_cap_cr").desc_nulls_last(), F.col("symbol")], 3)
    return rounded(top.select("industry", "rank", "symbol", "market_cap_cr"))


def sector_list(spark, root):
    return _entities(spark, root).select("nse_industry").filter("nse_industry is not null").distinct()


def financial_flag(spark, root):
    """Whether a company counts as financial: by its industry and sector, else by the start of its description."""
    e = _entities(spark, root).withColumn("_about", F.substring("about", 1, 200))
    return e.select("symbol", S.contains_any(["industry", "sector", "nse_industry", "_about"], ["financ", "bank", "nbfc", "insurance"]).alias("is_financial"))


def _history(spark, root):
    return P.yearly_returns(_daily(spark, root))


def consistency_screen(spark, root):
    return rounded(S.consistency(_history(spark, root), "symbol", "calendar_year", "return_pct", 0.0, n_years=5, max_violations=2, min_years=3), 5)


def screen_by_year_drop_null(spark, root):
    """Returns of 2024 with company attributes; rows without the number are dropped."""
    h = _history(spark, root).filter("calendar_year = 2024").join(_entities(spark, root).select("symbol", "company_name", "industry"), "symbol", "left")
    out = S.Screen(h, least={"return_pct": 0.0}, null_policy="drop").top("return_pct", "symbol", 20)
    return rounded(out.select("symbol", "company_name", "industry", "return_pct"), 5)


def screen_membership(spark, root):
    """Companies of the groups whose name holds 'finan', by size."""
    e = _entities(spark, root).filter(S.contains_any(["nse_industry"], ["finan"]))
    return e.select("symbol", "nse_industry", "market_cap_cr")


QUERIES = {f.__name__: f for f in (
    screen_membership,
    entity_master, resolve_company_exact_then_contains, resolve_company_words, screen_funnel, screen_null_pass, screen_passed_unknown, screen_near_miss,
    screen_topn, screen_drop_null, ethics_exclusion_split, ethics_exclusion_counts, sector_aggregate, sector_leaders, sector_list, financial_flag,
    consistency_screen, screen_by_year_drop_null,
)}


def _contains(columns: list[str], words: list[str]) -> str:
    return "(" + " or ".join(f"coalesce(lower({c}) like '%{w}%', false)" for c in columns for w in words) + ")"


_REASON = "case " + " ".join(f"when {_contains(_TEXTS, w)} then '{n}'" for n, w in EXCLUDED.items()) + " end"
_HIST = f"""{DAILY}, y0 as (select symbol, year(d)::int as calendar_year, arg_min(close, d) as s, arg_max(close, d) as e from daily group by 1, 2),
  hist as (select symbol, calendar_year, (e / s - 1) * 100 as return_pct from y0 where s > 0)"""
_FLAGGED = [*_S, ("above_dma50=true", "above_dma50")]

SQL = {
    "screen_membership": f"with {ENT} select symbol, nse_industry, market_cap_cr from ent where lower(nse_industry) like '%finan%'",
    "entity_master": f"with {ENT} select symbol, company_name, nse_symbol, bse_code, market_cap_cr, price, pe from ent",
    "resolve_company_exact_then_contains": f"""with {ENT}, m as (select *, lower(symbol) = 'gekkafur' as exact, coalesce(lower(symbol) like '%gekkafur%', false) or coalesce(lower(company_name) like '%gekkafur%', false) as l,
        coalesce(lower(company_name) like '%gekkafur%', false) as w from ent)
        select symbol, company_name, market_cap_cr, exact from m where exact or l or (w and not (select bool_or(l) from m)) order by exact desc, coalesce(market_cap_cr, -1) desc, symbol limit 8""",
    "resolve_company_words": f"""with {ENT}, m as (select *, lower(symbol) = 'limited paper' as exact, coalesce(lower(company_name) like '%limited paper%', false) as l,
        coalesce(lower(company_name) like '%limited%' and lower(company_name) like '%paper%', false) as w from ent)
        select symbol, company_name, market_cap_cr, exact from m where exact or l or (w and not (select bool_or(l) from m)) order by exact desc, coalesce(market_cap_cr, -1) desc, symbol limit 8""",
    "screen_funnel": f"with {_UNIVERSE} " + " union all ".join(
        f"select {i} as step, '{n}' as stage, count(*) filter ({' and '.join(c for _, c in _FLAGGED[: i + 1])}) as remaining from uni" for i, (n, _) in enumerate(_FLAGGED)),
    "screen_null_pass": f"with {ENT} select symbol, market_cap_cr, price, pe from ent where {_ALL}",
    "screen_passed_unknown": f"with {ENT} " + " union all ".join(f"select '{c}' as \"column\", count(*) filter ({c} is null) as n_unknown from ent where {_ALL}" for c in ("market_cap_cr", "price", "pe")),
    "screen_near_miss": f"""with {ENT}, t as (select symbol, market_cap_cr, price, pe, (coalesce(market_cap_cr < 300, false))::int + (coalesce(price < 50, false))::int + (coalesce(pe > 40, false))::int as k from ent where {_T}),
        f as (select symbol, case when market_cap_cr < 300 then 'market_cap_cr' when price < 50 then 'price' else 'pe' end as failed,
          case when market_cap_cr < 300 then market_cap_cr when price < 50 then price else pe end as actual, case when market_cap_cr < 300 then 300.0 when price < 50 then 50.0 else 40.0 end::double as threshold,
          case when market_cap_cr < 300 then (300 - market_cap_cr) / 300 * 100 when price < 50 then (50 - price) / 50 * 100 else (pe - 40) / 40 * 100 end as margin_pct from t where k = 1)
        select symbol, failed, round(actual, 6) as actual, threshold, round(margin_pct, 6) as margin_pct from f where margin_pct <= 25 order by f.margin_pct, symbol limit 15""",
    "screen_topn": f"with {ENT} select symbol, market_cap_cr from ent where {_ALL} order by market_cap_cr desc nulls last, symbol limit 25",
    "screen_drop_null": f"with {ENT} select symbol, market_cap_cr, price, pe from ent where {_T} and market_cap_cr >= 300 and price >= 50 and pe <= 40",
    "ethics_exclusion_split": f"with {ENT} select symbol, {_REASON} as reason, ({_REASON}) is not null as excluded from ent",
    "ethics_exclusion_counts": f"with {ENT} select {_REASON} as reason, count(*) as n from ent where ({_REASON}) is not null group by 1",
    "sector_aggregate": f"with {ENT} select industry, count(*) as n, round(sum(market_cap_cr), 4) as total_mcap, round(median(market_cap_cr), 4) as median_mcap, round(median(pe), 4) as median_pe from ent group by 1",
    "sector_leaders": f"""with {ENT}, r as (select industry, row_number() over (partition by industry order by market_cap_cr desc nulls last, symbol)::int as rank, symbol, market_cap_cr from ent where industry is not null)
        select * from r where rank <= 3""",
    "sector_list": f"with {ENT} select distinct nse_industry from ent where nse_industry is not null",
    "financial_flag": f"with {ENT} select symbol, {_contains(['industry', 'sector', 'nse_industry', 'about[1:200]'], ['financ', 'bank', 'nbfc', 'insurance'])} as is_financial from ent",
    "consistency_screen": f"""with {_HIST}, r as (select *, row_number() over (partition by symbol order by calendar_year desc) as n from hist)
        select symbol, count(*) as years, count(*) filter (return_pct < 0) as violations, round(min(return_pct), 5) as worst, arg_min(calendar_year, (return_pct, calendar_year)) as worst_year,
        round(avg(return_pct), 5) as mean, round(arg_max(return_pct, calendar_year), 5) as latest from r where n <= 5 group by 1 having count(*) >= 3 and count(*) filter (return_pct < 0) <= 2""",
    "screen_by_year_drop_null": f"""with {ENT}, {_HIST} select symbol, company_name, industry, round(return_pct, 5) as return_pct from hist left join ent using (symbol)
        where calendar_year = 2024 and return_pct >= 0 order by hist.return_pct desc, symbol limit 20""",
}
