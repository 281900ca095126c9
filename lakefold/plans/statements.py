"""Queries over yearly statements and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakefold.operators import screening as S
from lakefold.operators import statements as A
from lakefold.plans.prices import rounded
from lakefold.plans.screening import ENT, _entities
from lakefold.plans.wide import _EMPTY, _LABEL, _MONTH, _PCT, _TIDY, _key_sql, _number_sql
from lakefold.sources import table


def _series(spark: SparkSession, root: str) -> DataFrame:
    records = table(spark, root, "screener", "rec_id", "symbol", "basis", "statement", "rows", "scraped_at")
    return A.statement_series(records, table(spark, root, "metric_catalog"))


def _history(spark: SparkSession, root: str, attribute: str) -> DataFrame:
    rows = table(spark, root, "tijori", "symbol", "metrics", "val", "scraped_at", "rec_id")
    return A.metric_history(rows, table(spark, root, "metric_catalog"), attribute)


def _financial(spark: SparkSession, root: str) -> DataFrame:
    e = _entities(spark, root).withColumn("_about", F.substring("about", 1, 200))
    return e.select("symbol", S.contains_any(["sector", "industry", "nse_industry", "_about"], list(A.FINANCIAL_WORDS)).alias("is_financial"))


def statement_series(spark, root):
    return rounded(_series(spark, root), 6)


def series_growth(spark, root):
    """First, last, sum and compound growth of every line of every company."""
    return rounded(A.series_ends(_series(spark, root), ["symbol", "attribute"]), 4)


def derived_columns(spark, root):
    return rounded(A.derived_columns(_series(spark, root)), 6)


def return_on_capital(spark, root):
    return rounded(A.returns_on_capital(_series(spark, root)), 4)


def balance_multiples(spark, root):
    return rounded(A.balance_multiples(_entities(spark, root), _series(spark, root)), 3)


def cash_ratio(spark, root):
    return rounded(A.cash_conversion(_series(spark, root)), 4)


def capital_flags(spark, root):
    return rounded(A.capital_allocation(_series(spark, root)), 4)


def ownership_trend(spark, root):
    """The promoters' pledge over time: first against last reading, with a band."""
    return rounded(A.change_flags(A.series_ends(_history(spark, root, "promoter_pledge"), ["symbol"], "at").drop("total", "cagr_pct")), 4)


def pledge_flag(spark, root):
    """The last reading of the pledge; over five percent is a concern."""
    last = A.series_ends(_history(spark, root, "promoter_pledge"), ["symbol"], "at")
    return rounded(last.select("symbol", F.col("last").alias("pledge_pct"), F.when(F.col("last") > 5, "concern").otherwise("clean").alias("flag")), 4)


def health_flags(spark, root):
    return A.trend_flags(_series(spark, root), _financial(spark, root), _history(spark, root, "receivable_days"))


def health_flag_counts(spark, root):
    return health_flags(spark, root).groupBy("category", "signal").agg(F.count(F.lit(1)).alias("n"))


def screen_by_year_fundamentals(spark, root):
    """Companies whose sales of 2024 grew by at least ten percent on the last year before with sales."""
    return rounded(A.yearly_screen_values(_series(spark, root), "sales", True).filter("year = 2024 and value >= 10"), 4)


def screen_consistency_fundamentals(spark, root):
    """Companies with an operating margin of at least five percent in the last three years, one exception allowed."""
    return rounded(A.consistent(A.yearly_screen_values(_series(spark, root), "opm", False), 3, 5.0, 1), 4)


QUERIES = {f.__name__: f for f in (
    statement_series, series_growth, derived_columns, return_on_capital, balance_multiples, cash_ratio, capital_flags, ownership_trend, pledge_flag, health_flags, health_flag_counts,
    screen_by_year_fundamentals, screen_consistency_fundamentals,
)}

SERIES = f"""
  cat as (select src, statement, attribute, value_type, {_key_sql('label')} as k from metric_catalog),
  c0 as (select *, row_number() over (partition by symbol, statement order by case when basis = 'consolidated' then 0 else 1 end, scraped_at desc nulls last, rec_id desc) as n
    from screener where len(rows) > 0 and symbol is not null and statement is not null),
  c1 as (select symbol, statement, unnest(range(len(rows))) as pos, unnest(rows) as r from c0 where n = 1),
  c2 as (select symbol, c1.statement, attribute, value_type, pos, unnest(map_entries(r)) as e from c1 join cat on cat.src = 'screener' and cat.statement = c1.statement and {_key_sql("r['metric']")} = cat.k),
  c3 as (select symbol, statement, attribute, value_type, pos, e.key as label, e.value as val, lower(trim(regexp_replace(e.key, '[\\s\\x{{00a0}}\\x{{2007}}\\x{{202f}}\\x{{200b}}]+', ' ', 'g'))) as p from c2 where e.key <> 'metric' and e.value is not null),
  c4 as (select *, lower({_TIDY}) as lv, regexp_extract(p, {_LABEL}, 2) as mon, regexp_extract(p, {_LABEL}, 3) as y from c3),
  c5 as (select *, case when regexp_full_match(p, '\\d{{4}}-\\d{{2}}(-\\d{{2}})?') then p[1:7] when mon <> '' and {_MONTH} > 0 then lpad(y, 4, '20') || '-' || lpad({_MONTH}::varchar, 2, '0') end as month,
    case when lv in {_EMPTY} then null when value_type = 'percent' then {_number_sql(_PCT)} else {_number_sql('lv')} end as value from c4),
  series as (select symbol, statement, attribute, month, arg_min(value, (pos, label)) as value from c5 where month is not null and value is not null group by 1, 2, 3, 4)
"""


def _history_sql(attribute: str, name: str) -> str:
    return f"""
  {name}_0 as (select symbol, scraped_at as seen, rec_id, value_type, lower({_TIDY}) as lv from tijori join (select distinct {_key_sql('label')} as k, value_type from metric_catalog where src = 'tijori' and attribute = '{attribute}') l
    on {_key_sql('metrics')} = l.k where symbol is not null and scraped_at is not null),
  {name}_1 as (select symbol, seen, rec_id, case when lv in {_EMPTY} then null when value_type = 'percent' then {_number_sql(_PCT)} else {_number_sql('lv')} end as value from {name}_0),
  {name} as (select symbol, seen, arg_max(value, rec_id) as value from {name}_1 where value is not null group by 1, 2)
"""


def _cagr(n: str, a: str, b: str) -> str:
    return f"case when {n} > 1 and {a} > 0 and {b} > 0 then round((pow({b} / {a}, 1.0 / ({n} - 1)) - 1) * 100, 1) end"


def _months(*attributes: str) -> str:
    return "select symbol, month, " + ", ".join(f"max(value) filter (attribute = '{a}') as {a}" for a in attributes) + f" from series where attribute in {attributes} group by 1, 2"


_ROCE = f"roce as (select symbol, month, (profit_before_tax + interest) / (equity_capital + reserves + borrowings) * 100 as value from ({_months('profit_before_tax', 'interest', 'equity_capital', 'reserves', 'borrowings')}) where equity_capital + reserves + borrowings > 0 and profit_before_tax + interest is not null)"
_NAMES = ("sales", "net_profit", "eps_in_rs", "opm", "operating_profit", "interest", "borrowings", "equity_capital", "cash_from_operating_activity")
_FIN = "fin as (select symbol, " + " or ".join(f"coalesce(lower({c}) like '%{w}%', false)" for c in ("sector", "industry", "nse_industry", "about[1:200]") for w in A.FINANCIAL_WORDS) + " as is_fin from ent)"
_HEALTH = f"""{SERIES}, {ENT}, {_FIN}, {_ROCE}, {_history_sql('receivable_days', 'days')},
  one as (select symbol, {', '.join(f"arg_min(value, month) filter (attribute = '{a}') as {a}_0, arg_max(value, month) filter (attribute = '{a}') as {a}_1, sum(value) filter (attribute = '{a}') as {a}_s, count(value) filter (attribute = '{a}') as {a}_n" for a in _NAMES)} from series group by 1),
  rr as (select symbol, arg_min(value, month) as r0, arg_max(value, month) as r1 from roce group by 1), dd as (select symbol, arg_min(value, seen) as d0, arg_max(value, seen) as d1 from days group by 1),
  h as (select one.*, r0, r1, d0, d1, not coalesce(is_fin, false) as real, {_cagr('sales_n', 'sales_0', 'sales_1')} as sc, {_cagr('net_profit_n', 'net_profit_0', 'net_profit_1')} as pc, {_cagr('eps_in_rs_n', 'eps_in_rs_0', 'eps_in_rs_1')} as ec
    from one left join rr using (symbol) left join dd using (symbol) left join fin using (symbol) where sales_n + net_profit_n > 0),
  g as (select *, case when real and net_profit_s > 0 then round(cash_from_operating_activity_s / net_profit_s, 2) end as ratio, case when real and interest_1 <> 0 then round(operating_profit_1 / interest_1, 1) end as cover from h),
  fl as (select symbol, case when sc < 3 and pc < 0 then 'growth' when pc - sc > 12 and sc < 8 then 'earnings_quality' when sc >= 12 and pc >= 12 then 'growth' end as category,
      case when sc < 3 and pc < 0 then 'concern' when pc - sc > 12 and sc < 8 then 'watch' when sc >= 12 and pc >= 12 then 'strength' end as signal from g
    union all select symbol, 'margins', case when opm_1 - opm_0 <= -4 then 'concern' when opm_1 - opm_0 >= 4 then 'strength' end from g
    union all select symbol, 'cash_conversion', case when ratio < 0.7 then 'concern' when ratio >= 0.9 then 'strength' end from g
    union all select symbol, 'coverage', case when cover < 3 then 'concern' when cover > 8 then 'strength' end from g
    union all select symbol, 'debt', case when borrowings_0 > 0 and borrowings_1 / borrowings_0 > 2 and borrowings_1 - borrowings_0 > 500 then 'watch' when borrowings_1 < borrowings_0 * 0.6 then 'strength' end from g
    union all select symbol, 'dilution', case when equity_capital_0 <> 0 and equity_capital_1 <> 0 and equity_capital_1 / equity_capital_0 > 1.25 and pc - ec > 4 then 'watch' end from g
    union all select symbol, 'returns', case when r1 - r0 <= -5 then 'concern' when r1 >= 18 and r1 - r0 >= 0 then 'strength' end from g
    union all select symbol, 'working_capital', case when real and d1 - d0 > 20 and d1 > 60 then 'watch' end from g)
"""
_LATEST = ", ".join(f"arg_max(value, month) filter (attribute = '{a}') as {a}" for a in ("sales", "net_profit", "operating_profit", "depreciation", "equity_capital", "reserves", "borrowings", "investments"))
_PLEDGE = f"{_history_sql('promoter_pledge', 'pledge')}, e as (select symbol, count(*) as n, arg_min(value, seen) as a, arg_max(value, seen) as b from pledge group by 1)"
_YEARS = "select symbol, month[1:4]::int as year, arg_max(value, month) as value from series where attribute = '{}' group by 1, 2"

SQL = {
    "statement_series": f"with {SERIES} select symbol, statement, attribute, month, round(value, 6) as value from series",
    "series_growth": f"""with {SERIES}, e as (select symbol, attribute, count(*) as n, arg_min(value, month) as a, arg_max(value, month) as b, sum(value) as s from series group by 1, 2)
        select symbol, attribute, n, round(a, 4) as "first", round(b, 4) as "last", round(s, 4) as total, {_cagr('n', 'a', 'b')} as cagr_pct from e""",
    "derived_columns": f"""with {SERIES}, m as ({_months('profit_before_tax', 'interest', 'operating_profit', 'depreciation', 'tax', 'net_profit', 'sales')})
        select symbol, month, round(profit_before_tax + interest, 6) as ebit, round(operating_profit + depreciation, 6) as ebitda, round(profit_before_tax * tax / 100, 6) as tax_amount, round(case when sales <> 0 then net_profit / sales * 100 end, 6) as npm_pct from m""",
    "return_on_capital": f"with {SERIES}, {_ROCE} select symbol, month, round(value, 4) as value from roce",
    "balance_multiples": f"""with {SERIES}, {ENT}, v as (select symbol, {_LATEST} from series group by 1),
        w as (select *, case when equity_capital is not null or reserves is not null then coalesce(equity_capital, 0) + coalesce(reserves, 0) end as worth, coalesce(borrowings, 0) - coalesce(investments, 0) as net_debt, operating_profit + depreciation as ebitda from v
          where coalesce(sales, net_profit, operating_profit, depreciation, equity_capital, reserves, borrowings, investments) is not null),
        m as (select *, market_cap_cr + net_debt as ev from ent join w using (symbol) where market_cap_cr is not null)
        select symbol, round(case when worth <> 0 then market_cap_cr / worth end, 3) as pb, round(case when sales <> 0 then market_cap_cr / sales end, 3) as ps, round(ev, 3) as ev, round(case when ebitda <> 0 then ev / ebitda end, 3) as ev_ebitda,
          round(case when worth <> 0 then borrowings / worth end, 3) as debt_equity, round(net_debt, 3) as net_debt, round(case when worth <> 0 then net_profit / worth end * 100, 3) as roe_pct from m""",
    "cash_ratio": f"""with {SERIES}, s as (select symbol, sum(value) filter (attribute = 'cash_from_operating_activity') as cfo, sum(value) filter (attribute = 'net_profit') as pat from series group by 1)
        select symbol, round(cfo, 4) as cfo, round(pat, 4) as pat, case when pat > 0 then round(cfo / pat, 2) end as ratio from s where cfo is not null and pat is not null""",
    "capital_flags": f"""with {SERIES}, m as (select symbol, month, cash_from_operating_activity + cash_from_investing_activity as fcf, borrowings - coalesce(investments, 0) as debt from ({_months('cash_from_operating_activity', 'cash_from_investing_activity', 'borrowings', 'investments')})),
        f as (select symbol, list(fcf order by month desc) filter (fcf is not null) as f, list(debt order by month desc) filter (debt is not null) as d from m group by 1),
        g as (select symbol, coalesce(f[1:5], []) as f, coalesce(d[1:5], []) as d from f), h as (select *, len(list_filter(f, lambda x: x < 0)) as neg, d[1] as b, d[-1] as a from g)
        select symbol, len(f)::int as n_fcf, neg::int as n_negative, case when len(f) = 0 then null when neg >= 3 then 'concern' when len(list_filter(f, lambda x: x > 0)) = len(f) then 'strength' end as cash_flag,
          round(a, 4) as net_debt_first, round(b, 4) as net_debt_last, case when len(d) >= 2 then case when b > a * 1.5 and b > 0 then 'watch' when b < 0 then 'strength' end end as debt_flag from h where len(f) > 0 or len(d) > 0""",
    "ownership_trend": f"""with {_PLEDGE} select symbol, n, round(a, 4) as "first", round(b, 4) as "last", round(b - a, 4) as change, case when b - a <= -1 then 'falling' when b - a >= -0.5 then 'steady' else 'slightly lower' end as flag from e""",
    "pledge_flag": f"with {_PLEDGE} select symbol, round(b, 4) as pledge_pct, case when b > 5 then 'concern' else 'clean' end as flag from e",
    "health_flags": f"with {_HEALTH} select * from fl where signal is not null",
    "health_flag_counts": f"with {_HEALTH} select category, signal, count(*) as n from fl where signal is not null group by 1, 2",
    "screen_by_year_fundamentals": f"""with {SERIES}, y as (select * from ({_YEARS.format('sales')}) where value <> 0), l as (select *, lag(value) over (partition by symbol order by year) as b from y)
        select symbol, year, round((value / b - 1) * 100, 4) as value from l where year = 2024 and b > 0 and (value / b - 1) * 100 >= 10""",
    "screen_consistency_fundamentals": f"""with {SERIES}, r as (select *, row_number() over (partition by symbol order by year desc) as n from ({_YEARS.format('opm')})),
        g as (select symbol, count(value) as n_years, count(*) filter (value < 5) as n_below, min((value, year)) as w, avg(value) as mean from r where n <= 3 group by 1)
        select symbol, n_years, n_below, round(w[1], 4) as worst, w[2] as worst_year, round(mean, 4) as mean from g where n_years = 3 and n_below <= 1""",
}
