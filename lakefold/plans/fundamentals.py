"""Filing and statement queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakefold.operators import fundamentals as A
from lakefold.operators.screening import growth_on_last_known
from lakefold.plans.prices import rounded
from lakefold.sources import table

ITEMS = {"RevenueFromOperations": "revenue", "ProfitLossForPeriod": "profit", "BasicEPS": "eps", "FinanceCosts": "interest", "ProfitBeforeTax": "pbt", "PaidUpCapital": "capital"}
NOT_ADDITIVE = ["PaidUpCapital", "BasicEPS"]
FIL = """
  f0 as (select *, last_day(period_end::date) as q from xbrl where symbol is not null and period_end is not null),
  f1 as (select *, row_number() over (partition by symbol, consolidated, q order by filing_date desc nulls last, xbrl_id desc) as n_ from f0),
  fil as (select * exclude (n_) from f1 where n_ = 1)
"""
WIDE = f"{FIL}, wide as (select symbol, consolidated, q, " + ", ".join(f"facts['{k}'] as {c}" for k, c in ITEMS.items()) + " from fil)"
_W = "(partition by symbol, consolidated order by q)"


def _filings(spark: SparkSession, root: str) -> DataFrame:
    return A.latest_filings(table(spark, root, "xbrl"))


def _wide(spark: SparkSession, root: str) -> DataFrame:
    return A.pivot_facts(_filings(spark, root), ITEMS)


def revision_dedupe(spark, root):
    return _filings(spark, root).select("symbol", "consolidated", "q", "xbrl_id")


def statement_unpivot(spark, root):
    return A.long_facts(_filings(spark, root))


def statement_pivot(spark, root):
    return _wide(spark, root)


def xbrl_quarterly(spark, root):
    """The last eight quarters per company, consolidated if there is such a basis."""
    w = A.prefer_basis(_wide(spark, root))
    r = w.withColumn("back", F.row_number().over(A.Window.partitionBy(*A.BY).orderBy(F.col("q").desc()))).filter("back <= 8")
    return r.select("symbol", "q", "back", "revenue", "profit", "eps")


def latest_reported_period(spark, root):
    return _filings(spark, root).groupBy("symbol").agg(F.max("q").alias("latest"))


def metric_offsets(spark, root):
    return A.offsets(_wide(spark, root), "revenue", {"latest": 1, "previous": 2, "year_ago": 5})


def ttm(spark, root):
    return rounded(_wide(spark, root).select(*A.BY, "q", A.trailing_sum("revenue").alias("revenue_ttm"), A.trailing_sum("eps").alias("eps_ttm")), 4)


def growth_yoy_qoq(spark, root):
    return rounded(_wide(spark, root).select(*A.BY, "q", A.growth("revenue", 4).alias("yoy_pct"), A.growth("revenue", 1).alias("qoq_pct")), 4)


def yearly_growth_skip_null(spark, root):
    w = A.prefer_basis(_wide(spark, root))
    return rounded(w.select("symbol", "q", growth_on_last_known(w, "symbol", "q", "revenue").alias("growth_pct")), 4)


def nyear_avg(spark, root):
    return rounded(A.average_of_last(_wide(spark, root), "profit", 8, 4), 6)


def cagr(spark, root):
    return rounded(A.cagr(_wide(spark, root), "revenue"), 4)


def decumulate_ytd(spark, root):
    return rounded(A.decumulate(_filings(spark, root), NOT_ADDITIVE), 4)


def decumulate_counts(spark, root):
    return A.decumulate(_filings(spark, root), NOT_ADDITIVE).groupBy("how").agg(F.count(F.lit(1)).alias("n"))


def xbrl_segments(spark, root):
    return rounded(A.segment_rows(_filings(spark, root)), 4)


def label_lookup(spark, root):
    """Per statement record the first line whose label holds 'net profit', else 'profit', else 'cash'."""
    s = table(spark, root, "screener", "rec_id", "rows").select("rec_id", F.posexplode("rows").alias("pos", "row"))
    lines = s.select("rec_id", "pos", F.col("row")["metric"].alias("label"))
    return A.pick_label(lines, ["rec_id"], "label", "pos", ["net profit", "profit", "cash"]).select("rec_id", "pos", "label")


def statement_basis(spark, root):
    """Per company and statement the record to read: consolidated before standalone, newest first, only
    records with rows."""
    s = table(spark, root, "screener", "rec_id", "symbol", "basis", "statement", "rows", "scraped_at").filter("size(rows) > 0 and symbol is not null")
    rank = F.when(F.col("basis") == "consolidated", 0).otherwise(1)
    return A.newest(s, ["symbol", "statement"], rank.asc(), F.col("scraped_at").desc_nulls_last(), F.col("rec_id").desc()).select("symbol", "statement", "basis", "rec_id")


def statement_cells(spark, root):
    """Statement matrices as rows: record, line, period label, text."""
    s = table(spark, root, "screener", "rec_id", "rows").select("rec_id", F.posexplode("rows").alias("pos", "row"))
    return s.select("rec_id", "pos", F.col("row")["metric"].alias("label"), F.explode("row").alias("period", "value")).filter("period <> 'metric'")


QUERIES = {f.__name__: f for f in (
    revision_dedupe, statement_unpivot, statement_pivot, xbrl_quarterly, latest_reported_period, metric_offsets, ttm, growth_yoy_qoq, yearly_growth_skip_null, nyear_avg, cagr,
    decumulate_ytd, decumulate_counts, xbrl_segments, label_lookup, statement_basis, statement_cells,
)}

_PREFERRED = "pw as (select * from (select *, max(consolidated::int) over (partition by symbol) as c_ from wide) where consolidated::int = c_)"
_DECUM = f"""{FIL},
  ya as (select symbol, consolidated, q, unnest(map_entries(ytd)) as e from fil), ta as (select symbol, consolidated, q, unnest(map_entries(facts)) as e from fil),
  y as (select symbol, consolidated, q, e.key as item, e.value as ytd from ya where e.value is not null), t as (select symbol, consolidated, q, e.key as item, e.value as fact from ta where e.value is not null),
  j as (select *, year(q + interval 9 month) as fy, ((month(q) // 3 + 2) % 4) + 1 as no from y full join t using (symbol, consolidated, q, item)),
  k as (select *, max(ytd) over (partition by symbol, consolidated, item, fy order by no range between 1 preceding and 1 preceding) as prior,
    sum(fact) over (partition by symbol, consolidated, item, fy order by no range between unbounded preceding and 1 preceding) as s,
    count(fact) over (partition by symbol, consolidated, item, fy order by no range between unbounded preceding and 1 preceding) as known from j),
  h as (select *, case when item in ('PaidUpCapital', 'BasicEPS') then 'carried' when no = 1 then 'first' when prior is not null then 'prior_ytd' when known = no - 1 then 'prior_quarters' else 'unresolved' end as how from k where ytd is not null)
"""
_ENDS = "count({0}) as n, arg_min({0}, q) filter ({0} is not null) as \"first\", arg_max({0}, q) filter ({0} is not null) as \"last\""

SQL = {
    "revision_dedupe": f"with {FIL} select symbol, consolidated, q, xbrl_id from fil",
    "statement_unpivot": f"with {FIL}, x as (select symbol, consolidated, q, unnest(map_entries(facts)) as e from fil) select symbol, consolidated, q, e.key as item, e.value as value from x where e.value is not null",
    "statement_pivot": f"with {WIDE} select * from wide",
    "xbrl_quarterly": f"with {WIDE}, {_PREFERRED}, r as (select *, row_number() over (partition by symbol, consolidated order by q desc)::int as back from pw) select symbol, q, back, revenue, profit, eps from r where back <= 8",
    "latest_reported_period": f"with {FIL} select symbol, max(q) as latest from fil group by 1",
    "metric_offsets": f"""with {WIDE}, r as (select *, row_number() over (partition by symbol, consolidated order by q desc) as n from wide)
        select symbol, consolidated, max(revenue) filter (n = 1) as latest, max(revenue) filter (n = 2) as previous, max(revenue) filter (n = 5) as year_ago from r where n <= 5 group by 1, 2""",
    "ttm": f"""with {WIDE} select symbol, consolidated, q, round(case when count(revenue) over w = 4 then sum(revenue) over w end, 4) as revenue_ttm, round(case when count(eps) over w = 4 then sum(eps) over w end, 4) as eps_ttm
        from wide window w as (partition by symbol, consolidated order by q rows 3 preceding)""",
    "growth_yoy_qoq": f"""with {WIDE}, l as (select *, lag(revenue, 4) over {_W} as a, lag(revenue, 1) over {_W} as b from wide)
        select symbol, consolidated, q, round(case when a > 0 then (revenue / a - 1) * 100 end, 4) as yoy_pct, round(case when b > 0 then (revenue / b - 1) * 100 end, 4) as qoq_pct from l""",
    "yearly_growth_skip_null": f"""with {WIDE}, {_PREFERRED}, l as (select *, nullif(revenue, 0) as v, last_value(nullif(revenue, 0) ignore nulls) over (partition by symbol order by q rows between unbounded preceding and 1 preceding) as b from pw)
        select symbol, q, round(case when v is not null and b > 0 then (v / b - 1) * 100 end, 4) as growth_pct from l""",
    "nyear_avg": f"""with {WIDE}, r as (select *, row_number() over (partition by symbol, consolidated order by q desc) as i from wide where profit is not null)
        select symbol, consolidated, count(*) as n, round(case when count(*) >= 4 then avg(profit) end, 6) as mean, round(sum(profit), 6) as total from r where i <= 8 group by 1, 2""",
    "cagr": f"""with {WIDE}, e as (select symbol, consolidated, {_ENDS.format('revenue')} from wide group by 1, 2 having count(revenue) > 0)
        select symbol, consolidated, n, round("first", 4) as "first", round("last", 4) as "last", round(case when n > 1 and "first" > 0 and "last" > 0 then (pow("last" / "first", 4.0 / (n - 1)) - 1) * 100 end, 4) as cagr_pct from e""",
    "decumulate_ytd": f"""with {_DECUM} select symbol, consolidated, q, item, round(ytd, 4) as ytd, round(case when how in ('carried', 'first') then ytd when how = 'prior_ytd' then ytd - prior when how = 'prior_quarters' then ytd - s end, 4) as value, how from h""",
    "decumulate_counts": f"with {_DECUM} select how, count(*) as n from h group by 1",
    "xbrl_segments": f"""with {FIL}, x as (select symbol, consolidated, q, unnest(map_entries(segments)) as e from fil) select symbol, consolidated, q, e.key as segment, round(e.value.revenue, 4) as revenue, round(e.value.result, 4) as result,
        round(case when e.value.revenue > 0 then e.value.result / e.value.revenue * 100 end, 4) as margin_pct from x""",
    "label_lookup": """with l as (select rec_id, unnest(range(len(rows)))::int as pos, unnest(rows)['metric'] as label from screener),
        r as (select *, case when lower(label) like '%net profit%' then 0 when lower(label) like '%profit%' then 1 when lower(label) like '%cash%' then 2 end as r from l),
        n as (select *, row_number() over (partition by rec_id order by r, pos) as n from r where r is not null) select rec_id, pos, label from n where n = 1""",
    "statement_basis": """with n as (select *, row_number() over (partition by symbol, statement order by case when basis = 'consolidated' then 0 else 1 end, scraped_at desc nulls last, rec_id desc) as n
        from screener where len(rows) > 0 and symbol is not null) select symbol, statement, basis, rec_id from n where n = 1""",
    "statement_cells": """with l as (select rec_id, unnest(range(len(rows)))::int as pos, unnest(rows) as r from screener), e as (select rec_id, pos, r['metric'] as label, unnest(map_entries(r)) as e from l)
        select rec_id, pos, label, e.key as period, e.value as value from e where e.key <> 'metric'""",
}
