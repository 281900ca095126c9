"""The query surface: one method per question a user asks of the lake, each a DataFrame.

Unknown arguments raise ValueError; a company without the data asked for gives an empty DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakefold.operators import documents as D
from lakefold.operators import fundamentals as A
from lakefold.operators import portfolio as R
from lakefold.operators import prices as P
from lakefold.operators import reference_data as M
from lakefold.operators import retrieval as V
from lakefold.operators import screening as S
from lakefold.operators import statements as T
from lakefold.operators import valuation as W
from lakefold.operators.wide import wide_companies, wide_statements
from lakefold.plans.documents import THEMES
from lakefold.plans.fundamentals import ITEMS, NOT_ADDITIVE
from lakefold.sources import table
from lakefold.sources.sinks import merge_newest

STATEMENTS = ("profit_loss", "balance_sheet", "cash_flow")
INTERVALS = ("daily", "week", "month")


class Lake:
    """The tables under one root, and the questions they answer."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _t(self, name: str, *columns: str) -> DataFrame:
        return table(self.spark, self.root, name, *columns)

    # base relations ------------------------------------------------------------------------------
    def entities(self) -> DataFrame:
        return S.entity_master(self._t("entities"))

    def daily(self, symbol: str | None = None) -> DataFrame:
        bars = self._t("prices", "px_id", "symbol", "date", "open", "high", "low", "close", "volume")
        return P.daily_bars(bars.filter(F.col("symbol") == symbol) if symbol else bars)

    def filings(self, symbol: str | None = None) -> DataFrame:
        x = self._t("xbrl")
        return A.latest_filings(x.filter(F.col("symbol") == symbol) if symbol else x)

    def _quarters(self, symbol: str | None = None) -> DataFrame:
        return A.pivot_facts(self.filings(symbol), ITEMS)

    def _business(self, symbol: str) -> DataFrame:
        rows = self._t("tijori", "rec_id", "slug", "symbol", "sheet", "metrics", "val", "scraped_at").filter(F.col("symbol") == symbol)
        return wide_companies(rows, self._t("metric_catalog"))

    # companies -----------------------------------------------------------------------------------
    def resolve_company(self, query: str, limit: int = 8) -> DataFrame:
        return S.resolve_company(self.entities(), query, limit)

    def company_overview(self, symbol: str) -> DataFrame:
        """Identity, technical position, peers and how many documents of each kind there are."""
        e = self.entities().filter(F.col("symbol") == symbol).select("symbol", "company_name", "industry", "sector", "market_cap_cr", "pe", "about")
        d = self.daily(symbol)
        tech = P.technicals(d).select("symbol", "close", "from_high_pct", "dma_short", "dma_long", "state", "rsi")
        docs = self._t("documents", "symbol", "doc_type").filter(F.col("symbol") == symbol).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_documents"))
        peers = M.peers(self.entities(), "symbol", "industry", "market_cap_cr", 6).filter(F.col("symbol") == symbol).groupBy("symbol").agg(F.array_join(F.sort_array(F.collect_list("peer")), ",").alias("peers"))
        return e.join(tech, "symbol", "left").join(docs, "symbol", "left").join(peers, "symbol", "left")

    def peers_and_index(self, symbol: str) -> DataFrame:
        e = self.entities()
        weights = M.group_weights(e.filter("nse_industry is not null and market_cap_cr is not null"), "nse_industry", "market_cap_cr").select("symbol", "nse_industry", "weight_pct")
        return M.peers(e, "symbol", "industry", "market_cap_cr", 6).filter(F.col("symbol") == symbol).join(weights.withColumnRenamed("symbol", "peer"), "peer", "left")

    def sector_analysis(self, industry: str, top_n: int = 25) -> tuple[DataFrame, DataFrame]:
        """(aggregate, leaders) of the industries that hold the word."""
        e = self.entities().filter(S.contains_any(["industry", "nse_industry"], [industry.replace("&amp;", "&")]))
        return S.sector_summary(e, "industry"), e.orderBy(F.col("market_cap_cr").desc_nulls_last(), "symbol").limit(top_n)

    # statements and filings ----------------------------------------------------------------------
    def financial_statements(self, symbol: str, statement: str = "profit_loss", basis: str | None = None) -> DataFrame:
        """The statement's typed rows per period: the basis asked for, else consolidated before
        standalone."""
        if statement not in STATEMENTS:
            raise ValueError(f"statement is one of {', '.join(STATEMENTS)}")
        s = self._t("screener", "rec_id", "symbol", "basis", "statement", "rows", "scraped_at").filter((F.col("symbol") == symbol) & (F.col("statement") == statement) & (F.size("rows") > 0))
        if basis:
            s = s.filter(F.col("basis") == basis)
        one = S.newest(s, ["symbol"], F.when(F.col("basis") == "consolidated", 0).otherwise(1).asc(), F.col("scraped_at").desc_nulls_last(), F.col("rec_id").desc())
        return wide_statements(one, self._t("metric_catalog").filter(F.col("statement") == statement)).orderBy("entity")

    def xbrl_quarterly(self, symbol: str, basis: str = "consolidated", quarters: int = 8, segments: bool = False) -> DataFrame:
        """Quarter values, de-cumulated from year-to-date ones, of the newest quarters."""
        f = self.filings(symbol).filter(F.col("consolidated") == F.lit(basis == "consolidated"))
        rows = A.segment_rows(f) if segments else A.decumulate(f, NOT_ADDITIVE)
        return rows.withColumn("_r", F.dense_rank().over(A.Window.partitionBy("symbol").orderBy(F.col("q").desc()))).filter(F.col("_r") <= quarters).drop("_r")

    def series(self, symbol: str | None = None, basis: str | None = None) -> DataFrame:
        """The numeric lines of the yearly statements: of one basis, or consolidated before standalone."""
        s = self._t("screener", "rec_id", "symbol", "basis", "statement", "rows", "scraped_at")
        s = s.filter(F.col("symbol") == symbol) if symbol else s
        return T.statement_series(s.filter(F.col("basis") == basis) if basis else s, self._t("metric_catalog"))

    def _history(self, symbol: str, attribute: str) -> DataFrame:
        rows = self._t("tijori", "symbol", "metrics", "val", "scraped_at", "rec_id").filter(F.col("symbol") == symbol)
        return T.metric_history(rows, self._t("metric_catalog"), attribute)

    def financial_health(self, symbol: str, basis: str | None = None) -> DataFrame:
        """Growth, earnings quality, margins, cash conversion, coverage, debt, dilution, returns and receivables, each
        with its direction; tests that mean nothing for lenders are left out for them."""
        e = self.entities().filter(F.col("symbol") == symbol).withColumn("_about", F.substring("about", 1, 200))
        financial = e.select("symbol", S.contains_any(["sector", "industry", "nse_industry", "_about"], list(T.FINANCIAL_WORDS)).alias("is_financial"))
        return T.trend_flags(self.series(symbol, basis), financial, self._history(symbol, "receivable_days"))

    def capital_allocation(self, symbol: str) -> DataFrame:
        """Free cash flow and net debt of the last five years and what they say."""
        return T.capital_allocation(self.series(symbol))

    def shareholding_trends(self, symbol: str) -> DataFrame:
        """The promoters' pledge, first against last reading: what the lake knows of holdings."""
        return T.change_flags(T.series_ends(self._history(symbol, "promoter_pledge"), ["symbol"], "at").drop("total", "cagr_pct"))

    def forensic_checks(self, symbol: str) -> DataFrame:
        """Vendor flags of the company and whether its pledge is a concern (over five percent)."""
        return self._business(symbol).select("slug", "forensic_flag", "promoter_pledge", (F.col("promoter_pledge") > 5).alias("pledge_concern"), "statutory_auditor", "rating_agency")

    def business_profile(self, symbol: str) -> DataFrame:
        return self._business(symbol)

    def competitive_position(self, symbol: str) -> DataFrame:
        mine = self.entities().filter(F.col("symbol") == symbol).select("industry")
        group = self.entities().join(F.broadcast(mine), "industry", "left_semi")
        rank = F.row_number().over(S.Window.partitionBy("industry").orderBy(F.col("market_cap_cr").desc_nulls_last(), "symbol"))
        return group.withColumn("rank", rank).filter(F.col("symbol") == symbol).select("symbol", "industry", "rank", "market_cap_cr")

    def supply_chain(self, symbol: str) -> DataFrame:
        """Segments of the newest filing, the nearest thing the lake has to lines of supply."""
        return A.segment_rows(self.filings(symbol)).groupBy("segment").agg(F.count(F.lit(1)).alias("n_quarters"), F.max_by("revenue", "q").alias("latest_revenue"))

    # prices and valuation ------------------------------------------------------------------------
    def price_history(self, symbol: str, start: str | None = None, end: str | None = None, interval: str = "month") -> DataFrame:
        if interval not in INTERVALS:
            raise ValueError(f"interval is one of {', '.join(INTERVALS)}")
        d = self.daily(symbol)
        if start:
            d = d.filter(F.col("d") >= F.lit(start).cast("date"))
        if end:
            d = d.filter(F.col("d") <= F.lit(end).cast("date"))
        return d if interval == "daily" else P.resample(d, interval)

    def technicals_momentum(self, symbol: str) -> DataFrame:
        return P.technicals(self.daily(symbol))

    def price_analytics(self, symbol: str) -> DataFrame:
        d = self.daily(symbol)
        rs = P.relative_strength(d, P.market_series(self.daily()), {"rs_3m": 63, "rs_1y": 252})
        return P.stack_columns([P.technicals(d), P.volume_trend(d), rs])

    def valuation_summary(self, symbol: str, terminal: float = 0.05, cost: float = 0.1234, years: int = 10) -> DataFrame:
        """Multiples of price and balance sheet, own PE band, peer PE, implied growth and three scenarios of one company."""
        q = A.prefer_basis(self._quarters(symbol))
        t = q.select("symbol", "q", A.trailing_sum("eps").alias("eps"), A.trailing_sum("revenue").alias("revenue"), A.trailing_sum("profit").alias("profit"))
        t = P.as_of(t, self.daily(symbol).select("symbol", "d", F.col("close").alias("price")), "symbol", "q", "d", ["price"])
        last = S.newest(t.filter("eps is not null and price is not null"), ["symbol"], F.col("q").desc())
        e = self.entities()
        row = W.multiples(last.join(e.select("symbol", "industry", F.col("market_cap_cr").alias("mcap")), "symbol", "left"))
        row = row.join(W.peer_pe(e, "industry"), "industry", "left").join(W.own_pe_band(t, "symbol"), "symbol", "left")
        row = row.join(T.balance_multiples(e.filter(F.col("symbol") == symbol), self.series(symbol)).drop("ps"), "symbol", "left")
        growth = A.cagr(q, "eps").select("symbol", (F.col("cagr_pct") / 100).alias("hist_growth"))
        cases = W.scenarios(last.select("symbol", "price", "eps").join(growth, "symbol", "left"), years, terminal, cost)
        cases = cases.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("scenario", "growth", "value", "upside_pct"))).alias("scenarios"))
        return row.join(cases, "symbol", "left").withColumn("implied_growth", W.implied_growth(F.col("price"), F.col("eps"), years, terminal, cost))

    def macro_data(self, series: str | None = None, last: int = 24) -> DataFrame:
        """Monthly means of an industry's prices, or the list of series."""
        e = self.entities().select("symbol", "industry").filter("industry is not null")
        if series is None:
            return e.select(F.col("industry").alias("series")).distinct().orderBy("series")
        m = self.daily().join(e.filter(F.col("industry") == series), "symbol").groupBy(F.last_day("d").alias("month")).agg(F.avg("close").alias("value"))
        return m.orderBy(F.col("month").desc()).limit(last)

    def index_data(self, industry: str | None = None, interval: str = "month") -> DataFrame:
        """The equally weighted index of all companies or of one industry."""
        d = self.daily()
        if industry:
            d = d.join(self.entities().filter(F.col("industry") == industry).select("symbol"), "symbol", "left_semi")
        i = P.market_series(d).withColumns({"symbol": F.lit(industry or "all"), "open": F.col("close"), "high": F.col("close"), "low": F.col("close"), "volume": F.lit(None).cast("long")})
        return i if interval == "daily" else P.resample(i, interval)

    def portfolio_risk(self, holdings: dict[str, float], risk_free: float = 0.0, least_days: int = 60, years: int | None = None, start: str | None = None, end: str | None = None,
                       benchmark: str | None = None) -> dict[str, DataFrame]:
        """weights, covariance, tail risk, ratios, beta and concentration of a portfolio, over the days from ``start`` to
        ``end`` or the last ``years``; beta is against the symbol ``benchmark`` or the mean of all companies."""
        if not holdings or any(w <= 0 for w in holdings.values()):
            raise ValueError("holdings need positive weights")
        h = R.normalised(self.spark.createDataFrame(sorted(holdings.items()), "symbol string, weight double"))
        d = self.daily()
        if years is not None:
            d = d.filter(F.col("d") >= F.add_months(F.lit(end).cast("date") if end else F.current_date(), -12 * years))
        d = d.filter(F.col("d") >= F.lit(start).cast("date")) if start else d
        d = d.filter(F.col("d") <= F.lit(end).cast("date")) if end else d
        r = R.aligned_returns(d, h)
        s = R.portfolio_series(r)
        enough = s.agg((F.count(F.lit(1)) >= least_days).alias("enough"))
        market = P.market_series(d.filter(F.col("symbol") == benchmark) if benchmark else d)
        return {"weights": h, "covariance": R.covariance(r), "tail_risk": R.tail_risk(s), "ratios": R.ratios(s, risk_free), "beta": R.beta(s, market), "concentration": R.concentration(h), "enough_days": enough}

    # screens -------------------------------------------------------------------------------------
    def screen_stocks(self, text: dict[str, str] | None = None, least: dict[str, float] | None = None, most: dict[str, float] | None = None, flags: dict[str, bool] | None = None,
                      exclude: dict[str, list[str]] | None = None, sort_by: str = "market_cap_cr", ascending: bool = False, limit: int = 25, tolerance_pct: float = 15.0,
                      sector: str | None = None, index: str | None = None) -> dict[str, DataFrame]:
        """matches, funnel, near misses and excluded companies of a screen over entities, balance-sheet multiples and
        technicals. ``sector``: a word of any industry or sector name; ``index``: a word of the group a company
        belongs to (nse_industry)."""
        d = self.daily()
        tech = P.stack_columns([P.offset_returns(d, {"r_3m": 63, "r_1y": 252}), P.technicals(d).withColumnRenamed("state", "dma_state").drop("n_days", "n_returns")])
        u = self.entities().join(tech, "symbol", "left").join(T.balance_multiples(self.entities(), self.series()), "symbol", "left")
        if sector:
            u = u.filter(S.contains_any(["industry", "sector", "nse_industry"], [sector.replace("&amp;", "&")]))
        if index:
            u = u.filter(S.contains_any(["nse_industry"], [index]))
        reason = S.exclusion_reason(exclude or {}, ["industry", "sector", "nse_industry", "company_name", "about"])
        marked = u.withColumn("excluded_for", reason)
        screen = S.Screen(marked.filter("excluded_for is null").drop("excluded_for"), text, least, most, flags)
        return {"matches": screen.top(sort_by, "symbol", limit, ascending), "funnel": screen.funnel(), "near_misses": screen.near_misses("symbol", tolerance_pct), "excluded": marked.filter("excluded_for is not null").groupBy("excluded_for").count()}

    def _yearly(self, metric: str) -> DataFrame:
        """symbol, year, value of ``price_return``, ``roce`` or a line of the statements, or, with ``_growth`` behind it,
        the growth of that line."""
        if metric == "price_return":
            return P.yearly_returns(self.daily()).select("symbol", F.col("calendar_year").alias("year"), F.col("return_pct").alias("value"))
        line, growth = metric.removesuffix("_growth"), metric.endswith("_growth")
        known = [r["attribute"] for r in self._t("metric_catalog").filter("src = 'screener'").select("attribute").distinct().collect()]
        if line != "roce" and line not in known:
            raise ValueError(f"metric is price_return, roce or one of {', '.join(sorted(known))}, each also with _growth")
        series = self.series()
        if line == "roce":
            series = T.returns_on_capital(series).withColumn("attribute", F.lit("roce"))
        return T.yearly_screen_values(series, line, growth)

    def screen_by_year(self, year: int, least: float | None = None, most: float | None = None, limit: int = 25, metric: str = "price_return", sector: str | None = None) -> DataFrame:
        """Companies by a metric of one year; companies without the value don't pass."""
        e = self.entities().select("symbol", "company_name", "industry", "sector")
        h = self._yearly(metric).filter(F.col("year") == year).join(e, "symbol", "left")
        h = h.filter(S.contains_any(["industry", "sector"], [sector])) if sector else h
        bounds = {"least": {"value": least} if least is not None else None, "most": {"value": most} if most is not None else None}
        return S.Screen(h, null_policy="drop", **bounds).top("value", "symbol", limit)

    def screen_consistency(self, least: float, n_years: int = 10, max_violations: int = 0, min_years: int = 5, metric: str = "price_return") -> DataFrame:
        return S.consistency(self._yearly(metric), "symbol", "year", "value", least, n_years, max_violations, min_years)

    # documents -----------------------------------------------------------------------------------
    def search_documents(self, query_vector: list[float], doc_types: list | None = None, max_per_group: int | None = None, top_k: int = 8, group: str = "label",
                         where: dict[str, object] | None = None, since: int | None = None, until: int | None = None, date: str = "date_int", vectors: DataFrame | None = None) -> DataFrame:
        """The nearest texts of ``vectors`` (default the stored embeddings) among those of the kinds, values and dates
        asked for, which are filtered before anything is scored."""
        e = self._t("embeddings") if vectors is None else vectors
        for column, value in (where or {}).items():
            e = e.filter(F.col(column).isin(*value) if isinstance(value, (list, tuple)) else F.col(column) == value)
        e = e.filter(F.col(date) >= since) if since is not None else e
        e = e.filter(F.col(date) <= until) if until is not None else e
        if doc_types:
            e = e.filter(V.where(doc_types, type_column="label"))
        return V.top_k_capped(e, query_vector, "vec_id", group, top_k, max_per_group) if max_per_group else V.top_k(e, query_vector, "vec_id", top_k)

    def topic_timeline(self, words: list[str], symbol: str, n_periods: int = 8, per_period: int = 1) -> DataFrame:
        docs = self._t("documents", "doc_id", "symbol", "text", "date_int").filter(F.col("symbol") == symbol)
        return D.guidance(docs, {"query": [w.lower() for w in words]}, "doc_id", "text", "date_int", per_period, n_periods)

    def management_guidance(self, symbol: str, lookback: int = 6) -> DataFrame:
        docs = self._t("documents", "doc_id", "symbol", "text", "date_int").filter(F.col("symbol") == symbol)
        return D.guidance(docs, THEMES, "doc_id", "text", "date_int", 2, lookback)

    def insider_trading(self, symbol: str) -> DataFrame:
        """Filings that speak of pledges and holdings, newest first."""
        docs = self._t("documents", "doc_id", "symbol", "text", "date_int", "source").filter(F.col("symbol") == symbol)
        return docs.filter(S.contains_any(["text"], ["pledge", "allotted", "holds the folio"])).orderBy(F.col("date_int").desc(), "doc_id")

    def refresh_company_data(self, stored: DataFrame, staged: DataFrame, keys: list[str], time_column: str) -> DataFrame:
        """Stored rows with the staged ones merged in, the newer of each key counting."""
        return merge_newest(stored, staged, keys, time_column)
