"""Yearly statements of companies: numeric series, trends with direction, cash and debt, derived columns, multiples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakefold.functions.parse import label_key, period_month, read_number, read_percent
from lakefold.operators.screening import newest

#: Words in sector, industry or description that mark a lender, insurer or broker.
FINANCIAL_WORDS = ("bank", "financ", "nbfc", "insurance", "broking", "amc", "asset management", "housing finance", "microfinance")


def chosen_records(records: DataFrame) -> DataFrame:
    """Per symbol and statement the record to read: consolidated before standalone, then the newest, then the larger
    rec_id; records without rows, symbol or statement don't count."""
    usable = records.filter("size(rows) > 0 and symbol is not null and statement is not null")
    rank = F.when(F.col("basis") == "consolidated", 0).otherwise(1)
    return newest(usable, ["symbol", "statement"], rank.asc(), F.col("scraped_at").desc_nulls_last(), F.col("rec_id").desc())


def statement_series(records: DataFrame, catalog: DataFrame) -> DataFrame:
    """symbol, statement, attribute, month (``yyyy-MM``), value: the numeric cells of the chosen records.

    Labels mean what the catalogue (src, statement, attribute, label, value_type) says, whatever their spelling;
    others, TTM and unreadable values are left out. If two cells mean the same the first line counts, then the
    smaller label. Only the choice of records and the last rule shuffle, by symbol and statement first."""
    labels = catalog.filter("src = 'screener'").select("statement", label_key(F.col("label")).alias("_k"), "attribute", "value_type").dropDuplicates(["statement", "_k"])
    lines = chosen_records(records).select("symbol", "statement", F.posexplode("rows").alias("_pos", "_row"))
    lines = lines.withColumn("_k", label_key(F.col("_row")["metric"])).join(labels, ["statement", "_k"])
    cells = lines.select("symbol", "statement", "attribute", "value_type", "_pos", F.explode("_row").alias("_label", "_text")).filter("_label <> 'metric'")
    value = F.when(F.col("value_type") == "number", read_number(F.col("_text"))).when(F.col("value_type") == "percent", read_percent(F.col("_text")))
    cells = cells.select("symbol", "statement", "attribute", period_month(F.col("_label")).alias("month"), value.alias("_v"), F.struct("_pos", "_label").alias("_o"))
    return cells.filter("month is not null and _v is not null").groupBy("symbol", "statement", "attribute", "month").agg(F.min_by("_v", "_o").alias("value"))


def series_ends(series: DataFrame, by: list[str], order: str = "month") -> DataFrame:
    """Per series the number of known values, the first and last of them, their sum and ``cagr_pct`` (compound growth
    per step over the known values, both ends positive, one decimal)."""
    g = series.groupBy(*by).agg(F.count("value").alias("n"), F.min_by("value", order).alias("first"), F.max_by("value", order).alias("last"), F.sum("value").alias("total"))
    ok = (F.col("n") > 1) & (F.col("first") > 0) & (F.col("last") > 0)
    return g.withColumn("cagr_pct", F.when(ok, F.round((F.pow(F.col("last") / F.col("first"), 1.0 / (F.col("n") - 1)) - 1) * 100, 1)))


def by_month(series: DataFrame, attributes: list[str]) -> DataFrame:
    """symbol, month and one column per attribute."""
    return series.filter(F.col("attribute").isin(attributes)).groupBy("symbol", "month").agg(*[F.max(F.when(F.col("attribute") == a, F.col("value"))).alias(a) for a in attributes])


def derived_columns(series: DataFrame) -> DataFrame:
    """symbol, month, ebit (profit before tax and interest), ebitda (operating profit and depreciation, the vendor's
    definition), tax_amount (tax rate of the profit before tax), npm_pct (net profit of sales); one part missing, no value."""
    m = by_month(series, ["profit_before_tax", "interest", "operating_profit", "depreciation", "tax", "net_profit", "sales"])
    return m.select(
        "symbol", "month", (F.col("profit_before_tax") + F.col("interest")).alias("ebit"), (F.col("operating_profit") + F.col("depreciation")).alias("ebitda"),
        (F.col("profit_before_tax") * F.col("tax") / 100).alias("tax_amount"), F.when(F.col("sales") != 0, F.col("net_profit") / F.col("sales") * 100).alias("npm_pct"),
    )


def returns_on_capital(series: DataFrame) -> DataFrame:
    """symbol, month, value: profit before tax and interest, as percent of equity capital, reserves and borrowings."""
    m = by_month(series, ["profit_before_tax", "interest", "equity_capital", "reserves", "borrowings"])
    used = F.col("equity_capital") + F.col("reserves") + F.col("borrowings")
    return m.select("symbol", "month", F.when(used > 0, (F.col("profit_before_tax") + F.col("interest")) / used * 100).alias("value")).filter("value is not null")


def latest_values(series: DataFrame, attributes: list[str]) -> DataFrame:
    """symbol and the last known value per attribute."""
    known = series.filter(F.col("attribute").isin(attributes))
    return known.groupBy("symbol").agg(*[F.max_by(F.when(F.col("attribute") == a, F.col("value")), F.when(F.col("attribute") == a, F.col("month"))).alias(a) for a in attributes])


def balance_multiples(entities: DataFrame, series: DataFrame) -> DataFrame:
    """Per company with a market value (symbol, market_cap_cr): pb, ps, ev, ev_ebitda, debt_equity, net_debt, roe_pct.
    Net debt is borrowings less investments; a denominator that is zero or missing gives null."""
    v = latest_values(series, ["sales", "net_profit", "operating_profit", "depreciation", "equity_capital", "reserves", "borrowings", "investments"])
    worth = F.coalesce("equity_capital", F.lit(0.0)) + F.coalesce("reserves", F.lit(0.0))
    worth = F.when(F.col("equity_capital").isNotNull() | F.col("reserves").isNotNull(), worth)
    v = v.withColumns({"_worth": worth, "net_debt": F.coalesce("borrowings", F.lit(0.0)) - F.coalesce("investments", F.lit(0.0)), "_ebitda": F.col("operating_profit") + F.col("depreciation")})
    m = entities.filter("market_cap_cr is not null").select("symbol", "market_cap_cr").join(v, "symbol")
    m = m.withColumn("ev", F.col("market_cap_cr") + F.col("net_debt"))
    over = lambda a, b: F.when(F.col(b) != 0, F.col(a) / F.col(b))
    return m.select(
        "symbol", over("market_cap_cr", "_worth").alias("pb"), over("market_cap_cr", "sales").alias("ps"), "ev", over("ev", "_ebitda").alias("ev_ebitda"),
        over("borrowings", "_worth").alias("debt_equity"), "net_debt", (over("net_profit", "_worth") * 100).alias("roe_pct"),
    )


def cash_conversion(series: DataFrame) -> DataFrame:
    """symbol, cfo, pat, ratio: operating cash flow against net profit, each summed over its known years; ratio (two
    decimals) where the profit is positive."""
    s = series.groupBy("symbol").agg(*[F.sum(F.when(F.col("attribute") == a, F.col("value"))).alias(n) for a, n in (("cash_from_operating_activity", "cfo"), ("net_profit", "pat"))])
    return s.filter("cfo is not null and pat is not null").withColumn("ratio", F.when(F.col("pat") > 0, F.round(F.col("cfo") / F.col("pat"), 2)))


def capital_allocation(series: DataFrame) -> DataFrame:
    """Per company with cash flows or debt: n_fcf and n_negative (of the last five years' free cash flows, operating
    plus investing), cash_flag, net_debt_first and net_debt_last (of the last five years), debt_flag."""
    m = by_month(series, ["cash_from_operating_activity", "cash_from_investing_activity", "borrowings", "investments"])
    m = m.select("symbol", "month", (F.col("cash_from_operating_activity") + F.col("cash_from_investing_activity")).alias("fcf"), (F.col("borrowings") - F.coalesce("investments", F.lit(0.0))).alias("debt"))

    def last_five(c: str) -> Column:
        known = F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("month", F.col(c).alias("v")))))
        return F.transform(F.slice(known, F.greatest(F.size(known) - 4, F.lit(1)), 5), lambda x: x["v"]).alias(c)

    g = m.groupBy("symbol").agg(last_five("fcf"), last_five("debt")).filter("size(fcf) > 0 or size(debt) > 0")
    negative, first, last = F.size(F.filter("fcf", lambda x: x < 0)), F.get("debt", F.lit(0)), F.element_at("debt", -1)
    first, last = F.when(F.size("debt") > 0, first), F.when(F.size("debt") > 0, F.try_element_at("debt", F.lit(-1)))
    return g.select(
        "symbol", F.size("fcf").alias("n_fcf"), negative.alias("n_negative"),
        F.when(F.size("fcf") == 0, None).when(negative >= 3, "concern").when(F.forall("fcf", lambda x: x > 0), "strength").alias("cash_flag"),
        first.alias("net_debt_first"), last.alias("net_debt_last"),
        F.when(F.size("debt") >= 2, F.when((last > first * 1.5) & (last > 0), "watch").when(last < 0, "strength")).alias("debt_flag"),
    )


def metric_history(rows: DataFrame, catalog: DataFrame, attribute: str) -> DataFrame:
    """symbol, at, value: the readings of one attribute of attribute-value rows (symbol, metrics, val, scraped_at,
    rec_id) over time; of readings at one time the larger rec_id counts."""
    labels = catalog.filter((F.col("src") == "tijori") & (F.col("attribute") == attribute)).select(label_key(F.col("label")).alias("_k"), "value_type").dropDuplicates(["_k"])
    known = rows.filter("symbol is not null and scraped_at is not null").withColumn("_k", label_key(F.col("metrics"))).join(labels, "_k")
    value = F.when(F.col("value_type") == "percent", read_percent(F.col("val"))).otherwise(read_number(F.col("val")))
    known = known.select("symbol", F.col("scraped_at").alias("at"), "rec_id", value.alias("value")).filter("value is not null")
    return known.groupBy("symbol", "at").agg(F.max_by("value", "rec_id").alias("value"))


def change_flags(ends: DataFrame) -> DataFrame:
    """First against last known value: ``change`` and ``flag``: at most -1 falling, at least -0.5 steady, else slightly lower."""
    out = ends.withColumn("change", F.col("last") - F.col("first"))
    return out.withColumn("flag", F.when(F.col("change") <= -1, "falling").when(F.col("change") >= -0.5, "steady").otherwise("slightly lower"))


def trend_flags(series: DataFrame, financial: DataFrame, receivable_days: DataFrame) -> DataFrame:
    """symbol, category, signal: what the statements say about growth, earnings quality, margins, leverage (coverage and
    debt), dilution, returns and working capital.

    ``financial`` (symbol, is_financial) leaves lenders out of the tests on cash conversion, coverage and receivables,
    which mean nothing there; ``receivable_days`` (symbol, at, value). One aggregation per company; a bonus issue is no
    dilution, since earnings per share keep up with profit."""
    names = ["sales", "net_profit", "eps_in_rs", "opm", "operating_profit", "interest", "borrowings", "equity_capital", "cash_from_operating_activity"]
    ends = series_ends(series.filter(F.col("attribute").isin(names)), ["symbol", "attribute"])
    ends = ends.unionByName(series_ends(returns_on_capital(series), ["symbol"]).withColumn("attribute", F.lit("roce")))
    ends = ends.unionByName(series_ends(receivable_days, ["symbol"], "at").withColumn("attribute", F.lit("days")))
    x = F.struct("first", "last", "total", "cagr_pct")
    one = ends.groupBy("symbol").agg(*[F.max(F.when(F.col("attribute") == a, x)).alias(a) for a in [*names, "roce", "days"]])
    one = one.filter("sales is not null or net_profit is not null").join(financial, "symbol", "left").withColumn("_fin", F.coalesce("is_financial", F.lit(False)))
    c, real = F.col, ~F.col("_fin")
    sales, profit, eps = c("sales.cagr_pct"), c("net_profit.cagr_pct"), c("eps_in_rs.cagr_pct")
    margin = c("opm.last") - c("opm.first")
    ratio = F.when(real & (c("net_profit.total") > 0), F.round(c("cash_from_operating_activity.total") / c("net_profit.total"), 2))
    cover = F.when(real & (c("interest.last") != 0), F.round(c("operating_profit.last") / c("interest.last"), 1))
    b0, b1, r0, r1, d0, d1 = c("borrowings.first"), c("borrowings.last"), c("roce.first"), c("roce.last"), c("days.first"), c("days.last")

    def flag(*cases: tuple[Column, str, str]) -> Column:
        """The first case that holds, as category and signal."""
        out = F.lit(None)
        for condition, category, signal in reversed(cases):
            out = F.when(condition, F.struct(F.lit(category).alias("category"), F.lit(signal).alias("signal"))).otherwise(out)
        return out

    flags = F.array_compact(F.array(
        flag(((sales < 3) & (profit < 0), "growth", "concern"), ((profit - sales > 12) & (sales < 8), "earnings_quality", "watch"), ((sales >= 12) & (profit >= 12), "growth", "strength")),
        flag((margin <= -4, "margins", "concern"), (margin >= 4, "margins", "strength")),
        flag((ratio < 0.7, "cash_conversion", "concern"), (ratio >= 0.9, "cash_conversion", "strength")),
        flag((cover < 3, "coverage", "concern"), (cover > 8, "coverage", "strength")),
        flag(((b0 > 0) & (b1 / F.when(b0 != 0, b0) > 2) & (b1 - b0 > 500), "debt", "watch"), (b1 < b0 * 0.6, "debt", "strength")),
        flag(((c("equity_capital.last") / F.when(c("equity_capital.first") != 0, c("equity_capital.first")) > 1.25) & (c("equity_capital.last") != 0) & (profit - eps > 4), "dilution", "watch")),
        flag((r1 - r0 <= -5, "returns", "concern"), ((r1 >= 18) & (r1 - r0 >= 0), "returns", "strength")),
        flag((real & (d1 - d0 > 20) & (d1 > 60), "working_capital", "watch")),
    ))
    return one.select("symbol", F.inline(flags))


def yearly_screen_values(series: DataFrame, attribute: str, growth: bool) -> DataFrame:
    """symbol, year, value of one attribute: the last month of a year, or its growth on the last known earlier year
    (percent; zero counts as unknown, the earlier value must be positive)."""
    y = series.filter(F.col("attribute") == attribute).groupBy("symbol", F.substring("month", 1, 4).cast("int").alias("year")).agg(F.max_by("value", "month").alias("value"))
    if not growth:
        return y
    known = y.filter("value <> 0")
    before = F.lag("value").over(Window.partitionBy("symbol").orderBy("year"))
    return known.withColumn("value", F.when(before > 0, (F.col("value") / before - 1) * 100)).filter("value is not null")


def consistent(values: DataFrame, years: int, least: float, allowed: int = 0) -> DataFrame:
    """Companies whose last ``years`` values (symbol, year, value; all of them must exist) fall below ``least`` at most
    ``allowed`` times: symbol, n_years, n_below, worst, worst_year, mean."""
    r = values.withColumn("_n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("year").desc()))).filter(F.col("_n") <= years)
    g = r.groupBy("symbol").agg(
        F.count("value").alias("n_years"), F.count_if(F.col("value") < least).alias("n_below"), F.min(F.struct("value", "year")).alias("_w"), F.avg("value").alias("mean")
    )
    return g.filter((F.col("n_years") == years) & (F.col("n_below") <= allowed)).select("symbol", "n_years", "n_below", F.col("_w.value").alias("worst"), F.col("_w.year").alias("worst_year"), "mean")
