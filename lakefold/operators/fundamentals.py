"""Statement and filing operators: long form, revisions, growth, trailing sums, de-cumulation, flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakefold.operators.screening import newest

BY = ["symbol", "consolidated"]


def latest_filings(filings: DataFrame) -> DataFrame:
    """One filing per symbol, basis and quarter end: the newest by filing date, then by id. Feeds give
    the same quarter end at different times of day; the month decides."""
    q = filings.filter("symbol is not null and period_end is not null").withColumn("q", F.last_day(F.col("period_end").cast("date")))
    return newest(q, [*BY, "q"], F.col("filing_date").desc_nulls_last(), F.col("xbrl_id").desc())


def long_facts(filings: DataFrame, column: str = "facts", value: str = "value") -> DataFrame:
    """symbol, consolidated, q, item, value: one row per known fact."""
    return filings.select(*BY, "q", F.explode(column).alias("item", value)).filter(F.col(value).isNotNull())


def fact(name: str, column: str = "facts") -> Column:
    return F.try_element_at(F.col(column), F.lit(name))


def pivot_facts(filings: DataFrame, items: dict[str, str]) -> DataFrame:
    """The wide view: one row per filing, one column per item (name -> column)."""
    return filings.select(*BY, "q", *[fact(k).alias(c) for k, c in items.items()])


def series():
    return Window.partitionBy(*BY).orderBy("q")


def prefer_basis(filings: DataFrame) -> DataFrame:
    """Consolidated rows of a symbol if there are any, else its standalone ones."""
    has = F.max(F.col("consolidated").cast("int")).over(Window.partitionBy("symbol"))
    return filings.withColumn("_c", has).filter(F.col("consolidated").cast("int") == F.col("_c")).drop("_c")


def first_last_known(df: DataFrame, value: str) -> DataFrame:
    """symbol, consolidated, n known values, the first and the last of them in time."""
    known = df.filter(F.col(value).isNotNull())
    return known.groupBy(*BY).agg(F.count(F.lit(1)).alias("n"), F.min_by(value, "q").alias("first"), F.max_by(value, "q").alias("last"))


def cagr(df: DataFrame, value: str, per_year: int = 4) -> DataFrame:
    """Compound growth over the known points (points - 1 steps); both ends must be positive."""
    ends = first_last_known(df, value)
    ok = (F.col("n") > 1) & (F.col("first") > 0) & (F.col("last") > 0)
    return ends.withColumn("cagr_pct", F.when(ok, (F.pow(F.col("last") / F.col("first"), F.lit(float(per_year)) / (F.col("n") - 1)) - 1) * 100))


def trailing_sum(value: str, n: int = 4) -> Column:
    """Sum of the last ``n`` rows, only if all are known."""
    w = series().rowsBetween(-n + 1, 0)
    return F.when(F.count(value).over(w) == n, F.sum(value).over(w))


def growth(value: str, back: int) -> Column:
    """Percent growth on the row ``back`` before, if that is positive."""
    base = F.lag(value, back).over(series())
    return F.when(base > 0, (F.col(value) / base - 1) * 100)


def average_of_last(df: DataFrame, value: str, n: int, least: int) -> DataFrame:
    """Mean and sum of the last ``n`` known values; null with fewer than ``least``."""
    known = df.filter(F.col(value).isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy(*BY).orderBy(F.col("q").desc())))
    out = known.filter(F.col("_n") <= n).groupBy(*BY).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.sum(value).alias("total"))
    return out.withColumn("mean", F.when(F.col("n") >= least, F.col("mean")))


def offsets(df: DataFrame, value: str, back: dict[str, int]) -> DataFrame:
    """The value at given places counted from the newest row (1 is the newest)."""
    r = df.withColumn("_n", F.row_number().over(Window.partitionBy(*BY).orderBy(F.col("q").desc())))
    return r.filter(F.col("_n") <= max(back.values())).groupBy(*BY).agg(*[F.max(F.when(F.col("_n") == n, F.col(value))).alias(k) for k, n in back.items()])


def decumulate(filings: DataFrame, not_additive: list[str]) -> DataFrame:
    """Quarter values out of year-to-date values: symbol, consolidated, q, item, ytd, value, how.

    In a fiscal year (April to March) the first quarter is its year-to-date value; later ones subtract the
    year-to-date value of the quarter right before, or else the sum of the true values of all quarters
    before, or stay unresolved. Items that don't add up over time are carried as they are. The prior
    quarter is looked up by window over the calendar, not by joining the table to itself.
    """
    ytd = long_facts(filings, "ytd", "ytd").filter("ytd is not null")
    true = long_facts(filings, "facts", "fact")
    rows = ytd.join(true, [*BY, "q", "item"], "full").withColumns({
        "fy": F.year(F.add_months("q", 9)), "no": (F.month("q") / 3 + 2).cast("int") % 4 + 1,
    })
    w = Window.partitionBy(*BY, "item", "fy").orderBy("no")
    before = w.rangeBetween(-1, -1)
    up_to = w.rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "_prior": F.max("ytd").over(before), "_sum": F.sum("fact").over(up_to), "_known": F.count("fact").over(up_to),
    }).filter("ytd is not null")
    additive = ~F.col("item").isin(*not_additive)
    how = (
        F.when(~additive, "carried").when(F.col("no") == 1, "first").when(F.col("_prior").isNotNull(), "prior_ytd")
        .when(F.col("_known") == F.col("no") - 1, "prior_quarters").otherwise("unresolved")
    )
    value = (
        F.when(how.isin("carried", "first"), F.col("ytd")).when(how == "prior_ytd", F.col("ytd") - F.col("_prior"))
        .when(how == "prior_quarters", F.col("ytd") - F.col("_sum"))
    )
    return rows.select(*BY, "q", "item", "ytd", value.alias("value"), how.alias("how"))


def segment_rows(filings: DataFrame) -> DataFrame:
    """One row per segment of a filing with its margin."""
    s = filings.select(*BY, "q", F.explode("segments").alias("segment", "v"))
    return s.select(*BY, "q", "segment", "v.revenue", "v.result", F.when(F.col("v.revenue") > 0, F.col("v.result") / F.col("v.revenue") * 100).alias("margin_pct"))


def pick_label(lines: DataFrame, keys: list[str], label: str, order: str, options: list[str]) -> DataFrame:
    """Per key the line whose label holds the first of ``options`` that any label holds; of several such
    lines the first."""
    low = F.lower(label)
    rank = F.lit(None).cast("int")
    for i, option in reversed(list(enumerate(options))):
        rank = F.when(low.contains(option.lower()), i).otherwise(rank)
    hits = lines.withColumn("_r", rank).filter("_r is not null")
    return newest(hits, keys, F.col("_r").asc(), F.col(order).asc()).drop("_r")
