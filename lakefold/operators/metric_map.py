"""The flat metric map: hundreds of derived figures from a short table of rules, by one aggregation.

A rule is (name, shape, column, n): the value n periods back, growth against n periods back, compound
growth over n periods, mean or sum of the last n known values, or a ratio of two newest values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Figures every offset, growth and average family is made for.
FLOWS = ("sales", "operating_profit", "net_profit", "eps_in_rs", "interest", "depreciation", "other_income", "profit_before_tax")
STOCKS = ("equity_capital", "reserves", "borrowings", "fixed_assets", "investments", "total_assets", "cwip", "other_liabilities")
CASH = ("cash_from_operating_activity", "cash_from_investing_activity", "cash_from_financing_activity", "net_cash_flow")
RATIOS = (
    ("npm", "net_profit", "sales", 100.0), ("interest_cover", "operating_profit", "interest", 1.0), ("debt_to_equity", "borrowings", "_equity", 1.0),
    ("roa", "net_profit", "total_assets", 100.0), ("roe", "net_profit", "_equity", 100.0), ("asset_turnover", "sales", "total_assets", 1.0),
    ("leverage", "total_assets", "_equity", 1.0), ("cash_conversion", "cash_from_operating_activity", "net_profit", 1.0),
)


def rules() -> list[tuple[str, str, str, int]]:
    """(name, shape, column, n) of the whole map."""
    out: list[tuple[str, str, str, int]] = []
    for c in (*FLOWS, *STOCKS, *CASH):
        out += [(c, "offset", c, 0), (f"{c}_preceding_year", "offset", c, 1), (f"{c}_2_years_back", "offset", c, 2), (f"{c}_3_years_back", "offset", c, 3)]
    for c in (*FLOWS, *STOCKS):
        out += [(f"{c}_growth", "growth", c, 1), (f"{c}_growth_3_years", "cagr", c, 3), (f"{c}_growth_5_years", "cagr", c, 5), (f"average_{c}_3_years", "mean", c, 3), (f"average_{c}_5_years", "mean", c, 5)]
    for c in CASH:
        out += [(f"{c}_3_years", "sum", c, 3), (f"{c}_5_years", "sum", c, 5)]
    return out


def _at(column: str, n: int) -> Column:
    return F.max(F.when(F.col("_n") == n, F.col(column)))


def flat_metrics(wide: DataFrame, key: str, period: str) -> DataFrame:
    """One row per key with all figures of ``rules`` and ``RATIOS``; what a figure needs and lacks makes it
    null, a growth needs a positive base. The periods are ranked once; everything else is conditional
    aggregation over that rank."""
    have = set(wide.columns)
    ranked = wide.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.col(period).desc())) - 1)
    aggs: list[Column] = []
    for name, shape, c, n in rules():
        if c not in have:
            continue
        now, then = _at(c, 0), _at(c, n)
        recent = F.when(F.col("_n") < n, F.col(c))
        value = {
            "offset": lambda: then,
            "growth": lambda: F.when(then > 0, (now / then - 1) * 100),
            "cagr": lambda: F.when((then > 0) & (now > 0), (F.pow(now / then, 1.0 / n) - 1) * 100),
            "mean": lambda: F.when(F.count(recent) == n, F.avg(recent)),
            "sum": lambda: F.when(F.count(recent) == n, F.sum(recent)),
        }[shape]()
        aggs.append(value.alias(name))
    equity = _at("equity_capital", 0) + F.coalesce(_at("reserves", 0), F.lit(0.0)) if {"equity_capital", "reserves"} <= have else F.lit(None).cast("double")
    for name, top, bottom, scale in RATIOS:
        if top in have and (bottom == "_equity" or bottom in have):
            den = equity if bottom == "_equity" else _at(bottom, 0)
            aggs.append(F.when(den > 0, _at(top, 0) / den * scale).alias(name))
    return ranked.groupBy(key).agg(*aggs)
