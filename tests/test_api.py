"""Every question of the query surface answers on the smallest tables."""

import os

import pytest

from lakefold.api import Lake

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables here")


@pytest.fixture(scope="module")
def lake(spark):
    return Lake(spark, ROOT)


@pytest.fixture(scope="module")
def symbol(lake):
    return lake.filings().join(lake.daily().select("symbol").distinct(), "symbol").groupBy("symbol").count().orderBy("count", ascending=False).first()["symbol"]


def test_company_questions(lake, symbol):
    assert lake.resolve_company(symbol).first()["symbol"] == symbol
    for question in ("company_overview", "peers_and_index", "financial_statements", "xbrl_quarterly", "financial_health", "capital_allocation", "shareholding_trends", "forensic_checks", "business_profile",
                     "competitive_position", "supply_chain", "technicals_momentum", "price_analytics", "valuation_summary", "management_guidance", "insider_trading"):
        df = getattr(lake, question)(symbol)
        assert df.columns and df.collect() is not None
        assert getattr(lake, question)("no such symbol").count() == 0
    assert lake.price_history(symbol).count() > 0 and lake.price_history(symbol, "2100-01-01").count() == 0
    assert lake.topic_timeline(["margin"], symbol).columns == ["theme", "date_int", "doc_id", "statement"]


def test_universe_questions(lake):
    out = lake.screen_stocks(text={"industry": "a"}, least={"market_cap_cr": 200.0}, most={"pe": 60.0}, exclude={"metals": ["metal"]})
    assert out["funnel"].count() == 4 and out["matches"].columns and out["near_misses"].count() >= 0 and out["excluded"].count() >= 0
    assert lake.screen_by_year(2024, least=0.0).count() >= 0 and lake.screen_consistency(-90.0, min_years=1).count() > 0
    assert lake.screen_by_year(2024, metric="sales_growth").columns and lake.screen_by_year(2024, metric="opm", sector="a").count() >= 0
    assert lake.screen_consistency(-1e9, 3, 0, 1, metric="net_profit").count() > 0 and lake.screen_consistency(-1e9, 3, 0, 1, metric="roce").count() >= 0
    assert lake.screen_stocks(most={"debt_equity": 2.0}, sector="a", index="a")["funnel"].count() == 2
    agg, leaders = lake.sector_analysis("a", 5)
    assert agg.count() > 0 and leaders.count() <= 5
    series = lake.macro_data().first()["series"]
    assert lake.macro_data(series).count() <= 24 and lake.index_data().count() > 0
    assert lake.search_documents([1.0] * 64, top_k=3).count() == 3 and lake.search_documents([1.0] * 64, max_per_group=1, top_k=3).count() <= 3


def test_portfolio_and_errors(lake):
    names = [r["symbol"] for r in lake.daily().groupBy("symbol").count().orderBy("count", ascending=False).limit(2).collect()]
    risk = lake.portfolio_risk({n: 1.0 for n in names})
    assert risk["concentration"].first()["hhi"] == pytest.approx(0.5) and risk["covariance"].count() == 3
    short = lake.portfolio_risk({n: 1.0 for n in names}, start="2024-01-01", benchmark=names[0])
    assert short["beta"].columns and short["enough_days"].count() == 1
    assert lake.search_documents([1.0] * 64, top_k=3, where={"label": [1, 2]}).columns
    for bad in (lambda: lake.screen_by_year(2024, metric="nothing"), lambda: lake.portfolio_risk({}), lambda: lake.financial_statements("x", "nothing"), lambda: lake.price_history("x", interval="hour"), lambda: lake.screen_stocks(least={"nothing": 1.0})):
        with pytest.raises(ValueError):
            bad()
