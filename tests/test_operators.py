"""Golden values, edge rows and properties of the core operators."""

import datetime as dt
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakefold.functions.parse import label_key, period_month, read_date, read_flag, read_number, read_percent
from lakefold.functions.times import micros
from lakefold.operators import fundamentals, portfolio, prices, reference_data, retrieval, screening, text, valuation, wide
from lakefold.sources import markup, sinks

CLOSES = [10, 11, 10.5, 12, 11.5, 12.5, 13, 12, 12.5, 14, 13.5, 15, 14.5, 16, 15, 15.5, 17, 16.5, 18, 17.5, 19]


def one(df):
    return df.collect()[0]


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.fixture(scope="module")
def series(spark):
    start = dt.date(2024, 1, 1)
    return spark.createDataFrame([("A", start + dt.timedelta(i), float(c)) for i, c in enumerate(CLOSES)], "symbol string, d date, close double")


def test_price_goldens(series):
    last = one(series.withColumn("v", prices.sma("close", 5)).orderBy(F.col("d").desc()))
    assert last["v"] == pytest.approx(17.6)
    assert series.withColumn("v", prices.sma("close", 5)).filter("v is null").count() == 4
    m = one(prices.macd_last(series))
    assert (m["macd"], m["macd_signal"]) == (pytest.approx(1.047303, abs=1e-6), pytest.approx(0.735863, abs=1e-6))
    assert one(prices.rsi_live(series))["rsi"] == pytest.approx(80.573632, abs=1e-6)
    assert one(prices.rsi_batch(series))["rsi"] == pytest.approx(74.772227, abs=1e-6)
    d = one(prices.drawdowns(series))
    assert (d["max_drawdown_pct"], d["drawdown_pct"]) == (pytest.approx(-7.692308, abs=1e-6), 0)
    assert one(prices.volatility(series, least=5))["annual_vol_pct"] == pytest.approx(114.002706, abs=1e-6)
    assert one(prices.volatility(series))["annual_vol_pct"] is None


def test_tail_risk_golden(series):
    r = series.withColumn("r", prices.pct_change("close")).filter("r is not null").select("d", "r")
    row = one(portfolio.tail_risk(r, (0.95,)))
    assert (row["var"], row["cvar"]) == (pytest.approx(-0.06322115, abs=1e-7), pytest.approx(-0.07692308, abs=1e-7))


def test_daily_bars_drop_halts_redeliveries_and_keep_last(spark):
    t = lambda h: dt.datetime(2024, 1, 2, h)
    rows = [(1, "A", t(9), 1.0, 2.0, 0.5, 1.5, 10), (1, "A", t(9), 1.0, 2.0, 0.5, 1.5, 10), (2, "A", t(15), 1.5, 3.0, 1.0, 2.5, 5), (3, "A", t(16), None, None, None, None, 1), (4, None, t(9), 1.0, 1.0, 1.0, 1.0, 1)]
    bars = spark.createDataFrame(rows, "px_id long, symbol string, date timestamp_ntz, open double, high double, low double, close double, volume long")
    got = one(prices.daily_bars(bars))
    assert (got["open"], got["high"], got["low"], got["close"], got["volume"]) == (1.0, 3.0, 0.5, 2.5, 15)
    assert prices.daily_bars(bars.limit(0)).count() == 0


def test_as_of_takes_the_last_at_or_before(spark):
    left = spark.createDataFrame([(1, "A", 5), (2, "A", 1), (3, "B", 9), (4, None, 5)], "id int, s string, t int")
    right = spark.createDataFrame([("A", 2, 20.0), ("A", 5, 50.0), ("A", 6, 60.0)], "s string, t int, v double")
    got = {r["id"]: r["v"] for r in prices.as_of(left, right, "s", "t", "t", ["v"]).collect()}
    assert got == {1: 50.0, 2: None, 3: None, 4: None}


def test_resample_labels(series):
    weeks = {r["period_end"] for r in prices.resample(series.withColumns({"open": F.col("close"), "high": F.col("close"), "low": F.col("close"), "volume": F.lit(1)}).filter("d <= '2024-01-10'"), "week").collect()}
    assert weeks == {dt.date(2024, 1, 7), dt.date(2024, 1, 14)}


def test_valuation_goldens(spark):
    got = [value(spark, valuation.two_stage_value(F.lit(1.0), F.lit(g), F.lit(10), 0.05, 0.1234)) for g in (0.058, 0.108, 0.158, 0.246)]
    assert got == [pytest.approx(x, abs=1e-4) for x in (15.1497, 21.7370, 31.2352, 58.7719)]
    for price, growth in ((30.0, 0.1524), (57.4, 0.2427)):
        assert value(spark, valuation.implied_growth(F.lit(price), F.lit(1.0), 10, 0.05, 0.1234)) == pytest.approx(growth, abs=1e-4)
    assert value(spark, valuation.implied_growth(F.lit(-1.0), F.lit(1.0), 10, 0.05, 0.1234)) is None
    assert value(spark, valuation.two_stage_value(F.lit(1.0), F.lit(0.1), F.lit(10), 0.2, 0.1)) is None


@settings(max_examples=20, deadline=None)
@given(price=st.floats(12, 80))
def test_value_at_the_implied_growth_is_the_price(spark, price):
    g = value(spark, valuation.implied_growth(F.lit(price), F.lit(1.0), 10, 0.05, 0.1234))
    assert value(spark, valuation.two_stage_value(F.lit(1.0), F.lit(g), F.lit(10), 0.05, 0.1234)) == pytest.approx(price, rel=1e-6)


@pytest.fixture(scope="module")
def universe(spark):
    rows = [("A", "Auto", 100.0, 10.0), ("B", "auto parts", 90.0, None), ("C", None, 500.0, 5.0), ("D", "Auto", None, 50.0), ("E", "AUTO", 40480.0, 30.0)]
    return spark.createDataFrame(rows, "symbol string, industry string, market_cap_cr double, pe double")


def test_screen_nulls_pass_or_drop(universe):
    spec = {"text": {"industry": "auto"}, "least": {"market_cap_cr": 95.0}, "most": {"pe": 40.0}}
    assert {r["symbol"] for r in screening.Screen(universe, **spec).matches().collect()} == {"A", "E"}
    assert [r["remaining"] for r in screening.Screen(universe, **spec).funnel().orderBy("step").collect()] == [5, 4, 3, 2]
    miss = screening.Screen(universe, **spec).near_misses("symbol", 10.0).collect()
    assert [(r["symbol"], r["failed"]) for r in miss] == [("B", "market_cap_cr")]
    assert screening.Screen(universe, least={"market_cap_cr": 0.0}, null_policy="drop").matches().count() == 4
    with pytest.raises(ValueError):
        screening.Screen(universe, least={"nothing": 1.0})


def test_zero_threshold_margin_uses_one(universe):
    miss = one(screening.Screen(universe.filter("symbol = 'A'").withColumn("pe", F.lit(-0.1)), least={"pe": 0.0}).near_misses("symbol", 15.0))
    assert miss["margin_pct"] == pytest.approx(10.0)


@settings(max_examples=10, deadline=None)
@given(low=st.floats(0, 600), high=st.floats(0, 60))
def test_funnel_is_monotone_and_ends_at_the_matches(universe, low, high):
    s = screening.Screen(universe, text={"industry": "auto"}, least={"market_cap_cr": low}, most={"pe": high})
    counts = [r["remaining"] for r in s.funnel().orderBy("step").collect()]
    assert counts == sorted(counts, reverse=True) and counts[-1] == s.matches().count()
    near = {r["symbol"] for r in s.near_misses("symbol").collect()}
    assert not near & {r["symbol"] for r in s.matches().collect()}


def test_resolution_order(spark):
    rows = [("TEXT", "Text Mills Limited", 58.4), ("X1", "Big Textiles", 40480.0), ("X2", "Other Textiles", None), ("X3", None, 1.0)]
    e = spark.createDataFrame(rows, "symbol string, company_name string, market_cap_cr double")
    assert [r["symbol"] for r in screening.resolve_company(e, "text").collect()] == ["TEXT", "X1", "X2"]
    assert [r["symbol"] for r in screening.resolve_company(e, "limited mills").collect()] == ["TEXT"]
    assert screening.resolve_company(e, "zzz").count() == 0


def test_consistency_and_exclusion(spark, universe):
    h = spark.createDataFrame([("A", y, v) for y, v in zip(range(2018, 2024), (1.0, -2.0, 3.0, -2.0, None, 5.0))], "symbol string, y int, v double")
    row = one(screening.consistency(h, "symbol", "y", "v", 0.0, max_violations=2))
    assert (row["years"], row["violations"], row["worst"], row["worst_year"], row["latest"]) == (5, 2, -2.0, 2019, 5.0)
    got = universe.select("symbol", screening.exclusion_reason({"cars": ["auto"], "rest": ["parts"]}, ["industry"]).alias("r")).collect()
    assert {r["symbol"]: r["r"] for r in got} == {"A": "cars", "B": "cars", "C": None, "D": "cars", "E": "cars"}


def test_growth_skips_gaps(spark):
    df = spark.createDataFrame([("A", i, v) for i, v in enumerate([10.0, None, 0.0, 20.0, -5.0, 10.0])], "s string, i int, v double")
    got = [r["g"] for r in df.withColumn("g", screening.growth_on_last_known(df, "s", "i", "v")).orderBy("i").collect()]
    assert got == [None, None, None, pytest.approx(100.0), pytest.approx(-125.0), None]


def test_decumulation_resums_and_flags(spark):
    q = [dt.date(2023, 6, 30), dt.date(2023, 9, 30), dt.date(2023, 12, 31), dt.date(2024, 3, 31)]
    rows = [
        ("A", True, q[0], {"S": 10.0}, {"S": 10.0, "P": 5.0}), ("A", True, q[1], {"S": 15.0}, {"S": 25.0, "P": 5.0}),
        ("A", True, q[2], {"S": 5.0}, {}), ("A", True, q[3], {}, {"S": 50.0}),
        ("B", True, q[1], {}, {"S": 7.0}), ("C", None, q[0], None, None),
    ]
    f = spark.createDataFrame(rows, "symbol string, consolidated boolean, q date, facts map<string,double>, ytd map<string,double>")
    got = {(r["symbol"], r["q"], r["item"]): (r["value"], r["how"]) for r in fundamentals.decumulate(f, ["P"]).collect()}
    assert got == {
        ("A", q[0], "S"): (10.0, "first"), ("A", q[0], "P"): (5.0, "carried"), ("A", q[1], "S"): (15.0, "prior_ytd"), ("A", q[1], "P"): (5.0, "carried"),
        ("A", q[3], "S"): (20.0, "prior_quarters"), ("B", q[1], "S"): (None, "unresolved"),
    }


def test_parsers(spark):
    numbers = {"1,234": 1234.0, "5,27,005": 527005.0, "(437.4)": -437.4, "₹ 724 Cr.": 724.0, "Rs. 12.5": 12.5, "−5": -5.0, "１７７": 177.0, "267 *": 267.0, "3.2e+02": 320.0,
               "-": None, "NA": None, "": None, "12 / 3": None, "1,2x7": None, "see note 3": None, "5-7": None, "NaN": None, None: None}
    assert {k: value(spark, read_number(F.lit(k))) for k in numbers} == numbers
    percents = {"36 %": 36.0, "18.5pct": 18.5, "9 per cent": 9.0, "(3.5%)": -3.5, "+7%": 7.0, "5-7%": None, "low teens %": None, "12": 12.0}
    assert {k: value(spark, read_percent(F.lit(k))) for k in percents} == percents
    days = {"2021-02-03": dt.date(2021, 2, 3), "03/02/2021": dt.date(2021, 2, 3), "01-AUG-2023": dt.date(2023, 8, 1), "31 Feb 2021": None, "February 29, 1956": dt.date(1956, 2, 29),
            "-86400000": dt.date(1969, 12, 31), "0": dt.date(1970, 1, 1), "last spring": None, "29/02/2023": None}
    assert {k: value(spark, read_date(F.lit(k))) for k in days} == days
    flags = {"yes ": True, "N": False, "TRUE": True, "0": False, "maybe": None, "2": None, "n.a.": None}
    assert {k: value(spark, read_flag(F.lit(k))) for k in flags} == flags
    assert value(spark, label_key(F.lit("R&D  Spend (Rs Cr) +"))) == "rdspend"
    months = {"Mar-24": "2024-03", "31 Mar 2020": "2020-03", "March 2019": "2019-03", "2024-12": "2024-12", "TTM": None, "2024-13": None}
    assert {k: value(spark, period_month(F.lit(k))) for k in months} == months
    ts = spark.sql("select timestamp_ntz'1969-12-31 23:59:59.5' as t")
    assert one(ts.select(micros(F.col("t")).alias("v")))["v"] == -500_000


def test_wide_companies_edges(spark):
    cat = spark.createDataFrame([("tijori", None, "arpu", "ARPU", "number"), ("tijori", None, "export_house", "Export House", "flag"), ("screener", "profit_loss", "sales", "Sales", "number")],
                                "src string, statement string, attribute string, label string, value_type string")
    t = lambda d: dt.datetime(2024, 1, d)
    rows = [(1, "x", "ARPU:", "5", t(1)), (2, "x", "arpu", "-", t(2)), (3, "x", "Export-House", "Y", t(1)), (3, "x", "Export-House", "Y", t(1)), (4, None, "ARPU", "1", t(1)),
            (5, "y", "ARPU (Nos)", "1,200", None), (6, "y", "Unknown", "1", t(1)), (7, "z", None, None, t(1)), (8, "tie", "ARPU", "1", t(1)), (9, "tie", "ARPU", "2", t(1))]
    df = spark.createDataFrame(rows, "rec_id long, slug string, metrics string, val string, scraped_at timestamp_ntz").withColumn("cell", F.lit("clash"))
    got = {r["slug"]: (r["arpu"], r["export_house"]) for r in wide.wide_companies(df, cat).collect()}
    assert got == {"x": (None, True), "y": (1200.0, None), "z": (None, None), "tie": (2.0, None)}
    assert wide.wide_companies(df.limit(0), cat).count() == 0
    assert {tuple(r) for r in wide.filled_cells(wide.wide_companies(df, cat), "slug").collect()} == {("x", "export_house"), ("y", "arpu"), ("tie", "arpu")}


def test_wide_is_one_row_per_entity_at_any_block(spark):
    cells = spark.range(500).select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("k"), F.lit("a").alias("attribute"),
                                    F.struct(F.col("id").cast("double").alias("number"), F.lit(None).cast("date").alias("day"), F.lit(None).cast("boolean").alias("flag"), F.lit(None).cast("string").alias("text")).alias("cell"))
    for block in (1, 7, 64):
        got = wide.stitch_wide(cells, cells.select("k"), "k", {"a": "number", "b": "text"}, block).collect()
        assert len(got) == 500 and all(r["a"] == float(r["k"][1:]) and r["b"] is None for r in got)
    numbers = sorted(r["ordinal"] for r in wide.global_ordinals(cells, "k").collect())
    assert numbers == list(range(500))


def test_wide_statements_edges(spark):
    cat = spark.createDataFrame([("screener", "profit_loss", "sales", "Sales", "number")], "src string, statement string, attribute string, label string, value_type string")
    t = lambda d: dt.datetime(2024, 1, d)
    rows = [(1, "A", "standalone", "profit_loss", [{"metric": "Sales", "Mar 2024": "1"}], t(1)), (2, "A", "standalone", "profit_loss", [{"metric": "Sales +", "Mar-24": "₹ 2.5", "TTM": "9"}, {"metric": "Other", "Mar-24": "1"}], t(2)),
            (3, "B", "standalone", "profit_loss", None, t(1)), (4, None, "standalone", "profit_loss", [{"metric": "Sales", "Mar 2024": "1"}], t(1)), (5, "C", "standalone", "profit_loss", [{"metric": "SALES", "2024-03": "", "2023-03": "7"}], t(1))]
    df = spark.createDataFrame(rows, "rec_id long, symbol string, basis string, statement string, rows array<map<string,string>>, scraped_at timestamp_ntz")
    got = {r["entity"]: r["sales"] for r in wide.wide_statements(df, cat).collect()}
    assert got == {"A|standalone|profit_loss|2024-03": 2.5, "C|standalone|profit_loss|2024-03": None, "C|standalone|profit_loss|2023-03": 7.0}


def test_reference_data(spark):
    a = spark.createDataFrame([("I1", "Alpha", "A"), (None, "Lone", "L")], "isin string, name string, code string")
    b = spark.createDataFrame([("I1", "Alpha Ltd", "1"), (None, "Other", "2"), ("I3", "Gamma", "3")], "isin string, name string, code string")
    got = sorted(tuple(r)[1:] for r in reference_data.outer_master(a, b, "isin", ("N", "B")).collect())
    assert got == sorted([("Alpha", "A", "1", "N+B"), ("Lone", "L", None, "N"), ("Other", None, "2", "B"), ("Gamma", None, "3", "B")])
    u = spark.createDataFrame([("A", "x", 3.0), ("B", "x", 2.0), ("C", "x", None), ("D", None, 9.0)], "s string, g string, m double")
    assert {(r["s"], r["peer"], r["rank"]) for r in reference_data.peers(u, "s", "g", "m", 1).collect()} == {("A", "B", 1), ("B", "A", 1), ("C", "A", 1)}
    w = {r["s"]: r["weight_pct"] for r in reference_data.group_weights(u.filter("g = 'x'"), "g", "m").collect()}
    assert w["A"] == 60.0 and w["B"] == 40.0
    m = spark.sql("select map('a', 1, 'b', 2) as x, map('b', 9, 'c', 3) as y")
    assert one(m.select(reference_data.overlay(F.col("x"), F.col("y")).alias("v")))["v"] == {"a": 1, "b": 2, "c": 3}
    assert one(m.select(reference_data.overlay(F.col("x"), F.col("y"), True).alias("v")))["v"] == {"a": 1, "b": 9, "c": 3}


def test_text_operators(spark):
    assert value(spark, text.normalise_text(F.lit("# Head\r\n\r\n\r\n\r\n**bold**  x​y\xa0z "))) == "Head\n\nbold xy z"
    assert value(spark, text.html_to_text(F.lit("<p>A &amp; B</p><script>x</script><p>A &amp; B</p><td>c</td>"))) == "A & B\nc"
    assert value(spark, text.label_date(F.lit("Nov_2023"))) == 20231101 and value(spark, text.label_date(F.lit("soon"))) == 0
    body = " ".join(f"Sentence number {i} says a little something here." for i in range(200))
    docs = spark.createDataFrame([(1, body), (2, ""), (3, None), (4, "x" * 9000)], "id long, t string")
    got = text.sliding_chunks(docs, "id", "t", 100, 200, 20).collect()
    assert max(r["n_tokens"] for r in got) <= 200 and {r["id"] for r in got} == {1, 4}
    joined = " ".join(r["chunk"] for r in sorted((r for r in got if r["id"] == 1), key=lambda r: r["seq"]))
    assert all(f"number {i} says" in joined for i in range(200))
    blocks = spark.createDataFrame([("k", i, s) for i, s in enumerate([3, 4, 5, 20, 1, 1])], "k string, o long, s int")
    assert [r["bin"] for r in text.pack_blocks(blocks, "k", "o", "s", 8).orderBy("o").collect()] == [0, 0, 1, 2, 3, 3]
    lines = spark.createDataFrame([(1, "Head\na\nHead\nb\nHead\nc")], "id long, t string")
    assert one(text.strip_frequent_lines(lines, "id", "t", 3))["t"] == "a\nb\nc"


def test_html_to_text_is_linear(spark):
    import time

    page = spark.createDataFrame([("<p>" + "</p><p>".join(f"line {i} &amp; more" for i in range(20_000)) + "</p>",)], "h string")
    began = time.perf_counter()
    got = page.select(text.html_to_text(F.col("h")).alias("t")).first()["t"]
    assert got.count("\n") == 19_999 and time.perf_counter() - began < 20


def test_chunks_in_tokens(spark):
    from lakefold.functions import tokens

    if not os.path.exists(tokens.TOKENIZER):
        pytest.skip("no tokenizer here")
    docs = spark.createDataFrame([(1, " ".join(f"Sentence {i} on the dividend of ₹{i}.50 crore." for i in range(200))), (2, "वार्षिक" * 900)], "id long, t string")
    got = text.sliding_chunks(docs, "id", "t", 100, 200, 20, tokens.TOKENIZER).collect()
    size = tokens.token_size(tokens.TOKENIZER)
    assert {r["id"] for r in got} == {1, 2} and max(size(r["chunk"]) for r in got) <= 220 and max(r["n_tokens"] for r in got) <= 200


def test_upserts_rewrite_only_the_buckets_they_touch(spark, tmp_path):
    from lakefold.streaming import events

    target = str(tmp_path / "t")
    schema = spark.createDataFrame([], "k long, at long, v string").schema
    write = events.upsert(spark, target, ["k"], [F.col("at").desc()], buckets=8)
    batches = [[(i, 1, "a") for i in range(40)], [(3, 2, "b"), (3, 0, "old")], [(41, 1, "c")], [(3, 1, "late")]]
    for n, rows in enumerate(batches):
        write(spark.createDataFrame(rows, schema), n)
    write(spark.createDataFrame(batches[3], schema), 3)  # replayed
    got = {r["k"]: r["v"] for r in events.newest_version(spark, target, schema).collect()}
    assert got == {**{i: "a" for i in range(40)}, 3: "b", 41: "c"}
    assert len(list((tmp_path / "t" / "v=1").glob("b=*"))) == 1


def test_windows_over_late_batches_and_the_end_of_input(spark, tmp_path):
    from lakefold.streaming import events

    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    schema = spark.createDataFrame([], "ts timestamp, event_type string, user_id long, value double").schema
    folder = tmp_path / "in"
    for n, rows in enumerate([[(at(5), "a", 1, 1.0), (at(70), "a", 1, 1.0)], [(at(61), "a", 1, 1.0), (at(62), "b", 2, 1.0), (at(1), "a", 1, 1.0)], [(at(130), "a", 1, 1.0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        for f in folder.glob("part-*"):
            if not f.name.startswith("part-9"):
                f.rename(folder / f"part-9{n}.parquet")
                os.utime(folder / f"part-9{n}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    stream = events.file_stream(spark, str(folder), schema, 1, "part-9*")
    out = events.drain_to_end(stream, lambda x: events.tumbling(x, "ts", "1 hour", ["event_type"], "10 minutes"), "ts", "window_start", str(tmp_path / "run"))
    got = {(r["window_start"].hour, r["event_type"]): r["n"] for r in out.collect()}
    assert got[1, "a"] == 2 and got[1, "b"] == 1 and got[2, "a"] == 1 and got[0, "a"] in (1, 2)


def test_retrieval_cap_and_ties(spark):
    v = spark.createDataFrame([(i, i % 2, [1.0, 0.0] if i < 4 else [0.0, 1.0]) for i in range(6)], "id long, g long, embedding array<float>")
    assert [r["id"] for r in retrieval.top_k(v, [1.0, 0.0], "id", 3).collect()] == [0, 1, 2]
    assert [r["id"] for r in retrieval.top_k_capped(v, [1.0, 0.0], "id", "g", 4, 1).collect()] == [0, 1]


def test_retrieval_for_a_table_of_queries(spark):
    v = spark.createDataFrame([(i, i % 3, i % 4, [float((i * 7) % 5), float((i * 3) % 4)]) for i in range(24)], "id int, g int, day int, embedding array<float>")
    q = spark.createDataFrame([(i, [float(i), 1.0 - i]) for i in range(3)], "query int, embedding array<float>")
    one_by_one = {r["query"]: [float(x) for x in r["embedding"]] for r in q.collect()}

    def rows(df, *first):
        return sorted((*first, *(r[c] for c in ("query", "id", "score") if c in df.columns)) for r in df.collect())

    for all_, single in (
        (retrieval.top_k_all(v, q, "query", "id", 5, F.col("g") > 0), lambda x: retrieval.top_k(v, x, "id", 5, F.col("g") > 0)),
        (retrieval.top_k_capped_all(v, q, "query", "id", "g", 3, 1), lambda x: retrieval.top_k_capped(v, x, "id", "g", 3, 1)),
        (retrieval.timeline_all(v, q, "query", "id", "day", 2, 2), lambda x: retrieval.timeline(v, x, "id", "day", 2, 2)),
    ):
        assert rows(all_) == sorted(x for i, vec in one_by_one.items() for x in rows(single(vec), i))



def test_sinks(spark, tmp_path):
    path, calls = str(tmp_path / "v"), []

    def build():
        calls.append(1)
        return spark.range(3)

    assert sinks.materialize(spark, path, build).count() == 3 and sinks.materialize(spark, path, build).count() == 3
    assert len(calls) == 1 and sinks.materialize(spark, path, build, force=True).count() == 3 and len(calls) == 2
    log = str(tmp_path / "log")
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k int, v string")
    assert sinks.append_new(spark, log, rows, ["k", "v"]) == 2 and sinks.append_new(spark, log, rows, ["k", "v"]) == 0
    kept, report = sinks.delete_where(rows, F.col("v") == "a", F.lit("leak"))
    assert kept.count() == 1 and one(report)["n"] == 2
    assert sinks.to_markdown(rows, 1).splitlines()[2:] == ["| 1 | a |", "… more rows"]


def test_markup(spark):
    page = "<section id='pl'><table><tr><th></th><th>Mar 2023</th><th>Mar 2024</th></tr><tr><td>Sales&nbsp;+</td><td>1,234</td><td>5</td></tr><tr><td>OPM %</td><td>7%</td></tr></table></section>"
    rows = markup.page_tables(spark.createDataFrame([(1, page), (2, ""), (3, None), (4, "<table><tr>broken")], "id long, h string"), "id", "h")
    m = one(markup.statement_matrix(rows, "id"))
    assert m["columns"] == ["Mar 2023", "Mar 2024"] and m["rows"] == [{"metric": "Sales +", "Mar 2023": "1,234", "Mar 2024": "5"}, {"metric": "OPM %", "Mar 2023": "7%"}]
    xml = "<x><context id='D'><period><startDate>2024-01-01</startDate><endDate>2024-03-31</endDate></period></context><context id='S'><scenario><explicitMember>m</explicitMember></scenario></context><Rev contextRef='D'>25000000</Rev><Rev contextRef='S'>1</Rev></x>"
    facts = markup.instance_facts(spark.createDataFrame([(1, xml), (2, "<broken")], "id long, x string"), "id", "x")
    assert [(r["tag"], r["text"], r["end"]) for r in markup.main_context(facts, "id").collect()] == [("Rev", "25000000", "2024-03-31")]
    assert value(spark, markup.scaled(F.lit("25,000,000"), F.lit("money"))) == 2.5
    pts = spark.sql("select array(array(0D, 1D), array(86400000D, null)) as p")
    assert one(pts.select(markup.epoch_series(F.col("p")).alias("s")))["s"] == [(dt.date(1970, 1, 1), 1.0)]
    sheet = spark.createDataFrame([("Sales", "1", None)], "item string, a string, b string")
    assert [tuple(r) for r in markup.unpivot_sheet(sheet, "item").collect()] == [("Sales", "a", "1")]
    assert tuple(value(spark, markup.split_trailing_value(F.lit("Market Cap 1,234 Cr")))) == ("Market Cap", "1,234 Cr")


def test_concentration_and_weights(spark):
    h = portfolio.normalised(spark.createDataFrame([("A", 1.0), ("B", 3.0)], "symbol string, weight double"))
    assert sum(r["weight"] for r in h.collect()) == pytest.approx(1.0) and one(portfolio.concentration(h))["hhi"] == pytest.approx(0.625)
