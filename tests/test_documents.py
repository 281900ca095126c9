"""Document, cleaning, string and metric-map operators, and streaming, on hand fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lakefold.functions import strings
from lakefold.operators import cleaning, documents
from lakefold.operators.metric_map import flat_metrics, rules
from lakefold.streaming import events


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, t string")


def test_fields_of_letters(spark):
    f = value(spark, documents.letter_fields(F.lit("Subject: Results of Q1\nScrip code: 5039759, ISIN XNE4119070178 under Regulation 30")))
    assert tuple(f) == ("Results of Q1", "5039759", "XNE4119070178", "30")
    assert value(spark, documents.document_date(F.lit("\n\nPune, 12th March 2024\n"))) == 20240312
    assert value(spark, documents.document_date(F.lit("March 3, 2021"))) == 20210303 and value(spark, documents.document_date(F.lit("3/12/2022"))) == 20221203
    assert value(spark, documents.document_date(F.lit("12 March 1999"))) == 0
    assert value(spark, documents.cover_letter_end(F.lit("Alpha Ltd\nRegd. Office: x\nbody"))) == 2 and value(spark, documents.cover_letter_end(F.lit("body"))) == 0
    assert value(spark, documents.cut_handoff(F.lit("Yes, it did. The next question is from the line of Bob."))) == "Yes, it did."
    assert value(spark, documents.safe_name(F.lit("Results: Q1 / FY24."))) == "Results_Q1_FY24"
    assert [value(spark, documents.fiscal_quarter(F.lit(m))) for m in (1, 5, 7, 12, 13)] == ["Q3", "Q4", "Q1", "Q2", None]
    assert value(spark, documents.topic(F.lit("Net debt fell"))) == "debt" and value(spark, documents.topic(F.lit(None).cast("string"))) == "other"


def test_pages(spark):
    assert value(spark, documents.page_kind(F.lit("x"))) == "thin" and value(spark, documents.page_kind(F.lit("1 2 3 " * 60))) == "table" and value(spark, documents.page_kind(F.lit("word " * 60))) == "text"
    assert value(spark, documents.is_digital(F.array(F.lit("x" * 200), F.lit("")))) is False and value(spark, documents.is_digital(F.array(F.lit("x" * 400), F.lit(None)))) is True
    assert value(spark, documents.content_lost(F.lit(10), F.lit(100))) is True and value(spark, documents.content_lost(F.lit(None).cast("int"), F.lit(1))) is False


def test_sections_and_boilerplate(spark):
    d = docs(spark, "## Risks\na\nOutlook:\nb\nc", None, "")
    got = {(r["section"], r["line"]) for r in documents.section_lines(d, "id", "t", ["Risks", "Outlook"]).filter("not is_heading and line <> ''").collect()}
    assert got == {("risks", "a"), ("outlook", "b"), ("outlook", "c")}
    kept = [r["line"] for r in documents.skip_boilerplate(docs(spark, "a\nDISCLAIMER\nx\nRationale\nb"), "id", "t", "(?i)disclaimer", "(?i)rationale").orderBy("pos").collect()]
    assert kept == ["a", "Rationale", "b"]
    table = "\n".join(["1 2 3"] * 15)
    assert documents.numeric_blocks(docs(spark, f"text\n\n{table}\n\nmore text"), "id", "t").count() == 1


def test_cleaning(spark):
    deck = docs(spark, "Margins rose in the year\nand volumes too\n\n12\n13\n\nDisclaimer: forward-looking words here and more of them\n\nShort\n\n" + "\n\n".join(["A block of text that is long enough to keep"] * 8) + "\n\nThank you for your time and attention today")
    texts = [r["text"] for r in cleaning.clean_presentation(deck, "id", "t").orderBy("block").collect()]
    assert texts[0].startswith("Margins rose") and len(texts) == 9 and not any("Thank" in t or "Disclaimer" in t for t in texts)
    report = docs(spark, "\n".join(["Running head", "a line", "goes on.", "12"] * 9))
    paragraphs = [r["text"] for r in cleaning.clean_report(report, "id", "t").orderBy("first_pos").collect()]
    assert paragraphs[0] == "Running head a line goes on." and sum("Running" in p for p in paragraphs) == 1
    r = cleaning.clean_rating(docs(spark, "Head\nRationale\nGood.\nIssuer not cooperating\nAnnexure 1\nx"), "id", "t").first()
    assert r["text"] == "Rationale\nGood.\nIssuer not cooperating" and r["quality"] == "stub" and r["non_cooperation"]
    assert value(spark, cleaning.announcement_body(F.lit("Head\nDear Sir,\nThe news.\nYours faithfully,\nX"))) == "The news."
    x = spark.createDataFrame([(1, 1, "Why?", "Because."), (1, 2, "ok", "short"), (1, 3, "ok", "r" * 600), (1, 4, "What about the margin in the coming year", "Fine. Thank you all for joining us.")], "k int, i int, q string, a string")
    got = [(r["i"], r["kind"], r["a"][:5]) for r in cleaning.clean_exchanges(x, "k", "i", "q", "a").orderBy("i").collect()]
    assert got == [(1, "exchange", "Becau"), (3, "remark", "rrrrr"), (4, "exchange", "Fine.")]


def test_calls(spark):
    t = spark.createDataFrame([(1, 1, "M", "x" * 400), (1, 2, "A", "y" * 400), (1, 3, "O", "first question please"), (1, 4, "A", "z" * 400), (1, 5, "N", "n" * 400)], "k int, i int, s string, t string")
    roster = spark.createDataFrame([(1, "A")], "k int, s string")
    assert [r["s"] for r in cleaning.management(t, "k", "i", "s", "t", roster).collect()] == ["M"]
    assert cleaning.questions_start(t, "k", "i", "t").first()["qa_start"] == 3
    q = documents.quality_reasons(t, "k", "s", "t").first()
    assert q["parse_quality"] == "weak" and q["reasons"] == ["few_turns"]


def test_selection(spark):
    u = spark.createDataFrame([("A",), ("B",), ("C",)], "s string")
    have = spark.createDataFrame([("A", dt.date(2024, 1, 2)), ("B", dt.date(2023, 1, 1))], "s string, t date")
    assert {r["s"] for r in documents.stale_or_missing(u, have, "s", "t", F.lit(dt.date(2024, 1, 1))).collect()} == {"B", "C"}
    forms = spark.createDataFrame([("A", "json"), ("A", "md"), ("B", "md")], "s string, f string")
    assert {tuple(r) for r in documents.prefer_parsed(forms, "s", "f").collect()} == {("A", "json"), ("B", "md")}
    d = spark.createDataFrame([(1, "We expect the margin to rise in the next year. Same statement here.", 20240101), (2, "We expect the margin to rise in the next year. Demand was soft in all regions this year.", 20240201), (3, None, 20240301)], "id long, t string, day int")
    got = {(r["theme"], r["statement"][:20]) for r in documents.guidance(d, {"m": ["margin"], "d": ["demand"]}, "id", "t", "day").collect()}
    assert got == {("m", "We expect the margin"), ("d", "Demand was soft in a")}


def test_strings(spark):
    v = lambda c: value(spark, c)
    assert v(strings.camel_words(F.lit("ProfitLossForPeriod"))) == "Profit Loss For Period" and v(strings.fiscal_label(F.lit("2024-03-31"))) == "FY24"
    assert v(strings.plain_signs(F.lit("ﬁne â€“ x​"))) == "fine – x" and v(strings.suffix_after(F.lit("2024_note_Acme.pdf"))) == "Acme"
    assert tuple(v(strings.headline_parts(F.lit("Results - Q1 - final")))) == ("Results", "Q1 - final") and tuple(v(strings.headline_parts(F.lit("Plain")))) == ("", "Plain")
    assert v(strings.last_known(F.array(F.lit(1), F.lit(2), F.lit(None)))) == 2 and v(strings.last_known(F.array(F.lit(None).cast("int")))) is None
    assert v(strings.pipe_cell(F.lit("| Sales | 1 | 2 |\n| Paid-up | 40 | |"), "Paid-up")) == "40"
    assert v(strings.listing_key(F.lit(" "), F.lit("500325.0"))) == "500325" and v(strings.listing_key(F.lit(None).cast("string"), F.lit("x"))) is None
    assert [tuple(x) for x in v(strings.linked_names(F.lit('<a href="/company/abc-ltd/">Abc Ltd</a>')))] == [("abc-ltd", "Abc Ltd")]
    assert v(strings.marker_label(F.lit("## **Rationale:** | x"))) == "rationale"
    for blob, names in (('[{"name":"a","data":[[0,1]]}]', ["a"]), ("[[0,1],[1,2]]", ["value"]), ('{"x":[[0,1]]}', ["x"]), ("oops", None)):
        got = v(strings.series_of_blob(F.lit(blob)))
        assert (got and [s["name"] for s in got]) == names
    assert v(strings.money(F.lit(1234.5), F.lit(False))) == "1,234 cr" and v(strings.money(F.lit(1.5), F.lit(True))) == "1.50"


def test_metric_map(spark):
    rows = [("A", f"20{y}-03", 100.0 * 1.1 ** (y - 18), 10.0 if y != 21 else None) for y in range(18, 25)]
    m = flat_metrics(spark.createDataFrame(rows, "k string, p string, sales double, net_profit double"), "k", "p").first()
    assert m["sales_growth"] == pytest.approx(10.0) and m["sales_growth_5_years"] == pytest.approx(10.0) and m["sales_preceding_year"] == pytest.approx(rows[-2][2])
    assert m["average_net_profit_3_years"] == 10.0 and m["average_net_profit_5_years"] is None and m["npm"] == pytest.approx(1000 / rows[-1][2])
    assert len({r[0] for r in rules()}) == len(rules()) > 150


def test_streams_resume_and_replace(spark, tmp_path):
    folder = str(tmp_path / "in")
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    schema = "id long, ts timestamp, kind string, value double"
    spark.createDataFrame([(1, at(0), "a", 1.0), (2, at(1), "a", 2.0)], schema).write.mode("append").parquet(folder)
    run = lambda: events.drain(events.file_stream(spark, folder, spark.createDataFrame([], schema).schema), str(tmp_path / "out"), str(tmp_path / "c"))
    run()
    spark.createDataFrame([(3, at(2), "b", 3.0)], schema).write.mode("append").parquet(folder)
    run()
    run()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]
    old = spark.createDataFrame([("s1", "k1"), ("s1", "k2"), ("s2", "k3")], "src string, k string")
    new = spark.createDataFrame([("s1", "k4"), ("s1", "k4")], "src string, k string")
    assert sorted(tuple(r) for r in events.reindex_by_source(old, new, "src", "k").collect()) == [("s1", "k4"), ("s2", "k3")]


def test_deck_sections_by_form(spark):
    d = spark.createDataFrame([(1, "intro line\n## Net Debt In Pump Sets\n- a b\n\n**Interest Cover In Tile Adhesives**\n- c\nSlide 3: Freight Cost In Yarn\n- d\nGross Margin In Cement\n- e of f")], "id int, t string")
    got = [(r["section"], r["line"]) for r in documents.deck_sections(d, "id", "t").orderBy("pos").collect() if r["line"].startswith("-")]
    assert got == [("net debt in pump sets", "- a b"), ("interest cover in tile adhesives", "- c"), ("freight cost in yarn", "- d"), ("gross margin in cement", "- e of f")]
