"""Document operators: cover letters, section labels, boilerplate, quality gates, fields of letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakefold.operators.text import compact_date, letterhead_markers, month_number, text_lines

#: Topics in the order in which the first hit wins.
TOPICS = {
    "guidance": ["guidance", "outlook", "expects", "target"], "capex": ["outlay", "capital work", "new capacity", "capex"], "demand": ["demand", "volume", "order pipeline", "customers"],
    "margins": ["margin", "cost", "price increase", "raw material"], "debt": ["borrowing", "net debt", "lender", "liquidity", "interest cover"], "returns": ["dividend", "buyback"],
}


def topic(text: Column) -> Column:
    """The first topic one of whose words the text holds, else ``other``."""
    low, out = F.lower(text), F.lit("other")
    for name, words in reversed(TOPICS.items()):
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, name).otherwise(out)
    return out


def page_kind(text: Column) -> Column:
    """``thin`` below 250 characters, ``table`` if over 0.16 of it are digits, else ``text``."""
    n = F.length(text)
    digits = n - F.length(F.regexp_replace(text, r"\d", ""))
    return F.when(F.coalesce(n, F.lit(0)) < 250, "thin").when(digits / n > 0.16, "table").otherwise("text")


def is_digital(pages: Column) -> Column:
    """Whether a document has a text layer: 150 characters a page on average."""
    total = F.aggregate(pages, F.lit(0), lambda a, p: a + F.coalesce(F.length(p), F.lit(0)))
    return (F.size(pages) > 0) & (total / F.size(pages) >= 150)


def content_lost(json_size: Column, text_size: Column) -> Column:
    return F.coalesce(json_size < 0.15 * text_size, F.lit(False))


def cover_letter_end(text: Column, scan: int = 120) -> Column:
    """Index of the line after the last letter-head mark in the first ``scan`` lines; 0 without one."""
    lines = F.slice(F.split(text, r"\r\n|\r|\n"), 1, scan)
    marked = F.filter(F.transform(lines, lambda x, i: F.when(letterhead_markers(x) > 0, i + 1).otherwise(0)), lambda v: v > 0)
    return F.coalesce(F.array_max(marked), F.lit(0))


def cut_handoff(text: Column) -> Column:
    """An answer without the operator's hand-off in its last 250 characters."""
    tail = F.right(text, F.lit(250))
    cut = F.regexp_replace(tail, r"(?is)\b(thank you\.?\s*)?(the )?(next|our next) question (is|comes) from\b.*$", "")
    return F.trim(F.concat(F.substring(text, F.lit(1), F.greatest(F.length(text) - F.length(tail), F.lit(0))), cut))


def section_lines(docs: DataFrame, key: str, text: str, headings: list[str]) -> DataFrame:
    """Lines with the section they stand in: the last heading line above them, carried forward."""
    lines = text_lines(docs, key, text)
    bare = F.trim(F.regexp_replace(F.lower("line"), r"[#*>:|]+", " "))
    heading = F.when(bare.isin(*[h.lower() for h in headings]), bare)
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.last(heading, ignorenulls=True).over(w)).withColumn("is_heading", heading.isNotNull())


#: Heading lines of decks by form: hash marks, bold, a slide number, or at least two words all with capitals.
DECK_HEADING = r"^(?:#{1,6}\s+(.+?)[\s#]*|\*\*([^*]+)\*\*:?|Slide\s+\d+\s*[:.-]\s*(.+)|([A-Z][A-Za-z&/'-]*(?: [A-Z][A-Za-z&/'-]*)+))$"


def deck_sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Lines below a heading of any deck, with the heading's words and its position (``section``,
    ``section_pos``); a heading of any name ends the section before it and counts to its own."""
    lines = text_lines(docs, key, text)
    words = F.lower(F.trim(F.concat(*[F.coalesce(F.regexp_extract(F.trim("line"), DECK_HEADING, i), F.lit("")) for i in range(1, 5)])))
    heading = F.when(words != "", F.struct(words.alias("section"), F.col("pos").alias("section_pos")))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out = lines.withColumn("_h", F.last(heading, ignorenulls=True).over(w)).filter("_h is not null")
    return out.select("*", "_h.section", "_h.section_pos").drop("_h")


def skip_boilerplate(docs: DataFrame, key: str, text: str, opens: str, closes: str) -> DataFrame:
    """Lines outside boilerplate: a line that matches ``opens`` starts it, one that matches ``closes`` ends
    it; the state is carried forward over the lines."""
    lines = text_lines(docs, key, text)
    state = F.when(F.col("line").rlike(opens), F.lit(True)).when(F.col("line").rlike(closes), F.lit(False))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("_skip", F.coalesce(F.last(state, ignorenulls=True).over(w), F.lit(False))).filter("not _skip").drop("_skip")


def numeric_blocks(docs: DataFrame, key: str, text: str, least: int = 15, share: float = 0.6) -> DataFrame:
    """Blocks between blank lines of ``least`` lines or more, ``share`` of them numeric: tables to drop."""
    lines = text_lines(docs, key, text).withColumn("blank", (F.trim("line") == "").cast("int"))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    b = lines.withColumn("block", F.sum("blank").over(w)).filter("blank = 0")
    numeric = F.col("line").rlike(r"\d") & (F.length(F.regexp_replace("line", r"[\d.,%()\s-]", "")) <= 0.4 * F.length("line"))
    g = b.groupBy(key, "block").agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n"), F.avg(numeric.cast("double")).alias("numeric_share"))
    return g.filter((F.col("n") >= least) & (F.col("numeric_share") >= share)).drop("block")


def letter_fields(text: Column) -> Column:
    """Subject, scrip code, ISIN and regulation that a filing letter names; empty where it does not."""
    return F.struct(
        F.trim(F.regexp_extract(text, r"(?im)^\s*sub(?:ject)?\s*[-:]\s*(.+)$", 1)).alias("subject"),
        F.regexp_extract(text, r"(?i)\bscrip code[^0-9]{0,12}(\d{6,7})\b", 1).alias("scrip_code"),
        F.regexp_extract(text, r"\b([A-Z]{3}\d{10}|IN[EF][A-Z0-9]{9})\b", 1).alias("isin"),
        F.regexp_extract(text, r"(?i)\bregulation\s+(\d+)", 1).alias("regulation"),
    )


def document_date(text: Column, lines: int = 8) -> Column:
    """yyyymmdd of the first date in the first lines that are not blank: ``12 March 2024``, ``March 12,
    2024`` or ``12/03/2024`` (day first); 0 if there is none in 2000-2035."""
    head = F.array_join(F.slice(F.filter(F.split(text, r"\r\n|\r|\n"), lambda x: F.trim(x) != ""), 1, lines), "\n")
    a, b, c = r"\b(\d{1,2})(?:st|nd|rd|th)?[ -]([A-Za-z]{3,9})[ ,-]+(20\d{2})\b", r"\b([A-Za-z]{3,9}) (\d{1,2}), ?(20\d{2})\b", r"\b(\d{1,2})[/.-](\d{1,2})[/.-](20\d{2})\b"
    g = lambda p, i: F.regexp_extract(head, p, i)
    n = lambda p, i: g(p, i).try_cast("int")
    dates = [compact_date(n(a, 3), month_number(g(a, 2)), n(a, 1)), compact_date(n(b, 3), month_number(g(b, 1)), n(b, 2)), compact_date(n(c, 3), n(c, 2), n(c, 1))]
    return F.coalesce(*[F.when(d > 0, d) for d in dates], F.lit(0))


def fiscal_quarter(month: Column) -> Column:
    """The quarter whose results a call in that month presents (fiscal year April to March)."""
    return F.when(month.between(1, 12), F.element_at(F.array(*map(F.lit, ("Q3", "Q4", "Q1", "Q2"))), F.floor((month - 1) / 3 + 1).cast("int")))


def safe_name(title: Column, most: int = 80) -> Column:
    """A title as a file name."""
    x = F.regexp_replace(F.regexp_replace(title, r"[^\w\s.-]", ""), r"\s+", "_")
    return F.regexp_replace(F.substring(x, 1, most), r"[_.]+$", "")


def quality_reasons(turns: DataFrame, key: str, speaker: str, text: str) -> DataFrame:
    """Why a parsed call is weak: too few turns or speakers, one speaker with nearly everything, a giant
    turn, too little text; empty if it is good."""
    t = turns.groupBy(key, speaker).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(text)).alias("c"), F.max(F.length(text)).alias("m"))
    g = t.groupBy(key).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("speakers"), F.sum("c").alias("c"), F.max("c").alias("top"), F.max("m").alias("m"))
    reasons = F.array_compact(F.array(
        F.when(F.col("n") < 6, "few_turns"), F.when(F.col("speakers") < 3, "few_speakers"), F.when(F.col("top") > 0.9 * F.col("c"), "one_voice"),
        F.when(F.col("m") > 0.6 * F.col("c"), "giant_turn"), F.when(F.col("c") < 1500, "little_text"),
    ))
    return g.select(key, reasons.alias("reasons"), F.when(F.size(reasons) > 0, "weak").otherwise("good").alias("parse_quality"))


def stale_or_missing(universe: DataFrame, have: DataFrame, key: str, time: str, cutoff: Column) -> DataFrame:
    """Keys to fetch again: those without a record, or only with records before ``cutoff``."""
    return universe.select(key).distinct().join(have.filter(F.col(time) >= cutoff).select(key), key, "left_anti")


def prefer_parsed(docs: DataFrame, key: str, form: str) -> DataFrame:
    """Of documents in several forms the parsed one where there is one: others with its key are left out."""
    parsed = docs.filter(F.col(form) == "json")
    return parsed.unionByName(docs.filter(F.col(form) != "json").join(parsed.select(key).distinct(), key, "left_anti"))


def guidance(docs: DataFrame, themes: dict[str, list[str]], key: str, text: str, date: str, per_date: int = 2, n_dates: int = 6) -> DataFrame:
    """Per theme the sentences of the newest dates that speak of it, each statement (its first 120
    characters) once: theme, date, key, statement. Scored by how many of the theme's words they hold."""
    s = docs.filter(F.col(date) > 0).select(key, date, F.posexplode(F.split(text, r"(?<=[.!?])\s+")).alias("pos", "statement")).filter("length(statement) > 30")
    low = F.lower("statement")
    score = lambda words: sum((low.contains(w).cast("int") for w in words), F.lit(0))
    cases = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("theme"), score(w).alias("score")) for i, (t, w) in enumerate(themes.items())])
    hits = s.select(key, date, "pos", "statement", F.inline(cases)).filter("score > 0")
    newest = hits.withColumn("_d", F.dense_rank().over(Window.partitionBy("theme").orderBy(F.col(date).desc()))).filter(F.col("_d") <= n_dates)
    best = newest.withColumn("_n", F.row_number().over(Window.partitionBy("theme", date).orderBy(F.col("score").desc(), key, "pos"))).filter(F.col("_n") <= per_date)
    once = best.withColumn("_o", F.row_number().over(Window.partitionBy(F.substring("statement", 1, 120)).orderBy("i", F.col(date).desc(), key, "pos")))
    return once.filter("_o = 1").select("theme", date, key, "statement")
