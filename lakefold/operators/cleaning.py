"""Cleaning of decks, reports, rating notes, announcements and parsed calls, line by line in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakefold.operators.text import letterhead_markers, text_lines


def _forward() -> tuple:
    return Window.unboundedPreceding, 0


def blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, block, first_pos, n_lines, text: the stretches between blank lines."""
    lines = text_lines(docs, key, text)
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(*_forward())
    lines = lines.withColumn("block", F.sum((F.trim("line") == "").cast("int")).over(w)).filter("trim(line) <> ''")
    return lines.groupBy(key, "block").agg(
        F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n_lines"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: F.trim(x["line"])), "\n").alias("text"),
    )


def clean_presentation(docs: DataFrame, key: str, text: str, least: int = 30) -> DataFrame:
    """Blocks of a deck worth keeping: no disclaimer, no letter head (two marks), no thanks or contact in
    the last 15 percent, longer than ``least`` characters; lines that are only numbers are left out."""
    lines = text_lines(docs, key, text).filter(~F.col("line").rlike(r"^\s*[-+]?[\d.,%]+\s*$"))
    kept = lines.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias(text))
    b = blocks(kept, key, text)
    n = F.max("first_pos").over(Window.partitionBy(key))
    b = b.withColumn("_at", F.when(n > 0, F.col("first_pos") / n).otherwise(0.0))
    low = F.lower("text")
    drop = low.rlike("disclaimer|forward[- ]looking|safe harbou?r") | (letterhead_markers(F.col("text")) >= 2) | ((F.col("_at") >= 0.85) & low.rlike(r"^\W*(thank you|contact)"))
    return b.filter(~drop & (F.length("text") > least)).drop("_at")


def clean_report(docs: DataFrame, key: str, text: str, repeats: int = 8) -> DataFrame:
    """Paragraphs of a report: a line that stands ``repeats`` times or more stays once, lone page numbers
    go, lines are joined until a sentence ends."""
    lines = text_lines(docs, key, text)
    bare = F.lower(F.trim("line"))
    same = Window.partitionBy(key, "_bare")
    lines = lines.withColumn("_bare", bare).withColumns({"_n": F.count(F.lit(1)).over(same), "_i": F.row_number().over(same.orderBy("pos"))})
    lines = lines.filter((F.col("_bare") == "") | (F.col("_n") < repeats) | (F.col("_i") == 1)).filter(~F.col("_bare").rlike(r"^(page )?\d{1,4}( of \d{1,4})?$"))
    w = Window.partitionBy(key).orderBy("pos")
    before = F.lag("line").over(w)
    starts = (F.trim("line") == "") | before.isNull() | (F.trim(F.coalesce(before, F.lit(""))) == "") | before.rlike(r"[.!?:]\s*$")
    lines = lines.withColumn("paragraph", F.sum(starts.cast("int")).over(w.rowsBetween(*_forward()))).filter("trim(line) <> ''")
    return lines.groupBy(key, "paragraph").agg(F.min("pos").alias("first_pos"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: F.trim(x["line"])), " ").alias("text"))


def clean_rating(docs: DataFrame, key: str, text: str, start: str = r"rationale", stop: str = r"^\W*(annexure|about the company|disclaimer)", stub: int = 600) -> DataFrame:
    """A rating note from its rationale to its annexures: text, quality (``stub`` if short), whether the
    company does not cooperate. Without a rationale the whole note counts."""
    lines = text_lines(docs, key, text)
    low = F.lower("line")
    w = Window.partitionBy(key)
    lines = lines.withColumns({"_a": F.min(F.when(low.rlike(start), F.col("pos"))).over(w), "_z": F.min(F.when(low.rlike(stop), F.col("pos"))).over(w)})
    lines = lines.filter((F.col("pos") >= F.coalesce("_a", F.lit(0))) & (F.col("_z").isNull() | (F.col("pos") < F.col("_z")) | (F.col("_z") <= F.coalesce("_a", F.lit(0)))))
    out = lines.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return out.select(key, "text", F.when(F.length("text") < stub, "stub").otherwise("full").alias("quality"), F.lower("text").contains("not cooperating").alias("non_cooperation"))


def announcement_body(text: Column) -> Column:
    """The body of an announcement: from the first line after the salutation to the closing."""
    x = F.regexp_replace(text, r"(?is)^.*?\b(dear (sir|madam)[^\n]*)\n", "")
    return F.trim(F.regexp_replace(x, r"(?is)\n\s*(yours (faithfully|sincerely|truly)|thanking you|for and on behalf of)\b.*$", ""))


def clean_exchanges(exchanges: DataFrame, key: str, order: str, question: str, answer: str, least: int = 30, salvage: int = 500) -> DataFrame:
    """Exchanges worth keeping: a question that asks something or is long enough; a long answer without
    one is kept as a remark; boilerplate at the end of the last answer goes."""
    asks = (F.length(F.trim(question)) >= least) | F.col(question).contains("?")
    kind = F.when(asks, "exchange").when(F.length(answer) > salvage, "remark")
    last = F.max(order).over(Window.partitionBy(key))
    closing = r"(?is)\b(thank you( all)?( very much)? for (joining|attending)|that concludes|on behalf of)\b.*$"
    cut = F.when(F.col(order) == last, F.trim(F.regexp_replace(answer, closing, ""))).otherwise(F.col(answer))
    return exchanges.select(key, order, F.when(kind == "exchange", F.col(question)).alias(question), cut.alias(answer), kind.alias("kind")).filter("kind is not null")


def management(turns: DataFrame, key: str, order: str, speaker: str, text: str, roster: DataFrame, long: int = 350) -> DataFrame:
    """Speakers of the management: long turns in the first forty percent of a call, or two long turns
    anywhere, of people who are not on the analysts' roster (key, speaker)."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    t = turns.withColumn("_at", F.row_number().over(Window.partitionBy(key).orderBy(order)) / n)
    is_long = F.length(text) >= long
    g = t.groupBy(key, speaker).agg(F.count_if(is_long & (F.col("_at") <= 0.4)).alias("early"), F.count_if(is_long).alias("n_long"))
    return g.filter("early > 0 or n_long >= 2").join(roster.select(key, speaker), [key, speaker], "left_anti").select(key, speaker)


#: How an operator announces who speaks next, and from which firm.
INTRODUCED = r"(?:line of|next participant,)\s+([A-Z][A-Za-z.'-]+(?: [A-Z][A-Za-z.'-]+){1,3})(?:\s+(?:from|of)\s+([A-Z][^.\n]{1,50}))?"


def introduced(calls: DataFrame, key: str, text: str) -> DataFrame:
    """The analysts an operator introduces: key, name, firm (empty if it is not said), each once; what follows the firm
    (please, thank you, go ahead) is cut."""
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(INTRODUCED), F.lit(1)).alias("name"), F.regexp_extract_all(text, F.lit(INTRODUCED), F.lit(2)).alias("firm"))
    rows = calls.select(key, F.explode(found).alias("x")).select(key, F.regexp_replace("x.name", r"\.+$", "").alias("name"), F.trim(F.regexp_replace("x.firm", r"(?i)\b(please|thank|go ahead|you (can|may))\b.*$", "")).alias("firm"))
    return rows.groupBy(key, "name").agg(F.max("firm").alias("firm"))


def questions_start(turns: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """The first turn in which the call is opened for questions."""
    opened = F.lower(text).rlike(r"question[- ]and[- ]answer|first question|open (the )?(floor|line)|next question")
    return turns.groupBy(key).agg(F.min(F.when(opened, F.col(order))).alias("qa_start"))
