"""Text operators of the lake: normalising, boilerplate, dates in names, segmentation, chunking."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from lakefold.functions.parse import let
from lakefold.functions.tokens import shipped, token_size
from lakefold.session import ship

#: Marks of a cover letter, in lower case.
LETTERHEAD = (
    r"phiroze jeejeebhoy",
    r"exchange plaza",
    r"listing department",
    r"scrip code",
    r"regd\.?\s*office\s*:",
    r"yours faithfully",
    r"dear (sirs?|madam)",
    r"take (the )?(same|above|this|it)[^.]{0,40}record",
    r"pursuant to regulation",
)


#: No-break, figure and narrow spaces and curly quotes; ``normalise_text`` makes them plain.
ODD_SIGNS = "\u00a0\u2007\u202f‘’“”"


def normalise_text(text: Column) -> Column:
    """Plain text: marks of emphasis and headings gone, line ends as one kind, odd spaces and zero-width
    signs gone, runs of blanks and of empty lines shortened. The steps have this order."""
    x = F.regexp_replace(text, r"\r\n?", "\n")
    x = F.regexp_replace(x, r"[\x{200b}\x{200c}\x{200d}\x{feff}\x{00ad}]", "")
    x = F.translate(x, ODD_SIGNS, "   ''\"\"")
    x = F.regexp_replace(x, r"\*\*", "")
    x = F.regexp_replace(x, r"(?m)^#+[ \t]+", "")
    x = F.regexp_replace(x, r"[ \t]+", " ")
    x = F.regexp_replace(x, r" ?\n ?", "\n")
    return F.trim(F.regexp_replace(x, r"\n{3,}", "\n\n"))


def dropcap_merge(text: Column) -> Column:
    """Drop caps split off their word are joined again, only in texts with three or more of them."""
    pattern = r"(?m)^([A-Z])\n([a-z]{2,})"
    return F.when(F.regexp_count(text, F.lit(pattern)) >= 3, F.regexp_replace(text, pattern, "$1$2")).otherwise(text)


def letterhead_markers(text: Column) -> Column:
    """How many different letter-head marks a text has."""
    low = F.lower(text)
    return sum((low.rlike(p).cast("int") for p in LETTERHEAD), F.lit(0))


def text_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("pos", "line"))


def line_frequency(docs: DataFrame, key: str, text: str, least: int = 2) -> DataFrame:
    """Lines (trimmed, not empty) that stand ``least`` times or more in one text."""
    lines = text_lines(docs, key, text).select(key, F.trim("line").alias("line")).filter("line <> ''")
    return lines.groupBy(key, "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def strip_frequent_lines(docs: DataFrame, key: str, text: str, least: int = 3) -> DataFrame:
    """Texts without the lines that stand ``least`` times or more in them; order is kept. Arrays of one
    text only, no shuffle."""
    lines = F.split(text, r"\r\n|\r|\n")
    # sorted, equal lines stand together: a line that also stands ``least`` - 1 places on is frequent
    rows = docs.select(key, lines.alias("_l")).withColumn("_s", F.array_sort(F.filter(F.transform("_l", lambda x: F.trim(x)), lambda x: x != "")))
    often = F.array_distinct(F.filter("_s", lambda x, i: x == F.try_element_at("_s", (i + least).cast("int"))))
    rows = rows.withColumn("_o", often)
    return rows.select(key, F.array_join(F.filter("_l", lambda x: ~F.array_contains("_o", F.trim(x))), "\n").alias(text))


def numeric_runs(docs: DataFrame, key: str, text: str, least: int = 4) -> DataFrame:
    """Runs of ``least`` or more lines that are numbers only (axis ticks): key, first line, length."""
    lines = text_lines(docs, key, text).filter("trim(line) <> ''").withColumn("num", F.col("line").rlike(r"^\s*[-+]?[\d.,%]+\s*$"))
    w = Window.partitionBy(key).orderBy("pos")
    lines = lines.withColumn("island", F.sum((~F.col("num")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return lines.filter("num").groupBy(key, "island").agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).drop("island")


def compact_date(year: Column, month: Column, day: Column) -> Column:
    """yyyymmdd as an int, 0 if unknown or outside 2000-2035."""
    ok = year.between(2000, 2035) & month.between(1, 12) & day.between(1, 31)
    return F.coalesce(F.when(ok, year * 10000 + month * 100 + day), F.lit(0)).cast("int")


def month_number(name: Column) -> Column:
    at = F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(F.substring(name, 1, 3)))
    return F.when((F.length(name) >= 3) & (at > 0) & ((at - 1) % 3 == 0), ((at - 1) / 3 + 1).cast("int"))


def label_date(label: Column) -> Column:
    """yyyymmdd (first of the month) of a label such as ``Nov 2023``, ``may_2021``; 0 if there is none."""
    mon = F.regexp_extract(label, r"([A-Za-z]{3})[A-Za-z]*[_ -]?(20\d{2})", 1)
    year = F.regexp_extract(label, r"([A-Za-z]{3})[A-Za-z]*[_ -]?(20\d{2})", 2).try_cast("int")
    return compact_date(year, month_number(mon), F.lit(1))


def latest_year(text: Column) -> Column:
    """The latest year 2000-2035 that a text mentions; null if none."""
    years = F.transform(F.regexp_extract_all(text, F.lit(r"\b(20[0-3]\d)\b")), lambda x: x.cast("int"))
    return F.array_max(F.filter(years, lambda y: y <= 2035))


def sentence_split(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?।])\s+")


def token_length(text: Column) -> Column:
    """Rough tokens: a quarter of the characters, at least one."""
    return F.greatest(F.floor(F.length(text) / 4), F.lit(1)).cast("int")


def html_to_text(html: Column) -> Column:
    """Reading-order text of HTML: scripts and styles gone, block ends as line ends, the basic entities
    resolved, a line that repeats the one before dropped."""
    x = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    x = F.regexp_replace(x, r"(?i)<br\s*/?>|</(p|div|tr|li|h[1-6]|table)>", "\n")
    x = F.regexp_replace(x, r"<[^>]+>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(sign))
    lines = F.filter(F.transform(F.split(x, "\n"), lambda v: F.trim(F.regexp_replace(v, r"\s+", " "))), lambda v: v != "")
    # the list is made once, not once per line
    return let(lines, lambda known: F.array_join(F.filter(known, lambda v, i: (i == 0) | (v != F.try_element_at(known, i))), "\n"))


def roster_like(text: Column) -> Column:
    """Short text full of job titles rather than sentences."""
    titles = F.regexp_count(F.lower(text), F.lit(r"\b(officer|director|chairman|secretary|manager|head|president|analyst)\b"))
    n_words = F.size(F.split(F.trim(text), r"\s+"))
    return (F.length(text) < 160) & (titles >= 4) & (titles > 0.12 * n_words)


def prose_yield(text: Column, least: int = 40) -> Column:
    """Characters in lines longer than ``least``."""
    return F.aggregate(F.split(text, r"\r\n|\r|\n"), F.lit(0), lambda a, x: a + F.when(F.length(x) > least, F.length(x)).otherwise(0))


def sentence_chunks(body: str, size: Callable[[str], int], target: int, most: int, overlap: int) -> list[tuple[int, int, str]]:
    """(seq, size, chunk) of one text. Sentences are packed until ``target``, a sentence above ``most`` is sliced, and
    each chunk starts with the last sentences of the one before worth at least ``overlap``. Sizes are measured once
    per sentence."""
    def sliced(s: str) -> list[str]:
        if size(s) <= most:
            return [s]
        if size is rough_size:
            return [s[i : i + most * 4] for i in range(0, len(s), most * 4)]
        cut = len(s) // 2  # halves until they fit, at a blank if there is one near
        blank = s.rfind(" ", cut // 2, cut)
        cut = blank + 1 if blank > 0 else cut
        return [*sliced(s[:cut]), *sliced(s[cut:])]

    rows: list[tuple[int, int, str]] = []
    held: list[tuple[str, int]] = []
    fill = 0
    for s in (part for whole in re.split(r"(?<=[.!?।])\s+|\n{2,}", body.strip()) if whole for part in sliced(whole)):
        n = size(s)
        if held and fill + n > target:
            rows.append((len(rows), fill, " ".join(t for t, _ in held)))
            at, back = len(held), 0
            while at and back < overlap and back + held[at - 1][1] + n <= most:
                at -= 1
                back += held[at][1]
            if at == 0:
                back -= held[0][1]
                at = 1
            held, fill = held[at:], back
        held.append((s, n))
        fill += n
    if held:
        rows.append((len(rows), fill, " ".join(t for t, _ in held)))
    return rows


def rough_size(s: str) -> int:
    return max(1, len(s) // 4)


def sliding_chunks(docs: DataFrame, key: str, text: str, target: int = 400, most: int = 800, overlap: int = 70, tokenizer: str | None = None) -> DataFrame:
    """Sentence-packed chunks (``sentence_chunks``) of every text: key, seq, n_tokens, chunk. Tokens are those of the
    ``tokenizer`` (path of a rank file), else a quarter of the characters. In Arrow batches, without a shuffle."""
    types = dict(docs.dtypes)
    file = shipped(docs.sparkSession, tokenizer) if tokenizer else None

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = token_size(file()) if file else rough_size
        for frame in frames:
            rows = [(k, *row) for k, body in zip(frame["_k"], frame["_t"]) for row in sentence_chunks(body, size, target, most, overlap)]
            if rows:
                yield pd.DataFrame(rows, columns=[key, "seq", "n_tokens", "chunk"])

    base = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).filter("length(trim(_t)) > 0")
    return base.mapInPandas(pack, f"`{key}` {types[key]}, seq int, n_tokens int, chunk string")


class ChunkText:
    """The chunker as a table function of SQL."""

    def eval(self, body: str, target: int, most: int, overlap: int):
        if body and body.strip():
            yield from sentence_chunks(body, rough_size, target, most, overlap)


def register_functions(spark: SparkSession) -> None:
    """Table functions for SQL: ``chunk_text(text, target, most, overlap)`` gives seq, n_tokens, chunk."""
    ship(spark)
    spark.udtf.register("chunk_text", udtf(ChunkText, returnType="seq int, n_tokens int, chunk string"))


def pack_blocks(blocks: DataFrame, key: str, order: str, size: str, limit: int) -> DataFrame:
    """Greedy packing of ordered blocks into bins of at most ``limit``: key, order, bin (from 0). A block
    alone above the limit is a bin of its own. A fold over one key's sizes, which nothing but the fold can cut."""
    types = dict(blocks.dtypes)

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["o", "s"], kind="stable")
        number, fill, out = 0, 0, []
        for s in part["s"].tolist():
            if fill and fill + s > limit:
                number, fill = number + 1, 0
            fill += s
            out.append(number)
        return pd.DataFrame({key: part["k"], order: part["o"], "bin": pd.Series(out, dtype="int32", index=part.index)})

    rows = blocks.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(size).cast("bigint").alias("s"))
    return rows.groupBy("k").applyInPandas(fold, f"`{key}` {types[key]}, `{order}` {types[order]}, bin int")


def exchanges(turns: DataFrame, key: str, order: str, role: str, question: str) -> DataFrame:
    """Question-and-answer exchanges: every question opens one, the turns after it up to the next question
    belong to it: key, exchange, first and last turn, turns, answers."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    t = turns.withColumn("exchange", F.sum((F.col(role) == question).cast("int")).over(w)).filter("exchange > 0")
    return t.groupBy(key, "exchange").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n_turns"), F.count_if(F.col(role) != question).alias("n_answers"))
