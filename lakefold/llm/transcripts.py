"""Turn raw call transcripts into clean, ordered speaker turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_CLOCK = r"\d{1,2}(?::\d{2}){1,2}(?:\.\d+)?"
#: time stamp, arrows and heading marks before a label
_LINE = rf"^\s*(?:[\[(<]?({_CLOCK})[\])>]?\s*(?:[-–]\s+)?)?(?:>>\s*)?(?:#+\s*)?(.*)$"
#: a label alone on its line, in bold, perhaps with the span of the turn behind it
_BOLD = rf"^\*\*([^*]+)\*\*\s*(?:({_CLOCK})\s*[-–]\s*{_CLOCK})?\s*$"
#: a label, a colon and text
_COLON = r"^(?:\*\*)?\s*(?:[Ss]peaker\s*:\s*)?([^:*]+?)\s*(?:\*\*)?\s*:\s*(?:\*\*)?\s*(.*)$"
_TITLE = r"^(?:mr|mrs|ms|dr|prof|shri|smt|sir|madam)\.?\s+"
_PAGE = r"(?i)^\s*(?:page\s+\d+(?:\s+of\s+\d+)?|p(?:g|age)?\.?\s*\d+|-\s*\d+\s*-|\[\d+\]|\d{1,4})\s*$"
_NOISES = "laugh|applause|drop|inaudible|cross ?talk|music|noise|silence|unclear|overlap|pause|cough|background|indiscernible|foreign|technical"
_ANNOTATIONS = (
    rf"(?i)\[[^\[\]\n]*\]|\{{[^{{}}\n]*\}}|<[a-z][^<>\n]*>|\([^()\n]*?(?:{_NOISES})[^()\n]*\)"
    rf"|(?<!\*)\*[a-z][a-z ]+\*(?!\*)"
)
_FILLER = r"(?i)(?<![\w'])(?:u[hm]+|er+m?|hm+|mm+|ah+|you know|i mean|sort of|like(?=\s*(?:\.\.\.|…|,)))(?![\w'])(?:\.\.\.|…|,)?"
_FILLER_ALL = r"(?i)(?<![\w'])(?:u[hm]+|er+m?|hm+|mm+|ah+|oh|you know|i mean|sort of|kind of|like)(?![\w'])"
_OPERATORS = ("operator", "moderator", "coordinator", "conference operator", "conference moderator")


def common_period(period: Column) -> Column:
    """``Qn FYyyyy`` of the many spellings of a reporting period; a month means the quarter whose
    results are presented in it (Indian fiscal year, April to March). Null if it can't be read."""
    p = F.upper(F.trim(F.regexp_replace(period, "[_\\s]+", " ")))
    span = F.regexp_extract(p, r"^Q([1-4])[- ]?(?:FY)?[- ]?(\d{4})[-–/](\d{2,4})$", 1)
    span_year = F.regexp_extract(p, r"^Q([1-4])[- ]?(?:FY)?[- ]?(\d{4})[-–/](\d{2,4})$", 2)
    q1 = F.regexp_extract(p, r"^(?:Q([1-4])|([1-4])Q)[- ]?FY[- ]?'?(\d{4}|\d{2})$", 1)
    q2 = F.regexp_extract(p, r"^(?:Q([1-4])|([1-4])Q)[- ]?FY[- ]?'?(\d{4}|\d{2})$", 2)
    qy = F.regexp_extract(p, r"^(?:Q([1-4])|([1-4])Q)[- ]?FY[- ]?'?(\d{4}|\d{2})$", 3)
    quarter = F.concat(q1, q2)
    full_year = F.when(F.length(qy) == 2, F.concat(F.lit("20"), qy)).otherwise(qy)
    mon = F.regexp_extract(p, r"^([A-Z]{3})[A-Z]*[- ,']*(\d{4})$", 1)
    mon_year = F.regexp_extract(p, r"^([A-Z]{3})[A-Z]*[- ,']*(\d{4})$", 2)
    month = F.instr(F.lit("JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC"), mon)
    index = F.floor((month - 1) / 9)  # 0: Jan-Mar presents Q3, 1: Q4, 2: Q1, 3: Q2
    by_month = F.concat(
        F.lit("Q"), F.element_at(F.array(*map(F.lit, "3412")), (index + 1).cast("int")), F.lit(" FY"),
        (mon_year.try_cast("int") + F.when(index >= 2, 1).otherwise(0)).cast("string"),
    )
    return (
        F.when(span != "", F.concat(F.lit("Q"), span, F.lit(" FY"), (span_year.try_cast("int") + 1).cast("string")))
        .when(quarter != "", F.concat(F.lit("Q"), quarter, F.lit(" FY"), full_year))
        .when((mon != "") & (month > 0) & ((month - 1) % 3 == 0), by_month)
    )


def _seconds(clock: Column) -> Column:
    parts = F.transform(F.split(clock, ":"), lambda x: x.try_cast("double"))
    return F.when(clock != "", F.aggregate(parts, F.lit(0.0), lambda a, x: a * 60 + x))


def _clean_label(label: Column) -> Column:
    """A label without titles, role, firm and order of names: lower case ``first last``."""
    x = F.regexp_replace(label, r"^\s*[Ss]peaker\s*:\s*", "")
    x = F.regexp_replace(x, r"\s*\([^)]*\)\s*$", "")
    x = F.regexp_replace(x, r"\s+[-–—]\s+.*$", "")
    x = F.regexp_replace(F.lower(F.trim(x)), _TITLE, "")
    x = F.regexp_replace(x, r"^([^,]{2,40}),\s*(.{2,40})$", "$2 $1")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def _best_speaker(label: Column, roster: Column) -> Column:
    """The roster's speaker the label names, null if none: in full, by role, by initial and surname,
    by one name alone, or within two typing errors."""

    def rank(r: Column) -> Column:
        full = F.lower(r["speaker"])
        first, last = F.substring_index(full, " ", 1), F.substring_index(full, " ", -1)
        errors = F.levenshtein(label, full, 2)
        errors = F.when(errors < 0, 99).otherwise(errors)  # beyond two
        level = (
            F.when(label == full, 0)
            .when(label.isin(*_OPERATORS) & (F.lower(r["job"]) == "operator"), 1)
            .when(label.rlike(r"^[a-z]\.? ?\S+$") & (F.length(F.regexp_replace(label, r"^([a-z])\.? .*$", "$1")) == 1)
                  & (F.substring(label, 1, 1) == F.substring(full, 1, 1)) & (F.substring_index(label, " ", -1) == last)
                  & (first != last), 2)
            .when((label == last) | (label == first), 3)
            .when((F.length(full) >= 6) & (errors <= 2), 4)
            .when((F.length(label) >= 5) & ((F.levenshtein(label, last, 1) >= 0) | (F.levenshtein(label, first, 1) >= 0)), 5)
        )
        return F.struct(level.alias("level"), errors.alias("errors"), r["speaker"].alias("speaker"))

    ranked = F.filter(F.transform(roster, rank), lambda x: x["level"].isNotNull())
    return F.array_min(ranked)["speaker"]


def strip_noise(text: Column) -> Column:
    """Text without annotations, fillers and stuttered words."""
    x = F.regexp_replace(text, _ANNOTATIONS, " ")
    x = F.regexp_replace(x, _FILLER, " ")
    x = F.regexp_replace(x, r"\s+", " ")
    x = F.regexp_replace(x, r"(?i)(?<![\w.,])([a-z]+)((?:\s+\1)+)(?![\w'])", "$1")
    return F.trim(F.regexp_replace(x, r"\s+([,.;:?!])", "$1"))


def speaker_turns(calls: DataFrame, roster: DataFrame) -> DataFrame:
    """Turns of each call: ``call_id``, ``turn`` (from 1), ``speaker`` (as in the roster), ``period``
    (``Qn FYyyyy``), ``started_s``, ``text``.

    ``calls`` needs call_id, period, text, loaded_at; ``roster`` call_id, speaker, job. Labels and times
    are extracted with SQL expressions, speakers and times are carried forward by windows, marked noise
    is removed, and runs of one speaker are folded with gaps-and-islands ids. Calls and roster are
    shuffled once, by call; every later step keeps that partitioning. The largest group is one call.

    Defined results: the newest delivery of a call_id counts; null or empty texts, calls without roster
    and text before the first known speaker give no turn; a label that names nobody in the roster is
    text; stretches of fillers or annotations only are dropped before neighbours are joined; stretches
    without a time stay with the timed stretch before them, at the start of a call with the one after;
    ties in time keep the order of the text.
    """
    newest = Window.partitionBy("call_id").orderBy(F.col("loaded_at").desc_nulls_last(), F.length("text").desc_nulls_last())
    people = roster.filter("speaker is not null").groupBy("call_id").agg(
        F.collect_set(F.struct("speaker", F.coalesce("job", F.lit("")).alias("job"))).alias("_roster")
    )
    calls = (
        calls.select("call_id", "period", "text", "loaded_at").filter("call_id is not null")
        .withColumn("_n", F.row_number().over(newest)).filter("_n = 1 and length(text) > 0")
        .join(people, "call_id")
    )
    lines = calls.select("call_id", "period", "_roster", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("_line", "_raw"))
    rest = F.regexp_extract("_raw", _LINE, 2)
    lines = lines.withColumns({"_rest": rest, "_time": F.regexp_extract("_raw", _LINE, 1)})
    lines = lines.withColumns({
        "_bold": F.regexp_extract("_rest", _BOLD, 1), "_span": F.regexp_extract("_rest", _BOLD, 2),
        "_head": F.regexp_extract("_rest", _COLON, 1), "_tail": F.regexp_extract("_rest", _COLON, 2),
    })
    lines = lines.withColumn(
        "_label", F.when(F.col("_bold") != "", _clean_label(F.regexp_replace("_bold", r"\s*:\s*$", ""))).when(F.col("_head") != "", _clean_label(F.col("_head")))
    )
    lines = lines.withColumn("_speaker", F.when(F.length("_label") >= 2, _best_speaker(F.col("_label"), F.col("_roster")))).drop("_roster")
    said = (
        F.when(F.col("_speaker").isNotNull() & (F.col("_bold") != ""), F.lit(""))
        .when(F.col("_speaker").isNotNull(), F.col("_tail"))
        .when(F.col("_raw").rlike(_PAGE), F.lit(""))
        .otherwise(F.col("_raw"))
    )
    stamp = F.when(F.col("_speaker").isNotNull(), _seconds(F.when(F.col("_time") != "", F.col("_time")).otherwise(F.col("_span"))))
    by_line = Window.partitionBy("call_id").orderBy("_line")
    lines = lines.select(
        "call_id", "period", "_line", said.alias("_said"), stamp.alias("_stamp"), "_speaker",
        F.count("_speaker").over(by_line.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_seg"),
    ).filter("_seg > 0")
    segments = lines.groupBy("call_id", "_seg").agg(
        F.first("period").alias("period"), F.max("_speaker").alias("speaker"), F.max("_stamp").alias("_stamp"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_line", "_said"))), lambda x: x["_said"]), " ").alias("_said"),
    )
    by_seg = Window.partitionBy("call_id").orderBy("_seg").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy("call_id").orderBy(F.col("_seg").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    segments = segments.withColumn("_at", F.coalesce(
        F.last("_stamp", ignorenulls=True).over(by_seg), F.last("_stamp", ignorenulls=True).over(ahead), F.lit(-1.0)
    ))
    segments = segments.withColumn("text", strip_noise(F.col("_said")))
    content = F.regexp_replace(F.col("text"), _FILLER_ALL, "")
    segments = segments.filter(content.rlike(r"[\p{L}\p{N}]"))
    spoken = Window.partitionBy("call_id").orderBy("_at", "_seg")
    before = F.lag("speaker").over(spoken)
    segments = segments.withColumn("_new", F.when(before.isNull() | (before != F.col("speaker")), 1).otherwise(0))
    segments = segments.withColumn("turn", F.sum("_new").over(spoken.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    turns = segments.groupBy("call_id", "turn").agg(
        F.first("speaker").alias("speaker"), F.first("period").alias("_period"), F.min("_stamp").alias("started_s"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_seg", "text"))), lambda x: x["text"]), " ").alias("text"),
    )
    return turns.select("call_id", F.col("turn").cast("bigint").alias("turn"), "speaker", common_period(F.col("_period")).alias("period"), "started_s", "text")
