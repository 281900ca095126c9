"""String, array and map functions of the lake."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ligatures and what they stand for, and signs wrong decodings leave most often.
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl"}
LEFTOVERS = {"â€™": "’", "â€œ": "“", "â€\x9d": "”", "â€“": "–", "â€”": "—", "â‚¹": "₹", "Â\xa0": " "}


def fiscal_label(iso: Column) -> Column:
    """``FY24`` of an ISO date text."""
    return F.when(F.length(iso) >= 4, F.concat(F.lit("FY"), F.substring(iso, 3, 2)))


def camel_words(name: Column) -> Column:
    """``ProfitLossForPeriod`` as ``Profit Loss For Period``."""
    return F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2")


def money(value: Column, per_share: Column) -> Column:
    """A figure as text: two digits for per-share values, whole crores with separators otherwise."""
    return F.when(per_share, F.format_number(value, 2)).otherwise(F.concat(F.format_number(value, 0), F.lit(" cr")))


def plain_signs(text: Column) -> Column:
    """Ligatures written out, the commonest wrong-decoding sequences, private-use and zero-width signs
    resolved."""
    out = text
    for bad, good in (LIGATURES | LEFTOVERS).items():
        out = F.replace(out, F.lit(bad), F.lit(good))
    return F.regexp_replace(out, r"[\x{e000}-\x{f8ff}\x{200b}-\x{200d}\x{feff}]", "")


def suffix_after(name: Column, mark: str = "_") -> Column:
    """The part of a file name after the last mark, without its extension."""
    return F.regexp_extract(name, rf"{mark}([^{mark}.]+)(?:\.[^.]*)?$", 1)


def headline_parts(headline: Column) -> Column:
    """(type, description) of ``Type - description``; without a separator the type is empty."""
    parts = F.split(headline, r"\s+[-–:]\s+", 2)
    two = F.size(parts) > 1
    return F.struct(F.when(two, parts[0]).otherwise("").alias("kind"), F.when(two, parts[1]).otherwise(headline).alias("description"))


def last_known(values: Column) -> Column:
    """The last element that is not null."""
    return F.try_element_at(F.filter(values, lambda x: x.isNotNull()), F.lit(-1))


def keys_with(values: Column, word: str) -> Column:
    """The part of a map whose keys hold ``word``, values that are null left out."""
    return F.map_filter(values, lambda k, v: F.lower(k).contains(word.lower()) & v.isNotNull())


def pipe_cell(text: Column, label: str) -> Column:
    """The last non-blank cell of the pipe-delimited line that starts with ``label``."""
    line = F.regexp_extract(text, rf"(?im)^\s*\|?\s*{label}\s*\|(.*)$", 1)
    cells = F.filter(F.transform(F.split(line, r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    return F.try_element_at(cells, F.lit(-1))


def context_line(symbol: Column, period: Column, section: Column) -> Column:
    """A deterministic prefix that says what a chunk is from."""
    what = F.when(section == "qa", "questions and answers").when(section == "prepared_remarks", "management remarks").when(section == "presentation", "presentation").otherwise("call")
    return F.concat(F.lit("["), F.concat_ws(" ", symbol, period, what), F.lit("]"))


def listing_key(nse: Column, bse: Column) -> Column:
    """The NSE symbol, else the BSE code as a whole number; null if there is neither."""
    return F.coalesce(F.when(F.trim(nse) != "", F.trim(nse)), F.floor(bse.try_cast("double")).cast("bigint").cast("string"))


def linked_names(html: Column) -> Column:
    """(slug, name) of every company link in a piece of mark-up."""
    slugs = F.regexp_extract_all(html, F.lit(r'href="/company/([^"/]+)'), 1)
    names = F.regexp_extract_all(html, F.lit(r'href="/company/[^"]*"[^>]*>([^<]*)<'), 1)
    return F.zip_with(slugs, names, lambda s, n: F.struct(s.alias("slug"), F.trim(n).alias("name")))


def marker_label(line: Column) -> Column:
    """A line as a marker: its first table cell without signs of heading, quote and emphasis."""
    cell = F.try_element_at(F.filter(F.split(line, r"\|"), lambda x: F.trim(x) != ""), F.lit(1))
    return F.lower(F.trim(F.regexp_replace(F.coalesce(cell, F.lit("")), r"[#>*:]+", "")))


def series_of_blob(blob: Column) -> Column:
    """Named series out of JSON in any of three shapes: a list of named series, one bare series of
    [millisecond, value] pairs, or an object of series: array of (name, pairs)."""
    pairs = "array<array<double>>"
    named = F.from_json(blob, f"array<struct<name:string,data:{pairs}>>")
    bare = F.from_json(blob, pairs)
    keyed = F.from_json(blob, f"map<string,{pairs}>")
    one = lambda name, data: F.struct(name.alias("name"), data.alias("data"))
    return (
        F.when(blob.rlike(r"^\s*\[\s*\{"), F.transform(named, lambda x: one(x["name"], x["data"])))
        .when(blob.rlike(r"^\s*\[\s*\["), F.array(one(F.lit("value"), bare)))
        .when(blob.rlike(r"^\s*\{"), F.transform(F.map_entries(keyed), lambda e: one(e["key"], e["value"])))
    )
