"""Tables and fields out of fetched pages, spreadsheets, chart series and filing documents."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class _Tables(HTMLParser):
    """All tables of a page as rows of cell texts, with the id of the nearest element that has one."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[tuple[str | None, list[list[str]]]] = []
        self.open: list[tuple[str | None, list[list[str]]]] = []
        self.near: str | None = None
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        named = dict(attrs).get("id")
        if named:
            self.near = named
        if tag == "table":
            self.open.append((named or self.near, []))
        elif tag == "tr" and self.open:
            self.open[-1][1].append([])
        elif tag in ("td", "th") and self.open:
            if not self.open[-1][1]:
                self.open[-1][1].append([])
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.open and self.cell is not None:
            self.open[-1][1][-1].append(re.sub(r"\s+", " ", "".join(self.cell)).strip())
            self.cell = None
        elif tag == "table" and self.open:
            self.tables.append(self.open.pop())

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def html_tables(html: str) -> list[tuple[str | None, list[list[str]]]]:
    parser = _Tables()
    parser.feed(html)
    parser.close()
    return parser.tables


def page_tables(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, section (id), row, cells: every table row of every page. Pages with broken or no mark-up give
    what can be read."""
    types = dict(pages.dtypes)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, section, i, cells) for k, page in zip(frame["_k"], frame["_h"]) for section, table in html_tables(page) for i, cells in enumerate(table)]
            yield pd.DataFrame(rows, columns=[key, "section", "row", "cells"])

    base = pages.select(F.col(key).alias("_k"), F.col(html).alias("_h")).filter("length(_h) > 0")
    return base.mapInPandas(read, f"`{key}` {types[key]}, section string, row int, cells array<string>")


def statement_matrix(rows: DataFrame, key: str) -> DataFrame:
    """Statement matrices (columns, rows as maps with the label under ``metric``) from table rows: the
    first row of a section holds the periods."""
    head = rows.filter("row = 0").select(key, "section", F.slice("cells", 2, 1000).alias("columns"))
    body = rows.filter("row > 0 and size(cells) > 0").join(head, [key, "section"])
    n = F.least(F.size("columns"), F.size("cells") - 1)
    line = F.map_concat(
        F.create_map(F.lit("metric"), F.col("cells")[0]),
        F.map_from_arrays(F.slice("columns", F.lit(1), n), F.slice("cells", F.lit(2), n)),
    )
    return body.groupBy(key, "section", "columns").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", F.to_json(line).alias("j")))), lambda x: F.from_json(x["j"], "map<string,string>")).alias("rows"))


def split_trailing_value(text: Column) -> Column:
    """``Name 1,234 %`` as (name, value)."""
    pattern = r"^(.+?)\s+(-?[\d,.]+\s*%?.*?)$"
    return F.struct(F.regexp_extract(text, pattern, 1).alias("name"), F.regexp_extract(text, pattern, 2).alias("value"))


def unpivot_sheet(sheet: DataFrame, label: str) -> DataFrame:
    """A wide sheet (one column per date) as label, column, value; empty cells are left out."""
    values = [c for c in sheet.columns if c != label]
    long = sheet.select(label, *[F.col(f"`{c}`").cast("string").alias(c) for c in values]).unpivot([label], values, "column", "value")
    return long.filter("value is not null and trim(value) <> ''")


def epoch_series(pairs: Column) -> Column:
    """Pairs of epoch milliseconds and value as (d, v), without those that lack either."""
    points = F.transform(pairs, lambda p: F.struct(F.date_from_unix_date(F.floor(p[0] / 86_400_000).cast("int")).alias("d"), p[1].alias("v")))
    return F.filter(points, lambda x: x["d"].isNotNull() & x["v"].isNotNull())


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def filing_facts(xml: str) -> list[tuple[str, str | None, str | None, str | None, str, str]]:
    """(context, start, end or instant, member, tag, text) of every fact of an instance document."""
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        return []
    contexts = {}
    for c in root:
        if _local(c.tag) == "context":
            parts = {_local(e.tag): (e.text or "").strip() for e in c.iter()}
            contexts[c.get("id")] = (parts.get("startDate"), parts.get("endDate") or parts.get("instant"), parts.get("explicitMember"))
    out = []
    for f in root:
        ref = f.get("contextRef")
        if ref and f.text and f.text.strip():
            out.append((ref, *contexts.get(ref, (None, None, None)), _local(f.tag), f.text.strip()))
    return out


def instance_facts(files: DataFrame, key: str, xml: str) -> DataFrame:
    """key, context, start, end, member, tag, text of filing documents; unreadable ones give nothing."""
    types = dict(files.dtypes)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, *fact) for k, x in zip(frame["_k"], frame["_x"]) for fact in filing_facts(x)]
            yield pd.DataFrame(rows, columns=[key, "context", "start", "end", "member", "tag", "text"])

    base = files.select(F.col(key).alias("_k"), F.col(xml).alias("_x")).filter("length(_x) > 0")
    return base.mapInPandas(read, f"`{key}` {types[key]}, context string, start string, end string, member string, tag string, text string")


def main_context(facts: DataFrame, key: str) -> DataFrame:
    """Facts of each document's main context: the one without members that has the most facts."""
    n = facts.filter("member is null").groupBy(key, "context").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy(key).agg(F.max_by("context", F.struct("n", "context")).alias("context"))
    return facts.join(best, [key, "context"], "left_semi")


def scaled(text: Column, kind: Column) -> Column:
    """A filing number: money in crores to two digits, anything else to four."""
    x = F.regexp_replace(text, ",", "").try_cast("double")
    return F.when(kind == "money", F.round(x / 1e7, 2)).otherwise(F.round(x, 4))
