"""Cut oversized texts into overlapping pieces at natural boundaries."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakefold.functions.tokens import shipped, token_size

#: Boundary classes, strongest first: what a piece should rather end after.
BOUNDARIES = (
    re.compile(r"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)\s*"),  # blank line
    re.compile(r"(?:\r\n|\r|\n)(?=[ \t]*(?:#|[-*•]|\*\*|Slide\b|\d+[.)]))"),  # before a heading or list item
    re.compile(r"[.!?।॥][\"'”’)\]]*\s+"),  # sentence end
    re.compile(r"(?:\r\n|\r|\n)"),  # line end
    re.compile(r"[;:,–—]\s+"),  # clause end
    re.compile(r"\s+"),  # word end
)


def _last_cut(cuts: list[int], above: int, upto: int) -> int | None:
    """The largest cut in (above, upto], by binary search."""
    i = bisect_right(cuts, upto)
    return cuts[i - 1] if i and cuts[i - 1] > above else None


_TOKEN = re.compile(r"\s*\S+|\s+")


def split_text(text: str, limit: int, overlap: int, size: Callable[[str], int] = len, fill: float = 0.5) -> list[tuple[int, int]]:
    """(start, end) offsets of consecutive pieces of ``text``, each of size at most ``limit``.

    ``size`` measures a token (a word with the space before it) or a part of one: characters by default, or
    tokens of a tokenizer. Token offsets and prefix sums over their sizes turn "how far does the limit reach"
    into one binary search, and sorted boundary arrays turn "which natural cut is last" into another. A
    boundary class is used when it leaves the piece at least ``fill`` full; with none the cut is hard,
    but never inside a combining sequence. Each piece starts at most ``overlap`` before the end of the
    one before, at a word start where there is one.
    """
    if limit <= 0 or not 0 <= overlap < limit:
        raise ValueError("limit must be positive and overlap smaller than limit")
    n = len(text)
    ends = [m.end() for m in _TOKEN.finditer(text)]  # token offsets
    begins = [0, *ends[:-1]]
    sums = [0, *ends] if size is len else list(accumulate((size(text[a:b]) for a, b in zip(begins, ends)), initial=0))
    if sums[-1] <= limit:
        return [(0, n)] if n else []

    def most(low: int, high: int, fits: Callable[[int], bool]) -> int:
        """The largest value in [low, high] that fits; ``low`` if none does."""
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if fits(mid) else (low, mid - 1)
        return low

    def reach(start: int) -> int:
        """The furthest end such that the piece from ``start`` keeps the limit."""
        i = bisect_right(ends, start)  # token that holds start
        part = size(text[start : ends[i]])
        if part > limit:  # one token alone is too large: cut inside it
            return start + limit if size is len else most(start + 1, ends[i], lambda e: size(text[start:e]) <= limit)
        j = bisect_right(sums, sums[i + 1] + limit - part) - 1
        if size is len:  # a character is a token of its own
            return min(n, start + limit)
        return ends[j - 1]

    def back(end: int, start: int) -> int:
        """Where the next piece may start: at most ``overlap`` before ``end``."""
        i = bisect_left(ends, end)  # token that holds the end
        upto = sums[i] + size(text[begins[i] : end])
        j = bisect_left(sums, upto - overlap)
        low = begins[j] if j < len(begins) else n
        if low >= end or size is len:  # inside the token
            low = end - overlap if size is len else end - most(0, end - begins[i], lambda k: size(text[end - k : end]) <= overlap)
        return max(start + 1, min(end, low))

    cuts = [[m.end() for m in pattern.finditer(text)] for pattern in BOUNDARIES]
    pieces, start = [], 0
    while True:
        end = reach(start)
        if pieces and end <= pieces[-1][1]:  # what is repeated leaves no room for the next token
            start = pieces[-1][1]
            end = reach(start)
        if end >= n:
            pieces.append((start, n))
            return pieces
        floor = max(start + int((end - start) * fill), pieces[-1][1] if pieces else start)
        cut = next((c for c in (_last_cut(k, floor, end) for k in cuts) if c), None)
        if cut is None:
            cut = _last_cut(cuts[-1], pieces[-1][1] if pieces else start, end)
        if cut is None:
            cut = end
            while cut > start + 1 and (unicodedata.combining(text[cut]) or unicodedata.category(text[cut]) in ("Mn", "Mc") or text[cut] == "‍"):
                cut -= 1
            if pieces and cut <= pieces[-1][1]:
                cut = end
        pieces.append((start, cut))
        low = back(cut, start) if overlap else cut
        i = bisect_left(cuts[-1], low)
        start = cuts[-1][i] if i < len(cuts[-1]) and cuts[-1][i] < cut else low
        while size is not len and start < cut and size(text[start:cut]) > overlap:  # a word alone may be more tokens than after a space
            i += 1
            start = cuts[-1][i] if i < len(cuts[-1]) and cuts[-1][i] < cut else cut


def split_oversized(
    docs: DataFrame, keys: list[str], text: str, limit: int = 3200, overlap: int = 280, tokenizer: str | None = None
) -> DataFrame:
    """Pieces of the texts larger than ``limit``: ``keys``, ``piece`` (from 1), ``n_pieces``, ``start_pos`` (1-based),
    ``n_chars``, ``size``, ``piece_text``. Texts within the limit come out as one piece. Sizes are characters,
    or, with the path of a ``tokenizer``, its tokens.

    One narrow pass, no shuffle: texts that are surely short (a token has a byte at least) never leave the JVM
    when characters count, the others go to Arrow workers with only their keys. Defined results: null and
    empty texts give no piece; repeated rows give their pieces once per row; null keys are kept; other
    columns are not carried.
    """
    base = docs.select(*keys, F.col(text).alias("_text")).filter(F.length("_text") > 0)
    types = dict(base.dtypes)
    names = [*keys, "piece", "n_pieces", "start_pos", "n_chars", "size", "piece_text"]
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", piece int, n_pieces int, start_pos bigint, n_chars int, size int, piece_text string"
    file = shipped(docs.sparkSession, tokenizer) if tokenizer else None

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = token_size(file()) if file else len
        for frame in frames:
            out: dict[str, list] = {k: [] for k in names}
            for row in frame.to_dict("records"):
                body = row["_text"]
                spans = split_text(body, limit, overlap, size)
                for i, (a, b) in enumerate(spans):
                    for k in keys:
                        out[k].append(row[k])
                    for k, v in zip(names[len(keys) :], (i + 1, len(spans), a + 1, b - a, b - a if file is None else size(body[a:b]), body[a:b])):
                        out[k].append(v)
            if out["piece"]:
                yield pd.DataFrame(out)

    if tokenizer:
        return base.mapInPandas(cut, schema)
    short = base.filter(F.length("_text") <= limit).select(
        *keys, F.lit(1).alias("piece"), F.lit(1).alias("n_pieces"), F.lit(1).cast("bigint").alias("start_pos"),
        F.length("_text").alias("n_chars"), F.length("_text").alias("size"), F.col("_text").alias("piece_text"),
    )
    return short.unionByName(base.filter(F.length("_text") > limit).mapInPandas(cut, schema))
