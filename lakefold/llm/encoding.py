"""Find and repair texts that were decoded with the wrong character encoding."""

from __future__ import annotations

import heapq
import html
import re
import unicodedata
from collections import OrderedDict
from collections.abc import Iterator
from itertools import pairwise

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encodings a text may have been read with by mistake. cp1252 is the forgiving kind that passes its
#: five undefined bytes through, as most decoders do.
WRONG = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "koi8-r")
#: Encodings it may have been written in. Those after cp1252 hold whole words of other scripts and are only tried on
#: texts with a run of foreign letters, read with one of the first two of ``WRONG``.
RIGHT = ("utf-8", "cp1252")
RIGHT_WORDS = ("cp1251", "koi8-r", "gbk", "shift_jis", "iso8859-7")
_UNDEFINED = {0x81, 0x8D, 0x8F, 0x90, 0x9D}

#: Letters outside ASCII in a row, as no Latin orthography writes them.
_FOREIGN_RUN = re.compile(r"[\u0080-\u024f]{4,}")
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")
_SPACE = re.compile(r"[ \t\n\r]+")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")
_LETTER_SCRIPTS = ("LATIN", "GREEK", "CYRILLIC", "DEVANAGARI", "ARABIC", "HEBREW", "CJK", "HIRAGANA", "KATAKANA", "HANGUL", "TAMIL", "BENGALI", "TELUGU", "GUJARATI", "GURMUKHI", "KANNADA", "MALAYALAM")


#: cp1252 as a table over latin-1, its undefined bytes standing for themselves.
_CP1252 = {b: bytes((b,)).decode("cp1252") for b in range(0x80, 0xA0) if b not in _UNDEFINED}
_CP1252_BACK = {ord(c): b for b, c in _CP1252.items()} | {b: 0xFFFF for b in _CP1252}


def _encode(text: str, codec: str) -> bytes | None:
    try:
        return text.translate(_CP1252_BACK).encode("latin-1") if codec == "cp1252" else text.encode(codec)
    except UnicodeEncodeError:
        return None


def _decode(raw: bytes, codec: str) -> str | None:
    try:
        return raw.decode("latin-1").translate(_CP1252) if codec == "cp1252" else raw.decode(codec)
    except UnicodeDecodeError:
        return None


def _script(ch: str) -> str | None:
    name = unicodedata.name(ch, "")
    return next((s for s in _LETTER_SCRIPTS if name.startswith(s)), None)


def plausibility_cost(text: str) -> float:
    """How unlike written text the characters are; 0 for plain ASCII.

    Every non-ASCII character costs a little, so of two readings the shorter one in characters wins;
    characters no writer types (controls, replacement and private-use characters, box drawing) cost
    more, and so do a word that mixes scripts, a capital after a small letter, and a run of accented Latin
    letters with no plain one.
    """
    cost = 8.0 * len(_CONTROL.findall(text))
    for word in _SPACE.split(text):
        if word.isascii():  # costs nothing
            continue
        cost += sum(2.0 * max(0, sum(map(str.isalpha, run)) - 3) for run in _FOREIGN_RUN.findall(word))
        cost += 1.5 * sum(a.islower() and b.isupper() for a, b in pairwise(word))
        scripts: set[str] = set()
        for ch in word:
            code, script = ord(ch), None
            if code < 0x80:
                script = "LATIN" if ch.isalpha() else None
            else:
                kind = unicodedata.category(ch)
                cost += 1
                if code == 0xFFFD:
                    cost += 3
                elif kind in ("Cc", "Co", "Cn", "Cs"):
                    cost += 8
                elif 0x2500 <= code <= 0x25FF:
                    cost += 4
                script = _script(ch) if kind[0] in "LM" else None
                if script == "CJK" and not 0xB0 <= ch.encode("gbk", "replace")[0] <= 0xD7:  # outside the common plane of the code
                    cost += 2
                if kind[0] in "LM" and script is None:
                    continue
            if script is None:
                scripts.clear()
            elif script not in scripts:
                cost += 6 if scripts else 0
                scripts.add(script)
    return cost


def _partly(raw: bytes) -> str | None:
    """UTF-8 of which bytes were lost: every lost place becomes one replacement character. Only taken if at
    least as many characters of several bytes come out whole."""
    got = raw.decode("utf-8", "replace")
    lost = got.count("\ufffd")
    whole = sum(ord(c) > 0x7F for c in got) - lost
    return got if lost and whole >= lost else None


def _steps(text: str, changed: bool) -> Iterator[tuple[str, float, bool]]:
    """The texts one operation away, the operation's own price, and whether a change between encodings that
    never fail has been made. A strict UTF-8 decoding of non-ASCII bytes is strong evidence and cheap, one
    with lost bytes less so; a change between other encodings hardly ever fails, has to save much to pay,
    and is made once at most."""
    words = _FOREIGN_RUN.search(text) is not None
    for wrong in WRONG:
        raw = _encode(text, wrong)
        if raw is None:
            raw = _encode(text.replace("\ufffd", "ÿ"), wrong) if "\ufffd" in text and wrong in WRONG[:2] else None
            got = _partly(raw) if raw else None
            if got is not None and got != text:
                yield got, 1.0, changed
            continue
        if raw.isascii():
            continue
        got = _decode(raw, "utf-8")
        if got is None:
            got, price = _partly(raw), 1.0
        else:
            price = 0.25
        if got is not None and got != text:
            yield got, price, changed
        if changed:
            continue
        for right in (*RIGHT[1:], *(RIGHT_WORDS if words and wrong in WRONG[:2] else ())):
            got = _decode(raw, right) if right != wrong else None
            if got is not None and got != text:
                yield got, 3.0, True
    if "&" in text:
        got = html.unescape(text)
        if got != text:
            yield got, 0.25, changed
    if "\\u" in text:
        got = _ESCAPE.sub(lambda m: chr(int(m[1], 16)), text)
        if got != text:
            yield got, 0.25, changed


def repair(text: str) -> tuple[bool, str]:
    """(damaged, best text). Best-first search over encode-decode and unescape operations: states are
    texts, visited ones are hashed, the queue is ordered by plausibility cost plus the price of the way.
    The cheapest text reached is the answer. The search ends when every way left costs more than the best
    text does; it always ends, since UTF-8 readings and unescapes shorten the text and other changes are
    made once. Damaged: a cheaper text was reached, or the cheapest still holds replacement characters or
    C1 controls, which no correct text does."""
    start = plausibility_cost(text)
    best, best_cost, visited = text, start, {(text, False)}
    queue: list[tuple[float, int, float, str, bool]] = [(start, 0, 0.0, text, False)]
    count = 0
    while queue:
        _, _, price, now, changed = heapq.heappop(queue)
        for nxt, step, after in _steps(now, changed):
            way = price + step
            if (nxt, after) in visited or way >= best_cost:  # no text costs less than nothing
                continue
            visited.add((nxt, after))
            count += 1
            cost = plausibility_cost(nxt)
            if cost + way < best_cost - 0.01:
                best, best_cost = nxt, cost + way
            heapq.heappush(queue, (cost + way, count, way, nxt, after))
    stuck = any(ch == "�" or 0x80 <= ord(ch) < 0xA0 for ch in best)
    # a bare unescape of one entity is a repair, not a wrong encoding
    damaged = best != text and best != html.unescape(text) or stuck
    return damaged, best


class _Memo(OrderedDict):
    """Bounded memory of results: labels repeat across records."""

    def __init__(self, most: int = 20_000):
        super().__init__()
        self.most = most

    def get_or(self, text: str) -> tuple[bool, str]:
        hit = self.get(text)
        if hit is None:
            hit = self[text] = repair(text)
            if len(self) > self.most:
                self.popitem(last=False)
        return hit


def repair_encoding(rows: DataFrame, key: str, texts: str) -> DataFrame:
    """Damaged texts of ``rows``: ``key``, ``original``, ``restored``, ``restorable``.

    ``texts`` is a string column or an array of strings. A JVM filter keeps only rows with a
    non-ASCII character or an escape; those go through Arrow once, without a shuffle. Defined results:
    null or empty texts and null elements are never damaged; repeated rows repeat their result; an
    unrestorable text comes out as far as it could be restored, with ``restorable`` false; extra columns
    are not carried.
    """
    dtype = dict(rows.dtypes)[texts]
    base = rows.select(F.col(key), F.col(texts).alias("_text"))
    if dtype.startswith("array"):
        base = base.select(key, F.explode("_text").alias("_text"))
    base = base.filter(F.col("_text").rlike(r"[^\x20-\x7e\s]|&[#A-Za-z]\w{1,30};|\\u[0-9a-fA-F]{4}"))
    schema = f"`{key}` {dict(rows.dtypes)[key]}, original string, restored string, restorable boolean"

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = _Memo()
        for frame in frames:
            found = [(k, t, *memo.get_or(t)) for k, t in zip(frame[key], frame["_text"])]
            found = [(k, t, best) for k, t, damaged, best in found if damaged]
            yield pd.DataFrame({  # typed also where nothing was found
                key: pd.Series([k for k, _, _ in found], dtype=frame[key].dtype),
                "original": pd.Series([t for _, t, _ in found], dtype=object),
                "restored": pd.Series([b for _, _, b in found], dtype=object),
                "restorable": pd.Series([not any(c == "�" or 0x80 <= ord(c) < 0xA0 for c in b) for _, _, b in found], dtype=bool),
            })

    return base.mapInPandas(search, schema)
