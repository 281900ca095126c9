"""Find documents that hold passages of held-out test items, with a positional inverted index."""

from __future__ import annotations

import html
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakefold.session import arrow_rows, stored

_TAG = re.compile(r"<[A-Za-z/!?][^<>]*>")
_WORD = re.compile(r"[^\W_]+")
#: Segments of the index that are read at a time.
_SEGMENTS = 16
_DROPPED = dict.fromkeys(map(ord, "­​‌‍﻿"))


def words(text: str) -> list[str]:
    """Lower-case words; case, punctuation, spacing, line breaks and mark-up don't count."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = text.translate(_DROPPED)
    return _WORD.findall(text.lower())


def sure_run(window: int, span: int) -> int:
    """The longest run of unchanged words that every passage of ``window`` words with at most one
    changed word in any ``span`` must hold."""
    best = window
    for first in range(window):
        changed = range(first, window, span)
        gaps = [first, *([span - 1] * (len(changed) - 1)), window - changed[-1] - 1]
        best = min(best, max(gaps))
    return best


def term_hash(word: str) -> int:
    """The number a word has in index and items: 64 bits, signed."""
    h = xxhash.xxh3_64_intdigest(word)
    return h - 2**64 if h >= 2**63 else h


def _lists(values: np.ndarray, ends: list[int], kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def build_index(docs: DataFrame, doc_id: str, text: str, segment_docs: int = 256, segment_chars: int = 1_000_000) -> DataFrame:
    """The positional inverted index of all words of ``docs``, in segments.

    One row per segment of up to ``segment_docs`` documents and, unless it is a single one, ``segment_chars`` characters:
    ``docs`` (ids), ``sizes`` (words of each), ``terms`` (sorted word hashes), ``starts`` (where each term's list begins),
    ``owners`` (index into docs) and ``places`` (word position). No shuffle: a document lies in one segment as a whole.
    """
    id_type = dict(docs.dtypes)[doc_id]
    base = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).filter("_id is not null and length(_text) > 0")

    def segment(part: pa.RecordBatch) -> pa.RecordBatch:
        ids: dict[str, int] = {}
        numbers, size = array("i"), np.zeros(part.num_rows, dtype=np.int32)
        for i, body in enumerate(part.column(1)):
            found = words(body.as_py())
            size[i] = len(found)
            numbers.extend([ids.setdefault(w, len(ids)) for w in found])
        hashes = np.fromiter((term_hash(w) for w in ids), dtype=np.int64, count=len(ids))
        terms, rank = np.unique(hashes, return_inverse=True)
        number = rank[np.frombuffer(numbers, dtype=np.int32)] if numbers else np.zeros(0, dtype=np.int64)
        order = np.argsort(number, kind="stable")
        owners = np.repeat(np.arange(len(size), dtype=np.int32), size)
        places = np.arange(len(number), dtype=np.int32) - np.repeat(np.cumsum(size) - size, size).astype(np.int32)
        starts = np.searchsorted(number[order], np.arange(len(terms)))
        lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))]
        lists += [_lists(v, [0, len(v)], t) for v, t in ((size, pa.int32()), (terms, pa.int64()), (starts, pa.int32()), (owners[order], pa.int32()), (places[order], pa.int32()))]
        return pa.RecordBatch.from_arrays(lists, ["docs", "sizes", "terms", "starts", "owners", "places"])

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # one segment's texts at a time become Python strings
            lo = chars = 0
            for hi, n in enumerate(pc.utf8_length(batch.column(1)).to_pylist()):
                if hi > lo and (hi - lo == segment_docs or chars + n > segment_chars):
                    yield segment(batch.slice(lo, hi - lo))
                    lo, chars = hi, 0
                chars += n
            if lo < batch.num_rows:
                yield segment(batch.slice(lo))

    schema = f"docs array<{id_type}>, sizes array<int>, terms array<bigint>, starts array<int>, owners array<int>, places array<int>"
    return base.mapInArrow(segments, schema)


def _longest(ok: np.ndarray, span: int) -> tuple[int, int]:
    """(start, length) of the longest stretch that begins and ends on a True and in which no two False are
    closer than ``span``; (0, 0) if there is none."""
    best, start, last_bad = (0, 0), 0, -span
    for at in [*np.flatnonzero(~ok).tolist(), len(ok)]:
        if at == len(ok) or at - last_bad < span and last_bad >= start:
            first, end = start, at
            while first < end and not ok[first]:
                first += 1
            while end > first and not ok[end - 1]:
                end -= 1
            if end - first > best[1]:
                best = (first, end - first)
            start = last_bad + 1
        last_bad = at
    return best


class _Matcher:
    """The compiled test items: words by number, and for every run of ``run`` words its ``need``
    rarest ones. A passage that counts holds such a run unchanged, hence all ``need`` of them on one
    diagonal (document position minus item position)."""

    def __init__(self, items: list[tuple[object, list[int]]], counts: dict[int, int], window: int, span: int, need: int = 3):
        run = sure_run(window, span)
        need = min(need, run)
        self.items, self.window, self.span, self.need = [(i, np.asarray(t, dtype=np.int64)) for i, t in items], window, span, need
        self.most = max((len(t) for _, t in items), default=0)
        anchors: dict[int, list[tuple[int, int]]] = {}
        for number, (_, terms) in enumerate(items):
            keys = [(counts.get(t, 0), i) for i, t in enumerate(terms)]
            chosen: set[int] = set()
            for lo in range(len(terms) - run + 1):
                rare = sorted(keys[lo : lo + run])[:need]
                if rare[0][0]:  # a run with a word the corpus never uses matches nowhere
                    chosen.update(i for _, i in rare)
            for i in chosen:
                anchors.setdefault(terms[i], []).append((number, i))
        self.terms = np.asarray(sorted(anchors), dtype=np.int64)
        self.where = [np.asarray(anchors[t], dtype=np.int64) for t in self.terms.tolist()]

    def match(self, row: dict, most: int = 4_000_000) -> Iterator[tuple]:
        terms = np.asarray(row["terms"], dtype=np.int64)
        common, here, there = np.intersect1d(terms, self.terms, assume_unique=True, return_indices=True)
        if not len(common):
            return
        sizes, owners = np.asarray(row["sizes"], dtype=np.int64), np.asarray(row["owners"], dtype=np.int64)
        starts = np.append(np.asarray(row["starts"], dtype=np.int64), len(owners))
        places = np.asarray(row["places"], dtype=np.int64)
        begins = np.cumsum(sizes) - sizes
        flat: np.ndarray | None = None  # the words of the segment in reading order, once something is to be checked
        # offset-adjusted lists, in blocks of items so that memory stays bounded
        total = sum(int(starts[a + 1] - starts[a]) * len(self.where[b]) for a, b in zip(here, there))
        blocks = max(1, -(-total // most))
        width = int(sizes.max()) + self.most + 1
        for block in range(blocks):
            keys = []
            for a, b in zip(here, there):
                w = self.where[b]
                if blocks > 1:
                    w = w[w[:, 0] % blocks == block]
                lo, hi = starts[a], starts[a + 1]
                diagonal = places[lo:hi, None] - w[None, :, 1] + self.most
                keys.append(((owners[lo:hi, None] * len(self.items) + w[None, :, 0]) * width + diagonal).ravel())
            key = np.concatenate(keys)
            keys.clear()
            key.sort()
            key = np.unique(key[self.need - 1 :][key[self.need - 1 :] == key[: len(key) - self.need + 1]])
            if not len(key):
                continue
            if flat is None:
                flat = np.empty(len(owners), dtype=np.int64)
                flat[begins[owners] + places] = np.repeat(terms, np.diff(starts))
            best: dict[tuple[int, int], tuple] = {}
            pairs = key // width
            for owner, item, diagonal in zip((pairs // len(self.items)).tolist(), (pairs % len(self.items)).tolist(), (key % width - self.most).tolist()):
                wanted = self.items[item][1]
                lo, hi = max(0, -diagonal), min(len(wanted), int(sizes[owner]) - diagonal)  # the part inside the document
                at = int(begins[owner]) + diagonal
                ok = flat[at + lo : at + hi] == wanted[lo:hi]
                start, length = _longest(ok, self.span)
                if length >= self.window and length > best.get((owner, item), (0,))[0]:
                    best[owner, item] = (length, lo + start, int(length - ok[start : start + length].sum()), diagonal + lo + start)
            for (owner, item), (length, start, changed, at) in best.items():
                yield row["docs"][owner], self.items[item][0], length, start + 1, at + 1, changed


def leaked_passages(
    docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, doc_text: str = "text", item_text: str = "text",
    window: int = 20, span: int = 10, items_per_pass: int = 50_000, chars_per_pass: int = 50_000_000,
) -> DataFrame:
    """Leaks: ``item_id``, ``doc_id``, ``n_words`` (the longest shared passage), ``item_word`` and
    ``doc_word`` (where it begins, from 1), ``changed`` (words that differ), ``kind`` (``exact`` or
    ``proximity``). A leak is a passage of at least ``window`` consecutive words of the item that lie in the
    document in their order, with at most one changed word in any ``span``; a passage begins and ends
    with words that agree.

    The postings of all words of all documents are stored once, in segments, under the shared folder, and
    serve every pass. Term counts over all documents name the rarest words of every stretch that a leak
    must hold unchanged; their offset-adjusted lists are intersected per segment, and what coincides on a
    diagonal is checked word by word. Nothing is shuffled but term counts and the final rows. The items are read
    to the driver in passes of about ``items_per_pass`` rows and ``chars_per_pass`` characters, so what is
    broadcast is bounded. Words are compared by 64-bit hashes.

    Defined results: null ids and null or empty texts match nothing; items shorter than ``window``
    words can't leak; repeated rows give one result per distinct pair; other columns are ignored.
    """
    spark, parts = docs.sparkSession, []
    clean = items.select(F.col(item_id).alias("_item"), F.col(item_text).alias("_text")).filter("_item is not null and length(_text) > 0").distinct()
    size = clean.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("_text")), F.lit(0)).alias("c")).first()
    passes = max(-(-size["n"] // items_per_pass), -(-size["c"] // chars_per_pass))
    clean = clean.withColumn("_pass", F.pmod(F.xxhash64("_item", "_text"), F.lit(max(1, passes))))
    id_types = dict(docs.dtypes)[doc_id], dict(items.dtypes)[item_id]
    schema = f"`{doc_id}` {id_types[0]}, `{item_id}` {id_types[1]}, n_words int, item_word int, doc_word int, changed int"
    # few segments to a row group and to an Arrow batch: neither the JVM nor Python holds more at a time, at any size of the table
    with arrow_rows(spark, 1_024):
        index = stored(build_index(docs, doc_id, doc_text), "postings", **{"parquet.block.row.count.limit": _SEGMENTS}) if passes else None
    for number in range(passes):
        held = [(r["_item"], [term_hash(w) for w in words(r["_text"])]) for r in clean.filter(F.col("_pass") == number).collect()]
        held = [(i, w) for i, w in held if len(w) >= window]
        if not held:
            continue
        wanted = spark.sparkContext.broadcast(np.unique(np.concatenate([w for _, w in held])))

        def count(frames: Iterator[pd.DataFrame], wanted=wanted) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for row in frame.to_dict("records"):
                    terms = np.asarray(row["terms"], dtype=np.int64)
                    held = np.diff(np.append(np.asarray(row["starts"], dtype=np.int64), row["n"]))
                    common, at, _ = np.intersect1d(terms, wanted.value, assume_unique=True, return_indices=True)
                    yield pd.DataFrame({"term": common, "n": held[at]})

        lists = index.select("terms", "starts", F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n")).mapInPandas(count, "term bigint, n bigint")
        with arrow_rows(spark, _SEGMENTS):
            counts = {r["term"]: r["n"] for r in lists.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # at most one row per term of the pass
        matcher = spark.sparkContext.broadcast(_Matcher(held, counts, window, span))

        def search(frames: Iterator[pd.DataFrame], matcher=matcher) -> Iterator[pd.DataFrame]:
            for frame in frames:
                found = [m for row in frame.to_dict("records") for m in matcher.value.match(row)]
                if found:
                    yield pd.DataFrame(found, columns=[doc_id, item_id, "n_words", "item_word", "doc_word", "changed"])

        with arrow_rows(spark, _SEGMENTS):
            parts.append(stored(index.mapInPandas(search, schema), "leaks"))
    if not parts:
        return spark.createDataFrame([], schema).withColumn("kind", F.lit("exact")).limit(0)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    longest = Window.partitionBy(item_id, doc_id).orderBy(F.col("n_words").desc(), "doc_word", "item_word")
    out = out.withColumn("_n", F.row_number().over(longest)).filter("_n = 1").drop("_n")
    return out.withColumn("kind", F.when(F.col("changed") == 0, "exact").otherwise("proximity"))
