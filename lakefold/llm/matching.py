"""Match records of two tables that describe the same things but share no identifier."""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import combinations, product

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakefold.session import stored

#: Words that say nothing about which company it is.
_STOP = frozenset({"limited", "ltd", "the", "co", "company", "india", "pvt", "private", "and", "of", "corp", "corporation", "plc", "inc"})
_BITS, _BAND = 256, 4
_BANDS = _BITS // _BAND


def grams(text: str) -> set[str]:
    """The pairs of neighbouring letters without regard to their order, so that a swap of neighbours
    changes as little as any other typing error: at most two pairs on either side."""
    padded = f"^{text}$"
    return {"".join(sorted(padded[i : i + 2])) for i in range(len(padded) - 1)} if text else set()


def vector(text: str) -> list[int]:
    """The fixed bit vector of a text's q-grams, as four signed 64-bit words."""
    bits = 0
    for gram in grams(text):
        bits |= 1 << (zlib.crc32(gram.encode()) % _BITS)
    parts = [(bits >> (64 * i)) & (2**64 - 1) for i in range(_BITS // 64)]
    return [p - 2**64 if p >= 2**63 else p for p in parts]


def bands(words: list[int]) -> list[int]:
    """The non-empty bands of a vector, each as band number and content: at most ``_BANDS << _BAND`` kinds."""
    out = []
    for w, word in enumerate(words):
        for i in range(64 // _BAND):
            value = (word >> (_BAND * i)) & (2**_BAND - 1)
            if value:
                out.append(((w * (64 // _BAND) + i) << _BAND) | value)
    return out


def radius(filled: int) -> int:
    """How many bits two vectors may differ in to be close, by the non-empty bands of the fuller one: two
    typing errors in longer values, one in short ones, none in two letters."""
    return 6 if filled >= 8 else 4 if filled >= 5 else 2 if filled >= 3 else 0


def band_keys(words: list[int], rank: dict[int, int], width: int) -> list[int]:
    """Multi-index keys. Two vectors that differ in at most ``r = radius(F)`` bits, ``F`` being the larger number
    of non-empty bands, differ in at most ``r`` bands and so share ``F - r`` or more. Whatever common order the
    bands are put in, they share ``c`` of the first ``r + c`` of either; a key is ``c`` of these bands. ``c`` is
    ``width``, which grows with the logarithm of the number of values, or ``F - r`` where that is less. A
    vector that may meet fuller ones gets the keys for each of their radii, so no close pair is missed at
    any length. Rare bands (``rank``) come first, which keeps the groups behind the keys small."""
    own = sorted(bands(words), key=lambda t: (rank.get(t, 0), t))
    out: set[int] = set()
    for r, c in {(radius(most), min(width, most - radius(most))) for most in range(len(own), len(own) + 7) if own and len(own) >= most - radius(most)}:
        for part in combinations(sorted(own[: r + c]), c):
            key = r * 8 + c
            for band in part:
                key = key << 10 | band  # a band's number and content take ten bits, so keys are exact
            out.add(key)
    return list(out)


def tokens(name: str | None) -> list[str]:
    return [t for t in re.findall(r"[a-z0-9]+", (name or "").lower()) if t not in _STOP]


def _near(a: str, b: str) -> bool:
    """At most one typing error apart (a swap of neighbours counts as one)."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return a == b
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (x[:2] == y[:2][::-1] and x[2:] == y[2:])


def _shortened(word: str) -> set[str]:
    """The word and all forms with one letter left out: words one error apart share one."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


class Namer:
    """Splits a company name into its own part and the words for its business, given the vocabulary of
    such words. Cut, abbreviated and misspelt business words are read as the word they stand for."""

    def __init__(self, descriptors: list[str]):
        self.descriptors = sorted(descriptors)
        self.known = set(descriptors)
        self.memo: dict[str, str | None] = {}
        self.near: dict[str, list[str]] = {}
        self.first: dict[str, list[str]] = {}
        for d in self.descriptors:
            self.first.setdefault(d[0], []).append(d)
            for k in range(4, len(d) + 1):  # the word and what is left of it when cut
                for form in _shortened(d[:k]):
                    self.near.setdefault(form, []).append(d)

    def descriptor(self, token: str) -> str | None:
        if token not in self.memo:
            self.memo[token] = self._find(token)
        return self.memo[token]

    def _find(self, t: str) -> str | None:
        if t in self.known:
            return t
        if len(t) >= 3:
            i, full = bisect_left(self.descriptors, t), []
            while i < len(self.descriptors) and self.descriptors[i].startswith(t):
                full.append(self.descriptors[i])
                i += 1
            if full:
                return min(full, key=len)
        if len(t) >= 4:
            close = sorted({d for form in _shortened(t) for d in self.near.get(form, ())})
            near = [d for d in close if len(d) >= 4 and _near(t, d)]
            if near:
                return near[0]
            cut = [d for d in close if len(t) >= 6 and len(d) > len(t) and _near(t, d[: len(t)])]
            if cut:
                return cut[0]
        if 3 <= len(t) <= 4 and sum(c in "aeiou" for c in t) <= 1:
            for d in self.first.get(t[0], ()):
                rest = iter(d)
                if len(d) > len(t) + 2 and all(c in rest for c in t):
                    return d
        return None

    def split(self, name: str | None) -> tuple[str, str]:
        """(own part, business words in alphabetical order)."""
        own, business = [], set()
        for t in tokens(name):
            d = self.descriptor(t)
            if d is None:
                own.append(t)
            else:
                business.add(d)
        return "".join(own), " ".join(sorted(business))


def _met(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join of tables that grow with the lists: always by shuffle and sort. Spark's estimates know nothing of
    compression and exploded arrays, so that it would gather such a table on the driver to broadcast it."""
    return left.join(right.hint("merge"), on, how)


def _dice(a: Column, b: Column) -> Column:
    both = sum((F.bit_count(a[i].bitwiseAND(b[i])) for i in range(_BITS // 64)), F.lit(0))
    each = sum((F.bit_count(a[i]) + F.bit_count(b[i]) for i in range(_BITS // 64)), F.lit(0))
    return F.when(each > 0, 2.0 * both / each)


def _hamming(a: Column, b: Column) -> Column:
    return sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(_BITS // 64)), F.lit(0))


def descriptor_words(names: DataFrame, column: str, least: int, heads: DataFrame | None = None, most: int = 100_000) -> list[str]:
    """Words that follow at least ``least`` different first words, one of them of ``heads`` (a column ``head``) if that
    is given: the broken end of a name follows none. They are the language's words for kinds of business and are broadcast; more than ``most`` are refused."""
    parts = names.select(F.expr(f"filter(split(lower(`{column}`), '[^a-z0-9]+'), x -> x <> '')").alias("p")).filter(F.size("p") > 1)
    tails = parts.select(F.col("p")[0].alias("head"), F.explode(F.slice("p", 2, 100)).alias("w")).filter(~F.col("w").isin(*_STOP) & (F.length("w") > 2)).distinct()
    tails = _met(tails, heads.withColumn("_in", F.lit(1)), "head", "left") if heads is not None else tails.withColumn("_in", F.lit(1))
    rows = tails.groupBy("w").agg(F.count("*").alias("n"), F.count("_in").alias("known")).filter((F.col("n") >= least) & (F.col("known") > 0)).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} business words")
    return sorted(r["w"] for r in rows)


def _prepared(rows: DataFrame, key: str, code: str, namer) -> DataFrame:
    """Distinct rows as own part, business words, code, their vectors and the other fields. Of rows that agree in
    all of these the one with the smallest key stands for all: the others could only tie with it."""
    key_type = dict(rows.dtypes)[key]
    schema = (
        f"key {key_type}, own string, business string, code string, bones string, industry string, face double, "
        "listed date, own_v array<bigint>, code_v array<bigint>, business_v array<bigint>, own_n int, code_n int"
    )

    def prepare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Namer(namer.value)
        strings = lambda values: pd.Series(list(values), dtype=object)
        for frame in frames:
            split = [reader.split(n) for n in frame["company_name"]]
            codes = [re.sub(r"[^a-z0-9]", "", c.lower()) or None if isinstance(c, str) else None for c in frame["_code"]]
            own_v, code_v = [vector(o) for o, _ in split], [vector(c or "") for c in codes]
            yield pd.DataFrame({
                "key": frame["_key"].reset_index(drop=True), "own": strings(o for o, _ in split), "business": strings(b for _, b in split), "code": strings(codes),
                "bones": strings(re.sub(r"[aeiou]", "", o) for o, _ in split), "industry": strings(frame["industry"]),
                "face": frame["face_value"].astype("float64").reset_index(drop=True), "listed": frame["listed_on"].reset_index(drop=True),
                "own_v": strings(own_v), "code_v": strings(code_v), "business_v": strings(vector(b) for _, b in split),
                "own_n": pd.Series([len(bands(v)) for v in own_v], dtype="int32"), "code_n": pd.Series([len(bands(v)) for v in code_v], dtype="int32"),
            })

    picked = rows.select(F.col(key).alias("_key"), "company_name", F.col(code).alias("_code"), "industry", "face_value", "listed_on")
    made = picked.filter("_key is not null and company_name is not null").distinct().mapInPandas(prepare, schema)
    fields = ["own", "business", "code", "industry", "face", "listed"]
    kept = made.groupBy(*fields).agg(F.min("key").alias("key"), *[F.first(c).alias(c) for c in ("bones", "own_v", "code_v", "business_v", "own_n", "code_n")])
    return kept.withColumn("id", F.xxhash64("key", *fields))


#: Levels of agreement per field, worst to best; 1 is "unknown".
FIELDS = {"own": 4, "business": 4, "code": 4, "industry": 3, "listed": 4, "face": 3}
#: The Dice score from which close values count as much alike: one typing error in seven letters.
ALIKE = 0.7
#: Where the estimation starts: P(level | same), P(level | different).
_START = {
    "own": ((0.05, 0.02, 0.18, 0.75), (0.1, 0.07, 0.03, 0.8)),
    "business": ((0.01, 0.09, 0.1, 0.8), (0.85, 0.09, 0.03, 0.03)),
    "code": ((0.03, 0.2, 0.37, 0.4), (0.5, 0.2, 0.295, 0.005)),
    "industry": ((0.02, 0.2, 0.78), (0.7, 0.2, 0.1)),
    "listed": ((0.01, 0.15, 0.25, 0.59), (0.75, 0.15, 0.03, 0.07)),
    "face": ((0.08, 0.1, 0.82), (0.5, 0.1, 0.4)),
}


def fit_confidence(patterns: dict[tuple[int, ...], int], expected: int, rounds: int = 12) -> dict[tuple[int, ...], float]:
    """P(same | levels of agreement) for every pattern, by expectation-maximisation over the counts of
    all patterns; fields count as independent given the class. At most the product of ``FIELDS``
    patterns exist, however many pairs there are."""
    total = max(1, sum(patterns.values()))
    share = min(0.9, max(1e-6, expected / total))
    m = {f: list(_START[f][0]) for f in FIELDS}
    u = {f: list(_START[f][1]) for f in FIELDS}

    def posterior(p: tuple[int, ...]) -> float:
        a, b = math.log(share), math.log(1 - share)
        for f, level in zip(FIELDS, p):
            a, b = a + math.log(m[f][level]), b + math.log(u[f][level])
        return 1 / (1 + math.exp(min(700, b - a)))

    for _ in range(rounds):
        same = {p: posterior(p) * n for p, n in patterns.items()}
        if total < 200:  # too few pairs to learn from
            break
        share = min(0.9, max(1e-6, sum(same.values()) / total))
        for i, f in enumerate(FIELDS):
            for table, start, weight in ((m, _START[f][0], same), (u, _START[f][1], {p: n - same[p] for p, n in patterns.items()})):
                mass = [20 * s for s in start]  # the start counts as much as twenty pairs
                for p, w in weight.items():
                    mass[p[i]] += w
                table[f] = [x / sum(mass) for x in mass]
    return {p: posterior(p) for p in product(*(range(k) for k in FIELDS.values()))}


def _close(lv: Column, rv: Column, ln: Column, rn: Column) -> Column:
    most = F.greatest(ln, rn)
    allowed = F.when(most >= 8, 6).when(most >= 5, 4).when(most >= 3, 2).otherwise(0)  # radius()
    return (ln > 0) & (rn > 0) & (_hamming(lv, rv) <= allowed)


def _values(rows: DataFrame) -> DataFrame:
    """The two name fields of prepared rows below each other: f (0 own, 1 code), v, x, n; values without letters are
    left out."""
    two = F.array(*[F.struct(F.lit(i).alias("f"), F.col(c).alias("v"), F.col(f"{c}_v").alias("x"), F.col(f"{c}_n").alias("n")) for i, c in enumerate(("own", "code"))])
    return rows.select(F.inline(two)).filter("n > 0")


def close_values(left: DataFrame, right: DataFrame) -> DataFrame:
    """All pairs (``f``, ``lv``, ``rv``) of values of a name field whose vectors are close, equal ones included, by
    multi-index hashing over the distinct values of both sides and a check. However many rows hold a value it is
    looked up once; the keys widen with the logarithm of the number of values."""
    sides = [_values(df).distinct() for df in (left, right)]
    both = stored(sides[0].withColumn("s", F.lit(1)).unionByName(sides[1].withColumn("s", F.lit(2))).groupBy("f", "v", "x", "n").agg(F.sum("s").alias("s")), "values")
    kinds = F.udf(bands, "array<int>", useArrow=True)
    counted = both.select("f", F.explode(kinds("x")).alias("t")).groupBy("f", "t").count().collect()  # at most twice _BANDS << _BAND
    rank: tuple[dict[int, int], dict[int, int]] = ({}, {})
    for r in counted:
        rank[r["f"]][r["t"]] = r["count"]
    width = max(2, min(5, math.ceil(math.log2(max(2, both.count())) / 8)))
    shared = left.sparkSession.sparkContext.broadcast((rank, width))
    keys = F.udf(lambda f, x: band_keys(x, shared.value[0][f], shared.value[1]), "array<bigint>", useArrow=True)
    keyed = both.select("f", "v", "x", "n", "s", F.explode(keys("f", "x")).alias("_key"))
    lhs, rhs = (keyed.filter(F.col("s").bitwiseAND(F.lit(bit)) > 0).select("f", "_key", *[F.col(c).alias(f"{side}{c}") for c in ("v", "x", "n")]) for bit, side in ((1, "l"), (2, "r")))
    found = _met(lhs, rhs, ["f", "_key"]).filter(_close(F.col("lx"), F.col("rx"), F.col("ln"), F.col("rn"))).select("f", "lv", "rv").distinct()
    return stored(found, "close")


_ANY = -10_000_000


def _keyed(rows: DataFrame, left: bool) -> DataFrame:
    """Rows per key of the second level. ``b``: business words, so placed that two rows share one if their words
    don't contradict each other (a word in common, or none on one side), and one key for whatever words, whose
    pairs can't come out but teach what the fields tell. ``t``: any time, and the 32 days of the listing with
    those around it (left) or itself (right)."""
    words = F.filter(F.split("business", " "), lambda w: w != "")
    none = F.size(words) == 0
    marks = lambda *m: F.array(*map(F.lit, m))
    by_word = F.when(none, marks("#", "?")).otherwise(F.concat(words, marks("*", "?"))) if left else F.when(none, marks("*", "#", "?")).otherwise(F.concat(words, marks("#", "?")))
    bucket = F.floor(F.unix_date("listed") / 32).cast("int")
    around = F.transform(F.array(*([F.lit(-1)] if left else []), F.lit(0), *([F.lit(1)] if left else [])), lambda d: bucket + d)
    times = F.concat(F.array(F.lit(None).cast("int")), F.when(F.col("listed").isNotNull(), around).otherwise(F.array().cast("array<int>")))
    two = F.array(*[F.struct(F.lit(i).alias("f"), F.col(c).alias("v"), (F.coalesce(o, F.lit("")) == "").alias("o")) for i, (c, o) in enumerate((("own", "code"), ("code", "own")))])
    return rows.select("id", "key", "industry", "face", "listed", by_word.alias("bs"), times.alias("ts"), F.inline(two)).filter("length(v) > 0")


def _spread(rows: DataFrame) -> DataFrame:
    """Keyed rows, one per ``b`` and ``t``; any words only at any time."""
    out = rows.withColumn("b", F.explode("bs")).withColumn("t", F.explode("ts")).withColumn("t", F.coalesce("t", F.lit(_ANY)))
    return out.drop("bs", "ts").filter(f"b <> '?' or t = {_ANY}")


def _standing(rows: DataFrame) -> DataFrame:
    """Of keyed rows with one value of a name field that nothing sets apart for a partner that is not close in the
    other name field, the one with the smallest key: the others could only tie with it."""
    day = F.when(F.col("t") == _ANY, F.col("listed").isNull().cast("int")).otherwise(F.unix_date("listed"))
    kept = _spread(rows).groupBy("f", "v", "b", "t", "industry", "face", "o", day.alias("_d")).agg(F.min(F.struct("key", "id")).alias("m"))
    return kept.select("f", "v", "b", "t", F.col("m.id").alias("id"))


def candidate_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of ids (``_l``, ``_r``) of prepared rows: close in one name field and standing for their kind, from
    either side, or close in both name fields. Rows travel as an id and a hash of what they meet by."""
    close = close_values(a, b)
    la, rb = _keyed(a, True), _keyed(b, False)
    meet = F.xxhash64("f", "v", "b", "t").alias("k")

    def turned(rows: DataFrame) -> DataFrame:  # left rows with the right side's values in place of theirs
        return _met(rows, close.select("f", F.col("lv").alias("v"), "rv"), ["f", "v"]).drop("v").withColumnRenamed("rv", "v")

    left_id, right_id = F.col("id").alias("_l"), F.col("id").alias("_r")
    found = _met(_spread(turned(la.select("id", "f", "v", "bs", "ts"))).select(left_id, meet), _standing(rb).select(right_id, meet), "k")
    found = found.unionByName(_met(turned(_standing(la)).select(left_id, meet), _spread(rb.select("id", "f", "v", "bs", "ts")).select(right_id, meet), "k"))
    # close in both: the right row's code, its beginnings, the codes close to it, and the name without vowels
    starts = F.when(F.length("code") > 0, F.transform(F.sequence(F.lit(1), F.length("code")), lambda n: F.substring(F.col("code"), F.lit(1), n)))
    near = close.filter("f = 1").groupBy(F.col("rv").alias("code")).agg(F.collect_set("lv").alias("near"))
    none = F.array().cast("array<string>")
    bs = F.filter("bs", lambda w: w != "?")
    codes = _met(_met(b.select("id", "own", "code", "bones"), near, "code", "left"), rb.filter("f = 0").select("id", bs.alias("bs")), "id")
    both = F.xxhash64("v", "b", "c").alias("k")
    rhs = codes.select("id", F.col("own").alias("v"), F.explode("bs").alias("b"), F.array_distinct(F.concat(F.coalesce(starts, none), F.coalesce("near", none), F.array("bones"))).alias("cs"))
    lhs = _met(turned(la.filter("f = 0").select("id", "f", "v", bs.alias("bs"))), a.filter("code <> ''").select("id", F.col("code").alias("c")), "id").withColumn("b", F.explode("bs"))
    found = found.unionByName(_met(lhs.select(left_id, both), rhs.withColumn("c", F.explode("cs")).select(right_id, both), "k"))
    return stored(found.select("_l", "_r").distinct(), "candidates")


def match_companies(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_code: str, right_code: str) -> DataFrame:
    """Pairs of one company: ``left_key``, ``right_key``, ``confidence``, and the field scores
    ``own_dice``, ``business_dice``, ``code_dice``.

    Both sides need company_name, industry, face_value, listed_on and a code (a ticker or short name).
    The name's own part, its business words and the code become fixed bit vectors of their letter pairs.
    Candidates are the rows whose own parts or codes are close: all pairs of values within the radius, found
    exactly by multi-index hashing. Dice scores per field become levels of agreement; how much each level
    weighs is estimated from the candidates, and the weighted sum is the log-odds behind a calibrated
    confidence. A pair comes out if its confidence is at least one half, its business words don't
    contradict each other, and it is the best for both of its records.

    Hot values: rows equal in all fields stand once; two values that are close don't pair all their rows but
    those that share a business word (or leave it open) and are close in the other name field too, and
    otherwise each row with the few that stand for all rows it can't tell apart (``_standing``, on either side).
    The best partner of every row is among these, so nothing is lost, at any size. Only word, band and
    pattern counts reach the driver, all bounded. Defined results: rows without key or name match nothing;
    repeated rows count once; several rows per key are compared each, and the key's best one counts; ties go
    to the smaller keys; missing fields neither help nor harm; empty tables give an empty result; extra
    columns are ignored.
    """
    spark = left.sparkSession
    words = descriptor_words(right.select("company_name"), "company_name", 2)
    reader = Namer(words)  # and words of the other list that can't be read as one of these
    heads = right.select(F.regexp_extract(F.lower("company_name"), "[a-z0-9]+", 0).alias("head")).distinct()
    words += [w for w in descriptor_words(left.select("company_name"), "company_name", 3, heads) if reader.descriptor(w) is None]
    namer = spark.sparkContext.broadcast(words)
    a = stored(_prepared(left, left_key, left_code, namer), "left")
    b = stored(_prepared(right, right_key, right_code, namer), "right")
    ids = candidate_pairs(a, b)

    # which industries of the left list go with which business: from rows that agree in all of the name
    sure = _met(a.filter("industry is not null and own <> ''"), b.select("own", "business").distinct(), ["own", "business"], "left_semi")
    kinds = sure.groupBy(F.col("industry").alias("l_industry"), F.col("business").alias("r_business")).count().withColumn(
        "_share", F.col("count") / F.sum("count").over(Window.partitionBy("r_business"))
    ).filter("_share >= 0.02")
    kinds = stored(kinds.select("l_industry", "r_business", F.lit(1).alias("_goes")), "kinds")
    seen = kinds.groupBy("r_business").agg(F.lit(1).alias("_seen"))
    # business words that are the whole business of some right row are not a cut form of more words
    whole = b.select(F.col("business").alias("l_business")).distinct().withColumn("_whole", F.lit(1))

    lhs = a.select(*[F.col(c).alias(f"l_{c}") for c in a.columns if c != "id"], F.col("id").alias("_l"))
    rhs = b.select(*[F.col(c).alias(f"r_{c}") for c in b.columns if c != "id"], F.col("id").alias("_r"))
    pairs = _met(_met(ids, lhs, "_l"), rhs, "_r")
    pairs = pairs.join(whole, "l_business", "left").join(kinds, ["l_industry", "r_business"], "left").join(seen, "r_business", "left")
    near_own = _close(F.col("l_own_v"), F.col("r_own_v"), F.col("l_own_n"), F.col("r_own_n"))
    near_code = _close(F.col("l_code_v"), F.col("r_code_v"), F.col("l_code_n"), F.col("r_code_n")) & (_dice(F.col("l_code_v"), F.col("r_code_v")) >= ALIKE)
    l_set, r_set = F.split("l_business", " "), F.split("r_business", " ")
    shared = F.size(F.array_intersect(l_set, r_set))
    days = F.abs(F.datediff("l_listed", "r_listed"))
    l_code, r_code = F.col("l_code"), F.col("r_code")
    # a code made of the left row's own name supports that name, not a similar one
    elsewhere = (F.col("l_own") != F.col("r_own")) & (F.length("l_own") >= 5) & l_code.startswith(F.col("l_own")) & (l_code != r_code)
    pairs = pairs.withColumns({f"{f}_dice": _dice(F.col(f"l_{f}_v"), F.col(f"r_{f}_v")) for f in ("own", "business", "code")}).withColumns({
        "own": F.when(F.col("l_own") == F.col("r_own"), 3).when(near_own & (F.col("own_dice") >= ALIKE), 2).when(near_own, 1).otherwise(0),
        "business": F.when(F.col("l_business") == F.col("r_business"), 3)
        .when((F.col("l_business") == "") | (F.col("r_business") == ""), 1)
        .when((shared > 0) & (shared == F.size(l_set)) & F.col("_whole").isNull(), 2).otherwise(0),
        "code": F.when(l_code.isNull() | r_code.isNull(), 1).when(l_code == r_code, 3).when(elsewhere, 0)
        .when(r_code.startswith(l_code) | (l_code == F.col("r_bones")) | near_code, 2).otherwise(0),
        "industry": F.when(F.col("_goes") == 1, 2).when(F.col("l_industry").isNull() | F.col("_seen").isNull(), 1).otherwise(0),
        "listed": F.when(days.isNull(), 1).when(days == 0, 3).when(days <= 31, 2).otherwise(0),
        "face": F.when(F.col("l_face").isNull() | F.col("r_face").isNull() | F.isnan("l_face") | F.isnan("r_face"), 1).when(F.col("l_face") == F.col("r_face"), 2).otherwise(0),
    })
    pairs = stored(pairs.select(F.col("l_key").alias("_lk"), F.col("r_key").alias("_rk"), *FIELDS, "own_dice", "business_dice", "code_dice"), "pairs")

    patterns = {tuple(r[f] for f in FIELDS): r["count"] for r in pairs.groupBy(*FIELDS).count().collect()}
    confidence = fit_confidence(patterns, a.select("key").distinct().count())
    table = spark.createDataFrame([(*p, float(c)) for p, c in confidence.items()], ", ".join(f"{f} int" for f in FIELDS) + ", confidence double")
    scored = pairs.join(table, list(FIELDS)).filter("confidence >= 0.5 and business >= 1")
    strength = F.when(F.col("own") >= 1, F.col("own_dice")).otherwise(0.0) + F.coalesce("business_dice", F.lit(0.0)) + F.when(F.col("code") >= 2, F.col("code_dice")).otherwise(0.0)
    best = F.struct(-F.col("confidence"), -strength, F.col("_lk"), F.col("_rk"))
    scored = scored.withColumn("_me", best).withColumns({
        "_bl": F.min("_me").over(Window.partitionBy("_lk")), "_br": F.min("_me").over(Window.partitionBy("_rk")),
    }).filter((F.col("_bl") == F.col("_me")) & (F.col("_br") == F.col("_me")))
    return scored.select(
        F.col("_lk").alias(left_key), F.col("_rk").alias(right_key), "confidence", "own_dice", "business_dice", "code_dice"
    ).dropDuplicates([left_key, right_key])
