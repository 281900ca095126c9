"""Find the noise of scanned pages in text and turn the text into continuous paragraphs."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakefold.session import stored

#: What a scanner reads and what stood there.
CONFUSIONS = (
    ("rn", "m"), ("m", "rn"), ("ri", "n"), ("li", "h"), ("cl", "d"), ("vv", "w"), ("ii", "u"), ("†", "t"), ("!", "i"), ("!", "l"),
    ("1", "l"), ("1", "i"), ("|", "l"), ("|", "i"), ("0", "o"), ("5", "s"), ("$", "s"), ("8", "b"), ("6", "b"), ("9", "g"), ("3", "e"),
    ("@", "a"), ("c", "e"), ("q", "g"), ("€", "e"), ("£", "e"), ("tl", "d"), ("fi", "h"),
)
_BY_FIRST: dict[str, list[tuple[str, str]]] = {}
for _seen, _meant in CONFUSIONS:
    _BY_FIRST.setdefault(_seen[0], []).append((_seen, _meant))
#: A word without any of these can't have been misread.
_DOUBTFUL = re.compile("|".join(re.escape(s) for s, _ in CONFUSIONS))
_BREAKS = re.compile(r"\r\n|\r|\n|\f")
_PAGE_NUMBER = re.compile(
    r"^\s*(?:\[\s*\d{1,4}\s*\]|[-–—~]\s*\d{1,4}\s*[-–—~]|(?:p[a-z]{2}[ec]\.?|pg\.?|p\.)\s*[\dOol]{1,4}(?:\s*(?:of|/|0f)\s*[\dOol]{1,4})?|\d{1,4}|\d{1,4}\s*(?:of|/)\s*\d{1,4}|[ivxl]{1,7})\s*$",
    re.I,
)
_MARKS = "-‐‑­¬"
_BROKEN = re.compile(rf"([^\W\d_][^\W_†!$|']*|[^\s\W][\w†!$|']*?)[{_MARKS}][ \t]*$")
_TOKEN = re.compile(r"[^\s]+")
_EDGE = re.compile(r"^[^\w$†!€£@|]+|[^\w†$!|]+$")
_END = re.compile(r"[.!?:;।॥][\"'”’)\]]*$")


@lru_cache(1 << 18)
def bare(word: str) -> str:
    """A word without the punctuation around it, in lower case."""
    w = _EDGE.sub("", word)
    while w[-1:] in "!|" and w[:-1].isalpha():  # an exclamation mark at the end is punctuation
        w = w[:-1]
    return w.lower()


_END_OF_WORD = ""


def trie(words: Iterable[str]) -> dict:
    """A vocabulary trie: a node maps letters to nodes, and the empty string to the word that ends there."""
    root: dict = {}
    for word in words:
        node = root
        for ch in word:
            node = node.setdefault(ch, {})
        node[_END_OF_WORD] = word
    return root


def readings(word: str, root: dict, most: int | None = None) -> dict[str, int]:
    """All vocabulary words the scanner could have turned into ``word`` with at most ``most`` misreadings (by
    default one in three letters, two at least), and how many it takes: the Levenshtein automaton of
    ``word`` whose edits are the misreadings, at a cost of 1 each, intersected with the trie. Complete."""
    most = max(2, len(word) // 3) if most is None else most
    out: dict[str, int] = {}
    stack = [(0, root, 0)]
    seen = set()
    while stack:
        at, node, cost = stack.pop()
        if (at, id(node), cost) in seen:
            continue
        seen.add((at, id(node), cost))
        if at == len(word):
            found = node.get(_END_OF_WORD)
            if cost and found is not None and cost < out.get(found, most + 1):
                out[found] = cost
            continue
        if word[at] in node:
            stack.append((at + 1, node[word[at]], cost))
        if cost < most:
            for seen_as, meant in _BY_FIRST.get(word[at], ()):
                if word.startswith(seen_as, at):
                    to = node
                    for ch in meant:
                        to = to.get(ch)
                        if to is None:
                            break
                    else:
                        stack.append((at + len(seen_as), to, cost + 1))
    return out


def within(word: str, root: dict, k: int) -> dict[str, int]:
    """All vocabulary words at Levenshtein distance at most ``k``: the automaton's state is a row of the
    distance table, and a branch ends where every entry exceeds ``k``. Complete."""
    out: dict[str, int] = {}
    stack = [(root, list(range(len(word) + 1)))]
    while stack:
        node, row = stack.pop()
        for ch, to in node.items():
            if ch == _END_OF_WORD:
                if row[-1] <= k:
                    out[to] = row[-1]
                continue
            new = [row[0] + 1]
            for i, c in enumerate(word):
                new.append(min(new[i] + 1, row[i + 1] + 1, row[i] + (c != ch)))
            if min(new) <= k:
                stack.append((to, new))
    return out


_SKELETON = str.maketrans({**dict.fromkeys("cedlihrnm1!|u", None), "0": "o", "5": "s", "$": "s", "8": "b", "†": "t", "q": "g", "€": None, "£": None, "6": "b", "9": "g", "3": None, "@": "a", "f": None, "t": None, "v": None, "w": None})


def skeleton(line: str) -> str:
    """What of a line no misreading changes."""
    return re.sub(r"[^\w$@]", "", line.lower().replace("†", "t")).translate(_SKELETON)


def titled(line: str) -> bool:
    """Whether a line looks like a title: few words, nearly all capitalised, no sentence end."""
    rough = line.split()
    if len(rough) < 2 or len(rough) > 20 or sum(w[0].islower() for w in rough) > 0.5 * len(rough):
        return False
    words = re.findall(r"[\w$†!]+", line)
    if not 2 <= len(words) <= 16 or len(line) > 140 or _END.search(line) or line.count("|") > 1:
        return False
    named = [w for w in words if w[0].isalpha() and w.lower() not in ("of", "and", "the", "for", "to", "in", "on", "a", "an")]
    return len(named) >= 2 and sum(not w[0].islower() for w in named) >= 0.75 * len(named) and any("a" <= c.lower() <= "z" for c in line)


_WHOLE = re.compile(r"(?:^|(?<=[\s(\[\"“‘']))[^\W\d_](?:[^\W\d_]|['’&-])*(?=[^\w\s]{0,3}(?:\s|$))")
_NUMBER = re.compile(r"[\d.,%/:()+\-]*")
_INSIDE = re.compile(r"[A-Za-z][a-z]*[0158!†$|][a-z]+|[A-Z]{2,}[!†$|][A-Z]{2,}")


def whole_words(text: str) -> list[str]:
    """The words of letters only, in order, in lower case."""
    return [w.rstrip("-'’&") for w in _WHOLE.findall(text.lower())]


def doubtful(word: str) -> bool:
    """Whether a bare word could have been misread at all."""
    return len(word) >= 3 and _DOUBTFUL.search(word) is not None and not _NUMBER.fullmatch(word) and "://" not in word and not ("@" in word[1:-1] and "." in word)


def broken_inside(word: str) -> bool:
    """A digit or sign in the middle of a word's small letters, which no spelling has."""
    return len(word) >= 5 and _INSIDE.fullmatch(word) is not None


@lru_cache(1 << 18)
def _sign_inside(token: str) -> bool:
    return broken_inside(_EDGE.sub("", token))


@lru_cache(1 << 18)
def _asked(token: str) -> tuple[str, tuple[str, ...], bool]:
    """(bare word, its forms that may be misread, whether it ends in an exclamation mark)."""
    inner = bare(token)
    called = token.rstrip(".,;:)").endswith("!")
    return inner, tuple(w for w in ((inner, f"{inner}!") if called else (inner,)) if doubtful(w)), called


def layout(text: str) -> tuple[set[str], list[str], list[str]]:
    """(noise of the page furniture, furniture lines, body lines). Needs no vocabulary."""
    noise: set[str] = set()
    raw = [line.replace("\f", "") for line in _BREAKS.split(text)]
    keys = [skeleton(line) if titled(line.strip()) else "" for line in raw]
    titles = Counter(k for k in keys if len(k) >= 4)
    furniture, body = [], []
    for line, key in zip(raw, keys):
        if line.strip() and _PAGE_NUMBER.match(line):
            noise.add("page_number")
            furniture.append(line)
        elif titles[key] > 1:
            noise.add("header")
            furniture.append(line)
        else:
            body.append(line)
    return noise, furniture, body


def _broken(lines: list[str], i: int):
    """Where line ``i`` ends in a broken word: the match at its end, the line that goes on, its first token."""
    end = lines[i].rstrip(" \t")
    m = _BROKEN.search(lines[i]) if end and end[-1] in _MARKS else None
    if not m:
        return None
    j = i + 1
    while j < len(lines) and not lines[j].strip():
        j += 1
    nxt = _TOKEN.search(lines[j]) if j < len(lines) else None
    return m, j, nxt


def _parts(left: str, right: str) -> tuple[str, str, str] | None:
    """The bare halves of a broken word and the first part of the second, or None if they can't be one word."""
    a, b = bare(left), bare(right)
    if not a or not b or not right[:1].isalpha() and right[:1] not in "$†!" or right[:1].isupper() and not left.isupper():
        return None
    return a, b, b.split("-")[0]


def questions(text: str) -> set[tuple[str, str, bool]]:
    """(word, word before it, whether its count matters) for every word whose repair needs the vocabulary."""
    _, furniture, lines = layout(text)
    out: set[tuple[str, str, bool]] = set()

    def ask(token: str, before: str) -> str:
        inner, forms, called = _asked(token)
        for form in forms:
            out.add((form, before, False))
        if called:
            out.add((inner, "", True))
        return inner

    for line in [*furniture, *lines]:
        before = ""
        for token in line.split():
            before = ask(token, before)
    for i in range(len(lines)):
        hit = _broken(lines, i)
        if hit and hit[2]:
            m, _, nxt = hit
            words = lines[i][: m.start()].split()
            before = bare(words[-1]) if words else ""
            ask(m[1] + nxt[0], before)
            ask(f"{m[1]}-{nxt[0]}", before)
            halves = _parts(m[1], nxt[0])
            if halves:
                a, b, first = halves
                out |= {(w, "", True) for w in (a + b, f"{a}-{b}", a, first)}
                if doubtful(a + b):
                    out.add((a + b, "", False))
    return out


class Reader:
    """Reads one scanned text with what the collection knows about its words: ``counts`` of words, and ``best``,
    what a word more likely is, by the word and the word before it."""

    def __init__(self, counts: dict[str, int], best: dict[tuple[str, str], str]):
        self.counts, self.best = counts, best
        self.misread = {w for w, _ in best}

    def known(self, word: str) -> int:
        return self.counts.get(word, 0)

    def core(self, word: str) -> str:
        """The bare word; an exclamation mark at its end stays if only with it the word can be read."""
        inner = bare(word)
        if word.rstrip(".,;:)").endswith("!") and not self.known(inner) and f"{inner}!" in self.misread:
            return f"{inner}!"
        return inner

    def dirty(self, token: str) -> bool:
        return bare(token) in self.misread or _sign_inside(token) or "!" in token and self.core(token) in self.misread

    def corrected(self, word: str, before: str) -> str:
        """``word`` as it stood on the page; the case is kept."""
        core = self.core(word)
        if core not in self.misread:
            return word
        best = self.best.get((core, before)) or next(v for (w, _), v in sorted(self.best.items()) if w == core)
        at = word.lower().find(core)
        body = word[at : at + len(core)]
        upper = sum(c.isupper() for c in body)
        shaped = best.upper() if upper > 1 and upper >= sum(c.islower() for c in body) else best.capitalize() if body[:1].isupper() or not body[:1].isalpha() and at == 0 and word[:1] in "$8" else best
        return word[:at] + shaped + word[at + len(core):]

    def joins(self, left: str, right: str) -> str | None:
        """The word that was broken into ``left`` and ``right``, or None if the hyphen is its own."""
        halves = _parts(left, right)
        if halves is None:
            return None
        a, b, first = halves
        if self.known(a + b) >= 2 or a + b in self.misread:
            return a + b
        if self.known(f"{a}-{b}") >= 2 or self.known(a) >= 2 and self.known(first) >= 2:
            return None
        return a + b

    def read(self, text: str) -> tuple[set[str], str]:
        """(kinds of noise, repaired text)."""
        noise, furniture, lines = layout(text)
        if any(self.dirty(w) for line in furniture for w in line.split()):
            noise.add("characters")
        out: list[str] = []
        i = 0
        while i < len(lines):
            line, hit = lines[i], _broken(lines, i)
            if hit:
                m, j, nxt = hit
                if nxt and self.joins(m[1], nxt[0]) is not None:
                    noise.add("hyphenation")
                    lines[j] = line[: m.start()] + m[1] + nxt[0] + lines[j][nxt.end():]
                    i = j
                    continue
                if nxt and line.rstrip()[-1] in "-‐‑" and j == i + 1:  # the hyphen is the word's own
                    lines[j] = line[: m.end(1)] + "-" + lines[j].lstrip()
                    i = j
                    continue
            out.append(line)
            i += 1
        fixed = []
        for line in out:
            if not any(map(self.dirty, line.split())):
                fixed.append(line)
                continue
            before, words = "", []
            for part in re.split(r"(\s+)", line):
                if part and not part.isspace():
                    new = self.corrected(part, before) if self.misread else part
                    if new != part or _sign_inside(part):
                        noise.add("characters")
                    part, before = new, bare(new)
                words.append(part)
            fixed.append("".join(words))
        return noise, self._reflow(fixed)

    @staticmethod
    def _reflow(lines: list[str]) -> str:
        """Lines to paragraphs: a blank line ends one, unless the sentence runs on across it."""
        paragraphs: list[str] = []
        current = ""
        gap = False
        for line in lines:
            line = re.sub(r"[ \t]+", " ", line).strip()
            if not line:
                gap = True
                continue
            table = line.count("|") > 1
            runs_on = current and not _END.search(current) and (line[:1].islower() or line[:1].isdigit())
            if current and (table or "|" in current and current.count("|") > 1 or gap and not runs_on):
                paragraphs.append(current)
                current = line
            else:
                current = f"{current} {line}".strip()
            gap = False
        if current:
            paragraphs.append(current)
        return "\n\n".join(paragraphs)


def _retrieve(words: pd.DataFrame) -> pd.DataFrame:
    """Per key the vocabulary words of that key as a trie, intersected with the automaton of every doubtful word."""
    found: list[tuple[str, int, str, int]] = []
    for key, part in words.groupby("key", sort=False):
        known = dict(zip(part["word"][part["asked"] == 0], part["n"][part["asked"] == 0]))
        root = trie(known)
        if not root:
            continue
        for word, own in zip(part["word"][part["asked"] == 1], part["n"][part["asked"] == 1]):
            if key[0] == "s":
                found += [(word, cost, v, known[v]) for v, cost in readings(word, root).items()]
            else:  # any one edit, dearer than misreadings
                found += [(word, 99 + cost, v, known[v]) for v, cost in within(word, root, 1).items() if v != word]
    columns = list(zip(*found)) if found else [[]] * 4
    kinds = {"word": object, "cost": "int32", "option": object, "n": "int64"}
    return pd.DataFrame({c: pd.Series(list(v), dtype=t) for (c, t), v in zip(kinds.items(), columns)})


def candidates(asked: DataFrame, known: DataFrame, buckets: int = 512) -> DataFrame:
    """Complete candidates (``word``, ``cost``, ``option``, ``n``) for the doubtful words ``asked`` (word) among the
    vocabulary ``known`` (word, n), each word looked up once in the whole cluster.

    No misreading changes a word's skeleton, so vocabulary and doubtful words meet by skeleton; a word with a
    sign inside, which may be any one letter, also meets the words that share its first or its second half
    (one edit leaves one of them whole). Per key the automaton of each doubtful word is intersected with the
    trie of the key's words."""
    half = F.udf(_halves, "array<string>", useArrow=True)
    bones = F.udf(skeleton, "string", useArrow=True)
    asked = asked.withColumn("key", F.explode(F.concat(F.array(F.concat(F.lit("s"), bones("word"))), half("word", F.lit(True)))))
    keys = asked.select("key").distinct()
    known = known.withColumn("key", F.explode(F.concat(F.array(F.concat(F.lit("s"), bones("word"))), half("word", F.lit(False)))))
    known = known.join(keys, "key", "left_semi").select("key", "word", "n", F.lit(0).alias("asked"))
    both = known.unionByName(asked.select("key", "word", F.lit(0).cast("bigint").alias("n"), F.lit(1).alias("asked")))
    return both.groupBy(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("_b")).applyInPandas(_retrieve, "word string, cost int, option string, n bigint")


def _halves(word: str, asked: bool) -> list[str]:
    """Keys for one edit at most: a doubtful word's two halves (only of words with a sign inside), and what may be
    the halves of such a word at the start and end of a vocabulary word."""
    if asked:
        h = len(word) // 2
        return [f"l{word[:h]}", f"r{word[h:]}"] if broken_inside(word) else []
    out = set()
    for n in (len(word) - 1, len(word), len(word) + 1):
        h = n // 2
        out |= {f"l{word[:h]}", f"r{word[max(0, len(word) - (n - h)):]}"}
    return sorted(out) if len(word) >= 4 else []


def repair_scanned(docs: DataFrame, keys: list[str], text: str, hot: int = 20_000) -> DataFrame:
    """Per record: ``keys``, ``noise`` (array of hyphenation, characters, header, page_number; empty if
    clean) and ``repaired`` (paragraphs without page furniture, words whole and corrected).

    One pass over the distinct texts counts the vocabulary, its word pairs, and the words of each text that may
    have been misread or broken. The distinct doubtful words meet the whole vocabulary in the cluster
    (``candidates``). Another reading counts if it has at least two records and three times those of the word
    as it stands (fifty times for three letters); several are ranked by misreadings, then by how often they follow the word before, then by frequency. What is known
    of a text's words then goes back to it, and a second pass repairs it. Nothing of the vocabulary is
    broadcast but the ``hot`` most frequent words that need no second reading, which don't travel.

    Defined results: null and empty texts have no noise and come out empty; repeated rows repeat their
    result; extra columns are not carried.
    """
    types = dict(docs.dtypes)
    base = docs.select(*keys, F.col(text).alias("_text"), F.when(F.length(text) > 0, F.md5(text)).alias("_h"))
    schema = "h string, word string, before string, counts boolean, n bigint, kind string"

    def survey(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            asked, words, pairs = [], Counter(), Counter()
            for h, body in zip(frame["_h"], frame["_text"]):
                asked += [(h, *q) for q in questions(body)]
                found = whole_words(body)
                words.update(set(found))
                pairs.update(zip(found, found[1:]))
            rows = [(h, w, b, c, None, "q") for h, w, b, c in asked]
            rows += [(None, w, None, None, n, "w") for w, n in words.items()] + [(None, w, b, None, n, "p") for (b, w), n in pairs.items()]
            if rows:
                out = pd.DataFrame(rows, columns=["h", "word", "before", "counts", "n", "kind"], dtype=object)
                yield out.assign(n=pd.array(out["n"], dtype="Int64"))

    seen = stored(base.filter("_h is not null").select("_h", "_text").dropDuplicates(["_h"]).mapInPandas(survey, schema), "survey")
    vocabulary = stored(seen.filter("kind = 'w'").groupBy("word").agg(F.sum("n").alias("n")).filter("n >= 2"), "vocabulary")
    asked = seen.filter("kind = 'q'")
    is_alpha = F.col("word").rlike(r"^\p{L}+$")
    doubts = asked.filter("not counts").select("word").distinct()
    found = candidates(doubts, vocabulary)
    own = found.join(vocabulary.select("word", F.col("n").alias("own")), "word", "left")
    own = own.withColumn("own", F.greatest(F.coalesce("own", F.lit(0)), F.when(is_alpha, 1).otherwise(0)))
    least = F.when(F.length("word") == 3, 50 * F.greatest("own", F.lit(1))).otherwise(3 * F.col("own"))
    options = own.filter((F.length("option") >= 3) & (F.col("n") >= F.greatest(F.lit(2), least)))
    cheapest = Window.partitionBy("word")
    options = stored(options.withColumn("_c", F.min("cost").over(cheapest)).filter("cost = _c").select("word", "option", "n").distinct(), "options")

    # what each text needs to know: counts of its broken words, and the best reading of its misread ones
    clean = vocabulary.join(options.select("word").distinct(), "word", "left_anti").orderBy(F.col("n").desc(), "word").limit(hot).select("word")
    misread = asked.filter("not counts").join(F.broadcast(clean), "word", "left_anti").select("h", "word", "before").join(options, "word")
    follows = seen.filter("kind = 'p'").join(options.select(F.col("option").alias("word")).distinct(), "word", "left_semi")
    follows = follows.groupBy("before", F.col("word").alias("option")).agg(F.sum("n").alias("f"))
    ranked = misread.join(follows, ["before", "option"], "left").groupBy("h", "word", "before").agg(
        F.max(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "n", "option")).alias("m")
    )
    answers = ranked.select("h", F.struct("word", "before", F.lit(None).cast("bigint").alias("n"), F.col("m.option").alias("option")).alias("a"))
    counted = asked.filter("counts").select("h", "word").join(vocabulary, "word")
    answers = answers.unionByName(counted.select("h", F.struct("word", F.lit("").alias("before"), "n", F.lit(None).cast("string").alias("option")).alias("a")))
    answers = answers.groupBy("h").agg(F.collect_set("a").alias("_answers"))

    def repair(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done = []
            for body, told in zip(frame["_text"], frame["_answers"]):
                told = told if told is not None else []
                reader = Reader({a["word"]: a["n"] for a in told if a["option"] is None}, {(a["word"], a["before"]): a["option"] for a in told if a["option"] is not None})
                done.append(reader.read(body) if isinstance(body, str) and body else (set(), ""))
            out = frame.drop(columns=["_text", "_answers"])
            yield out.assign(noise=pd.Series([sorted(n) for n, _ in done], index=out.index, dtype=object), repaired=pd.Series([r for _, r in done], index=out.index, dtype=object))

    out = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", noise array<string>, repaired string"
    return base.join(answers.withColumnRenamed("h", "_h"), "_h", "left").select(*keys, "_text", "_answers").mapInPandas(repair, out)
