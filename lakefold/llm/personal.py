"""Find personal information in free text and replace it by typed placeholders or keyed surrogates."""

from __future__ import annotations

import hashlib
import hmac
import re
import secrets
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakefold.session import stored

_AT = re.compile(r"@|[(\[{]\s?at\s?[)\]}]", re.I)
_LOCAL = re.compile(r"([A-Za-z0-9][A-Za-z0-9._%+\-]{0,63})\s?$")
_DOMAIN = re.compile(r"\s?([A-Za-z0-9\-]+(?:(?:\.|\s?[(\[{]\s?dot\s?[)\]}]\s?)[A-Za-z0-9\-]+)+)", re.I)
_SPELT = re.compile(r"\b[A-Za-z0-9][\w.+\-]{0,63} at [A-Za-z0-9\-]+(?: dot [A-Za-z0-9\-]+)+\b", re.I)

#: Layouts of telephone numbers: with country code, Indian trunk and mobile forms.
_PHONE = re.compile(
    r"(?<![\w.,/@+\-])(?:"
    r"\+\d{1,3}[-. ]?(?:\d{10}|\d{5}[-. ]\d{5}|\d{2}[ -]\d{4}[ -]\d{4}|\(?\d{3}\)?[-. ]\d{3}[-. ]\d{4})"
    r"|91[- ](?:\d{3}[- ]\d{3}[- ]\d{4}|\d{5}[- ]\d{5}|\d{10})"
    r"|\(0\d{2,4}\)[ -]?\d{3,4}[ -]?\d{3,4}"
    r"|0\d{2,4}-\d{6,8}|0\d{2,4}[ -]\d{3}[ -]\d{4}|0\d{3} \d{2} \d{2} \d{2} \d|0\d{10}"
    r"|\d{5}[- ]\d{5}|\d{3}[- ]\d{3}[- ]\d{4}|\d{10}"
    r")(?![\w@]|[-.,/]\d)"
)
_NOT_PHONE = re.compile(
    r"(?:\b(?:no|nos|number|code|folio|ref|reference|order|application|isin|cin|gstin|invoice|id|docket|case|account|a/c|rs|inr|turnover|uid|din|pan|aadhaa?r|serial|receipt|token)\b\.?|₹|\$)\s*[:#\-–.]*\s*$",
    re.I,
)
_PHONE_WORD = re.compile(r"\b(?:phone|tel|telephone|mobile|mob|cell|call|fax|contact|whatsapp)\b[\w .]{0,12}[:#\-–.]*\s*$", re.I)

_ID_WORD = (
    "pan", "permanent account", "tax id", "aadhaar", "aadhar", "uid", "passport", "licence", "license", "din",
    "director identification",
)
_ID = re.compile(
    r"(?:pan|permanent account(?: number)?|tax id|aadhaa?r|uid(?:ai)?|passport|licen[cs]e|din|director identification(?: number)?)"
    r"(?:\s+(?:card|number|no))*[\s.:#\-–]*"
    r"([a-z]{5}\d{4}[a-z]|\d{4}[ -]\d{4}[ -]\d{4}|\d{12}|[a-z]{2}[ -]?\d{2}[ -]?\d{11}|[a-z]\d{7}|\d{8})(?![\w]|-\d)",
    re.I,
)
#: A PAN whose fourth letter says person, wherever it stands.
_BARE_PAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{3}P[A-Z]\d{4}[A-Z](?![A-Za-z0-9])")

_STREET_WORDS = (
    "street", "road", "marg", "lane", "nagar", "layout", "enclave", "colony", "avenue", "society", "chowk", "bazaar",
    "vihar", "apartments", "residency",
)
_HOUSE = r"(?:(?:house|flat|plot|door|shop|villa|apartment|apt|h)\.?\s*(?:no\b\.?|number\b)?\s*|#\s?|[a-z]-)?\d{1,5}[a-z]?(?:[-/]\s?[a-z0-9]{1,4})?"
_ADDRESS = re.compile(
    rf"(?<![\w#/\-.])({_HOUSE}\s*,\s+(?:(?:\d{{1,3}}(?:st|nd|rd|th)\s+(?:cross|main|floor|block)|(?:sector|block|phase|ward)\s+\w{{1,4}})\s*,\s+){{0,3}}"
    rf"(?:[^\W\d_][\w'.]*\s+){{1,3}}(?:{'|'.join(_STREET_WORDS)}))\b",
    re.I,
)
_CITY = re.compile(r"\s*,\s*[^\W\d_]+(?: [A-Z][^\W\d_]+)?(?:(?:\s*,\s*PIN\s+|\s*[-–]\s*|\s+)\d{3}\s?\d{3}\b)?")

_TITLED = re.compile(
    r"\b(?:Mr|Mrs|Ms|Dr|Shri|Smt|Prof)\.?\s+((?:[A-Z]\.\s?){1,3}[A-Z][a-z]{2,}|[A-Z][a-z]{2,}(?:\s+[A-Z][a-z]+){1,2}|[A-Z]{3,}\s+[A-Z]{3,})(?!\s*(?:Limited|Ltd|Private|Bank|Industries|Road|Street))"
)
_INITIALS = re.compile(r"(?<![\w.@])((?:[^\W\d_]\.\s?){1,3}\s*|[A-Z]\s+)$")
_BEFORE = re.compile(r"(?<![\w@.\-])([^\W\d_][^\s\d.,;:()\[\]\"“”@]*)\s+$")
_SEP = "\0"


def _lower(text: str) -> str:
    """Lower case of equal length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _within_word(c: str) -> bool:
    return c.isalnum() or c == "_" or not c.isascii() and unicodedata.category(c)[0] == "M"


class Detector:
    """Finds e-mail addresses, telephone numbers, identity numbers, street addresses and names.

    One automaton walks the text for surnames and for the words that identity numbers and addresses
    come with; expressions are only tried where it stops. A name is a given name or initials before a
    known surname, or capitalised words after a personal title.
    """

    def __init__(self, given: frozenset[str], surnames: frozenset[str]):
        self.given = given
        self.automaton = ahocorasick.Automaton()
        triggers = {w: "id" for w in _ID_WORD} | {w: "street" for w in _STREET_WORDS} | {" dot ": "spelt"}
        triggers |= {s: "surname" for s in surnames if len(s) > 1}
        for word, kind in triggers.items():
            self.automaton.add_word(word, (kind, len(word)))
        self.automaton.make_automaton()

    def spans(self, text: str, names: list[tuple[int, int]] = ()) -> list[tuple[str, int, int]]:
        """(kind, start, end), ordered and without overlaps; e-mail beats identity number, address,
        telephone number and name. ``names`` were found before."""
        found = self.found(text)
        found["name"] += names
        taken: list[tuple[str, int, int]] = []
        cover = bytearray(len(text))
        for kind, spans in found.items():
            for a, b in sorted(set(spans), key=lambda s: (s[0], -s[1])):
                if not any(cover[a:b]):
                    cover[a:b] = b"\1" * (b - a)
                    taken.append((kind, a, b))
        return sorted(taken, key=lambda t: t[1])

    def found(self, text: str) -> dict[str, list[tuple[int, int]]]:
        """All that looks like a mention, by kind."""
        low, n = _lower(text), len(text)
        found: dict[str, list[tuple[int, int]]] = {k: [] for k in ("email", "id", "address", "phone", "name")}
        spelt = False
        for last, (kind, size) in self.automaton.iter(low):
            start, end = last - size + 1, last + 1
            if kind == "spelt":
                spelt = True
                continue
            if start and _within_word(low[start - 1]):
                continue
            if kind == "id":
                m = _ID.match(text, start)
                if m:
                    found["id"].append(m.span(1))
            elif end < n and _within_word(low[end]):
                continue
            elif kind == "street":
                base = max(0, start - 400)
                hits = [m for m in _ADDRESS.finditer(text, base, end) if m.end() == end]
                if hits:
                    city = _CITY.match(text, end)
                    found["address"].append((hits[0].start(1), city.end() if city else end))
            else:
                m = _BEFORE.search(text, max(0, start - 40), start)
                if m and m[1].lower() in self.given:
                    found["name"].append((m.start(1), end))
                else:
                    m = _INITIALS.search(text, max(0, start - 12), start)
                    if m:
                        found["name"].append((m.start(1), end))
        for m in _AT.finditer(text):
            local, domain = _LOCAL.search(text, max(0, m.start() - 66), m.start()), _DOMAIN.match(text, m.end())
            if local and domain and (m[0] != "@" or local.end() == m.start() and not domain[0][0].isspace()):
                found["email"].append((local.start(1), domain.end(1)))
        if spelt:
            found["email"] += [m.span() for m in _SPELT.finditer(text)]
        for m in _BARE_PAN.finditer(text):
            found["id"].append(m.span())
        for m in _PHONE.finditer(text):
            before = text[max(0, m.start() - 32) : m.start()]
            if not _NOT_PHONE.search(before) or _PHONE_WORD.search(before):
                found["phone"].append(m.span())
        for m in _TITLED.finditer(text):
            found["name"].append(m.span(1))
        return found


_PART = re.compile(r"[^\s.,'’/()-]+")


def canonical(kind: str, text: str) -> str:
    """What two mentions of one entity share."""
    low = _lower(text)
    if kind == "email":
        return re.sub(r"\s?[(\[{]\s?dot\s?[)\]}]\s?| dot ", ".", re.sub(r"\s?[(\[{]\s?at\s?[)\]}]\s?| at ", "@", low))
    if kind == "phone":
        return re.sub(r"\D", "", text)[-10:]
    if kind == "id":
        return re.sub(r"[^a-z0-9]", "", low)
    return " ".join(_PART.findall(low))


def entities(text: str, spans: list[tuple[str, int, int]]) -> list[str]:
    """The entity of every mention. A name with initials means the full name of the text with that surname and
    those initials, if there is exactly one."""
    out = [canonical(kind, text[a:b]) for kind, a, b in spans]
    full = {e for (kind, _, _), e in zip(spans, out) if kind == "name" and len(e.split()) > 1 and all(len(p) > 1 for p in e.split())}
    for i, (kind, _, _) in enumerate(spans):
        parts = out[i].split()
        if kind == "name" and len(parts) > 1 and len(parts[0]) == 1:
            same = [f for f in full if f.split()[-1] == parts[-1] and all(f.startswith(p) if n == 0 else True for n, p in enumerate(parts[:-1]))]
            if len(same) == 1:
                out[i] = same[0]
    return out


_ONSET = ("b", "d", "g", "h", "k", "l", "m", "n", "p", "r", "s", "t", "v", "y", "z", "br", "dr", "kr", "sh", "tr")
_NUCLEUS = ("a", "e", "i", "o", "u")
_CODA = ("l", "m", "n", "r", "s", "v")


def _stream(key: bytes, *what: object) -> Iterator[int]:
    """Endless bytes that depend on the key and ``what`` only."""
    block = 0
    while True:
        yield from hmac.new(key, _SEP.join(map(str, (*what, block))).encode(), hashlib.sha256).digest()
        block += 1


def _word(part: str, key: bytes, role: str, turn: int) -> str:
    """Another word of the same script for part of a name: Latin syllables, for given names with the ending the
    gender suggests; letters of other scripts change within their own block and keep their marks."""
    stream = _stream(key, role, part, turn)
    if not part.isascii():
        return "".join(_same_block(c, next(stream)) for c in part)
    if len(part) == 1:
        return chr(ord("a") + next(stream) % 26)
    made = ""
    while len(made) < max(6, min(10, len(part) + 2)):
        made += _ONSET[next(stream) % len(_ONSET)] + _NUCLEUS[next(stream) % len(_NUCLEUS)]
    feminine = role == "given" and part[-1] in "aiy"
    return made[:-1] + "a" if feminine else made + _CODA[next(stream) % len(_CODA)]


def surrogate(kind: str, entity: str, key: bytes, turn: int = 0) -> str:
    """The keyed replacement of an entity, in canonical form: digits for digits and letters for letters (a PAN stays
    a person's), words for the parts of a name, the same word wherever the part stands. E-mail addresses move
    to a reserved domain; of an address the house number and the street's own name change, the kind of street,
    the town and its code stay."""
    stream = _stream(key, kind, entity, turn)
    if kind == "name":
        parts = entity.split()
        return " ".join(_word(p, key, "surname" if i and i == len(parts) - 1 else "given", turn) for i, p in enumerate(parts))
    if kind == "email":
        local = entity.split("@")[0]
        return "".join(next_letter(c, stream) for c in local) + "".join(chr(ord("a") + next(stream) % 26) for _ in range(2)) + "@example.invalid"
    if kind == "address":
        parts = entity.split()
        street = next((i for i, p in enumerate(parts) if p in _STREET_WORDS and i and parts[i - 1].isalpha()), None)
        numbered = next((i for i, p in enumerate(parts) if any(map(str.isdigit, p))), None)
        for i in range(len(parts)):
            if street is not None and i < street and parts[i].isalpha() and parts[i] not in _HOUSE_WORDS and (numbered is None or i > numbered):
                parts[i] = _word(parts[i], key, "street", turn)
            elif any(map(str.isdigit, parts[i])) and (street is None or i < street):
                parts[i] = "".join(next_letter(c, stream) if c.isdigit() else c for c in parts[i])
        return " ".join(parts)
    if kind == "id" and re.fullmatch(r"[a-z]{5}\d{4}[a-z]", entity):
        return "".join(c if i == 3 else next_letter(c, stream) for i, c in enumerate(entity))
    return "".join(next_letter(c, stream) for c in entity)


_HOUSE_WORDS = frozenset("house flat plot door shop villa apartment apt h no number cross main floor block sector phase ward".split())


def render(kind: str, mention: str, entity: str, other: str) -> str:
    """``other`` written as ``mention`` writes ``entity``: its case, separators, initials and prefixes."""
    if kind == "email":
        at = re.search(r"@|\s?[(\[{]\s?at\s?[)\]}]\s?| at ", mention, re.I)
        dot = re.search(r"\s?[(\[{]\s?dot\s?[)\]}]\s?| dot ", mention, re.I)
        local, domain = other.split("@")
        return _cased(local, mention) + (at[0] if at else "@") + domain.replace(".", dot[0] if dot else ".")
    if kind in ("phone", "id"):
        left, out = list(other), []
        for c in reversed(mention):  # a country code stays
            out.append((left.pop().upper() if c.isupper() else left.pop()) if c.isalnum() and left else c)
        return "".join(reversed(out))
    parts, old = other.split(), entity.split()
    places = list(_PART.finditer(mention))
    out, at = [], 0
    for n, m in enumerate(places):
        k = len(parts) - (len(places) - n) if len(places) < len(parts) and n == len(places) - 1 else n  # a surname behind fewer initials
        new = parts[k] if k < len(parts) else m[0]
        if len(m[0]) == 1 and k < len(old) and len(old[k]) > 1:
            new = new[0]
        out += [mention[at : m.start()], _cased(new, m[0])]
        at = m.end()
    return "".join([*out, mention[at:]])


def _cased(new: str, like: str) -> str:
    letters = [c for c in like if c.isalpha()]
    if letters and all(c.isupper() for c in letters) and (len(letters) > 1 or len(new) == 1 or any(map(str.isdigit, like))):
        return new.upper()
    return new[:1].upper() + new[1:] if like[:1].isupper() else new


def next_letter(c: str, stream: Iterator[int]) -> str:
    if c.isdigit():
        return str(next(stream) % 10)
    if c.isascii() and c.isalpha():
        return chr((ord("A") if c.isupper() else ord("a")) + next(stream) % 26)
    return c


def _same_block(c: str, by: int) -> str:
    """Another letter of the same script, near by; marks stay."""
    if not c.isalpha():
        return c
    script = unicodedata.name(c, "").split(" ")[0]
    for step in range(by % 20 + 1, 160):
        other = chr((ord(c) & ~0x7F) | ((ord(c) + step) & 0x7F))
        if other.isalpha() and other != c and other.lower() == other and unicodedata.name(other, "").split(" ")[0] == script:
            return other
    return c


def name_parts(people: DataFrame, person: str) -> tuple[DataFrame, DataFrame]:
    """Distinct given names and surnames (``w``, lower case) of known people; initials are no given names."""
    parts = people.select(F.split(F.lower(F.trim(F.col(person))), r"\s+").alias("p")).filter(F.size("p") >= 2)
    word = lambda c: parts.select(F.expr(c).alias("w")).filter("length(w) > 1 and w not like '%.'").distinct()
    return word("p[0]"), word("p[size(p) - 1]")


def _blocks(words: DataFrame, most: int) -> Iterator[frozenset[str]]:
    """The words in blocks of about ``most``, each small enough to hand out."""
    n = max(1, -(-words.count() // most))
    for i in range(n):
        yield frozenset(r["w"] for r in words.filter(F.pmod(F.xxhash64("w"), F.lit(n)) == i).collect())


def find_personal(
    docs: DataFrame, doc_id: str, text: str, people: DataFrame, person: str, key: str, names_per_pass: int = 200_000
) -> DataFrame:
    """Every mention: ``doc_id``, ``kind``, ``start_pos`` (1-based, in characters), ``n_chars``, ``mention``, ``entity``
    (what mentions of the same share) and ``surrogate``, its keyed replacement of like type, script, gender and
    format.

    One narrow pass over the whole texts finds the mentions. Surrogates are drawn once per entity of the whole
    collection and checked against all others and all real ones by a keyed join (``draw_surrogates``), so
    different entities stay different and one entity stays one, in every document. Known names are handed out in
    blocks of ``names_per_pass``; if they are more, each block gets a pass of its own and what it finds joins
    the text again.

    Defined results: null and empty texts hold nothing; repeated rows repeat their mentions; positions count
    code points of the text as stored; null ids are kept; other columns are ignored.
    """
    found = stored(_detected(docs, doc_id, text, people, person, names_per_pass), "mentions")
    drawn = draw_surrogates(found.select("kind", "entity").distinct(), key)
    shown = F.udf(render, "string", useArrow=True)
    out = found.join(drawn, ["kind", "entity"])
    return out.select(doc_id, "kind", "start_pos", "n_chars", "mention", "entity", shown("kind", "mention", "entity", "other").alias("surrogate"), "_h")


def _detected(docs: DataFrame, doc_id: str, text: str, people: DataFrame, person: str, names_per_pass: int) -> DataFrame:
    spark = docs.sparkSession
    base = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), F.md5(text).alias("_h")).filter("length(_text) > 0")
    givens, surnames = (list(_blocks(words, names_per_pass)) for words in name_parts(people, person))
    single = len(givens) == len(surnames) == 1
    if not single:  # names first, block against block
        base = stored(base, "texts")
        parts = []
        for given in givens:
            for surname in surnames:
                shared = spark.sparkContext.broadcast((given, surname))

                def search(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
                    detector = Detector(*shared.value)
                    for frame in frames:
                        rows = [(h, a, b) for h, body in zip(frame["_h"], frame["_text"]) for a, b in detector.found(body)["name"]]
                        if rows:
                            yield pd.DataFrame(rows, columns=["_h", "a", "b"])

                parts.append(base.select("_h", "_text").mapInPandas(search, "_h string, a int, b int"))
        names = parts[0]
        for part in parts[1:]:
            names = names.unionByName(part)
        base = base.join(names.groupBy("_h").agg(F.collect_set(F.struct("a", "b")).alias("_names")), "_h", "left").select("_id", "_text", "_h", "_names")
    shared = spark.sparkContext.broadcast((givens[0], surnames[0]) if single else (frozenset(), frozenset()))
    columns = [doc_id, "_h", "kind", "start_pos", "n_chars", "mention", "entity"]

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = Detector(*shared.value)
        for frame in frames:
            out = []
            known = frame["_names"] if "_names" in frame else [None] * len(frame)
            for i, body, h, names in zip(frame["_id"], frame["_text"], frame["_h"], known):
                spans = detector.spans(body, [] if names is None else [(n["a"], n["b"]) for n in names])
                out += [(i, h, kind, a + 1, b - a, body[a:b], entity) for (kind, a, b), entity in zip(spans, entities(body, spans))]
            if out:
                yield pd.DataFrame(out, columns=columns)

    return base.mapInPandas(scan, f"`{doc_id}` {dict(docs.dtypes)[doc_id]}, _h string, kind string, start_pos bigint, n_chars int, mention string, entity string")


def draw_surrogates(found: DataFrame, key: str) -> DataFrame:
    """``kind``, ``entity``, ``other`` for distinct entities. All are drawn at once; those whose draw another entity
    has (the smaller one keeps it), or that is itself a real entity, are drawn again, until none is left: the
    rounds shrink fast, since few collide."""
    secret = key.encode()
    draw = F.udf(lambda kind, entity, turn: surrogate(kind, entity, secret, turn), "string", useArrow=True)
    real = found.select("kind", F.col("entity").alias("other"))
    left, done, turn = found, None, 0
    while True:
        drawn = stored(left.select("kind", "entity", draw("kind", "entity", F.lit(turn)).alias("other")), "draws")
        taken = real if done is None else real.unionByName(done.select("kind", "other"))
        free = drawn.join(taken, ["kind", "other"], "left_anti")
        free = free.groupBy("kind", "other").agg(F.min("entity").alias("entity")).select("kind", "entity", "other")
        free = stored(free, "drawn")
        done = free if done is None else done.unionByName(free)
        left = stored(drawn.select("kind", "entity").join(free.select("kind", "entity"), ["kind", "entity"], "left_anti"), "left")
        turn += 1
        if left.isEmpty() or turn > 50:  # a kind with fewer forms than entities can't be kept apart
            return done if turn <= 50 else done.unionByName(drawn.join(left, ["kind", "entity"], "left_semi"))


def mask_personal(docs: DataFrame, doc_id: str, text: str, mentions: DataFrame, key: str) -> DataFrame:
    """Texts that hold personal information, rewritten: ``doc_id``, ``n_found``, ``masked`` (typed
    placeholders), ``surrogate`` (the replacements of ``mentions``, as found in the same texts). A placeholder
    carries a keyed tag of its entity. All else is unchanged. Null, empty and repeated rows as in
    ``find_personal``."""
    secret = key.encode()
    spots = F.array_sort(F.collect_set(F.struct("start_pos", "n_chars", "kind", "entity", "surrogate"))).alias("_spots")
    base = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), F.md5(text).alias("_h")).join(mentions.groupBy("_h").agg(spots), "_h")

    def rewrite(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for i, body, spots in zip(frame["_id"], frame["_text"], frame["_spots"]):
                masked, natural, at = [], [], 0
                for s in spots:
                    a = s["start_pos"] - 1
                    tag = hmac.new(secret, f"{s['kind']}{_SEP}{s['entity']}".encode(), hashlib.sha256).hexdigest()[:16]
                    masked += [body[at:a], f"[{s['kind'].upper()}_{tag}]"]
                    natural += [body[at:a], s["surrogate"]]
                    at = a + s["n_chars"]
                rows.append((i, len(spots), "".join([*masked, body[at:]]), "".join([*natural, body[at:]])))
            if rows:
                yield pd.DataFrame(rows, columns=[doc_id, "n_found", "masked", "surrogate"])

    return base.select("_id", "_text", "_spots").mapInPandas(rewrite, f"`{doc_id}` {dict(docs.dtypes)[doc_id]}, n_found int, masked string, surrogate string")


def session_key(spark: SparkSession) -> str:
    """The key of surrogates and tags: ``spark.lakefold.personal.key`` of the session, else a new random one for this
    application."""
    named = spark.conf.get("spark.lakefold.personal.key", None)
    if named:
        return named
    sc = spark.sparkContext
    if not getattr(sc, "_lakefold_key", None):
        sc._lakefold_key = secrets.token_hex(32)
    return sc._lakefold_key
