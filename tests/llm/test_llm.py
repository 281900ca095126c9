"""The training-data operators on small fixtures: edge rows, brute force, round trips."""

import datetime as dt
import os
import random
import re

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakefold.functions import tokens
from lakefold.llm import encoding, leakage, matching, mixing, personal, scanned, splitting, transcripts
from lakefold.llm.nearest_time import nearest_by_time

T = dt.datetime


# 1 matching ---------------------------------------------------------------------------------------
LEFT = "bse_code string, company_name string, scrip_name string, industry string, face_value double, listed_on date"
RIGHT = "nse_symbol string, company_name string, industry string, face_value double, listed_on date"
D = dt.date(2001, 1, 1)


@pytest.fixture(scope="module")
def companies(spark):
    kinds = ["Ceramics", "Telecom", "Foods", "Paper Mills"]
    houses = ["Babvuvud", "Kiwyugay", "Lelwakuy", "Hivpisel", "Nudbadoy", "Gekkafur"]
    right = [(f"{h[:7].upper()}{k[:2].upper()}", f"{h} {k} Limited", k, 10.0, D) for h in houses for k in kinds]
    left = [
        ("1", "BABV UVUD CERAMICS LTD", None, "Ceramics", 10.0, D), ("2", "Kiwyuagy Telecom", None, "Telecom", None, None), ("3", "Foods Lelwakuy (India) Ltd.", "LELWAK", None, 10.0, None),
        ("4", "Renamed Paper Mills Limited", "HIVPISEPA", None, 5.0, D), ("5", "Nudbadoy Chemicals Limited", "NUDBADOY", "Chemicals", 10.0, D), ("8", "Zuhpuril Chemicals", None, None, None, None), ("9", "Fizhuwup Chemicals", None, None, None, None), ("6", None, "X", None, None, None), (None, "Nobody Foods", None, None, None, None),
        ("7", "Gekkafur Ceramics Limited", "GEKKAFUCE", None, 10.0, D), ("7", "Gekkafur Ceramics Limited", "GEKKAFUCE", None, 10.0, D),
    ]
    return spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT).withColumn("_code", F.col("nse_symbol"))


def _match(left, right):
    return matching.match_companies(left, right, "bse_code", "nse_symbol", "scrip_name", "_code")


def test_companies_match_through_noise(companies):
    rows = _match(companies[0].withColumn("confidence", F.lit("clash")), companies[1]).collect()
    assert {(r["bse_code"], r["nse_symbol"]) for r in rows} == {("1", "BABVUVUCE"), ("2", "KIWYUGATE"), ("3", "LELWAKUFO"), ("4", "HIVPISEPA"), ("7", "GEKKAFUCE")}
    assert all(0.5 <= r["confidence"] <= 1 for r in rows) and len(rows) == 5


def test_companies_empty(companies):
    assert _match(companies[0].limit(0), companies[1]).count() == 0
    assert _match(companies[0], companies[1].limit(0)).count() == 0


def test_a_near_name_that_agrees_better_beats_the_same_name(spark, companies):
    left = companies[0].unionByName(spark.createDataFrame([("10", "Zinmorub Telecom", None, "Telecom", 10.0, D)], LEFT))
    more = spark.createDataFrame([("ZINMORUTE", "Zinmorub Telecom", None, None, None), ("ZINMOURTE", "Zinmourb Telecom", "Telecom", 10.0, D)], RIGHT)
    got = _match(left, companies[1].unionByName(more.withColumn("_code", F.col("nse_symbol")))).collect()
    assert {r["nse_symbol"] for r in got if r["bse_code"] == "10"} == {"ZINMOURTE"}


def test_large_groups_keep_pairs_without_business_words(spark, companies):
    rows = [("20", "Vudo Ceramics", None, None, 10.0, D), ("21", "Zerri", None, None, 10.0, D), ("22", "Moppa", None, None, 10.0, D), ("23", "Sukki Paper Mills", None, None, 10.0, D)]
    more = [("VUDO", "Vudo", None, 10.0, D), ("ZERRICE", "Zerri Ceramics", None, 10.0, D), ("MOPPA", "Moppa", None, 10.0, D), ("SUKKIPA", "Sukki Paper Mills", None, 10.0, D)]
    more += [(f"{s}X{i}", f"{s.title()} Foods", "Foods", 5.0, dt.date(1990, 5, 5)) for s in ("VUDO", "ZERRI", "MOPPA", "SUKKI") for i in range(260)]
    left = companies[0].unionByName(spark.createDataFrame(rows, LEFT))
    right = companies[1].unionByName(spark.createDataFrame(more, RIGHT).withColumn("_code", F.col("nse_symbol")))
    got = {(r["bse_code"], r["nse_symbol"]) for r in _match(left, right).collect()}
    assert {("20", "VUDO"), ("21", "ZERRICE"), ("22", "MOPPA"), ("23", "SUKKIPA")} <= got


def test_one_name_does_not_pair_all_its_rows(spark):
    rng = random.Random(3)
    day = lambda: dt.date(1990, 1, 1) + dt.timedelta(days=rng.randrange(9000))
    left = spark.createDataFrame([(f"L{i}", "Acmefirm Foods Ltd", "".join(rng.choices("BCDFGHKLMNPRST", k=9)), "Foods", float(rng.choice([1, 2, 10])), rng.choice([None, day()])) for i in range(300)], LEFT)
    right = spark.createDataFrame([(f"R{i}", rng.choice(["Acmefirm Foods", "Acmefirm"]), "Foods", float(rng.choice([1, 2, 10])), day()) for i in range(400)], RIGHT).withColumn("_code", F.concat(F.lit("QX"), F.col("nse_symbol"), F.lit("ZZ")))
    namer = spark.sparkContext.broadcast(["foods"])
    a, b = matching._prepared(left, "bse_code", "scrip_name", namer), matching._prepared(right, "nse_symbol", "_code", namer)
    n = matching.candidate_pairs(a, b).count()
    assert 700 <= n < 20_000


@pytest.mark.parametrize("width", [2, 3, 4])
def test_close_values_are_found_exactly(width):
    rng = random.Random(width)
    words = {"".join(rng.choices("abcdefghij", k=rng.randint(1, 11))) for _ in range(150)}
    for w in list(words):
        for _ in range(3):
            i = rng.randrange(len(w))
            words.add(rng.choice([w[:i] + w[i + 1 :], w[:i] + "k" + w[i:], w[:i] + "k" + w[i + 1 :], w[:i] + w[i + 1 : i + 2] + w[i : i + 1] + w[i + 2 :]]) or "k")
    vectors = {w: matching.vector(w) for w in words}
    rank = {}
    for v in vectors.values():
        for t in matching.bands(v):
            rank[t] = rank.get(t, 0) + 1
    keys = {w: set(matching.band_keys(v, rank, width)) for w, v in vectors.items()}
    n = 0
    for a, b in ((a, b) for a in words for b in words):
        distance = sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(vectors[a], vectors[b]))
        if distance <= matching.radius(max(len(matching.bands(vectors[a])), len(matching.bands(vectors[b])))):
            n += 1
            assert keys[a] & keys[b], (a, b)
    assert n > 3 * len(words)


@settings(max_examples=150, deadline=None)
@given(st.text("abdegiklmnoprtuvwyz", min_size=4, max_size=12), st.integers(0, 3), st.integers(0, 3), st.sampled_from("abkz"))
def test_one_typing_error_is_close(word, kind, at, letter):
    other = [word[:at] + letter + word[at + 1 :], word[:at] + letter + word[at:], word[:at] + word[at + 1 :], word[:at] + word[at + 1 : at + 2] + word[at : at + 1] + word[at + 2 :]][kind]
    assert len(matching.grams(word) ^ matching.grams(other)) <= 4


def test_confidences_are_calibrated(spark):
    """Planted truth: of the pairs at a confidence about that share is true."""
    rng = random.Random(11)
    kinds = ["Ceramics", "Telecom", "Foods", "Paper Mills", "Chemicals"]
    names = ["".join(rng.choice("bdfgjklmnprstvz") + rng.choice("aeiou") for _ in range(4)) for _ in range(700)]
    right, left = [], []
    for i, n in enumerate(names):
        kind, day, face = rng.choice(kinds), dt.date(1990, 1, 1) + dt.timedelta(days=rng.randrange(12000)), rng.choice([1.0, 2.0, 10.0])
        right.append((f"{n.upper()}{kind[:2].upper()}{i}", f"{n.title()} {kind} Limited", kind, face, day))
        if rng.random() < 0.3:  # another company of the house
            other = rng.choice([k for k in kinds if k != kind])
            right.append((f"{n.upper()}{other[:2].upper()}{i}", f"{n.title()} {other} Limited", other, rng.choice([1.0, 2.0, 10.0]), dt.date(1990, 1, 1) + dt.timedelta(days=rng.randrange(12000))))
        m = list(n)
        if rng.random() < 0.3:
            at = rng.randrange(len(m) - 1)
            m[at : at + 2] = m[at + 1], m[at]
        word = kind if rng.random() < 0.7 else ""
        left.append((str(i), f"{''.join(m).title()} {word} Ltd", rng.choice([None, f"{n.upper()}{kind[:2].upper()}{i}"[: rng.randint(6, 11)]]), rng.choice([None, kind]), rng.choice([None, face]), rng.choice([None, day, day])))
    got = _match(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT).withColumn("_code", F.col("nse_symbol"))).collect()
    true = {str(i): {r[0] for r in right if r[0].endswith(str(i)) and r[1].lower().startswith(names[i])} for i in range(700)}
    first = {str(i): next(r[0] for r in right if r[1].lower().startswith(names[i]) and re.search(rf"[A-Z]{i}$", r[0])) for i in range(700)}
    hits = [(r["confidence"], first[r["bse_code"]] == r["nse_symbol"]) for r in got]
    assert true and len(hits) >= 630
    for low, high in ((0.5, 0.9), (0.9, 1.01)):
        part = [(c, h) for c, h in hits if low <= c < high]
        if len(part) >= 20:
            assert abs(sum(c for c, _ in part) / len(part) - sum(h for _, h in part) / len(part)) < 0.15
    assert sum(h for _, h in hits) / len(hits) > 0.95


def test_matching_gathers_no_growing_table_on_the_driver(companies, monkeypatch):
    plans, real = {}, matching.stored
    monkeypatch.setattr(matching, "stored", lambda df, name, **o: (plans.update({name: df._jdf.queryExecution().sparkPlan().toString()}), real(df, name, **o))[1])
    assert _match(*companies).count() > 3
    assert all("Join" in plans[n] and "Broadcast" not in plans[n] for n in ("close", "candidates"))
    assert plans["pairs"].count("SortMergeJoin") == 2  # with the candidates; business words and industries may be broadcast


# 2 splitting --------------------------------------------------------------------------------------
@settings(max_examples=150, deadline=None)
@given(st.text("ab .\n#-é", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_pieces_cover_overlap_and_keep_the_limit(body, limit, overlap):
    spans = splitting.split_text(body, limit, overlap)
    if not body:
        assert spans == []
        return
    assert spans[0][0] == 0 and spans[-1][1] == len(body)
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert a < c <= b < d and b - c <= overlap
    assert all(b - a <= limit for a, b in spans)


def test_pieces_prefer_paragraphs_then_sentences():
    body = "First one here. Second one here.\n\nThird paragraph goes on and on."
    assert body[: splitting.split_text(body, 40, 0)[0][1]] == "First one here. Second one here.\n\n"
    assert splitting.split_text("x" * 100, 30, 0)[0] == (0, 30)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=30), min_size=1, max_size=60), st.sampled_from([" ", "\n\n", ". "]))
def test_pieces_with_another_size(words, between):
    body = between.join(words)
    size = lambda s: len(s.strip()) // 3 + 1
    spans = splitting.split_text(body, 12, 3, size)
    assert spans[0][0] == 0 and spans[-1][1] == len(body)
    assert all(x[1] >= y[0] > x[0] and y[1] > x[1] for x, y in zip(spans, spans[1:]))


@pytest.mark.skipif(not os.path.exists(tokens.TOKENIZER), reason="no tokenizer here")
def test_pieces_in_tokens(spark):
    rng = random.Random(2)
    word = lambda: rng.choice(["the", "dividend", "of ₹12.50", "per share", "वार्षिक", "approved.\n\n", "Supercalifragilistic" * 8, "x"])
    texts = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((1, 40, 400, 900))]
    df = spark.createDataFrame(texts, "rec_id long, text string")
    rows = splitting.split_oversized(df, ["rec_id"], "text", 120, 20, tokens.TOKENIZER).collect()
    enc = tokens.encoding(tokens.TOKENIZER)
    for i, body in texts:
        mine = sorted((r for r in rows if r["rec_id"] == i), key=lambda r: r["piece"])
        assert all(len(enc.encode_ordinary(r["piece_text"])) == r["size"] <= 120 for r in mine) and len(mine) == mine[0]["n_pieces"]
        spans = [(r["start_pos"] - 1, r["start_pos"] - 1 + r["n_chars"]) for r in mine]
        assert spans[0][0] == 0 and spans[-1][1] == len(body)
        assert all(c <= b and len(enc.encode_ordinary(body[c:b])) <= 20 for (_, b), (c, _) in zip(spans, spans[1:]))


def test_split_edges(spark):
    long = "word " * 2000
    df = spark.createDataFrame([(1, long), (1, long), (2, None), (3, ""), (4, "short"), (None, "null key")], "rec_id long, text string").withColumn("piece", F.lit("clash"))
    got = splitting.split_oversized(df, ["rec_id"], "text", 3200, 280).collect()
    assert {r["rec_id"] for r in got} == {1, 4, None}
    assert max(r["n_chars"] for r in got) <= 3200 and sum(r["piece"] == 1 for r in got if r["rec_id"] == 1) == 2
    assert splitting.split_oversized(df.limit(0), ["rec_id"], "text").count() == 0


# 3 transcripts ------------------------------------------------------------------------------------
ROSTER = [("Moderator", "Operator"), ("Ann Lee", "Managing Director"), ("Bob Ray", "Analyst"), ("Cara Ray", "Analyst")]


def _turns(spark, *texts, roster=ROSTER):
    calls = spark.createDataFrame([(i, p, t, T(2024, 1, 1)) for i, (p, t) in enumerate(texts)], "call_id long, period string, text string, loaded_at timestamp_ntz")
    people = spark.createDataFrame([(i, s, j, None) for i in range(len(texts)) for s, j in roster], "call_id long, speaker string, job string, firm string")
    return sorted(tuple(r) for r in transcripts.speaker_turns(calls.withColumn("speaker", F.lit("clash")), people).select("call_id", "turn", "speaker", "period", "text").collect())


def test_turns_styles_noise_and_merging(spark):
    body = (
        "Some Company\nANN LEE – MANAGING DIRECTOR\n\n[00:00:10] OPERATOR: Welcome um, all.\n[00:00:20] **Ann Lee:** Hello hello there\nOutlook: stable.\nPage 3 of 9\n"
        "Lee, Ann: more (laughter) words\n>> B. Ray: [inaudible]\n## **Bob Ray – Analyst, X Capital**\nA question?\nMr. Cara Ray (Analyst): You know, hm\nDr. Lee: Yes"
    )
    got = _turns(spark, ("Q1FY24", body))
    assert [(s, x) for _, _, s, _, x in got] == [
        ("Moderator", "Welcome all."), ("Ann Lee", "Hello there Outlook: stable. more words"), ("Bob Ray", "A question?"), ("Ann Lee", "Yes"),
    ]
    assert [t for _, t, *_ in got] == [1, 2, 3, 4] and got[0][3] == "Q1 FY2024"


def test_turns_follow_the_stated_times(spark):
    got = _turns(spark, (None, "(2:00) Bob Ray: third\n(3:00) Ann Lee: fourth\n(0:10) Ann Lee: first\nCara Ray: second"))
    assert [x for *_, x in got] == ["first", "second", "third", "fourth"]


def test_long_labels_and_annotations(spark):
    name = "Maria Anna Sophia de la Cruz Obregon"
    body = f"{name}: one [{'background noise ' * 9}] two (long {'very ' * 20}applause here) three\n**{name} - Chief Executive Officer, {'Some Company and Sons ' * 8}**\nfour\nBob Ray: five"
    got = _turns(spark, (None, body), roster=[*ROSTER, (name, "CEO")])
    assert [(s, x) for *_, s, _, x in got] == [(name, "one two three four"), ("Bob Ray", "five")]


def test_turns_edges(spark):
    assert _turns(spark, ("x", None), ("x", ""), ("x", "no label at all"), ("x", "Um, uh... [music]")) == []
    twice = spark.createDataFrame([(1, None, "Ann Lee: old", T(2024, 1, 1)), (1, None, "Ann Lee: new", T(2024, 1, 2))], "call_id long, period string, text string, loaded_at timestamp_ntz")
    people = spark.createDataFrame([(1, "Ann Lee", "MD", None), (1, None, None, None), (2, "Bob", None, None)], "call_id long, speaker string, job string, firm string")
    assert [r["text"] for r in transcripts.speaker_turns(twice, people).collect()] == ["new"]
    assert transcripts.speaker_turns(twice.limit(0), people).count() == 0


def test_periods(spark):
    want = {"Q1-2023-24": "Q1 FY2024", "2QFY24": "Q2 FY2024", "Q3FY21": "Q3 FY2021", "Q4 FY2022": "Q4 FY2022", "Nov 2023": "Q2 FY2024", "may_2021": "Q4 FY2021", "february 2020": "Q3 FY2020", "soon": None, None: None}
    for k, v in want.items():
        assert spark.range(1).select(transcripts.common_period(F.lit(k)).alias("v")).first()["v"] == v


# 4 scanned pages ----------------------------------------------------------------------------------
VOCABULARY = "through the board approved clearances debt free demand annual report alpha limited and was it of dealer line page one two modern".split()


def _scan(spark, *texts):
    """The texts among fifty records that hold the vocabulary."""
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, " ".join([*VOCABULARY, str(i)])) for i in range(50)]
    got = scanned.repair_scanned(spark.createDataFrame(rows, "rec_id long, text string"), ["rec_id"], "text")
    out = {r["rec_id"]: (set(r["noise"]), r["repaired"]) for r in got.collect()}
    return [out[i] for i in range(len(texts))]


def test_scanned_kinds_and_repair(spark):
    noisy, clean, short, letters = _scan(
        spark, "Annual Report Alpha Limited\nThe board approved debt-\nfree cle-\n- 4 -\nANNUAL REP0RT ALPHA LIMITED\n\nararices throuqh\n\ndemand.",
        "The board approved demand through the dealer.", "One Two Report\nthe board", "the app?oved appr4ved board",
    )
    assert noisy == ({"header", "page_number", "hyphenation", "characters"}, "The board approved debt-free clearances through demand.")
    assert clean == (set(), "The board approved demand through the dealer.") and short[0] == set()
    assert letters == (set(), "the app?oved appr4ved board")


def test_a_word_with_any_sign_inside_is_one_edit_away(spark):
    assert _scan(spark, "the appro8ed board", "rep5rt of the alpha limi†ed") == [({"characters"}, "the approved board"), ({"characters"}, "report of the alpha limited")]


def test_context_ranks_the_candidates(spark):
    rows = [(i, f"light grain came {i}") for i in range(20)] + [(100 + i, f"the groin stood {i}") for i in range(25)]
    rows += [(900, "light gr!in came"), (901, "the gr!in stood"), (902, "odd gr!in")]
    got = {r["rec_id"]: r["repaired"] for r in scanned.repair_scanned(spark.createDataFrame(rows, "rec_id long, text string"), ["rec_id"], "text").collect()}
    assert (got[900], got[901], got[902]) == ("light grain came", "the groin stood", "odd groin")


def test_readings_do_not_depend_on_the_size(spark):
    """A misreading as frequent as it likes is read as the word that is three times as frequent."""
    few, many = ([(i, f"ten crore rupees {i}") for i in range(3 * n)] + [(10_000 + i, f"ten crorc rupees {i}") for i in range(n)] for n in (2, 150))
    for rows in (few, many):
        got = scanned.repair_scanned(spark.createDataFrame(rows, "rec_id long, text string"), ["rec_id"], "text")
        assert {r["repaired"].rsplit(" ", 1)[0] for r in got.collect()} == {"ten crore rupees"}


@settings(max_examples=60, deadline=None)
@given(st.text("abcd", min_size=1, max_size=6), st.integers(0, 2))
def test_automaton_is_complete(word, k):
    rng = random.Random(1)
    words = {"".join(rng.choice("abcd") for _ in range(rng.randint(1, 6))): 1 for _ in range(150)}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
        return row[-1]

    assert scanned.within(word, scanned.trie(words), k) == {w: distance(word, w) for w in words if distance(word, w) <= k}


@settings(max_examples=60, deadline=None)
@given(st.sampled_from(["clearance", "modern", "building", "million", "height"]), st.lists(st.tuples(st.integers(0, 20), st.integers(0, 30)), max_size=3))
def test_misreadings_are_found_by_the_automaton(word, errors):
    root, seen, n = scanned.trie(["clearance", "modern", "building", "million", "height", "dear"]), word, 0
    for at, which in errors:
        meant = [c for c in scanned.CONFUSIONS if seen.startswith(c[1], at % len(seen))]
        if meant and seen == word or meant and at % len(seen) > len(seen) // 2:
            got, was = meant[which % len(meant)]
            at %= len(seen)
            seen, n = seen[:at] + got + seen[at + len(was) :], n + 1
    if seen != word:
        assert scanned.skeleton(seen) == scanned.skeleton(word)
        assert word in scanned.readings(seen, root, 6)


def test_scanned_edges(spark):
    df = spark.createDataFrame([(1, "the board\n12\nthe board"), (2, None), (3, ""), (1, "the board\n12\nthe board"), (4, "the board " * 20000)], "rec_id long, text string").withColumn("noise", F.lit(1))
    got = {(r["rec_id"], tuple(r["noise"])) for r in scanned.repair_scanned(df, ["rec_id"], "text").collect()}
    assert got == {(1, ("page_number",)), (2, ()), (3, ()), (4, ())}
    assert scanned.repair_scanned(df.limit(0), ["rec_id"], "text").count() == 0


# 5 nearest time -----------------------------------------------------------------------------------
def _nearest(left, right, tolerance, slice_us):
    out = {}
    for i, e, t in left:
        best = min(((abs(t - u), u, k) for k, f, u in right if f == e and None not in (e, t, u, k) and abs(t - u) <= tolerance), default=None) if None not in (i, e, t) else None
        if best:
            out[i] = (best[2], best[0])
    return out


@pytest.mark.parametrize("seed,slice_s", [(1, 10), (2, 3), (3, 200), (4, 1)])
def test_nearest_against_brute_force(spark, seed, slice_s):
    rng = random.Random(seed)
    left = [(i, rng.choice("ABC"), rng.randint(-200, 400)) for i in range(60)] + [(900, None, 5), (901, "A", None)]
    right = [(k, rng.choice(["A", "A", "A", "B"]), rng.randint(-200, 400)) for k in range(80)] + [(100, "A", 7), (99, "A", 7), (99, "A", 7), (98, None, 7), (97, "B", None)]
    at = lambda t: None if t is None else T(1970, 1, 1) + dt.timedelta(seconds=t)
    a = spark.createDataFrame([(i, e, at(t)) for i, e, t in left], "id long, e string, t timestamp_ntz").withColumn("k", F.lit("clash"))
    b = spark.createDataFrame([(k, e, at(t)) for k, e, t in right], "k long, e string, t timestamp_ntz").withColumn("id", F.lit("clash"))
    got = {r["id"]: (r["k"], r["distance_us"] // 10**6) for r in nearest_by_time(a, b, "e", "t", "t", "id", "k", 20 * 10**6, slice_s * 10**6).collect()}
    assert got == _nearest(left, right, 20, slice_s)
    assert nearest_by_time(a.limit(0), b, "e", "t", "t", "id", "k", 10).count() == 0 == nearest_by_time(a, b.limit(0), "e", "t", "t", "id", "k", 10).count()


# 6 encodings --------------------------------------------------------------------------------------
CORRECT = ["Cafés & Hospitality", "CÂMARA Fria – Cold Chain", "“Green” Power", "वस्त्र – Textiles", "Gold (₹)", "Ångström ≥ 5", "Русский текст", "Ελληνικά", "plain", "a\xa0b", "25 °C ± 1", "naïve—really"]


@pytest.mark.parametrize("text", CORRECT)
def test_correct_text_is_no_case(text):
    assert encoding.repair(text) == (False, text)


@pytest.mark.parametrize("text", [t for t in CORRECT[:6]])
@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "mac_roman", "cp437"])
def test_round_trip_through_a_wrong_decoding(text, wrong):
    once = encoding._decode(text.encode("utf-8"), wrong)
    assert encoding.repair(once) == (True, text)
    if wrong == "cp1252":
        assert encoding.repair(encoding._decode(once.encode("utf-8"), wrong)) == (True, text)


def test_encoding_edges(spark):
    df = spark.createDataFrame([(1, "CafÃ©"), (1, "CafÃ©"), (2, None), (3, ""), (4, "Caf�"), (5, "Cafйs"), (6, "A &amp; B"), (7, "x" * 50000 + "Ã©")], "rec_id long, t string").withColumn("original", F.lit(0))
    got = sorted((r["rec_id"], r["restored"][-4:], r["restorable"]) for r in encoding.repair_encoding(df, "rec_id", "t").collect())
    assert got == [(1, "Café", True), (1, "Café", True), (4, "Caf�", False), (5, "afés", True), (7, "xxxé", True)]
    arrays = spark.createDataFrame([(1, ["ok", None, "Ã©"]), (2, None)], "rec_id long, t array<string>")
    assert [r["restored"] for r in encoding.repair_encoding(arrays, "rec_id", "t").collect()] == ["é"]


@pytest.mark.parametrize("text,right,wrong", [("Привет", "cp1251", "latin-1"), ("Привет, мир", "koi8-r", "latin-1"), ("你好世界", "gbk", "latin-1"), ("Ελληνικά", "iso8859-7", "latin-1"), ("Ångström Optics", "cp1252", "cp1251")])
def test_other_encodings(text, right, wrong):
    assert encoding.repair(encoding._decode(text.encode(right), wrong)) == (True, text)


def test_a_lost_byte_costs_one_character():
    text = "Énergie – “santé” à côté"
    for errors in ("ignore", "replace"):
        damaged, best = encoding.repair(text.encode().decode("cp1252", errors))
        assert damaged and best.replace("�", "") == text.replace("”", "") and "�" in best


def test_many_readings_end(spark):
    text = " ".join(encoding._decode(w.encode("utf-8"), "cp1252") for w in CORRECT * 20)
    assert encoding.repair(text) == (True, " ".join(CORRECT * 20))


def test_batches_without_damage(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        clean = spark.createDataFrame([(i, t) for i, t in enumerate(CORRECT)], "rec_id long, t string").coalesce(1)
        assert encoding.repair_encoding(clean, "rec_id", "t").count() == 0
        mixed = clean.unionByName(spark.createDataFrame([(99, "CafÃ©")], "rec_id long, t string")).coalesce(1)
        assert [r["restored"] for r in encoding.repair_encoding(mixed, "rec_id", "t").collect()] == ["Café"]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


# 8 leakage ----------------------------------------------------------------------------------------
def _leaks(docs, items, window=20, span=10):
    """From the statement: a stretch of the item's words stands in the document word against word, all of it inside,
    its first and last words agree, and no ``span`` words of it hold two changed ones."""
    out = {}
    for i, t in items:
        w = leakage.words(t)
        for d, x in docs:
            v = leakage.words(x or "")
            for off in range(-len(w), len(v)):
                for s in range(max(0, -off), len(w)):
                    changed = []
                    for e in range(s, min(len(w), len(v) - off)):
                        if v[off + e] != w[e]:
                            if e == s or changed and e - changed[-1] < span:
                                break
                            changed.append(e)
                        elif e - s + 1 >= window:
                            out[i, d] = max(out.get((i, d), 0), e - s + 1)
    return out


def test_leaks_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(15, 60)))) for i in range(12)]
    docs = []
    for d in range(60):
        i, t = rng.choice(items)
        w = t.split()
        a = rng.randint(0, max(0, len(w) - 15))
        part = w[a : a + rng.randint(12, 40)]
        for _ in range(rng.randint(0, 4)):
            part[rng.randrange(len(part))] = "changed"
        noise = [rng.choice(vocabulary) for _ in range(30)]
        docs.append((d, " ".join([*noise[:15], "<b>", ", ".join(part).upper().replace("W", "w").upper(), "</b>\n", *noise[15:]])))
    docs += [(900, None), (901, "")]
    a = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    b = spark.createDataFrame([*items, (99, None), (98, "too short"), (97, "")], "item_id long, text string")
    rows = leakage.leaked_passages(a, b, "doc_id", "item_id").collect()
    want = _leaks(docs, items)
    assert want and {(r["item_id"], r["doc_id"]): r["n_words"] for r in rows} == want and len(rows) == len(want)
    two = leakage.leaked_passages(a, b, "doc_id", "item_id", items_per_pass=5)
    assert {(r["item_id"], r["doc_id"]): r["n_words"] for r in two.collect()} == want
    assert leakage.leaked_passages(a.limit(0), b, "doc_id", "item_id").count() == 0 == leakage.leaked_passages(a, b.limit(0), "doc_id", "item_id").count()


def test_leak_index_is_read_in_small_parts(spark, monkeypatch):
    rng = random.Random(6)
    docs = [(d, " ".join(f"w{rng.randrange(400)}" for _ in range(60))) for d in range(60)]
    a, b = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame([(d, docs[d][1]) for d in (3, 50)], "item_id long, text string")
    paths, real, keep = [], leakage.build_index, leakage.stored
    monkeypatch.setattr(leakage, "build_index", lambda *x: real(*x, segment_docs=1))
    monkeypatch.setattr(leakage, "stored", lambda df, *x, **y: (paths.append((out := keep(df, *x, **y)).inputFiles()), out)[1])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r["doc_id"], r["item_id"]) for r in leakage.leaked_passages(a, b, "doc_id", "item_id").collect()} == {(3, 3), (50, 50)}
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    meta = pq.ParquetFile(paths[0][0].removeprefix("file:")).metadata
    assert meta.num_rows == 60 and max(meta.row_group(i).num_rows for i in range(meta.num_row_groups)) <= 16
    size = {d: len(t) for d, t in docs} | {99: 5000}
    a = a.unionByName(spark.createDataFrame([(99, "x" * 5000)], "doc_id long, text string"))
    parts = [r["docs"] for r in real(a.coalesce(1), "doc_id", "text", segment_chars=1000).select("docs").collect()]
    assert sorted(d for p in parts for d in p) == sorted(size) and all(len(p) == 1 or sum(size[d] for d in p) <= 1000 for p in parts) and len(parts) < 61



def test_lengths_kinds_and_markup(spark, monkeypatch):
    w = [f"word{i}" for i in range(60)]
    link = '<a href="https://example.org/' + "x" * 140 + '">'
    docs = [
        (1, " ".join(["x", *w[10:28], "y"])), (2, " ".join([*w[:19], "y"])), (3, " ".join(["x", *w[10:40], "y"])), (4, " ".join([*w[10:20], link, *w[20:30]])),
        (5, " ".join([*w[5:15], "other", *w[16:26]])), (6, " ".join([*w[5:15], "other", *w[16:20], "more", *w[21:26]])), (7, " ".join(w)), (8, " ".join(["other", *w[11:30]])),
    ]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(w)), (2, " ".join(reversed(w)))], "item_id long, text string")
    built = []
    real = leakage.build_index
    monkeypatch.setattr(leakage, "build_index", lambda *x, **y: built.append(1) or real(*x, **y))
    got = {r["doc_id"]: (r["n_words"], r["kind"], r["item_word"], r["doc_word"]) for r in leakage.leaked_passages(a, b, "doc_id", "item_id", items_per_pass=1).collect()}
    assert got == {3: (30, "exact", 11, 2), 4: (20, "exact", 11, 1), 5: (21, "proximity", 6, 1), 7: (60, "exact", 1, 1)} and len(built) == 1


def test_sure_run():
    for window, span in ((20, 10), (12, 5), (9, 3), (7, 10)):
        best = window
        for mask in range(2**min(window, 12)):
            ok = [not mask >> i & 1 for i in range(window)]
            if all(ok[i : i + span].count(False) <= 1 for i in range(max(1, window - span + 1))):
                best = min(best, max(map(len, "".join("x" if o else " " for o in ok).split()), default=0))
        if window <= 12:
            assert leakage.sure_run(window, span) == best


# 9 mixing -----------------------------------------------------------------------------------------
def _mix(spark, sources, targets, **more):
    rows = [(i, s, " ".join(["token"] * n)) for i, (s, n) in enumerate(sources)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("copy", F.lit("clash"))
    plan = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    return mixing.mix_to_targets(docs, plan, "doc_id", "source", "text", **more), plan


def test_mixture_holds_its_shares(spark):
    sources = [("a", 10)] * 300 + [("B ", 10)] * 100 + [("c-d", 5)] * 40 + [(None, 10)] * 5 + [("unknown", 10)]
    mixed, plan = _mix(spark, sources, [("a", 0.5, 1), ("b", 0.3, 2), ("c_d", 0.2, 4), ("none", 0.1, 4), ("zero", 0.0, 1)])
    shares = {r["source"]: r for r in mixing.mixture_shares(mixed, plan).collect()}
    for s, target in (("a", 0.5), ("b", 0.3), ("c_d", 0.2)):
        assert shares[s]["actual_share"] == pytest.approx(target, abs=0.01)
        assert shares[s]["most_copies"] <= {"a": 1, "b": 2, "c_d": 4}[s]
    assert shares["none"]["n_rows"] == 0
    rows = mixed.collect()
    assert len({(r["doc_id"], r["copy"]) for r in rows}) == len(rows)
    assert {r["copy"] for r in rows if r["source"] == "c_d"} == {1, 2, 3, 4}


def test_mixture_budget_and_edges(spark):
    mixed, _ = _mix(spark, [("a", 10)] * 50 + [("b", 10)] * 5, [("a", 0.5, 1), ("b", 0.5, 2)], budget=300)
    total = {r["source"]: r["sum(n_tokens)"] for r in mixed.groupBy("source").sum("n_tokens").collect()}
    assert total == {"a": 200, "b": 100}
    empty, plan = _mix(spark, [("a", 1)], [("z", 1.0, 1)])
    assert empty.count() == 0 and mixing.mixture_shares(empty, plan).first()["actual_share"] == 0.0
    rows = sorted(mixed.collect(), key=lambda r: r["running"])
    assert [r["finish"] for r in rows] == sorted(r["finish"] for r in rows)
    assert rows[-1]["running"] == 300 == sum(r["n_tokens"] for r in rows)
    again, _ = _mix(spark, [("a", 10)] * 50 + [("b", 10)] * 5, [("a", 0.5, 1), ("b", 0.5, 2)], budget=300, slices=3)
    assert again.count() == mixed.count()


# 10 personal information --------------------------------------------------------------------------
DETECT = personal.Detector(frozenset({"wenmaya", "osvin"}), frozenset({"wadhvelor", "daskelmi"}))
TEXT = (
    "Mr. Wenmaya Wadhvelor (residing at House No. 252-6,\nNeemali Nagar,\nYervanagar) wrote to o.daskelmi+ir [at] mail [dot] example [dot] org or call +91 28223 25407 / (0171) 555 7144. "
    "PAN No.: abcpd1234e, DIN - 63164411, licence no. - AN71 95291814279; osvin daskelmi and E. WADHVELOR. Order no. 664138-5769, Application no. 207432711698, @alvor on the day, GSTIN 00AAAPA5045A0Z5, Daskelmi & Co, Plot area is 1379."
)


def test_detection():
    got = [(k, TEXT[a:b]) for k, a, b in DETECT.spans(TEXT)]
    assert got == [
        ("name", "Wenmaya Wadhvelor"), ("address", "House No. 252-6,\nNeemali Nagar,\nYervanagar"), ("email", "o.daskelmi+ir [at] mail [dot] example [dot] org"),
        ("phone", "+91 28223 25407"), ("phone", "(0171) 555 7144"), ("id", "abcpd1234e"), ("id", "63164411"), ("id", "AN71 95291814279"), ("name", "osvin daskelmi"), ("name", "E. WADHVELOR"),
    ]


PEOPLE = [("Osvin Daskelmi",), ("Wenmaya Wadhvelor",), ("राहुल शर्मा",), ("Moderator",), (None,), ("Li Om",)]


def _personal(spark, *texts, people=PEOPLE, key="k", **more):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("kind", F.lit(0))
    lexicon = spark.createDataFrame(people, "speaker string")
    found = personal.find_personal(df, "doc_id", "text", lexicon, "speaker", key, **more)
    masked = {r["doc_id"]: r for r in personal.mask_personal(df, "doc_id", "text", found, key).collect()}
    return sorted(found.drop("_h").collect(), key=lambda r: (r["doc_id"], r["start_pos"])), masked


def test_surrogates_keep_format_script_and_coreference(spark):
    bodies = (
        "Osvin Daskelmi met Wenmaya Wadhvelor; OSVIN DASKELMI and O. Daskelmi left. Call 3317800468 or +91 33178 00468.",
        "Then O. Daskelmi wrote; Osvin Daskelmi lives at 12, Long Road, Pune 411001. PAN: ABCPD1234E, mail osvin [at] mail [dot] example [dot] org.",
        "नमस्ते राहुल शर्मा जी, O. Daskelmi. Li Om too.",
    )
    found, masked = _personal(spark, *bodies)
    by = {(r["doc_id"], r["mention"]): r["surrogate"] for r in found}
    full = by[0, "Osvin Daskelmi"]
    assert by[0, "OSVIN DASKELMI"] == full.upper() and by[1, "Osvin Daskelmi"] == full
    assert by[0, "O. Daskelmi"] == by[1, "O. Daskelmi"] == f"{full[0]}. {full.split()[1]}"
    assert by[2, "O. Daskelmi"].split()[1] == full.split()[1]  # nobody's initials here, the surname is the same
    assert by[0, "Wenmaya Wadhvelor"].split()[0].endswith("a") and (2, "Li Om") in by
    assert re.fullmatch(r"\+91 \d{5} \d{5}", by[0, "+91 33178 00468"]) and re.sub(r"\D", "", by[0, "+91 33178 00468"])[2:] == by[0, "3317800468"] != "3317800468"
    assert re.fullmatch(r"\d\d, [A-Z][a-z]+ Road, Pune 411001", by[1, "12, Long Road, Pune 411001"])
    assert re.fullmatch(r"[A-Z]{3}P[A-Z]\d{4}[A-Z]", by[1, "ABCPD1234E"]) and by[1, "osvin [at] mail [dot] example [dot] org"].endswith(" [at] example [dot] invalid")
    hindi = by[2, "राहुल शर्मा"]
    assert all("\u0900" <= c <= "\u097f" or c == " " for c in hindi) and [len(w) for w in hindi.split()] == [5, 5]
    for i, body in enumerate(bodies):
        plain = re.sub(r"\[[A-Z]+_[0-9a-f]{16}\]", "\0", masked[i]["masked"])
        assert re.fullmatch(re.escape(plain).replace("\0", "(.+)"), body, re.S)
        assert re.fullmatch(re.escape(plain).replace("\0", "(.+)"), masked[i]["surrogate"], re.S)
    again, other = _personal(spark, *bodies)[0], _personal(spark, *bodies, key="other")[0]
    assert again == found and all(a["surrogate"] != b["surrogate"] for a, b in zip(found, other) if a["kind"] != "address")


def test_surrogates_stay_distinct(spark, monkeypatch):
    """Drawn from few forms, so that many collide; every entity still gets its own, and none a real one."""
    monkeypatch.setattr(personal, "surrogate", lambda kind, entity, key, turn=0: str((int(entity) * 7 + turn * 13) % 97))
    entities = spark.createDataFrame([("id", str(i)) for i in range(40)], "kind string, entity string")
    got = personal.draw_surrogates(entities, "k").collect()
    assert len(got) == 40 == len({r["other"] for r in got}) and not {r["other"] for r in got} & {str(i) for i in range(40)}


def test_names_in_blocks_give_the_same(spark):
    bodies = ["Osvin Daskelmi met Wenmaya Wadhvelor.", "W. Wadhvelor", None, "", "x " * 50000 + "Osvin Daskelmi"]
    assert _personal(spark, *bodies) == _personal(spark, *bodies, names_per_pass=1)


def test_personal_edges(spark):
    found, masked = _personal(spark, TEXT, TEXT, None, "", "x " * 50000 + "Osvin Daskelmi")
    assert len(found) == 21 and (4, "name", 100001) in {(r["doc_id"], r["kind"], r["start_pos"]) for r in found}
    assert masked.keys() == {0, 1, 4} and masked[0]["masked"] == masked[1]["masked"]
    assert _personal(spark, people=[("A",)])[0] == []
