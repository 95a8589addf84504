"""Each operator on odd rows, and against brute force where SQL can't say what it does."""

import hashlib
import io
import json
import random
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F

from pagerefine.llm import decontamination, jaccard_join, queries, secrets, substring_dedup, warc
from pagerefine.llm import quality_rules as quality_rules_module
from pagerefine.llm._common import documents
from pagerefine.llm.bpe import bpe_decode, bpe_encode, bpe_round_trip, codec
from pagerefine.llm.decontamination import clean_documents, decontaminate, find_matches
from pagerefine.llm.graph import connected_components
from pagerefine.llm.jaccard_join import keep_one_of_each, similar_groups
from pagerefine.llm.language_id import UNKNOWN, fit_profiles, identify_languages, keep_identified, predict_language
from pagerefine.llm.licenses import LicenseIndex, license_words, scan_licenses
from pagerefine.llm.quality_rules import quality_rules
from pagerefine.llm.secrets import RULES, BlobLedger, Rule, redact_secrets, scan_secrets, secret_report
from pagerefine.llm.substring_dedup import chains, common, minimizers, repeated_passages
from pagerefine.llm.token_counts import Counter as Counting
from pagerefine.llm.token_counts import token_counts
from pagerefine.llm.words import hashed_words
from tests.conftest import DATA

BPE = public_tokenizers.path("byte_bpe_50k.json")
#: Columns that clash with names the operators use within.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, n int, sid string, kind string, value string, row string, path string"
LONG = " ".join(f"word{i % 997}x{i % 13}" for i in range(30_000))


def rows(spark, *pairs):
    out = [(i, t, "en", "s", None if t is None else len(t), "h", 1, "sid", "k", "v", "r", "p") for i, t in pairs]
    return spark.createDataFrame(out, SCHEMA)


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "x"), (5, LONG), (6, "same words here in this text"), (6, "same words here in this text"), (None, "no id but text"), (7, "日本 ünï 😀 <|endoftext|>"), (8, "same words here in this text")]


@pytest.fixture(scope="module")
def odd(spark):
    return rows(spark, *ODD).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return rows(spark)


@pytest.mark.parametrize(
    "run",
    [identify_languages, lambda d: similar_groups(d, 3, 90), scan_licenses, repeated_passages, scan_secrets, lambda d: bpe_round_trip(d, BPE), lambda d: token_counts(d, BPE), quality_rules],
    ids=["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8"],
)
def test_empty_table(run, empty):
    assert run(empty).count() == 0


@pytest.mark.parametrize(
    "run", [identify_languages, lambda d: similar_groups(d, 3, 90), scan_secrets, lambda d: bpe_round_trip(d, BPE), lambda d: token_counts(d, BPE), quality_rules], ids=["op1", "op2", "op5", "op6", "op7", "op8"]
)
def test_one_row_for_each_odd_row(run, odd):
    assert Counter(r.doc_id for r in run(odd).collect()) == Counter(i for i, _ in ODD)


# --- the queries with SQL ------------------------------------------------------------------------------------------
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(name, same_as_sql):
    same_as_sql(queries.QUERIES[name], queries.ORACLE_SQL[name])


# --- 1 --------------------------------------------------------------------------------------------------------------
def test_language_accuracy_on_held_out(spark):
    docs = documents(spark, str(DATA))
    found = identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(found) > 20 and sum(r.lang == r.lang_pred for r in found) >= 0.95 * len(found)
    assert all(0 <= r.score <= 1 for r in found)


def test_language_like_brute_force(spark):
    """Profiles and out-of-place distances, counted n-gram by n-gram, give the same languages and scores."""
    docs = documents(spark, str(DATA)).limit(60).collect()
    size = 40

    def grams(text):
        padded = "\x01" + "".join(c if c.isalpha() else "\x01" for c in text.lower()) + "\x01"
        found = [padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1)]
        return Counter(g for g in found if g.strip("\x01") and (len(g) < 3 or g[1] != "\x01"))

    def ranked(counts):
        order = lambda g: sum(ord(c) << 21 * i for i, c in enumerate(reversed(g)))
        return sorted(counts, key=lambda g: (-counts[g], order(g)))[:size]

    totals = defaultdict(Counter)
    for r in docs:
        if r.text and r.lang:
            totals[r.lang] += grams(r.text)
    profiles = {k: {g: i for i, g in enumerate(ranked(c))} for k, c in totals.items()}
    table = spark.createDataFrame(docs)
    found = {r.doc_id: (r.lang_pred, r.score) for r in predict_language(table, fit_profiles(table, size=size)).collect()}
    for r in docs:
        own = ranked(grams(r.text or ""))
        if not own:
            assert found[r.doc_id] == (UNKNOWN, 0.0)
            continue
        gaps = {k: sum(abs(p[g] - i) if g in p else size for i, g in enumerate(own)) for k, p in profiles.items()}
        best = min(sorted(gaps), key=gaps.get)
        assert found[r.doc_id][0] == best and abs(found[r.doc_id][1] - (1 - gaps[best] / (len(own) * size))) < 1e-9


def test_languages_that_stay(spark, odd):
    """A text that no profile fits goes; languages can be chosen; without profiles whatever has a letter stays."""
    docs = documents(spark, str(DATA))
    profiles = fit_profiles(docs)
    other = rows(spark, (1, "Это совсем другой язык, которого здесь никто не учил"), (2, "12 34"), (3, None), (4, docs.where("lang = 'fr'").first().text))
    assert [r.doc_id for r in keep_identified(other, profiles).collect()] == [4]
    assert [r.doc_id for r in keep_identified(other, profiles, languages=("en",)).collect()] == []
    assert sorted(r.doc_id for r in keep_identified(other, fit_profiles(odd.where("lang is null"))).collect()) == [1, 4]
    kept = keep_identified(docs, profiles)
    assert kept.columns == docs.columns and kept.count() == docs.where(r"text rlike '\\p{L}'").count()


def test_language_odd(spark, odd):
    fitted = fit_profiles(documents(spark, str(DATA)))
    got = defaultdict(list)
    for r in predict_language(odd, fitted).collect():
        got[r.doc_id].append((r.lang_pred, r.score))
    assert [got[i] for i in (1, 2, 3)] == [[(UNKNOWN, 0.0)]] * 3
    assert got[4][0][0] in fitted.languages
    kept = keep_identified(odd, fitted)
    assert kept.columns == odd.columns and Counter(r.doc_id for r in kept.collect()) == Counter(i for i, t in ODD if t and t.strip())


# --- 2 --------------------------------------------------------------------------------------------------------------
def brute_groups(texts, width, percent):
    """Smallest linked id of each id, by comparing all pairs that share a shingle."""
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    postings = defaultdict(list)
    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in postings[s])
        for j, c in shared.items():
            if 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
        for s in sets[i]:
            postings[s].append(i)
    return {i: (len(sets[i]), top(i)) for i in sets}


def edited(rng, words, most):
    words = list(words)
    for _ in range(rng.randrange(most)):
        k = rng.randrange(len(words))
        rng.choice([lambda: words.__setitem__(k, f"new{rng.randrange(10**6)}"), lambda: words.insert(k, "ins"), lambda: words.pop(k) if len(words) > 3 else None])()
    return " ".join(words)


@pytest.mark.parametrize(("width", "percent", "frequent", "combined"), [(3, 90, 2, 48), (5, 80, 2, 2), (3, 50, 2, 3), (1, 60, 2, 48)])
def test_groups_like_brute_force(spark, monkeypatch, width, percent, frequent, combined):
    """Near copies, shared passages and very short texts; a low bar makes most shared tokens frequent."""
    for name, value in (("BLOCK_TOKENS", 2), ("BLOCK_WORD", 1), ("FREQUENT", frequent), ("COMBINED", combined)):
        monkeypatch.setattr(jaccard_join, name, value)
    if width == 5:  # as if eight bytes of ids weren't enough
        monkeypatch.setattr(jaccard_join, "id_bytes", lambda sizes: 16)
    rng = random.Random(width * percent)
    vocabulary = [f"w{i}" for i in range(400)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([2, 5, 40, 120]))] for _ in range(14)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    texts = {}
    for i in range(260):
        base = rng.choice(bases)
        texts[i] = edited(rng, base + (passage if rng.random() < 0.3 else []), 7)
    texts |= {260: None, 261: "", 262: " \n", 263: "One", 264: "ONE", 265: "one\ttwo", 266: "one two"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_groups(docs, width, percent).collect()}
    assert found == brute_groups(texts, width, percent)


def test_one_of_each_stays(odd):
    kept = keep_one_of_each(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 3, 4, 5, 6, 6, 7, None])


def test_components(spark):
    rng = random.Random(5)
    edges = [(f"n{a}", f"n{a + 1}") for a in range(40)] + [(f"m{rng.randrange(30)}", f"m{rng.randrange(30)}") for _ in range(25)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    parent = {}
    for a, b in edges:
        for x in (a, b):
            parent.setdefault(x, x)
        if a != b:
            low, high = sorted((parent[a], parent[b]))
            parent = {k: low if v == high else v for k, v in parent.items()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert found == {k: parent[k] for k in linked}
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


# --- 3 --------------------------------------------------------------------------------------------------------------
def test_licenses(spark):
    mit = dict(LicenseIndex().templates)["mit"]
    changed = mit.replace("free of charge", "at no charge").replace("publish, ", "")
    texts = [(1, f"code\n{mit}\nmore"), (2, f"ü {changed}"), (3, "released under the mit license!"), (4, "released under some other terms"), (5, None), (6, ""), (7, LONG), (8, "All rights reserved. " * 2)]
    found = scan_licenses(rows(spark, *texts)).orderBy("doc_id", "start").collect()
    assert [(r.doc_id, r.license) for r in found] == [(1, "mit"), (2, "mit"), (3, "mit-notice"), (8, "all-rights-reserved"), (8, "all-rights-reserved")]
    by = {r.doc_id: r for r in found}
    assert by[1].coverage == 1.0 and texts[0][1][by[1].start : by[1].end] == mit.rstrip(".")
    assert 0.9 < by[2].coverage < 1.0 and by[2].start == 2


def test_licenses_odd(spark):
    """Null ids, repeated rows, a text with thousands of notices, words put into the middle of a license."""
    mit = dict(LicenseIndex().templates)["mit"].split()
    parted = " ".join(mit[:80] + [f"own{i}" for i in range(30)] + mit[80:])
    many = "Released under the MIT License. All rights reserved. " * 5000
    texts = [(None, " ".join(mit)), (1, parted), (1, parted), (2, many), (3, "All rights reserved. " * 3000)]
    found = Counter((r.doc_id, r.license, round(r.coverage, 2)) for r in scan_licenses(rows(spark, *texts)).collect())
    assert found == {(None, "mit", 1.0): 1, (1, "mit", 1.0): 2, (2, "mit-notice", 1.0): 5000, (2, "all-rights-reserved", 1.0): 5000, (3, "all-rights-reserved", 1.0): 3000}


def test_edited_licenses_like_longest_subsequence(spark):
    """Long templates with edits, beside each other: found as the longest common subsequence with each template says."""
    index, rng = LicenseIndex(), random.Random(9)
    long = {n: license_words(t.encode()).tolist() for n, t in index.templates if len(t) > 300}
    raw = {n: re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", t) for n, t in index.templates if len(t) > 300}
    texts, expected = [], {}
    for i, (name, words) in enumerate(sorted(raw.items())):
        edits, edited = rng.choice([0, 0.03, 0.06]), []
        for w in words:
            how = rng.randrange(3) if rng.random() < edits else 3
            edited += [[f"z{rng.randrange(10**6)}"], [], [w, f"z{rng.randrange(10**6)}"], [w]][how]
        text = " ".join([f"a{rng.randrange(10**6)}" for _ in range(50)] + edited + [f"b{rng.randrange(10**6)}" for _ in range(50)])
        own = license_words(text.encode()).tolist()
        shares = {n: common(own, t) for n, t in long.items()}
        expected[i] = max(shares, key=lambda n: (shares[n] >= 0.8 * len(long[n])) * shares[n])
        texts.append((i, text))
    found = defaultdict(dict)
    for r in scan_licenses(rows(spark, *texts)).collect():
        found[r.doc_id][r.license] = r.n_matched
    assert {i: max(f, key=f.get) for i, f in found.items()} == expected
    for i, text in texts:
        own = common(license_words(text.encode()).tolist(), long[expected[i]])
        assert found[i][expected[i]] >= 0.97 * own


def test_licenses_like_search_for_all_templates(spark):
    """On the table, every line that is a notice is found, and nothing else is."""
    index = LicenseIndex()
    clean = lambda t: " ".join(re.findall(r"[0-9a-z]+", t.lower()))
    short = {n: f" {clean(t)} " for n, t in index.templates if len(t) < 90}
    docs = documents(spark, str(DATA))
    expected = Counter((r.doc_id, n) for r in docs.collect() for line in (r.text or "").split("\n") for n, t in short.items() if t in f" {clean(line)} ")
    assert Counter((r.doc_id, r.license) for r in scan_licenses(docs).collect()) == expected and expected


# --- 4 --------------------------------------------------------------------------------------------------------------
def test_passages(spark):
    rng = random.Random(3)
    new = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    passage, other = new(80), new(60)
    changed = list(passage)
    changed[30] = "edit"
    changed.insert(55, "more")
    texts = [
        (10, new(100) + passage + new(40)), (11, passage + new(30)), (12, new(20) + changed + new(20)), (13, new(200)), (14, new(70) + other), (15, other + new(9) + passage), (16, new(30) + passage[:30] + new(30)),
    ]
    docs = rows(spark, *((i, " ".join(w)) for i, w in texts), (17, None), (18, ""), (19, "short"))
    found = {(r.doc_id, r.other_id): r for r in repeated_passages(docs).collect()}
    assert set(found) == {(11, 10), (12, 10), (15, 10), (15, 14)}
    assert (found[11, 10].start, found[11, 10].end, found[11, 10].other_start, found[11, 10].identity) == (0, 80, 100, 1.0)
    fuzzy = found[12, 10]
    assert (fuzzy.start, fuzzy.end) == (20, 101) and 0.95 < fuzzy.identity < 1
    assert (found[15, 10].start, found[15, 10].end) == (69, 149)


def test_passages_of_copies(spark):
    docs = rows(spark, *((i, " ".join(f"c{k}" for k in range(90))) for i in range(40)), (0, " ".join(f"c{k}" for k in range(90))))
    found = repeated_passages(docs).collect()
    assert {(r.doc_id, r.other_id) for r in found} == {(i, 0) for i in range(1, 40)} and all(r.n_words == 90 for r in found)


def test_passages_of_lines_that_stand_alone_before(spark):
    """Lines of under 50 words occur singly in earlier documents; what later ones share of them in common order is found."""
    rng = random.Random(8)
    new = lambda n: [f"n{rng.randrange(10**6)}" for _ in range(n)]
    one, two = new(45), new(45)
    lines = [new(rng.randrange(20, 45)) for _ in range(12)]
    texts = [(5, one + new(30)), (7, new(30) + two), (100, new(9) + one + two), (200, one + two + new(9)), (150, one + new(20))]
    texts += [(300 + i, new(60) + line + new(60)) for i, line in enumerate(lines)]
    for i in range(30):
        at = rng.randrange(9)
        texts.append((400 + i, new(10) + [w for line in lines[at : at + rng.randrange(1, 4)] for w in line] + new(10)))
    found = repeated_passages(rows(spark, *((i, " ".join(w)) for i, w in texts))).collect()
    assert (200, 100) in {(r.doc_id, r.other_id) for r in found}
    runs = lambda w: {tuple(w[x : x + 50]): x for x in range(len(w) - 49)}
    seen, expected = set(), 0
    for doc, w in sorted(texts):
        for run, x in runs(w).items():
            if run in seen:
                expected += 1
                assert any(r.doc_id == doc and r.start <= x and x + 50 <= r.end for r in found), (doc, x)
        seen |= set(runs(w))
    assert expected > 100


def test_passages_of_one_word(spark):
    """Texts of one word over and over are told of without a row for each place."""
    docs = rows(spark, (1, " ".join(["one"] * 120)), (2, " ".join(["one"] * 400)))
    found = sorted((r.start, r.end) for r in repeated_passages(docs).collect())
    assert all(any(a <= x and x + 50 <= b for a, b in found) for x in range(351)) and len(found) < 60


def test_edited_passages(spark):
    """Nine tenths at least of passages of 60 words and more with one word in twelve replaced, left out or doubled."""
    rng = random.Random(21)
    new = lambda n: [f"e{rng.randrange(10**7)}" for _ in range(n)]
    texts, planted = [], 150
    for i in range(planted):
        passage, edited = new(rng.randrange(60, 120)), []
        for k, w in enumerate(passage):
            how = rng.randrange(3) if k % 12 == 6 else 3
            edited += [new(1), [], [w, *new(1)], [w]][how]
        texts += [(i, new(60) + passage + new(60)), (1000 + i, new(40) + edited + new(40))]
    found = repeated_passages(rows(spark, *((i, " ".join(w)) for i, w in texts))).collect()
    assert all(r.doc_id == 1000 + r.other_id and r.identity >= 0.8 for r in found)
    assert len({r.doc_id for r in found}) >= 0.9 * planted


@pytest.mark.parametrize("seen", [2, 10**6])
def test_passages_of_frequent_seeds(spark, monkeypatch, seen):
    """Rows of a seed that a third of all texts have are spread; what is found stays the same."""
    monkeypatch.setattr("pagerefine.llm.substring_dedup.HOT_SEEN", seen)
    rng = random.Random(4)
    new = lambda n: [f"f{rng.randrange(10**6)}" for _ in range(n)]
    line, passage, late = new(30), new(70), new(40)
    texts = [(i, new(30) + (line if i % 3 else line + late) + new(30) + (passage if i % 2 else [])) for i in range(60)]
    found = {(r.doc_id, r.other_id, r.end - r.start) for r in repeated_passages(rows(spark, *((i, " ".join(w)) for i, w in texts))).collect()}
    assert found == {(i, 1, 70) for i in range(3, 60, 2)} | {(i, 0, 70) for i in range(3, 60, 3)}


def test_passages_of_scattered_first_documents(spark):
    """Edited passages whose every common piece stands alone in an earlier document."""
    rng = random.Random(31)
    new = lambda n: [f"s{rng.randrange(10**7)}" for _ in range(n)]
    pieces = [new(17) for _ in range(6)]
    edited = lambda: [w for piece in pieces for w in [*piece, *new(1)]]
    texts = [(i, new(40) + piece + new(40)) for i, piece in enumerate(pieces)]
    texts += [(100, new(30) + edited() + new(30)), (200, edited() + new(50)), (None, new(9) + edited())]
    found = {(r.doc_id, r.other_id): r for r in repeated_passages(rows(spark, *((i, " ".join(w)) for i, w in texts))).collect()}
    assert set(found) == {(200, 100), (None, 100), (None, 200)}
    one = found[200, 100]
    assert (one.start, one.end, one.other_start, one.other_end, one.n_matched) == (0, 107, 30, 137, 102)


def test_passages_like_a_later_document_alone(spark):
    """The second document is like the first, the third like the second alone; more copies of each add a row each."""
    rng = random.Random(32)
    new = lambda n: [f"l{rng.randrange(10**7)}" for _ in range(n)]
    first = new(96)
    second = [w if i % 12 else new(1)[0] for i, w in enumerate(first)]
    third = [w if i % 12 not in (7, 8) else new(1)[0] for i, w in enumerate(second)]
    pad = lambda w: new(20) + w + new(20)
    texts = [(1, pad(first)), (2, pad(second)), (3, pad(third)), *((i, pad([first, second, third][i % 3])) for i in range(4, 34))]
    found = repeated_passages(rows(spark, *((i, " ".join(w)) for i, w in texts))).collect()
    near = defaultdict(set)
    for r in found:
        near[r.doc_id].add(r.other_id)
        near[r.other_id].add(r.doc_id)
    reached, ahead = {1}, [1]
    while ahead:
        more = near[ahead.pop()] - reached
        reached |= more
        ahead += more
    assert reached == set(range(1, 34))


def test_passages_of_a_short_line_alone(spark, monkeypatch):
    """Texts that share a line of under 50 words alone make no chains with each other; a passage amid them is found."""
    made = {}
    monkeypatch.setattr(substring_dedup, "stored", lambda df, name, *a, own=substring_dedup.stored: made.setdefault(name, own(df, name, *a)) if name == "late-chains" else own(df, name, *a))
    rng = random.Random(33)
    new = lambda n: [f"q{rng.randrange(10**7)}" for _ in range(n)]
    line, others = new(30), [new(17) for _ in range(4)]
    edited = lambda: [w for piece in [*others[:2], line, *others[2:]] for w in [*piece, *new(1)]]
    texts = [(i, new(40) + line + new(40)) for i in range(40)] + [(50 + i, new(40) + piece + new(40)) for i, piece in enumerate(others)]
    texts += [(100, new(30) + edited() + new(30)), (200, edited() + new(50))]
    found = [(r.doc_id, r.other_id) for r in repeated_passages(rows(spark, *((i, " ".join(w)) for i, w in texts))).collect()]
    assert found == [(200, 100)]
    assert {(r.doc, r.other) for r in made["late-chains"].collect()} == {(200, 100)}


def test_passages_of_two_short_lines_far_apart(spark, monkeypatch):
    """Texts that share two lines with other words between pass no comparison; a longer edited passage with both is found."""
    made = {}
    monkeypatch.setattr(substring_dedup, "stored", lambda df, name, *a, own=substring_dedup.stored: made.setdefault(name, own(df, name, *a)) if name == "alike-texts" else own(df, name, *a))
    rng = random.Random(35)
    new = lambda n: [f"q{rng.randrange(10**7)}" for _ in range(n)]
    one, two, others = new(14), new(14), [new(17) for _ in range(3)]
    edited = lambda: [w for piece in [one, *others, two] for w in [*piece, *new(1)]]
    texts = [(i, new(40) + one + new(54) + two + new(40)) for i in range(30)] + [(50 + i, new(40) + piece + new(40)) for i, piece in enumerate(others)]
    texts += [(100, new(30) + edited() + new(30)), (200, edited() + new(50))]
    found = [(r.doc_id, r.other_id) for r in repeated_passages(rows(spark, *((i, " ".join(w)) for i, w in texts))).collect()]
    assert found == [(200, 100)]
    assert made["alike-texts"].count() == 1


def test_words_in_common():
    """Bits of words never tell of fewer words in common than there are."""
    rng = random.Random(36)
    texts = [[rng.randrange(most) for _ in range(rng.randrange(6, 140))] for most in (40, 300, 10**9) for _ in range(40)]
    words, sizes = np.array([w for t in texts for w in t], np.uint32), np.array([len(t) for t in texts])
    ends, at = np.cumsum(sizes), np.arange(len(texts))
    held = substring_dedup.word_bits(words, ends - sizes, ends)
    a, b = (c.ravel() for c in np.meshgrid(at, at))
    most = substring_dedup.in_common(held, sizes[a], sizes[b], a, b, np.arange(len(a)))
    for i, j, n in zip(a.tolist(), b.tolist(), most.tolist(), strict=True):
        assert common(texts[i], texts[j]) <= n <= min(sizes[i], sizes[j])


def test_reaches():
    """All pairs at once go as far as one by one, in both directions."""
    rng = random.Random(34)
    pairs = []
    for _ in range(3000):
        kinds = rng.choice([2, 4, 50])
        a = [rng.randrange(kinds) + 1 for _ in range(rng.choice([0, 1, 2, 5, 28, 53]))]
        b = list(a)
        for _ in range(rng.randrange(7)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = [rng.randrange(kinds) + 1] * rng.randrange(2)
        pairs += [(a, b[: rng.choice([10, 28, 53])])]
    words = np.array([w for ab in pairs for own in ab for w in own], np.uint32)
    sizes = np.array([len(own) for ab in pairs for own in ab])
    starts = np.cumsum(sizes) - sizes
    on = substring_dedup.reaches(words, starts[::2], starts[1::2], sizes[::2], sizes[1::2], 1)
    back = substring_dedup.reaches(words, (starts + sizes - 1)[::2], (starts + sizes - 1)[1::2], sizes[::2], sizes[1::2], -1)
    assert [tuple(r) for r in on[:3].T] == [substring_dedup.reach(a, b) for a, b in pairs]
    assert [tuple(r) for r in back[:3].T] == [substring_dedup.reach(a[::-1], b[::-1]) for a, b in pairs]


def test_passages_odd(spark, odd):
    """Null ids, long texts, repeated rows, and ties between the first documents; a null id comes last of all."""
    passage = " ".join(f"p{i}" for i in range(60))
    docs = odd.unionByName(rows(spark, (None, passage), (20, f"a {passage}"), (20, f"b b {passage}"), (21, passage), (22, LONG), (22, LONG)))
    got = repeated_passages(docs).collect()
    found = Counter((r.doc_id, r.other_id, r.n_words) for r in got)
    assert found[None, 20, 60] and found[20, 20, 60] == 1 and found[21, 20, 60] == 1
    assert {(a, b) for a, b, _ in found} == {(None, 20), (20, 20), (21, 20), (22, 5)}
    long = sorted((r.start, r.end) for r in got if r.doc_id == 22)  # its words repeat after 12 961
    assert all(any(a <= x and x + 50 <= b for a, b in long) for x in range(0, 30_000 - 49, 7))


def test_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(9))] for _ in range(2))
        table = defaultdict(int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i, j] = table[i - 1, j - 1] + 1 if x == y else max(table[i - 1, j], table[i, j - 1])
        assert common(a, b) == table[len(a) - 1, len(b) - 1]


def test_words_of_columns():
    """Words of a column hash as the same words elsewhere do, whatever pieces texts are cut into."""
    rng = random.Random(6)
    texts = [None if rng.random() < 0.1 else "".join(rng.choice("abAB é\n\t\x0b ") for _ in range(rng.choice([0, 1, 9, 300]))) for _ in range(300)]
    texts += ["x" * 200_000 + " a " + "y" * 20_000, "z " * 100_000, "x" * 200_000, "y" * 20_000 + " X"]
    column = pa.array(texts)
    known: dict[bytes, int] = {}
    for kind in (column, column.cast(pa.large_string()), column.slice(7)):
        found = list(hashed_words(kind))
        assert len(found) == len(kind)
        for text, own in zip(kind.to_pylist(), found, strict=True):
            parts = (text or "").encode().lower().split()
            assert len(parts) == len(own) and all(known.setdefault(w, h) == h for w, h in zip(parts, own.tolist(), strict=True))
    assert len(set(known.values())) == len(known)


def test_chains_like_quadratic(spark):
    """The Fenwick tree gives the best chain that trying all predecessors gives."""
    rng = np.random.default_rng(1)
    for _ in range(60):
        x, y = rng.integers(0, 300, 25), rng.integers(0, 300, 25)
        a = np.stack([x, x + 8, y, y + 8], axis=1)
        own = [tuple(map(int, r)) for r in a[np.lexsort((a[:, 2], a[:, 0]))]]
        score = []
        for i, (x0, x1, y0, _) in enumerate(own):
            before = [score[j] - 0.1 * (x0 - own[j][1] + y0 - own[j][3]) for j in range(i) if own[j][1] <= x0 and own[j][3] <= y0]
            score.append(x1 - x0 + max([0.0, *before]))
        best = chains(a, 0.1)[0]
        got = sum(r[1] - r[0] for r in best) - sum(0.1 * (q[0] - p[1] + q[2] - p[3]) for p, q in zip(best, best[1:], strict=False))
        assert abs(got - max(score)) < 1e-9


@pytest.mark.parametrize("window", [1, 2, 5, 16])
def test_minimizers(window):
    rng = np.random.default_rng(window)
    for n in (0, 1, 3, 16, 60):
        h = rng.integers(0, 50, n).astype(np.uint64)
        w = min(window, n)
        expected = {i for s in range(n - w + 1) for i in range(s, s + w) if n and h[i] == h[s : s + w].min()}
        assert minimizers(h, window).tolist() == sorted(expected)


# --- 5 --------------------------------------------------------------------------------------------------------------
def test_ledger_scans_unseen_pairs_only(spark):
    hexes = "0123456789abcdef" * 2
    first = rows(spark, (1, f"é token = 'abcdef1' {hexes}"), (2, f"é token = 'abcdef1' {hexes}"), (3, None), (4, "password: x"))
    ledger = BlobLedger(spark)
    ledger.scan(first, RULES, "doc_id", "text")
    assert ledger.pairs().count() == 3 * len(RULES)  # three blobs of four versions
    second = rows(spark, (5, f"é token = 'abcdef1' {hexes}"), (6, "AKIA" + "A" * 20))
    before = ledger.pairs().count()
    ledger.scan(second, RULES, "doc_id", "text")
    assert ledger.pairs().count() == before + len(RULES)
    newer = (*RULES[:-1], Rule(RULES[-1].kind, RULES[-1].pattern, version=2))
    ledger.scan(second, newer, "doc_id", "text")
    assert ledger.pairs().count() == before + len(RULES) + 2
    got = {r.doc_id: r for r in secret_report(first.unionByName(second), ledger).collect()}
    said = "assign:2:18,hex:20:52"
    assert got[1].spans == got[2].spans == got[5].spans == said and got[6].spans == "access:0:24" and got[4].n_assign == 0 and got[3].spans == ""
    assert got[1].base_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_redaction(spark):
    docs = rows(spark, (1, "a token = 0123456789abcdef01234567 b"), (2, "clean"), (3, None), (4, "secret: abcdefg and AKIA" + "Z" * 16))
    got = {r.doc_id: r for r in redact_secrets(docs).collect()}
    assert (got[1].text, got[1].n_chars) == ("a [SECRET] b", 12) and got[2].text == "clean" and got[3].text is None
    assert got[4].text == "[SECRET] and [SECRET]" and redact_secrets(docs).columns == docs.columns


# --- 6 and 7 --------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


def samples():
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "'LL", "é", "日本", "😀", "12", "½", "_-", "<|endoftext|>", "<|endof", "\x85", "\xa0", "​", "\x1c", "the", "aaaa", "̀", "\r\n", "﻿"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(1500)] + ["", "a" * 4000, "ab" * 2000, " " * 2000, LONG[:20000]]


def test_tokens_like_library(spark, library):
    texts = samples()
    expected = library.encode_batch(texts, add_special_tokens=False)
    c = codec(BPE)
    for text, e in zip(texts, expected, strict=True):
        assert c.encode(text) == e.ids and c.decode(e.ids) == library.decode(e.ids, skip_special_tokens=False)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in token_counts(docs, BPE).collect()}
    assert [got[i].n_tokens for i in range(len(texts))] == [len(e.ids) for e in expected]
    assert all(got[i].n_bytes == len(t.encode()) and got[i].over_limit == (got[i].n_tokens > 1024) for i, t in enumerate(texts))


def test_long_pre_tokens_like_library(library):
    rng = random.Random(7)
    texts = ["".join(rng.choice(a) for _ in range(n)) for a in ("ab", "abcdefghijklmnopqrstuvwxyz", "aetion") for n in (511, 512, 513, 30_000)] + ["a" * 5001, "!" * 3000]
    assert Counting(BPE).count(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_files_that_ask_for_more(tmp_path):
    """A tokenizer file with settings that aren't done here is an error, not a wrong result."""
    spec = json.load(open(BPE, encoding="utf-8"))
    changes = [("normalizer", {"type": "Lowercase"}), ("pre_tokenizer", {"type": "Whitespace"}), ("pre_tokenizer", spec["pre_tokenizer"] | {"add_prefix_space": True})]
    changes += [("model", spec["model"] | {k: v}) for k, v in (("ignore_merges", True), ("dropout", 0.1), ("end_of_word_suffix", "</w>"))]
    changes += [("added_tokens", [spec["added_tokens"][0] | {"lstrip": True}])]
    for i, (key, value) in enumerate(changes):
        path = tmp_path / f"{i}.json"
        path.write_text(json.dumps(spec | {key: value}), encoding="utf-8")
        with pytest.raises(ValueError):
            codec(str(path))
    path = tmp_path / "order.json"
    path.write_text(json.dumps(spec | {"model": spec["model"] | {"merges": spec["model"]["merges"][::-1]}}), encoding="utf-8")
    with pytest.raises(ValueError):
        Counting(str(path))


def test_round_trip_of_table(spark, library):
    docs = documents(spark, str(DATA))
    got = {r.doc_id: r for r in bpe_round_trip(docs, BPE).collect()}
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id].n_tokens == len(ids) and got[r.doc_id].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_encode_then_decode(odd):
    back = bpe_decode(bpe_encode(odd, BPE), BPE)
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((i, t or "") for i, t in ODD)


# --- 8 --------------------------------------------------------------------------------------------------------------
def test_quality_odd_and_hosts(spark):
    good = " ".join(f"word{i}" for i in range(60))
    texts = [(1, good, "a"), (2, "few words", "a"), (3, "one two three " * 30, "a"), (4, None, None), (5, f"{good}\nx y\nx y\n \n ", None)]
    texts += [(10 + i, "bad " + "## " * 70 + str(i), "b") for i in range(30)] + [(50, good, "b")] + [(60 + i, good + str(i), "c") for i in range(30)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality_rules(docs).collect()}
    assert got[1].kept and got[2].base_failed and got[3].n_repeat_words == 90 and got[3].base_failed
    assert got[4].n_words == 0 and got[4].base_failed and got[5].n_dup_lines == 1 and got[5].kept
    assert not got[50].base_failed and not got[50].kept and all(got[60 + i].kept for i in range(30))
    assert got[50].host_verdict == "bad" and got[50].host_rate > 0.7 and got[1].host_rate is not None and got[4].host_verdict is None


def test_quality_suspect_host(spark):
    """A document that fails a style rule alone goes where its host is worse than others, and stays elsewhere."""
    good, loud = " ".join(f"word{i}" for i in range(60)), " ".join(f"w{i} ##" for i in range(60))
    texts = [(h, "few words" if i % 10 < failing else good) for h, failing in (("a", 1), ("b", 1), ("c", 1), ("d", 4)) for i in range(40)]
    texts += [("a", loud), ("d", loud), (None, loud)]
    docs = spark.createDataFrame([(i, t, h) for i, (h, t) in enumerate(texts)], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality_rules(docs).collect()}
    assert [got[i].style_failed for i in (160, 161, 162)] == [True] * 3 and not any(got[i].base_failed for i in (160, 161, 162))
    assert [got[i].kept for i in (160, 161, 162)] == [True, False, True]
    assert {r.host_verdict for r in got.values()} == {"good", "suspect", None}
    assert all(r.kept != r.base_failed for i, r in got.items() if i != 161)


# --- 9 --------------------------------------------------------------------------------------------------------------
def brute_hits(doc, items, size=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = words(doc), set(), set()
    for i, t in items:
        own = words(t)
        n = min(size, len(own))
        for s in range(len(own) - n + 1 if n else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == own[s : s + n]:
                    hit.update(range(p, p + n))
                    found.add(str(i))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("alphabet", [3, 40])
def test_hits_like_brute_force(spark, alphabet):
    """Few letters make windows overlap and repeat; items of one word, of fewer than a window, and without words."""
    rng = random.Random(alphabet)
    new = lambda n: " ".join(rng.choice("abcdefghijklmnopqrstuvwxyzàé0123456789ABCD"[:alphabet]) for _ in range(n))
    items = [(1, new(14)), (2, new(10)), (3, new(4)), (4, "?!"), (5, None), (6, new(25)), (10, "zebra"), (11, new(12)), (11, new(12))]
    texts = [(i, new(rng.randrange(80))) for i in range(40)]
    texts += [(50 + i, f"{new(5)}, {t} - {new(5)}" if t else None) for i, (_, t) in enumerate(items)] + [(60, "A Zebra."), (61, ""), (62, items[0][1].upper()), (62, "other")]
    docs, bench = rows(spark, *texts), spark.createDataFrame(items, "item_id long, text string").withColumn("doc", F.lit(1))
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate(docs, bench).collect())
    assert got == Counter((i, *brute_hits(t, items)) for i, t in texts)
    kept = clean_documents(docs, bench)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter(i for i, t in texts if not brute_hits(t, items)[-1])


def test_proximity(spark):
    item = " ".join(f"term{i}" for i in range(20))
    near = item.replace("term7 ", "term7 inserted ").replace("term15", "changed")
    docs = rows(spark, (1, f"x {near} y"), (2, item), (3, "term1 term9"))
    found = find_matches(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {(r.doc, r.kind) for r in found} == {(1, "near"), (2, "phrase"), (2, "near")}


def test_hits_in_odd_rows(spark, odd):
    """A null id, repeated rows, a very long text, and items that repeat an id or have no words."""
    phrase = " ".join(f"q{i}" for i in range(12))
    docs = odd.unionByName(rows(spark, (None, f"a {phrase} b"), (30, f"{LONG} {phrase} {LONG}"), (30, phrase), (30, phrase)))
    items = spark.createDataFrame([("i", phrase), ("i", " ".join(LONG.split()[100:115])), ("none", None), ("blank", " ,.")], "item_id string, text string")
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in decontaminate(docs, items).collect())
    hit = {k: n for k, n in got.items() if k[2]}
    assert hit == {(None, 14, 12, 1): 1, (30, 60_012, 12 + 6 * 15, 1): 1, (30, 12, 12, 1): 2, (5, 30_000, 3 * 15, 1): 1}
    assert sum(got.values()) == len(ODD) + 4


def test_no_items_or_documents(spark, odd, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(not r.contaminated for r in decontaminate(odd, none).collect())
    assert decontaminate(empty, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


# --- 10 -------------------------------------------------------------------------------------------------------------
PAGES = [(3, "u3", "<p>a</p>"), (1, "u1", "<p>a</p>"), (2, None, "ü" * 5000), (4, "u4", None), (5, "u5", ""), (None, "u", "<p>a</p>"), (1, "u1", "<p>a</p>"), (6, "a\r\nb", "x\r\n\r\ny")]


def test_archives(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"key": F.lit(1), "digest": F.lit("x")})
    got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_round_trip(spark, pages).collect())
    assert got == Counter([(1, 8, "response", None), (1, 8, "revisit", 1), (3, 8, "revisit", 1), (None, 8, "revisit", 1), (2, 10000, "response", None), (4, 0, "response", None), (5, 0, "revisit", 4), (6, 6, "response", None)])
    assert warc.archive_round_trip(spark, pages.limit(0)).count() == 0
    larger = warc.archive_round_trip(spark, pages, min_bytes=9).collect()
    assert all(r.record_type == "response" for r in larger)


def test_archives_of_text_ids(spark):
    """Ids with line ends, blanks, percent signs and no characters at all come back as they were."""
    ids = ["a\r\nWARC-Type: odd", "", " b ", "%41", "<ü>", None, "null"]
    pages = spark.createDataFrame([(i, "u", f"text {n}") for n, i in enumerate(ids)] + [("z", "u", "text 1")], "page_id string, url string, html string")
    got = Counter((r.page_id, r.record_type, r.refers_to) for r in warc.archive_round_trip(spark, pages).collect())
    assert got == Counter([(i, "response", None) for i in ids] + [("z", "revisit", "")])


def test_archive_payloads_and_dictionary(spark):
    pages = spark.createDataFrame([(i, f"u{i}", f"<html>{'shared text ' * 20}{i} {random.Random(i).random()}</html>") for i in range(300)], "page_id long, url string, html string")
    trained = warc.train_dictionary(pages, "page_id", "html")
    assert trained
    manifest = warc.write_archives(warc.mark_revisits(pages), warc.new_path(spark, "test-warc"), trained, archive_bytes=4000)
    assert manifest.count() > 4  # archives are closed at their size
    first = open(manifest.first().path.removeprefix("file://"), "rb").read()
    assert first[:4] == struct.pack("<I", warc.DICTIONARY_MAGIC) and first[8 : 8 + len(trained)] == trained  # what lies on disk is the archive itself
    back = {r.page_id: r.payload for r in warc.read_archives(manifest).collect()}
    assert back == {str(r.page_id): r.html.encode() for r in pages.collect()}


def archive(*records, dictionary=b""):
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    c = zstandard.ZstdCompressor(dict_data=data) if data else zstandard.ZstdCompressor()
    return warc.dictionary_frame(dictionary) + b"".join(map(c.compress, records))


def test_reader_checks():
    good = warc.record_bytes(1, "u", b"payload")
    assert [warc.parse_record(r)["payload"] for r in warc.read_archive(io.BytesIO(archive(good, good)))] == [b"payload"] * 2
    packed = zstandard.ZstdCompressor().compress(b"word " * 3000)
    assert next(warc.read_archive(io.BytesIO(warc.dictionary_frame(packed) + zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(b"word " * 3000)).compress(good)))) == good
    for bad in (good[:-1], good.replace(b"payload", b"paXload"), good.replace(b"WARC/1.1", b"WARC/0.9"), good.replace(b"WARC-Date", b"X-Date"), good.replace(b"WARC-Type: response", b"WARC-Type: odd"), b""):
        with pytest.raises(warc.WarcError):
            warc.parse_record(bad)
    for cut in (archive(good)[:4], archive(good)[:-3], archive(good) + b"rubbish"):
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(io.BytesIO(cut)))


def test_reader_reports_errors(spark, tmp_path):
    path = tmp_path / "x.warc.zst"
    path.write_bytes(archive(warc.record_bytes(1, "u", b"a"), b"bad", warc.record_bytes(2, "u", b"b")) + b"junk")
    manifest = spark.createDataFrame([(f"file://{path}",)], "path string")
    got = warc.read_archives(manifest, strict=False).collect()
    assert [(r.page_id, r.error is None) for r in got] == [("1", True), (None, False), ("2", True), (None, False)]


# --- native forms ---------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("name", ["op5_secrets", "op8_quality_rules", "op9_decontamination"])
def test_native_plans_run_no_python(name, spark, monkeypatch):
    """The last plan, those of all tables stored on the way, and what the ledger writes."""
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    for module in (quality_rules_module, secrets, decontamination):
        if hasattr(module, "stored"):
            monkeypatch.setattr(module, "stored", lambda df, *a, own=module.stored: own(seen(df), *a))
    monkeypatch.setattr(secrets, "scan_blobs", lambda *a, own=secrets.scan_blobs: seen(own(*a)))
    seen(queries.QUERIES[name](spark, str(DATA)))
    assert len(plans) > 1 and not any(re.search("Python|Pandas|Arrow", p) for p in plans)
