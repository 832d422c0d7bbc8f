"""Phrase mining, fill-in-middle and license scan against brute force."""
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartlore.llm import fill_middle, license_scan, phrase_mining

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))


@pytest.fixture
def odd(spark):
    rows = [(1, "plain words here", "en", "a", 16), (1, "plain words here", "en", "a", 16), (2, None, None, None, None),
            (2, None, None, None, None), (None, "", "en", "a", 0), (3, "", None, "b", 0), (4, LONG, "en", None, len(LONG)),
            (5, LONG, "de", "b", len(LONG)), (None, "plain words here", None, None, None), (6, " \n\t ", "fr", "b", 4),
            (7, "a<P>b", "en", "a", 5), (8, "é𝄞́ 中文 <S", "fr", "a", 9)]
    frame = spark.createDataFrame(rows, DOCS)
    return frame.withColumns({n: F.lit(7) for n in ("n", "form", "f", "id", "word", "rank", "score", "fim", "row", "_part")})


# --- phrase mining ---------------------------------------------------------------


def mined(rows, least, longest=5, top=2000):
    """Plain statement of the rules."""
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", folded):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    counts[lang, tuple(words[i:i + m])] += 1
    often = {k: v for k, v in counts.items() if v >= least}
    inside = Counter()
    for (lang, words), f in often.items():
        for m in range(2, len(words)):
            for i in range(len(words) - m + 1):
                inside[lang, words[i:i + m]] = max(inside[lang, words[i:i + m]], f)
    out = []
    for (lang, words), a in often.items():
        if len(words) < 2 or inside[lang, words] >= a:
            continue
        best = None
        for k in range(1, len(words)):
            left, right = often[lang, words[:k]], often[lang, words[k:]]
            score = 1000 * a * totals[lang] // (left * right)
            if best is None or score < best[0]:
                best = (score, left, right)
        out.append((lang, -best[0], -a, " ".join(words).encode(), best[1], best[2], totals[lang]))
    ranked, seen = set(), Counter()
    for lang, s, a, phrase, left, right, n in sorted(out):
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.add((lang, seen[lang], phrase.decode(), -a, left, right, n, -s))
    return ranked


def corpus(seed, n=400):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "é", "x-ray", "new", "york", "city", "中文", "b", "c", "d"] + [f"w{i}" for i in range(60)]
    rows = []
    for _ in range(n):
        words = []
        for _ in range(rng.randrange(30)):
            words += ["new", "York", "city", "hall"][:rng.randrange(5)] if rng.random() < 0.2 else [rng.choice(vocabulary[:rng.choice((4, 12, 72))])]
        rows.append(("".join(w + rng.choice([" ", " ", " ", "\t", "  ", ", ", "\n", ".", "\r"]) for w in words), rng.choice(["en", "de", None])))
    return rows + [(None, "en"), ("", None), ("a a a a a a a a", "und"), (" . ,", "en")]


@pytest.mark.parametrize("head,top", [(200_000, 2000), (7, 25), (0, 2000)])
def test_phrases_equal_brute_force(spark, head, top):
    rows = corpus(3)
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id bigint, text string, lang string").repartition(5)
    got = phrase_mining.best_of_each(phrase_mining.collocations(docs, least=4, head=head), top)
    got = {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got.collect()}
    assert got == mined(rows, 4, top=top) and len(got) > 40


def test_tiles_equal_a_plain_count():
    rng = np.random.default_rng(1)
    a, b = (rng.zipf(1.3, 20_000) % 5000 for _ in range(2))
    want = Counter(zip(a.tolist(), b.tolist()))
    for tile, crowded in ((16, 40), (1024, 1 << 30), (8192, 1)):
        x, y, c = phrase_mining.cell_counts(a, b, tile, crowded)
        assert dict(zip(zip(x.tolist(), y.tolist()), c.tolist())) == want and len(x) == len(want)
    assert [len(p) for p in phrase_mining.cell_counts(a[:0], b[:0])] == [0, 0, 0]


def test_wide_products_are_exact(spark):
    # A thousand million occurrences of each part: the product passes 64 bits.
    big = 10 ** 12
    levels = [None, spark.createDataFrame([("en", 0, 0, 0, big - 1, [big, big - 1], [big + 7, big - 1], "x y", "y")],
                                          "lang string, id int, a int, b int, f bigint, pre array<bigint>, suf array<bigint>, phrase string, last string")]
    total = spark.createDataFrame([("en", 10 ** 14 + 3)], "lang string, n bigint")
    plain = phrase_mining.phrase_levels
    phrase_mining.phrase_levels = lambda *_: (total, levels)
    try:
        row = phrase_mining.collocations(spark.range(0)).first()
    finally:
        phrase_mining.phrase_levels = plain
    assert row.score == 1000 * (big - 1) * (10 ** 14 + 3) // (big * (big + 7))


def test_phrases_of_odd_rows(odd):
    rows = [(r.text, r.lang) for r in odd.collect()]
    got = phrase_mining.phrase_report(odd, least=2)
    assert {tuple(r) for r in got.collect()} == mined(rows, 2)
    assert phrase_mining.phrase_report(odd.where("1 = 0")).collect() == []


# --- fill in middle -------------------------------------------------------------


def test_wavelet_ranks_equal_counts():
    rng = np.random.default_rng(2)
    for size in (0, 1, 63, 64, 65, 1000):
        codes = rng.integers(0, 5, size).astype(np.uint8)
        matrix = fill_middle.WaveletMatrix(codes)
        at = np.arange(size + 1)
        for code in range(5):
            assert matrix.rank(code, at).tolist() == np.concatenate([[0], np.cumsum(codes == code)]).tolist()


def test_cuts_by_characters_and_words():
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "é", "中", "𝄞", " ", "\n", "b", "\t"]) for _ in range(rng.randrange(60))) for _ in range(300)]
    raw = [t.encode() for t in texts]
    h1, h2 = (np.array([rng.randrange(1 << 32) for _ in texts]) for _ in range(2))
    for row, t, x, y in zip(fill_middle.cuts(raw, h1, h2).itertuples(), texts, h1.tolist(), h2.tolist()):
        a, b = sorted((x % (len(t) + 1), y % (len(t) + 1)))
        assert (row.n, row.prefix_chars, row.middle_chars) == (len(t), a, b - a)
    for row, t, x, y in zip(fill_middle.cuts(raw, h1, h2, "words").itertuples(), texts, h1.tolist(), h2.tolist()):
        starts = [m.start() for m in re.finditer(r"[^ \t\n]+", t)]
        a, b = sorted((x % (len(starts) + 1), y % (len(starts) + 1)))
        low, high = (0 if k == 0 else [*starts, len(t)][k] for k in (a, b))
        assert (row.n, row.prefix_units, row.middle_units) == (len(starts), a, b - a)
        assert (row.prefix_chars, row.prefix_chars + row.middle_chars) == (low, high)


@pytest.mark.parametrize("unit", ["chars", "words"])
def test_middle_round_trip(odd, unit):
    done = fill_middle.fill_in_middle(odd, unit=unit, out="made")
    assert done.columns == [*odd.columns, "made"]
    rows = done.withColumn("again", fill_middle.restored(F.col("made.output"), F.col("made.form"))).collect()
    assert len(rows) == odd.count() and all(r.again == (r.text or "") for r in rows)
    for r in rows:
        if r.made.form == "plain":
            assert r.made.output == (r.text or "") and r.made.prefix_chars is None
        else:
            p, s = r.text[:r.made.prefix_chars], r.text[r.made.prefix_chars + r.made.middle_chars:]
            m = r.text[r.made.prefix_chars:r.made.prefix_chars + r.made.middle_chars]
            assert r.made.output == (f"<P>{p}<S>{s}<M>{m}" if r.made.form == "psm" else f"<S>{s}<P>{p}<M>{m}")
    assert {r.made.form for r in rows if r.doc_id == 7} == {"plain"}
    assert fill_middle.middle_report(odd.where("1 = 0")).collect() == []


def test_form_follows_the_key(spark):
    rows = [(i, f"text number {i}") for i in range(600)]
    got = fill_middle.middle_report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    for r in got:
        h = [int(hashlib.sha256(f"1:{r.doc_id}".encode()).hexdigest()[i:i + 8], 16) for i in (0, 8, 16, 24)]
        assert r.form == ("plain" if h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm")
        assert r.restored_sha256 == hashlib.sha256(rows[r.doc_id][1].encode()).hexdigest()
    assert {r.form for r in got} == {"plain", "psm", "spm"}


# --- license scan ---------------------------------------------------------------


def least_edits(item, text):
    """Least edit distance of the item to any part of the text."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for ch in text:
        before, row[0] = row[0], 0
        for i, c in enumerate(item, 1):
            before, row[i] = row[i], min(before + (c != ch), row[i] + 1, row[i - 1] + 1)
        best = min(best, row[-1])
    return best


def altered(rng, text, edits):
    for _ in range(edits):
        i = rng.randrange(len(text))
        text = text[:i] + rng.choice(["", rng.choice("abcxyz ") + text[i], rng.choice("abcxyz")]) + text[i + 1:]
    return text


def test_notices_equal_least_edits():
    rng = random.Random(6)
    notices = [(f"l{i}", "", t) for i, (_, _, t) in enumerate(license_scan.NOTICES) if len(t) < 60]
    finder = license_scan.NoticeFinder(notices)
    found = 0
    for _ in range(150):
        label, _, notice = rng.choice(notices)
        text = f"{rng.choice(['', 'some words before '])}{altered(rng, notice, rng.randrange(6))}{rng.choice(['', ' and after', ' ' + notice[:20]])}"
        plain = " ".join(w.decode() for w in license_scan.words_of(text) if w)
        got = {finder.notices[no][0] for no, *_ in finder.find(plain)}
        want = {name for name, _, t in notices if least_edits(t, plain) <= license_scan.error_budget(len(t))}
        assert got == want, plain
        found += bool(want)
    assert 30 < found < 150


def test_words_phrases_and_spans():
    finder = license_scan.NoticeFinder(license_scan.NOTICES)
    text = "Intro. MIT-License, mit license mit license!\nReleased undr the MIT licence; and\u00a0Licensed under CC BY-NC 4.0."
    n_words, n_base, first, last, base, labels, score, spans = license_scan.scan(text, finder)
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.lower())
    places = [i for i in range(len(words) - 1) if words[i:i + 2] == ["mit", "license"]]
    assert (n_words, n_base, first, last, base) == (len(words), len(places), places[0], places[-1], "mit")
    assert labels == "cc,mit" and score == 1.0
    shown = {s["label"]: text[s["start"]:s["end"]] for s in spans}
    assert shown == {"mit": "Released undr the MIT licence", "cc": "and\u00a0Licensed under CC BY-NC 4.0"}
    assert all(words[s["first_word"]] in ("released", "and\u00a0licensed") and s["edits"] for s in spans if s["label"] == "mit")
    # The name of a license is not an error to be forgiven.
    assert license_scan.scan("Released under the MPL license, released under the BSE license", finder)[5] == ""
    assert license_scan.scan("this work is licensed under the gnu general public licence, version 3", finder)[5:7] == ("gpl", pytest.approx(1 - 1 / 55, abs=0.01))


def test_licenses_of_odd_rows(odd, spark):
    n = odd.count()
    got = license_scan.with_licenses(odd, out="found")
    assert got.columns == [*odd.columns, "found"]
    rows = got.collect()
    assert len(rows) == n and all(r.found.labels == "" and r.found.score == 0.0 and r.found.first_word is None for r in rows)
    assert {r.found.n_words for r in rows if r.text == LONG} == {30_000}
    assert license_scan.license_report(odd.where("1 = 0")).collect() == []
    many = spark.createDataFrame([(1, "Released under the MIT License. " * 3000)], "doc_id bigint, text string")
    row = license_scan.license_report(many).first()
    assert row.n_base == 3000 and len(row.notices) == 3000 and (row.first_word, row.last_word) == (3, 5 * 2999 + 3)
