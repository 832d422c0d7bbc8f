"""The plain parts of the operators against brute force, without Spark."""
import random

import numpy as np
import pytest

from chartlore.llm import edit_leaks, order_minhash, quality_forest, text_rules, toxicity, url_filter, window_dedup
from chartlore.llm.fitting import fit_logistic, probability
from chartlore.llm.rolling import RangeHash


def edit_distance_in(item, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(text, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return min(row)


def common_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_bit_parallel_distance_is_the_edit_distance():
    rnd = random.Random(1)
    for _ in range(300):
        item = "".join(rnd.choice("abc ") for _ in range(rnd.randint(1, 90)))
        text = "".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 120)))
        assert edit_leaks.best_end(item, text)[0] == edit_distance_in(item, text)


def test_every_item_within_its_budget_is_found():
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    items = [(i, " ".join(rnd.choices(words, k=30))) for i in range(20)]
    matcher = edit_leaks.ItemMatcher(items, edit_leaks.RATE)
    for _ in range(150):
        i, item = rnd.choice(items)
        text = list(item)
        for _ in range(edit_leaks.error_budget(len(item))):
            at = rnd.randrange(len(text))
            text[at] = rnd.choice(["", "x", text[at] + "y"])
        whole = " ".join(rnd.choices(words, k=20)) + " " + "".join(text) + " " + " ".join(rnd.choices(words, k=20))
        want = {j for j, t in items if edit_distance_in(edit_leaks.normal(t), edit_leaks.normal(whole))
                <= edit_leaks.error_budget(len(edit_leaks.normal(t)))}
        assert i in want
        assert {leak[0] for leak in matcher.leaks(whole)} == want


def test_matcher_edges():
    matcher = edit_leaks.ItemMatcher([(1, None), (2, ""), (3, "a"), (4, "same item"), (5, "same item")], 0.08)
    assert matcher.leaks(None) == matcher.leaks("") == []
    assert [leak[:2] for leak in matcher.leaks("THE  same\nITEM here")][-2:] == [(4, 0), (5, 0)]
    assert edit_leaks.ItemMatcher([], 0.08).leaks("anything") == []


def test_aligned_is_the_common_subsequence():
    rnd = random.Random(3)
    for _ in range(300):
        a = rnd.sample(range(60), rnd.randint(1, 40))
        b = [v for v in a if rnd.random() > 0.2] + rnd.sample(range(100, 200), rnd.randint(0, 5))
        if rnd.random() < 0.3:
            rnd.shuffle(b)
        got = order_minhash.aligned(np.array(a, np.uint64), np.array(b, np.uint64), 100)
        assert got == common_length(a, b)


def test_sketches_depend_on_order_and_repeats():
    words = "one two three four five six seven eight nine ten".split()
    there, back = (order_minhash.labelled_shingles(" ".join(w), 1) for w in (words, words[::-1]))
    assert set(there) == set(back)
    assert (order_minhash.sketch_keys(there) != order_minhash.sketch_keys(back)).any()
    assert len(set(order_minhash.labelled_shingles("a a a a", 1))) == 4
    assert len(order_minhash.labelled_shingles(None)) == len(order_minhash.labelled_shingles(" \n ")) == 0
    assert len(order_minhash.labelled_shingles("just two")) == 1


def test_near_texts_meet_and_far_ones_are_refused():
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    missed = 0
    for _ in range(300):
        a = rnd.choices(words, k=300)
        b = list(a)
        for at in rnd.sample(range(300), 6):
            b[at] = "new" + str(at)
        x, y = (order_minhash.labelled_shingles(" ".join(t)) for t in (a, b))
        assert order_minhash.similarity(x, y) >= 0.8
        missed += not (order_minhash.sketch_keys(x) == order_minhash.sketch_keys(y)).any()
        far = order_minhash.labelled_shingles(" ".join(a[:150] + rnd.choices(words, k=150)))
        assert order_minhash.similarity(x, far) == 0.0
    assert missed == 0


def test_range_hash_names_equal_ranges():
    raw = b"abcabcabd" * 5
    h = RangeHash(raw)
    seen = {}
    for a in range(len(raw)):
        for b in range(a, len(raw) + 1):
            v = int(h.ranges(np.array([a]), np.array([b]))[0])
            assert seen.setdefault(v, raw[a:b]) == raw[a:b]


def test_every_window_holds_an_anchor_found_by_content():
    rnd = random.Random(5)
    for _ in range(30):
        raw = bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 200)))
        at, _, _ = window_dedup.anchors(raw, 20, 12)
        grams = {p for p in at.tolist()}
        for s in range(len(raw) - 20 + 1):
            assert grams & set(range(s, s + 9))
        assert len(raw) >= 20 or not grams


def test_text_rules_by_their_definitions():
    text = "a b c a b c\nx y\nx y\n \n \nd|e é!"
    r = dict(zip(text_rules.FIELDS, text_rules.text_rules(text)))
    words = text.split()
    runs = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, run in enumerate(runs) if runs.count(run) > 1 for k in range(3)}
    assert r["n_words"] == len(words) and r["word_chars"] == sum(map(len, words))
    assert r["n_repeat_words"] == len(covered) and r["n_dup_lines"] == 1 and r["n_symbols"] == 1
    assert text_rules.text_rules(None)[0] == 0
    assert np.isfinite(text_rules.ratios(text_rules.pd.DataFrame([text_rules.text_rules("")], columns=text_rules.FIELDS))).all()


def test_forest_finds_what_lies_apart():
    rng = np.random.default_rng(6)
    good, bad = rng.normal(0, 1, (500, 4)), rng.normal(0, 1, (60, 4))
    bad[:, 2] += 12
    forest = quality_forest.grow(good, np.vstack([good, bad]))
    scores = forest.score(np.vstack([good, bad]))
    cut = quality_forest.calibrate(scores, np.arange(560) < 500)
    assert (scores[500:] > cut).mean() > 0.95 and (scores[:500] > cut).mean() <= 0.01


def test_grammar_tells_the_kinds_apart():
    scorer = toxicity.Scorer({"idiot": 2.0}, {"mor": 3.0})
    kinds = dict(zip(toxicity.KINDS, range(5)))

    def found(text):
        counts = scorer.counts(text)
        return {k for k, i in kinds.items() if counts[i] > 0}

    assert found("such an idiot") == {"plain"} and found("morbo sits") == {"plain"}
    assert found("you idiot") == {"aimed"} and found("not an idiot") == {"negated"}
    assert found("She said idiot things") == {"reported"} and found("I will hurt it") == {"threat"}
    assert found("idiotic") == found("") == found(None) == found("they hurt. not") == set()


def test_logistic_fit():
    x = np.array([[0.0], [1.0], [2.0], [3.0]])
    w = fit_logistic(x, np.array([0.0, 0, 1, 1]), 0.1)
    assert (probability(x, w) > 0.5).tolist() == [False, False, True, True]
    assert probability(x, fit_logistic(x[:0], np.zeros(0))).tolist() == [0.5] * 4


def test_urls_are_cut_as_stated():
    assert url_filter.split_url("HTTP://A.b/C?d#e") == ("a.b", "/C")
    assert url_filter.split_url("x://h?q/p") == ("h", "") and url_filter.split_url("no") == ("", "")
    assert url_filter.split_url(None) == ("", "") and url_filter.split_url("://") == ("", "")


def test_bpe_equals_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    from chartlore.llm import prefix_bpe
    from chartlore.llm.common import word_model

    ours = prefix_bpe.PrefixBpe(prefix_bpe.read_model(word_model()))
    theirs = tokenizers.Tokenizer.from_file(word_model())
    rnd = random.Random(7)
    texts = ["", "It's we'LL 12 ΟΔΟΣ İ <|startoftext|>é<|endoftext|>", "a" * 2000, "\x1c a\x85b　c", "aaaa bbbb" * 20, "ñandú ﬁ 😀👍🏽"]
    texts += ["".join(rnd.choice("aabbcdeéßΣ 's1.,-_") for _ in range(rnd.randint(1, 80))) for _ in range(400)]
    for text in texts:
        want = theirs.encode(text, add_special_tokens=False).ids
        got = ours.encode(text)
        assert np.frombuffer(got, "<u4").tolist() == want
        assert ours.decode(got) == theirs.decode(want, skip_special_tokens=False)
    assert ours.encode(None) == b"" and ours.decode(b"") == ""


def test_url_model_on_left_out_hosts():
    labelled = url_filter.labelled_urls()
    right = url_filter.left_out_accuracy(labelled)
    assert right[0] >= 0.9 and right[1] >= 0.9, right
    known = {part for url, _ in labelled for part in url_filter.split_url(url)[0].split(".")}
    # No labelled name is one of the given tables'.
    assert not known & {"adult-x", "casino-win", "free-bets", "cheap-pills", "spam-farm", "ads-track", "thother", "tionsh", "theron"}
