"""Near copies in crowded buckets: every pair of classes is compared."""
import random

import numpy as np

from chartlore.llm import order_minhash


def test_bitmaps_rule_out_no_near_pair():
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(9000)]
    texts = []
    for size in (60, 400, 480, 1900, 2100, 2300):
        first = rnd.choices(words, k=size)
        for changed in (0, size // 60, size // 45, size // 30, size // 10):
            other = list(first)
            for at in rnd.sample(range(size), changed):
                other[at] = rnd.choice(words)
            texts.append(" ".join(other + rnd.choices(words, k=changed)))
    runs = [order_minhash.labelled_shingles(t) for t in texts]
    n, bits = np.array([len(r) for r in runs]), [order_minhash.parity_bits(r) for r in runs]
    assert len(set(map(len, bits))) > 2
    near = {(i, j) for i in range(len(runs)) for j in range(i) if order_minhash.similarity(runs[i], runs[j]) >= 0.8}
    none = np.zeros(len(runs), bool)
    a, b = order_minhash.may_be_near(n, np.arange(len(runs)), none, bits, 0.8)
    found = {(max(p), min(p)) for p in zip(a.tolist(), b.tolist())}
    assert near and near <= found and len(found) < len(runs) * (len(runs) - 1) / 4
    classes, side = np.arange(len(runs)) % 3, np.arange(len(runs)) % 2 > 0
    a, b = order_minhash.may_be_near(n, classes, side, bits, 0.8)
    assert {(max(p), min(p)) for p in zip(a.tolist(), b.tolist())} == {
        (i, j) for i, j in found if classes[i] != classes[j] and side[i] != side[j]}


def test_near_copies_below_a_hot_passage(spark, monkeypatch):
    rnd = random.Random(200)
    words = [f"w{i}" for i in range(5000)]
    passage = rnd.choices(words, k=150)
    texts = [passage + rnd.choices(words, k=50) for _ in range(40)]
    tail = rnd.choices(words, k=50)
    other = list(tail)
    other[30:42] = rnd.choices(words, k=12)
    docs = spark.createDataFrame(
        list(enumerate(" ".join(t) for t in [*texts, passage + tail, passage + other])), "doc_id long, text string")
    for block in (2048, 8):
        monkeypatch.setattr(order_minhash, "BLOCK", block, raising=False)
        got = {r.doc_id: r.class_id for r in order_minhash.near_classes(docs).collect()}
        assert got == {i: min(i, 40) for i in range(42)}
