"""What the bound of 400 bytes means for repeated passages of over 50 words."""
import hashlib
import random
import string

import pytest

from chartlore.llm import window_dedup


@pytest.mark.parametrize("size", [394, 399, 400, 401])
def test_passages_of_over_50_words_go_from_400_bytes_on(spark, size):
    rnd = random.Random(size)

    def words(n):
        return " ".join("".join(rnd.choices(string.ascii_lowercase, k=5)) for _ in range(n))

    passage, own = words(90)[:size - 1] + ".", words(90)[:size - 1] + "."
    assert len(passage) == size and len(passage.split()) > 50
    # Other neighbours each time, so what repeats is the passage alone.
    edges = [(words(100) + a, b + words(100)) for a, b in ("AB", "CD", "EF", "GH", "IJ")]
    parts = [(edges[0][0], passage, edges[0][1]), (edges[1][0], passage, edges[1][1]),  # in two documents
             (edges[2][0], own, edges[2][1] + edges[3][0], own, edges[3][1]),  # twice in one
             (*edges[4],)]  # clean
    docs = spark.createDataFrame([(i, "".join(p)) for i, p in enumerate(parts)], "doc_id long, text string").repartition(2)
    want = []
    for i, p in enumerate(parts):
        gone = p[1::2] if size >= 400 and len(p) > 2 else ()
        kept = "".join(p[::2] if gone else p)
        want.append((i, len("".join(p)), sum(map(len, gone)), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = [tuple(r) for r in window_dedup.repeats_report(docs).collect()]
    assert sorted(got) == want
