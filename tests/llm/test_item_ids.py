"""Benchmark items that share an id or have none."""
import collections

from chartlore.llm import edit_leaks


def test_each_text_of_an_id_and_null_ids_are_searched(spark):
    first, second, third = ("the quick brown fox jumps over the lazy dog", "pack my box with five dozen liquor jugs",
                            "how vexingly quick daft zebras jump today")
    items = spark.createDataFrame([(1, first), (1, second), (None, third), (None, None), (2, second), (2, " " + second.upper())],
                                  "item_id bigint, text string")
    docs = spark.createDataFrame([(i, f"aa {t} zz") for i, t in enumerate((first, second, third, "none"))], "doc_id bigint, text string")
    for size in (edit_leaks.BLOCK_CHARS, 30):
        got = collections.Counter((r.doc_id, r.item_id) for r in edit_leaks.leak_report(docs, items, block_chars=size).collect())
        assert got == {(0, 1): 1, (1, 1): 1, (1, 2): 1, (2, None): 1}
        assert [r.doc_id for r in edit_leaks.drop_leaked(docs, items, block_chars=size).collect()] == [3]
