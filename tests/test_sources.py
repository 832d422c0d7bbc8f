"""List files as ordinary CSV, page text, folded letters, tied source ranks."""
import csv
import os
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from chartlore.functions import text
from chartlore.functions.sql import register_sql_functions
from chartlore.operators import matching
from chartlore import schemas, session
from chartlore.operators import history
from chartlore.sources import lists, pages


def test_csv_by_name_with_doubled_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        'Rank,Song,Weeks in Charts,Artist,Date\n1,"The ""Heroes"", Live",7,Bowie,2024-01-06\n2,Plain,1,"A, B",2024-01-06\n')
    got = [(r.rank, r.title, r.artist, str(r.date), r.weeks_on_chart, r.peak_position)
           for r in lists.scan_chart_csv(spark, str(tmp_path / "a.csv"), "a").orderBy("rank").collect()]
    assert got == [(1, 'The "Heroes", Live', "Bowie", "2024-01-06", 7, None), (2, "Plain", "A, B", "2024-01-06", 1, None)]


def test_csv_written_is_read_by_others(spark, tmp_path, entries):
    rows = [("a", "2024-01-06", 1, 'The "Heroes", Live', "Bowie"), ("a", "2024-01-06", 2, "back\\slash", 'x"')]
    lists.csv_sink(entries(rows), str(tmp_path / "out"), partition=False)
    found = []
    for part in (tmp_path / "out").glob("part-*.csv"):
        with part.open(newline="") as file:
            found += [(r["Song"], r["Artist"]) for r in csv.DictReader(file)]
    assert sorted(found) == sorted((r[3], r[4]) for r in rows)


def test_csv_values_with_line_ends(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Date,Rank,Song,Artist\n2024-01-06,1,"two\nlines",x\n')
    got = lists.scan_chart_csv(spark, str(tmp_path / "a.csv"), "a", multi_line=True).collect()
    assert [(r.rank, r.title) for r in got] == [(1, "two\nlines")]


def test_csv_without_a_required_column_raises(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,Song,Artist\n2024-01-06,x,y\n")
    with pytest.raises(ValueError, match="rank"):
        lists.scan_chart_csv(spark, str(tmp_path / "a.csv"), "a")


def test_one_list_lies_in_few_files(spark, tmp_path, entries):
    rows = [(f"list_{c}", f"20{y:02d}-01-06", 1, f"t{c}", "a") for c in range(20) for y in range(10, 30)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    lists.write_history(entries(rows), str(tmp_path / "h"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    stored = spark.read.parquet(str(tmp_path / "h"))
    assert len(stored.inputFiles()) >= 6
    assert stored.filter("chart = 'list_3'").select(F.input_file_name()).distinct().count() <= 2


def folded(letters):
    plain = unicodedata.normalize("NFKD", letters).encode("ascii", "ignore").decode().casefold().replace("&", " and ")
    return re.sub("[^a-z0-9]", "", plain)


def test_norm_folds_every_letter_of_the_basic_plane(spark):
    codes = [c for c in (*range(1, 0xD800), *range(0xE000, 0x10000))]
    rows = [(i, "x".join(map(chr, codes[i:i + 64]))) for i in range(0, len(codes), 64)]
    frame = spark.createDataFrame(rows, "i int, t string").repartition(8).select("i", text.norm(F.col("t")).alias("v"))
    assert {r.i: r.v for r in frame.collect()} == {i: folded(t) for i, t in rows}


def test_sql_title_key_folds_alike(spark):
    register_sql_functions(spark)
    t = "Beyoncé Ñandú ﬁre Ⅳ Ệ Đ ș (EP)"
    frame = spark.createDataFrame([(t,)], "t string")
    row = frame.select(F.expr("title_key(t)").alias("a"), text.title_key(F.col("t")).alias("b")).first()
    assert row.a == row.b == folded(t.replace("(EP)", " "))


def test_page_rows_over_lines_with_quotes_and_entities(spark):
    html = "<ul><li class='x'>A &amp;lt; &eacute;&#233;&#xE9;\n&hellip;</li><li class='x'>&bogus; &#x110000; B&nbsp;</li></ul>"
    frame = spark.createDataFrame([(1, html)], "page_id int, html string")
    got = [(r.rank, r.text) for r in pages.extract_ranked_rows(frame, "<li class='x'>(.*?)</li>").collect()]
    assert got == [(1, "A &lt; ééé\n…"), (2, "&bogus; &#x110000; B")]


def test_tied_source_ranks_use_an_entry_once(spark):
    e = spark.createDataFrame([("a", 1, 1, "Gold Road", "Ann")], "chart string, date int, rank int, title string, artist string")
    r = spark.createDataFrame([("a", 1, 5, "Gold Road", "Ann"), ("a", 1, 5, "Gold Road", "Ann feat. Bo")],
                              "chart string, date int, src_rank int, title string, artist string")
    first = matching.match_entities(r, e)
    assert sorted(str(x.m_rank) for x in first.collect()) == ["1", "None"]
    near = spark.createDataFrame([("a", 1, 5, "Gold Roads", "Ann"), ("a", 1, 5, "Gold Roadz", "Ann"), ("a", 1, 6, "", "Zed")],
                                 "chart string, date int, src_rank int, title string, artist string")
    empty = e.unionByName(spark.createDataFrame([("a", 1, 2, "", "Zed")], e.schema))
    found = {x.title: x.m_rank for x in matching.match_fuzzy(matching.match_entities(near, e), empty).collect()}
    assert found == {"Gold Roads": 1, "Gold Roadz": None, "": None}


def test_keys_are_stored_and_versioned(spark, tmp_path, entries, monkeypatch):
    path = str(tmp_path / "h")
    lists.write_history(entries([("a", "2024-01-06", 1, " One ", "X Featuring Y"), ("a", "2024-01-06", 2, "Two", "Q, R")]), path)
    want = [("one", "x", "x featuring y"), ("two", "q", "q, r")]
    keyed = lists.read_keyed_history(spark, path)
    assert [tuple(r) for r in keyed.orderBy("rank").select("k_title", "k_artist", "k_credit").collect()] == want
    assert history.with_all_keys(keyed) is keyed
    assert lists.read_history(spark, path).columns == schemas.ENTRY.fieldNames()
    # Files of an older rule are keyed anew, the others keep what is stored.
    monkeypatch.setattr(lists, "KEY_RULE", lists.KEY_RULE + 1)
    lists.write_history(entries([("b", "2024-01-06", 1, "Three", "Z")]).withColumn("k_title", F.lit("stale")), path, "append")
    both = lists.read_keyed_history(spark, path)
    assert [tuple(r) for r in both.orderBy("chart", "rank").select("k_title", "k_artist", "k_credit").collect()] == [*want, ("three", "z", "z")]
    assert lists.read_history(spark, path).count() == 3


def test_catalogue_reports_what_cannot_be_used(spark, tmp_path):
    (tmp_path / "good.csv").write_text('Date,Rank,Song,Artist\n1/6/2024,1,"S, T",x\n')
    (tmp_path / "era.csv").write_text('"Song","Artist","Rank","Date","Weeks in Charts"\nS,x,2,1/13/2024,4\n')
    (tmp_path / "bare.csv").write_text("Date,Artist\n1/6/2024,x\n")
    (tmp_path / "twice.csv").write_text("Date,Rank,Song,song,Artist\n1/6/2024,1,S,S,x\n")
    found = lists.catalogue(spark, str(tmp_path))
    assert {r.chart: r.defect for r in found.collect()} == {
        "good": None, "era": None, "bare": "no column for rank, title", "twice": "a column twice"}
    got = {(r.chart, r["rank"], r.title, r.weeks_on_chart) for r in lists.scan_catalogued(spark, found).collect()}
    assert got == {("good", 1, "S, T", None), ("era", 2, "S", 4)}
    assert lists.scan_catalogued(spark, found.filter("chart = 'bare'")).collect() == []


def test_staged_files_are_dropped(spark):
    mark = session.staged_count(spark)
    kept = [session.staged(spark.range(n), "part") for n in (3, 4, 5)]
    files = [os.path.dirname(k.inputFiles()[0].removeprefix("file://")) for k in kept]
    session.drop_staged(spark, mark, keep_last=True)
    assert [os.path.exists(f) for f in files] == [False, False, True] and kept[2].count() == 5
    session.drop_staged(spark, mark)
    assert not os.path.exists(files[2]) and session.staged_count(spark) == mark
