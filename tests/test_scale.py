"""What grows with the tables: placements, broadcasts, numbers of columns."""
import difflib
import random

from pyspark.sql import functions as F

from chartlore.functions.credits import primary_artist
from chartlore.operators import history, matching, reshape, yearend
from chartlore.plans import fixtures as fx
from chartlore.plans import report_queries
from chartlore.sources import lists

SF = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_history_is_derived_on_one_placement_by_list(spark):
    found = plan(fx.derive_entries(spark, SF))
    assert found.count("Exchange hashpartitioning(") - found.count("Exchange hashpartitioning(l_partkey") == 1
    assert plan(fx.yearend(spark, SF).filter("chart = 'list_0'")).count("Exchange hashpartitioning(cno#") <= 2


def test_placed_history_is_not_worked_out_twice(spark, entries, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    count = F.udf(lambda t: (seen.add(1), t)[1], "string").asNondeterministic()
    rows = entries([("a", "2024-01-06", 1, "One", "X, Y"), ("b", "2024-01-06", 1, "Two", "Q")]).withColumn("title", count("title"))
    lists.write_history(rows, str(tmp_path / "h"), placed=True)
    assert seen.value == 2
    stored = lists.read_keyed_history(spark, str(tmp_path / "h")).orderBy("chart").collect()
    assert [(r.title, r.k_title, r.k_artist) for r in stored] == [("One", "one", "x"), ("Two", "two", "q")]


def test_comparison_has_more_columns_than_a_pivot(spark, entries):
    rows = entries([("a", "2024-01-06", n, f"T{n}", "X") for n in range(1, 5)]).withColumn("name", F.lit("X"))
    limit = spark.conf.get("spark.sql.pivotMaxValues")
    spark.conf.set("spark.sql.pivotMaxValues", "3")
    try:
        cells = reshape.versus_weekly_cells(rows).collect()
    finally:
        spark.conf.set("spark.sql.pivotMaxValues", limit)
    assert sorted((r.header, r.rank) for r in cells) == [(f"X: T{n}", n) for n in range(1, 5)]


def test_list_pages_take_one_placement_and_no_broadcast(spark):
    page = history.chart_page(fx.keyed_entries(spark, SF), partitions=fx.tasks(spark, SF))
    found = plan(page)
    assert "Broadcast" not in found and page.rdd.getNumPartitions() == fx.tasks(spark, SF)
    assert found.count("Exchange hashpartitioning(") == 1


def test_exports_take_the_keys_that_rows_bring_along(spark, entries):
    rows = entries([("a", "2024-01-06", 1, "T", "X")]).withColumn("k_artist", F.lit("stored")).withColumn("name", F.lit("X"))
    assert [r.k_artist for r in reshape.versus_weekly_long(rows).collect()] == ["stored"]


def test_rows_are_matched_on_one_pass_over_them(spark):
    seen = spark.sparkContext.accumulator(0)
    count = F.udf(lambda t: (seen.add(1), t)[1], "string").asNondeterministic()
    e = spark.createDataFrame([("a", 1, 1, "Long Summer Nights", "Em"), ("a", 1, 2, "Other", "Em"), ("a", 1, 3, "Nothing Like It", "Em")],
                              "chart string, date int, rank int, title string, artist string")
    r = spark.createDataFrame([("a", 1, 1, "Long Sumer Night", "Em"), ("a", 1, 2, "Other", "Em"), ("a", 1, 3, "Else", "Em"), (None, None, 4, "Else", "Em")],
                              "chart string, date int, src_rank int, title string, artist string").withColumn("title", count("title"))
    got = {x.src_rank: x.m_rank for x in matching.match_rows(r, e, swapped=False, partitions=3).collect()}
    assert got == {1: 1, 2: 2, 3: None, 4: None} and seen.value == 4


def test_matching_takes_the_tasks_it_is_given(spark):
    e = spark.createDataFrame([("a", 1, 1, "T", "X")], "chart string, date int, rank int, title string, artist string")
    found = matching.match_entities(e.withColumnRenamed("rank", "src_rank"), e, partitions=37)
    assert found.rdd.getNumPartitions() == 37


def test_edit_bound_loses_no_title_that_is_alike(spark):
    rng = random.Random(11)
    titles = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 30))) for _ in range(400)]

    def typo(s):
        i = rng.randrange(len(s) + 1)
        return s[:i] + rng.choice(["", "a", "bc"]) + s[i + rng.randrange(2):]

    pairs = [(t, typo(typo(typo(t)))) for t in titles] + list(zip(titles, titles[1:]))
    alike = [p for p in pairs if difflib.SequenceMatcher(None, *p).ratio() >= 0.85]
    frame = spark.createDataFrame(alike, "t string, u string")
    assert len(alike) > 100 and frame.filter(matching._could_be_alike(F.col("t"), F.col("u"))).count() == len(alike)
    assert spark.createDataFrame(pairs, "t string, u string").filter(matching._could_be_alike(F.col("t"), F.col("u"))).count() < len(pairs)


def test_ledger_matches_in_the_tasks_it_is_given_and_moves_no_capture_ids(spark):
    e = spark.sql("SELECT 'a' AS chart, date'2024-01-10' AS date, 1 AS rank, 'T' AS title, 'X' AS artist")
    captures = spark.sql("SELECT 'a' AS chart, date'2024-01-01' AS week, timestamp'2024-01-11 00:00:00' AS taken, 'Final' AS status, 'c1' AS capture_id")
    rows = spark.sql("""SELECT 'a' AS chart, date'2024-01-01' AS week, src_rank, title, 'X' AS artist, '1,000' AS units, capture_id
                        FROM VALUES (1, 'T', 'c1'), (2, 'Q', 'c1'), (3, 'T', 'c0') AS v(src_rank, title, capture_id)""")
    found = matching.units_ledger(captures, rows, e, days=9, partitions=5)
    assert {r.src_rank: r.status for r in found.collect()} == {1: "used", 2: "unmatched", 3: "superseded"}
    read = [f for f in found.inputFiles() if "/taken-" in f]
    assert read and "capture_id" not in spark.read.parquet(*read).schema["row"].dataType.fieldNames()


def test_yearend_titles_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)
    count = F.udf(lambda t: (seen.add(1), t)[1], "string").asNondeterministic()
    y = spark.sql("SELECT 'a' AS chart, 2024 AS year, title FROM VALUES ('One'), ('Two'), ('Two'), (null) AS v(title)")
    w = spark.sql("SELECT 'a' AS chart, explode(sequence(date'2024-01-06', date'2024-12-28', interval 7 day)) AS date, 'one' AS title").union(
        spark.sql("SELECT 'a', date'2024-01-06', 'TWO!'"))
    got = yearend.accept_yearend(y.withColumn("title", count("title")), w.withColumn("title", count("title"))).collect()
    assert [(r.chart, r.year, r.accepted) for r in got] == [("a", 2024, True)] and seen.value == 4 + 53


def test_stored_files_hold_a_bounded_number_of_rows(spark, entries, tmp_path, monkeypatch):
    monkeypatch.setattr(lists, "ROWS_A_FILE", 10)
    rows = entries([("a", "2024-01-06", n, f"T{n}", "X") for n in range(1, 36)]).coalesce(1)
    lists.write_history(rows, str(tmp_path / "h"), placed=True)
    stored = spark.read.parquet(str(tmp_path / "h"))
    found = stored.groupBy("_metadata.file_path").agg(F.count("*").alias("n"), F.min("rank").alias("a"), F.max("rank").alias("b")).collect()
    assert sorted((r.a, r.b, r.n) for r in found) == [(1, 10, 10), (11, 20, 10), (21, 30, 10), (31, 35, 5)]


def test_credits_without_a_comma_of_a_name_are_not_walked_by_character(spark):
    credits = {"A, Guest & B": "a", "Tyler, Jr": "tyler, jr", "10,000 Maniacs, Q": "10,000 maniacs", "Abc, Ivy": "abc", "X, Y, Jr": "x", "Y, Jr, X": "y, jr", ",x": ""}
    frame = spark.createDataFrame([(c,) for c in credits], "artist string").select("artist", primary_artist(F.col("artist")).alias("k"))
    assert {r.artist: r.k for r in frame.collect()} == credits and "substring_index(" in plan(frame)


def test_weeks_are_fitted_and_placed_on_one_placement_by_list(spark):
    lists_, rows = report_queries.both_sources(spark, SF)
    found = matching.placements(matching.best_fit(rows, lists_, matching.week_candidates(rows, lists_, partitions=37), 37))
    text = plan(found)
    assert "Join" not in text and found.rdd.getNumPartitions() == 37
    assert text.count("Exchange hashpartitioning(chart") == 3 == text.count("Exchange hashpartitioning(")


def test_fit_counts_every_row_and_the_last_rank_of_a_title_twice_there(spark):
    e = spark.sql("SELECT 'a' AS chart, date'2024-01-10' AS date, * FROM VALUES (1, 'T'), (2, 't'), (3, NULL), (21, 'Q') AS v(rank, title)")
    r = spark.sql("SELECT 'a' AS chart, date'2024-01-01' AS week, * FROM VALUES (1, 'T'), (2, 'T!'), (3, NULL), (4, 'Q'), (11, 'T') AS v(src_rank, title)")
    pairs = spark.sql("SELECT 'a' AS chart, w AS week, d AS date FROM VALUES (date'2024-01-01', date'2024-01-10'), (date'2024-01-01', date'2024-01-11'), (date'2024-01-02', date'2024-01-10') AS v(w, d)")
    got = {(x.week.day, x.date.day): (x.exact, x.overlap) for x in matching.best_fit(r, e, pairs, 3).collect()}
    assert got == {(1, 10): (1, 2), (1, 11): (0, 0), (2, 10): (0, 0)}


def test_rows_matched_by_key_stay_where_they_are_for_the_fuzzy_step(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(matching, "staged", lambda frame, name: seen.append(frame) or frame)
    e = spark.createDataFrame([("a", 1, 1, "Long Summer Nights", "Em"), ("b", 1, 2, "Other", "Em")], "chart string, date int, rank int, title string, artist string")
    r = spark.createDataFrame([("a", 1, 1, "Long Sumer Night", "Em"), ("b", 1, 2, "Other", "Em")], "chart string, date int, src_rank int, title string, artist string")
    got = matching.match_fuzzy(matching.match_entities(r, e, partitions=7), e, partitions=7).collect()
    assert sorted((x.chart, x.date, x.src_rank, x.m_rank) for x in got) == [("a", 1, 1, 1), ("b", 1, 2, 2)]
    seen[0].collect()
    moved = [line for line in plan(seen[0]).split("Initial Plan")[0].splitlines() if "Exchange hashpartitioning(" in line]
    assert len(moved) == 3 and sum("ReusedExchange" in line for line in moved) == 1 and all("(chart#" in x and "date" not in x.split("(chart#")[1].split(")")[0] for x in moved)


def test_ledger_joins_and_broadcasts_nothing(spark, monkeypatch):
    seen, write = [], matching.staged
    monkeypatch.setattr(matching, "staged", lambda frame, name: seen.append(frame) or write(frame, name))
    e = spark.sql("SELECT 'a' AS chart, date'2024-01-10' AS date, rank, title, 'X' AS artist FROM VALUES (1, 'T'), (2, 'Q') AS v(rank, title)")
    captures = spark.sql("""SELECT chart, week, timestamp'2024-01-11 00:00:00' AS taken, 'Final' AS status, 'c1' AS capture_id FROM VALUES
                            ('a', date'2024-01-01'), (null, date'2024-01-01'), ('b', date'2024-01-01'), ('c', date'2024-01-01') AS v(chart, week)""")
    rows = spark.sql("""SELECT chart, week, src_rank, title, 'X' AS artist, '1,000' AS units, capture_id FROM VALUES
                        ('a', date'2024-01-01', 1, 'T', 'c1'), ('a', date'2024-01-01', 2, 'Q', 'c1'), ('a', date'2024-01-01', 3, 'T', 'c0'), ('a', date'2024-01-01', 4, 'T', null),
                        (null, date'2024-01-01', 1, 'T', 'c1'), ('a', null, 1, 'T', 'c1'), ('b', date'2024-01-01', 1, 'T', 'c1'), ('d', date'2024-01-01', 1, 'T', 'c1')
                        AS v(chart, week, src_rank, title, capture_id)""")
    official = spark.sql("""SELECT chart, date, title, 'X' AS artist, 5 AS units FROM VALUES
                            ('a', date'2024-01-10', 'T'), (null, date'2024-01-10', 'T'), ('b', date'2024-01-10', 'T') AS v(chart, date, title)""")
    owned = spark.sql("SELECT 'a' AS chart, date'2024-01-17' AS date")
    want = {("a", 1, "source"): "outranked", ("a", 2, "source"): "used", ("a", 3, "source"): "superseded", ("a", 4, "source"): "superseded",
            (None, 1, "source"): "superseded", ("b", 1, "source"): "pending", ("d", 1, "source"): "superseded",
            ("a", 1, "official"): "used", (None, 1, "official"): "rejected", ("b", 1, "official"): "rejected"}
    for partitions in (5, None):
        found = matching.units_ledger(captures, rows, e, official, owned, days=9, partitions=partitions)
        got = found.collect()
        assert {(r.chart, r.src_rank, r.source): r.status for r in got if r.week is not None} == want and len(got) == 11
        assert [(r.chart, r.status) for r in got if r.week is None] == [("a", "superseded")]
    fits = matching.units_ledger(captures, rows, e, official, owned, partitions=5)
    assert {(r.chart, r.src_rank): r.status for r in fits.filter("source = 'source' AND chart IN ('a', 'b') AND week IS NOT NULL AND src_rank < 3").collect()} == {
        ("a", 1): "unplaced", ("a", 2): "unplaced", ("b", 1): "unplaced"}
    assert all("Join" not in plan(f) and "Broadcast" not in plan(f) for f in [*seen, found, fits])
