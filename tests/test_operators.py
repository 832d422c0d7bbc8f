"""Operators on small histories with known answers."""
import datetime as dt
import random

from pyspark.sql import functions as F

from chartlore.functions.credits import names_artist_col
from chartlore.operators import calendar, compare, history, ingest, quality, stats, titles, yearend
from chartlore.plans import fixtures as fx

SF = "/root/testdata/sf0.001"


def d(s):
    return dt.date.fromisoformat(s)


W = ["2024-01-06", "2024-01-13", "2024-01-20", "2024-01-27", "2024-02-03"]


def registry(spark, *rows):
    return spark.createDataFrame(rows or [("a", "A", "g", 3, "song", 1)],
                                 "chart string, label string, grp string, depth int, kind string, ord int")


def test_page_uses_history_not_dates(entries):
    # "One" misses the third week and re-enters; its credit drifts mid-run.
    e = entries([
        ("a", W[0], 2, "One", "X"), ("a", W[0], 1, "Two", "Y"),
        ("a", W[1], 1, "one ", "X Featuring Z"), ("a", W[1], 2, "Two", "Y"),
        ("a", W[3], 1, "Two", "Y"), ("a", W[4], 1, "One", "X"), ("a", W[4], 3, "Two", "Y"),
        ("a", W[4], None, "Three", "Q"),
    ])
    page = {(r.date, r.title): r for r in history.chart_page(e).collect()}
    assert len(page) == 7
    debut = page[d(W[0]), "One"]
    assert (debut.change, debut.last_week, debut.new_peak, debut.tags) == ("new", None, False, ["new"])
    up = page[d(W[1]), "one"]
    assert (up.change, up.change_amount, up.peak, up.new_peak, up.weeks, up.tags) == ("up", 1, 1, True, 2, ["peak"])
    # The third week was not published, so the fourth follows the second.
    assert page[d(W[3]), "Two"].change == "up"
    back = page[d(W[4]), "One"]
    # Exact credit weeks 1 and 5; the variant week 2 lies outside this run.
    assert (back.change, back.weeks, back.peak, back.new_peak) == ("re-entry", 2, 1, False)
    assert page[d(W[4]), "Two"].change == "down"


def test_page_credit_variants_count_inside_a_run(entries):
    e = entries([("a", W[0], 1, "S", "X"), ("a", W[1], 1, "S", "X & Z"), ("a", W[2], 1, "S", "X")])
    assert [r.weeks for r in history.chart_page(e).orderBy("date").collect()] == [1, 2, 3]


def test_dropouts_and_recurrents(spark, entries):
    e = entries([
        ("a", W[0], 1, "Keep", "The Kid LAROI"), ("a", W[0], 30, "Gone", "B"), ("a", W[0], 2, "Late", "C"),
        ("a", W[2], 1, "keep", "The Kid Laroi"),
        ("p", W[0], 1, "Actor", "Unknown"), ("p", W[0], 2, "Singer", "Unknown"), ("p", W[1], 1, "Actor", "Someone"),
    ]).withColumn("weeks_on_chart", F.when(F.col("title") == "Gone", 21).otherwise(3))
    reg = registry(spark, ("a", "A", "g", 3, "song", 1), ("p", "P", "g", 3, "artist", 2))
    gone = compare.dropouts(e, reg)
    assert {(r.chart, r.title, r.artist) for r in gone.collect()} == {
        ("a", "Gone", "B"), ("a", "Late", "C"), ("p", "Singer", None)}
    assert [r.title for r in compare.recurrents(gone).collect()] == ["Gone"]
    # The first week has no predecessor and is reported as the second.
    for week in (None, W[0], W[2], "2030-01-01"):
        assert [r.title for r in compare.dropouts_on(e, reg, "a", week).collect()] == ["Late", "Gone"]


def test_reign_and_gap(entries):
    e = entries([("a", W[0], 1, "S", "X"), ("a", W[1], 2, "S", "X"), ("a", W[2], 1, "S", "X"), ("a", W[3], 1, "S", "X")])
    assert history.reign(e).first().weeks == 3
    got = history.reign(e, stop_at_gap=True).first()
    assert (got.weeks, got.since) == (2, d(W[2]))


def test_artist_stats(spark, entries):
    e = entries([
        ("a", W[0], 1, "S", "X"), ("a", W[0], 12, "T", "X & Y"), ("a", W[1], 1, "s", "X Featuring Q"),
        ("a", W[1], 50, "T", "X"), ("p", W[0], 1, "X", "X"),
    ])
    reg = registry(spark, ("a", "A", "g", 3, "song", 1), ("p", "P", "g", 3, "artist", 2))
    got = {r.chart: r for r in stats.artist_coverage(e, reg, ["X", "nobody"]).collect()}
    a = got["a"]
    assert (a.entries, a.number_ones, a.weeks_at_1, a.top_10s, a.top_40s, a.total_weeks_charted) == (2, 1, 2, 1, 2, 2)
    assert (a.best_peak, a.biggest_hit, a.hidden) == (1, "S", 0)
    p = got["p"]
    assert (p.entries, p.number_ones, p.biggest_hit) == (None, None, None)
    assert (p.best_peak, p.total_weeks_charted) == (1, 1)
    versus = stats.versus(e, "a", ["nobody", "x"]).collect()
    assert [(r.name, r.entries, r.best_peak, r.display_name) for r in versus] == [
        ("nobody", 0, None, "nobody"), ("x", 2, 1, "X")]


def test_display_name_is_modal_leading_credit(entries):
    e = entries([("a", w, 1, "S", c) for w, c in zip(W, ["Kid LAROI", "Kid Laroi & B", "Kid Laroi", "Z & Kid Laroi"])])
    assert stats.display_names(stats.artist_rows(e, ["kid laroi"])).first().shown == "Kid Laroi"


def test_index_and_crossovers(spark, entries):
    e = entries([
        ("a", W[0], 5, "1989", "T"), ("a", W[0], 6, "1989", "Other"), ("b", W[1], 2, " 1989", "t & G"), ("b", W[1], 3, "1989", "T"),
        ("c", W[2], 1, "1989", "T"), ("a", None, 1, "Undated", "T"), ("a", W[0], 1, None, "T"),
    ])
    reg = registry(spark, ("a", "A", "g", 3, "song", 1), ("b", "B", "g", 3, "song", 2), ("c", "C", "g", 3, "album", 3))
    idx = titles.title_index(e, reg)
    assert idx.count() == 4
    row = idx.filter("chart = 'b'").first()
    assert (row.peak, row.weeks, row.k_artist) == (2, 1, "t")
    asked = spark.createDataFrame([("1989", "t", "song", "a", d(W[0])), ("1989", "t", "song", None, None)],
                                  "k_title string, k_artist string, kind string, origin string, origin_debut date")
    got = {(r.origin, r.chart): r.later for r in titles.crossovers(idx, asked).collect()}
    assert got == {("a", "b"): True, (None, "a"): None, (None, "b"): None}
    assert [r.charts for r in titles.suggest(idx, "song", "19").collect()] == [2, 1]
    assert titles.missing_columns(e.drop("rank")) == ["rank"]


def test_news_order_and_skips(spark, entries):
    e = entries([
        ("a", W[0], 1, "Old", "X"), ("a", W[0], 30, "Up", "X"), ("a", W[1], 1, "New", "X"), ("a", W[1], 2, "Up", "X"),
        ("b", W[0], 1, "Old", "X"), ("b", W[1], 1, "New", "X"), ("c", W[0], 1, "Stale", "X"),
    ])
    reg = registry(spark, ("a", "Zed", "g", 3, "song", 1), ("b", "Alpha", "g", 3, "song", 2), ("c", "C", "g", 3, "song", 3))
    news = compare.weekly_news(e, reg, ["a"]).collect()
    ones = sorted((r.place, r.chart) for r in news if r.section == "new_one")
    assert ones == [(1, "a"), (2, "b")]
    assert [(r.title, r.was, r.rank) for r in news if r.section == "climb"] == [("Up", 30, 2)]
    assert {r.chart for r in news} == {"a", "b"}


def test_quality(spark, entries):
    base = [("a", W[0], r, f"T{r}", "X") for r in (1, 2, 3)]
    e = entries(base + [("a", W[1], r, f" t{r}", "Y") for _, _, r, _, _ in base] + [("a", W[3], 1, "T3", "X"), ("a", W[3], 3, "T1", "X")])
    assert [r.date for r in quality.clamped_weeks(e).collect()] == [d(W[1])]
    assert [r.date for r in calendar.non_weekly_steps(e).collect()] == [d(W[3])]
    whole = quality.refuse_incomplete_ranks(e, ["chart", "date"])
    assert {r.date for r in whole.collect()} == {d(W[0]), d(W[1])}
    feeds = e.withColumn("feed", F.lit("f"))
    # Two rows at the latest week prove nothing.
    assert [r.proven for r in quality.prove_feed(e, feeds).collect()] == [False]


def test_signature_depends_on_order_not_on_layout(entries):
    rows = [("a", W[0], r, f"T{r}", "X") for r in range(1, 60)]
    swapped = [("b", W[0], {1: 2, 2: 1}.get(r, r), f"T{r}", "X") for r in range(1, 60)]
    same = [("c", W[0], r, f"T{r}", "X") for r in range(59, 0, -1)]
    got = {r.chart: r.signature for r in quality.ranking_signatures(entries(rows + swapped + same), ["chart"]).collect()}
    assert got["a"] == got["c"] != got["b"]


def test_real_years_across_gaps(spark):
    lists = {1978: "old", 2005: "old", 2009: "old", 2010: "new", 1990: "weekly"}
    y = spark.createDataFrame([("a", year, 1, t, "X") for year, t in lists.items()],
                              "chart string, year int, rank int, title string, artist string")
    weekly = quality.ranking_signatures(y.filter("year = 1990"), ["chart"])
    got = {r.year: (r.genuine, r.duplicate_of) for r in yearend.real_years(y, weekly).collect()}
    assert got == {1978: (False, 2009), 2005: (False, 2009), 2009: (True, None), 2010: (True, None), 1990: (False, None)}


def test_nearest_date_takes_newest_on_a_tie(spark, entries):
    e = entries([("a", "2024-01-06", 1, "S", "X"), ("a", "2024-01-16", 1, "S", "X")])
    asked = spark.createDataFrame([("a", d(x)) for x in ("2024-01-01", "2024-01-11", "2024-01-10", "2025-01-01")],
                                  "chart string, asked date")
    got = {r.asked.day: r.date.day for r in calendar.nearest_date(e, asked).collect() if r.asked.year == 2024}
    assert got == {1: 6, 11: 16, 10: 6}


def test_upsert_newest_wins_and_hot_copies(spark, entries):
    old = entries([("a", W[0], 1, "Old", "X"), ("a", W[0], 2, "Kept", "X")])
    # A third of the rows are copies of one position.
    new = entries([("a", W[0], 1, "New", "X")] * 500 + [("a", W[1], r, "S", "X") for r in range(1, 1001)])
    got = ingest.merge_upsert(old, new)
    assert got.count() == 1002
    assert {r.title for r in got.filter(F.col("date") == W[0]).collect()} == {"New", "Kept"}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_hot_title_keeps_every_row(entries):
    # One title holds a third of all rows over many weeks.
    days = [dt.date(1990, 1, 6) + dt.timedelta(7 * i) for i in range(400)]
    rows = [("a", str(x), 1, "Hot", "H") for x in days]
    rows += [("a", str(x), r, f"T{i % 97}-{r}", f"A{i % 13}") for i, x in enumerate(days) for r in (2, 3)]
    page = history.chart_page(entries(rows))
    assert page.count() == 1200
    assert page.filter("title = 'Hot'").agg(F.max("weeks")).first()[0] == 400


def test_missing_weeks(spark, entries):
    e = entries([("a", W[0], 1, "S", "X"), ("a", W[3], 1, "S", "X")])
    seg = spark.createDataFrame([("a", d(W[0]), d(W[4]))], "chart string, first date, last date")
    gap = spark.createDataFrame([("a", d(W[1]), d(W[1]))], "chart string, first date, last date")
    extra = spark.createDataFrame([("a", d("2024-02-04"))], "chart string, date date")
    got = [str(r.date) for r in calendar.missing_weeks(e, seg, gap, extra).orderBy("date").collect()]
    assert got == [W[2], W[4], "2024-02-04"]


def test_stored_index_is_versioned_and_pruned(spark, tmp_path):
    entries = fx.entries(spark, SF)
    registry = fx.registry(spark, SF)
    version = titles.history_version(entries)
    assert version == titles.history_version(entries.repartition(7)) != titles.history_version(entries.limit(5))
    assert titles.stored_title_index(spark, "kept", version) is None
    built = titles.title_index(entries, registry)
    titles.save_title_index(built, "kept", version, str(tmp_path), 4)
    assert titles.stored_title_index(spark, "kept", "other") is None
    index = titles.stored_title_index(spark, "kept", version)
    assert sorted(map(tuple, index.by_title.collect())) == sorted(map(tuple, built.collect()))
    # A question for one title reads one bucket and builds nothing.
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else the plan doesn't name the buckets
    try:
        for ask in (titles.lookup(index.by_title, "Gear", "RED 0", "song"), titles.suggest(index.by_letter, "song", "ge")):
            plan = ask._jdf.queryExecution().executedPlan().toString()
            assert "SelectedBucketsCount: 1 out of 4" in plan and plan.count("FileScan") == 1
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    # All titles at once need no exchange of the table.
    everything = titles.all_crossovers(index.by_title)
    assert "Exchange" not in everything._jdf.queryExecution().executedPlan().toString()
    want = titles.crossovers(built, titles.origins(built))
    assert sorted(map(repr, everything.collect())) == sorted(map(repr, want.collect()))
    for prefix in ("g", "GE", "ri", ""):
        for ask in (titles.suggest, titles.title_pool):
            assert ask(index.by_letter, "song", prefix).collect() == ask(built, "song", prefix).collect()
    # A title with no other list, and one that is not known.
    assert titles.lookup(index.by_title, "No such title", "Nobody", "song").collect() == []


def test_names_by_words_equal_the_pattern(spark):
    rng = random.Random(8)
    names = ["A", "b c", "Tyler, The Creator", "x", "with b", "The Who", "who", "(a)", "/", "and", "J. B.", "A & b c", "", "  ", "feat", "b  c"]
    glue = [" Featuring ", " & ", ", ", " / ", " with ", " x ", "(", ") ", " and ", " ", "-", " feat. ", "  ", " + "]
    credits = {"The A Band", "the b c band", "the the who band", "A & with b", None, "", " a ", "(A)", "/", "x x x"}
    while len(credits) < 400:
        credits.add("".join(rng.choice(names) + rng.choice(glue) for _ in range(rng.randrange(1, 5))) + rng.choice(names))
    shown = spark.createDataFrame([(c,) for c in credits], "artist string")
    asked = spark.createDataFrame([(n,) for n in names], "name string")
    got = {tuple(r) for r in stats.named_credits(shown, asked).collect()}
    want = {tuple(r) for r in shown.crossJoin(asked).filter(names_artist_col(F.col("artist"), F.col("name"))).collect()}
    assert got == want and len(want) > 300
    rows = shown.withColumn("n", F.lit(1))
    many = [n for n in names if n.strip()] + [f"nobody {i}" for i in range(20)]
    assert sorted(map(repr, stats.artist_rows(rows, many).collect())) == sorted(
        repr(r) for half in (many[:10], many[10:24], many[24:]) for r in stats.artist_rows(rows, half).collect())
