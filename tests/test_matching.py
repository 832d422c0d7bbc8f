"""Fuzzy matching against a plain restatement on a small fixture."""
import difflib
import random

from pyspark.sql import functions as F

from chartlore.operators import matching


def likeness(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


def settle(open_rows, spare):
    """Sequential statement of the rule: rows by rank, one entry each."""
    spare, won = list(spare), {}
    for rank, title, artist in sorted(open_rows):
        rules = [
            lambda e: len(title) >= 4 and len(e[0]) >= 4 and (e[0].startswith(title) or title.startswith(e[0])),
            lambda e: e[1] == artist and likeness(title, e[0]) >= 0.85,
            lambda e: likeness(title, e[0]) >= 0.85 and likeness(artist, e[1]) >= 0.85,
        ]
        for rule in rules:
            fitting = [e for e in spare if rule(e)]
            if len(fitting) == 1:
                won[rank] = fitting[0]
                spare.remove(fitting[0])
                break
    return won


def test_fuzzy_equals_sequential(spark):
    rng = random.Random(5)
    letters = "abcdefgh"

    def word(n):
        return "".join(rng.choice(letters) for _ in range(n))

    def typo(s):
        i = rng.randrange(len(s))
        return s[:i] + rng.choice(["", rng.choice(letters)]) + s[i + 1:]

    entries, rows = [], []
    for week in range(12):
        date = f"2024-01-{week + 1:02d}"
        stems = [word(rng.choice((4, 9, 14, 22))) for _ in range(6)]
        names = [word(9) for _ in range(4)]
        for rank in range(1, 25):
            stem = rng.choice(stems)
            t = rng.choice([stem, stem + word(3), typo(stem), typo(typo(stem + word(6)))])
            entries.append(("a", date, rank, t, typo(rng.choice(names))))
            rows.append(("a", date, rank, rng.choice([stem, typo(t), t[:6], typo(typo(t))]), rng.choice(names)))
    as_date = F.col("date").cast("date")
    e = spark.createDataFrame(entries, "chart string, date string, rank int, title string, artist string").withColumn("date", as_date)
    r = spark.createDataFrame(rows, "chart string, date string, src_rank int, title string, artist string").withColumn("date", as_date)
    first = matching.match_entities(r, e)
    got = {(str(x.date), x.src_rank): (x.m_title, x.m_artist, x.m_rank) for x in matching.match_fuzzy(first, e).collect()}
    base = first.collect()
    filled = 0
    for date in sorted({x[1] for x in entries}):
        mine = [x for x in base if str(x.date) == date]
        used = {(x.m_rank) for x in mine if x.m_rank is not None}
        spare = [(t, a, rank) for _, dd, rank, t, a in entries if dd == date and rank not in used]
        want = settle([(x.src_rank, x.k_t, x.k_a) for x in mine if x.m_rank is None], spare)
        for x in mine:
            expected = (x.m_title, x.m_artist, x.m_rank) if x.m_rank is not None else want.get(x.src_rank, (None, None, None))
            assert got[date, x.src_rank] == expected, (date, x)
        filled += len(want)
    assert filled > 20


def test_containment_needs_one_fit(spark):
    e = spark.createDataFrame([("a", 1, 1, "Curtain Call: The Hits", "Em"), ("a", 1, 2, "Revival", "Em"),
                               ("a", 1, 3, "Part One Two", "Q"), ("a", 1, 4, "Part One Two Three", "Q")],
                              "chart string, date int, rank int, title string, artist string")
    r = spark.createDataFrame([("a", 1, 1, "Curtain Call", "Em & X"), ("a", 1, 2, "Part One", "Q"),
                               ("a", 1, 3, "Curtain", "Em")],
                              "chart string, date int, src_rank int, title string, artist string")
    got = {x.src_rank: x.m_rank for x in matching.match_entities(r, e).collect()}
    # Two fits resolve nothing, and an entry goes to the first row only.
    assert got == {1: 1, 2: None, 3: None}


def test_place_weeks_moves_the_odd_one(spark):
    rows = []
    for i in range(5):
        week = f"2024-{i + 1:02d}-01"
        rows += [("a", week, 9, 8, 9), ("a", week, 16, 2, 8)]
    rows = [r for r in rows if r[1] != "2024-03-01"] + [("a", "2024-03-01", 9, 5, 8), ("a", "2024-03-01", 16, 7, 9)]
    fits = spark.createDataFrame(rows, "chart string, week string, lag int, exact int, overlap int").selectExpr(
        "chart", "cast(week AS date) AS week", "date_add(cast(week AS date), lag) AS date", "exact", "overlap")
    got = [(x.date - x.week).days for x in matching.place_weeks(fits).collect()]
    assert got == [9] * 5


def test_containment_of_a_busy_artist(spark):
    # One artist holds all of a list.
    rng = random.Random(7)
    stems = ["".join(rng.choice("abc") for _ in range(rng.choice((1, 3, 5, 9)))) for _ in range(60)]
    shown = sorted({"x" + s + rng.choice(["", "qq", "rest"]) for s in stems})
    asked = sorted({s[rng.randrange(2):] for s in shown} - set(shown))
    e = spark.createDataFrame([("a", 1, i, t, "Busy") for i, t in enumerate(shown)],
                              "chart string, date int, rank int, title string, artist string")
    r = spark.createDataFrame([("a", 1, i, t, "Busy") for i, t in enumerate(asked)],
                              "chart string, date int, src_rank int, title string, artist string")
    got = {x.src_rank: x.m_rank for x in matching.match_entities(r, e).collect()}
    want, used = {}, set()
    for i, t in enumerate(asked):
        fits = [k for k, s in enumerate(shown) if t in s or s in t]
        hit = fits[0] if len(fits) == 1 and fits[0] not in used else None
        used.add(hit)
        want[i] = hit
    assert got == want and any(v is not None for v in want.values())
