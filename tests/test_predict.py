"""The next number one: features look back only, and the model adds to "no change"."""
import datetime as dt
import math

from pyspark.sql import functions as F

from chartlore.operators import predict
from chartlore.operators.calendar import published_weeks
from chartlore.plans import history_queries


def history(entries, weeks=160, depth=8):
    """Titles rise and fall in waves, so movement tells who is next."""
    start, rows = dt.date(2000, 1, 1), []
    for w in range(weeks):
        for chart in ("a", "b"):
            height = {f"t{i}": math.cos((w - 4 * i - (chart == "b")) * math.pi / 9) * (1 + i % 3 / 10) if abs(w - 4 * i) < 9 else -2
                      for i in range(weeks // 4 + 3)}
            top = sorted((t for t, h in height.items() if h > -2), key=lambda t: (-height[t], t))[:depth]
            rows += [(chart, str(start + dt.timedelta(days=7 * w)), r, t, "x") for r, t in enumerate(top, 1)]
    return entries(rows)


def test_features_do_not_look_ahead(spark, entries):
    whole = history(entries, 40)
    cut = dt.date(2000, 6, 3)
    names = ["chart", "date", "k_title", *predict.FEATURES]
    full = predict.next_week_candidates(whole).filter(F.col("date") <= F.lit(cut)).select(*names)
    part = predict.next_week_candidates(whole.filter(F.col("date") <= F.lit(cut)))
    assert sorted(map(tuple, full.collect())) == sorted(map(tuple, part.select(*names).collect()))
    last = part.filter(F.col("date") == F.lit(cut))
    assert last.count() > 0 and last.filter("label IS NOT NULL").count() == 0
    # Weeks of the training set end before any label lies on or after the split.
    one = predict.next_week_candidates(entries([("a", "2000-01-01", 1, "s", "x"), ("a", "2000-01-08", 2, "s", "x"),
                                                ("a", "2000-01-08", 1, "t", "x"), ("a", "2000-01-22", 1, "s", "y"),
                                                ("a", "2000-01-22", 2, "t", "x")])).orderBy("date", "rank").collect()
    got = [(r.k_title, r.k_artist, r.rise_1, r.weeks, r.peak, r.held, r.is_debut, r.incumbent_rise, r.label) for r in one]
    assert got == [("s", "x", 0, 1, 1, 1, 1, 0, 0), ("t", "x", 0, 1, 1, 1, 1, 0, 0), ("s", "x", -1, 2, 1, 0, 0, 0, 0),
                   ("s", "y", 0, 1, 1, 1, 1, 0, None), ("t", "x", -1, 2, 1, 0, 0, 0, None)]


def test_model_beats_no_change_on_held_out_weeks(spark, entries):
    found = predict.next_week_candidates(history(entries)).cache()
    split = "2001-12-01"
    model = predict.fit_next_number_one(found, split)
    row = predict.account(predict.predicted(model, found), split).first()
    assert row.weeks > 100 and row.right > row.no_change and row.right_on_changes > 0.3


def test_weeks_are_numbered_and_ended_without_a_join(spark, entries):
    rows = entries([("a", "2000-01-01", 1, "s", "x"), ("a", "2000-01-08", None, "t", "x"), ("a", "2000-01-15", 1, "s", "x"), ("a", "2000-01-15", 2, "t", "x"),
                    ("b", "2000-01-01", 1, "s", "x"), ("b", "2000-01-08", 1, "s", "x"), ("b", "2000-01-15", None, "s", "x"), (None, "2000-01-08", 1, "s", "x")])
    found = predict.next_week_candidates(rows, partitions=7)
    got = sorted(map(tuple, found.collect()), key=repr)
    assert got == sorted(map(tuple, predict.next_week_candidates(rows, published_weeks(rows)).collect()), key=repr)
    assert {(r.chart, r.date.day, r.k_title): r.label for r in found.collect()} == {
        ("a", 1, "s"): 0, ("a", 15, "s"): None, ("a", 15, "t"): None, ("b", 1, "s"): 1, ("b", 8, "s"): 0}
    for frame in (predict.next_week_candidates(rows, partitions=7), history_queries.next_week_candidates(spark, "/root/testdata/sf0.001")):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Broadcast" not in plan and plan.count("Exchange hashpartitioning(") == 1
