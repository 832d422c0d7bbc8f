"""Streams equal their batch operators and survive replays, restarts and crashes."""
import datetime as dt
import os
import random

import pytest

from chartlore.operators import quality, visits
from chartlore.plans import fixtures as fx
from chartlore.plans import report_queries as rq
from chartlore.streaming import sinks
from chartlore.streaming import visits as stream_visits
from chartlore.streaming import weeks as stream_weeks

SF = "/root/testdata/sf0.001"


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_streams_equal_batch(spark):
    v = fx.visits(spark, SF)
    assert rows(rq.stream_page_views(spark, SF)) == rows(visits.page_views(v))
    assert rows(rq.stream_visitor_days(spark, SF)) == rows(visits.visitor_days(v))
    assert rows(rq.stream_visitors_by_day(spark, SF)) == rows(visits.visitors(v))


def test_replayed_batch_changes_nothing(spark, tmp_path):
    write = sinks.batch_writer(str(tmp_path))
    first = spark.createDataFrame([("a", 1)], "k string, n int")
    write(first, 0)
    write(spark.createDataFrame([("a", 5), ("b", 1)], "k string, n int"), 1)
    write(spark.createDataFrame([("a", 5), ("b", 1)], "k string, n int"), 1)
    assert rows(sinks.latest_by_key(spark, str(tmp_path), ["k"])) == [("a", 5), ("b", 1)]


def files(path):
    return sum(f.endswith(".parquet") for _, _, names in os.walk(path) for f in names)


def test_files_stay_bounded(spark, tmp_path):
    keyed, plain = (str(tmp_path / n) for n in ("keyed", "plain"))
    writers = sinks.batch_writer(keyed, ["k"], every=5), sinks.batch_writer(plain, every=5)
    most, want = 0, {}
    for i in range(200):  # a merge every fifth
        batch = spark.createDataFrame([(i % 7, i), (100 + i, i)], "k int, n int").coalesce(1)
        for write in writers[:1 if i >= 20 else 2]:
            write(batch, i)
        want |= {i % 7: i, 100 + i: i}
        most = max(most, files(keyed))
    assert most <= 40
    assert rows(sinks.latest_by_key(spark, keyed, ["k"])) == sorted(want.items())
    assert rows(sinks.stored_rows(spark, plain)) == sorted([(i % 7, i) for i in range(20)] + [(100 + i, i) for i in range(20)])


def test_crash_between_base_and_commit(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    write = sinks.batch_writer(path, ["k"], every=3)

    def batch(i):
        return spark.createDataFrame([("a", i), (f"k{i}", i)], "k string, n int")

    def crash(*_):
        raise RuntimeError("lost the driver")

    for i in range(5):
        write(batch(i), i)
    with monkeypatch.context() as broken:
        broken.setattr(sinks, "commit", crash)
        with pytest.raises(RuntimeError):
            write(batch(5), 5)  # the tail and a new base are there, its manifest row is not
    want = sorted([("a", 5)] + [(f"k{i}", i) for i in range(6)])
    assert rows(sinks.latest_by_key(spark, path, ["k"])) == want
    write(batch(5), 5)  # the batch is replayed
    assert rows(sinks.latest_by_key(spark, path, ["k"])) == want
    write(batch(5), 5)  # and once more, after its merge
    assert rows(sinks.latest_by_key(spark, path, ["k"])) == want
    for i in range(6, 12):
        write(batch(i), i)
    assert rows(sinks.latest_by_key(spark, path, ["k"])) == sorted([("a", 11)] + [(f"k{i}", i) for i in range(12)])


def test_visitors_in_order_of_arrival(spark, tmp_path):
    rng = random.Random(2)
    seen, state = [], {}
    for no in range(240):
        day = dt.date(2024, 1, 1) + dt.timedelta(days=no // 12 - rng.choice((0, 0, 0, 3, 9)))
        seen.append((rng.choice("abcdefg") if no % 3 else "hot", str(day), no))
    schema = "visitor string, ts timestamp, arrived bigint"
    for part in range(3):
        mine = seen[part * 80:(part + 1) * 80]
        for visitor, day, _ in mine:  # as each visit would be recorded
            first, _, n = state.get(visitor, (day, None, 0))
            state[visitor] = (first, day, n + 1)
        rng.shuffle(mine)
        spark.createDataFrame([*mine, (None, "2024-01-01", 0)], "visitor string, day string, arrived bigint").selectExpr(
            "visitor", "cast(day AS timestamp) AS ts", "arrived").repartition(3).write.parquet(f"{tmp_path}/in/{part}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        sinks.run_available(stream_visits.visitors(stream), f"{tmp_path}/out", f"{tmp_path}/checkpoint", keys=["visitor"], every=2)
    got = {v: (str(a), str(b), n) for v, a, b, n in rows(sinks.latest_by_key(spark, f"{tmp_path}/out", ["visitor"]))}
    assert got == state
    newest = {v: max(day for w, day, _ in seen if w == v) for v in got}
    assert any(last < newest[v] for v, (_, last, _) in got.items())  # a late visit moved last_seen back


def test_replayed_weeks_are_stored_once(spark, entries, tmp_path, monkeypatch):
    def deliver(no, frame):
        frame.write.parquet(f"{tmp_path}/in/{no}")
        stream = spark.readStream.schema(frame.schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        stream_weeks.ingest_weeks(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint", every=2)

    one = entries([("a", "2024-01-06", 1, "S", "X"), ("a", "2024-01-06", 2, "T", "X")])
    two = entries([("a", "2024-01-13", 1, "s ", "X"), ("a", "2024-01-13", 2, "T", "X"),
                   ("a", "2024-01-20", 1, "T", "X"), ("a", "2024-01-20", 3, "S", "X"),
                   ("a", "2024-01-06", 1, "Z", "X"), ("b", "2024-01-13", 1, "S", "X")])
    deliver(0, one)
    write = sinks.batch_writer

    def failing(*args):
        inner = write(*args)

        def run(batch, batch_id):
            inner(batch, batch_id)
            raise RuntimeError("lost after the write")
        return run

    with monkeypatch.context() as broken:
        broken.setattr(sinks, "batch_writer", failing)
        with pytest.raises(Exception, match="lost after the write"):
            deliver(1, two)   # a repeat of the week before, a list with a hole, a week stored already, another list
    deliver(2, one)           # the lost batch runs again; then the first week comes once more
    stored = stream_weeks.stored_weeks(spark, f"{tmp_path}/out")
    assert rows(stored.select("chart", "date", "title")) == [
        ("a", dt.date(2024, 1, 6), "S"), ("a", dt.date(2024, 1, 6), "T"), ("b", dt.date(2024, 1, 13), "S")]
    assert quality.duplicates(stored).count() == 0
