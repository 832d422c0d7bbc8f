"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

`history_build` derives and stores the history, its keys and its calendar;
`index_build` makes and saves the title index. The other queries then read what
is stored, as a deployment would; `title_index` is the build without saving. Every query is run
once to warm the JVM and once for the clock; results go to the noop sink.
"""
from __future__ import annotations

import json
import os
import time

from chartlore.plans import catalog, fixtures, history_queries
from chartlore.session import local_session

HEADLINE = [
    "chart_page", "dropouts", "week_over_week", "song_history", "artist_stats", "artist_coverage", "title_index",
    "crossovers", "suggest", "weekly_news", "clamped_weeks", "week_gaps", "verify_lists", "verify_yearend",
    "title_lookup", "artist_rows_of", "best_fit", "place_weeks", "match_entities", "match_rows", "units_ledger", "rank_long", "visit_summary", "stream_page_views",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))

    def seconds(work) -> float:
        start = time.perf_counter()
        work()
        return round(time.perf_counter() - start, 3)

    def drain(name: str):
        return lambda: catalog.QUERIES[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()

    fixtures.derive_entries(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {"history_build": seconds(lambda: fixtures.weeks(spark, sf_dir).count())}
    times["index_build"] = seconds(lambda: history_queries.stored_index(spark, sf_dir))
    for name in HEADLINE:
        drain(name)()
        times[name] = seconds(drain(name))
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
