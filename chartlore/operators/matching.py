"""Matching a second source's weekly rows to stored lists.

Source rows are (chart, week, src_rank, title, artist, units, ...); list
entries are (chart, date, rank, title, artist).
"""
from __future__ import annotations

import difflib
import functools

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chartlore.functions.dates import plausible_capture
from chartlore.functions.text import lead_artist, norm, number, title_key, unswap
from chartlore.operators.quality import list_signature
from chartlore.session import staged

# Fixed values of the matching rules.
OFFSET_DAYS, MAX_LAG, MIN_FIT, SIMILAR, MIN_PREFIX = 9, 25, 7, 0.85, 4


def offset_join(weeks: DataFrame, entries: DataFrame, days: int = OFFSET_DAYS) -> DataFrame:
    """Source weeks with the list date a fixed number of days later, where
    published."""
    dates = entries.select("chart", "date").distinct()
    return weeks.withColumn("date", F.date_add("week", days)).join(dates, ["chart", "date"])


def _by_list(frame: DataFrame, partitions: int | None) -> DataFrame:
    """Placed by list in that many tasks: what then goes by list and week, or by
    list and date, moves nothing more. A list is bounded by its calendar."""
    return frame.repartition(partitions, "chart") if partitions else frame


def _looked_up(frame: DataFrame, other: DataFrame, at: list[str], names: list[str], partitions: int | None = None) -> DataFrame:
    """`frame` with the columns `names` of `other`, where `at` occurs once, or nulls:
    a left join as a window on both, each placed by list. A side that comes so placed
    is not moved again, and nothing is broadcast, however small its files are."""
    own = [c for c in frame.columns if c not in at]
    both = _by_list(frame.select(*at, F.struct(F.lit(True).alias("_"), *own).alias("_row")), partitions).unionByName(
        _by_list(other.select(*at, F.struct(*names).alias("_other")), partitions), allowMissingColumns=True)
    known = F.lit(True)
    for c in at:
        known = known & F.col(c).isNotNull()
    met = both.withColumn("_other", F.when(known, F.max("_other").over(W.partitionBy(*at)))).filter("_row IS NOT NULL")
    return met.select(*(c if c in at else F.col(f"_row.{c}") for c in frame.columns), *(F.col(f"_other.{c}") for c in names))


def week_candidates(weeks: DataFrame, dates: DataFrame, max_lag: int = MAX_LAG, partitions: int | None = None) -> DataFrame:
    """(chart, week, date) with the date 1..max_lag days after the week.

    Weeks and dates of a list stand in one line of days, and a week sees the
    dates ahead of it. `partitions` is how many tasks share the lists.
    """
    days = weeks.select("chart", F.col("week").alias("day"), F.lit(True).alias("is_week")).unionByName(
        dates.select("chart", F.col("date").alias("day"), F.lit(False).alias("is_week"))).dropna().distinct()
    ahead = W.partitionBy("chart").orderBy(F.unix_date("day")).rangeBetween(1, max_lag)
    seen = _by_list(days, partitions).withColumn("dates", F.collect_list(F.when(~F.col("is_week"), F.col("day"))).over(ahead))
    return seen.filter("is_week").select("chart", F.col("day").alias("week"), F.explode("dates").alias("date"))


def best_fit(rows: DataFrame, entries: DataFrame, pairs: DataFrame, partitions: int | None = None, rows_placed: bool = False) -> DataFrame:
    """Per (chart, week, date) of `pairs`, each there once: `exact` source top ten
    rows at the same rank, `overlap` of them anywhere in the list's top twenty.

    Pairs, rows and entries are one relation, placed once by list in as many tasks
    as `partitions` says; a pair takes the ten of its week and the twenty of its
    date from two windows that this placement satisfies, and stays one row. Pairs
    that come so placed, and rows if `rows_placed`, are not moved again.
    """
    def side(frame: DataFrame, **columns) -> DataFrame:
        types = {"week": "date", "date": "date", "src_rank": "int", "rank": "int", "t": "string"}
        return frame.select("chart", *(columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in types.items()))

    title = norm(F.col("title"))
    ours = side(rows.filter("src_rank <= 10"), week=F.col("week"), src_rank=F.col("src_rank"), t=title)
    listed = side(entries.filter("rank <= 20"), date=F.col("date"), rank=F.col("rank"), t=title).filter("t IS NOT NULL")
    both = (_by_list(ours, partitions).unionByName(_by_list(listed, partitions)) if rows_placed
            else _by_list(ours.unionByName(listed), partitions))
    every = _by_list(side(pairs, week=F.col("week"), date=F.col("date")), partitions).unionByName(both)
    ten = F.collect_list(F.when(F.col("src_rank").isNotNull(), F.struct("src_rank", "t"))).over(W.partitionBy("chart", "week"))
    met = every.withColumn("ten", ten).filter("src_rank IS NULL")
    # Of a title that is there twice the last rank counts.
    last = F.row_number().over(W.partitionBy("chart", "date", "t").orderBy(F.desc("rank"))) == 1
    ranks = F.collect_list(F.when(F.col("last") & F.col("rank").isNotNull(), F.struct("t", "rank"))).over(W.partitionBy("chart", "date"))
    pair = met.withColumn("last", last).withColumn("ranks", ranks).filter("rank IS NULL")
    hits = pair.withColumn("ranks", F.map_from_entries("ranks")).withColumn(
        "hits", F.transform("ten", lambda x: F.struct(x["src_rank"].alias("src_rank"), F.try_element_at("ranks", x["t"]).alias("rank"))))
    return hits.select(
        "chart", "week", "date", F.size(F.filter("hits", lambda h: h["rank"] == h["src_rank"])).alias("exact"),
        F.size(F.filter("hits", lambda h: h["rank"].isNotNull())).alias("overlap"))


def _signatures(rows: DataFrame) -> DataFrame:
    return rows.groupBy("chart", "week").agg(*list_signature(
        F.col("src_rank"), F.col("artist"), F.col("title"), F.col("units")))


def copied_weeks(rows: DataFrame, fits: DataFrame | None = None) -> DataFrame:
    """(chart, week) served as an exact copy of a neighbouring week. With `fits`
    (chart, week, fit) only the copy that fits worse is listed, both on a tie."""
    w = W.partitionBy("chart").orderBy("week")
    sigs = _signatures(rows).drop("n")
    if fits is not None:
        sigs = sigs.join(fits.select("chart", "week", "fit"), ["chart", "week"], "left")
    else:
        sigs = sigs.withColumn("fit", F.lit(0))
    pair = (
        sigs.withColumn("fit", F.coalesce("fit", F.lit(0)))
        .withColumn("next_week", F.lead("week").over(w)).withColumn("next_sig", F.lead("signature").over(w))
        .withColumn("next_fit", F.lead("fit").over(w)).filter("signature = next_sig"))
    worse = F.when(F.col("fit") > F.col("next_fit"), F.array("next_week")).when(
        F.col("fit") < F.col("next_fit"), F.array("week")).otherwise(F.array("week", "next_week"))
    return pair.select("chart", F.explode(worse).alias("week")).distinct()


def _good_captures(captures: DataFrame) -> DataFrame:
    return captures.filter((F.col("status") != "Building") & plausible_capture(F.col("week"), F.to_date("taken")))


def latest_capture(captures: DataFrame) -> DataFrame:
    """Per (chart, week) the last plausible capture not still building.

    `captures` has chart, week, taken, status and a capture_id.
    """
    return _good_captures(captures).groupBy("chart", "week").agg(
        F.max_by("capture_id", F.struct("taken", "capture_id")).alias("capture_id"),
        F.max("taken").alias("taken"))


def _shown_weeks(captures: DataFrame, rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """Every (chart, week) whose last capture has rows, with that capture's id as
    `last_id` and whether its rows equal those of a neighbouring week (`copied`).
    Rows are summed up per capture before anything is placed by list."""
    sums = rows.groupBy("chart", "week", "capture_id").agg(*list_signature(
        F.col("src_rank"), F.col("artist"), F.col("title"), F.col("units"))).drop("n")
    good = _good_captures(captures).filter("chart IS NOT NULL").select("chart", "week", F.struct("taken", "capture_id").alias("seen"))
    both = _by_list(sums, partitions).unionByName(_by_list(good, partitions), allowMissingColumns=True)
    last = both.withColumn("last_id", F.max("seen").over(W.partitionBy("chart", "week"))["capture_id"])
    shown = last.filter("signature IS NOT NULL AND capture_id = last_id")
    line = W.partitionBy("chart").orderBy("week")
    same = [F.coalesce(near("signature").over(line) == F.col("signature"), F.lit(False)) for near in (F.lag, F.lead)]
    return shown.select("chart", "week", "last_id", (same[0] | same[1]).alias("copied"))


def placements(fits: DataFrame, min_fit: int = MIN_FIT) -> DataFrame:
    """Every (chart, week) of `fits` with the list date it is placed on, or no
    date and the reason.

    1. Best by (exact, overlap); too weak or tied weeks are dropped.
    2. A week whose lag is off from both neighbours', while they agree, moves to
       their lag if exactly one good candidate lies there, else it is dropped.
       Neighbours are those of step 1.
    3. Of two weeks on one date the better fit stays, none on a tie.

    A week's candidates, a few by the range they come from, travel with it; the
    two windows that follow are over the weeks of a list and share its placement.
    """
    cand = F.struct("exact", "overlap", "date")
    weeks = fits.groupBy("chart", "week").agg(F.sort_array(F.collect_list(cand), asc=False).alias("cands"))
    best, second = F.get("cands", F.lit(0)), F.get("cands", F.lit(1))
    day = F.date_format(best["date"], "yyyy-MM-dd")
    shown = F.concat(best["exact"].cast("string"), F.lit("/"), best["overlap"].cast("string"), F.lit(" on "), day)
    tied = F.coalesce((best["exact"] == second["exact"]) & (best["overlap"] == second["overlap"]), F.lit(False))
    weeks = weeks.withColumn("reason", F.when(best["overlap"] < min_fit, F.concat(F.lit("best fit "), shown)).when(
        tied, F.concat(F.lit("fit tied: "), shown, F.lit(" and "), F.date_format(second["date"], "yyyy-MM-dd"))))
    weeks = weeks.withColumn("own", F.when(F.col("reason").isNull(), F.datediff(best["date"], F.col("week"))))
    around = weeks.withColumn("before", F.expr("lag(own) IGNORE NULLS OVER (PARTITION BY chart ORDER BY week)")).withColumn(
        "after", F.expr("lead(own) IGNORE NULLS OVER (PARTITION BY chart ORDER BY week)"))
    odd = F.coalesce(F.col("own").isNotNull() & (F.abs(F.col("before") - F.col("after")) <= 2)
                     & (F.abs(F.col("own") - F.col("before")) >= 4), F.lit(False))
    near = F.filter("cands", lambda c: F.abs(F.datediff(c["date"], F.col("week")) - F.col("before")) <= 2)
    moved = F.when((F.size(near) == 1) & (F.get(near, F.lit(0))["overlap"] >= min_fit), F.get(near, F.lit(0)))
    placed = around.withColumn("odd", odd).withColumn("fit", F.when(F.col("reason").isNull(), F.when(F.col("odd"), moved).otherwise(best)))
    placed = placed.withColumn("reason", F.when(F.col("odd") & F.col("fit").isNull(), F.concat(
        F.lit("lag "), F.col("own").cast("string"), F.lit(" against neighbours "), F.col("before").cast("string"), F.lit("/"),
        F.col("after").cast("string"))).otherwise(F.col("reason"))).withColumn("date", F.col("fit.date"))
    same = W.partitionBy("chart", "date").orderBy(F.desc("fit.exact"), F.desc("fit.overlap"), F.desc("week"))
    whole = same.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rival = placed.withColumn("n", F.row_number().over(same)).withColumn("one", F.first(F.struct("fit", "week")).over(whole)).withColumn(
        "two", F.nth_value(F.struct("fit", "week"), 2).over(whole))
    on = F.date_format("date", "yyyy-MM-dd")
    equal = F.coalesce(F.col("one.fit") == F.col("two.fit"), F.lit(False))
    reason = F.when(F.col("date").isNull(), F.col("reason")).when(equal, F.concat(F.lit("shares "), on, F.lit(" with an equal fit"))).when(
        F.col("n") > 1, F.concat(on, F.lit(" fits "), F.date_format("one.week", "yyyy-MM-dd"), F.lit(" better")))
    return rival.withColumn("reason", reason).select("chart", "week", F.when(F.col("reason").isNull(), F.col("date")).alias("date"), "reason")


def place_weeks(fits: DataFrame, min_fit: int = MIN_FIT) -> DataFrame:
    """(chart, week, date): each source week on the list date it fits best, by
    the rules of `placements`."""
    return placements(fits, min_fit).filter("reason IS NULL").select("chart", "week", "date")


# --- entity matching --------------------------------------------------------
#
# Source rows and list entries are put into one relation and placed once by list.
# Every window and grouping below is by list and date or by these and more, so
# that placement serves all of them and only sorts follow. Rows of a list lie
# together in what is moved, as they do where they are stored, and so take a part
# of the room that rows dealt out by list and date take. What is held together for
# one list and date is bounded by the depth of its lists.


def _both(rows: DataFrame, entries: DataFrame, at: list[str], partitions: int | None) -> DataFrame:
    """Rows (at, row, ...) and the lines of entries as one relation, with is_row, placed
    by list in that many tasks. Each side is placed for itself: one that comes so
    placed is not moved again, lines that two steps ask for are moved once, and the
    union keeps what its sides have in common."""
    r, e = rows, entries.select(*at, "rank", "title", "artist")
    if partitions is not None:
        r, e = r.repartition(partitions, at[0]), e.repartition(partitions, at[0])
    both = r.unionByName(e.select(*at, F.struct("rank", "title", "artist").alias("line")), allowMissingColumns=True)
    both = both.repartition(*at) if partitions is None else both
    return both.withColumn("is_row", F.col("row").isNotNull())


def _placed(rows: DataFrame, entries: DataFrame, at: list[str], swapped: bool, partitions: int | None = None) -> DataFrame:
    """Both sides as (at, row, line, is_row, k_t, k_a); `row`, the columns of a row
    but for `at`, is null for entries, `line` for rows. `partitions` is how many
    tasks share them."""
    r = unswap(rows) if swapped else rows
    both = _both(r.select(*at, F.struct(*(c for c in rows.columns if c not in at)).alias("row")), entries, at, partitions)
    return both.withColumns({"k_t": title_key(F.coalesce("row.title", "line.title")), "k_a": lead_artist(F.coalesce("row.artist", "line.artist"))})


def _resolved(both: DataFrame, at: list[str]) -> DataFrame:
    """`both` with `e`: for a row the entry it resolves to, for an entry its own
    line."""
    known = F.col("k_t").isNotNull()
    for c in at:
        known = known & F.col(c).isNotNull()
    named = known & F.col("k_a").isNotNull()
    out = both.withColumn("e1", F.when(named, F.max("line").over(W.partitionBy(*at, "k_t", "k_a"))))
    title = W.partitionBy(*at, "k_t")
    out = out.withColumn("e12", F.coalesce("e1", F.when(known & (F.count("line").over(title) == 1), F.max("line").over(title))))
    mine = F.collect_list(F.when(~F.col("is_row"), F.struct("k_t", "line"))).over(W.partitionBy(*at, "k_a"))
    out = out.withColumn("of_artist", F.when(named & F.col("is_row") & F.col("e12").isNull() & (F.col("k_t") != ""), F.filter(
        mine, lambda e: F.contains(e["k_t"], F.col("k_t")) | F.contains(F.col("k_t"), e["k_t"]))))
    part = F.when(F.size("of_artist") == 1, F.get("of_artist", F.lit(0))["line"])
    return out.withColumn("e", F.when(F.col("is_row"), F.coalesce("e12", part)).otherwise(F.col("line"))).drop("e1", "e12", "of_artist")


def _taken(resolved: DataFrame, at: list[str]) -> DataFrame:
    """`resolved` with an entry left to the first row that resolves to it; `free`
    marks the entries no row has, one of equal lines."""
    w = W.partitionBy(*at, "e").orderBy(F.desc("is_row"), F.col("row.src_rank").cast("bigint"), "row.title", "row.artist")
    rows = F.count_if("is_row").over(W.partitionBy(*at, "e"))
    first = resolved.withColumn("_no", F.row_number().over(w)).withColumn("_rows", rows)
    return first.withColumn("free", ~F.col("is_row") & (F.col("_rows") == 0) & (F.col("_no") == 1)).withColumn(
        "e", F.when(~F.col("is_row") | (F.col("_no") == 1), F.col("e"))).drop("_no", "_rows")


def _matched(rows: DataFrame, names: list[str], at: list[str]) -> DataFrame:
    """The columns `names` of rows, keys and what they resolve to; those of `at` are
    the ones that rows are placed by."""
    return rows.select(*(c if c in at else F.col(f"row.{c}") for c in names), "k_t", "k_a", F.col("e.rank").alias("m_rank"),
                       F.col("e.title").alias("m_title"), F.col("e.artist").alias("m_artist"))


def match_entities(rows: DataFrame, entries: DataFrame, at: list[str] = ("chart", "date"),
                   swapped: bool = True, partitions: int | None = None) -> DataFrame:
    """Source rows with the list entry each resolves to, or nulls.

    In order: title and lead artist; title alone if one entry carries it; same
    lead artist and one title containing the other if one entry fits. An entry
    goes to the first source row that resolves to it; ranks may tie. Rows filed
    under a placeholder title come out put right. `partitions` is how many tasks
    share both sides.
    """
    at = list(at)
    return _matched(_taken(_resolved(_placed(rows, entries, at, swapped, partitions), at), at).filter("is_row"), rows.columns, at)


def likeness(pairs: str, least: float = SIMILAR) -> Column:
    """For a column of arrays of (t, u, a, b), titles and artists of two sides, how alike
    each pair is by difflib's ratio: 2 where titles and artists are, 1 where
    titles are, else 0. Declared non-deterministic, so that it is worked out
    once."""

    @F.pandas_udf("array<int>")
    def run(ts: pd.Series, us: pd.Series, xs: pd.Series, ys: pd.Series) -> pd.Series:
        @functools.lru_cache(10_000)
        def alike(x: str, y: str) -> bool:
            m = difflib.SequenceMatcher(None, x, y)
            return m.real_quick_ratio() >= least and m.quick_ratio() >= least and m.ratio() >= least

        return pd.Series([[(1 + alike(a or "", b or "")) if alike(t, u) else 0 for t, u, a, b in zip(*group)]
                          for group in zip(ts, us, xs, ys)], dtype=object)

    return run.asNondeterministic()(*(F.col(f"{pairs}.{c}") for c in ("t", "u", "a", "b")))


def _could_be_alike(t: Column, u: Column) -> Column:
    """Whether two titles may have a ratio of 17 / 20. Of L letters in all M are
    matched, in order, on either side: with 2 M >= 17 L / 20 no more than 3 L / 20
    insertions and deletions lead from one to the other, and no more edits."""
    both = F.length(t) + F.length(u)
    edits = F.call_function("levenshtein", t, u, F.floor(both * 3 / 20).cast("int"))
    return (40 * F.least(F.length(t), F.length(u)) >= 17 * both) & (edits >= 0)


def _won(open_: DataFrame, at: list[str], partitions: int | None) -> DataFrame:
    """The open rows of `open_`, which holds them and the free entries (at, is_row,
    row, line, k_t, k_a), with the line each wins as `e`, or null.

    Both are gathered per list and date. What is compared there is bounded by its
    rows and entries that resolve to nothing: an edit bound is worked out for each
    of these pairs, and Python sees only what passes it. The candidates are then
    folded over in row order.
    """
    order = W.partitionBy(*at).orderBy(F.desc("is_row"), F.col("row.src_rank").cast("bigint"), "row.title", "row.artist")
    rows, free = (lambda c: F.collect_list(F.when(F.col("is_row"), c))), (lambda c: F.collect_list(F.when(~F.col("is_row"), c)))
    placed = open_ if partitions is None else open_.repartition(partitions, at[0])
    groups = placed.withColumn("no", F.row_number().over(order)).groupBy(*at).agg(
        F.array_sort(rows(F.struct("no", "k_t", "k_a"))).alias("todo"), rows(F.struct("no", "row", "k_t", "k_a")).alias("rows"),
        free(F.struct("no", "k_t", "k_a", "line")).alias("free"))

    def prefix(t: Column, u: Column) -> Column:
        return (F.length(t) >= MIN_PREFIX) & (F.length(u) >= MIN_PREFIX) & (F.startswith(u, t) | F.startswith(t, u))

    def candidates(r: Column) -> Column:
        fitting = F.filter("free", lambda f: prefix(r["k_t"], f["k_t"]) | _could_be_alike(r["k_t"], f["k_t"]))
        return F.transform(fitting, lambda f: F.struct(
            r["no"].alias("no"), f["no"].alias("f_no"), f["line"].alias("line"), prefix(r["k_t"], f["k_t"]).alias("prefix"),
            r["k_a"].eqNullSafe(f["k_a"]).alias("same"), r["k_t"].alias("t"), f["k_t"].alias("u"), r["k_a"].alias("a"), f["k_a"].alias("b")))

    # Made once, as the likeness is worked out from it: an expression that is not
    # deterministic is not merged into what reads it.
    pairs = groups.withColumn("pairs", F.flatten(F.transform("todo", candidates)))
    judged = pairs.withColumn("like", likeness("pairs"))
    cands = F.zip_with("pairs", "like", lambda p, n: F.struct(
        p["no"].alias("no"), p["f_no"].alias("f_no"), p["line"].alias("line"), p["prefix"].alias("prefix"),
        ((n > 0) & p["same"]).alias("alike"), (n > 1).alias("close")))
    judged = judged.withColumn("cands", cands)
    line = open_.schema["line"].dataType.simpleString()

    def only(cands: Column, rule: str) -> Column:
        return _let(F.filter(cands, lambda c: c[rule]), lambda fit: F.when(F.size(fit) == 1, F.get(fit, F.lit(0))))

    def settle(state: Column, row: Column) -> Column:
        left = F.filter("cands", lambda c: (c["no"] == row["no"]) & ~F.array_contains(state["used"], c["f_no"]))
        won = _let(left, lambda cands: F.coalesce(*(only(cands, rule) for rule in ("prefix", "alike", "close"))))
        return _let(won, lambda c: F.when(c.isNull(), state).otherwise(F.struct(
            F.array_append(state["used"], c["f_no"]).alias("used"),
            F.array_append(state["won"], F.struct(row["no"].alias("no"), c["line"].alias("line"))).alias("won"))))

    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast(f"array<struct<no:int,line:{line}>>").alias("won"))
    won = F.when(F.size("cands") > 0, F.map_from_entries(F.aggregate("todo", start, settle, lambda state: state["won"])))
    return judged.select(*at, "rows", won.alias("won")).select(*at, F.explode("rows").alias("r"), "won").select(
        *at, "r.row", "r.k_t", "r.k_a", F.try_element_at("won", F.col("r.no")).alias("e"))


def _let(value: Column, body) -> Column:
    """`body` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _settled(taken: DataFrame, at: list[str], partitions: int | None = None) -> DataFrame:
    """The rows of `taken` with `e` of open ones filled from free entries. It is
    written once; only rows and entries that resolved to nothing are placed and
    read again."""
    own = F.when(F.col("is_row"), F.col("e")).alias("e")
    kept = staged(taken.filter("is_row OR free").select(*at, "is_row", "row", "line", "k_t", "k_a", own), "taken")
    comparable = F.coalesce(F.col("k_t") != "", F.lit(False))
    for c in at:
        comparable = comparable & F.col(c).isNotNull()
    is_open = comparable & (~F.col("is_row") | F.col("e").isNull())
    done = kept.filter(~is_open & F.col("is_row")).select(*at, "row", "k_t", "k_a", "e")
    return done.unionByName(_won(kept.filter(is_open), at, partitions))


def match_fuzzy(matched: DataFrame, entries: DataFrame, at: list[str] = ("chart", "date"), partitions: int | None = None) -> DataFrame:
    """Fills what `match_entities` left: a unique title prefix; else one entry
    of the same lead artist whose title is 0.85 alike; else one whose title and
    artist both are. Each only among entries not yet used, source rows in rank
    order: the candidates of a list and date are folded over in that order.
    What `match_entities` placed in as many tasks as `partitions` stays there.
    """
    at = list(at)
    line = F.struct("rank", "title", "artist")
    kind = entries.select(line).schema[0].dataType
    given = F.struct(F.col("m_rank").alias("rank"), F.col("m_title").alias("title"), F.col("m_artist").alias("artist")).cast(kind)
    names = [c for c in matched.columns if c not in ("k_t", "k_a", "m_rank", "m_title", "m_artist")]
    r = matched.select(*at, F.struct(*(c for c in names if c not in at)).alias("row"), "k_t", "k_a",
                       F.when(F.col("m_rank").isNotNull(), given).alias("e"))
    both = _both(r, entries, at, partitions)
    both = both.withColumns({c: F.when(F.col("is_row"), F.col(c)).otherwise(own) for c, own in (
        ("k_t", title_key(F.col("line.title"))), ("k_a", lead_artist(F.col("line.artist"))), ("e", F.col("line")))})
    return _matched(_settled(_taken(both, at), at, partitions), names, at).select(*matched.columns)


def match_rows(rows: DataFrame, entries: DataFrame, at: list[str] = ("chart", "date"), swapped: bool = True,
               partitions: int | None = None) -> DataFrame:
    """`match_entities` and then `match_fuzzy` on one placement of the rows."""
    at = list(at)
    return _matched(_settled(_taken(_resolved(_placed(rows, entries, at, swapped, partitions), at), at), at, partitions), rows.columns, at)


def pin_official(figures: DataFrame, entries: DataFrame, partitions: int | None = None) -> DataFrame:
    """External number-one figures (chart, date, title, artist, units) with the
    stored number one that day and whether they agree on title or lead artist.
    Rows not accepted keep a reason. `partitions` is how many tasks share both."""
    top = _by_list(entries.filter("rank = 1").select("chart", "date", "title", "artist"), partitions).groupBy("chart", "date").agg(
        F.min(F.struct("title", "artist")).alias("s")).select(
        "chart", "date", F.col("s.title").alias("s_title"), F.col("s.artist").alias("s_artist"))

    def plain(c):
        return F.replace(c, F.lit("$"), F.lit("s"))

    a, b = title_key(plain(F.col("title"))), title_key(plain(F.col("s_title")))
    same_title = (a == b) | ((a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a)))
    same_artist = lead_artist(plain(F.col("artist"))) == lead_artist(plain(F.col("s_artist")))
    at = ["chart", "date"]
    met = _looked_up(figures, top, at, ["s_title", "s_artist"], partitions)
    return met.select(*at, *(c for c in met.columns if c not in at)).withColumn(
        "reason", F.when(F.col("s_title").isNull(), "no stored list that date")
        .when(~(same_title | same_artist),
              F.concat(F.lit("stored No. 1 is "), "s_title", F.lit(" by "), "s_artist")))


#: What can become of a row of the second source or of an official figure.
STATUSES = ("used", "outranked", "no figure", "superseded", "copied", "unplaced", "pending", "owned", "unmatched", "rejected")


def units_ledger(captures: DataFrame, rows: DataFrame, entries: DataFrame, official: DataFrame | None = None,
                 owned: DataFrame | None = None, source: str = "source", days: int | None = None,
                 partitions: int | None = None) -> DataFrame:
    """Every input row with what became of it: source rows and official figures
    as chart, week, src_rank, title, artist, the entry (date, m_rank, m_title,
    m_artist), figures, source, status and reason. Statuses are those of
    `STATUSES`; each row has one, so their counts add up to the input.

    Only the last capture of a week counts, copies of a neighbouring week are
    left out, weeks are placed on list dates by their fit (or `days` later, where
    a list not yet published leaves them pending), list dates in `owned` (chart,
    date) belong to another source, and an official figure outranks others.
    `rows` may hold `albums`, `tea` and `sea` beside `units`. `partitions` is how
    many tasks share the lists. What a row needs of its week or date is looked up on
    relations placed by list, so nothing is broadcast, and fits, matches and claims
    find rows and entries placed.
    """
    figures = {"units": "units", "album_sales": "albums", "tea": "tea", "sea": "sea"}
    extra = {c: F.col(c) if c in rows.columns else F.lit(None).cast("string") for c in figures.values()}
    # Read for the copies, the fits and the rows themselves: written once.
    rows = staged(rows.withColumns(extra).select("chart", "week", "src_rank", "title", "artist", *extra, "capture_id"), "captured")
    weeks = staged(_shown_weeks(captures, rows, partitions), "weeks")
    dates = entries.select("chart", "date").distinct()
    if days is None:
        ten = _looked_up(rows.filter("src_rank <= 10").select("chart", "week", "src_rank", "title", "capture_id"), weeks,
                         ["chart", "week"], ["last_id", "copied"], partitions).filter("capture_id = last_id AND NOT copied")
        pairs = week_candidates(weeks.filter("NOT copied"), dates, partitions=partitions)
        placed = _looked_up(weeks, placements(best_fit(ten, entries, pairs, partitions, rows_placed=True)), ["chart", "week"], ["date", "reason"], partitions)
        placed = placed.withColumn("reason", F.when(F.col("date").isNull(), F.coalesce("reason", F.lit("no list in range"))))
        lost = "unplaced"
    else:
        due = weeks.withColumn("date", F.date_add("week", days))
        placed = _looked_up(due, dates.withColumn("out", F.lit(True)), ["chart", "date"], ["out"], partitions).withColumn(
            "reason", F.when(F.col("out").isNull(), F.concat(F.lit("no list of "), F.date_format("date", "yyyy-MM-dd")))).withColumn(
            "date", F.when(F.col("out"), F.col("date")))
        lost = "pending"
    if owned is not None:
        theirs = owned.select("chart", "date").distinct().withColumn("owned", F.lit(True))
        placed = _looked_up(placed, theirs, ["chart", "date"], ["owned"], partitions)
    else:
        placed = placed.withColumn("owned", F.lit(None).cast("boolean"))
    # A row a week: written so that fitting and matching don't hold memory in one stage.
    fate = staged(placed.select(
        "chart", "week", "last_id", "date", F.when(F.col("copied"), "copied").when(F.col("date").isNull(), lost).when(F.col("owned"), "owned").alias("status"),
        F.when(F.col("copied"), "equal to a neighbouring week").otherwise(F.col("reason")).alias("reason")), "fates")
    dated = _looked_up(rows, fate, ["chart", "week"], ["last_id", "date", "status", "reason"], partitions)
    superseded = ~F.coalesce(F.col("capture_id") == F.col("last_id"), F.lit(False))
    dated = dated.withColumn("status", F.when(superseded, "superseded").otherwise(F.col("status"))).drop("capture_id", "last_id")
    # Rows that have a status don't take part; without a date nothing is near them.
    dated = dated.withColumn("date", F.when(F.col("status").isNull(), F.col("date")))
    found = match_rows(dated, entries, partitions=partitions)
    ledger = _by_list(found, partitions).select(
        "chart", "week", "src_rank", "title", "artist", "date", "m_rank", "m_title", "m_artist",
        *(number(F.col(c)).alias(name) for name, c in figures.items()), F.lit(source).alias("source"),
        F.coalesce("status", F.when(F.col("m_rank").isNull(), "unmatched")).alias("status"), "reason")
    if official is not None:
        pinned = _by_list(pin_official(official, entries, partitions), partitions)
        good = F.col("reason").isNull()
        ledger = ledger.unionByName(pinned.select(
            "chart", F.col("date").alias("week"), F.lit(1).alias("src_rank"), "title", "artist", F.when(good, F.col("date")).alias("date"),
            F.when(good, 1).alias("m_rank"), F.when(good, F.col("s_title")).alias("m_title"), F.when(good, F.col("s_artist")).alias("m_artist"),
            F.col("units").cast("bigint").alias("units"), *(F.lit(None).cast("bigint").alias(c) for c in ("album_sales", "tea", "sea")),
            F.lit("official").alias("source"), F.when(~good, "rejected").alias("status"), "reason"))
    is_official = F.col("source") == "official"
    claim = W.partitionBy("chart", "date", F.trim("m_title"), F.trim("m_artist"), F.col("status").isNull() & F.col("units").isNotNull()).orderBy(
        F.desc(is_official), F.when(is_official, F.col("src_rank")).otherwise(-F.col("src_rank")), F.desc("week"))
    return ledger.withColumn("status", F.coalesce("status", F.when(F.col("units").isNull(), "no figure").when(
        F.row_number().over(claim) > 1, "outranked").otherwise("used")))


def counted(ledger: DataFrame, observation: Observation) -> DataFrame:
    """The ledger with its rows counted by status as they pass by; the figures
    are there once an action on the result has ended."""
    return ledger.observe(observation, F.count("*").alias("rows"), *(
        F.count_if(F.col("status") == s).alias(s.replace(" ", "_")) for s in STATUSES))


def build_units(captures: DataFrame, rows: DataFrame, entries: DataFrame, official: DataFrame | None = None,
                source: str = "source", **options) -> DataFrame:
    """Units per stored entry: the used rows of `units_ledger`."""
    used = units_ledger(captures, rows, entries, official, source=source, **options).filter("status = 'used'")
    return used.select("chart", "date", F.trim("m_title").alias("title"), F.trim("m_artist").alias("artist"), F.col("m_rank").alias("rank"),
                       "units", "album_sales", "tea", "sea", "source", F.col("week").alias("source_week"), F.col("src_rank").alias("source_rank"))
