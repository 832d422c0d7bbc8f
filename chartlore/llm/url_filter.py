"""URL filter: rules for hosts and paths, else logistic regression on hashed
character n-grams, trained from a small labelled URL table.

Host and path are cut out of the URL by Spark functions. A rule fits its host
and all subdomains if the URL's path starts with the rule's path; the longest
fitting rule wins. Other URLs are judged by the model, which sees the n-grams of
host and path in separate halves of the feature space.

Null URLs and URLs without "://" have an empty host and path; they fit no rule,
and without n-grams the model's intercept alone would speak, so they are allowed.
Rows are independent: repeated URLs get equal verdicts and nothing is shuffled.
The labelled table and the rules are parameters of bounded size.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartlore.llm.common import ship_package

MAX_RULES = 10_000
MAX_LABELLED = 20_000
DIMENSIONS = 1 << 14
GRAMS = (3, 4, 5)

#: (verdict, rule): a host, then the start of the path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

#: Words of hosts with unwanted pages and of ordinary hosts. None of the labelled
#: names occurs in the given tables; both kinds take the same companions, so that
#: these tell nothing.
UNWANTED = ("adult porn erotic fetish nude escort cams casino poker slots jackpot roulette bets betting bookie pills viagra meds "
            "pharma steroids replica knockoff spam spammer ads adserver popup clicks tracker track payday loans prize winner "
            "crack keygen warez cheap free win").split()
ORDINARY = ("library museum garden science history wiki news city university school theatre weather cooking recipes travel "
            "maps books reading music physics biology gazette tribune forum archive docs handbook journal review letters "
            "painting sailing hiking mountain river bakery market workshop teacher other thing there the nation station "
            "tradition motion shore thunder leather weaver theory thread ration onward heron entry strand").split()
COMPANIONS = "hub zone world club daily online house team corner point".split()
_PATHS = ("/", "/en/12", "/de/345", "/fr/67.html", "/es/8910/", "/page/2", "/about")
_HOSTS = ("{}.example.com", "www.{}.example.org", "m.{}.net", "blog.{}.example.net", "{}.org")


def labelled_urls() -> list[tuple[str, int]]:
    """The labelled table: each word alone and with six companions, before or
    after it, under several hosts and with a path that tells nothing about the
    label."""
    rows = []
    for bad, words in ((1, UNWANTED), (0, ORDINARY)):
        for i, word in enumerate(words):
            a, b, c, d, e, f = (COMPANIONS[(3 * i + k) % len(COMPANIONS)] for k in range(6))
            for j, name in enumerate((word, f"{word}-{a}", f"{b}-{word}", f"{word}{c}", f"{d}{word}", f"{word}-{e}", f"my-{word}-{f}")):
                rows.append((f"http://{_HOSTS[(i + 2 * j) % len(_HOSTS)].format(name)}{_PATHS[(i + 3 * j) % len(_PATHS)]}", bad))
    return rows


def left_out_accuracy(labelled: Sequence[tuple[str, int]], folds: int = 5) -> dict[int, float]:
    """Share of each label judged right by models that haven't seen the host."""
    right, total = {0: 0, 1: 0}, {0: 0, 1: 0}
    hosts = [zlib.crc32(split_url(u)[0].encode()) % folds for u, _ in labelled]
    for fold in range(folds):
        weights = train([row for row, f in zip(labelled, hosts) if f != fold])
        for (url, bad), f in zip(labelled, hosts):
            if f == fold:
                slots = gram_slots(*split_url(url))
                score = weights[slots].sum() / np.sqrt(max(1, len(slots))) + weights[-1]
                right[bad] += int((score >= 0) == bad)
                total[bad] += 1
    return {label: right[label] / max(1, total[label]) for label in right}


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits as (rule, verdict), null where none does. Rules
    are looked up by each suffix of the host that starts after a dot."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, rule in rules:
        name, _, rest = rule.partition("/")
        by_host.setdefault(name, []).append(("/" + rest, rule, verdict))
    kind = "array<struct<path:string,rule:string,verdict:string>>"
    if not by_host:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    pairs = []
    for name, entries in by_host.items():
        pairs += [F.lit(name), F.array(*(F.struct(F.lit(p).alias("path"), F.lit(r).alias("rule"), F.lit(v).alias("verdict"))
                                         for p, r, v in entries)).cast(kind)]
    table = F.create_map(*pairs)
    parts = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    near = F.flatten(F.transform(suffixes, lambda s: F.coalesce(F.try_element_at(table, s), F.array().cast(kind))))
    fits = F.filter(near, lambda r: F.startswith(path, r["path"]))
    longest = F.array_max(F.transform(fits, lambda r: F.struct(
        F.length(r["rule"]).alias("size"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    return F.when(longest.isNotNull(), F.struct(longest["rule"].alias("rule"), longest["verdict"].alias("verdict")))


def gram_slots(host: str, path: str) -> list[int]:
    """Hashed n-grams: the host's in the lower half, the path's in the upper."""
    half, out = DIMENSIONS // 2, set()
    for base, part in ((0, f"^{host}$" if host else ""), (half, f"^{path}$" if path else "")):
        for n in GRAMS:
            out.update(base + zlib.crc32(part[i:i + n].encode()) % half for i in range(len(part) - n + 1))
    return sorted(out)


def split_url(url: str | None) -> tuple[str, str]:
    """`host_of` and `path_of` for the few labelled rows."""
    _, sign, rest = (url or "").partition("://")
    if not sign:
        return "", ""
    size = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:size], rest[size:]
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    return "".join(c.lower() if c.isascii() else c for c in host), rest[:end]


def train(labelled: Sequence[tuple[str, int]], rounds: int = 400, rate: float = 8.0, shrink: float = 1e-4) -> np.ndarray:
    """Weights and, last, the intercept, by gradient descent from zero."""
    if len(labelled) > MAX_LABELLED:
        raise ValueError(f"more than {MAX_LABELLED} labelled URLs")
    rows = [gram_slots(*split_url(u)) for u, _ in labelled]
    y = np.array([b for _, b in labelled], float)
    at = np.array([s for r in rows for s in r], np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(owner, minlength=len(rows))))
    w, b = np.zeros(DIMENSIONS), 0.0
    for _ in range(rounds):
        z = np.bincount(owner, w[at], minlength=len(rows)) * scale + b
        miss = (1 / (1 + np.exp(-z)) - y) / max(1, len(rows))
        w -= rate * (np.bincount(at, (miss * scale)[owner], minlength=DIMENSIONS) + shrink * w)
        b -= rate * miss.sum()
    return np.append(w, b)


def url_scores(host: Column, path: Column, weights: np.ndarray) -> Column:
    """Probability that a URL is unwanted; 0 for an empty host and path."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in batches:
            out = []
            for h, p in zip(hosts, paths):
                slots = gram_slots(h, p)
                out.append(0.0 if not slots else 1 / (1 + np.exp(-(weights[slots].sum() / np.sqrt(len(slots)) + weights[-1]))))
            yield pd.Series(out, dtype=float)

    return score(host, path)


def judge_urls(pages: DataFrame, key: str = "page_id", url: str = "url", rules=RULES, labelled=None,
               cut: float = 0.5) -> DataFrame:
    """key, host, path, rule, verdict and the model's score of every row."""
    ship_package(pages.sparkSession)
    weights = train(labelled_urls() if labelled is None else labelled)
    parts = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    parts = parts.withColumn("_rule", fitting_rule(F.col("host"), F.col("path"), rules))
    parts = parts.withColumn("score", url_scores(F.col("host"), F.col("path"), weights))
    return parts.select(key, "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(
        F.col("_rule.verdict"), F.when(F.col("score") >= cut, "block").otherwise("allow")).alias("verdict"), "score")
