"""Secret scan: known forms plus sliding-window entropy, all as Spark functions.

Known forms (assignments, access ids, hex runs) are found by pattern. Other
candidates are runs of token characters; a fixed-width window slides over each
one while an array of symbol counts is moved by one in, one out, and the sum of
c*log2(c) follows from the two counts that changed. Windows whose Shannon
entropy reaches the threshold of the candidate's character class are joined to
spans. Every candidate has a class. Those on the allow-list give no entropy
span; of one that known forms overlap, the parts beside them are scored.

Positions are code points, end exclusive. Null and empty texts have no spans.
Rows are independent: repeated rows give repeated results, and no shuffle runs.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartlore.llm.common import whole_text

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"

#: Harmless forms: identifiers, counting runs, placeholders.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|placeholder|changeme|dummy|deadbeef|x{8}",
    r"(?i)0123456789|abcdefghij|qwertyuiop",
)


@dataclass(frozen=True)
class CharClass:
    """Candidates that match `form` belong to the first such class."""

    name: str
    form: str
    bits: float


#: Letters alone, with or without separators, need more than words reach.
CLASSES = (
    CharClass("hex", r"^(?=[a-fA-F]*[0-9])(?=[0-9]*[a-fA-F])[0-9a-fA-F]+$", 2.93),
    CharClass("alnum", r"^(?=(?:[a-z]*[0-9]){3})(?=(?:[0-9]*[a-z]){3})[a-z0-9]+$", 3.47),
    CharClass("base64", r"^(?=[^0-9]*[0-9])(?=[^a-z]*[a-z])(?=[^A-Z]*[A-Z])", 3.77),
    CharClass("upper", r"^(?=(?:[A-Z]*[0-9]){3})(?=(?:[0-9]*[A-Z]){3})[A-Z0-9]+$", 3.47),
    CharClass("digits", r"[0-9]", 3.77),
    CharClass("letters", r"", 4.0),
)
WINDOW = 20
_CHUNK = 256


def _long(value) -> Column:
    return F.lit(value).cast("bigint")


def _running(lengths: Column) -> Column:
    """Sum of all earlier elements, per element. Works through chunks, so that
    appending to an array never copies more than a chunk or a list of chunks."""
    empty = F.array().cast("array<bigint>")

    def totals(values: Column) -> Column:
        return F.aggregate(
            values, F.struct(_long(0).alias("total"), empty.alias("seen")),
            lambda s, v: F.struct((s["total"] + v).alias("total"), F.concat(s["seen"], F.array(s["total"])).alias("seen")))

    starts = F.sequence(F.lit(1), F.size(lengths), F.lit(_CHUNK))
    chunks = F.transform(starts, lambda at: totals(F.slice(lengths, at, _CHUNK)))
    offsets = totals(F.transform(chunks, lambda c: c["total"]))["seen"]
    shifted = F.zip_with(chunks, offsets, lambda c, off: F.transform(c["seen"], lambda v: v + off))
    return F.when(F.size(lengths) > 0, F.flatten(shifted)).otherwise(empty)


def _located(frame: DataFrame, text: str, pattern: str, out: str, group: int = 0, gate: Column | None = None) -> DataFrame:
    """Adds `out`: every match in order as (start, end, part), part being the
    group asked for. The text between matches gives the positions."""
    hit = F.col(text).rlike(pattern) if gate is None else gate & F.col(text).rlike(pattern)
    none = F.array().cast("array<string>")
    frame = frame.withColumn("_hit", hit)
    frame = frame.withColumns({
        "_whole": F.when(F.col("_hit"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none),
        "_part": F.when(F.col("_hit"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(none),
        "_gap": F.when(F.col("_hit"), F.split(F.col(text), pattern, -1)).otherwise(none)})
    # Gap i precedes match i; the gap after the last match is not needed.
    frame = frame.withColumn("_step", F.zip_with(
        F.slice("_gap", 1, F.size("_whole")), "_whole", lambda g, m: (F.length(g) + F.length(m)).cast("bigint")))
    frame = frame.withColumn("_before", _running(F.col("_step")))
    ends = F.zip_with("_before", "_step", lambda b, s: b + s)
    frame = frame.withColumn(out, F.zip_with(
        F.arrays_zip(ends.alias("end"), F.col("_whole").alias("whole")), "_part",
        lambda m, part: F.struct((m["end"] - F.length(m["whole"])).cast("bigint").alias("start"),
                                 m["end"].cast("bigint").alias("end"), part.alias("part"))))
    return frame.drop("_hit", "_whole", "_part", "_gap", "_step", "_before")


def window_sum(counts: Column) -> Column:
    return F.when(counts > 1, counts * F.log2(counts.cast("double"))).otherwise(F.lit(0.0))


def hot_runs(token: Column, bits: Column, width: int = WINDOW) -> Column:
    """Joined windows of `token` with at least `bits` of entropy, as (start, end).

    The fold carries the symbol counts of the current window, its sum of
    c*log2(c) and the spans so far; each step adds one symbol and, once the
    window is full, takes one away. Only ASCII symbols are counted."""
    spans = F.array().cast("array<struct<start:bigint,end:bigint>>")
    start = F.struct(F.lit(0).alias("at"), F.array_repeat(F.lit(0), 128).alias("counts"), F.lit(0.0).alias("sum"), spans.alias("spans"))
    codes = F.transform(F.slice(F.split(token, ""), 1, F.length(token)), F.ascii)
    steps = F.arrays_zip(codes.alias("came"), F.concat(F.array_repeat(F.lit(-1), width), codes).alias("went"))

    def step(s: Column, x: Column) -> Column:
        came, went, at = x["came"], x["went"], s["at"] + 1
        c_in, c_out = F.get(s["counts"], came), F.get(s["counts"], went)
        moved = F.transform(s["counts"], lambda c, k: c + (k == came).cast("int") - (k == went).cast("int"))
        change = F.when(came == went, F.lit(0.0)).otherwise(
            window_sum(c_in + 1) - window_sum(c_in)
            + F.when(went >= 0, window_sum(c_out - 1) - window_sum(c_out)).otherwise(F.lit(0.0)))
        total = s["sum"] + change
        first = (at - width).cast("bigint")
        hot = (at >= width) & (F.lit(float(width)) * (F.log2(F.lit(float(width))) - bits) >= total)
        last = F.try_element_at(s["spans"], F.lit(-1))
        longer = F.concat(F.slice(s["spans"], 1, F.greatest(F.size(s["spans"]) - 1, F.lit(0))), F.array(F.struct(
            last["start"].alias("start"), at.cast("bigint").alias("end"))))
        further = F.concat(s["spans"], F.array(F.struct(first.alias("start"), at.cast("bigint").alias("end"))))
        grown = F.when((F.size(s["spans"]) > 0) & (last["end"] >= first), longer).otherwise(further)
        return F.struct(at.alias("at"), moved.alias("counts"), total.alias("sum"), F.when(hot, grown).otherwise(s["spans"]).alias("spans"))

    # The zip is longer than the token by the window's width.
    return F.when(F.length(token) >= width, F.aggregate(F.slice(steps, 1, F.length(token)), start, step)["spans"]).otherwise(spans)


def class_bits(token: Column, classes=CLASSES) -> Column:
    """The threshold of the candidate's class, the first whose form fits; null
    where none does."""
    bits = F.lit(None).cast("double")
    for c in reversed(classes):
        bits = F.when(token.rlike(c.form), F.lit(c.bits)).otherwise(bits)
    return bits


def _tagged(spans: Column, kind: str) -> Column:
    rank = KINDS.index(kind)
    return F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def find_secrets(docs: DataFrame, text: str = "text", allow=ALLOW, classes=CLASSES, width: int = WINDOW,
                 base: str = "secret_base", found: str = "secret_spans") -> DataFrame:
    """`docs` with two arrays of (start, rank, end, kind): the known forms in
    `base`, these and the entropy spans in `found`, both by start, then kind.
    Of a candidate that known forms overlap, the parts beside them are scored.

    Every column of `docs` stays, whatever its name: `base` and `found` must be
    new names. Nulls in `text` count as empty."""
    frame = docs.select(F.struct("*").alias("_row"), whole_text(text).alias("_text"))
    frame = _located(frame, "_text", ASSIGN, "_assign", 2)
    frame = _located(frame, "_text", ACCESS, "_access", gate=F.col("_text").contains("AKIA"))
    frame = _located(frame, "_text", HEX, "_hex")
    frame = _located(frame, "_text", CANDIDATE, "_cand")
    frame = frame.withColumn("_assign", F.filter("_assign", lambda m: F.length(m["part"]) >= 8))
    frame = frame.withColumn("_base", F.array_sort(F.concat(
        _tagged(F.col("_assign"), "assign"), _tagged(F.col("_access"), "access"), _tagged(F.col("_hex"), "hex"))))

    def meets(b: Column, m: Column) -> Column:
        return (b["start"] < m["end"]) & (m["start"] < b["end"])

    def wanted(m: Column) -> Column:
        keep = F.lit(True)
        for form in allow:
            keep = keep & ~m["part"].rlike(form)
        return keep

    def beside(m: Column) -> Column:
        """The parts of a candidate between the known forms, wide enough for a window."""
        known = F.filter("_base", lambda b: meets(b, m))
        ends = F.transform(known, lambda b: b["end"])
        starts = F.concat(F.transform(known, lambda b: b["start"]), F.array(m["end"]))
        # By start; a gap begins where all earlier forms have ended.
        gaps = F.transform(starts, lambda to, i: F.struct(
            F.greatest(m["start"], F.coalesce(F.array_max(F.slice(ends, F.lit(1), i)), m["start"])).alias("start"), to.alias("end")))
        return F.transform(F.filter(gaps, lambda g: g["end"] - g["start"] >= width), lambda g: F.struct(
            g["start"].alias("start"), g["end"].alias("end"),
            F.substr(m["part"], (g["start"] - m["start"] + 1).cast("int"), (g["end"] - g["start"]).cast("int")).alias("part")))

    frame = frame.withColumn("_cand", F.flatten(F.transform(F.filter("_cand", wanted), beside)))
    # A part is judged by its own class.
    frame = frame.withColumn("_cand", F.filter("_cand", lambda m: class_bits(m["part"], classes).isNotNull()))
    hot = F.flatten(F.transform("_cand", lambda m: F.transform(
        hot_runs(m["part"], class_bits(m["part"], classes), width),
        lambda r: F.struct((r["start"] + m["start"]).alias("start"), (r["end"] + m["start"]).alias("end")))))
    frame = frame.withColumn("_hot", F.when(F.size("_cand") > 0, hot).otherwise(
        F.array().cast("array<struct<start:bigint,end:bigint>>")))
    frame = frame.withColumn("_all", F.array_sort(F.concat("_base", _tagged(F.col("_hot"), "entropy"))))
    return frame.select("_row.*", F.col("_base").alias(base), F.col("_all").alias(found))


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact_secrets(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", **options) -> DataFrame:
    """`docs` with every found span, overlapping ones joined, replaced by `mark`.
    Texts without spans, nulls included, stay as they are."""
    frame = find_secrets(docs, text, base="_sbase", found="_sspans", **options)
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    joined = F.aggregate("_sspans", none, lambda acc, s: F.when(
        (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= s["start"]),
        F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(
            F.try_element_at(acc, F.lit(-1))["start"].alias("start"),
            F.greatest(F.try_element_at(acc, F.lit(-1))["end"], s["end"]).alias("end")))),
    ).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))))
    frame = frame.withColumn("_cut", joined)
    pieces = F.transform("_cut", lambda c, i: F.substr(
        F.col(text),
        (F.when(i > 0, F.get(F.col("_cut"), i - 1)["end"]).otherwise(_long(0)) + 1).cast("int"),
        (c["start"] - F.when(i > 0, F.get(F.col("_cut"), i - 1)["end"]).otherwise(_long(0))).cast("int")))
    tail = F.substr(F.col(text), (F.element_at("_cut", -1)["end"] + 1).cast("int"), F.length(text))
    clean = F.when(F.size("_cut") == 0, F.col(text)).otherwise(
        F.concat(F.array_join(pieces, mark), F.lit(mark), tail))
    return frame.withColumn(text, clean).drop("_sbase", "_sspans", "_cut")


def secrets_report(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """One row per row of `docs`: counts of the known forms, their digest and
    all spans."""
    frame = find_secrets(docs.select(key, "text"), base="_b", found="_f", **options)

    def count(kind: str) -> Column:
        return F.size(F.filter("_b", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return frame.select(key, count("assign"), count("access"), count("hex"),
                        F.sha2(listed(F.col("_b")), 256).alias("base_sha256"), listed(F.col("_f")).alias("spans"))
