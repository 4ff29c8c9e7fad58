"""Secret scans with DataFrame functions only: fixed patterns, and sliding-window Shannon entropy per character class."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.shared import text_documents

#: The base patterns, in the order in which kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a run of 20 characters or more
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")
#: Least length of the value that is assigned.
MIN_VALUE = 6
#: Length of the entropy window.
WINDOW = 20
#: Character classes of candidates and the bits a character that a window must reach.
CLASSES = (("hex", r"(?<![A-Za-z0-9])[0-9a-fA-F]{20,}(?![A-Za-z0-9])", 2.9), ("base64", r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{20,}", 3.8))
#: Candidates that the entropy scan passes over: letters alone (words), digits alone, joined words, placeholders. Repeated groups are
#: possessive, as Java's matcher else goes one call deeper for each repetition.
ALLOWED = (r"^[A-Za-z]+$", r"^[0-9]+$", r"^[A-Za-z]++(?:[-_/+=][A-Za-z]++)*+[-_/+=]*+$", r"(?i:example|placeholder|changeme|xxxxx|00000)")

#: Characters that candidates are made of; each has a count in a window.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"
#: Matches that are walked at a time.
CHUNK = 256
#: Counts in one 64-bit number, of 5 bits each.
_PACKED = 12

_SPAN = "array<struct<start:int,no:int,end:int,value:string>>"
_MATCH = "array<struct<start:int,end:int,value:string,part:string>>"


def _let(value: Column, then) -> Column:
    """then(value), where value is computed once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _matches(text: Column, pattern: str, group: int | None = None) -> Column:
    """All matches of a pattern, left to right: array of (start, end, value, part), start and end in code points; part: the group.

    A start is the sum of the lengths of all gaps and matches before it. Sums run in chunks, so no array is copied for every match.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    between = F.transform(F.split(text, pattern, -1), F.length)
    each = F.zip_with(F.zip_with(found, part, lambda v, p: F.struct(v.alias("v"), p.alias("p"))), F.slice(between, 1, F.size(found)), lambda m, gap: F.struct(m["v"].alias("v"), m["p"].alias("p"), gap.alias("gap")))
    empty = F.from_json(F.lit("[]"), _MATCH)

    def add(state: Column, m: Column) -> Column:
        start = state["at"] + m["gap"]
        end = start + F.length(m["v"])
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(start.alias("start"), end.alias("end"), m["v"].alias("value"), m["p"].alias("part")))).alias("out"))

    def walk(chunk: Column, start: Column) -> Column:
        return F.aggregate(chunk, F.struct(start.alias("at"), empty.alias("out")), add, lambda s: s["out"])

    def walked(chunks: Column) -> Column:
        sums = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda n, m: n + m["gap"] + F.length(m["v"])))
        none = F.from_json(F.lit("[]"), "array<int>")
        starts = F.aggregate(sums, F.struct(F.lit(0).alias("at"), none.alias("out")), lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])
        return F.flatten(F.zip_with(chunks, starts, walk))

    numbers = lambda all_: F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / CHUNK).cast("int"))
    chunks = _let(each, lambda all_: F.transform(numbers(all_), lambda k: F.slice(all_, k * CHUNK + 1, CHUNK)))
    return F.when(F.rlike(text, F.lit(pattern)), _let(chunks, walked)).otherwise(empty)


def entropy_run(value: Column, least: float, window: int = WINDOW) -> Column:
    """(first, last): from the first character of the first to the last of the last window of value whose Shannon entropy reaches `least`; first is 0 if none does.

    value is made of characters of ALPHABET, window is at most 31. The counts of a window follow from those of the one before: one
    character leaves, one enters, and the sum of n log n changes by their two terms. The work is in proportion to the length of value.
    """
    gains = F.array(*(F.lit(float(n * math.log2(n) - ((n - 1) * math.log2(n - 1) if n > 1 else 0)) if n else 0.0) for n in range(window + 2)))
    place = lambda c: F.struct(F.floor(c / _PACKED).cast("int").alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), (5 * (c % _PACKED)).cast("int")).alias("unit"), c.alias("code"))
    places = F.transform(F.slice(F.split(value, ""), F.lit(1), F.length(value)), lambda c: place(F.position(c, F.lit(ALPHABET)) - 1))
    none = F.struct(F.lit(-1).alias("at"), F.lit(0).cast("long").alias("unit"), F.lit(-1).alias("code"))
    moves = _let(places, lambda all_: F.zip_with(all_, F.slice(F.concat(F.array_repeat(none, window), all_), F.lit(1), F.size(all_)), lambda come, out: F.struct(come.alias("come"), out.alias("out"))))
    count = lambda counts, p: F.when(p["code"] < 0, F.lit(0)).otherwise(F.call_function("div", F.get(counts, p["at"]), p["unit"]) % 32).cast("int")

    def step(state: Column, move: Column) -> Column:
        come, out = move["come"], move["out"]
        i = state["i"] + 1
        here = count(state["counts"], come) - F.when(come["code"] == out["code"], 1).otherwise(0)
        total = state["sum"] - F.get(gains, count(state["counts"], out)) + F.get(gains, here + 1)
        counts = F.transform(state["counts"], lambda n, j: n + F.when(j == come["at"], come["unit"]).otherwise(F.lit(0).cast("long")) - F.when(j == out["at"], out["unit"]).otherwise(F.lit(0).cast("long")))
        now = F.struct(i.alias("i"), total.alias("sum"), counts.alias("counts"), state["first"].alias("first"), state["last"].alias("last"))
        hit = lambda s: (s["i"] >= window) & (math.log2(window) - s["sum"] / window >= least - 1e-9)
        first = lambda s: F.when(hit(s) & (s["first"] == 0), s["i"] - window + 1).otherwise(s["first"])
        return _let(now, lambda s: F.struct(s["i"].alias("i"), s["sum"].alias("sum"), s["counts"].alias("counts"), first(s).alias("first"), F.when(hit(s), s["i"]).otherwise(s["last"]).alias("last")))

    start = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("sum"), F.array_repeat(F.lit(0).cast("long"), -(-len(ALPHABET) // _PACKED)).alias("counts"), F.lit(0).alias("first"), F.lit(0).alias("last"))
    return F.aggregate(moves, start, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): per row of docs its secrets as an array of (kind, start, end, value), by start, then kind.

    Start and end count code points, end is exclusive. Base kinds are leftmost non-overlapping matches of their patterns, assign only
    with a value of 6 characters or more. Kind entropy: runs of hex or base64 characters with windows of high entropy, unless the
    allow-list passes over them or a base span covers them. Null or empty texts have no spans; null ids are kept, repeated rows each have
    a result, an empty table gives no rows.
    """
    docs = text_documents(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    span = lambda no, s, e, v: F.struct(s.cast("int").alias("start"), F.lit(no).alias("no"), e.cast("int").alias("end"), v.alias("value"))
    plain = lambda no: lambda m: span(no, m["start"], m["end"], m["value"])
    base = F.concat(
        F.transform(F.filter(_matches(F.col("text"), ASSIGN, 2), lambda m: F.length(m["part"]) >= MIN_VALUE), plain(0)),
        F.transform(_matches(F.col("text"), ACCESS), plain(1)),
        F.transform(_matches(F.col("text"), HEX), plain(2)),
    )
    docs = docs.withColumn("base", F.array_sort(base).cast(_SPAN))
    added = []
    for j, (_, pattern, least) in enumerate(CLASSES):
        docs = docs.withColumn(f"c{j}", F.filter(_matches(F.col("text"), pattern), lambda m: ~_any(m["value"], ALLOWED)))
        docs = docs.withColumn(f"r{j}", F.transform(f"c{j}", _with_run(least)))
        high = F.filter(f"r{j}", lambda m: m["run"]["first"] > 0)
        added.append(F.transform(high, lambda m: span(3, m["start"] + m["run"]["first"] - 1, m["start"] + m["run"]["last"], F.substr(m["value"], m["run"]["first"], m["run"]["last"] - m["run"]["first"] + 1))))
    # A run of hex characters may be found as one of base64 characters too; equal spans are neighbours once sorted.
    once = lambda all_: F.filter(all_, lambda m, i: (i == 0) | (m != F.get(all_, i - 1)))
    docs = docs.withColumn("more", _let(F.array_sort(F.concat(*added)).cast(_SPAN), once))
    uncovered = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] <= m["start"]) & (b["end"] >= m["end"])))
    kinds = F.array(*map(F.lit, KINDS))
    spans = F.transform(F.array_sort(F.concat("base", uncovered)), lambda s: F.struct(F.get(kinds, s["no"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    return docs.select("doc_id", spans.alias("spans"))


def _with_run(least: float):
    # Not a lambda with a default: Spark would pass the element's index as its second argument.
    return lambda m: F.struct(m["start"].alias("start"), m["value"].alias("value"), entropy_run(m["value"], least).alias("run"))


def _any(value: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | F.rlike(value, F.lit(p))
    return out


def span_list(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
