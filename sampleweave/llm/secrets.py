"""Secret scans with DataFrame functions only: fixed patterns, and sliding-window entropy of candidate strings.

Fixed patterns give the base spans. A candidate is a maximal run of token characters that no base span touches; its
character class (hexadecimal, alphanumeric or base64) sets an alphabet, a window and a limit. One pass over a candidate
keeps the count of each character in the window and the sum of count x log2 count: a character that enters or leaves
changes one count and one term, and the window's entropy is log2(window) - sum / window. A candidate is a secret if some
window reaches the limit and no allow-list pattern matches it.

Positions count code points. They come from lengths alone: the pieces between matches and the matches, in turn. Running
sums and extremes go by blocks, so that the work grows with the number of matches, not its square: a state that holds a
growing array is copied at each step of an aggregate.

Cases: a null or empty text has no span; rows repeat as they come; overlapping spans of different kinds all stay; an
empty table gives no row; a text may be one long run or hold any number of matches; a run that is shorter than its
window is one window, with the limit as far below what its length allows as for a whole one; columns of any other names pass through scan
untouched, but for the one that it adds, which replaces one of the same name.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base patterns, in the order of their kinds, with the group and the least length that a match must have.
BASE = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),  # runs are maximal, so the shorter ones can be left out at once
}
#: Of each class its alphabet, window and least entropy in bits.
CLASSES = {
    "entropy_hex": ("0123456789abcdefABCDEF", 20, 3.1),
    "entropy_alnum": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 24, 4.0),
    "entropy_base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 24, 4.1),
}
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Candidates that are no secrets: UUIDs, samples, runs of one character, alphabets, paths, long numbers, words joined by hyphens or underscores.
ALLOWED = r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$|example|sample|placeholder|x{6}|(.)\2{7}|abcdefgh|0123456789|12345678|^/?([a-z_.-]+/)+[a-z_.-]*$|^[0-9=_+/-]+$|^[a-z]+([-_=+/][a-z]+)*$|^[a-z]+([-_][a-z0-9]{1,8}){3,}$"
KINDS = [*BASE, *CLASSES]
STEP = 256  #: elements of a block of a running sum
FAR = (1 << 31) - 1
CHUNK = 4096  #: characters of a piece of text: a place in a text is found from the start of its piece


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, zero: int, combine: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of integers what those before it combine to, from zero on: within blocks of STEP, from what the blocks before them come to."""

    def before(xs: Column, start: Column) -> Column:
        state = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(xs, state, lambda acc, x: F.struct(combine(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def cut(xs: Column) -> Column:
        return F.when(F.size(xs) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / STEP).cast("int")), lambda b: F.slice(xs, b * STEP + 1, F.lit(STEP)))).otherwise(F.array().cast("array<array<int>>"))

    def heads(blocks: Column) -> Column:
        return before(F.transform(blocks, lambda xs: F.aggregate(xs, F.lit(zero), combine)), F.lit(zero))

    return let(values, lambda xs: let(cut(xs), lambda blocks: F.flatten(F.zip_with(blocks, heads(blocks), before))))


def places(matches: Column, gaps: Column, values: Column) -> Column:
    """The spans (start, end, value) of matches, from the pieces of text between them."""
    sizes = F.zip_with(matches, F.slice(gaps, F.lit(1), F.size(matches)), lambda m, g: F.length(m) + F.length(g))
    starts = F.zip_with(running(sizes, 0, lambda a, b: a + b), F.slice(gaps, F.lit(1), F.size(matches)), lambda at, g: at + F.length(g))
    ends = F.zip_with(starts, matches, lambda start, m: F.struct(start.alias("start"), (start + F.length(m)).alias("end")))
    return F.zip_with(ends, values, lambda s, v: F.struct(s["start"].alias("start"), s["end"].alias("end"), v.alias("value")))


def untouched(candidates: Column, base: Column) -> Column:
    """The candidates (start, end, value; apart from each other) that no base span touches, from one sorted array of both."""
    both = F.array_sort(F.concat(
        F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), F.lit(None).cast("string").alias("value"))),
        F.transform(candidates, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["value"].alias("value"))),
    ))

    def kept(xs: Column) -> Column:
        last_end = running(F.transform(xs, lambda x: F.when(x["value"].isNull(), x["end"]).otherwise(0)), 0, lambda a, b: F.greatest(a, b))
        next_start = F.reverse(running(F.reverse(F.transform(xs, lambda x: F.when(x["value"].isNull(), x["start"]).otherwise(FAR))), FAR, lambda a, b: F.least(a, b)))
        free = F.zip_with(xs, F.zip_with(last_end, next_start, lambda e, s: F.struct(e.alias("e"), s.alias("s"))), lambda x, n: F.when(x["value"].isNotNull() & (n["e"] <= x["start"]) & (n["s"] >= x["end"]), x))
        return F.filter(free, lambda x: x.isNotNull())

    return let(both, kept)


def windowed(value: Column, alphabet: str, window: int) -> Column:
    """The greatest entropy in bits over all windows of a string, -1 without a character of the alphabet.

    A shorter string is one window: to what it lacks of log2 of its length, log2 of the window is given. Each character is an event that enters, and from the window's length on one that leaves: the state holds the counts
    by place in the alphabet, how many characters are in, the sum of count x log2 count, and the best so far.
    """
    terms = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)))
    zero = F.struct(F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0).alias("n"), F.lit(0.0).alias("sum"), F.lit(-1.0).alias("best"))

    def best(places: Column) -> Column:
        events = F.flatten(F.transform(places, lambda k, i: F.when(i >= window, F.array(k, -F.get(places, i - window))).otherwise(F.array(k))))
        size = F.least(F.size(places), F.lit(window))

        def step(acc: Column, e: Column) -> Column:
            k, by = F.abs(e), F.signum(e).cast("int")
            old, n = F.get(acc["counts"], k - 1), acc["n"] + by
            total = acc["sum"] + F.get(terms, old + by) - F.get(terms, old)
            counts = F.concat(F.slice(acc["counts"], F.lit(1), k - 1), F.array(old + by), F.slice(acc["counts"], k + 1, F.lit(len(alphabet))))
            found = F.when(n == size, F.greatest(acc["best"], F.lit(math.log2(window)) - total / size)).otherwise(acc["best"])
            return F.struct(counts.alias("counts"), n.alias("n"), total.alias("sum"), found.alias("best"))

        return F.aggregate(events, zero, step, lambda acc: acc["best"])

    return let(F.filter(F.transform(F.split(value, ""), lambda c: F.instr(F.lit(alphabet), c)), lambda k: k > 0), best)


def kind_of(value: Column) -> Column:
    """The class of a candidate: the smallest alphabet that holds it."""
    return F.when(value.rlike("^[0-9a-fA-F]+$"), "entropy_hex").when(value.rlike("^[A-Za-z0-9]+$"), "entropy_alnum").otherwise("entropy_base64")


def long_enough(least: int) -> Callable[[Column], Column]:
    return lambda s: F.length(s["value"]) >= least


def of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"))


def scan(docs: DataFrame, column: str = "secrets", text: str = "text") -> DataFrame:
    """docs with its secrets: an array of (start, rank, end, kind) in order of start, then of the kind's place in KINDS.

    Each pattern is looked for once; what follows a match (pieces, groups, places) is computed only for texts that have one.
    """
    own = docs.columns
    mine = "_"  # no column of docs begins with it
    while any(c.lower().startswith(mine) for c in own):
        mine += "_"
    found = docs.withColumn(f"{mine}text", F.coalesce(F.col(f"`{text}`"), F.lit("")))
    whole = F.col(f"{mine}text")
    patterns = BASE | {"candidate": (CANDIDATE, 0, 0)}
    for kind, (pattern, *_) in patterns.items():
        found = found.withColumn(f"{mine}{kind}", F.regexp_extract_all(whole, F.lit(pattern), F.lit(0)))
    for kind, (pattern, group, _) in patterns.items():
        values = F.regexp_extract_all(whole, F.lit(pattern), F.lit(group)) if group else F.col(f"{mine}{kind}")
        rest = F.struct(F.split(whole, pattern, -1).alias("gaps"), values.alias("values"))
        found = found.withColumn(f"{mine}{kind}_rest", F.when(F.size(f"{mine}{kind}") > 0, rest))
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    for kind, (*_, least) in patterns.items():
        made = F.filter(places(F.col(f"{mine}{kind}"), F.col(f"{mine}{kind}_rest.gaps"), F.col(f"{mine}{kind}_rest.values")), long_enough(least))
        found = found.withColumn(f"{mine}{kind}_spans", F.when(F.size(f"{mine}{kind}") > 0, made).otherwise(empty))
    plain = [F.transform(f"{mine}{kind}_spans", of_kind(kind)) for kind in BASE]
    base, apart, added = (F.col(f"{mine}{x}") for x in ("base", "apart", "added"))
    found = found.withColumn(f"{mine}base", F.array_sort(F.concat(*plain)))
    mixed = F.filter(f"{mine}candidate_spans", lambda c: c["value"].rlike("[0-9]") & c["value"].rlike("[A-Za-z]") & ~c["value"].rlike(ALLOWED))
    found = found.withColumn(f"{mine}apart", F.when(F.size(f"{mine}candidate_spans") > 0, mixed).otherwise(empty))
    found = found.withColumn(f"{mine}apart", F.when((F.size(apart) > 0) & (F.size(base) > 0), untouched(apart, base)).otherwise(apart))

    def judged(c: Column) -> Column:
        kind = kind_of(c["value"])
        rank = F.lit(-1)
        for name, (alphabet, window, limit) in CLASSES.items():
            rank = F.when(kind == name, F.when(windowed(c["value"], alphabet, window) >= limit, F.lit(KINDS.index(name))).otherwise(F.lit(-1))).otherwise(rank)
        return F.struct(c["start"].alias("start"), rank.alias("rank"), c["end"].alias("end"), kind.alias("kind"))

    kept = F.filter(F.transform(apart, judged), lambda s: s["rank"] >= 0)
    found = found.withColumn(f"{mine}added", F.when(F.size(apart) > 0, kept))
    return found.withColumn(column, F.when(F.size(added) > 0, F.array_sort(F.concat(base, added))).otherwise(base)).select(*(F.col(f"`{c}`") for c in own if c != column), f"`{column}`")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def base_only(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["rank"] < len(BASE))


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """A text in which each span, or run of overlapping spans, is replaced by a mark."""

    def piece(chunks: Column, start: Column, end: Column) -> Column:
        """Characters start to before end, from the pieces of CHUNK characters that hold them."""
        first, last = (F.floor(x / CHUNK).cast("int") for x in (start, end - 1))
        part = lambda k: F.substring(F.get(chunks, k), F.greatest(start - k * CHUNK, F.lit(0)) + 1, F.least(end - k * CHUNK, F.lit(CHUNK)) - F.greatest(start - k * CHUNK, F.lit(0)))
        return F.when(start < end, F.array_join(F.transform(F.sequence(first, last), part), "")).otherwise("")

    def built(chunks: Column) -> Column:
        before = running(F.transform(spans, lambda s: s["end"]), 0, lambda a, b: F.greatest(a, b))
        parts = F.zip_with(spans, before, lambda s, at: F.when(s["start"] >= at, F.concat(piece(chunks, at, s["start"]), F.lit(mark))).otherwise(""))
        return F.concat(F.array_join(parts, ""), piece(chunks, F.array_max(F.transform(spans, lambda s: s["end"])), F.length(text)))

    return F.when(F.size(spans) > 0, let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), built)).otherwise(text)
