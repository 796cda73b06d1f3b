"""Trigger filters over tags, and the sample ranges that they select.

A filter reads [start/context, stop/context]; a leading ^ fires at the first tag that no longer matches. With one side, or
equal sides, every match is a trigger by itself. Tags are far rarer than samples, so ranges come from the tags of a stream
alone; samples then meet ranges in an equi-join on blocks of idx.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN_END = 1 << 62


@dataclass(frozen=True)
class Side:
    """A name and a context to match (empty: any), and whether the end of the match counts."""

    name: str = ""
    context: str = ""
    after: bool = False

    @property
    def given(self) -> bool:
        return bool(self.name or self.context)


@dataclass(frozen=True)
class Filter:
    start: Side
    stop: Side

    @property
    def single(self) -> bool:
        return not self.stop.given or not self.start.given or self.start == self.stop

    @property
    def one(self) -> Side:
        return self.start if self.start.given else self.stop


def parsed(text: str) -> Filter:
    body = text.strip()
    if body.startswith("[") != body.endswith("]") or body.count("[") > 1 or body.count("]") > 1:
        raise ValueError(f"unbalanced brackets in filter: {text}")
    parts = body.strip("[]").split(",")
    if len(parts) > 2:
        raise ValueError(f"more than a start and a stop in filter: {text}")

    def side(part: str) -> Side:
        name, *context = (x.strip() for x in part.split("/"))
        if len(context) > 1:
            raise ValueError(f"more than one context in filter: {text}")
        after = any(x.startswith("^") for x in (name, *context))
        return Side(name.lstrip("^"), context[0].lstrip("^") if context else "", after)

    return Filter(side(parts[0]), side(parts[1]) if len(parts) > 1 else Side())


def matches(side: Side, name: str, context: str) -> bool:
    return (not side.name or side.name == name) and (not side.context or side.context in context)


def verdicts(rule: Filter, tags: list[tuple[int, str, str]]) -> Iterator[tuple[int, str]]:
    """(idx, start or stop) of the tags of one stream in order; of several at one sample the first that counts."""
    if rule.single:
        last = None
        one = rule.one
        for idx, name, context in tags:
            # a single trigger's context test runs the other way round: an empty context of the tag matches
            if idx != last and (not one.name or one.name == name) and (not one.context or context in one.context):
                last = idx
                yield idx, "start"
        return
    pending_start = pending_stop = False
    last = None
    for idx, name, context in tags:
        is_start, is_stop = matches(rule.start, name, context), matches(rule.stop, name, context)
        found = None
        if rule.start.after:
            if is_start:
                pending_start = True
            elif pending_start:
                pending_start, found = False, "start"
        elif is_start:
            found = "start"
        if found is None:
            if rule.stop.after:
                if is_stop:
                    pending_stop = True
                elif pending_stop:
                    pending_stop, found = False, "stop"
            elif is_stop:
                found = "stop"
        if found and idx != last:
            last = idx
            yield idx, found


def ranges(rule: Filter, tags: list[tuple[int, str, str]], pre: int, post: int, overlap: bool) -> list[tuple[int, int, int]]:
    """(trigger, first, end) of one stream: the start is in, the stop is not; pre and post widen both ends.

    Without overlap a start within a range is ignored and single triggers extend it; with it each start opens a range
    and a stop closes the oldest.
    """
    out: list[tuple[int, int, int]] = []
    if rule.single:
        for idx, _ in verdicts(rule, tags):
            out.append((idx, max(0, idx - pre), idx + post))
    else:
        waiting: list[int] = []
        for idx, kind in verdicts(rule, tags):
            if kind == "start":
                if overlap or not waiting:
                    waiting.append(idx)
            elif waiting:
                first = waiting.pop(0)
                out.append((first, max(0, first - pre), idx + post))
        out += [(first, max(0, first - pre), OPEN_END) for first in waiting]
    if overlap:
        return out
    merged: list[tuple[int, int, int]] = []
    for trigger, first, end in sorted(out, key=lambda r: r[1]):
        if merged and first < merged[-1][2]:
            merged[-1] = (merged[-1][0], merged[-1][1], max(end, merged[-1][2]))
        elif end > first:
            merged.append((trigger, first, end))
    return merged


def matching(side: Side, reverse: bool = False) -> Column:
    """Whether a tag matches a side, as a column; reverse: the side's context holds the tag's."""
    name, context = F.coalesce("name", F.lit("")), F.coalesce("context", F.lit(""))
    out = F.lit(True) if not side.name else name == side.name
    if not side.context:
        return out
    return out & (F.lit(side.context).contains(context) if reverse else context.contains(side.context))


def merged(found: DataFrame) -> DataFrame:
    """Ranges of a stream that overlap become one, with the first one's trigger; empty ones go."""
    w = Window.partitionBy("stream_id").orderBy("i_start", "trigger")
    before = F.max("i_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = found.filter("i_end > i_start").withColumn("_new", F.when(before.isNull() | (F.col("i_start") >= before), 1).otherwise(0))
    rows = rows.withColumn("seg", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return rows.groupBy("stream_id", "seg").agg(F.min_by("trigger", F.struct("i_start", "trigger")).alias("trigger"), F.min("i_start").alias("i_start"), F.max("i_end").alias("i_end"))


def segments(tags: DataFrame, rule: str | Filter, pre: int = 0, post: int = 0, overlap: bool = False) -> DataFrame:
    """stream_id, seg, trigger, i_start, i_end of the ranges that a filter selects. tags: stream_id, idx, name, context, seq.

    Single triggers, and starts and stops that may not overlap, are window expressions over the tags; filters with ^ and
    overlapping starts and stops need the automaton above and run it over each stream's tags.
    """
    rule = parsed(rule) if isinstance(rule, str) else rule
    w = Window.partitionBy("stream_id").orderBy("idx")
    columns = ["stream_id", "seg", "trigger", "i_start", "i_end"]
    if rule.single:
        hit = tags.filter(matching(rule.one, reverse=True)).select("stream_id", "idx").distinct()
        found = hit.select("stream_id", F.col("idx").alias("trigger"), F.greatest(F.col("idx") - pre, F.lit(0)).alias("i_start"), (F.col("idx") + post).alias("i_end"))
        if not overlap:
            return merged(found).select(*columns)
        return found.withColumn("seg", (F.row_number().over(Window.partitionBy("stream_id").orderBy("trigger")) - 1).cast("long")).select(*columns)
    if not (overlap or rule.start.after or rule.stop.after):
        mark = F.when(matching(rule.start), 1).when(matching(rule.stop), 0)
        marks = tags.withColumn("_mark", mark).filter("_mark is not null").groupBy("stream_id", "idx").agg(F.min_by("_mark", "seq").alias("_mark"))
        turns = marks.withColumn("_was", F.lag("_mark", 1, 0).over(w)).filter("_mark <> _was")
        turns = turns.withColumn("_stop", F.lead("idx").over(w)).filter("_mark = 1")
        found = turns.select("stream_id", F.col("idx").alias("trigger"), F.greatest(F.col("idx") - pre, F.lit(0)).alias("i_start"), F.coalesce(F.col("_stop") + post, F.lit(OPEN_END)).alias("i_end"))
        return merged(found).select(*columns)

    def of_stream(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["idx", "seq"], kind="stable")
        found = ranges(rule, list(zip(pdf["idx"], pdf["name"].fillna(""), pdf["context"].fillna(""), strict=True)), pre, post, overlap)
        return pd.DataFrame({"stream_id": pdf["stream_id"].iloc[0], "seg": range(len(found)), "trigger": [r[0] for r in found], "i_start": [r[1] for r in found], "i_end": [r[2] for r in found]})

    schema = f"stream_id {dict(tags.dtypes)['stream_id']}, seg long, trigger long, i_start long, i_end long"
    return tags.select("stream_id", "idx", "name", "context", "seq").groupBy("stream_id").applyInPandas(of_stream, schema)


def selected(samples: DataFrame, found: DataFrame, block: int = 4096) -> DataFrame:
    """Samples in ranges, with seg and pos (the place in the range). Both sides meet on blocks of idx.

    Ranges are first cut at the stream's end, so that an open one covers no blocks beyond it.
    """
    ends = samples.groupBy("stream_id").agg(F.max("idx").alias("_last"))
    cut = found.join(ends, "stream_id").withColumn("i_end", F.least("i_end", F.col("_last") + 1)).filter("i_start < i_end").drop("_last")
    cut = cut.withColumn("_block", F.explode(F.sequence(F.expr(f"i_start div {block}"), F.expr(f"(i_end - 1) div {block}"))))
    met = samples.withColumn("_block", F.expr(f"idx div {block}")).join(cut, ["stream_id", "_block"]).filter("idx >= i_start and idx < i_end")
    return met.withColumn("pos", F.col("idx") - F.col("i_start")).drop("_block")


def stream_filter(samples: DataFrame, tags: DataFrame, rule: str, pre: int = 0, post: int = 0) -> DataFrame:
    """The samples between start and stop triggers; ranges do not overlap."""
    return selected(samples, segments(tags, rule, pre, post)).drop("trigger", "i_start", "i_end")


def stream_to_dataset(samples: DataFrame, tags: DataFrame, rule: str, pre: int = 0, post: int = 0, most: int = 0, sample_rate: float = 1.0) -> DataFrame:
    """One data set per range: its axis in seconds from the trigger and its values. Ranges may overlap."""
    rows = selected(samples, segments(tags, rule, pre, post, overlap=True))
    if most:
        rows = rows.filter(F.col("pos") < most)
    made = rows.groupBy("stream_id", "seg", "trigger", "i_start").agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("_rows"))
    trigger = F.col("trigger")
    return made.select("stream_id", "seg", "trigger", F.transform("_rows", lambda r: (r["idx"] - trigger) / F.lit(float(sample_rate))).alias("axis"), F.transform("_rows", lambda r: r["value"]).alias("values"))
