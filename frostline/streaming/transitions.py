"""Incidents from status events, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FIRING, RESOLVED = "firing", "resolved"
OUT = "kind string, entity string, seq long, state string"


def transitions(events: DataFrame) -> DataFrame:
    """(kind, entity, seq, state) of every change of (seq, kind, entity, failed); a first event that is healthy changes nothing."""
    w = Window.partitionBy("kind", "entity").orderBy("seq")
    prior = F.coalesce(F.lag("failed").over(w), F.lit(False))
    changed = events.withColumn("prior", prior).where("failed <> prior")
    return changed.select("kind", "entity", "seq", F.when(F.col("failed"), FIRING).otherwise(RESOLVED).alias("state"))


def transitions_stream(events: DataFrame) -> DataFrame:
    """The same over a stream of events: the state of each (kind, entity) is its last sequence number and whether it failed.

    An event at or below the last number was seen before (a replay) and changes nothing.
    """

    def run(key: tuple, chunks: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, failed = state.get if state.exists else (-(1 << 62), False)
        rows = pd.concat(list(chunks)).drop_duplicates("seq").sort_values("seq")
        out = []
        for seq, bad in zip(rows["seq"].tolist(), rows["failed"].tolist()):
            if seq <= last:
                continue
            if bad != failed:
                out.append((*key, seq, FIRING if bad else RESOLVED))
            last, failed = seq, bool(bad)
        state.update((last, failed))
        yield pd.DataFrame(out, columns=["kind", "entity", "seq", "state"])

    return events.select("seq", "kind", "entity", "failed").groupBy("kind", "entity").applyInPandasWithState(run, OUT, "last long, failed boolean", "append", "NoTimeout")


def sequence_gaps(events: DataFrame, cursor: int) -> DataFrame:
    """(first_missing, last_missing) of the sequence numbers over cursor that are not there; a journal that ends before it is an error.

    Neighbours are found within ranges of 2^20 numbers, and each range's first with the last number of the ranges before: only a row per range
    is sorted as a whole.
    """
    top = events.agg(F.max("seq")).first()[0]
    if top is not None and top < cursor:
        raise ValueError("the journal regressed")
    after = events.where(F.col("seq") > cursor).select("seq").distinct().withColumn("r", F.shiftright("seq", 20))
    ranges = after.groupBy("r").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    edges = ranges.select(F.col("lo").alias("seq"), F.coalesce(F.lag("hi").over(Window.orderBy("r")), F.lit(cursor)).alias("prior"))
    inside = after.select("seq", F.lag("seq").over(Window.partitionBy("r").orderBy("seq")).alias("prior")).where("prior is not null")
    return inside.unionByName(edges).where("seq > prior + 1").select((F.col("prior") + 1).alias("first_missing"), (F.col("seq") - 1).alias("last_missing"))


def prune_delivered(events: DataFrame, now: int, days: int = 30) -> DataFrame:
    """Events (created in seconds, delivery) without those that were delivered over days ago; pending ones stay."""
    return events.where((F.col("delivery") == "pending") | (F.col("created") >= now - days * 86400))


def prune_incidents(incidents: DataFrame, events: DataFrame, now: int, days: int = 30) -> DataFrame:
    """Incidents (kind, entity, active, updated) without closed ones not touched for days, unless an event of theirs is pending."""
    waiting = events.where("delivery = 'pending'").select("kind", "entity").distinct().withColumn("waits", F.lit(True))
    old = ~F.col("active") & (F.col("updated") < now - days * 86400) & F.col("waits").isNull()
    return incidents.join(waiting, ["kind", "entity"], "left").where(~old).drop("waits")


def keep_newest(events: DataFrame, keep: int = 10_000) -> DataFrame:
    """The events of the last keep sequence numbers."""
    top = events.agg(F.max("seq")).first()[0]
    return events if top is None else events.where(F.col("seq") > top - keep)


def late_arrivals(cycles: DataFrame) -> DataFrame:
    """(policy, cycle, key) of keys at or below the upper key of the policy's earlier cycles; cycles: policy, cycle, key.

    A row per policy and cycle carries the running maximum; keys meet it by an equi-join.
    """
    top = cycles.groupBy("policy", "cycle").agg(F.max("key").alias("hi"))
    w = Window.partitionBy("policy").orderBy("cycle").rowsBetween(Window.unboundedPreceding, -1)
    before = top.withColumn("seen", F.max("hi").over(w)).where("seen is not null").select("policy", "cycle", "seen")
    return cycles.join(before, ["policy", "cycle"]).where("key <= seen").select("policy", "cycle", "key")
