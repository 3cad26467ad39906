"""Review and status events: latest state and legal transitions, as batch and as stream."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Legal changes of a plan's status.
ALLOWED = {("DRAFT", "ENGINEER_REVIEWED"), ("REJECTED", "ENGINEER_REVIEWED"), ("ENGINEER_REVIEWED", "APPROVED"), ("DRAFT", "REJECTED"), ("ENGINEER_REVIEWED", "REJECTED")}


def latest_state(events: DataFrame) -> DataFrame:
    """The last event of each detection by (ts, event_id). The same expression serves a stream in update or complete mode."""
    return events.groupBy("detection_id").agg(F.max_by(F.struct("action", "value"), F.struct("ts", "event_id")).alias("last"), F.count(F.lit(1)).alias("n_events")).select("detection_id", "last.action", "last.value", "n_events")


def latest_state_stream(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """latest_state over a stream that may deliver an event more than once within the delay."""
    return latest_state(events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"]))


STATES = ["DRAFT", "ENGINEER_REVIEWED", "APPROVED", "REJECTED", "SUPERSEDED"]
#: Events of a plan that are replayed in one array.
BLOCK = 512


def _legal(state: Column, to: Column) -> Column:
    """Of state numbers: whether a plan may go from one to the other; any may be superseded."""
    number = STATES.index
    return reduce(lambda a, b: a | b, [(state == number(x)) & (to == number(y)) for x, y in sorted(ALLOWED)], to == number("SUPERSEDED"))


def _next(state: Column, event: Column) -> Column:
    return F.when(_legal(state, event["to"]), event["to"]).otherwise(state)


def replay(events: DataFrame, block: int = BLOCK) -> DataFrame:
    """Strict replay of status events (plan_id, event_id, ts, to_status): an illegal event is reported and doesn't advance the state.

    A block of a plan's events maps each state to the state after it. The blocks' maps give each block's start, and then
    every block is replayed by itself, so a plan with very many events is spread over tasks.
    """
    c = F.col
    n = F.row_number().over(W.partitionBy("plan_id").orderBy("ts", "event_id")) - 1
    to = F.array_position(F.array(*map(F.lit, STATES)), c("to_status")).cast("int") - 1
    numbered = events.select("plan_id", "event_id", n.alias("n"), to.alias("to")).withColumn("b", F.floor(c("n") / block).cast("int"))
    blocks = numbered.groupBy("plan_id", "b").agg(F.sort_array(F.collect_list(F.struct("n", "to", "event_id"))).alias("ev"))
    after = F.array(*[F.aggregate("ev", F.lit(s), _next) for s in range(len(STATES))])
    maps = blocks.select("plan_id", "b", after.alias("m")).groupBy("plan_id").agg(F.sort_array(F.collect_list(F.struct("b", "m"))).alias("all"))
    starts = F.aggregate("all", F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.get(x["m"], F.element_at(s, -1)))))
    start = maps.select("plan_id", F.posexplode(starts).alias("b", "start"))
    one = "struct<event_id: bigint, was: int, to: int, legal: boolean>"
    zero = F.struct(c("start").alias("s"), F.array().cast(f"array<{one}>").alias("out"))
    row = lambda s, e: F.struct(e["event_id"].cast("long").alias("event_id"), s["s"].alias("was"), e["to"].alias("to"), _legal(s["s"], e["to"]).alias("legal")).cast(one)
    replayed = F.aggregate("ev", zero, lambda s, e: F.struct(_next(s["s"], e).alias("s"), F.concat(s["out"], F.array(row(s, e))).alias("out")), lambda s: s["out"])
    name = lambda x: F.get(F.array(*map(F.lit, STATES)), x)
    out = blocks.join(start, ["plan_id", "b"]).select("plan_id", F.explode(replayed).alias("r"))
    return out.select("plan_id", "r.event_id", name(c("r.was")).alias("from_status"), name(c("r.to")).alias("to_status"), "r.legal")
