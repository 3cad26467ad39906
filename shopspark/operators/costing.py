"""Times of steps and batches from components, feed ranges, load bounds, event counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.guards import wildcard

c = F.col


def component(kind: str, low: Column, high: Column, status: str | Column, missing: list[str]) -> Column:
    """struct(kind, low, high, status, missing): UNKNOWN with the names of the missing inputs unless both values are known."""
    known = low.isNotNull() & high.isNotNull()
    return F.struct(
        F.lit(kind).alias("kind"), F.when(known, low).cast("double").alias("low"), F.when(known, high).cast("double").alias("high"), F.when(known, status).otherwise("UNKNOWN").alias("status"),
        F.when(known, F.array().cast("array<string>")).otherwise(F.array(*map(F.lit, missing))).alias("missing"),
    )


def cutting(path_mm: Column, low_feed: Column, high_feed: Column) -> Column:
    """Seconds of a cutting path at the highest and at the lowest feed (mm/min)."""
    at = lambda f: F.when(f > 0, path_mm * 60 / f)
    return component("CUTTING", at(high_feed), at(low_feed), "CALCULATED", ["cutting_path_length_mm", "feed_rate_mm_min"])


def rapid(distance_mm: Column, rate_m_min: Column) -> Column:
    t = F.when(rate_m_min > 0, distance_mm * 60 / (rate_m_min * 1000))
    return component("RAPID", t, t, "CALCULATED", ["rapid_distance_mm", "machine_rapid_traverse"])


def approach_retract(approach_s: Column, retract_s: Column, measured: Column) -> Column:
    t = approach_s + retract_s
    return component("APPROACH_RETRACT", t, t, F.when(measured, "CALCULATED").otherwise("USER_SUPPLIED"), ["approach_distance_mm", "retract_distance_mm"])


def tool_change(change_s: Column, changes: Column) -> Column:
    t = F.when(changes >= 0, change_s * changes)
    return component("TOOL_CHANGE", t, t, "REFERENCE", ["atc_time_sec"])


def given(kind: str, seconds: Column) -> Column:
    """Setup, load/unload, probing, inspection or dwell: what the user says, never guessed; negative values don't count."""
    t = F.when(seconds >= 0, seconds)
    return component(kind, t, t, "USER_SUPPLIED", [f"{kind}_time_sec".lower()])


def assembled(df: DataFrame, *components: Column) -> DataFrame:
    """df with known_low, known_high (sums of the known), unknown (kinds), completeness; total_low and total_high only where all are known."""
    df = df.withColumn("_p", F.array(*components))
    known = F.filter("_p", lambda p: p["status"] != "UNKNOWN")
    df = df.withColumns({"_k": known, "unknown": F.transform(F.filter("_p", lambda p: p["status"] == "UNKNOWN"), lambda p: p["kind"])})
    some, full = F.size("_k") > 0, F.size("unknown") == 0
    add = lambda f: F.when(some, F.aggregate("_k", F.lit(0.0), lambda s, p: s + p[f]))
    df = df.withColumns({"known_low": add("low"), "known_high": add("high"), "completeness": F.when(full, "FULLY_CALCULATED").when(some, "PARTIALLY_CALCULATED").otherwise("INSUFFICIENT_DATA")})
    return df.withColumns({"total_low": F.when(full, c("known_low")), "total_high": F.when(full, c("known_high"))}).drop("_p", "_k")


def batch(quantity: Column, setup_s: Column, low_s: Column, high_s: Column, other_s: Column) -> list[Column]:
    """per_part_setup, per_part_low, per_part_high and completeness of a batch; a batch of none is INSUFFICIENT_DATA."""
    share = F.when(quantity > 0, setup_s / quantity)
    low, high = low_s + share + other_s, F.coalesce(high_s, low_s) + share + other_s
    state = F.when(F.coalesce(quantity, F.lit(0)) <= 0, "INSUFFICIENT_DATA").when(low.isNotNull(), "FULLY_CALCULATED").when(low_s.isNotNull() | share.isNotNull(), "PARTIALLY_CALCULATED").otherwise("INSUFFICIENT_DATA")
    return [share.alias("per_part_setup"), low.alias("per_part_low"), high.alias("per_part_high"), state.alias("completeness")]


def feed_ranges(steps: DataFrame, references: DataFrame) -> DataFrame:
    """(operation, iso_group, low, high, n): range of feed per tooth over all matching references; the few scopes are reduced before the steps meet them."""
    scopes = steps.select("operation", "iso_group").distinct()
    r = references.select(c("operation").alias("ro"), c("iso_group").alias("ri"), "min_value", "max_value").groupBy("ro", "ri").agg(F.min("min_value").alias("lo"), F.max("max_value").alias("hi"), F.count(F.lit(1)).alias("k"))
    found = scopes.join(r, wildcard(c("ro"), c("operation")) & wildcard(c("ri"), c("iso_group")), "left")
    return found.groupBy("operation", "iso_group").agg(F.min("lo").alias("low"), F.max("hi").alias("high"), F.coalesce(F.sum("k"), F.lit(0)).cast("long").alias("n"))


def first_per_type(references: DataFrame) -> DataFrame:
    """(parameter_type, record_id, unit, min_value, max_value): the first record of each type by id."""
    return references.groupBy("parameter_type").agg(F.min_by(F.struct("unit", "min_value", "max_value"), "record_id").alias("r"), F.min("record_id").alias("record_id")).select("parameter_type", "record_id", "r.*")


def load_bounds(jobs: DataFrame, windows: DataFrame, key: str) -> DataFrame:
    """(key, load, latest_end, largest_setup, makespan): what bounds a schedule of a machine from below and above; missing parts are 0."""
    j = jobs.groupBy(key).agg(F.sum("duration").alias("load"), F.max("setup").alias("largest_setup"), F.max("end").alias("makespan"))
    w = windows.groupBy(key).agg(F.max("end").alias("latest_end"))
    return j.join(w, key, "full").na.fill(0, ["load", "largest_setup", "latest_end", "makespan"])


def event_counts(events: DataFrame, key: str, kinds: list[str], adverse: list[str]) -> DataFrame:
    """(key, n_<kind>..., adverse, lossless): events per class; lossless only where a COMPLETE one stands and none is adverse."""
    out = events.groupBy(key).agg(*[F.count_if(c("kind") == k).alias(f"n_{k.lower()}") for k in kinds], F.bool_or(c("kind").isin(adverse)).alias("adverse"), F.bool_or(c("complete")).alias("_done"))
    return out.withColumn("lossless", c("_done") & ~c("adverse")).drop("_done")


def changes_in_order(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(key, changes): how often the value differs from the row before; NULL forgets the value before it."""
    before = F.lag(value).over(W.partitionBy(key).orderBy(*order))
    return rows.select(key, (before.isNotNull() & c(value).isNotNull() & (before != c(value))).cast("int").alias("_c")).groupBy(key).agg(F.sum("_c").cast("long").alias("changes"))


def by_precedence(values: DataFrame, key: str, order: dict[str, int]) -> DataFrame:
    """(key, source, value, rejected, status): the value of the best-ranked source, and the sources passed over in order. Values that are
    NULL don't take part; a key that has no other stays, as INSUFFICIENT_DATA."""
    rank = F.coalesce(*[F.when(c("source") == s, F.lit(r)) for s, r in order.items()], F.lit(len(order)))
    own = values.withColumn("_v", F.when(c("value").isNotNull(), F.struct(rank.alias("_r"), "source", "value")))
    out = own.groupBy(key).agg(F.min("_v").alias("best"), F.sort_array(F.collect_list("_v")).alias("all"))
    passed = F.transform(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))), lambda x: x["source"])
    status = F.when(c("best").isNull(), "INSUFFICIENT_DATA").otherwise("RESOLVED")
    return out.select(key, "best.source", "best.value", F.array_join(passed, ",").alias("rejected"), status.alias("status"))
