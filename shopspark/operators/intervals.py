"""Half-open intervals: merging, subtraction, containment; schedule checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .spread import parts, spread


def merge(df: DataFrame, key: str, start: str = "start_h", end: str = "end_h") -> DataFrame:
    """Unions of overlapping and touching intervals per key (gaps and islands)."""
    df = df.filter(F.col(start) < F.col(end))
    w = W.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))

    df = df.withColumn("_new", (reach.isNull() | (F.col(start) > reach)).cast("int")).withColumn("_i", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return df.groupBy(key, "_i").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_i")

def subtract(windows: DataFrame, holes: DataFrame, key: str, start: str = "start_h", end: str = "end_h") -> DataFrame:
    """What is left of merged windows without the holes: boundary events, and stretches covered by a window and by no hole."""
    n = parts(windows, holes)
    a, b = merge(spread(windows, key, n=n), key, start, end), merge(spread(holes, key, n=n), key, start, end)
    event = lambda d, w, h: d.select(key, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(w).alias("w"), F.lit(h).alias("h")), F.struct(F.col(end).alias("at"), F.lit(-w).alias("w"), F.lit(-h).alias("h")))).alias("e")).select(key, "e.*")
    e = event(a, 1, 0).unionByName(event(b, 0, 1)).groupBy(key, "at").agg(F.sum("w").alias("w"), F.sum("h").alias("h"))
    o = W.partitionBy(key).orderBy("at")
    e = e.withColumns({"w": F.sum("w").over(o), "h": F.sum("h").over(o), "next": F.lead("at").over(o)})
    return merge(e.filter("w > 0 AND h = 0 AND next IS NOT NULL").select(key, F.col("at").alias(start), F.col("next").alias(end)), key, start, end)

def clip(df: DataFrame, low: int, high: int, start: str = "start_h", end: str = "end_h") -> DataFrame:
    df = df.withColumns({start: F.greatest(F.col(start), F.lit(low)), end: F.least(F.col(end), F.lit(high))})
    return df.filter(F.col(start) < F.col(end))

def calendars(machines: DataFrame, windows: DataFrame, key: str, low: int, high: int, start: str = "start_h", end: str = "end_h") -> DataFrame:
    """Merged, clipped windows per machine; a machine without a calendar has the whole horizon."""
    w = clip(merge(windows, key, start, end), low, high, start, end).withColumn("has", F.lit(True))
    had = windows.select(key).distinct().withColumn("known", F.lit(True))
    out = machines.join(had, key, "left").join(w, key, "left").filter(F.col("known").isNull() | F.col("has").isNotNull())
    return out.select(key, F.coalesce(start, F.lit(low).cast("long")).alias(start), F.coalesce(end, F.lit(high).cast("long")).alias(end), F.col("known").isNull().alias("whole_horizon"))

def outside(jobs: DataFrame, windows: DataFrame, key: str, job: str, bucket: int, start: str = "s", end: str = "e") -> DataFrame:
    """Jobs that lie in no single window. Both sides are dealt into time buckets, so the join has an equality besides the range."""
    cut = lambda d: d.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor((F.col(end) - 1) / bucket))))
    first = jobs.withColumn("_b", F.floor(F.col(start) / bucket))
    w = cut(windows).select(F.col(key).alias("_k"), "_b", F.col(start).alias("_s"), F.col(end).alias("_e"))
    b = first.withColumnRenamed("_b", "_jb")
    return b.join(w, (b[key] == w["_k"]) & (b["_jb"] == w["_b"]) & (b[start] >= w["_s"]) & (b[end] <= w["_e"]), "left_anti").drop("_jb")

def setup_gaps(jobs: DataFrame, matrix: DataFrame, default_s: int) -> DataFrame:
    """Consecutive jobs of a machine: overlap, and a gap shorter than the setup change needs (exact pair, else the default; the same key isn't free)."""
    w = W.partitionBy("machine_id").orderBy("start_s", "operation_id")
    j = jobs.withColumns({"p_end": F.lag("end_s").over(w), "p_key": F.lag("setup_key").over(w)}).filter("p_end IS NOT NULL")
    j = j.join(matrix, (j["p_key"] == matrix["from_key"]) & (j["setup_key"] == matrix["to_key"]), "left")
    need = F.coalesce("seconds", F.lit(default_s))
    gap = F.col("start_s") - F.col("p_end")
    return j.select("machine_id", "operation_id", gap.alias("gap_s"), need.alias("need_s"), F.when(gap < 0, "OVERLAP").when(gap < need, "SETUP_TOO_SHORT").otherwise("OK").alias("status"))

def setup_spans(jobs: DataFrame, matrix: DataFrame, default_s: int, windows: DataFrame) -> DataFrame:
    """(machine_id, operation_id, span_s, end_s, state) of each setup before a job that follows another: the setup (which ends as the job starts)
    and the job must lie in one window of the machine. FITS, CROSSES (begins in a window and leaves it), OUTSIDE, or NO_CALENDAR.

    Windows (machine_id, start_s, end_s) are merged, so only the last that begins by a span's start can hold it: one scan of both in order
    carries its end to the spans. A setup that takes no time has no span.
    """
    w = W.partitionBy("machine_id").orderBy("start_s", "operation_id")
    j = jobs.withColumn("p_key", F.lag("setup_key").over(w)).filter("p_key IS NOT NULL")
    j = j.join(matrix, (j["p_key"] == matrix["from_key"]) & (j["setup_key"] == matrix["to_key"]), "left").withColumn("need", F.coalesce("seconds", F.lit(default_s))).filter("need > 0")
    spans = j.select("machine_id", (F.col("start_s") - F.col("need")).alias("at"), F.lit(1).alias("kind"), "operation_id", "end_s")
    none = F.lit(None).cast("long")
    held = merge(windows, "machine_id", "start_s", "end_s").select("machine_id", F.col("start_s").alias("at"), F.lit(0).alias("kind"), none.alias("operation_id"), "end_s")
    both = spans.unionByName(held)
    scan = W.partitionBy("machine_id").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, 0)
    closes = F.last(F.when(F.col("kind") == 0, F.col("end_s")), ignorenulls=True).over(scan)
    both = both.withColumns({"closes": closes, "has": F.min("kind").over(W.partitionBy("machine_id")) == 0}).filter("kind = 1")
    state = F.when(~F.col("has"), "NO_CALENDAR").when(F.col("closes") >= F.col("end_s"), "FITS").when(F.col("closes") > F.col("at"), "CROSSES").otherwise("OUTSIDE")
    return both.select("machine_id", "operation_id", F.col("at").alias("span_s"), "end_s", state.alias("state"))


def completeness(required: DataFrame, assigned: DataFrame, key: str) -> DataFrame:
    """Violations of a one-to-one assignment: DUPLICATE, UNKNOWN, MISSING."""
    r, a = required.select(key).distinct().withColumn("_r", F.lit(1)), assigned.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col("n").isNull(), "MISSING").when(F.col("_r").isNull(), "UNKNOWN").when(F.col("n") > 1, "DUPLICATE")
    return r.join(a, key, "full").select(key, kind.alias("violation")).filter("violation IS NOT NULL")

def seconds(ts: Column, origin: Column) -> Column:
    return F.timestamp_diff("SECOND", origin, ts)
