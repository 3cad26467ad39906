"""The whole audit of a schedule against what was asked for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .intervals import merge

c = F.col


def violations(required: DataFrame, assigned: DataFrame, eligible: DataFrame, machines: DataFrame, precedence: DataFrame, windows: DataFrame | None, matrix: DataFrame, default_s: int, makespan_s: int | None = None) -> DataFrame:
    """(check_id, operation_id, machine_id): every broken check of every assignment, not only the first.

    required (operation_id, duration_s); assigned (operation_id, machine_id, start_s, end_s, setup_key); eligible (operation_id, machine_id);
    machines (machine_id); precedence (operation_id, predecessor); windows (machine_id, start_s, end_s) or None without calendars;
    matrix (from_key, to_key, seconds) of setup changes, each other pair taking default_s.

    MISSING, UNKNOWN, DUPLICATE (each copy); UNKNOWN_MACHINE; INELIGIBLE (of known operations and machines); NOT_TIMED (no start or no end:
    no check of times follows, and it takes no place on its machine); NEGATIVE_START; END_BEFORE_START; WRONG_DURATION; OVERLAP with any earlier assignment of the machine;
    OUTSIDE_WINDOW (in no single merged window; a machine without windows has none); SETUP_TOO_SHORT after the assignment just before;
    PRECEDENCE (ends of all copies of a predecessor against each start); MAKESPAN (the reported one isn't the latest end; ids are NULL).
    An id that is NULL is unknown. Machines' timelines and windows are read in one sorted scan.
    """
    asked = required.groupBy("operation_id").agg(F.max("duration_s").alias("duration_s")).withColumn("asked", F.lit(True))
    may = eligible.select("operation_id", "machine_id").distinct().withColumn("may", F.lit(True))
    exists = machines.select("machine_id").distinct().withColumn("exists", F.lit(True))
    a = assigned.select("operation_id", "machine_id", "start_s", "end_s", "setup_key").withColumn("copies", F.count(F.lit(1)).over(W.partitionBy("operation_id")))
    a = a.join(asked, "operation_id", "left").join(may, ["operation_id", "machine_id"], "left").join(exists, "machine_id", "left").withColumn("kind", F.lit(1))
    line = a
    if windows is not None:
        line = a.unionByName(merge(windows, "machine_id", "start_s", "end_s").select("machine_id", "start_s", "end_s", F.lit(0).alias("kind")), allowMissingColumns=True)
    own = W.partitionBy("machine_id", F.when(c("machine_id").isNull(), c("operation_id"))).orderBy("start_s", "kind", "operation_id", "end_s", "setup_key")
    past, job, timed = own.rowsBetween(W.unboundedPreceding, -1), c("kind") == 1, c("start_s").isNotNull() & c("end_s").isNotNull()
    before = F.last(F.when(job & timed, F.struct("end_s", "setup_key")), ignorenulls=True).over(past)
    line = line.withColumns({"reach": F.max(F.when(job & timed, c("end_s"))).over(past), "before": before, "closes": F.last(F.when(~job, c("end_s")), ignorenulls=True).over(past)}).filter(job)
    line = line.join(matrix.select(c("from_key").alias("_f"), c("to_key").alias("_t"), "seconds"), (c("before.setup_key") == c("_f")) & (c("setup_key") == c("_t")), "left")
    gap = c("start_s") - c("before.end_s")
    known = c("asked").isNotNull() & c("exists").isNotNull()
    cases = {
        "DUPLICATE": c("copies") > 1, "UNKNOWN": c("asked").isNull(), "UNKNOWN_MACHINE": c("exists").isNull(), "INELIGIBLE": known & c("may").isNull(), "NOT_TIMED": ~timed,
        "NEGATIVE_START": timed & (c("start_s") < 0), "END_BEFORE_START": c("end_s") <= c("start_s"), "WRONG_DURATION": (c("end_s") > c("start_s")) & (c("end_s") - c("start_s") != c("duration_s")),
        "OVERLAP": timed & (c("reach") > c("start_s")), "SETUP_TOO_SHORT": timed & (gap >= 0) & (gap < F.coalesce(c("seconds"), F.lit(default_s))),
    }
    if windows is not None:
        cases["OUTSIDE_WINDOW"] = timed & F.coalesce(c("closes") < c("end_s"), F.lit(True))
    hits = F.explode(F.array_compact(F.array(*[F.when(on, F.lit(k)) for k, on in cases.items()])))
    out = [line.select(hits.alias("check_id"), "operation_id", "machine_id")]
    none = F.lit(None).cast("long")
    out.append(asked.join(assigned.select("operation_id"), "operation_id", "left_anti").select(F.lit("MISSING").alias("check_id"), "operation_id", none.alias("machine_id")))
    ends = assigned.groupBy(c("operation_id").alias("predecessor")).agg(F.max("end_s").alias("done_s"))
    late = precedence.select("operation_id", "predecessor").distinct().join(ends, "predecessor").join(assigned.select("operation_id", "machine_id", "start_s"), "operation_id").filter("done_s > start_s")
    out.append(late.select(F.lit("PRECEDENCE").alias("check_id"), "operation_id", "machine_id"))
    if makespan_s is not None:
        out.append(assigned.agg(F.max("end_s").alias("latest")).filter(c("latest") != makespan_s).select(F.lit("MAKESPAN").alias("check_id"), none.alias("operation_id"), none.alias("machine_id")))
    return reduce(DataFrame.unionByName, out)
