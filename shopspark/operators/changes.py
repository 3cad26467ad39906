"""Differences of two revisions of NC programs: segments, findings, coverage, commands, times, configuration; and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col


def _both(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Full outer join with structs a and b; a side without the key is NULL."""
    of = lambda d, n: d.select(*key, F.struct(*[x for x in d.columns if x not in key]).alias(n))
    return of(a, "a").join(of(b, "b"), key, "full")


def _differs(*names: str) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | ~c(f"a.{n}").eqNullSafe(c(f"b.{n}"))
    return out


def segment_changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """(program_id, segment, change, tool_changed, feed_delta, rapid_delta): segments (program_id, segment, tool, feed_mm, rapid_mm, min_feed, max_feed).

    Where the number of tool changes differs, segments of one number may be others: MATCH_UNCERTAIN.
    """
    n = lambda d, k: d.groupBy("program_id").agg(F.max("segment").alias(k))
    changed = n(a, "_x").join(n(b, "_y"), "program_id", "full").select("program_id", (~c("_x").eqNullSafe(c("_y"))).alias("uncertain"))
    d = _both(a, b, ["program_id", "segment"]).join(changed, "program_id")
    delta = lambda k: F.round(F.coalesce(c(f"b.{k}"), F.lit(0.0)) - F.coalesce(c(f"a.{k}"), F.lit(0.0)), 4) + 0.0
    modified = _differs("tool", "min_feed", "max_feed") | (F.abs(delta("feed_mm")) > 0) | (F.abs(delta("rapid_mm")) > 0)
    change = F.when(c("a").isNull(), "ADDED").when(c("b").isNull(), "REMOVED").when(c("uncertain"), "MATCH_UNCERTAIN").when(modified, "MODIFIED").otherwise("UNCHANGED")
    two = c("a").isNotNull() & c("b").isNotNull()
    return d.select("program_id", "segment", change.alias("change"), F.when(two, _differs("tool")).alias("tool_changed"), F.when(two, delta("feed_mm")).alias("feed_delta"), F.when(two, delta("rapid_mm")).alias("rapid_delta"))


def finding_changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """(program_id, code, change, severity): findings (program_id, code, severity, observed, lim, source); the first difference of severity, value, limit, source."""
    d = _both(a, b, ["program_id", "code"])
    change = F.when(c("a").isNull(), "FINDING_ADDED").when(c("b").isNull(), "FINDING_RESOLVED")
    for name, says in (("severity", "SEVERITY"), ("observed", "VALUE"), ("lim", "LIMIT"), ("source", "SOURCE")):
        change = change.when(_differs(name), f"FINDING_{says}_CHANGED")
    return d.select("program_id", "code", change.otherwise("FINDING_UNCHANGED").alias("change"), c("b.severity").alias("severity"))


def coverage_changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """(program_id, feature, change, state): coverage (program_id, feature, detected, state)."""
    d = _both(a, b, ["program_id", "feature"])
    was, now = F.coalesce("a.detected", F.lit(False)), F.coalesce("b.detected", F.lit(False))
    change = F.when(now & ~was, "FEATURE_NEWLY_DETECTED").when(was & ~now, "FEATURE_NO_LONGER_DETECTED").when(_differs("state"), "FEATURE_STATE_CHANGED").otherwise("FEATURE_UNCHANGED")
    return d.select("program_id", "feature", change.alias("change"), c("b.state").alias("state"))


def field_changes(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, was, now, changed) per field of two records; NULLs are equal."""
    d = a.select(key, F.struct(*fields).alias("a")).join(b.select(key, F.struct(*fields).alias("b")), key)
    text = lambda s, f: c(f"{s}.{f}").cast("string")
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), text("a", f).alias("was"), text("b", f).alias("now"), _differs(f).alias("changed")) for f in fields])).alias("r")
    return d.select(key, rows).select(key, "r.*")


def time_change(a: DataFrame, b: DataFrame) -> DataFrame:
    """(program_id, was_s, now_s, delta_s, comparable) of known subtotals; a delta only where both are known."""
    d = a.select("program_id", c("known_s").alias("was_s")).join(b.select("program_id", c("known_s").alias("now_s")), "program_id")
    both = c("was_s").isNotNull() & c("now_s").isNotNull()
    return d.withColumns({"delta_s": F.when(both, F.round(c("now_s") - c("was_s"), 6)), "comparable": both})


def comparability(schema_a: Column, schema_b: Column, profile_a: Column, profile_b: Column, inch_a: Column, inch_b: Column, traced: Column) -> Column:
    """NOT_COMPARABLE for another major schema, profile or unit; PARTIALLY_COMPARABLE for another minor schema or lost traces; else COMPARABLE."""
    major = lambda x: F.split_part(x, F.lit("."), F.lit(1))
    never = (major(schema_a) != major(schema_b)) | (profile_a != profile_b) | (inch_a != inch_b)
    return F.when(F.coalesce(never, F.lit(False)), "NOT_COMPARABLE").when(~F.coalesce(traced, F.lit(False)) | (schema_a != schema_b), "PARTIALLY_COMPARABLE").otherwise("COMPARABLE")


def summary(programs: DataFrame, lines: DataFrame, findings: DataFrame, coverage: DataFrame, config: DataFrame) -> DataFrame:
    """One row per program of both revisions: counts of changes, program and configuration status, severity, re_review and its reasons.

    lines: program_id, added, removed; findings, coverage and config as above. Each table is aggregated before it is joined.
    """
    n = lambda v: F.count_if(c("change") == v)
    blocking = F.count_if((c("change") == "FINDING_ADDED") & (c("severity") == "BLOCKING") | (c("change") == "FINDING_SEVERITY_CHANGED") & (c("severity") == "BLOCKING"))
    f = findings.groupBy("program_id").agg(n("FINDING_ADDED").alias("findings_added"), n("FINDING_RESOLVED").alias("findings_resolved"), blocking.alias("new_blocking"))
    v = coverage.groupBy("program_id").agg(F.count_if((c("change") == "FEATURE_NEWLY_DETECTED") & (c("state") == "UNSUPPORTED")).alias("new_unsupported"))
    k = config.groupBy("program_id").agg(F.count_if("changed").alias("fields_changed"))
    d = programs.select("program_id").distinct()
    for part in (lines, f, v, k):
        d = d.join(part, "program_id", "left")
    d = d.na.fill(0)
    program, conf = (c("added") + c("removed")) > 0, c("fields_changed") > 0
    status = F.when(program & conf, "PROGRAM_AND_CONFIGURATION_CHANGED").when(program, "PROGRAM_CHANGED").when(conf, "CONFIGURATION_CHANGED").otherwise("UNCHANGED")
    severity = F.when(c("new_blocking") > 0, "CRITICAL_REVIEW_REQUIRED").when(conf, "MAJOR_REVIEW_REQUIRED").when(program, "MINOR_CHANGE").otherwise("NO_CHANGE")
    reasons = F.array_compact(F.array(*[F.when(on, F.lit(r)) for r, on in (("NEW_BLOCKING_FINDING", c("new_blocking") > 0), ("NEW_UNSUPPORTED_FEATURE", c("new_unsupported") > 0), ("NC_PROGRAM_CHANGED", program), ("CONFIGURATION_CHANGED", conf))]))
    return d.withColumns({"status": status, "severity": severity, "reasons": F.array_join(reasons, ",")}).withColumn("re_review", c("reasons") != "")
