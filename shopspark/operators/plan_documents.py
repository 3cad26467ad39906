"""Manufacturing plan documents: a header per plan, and its sections as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import compat, costing
from . import records as rec
from .catalog import items
from .spread import spread

c = F.col

#: Reactions of a control plan to a characteristic out of limits; others are measured again.
REACTION = {"KEY_CHARACTERISTIC": "STOP_AND_REVIEW", "CRITICAL": "SEGREGATE"}
#: Shares that a plan's completeness is the mean of, with their value where a plan has no operations.
SHARES = {"machine": 0.0, "tool": 0.0, "holder": 1.0, "parameter": 0.0, "cycle_time": 0.0, "inspection": 0.0}


def control_plan(chars: DataFrame) -> DataFrame:
    """chars (level, ...) with operation_name, reaction_plan and responsibility: one row each, checked at the end."""
    reaction = F.coalesce(*[F.when(c("level") == k, F.lit(v)) for k, v in REACTION.items()], F.lit("REMEASURE"))
    who = F.when(c("level").isin(*REACTION), "QC").otherwise("OPERATOR")
    return chars.withColumns({"operation_name": F.lit("FINAL"), "reaction_plan": reaction, "responsibility": who})


def operations(steps: DataFrame, order: list[str]) -> DataFrame:
    """steps with setup (1 where setup_number is NULL), op_number (10, 20, ... in the given order) and operation_type (UNKNOWN where NULL)."""
    n = F.row_number().over(W.partitionBy("plan_id").orderBy(*order))
    return steps.withColumns({"setup": F.coalesce(c("setup_number"), F.lit(1)).cast("long"), "op_number": (n * 10).cast("long"), "operation_type": F.coalesce(c("operation"), F.lit("UNKNOWN"))})


def setups(ops: DataFrame) -> DataFrame:
    """(plan_id, setup, machine_id, n_machines, n_tools, n_operations): the smallest machine of a setup stands for it, n_machines tells of others."""
    return ops.groupBy("plan_id", "setup").agg(F.min("machine_id").alias("machine_id"), F.count_distinct("machine_id").alias("n_machines"), F.count_distinct("tool_id").alias("n_tools"), F.count(F.lit(1)).alias("n_operations"))


def parameters(ops: DataFrame) -> DataFrame:
    """(plan_id, op_number, operation_type, vc, feed_rate, source) of the operations that have a speed or a feed other than zero."""
    own = ops.filter((F.coalesce(c("vc"), F.lit(0)) != 0) | (F.coalesce(c("feed_rate"), F.lit(0)) != 0))
    return own.select("plan_id", "op_number", "operation_type", "vc", "feed_rate", F.coalesce(c("parameter_source"), F.lit("INSUFFICIENT_DATA")).alias("source"))


def flow(ops: DataFrame) -> DataFrame:
    """(plan_id, src, dst, node_type) edges of RAW_MATERIAL, each setup followed by its operations, OUTPUT; node_type is that of dst."""
    kind = F.when(F.upper("operation_type").contains("INSPECT"), "INSPECTION").otherwise("OPERATION")
    s = ops.select("plan_id", "setup", F.lit(0).cast("long").alias("op_number"), F.concat(F.lit("S"), c("setup").cast("string")).alias("node"), F.lit("SETUP").alias("node_type")).distinct()
    o = ops.select("plan_id", "setup", "op_number", F.concat(F.lit("OP"), c("op_number").cast("string")).alias("node"), kind.alias("node_type"))
    w = W.partitionBy("plan_id").orderBy("setup", "op_number")
    n = s.unionByName(o).withColumns({"src": F.coalesce(F.lag("node").over(w), F.lit("RAW_MATERIAL")), "last": F.lead("node").over(w).isNull()})
    edge = lambda src, dst, kind: F.struct(src.alias("src"), dst.alias("dst"), kind.alias("node_type"))
    into = edge(c("src"), c("node"), c("node_type"))
    edges = F.when(c("last"), F.array(into, edge(c("node"), F.lit("OUTPUT"), F.lit("OUTPUT")))).otherwise(F.array(into))
    return n.select("plan_id", F.explode(edges).alias("e")).select("plan_id", "e.*")


def content(*parts: Column) -> Column:
    """A row's share of an order-free fingerprint: 32 bits of its digest; NULL parts count as empty."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def header(ops: DataFrame, chars: DataFrame, critical: DataFrame, covered: DataFrame) -> DataFrame:
    """One row per plan that has operations or characteristics: counts of the sections, completeness, gate, warning, fingerprint; always a DRAFT.

    ops: from ``operations``, with a column content; chars (plan_id, content); critical (plan_id, characteristic_id, feature_id);
    covered (plan_id, characteristic_id). A plan without characteristics has no share of requirements and a warning. Failure hooks are
    counted, not made: those of a step's feature by an equi join of counts, those of the whole plan by a product of counts.
    """
    has = lambda x: F.coalesce(c(x), F.lit(0)) != 0
    # the first row of each id is counted, as several counts of distinct values would shuffle every row several times
    ids = {"setup": "n_setups", "tool_id": "n_tools", "machine_id": "n_machines"}
    rows = ops.select("plan_id", *ids, (has("vc") | has("feed_rate")).alias("_given"), "content")
    rows = spread(rows, "plan_id")
    for x, n in ids.items():
        rows = rows.withColumn(n, c(x).isNotNull() & (F.row_number().over(W.partitionBy("plan_id", x).orderBy(x)) == 1))
    o = rows.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n_operations"), *[F.count_if(n).alias(n) for n in ids.values()], F.count_if("_given").alias("n_parameters"), F.sum("content").alias("route"))
    ch = chars.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n_characteristics"), F.sum("content").alias("requirements"))
    crit = critical.groupBy("plan_id", "feature_id").agg(F.count(F.lit(1)).alias("k"))
    own = ops.groupBy("plan_id", "feature_id").agg(F.count(F.lit(1)).alias("m")).join(crit, ["plan_id", "feature_id"]).groupBy("plan_id").agg(F.sum(c("k") * c("m")).alias("own"))
    whole = crit.filter("feature_id IS NULL").select("plan_id", c("k").alias("whole"))
    items = rec.open_items(ops, rec.uninspected(critical, covered)).groupBy("plan_id").agg(F.count_if(c("severity") == "BLOCKING").alias("blocking"), F.count_if(c("severity") == "REVIEW_REQUIRED").alias("review"), F.count_if(c("severity") == "ADVISORY").alias("advisory"))
    d = o.join(ch, "plan_id", "full")
    for more in (rec.completeness(ops).select("plan_id", *SHARES), own, whole, items):
        d = d.join(more, "plan_id", "left")
    counts = ["n_operations", "n_setups", "n_tools", "n_machines", "n_parameters", "n_characteristics", "own", "whole", "blocking", "review", "advisory", "route", "requirements"]
    d = d.na.fill(0, counts).na.fill(SHARES)
    shares = sum((c(k) for k in SHARES), F.lit(0.0)) + F.when(c("n_characteristics") > 0, 1.0).otherwise(0.0)
    d = d.withColumn("completeness", shares / (len(SHARES) + 1)).withColumn("band", rec.band(c("completeness")))
    print_ = F.substring(F.sha2(F.concat_ws("|", c("plan_id").cast("string"), c("route").cast("string"), c("requirements").cast("string")), 256), 1, 16)
    flows = F.when(c("n_operations") > 0, c("n_operations") + c("n_setups") + 1).otherwise(0)
    return d.select(
        "plan_id", F.lit("DRAFT").alias("status"), "n_setups", "n_operations", "n_tools", "n_machines", "n_parameters", "n_characteristics", flows.cast("long").alias("n_flow_edges"),
        (c("own") + c("whole") * c("n_operations")).alias("n_hooks"), "blocking", "review", "advisory", "completeness", "band", rec.gate(c("blocking"), c("review"), c("band"), c("completeness")).alias("gate"),
        F.when(c("n_characteristics") == 0, "NO_CHARACTERISTICS").alias("warning"), print_.alias("fingerprint"),
    )


#: Operations and material groups that a process plan knows.
PROCESSES = ["milling", "turning", "drilling", "boring", "reaming", "tapping"]
GROUPS = ["P", "M", "K", "N", "S", "H"]


def step_plans(steps: DataFrame, machines: DataFrame, tools: DataFrame, holders: DataFrame, references: DataFrame) -> DataFrame:
    """steps with state, reasons and n_references: how far each step (plan_id, operation, iso_group, machine_id, tool_id, holder_id, vc) is planned.

    Ids are unique in each catalog. NOT_SUPPORTED: an operation that isn't known. INSUFFICIENT_DATA: no known material group, a resource
    that is missing or in no catalog, a machine or tool that doesn't do the operation, or a rule that can't be told. BLOCKED: a rule of
    compatibility fails at the step's speed (from vc and the tool's diameter). Else PLANNED. A step that leaves a resource open isn't
    searched for one here; see compat.fitting. reasons are codes; NO_REFERENCE beside them where no reference covers the step's scope.
    """
    s = steps.withColumn("_op", F.lower("operation"))
    m = machines.select("machine_id", c("max_rpm").alias("m_rpm"), F.array_sort(compat.interfaces(c("spindle_interface"), c("more_interfaces"))).alias("own"), "max_tool_d", "max_tool_len", items(c("processes")).alias("_mo"))
    t = tools.select("tool_id", c("max_rpm").alias("t_rpm"), "d_mm", "length_mm", "shank_mm", "insert_shape", items(c("iso_groups")).alias("groups"), items(c("operations")).alias("_to"))
    h = holders.select("holder_id", c("max_rpm").alias("h_rpm"), "machine_interface", "tool_interface", "clamp_min", "clamp_max")
    scopes = costing.feed_ranges(s.select(c("_op").alias("operation"), "iso_group"), references).select(c("operation").alias("_so"), c("iso_group").alias("_si"), c("n").alias("n_references"))
    # tool and holder are judged before the rows move on to their machines
    d = s.join(t, "tool_id", "left").join(compat.bounded(h), "holder_id", "left").join(compat.bounded(scopes), c("_op").eqNullSafe(c("_so")) & c("iso_group").eqNullSafe(c("_si")), "left")
    d = d.withColumn("_rpm", F.try_divide(c("vc") * 1000, F.pi() * c("d_mm")))
    d = d.withColumns({"_held": compat.worst(*compat.held_rules(c("iso_group"), c("_rpm"))), "_known": c("_to").isNotNull() & c("tool_interface").isNotNull(), "_does": F.array_contains("_to", c("_op"))})
    d = d.select(*steps.columns, "_op", "n_references", "_rpm", "_held", "_known", "_does", "machine_interface", "length_mm", "d_mm").join(m, "machine_id", "left")
    d = d.withColumn("verdict", compat.said(F.greatest("_held", compat.worst(*compat.machine_rules(c("_rpm"))))))
    supported, grouped = F.coalesce(c("_op").isin(PROCESSES), F.lit(False)), F.coalesce(c("iso_group").isin(GROUPS), F.lit(False))
    found = c("_mo").isNotNull() & c("_known")
    able = found & F.array_contains("_mo", c("_op")) & c("_does")
    cases = [
        ("NOT_SUPPORTED", ~supported), ("MATERIAL_GROUP", supported & ~grouped), ("RESOURCE_UNKNOWN", supported & grouped & ~found), ("NO_CANDIDATE", supported & grouped & found & ~able),
        ("INCOMPATIBLE", supported & grouped & able & (c("verdict") == "INCOMPATIBLE")), ("COMPATIBILITY_UNKNOWN", supported & grouped & able & (c("verdict") == "INSUFFICIENT_DATA")),
        ("NO_REFERENCE", supported & grouped & (c("n_references") == 0)),
    ]
    reasons = F.array_compact(F.array(*[F.when(on, F.lit(k)) for k, on in cases]))
    state = F.when(~supported, "NOT_SUPPORTED").when(~grouped | ~able, "INSUFFICIENT_DATA").when(c("verdict") == "COMPATIBLE", "PLANNED").when(c("verdict") == "INCOMPATIBLE", "BLOCKED").otherwise("INSUFFICIENT_DATA")
    return d.withColumns({"state": state, "reasons": reasons}).select(*steps.columns, "state", "reasons", "n_references")


def process_plans(planned: DataFrame, dependencies: DataFrame) -> DataFrame:
    """One row per plan of ``step_plans``: steps by state, what planned steps use, reasons, seconds of cutting, dependency faults, plan_status.

    dependencies (plan_id, step_id): one row per fault of ids, order or predecessors. COMPLETE: all steps planned; PARTIAL: some; BLOCKED:
    none, and some blocked; else INSUFFICIENT_DATA. A cutting time needs a path and a feed above zero.
    """
    on = c("state") == "PLANNED"
    n = lambda k: F.count_if(c("state") == k)
    time = F.when(c("feed_rate") > 0, c("path_mm") * 60 / c("feed_rate"))
    used = {f"n_{k}s": F.count_distinct(F.when(on, c(f"{k}_id"))) for k in ("machine", "holder", "tool")}
    d = planned.groupBy("plan_id").agg(
        F.count(F.lit(1)).alias("n_steps"), n("PLANNED").alias("n_planned"), n("BLOCKED").alias("n_blocked"), n("INSUFFICIENT_DATA").alias("n_insufficient"), n("NOT_SUPPORTED").alias("n_not_supported"),
        *[v.alias(k) for k, v in used.items()], F.count(time).alias("n_timed"), F.sum(time).alias("cutting_s"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("reasons")))), ",").alias("reasons"),
    )
    faults = dependencies.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n_faults"))
    status = F.when(c("n_planned") == c("n_steps"), "COMPLETE").when(c("n_planned") > 0, "PARTIAL").when(c("n_blocked") > 0, "BLOCKED").otherwise("INSUFFICIENT_DATA")
    return d.join(faults, "plan_id", "left").na.fill(0, ["n_faults"]).withColumns({"plan_status": status, "dependencies_ok": c("n_faults") == 0})
