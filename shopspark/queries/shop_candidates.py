"""Capability, candidates with scores, precedence, parameter variants, setups."""

from pyspark.sql import functions as F

from ..operators import candidates as ca
from ..operators import graph
from .registry import query

c = F.col


def _values(rows):
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + ")"


_CAP = f"cp AS (SELECT * FROM {_values(ca.CAPABILITY)} t(feature_type, operation, best_ra))"


@query("feature_operations", f"WITH {_CAP} SELECT part_id, feature_id, operation, best_ra, coalesce(best_ra <= depth_mm / 20, false) AS achieves FROM v_feature LEFT JOIN cp USING (feature_type)")
def feature_operations(shop):
    """Operations able to make a feature, and whether they reach the asked roughness; an unknown capability doesn't."""
    j = shop.v_feature.select("part_id", "feature_id", "feature_type", (c("depth_mm") / 20).alias("ra")).join(F.broadcast(ca.capability(shop.spark)), "feature_type", "left")
    return j.select("part_id", "feature_id", "operation", "best_ra", F.coalesce(c("best_ra") <= c("ra"), F.lit(False)).alias("achieves"))


_TEMPLATES = [("HOLE", "R0", "drilling", 3.2), ("HOLE", "R1", "drilling;reaming", 0.4), ("HOLE", "R2", "drilling;boring;honing", 0.1), ("POCKET", "R0", "milling", 0.8), ("SLOT", "R0", "milling", 0.8), ("SLOT", "R1", "milling;grinding", 0.2)]


@query("generated_routes", f"WITH tp AS (SELECT * FROM {_values(_TEMPLATES)} t(feature_type, route, operations, best_ra)), f AS (SELECT part_id, feature_id, feature_type, CASE WHEN feature_id % 3 = 0 THEN NULL ELSE depth_mm / 40 END AS ra FROM v_feature) SELECT part_id, feature_id, route, operations, CASE WHEN route IS NULL THEN 'FEATURE_UNSUPPORTED' WHEN ra IS NOT NULL AND best_ra > ra THEN 'CAPABILITY_GAP' ELSE 'ACCEPTED' END AS outcome FROM f LEFT JOIN tp USING (feature_type)")
def generated_routes(shop):
    """Template routes of each feature against its roughness."""
    t = shop.spark.createDataFrame(_TEMPLATES, "feature_type string, route string, operations string, best_ra double")
    f = shop.v_feature.select("part_id", "feature_id", "feature_type", F.when(c("feature_id") % 3 != 0, c("depth_mm") / 40).alias("ra_um"))
    return ca.routes_for(f, t).select("part_id", "feature_id", "route", "operations", "outcome")


def _fit_sql(op, mt):
    return "CASE " + " ".join(f"WHEN {op} = '{o}' THEN {mt} IN ({', '.join(repr(t) for t in ts)})" for o, ts in ca.MACHINES_OF.items()) + " ELSE false END"


@query("machine_candidates", f"""WITH m AS (SELECT machine_id, machine_type, 3 + machine_id % 3 AS axes, unnest(string_split(processes, ';')) AS operation FROM v_machine), s AS (SELECT operation, machine_id, 50 + CASE WHEN {_fit_sql('operation', 'machine_type')} THEN 30 ELSE 0 END + CASE WHEN axes >= 5 AND operation IN ('milling', 'boring') THEN 10 WHEN axes >= 4 THEN 5 ELSE 0 END AS score FROM m WHERE operation IN (SELECT operation FROM v_step)),
  r AS (SELECT *, row_number() OVER (PARTITION BY operation ORDER BY score DESC, machine_id) AS rank FROM s) SELECT * FROM r WHERE rank <= 3""")
def machine_candidates(shop):
    """The best three machines of each operation."""
    return ca.operation_machines(shop.v_step, shop.v_machine.withColumn("axes", c("machine_id") % 3 + 3))


@query("tool_candidates", """WITH w AS (SELECT DISTINCT operation, iso_group FROM v_step WHERE iso_group IS NOT NULL), t AS (SELECT tool_id, d_mm, string_split(iso_groups, ';') AS gs, unnest(string_split(operations, ';')) AS operation FROM v_tool),
  s AS (SELECT w.operation, w.iso_group, tool_id, 50 + CASE WHEN abs(d_mm - 12) <= 0.1 THEN 30 WHEN abs(d_mm - 12) <= 1 THEN 20 WHEN abs(d_mm - 12) <= 3 THEN 10 ELSE 0 END + CASE WHEN list_contains(gs, w.iso_group) THEN 20 ELSE 0 END AS score FROM w JOIN t USING (operation)),
  r AS (SELECT *, row_number() OVER (PARTITION BY operation, iso_group ORDER BY score DESC, tool_id) AS rank FROM s) SELECT * FROM r WHERE rank <= 3""")
def tool_candidates(shop):
    """The best three tools of each operation and material for a 12 mm feature."""
    from ..operators.catalog import items
    from ..operators.spread import spread

    want = shop.v_step.filter("iso_group IS NOT NULL").select("operation", "iso_group").distinct()
    tools = spread(shop.v_tool.select("tool_id", "d_mm", "iso_groups", "operations"), "tool_id")  # a task sorts several candidates of each; wants are few
    t = tools.select("tool_id", "d_mm", items(c("iso_groups")).alias("gs"), F.explode(items(c("operations"))).alias("operation"))
    s = t.join(F.broadcast(want), "operation").select("operation", "iso_group", "tool_id", ca.tool_score(c("d_mm"), F.lit(12.0), c("gs"), c("iso_group")).alias("score"))
    return ca.best(s, ["operation", "iso_group"], "tool_id", 3)


@query("holder_candidates", """WITH i AS (SELECT machine_id, spindle_interface AS face, max_rpm AS need FROM v_machine WHERE spindle_interface IS NOT NULL), s AS (SELECT machine_id, holder_id, 50 + CASE WHEN h.max_rpm >= need THEN 30 WHEN h.max_rpm < need THEN -20 ELSE 0 END AS score FROM i JOIN v_holder h ON h.machine_interface = face),
  r AS (SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY score DESC, holder_id) AS rank FROM s) SELECT * FROM r WHERE rank <= 2""")
def holder_candidates(shop):
    m = shop.v_machine.select("machine_id", c("spindle_interface").alias("machine_interface"), c("max_rpm").alias("need"))
    j = m.join(shop.v_holder.select("holder_id", "machine_interface", "max_rpm"), "machine_interface")
    return ca.best(j.select("machine_id", "holder_id", ca.holder_score(c("max_rpm"), c("need")).alias("score")), ["machine_id"], "holder_id", 2)


_OPS = "op AS (SELECT DISTINCT plan_id, step_id, step_id % 2 AS feature_id, CASE step_id % 7 WHEN 1 THEN 'drilling' WHEN 2 THEN 'facing' WHEN 3 THEN 'boring' WHEN 4 THEN 'honing' WHEN 5 THEN 'reaming' WHEN 6 THEN 'milling' ELSE 'grinding' END AS operation FROM v_planstep)"
_PREC = f"pe AS (SELECT DISTINCT a.plan_id, a.feature_id, a.step_id AS src, b.step_id AS dst, kind FROM op a JOIN {_values(ca.PRECEDENCE)} r(before, after, kind) ON r.before = a.operation JOIN op b ON b.plan_id = a.plan_id AND b.feature_id = a.feature_id AND b.operation = r.after AND b.step_id <> a.step_id)"


def _ops(shop):
    name = F.coalesce(*[F.when(c("step_id") % 7 == i, F.lit(n)) for i, n in ((1, "drilling"), (2, "facing"), (3, "boring"), (4, "honing"), (5, "reaming"), (6, "milling"))], F.lit("grinding"))
    return shop.v_planstep.select("plan_id", "step_id", (c("step_id") % 2).alias("feature_id"), name.alias("operation")).distinct()


@query("precedence_edges", f"WITH {_OPS}, {_PREC} SELECT * FROM pe")
def precedence_edges(shop):
    return ca.precedence_edges(_ops(shop))


@query("blocking_violations", f"WITH {_OPS}, {_PREC} SELECT plan_id, feature_id, src, dst FROM pe WHERE kind = 'BLOCKING' AND src % 3 * 10 + src > dst % 3 * 10 + dst")
def blocking_violations(shop):
    """Blocking edges that an order turns round."""
    ops = _ops(shop)
    return ca.violated(ca.precedence_edges(ops), ops.select("plan_id", "step_id", (c("step_id") % 3 * 10 + c("step_id")).alias("position")))


@query("independent_pairs", f"""WITH RECURSIVE {_OPS}, {_PREC}, t AS (SELECT plan_id, src, dst FROM pe UNION SELECT t.plan_id, t.src, pe.dst FROM t JOIN pe ON pe.plan_id = t.plan_id AND pe.src = t.dst)
  SELECT a.plan_id, a.step_id AS a, b.step_id AS b FROM op a JOIN op b ON a.plan_id = b.plan_id AND a.feature_id = b.feature_id AND a.step_id < b.step_id WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.plan_id = a.plan_id AND ((t.src = a.step_id AND t.dst = b.step_id) OR (t.src = b.step_id AND t.dst = a.step_id)))""")
def independent_pairs(shop):
    """Steps of one feature of a plan that no path orders."""
    ops = _ops(shop)
    return graph.independent(ops, ca.precedence_edges(ops))


@query("topological_order", f"WITH RECURSIVE {_OPS}, {_PREC}, d AS (SELECT plan_id, step_id, 0 AS l FROM op UNION SELECT d.plan_id, pe.dst, l + 1 FROM d JOIN pe ON pe.plan_id = d.plan_id AND pe.src = d.step_id), v AS (SELECT plan_id, step_id, max(l) AS level FROM d GROUP BY plan_id, step_id) SELECT plan_id, step_id, level, row_number() OVER (PARTITION BY plan_id ORDER BY level, step_id) AS position FROM v")
def topological_order(shop):
    """By the longest path to a step, then by id."""
    ops = _ops(shop)
    return graph.topological(ca.precedence_edges(ops), ops.select("plan_id", c("step_id").alias("node"))).select("plan_id", c("node").alias("step_id"), "level", "position")


@query("parameter_variants", """WITH sc AS (SELECT DISTINCT operation, iso_group FROM v_step), j AS (SELECT sc.operation, sc.iso_group, parameter_type, record_id, min_value, max_value, row_number() OVER (PARTITION BY sc.operation, sc.iso_group, parameter_type ORDER BY record_id) AS n FROM sc JOIN v_ref r ON (r.operation IS NULL OR r.operation = sc.operation) AND (r.iso_group IS NULL OR sc.iso_group IS NULL OR r.iso_group = sc.iso_group)),
  g AS (SELECT operation, iso_group, max(min_value) FILTER (WHERE parameter_type = 'cutting_speed') AS vl, max(max_value) FILTER (WHERE parameter_type = 'cutting_speed') AS vh, max(min_value) FILTER (WHERE parameter_type = 'feed_per_tooth') AS fl, max(max_value) FILTER (WHERE parameter_type = 'feed_per_tooth') AS fh, max(min_value) FILTER (WHERE parameter_type = 'depth_of_cut') AS al, max(max_value) FILTER (WHERE parameter_type = 'depth_of_cut') AS ah FROM j WHERE n = 1 GROUP BY operation, iso_group)
  SELECT operation, iso_group, variant, CASE variant WHEN 'CONSERVATIVE' THEN vl WHEN 'BALANCED' THEN (vl + vh) / 2 ELSE vh END AS vc, CASE variant WHEN 'CONSERVATIVE' THEN fl WHEN 'BALANCED' THEN (fl + fh) / 2 ELSE fh END AS fz, CASE variant WHEN 'CONSERVATIVE' THEN al WHEN 'BALANCED' THEN (al + ah) / 2 ELSE ah END AS ap
  FROM g CROSS JOIN (VALUES ('CONSERVATIVE'), ('BALANCED'), ('PRODUCTIVITY')) v(variant) WHERE vl IS NOT NULL""")
def parameter_variants(shop):
    """Three variants of the first record of each type in scope."""
    return ca.variants(shop.v_step, shop.v_ref)


_ABLE = "ab AS (SELECT * FROM " + _values([(o, t) for o, ts in ca.MACHINES_OF.items() for t in ts]) + " t(operation, machine_type))"


@query("setup_machine_types", f"WITH {_ABLE}, n AS (SELECT DISTINCT plan_id, operation FROM v_step) SELECT plan_id, machine_type FROM n JOIN ab USING (operation) GROUP BY plan_id, machine_type HAVING count(*) = (SELECT count(*) FROM n x WHERE x.plan_id = n.plan_id)")
def setup_machine_types(shop):
    """Machine types that do all operations of a plan's setup."""
    return ca.common_types(shop.v_step, "plan_id")


@query("available_types", f"WITH {_ABLE}, n AS (SELECT DISTINCT plan_id, operation FROM v_step), h AS (SELECT DISTINCT machine_type FROM v_machine WHERE max_rpm > 6000) SELECT plan_id, coalesce(string_agg(DISTINCT machine_type, ',' ORDER BY machine_type), '') AS types, count(machine_type) > 0 AS possible FROM n LEFT JOIN (SELECT * FROM ab WHERE machine_type IN (SELECT machine_type FROM h)) USING (operation) GROUP BY plan_id")
def available_types(shop):
    """Required machine types that are there."""
    have = shop.v_machine.filter("max_rpm > 6000").select("machine_type").distinct()
    able = shop.spark.createDataFrame([(o, t) for o, ts in ca.MACHINES_OF.items() for t in ts], "operation string, machine_type string").join(F.broadcast(have), "machine_type", "left_semi")
    j = shop.v_step.select("plan_id", "operation").distinct().join(F.broadcast(able), "operation", "left")
    return j.groupBy("plan_id").agg(F.array_join(F.sort_array(F.collect_set("machine_type")), ",").alias("types"), (F.count("machine_type") > 0).alias("possible"))


@query("same_setup", """SELECT drawing_id, coalesce(string_agg(DISTINCT CASE WHEN characteristic IN ('CIRCULAR_RUNOUT', 'TOTAL_RUNOUT') OR (characteristic = 'POSITION' AND tolerance < 0.1) THEN CAST(frame_id AS VARCHAR) END, ',' ORDER BY CASE WHEN characteristic IN ('CIRCULAR_RUNOUT', 'TOTAL_RUNOUT') OR (characteristic = 'POSITION' AND tolerance < 0.1) THEN CAST(frame_id AS VARCHAR) END), '') AS frame_ids,
  coalesce(arg_min(datums[1:1], {'l': line_no, 'f': frame_id, 's': s}) FILTER (WHERE datums IS NOT NULL), 'UNKNOWN') AS primary_datum, count(*) FILTER (WHERE characteristic = 'TOTAL_RUNOUT') AS n_warnings FROM v_frame GROUP BY drawing_id""")
def same_setup(shop):
    """Frames that must share a setup, and the first datum."""
    out = ca.same_setup(shop.v_frame, 0.1)
    return out.withColumn("frame_ids", F.array_join(F.array_sort(F.filter(F.split("frame_ids", ","), lambda x: x != "")), ","))


@query("locked_routes", """WITH r AS (SELECT DISTINCT feature_id, route_id FROM v_route), k AS (SELECT DISTINCT o_orderkey AS feature_id, CASE WHEN o_orderkey % 2 = 0 THEN (SELECT min(route_id) FROM r WHERE r.feature_id = o_orderkey) ELSE -1 END AS locked FROM orders)
  SELECT r.feature_id, r.route_id FROM r LEFT JOIN k USING (feature_id) WHERE k.locked IS NULL OR k.locked = -1 OR k.locked = r.route_id""")
def locked_routes(shop):
    """A lock keeps one route; a lock on what is no candidate keeps all."""
    r = shop.v_route.select("feature_id", "route_id").distinct()
    first = r.groupBy("feature_id").agg(F.min("route_id").alias("first"))
    locks = shop.orders.select(c("o_orderkey").alias("feature_id")).distinct().join(first, "feature_id", "left").select("feature_id", F.when(c("feature_id") % 2 == 0, c("first")).otherwise(-1).alias("locked_id"))
    return ca.locked(r, locks, "feature_id", "route_id")


@query("material_bridge", """WITH d AS (SELECT DISTINCT l_partkey % 2000 AS q, CASE l_partkey % 3 WHEN 0 THEN ' brand#' || CAST(10 + l_partkey % 45 AS VARCHAR) || '-' || CAST(l_partkey % 1000 AS VARCHAR) || ' ' WHEN 1 THEN CAST(l_partkey % 1000 AS VARCHAR) ELSE 'none ' || CAST(l_partkey AS VARCHAR) END AS raw FROM lineitem), n AS (SELECT *, upper(trim(raw)) AS k FROM d),
  m AS (SELECT material_id, iso_group, designation, upper(trim(designation)) AS k, upper(trim(alias)) AS al FROM v_material WHERE designation <> ''),
  e AS (SELECT n.q, n.raw, min(material_id) AS material_id FROM n JOIN m USING (k) GROUP BY n.q, n.raw), u AS (SELECT DISTINCT k FROM n WHERE k <> ''), x AS (SELECT u.k, arg_min(material_id, {'g': coalesce(iso_group, '~'), 'd': designation, 'i': material_id}) AS material_id FROM u JOIN m ON contains(m.k, u.k) OR contains(m.al, u.k) GROUP BY u.k), p AS (SELECT n.q, n.raw, x.material_id FROM n JOIN x USING (k))
  SELECT n.q, n.raw, coalesce(e.material_id, p.material_id) AS material_id, CASE WHEN e.material_id IS NOT NULL THEN 'EXACT' WHEN p.material_id IS NOT NULL THEN 'PARTIAL' ELSE 'NONE' END AS confidence FROM n LEFT JOIN e ON e.q = n.q AND e.raw = n.raw LEFT JOIN p ON p.q = n.q AND p.raw = n.raw""")
def material_bridge(shop):
    """Exact normal form, else the first material that holds the name, else NONE."""
    i = c("l_partkey")
    raw = F.when(i % 3 == 0, F.concat(F.lit(" brand#"), (i % 45 + 10).cast("string"), F.lit("-"), (i % 1000).cast("string"), F.lit(" "))).when(i % 3 == 1, (i % 1000).cast("string")).otherwise(F.concat(F.lit("none "), i.cast("string")))
    d = shop.lineitem.select((i % 2000).alias("q"), raw.alias("raw")).distinct()
    return ca.bridged(d, shop.v_material).select("q", "raw", "material_id", "confidence")


@query("routing_eligibility", """WITH o AS (SELECT DISTINCT CASE WHEN tool_id % 97 = 0 THEN 'plating' ELSE operation END AS operation FROM v_step), m AS (SELECT machine_id, unnest(string_split(processes, ';')) AS operation FROM v_machine) SELECT operation, count(machine_id) AS n, CASE WHEN count(machine_id) = 0 THEN 'UNKNOWN_OPERATION' ELSE 'OK' END AS status FROM o LEFT JOIN m USING (operation) GROUP BY operation""")
def routing_eligibility(shop):
    """Operations of routings with their machines; an unknown one is an error row."""
    from ..operators.catalog import items

    o = shop.v_step.select(F.when(c("tool_id") % 97 == 0, "plating").otherwise(c("operation")).alias("operation")).distinct()
    j = o.join(shop.v_machine.select("machine_id", F.explode(items(c("processes"))).alias("operation")), "operation", "left")
    return j.groupBy("operation").agg(F.count("machine_id").alias("n"), F.when(F.count("machine_id") == 0, "UNKNOWN_OPERATION").otherwise("OK").alias("status"))


@query("unlinked_features", "SELECT DISTINCT part_id, feature_id FROM v_feature f WHERE feature_type = 'HOLE' AND NOT EXISTS (SELECT 1 FROM v_char ch WHERE ch.plan_id = f.part_id AND ch.feature_id = f.feature_id AND ch.nominal IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type = 'error' AND e.user_id = f.part_id % 1000)")
def unlinked_features(shop):
    """features of a type without the linked and the rejected ones."""
    f = shop.v_feature.filter("feature_type = 'HOLE'").select("part_id", "feature_id").distinct()
    linked = shop.v_char.filter("nominal IS NOT NULL").select(c("plan_id").alias("part_id"), "feature_id").distinct()
    gone = shop.events.filter("event_type = 'error'").select(c("user_id").alias("_u")).distinct()
    return f.join(linked, ["part_id", "feature_id"], "left_anti").join(gone, c("part_id") % 1000 == c("_u"), "left_anti")


@query("lineage", "SELECT ch.plan_id, characteristic_id, f.feature_id, s.step_id, s.machine_id FROM v_char ch JOIN (SELECT DISTINCT part_id, feature_id FROM v_feature) f ON f.part_id = ch.plan_id AND f.feature_id = ch.feature_id JOIN v_planstep s ON s.plan_id = ch.plan_id AND s.feature_id = f.feature_id")
def lineage(shop):
    """Requirement to feature to step; filters on any of its columns are the lookups."""
    f = shop.v_feature.select(c("part_id").alias("plan_id"), "feature_id").distinct()
    return shop.v_char.select("plan_id", "characteristic_id", "feature_id").join(f, ["plan_id", "feature_id"]).join(shop.v_planstep.select("plan_id", "feature_id", "step_id", "machine_id"), ["plan_id", "feature_id"])


@query("derived_flags", """SELECT plan_id, bool_or(coalesce(ra_um <= 0.4, false)) AS needs_grinding, bool_or(coalesce(ra_um <= 1.6, false)) AS needs_finishing, bool_or(char_type = 'THREAD') AS needs_tapping FROM v_char GROUP BY plan_id""")
def derived_flags(shop):
    """Flags of a part from its requirements."""
    on = lambda x: F.bool_or(F.coalesce(x, F.lit(False)))
    return shop.v_char.groupBy("plan_id").agg(on(c("ra_um") <= 0.4).alias("needs_grinding"), on(c("ra_um") <= 1.6).alias("needs_finishing"), on(c("char_type") == "THREAD").alias("needs_tapping"))
