"""Process plans, manufacturing plan documents and the whole audit of a schedule."""

from pyspark.sql import functions as F

from ..operators import graph, quality, schedules
from ..operators import plan_documents as pd
from ..operators import records as rec
from ..sources import export
from .registry import query, r6
from .shop_quality import _INSP
from .shop_records import _CRIT, _ITEMS, _LOST, _PARTS, _covered, _critical, _items

c = F.col

_KEY = "CASE WHEN level = 'CRITICAL' AND s % 4 = 0 THEN 'KEY_CHARACTERISTIC' ELSE level END"


@query("control_plan", f"""WITH {_INSP}, k AS (SELECT *, {_KEY} AS own FROM lv)
  SELECT plan_id, characteristic_id, s, own AS level, gage, 'FINAL' AS operation_name, CASE own WHEN 'KEY_CHARACTERISTIC' THEN 'STOP_AND_REVIEW' WHEN 'CRITICAL' THEN 'SEGREGATE' ELSE 'REMEASURE' END AS reaction_plan,
  CASE WHEN own IN ('KEY_CHARACTERISTIC', 'CRITICAL') THEN 'QC' ELSE 'OPERATOR' END AS responsibility FROM k""")
def control_plan(shop):
    """A control plan row per characteristic."""
    chars = quality.inspection_plan(shop.v_char).withColumn("level", F.expr(_KEY))
    return pd.control_plan(chars).select("plan_id", "characteristic_id", "s", "level", "gage", "operation_name", "reaction_plan", "responsibility")


_SETUP = "CASE WHEN s % 7 = 0 THEN NULL ELSE 1 + s % 3 END"
_SOURCE = "CASE WHEN k % 5 = 0 THEN NULL WHEN k % 2 = 0 THEN 'CATALOG' ELSE 'CALIBRATION' END"
_OPS = f"""op AS (SELECT *, coalesce({_SETUP}, 1)::BIGINT AS setup, 10 * row_number() OVER (PARTITION BY plan_id ORDER BY sequence_index, step_id, k, s) AS op_number, coalesce(operation, 'UNKNOWN') AS operation_type,
  CAST('0x' || substr(sha256(concat_ws('|', step_id, sequence_index, coalesce(operation, ''), coalesce(machine_id::VARCHAR, ''), coalesce(tool_id::VARCHAR, ''), coalesce(feature_id::VARCHAR, ''), coalesce(CAST(round(vc * 1000) AS BIGINT)::VARCHAR, ''))), 1, 8) AS BIGINT) AS content FROM v_planstep)"""


def _operations(shop):
    s = shop.v_planstep.withColumns({"setup_number": F.expr(_SETUP), "parameter_source": F.expr(_SOURCE)})
    print_ = pd.content(*[c(x) for x in ("step_id", "sequence_index", "operation", "machine_id", "tool_id", "feature_id")], F.round(c("vc") * 1000).cast("long"))
    return pd.operations(s, ["sequence_index", "step_id", "k", "s"]).withColumn("content", print_)


@query("plan_operations", f"WITH {_OPS} SELECT plan_id, step_id, setup, op_number, operation_type, machine_id, tool_id FROM op")
def plan_operations(shop):
    """C4: the operations of a manufacturing plan, numbered in tens within their plan."""
    return _operations(shop).select("plan_id", "step_id", "setup", "op_number", "operation_type", "machine_id", "tool_id")


@query("plan_setups", f"WITH {_OPS} SELECT plan_id, setup, min(machine_id) AS machine_id, count(DISTINCT machine_id) AS n_machines, count(DISTINCT tool_id) AS n_tools, count(*) AS n_operations FROM op GROUP BY plan_id, setup")
def plan_setups(shop):
    """C4: the setups of a manufacturing plan."""
    return pd.setups(_operations(shop))


@query("plan_parameters", f"WITH {_OPS} SELECT plan_id, op_number, operation_type, vc, feed_rate, coalesce({_SOURCE}, 'INSUFFICIENT_DATA') AS source FROM op WHERE coalesce(vc, 0) <> 0 OR coalesce(feed_rate, 0) <> 0")
def plan_parameters(shop):
    """C4: the parameter table of a manufacturing plan."""
    return pd.parameters(_operations(shop))


@query("plan_flow", f"""WITH {_OPS}, n AS (SELECT plan_id, setup, 0 AS op_number, 'S' || setup AS node, 'SETUP' AS node_type FROM op GROUP BY plan_id, setup UNION ALL SELECT plan_id, setup, op_number, 'OP' || op_number, CASE WHEN upper(operation_type) LIKE '%INSPECT%' THEN 'INSPECTION' ELSE 'OPERATION' END FROM op),
  o AS (SELECT *, lag(node) OVER w AS before, lead(node) OVER w AS next FROM n WINDOW w AS (PARTITION BY plan_id ORDER BY setup, op_number))
  SELECT plan_id, coalesce(before, 'RAW_MATERIAL') AS src, node AS dst, node_type FROM o UNION ALL SELECT plan_id, node, 'OUTPUT', 'OUTPUT' FROM o WHERE next IS NULL""")
def plan_flow(shop):
    """From raw material through setups and operations to the part."""
    return pd.flow(_operations(shop))


@query("manufacturing_plans", f"""WITH {_CRIT}, {_LOST}, {_ITEMS}, {_PARTS}, {_OPS},
  o AS (SELECT plan_id, count(*) AS n_operations, count(DISTINCT setup) AS n_setups, count(DISTINCT tool_id) AS n_tools, count(DISTINCT machine_id) AS n_machines, count(*) FILTER (WHERE coalesce(vc, 0) <> 0 OR coalesce(feed_rate, 0) <> 0) AS n_parameters, sum(content)::BIGINT AS route FROM op GROUP BY plan_id),
  ch AS (SELECT plan_id, count(*) AS n_characteristics, sum(CAST('0x' || substr(sha256(concat_ws('|', characteristic_id, char_type, coalesce(CAST(round(nominal * 1000) AS BIGINT)::VARCHAR, ''))), 1, 8) AS BIGINT))::BIGINT AS requirements FROM v_char GROUP BY plan_id),
  hk AS (SELECT op.plan_id, count(*) AS n_hooks FROM op JOIN cr ON cr.plan_id = op.plan_id AND (cr.feature_id IS NULL OR cr.feature_id = op.feature_id) GROUP BY op.plan_id),
  ix AS (SELECT plan_id, count(*) FILTER (WHERE severity = 'BLOCKING') AS blocking, count(*) FILTER (WHERE severity = 'REVIEW_REQUIRED') AS review, count(*) FILTER (WHERE severity = 'ADVISORY') AS advisory FROM it GROUP BY plan_id),
  d AS (SELECT coalesce(o.plan_id, ch.plan_id) AS plan_id, coalesce(n_operations, 0) AS n_operations, coalesce(n_setups, 0) AS n_setups, coalesce(n_tools, 0) AS n_tools, coalesce(n_machines, 0) AS n_machines, coalesce(n_parameters, 0) AS n_parameters, coalesce(n_characteristics, 0) AS n_characteristics, coalesce(route, 0) AS route, coalesce(requirements, 0) AS requirements FROM o FULL JOIN ch ON o.plan_id = ch.plan_id),
  e AS (SELECT d.*, coalesce(n_hooks, 0) AS n_hooks, coalesce(blocking, 0) AS blocking, coalesce(review, 0) AS review, coalesce(advisory, 0) AS advisory, (coalesce(machine, 0) + coalesce(tool, 0) + coalesce(holder, 1) + coalesce(parameter, 0) + coalesce(cycle_time, 0) + coalesce(inspection, 0) + CASE WHEN n_characteristics > 0 THEN 1 ELSE 0 END) / 7 AS completeness
    FROM d LEFT JOIN pa USING (plan_id) LEFT JOIN hk USING (plan_id) LEFT JOIN ix USING (plan_id)),
  f AS (SELECT *, CASE WHEN completeness >= 0.95 THEN 'COMPLETE' WHEN completeness >= 0.80 THEN 'MOSTLY_COMPLETE' WHEN completeness >= 0.50 THEN 'PARTIALLY_COMPLETE' ELSE 'INCOMPLETE' END AS band FROM e)
  SELECT plan_id, 'DRAFT' AS status, n_setups, n_operations, n_tools, n_machines, n_parameters, n_characteristics, CASE WHEN n_operations > 0 THEN n_operations + n_setups + 1 ELSE 0 END AS n_flow_edges, n_hooks, blocking, review, advisory, round(completeness + 1e-9, 6) AS completeness, band,
  CASE WHEN blocking > 0 THEN 'BLOCKED' WHEN band = 'INCOMPLETE' THEN 'INCOMPLETE' WHEN review > 0 OR completeness < 0.80 THEN 'REVIEW_REQUIRED' ELSE 'READY_FOR_ENGINEERING_REVIEW' END AS gate, CASE WHEN n_characteristics = 0 THEN 'NO_CHARACTERISTICS' END AS warning,
  substr(sha256(concat_ws('|', plan_id, route, requirements)), 1, 16) AS fingerprint FROM f""")
def manufacturing_plans(shop):
    """C4: a manufacturing plan's header with its counts, completeness, gate and fingerprint."""
    chars = shop.v_char.withColumn("content", pd.content(c("characteristic_id"), c("char_type"), F.round(c("nominal") * 1000).cast("long")))
    return pd.header(_operations(shop), chars, _critical(shop), _covered(shop)).withColumn("completeness", r6(c("completeness")))


_ISO = "CASE k % 7 WHEN 0 THEN 'P' WHEN 1 THEN 'M' WHEN 2 THEN 'K' WHEN 3 THEN 'N' WHEN 4 THEN 'S' WHEN 5 THEN 'H' END"
_FAULTS = """f AS (SELECT plan_id FROM v_planstep GROUP BY plan_id, step_id HAVING count(*) > 1 UNION ALL SELECT plan_id FROM v_planstep GROUP BY plan_id, sequence_index HAVING count(*) > 1
  UNION ALL SELECT plan_id FROM v_planstep s WHERE predecessor IS NOT NULL AND (predecessor = step_id OR NOT EXISTS (SELECT 1 FROM v_planstep o WHERE o.plan_id = s.plan_id AND o.step_id = s.predecessor)) UNION ALL SELECT plan_id FROM y)"""
_RULE = lambda unknown, ok: f"CASE WHEN {unknown} THEN 'UNKNOWN' WHEN {ok} THEN 'PASS' ELSE 'FAIL' END"
_RULES = ", ".join([
    _RULE("len(own) = 0", "list_contains(own, machine_interface)"),
    f"""CASE WHEN tool_interface IN ('ER32', 'HYDRAULIC') THEN {_RULE('shank_mm IS NULL OR clamp_min IS NULL OR clamp_max IS NULL', 'shank_mm BETWEEN clamp_min AND clamp_max')} WHEN tool_interface = 'INSERT_CNMG' THEN {_RULE('insert_shape IS NULL', "insert_shape = 'CNMG'")}
    WHEN tool_interface = 'BORING_BAR_25' THEN {_RULE('shank_mm IS NULL', 'abs(shank_mm - 25) <= 0.1')} ELSE 'UNKNOWN' END""",
    _RULE("length_mm IS NULL OR max_tool_len IS NULL", "length_mm <= max_tool_len"), _RULE("d_mm IS NULL OR max_tool_d IS NULL", "d_mm <= max_tool_d"), _RULE("iso_groups = ''", "list_contains(string_split(iso_groups, ';'), iso)"),
    *[_RULE(f"{x} IS NULL OR rpm IS NULL", f"{x} >= rpm") for x in ("m_rpm", "t_rpm", "h_rpm")],
])
_PLANNED = f"""z AS (SELECT p.*, {_ISO} AS iso, lower(operation) AS o, m.processes, t.operations, h.tool_interface, h.machine_interface, h.clamp_min, h.clamp_max, m.max_rpm AS m_rpm, t.max_rpm AS t_rpm, h.max_rpm AS h_rpm, m.max_tool_len, m.max_tool_d, t.length_mm, t.d_mm, t.shank_mm, t.insert_shape, t.iso_groups,
    list_filter(string_split(coalesce(spindle_interface, '') || ';' || more_interfaces, ';'), lambda x: x <> '') AS own, vc * 1000 / (pi() * t.d_mm) AS rpm FROM v_planstep p LEFT JOIN v_machine m USING (machine_id) LEFT JOIN v_tool t USING (tool_id) LEFT JOIN v_holder h USING (holder_id)),
  sc AS (SELECT o AS so, iso AS si, (SELECT count(*) FROM v_ref r WHERE (r.operation IS NULL OR q.o IS NULL OR r.operation = q.o) AND (r.iso_group IS NULL OR q.iso IS NULL OR r.iso_group = q.iso)) AS n_references FROM (SELECT DISTINCT o, iso FROM z) q),
  zr AS (SELECT z.*, n_references, [{_RULES}] AS rules, coalesce(z.o IN ('milling', 'turning', 'drilling', 'boring', 'reaming', 'tapping'), false) AS sup, z.iso IS NOT NULL AS grp, processes IS NOT NULL AND operations IS NOT NULL AND tool_interface IS NOT NULL AS fnd FROM z LEFT JOIN sc ON so IS NOT DISTINCT FROM z.o AND si IS NOT DISTINCT FROM z.iso),
  zs AS (SELECT *, fnd AND list_contains(string_split(processes, ';'), o) AND list_contains(string_split(operations, ';'), o) AS able, CASE WHEN list_contains(rules, 'FAIL') THEN 'BLOCKED' WHEN list_contains(rules, 'UNKNOWN') THEN 'INSUFFICIENT_DATA' ELSE 'PLANNED' END AS verdict FROM zr),
  st AS (SELECT *, CASE WHEN NOT sup THEN 'NOT_SUPPORTED' WHEN NOT grp OR NOT able THEN 'INSUFFICIENT_DATA' ELSE verdict END AS state, list_filter([CASE WHEN NOT sup THEN 'NOT_SUPPORTED' WHEN NOT grp THEN 'MATERIAL_GROUP' WHEN NOT fnd THEN 'RESOURCE_UNKNOWN' WHEN NOT able THEN 'NO_CANDIDATE' WHEN verdict = 'BLOCKED' THEN 'INCOMPATIBLE' WHEN verdict = 'INSUFFICIENT_DATA' THEN 'COMPATIBILITY_UNKNOWN' END,
    CASE WHEN sup AND grp AND n_references = 0 THEN 'NO_REFERENCE' END], lambda x: x IS NOT NULL) AS reasons FROM zs)"""


def _planned(shop):
    return pd.step_plans(shop.v_planstep.withColumn("iso_group", F.expr(_ISO)), shop.v_machine, shop.v_tool, shop.v_holder, shop.v_ref)


@query("step_plans", f"WITH {_PLANNED} SELECT plan_id, step_id, k, s, state, array_to_string(reasons, ',') AS reasons, n_references FROM st")
def step_plans(shop):
    """How far each step of a process plan is planned, and what is missing."""
    return _planned(shop).select("plan_id", "step_id", "k", "s", "state", F.array_join("reasons", ",").alias("reasons"), "n_references")


@query("process_plans", f"""WITH RECURSIVE e AS (SELECT DISTINCT plan_id, predecessor AS src, step_id AS dst FROM v_planstep WHERE predecessor IS NOT NULL), t AS (SELECT plan_id, src, dst FROM e UNION SELECT t.plan_id, t.src, e.dst FROM t JOIN e ON e.plan_id = t.plan_id AND e.src = t.dst), r AS (SELECT DISTINCT plan_id, src FROM t WHERE src = dst),
  y AS (SELECT DISTINCT t.plan_id, t.dst FROM t JOIN r ON r.plan_id = t.plan_id AND r.src = t.src), {_FAULTS}, {_PLANNED},
  x AS (SELECT plan_id, count(*) AS n_steps, count(*) FILTER (WHERE state = 'PLANNED') AS n_planned, count(*) FILTER (WHERE state = 'BLOCKED') AS n_blocked, count(*) FILTER (WHERE state = 'INSUFFICIENT_DATA') AS n_insufficient, count(*) FILTER (WHERE state = 'NOT_SUPPORTED') AS n_not_supported,
    count(DISTINCT machine_id) FILTER (WHERE state = 'PLANNED') AS n_machines, count(DISTINCT holder_id) FILTER (WHERE state = 'PLANNED') AS n_holders, count(DISTINCT tool_id) FILTER (WHERE state = 'PLANNED') AS n_tools, count(CASE WHEN feed_rate > 0 THEN path_mm * 60 / feed_rate END) AS n_timed, sum(CASE WHEN feed_rate > 0 THEN path_mm * 60 / feed_rate END) AS cutting_s,
    array_to_string(list_sort(list_distinct(flatten(list(reasons)))), ',') AS reasons FROM st GROUP BY plan_id), nf AS (SELECT plan_id, count(*) AS n_faults FROM f GROUP BY plan_id)
  SELECT x.* REPLACE (round(cutting_s + 1e-9, 6) AS cutting_s), coalesce(n_faults, 0) AS n_faults, CASE WHEN n_planned = n_steps THEN 'COMPLETE' WHEN n_planned > 0 THEN 'PARTIAL' WHEN n_blocked > 0 THEN 'BLOCKED' ELSE 'INSUFFICIENT_DATA' END AS plan_status, coalesce(n_faults, 0) = 0 AS dependencies_ok FROM x LEFT JOIN nf USING (plan_id)""")
def process_plans(shop):
    """A process plan's status, resources, missing data, cutting time and faults of its dependencies, cycles included."""
    s = shop.v_planstep
    faults = rec.step_findings(s).filter("rule_id IN ('R-2801', 'R-2802', 'R-2803')").select("plan_id", "step_id")
    cyclic = graph.cyclic_nodes(s.filter("predecessor IS NOT NULL").select("plan_id", c("predecessor").alias("src"), c("step_id").alias("dst")))
    faults = faults.unionByName(cyclic.select("plan_id", c("node").cast("long").alias("step_id")))
    return pd.process_plans(_planned(shop), faults).withColumn("cutting_s", r6(c("cutting_s")))


_ASSIGNED = """SELECT CASE WHEN o_orderkey % 89 = 0 THEN o_orderkey + 1 ELSE o_orderkey END AS operation_id, o_custkey AS machine_id, CASE WHEN o_orderkey % 83 = 0 THEN NULL ELSE (o_orderkey % 700 * 3) * 3600 + 1800 - CASE WHEN o_orderkey % 97 = 0 THEN 9000000 ELSE 0 END END AS start_s,
  (o_orderkey % 700 * 3) * 3600 + 1800 + 600 * (o_custkey % 20) AS end_s, CASE o_orderstatus WHEN 'P' THEN 'K1' WHEN 'O' THEN 'K2' ELSE 'K3' END AS setup_key FROM {orders}"""
_REQUIRED = "SELECT o_orderkey + CASE WHEN o_orderkey % 71 = 0 THEN 1000000000 ELSE 0 END AS operation_id, 600 * (o_custkey % 20) + CASE WHEN o_orderkey % 11 = 0 THEN 60 ELSE 0 END AS duration_s FROM {orders}"
_ELIGIBLE = "SELECT o_orderkey AS operation_id, o_custkey + CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS machine_id FROM {orders}"
_SHOPS = "SELECT CASE WHEN c_custkey % 40 = 0 THEN -c_custkey ELSE c_custkey END AS machine_id FROM {customer}"
_BEFORE = "SELECT o_orderkey AS operation_id, o_orderkey - 1 - o_custkey % 2 AS predecessor FROM {orders} WHERE o_orderkey % 5 <> 0"
_WINDOWS = "SELECT machine_id, start_h * 3600 AS start_s, end_h * 3600 + 7200 AS end_s FROM v_window"
_CHANGES = [("K1", "K2", 2400), ("K2", "K1", 0), ("K3", "K2", 90000)]
_MAKESPAN = 7_550_000
_ROWS = ", ".join(map(str, _CHANGES))
_BARE = lambda sql: sql.replace("{", "").replace("}", "")


@query("schedule_violations", f"""WITH a AS ({_BARE(_ASSIGNED)}), rq AS (SELECT operation_id, max(duration_s) AS duration_s FROM ({_BARE(_REQUIRED)}) GROUP BY 1), el AS (SELECT DISTINCT * FROM ({_BARE(_ELIGIBLE)})), mc AS (SELECT DISTINCT * FROM ({_BARE(_SHOPS)})), pr AS (SELECT DISTINCT * FROM ({_BARE(_BEFORE)})),
  w0 AS (SELECT DISTINCT * FROM ({_WINDOWS})), w1 AS (SELECT *, max(end_s) OVER (PARTITION BY machine_id ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM w0), w2 AS (SELECT *, sum(CASE WHEN start_s <= pe THEN 0 ELSE 1 END) OVER (PARTITION BY machine_id ORDER BY start_s, end_s ROWS UNBOUNDED PRECEDING) AS g FROM w1), w AS (SELECT machine_id, min(start_s) AS s, max(end_s) AS e FROM w2 GROUP BY machine_id, g),
  q AS (SELECT a.*, count(*) OVER (PARTITION BY operation_id) AS copies, max(end_s) OVER w AS reach, lag(end_s) OVER v AS p_end, lag(setup_key) OVER v AS p_key FROM a WINDOW w AS (PARTITION BY machine_id, start_s IS NULL OR end_s IS NULL ORDER BY start_s NULLS FIRST, operation_id, end_s, setup_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), v AS (PARTITION BY machine_id, start_s IS NULL OR end_s IS NULL ORDER BY start_s NULLS FIRST, operation_id, end_s, setup_key)),
  j AS (SELECT q.*, rq.operation_id IS NOT NULL AS asked, duration_s, mc.machine_id IS NOT NULL AS there, el.machine_id IS NOT NULL AS may, coalesce(sec, 900) AS need FROM q LEFT JOIN rq USING (operation_id) LEFT JOIN mc ON mc.machine_id = q.machine_id LEFT JOIN el ON el.operation_id = q.operation_id AND el.machine_id = q.machine_id LEFT JOIN (VALUES {_ROWS}) mx(f, t, sec) ON f = p_key AND t = setup_key)
  SELECT 'DUPLICATE' AS check_id, operation_id, machine_id FROM j WHERE copies > 1 UNION ALL SELECT 'UNKNOWN', operation_id, machine_id FROM j WHERE NOT asked UNION ALL SELECT 'UNKNOWN_MACHINE', operation_id, machine_id FROM j WHERE NOT there UNION ALL SELECT 'INELIGIBLE', operation_id, machine_id FROM j WHERE asked AND there AND NOT may
  UNION ALL SELECT 'NOT_TIMED', operation_id, machine_id FROM j WHERE start_s IS NULL OR end_s IS NULL UNION ALL SELECT 'NEGATIVE_START', operation_id, machine_id FROM j WHERE start_s < 0 UNION ALL SELECT 'END_BEFORE_START', operation_id, machine_id FROM j WHERE end_s <= start_s UNION ALL SELECT 'WRONG_DURATION', operation_id, machine_id FROM j WHERE end_s > start_s AND end_s - start_s <> duration_s
  UNION ALL SELECT 'OVERLAP', operation_id, machine_id FROM j WHERE reach > start_s UNION ALL SELECT 'SETUP_TOO_SHORT', operation_id, machine_id FROM j WHERE start_s >= p_end AND start_s - p_end < need UNION ALL SELECT 'OUTSIDE_WINDOW', operation_id, machine_id FROM j WHERE start_s IS NOT NULL AND NOT EXISTS (SELECT 1 FROM w WHERE w.machine_id = j.machine_id AND w.s <= j.start_s AND j.end_s <= w.e)
  UNION ALL SELECT 'MISSING', operation_id, NULL FROM rq WHERE operation_id NOT IN (SELECT operation_id FROM a) UNION ALL SELECT 'PRECEDENCE', pr.operation_id, b.machine_id FROM pr JOIN (SELECT operation_id, max(end_s) AS done FROM a GROUP BY 1) p ON p.operation_id = pr.predecessor JOIN a b ON b.operation_id = pr.operation_id WHERE done > b.start_s
  UNION ALL SELECT 'MAKESPAN', NULL, NULL FROM (SELECT max(end_s) AS m FROM a) WHERE m <> {_MAKESPAN}""")
def schedule_violations(shop):
    """Every check of a schedule against what was asked for, violations as rows."""
    sql = lambda text, t: shop.spark.sql(text, **{t: shop.table(t)})
    windows = shop.v_window.select("machine_id", (c("start_h") * 3600).alias("start_s"), (c("end_h") * 3600 + 7200).alias("end_s"))
    matrix = shop.spark.createDataFrame(_CHANGES, "from_key string, to_key string, seconds long")
    return schedules.violations(sql(_REQUIRED, "orders"), sql(_ASSIGNED, "orders"), sql(_ELIGIBLE, "orders"), sql(_SHOPS, "customer"), sql(_BEFORE, "orders"), windows, matrix, 900, _MAKESPAN)


def _cells(columns):
    """A CSV line in SQL, out of SQL texts of its cells."""
    guard = lambda x: f"coalesce(CASE WHEN regexp_matches({x}, '^[=+\\-@\\t\\r]') THEN chr(39) || {x} ELSE {x} END, '')"
    return "concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches({guard(x)}, '[,\"\\r\\n]') THEN '\"' || replace({guard(x)}, '\"', '\"\"') || '\"' ELSE {guard(x)} END" for x in columns.values()) + ")"


def _export_sql(ctes, source, order, columns):
    return f"""WITH {ctes}, x AS (SELECT plan_id, row_number() OVER (PARTITION BY plan_id ORDER BY {order}) AS line_no, {_cells(columns)} AS line FROM {source})
  SELECT plan_id, line_no, line FROM x UNION ALL SELECT DISTINCT plan_id, 0, '{','.join(columns)}' FROM x"""


_TEXT = lambda x: f"CAST({x} AS STRING)"
_MILLI = lambda x: f"CAST(CAST({x} AS DECIMAL(18, 3)) AS STRING)"
#: Header and cells of each export; the same expressions in both engines.
_OPERATION_CELLS = {x: _TEXT(x) for x in ("op_number", "operation_type", "machine_id", "tool_id", "holder_id")} | {"vc_m_min": _MILLI("vc"), "feed_mm_min": _MILLI("feed_rate"), "parameter_source": _SOURCE, "feature_id": _TEXT("feature_id"), "notes": "CASE WHEN k % 3 = 0 THEN '-check \"vc\", ' || coalesce(operation, '') END"}
_CHAR_CELLS = {"char_id": _TEXT("characteristic_id"), "char_type": "char_type", "criticality": "level", "specification": f"CASE WHEN s % 6 = 0 THEN '=' ELSE '' END || {_MILLI('nominal')}"}
_INSPECTION_CELLS = _CHAR_CELLS | {"stage": "'FINAL'", "gage_suggestion": "gage", "frequency": "CASE level WHEN 'CRITICAL' THEN 'EVERY_PART' WHEN 'MAJOR' THEN '1_IN_5' ELSE '1_IN_20' END"}
_CONTROL_CELLS = {"operation_name": "'FINAL'"} | _CHAR_CELLS | {
    "gage_suggestion": "gage", "reaction_plan": "CASE level WHEN 'KEY_CHARACTERISTIC' THEN 'STOP_AND_REVIEW' WHEN 'CRITICAL' THEN 'SEGREGATE' ELSE 'REMEASURE' END",
    "responsibility": "CASE WHEN level IN ('KEY_CHARACTERISTIC', 'CRITICAL') THEN 'QC' ELSE 'OPERATOR' END",
}
_ITEM_CELLS = {"category": "category", "severity": "severity", "related_id": _TEXT("related_id"), "status": "'OPEN'"}
_IN_ORDER = "characteristic_id, s, level, nominal, gage"


def _lines(df, order, columns):
    return export.csv_lines(df, "plan_id", [F.asc_nulls_last(x.strip()) for x in order.split(",")], {k: F.expr(v) for k, v in columns.items()})


@query("export_operations", _export_sql(_OPS, "op", "op_number", _OPERATION_CELLS))
def export_operations(shop):
    """The operations of a plan as CSV."""
    return _lines(_operations(shop), "op_number", _OPERATION_CELLS)


@query("export_inspection", _export_sql(_INSP, "lv", _IN_ORDER, _INSPECTION_CELLS))
def export_inspection(shop):
    """The inspection plan as CSV."""
    return _lines(quality.inspection_plan(shop.v_char), _IN_ORDER, _INSPECTION_CELLS)


@query("export_control_plan", _export_sql(f"{_INSP}, kl AS (SELECT * REPLACE ({_KEY} AS level) FROM lv)", "kl", _IN_ORDER, _CONTROL_CELLS))
def export_control_plan(shop):
    """The control plan as CSV."""
    return _lines(quality.inspection_plan(shop.v_char).withColumn("level", F.expr(_KEY)), _IN_ORDER, _CONTROL_CELLS)


@query("export_open_items", _export_sql(f"{_CRIT}, {_LOST}, {_ITEMS}", "it", "category, severity, related_id", _ITEM_CELLS))
def export_open_items(shop):
    """The open items of a plan as CSV."""
    return _lines(_items(shop), "category, severity, related_id", _ITEM_CELLS)
