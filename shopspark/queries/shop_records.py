"""Rules over materials, experiments, tolerance frames, plan steps and plan documents."""

from pyspark.sql import functions as F

from ..operators import records as rec
from .registry import query, r6

c = F.col

_REQUIRED = ", ".join(f"CASE WHEN {n} IS NULL OR trim(CAST({n} AS VARCHAR)) = '' THEN 'REQUIRED_{n.upper()}' END" for n in ("material_id", "designation", "iso_group", "iso_subgroup", "family"))


def _codes(*rules):
    """SQL list of the codes whose condition holds, in order, as text."""
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {on} THEN '{k}' END" for k, on in rules) + "], lambda x: x IS NOT NULL), ',')"


@query("material_issues", f"""SELECT material_id, array_to_string(list_filter([{_REQUIRED},
  CASE WHEN iso_group NOT IN ('P', 'M', 'K', 'N', 'S', 'H') THEN 'INVALID_ISO_GROUP' END, CASE WHEN iso_group = 'S' AND coalesce(iso_subgroup, '') NOT IN ('S_TITANIUM', 'S_NICKEL_HRSA') THEN 'S_GROUP_NOT_DIFFERENTIATED' END,
  CASE WHEN density = 0 THEN 'ZERO_FOR_MISSING_DENSITY' END, CASE WHEN modulus = 0 THEN 'ZERO_FOR_MISSING_MODULUS' END, CASE WHEN coalesce(hardness_scale, '') NOT IN ('HB', 'HRC', 'HRB', 'HV') THEN 'INVALID_HARDNESS_SCALE' END,
  CASE WHEN hardness_min <= 0 OR hardness_max <= 0 THEN 'NON_POSITIVE_HARDNESS' END, CASE WHEN hardness_min > hardness_max THEN 'HARDNESS_RANGE_INVERTED' END, CASE WHEN vc_min <= 0 OR vc_max <= 0 THEN 'NON_POSITIVE_VC' END,
  CASE WHEN tensile > 3500 THEN 'IMPLAUSIBLE_TENSILE' END, CASE WHEN density < 1500 OR density > 22000 THEN 'IMPLAUSIBLE_DENSITY' END], lambda x: x IS NOT NULL), ',') AS issues FROM v_material""")
def material_issues(shop):
    return shop.v_material.select("material_id", F.array_join(rec.material_issues(), ",").alias("issues"))


def _int_sql(name, least):
    x = f"TRY_CAST({name} AS INTEGER)"
    return [(f"{name}_NOT_INTEGER".upper(), f"{x} IS NULL"), (f"{name}_BELOW_{least}".upper(), f"{x} < {least}")]


def _pos_sql(name):
    x = f"TRY_CAST({name} AS DOUBLE)"
    return [(f"{name}_NOT_NUMBER".upper(), f"{x} IS NULL OR isnan({x})"), (f"{name}_NOT_POSITIVE".upper(), f"{x} <= 0")]


def _first(rules):
    return "CASE " + " ".join(f"WHEN {on} THEN '{k}'" for k, on in rules) + " END"


_LIFE = [*_int_sql("tool_index", 1), ("TOOL_TYPE_MISSING", "tool_type IS NULL"), ("TOOL_TYPE_UNKNOWN", "trim(tool_type) NOT IN ('1', '2')"), *_pos_sql("adoc"), *_pos_sql("rdoc"), *_pos_sql("hardness"), *_pos_sql("holder_length"), *_int_sql("cycle", 1),
         *_int_sql("sample", 0), *_int_sql("countdown", 0), ("COUNTDOWN_SHARE_NOT_NUMBER", "TRY_CAST(countdown_share AS DOUBLE) IS NULL"), ("COUNTDOWN_SHARE_OUTSIDE_0_1", "TRY_CAST(countdown_share AS DOUBLE) NOT BETWEEN 0 AND 1"),
         *[r for n in ("sensor_a", "sensor_b") for r in ((f"{n}_MISSING".upper(), f"{n} IS NULL"), (f"{n}_NOT_NUMBER".upper(), f"TRY_CAST({n} AS DOUBLE) IS NULL"))]]


@query("life_test_rows", f"SELECT event_id, {_first(_LIFE)} AS reason FROM v_lifetest")
def life_test_rows(shop):
    return shop.v_lifetest.select("event_id", rec.life_test_reason(["sensor_a", "sensor_b"]).alias("reason"))


_WEAR = [("TOOL_CONDITION", "tool_condition IS NULL OR tool_condition NOT IN ('NEW', 'WORN')"), ("COATING", "coating IS NULL OR coating NOT IN ('TiAlN', 'AlCrN', 'NONE')"), *_int_sql("replicate", 1), *[r for n in ("vc", "fz", "ap", "rq") for r in _pos_sql(n)]]


@query("wear_test_rows", f"SELECT case_no, k, {_first(_WEAR)} AS reason FROM v_weartest")
def wear_test_rows(shop):
    return shop.v_weartest.select("case_no", "k", rec.wear_test_reason(["NEW", "WORN"], ["TiAlN", "AlCrN", "NONE"], ["vc", "fz", "ap", "rq"]).alias("reason"))


@query("wear_test_filter", f"SELECT case_no, k FROM v_weartest WHERE {_first(_WEAR)} IS NULL AND lower(tool_condition) = 'new' AND lower(coating) = 'tialn' AND replicate = '2'")
def wear_test_filter(shop):
    """accepted wear tests by condition, coating and replicate."""
    from ..operators import catalog as cat

    good = shop.v_weartest.withColumn("reason", rec.wear_test_reason(["NEW", "WORN"], ["TiAlN", "AlCrN", "NONE"], ["vc", "fz", "ap", "rq"])).filter("reason IS NULL")
    return cat.filter_equal(good, tool_condition="NEW", coating="TiAlN", replicate="2").select("case_no", "k")


@query("life_test_ends", f"SELECT event_id, tool_index FROM v_lifetest WHERE {_first(_LIFE)} IS NULL AND tool_type = '1' AND adoc = '0.5' AND countdown = '0'")
def life_test_ends(shop):
    """accepted end-of-life rows of one tool type and depth."""
    from ..operators import catalog as cat

    good = shop.v_lifetest.withColumn("reason", rec.life_test_reason(["sensor_a", "sensor_b"])).filter("reason IS NULL")
    return cat.filter_equal(good, tool_type="1", adoc="0.5", countdown="0").select("event_id", "tool_index")


_FORM = "characteristic IN ('STRAIGHTNESS', 'FLATNESS', 'CIRCULARITY', 'CYLINDRICITY')"
_FRAME_RULES = [
    ("VAL-GDT-001", "ERROR", f"{_FORM} AND datums IS NOT NULL"),
    ("VAL-GDT-002", "WARNING", "characteristic IN ('PERPENDICULARITY', 'PARALLELISM', 'ANGULARITY', 'POSITION', 'CONCENTRICITY', 'SYMMETRY', 'CIRCULAR_RUNOUT', 'TOTAL_RUNOUT') AND datums IS NULL"),
    ("VAL-GDT-003", "ERROR", "modifier IN ('MMC', 'LMC') AND NOT true_fos"), ("VAL-GDT-004", "ERROR", f"{_FORM} AND modifier IN ('MMC', 'LMC')"), ("VAL-GDT-006", "ERROR", "lower_tolerance > tolerance"),
    ("VAL-GDT-007", "WARNING", "characteristic = 'TOTAL_RUNOUT' AND datums IS NULL"), ("VAL-GDT-008", "INFO", "characteristic IN ('CONCENTRICITY', 'SYMMETRY')"),
]


@query("frame_findings", " UNION ALL ".join(f"SELECT drawing_id, frame_id, line_no, '{r}' AS rule_id, '{s}' AS severity FROM v_frame WHERE {on}" for r, s, on in _FRAME_RULES))
def frame_findings(shop):
    return rec.frame_findings(shop.v_frame)


@query("step_findings", """SELECT plan_id, 'R-2801' AS rule_id, step_id::BIGINT AS step_id, CAST(count(*) AS VARCHAR) AS detail FROM v_planstep GROUP BY plan_id, step_id HAVING count(*) > 1
  UNION ALL SELECT plan_id, 'R-2802', sequence_index::BIGINT, CAST(count(*) AS VARCHAR) FROM v_planstep GROUP BY plan_id, sequence_index HAVING count(*) > 1
  UNION ALL SELECT plan_id, 'R-2803', step_id::BIGINT, CASE WHEN predecessor = step_id THEN 'SELF' ELSE 'UNKNOWN' END FROM v_planstep s WHERE predecessor IS NOT NULL AND (predecessor = step_id OR NOT EXISTS (SELECT 1 FROM v_planstep o WHERE o.plan_id = s.plan_id AND o.step_id = s.predecessor))
  UNION ALL SELECT plan_id, 'R-2805', step_id::BIGINT, array_to_string(list_filter([CASE WHEN feature_id IS NULL THEN 'feature_id' END, CASE WHEN operation IS NULL THEN 'operation' END, CASE WHEN tool_id IS NULL THEN 'tool_id' END, CASE WHEN machine_id IS NULL THEN 'machine_id' END], lambda x: x IS NOT NULL), ',')
    FROM v_planstep WHERE feature_id IS NULL OR operation IS NULL OR tool_id IS NULL OR machine_id IS NULL""")
def step_findings(shop):
    return rec.step_findings(shop.v_planstep)


_CRIT = "cr AS (SELECT plan_id, characteristic_id, feature_id FROM v_char WHERE char_type = 'GDT')"
_LOST = "lost AS (SELECT cr.plan_id, cr.characteristic_id FROM cr WHERE NOT EXISTS (SELECT 1 FROM v_planstep p WHERE p.plan_id = cr.plan_id AND p.covered AND p.k * 1000 + p.step_id = cr.characteristic_id))"
_MACH = "upper(coalesce(operation, '')) NOT LIKE '%INSPECT%'"
_ITEMS = f"""it AS (SELECT plan_id, 'MISSING_MACHINE' AS category, 'REVIEW_REQUIRED' AS severity, step_id::BIGINT AS related_id FROM v_planstep WHERE {_MACH} AND machine_id IS NULL UNION ALL SELECT plan_id, 'MISSING_TOOL', 'REVIEW_REQUIRED', step_id FROM v_planstep WHERE {_MACH} AND tool_id IS NULL
  UNION ALL SELECT plan_id, 'MISSING_PARAMETER', 'ADVISORY', step_id FROM v_planstep WHERE {_MACH} AND vc IS NULL AND feed_rate IS NULL UNION ALL SELECT plan_id, 'MISSING_INSPECTION', 'BLOCKING', characteristic_id FROM lost)"""


def _critical(shop):
    return shop.v_char.filter("char_type = 'GDT'").select("plan_id", "characteristic_id", "feature_id")


def _covered(shop):
    return shop.v_planstep.filter("covered").select("plan_id", (c("k") * 1000 + c("step_id")).alias("characteristic_id"))


def _items(shop):
    return rec.open_items(shop.v_planstep, rec.uninspected(_critical(shop), _covered(shop)))


@query("uninspected", f"WITH {_CRIT}, {_LOST} SELECT plan_id, characteristic_id FROM lost")
def uninspected(shop):
    return rec.uninspected(_critical(shop), _covered(shop)).select("plan_id", "characteristic_id")


@query("open_items", f"WITH {_CRIT}, {_LOST}, {_ITEMS} SELECT * FROM it")
def open_items(shop):
    return _items(shop)


def _mean_sql(on, empty="0.0"):
    return f"coalesce(avg(CASE WHEN {_MACH} THEN CAST({on} AS INT) END), {empty})"


_PARTS = f"""pa AS (SELECT plan_id, {_mean_sql('machine_id IS NOT NULL')} AS machine, {_mean_sql('tool_id IS NOT NULL')} AS tool, {_mean_sql('holder_id IS NOT NULL', '1.0')} AS holder, {_mean_sql('vc IS NOT NULL')} AS parameter, {_mean_sql('timed')} AS cycle_time, avg(CAST(covered AS INT)) AS inspection, 1.0 AS requirement FROM v_planstep GROUP BY plan_id),
  pm AS (SELECT *, (machine + tool + holder + parameter + cycle_time + inspection + requirement) / 7 AS completeness FROM pa), pc AS (SELECT *, CASE WHEN completeness >= 0.95 THEN 'COMPLETE' WHEN completeness >= 0.80 THEN 'MOSTLY_COMPLETE' WHEN completeness >= 0.50 THEN 'PARTIALLY_COMPLETE' ELSE 'INCOMPLETE' END AS band FROM pm),
  ni AS (SELECT plan_id, count(*) FILTER (WHERE severity = 'BLOCKING') AS blocking, count(*) FILTER (WHERE severity = 'REVIEW_REQUIRED') AS review, count(*) FILTER (WHERE category = 'MISSING_INSPECTION') AS lost FROM it GROUP BY plan_id),
  g AS (SELECT pc.plan_id, completeness, band, coalesce(blocking, 0) AS blocking, coalesce(review, 0) AS review, coalesce(ni.lost, 0) AS lost, CASE WHEN blocking > 0 THEN 'BLOCKED' WHEN band = 'INCOMPLETE' THEN 'INCOMPLETE' WHEN review > 0 OR completeness < 0.80 THEN 'REVIEW_REQUIRED' ELSE 'READY_FOR_ENGINEERING_REVIEW' END AS gate FROM pc LEFT JOIN ni USING (plan_id))"""


@query("release_gates", f"WITH {_CRIT}, {_LOST}, {_ITEMS}, {_PARTS} SELECT plan_id, round(completeness + 1e-9, 6) AS completeness, band, blocking, review, gate FROM g")
def release_gates(shop):
    """The mean of seven shares, its band, and the gate."""
    g = rec.release_gate(rec.completeness(shop.v_planstep), _items(shop))
    return g.select("plan_id", r6(c("completeness")).alias("completeness"), "band", "blocking", "review", "gate")


@query("plan_findings", f"""WITH {_CRIT}, {_LOST}, {_ITEMS}, {_PARTS}, o AS (SELECT plan_id, count(operation) AS n_ops FROM v_planstep GROUP BY plan_id)
  SELECT plan_id, 'V-002' AS code, 'REVIEW_REQUIRED' AS severity, 1::BIGINT AS n FROM g JOIN o USING (plan_id) WHERE n_ops = 0 UNION ALL SELECT plan_id, 'V-003', 'BLOCKING', lost FROM g WHERE lost > 0 UNION ALL SELECT plan_id, 'V-004', 'BLOCKING', blocking FROM g WHERE blocking > 0
  UNION ALL SELECT plan_id, 'V-005', 'REVIEW_REQUIRED', 1 FROM g WHERE gate = 'READY_FOR_ENGINEERING_REVIEW' AND completeness < 0.5 UNION ALL SELECT plan_id, 'V-006', 'ADVISORY', 1 FROM g WHERE completeness < 0.8 UNION ALL SELECT plan_id, 'V-007', 'ADVISORY', 1 FROM g WHERE plan_id % 7 = 0""")
def plan_findings(shop):
    items = _items(shop)
    plans = rec.release_gate(rec.completeness(shop.v_planstep), items).select("plan_id", "completeness", "gate", F.when(c("plan_id") % 7 != 0, c("plan_id").cast("string")).alias("fingerprint"))
    return rec.plan_findings(plans, items, shop.v_planstep)


@query("plan_resources", """SELECT plan_id, 'machine' AS kind, machine_id AS resource_id, string_agg(CAST(step_id AS VARCHAR), ',' ORDER BY step_id) AS step_ids FROM v_planstep WHERE machine_id IS NOT NULL GROUP BY plan_id, machine_id
  UNION ALL SELECT plan_id, 'tool', tool_id, string_agg(CAST(step_id AS VARCHAR), ',' ORDER BY step_id) FROM v_planstep WHERE tool_id IS NOT NULL GROUP BY plan_id, tool_id""")
def plan_resources(shop):
    """The machine list and the tool list of each plan."""
    of = lambda k: rec.used_resources(shop.v_planstep, f"{k}_id").select("plan_id", F.lit(k).alias("kind"), c(f"{k}_id").alias("resource_id"), "step_ids")
    return of("machine").unionByName(of("tool"))


@query("failure_hooks", f"WITH {_CRIT} SELECT p.plan_id, step_id, characteristic_id FROM v_planstep p JOIN cr ON cr.plan_id = p.plan_id AND (cr.feature_id IS NULL OR cr.feature_id = p.feature_id)")
def failure_hooks(shop):
    return rec.failure_hooks(shop.v_planstep, _critical(shop))


@query("nc_handoff", f"SELECT plan_id, step_id, operation, machine_id, tool_id, row_number() OVER (PARTITION BY plan_id ORDER BY step_id, k, s) AS position FROM v_planstep WHERE {_MACH}")
def nc_handoff(shop):
    return rec.handoff(shop.v_planstep)


@query("material_search", """SELECT material_id, designation FROM v_material WHERE iso_group = 'P' AND family = 'ECONOMY' AND (contains(lower(designation), '3') OR contains(lower(alias), 'gear')) ORDER BY iso_group, designation, material_id LIMIT 20 OFFSET 5""")
def material_search(shop):
    """group, family and a substring over designation and aliases, paged."""
    from ..operators import catalog as cat

    m = cat.filter_equal(shop.v_material, iso_group="P", family="ECONOMY")
    found = cat.search(m, "3", "designation").unionByName(cat.search(m, "gear", "alias")).distinct()
    return cat.page(found, ["iso_group", "designation", "material_id"], 5, 20).select("material_id", "designation")


@query("cutting_envelopes", "SELECT iso_group, operation, min(vc_min) AS vc_min, max(vc_max) AS vc_max, count(*) AS n FROM v_material WHERE operation = 'milling' AND tool_material = 'carbide' GROUP BY iso_group, operation")
def cutting_envelopes(shop):
    """the cutting references of materials for an operation and a tool material, and their envelope."""
    from ..operators import catalog as cat

    refs = F.explode(F.array(F.struct("operation", "tool_material", "vc_min", "vc_max"))).alias("r")
    own = cat.filter_equal(shop.v_material.select("material_id", "iso_group", refs).select("material_id", "iso_group", "r.*"), operation="milling", tool_material="carbide")
    return own.groupBy("iso_group", "operation").agg(F.min("vc_min").alias("vc_min"), F.max("vc_max").alias("vc_max"), F.count(F.lit(1)).alias("n"))
