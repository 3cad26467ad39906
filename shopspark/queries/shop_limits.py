"""Machine limits with margins, policy warnings, point lookups, inspection links, features out of notes, item lists in JSON, evidence rows."""

from pyspark.sql import functions as F

from ..operators import nc
from ..operators import validation as val
from . import shop_nc as base
from .registry import query, r6

c = F.col

#: What a step asks of its machine, and the machine's limit.
_ASKED = [("RPM", "1000 * vc / (pi() * d_mm)", "max_rpm"), ("FEED", "1000 * vc / (pi() * d_mm) * feed_rev", "max_feed"), ("POWER", "path_mm / 40", "power_kw"), ("TORQUE", "path_mm / 40 * 60000 / (2 * pi() * (1000 * vc / (pi() * d_mm)))", "torque_nm")]
_LIM = " UNION ALL ".join(f"SELECT plan_id, seq, '{k}' AS check_id, {e} AS asked, CAST({m} AS DOUBLE) AS lim FROM v_step LEFT JOIN v_machine USING (machine_id)" for k, e, m in _ASKED)


def _asked(shop):
    s = shop.v_step.join(shop.v_machine.select("machine_id", "max_rpm", "max_feed", "power_kw", "torque_nm"), "machine_id", "left")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("check_id"), F.expr(e).cast("double").alias("asked"), c(m).cast("double").alias("lim")) for k, e, m in _ASKED])).alias("l")
    return s.select("plan_id", "seq", each).select("plan_id", "seq", "l.*")


@query("machine_margins", f"WITH l AS ({_LIM}) SELECT plan_id, seq, check_id, CASE WHEN asked IS NULL OR lim IS NULL THEN 'INSUFFICIENT_DATA' WHEN asked > lim THEN 'FAIL' ELSE 'PASS' END AS status, round(lim - asked + 1e-9, 6) AS margin, round(asked / lim + 1e-9, 4) AS utilisation FROM l")
def machine_margins(shop):
    """Speed, feed, power and torque against the machine, with margin and utilisation."""
    return _asked(shop).select("plan_id", "seq", "check_id", val.limit_status(c("asked"), c("lim")).alias("status"), r6(c("lim") - c("asked")).alias("margin"), F.round(F.try_divide("asked", "lim") + 1e-9, 4).alias("utilisation"))


@query("feasibility_context", f"""WITH l AS ({_LIM}), s AS (SELECT plan_id, seq, CASE WHEN asked IS NULL OR lim IS NULL THEN 'INSUFFICIENT_DATA' WHEN asked > lim THEN 'FAIL' ELSE 'PASS' END AS status, check_id FROM l)
  SELECT plan_id, seq, CASE WHEN bool_or(status = 'FAIL') THEN 'NOT_FEASIBLE' WHEN bool_or(status = 'INSUFFICIENT_DATA') THEN 'UNDETERMINED' ELSE 'FEASIBLE' END AS context, coalesce(string_agg(check_id, ',' ORDER BY check_id) FILTER (WHERE status <> 'PASS'), '') AS because FROM s GROUP BY plan_id, seq""")
def feasibility_context(shop):
    """A machine's results as one context for feasibility."""
    s = _asked(shop).withColumn("status", val.limit_status(c("asked"), c("lim")))
    state = F.when(F.bool_or(c("status") == "FAIL"), "NOT_FEASIBLE").when(F.bool_or(c("status") == "INSUFFICIENT_DATA"), "UNDETERMINED").otherwise("FEASIBLE")
    return s.groupBy("plan_id", "seq").agg(state.alias("context"), F.array_join(F.sort_array(F.collect_list(F.when(c("status") != "PASS", c("check_id")))), ",").alias("because"))


@query("policy_warnings", "SELECT plan_id, seq, concat_ws(',', CASE WHEN path_mm / d_mm > 10 THEN 'DEPTH_OVER_10_D' END, CASE WHEN dwell_s / d_mm > 2 THEN 'AP_OVER_2_D' END, CASE WHEN feed_rev = 0 AND dwell_s = 0 THEN 'NO_ENGAGEMENT' END) AS warnings FROM v_step")
def policy_warnings(shop):
    """Depth over ten diameters, depth of cut over two, no engagement at all."""
    rules = [("DEPTH_OVER_10_D", c("path_mm") / c("d_mm") > 10), ("AP_OVER_2_D", c("dwell_s") / c("d_mm") > 2), ("NO_ENGAGEMENT", (c("feed_rev") == 0) & (c("dwell_s") == 0))]
    return shop.v_step.select("plan_id", "seq", F.array_join(val.findings(*rules), ",").alias("warnings"))


@query("point_lookups", "SELECT DISTINCT l_suppkey * 2 AS asked_id, machine_type, CASE WHEN machine_id IS NULL THEN 'NOT_FOUND' ELSE 'OK' END AS status FROM lineitem LEFT JOIN v_machine ON machine_id = l_suppkey * 2")
def point_lookups(shop):
    """F16: records by id; an id that isn't there is an error row."""
    asked = shop.lineitem.select((c("l_suppkey") * 2).alias("asked_id")).distinct()
    j = asked.join(shop.v_machine.select(c("machine_id").alias("asked_id"), "machine_type", F.lit("OK").alias("ok")), "asked_id", "left")
    return j.select("asked_id", "machine_type", F.coalesce("ok", F.lit("NOT_FOUND")).alias("status"))


_GAGES = [("CMM", "GDT", "SUITABLE"), ("CMM", "DIMENSION", "SUITABLE"), ("CALIPER", "DIMENSION", "SUITABLE"), ("MICROMETER", "DIMENSION", "SUITABLE"), ("THREAD_GAGE", "THREAD", "SUITABLE"), ("ROUGHNESS_TESTER", "SURFACE_FINISH", "SUITABLE"), ("CALIPER", "GDT", "UNSUITABLE")]


@query("inspection_links", f"WITH i AS (SELECT DISTINCT plan_id, step_id, CASE k % 3 WHEN 0 THEN 'CMM' WHEN 1 THEN 'CALIPER' ELSE 'THREAD_GAGE' END AS gage FROM v_planstep WHERE covered), s(gage, char_type, says) AS (VALUES {', '.join(repr(g) for g in _GAGES)}) SELECT ch.plan_id, ch.characteristic_id, i.step_id, i.gage, coalesce(says, 'REVIEW') AS suitability FROM v_char ch JOIN i USING (plan_id) LEFT JOIN s ON s.gage = i.gage AND s.char_type = ch.char_type")
def inspection_links(shop):
    """Inspections of a plan with its characteristics, and whether the gage suits."""
    i = shop.v_planstep.filter("covered").select("plan_id", "step_id", F.when(c("k") % 3 == 0, "CMM").when(c("k") % 3 == 1, "CALIPER").otherwise("THREAD_GAGE").alias("gage")).distinct()
    s = F.broadcast(shop.spark.createDataFrame(_GAGES, "gage string, char_type string, says string"))
    j = shop.v_char.select("plan_id", "characteristic_id", "char_type").join(i, "plan_id").join(s, ["gage", "char_type"], "left")
    return j.select("plan_id", "characteristic_id", "step_id", "gage", F.coalesce("says", F.lit("REVIEW")).alias("suitability"))


@query("features_from_notes", """SELECT drawing_id, token_id, s, CASE WHEN regexp_matches(text, '^M\\d', 'i') OR regexp_matches(text, 'UNC|NPT|^G\\d') THEN 'THREAD' WHEN regexp_matches(text, 'H\\d+$') THEN 'HOLE' WHEN regexp_matches(text, 'DEEP') THEN 'POCKET' WHEN regexp_matches(text, '^R[az]') THEN 'PLANAR_FACE' END AS feature_type,
  CASE WHEN regexp_matches(text, 'UNC|NPT|^G\\d|H\\d+$') OR regexp_matches(text, '^M\\d', 'i') THEN 0.9 WHEN regexp_matches(text, 'DEEP|^R[az]') THEN 0.6 END AS confidence FROM v_token""")
def features_from_notes(shop):
    """The feature that a requirement's text speaks of."""
    t = c("text")
    thread = t.rlike(r"(?i)^M\d") | t.rlike(r"UNC|NPT|^G\d")
    kind = F.when(thread, "THREAD").when(t.rlike(r"H\d+$"), "HOLE").when(t.contains("DEEP"), "POCKET").when(t.rlike("^R[az]"), "PLANAR_FACE")
    return shop.v_token.select("drawing_id", "token_id", "s", kind.alias("feature_type"), F.when(thread | t.rlike(r"H\d+$"), 0.9).when(t.rlike("DEEP|^R[az]"), 0.6).alias("confidence"))


@query("truth_items", "SELECT fixture, item_id, required FROM v_truth")
def truth_items(shop):
    """Expected items out of one JSON text per fixture; item lists are bounded by a drawing."""
    text = shop.v_truth.groupBy("fixture").agg(F.to_json(F.struct(F.collect_list(F.struct("item_id", "required")).alias("items"))).alias("json"))
    parsed = F.from_json("json", "items array<struct<item_id: bigint, required: boolean>>")
    return text.select("fixture", F.explode(parsed["items"]).alias("i")).select("fixture", "i.*")


@query("path_evidence", f"WITH {base._PROGRAM} SELECT program_id, evidence, CASE evidence WHEN 'FEED_PATH' THEN round(feed_mm, 4) WHEN 'RAPID_PATH' THEN round(rapid_mm, 4) ELSE tool_changes END AS value, CASE WHEN skipped > 0 THEN 'PARTIAL' ELSE 'COMPLETE' END AS state FROM pr CROSS JOIN (VALUES ('FEED_PATH'), ('RAPID_PATH'), ('TOOL_CHANGES')) e(evidence)")
def path_evidence(shop):
    """Evidence rows out of a program's totals."""
    p = nc.programs(nc.motion(shop.v_nc))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("evidence"), v.cast("double").alias("value")) for k, v in (("FEED_PATH", F.round("feed_mm", 4)), ("RAPID_PATH", F.round("rapid_mm", 4)), ("TOOL_CHANGES", c("tool_changes")))])).alias("e")
    return p.select("program_id", each, F.when(c("skipped") > 0, "PARTIAL").otherwise("COMPLETE").alias("state")).select("program_id", "e.*", "state")
