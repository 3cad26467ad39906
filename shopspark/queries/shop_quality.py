"""Tool life, roughness, inspection, routes, matching, rules and events."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import matching, quality, routes
from ..operators.catalog import items
from ..plans.rules import STEP_RULES, apply_rules
from ..streaming import events
from .registry import query, r6

c = F.col


@query("tool_life_summary", "SELECT tool_index, count(*) AS n_obs, min(countdown) AS min_countdown, max(countdown) AS max_countdown, bool_or(countdown = 0) AS has_end, min_by(tool_type, cycle) AS tool_type, min_by(adoc_mm, cycle) AS adoc_mm FROM v_obs GROUP BY tool_index")
def tool_life_summary(shop):
    return quality.tool_summary(shop.v_obs)


@query("tool_life_series", "SELECT tool_index, cycle - 1 AS i, countdown, sensor, sensor - lag(sensor) OVER (PARTITION BY tool_index ORDER BY cycle) AS step FROM v_obs")
def tool_life_series(shop):
    w = W.partitionBy("tool_index").orderBy("cycle")
    return shop.v_obs.select("tool_index", (F.row_number().over(w) - 1).cast("long").alias("i"), "countdown", "sensor", (c("sensor") - F.lag("sensor").over(w)).alias("step"))


@query("tool_life_dataset", "SELECT count(*) AS n, count(DISTINCT tool_index) AS tools, count(*) FILTER (WHERE countdown = 0) AS ends FROM v_obs")
def tool_life_dataset(shop):
    return shop.v_obs.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("tool_index").alias("tools"), F.count_if(c("countdown") == 0).alias("ends"))


_STAGES = "st AS (SELECT replicate_id, stage_id, avg(rq * CASE WHEN unit = 'um' THEN 1e-3 ELSE 1 END) AS rq_mm, CASE WHEN count(ra) = count(*) THEN avg(ra * CASE WHEN unit = 'um' THEN 1e-3 ELSE 1 END) END AS ra_mm, bool_and(validity = 'VALID') AS valid, count(*) AS n FROM v_reading GROUP BY replicate_id, stage_id)"


@query("roughness_stages", f"WITH {_STAGES} SELECT replicate_id, stage_id, round(rq_mm + 1e-9, 6) AS rq_mm, round(ra_mm + 1e-9, 6) AS ra_mm, valid, n FROM st")
def roughness_stages(shop):
    return quality.stage_roughness(shop.v_reading).withColumns({"rq_mm": r6(c("rq_mm")), "ra_mm": r6(c("ra_mm"))})


@query("roughness_lifecycle", f"WITH {_STAGES} SELECT replicate_id, round(avg(rq_mm) + 1e-9, 6) AS rq_mm, round(CASE WHEN count(ra_mm) = count(*) THEN avg(ra_mm) END + 1e-9, 6) AS ra_mm, count(*) AS n_stages FROM st WHERE valid GROUP BY replicate_id")
def roughness_lifecycle(shop):
    return quality.lifecycle_roughness(quality.stage_roughness(shop.v_reading)).withColumns({"rq_mm": r6(c("rq_mm")), "ra_mm": r6(c("ra_mm"))})


_INSP = """ch AS (SELECT *, upper_tol - lower_tol AS width FROM v_char), lv AS (SELECT *, CASE WHEN char_type = 'GDT' OR width <= 0.02 THEN 'CRITICAL' WHEN char_type = 'THREAD' OR width <= 0.1 OR ra_um <= 0.8 THEN 'MAJOR' ELSE 'MINOR' END AS level,
  CASE WHEN char_type = 'THREAD' THEN 'THREAD_GAGE' WHEN char_type = 'SURFACE_FINISH' THEN 'ROUGHNESS_TESTER' WHEN char_type = 'GDT' THEN 'CMM' WHEN width IS NULL THEN 'UNRESOLVED' WHEN width <= 0.02 THEN 'CMM' WHEN width <= 0.1 THEN 'MICROMETER' ELSE 'CALIPER' END AS gage FROM ch)"""


@query("inspection_plan", f"WITH {_INSP} SELECT plan_id, characteristic_id, s, level, gage, CASE level WHEN 'CRITICAL' THEN 'EVERY_PART' WHEN 'MAJOR' THEN '1_IN_5' ELSE '1_IN_20' END AS frequency, CASE WHEN level = 'CRITICAL' THEN 'STOP_AND_CONTAIN' ELSE 'ADJUST_AND_RECHECK' END AS reaction FROM lv")
def inspection_plan(shop):
    return quality.inspection_plan(shop.v_char).select("plan_id", "characteristic_id", "s", "level", "gage", "frequency", "reaction")


@query("plan_completeness", f"""WITH {_INSP}, k AS (SELECT plan_id, avg((nominal IS NOT NULL)::INT) AS a, avg((width IS NOT NULL)::INT) AS b, avg((feature_id IS NOT NULL)::INT) AS f, count(*) FILTER (WHERE level = 'CRITICAL' AND gage = 'UNRESOLVED') AS blocked FROM lv GROUP BY plan_id)
  SELECT plan_id, round((a + b + f) / 3 + 1e-9, 6) AS completeness, CASE WHEN (a + b + f) / 3 >= 0.95 THEN 'COMPLETE' WHEN (a + b + f) / 3 >= 0.8 THEN 'MOSTLY' WHEN (a + b + f) / 3 >= 0.5 THEN 'PARTIAL' ELSE 'SPARSE' END AS band, (a + b + f) / 3 >= 0.8 AND blocked = 0 AS release_ok FROM k""")
def plan_completeness(shop):
    p = quality.inspection_plan(shop.v_char)
    share = lambda x: F.avg(c(x).isNotNull().cast("int"))
    k = p.groupBy("plan_id").agg(((share("nominal") + share("width") + share("feature_id")) / 3).alias("k"), F.count_if((c("level") == "CRITICAL") & (c("gage") == "UNRESOLVED")).alias("blocked"))
    return k.select("plan_id", r6(c("k")).alias("completeness"), F.when(c("k") >= 0.95, "COMPLETE").when(c("k") >= 0.8, "MOSTLY").when(c("k") >= 0.5, "PARTIAL").otherwise("SPARSE").alias("band"), ((c("k") >= 0.8) & (c("blocked") == 0)).alias("release_ok"))


@query("operation_links", "SELECT s.plan_id, s.seq, ch.characteristic_id, CASE WHEN ch.feature_id IS NULL THEN 'GLOBAL' ELSE 'PRODUCES' END AS role FROM v_step s JOIN v_char ch ON ch.plan_id = s.plan_id AND (ch.feature_id IS NULL OR ch.feature_id = s.tool_id * 1000 + s.line_no)")
def operation_links(shop):
    """Characteristics of a step's feature, and of no feature; two equi joins instead of one with OR."""
    s = shop.v_step.select("plan_id", "seq", (c("tool_id") * 1000 + c("line_no")).alias("feature_id"))
    ch = shop.v_char.select("plan_id", "feature_id", "characteristic_id")
    own = s.join(ch, ["plan_id", "feature_id"]).select("plan_id", "seq", "characteristic_id", F.lit("PRODUCES").alias("role"))
    return own.unionByName(s.drop("feature_id").join(ch.filter("feature_id IS NULL").drop("feature_id"), "plan_id").select("plan_id", "seq", "characteristic_id", F.lit("GLOBAL").alias("role")))


@query("virtual_condition", "SELECT plan_id, characteristic_id, s, round(nominal + CASE WHEN s % 2 = 0 THEN lower_tol ELSE upper_tol END, 4) AS mmc, round(nominal + CASE WHEN s % 2 = 0 THEN upper_tol ELSE lower_tol END, 4) AS lmc, round(abs(CASE WHEN s % 2 = 0 THEN lower_tol ELSE upper_tol END), 4) AS bonus FROM v_char WHERE nominal IS NOT NULL AND upper_tol IS NOT NULL")
def virtual_condition(shop):
    d = shop.v_char.filter("nominal IS NOT NULL AND upper_tol IS NOT NULL")
    v = quality.virtual_condition(c("s") % 2 == 0, c("nominal"), c("upper_tol"), c("lower_tol"), F.lit(0.1), F.lit(True))
    return d.withColumn("v", v).select("plan_id", "characteristic_id", "s", F.round("v.mmc", 4).alias("mmc"), F.round("v.lmc", 4).alias("lmc"), F.round("v.bonus", 4).alias("bonus"))


@query("hole_patterns", """WITH h AS (SELECT part_id, round(d_mm, 1) AS d, x, y FROM v_feature WHERE feature_type = 'HOLE'), g AS (SELECT part_id, d, count(*) AS n, avg(x) AS cx, avg(y) AS cy FROM h GROUP BY part_id, d HAVING count(*) >= 2),
  r AS (SELECT part_id, d, any_value(n) AS n, avg(sqrt((x - cx) ** 2 + (y - cy) ** 2)) AS radius, min(sqrt((x - cx) ** 2 + (y - cy) ** 2)) AS lo, max(sqrt((x - cx) ** 2 + (y - cy) ** 2)) AS hi FROM h JOIN g USING (part_id, d) GROUP BY part_id, d)
  SELECT part_id, d, n, round(radius, 4) AS radius, n >= 3 AND radius > 0 AND coalesce((hi - lo) / nullif(radius, 0) < 0.1, false) AS circular FROM r""")
def hole_patterns(shop):
    return quality.hole_patterns(shop.v_feature).select("part_id", "d", "n", F.round("radius", 4).alias("radius"), F.coalesce("circular", F.lit(False)).alias("circular"))


@query("hole_pattern_types", """WITH h AS (SELECT part_id, round(d_mm, 1) AS d, x, y FROM v_feature WHERE feature_type = 'HOLE'), g AS (SELECT part_id, d, count(*) AS n, avg(x) AS cx, avg(y) AS cy FROM h GROUP BY part_id, d HAVING count(*) >= 2), k AS (SELECT h.*, n, x - cx AS dx, y - cy AS dy FROM h JOIN g USING (part_id, d)),
  t AS (SELECT part_id, d, 0.5 * atan2(2 * sum(dx * dy), sum(dx * dx - dy * dy)) AS turn FROM k GROUP BY part_id, d), a AS (SELECT k.*, dx * cos(turn) + dy * sin(turn) AS s, abs(dy * cos(turn) - dx * sin(turn)) AS o, sqrt(dx * dx + dy * dy) AS r FROM k JOIN t USING (part_id, d)),
  b AS (SELECT *, s - lag(s) OVER (PARTITION BY part_id, d ORDER BY s) AS gap FROM a), m AS (SELECT part_id, d, any_value(n) AS n, avg(r) AS r, min(r) AS r0, max(r) AS r1, max(s) - min(s) AS len, max(o) AS o, min(gap) AS g0, max(gap) AS g1, (max(s) - min(s)) / (any_value(n) - 1) AS pitch FROM b GROUP BY part_id, d),
  z AS (SELECT *, CASE WHEN n >= 3 AND r > 0.5 AND greatest(r1 - r, r - r0) < 0.1 * r THEN 'CIRCULAR' WHEN len > 0.5 AND o <= 0.01 * len AND greatest(g1 - pitch, pitch - g0) < 0.1 * pitch THEN 'LINEAR' ELSE 'NONE' END AS kind FROM m)
  SELECT part_id, d, n, kind, CASE WHEN kind = 'CIRCULAR' THEN round(2 * r, 3) END AS pcd_mm, CASE WHEN kind = 'CIRCULAR' THEN round(360.0::DOUBLE / n, 3) END AS pitch_deg, CASE WHEN kind = 'LINEAR' THEN round(pitch, 3) END AS pitch_mm FROM z""")
def hole_pattern_types(shop):
    """Circular and linear hole patterns with diameter, angle and pitch."""
    return quality.pattern_types(shop.v_feature)


@query("route_scores", """SELECT feature_id, route_id, score, n_ops, greatest(0, least(15, CAST(trunc((15 - n_ops * 2) * 0.8) AS INT))) AS capability, CASE WHEN gdt_capable THEN 10 ELSE 5 END AS gdt, greatest(0, 10 - (setups - 1) * 3) AS setup_points, CASE risk WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN -7 ELSE -15 END AS penalty,
  CASE WHEN best_ra <= 2 THEN 1 ELSE 0 END + CASE WHEN best_it <= 9 THEN 1 ELSE 0 END + CASE WHEN gdt_capable THEN 1 ELSE 0 END AS met FROM v_route""")
def route_scores(shop):
    r = shop.v_route
    need = routes.feasibility(c("best_ra"), c("best_it"), c("gdt_capable"), F.lit(2.0), F.lit(9), F.lit(True))
    return r.select("feature_id", "route_id", "score", "n_ops", routes.points(15 - c("n_ops") * 2, 0.8, 15).alias("capability"), F.when(c("gdt_capable"), 10).otherwise(5).alias("gdt"), routes.points(10 - (c("setups") - 1) * 3, 1.0, 10).alias("setup_points"), routes.risk_penalty(c("risk"), 1.5).alias("penalty"), (3 - need["rejections"]).alias("met"))


@query("route_pareto", """WITH r AS (SELECT feature_id, route_id, max(score) AS score, min(n_ops) AS n_ops, min(setups) AS setups FROM v_route GROUP BY feature_id, route_id)
  SELECT a.feature_id, a.route_id, a.score, a.n_ops, a.setups, count(DISTINCT b.route_id) AS dominated_by FROM r a LEFT JOIN r b ON a.feature_id = b.feature_id AND b.score >= a.score AND b.n_ops <= a.n_ops AND b.setups <= a.setups AND (b.score > a.score OR b.n_ops < a.n_ops OR b.setups < a.setups) GROUP BY ALL""")
def route_pareto(shop):
    r = shop.v_route.groupBy("feature_id", "route_id").agg(F.max("score").alias("score"), F.min("n_ops").alias("n_ops"), F.min("setups").alias("setups"))
    return routes.pareto(r, "feature_id", "route_id", ["score"], ["n_ops", "setups"])


@query("route_skyline", """WITH r AS (SELECT *, CASE risk WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END AS risk_no FROM v_route) SELECT feature_id, route_id, score, n_ops, setups, risk FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.feature_id = a.feature_id AND b.score >= a.score AND b.n_ops <= a.n_ops AND b.setups <= a.setups AND b.risk_no <= a.risk_no AND (b.score > a.score OR b.n_ops < a.n_ops OR b.setups < a.setups OR b.risk_no < a.risk_no))""")
def route_skyline(shop):
    """The frontier by score, operations, setups and risk."""
    r = shop.v_route.withColumn("risk_no", F.when(c("risk") == "LOW", 0).when(c("risk") == "MEDIUM", 1).otherwise(2))
    return routes.skyline(r, "feature_id", ["score"], ["n_ops", "setups", "risk_no"]).select("feature_id", "route_id", "score", "n_ops", "setups", "risk")


_SETUPS = ["VMC", "HMC", "LATHE", "GRINDER"]
_PLAN = """WITH st(i, name) AS (VALUES (0, 'VMC'), (1, 'HMC'), (2, 'LATHE'), (3, 'GRINDER')), ms AS (SELECT s, count(*) AS m, string_agg(name, ',' ORDER BY name) AS names FROM range(1, 16) t(s) JOIN st ON (s >> i) & 1 = 1 GROUP BY s),
  ok AS (SELECT r.*, st.i FROM v_partroute r JOIN st ON st.name = r.setup_key WHERE feasible), nf AS (SELECT part_id, count(DISTINCT feature_id) AS n_all FROM v_partroute GROUP BY part_id), ff AS (SELECT part_id, count(DISTINCT feature_id) AS n FROM ok GROUP BY part_id),
  fs AS (SELECT part_id, feature_id, ms.s, m, names, max(score) AS best FROM ok JOIN ms ON (ms.s >> i) & 1 = 1 GROUP BY ALL), ps AS (SELECT part_id, s, m, names, sum(best)::BIGINT - 8 * m AS total, count(*) AS n FROM fs GROUP BY part_id, s, m, names),
  pl AS (SELECT ps.*, row_number() OVER (PARTITION BY part_id ORDER BY total DESC, m, s) AS rank FROM ps JOIN ff USING (part_id, n))"""


@query("best_routes", f"{_PLAN} SELECT nf.part_id, rank, names AS setups, total, coalesce(ff.n, 0) AS n_features, n_all - coalesce(ff.n, 0) AS n_unresolved FROM nf LEFT JOIN ff USING (part_id) LEFT JOIN (SELECT * FROM pl WHERE rank <= 2) pl USING (part_id)")
def best_routes(shop):
    """A part's two best plans over all its features, with shared setups."""
    return routes.best_routes(shop.v_partroute, _SETUPS, 8, 2)[0]


@query("best_route_choices", f"{_PLAN}, ch AS (SELECT ok.part_id, feature_id, route_id, setup_key, score, row_number() OVER (PARTITION BY ok.part_id, feature_id ORDER BY score DESC, n_ops, route_id, setup_key) AS n FROM ok JOIN pl ON pl.part_id = ok.part_id AND rank = 1 AND (s >> i) & 1 = 1) SELECT part_id, feature_id, route_id, setup_key, score FROM ch WHERE n = 1")
def best_route_choices(shop):
    """The route that a part's best plan takes for each feature, by setup."""
    return routes.best_routes(shop.v_partroute, _SETUPS, 8)[1].select("part_id", "feature_id", "route_id", "setup_key", "score")


@query("route_top", "SELECT feature_id, route_id, score, n_ops, setups, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY score DESC, n_ops, route_id, setups) AS rn FROM v_route) WHERE rn <= 3")
def route_top(shop):
    return routes.top_k(shop.v_route.select("feature_id", "route_id", "score", "n_ops", "setups"), "feature_id", 3, c("score").desc(), c("n_ops"), c("route_id"), c("setups"))


@query("route_sequences", "SELECT feature_id, route_id, n_ops, score, CASE operations WHEN 'drilling;reaming' THEN 'drilling;boring;reaming' WHEN 'milling;grinding' THEN 'milling;semi_finishing;grinding' ELSE operations END AS ops, operations = 'drilling;boring;honing' AS in_order FROM v_route WHERE operations NOT LIKE '%lapping%'")
def route_sequences(shop):
    ops = items(c("operations"))
    put = routes.with_predecessors(ops, [("reaming", "boring"), ("grinding", "semi_finishing")])
    ordered = (F.array_position(ops, "boring") > 0) & (F.array_position(ops, "boring") < F.array_position(ops, "honing"))
    return shop.v_route.filter(~F.arrays_overlap(ops, F.array(F.lit("lapping")))).select("feature_id", "route_id", "n_ops", "score", F.array_join(put, ";").alias("ops"), ordered.alias("in_order"))


@query("what_if", """WITH s(strategy, w) AS (VALUES ('baseline', 1.0), ('minimum_setup', 1.5), ('lowest_risk', 0.7)), v AS (SELECT strategy, feature_id, max(CAST(trunc(score * w) AS BIGINT)) AS best FROM v_route, s GROUP BY strategy, feature_id), a AS (SELECT strategy, sum(best)::BIGINT AS total FROM v GROUP BY strategy) SELECT strategy, total, (total - (SELECT total FROM a WHERE strategy = 'baseline'))::BIGINT AS delta FROM a""")
def what_if(shop):
    """Strategies are three rows; the best score per feature is found once, since each weight keeps the order of scores."""
    weights = {"baseline": 1.0, "minimum_setup": 1.5, "lowest_risk": 0.7}
    best = shop.v_route.groupBy("feature_id").agg(F.max("score").alias("b"))
    sums = best.agg(*[F.sum((c("b") * w).cast("long")).alias(k) for k, w in weights.items()])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(k).alias("strategy"), c(k).alias("total"), (c(k) - c("baseline")).alias("delta")) for k in weights])).alias("r")).select("r.*")


_BARE = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_NORMAL = "lower(trim(regexp_replace({0}, '\\s+', ' ', 'g')))"
_UNIT = "CASE WHEN lower(trim({0})) IN ('mm', 'millimetre', 'millimeter') THEN 'mm' ELSE coalesce(lower(trim({0})), '') END"
_DIMS = ", ".join(f"'{x}'" for x in matching.DIMENSIONS)
#: Candidates (m), then one-to-one matches (mm): finding after finding takes the best item that is left.
_MATCH = f"""m AS (SELECT f.run_id, f.fixture, f.finding_no, t.item_id, min(CASE WHEN {_BARE.format('f.raw_text')} = {_BARE.format('t.expected_text')} THEN 1 WHEN {_NORMAL.format('f.raw_text')} = {_NORMAL.format('t.expected_text')} THEN 2 ELSE 3 END) AS level FROM v_found f JOIN v_truth t ON f.fixture = t.fixture
    AND ({_NORMAL.format('f.raw_text')} = {_NORMAL.format('t.expected_text')} OR (t.feature_type IN ({_DIMS}) AND {_BARE.format('f.value')} = {_BARE.format('t.value')} AND {_UNIT.format('f.unit')} = {_UNIT.format('t.unit')})) GROUP BY ALL),
  cd AS (SELECT *, row_number() OVER (PARTITION BY run_id, fixture ORDER BY finding_no) AS k FROM (SELECT run_id, fixture, finding_no, list(item_id ORDER BY level, item_id) AS cand FROM m GROUP BY ALL)),
  gr AS (SELECT DISTINCT run_id, fixture, 0::BIGINT AS k, []::BIGINT[] AS taken, NULL::BIGINT AS finding_no, NULL::BIGINT AS item_id FROM cd
    UNION ALL SELECT run_id, fixture, k, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick) END, finding_no, pick FROM (SELECT gr.run_id, gr.fixture, cd.k, gr.taken, cd.finding_no, [x FOR x IN cd.cand IF NOT list_contains(gr.taken, x)][1] AS pick FROM gr JOIN cd ON cd.run_id = gr.run_id AND cd.fixture = gr.fixture AND cd.k = gr.k + 1)),
  mm AS (SELECT m.*, t.required FROM gr JOIN m USING (run_id, fixture, finding_no, item_id) JOIN v_truth t USING (item_id))"""


def matched(shop):
    return matching.greedy(matching.match_levels(shop.v_found, shop.v_truth))


@query("match_levels", f"WITH RECURSIVE {_MATCH} SELECT run_id, fixture, finding_no, item_id, level FROM m")
def match_levels(shop):
    """What may match, at EXACT, NORMALISED or SEMANTIC level."""
    return matching.match_levels(shop.v_found, shop.v_truth)


@query("finding_matches", f"WITH RECURSIVE {_MATCH} SELECT run_id, fixture, finding_no, item_id, level FROM mm")
def finding_matches(shop):
    """One-to-one matches, also where findings compete for an item."""
    return matched(shop)


@query("recognition_score", f"""WITH RECURSIVE {_MATCH}, g AS (SELECT run_id, count(*) AS tp, count(*) FILTER (WHERE required) AS rq, count(*) FILTER (WHERE level = 1) AS n_exact FROM mm GROUP BY run_id), f AS (SELECT run_id, count(*) AS n FROM v_found GROUP BY run_id), t AS (SELECT count(*) AS n, count(*) FILTER (WHERE required) AS r FROM v_truth)
  SELECT f.run_id, tp, f.n - tp AS fp, t.n - tp AS fn, t.r - rq AS critical_missed, n_exact, round(tp / CAST(f.n AS DOUBLE), 6) AS precision, round(tp / CAST(t.n AS DOUBLE), 6) AS recall FROM f JOIN g USING (run_id), t""")
def recognition_score(shop):
    return matching.score(shop.v_found, shop.v_truth, matched(shop))


@query("item_stability", f"WITH RECURSIVE {_MATCH}, k AS (SELECT item_id, count(DISTINCT run_id) AS runs FROM mm GROUP BY item_id) SELECT t.item_id, coalesce(runs, 0) AS runs, coalesce(runs, 0) = (SELECT count(DISTINCT run_id) FROM v_found) AS in_all FROM v_truth t LEFT JOIN k USING (item_id)")
def item_stability(shop):
    m = matched(shop).groupBy("item_id").agg(F.count_distinct("run_id").alias("runs"))
    n = shop.v_found.agg(F.count_distinct("run_id").alias("n"))
    d = shop.v_truth.select("item_id").join(m, "item_id", "left").join(n, how="cross")
    return d.select("item_id", F.coalesce("runs", F.lit(0).cast("long")).alias("runs"), (F.coalesce("runs", F.lit(0).cast("long")) == c("n")).alias("in_all"))


@query("step_rules", """SELECT plan_id, seq, CASE WHEN vc > 0 THEN 'PASS' ELSE 'FAIL' END AS positive_speed, CASE WHEN d_mm IS NULL THEN 'INSUFFICIENT_DATA' WHEN d_mm BETWEEN 3 AND 40 THEN 'PASS' ELSE 'FAIL' END AS diameter_range, CASE WHEN d_mm IS NULL THEN 'INSUFFICIENT_DATA' WHEN path_mm / d_mm <= 10 THEN 'PASS' ELSE 'WARNING' END AS deep_hole,
  CASE WHEN dwell_s IS NULL OR rapid_mm IS NULL THEN 'INSUFFICIENT_DATA' WHEN dwell_s <= 6 THEN 'PASS' ELSE 'FAIL' END AS dwell_limit FROM v_step""")
def step_rules(shop):
    d = apply_rules(shop.v_step, STEP_RULES.all())
    return d.select("plan_id", "seq", *[c(f"{r.rule_id}.status").alias(r.rule_id) for r in STEP_RULES.all()])


@query("review_state", "SELECT detection_id, arg_max(action, (ts, event_id)) AS action, arg_max(value, (ts, event_id)) AS value, count(*) AS n_events FROM v_event GROUP BY detection_id")
def review_state(shop):
    return events.latest_state(shop.v_event)


@query("status_replay", None)
def status_replay(shop):
    to = F.when(c("action") == "confirm", "ENGINEER_REVIEWED").when(c("action") == "edit", "APPROVED").when(c("action") == "reject", "REJECTED").otherwise("SUPERSEDED")
    return events.replay(shop.v_event.select(c("detection_id").alias("plan_id"), "event_id", "ts", to.alias("to_status"))).groupBy("from_status", "to_status", "legal").agg(F.count(F.lit(1)).alias("n"))
