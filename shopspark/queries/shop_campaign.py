"""Campaign scores, route benchmark, points, faces, reach, schedule audit."""

from pyspark.sql import functions as F

from ..operators import campaign as cp
from ..operators import intervals as iv
from ..operators import matching
from . import shop_candidates as sc
from . import shop_planning as sp
from . import shop_quality as sq
from .registry import query, r6

c = F.col

_RUNS = f"""{sq._MATCH}, h AS (SELECT fixture, run_id, count(*) AS tp FROM mm GROUP BY ALL), fn AS (SELECT fixture, run_id, count(*) AS n_found FROM v_found GROUP BY ALL), tn AS (SELECT fixture, count(*) AS n_items FROM v_truth GROUP BY fixture),
  sr AS (SELECT CASE WHEN fixture % 2 = 0 THEN 'CORE' ELSE 'EXTENDED' END AS class, fixture, run_id, coalesce(tp, 0) AS tp, n_found, n_items, CAST(20 + (fixture * 37 + run_id * 11) % 300 AS DOUBLE) AS seconds FROM fn JOIN tn USING (fixture) LEFT JOIN h USING (fixture, run_id)),
  cm AS (SELECT class, fixture, grouping(class, fixture) AS level, count(*) AS runs, round(sum(tp) / sum(n_items), 6) AS recall, round(sum(tp) / sum(n_found), 6) AS precision, median(seconds) AS median_s, list_sort(list(seconds))[least(CAST(floor(count(*) * 0.9) AS BIGINT), count(*) - 1) + 1] AS p90_s, max(seconds) AS worst_s FROM sr GROUP BY ROLLUP (class, fixture))"""


def _scores(shop):
    m = sq.matched(shop)
    h = m.groupBy("fixture", "run_id").agg(F.count(F.lit(1)).alias("tp"))
    n = shop.v_found.groupBy("fixture", "run_id").agg(F.count(F.lit(1)).alias("n_found")).join(shop.v_truth.groupBy("fixture").agg(F.count(F.lit(1)).alias("n_items")), "fixture")
    d = n.join(h, ["fixture", "run_id"], "left").na.fill(0, ["tp"])
    return d.select(F.when(c("fixture") % 2 == 0, "CORE").otherwise("EXTENDED").alias("class"), "fixture", "run_id", "tp", "n_found", "n_items", (20 + (c("fixture") * 37 + c("run_id") * 11) % 300).cast("double").alias("seconds"))


@query("campaign_totals", f"WITH RECURSIVE {_RUNS} SELECT * FROM cm")
def campaign_totals(shop):
    """Pooled scores per fixture, class and campaign."""
    return cp.campaign(_scores(shop)).withColumn("level", c("level").cast("long"))


@query("campaign_thresholds", f"""WITH RECURSIVE {_RUNS} SELECT class, fixture, level, 'RECALL' AS check_id, recall::DOUBLE AS value, coalesce(recall >= 0.8, false) AS ok FROM cm UNION ALL SELECT class, fixture, level, 'PRECISION', precision, coalesce(precision >= 0.85, false) FROM cm
  UNION ALL SELECT class, fixture, level, 'MEDIAN_S', median_s, coalesce(median_s <= 240, false) FROM cm UNION ALL SELECT class, fixture, level, 'WORST_S', worst_s, coalesce(worst_s <= 480, false) FROM cm""")
def campaign_thresholds(shop):
    """The limits of a campaign."""
    return cp.thresholds(cp.campaign(_scores(shop)).withColumn("level", c("level").cast("long")))


@query("failing_items", f"WITH RECURSIVE {sq._MATCH}, e AS (SELECT fixture, run_id, row_number() OVER (PARTITION BY fixture ORDER BY run_id) AS n FROM (SELECT DISTINCT fixture, run_id FROM v_found)) SELECT e.fixture, t.item_id, count(*) AS missed FROM e JOIN v_truth t ON t.fixture = e.fixture AND t.required WHERE n <= 3 AND NOT EXISTS (SELECT 1 FROM mm WHERE mm.fixture = e.fixture AND mm.run_id = e.run_id AND mm.item_id = t.item_id) GROUP BY e.fixture, t.item_id HAVING count(*) >= 2")
def failing_items(shop):
    """Required items that two of the first three runs miss."""
    return cp.failing_items(shop.v_found, shop.v_truth.filter("required"), sq.matched(shop))


@query("repeated_wrong", f"WITH RECURSIVE {sq._MATCH} SELECT fixture, {sq._NORMAL.format('raw_text')} AS text, count(DISTINCT run_id) AS runs FROM v_found f WHERE NOT EXISTS (SELECT 1 FROM mm WHERE mm.run_id = f.run_id AND mm.fixture = f.fixture AND mm.finding_no = f.finding_no) GROUP BY ALL HAVING count(DISTINCT run_id) >= 2")
def repeated_wrong(shop):
    """Texts that match nothing, in two runs and more."""
    wrong = shop.v_found.join(sq.matched(shop), ["run_id", "fixture", "finding_no"], "left_anti")
    return cp.repeated_wrong(wrong.select("fixture", "run_id", matching.normal(c("raw_text")).alias("text")))


_DIM = f"t.feature_type IN ({sq._DIMS})"
_ACTION = "CASE WHEN finding_no % 3 = 0 THEN NULL WHEN finding_no % 4 < 2 THEN 'ACCEPT' WHEN finding_no % 4 = 2 THEN 'EDIT' ELSE 'REJECT' END"
_SCORED = f"""{sq._MATCH}, it AS (SELECT fixture, count(*) AS n_items, count(*) FILTER (WHERE {_DIM}) AS n_dims, count(*) FILTER (WHERE {_DIM} AND required) AS n_required FROM v_truth t GROUP BY fixture),
  hi AS (SELECT mm.fixture, mm.run_id, count(*) AS tp, count(*) FILTER (WHERE {_DIM}) AS dim_tp, count(*) FILTER (WHERE {_DIM} AND t.required) AS required_tp FROM mm JOIN v_truth t ON t.fixture = mm.fixture AND t.item_id = mm.item_id GROUP BY ALL),
  fo AS (SELECT f.fixture, f.run_id, count(*) FILTER (WHERE f.value IS NOT NULL AND f.unit IS NOT NULL) AS n_dim_looking, count(*) FILTER (WHERE k.item_id IS NULL) AS fp, count(*) FILTER (WHERE k.item_id IS NULL AND f.value IS NOT NULL AND f.unit IS NOT NULL) AS dim_fp,
    count(*) FILTER (WHERE f.action = 'ACCEPT') AS accepted, count(*) FILTER (WHERE f.action = 'EDIT') AS edited, count(*) FILTER (WHERE f.action = 'REJECT') AS rejected, count(*) FILTER (WHERE f.action = 'ACCEPT' AND k.item_id IS NULL) AS accepted_wrong
    FROM (SELECT *, {_ACTION} AS action FROM v_found) f LEFT JOIN mm k USING (run_id, fixture, finding_no) GROUP BY ALL),
  rs AS (SELECT fixture, run_id, coalesce(tp, 0) AS tp, coalesce(n_items, 0) - coalesce(tp, 0) AS fn, fp, coalesce(dim_tp, 0) AS dim_tp, coalesce(n_dims, 0) - coalesce(dim_tp, 0) AS dim_fn, dim_fp, coalesce(n_required, 0) - coalesce(required_tp, 0) AS critical_missed, n_dim_looking, accepted, edited, rejected, accepted_wrong
    FROM fo LEFT JOIN it USING (fixture) LEFT JOIN hi USING (fixture, run_id))"""


def _run_scores(shop):
    reviews = shop.v_found.select("fixture", "run_id", "finding_no", F.expr(_ACTION).alias("action"))
    return cp.run_scores(shop.v_found, shop.v_found, shop.v_truth, sq.matched(shop), reviews, matching.DIMENSIONS)


@query("run_scores", f"WITH RECURSIVE {_SCORED} SELECT * FROM rs")
def run_scores(shop):
    """Hits, misses, dimensions and reviews of each run."""
    return _run_scores(shop)


_RUN_FACTS = {
    "class": "CASE WHEN fixture % 5 = 4 THEN 'CROP' WHEN fixture % 2 = 0 THEN 'CORE' ELSE 'EXTENDED' END", "parent": "CASE WHEN fixture % 5 = 4 THEN fixture - 1 END",
    "seconds": "CASE WHEN fixture % 7 <> 3 THEN CAST(20 + (fixture * 37 + run_id * 11) % 300 AS DOUBLE) END", "good": "(fixture + run_id) % 9 <> 0", "refused": "CASE WHEN (fixture + run_id) % 13 = 0 THEN 1 ELSE 0 END",
}
_DRAWINGS = "SELECT DISTINCT fixture FROM e JOIN v_truth t USING (fixture) WHERE n <= 3 AND t.required AND NOT EXISTS (SELECT 1 FROM mm WHERE mm.fixture = e.fixture AND mm.run_id = e.run_id AND mm.item_id = t.item_id) GROUP BY fixture, t.item_id HAVING count(*) >= 2"


@query("campaign_verdicts", f"""WITH RECURSIVE {_SCORED}, ra AS (SELECT rs.*, {", ".join(f"{v} AS {k}" for k, v in _RUN_FACTS.items())} FROM rs), co AS (SELECT * FROM ra WHERE class = 'CORE' AND parent IS NULL), wh AS (SELECT * FROM ra WHERE parent IS NULL),
  e AS (SELECT fixture, run_id, row_number() OVER (PARTITION BY fixture ORDER BY run_id) AS n FROM (SELECT DISTINCT fixture, run_id FROM v_found)), bad AS ({_DRAWINGS}),
  wr AS (SELECT fixture, {sq._NORMAL.format('raw_text')} AS text FROM v_found f WHERE NOT EXISTS (SELECT 1 FROM mm WHERE mm.run_id = f.run_id AND mm.fixture = f.fixture AND mm.finding_no = f.finding_no) GROUP BY ALL HAVING count(DISTINCT run_id) >= 2),
  gn AS (SELECT coalesce(parent, fixture) AS drawing, round(sum(dim_tp) FILTER (WHERE parent IS NULL) / nullif(sum(dim_tp + dim_fn) FILTER (WHERE parent IS NULL), 0), 6) AS own, round(sum(dim_tp) FILTER (WHERE parent IS NOT NULL) / nullif(sum(dim_tp + dim_fn) FILTER (WHERE parent IS NOT NULL), 0), 6) AS crop FROM ra GROUP BY ALL),
  v AS (SELECT (SELECT count(DISTINCT fixture) FROM co JOIN bad USING (fixture)) AS p1, (SELECT count(*) FROM co) AS n_core, (SELECT round(sum(dim_tp) / nullif(sum(dim_tp + dim_fn), 0), 6) FROM co) AS p2, (SELECT round(sum(tp) / nullif(sum(tp + fp), 0), 6) FROM co) AS p3, (SELECT count(*) > 0 FROM wr) AS several,
    (SELECT round((sum(refused) + count(*) FILTER (WHERE NOT good AND refused = 0)) / nullif(count(*), 0), 6) FROM wh) AS p4, (SELECT median(seconds) FROM wh WHERE good) AS p5, (SELECT max(seconds) FROM wh WHERE good) AS worst,
    (SELECT round(sum(edited + rejected) / nullif(sum(accepted + edited + rejected), 0), 6) FROM co) AS p6, (SELECT coalesce(sum(accepted_wrong), 0) FROM ra) AS p7, (SELECT round(crop - own, 6) FROM gn WHERE own < 0.7 AND crop IS NOT NULL ORDER BY drawing LIMIT 1) AS gain)
  SELECT 'P1' AS check_id, p1::DOUBLE AS value, CASE WHEN n_core = 0 THEN 'INSUFFICIENT_DATA' WHEN p1 < 2 THEN 'PASS' ELSE 'FAIL' END AS state FROM v UNION ALL SELECT 'P2', p2, CASE WHEN p2 IS NULL THEN 'INSUFFICIENT_DATA' WHEN p2 >= 0.7 THEN 'PASS' ELSE 'FAIL' END FROM v
  UNION ALL SELECT 'P3', p3, CASE WHEN p3 IS NULL AND NOT several THEN 'INSUFFICIENT_DATA' WHEN p3 >= 0.75 AND NOT several THEN 'PASS' ELSE 'FAIL' END FROM v UNION ALL SELECT 'P4', p4, CASE WHEN p4 IS NULL THEN 'INSUFFICIENT_DATA' WHEN p4 <= 0.2 THEN 'PASS' ELSE 'FAIL' END FROM v
  UNION ALL SELECT 'P5', p5, CASE WHEN p5 IS NULL THEN 'INSUFFICIENT_DATA' WHEN p5 <= 240 AND worst <= 480 THEN 'PASS' ELSE 'FAIL' END FROM v UNION ALL SELECT 'P6', p6, CASE WHEN p6 IS NULL THEN 'INSUFFICIENT_DATA' WHEN p6 <= 0.4 THEN 'PASS' ELSE 'FAIL' END FROM v
  UNION ALL SELECT 'P7', p7::DOUBLE, CASE WHEN p7 = 0 THEN 'PASS' ELSE 'FAIL' END FROM v UNION ALL SELECT 'RECALL_GAIN', gain, CASE WHEN gain IS NULL THEN 'INSUFFICIENT_DATA' WHEN gain >= 0.15 THEN 'PASS' ELSE 'FAIL' END FROM v""")
def campaign_verdicts(shop):
    """The checks P1 to P7 of a campaign, and what crops gain."""
    runs = _run_scores(shop).withColumns({k: F.expr(v) for k, v in _RUN_FACTS.items()})
    return cp.verdicts(runs, failing_items(shop), repeated_wrong(shop))


_TP = f"tp AS (SELECT * FROM {sc._values(sc._TEMPLATES)} t(feature_type, route, operations, best_ra))"


@query("route_benchmark", f"""WITH {_TP}, f AS (SELECT part_id, feature_id, feature_type, CASE WHEN feature_id % 3 = 0 THEN NULL ELSE depth_mm / 40 END AS ra FROM v_feature), g AS (SELECT part_id, feature_id, route, CASE WHEN route IS NULL THEN 'FEATURE_UNSUPPORTED' WHEN ra IS NOT NULL AND best_ra > ra THEN 'CAPABILITY_GAP' ELSE 'ACCEPTED' END AS outcome FROM f LEFT JOIN tp USING (feature_type)),
  r AS (SELECT part_id, count(*) AS n_routes, round(avg(CAST(outcome <> 'ACCEPTED' AS INT)), 6) AS rejection_rate FROM g WHERE route IS NOT NULL GROUP BY part_id), x AS (SELECT DISTINCT part_id, feature_id, 'R0' AS route FROM v_feature), ok AS (SELECT DISTINCT part_id, feature_id, route FROM g WHERE outcome = 'ACCEPTED'),
  e AS (SELECT x.part_id, round(count(ok.route) / count(*), 6) AS recall FROM x LEFT JOIN ok ON ok.part_id = x.part_id AND ok.feature_id = x.feature_id AND ok.route = x.route GROUP BY x.part_id) SELECT part_id, recall, n_routes, rejection_rate FROM e FULL JOIN r USING (part_id)""")
def route_benchmark(shop):
    """Generated routes against expected ones."""
    return cp.route_benchmark(sc.generated_routes(shop), shop.v_feature.select("part_id", "feature_id", F.lit("R0").alias("route")))


_K, _S = "cos(radians(30))", "sin(radians(30))"


@query("moved_boxes", f"""WITH b AS (SELECT part_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(depth_mm) AS z0, max(depth_mm) AS z1 FROM v_feature GROUP BY part_id),
  q AS (SELECT part_id, z0, z1, (px * {_K} - py * {_S} + 5) / 1000 AS u, (px * {_S} + py * {_K} - 3) / 1000 AS v FROM (SELECT part_id, z0, z1, unnest([x0, x0, x1, x1]) AS px, unnest([y0, y1, y0, y1]) AS py FROM b))
  SELECT part_id, round(min(u) + 1e-9, 6) AS x0, round(min(v) + 1e-9, 6) AS y0, round((z0 + 2) / 1000 + 1e-9, 6) AS z0, round(max(u) + 1e-9, 6) AS x1, round(max(v) + 1e-9, 6) AS y1, round((z1 + 2) / 1000 + 1e-9, 6) AS z1 FROM q GROUP BY part_id, z0, z1""")
def moved_boxes(shop):
    """A part's box after a turn, a shift and a change from mm to m."""
    b = shop.v_feature.groupBy("part_id").agg(*[f(k).alias(k[0] + n) for f, n in ((F.min, "0"), (F.max, "1")) for k in ("x", "y")], F.min("depth_mm").alias("z0"), F.max("depth_mm").alias("z1"))
    low, high = cp.box_after([c("x0"), c("y0"), c("z0")], [c("x1"), c("y1"), c("z1")], 30, (5, -3, 2), 1e-3)
    return b.select("part_id", *[r6(v).alias(k) for k, v in zip(("x0", "y0", "z0", "x1", "y1", "z1"), low + high, strict=True)])


#: A turn by 35 degrees about a tilted axis, with a shift in mm.
_TURN = cp.rotation((1.0, 2.0, 2.0), 35.0, (10.0, -4.0, 2.5))
_ROW = lambda i, x, y, z: " + ".join(f"({_TURN[i][j]!r}::DOUBLE) * {v}" for j, v in enumerate((x, y, z)))
_SPOT = ", ".join(f"round(({_ROW(i, 'x', 'y', 'depth_mm')}) * sc + ({_TURN[i][3]!r}::DOUBLE), 4) AS {k}" for i, k in enumerate("xyz"))
_WAY = ", ".join(f"round({_ROW(i, 0, 0.6, 0.8)}, 6) AS d{k}" for i, k in enumerate("xyz"))


@query("moved_geometry", f"""WITH g AS (SELECT *, CASE part_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 25.4 WHEN 2 THEN 1000 WHEN 3 THEN 10 END::DOUBLE AS sc FROM v_feature), b AS (SELECT part_id, feature_id, d_mm, {_SPOT}, {_WAY}, sc FROM g)
  SELECT part_id, feature_id, part AS part, x, y, z, CASE WHEN part <> 'POINT' THEN dx END AS dx, CASE WHEN part <> 'POINT' THEN dy END AS dy, CASE WHEN part <> 'POINT' THEN dz END AS dz, CASE WHEN part <> 'POINT' THEN round(d_mm / 2 * sc, 4) END AS radius FROM b, (VALUES ('POINT'), ('CURVE'), ('SURFACE')) p(part) WHERE part <> 'SURFACE' OR feature_id % 2 = 0""")
def moved_geometry(shop):
    """Whole parts (points, curves, surfaces) through one matrix, each in its own unit."""
    at = F.struct("x", "y", c("depth_mm").alias("z"))
    way = F.struct(F.lit(0.0).alias("x"), F.lit(0.6).alias("y"), F.lit(0.8).alias("z"))
    shape = lambda kind, name: F.struct(c("feature_id").alias("id"), F.lit(kind).alias("kind"), at.alias("at"), way.alias(name), (c("d_mm") / 2).alias("radius"))
    parts = shop.v_feature.groupBy("part_id").agg(F.struct(
        F.collect_list(F.struct(c("feature_id").alias("id"), at.alias("at"))).alias("points"), F.collect_list(shape("CIRCLE", "along")).alias("curves"),
        F.collect_list(F.when(c("feature_id") % 2 == 0, shape("CYLINDER", "normal"))).alias("surfaces"),
    ).alias("g"))
    unit = F.get(F.array(*map(F.lit, ["mm", "inch", "m", "cm", "parsec"])), (c("part_id") % 5).cast("int"))
    out = parts.withColumn("g", cp.transformed(c("g"), _TURN, unit))
    none = F.lit(None).cast("struct<x:double,y:double,z:double>")
    each = lambda part, items, d, r: out.select("part_id", F.explode(items).alias("i")).select("part_id", c("i.id").alias("feature_id"), F.lit(part).alias("part"), c("i.at").alias("at"), d.alias("d"), r.alias("radius"))
    rows = each("POINT", "g.points", none, F.lit(None).cast("double")).unionByName(each("CURVE", "g.curves", c("i.along"), c("i.radius"))).unionByName(each("SURFACE", "g.surfaces", c("i.normal"), c("i.radius")))
    return rows.select("part_id", "feature_id", "part", *[F.round(f"at.{k}", 4).alias(k) for k in "xyz"], *[F.round(f"d.{k}", 6).alias(f"d{k}") for k in "xyz"], F.round("radius", 4).alias("radius"))


@query("adjacent_faces", "WITH e AS (SELECT DISTINCT l_orderkey AS part_id, l_partkey AS face, l_suppkey % 3 AS edge_id FROM lineitem) SELECT a.part_id, a.face, string_agg(DISTINCT CAST(b.face AS VARCHAR), ',' ORDER BY CAST(b.face AS VARCHAR)) AS neighbours FROM e a JOIN e b ON a.part_id = b.part_id AND a.edge_id = b.edge_id AND a.face <> b.face GROUP BY a.part_id, a.face")
def adjacent_faces(shop):
    """Faces that share an edge."""
    e = shop.lineitem.select(c("l_orderkey").alias("part_id"), c("l_partkey").alias("face"), (c("l_suppkey") % 3).alias("edge_id"))
    out = cp.adjacent_faces(e)
    return out.withColumn("neighbours", F.array_join(F.array_sort(F.split("neighbours", ",")), ","))


@query("tool_reach", "SELECT part_id, feature_id, tool_id, CASE WHEN length_mm IS NULL THEN 'UNKNOWN' WHEN t.d_mm > f.d_mm THEN 'TOO_WIDE' WHEN length_mm < depth_mm THEN 'TOO_SHORT' ELSE 'REACHES' END AS reach FROM v_feature f JOIN v_tool t ON t.tool_id = CAST(floor(f.feature_id / 1000) AS BIGINT)")
def tool_reach(shop):
    """Whether a feature's tool gets into it."""
    t = shop.v_tool.select("tool_id", c("d_mm").alias("td"), "length_mm")
    j = shop.v_feature.withColumn("tool_id", F.floor(c("feature_id") / 1000)).join(t, "tool_id")
    return j.select("part_id", "feature_id", "tool_id", cp.reach(c("depth_mm"), c("length_mm"), c("td"), c("d_mm")).alias("reach"))


@query("schedule_audit", f"""WITH {sp._J}, a AS ({sp._MERGE.format(t='v_window')}), p AS (SELECT *, lag(end_s) OVER (PARTITION BY machine_id ORDER BY start_s, operation_id) AS p_end FROM v_job), um AS (SELECT DISTINCT machine_id FROM v_window WHERE machine_id NOT IN (SELECT machine_id FROM v_machine)),
  v AS (SELECT 'OUTSIDE_WINDOW' AS check_id, operation_id::BIGINT AS subject FROM j WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.machine_id = j.machine_id AND a.start_h <= j.s AND a.end_h >= j.e) UNION ALL SELECT 'OVERLAP', operation_id FROM p WHERE start_s < p_end UNION ALL SELECT 'UNKNOWN_MACHINE', machine_id FROM um)
  SELECT check_id, subject, count(*) AS n FROM v GROUP BY ALL""")
def schedule_audit(shop):
    """Violations of all checks of a schedule as rows; windows of unknown machines are errors."""
    overlap = iv.setup_gaps(shop.v_job, shop.spark.createDataFrame([], "from_key string, to_key string, seconds int"), 0).filter("status = 'OVERLAP'")
    unknown = shop.v_window.select("machine_id").distinct().join(shop.v_machine.select("machine_id"), "machine_id", "left_anti")
    out = cp.audit(("OUTSIDE_WINDOW", sp.jobs_outside_windows(shop), "operation_id"), ("OVERLAP", overlap, "operation_id"), ("UNKNOWN_MACHINE", unknown, "machine_id"))
    return out.groupBy("check_id", "subject").agg(F.count(F.lit(1)).alias("n"))
