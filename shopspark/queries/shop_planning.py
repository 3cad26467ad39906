"""Calendars, schedule audit, dependency graphs, cycle time."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.formulas import BASIC
from ..functions.guards import wildcard
from ..operators import graph
from ..operators import intervals as iv
from .registry import query, r6

c = F.col

_MERGE = """SELECT machine_id, min(start_h) AS start_h, max(end_h) AS end_h FROM (SELECT *, sum(n) OVER (PARTITION BY machine_id ORDER BY start_h, end_h) AS i FROM (SELECT *, CASE WHEN start_h <= max(end_h) OVER (PARTITION BY machine_id ORDER BY start_h, end_h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM {t})) GROUP BY machine_id, i"""


@query("merged_windows", _MERGE.format(t="v_window"))
def merged_windows(shop):
    return iv.merge(shop.v_window, "machine_id")


@query("available_windows", f"""WITH a AS ({_MERGE.format(t='v_window')}), b AS ({_MERGE.format(t='v_maint')}),
  p AS (SELECT machine_id, start_h AS t FROM a UNION SELECT machine_id, end_h FROM a UNION SELECT machine_id, start_h FROM b UNION SELECT machine_id, end_h FROM b),
  g AS (SELECT machine_id, t AS start_h, lead(t) OVER (PARTITION BY machine_id ORDER BY t) AS end_h FROM p),
  k AS (SELECT g.* FROM g WHERE end_h IS NOT NULL AND EXISTS (SELECT 1 FROM a WHERE a.machine_id = g.machine_id AND a.start_h <= g.start_h AND a.end_h >= g.end_h) AND NOT EXISTS (SELECT 1 FROM b WHERE b.machine_id = g.machine_id AND b.start_h < g.end_h AND b.end_h > g.start_h))
  {_MERGE.format(t='k')}""")
def available_windows(shop):
    return iv.subtract(shop.v_window, shop.v_maint, "machine_id")


@query("machine_calendars", f"""WITH a AS ({_MERGE.format(t='v_window')}), m AS (SELECT machine_id FROM v_machine),
  x AS (SELECT machine_id, greatest(start_h, 100) AS start_h, least(end_h, 1500) AS end_h FROM a WHERE greatest(start_h, 100) < least(end_h, 1500))
  SELECT m.machine_id, start_h, end_h, false AS whole_horizon FROM m JOIN x USING (machine_id) UNION ALL SELECT machine_id, 100, 1500, true FROM m WHERE machine_id NOT IN (SELECT machine_id FROM v_window)""")
def machine_calendars(shop):
    return iv.calendars(shop.v_machine.select("machine_id"), shop.v_window, "machine_id", 100, 1500)


_J = "j AS (SELECT operation_id, machine_id, operation_id % 700 * 3 AS s, operation_id % 700 * 3 + 1 + machine_id % 8 AS e FROM v_job)"


@query("jobs_outside_windows", f"WITH {_J}, a AS ({_MERGE.format(t='v_window')}) SELECT operation_id, machine_id, s, e FROM j WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.machine_id = j.machine_id AND a.start_h <= j.s AND a.end_h >= j.e)")
def jobs_outside_windows(shop):
    j = shop.v_job.select("operation_id", "machine_id", (c("operation_id") % 700 * 3).alias("s"), (c("operation_id") % 700 * 3 + 1 + c("machine_id") % 8).alias("e"))
    w = iv.merge(shop.v_window, "machine_id").select("machine_id", c("start_h").alias("s"), c("end_h").alias("e"))
    return iv.outside(j, w, "machine_id", "operation_id", 48)


_MATRIX = "(VALUES ('K1', 'K2', 1800), ('K2', 'K1', 2400), ('K1', 'K3', 7200), ('K3', 'K2', 90000), ('K2', 'K2', 60)) mx(f, t, sec)"


@query("setup_spans", """WITH j AS (SELECT operation_id, machine_id, (operation_id % 700 * 3) * 3600 + 1800 AS start_s, (operation_id % 700 * 3) * 3600 + 1800 + 600 * (1 + machine_id % 20) AS end_s, setup_key FROM v_job),
  p AS (SELECT *, lag(setup_key) OVER (PARTITION BY machine_id ORDER BY start_s, operation_id) AS p_key FROM j), q AS (SELECT *, CASE WHEN p_key = 'K1' AND setup_key = 'K2' THEN 2400 WHEN p_key = 'K2' AND setup_key = 'K1' THEN 0 ELSE 900 END AS need FROM p WHERE p_key IS NOT NULL),
  w AS (SELECT DISTINCT machine_id, start_h * 3600 AS s, end_h * 3600 AS e FROM v_window WHERE machine_id % 10 <> 3), x AS (SELECT *, max(e) OVER (PARTITION BY machine_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM w), y AS (SELECT *, sum(CASE WHEN s <= pe THEN 0 ELSE 1 END) OVER (PARTITION BY machine_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM x),
  m AS (SELECT machine_id, min(s) AS s, max(e) AS e FROM y GROUP BY machine_id, g), r AS (SELECT q.machine_id, operation_id, start_s - need AS span_s, end_s FROM q WHERE need > 0)
  SELECT r.*, CASE WHEN NOT EXISTS (SELECT 1 FROM m WHERE m.machine_id = r.machine_id) THEN 'NO_CALENDAR' WHEN EXISTS (SELECT 1 FROM m WHERE m.machine_id = r.machine_id AND m.s <= span_s AND end_s <= m.e) THEN 'FITS' WHEN EXISTS (SELECT 1 FROM m WHERE m.machine_id = r.machine_id AND m.s <= span_s AND span_s < m.e) THEN 'CROSSES' ELSE 'OUTSIDE' END AS state FROM r""")
def setup_spans(shop):
    """Setups with their jobs inside one window of the machine."""
    start = (c("operation_id") % 700 * 3) * 3600 + 1800
    jobs = shop.v_job.select("operation_id", "machine_id", start.alias("start_s"), (start + 600 * (1 + c("machine_id") % 20)).alias("end_s"), "setup_key")
    matrix = shop.spark.createDataFrame([("K1", "K2", 2400), ("K2", "K1", 0)], "from_key string, to_key string, seconds long")
    windows = shop.v_window.filter("machine_id % 10 <> 3").select("machine_id", (c("start_h") * 3600).alias("start_s"), (c("end_h") * 3600).alias("end_s"))
    return iv.setup_spans(jobs, matrix, 900, windows)


@query("setup_gaps", f"""WITH p AS (SELECT *, lag(end_s) OVER w AS p_end, lag(setup_key) OVER w AS p_key FROM v_job WINDOW w AS (PARTITION BY machine_id ORDER BY start_s, operation_id))
  SELECT machine_id, operation_id, start_s - p_end AS gap_s, coalesce(sec, 900) AS need_s, CASE WHEN start_s < p_end THEN 'OVERLAP' WHEN start_s - p_end < coalesce(sec, 900) THEN 'SETUP_TOO_SHORT' ELSE 'OK' END AS status FROM p LEFT JOIN {_MATRIX} ON f = p_key AND t = setup_key WHERE p_end IS NOT NULL""")
def setup_gaps(shop):
    matrix = shop.spark.createDataFrame([("K1", "K2", 1800), ("K2", "K1", 2400), ("K1", "K3", 7200), ("K3", "K2", 90000), ("K2", "K2", 60)], "from_key string, to_key string, seconds int")
    return iv.setup_gaps(shop.v_job, matrix, 900)


@query("assignment_completeness", """WITH r AS (SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_orderkey % 10 <> 3), a AS (SELECT l_orderkey AS id, count(*) AS n FROM lineitem WHERE l_orderkey % 9 <> 1 GROUP BY 1)
  SELECT id, CASE WHEN n IS NULL THEN 'MISSING' WHEN r.id IS NULL THEN 'UNKNOWN' ELSE 'DUPLICATE' END AS violation FROM (SELECT coalesce(r.id, a.id) AS id, r.id AS rid, n FROM r FULL JOIN a ON r.id = a.id) x LEFT JOIN r USING (id) WHERE n IS NULL OR rid IS NULL OR n > 1""")
def assignment_completeness(shop):
    return iv.completeness(shop.orders.filter("o_orderkey % 10 <> 3").select(c("o_orderkey").alias("id")), shop.lineitem.filter("l_orderkey % 9 <> 1").select(c("l_orderkey").alias("id")), "id")


@query("precedence_violations", "SELECT a.plan_id, a.seq, b.seq AS successor FROM v_step a JOIN v_step b ON a.plan_id = b.plan_id AND b.seq = a.seq + 1 WHERE a.path_mm / 100 + a.seq * 3 > (b.seq - 1) * 3 + b.vc / 10")
def precedence_violations(shop):
    s = shop.v_step.select("plan_id", "seq", (c("path_mm") / 100 + c("seq") * 3).alias("fin"), ((c("seq") - 1) * 3 + c("vc") / 10).alias("beg"))
    b = s.select("plan_id", (c("seq") - 1).alias("seq"), c("seq").alias("successor"), c("beg").alias("b2"))
    return s.join(b, ["plan_id", "seq"]).filter("fin > b2").select("plan_id", "seq", "successor")


_EDGES = "e AS (SELECT plan_id, seq AS src, seq + 1 AS dst FROM v_step WHERE tool_id % 5 <> 0 UNION SELECT plan_id, seq, seq - 1 FROM v_step WHERE tool_id % 37 = 0 AND seq > 1)"


def _edges(shop):
    s = shop.v_step
    on = s.filter("tool_id % 5 <> 0").select("plan_id", c("seq").alias("src"), (c("seq") + 1).alias("dst"))
    return on.union(s.filter("tool_id % 37 = 0 AND seq > 1").select("plan_id", "seq", c("seq") - 1)).distinct()


@query("cyclic_steps", f"WITH RECURSIVE {_EDGES}, t AS (SELECT plan_id, src, dst FROM e UNION SELECT t.plan_id, t.src, e.dst FROM t JOIN e ON e.plan_id = t.plan_id AND e.src = t.dst), k AS (SELECT DISTINCT plan_id, src AS node FROM t WHERE src = dst) SELECT plan_id, node FROM k UNION SELECT t.plan_id, t.dst FROM t JOIN k ON k.plan_id = t.plan_id AND k.node = t.src")
def cyclic_steps(shop):
    return graph.cyclic_nodes(_edges(shop))


@query("step_ancestors", f"WITH RECURSIVE {_EDGES}, t AS (SELECT plan_id, src, dst FROM e UNION SELECT t.plan_id, t.src, e.dst FROM t JOIN e ON e.plan_id = t.plan_id AND e.src = t.dst) SELECT plan_id, src, dst FROM t")
def step_ancestors(shop):
    return graph.ancestors(_edges(shop))


@query("step_levels", "WITH RECURSIVE e AS (SELECT plan_id, seq AS src, seq + 1 AS dst FROM v_step WHERE tool_id % 5 <> 0), n AS (SELECT plan_id, src AS node FROM e UNION SELECT plan_id, dst FROM e), t AS (SELECT plan_id, node, 0 AS d FROM n UNION SELECT t.plan_id, e.dst, d + 1 FROM t JOIN e ON e.plan_id = t.plan_id AND e.src = t.node) SELECT plan_id, node, max(d) AS level FROM t GROUP BY plan_id, node")
def step_levels(shop):
    e = shop.v_step.filter("tool_id % 5 <> 0").select("plan_id", c("seq").alias("src"), (c("seq") + 1).alias("dst"))
    return graph.levels(e, e.select("plan_id", c("src").alias("node")).union(e.select("plan_id", "dst")).distinct())


@query("setup_groups", "WITH RECURSIVE p AS (SELECT DISTINCT c_custkey AS a, c_custkey - c_custkey % 7 + c_nationkey % 7 AS b FROM customer), q AS (SELECT a, b FROM p UNION SELECT b, a FROM p), t AS (SELECT a AS node, b AS o FROM q UNION SELECT t.node, q.b FROM t JOIN q ON q.a = t.o) SELECT node, least(node, min(o)) AS grp FROM t GROUP BY node")
def setup_groups(shop):
    return graph.groups(shop.customer.select(c("c_custkey").alias("a"), (c("c_custkey") - c("c_custkey") % 7 + c("c_nationkey") % 7).alias("b")))


@query("drilled_before", "SELECT plan_id, seq, operation, coalesce(max((operation = 'drilling')::INT) OVER (PARTITION BY plan_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS drilled FROM v_step")
def drilled_before(shop):
    w = W.partitionBy("plan_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    return shop.v_step.select("plan_id", "seq", "operation", F.coalesce(F.bool_or(c("operation") == "drilling").over(w), F.lit(False)).alias("drilled"))


@query("process_flow", "SELECT plan_id, seq::BIGINT AS node, coalesce(lead(seq) OVER (PARTITION BY plan_id ORDER BY seq), -1)::BIGINT AS next_node FROM v_step UNION ALL SELECT DISTINCT plan_id, 0, 1 FROM v_step")
def process_flow(shop):
    s = shop.v_step
    w = W.partitionBy("plan_id").orderBy("seq")
    on = s.select("plan_id", c("seq").cast("long").alias("node"), F.coalesce(F.lead("seq").over(w), F.lit(-1)).cast("long").alias("next_node"))
    return on.unionByName(s.select("plan_id", F.lit(0).cast("long").alias("node"), F.lit(1).cast("long").alias("next_node")).distinct())


@query("cycle_time", """WITH k AS (SELECT plan_id, seq, path_mm / 100 AS cutting, rapid_mm / 10000 AS rapid, dwell_s / 60 AS dwell FROM v_step), u AS (SELECT plan_id, 'cutting' AS part, cutting AS t FROM k UNION ALL SELECT plan_id, 'rapid', rapid FROM k UNION ALL SELECT plan_id, 'dwell', dwell FROM k)
  SELECT plan_id, round(sum(t) + 1e-9, 6) AS known_min, count(*) FILTER (WHERE t IS NULL) AS n_unknown, string_agg(DISTINCT part, ',' ORDER BY part) FILTER (WHERE t IS NULL) AS unknown, CASE WHEN count(*) = count(t) THEN round(sum(t) + 1e-9, 6) END AS total_min, CASE WHEN count(*) = count(t) THEN round(sum(t) / 25 + 1e-9, 6) END AS per_part_min FROM u GROUP BY plan_id""")
def cycle_time(shop):
    """Known components only; a total stands only where every component is known."""
    parts = F.explode(F.array(*[F.struct(F.lit(n).alias("part"), e.alias("t")) for n, e in (("cutting", c("path_mm") / 100), ("rapid", c("rapid_mm") / 10000), ("dwell", c("dwell_s") / 60))])).alias("p")
    u = shop.v_step.select("plan_id", parts).select("plan_id", "p.*")
    full = F.count(F.lit(1)) == F.count("t")
    out = u.groupBy("plan_id").agg(F.sum("t").alias("s"), F.count_if(c("t").isNull()).alias("n_unknown"), F.nullif(F.array_join(F.sort_array(F.collect_set(F.when(c("t").isNull(), c("part")))), ","), F.lit("")).alias("unknown"), full.alias("full"))
    return out.select("plan_id", r6(c("s")).alias("known_min"), "n_unknown", "unknown", F.when(c("full"), r6(c("s"))).alias("total_min"), F.when(c("full"), r6(c("s") / 25)).alias("per_part_min"))


@query("reference_ranges", """WITH s AS (SELECT plan_id, seq, vc, operation, iso_group FROM v_step), j AS (SELECT s.*, r.record_id, min_value, max_value, row_number() OVER (PARTITION BY plan_id, seq ORDER BY record_id) AS n FROM s JOIN v_ref r ON parameter_type = 'cutting_speed' AND (r.operation IS NULL OR r.operation = s.operation) AND (r.iso_group IS NULL OR s.iso_group IS NULL OR r.iso_group = s.iso_group))
  SELECT plan_id, seq, record_id, CASE WHEN record_id IS NULL THEN 'INSUFFICIENT_DATA' WHEN vc < min_value THEN 'BELOW_REFERENCE_RANGE' WHEN vc > max_value THEN 'ABOVE_REFERENCE_RANGE' ELSE 'WITHIN_REFERENCE_RANGE' END AS status, (min_value + max_value) / 2 AS midpoint FROM s LEFT JOIN (SELECT plan_id, seq, record_id, min_value, max_value FROM j WHERE n = 1) USING (plan_id, seq)""")
def reference_ranges(shop):
    """The first matching record decides. Scopes are few, so records are reduced per scope before the steps meet them."""
    s = shop.v_step.select("plan_id", "seq", "vc", "operation", "iso_group")
    scopes = s.select("operation", "iso_group").distinct()
    r = shop.v_ref.filter("parameter_type = 'cutting_speed'").select("record_id", c("operation").alias("ro"), c("iso_group").alias("ri"), "min_value", "max_value")
    first = scopes.join(r, wildcard(c("ro"), c("operation")) & wildcard(c("ri"), c("iso_group"))).groupBy("operation", "iso_group").agg(F.min_by(F.struct("record_id", "min_value", "max_value"), "record_id").alias("r"))
    j = s.alias("s").join(first.alias("f"), c("s.operation").eqNullSafe(c("f.operation")) & c("s.iso_group").eqNullSafe(c("f.iso_group")), "left")
    status = F.when(c("r").isNull(), "INSUFFICIENT_DATA").when(c("vc") < c("r.min_value"), "BELOW_REFERENCE_RANGE").when(c("vc") > c("r.max_value"), "ABOVE_REFERENCE_RANGE").otherwise("WITHIN_REFERENCE_RANGE")
    return j.select("plan_id", "seq", c("r.record_id").alias("record_id"), status.alias("status"), ((c("r.min_value") + c("r.max_value")) / 2).alias("midpoint"))


_STATUS = """f AS (SELECT plan_id, seq, CASE WHEN d_mm IS NULL OR max_rpm IS NULL THEN 'INSUFFICIENT_DATA' WHEN 1000 * vc / (pi() * d_mm) > max_rpm THEN 'EXCEEDS_LIMIT' ELSE 'WITHIN_LIMIT' END AS status FROM v_step LEFT JOIN v_machine USING (machine_id))"""


@query("flagship_step_check", f"WITH {_STATUS} SELECT plan_id, count(*) AS n_steps, count(*) FILTER (WHERE status = 'WITHIN_LIMIT') AS n_within, count(*) FILTER (WHERE status = 'EXCEEDS_LIMIT') AS n_exceeds, count(*) FILTER (WHERE status = 'INSUFFICIENT_DATA') AS n_unknown, CASE WHEN bool_or(status = 'EXCEEDS_LIMIT') THEN 'BLOCKED' WHEN bool_or(status = 'INSUFFICIENT_DATA') THEN 'INSUFFICIENT_DATA' ELSE 'COMPLETE' END AS plan_status FROM f GROUP BY plan_id")
def flagship_step_check(shop):
    """Spindle speed of each step against its machine's limit, rolled up per plan."""
    s = shop.v_step.select("plan_id", "machine_id", BASIC["spindle_rpm"].value(vc=c("vc"), d=c("d_mm")).alias("rpm")).join(shop.v_machine.select("machine_id", "max_rpm"), "machine_id", "left")
    status = F.when(c("rpm").isNull() | c("max_rpm").isNull(), "INSUFFICIENT_DATA").when(c("rpm") > c("max_rpm"), "EXCEEDS_LIMIT").otherwise("WITHIN_LIMIT")
    n = lambda v: F.count_if(c("status") == v)
    plan = F.when(n("EXCEEDS_LIMIT") > 0, "BLOCKED").when(n("INSUFFICIENT_DATA") > 0, "INSUFFICIENT_DATA").otherwise("COMPLETE")
    return s.withColumn("status", status).groupBy("plan_id").agg(F.count(F.lit(1)).alias("n_steps"), n("WITHIN_LIMIT").alias("n_within"), n("EXCEEDS_LIMIT").alias("n_exceeds"), n("INSUFFICIENT_DATA").alias("n_unknown"), plan.alias("plan_status"))


@query("eligible_machines", "SELECT operation, string_agg(DISTINCT CAST(machine_id AS VARCHAR), ',' ORDER BY CAST(machine_id AS VARCHAR)) AS machines, count(DISTINCT machine_id) AS n FROM (SELECT DISTINCT operation FROM v_step) LEFT JOIN (SELECT machine_id, unnest(string_split(processes, ';')) AS operation FROM v_machine) USING (operation) GROUP BY operation")
def eligible_machines(shop):
    from ..operators.catalog import items

    able = shop.v_machine.select("machine_id", F.explode(items(c("processes"))).alias("operation"))
    out = shop.v_step.select("operation").distinct().join(able, "operation", "left")
    return out.groupBy("operation").agg(F.nullif(F.array_join(F.sort_array(F.collect_set(c("machine_id").cast("string"))), ","), F.lit("")).alias("machines"), F.count_distinct("machine_id").alias("n"))
