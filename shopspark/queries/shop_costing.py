"""Times of steps and batches, feed ranges, load bounds, precedence of sources, counts of events."""

from pyspark.sql import functions as F

from ..operators import costing as co
from .registry import query, r6

c = F.col

_KINDS = [
    ("CUTTING", "CASE WHEN feed_rate * 1.25 > 0 THEN path_mm * 60 / (feed_rate * 1.25) END", "CASE WHEN feed_rate > 0 THEN path_mm * 60 / feed_rate END"),
    ("RAPID", "CASE WHEN s % 9 > 0 THEN q * 600 / (s % 9 * 1000) END", None), ("APPROACH_RETRACT", "CASE WHEN k % 4 <> 0 THEN 1.5 END + CASE WHEN k % 5 <> 0 THEN 2.0 END", None),
    ("TOOL_CHANGE", "CASE WHEN s % 7 <> 0 THEN 4.0 END * (q % 3)", None), ("SETUP", "CASE WHEN k % 3 = 0 THEN NULL ELSE CAST(k % 50 - 1 AS DOUBLE) END", None), ("INSPECTION", "CASE WHEN covered THEN 12.0 END", None),
]


def _sql_parts():
    rows = []
    for kind, low, high in _KINDS:
        low = f"CASE WHEN {low} >= 0 THEN {low} END" if kind in ("SETUP", "INSPECTION") else low
        rows.append(f"SELECT plan_id, step_id, k, s, q, '{kind}' AS kind, {low} AS low, {high or low} AS high FROM v_planstep")
    return " UNION ALL ".join(rows)


_COMP = f"""pr AS ({_sql_parts()}), pk AS (SELECT *, low IS NOT NULL AND high IS NOT NULL AS known FROM pr),
  ag AS (SELECT plan_id, count(*) AS n, count(*) FILTER (WHERE known) AS n_known, sum(low) FILTER (WHERE known) AS known_low, sum(high) FILTER (WHERE known) AS known_high FROM pk GROUP BY plan_id)"""


def _components(shop):
    on = lambda x, v: F.when(x, F.lit(v))
    s = shop.v_planstep
    parts = [
        co.cutting(c("path_mm"), c("feed_rate"), c("feed_rate") * 1.25), co.rapid(c("q") * 10, (c("s") % 9).cast("double")), co.approach_retract(on(c("k") % 4 != 0, 1.5), on(c("k") % 5 != 0, 2.0), c("covered")),
        co.tool_change(on(c("s") % 7 != 0, 4.0), c("q") % 3), co.given("SETUP", F.when(c("k") % 3 != 0, (c("k") % 50 - 1).cast("double"))), co.given("INSPECTION", on(c("covered"), 12.0)),
    ]
    return s, parts


@query("step_components", f"WITH {_COMP} SELECT plan_id, step_id, k, s, q, string_agg(kind, ',' ORDER BY kind) FILTER (WHERE NOT known) AS unknown, round(sum(low) FILTER (WHERE known) + 1e-9, 6) AS known_low, round(sum(high) FILTER (WHERE known) + 1e-9, 6) AS known_high, CASE WHEN count(*) FILTER (WHERE NOT known) = 0 THEN 'FULLY_CALCULATED' WHEN count(*) FILTER (WHERE known) > 0 THEN 'PARTIALLY_CALCULATED' ELSE 'INSUFFICIENT_DATA' END AS completeness FROM pk GROUP BY ALL")
def step_components(shop):
    """Every component of a step, known or not; what isn't known is never zero. Equal rows are one."""
    s, parts = _components(shop)
    keys = ["plan_id", "step_id", "k", "s", "q"]
    d = co.assembled(s, *parts).select(*keys, F.nullif(F.array_join(F.array_sort("unknown"), ","), F.lit("")).alias("unknown"), r6(c("known_low")).alias("known_low"), r6(c("known_high")).alias("known_high"), "completeness")
    return d


@query("batch_costs", """WITH b AS (SELECT o_orderkey AS batch_id, o_custkey % 40 - 2 AS n, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice / 100 END AS setup, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_custkey % 90 AS DOUBLE) END AS low, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_custkey % 90 + 5 AS DOUBLE) END AS high FROM orders),
  p AS (SELECT *, CASE WHEN n > 0 THEN setup / n END AS share FROM b) SELECT batch_id, round(share + 1e-9, 6) AS per_part_setup, round(low + share + 1.5 + 1e-9, 6) AS per_part_low, round(coalesce(high, low) + share + 1.5 + 1e-9, 6) AS per_part_high,
  CASE WHEN n <= 0 THEN 'INSUFFICIENT_DATA' WHEN low IS NOT NULL AND share IS NOT NULL THEN 'FULLY_CALCULATED' WHEN low IS NOT NULL OR share IS NOT NULL THEN 'PARTIALLY_CALCULATED' ELSE 'INSUFFICIENT_DATA' END AS completeness FROM p""")
def batch_costs(shop):
    o = shop.orders
    parts = co.batch(c("o_custkey") % 40 - 2, F.when(c("o_orderkey") % 5 != 0, c("o_totalprice") / 100), F.when(c("o_orderkey") % 7 != 0, (c("o_custkey") % 90).cast("double")), F.when(c("o_orderkey") % 3 != 0, (c("o_custkey") % 90 + 5).cast("double")), F.lit(1.5))
    d = o.select(c("o_orderkey").alias("batch_id"), *parts)
    return d.withColumns({k: r6(c(k)) for k in ("per_part_setup", "per_part_low", "per_part_high")})


@query("feed_ranges", """WITH sc AS (SELECT DISTINCT operation, iso_group FROM v_step) SELECT sc.operation, sc.iso_group, min(min_value) AS low, max(max_value) AS high, count(record_id) AS n FROM sc LEFT JOIN (SELECT * FROM v_ref WHERE parameter_type = 'feed_per_tooth') r
  ON (r.operation IS NULL OR sc.operation IS NULL OR r.operation = sc.operation) AND (r.iso_group IS NULL OR sc.iso_group IS NULL OR r.iso_group = sc.iso_group) GROUP BY sc.operation, sc.iso_group""")
def feed_ranges(shop):
    return co.feed_ranges(shop.v_step, shop.v_ref.filter("parameter_type = 'feed_per_tooth'"))


@query("first_references", "SELECT parameter_type, min(record_id) AS record_id, min_by(unit, record_id) AS unit, min_by(min_value, record_id) AS min_value, min_by(max_value, record_id) AS max_value FROM v_ref WHERE operation IS NULL OR operation = 'milling' GROUP BY parameter_type")
def first_references(shop):
    return co.first_per_type(shop.v_ref.filter("operation IS NULL OR operation = 'milling'"))


@query("load_bounds", """WITH j AS (SELECT machine_id, sum(end_s - start_s) AS load, max(operation_id % 900) AS largest_setup, max(end_s) AS makespan FROM v_job GROUP BY machine_id), w AS (SELECT machine_id, max(end_h) * 3600 AS latest_end FROM v_window WHERE machine_id % 5 <> 0 GROUP BY machine_id)
  SELECT machine_id, coalesce(load, 0)::BIGINT AS load, coalesce(largest_setup, 0)::BIGINT AS largest_setup, coalesce(makespan, 0)::BIGINT AS makespan, coalesce(latest_end, 0)::BIGINT AS latest_end FROM j FULL JOIN w USING (machine_id)""")
def load_bounds(shop):
    """Load, latest window end, largest setup and makespan of each machine."""
    jobs = shop.v_job.select("machine_id", (c("end_s") - c("start_s")).alias("duration"), (c("operation_id") % 900).alias("setup"), c("end_s").alias("end"))
    return co.load_bounds(jobs, shop.v_window.filter("machine_id % 5 <> 0").select("machine_id", (c("end_h") * 3600).alias("end")), "machine_id")


@query("conversion_events", """SELECT user_id AS document_id, count(*) FILTER (WHERE event_type = 'click') AS n_click, count(*) FILTER (WHERE event_type = 'view') AS n_view, count(*) FILTER (WHERE event_type = 'error') AS n_error, bool_or(event_type = 'error') AS adverse,
  bool_or(event_id % 3 = 0) AND NOT bool_or(event_type = 'error') AS lossless FROM events GROUP BY user_id""")
def conversion_events(shop):
    e = shop.events.select(c("user_id").alias("document_id"), c("event_type").alias("kind"), (c("event_id") % 3 == 0).alias("complete"))
    return co.event_counts(e, "document_id", ["click", "view", "error"], ["error"])


@query("tool_transitions", """WITH t AS (SELECT plan_id, seq, CASE WHEN tool_id % 6 = 0 THEN NULL ELSE operation END AS tt FROM v_step), l AS (SELECT plan_id, tt, lag(tt) OVER (PARTITION BY plan_id ORDER BY seq) AS b FROM t)
  SELECT plan_id, coalesce(sum(CASE WHEN b IS NOT NULL AND tt IS NOT NULL AND b <> tt THEN 1 ELSE 0 END), 0)::BIGINT AS changes FROM l GROUP BY plan_id""")
def tool_transitions(shop):
    t = shop.v_step.select("plan_id", "seq", F.when(c("tool_id") % 6 != 0, c("operation")).alias("tt"))
    return co.changes_in_order(t, "plan_id", ["seq"], "tt")


@query("calibration_values", """WITH v AS (SELECT l_orderkey AS plan_id, CASE l_linenumber % 5 WHEN 0 THEN 'USER_OVERRIDE' WHEN 1 THEN 'SHOP_MEASUREMENT' WHEN 2 THEN 'MANUFACTURER_REFERENCE' WHEN 3 THEN 'LITERATURE_REFERENCE' ELSE 'OTHER' END AS source, CASE WHEN l_partkey % 8 <> 0 THEN l_quantity END AS value FROM lineitem),
  r AS (SELECT *, CASE source WHEN 'USER_OVERRIDE' THEN 0 WHEN 'SHOP_MEASUREMENT' THEN 1 WHEN 'MANUFACTURER_REFERENCE' THEN 2 WHEN 'LITERATURE_REFERENCE' THEN 3 ELSE 4 END AS k FROM v WHERE value IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY k, source, value) AS i FROM r)
  SELECT plan_id, min_by(source, i) AS source, min_by(value, i) AS value, coalesce(string_agg(source, ',' ORDER BY i) FILTER (WHERE i > 1), '') AS rejected, 'RESOLVED' AS status FROM n GROUP BY plan_id UNION ALL SELECT plan_id, NULL, NULL, '', 'INSUFFICIENT_DATA' FROM v GROUP BY plan_id HAVING count(value) = 0""")
def calibration_values(shop):
    """The value of the best source, and the sources passed over."""
    order = {"USER_OVERRIDE": 0, "SHOP_MEASUREMENT": 1, "MANUFACTURER_REFERENCE": 2, "LITERATURE_REFERENCE": 3}
    name = F.coalesce(*[F.when(c("l_linenumber") % 5 == i, F.lit(n)) for i, n in enumerate(order)], F.lit("OTHER"))
    return co.by_precedence(shop.lineitem.select(c("l_orderkey").alias("plan_id"), name.alias("source"), F.when(c("l_partkey") % 8 != 0, c("l_quantity")).alias("value")), "plan_id", order)


@query("step_cycle_time", """SELECT plan_id, seq, tool_id, machine_id, CASE WHEN feed_rev > 0 THEN round(path_mm / (feed_rev * 1000 * 1.2) + 1e-9, 6) END AS low_min, CASE WHEN feed_rev > 0 THEN round(path_mm / (feed_rev * 1000 * 0.8) + 1e-9, 6) END AS high_min, round(rapid_mm / 10000 + 1e-9, 6) AS rapid_min, round(dwell_s / 60 + 1e-9, 6) AS dwell_min,
  CASE WHEN feed_rev <= 0 THEN 'INSUFFICIENT_DATA' WHEN rapid_mm IS NULL OR dwell_s IS NULL THEN 'PARTIAL' ELSE 'COMPLETE' END AS status FROM v_step""")
def step_cycle_time(shop):
    """Cutting time at the highest and lowest feed beside rapid and dwell."""
    at = lambda k: F.when(c("feed_rev") > 0, r6(c("path_mm") / (c("feed_rev") * 1000 * k)))
    status = F.when(c("feed_rev") <= 0, "INSUFFICIENT_DATA").when(c("rapid_mm").isNull() | c("dwell_s").isNull(), "PARTIAL").otherwise("COMPLETE")
    return shop.v_step.select("plan_id", "seq", "tool_id", "machine_id", at(1.2).alias("low_min"), at(0.8).alias("high_min"), r6(c("rapid_mm") / 10000).alias("rapid_min"), r6(c("dwell_s") / 60).alias("dwell_min"), status.alias("status"))


@query("step_severities", """SELECT plan_id, step_id, count(*) FILTER (WHERE machine_id IS NULL) AS blocking, count(*) FILTER (WHERE tool_id IS NULL) AS warnings, count(*) FILTER (WHERE vc IS NOT NULL) AS metrics_known, count(*) FILTER (WHERE vc IS NULL) AS metrics_unknown FROM v_planstep GROUP BY plan_id, step_id""")
def step_severities(shop):
    """Severities and availability of metrics per step."""
    n = F.count_if
    return shop.v_planstep.groupBy("plan_id", "step_id").agg(n(c("machine_id").isNull()).alias("blocking"), n(c("tool_id").isNull()).alias("warnings"), n(c("vc").isNotNull()).alias("metrics_known"), n(c("vc").isNull()).alias("metrics_unknown"))


@query("first_findings", """WITH f AS (SELECT plan_id, 'NO_MACHINE' AS code, step_id, s FROM v_planstep WHERE machine_id IS NULL UNION ALL SELECT plan_id, 'NO_TOOL', step_id, s FROM v_planstep WHERE tool_id IS NULL) SELECT plan_id, code, min(step_id) AS step_id FROM f GROUP BY plan_id, code""")
def first_findings(shop):
    """The first finding of each code of a plan."""
    from ..operators import catalog as cat

    s = shop.v_planstep
    f = s.filter("machine_id IS NULL").select("plan_id", F.lit("NO_MACHINE").alias("code"), "step_id").unionByName(s.filter("tool_id IS NULL").select("plan_id", F.lit("NO_TOOL").alias("code"), "step_id"))
    f = f.select(F.struct("plan_id", "code").alias("key"), "step_id")
    return cat.first_of_each(f, "key", c("step_id")).select("key.*", "step_id")


@query("id_differences", """SELECT o_orderkey AS id, 'REQUIRED_NOT_ASSIGNED' AS side FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O') UNION ALL
  SELECT DISTINCT l_orderkey, 'ASSIGNED_NOT_REQUIRED' FROM lineitem WHERE l_linestatus = 'O' AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')""")
def id_differences(shop):
    """Required without assigned, and assigned without required."""
    need = shop.orders.filter("o_orderstatus <> 'P'").select(c("o_orderkey").alias("id")).distinct()
    have = shop.lineitem.filter("l_linestatus = 'O'").select(c("l_orderkey").alias("id")).distinct()
    side = lambda a, b, n: a.join(b, "id", "left_anti").withColumn("side", F.lit(n))
    return side(need, have, "REQUIRED_NOT_ASSIGNED").unionByName(side(have, need, "ASSIGNED_NOT_REQUIRED"))


@query("requirement_union", """SELECT plan_id, characteristic_id, 'DIMENSION' AS kind, nominal AS value, NULL::VARCHAR AS detail FROM v_char WHERE char_type = 'DIMENSION' UNION ALL SELECT drawing_id, frame_id, 'GDT', tolerance, characteristic FROM v_frame UNION ALL SELECT plan_id, characteristic_id, 'SURFACE_FINISH', ra_um, NULL FROM v_char WHERE ra_um IS NOT NULL""")
def requirement_union(shop):
    """Requirement kinds with different columns in one table of characteristics."""
    d = shop.v_char.filter("char_type = 'DIMENSION'").select("plan_id", "characteristic_id", F.lit("DIMENSION").alias("kind"), c("nominal").alias("value"))
    g = shop.v_frame.select(c("drawing_id").alias("plan_id"), c("frame_id").alias("characteristic_id"), F.lit("GDT").alias("kind"), c("tolerance").alias("value"), c("characteristic").alias("detail"))
    s = shop.v_char.filter("ra_um IS NOT NULL").select("plan_id", "characteristic_id", F.lit("SURFACE_FINISH").alias("kind"), c("ra_um").alias("value"))
    return d.unionByName(g, allowMissingColumns=True).unionByName(s, allowMissingColumns=True)
