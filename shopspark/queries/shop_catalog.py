"""Catalogs, ingest with quarantine, validation, compatibility and ranked selection."""

from pyspark.sql import functions as F

from ..operators import catalog as cat
from ..operators import compat
from ..operators import validation as val
from ..sources import export, ingest
from .registry import query, r6

c = F.col


@query("machine_filter", "SELECT machine_id, model, machine_type, max_rpm FROM v_machine WHERE machine_type = 'MILL' AND max_rpm >= 6000 AND list_contains(string_split(processes, ';'), 'boring') AND power_kw >= 8 ORDER BY machine_id")
def machine_filter(shop):
    df = cat.filter_least(cat.filter_equal(shop.v_machine, machine_type="mill"), max_rpm=6000, power_kw=8)
    return cat.filter_member(df, "processes", "Boring").select("machine_id", "model", "machine_type", "max_rpm").orderBy("machine_id")


@query("machine_search", "SELECT machine_id, model, spindle_interface FROM v_machine WHERE contains(lower(model), '#00000001') OR contains(lower(coalesce(spindle_interface, '')), '#00000001') OR contains(lower(machine_type), '#00000001')")
def machine_search(shop):
    return cat.search(shop.v_machine, "#00000001", "model", "spindle_interface", "machine_type").select("machine_id", "model", "spindle_interface")


@query("tool_filter", "SELECT tool_id, d_mm, flutes FROM v_tool WHERE tool_material = 'carbide' AND list_contains(string_split(iso_groups, ';'), 'P') AND list_contains(string_split(operations, ';'), 'milling') AND flutes >= 2")
def tool_filter(shop):
    df = cat.filter_least(cat.filter_equal(shop.v_tool, tool_material="Carbide"), flutes=2)
    return cat.filter_member(cat.filter_member(df, "iso_groups", "p"), "operations", "milling").select("tool_id", "d_mm", "flutes")


@query("holder_filter", "SELECT holder_id, tool_interface, max_rpm FROM v_holder WHERE machine_interface = 'BT40' AND max_rpm >= 9000")
def holder_filter(shop):
    return cat.filter_least(cat.filter_equal(shop.v_holder, machine_interface="bt40"), max_rpm=9000).select("holder_id", "tool_interface", "max_rpm")


@query("tool_page", "SELECT tool_id, product, iso_groups <> '' AS has_iso_groups, flutes IS NOT NULL AS has_flutes, insert_shape IS NOT NULL AS has_insert FROM v_tool WHERE contains(lower(product), 'ring') OR contains(lower(brand), 'ring') ORDER BY product, tool_id LIMIT 25 OFFSET 10")
def tool_page(shop):
    df = cat.page(cat.search(shop.v_tool, "Ring", "product", "brand"), ["product", "tool_id"], 10, 25)
    return df.select("tool_id", "product", (F.size(cat.items(c("iso_groups"))) > 0).alias("has_iso_groups"), c("flutes").isNotNull().alias("has_flutes"), c("insert_shape").isNotNull().alias("has_insert"))


@query("reference_lookup", """SELECT record_id, parameter_type, min_value, max_value, evidence_status IN ('VERIFIED', 'REFERENCE') AND source_reference IS NOT NULL AND source_type NOT IN ('AI', 'UNKNOWN') AND evidence_status IS NOT NULL AS authoritative,
  CASE WHEN unit = 'm/min' THEN 65 BETWEEN min_value AND max_value END AS holds_65 FROM v_ref WHERE (operation IS NULL OR operation = 'milling') AND (iso_group IS NULL OR iso_group = 'P')""")
def reference_lookup(shop):
    from ..functions.guards import in_range

    df = cat.in_scope(shop.v_ref, operation="milling", iso_group="P", tool_material=None)
    return df.select("record_id", "parameter_type", "min_value", "max_value", cat.is_usable_for_authority(c("evidence_status"), c("source_reference"), c("source_type")).alias("authoritative"), in_range(F.lit(65.0), F.lit("m/min"), c("min_value"), c("max_value"), c("unit")).alias("holds_65"))


@query("catalog_summary", """SELECT 'machine' AS catalog, count(*) AS n_rows, count(DISTINCT machine_type) AS n_kinds, string_agg(DISTINCT machine_type, ',' ORDER BY machine_type) AS kinds FROM v_machine
  UNION ALL SELECT 'tool', count(*), count(DISTINCT tool_material), string_agg(DISTINCT tool_material, ',' ORDER BY tool_material) FROM v_tool
  UNION ALL SELECT 'holder', count(*), count(DISTINCT machine_interface), string_agg(DISTINCT machine_interface, ',' ORDER BY machine_interface) FROM v_holder""")
def catalog_summary(shop):
    def of(name, df, col):
        return cat.summary(df.withColumnRenamed(col, "kind"), "kind").select(F.lit(name).alias("catalog"), "n_rows", c("n_kind").alias("n_kinds"), c("kind_values").alias("kinds"))

    return of("machine", shop.v_machine, "machine_type").unionByName(of("tool", shop.v_tool, "tool_material")).unionByName(of("holder", shop.v_holder, "machine_interface"))


@query("catalog_facets", """SELECT 'operation' AS facet, v AS value, count(*) AS n FROM (SELECT unnest(string_split(operations, ';')) AS v FROM v_tool) GROUP BY v
  UNION ALL SELECT 'iso', v, count(*) FROM (SELECT unnest(string_split(iso_groups, ';')) AS v FROM v_tool) WHERE v <> '' GROUP BY v""")
def catalog_facets(shop):
    return cat.facets(shop.v_tool, "operations").withColumn("facet", F.lit("operation")).unionByName(cat.facets(shop.v_tool, "iso_groups").withColumn("facet", F.lit("iso")))


@query("material_counts", "SELECT p_type AS family, p_brand AS grp, count(*) AS n, grouping(p_type)::BIGINT AS all_families FROM part GROUP BY GROUPING SETS ((p_type), (p_brand), ())")
def material_counts(shop):
    df = shop.part.select(c("p_type").alias("family"), c("p_brand").alias("grp"))
    return df.groupingSets([["family"], ["grp"], []], "family", "grp").agg(F.count(F.lit(1)).alias("n"), F.grouping("family").cast("long").alias("all_families"))


@query("first_of_each_tool", "SELECT DISTINCT ON (brand) brand, tool_id, d_mm, product FROM v_tool ORDER BY brand, d_mm DESC, tool_id")
def first_of_each_tool(shop):
    return cat.first_of_each(shop.v_tool.select("brand", "tool_id", "d_mm", "product"), "brand", -c("d_mm"), c("tool_id"))


@query("csv_ingest", """SELECT machine_id, max_rpm, power_kw, processes, machine_id % 6 = 0 AS bad FROM v_machine""")
def csv_ingest(shop):
    """Lines of text as a CSV file has them, read back with lenient and strict coercion."""
    m = shop.v_machine.select("machine_id", "max_rpm", "power_kw", "processes", "max_feed")
    line = F.to_csv(F.struct("machine_id", "max_rpm", "power_kw", F.replace("processes", F.lit(";"), F.lit(" ; ")).alias("processes"), F.when(c("max_feed").isNull(), "n/a").otherwise(c("max_feed").cast("string")).alias("max_feed")))
    raw = m.select(F.from_csv(line, F.lit("machine_id string, max_rpm string, power_kw string, processes string, max_feed string")).alias("r")).select("r.*")
    bad = F.size(ingest.coercion_errors(max_rpm=(c("max_rpm"), "int"), max_feed=(c("max_feed"), "double"))) > 0
    out = ingest.typed(raw.withColumn("bad", bad.cast("string")), {"machine_id": "bigint", "max_rpm": "bigint", "power_kw": "double", "processes": "list", "bad": "bool"})
    return out.withColumn("processes", F.array_join("processes", ";"))


@query("range_parse", "SELECT plan_id, seq, feed_rev AS low, feed_rev + 1 AS high  FROM v_step")
def range_parse(shop):
    s = shop.v_step
    comma = lambda x: F.replace(F.format_number(x, 2), F.lit("."), F.lit(","))
    got = ingest.number_range(F.concat(comma(c("feed_rev")), F.lit(" – "), comma(c("feed_rev") + 1), F.lit("*")))
    return s.select("plan_id", "seq", got["low"].alias("low"), F.round(got["high"], 2).alias("high"))


_BLANK = "coalesce(trim({0}) = '', true)"
_ERRORS = [
    ("V-01", f"{_BLANK.format('stable_id')} OR regexp_matches(stable_id, '\\s')"), ("V-02", _BLANK.format("manufacturer")), ("V-03", _BLANK.format("model")), ("V-04", _BLANK.format("machine_type")), ("V-05", _BLANK.format("machine_type_code")),
    ("V-06", "len(list_filter(string_split(coalesce(processes, ''), ';'), lambda x: trim(x) <> '')) = 0"), ("V-07", "axis_count IS NULL OR axis_count <= 0"), ("V-08", "NOT (turning_capable OR milling_capable OR coalesce(drilling_capable, false))"),
    ("V-09", _BLANK.format("source_title")), ("V-10", _BLANK.format("evidence_status")), ("V-11", "spindle_max_rpm <= 0"), ("V-12", "spindle_min_rpm <= 0 OR spindle_min_rpm >= spindle_max_rpm"), ("V-13", "spindle_power_kw <= 0"), ("V-14", "spindle_torque_nm <= 0"),
    ("V-15", "travel_x_mm <= 0 OR travel_y_mm <= 0 OR travel_z_mm <= 0"), ("V-16", "table_length_mm <= 0 OR table_width_mm <= 0"), ("V-17", "table_load_kg <= 0"), ("V-20", "tool_magazine_capacity <= 0"), ("V-21", "rapid_traverse_mpm <= 0"), ("V-22", "simultaneous_axis_count <= 0 OR simultaneous_axis_count > axis_count"),
]
_WARNINGS = [
    ("V-18", "NOT turning_capable AND (max_turning_diameter_mm IS NOT NULL OR max_turning_length_mm IS NOT NULL)"), ("V-19", "NOT turning_capable AND bar_capacity_mm IS NOT NULL"), ("V-23", "capable_5axis_simultaneous AND simultaneous_axis_count IS DISTINCT FROM 5"),
    ("V-24", "machine_type_code = 'LATHE_Y' AND NOT has_y_axis"), ("V-25", "spindle_max_rpm IS NULL"), ("V-26", "spindle_power_kw IS NULL"),
]
_codes = lambda rules: "concat_ws(',', " + ", ".join(f"CASE WHEN {on} THEN '{k}' END" for k, on in rules) + ")"


@query("machine_validation", f"SELECT *, errors = '' AS is_valid FROM (SELECT machine_id, {_codes(_ERRORS)} AS errors, {_codes(_WARNINGS)} AS warnings FROM v_machine_record)")
def machine_validation(shop):
    """V1: the 26 rules of a machine record."""
    df = val.validated(shop.v_machine_record, *val.machine_record_rules())
    return df.select("machine_id", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"), "is_valid")


_IMPORT = """b AS (SELECT p_partkey AS rowno, CASE WHEN p_partkey % 31 = 0 THEN NULL ELSE p_partkey % 700 END AS id, p_size > 8 AS ok FROM part),
  e AS (SELECT s_suppkey AS id FROM supplier),
  o AS (SELECT rowno, id, ok, id IS NOT NULL AND (id IN (SELECT id FROM e) OR coalesce(sum({r}) OVER (PARTITION BY id ORDER BY rowno ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0) AS dup FROM b)"""


@query("import_outcomes", "WITH " + _IMPORT.format(r="1") + ", " + _IMPORT.format(r="ok::INT").replace("b AS", "b2 AS").replace("e AS", "e2 AS").replace("o AS (", "o2 AS (").replace("FROM b)", "FROM b2)").replace("FROM e)", "FROM e2)") + """
  SELECT 'machines' AS kind, rowno, CASE WHEN dup THEN 'DUPLICATE' WHEN NOT ok THEN 'INVALID' ELSE 'ACCEPTED' END AS outcome FROM o
  UNION ALL SELECT 'tools', rowno, CASE WHEN dup AND ok THEN 'DUPLICATE' WHEN NOT ok THEN 'INVALID' ELSE 'ACCEPTED' END FROM o2
  UNION ALL SELECT 'materials', rowno, CASE WHEN dup THEN 'DUPLICATE' WHEN NOT ok THEN 'INVALID' ELSE 'ACCEPTED' END FROM o2""")
def import_outcomes(shop):
    batch = shop.part.select(c("p_partkey").alias("rowno"), F.when(c("p_partkey") % 31 != 0, c("p_partkey") % 700).alias("id"), (c("p_size") > 8).alias("is_valid"))
    had = shop.supplier.select(c("s_suppkey").alias("id"))
    rules = {"machines": (True, True), "tools": (False, False), "materials": (True, False)}
    parts = [val.import_rows(batch, "id", ["rowno"], had, *r).select(F.lit(k).alias("kind"), "rowno", "outcome") for k, r in rules.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("repeated_keys", "SELECT plan_id, line_no, tool_id, n AS copies FROM (SELECT *, count(*) OVER (PARTITION BY plan_id, line_no) AS n FROM v_step) WHERE n > 1")
def repeated_keys(shop):
    return val.refuse_repeated(shop.v_step.select("plan_id", "line_no", "tool_id"), "plan_id", "line_no")


@query("machine_capability", """SELECT plan_id, seq, CASE WHEN d_mm IS NULL OR m.max_rpm IS NULL THEN 'INSUFFICIENT_DATA' WHEN 1000 * vc / (pi() * d_mm) > m.max_rpm THEN 'FAIL' ELSE 'PASS' END AS spindle,
  CASE WHEN m.max_feed IS NULL THEN 'INSUFFICIENT_DATA' WHEN vc * 60 > m.max_feed THEN 'FAIL' ELSE 'PASS' END AS feed, CASE WHEN m.power_kw IS NULL THEN 'INSUFFICIENT_DATA' WHEN vc / 5 > m.power_kw THEN 'FAIL' ELSE 'PASS' END AS power,
  CASE WHEN m.travel_x IS NULL THEN 'INSUFFICIENT_DATA' WHEN path_mm > m.travel_x THEN 'FAIL' ELSE 'PASS' END AS envelope, round(vc * 60 / m.max_feed, 4) AS feed_use, d_mm IS NOT NULL AND d_mm < 3 AS slender FROM v_step s LEFT JOIN v_machine m USING (machine_id)""")
def machine_capability(shop):
    s = shop.v_step.join(shop.v_machine, "machine_id", "left")
    from ..functions.formulas import BASIC

    rpm = BASIC["spindle_rpm"].value(vc=c("vc"), d=c("d_mm"))
    return s.select("plan_id", "seq", val.limit_status(rpm, c("max_rpm")).alias("spindle"), val.limit_status(c("vc") * 60, c("max_feed")).alias("feed"), val.limit_status(c("vc") / 5, c("power_kw")).alias("power"), val.limit_status(c("path_mm"), c("travel_x")).alias("envelope"), val.utilisation(c("vc") * 60, c("max_feed")).alias("feed_use"), F.coalesce(c("d_mm") < 3, F.lit(False)).alias("slender"))


@query("manufacturability", """SELECT part_id, feature_id, depth_mm, CASE WHEN t.d_mm IS NULL THEN 'INSUFFICIENT_DATA' WHEN t.d_mm / 2 > f.d_mm THEN 'FAIL' ELSE 'PASS' END AS corner, CASE WHEN depth_mm / f.d_mm > 10 THEN 'WARNING' ELSE 'PASS' END AS depth_ratio,
  CASE WHEN f.feature_type = 'SLOT' THEN CASE WHEN t.d_mm > f.d_mm THEN 'FAIL' ELSE 'PASS' END ELSE 'NOT_APPLICABLE' END AS slot,
  CASE feature_type WHEN 'HOLE' THEN CASE WHEN list_contains(string_split(operations, ';'), 'drilling') THEN 'PASS' ELSE 'FAIL' END WHEN 'POCKET' THEN CASE WHEN list_contains(string_split(operations, ';'), 'milling') THEN 'PASS' ELSE 'FAIL' END
  WHEN 'SLOT' THEN CASE WHEN list_contains(string_split(operations, ';'), 'milling') THEN 'PASS' ELSE 'FAIL' END ELSE 'INSUFFICIENT_DATA' END AS process FROM v_feature f LEFT JOIN v_tool t ON t.tool_id = feature_id // 1000""")
def manufacturability(shop):
    f = shop.v_feature.withColumn("tool_id", F.floor(c("feature_id") / 1000))
    t = shop.v_tool.select("tool_id", c("d_mm").alias("t"), "operations")
    does = lambda op: F.when(F.array_contains(cat.items(c("operations")), op), "PASS").otherwise("FAIL")
    return f.join(t, "tool_id", "left").select(
        "part_id", "feature_id", "depth_mm", val.limit_status(c("t") / 2, c("d_mm")).alias("corner"), F.when(c("depth_mm") / c("d_mm") > 10, "WARNING").otherwise("PASS").alias("depth_ratio"),
        F.when(c("feature_type") == "SLOT", F.when(c("t") > c("d_mm"), "FAIL").otherwise("PASS")).otherwise("NOT_APPLICABLE").alias("slot"),
        F.when(c("feature_type") == "HOLE", does("drilling")).when(c("feature_type").isin("POCKET", "SLOT"), does("milling")).otherwise("INSUFFICIENT_DATA").alias("process"),
    )


@query("consistency_rules", """SELECT plan_id, seq, CASE WHEN rapid_mm IS NULL THEN 'INSUFFICIENT_DATA' WHEN abs(rapid_mm * feed_rev - (vc - 50) * 10 * feed_rev) <= 0.001 THEN 'PASS' ELSE 'FAIL' END AS feed_consistent, CASE WHEN vc > 60 THEN 'WARNING' ELSE 'PASS' END AS honing_speed,
  CASE WHEN dwell_s IS NULL THEN 'INSUFFICIENT_DATA' WHEN 2 * degrees(atan(dwell_s * 5 / vc)) BETWEEN 20 AND 60 THEN 'PASS' ELSE 'FAIL' END AS crosshatch, CASE WHEN feed_rev NOT BETWEEN 0.005 AND 0.2 THEN 'WARNING' ELSE 'PASS' END AS lapping_pressure FROM v_step""")
def consistency_rules(shop):
    from ..functions.formulas import HONING

    s = shop.v_step
    angle = HONING["crosshatch_deg"].value(vh=c("dwell_s") * 5, vp=c("vc"))
    return s.select("plan_id", "seq", val.tolerance_status(c("rapid_mm") * c("feed_rev"), F.when(c("rapid_mm").isNotNull(), (c("vc") - 50) * 10 * c("feed_rev"))).alias("feed_consistent"), F.when(c("vc") > 60, "WARNING").otherwise("PASS").alias("honing_speed"),
                    F.when(angle.isNull(), "INSUFFICIENT_DATA").when(angle.between(20, 60), "PASS").otherwise("FAIL").alias("crosshatch"), F.when(~c("feed_rev").between(0.005, 0.2), "WARNING").otherwise("PASS").alias("lapping_pressure"))


@query("worst_status", """SELECT plan_id, CASE max(CASE WHEN d_mm IS NULL THEN 2 WHEN vc > 90 THEN 3 WHEN vc > 75 THEN 1 ELSE 0 END) WHEN 0 THEN 'PASS' WHEN 1 THEN 'WARNING' WHEN 2 THEN 'INSUFFICIENT_DATA' ELSE 'FAIL' END AS status,
  count(*) FILTER (WHERE d_mm IS NULL) AS n_unknown, count(*) FILTER (WHERE d_mm IS NOT NULL AND vc > 90) AS n_fail FROM v_step GROUP BY plan_id""")
def worst_status(shop):
    status = F.when(c("d_mm").isNull(), "INSUFFICIENT_DATA").when(c("vc") > 90, "FAIL").when(c("vc") > 75, "WARNING").otherwise("PASS")
    s = shop.v_step.withColumn("st", status)
    return s.groupBy("plan_id").agg(val.worst(c("st"), ["PASS", "WARNING", "INSUFFICIENT_DATA", "FAIL"]).alias("status"), F.count_if(c("st") == "INSUFFICIENT_DATA").alias("n_unknown"), F.count_if(c("st") == "FAIL").alias("n_fail"))


_TRIPLES = """mi AS (SELECT *, list_filter(string_split(coalesce(spindle_interface, '') || ';' || more_interfaces, ';'), lambda x: x <> '') AS own FROM v_machine WHERE list_contains(string_split(processes, ';'), 'milling')),
  ti AS (SELECT * FROM v_tool WHERE list_contains(string_split(operations, ';'), 'milling')),
  tr AS (SELECT m.machine_id, t.tool_id, h.holder_id, m.max_rpm AS m_rpm, t.max_rpm AS t_rpm, h.max_rpm AS h_rpm,
    CASE WHEN len(own) = 0 THEN 'UNKNOWN' WHEN list_contains(own, h.machine_interface) THEN 'PASS' ELSE 'FAIL' END AS r_interface,
    CASE WHEN tool_interface IN ('ER32', 'HYDRAULIC') THEN CASE WHEN shank_mm IS NULL OR clamp_min IS NULL OR clamp_max IS NULL THEN 'UNKNOWN' WHEN shank_mm BETWEEN clamp_min AND clamp_max THEN 'PASS' ELSE 'FAIL' END
      WHEN tool_interface = 'INSERT_CNMG' THEN CASE WHEN insert_shape IS NULL THEN 'UNKNOWN' WHEN insert_shape = 'CNMG' THEN 'PASS' ELSE 'FAIL' END
      WHEN tool_interface = 'BORING_BAR_25' THEN CASE WHEN shank_mm IS NULL THEN 'UNKNOWN' WHEN abs(shank_mm - 25) <= 0.1 THEN 'PASS' ELSE 'FAIL' END ELSE 'UNKNOWN' END AS r_shank,
    CASE WHEN length_mm IS NULL OR max_tool_len IS NULL THEN 'UNKNOWN' WHEN length_mm > max_tool_len THEN 'FAIL' ELSE 'PASS' END AS r_length, CASE WHEN max_tool_d IS NULL THEN 'UNKNOWN' WHEN d_mm > max_tool_d THEN 'FAIL' ELSE 'PASS' END AS r_diameter,
    CASE WHEN iso_groups = '' THEN 'UNKNOWN' WHEN list_contains(string_split(iso_groups, ';'), 'P') THEN 'PASS' ELSE 'FAIL' END AS r_iso,
    CASE WHEN m.max_rpm IS NULL THEN 'UNKNOWN' WHEN 9000 > m.max_rpm THEN 'FAIL' ELSE 'PASS' END AS r_rpm_m, CASE WHEN t.max_rpm IS NULL THEN 'UNKNOWN' WHEN 9000 > t.max_rpm THEN 'FAIL' ELSE 'PASS' END AS r_rpm_t, CASE WHEN h.max_rpm IS NULL THEN 'UNKNOWN' WHEN 9000 > h.max_rpm THEN 'FAIL' ELSE 'PASS' END AS r_rpm_h
    FROM mi m CROSS JOIN ti t CROSS JOIN v_holder h),
  ev AS (SELECT *, CASE WHEN 'FAIL' IN (r_interface, r_shank, r_length, r_diameter, r_iso, r_rpm_m, r_rpm_t, r_rpm_h) THEN 'INCOMPATIBLE' WHEN 'UNKNOWN' IN (r_interface, r_shank, r_length, r_diameter, r_iso, r_rpm_m, r_rpm_t, r_rpm_h) THEN 'INSUFFICIENT_DATA' ELSE 'COMPATIBLE' END AS verdict FROM tr)"""
_REQUEST = dict(operation="milling", iso_group="P", rpm=9000)


def _counts(shop):
    return compat.verdict_counts(shop.v_machine, shop.v_tool, shop.v_holder, **_REQUEST)


@query("compatibility", f"WITH {_TRIPLES} SELECT verdict, r_interface, r_shank, r_length, r_diameter, r_iso, r_rpm_m, r_rpm_t, r_rpm_h, count(*) AS n FROM ev GROUP BY ALL")
def compatibility(shop):
    return _counts(shop)


@query("ranked_selection", f"""WITH {_TRIPLES}, k AS (SELECT machine_id, tool_id, holder_id, round((m_rpm - 9000) / CAST(m_rpm AS DOUBLE), 6) AS margin, tool_id % 2 AS reference FROM ev WHERE verdict = 'COMPATIBLE'),
  r AS (SELECT *, dense_rank() OVER (ORDER BY margin DESC NULLS LAST, reference DESC) AS rank, count(*) OVER (PARTITION BY margin, reference) > 1 AS tied, row_number() OVER (ORDER BY margin DESC NULLS LAST, reference DESC, machine_id, holder_id, tool_id) AS pos FROM k),
  d AS (SELECT DISTINCT rank, margin, reference FROM r), nx AS (SELECT rank, margin, reference, lead(margin) OVER (ORDER BY rank) AS m2, lead(reference) OVER (ORDER BY rank) AS r2 FROM d)
  SELECT machine_id, tool_id, holder_id, r.margin, rank, tied, CASE WHEN m2 IS NOT NULL AND nx.margin > m2 THEN 'HIGHER_RPM_MARGIN' WHEN r2 IS NOT NULL AND nx.reference > r2 THEN 'REFERENCE_GUIDANCE' END AS ahead FROM r JOIN nx USING (rank) WHERE pos <= 200""")
def ranked_selection(shop):
    margin = F.round((c("m_rpm") - 9000) / c("m_rpm"), 6)
    df = compat.ranked_fitting(shop.v_machine, shop.v_tool, shop.v_holder, **_REQUEST, limit=200, margin=margin, reference=c("tool_id") % 2)
    return df.select("machine_id", "tool_id", "holder_id", "margin", "rank", "tied", "ahead")


@query("selection_rollup", f"WITH {_TRIPLES} SELECT count(*) AS evaluated, count(*) FILTER (WHERE verdict = 'COMPATIBLE') AS compatible, count(*) FILTER (WHERE verdict = 'INCOMPATIBLE') AS incompatible, CASE WHEN count(*) FILTER (WHERE verdict = 'COMPATIBLE') > 0 THEN 'RANKED' WHEN count(*) FILTER (WHERE verdict = 'INSUFFICIENT_DATA') > count(*) FILTER (WHERE verdict = 'INCOMPATIBLE') THEN 'INSUFFICIENT_DATA' ELSE 'NO_COMPATIBLE' END AS state FROM ev")
def selection_rollup(shop):
    n = lambda v: F.coalesce(F.sum(F.when(c("verdict") == v, c("n"))), F.lit(0).cast("long"))
    return _counts(shop).agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("evaluated"), n("COMPATIBLE").alias("compatible"), n("INCOMPATIBLE").alias("incompatible"), F.when(n("COMPATIBLE") > 0, "RANKED").when(n("INSUFFICIENT_DATA") > n("INCOMPATIBLE"), "INSUFFICIENT_DATA").otherwise("NO_COMPATIBLE").alias("state"))


@query("machine_holder_pairs", "SELECT machine_id, holder_id FROM (SELECT machine_id, unnest(list_distinct(list_filter(string_split(coalesce(spindle_interface, '') || ';' || more_interfaces, ';'), lambda x: x <> ''))) AS i FROM v_machine) m JOIN v_holder h ON h.machine_interface = m.i")
def machine_holder_pairs(shop):
    return compat.interface_pairs(shop.v_machine, shop.v_holder)


@query("guarded_export", "SELECT tool_id, CASE WHEN flutes IS NULL THEN '' || chr(39) || '=' || product ELSE product END AS product, sha256(concat_ws('|', CAST(tool_id AS VARCHAR), product, coalesce(CAST(flutes AS VARCHAR), ''))) AS fingerprint FROM v_tool")
def guarded_export(shop):
    t = shop.v_tool.select("tool_id", "product", "flutes")
    return t.select("tool_id", export.csv_guard(F.when(c("flutes").isNull(), F.concat(F.lit("="), c("product"))).otherwise(c("product"))).alias("product"), ingest.fingerprint(c("tool_id"), c("product"), c("flutes")).alias("fingerprint"))


@query("json_export", """SELECT machine_id, '{"machine_id":' || machine_id || ',"machine_type":"' || machine_type || '"' || CASE WHEN max_rpm IS NULL THEN '' ELSE ',"max_rpm":' || max_rpm END || '}' AS json FROM v_machine""")
def json_export(shop):
    m = shop.v_machine.select("machine_id", "machine_type", "max_rpm")
    return m.select("machine_id", F.to_json(F.struct("machine_id", "machine_type", "max_rpm")).alias("json"))


@query("text_inventory", """WITH t AS (SELECT p_partkey // 16 AS k, p_partkey AS p, p_name || ' ' || p_partkey AS name FROM part)
  SELECT k, count(*) AS vertices, count(*) FILTER (WHERE p % 3 = 0) AS normals, count(*) FILTER (WHERE p % 5 = 0) AS texcoords, count(*) FILTER (WHERE p % 2 = 0) AS faces, string_agg(name, ',' ORDER BY name) AS names FROM t GROUP BY k""")
def text_inventory(shop):
    """Meshes of up to sixteen objects each, over all parts."""
    own = lambda n, text: F.when(c("p_partkey") % n == 0, text).otherwise("")
    part = F.concat(F.lit("o "), c("p_name"), F.lit(" "), c("p_partkey").cast("string"), F.lit("\nv 0 0 1\n"), own(3, "vn 0 0 1\n"), own(5, "vt 0 1\n"), own(2, "f 1 2 3\n"))
    return ingest.mesh_inventory(shop.part.groupBy(F.expr("p_partkey div 16").alias("k")).agg(F.array_join(F.collect_list(part), "").alias("text")), "k")


@query("markdown_tables", """WITH t AS (SELECT p_partkey // 16 AS k, p_partkey AS p, p_name || ' ' || p_partkey AS name FROM part)
  SELECT k, 1::BIGINT AS table_no, rn + 1 AS row_no, i AS col_no, CASE i WHEN 0 THEN name ELSE CAST(p AS VARCHAR) END AS value FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY name) AS rn FROM t) CROSS JOIN (VALUES (0), (1)) v(i)
  UNION ALL SELECT k, 1, 1, i, CASE i WHEN 0 THEN 'name' ELSE 'key' END FROM (SELECT DISTINCT k FROM t) CROSS JOIN (VALUES (0), (1)) v(i)""")
def markdown_tables(shop):
    """The cells of tables of up to sixteen rows each, over all parts."""
    row = F.concat(F.lit("| "), c("p_name"), F.lit(" "), c("p_partkey").cast("string"), F.lit(" | "), c("p_partkey").cast("string"), F.lit(" |"))
    rows = shop.part.groupBy(F.expr("p_partkey div 16").alias("k")).agg(F.sort_array(F.collect_list(row)).alias("r"))
    return ingest.markdown_cells(rows.select("k", F.concat(F.lit("# Title\n| name | key |\n|---|:--|\n"), F.array_join("r", "\n"), F.lit("\n\nend")).alias("text")), "k")
