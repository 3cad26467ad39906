"""Domain tables as deterministic views over the star-schema tables.

Each view is one SELECT that Spark and DuckDB both run, so both sides of a comparison see the same input.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "v_machine": """SELECT s_suppkey AS machine_id, s_name AS model,
  CASE s_suppkey % 4 WHEN 0 THEN 'MILL' WHEN 1 THEN 'LATHE' WHEN 2 THEN 'MILL_TURN' ELSE 'DRILL' END AS machine_type,
  CASE s_suppkey % 4 WHEN 0 THEN 'milling;drilling;boring' WHEN 1 THEN 'turning;boring' WHEN 2 THEN 'milling;turning;drilling' ELSE 'drilling' END AS processes,
  CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE 4000 + (s_suppkey * 137) % 16000 END AS max_rpm,
  CASE WHEN s_suppkey % 13 = 0 THEN NULL WHEN s_suppkey % 3 = 0 THEN 'BT40' WHEN s_suppkey % 3 = 1 THEN 'HSK-A63' ELSE 'BT30' END AS spindle_interface,
  CASE WHEN s_suppkey % 5 = 0 THEN 'BT40;CAT40' ELSE '' END AS more_interfaces,
  CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE CAST(2000 + (s_suppkey * 53) % 9000 AS DOUBLE) END AS max_feed,
  CASE WHEN s_suppkey % 8 = 0 THEN NULL ELSE CAST(5 + s_suppkey % 26 AS DOUBLE) END AS power_kw,
  CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE CAST(20 + (s_suppkey * 11) % 180 AS DOUBLE) END AS torque_nm,
  CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE CAST(30 + (s_suppkey * 7) % 70 AS DOUBLE) END AS max_tool_d,
  CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE CAST(100 + (s_suppkey * 13) % 250 AS DOUBLE) END AS max_tool_len,
  CAST(300 + (s_suppkey * 17) % 900 AS DOUBLE) AS travel_x, s_nationkey AS site FROM {supplier}""",
    "v_machine_record": """SELECT s_suppkey AS machine_id, CASE s_suppkey % 29 WHEN 0 THEN '' WHEN 1 THEN 'M 1' WHEN 2 THEN NULL ELSE 'M-' || CAST(s_suppkey AS STRING) END AS stable_id, CASE WHEN s_suppkey % 31 = 0 THEN ' ' ELSE 'Maker' END AS manufacturer, CASE WHEN s_suppkey % 37 = 0 THEN NULL ELSE s_name END AS model,
  CASE WHEN s_suppkey % 41 = 0 THEN '' ELSE 'LATHE' END AS machine_type, CASE s_suppkey % 5 WHEN 0 THEN 'LATHE_Y' WHEN 1 THEN 'VMC' WHEN 2 THEN NULL ELSE 'VMC5' END AS machine_type_code, CASE s_suppkey % 11 WHEN 0 THEN '' WHEN 1 THEN ' ; ' ELSE 'milling;drilling' END AS processes,
  CASE WHEN s_suppkey % 13 = 0 THEN NULL ELSE s_suppkey % 7 - 1 END AS axis_count, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_suppkey % 6 END AS simultaneous_axis_count, s_suppkey % 3 = 0 AS turning_capable, s_suppkey % 3 = 1 AS milling_capable, CASE WHEN s_suppkey % 6 = 5 THEN true WHEN s_suppkey % 6 = 4 THEN NULL ELSE false END AS drilling_capable,
  CASE WHEN s_suppkey % 17 = 0 THEN NULL ELSE s_name END AS source_title, CASE WHEN s_suppkey % 19 = 0 THEN '' ELSE 'VERIFIED' END AS evidence_status, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_suppkey * 131 % 9000 - 50 END AS spindle_max_rpm, CASE WHEN s_suppkey % 8 = 0 THEN NULL ELSE s_suppkey * 37 % 3000 - 20 END AS spindle_min_rpm,
  CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE CAST(s_suppkey % 30 AS DOUBLE) END AS spindle_power_kw, CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE CAST(s_suppkey % 40 - 1 AS DOUBLE) END AS spindle_torque_nm, CAST(s_suppkey % 23 AS DOUBLE) AS travel_x_mm, CAST(s_suppkey % 25 AS DOUBLE) AS travel_y_mm, CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE CAST(s_suppkey % 27 AS DOUBLE) END AS travel_z_mm,
  CAST(s_suppkey % 26 AS DOUBLE) AS table_length_mm, CAST(s_suppkey % 28 AS DOUBLE) AS table_width_mm, CAST(s_suppkey % 33 - 2 AS DOUBLE) AS table_load_kg, CASE WHEN s_suppkey % 5 < 2 THEN 300.0 ELSE NULL END AS max_turning_diameter_mm, CASE WHEN s_suppkey % 5 = 1 THEN 900.0 ELSE NULL END AS max_turning_length_mm, CASE WHEN s_suppkey % 14 = 3 THEN 42.0 ELSE NULL END AS bar_capacity_mm,
  CASE WHEN s_suppkey % 15 = 0 THEN NULL ELSE s_suppkey % 16 END AS tool_magazine_capacity, CASE WHEN s_suppkey % 18 = 0 THEN NULL ELSE CAST(s_suppkey % 21 AS DOUBLE) END AS rapid_traverse_mpm, s_suppkey % 12 = 7 AS capable_5axis_simultaneous, s_suppkey % 20 = 5 AS has_y_axis FROM {supplier}""",
    "v_tool": """SELECT p_partkey AS tool_id, p_name AS product, p_brand AS brand, CAST(2 + p_size AS DOUBLE) AS d_mm,
  CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE 2 + p_partkey % 4 END AS flutes,
  CASE p_partkey % 6 WHEN 0 THEN 'P;M' WHEN 1 THEN 'P' WHEN 2 THEN 'K;P' WHEN 3 THEN 'N' WHEN 4 THEN '' ELSE 'S;H' END AS iso_groups,
  CASE p_partkey % 4 WHEN 0 THEN 'milling' WHEN 1 THEN 'drilling' WHEN 2 THEN 'turning;boring' ELSE 'milling;drilling' END AS operations,
  CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE CAST(6 + p_partkey % 27 AS DOUBLE) END AS shank_mm,
  CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE CAST(60 + (p_partkey * 3) % 240 AS DOUBLE) END AS length_mm,
  CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE 5000 + (p_partkey * 31) % 20000 END AS max_rpm,
  CASE p_partkey % 3 WHEN 0 THEN 'carbide' WHEN 1 THEN 'hss' ELSE NULL END AS tool_material,
  CASE p_partkey % 5 WHEN 0 THEN 'CNMG' WHEN 1 THEN 'DNMG' ELSE NULL END AS insert_shape FROM {part}""",
    "v_holder": """SELECT n_nationkey AS holder_id, CASE n_nationkey % 3 WHEN 0 THEN 'BT40' WHEN 1 THEN 'HSK-A63' ELSE 'BT30' END AS machine_interface,
  CASE n_nationkey % 5 WHEN 0 THEN 'ER32' WHEN 1 THEN 'HYDRAULIC' WHEN 2 THEN 'INSERT_CNMG' WHEN 3 THEN 'BORING_BAR_25' ELSE 'SHELL_MILL_ARBOR' END AS tool_interface,
  CASE WHEN n_nationkey % 10 = 0 THEN NULL ELSE CAST(3 + n_nationkey % 6 AS DOUBLE) END AS clamp_min, CAST(16 + n_nationkey % 12 AS DOUBLE) AS clamp_max,
  CASE WHEN n_nationkey % 6 = 0 THEN NULL ELSE 8000 + n_nationkey * 600 END AS max_rpm FROM {nation}""",
    "v_step": """SELECT l_orderkey AS plan_id, l_linenumber AS line_no, l_suppkey AS machine_id, l_partkey AS tool_id,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS seq,
  CASE l_linenumber % 4 WHEN 0 THEN 'milling' WHEN 1 THEN 'drilling' WHEN 2 THEN 'turning' ELSE 'boring' END AS operation,
  50 + l_quantity AS vc, CASE WHEN l_partkey % 23 = 0 THEN NULL ELSE CAST(2 + l_partkey % 49 AS DOUBLE) END AS d_mm,
  l_extendedprice / 100 AS path_mm, l_discount AS feed_rev, CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE l_quantity * 10 END AS rapid_mm,
  CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE l_tax * 100 END AS dwell_s,
  CASE l_partkey % 5 WHEN 0 THEN 'P' WHEN 1 THEN 'M' WHEN 2 THEN 'K' WHEN 3 THEN 'N' ELSE NULL END AS iso_group FROM {lineitem}""",
    "v_ref": """SELECT p_partkey AS record_id, CASE p_partkey % 3 WHEN 0 THEN 'cutting_speed' WHEN 1 THEN 'feed_per_tooth' ELSE 'depth_of_cut' END AS parameter_type,
  CASE p_partkey % 4 WHEN 0 THEN 'milling' WHEN 1 THEN 'drilling' WHEN 2 THEN 'turning' ELSE NULL END AS operation,
  CASE p_partkey % 5 WHEN 0 THEN 'P' WHEN 1 THEN 'M' WHEN 2 THEN 'K' ELSE NULL END AS iso_group,
  CASE p_partkey % 7 WHEN 0 THEN 'carbide' WHEN 1 THEN 'hss' ELSE NULL END AS tool_material,
  CASE p_partkey % 3 WHEN 0 THEN 'm/min' WHEN 1 THEN 'mm/tooth' ELSE 'mm' END AS unit,
  CAST(20 + p_partkey % 60 AS DOUBLE) AS min_value, CAST(60 + p_partkey % 90 AS DOUBLE) AS max_value,
  CASE p_partkey % 4 WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'REFERENCE' WHEN 2 THEN 'UNVERIFIED' ELSE NULL END AS evidence_status,
  CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_brand END AS source_reference,
  CASE p_partkey % 5 WHEN 0 THEN 'HANDBOOK' WHEN 1 THEN 'CATALOG' WHEN 2 THEN 'AI' WHEN 3 THEN 'STANDARD' ELSE 'UNKNOWN' END AS source_type FROM {part}""",
    "v_obs": """SELECT user_id AS tool_index, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS cycle,
  count(*) OVER (PARTITION BY user_id) - row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS countdown,
  CASE user_id % 3 WHEN 0 THEN 'endmill' WHEN 1 THEN 'drill' ELSE 'insert' END AS tool_type, value AS sensor,
  CAST(1 + user_id % 4 AS DOUBLE) / 2 AS adoc_mm FROM {events}""",
    "v_nc": """SELECT CAST(floor(l_orderkey / 120) AS BIGINT) AS program_id, l_partkey AS k,
  row_number() OVER (PARTITION BY floor(l_orderkey / 120) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS line_no,
  CASE WHEN row_number() OVER (PARTITION BY floor(l_orderkey / 120) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) = 1 THEN CASE WHEN floor(l_orderkey / 120) % 9 = 0 THEN 'G20 G90' ELSE 'G21 G90 (start)' END
  WHEN l_partkey % 40 = 0 THEN 'T' || CAST(l_suppkey % 12 AS STRING) || ' ; pick' WHEN l_partkey % 40 = 1 THEN 'M6'
  WHEN l_partkey % 40 = 2 THEN 'S' || CAST(500 + l_suppkey * 20 AS STRING) || ' M3' WHEN l_partkey % 40 = 3 THEN 'G91' WHEN l_partkey % 40 = 4 THEN 'G90' WHEN l_partkey % 200 = 5 THEN 'G28 X0 Y0'
  WHEN l_partkey % 200 = 6 THEN '#100 = 5' WHEN l_partkey % 40 = 7 THEN 'M5' WHEN l_partkey % 900 = 8 THEN 'M30' WHEN l_partkey % 40 = 9 THEN 'G91.1' WHEN l_partkey % 40 = 10 THEN 'G2 X' || CAST(l_suppkey % 9 AS STRING) || ' Y0 I' || CAST(l_suppkey % 7 AS STRING) || ' J0' WHEN l_partkey % 40 = 11 THEN 'G91 G3 X4 Y0 I2 J0 Z-1' WHEN l_partkey % 40 = 12 THEN 'G90 G' || CAST(81 + l_suppkey % 6 AS STRING) || ' X' || CAST(l_suppkey % 50 AS STRING) || ' Y5 Z-' || CAST(l_linenumber AS STRING) || ' R2'
  WHEN l_partkey % 40 = 13 THEN 'G80' WHEN l_partkey % 40 = 14 THEN 'G99' WHEN l_partkey % 40 = 15 THEN 'G98' WHEN l_partkey % 40 = 16 THEN 'G18' WHEN l_partkey % 40 = 17 THEN 'G17' WHEN l_partkey % 40 = 18 THEN 'G3 X5 R9' WHEN l_partkey % 40 = 19 THEN 'G90 X1 Y2 Z3' WHEN l_partkey % 80 = 20 THEN 'G92 X0 Y' || CAST(l_suppkey % 5 AS STRING) WHEN l_partkey % 80 = 21 THEN 'G95 F0.25' WHEN l_partkey % 80 = 22 THEN 'G94 F150' WHEN l_partkey % 80 = 23 THEN 'G54 G43 H1' WHEN l_partkey % 400 = 24 THEN 'G93 F9' WHEN l_partkey % 80 = 25 THEN 'G94'
  WHEN l_linenumber % 3 = 0 THEN 'G0 X' || CAST(l_suppkey % 90 AS STRING) || ' Y' || CAST(l_partkey % 70 AS STRING)
  WHEN l_linenumber % 3 = 1 THEN 'G1 X' || CAST(l_partkey % 80 AS STRING) || ' (cut) F' || CAST(100 + l_suppkey % 300 AS STRING)
  ELSE 'Y' || CAST(l_suppkey % 60 AS STRING) || ' Z-' || CAST(l_partkey % 9 AS STRING) END AS text FROM {lineitem}""",
    "v_nc_b": """SELECT program_id, line_no, CASE WHEN k % 17 = 0 THEN replace(text, 'X', 'X1') WHEN k % 29 = 0 THEN text || ' F999' ELSE text END AS text FROM v_nc WHERE k % 41 <> 0""",
    "v_window": """SELECT o_custkey AS machine_id, CAST(o_orderkey % 700 * 3 AS BIGINT) AS start_h, CAST(o_orderkey % 700 * 3 + 1 + o_custkey % 6 AS BIGINT) AS end_h FROM {orders}""",
    "v_maint": """SELECT o_custkey AS machine_id, CAST(o_orderkey * 11 % 700 * 3 + 1 AS BIGINT) AS start_h, CAST(o_orderkey * 11 % 700 * 3 + 2 + o_custkey % 3 AS BIGINT) AS end_h FROM {orders}""",
    "v_job": """SELECT o_orderkey AS operation_id, o_custkey AS machine_id, CAST(o_orderkey / 1 AS BIGINT) * 3600 AS start_s,
  CAST(o_orderkey / 1 AS BIGINT) * 3600 + 600 * (1 + o_custkey % 900) AS end_s, CASE o_orderstatus WHEN 'P' THEN 'K1' WHEN 'O' THEN 'K2' ELSE 'K3' END AS setup_key FROM {orders}""",
    "v_reading": """SELECT l_orderkey AS replicate_id, l_linenumber % 3 AS stage_id, l_quantity / 10 AS rq, CASE WHEN l_partkey % 29 = 0 THEN NULL ELSE l_quantity / 12 END AS ra,
  CASE WHEN l_suppkey % 15 = 0 THEN 'INVALID' ELSE 'VALID' END AS validity, CASE WHEN l_suppkey % 2 = 0 THEN 'um' ELSE 'mm' END AS unit FROM {lineitem}""",
    "v_event": """SELECT event_id, ts, user_id AS detection_id, CASE event_type WHEN 'click' THEN 'confirm' WHEN 'view' THEN 'edit' WHEN 'error' THEN 'reject' ELSE 'associate' END AS action, value FROM {events}""",
    "v_feature": """SELECT l_orderkey AS part_id, l_partkey * 1000 + l_linenumber AS feature_id, CASE l_linenumber % 4 WHEN 0 THEN 'HOLE' WHEN 1 THEN 'POCKET' WHEN 2 THEN 'SLOT' ELSE 'THREAD' END AS feature_type,
  CAST(3 + l_partkey % 7 AS DOUBLE) + CAST(l_suppkey % 3 AS DOUBLE) / 10 AS d_mm, l_quantity AS depth_mm, CAST(l_partkey % 100 AS DOUBLE) AS x, CAST(l_suppkey % 100 AS DOUBLE) AS y FROM {lineitem}""",
    "v_char": """SELECT l_orderkey AS plan_id, l_partkey * 1000 + l_linenumber AS characteristic_id, CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_partkey * 1000 + l_linenumber END AS feature_id,
  CASE l_partkey % 4 WHEN 0 THEN 'DIMENSION' WHEN 1 THEN 'GDT' WHEN 2 THEN 'SURFACE_FINISH' ELSE 'THREAD' END AS char_type, CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE l_quantity END AS nominal,
  CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE l_discount END AS upper_tol, CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE -l_tax END AS lower_tol,
  CASE WHEN l_partkey % 4 = 2 THEN l_quantity / 20 ELSE NULL END AS ra_um, l_suppkey AS s FROM {lineitem}""",
    "v_route": """SELECT l_orderkey AS feature_id, l_partkey * 10 + l_linenumber AS route_id, CAST(l_quantity AS INT) AS score, 1 + l_suppkey % 5 AS n_ops, 1 + l_partkey % 3 AS setups,
  CASE l_suppkey % 3 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' ELSE 'HIGH' END AS risk, CASE l_partkey % 4 WHEN 0 THEN 'drilling;reaming' WHEN 1 THEN 'drilling;boring;honing' WHEN 2 THEN 'milling;grinding' ELSE 'milling' END AS operations,
  l_quantity / 10 AS best_ra, 6 + l_partkey % 7 AS best_it, l_partkey % 5 <> 0 AS gdt_capable FROM {lineitem}""",
    "v_partroute": """SELECT CAST(floor(l_orderkey / 4) AS BIGINT) AS part_id, l_orderkey AS feature_id, l_partkey * 10 + l_linenumber AS route_id, CAST(l_quantity AS INT) AS score, 1 + l_suppkey % 5 AS n_ops,
  CASE WHEN l_partkey % 4 = 0 THEN 'VMC' WHEN l_partkey % 4 = 1 THEN 'HMC' WHEN l_partkey % 4 = 2 THEN 'LATHE' ELSE 'GRINDER' END AS setup_key, l_quantity > 4 AND l_suppkey % 6 <> 0 AS feasible FROM {lineitem}""",
    "v_truth": """SELECT item_id, CAST(floor(item_id / 25) AS BIGINT) AS fixture, text AS expected_text, item_id % 3 = 0 AS required,
  CASE item_id % 3 WHEN 0 THEN 'DIAMETER' WHEN 1 THEN 'LINEAR_DIMENSION' ELSE 'NOTE' END AS feature_type, CAST(item_id % 5 AS STRING) AS value, CASE WHEN item_id % 2 = 0 THEN 'mm' ELSE NULL END AS unit FROM {benchmark}""",
    "v_found": """SELECT r.run AS run_id, b.item_id * 10 + r.run AS finding_no, CAST(floor(b.item_id / 25) AS BIGINT) AS fixture, CASE (b.item_id + r.run) % 4 WHEN 0 THEN b.text WHEN 1 THEN replace(b.text, ' ', '  ') WHEN 2 THEN '  ' || b.text || ' ' ELSE 'none of ' || CAST(b.item_id % 3 AS STRING) END AS raw_text,
  CASE WHEN b.item_id % 7 = 0 THEN NULL ELSE ' ' || CAST((b.item_id + r.run) % 5 AS STRING) END AS value, CASE WHEN b.item_id % 2 = 0 THEN ' Millimeter' ELSE NULL END AS unit
  FROM {benchmark} b CROSS JOIN (SELECT DISTINCT r_regionkey % 3 AS run FROM {region}) r WHERE (b.item_id * 7 + r.run) % 5 <> 0""",
    "v_material": """SELECT p_partkey AS material_id, CASE WHEN p_partkey % 37 = 0 THEN '' ELSE p_brand || '-' || CAST(p_partkey % 1000 AS STRING) END AS designation, p_name AS alias,
  CASE p_partkey % 8 WHEN 0 THEN 'P' WHEN 1 THEN 'M' WHEN 2 THEN 'K' WHEN 3 THEN 'N' WHEN 4 THEN 'S' WHEN 5 THEN 'H' WHEN 6 THEN 'X' ELSE NULL END AS iso_group,
  CASE WHEN p_partkey % 8 = 4 THEN CASE p_partkey % 3 WHEN 0 THEN 'S_TITANIUM' WHEN 1 THEN 'S_NICKEL_HRSA' ELSE 'UNSPECIFIED' END WHEN p_partkey % 41 = 0 THEN NULL ELSE 'GENERAL' END AS iso_subgroup,
  p_type AS family, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(p_partkey * 31 % 25 * 1000 AS DOUBLE) END AS density, CAST(p_partkey * 7 % 20 * 20 AS DOUBLE) AS modulus,
  CASE p_partkey % 5 WHEN 0 THEN 'HB' WHEN 1 THEN 'HRC' WHEN 2 THEN 'HV' WHEN 3 THEN 'HX' ELSE NULL END AS hardness_scale, CAST(p_partkey % 60 - 2 AS DOUBLE) AS hardness_min, CAST(p_partkey * 3 % 70 AS DOUBLE) AS hardness_max,
  CAST(p_partkey * 13 % 4000 AS DOUBLE) AS tensile, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE CAST(p_partkey % 90 - 1 AS DOUBLE) END AS vc_min, CAST(60 + p_partkey % 90 AS DOUBLE) AS vc_max,
  CASE p_partkey % 3 WHEN 0 THEN 'turning' WHEN 1 THEN 'milling' ELSE 'drilling' END AS operation, CASE p_partkey % 2 WHEN 0 THEN 'carbide' ELSE 'hss' END AS tool_material FROM {part}""",
    "v_report": """SELECT CAST(floor(p_partkey / 30) AS BIGINT) AS report_id, p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN 'Turning' ELSE 'Milling' END AS operation,
  CASE WHEN p_partkey % 11 = 0 THEN '' ELSE CASE p_partkey % 3 WHEN 0 THEN 'P' WHEN 1 THEN 'M' ELSE 'K' END END AS iso_group, CASE p_partkey % 4 WHEN 0 THEN 'carbide' WHEN 1 THEN 'hss' ELSE '' END AS tool_material,
  CASE WHEN p_partkey % 13 = 0 THEN '-' WHEN p_partkey % 17 = 0 THEN 'n/a' WHEN p_partkey % 19 = 0 THEN CAST(p_size + 90 AS STRING) || '–' || CAST(p_size + 40 AS STRING) WHEN p_partkey % 5 = 0 THEN CAST(p_size + 40 AS STRING) || '–' || CAST(p_size + 90 AS STRING) || '*' ELSE CAST(p_size + 40 AS STRING) || '-' || CAST(p_size + 90 AS STRING) END AS speed,
  '0,' || CAST(1 + p_partkey % 4 AS STRING) || '–0,' || CAST(5 + p_partkey % 4 AS STRING) AS feed, p_size FROM {part}""",
    "v_req": """SELECT CAST(floor(l_orderkey / 5) AS BIGINT) AS drawing_id, row_number() OVER (PARTITION BY floor(l_orderkey / 5) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS req_id, CASE WHEN l_partkey % 9 = 0 THEN 'THREAD' ELSE 'DIMENSION' END AS kind,
  CASE l_partkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 'Diameter' WHEN 2 THEN 'HOLE_DIAMETER' WHEN 3 THEN 'DEPTH' WHEN 7 THEN 'RADIUS' ELSE 'LINEAR' END AS dimension_type, l_quantity AS value,
  CASE l_partkey % 9 WHEN 3 THEN CASE WHEN l_suppkey % 2 = 0 THEN 'slot depth' ELSE NULL END WHEN 4 THEN 'Slot width' WHEN 5 THEN 'of the POCKET' WHEN 6 THEN CASE WHEN l_suppkey % 2 = 0 THEN 'chamfer 45' ELSE 'groove' END ELSE NULL END AS note FROM {lineitem}""",
    "v_frame": """SELECT l_orderkey AS drawing_id, l_partkey * 1000 + l_linenumber AS frame_id, l_linenumber AS line_no, l_suppkey AS s, CASE l_partkey % 12 WHEN 0 THEN 'FLATNESS' WHEN 1 THEN 'STRAIGHTNESS' WHEN 2 THEN 'CIRCULARITY' WHEN 3 THEN 'CYLINDRICITY'
  WHEN 4 THEN 'PERPENDICULARITY' WHEN 5 THEN 'PARALLELISM' WHEN 6 THEN 'POSITION' WHEN 7 THEN 'CIRCULAR_RUNOUT' WHEN 8 THEN 'TOTAL_RUNOUT' WHEN 9 THEN 'CONCENTRICITY' WHEN 10 THEN 'SYMMETRY' ELSE 'PROFILE_OF_SURFACE' END AS characteristic,
  CASE l_suppkey % 4 WHEN 0 THEN 'MMC' WHEN 1 THEN 'LMC' ELSE NULL END AS modifier, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE 'A' || CASE WHEN l_suppkey % 2 = 0 THEN 'B' ELSE '' END END AS datums,
  l_suppkey % 3 = 0 AS true_fos, l_quantity / 100 AS tolerance, CASE WHEN l_suppkey % 5 = 0 THEN l_discount ELSE NULL END AS lower_tolerance, l_linenumber % 2 = 0 AS is_hole FROM {lineitem}""",
    "v_lifetest": """SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'x' ELSE CAST(user_id % 70 AS STRING) END AS tool_index, CASE WHEN event_id % 31 = 0 THEN NULL WHEN event_id % 29 = 0 THEN '3' ELSE CAST(1 + user_id % 2 AS STRING) END AS tool_type,
  CASE WHEN event_id % 37 = 0 THEN '0' ELSE '0.5' END AS adoc, CASE WHEN event_id % 41 = 0 THEN 'n/a' ELSE '2.5' END AS rdoc, CASE WHEN event_id % 43 = 0 THEN '-1' ELSE '33' END AS hardness, CASE WHEN event_id % 47 = 0 THEN NULL ELSE '120' END AS holder_length,
  CAST(event_id % 53 AS STRING) AS cycle, CAST(event_id % 59 - 1 AS STRING) AS sample, CAST(event_id % 61 - 1 AS STRING) AS countdown, CASE WHEN event_id % 67 = 0 THEN '1.5' ELSE '0.25' END AS countdown_share,
  CASE WHEN event_id % 71 = 0 THEN NULL ELSE CAST(value AS STRING) END AS sensor_a, CASE WHEN event_id % 73 = 0 THEN 'bad' ELSE '1' END AS sensor_b FROM {events}""",
    "v_weartest": """SELECT l_orderkey * 10 + l_linenumber AS case_no, l_partkey AS k, CASE l_partkey % 7 WHEN 0 THEN 'NEW' WHEN 1 THEN 'WORN' WHEN 2 THEN 'new' ELSE 'NEW' END AS tool_condition, CASE l_suppkey % 5 WHEN 0 THEN 'TiAlN' WHEN 1 THEN 'NONE' WHEN 2 THEN 'TiAlN' WHEN 3 THEN 'AlCrN' ELSE 'paint' END AS coating,
  CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE CAST(l_linenumber - 1 AS STRING) END AS replicate, CAST(l_quantity - 2 AS STRING) AS vc, CASE WHEN l_partkey % 17 = 0 THEN 'NaN' ELSE CAST(l_tax AS STRING) END AS fz, CASE WHEN l_partkey % 19 = 0 THEN '' ELSE '0.4' END AS ap, CAST(l_discount AS STRING) AS rq FROM {lineitem}""",
    "v_token": """SELECT l_orderkey AS drawing_id, l_partkey * 10 + l_linenumber AS token_id, l_suppkey AS s, CASE l_partkey % 14 WHEN 0 THEN 'M' || CAST(3 + l_suppkey % 30 AS STRING) || CASE WHEN l_suppkey % 2 = 0 THEN 'x1.5' ELSE '×1,25–6H-LH' END WHEN 1 THEN 'm' || CAST(3 + l_suppkey % 30 AS STRING) || ' - 6H' WHEN 2 THEN CASE WHEN l_suppkey % 2 = 0 THEN '1/4-20 UNC-2B' ELSE '#10–32 UNF' END WHEN 3 THEN 'G1/2 A'
  WHEN 4 THEN '3/4 NPT' WHEN 5 THEN 'H7/g6' WHEN 6 THEN CAST(10 + l_suppkey % 90 AS STRING) || ' H' || CAST(6 + l_linenumber AS STRING) WHEN 7 THEN 'Ra ' || CAST(l_linenumber AS STRING) || ',6 um' WHEN 8 THEN 'Rz' || CAST(l_linenumber * 4 AS STRING) WHEN 9 THEN 'NO MACHINING'
  WHEN 10 THEN 'ALL DIMENSIONS IN MM' WHEN 11 THEN 'ISO 2768-m' WHEN 12 THEN 'DATUM ' || CASE l_linenumber % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END ELSE CAST(l_quantity AS STRING) || ' DEEP' END AS text,
  CAST(l_partkey % 600 AS DOUBLE) AS x, CAST(l_suppkey % 400 AS DOUBLE) AS y, l_linenumber % 3 AS page FROM {lineitem}""",
    "v_planstep": """SELECT l_orderkey AS plan_id, l_linenumber AS step_id, CASE WHEN l_partkey % 9 = 0 THEN 1 ELSE l_linenumber END AS sequence_index, CASE WHEN l_linenumber = 1 THEN NULL WHEN l_partkey % 25 = 0 THEN l_linenumber WHEN l_partkey % 26 = 0 THEN 99 ELSE l_linenumber - 1 END AS predecessor,
  CASE WHEN l_partkey % 14 = 0 THEN NULL ELSE l_partkey * 1000 + l_linenumber END AS feature_id, CASE WHEN l_partkey % 15 = 0 THEN NULL WHEN l_linenumber = 5 THEN 'INSPECTION' ELSE CASE l_linenumber % 4 WHEN 0 THEN 'MILLING' WHEN 1 THEN 'DRILLING' WHEN 2 THEN 'TURNING' ELSE 'BORING' END END AS operation,
  CASE WHEN l_suppkey % 8 = 0 THEN NULL ELSE l_suppkey END AS machine_id, CASE WHEN l_partkey % 16 = 0 THEN NULL ELSE l_partkey END AS tool_id, CASE WHEN l_partkey % 18 = 0 THEN NULL ELSE l_suppkey % 25 END AS holder_id, CASE WHEN l_suppkey % 6 = 0 THEN NULL ELSE 50 + l_quantity END AS vc,
  CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE l_extendedprice / 10 END AS feed_rate, l_extendedprice / 100 AS path_mm, l_returnflag <> 'N' AS timed, l_linestatus = 'O' AS covered, l_quantity AS q, l_partkey AS k, l_suppkey AS s FROM {lineitem}""",
}
DUCK = re.compile(r"\{(\w+)\}")
SPARK_SQL = dict(VIEWS)
VIEWS = {k: DUCK.sub(r"\1", v) for k, v in VIEWS.items()}


class Shop:
    """The tables of a folder, and the domain views over them as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        text = SPARK_SQL[name]
        args = {t: self.table(t) for t in set(DUCK.findall(text))}
        for other in SPARK_SQL:
            if other != name and re.search(rf"\b{other}\b", text):
                text = re.sub(rf"\b{other}\b", f"{{{other}}}", text)
                args[other] = self.view(other)
        return self.spark.sql(text, **args)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("v_") or name in TABLES:
            return self.view(name) if name.startswith("v_") else self.table(name)
        raise AttributeError(name)
