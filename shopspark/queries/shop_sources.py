"""Reports and sheets that are written out and read back."""

import uuid

from pyspark.sql import functions as F

from ..operators.graph import shared_folder
from ..sources import reports, sheets
from .registry import query

c = F.col


def report_texts(shop):
    """Reports of two sections with a table each (their columns in another order), a footnote and a table that isn't about cutting."""
    r = shop.v_report
    turning = F.concat_ws(" | ", F.lit("|"), "iso_group", "tool_material", "speed", "feed", F.lit("|"))
    milling = F.concat_ws("|", F.lit(""), "speed", "iso_group", "feed", "tool_material", F.lit(""))
    tidy = F.regexp_replace(F.regexp_replace(turning, r"^\| \| ", "| "), r" \| \|$", " |")
    rows = r.select("report_id", "k", "operation", F.when(c("operation") == "Turning", tidy).otherwise(milling).alias("line"))
    part = lambda o: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c("operation") == o, F.struct("k", "line")))), lambda x: x["line"]), "\n")
    g = rows.groupBy("report_id").agg(part("Turning").alias("t"), part("Milling").alias("m"))
    head = F.concat(F.lit("# Report "), c("report_id"), F.lit("\n\n| A | B |\n|---|---|\n| 1 | 2 |\n"))
    one = F.concat(F.lit("\n## Turning data\n\n| ISO group | Tool | vc (m/min) | f [mm/rev] |\n|:--|---|---|--:|\n"), c("t"), F.lit("\n\n* with coolant\n"))
    two = F.concat(F.lit("\n## Milling data\ntext\n| Cutting speed | Material | fz | Tool material |\n|---|---|---|---|\n"), c("m"), F.lit("\n* dry only\n* second\n"))
    return g.select("report_id", F.concat(head, one, two).alias("text"))


@query("report_parameters", """WITH p AS (SELECT report_id, k, lower(operation) AS operation, nullif(iso_group, '') AS iso_group, nullif(tool_material, '') AS tool_material, operation || ' data/' || CASE operation WHEN 'Turning' THEN 2 ELSE 3 END || '/' || row_number() OVER (PARTITION BY report_id, operation ORDER BY k) AS source, speed, p_size AS z FROM v_report),
  v AS (SELECT report_id, source, operation, iso_group, tool_material, 'cutting_speed' AS parameter_type, 'm/min' AS unit, CASE WHEN speed = 'n/a' THEN NULL WHEN k % 19 = 0 THEN z + 90 ELSE z + 40 END::DOUBLE AS low, CASE WHEN speed = 'n/a' THEN NULL WHEN k % 19 = 0 THEN z + 40 ELSE z + 90 END::DOUBLE AS high, CASE WHEN speed LIKE '%*' THEN CASE operation WHEN 'turning' THEN 'with coolant' ELSE 'dry only' END END AS note FROM p WHERE speed <> '-'
    UNION ALL SELECT report_id, source, operation, iso_group, tool_material, CASE operation WHEN 'turning' THEN 'feed_per_rev' ELSE 'feed_per_tooth' END, CASE operation WHEN 'turning' THEN 'mm/rev' ELSE 'mm/tooth' END, (1 + k % 4) / 10.0, (5 + k % 4) / 10.0, NULL FROM p)
  SELECT *, CASE WHEN low IS NULL THEN 'NO_RANGE' WHEN low > high THEN 'REVERSED' WHEN iso_group IS NULL THEN 'NO_SCOPE' END AS problem FROM v""")
def report_parameters(shop):
    """Reports to parameter records, with unit, scope, footnote and source."""
    return reports.parameters(report_texts(shop), "report_id")


SENSORS = 120
LIFE = {"event_id": "long", "tool_index": "int", "cycle": "int", "countdown": "int", "adoc": "double", "hardness": "double"}


@query("life_sheet", f"""WITH x AS (SELECT event_id, TRY_CAST(tool_index AS INT) AS tool_index, TRY_CAST(cycle AS INT) AS cycle, TRY_CAST(countdown AS INT) AS countdown, TRY_CAST(adoc AS DOUBLE) AS adoc, TRY_CAST(hardness AS DOUBLE) AS hardness, TRY_CAST(sensor_a AS DOUBLE) AS s FROM v_lifetest)
  SELECT event_id, CASE WHEN tool_index IS NULL THEN 'UNREADABLE:tool_index' WHEN s IS NULL THEN 'NO_SENSORS' WHEN adoc <= 0 THEN 'DEPTH_NOT_POSITIVE' WHEN hardness <= 0 THEN 'HARDNESS_NOT_POSITIVE' WHEN countdown < 0 THEN 'COUNTDOWN_NEGATIVE' END AS reason FROM x""")
def life_sheet(shop):
    """A tool-life sheet of 120 sensor columns, written out whole, read back and checked; every row is good or has a reason."""
    path = f"{shared_folder(shop.spark)}/sheets-{uuid.uuid4().hex}"
    values = [(c("sensor_a").try_cast("double") * (i + 1)).cast("string").alias(f"Sensor {i + 1}") for i in range(SENSORS)]
    shop.v_lifetest.select(*values, *[c(k).cast("string").alias(k.replace("_", " ").title()) for k in LIFE]).write.option("header", True).csv(path)
    names = {k.replace("_", " ").title(): k for k in LIFE}
    rows = sheets.read_sheet(shop.spark, path, list(names), "sensor").withColumnsRenamed(names)
    rules = [("DEPTH_NOT_POSITIVE", c("adoc") > 0), ("HARDNESS_NOT_POSITIVE", c("hardness") > 0), ("COUNTDOWN_NEGATIVE", c("countdown") >= 0)]
    d = sheets.judged(rows, LIFE, rules, sensors=True)
    d = d.filter((F.size("sensors") == SENSORS) | c("reason").isNotNull())
    return d.select(c("_text_event_id").cast("long").alias("event_id"), "reason")
