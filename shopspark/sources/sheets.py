"""Sheets exported as CSV: the header row is found by its content, required columns must be there, bad rows go to quarantine."""

from __future__ import annotations

import csv
import io

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import _cut
from .ingest import blank_to_null, coerce, read_csv_text, read_json_array, typed

c = F.col

#: Column kinds of the catalogs, as `ingest.coerce` reads them.
MACHINES = {
    "stable_id": "string", "manufacturer": "string", "model": "string", "machine_type": "string", "supported_processes": "list", "axis_count": "int", "turning_capable": "bool", "milling_capable": "bool", "drilling_capable": "bool",
    "spindle_max_rpm": "int", "spindle_min_rpm": "int", "spindle_power_kw": "double", "spindle_torque_nm": "double", "spindle_interface": "string", "spindle_interfaces_supported": "list", "travel_x_mm": "double", "travel_y_mm": "double", "travel_z_mm": "double",
    "max_tool_diameter_mm": "double", "max_tool_length_mm": "double", "max_cutting_feed_mm_min": "double", "evidence_status": "string",
}
TOOLS = {
    "stable_id": "string", "manufacturer": "string", "product_name": "string", "tool_category": "string", "supported_operations": "list", "iso_material_groups": "list", "tool_material": "string", "insert_shape_code": "string",
    "cutting_diameter_mm": "double", "shank_diameter_mm": "double", "overall_length_mm": "double", "number_of_flutes": "int", "max_rpm": "int", "vc_min_mpm": "double", "vc_max_mpm": "double", "fz_min_mm": "double", "fz_max_mm": "double",
}
MATERIALS = {"material_id": "string", "designation": "string", "werkstoff_nr": "string", "aliases": "list", "iso_group": "string", "iso_subgroup": "string", "material_family": "string", "density": "double", "modulus": "double"}
#: Nested parts of a material in JSON; CSV has none of them.
MATERIAL_PARTS = (
    "conditions array<struct<condition_code:string,hardness:array<struct<scale:string,value_min:double,value_max:double>>>>, machinability struct<machinability_index:double,work_hardening:string,thermal_load:string>, "
    "tool_compatibility array<struct<tool_material:string,rating:string>>, cutting_references array<struct<operation:string,tool_material:string,vc_min_m_min:double,vc_max_m_min:double,fz_min_mm_tooth:double,fz_max_mm_tooth:double>>"
)
_TYPES = {"list": "array<string>", "bool": "boolean"}


def catalog_csv(spark: SparkSession, path: str, kinds: dict[str, str], sep: str = ";") -> DataFrame:
    """A catalog's CSV with typed columns; a column that the file lacks is NULL, one that the catalog doesn't know is left out."""
    rows = read_csv_text(spark, path)
    have = {x.strip().lower(): x for x in rows.columns}
    return typed(rows.select(*[c(f"`{have[k]}`").alias(k) if k in have else F.lit(None).cast("string").alias(k) for k in kinds]), kinds, sep)


def catalog_json(spark: SparkSession, path: str, kinds: dict[str, str], parts: str = "") -> DataFrame:
    """A catalog's JSON array of records."""
    schema = ", ".join([*[f"{k} {_TYPES.get(v, v)}" for k, v in kinds.items()], *([parts] if parts else [])])
    return read_json_array(spark, path, schema)


def header_name(text: str) -> str:
    """A header cell in one form: no byte-order mark, plain blanks, one between words, lower case."""
    return " ".join(text.replace("﻿", "").replace(" ", " ").split()).lower()


def _plain(x: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(x, "﻿", ""), "[\\s ]+", " ")))


def read_sheet(spark: SparkSession, path: str, required: list[str], sensors: str | None = None) -> DataFrame:
    """The rows below the header row of each file under path, as text: file, row_no, the required columns, and with a prefix the sensors.

    The header is the first line that holds all required names (compared as ``header_name``); the lines above it are a title and left
    out, and so are rows without any value. Raises ValueError naming the missing columns where no line has them all, and the files
    whose header differs. ``sensors`` is the prefix of the columns that become one array, in their order in the file. row_no counts a
    file's rows below the header, from 1.
    """
    names = [header_name(x) for x in required]
    text = spark.read.text(path)
    low = F.lower(F.replace("value", F.lit("\ufeff"), F.lit("")))
    fit = F.lit(True)
    for word in sorted({w for x in names for w in x.split()}):  # most lines lack a word, and needn't be brought into one form
        fit = fit & F.contains(low, F.lit(word))
    for x in names:
        fit = fit & F.contains(_plain(c("value")), F.lit(x))
    first = None
    for line in (r["value"] for r in text.filter(fit).toLocalIterator()):
        cells = [header_name(x) for x in next(csv.reader(io.StringIO(line)))]
        if all(x in cells for x in names):
            first = cells
            break
    if first is None:
        best = text.select(F.array(*[F.when(F.contains(_plain(c("value")), F.lit(x)), F.lit(x)) for x in names]).alias("h")).select(F.array_compact("h").alias("h")).orderBy(F.size("h").desc()).first()
        raise ValueError(f"columns missing from the header: {sorted(set(names) - set(best['h'] if best else []))}")
    columns = [f"c{i}" for i in range(len(first))]
    rows = spark.read.schema(T.StructType([T.StructField(x, T.StringType()) for x in columns])).option("header", False).option("mode", "PERMISSIVE").csv(path)
    at = F.struct(c("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    rows = rows.select(c("_metadata.file_path").alias("file"), at.alias("at"), F.array(*columns).alias("cells"))
    # The first cell tells most rows apart from the header; all cells of the others are compared. There is one row per file.
    head = (F.coalesce(_plain(F.get("cells", F.lit(0))), F.lit("")) == first[0]) & (F.transform("cells", lambda x: F.coalesce(_plain(x), F.lit(""))) == F.array(*map(F.lit, first)))
    heads = _cut(rows.groupBy("file").agg(F.min(F.when(head, c("at"))).alias("head")))
    lost = [r["file"] for r in heads.filter("head IS NULL").select("file").limit(10).collect()]
    if lost:
        raise ValueError(f"no such header in {lost}")
    below = rows.join(F.broadcast(heads), "file").filter((c("at") > c("head")) & F.exists("cells", lambda x: F.coalesce(F.trim(x) != "", F.lit(False))))
    below = below.withColumn("row_no", F.row_number().over(W.partitionBy("file").orderBy("at")).cast("long"))
    out = [F.get("cells", F.lit(first.index(x))).alias(y) for x, y in zip(names, required, strict=True)]
    if sensors is not None:
        mine = [i for i, x in enumerate(first) if x.startswith(header_name(sensors)) and x not in names]
        out.append(F.array(*[F.get("cells", F.lit(i)) for i in mine]).alias("sensors"))
    return below.select("file", "row_no", *out)


def judged(rows: DataFrame, kinds: dict[str, str], rules: list[tuple[str, Column]] = (), sensors: bool = False) -> DataFrame:
    """The rows of a sheet with their cells typed, as text (_text_column), the sensors' numbers (_values) and the first reason against a row.

    A cell is bad when it is empty or can't be read as its kind (UNREADABLE:column); then ``rules`` (code, condition over the typed
    columns) are tried in order. A sensor that can't be read is NULL and spoils no row; a row without any sensor is (NO_SENSORS).
    """
    read = {k: coerce(c(k), v) for k, v in kinds.items()}
    flags = [F.when(v.isNull(), F.lit(f"UNREADABLE:{k}")) for k, v in read.items()]
    d = rows.withColumn("_typed", F.struct(*[v.alias(k) for k, v in read.items()])).withColumn("_cells", F.coalesce(*flags))
    if sensors:
        d = d.withColumn("_values", F.transform("sensors", lambda x: blank_to_null(x).try_cast("double")))
        d = d.withColumn("_cells", F.coalesce("_cells", F.when(~F.exists("sensors", lambda x: blank_to_null(x).try_cast("double").isNotNull()), F.lit("NO_SENSORS"))))
    typed_rows = d.withColumns({f"_text_{k}": c(k) for k in kinds}).withColumns({k: c(f"_typed.{k}") for k in kinds})
    reason = F.coalesce("_cells", *[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in rules])
    return typed_rows.withColumn("reason", reason)


def checked(rows: DataFrame, kinds: dict[str, str], rules: list[tuple[str, Column]] = (), sensors: bool = False) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows of ``judged``: good ones typed; bad ones as text with the first reason."""
    typed_rows = judged(rows, kinds, rules, sensors)
    extra = [c("_values").alias("sensors")] if sensors else []
    good = typed_rows.filter("reason IS NULL").select("file", "row_no", *kinds, *extra)
    bad = typed_rows.filter("reason IS NOT NULL").select("file", "row_no", "reason", F.to_json(F.struct(*[c(f"_text_{k}").alias(k) for k in kinds])).alias("row"))
    return good, bad


def quarantine(bad: DataFrame, path: str) -> None:
    """The bad rows as JSON lines under path, beside what is there."""
    bad.write.mode("append").json(path)
