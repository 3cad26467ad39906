"""Sheet and catalog files that the test writes: a shifted header, a missing column, bad rows, quarantine; reports by hand."""

import json

import pytest
from pyspark.sql import functions as F

from shopspark.sources import reports, sheets

KINDS = {"Tool Index": "int", "Depth": "double"}


def sheet(tmp_path, name, lines):
    folder = tmp_path / name
    folder.mkdir(exist_ok=True)
    for i, text in enumerate(lines):
        (folder / f"part{i}.csv").write_text("\n".join(text) + "\n", encoding="utf-8")
    return str(folder)


def test_header_is_found_and_bad_rows_leave(spark, tmp_path):
    head = "﻿S1,S2, tool   index ,Note,DEPTH,S3"
    path = sheet(tmp_path, "good", [["Tool life,,", "measured 2020", head, "1.5,2,7,a,0.5,x", ",,,,,", ",,8,b,0.25,", '3,,9,"c, d",bad,1', "4,5,,e,1,2"], [head, "6,7,5,f,-1,8"]])
    rows = sheets.read_sheet(spark, path, list(KINDS), "s")
    assert rows.columns == ["file", "row_no", "Tool Index", "Depth", "sensors"] and rows.count() == 5
    good, bad = sheets.checked(rows, KINDS, [("DEPTH_NOT_POSITIVE", F.col("Depth") > 0)], sensors=True)
    assert [(r["row_no"], r["Tool Index"], r["Depth"], r["sensors"]) for r in good.collect()] == [(1, 7, 0.5, [1.5, 2.0, None])]
    assert sorted((r.row_no, r.reason) for r in bad.collect()) == [(1, "DEPTH_NOT_POSITIVE"), (2, "NO_SENSORS"), (3, "UNREADABLE:Depth"), (4, "UNREADABLE:Tool Index")]
    for _ in range(2):
        sheets.quarantine(bad, str(tmp_path / "bad"))
    kept = spark.read.json(str(tmp_path / "bad"))
    assert kept.count() == 8 and json.loads(kept.filter("row_no = 3").first()["row"]) == {"Tool Index": "9", "Depth": "bad"}


def test_missing_columns_are_named(spark, tmp_path):
    with pytest.raises(ValueError, match="depth"):
        sheets.read_sheet(spark, sheet(tmp_path, "lacks", [["title", "tool index,note", "1,a"]]), list(KINDS))
    with pytest.raises(ValueError, match="part1.csv"):
        sheets.read_sheet(spark, sheet(tmp_path, "differs", [["tool index,depth", "1,2"], ["depth,tool index", "1,2"]]), list(KINDS))


def test_catalog_files(spark, tmp_path):
    (tmp_path / "m.csv").write_text("stable_id, Model ,supported_processes,spindle_max_rpm,milling_capable,other\nM1,X,milling; drilling ;,8000,yes,q\nM2,,,fast,,\n")
    one, two = sheets.catalog_csv(spark, str(tmp_path / "m.csv"), sheets.MACHINES).orderBy("stable_id").collect()
    assert (one.model, one.supported_processes, one.spindle_max_rpm, one.milling_capable, one.travel_x_mm) == ("X", ["milling", "drilling"], 8000, True, None)
    assert (two.model, two.supported_processes, two.spindle_max_rpm, two.milling_capable) == (None, [], None, None)
    (tmp_path / "t.csv").write_text("stable_id,iso_material_groups\nT1,P|M\n")
    assert sheets.catalog_csv(spark, str(tmp_path / "t.csv"), sheets.TOOLS, "|").first().iso_material_groups == ["P", "M"]
    (tmp_path / "x.json").write_text(json.dumps([{"material_id": "A", "aliases": ["b"], "conditions": [{"condition_code": "N", "hardness": [{"scale": "HB", "value_min": 1, "value_max": 2.5}]}], "new": 1}]))
    r = sheets.catalog_json(spark, str(tmp_path / "x.json"), sheets.MATERIALS, sheets.MATERIAL_PARTS).first()
    assert r.aliases == ["b"] and r.conditions[0].hardness[0].value_max == 2.5 and r.machinability is None


def test_report_by_hand(spark):
    text = "## Milling\n| ISO | vc | ap (in) | other |\n|-|-|-|-|\n| P | 1,5–2* | 3 | 9 |\n| | 7 | - | |\n* wet\n\n| ISO | vc |\n| P | 1 |\n## Prices\n| ISO | vc |\n|-|-|\n| P | 1 |\n"
    d = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string")
    got = {(r.source, r.parameter_type): (r.operation, r.iso_group, r.unit, r.low, r.high, r.note, r.problem) for r in reports.parameters(d, "id").collect()}
    assert got == {
        ("Milling/1/1", "cutting_speed"): ("milling", "P", "m/min", 1.5, 2.0, "wet", None),
        ("Milling/1/1", "depth_of_cut"): ("milling", "P", "in", 3.0, 3.0, None, None),
        ("Milling/1/2", "cutting_speed"): ("milling", None, "m/min", 7.0, 7.0, None, "NO_SCOPE"),
    }


def test_rows_are_judged_in_one_pass(spark):
    from shopspark.queries import ENTRIES

    d = ENTRIES["life_sheet"].build(spark, "/root/testdata/sf0.001")
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 1 and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
    assert d.count() == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
