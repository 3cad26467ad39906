"""Hand-made and brute-force cases: frames, features, substrings, patterns, setups, geometry."""

import contextlib
import io
import math
import random

import pytest
from pyspark.sql import functions as F

from shopspark.operators import campaign, candidates, frames, intervals, quality


def test_frame_text(spark):
    want = {
        "⌖ Ø0,05 Ⓜ A|B-C": ("POSITION", 0.05, "mm", True, "MMC", ["A", "B", "C"]),
        "perpendicularity 0.1 in A A": ("PERPENDICULARITY", 0.1, "inch", False, None, ["A"]),
        "PROFILE OF A SURFACE .5": ("PROFILE_OF_A_SURFACE", 5.0, "mm", False, None, []),
        "FLATNESS": ("FLATNESS", None, None, False, None, []),
        "Ra 1.6": None, "": None, None: None, "0.05 A": None,
    }
    d = spark.createDataFrame([(t,) for t in want], "t string").select("t", frames.segment(F.col("t")).alias("s"))
    assert {r.t: None if r.s is None else tuple(r.s) for r in d.collect()} == want
    two = spark.createDataFrame([("⌖ Ø0.5 A", "0.2 A"), ("⌖ 0.1 A", "0.2"), ("x", "0.2"), ("⌖ 0.1", "A"), ("⌖ 0.1 mm", "0.1 in")], "u string, l string").select(frames.composite(F.col("u"), F.col("l")).alias("f")).select("f.state", "f.lower.characteristic")
    assert [tuple(r) for r in two.collect()] == [("COMPOSITE", "POSITION"), ("LOWER_LARGER", "POSITION"), ("NO_FRAME", None), ("NO_TOLERANCE", "POSITION"), ("UNITS_DIFFER", "POSITION")]


def test_requirements_are_used_once(spark):
    r = random.Random(2)
    rows = [(d, i, *r.choice([("THREAD", None, None), ("DIMENSION", "diameter", None), ("DIMENSION", "Depth", r.choice([None, "slot"])), ("DIMENSION", "radius", None), ("DIMENSION", "linear", r.choice([None, "groove", "a SLOT", "pocket slot"]))]), float(i)) for d in range(30) for i in range(r.randrange(12))]
    got = frames.recognised(spark.createDataFrame([(a, b, k, t, v, n) for a, b, k, t, n, v in rows], "drawing_id int, req_id int, kind string, dimension_type string, value double, note string")).collect()
    used = [(x.drawing_id, q) for x in got for q in (x.req_id, x.depth_req_id) if q is not None]
    assert len(used) == len(set(used))
    want = set()
    for d in range(30):
        mine, gone = [x for x in rows if x[0] == d], set()
        depths = [x for x in mine if (x[3] or "").lower() == "depth"]
        for x in mine:
            if x[3] == "diameter":
                z = next((y for y in depths if y[1] not in gone), None)
                gone |= {x[1]} | ({z[1]} if z else set())
                want.add((d, x[1], "HOLE", z and z[1]))
        for x in mine:
            words = f"{x[3] or ''} {x[4] or ''}".lower()
            kind = "THREAD" if x[2] == "THREAD" else next((f for w, f, _ in frames.BY_WORD if w in words), None)
            if x[1] not in gone and kind:
                want.add((d, x[1], kind, None))
    assert {(x.drawing_id, x.req_id, x.feature_type, x.depth_req_id) for x in got} == want


def test_substrings(spark):
    r = random.Random(1)
    texts = [(i, "".join(r.choice("abc ") for _ in range(r.randrange(9)))) for i in range(150)]
    asked = {"".join(r.choice("abc ") for _ in range(r.randrange(1, 6))) for _ in range(60)} | {"zz", "z"}
    q, t = spark.createDataFrame([(x,) for x in asked], "q string"), spark.createDataFrame(texts, "id int, text string")
    out = candidates.holding(q, t, "id")
    assert {tuple(x) for x in out.collect()} == {(x, i) for x in asked for i, s in texts if x in s}
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        out.explain()
    assert "NestedLoop" not in said.getvalue() and "Cartesian" not in said.getvalue()


def test_hole_patterns_by_hand(spark):
    at = lambda part, points: [(part, "HOLE", 5.04, float(x), float(y)) for x, y in points]
    rows = at(1, [(10 + 3 * i, 5 + 4 * i) for i in (3, 0, 2, 1)]) + at(2, [(20 * math.cos(k), 20 * math.sin(k)) for k in (0, math.pi / 2, math.pi, 3 * math.pi / 2)])
    rows += at(3, [(0, 0), (5, 0), (20, 0)]) + at(4, [(1, 1), (1, 1)]) + at(5, [(0, 0), (0, 7)]) + at(6, [(0, 0)]) + at(7, [(0, 0), (5, 1), (10, 0), (15, 1)]) + [(8, "SLOT", 5.0, 0.0, 0.0)]
    got = {r.part_id: tuple(r)[2:] for r in quality.pattern_types(spark.createDataFrame(rows, "part_id int, feature_type string, d_mm double, x double, y double")).collect()}
    assert got == {1: (4, "LINEAR", None, None, 5.0), 2: (4, "CIRCULAR", 40.0, 90.0, None), 3: (3, "NONE", None, None, None), 4: (2, "NONE", None, None, None), 5: (2, "LINEAR", None, None, 7.0), 7: (4, "NONE", None, None, None)}


def test_setup_spans_by_hand(spark):
    jobs = [(1, 1, 100, 150, "A"), (2, 1, 200, 250, "B"), (3, 1, 300, 350, "B"), (4, 1, 500, 620, "A"), (5, 1, 900, 910, "B"), (6, 2, 0, 5, "A"), (7, 2, 50, 60, "B")]
    d = spark.createDataFrame(jobs, "operation_id long, machine_id long, start_s long, end_s long, setup_key string")
    w = spark.createDataFrame([(1, 0, 210), (1, 210, 400), (1, 450, 600), (3, 0, 9)], "machine_id long, start_s long, end_s long")
    matrix = spark.createDataFrame([("B", "B", 0)], "from_key string, to_key string, seconds long")
    got = {r.operation_id: (r.span_s, r.state) for r in intervals.setup_spans(d, matrix, 20, w).collect()}
    assert got == {2: (180, "FITS"), 4: (480, "CROSSES"), 5: (880, "OUTSIDE"), 7: (30, "NO_CALENDAR")}


def test_directions_keep_their_length_and_are_not_shifted(spark):
    m = campaign.rotation((1, 1, 1), 120, (5, 6, 7))
    p = lambda x, y, z: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(z).alias("z"))
    r = spark.range(1).select(campaign.place(m, p(1.0, 2.0, 3.0), F.lit(10.0)).alias("at"), campaign.place(m, p(1.0, 2.0, 2.0), F.lit(10.0), 0.0).alias("way")).first()
    assert all(abs(a - b) < 1e-9 for a, b in zip(r["at"], (35, 16, 27), strict=True)) and all(abs(a - b) < 1e-9 for a, b in zip(r["way"], (2, 1, 2), strict=True))
    with pytest.raises(ValueError, match="axis"):
        campaign.rotation((0, 0, 0), 10)
