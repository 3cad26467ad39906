"""Greedy matching in rounds against the plain loop, and drawing tokens by hand."""

import random

from pyspark.sql import functions as F

from shopspark.operators import drawing, matching


def test_greedy_in_rounds_is_the_greedy_loop(spark):
    r = random.Random(9)
    rows = {(run, fix, f, i): r.randint(1, 3) for run in range(3) for fix in range(4) for f in range(14) for i in range(12) if r.random() < 0.35}
    rows |= {(9, 0, f, i): 1 + (i > f) for f in range(25) for i in range(25) if i in (f, f + 1, f - 1)}  # a long chain of wishes
    d = spark.createDataFrame([(*k, v) for k, v in rows.items()], "run_id long, fixture long, finding_no long, item_id long, level int")
    want, taken = set(), set()
    for run, fix, f in sorted({k[:3] for k in rows}):
        free = sorted((v, k[3]) for k, v in rows.items() if k[:3] == (run, fix, f) and (run, fix, k[3]) not in taken)
        if free:
            taken.add((run, fix, free[0][1]))
            want.add((run, fix, f, free[0][1], free[0][0]))
    assert {tuple(x) for x in matching.greedy(d).collect()} == want
    assert matching.greedy(d.limit(0)).count() == 0


def test_levels(spark):
    found = spark.createDataFrame([(1, 1, 1, " A  b ", None, None), (1, 1, 2, "x", " 5.0 ", "Millimeter"), (1, 1, 3, "x", "5.0", None), (1, 1, 4, " Ab", None, None)], "run_id long, fixture long, finding_no long, raw_text string, value string, unit string")
    truth = spark.createDataFrame([(1, 1, "a B", "NOTE", "5.0", "mm"), (1, 2, "q", "DIAMETER", "5.0", "mm"), (1, 3, "Ab ", "RADIUS", "5.0", None)], "fixture long, item_id long, expected_text string, feature_type string, value string, unit string")
    assert {(x.finding_no, x.item_id, x.level) for x in matching.match_levels(found, truth).collect()} == {(1, 1, 2), (2, 2, 3), (3, 3, 3), (4, 3, 1)}


def test_drawing_tokens(spark):
    want = {
        "M8×1,25": ("THREAD_METRIC", 8.0), "M10x1.5-6H-LH": ("THREAD_METRIC", 10.0), "m12 – 6g": ("THREAD_METRIC", 12.0), "M8y1": (None, None), "1/4-20 UNC-2B": ("THREAD_UN", None), "#10–32 UNF": ("THREAD_UN", None), "1/4-20 ABC": (None, None),
        "G1/2 A": ("THREAD_BSP", None), "R3/8": ("THREAD_BSP", None), "3/4-14 NPTF": ("THREAD_NPT", None), "H7/g6": ("FIT_PAIR", None), "H7-g6": ("FIT_PAIR", None), "Ø25 H7": ("FIT_SIZED", 25.0), "25,5h11": ("FIT_SIZED", 25.5), "Q25 H7": (None, None),
        "Ra 1,6 µm": ("SURFACE_FINISH", 1.6), "Rz3.2": ("SURFACE_FINISH", 3.2), "Ra 1.6 kg": (None, None), "NO  MACHINING": ("NO_MACHINING", None), "45 DEEP": (None, None), "": (None, None), "M8 (x)": (None, None),
    }
    d = spark.createDataFrame([(t,) for t in want], "t string").select("t", drawing.token_kind(F.col("t")).alias("k"), drawing.token_size(F.col("t")).alias("n"))
    assert {x.t: (x.k, x.n) for x in d.collect()} == want


def test_pages_of_few_features_are_shuffled_once(spark, monkeypatch):
    from shopspark.operators import drawing as dr

    a = spark.range(200).selectExpr("id % 9 AS page", "id AS annotation_id", "element_at(array('FIT', 'THREAD', 'GDT'), int(id % 3) + 1) AS kind", "double(id * 37 % 300) AS x", "double(id * 11 % 200) AS y")
    f = spark.range(150).selectExpr("id % 8 AS page", "id AS feature_id", "element_at(array('HOLE', 'SHAFT', 'THREADED_HOLE'), int(id * 7 % 3) + 1) AS feature_type", "double(id * 53 % 300) AS x", "double(id * 29 % 200) AS y")
    rows = lambda: {tuple(r) for r in dr.associated(a, f, ["page"]).selectExpr("page", "annotation_id", "feature_id", "round(score, 9) AS score", "rank").collect()}
    few = rows()
    assert dr.associated(a, f, ["page"])._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 2
    monkeypatch.setattr(dr, "SMALL_PAGE", 0)  # all pages by cells
    assert rows() == few and len(few) > 800
    monkeypatch.setattr(dr, "SMALL_PAGE", 18)  # some pages this way, some that
    assert rows() == few
    state = dr.association_state(a, dr.associated(a, f, ["page"]), ["page", "annotation_id"])
    assert state.count() == 200 and state.filter("state = 'UNRESOLVED'").select("page").distinct().collect() == [(8,)]
