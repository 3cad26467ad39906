"""Hand values and invariants of the operators."""

import math

import pytest
from pyspark.sql import functions as F

from shopspark.functions import nc as X
from shopspark.functions.formulas import ALL, BASIC
from shopspark.functions.tolerance import it_tolerance_um
from shopspark.operators import catalog, graph, intervals, linediff, nc, validation
from shopspark.plans.rules import STEP_RULES, Rule, RuleRegistry
from shopspark.sources import export, ingest
from shopspark.streaming import events


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_formula_values(spark):
    assert one(spark, BASIC["spindle_rpm"].value(vc=F.lit(100.0), d=F.lit(10.0))) == pytest.approx(3183.0988618)
    assert one(spark, ALL["crosshatch_deg"].value(vh=F.lit(12.0), vp=F.lit(46.0))) == pytest.approx(2 * math.degrees(math.atan(12 / 46)))
    assert one(spark, ALL["taylor_life"].value(vc=F.lit(100.0), c=F.lit(200.0), n=F.lit(0.25))) == pytest.approx(16.0)
    assert one(spark, ALL["pass_count"].value(stock=F.lit(5.0), ap=F.lit(2.0))) == 3


def test_formula_reasons(spark):
    r = lambda **k: one(spark, BASIC["spindle_rpm"].reason(**{n: F.lit(v).cast("double") for n, v in k.items()}))
    assert r(vc=None, d=1.0) == "MISSING_VC" and r(vc=1.0, d=0.0) == "NOT_POSITIVE_D" and r(vc=1.0, d=1.0) is None
    assert one(spark, ALL["feed_per_rev"].reason(z=F.lit(2.5), fz=F.lit(0.1))) == "NOT_WHOLE_Z"


def test_it_grade_at_step_bounds(spark):
    assert one(spark, it_tolerance_um(F.lit(7), F.lit(30.0))) == one(spark, it_tolerance_um(F.lit(7), F.lit(20.0)))
    assert one(spark, it_tolerance_um(F.lit(19), F.lit(30.0))) is None and one(spark, it_tolerance_um(F.lit(7), F.lit(501.0))) is None


def test_touching_windows_merge_and_holes_split(spark):
    w = spark.createDataFrame([(1, 0, 4), (1, 4, 8), (1, 10, 12), (2, 5, 5)], "m long, s long, e long")
    assert sorted(map(tuple, intervals.merge(w, "m", "s", "e").collect())) == [(1, 0, 8), (1, 10, 12)]
    h = spark.createDataFrame([(1, 2, 3), (1, 7, 11)], "m long, s long, e long")
    assert sorted(map(tuple, intervals.subtract(w, h, "m", "s", "e").collect())) == [(1, 0, 2), (1, 3, 7), (1, 11, 12)]


def test_import_outcomes(spark):
    b = spark.createDataFrame([(1, "a", False), (2, "a", True), (3, "b", True), (4, "b", True), (5, None, True), (6, "z", True)], "n long, id string, is_valid boolean")
    had = spark.createDataFrame([("z",)], "id string")
    out = lambda *r: [x["outcome"] for x in validation.import_rows(b, "id", ["n"], had, *r).orderBy("n").collect()]
    assert out(True, True) == ["INVALID", "DUPLICATE", "ACCEPTED", "DUPLICATE", "ACCEPTED", "DUPLICATE"]
    assert out(False, False) == ["INVALID", "ACCEPTED", "ACCEPTED", "DUPLICATE", "ACCEPTED", "DUPLICATE"]


def test_nc_motion_modal_and_arcs(spark):
    text = ["G21 G90", "T1", "M6", "G0 X0 Y0", "G1 X3 Y4 F100", "G91", "X3 (in) Y4", "G28 X0", "X5", "M30", "G1 X9"]
    m = nc.motion(spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(text)], "program_id long, line_no long, text string")).orderBy("line_no").collect()
    assert len(m) == 10 and [r["length"] for r in m][4:7] == [5.0, None, 5.0]
    assert m[8]["skipped"] and m[4]["segment"] == 1
    half = X.arc_length(F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(True))
    full = X.arc_length(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(False))
    assert one(spark, half) == pytest.approx(math.pi) and one(spark, full) == pytest.approx(2 * math.pi)


def test_arc_radius_needs_both_tolerances(spark):
    zero = F.lit(0.0)
    arc = lambda x, i: X.arc_length(zero, zero, F.lit(x), zero, F.lit(i), zero, zero, F.lit(True))
    r = spark.range(1).select(arc(2.0005, 1.0).alias("rel"), arc(100.005, 50.0).alias("both"), arc(20.0001, 10.0).alias("ok")).first()
    assert r.rel is None and r.both is None and abs(r.ok - 31.4159265) < 1e-4


def test_noted_codes_and_feed_modes(spark):
    lines = ["G21 G90 G0 X20 Y0 Z0", "G92 X0", "G1 X10 F100", "G95 F0.2", "G1 X20", "G94", "G54 G43 H1", "G1 X30 F50", "G91 G92 Y5", "G93 F3"]
    d = spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(lines)], "program_id long, line_no long, text string")
    m = {r.line_no: r for r in nc.motion(d).collect()}
    assert (m[2].length, m[2].px, m[3].feed_len, m[3].feed) == (None, 0.0, 10.0, 100.0)
    assert (m[4].feed, m[4].feed_rev, m[5].feed_len, m[8].feed, m[9].py, m[9].length) == (100.0, 0.2, 10.0, 50.0, 5.0, None)
    p = nc.programs(nc.motion(d)).first()
    assert (p.status, p.noted, p.last_feed_rev, p.max_feed) == ("PARTIAL", "G43,G54,G92,G93,G95", 0.2, 100.0)


def test_ordered_diff(spark):
    a = spark.createDataFrame([(1, 1, "A"), (1, 2, "B"), (1, 3, "C")], "program_id long, line_no long, text string")
    b = spark.createDataFrame([(1, 1, "A"), (1, 2, "X"), (1, 3, "C"), (1, 4, "D")], "program_id long, line_no long, text string")
    assert sorted(r["change"] for r in linediff.ordered_diff(a, b).collect()) == ["ADDED", "MODIFIED", "UNCHANGED", "UNCHANGED"]


def test_cycles_and_groups(spark):
    e = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, 2), (1, 3, 4), (2, 1, 2)], "plan_id long, src long, dst long")
    assert sorted(map(tuple, graph.cyclic_nodes(e).collect())) == [(1, 2), (1, 3), (1, 4)]
    g = spark.createDataFrame([(1, 2), (3, 2), (7, 8)], "a long, b long")
    assert sorted(map(tuple, graph.groups(g).collect())) == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)]


def test_long_chain_has_no_cycle(spark):
    e = spark.createDataFrame([(1, i, i + 1) for i in range(200)] + [(2, 1, 2), (2, 2, 1)], "plan_id long, src long, dst long")
    assert sorted(map(tuple, graph.cyclic_nodes(e).collect())) == [(2, 1), (2, 2)]


def test_coercion_and_guard(spark, tmp_path):
    assert one(spark, ingest.coerce(F.lit(" 12 "), "int")) == 12 and one(spark, ingest.coerce(F.lit("x"), "int")) is None
    assert one(spark, ingest.coerce(F.lit("Yes"), "bool")) is True and one(spark, ingest.coerce(F.lit("a; b;"), "list")) == ["a", "b"]
    assert tuple(one(spark, ingest.number_range(F.lit("0,2–0,4*")))) == (0.2, 0.4)
    assert one(spark, export.csv_guard(F.lit("=1+1"))) == "'=1+1"
    spark.createDataFrame([(1, "=x"), (2, None)], "id long, t string").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "p"))
    export.write_csv(spark.read.parquet(str(tmp_path / "p")), str(tmp_path / "c"))
    assert {r["t"] for r in ingest.read_csv_text(spark, str(tmp_path / "c")).collect()} == {"'=x", None}
    (tmp_path / "a.json").write_text('[{"id": 1, "tags": ["x"]}, {"id": 2}]')
    assert ingest.read_json_array(spark, str(tmp_path / "a.json"), "id long, tags array<string>").count() == 2


def test_missing_limit_is_no_pass(spark):
    df = spark.createDataFrame([(1, None), (2, 9.0)], "id long, lim double")
    assert [r["id"] for r in catalog.filter_least(df, lim=5).collect()] == [2]
    assert {r["s"] for r in df.select(validation.limit_status(F.lit(3.0), F.col("lim")).alias("s")).collect()} == {"INSUFFICIENT_DATA", "PASS"}


def test_rule_ids_are_taken_once():
    with pytest.raises(ValueError):
        RuleRegistry([Rule("a", (), lambda: F.lit("PASS"))] * 2)
    assert len(STEP_RULES.all()) == 4


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:00:{i % 60:02d}", i % 5, "edit" if i % 2 else "confirm", float(i)) for i in range(40)]
    df = spark.createDataFrame(rows + rows[:5], "event_id long, ts string, detection_id long, action string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    q = events.latest_state_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("latest").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    want = sorted(map(tuple, events.latest_state(df.dropDuplicates(["event_id"])).collect()))
    assert sorted(map(tuple, spark.table("latest").collect())) == want


def test_replay_reports_illegal_steps(spark):
    df = spark.createDataFrame([(1, 1, 1, "APPROVED"), (1, 2, 2, "ENGINEER_REVIEWED"), (1, 3, 3, "APPROVED"), (1, 4, 4, "SUPERSEDED")], "plan_id long, event_id long, ts long, to_status string")
    assert [r["legal"] for r in events.replay(df).orderBy("event_id").collect()] == [False, True, True, True]


def test_chains_cycles_and_levels(spark):
    from shopspark.operators import graph

    chain = spark.createDataFrame([(1, i, i + 1) for i in range(200)] + [(2, 1, 2), (2, 2, 1), (2, 2, 3)], "plan_id long, src long, dst long")
    assert sorted((r["plan_id"], r["node"]) for r in graph.cyclic_nodes(chain).collect()) == [(2, 1), (2, 2), (2, 3)]
    ok = chain.filter("plan_id = 1 AND src < 30")
    nodes = ok.select("plan_id", ok["src"].alias("node")).union(ok.select("plan_id", "dst")).distinct()
    assert sorted((r["node"], r["level"], r["position"]) for r in graph.topological(ok, nodes).collect()) == [(i, i, i + 1) for i in range(31)]
    assert graph.ancestors(ok).count() == 31 * 30 // 2
    bad = chain.filter("plan_id = 2")
    with pytest.raises(ValueError):
        graph.levels(bad, bad.select("plan_id", bad["src"].alias("node")).union(bad.select("plan_id", "dst")).distinct())


def test_small_graphs_take_no_rounds(spark, monkeypatch):
    import random

    from pyspark.sql import types as T

    r = random.Random(4)
    rows = [(p, r.randrange(6), r.randrange(6)) for p in range(40) for _ in range(r.randrange(1, 9))]
    shape = T.StructType([T.StructField("plan_id", T.LongType()), T.StructField("src", T.IntegerType()), T.StructField("dst", T.LongType())])
    e = spark.createDataFrame([*rows, (7, None, 2), (7, 3, None)], shape)
    for many in ("_ancestors_of_many", "_cyclic_of_many", "_levels_of_many"):
        monkeypatch.setattr(graph, many, None)
    paths = set(rows)
    while more := {(p, a, d) for p, a, b in paths for q, x, d in rows if (p, b) == (q, x)} - paths:
        paths |= more
    got = graph.ancestors(e)
    assert got.schema == shape or [f.dataType for f in got.schema] == [f.dataType for f in shape]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, paths | {(7, None, 2), (7, 3, None)}))
    ring = {(p, a) for p, a, b in paths if a == b}
    assert sorted(map(tuple, graph.cyclic_nodes(e).collect())) == sorted({(p, b) for p, a, b in paths if (p, a) in ring})
    up = {x for x in rows if x[1] < x[2]}
    nodes = sorted({(p, n) for p, a, b in up for n in (a, b) if n != 3} | {(p, 77) for p in range(40)})
    level = dict.fromkeys(nodes, 0)
    for _ in range(6):
        for p, a, b in sorted(up):
            if (p, a) in level and (p, b) in level:
                level[p, b] = max(level[p, b], level[p, a] + 1)
    got = graph.levels(spark.createDataFrame(sorted(up), shape), spark.createDataFrame(nodes, "plan_id long, node long"))
    assert sorted(map(tuple, got.collect())) == sorted((*k, v) for k, v in level.items())


@pytest.mark.parametrize("block", [3, 512])
def test_status_replay_against_a_loop(spark, block):
    import random

    from shopspark.streaming import events as ev

    r = random.Random(1)
    rows = [(p, e, float(r.randrange(50)), r.choice(ev.STATES[1:])) for p in range(6) for e in range(p * 1000, p * 1000 + r.randrange(40))]
    got = {(x["plan_id"], x["event_id"]): (x["from_status"], x["to_status"], x["legal"]) for x in ev.replay(spark.createDataFrame(rows, "plan_id long, event_id long, ts double, to_status string"), block).collect()}
    state, want = {}, {}
    for p, e, _, to in sorted(rows, key=lambda x: (x[0], x[2], x[1])):
        was = state.get(p, "DRAFT")
        ok = to == "SUPERSEDED" or (was, to) in ev.ALLOWED
        want[p, e] = (was, to, ok)
        state[p] = to if ok else was
    assert got == want


def test_arcs_cycles_and_decimal_codes(spark):
    from shopspark.operators import nc

    text = ["G21 G90", "G0 X0 Y0 Z5", "G2 X10 Y0 I5 J0", "G91.1", "G1 X20", "G98 G81 X30 Y0 Z-10 R2", "G80", "G1 X40", "G99 G83 X50 Z-3 R1", "G80 G0 Z5", "G18 G3 X60 Z5 I5 K0", "G17 G2 X70 R5", "G86 X80"]
    moves = {r["line_no"]: r for r in nc.motion(spark.createDataFrame([(1, i, t) for i, t in enumerate(text)], "program_id long, line_no long, text string")).collect()}
    near = lambda x: pytest.approx(x, abs=1e-6)
    assert moves[1]["skipped"] and moves[1]["length"] is None  # its start isn't known
    assert moves[2]["length"] == near(5 * math.pi) and moves[4]["length"] == near(10)  # G91.1 isn't G91
    assert (moves[5]["feed_len"], moves[5]["rapid_len"]) == (near(12), near(10 + 3 + 3)) and moves[5]["pz"] == near(5) and not moves[5]["skipped"]
    assert moves[7]["length"] == near(10)
    assert (moves[8]["feed_len"], moves[8]["rapid_len"]) == (near(4), near(10 + 4)) and moves[8]["pz"] == near(1) and moves[8]["skipped"]  # pecking: known in part
    assert moves[9]["length"] == near(4) and moves[10]["length"] == near(5 * math.pi)
    assert moves[11]["skipped"] and moves[11]["length"] is None and moves[12]["skipped"] and moves[12]["length"] is None
    total = nc.programs(nc.motion(spark.createDataFrame([(1, i, t) for i, t in enumerate(text)], "program_id long, line_no long, text string"))).first()
    assert total["status"] == "PARTIAL" and total["feed_mm"] == near(10 * math.pi + 10 + 12 + 10 + 4)


def test_partitions_follow_the_rows(spark, monkeypatch):
    from shopspark.operators import intervals, nc, spread

    monkeypatch.setattr(spread, "ROWS", 50)
    lines = spark.range(1000).selectExpr("id % 90 AS program_id", "id AS line_no", "'G1 X' || id AS text")
    assert nc.motion(lines).rdd.getNumPartitions() == 20
    w = spark.range(1000).selectExpr("id % 90 AS machine_id", "id * 10 AS start_h", "id * 10 + 6 AS end_h")
    left = intervals.subtract(w, w.selectExpr("machine_id", "start_h + 2 AS start_h", "start_h + 3 AS end_h"), "machine_id")
    assert left.rdd.getNumPartitions() == 20 and left.count() == 2000


def test_motion_sorts_once(spark):
    from shopspark.operators import nc

    lines = spark.range(1000).selectExpr("id % 90 AS program_id", "id AS line_no", "'G1 X' || id AS text")
    plan = nc.motion(lines)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and nc.motion(lines).count() == 1000
    text = ["G21 G90 X0.1 Y0 Z0", "G91 G1 X900000000000.5", "X0.1", "G90 X0.1", "G91 X0.1", "X0.2", "G20 X0.1"]
    moves = {r["line_no"]: r for r in nc.motion(spark.createDataFrame([(1, i, t) for i, t in enumerate(text)], "program_id long, line_no long, text string")).collect()}
    assert [moves[i]["px"] for i in (3, 4, 5, 6)] == [pytest.approx(x, abs=1e-9) for x in (0.1, 0.2, 0.4, 2.94)]  # long steps before don't blur later ones


def test_tools_stay_spread_where_wants_are_few(spark):
    from shopspark.queries import ENTRIES

    plan = ENTRIES["tool_candidates"].build(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    join = next(x for x in plan.splitlines() if "BroadcastHashJoin" in x)
    assert "BuildRight" in join and "REPARTITION_BY_NUM" in plan  # the tools aren't broadcast to the task that holds the wants


def test_line_counts_are_those_of_the_line_diff(spark):
    """Repeated lines, blanks around them, lines without text and programs of one revision only."""
    a = spark.createDataFrame([(1, 1, "G0"), (1, 2, "G0 "), (1, 3, None), (1, 4, "M5"), (2, 1, "G1"), (None, 1, "G1"), (4, 1, "x"), (4, 2, None)], "program_id long, line_no long, text string")
    b = spark.createDataFrame([(1, 1, "G0"), (1, 2, None), (1, 3, "M6"), (1, 4, "M6"), (3, 1, "G1"), (None, 1, "G1"), (4, 1, "x"), (4, 2, " x"), (4, 3, "x")], "program_id long, line_no long, text string")
    want = {r[0]: (r[1], r[2]) for r in nc.line_diff(a, b).groupBy("program_id").agg(F.count_if(F.col("change") == "ADDED"), F.count_if(F.col("change") == "REMOVED")).collect()}
    assert {r["program_id"]: (r["added"], r["removed"]) for r in nc.line_counts(a, b).collect()} == want
