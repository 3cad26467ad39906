"""Hand-made and brute-force cases: schedules against what was asked for, plan documents, process plans, values by precedence."""

import random
from collections import Counter

from pyspark.sql import functions as F

from shopspark.operators import costing, plan_documents, schedules


def _audit(spark, required, assigned, eligible, machines, before, windows, matrix=(), makespan=None):
    frame = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    held = None if windows is None else frame(windows, "machine_id long, start_s long, end_s long")
    out = schedules.violations(
        frame(required, "operation_id long, duration_s long"), frame(assigned, "operation_id long, machine_id long, start_s long, end_s long, setup_key string"), frame(eligible, "operation_id long, machine_id long"),
        frame([(m,) for m in machines], "machine_id long"), frame(before, "operation_id long, predecessor long"), held, frame(matrix, "from_key string, to_key string, seconds long"), 0, makespan,
    )
    return Counter((r.check_id, r.operation_id, r.machine_id) for r in out.collect())


def test_schedule_by_hand(spark):
    required = [(i, 10) for i in range(1, 9)]
    assigned = [
        (1, 1, 0, 10, "A"), (2, 1, 10, 20, "B"), (3, 1, 15, 25, "B"), (4, 2, 95, 105, "A"), (5, 9, 0, 12, None), (6, 2, None, 5, "A"), (7, 2, -5, 5, "A"), (7, 2, 30, 30, "A"),
        (99, 1, 200, 210, "A"), (None, None, 300, 310, "A"),
    ]
    eligible = [(1, 1), (2, 1), (3, 2), (4, 2), (6, 2), (7, 2)]
    got = _audit(spark, required, assigned, eligible, [1, 2], [(2, 1), (3, 2), (4, 8)], [(1, 0, 12), (1, 12, 40), (2, -10, 100)], [("A", "B", 5)], 310)
    assert got == Counter({
        ("SETUP_TOO_SHORT", 2, 1): 1, ("OVERLAP", 3, 1): 1, ("INELIGIBLE", 3, 1): 1, ("PRECEDENCE", 3, 1): 1, ("OUTSIDE_WINDOW", 4, 2): 1, ("UNKNOWN_MACHINE", 5, 9): 1, ("WRONG_DURATION", 5, 9): 1, ("OUTSIDE_WINDOW", 5, 9): 1,
        ("NOT_TIMED", 6, 2): 1, ("DUPLICATE", 7, 2): 2, ("NEGATIVE_START", 7, 2): 1, ("END_BEFORE_START", 7, 2): 1, ("UNKNOWN", 99, 1): 1, ("OUTSIDE_WINDOW", 99, 1): 1, ("MISSING", 8, None): 1,
        ("UNKNOWN", None, None): 1, ("UNKNOWN_MACHINE", None, None): 1, ("OUTSIDE_WINDOW", None, None): 1,
    })
    assert _audit(spark, [], [], [], [], [], None, makespan=5) == Counter()
    assert _audit(spark, [(1, 5)], [(1, 1, 0, 5, "A")], [(1, 1)], [1], [], None, makespan=6) == Counter({("MAKESPAN", None, None): 1})


def test_schedule_by_brute_force(spark):
    r = random.Random(5)
    required = [(i, r.randrange(1, 4)) for i in range(60)]
    assigned = []
    for i in range(60):
        start = r.randrange(-1, 40)
        assigned.append((i, r.randrange(4), start, start + r.choice([required[i][1], 2]), r.choice("AB")))
    eligible = sorted({(i, m) for i, m, *_ in assigned if i % 7} | {(0, 9)})
    before = [(i, r.randrange(60)) for i in range(0, 60, 2)]
    windows = [(m, s, s + r.randrange(2, 9)) for m in range(3) for s in range(0, 40, 6)]
    got = _audit(spark, required, assigned, eligible, [0, 1, 2, 3], before, windows, [("A", "B", 2)])
    covered = {m: {(t, t + 1) for w, s, e in windows if w == m for t in range(s, e)} for m in range(4)}
    want, by_id = Counter(), {a[0]: a for a in assigned}
    for i, m, s, e, key in assigned:
        add = lambda k: want.update([(k, i, m)])  # noqa: B023, E731
        earlier = sorted(((a[2], a[0]), a) for a in assigned if a[1] == m and (a[2], a[0]) < (s, i))
        if (i, m) not in eligible:
            add("INELIGIBLE")
        if s < 0:
            add("NEGATIVE_START")
        if e - s != required[i][1]:
            add("WRONG_DURATION")
        if any(a[3] > s for _, a in earlier):
            add("OVERLAP")
        if earlier and 0 <= s - earlier[-1][1][3] < (2 if (earlier[-1][1][4], key) == ("A", "B") else 0):
            add("SETUP_TOO_SHORT")
        if not all((t, t + 1) in covered[m] for t in range(s, e)):
            add("OUTSIDE_WINDOW")
    for i, p in before:
        if by_id[p][3] > by_id[i][2]:
            want[("PRECEDENCE", i, by_id[i][1])] += 1
    assert got == want


STEP = "plan_id long, step_id long, sequence_index long, setup_number long, operation string, machine_id long, tool_id long, holder_id long, feature_id long, vc double, feed_rate double, timed boolean, covered boolean, parameter_source string"


def test_manufacturing_plan(spark):
    rows = [
        (1, 2, 2, 2, "Final inspection", None, None, None, 7, None, None, True, True, None), (1, 1, 1, None, "milling", 4, 5, 6, 7, 90.0, 10.0, True, True, "CATALOG"), (1, 3, 3, 2, None, 4, None, None, 8, 0.0, None, False, False, None),
        (3, 1, 1, 1, "drilling", 1, 2, 3, 4, 50.0, 1.0, True, True, None),
    ]
    ops = plan_documents.operations(spark.createDataFrame(rows, STEP), ["sequence_index"]).withColumn("content", plan_documents.content(F.col("step_id"), F.col("operation")))
    edges = {(r.src, r.dst, r.node_type) for r in plan_documents.flow(ops).filter("plan_id = 1").collect()}
    assert edges == {("RAW_MATERIAL", "S1", "SETUP"), ("S1", "OP10", "OPERATION"), ("OP10", "S2", "SETUP"), ("S2", "OP20", "INSPECTION"), ("OP20", "OP30", "OPERATION"), ("OP30", "OUTPUT", "OUTPUT")}
    assert {tuple(r) for r in plan_documents.setups(ops).filter("plan_id = 1").collect()} == {(1, 1, 4, 1, 1, 1), (1, 2, 4, 1, 0, 2)}
    assert {(r.plan_id, r.op_number, r.source) for r in plan_documents.parameters(ops).collect()} == {(1, 10, "CATALOG"), (3, 10, "INSUFFICIENT_DATA")}
    chars = spark.createDataFrame([(1, 11), (1, 12), (2, 13)], "plan_id long, content long")
    critical = spark.createDataFrame([(1, 100, 7), (1, 101, None), (2, 102, 7)], "plan_id long, characteristic_id long, feature_id long")
    covered = spark.createDataFrame([(1, 100), (1, 101)], "plan_id long, characteristic_id long")
    heads = {r.plan_id: r for r in plan_documents.header(ops, chars, critical, covered).collect()}
    one, two, three = heads[1], heads[2], heads[3]
    assert (one.n_setups, one.n_operations, one.n_tools, one.n_machines, one.n_parameters, one.n_characteristics, one.n_flow_edges, one.n_hooks) == (2, 3, 1, 1, 1, 2, 6, 2 + 3)
    assert (one.blocking, one.review, one.advisory, one.gate) == (0, 1, 1, "REVIEW_REQUIRED")
    assert abs(one.completeness - (1 + 0.5 + 0.5 + 0.5 + 0.5 + 2 / 3 + 1) / 7) < 1e-9
    assert (two.n_operations, two.n_flow_edges, two.blocking, two.gate, two.warning) == (0, 0, 1, "BLOCKED", None)
    assert abs(two.completeness - 2 / 7) < 1e-9
    assert (three.warning, three.gate, three.band) == ("NO_CHARACTERISTICS", "READY_FOR_ENGINEERING_REVIEW", "MOSTLY_COMPLETE")
    again = {r.plan_id: r.fingerprint for r in plan_documents.header(ops.orderBy(F.desc("step_id")), chars, critical, covered).collect()}
    other = plan_documents.header(ops, chars.withColumn("content", F.col("content") + 1), critical, covered).filter("plan_id = 1").first().fingerprint
    assert again == {k: v.fingerprint for k, v in heads.items()} and other != one.fingerprint


def test_process_plan(spark):
    machines = spark.createDataFrame([(1, "milling;drilling", 8000, "BT40", "", 80.0, 200.0), (2, "milling", 1000, "BT40", "", 80.0, 200.0)], "machine_id long, processes string, max_rpm int, spindle_interface string, more_interfaces string, max_tool_d double, max_tool_len double")
    tools = spark.createDataFrame([(5, 10.0, "P;M", "milling", 10.0, 100.0, 9000, None), (6, 10.0, "P", "milling", None, 100.0, 9000, None)], "tool_id long, d_mm double, iso_groups string, operations string, shank_mm double, length_mm double, max_rpm int, insert_shape string")
    holders = spark.createDataFrame([(9, "BT40", "ER32", 3.0, 20.0, 12000)], "holder_id long, machine_interface string, tool_interface string, clamp_min double, clamp_max double, max_rpm int")
    references = spark.createDataFrame([(1, "milling", "P", 1.0, 2.0)], "record_id long, operation string, iso_group string, min_value double, max_value double")
    rows = [
        (1, 1, "Milling", "P", 1, 5, 9, 100.0, 100.0, 50.0, ("PLANNED", [])), (1, 2, "milling", "P", 2, 5, 9, 100.0, None, 50.0, ("BLOCKED", ["INCOMPATIBLE"])), (1, 3, "milling", "M", 1, 5, 9, 100.0, 0.0, 50.0, ("PLANNED", ["NO_REFERENCE"])),
        (1, 4, "milling", "P", 1, 6, 9, 100.0, None, None, ("INSUFFICIENT_DATA", ["COMPATIBILITY_UNKNOWN"])), (1, 5, "milling", "P", 1, 5, 9, None, None, None, ("INSUFFICIENT_DATA", ["COMPATIBILITY_UNKNOWN"])),
        (2, 1, None, "P", 1, 5, 9, 100.0, None, None, ("NOT_SUPPORTED", ["NOT_SUPPORTED"])), (2, 2, "milling", "Q", 1, 5, 9, 100.0, None, None, ("INSUFFICIENT_DATA", ["MATERIAL_GROUP"])), (2, 3, "milling", "P", None, 5, 9, 100.0, None, None, ("INSUFFICIENT_DATA", ["RESOURCE_UNKNOWN"])),
        (2, 4, "drilling", "P", 1, 5, 9, 100.0, None, None, ("INSUFFICIENT_DATA", ["NO_CANDIDATE", "NO_REFERENCE"])), (3, 1, "milling", "P", 2, 5, 9, 100.0, None, None, ("BLOCKED", ["INCOMPATIBLE"])), (4, 1, "milling", "P", 1, 5, 9, 100.0, 200.0, 50.0, ("PLANNED", [])),
    ]
    steps = spark.createDataFrame([x[:10] for x in rows], "plan_id long, step_id long, operation string, iso_group string, machine_id long, tool_id long, holder_id long, vc double, feed_rate double, path_mm double")
    planned = plan_documents.step_plans(steps, machines, tools, holders, references)
    assert {(r.plan_id, r.step_id): (r.state, r.reasons) for r in planned.collect()} == {x[:2]: x[10] for x in rows}
    faults = spark.createDataFrame([(2, 1), (2, 2)], "plan_id long, step_id long")
    got = {r.plan_id: (r.plan_status, r.n_planned, r.n_machines, r.n_timed, r.cutting_s, r.n_faults, r.dependencies_ok) for r in plan_documents.process_plans(planned, faults).collect()}
    assert got == {1: ("PARTIAL", 2, 1, 1, 30.0, 0, True), 2: ("INSUFFICIENT_DATA", 0, 0, 0, None, 2, False), 3: ("BLOCKED", 0, 0, 0, None, 0, True), 4: ("COMPLETE", 1, 1, 1, 15.0, 0, True)}
    assert plan_documents.process_plans(planned.limit(0), faults).count() == 0


def test_steps_move_twice(spark):
    """Once to their tools and once to their machines, where catalogs are too large to be broadcast; holders and scopes are counted and broadcast."""
    machines = spark.createDataFrame([(1, "milling", 8000, "BT40", "", 80.0, 200.0)], "machine_id long, processes string, max_rpm int, spindle_interface string, more_interfaces string, max_tool_d double, max_tool_len double")
    tools = spark.createDataFrame([(5, 10.0, "P;M", "milling", 10.0, 100.0, 9000, None)], "tool_id long, d_mm double, iso_groups string, operations string, shank_mm double, length_mm double, max_rpm int, insert_shape string")
    holders = spark.createDataFrame([(9, "BT40", "ER32", 3.0, 20.0, 12000)], "holder_id long, machine_interface string, tool_interface string, clamp_min double, clamp_max double, max_rpm int")
    references = spark.createDataFrame([(1, "milling", "P", 1.0, 2.0)], "record_id long, operation string, iso_group string, min_value double, max_value double")
    steps = spark.createDataFrame([(1, 1, "Milling", "P", 1, 5, 9, 100.0)], "plan_id long, step_id long, operation string, iso_group string, machine_id long, tool_id long, holder_id long, vc double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        planned = plan_documents.step_plans(steps, machines, tools, holders, references)
        assert planned._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") == 2
        assert [tuple(r) for r in planned.select("state", "reasons", "n_references").collect()] == [("PLANNED", [], 1)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rows_of_a_plan_are_not_multiplied(spark):
    """Distinct setups, tools and machines of a plan are counted without a copy of each row for each of them."""
    rows = [(1, i, i, None, "milling", 4 + i % 2, None if i % 3 == 0 else i % 5, 6, 7, 90.0, 10.0, True, True, None) for i in range(1, 31)]
    ops = plan_documents.operations(spark.createDataFrame(rows, STEP).withColumn("setup_number", F.col("step_id") % 3), ["sequence_index"]).withColumn("content", F.lit(1).cast("long"))
    none = spark.createDataFrame([], "plan_id long, characteristic_id long, feature_id long")
    head = plan_documents.header(ops, spark.createDataFrame([], "plan_id long, content long"), none, none.drop("feature_id"))
    want = ops.agg(F.count_distinct("setup"), F.count_distinct("tool_id"), F.count_distinct("machine_id")).first()
    assert tuple(head.select("n_setups", "n_tools", "n_machines").first()) == tuple(want)
    assert "Expand" not in head._jdf.queryExecution().executedPlan().toString()


def test_keys_without_values_stay(spark):
    rows = [(1, "B", 2.0), (1, "A", None), (1, "C", 3.0), (2, "A", None), (3, None, 5.0)]
    got = {tuple(r) for r in costing.by_precedence(spark.createDataFrame(rows, "k int, source string, value double"), "k", {"A": 0, "B": 1, "C": 2}).collect()}
    assert got == {(1, "B", 2.0, "C", "RESOLVED"), (2, None, None, "", "INSUFFICIENT_DATA"), (3, None, 5.0, "", "RESOLVED")}
