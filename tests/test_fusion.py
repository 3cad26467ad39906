"""Fusion of requirements and features against the plain loop over all pairs."""

import random
import re

from shopspark.operators import fusion as fu


def plain_score(kind, value, source, feature):
    _, kind_of, diameter, width, length = feature
    found = re.search(r"[0-9]+(\.[0-9]+)?", (value or "").replace(",", "."))
    round_ = "Ø" in (value or "") or "diam" in (value or "").lower()
    if kind == "DIMENSION" and not round_:
        own = next((x for x in (diameter, width, length) if x is not None), None)
    else:
        own = diameter if kind in ("DIMENSION", "THREAD", "FIT") else None
    if not found:
        size = 0.5
    elif kind in ("SURFACE_FINISH", "GDT_FCF"):
        size = 0.6
    elif own is None:
        size = 0.4
    else:
        gap = round(abs(float(found.group()) - own), 9)
        size = next((v for within, v in ((0.1, 1.0), (0.5, 0.85), (2, 0.6), (10, 0.3)) if gap <= within), 0.1)
    return round(0.25 * fu.SUITS.get(kind, {}).get(kind_of, 0.3) + 0.25 * size + 0.2 * 0.5 + 0.1 * 0.5 + 0.1 * 0.5 + 0.05 * (0.5 if source is None else source), 6)


def test_fusion_is_the_loop_over_all_pairs(spark):
    r = random.Random(4)
    kinds = [*fu.SUITS, "OTHER", "NOTE", None]
    types = ["THROUGH_HOLE", "HOLE", "PLANAR_FACE", "OUTER_DIAMETER", "CHAMFER", "BOSS", None]
    size = lambda: r.choice([None, round(r.uniform(0, 60), 1)])
    features = [(p, i, r.choice(types), size(), size(), size()) for p in range(3) for i in range(150)] + [(7, 1, "PLANAR_FACE", None, None, None), (7, 2, "CHAMFER", None, None, None)]
    texts = [None, "", "as shown", "Ø%s", "diam. %s", "%s depth", "W %s", "%s"]
    reqs = []
    for p in (0, 1, 2, 8):
        for i in range(150):
            t = r.choice(texts)
            reqs.append((p, i, r.choice(kinds), t and t.replace("%s", str(round(r.uniform(0, 70), 1)).replace(".", ",")), r.choice([None, 0.4, 0.95])))
    # Of one part, every third requirement meets a size that few features have.
    features += [(9, i, "HOLE", 5.0 + 20 * i, None, None) for i in range(6)]
    reqs += [(9, i, "DIMENSION", f"Ø{5 + 20 * i}", 1.0) for i in range(4)] + [(9, 4, "THREAD", "M5", 1.0)]
    f = spark.createDataFrame([(*x, "clash") for x in features], "part_id long, feature_id long, feature_type string, diameter double, width double, length double, score string")
    q = spark.createDataFrame([(*x, "clash") for x in reqs], "part_id long, req_id long, kind string, value string, source double, score string")
    linked = fu.links(q, f)
    got = {(x["part_id"], x["req_id"]): (x["score"], x["candidates"], x["state"], x["feature_id"]) for x in linked.collect()}
    want = {}
    for p, i, kind, value, source in reqs:
        pairs = sorted((-plain_score(kind, value, source, x[1:]), x[1]) for x in features if x[0] == p)
        if kind in (*fu.DRAWING_KINDS, None) or not pairs:
            want[p, i] = (None, None, "DRAWING_ONLY", None)
            continue
        s = -pairs[0][0]
        state = "UNRESOLVED" if s < 0.7 else "MULTIPLE_CANDIDATES" if len(pairs) > 1 and round(s + pairs[1][0], 6) < 0.15 else "AUTO_MATCHED"
        want[p, i] = (s, [x for _, x in pairs[:3]], state, None if state == "UNRESOLVED" else pairs[0][1])
    assert got == want
    assert {s for _, _, s, _ in got.values()} == {"AUTO_MATCHED", "MULTIPLE_CANDIDATES", "UNRESOLVED", "DRAWING_ONLY"}

    matched = {(p, v[3]) for (p, _), v in want.items() if v[2] == "AUTO_MATCHED"}
    asked = {p for p, *_ in reqs}
    left = fu.leftovers(q, f, linked)
    assert {(x["part_id"], x["feature_id"]): x["asks"] for x in left.collect()} == {(p, i): p in asked and t not in fu.SMALL for p, i, t, *_ in features if (p, i) not in matched and (p not in asked or t != fu.FACE)}
    out = {x["part_id"]: x["completeness"] for x in fu.outcomes(linked, f, left).collect()}
    assert out[7] == "CAD_ONLY" and out[8] == "DRAWING_ONLY" and out[9] == "PARTIAL" and set(out) == {0, 1, 2, 7, 8, 9}
    assert fu.links(q.limit(0), f).count() == 0 and fu.links(q, f.limit(0)).filter("state <> 'DRAWING_ONLY'").count() == 0


def test_small_parts_are_shuffled_once_a_side(spark):
    f = spark.createDataFrame([(p, i, "HOLE", 5.0 + i, None, None) for p in range(50) for i in range(4)], "part_id long, feature_id long, feature_type string, diameter double, width double, length double")
    q = spark.createDataFrame([(p, i, "DIMENSION", f"Ø{5 + i}", 1.0) for p in range(50) for i in range(4)], "part_id long, req_id long, kind string, value string, source double")
    linked = fu.links(q, f)
    plan = linked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Generate" not in plan
    assert all(x["candidates"][0] == x["req_id"] and len(x["candidates"]) == 3 for x in linked.collect())


def test_small_and_large_parts_agree(spark):
    """The rows of a part in both ways."""
    r = random.Random(7)
    size = lambda: r.choice([None, round(r.uniform(0, 30), 1)])
    f = spark.createDataFrame([(p, i, r.choice(["HOLE", "BOSS", "FILLET", None]), size(), size(), size()) for p in range(20) for i in range(r.randrange(8)) for _ in range(2)], "part_id long, feature_id long, feature_type string, diameter double, width double, length double")
    q = spark.createDataFrame([(p, i, r.choice([*fu.SUITS, "NOTE", None]), r.choice(["Ø", ""]) + str(round(r.uniform(0, 30), 1)), 0.9) for p in range(21) for i in range(6)], "part_id long, req_id long, kind string, value string, source double")
    few = sorted(map(str, fu.links(q, f).collect()))
    small, fu.SMALL_PART = fu.SMALL_PART, 0
    try:
        assert few == sorted(map(str, fu.links(q, f).collect()))
    finally:
        fu.SMALL_PART = small
