"""Scores of recognition campaigns, route benchmarks, points and faces, and the audit of a schedule."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

c = F.col

#: Limits of a campaign.
LEAST_RECALL, LEAST_PRECISION, MOST_WORST_S, MOST_MEDIAN_S = 0.80, 0.85, 480.0, 240.0


#: Levels of a campaign's ROLLUP: what stays of (class, fixture), and its grouping id.
LEVELS = [(("class", "fixture"), 0), (("class",), 1), ((), 3)]


def at_share(counts: DataFrame, group: list[str], value: str, share: float = 0.9) -> DataFrame:
    """(group, at) of counts (group, value, n): the element at int(share n) of the sorted values, the last one at most, not interpolated.

    Values come with their counts, so the largest group sorts its distinct values only.
    """
    w = W.partitionBy(*group)
    d = counts.withColumns({"_upto": F.sum("n").over(w.orderBy(value)), "_all": F.sum("n").over(w)})
    index = F.least(F.floor(c("_all") * share), c("_all") - 1)
    return d.filter(c("_upto") > index).groupBy(*group).agg(F.min(value).alias("at"))


def campaign(scores: DataFrame) -> DataFrame:
    """ROLLUP over (class, fixture) of run scores (class, fixture, run_id, tp, n_found, n_items, seconds): pooled recall and precision, times, runs."""
    out = scores.rollup("class", "fixture").agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("runs"), F.round(F.try_divide(F.sum("tp"), F.sum("n_items")), 6).alias("recall"), F.round(F.try_divide(F.sum("tp"), F.sum("n_found")), 6).alias("precision"),
        F.median("seconds").alias("median_s"), F.max("seconds").alias("worst_s"),
    )
    keys = ["class", "fixture", "level"]
    own = lambda k, kept: (c(k) if k in kept else F.lit(None).cast(scores.schema[k].dataType)).alias(k)
    each = F.explode(F.array(*[F.struct(own("class", kept), own("fixture", kept), F.lit(n).cast("long").alias("level")) for kept, n in LEVELS]))
    times = scores.filter("seconds IS NOT NULL").groupBy("class", "fixture", "seconds").agg(F.count(F.lit(1)).alias("n")).select(each.alias("g"), "seconds", "n").select("g.*", "seconds", "n")
    p = at_share(times.groupBy(*keys, "seconds").agg(F.sum("n").alias("n")), keys, "seconds").alias("p")
    o = out.alias("o")
    d = o.join(p, [c(f"o.{k}").eqNullSafe(c(f"p.{k}")) for k in keys], "left")
    return d.select(*[f"o.{x}" for x in ("class", "fixture", "level", "runs", "recall", "precision", "median_s")], c("p.at").alias("p90_s"), "o.worst_s")


def thresholds(totals: DataFrame) -> DataFrame:
    """(class, fixture, level, check_id, value, ok) of each limit; a value that isn't known isn't ok."""
    cases = [("RECALL", c("recall"), c("recall") >= LEAST_RECALL), ("PRECISION", c("precision"), c("precision") >= LEAST_PRECISION), ("MEDIAN_S", c("median_s"), c("median_s") <= MOST_MEDIAN_S), ("WORST_S", c("worst_s"), c("worst_s") <= MOST_WORST_S)]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("check_id"), v.cast("double").alias("value"), F.coalesce(ok, F.lit(False)).alias("ok")) for k, v, ok in cases])).alias("t")
    return totals.select("class", "fixture", "level", each).select("class", "fixture", "level", "t.*")


def failing_items(runs: DataFrame, required: DataFrame, hits: DataFrame, first: int = 3, misses: int = 2) -> DataFrame:
    """(fixture, item_id, missed): required items that at least ``misses`` of a fixture's first runs miss."""
    early = runs.select("fixture", "run_id").distinct().withColumn("_n", F.row_number().over(W.partitionBy("fixture").orderBy("run_id"))).filter(c("_n") <= first)
    want = early.join(required.select("fixture", "item_id").distinct(), "fixture")
    lost = want.join(hits.select("fixture", "run_id", "item_id").distinct(), ["fixture", "run_id", "item_id"], "left_anti")
    return lost.groupBy("fixture", "item_id").agg(F.count(F.lit(1)).alias("missed")).filter(c("missed") >= misses)


def repeated_wrong(wrong: DataFrame) -> DataFrame:
    """(fixture, text, runs): wrong values that at least two runs give."""
    return wrong.groupBy("fixture", "text").agg(F.count_distinct("run_id").alias("runs")).filter("runs >= 2")


def route_benchmark(routes: DataFrame, expected: DataFrame) -> DataFrame:
    """(part_id, recall, rejection_rate, n_routes) of generated routes (part_id, feature_id, route, outcome) against expected (part_id, feature_id, route)."""
    r = routes.filter("route IS NOT NULL").groupBy("part_id").agg(F.count(F.lit(1)).alias("n_routes"), F.round(F.avg((c("outcome") != "ACCEPTED").cast("int")), 6).alias("rejection_rate"))
    ok = routes.filter("outcome = 'ACCEPTED'").select("part_id", "feature_id", "route").distinct().withColumn("_hit", F.lit(1))
    e = expected.distinct().join(ok, ["part_id", "feature_id", "route"], "left").groupBy("part_id").agg(F.round(F.count("_hit") / F.count(F.lit(1)), 6).alias("recall"))
    return e.join(r, "part_id", "full")


def moved(x: Column, y: Column, z: Column, degrees: float, shift: tuple[float, float, float], scale: float = 1.0) -> list[Column]:
    """A point after a turn about z, a shift and a change of unit (scale)."""
    s, k = math.sin(math.radians(degrees)), math.cos(math.radians(degrees))
    return [(x * k - y * s + shift[0]) * scale, (x * s + y * k + shift[1]) * scale, (z + shift[2]) * scale]


def box_after(low: list[Column], high: list[Column], degrees: float, shift: tuple[float, float, float], scale: float = 1.0) -> tuple[list[Column], list[Column]]:
    """The axis-parallel box of a box's eight corners after a move."""
    corners = [moved(a, b, z, degrees, shift, scale) for a in (low[0], high[0]) for b in (low[1], high[1]) for z in (low[2], high[2])]
    return [F.least(*[p[i] for p in corners]) for i in range(3)], [F.greatest(*[p[i] for p in corners]) for i in range(3)]


#: Millimetres of a unit.
UNIT_MM = {"mm": 1.0, "cm": 10.0, "m": 1000.0, "inch": 25.4}


def rotation(axis: tuple[float, float, float], degrees: float, shift: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> list[list[float]]:
    """The 4x4 matrix of a turn about an axis through the origin and a shift after it. Raises ValueError for an axis without direction."""
    n = math.hypot(*axis)
    if n == 0:
        raise ValueError("the axis has no direction")
    u = [v / n for v in axis]
    k, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    skew = [[0, -u[2], u[1]], [u[2], 0, -u[0]], [-u[1], u[0], 0]]
    turn = [[(k if i == j else 0) + (1 - k) * u[i] * u[j] + s * skew[i][j] for j in range(3)] for i in range(3)]
    return [[*turn[i], shift[i]] for i in range(3)] + [[0.0, 0.0, 0.0, 1.0]]


def place(m: list[list[float]], p: Column, scale: Column, w: float = 1.0) -> Column:
    """A point (w = 1: turned, shifted, in mm) or a direction (w = 0: turned only, its length kept)."""
    xyz = [m[i][0] * p["x"] + m[i][1] * p["y"] + m[i][2] * p["z"] for i in range(3)]
    out = [(v * scale + m[i][3]) if w else v for i, v in enumerate(xyz)]
    return F.when(p.isNotNull(), F.struct(*[v.alias(k) for v, k in zip(out, "xyz", strict=True)]))


def transformed(geometry: Column, m: list[list[float]], unit: Column) -> Column:
    """A part's geometry after the matrix (its shift in mm), in mm: struct(points, curves, surfaces) of structs.

    Points are (id, at), curves (id, kind, at, along, radius) and surfaces (id, kind, at, normal, radius). Every place goes through the
    matrix, directions through its turn alone, radii only through the unit. An unknown unit gives NULL places and radii: it is never assumed.
    """
    scale = F.coalesce(*[F.when(unit == k, F.lit(v)) for k, v in UNIT_MM.items()])
    shaped = lambda way: lambda x: F.struct(x["id"].alias("id"), x["kind"].alias("kind"), place(m, x["at"], scale).alias("at"), place(m, x[way], scale, 0.0).alias(way), (x["radius"] * scale).alias("radius"))
    return F.struct(
        F.transform(geometry["points"], lambda x: F.struct(x["id"].alias("id"), place(m, x["at"], scale).alias("at"))).alias("points"),
        F.transform(geometry["curves"], shaped("along")).alias("curves"),
        F.transform(geometry["surfaces"], shaped("normal")).alias("surfaces"),
    )


def adjacent_faces(edges: DataFrame) -> DataFrame:
    """(part_id, face, neighbours): faces that share an edge (part_id, face, edge_id). A face meets the edge's set of faces, made once per edge."""
    own = edges.select("part_id", "face", "edge_id").distinct()
    sets = own.groupBy("part_id", "edge_id").agg(F.collect_set("face").alias("faces"))
    near = own.join(sets, ["part_id", "edge_id"]).select("part_id", "face", F.explode("faces").alias("other")).filter("face <> other")
    return near.groupBy("part_id", "face").agg(F.array_join(F.transform(F.sort_array(F.collect_set("other")), lambda v: v.cast("string")), ",").alias("neighbours"))


def reach(depth: Column, length: Column, d_tool: Column, d_feature: Column) -> Column:
    """Whether a tool gets into a feature: its free length and diameter against depth and width; UNKNOWN where either is missing."""
    return F.when(depth.isNull() | length.isNull() | d_tool.isNull() | d_feature.isNull(), "UNKNOWN").when(d_tool > d_feature, "TOO_WIDE").when(length < depth, "TOO_SHORT").otherwise("REACHES")


def audit(*violations: tuple[str, DataFrame, str]) -> DataFrame:
    """(check_id, subject) rows of the violations of all checks: (check_id, frame, column that names the subject)."""
    rows = [d.select(F.lit(k).alias("check_id"), c(s).cast("long").alias("subject")) for k, d, s in violations]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


#: Limits of the verdict on a campaign; failing drawings and runs with one wrong text that are too many.
LEAST_DIM_RECALL, LEAST_TEXT_PRECISION, MOST_FAILURES, MOST_CORRECTIONS, LEAST_GAIN, MOST_FAILING = 0.70, 0.75, 0.20, 0.40, 0.15, 2


def run_scores(runs: DataFrame, found: DataFrame, truth: DataFrame, matched: DataFrame, reviews: DataFrame, dimensions: list[str]) -> DataFrame:
    """One row per run (fixture, run_id): hits, misses and false finds, the same of dimensions, missed required dimensions, reviews by action.

    accepted_wrong counts accepted findings that match nothing. runs: fixture, run_id; found: fixture, run_id, finding_no, value, unit;
    truth: fixture, item_id, feature_type, required; matched: fixture, run_id, finding_no, item_id; reviews: fixture, run_id, finding_no,
    action. A finding looks like a dimension where it has a value and a unit. Runs without findings, items or reviews count zeros.
    """
    run, key = ["fixture", "run_id"], ["fixture", "run_id", "finding_no"]
    dim = F.coalesce(c("feature_type").isin(dimensions), F.lit(False))
    need = F.coalesce(c("required"), F.lit(False))
    n = lambda on, name: F.count_if(on).alias(name)
    items = truth.groupBy("fixture").agg(F.count(F.lit(1)).alias("n_items"), n(dim, "n_dims"), n(dim & need, "n_required"))
    hits = matched.join(truth.select("fixture", "item_id", "feature_type", "required"), ["fixture", "item_id"]).groupBy(*run).agg(F.count(F.lit(1)).alias("tp"), n(dim, "dim_tp"), n(dim & need, "required_tp"))
    known = matched.select(*key, F.lit(True).alias("_hit")).distinct()
    looks, wrong = c("value").isNotNull() & c("unit").isNotNull(), c("_hit").isNull()
    finds = found.join(known, key, "left").groupBy(*run).agg(n(looks, "n_dim_looking"), n(wrong, "fp"), n(wrong & looks, "dim_fp"))
    does = lambda x: c("action") == x
    acts = reviews.join(known, key, "left").groupBy(*run).agg(n(does("ACCEPT"), "accepted"), n(does("EDIT"), "edited"), n(does("REJECT"), "rejected"), n(does("ACCEPT") & wrong, "accepted_wrong"))
    d = runs.select(*run).distinct().join(items, "fixture", "left")
    for more in (hits, finds, acts):
        d = d.join(more, run, "left")
    d = d.na.fill(0)
    return d.select(*run, "tp", (c("n_items") - c("tp")).alias("fn"), "fp", "dim_tp", (c("n_dims") - c("dim_tp")).alias("dim_fn"), "dim_fp", (c("n_required") - c("required_tp")).alias("critical_missed"), "n_dim_looking", "accepted", "edited", "rejected", "accepted_wrong")


def verdicts(runs: DataFrame, failing: DataFrame, wrong: DataFrame) -> DataFrame:
    """(check_id, value, state): P1 to P7 and RECALL_GAIN of a campaign as PASS, FAIL or INSUFFICIENT_DATA.

    P1: core drawings with failing items; P2: recall of dimensions, core; P3: precision, core, and no wrong text in several runs; P4: share of
    refused and failed jobs; P5: median time of good jobs, and the worst; P6: share of edits and rejections, core; P7: accepted wrong ones;
    RECALL_GAIN: what crops of the first drawing below P2's limit gain in recall of dimensions. Crops take part in P7 and the gain alone.
    runs: run_scores with class (CORE or another), parent (the fixture that a crop is of; NULL: a whole drawing), seconds, good and refused;
    failing: fixture; wrong: any row is a text that several runs give. A campaign without runs has INSUFFICIENT_DATA, but PASS in P7.
    """
    core, whole = (c("class") == "CORE") & c("parent").isNull(), c("parent").isNull()
    of = lambda on, x: F.coalesce(F.sum(F.when(on, c(x))), F.lit(0))
    share = lambda a, b: F.round(F.try_divide(a, b), 6)
    good = F.when(whole & c("good"), c("seconds"))
    totals = runs.agg(
        F.count_if(core).alias("n_core"), share(of(core, "dim_tp"), of(core, "dim_tp") + of(core, "dim_fn")).alias("P2"), share(of(core, "tp"), of(core, "tp") + of(core, "fp")).alias("P3"),
        share(of(whole, "refused") + F.count_if(whole & ~c("good") & (c("refused") == 0)), F.count_if(whole)).alias("P4"), F.median(good).alias("P5"), F.max(good).alias("worst"),
        share(of(core, "edited") + of(core, "rejected"), of(core, "accepted") + of(core, "edited") + of(core, "rejected")).alias("P6"), F.coalesce(F.sum("accepted_wrong"), F.lit(0)).alias("P7"),
    )
    lost = runs.filter(core).select("fixture").distinct().join(failing.select("fixture").distinct(), "fixture").agg(F.count(F.lit(1)).alias("P1"))
    several = wrong.agg((F.count(F.lit(1)) > 0).alias("several"))
    recall = lambda on: share(of(on, "dim_tp"), of(on, "dim_tp") + of(on, "dim_fn"))
    gains = runs.groupBy(F.coalesce("parent", "fixture").alias("drawing")).agg(recall(whole).alias("own"), recall(~whole).alias("crop"))
    gain = gains.filter((c("own") < LEAST_DIM_RECALL) & c("crop").isNotNull()).agg(F.min_by(F.round(c("crop") - c("own"), 6), "drawing").alias("gain"))
    d = totals.crossJoin(lost).crossJoin(several).crossJoin(gain)  # one row each
    state = lambda unknown, ok: F.when(unknown, "INSUFFICIENT_DATA").when(ok, "PASS").otherwise("FAIL")
    none = F.lit(False)
    cases = [
        ("P1", c("P1"), state(c("n_core") == 0, c("P1") < MOST_FAILING)), ("P2", c("P2"), state(c("P2").isNull(), c("P2") >= LEAST_DIM_RECALL)),
        ("P3", c("P3"), state(c("P3").isNull() & ~c("several"), F.coalesce(c("P3") >= LEAST_TEXT_PRECISION, none) & ~c("several"))),
        ("P4", c("P4"), state(c("P4").isNull(), c("P4") <= MOST_FAILURES)), ("P5", c("P5"), state(c("P5").isNull(), (c("P5") <= MOST_MEDIAN_S) & (c("worst") <= MOST_WORST_S))),
        ("P6", c("P6"), state(c("P6").isNull(), c("P6") <= MOST_CORRECTIONS)), ("P7", c("P7"), state(none, c("P7") == 0)), ("RECALL_GAIN", c("gain"), state(c("gain").isNull(), c("gain") >= LEAST_GAIN)),
    ]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("check_id"), v.cast("double").alias("value"), s.alias("state")) for k, v, s in cases]))
    return d.select(each.alias("t")).select("t.*")
