"""Formulas, guards and tolerance tables over plan steps."""

from pyspark.sql import functions as F

from ..functions import formulas as X
from ..functions import tolerance as tol
from ..functions.guards import missing_inputs
from .registry import query, r6

KEY = ["plan_id", "seq"]
COLS = "plan_id, seq"
INPUTS = {
    "vc": "vc", "d": "d_mm", "n": "rapid_mm", "f": "feed_rev", "vf": "vc * 10", "z": "line_no", "fz": "feed_rev / 2", "ap": "feed_rev * 20", "ae": "d_mm / 3", "length": "path_mm", "p": "vc / 10", "t": "dwell_s",
    "d0": "d_mm", "d1": "d_mm * (0.5 + feed_rev * 6)", "stock": "dwell_s", "passes": "line_no", "v": "path_mm", "approach": "feed_rev", "exit": "feed_rev", "outer": "d_mm", "inner": "d_mm * feed_rev * 12", "extra": "feed_rev", "depth": "vc - 60",
    "breakthrough": "feed_rev", "travel": "path_mm", "pitch": "feed_rev * 10", "starts": "line_no", "lead": "feed_rev * 10", "overtravel": "feed_rev", "vh": "dwell_s", "vp": "vc", "alpha": "vc * 2", "force": "path_mm", "area": "vc", "thickness": "feed_rev", "mrr": "dwell_s", "k": "feed_rev", "r": "d_mm / 2", "c": "vc * 3",
}
# Preston's rate and power take other columns under the same letters; the views feed the same ones.


def _inputs(step):
    return step.select(*KEY, *[F.expr(f"CAST({e} AS DOUBLE)").alias(n) for n, e in INPUTS.items()])


def _apply(step, group):
    df = _inputs(step)
    return df.select(*KEY, *[r6(f.value(**{n: F.col(n) for n in f.inputs})).alias(name) for name, f in group.items()])


_SRC = "s AS (SELECT plan_id, seq, " + ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in INPUTS.items()) + " FROM v_step)"


def _sql(**values):
    return f"WITH {_SRC} SELECT {COLS}, " + ", ".join(f"round(CASE WHEN {c} THEN {v} END + 1e-9, 6) AS {n}" for n, (c, v) in values.items()) + " FROM s"


@query("formulas_basic", _sql(
    spindle_rpm=("vc > 0 AND d > 0", "1000 * vc / (pi() * d)"), cutting_speed=("n > 0 AND d > 0", "pi() * d * n / 1000"), feed_from_rev=("n > 0 AND f > 0", "n * f"), rev_from_feed=("vf > 0 AND n > 0", "vf / n"),
    rpm_from_feed_rev=("vf > 0 AND f > 0", "vf / f"), feed_from_tooth=("n > 0 AND z > 0 AND fz > 0", "n * z * fz"), tooth_feed=("vf > 0 AND n > 0 AND z > 0", "vf / (n * z)"), rpm_from_tooth=("vf > 0 AND z > 0 AND fz > 0", "vf / (z * fz)"),
    teeth=("vf > 0 AND n > 0 AND fz > 0", "vf / (n * fz)"), milling_mrr=("ap > 0 AND ae > 0 AND vf > 0", "ap * ae * vf"), machining_time=("length >= 0 AND vf > 0", "length / vf"), torque=("p > 0 AND n > 0", "60000 * p / (2 * pi() * n)"), power=("t > 0 AND n > 0", "2 * pi() * n * t / 60000")))
def formulas_basic(shop):
    return _apply(shop.v_step, X.BASIC)


@query("formulas_turning", _sql(
    radial_stock_external=("d0 > 0 AND d1 > 0 AND d1 < d0", "(d0 - d1) / 2"), final_diameter_external=("d0 > 0 AND ap > 0 AND d0 > 2 * ap", "d0 - 2 * ap"), radial_stock_boring=("d0 > 0 AND d1 > d0", "(d1 - d0) / 2"), final_diameter_boring=("d0 > 0 AND ap > 0", "d0 + 2 * ap"),
    pass_count=("stock >= 0 AND ap > 0", "ceil(stock / ap)"), equal_pass_depth=("stock > 0 AND passes > 0", "stock / passes"), removed_volume_external=("d1 > 0 AND d1 < d0 AND length >= 0", "pi() / 4 * (d0 * d0 - d1 * d1) * length"),
    removed_volume_boring=("d0 > 0 AND d1 > d0 AND length >= 0", "pi() / 4 * (d1 * d1 - d0 * d0) * length"), mrr_from_volume=("v >= 0 AND t > 0", "v / t"), mrr_direct=("d1 > 0 AND d1 < d0 AND vf > 0", "pi() / 4 * (d0 * d0 - d1 * d1) * vf"),
    facing_travel=("outer_ > 0 AND inner_ >= 0 AND inner_ < outer_ AND extra >= 0", "(outer_ - inner_) / 2 + extra"), facing_volume=("outer_ > 0 AND inner_ >= 0 AND inner_ < outer_ AND depth >= 0", "pi() / 4 * (outer_ * outer_ - inner_ * inner_) * depth"),
    turning_time=("length >= 0 AND approach >= 0 AND vf > 0", "(length + approach + exit) / vf")).replace("AS outer,", "AS outer_,").replace("AS inner,", "AS inner_,"))
def formulas_turning(shop):
    return _apply(shop.v_step, X.TURNING)


@query("formulas_milling_drilling", _sql(
    feed_per_rev=("z > 0 AND fz > 0", "z * fz"), radial_engagement=("ae >= 0 AND d > 0", "ae / d"), axial_engagement=("ap >= 0 AND d > 0", "ap / d"), milling_time=("length >= 0 AND n > 0 AND z > 0 AND fz > 0", "length / (n * z * fz)"), milling_mrr_full=("ap > 0 AND ae > 0 AND n > 0 AND z > 0 AND fz > 0", "ap * ae * n * z * fz"),
    drilling_travel=("depth > 0 AND approach >= 0", "depth + approach + breakthrough"), drilling_time=("travel >= 0 AND n > 0 AND f > 0", "travel / (n * f)"), hole_area=("d > 0", "pi() * d * d / 4"), hole_volume=("d > 0 AND depth >= 0", "pi() * d * d / 4 * depth"), drilling_mrr=("d > 0 AND vf > 0", "pi() * d * d / 4 * vf")))
def formulas_milling_drilling(shop):
    return _apply(shop.v_step, X.MILLING | X.DRILLING)


@query("formulas_threading_finishing", _sql(
    lead=("pitch > 0 AND starts > 0", "pitch * starts"), pitch=("lead > 0 AND starts > 0", "lead / starts"), threads_per_mm=("pitch > 0", "1 / pitch"), thread_feed=("n > 0 AND lead > 0", "n * lead"), thread_rpm=("vf > 0 AND lead > 0", "vf / lead"), threading_travel=("length > 0 AND approach >= 0", "length + approach + exit"),
    threading_time=("travel >= 0 AND n > 0 AND lead > 0", "travel / (n * lead)"), threading_revolutions=("travel >= 0 AND lead > 0", "travel / lead"), diametral_stock=("d0 > 0 AND d1 > d0", "d1 - d0"), radial_stock=("d0 > 0 AND d1 > d0", "(d1 - d0) / 2"), annular_area=("d0 > 0 AND d1 > d0", "pi() / 4 * (d1 * d1 - d0 * d0)"),
    annular_volume=("d0 > 0 AND d1 > d0 AND length > 0", "pi() / 4 * (d1 * d1 - d0 * d0) * length"), finishing_mrr=("d0 > 0 AND d1 > d0 AND vf > 0", "pi() / 4 * (d1 * d1 - d0 * d0) * vf"), finishing_travel=("length > 0 AND approach >= 0", "length + approach + overtravel"), finishing_time=("travel >= 0 AND n > 0 AND f > 0", "travel / (n * f)")))
def formulas_threading_finishing(shop):
    return _apply(shop.v_step, X.THREADING | X.HOLE_FINISHING)


@query("formulas_abrasive_life", _sql(
    peripheral_speed=("d > 0 AND n > 0", "pi() * d * n / 1000"), crosshatch_deg=("vh >= 0 AND vp > 0", "2 * degrees(atan(vh / vp))"), stroke_speed=("vp > 0 AND alpha >= 0 AND alpha < 180", "vp * tan(radians(alpha / 2))"), resultant_speed=("vh >= 0 AND vp >= 0 AND (vh > 0 OR vp > 0)", "sqrt(vh * vh + vp * vp)"),
    honing_stock=("d0 > 0 AND d1 > d0", "(d1 - d0) / 2"), honing_volume=("d0 > 0 AND d1 > d0 AND length >= 0", "pi() / 4 * (d1 * d1 - d0 * d0) * length"), contact_pressure=("force >= 0 AND area > 0", "force / area"), lapping_volume=("area > 0 AND thickness >= 0", "area * thickness"), lapping_mrr=("v >= 0 AND t > 0", "v / t"),
    lapping_thickness=("v >= 0 AND area > 0", "v / area"), lapping_time=("v >= 0 AND mrr > 0", "v / mrr"), preston_rate=("k > 0 AND p >= 0 AND v >= 0", "k * p * v"), taylor_life=("vc > 0 AND c > 0 AND fz > 0", "pow(c / vc, 1 / (fz + 0.2))"), taylor_speed=("t > 0 AND c > 0 AND fz > 0", "c / pow(t, fz + 0.2)"),
    feed_mark_ra=("fz > 0 AND r > 0", "fz * fz / (16 * r)"), feed_mark_rq=("fz > 0 AND r > 0", "fz * fz / (8 * r) / sqrt(3)"), scallop_ra=("ae > 0 AND r > 0 AND ae < 2 * r", "ae * ae / (16 * r)"), scallop_rq=("ae > 0 AND r > 0 AND ae < 2 * r", "ae * ae / (8 * r) / sqrt(3)")))
def formulas_abrasive_life(shop):
    df = _inputs(shop.v_step)
    exponent = F.when(F.col("fz") > 0, F.col("fz") + 0.2)
    own = lambda name, f: {n: exponent if n == "n" and name.startswith("taylor") else F.col(n) for n in f.inputs}
    return df.select(*KEY, *[r6(f.value(**own(name, f))).alias(name) for name, f in (X.HONING | X.LAPPING | X.LIFE).items()])


@query("guard_reasons", """SELECT plan_id, seq, CASE WHEN d_mm IS NULL THEN 'MISSING_D' WHEN vc <= 0 THEN 'NOT_POSITIVE_VC' END AS rpm_reason,
  CASE WHEN d_mm IS NULL THEN 'MISSING_D0' WHEN d_mm * (0.5 + feed_rev * 6) <= 0 THEN 'NOT_POSITIVE_D1' WHEN NOT d_mm * (0.5 + feed_rev * 6) < d_mm THEN 'NOT_SMALLER_D1' END AS stock_reason,
  concat_ws(',', CASE WHEN d_mm IS NULL THEN 'd_mm' END, CASE WHEN rapid_mm IS NULL THEN 'rapid_mm' END, CASE WHEN dwell_s IS NULL THEN 'dwell_s' END, CASE WHEN iso_group IS NULL THEN 'iso_group' END) AS missing FROM v_step""")
def guard_reasons(shop):
    s = shop.v_step
    d, d1 = F.col("d_mm"), F.col("d_mm") * (0.5 + F.col("feed_rev") * 6)
    return s.select(*KEY, X.BASIC["spindle_rpm"].reason(vc=F.col("vc"), d=d).alias("rpm_reason"), X.TURNING["radial_stock_external"].reason(d0=d, d1=d1).alias("stock_reason"), F.array_join(missing_inputs(**{c: F.col(c) for c in ("d_mm", "rapid_mm", "dwell_s", "iso_group")}), ",").alias("missing"))


_STEPS = ", ".join(f"({a}, {b}, {i})" for i, (a, b) in enumerate(tol.SIZE_STEPS))
_GRADES = ", ".join(f"({g}, {m})" for g, m in tol.GRADE_FACTORS.items())


@query("it_tolerance", f"""WITH st(lo, hi, i) AS (VALUES {_STEPS}), gr(g, m) AS (VALUES {_GRADES}),
  f AS (SELECT part_id, feature_id, x, y, d_mm * 30 AS size, CAST(x AS INT) % 21 AS grade FROM v_feature),
  s AS (SELECT f.*, (SELECT min(i) FROM st WHERE size BETWEEN lo AND hi) AS i FROM f)
  SELECT part_id, feature_id, x, y, round(m * (0.45 * pow(sqrt(CAST(lo AS DOUBLE) * hi), 1.0 / 3) + 0.001 * sqrt(CAST(lo AS DOUBLE) * hi)), 2) AS it_um,
  CASE WHEN m IS NULL OR lo IS NULL THEN 'OUT_OF_RANGE' WHEN y IS NULL OR y = 0 THEN 'INSUFFICIENT_DATA' WHEN y >= 2 * round(m * (0.45 * pow(sqrt(CAST(lo AS DOUBLE) * hi), 1.0 / 3) + 0.001 * sqrt(CAST(lo AS DOUBLE) * hi)), 2) THEN 'COMFORTABLE' WHEN y >= round(m * (0.45 * pow(sqrt(CAST(lo AS DOUBLE) * hi), 1.0 / 3) + 0.001 * sqrt(CAST(lo AS DOUBLE) * hi)), 2) THEN 'CAPABLE' ELSE 'NOT_CAPABLE' END AS band
  FROM s LEFT JOIN st USING (i) LEFT JOIN gr ON g = grade""")
def it_tolerance(shop):
    f = shop.v_feature.select("part_id", "feature_id", "x", "y", (F.col("d_mm") * 30).alias("size"), (F.col("x").cast("int") % 21).alias("grade"))
    out = f.withColumn("it_um", tol.it_tolerance_um(F.col("grade"), F.col("size")))
    return out.select("part_id", "feature_id", "x", "y", "it_um", tol.capability_band(F.when(F.col("y") > 0, F.col("y")), F.col("it_um")).alias("band"))
