"""Machining formulas as guarded columns: lengths in mm, speeds in m/min, feeds in mm/min, times in min."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from .guards import Formula

PI = math.pi
_ring = lambda big, small: PI / 4 * (big * big - small * small)
_bigger = ("NOT_LARGER_D1", lambda d0, d1, **_: d1 > d0)
_smaller = ("NOT_SMALLER_D1", lambda d0, d1, **_: d1 < d0)

BASIC = {
    "spindle_rpm": Formula(("vc", "d"), lambda vc, d: 1000 * vc / (PI * d), ("vc", "d")),
    "cutting_speed": Formula(("n", "d"), lambda n, d: PI * d * n / 1000, ("n", "d")),
    "feed_from_rev": Formula(("n", "f"), lambda n, f: n * f, ("n", "f")),
    "rev_from_feed": Formula(("vf", "n"), lambda vf, n: vf / n, ("vf", "n")),
    "rpm_from_feed_rev": Formula(("vf", "f"), lambda vf, f: vf / f, ("vf", "f")),
    "feed_from_tooth": Formula(("n", "z", "fz"), lambda n, z, fz: n * z * fz, ("n", "z", "fz"), ("z",)),
    "tooth_feed": Formula(("vf", "n", "z"), lambda vf, n, z: vf / (n * z), ("vf", "n", "z"), ("z",)),
    "rpm_from_tooth": Formula(("vf", "z", "fz"), lambda vf, z, fz: vf / (z * fz), ("vf", "z", "fz"), ("z",)),
    "teeth": Formula(("vf", "n", "fz"), lambda vf, n, fz: vf / (n * fz), ("vf", "n", "fz")),
    "milling_mrr": Formula(("ap", "ae", "vf"), lambda ap, ae, vf: ap * ae * vf, ("ap", "ae", "vf")),
    "machining_time": Formula(("length", "vf"), lambda length, vf: length / vf, ("vf",)),
    "torque": Formula(("p", "n"), lambda p, n: 60000 * p / (2 * PI * n), ("p", "n")),
    "power": Formula(("t", "n"), lambda t, n: 2 * PI * n * t / 60000, ("t", "n")),
}
TURNING = {
    "radial_stock_external": Formula(("d0", "d1"), lambda d0, d1: (d0 - d1) / 2, ("d0", "d1"), require=(_smaller,)),
    "final_diameter_external": Formula(("d0", "ap"), lambda d0, ap: d0 - 2 * ap, ("d0", "ap"), require=(("NOTHING_LEFT", lambda d0, ap: d0 > 2 * ap),)),
    "radial_stock_boring": Formula(("d0", "d1"), lambda d0, d1: (d1 - d0) / 2, ("d0", "d1"), require=(_bigger,)),
    "final_diameter_boring": Formula(("d0", "ap"), lambda d0, ap: d0 + 2 * ap, ("d0", "ap")),
    "pass_count": Formula(("stock", "ap"), lambda stock, ap: F.ceil(stock / ap).cast("double"), ("ap",)),
    "equal_pass_depth": Formula(("stock", "passes"), lambda stock, passes: stock / passes, ("stock", "passes"), ("passes",)),
    "removed_volume_external": Formula(("d0", "d1", "length"), lambda d0, d1, length: _ring(d0, d1) * length, ("d0", "d1"), require=(_smaller,)),
    "removed_volume_boring": Formula(("d0", "d1", "length"), lambda d0, d1, length: _ring(d1, d0) * length, ("d0", "d1"), require=(_bigger,)),
    "mrr_from_volume": Formula(("v", "t"), lambda v, t: v / t, ("t",)),
    "mrr_direct": Formula(("d0", "d1", "vf"), lambda d0, d1, vf: _ring(d0, d1) * vf, ("d0", "d1", "vf"), require=(_smaller,)),
    "facing_travel": Formula(("outer", "inner", "extra"), lambda outer, inner, extra: (outer - inner) / 2 + extra, ("outer",), require=(("NOT_SMALLER_INNER", lambda outer, inner, extra: inner < outer),)),
    "facing_volume": Formula(("outer", "inner", "depth"), lambda outer, inner, depth: _ring(outer, inner) * depth, ("outer",), require=(("NOT_SMALLER_INNER", lambda outer, inner, depth: inner < outer),)),
    "turning_time": Formula(("length", "approach", "exit", "vf"), lambda length, approach, exit, vf: (length + approach + exit) / vf, ("vf",)),
}
MILLING = {
    "feed_per_rev": Formula(("z", "fz"), lambda z, fz: z * fz, ("z", "fz"), ("z",)),
    "radial_engagement": Formula(("ae", "d"), lambda ae, d: ae / d, ("d",)),
    "axial_engagement": Formula(("ap", "d"), lambda ap, d: ap / d, ("d",)),
    "milling_time": Formula(("length", "n", "z", "fz"), lambda length, n, z, fz: length / (n * z * fz), ("n", "z", "fz"), ("z",)),
    "milling_mrr_full": Formula(("ap", "ae", "n", "z", "fz"), lambda ap, ae, n, z, fz: ap * ae * n * z * fz, ("ap", "ae", "n", "z", "fz"), ("z",)),
}
DRILLING = {
    "drilling_travel": Formula(("depth", "approach", "breakthrough"), lambda depth, approach, breakthrough: depth + approach + breakthrough, ("depth",)),
    "drilling_time": Formula(("travel", "n", "f"), lambda travel, n, f: travel / (n * f), ("n", "f")),
    "hole_area": Formula(("d",), lambda d: PI * d * d / 4, ("d",)),
    "hole_volume": Formula(("d", "depth"), lambda d, depth: PI * d * d / 4 * depth, ("d",)),
    "drilling_mrr": Formula(("d", "vf"), lambda d, vf: PI * d * d / 4 * vf, ("d", "vf")),
}
THREADING = {
    "lead": Formula(("pitch", "starts"), lambda pitch, starts: pitch * starts, ("pitch", "starts"), ("starts",)),
    "pitch": Formula(("lead", "starts"), lambda lead, starts: lead / starts, ("lead", "starts"), ("starts",)),
    "threads_per_mm": Formula(("pitch",), lambda pitch: 1 / pitch, ("pitch",)),
    "thread_feed": Formula(("n", "lead"), lambda n, lead: n * lead, ("n", "lead")),
    "thread_rpm": Formula(("vf", "lead"), lambda vf, lead: vf / lead, ("vf", "lead")),
    "threading_travel": Formula(("length", "approach", "exit"), lambda length, approach, exit: length + approach + exit, ("length",)),
    "threading_time": Formula(("travel", "n", "lead"), lambda travel, n, lead: travel / (n * lead), ("n", "lead")),
    "threading_revolutions": Formula(("travel", "lead"), lambda travel, lead: travel / lead, ("lead",)),
}
HOLE_FINISHING = {
    "diametral_stock": Formula(("d0", "d1"), lambda d0, d1: d1 - d0, ("d0", "d1"), require=(_bigger,)),
    "radial_stock": Formula(("d0", "d1"), lambda d0, d1: (d1 - d0) / 2, ("d0", "d1"), require=(_bigger,)),
    "annular_area": Formula(("d0", "d1"), lambda d0, d1: _ring(d1, d0), ("d0", "d1"), require=(_bigger,)),
    "annular_volume": Formula(("d0", "d1", "length"), lambda d0, d1, length: _ring(d1, d0) * length, ("d0", "d1", "length"), require=(_bigger,)),
    "finishing_mrr": Formula(("d0", "d1", "vf"), lambda d0, d1, vf: _ring(d1, d0) * vf, ("d0", "d1", "vf"), require=(_bigger,)),
    "finishing_travel": Formula(("length", "approach", "overtravel"), lambda length, approach, overtravel: length + approach + overtravel, ("length",)),
    "finishing_time": Formula(("travel", "n", "f"), lambda travel, n, f: travel / (n * f), ("n", "f")),
}
HONING = {
    "peripheral_speed": Formula(("d", "n"), lambda d, n: PI * d * n / 1000, ("d", "n")),
    "crosshatch_deg": Formula(("vh", "vp"), lambda vh, vp: 2 * F.degrees(F.atan(vh / vp)), ("vp",)),
    "stroke_speed": Formula(("vp", "alpha"), lambda vp, alpha: vp * F.tan(F.radians(alpha / 2)), ("vp",), require=(("ALPHA_NOT_BELOW_180", lambda vp, alpha: alpha < 180),)),
    "resultant_speed": Formula(("vh", "vp"), lambda vh, vp: F.sqrt(vh * vh + vp * vp), require=(("BOTH_ZERO", lambda vh, vp: (vh > 0) | (vp > 0)),)),
    "honing_stock": Formula(("d0", "d1"), lambda d0, d1: (d1 - d0) / 2, ("d0", "d1"), require=(_bigger,)),
    "honing_volume": Formula(("d0", "d1", "length"), lambda d0, d1, length: _ring(d1, d0) * length, ("d0", "d1", "length"), require=(_bigger,)),
}
LAPPING = {
    "contact_pressure": Formula(("force", "area"), lambda force, area: force / area, ("area",)),
    "lapping_volume": Formula(("area", "thickness"), lambda area, thickness: area * thickness, ("area",)),
    "lapping_mrr": Formula(("v", "t"), lambda v, t: v / t, ("t",)),
    "lapping_thickness": Formula(("v", "area"), lambda v, area: v / area, ("area",)),
    "lapping_time": Formula(("v", "mrr"), lambda v, mrr: v / mrr, ("mrr",)),
    "preston_rate": Formula(("k", "p", "v"), lambda k, p, v: k * p * v, ("k",)),
}
LIFE = {
    "taylor_life": Formula(("vc", "c", "n"), lambda vc, c, n: F.pow(c / vc, 1 / n), ("vc", "c", "n")),
    "taylor_speed": Formula(("t", "c", "n"), lambda t, c, n: c / F.pow(t, n), ("t", "c", "n")),
    "feed_mark_ra": Formula(("fz", "r"), lambda fz, r: fz * fz / (16 * r), ("fz", "r")),
    "feed_mark_rq": Formula(("fz", "r"), lambda fz, r: fz * fz / (8 * r) / math.sqrt(3), ("fz", "r")),
    "scallop_ra": Formula(("ae", "r"), lambda ae, r: ae * ae / (16 * r), ("ae", "r"), require=(("STEPOVER_TOO_WIDE", lambda ae, r: ae < 2 * r),)),
    "scallop_rq": Formula(("ae", "r"), lambda ae, r: ae * ae / (8 * r) / math.sqrt(3), ("ae", "r"), require=(("STEPOVER_TOO_WIDE", lambda ae, r: ae < 2 * r),)),
}
ALL = BASIC | TURNING | MILLING | DRILLING | THREADING | HOLE_FINISHING | HONING | LAPPING | LIFE
