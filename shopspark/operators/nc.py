"""NC programs as line tables: modal state, positions, moves, segments, totals, revision differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import nc as X
from .spread import spread

AXES = ["x", "y", "z"]
#: Fixed values, in tenths: codes that are noted and not carried out (cutter and length compensation, offsets, shift, feed modes).
NOTED = [410, 420, 430, 530, 540, 550, 560, 570, 580, 590, 920, 930, 950]


def motion(lines: DataFrame) -> DataFrame:
    """(program_id, line_no, text) to one row per line up to the program's end, with state after the line and the move's length.

    Lengths are in mm. Coordinates and feeds are read in the units of their own line. Straight moves, arcs about a relative
    centre in the three planes, and holes of the cycles G81-G85 are measured. What can't be measured has no length and is
    skipped: a move whose start isn't known in an axis that it changes, an arc by radius or with unequal radii, cycles G86-G89
    or in relative mode. Holes that are measured in part (pecking, tapping, unknown initial level) are skipped as well, but add
    what is known. G92 sets the position without a move. A feed counts as mm/min under G94 only; under G95 it is feed_rev (mm), and
    under G93 it has no meaning by itself. noted has the codes of a line that are read but not carried out, in tenths; end is set on the
    line that ends the program. Everything is a window over a program's lines in order: they are spread by their number and sorted once,
    before anything is read out of them, and no window asks for another order.
    """
    c = F.col
    lines = spread(lines.select("program_id", "line_no", "text"), "program_id").sortWithinPartitions("program_id", "line_no")
    b = X.clean(c("text"))
    d = lines.withColumn("b", F.when(X.is_macro(c("text")), "").otherwise(b)).withColumns({"g": X.codes(c("b"), "G"), "m": X.codes(c("b"), "M")})
    w = W.partitionBy("program_id").orderBy("line_no")
    to_here = w.rowsBetween(W.unboundedPreceding, 0)
    end = F.min(F.when(X.last_of(c("m"), 2, 30).isNotNull(), c("line_no"))).over(to_here)
    d = d.withColumn("end", end).filter(c("end").isNull() | (c("line_no") <= c("end")))
    kept = lambda x: F.last(x, ignorenulls=True).over(to_here)
    g = c("g")
    modal, straight = kept(X.last_of(g, 0, 1, 2, 3, *range(80, 90))), kept(X.last_of(g, 0, 1, 2, 3))
    d = d.withColumns({
        "inch": F.coalesce(kept(X.last_of(g, 20, 21)) == 20, F.lit(False)), "shift": X.last_of(g, 92).isNotNull(), "feed_mode": F.coalesce(kept(X.last_of(g, 93, 94, 95)), F.lit(94)).cast("int"), "noted": F.filter(g, lambda x: x.isin(NOTED)), "relative": F.coalesce(kept(X.last_of(g, 90, 91)) == 91, F.lit(False)) & X.last_of(g, 92).isNull(), "mode": F.when(modal == 80, straight).otherwise(modal).cast("int"),
        "plane": F.coalesce(kept(X.last_of(g, 17, 18, 19)), F.lit(17)).cast("int"), "stays": F.coalesce(kept(X.last_of(g, 98, 99)) == 99, F.lit(False)), "begins": X.last_of(g, 81, 82, 83, 84, 85).isNotNull(),
        "rpm": kept(X.word(c("b"), "S")), "t": X.word(c("b"), "T"), "home": X.last_of(g, 28).isNotNull(), "change": X.last_of(c("m"), 6).isNotNull(), "macro": X.is_macro(c("text")),
    })
    scale = F.when(c("inch"), 25.4).otherwise(1.0)
    d = d.withColumns({"feed": kept(F.when(c("feed_mode") == 94, X.word(c("b"), "F") * scale)), "feed_rev": kept(F.when(c("feed_mode") == 95, X.word(c("b"), "F") * scale)), **{f"w{a}": X.word(c("b"), a.upper()) * scale for a in [*AXES, "i", "j", "k", "r"]}})
    pending = F.last(c("t"), ignorenulls=True).over(to_here)
    d = d.withColumn("tool", pending).withColumn("segment", F.sum((c("change") & c("tool").isNotNull()).cast("int")).over(to_here))
    cycle = c("mode").between(81, 85) & ~c("shift")
    d = d.withColumn("hole", F.coalesce(cycle & ~c("relative") & ~c("home") & (c("wx").isNotNull() | c("wy").isNotNull()), F.lit(False)))
    d = d.withColumns({"depth": kept(F.when(cycle, c("wz"))), "level": kept(F.when(cycle, c("wr")))})

    # Relative steps so far: below a metre in whole millionths of a um, so that differences of sums are exact; longer ones apart.
    step = {a: F.when(c("relative") & ~c("home"), F.coalesce(f"w{a}", F.lit(0.0))).otherwise(0.0) for a in AXES}
    short = {a: F.abs(x) < 1000 for a, x in step.items()}
    d = d.withColumns({f"near_{a}": F.sum(F.when(short[a], F.rint(step[a] * 1e9).cast("long")).otherwise(F.lit(0).cast("long"))).over(to_here) for a in AXES} | {f"far_{a}": F.sum(F.when(short[a], 0.0).otherwise(step[a])).over(to_here) for a in AXES})

    def placed(d: DataFrame, at: dict[str, tuple[str, Column, Column]]) -> DataFrame:
        """Positions of axes (out: axis, at, base): the last line that fixes it (at) has base (NULL: unknown), to which the steps since add."""
        d = d.withColumns({f"k{out}": F.last(F.when(on, F.struct(base.alias("p"), c(f"near_{a}").alias("near"), c(f"far_{a}").alias("far"))), ignorenulls=True).over(to_here) for out, (a, on, base) in at.items()})
        d = d.withColumns({f"p{out}": c(f"k{out}.p") + ((c(f"near_{a}") - c(f"k{out}.near")) / 1e9 + (c(f"far_{a}") - c(f"k{out}.far"))) for out, (a, _, _) in at.items()})
        return d.withColumns({f"s{out}": F.lag(f"p{out}").over(w) for out in at})

    said = lambda a: c(f"w{a}").isNotNull() & ~c("relative")
    own = lambda a: F.when(~c("home") & ~c("relative"), c(f"w{a}"))
    # A hole leaves the axis at the level (G99) or where the cycle began (G98): first without the latter, to know where that was.
    sets = c("home") | (said("z") & ~c("hole"))
    d = placed(d, {a: (a, c("home") | said(a), own(a)) for a in ("x", "y")} | {"a": ("z", sets | (c("hole") & c("stays")), F.when(c("hole"), c("level")).otherwise(own("z")))})
    d = d.withColumn("initial", F.last(F.when(c("begins"), F.struct(c("sa").alias("z"))), ignorenulls=True).over(to_here)["z"])
    d = placed(d, {"z": ("z", sets | c("hole"), F.when(c("hole"), F.when(c("stays"), c("level")).otherwise(F.coalesce("initial", "level"))).otherwise(own("z")))})

    moved = [c(f"w{a}").isNotNull() for a in AXES]
    is_move = F.coalesce((moved[0] | moved[1] | moved[2]) & ~c("home") & ~c("shift") & (c("mode").between(0, 3) | c("mode").between(81, 89)), F.lit(False))
    unknown = [moved[k] & (c(f"s{a}").isNull() | c(f"p{a}").isNull()) for k, a in enumerate(AXES)]
    square = [F.when(moved[k], F.pow(c(f"p{a}") - c(f"s{a}"), 2)).otherwise(0.0) for k, a in enumerate(AXES)]
    line = F.when(~(unknown[0] | unknown[1] | unknown[2]), F.sqrt(square[0] + square[1] + square[2]))
    by_plane = lambda p, q, r: F.when(c("plane") == 17, p).when(c("plane") == 18, q).otherwise(r)
    u, v, h = by_plane(c("sx"), c("sx"), c("sy")), by_plane(c("sy"), c("sz"), c("sz")), by_plane(c("sz"), c("sy"), c("sx"))
    u1, v1, h1 = by_plane(c("px"), c("px"), c("py")), by_plane(c("py"), c("pz"), c("pz")), by_plane(c("pz"), c("py"), c("px"))
    i, j = by_plane(c("wi"), c("wi"), c("wj")), by_plane(c("wj"), c("wk"), c("wk"))
    rise = F.when(by_plane(*[moved[k] for k in (2, 1, 0)]), F.coalesce(h1 - h, F.lit(0.0))).otherwise(0.0)
    zero = F.lit(0.0)
    arc = F.when(i.isNotNull() | j.isNotNull(), X.arc_length(u, v, u1, v1, F.coalesce(i, zero), F.coalesce(j, zero), rise, c("mode") == 2))
    stroke = F.abs(c("depth") - c("level"))
    across = F.coalesce(F.hypot(c("px") - c("sx"), c("py") - c("sy")), zero)
    deep = stroke >= 1e-9
    back = F.when(deep & ~c("stays"), F.coalesce(F.abs(c("level") - c("initial")), zero)).otherwise(0.0)
    hole_feed = F.when(deep, stroke * F.when(c("mode").isin(84, 85), 2).otherwise(1)).when(stroke.isNotNull(), 0.0)
    hole_rapid = F.when(stroke.isNotNull(), across + F.coalesce(F.abs(c("sz") - c("level")), zero) + back)
    in_part = c("hole") & (stroke.isNull() | ~deep | c("mode").isin(83, 84) | (~c("stays") & c("initial").isNull()))
    d = d.withColumns({
        "feed_len": F.when(is_move, F.when(c("mode") == 1, line).when(c("mode").isin(2, 3), arc).when(c("hole"), hole_feed)),
        "rapid_len": F.when(is_move, F.when(c("mode") == 0, line).when(c("hole"), hole_rapid)),
    })
    length = F.coalesce(c("feed_len") + c("rapid_len"), c("feed_len"), c("rapid_len"))
    return d.withColumn("length", length).withColumn("skipped", F.coalesce(is_move & (c("length").isNull() | in_part), F.lit(False)))


def segments(moves: DataFrame) -> DataFrame:
    c = F.col
    at_feed = F.when((c("mode") == 1) & c("length").isNotNull(), c("feed"))
    return moves.groupBy("program_id", "segment").agg(
        F.max_by("tool", "line_no").alias("tool"), F.sum("feed_len").alias("feed_mm"), F.sum("rapid_len").alias("rapid_mm"), F.count_if(c("length").isNotNull()).alias("moves"), F.count_if("skipped").alias("skipped"),
        F.min(at_feed).alias("min_feed"), F.max(at_feed).alias("max_feed"),
    )


def programs(moves: DataFrame) -> DataFrame:
    c = F.col
    out = moves.groupBy("program_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("feed_len").alias("feed_mm"), F.sum("rapid_len").alias("rapid_mm"), F.max("segment").alias("tool_changes"), F.count_if("skipped").alias("skipped"), F.count_if("macro").alias("macros"),
        F.max_by("rpm", "line_no").alias("last_rpm"), F.max_by("feed", "line_no").alias("last_feed"), F.max("rpm").alias("max_rpm"), F.max("feed").alias("max_feed"), F.bool_or(c("end").isNotNull()).alias("ended"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("noted")))).alias("noted"), F.max_by("feed_rev", "line_no").alias("last_feed_rev"),
    )  # a program notes some of NOTED, so the set is small
    status = F.when(c("macros") > 0, "UNSUPPORTED").when((c("skipped") > 0) | F.array_contains("noted", 930), "PARTIAL").otherwise("COMPLETE")
    return out.withColumn("status", status).withColumn("noted", F.array_join(F.transform("noted", lambda x: F.concat(F.lit("G"), (x / 10).cast("int").cast("string"))), ","))


def line_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Multiset difference of two revisions' lines: program_id, text, occurrence, change. Equal lines are numbered, so each pairs once."""
    number = lambda d: d.select("program_id", F.trim("text").alias("text"), F.row_number().over(W.partitionBy("program_id", F.trim("text")).orderBy("line_no")).alias("occurrence"))
    a, b = number(a).withColumn("_a", F.lit(1)), number(b).withColumn("_b", F.lit(1))
    out = a.join(b, ["program_id", "text", "occurrence"], "full")
    return out.select("program_id", "text", "occurrence", F.when(F.col("_b").isNull(), "REMOVED").when(F.col("_a").isNull(), "ADDED").otherwise("UNCHANGED").alias("change"))


def line_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """(program_id, added, removed): the lines of ``line_diff`` by program, from the number of equal lines of a side instead of numbered ones."""
    c = F.col
    side = lambda d, k: d.select("program_id", F.trim("text").alias("text"), F.lit(k).alias("n"))
    n = side(a, -1).unionByName(side(b, 1)).groupBy("program_id", "text").agg(F.sum(F.when(c("program_id").isNotNull() & c("text").isNotNull(), c("n"))).alias("n"), F.count_if(c("n") > 0).alias("b"), F.count_if(c("n") < 0).alias("a"))
    # a line without a text or program has no counterpart
    added, removed = F.greatest(F.coalesce("n", "b"), F.lit(0)), F.greatest(F.coalesce(-c("n"), "a"), F.lit(0))
    return n.groupBy("program_id").agg(F.sum(added).alias("added"), F.sum(removed).alias("removed"))


def record_diff(a: DataFrame, b: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Full outer difference of keyed records: key, change (ADDED, REMOVED, UNCHANGED, or CHANGED_<first differing value>)."""
    x = a.select(*key, F.struct(*values).alias("_a"))
    y = b.select(*key, F.struct(*values).alias("_b"))
    change = F.when(F.col("_a").isNull(), "ADDED").when(F.col("_b").isNull(), "REMOVED")
    for v in values:
        change = change.when(~F.col(f"_a.{v}").eqNullSafe(F.col(f"_b.{v}")), f"CHANGED_{v}".upper())
    return x.join(y, key, "full").select(*key, change.otherwise("UNCHANGED").alias("change"))
