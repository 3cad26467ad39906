"""Order-aware difference of two revisions' lines, with DataFrame functions only.

A line that stands once on both sides is an anchor when no other pair of equal lines crosses it. Such lines belong to every
longest common subsequence, so they cut a program into gaps that can be solved one by one: two running extremes find them.
Gaps of up to ``cells`` pairs of lines are solved exactly by a fold. Longer ones are cut further by the lines that are
unique within them: those that follow each other on both sides are runs, and the heaviest chain of runs that rises on
both sides stays. Then equal lines are told apart by their occurrence, and the same is done with these.

Lines are shuffled once by program for all of this but the rounds over longer gaps, which take these gaps' lines alone. A gap is
named by the first revision's place of the anchor before it, so gaps that a round doesn't touch keep their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import shared_folder
from .spread import spread

c = F.col
#: Pairs of lines of a gap that is solved exactly; runs that a round chains in a longer gap (the next round takes more).
CELLS, RUNS = 2500, 500
_GAP = ["program_id", "gap"]


def _gaps(lines: DataFrame) -> DataFrame:
    """The lines, cut by their anchors, with the pairs of lines of the gap that a line is in (or opens)."""
    to_here = W.partitionBy(*_GAP, "side").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    anchor = F.when(c("mate").isNotNull(), F.when(c("side") == "a", c("pos")).otherwise(c("mate")))
    d = lines.withColumn("_new", F.coalesce(F.max(anchor).over(to_here), c("gap")))
    n = lambda s: F.count_if((c("side") == s) & c("mate").isNull()).over(W.partitionBy(*_GAP, "_new"))
    return d.withColumn("pairs", n("a") * n("b")).select("program_id", "side", "pos", "text", c("_new").alias("gap"), "mate", "pairs")


def _met(lines: DataFrame, key: list[str]) -> DataFrame:
    """lines with how often a line's key stands on both sides of its gap (_na, _nb), and the first and last place of it on the other side."""
    same = W.partitionBy(*_GAP, *key)
    count = lambda s: F.count_if(c("side") == s).over(same)
    at = lambda f, s: f(F.when(c("side") == s, c("pos"))).over(same)
    low, high = (F.when(c("side") == "a", at(f, "b")).otherwise(at(f, "a")) for f in (F.min, F.max))
    return lines.withColumns({"_na": count("a"), "_nb": count("b"), "_low": low, "_high": high})


def _undisputed(lines: DataFrame, cells: int) -> DataFrame:
    """Whole programs, cut at the lines that are unique on both sides and crossed by no pair of equal lines, where they have more than ``cells`` pairs of lines."""
    n = lambda s: F.count_if(c("side") == s).over(W.partitionBy(*_GAP))
    ahead = W.partitionBy(*_GAP, "side").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    behind = W.partitionBy(*_GAP, "side").orderBy(c("pos").desc()).rowsBetween(W.unboundedPreceding, -1)
    d = _met(lines.withColumn("_open", n("a") * n("b") > cells), ["text"]).withColumn("_after", F.min("_low").over(behind)).withColumn("_before", F.max("_high").over(ahead))
    free = (c("_na") == 1) & (c("_nb") == 1) & c("_open") & (c("_before").isNull() | (c("_before") < c("_low"))) & (c("_after").isNull() | (c("_after") > c("_low")))
    return _gaps(d.withColumn("mate", F.when(free, c("_low"))))


def _heaviest(runs: Column) -> Column:
    """Of runs (i, j, j_end, w) in the order of i: the numbers (from 0) of those in the heaviest chain that rises in j as well."""
    best = F.aggregate(
        F.sequence(F.lit(0), F.size(runs) - 1),
        F.array().cast("array<struct<w:bigint,before:int>>"),
        lambda s, r: F.array_append(s, _after(runs, s, r)),
    )
    last = lambda s: F.array_max(F.transform(s, lambda x, k: F.struct(x["w"].alias("w"), (-k).alias("k"))))["k"]

    def back(s: Column) -> Column:
        start = F.struct((-last(s)).cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda x, _: F.when(x["at"] < 0, x).otherwise(F.struct(F.get(s, x["at"])["before"].alias("at"), F.array_append(x["out"], x["at"]).alias("out")))
        return F.aggregate(s, start, step)["out"]

    return F.transform(F.array(best), back)[0]


def _after(runs: Column, s: Column, r: Column) -> Column:
    """Weight of the best chain that ends in run r, and the run before it (-1: none)."""
    mine = F.get(runs, r)
    fit = F.array_max(F.transform(s, lambda x, k: F.when(F.get(runs, k)["j_end"] < mine["j"], F.struct(x["w"].alias("w"), (-k).alias("k")))))
    return F.struct((mine["w"] + F.coalesce(fit["w"], F.lit(0))).cast("long").alias("w"), F.coalesce(-fit["k"], F.lit(-1)).cast("int").alias("before"))


def _chained(lines: DataFrame, key: list[str], most: int) -> DataFrame:
    """Lines of open gaps, cut at those that are unique by ``key`` on both sides: those of the heaviest rising chain of runs.

    A run is a stretch of such lines that follow each other on both sides. A gap's ``most`` longest runs take part.
    """
    lines = spread(lines.select(*_GAP, "side", "pos", "text"), *_GAP)
    if "occ" in key:  # which of the equal lines of a side within its gap a line is
        lines = lines.withColumn("occ", F.row_number().over(W.partitionBy(*_GAP, "side", "text").orderBy("pos")))
    d = _met(lines, key)
    unique = (c("_na") == 1) & (c("_nb") == 1)
    pairs = d.filter((c("side") == "a") & unique).select(*_GAP, c("pos").alias("i"), c("_low").alias("j"))
    rank = lambda x, *more: F.row_number().over(W.partitionBy(*_GAP, *more).orderBy(x))
    ranked = pairs.withColumn("ri", rank("i")).withColumn("off", rank("j") - c("ri"))
    ranked = ranked.withColumn("run", c("ri") - rank("ri", "off"))
    runs = ranked.groupBy(*_GAP, "off", "run").agg(F.min("i").alias("i"), F.max("i").alias("i_end"), F.min("j").alias("j"), F.max("j").alias("j_end"), F.count(F.lit(1)).alias("w"))
    runs = runs.withColumn("n", F.row_number().over(W.partitionBy(*_GAP).orderBy(c("w").desc(), "i"))).filter(c("n") <= most)
    lists = runs.groupBy(*_GAP).agg(F.array_sort(F.collect_list(F.struct("i", "j", "j_end", "w", "i_end"))).alias("runs"))
    taken = lists.select(*_GAP, F.transform(_heaviest(c("runs")), lambda k: F.get("runs", k)).alias("taken"))
    at = F.when(c("side") == "a", c("pos")).otherwise(c("_low"))
    hit = unique & F.exists("taken", lambda r: at.between(r["i"], r["i_end"]))
    return _gaps(d.join(taken, _GAP, "left").withColumn("mate", F.when(hit, c("_low"))))


def _common(a: Column, b: Column) -> Column:
    """Index pairs (i, j from 1) of a longest common subsequence of two arrays, by a fold over the first that keeps the table's rows."""
    row = lambda rows, x: F.aggregate(
        F.sequence(F.lit(1), F.size(b)),
        F.array(F.lit(0)),
        lambda r, j: F.array_append(r, F.when(F.element_at(b, j) == x, F.element_at(F.element_at(rows, -1), j) + 1).otherwise(F.greatest(F.element_at(F.element_at(rows, -1), j + 1), F.element_at(r, -1)))),
    )
    table = F.aggregate(a, F.array(F.array_repeat(F.lit(0), F.size(b) + 1)), lambda rows, x: F.array_append(rows, row(rows, x)))

    def back(table: Column) -> Column:
        start = F.struct(F.size(a).alias("i"), F.size(b).alias("j"), F.array().cast("array<struct<i:int,j:int>>").alias("out"))

        def step(s: Column, _: Column) -> Column:
            i, j = s["i"], s["j"]
            done = (i == 0) | (j == 0)
            pair = F.array_append(s["out"], F.struct(i.alias("i"), j.alias("j")))
            equal = F.get(a, i - 1) == F.get(b, j - 1)
            up = F.get(F.get(table, i - 1), j) >= F.get(F.get(table, i), j - 1)
            new = lambda i, j, out: F.struct(i.alias("i"), j.alias("j"), out.alias("out"))
            return F.when(done, s).when(equal, new(i - 1, j - 1, pair)).when(up, new(i - 1, j, s["out"])).otherwise(new(i, j - 1, s["out"]))

        return F.aggregate(F.sequence(F.lit(1), F.size(a) + F.size(b)), start, step)["out"]

    return F.transform(F.array(table), back)[0]


def _aligned(lines: DataFrame) -> DataFrame:
    """(program_id, a, b) structs of pos and text: the lines of gaps of few pairs side by side, the common ones first, then the k-th of both between them."""
    side = lambda s: F.array_sort(F.collect_list(F.when(c("side") == s, F.struct("pos", "text"))))
    texts = lambda x: F.transform(x, lambda y: y["text"])
    g = lines.groupBy(*_GAP).agg(side("a").alias("a"), side("b").alias("b"))
    g = g.withColumns({"ta": texts("a"), "tb": texts("b")})
    cut = lambda i, j: F.array(F.struct(i.cast("int").alias("i"), j.cast("int").alias("j")))
    common = F.when(F.arrays_overlap("ta", "tb"), F.reverse(_common(c("ta"), c("tb")))).otherwise(F.array().cast("array<struct<i:int,j:int>>"))
    g = g.withColumn("cuts", F.concat(cut(F.lit(1), F.lit(1)), common, cut(F.size("a") + 1, F.size("b") + 1)))
    at = lambda k, x: F.get("cuts", k)[x]
    part = lambda s, x, k: F.slice(s, at(k - 1, x), at(k, x) - at(k - 1, x))
    rows = F.flatten(F.transform(F.sequence(F.lit(1), F.size("cuts") - 1), lambda k: F.arrays_zip(part("a", "i", k), part("b", "j", k))))
    line = "struct<pos:bigint,text:string>"
    return g.select("program_id", F.explode(rows.cast(f"array<struct<a:{line},b:{line}>>")).alias("x")).select("program_id", "x.*")


def _side_by_side(lines: DataFrame) -> DataFrame:
    """As ``_aligned``, for gaps of any length that keep no common line: the k-th of both."""
    k = F.row_number().over(W.partitionBy(*_GAP, "side").orderBy("pos"))
    side = lambda s: F.max(F.when(c("side") == s, F.struct("pos", "text"))).alias(s)
    return spread(lines.select(*_GAP, "side", "pos", "text"), *_GAP).withColumn("k", k).groupBy(*_GAP, "k").agg(side("a"), side("b")).select("program_id", "a", "b")


def _kept(lines: DataFrame) -> DataFrame:
    """The lines, written to the shared folder."""
    path = f"{shared_folder(lines.sparkSession)}/linediff-{uuid.uuid4().hex}"
    lines.write.parquet(path)
    return lines.sparkSession.read.schema(lines.schema).parquet(path)


def ordered_diff(a: DataFrame, b: DataFrame, cells: int = CELLS, runs: int = RUNS) -> DataFrame:
    """(program_id, change, a_line, b_line, text_a, text_b) of two revisions (program_id, line_no, text), compared without outer blanks.

    a_line and b_line are places in the order of line_no, from 1. UNCHANGED lines rise on both sides; between them the k-th line that is
    gone and the k-th that came are MODIFIED, what is over is REMOVED or ADDED. Pairs of programs of at most ``cells`` pairs of lines, and
    gaps of that size between anchors, keep as many lines as possible. A program on one side only is all removed or added; a null text is empty.
    """
    side = lambda d, s: d.select("program_id", F.lit(s).alias("side"), "line_no", F.trim(F.coalesce("text", F.lit(""))).alias("text"))
    place = F.row_number().over(W.partitionBy("program_id", "side").orderBy("line_no")).cast("long")
    lines = spread(side(a, "a").unionByName(side(b, "b")), "program_id").select("program_id", "side", place.alias("pos"), "text", F.lit(0).cast("long").alias("gap"))
    unsolved = c("mate").isNull() & (c("pairs") > cells)
    lines, done = _kept(_undisputed(lines, cells)), []
    left = lines.filter(unsolved).count()
    for key in (["text"], ["text", "occ"]):
        found = 1
        while left and found:  # a rule goes on while it finds anchors
            done.append(lines.filter(~unsolved))
            lines = _kept(_chained(lines.filter(unsolved), key, runs))
            left, found = lines.agg(F.count_if(unsolved), F.count("mate")).first()
    own = F.struct("pos", "text")
    none = F.lit(None).cast(lines.select(own.alias("x")).schema["x"].dataType)
    ready = lines.filter(~unsolved)
    for d in done:
        ready = ready.unionByName(d)
    kept = ready.filter((c("side") == "a") & c("mate").isNotNull()).select("program_id", own.alias("a"), F.struct(c("mate").alias("pos"), "text").alias("b"))
    alone = ready.filter(c("mate").isNull() & (c("pairs") == 0)).select("program_id", F.when(c("side") == "a", own).otherwise(none).alias("a"), F.when(c("side") == "b", own).otherwise(none).alias("b"))
    out = [kept.withColumn("same", F.lit(True)), alone.withColumn("same", F.lit(False)), _aligned(ready.filter(c("mate").isNull() & (c("pairs") > 0))).withColumn("same", c("a.text") == c("b.text"))]
    if left:
        out.append(_side_by_side(lines.filter(unsolved)).withColumn("same", F.lit(False)))
    change = F.when(c("b").isNull(), "REMOVED").when(c("a").isNull(), "ADDED").when(c("same"), "UNCHANGED").otherwise("MODIFIED")
    show = lambda d: d.select("program_id", change.alias("change"), c("a.pos").alias("a_line"), c("b.pos").alias("b_line"), c("a.text").alias("text_a"), c("b.text").alias("text_b"))
    rows = show(out[0])
    for d in out[1:]:
        rows = rows.unionByName(show(d))
    return rows
