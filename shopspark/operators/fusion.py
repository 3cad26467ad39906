"""Requirements of a drawing met with the features of a part's geometry: links, what is left over, and the outcome per part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

c = F.col

# How well a kind of requirement suits a type of feature (others OTHER), and the weights of a score's seven parts.
SUITS = {
    "DIMENSION": {
        "THROUGH_HOLE": 0.9, "BLIND_HOLE": 0.9, "HOLE": 0.9, "COUNTERBORE": 0.85, "COUNTERSINK": 0.85, "OPEN_SLOT": 0.8, "CLOSED_SLOT": 0.8, "CLOSED_POCKET": 0.8,
        "OPEN_POCKET": 0.8, "PLANAR_FACE": 0.7, "OUTER_DIAMETER": 0.85, "INNER_DIAMETER": 0.85, "CHAMFER": 0.8, "FILLET": 0.8, "BOSS": 0.8,
    },
    "GDT_FCF": {"PLANAR_FACE": 0.9, "THROUGH_HOLE": 0.85, "BLIND_HOLE": 0.85, "OUTER_DIAMETER": 0.85, "INNER_DIAMETER": 0.85},
    "DATUM": {"PLANAR_FACE": 0.9, "OUTER_DIAMETER": 0.8},
    "THREAD": {"THROUGH_HOLE": 0.9, "BLIND_HOLE": 0.9, "HOLE": 0.9, "OUTER_DIAMETER": 0.8},
    "SURFACE_FINISH": {"PLANAR_FACE": 0.85, "OUTER_DIAMETER": 0.85, "INNER_DIAMETER": 0.85, "THROUGH_HOLE": 0.8, "BLIND_HOLE": 0.8},
    "FIT": {"THROUGH_HOLE": 0.9, "BLIND_HOLE": 0.9, "HOLE": 0.9, "INNER_DIAMETER": 0.85, "OUTER_DIAMETER": 0.85},
}
OTHER = 0.3
WEIGHTS = {"type": 0.25, "size": 0.25, "location": 0.20, "orientation": 0.10, "datum": 0.10, "pattern": 0.05, "source": 0.05}
#: What the parts count that neither side tells.
UNTOLD = {"location": 0.5, "orientation": 0.5, "datum": 0.5, "pattern": 0.0}
#: A size's share by its distance in mm, and beyond the last; without a number; of a feature without the size; of kinds that have none.
NEAR = [(0.1, 1.0), (0.5, 0.85), (2.0, 0.60), (10.0, 0.30)]
FAR, NO_NUMBER, NO_SIZE, SIZELESS = 0.10, 0.5, 0.4, {"SURFACE_FINISH": 0.6, "GDT_FCF": 0.6}
#: Kinds that belong to the drawing alone; faces that need no requirement, and types that need none either but are left over.
DRAWING_KINDS = ["NOTE", "TITLE_FIELD", "UNKNOWN", "GENERAL_TOLERANCE"]
FACE, SMALL = "PLANAR_FACE", ["CHAMFER", "FILLET", "EDGE_BREAK"]
AUTO_SCORE, AUTO_GAP = 0.70, 0.15
#: Candidates that a requirement with several keeps.
KEPT = 3


def number(value: Column) -> Column:
    """The first number of a value's text, with a comma or a point; NULL where there is none."""
    return F.nullif(F.regexp_extract(F.translate(value, ",", "."), r"[0-9]+(\.[0-9]+)?", 0), F.lit("")).cast("double")


def diametral(value: Column) -> Column:
    return F.coalesce(F.contains(value, F.lit("Ø")) | F.contains(F.lower(value), F.lit("diam")), F.lit(False))


def role(kind: Column, value: Column) -> Column:
    """DIAMETER, DEPTH, WIDTH or LINEAR of a dimension by its text; NULL of other kinds."""
    has = lambda x, text: F.coalesce(F.contains(x, F.lit(text)), F.lit(False))
    low = F.lower(value)
    return F.when(kind == "DIMENSION", F.when(diametral(value), "DIAMETER").when(has(low, "depth"), "DEPTH").when(has(low, "width") | has(value, "W"), "WIDTH").otherwise("LINEAR"))


def suits(kind: Column, feature_type: Column) -> Column:
    own = F.coalesce(*[F.when(kind == k, F.create_map(*[F.lit(x) for pair in own.items() for x in pair])) for k, own in SUITS.items()])
    return F.coalesce(F.try_element_at(own, feature_type), F.lit(OTHER))


def size_gap(asked: Column, own: Column) -> Column:
    return F.round(F.abs(asked - own), 9)


def size_share(kind: Column, asked: Column, gap: Column) -> Column:
    """How well sizes agree: by distance; kinds without a size and sides that tell none have fixed shares."""
    out = F.when(asked.isNull(), NO_NUMBER)
    for k, v in SIZELESS.items():
        out = out.when(kind == k, v)
    out = out.when(~kind.isin("DIMENSION", "THREAD", "FIT") | gap.isNull(), NO_SIZE)
    for within, v in NEAR:
        out = out.when(gap <= within, v)
    return out.otherwise(FAR)


def score(kind: Column, asked: Column, source: Column, feature_type: Column, gap: Column) -> Column:
    """The weighted sum of the seven parts, to six digits."""
    parts = {k: F.lit(v) for k, v in UNTOLD.items()} | {"type": suits(kind, feature_type), "size": size_share(kind, asked, gap), "source": source}
    return F.round(sum((F.lit(w) * parts[k] for k, w in WEIGHTS.items()), F.lit(0.0)), 6)


def _first(df: DataFrame, by: list, mark: str) -> DataFrame:
    """df with the place of a feature among those that agree in ``by``, smallest id first."""
    return df.withColumn(mark, F.row_number().over(W.partitionBy(*by).orderBy("feature_id")))


#: Most feature rows of a part whose features go with its requirements as one array.
SMALL_PART = 64


def _best_of_few(r: DataFrame, features: DataFrame) -> DataFrame:
    """r with score, second and candidates out of its part's features, which are few: they come as one array a part."""
    few = features.select("part_id", "feature_id", "feature_type", "diameter", "width", "length").repartition("part_id").distinct()
    few = few.groupBy("part_id").agg(F.collect_list(F.struct("feature_id", "feature_type", "diameter", "width", "length")).alias("_few"))
    own = lambda f: F.when(c("measure") == "ANY", F.coalesce(f["diameter"], f["width"], f["length"])).otherwise(f["diameter"])
    each = F.array_distinct(F.transform("_few", lambda f: F.struct(f["feature_id"].alias("id"), f["feature_type"].alias("type"), own(f).alias("own"))))
    each = F.transform(each, lambda f: F.struct(f["id"].alias("id"), f["type"].alias("type"), size_gap(c("asked"), f["own"]).alias("gap")))
    scored = F.transform(each, lambda f: F.struct((-score(c("kind"), c("asked"), c("source"), f["type"], f["gap"])).alias("s"), f["id"].alias("id")))
    d = r.join(few, "part_id", "left").withColumn("_best", F.when(c("open"), F.slice(F.sort_array(scored), 1, KEPT))).drop("_few")
    at = lambda k: -F.get("_best", F.lit(k))["s"]
    return d.withColumns({"score": at(0), "second": at(1), "candidates": F.transform("_best", lambda x: x["id"])}).drop("_best")


def _best_of_many(r: DataFrame, features: DataFrame) -> DataFrame:
    """The same by cells of sizes, for parts of any number of features. Pairs of a whole part aren't formed. Beyond 10 mm all features
    of a type score alike, so features are met through cells of 10 mm, and of the others only the first of each type take part; of
    features (and requirements) that agree in type and size, the first stand for all."""
    want = ["part_id", "kind", "asked", "source", "measure"]
    asked = r.filter("open").select(*want).distinct()

    measures = F.explode(F.array(F.struct(F.lit("DIAMETER").alias("measure"), c("diameter").alias("own")), F.struct(F.lit("ANY").alias("measure"), F.coalesce("diameter", "width", "length").alias("own"))))
    f = features.select("part_id", "feature_id", "feature_type", measures.alias("m")).select("part_id", "feature_id", "feature_type", "m.*").distinct()
    f = _first(f, ["part_id", "measure", "feature_type", "own"], "n").filter(c("n") <= KEPT).drop("n")
    lot = _first(f, ["part_id", "measure", "feature_type", c("own").isNull()], "n").filter(c("n") <= KEPT).drop("n")

    reach = NEAR[-1][0]
    cell = lambda x: F.floor(c(x) / reach)
    near = f.filter("own IS NOT NULL").withColumn("cell", F.explode(F.array(*[cell("own") + i for i in (-1, 0, 1)])))
    sized = asked.filter(c("asked").isNotNull() & c("kind").isin("DIMENSION", "THREAD", "FIT")).withColumn("cell", cell("asked"))
    cols = [*want, "feature_id", "feature_type", "own"]
    met = sized.join(near, ["part_id", "measure", "cell"]).select(*cols).unionByName(asked.join(lot, ["part_id", "measure"]).select(*cols)).distinct()
    met = met.withColumn("score", score(c("kind"), c("asked"), c("source"), c("feature_type"), size_gap(c("asked"), c("own"))))
    rank = F.row_number().over(W.partitionBy(*want).orderBy(c("score").desc(), "feature_id"))
    best = met.withColumn("rank", rank).filter(c("rank") <= KEPT)
    at = lambda k, x: F.max(F.when(c("rank") == k, c(x)))
    g = best.groupBy(*want).agg(at(1, "score").alias("score"), at(2, "score").alias("second"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "feature_id"))), lambda x: x["feature_id"]).alias("candidates"))
    a, b = r.alias("a"), g.alias("b")
    return a.join(b, [c(f"a.{k}").eqNullSafe(c(f"b.{k}")) for k in want] + [c("a.open")], "left").select("a.*", "score", "second", "candidates")


def links(requirements: DataFrame, features: DataFrame) -> DataFrame:
    """One row per requirement: part_id, req_id, role, score, candidates (best first, ties by id), feature_id, state.

    AUTO_MATCHED: the best scores 0.70 and the second at least 0.15 less; MULTIPLE_CANDIDATES: another comes nearer (feature_id is the
    best all the same); UNRESOLVED: none scores 0.70; DRAWING_ONLY: a note and the like (or NULL kind), or a part without features.
    requirements: part_id, req_id, kind, value (text), source (its confidence; NULL: 0.5); features: part_id, feature_id, feature_type,
    diameter, width, length. Diameters, threads and fits are compared with the diameter, other dimensions with the first size there is.

    Features of a part of at most SMALL_PART rows go to its requirements at once, so both sides are shuffled once by part; those of larger
    parts are met through cells of sizes.
    """
    r = requirements.select("part_id", "req_id", "kind", "value", F.coalesce(c("source"), F.lit(0.5)).alias("source"))
    r = r.withColumns({"asked": number(c("value")), "role": role(c("kind"), c("value"))})
    r = r.withColumn("measure", F.when((c("kind") == "DIMENSION") & ~diametral(c("value")), "ANY").otherwise("DIAMETER"))
    r = r.withColumn("open", ~F.coalesce(c("kind").isin(DRAWING_KINDS), F.lit(True)))

    large = features.groupBy("part_id").agg(F.count(F.lit(1)).alias("n")).filter(c("n") > SMALL_PART).select("part_id")
    if large.isEmpty():
        d = _best_of_few(r, features)
    else:
        of = lambda df, how: df.join(large, "part_id", how)
        d = _best_of_few(of(r, "left_anti"), of(features, "left_anti")).unionByName(_best_of_many(of(r, "left_semi"), of(features, "left_semi")))
    close = F.coalesce(F.round(c("score") - c("second"), 6) < AUTO_GAP, F.lit(False))
    state = F.when(c("score").isNull(), "DRAWING_ONLY").when(c("score") < AUTO_SCORE, "UNRESOLVED").when(close, "MULTIPLE_CANDIDATES").otherwise("AUTO_MATCHED")
    d = d.select("part_id", "req_id", "role", "score", "candidates", state.alias("state"))
    return d.withColumn("feature_id", F.when(c("state").isin("AUTO_MATCHED", "MULTIPLE_CANDIDATES"), F.element_at("candidates", 1)))


def leftovers(requirements: DataFrame, features: DataFrame, linked: DataFrame) -> DataFrame:
    """(part_id, feature_id, feature_type, asks): features that no requirement is matched with, plane faces aside; asks: one should be.

    A part without requirements leaves all its features, faces too, and asks for nothing.
    """
    own = linked.filter("state = 'AUTO_MATCHED'").select("part_id", "feature_id").distinct()
    known = requirements.select("part_id", F.lit(True).alias("_known")).distinct()
    d = features.select("part_id", "feature_id", "feature_type").distinct().join(own, ["part_id", "feature_id"], "left_anti").join(known, "part_id", "left")
    d = d.withColumn("_known", F.coalesce("_known", F.lit(False))).filter(~c("_known") | ~c("feature_type").eqNullSafe(F.lit(FACE)))
    return d.select("part_id", "feature_id", "feature_type", (c("_known") & ~F.coalesce(c("feature_type").isin(SMALL), F.lit(False))).alias("asks"))


def outcomes(linked: DataFrame, features: DataFrame, left: DataFrame) -> DataFrame:
    """One row per part of either side: counts, ambiguities, and FULL, PARTIAL, DRAWING_ONLY (nothing matched) or CAD_ONLY (nothing asked)."""
    n = lambda *states: F.count_if(c("state").isin(*states))
    r = linked.groupBy("part_id").agg(F.count(F.lit(1)).alias("n_requirements"), n("AUTO_MATCHED").alias("n_matched"), n("MULTIPLE_CANDIDATES").alias("n_multiple"), n("UNRESOLVED").alias("n_unresolved"), n("UNRESOLVED", "DRAWING_ONLY").alias("n_drawing_only"))
    f = features.select("part_id", "feature_id", "feature_type").distinct().groupBy("part_id").agg(F.count(F.lit(1)).alias("n_features"))
    u = left.groupBy("part_id").agg(F.count(F.lit(1)).alias("n_cad_only"), F.count_if("asks").alias("n_asks"))
    d = r.join(f, "part_id", "full").join(u, "part_id", "left").na.fill(0)
    state = F.when(c("n_requirements") == 0, "CAD_ONLY").when(c("n_matched") == 0, "DRAWING_ONLY").when((c("n_drawing_only") == 0) & (c("n_cad_only") == 0), "FULL").otherwise("PARTIAL")
    return d.select("part_id", "n_requirements", "n_features", "n_matched", "n_multiple", "n_drawing_only", "n_cad_only", (c("n_multiple") + c("n_unresolved") + c("n_asks")).alias("n_ambiguities"), state.alias("completeness"))
