"""Drawing text as columns: tokens, notes, units; annotations and requirements met with features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .spread import parts, spread

c = F.col

#: The series and words that name a kind of token, and the units of a finish.
UNIFIED, PIPE, PARALLEL, FINISH = ["UNC", "UNF", "UNEF", "UNS"], ["NPT", "NPTF"], ["G", "R"], ["RA", "RZ", "RT", "RMAX"]
FINISH_UNITS, HANDS, DIAMETER = ["UM", "ΜM", "µM", "UIN", "ΜIN", "µIN"], ["LH", "RH"], ["Ø", "∅", "R"]
PROHIBITED = ["NOMACHINING", "MACHININGPROHIBITED"]
#: A token is read as numbers (n), words (a) and signs. A kind has a shape of these.
LEXEME = "[0-9]+(?:[.][0-9]+)?|[A-Za-zµμØ∅]+|[-/#]"
SHAPES = {
    "THREAD_METRIC": "^an(an)?(-na)?(-a)?$", "THREAD_UN": "^(#n|n|n/n|n-n/n)-na(-na)?$", "THREAD_BSP": "^an(/n)?(-?a)?$", "THREAD_NPT": "^n(/n)?(-n)?a$",
    "FIT_PAIR": "^an[/-]an$", "FIT_SIZED": "^a?nan$", "SURFACE_FINISH": "^ana?$",
}
#: How sure a way of reading is, and below what a person must look.
CONFIDENCE = {"EXACT_PATTERN": 0.95, "NORMALISED": 0.85, "HEURISTIC": 0.6, "OCR": 0.5, "USER_CONFIRMED": 1.0}
REVIEW_BELOW = 0.85
#: How well an annotation's type suits a feature's type; others get 0.5.
SUITS = {
    ("DIMENSION", "HOLE"): 0.8, ("DIMENSION", "PLANAR_FACE"): 0.7, ("DIMENSION", "CYLINDRICAL_FACE"): 0.7, ("FIT", "HOLE"): 1.0, ("FIT", "SHAFT"): 1.0, ("THREAD", "THREADED_HOLE"): 1.0, ("SURFACE_FINISH", "PLANAR_FACE"): 0.9, ("SURFACE_FINISH", "CYLINDRICAL_FACE"): 0.8, ("GDT", "HOLE"): 0.85, ("GDT", "HOLE_PATTERN"): 0.9, ("GDT", "PLANAR_FACE"): 0.8, ("GDT", "CYLINDRICAL_FACE"): 0.8,
}
REACH_PT, NEAR_WEIGHT, TYPE_WEIGHT = 72.0, 0.6, 0.4
AUTO_SCORE, AUTO_GAP = 0.70, 0.15
#: Most rows of a page whose groups or pairs are formed at once.
SMALL_PAGE = 64


def lexemes(text: Column) -> Column:
    """Numbers, words and signs of a token; a multiplication sign is an x, a dash a hyphen, a decimal comma a point."""
    return F.regexp_extract_all(F.translate(F.trim(text), "×–—,", "x--."), F.lit(LEXEME), F.lit(0))


def token_kind(text: Column) -> Column:
    """What kind of thread, fit or finish a token is; NULL for other text. The first that fits, in the order below."""
    x, up = lexemes(text), F.transform(lexemes(text), F.upper)
    shape = F.array_join(F.transform(x, lambda y: F.when(y.rlike("^[0-9]"), "n").when(y.rlike("^[-/#]"), y).otherwise("a")), "")
    whole = F.array_join(x, "") == F.regexp_replace(F.translate(F.trim(text), "×–—,", "x--."), "[ \\t]+", "")
    first, last = F.get(up, F.lit(0)), F.try_element_at(up, F.lit(-1))
    has = lambda kind: whole & shape.rlike(SHAPES[kind])
    words = lambda names: F.exists(up, lambda y: y.isin(names))
    code = lambda y: F.length(y) <= 3  # noqa: E731  (a tolerance's letters)
    return (
        F.when(has("THREAD_METRIC") & (first == "M") & (~shape.rlike("^anan") | (F.get(up, F.lit(2)) == "X")) & (~shape.rlike("-a$") | last.isin(HANDS)), "THREAD_METRIC")
        .when(has("THREAD_UN") & words(UNIFIED), "THREAD_UN")
        .when(has("THREAD_BSP") & first.isin(PARALLEL) & (~shape.rlike("a$") | last.isin("A", "B")), "THREAD_BSP")
        .when(has("THREAD_NPT") & last.isin(PIPE), "THREAD_NPT")
        .when(has("FIT_PAIR") & code(first) & code(F.get(up, F.lit(3))), "FIT_PAIR")
        .when(has("FIT_SIZED") & (shape.rlike("^n") | first.isin(DIAMETER)) & code(F.try_element_at(up, F.lit(-2))), "FIT_SIZED")
        .when(has("SURFACE_FINISH") & first.isin(FINISH) & (~shape.rlike("a$") | last.isin(FINISH_UNITS)), "SURFACE_FINISH")
        .when(F.array_join(up, "").isin(PROHIBITED), "NO_MACHINING")
    )


def token_size(text: Column) -> Column:
    """The number that a metric thread, a sized fit or a finish token gives: its first."""
    number = F.get(F.filter(lexemes(text), lambda y: y.rlike("^[0-9]")), F.lit(0)).try_cast("double")
    return F.when(token_kind(text).isin("THREAD_METRIC", "FIT_SIZED", "SURFACE_FINISH"), number)


def _plain(text: Column) -> Column:
    """Upper-case words and numbers, a blank around each: phrases are then found by their words."""
    return F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.upper(text), F.lit("[A-Z]+|[0-9]+"), F.lit(0)), " "), F.lit(" "))


def _says(text: Column, *phrases: str) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(_plain(text), F.lit(f" {p} "))
    return out


def drawing_unit(title: Column, note: Column, standard: Column) -> Column:
    """mm or inch by the title block, else a note, else the standard; NULL where nothing says so. It is never assumed."""
    t, s = F.upper(F.trim(title)), F.upper(standard)
    by_title = F.when(t.isin("MM", "MILLIMETRE", "MILLIMETER"), "mm").when(t.isin("INCH", "IN", "INCHES"), "inch")
    said = lambda *units: _says(note, *[f"{d} IN {u}" for d in ("DIMENSION", "DIMENSIONS") for u in units])
    by_note = F.when(said("MM"), "mm").when(said("INCH", "INCHES"), "inch")
    return F.coalesce(by_title, by_note, F.when(s.rlike("ISO|DIN|EN|BS|JIS"), "mm").when(s.rlike("ANSI|ASME"), "inch"))


def note_category(text: Column) -> Column:
    """What a note is about: the first that fits of units, general tolerance, datum, thread, fit, finish; else TEXT."""
    kind = token_kind(text)
    return (
        F.when(_says(text, "DIMENSION IN", "DIMENSIONS IN"), "UNIT").when(_says(text, "ISO 2768"), "GENERAL_TOLERANCE").when(_plain(text).rlike(" DATUM [A-Z] "), "DATUM")
        .when(F.startswith(kind, F.lit("THREAD")), "THREAD").when(F.startswith(kind, F.lit("FIT")), "FIT").when(kind.isNotNull(), "SURFACE_FINISH").otherwise("TEXT")
    )


def confidence(method: Column) -> Column:
    return F.coalesce(*[F.when(method == k, F.lit(v)) for k, v in CONFIDENCE.items()])


def unit_name(text: Column) -> Column:
    """One name per unit: mm, inch, um, deg; other text as it is, trimmed and in lower case."""
    t = F.lower(F.trim(text))
    return F.when(t.isin("mm", "millimetre", "millimeter"), "mm").when(t.isin("in", "inch", "inches", '"'), "inch").when(t.isin("um", "µm", "μm", "micron"), "um").when(t.isin("deg", "°", "degree", "degrees"), "deg").otherwise(t)


def likely_feature(kind: Column, subtype: Column) -> Column:
    """The feature type that an annotation is probably about."""
    dim = F.when(subtype == "DIAMETRAL", "HOLE").when(subtype == "RADIAL", "FILLET").otherwise("PLANAR_FACE")
    return F.when(kind == "FIT", F.when(F.startswith(subtype, F.lit("SHAFT")), "SHAFT").otherwise("HOLE")).when(kind == "THREAD", "THREADED_HOLE").when(kind == "SURFACE_FINISH", "PLANAR_FACE").when(kind == "GDT", "HOLE").when(kind == "DIMENSION", dim).otherwise("UNKNOWN")


def suits(kind: Column, feature_type: Column) -> Column:
    return F.coalesce(*[F.when((kind == a) & (feature_type == f), F.lit(v)) for (a, f), v in SUITS.items()], F.lit(0.5))


def associated(annotations: DataFrame, features: DataFrame, page: list[str], k: int = 5) -> DataFrame:
    """(page, annotation_id, feature_id, score, rank): the k best features on an annotation's page by nearness (72 pt) and type.

    Far features still score by their type. Pages with at most SMALL_PAGE rows of features send these as one array to their annotations.
    Larger pages are worked out in parts: features within reach are met through cells of the reach's size, and of the far ones only the
    first k of each type of the page, which score alike, take part, so no pairs of a whole page are formed. annotations: page,
    annotation_id, kind, x, y, where rows of one annotation_id differ in no more than kind, x and y; features: page, feature_id,
    feature_type, x, y.
    """
    large = features.groupBy(*page).agg(F.count(F.lit(1)).alias("_n")).filter(c("_n") > SMALL_PAGE).select(*page)
    if large.isEmpty():
        return _ranked(_associated_with_few(annotations, features, page), page, k)
    of = lambda d, how: d.join(large, page, how)
    both = _associated_by_cells(of(annotations, "left_semi"), of(features, "left_semi"), page, k)
    return _ranked(both.unionByName(_associated_with_few(of(annotations, "left_anti"), of(features, "left_anti"), page)), page, k)


def _ranked(scored: DataFrame, page: list[str], k: int) -> DataFrame:
    """The k best of (page, annotation_id, feature_id, score)."""
    rank = F.row_number().over(W.partitionBy(*page, "annotation_id").orderBy(c("score").desc(), "feature_id"))
    return scored.withColumn("rank", rank).filter(c("rank") <= k)


def _score(kind: Column, feature_type: Column, distance: Column) -> Column:
    near = NEAR_WEIGHT * (1 - distance / REACH_PT) + TYPE_WEIGHT * suits(kind, feature_type)
    return F.when(distance < REACH_PT, near).otherwise(TYPE_WEIGHT * suits(kind, feature_type))

def _associated_with_few(annotations: DataFrame, features: DataFrame, page: list[str]) -> DataFrame:
    """Scores of all pairs of a page with few features: both sides are shuffled once, by page, and what follows keeps to it. Several sorts
    follow one another in a task, so rows are spread by their number."""
    keys, n = [*page, "annotation_id"], parts(annotations, features)
    few = spread(features.select(*page, "feature_id", "feature_type", "x", "y"), *page, n=n).groupBy(*page).agg(F.collect_list(F.struct("feature_id", "feature_type", "x", "y")).alias("_few"))
    pairs = spread(annotations.select(*keys, "kind", "x", "y"), *page, n=n).join(few.hint("merge"), page).withColumn("_f", F.explode("_few"))
    score = _score(c("kind"), c("_f.feature_type"), F.hypot(c("x") - c("_f.x"), c("y") - c("_f.y")))
    return pairs.select(*keys, c("_f.feature_id").alias("feature_id"), score.alias("score")).groupBy(*keys, "feature_id").agg(F.max("score").alias("score"))


def _associated_by_cells(annotations: DataFrame, features: DataFrame, page: list[str], k: int) -> DataFrame:
    cell = lambda v: F.floor(c(v) / REACH_PT)
    a = annotations.withColumns({"cx": cell("x"), "cy": cell("y")})
    spread = F.explode(F.array(*[F.struct((cell("x") + i).alias("cx"), (cell("y") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    f = features.select(*page, "feature_id", "feature_type", c("x").alias("fx"), c("y").alias("fy"))
    near = features.select(*page, "feature_id", "feature_type", c("x").alias("fx"), c("y").alias("fy"), spread.alias("at")).select(*page, "feature_id", "feature_type", "fx", "fy", "at.*")
    keys = [*page, "annotation_id"]
    distance = F.hypot(c("x") - c("fx"), c("y") - c("fy"))
    first = a.join(near, [*page, "cx", "cy"]).filter(distance < REACH_PT).select(*keys, "feature_id", (NEAR_WEIGHT * (1 - distance / REACH_PT) + TYPE_WEIGHT * suits(c("kind"), c("feature_type"))).alias("score"))
    lot = f.withColumn("_n", F.row_number().over(W.partitionBy(*page, "feature_type").orderBy("feature_id"))).filter(c("_n") <= k)
    far = a.join(lot, page).select(*keys, "feature_id", (TYPE_WEIGHT * suits(c("kind"), c("feature_type"))).alias("score"))
    return first.unionByName(far).groupBy(*keys, "feature_id").agg(F.max("score").alias("score"))


def association_state(annotations: DataFrame, ranked: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, feature_id, state) of every annotation: AUTO_MATCHED where the best scores 0.70 and the second at least 0.15 less, else
    MULTIPLE_CANDIDATES; UNRESOLVED where no feature is on the page."""
    g = ranked.filter("rank <= 2").groupBy(*keys).agg(F.max(F.when(c("rank") == 1, c("score"))).alias("s1"), F.max(F.when(c("rank") == 2, c("score"))).alias("s2"), F.max(F.when(c("rank") == 1, c("feature_id"))).alias("feature_id"))
    auto = (c("s1") >= AUTO_SCORE) & (c("s2").isNull() | (c("s2") < c("s1") - AUTO_GAP))
    open_ = annotations.select(*keys, *[F.lit(None).cast(g.schema[x].dataType).alias(x) for x in ("s1", "s2", "feature_id")])
    g = open_.unionByName(g).groupBy(*keys).agg(*[F.max(x).alias(x) for x in ("s1", "s2", "feature_id")])
    return g.select(*keys, F.when(auto, c("feature_id")).alias("feature_id"), F.when(c("s1").isNull(), "UNRESOLVED").when(auto, "AUTO_MATCHED").otherwise("MULTIPLE_CANDIDATES").alias("state"))


def link_state(events: DataFrame) -> DataFrame:
    """(requirement_id, feature_id, status) after review events (requirement_id, event_id, ts, action, feature_id): the last of confirm, reassign
    (makes a link where none is) and mark_drawing_only decides; a confirmation of another feature than the link's doesn't count."""
    order = F.struct("ts", "event_id")
    moves = events.filter(c("action").isin("reassign", "mark_drawing_only"))
    last = moves.groupBy("requirement_id").agg(F.max_by(F.struct("action", "feature_id"), order).alias("m"), F.max(order).alias("at"))
    all_ids = events.select("requirement_id").distinct().join(last, "requirement_id", "left")
    ok = events.filter("action = 'confirm'").join(all_ids, "requirement_id").filter((c("at").isNull() | (order > c("at"))) & (c("m").isNull() | ((c("m.action") == "reassign") & c("m.feature_id").eqNullSafe(c("feature_id")))))
    good = ok.groupBy("requirement_id").agg(F.max_by("feature_id", order).alias("confirmed"), F.lit(True).alias("_ok"))
    out = all_ids.join(good, "requirement_id", "left")
    feature = F.when(c("m.action") == "reassign", c("m.feature_id")).when(c("_ok"), c("confirmed"))
    status = F.when(c("m.action") == "mark_drawing_only", "DRAWING_ONLY").when(c("m").isNotNull() | c("_ok"), "USER_MATCHED").otherwise("PENDING")
    return out.select("requirement_id", feature.alias("feature_id"), status.alias("status"))


def reconciled(machine: DataFrame, rule: DataFrame, groups: DataFrame) -> DataFrame:
    """(page, grp, state): evidence groups as AGREES, CONFLICTS, AI_ONLY, DETERMINISTIC_ONLY or AMBIGUOUS (several on a side that don't agree).

    groups: (page, side, finding_id, grp), from shared source objects; machine and rule: page, finding_id, value.
    """
    m = machine.select("page", "finding_id", "value", F.lit("AI").alias("side"))
    d = rule.select("page", "finding_id", "value", F.lit("RULE").alias("side"))
    j = m.unionByName(d).join(groups, ["page", "side", "finding_id"])
    n = lambda s: F.count_distinct(F.when(c("side") == s, c("value")))
    g = j.groupBy("page", "grp").agg(n("AI").alias("a"), n("RULE").alias("r"), F.count_distinct("value").alias("v"))
    state = F.when(c("r") == 0, "AI_ONLY").when(c("a") == 0, "DETERMINISTIC_ONLY").when((c("a") > 1) | (c("r") > 1), "AMBIGUOUS").when(c("v") == 1, "AGREES").otherwise("CONFLICTS")
    return g.select("page", "grp", state.alias("state"))


def evidence_groups(edges: DataFrame) -> DataFrame:
    """(page, side, finding_id, grp) of (page, side, finding_id, source_id): findings that share a source object on a page, directly or through others."""
    from .graph import groups

    large = edges.groupBy("page").agg(F.count(F.lit(1)).alias("n")).filter(c("n") > SMALL_PAGE).select("page")
    if large.isEmpty():
        return _groups_of_few(edges)
    many = edges.join(large, "page", "left_semi")
    node = F.xxhash64("page", "side", "finding_id")
    e = many.select("page", "side", "finding_id", F.xxhash64("page", F.lit("source"), "source_id").alias("a"), node.alias("b"))
    label = groups(e.select("a", "b"))
    found = e.select("page", "side", "finding_id", c("b").alias("node")).distinct().join(label, "node").select("page", "side", "finding_id", "grp")
    return found.unionByName(_groups_of_few(edges.join(large, "page", "left_anti")))


def _groups_of_few(edges: DataFrame) -> DataFrame:
    """The same of pages with few rows: the findings of each source object in turn merge the groups of their page that they meet."""
    e = edges.select("page", "side", "finding_id", "source_id").repartition("page").distinct()
    e = e.groupBy("page", "source_id").agg(F.collect_list(F.struct("side", "finding_id")).alias("own")).groupBy("page").agg(F.collect_list("own").alias("each"))
    meet = lambda known, own: F.filter(known, lambda g: F.arrays_overlap(g, own))
    apart = lambda known, own: F.filter(known, lambda g: ~F.arrays_overlap(g, own))
    merged = F.aggregate("each", F.filter("each", lambda g: F.lit(False)), lambda known, own: F.concat(apart(known, own), F.array(F.array_distinct(F.concat(own, F.flatten(meet(known, own)))))))
    g = e.select("page", F.explode(merged).alias("g")).select("page", "g", F.explode("g").alias("x"))
    return g.select("page", "x.side", "x.finding_id", F.array_min(F.transform("g", lambda x: F.xxhash64(c("page"), x["side"], x["finding_id"]))).alias("grp"))
