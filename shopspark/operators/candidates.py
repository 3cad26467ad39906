"""Operations that make features, candidate machines, tools and holders with scores, precedence edges, parameter variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .catalog import items

c = F.col

#: Operations by feature type with the finest Ra (um) and the machine types that do them.
CAPABILITY = [
    ("HOLE", "drilling", 3.2), ("HOLE", "boring", 0.8), ("HOLE", "reaming", 0.4), ("HOLE", "honing", 0.1), ("POCKET", "milling", 0.8), ("SLOT", "milling", 0.8), ("SLOT", "grinding", 0.2), ("THREAD", "tapping", 1.6), ("THREAD", "threading", 1.6),
]
MACHINES_OF = {"milling": ["MILL", "MILL_TURN"], "drilling": ["MILL", "MILL_TURN", "DRILL"], "turning": ["LATHE", "MILL_TURN"], "boring": ["MILL", "LATHE"]}
#: Order of operations within a feature (before, after, kind).
PRECEDENCE = [
    ("drilling", "reaming", "BLOCKING"), ("drilling", "tapping", "BLOCKING"), ("drilling", "boring", "BLOCKING"), ("boring", "honing", "BLOCKING"), ("drilling", "threading", "BLOCKING"), ("turning", "grinding", "BLOCKING"),
    ("milling", "grinding", "BLOCKING"), ("facing", "drilling", "ADVISORY"), ("turning", "threading", "BLOCKING"), ("grinding", "lapping", "BLOCKING"), ("boring", "lapping", "BLOCKING"), ("milling", "deburring", "ADVISORY"), ("drilling", "deburring", "ADVISORY"),
]


def capability(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CAPABILITY, "feature_type string, operation string, best_ra double")


def routes_for(features: DataFrame, templates: DataFrame) -> DataFrame:
    """(features' columns, route, operations, best_ra, outcome): each feature's template routes against its required Ra (ra_um, NULL: none).

    Outcomes are ACCEPTED, CAPABILITY_GAP, and FEATURE_UNSUPPORTED for a type without template. templates: feature_type, route, operations, best_ra.
    """
    j = features.join(F.broadcast(templates), "feature_type", "left")  # a fixed table
    outcome = F.when(c("route").isNull(), "FEATURE_UNSUPPORTED").when(c("ra_um").isNotNull() & (c("best_ra") > c("ra_um")), "CAPABILITY_GAP").otherwise("ACCEPTED")
    return j.withColumn("outcome", outcome)


def clipped(score: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), score))


def machine_score(operation: Column, machine_type: Column, axes: Column, ra_um: Column) -> Column:
    """50, 30 more for a machine type of the operation, 10 more for five axes where they help (5 for four), 10 less for fine finishes outside a grinder."""
    fits = F.coalesce(*[F.when(operation == o, machine_type.isin(t)) for o, t in MACHINES_OF.items()], F.lit(False))
    more = F.when((axes >= 5) & operation.isin("milling", "boring"), 10).when(axes >= 4, 5).otherwise(0)
    return clipped(F.lit(50) + F.when(fits, 30).otherwise(0) + more - F.when((ra_um <= 0.1) & (machine_type != "GRINDER"), 10).otherwise(0))


def tool_score(d_mm: Column, wanted_mm: Column, groups: Column, iso_group: Column) -> Column:
    """50, up to 30 more the nearer the diameter, 20 more for the ISO group."""
    gap = F.abs(d_mm - wanted_mm)
    near = F.when(gap <= 0.1, 30).when(gap <= 1, 20).when(gap <= 3, 10).otherwise(0)
    return clipped(F.lit(50) + near + F.when(F.array_contains(groups, iso_group), 20).otherwise(0))


def holder_score(max_rpm: Column, rpm: Column) -> Column:
    """50, 30 more for enough speed, 20 less for too little, nothing where it is unknown."""
    return clipped(F.lit(50) + F.when(max_rpm >= rpm, 30).when(max_rpm < rpm, -20).otherwise(0))


def best(candidates: DataFrame, key: list[str], identity: str, k: int) -> DataFrame:
    """The k best-scored candidates of each key, ties by id, with their rank. The window's limit applies before the shuffle as well."""
    rank = F.row_number().over(W.partitionBy(*key).orderBy(c("score").desc(), identity))
    return candidates.withColumn("rank", rank).filter(c("rank") <= k)


def operation_machines(operations: DataFrame, machines: DataFrame, k: int = 3) -> DataFrame:
    """(operation, machine_id, score, rank): the best k machines of each distinct operation."""
    able = machines.select("machine_id", "machine_type", "axes", F.explode(items(c("processes"))).alias("operation"))
    j = operations.select("operation").distinct().join(able, "operation")
    return best(j.select("operation", "machine_id", machine_score(c("operation"), c("machine_type"), c("axes"), F.lit(None).cast("double")).alias("score")), ["operation"], "machine_id", k)


def precedence_edges(steps: DataFrame) -> DataFrame:
    """(plan_id, feature_id, src, dst, kind): rule edges between steps of one feature. Steps meet by feature and the rule's operation: no pairs of unrelated steps."""
    rules = F.broadcast(steps.sparkSession.createDataFrame(PRECEDENCE, "before string, after string, kind string"))
    a = steps.select("plan_id", "feature_id", c("step_id").alias("src"), c("operation").alias("before")).join(rules, "before")
    b = steps.select("plan_id", c("feature_id").alias("f2"), c("step_id").alias("dst"), c("operation").alias("after"))
    j = a.join(b, (a["plan_id"] == b["plan_id"]) & a["feature_id"].eqNullSafe(b["f2"]) & (a["after"] == b["after"]) & (a["src"] != b["dst"]))
    return j.select(a["plan_id"], "feature_id", "src", "dst", "kind").distinct()


def violated(edges: DataFrame, order: DataFrame) -> DataFrame:
    """BLOCKING edges whose steps stand the other way round in an order (plan_id, step_id, position)."""
    e = edges.filter("kind = 'BLOCKING'")
    p, q = order.select("plan_id", c("step_id").alias("src"), c("position").alias("p")), order.select("plan_id", c("step_id").alias("dst"), c("position").alias("q"))
    return e.join(p, ["plan_id", "src"]).join(q, ["plan_id", "dst"]).filter("p > q").select("plan_id", "feature_id", "src", "dst")


def variants(scopes: DataFrame, references: DataFrame) -> DataFrame:
    """(operation, iso_group, variant, vc, fz, ap): low end, middle and high end of the first record of each type in scope; scopes without a speed have none."""
    from ..functions.guards import wildcard

    r = references.select("record_id", "parameter_type", c("operation").alias("ro"), c("iso_group").alias("ri"), "min_value", "max_value")
    few = r.groupBy("parameter_type", "ro", "ri").agg(F.min_by(F.struct("min_value", "max_value"), "record_id").alias("r"), F.min("record_id").alias("id"))  # first of each scope
    j = scopes.select("operation", "iso_group").distinct().join(few, wildcard(c("ro"), c("operation")) & wildcard(c("ri"), c("iso_group")))
    first = lambda t: F.min_by(F.when(c("parameter_type") == t, c("r")), F.when(c("parameter_type") == t, c("id")))
    g = j.groupBy("operation", "iso_group").agg(first("cutting_speed").alias("vc"), first("feed_per_tooth").alias("fz"), first("depth_of_cut").alias("ap")).filter("vc IS NOT NULL")
    take = {"CONSERVATIVE": lambda x: x["min_value"], "BALANCED": lambda x: (x["min_value"] + x["max_value"]) / 2, "PRODUCTIVITY": lambda x: x["max_value"]}
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), *[f(c(k)).alias(k) for k in ("vc", "fz", "ap")]) for n, f in take.items()])).alias("v")
    return g.select("operation", "iso_group", rows).select("operation", "iso_group", "v.*")


def common_types(needs: DataFrame, key: str) -> DataFrame:
    """(key, machine_type): the types that do all operations of a key (setup, route)."""
    able = F.broadcast(needs.sparkSession.createDataFrame([(o, t) for o, ts in MACHINES_OF.items() for t in ts], "operation string, machine_type string"))
    own = needs.select(key, "operation").distinct()
    n = own.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    did = own.join(able, "operation").groupBy(key, "machine_type").agg(F.count(F.lit(1)).alias("k"))
    return did.join(n, key).filter("k = n").select(key, "machine_type")


def same_setup(frames: DataFrame, tight_mm: float) -> DataFrame:
    """(drawing_id, frame_ids, primary_datum, n_warnings): frames that ask for one setup (runouts, tight positions), first datum by order, total runouts."""
    runout = c("characteristic").isin("CIRCULAR_RUNOUT", "TOTAL_RUNOUT")
    tight = (c("characteristic") == "POSITION") & (c("tolerance") < tight_mm)
    ids = F.sort_array(F.collect_set(F.when(runout | tight, c("frame_id"))))
    return frames.groupBy("drawing_id").agg(
        F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("frame_ids"), F.coalesce(F.min_by(F.substr("datums", F.lit(1), F.lit(1)), F.when(c("datums").isNotNull(), F.struct("line_no", "frame_id", "s"))), F.lit("UNKNOWN")).alias("primary_datum"),
        F.count_if(c("characteristic") == "TOTAL_RUNOUT").alias("n_warnings"),
    )


def locked(candidates: DataFrame, locks: DataFrame, key: str, identity: str) -> DataFrame:
    """candidates with only the locked one of each key; keys without a lock, or whose lock is no candidate, keep all."""
    hit = candidates.join(locks.select(key, c("locked_id").alias(identity)), [key, identity], "left_semi").select(key, c(identity).alias("_one"))
    return candidates.join(hit, key, "left").filter(c("_one").isNull() | (c("_one") == c(identity))).drop("_one")


#: Characters of a gram of the substring index; shorter queries are looked up by what they have.
GRAM = 3


def _grams(text: Column, n: Column) -> Column:
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, n))).otherwise(F.array().cast("array<string>"))


def holding(queries: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """(q, key) for every text that holds a query: queries (q, not empty), texts (key, text); compared as they are.

    Texts are indexed by their grams of 1 to GRAM characters. A query is looked up by the rarest of its grams of GRAM characters (or by
    all of itself, if shorter), and what that finds is verified; a query with a gram that no text has finds nothing.
    """
    every = F.flatten(F.array(*[_grams(c("text"), F.lit(n)) for n in range(1, GRAM + 1)]))
    index = texts.select(key, F.explode(F.array_distinct(every)).alias("gram"))
    rarity = index.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    mine = queries.select("q").distinct().withColumn("gram", F.explode(F.array_distinct(_grams(c("q"), F.least(F.lit(GRAM), F.length("q"))))))
    rare = mine.join(rarity.hint("merge"), "gram", "left").groupBy("q").agg(F.min_by("gram", F.struct("df", "gram")).alias("gram"), F.count_if(c("df").isNull()).alias("lost")).filter("lost = 0")
    return rare.hint("merge").join(index.hint("merge"), "gram").join(texts.hint("merge"), key).filter(F.contains("text", c("q"))).select("q", key).distinct()


def bridged(names: DataFrame, materials: DataFrame) -> DataFrame:
    """names (raw, ...) with material_id and confidence: EXACT by normal form, else PARTIAL where the designation or the alias holds the name
    (first by group, without one last, and designation), else NONE. Names and texts are compared without outer blanks and in lower case.
    Materials may be many, and an estimate of what was exploded or grouped out of them is no bound, so they are merged and never broadcast."""
    norm = lambda x: F.lower(F.trim(x))
    known = materials.filter("designation <> ''")
    exact = known.groupBy(norm(c("designation")).alias("_k")).agg(F.min("material_id").alias("_e"))
    out = names.withColumn("_k", norm(c("raw"))).join(exact.hint("merge"), "_k", "left")
    texts = known.select("material_id", F.explode(F.array(norm(c("designation")), norm(c("alias")))).alias("text")).filter("text IS NOT NULL").distinct()
    numbered = texts.withColumn("_n", F.struct("material_id", F.xxhash64("text")))
    asked = out.filter(c("_e").isNull() & (c("_k") != "")).select(c("_k").alias("q"))
    hits = holding(asked, numbered.select("_n", "text"), "_n").select(c("q").alias("_k"), c("_n.material_id").alias("material_id"))
    order = F.struct(F.coalesce(c("iso_group"), F.lit("~")), c("designation"), c("material_id"))
    part = hits.join(known.select("material_id", "iso_group", "designation").hint("merge"), "material_id").groupBy("_k").agg(F.min_by("material_id", order).alias("_p"))
    out = out.join(part.hint("merge"), "_k", "left")
    confidence = F.when(c("_e").isNotNull(), "EXACT").when(c("_p").isNotNull(), "PARTIAL").otherwise("NONE")
    return out.withColumns({"material_id": F.coalesce("_e", "_p"), "confidence": confidence}).drop("_k", "_e", "_p")
