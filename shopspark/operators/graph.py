"""Dependency graphs and groups by repeated joins; graphs of few nodes in one row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Most rows (edges count twice) of a plan that is worked out in one row, where its nodes are the bits of a long.
SMALL_PLAN = 62


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, that of spark.checkpoint.dir where none is set yet; a cluster needs one that its machines share."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            raise ValueError("spark.checkpoint.dir names no folder")
        spark.sparkContext.setCheckpointDir(named)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def _cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    spark = df.sparkSession
    shared_folder(spark)
    jdf = df.checkpoint()._jdf
    return DataFrame(spark._jsparkSession.createDataFrame(jdf.toJavaRDD(), jdf.schema()), spark)


def _large(rows: DataFrame) -> DataFrame:
    """Plans that go the general way: those of many rows, and those without an id, whose edges meet none."""
    n = rows.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n"))
    return n.filter((F.col("n") > SMALL_PLAN) | F.col("plan_id").isNull()).select(F.col("plan_id").alias("_large"))


def _of(df: DataFrame, large: DataFrame, how: str) -> DataFrame:
    return df.join(large, df["plan_id"].eqNullSafe(large["_large"]), how)


def _bit(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), k.cast("int"))


def _has(bits: Column, k: Column) -> Column:
    return F.getbit(bits, k) == 1


def _any(bits: Column) -> Column:
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))


def _marks(picked: Column, end: str) -> Column:
    """Bits of the nodes at this end of the picked edges."""
    return _any(F.transform(picked, lambda x: _bit(F.array_position("nodes", x[end]) - 1)))


def _with(x: Column, f) -> Column:
    """f of x, which is worked out once and not again in each turn of a loop of f."""
    return F.transform(F.array(x), f)[0]


def _packed(edges: DataFrame) -> DataFrame:
    """(plan_id, e, nodes, reach): a plan's edges, its nodes in order, and for each node the bits of those that paths from it lead to. Each
    node in turn hands on what it reaches to those that reach it."""
    g = edges.select("plan_id", "src", "dst").repartition("plan_id").groupBy("plan_id").agg(F.collect_set(F.struct("src", "dst")).alias("e"))
    g = g.withColumn("own", F.filter("e", lambda x: x["src"].isNotNull() & x["dst"].isNotNull()))
    g = g.withColumn("nodes", F.array_sort(F.array_distinct(F.flatten(F.transform("own", lambda x: F.array(x["src"], x["dst"]))))))
    direct = F.transform("nodes", lambda n: _marks(F.filter("own", lambda x: x["src"] == n), "dst"))
    through = lambda reach, k: F.transform(reach, lambda r: F.when(_has(r, k), r.bitwiseOR(F.get(reach, k))).otherwise(r))
    return g.select("plan_id", "e", "nodes", F.aggregate(F.sequence(F.lit(0), F.size("nodes") - 1), direct, through).alias("reach"))


def _ancestors_of_few(edges: DataFrame) -> DataFrame:
    s, d = (edges.schema[k].dataType for k in ("src", "dst"))
    behind = lambda n, r: F.transform(F.filter("nodes", lambda _, j: _has(r, j)), lambda m: F.struct(n.cast(s).alias("src"), m.cast(d).alias("dst")))
    loose = F.filter("e", lambda x: x["src"].isNull() | x["dst"].isNull())  # edges that lead on to nothing
    return _packed(edges).select("plan_id", F.explode(F.concat(loose, F.flatten(F.zip_with("nodes", "reach", behind)))).alias("x")).select("plan_id", "x.*")


def ancestors(edges: DataFrame) -> DataFrame:
    """Transitive closure (plan_id, src, dst). Plans of few edges are worked out in one row; larger ones in rounds of joins."""
    large = _large(edges.union(edges))
    if large.isEmpty():
        return _ancestors_of_few(edges)
    return _ancestors_of_few(_of(edges, large, "left_anti")).union(_ancestors_of_many(_of(edges, large, "left_semi")))


def _ancestors_of_many(edges: DataFrame) -> DataFrame:
    """The same in rounds: in each only the paths that the last one found are lengthened, on both sides, so the
    number of rounds is the logarithm of the longest path; it ends when a round finds nothing new."""
    paths = fresh = _cut(edges.select("plan_id", "src", "dst").distinct())
    join = lambda x, y: x.alias("a").join(y.alias("b"), (F.col("a.plan_id") == F.col("b.plan_id")) & (F.col("a.dst") == F.col("b.src"))).select("a.plan_id", "a.src", "b.dst")
    while True:
        longer = join(fresh, paths).union(join(paths, fresh)).distinct()
        fresh = _cut(longer.join(paths, ["plan_id", "src", "dst"], "left_anti"))
        if fresh.isEmpty():
            return paths
        paths = _cut(paths.union(fresh))


def _cyclic_of_few(edges: DataFrame) -> DataFrame:
    behind = _any(F.transform("reach", lambda r, i: F.when(_has(r, i), r).otherwise(0)))
    nodes = _with(behind, lambda bits: F.filter("nodes", lambda _, j: _has(bits, j)))
    return _packed(edges).select("plan_id", F.explode(nodes).alias("node")).withColumn("node", F.col("node").cast(edges.schema["dst"].dataType))


def _cyclic_of_many(edges: DataFrame) -> DataFrame:
    paths = _ancestors_of_many(edges)
    ring = paths.filter("src = dst").select("plan_id", "src")
    return paths.join(ring, ["plan_id", "src"], "left_semi").select("plan_id", F.col("dst").alias("node")).distinct()


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """(plan_id, node) on or behind a cycle of (plan_id, src, dst): the nodes that reach themselves, and what they reach."""
    large = _large(edges.union(edges))
    if large.isEmpty():
        return _cyclic_of_few(edges)
    return _cyclic_of_few(_of(edges, large, "left_anti")).union(_cyclic_of_many(_of(edges, large, "left_semi")))


def _levels_of_few(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The levels of plans with few nodes, in layers: the nodes that all before them are done with, round by round."""
    kind = nodes.schema["node"].dataType
    e = edges.filter("src IS NOT NULL AND dst IS NOT NULL").select("plan_id", F.col("src").cast(kind).alias("src"), F.col("dst").cast(kind).alias("dst"), F.lit(False).alias("own"))
    own = nodes.select("plan_id", F.col("node").alias("src"), F.lit(None).cast(kind).alias("dst"), F.lit(True).alias("own"))
    g = e.union(own).repartition("plan_id").groupBy("plan_id").agg(F.collect_set(F.struct("src", "dst", "own")).alias("e"))
    g = g.withColumn("nodes", F.array_sort(F.transform(F.filter("e", lambda x: x["own"]), lambda x: x["src"]))).filter(F.size("nodes") > 0)
    known = lambda n, x: ~x["own"] & (x["dst"] == n) & (F.array_position("nodes", x["src"]) > 0)
    before = F.transform("nodes", lambda n: _marks(F.filter("e", lambda x: known(n, x)), "src"))
    more = lambda before, done: _any(F.transform(before, lambda b, j: F.when(b.bitwiseAND(done) == b, _bit(j)).otherwise(0)))
    layers = lambda before: F.aggregate("nodes", F.array(F.lit(0).cast("long")), lambda s, _: F.array_append(s, more(before, F.element_at(s, -1))))
    at = lambda done: F.transform("nodes", lambda n, j: F.struct(n.alias("node"), (F.size(F.filter(done, lambda m: ~_has(m, j))) - 1).alias("level")))
    level = _with(_with(before, layers), at)
    g = _cut(g.select("plan_id", level.alias("each"), F.size("nodes").alias("n")))
    if not g.filter(F.exists("each", lambda x: x["level"] >= F.col("n"))).isEmpty():
        raise ValueError("the graph has a cycle")
    return g.select("plan_id", F.explode("each").alias("x")).select("plan_id", "x.*")


def levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(plan_id, node, level): length of the longest path that leads to each node. Raises ValueError where the graph has a cycle. Plans of few
    nodes and edges are worked out in one row; larger ones in rounds of joins."""
    large = _large(edges.select("plan_id").union(nodes.select("plan_id")))
    if large.isEmpty():
        return _levels_of_few(edges, nodes)
    of = lambda how: (_of(edges, large, how), _of(nodes, large, how))
    return _levels_of_few(*of("left_anti")).union(_levels_of_many(*of("left_semi")))


def _levels_of_many(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The same in rounds. A level of as many steps as its graph has nodes can't be."""
    direct = edges.select("plan_id", "src", "dst").distinct()
    size = nodes.select("plan_id", "node").distinct().groupBy("plan_id").agg(F.count(F.lit(1)).alias("_n"))
    most = size.agg(F.max("_n")).first()[0] or 0
    moved = cur = _cut(nodes.select("plan_id", "node").distinct().withColumn("level", F.lit(0)))
    for _ in range(most + 1):  # only nodes that moved move others
        up = direct.join(moved.select("plan_id", F.col("node").alias("src"), "level"), ["plan_id", "src"]).groupBy("plan_id", F.col("dst").alias("node")).agg((F.max("level") + 1).alias("l2"))
        new = _cut(cur.join(up, ["plan_id", "node"], "left").select("plan_id", "node", F.greatest("level", F.coalesce("l2", F.lit(0))).alias("level"), (F.coalesce("l2", F.lit(0)) > F.col("level")).alias("_m")))
        moved, cur = new.filter("_m").drop("_m"), new.drop("_m")
        if moved.isEmpty():
            return cur
    raise ValueError("the graph has a cycle")


def topological(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(plan_id, node, level, position): nodes by level, then by id."""
    return levels(edges, nodes).withColumn("position", F.row_number().over(W.partitionBy("plan_id").orderBy("level", "node")).cast("long"))


def independent(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """(plan_id, a, b), a < b: pairs of steps of one feature that no path connects. steps: plan_id, feature_id, step_id."""
    s = steps.select("plan_id", "feature_id", "step_id").distinct()
    pairs = s.withColumnRenamed("step_id", "a").join(s.withColumnRenamed("step_id", "b"), ["plan_id", "feature_id"]).filter("a < b").select("plan_id", "a", "b")
    paths = ancestors(edges).select("plan_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    return pairs.join(paths, ["plan_id", "a", "b"], "left_anti")


def groups(pairs: DataFrame) -> DataFrame:
    """(node, grp) of the nodes of undirected (a, b); grp is the smallest node of the connected component."""
    e = _cut(pairs.select("a", "b").union(pairs.select(F.col("b"), F.col("a"))).distinct())
    label = _cut(e.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("grp")))
    while True:
        near = e.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("grp").alias("g2"))
        new = label.join(near, "node").select("node", "grp", F.least("grp", "g2").alias("g"))
        jump = new.select(F.col("node").alias("g"), F.col("g").alias("gg"))
        new = _cut(new.join(jump, "g", "left").select("node", F.coalesce("gg", "g").alias("grp"), (F.coalesce("gg", "g") < F.col("grp")).alias("moved")))
        label = new.select("node", "grp")
        if not new.filter("moved").count():
            break
    return label
