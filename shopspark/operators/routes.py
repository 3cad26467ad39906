"""Route scoring, feasibility and Pareto frontiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Points lost by risk level.
RISK_POINTS = {"LOW": 0, "MEDIUM": -5, "HIGH": -10, "CRITICAL": -15}


def points(raw: Column, weight: float, most: int) -> Column:
    """Weighted points, cut to a whole number toward zero and clamped to 0..most."""
    return F.greatest(F.lit(0), F.least(F.lit(most), (raw * F.lit(weight)).cast("int")))


def risk_penalty(level: Column, weight: float = 1.0) -> Column:
    raw = F.coalesce(*[F.when(level == k, F.lit(v)) for k, v in RISK_POINTS.items()])
    return F.greatest(F.lit(-15), (raw * F.lit(weight)).cast("int"))


def pareto(routes: DataFrame, key: str, route: str, more: list[str], less: list[str]) -> DataFrame:
    """Routes with the number of routes of their feature that dominate them (no worse in all, better in one); 0: on the frontier."""
    cols = [*more, *less]
    a = routes.select(key, route, *cols)
    b = routes.select(F.col(key), F.col(route).alias("_r"), *[F.col(c).alias(f"_{c}") for c in cols])
    no_worse, better = F.lit(True), F.lit(False)
    for c in more:
        no_worse, better = no_worse & (F.col(f"_{c}") >= F.col(c)), better | (F.col(f"_{c}") > F.col(c))
    for c in less:
        no_worse, better = no_worse & (F.col(f"_{c}") <= F.col(c)), better | (F.col(f"_{c}") < F.col(c))
    beaten = a.join(b, key).filter(no_worse & better).groupBy(key, route).agg(F.count_distinct("_r").alias("dominated_by"))
    return a.join(beaten, [key, route], "left").withColumn("dominated_by", F.coalesce("dominated_by", F.lit(0).cast("long")))


def top_k(df: DataFrame, key: str, k: int, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= k)


def feasibility(best_ra: Column, best_it: Column, gdt: Column, need_ra: Column, need_it: Column, need_gdt: Column) -> Column:
    """struct(coverage, rejections): share of the stated requirements that a route meets, and how many it misses."""
    asked = [(need_ra.isNotNull(), best_ra <= need_ra), (need_it.isNotNull(), best_it <= need_it), (need_gdt, gdt)]
    n = sum((F.coalesce(a, F.lit(False)).cast("int") for a, _ in asked), F.lit(0))
    met = sum((F.coalesce(a & ok, F.lit(False)).cast("int") for a, ok in asked), F.lit(0))
    return F.struct(F.coalesce(F.try_divide(met, n), F.lit(1.0)).alias("coverage"), (n - met).alias("rejections"))


def with_predecessors(ops: Column, rules: list[tuple[str, str]]) -> Column:
    """Each rule (operation, predecessor): a missing predecessor is put right before the operation."""
    for op, before in rules:
        at = F.array_position(ops, op).cast("int")
        ops = F.when((at > 0) & ~F.array_contains(ops, before), F.array_insert(ops, F.greatest(at, F.lit(1)), F.lit(before))).otherwise(ops)
    return ops


def skyline(routes: DataFrame, key: str, more: list[str], less: list[str], deals: int = 16) -> DataFrame:
    """The routes on their feature's frontier: no other is at least as good in all criteria and better in one. Equal routes stay together.

    Vectors of criteria are swept in falling order, in which a dominating one always comes first, and met with the frontier found so far
    only: first in ``deals`` parts of a feature, then over the parts' frontiers, so that neither pairs nor a whole feature are formed.
    A route without one of the criteria is on no frontier.
    """
    signed = [*[F.col(m) for m in more], *[-F.col(x) for x in less]]
    names = [f"_s{i}" for i in range(len(signed))]
    known = routes.dropna(subset=[*more, *less]).select("*", *[x.alias(n) for n, x in zip(names, signed, strict=True)])
    vectors = known.select(key, *names).distinct()

    def swept(v: DataFrame, *by: Column) -> DataFrame:
        rows = F.reverse(F.array_sort(F.collect_list(F.struct(*names))))
        beaten = lambda acc, x: F.exists(acc, lambda y: F.forall(F.array(*[y[n] - x[n] for n in names]), lambda d: d >= 0))
        kind = v.select(F.array(F.struct(*names))).schema[0].dataType.simpleString()
        front = v.groupBy(key, *by).agg(rows.alias("_rows")).withColumn("_rows", F.aggregate("_rows", F.array().cast(kind), lambda acc, x: F.when(beaten(acc, x), acc).otherwise(F.array_append(acc, x))))
        return front.select(key, F.explode("_rows").alias("_v")).select(key, "_v.*")

    front = swept(swept(vectors, F.pmod(F.xxhash64(*names), F.lit(deals)).alias("_deal")))
    return known.join(front, [key, *names], "left_semi").drop(*names)


def best_routes(routes: DataFrame, setups: list[str], setup_cost: int, k: int = 1) -> tuple[DataFrame, DataFrame]:
    """(plans, choices): each part's k best plans, and the route that a plan takes for each feature.

    A plan takes one feasible route for every feature that has any; it is worth the sum of their scores less ``setup_cost`` for each
    different setup. For a set of setups the best routes are those with the best score among them, so a feature's routes come down to
    one value for each set, a part's to the sums of these, and the best set is the best plan: no combination of routes is formed. The k
    plans differ in their sets of setups. plans: part_id, rank, setups (sorted), total, n_features, n_unresolved (features without a
    feasible route, which a plan leaves out); choices: part_id, rank, feature_id, route_id, setup_key, score.
    Ties go to fewer setups, then to the earlier ones of ``setups``; among routes to fewer operations, then to the smaller id.
    """
    sets = range(1, 1 << len(setups))
    names = lambda s: [x for i, x in enumerate(setups) if s >> i & 1]
    order = F.struct((-F.col("score")).alias("a"), F.col("n_ops").alias("b"), F.col("route_id").alias("c"))
    good = routes.filter(F.col("feasible") & F.col("setup_key").isin(setups))
    each = good.groupBy("part_id", "feature_id", "setup_key").agg(F.min(order).alias("r"))
    value = lambda s: F.max(F.when(F.col("setup_key").isin(names(s)), -F.col("r.a")))
    feature = each.groupBy("part_id", "feature_id").agg(*[value(s).alias(f"_{s}") for s in sets])
    sums = [F.when(F.count(f"_{s}") == F.count(F.lit(1)), F.sum(f"_{s}") - setup_cost * len(names(s))).alias(f"_{s}") for s in sets]
    part = feature.groupBy("part_id").agg(F.count(F.lit(1)).alias("n"), *sums)
    ranked = F.filter(F.array(*[F.struct((-F.col(f"_{s}")).alias("t"), F.lit(len(names(s))).alias("m"), F.lit(s).alias("s")) for s in sets]), lambda x: x["t"].isNotNull())
    # A set with a setup that its routes don't need is another's plan at a higher cost; it is told by the setups that are taken.
    best = part.select("part_id", F.posexplode(F.slice(F.array_sort(ranked), 1, k)).alias("i", "x")).select("part_id", (F.col("i") + 1).cast("long").alias("rank"), (-F.col("x.t")).alias("total"), F.col("x.s").alias("s"))
    bit = F.coalesce(*[F.when(F.col("setup_key") == x, F.lit(1 << i)) for i, x in enumerate(setups)])
    chosen = each.join(best, "part_id").filter(F.col("s").bitwiseAND(bit) > 0).groupBy("part_id", "rank", "feature_id").agg(F.min(F.struct("r", "setup_key")).alias("p"))
    choices = chosen.select("part_id", "rank", "feature_id", F.col("p.r.c").alias("route_id"), F.col("p.setup_key").alias("setup_key"), (-F.col("p.r.a")).alias("score"))
    count = routes.groupBy("part_id").agg(F.count_distinct("feature_id").alias("n_all"), F.count_distinct(F.when(F.col("feasible") & F.col("setup_key").isin(setups), F.col("feature_id"))).alias("n_features"))
    set_names = F.filter(F.array(*[F.when(F.col("s").bitwiseAND(F.lit(1 << i)) > 0, F.lit(x)) for i, x in enumerate(setups)]), lambda x: x.isNotNull())
    plans = count.join(best.withColumn("setups", F.array_join(F.array_sort(set_names), ",")), "part_id", "left")
    return plans.select("part_id", "rank", "setups", "total", "n_features", (F.col("n_all") - F.col("n_features")).alias("n_unresolved")), choices
