"""Compatibility of machine, tool and holder, and ranking with ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .catalog import items

#: Holder interfaces that clamp a shank, seats that take one insert shape, and the bar with its diameter.
CLAMPING = ["ER32", "HYDRAULIC"]
SEATS = {"INSERT_CNMG": "CNMG"}
BAR, BAR_MM, BAR_TOLERANCE = "BORING_BAR_25", 25.0, 0.1
RULES = ["r_interface", "r_shank", "r_length", "r_diameter", "r_iso", "r_rpm_m", "r_rpm_t", "r_rpm_h"]


def interfaces(df_interface: Column, more: Column) -> Column:
    return F.array_distinct(F.concat(F.array_compact(F.array(df_interface)), items(more)))


def _catalogs(machines: DataFrame, tools: DataFrame, holders: DataFrame, operation: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the rules read of the machines and tools that do the operation, and of the holders."""
    m = machines.filter(F.array_contains(items(F.col("processes")), operation)).select("machine_id", F.col("max_rpm").alias("m_rpm"), F.array_sort(interfaces(F.col("spindle_interface"), F.col("more_interfaces"))).alias("own"), "max_tool_d", "max_tool_len")
    t = tools.filter(F.array_contains(items(F.col("operations")), operation)).select("tool_id", F.col("max_rpm").alias("t_rpm"), "d_mm", "length_mm", "shank_mm", "insert_shape", items(F.col("iso_groups")).alias("groups"))
    return m, t, holders.select("holder_id", F.col("max_rpm").alias("h_rpm"), "machine_interface", "tool_interface", "clamp_min", "clamp_max")


#: Most rows of a frame that is broadcast; a longer one is joined by what the optimizer picks.
BROADCAST_ROWS = 100_000


def bounded(df: DataFrame) -> DataFrame:
    """df with a broadcast hint where it has at most BROADCAST_ROWS rows; counting stops there."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def verdict_counts(machines: DataFrame, tools: DataFrame, holders: DataFrame, operation: str, iso_group: str, rpm: float) -> DataFrame:
    """(verdict, rules, n) over all triples whose machine and tool do the operation.

    Rows of a catalog that no rule tells apart are one group with a row count. Tool and holder groups are paired, reduced
    to their rules and counted again; the machines' groups meet them in each of the holders' interfaces.
    """
    c = F.col
    m, t, h = _catalogs(machines, tools, holders, operation)
    n = F.count(F.lit(1))
    limit = lambda x: _known(c(x).isNull(), c(x) >= rpm)
    h = h.groupBy("machine_interface", "tool_interface", "clamp_min", "clamp_max", limit("h_rpm").alias("r_rpm_h")).agg(n.alias("n_h"))
    t = t.groupBy("d_mm", "length_mm", "shank_mm", "insert_shape", _iso(iso_group).alias("r_iso"), limit("t_rpm").alias("r_rpm_t")).agg(n.alias("n_t"))
    faces = h.select("machine_interface").distinct()
    m = m.groupBy("own", "max_tool_d", "max_tool_len", limit("m_rpm").alias("r_rpm_m")).agg(n.alias("n_m"))
    m = m.join(bounded(faces), F.lit(True)).groupBy("machine_interface", _interface().alias("r_interface"), "r_rpm_m", "max_tool_d", "max_tool_len").agg(F.sum("n_m").alias("n_m"))
    th = t.join(bounded(h), F.lit(True)).groupBy("machine_interface", "d_mm", "length_mm", _shank().alias("r_shank"), "r_iso", "r_rpm_t", "r_rpm_h").agg(F.sum(c("n_t") * c("n_h")).alias("n_th"))
    pairs = th.join(m, th["machine_interface"].eqNullSafe(m["machine_interface"])).withColumns({"r_length": _length(), "r_diameter": _diameter()})
    return pairs.groupBy(*RULES).agg(F.sum(c("n_th") * c("n_m")).alias("n")).select(_verdict().alias("verdict"), *RULES, "n")


def _fitting_sides(machines: DataFrame, tools: DataFrame, holders: DataFrame, operation: str, iso_group: str, rpm: float) -> tuple[DataFrame, DataFrame]:
    """Tools with holders, and machines by interface, after each rule that reads one catalog, or tool and holder."""
    c = F.col
    m, t, h = _catalogs(machines, tools, holders, operation)
    m = m.filter(c("m_rpm") >= rpm).withColumn("machine_interface", F.explode("own"))
    h = h.filter(c("h_rpm") >= rpm)
    t = t.filter((c("t_rpm") >= rpm) & (_iso(iso_group) == "PASS"))
    return t.join(bounded(h), _shank() == "PASS"), m


def fitting(machines: DataFrame, tools: DataFrame, holders: DataFrame, operation: str, iso_group: str, rpm: float) -> DataFrame:
    """The COMPATIBLE triples: each rule that reads one catalog, or tool and holder, is applied before the machines are met by an equi join on the interface."""
    th, m = _fitting_sides(machines, tools, holders, operation, iso_group, rpm)
    return th.join(m, "machine_interface").filter((_length() == "PASS") & (_diameter() == "PASS"))


def ranked_fitting(machines: DataFrame, tools: DataFrame, holders: DataFrame, operation: str, iso_group: str, rpm: float, limit: int, margin: Column, reference: Column) -> DataFrame:
    """``ranked`` over ``fitting``, without its triples; margin is of a machine (m_rpm), reference of a tool (tool_id).

    Limits of machines (few values) meet the counts of tools and holders by length, diameter and reference, which tells each machine's number of triples by
    reference. Each such cell has a triple at least, so the first ``limit`` cells hold the first ``limit`` triples, and only those are formed.
    """
    th, m = _fitting_sides(machines, tools, holders, operation, iso_group, rpm)
    th, m = th.withColumn("reference", reference), m.withColumn("margin", margin)
    bounds = ["machine_interface", "max_tool_len", "max_tool_d"]
    sizes = th.groupBy("machine_interface", "length_mm", "d_mm", "reference").agg(F.count(F.lit(1)).alias("n"))
    fit = m.select(*bounds).distinct().join(sizes, "machine_interface").filter((_length() == "PASS") & (_diameter() == "PASS")).groupBy(*bounds, "reference").agg(F.sum("n").alias("n"))
    cells = m.join(fit, bounds).groupBy("machine_id", "margin", "reference").agg(F.sum("n").alias("n"))
    first = cells.orderBy(*_order(), "machine_id").limit(limit).select("machine_id", F.col("margin").alias("_margin"), "reference")
    own = m.join(F.broadcast(first), "machine_id").filter(F.col("margin").eqNullSafe(F.col("_margin"))).drop("_margin")
    rows = th.join(F.broadcast(own), ["machine_interface", "reference"]).filter((_length() == "PASS") & (_diameter() == "PASS"))
    return _with_ranks(rows, cells.groupBy("margin", "reference").agg(F.sum("n").alias("n")), limit)


def interface_pairs(machines: DataFrame, holders: DataFrame) -> DataFrame:
    """Only the pairs that fit: an equi join on the exploded interfaces instead of a product."""
    m = machines.select("machine_id", F.explode(interfaces(F.col("spindle_interface"), F.col("more_interfaces"))).alias("machine_interface"))
    return m.join(holders.select("holder_id", "machine_interface"), "machine_interface").select("machine_id", "holder_id")


def _known(unknown: Column, ok: Column) -> Column:
    return F.when(unknown, "UNKNOWN").when(ok, "PASS").otherwise("FAIL")


def evaluate(triples: DataFrame, iso_group: str | Column, rpm: float | Column) -> DataFrame:
    """The rules' statuses, and verdict: any FAIL is INCOMPATIBLE, else any UNKNOWN is INSUFFICIENT_DATA. Group and speed may differ by row; a speed that is NULL is unknown."""
    out = triples.withColumns({
        "r_interface": _interface(), "r_shank": _shank(), "r_length": _length(), "r_diameter": _diameter(),
        "r_iso": _iso(iso_group), "r_rpm_m": _limit("m_rpm", rpm), "r_rpm_t": _limit("t_rpm", rpm), "r_rpm_h": _limit("h_rpm", rpm),
    })
    return out.withColumn("verdict", _verdict())


def held_rules(iso_group: str | Column, rpm: float | Column) -> list[Column]:
    """Statuses of the rules that read tool and holder alone."""
    return [_shank(), _iso(iso_group), _limit("t_rpm", rpm), _limit("h_rpm", rpm)]


def machine_rules(rpm: float | Column) -> list[Column]:
    """Statuses of the rules that read the machine."""
    return [_interface(), _length(), _diameter(), _limit("m_rpm", rpm)]


def worst(*rules: Column) -> Column:
    """2 where a rule is FAIL, else 1 where one is UNKNOWN, else 0; the greatest of two parts' is that of all their rules."""
    return F.greatest(*[F.when(r == "FAIL", 2).when(r == "UNKNOWN", 1).otherwise(0).cast("byte") for r in rules])


def said(worst: Column) -> Column:
    """The verdict of ``worst``, as ``evaluate`` gives it."""
    return F.when(worst == 2, "INCOMPATIBLE").when(worst == 1, "INSUFFICIENT_DATA").otherwise("COMPATIBLE")


def _limit(x: str, rpm: float | Column) -> Column:
    return _known(F.col(x).isNull() | F.lit(rpm).isNull(), F.col(x) >= rpm)


def _interface() -> Column:
    return _known(F.size("own") == 0, F.array_contains("own", F.col("machine_interface")))


def _length() -> Column:
    return _known(F.col("length_mm").isNull() | F.col("max_tool_len").isNull(), F.col("length_mm") <= F.col("max_tool_len"))


def _diameter() -> Column:
    return _known(F.col("d_mm").isNull() | F.col("max_tool_d").isNull(), F.col("d_mm") <= F.col("max_tool_d"))


def _iso(iso_group: str | Column) -> Column:
    return _known(F.size("groups") == 0, F.array_contains("groups", iso_group))


def _verdict() -> Column:
    every = F.array(*RULES)
    return F.when(F.array_contains(every, "FAIL"), "INCOMPATIBLE").when(F.array_contains(every, "UNKNOWN"), "INSUFFICIENT_DATA").otherwise("COMPATIBLE")


def _shank() -> Column:
    c = F.col
    shank = F.when(c("tool_interface").isin(CLAMPING), _known(c("shank_mm").isNull() | c("clamp_min").isNull() | c("clamp_max").isNull(), c("shank_mm").between(c("clamp_min"), c("clamp_max"))))
    for seat, shape in SEATS.items():
        shank = shank.when(c("tool_interface") == seat, _known(c("insert_shape").isNull(), c("insert_shape") == shape))
    shank = shank.when(c("tool_interface") == BAR, _known(c("shank_mm").isNull(), F.abs(c("shank_mm") - BAR_MM) <= BAR_TOLERANCE)).otherwise("UNKNOWN")
    return shank


def _order() -> list[Column]:
    return [F.col("margin").desc_nulls_last(), F.col("reference").desc()]


def ranked(df: DataFrame, limit: int) -> DataFrame:
    """Ranks by (margin desc, NULL last, reference desc): equal keys tie, the next key is one rank on; first ``limit`` rows.

    The distinct keys are ranked apart (margins are rounded, so they are few), and the rows are cut by an ordered limit, so no
    window runs over all rows. ahead says why a key stands before the next distinct one.
    """
    return _with_ranks(df, df.groupBy("margin", "reference").agg(F.count(F.lit(1)).alias("n")), limit)


def _with_ranks(df: DataFrame, keys: DataFrame, limit: int) -> DataFrame:
    w = W.orderBy(*_order())
    keys = keys.withColumn("rank", F.dense_rank().over(w)).withColumn("m2", F.lead("margin").over(w)).withColumn("r2", F.lead("reference").over(w))
    ahead = F.when(F.col("m2").isNotNull() & (F.col("margin") > F.col("m2")), "HIGHER_RPM_MARGIN").when(F.col("margin").isNotNull() & F.col("m2").isNull() & F.col("r2").isNotNull(), "RPM_MARGIN_KNOWN").when(F.col("reference") > F.col("r2"), "REFERENCE_GUIDANCE")
    keys = keys.select(F.col("margin").alias("_m"), F.col("reference").alias("_r"), "rank", (F.col("n") > 1).alias("tied"), ahead.alias("ahead"))
    top = df.orderBy(*_order(), "machine_id", "holder_id", "tool_id").limit(limit)
    return top.join(keys, top["margin"].eqNullSafe(F.col("_m")) & (top["reference"] == F.col("_r"))).drop("_m", "_r")
