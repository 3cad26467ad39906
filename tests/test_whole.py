"""The queries over whole tables: against their SQL without its id subsets, and brute force where that SQL is recursive."""

import os
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from shopspark.plans.views import TABLES, VIEWS
from shopspark.queries import ENTRIES
from shopspark.sources import ingest
from tests.test_queries import SF, norm

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def same(spark, duck, name, sql, folder=SF):
    df, want = ENTRIES[name].build(spark, folder), duck.sql(sql)
    cols = sorted(df.columns)
    at = [want.columns.index(c) for c in cols]
    rows = Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
    assert rows and rows == Counter(tuple(norm(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", ["compatibility", "ranked_selection", "selection_rollup"])
def test_whole_catalogs(spark, name):
    """On larger tables, as the smallest have no compatible triple."""
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    same(spark, con, name, ENTRIES[name].sql, folder)


def test_line_cap_is_for_nc_text_only(spark):
    n = ingest.NC_LINE_CAP + 1
    mesh = spark.range(1).select(F.lit(1).alias("k"), F.repeat(F.lit("v 0 0 1\n"), n).alias("text"))
    assert [r["vertices"] for r in ingest.mesh_inventory(mesh, "k").collect()] == [n]
    table = spark.range(1).select(F.lit(1).alias("k"), F.concat(F.repeat(F.lit("x\n"), n), F.lit("| a | b |")).alias("text"))
    assert [r["value"] for r in ingest.markdown_cells(table, "k").orderBy("col_no").collect()] == ["a", "b"]
    assert [tuple(r) for r in ingest.nc_lines(mesh).select("valid", "text").collect()] == [(False, None)]


def test_programs_over_the_block_keep_their_lines(spark):
    rows = [(p, i + 1, f"X{i}") for p, n in ((1, 7), (2, 3), (3, 1)) for i in range(n)]
    got = ingest.reread(spark.createDataFrame(rows, "program_id long, line_no long, text string"), 3).collect()
    assert sorted((r["program_id"], r["line_no"], r["text"]) for r in got) == sorted(rows) and all(r["valid"] for r in got)


def plans(duck, back):
    """Per plan the edges of its steps, and with ``back`` those that lead one step back."""
    steps = duck.sql(f"WITH v_step AS ({VIEWS['v_step']}) SELECT plan_id, seq, tool_id FROM v_step").fetchall()
    out = defaultdict(set)
    for plan, seq, tool in steps:
        if tool % 5:
            out[plan].add((seq, seq + 1))
        if back and tool % 37 == 0 and seq > 1:
            out[plan].add((seq, seq - 1))
    return out


def closure(edges):
    got = set(edges)
    while more := {(a, d) for a, b in got for c, d in edges if b == c} - got:
        got |= more
    return got


def test_whole_step_graphs(spark, duck):
    every = {p: closure(e) for p, e in plans(duck, True).items()}
    rows = lambda name: sorted(map(tuple, ENTRIES[name].build(spark, SF).collect()))
    assert rows("step_ancestors") == sorted((p, a, b) for p, t in every.items() for a, b in t)
    ring = {p: {a for a, b in t if a == b} for p, t in every.items()}
    assert rows("cyclic_steps") == sorted({(p, b) for p, t in every.items() for a, b in t if a in ring[p]})
    level = {}
    for p, e in plans(duck, False).items():  # edges lead from seq to seq + 1
        for a, b in sorted(e):
            level.setdefault((p, a), 0)
            level[p, b] = level[p, a] + 1
    assert rows("step_levels") == sorted((p, n, d) for (p, n), d in level.items())


@pytest.mark.parametrize("name", ["setup_spans", "schedule_violations"])
def test_equal_windows_are_no_matter_of_chance(spark, tmp_path, name):
    """Many windows of a machine are equal; the SQL must not depend on which of them comes first."""
    con = duckdb.connect()
    con.sql("create table orders as select i as o_orderkey, (i * 7919 % 13) as o_custkey, ['P', 'O', 'F'][1 + i % 3] as o_orderstatus from range(1, 400000) r(i) where i % 700 % 3 = 0")
    con.sql("create table customer as select i as c_custkey from range(13) r(i)")
    for t in ("orders", "customer"):
        con.sql(f"copy {t} to '{tmp_path}/{t}.parquet'")
    ENTRIES[name].build(spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    con.sql(f"create table want as {ENTRIES[name].sql}")
    con.sql(f"create view got as select * from '{tmp_path}/out/*.parquet'")
    cols = ", ".join(sorted(r[0] for r in con.sql("describe want").fetchall()))
    for a, b in (("want", "got"), ("got", "want")):
        assert con.sql(f"select count(*) from (select {cols} from {a} except all select {cols} from {b})").fetchall() == [(0,)]


def test_ranked_without_triples_is_ranked_over_them(spark):
    from shopspark.operators import compat
    from shopspark.plans.views import Shop

    shop = Shop(spark, SF.replace("sf0.001", "sf0.01"))
    request = dict(operation="milling", iso_group="P", rpm=9000)
    margin, reference = F.round((F.col("m_rpm") - 9000) / F.col("m_rpm"), 2), F.col("tool_id") % 2
    cols = ["machine_id", "tool_id", "holder_id", "margin", "rank", "tied", "ahead"]
    sides = (shop.v_machine.union(shop.v_machine.limit(5)), shop.v_tool, shop.v_holder)
    whole = compat.fitting(*sides, **request).withColumns({"margin": margin, "reference": reference})
    for limit in (1, 7, 60, 100_000):
        got = compat.ranked_fitting(*sides, **request, limit=limit, margin=margin, reference=reference)
        assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, compat.ranked(whole, limit).select(cols).collect()))
        assert got.count() > 0


def test_materials_are_never_broadcast(spark):
    from shopspark.operators import candidates as ca
    from shopspark.plans.views import Shop

    shop = Shop(spark, SF)
    d = ca.bridged(shop.lineitem.selectExpr("l_partkey AS q", "cast(l_partkey AS string) AS raw").distinct(), shop.v_material)
    assert "Broadcast" not in d._jdf.queryExecution().executedPlan().toString()


def test_evidence_of_small_and_large_pages_agrees(spark):
    import random

    from shopspark.operators import drawing as dr

    r = random.Random(3)
    rows = [(p, r.choice(["AI", "RULE"]), r.randrange(12), r.choice([None, *range(9)])) for p in range(40) for _ in range(r.randrange(1, 14))]
    ev = spark.createDataFrame(rows, "page long, side string, finding_id long, source_id long")

    def parted():
        out = defaultdict(set)
        for x in dr.evidence_groups(ev).collect():
            out[x["page"], x["grp"]].add((x["side"], x["finding_id"]))
        return sorted((p, sorted(v)) for (p, _), v in out.items())

    assert "Scan ExistingRDD[page" in dr.evidence_groups(ev)._jdf.queryExecution().executedPlan().toString()  # no checkpoint
    few = parted()
    small = dr.SMALL_PAGE
    try:
        for at in (0, 6):
            dr.SMALL_PAGE = at
            assert few == parted()
    finally:
        dr.SMALL_PAGE = small
