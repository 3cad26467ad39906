"""The order-aware line difference against a longest common subsequence, and on long programs."""

import random
import time

import pytest
from pyspark.sql import functions as F

from shopspark.operators import linediff


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def table(spark, programs):
    rows = [(p, 10 * i, t) for p, lines in programs.items() for i, t in enumerate(lines)]
    return spark.createDataFrame(rows, "program_id long, line_no long, text string")


def check(out, a, b):
    """Every line once, unchanged lines equal and rising on both sides, the k-th lost line with the k-th new one; the number unchanged."""
    kept = {}
    for p in a.keys() | b.keys():
        x, y = [(t or "").strip(" ") for t in a.get(p, [])], [(t or "").strip(" ") for t in b.get(p, [])]
        rows = [r for r in out if r.program_id == p]
        assert sorted(r.a_line for r in rows if r.a_line) == list(range(1, len(x) + 1))
        assert sorted(r.b_line for r in rows if r.b_line) == list(range(1, len(y) + 1))
        same = sorted((r.a_line, r.b_line) for r in rows if r.change == "UNCHANGED")
        assert all(x[i - 1] == y[j - 1] for i, j in same) and [j for _, j in same] == sorted(j for _, j in same)
        ends = [(0, 0), *same, (len(x) + 1, len(y) + 1)]
        for (i0, j0), (i1, j1) in zip(ends, ends[1:], strict=False):
            lost, new = list(range(i0 + 1, i1)), list(range(j0 + 1, j1))
            n = min(len(lost), len(new))
            want = [("MODIFIED", i, j) for i, j in zip(lost, new, strict=False)] + [("REMOVED", i, None) for i in lost[n:]] + [("ADDED", None, j) for j in new[n:]]
            assert all(any((r.change, r.a_line, r.b_line) == w for r in rows) for w in want)
        kept[p] = len(same)
    return kept


@pytest.fixture(scope="module")
def pairs():
    r = random.Random(6)
    a, b = {}, {}
    for p in range(40):
        few = [f"G1 X{r.randrange(9)}" for _ in range(6)]
        x = [r.choice(few) if r.random() < 0.5 else f"N{r.randrange(40)}" for _ in range(r.randrange(0, 30))]
        y = list(x)
        for _ in range(r.randrange(0, 8)):
            k = r.randrange(len(y) + 1)
            y[k : k + r.randrange(3)] = [r.choice(few) for _ in range(r.randrange(3))]
        if p % 7 == 3:
            r.shuffle(y)
        a[p], b[p] = x, y
    a[100], b[101] = ["M5", " M5 ", None], ["", "G0"]
    a[102], b[102] = ["U", "x", "x"], ["x", "x", "U"]
    return a, b


def test_small_pairs_keep_as_many_lines_as_possible(spark, pairs):
    a, b = pairs
    kept = check(linediff.ordered_diff(table(spark, a), table(spark, b)).collect(), a, b)
    text = lambda lines: [(t or "").strip(" ") for t in lines]
    assert kept == {p: longest(text(a.get(p, [])), text(b.get(p, []))) for p in kept}


@pytest.mark.parametrize("cells", [0, 9])
def test_gaps_that_are_cut_further(spark, pairs, cells):
    a, b = pairs
    kept = check(linediff.ordered_diff(table(spark, a), table(spark, b), cells).collect(), a, b)
    best = sum(longest([(t or "").strip(" ") for t in a.get(p, [])], [(t or "").strip(" ") for t in b.get(p, [])]) for p in kept)
    assert sum(kept.values()) >= 0.6 * best and all(kept[p] > 0 for p in kept if set(a.get(p, [])) & set(b.get(p, [])))


def test_long_pair(spark):
    """100,000 lines, a third of them the same word, with edits and a moved block."""
    n = 100_000
    a = spark.range(n).select(F.lit(1).cast("long").alias("program_id"), F.col("id").alias("line_no"), F.when(F.col("id") % 3 == 0, "G90").otherwise(F.concat(F.lit("G1 X"), F.col("id") * 7 % 60000)).alias("text"))
    b = a.filter("line_no % 1000 <> 5").withColumn("text", F.when(F.col("line_no") % 777 == 1, F.concat("text", F.lit(" F5"))).otherwise(F.col("text")))
    b = b.withColumn("line_no", F.when(F.col("line_no").between(40_000, 40_999), F.col("line_no") + 20_000.5).otherwise(F.col("line_no").cast("double")))
    began = time.time()
    got = {r["change"]: r["count"] for r in linediff.ordered_diff(a, b).groupBy("change").count().collect()}
    assert got["UNCHANGED"] >= 0.97 * n and got.get("MODIFIED", 0) >= 100 and time.time() - began < 300
    assert got["UNCHANGED"] + got.get("MODIFIED", 0) + got["REMOVED"] == n


def test_lines_are_shuffled_once_for_closed_gaps(spark, pairs):
    """Anchors and lines without a counterpart are told where they stand; only gaps with lines on both sides are grouped."""
    a, b = pairs
    plan = linediff.ordered_diff(table(spark, a), table(spark, b))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
