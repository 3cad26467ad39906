"""CSV texts by Python's own reader, and the element at a share of sorted values."""

import csv
import glob
import random

from pyspark.sql import functions as F

from shopspark.operators import campaign
from shopspark.sources import export


def test_csv_texts_read_back(spark, tmp_path):
    cells = ['=1+1', "-2", "+x", "@a", 'say "no", no', "two\tfields", "", None, "plain", "a,b", "\ttab", '"']
    rows = [(p, i, t, i * 1.5) for p in (1, 2) for i, t in enumerate(cells)]
    d = spark.createDataFrame(rows, "plan_id long, n long, note string, x double").repartition(5)
    lines = export.csv_lines(d, "plan_id", ["n"], {"n": F.col("n"), "note": F.col("note"), "the x": F.col("x")})
    path = str(tmp_path / "out")
    export.write_csv_texts(lines, "plan_id", path)
    for p in (1, 2):
        (file,) = glob.glob(f"{path}/plan_id={p}/*.txt")
        got = list(csv.reader(open(file)))
        guarded = ["'" + t if t and t[0] in "=+-@\t" else t or "" for t in cells]
        assert got == [["n", "note", "the x"]] + [[str(i), t, str(i * 1.5)] for i, t in enumerate(guarded)]
    assert export.csv_lines(d.limit(0), "plan_id", ["n"], {"n": F.col("n")}).count() == 0


def test_campaign_times(spark):
    r = random.Random(6)
    runs = [(r.choice(["A", "B", None]), r.randint(1, 4), i, 1, 2, 4, r.choice([None, *(float(x) for x in range(9))])) for i in range(150)] + [("C", 9, 1, 1, 1, 1, None)]
    d = spark.createDataFrame(runs, "class string, fixture long, run_id long, tp long, n_found long, n_items long, seconds double")
    got = {(x["class"], x["fixture"], x["level"]): (x["runs"], x["p90_s"], x["worst_s"]) for x in campaign.campaign(d).collect()}
    want = {}
    for a, f, *_, s in runs:
        for key in ((a, f, 0), (a, None, 1), (None, None, 3)):
            want.setdefault(key, []).append(s)
    for key, all_ in want.items():
        known = sorted(s for s in all_ if s is not None)
        want[key] = (len(all_), known[min(int(0.9 * len(known)), len(known) - 1)] if known else None, max(known, default=None))
    assert got == want


def test_verdicts_of_small_campaigns(spark):
    cols = "fixture long, run_id long, tp long, fn long, fp long, dim_tp long, dim_fn long, accepted long, edited long, rejected long, accepted_wrong long, class string, parent long, seconds double, good boolean, refused long"
    none = spark.createDataFrame([], "fixture long")

    def states(rows, failing=none, wrong=none):
        return {x["check_id"]: (x["value"], x["state"]) for x in campaign.verdicts(spark.createDataFrame(rows, cols), failing, wrong).collect()}

    good = [(1, r, 8, 2, 2, 7, 3, 6, 2, 2, 0, "CORE", None, 100.0 + r, True, 0) for r in range(3)]
    got = states(good)
    assert {k: s for k, (_, s) in got.items()} == {f"P{i}": "PASS" for i in range(1, 8)} | {"RECALL_GAIN": "INSUFFICIENT_DATA"}
    assert (got["P2"][0], got["P3"][0], got["P5"][0], got["P6"][0]) == (0.7, 0.8, 101.0, 0.4)
    poor = [(f, r, 1, 9, 9, 1, 9, 1, 4, 4, 1, "CORE", None, 500.0, r > 0, int(r == 1)) for f in (2, 3) for r in range(3)]
    crop = [(4, 0, 5, 5, 0, 5, 5, 0, 0, 0, 0, "CROP", 2, 9999.0, False, 5)]
    both = spark.createDataFrame([(2,), (3,), (3,)], "fixture long")
    got = states(poor + crop, both)
    assert {k: s for k, (_, s) in got.items()} == {f"P{i}": "FAIL" for i in range(1, 8)} | {"RECALL_GAIN": "PASS"}
    assert got["P1"][0] == 2 and got["P4"][0] == round(4 / 6, 6) and got["P5"][0] == 500.0 and got["P7"][0] == 6 and got["RECALL_GAIN"][0] == 0.4
    assert states(good, wrong=both)["P3"] == (0.8, "FAIL")
    got = states([])
    assert {k for k, (_, s) in got.items() if s == "INSUFFICIENT_DATA"} == {"P1", "P2", "P3", "P4", "P5", "P6", "RECALL_GAIN"} and got["P7"] == (0.0, "PASS")


def test_reviews_of_runs(spark):
    runs = spark.createDataFrame([(1, 1), (1, 2), (5, 1)], "fixture long, run_id long")
    found = spark.createDataFrame([(1, 1, 1, "3", "mm"), (1, 1, 2, "4", None), (1, 1, 3, None, "mm"), (1, 1, 4, "9", "mm")], "fixture long, run_id long, finding_no long, value string, unit string")
    truth = spark.createDataFrame([(1, 1, "DIAMETER", True), (1, 2, "RADIUS", True), (1, 3, "NOTE", True), (1, 4, "DIAMETER", None)], "fixture long, item_id long, feature_type string, required boolean")
    matched = spark.createDataFrame([(1, 1, 1, 1), (1, 1, 2, 3)], "fixture long, run_id long, finding_no long, item_id long")
    reviews = spark.createDataFrame([(1, 1, 1, "ACCEPT"), (1, 1, 3, "ACCEPT"), (1, 1, 4, "REJECT"), (1, 1, 2, "EDIT"), (1, 1, 2, None)], "fixture long, run_id long, finding_no long, action string")
    out = campaign.run_scores(runs, found, truth, matched, reviews, ["DIAMETER", "RADIUS"])
    got = {(x["fixture"], x["run_id"]): tuple(x)[2:] for x in out.collect()}
    assert out.columns[2:] == ["tp", "fn", "fp", "dim_tp", "dim_fn", "dim_fp", "critical_missed", "n_dim_looking", "accepted", "edited", "rejected", "accepted_wrong"]
    assert got == {(1, 1): (2, 2, 2, 1, 2, 1, 1, 2, 2, 1, 1, 1), (1, 2): (0, 4, 0, 0, 3, 0, 2, 0, 0, 0, 0, 0), (5, 1): (0,) * 12}
