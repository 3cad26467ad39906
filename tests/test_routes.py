"""Best plans against the enumeration of all combinations; the frontier against all pairs."""

import itertools
import random

from pyspark.sql import functions as F

from shopspark.operators import routes

SETUPS = ["A", "B", "C"]


def test_best_routes_is_the_best_combination(spark):
    r = random.Random(4)
    rows = [(p, f, 10 * f + i, r.randint(0, 20), r.randint(1, 4), r.choice([*SETUPS, "Z"]), r.random() < 0.8) for p in range(60) for f in range(r.randint(1, 4)) for i in range(r.randint(1, 4))]
    d = spark.createDataFrame(rows, "part_id long, feature_id long, route_id long, score int, n_ops int, setup_key string, feasible boolean")
    plans, choices = routes.best_routes(d, SETUPS, 6)
    plans, choices = {x.part_id: x for x in plans.collect()}, choices.collect()
    for p in range(60):
        mine = [x for x in rows if x[0] == p]
        lists = [[x for x in mine if x[1] == f and x[6] and x[5] in SETUPS] for f in {x[1] for x in mine}]
        full = [x for x in lists if x]
        worth = lambda combo: sum(x[3] for x in combo) - 6 * len({x[5] for x in combo})
        assert plans[p].n_features == len(full) and plans[p].n_unresolved == len(lists) - len(full)
        if not full:
            assert plans[p].total is None
            continue
        assert plans[p].total == max(worth(x) for x in itertools.product(*full))
        taken = [x for x in choices if x.part_id == p]
        assert len(taken) == len(full) and {x.setup_key for x in taken} == set(plans[p].setups.split(","))
        assert sum(x.score for x in taken) - 6 * len({x.setup_key for x in taken}) == plans[p].total


def test_skyline(spark):
    r = random.Random(5)
    rows = [(k, i, r.randint(0, 6), r.randint(0, 4), r.randint(0, 4), None if i == 7 else r.randint(0, 3)) for k in range(5) for i in range(60)]
    d = spark.createDataFrame(rows, "k int, i int, a int, b int, c int, e int")
    known = [x for x in rows if x[5] is not None]
    good = lambda x, y: x[2] >= y[2] and x[3] <= y[3] and x[4] <= y[4] and x[5] <= y[5] and x[2:] != y[2:]
    want = {x for x in known if not any(y[0] == x[0] and good(y, x) for y in known)}
    for deals in (1, 16):
        assert {tuple(x) for x in routes.skyline(d, "k", ["a"], ["b", "c", "e"], deals).collect()} == want
    assert d.filter(F.lit(False)).count() == 0
