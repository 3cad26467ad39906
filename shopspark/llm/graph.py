"""Connected components by contraction, and grouping of sorted Arrow streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, round_result


#: Edges that a task contracts by itself.
TASK_EDGES = 2_000_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's edges (a, b): each node but the smallest of its component there, with that smallest node."""
    held = [(x.column("a").to_numpy(), x.column("b").to_numpy()) for x in batches]
    if not held:
        return
    a, b = (np.concatenate(x) for x in zip(*held, strict=True))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        low = np.minimum(x, y)
        if (x == y).all():
            break
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        while (new[new] != new).any():
            new = new[new]
        label = new[label]
    out = np.flatnonzero(label != np.arange(len(nodes)))
    for k in range(0, len(out), 100_000):
        some = out[k : k + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(nodes[label[some]])], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of an undirected edge list (a, b: long); component is the smallest node.

    Each partition first contracts its own edges to a forest; where few edges are left, one partition holds them all and
    nothing more is to do. Otherwise each round maps every node to the smallest node near it (two pointer jumps) and
    contracts the edges, which shrink geometrically; rounds are aggregations with map-side combine and joins, checkpointed.
    """
    cur = round_result(edges.filter("a <> b").select("a", "b"))
    maps: list[DataFrame] = []
    while True:
        parts = -(-cur.count() // TASK_EDGES)
        if parts <= 1:
            last = round_result(cur.coalesce(1).mapInArrow(released(_forest), "a long, b long"))
            maps.append(last.select("a", F.col("b").alias("m")).union(last.select("b", "b").distinct()))
            break
        cur = round_result(cur.coalesce(parts).mapInArrow(released(_forest), "a long, b long"))
        cur = round_result(cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
        m = cur.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        for _ in range(2):
            m = round_result(m)
            m = m.join(m.select(F.col("a").alias("m"), F.col("m").alias("m2")), "m").select("a", F.col("m2").alias("m"))
        m = round_result(m)
        maps.append(m)
        cur = cur.join(m, "a").select(F.col("b"), F.col("m").alias("x")).join(m.select(F.col("a").alias("b"), F.col("m").alias("y")), "b")
        cur = round_result(cur.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")))
    out = maps[0].select(F.col("a").alias("node"), F.col("m").alias("component"))
    for m in maps[1:]:
        out = out.join(m.select(F.col("a").alias("component"), "m"), "component", "left").select("node", F.coalesce("m", "component").alias("component"))
    return round_result(out)


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of the rows with one key each, from a stream sorted by the key (int64)."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if held and k[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = k[a]
    if held:
        yield pa.Table.from_batches(held)
