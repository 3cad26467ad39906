"""Near duplicates among embeddings: spherical k-means cells, blocked cosine products within cells.

Equal vectors are one class. Classes are dealt to the cell of the nearest centre, their home, and as guests to every other
cell whose border (the plane halfway between the two centres) is nearer than ``reach``. A cell's classes are cut into
blocks; a task multiplies two blocks and gives each class its number of links and a spanning forest of the links found,
never the pairs.

Which pairs are found. Let two unit vectors be at distance d, at most D = sqrt(2 - 2 threshold), with homes c and c'. Their
distances from the border of c and c' sum to the length t of their difference across it, so one of them is at most t / 2
from it, and with reach D / 2 no pair is lost. In many dimensions a difference hardly ever lies straight across a border:
for differences of random direction t has deviation d / sqrt(dimensions). The reach is therefore ``deviations`` of these
(halved), D / 2 at most: with 4, a pair across one border is missed with a probability below 1 in 30,000, and up to 16
dimensions none is. ``deviations=None`` takes D / 2 whatever the dimensions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed, read_table
from .graph import components, sorted_groups

#: Parameters of near_duplicates.
THRESHOLD, DEVIATIONS = 0.95, 4.0
#: Classes that a cell is meant for, cells at most, and classes of a block.
CELL_ROWS, MOST_CELLS, BLOCK_ROWS = 2048, 4096, 2048
#: Sample of the fit: rows a cell, rows and numbers at most; rounds of k-means.
SAMPLE_PER_CELL, SAMPLE_ROWS, SAMPLE_NUMBERS, ROUNDS = 64, 65_536, 1 << 23, 8
#: Products nearer to the threshold than this are taken again with exact sums.
CLOSE = 1e-12


def _valid(e):
    """Not null, not empty, no null or non-finite component, not zero."""
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(e) > 0) & ~bad & F.exists(e, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, shorter ones with zeros behind, and their lengths (dimensions)."""
    off = column.offsets.to_numpy()
    size = np.diff(off)
    x = np.zeros((len(size), width))
    x[np.arange(width)[None, :] < size[:, None]] = column.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]]
    return x, size


def _scaled(x: np.ndarray) -> np.ndarray:
    """Largest component 1, so that squares neither vanish nor overflow."""
    return x / np.abs(x).max(axis=1, keepdims=True)


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _fit(width: int, k: int):
    """Spherical k-means of a bounded sample (one partition): centres, one a row. An emptied cell keeps its centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_unit(_matrix(b.column("e"), width)[0]) for b in batches if b.num_rows]
        if not held:
            return
        x = np.concatenate(held)
        centre = x[:k].copy()
        for _ in range(ROUNDS):
            near = np.concatenate([np.argmax(x[i : i + 4096] @ centre.T, axis=1) for i in range(0, len(x), 4096)])
            total = np.zeros_like(centre)
            np.add.at(total, near, x)
            norm = np.linalg.norm(total, axis=1)
            centre[norm > 1e-9] = total[norm > 1e-9] / norm[norm > 1e-9, None]
        yield pa.RecordBatch.from_arrays([pa.array(list(centre), pa.list_(pa.float64()))], names=["centre"])

    return run


def centres(classes: DataFrame, width: int, rows: int) -> np.ndarray:
    """Cell centres, fitted on the classes with the smallest hashes: at most SAMPLE_ROWS of them and SAMPLE_NUMBERS numbers."""
    k = max(1, min(MOST_CELLS, -(-rows // CELL_ROWS)))
    most = max(k, min(SAMPLE_ROWS, SAMPLE_PER_CELL * k, SAMPLE_NUMBERS // max(1, width)))
    share = math.ceil(min(1.0, 4 * most / rows) * (1 << 30))  # a few times too many, so that no task reads more than these
    sample = classes.filter(F.pmod("h", F.lit(1 << 30)) < share).orderBy("h", "e").limit(most).select("e").coalesce(1)
    found = sample.mapInArrow(_fit(width, k), "centre array<double>").collect()
    return np.array([r["centre"] for r in found])


def _dealt(centre, width: int, reach: float):
    """Each class at its home and at the cells whose border it is near to: cell, home, near (these cells), with the class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centre.value
        gap = np.linalg.norm(c[:, None, :] - c[None, :, :], axis=2) if len(c) <= 512 else None
        for whole in batches:
            for low in range(0, whole.num_rows, 1024):
                batch = whole.slice(low, 1024)
                s = _unit(_matrix(batch.column("e"), width)[0]) @ c.T
                home = s.argmax(axis=1)
                apart = gap[home] if gap is not None else np.sqrt(np.maximum(0, 2 - 2 * (c[home] @ c.T)))
                near = s[np.arange(len(s)), home][:, None] - s <= reach * apart + 1e-9  # distance from the border, times the centres'
                near[np.arange(len(s)), home] = False
                row, cell = np.nonzero(near)
                take = np.concatenate([np.arange(len(s)), row])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(near.sum(axis=1))]).astype(np.int32)), pa.array(cell.astype(np.int32)))
                out = batch.take(pa.array(take))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([home, cell]).astype(np.int32)), pa.array(home[take].astype(np.int32)), lists.take(pa.array(take)), out.column("cid"), out.column("n"), out.column("e")],
                    names=["cell", "home", "near", "cid", "n", "e"],
                )

    return run


def _links(threshold: float, width: int):
    """Of each task's two blocks: links by class (side 0: cid, n), and a spanning forest of what links (side 1: a, b)."""

    def close(x: np.ndarray, y: np.ndarray) -> bool:
        return math.fsum(x * y) / (math.sqrt(math.fsum(x * x)) * math.sqrt(math.fsum(y * y))) >= threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task in sorted_groups(batches, "task"):
            cid, n = task.column("cid").to_numpy(), task.column("n").to_numpy()
            home, cell = task.column("home").to_numpy(), task.column("cell").to_numpy()
            part = task.column("side").to_numpy()
            left, right = np.flatnonzero(part != 1), np.flatnonzero(part != 0)  # 2: both
            if not len(left) or not len(right):
                continue
            x, size = _matrix(task.column("e").combine_chunks(), width)
            x, u = _scaled(x), _unit(x)
            # A pair of a guest and a resident that is dealt to both homes counts at the smaller cell.
            near = task.column("near").combine_chunks()
            width_of = int(max(home.max(), cell.max(), near.values.to_numpy().max(initial=0))) + 1
            both = np.unique(np.repeat(np.arange(len(cid)), np.diff(near.offsets.to_numpy())) * width_of + near.values.to_numpy()[near.offsets[0].as_py() : near.offsets[-1].as_py()])
            guest = home[right] != cell[right]
            links, root = np.zeros(len(cid), np.int64), np.arange(len(cid))
            for low in range(0, len(left), 512):
                some = left[low : low + 512]
                s = u[some] @ u[right].T
                hit = s >= threshold
                for i, j in zip(*np.nonzero(np.abs(s - threshold) < CLOSE), strict=True):
                    hit[i, j] = close(x[some[i]], x[right[j]])
                i, j = np.nonzero(hit)
                a, b = some[i], right[j]
                ok = (size[a] == size[b]) & ((part[a] != 2) | (part[b] != 2) | (a < b))
                again = guest[j] & (cell[b] > home[b]) & np.isin(a * width_of + home[b], both)
                a, b = a[ok & ~again], b[ok & ~again]
                np.add.at(links, a, n[b])
                np.add.at(links, b, n[a])
                root = _joined(root, a, b)
            got = np.flatnonzero(links)
            tied = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([np.zeros(len(got), np.int32), np.ones(len(tied), np.int32)])), pa.array(np.concatenate([cid[got], cid[tied]])), pa.array(np.concatenate([links[got], cid[root[tied]]]))],
                names=["what", "a", "b"],
            )

    return run


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """root (of each node the smallest of its component) after the links a, b."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        x, y = x[apart], y[apart]
        new = root.copy()
        low = np.minimum(x, y)
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        while (new[new] != new).any():
            new = new[new]
        root = new


def _tasks(dealt: DataFrame, block_rows: int) -> DataFrame:
    """The dealt classes once for each task of theirs: task, side (0: left, 1: right, 2: both), and the class.

    A cell with so many residents and guests has so many blocks of either; residents meet residents and guests.
    """
    blocks = dealt.groupBy("cell").agg(
        F.ceil(F.sum(F.when(F.col("cell") == F.col("home"), 1).otherwise(0)) / block_rows).cast("int").alias("nr"),
        F.ceil(F.sum(F.when(F.col("cell") != F.col("home"), 1).otherwise(0)) / block_rows).cast("int").alias("ng"),
    )
    rows = dealt.join(F.broadcast(checkpointed(blocks.filter("nr > 0"))), "cell")  # a row a cell: MOST_CELLS at most
    at = F.pmod(F.xxhash64("cid"), F.when(F.col("cell") == F.col("home"), F.col("nr")).otherwise(F.col("ng"))).cast("int")
    rows = rows.withColumn("at", at)
    pair = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    every = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    mine = F.transform(
        every(F.col("nr")),
        lambda o: F.when(o == F.col("at"), pair(o, o, F.lit(2))).when(o < F.col("at"), pair(o, F.col("at"), F.lit(1))).otherwise(pair(F.col("at"), o, F.lit(0))),
    )
    hosts = F.transform(every(F.col("ng")), lambda g: pair(F.col("at"), F.col("nr") + g, F.lit(0)))
    guests = F.transform(every(F.col("nr")), lambda r: pair(r, F.col("nr") + F.col("at"), F.lit(1)))
    rows = rows.withColumn("p", F.explode(F.when(F.col("cell") == F.col("home"), F.concat(mine, hosts)).otherwise(guests)))
    task = F.shiftleft(F.col("cell").cast("long"), 50) + F.shiftleft(F.col("p.i").cast("long"), 25) + F.col("p.j")
    return rows.select(task.alias("task"), F.col("p.side").alias("side"), "cell", "home", "near", "cid", "n", "e")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, deviations: float | None = DEVIATIONS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per row of vectors (vec_id, embedding): vec_id, n_links, component_id, kept.

    Two rows link when the cosine of their vectors, in double precision, is ``threshold`` or more. n_links counts the other
    rows linked to a row, its equals included; component_id is the smallest vec_id reachable by links; kept marks the row
    that has it. Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors
    of different lengths with each other. A row without vec_id links as any other; its component has the smallest id there
    is in it (null if none), and it isn't kept. Repeated rows are rows of their own, all kept where one is. Other columns
    are ignored. An empty table gives an empty result.
    """
    bounded_batches(vectors.sparkSession)
    e = F.transform(F.col("embedding"), lambda x: x.cast("double") + F.lit(0.0))
    rows = checkpointed(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(_valid(e), e).alias("e")).withColumn("h", F.xxhash64("e")))
    alone = rows.filter("e IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    classes = rows.filter("e IS NOT NULL").groupBy("h", "e").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("n"))
    classes = checkpointed(classes.withColumn("cid", F.monotonically_increasing_id()))
    many, width = classes.agg(F.count(F.lit(1)), F.max(F.size("e"))).first()
    if not many:
        return _kept(alone)
    spark = vectors.sparkSession
    centre = spark.sparkContext.broadcast(centres(classes, width, many))
    half = math.sqrt(max(0.0, 2 - 2 * threshold)) / 2
    reach = half if deviations is None else half * min(1.0, deviations / math.sqrt(width))
    dealt = checkpointed(classes.mapInArrow(_dealt(centre, width, reach), "cell int, home int, near array<int>, cid long, n long, e array<double>"))
    tasks = _tasks(dealt, block_rows).repartition("task").sortWithinPartitions("task")
    found = checkpointed(tasks.mapInArrow(_links(threshold, width), "what int, a long, b long"))
    links = found.filter("what = 0").groupBy(F.col("a").alias("cid")).agg(F.sum("b").alias("links"))
    label = components(found.filter("what = 1").select("a", "b")).select(F.col("node").alias("cid"), "component")
    each = classes.select("h", "e", "cid", "low", "n").join(links, "cid", "left").join(label, "cid", "left")
    each = checkpointed(each.select("h", "e", "low", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "cid").alias("component")))
    least = checkpointed(each.groupBy("component").agg(F.min("low").alias("component_id")))
    each = checkpointed(each.join(least, "component").select("h", F.col("e").alias("_e"), "n_links", "component_id"))
    linked = rows.join(each.withColumnRenamed("h", "_h"), (F.col("h") == F.col("_h")) & (F.col("e") == F.col("_e")))
    return _kept(linked.select("vec_id", "n_links", "component_id").unionByName(alone))


def _kept(rows: DataFrame) -> DataFrame:
    return rows.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
ok AS (SELECT * FROM v WHERE len(e) > 0 AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a, ok b WHERE a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id, vec_id AS to_id FROM embeddings UNION SELECT r.vec_id, p.b FROM r JOIN p ON p.a = r.to_id),
c AS (SELECT vec_id, min(to_id) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM p GROUP BY a)
SELECT c.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""
