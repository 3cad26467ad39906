"""Quality classifier: naive Bayes support vectors over hashed byte n-gram indicators.

A text's features are the distinct byte n-grams that it holds, hashed to a fixed number of slots, each scaled by
the log-count ratio of its slot between the classes (naive Bayes, counted in Spark over all labelled training
rows). A linear hinge-loss model is fitted to the scaled, length-normalised indicators by dual coordinate
descent, on at most FIT_ROWS labelled rows; a logistic curve fitted to the margins of rows that the
descent didn't see turns margins into scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import held_out, maybe_broadcast, read_table, released

NGRAM, SLOTS = 4, 1 << 16
#: The hinge-loss fit takes at most so many labelled training rows (those with the smallest id hashes), a quarter of them for calibration.
FIT_ROWS = 8000
#: ... of at most so many features together, so that very long texts fit into the task that learns.
FIT_SLOTS = 24_000_000
EPOCHS, COST, SMOOTHING = 12, 1.0, 1.0
#: A text is kept when its score is at least this.
THRESHOLD = 0.3


def indicators(batch: pa.RecordBatch, column: str = "text") -> Iterator[np.ndarray]:
    """The distinct slots of each text; a text shorter than an n-gram has its whole as the only one."""
    seen = np.zeros(SLOTS, bool)
    for part in tk.chunks(batch, column):
        buf, off = tk.raw(part.column(column))
        wide = np.concatenate([buf, np.zeros(NGRAM, np.uint8)])
        code = np.zeros(len(buf), np.uint32)
        for j in range(NGRAM):
            code = code * np.uint32(257) + wide[j : j + len(buf)]
        slot = ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int32)
        for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            own = slot[a : max(b - NGRAM + 1, a + (b > a))]
            seen[own] = True
            got = np.flatnonzero(seen)
            seen[got] = False
            yield got


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros((2, SLOTS), np.int64)
    for batch in batches:
        for y, got in zip(batch.column("y").to_pylist(), indicators(batch), strict=True):
            n[y, got] += 1
    some = np.flatnonzero(n.sum(0))
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[0, some]), pa.array(n[1, some])], names=["slot", "n0", "n1"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [x.astype(np.uint16).tobytes() for x in indicators(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("y"), pa.array(got, pa.binary())], names=["k", "y", "slots"])


def dual_coordinate_descent(rows: list[np.ndarray], scale: list[np.ndarray], y: np.ndarray, cost: np.ndarray, epochs: int, dim: int) -> tuple[np.ndarray, float]:
    """L2-regularised hinge loss: min w.w/2 + sum cost_i max(0, 1 - y_i (w.x_i + b)); rows are slots, scale their values."""
    w, b = np.zeros(dim), 0.0
    alpha = np.zeros(len(rows))
    norm = np.array([float(v @ v) + 1.0 for v in scale])
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            g = y[i] * (w[rows[i]] @ scale[i] + b) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), cost[i])
            if (d := (new - alpha[i]) * y[i]) != 0:
                w[rows[i]] += d * scale[i]
                b += d
                alpha[i] = new
    return w, b


def _logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve of y over m (Newton steps, lightly regularised)."""
    x = np.stack([m, np.ones_like(m)], 1)
    t = np.zeros(2)
    target = np.where(y > 0, (np.sum(y > 0) + 1) / (np.sum(y > 0) + 2), 1 / (np.sum(y < 0) + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(2) * 1e-3
        step = np.linalg.solve(h, x.T @ (target - p) - 1e-3 * t)
        t += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(t[0]), float(t[1])


class QualityModel:
    """Weights per slot, log-count ratios, and the curve from margin to score. A few hundred KB, whatever the table's size."""

    def __init__(self, ratio, w, b, slope, offset):
        self.ratio, self.wr, self.b, self.slope, self.offset = ratio, w * ratio, b, slope, offset

    def margins(self, sets) -> np.ndarray:
        square = self.ratio**2
        return np.array([self.wr[x].sum() / max(np.sqrt(square[x].sum()), 1e-9) + self.b for x in sets])

    def column(self, text):
        """Score column (0 to 1) of a text column."""
        model = self

        @F.arrow_udf("double")
        def score(t: pa.Array) -> pa.Array:
            batch = pa.RecordBatch.from_arrays([t.fill_null("")], names=["text"])
            m = model.margins(indicators(batch))
            return pa.array(1 / (1 + np.exp(-np.clip(model.slope * m + model.offset, -30, 30))))

        return score(F.coalesce(text.cast("string"), F.lit("")))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> QualityModel:
    """Fit on the labelled rows of docs whose crc32(doc_id) mod 5 isn't 0.

    Rows with conflicting or null labels teach nothing. Without labels of both classes the score is the share of 1
    (1 without any label). The log-count ratios take all labelled rows, the hinge fit at most ``fit_rows`` (those with the least hash
    of their id), and of these as many as have FIT_SLOTS features together.
    """
    y = labels.filter("quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("y"), F.max("quality").alias("z")).filter("y = z").select(F.col("doc_id").alias("_id"), "y")
    y = y.filter(~held_out(F.col("_id"), 5, 0))
    text = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = text.join(maybe_broadcast(y), "_id").select("_id", "y", "text")
    total = rows.select("y", "text").mapInArrow(released(_counts), "slot int, n0 long, n1 long").groupBy("slot").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    n = np.zeros((2, SLOTS))
    n[0, total.column("slot").to_numpy()], n[1, total.column("slot").to_numpy()] = total.column("n0").to_numpy(), total.column("n1").to_numpy()
    p = n + SMOOTHING
    ratio = np.log(p[1] / p[1].sum()) - np.log(p[0] / p[0].sum())
    size = y.groupBy("y").count().toPandas().set_index("y")["count"]
    rare = min(size.get(0, 0), size.get(1, 0))
    if not rare:
        share = (size.get(1, 0) + 1e-9) / (size.sum() + 1e-9) if len(size) else 1.0
        return QualityModel(ratio, np.zeros(SLOTS), 0.0, 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    chosen = F.broadcast(y.orderBy(F.xxhash64("_id"), "_id").limit(fit_rows).select("_id"))
    sample = rows.join(chosen, "_id").select(F.xxhash64("_id").alias("k"), "y", "text").mapInArrow(released(_features), "k long, y int, slots binary")
    got = sample.repartition(1).sortWithinPartitions("k", "y", "slots").mapInArrow(released(_train(ratio)), "w binary, b double, slope double, offset double").toArrow().to_pylist()
    if not got:  # labels of both classes, but of no row of docs
        return QualityModel(ratio, np.zeros(SLOTS), 0.0, 0.0, 0.0)
    got = got[0]
    return QualityModel(ratio, np.frombuffer(got["w"]), got["b"], got["slope"], got["offset"])


class _Scaled:
    """The length-normalised ratios of sets of slots, made when they are asked for: a sample's sets take two bytes a feature."""

    def __init__(self, sets: list[np.ndarray], ratio: np.ndarray):
        self.sets, self.ratio = sets, ratio

    def of(self, some: np.ndarray) -> _Scaled:
        return _Scaled([self.sets[i] for i in some], self.ratio)

    def __getitem__(self, i: int) -> np.ndarray:
        v = self.ratio[self.sets[i]]
        return v / max(np.sqrt(v @ v), 1e-9)

    def __iter__(self) -> Iterator[np.ndarray]:
        return (self[i] for i in range(len(self.sets)))


def _train(ratio: np.ndarray):
    """The hinge fit of a bounded sample (at most FIT_ROWS rows and FIT_SLOTS slots), in one task, and the curve from margin to score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, y, total = [], [], 0
        for batch in batches:
            for one, slots in zip(batch.column("y").to_pylist(), batch.column("slots").to_pylist(), strict=True):
                total += len(slots) // 2
                if total <= FIT_SLOTS:
                    sets.append(np.frombuffer(slots, np.uint16))
                    y.append(one)
        label = np.where(np.array(y) > 0, 1.0, -1.0)
        scaled = _Scaled(sets, ratio)
        pick = np.random.default_rng(1).random(len(sets)) < 0.75 if len(sets) >= 40 else np.ones(len(sets), bool)
        use = np.flatnonzero(pick)
        cost = np.where(label > 0, COST * len(label) / 2 / max((label > 0).sum(), 1), COST * len(label) / 2 / max((label < 0).sum(), 1))
        w, b = dual_coordinate_descent([sets[i] for i in use], scaled.of(use), label[use], cost[use], EPOCHS, SLOTS)
        rest = np.flatnonzero(~pick) if (~pick).sum() >= 10 else use
        slope, offset = _logistic(QualityModel(ratio, w, b, 0.0, 0.0).margins([sets[i] for i in rest]), label[rest])
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([b]), pa.array([slope]), pa.array([offset])], names=["w", "b", "slope", "offset"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold) per input row.

    Only texts enter a score. Null or empty text is scored from no features. Null doc_id: scored, never learnt from.
    Repeated rows get equal scores. Other columns are ignored. An empty table gives an empty result.
    """
    score = fit(docs, labels, fit_rows).column(F.col("text"))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score.alias("score"))
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose score reaches the threshold; order, ids and repeated rows stay as they are.

    Null and empty texts get the score of a text without features, like score_quality(); null ids count as the text '' for the
    held-out share and are judged like others. Without any label every row scores about 1 and stays (see fit()). An empty table
    gives an empty result. Columns named like those of the model are no input and pass unchanged.
    """
    return docs.filter(fit(docs, labels).column(F.col("text")) >= threshold)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
