"""LM scoring: Brown class-based bigrams with exchange clustering.

p(w | v) = p(class(w) | class(v)) * p(w | class(w)). All counts are taken over the whole training corpus in Spark.

Words with at least HEAD_SHARE of the training tokens (there can be at most 1 / HEAD_SHARE of them, however large
the corpus) are clustered: starting from frequency order, each round counts every word's left and right
neighbour classes over the corpus and exchanges words one after the other into the class that raises the
class bigram likelihood most. Rarer words fall into classes by their ending and length, keep their own
exact counts as emissions, and reach their documents by a join instead of a broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import checkpointed, held_out, keyed, read_table

HEAD_SHARE = 2e-5
#: Words with at least this share of the training tokens have their counts in every task; at most 1 / KNOWN_SHARE do.
KNOWN_SHARE = 1e-6
CLASSES, RARE, ROUNDS = 48, 16, 4
#: Weight of the class bigram against the class unigram.
BIGRAM = 0.95
#: A task counts words exactly in memory up to so many tokens before it hands them on.
FLUSH = 2_000_000
END = np.int64((1 << 62) | 1)


def _kinds() -> np.ndarray:
    """A kind for each last byte: vowel, other letter, digit, stop mark, other mark, non-ASCII ..., 0 to 7."""
    kind = np.full(256, 5, np.int64)
    kind[128:] = 7
    for chars, k in ((b"aeiou", 0), (b"bcdfghjklmpqvwxyz", 1), (b"nrst", 2), (b"0123456789", 3), (b".!?;:", 4), (b",", 6)):
        kind[list(chars)] = k
    return kind


_KIND = _kinds()


def token_ids(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all tokens (words and one end per text) and the bounds of each text; the low 4 bits are the rare class."""
    buf = tk.LOWER[buf]
    s, e, bounds = tk.words(buf, off)
    h = (tk.span_hashes(buf, s, e) >> np.uint64(2)).view(np.int64) & ~np.int64(RARE - 1)
    if len(s):
        h |= _KIND[buf[e - 1]] * 2 + (e - s > 7)
    n = np.diff(bounds)
    out = np.full(len(h) + len(n), END, np.int64)
    out[np.arange(len(h)) + np.repeat(np.arange(len(n)), n)] = h
    return out, bounds + np.arange(len(bounds))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def flush():
        w, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(w), pa.array(n.astype(np.int64))], names=["w", "n"])

    for batch in batches:
        for part in tk.chunks(batch):
            ids, _ = token_ids(*tk.raw(part.column("text")))
            held.append(ids)
            size += len(ids)
            if size >= FLUSH:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


class Head:
    """Words that every task knows, sorted by id, with their counts. Units number what the clustering sees:
    clustered words (counts of at least ``least``) first, then the rare classes.
    """

    def __init__(self, words: np.ndarray, counts: np.ndarray, least: float):
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]
        clustered = self.counts >= least
        self.size = int(clustered.sum())
        self.unit_of = np.where(clustered, np.cumsum(clustered) - 1, self.size + (self.words & (RARE - 1)))
        self.unit_counts = self.counts[clustered]

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each id, and whether it is known."""
        if not len(self.words):
            return np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
        at = np.minimum(np.searchsorted(self.words, ids), len(self.words) - 1)
        return at, self.words[at] == ids

    def unit(self, ids: np.ndarray) -> np.ndarray:
        at, known = self.find(ids)
        other = self.size + (ids & (RARE - 1))
        return np.where(known, self.unit_of[at], other) if len(self.words) else other


def _encode(head: Head):
    """Unit sequences of the training texts, each text after an end token's context, as packed 16-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.chunks(batch):
                ids, _ = token_ids(*tk.raw(part.column("text")))
                seq = head.unit(np.concatenate([[END], ids])).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([pa.array([seq.tobytes()], pa.binary())], names=["seq"])

    return run


def _neighbours(cls: np.ndarray, n_classes: int):
    """Per unit and class: how often the class comes right before (side 0) and right after it (side 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(cls) * n_classes
        n = np.zeros((2, m), np.int64)
        for batch in batches:
            for x in batch.column("seq"):
                u = np.frombuffer(x.as_buffer(), np.uint16).astype(np.int64)
                c = cls[u]
                n[0] += np.bincount(u[1:] * n_classes + c[:-1], minlength=m)
                n[1] += np.bincount(u[:-1] * n_classes + c[1:], minlength=m)
        side, key = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(side.astype(np.int32)), pa.array(key), pa.array(n[side, key])], names=["side", "key", "n"])

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(cls: np.ndarray, left: np.ndarray, right: np.ndarray, movable: np.ndarray, classes: int) -> np.ndarray:
    """One exchange pass: each movable unit goes to the class (below ``classes``) that raises the likelihood most."""
    k = left.shape[1]
    big = np.zeros((k, k))
    np.add.at(big, cls, right)
    before, after = big.sum(1), big.sum(0)
    cls = cls.copy()
    for w in movable:
        l, r, a = left[w].astype(float), right[w].astype(float), cls[w]
        big[a] -= r
        big[:, a] -= l
        np.maximum(big, 0, out=big)
        before[a] -= r.sum()
        after[a] -= l.sum()
        gain = (_xlogx(big[:classes] + r) - _xlogx(big[:classes])).sum(1) + (_xlogx(big[:, :classes] + l[:, None]) - _xlogx(big[:, :classes])).sum(0)
        b, f = np.maximum(before[:classes], 0), np.maximum(after[:classes], 0)
        gain -= _xlogx(b + r.sum()) - _xlogx(b) + _xlogx(f + l.sum()) - _xlogx(f)
        to = int(np.argmax(gain))
        cls[w] = to
        big[to] += r
        big[:, to] += l
        before[to] += r.sum()
        after[to] += l.sum()
    return cls


class BrownModel:
    """Everything a task needs to score: head words with counts and classes, class transitions, rare-class totals."""

    def __init__(self, head: Head, cls, pair, total, types, rare_n, rare_v, n_classes):
        self.head, self.cls, self.total, self.types = head, cls, total, types
        unigram = (pair.sum(0) + 1) / (pair.sum() + n_classes)
        own = pair.sum(1, keepdims=True)
        self.trans = np.log10(BIGRAM * np.where(own > 0, pair / np.maximum(own, 1), unigram) + (1 - BIGRAM) * unigram)
        word_class = cls[head.unit_of]
        of_class = np.bincount(cls[: head.size], weights=head.unit_counts, minlength=n_classes)
        rare = -np.log10(rare_n + rare_v + 1)  # plus log10(c + 1); unknown words have c = 0
        is_rare = head.unit_of >= head.size
        self.emit = np.where(is_rare, np.log10(head.counts + 1) + rare[head.words & (RARE - 1)], np.log10(head.counts / np.maximum(of_class[word_class], 1)))
        self.rare, self.rare_base = rare, -np.log10(total + types + 1)
        self.base = np.log10(head.counts + 1) + self.rare_base

    def score(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = self.head
        start = self.cls[h.unit(np.array([END]))[0]]
        for batch in batches:
            for part in tk.chunks(batch):
                ids, bounds = token_ids(*tk.raw(part.column("text")))
                at, known = h.find(ids)
                at = at[known]
                unit = h.size + (ids & (RARE - 1))
                unit[known] = h.unit_of[at]
                c = self.cls[unit]
                prev = np.concatenate([[start], c[:-1]])
                prev[bounds[:-1]] = start
                score, base = self.trans[prev, c], np.full(len(ids), self.rare_base)
                score[known] += self.emit[at]
                base[known] = self.base[at]
                other = np.flatnonzero(~known)
                score[other] += self.rare[ids[other] & (RARE - 1)]
                n, n_other = np.diff(bounds), np.diff(np.searchsorted(other, bounds))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n), pa.array(n - n_other), pa.array(np.add.reduceat(base, bounds[:-1])), pa.array(np.add.reduceat(score, bounds[:-1])), tk.lists(pa.array(ids[other]), n_other)],
                    names=["doc_id", "n_tokens", "n_head", "base", "score", "others"],
                )


def train(docs: DataFrame, head_share: float = HEAD_SHARE, known_share: float = KNOWN_SHARE, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[BrownModel, DataFrame]:
    """The model of all texts of docs (keyed), and the table of their word counts (w, n)."""
    counts = checkpointed(docs.select("text").mapInArrow(_count_words, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")))
    total, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    top = counts.filter(F.col("n") >= known_share * total).toArrow()
    head = Head(top.column("w").to_numpy(), top.column("n").to_numpy(), head_share * total)
    rare = counts.filter(F.col("n") < head_share * total).groupBy(F.col("w").bitwiseAND(RARE - 1).alias("c")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    rare_n, rare_v = np.zeros(RARE), np.zeros(RARE)
    for r in rare:
        rare_n[r["c"]], rare_v[r["c"]] = r["n"], r["v"]
    k = classes + RARE
    by_count = np.argsort(-head.unit_counts, kind="stable")
    cls = np.concatenate([np.zeros(head.size, np.int64), classes + np.arange(RARE)])
    cls[by_count] = np.arange(head.size) % classes
    pair = np.zeros((k, k))
    seqs = checkpointed(docs.select("text").mapInArrow(_encode(head), "seq binary"))
    for t in range(rounds):
        # At most 2 * (1 / head_share + RARE) * k rows come back, whatever the corpus.
        got = seqs.mapInArrow(_neighbours(cls, k), "side int, key long, n long").groupBy("side", "key").agg(F.sum("n").alias("n")).toArrow()
        n = np.zeros((2, len(cls) * k))
        n[got.column("side").to_numpy(), got.column("key").to_numpy()] = got.column("n").to_numpy()
        left, right = n.reshape(2, len(cls), k)
        pair[:] = 0
        np.add.at(pair, cls, right)
        if t + 1 < rounds:
            cls = exchange(cls, left, right, by_count, classes)
    return BrownModel(head, cls, pair, total, types, rare_n, rare_v, k), counts


def score_texts(docs: DataFrame, training=None, head_share: float = HEAD_SHARE, known_share: float = KNOWN_SHARE, classes: int = CLASSES, rounds: int = ROUNDS) -> DataFrame:
    """Log10 probabilities of every text under a unigram base and a Brown class bigram model.

    training: condition on doc_id for the rows to learn from (default: all). Returns doc_id, n_tokens, n_known,
    train_tokens, base_score, score and perplexity per input row. Tokens are the words after lower-casing A-Z and
    one end per text. Null text is empty: its end is its only token. Null doc_id: scored; it is learnt from as the
    condition says. Repeated rows count as often as they stand there and get equal scores. Without training rows
    every word is an unknown one. Other columns are ignored. An empty table gives an empty result. Words are told
    apart by 58-bit hashes.
    """
    rows = keyed(docs)
    model, counts = train(rows if training is None else rows.filter(training), head_share, known_share, classes, rounds)
    scored = rows.mapInArrow(model.score, "doc_id long, n_tokens long, n_head long, base double, score double, others array<long>")
    scored = checkpointed(scored.withColumn("row", F.monotonically_increasing_id()))  # stable once written
    others = scored.select("row", F.explode("others").alias("w")).join(counts.filter(F.col("n") < known_share * model.total), "w")
    more = others.groupBy("row").agg(F.count(F.lit(1)).alias("n_more"), F.sum(F.log10(F.col("n") + 1)).alias("more"))
    gain = F.coalesce("more", F.lit(0.0))
    out = scored.drop("others").join(more, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_head") + F.coalesce("n_more", F.lit(0))).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), (F.col("base") + gain).alias("base_score"), (F.col("score") + gain).alias("score")
    )
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = score_texts(docs, ~held_out(F.col("doc_id"), 7, 2))
    return out.select("doc_id", held_out(F.col("doc_id"), 7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
