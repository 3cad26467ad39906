"""Substring dedup: super-k-mer partitioning of word windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repeats
from . import textkernel as tk
from .common import keyed, read_table

WINDOW_WORDS = 35
MINIMISER_WORDS = 8


def sorted_windows(payloads: list[bytes], first, last, at, anchor, window: int):
    """Windows of the packed word runs that occur twice or more, found by sorting them.

    Words become exact ids; windows are sorted by a hash of their ids, and neighbours are compared id by id.
    Should two different windows share a hash, exact ranks by prefix doubling replace the hash.
    """
    text = pa.array(payloads, pa.binary()).cast(pa.string())
    split = pc.split_pattern_regex(text, "[ \t\n\x0b\x0c\r]+")
    ids = split.flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
    n_words = np.diff(np.asarray(split.offsets))
    begin = np.concatenate([[0], np.cumsum(n_words)[:-1]])
    n = (last - first + 1).astype(np.int64)
    pay = np.repeat(np.arange(len(n)), n)
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    pos = begin[pay] + within
    key = tk.gram_hashes(tk.mix(ids.astype(np.uint64) + np.uint64(1)), window)[pos]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    a, b = pos[order[:-1]][same], pos[order[1:]][same]
    if not all((ids[a + j] == ids[b + j]).all() for j in range(window)):
        key = _ranks(ids, window)[pos]
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(pos), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = twice.copy()
    edge[1:] &= ~(twice[:-1] & (pay[1:] == pay[:-1]))
    start = np.flatnonzero(edge)
    stop = twice.copy()
    stop[:-1] &= ~(twice[1:] & (pay[1:] == pay[:-1]))
    end = np.flatnonzero(stop)
    return pay[start], first[pay[start]] + within[start], end - start + 1


def _ranks(ids: np.ndarray, window: int) -> np.ndarray:
    """Exact names of all runs of ``window`` ids, by prefix doubling."""
    out, have, done, rank = None, 1, 0, np.unique(ids, return_inverse=True)[1].astype(np.int64)
    while True:
        if window & have:
            part = rank[done:] if out is None else rank[done : done + len(out)]
            m = len(part) if out is None else min(len(out), len(part))
            out = part.copy() if out is None else np.unique(out[:m] * (int(rank.max(initial=0)) + 1) + part[:m], return_inverse=True)[1].astype(np.int64)
            done += have
        have *= 2
        if have > window:
            return out
        half = have // 2
        rank = np.unique(rank[:-half] * (int(rank.max(initial=0)) + 1) + rank[half:], return_inverse=True)[1].astype(np.int64)


def unit(window: int = WINDOW_WORDS, k: int = MINIMISER_WORDS) -> repeats.Unit:
    return repeats.Unit(window, min(k, window), repeats.word_units, lambda pay, s, e, p, a: sorted_windows(pay, s, e, p, a, window))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tk.chunks(batch):
            buf, off = tk.raw(part.column("text"))
            s, e, bounds = tk.words(buf, off)
            so, start, length = repeats.span_rows(part)
            data, texts, gone = buf.tobytes(), [], []
            for i in range(part.num_rows):
                a, b = int(bounds[i]), int(bounds[i + 1])
                drop = tk.cover(b - a, start[so[i] : so[i + 1]], length[so[i] : so[i + 1]])
                keep = a + np.flatnonzero(~drop)
                texts.append(b" ".join([data[x:y] for x, y in zip(s[keep].tolist(), e[keep].tolist(), strict=True)]))
                gone.append(b - a - len(keep))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(bounds), pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_text"],
            )


def remove_repeated_words(docs: DataFrame, window: int = WINDOW_WORDS, minimiser: int = MINIMISER_WORDS, hot_limit: int = repeats.HOT_LIMIT) -> DataFrame:
    """Remove every word that lies in a window of ``window`` words which also starts elsewhere in the table.

    Returns one row per input row: doc_id, n_words, n_removed, kept_text (kept words joined by one space).
    Null text: no words. Null doc_id: a row like any other. Repeated rows repeat each other's windows. Texts
    shorter than a window keep all words. Other columns are ignored. An empty table gives an empty result.
    Both copies of a repeated window go: windows are judged on the input.
    """
    rows = keyed(docs)
    spans = repeats.repeated_spans(rows, unit(window, minimiser), hot_limit)
    return repeats.with_spans(rows, spans).mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept_text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_words(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
dup AS (SELECT doc_id, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT doc_id, list(DISTINCT j) AS js FROM (SELECT doc_id, unnest(range(i, i + 35)) AS j FROM dup) GROUP BY doc_id),
kept AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(js), 0)::BIGINT AS n_removed,
  array_to_string(CASE WHEN js IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(js, i)) END, ' ') AS t FROM w LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(t) AS kept_sha256 FROM kept
"""
