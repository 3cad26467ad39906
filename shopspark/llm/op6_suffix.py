"""Suffix-array dedup: repeated byte strings, found by sorting suffixes with their common prefixes in shards.

The table's suffixes are dealt to shards by the minimiser of their first 200 bytes; Spark's sort shuffle, which spills to
disk, is the queue between texts and shards. A shard's kernel takes whole minimisers, a few MB at a time. It sorts the
suffixes that start at the minimisers by refining ranks of 8-byte blocks, with their common prefixes; every other suffix of
the shard is one byte longer than one already in order, so each round derives the next order from the last one by a stable
pass over the preceding byte, and its common prefixes by range minima. This is not external induced sorting: ranks are
refined in memory, nothing recurses over names, and no queue holds every suffix of the table (README says why).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repeats
from . import textkernel as tk
from .common import keyed, read_table

LENGTH = 200
MINIMISER_BYTES = 32


def _sampled_order(data: np.ndarray, at: np.ndarray, avail: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``at`` by their first avail bytes, and each one's common prefix with the one before."""
    n = len(at)
    order = np.argsort(avail, kind="stable")  # of equal contents, the shorter first
    lcp = np.zeros(n, np.int64)
    cls = np.zeros(n, np.int64)
    act = np.arange(n)
    view = np.ndarray((len(data) - 7,), ">u8", data.tobytes(), strides=(1,))
    for j in range(0, depth, 8):
        if not len(act):
            break
        el = order[act]
        rem = avail[el] - j
        key = view[np.minimum(at[el] + j, len(view) - 1)].astype(np.uint64)
        shift = np.clip(8 - rem, 0, 7).astype(np.uint64) * np.uint64(8)
        key = np.where(rem <= 0, np.uint64(0), key >> shift << shift)
        o = np.lexsort((key, cls[act]))
        order[act] = el[o]
        key = key[o]
        split = np.flatnonzero((cls[act[1:]] == cls[act[:-1]]) & (key[1:] != key[:-1])) + 1
        x = key[split] ^ key[split - 1]
        common = np.zeros(len(split), np.int64)
        for b in range(1, 8):
            common += x < np.uint64(1 << (64 - 8 * b))
        lcp[act[split]] = j + common
        edge = np.zeros(n, np.int64)
        edge[1:] = cls[1:] != cls[:-1]
        edge[act[split]] = 1
        cls = np.cumsum(edge)
        size = np.bincount(cls)
        act = np.flatnonzero(size[cls] > 1)
    tied = np.flatnonzero(cls[1:] == cls[:-1]) + 1
    lcp[tied] = depth
    lcp[1:] = np.minimum(lcp[1:], np.minimum(avail[order[1:]], avail[order[:-1]]))
    return order, lcp


def induced_windows(payloads: list[bytes], first, last, at, anchor, window: int, k: int):
    """Windows of the packed byte runs that occur twice or more, by induced sorting from their minimisers."""
    size = np.array([len(x) for x in payloads], np.int64)
    begin = np.cumsum(size) - size
    data = np.frombuffer(b"".join([*payloads, b"\0" * 8]), np.uint8)
    d_max, d_min = (at - first).astype(np.int64), (at - last).astype(np.int64)
    pos = begin + d_max
    avail = window - d_min
    el, lcp = _sampled_order(data, pos, avail, window)
    cls = np.cumsum(lcp < k)  # a different minimiser
    found = np.zeros((len(payloads), int((last - first).max(initial=0)) + 2), bool)
    for d in range(window - k + 1):
        keep = np.zeros(len(el), bool)
        same = cls[1:] == cls[:-1]
        keep[1:] = same
        keep[:-1] |= same
        if not keep.any():
            break
        hit = np.flatnonzero(same & (lcp[1:] >= window - d)) + 1
        for x in (el[hit], el[hit - 1]):
            found[x, d_max[x] - d] = True
        old = np.flatnonzero(keep & (d_max[el] > d))
        if not len(old):
            break
        key = cls[old] * 256 + data[pos[el[old]] - d - 1]
        if (key[1:] < key[:-1]).any():
            o = np.argsort(key, kind="stable")
            old, key = old[o], key[o]
        a, b = old[:-1], old[1:]
        new = np.zeros(len(old), np.int64)
        new[1:] = lcp[b]
        far = np.flatnonzero((key[1:] == key[:-1]) & (b != a + 1))
        if len(far):
            pairs = np.stack([a[far] + 1, b[far] + 1], 1).reshape(-1)
            new[far + 1] = np.minimum.reduceat(np.append(lcp, 0), pairs)[::2]
        el, lcp = el[old], new
        cls = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
    a, b = tk.runs_of(found.reshape(-1))
    row, col = np.divmod(a, found.shape[1])
    return row, first[row] + col, b - a


def unit(window: int = LENGTH, k: int = MINIMISER_BYTES) -> repeats.Unit:
    k = min(k, window)
    return repeats.Unit(window, k, repeats.byte_units, lambda pay, s, e, p, a: induced_windows(pay, s, e, p, a, window, k))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tk.chunks(batch):
            buf, off = tk.raw(part.column("text"))
            so, start, length = repeats.span_rows(part)
            rest, gone, runs = [], [], []
            for i in range(part.num_rows):
                own = buf[off[i] : off[i + 1]]
                drop = tk.cover(len(own), start[so[i] : so[i + 1]], length[so[i] : so[i + 1]]) if so[i] < so[i + 1] else np.zeros(len(own), bool)
                gone.append(int(drop.sum()))
                runs.append(len(tk.runs_of(drop)[0]))
                rest.append(own[~drop].tobytes())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(off), pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(rest, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )


def remove_repeated_bytes(docs: DataFrame, length: int = LENGTH, minimiser: int = MINIMISER_BYTES, hot_limit: int = repeats.HOT_LIMIT) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts elsewhere in the table.

    Returns one row per input row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (binary:
    a cut may fall inside a UTF-8 character). Null text: empty. Null doc_id: a row like any other. Repeated
    rows repeat each other's strings. Matches never cross rows; strings are judged on the input. Texts shorter
    than ``length`` stay whole. Other columns are ignored. An empty table gives an empty result.
    """
    rows = keyed(docs)
    spans = repeats.repeated_spans(rows, unit(length, minimiser), hot_limit)
    return repeats.with_spans(rows, spans).mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_bytes(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 400)) AS m FROM (SELECT doc_id, x, unnest(range(0, strlen(x) // 2 - 199)) AS i FROM h)),
dup AS (SELECT doc_id, i FROM win WHERE m IN (SELECT m FROM win GROUP BY m HAVING count(*) > 1)),
run AS (SELECT doc_id, i, max(i + 200) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM dup),
isl AS (SELECT doc_id, i, sum((reach IS NULL OR i > reach)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM run),
gone AS (SELECT doc_id, g, min(i) AS a, max(i) + 200 AS b FROM isl GROUP BY doc_id, g),
gaps AS (SELECT doc_id, b AS a, lead(a, 1, 2147483647) OVER (PARTITION BY doc_id ORDER BY a) AS b, a AS ord FROM gone
  UNION ALL SELECT doc_id, 0, min(a), -1 FROM gone GROUP BY doc_id),
kept AS (SELECT g.doc_id, string_agg(substr(x, (2 * g.a + 1)::BIGINT, (2 * (g.b - g.a))::BIGINT), '' ORDER BY ord) AS k FROM gaps g JOIN h ON h.doc_id = g.doc_id GROUP BY g.doc_id),
sums AS (SELECT doc_id, sum(b - a)::BIGINT AS n, count(*)::BIGINT AS c FROM gone GROUP BY doc_id)
SELECT h.doc_id, (strlen(x) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(c, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(k, x))) AS kept_sha256
FROM h LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
