"""Exact removal of repeated windows of a text table: the part that word windows and byte windows share.

1. Every text is cut into super-windows: consecutive windows whose minimiser stands at the same place.
   Equal windows have equal minimisers, so only windows under one minimiser need comparing.
2. Minimisers are counted over the whole table (map-side combine); one that stands at a single place can't
   belong to a repeated window, and its super-windows stop here.
3. The others travel as one packed payload each to the partition of their minimiser, where Spark's
   spilling sort brings equal minimisers together and a kernel counts the windows exactly.
4. A minimiser with more than ``hot_limit`` occurrences never meets in one task: its windows are counted one
   by one under a 128-bit fingerprint, by a two-phase aggregation and a join that AQE can split.
5. The windows found are joined back to the texts, and what they cover is removed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import checkpointed, same_row

#: Occurrences of one minimiser that a task may hold at a time (payloads of some hundred bytes each).
HOT_LIMIT = 65_536
#: Payload bytes that the kernel takes at a time; whole minimisers only.
FLUSH_BYTES = 4 << 20

#: at: first window, windows after it and distance of the minimiser, as 32 + 16 + 16 bits of one number.
HITS = "doc_id long, _h long, anchor long, at long"
PACKED = "doc_id long, _h long, anchor long, at long, payload binary, w1 array<long>, w2 array<long>"
SPANS = "doc_id long, _h long, start int, length int"


@dataclass(frozen=True)
class Unit:
    """How a text is cut. split(buf, off) gives unit byte starts, ends, unit index bounds and unit hashes (or None)."""

    window: int
    k: int
    split: Callable
    kernel: Callable  # (list of payloads, first, last, anchor at) -> (payload index, start, windows)


def word_units(buf, off):
    s, e, b = tk.words(buf, off)
    return s, e, b, tk.span_hashes(buf, s, e)


def byte_units(buf, off):
    return None, None, off, None


def _grams(buf, hashes, k):
    return tk.byte_gram_hashes(buf, k) if hashes is None else tk.gram_hashes(hashes, k)


def _find(unit: Unit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.chunks(batch):
                buf, off = tk.raw(part.column("text"))
                _, _, bounds, hashes = unit.split(buf, off)
                t, s, e, p, h = tk.super_windows(_grams(buf, hashes, unit.k), bounds, unit.window, unit.k)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(t)), part.column("_h").take(pa.array(t)), pa.array(h.view(np.int64)), pa.array((s - bounds[t] << 32) | (e - s << 16) | (p - s))],
                    names=["doc_id", "_h", "anchor", "at"],
                )

    return run


def _pack(unit: Unit):
    """Cut the packed payloads out of the texts; hot super-windows become window fingerprints instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.chunks(batch):
                buf, off = tk.raw(part.column("text"))
                us, ue, bounds, hashes = unit.split(buf, off)
                own = part.column("hits")
                n = np.diff(np.asarray(own.offsets))
                row = np.repeat(np.arange(part.num_rows), n)
                hit = own.flatten()
                anchor, at, hot = (hit.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                s = at >> 32
                e = s + (at >> 16 & 0xFFFF)
                data = buf.tobytes()
                first, last = bounds[row] + s, bounds[row] + e + unit.window
                a, b = (first, last) if us is None else (us[first], ue[last - 1])
                payload = [None if q else data[x:y] for x, y, q in zip(a.tolist(), b.tolist(), hot.tolist(), strict=True)]
                if hot.any():
                    f1 = _grams(buf, hashes, unit.window).view(np.int64)
                    f2 = (tk.byte_gram_hashes(buf[::-1], unit.window)[::-1] if hashes is None else tk.gram_hashes(tk.mix(hashes[::-1] + np.uint64(1)), unit.window)[::-1]).view(np.int64)
                    w1 = [f1[x : y + 1 - unit.window] if q else None for x, y, q in zip(first, last, hot, strict=True)]
                    w2 = [f2[x : y + 1 - unit.window] if q else None for x, y, q in zip(first, last, hot, strict=True)]
                else:
                    w1 = w2 = [None] * len(s)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(row)), part.column("_h").take(pa.array(row)), pa.array(anchor, pa.int64()), pa.array(at, pa.int64()), pa.array(payload, pa.binary()), pa.array(w1, pa.list_(pa.int64())), pa.array(w2, pa.list_(pa.int64()))],
                    names=["doc_id", "_h", "anchor", "at", "payload", "w1", "w2"],
                )

    return run


def _count(unit: Unit):
    """Rows come sorted by minimiser; whole minimisers are gathered up to FLUSH_BYTES and counted."""

    def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        at = table.column("at").to_numpy()
        s = at >> 32
        e, p = s + (at >> 16 & 0xFFFF), s + (at & 0xFFFF)
        i, start, m = unit.kernel(table.column("payload").to_pylist(), s, e, p, table.column("anchor").to_numpy())
        at = pa.array(i)
        return pa.RecordBatch.from_arrays(
            [table.column("doc_id").combine_chunks().take(at), table.column("_h").combine_chunks().take(at), pa.array(start.astype(np.int32)), pa.array((m + unit.window - 1).astype(np.int32))],
            names=["doc_id", "_h", "start", "length"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            for part in tk.chunks(batch, "payload"):
                anchor = part.column("anchor").to_numpy()
                if size >= FLUSH_BYTES:
                    cut = int(np.searchsorted(anchor != last, True))
                    if cut < len(anchor):
                        yield solve([*held, part.slice(0, cut)])
                        held, size, part = [], 0, part.slice(cut)
                held.append(part)
                size += int(tk.raw(part.column("payload"))[1][-1])
                last = anchor[-1]
        if held:
            yield solve(held)

    return run


def repeated_spans(docs: DataFrame, unit: Unit, hot_limit: int = HOT_LIMIT) -> DataFrame:
    """doc_id, _h, start, length (units) of every run of windows that also start elsewhere. docs: keyed().

    AQE splits a frequent key only between plain exchanges. So the minimisers found twice are written before they meet their
    places, and the fingerprints found twice, whose input would have to be made again for that, meet theirs under another key
    than the one they were counted by.
    """
    hits = docs.mapInArrow(_find(unit), HITS)
    repeated = hits.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor", (F.col("n") > hot_limit).alias("hot"))
    hits = hits.join(checkpointed(repeated), "anchor")
    by_doc = hits.groupBy("doc_id", "_h").agg(F.collect_set(F.struct("anchor", "at", "hot")).alias("hits"))
    packed = docs.join(by_doc, same_row(docs, by_doc)).select(docs["doc_id"], docs["_h"], "text", "hits").mapInArrow(_pack(unit), PACKED)
    cold = packed.filter(F.col("payload").isNotNull()).select("doc_id", "_h", "anchor", "at", "payload")
    spans = cold.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_count(unit), SPANS)
    each = packed.filter(F.col("w1").isNotNull()).select("doc_id", "_h", F.shiftright("at", 32).cast("int").alias("s"), F.posexplode(F.arrays_zip("w1", "w2")).alias("i", "w")).select("doc_id", "_h", (F.col("s") + F.col("i")).alias("start"), "w.w1", "w.w2", F.bitwise_not("w.w2").alias("v2"))
    twice = each.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("w1", F.bitwise_not("w2").alias("v2"))  # other keys than the count's, so exchanged again
    hot = each.join(twice, ["w1", "v2"]).select("doc_id", "_h", "start", F.lit(unit.window).alias("length"))
    return spans.unionByName(hot)


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with an array of the spans to remove (null: none)."""
    by_doc = spans.groupBy("doc_id", "_h").agg(F.collect_set(F.struct("start", "length")).alias("spans"))
    return docs.join(by_doc, same_row(docs, by_doc), "left").select(docs["doc_id"], docs["text"], by_doc["spans"])


def span_rows(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row the bounds into flat start and length arrays."""
    own = part.column("spans").fill_null(pa.scalar([], part.column("spans").type)) if part.column("spans").null_count else part.column("spans")
    flat = own.flatten()
    off = np.concatenate([[0], np.cumsum(np.diff(np.asarray(own.offsets)))])
    return off, flat.field(0).to_numpy().astype(np.int64), flat.field(1).to_numpy().astype(np.int64)
