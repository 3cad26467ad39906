"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Benchmark items are cut into patterns of PATTERN characters (UTF-8 bytes, here and below). A stretch of a document within e edits of a pattern of
m characters shares at least m - q + 1 - q * e of its q-grams, all of them near one diagonal (document position
minus pattern position). Shared q-grams are counted in overlapping bands of diagonals; bands that reach the bound are
verified by an alignment restricted to the band.

What is found: of an item of PASSAGE bytes or more, every passage of at least PASSAGE bytes that a document quotes
verbatim (after normalising), wherever in the item it starts; with up to EDIT_RATE edits a byte, every 120-byte pattern,
and those passages of PASSAGE bytes that hold an unedited seed. Seeds are SEED bytes at a stride of SEED, so that each
passage of PASSAGE bytes holds a whole one; a seed counts only if the passage around it is that long. Items of MIN_CHARS
to PASSAGE bytes are found nearly whole, shorter ones whole, unedited and not as a part of longer words.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import keyed, read_table, released, same_row

Q = 12
#: Patterns overlap by half; an item of at most 1.5 PATTERN characters is one pattern. Shorter ones than MIN_CHARS are searched unedited.
PATTERN, MIN_CHARS = 120, 40
#: The shortest passage that must be found, and the seeds that lead to it: PASSAGE >= 2 * SEED - 1 holds a whole seed.
PASSAGE, SEED = 80, 40
#: Edits allowed per pattern character.
EDIT_RATE = 0.06
#: Characters of benchmark that a pass over the documents takes to the tasks; more go in further passes.
BLOCK_CHARS = 4_000_000


#: Bytes that are part of a word: letters, digits, and all beyond ASCII.
WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def normalised(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of texts and their bounds, with A-Z lower-cased and each run of white space as one space, none at the start."""
    space = tk.SPACE[buf]
    before = np.empty(len(buf) + 1, bool)
    before[0], before[1:] = True, space
    before[off] = True
    keep = ~space | ~before[:-1]
    at = np.concatenate([[0], np.cumsum(keep)])
    out = np.where(space, np.uint8(32), tk.LOWER[buf])[keep]
    return out, at[off]


def codes(text: str) -> np.ndarray:
    """The normalised bytes of one text."""
    buf = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    out = normalised(buf, np.array([0, len(buf)]))[0]
    return out[:-1] if len(out) and out[-1] == 32 else out


def edit_budget(m: int) -> int:
    """The rate's edits, but few enough for the q-gram bound to ask for one shared q-gram at least."""
    return max(0, min(int(EDIT_RATE * m), (m - Q) // Q))


def patterns(items: list[tuple[int, str]]) -> list[tuple[int, int, np.ndarray, tuple[bytes, int] | None]]:
    """(item_id, offset, bytes, seed) of the pieces of normalised items that are searched for; seed: the item's bytes and the seed's place there.

    A seed has the offset of a pattern that it touches, so that neighbouring hits are one passage.
    """
    out = []
    for item, text in items:
        c = codes(text or "")
        if not len(c):
            continue
        starts = [0]
        if len(c) <= PATTERN * 3 // 2:
            out.append((item, 0, c, None))
        else:
            starts = sorted({*range(0, len(c) - PATTERN + 1, PATTERN // 2), len(c) - PATTERN})
            out += [(item, a, c[a : a + PATTERN], None) for a in starts]
        if len(c) >= PASSAGE:
            whole = c.tobytes()
            out += [(item, max(x for x in starts if x <= a), c[a : a + SEED], (whole, a)) for a in range(0, len(c) - SEED + 1, SEED)]
    return out


def edits_by_length(x: bytes, y: bytes) -> list[tuple[int, int]]:
    """For each length r of a start of x: the fewest edits to a start of y, and that start's length."""
    row, out = list(range(len(y) + 1)), [(0, 0)]
    for i, a in enumerate(x, 1):
        new = [i]
        for j, b in enumerate(y, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row, best = new, min(new)
        out.append((best, row.index(best)))
    return out


def grown(text: bytes, start: int, item: bytes, at: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best passage of PASSAGE bytes of an item around its seed at ``at``, which stands unedited in the text at start."""
    edits = int(EDIT_RATE * PASSAGE)
    more, end, slack = PASSAGE - SEED, start + SEED, PASSAGE - SEED + edits
    same = lambda x, y: len(os.path.commonprefix([x, y]))
    before, after = same(item[max(0, at - more) : at][::-1], text[max(0, start - more) : start][::-1]), same(item[at + SEED : at + SEED + more], text[end : end + more])
    if before + after >= more:  # no edit: nothing to align
        return 0, start - before, end + after
    left = edits_by_length(item[max(0, at - more) : at][::-1], text[max(0, start - slack) : start][::-1])
    right = edits_by_length(item[at + SEED : at + SEED + more], text[end : end + slack])
    fit = [(left[k][0] + right[more - k][0], start - left[k][1], end + right[more - k][1]) for k in range(len(left)) if 0 <= more - k < len(right)]
    best = min(fit, default=None)
    return best if best and best[0] <= edits else None


def banded_edits(pattern: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """Fewest edits between the pattern and any stretch of text whose alignment stays within diagonals low..high.

    Returns edits, start (best known) and end of the stretch in text. A diagonal is text position minus pattern position.
    """
    width = high - low + 1
    far = 1 << 20
    at = low + np.arange(width)  # text position before pattern character 0, by diagonal
    cost = np.where((at >= 0) & (at <= len(text)), 0, far)
    start = at.copy()
    for i in range(len(pattern)):
        pos = at + i  # the text character that this diagonal pairs with pattern[i]
        ok = (pos >= 0) & (pos < len(text))
        differs = np.ones(width, np.int64)
        differs[ok] = text[pos[ok]] != pattern[i]
        swap = np.where(ok, cost + differs, far)
        drop = np.append(cost[1:] + 1, far)  # pattern character without partner: one diagonal down
        take = drop < swap
        cost2, start2 = np.where(take, drop, swap), np.where(take, np.append(start[1:], 0), start)
        run = cost2 - np.arange(width)  # text characters without partner: along the row, to higher diagonals
        best = np.minimum.accumulate(run)
        src = np.maximum.accumulate(np.where(run == best, np.arange(width), 0))
        cost, start = best + np.arange(width), start2[src]
        cost = np.where(pos + 1 <= len(text), np.minimum(cost, far), far)
    j = int(cost.argmin())
    return int(cost[j]), int(start[j]), int(at[j] + len(pattern))


class PatternIndex:
    """q-grams of a block of patterns, for the tasks; its size is bounded by BLOCK_CHARS."""

    def __init__(self, pats: list[tuple[int, int, np.ndarray, tuple[bytes, int] | None]]):
        pats = sorted(pats, key=lambda p: len(p[2]) < MIN_CHARS)  # short items last
        self.item = np.array([p[0] for p in pats], np.int64)
        self.offset = np.array([p[1] for p in pats], np.int64)
        full = [p for p in pats if len(p[2]) >= MIN_CHARS]
        self.short: dict[int, dict[int, list[tuple[int, np.ndarray]]]] = {}  # by q, then by the hash of the first q bytes
        for k in range(len(full), len(pats)):
            q = min(Q, len(pats[k][2]))
            self.short.setdefault(q, {}).setdefault(int(tk.byte_gram_hashes(pats[k][2][:q], q)[0]), []).append((k, pats[k][2]))
        self.codes = [p[2] for p in full]
        self.seed = [p[3] for p in full]
        if not full:
            return
        self.size = np.array([len(c) for c in self.codes], np.int64)
        self.edits = np.array([edit_budget(int(m)) if s is None else 0 for m, s in zip(self.size, self.seed, strict=True)], np.int64)
        self.need = np.maximum(1, self.size - Q + 1 - Q * self.edits)
        self.band = self.edits + 1
        h = [tk.byte_gram_hashes(c, Q) for c in self.codes]
        flat = np.concatenate(h)
        which, pos = np.repeat(np.arange(len(h)), [len(x) for x in h]), np.concatenate([np.arange(len(x)) for x in h])
        order = np.argsort(flat, kind="stable")
        self.which, self.pos = which[order], pos[order]
        self.grams, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(self.grams >> np.uint64(42)).astype(np.int64)] = True
        self.least, self.longest = int(self.need.min()), int((self.size + self.edits).max())

    def search_all(self, buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, pattern, edits, start, end) of the verified stretches of many texts (raw bytes and bounds)."""
        c, off = normalised(buf, off)
        h = tk.byte_gram_hashes(c, Q)
        yield from self.search_short(c, off, h)
        if not len(h) or not self.codes:
            return
        maybe = np.flatnonzero(self.filter[(h >> np.uint64(42)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.grams, h[maybe]), len(self.grams) - 1)
        hit = self.grams[at] == h[maybe]
        at, d = at[hit], maybe[hit]
        text = np.searchsorted(off, d, "right") - 1
        whole = d + Q <= off[text + 1]
        at, d, text = at[whole], d[whole], text[whole]
        n = np.bincount(text, minlength=len(off) - 1)
        ends = np.cumsum(n)
        for t in np.flatnonzero(n >= self.least).tolist():
            own = slice(ends[t] - n[t], ends[t])
            for found in self.search(c[off[t] : off[t + 1]], at[own], d[own] - off[t]):
                yield (t, *found)

    def search_short(self, c: np.ndarray, off: np.ndarray, h: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """search_all for the short items: whole, unedited, between characters that continue no word."""
        if not self.short:
            return
        word = np.append(WORD[c], False)
        for q, known in self.short.items():
            own = h if q == Q else tk.byte_gram_hashes(c, q)
            at = np.flatnonzero(np.isin(own, np.fromiter(known, np.uint64, len(known))))
            for g in np.unique(own[at]).tolist():
                for k, item in known[g]:
                    d = at[own[at] == g]
                    d = d[d + len(item) <= len(c)]
                    d = d[(c[d[:, None] + np.arange(len(item))] == item).all(1)]
                    t = np.searchsorted(off, d, "right") - 1
                    end = d + len(item)
                    inside = (word[d - 1] & (d > off[t]) & word[d]) | (word[end] & (end < off[t + 1]) & word[end - 1])
                    for i in np.flatnonzero(~inside & (end <= off[t + 1])).tolist():
                        yield int(t[i]), k, 0, int(d[i] - off[t[i]]), int(end[i] - off[t[i]])

    def search(self, c: np.ndarray, at: np.ndarray, d: np.ndarray) -> list[tuple[int, int, int, int]]:
        """The same for one text, given its q-grams that patterns hold (index) and where they stand."""
        # A stretch of the longest pattern's length must hold the smallest bound of shared q-grams.
        dense = np.searchsorted(d, d + self.longest) - np.arange(len(d)) >= self.least
        if not dense.any():
            return []
        keep = tk.cover(len(c), d[dense], np.full(int(dense.sum()), self.longest))[d]
        at, d = at[keep], d[keep]
        n = self.count[at]
        entry = np.repeat(self.first[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        d, p, pos = np.repeat(d, n), self.which[entry], self.pos[entry]
        diagonal = d - pos + int(self.size.max())  # never negative
        band = diagonal // self.band[p]
        two = np.flatnonzero(band > 0)  # bands overlap: each holds its own diagonals and the next block's
        p2, band2, pos2 = np.concatenate([p, p[two]]), np.concatenate([band, band[two] - 1]), np.concatenate([pos, pos[two]])
        width = int(band2.max()) + 1
        key = np.unique((p2 * width + band2) * (int(self.size.max()) + 1) + pos2) // (int(self.size.max()) + 1)  # distinct pattern positions
        group, n = np.unique(key, return_counts=True)
        out, raw, seen = [], b"", set()
        for g in group[n >= self.need[group // width]].tolist():
            p, b = divmod(g, width)
            low = b * int(self.band[p]) - int(self.size.max()) - int(self.edits[p])
            lead = max(low, 0)
            found = c[lead : max(low, 0) + 2 * len(self.codes[p])].tobytes().find(self.codes[p].tobytes())
            if self.seed[p] is not None:
                if found < 0 or (p, lead + found) in seen:
                    continue
                seen.add((p, lead + found))
                raw = raw or c.tobytes()
                best = grown(raw, lead + found, *self.seed[p])
                if best is not None:
                    out.append((p, *best))
                continue
            if found >= 0:  # no edit: nothing to align
                out.append((p, 0, lead + found, lead + found + len(self.codes[p])))
                continue
            edits, start, end = banded_edits(self.codes[p], c, low, low + 2 * int(self.band[p]) + 2 * int(self.edits[p]))
            if edits <= self.edits[p]:
                out.append((p, edits, max(start, 0), end))
        return out


def _search(index: PatternIndex):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.chunks(batch):
                rows = np.array(list(index.search_all(*tk.raw(part.column("text")))), np.int64).reshape(-1, 5)
                text = pa.array(rows[:, 0])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(text), part.column("_h").take(text), *(pa.array(x) for x in (index.item[rows[:, 1]], index.offset[rows[:, 1]], rows[:, 2], rows[:, 3], rows[:, 4]))],
                    names=["doc_id", "_h", "item_id", "item_offset", "edits", "start", "end"],
                )

    return run


FOUND = "doc_id long, _h long, item_id long, item_offset long, edits long, start long, end long"


def find_passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Stretches of documents that stand for a benchmark passage, at most EDIT_RATE edits a character away.

    docs: keyed(). One row per pattern, diagonal band and document: doc_id, _h, item_id, item_offset, edits, and
    start and end in the normalised text. The benchmark goes to the tasks in blocks of BLOCK_CHARS characters, each
    a pass over the documents.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("item_id is not null")
    blocks = max(1, -(-int(items.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS))
    out = None
    for b in range(blocks):
        own = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        pats = patterns([(r["item_id"], r["text"]) for r in own.distinct().toLocalIterator()])
        if pats:
            found = docs.mapInArrow(released(_search(PatternIndex(pats))), FOUND)
            out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], FOUND) if out is None else out


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per input row: doc_id, contaminated, items (sorted item_ids), n_passages, least_edits.

    Texts are compared after lower-casing A-Z and collapsing white space. Null or empty texts hold nothing; empty
    items and those with a null id are never found. The module's docstring says how long a passage must be. Null doc_id and repeated rows are rows like any
    other. Other columns are ignored. An empty table gives an empty result; an empty benchmark finds nothing.
    """
    rows = keyed(docs)
    found = find_passages(rows, benchmark)
    per = found.groupBy("doc_id", "_h").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.count_distinct("item_id", "item_offset").alias("n_passages"), F.min("edits").alias("least_edits"))
    bare = rows.select("doc_id", "_h")
    out = bare.join(per, same_row(bare, per), "left")
    return out.select(bare["doc_id"], F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"), F.coalesce("n_passages", F.lit(0).cast("long")).alias("n_passages"), "least_edits")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that hold no benchmark passage; repeated rows stay or go together.

    Null and empty texts hold none and stay, rows without an id are judged by their text like others. With an empty benchmark
    all rows stay; an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bad = find_passages(keyed(docs), benchmark).select(F.col("doc_id").alias("_id"), F.col("_h").alias("_hash")).distinct()
    return docs.join(bad, (F.xxhash64(text) == bad["_hash"]) & docs["doc_id"].cast("long").eqNullSafe(bad["_id"]), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
