"""Phrase collocation mining on sorted count streams.

Phrases are counted order by order. The counts of one order are a stream of (lang, phrase, count); a candidate meets the
counts of its parts in lockstep: sorted by its first words it is merge-joined with the stream of shorter phrases for the
left counts, sorted by its last words for the right counts, and the phrases that extend it arrive as one more stream,
sorted by what they extend. No side is held in memory or broadcast, so each is as long as the disk allows.

A phrase of three words or more can only be frequent if the two phrases that are one word shorter are. Occurrences are
therefore left out of the next order where a bit set of the frequent shorter phrases (of bounded size, broadcast) rules
them out. A bit set has no false negatives, and a false positive is only counted in vain, so counts stay exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed, read_table
from .textkernel import LOWER, mix, raw, span_hashes

#: Parameters: words of a phrase, occurrences of a candidate, percentage of a candidate that a longer one explains, rows of a report.
MAX_WORDS, LEAST, EXPLAINED, TOP = 3, 10, 50, 2000
#: Bytes of text that a task counts at a time.
BLOCK_BYTES = 2 << 20
#: Bits of the set of frequent phrases: 16 for each, at most this many (64 MB), in segments that tasks fill and merge.
MOST_BITS, SEGMENTS = 1 << 29, 64
#: Ranks are found in three steps over so many groups of a language, then one: bounded inputs whatever the table.
DEALS = (256, 16, 1)

BREAK = np.zeros(256, bool)
BREAK[[ord(c) for c in ".,;:!?"]] = True
BREAK[0x0A:0x0E] = True
APART = BREAK.copy()
APART[[0x20, 0x09]] = True
_FOLD = np.uint64(0x9E3779B97F4A7C15)


def _spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of each word, and whether the word goes on in the piece of the word before it."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, bool)
    inside = ~APART[buf]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    start = np.flatnonzero(inside & (~np.concatenate([[False], inside[:-1]]) | edge[:n]))
    end = np.flatnonzero(inside & (~np.concatenate([inside[1:], [False]]) | edge[1:])) + 1
    cuts = np.cumsum(BREAK[buf] | edge[:n], dtype=np.int32)  # a text's first byte begins a piece, as does what follows a break
    piece = cuts[start] if len(start) else start
    goes = np.zeros(len(start), bool)
    goes[1:] = piece[1:] == piece[:-1]
    return start, end, goes


def _distinct(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The different words, and the number of each word's in it. What doesn't separate words belongs to one."""
    data = np.ascontiguousarray(buf[~APART[buf]])
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    coded = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _hashes(texts: pa.Array) -> np.ndarray:
    buf, off = raw(texts)
    return span_hashes(buf, off[:-1], off[1:])


def _folded(tongue: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """Hash of phrases, from the hashes of their languages and of their first, second, ... words."""
    for h in words:
        tongue = tongue * _FOLD + h
    return mix(tongue)


def _probes(h: np.ndarray, bits: int) -> list[np.ndarray]:
    return [x & np.uint64(bits - 1) for x in (h, mix(h ^ _FOLD))]


def _blocks(batches: Iterator[pa.RecordBatch], limit: int, words: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array, int]]:
    """(lower-cased bytes, text starts and end, languages, bytes at the start that count already) of at most about twice ``limit`` bytes."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.column("text").nbytes
        if size >= limit:
            yield from _cut(held, limit, words)
            held, size = [], 0
    if held:
        yield from _cut(held, limit, words)


def _cut(held: list[pa.RecordBatch], limit: int, words: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array, int]]:
    batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    buf, off = raw(batch.column("text"))
    buf, lang = LOWER[buf], batch.column("lang")
    at, n = 0, len(off) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + 2 * limit, "right")) - 1)
        a, b = int(off[at]), int(off[to])
        if b - a <= 2 * limit:
            yield buf[a:b], off[at : to + 1] - a, lang[at:to], 0
        else:
            yield from ((part, np.array([0, len(part)], np.int64), lang[at:to], seen) for part, seen in _windows(buf[a:b], limit, words))
        at = to


def _windows(text: np.ndarray, limit: int, words: int) -> Iterator[tuple[np.ndarray, int]]:
    """A long text in windows that end after a word and begin with the last ``words`` words (in ``seen`` bytes) of the window before."""
    begin, seen = 0, 0
    while True:
        stop = begin + seen + limit
        while stop < len(text) and not APART[text[stop]]:
            gap = np.flatnonzero(APART[text[stop : stop + limit]])
            stop += int(gap[0]) if len(gap) else limit
        part = text[begin:stop]
        yield part, seen
        if stop >= len(text):
            return
        start, _, _ = _spans(part, np.array([0, len(part)], np.int64))
        back = int(start[-min(words, len(start))]) if len(start) else len(part)
        begin, seen = begin + back, len(part) - back


def _counted(orders: tuple[int, ...], bits, limit: int):
    """Counts of the phrases of some orders in each block, and, with order 1, of all words of a language (m = 0).

    ``bits`` (broadcast; None: everything counts) holds the frequent phrases that are one word shorter than max(orders).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = max(orders)
        for buf, off, langs, seen in _blocks(batches, limit, top - 1):
            start, end, goes = _spans(buf, off)
            if not len(start):
                continue
            words, code = _distinct(buf, start, end)
            tongues = langs.dictionary_encode()
            tongue = tongues.indices.to_numpy(zero_copy_only=False).astype(np.int64)[np.searchsorted(off, start, "right") - 1]
            fresh = start >= seen
            may = None
            if bits is not None:
                h, m = _hashes(words)[code], len(code) - top + 2
                shorter = _folded(_hashes(tongues.dictionary.cast(pa.binary()))[tongue[: max(m, 0)]], [h[j : j + m] for j in range(top - 1)] if m > 0 else [])
                may = np.ones(len(shorter), bool)
                for p in _probes(shorter, 8 * len(bits.value)):
                    may &= (bits.value[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 > 0
            key, ok = tongue * len(words) + code, np.ones(len(code), bool)
            for m in range(1, top + 1):
                if m > 1:  # a phrase of m words is one of m - 1 words and the word after it
                    _, at = np.unique(key[:-1], return_inverse=True)
                    key, ok = at * len(words) + code[m - 1 :], ok[:-1] & goes[m - 1 :]
                if m not in orders or not len(key):
                    continue
                use = ok & fresh[m - 1 :]
                if may is not None:
                    use &= may[:-1] & may[1:]
                some = np.flatnonzero(use)
                _, first, n = np.unique(key[some], return_index=True, return_counts=True)
                for low in range(0, len(first), 100_000):
                    p = some[first[low : low + 100_000]]
                    phrase = words.take(pa.array(code[p]))
                    for j in range(1, m):
                        phrase = pc.binary_join_element_wise(phrase, words.take(pa.array(code[p + j])), pa.scalar(b" ", phrase.type))
                    yield _rows(tongues.dictionary.take(pa.array(tongue[p])), m, phrase.cast(pa.string()), n[low : low + 100_000])
            if 1 in orders:
                n = np.bincount(tongue[fresh], minlength=len(tongues.dictionary))
                yield _rows(tongues.dictionary, 0, pa.nulls(len(n), pa.string()), n)

    return run


def _rows(lang: pa.Array, m: int, phrase: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lang, pa.array(np.full(len(n), m, np.int32)), phrase, pa.array(n.astype(np.int64))], names=["lang", "m", "phrase", "a"])


def _bit_rows(size: int, words: int):
    """The bits of a partition's phrases of so many words, in segments; segments without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size // 8, np.uint8)
        for batch in batches:
            buf, off = raw(batch.column("phrase"))
            start, end, _ = _spans(buf, off)
            h, at = span_hashes(buf, start, end), np.searchsorted(start, off[:-1])
            phrases = _folded(_hashes(batch.column("lang").cast(pa.binary())), [h[at + j] for j in range(words)])
            for p in _probes(phrases, size):
                np.bitwise_or.at(bits, (p >> np.uint64(3)).astype(np.int64), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))
        yield from _segments({k: x for k, x in enumerate(np.split(bits, SEGMENTS)) if x.any()})

    return run


def _segments(held: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for k, x in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([x.tobytes()], pa.binary())], names=["k", "bits"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, x in zip(batch.column("k").to_pylist(), batch.column("bits").to_pylist(), strict=True):
            x = np.frombuffer(x, np.uint8)
            held[k] = held[k] | x if k in held else x
    yield from _segments(held)


def _bit_set(stream: DataFrame, words: int) -> np.ndarray:
    """Bits of a stream's phrases: 16 a phrase, at most MOST_BITS; partitions fill segments, which are merged by their number."""
    size = 1 << max(16, min(MOST_BITS.bit_length() - 1, (16 * stream.count()).bit_length()))
    form = "k long, bits binary"
    rows = stream.coalesce(SEGMENTS).mapInArrow(_bit_rows(size, words), form).repartition(SEGMENTS, "k").mapInArrow(_merged, form)
    bits, step = np.zeros(size // 8, np.uint8), size // 8 // SEGMENTS
    for row in rows.toLocalIterator():
        bits[row["k"] * step : (row["k"] + 1) * step] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return bits


def count_streams(docs: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """lang, m, phrase, a: all phrases of 1 to ``max_words`` words with ``least`` occurrences and more, written to the shared folder.

    Rows with m = 0 and no phrase hold the number of all words of a language.
    """
    if max_words < 2:
        raise ValueError("phrases have two words at least")
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))

    def total(orders: tuple[int, ...], bits) -> DataFrame:
        counts = rows.mapInArrow(_counted(orders, bits, block_bytes), "lang string, m int, phrase string, a long")
        return checkpointed(counts.groupBy("lang", "m", "phrase").agg(F.sum("a").alias("a")).filter((F.col("a") >= least) | (F.col("m") == 0)))

    last = total((1, 2), None)
    out = last
    for m in range(3, max_words + 1):
        last = total((m,), docs.sparkSession.sparkContext.broadcast(_bit_set(last.filter(F.col("m") == m - 1), m - 1)))
        out = out.unionByName(last)
    return out


def scored(streams: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """lang, phrase, m, a, k, l, r, score of the phrases of two words and more: their lowest-scoring cut, after the first k words."""

    def stream(m: int, part: str, count: str) -> DataFrame:
        return streams.filter(F.col("m") == m).select("lang", F.col("phrase").alias(part), F.col("a").alias(count)).hint("merge")

    out = None
    for m in range(2, max_words + 1):
        cand, cuts = streams.filter(F.col("m") == m), []
        for k in range(1, m):
            left, right = f"_left{k}", f"_right{k}"
            cand = cand.withColumn(left, F.substring_index("phrase", " ", k)).withColumn(right, F.substring_index("phrase", " ", k - m))
            cand = cand.join(stream(k, left, f"_l{k}"), ["lang", left]).join(stream(m - k, right, f"_r{k}"), ["lang", right]).drop(left, right)
            exact = F.expr(f"(CAST(1000000 AS DECIMAL(38, 0)) * CAST(a AS DECIMAL(19, 0)) * CAST(a AS DECIMAL(19, 0))) DIV (CAST(_l{k} AS DECIMAL(19, 0)) * CAST(_r{k} AS DECIMAL(19, 0)))")
            cuts.append(F.struct(exact.alias("score"), F.lit(k).alias("k"), F.col(f"_l{k}").alias("l"), F.col(f"_r{k}").alias("r")))
        best = F.array_min(F.array(*cuts))
        some = cand.select("lang", "phrase", "m", "a", best.alias("_b")).select("lang", "phrase", "m", "a", "_b.k", "_b.l", "_b.r", "_b.score")
        out = some if out is None else out.unionByName(some)
    return out


def extensions(streams: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """lang, phrase, longer: the largest count among the longer phrases of the streams that hold a phrase of two words and more."""
    words = F.split("phrase", " ")
    inner = [F.array_join(F.slice(words, i + 1, n), " ") for m in range(3, max_words + 1) for n in range(2, m) for i in range(m - n + 1)]
    sizes = [m for m in range(3, max_words + 1) for n in range(2, m) for _ in range(m - n + 1)]
    parts = F.array(*[F.when(F.col("m") == m, p) for m, p in zip(sizes, inner, strict=True)]) if inner else F.array().cast("array<string>")
    longer = streams.filter("m > 2").select("lang", F.explode(parts).alias("phrase"), F.col("a").alias("longer")).filter("phrase IS NOT NULL")
    return longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST, explained: int = EXPLAINED, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score: each language's ``top`` phrases of 2 to ``max_words`` words.

    Texts are lower-cased (A-Z), split at ``.,;:!?`` and line ends into pieces, and those at blanks and tabs into words.
    n is the number of words of the language, a of a phrase's occurrences within pieces (overlaps too, ``least`` at least),
    l and r of those of its parts at the cut with the lowest score floor(1000000 a a / (l r)), of equal ones the first.
    A phrase that stands in a longer one with 100 longer >= explained a is dropped. Ties in score go to the larger a, then
    to the phrase that comes first by its bytes. A null text is empty, a null language 'und'. Repeated rows count as often
    as they stand there. Other columns are ignored; an empty table, and a language without frequent phrases, give no rows.
    A very long text is counted in windows that overlap by a phrase less a word.
    """
    streams = count_streams(docs, max_words, least, block_bytes)
    longer = extensions(streams, max_words).hint("merge")
    rows = scored(streams, max_words).join(longer, ["lang", "phrase"], "left")
    rows = rows.filter(~F.coalesce(100 * F.col("longer") >= explained * F.col("a"), F.lit(False)))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    for deal in DEALS:
        group = ["lang"] if deal == 1 else ["lang", F.pmod(F.xxhash64("phrase"), F.lit(deal))]
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    n = streams.filter("m = 0").select("lang", F.col("a").alias("n"))
    return rows.join(n.hint("merge"), "lang").select("lang", "rank", "phrase", "a", F.col("l").cast("long").alias("l"), F.col("r").cast("long").alias("r"), "n", F.col("score").cast("long").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT row_number() OVER () AS id, lang, piece FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d)),
w AS (SELECT id, lang, unnest(w) AS w1, unnest(range(len(w))) AS i FROM (SELECT id, lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p)),
g AS (SELECT lang, w1, lead(w1, 1) OVER (PARTITION BY id ORDER BY i) AS w2, lead(w1, 2) OVER (PARTITION BY id ORDER BY i) AS w3 FROM w),
f AS (SELECT lang, 1 AS m, w1 AS phrase, count(*) AS a FROM g GROUP BY ALL
  UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM g WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM g WHERE w3 IS NOT NULL GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND a >= 10),
k AS (SELECT c.*, j AS k, array_to_string(w[1:j], ' ') AS le, array_to_string(w[j + 1:m], ' ') AS ri FROM c, (VALUES (1), (2)) AS o(j) WHERE j < m),
s AS (SELECT k.lang, k.m, k.phrase, k.a, k.k, x.a AS l, y.a AS r, (1000000::HUGEINT * k.a * k.a) // (x.a::HUGEINT * y.a) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = k.le JOIN f y ON y.lang = k.lang AND y.phrase = k.ri),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
e AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE m = 3
  UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE m = 3) GROUP BY ALL),
z AS (SELECT b.* FROM b LEFT JOIN e USING (lang, phrase) WHERE NOT coalesce(100 * longer >= 50 * b.a, false)),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z)
SELECT q.lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM q JOIN n USING (lang) WHERE rank <= 2000
"""
