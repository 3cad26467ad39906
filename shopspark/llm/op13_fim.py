"""Fill-in-the-middle transformation over seekable compressed frames.

``store`` keeps every text as independent zstandard frames with the cumulative numbers of units and characters before
each frame's end. A cut that is given as a unit number is then found by one search over these numbers and one frame that
is decompressed; outputs and digests are streamed frame by frame in the order in which their parts stand in the output.
A task holds one row's compressed frames and one decompressed frame.

A unit is a match of ``[A-Za-z]+|[^A-Za-z]`` and belongs to the frame in which it starts, so that a run of letters of any
length can go on over several frames.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed, read_table
from .textkernel import chunks, raw

#: Bytes of text in a frame (a parameter of ``store``), and zstandard's level.
FRAME_BYTES, LEVEL = 1 << 15, 3
#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Shares of 100 that are left plain, and of the others that have the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20

LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True

STORED = "doc_id long, marked boolean, frames array<binary>, units array<long>, chars array<long>, bytes array<long>"


def _framed(frame_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            for part in chunks(batch, limit=1 << 20):
                buf, off = raw(part.column("text"))
                letter = LETTER[buf]
                char = (buf & 0xC0) != 0x80
                unit = char.copy()
                unit[1:] &= ~(letter[1:] & letter[:-1])
                firsts = off[:-1][off[:-1] < off[1:]]
                unit[firsts] = True
                upto_unit, upto_char = np.concatenate([[0], np.cumsum(unit)]), np.concatenate([[0], np.cumsum(char)])
                data, frames, counts = buf.tobytes(), [], ([], [], [])
                for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                    ends, at = [], a
                    while at < b:
                        to = min(at + frame_bytes, b)
                        while to < b and not char[to]:
                            to += 1
                        ends.append(to)
                        at = to
                    frames.append([pack.compress(data[x:y]) for x, y in zip([a, *ends], ends)])
                    e = np.array(ends, np.int64)
                    for out, upto in zip(counts, (upto_unit, upto_char, None), strict=True):
                        out.append(e - a if upto is None else upto[e] - upto[a])
                held = [pa.array(x, pa.list_(pa.int64())) for x in counts]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("marked"), pa.array(frames, pa.list_(pa.binary())), *held],
                    names=["doc_id", "marked", "frames", "units", "chars", "bytes"],
                )

    return run


def store(docs: DataFrame, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """The texts as seekable frames: doc_id, marked (holds one of the three marks), frames, and cumulative units, chars, bytes.

    The frame is written to the shared folder, so that later steps seek in it instead of reading texts again. A null text
    is the empty text, which has no frame. Rows stay apart whatever their ids.
    """
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marked = text.contains("<P>") | text.contains("<S>") | text.contains("<M>")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), marked.alias("marked"))
    return checkpointed(rows.mapInArrow(_framed(frame_bytes), STORED))


def _draw(doc_id: Column, i: int) -> Column:
    """The i-th 8-digit group (from 1) of the hex sha256 of '1:' and the id, as a number; a null id counts as no digits."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * i - 7, 8), 16, 10).cast("long")


def planned(stored: DataFrame) -> DataFrame:
    """stored with n (units), form and the two cuts as numbers of units: from the cumulative numbers alone."""
    n = F.when(F.size("units") > 0, F.element_at("units", -1)).otherwise(F.lit(0).cast("long"))
    rows = stored.withColumn("n", n).withColumns({f"_h{i}": _draw(F.col("doc_id"), i) for i in range(1, 5)})
    one, two = F.col("_h1") % (F.col("n") + 1), F.col("_h2") % (F.col("n") + 1)
    plain = (F.col("n") == 0) | F.col("marked") | (F.col("_h3") % 100 >= 100 - PLAIN)
    form = F.when(plain, "plain").when(F.col("_h4") % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    return rows.withColumns({"form": form, "cut1": F.least(one, two), "cut2": F.greatest(one, two)}).drop("_h1", "_h2", "_h3", "_h4")


class Frames:
    """One text's frames: seeks a unit, reads a range of bytes, one decompressed frame at a time."""

    def __init__(self, frames: list[bytes], units: list[int], chars: list[int], ends: list[int]):
        self.frames, self.units, self.chars, self.ends = frames, units, chars, ends
        self.size = ends[-1] if ends else 0
        self.unpack = zstandard.ZstdDecompressor()

    def frame(self, i: int) -> bytes:
        return self.unpack.decompress(self.frames[i])

    def before(self, unit: int) -> tuple[int, int]:
        """(bytes, characters) before the start of a unit; of the whole text where there are no more units."""
        i = bisect_right(self.units, unit)
        if i == len(self.units):
            return self.size, self.chars[-1] if self.chars else 0
        data = np.frombuffer(self.frame(i), np.uint8)
        letter, char = LETTER[data], (data & 0xC0) != 0x80
        start = char.copy()
        start[1:] &= ~(letter[1:] & letter[:-1])
        if start.sum() > self.units[i] - (self.units[i - 1] if i else 0):  # its first letter goes on from the frame before
            start[0] = False
        at = int(np.flatnonzero(start)[unit - (self.units[i - 1] if i else 0)])
        return (self.ends[i - 1] if i else 0) + at, (self.chars[i - 1] if i else 0) + int(char[:at].sum())

    def read(self, a: int, b: int) -> Iterator[bytes]:
        i = bisect_right(self.ends, a)
        while a < b and i < len(self.ends):
            low = self.ends[i - 1] if i else 0
            piece = self.frame(i)[a - low : b - low]
            yield piece
            a += len(piece)
            i += 1


class Output:
    """A text's output as a readable sequence of bytes: marks, and ranges of the frames."""

    def __init__(self, text: Frames, form: str, cut1: int, cut2: int):
        spans = {PREFIX: (0, cut1), SUFFIX: (cut2, text.size), MIDDLE: (cut1, cut2)}
        order = {"plain": [], "psm": [PREFIX, SUFFIX, MIDDLE], "spm": [SUFFIX, PREFIX, MIDDLE]}[form]
        self.text, self.parts = text, [x for mark in order for x in (mark, spans[mark])] or [(0, text.size)]
        sizes = [len(x) if isinstance(x, bytes) else x[1] - x[0] for x in self.parts]
        self.ends = np.cumsum(sizes).tolist()
        self.size = self.ends[-1]

    def read(self, a: int = 0, b: int | None = None) -> Iterator[bytes]:
        b = self.size if b is None else b
        for part, end in zip(self.parts, self.ends, strict=True):
            size = len(part) if isinstance(part, bytes) else part[1] - part[0]
            x, y = max(a, end - size) - (end - size), min(b, end) - (end - size)
            if x < y:
                yield from [part[x:y]] if isinstance(part, bytes) else self.text.read(part[0] + x, part[0] + y)


def marks(pieces: Iterator[bytes]) -> list[tuple[int, bytes]]:
    """Where the three marks stand in a stream of bytes (each stands there once), in order."""
    found, tail, base = [], b"", 0
    for piece in pieces:
        window = tail + piece
        for mark in (PREFIX, SUFFIX, MIDDLE):
            at = window.find(mark)
            while at >= 0:
                found.append((base + at, mark))
                at = window.find(mark, at + 1)
        tail = window[-2:]
        base += len(window) - len(tail)
    return sorted(set(found))


def restored(output: Output, form: str) -> Iterator[bytes]:
    """The text again, out of the output and its form alone: finds the marks, then reads the parts in the text's order."""
    if form == "plain":
        yield from output.read()
        return
    at = marks(output.read())
    ends = [x for x, _ in at[1:]] + [output.size]
    span = {mark: (x + len(mark), end) for (x, mark), end in zip(at, ends, strict=True)}
    for mark in (PREFIX, MIDDLE, SUFFIX):
        yield from output.read(*span[mark])


def _digest(pieces: Iterator[bytes]) -> str:
    h = hashlib.sha256()
    for x in pieces:
        h.update(x)
    return h.hexdigest()


def _opened(batch: pa.RecordBatch) -> Iterator[tuple[int | None, int, str, Output, tuple[int, int] | None]]:
    """Each row's id, units, form, output, and characters of prefix and middle."""
    column = {name: batch.column(name) for name in batch.schema.names}
    for i in range(batch.num_rows):
        row = {name: c[i].as_py() for name, c in column.items()}
        text = Frames(row["frames"], row["units"], row["chars"], row["bytes"])
        if row["form"] == "plain":
            yield row["doc_id"], row["n"], "plain", Output(text, "plain", 0, 0), None
            continue
        (b1, c1), (b2, c2) = text.before(row["cut1"]), text.before(row["cut2"])
        yield row["doc_id"], row["n"], row["form"], Output(text, row["form"], b1, b2), (c1, c2 - c1)


def _columns(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


HEAD = "doc_id long, n long, form string, prefix_chars long, middle_chars long"
_NAMES = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(i, n, form, *(chars or (None, None)), _digest(out.read()), _digest(restored(out, form))) for i, n, form, out, chars in _opened(batch)]
        yield _columns(rows, [*_NAMES, "output_sha256", "restored_sha256"], [*_TYPES, pa.string(), pa.string()])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i, n, form, out, chars in _opened(batch):
            rows.append((i, n, form, *(chars or (None, None)), b"".join(out.read()).decode()))
            if sum(len(r[-1]) for r in rows) > 1 << 22:
                yield _columns(rows, [*_NAMES, "output"], [*_TYPES, pa.string()])
                rows = []
        yield _columns(rows, [*_NAMES, "output"], [*_TYPES, pa.string()])


def outputs(stored: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of stored texts: what a training job reads."""
    return planned(stored).mapInArrow(_texts, f"{HEAD}, output string")


def digests(stored: DataFrame) -> DataFrame:
    """As ``outputs``, with the digests of the output and of the text rebuilt from it, streamed and never put together."""
    return planned(stored).mapInArrow(_digests, f"{HEAD}, output_sha256 string, restored_sha256 string")


def fill_in_middle(docs: DataFrame, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, n, form, prefix_chars, middle_chars, output.

    A text with one of the marks, an empty and a null text is left plain, as is a share drawn from the id; a null id draws
    from no digits. Repeated rows and ids draw alike, each by its own text. Other columns of docs are ignored, and an empty
    table gives an empty result.
    """
    return outputs(store(docs, frame_bytes))


def restore(output: Column, form: Column) -> Column:
    """The text of a row of ``fill_in_middle``, as a column."""
    tail = F.substring_index(output, "<M>", -1)
    body = F.substring_index(output, "<M>", 1)
    psm = F.concat(F.substring_index(F.substr(body, F.lit(4)), "<S>", 1), tail, F.substring_index(body, "<S>", -1))
    spm = F.concat(F.substring_index(body, "<P>", -1), tail, F.substring_index(F.substr(body, F.lit(4)), "<P>", 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(store(read_table(spark, sf_dir, "documents")))


SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS w,
    ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
    ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM t),
c AS (SELECT *, len(w)::BIGINT AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS k1, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS k2 FROM u),
p AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(w[1:k1], '') AS pre, array_to_string(w[k1 + 1:k2], '') AS mid, array_to_string(w[k2 + 1:n], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""
