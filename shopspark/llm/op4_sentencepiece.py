"""SentencePiece encoding and decoding over a relational lattice.

A text is cut into units wherever no piece can reach over: between two bytes that stand next to each other in no
piece. So a unit is about a word with the space before it, and the best path of a text is that of its units in a row.
The lattice of a unit is relational: its substrings of bounded length are exploded and equi-joined to the piece
table, the edges are grouped by unit, and Viterbi is folded over them with Spark's higher-order ``aggregate``.

Rows never leave their partition. A task sends the distinct units of a few hundred texts ahead of the texts
themselves; explode and a join to a broadcast piece table keep the order of rows, so the edges of a unit arrive
in one run and are grouped as they pass, and a text finds the pieces of its units when it comes. Units that are common
in a sample of texts are encoded first and known to every task; the sample can't change a result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import keyed, read_table, released

#: Path of a SentencePiece model; a parameter of every function here.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Units known to every task, at most, and one in how many texts they are looked for in.
KNOWN_UNITS, KNOWN_SAMPLE = 300_000, 6
#: Bytes of texts that a task works on at a time, and characters of a unit that are folded into one array or cut at a time.
PART_BYTES, BLOCK, WINDOW = 1 << 18, 64, 256
SPACE = "▁"
#: Units of a task whose pieces it holds at a time, at least.
HELD_UNITS = 200_000
#: An edge's code: number of characters, then piece id; this id stands for a character without a piece.
ID_BITS, CODE_BITS = 24, 31
NO_PIECE = (1 << ID_BITS) - 1
#: Lattice rows. A unit (each WINDOW characters of it from ``base`` on, and those before them that a piece can take in) has
#: the longest piece (in characters) that may end at each character; a text's row has none.
LATTICE = "unit binary, base int, bounds array<tinyint>"


class Pieces:
    """The piece table of a model: text, id and log-probability-like score of each normal piece, and ids of bytes.

    A unigram model's scores are taken as they are. In a BPE model a score is only the negative rank of a merge; the
    piece of rank r gets -ln(r + 2) (Zipf's law), so that the best path joins pieces as a unigram model would.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        bpe = model.trainer_spec.model_type == 2
        byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.unknown = next((i for i, p in enumerate(model.pieces) if p.type == 2), 0)
        normal = [i for i, p in enumerate(model.pieces) if p.type in (1, 4)]
        first = normal[0] if normal else 0
        self.rows = [(model.pieces[i].piece.replace(SPACE, " "), i, -math.log(i - first + 2) if bpe else float(model.pieces[i].score)) for i in normal]
        self.longest = max((len(x) for x, _, _ in self.rows), default=1)
        if self.longest > 126 or len(model.pieces) >= NO_PIECE:
            raise ValueError("pieces of more than 126 characters, or too many pieces")
        self.unknown_score = min((s for _, _, s in self.rows), default=0.0) - 10.0
        self.byte_ids = np.array([byte.get(b, self.unknown) for b in range(256)], np.int32)
        own = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else b"" if p.type in (2, 3) else p.piece.replace(SPACE, " ").encode() for p in model.pieces]
        self.data = np.frombuffer(b"".join(own), np.uint8)
        self.size = np.array([len(x) for x in own], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.joined = np.zeros((256, 256), bool)  # byte pairs that a unit's end can't part
        self.joined[:, 0x80:0xC0] = True
        for x, _, _ in self.rows:
            b = np.frombuffer(x.encode(), np.uint8)
            self.joined[b[:-1], b[1:]] = True
        # An upper bound of a piece's length by its last three bytes; shorter pieces have two characters at most.
        self.ends = np.full(1 << 18, min(2, self.longest), np.int8)
        for x, _, _ in self.rows:
            b = np.frombuffer(x.encode(), np.uint8)[-3:].astype(np.int64)
            if len(b) == 3:
                slot = int(_slots(b)[0])
                self.ends[slot] = max(self.ends[slot], len(x))
        # Scores in fixed point, so that an edge is one long: score, number of characters, id. BLOCK edges can't overflow.
        worst = max(1.0, -self.unknown_score, *(abs(r[2]) for r in self.rows)) if self.rows else 1.0
        self.scale = 2.0 ** math.floor(math.log2((1 << 31) / ((BLOCK + self.longest) * worst)))
        self.fixed = np.full(len(model.pieces) + 1, round(self.unknown_score * self.scale), np.int64)
        for _, i, score in self.rows:
            self.fixed[i] = round(score * self.scale)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "rows"}  # tasks have no use for the table

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([r[:2] for r in self.rows], "piece string, id int").withColumn("slot", F.xxhash64("piece"))


def _slots(b: np.ndarray) -> np.ndarray:
    """For each byte from the third on, the slot of the three that end there."""
    return ((b[:-2] * 65599 + b[1:-1]) * 65599 + b[2:]) >> 3 & ((1 << 18) - 1) ^ b[2:]


def _spaced(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with one space put before each that isn't empty."""
    some = np.diff(off) > 0
    out = np.insert(buf, off[:-1][some], 32)
    return out, off + np.concatenate([[0], np.cumsum(some)])


def units(buf: np.ndarray, off: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of each unit of texts prepared by _spaced, and the unit index where each text begins."""
    n = len(buf)
    start = np.ones(n + 1, bool)
    start[1:n] = ~joined[buf[:-1], buf[1:]]
    start[off] = True
    s = np.flatnonzero(start[:n])
    return s, np.append(s[1:], n), np.searchsorted(s, off)


def _distinct_units(joined: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.chunks(batch, limit=PART_BYTES):
                buf, off = _spaced(*tk.raw(part.column("text")))
                s, e, _ = units(buf, off, joined)
                h, at, n = np.unique(tk.span_hashes(buf, s, e), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), _cut(buf, s[at], e[at]).cast(pa.string()), pa.array(n.astype(np.int64))], names=["h", "unit", "n"])

    return run


def _cut(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.Array:
    """Binaries buf[s:e]."""
    n = e - s
    end = np.concatenate([[0], np.cumsum(n)])
    data = buf[np.repeat(s - end[:-1], n) + np.arange(int(end[-1]))]
    return pa.BinaryArray.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(end.astype(np.int32)), pa.py_buffer(data)])


def _characters(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of strings, the byte at which each character begins (one more at the end), and each string's first character."""
    buf, off = tk.raw(text)
    first = np.flatnonzero((buf & 0xC0) != 0x80)
    return buf, np.append(first, len(buf)), np.searchsorted(first, off)


class Known:
    """Pieces of units by hash: sorted hashes, and where each one's pieces lie."""

    def __init__(self, h: np.ndarray, ids: np.ndarray, n: np.ndarray):
        order = np.argsort(h)
        end = np.concatenate([[0], np.cumsum(n[order])])
        at = np.repeat((np.cumsum(n) - n)[order] - end[:-1], n[order]) + np.arange(int(end[-1]))
        self.h, self.ids, self.off = h[order], ids[at].astype(np.int32), end

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each hash is known, and its number of pieces (1 where not) and their place."""
        if not len(self.h):
            return np.zeros(len(h), bool), np.ones(len(h), np.int64), np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        ok = self.h[at] == h
        return ok, np.where(ok, self.off[at + 1] - self.off[at], 1), self.off[at]


def _unit_rows(text: pa.Array, pieces: Pieces) -> pa.RecordBatch:
    """Lattice rows of units: for each character, how many characters a piece that ends with it can have."""
    buf, char, first = _characters(text)
    b = np.concatenate([[0, 0], buf]).astype(np.int64)
    most = pieces.ends[_slots(b)][char[1:] - 1]
    size = np.diff(first)
    most = np.minimum(most, np.arange(len(most)) - np.repeat(first[:-1], size) + 1).astype(np.int8)
    n = -(-size // WINDOW)
    own = np.repeat(np.arange(len(size)), n)
    base = (np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)) * WINDOW
    start = first[own] + base
    stop = np.minimum(start + WINDOW, first[own + 1])
    window = _cut(buf, char[np.maximum(start - pieces.longest + 1, first[own])], char[stop])
    return _rows(window, pa.array(base.astype(np.int32)), tk.lists(pa.array(most), stop - start))


def _ahead(pieces: Pieces, known: Known):
    """Texts to lattice rows: first the units of a few texts that aren't known and weren't sent, then the texts with holes for them.

    A text's row has whether its id is null, id, hash, the number of the first unit still in use, the bytes of ids, ids
    (-1: a hole), and for each hole the unit's number in the task.
    """
    joined = pieces.joined

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent, number, total = np.zeros(0, np.int64), np.zeros(0, np.int64), 0  # sorted hashes, and their units' numbers
        for batch in batches:
            for part in tk.chunks(batch, limit=PART_BYTES):
                buf, off = _spaced(*tk.raw(part.column("text")))
                s, e, bounds = units(buf, off, joined)
                h = tk.span_hashes(buf, s, e).view(np.int64)
                ok, n, place = known.find(h)
                other = np.flatnonzero(~ok)
                own, at, which = np.unique(h[other], return_index=True, return_inverse=True)
                if len(sent) > HELD_UNITS:
                    sent, number = sent[:0], number[:0]
                first = total - len(sent)
                here = np.minimum(np.searchsorted(sent, own), max(len(sent) - 1, 0))
                old = sent[here] == own if len(sent) else np.zeros(len(own), bool)
                fresh = np.flatnonzero(~old)
                numbers = np.empty(len(own), np.int64)
                numbers[old] = number[here[old]]
                numbers[fresh] = total + np.arange(len(fresh))
                total += len(fresh)
                at_sent = np.searchsorted(sent, own[fresh])
                sent, number = np.insert(sent, at_sent, own[fresh]), np.insert(number, at_sent, numbers[fresh])
                for k in range(0, len(fresh), 4096):
                    some = other[at[fresh[k : k + 4096]]]
                    yield _unit_rows(_cut(buf, s[some], e[some]), pieces)
                end = np.concatenate([[0], np.cumsum(n)])
                ids = np.full(int(end[-1]), -1, np.int32)
                fill = np.repeat(ok, n)
                ids[fill] = known.ids[(np.repeat(place - end[:-1], n) + np.arange(len(ids)))[fill]]
                ids, holes = ids.tobytes(), numbers[which].tobytes()
                cuts, gaps = (end[bounds] * 4).tolist(), (np.searchsorted(other, bounds) * 8).tolist()
                m = part.num_rows
                doc_id = part.column("doc_id").fill_null(0).to_numpy()
                null = part.column("doc_id").is_null().to_numpy(zero_copy_only=False)
                head = np.stack([null.astype(np.int64), doc_id, part.column("_h").to_numpy(), np.full(m, first), np.diff(cuts)], 1).astype(np.int64).tobytes()
                packed = [head[HEAD * i : HEAD * i + HEAD] + ids[cuts[i] : cuts[i + 1]] + holes[gaps[i] : gaps[i + 1]] for i in range(m)]
                yield _rows(pa.array(packed, pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.list_(pa.int8())))

    return run


HEAD = 5 * 8


def _rows(unit: pa.Array, base: pa.Array, bounds: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([unit, base, bounds], names=["unit", "base", "bounds"])


def _whole(window: list[bytes], end: np.ndarray, longest: int) -> pa.Array:
    """Units from their windows; end: the first node of each window."""
    out: list[list[str]] = []
    for text, at in zip(window, end.tolist(), strict=True):
        if at == 1:
            out.append([text.decode()])
        else:
            out[-1].append(text.decode()[min(longest - 1, at - 1) :])
    return pa.array(["".join(x).encode() for x in out], pa.binary())


def _grouped(fixed: np.ndarray, longest: int):
    """Edges in order of unit and end to a row per unit: lists of blocks of end nodes of edges. Texts pass.

    A unit begins with its only edge into its first character's end.
    """
    kind = pa.list_(pa.list_(pa.list_(pa.int64())))

    def edges(part: pa.RecordBatch) -> pa.RecordBatch:
        edge = part.column("edge").to_numpy()
        end, code = edge >> CODE_BITS, edge & ((1 << CODE_BITS) - 1)
        step = np.diff(end)
        node = np.flatnonzero(np.concatenate([[True], step != 0]) | (end == 1))
        first = np.flatnonzero(end[node] == 1)
        window = np.flatnonzero(part.column("unit").is_valid().to_numpy(zero_copy_only=False))
        unit = part.column("unit").drop_null()
        if len(unit) > len(first):
            unit = _whole(unit.to_pylist(), end[window], longest)
        if len(unit) != len(first) or ((step != 0) & (step != 1) & (end[1:] != 1)).any() or end[0] != 1:
            raise RuntimeError("edges of a unit came apart")
        size = np.diff(np.append(first, len(node)))
        piece = code & NO_PIECE
        edge = (fixed[np.where(piece == NO_PIECE, len(fixed) - 1, piece)] << CODE_BITS) + code
        nodes = tk.lists(pa.array(edge), np.diff(np.append(node, len(edge))))
        per = -(-size // BLOCK)
        full = np.full(int(per.sum()), BLOCK, np.int64)
        full[np.cumsum(per) - 1] = size - (per - 1) * BLOCK
        return pa.RecordBatch.from_arrays([unit, tk.lists(tk.lists(nodes, full), per)], names=["unit", "blocks"])

    def emit(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for is_text, part in _runs(batch, "edge"):
            yield pa.RecordBatch.from_arrays([part.column("unit"), pa.nulls(part.num_rows, kind)], names=["unit", "blocks"]) if is_text else edges(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            edge = batch.column("edge").fill_null(1 << CODE_BITS).to_numpy() >> CODE_BITS
            begins = np.flatnonzero(edge == 1)
            cut = int(begins[-1]) if len(begins) else 0  # the last unit may go on
            if len(begins):
                yield from emit(_together([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from emit(_together(held))

    return run


def _runs(batch: pa.RecordBatch, column: str) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Runs of rows in which a column is null, or isn't."""
    null = batch.column(column).is_null().to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(null[1:] != null[:-1]) + 1).tolist(), len(null)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield bool(null[a]), batch.slice(a, b - a)


def _together(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def lattice(rows: DataFrame, pieces: Pieces) -> DataFrame:
    """Lattice rows to unit, codes (the best edge into each node; null for a text's row).

    Equal sums (of scores rounded to about a millionth) prefer the longest last piece.
    """
    table = F.broadcast(pieces.table(rows.sparkSession))  # as many rows as the vocabulary
    ends = rows.select("unit", "base", F.posexplode_outer("bounds").alias("p", "bound"))
    cut = ends.withColumn("k", F.explode_outer(F.when(F.col("bound").isNotNull(), F.sequence(F.lit(1), F.col("bound").cast("int")))))
    lead = F.least(F.col("base"), F.lit(pieces.longest - 1))
    cut = cut.withColumn("sub", F.substr(F.col("unit").cast("string"), lead + F.col("p") + 2 - F.col("k"), F.col("k")))
    hit = cut.join(table, F.xxhash64("sub") == F.col("slot"), "left").withColumn("id", F.when(F.col("sub") == F.col("piece"), F.col("id")))
    edges = hit.filter(F.col("k").isNull() | (F.col("k") == 1) | F.col("id").isNotNull()).select(
        (F.shiftleft((F.col("base") + F.col("p")).cast("long") + 1, CODE_BITS) + F.shiftleft("k", ID_BITS) + F.coalesce("id", F.lit(NO_PIECE))).alias("edge"),
        F.when(F.col("k").isNull() | ((F.col("p") == 0) & (F.col("k") == 1)), F.col("unit")).alias("unit"),
    )
    grouped = edges.mapInArrow(released(_grouped(pieces.fixed, pieces.longest)), "unit binary, blocks array<array<array<long>>>")
    low = (1 << CODE_BITS) - 1

    def into(best, node):
        """One more node; best has an edge with the whole score for each node before it, the nearest last."""
        before = lambda e: F.get(best, F.size(best) - F.shiftright(e.bitwiseAND(low), ID_BITS).cast("int"))
        return F.concat(best, F.array(F.array_max(F.transform(node, lambda e: e + before(e).bitwiseAND(~low)))))

    def block(done, nodes):
        """One more block: it begins with the last nodes before it, their scores taken relative to the last one's."""
        last = F.element_at(done, -1)
        end = F.element_at(last, -1).bitwiseAND(~low)
        w = F.transform(F.slice(last, F.greatest(F.size(last) - pieces.longest + 1, F.lit(1)), pieces.longest), lambda x: x.bitwiseAND(~low) - end)
        return F.concat(done, F.array(F.aggregate(nodes, w, into)))

    zero = F.array(F.array(F.lit(0).cast("long")))
    done = F.aggregate("blocks", zero, block)
    own = F.zip_with(done, F.concat(F.array(F.array().cast("array<array<long>>")), F.col("blocks")), lambda best, nodes: F.slice(best, F.size(best) - F.size(nodes) + 1, F.size(nodes)))
    return grouped.select("unit", F.flatten(own).alias("codes"))


def paths(unit: pa.Array, codes: pa.Array, byte_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of units from the best edges into their nodes, and each unit's number of them. Bytes stand for a character without a piece."""
    buf, char, first = _characters(unit)
    code = codes.flatten().to_numpy() & ((1 << CODE_BITS) - 1)
    back, piece = code >> ID_BITS, code & NO_PIECE
    lens = np.diff(char)
    n = np.where(piece == NO_PIECE, lens, 1)
    on = np.zeros(len(code) + 1, bool)  # nodes on the best path
    at = first[1:].copy()
    begin = first[:-1]
    while len(at):
        on[at] = True
        at = at - back[at - 1]
        go = at > begin
        at, begin = at[go], begin[go]
    taken = np.flatnonzero(on[1:])
    m = n[taken]
    end = np.concatenate([[0], np.cumsum(m)])
    out = np.repeat(piece[taken], m)
    k = np.repeat(char[taken] - end[:-1], m) + np.arange(int(end[-1]))
    low = out == NO_PIECE
    out[low] = byte_ids[buf[k[low]]]
    total = np.concatenate([[0], np.cumsum(np.bincount(taken, m, len(code)).astype(np.int64))]) if len(code) else np.zeros(1, np.int64)
    return out.astype(np.int32), total[first[1:]] - total[first[:-1]]


def _filled(pieces: Pieces, decoded: bool):
    """Units and texts to texts with all their pieces, and (where asked for) what these decode to."""
    byte_ids = pieces.byte_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, size, first = np.zeros(0, np.int32), np.zeros(0, np.int64), 0  # pieces of the units from number first on
        fresh: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for is_text, part in _runs(batch, "codes"):
                if not is_text:
                    fresh.append(paths(part.column("unit"), part.column("codes"), byte_ids))
                    continue
                for k in range(0, part.num_rows, 256):
                    rows = part.column("unit").slice(k, 256).to_pylist()
                    head = np.array([np.frombuffer(x, np.int64, 5) for x in rows])
                    gone = int(head[0, 3]) - first
                    if gone or fresh:
                        ids = np.concatenate([ids[int(size[:gone].sum()) :], *(x for x, _ in fresh)])
                        size, first, fresh = np.concatenate([size[gone:], *(n for _, n in fresh)]), first + gone, []
                    out = _fill(rows, head, ids, size, np.cumsum(size) - size, first)
                    yield out.append_column("decoded", texts_of(out.column("ids"), pieces)) if decoded else out

    return run


def _fill(rows: list[bytes], head: np.ndarray, own: np.ndarray, size: np.ndarray, begin: np.ndarray, first: int) -> pa.RecordBatch:
    """Texts with the pieces of their units put into the holes."""
    n_ids = head[:, 4].tolist()
    ids = np.frombuffer(b"".join(x[HEAD : HEAD + n] for x, n in zip(rows, n_ids, strict=True)), np.int32)
    hole = np.frombuffer(b"".join(x[HEAD + n :] for x, n in zip(rows, n_ids, strict=True)), np.int64) - first
    off = np.concatenate([[0], np.cumsum(head[:, 4] // 4)])
    at = np.flatnonzero(ids == -1)
    n = np.ones(len(ids), np.int64)
    n[at] = size[hole]
    end = np.concatenate([[0], np.cumsum(n)])
    out = np.repeat(ids, n)
    src = np.zeros(len(ids), np.int64)
    src[at] = begin[hole] - end[at]
    put = out == -1
    out[put] = own[(np.repeat(src, n) + np.arange(len(out)))[put]]
    return pa.RecordBatch.from_arrays([pa.array(head[:, 1], mask=head[:, 0] == 1), pa.array(head[:, 2]), tk.lists(pa.array(out), np.diff(end[off]))], names=["doc_id", "_h", "ids"])


def _unit_rows_of(pieces: Pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _unit_rows(batch.column("unit").cast(pa.binary()), pieces)

    return run


def _by_hash(byte_ids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n = paths(batch.column("unit"), batch.column("codes"), byte_ids)
            buf, off = tk.raw(batch.column("unit"))
            yield pa.RecordBatch.from_arrays([pa.array(tk.span_hashes(buf, off[:-1], off[1:]).view(np.int64)), tk.lists(pa.array(ids), n)], names=["h", "ids"])

    return run


def common_units(docs: DataFrame, pieces: Pieces, most: int) -> Known:
    """The commonest units of a sample of texts, encoded over their lattice; at most ``most``, so of bounded size."""
    sample = docs.filter(F.pmod(F.xxhash64("_h"), F.lit(KNOWN_SAMPLE)) == 0).select("text")
    counted = sample.mapInArrow(released(_distinct_units(pieces.joined)), "h long, unit string, n long").groupBy("h").agg(F.first("unit").alias("unit"), F.sum("n").alias("n"))
    top = counted.filter("n > 1").orderBy(F.desc("n"), "h").limit(most).repartition("h")
    rows = top.select("unit").mapInArrow(released(_unit_rows_of(pieces)), LATTICE)
    got = lattice(rows, pieces).mapInArrow(released(_by_hash(pieces.byte_ids)), "h long, ids array<int>").toArrow().combine_chunks()
    if not got.num_rows:
        none = np.zeros(0, np.int64)
        return Known(none, none, none)
    ids = got.column("ids").combine_chunks()
    return Known(got.column("h").to_numpy(), ids.flatten().to_numpy(), np.diff(np.asarray(ids.offsets)).astype(np.int64))


def encode(docs: DataFrame, model: str = MODEL, known_units: int = KNOWN_UNITS, decoded: bool = False) -> DataFrame:
    """doc_id, _h (content hash), ids (array of piece ids) per input row; with ``decoded`` also the text that decode() gives.

    The ids are those of the best-scored path over each unit's lattice, with bytes for characters that have no piece.
    A space is put before a text, as the model's dummy prefix; a text isn't normalised otherwise. User-defined pieces
    are pieces like any other. Null and empty texts have no pieces. Null doc_id and repeated rows are rows like any
    other. Other columns are ignored. An empty table gives an empty result. A text of any length is encoded whole; one
    without a place that no piece reaches over is a single unit, folded BLOCK characters at a time. Units are told
    apart by 64-bit hashes.
    """
    pieces = Pieces(model)
    rows = keyed(docs)
    known = common_units(rows, pieces, known_units)
    coded = lattice(rows.mapInArrow(released(_ahead(pieces, known)), LATTICE), pieces)
    return coded.mapInArrow(released(_filled(pieces, decoded)), "doc_id long, _h long, ids array<int>" + ", decoded string" * decoded)


def texts_of(ids: pa.Array, pieces: Pieces) -> pa.Array:
    """The texts of lists of piece ids; bytes that aren't UTF-8 become U+FFFD."""
    out = []
    for k in range(0, len(ids), 256):
        some = ids.slice(k, 256)
        flat = some.flatten().to_numpy().astype(np.int64)
        off = np.concatenate([[0], np.cumsum(np.diff(np.asarray(some.offsets)))])
        for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            own = flat[a:b]
            n = pieces.size[own]
            at = np.repeat(pieces.begin[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            text = pieces.data[at].tobytes()
            out.append((text[1:] if text[:1] == b" " else text).decode("utf-8", "replace"))
    return pa.array(out, pa.string())


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """encoded with a column decoded: the texts of its ids (null or no ids: the empty text). Other columns and repeated rows
    stay, but for a column that is already named decoded, which is replaced. An empty table gives an empty result."""
    pieces = Pieces(model)
    decoder = F.arrow_udf(lambda ids: texts_of(ids, pieces), "string")
    return encoded.withColumn("decoded", decoder(F.col("ids")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode all texts; lossless tells whether the decoded text is the original."""
    out = encode(read_table(spark, sf_dir, "documents"), decoded=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("text_sha256"), (F.xxhash64("decoded") == F.col("_h")).alias("lossless"))
