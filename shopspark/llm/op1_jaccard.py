"""N-gram Jaccard join by set-relation skipping.

Word shingles become 64-bit tokens; a document is the set of its tokens. Equal sets form one class, and only
one representative of a class goes on.

1. Prefix index. Tokens have one global order (common ones last, a hint from a sample that can't change
   results). Two sets that link share at least l tokens among the first ones of both. The index lists hold
   only such leading tokens; a set that shares too few of them with any other set is skipped as a whole.
   Then whole sets are held to their percentage of shared tokens in the same way. The lists are made in buckets of
   tokens, to which a batch of sets sends one packed row per bucket; a token that stands in two sets of a batch is
   known to be shared there and goes to its bucket once, so a token of every set is no hot key.
2. Lists are linked to candidate groups: two sets that link lie in the same group. Groups above a task's
   budget are cut into blocks by size (the position at which a partner can stand); blocks whose sizes
   can't meet are never paired.
3. Inside a block, a set's intersections with all others are derived from those of the most similar set
   already done: only the tokens in which the two differ touch the index lists. A set whose possible partners
   are all in its component already is skipped.
4. Blocks of one large group are first joined each in itself, together with a few shared pivots. What these
   links connect needs no more comparisons; only sets outside the group's main component then meet all blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import checkpointed, keyed, maybe_broadcast, read_table, released, same_row
from .graph import components, sorted_groups

SHINGLE_WORDS = 4
PERCENT = 85
#: Share of a set (percent) by which its prefix is longer than a single common token needs.
EXTRA_PERCENT = 3
#: What a task compares at a time.
BLOCK_TOKENS, BLOCK_SETS = 400_000, 1000
#: Tokens in a bucket of the index, and buckets at most.
BUCKET_TOKENS, MOST_BUCKETS = 100_000, 1 << 18
#: At most so many common tokens are put last in the order.
HINTS, HINT_SAMPLE = 200_000, 16


def shingle_sets(buf: np.ndarray, off: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct 63-bit tokens of each text: runs of n words, or all its words if they are fewer."""
    buf = tk.LOWER[buf]
    s, e, bounds = tk.words(buf, off)
    h = tk.span_hashes(buf, s, e)
    grams = tk.gram_hashes(h, n)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= n:
            g = np.sort(grams[a : b - n + 1] >> np.uint64(1))
            out.append(g[np.concatenate([[True], g[1:] != g[:-1]])])
        elif b > a:
            out.append(tk.gram_hashes(h[a:b] + np.uint64(b - a), b - a) >> np.uint64(1))
        else:
            out.append(h[:0])
    return out


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return np.minimum(n, n - (percent * n + 99) // 100 + 1 + EXTRA_PERCENT * n // 100)


def shared_at_least(n, percent: int):
    """Leading tokens that a set of n shares with each set that it links to."""
    return F.lit(1) + F.floor(EXTRA_PERCENT * F.floor((percent * n + 99) / 100) / 100)


def _rank(tokens: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The global order: a token's slot in ``common`` decides first, then its value."""
    return tokens | (common[(tokens >> np.uint64(41)).astype(np.int64)].astype(np.uint64) << np.uint64(63))


def _sets(n: int, percent: int, packed_common: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = np.unpackbits(np.frombuffer(packed_common, np.uint8))
        for batch in batches:
            for part in tk.chunks(batch):
                sets = shingle_sets(*tk.raw(part.column("text")), n)
                size = np.array([len(x) for x in sets], np.int64)
                take = prefix_length(size, percent)
                pre = [np.sort(_rank(x, common))[:p] for x, p in zip(sets, take.tolist(), strict=True)]
                d1 = np.array([int(tk.mix(x).sum(dtype=np.uint64)) for x in sets], np.uint64)
                d2 = np.array([int(np.bitwise_xor.reduce(tk.mix(x + np.uint64(77)))) if len(x) else 0 for x in sets], np.uint64)
                flat = np.concatenate(pre) if pre else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("_h"), pa.array(size), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), tk.lists(pa.array(flat.view(np.int64)), take)],
                    names=["doc_id", "_h", "n", "d1", "d2", "prefix"],
                )

    return run


def _tokens(n: int):
    def run(batches):
        for batch in batches:
            for part in tk.chunks(batch):
                sets = shingle_sets(*tk.raw(part.column("text")), n)
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64))], names=["t"])

    return run


def common_tokens(docs: DataFrame, n: int) -> bytes:
    """Bitmap of 2^22 token slots that the order puts last: those of the most common tokens in a sample of texts."""
    sample = docs.filter(F.pmod(F.xxhash64("_h"), F.lit(HINT_SAMPLE)) == 0).select("text").distinct()
    top = sample.mapInArrow(released(_tokens(n)), "t long").groupBy("t").count().filter("count >= 3").orderBy(F.desc("count"), "t").limit(HINTS)
    slots = np.zeros(1 << 22, bool)
    found = top.select(F.shiftrightunsigned("t", 41).alias("slot")).distinct().toArrow().column("slot").to_numpy()
    slots[found.astype(np.int64)] = True
    return np.packbits(slots).tobytes()


def links_inside(sets: list[np.ndarray], label: np.ndarray, visitor: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect the sets' components (a spanning forest of what isn't connected by ``label`` yet).

    Every pair is decided, but visitors aren't compared with each other, and where there are visitors,
    other sets aren't either. Intersections are derived from the most similar set that is done.
    """
    m = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), size)
    order = np.argsort(flat, kind="stable")
    tokens, first = np.unique(flat[order], return_index=True)
    stop = np.append(first[1:], len(flat))
    posting = owner[order]
    ids = np.empty(len(flat), np.int64)
    ids[order] = np.repeat(np.arange(len(tokens)), stop - first)
    own = np.split(ids, np.cumsum(size)[:-1])

    def touch(t: np.ndarray) -> np.ndarray:
        t = t[stop[t] - first[t] > 1]
        if not len(t):
            return np.zeros(m, np.int64)
        n = stop[t] - first[t]
        at = np.repeat(first[t] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.bincount(posting[at], minlength=m)

    lab = np.unique(label, return_inverse=True)[1].astype(np.int64)
    mixed = visitor.any()
    rows: dict[int, np.ndarray] = {}
    near, near_by = np.zeros(m, np.int64), np.full(m, -1)
    out = []
    for i in np.argsort(size, kind="stable").tolist():
        partner = (lab != lab[i]) & (size >= size[i]) & (size * percent <= 100 * size[i])
        if mixed:
            partner = (lab != lab[i]) & (visitor != visitor[i]) & (np.minimum(size, size[i]) * 100 >= percent * np.maximum(size, size[i]))
        if not partner.any():
            continue
        r = int(near_by[i])
        if r >= 0 and size[i] + size[r] - 2 * near[i] < size[i] // 2:
            gone, new = np.setdiff1d(own[r], own[i], assume_unique=True), np.setdiff1d(own[i], own[r], assume_unique=True)
            row = rows[r] - touch(gone) + touch(new)
            row[r] = near[i]
        else:
            row = touch(own[i])
        row[i] = size[i]
        rows[i] = row
        better = row > near
        near[better], near_by[better] = row[better], i
        for j in np.flatnonzero(partner & (100 * row >= percent * (size[i] + size - row))).tolist():
            if lab[j] != lab[i]:
                out.append((i, j))
                lab[lab == lab[j]] = lab[i]
    return out


def _compare(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, "task"):
            tokens = group.column("tokens").combine_chunks()
            sets = np.split(tokens.flatten().to_numpy().view(np.uint64), np.cumsum(np.diff(np.asarray(tokens.offsets)))[:-1])
            cid = group.column("cid").to_numpy()
            got = links_inside(sets, group.column("label").to_numpy(), group.column("visitor").to_numpy(zero_copy_only=False).astype(bool), percent)
            i, j = np.array(got, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(cid[i]), pa.array(cid[j])], names=["a", "b"])

    return run


def _full_sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.chunks(batch):
                sets = shingle_sets(*tk.raw(part.column("text")), n)
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("cid"), tk.lists(pa.array(flat.view(np.int64)), np.array([len(x) for x in sets], np.int64))], names=["cid", "tokens"])

    return run


def _joined(work: DataFrame, percent: int) -> DataFrame:
    """Links found in tasks: work has task (long), cid, label, visitor, tokens."""
    return work.select("task", "cid", "label", "visitor", "tokens").repartition("task").sortWithinPartitions("task").mapInArrow(released(_compare(percent)), "a long, b long")


NOBODY = np.uint64((1 << 64) - 1)


def _deal(buckets: int):
    """(id, tokens) to packed rows: per bucket the low 48 bits of its tokens and who holds each; answers that are known already apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            n = np.diff(np.asarray(lists.offsets)).astype(np.int64)
            if not n.sum():
                continue
            h = tk.mix(lists.flatten().to_numpy().view(np.uint64))
            own = np.repeat(batch.column("id").to_numpy().view(np.uint64), n)
            order = np.argsort(h, kind="stable")
            h, own = h[order], own[order]
            first = np.concatenate([[True], h[1:] != h[:-1]])
            alone = first & np.append(first[1:], True)
            to = ((h >> np.uint64(48)) * np.uint64(buckets)) >> np.uint64(16) if buckets <= 1 << 16 else (h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            yield _packed(to[first], h[first], np.where(alone, own, NOBODY)[first], False)
            if not alone.all():  # sets that share tokens in this batch hear so by way of any bucket
                spread = tk.mix(own[~alone] ^ np.uint64(11)) % np.uint64(buckets)
                by = np.argsort(spread, kind="stable")
                yield _packed(spread[by], ((to << np.uint64(48)) | (h & LOW))[~alone][by], own[~alone][by], True)

    return run


LOW = np.uint64((1 << 48) - 1)


def _packed(to: np.ndarray, h: np.ndarray, own: np.ndarray, known: bool) -> pa.RecordBatch:
    cuts = np.concatenate([[0], np.flatnonzero(to[1:] != to[:-1]) + 1, [len(to)]]).tolist()
    bucket, blob = [], []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        words = h[a:b].view(np.uint16).reshape(-1, 4)
        blob.append((words if known else words[:, :3]).T.tobytes() + own[a:b].view(np.uint16).reshape(-1, 4).T.tobytes())  # in planes, which compress
        bucket.append(int(to[a]))
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array([known] * len(blob)), pa.array(blob, pa.binary())], names=["bucket", "known", "blob"])


def _unpacked(blob: bytes, known: bool) -> tuple[np.ndarray, np.ndarray]:
    k = 4 if known else 3
    planes = np.frombuffer(blob, np.uint16).reshape(k + 4, -1)
    words = np.zeros((planes.shape[1], 4), np.uint16)
    words[:, :k] = planes[:k].T
    return words.view(np.uint64).ravel(), np.ascontiguousarray(planes[k:].T).view(np.uint64).ravel()


def _answer(counts: bool):
    """Packed rows of a bucket to (id, h) for each token that another set has too; or (id, their number)."""

    def out(own: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
        if counts:
            own, n = np.unique(own, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n.astype(np.int64))], names=["id", "h"])
        return pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(h.view(np.int64))], names=["id", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, "bucket"):
            bucket = np.uint64(group.column("bucket")[0].as_py()) << np.uint64(48)
            parts = []
            for known, blob in zip(group.column("known").to_pylist(), group.column("blob"), strict=True):
                h, own = _unpacked(blob.as_py(), known)
                if known:
                    yield out(own, h)
                else:
                    parts.append((h, own))
            if not parts:
                continue
            h, own = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            h, own = h[order], own[order]
            same = h[1:] == h[:-1]
            shared = (np.append(same, False) | np.append(False, same)) & (own != NOBODY)
            if shared.any():
                yield out(own[shared], bucket | h[shared])

    return run


def shared_tokens(sets: DataFrame, counts: bool = False) -> DataFrame:
    """sets (id, tokens: array<long>, ids and each set's tokens distinct) to (id, hs), hs the tokens that other sets have too; or to (id, held), their number.

    Tokens are named anew by 64 bits. Sets without any are absent.
    """
    total = sets.agg(F.sum(F.size("tokens").cast("long"))).first()[0] or 0
    buckets = int(min(MOST_BUCKETS, max(1, -(-total // BUCKET_TOKENS))))
    dealt = sets.mapInArrow(released(_deal(buckets)), "bucket long, known boolean, blob binary").repartition("bucket").sortWithinPartitions("bucket")
    found = dealt.mapInArrow(released(_answer(counts)), "id long, h long")
    return found.groupBy("id").agg(F.sum("h").alias("held") if counts else F.collect_list("h").alias("hs"))


def set_classes(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Per row: size, 128-bit digest and prefix of its set, and a number; per distinct non-empty set: cid and representative."""
    made = docs.mapInArrow(released(_sets(n, percent, common_tokens(docs, n))), "doc_id long, _h long, n long, d1 long, d2 long, prefix array<long>")
    rows = checkpointed(made.withColumn("rid", F.monotonically_increasing_id()))
    cid = F.coalesce(F.min("doc_id"), F.expr("(d1 & 4611686018427387903) | 4611686018427387904"))
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_h", "rid")  # of one row; a null id comes last
    classes = rows.filter("n > 0").groupBy("d1", "d2", "n").agg(cid.alias("cid"), F.min(own).alias("rep"))
    return rows, checkpointed(classes.select("d1", "d2", "n", "cid", F.col("rep.doc_id").alias("rep_id"), F.col("rep._h").alias("rep_h"), F.col("rep.rid").alias("rid")))


def candidates(rows: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """cid, n, rep_id, rep_h, hs: representatives that may link to another, with the leading tokens they share."""
    # Rows that aren't their class's representative go: found by keys alone, so that prefixes needn't move where copies are few.
    copies = rows.filter("n > 0").select("rid").join(classes.select("rid"), "rid", "left_anti")
    reps = rows.filter("n > 0").select("rid", "prefix").join(maybe_broadcast(checkpointed(copies)), "rid", "left_anti")
    enough = F.size("hs") >= shared_at_least(F.col("n"), percent)
    some = shared_tokens(reps.select(F.col("rid").alias("id"), F.col("prefix").alias("tokens")))
    some = checkpointed(some.join(classes.select(F.col("rid").alias("id"), "cid", "n", "rep_id", "rep_h"), "id").filter(enough))
    left = shared_tokens(some.select(F.col("cid").alias("id"), F.col("hs").alias("tokens")).dropDuplicates(["id"]))  # now only among those left
    return checkpointed(some.drop("id", "hs").join(left.withColumnRenamed("id", "cid"), "cid").filter(enough).dropDuplicates(["cid"]))


def links(docs: DataFrame, classes: DataFrame, some: DataFrame, n: int, percent: int, block_tokens: int = BLOCK_TOKENS, block_sets: int = BLOCK_SETS) -> DataFrame:
    """Links (a, b: cid) that connect all representatives which links connect."""
    want = maybe_broadcast(some.select("cid", F.col("rep_id").alias("doc_id"), F.col("rep_h").alias("_h")))
    texts = docs.join(want, same_row(docs, want)).select("cid", "text").dropDuplicates(["cid"])
    sets = checkpointed(texts.mapInArrow(released(_full_sets(n)), "cid long, tokens array<long>"))
    # Whole sets now: one that links shares the percentage of its tokens with others among those left.
    held = shared_tokens(sets.select(F.col("cid").alias("id"), "tokens"), counts=True).withColumnRenamed("id", "cid")
    some = checkpointed(some.join(held, "cid").filter(100 * F.col("held") >= percent * F.col("n")).drop("held"))
    # Size classes: partners differ by at most one class, so each pair meets in a window of two classes.
    cls = F.floor(F.log(F.col("n")) / F.log(F.lit(100 / percent)) - 1e-9).cast("int")
    both = F.explode(F.array(F.col("cls"), F.col("cls") - 1))
    entry = some.withColumn("cls", cls).select("cid", F.explode("hs").alias("h"), "cls").select("cid", "h", both.alias("win"))
    leader = entry.groupBy("h", "win").agg(F.min("cid").alias("b"))
    groups = components(entry.join(leader, ["h", "win"]).select(F.col("cid").alias("a"), "b"))
    member = checkpointed(some.select("cid", "n").join(groups.withColumnRenamed("node", "cid"), "cid").withColumnRenamed("component", "grp"))
    over = (F.sum("n") > block_tokens) | (F.count(F.lit(1)) > block_sets)
    large = member.groupBy("grp").agg(over.alias("large")).filter("large").select("grp")
    small = sets.join(maybe_broadcast(member.join(large, "grp", "left_anti")), "cid")
    found = _joined(small.select(F.col("grp").alias("task"), "cid", F.col("cid").alias("label"), F.lit(False).alias("visitor"), "tokens"), percent)
    big = member.join(large, "grp")
    if big.isEmpty():
        return checkpointed(found)
    windowed = big.withColumn("cls", cls).select("cid", "n", "grp", both.alias("win"))
    subs = F.greatest(F.ceil(F.sum("n") / block_tokens), F.ceil(F.count(F.lit(1)) / block_sets)).cast("int")
    shape = windowed.groupBy("grp", "win").agg(subs.alias("subs"), F.count(F.lit(1)).alias("sets"))
    placed = checkpointed(windowed.join(shape, ["grp", "win"]).withColumn("sub", F.pmod(F.xxhash64("cid"), F.col("subs")).cast("int")))
    pivot = F.pmod(F.xxhash64("cid", F.lit(1)), F.col("sets")) < 8
    everywhere = placed.filter(pivot & (F.col("subs") > 1)).withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
    task = F.xxhash64("grp", "win", "sub")
    placed_all = checkpointed(placed.unionByName(everywhere).dropDuplicates(["grp", "win", "sub", "cid"]))
    first = sets.join(maybe_broadcast(placed_all), "cid")  # keys go to the sets where they are few
    found = checkpointed(found.unionByName(_joined(first.select(task.alias("task"), "cid", F.col("cid").alias("label"), F.lit(False).alias("visitor"), "tokens"), percent)))
    # What is connected now stays so; sets outside a window's main component meet all its blocks.
    known = components(found).withColumnRenamed("node", "cid").withColumnRenamed("component", "label")
    split = placed.filter("subs > 1").join(known, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    split = checkpointed(split)
    main = split.groupBy("grp", "win", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("grp", "win").agg(F.max_by("label", F.struct("c", "label")).alias("main"))
    apart = checkpointed(split.join(main, ["grp", "win"]).filter("label <> main"))
    load = apart.groupBy("grp", "win").agg(subs.alias("parts"))
    guests = apart.join(load, ["grp", "win"]).withColumn("part", F.pmod(F.xxhash64("cid", F.lit(2)), F.col("parts")).cast("int"))
    guests = guests.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).select("grp", "win", "sub", "part", "cid", "label", F.lit(True).alias("visitor"))
    hosts = split.join(load, ["grp", "win"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("grp", "win", "sub", "part", "cid", "label", F.lit(False).alias("visitor"))
    # A guest is also a host of its own block, so that guests meet each other.
    meet = checkpointed(guests.unionByName(hosts).select(F.xxhash64("grp", "win", "sub", "part").alias("task"), "cid", "label", "visitor"))
    meet = sets.join(maybe_broadcast(meet), "cid")
    return checkpointed(found.unionByName(_joined(meet, percent)))


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE_WORDS, percent: int = PERCENT, block_tokens: int = BLOCK_TOKENS, block_sets: int = BLOCK_SETS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest doc_id reachable by links, or its own).

    Words are runs of non-space bytes after lower-casing A-Z. A set holds the distinct runs of ``shingle``
    words; with fewer words, the whole sequence; no words or null text: the empty set, which links to nothing.
    Two rows link when 100 * intersection >= percent * union. Equal sets link. Null doc_id: the row links as
    any other and gets its component's id, null if no member has one. doc_id is taken as unique; rows that repeat
    one with the same text are one document, and sets whose smallest doc_id is the same count as linked. Other
    columns are ignored. An empty table gives an empty result. Sets are compared by 63-bit token hashes.
    """
    docs = keyed(docs)
    rows, classes = set_classes(docs, shingle, percent)
    some = candidates(rows, classes, percent)
    comp = components(links(docs, classes, some, shingle, percent, block_tokens, block_sets))
    of = classes.select("d1", "d2", "n", "cid").join(comp.withColumnRenamed("node", "cid"), "cid", "left")
    of = checkpointed(of.select("d1", "d2", "n", F.coalesce("component", "cid").alias("component")))
    out = rows.filter("n > 0").select("doc_id", "n", "d1", "d2").join(of, ["d1", "d2", "n"])
    component = F.when(F.col("component") < 4611686018427387904, F.col("component"))
    empty = rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).unionByName(empty)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 3], ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT a AS doc_id, a AS other FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other)
SELECT w.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(min(r.other), w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.doc_id = w.doc_id GROUP BY w.doc_id
"""
