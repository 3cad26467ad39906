"""Phrases, embeddings and fill-in-middle against brute force: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shopspark.llm import op11_collocations, op12_embeddings, op13_fim

DOCS = "doc_id long, text string, lang string, m int, phrase string, a long, n long, rank long, h string, frames string, form string, units long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, "p", 2, 3, 4, "h", "f", "psm", 5) for i, t, lang in rows], DOCS)


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


# ---- phrases


def phrases(rows, least, explained, top, most):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, most + 1):
                for i in range(len(w) - m + 1):
                    f[lang][tuple(w[i : i + m])] += 1
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= explained * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            cuts = [(1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


@pytest.fixture(scope="module")
def talk():
    r = random.Random(3)
    word = ["".join(r.choice("abé") for _ in range(r.randint(1, 3))) for _ in range(14)]
    text = lambda n: "".join(r.choice(word).title() + r.choice([" ", "  ", "\t", " ", " ", ", ", ". ", "\n", " | "]) for _ in range(n))
    rows = [(i, text(r.randint(0, 60)), r.choice(["en", "fr", None, "und", ""])) for i in range(60)]
    rows += [(100, "New York City " * 30, "en"), (100, "New York City " * 30, "en"), (101, None, "en"), (102, "", "en"), (None, "x " * 500, "de"), (103, ".,;", "sole"), (104, text(4000), "en")]
    return rows


@pytest.mark.parametrize("most, block", [(2, 1 << 20), (3, 700), (4, 900)])
def test_phrases(spark, talk, most, block):
    out = op11_collocations.collocations(docs(spark, talk), max_words=most, least=4, explained=50, top=40, block_bytes=block)
    got = sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in out.collect())
    assert got == phrases(talk, 4, 50, 40, most)


def test_phrase_bits_have_no_false_negatives(spark, talk):
    streams = op11_collocations.count_streams(docs(spark, talk), 2, 4)
    bits = op11_collocations._bit_set(streams.filter("m = 2"), 2)
    longer = op11_collocations.count_streams(docs(spark, talk), 3, 4).filter("m = 3").count()
    assert bits.any() and longer == sum(1 for r in phrases(talk, 4, 1000, 10**6, 3) if len(r[2].split()) == 3)


def test_phrase_scores_pass_64_bits(spark):
    big = 4_000_000_000_000
    rows = [("en", 1, "a", big), ("en", 1, "b", big + 1), ("en", 2, "a b", big - 1)]
    got = op11_collocations.scored(spark.createDataFrame(rows, "lang string, m int, phrase string, a long"), 2).first()
    assert got.score == 1_000_000 * (big - 1) ** 2 // (big * (big + 1))


def test_phrase_windows_of_a_long_word():
    text = np.frombuffer(b"a b c " + b"x" * 100 + b" d e f g h i j k", np.uint8)
    seen = [(bytes(p), k) for p, k in op11_collocations._windows(text, 10, 2)]
    assert b"".join(p[k:] for p, k in seen) == bytes(text) and all(len(p) <= 130 for p, _ in seen)


# ---- embeddings


def linked(rows, threshold):
    def cos(x, y):
        x, y = ([v / max(map(abs, z)) for v in z] for z in (x, y))
        return math.fsum(a * b for a, b in zip(x, y, strict=True)) / math.sqrt(math.fsum(a * a for a in x) * math.fsum(b * b for b in y))

    good = [e is not None and len(e) > 0 and all(v is not None and math.isfinite(v) for v in e) and any(e) for _, e in rows]
    near = [[j for j in range(len(rows)) if j != i and good[i] and good[j] and len(rows[i][1]) == len(rows[j][1]) and cos(rows[i][1], rows[j][1]) >= threshold] for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        low = min(ids) if ids else None
        out.append((rows[i][0], len(near[i]), low, rows[i][0] is not None and rows[i][0] == low))
    return out


def key(r):
    return tuple((x is None, x or 0) for x in r)


@pytest.fixture(scope="module")
def vectors():
    r = random.Random(8)
    v = lambda: [r.gauss(0, 1) for _ in range(5)]
    rows = [(i, v()) for i in range(250)]
    for g in range(4):
        base = v()
        rows += [(1000 + 100 * g + i, [x + r.gauss(0, 0.12) for x in base]) for i in range(40)]
    rows += [(3000 + i, [1.0, 2.0, 3.0, 4.0, 5.0]) for i in range(30)] + [(3000, [1.0, 2.0, 3.0, 4.0, 5.0]), (3100, [2.0, 4.0, 6.0, 8.0, 10.0]), (3101, [0.0, -0.0, 0.0, 0.0, 1e-300]), (3102, [-0.0, 0.0, 0.0, 0.0, 1e-300])]
    rows += [(4000, None), (4001, []), (4002, [0.0] * 5), (4003, [float("nan")] * 5), (4004, [float("inf"), 1.0, 1.0, 1.0, 1.0]), (4005, [None, 1.0, 1.0, 1.0, 1.0]), (4006, [1.0, 2.0]), (4007, [2.0, 4.1]), (4008, [1.0, 2.0, 3.0, 4.0, 5.0, 0.0])]
    rows += [(None, [1.0, 2.0, 3.0, 4.0, 5.0]), (None, None), (None, [9.0, -9.0, 9.0, -9.0, 0.5])]
    return rows


@pytest.mark.parametrize("block_rows, deviations, cell_rows", [(2048, None, 2048), (16, None, 40), (16, 4.0, 10)])
def test_embeddings(spark, vectors, monkeypatch, block_rows, deviations, cell_rows):
    monkeypatch.setattr(op12_embeddings, "CELL_ROWS", cell_rows)
    table = spark.createDataFrame([(i, e, 3, "c", "h", 7) for i, e in vectors], "vec_id long, embedding array<double>, label int, cid string, h string, n int")
    got = op12_embeddings.near_duplicates(table, 0.95, deviations, block_rows)
    assert sorted([(r.vec_id, r.n_links, r.component_id, r.kept) for r in got.collect()], key=key) == sorted(linked(vectors, 0.95), key=key)
    assert op12_embeddings.near_duplicates(table.limit(0)).count() == 0
    assert op12_embeddings.near_duplicates(table.filter("embedding IS NULL")).count() == 2


def test_embeddings_recall_in_many_dimensions(spark):
    """With 4 deviations, pairs of random direction over many cells: brute force finds no more than 1 in 200 that is missed."""
    r = np.random.default_rng(4)
    base = r.normal(size=(1500, 48))
    base /= np.linalg.norm(base, axis=1)[:, None]
    noise = r.normal(size=(1500, 48))
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    x = np.concatenate([base, base + 0.3 * noise])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = int((u @ u.T >= 0.95).sum()) - len(u)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    op12_embeddings.CELL_ROWS, kept = 30, op12_embeddings.CELL_ROWS
    try:
        got = op12_embeddings.near_duplicates(table).agg(F.sum("n_links")).first()[0]
    finally:
        op12_embeddings.CELL_ROWS = kept
    assert want > 2000 and 0.995 * want <= got <= want


# ---- fill-in-middle


def cut(i, text):
    text = text or ""
    w = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(w)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return i, n, "plain", None, None, text
    p, m, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    form = "spm" if h4 % 100 < 20 else "psm"
    return i, n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark):
    r = random.Random(2)
    bits = ["a", "Bc", "é", " ", "\n", "<", "P", ">", "<S", "日本", "😀", "1", "z" * 40, "\x00"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 90))), "en") for i in range(250)]
    rows += [(300, None, "en"), (301, "", "en"), (None, "some text", None), (None, None, None), (302, "x<M>y", "en"), (303, "one"), (303, "one"), (304, "letters" * 4000), (305, "é" * 5000), (306, "".join(r.choice(bits) for _ in range(60000)))]
    rows = [(*x, "en")[:3] for x in rows]
    table = docs(spark, rows)
    want = [cut(i, t) for i, t, _ in rows]
    assert {x[2] for x in want} == {"plain", "psm", "spm"}
    for frame_bytes in (7, 1 << 15):
        stored = op13_fim.store(table, frame_bytes)
        out = op13_fim.outputs(stored).withColumn("text", op13_fim.restore(F.col("output"), F.col("form"))).collect()
        assert sorted([(x.doc_id, x.n, x.form, x.prefix_chars, x.middle_chars, x.output) for x in out], key=lambda x: repr(x)) == sorted(want, key=lambda x: repr(x))
        assert sorted(x.text for x in out) == sorted(t or "" for _, t, _ in rows)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        got = sorted((x.output_sha256, x.restored_sha256) for x in op13_fim.digests(stored).collect())
        assert got == sorted((sha(w[5]), sha(t or "")) for w, (_, t, _) in zip(want, rows, strict=True))
    assert op13_fim.fill_in_middle(table.limit(0)).count() == 0 and op11_collocations.collocations(table.limit(0)).count() == 0


def test_a_cut_opens_one_frame():
    pack = op13_fim.zstandard.ZstdCompressor()
    parts = [b"one two ", b"three f", b"our five"]
    frames = op13_fim.Frames([pack.compress(x) for x in parts], [4, 7, 9], [8, 15, 23], [8, 15, 23])
    opened = []
    frames.frame = lambda i, f=frames.frame: opened.append(i) or f(i)
    assert frames.before(5) == (13, 13) and opened == [1]
    assert frames.before(7) == (18, 18) and opened == [1, 2]  # "our" goes on from the frame before
    assert b"".join(frames.read(6, 17)) == b"o three fou"
