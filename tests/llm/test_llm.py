"""Text operators against brute force, on small tables with nulls, empty texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shopspark.llm import op1_jaccard, op2_substring, op3_brown, op4_sentencepiece, op5_exact, op6_suffix, op7_pii, op8_decontam, op9_quality, op10_chat, textkernel
from shopspark.llm.common import keyed
from shopspark.llm.graph import components
from shopspark.llm.semicrf import SemiCRF, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, n long, cid string, h string, spans string, score string, _h string, label string"


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "c", "h", "s", "x", "y", "z") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    vocab = ["".join(r.choice("abcdeéñ") for _ in range(r.randint(1, 7))) for _ in range(200)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    passage, base = text(60), text(150)
    out = [(i, text(r.randint(1, 120))) for i in range(40)]
    out += [(100 + i, text(20) + " " + passage + "\n" + text(30)) for i in range(8)]
    for i in range(25):
        w = base.split()
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = r.choice(vocab)
        out.append((200 + i, " ".join(w)))
    out += [(300, base.upper()), (301, base), (301, base), (302, ""), (303, None), (304, " \t\n"), (305, "one"), (306, "ONE"), (307, "one two"), (None, passage), (None, None)]
    out += [(400, "la " * 300), (401, text(3000)), (402, "a\x00b " * 60), (403, "no@yes 1 " * 50)]
    return out


def test_empty_tables(spark, rows):
    none = table(spark, rows[:1]).limit(0)
    bench = spark.createDataFrame([(1, "x " * 60)], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for out in (op1_jaccard.jaccard_components(none), op2_substring.remove_repeated_words(none), op3_brown.score_texts(none), op4_sentencepiece.encode(none), op5_exact.deduplicate(none), op6_suffix.remove_repeated_bytes(none),
                op7_pii.find_personal_data(none), op8_decontam.contaminated(none, bench), op9_quality.score_quality(none, labels)):
        assert out.count() == 0


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)]
    root = {x: x for e in edges for x in e}
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {x: find(x) for a, b in edges for x in (a, b) if a != b}


@pytest.mark.parametrize("blocks", [{}, {"block_tokens": 600, "block_sets": 4}])
def test_jaccard(spark, rows, blocks):
    sets, own = [], {}
    for i, t in rows:
        w = WORD.findall(lower(t))
        sets.append(frozenset(tuple(w[k : k + 4]) for k in range(max(len(w) - 3, 1))) if w else frozenset())
    root = list(range(len(rows)))
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            own[find(k)] = min(own.get(find(k), i), i)
    want = sorted(((str(i), len(s), str(own.get(find(k)))) for k, ((i, _), s) in enumerate(zip(rows, sets))))
    got = op1_jaccard.jaccard_components(table(spark, rows), **blocks).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == want


def brute_repeats(units, window, join):
    seen = {}
    for d, u in enumerate(units):
        for i in range(len(u) - window + 1):
            seen.setdefault(tuple(u[i : i + window]), []).append((d, i))
    gone = [set() for _ in units]
    for at in seen.values():
        if len(at) > 1:
            for d, i in at:
                gone[d].update(range(i, i + window))
    return [(len(u), len(g), join([x for k, x in enumerate(u) if k not in g])) for u, g in zip(units, gone)]


@pytest.mark.parametrize("hot", [2, 65536])
@pytest.mark.parametrize("window", [5, 35])
def test_repeated_words(spark, rows, window, hot):
    units = [WORD.findall(t or "") for _, t in rows]
    want = sorted((str(i), *x) for (i, _), x in zip(rows, brute_repeats(units, window, " ".join)))
    got = op2_substring.remove_repeated_words(table(spark, rows), window, 4, hot).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_text"]) for r in got) == want


@pytest.mark.parametrize("hot", [2, 65536])
@pytest.mark.parametrize("length", [20, 200])
def test_repeated_bytes(spark, rows, length, hot):
    units = [(t or "").encode() for _, t in rows]
    want = sorted((str(i), *x) for (i, _), x in zip(rows, brute_repeats(units, length, bytes)))
    got = op6_suffix.remove_repeated_bytes(table(spark, rows), length, 9, hot).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in got) == want


def test_exact_ranks_replace_hashes():
    ids = np.array([1, 2, 3, 1, 2, 3, 1, 2, 4])
    for w in range(1, 6):
        rank = op2_substring._ranks(ids, w)
        runs = [tuple(ids[i : i + w]) for i in range(len(ids) - w + 1)]
        assert all((rank[i] == rank[j]) == (runs[i] == runs[j]) for i in range(len(runs)) for j in range(len(runs)))


def test_brown_scores(spark, rows):
    out = op3_brown.score_texts(table(spark, rows), F.coalesce(F.col("doc_id"), F.lit(0)) % 3 != 1, head_share=0.02, known_share=0.01, classes=4).collect()
    from collections import Counter
    c = Counter()
    toks = [[*WORD.findall(lower(t)), None] for _, t in rows]
    for (i, _), w in zip(rows, toks):
        if (i or 0) % 3 != 1:
            c.update(w)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), len(w), sum(x in c for x in w), n, round(sum(np.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)) for (i, _), w in zip(rows, toks))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out) == want
    assert all(np.isfinite(r["score"]) and r["score"] < 0 and r["perplexity"] > 1 for r in out)


def test_exchange_separates_word_kinds():
    r = random.Random(0)
    seq = np.array([x for _ in range(3000) for x in (r.randrange(5), 5 + r.randrange(5))])  # two kinds that alternate
    cls = np.arange(10) % 2
    for _ in range(4):
        left, right = np.zeros((10, 2)), np.zeros((10, 2))
        np.add.at(right, (seq[:-1], cls[seq[1:]]), 1)
        np.add.at(left, (seq[1:], cls[seq[:-1]]), 1)
        cls = op3_brown.exchange(cls, left, right, np.arange(10), 2)
    assert len(set(cls[:5])) == 1 and len(set(cls[5:])) == 1 and cls[0] != cls[5]


@pytest.mark.parametrize("known", [0, 10**6])
def test_pieces(spark, rows, known):
    texts = [*rows, (500, "tab\there\r\nnew  lines "), (501, "日本 \x00x ☃"), (502, "  lead")]
    out = op4_sentencepiece.decode(op4_sentencepiece.encode(table(spark, texts), known_units=known)).collect()
    assert sorted((str(r["doc_id"]), r["decoded"]) for r in out) == sorted((str(i), t or "") for i, t in texts)
    import sentencepiece as spm
    from sentencepiece import sentencepiece_model_pb2 as pb
    p = op4_sentencepiece.Pieces(op4_sentencepiece.MODEL)
    m = pb.ModelProto()
    m.ParseFromString(open(op4_sentencepiece.MODEL, "rb").read())
    m.trainer_spec.model_type = 1  # the library's Viterbi over the same pieces and scores
    score = {i: s for _, i, s in p.rows}
    for i, x in enumerate(m.pieces):
        x.score = score.get(i, x.score)
    lib = spm.SentencePieceProcessor(model_proto=m.SerializeToString())
    total = lambda ids: sum(score.get(i, p.unknown_score / 2) for i in ids)
    for r in out:
        ids = lib.encode(r["decoded"])
        assert list(r["ids"]) == ids or total(r["ids"]) == pytest.approx(total(ids), abs=1e-2)


def test_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(op4_sentencepiece, "HELD_UNITS", 50)
    r = random.Random(8)
    b64 = "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(200_000))
    texts = [(1, b64), (2, "a" * 50_000), (3, "日本語" * 20_000), (4, " " * 3000 + "x"), (5, ""), (6, None), (None, "ab " * 40_000)]
    texts += [(10 + i, " ".join("".join(r.choice("abcdefg") for _ in range(8)) for _ in range(300))) for i in range(20)] * 2
    out = op4_sentencepiece.encode(table(spark, texts), decoded=True).collect()
    assert sorted((str(x["doc_id"]), x["decoded"]) for x in out) == sorted((str(i), t or "") for i, t in texts)
    p = op4_sentencepiece.Pieces(op4_sentencepiece.MODEL)
    score = {i: p.fixed[i] for _, i, _ in p.rows}
    unit = " " + b64[:3000]  # plain Viterbi over the whole text, not cut
    ids = next(x for x in op4_sentencepiece.encode(table(spark, [(1, b64[:3000])])).collect())["ids"]
    of = {t: score[i] for t, i, _ in p.rows}
    best = [0] + [-(1 << 62)] * len(unit)
    for j in range(1, len(unit) + 1):
        best[j] = max(best[i] + of[unit[i:j]] for i in range(max(0, j - p.longest), j) if unit[i:j] in of)
    assert sum(score[i] for i in ids) == best[-1]


def test_exact(spark, rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    best = {k: max((x for x in v if x is not None), default=None) for k, v in groups.items()}
    want = sorted((str(i), str(best[lower(t)]), len(groups[lower(t)]), i == best[lower(t)], hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in rows)
    got = op5_exact.deduplicate(table(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"], r["text_sha256"]) for r in got) == want
    left = op5_exact.survivors(table(spark, rows)).collect()
    assert sorted(lower(r["text"]) for r in left) == sorted(groups)


def test_index_grows_by_batches(spark):
    rows = lambda x: op5_exact.digests(table(spark, x))
    index = op5_exact.DigestIndex(spark, "digest_index_test", buckets=4)
    index.add(rows([(1, "a"), (2, "A"), (3, "b")]))
    index.add(rows([(9, "a"), (10, "c")]))
    assert sorted((r["doc_id"], r["n_rows"]) for r in index.read().collect()) == [(2, 3), (3, 1), (10, 1)]
    again = op5_exact.DigestIndex(spark, "digest_index_test", 10**9)  # an index keeps its buckets
    assert again.buckets == 4
    out = op5_exact.deduplicate(table(spark, [(20, "b"), (21, "d"), (22, "a"), (None, "a")]), "digest_index_test").collect()
    assert sorted((str(r["doc_id"]), r["kept"], r["group_size"]) for r in out) == [("20", False, 2), ("21", True, 1), ("22", False, 5), ("None", False, 5)]
    spark.sql("drop table digest_index_test")


def test_index_of_a_call_goes_again(spark, rows):
    op5_exact.deduplicate(table(spark, rows)).count()
    op5_exact.survivors(table(spark, rows)).count()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("digest_index_")]


def test_survivors_keep_columns_and_one_of_repeated_rows(spark, monkeypatch):
    rows = [(1, "a"), (1, "a"), (1, "A"), (2, "b"), (None, "b"), (None, "c"), (None, "c"), (3, None), (3, "")]
    for limit in (0, 10**6):  # joined by shuffle, and by broadcast
        monkeypatch.setattr(op5_exact.maybe_broadcast, "__defaults__", (None, limit))
        out = op5_exact.survivors(table(spark, rows))
        assert out.columns == table(spark, rows).columns
        assert sorted((str(r["doc_id"]), lower(r["text"])) for r in out.collect()) == [("1", "a"), ("2", "b"), ("3", ""), ("None", "c")]


def test_personal_data_base():
    t = "x a.b+c@h-1.example.com, 10.0.0.1 999.1.1.1 card 4111 1111 1111 1111 tel +1 (988) 555-2485 é 4111111111111112 +12"
    want = []
    for k, rx in (("email", op7_pii.EMAIL), ("ip", op7_pii.IP), ("card", op7_pii.CARD), ("phone", op7_pii.PHONE)):
        for m in rx.finditer(t):
            d = op7_pii._digits(m.group())
            ok = {"email": True, "ip": all(int(x) < 256 for x in m.group().split(".")) if k == "ip" else 0, "card": 16 <= len(d) <= 19 and op7_pii.luhn(d), "phone": 8 <= len(d) <= 15}[k]
            want += [(k, *m.span())] * bool(ok)
    assert op7_pii.base_spans(t) == want and len(want) == 4
    r = random.Random(3)
    for _ in range(500):
        s = "".join(r.choice("ab@.-+1 9\né") for _ in range(60))
        assert [x for x in op7_pii.base_spans(s) if x[0] == "email"] == [("email", *m.span()) for m in op7_pii.EMAIL.finditer(s)]


def test_personal_data_model(spark):
    texts = [f"der Text {i} mail ab{i}.c@mail{i % 7}.example.com und {i % 200}.17.{i % 99}.4 oder +1 (98{i % 10}) 555-24{i % 90 + 10} la" for i in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, "ruf (988) 555-2485 an"), (101, "am 2024-01-05 um 10:30 nur 12 Teile"), (102, None), (None, "x")]
    out = {r["doc_id"]: r for r in op7_pii.find_personal_data(table(spark, rows)).collect()}
    assert all({tuple(s) for s in r["base"]} <= {tuple(s) for s in r["spans"]} for r in out.values())
    assert [s["kind"] for s in out[100]["spans"]] == ["phone"] and not out[101]["spans"] and not out[102]["spans"]


def test_null_id_beside_an_id_of_the_same_set(spark):
    words = [f"w{i}" for i in range(100)]
    docs = [(None, " ".join(words).upper()), (5, " ".join(words)), (9, " ".join(words[:-1] + ["other"]))]
    out = op1_jaccard.jaccard_components(table(spark, docs)).collect()
    assert sorted((str(r["doc_id"]), r["component_id"]) for r in out) == [("5", 5), ("9", 5), ("None", 5)]


def test_addresses_without_digits(spark):
    rng = random.Random(1)
    for _ in range(40):
        t = op7_pii._variant("email", "jane.doe@example.com", rng)
        assert op7_pii.candidate(f"an {t} bald", 3, 3 + len(t)) and any(a <= 3 and b >= 3 + len(t) for a, b in op7_pii.zones(f"an {t} bald"))
    name = lambda i: "".join(chr(97 + int(x)) for x in str(i * 37))
    texts = [f"der Text mail {name(i)}{".c" * (i % 2)}@{"mail." * (i % 3 > 0)}example.com und {i % 200}.17.{i % 99}.4 oder +1 (98{i % 10}) 555-24{i % 90 + 10} la" for i in range(60)]
    asked = {200: "schreib an jane.doe[at]example.com bald", 201: "write to jane (at) example.com now", 202: "jane(at)example.com"}
    rows = [*enumerate(texts), *asked.items(), (300, "we met (at) noon"), (301, "an array[at] index")]
    out = {r["doc_id"]: r for r in op7_pii.find_personal_data(table(spark, rows)).collect()}
    found = {k: [(s["kind"], t[s["start"] : s["end"]]) for s in out[k]["spans"]] for k, t in asked.items()}
    assert found == {200: [("email", "jane.doe[at]example.com")], 201: [("email", "jane (at) example.com")], 202: [("email", "jane(at)example.com")]}
    assert not out[300]["spans"] and not out[301]["spans"]


def test_semicrf_sums_match_enumeration():
    m = SemiCRF(["o", "e", "f"], lambda t, a, b: [t[a:b], str(b - a)], lambda t, a, b: "1" in t[a:b]).fit([("a 1 2 b", {(2, 5): 1}), ("a b 1 c", {(4, 5): 2}), ("a b", {})] * 5, epochs=10)
    assert m.decode("a 1 2 b") == [(2, 5, 1)] and m.decode("b a") == []
    for text in ("a 1 2 b", "1 1 b 1 2", "c 2 1 1 1 a"):
        tok = tokens(text)
        segs = m.segments(text, tok)
        score = dict(zip(zip(segs.first.tolist(), segs.last.tolist(), strict=True), m.scores(segs), strict=True))

        def every(at, before, so_far, path):
            if at == len(tok):
                yield so_far, path
            for j in range(at, len(tok)):
                for t in range(3):
                    s = score[at, j][t] if (at, j) in score else -np.inf
                    if np.isfinite(s):
                        yield from every(j + 1, t, so_far + m.trans[before, t] + s, [*path, (tok[at][0], tok[j][1], t)])

        ways = list(every(0, 0, 0.0, []))
        _, _, z = m.sums(segs, m.scores(segs))
        assert abs(z - np.log(np.exp([w for w, _ in ways]).sum())) < 1e-9
        best = max(ways)
        assert m.decode(text) == [x for x in best[1] if x[2]]


def test_personal_data_base_by_fuzz():
    r = random.Random(4)
    for _ in range(3000):
        s = "".join(r.choice("ab@.-+1 9\né_%25()") for _ in range(60))
        want = [("email", *m.span()) for m in op7_pii.EMAIL.finditer(s)]
        want += [("ip", *m.span()) for m in op7_pii.IP.finditer(s) if all(int(x) <= 255 for x in m.group().split("."))]
        want += [("card", *m.span()) for m in op7_pii.CARD.finditer(s) if 16 <= len(op7_pii._digits(m.group())) <= 19 and op7_pii.luhn(op7_pii._digits(m.group()))]
        want += [("phone", *m.span()) for m in op7_pii.PHONE.finditer(s) if 8 <= len(op7_pii._digits(m.group())) <= 15]
        assert op7_pii.base_spans(s) == want


def test_personal_data_in_long_texts(spark):
    long = [("9" * 5000 + ".1.1.1", 0), ("a" * 100_000 + "@", 0), (("a" * 60 + "1") * 2000, 0), ("1." * 20_000 + " x@y.example.com " * 3, 3), ("0" * 6000 + "9.0.0.1", 1)]
    for t, n in long:
        z = op7_pii.zones(t)
        assert len(op7_pii.base_spans(t)) >= n and all(b <= c for (_, b), (c, _) in zip(z, z[1:]))
    seen = [f"mail ab{i}.c@mail{i % 7}.example.com und {i % 200}.17.{i % 99}.4" for i in range(40)]
    rows = list(enumerate([t for t, _ in long] + seen + seen))
    out = {r["doc_id"]: r for r in op7_pii.find_personal_data(table(spark, rows)).collect()}
    assert len(out) == len(rows)
    for i, (t, _) in enumerate(long):
        assert [tuple(s) for s in out[i]["base"]] == op7_pii.base_spans(t)
    for i in range(40):  # repeated rows get equal results
        assert out[len(long) + i]["spans"] == out[len(long) + 40 + i]["spans"]
    # spans are those of the model's best segmentation of each zone that touch no base span
    model = op7_pii.fit(keyed(table(spark, rows)))
    for i, t in rows[5:25]:
        own = op7_pii.base_spans(t)
        extra = [(op7_pii.KINDS[k - 1], s + a, e + a) for a, b in op7_pii.zones(t) for s, e, k in model.decode(t[a:b])]
        want = own + [x for x in extra if all(x[2] <= y[1] or x[1] >= y[2] for y in own)]
        assert [tuple(s) for s in out[i]["spans"]] == sorted(want, key=lambda x: (op7_pii.KINDS.index(x[0]), x[1], x[2]))


def test_contamination(spark, rows):
    r = random.Random(2)
    text = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(n))
    items = [(i, text(40)) for i in range(6)] + [(7, "short"), (8, None), (None, text(40))]
    edited = list(items[1][1])
    for k in range(0, len(edited), 40):
        edited[k] = "z"
    docs = [(1, text(30) + " " + items[0][1].upper().replace(" ", "\n ") + text(9)), (2, "".join(edited)), (3, text(400)), (4, items[2][1][:60]), (5, None), (None, items[3][1]), (1, "other " + text(20))]
    out = op8_decontam.contaminated(table(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = sorted((str(x["doc_id"]), list(x["items"])) for x in out)
    assert got == sorted([("1", [0]), ("2", [1]), ("3", []), ("4", []), ("5", []), ("None", [3]), ("1", [])])


def test_quotes_of_the_least_length_and_short_items(spark):
    r = random.Random(5)
    text = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(n))
    item, pad, n = text(60), text(20), op8_decontam.PASSAGE
    assert len(item) > 240
    quotes = {a: item[a : a + n] for a in range(len(item) - n + 1) if item[a] != " " and item[a + n - 1] != " "}
    docs = [(a, f"{pad} zz{q}zz {pad}") for a, q in quotes.items()] + [(1000 + a, f"{pad} zz{q[:60]}zz {pad}") for a, q in quotes.items()]
    typo = list(quotes[0])
    typo[50] = typo[60] = "z"  # the seed at 0 stands unedited
    docs += [(2000, "what is 6 x 7? nothing"), (2001, "six times seven"), (2002, "1six times sevens"), (2003, "say a12 now"), (2004, "a123"), (2005, "zz".join([pad, "".join(typo), pad]))]
    bench = [(1, item), (2, "Six  times seven"), (3, "What is 6 x 7?"), (4, "a12"), (5, "")]
    out = {x["doc_id"]: list(x["items"]) for x in op8_decontam.contaminated(table(spark, docs), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert [a for a in quotes if out[a] != [1]] == [] and [a for a in quotes if out[1000 + a]] == []
    assert [out[k] for k in range(2000, 2005)] == [[3], [2], [], [4], []]
    assert out[2005] == [1]


def test_banded_edits_match_full_table():
    r = random.Random(4)
    for _ in range(60):
        p = np.array([r.randrange(3) for _ in range(r.randint(1, 12))])
        t = np.array([r.randrange(3) for _ in range(r.randint(0, 20))])
        d = np.zeros((len(p) + 1, len(t) + 1), int)
        d[:, 0] = range(len(p) + 1)
        for i in range(1, len(p) + 1):
            for j in range(1, len(t) + 1):
                d[i, j] = min(d[i - 1, j - 1] + (p[i - 1] != t[j - 1]), d[i - 1, j] + 1, d[i, j - 1] + 1)
        assert op8_decontam.banded_edits(p, t, -len(p), len(t))[0] == d[-1].min()


def test_quality_held_out(spark):
    r = random.Random(6)
    good = lambda: " ".join(r.choice(["the", "cat", "sat", "on", "mat", "and", "ran"]) for _ in range(30))
    bad = lambda: " ".join(r.choice(["BUY", "NOW!!", "$$$", "WIN", "###"]) for _ in range(30))
    rows = [(i, good() if i % 3 else bad()) for i in range(300)] + [(900, None), (None, good())]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] + [(5, 0), (6, None)], "doc_id long, quality int")
    out = op9_quality.score_quality(table(spark, rows), labels).collect()
    held = [x for x in out if x["held_out"] and x["doc_id"] is not None and x["doc_id"] < 300 and x["doc_id"] != 5]
    assert held and all(x["predicted"] == int(x["doc_id"] % 3 > 0) for x in held) and all(0 <= x["score"] <= 1 for x in out) and len(out) == 302


def test_ratios_and_hinge_loss_against_plain_solvers(spark):
    r = random.Random(4)
    good, bad = "the quick brown fox jumps over lazy dogs", "zzz qqq 111 %%% buy now !!!"
    text = lambda y: " ".join(r.choice((good if r.random() < (0.8 if y else 0.3) else bad).split()) for _ in range(12))
    docs = [(i, text(i % 2)) for i in range(1, 200)] + [(500, None), (500, None), (None, good)]
    labels = [(i, i % 2) for i in range(1, 200)]
    model = op9_quality.fit(table(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int"))
    taught = [(t, y) for (i, t), (_, y) in zip(docs, labels) if zlib.crc32(str(i).encode()) % 5]
    sets = [next(op9_quality.indicators(pa.RecordBatch.from_arrays([pa.array([t])], names=["text"]))) for t, _ in taught]
    n = np.ones((2, op9_quality.SLOTS))
    for x, (_, y) in zip(sets, taught):
        n[y, x] += 1
    assert np.allclose(model.ratio, np.log(n[1] / n[1].sum()) - np.log(n[0] / n[0].sum()))
    # the dual ascent's objective is that of projected gradient steps on the whole dual problem
    scaled = [model.ratio[x] / np.sqrt((model.ratio[x] ** 2).sum()) for x in sets]
    y = np.array([2.0 * y - 1 for _, y in taught])
    dense = np.zeros((len(sets), op9_quality.SLOTS + 1))
    for k, (x, v) in enumerate(zip(sets, scaled)):
        dense[k, x], dense[k, -1] = v, 1.0
    gram = (dense * y[:, None]) @ (dense * y[:, None]).T
    alpha = np.zeros(len(y))
    step = 1 / np.linalg.norm(gram, 2)
    for _ in range(5000):
        alpha = np.clip(alpha - (gram @ alpha - 1) * step, 0, 1.0)
    loss = lambda w: w @ w / 2 + np.maximum(0, 1 - y * (dense @ w)).sum()
    best = loss(dense.T @ (alpha * y))
    w, b = op9_quality.dual_coordinate_descent(sets, scaled, y, np.ones(len(y)), 100, op9_quality.SLOTS)
    assert loss(np.append(w, b)) == pytest.approx(best, rel=1e-3)
    out = op9_quality.score_quality(table(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    seen = {}
    for x in out:
        assert 0 <= x["score"] <= 1 and seen.setdefault(x["doc_id"], x["score"]) == x["score"]
    held = [(x["score"], x["doc_id"] % 2) for x in out if x["held_out"] and x["doc_id"] is not None and x["doc_id"] < 200]
    assert np.mean([(s >= 0.5) == bool(y) for s, y in held]) > 0.9


def test_reply_trees(spark):
    m = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", -1.0), (1, 3, 1, "assistant", "good <|im_end|>\n\\ %", 2.0), (1, 4, 3, "us\ner", None, 0.0), (1, 4, 3, "zz", "repeated id", 9.0),
         (2, 1, 2, "user", "c", 0.0), (2, 2, 1, "user", "d", 0.0), (2, 3, 2, "user", "leads into a cycle", 0.0), (None, 1, 77, "assistant", "lost parent", None), (3, None, None, "user", "no id", 0.0)]
    df = spark.createDataFrame(m, "tree_id long, message_id long, parent_id long, role string, text string, score double").withColumn("rank", F.lit("clash"))
    out = op10_chat.format_trees(df, branches=2).withColumn("back", op10_chat.read_back(F.col("formatted"))).withColumn("loss", op10_chat.masked(F.col("formatted"), F.col("mask"))).collect()
    got = {(r["tree_id"], r["rank"]): ([tuple(t) for t in r["back"]], r["loss"]) for r in out}
    assert got == {
        (1, 1): ([("user", "q"), ("assistant", "good <|im_end|>\n\\ %"), ("us\ner", "")], "good <|im_end|>\n\\ %"),
        (1, 2): ([("user", "q"), ("assistant", "bad")], "bad"),
        (None, 1): ([("assistant", "lost parent")], "lost parent"),
    }
    assert op10_chat.format_trees(df.limit(0)).count() == 0


def test_keyed_ignores_other_columns(spark, rows):
    assert keyed(table(spark, rows)).columns == ["doc_id", "text", "_h"]


def test_super_windows_of_a_text_longer_than_a_sort_key(monkeypatch):
    r = np.random.default_rng(3)
    buf = r.integers(97, 100, 5000).astype(np.uint8)
    bounds = np.array([0, 40, 40, 4700, 5000])
    window, k = 35, 4
    grams = textkernel.byte_gram_hashes(buf, k)
    whole = textkernel.super_windows(grams, bounds, window, k)
    monkeypatch.setattr(textkernel, "POSITIONS", 512)
    parts = textkernel.super_windows(grams, bounds, window, k)

    def windows(found):  # start: (text, hash of its minimiser)
        return sorted((w, t, h) for t, first, last, _, h in zip(*(x.tolist() for x in found), strict=True) for w in range(first, last + 1))

    assert windows(parts) == windows(whole)
    assert [w for w, *_ in windows(parts)] == [i for a, b in zip(bounds, bounds[1:]) for i in range(a, b - window + 1)]
    assert all(f <= a + window and f <= b and p >= f for a, b, p, f in zip(parts[1], parts[2], parts[3], parts[1]))


def test_very_long_texts(spark):
    """Texts of some hundred KB beside short ones: sets, windows, digests, passages and scores of the whole text."""
    r = random.Random(8)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(5000)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    long = text(40_000)
    words = long.split()
    near = list(words)
    for k in range(0, len(near), 400):
        near[k] = "zz"
    item = text(40)
    rows = [(1, long), (2, " ".join(near)), (3, text(40_000)), (4, " ".join(words[20_000:20_050])), (5, long.upper()), (6, "short"), (7, text(30_000) + " " + item + " " + text(30_000))]
    docs = table(spark, rows)

    def shingles(t):
        w = lower(t).split()
        return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} or {tuple(w)}

    a, b = shingles(long), shingles(rows[1][1])
    assert 100 * len(a & b) >= 85 * len(a | b)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in op1_jaccard.jaccard_components(docs).collect()}
    assert got == {i: (len(shingles(t)), 1 if i in (1, 2, 5) else i) for i, t in rows}

    units = [t.split() for _, t in rows]
    want = {i: (n, gone, kept) for (i, _), (n, gone, kept) in zip(rows, brute_repeats(units, 35, " ".join))}
    got = {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept_text"]) for x in op2_substring.remove_repeated_words(docs).collect()}
    assert got == want

    data = [rows[0], rows[3], (8, long[100_000:150_000])]
    out = {x["doc_id"]: (x["n_bytes"], x["n_removed"], bytes(x["kept"])) for x in op6_suffix.remove_repeated_bytes(table(spark, data)).collect()}
    seen, gone = {}, {}
    for i, t in data:
        for p in range(len(t) - 199):
            seen.setdefault(t[p : p + 200], []).append((i, p))
    for at in seen.values():
        for i, p in at if len(at) > 1 else []:
            gone.setdefault(i, set()).update(range(p, p + 200))
    assert out == {i: (len(t), len(gone.get(i, ())), "".join(x for p, x in enumerate(t) if p not in gone.get(i, ())).encode()) for i, t in data}

    stay = {x["doc_id"]: x["keep_id"] for x in op5_exact.deduplicate(docs).collect()}
    assert stay == {1: 5, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7}

    found = {x["doc_id"]: list(x["items"]) for x in op8_decontam.contaminated(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()}
    assert found == {i: [9] if i == 7 else [] for i, _ in rows}

    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    scores = {x["doc_id"]: x["score"] for x in op9_quality.score_quality(docs, labels).collect()}
    assert len(scores) == len(rows) and all(0 <= s <= 1 for s in scores.values())
