"""PII: a semi-Markov conditional random field beside exact patterns."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keyed, read_table
from .semicrf import SemiCRF

KINDS = ["email", "ip", "card", "phone"]
#: Fixed patterns of the base kinds.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
IP_AT_RUN = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # the same matches: they begin where a run of digits does
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
USER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
#: What an entity holds at least: a digit, an at sign, or the at sign's other spellings.
SPELT_AT = re.compile(r"\[at\]|\(at\)")
TRIGGER = re.compile(rf"[0-9@]|{SPELT_AT.pattern}")
#: The model is trained on at most so many zones (smallest hashes) of at most so many characters, out of at most so
#: many texts that hold a digit or an at sign (smallest content hashes).
FIT_ZONES, FIT_ZONE_CHARS, FIT_TEXTS = 400, 300, 200
#: Characters around a trigger that its zone takes in.
REACH = 24
SEPARATED = re.compile(r"[0-9](?:[\x20./-]?[0-9])*")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _octet(x: str) -> bool:
    """Whether digits, however many, are at most 255."""
    x = x.lstrip("0")
    return len(x) < 3 or (len(x) == 3 and x <= "255")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Exact pattern matches, by kind and then by start; leftmost, not overlapping within a kind."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        a = at
        while a > done and text[a - 1] in USER:
            a -= 1
        host = DOMAIN.match(text, at + 1) if a < at else None
        if host:
            out.append(("email", a, host.end()))
            done = host.end()
        at = text.find("@", max(at + 1, done))
    if not TRIGGER.search(text):
        return out
    out += [("ip", *m.span()) for m in IP_AT_RUN.finditer(text) if all(_octet(x) for x in m.group().split("."))]
    for m in CARD.finditer(text):
        d = _digits(m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


def zones(text: str) -> list[tuple[int, int]]:
    """Character ranges around digits and at signs (other spellings too), cut at line ends and (where possible) between words."""
    out: list[list[int]] = []
    for m in re.finditer(rf"(?:{TRIGGER.pattern})+", text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    fixed: list[tuple[int, int]] = []
    for a, b in out:
        least = fixed[-1][1] if fixed else 0
        if b <= least:
            continue
        a = max(a, least)
        while a > least and text[a - 1] not in " \n\t" and text[a] not in " \n\t":
            a -= 1
        while b < len(text) and text[b] not in " \n\t":
            b += 1
        if fixed and a <= least:  # both reach into one word
            fixed[-1] = (fixed[-1][0], max(b, least))
        else:
            fixed.append((a, b))
    return fixed


def _bucket(n: int) -> str:
    return str(n) if n < 20 else "20+"


def span_features(text: str, a: int, b: int) -> list[str]:
    """Features of the whole span and of what stands beside it."""
    s = text[a:b]
    if b - a > 80:
        return ["long"]
    d = _digits(s)
    shape = re.sub(r"[0-9]+", lambda m: "9" * min(len(m.group()), 5), re.sub(r"[A-Za-z]+", "a", s))
    loose = re.sub(r"9+", "9", shape)
    out = ["b", "s:" + shape[:30], "l:" + loose[:30], "k:" + "".join(sorted(set(re.sub(r"[A-Za-z0-9]", "", s)))), "n:" + _bucket(len(d))]
    if 13 <= len(d) <= 19:
        out.append("luhn:" + str(luhn(d)) + _bucket(len(d)) + str(len(d) == len(re.sub(r"[ ./-]", "", s))))
    parts = re.split(r"\.|\[\.\]", s)
    if len(parts) == 4 and all(x.isascii() and x.isdigit() for x in parts):
        out.append("ip:" + str(all(_octet(x) for x in parts)))
    left, right = text[a - 1 : a], text[b : b + 1]
    out += ["L:" + _class(left), "R:" + _class(right), "LR:" + _class(left) + _class(right) + loose[:12]]
    if "@" in s or "[at]" in s or "(at)" in s:
        out.append("mail:" + str(bool(re.fullmatch(r"[\w.%+-]+ ?(?:@|\[at\]|\(at\)) ?[\w-]+(?:(?:\.| ?\[dot\] ?)[\w-]+)+", s, re.ASCII))))
    return out


def _class(c: str) -> str:
    return "^" if not c else "9" if c.isdigit() else "a" if c.isalpha() else " " if c.isspace() else c


def candidate(text: str, a: int, b: int) -> bool:
    """Spans that may be an entity: of one line, at most 64 characters, with a digit or an at sign (other spellings too), whole at both ends."""
    s = text[a:b]
    if b - a > 64 or "\n" in s or not TRIGGER.search(s):
        return False
    return (s[0].isalnum() or s[0] in "+(") and s[-1].isalnum() and not (text[a - 1 : a].isalnum() and s[0].isalnum()) and not (text[b : b + 1].isalnum())


def _variant(kind: str, s: str, rng: random.Random) -> str:
    """The same entity written in a way that the base patterns don't know."""
    d = _digits(s)
    if kind == "email":
        user, _, host = s.partition("@")
        return user + rng.choice(["[at]", "(at)", " [at] ", " (at) ", " @ "]) + host
    if kind == "ip":
        return s.replace(".", "[.]")
    if kind == "card":
        sep = rng.choice([".", "/"])
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))
    return f"({d[-10:-7]}) {d[-7:-4]}-{d[-4:]}" if len(d) >= 10 else s


def _decoy(rng: random.Random) -> str:
    """Numbers, codes and words that are no personal data."""
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    w = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 8)))
    return rng.choice([
        n(rng.randint(1, 8)), n(4) + "-" + n(2) + "-" + n(2), n(2) + ":" + n(2), n(1) + "." + n(1) + "." + n(2), n(3) + "." + n(2), n(16) + n(rng.randint(4, 9)), "v" + n(1) + "." + n(2),
        n(12), n(10), "".join(rng.choice("0123456789abcdef") for _ in range(24)), "$" + n(3) + "." + n(2), n(2) + "%", "@" + "".join(rng.choice("abcdef") for _ in range(6)), n(3) + "-" + n(4), "(" + n(2) + ")",
        w() + rng.choice(["[at]", "(at)", " [at] ", " (at) ", " @ "]) + w(),
    ])


def own_zones(text: str) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Zones to learn from, with the base spans in them that overlap no other.

    Zones that spell an at sign already are left out: whether they hold an address isn't known. So are those of more
    than FIT_ZONE_CHARS characters.
    """
    spans = sorted(base_spans(text), key=lambda x: (x[1], x[2]))
    out = []
    for a, b in zones(text):
        if b - a > FIT_ZONE_CHARS or SPELT_AT.search(text, a, b):
            continue
        own = [(k, s - a, e - a) for k, s, e in spans if a <= s and e <= b]
        out.append((text[a:b], [x for n, x in enumerate(own) if all(x[2] <= y[1] or x[1] >= y[2] for m, y in enumerate(own) if m != n)]))
    return out


def training_data(found: list[tuple[str, list[tuple[str, int, int]]]], seed: int = 0) -> list[tuple[str, dict[tuple[int, int], int]]]:
    """Zones with the base spans as entities, each also with variants and decoys in place of its spans."""
    rng = random.Random(seed)
    out = []
    for text, own in found:
        for how in ("as is", "variant", "decoy") if own else ("as is",):
            zone, gold, at = "", {}, 0
            for k, s, e in own:
                zone += text[at:s]
                new = text[s:e] if how == "as is" else _variant(k, text[s:e], rng) if how == "variant" else _decoy(rng)
                if how != "decoy":
                    gold[(len(zone), len(zone) + len(new))] = 1 + KINDS.index(k)
                zone += new
                at = e
            out.append((zone + text[at:], gold))
    return out


def _zone_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in batch.column("text").to_pylist():
            got = own_zones(text)
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in x] for _, x in got]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in got], pa.string()), pa.array(spans, SPANS)], names=["zone", "spans"])


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
SPANS_SQL = "array<struct<kind: string, start: long, end: long>>"


def fit(rows: DataFrame, fit_texts: int = FIT_TEXTS, fit_zones: int = FIT_ZONES) -> SemiCRF:
    """Train on a bounded number of zones; nothing else reaches the driver. Half of them, where there are, hold a base span."""
    some = rows.filter(F.col("text").rlike("[0-9]@|@[a-z]|[0-9]{4}|[0-9]\\.[0-9]"))
    keys = [r["_h"] for r in some.select("_h").distinct().orderBy("_h").limit(fit_texts).collect()]
    if not keys:
        return SemiCRF(["outside", *KINDS], span_features, candidate).fit([])
    chosen = some.filter(F.col("_h").isin(keys)).select("_h", "text").dropDuplicates(["_h"])
    zone = chosen.select("text").mapInArrow(_zone_rows, f"zone string, spans {SPANS_SQL}").dropDuplicates(["zone"]).withColumn("k", F.xxhash64("zone"))
    rank = F.row_number().over(Window.partitionBy(F.size("spans") > 0).orderBy("k", "zone"))
    found = zone.withColumn("n", rank).orderBy("n", "k", "zone").limit(fit_zones).collect()
    data = training_data([(r["zone"], [tuple(s) for s in r["spans"]]) for r in found])
    random.Random(1).shuffle(data)
    return SemiCRF(["outside", *KINDS], span_features, candidate).fit(data, epochs=5)


def all_spans(text: str, model: SemiCRF, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Base spans, and those of the best segmentation that touch none of them; by kind, then start."""
    out = list(base)
    if TRIGGER.search(text):
        for a, b in zones(text):
            for s, e, t in model.decode(text[a:b]):
                if all(e + a <= y or s + a >= z for _, y, z in base):
                    out.append((KINDS[t - 1], s + a, e + a))
    return sorted(out, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_personal_data(docs: DataFrame, fit_texts: int = FIT_TEXTS) -> DataFrame:
    """Per input row: doc_id, text, base and spans (array of kind, start, end in code points, end exclusive).

    base holds the exact pattern matches; spans holds them and what the model adds. Null text is empty and has no
    spans. Texts of any length are searched whole, in time linear in it; an entity that the model adds has at most 64
    characters and 16 tokens. Null doc_id and repeated rows are rows like any other. Other columns are ignored. An empty table gives
    an empty result; without any candidate text to learn from, the model adds nothing.
    """
    rows = keyed(docs)
    model = fit(rows, fit_texts)
    as_rows = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base = [base_spans(t) for t in batch.column("text").to_pylist()]
            every = [all_spans(t, model, x) for t, x in zip(batch.column("text").to_pylist(), base, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(as_rows, base), SPANS), pa.array(map(as_rows, every), SPANS)], names=["doc_id", "base", "spans"])

    return rows.select("doc_id", "text").mapInArrow(run, f"doc_id long, base {SPANS_SQL}, spans {SPANS_SQL}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(read_table(spark, sf_dir, "documents"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))
