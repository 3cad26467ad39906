"""A small semi-Markov conditional random field over the tokens of a zone of text.

A segmentation splits a zone into outside tokens and entities of at most MAX_TOKENS tokens; its weight is the
sum of whole-span feature weights and of transitions between the types of neighbouring segments. Training
maximises the log-likelihood by forward-backward sums; decoding is the bounded-length Viterbi recursion.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

MAX_TOKENS = 16
TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|[^\sA-Za-z0-9]")


def tokens(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in TOKEN.finditer(text)]


class _Segments:
    """Candidate segments of a text: first and last token, whether an entity is possible, ids of features."""

    def __init__(self, tokens: int, first: np.ndarray, last: np.ndarray, entity: np.ndarray, ids: np.ndarray, n: np.ndarray):
        self.tokens, self.first, self.last, self.entity, self.ids, self.n = tokens, first, last, entity, ids, n
        self.end = np.cumsum(n)
        self.cuts = np.searchsorted(last, np.arange(tokens + 1))
        self.by_first = np.argsort(first, kind="stable")
        self.starts = np.searchsorted(first[self.by_first], np.arange(tokens + 1))


class SemiCRF:
    """types[0] is 'outside'. allowed(text, start, end) limits the entity candidates."""

    def __init__(self, types: list[str], features: Callable[[str, int, int], list[str]], allowed: Callable[[str, int, int], bool]):
        self.types, self.features, self.allowed = types, features, allowed
        self.index: dict[str, int] = {}
        self.w = np.zeros((0, len(types)))
        self.trans = np.zeros((len(types), len(types)))

    def segments(self, text: str, tok: list[tuple[int, int]], grow: bool = False) -> _Segments:
        """The segments of a text, by last token and then from the shortest on, with the ids of their features."""
        first, last, entity, ids, n = [], [], [], [], []
        for j in range(len(tok)):
            for i in range(j, max(-1, j - MAX_TOKENS), -1):
                allowed = self.allowed(text, tok[i][0], tok[j][1])
                if not allowed and i < j:
                    continue
                names = self.features(text, tok[i][0], tok[j][1])
                own = [self.index.setdefault(x, len(self.index)) for x in names] if grow else [self.index[x] for x in names if x in self.index]
                first.append(i)
                last.append(j)
                entity.append(allowed)
                ids += own
                n.append(len(own))
        return _Segments(len(tok), np.array(first), np.array(last), np.array(entity, bool), np.array(ids, np.int64), np.array(n, np.int64))

    def scores(self, segs: _Segments) -> np.ndarray:
        """Weight of each segment as each type; -inf where it can't be of the type."""
        total = np.concatenate([np.zeros((1, len(self.types))), np.cumsum(self.w[segs.ids], 0)])
        s = total[segs.end] - total[segs.end - segs.n]
        s[segs.first < segs.last, 0] = -np.inf
        s[~segs.entity, 1:] = -np.inf
        return s

    def sums(self, segs: _Segments, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Forward and backward log-sums by node and type of the segment before it, and the logarithm of all segmentations' weight."""
        m, k = segs.tokens, len(self.types)
        f = np.full((m + 1, k), -np.inf)
        f[0, 0] = 0
        into = np.full((m + 1, k), -np.inf)
        for j in range(m):
            into[j] = _lse(f[j][:, None] + self.trans)
            a, b = segs.cuts[j], segs.cuts[j + 1]
            f[j + 1] = _lse(into[segs.first[a:b]] + score[a:b])
        back = np.full((m + 1, k), -np.inf)
        back[m] = 0
        for i in range(m - 1, -1, -1):
            own = segs.by_first[segs.starts[i] : segs.starts[i + 1]]
            back[i] = _lse((self.trans + _lse(score[own] + back[segs.last[own] + 1])[None, :]).T)
        return f, back, float(_lse(f[m][:, None])[0])

    def fit(self, data: list[tuple[str, dict[tuple[int, int], int]]], epochs: int = 8, rate: float = 0.3, decay: float = 1e-4) -> SemiCRF:
        """data: texts with their entities (character span: type number)."""
        k = len(self.types)
        ready = []
        for text, gold in data:
            tok = tokens(text)
            if not tok:
                continue
            segs = self.segments(text, tok, grow=True)
            at = {(int(i), int(j)): n for n, (i, j) in enumerate(zip(segs.first, segs.last, strict=True))}
            begins, ends = {a: n for n, (a, _) in enumerate(tok)}, {b: n for n, (_, b) in enumerate(tok)}
            y = {ends[b]: (begins[a], t) for (a, b), t in gold.items() if a in begins and b in ends and (begins[a], ends[b]) in at}
            path, j = [], len(tok) - 1
            while j >= 0:
                i, t = y.get(j, (j, 0))
                path.append((at[i, j], t))
                j = i - 1
            n, t = np.array(path[::-1]).T
            used, slot = np.unique(segs.ids, return_inverse=True)
            ready.append((segs, n, t, used, slot, np.repeat(np.arange(len(segs.n)), segs.n)))
        self.w = np.zeros((len(self.index), k))
        gw, gt = np.full_like(self.w, 1e-2), np.full_like(self.trans, 1e-2)
        rng = np.random.default_rng(0)
        for _ in range(epochs):
            for at in rng.permutation(len(ready)):
                segs, n, t, used, slot, owner = ready[at]
                score = self.scores(segs)
                f, back, z = self.sums(segs, score)
                p = np.exp(f[segs.first][:, :, None] + self.trans + (score + back[segs.last + 1])[:, None, :] - z)
                dt, ds = -p.sum(0), -p.sum(1)
                np.add.at(dt, (np.concatenate([[0], t[:-1]]), t), 1)
                ds[n, t] += 1
                g = np.zeros((len(used), k))
                np.add.at(g, slot, ds[owner])
                g -= decay * self.w[used]
                gw[used] += g * g
                self.w[used] += rate * g / np.sqrt(gw[used])
                gt += dt * dt
                self.trans += rate * dt / np.sqrt(gt)
        return self

    def decode(self, text: str) -> list[tuple[int, int, int]]:
        """The best segmentation's entities: start, end (characters), type number."""
        tok = tokens(text)
        if not tok or not len(self.w):
            return []
        segs = self.segments(text, tok)
        score, m, k = self.scores(segs), len(tok), len(self.types)
        v = np.full((m + 1, k), -np.inf)
        v[0, 0] = 0
        step, prev = np.full((m + 1, k), -np.inf), np.zeros((m + 1, k), np.int64)
        back = [[(0, 0)] * k]
        for j in range(m):
            way = v[j][:, None] + self.trans
            step[j], prev[j] = way.max(0), way.argmax(0)
            first = segs.first[segs.cuts[j] : segs.cuts[j + 1]]
            total = step[first] + score[segs.cuts[j] : segs.cuts[j + 1]]
            best = total.argmax(0)
            v[j + 1] = total[best, np.arange(k)]
            back.append([(int(first[x]), int(prev[first[x], t])) for t, x in enumerate(best)])
        out, j, t = [], m, int(v[m].argmax())
        while j > 0:
            i, p = back[j][t]
            if t:
                out.append((tok[i][0], tok[j - 1][1], t))
            j, t = i, p
        return out[::-1]


def _lse(x: np.ndarray) -> np.ndarray:
    """log-sum-exp over the first axis; columns without finite entries give -inf."""
    top = x.max(0)
    safe = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - safe).sum(0)) + safe
