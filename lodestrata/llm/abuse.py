"""Abusive, hateful or sexual passages: a convolutional classifier over hashed words, in numpy.

A text is cut into passages at sentence and paragraph ends.  A passage's words are hashed into
an embedding table; filters of several widths run over them and each keeps its greatest
value; a logistic layer scores the passage.  A text's score is that of its worst passage.

Labels are for texts and some are wrong, so training is by turns: the passage of each positive
text that most looks like it (at first by how its words are spread over positive and other
texts, then by the model) is a positive example; passages of the other texts are negative
ones.  Positive texts without such a passage, and negative passages that the model is
sure of, are left out of the next turn as probably mislabelled.  Thresholds are chosen by
language on labelled texts, drawn to the common one where a language has few.

Training takes at most ``LABELLED`` labelled and ``UNLABELLED`` other texts, drawn by a hash of
their id; every text is scored whole.

Defined results: null, empty and wordless texts score 0; without any positive label all
texts score 0; repeated ids come once with their highest score; texts of any length are handled whole.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import arrow_map
from lodestrata.llm.language import label_language

#: Labelled and unlabelled texts that training takes, at most about.
LABELLED = 4000
UNLABELLED = 2500
SLOTS, DIM, FILTERS, WIDTHS = 1 << 14, 16, 20, (1, 2, 3, 4)
#: Negative passages that a turn trains on, at most.
NEGATIVE = 6000
#: Log odds that a passage of a positive text must have to be its first example.
ODD = 1.2
#: Words that a passage has, at most; longer ones are cut into overlapping windows.
WINDOW, STEP = 60, 50
#: Passages of fewer words are scored with their neighbour.
SHORT = 4
#: Words scored at once; their filter maps should fit a cache.
BATCH = 2000

_QUOTE = re.compile(r"(?m)^[ \t]*(?:[>|][ \t]*)+")
_BREAK = re.compile(r"(?<=[.!?…])[\"”»’')\]]*\s+|\n[ \t]*\n|\n(?=\s*(?:[-*•]|\[\d\d:|\d+[.,;]))|;\s")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ ._*-]){3,}[^\W\d_](?![^\W_])")
_TOKEN = re.compile(r"[^\W_][\w@$*+!|’']*[^\W_]|[^\W_]|[?!]{1}")
_RUN = re.compile(r"(.)\1{2,}")
_LEET = str.maketrans("013457@$!|+", "oieastasiit")
_DIGITS = re.compile(r"\d")
_ALPHA = re.compile(r"[^\W\d_]")


def _norm(token: str) -> str:
    t = _RUN.sub(r"\1", token.lower())
    if not t.isalpha():
        if _ALPHA.search(t):
            letters = sum(c.isalpha() for c in t)
            t = t.translate(_LEET) if letters * 2 >= len(t) and len(t) > 2 else "#a"
            t = t.replace("*", "").replace("'", "").replace("’", "")
        elif _DIGITS.search(t):
            t = "#"
    return t


def passages(text: str | None) -> list[list[str]]:
    """Normalised words of each passage of a text."""
    if not text:
        return []
    text = _QUOTE.sub("", text)
    text = _SPACED.sub(lambda m: re.sub(r"[ ._*-]", "", m.group()), text)
    out = []
    for p in _BREAK.split(text):
        ws = _TOKEN.findall(p)
        if not ws:
            continue
        if out and len(out[-1]) < SHORT and len(ws) <= WINDOW:
            out[-1] = out[-1] + ws
        elif out and len(ws) < SHORT and len(out[-1]) < WINDOW:
            out[-1] = out[-1] + ws
        elif len(ws) <= WINDOW:
            out.append(ws)
        else:
            out += [ws[i : i + WINDOW] for i in range(0, len(ws) - WINDOW + STEP, STEP)]
    return out


class Slots:
    """Hash slots of normalised words, kept up to a bounded number."""

    def __init__(self, most: int = 300_000):
        self.known: dict[str, int] = {}
        self.most = most

    def __call__(self, words: Sequence[str]) -> list[int]:
        if len(self.known) > self.most:
            self.known.clear()
        get, new = self.known.get, self._new
        return [get(w) or new(w) for w in words]

    def _new(self, word: str) -> int:
        i = self.known[word] = 1 + xxhash.xxh64_intdigest(_norm(word)) % (SLOTS - 1)
        return i


def pack(chunks: Sequence[Sequence[int]]) -> np.ndarray:
    """The chunks as rows, each followed by zeros enough for the widest filter."""
    size = np.fromiter(map(len, chunks), np.int64, len(chunks))
    out = np.zeros((len(chunks), int(size.max(initial=0)) + max(WIDTHS) - 1), np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = np.concatenate([np.asarray(c, np.int64) for c in chunks]) if len(chunks) else []
    return out


@dataclass
class Net:
    emb: np.ndarray
    filters: list[np.ndarray]  # width x (DIM, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: float = 0.0
    thresholds: dict = field(default_factory=dict)
    blank: bool = False
    _table: np.ndarray | None = None

    @staticmethod
    def new(seed: int = 7) -> Net:
        r = np.random.default_rng(seed)
        emb = r.normal(0, 0.3, (SLOTS, DIM)).astype(np.float32)
        emb[0] = 0
        filters = [r.normal(0, (2 / (w * DIM)) ** 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        return Net(emb, filters, np.zeros((len(WIDTHS), FILTERS), np.float32), r.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), -1.0)

    def table(self) -> np.ndarray:
        """What each slot adds to each filter at each of its places; computed once for a net that is trained."""
        if self._table is None:
            self._table = self.emb @ np.concatenate([f.transpose(1, 0, 2).reshape(DIM, -1) for f in self.filters], axis=1)
        return self._table

    def maps(self, every: np.ndarray) -> list[np.ndarray]:
        """Values of the filters of each width at each word; (rows, words, FILTERS)."""
        out, at, n = [], 0, every.shape[1] - max(WIDTHS) + 1
        for w in WIDTHS:
            y = every[:, :n, at : at + FILTERS]
            for j in range(1, w):
                y = y + every[:, j : n + j, at + j * FILTERS : at + (j + 1) * FILTERS]
            out.append(y)
            at += w * FILTERS
        return out

    def score(self, chunks: Sequence[Sequence[int]]) -> np.ndarray:
        """Of each chunk; those of like length are scored together, so many that their maps fit a cache."""
        out = np.zeros(len(chunks))
        if not len(chunks) or self.blank:
            return out
        table = self.table()
        order = sorted(range(len(chunks)), key=lambda i: len(chunks[i]))
        at = 0
        while at < len(order):
            to = at + 1
            while to < len(order) and (to - at + 1) * (len(chunks[order[to]]) + 3) <= BATCH:
                to += 1
            own = order[at:to]
            top = np.concatenate([y.max(axis=1) for y in self.maps(table[pack([chunks[i] for i in own])])], axis=1)
            out[own] = 1 / (1 + np.exp(-(np.maximum(np.maximum(top, 0) + self.bias.ravel(), 0) @ self.out + self.out_bias)))
            at = to
        return out

    def train(self, chunks: list[list[int]], y: np.ndarray, weight: np.ndarray, epochs: int, rate: float = 0.004, seed: int = 3) -> Net:
        """Adam over mini-batches; gradients flow through the greatest value of each filter."""
        r = np.random.default_rng(seed)
        self._table = None
        rows = pack(chunks)
        length = np.fromiter(map(len, chunks), np.int64, len(chunks))
        params = [self.emb, *self.filters, self.bias, self.out]
        first = [np.zeros_like(p) for p in params[1:]]
        second = [np.zeros_like(p) for p in params[1:]]
        g_emb = np.zeros_like(self.emb)  # second moments of rows
        step = 0
        size = 256
        for epoch in range(epochs):
            order = r.permutation(len(chunks))
            parts = [order[i : i + 8 * size] for i in range(0, len(order), 8 * size)]  # a batch has chunks of like length
            batches = [q[i : i + size] for part in parts for q in (part[np.argsort(length[part], kind="stable")],) for i in range(0, len(q), size)]
            for pick in (batches[i] for i in r.permutation(len(batches))):
                ids = rows[pick, : int(length[pick].max()) + max(WIDTHS) - 1]
                if epoch:
                    ids = ids * (r.random(ids.shape) > 0.08)
                flat = self.emb[ids].reshape(-1, DIM)
                w_all = np.concatenate([f.transpose(1, 0, 2).reshape(DIM, -1) for f in self.filters], axis=1)
                maps = self.maps((flat @ w_all).reshape(*ids.shape, -1))
                pos = [y_.argmax(axis=1) for y_ in maps]
                top = np.concatenate([np.take_along_axis(y_, p[:, None], axis=1)[:, 0] for y_, p in zip(maps, pos)], axis=1)
                hidden = np.maximum(np.maximum(top, 0) + self.bias.ravel(), 0)  # beyond its words a chunk has zeros
                keep = (r.random(hidden.shape[1]) > 0.25).astype(np.float32) / 0.75
                z = (hidden * keep) @ self.out + self.out_bias
                err = ((1 / (1 + np.exp(-z)) - y[pick]) * weight[pick] / len(pick)).astype(np.float32)
                g_out = (hidden * keep).T @ err
                g_hidden = np.outer(err, self.out * keep) * (hidden > 0)
                g_filters = [np.zeros_like(f) for f in self.filters]
                b = np.arange(len(pick))[:, None]
                hit, back = [], []
                for k, w in enumerate(WIDTHS):
                    g = g_hidden[:, k * FILTERS : (k + 1) * FILTERS] * (top[:, k * FILTERS : (k + 1) * FILTERS] > 0)
                    for j in range(w):
                        slot = ids[b, pos[k] + j]  # one place for each chunk and filter
                        g_filters[k][j] = np.einsum("bf,bfd->df", g, self.emb[slot])
                        hit.append(slot.ravel())
                        back.append((g[:, :, None] * self.filters[k][j].T[None]).reshape(-1, DIM))
                g_bias = g_hidden.sum(axis=0).reshape(self.bias.shape)
                step += 1
                for p, g, m, s in zip(params[1:], [*g_filters, g_bias, g_out], first, second):
                    g = g + 1e-5 * p
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-7)
                slots, inv = np.unique(np.concatenate(hit), return_inverse=True)
                g_x = np.concatenate(back)
                g_rows = np.stack([np.bincount(inv, g_x[:, i], len(slots)) for i in range(DIM)], axis=1).astype(np.float32)
                g_emb[slots] += g_rows * g_rows
                self.emb[slots] -= 0.05 * g_rows / (np.sqrt(g_emb[slots]) + 1e-6)
                self.emb[0] = 0
                self.out_bias -= rate * float(err.sum()) * 5
        self._table = None
        return self


def _surprise(docs: list[list[list[int]]], labels: np.ndarray) -> dict[int, float]:
    """Log odds of each slot's share of positive texts against its share of all others."""
    pos, neg = Counter(), Counter()
    for d, y in zip(docs, labels):
        (pos if y == 1 else neg).update({i for p in d for i in p})
    n_pos, n_neg = max(1, int((labels == 1).sum())), max(1, int((labels != 1).sum()))
    return {i: float(np.log((pos[i] + 0.5) / (n_pos + 1)) - np.log((neg[i] + 2) / (n_neg + 4))) for i in pos}


def fit(rows: list[tuple[str | None, str | None, float | None]]) -> Net:
    """A net from (text, language, label) rows; label None for unlabelled texts."""
    slots = Slots()
    docs = [[slots(p) for p in passages(t)] for t, _, _ in rows]
    label = np.array([-1.0 if y is None else y for _, _, y in rows])
    lang = [label_language(g) for _, g, _ in rows]
    net = Net.new()
    sure = np.where(label > 0.5, 1, np.where(label < 0, -1, 0))  # a tie counts as no label below
    sure[label == 0.5] = -2
    if not (sure == 1).any():
        net.blank = True
        return net
    odds = _surprise(docs, sure)

    def rough(p: list[int]) -> float:
        best = sorted((odds.get(i, 0.0) for i in set(p)), reverse=True)[:4]
        return sum(best) / (len(best) + 1)

    skip: set[tuple[int, int]] = set()
    extra: list[list[int]] = []
    chosen = {int(d): max(range(len(docs[d])), key=lambda i: rough(docs[d][i])) for d in np.flatnonzero(sure == 1) if docs[d]}
    chosen = {d: i for d, i in chosen.items() if rough(docs[d][i]) >= ODD and len(docs[d][i]) >= 3}
    for turn in range(3):
        if not chosen:
            net.blank = True
            return net
        good = [docs[d][i] for d, i in chosen.items()] + extra
        seen: dict[tuple, float] = defaultdict(float)
        for d in np.flatnonzero((sure == 0) | (sure == -1)):
            for i, p in enumerate(docs[d]):
                if (d, i) not in skip and len(p) > 1:
                    seen[tuple(p)] += 1.0 if sure[d] == 0 else 0.5
        alike = {tuple(p) for p in good}
        bad = sorted(seen, key=lambda p: (p not in alike and seen[p] < 3, xxhash.xxh64_intdigest(repr(p))))[:NEGATIVE]
        chunks = good + [list(p) for p in bad]
        y = np.array([1.0] * len(good) + [0.0] * len(bad), np.float32)
        often = [min(20.0, seen[p]) for p in bad]
        w = np.array([min(8.0, max(1.0, 0.2 * sum(often) / len(good)))] * len(good) + often, np.float32)
        net = Net.new(7 + turn).train(chunks, y, w, 6 if turn < 2 else 10)
        if turn == 2:
            break
        scores = [net.score(d) if d else np.zeros(0) for d in docs]
        chosen = {}
        skip, extra = set(), []
        for d, s in enumerate(scores):
            if not len(s):
                continue
            i = int(s.argmax())
            if sure[d] == 1 and s[i] > 0.5:
                chosen[d] = i
                extra += [docs[d][j] for j in np.flatnonzero(s > 0.9) if j != i]
            elif sure[d] != 1:
                high = np.flatnonzero(s > (0.5 if sure[d] == -1 else 0.97))
                skip |= {(d, int(j)) for j in high}
                if sure[d] == -1:
                    extra += [docs[d][j] for j in np.flatnonzero(s > 0.95)]
    best = np.array([net.score(d).max() if d else 0.0 for d in docs])
    net.thresholds = _thresholds(best, sure, lang)
    return net


def _thresholds(score: np.ndarray, label: np.ndarray, lang: list[str | None]) -> dict:
    """By language the threshold of the best F1 on labelled texts, drawn to the common one; None has the common one."""
    grid = np.linspace(0.1, 0.95, 35)

    def best(at: np.ndarray, toward: float | None) -> float:
        s, y = score[at], label[at] == 1
        f1 = np.array([2 * (y & (s >= g)).sum() / max(1, y.sum() + (s >= g).sum()) for g in grid])
        good = grid[f1 >= f1.max() - 0.01]  # labels are noisy: near the best, the middle is safer
        own = float(good[np.abs(good - (0.5 if toward is None else toward)).argmin()])
        n = int(y.sum())
        return own if toward is None else (n * own + 30 * toward) / (n + 30)

    known = label >= 0
    common = best(np.flatnonzero(known), None)
    out: dict = {None: common}
    for g in {x for x in lang if x}:
        at = np.flatnonzero(known & np.array([x == g for x in lang]))
        out[g] = best(at, common) if len(at) else common
    return out


def trained(docs: DataFrame, doc_id: str, text: str, lang: str, labels: DataFrame, label: str) -> Net:
    """A net trained on a bounded sample of labelled and other texts, the same ones at every run."""
    share = lambda c: F.xxhash64(c).bitwiseAND(F.lit((1 << 30) - 1)) / (1 << 30)
    judged = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(doc_id).agg(F.avg(label).alias("y"))
    n = judged.count()
    judged = judged.where(share(doc_id) < LABELLED / max(n, 1)).limit(2 * LABELLED)
    few = F.broadcast(judged.withColumnRenamed(doc_id, "_id"))  # at most 2 * LABELLED rows
    there = docs.select(doc_id).count()
    rows = docs.select(doc_id, text, lang).join(few, F.col(doc_id) == F.col("_id"), "left").where(F.col("y").isNotNull() | (share(doc_id) < UNLABELLED / max(there, 1)))
    got = rows.select(doc_id, text, lang, "y").limit(2 * (LABELLED + UNLABELLED)).collect()
    return fit([(r[1], r[2], r[3]) for r in sorted(got, key=lambda r: (r[0] is None, r[0]))])


def scores(docs: DataFrame, doc_id: str, text: str, lang: str, net: Net) -> DataFrame:
    """(doc_id, score, flagged) of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def make():
        model, slots = shared.value, Slots()

        def f(b):
            chunks, owner = [], []
            for d, t in enumerate(b[text]):
                for p in passages(t):
                    chunks.append(slots(p))
                    owner.append(d)
            best = np.zeros(len(b[text]))
            np.maximum.at(best, owner, model.score(chunks))
            cuts = [model.thresholds.get(label_language(g), model.thresholds.get(None, 1.0)) for g in b[lang]]
            return {doc_id: b[doc_id], "score": best, "flagged": (best >= np.array(cuts)) & (best > 0)}

        return f

    each = arrow_map(docs.select(doc_id, text, lang), make, f"{doc_id} {dict(docs.dtypes)[doc_id]}, score double, flagged boolean")
    return each.groupBy(doc_id).agg(F.max("score").alias("score"), F.max("flagged").alias("flagged"))


def rates(docs: DataFrame, doc_id: str, source: str, scored: DataFrame) -> DataFrame:
    """(source, n, n_flagged, rate); counts are pre-aggregated, so a hot source is no burden."""
    return (
        docs.select(doc_id, source).distinct().join(scored, doc_id).groupBy(source)
        .agg(F.count("*").alias("n"), F.count_if("flagged").alias("n_flagged"), F.avg(F.col("flagged").cast("double")).alias("rate"))
    )
