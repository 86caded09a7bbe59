"""Language of each text and of each stretch of a mixed text, by segmentation-marginalised unigrams.

A word, with the blank before it, is any sequence of pieces of a fixed public vocabulary.
Each language has a probability for every piece; a word's score in a language is the sum over
all its segmentations of the product of their pieces, found by the forward algorithm.
Probabilities are fitted by expectation maximisation on a bounded sample of labelled texts
(``SAMPLE`` per language); texts that the first fit puts into another language than their
label are left out of the second.

Words are scored once and kept.  Units, the stretches between line ends and sentence ends, are
labelled by the best path with a cost for each change of language.  Stretches in one
language of fewer than 40 characters are dropped and equal neighbours then merged.  Capitalised words that aren't known from one
language may be names; they count where a unit has no others and together they are of one language.  A stretch whose words are far less
probable in its language than those of any labelled text of it is in another language, ``OTHER``.  Confidences are those
of a logistic curve over the lead of the best language, fitted on the units of labelled texts.

Defined results: null, empty and wordless texts have no segments; words with digits, and bare
header labels, belong to no language; words and texts of any length are handled whole; repeated rows of one
id count once.
"""

from __future__ import annotations

import base64
import os
import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import arrow_map

LANGUAGES = ["en", "de", "fr", "es", "pl"]
#: Labelled texts per language that the model is fitted on, at most.
SAMPLE = 600
#: Word types per language that it is fitted on, at most.
TYPES = 6000
#: Cost of a change of language, in nats.
CHANGE = 7.0
LEAST = 40
#: What one word counts for at most, in nats: one that may be a name, any other. What a stretch of such words only must come to.
NAME, WORD, NAMES = 1.0, 12.0, 3.0
#: A language of none of the labels.
OTHER = "und"
VOCABULARY = os.environ.get("LODESTRATA_PIECES", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")

#: Usual spellings of languages, without region.
SPELLINGS = {
    "en": "en eng english englisch anglais inglés angielski",
    "de": "de deu ger german deutsch allemand alemán niemiecki",
    "fr": "fr fra fre french französisch français francés francuski",
    "es": "es spa spanish spanisch espagnol español castellano hiszpański",
    "pl": "pl pol polish polnisch polonais polaco polski",
}
_BY_SPELLING = {w: lang for lang, ws in SPELLINGS.items() for w in ws.split()}
_TOKENS = re.compile(r"\S{0,80}[@\d]\S*|[^\W\d_]+(?:[’'][^\W\d_]+)*|[\n.!?;:]")
_HEADER = re.compile(r"^[ \t>|]*[^\W\d_]{1,16}[ ]?:(?=\s)", re.M)


def label_language(label: str | None) -> str | None:
    """Two-letter code that a label stands for; None if it names none of the languages."""
    return _BY_SPELLING.get(re.split(r"[-_ (]", label.strip().lower())[0]) if label else None


def vocabulary(path: str = VOCABULARY) -> list[bytes]:
    with open(path, "rb") as f:
        pieces = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    return pieces + [bytes([b]) for b in range(256) if bytes([b]) not in set(pieces)]


class Model:
    """Log probabilities of pieces by language, and the forward algorithm over words."""

    def __init__(self, pieces: Iterable[bytes], languages: list[str]):
        self.pieces = {p: i for i, p in enumerate(pieces) if len(p) == 1 or p == p.lower() and not any(c in b" \t\r\n" for c in p[1:])}
        self.longest = max(map(len, self.pieces))
        #: Least mean score of a character that texts of each language have, and how the lead of a language turns into confidence.
        self.floor = np.full(len(languages), -np.inf)
        self.curve = (0.0, 1.0)
        self.languages = languages
        #: Words that stand in texts of nearly one language only; other capitalised words may be names.
        self.own: set[str] = set()
        self.p = np.full((max(self.pieces.values()) + 1, len(languages)), 1.0 / len(self.pieces))

    def arcs(self, word: str) -> tuple[int, list[tuple[int, int, int]]]:
        """Length in bytes, and (from, to, piece) of each piece in the word, by end."""
        w = (" " + word.lower()).encode("utf-8", "replace")
        n, get, longest = len(w), self.pieces.get, self.longest
        return n, [(i, j, k) for j in range(1, n + 1) for i in range(max(0, j - longest), j) if (k := get(w[i:j])) is not None]

    def score(self, word: str) -> np.ndarray:
        """Log probability of the word in each language, all segmentations summed."""
        n, arcs = self.arcs(word)
        a = np.zeros((n + 1, len(self.languages)))
        a[0] = 1
        log, at, p = np.zeros(len(self.languages)), 0, self.p
        for i, j, k in arcs:
            if j > at and j % 32 == 0:  # long words: values are kept away from the least a number can be
                at = j
                top = np.maximum(a[max(0, j - self.longest) : j].max(axis=0), 1e-300)
                a[max(0, j - self.longest) : j] /= top
                log += np.log(top)
            a[j] += a[i] * p[k]
        return np.log(np.maximum(a[n], 1e-300)) + log

    def fit(self, counts: list[Counter], rounds: int = 3) -> Model:
        """Expectation maximisation; forward and backward sums run over the arcs of all words at once, by their ends."""
        kept = []
        for x in counts:
            types = x.most_common(TYPES)
            every = [self.arcs(w) for w, _ in types]
            arcs = np.array([(w, i, j, k) for w, (_, own) in enumerate(every) for i, j, k in own], np.int64).reshape(-1, 4)
            kept.append((np.array([n for n, _ in every], np.int64), np.array([c for _, c in types], float), arcs[np.argsort(arcs[:, 2], kind="stable")], arcs[np.argsort(arcs[:, 1], kind="stable")]))
        for _ in range(rounds):
            new = np.full(self.p.shape, 0.05)
            for lang, (n, c, by_end, by_begin) in enumerate(kept):
                if not len(n):
                    continue
                p, width = self.p[:, lang], int(n.max()) + 1
                a, b = np.zeros((len(n), width)), np.zeros((len(n), width))
                a[:, 0], b[np.arange(len(n)), n] = 1, 1
                bounds = np.searchsorted(by_end[:, 2], np.arange(width + 1))
                for j in range(1, width):
                    w, i, _, k = by_end[bounds[j] : bounds[j + 1]].T
                    a[:, j] = np.bincount(w, a[w, i] * p[k], len(n))
                bounds = np.searchsorted(by_begin[:, 1], np.arange(width + 1))
                for i in range(width - 1, -1, -1):
                    w, _, j, k = by_begin[bounds[i] : bounds[i + 1]].T
                    b[:, i] += np.bincount(w, p[k] * b[w, j], len(n))
                whole = a[np.arange(len(n)), n]
                share = np.divide(c, whole, out=np.zeros(len(n)), where=whole > 0)
                w, i, j, k = by_end.T
                new[:, lang] += np.bincount(k, a[w, i] * p[k] * b[w, j] * share[w], len(p))
            self.p = new / new.sum(axis=0)
        return self


def words(text: str) -> list[str]:
    return [t for t in _TOKENS.findall(_HEADER.sub("\n", text)) if t[0].isalpha() and not any(c.isdigit() or c == "@" for c in t)]


def fit(sample: Iterable[tuple[str, str]], path: str = VOCABULARY) -> Model:
    """A model fitted on (language, text) pairs, some of them labelled wrong."""
    sample = [(lang, words(text)) for lang, text in sample]
    pieces = vocabulary(path)

    def counted(rows) -> list[Counter]:
        counts = [Counter() for _ in LANGUAGES]
        for lang, ws in rows:
            counts[LANGUAGES.index(lang)].update(w.lower() for w in ws)
        return counts

    model = Model(pieces, LANGUAGES).fit(counted(sample), 2)
    known: dict[str, np.ndarray] = {}
    sure = []
    for lang, ws in sample:
        total = sum((known.get(w) if w in known else known.setdefault(w, model.score(w)) for w in ws), np.zeros(len(LANGUAGES)))
        if ws and LANGUAGES[int(total.argmax())] == lang:
            sure.append((lang, ws))
    counts = counted(sure)
    model = Model(pieces, LANGUAGES).fit(counts, 3)
    for w in set().union(*counts):
        n = [c[w] for c in counts]
        if max(n) >= 2 and max(n) >= 0.9 * sum(n):
            model.own.add(w)
    _calibrate(model, sure)
    return model


def _calibrate(model: Model, sure: list[tuple[str, list[str]]]) -> None:
    """The floors of languages and the curve of confidence, from texts whose label holds."""
    known: dict[str, tuple[np.ndarray, int]] = {}
    means: list[list[float]] = [[] for _ in LANGUAGES]
    leads, right = [], []
    for lang, ws in sure:
        k, rows = LANGUAGES.index(lang), []
        for w in ws:
            if w not in known:
                known[w] = model.score(w), 1 + len(w)
            if w[0].islower() or w.lower() in model.own:
                rows.append(known[w])
        if sum(n for _, n in rows) >= LEAST:
            means[k].append(sum(s[k] for s, _ in rows) / sum(n for _, n in rows))
        for at in range(0, len(rows), 4):  # about a unit each
            total = sum(s - s.max() for s, _ in rows[at : at + 4])
            leads.append(np.log1p(_lead(total)))
            right.append(int(total.argmax()) == k)
    for k, x in enumerate(means):
        if x:
            low, mid = np.quantile(x, [0.01, 0.5])  # the least ones may be damaged
            model.floor[k] = mid - 2.2 * (mid - low) - 0.2
    if leads:
        x, y = np.array(leads), np.array(right, float)
        a, b = 0.0, 1.0
        for _ in range(30):  # Newton steps, held back a little so that a perfect split has a curve as well
            p = 1 / (1 + np.exp(-(a + b * x)))
            g = np.array([(y - p).sum() - 0.01 * a, ((y - p) * x).sum() - 0.01 * (b - 1)])
            w = p * (1 - p) + 1e-6
            h = np.array([[w.sum() + 0.01, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 0.01]])
            a, b = np.array([a, b]) + np.clip(np.linalg.solve(h, g), -2, 2)
        model.curve = (float(a), float(b))


def _lead(score: np.ndarray) -> float:
    """How far the best language is before the next, in nats."""
    if len(score) < 2:
        return 0.0
    two = np.partition(score, -2)[-2:]
    return float(two[1] - two[0])


_BOUNDS = {c: -1 for c in "\n.!?;:"}


class Tagger:
    """Labels texts; scores of words are kept, up to a bounded number."""

    def __init__(self, model: Model, most: int = 200_000):
        self.model, self.most = model, most
        self.ids: dict[str, int] = dict(_BOUNDS)
        #: Of each word the lead of each language, then its score in each, and its length; a row's words that may be names are ``weak``.
        self.table = np.zeros((1024, 2 * len(model.languages) + 1))
        self.weak = np.zeros(1024, bool)

    def _new(self, token: str) -> int:
        """The row of a token that isn't kept yet: -1 for a bound, 0 for one of no language."""
        if not token[0].isalpha() or "@" in token or any(c.isdigit() for c in token):
            return 0
        if len(self.ids) >= self.most:
            self.ids.clear()
            self.ids.update(_BOUNDS)
        weak = token[0].isupper() and token.lower() not in self.model.own
        i = len(self.ids) + 1
        if i >= len(self.table):
            self.table = np.concatenate((self.table, np.zeros_like(self.table)))
            self.weak = np.concatenate((self.weak, np.zeros_like(self.weak)))
        s, k = self.model.score(token), len(self.model.languages)
        self.table[i, :k] = np.maximum(s - s.max(), -(NAME if weak else WORD))  # one word decides nothing
        self.table[i, k : 2 * k], self.table[i, 2 * k] = (0, 0) if weak else (s, 1 + len(token))
        self.weak[i] = weak
        self.ids[token] = i
        return i

    def segments(self, text: str | None) -> tuple[list[tuple[int, int, str, float]], np.ndarray]:
        """(start, end, language, confidence) of the stretches, and the text's score by language."""
        none = np.zeros(len(self.model.languages))
        if not text:
            return [], none
        text = _HEADER.sub(lambda m: "\n" + " " * (len(m.group()) - 1), text)
        tokens = _TOKENS.findall(text)
        get, new = self.ids.get, self._new
        ids = [i if (i := get(t)) is not None else new(t) for t in tokens]
        a = np.array(ids)
        at = np.flatnonzero(a > 0)
        if not len(at):
            return [], none
        k, unit = len(self.model.languages), np.cumsum(a == -1)
        weak = self.weak[a[at]]
        if weak.any():  # what may be names counts only where it stands alone and is of one language, as nouns are
            begin = np.flatnonzero(np.concatenate(([True], unit[at][1:] != unit[at][:-1])))
            size = np.diff(np.append(begin, len(at)))
            alone = np.flatnonzero(np.add.reduceat(~weak, begin, dtype=np.int64) == 0)
            if len(alone):
                sums = np.add.reduceat(self.table[a[at], :k], begin)[alone]
                alone = alone[[_lead(x) >= NAMES for x in sums]]
            kept = np.zeros(len(begin), bool)
            kept[alone] = True
            at = at[~weak | np.repeat(kept, size)]
            if not len(at):
                return [], none
        unit = unit[at]
        begin = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
        every = np.add.reduceat(self.table[a[at]], begin)
        scores = every[:, :k]
        total = scores.sum(axis=0)
        best = int(total.argmax())
        path = np.full(len(scores), best)
        if (scores.max(axis=1) - scores[:, best]).sum() > CHANGE:
            path = _path(scores)
        out: list[list] = []
        if (path == best).all():
            out = [[re.search(r"[^\W\d_]", text).start(), len(text.rstrip()), best, every.sum(axis=0)]]
        else:
            spans = [m.span() for m in _TOKENS.finditer(text)]
            ends = np.concatenate((begin[1:], [len(at)])) - 1
            for u, lang in enumerate(path):
                s, e = spans[at[begin[u]]][0], spans[at[ends[u]]][1]
                if out and out[-1][2] == lang:
                    out[-1][1], out[-1][3] = e, out[-1][3] + every[u]
                else:
                    out.append([s, e, lang, every[u]])
        kept: list[list] = []
        for s, e, lang, score in out:
            if e - s < LEAST:
                continue
            if kept and kept[-1][2] == lang:
                kept[-1][1], kept[-1][3] = e, kept[-1][3] + score
            else:
                kept.append([s, e, lang, score])
        return [(s, e, *self.named(lang, score)) for s, e, lang, score in kept], total

    def named(self, lang: int, score: np.ndarray) -> tuple[str, float]:
        """Code and confidence of a stretch; that of another language where its words are too improbable."""
        k = len(self.model.languages)
        own, n = score[k + lang], score[2 * k]
        if n >= LEAST and own / n < self.model.floor[lang]:
            return OTHER, 0.5
        return self.model.languages[lang], self.confidence(score[:k])

    def confidence(self, score: np.ndarray) -> float:
        a, b = self.model.curve
        return float(1 / (1 + np.exp(-np.clip(a + b * np.log1p(_lead(score)), -50, 50))))


def _path(scores: np.ndarray) -> np.ndarray:
    """Best languages of the units, with a cost for each change."""
    n, k = scores.shape
    back = np.zeros((n, k), np.int64)
    total = scores[0].copy()
    for u in range(1, n):
        best = int(total.argmax())
        moved = total[best] - CHANGE
        back[u] = np.where(total >= moved, np.arange(k), best)
        total = np.maximum(total, moved) + scores[u]
    path = np.zeros(n, np.int64)
    path[-1] = int(total.argmax())
    for u in range(n - 1, 0, -1):
        path[u - 1] = back[u, path[u]]
    return path


def fitted(df: DataFrame, key: str, text: str, label: str, path: str = VOCABULARY) -> Model:
    """A model fitted on up to SAMPLE labelled texts of each language, the same ones at every run."""
    code = F.create_map(*[F.lit(x) for w, lang in _BY_SPELLING.items() for x in (w, lang)])[F.regexp_extract(F.lower(F.trim(label)), r"^([^-_ (]*)", 1)]
    share = F.xxhash64(key).bitwiseAND(F.lit((1 << 20) - 1)) / (1 << 20)
    rows = df.select(share.alias("share"), code.alias("lang"), text).where(F.col("lang").isNotNull())
    there = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row per language
    least = F.create_map(*[x for lang, n in there.items() for x in (F.lit(lang), F.lit(SAMPLE / n))]) if there else None
    chosen = rows.where(F.col("share") < least[F.col("lang")]).limit(2 * SAMPLE * len(LANGUAGES)).select("lang", text).collect() if there else []
    return fit(((r[0], r[1]) for r in chosen), path)


def languages(df: DataFrame, key: str, text: str, label: str, model: Model) -> DataFrame:
    """(key, lang, confidence, segments, label_right) of each text; one row per key."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        tagger = Tagger(shared.value)

        def f(b):
            out: dict[str, list] = {c: [] for c in (key, "lang", "confidence", "segments", "label_right")}
            for k, t, lab in zip(b[key], b[text], b[label]):
                if k is None:
                    continue
                segments, total = tagger.segments(t)
                best = int(total.argmax())
                said = label_language(lab)
                out[key].append(k)
                most = max(segments, key=lambda x: x[1] - x[0], default=None)
                lang = most[2] if most and most[2] == OTHER else tagger.model.languages[best] if total.any() else None
                out["lang"].append(lang)
                out["confidence"].append((most[3] if lang == OTHER else tagger.confidence(total)) if total.any() else None)
                out["segments"].append([{"seg_no": i, "start_at": s + 1, "end_at": e, "lang": lang, "confidence": c} for i, (s, e, lang, c) in enumerate(segments, 1)])
                out["label_right"].append(bool(said and len(segments) <= 1 and (not segments or segments[0][2] == said)))
            return out

        return f

    schema = f"{key} {dict(df.dtypes)[key]}, lang string, confidence double, segments array<struct<seg_no bigint, start_at bigint, end_at bigint, lang string, confidence double>>, label_right boolean"
    return arrow_map(df.select(key, text, label), make, schema).dropDuplicates([key])
