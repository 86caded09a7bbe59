"""Texts cut off by a limit or a broken transfer.

1. Near-copies come from min-hash banding.  A cut copy has the beginning of the whole one, so the signatures are
   those of a text's beginnings of 16, 32, 64, ... words: ``BANDS`` bands of ``ROWS`` minima each.  A record asks with the
   bands of the longest such beginning it has, each joined with the hash of its last whole words, so that a
   bucket holds only texts that can be aligned at the record's end, however many are alike.  A pair is verified
   by the shingles of the stretch before that end, of which the copy must have at least half, and aligned by its last word; where
   the copy goes on within the word or sentence, the record ends early, whatever its own end looks like.
2. Records without such a copy are scored by terminality.  The shape of an ending is its punctuation, the kind of its
   last line and how its closing word stands to line ends in a sketch over all texts.  The shares of shapes among all
   ends, and among one place in each text where it might have been cut, give the probability that an
   ending of a shape was cut (the share of cut texts is the least ratio of the two).  Lengths at which texts pile up count as well.

Defined results: null and empty texts are not cut; texts that end with a signature, a list, a
table row or a short status phrase are complete unless a near-copy or the corpus shows otherwise; a text with a mark of
omission at its end is cut; repeated rows of one id count once.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import encoding
from lodestrata.llm.common import arrow_map, cut, stored
from lodestrata.llm.mail import CLOSING, NOTICES, fold
from lodestrata.llm.neardup import _named, buckets_for, filled, filter_bits
from lodestrata.llm.words import Words, blocks, mix, words_of

_U = np.uint64
#: Least buckets of the closing-word sketch, which grows with the input: words within lines, and words that close lines.
BUCKETS = 1 << 19
#: A count is no chance if a Poisson count of its mean is so far off, or farther, with a probability under exp(-x): of a
#: word's line ends, and of a length, of which there are many. It must also differ from the mean by a factor.
SURE_WORD, SURE_LENGTH = 8, 21
FEW, MANY = 1 / 20, 5
CHUNK = 1 << 13
#: Bands of a signature, and minima of each; words of its shortest beginning.
BANDS, ROWS, FIRST = 8, 3, 16
#: Words of a shingle; words of the stretch before the end that a near-copy has at least half of, and words by which the
#: near-copy's may be longer; characters after the last word that show how it goes on.
SHINGLE, STRETCH, SLACK, AFTER = 3, 64, 16, 24
#: Whole words before the last that are looked up.
K = 5
#: Texts of a shape that the product of its parts counts for; share of the possible cuts whose shapes tell how many texts are cut;
#: probability from which a text counts as cut: texts aren't cut evenly at all possible places, so shapes of cut ones differ by a factor.
PRIOR, SURE, LEAST = 1.0, 0.3, 0.15

_MARK = re.compile(r"(?:…|\.\.\.|\[(?:…|\.\.\.)\]|\((?:…|\.\.\.)\)|\[?(?:truncated|cut|gekürzt|abgeschnitten|tronqué|truncado|obcięto|ucięto)\]?|>>+|\[\+\d+ [^\]]{1,12}\])\s*$", re.I)
_END = re.compile(r"[.!?。][\"”“»’')\]]*$|[”»\"]$")
_ABBREVIATED = re.compile(r"(?:\b(?:no|nr|n|dr|mr|mrs|ms|ul|al|pl|str|str|sra?|mme|prof|ca|bzw|z|tel|ref|vol|st)\.|n\.º|n°|nº|(?<![\d.])\d{1,3}\.\d{1,3}\.(?:\d{1,3}\.)?)$", re.I)
_BULLET = re.compile(r"^\s*(?:[-*•–+]|->|--|\d{1,2}[.)])\s+\S")
_QUOTES = re.compile(r"^[ \t>|]+")
_LABEL = re.compile(r"^[^\W\d_][\w .ęó-]{0,22}\s?:\s*\S")
_TALK = re.compile(r"^\[\d\d:\d\d\] [^:]{2,40}: ")
_RULER = re.compile(r"^\s*(?:--|__|~~+|==+|\* \* \*)\s*$")
_NOTICE = re.compile(r"\W*(?:" + "|".join(re.escape(fold(x)) for x in NOTICES) + ")")
_ADDRESS = re.compile(r"[\w.+%-]+@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}\W*$")
_PRICE = re.compile(r"\d+[.,]\d\d$")
_SENTENCE = re.compile(r"[.!?][\"”’)]?\s")
_MASK = re.compile(r"\b(?=\w*\d)\w+\b")


def closing_counts(df: DataFrame, text: str) -> np.ndarray:
    """(2, buckets): how often words of each hash bucket stand within a line, and how often they close one."""
    df = df.select(text)
    width = max(BUCKETS, buckets_for(df))

    def make():
        total = np.zeros(2 * width, np.int32)

        def f(b):
            for x, y in blocks(b[text]):
                w = words_of(b[text][x:y])
                inner = np.ones(len(w.hash), bool)
                last = w.first[1:][np.diff(w.first) > 0] - 1  # the last word may be cut
                inner[last] = False
                slot = (w.hash % _U(width)).astype(np.int64) + np.where(w.closes, width, 0)
                np.add.at(total, slot[inner], 1)

        def end():
            parts = total.reshape(-1, CHUNK)
            some = np.flatnonzero(parts.any(axis=1))
            return {"chunk": some.tolist(), "counts": [parts[i].tobytes() for i in some]}

        f.end = end
        return f

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CHUNK, np.int64)
        for batch in batches:
            for x in batch.column("counts").to_pylist():
                total += np.frombuffer(x, np.int32)
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([key[0].as_py()], pa.int32()), "counts": [np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()]})

    out = np.zeros(2 * width, np.int32)
    summed = arrow_map(df, make, "chunk int, counts binary").groupBy("chunk").applyInArrow(add, "chunk int, counts binary")
    for row in summed.collect():  # 2 * width / CHUNK rows at most
        out[row.chunk * CHUNK : (row.chunk + 1) * CHUNK] = np.frombuffer(row.counts, np.int32)
    return out.reshape(2, width)


def pile_ups(sized: DataFrame) -> DataFrame:
    """(unit, n, who) of the lengths, in characters or bytes, of far more texts than the lengths around them let
    expect, so many that it is no chance; ``who`` is null for a length of all texts, else the source whose texts pile up.

    ``sized`` has (alike, source, chars, bytes) of the texts without an end mark. Texts that are ``alike``, equal
    but for their digits, have one length without any limit and count once.
    """
    who = F.array_distinct(F.array(F.lit(None).cast("string"), F.col("source").cast("string")))
    one = sized.select("alike", F.explode(who).alias("who"), "chars", "bytes").distinct()
    one = one.select("who", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("n")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("n")))).alias("x")).select("who", "x.*")
    counts = cut(one.groupBy("who", "unit", "n").count())
    near = counts.select("who", "unit", F.explode(F.sequence(F.col("n") - 10, F.col("n") + 10)).alias("n"), F.col("count").alias("c"), F.col("n").alias("own"))
    around = near.where("n != own").groupBy("who", "unit", "n").agg(F.sum("c").alias("c")).alias("a")
    usual = (F.coalesce("a.c", F.lit(0)) + 1) / 20
    c = F.col("count")
    many = counts.where("count > 1").alias("m")
    out = many.join(around, F.col("m.who").eqNullSafe(F.col("a.who")) & (F.col("m.unit") == F.col("a.unit")) & (F.col("m.n") == F.col("a.n")), "left").where((c >= MANY * usual) & (c * F.log(c / usual) - c + usual >= SURE_LENGTH))
    return out.select("m.unit", "m.n", "m.who")


def surprise(count: int, mean: float) -> float:
    """A Poisson count of this mean is as far off, on its side, with a probability of at most exp(-surprise)."""
    return mean - count + (count * math.log(count / mean) if count else 0.0)


class Shapes:
    """Shapes of endings: 'mark', or punctuation, kind of the last line and closing word."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.known: dict[str, tuple[int, int]] = {}
        self.usual = float(counts[1].sum(dtype=np.int64)) / max(1, int(counts.sum(dtype=np.int64)))  # share of words that close a line

    def seen(self, word: str) -> tuple[int, int]:
        """How often the word stands within a line, and how often it closes one."""
        got = self.known.get(word)
        if got is None:
            h = words_of([word]).hash
            i = int(h[0] % _U(self.counts.shape[1])) if len(h) == 1 else -1
            got = (int(self.counts[0, i]), int(self.counts[1, i])) if i >= 0 else (0, 0)
            if len(self.known) >= 100_000:  # bounded memory
                self.known.clear()
            self.known[word] = got
        return got

    def closing(self, last: str, less: tuple[int, int] = (0, 0)) -> str:
        """How the closing word stands to line ends: no word, a new one, one that never closes a line, some or often."""
        end = len(last)
        while end and not (last[end - 1].isalnum() or last[end - 1] == "_"):
            end -= 1
        at = end
        while at and last[at - 1].isalpha():
            at -= 1
        if at == end:
            return "none"
        inner, closing = (max(0, a - b) for a, b in zip(self.seen(last[at:end]), less))
        n = inner + closing
        if not n:
            return "new"
        if closing >= self.usual * n:
            return "often"
        return "some" if closing >= FEW * self.usual * n or surprise(closing, n * self.usual) < SURE_WORD else "never"

    def shape(self, text: str, less: tuple[int, int] = (0, 0)) -> str:
        end = text.rstrip()
        if not end:
            return ""
        if _MARK.search(end, max(0, len(end) - 40)):
            return "mark"
        lines = end.rsplit("\n", 12)
        if len(lines) > 12:
            lines = lines[1:]
        lines = [_QUOTES.sub("", x).rstrip() for x in lines]
        last = lines[-1]
        return f"{self._point(last)} {self._kind(lines)} {self.closing(last, less)}"

    def _point(self, last: str) -> str:
        """What the ending's punctuation says."""
        sentence = _SENTENCE.split(last)[-1]
        short = bool(_ABBREVIATED.search(last, max(0, len(last) - 60)))
        if last[:1] in "{[" and (last.count("{") > last.count("}") or last.count("[") > last.count("]") or last.count('"') % 2):
            return "unclosed"
        opened = sentence.count("(") > sentence.count(")")
        if _END.search(last, max(0, len(last) - 60)) and not short and not opened:
            return "end"
        if opened:
            return "opened"
        if short:
            return "short"
        if last[-1:] in ",(/–-;:&@=+" and last:
            return "rule" if last[-1] in ":;-" and len(last) < 40 and not last[-2:-1].isalnum() else "joiner"
        token = last.split()[-1] if last.split() else ""
        if "@" in token[1:] and not _ADDRESS.search(token) and not token.startswith("@"):
            return "address"
        return "word"

    def _kind(self, lines: list[str]) -> str:
        """What the last line is."""
        last = lines[-1]
        if len(last) < 80 and _NOTICE.match(fold(_sound(last))):
            return "notice"
        if _BULLET.match(last):
            return "item"
        for sep in (";", ",", "\t", "|"):  # a table row
            n = last.count(sep)
            if n >= 2 and len(lines) > 1 and lines[-2].count(sep) >= 2 and not lines[-2].rstrip().endswith((".", "!", "?")) and (len(last.split()) <= 3 * (n + 1)):
                ends = [x.rsplit(sep, 1)[-1] for x in lines[:-1] if x.count(sep) == n][1:]
                prices = len(ends) >= 2 and all(_PRICE.match(x) for x in ends)
                return "part of a row" if n < lines[-2].count(sep) or prices and not _PRICE.match(last.rsplit(sep, 1)[-1]) else "row"
        for back, line in enumerate(reversed(lines[:-1])):  # a signature
            if _RULER.match(line) or len(line) < 60 and CLOSING.match(fold(_sound(line))):
                return "after a signature" if back > 8 else "signature"
            if not line or len(line) > 60 or _END.search(line):
                break
        if _TALK.match(last):
            return "talk"
        if _LABEL.match(last) and len(last.split()) <= 7:
            return "field"
        above = lines[-2] if len(lines) > 1 else ""
        if len(above) > 40 and not _END.search(above) and not _BULLET.match(above):
            return "wrapped"
        n = len(last.split())
        return "phrase" if len(lines) == 1 and n < 8 else "prose" if n >= 5 else "few words"

    def possible(self, text: str) -> str:
        """The shape of the text cut at one place of its last seven tenths, always the same one."""
        u = zlib.crc32(text.encode("utf-8", "surrogatepass")) / 2**32
        at = int(len(text) * (0.3 + 0.7 * u))
        part = text[:at].rstrip()
        if len(part) < 3 or at >= len(text):
            return ""
        end = len(part)
        whole = not text[end : end + 1].isalnum()  # then the word itself was counted
        return self.shape(part, ((0, 1) if text[end : end + 1] == "\n" else (1, 0)) if whole else (0, 0))


def _sound(line: str) -> str:
    return line if line.isascii() else encoding.restore(line)[1]


def cut_shapes(ends: Counter, possible: Counter) -> dict[str, float]:
    """Probability that a text with an ending of each shape was cut; from the shapes of all ends and of possible cuts.

    A shape's count is drawn to the product of its parts' shares, which hold where a shape is rare.
    """
    ends, possible = ({k: v for k, v in c.items() if k and k != "mark"} for c in (ends, possible))
    shapes = sorted({*ends, *possible})
    if not shapes or not possible or not ends:
        return {}

    def shares(c: dict) -> dict:
        total = sum(c.values())
        parts = [Counter() for _ in range(3)]
        split = {s: (s.split(" ", 1)[0], s.split(" ", 1)[1].rsplit(" ", 1)[0], s.rsplit(" ", 1)[1]) for s in shapes}
        for s, n in c.items():
            for p, x in zip(parts, split[s]):
                p[x] += n
        free = {s: math.prod((p[x] + 0.5) / (total + 0.5 * 6) for p, x in zip(parts, split[s])) for s in shapes}
        return {s: (c.get(s, 0) + PRIOR * free[s]) / (total + PRIOR) for s in shapes}

    p_end, p_cut = shares(ends), shares(possible)
    mass, above = 0.0, 0.0
    for s in sorted(shapes, key=lambda s: p_end[s] / p_cut[s]):
        mass, above = mass + p_cut[s], above + p_end[s]
        if mass >= SURE:
            break
    part = above / mass  # of the texts that are cut
    return {s: min(1.0, part * p_cut[s] / p_end[s]) for s in shapes}


def _stretches(w: Words) -> Callable[[int, int, int], bytes]:
    """Shingles of at most so many words of a text before a word."""
    g = np.zeros(max(0, len(w.hash) - SHINGLE + 1), _U)
    for i in range(SHINGLE):
        g = g * _U(0x9E3779B97F4A7C15) + w.hash[i : i + len(g)]
    g = (mix(g) >> _U(48)).astype(np.uint16)
    return lambda d, to, most: g[max(int(w.first[d]), to - most) : max(0, to - SHINGLE + 1)].tobytes()


def bands(w: Words, first: int = FIRST) -> np.ndarray:
    """(levels, texts, BANDS): the bands of the beginnings of first, 2 first, 4 first, ... words of each text.

    A minimum is that of the pairs of words whose hash falls in one of the bins; an empty bin has that of the next one. Shorter
    beginnings are carried on, so that the work is that of one pass.
    """
    n_texts, bins = len(w.first) - 1, BANDS * ROWS
    n = np.diff(w.first)
    g, at = w.shingles(2)
    d = w.doc[at]
    reach = at - w.first[d] + 2
    none = _U(np.iinfo(np.uint64).max)
    least = np.full(n_texts * bins, none)
    slot = d * bins + ((g >> _U(40)) % _U(bins)).astype(np.int64)
    value = mix(g) >> _U(1)
    order = np.argsort(reach, kind="stable")
    slot, value, reach = slot[order], value[order], reach[order]
    out, size, done, top = [], first, 0, int(n.max()) if n_texts else 0
    while size <= max(top, first):
        to = int(np.searchsorted(reach, size, side="right"))
        np.minimum.at(least, slot[done:to], value[done:to])
        done = to
        full = least.reshape(n_texts, bins).copy()
        for _ in range(bins):
            empty = full == none
            if not empty.any() or empty.all():
                break
            full = np.where(empty, np.where(np.roll(full, -1, axis=1) == none, none, mix(np.roll(full, -1, axis=1)) >> _U(1)), full)
        band = np.full((n_texts, BANDS), _U(len(out) * 0x632BE59BD9B4E019 % 2**64))
        for i in range(ROWS):
            band = mix(band * _U(0x9E3779B97F4A7C15) + full[:, i::ROWS])
        out.append(band + np.arange(BANDS, dtype=_U))
        size *= 2
    return np.stack(out)


def _level(n: np.ndarray, first: int = FIRST) -> np.ndarray:
    """Number of the longest beginning that n words have; -1 for none."""
    return np.where(n >= first, np.frexp(np.maximum(n, 1) / first)[1] - 1, -1)


def _joined(band: np.ndarray, run: np.ndarray, next_: np.ndarray) -> np.ndarray:
    """Keys of buckets: a band, the run of words at the end, and the first character after it."""
    return mix(band + (run + next_.astype(_U) * _U(0xD6E8FEB86659FD93))[..., None] * _U(0xC2B2AE3D27D4EB4F))


def records(texts: list[str], k: int = K, first: int = FIRST) -> list[tuple[int, bytes, str, bytes] | None]:
    """(hash of the last k whole words, its bucket keys, the last word and what follows it, shingles of the stretch before) of
    each text that is long enough to be aligned. The mark of omission is left out."""
    ends = [x.rstrip() for x in texts]
    for i, x in enumerate(ends):
        if m := _MARK.search(x, max(0, len(x) - 40)):
            ends[i] = x[: m.start()].rstrip()
    low = [x.lower() for x in ends]
    w = words_of(low)
    h, at = w.shingles(k)
    n = np.diff(w.first)
    last = w.first[1:] - 1
    run = np.searchsorted(at, last - k)
    own, level, stretch = bands(w, first), _level(n - 1, first), _stretches(w)
    fit = np.flatnonzero((n > k) & (n > first))
    tails = [(ends[i] if len(low[i]) == len(ends[i]) else low[i])[w.start[last[i]] :] for i in fit]
    keys = _joined(own[level[fit], fit], h[run[fit]], w.lead[last[fit]]).view(np.int64) if len(fit) else []
    out: list = [None] * len(texts)
    for i, key, tail in zip(fit.tolist(), keys, tails):
        out[i] = (int(h[run[i]].view(np.int64)), key.tobytes(), tail, stretch(i, int(last[i]), STRETCH))
    return out


def followers(texts: list[str | None], k: int, first: int, wanted: Callable[[np.ndarray], np.ndarray], asked: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[int, int, str, bytes]]:
    """(text, bucket key, how the text goes on from the word after the run, shingles before) of every run of k words whose
    hash is ``wanted`` and whose key is ``asked`` for, given whether the word after it is the last."""
    low = [t.lower() if t else "" for t in texts]
    w = words_of(low)
    h, at = w.shingles(k)
    ok = np.flatnonzero(wanted(h)) if len(h) else np.zeros(0, np.int64)
    ok = ok[at[ok] + k < w.first[w.doc[at[ok]] + 1]]
    if not len(ok):
        return
    own, stretch = bands(w, first), _stretches(w)
    d, after = w.doc[at[ok]], at[ok] + k
    p = after - w.first[d]
    end = after == w.first[d + 1] - 1
    next_ = w.lead[after]
    keys: set[tuple[int, int]] = set()
    levels = [_level(x, first) for x in (p, p - p // 8, np.minimum(p + p // 8, w.first[d + 1] - w.first[d]))]  # edits may have moved the end
    for i, level in enumerate(levels):
        fit = np.flatnonzero((level >= 0) & ~np.any([level == x for x in levels[:i]], axis=0)) if i else np.flatnonzero(level >= 0)
        each = _joined(own[level[fit], d[fit]], h[ok[fit]], next_[fit])
        a, b = np.nonzero(asked(each.ravel(), np.repeat(end[fit], BANDS)).reshape(each.shape))
        keys.update(zip(fit[a].tolist(), each[a, b].view(np.int64).tolist()))
    for i, key in sorted(keys):
        t = int(d[i])
        plain = (texts[t] if len(low[t]) == len(texts[t]) else low[t]).rstrip()
        yield t, key, plain[w.start[after[i]] : w.end[after[i]] + AFTER], stretch(t, int(after[i]), STRETCH + SLACK)


def goes_on(tail: str, follow: str) -> bool:
    """A text that ends with ``tail`` goes on within the word or sentence where another has ``follow``."""
    if follow[: len(tail)].lower() != tail.lower():
        return False
    rest = follow[len(tail) :]
    return bool(rest) and (rest[0].isalnum() or bool(re.match(r"[ ]?\S|\n[>| ]*[a-zà-ÿ]", rest)) and not _END.search(tail[-3:]) and not rest.startswith("\n\n"))


def contained(window: bytes, other: bytes) -> bool:
    """At least half of the shingles are the other's, too."""
    own = np.frombuffer(window, np.uint16)
    return 2 * np.isin(own, np.frombuffer(other, np.uint16)).sum() >= len(own)


def ends_early(text: str, other: str, k: int = K, first: int = FIRST) -> bool:
    """The two have a band in common, and the other goes on after the text's last words."""
    own = records([text], k, first)[0]
    if own is None:
        return False
    keys = np.frombuffer(own[1], _U)
    found = followers([other], k, first, lambda h: h.view(np.int64) == own[0], lambda x, _: np.isin(x, keys))
    return any(goes_on(own[2], follow) and contained(own[3], around) for _, _, follow, around in found)


def share_by_source(rows: DataFrame, cut_ids: DataFrame, key: str, source: str) -> DataFrame:
    """(source, n, n_cut, share) over the distinct records of each source; a hot source is pre-aggregated."""
    flagged = rows.select(key, source).distinct().join(cut_ids.select(key).withColumn("cut", F.lit(1)), key, "left")
    return flagged.groupBy(source).agg(F.count("*").alias("n"), F.count("cut").alias("n_cut"), (F.count("cut") / F.count("*")).alias("share"))


def truncated(df: DataFrame, key: str, text: str, source: str | None = None, *, k: int = K, first: int = FIRST, numbers: bool = True) -> DataFrame:
    """(key, how) of the texts that are cut, one row per key; how is 'near-copy', 'mark', 'terminality' or 'limit'.

    Limits are sought in each ``source``, too. Without ``numbers`` words with digits are all the same.
    """
    spark = df.sparkSession
    kind = dict(df.dtypes)[key]
    df = df.select(F.col(key).alias("id"), F.col(text).alias("text"), (F.col(source).cast("string") if source else F.lit(None).cast("string")).alias("source")).where("id IS NOT NULL AND text <> ''")
    shared = spark.sparkContext.broadcast(closing_counts(df, "text"))
    plain = _plain if numbers else partial(_plain, numbers=False)

    def shaped():
        shapes = Shapes(shared.value)

        def f(b):
            own = plain(b["text"])
            out: dict[str, list] = {"id": b["id"], "source": b["source"], "h": [], "shape": [shapes.shape(t) for t in own], "possible": [shapes.possible(t) for t in own], "chars": [len(t) for t in b["text"]]}
            raw = [t.encode("utf-8", "surrogatepass") for t in b["text"]]
            out["bytes"] = [len(t) for t in raw]
            out["h"] = [_hash(t) for t in own]
            out["alike"] = [_hash(t.translate(_DIGITS)) for t in raw]
            got: list = []
            for x, y in blocks(own):
                got += records(own[x:y], k, first)
            for i, c in enumerate(("run", "keys", "tail", "stretch")):
                out[c] = [None if g is None else g[i] for g in got]
            return out

        return f

    seen = stored(arrow_map(df, shaped, f"id {kind}, source string, h bigint, shape string, possible string, chars bigint, bytes bigint, alike bigint, run bigint, keys binary, tail string, stretch binary"))
    near = _early(df.select("text"), seen, k, first, plain)
    once = seen.join(near.withColumn("near", F.lit(1)), "h", "left").withColumn("shape", F.when(F.col("near").isNull(), F.col("shape")).otherwise(""))
    once = once.groupBy("h").agg(F.first("shape").alias("shape"), F.first("possible").alias("possible"))  # equal texts count once
    counts = once.groupBy("shape", "possible").count().collect()  # a row per pair of shapes, some hundred each
    ends, possible = Counter(), Counter()
    for r in counts:
        ends[r["shape"]] += r["count"]
        possible[r["possible"]] += r["count"]
    bad = [s for s, p in cut_shapes(ends, possible).items() if p >= LEAST]
    open_ = seen.where(~F.col("shape").startswith("end ") & (F.col("shape") != "mark"))
    limits = pile_ups(open_.select("alike", "source", "chars", "bytes")).withColumn("at_limit", F.lit(True))
    loose = ~F.split("shape", " ")[0].isin("end", "mark", "rule") & ~F.col("shape").contains(" notice ")
    sized = seen.select("id", "source", "shape", F.col("chars").alias("n"), F.lit("chars").alias("unit")).unionByName(seen.select("id", "source", "shape", F.col("bytes").alias("n"), F.lit("bytes").alias("unit"))).where(loose)
    at_limit = sized.join(limits, ["unit", "n"]).where("who IS NULL OR who = source").select("id", F.lit("limit").alias("how"))
    copies = seen.join(near, "h", "left_semi").select("id", F.lit("near-copy").alias("how"))
    scored = seen.where((F.col("shape") == "mark") | F.col("shape").isin(bad)).select("id", F.when(F.col("shape") == "mark", "mark").otherwise("terminality").alias("how"))
    order = F.create_map(*[F.lit(x) for i, h in enumerate(("near-copy", "mark", "terminality", "limit")) for x in (h, i)])
    return copies.unionByName(scored).unionByName(at_limit).groupBy(F.col("id").alias(key)).agg(F.min_by("how", order[F.col("how")]).alias("how"))


_DIGITS = bytes.maketrans(b"123456789", b"0" * 9)


def _plain(texts: list[str], numbers: bool = True) -> list[str]:
    return texts if numbers else [_MASK.sub("0", t) for t in texts]


def _hash(text: str | bytes) -> int:
    return xxhash.xxh3_64_intdigest(text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _slots(h: np.ndarray, size: int) -> list[np.ndarray]:
    """Three bits of a filter for each hash."""
    return [(mix(h + _U(i)) & _U(size - 1)).astype(np.int64) for i in range(3)]


def _set(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether all bits of a hash are set; the second ones are looked up for those only that have the first."""
    out = np.zeros(len(h), bool)
    left = np.arange(len(h))
    for i in range(3):
        at = (mix(h[left] + _U(i)) & _U(8 * len(bits) - 1)).astype(np.int64)
        left = left[((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)]
    out[left] = True
    return out


def _early(texts: DataFrame, seen: DataFrame, k: int, first: int, plain: Callable[[list[str]], list[str]]) -> DataFrame:
    """(h) of the texts that a near-copy shows to be cut.

    Filters on the last words and on the buckets keep all else out of the join. A text that ends where a record does is
    in it only if another text asks with the same key.
    """
    spark = texts.sparkSession
    asks = seen.where("run IS NOT NULL")

    def asked():
        def f(b):
            keys = [np.frombuffer(x, np.int64) for x in b["keys"]]
            return {"h": [h for h, x in zip(b["h"], keys) for _ in x], "key": np.concatenate(keys) if keys else [], "tail": [t for t, x in zip(b["tail"], keys) for _ in x]}

        return f

    ends = stored(arrow_map(asks.select("h", "keys", "tail"), asked, "h bigint, key bigint, tail string"))
    size = filter_bits(ends)

    def share(hashes: DataFrame):
        return spark.sparkContext.broadcast(filled(hashes, size, _slots))

    runs, keys = share(asks.select("run")), share(ends.select("key"))
    twice = share(ends.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a != b").select("key"))

    def going():
        def f(b):
            out: dict[str, list] = {"key": [], "follow": [], "around": [], "h": []}
            here: set = set()
            own = plain(b["text"])
            for x, y in blocks(own):
                here.update((key, follow, around, _hash(own[x + d])) for d, key, follow, around in followers(own[x:y], k, first, lambda h: _set(runs.value, h), lambda g, last: _set(keys.value, g) & (~last | _set(twice.value, g))))
            for i, c in enumerate(out):
                out[c] = [v[i] for v in here]
            return out

        return f

    found = arrow_map(texts, going, "key bigint, follow string, around binary, h bigint").groupBy("key", "follow", "around")
    found = stored(found.agg(F.min("h").alias("one"), F.max("h").alias("two")))  # copies are one; of two texts one is another

    def on():
        def f(b):
            ok = [i for i, (t, x) in enumerate(zip(b["tail"], b["follow"])) if goes_on(t, x)]
            return {c: [b[c][i] for i in ok] for c in ("key", "tail", "follow")}

        return f

    # Which endings go on elsewhere at all, whatever texts have them.
    pairs = ends.select("key", "tail").distinct().join(found.select("key", "follow").distinct(), "key")
    pairs = cut(arrow_map(pairs, on, "key bigint, tail string, follow string"))
    left = cut(ends.join(pairs.select("key", "tail").distinct(), ["key", "tail"], "left_semi").distinct())
    stretches = _named(asks.select(F.col("h").alias("id"), "stretch"), left.select(F.col("h").alias("id"))).distinct()
    own = left.join(stretches.withColumnRenamed("id", "h"), "h").join(pairs, ["key", "tail"]).select("h", "key", "follow", "stretch")

    def near():
        def f(b):
            return {"h": [h for h, s, o in zip(b["h"], b["stretch"], b["around"]) if contained(s, o)]}

        return f

    return cut(arrow_map(own.join(found, ["key", "follow"]).where("one != h OR two != h").select("h", "stretch", "around"), near, "h bigint").distinct())


def truncated_messages(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, how) of short generated messages that are cut: each distinct message is judged once, however many rows have it,
    with numbers that are all the same and one whole word at its end."""
    df = df.select(key, F.trim(text).alias("m")).where("m <> ''")
    distinct = df.select("m").distinct()  # a status word such as "ok", which most rows may have, is one row of each task
    bad = cut(truncated(distinct, "m", "m", k=1, first=1, numbers=False))
    rows = _named(df.select(F.col("m").alias("id"), key), bad.select(F.col("m").alias("id")))  # hot messages that are whole aren't shuffled
    return rows.join(bad.withColumnRenamed("m", "id"), "id").groupBy(key).agg(F.min("how").alias("how"))
