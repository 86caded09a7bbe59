"""Evaluation passages inside training texts, by a prefix-filtered set join.

A text leaks an item when both have at least ``run`` consecutive words in common.  Such a
window holds ``run - k + 1`` shingles of ``k`` words, and the text must hold all of them, so
one shingle of each window, its rarest over the corpus, is the necessary prefix.  Shingle
counts come from a sketch over all texts.

The items' prefix shingles are looked up in every text.  A hit gives the position in both;
there must be room for ``run`` words around it, and the words are compared outwards from it
until they differ.  Up to ``broadcast_words`` words of items are sent to the tasks, each item's words once;
beyond that a filter on the items' shingles picks those of the texts, which are joined with the items' by a shuffle.  Both
sides then carry the words around the shingle, as many as a run needs, so a row's size doesn't depend on the length of item
or text; a shingle of very many texts is split over several tasks.  Both ways give the same rows.

Defined results: null and short texts or items leak nothing; each (text, item) comes once
however often and in whatever copies it leaks; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import arrow_map, stored
from lodestrata.llm.neardup import HOT, bucket, filled, filter_bits, own_count, shingle_counts
from lodestrata.llm.words import blocks, words_of


def necessary(words: np.ndarray, shingles: np.ndarray, counts: np.ndarray, run: int, k: int) -> list[int]:
    """Offsets of the rarest shingle of each window of ``run`` words, without repeats."""
    if len(words) < run:
        return []
    order = np.lexsort((shingles, counts[bucket(shingles, counts)]))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    windows = np.lib.stride_tricks.sliding_window_view(rank, run - k + 1)
    return np.unique(windows.argmin(axis=1) + np.arange(len(windows))).tolist()


def common_run(a: np.ndarray, i: int, b: np.ndarray, j: int, k: int) -> int:
    """Length of the run of equal words around a[i:i+k] and b[j:j+k]."""
    if not np.array_equal(a[i : i + k], b[j : j + k]):
        return 0
    n = min(i, j)
    left = np.flatnonzero(a[i - n : i][::-1] != b[j - n : j][::-1])
    m = min(len(a) - i, len(b) - j)
    right = np.flatnonzero(a[i : i + m] != b[j : j + m])
    return (int(left[0]) if len(left) else n) + (int(right[0]) if len(right) else m)


def leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, *, run: int = 13, k: int = 5, broadcast_words: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id) of texts with at least ``run`` consecutive words of an item."""
    spark = docs.sparkSession
    counts = spark.sparkContext.broadcast(shingle_counts(docs, text, k))
    kinds = dict(items.dtypes)[item_id], dict(docs.dtypes)[doc_id]
    out = f"{doc_id} {kinds[1]}, {item_id} {kinds[0]}"
    size = items.select(F.sum(F.length(item_text) / 2)).first()[0] or 0  # a word has two characters or more, with what follows it
    small = size <= broadcast_words

    def prefixes():
        def f(b):
            got: dict[str, list] = {c: [] for c in ("item", "token", "salt", "offset", "around", "before")}
            for x, y in blocks(b[item_text]):
                w = words_of(b[item_text][x:y])
                h, at = w.shingles(k)
                for i, name in enumerate(b[item_id][x:y]):
                    own = w.hash[w.first[i] : w.first[i + 1]]
                    s = h[np.searchsorted(at, w.first[i]) : np.searchsorted(at, w.first[i + 1])]
                    if name is None or len(own) < run:
                        continue
                    for o in necessary(own, s, counts.value, run, k):
                        low = max(0, o - run)
                        for salt in range(1 if small else _parts(counts.value, s[o : o + 1])):
                            got["item"].append(name)
                            got["token"].append(int(s[o].view(np.int64)))
                            got["salt"].append(salt)
                            got["offset"].append(o)
                            got["around"].append(None if small else own[low : o + k + run].view(np.int64))
                            got["before"].append(o - low)
            return got

        return f

    prefix = arrow_map(items.select(item_id, item_text), prefixes, f"item {kinds[0]}, token long, salt int, offset int, around array<long>, before int")
    if small:
        rows = prefix.select("token", "item", "offset").toArrow()  # at most a row for each word
        words = arrow_map(items.select(item_id, item_text).where(F.col(item_id).isNotNull()), lambda: _words(item_id, item_text), f"item {kinds[0]}, words array<long>").toArrow()
        known = {i: np.array(x, np.int64) for i, x in zip(words.column("item").to_pylist(), (words.column("words")[j].values.to_numpy() for j in range(words.num_rows)))}
        shared = spark.sparkContext.broadcast((rows.column("token").to_numpy(), rows.column("item").to_pylist(), rows.column("offset").to_numpy(), known))
        return _scan(docs.select(doc_id, text), doc_id, item_id, text, shared, run, k, out).distinct()

    prefix = stored(prefix)
    bits = filter_bits(prefix)
    wanted = spark.sparkContext.broadcast(filled(prefix.select("token"), bits))

    def texts():
        def f(b):
            got: dict[str, list] = {c: [] for c in ("doc", "token", "salt", "around", "before")}
            for x, y in blocks(b[text]):
                w = words_of(b[text][x:y])
                h, at = w.shingles(k)
                slot = (h & np.uint64(bits - 1)).astype(np.int64)
                for i in np.flatnonzero((wanted.value[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1):
                    p = int(at[i])
                    d = int(w.doc[p])
                    doc, low = b[doc_id][x + d], max(int(w.first[d]), p - run)
                    if w.first[d + 1] - w.first[d] >= run and doc is not None:
                        got["doc"].append(doc)
                        got["token"].append(int(h[i].view(np.int64)))
                        got["salt"].append(hash(doc) % _parts(counts.value, h[i : i + 1]))
                        got["around"].append(w.hash[low : min(int(w.first[d + 1]), p + k + run)].view(np.int64))
                        got["before"].append(p - low)
            return got

        return f

    def verify():
        def f(b):
            ok = [i for i in range(len(b["doc"])) if common_run(np.array(b["around"][i]), b["before"][i], np.array(b["other"][i]), b["offset"][i], k) >= run]
            return {doc_id: [b["doc"][i] for i in ok], item_id: [b["item"][i] for i in ok]}

        return f

    hits = arrow_map(docs.select(doc_id, text), texts, f"doc {kinds[1]}, token long, salt int, around array<long>, before int")
    both = hits.join(prefix.select("token", "salt", "item", F.col("around").alias("other"), F.col("before").alias("offset")), ["token", "salt"])
    return arrow_map(both.select("doc", "around", "before", "item", "other", "offset"), verify, out).distinct()


def _words(item_id: str, item_text: str):
    def f(b):
        w = words_of(b[item_text])
        return {"item": b[item_id], "words": [w.hash[w.first[i] : w.first[i + 1]].view(np.int64) for i in range(len(b[item_id]))]}

    return f


def _parts(counts: np.ndarray, h: np.ndarray) -> int:
    """Parts that the texts of a shingle are split into."""
    return 1 + int(own_count(h, counts)[0]) // HOT


def _scan(docs: DataFrame, doc_id: str, item_id: str, text: str, shared, run: int, k: int, schema: str) -> DataFrame:
    def make():
        tokens, items, offsets, words = shared.value
        order = np.argsort(tokens, kind="stable")
        ordered = tokens[order]

        def f(b):
            got: set = set()
            for x, y in blocks(b[text]):
                w = words_of(b[text][x:y])
                h, at = w.shingles(k)
                h = h.view(np.int64)
                low, high = np.searchsorted(ordered, h), np.searchsorted(ordered, h, side="right")
                for hit in np.flatnonzero(low < high):
                    d = int(w.doc[at[hit]])
                    first, last = int(w.first[d]), int(w.first[d + 1])
                    if last - first < run or b[doc_id][x + d] is None:
                        continue
                    own, p = w.hash[first:last].view(np.int64), int(at[hit]) - first
                    for i in order[low[hit] : high[hit]]:
                        pair = (b[doc_id][x + d], items[i])
                        if pair not in got and common_run(own, p, words[items[i]], offsets[i], k) >= run:
                            got.add(pair)
            return {doc_id: [a for a, _ in got], item_id: [c for _, c in got]}

        return f

    return arrow_map(docs, make, schema)
