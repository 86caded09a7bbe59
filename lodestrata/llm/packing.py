"""Packing texts, by their size in tokens, into containers of a fixed capacity.

Exact-complement hashing over the histogram of sizes, which has at most ``capacity`` entries
however many items there are.  From the largest size down, an item's gap is filled exactly by
one available size, else by a pair, else by a triple that sums to it; a combination is
consumed as often as the counts allow at once, so every step uses up one of its sizes.
What no such combination fills exactly goes in by best fit: the available sizes, however many,
that together leave the least room.

Items get their container by rank within their size.  Ranks are counted in buckets whose
offsets are prefix sums, so a size that a third of all items have is spread like any other.

Only items above the capacity are split, at token bounds, into full pieces and a rest.

Defined results: null and empty texts have 0 tokens and no container; every other item has
exactly one, for each of its pieces; repeated rows are items of their own; equal sizes are
taken in order of id; an empty table has no containers.
"""

from __future__ import annotations

import base64
import os
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.llm.common import arrow_map, cut

CAPACITY = 2048
VOCABULARY = os.environ.get("LODESTRATA_TOKENS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the public tokenizer's pattern of words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Buckets in which ranks within one size are counted, at least; and items of one size that a bucket has at most, about.
BUCKETS, FULL = 128, 1 << 18


def ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@dataclass
class Plan:
    """Containers ``first[p]`` to ``first[p] + times[p] - 1`` hold the sizes of pattern ``p``."""

    patterns: list[dict[int, int]]  # size -> how many of it one container holds
    times: list[int]

    @property
    def first(self) -> list[int]:
        return [0, *np.cumsum(self.times)[:-1].tolist()] if self.times else []

    @property
    def containers(self) -> int:
        return sum(self.times)


def _exact(left: np.ndarray, gap: int) -> tuple[int, ...] | None:
    """One, two or three available sizes that sum to the gap, the largest first."""
    if gap < 1:
        return None
    if left[gap]:
        return (gap,)

    def pair(total: int, most: int) -> tuple[int, int] | None:
        low = np.arange(1, total // 2 + 1)
        high = total - low
        ok = (left[low] > 0) & (left[high] > 0) & (high <= most) & ((low != high) | (left[low] > 1))
        at = np.flatnonzero(ok)
        return (int(high[at[0]]), int(low[at[0]])) if len(at) else None

    if found := pair(gap, gap):
        return found
    for a in np.flatnonzero(left[: gap - 1])[::-1].tolist():
        if a * 3 < gap:
            break
        left[a] -= 1
        rest = pair(gap - a, a)
        left[a] += 1
        if rest:
            return (a, *rest)
    return None


def _best(left: np.ndarray, gap: int) -> dict[int, int]:
    """The available sizes, however many, that together leave the least of the gap.

    Bit ``i`` of ``sums`` says that some of the sizes so far sum to ``i``; how many there are of a size is added in powers of two.
    """
    sums, steps, mask = 1, [], (1 << (gap + 1)) - 1
    for s in np.flatnonzero(left[: gap + 1])[::-1].tolist():
        n, k = min(int(left[s]), gap // s), 1
        while n:
            k = min(k, n)
            steps.append((s, k, sums))
            sums |= (sums << (k * s)) & mask
            n, k = n - k, 2 * k
        if sums >> gap & 1:
            break
    total, out = sums.bit_length() - 1, {}
    for s, k, before in reversed(steps):
        if not before >> total & 1:
            out[s] = out.get(s, 0) + k
            total -= s * k
    return out


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """Containers for ``counts[s]`` items of each size ``s`` from 1 to ``capacity``."""
    left = np.zeros(capacity + 1, np.int64)
    left[: len(counts)] = counts[: capacity + 1]
    left[0] = 0
    out = Plan([], [])

    def use(sizes: dict[int, int]) -> None:
        times = min(int(left[s]) // n for s, n in sizes.items())
        for s, n in sizes.items():
            left[s] -= n * times
        out.patterns.append(sizes)
        out.times.append(times)

    residual: list[int] = []
    kept = np.zeros_like(left)
    for size in range(capacity, 0, -1):
        while left[size]:
            if size == capacity:
                use({size: 1})
                continue
            left[size] -= 1
            found = _exact(left, capacity - size)
            left[size] += 1
            if not found:
                kept[size], left[size] = left[size], 0
                residual.append(size)
                break
            sizes: dict[int, int] = {size: 1}
            for s in found:
                sizes[s] = sizes.get(s, 0) + 1
            use(sizes)
    left = kept
    for size in residual:
        while left[size]:
            left[size] -= 1
            sizes = _best(left, capacity - size)
            left[size] += 1
            sizes[size] = sizes.get(size, 0) + 1
            use(sizes)
    return out


def sized(df: DataFrame, key: str, text: str, capacity: int = CAPACITY, path: str = VOCABULARY) -> DataFrame:
    """(key, piece, start_at, end_at, n_tokens): a row for each text, or for each piece of one above the capacity."""
    shared = df.sparkSession.sparkContext.broadcast(ranks(path))  # the vocabulary has a fixed size

    def make():
        import tiktoken

        coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=shared.value, special_tokens={})

        def f(b):
            out: dict[str, list] = {c: [] for c in (key, "piece", "start_at", "end_at", "n_tokens")}

            def add(*row):
                for c, v in zip(out, row):
                    out[c].append(v)

            for k, t in zip(b[key], b[text]):
                codes = coder.encode_ordinary(t) if t else []
                if len(codes) <= capacity:
                    add(k, 1, 1, len(t or ""), len(codes))
                    continue
                starts = [*coder.decode_with_offsets(codes)[1], len(t)]
                for i, at in enumerate(range(0, len(codes), capacity)):
                    n = min(capacity, len(codes) - at)
                    add(k, i + 1, starts[at] + 1, starts[at + n], n)
            return out

        return f

    kind = dict(df.dtypes)[key]
    return arrow_map(df.select(key, text), make, f"{key} {kind}, piece bigint, start_at bigint, end_at bigint, n_tokens bigint")


def packed(df: DataFrame, key: str, text: str, capacity: int = CAPACITY, path: str = VOCABULARY) -> DataFrame:
    """(key, piece, start_at, end_at, n_tokens, container) of every text."""
    items = cut(sized(df, key, text, capacity, path))
    buckets = max(BUCKETS, items.count() // FULL)
    items = items.withColumn("bucket", F.pmod(F.xxhash64(key, "piece"), F.lit(buckets)))
    sizes = items.where("n_tokens > 0").groupBy("n_tokens", "bucket").count()
    counts = np.zeros(capacity + 1, np.int64)
    for r in sizes.groupBy("n_tokens").agg(F.sum("count").alias("n")).collect():  # a row per size, at most capacity
        counts[r.n_tokens] = r.n
    made = plan(counts, capacity)
    ends: dict[int, list[tuple[int, int, int]]] = {}
    for p, (first, sizes_of) in enumerate(zip(made.first, made.patterns)):
        for s, n in sizes_of.items():
            own = ends.setdefault(s, [])
            own.append(((own[-1][0] if own else 0) + n * made.times[p], first, n))
    shared = df.sparkSession.sparkContext.broadcast({s: tuple(np.array(x, np.int64) for x in zip(*own)) for s, own in ends.items()})

    before = Window.partitionBy("n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket
    offsets = sizes.select("n_tokens", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    own = Window.partitionBy("n_tokens", "bucket").orderBy(key, "piece")
    ranked = items.where("n_tokens > 0").withColumn("rank", F.row_number().over(own) - 1).join(offsets, ["n_tokens", "bucket"]).withColumn("rank", F.col("rank") + F.col("offset"))
    columns = [key, "piece", "start_at", "end_at", "n_tokens"]

    def place():
        where = shared.value

        def f(b):
            size, rank = np.array(b["n_tokens"]), np.array(b["rank"])
            container = np.zeros(len(size), np.int64)
            for s in np.unique(size):
                end, first, n = where[int(s)]
                at = np.flatnonzero(size == s)
                i = np.searchsorted(end, rank[at], side="right")
                begin = np.where(i > 0, end[i - 1], 0)
                container[at] = first[i] + (rank[at] - begin) // n[i]
            return {c: b[c] for c in columns} | {"container": container}

        return f

    kind = dict(df.dtypes)[key]
    schema = f"{key} {kind}, piece bigint, start_at bigint, end_at bigint, n_tokens bigint, container bigint"
    placed = arrow_map(ranked.select(*columns, "rank"), place, schema)
    return placed.unionByName(items.where("n_tokens = 0").select(*columns).withColumn("container", F.lit(None).cast("bigint")))


def fill(packs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(containers, tokens, share, least): how full the containers are, and how few could do."""
    out = packs.where("container IS NOT NULL").groupBy("container").agg(F.sum("n_tokens").alias("n")).agg(F.count("*").alias("containers"), F.sum("n").alias("tokens"))
    return out.select("containers", "tokens", (F.col("tokens") / (F.col("containers") * capacity)).alias("share"), F.ceil(F.col("tokens") / capacity).alias("least"))
