"""Near-duplicate records by a grouped prefix join on shingles of words.

Similarity of two texts is the Jaccard coefficient of their sets of ``k`` consecutive words.

1. A fixed-size sketch of shingle counts over all texts gives a global order, rare first.
2. Each text's shingles are sorted in that order.  Two texts as similar as ``t`` share a
   shingle among the first ``n - ceil(t n) + 1`` of each (prefix filter).
3. Texts with the same prefix and number of shingles collapse into one group, so that
   copies are joined once.  Group pairs come from an equi-join on prefix shingles with
   bounds on size and position.  A 128-bit agreement sketch (one-bit minima of 128 bins)
   stops pairs that agree in fewer bits than a pair at ``t`` does less 4 standard deviations;
   one of 256 bits follows for the members.  With ``exact`` no pair is stopped by a sketch.  A shingle of very many texts is
   split into blocks.
4. Group pairs expand to members; members of one group are pairs, too.  Every pair is
   verified by the sizes of the intersection and union of its sets.

Texts of equal sets are one class, which its least id stands for; only these are joined and verified, and pairs of ids
follow from the classes' pairs.

Defined results: null and too short texts have no pairs; equal texts under different ids are
pairs of similarity 1; repeated rows of one id count once; an empty table gives no pairs.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import arrow_map, cut, stored
from lodestrata.llm.words import blocks, mix, words_of
from lodestrata.sources import store

#: Buckets of the count sketch, by the size of the input: 1 MB of counts at least and 64 MB at most.
BUCKETS = (1 << 18, 1 << 24)
CHUNK = 1 << 12
#: Texts that a block of a shingle's texts holds at most, about.
HOT = 20_000
#: Bytes of postings that a task sorts, about.
PART = 256 << 20
#: Bits of a size, which an array of Arrow bounds; the rest of a group's g is a hash.
WIDTH = 32
SIZE = (1 << WIDTH) - 1
_U = np.uint64


def shingle_sets(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash) without repeats, in order of text; and the number of words of each text."""
    w = words_of(texts)
    h, at = w.shingles(k)
    d = w.doc[at]
    key = mix(h + d.astype(_U) * _U(0x9E3779B97F4A7C15))  # of one 64-bit word, which sorts fastest
    order = np.argsort(key)
    key = key[order]
    keep = np.sort(order[np.concatenate(([True], key[1:] != key[:-1]))]) if len(key) else order
    return d[keep], h[keep], np.diff(w.first)


def _ranked(d: np.ndarray, h: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Order by text, rank and hash.

    One word holds the text, the rank up to a million, and most of the hash; where two are equal in it, all columns are compared.
    """
    rank = np.minimum(rank, (1 << 20) - 1)
    if not len(d) or int(d[-1]) >= 1 << 10:
        return np.lexsort((h, rank, d))
    key = d.astype(_U) << _U(54) | rank.astype(_U) << _U(34) | h >> _U(30)
    order = np.argsort(key)
    key = key[order]
    return order if (key[1:] != key[:-1]).all() else np.lexsort((h, rank, d))


def buckets_for(df: DataFrame) -> int:
    """So many buckets that the shingles of a bucket together stay far below HOT, within bounds, by the size of the files
    that hold the rows; that costs no scan. Rows that come from no files get a number in between."""
    size = store.total_size(df.sparkSession, df.inputFiles())
    return min(BUCKETS[1], max(BUCKETS[0], 1 << (size // 4000).bit_length())) if size else 1 << 20


def own_count(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many texts have a shingle, about: its bucket's count less what others add to any bucket. Where buckets are many
    times fuller than a shingle is frequent, that is 0 but for the shingles that stand out."""
    noise = 2 * float(counts.mean())
    return np.maximum(0, counts[bucket(h, counts)] - noise).astype(np.int64)


def bucket(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return (h % _U(len(counts))).astype(np.int64)


def shingle_counts(df: DataFrame, text: str, k: int) -> np.ndarray:
    """Number of texts with a shingle of each hash bucket, over all rows."""
    df = df.select(text)
    width = buckets_for(df)

    def make():
        counts = np.zeros(width, np.int32)

        def f(b):
            for x, y in blocks(b[text]):
                np.add.at(counts, bucket(shingle_sets(b[text][x:y], k)[1], counts), 1)

        def end():
            parts = counts.reshape(-1, CHUNK)
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

    summed = arrow_map(df, make, "chunk int, counts binary").groupBy("chunk").applyInArrow(add, "chunk int, counts binary")
    out = np.zeros(width, np.int32)
    for row in summed.collect():  # width / CHUNK rows at most
        out[row.chunk * CHUNK : (row.chunk + 1) * CHUNK] = np.frombuffer(row.counts, np.int32)
    return out


def _agreement(d: np.ndarray, h: np.ndarray, n_texts: int, functions: int = 4, bins: int = 64) -> np.ndarray:
    """One bit of the least hash in each bin, for some hash functions: (texts, functions) words of 64 bits. In a bin without
    any shingle of either text two sketches agree, so short texts are stopped less."""
    bits = np.zeros((n_texts, bins * functions), np.uint8)
    for i in range(functions):
        g = mix(h + _U(0x632BE59BD9B4E019 * (i + 1) % 2**64))
        least = np.full(n_texts * bins, np.iinfo(np.uint64).max, _U)
        np.minimum.at(least, d * bins + (g >> _U(58)).astype(np.int64), g << _U(6))
        bits[:, bins * i : bins * (i + 1)] = ((least >> _U(8)) & _U(1)).astype(np.uint8).reshape(n_texts, bins)
    return np.packbits(bits, axis=1).view(np.int64)


def prefix_table(df: DataFrame, key: str, text: str, *, k: int, t: float, min_words: int) -> DataFrame:
    """One row per text: id, prefix (its rarest shingles), hot (their counts), h1 and h2 (of all shingles), s1, s2, s3 and g.

    s1, s2 and g (31 bits of the prefix's hash, 32 of the size) are the identity of the text's group; s3 is a
    larger agreement sketch.
    """
    counts = df.sparkSession.sparkContext.broadcast(shingle_counts(df, text, k))

    def make():
        rank = counts.value

        def f(b):
            out: dict[str, list] = {c: [] for c in ("id", "prefix", "hot", "h1", "h2", "s1", "s2", "s3", "g")}
            for x, y in blocks(b[text]):
                d, h, words = shingle_sets(b[text][x:y], k)
                order = _ranked(d, h, rank[bucket(h, rank)])
                d, h = d[order], h[order]
                n = np.bincount(d, minlength=y - x)
                first = np.concatenate(([0], np.cumsum(n)))
                s = _agreement(d, h, y - x)
                short = (h >> _U(32)).astype(np.uint32).view(np.int32)
                count = own_count(h, rank)
                for i in range(y - x):
                    if b[key][x + i] is None or words[i] < min_words or not n[i]:
                        continue
                    own = slice(first[i], first[i + 1])
                    p = prefix_size(int(n[i]), t)
                    out["id"].append(b[key][x + i])
                    h1, h2 = np.frombuffer(blake2b(short[own].tobytes(), digest_size=16).digest(), np.int64)
                    out["prefix"].append(short[own][:p])
                    out["h1"].append(int(h1))
                    out["h2"].append(int(h2))
                    many = count[own][:p] // HOT
                    out["hot"].append(many.astype(np.int32).tolist() if many.any() else None)
                    out["s1"].append(int(s[i, 0]))
                    out["s2"].append(int(s[i, 1]))
                    out["s3"].append(s[i, 2:].tobytes())
                    out["g"].append((zlib.crc32(short[own][:p].tobytes()) & 0x7FFFFFFF) << WIDTH | int(n[i]))
            return out

        return f

    kind = dict(df.dtypes)[key]
    return arrow_map(df.select(key, text), make, f"id {kind}, prefix array<int>, hot array<int>, h1 long, h2 long, s1 long, s2 long, s3 binary, g long")


def prefix_size(n: int, t: float) -> int:
    return n - math.ceil(t * n - 1e-9) + 1


def _postings(rows: DataFrame) -> DataFrame:
    """(token, salt, s1, s2, g, p): the prefix of each group, p its positions; a task names a group once.

    A token in more than HOT texts is dealt to blocks of about HOT rows, and the rows of each pair of blocks meet.
    """

    def make():
        seen: set = set()

        def f(b):
            token, salt, s1, s2, gs, pos = [], [], [], [], [], []
            for prefix, hot, x, y, g in zip(b["prefix"], b["hot"], b["s1"], b["s2"], b["g"]):
                if (x, y, g) in seen:
                    continue
                if len(seen) < 1_000_000:  # bounded memory; a group named twice is collapsed at the join
                    seen.add((x, y, g))
                p = np.arange(len(prefix))
                tok, at = np.array(prefix, np.int32), np.zeros(len(p), np.int32)
                if hot is not None:
                    many = np.array(hot) + 1
                    own = (x ^ g) % many
                    p = np.repeat(p, many)
                    other = np.arange(len(p)) - np.repeat(np.cumsum(many) - many, many)
                    mine = np.repeat(own, many)
                    tok, at = np.repeat(tok, many), (np.minimum(mine, other) << 12 | np.maximum(mine, other)).astype(np.int32)
                token.append(tok)
                salt.append(at)
                s1.append(np.full(len(p), x))
                s2.append(np.full(len(p), y))
                gs.append(np.full(len(p), g))
                pos.append(p.astype(np.int32))
            if token:
                return {"token": pa.array(np.concatenate(token)), "salt": pa.array(np.concatenate(salt)), "s1": pa.array(np.concatenate(s1)), "s2": pa.array(np.concatenate(s2)), "g": pa.array(np.concatenate(gs)), "p": pa.array(np.concatenate(pos))}
            return None

        return f

    return arrow_map(rows.select("prefix", "hot", "s1", "s2", "g"), make, "token int, salt int, s1 long, s2 long, g long, p int")


def _bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which 64-bit words differ."""
    return np.bitwise_count((a ^ b).view(_U))


def _parts(rows: DataFrame) -> int | None:
    """Parts of the postings of stored rows, PART bytes each, where that is more than the session's number; else that one is left
    to the adaptive plan."""
    need = 4 * store.total_size(rows.sparkSession, rows.inputFiles()) // PART
    return need if need > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def _group_pairs(post: DataFrame, t: float, exact: bool = False, parts: int | None = None) -> DataFrame:
    """Pairs of groups that pass the bounds on size and position and, unless ``exact``, the agreement sketch."""
    least = 0 if exact else floor_of(128, t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:  # sorted by token and salt: all rows of one meet in one task
            held.append(batch)
            size += batch.num_rows
            if size >= 1 << 19:
                table = pa.Table.from_batches(held)
                key = table.column("token").to_numpy().astype(np.int64) << 32 | table.column("salt").to_numpy()
                start = int(np.searchsorted(key, key[-1]))
                if start:
                    yield from pairs(table.slice(0, start))
                    held = table.slice(start).to_batches()
                    size -= start
        if held:
            yield from pairs(pa.Table.from_batches(held))

    def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
        token, salt, s1, s2, g, pos = (table.column(c).to_numpy() for c in ("token", "salt", "s1", "s2", "g", "p"))
        key = token.astype(np.int64) << 32 | salt
        n, pos = g & SIZE, pos.astype(np.int64)
        order = np.lexsort((pos, s2, s1, g, n, key))
        key, s1, s2, g, n, pos = key[order], s1[order], s2[order], g[order], n[order], pos[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (g[1:] != g[:-1]) | (pos[1:] != pos[:-1]) | (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])
        key, s1, s2, g, n, pos = (x[new] for x in (key, s1, s2, g, n, pos))
        last = np.searchsorted(key, key, side="right")
        # Within a key sizes ascend: partners of row i are those after it whose size is at most n / t.
        far = np.minimum(last, np.searchsorted(_compound(key, n), _compound(key, np.floor(n / t + 1e-9).astype(np.int64)), side="right"))
        many = far - np.arange(len(key)) - 1
        many[n - pos < np.ceil(2 * t / (1 + t) * n - 1e-9)] = 0  # the smaller side needs no more than its index prefix
        rows = np.flatnonzero(many)
        ends = np.cumsum(many[rows])
        at = 0
        while at < len(rows):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + (1 << 21), side="right")))
            m = many[rows[at:to]]
            a = np.repeat(rows[at:to], m)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(m) - m, m)
            need = np.ceil(t / (1 + t) * (n[a] + n[b]) - 1e-9)
            ok = (n[a] - pos[a] >= need) & (n[b] - pos[b] >= need)
            a, b = a[ok], b[ok]
            ok = _bits(s1[a], s1[b]) + _bits(s2[a], s2[b]) <= 128 - least
            a, b = a[ok], b[ok]
            yield pa.RecordBatch.from_pydict({"a_s1": s1[a], "a_s2": s2[a], "a_g": g[a], "b_s1": s1[b], "b_s2": s2[b], "b_g": g[b]})
            at = to

    return (
        post.repartition(*([parts] if parts else []), "token", "salt").sortWithinPartitions("token", "salt")
        .mapInArrow(run, "a_s1 long, a_s2 long, a_g long, b_s1 long, b_s2 long, b_g long").distinct()
    )


def _compound(key: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Ascending codes of (key, n), keys sorted."""
    return np.cumsum(np.concatenate(([0], np.diff(key) != 0))).astype(np.int64) << WIDTH | n


def floor_of(bits: int, t: float) -> int:
    """Bits that a pair at ``t`` agrees in, less 4 standard deviations."""
    p = (1 + t) / 2
    return math.floor(bits * p - 4 * math.sqrt(bits * p * (1 - p)))


def near_pairs(df: DataFrame, key: str, text: str, *, k: int = 5, t: float = 0.8, min_words: int = 0, exact: bool = False) -> DataFrame:
    """Pairs (a, b, similarity), a < b, of ids whose texts are at least ``t`` similar; copies are pairs as well."""
    rows = stored(prefix_table(df, key, text, k=k, t=t, min_words=min_words))
    members = _classes(rows)
    pairs = _pairs(rows, members, df.select(key, text), k, t, exact)
    side = lambda c: members.select(F.col("chief").alias(c), F.col("id").alias(f"{c}_id"))
    every = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("a_id", "a").alias("x"), F.coalesce("b_id", "b").alias("y"), "similarity")
    copies = side("chief").join(members, "chief").select(F.col("chief_id").alias("x"), F.col("id").alias("y"), F.lit(1.0).alias("similarity")).where("x < y")
    return every.unionByName(copies).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")


def _classes(rows: DataFrame) -> DataFrame:
    """(id, chief) of the ids in classes of several, the least id being the chief."""
    many = rows.groupBy("h1", "h2").agg(F.min("id").alias("chief"), F.max("id").alias("last")).where("chief != last").drop("last")
    return cut(rows.select("id", "h1", "h2").join(many, ["h1", "h2"]).select("id", "chief").distinct())


def near_groups(df: DataFrame, key: str, text: str, *, k: int = 5, t: float = 0.8, min_words: int = 0, exact: bool = False) -> DataFrame:
    """(id, group_id, n_links, n_copies) of every id with a copy or a similar text.

    Only the chiefs of classes are joined, so that a class of a third of all rows costs its size. n_links counts classes that are
    similar to the id's own, n_copies the other members of its class; group_id is the least id that links lead to.
    """
    rows = stored(prefix_table(df, key, text, k=k, t=t, min_words=min_words))
    members = _classes(rows)
    pairs = cut(_pairs(rows, members, df.select(key, text), k, t, exact).select("a", "b"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = both.groupBy(F.col("a").alias("chief")).agg(F.count("*").alias("n_links"))
    found = links.join(components(pairs).withColumnRenamed("id", "chief"), "chief")
    sizes = members.groupBy("chief").agg((F.count("*") - 1).alias("n_copies"))
    chief = found.join(sizes, "chief", "full")
    every = chief.join(members, "chief", "left").select(F.coalesce("id", "chief").alias("id"), F.coalesce("group_id", "chief").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_copies", F.lit(0)).alias("n_copies"))
    return every


def components(pairs: DataFrame) -> DataFrame:
    """(id, group_id) of the ids in pairs (a, b): the least id of each connected component.

    Large and small stars in turn: each id's neighbours are pointed to the least of them, by a
    minimum and a join and never a list of neighbours, until nothing changes.
    """
    edges = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = cut(small.where("u != v").distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("group_id")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("group_id"))).distinct()


def _pairs(rows: DataFrame, members: DataFrame, texts: DataFrame, k: int, t: float, exact: bool = False) -> DataFrame:
    """Pairs of chiefs, and of ids without copies; all members of a class are of one group, which is joined once."""
    group = ["s1", "s2", "g"]
    found = _group_pairs(_postings(rows), t, exact, _parts(rows))
    ids = rows.select("id", *group, "s3").join(members.where("id != chief").select("id"), "id", "left_anti")
    copies = ids.groupBy(*group).count().where("count > 1")  # members of one group are pairs, too
    found = found.unionByName(copies.select(*(F.col(c).alias(f"a_{c}") for c in group), *(F.col(c).alias(f"b_{c}") for c in group)))
    # Both sides are the same rows by the same keys, so that they are exchanged once.
    on = lambda side, name: [F.col(f"{side}_{c}") == F.col(f"{name}.{c}") for c in group]
    differ = F.bit_count(F.col("x.s1").bitwiseXOR(F.col("y.s1"))) + F.bit_count(F.col("x.s2").bitwiseXOR(F.col("y.s2"))) + _differ("x.s3", "y.s3")
    across = found.join(ids.alias("x"), on("a", "x")).join(ids.alias("y"), on("b", "y")).where(F.lit(exact) | (differ <= 256 - floor_of(256, t))).where("x.id != y.id")
    pairs = cut(across.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct())
    sets = _sets(_named(texts.toDF("id", "text"), pairs.select(F.explode(F.array("a", "b")).alias("id"))), k)
    both = F.size(F.array_intersect("a_items", "b_items"))
    return (
        pairs.join(sets.select(F.col("id").alias("a"), F.col("items").alias("a_items")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("items").alias("b_items")), "b")
        .withColumn("similarity", both / (F.size("a_items") + F.size("b_items") - both))
        .where(F.col("similarity") >= t - 1e-9)
        .select("a", "b", "similarity").dropDuplicates(["a", "b"])
    )


def _sets(df: DataFrame, k: int) -> DataFrame:
    """(id, items) of (id, text) rows: the shingles of each text. It costs less to read a few texts again than to keep all sets."""

    def make():
        def f(b):
            out: dict[str, list] = {"id": [], "items": []}
            for x, y in blocks(b["text"]):
                d, h, _ = shingle_sets(b["text"][x:y], k)
                first = np.searchsorted(d, np.arange(y - x + 1))
                short = (h >> _U(32)).astype(np.uint32).view(np.int32)
                out["id"] += b["id"][x:y]
                out["items"] += [short[first[i] : first[i + 1]] for i in range(y - x)]
            return out

        return f

    return arrow_map(df, make, f"id {dict(df.dtypes)['id']}, items array<int>")


#: Bits of a filter: 1 MB at least and 128 MB at most; a fuller filter only stops less.
FILTER = (1 << 23, 1 << 30)


def filter_bits(rows: DataFrame) -> int:
    """Sixteen to 32 bits for each of these rows, within bounds."""
    return min(FILTER[1], max(FILTER[0], 1 << (16 * rows.count()).bit_length()))


def filled(hashes: DataFrame, size: int, slots: Callable[[np.ndarray, int], list[np.ndarray]] | None = None) -> np.ndarray:
    """The filter's bits, eight to a byte, with those set that ``slots`` names for each hash of the one column; else its last bits."""

    def make():
        bits = np.zeros(size // 8, np.uint8)

        def f(b):
            h = np.array(b["h"], np.int64).view(_U)
            for at in slots(h, size) if slots else [(h & _U(size - 1)).astype(np.int64)]:
                np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))

        def end():
            parts = bits.reshape(-1, 4096)
            some = np.flatnonzero(parts.any(axis=1))
            return {"part": some.tolist(), "bits": [parts[i].tobytes() for i in some]}

        f.end = end
        return f

    # A task's part is as large as the filter, so there are few tasks: one for each 64 million bits, and no less than four.
    parts = arrow_map(hashes.toDF("h").coalesce(max(4, size >> 26)), make, "part int, bits binary")
    out = np.zeros(size // 8, np.uint8)
    for row in parts.groupBy("part").agg(F.bitmap_or_agg("bits").alias("bits")).collect():  # size / 32768 rows at most
        out[row.part * 4096 : row.part * 4096 + len(row.bits)] = np.frombuffer(row.bits, np.uint8)
    return out


def _named(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is likely among ``ids``, by a filter of bounded size, before they are shuffled."""
    size = filter_bits(ids)
    slot = F.xxhash64("id").bitwiseAND(F.lit(size - 1))
    shared = df.sparkSession.sparkContext.broadcast(filled(ids.select(F.xxhash64("id")), size))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(batch.num_columns - 1).to_numpy()
            ok = (shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            yield batch.filter(pa.array(ok.astype(bool)))

    return df.withColumn("slot", slot).mapInArrow(keep, df.withColumn("slot", slot).schema).drop("slot")


def _differ(a: str, b: str):
    """Bits in which two sketches of 16 bytes differ."""
    word = lambda c, i: F.conv(F.hex(F.substring(c, 8 * i + 1, 8)), 16, -10).cast("long")
    return F.bit_count(word(a, 0).bitwiseXOR(word(b, 0))) + F.bit_count(word(a, 1).bitwiseXOR(word(b, 1)))
