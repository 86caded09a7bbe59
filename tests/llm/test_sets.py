"""Words, near-duplicates and leaked passages against brute force."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import leak, neardup
from lodestrata.llm.words import words_of

WORD = re.compile(r"[^\W_]+")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abÄßé1²_ .,-\n\x00Łпσ漢"), max_size=30), min_size=1, max_size=6))
def test_words_are_those_of_the_pattern(texts):
    w = words_of(texts)
    known: dict[str, int] = {}
    for d, t in enumerate(texts):
        own = list(WORD.finditer(t.lower()))
        at = slice(w.first[d], w.first[d + 1])
        assert [(m.start(), m.end()) for m in own] == list(zip(w.start[at].tolist(), w.end[at].tolist()))
        for m, h in zip(own, w.hash[at].tolist()):
            assert known.setdefault(m.group(), h) == h
    assert len(set(known.values())) == len(known)


def test_no_words():
    assert len(words_of([]).hash) == len(words_of([None, ""]).hash) == 0
    assert len(words_of(["one two"]).shingles(3)[0]) == 0


def similar(texts, k, t, least):
    sets = {}
    for i, x in texts:
        w = WORD.findall(x.lower()) if i is not None and x else []
        if len(w) >= max(least, 1) and len(w) >= k:
            sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    ids = sorted(sets)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-12}


def edited(r, words):
    w = list(words)
    for _ in range(r.randrange(0, 12)):
        at = r.randrange(len(w))
        w[at : at + r.randrange(2)] = [f"x{r.randrange(999)}"] * r.randrange(2)
    return w


@pytest.mark.parametrize("k, t, least", [(3, 0.6, 20), (5, 0.8, 0)])
def test_near_pairs_equal_brute_force(spark, k, t, least, monkeypatch):
    r = random.Random(5)
    rows = [(None, "null id " * 30), ("n", None), ("e", ""), ("s", "too short")]
    for i in range(40):
        base = [f"w{r.randrange(60)}" for _ in range(r.randrange(15, 120))]
        rows += [(f"{i:03}-{j}", " ".join(edited(r, base))) for j in range(4)]
    rows += [(f"copy{i}", "the very same text of some length " * 5) for i in range(8)]
    rows += rows[:20]
    df = spark.createDataFrame(rows, "key string, text string").selectExpr("key", "text", "1 AS id", "2 AS n", "3 AS a")
    got = [(x.a, x.b) for x in neardup.near_pairs(df, "key", "text", k=k, t=t, min_words=least).collect()]
    assert len(got) == len(set(got)) and set(got) == similar(rows, k, t, least)


def test_hot_shingles_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT", 6)
    r = random.Random(2)
    base = [f"w{i}" for i in range(60)]
    rows = [(f"{i:03}", " ".join(edited(r, base))) for i in range(60)]
    df = spark.createDataFrame(rows, "key string, text string")
    got = {(x.a, x.b) for x in neardup.near_pairs(df, "key", "text", k=3, t=0.6).collect()}
    assert got == similar(rows, 3, 0.6, 0)


def test_sketches_lose_no_pair_of_a_table(spark):
    from lodestrata.llm import catalog

    texts = catalog.contents(spark, "/root/testdata/sf0.01")
    by = [{(x.a, x.b) for x in neardup.near_pairs(texts, "sha256", "content", k=3, t=0.6, min_words=20, exact=e).select("a", "b").collect()} for e in (False, True)]
    assert by[0] == by[1] and by[0]


def test_pairs_of_pairs_of_classes(spark):
    r = random.Random(8)
    base = [f"w{i}" for i in range(80)]
    one, two = " ".join(base), " ".join(edited(r, base))
    rows = [(f"a{i}", one) for i in range(5)] + [(f"b{i}", two + (" x" if i == 9 else "")) for i in range(4)] + [("c", " ".join(f"v{i}" for i in range(30)))]
    got = [(x.a, x.b) for x in neardup.near_pairs(spark.createDataFrame(rows, "key string, text string"), "key", "text", k=3, t=0.6).collect()]
    assert len(got) == len(set(got)) and set(got) == similar(rows, 3, 0.6, 0) and len(got) > 10


def test_full_buckets_make_no_shingle_hot():
    r = np.random.default_rng(1)
    counts = r.poisson(50_000, 1 << 18).astype(np.int32)
    h = r.integers(0, 2**63, 1000).astype(np.uint64)
    assert not (neardup.own_count(h, counts) >= neardup.HOT).any()
    counts[neardup.bucket(h[:1], counts)] += 500_000
    assert neardup.own_count(h[:1], counts)[0] // neardup.HOT > 15


def test_no_rows_no_pairs(spark):
    assert neardup.near_pairs(spark.createDataFrame([], "key string, text string"), "key", "text").count() == 0


@pytest.mark.parametrize("limit", [2_000_000, 0])
def test_leaks_equal_brute_force(spark, limit):
    r = random.Random(9)
    word = lambda: f"w{r.randrange(40)}"
    items = [(i, " ".join(word() for _ in range(r.randrange(5, 60)))) for i in range(30)] + [(90, None), (91, ""), (None, "x " * 40)]
    docs = []
    for i in range(120):
        own = [word() for _ in range(r.randrange(0, 80))]
        if i % 2:
            w = (r.choice(items[:30])[1]).split()
            at, n = r.randrange(len(w)), r.choice([11, 12, 13, 14, 30])
            own[len(own) // 2 : len(own) // 2] = w[at : at + n]
        docs.append((i, " ".join(own).upper() if i % 3 else ", ".join(own)))
    docs += [(500, None), (501, ""), (None, items[0][1])] + docs[:10]
    windows = {}
    for i, t in items:
        w = WORD.findall(t or "")
        for j in range(len(w) - 12):
            windows.setdefault(tuple(w[j : j + 13]), set()).add(i)
    want = {(d, i) for d, t in docs if d is not None for w in [WORD.findall((t or "").lower())] for j in range(len(w) - 12) for i in windows.get(tuple(w[j : j + 13]), ()) if i is not None}
    D = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id_", "2 AS token")
    items_df = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS token")
    got = [tuple(x) for x in leak.leaks(D, "doc_id", "text", items_df, "item_id", "text", broadcast_words=limit).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    assert leak.leaks(D.limit(0), "doc_id", "text", items_df, "item_id", "text", broadcast_words=limit).count() == 0
    assert leak.leaks(D, "doc_id", "text", items_df.limit(0), "item_id", "text", broadcast_words=limit).count() == 0


def test_items_cost_their_length():
    import pickle

    w = words_of([" ".join(f"w{i % 977} v{i}" for i in range(50_000))])
    h, _ = w.shingles(5)
    offsets = leak.necessary(w.hash, h, np.zeros(1 << 18, np.int32), 13, 5)
    assert len(offsets) <= len(w.hash) and len(pickle.dumps((w.hash, h[offsets], offsets))) < 10_000_000


def test_hot_items_are_split(spark, monkeypatch):
    monkeypatch.setattr(leak, "HOT", 3)
    passage = " ".join(f"p{i}" for i in range(20))
    docs = spark.createDataFrame([(i, f"x{i} {passage} y{i}") for i in range(40)] + [(99, "other words " * 20)], "doc_id long, text string")
    items = spark.createDataFrame([(1, passage), (2, " ".join(f"q{i}" for i in range(20)))], "item_id long, text string")
    for limit in (2_000_000, 0):
        got = {tuple(r) for r in leak.leaks(docs, "doc_id", "text", items, "item_id", "text", broadcast_words=limit).collect()}
        assert got == {(i, 1) for i in range(40)}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32))
def test_order_by_text_rank_and_hash(seed):
    r = np.random.default_rng(seed)
    d, h, rank = np.sort(r.integers(0, 5, 300)), r.integers(0, 2**64, 300, dtype=np.uint64), r.integers(0, 3, 300)
    h[::7] = h[0] + np.arange(len(h[::7]), dtype=np.uint64)  # equal in their first bits
    assert neardup._ranked(d, h, rank).tolist() == np.lexsort((h, rank, d)).tolist()


def test_agreement_bits():
    d, h, _ = neardup.shingle_sets(["a b c d e f g h i j k l m n o p"] * 2 + ["q r s t u v w x y z"], 3)
    s = neardup._agreement(d, h, 3)
    assert (s[0] == s[1]).all() and np.bitwise_count((s[0] ^ s[2]).view(np.uint64)).sum() > 10


def test_groups(spark):
    r = random.Random(11)
    rows = [("z", None)]
    for i in range(25):
        base = [f"w{r.randrange(60)}" for _ in range(r.randrange(20, 90))]
        rows += [(f"{i:03}-{j}", " ".join(edited(r, base))) for j in range(5)]
    rows += [(f"copy{i}", "the very same text of some length " * 5) for i in range(30)] + rows[:9]
    pairs = similar(rows, 3, 0.6, 0)
    boss = {i: i for p in pairs for i in p}

    def top(i):
        while boss[i] != i:
            i = boss[i]
        return i

    for a, b in sorted(pairs):
        x, y = sorted((top(a), top(b)))
        boss[y] = x
    got = neardup.near_groups(spark.createDataFrame(rows, "key string, text string"), "key", "text", k=3, t=0.6).collect()
    assert len(got) == len({x.id for x in got}) and {x.id: x.group_id for x in got} == {i: top(i) for i in boss}
    assert {x.n_copies for x in got if x.id.startswith("copy")} == {29}
    for x in got:
        if not x.id.startswith("copy") and not x.n_copies:
            assert x.n_links <= sum(x.id in p for p in pairs)


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(60)] + [("x", "y"), ("y", "x"), ("q", "q")], "a string, b string")
    got = {r.id: r.group_id for r in neardup.components(chain).collect()}
    assert got == {f"{i:03}": "000" for i in range(61)} | {"x": "x", "y": "x"}
    assert neardup.components(chain.limit(0)).count() == 0
