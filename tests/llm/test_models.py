"""Packing and the classifier."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import abuse, packing


def packed_sizes(made):
    return [dict(p) for p, n in zip(made.patterns, made.times) for _ in range(n)]


@settings(max_examples=100, deadline=None)
@given(st.integers(2, 40), st.lists(st.integers(1, 40), max_size=60))
def test_plan_packs_every_item_once(capacity, sizes):
    sizes = [s for s in sizes if s <= capacity]
    made = packing.plan(np.bincount(sizes, minlength=capacity + 1) if sizes else np.zeros(capacity + 1, int), capacity)
    boxes = packed_sizes(made)
    assert sorted(s for b in boxes for s, n in b.items() for _ in range(n)) == sorted(sizes)
    assert all(sum(s * n for s, n in b.items()) <= capacity for b in boxes)
    assert made.containers <= len(sizes)


def test_plan_fills_exactly_where_it_can():
    counts = np.zeros(101, int)
    for s in (100, 60, 40, 50, 25, 25, 70, 10, 20):
        counts[s] += 1
    assert packing.plan(counts, 100).containers == 4


def test_plan_is_close_to_the_bound():
    r = np.random.default_rng(3)
    sizes = np.clip(r.gamma(1.5, 250, 20_000).astype(int), 1, 2048)
    made = packing.plan(np.bincount(sizes, minlength=2049))
    assert made.containers <= np.ceil(sizes.sum() / 2048) + 2


def test_packed_table(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdef") for _ in range(6))
    rows = [(i, " ".join(word() for _ in range(r.choice([5, 30, 30, 30, 40])))) for i in range(300)]
    rows += [(900, "word " * 700), (901, None), (902, ""), (903, " "), (None, "no id"), (0, "the same id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS piece", "2 AS rank", "3 AS bucket")
    got = packing.packed(df, "doc_id", "text", capacity=256).collect()
    texts = dict(rows)
    full = {}
    for x in got:
        assert (x.container is None) == (x.n_tokens == 0) and x.n_tokens <= 256
        if x.container is not None:
            full[x.container] = full.get(x.container, 0) + x.n_tokens
    assert max(full.values()) <= 256 and sorted(full) == list(range(len(full)))
    pieces = sorted((x.piece, x.start_at, x.end_at, x.n_tokens) for x in got if x.doc_id == 900)
    assert len(pieces) > 1 and [p[3] for p in pieces[:-1]] == [256] * (len(pieces) - 1)
    assert "".join(texts[900][a - 1 : b] for _, a, b, _ in pieces) == texts[900]
    assert len(got) == len(rows) - 1 + len(pieces)
    assert packing.fill(packing.packed(df, "doc_id", "text", capacity=256), 256).first().share > 0.85
    assert packing.packed(df.limit(0), "doc_id", "text").count() == 0


BAD = ["you are a worthless {} and everybody knows it", "shut your damn mouth you {}", "those {} are vermin and must be driven out", "i hope you choke on it you {}"]
WHO = ["idiot", "clown", "moron", "fool", "loser"]
GOOD = ["the carrier counted the crates near the dock", "the office paid the invoice before noon", "the clown at the party counted the children", "the farm sold one cow and two rats", "please shut the door when you leave", "the vermin in the cellar were removed"]


def corpus(r, n, noise):
    rows = []
    for _ in range(n):
        text = [r.choice(GOOD) + f" on day {r.randrange(30)}." for _ in range(r.randrange(3, 12))]
        bad = r.random() < 0.3
        if bad:
            text.insert(r.randrange(len(text)), r.choice(BAD).format(r.choice(WHO)) + r.choice([".", "!", "!!"]))
        rows.append((" ".join(text), "en", bad, float(bad != (r.random() < noise))))
    return rows


def test_classifier_on_held_out_texts():
    r = random.Random(4)
    train, test = corpus(r, 400, 0.06), corpus(r, 300, 0)
    net = abuse.fit([(t, g, y) for t, g, _, y in train] + [(t, g, None) for t, g, _, _ in corpus(r, 100, 0)])
    slots = abuse.Slots()
    got = [bool(net.score([slots(p) for p in abuse.passages(t)]).max() >= net.thresholds["en"]) for t, _, _, _ in test]
    want = [b for _, _, b, _ in test]
    hit = sum(g and w for g, w in zip(got, want))
    assert hit / sum(want) > 0.9 and hit / max(1, sum(got)) > 0.9


def test_words_in_disguise():
    assert abuse._norm("w0rthle$$") == abuse._norm("Worthless") == abuse._norm("worthlessss") == "worthless" or abuse._norm("w0rthle$$") == "worthless"
    assert abuse.passages("you i d i o t now here")[0] == ["you", "idiot", "now", "here"]
    assert abuse.passages(None) == abuse.passages("") == []


def test_scores_of_a_table(spark):
    r = random.Random(6)
    train = corpus(r, 200, 0)
    docs = spark.createDataFrame([(i, t, g) for i, (t, g, _, _) in enumerate(train)] + [(1000, None, None), (1001, "", "xx"), (None, "text", "en"), (0, "again", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, "r", int(y)) for i, (_, _, _, y) in enumerate(train)] + [(0, None, 1), (None, "r", 1), (5, "r", None)], "doc_id long, reviewer string, label int")
    net = abuse.trained(docs, "doc_id", "text", "lang", labels, "label")
    got = abuse.scores(docs.selectExpr("*", "'s' AS source", "1 AS score"), "doc_id", "text", "lang", net)
    rows = {x.doc_id: x for x in got.collect()}
    assert len(rows) == got.count() and rows[1000].score == rows[1001].score == 0
    assert sum(rows[i].flagged == bool(y) for i, (_, _, _, y) in enumerate(train)) > 185
    rates = abuse.rates(docs.selectExpr("doc_id", "'s' AS source"), "doc_id", "source", got).first()
    assert rates.n == len(train) + 2


@pytest.mark.parametrize("rows", [[], [("words only", "en", 0.0)], [(None, None, 1.0)]])
def test_nothing_to_learn(rows):
    assert abuse.fit(rows).score([[1, 2, 3]]).tolist() == [0.0]
