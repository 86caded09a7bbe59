"""Cut texts: near-copies by bands and alignment, shapes of endings, limits, messages."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import truncation
from lodestrata.llm.words import words_of

COLUMNS = "key string, text string"


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(3)) for _ in range(n))


def found(spark, rows):
    return {r.key: r.how for r in truncation.truncated(spark.createDataFrame(rows, COLUMNS), "key", "text").collect()}


LIST = "\n\n- one of the crates\n- papers of the harbour"
BODY = "The carrier counted the damaged crates near the loading dock before noon. "


@pytest.fixture(scope="module")
def corpus():
    return [(f"w{i}", f"{words(700 + i, 40)}. " + words(800 + i, 20) + ".") for i in range(60)]


def test_every_copy_that_goes_on_is_aligned(spark, corpus):
    body = words(1, 60)
    rows = [
        ("open", body + LIST), ("goes on", body + LIST + " master\n- keys"),
        ("edited", words(3, 30) + " small edit " + words(4, 30) + LIST), ("whole", words(3, 30) + " other edits " + words(4, 30) + LIST + " master, tea and a lot more."),
        ("copy", body + LIST), ("much longer", body + LIST + " master and " + words(7, 900) + "."),
    ]
    got = found(spark, rows + corpus)
    assert {k for k, how in got.items() if how == "near-copy"} == {"open", "edited", "copy"}


def test_words_and_sentences_that_go_on(spark, corpus):
    other = words(5, 50)
    rows = [
        ("whole by its end", other + " the final rate is 3."), ("decimal", other + " the final rate is 3.25 at most."),
        ("alone", words(8, 50) + LIST), ("twice", words(9, 50) + LIST + " master\n\n" + words(9, 50) + LIST),
        ("mid word", words(10, 50) + " the harb"), ("word", words(10, 50) + " the harbour"),
    ]
    got = found(spark, rows + corpus)
    assert got["whole by its end"] == got["mid word"] == "near-copy" and "alone" not in got and "twice" not in got and got.get("word") != "near-copy"


def test_any_copy_cut_at_half_its_words_or_later_shares_a_band():
    r = random.Random(1)
    for seed in range(60):
        whole = words(seed, r.randrange(40, 300))  # no edits: every beginning is equal
        cut = whole[: r.randrange(len(whole) // 6, len(whole) - 1)].rstrip()
        if len(cut.split()) > truncation.FIRST:
            assert truncation.ends_early(cut, whole), (cut, whole)
        assert not truncation.ends_early(whole, cut)
        assert not truncation.ends_early(cut, words(seed + 1000, 100))


def test_bands_are_those_of_beginnings():
    a, b = words(1, 130), words(1, 70)
    own = truncation.bands(words_of([a, b, None, "one"]))
    assert (own[:3, 0] == own[:3, 1]).all() and (own[-1, 0] != own[-1, 1]).any()
    assert truncation._level(np.array([0, 15, 16, 31, 32, 63, 64])).tolist() == [-1, -1, 0, 0, 1, 1, 2]


def test_shapes():
    shapes = truncation.Shapes(np.zeros((2, truncation.BUCKETS), int))
    for text, want in {
        BODY: "end prose", BODY + "After the audit, the project boa": "word prose", BODY + "and so on […]": "mark", BODY + "\n\nBest regards,\nAnna Low": "word signature", BODY + "\n\nViele GrÃ¼ÃŸe\nUte Low": "word signature",
        BODY + "\n- one\n- the crates": "word item", "a;b;c\n1;2;3\n4;5": "word", "ok": "word phrase", "": "", '{"a": 1, "b': "unclosed", BODY + "write to anna@har": "address", BODY + "\n[10:12] Ann: so then": "word talk",
    }.items():
        assert shapes.shape(text).startswith(want), text
    assert all(shapes.possible(BODY * n) for n in range(1, 9)) and shapes.possible("ok") == ""


def test_closing_words_are_compared_with_the_corpus():
    counts = np.zeros((2, truncation.BUCKETS), int)
    slot = lambda word: int(words_of([word]).hash[0] % np.uint64(truncation.BUCKETS))
    counts[0, slot("other")], counts[1, slot("other")], counts[0, slot("boa")] = 700_000, 300_000, 100
    assert truncation.Shapes(counts).closing("the boa") == "never" and truncation.Shapes(counts).closing("other") == "often"  # thirty line ends are expected
    counts[:, slot("other")], counts[0, slot("boa")] = (999_900, 100), 400
    shapes = truncation.Shapes(counts)
    assert shapes.closing("the boa") == "some" and shapes.closing("the never seen") == "new" and shapes.closing("7") == "none"  # none is expected


def test_probabilities_of_shapes():
    ends = Counter({"end prose often": 800, "word signature often": 150, "word prose new": 30, "word prose some": 20, "mark": 9, "": 5})
    possible = Counter({"end prose often": 20, "word signature often": 80, "word prose new": 500, "word prose some": 400})
    got = truncation.cut_shapes(ends, possible)
    assert got["word prose new"] > 0.8 and got["word prose some"] > 0.8 and got["end prose often"] < 0.01 and got["word signature often"] < truncation.LEAST
    assert truncation.cut_shapes(Counter(), possible) == truncation.cut_shapes(ends, Counter()) == {}


def test_truncated_table(spark, corpus):
    rows = [(f"w{i}", BODY * 3 + f"Best regards,\nAnna Low {i}\nClerk of the harbour\nmany old words") for i in range(30)]
    rows += corpus + [(f"wl{i}", BODY + f"\n- {words(i, 2)}\n- the {words(50 + i, 1)}") for i in range(9)]
    rows += [("cut", BODY * 3 + "After the audit, the project boa"), ("mark", BODY + "and so on […]"), ("sig", "Quite another letter, which nobody else has sent so far, tells of summer days.\n\nBest regards,\nAnna Low"), ("list", BODY + "\n- one of the crates\n- the crates"), ("n", None), ("e", ""), (None, "x y z"), ("cut", BODY * 3 + "After the audit, the project boa")]
    df = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "1 AS how", "2 AS h", "3 AS id")
    got = sorted(r.key for r in truncation.truncated(df, "key", "text").collect() if not r.key.startswith("w"))
    assert got == ["cut", "mark"]
    assert truncation.truncated(df.limit(0), "key", "text").count() == 0
    assert truncation.truncated_messages(df.selectExpr("key", "text AS message"), "key", "message").where("key = 'mark'").count() == 1


def _piled(spark, rows):
    df = spark.createDataFrame(rows, "text string, source string").select(F.xxhash64(F.translate("text", "123456789", "0" * 9)).alias("alike"), "source", F.length("text").alias("chars"), F.octet_length("text").alias("bytes"))
    return {tuple(r) for r in truncation.pile_ups(df).collect()}


def test_rare_limits_pile_up(spark):
    r = random.Random(3)
    rows = [(words(100 + i, 80)[: 6 * i + 40], None) for i in range(60)] + [(words(500 + i, 80)[:500], None) for i in range(7)]
    assert _piled(spark, rows) == {("chars", 500, None), ("bytes", 500, None)}
    rows = [(words(900 + i, 60)[: r.randrange(100, 130)], None) for i in range(300)]
    assert _piled(spark, rows) == set()


def test_limits_of_texts_with_one_beginning(spark):
    head = "Report of the harbour office on the crates that were counted and weighed near the loading dock"
    rows = [(head + words(i, 90)[: 5 * i + 100], "a") for i in range(60)] + [(head + words(300 + i, 90)[:300], "a") for i in range(30)]
    rows += [(f"{head} {i:04}", "a") for i in range(300)]  # equal but for a number
    assert {x[:2] for x in _piled(spark, rows)} == {("chars", len(head) + 300), ("bytes", len(head) + 300)}


def test_limit_of_one_source(spark):
    rows = [(words(i, 40)[: 140 + i % 21], "most") for i in range(630)] + [(words(2000 + i, 40)[:150], "few") for i in range(9)]
    assert _piled(spark, rows) == {("chars", 150, "few"), ("bytes", 150, "few")}


def test_sketch_grows_with_the_input(spark, monkeypatch):
    monkeypatch.setattr(truncation, "buckets_for", lambda df: 1 << 21)
    counts = truncation.closing_counts(spark.createDataFrame([("one of the crates\nmore words",)], "text string"), "text")
    assert counts.shape == (2, 1 << 21) and truncation.Shapes(counts).seen("crates") == (0, 1)


def test_every_message_is_judged(spark):
    rows = [("tabs", "Skipped\tthe\tworker"), ("form", "Skipped the worker entry since its size is wrong."), ("longer", "Skipped the image of the other list since nobody had asked for it at all."), ("ok", "ok"), ("mark", "tronqué"), ("Mark", "Truncated"), ("n", None), ("e", " ")]
    got = {r.key for r in truncation.truncated_messages(spark.createDataFrame(rows, COLUMNS), "key", "text").collect()}
    assert got == {"tabs", "mark", "Mark"}


def test_messages_are_compared_with_every_form(spark):
    rows = [("cut", "Skipped the worker entry 7a si"), ("short", "Skipped the wor"), ("form", "Skipped the worker entry 8b since its size is wrong."), ("longest", "Skipped the big red image list that nobody had ever asked for at all."), ("lost", "Connection los"), ("lost2", "Connection lost to 10.0.0.1 after 5 s")]
    got = {r.key: r.how for r in truncation.truncated_messages(spark.createDataFrame(rows, COLUMNS), "key", "text").collect()}
    assert {k for k, how in got.items() if how == "near-copy"} == {"cut", "short", "lost"} and not got.keys() & {"form", "longest"}
