"""Mentions that depend on the language around them."""

import pytest

from lodestrata.llm import pii

ENGLISH, FRENCH = "the crates of the harbour and the keys of the office. " * 150, "le quai du port et la liste des clés, une caisse et les reçus. " * 150


@pytest.mark.parametrize("before, after, want", [(ENGLISH + FRENCH, "", "Dupont"), (FRENCH + ENGLISH, "", "M. Dupont"), (ENGLISH, FRENCH * 3, None), ("", FRENCH, "Dupont"), ("", ENGLISH, "M. Dupont")])
def test_language_around_a_title(before, after, want):
    text = before + "M. Dupont " + after
    got = [text[a:b] for a, b, k in pii.Finder(["Alice"]).find(text) if k == "name"]
    assert got == [want] if want else len(got) == 1


ANCHORS = {"email": {"at", "spelt"}, "id_number": {"id", "number"}, "phone": {"number", "sign"}, "address": {"street", "place"}, "name": {"given", "title", "initial", "greeting", "closing", "label", "talk", "line", "cue", "after", "at", "street", "introduced"}}


def test_every_mention_comes_from_an_anchor():
    import duckdb

    from tests.conftest import DATA

    texts = [r[0] for r in duckdb.execute(f"SELECT DISTINCT attachment.content FROM '{DATA}/leakdata_index.parquet' WHERE attachment.content <> ''").fetchall()]
    names = [r[0] for r in duckdb.execute(f"SELECT given_name FROM '{DATA}/given_names.parquet'").fetchall()]
    finder, n = pii.Finder(names), {}
    for t in texts:
        for _, _, kind, anchor in finder.anchored(t):
            assert anchor in ANCHORS[kind]
            n[kind, anchor] = n.get((kind, anchor), 0) + 1
    by = {k: sum(c for (kind, _), c in n.items() if kind == k) for k in ANCHORS}
    assert by["email"] > 50 and by["name"] > 200 and by["phone"] > 30 and by["address"] > 30 and by["id_number"] > 10
    assert n["name", "given"] > by["name"] / 3


@pytest.mark.parametrize(
    "text, want",
    [
        ("mail " + "a" * 150 + "@x.test now", ["a" * 150 + "@x.test"]), ("to " + "b.c-" * 60 + "d (at) x (dot) test", ["b.c-" * 60 + "d (at) x (dot) test"]),
        ("tax\n> number: 60 964 197 383", ["60 964 197 383"]), ("GrÃ¼ÃŸe an JÃ¼rgen Toreck", ["JÃ¼rgen Toreck"]), ("To: Xaverio Tor\n\nso Xaverio Tor said that", ["Xaverio Tor", "Xaverio Tor"]),
        ("see http://x.test/(312) 555-0156", []), ("x 12,\n\nThe tax number is fine. Call 600 123 456", ["600 123 456"]),
        ("passport no. AB1234567 and more", ["AB1234567"]), ("Quess Drastow <q@x.test> wrote", ["Quess Drastow", "q@x.test"]), ("lives in Am Markt 3, Bad Ort", ["Am Markt 3"]),
    ],
)
def test_local_parsers(text, want):
    f = pii.Finder(["Alice", "Jürgen"])
    assert [text[a:b] for a, b, _ in f.find(text)] == want


@pytest.mark.parametrize("unit", ["ann@x.test ", "Alice Drastow, ", "(at) ", "a.", "tax number ", "+49 30 23125-035 ", "Alice\n> ", "From: Alice Low\n", "12 Mill Lane\n", "A. Low "])
def test_time_grows_with_the_text(unit):
    import time

    f, took = pii.Finder(["Alice"]), []
    for n in (4_000, 16_000):
        begin = time.perf_counter()
        f.find(unit * n)
        took.append(time.perf_counter() - begin)
    assert took[1] < 12 * took[0] + 0.5
