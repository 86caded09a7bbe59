"""Operators on single texts."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import encoding, language, mail, pii, truncation

NAMES = ["Alice", "Jürgen", "May", "Róża", "Will", None]


@pytest.fixture(scope="module")
def finder():
    return pii.Finder(NAMES)


@pytest.mark.parametrize(
    "text, want",
    [
        ("You can reach Alice Drastow at alice20@x.test or by phone at (312) 555-0156.", [("name", "Alice Drastow"), ("email", "alice20@x.test"), ("phone", "(312) 555-0156")]),
        ("Mail to edith (dot) sturm (at) quantor-foods.example please", [("email", "edith (dot) sturm (at) quantor-foods.example")]),
        ("paz72[at]mail.kestrin.example!", [("email", "paz72[at]mail.kestrin.example")]),
        ("write to bob at site dot org", [("email", "bob at site dot org")]),
        ("cc @finance and via 192.0.2.57 (build 9.13.9-686) no. RQ-2015-68000 and 165093662021", []),
        ("Ms Łukstow and Dr Brenmark-Selt met", [("name", "Łukstow"), ("name", "Brenmark-Selt")]),
        ("National ID:\t894-58-2773 on file", [("id_number", "894-58-2773")]),
        ("Auf dem Formular steht die Nummer 60 964 197 383 bei Jürgen Toreck.", [("id_number", "60 964 197 383"), ("name", "Jürgen Toreck")]),
        ("The key was left at Flat 3, 95 Quarry Close, Carrowby", [("address", "Flat 3, 95 Quarry Close")]),
        ("wohnt jetzt in Mühlenstraße 38 c, 85773 Marebridge", [("address", "Mühlenstraße 38 c")]),
        ("Adresse : 68, chemin des Prés, 14025 Graufels", [("address", "68, chemin des Prés")]),
        ("Dirección: Avenida del Puerto, n.º 14, 60007 Brzezowo", [("address", "Avenida del Puerto, n.º 14")]),
        ("Adres: ul. Ogrodowa 6/26, 39-357 Łęgowo", [("address", "ul. Ogrodowa 6/26")]),
        ("dated 20 May 2019 and in May", []),
        ("Hi Alice,\n\nsee you\n\nCheers,\nMay\n", [("name", "Alice"), ("name", "May")]),
        ("Tel. +49 (0)30 / 23125-035, 01 99 00 52 56", [("phone", "+49 (0)30 / 23125-035"), ("phone", "01 99 00 52 56")]),
        ("Name:  Ravarz, Alice\n", [("name", "Ravarz, Alice")]),
        ("please call Alice\n> Drastow", [("name", "Alice\n> Drastow")]),
    ],
)
def test_mentions(finder, text, want):
    got = finder.find(text)
    assert [(k, text[a:b]) for a, b, k in got] == [(k, x) for k, x in want] or {(k, text[a:b].split("/")[0]) for a, b, k in got} == {(k, x.split("/")[0]) for k, x in want}


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=200))
def test_any_text_is_masked_without_overlaps(text):
    f = pii.Finder(NAMES)
    spans = f.find(text)
    assert all(0 <= a < b <= len(text) for a, b, _ in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    assert pii.mask(text, []) == text


def test_mentions_of_a_table(spark):
    rows = [("a", "Hi Alice,\n"), ("b", None), ("c", ""), (None, "Hi Alice,"), ("a", "Hi Alice,\n"), ("long", "x " * 100_000)]
    df = spark.createDataFrame(rows, "key string, text string").selectExpr("*", "1 AS found", "2 AS masked")
    got = {r.key: r.masked for r in pii.mentions(df, "key", "text", NAMES).collect()}
    assert got == {"a": "Hi [NAME],\n", "b": None, "c": "", "long": "x " * 100_000}
    assert pii.mentions(df.limit(0), "key", "text", []).count() == 0


SOUND = ["Þjórsá", "SÃO JOÃO relatório", "Ñandú", "Ærø færge", "£ prices", "ÂGE moyen", "CRÈME brûlée", "MAÇÃ preços", "O’Neil order", "naıve", "résumé", "dossier%20été", "x.eml?version=2", "Quoi ?", "plain", "", None, "привет мир", "m³ und m²"]


@pytest.mark.parametrize("text", SOUND)
def test_sound_texts_stay(text):
    assert encoding.restore(text) == (False, text)


@pytest.mark.parametrize("page", ["cp1252", "cp437", "cp850", "mac_roman", "cp1250", "cp1251", "latin-1"])
def test_multi_byte_round_trip(page):
    for text in ["Größentabelle für Jürgen", "le procès-verbal d’été", "reunión del año", "źródła i święta ł", "everyone’s relief – done"]:
        try:
            bad = text.encode().decode(page)
        except UnicodeDecodeError:
            continue
        assert encoding.restore(bad) == (True, text), bad


@pytest.mark.parametrize("page", ["cp1252", "latin-1", "cp437", "mac_roman"])
def test_all_scripts_round_trip(page):
    for text in ["привет мир", "Καλημέρα κόσμε", "你好，世界", "こんにちは", "안녕하세요", "so good 😀 and 🎉", "plain and שלום", "مرحبا"]:
        bad = encoding.misread(text, "cp1252" if page == "latin-1" else page) if page != "latin-1" else text.encode().decode("latin-1")
        assert encoding.restore(bad) == (True, text), (page, bad)
        assert encoding.restore(text) == (False, text)


def test_quotations_are_no_spans():
    for text in ["il dit à\xa0« oui\xa0»", "l’été\xa0» et", "«élan» ’été", "à\xa0» la"]:
        assert encoding.restore(text) == (False, text)


def test_layers_until_none_is_left():
    text = bad = "Prüfbericht für Müller – été"
    for _ in range(7):
        bad = encoding.misread(bad, "cp1252")
    assert encoding.restore(bad) == (True, text)


def test_maximal_spans():
    assert encoding.decode_spans("Ã©Ã¨ Ã x Ã\xa0", "cp1252") == ("éè Ã x à", 3)


@pytest.mark.parametrize("right, wrong", [("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "cp1251"), ("cp1252", "mac_roman"), ("cp1250", "cp1252")])
def test_single_byte_round_trip(right, wrong):
    text = "przewoźnik opłacił kartę wstępu" if right == "cp1250" else "le procès-verbal a été résumé, Gérard für Stück"
    assert encoding.restore(text.encode(right).decode(wrong)) == (True, text)


@pytest.mark.parametrize("text", ["anul� la", "St?ckzahlen", "x\x93y", "Ma?gorzata"])
def test_lost_characters(text):
    assert encoding.restore(text)[0]


def test_twice_damaged_and_partly_damaged():
    twice = "Prüfbericht".encode().decode("cp1252").encode().decode("cp1252")
    assert encoding.restore(twice) == (True, "Prüfbericht")
    assert encoding.restore("Übersicht und " + "Prüfung".encode().decode("cp1252")) == (True, "Übersicht und Prüfung")


def test_garbled_table(spark):
    df = spark.createDataFrame([("a", "rÃ©sumÃ©"), ("a", "rÃ©sumÃ©"), ("b", "ok"), ("c", None), (None, "Ã©")], "key string, text string").selectExpr("*", "1 AS restored")
    assert [tuple(r) for r in encoding.garbled(df, "key", "text").collect()] == [("a", "résumé")]


MAIL = """From: Derek <d@x.test>
To: nora@y.test
Subject: AW: offer

Hi Nora,

The body of
the mail.
- one
-- two

> On 2022-09-05, Will wrote:
> old words

An answer.

Thanks,
Derek Low
-- 
Derek Low
Clerk
T: 020 7946 0219

P.S. One more thing
on two lines.

This message is confidential and meant only for the person named above.

Sent from my phone

On 2023-09-06 at 10:14,
Nora Hill <nora@y.test>
wrote:
Good morning,

all of this is old.
"""


def test_mail():
    lines = MAIL.split("\n")
    assert [lines[i - 1] for i in mail.authored(MAIL)] == ["Hi Nora,", "The body of", "the mail.", "- one", "-- two", "An answer.", "P.S. One more thing", "on two lines."]


@pytest.mark.parametrize(
    "text, want",
    [
        (None, []), ("", []), ("\n\n", []), ("Just words", [1]), ("Dear all,\n\nThanks, received and filed.\n\nThanks,\nBo", [1, 3]), ("Hallo,\n\n-----Ursprüngliche Nachricht-----\nVon: x\n\nalt", [1]),
        ("> q\n\nnew\n\n> q\n\nnew", [3, 7]), ("Bonjour,\n\nDe : A\nEnvoyé : 1\nÀ : B\nObjet : c\n\nvieux", [1]), ("text\n\nMit freundlichen GrÃ¼ÃŸen\nBo", [1]), ("text\n\nMit freundlichen Gr??en\nBo", [1]),
    ],
)
def test_small_mails(text, want):
    assert mail.authored(text) == want


LONG_NOTICE = "This message and all that is attached to it is meant for the person named above only and\n" + "".join(f"holds line {i} of what the lawyers wanted to have said, word by word,\n" for i in range(9)) + "and the content of this e-mail may be protected."
FORWARD = "See below.\n\n---------- Forwarded message ---------\nFrom: Ann <a@x.test>\nTo: b@x.test\nSubject: x\n\nold words\n\nRegards,\nAnn\n{}\n\nAnd what do you think?\n\nThanks,\nBo"


@pytest.mark.parametrize(
    "text, want",
    [
        ("Hi,\n\nnew words.\n\n" + LONG_NOTICE, ["Hi,", "new words."]), (FORWARD.format("---------- End of forwarded message ---------"), ["See below.", "And what do you think?"]),
        (FORWARD.format("Ende der weitergeleiteten Nachricht"), ["See below.", "And what do you think?"]), (FORWARD.format(""), ["See below."]),
        ("top\n\n-----Original Message-----\n> From: Ann\n> old\n\nanswer below", ["top", "answer below"]), ("Bo Low\n\nThanks,\nBo\n> quoted\nanswer after a signature", ["Bo Low", "answer after a signature"]),
        ("a\n" + ">" * 5000 + " deep\nb", ["a", "b"]), ("a\n\n" + "-----Original Message-----\n" * 3000 + "old", ["a"]), ("x" * 200 + " wrote it.\nOn 2020-01-02 " + "Ann " * 60 + "wrote:\n> old\nnew", ["x" * 200 + " wrote it.", "new"]),
    ],
)
def test_trees_of_mails(text, want):
    lines = text.split("\n")
    assert [lines[i - 1] for i in mail.authored(text)] == want


def test_every_line_is_in_one_node():
    def all_lines(node):
        return node.lines + [x for child in node.nodes for x in all_lines(child)]

    for text in (MAIL, FORWARD, FORWARD.format("End of forwarded message"), "> > a\n> b\nc"):
        assert sorted(all_lines(mail.parse(text))) == [i for i, x in enumerate(text.split("\n"), 1) if x.strip()]
    nested = mail.parse("> > a\n> b").nodes[0]
    assert nested.kind == "quote" and nested.lines == [2] and nested.nodes[0].lines == [1]


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab >|-:@\n.,é0"), max_size=200))
def test_any_mail_has_numbered_lines(text):
    lines = text.split("\n")
    got = mail.authored(text)
    assert got == sorted(set(got)) and all(lines[i - 1].strip() for i in got)


def test_mail_table(spark):
    df = spark.createDataFrame([("a", "x.EML", "Hi,\n\nwords"), ("a", "x.EML", "Hi,\n\nwords"), ("b", "y.txt", "no"), ("c", None, "no"), ("d", "z.msg", None)], "sha256 string, filename string, content string").selectExpr("*", "1 AS lines")
    got = {r.sha256: (r.lines, r.new_text) for r in mail.new_lines(mail.mails(df), "sha256", "content").collect()}
    assert got == {"a": ([1, 3], "Hi,\nwords"), "d": ([], "")}


@pytest.mark.parametrize("label, want", [("DE", "de"), ("de-AT", "de"), ("deu", "de"), ("German", "de"), ("xx", None), ("", None), (None, None), ("en_GB", "en"), ("und", None)])
def test_labels(label, want):
    assert language.label_language(label) == want


SENTENCES = {
    "en": "The harbour office collected the meeting minutes before the books were closed, and nobody had asked for it.",
    "de": "Die Buchhaltung prüfte den Mietvertrag und verschob die Übergabe im Auftrag des Eigentümers auf Montag.",
    "fr": "Le comité de projet a vérifié la liste de livraison et la direction a signé le contrat sans préavis.",
    "es": "La oficina del puerto revisó el contrato de alquiler y devolvió las llaves antes del cierre contable.",
    "pl": "Główny księgowy sprawdził umowę najmu i przełożył zebranie na koszt klienta bez uprzedzenia.",
}


@pytest.fixture(scope="module")
def model():
    more = {"en": "We will send it to you when they have it with this.", "de": "Wir werden es nicht mit der Post an ihn senden, wenn sie es haben.", "fr": "Nous vous le ferons parvenir avec les autres quand ils seront là.", "es": "Nosotros se lo enviaremos a usted cuando ellos lo tengan con este.", "pl": "My wyślemy to do nich, kiedy będą mieli je ze sobą."}
    return language.fit([(g, t) for g, t in SENTENCES.items()] * 3 + [(g, t) for g, t in more.items()] * 3)


def test_languages_of_new_sentences(model):
    tagger = language.Tagger(model)
    for g, t in {"en": "they have the minutes with this contract before it was closed", "de": "wenn der Mietvertrag nicht an die Buchhaltung gesendet werde", "fr": "la direction vous a signé les contrats avec le comité", "es": "ellos revisó las llaves cuando el contrato antes del puerto", "pl": "kiedy sprawdził zebranie ze sobą na koszt najmu"}.items():
        (s, e, lang, c), *rest = tagger.segments(t + ".")[0]
        assert lang == g and not rest and c > 0.8


def test_mixed_text(model):
    text = SENTENCES["de"] + "\n\n" + SENTENCES["en"] + " Ja.\n\n" + SENTENCES["pl"]
    got = language.Tagger(model).segments(text)[0]
    assert [x[2] for x in got] == ["de", "en", "pl"]
    assert all(text[s:e].strip() for s, e, _, _ in got)
    assert language.Tagger(model).segments("Ja. 123 a@b.test")[0] == [] and language.Tagger(model).segments(None)[0] == []


@pytest.fixture(scope="module")
def fitted_model():
    import duckdb

    rows = duckdb.execute("SELECT attachment.language, attachment.content FROM '/root/testdata/sf0.01/leakdata_index.parquet' WHERE attachment.content <> ''").fetchall()
    return language.fit([(language.label_language(g), t) for g, t in rows if language.label_language(g)])


def test_other_languages_and_nouns(fitted_model):
    tagger = language.Tagger(fitted_model)
    it = "La commissione ha verificato l'elenco delle consegne e la direzione ha firmato il contratto senza alcun preavviso, perché così voleva. "
    ru = "Портовая служба собрала протоколы собрания до закрытия книг, и никто об этом не просил. "
    assert [x[2] for x in tagger.segments(ru * 3)[0]] == [language.OTHER]
    assert [x[2] for x in tagger.segments(it * 3)[0]] == [language.OTHER]
    assert [x[2] for g in SENTENCES for x in tagger.segments(SENTENCES[g])[0]] == list(SENTENCES)
    nouns = "Mietvertrag Buchhaltung Übergabe Eigentümers Auftrag Montag Buchhaltungen Mietverträge Übergaben"
    assert [x[2] for x in tagger.segments(nouns)[0]] == ["de"]


def test_long_words_are_scored_whole(model):
    lead = "donaudampfschifffahrts"
    assert model.score(lead * 2)[1] < model.score(lead)[1] < 0
    long = model.score(lead * 2000)
    assert np.isfinite(long).all() and abs(long[1] / model.score(lead * 100)[1] - 20) < 1


def test_confidence_follows_the_lead(model):
    tagger = language.Tagger(model)
    c = [tagger.confidence(np.array([0.0, -x, -50, -50, -50])) for x in (0.1, 1, 5, 50)]
    assert c == sorted(c) and c[0] < 0.9 and c[-1] > c[0]


def test_forward_sums_all_segmentations():
    m = language.Model([b" ", b"a", b"b", b"ab", b" a"], ["x"])
    p = 1 / 5
    # " ab": " "+"a"+"b", " "+"ab", " a"+"b"
    assert abs(float(m.score("ab")[0]) - __import__("math").log(p**3 + 2 * p**2)) < 1e-9


def test_language_table(spark, model):
    rows = [("a", SENTENCES["de"], "German"), ("b", SENTENCES["de"], "en"), ("c", SENTENCES["de"] + "\n" + SENTENCES["en"], "de"), ("d", None, "de"), ("e", "", None), ("a", SENTENCES["de"], "German"), (None, "x", "de")]
    df = spark.createDataFrame(rows, "key string, text string, label string").selectExpr("*", "1 AS segments", "2 AS confidence")
    got = {r.key: (r.label_right, [s.lang for s in r.segments]) for r in language.languages(df, "key", "text", "label", model).collect()}
    assert got == {"a": (True, ["de"]), "b": (False, ["de"]), "c": (False, ["de", "en"]), "d": (True, []), "e": (False, [])}
    assert language.fitted(df.limit(0), "key", "text", "label").own == set()


def test_aligned_copies():
    whole = "The quick brown fox jumps over the lazy dog while the old farmer counts his many sheep near the river, and all is well.\n\n- one item\n- the insurance file"
    assert truncation.ends_early(whole[:-8], whole) and truncation.ends_early(whole[:90], whole) and not truncation.ends_early(whole, whole)


def test_share_by_source(spark):
    rows = spark.createDataFrame([("a", "s"), ("b", "s"), ("b", "s"), ("c", None)], "key string, source string")
    got = {r.source: (r.n, r.n_cut) for r in truncation.share_by_source(rows, rows.where("key = 'a'").select("key"), "key", "source").collect()}
    assert got == {"s": (2, 1), None: (1, 0)}


@pytest.mark.parametrize("text", ["1" * 50_000, "00" + "1" * 20_000 + "x", "a" * 100_000, "ab.c" * 30_000, "é" * 50_000, "x@" * 20_000, "\n" * 50_000, " " * 100_000, "> | " * 20_000, "A " * 50_000, "( " * 20_000, "a?b" * 20_000, "Ã©" * 20_000, "рйс" * 20_000])
def test_long_texts_take_no_time(finder, model, text):
    import time

    from lodestrata.llm import abuse

    begin = time.time()
    finder.find(text)
    encoding.restore(text)
    mail.authored(text)
    language.Tagger(model).segments(text)
    abuse.passages(text)
    shapes = truncation.Shapes(__import__("numpy").zeros((2, truncation.BUCKETS), int))
    shapes.shape(text), shapes.possible(text)
    truncation.ends_early(text, text + text)
    assert time.time() - begin < 15
