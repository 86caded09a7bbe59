"""Personal information in free text: find it, name its kind, put typed placeholders in its place.

Anchor expansion: one Aho-Corasick pass over the text in small letters, its blanks, line ends and quote marks
collapsed, finds at-signs and their spelt-out forms, schemes of addresses, begins of numbers, identifier cues, street words,
titles, given names, initials, greetings, closings, labels and words that go with names.  From each anchor a local parser
reads outwards in the text itself, up to where its grammar ends, and validates what it finds; every mention comes from an
anchor.  Words with accents are looked for in the forms, too, that a wrong encoding gives them.  Given names that a text introduces by a
label, a closing or a talk's begin are anchors in the rest of that text.
Where mentions overlap the earlier kind of ``KINDS`` holds, then the longer one.  A mention may be broken by line
ends and quote marks.

Defined results: null and empty texts have no mentions and stay as they are; texts of any length
are handled whole; a text without mentions is returned unchanged; repeated rows of one id
count once.  Positions count code points from 1.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterable, Sequence
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame

from lodestrata.llm import encoding
from lodestrata.llm.common import arrow_map
from lodestrata.llm.mail import CLOSINGS

KINDS = ("email", "id_number", "address", "phone", "name")

_S = r"(?:[ \t\xa0]+|[ \t]*\r?\n[ \t>|]*)"  # a blank, or a line end with quote marks
_U = "A-ZÀ-ÖØ-ÞĀĂĄĆĈĊČĎĐĒĘĚĜĞĢĤĪĮİĶĹĻĽĿŁŃŅŇŌŐŒŔŘŚŜŞŠŢŤŪŮŰŲŴŶŹŻŽ"
_CAP = rf"(?:[{_U}]|[?�](?=[a-z])|[├√┼Ãø][^\sa-z]{{0,3}}(?=[a-z]))[^\s,;:<>()\[\]\"“”„!.@/\\|&=+*#{{}}0-9]*"

#: Words before a family name.
TITLES = "mr mrs ms miss mr. mrs. ms. dr dr. prof prof. sir herr herrn frau fräulein monsieur madame mademoiselle mme mlle m. señor señora dra dra. sr. sra. srta. don doña pan pani pana panu panem panią".split()
#: Street words by the place of the number (before, or after the name).
STREETS_EN = "road street lane avenue drive close hill way court square terrace gardens crescent row walk grove mews rd st ave".split()
STREETS_FR = "rue avenue boulevard impasse chemin place allée quai cours passage route square faubourg sentier bd bd. boul. av. ch. pl.".split()
STREETS_ES = "calle avenida plaza paseo camino carretera ronda travesía glorieta avda. c/ pza.".split()
STREETS_DE = "straße strasse str. weg platz allee gasse ufer ring damm steig markt".split()
STREETS_PL = "ul. al. pl. os. ulica aleja plac osiedle".split()
#: What says that a number identifies a person.
ID_CUES = """
national id|id number|identity number|identity card|social security number|ssn|tax number|tax id|passport|passport number|national insurance number|form
ausweisnummer|personalausweis|steuernummer|steuer-id|steueridentifikationsnummer|sozialversicherungsnummer|reisepass|passnummer|formular|rentenversicherungsnummer
numéro national|numéro de sécurité sociale|numéro fiscal|numéro d’identité|numéro de passeport|formulaire|carte d’identité|passeport
número nacional|número de identidad|número de identificación|número de la seguridad social|número fiscal|dni|nif|nie|pasaporte|formulario|documento de identidad|número de afiliación|documento|n.º de documento|número de documento
numer ewidencyjny|pesel|numer pesel|numer dowodu|dowód osobisty|paszport|numer paszportu|nip|formularzu|numer identyfikacyjny|numer podatkowy|numer ubezpieczenia
""".strip().replace("\n", "|").split("|")
#: Words that greet.
GREETINGS = "hi|hello|dear|good morning|good afternoon|hey|hallo|liebe|lieber|guten tag|guten morgen|sehr geehrte|sehr geehrter|hola|estimado|estimada|querido|querida|buenos días|buenas tardes|bonjour|cher|chère|salut|cześć|witaj|drogi|droga|dzień dobry|szanowny|szanowna|servus|moin"
#: Common given names besides those of the table.
GIVEN = """
anna maria martin thomas peter paul david daniel michael john james robert william mary susan sarah laura julia sophie emma oscar hugo hans karl klaus werner norbert wolf wolfgang
jürgen günter dieter käthe ingrid sabine petra monika renate uwe jens lars sven anton franz josef tomás álvaro josé juan carlos luis miguel pedro pablo antonio javier diego carmen
dolores elena isabel lucas jean pierre jacques michel philippe nicolas françois andré claude louis julien antoine marie claire hélène isabelle catherine nathalie monique camille
kinga piotr krzysztof andrzej tomasz jan stanisław marek michał katarzyna barbara ewa magdalena joanna zofia jadwiga halina bożena aleksandra zbigniew wojciech jerzy adam
george henry charles edward arthur simon philip kevin karen helen margaret elizabeth patricia jennifer
""".split()
#: Given names that are words as well, in small letters.
AMBIGUOUS = set("will may mark rose grace frank carol linda paz pilar cruz blanca grit otto ruth wolf hugo karl mary anton dolores claire jan adam marie camille jerzy peter bodo tara alba".split())
#: Last words of companies and places.
NOT_NAMES = set(
    "foods logistics gmbh ltd partner ag kg inc llc sa sl group holding company co & und and et y i road street lane avenue drive close hill mail phone tel january february march april may june july august september october november "
    "december monday tuesday wednesday thursday friday saturday sunday".split()
)
#: Words before a name.
FULL_CUES = set(
    "for call reach from by with laut an bei von für sie selon pour chez appeler joindre avec según con para zgodnie dla do od według nazwisku contact kontakt contacto ask tell".split()
)
#: Words before a full name, whatever the name.
STRONG_CUES = set("call reach laut bei selon chez appeler joindre według nazwisku schrieb".split())
_NEXT = re.compile(rf"{_S}([^\W\d_][\w-]{{3,}})")
_PAIR = re.compile(rf"(?<![\w@.\-’'/\\+])({_CAP})(?:{_S}([{_U}]\.))?{_S}((?:[{_U}]\.{_S})?{_CAP})")
_INITIAL = re.compile(rf"(?<![\w@.\-])([{_U}]\.(?:-?[{_U}]\.)?){_S}({_CAP})")
_TITLED = re.compile(rf"{_S}(?:(?:Dr|Prof|Doktor)\.?{_S})?({_CAP}(?:{_S}{_CAP})?)")
_COMMA = re.compile(rf"(?<![\w@.\-])({_CAP}),[ \t\xa0]+({_CAP})")
_FORM = re.compile(r"[^\W\d_][\w ]{0,24}[ ]?:[ \t]*")
_NOBODY = re.compile(r"^(all|team|everyone|colleagues|kolleg|tag|morgen|days|compañ|coll|state|sir|madam|ladies|together|zusammen|damen|tous|toutes|todos)", re.I)
_DOMAIN = re.compile(r"(?:[\w-]+\.)+[^\W\d_]{2,}")
_DOT = rf"(?:{_S}?[(\[{{]{_S}?(?:dot|punkt|punto|point|kropka|\.){_S}?[)\]}}]{_S}?|{_S}(?:dot|punkt|punto|point|kropka){_S}|\.)"
_SPELT_DOMAIN = re.compile(rf"{_S}?[\w-]+(?:{_DOT}[\w-]+)*{_DOT}[^\W\d_]{{2,}}(?![\w])")

_PHONE = re.compile(
    rf"(?<![\w+/,-])(?<!\d\.)(?:"
    rf"(?:\(\+\d{{1,3}}\)|\+\d{{1,3}}|00[1-9]\d{{0,2}})(?:{_S}?/?{_S}?\(0\))?(?:(?:{_S}|[./-]|{_S}/{_S})?\(?\d++\)?)+"
    rf"|\(\d{{3}}\){_S}?\d{{3}}[-.\s]\d{{4}}|\d{{3}}([-.])\d{{3}}\1\d{{4}}|\d{{3}} \d{{3}} \d{{4}}"
    rf"|\(?0\d{{1,4}}\)?(?:(?:{_S}|[./-]|{_S}/{_S})\d++)+|0\d{{9,10}}"
    rf"|[5-9]\d\d(?:{_S}|[.-])\d{{3}}(?:{_S}|[.-])\d{{3}}|[5-9]\d\d(?:(?:{_S}|[.-])\d\d){{3}}|[5-9]\d{{8}}"
    rf")(?![\w])(?![./-]\d)(?!,\d)"
)
_DATE = re.compile(r"\d{1,2}[./-]\d{1,2}[./-](?:19|20)\d\d|(?:19|20)\d\d[./-]\d")
_NUMBERED = re.compile(r"(?:\bno\.|\bnr\.?|n[°º.]|n\.º|№|reference|version|build|wersja|versión)[ \n>|]*$", re.I)
_PHONE_CUE = re.compile(r"(?:tel|tél|phone|telefon|téléphone|teléfono|mobil|mobile|móvil|handy|\b[TM]|fax|portable|numer(?:em)?|number|call|unter|on|at|al|au|el|le|is|to|lautet)[.:]?[\s>|]*$", re.I)
_ID = re.compile(
    rf"(?<![\w/.,-])(?:\d{{3}}[- ]\d\d[- ]\d{{4}}|[12](?:{_S}?\d\d){{3}}(?:{_S}?\d{{3}}){{2}}{_S}?\d\d|\d\d{_S}\d{{3}}{_S}\d{{3}}{_S}\d{{3}}|\d\d?\.?\d{{3}}\.?\d{{3}}{_S}?-?{_S}?[A-Z]|[XYZ]-?\d{{7}}-?[A-Z]"
    rf"|[A-Z]{{1,3}} ?\d{{6,9}}|[A-Z]{{2}} ?\d\d ?\d\d ?\d\d ?[A-Z]|\d{{2}}/\d{{8}}/\d{{2}}|\d{{9}}|\d{{11}}|\d{{15}})(?!\w)(?![-./]\d)"
)
_BLANKS = re.compile(r"[\s>|]+")
#: Numbers of this form need no cue.
_ID_ALONE = re.compile(r"\d{3}-\d\d-\d{4}|[12] \d\d \d\d \d\d \d{3} \d{3} \d\d")

_NO = r"\d{1,4}(?:[ ]?(?:bis|ter|quater|[a-zA-Z])\b)?"
_FLAT = rf"(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|Room){_S}\w+,{_S})?"
_FR_NAME = re.compile(rf"{_S}(?:(?:de{_S}la|de{_S}l|du|des|de|d|la|le|l)?(?:{_S}|[’'])?)*{_CAP}")
_ES = re.compile(rf"{_S}?(?:(?:de{_S}la|de{_S}los|de{_S}las|del|de|la|el){_S})*{_CAP}(?:{_S}{_CAP})*,?{_S}(?:n\.?[ ]?[º°o]\.?{_S}?|núm\.?{_S})?\d{{1,4}}")
_DE_NO = re.compile(rf"{_S}{_NO}(?![\d.]\d)")
_PL = re.compile(rf"{_S}(?:{_CAP}{_S}){{1,4}}\d{{1,4}}")
_DE_AT = re.compile(rf"(?<![\w])(?:Am|An{_S}der|An{_S}den|Im|In{_S}der|Zum|Zur|Auf{_S}dem|Auf{_S}der|Unter{_S}den|Hinter{_S}der){_S}[{_U}][\w-]+{_S}{_NO}(?=,|[ ]*\r?\n|$|{_S}\w)")
_EN = re.compile(rf"{_FLAT}{_NO},?{_S}(?:{_CAP}{_S}){{1,3}}")
_FR = re.compile(rf"(?<![\w.,/-]){_NO},?{_S}")
#: Words before a place and its number.
AT_PLACES = "am|an der|an den|im|in der|zum|zur|auf dem|auf der|unter den|hinter der".split("|")
#: Words after a full name, whatever the name; those that say something, and those that say where one lives.
SAYING = ["wrote", "escribió", "escribió:", "napisał", "napisał(a)", "a écrit", "said,"]
LIVING = ["now lives", "lives", "wohnt", "habite", "vive", "mieszka", "ist unter"]
#: Labels before a name.
LABELS = "from|to|cc|von|an|de|à|para|od|do|name|nom|nombre|imię i nazwisko|nombre y apellidos|nom et prénom".split("|")
SEPARATORS = ["--", "__", "~~~", "* * *"]
SCHEMES = ["http://", "https://", "ftp://", "www.", "mailto:"]
#: What spells an at-sign, and a dot.
SPELT_AT, SPELT_DOT = ["(at)", "[at]", "{at}", " at ", "(a)", "[a]"], {"dot", "punkt", "punto", "point", "kropka"}
#: Characters between a cue and its number, blanks collapsed.
REACH = 30
_CUED = re.compile(rf"(?:[\s>|]+|[^\d\s>|]){{0,{REACH - 1}}}?(?<![\w/.,-])([XYZ]-?\d{{7}}-?[A-Z]|[A-Z]{{1,3}} ?\d{{6,9}}|[A-Z]{{2}} ?\d\d ?\d\d ?\d\d ?[A-Z])(?!\w)(?![-./]\d)")
_STOP = re.compile(r"[.;!?][\s>|]+(?=[A-ZÀ-Ž])|\n\s*\n")
_LABELLED = re.compile(rf"[ ]?:?[ \t]*({_CAP}(?:[ ,]+{_CAP}){{0,3}})(?=[ ]*(?:<|\[|\r?\n|$))")
_TALKING = re.compile(rf"[ ]?({_CAP}(?: {_CAP})*)(?=:)")
_CLOSED = re.compile(rf"[ ]?[,.!]?[ ]*\r?\n[ \t>|]*({_CAP}(?: {_CAP})?)[ ]*(?=\r?\n|$)")
_SEPARATED = re.compile(rf"[ ]?\r?\n[ \t>|]*({_CAP} {_CAP}(?: {_CAP})?)[ ]*(?=\r?\n|$)")
_GREETED = re.compile(rf",?{_S}({_CAP})[ ]?[,:!]?[ ]?(?=\r?\n|$)")
_ALONE = re.compile(rf"({_CAP})[ ]?[,:!][ ]?(?=\r?\n|$)")
_GREETS = re.compile(rf"(?:{GREETINGS}) $")
_AFTER = re.compile(rf"{_S}(?:[<\[]\S+@|\((?=[{_U}][^()\n]*\){_S}said))|,{_S}(?:Flat{_S}\d|\d{{1,3}},?{_S}[{_U}a-z]|C/|Calle|Plaza|Avenida|Paseo|ul\.|al\.|pl\.)")
_TOKEN = re.compile(r"\S*")


@lru_cache(1 << 14)
def damaged(word: str) -> frozenset[str]:
    """The word in small letters, as it is and as wrong encodings change it."""
    out = {word.lower()}
    if not word.isascii():
        out.add(unicodedata.normalize("NFD", word).lower())
        for form in {word, word.lower(), word.title(), word.upper()}:
            for lost in ("?", "??", "\ufffd"):
                out.add("".join(c if c.isascii() else lost for c in form).lower())
            for page in encoding.CODE_PAGES:
                once = encoding.misread(form, page)
                out |= {once.lower(), encoding.misread(once, page).lower(), encoding.misread(unicodedata.normalize("NFD", form), page).lower()}
            for wrong, right in encoding.SWAPS:
                try:
                    out.add(form.encode(right).decode(wrong).lower())
                except UnicodeError:
                    pass
    return frozenset(out)


class Finder:
    """Finds the mentions of a text; ``names`` are given names in any spelling of case."""

    def __init__(self, names: Iterable[str | None] = ()):
        self.given = {n.lower() for n in names if n} | set(GIVEN)
        self.lost = {re.sub(r"[^\x00-\x7f]", "?", n) for n in self.given if not n.isascii()}
        anchors: dict[str, set[str]] = {}

        def add(words: Iterable[str], kind: str) -> None:
            for w in words:
                for x in damaged(w):
                    anchors.setdefault(" ".join(x.split()) if x.strip() == x else x, set()).add(kind)

        add(TITLES, "title")
        for ws, kind in ((STREETS_EN, "en"), (STREETS_FR, "fr"), (STREETS_ES, "es"), (STREETS_DE, "de"), (STREETS_PL, "pl")):
            add(ws, kind)
        add(["@"], "at")
        add(SPELT_AT, "spelt")
        add(SCHEMES, "scheme")
        add([f"{a}{d}" for a in " (:[\"'“”„‘’«»=#.;!?*_–—}~\ufeff\ufffd" for d in "0123456789"], "number")
        add(["+" + d for d in "0123456789"] + ["(" + d for d in "+0123456789"], "sign")
        add(ID_CUES, "id")
        add(AT_PLACES, "place")
        add([f"{a}{c.lower()}." for a in " (\"“„«[:" for c in _LETTERS], "initial")
        add(GREETINGS.split("|"), "greeting")
        add(CLOSINGS.strip().replace("\n", "|").split("|"), "closing")
        add([x + end for x in LABELS for end in (":", " :")], "label")
        add([f"{d}] " for d in "0123456789"], "talk")
        add(SEPARATORS, "line")
        add(STRONG_CUES, "cue")
        add(SAYING + LIVING, "after")
        add(self.given, "given")
        self.at = ahocorasick.Automaton()
        for w, kinds in anchors.items():
            self.at.add_word(w, (sorted(kinds), len(w)))
        self.at.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) in text order, without overlaps."""
        return [x[:3] for x in self.anchored(text)]

    def anchored(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, kind, kind of the anchor) in text order, without overlaps."""
        return _settle(_Reading(self, text).got)

    def is_given(self, w: str) -> bool:
        low = w.lower()
        if low in self.given or "-" in low and low.split("-")[0] in self.given:
            return True
        if w.isascii() and "?" not in w:
            return False
        low = low.replace("\ufffd", "?")
        if "?" in low:
            return low in self.lost
        return _restored(w) in self.given


class _Reading:
    """One text read from its anchors; ``got`` has (start, end, kind, kind of the anchor)."""

    def __init__(self, finder: Finder, text: str):
        self.finder, self.text, self.is_given = finder, text, finder.is_given
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        self.got: list[tuple[int, int, str, str]] = []
        origin, begin, parts = [0], 0, [" "]  # the flat text begins with a blank
        for m in _BLANKS.finditer(low):
            a, b = m.span()
            if b - a > 1:
                parts += [low[begin:a], " "]
                origin.extend(range(begin, a + 1))
                begin = b
        parts.append(low[begin:])
        origin.extend(range(begin, len(low) + 1))
        flat = self.flat = _BLANK.sub(" ", "".join(parts))
        self.cue = -1  # where the last cue of an identifier ends, in the flat text
        self.past = {"phone": 0, "name": 0, "at": 0}
        self.url = 0
        self.firsts: set[str] = set()
        names: list[tuple[int, int]] = []
        n = len(flat)
        for end, (kinds, size) in finder.at.iter(flat):
            start, end = end - size + 1, end + 1
            free = not start or not flat[start - 1].isalnum()
            bound = end == n or not flat[end].isalnum() or not flat[end - 1].isalnum()
            a, b = origin[start] if start else 0, origin[end - 1] + 1 if end > 1 else 0
            for kind in kinds:
                if kind == "given":
                    if free and bound and flat[start - 1] not in "@.-_+":
                        names.append((a, b))
                elif kind in ("number", "sign"):
                    self._number(origin[start + 1] if kind == "number" else a, start + (kind == "number"), kind)
                elif kind == "at":
                    self._email(a, b)
                elif kind == "spelt":
                    self._spelt(a, b, flat[start] == " ")
                elif kind == "scheme":
                    self.url = max(self.url, _TOKEN.match(text, a).end()) if flat[start:end] != "mailto:" else self.url
                elif kind == "initial":
                    self._initial(origin[start + 1])
                elif kind == "line":
                    self._introduced(_SEPARATED, a, b, kind)
                elif kind == "talk":
                    if a >= 5 and re.fullmatch(r"\[\d\d:\d\d\] ", text[a - 5 : b]):
                        self._introduced(_TALKING, a - 5, b - 1, kind)
                elif kind in _STREET_KINDS:
                    self._street(a, b, kind, free, bound)
                elif not free:
                    continue
                elif kind == "title":
                    if text[a - 1 : a] not in tuple("@.-") and (text[a].isupper() or text[a:b] in ("pan", "pani", "pana", "panu", "panem", "panią")):
                        self._titled(a, b)
                elif not bound:
                    continue
                elif kind == "id":
                    self.cue = end
                    m = _CUED.match(text, b)
                    if m and not _STOP.search(text, b, m.start(1)):
                        self._add(m.start(1), m.end(1), "id_number", kind)
                elif kind == "place":
                    m = _DE_AT.match(text, a)
                    if m:
                        self._add(a, m.end(), "address", kind)
                elif kind == "greeting":
                    m = _GREETED.match(text, b)
                    if m and self._begins(a) and len(m.group(1)) > 2 and not _NOBODY.search(m.group(1)):
                        self._add(m.start(1), m.end(1), "name", kind)
                elif kind == "closing":
                    self._introduced(_CLOSED, a, b, kind)
                elif kind == "label":
                    if text[a].isupper():
                        self._introduced(_LABELLED, a, b - 1, kind)
                elif kind == "cue":
                    self._cued(a, b)
                elif kind == "after":
                    self._pair_before(a, kind)
        for a, b in names:
            self._given(a, b)
        for first in self.firsts - finder.given:  # names that the text itself introduces
            i, self.past["name"] = low.find(first), 0
            while i >= 0:
                if text[i].isupper():
                    self._given(i, i + len(first), "introduced")
                i = low.find(first, i + len(first))

    def _add(self, a: int, b: int, kind: str, anchor: str) -> None:
        self.got.append((a, b, kind, anchor))

    def _begins(self, at: int) -> bool:
        """A line begins here, but for quote marks."""
        while at and self.text[at - 1] in " \t>|":
            at -= 1
        return not at or self.text[at - 1] == "\n"

    def _tokens(self, at: int, n: int) -> list[int]:
        """Begins of the last n words before a place, the nearest first."""
        text, out = self.text, []
        while len(out) < n:
            while at and (text[at - 1].isspace() or text[at - 1] in ">|"):
                at -= 1
            if not at:
                break
            while at and not (text[at - 1].isspace() or text[at - 1] in ">|"):
                at -= 1
            out.append(at)
        return out

    def _email(self, start: int, end: int) -> None:
        text, a, low = self.text, start, self.past["at"]
        while a > low and (text[a - 1].isalnum() or text[a - 1] in "_.+%-"):
            a -= 1
        self.past["at"] = end
        b = _DOMAIN.match(text, end)
        while a < start and text[a] in ".%-":
            a += 1
        if b and a < start:
            self._add(a, b.end(), "email", "at")
            if a and text[a - 1] in "<[":
                self._pair_before(a - 1, "at")

    def _spelt(self, start: int, end: int, plain: bool) -> None:
        text, a = self.text, start
        while a and text[a - 1] in " \t\xa0":
            a -= 1
        if a and text[a - 1] in "\n>|":
            a = self._back(a)
        end_of_word = first = a
        while True:
            w = end_of_word
            while w and (text[w - 1].isalnum() or text[w - 1] in "_+%-"):
                w -= 1
            if w == end_of_word:
                break
            first, end_of_word = w, self._dot_before(w)
            if end_of_word == w:
                break
        b = _SPELT_DOMAIN.match(text, end)
        if first == a or not b:
            return
        if plain and "." in b.group() and not re.search(r"dot|punkt|punto|point|kropka", b.group()):
            return
        self._add(first, b.end(), "email", "spelt")

    def _back(self, a: int) -> int:
        """Before blanks, line ends and quote marks."""
        while a and (self.text[a - 1].isspace() or self.text[a - 1] in ">|"):
            a -= 1
        return a

    def _dot_before(self, w: int) -> int:
        """Where what precedes a dot, plain or spelt, ends; ``w`` itself where there is none."""
        text = self.text
        if w and text[w - 1] == ".":
            return w - 1
        p = self._back(w)
        if p and text[p - 1] in ")]}":
            o = max(text.rfind(c, max(0, p - 16), p - 1) for c in "([{")  # the longest word for a dot has 6 letters
            inner = text[o + 1 : p - 1].strip(" \t\r\n>|").lower()
            return self._back(o) if o >= 0 and (inner in SPELT_DOT or inner == ".") else w
        q = p
        while q and text[q - 1].isalpha() and p - q < 7:
            q -= 1
        if q < p < w and text[q:p].lower() in SPELT_DOT and self._back(q) < q:
            return self._back(q)
        return w

    def _titled(self, start: int, end: int) -> None:
        if self.text[start:end] == "M." and not _french(self.text, start):
            return
        m = _TITLED.match(self.text, end)
        if not m:
            return
        words = m.group(1).split()
        if words[-1].lower().strip(".") in NOT_NAMES and len(words) == 1 or len(words[0]) < 3:
            return
        one = len(words) == 2 and not self.is_given(words[0])
        self._add(m.start(1), m.start(1) + len(words[0]) if one else m.end(1), "name", "title")

    def _small(self, start: int, end: int) -> None:
        text = self.text
        m = _NEXT.match(text, end)
        if not m:
            return
        if text[start:end] in AMBIGUOUS:
            t = self._tokens(start, 1)
            cue = text[t[0] : self._back(start)].lower().strip("(") if t else ""
            greeted = _GREETS.search(_BLANK.sub(" ", text[self._tokens(start, 3)[-1] if t else 0 : start].lower())) is not None
            if not (greeted or cue in FULL_CUES or cue == "to" and text[m.end() : m.end() + 1] == "," or self._followed(m.end())):
                return
        self._add(start, m.end(), "name", "given")

    def _followed(self, end: int) -> bool:
        """What follows says that a name has ended."""
        if _AFTER.match(self.text, end):
            return True
        m = _AFTER_WORDS.match(self.text, end)
        return m is not None

    def _street(self, start: int, end: int, kind: str, free: bool, bound: bool) -> None:
        text = self.text
        bound = bound or text[end - 1] == "."
        if kind == "en" and bound and free and text[start].isupper():
            for a in reversed(self._tokens(start, 8)):
                if _EN.fullmatch(text, a, start) and not (a and text[a - 1] in "-./0123456789"):
                    self._add(a, end, "address", "street")
                    self._pair_before_comma(a, "street")
                    break
        elif kind == "fr" and bound and free:
            for a in reversed(self._tokens(start, 2)):
                for at in (a, a + 1) if text[a] in "([\"“«" else (a,):
                    n = _FR_NAME.match(text, end)
                    if n and _FR.fullmatch(text, at, start):
                        self._add(at, n.end(), "address", "street")
                        self._pair_before_comma(at, "street")
                        return
        elif kind == "es" and free and text[start].isupper():
            m = _ES.match(text, end)
            if m:
                self._add(start, m.end(), "address", "street")
                self._pair_before_comma(start, "street")
        elif kind == "pl" and free:
            m = _PL.match(text, end)
            if m:
                self._add(start, m.end(), "address", "street")
                self._pair_before_comma(start, "street")
        elif kind == "de":
            at = end
            while not bound and at < len(text) and at < end + 2 and text[at].isalnum():
                at += 1
            if not bound and not (text[start : start + 4].lower() == "stra" and (at == len(text) or not text[at].isalnum())):
                return
            m = _DE_NO.match(text, at)
            if m:
                a = start
                while a and (text[a - 1].isalnum() or text[a - 1] in "-?\ufffd" or not text[a - 1].isspace() and ord(text[a - 1]) > 127):
                    a -= 1
                if a == start and start and text[start - 1] == " ":  # Alter Markt 3
                    t = self._tokens(start, 1)
                    a = t[0] if t and _BEFORE.fullmatch(text, t[0], start) else a
                if text[a : a + 1].isupper():
                    self._add(a, m.end(), "address", "street")

    def _number(self, at: int, flat_at: int, anchor: str) -> None:
        """An identity number or a phone number that begins here."""
        text = self.text
        if at < self.past["phone"] or at < self.url:
            return
        m = _ID.match(text, at)
        if m:
            gap = self.flat[self.cue : flat_at] if 0 <= self.cue <= flat_at and flat_at - self.cue < REACH else None
            cued = gap is not None and not any(c.isdigit() for c in gap) and not _DATE.match(m.group()) and not _STOP.search(text, self._origin(gap, at), at)
            if _ID_ALONE.fullmatch(m.group()) or cued:
                self._add(at, m.end(), "id_number", "id" if cued else anchor)
                self.past["phone"] = m.end()
                return
        m = _PHONE.match(text, at)
        if not m:
            return
        x, end = m.group(), m.end()
        if "\n" in x:  # a number may be broken by a line end, but two lines may also hold two numbers
            lead, rest = x.split("\n", 1)
            if sum(c.isdigit() for c in lead) >= 9:
                x = lead.rstrip()
                end = at + len(x)
            elif re.fullmatch(r"\d{5}\s*", lead):
                x = rest.lstrip(" \t>|")
                at = end - len(x)
        digits = sum(c.isdigit() for c in x)
        if _DATE.match(x) or not 9 <= digits <= 15 or x[0] == "0" and not x.startswith("00") and digits < 10:
            return
        before = self.flat[max(0, flat_at - 24) : flat_at]  # longer than any cue
        if _NUMBERED.search(before) or x.isdigit() and not x.startswith("00") and not _PHONE_CUE.search(before):
            return
        self._add(at, end, "phone", anchor)
        self.past["phone"] = end

    def _origin(self, gap: str, at: int) -> int:
        """Where the gap before a place begins: as many characters back, blanks collapsed."""
        n = len(gap.strip())
        while at and n:
            at -= 1
            if self.text[at].isspace() or self.text[at] in ">|":
                at = self._back(at + 1)
            n -= 1
        return at

    def _initial(self, at: int) -> None:
        m = _INITIAL.match(self.text, at)
        if m and m.group(1) != "P.S." and m.group(2).lower().strip(".") not in NOT_NAMES and len(m.group(2)) > 3 and not (m.group(1) == "M." and _french(self.text, at)):
            self._add(m.start(), m.end(), "name", "initial")

    def _introduced(self, pattern: re.Pattern, start: int, end: int, anchor: str) -> None:
        """A name that a closing, a separator, a label or the begin of a talk introduces."""
        m = pattern.match(self.text, end) if self._begins(start) else None
        if not m:
            return
        words = m.group(1).split()
        if words[-1].lower() in NOT_NAMES - self.finder.given or len(words) == 1 and anchor in ("label", "talk") and not self.is_given(words[0]):
            return
        self._add(m.start(1), m.end(1), "name", anchor)
        if len(words) > 1 and not words[0].endswith(","):
            self.firsts.add(words[0].lower())

    def _pair(self, at: int) -> re.Match | None:
        """First name, initial and last name that begin here, if the last can be one."""
        m = _PAIR.match(self.text, at)
        if not m:
            return None
        last = m.group(3)
        bad = last.lower().rstrip("’'s").strip(".") in NOT_NAMES or last.lower() in NOT_NAMES
        if bad or len(last.strip("-’'")) < 3 or "\n" in m.group() and re.match(r"[ ]?:", self.text[m.end() : m.end() + 2]):
            return None
        return m

    def _unknown(self, m: re.Match | None, anchor: str, by_cue: bool) -> None:
        """A pair whose first name isn't known, with a cue beside it."""
        if m and len(m.group(1)) > 1 and (by_cue or not _common(m.group(1))) and not (m.group(3).lower() in self.finder.given and m.group(1).lower() not in self.finder.given):
            self._add(m.start(), m.end(), "name", anchor)

    def _cued(self, start: int, end: int) -> None:
        at = end
        while at < len(self.text) and (self.text[at].isspace() or self.text[at] in ">|("):
            at += 1
        if at > end:
            self._unknown(self._pair(at), "cue", True)

    def _pair_before(self, end: int, anchor: str) -> None:
        for a in self._tokens(end, 3)[1:]:
            m = self._pair(a)
            if m and m.end() == self._back(end):
                self._unknown(m, anchor, False)
                return

    def _pair_before_comma(self, end: int, anchor: str) -> None:
        at = self._back(end)
        if at < end and at and self.text[at - 1] == ",":
            self._pair_before(at - 1, anchor)

    def _given(self, start: int, end: int, anchor: str = "given") -> None:
        text = self.text
        if text[start].islower():
            if anchor == "given":
                self._small(start, end)
            return
        if start < self.past["name"]:
            return
        m = self._pair(start)
        if m:
            first = m.group(1)
            if self.is_given(first) or first.lower() in self.firsts:
                self._add(m.start(), m.end(), "name", anchor)
                self.past["name"] = m.end()
                return
        if anchor != "given":
            return
        a = self._back_blank(start)
        if a < start and a and text[a - 1] == ",":  # family name first
            t = self._tokens(a, 1)
            m = _COMMA.match(text, t[0]) if t else None
            if m and m.start(2) == start and self.is_given(m.group(2)) and not self.is_given(m.group(1)) and not _PAIR.match(text, start) and self._led(t[0]):
                self._add(m.start(), m.end(), "name", anchor)
                return
        m = _ALONE.match(text, start)
        if m and self.is_given(m.group(1)) and self._begins(start):
            self._add(m.start(1), m.end(1), "name", anchor)

    def _back_blank(self, a: int) -> int:
        while a and self.text[a - 1] in " \t\xa0":
            a -= 1
        return a

    def _led(self, at: int) -> bool:
        """A line or the value of its label begins here."""
        if self._begins(at):
            return True
        line = self.text.rfind("\n", 0, at) + 1
        while line < at and self.text[line] in " \t>|":
            line += 1
        m = _FORM.match(self.text, line)
        return m is not None and m.end() == at


_BEFORE = re.compile(rf"(?<!\w){_CAP} ")
_STREET_KINDS = {"en", "fr", "es", "de", "pl"}
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÄÅÆÇÈÉÊËÍÎÑÓÔÖØÚÛÜĆŁŃŚŹŻ"
_BLANK = re.compile(r"[\s>|]")
_AFTER_WORDS = re.compile(rf"{_S}(?:wrote|escribi\S\S?|napisa\S+|a{_S}écrit|said,|(?:now{_S})?lives|wohnt|habite|vive|mieszka|ist{_S}unter)(?!\w)")


@lru_cache(1 << 15)
def _restored(word: str) -> str:
    """The word in small letters, its accents composed and its encoding restored."""
    return unicodedata.normalize("NFC", encoding.restore(word)[1]).lower()


def _common(word: str) -> bool:
    return word.lower() in {"the", "our", "die", "der", "das", "unser", "le", "la", "les", "notre", "el", "los", "las", "nuestro", "nuestra", "for", "in", "on", "am", "im"}


def _french(text: str, at: int) -> bool:
    """Whether the text around a place is French: its stretch of 2 000 characters and the two beside it."""
    i = at // 2000
    return _french_stretch(text[max(0, i - 1) * 2000 : (i + 2) * 2000])


@lru_cache(64)
def _french_stretch(text: str) -> bool:
    return len(re.findall(r"\b(?:le|la|les|du|des|et|une?)\b", text)) > len(re.findall(r"\b(?:the|and|of|der|die|und|el|los|del|w|na|z)\b", text))


def _settle(got: Sequence[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Without overlaps: the earlier kind holds, then the longer mention. What is taken is kept in order and searched."""
    begins: list[int] = []
    taken: list[tuple[int, int, str, str]] = []
    for x in sorted(set(got), key=lambda x: (KINDS.index(x[2]), x[0] - x[1], x[0], x[3] != "given", x[3])):
        i = bisect_left(begins, x[0])
        if (not i or taken[i - 1][1] <= x[0]) and (i == len(taken) or x[1] <= taken[i][0]):
            begins.insert(i, x[0])
            taken.insert(i, x)
    return taken


def mask(text: str, found: Sequence[tuple[int, int, str]]) -> str:
    """The text with a placeholder for each mention, all else unchanged."""
    out, at = [], 0
    for a, b, kind in found:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def mentions(df: DataFrame, key: str, text: str, names: Iterable[str | None], masked: bool = True) -> DataFrame:
    """(key, found array<struct<start_at, end_at, kind>>, masked) of each text; without ``masked`` that is null."""
    names = list(names)

    def make():
        finder = Finder(names)

        def f(b):
            out: dict[str, list] = {key: [], "found": [], "masked": []}
            for k, t in zip(b[key], b[text]):
                if k is None:
                    continue
                spans = finder.find(t) if t else []
                out[key].append(k)
                out["found"].append([{"start_at": a + 1, "end_at": z, "kind": kind} for a, z, kind in spans])
                out["masked"].append((mask(t, spans) if t else t) if masked else None)
            return out

        return f

    schema = f"{key} {dict(df.dtypes)[key]}, found array<struct<start_at bigint, end_at bigint, kind string>>, masked string"
    return arrow_map(df.select(key, text), make, schema)


def remainders(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, same): whether a text without its ``found`` mentions is its ``masked`` form without the placeholders."""

    def make():
        def f(b):
            out: dict[str, list] = {key: b[key], "same": []}
            for t, found, hidden in zip(b[text], b["found"], b["masked"]):
                at = j = 0
                same = True
                for m in found:
                    lead, mark = t[at : m["start_at"] - 1], f"[{m['kind'].upper()}]"
                    same = same and hidden.startswith(lead + mark, j)
                    j += len(lead) + len(mark)
                    at = m["end_at"]
                out["same"].append(same and hidden[j:] == t[at:])
            return out

        return f

    return arrow_map(df.select(key, text, "found", "masked"), make, f"{key} {dict(df.dtypes)[key]}, same boolean")
