"""Mails reduced to what their sender newly wrote, by a recursive layout grammar over lines.

    mail        := header? part*
    part        := quote | reply | forward | notice | disclaimer | signature | postscript | authored
    quote       := lines led by quote marks, nested by their number
    reply       := (original divider | header block | attribution) (quote | mail)
    forward     := forward divider (quote | mail) end divider?
    signature   := (closing | separator) line*   up to any other part
    attribution := one to four lines naming a writer and a time, up to a colon
    authored    := greeting, body, list lines, answers between quotes

The lines are read once into a tree; the nodes that are open are a stack, so nesting may be of any depth.  A reply or
forward whose text has quote marks ends with them; one without reaches to the end of the message it stands in, a
forward to its end divider.  Only authored nodes and postscripts that no quote, reply or forward holds are new.  Accents are
ignored and lost characters stand for any letter, so damaged mails parse as well.

Defined results: a null or empty mail has no lines; a mail without any layout is authored
whole; blank lines are in no node; lines are numbered from 1; repeated rows of one id count once.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import encoding
from lodestrata.llm.common import arrow_map

#: Names of header fields.
FIELDS = (
    "from to cc bcc sent date subject reply-to attachments von an gesendet datum betreff kopie antwort de a envoye objet copie "
    "para enviado fecha asunto od do wyslano data temat dw"
).split()
#: Closing formulas.
CLOSINGS = """
best regards|kind regards|regards|warm regards|with best wishes|best wishes|all the best|best|many thanks|thanks|thank you|thanks in advance|thanks and regards|cheers|yours sincerely|yours faithfully|yours truly|sincerely|take care
mit freundlichen grüßen|freundliche grüße|beste grüße|viele grüße|schöne grüße|liebe grüße|herzliche grüße|mit besten grüßen|mit herzlichen grüßen|grüße|gruß|viele dank|vielen dank|danke|mfg|lg|vg|hochachtungsvoll
cordialement|bien cordialement|très cordialement|bien à vous|à bientôt|meilleures salutations|sincères salutations|salutations distinguées|salutations|amicalement|merci|merci d’avance|bonne journée
un saludo|saludos|saludos cordiales|un cordial saludo|muchas gracias y un saludo|muchas gracias|gracias|gracias y un saludo|atentamente|un abrazo|reciba un cordial saludo
pozdrawiam|serdecznie pozdrawiam|z poważaniem|pozdrowienia|z pozdrowieniami|z wyrazami szacunku|dziękuję|dziękuję i pozdrawiam|łączę pozdrowienia
"""
#: Beginnings of device notices.
NOTICES = [
    "sent from my", "sent from a mobile", "sent from outlook", "sent via", "get outlook for", "von meinem", "gesendet von", "unterwegs geschrieben",
    "diese nachricht wurde von meinem", "envoyé depuis", "envoyé de mon", "enviado desde", "enviado de mi", "wysłane z", "wysłano z",
]
#: What disclaimers say.
DISCLAIMERS = [
    r"this (message|e-?mail|mail|communication)\b.{0,60}\b(confidential|privileged|intended)", r"content of this e-?mail", r"think of the environment|consider the environment",
    r"not binding unless", r"if you (have )?received (it|this)\b.{0,40}\bin error", r"diese (nachricht|e-?mail)\b.{0,40}\bvertraulich", r"inhalt dieser e-?mail", r"denken sie an die umwelt",
    r"angebote sind freibleibend", r"ce (message|courriel|mail)\b.{0,40}\bconfidentiel", r"contenu de ce (message|courriel)", r"pensez à l.environnement", r"nos offres ne nous engagent",
    r"este (mensaje|correo)\b.{0,40}\bconfidencial", r"contenido de este (mensaje|correo)", r"piense en el medio ambiente", r"nuestras ofertas no son vinculantes",
    r"(ta|niniejsza) wiadomość\b.{0,40}\bpoufn", r"treść (tej|niniejszej) wiadomości", r"(pomyśl|pamięta\w+|proszę pomyśleć)\b.{0,40}\bśrodowisk", r"nasze oferty",
    r"treść (tego|niniejszego) (e-?maila|listu)",
]
#: What stands in a divider before an earlier message, and in one before a forwarded message.
DIVIDERS = "original|urspr|origin|oryginaln|forward|weitergeleitet|transf|reenviad|przekazan|podan|message|nachricht|mensaje|wiadomo"
FORWARDS = "forward|weitergeleitet|transf|reenviad|przekazan|podan"
#: How a line without marks begins that stands before, or after, a forwarded message.
BEGINNINGS = "begin forwarded message|anfang der weitergeleiteten|debut du message|inicio del mensaje|poczatek przekazanej".split("|")
ENDINGS = "end forwarded message|end of forwarded message|end of the forwarded message|ende der weitergeleiteten|fin du message|fin del mensaje|koniec przekazanej|koniec wiadomosci przekazanej".split("|")
VERBS = "wrote|schrieb|a écrit|escribió|napisał|said|sagte|a dit|dijo|powiedział|writes|schreibt"


def fold(text: str) -> str:
    """Small letters without accents, blanks collapsed; each line stays one."""
    t = text.lower()
    if not t.isascii():
        t = "".join(c for c in unicodedata.normalize("NFD", t) if not "̀" <= c <= "ͯ").translate(_LETTERS)
    return t


_LETTERS = str.maketrans({"ł": "l", "ß": "ss", "ø": "o", "\xa0": " ", "’": "'", "‘": "'", "´": "'", "—": "-", "–": "-"})
_LOST = r"(?:\?|�)"


@cache
def _p(pattern: str, flags: int = 0) -> re.Pattern:
    """The pattern over folded text; a letter with an accent may be lost."""
    out = []
    for c in pattern:
        if c.isascii():
            out.append(c)
        else:
            f = fold(c)
            out.append(f"(?:{f}|{_LOST}{{1,2}})" if c != "’" else f"(?:'|{_LOST})")
    return re.compile("".join(out), flags)


_QUOTE = re.compile(r"\s*[>|]")
_FIELD = re.compile(r"[*\s]*(?:" + "|".join(map(re.escape, sorted(FIELDS, key=len, reverse=True))) + r"|env[?�]+|wys[?�]ano|envoy[?�]+|[?�]+)[*]?\s?:(?:\s|$)")
_FIRST_FIELD = re.compile(r"[*\s]*(?:from|von|de|od)[*]?\s?:\s")
CLOSING = _p("(?:" + "|".join(re.sub(r"\s+", r"\\s+", x) for x in sorted(CLOSINGS.strip().replace("\n", "|").split("|"), key=len, reverse=True)) + r")\s*[,.!;]*(?:\s*[-]?\s*(\w[\w.'-]*(?:\s+\w[\w.'-]*){0,2})\s*)?$")
_SEPARATOR = re.compile(r"\s*(?:--|__|~~+|==+|\*\*+|\* \* \*|---|___)\s*$")
_NOTICE = _p(r"\W*(?:" + "|".join(NOTICES) + ")")
_DISCLAIMER = _p("|".join(DISCLAIMERS), re.S)
_DIVIDING = re.compile(DIVIDERS)
_FORWARDING = re.compile(FORWARDS)
_MARKS = "-_=* \t"
_RULE = re.compile(r"\s*_{10,}\s*$|\s*-{10,}\s*$")
_POSTSCRIPT = re.compile(r"\s*(?:p\.\s?s\b\.?|ps\b|p\.\s?d\b\.?|pd\s?[:.-]|pps\b|p\.\s?p\.\s?s)\s?[:.\-–]?")
_ATTRIBUTION = _p(rf"(?:{VERBS})(?:a|\(a\)|\b)[^\n]*:\s*$|(?:{VERBS})(?:a|\(a\))?\s*:\s*$", re.S)
_OPENING = re.compile(r"\s*(?:on|am|le|el|en|dnia|w dniu)\s+(?:\w+[.,]?\s+)?\d")
_DATE = re.compile(r"\d{1,4}[./-]\d{1,2}[./-]\d{2,4}|\d{1,2}\.? \w+ \d{4}|@|\b\d{4}\b")


def _attribution(lines: list[str], i: int) -> int:
    """The line after an attribution that begins at line ``i``, or ``i``."""
    line = lines[i]
    if not (_OPENING.match(line) or "@" in line or ":" in line):
        return i
    joined = ""
    for j in range(i, min(i + 4, len(lines))):
        if not lines[j].strip() or _QUOTE.match(lines[j]):
            return i
        joined += " " + lines[j].strip()
        if joined.endswith(":"):
            opened = _OPENING.match(joined) or "@" in joined
            if _ATTRIBUTION.search(joined) and (opened or _DATE.search(joined)) and (j == i or opened):
                return j + 1
            return i
    return i


def _closing(line: str, raw: str) -> bool:
    """A closing formula, alone or with the name of the sender."""
    m = CLOSING.match(line)
    return bool(m) and (not m.group(1) or all(w[:1].isupper() for w in raw.split()[-len(m.group(1).split()) :]))


def _divider(line: str) -> str | None:
    """'forward', 'end' or 'reply' for a line that divides messages."""
    bare = line.strip(_MARKS)
    if line[:1] in "-_=*" and line[:2].strip("-_=*") == "" and len(line) > 3 and line.rstrip()[-2:].strip("-_=*") == "" and bare:
        if any(bare.startswith(x) for x in ENDINGS):
            return "end"
        if _DIVIDING.search(bare):
            return "forward" if _FORWARDING.search(bare) else "reply"
    if bare.startswith(tuple(BEGINNINGS)):
        return "forward"
    return "end" if bare.startswith(tuple(ENDINGS)) and len(bare) < 80 else None


@dataclass
class Node:
    """A node of the tree: its kind, the numbers of its own lines, and what it holds."""

    kind: str
    lines: list[int] = field(default_factory=list)
    nodes: list[Node] = field(default_factory=list)
    signed: bool = False

    def add(self, kind: str, *lines: int) -> Node:
        """Lines of a kind go to the node of that kind if it is the last one, else to a new one."""
        if not (self.nodes and self.nodes[-1].kind == kind and kind not in ("reply", "forward")):
            self.nodes.append(Node(kind))
        self.nodes[-1].lines += lines
        return self.nodes[-1]


NEW = ("authored", "postscript")


def parse(text: str) -> Node:
    """The tree of a mail."""
    if not text.isascii():
        hurt, fixed = encoding.restore(text)
        if hurt and fixed.count("\n") == text.count("\n"):
            text = fixed
    raw = text.split("\n")
    lines = [" ".join(x.split()) for x in fold(text).split("\n")]
    n, i = len(lines), 0
    root = Node("mail")
    open_ = [root]  # the messages that line i stands in

    def after(j: int) -> int:
        while j < n and not lines[j]:
            j += 1
        return j

    def header(j: int) -> int:
        """The line after a block of header fields that begins at line j."""
        while j < n and lines[j] and not _QUOTE.match(lines[j]):
            j += 1
        return j

    def old(kind: str, to: int, end: int) -> int:
        """An earlier message whose heading ends before line ``to``, and maybe is followed by header fields."""
        node = open_[-1].add(kind, *range(i + 1, end + 1))
        open_[-1].signed = False
        j = after(to)
        if j < n and _FIELD.match(lines[j]) and not _QUOTE.match(lines[j]):
            k = header(j)
            node.add("header", *range(j + 1, k + 1))
            j = after(k)
        if j >= n or not _QUOTE.match(lines[j]):  # without quote marks
            open_.append(node)
        return j

    i = after(0)
    if i < n and _FIELD.match(lines[i]):
        j = header(i)
        root.add("header", *range(i + 1, j + 1))
        i = j
    while i < n:
        line, here = lines[i], open_[-1]
        if not line:
            i += 1
            continue
        if _QUOTE.match(line):
            depth = 0
            node = here
            for c in line:
                if c in ">|":
                    depth += 1
                elif c != " ":
                    break
            node = node.add("quote")
            for _ in range(1, min(depth, 16)):  # deeper ones are one node
                node = node.add("quote")
            node.lines.append(i + 1)
            here.signed = False
            i += 1
            continue
        divides = _divider(line)
        if divides == "end":
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].kind == "forward":
                    del open_[k:]
                    break
            open_[-1].add("end", i + 1)
            open_[-1].signed = False
            i += 1
            continue
        if divides:
            i = old(divides, i + 1, i + 1)
            continue
        rule = _RULE.match(line)
        if rule or _FIRST_FIELD.match(line):
            j = after(i + 1) if rule else i
            k = j
            while k < n and lines[k] and _FIELD.match(lines[k]):
                k += 1
            if k - j >= 2 and _FIRST_FIELD.match(lines[j]):
                i = old("reply", j, j)
                continue
        j = _attribution(lines, i)
        if j > i:
            i = old("reply", j, j)
            continue
        if _POSTSCRIPT.match(line):
            while i < n and lines[i] and not _QUOTE.match(lines[i]):
                here.add("postscript", i + 1)
                i += 1
            continue
        if _NOTICE.match(line):
            here.add("notice", i + 1)
            i += 1
            continue
        if i == 0 or not lines[i - 1]:  # a paragraph begins
            j = i
            while j < n and lines[j] and not _QUOTE.match(lines[j]):
                j += 1
            if _DISCLAIMER.search(" ".join(lines[i:j])):
                here.add("disclaimer", *range(i + 1, j + 1))
                i = j
                continue
        here.signed = here.signed or bool(_SEPARATOR.match(line)) or _closing(line, raw[i])
        here.add("signature" if here.signed else "authored", i + 1)
        i += 1
    return root


def authored(text: str | None) -> list[int]:
    """Numbers of the newly written lines of a mail: those of the new nodes right below its root."""
    return sorted(x for node in parse(text).nodes if node.kind in NEW for x in node.lines) if text else []


def mails(df: DataFrame, path: str = "filename") -> DataFrame:
    """Rows whose path says that they are mails."""
    return df.where(F.col(path).rlike(r"(?i)\.(eml|msg)$"))


def new_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, lines, new_text) of each mail; one row per key."""

    def make():
        def f(b):
            out: dict[str, list] = {key: [], "lines": [], "new_text": []}
            for k, t in zip(b[key], b[text]):
                if k is None:
                    continue
                at = authored(t)
                split = (t or "").split("\n")
                out[key].append(k)
                out["lines"].append(at)
                out["new_text"].append("\n".join(split[x - 1] for x in at))
            return out

        return f

    return arrow_map(df.select(key, text), make, f"{key} {dict(df.dtypes)[key]}, lines array<bigint>, new_text string").dropDuplicates([key])
