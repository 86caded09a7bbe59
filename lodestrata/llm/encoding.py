"""Text decoded with the wrong character encoding: find it and restore it where possible.

Three kinds of damage are looked for, in this order.

* Multi-byte text read as a legacy code page ("Ã©").  Characters are mapped back to the
  bytes of each code page, and an automaton over the structure of UTF-8 finds the maximal
  well-formed spans; only those spans are decoded, and again while any are left, as
  damage can be repeated.  In a span, letters and marks of Latin script, punctuation, symbols and emoji count alone;
  other scripts count from two characters on, as a French quotation can look like one.
* Single-byte text read as another code page ("rΘsumΘ", "op³aci³").  Words with a
  character that can't stand where it stands (a symbol, another script or a capital
  inside a lower-case word) are mapped back and decoded with the code page that makes all
  words of the text plausible.
* Characters lost for good: the replacement character, C1 controls, and question marks
  within words.

Rare but right letters, decomposed accents and URL escapes are no damage.

Defined results: null, empty and pure ASCII texts without lost characters are sound; what
can't be restored is left as it is; very long texts are handled whole; repeated rows of
one id count once.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import cache
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import arrow_map

#: Code pages by name, in order of preference.
CODE_PAGES = ["cp1252", "cp437", "cp850", "mac_roman", "cp1250", "cp852", "cp1251", "iso8859_2"]
#: Fixed values: (code page it was read as, code page it was written in).
SWAPS = [
    ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1251", "cp1252"), ("mac_roman", "cp1252"), ("cp1252", "cp1250"),
    ("cp852", "cp1250"), ("cp437", "cp1250"), ("cp850", "cp1250"), ("cp1251", "cp1250"), ("mac_roman", "cp1250"),
    ("cp1252", "mac_roman"), ("cp1252", "cp850"), ("cp1252", "cp852"), ("cp1252", "cp437"), ("cp1250", "cp1252"),
]
#: Letters and marks of the languages a restored text may be in.
USUAL = set("äöüßÄÖÜéèêëàâçîïôûùœæÉÈÊÀÂÇÎÏÔÛÙŒÆáíóúñÁÍÓÚÑ¿¡ąćęłńóśźżĄĆĘŁŃÓŚŹŻ’‘“”„‚‘–—«»…•·€§°ºª£ãõÃÕåøÅØþÞðÐ ")


@cache
def _to_bytes(page: str) -> dict[int, int]:
    """Character to byte; bytes that the code page leaves open are those of Latin-1."""
    table = {}
    for b in range(0x80, 0x100):
        try:
            table[ord(bytes([b]).decode(page))] = b
        except UnicodeDecodeError:
            table[b] = b
    if page == "cp1252":
        table |= {b: b for b in range(0x80, 0xA0)}
    return table


@cache
def _of_bytes(page: str) -> list[str]:
    back = {b: chr(c) for c, b in sorted(_to_bytes(page).items())}
    return [chr(b) if b < 0x80 else back.get(b, chr(b)) for b in range(256)]


def misread(text: str, page: str) -> str:
    """The text as it looks when its UTF-8 bytes are read in a code page."""
    table = _of_bytes(page)
    return "".join([table[b] for b in text.encode("utf-8", "surrogatepass")])


#: The automaton of UTF-8 over bytes (as characters below 256): sequences of two, three and four bytes, as many as follow each other.
_WELL_FORMED = re.compile(
    "(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    "|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})+"
)


@cache
def _marks(page: str) -> tuple[re.Pattern, dict[int, int]]:
    """A lead character of the page with one that may follow it; and its characters' bytes, all else mapped to no byte."""
    table = _to_bytes(page)
    lead = re.escape("".join(chr(c) for c, b in table.items() if 0xC2 <= b <= 0xF4))
    rest = re.escape("".join(chr(c) for c, b in table.items() if 0x80 <= b < 0xC0))
    return re.compile(f"[{lead}][{rest}]"), {c: 0xFFFF for c in range(0x80, 0x100)} | table


#: Fixed values: (first, last, script) of characters that a span may yield; those without a script count alone.
SCRIPTS = [
    (0x80, 0x17F, ""), (0x192, 0x192, ""), (0x218, 0x21B, ""), (0x2C6, 0x2DD, ""), (0x300, 0x36F, ""), (0x370, 0x3FF, "Greek"), (0x400, 0x52F, "Cyrillic"), (0x530, 0x58F, "Armenian"), (0x590, 0x5FF, "Hebrew"), (0x600, 0x77F, "Arabic"), (0x900, 0xDFF, "Indic"),
    (0xE00, 0xE7F, "Thai"), (0x10A0, 0x10FF, "Georgian"), (0x1E00, 0x1EFF, ""), (0x1F00, 0x1FFF, "Greek"), (0x200B, 0x27BF, ""), (0x3000, 0x30FF, "Han"), (0x3400, 0x9FFF, "Han"), (0xAC00, 0xD7AF, "Hangul"), (0xF900, 0xFAFF, "Han"),
    (0xFE0F, 0xFE0F, ""), (0xFEFF, 0xFEFF, ""), (0xFF00, 0xFFEF, "Han"), (0x1F000, 0x1FAFF, ""), (0x20000, 0x2FFFF, "Han"),
]
_FIRSTS = [x[0] for x in SCRIPTS]


def _script(c: str) -> str | None:
    """The script that a character counts for, "" if it counts alone, None if it doesn't count."""
    p = ord(c)
    first, last, script = SCRIPTS[max(0, bisect_right(_FIRSTS, p) - 1)]
    return script if first <= p <= last else None


def decode_spans(text: str, page: str) -> tuple[str, int]:
    """The text with its maximal well-formed multi-byte spans decoded, and how many characters they yield."""
    mapped = text.translate(_marks(page)[1])
    found, out, at = 0, [], 0
    for m in _WELL_FORMED.finditer(mapped):
        a = m.start()
        chars = m.group().encode("latin-1").decode()
        for script, same in groupby(chars, _script):
            run = list(same)
            size = sum(len(c.encode()) for c in run)
            if script == "" or script and len(run) > 1:
                out += [text[at:a], *run]
                at = a + size
                found += len(run)
            a += size
    return "".join(out) + text[at:], found


# Characters that can't stand where they stand.  L: Latin letters, U: capitals with marks.
_L = "a-zA-Zß-öø-ÿÀ-ÖØ-ÞĀ-ſ"
_SYMBOL = "∩¢¤¥¦¨©«¬®±²³´¶·¸¹¼½¾¿×÷‡†‰‹›™≤≥≈∞∂∑∏∫√∆◊Ω⌠⌡∙ⁿ₧⌐═-╬▀-▟─│┌┐└┘├┤┬┴┼■¯˘˙˚˛˝ˇˆ˜─-╿"
_ODD = re.compile(
    rf"[Ͱ-ӿ](?=[{_L}])|(?<=[{_L}])[Ͱ-ӿ]"  # Greek or Cyrillic beside Latin
    rf"|(?<=[{_L}])(?:[{_SYMBOL}])(?=[{_L}])"  # a symbol within a word
    rf"|(?<=[{_L}])[─-◿≤≥≈√⌐ⁿ]|[─-◿≤≥≈√⌐ⁿ](?=[{_L}])"
    r"|(?<=[a-zß-öø-ÿąćęłńśźż])[À-ÖØ-ÞŒŠŽŸ](?![A-ZÀ-ÖØ-Þ])"  # a capital after a small letter
    r"|(?<![^\s/\\_])[ûúÛÆ](?= |$)|(?<![^\W_])[OdlDLcCjJsSnNmMtTqQ]Æ(?=[^\W\d_])|(?<=[a-z])·(?=[-_ .\s])"  # a dash, a pound sign, an apostrophe
    r"|(?<![\w.])[¸‰¿³¹](?=[a-z])(?<!¿)|(?<=[a-z])µ(?=[a-z])|(?<=[a-z]{2})[³¹¸¿](?=[\s,.;:!?)]|$)"
)
_NOT_ODD = re.compile(r"(?<=l)·(?=l)|(?<=\b[dlcjmnstDLCJMNST])´(?=[aeiouhyéèêâàôû])", re.I)
_GONE = re.compile(r"�|[\x80-\x84\x86-\x9f]")
_LOST = re.compile(
    rf"(?<=[{_L}])\?+(?=[{_L}])(?!\?\w+=)|(?<![^\s\[(\"“„'/\\>|_-])\?{{1,2}}(?=[a-zß-öø-ÿ]{{2}})(?!\?\w+=)"
    rf"|(?<=[a-z,;–)]) \?{{1,3}} (?=[a-z])|(?<=[{_L}]\s)\?(?=[A-Z{_L}])"
)
_URL = re.compile(r"(?:https?://|www\.)\S+|\?\w+=\S*")


def _swap(text: str) -> str:
    """The text with its non-ASCII words read in the code page that makes them plausible; itself if none does."""
    words = {w for w in text.split() if not w.isascii()}
    best, most = text, 0
    for wrong, right in SWAPS:
        table, good, bad = {}, 0, 0
        for w in words:
            try:
                new = "".join(c if c < "\x80" or c in "’“”„–…" and wrong not in ("cp1252", "cp1250") else bytes([_to_bytes(wrong)[ord(c)]]).decode(right) for c in w)
            except (KeyError, UnicodeDecodeError):
                bad += 1
                continue
            if all(c < "\x80" or c in USUAL for c in new) and not _ODD.search(new):
                good += bool(_ODD.search(w)) * 2 + any(c not in USUAL for c in w)
                table[w] = new
            elif _ODD.search(w):
                bad += 1
        if good - bad > most:
            best, most = "".join([table.get(w, w) for w in re.split(r"(\s+)", text)]), good - bad
    return best


def restore(text: str | None, name: bool = False) -> tuple[bool, str | None]:
    """Whether any part of the text was changed by a wrong encoding, and the text restored as far as possible.

    A ``name`` of a file has no question marks of its own, but an address may end with a query.
    """
    if not text:
        return False, text
    hurt, whole = False, text
    if not text.isascii():
        marked = _marked(text)
        while True:  # a layer makes the text shorter
            pages = [page for page in CODE_PAGES if _marks(page)[0].search(marked) and decode_spans(marked, page)[1]]
            if not pages:
                break
            hurt = True
            text = max((decode_spans(text, page) for page in pages), key=lambda x: len(text) - len(x[0]) + x[1])[0]  # the one that takes most characters
            marked = _marked(text)
        if any(not _NOT_ODD.match(marked, m.start()) for m in _ODD.finditer(marked)):
            hurt, text = True, _swap(text)
        hurt = hurt or bool(_GONE.search(marked))
    if not hurt and name and "?" in whole:
        hurt = "?" in re.sub(r"\?\w+=[^/\\]*$", "", whole)
    elif not hurt and "?" in whole:
        hurt = any(not _in_url(whole, m.start()) for m in _LOST.finditer(whole))
    return hurt, text


def _marked(text: str) -> str:
    """The words with other than ASCII characters; blanks that aren't ASCII may be bytes and split nothing."""
    return " ".join([w for w in text.replace("\n", " ").split(" ") if not w.isascii()])


def _in_url(text: str, at: int) -> bool:
    low = max(text.rfind(" ", 0, at), text.rfind("\n", 0, at)) + 1
    m = re.compile(r"\S*").match(text, low)
    return bool(_URL.search(m.group()))


def garbled(df: DataFrame, key: str, text: str, names: bool = False) -> DataFrame:
    """(key, restored) of the values that a wrong encoding changed; one row per key. ``names``: they are names of files."""

    def make():
        def f(b):
            out: dict[str, list] = {key: [], "restored": []}
            for k, t in zip(b[key], b[text]):
                if k is not None and t:
                    hurt, new = restore(t, names)
                    if hurt:
                        out[key].append(k)
                        out["restored"].append(new)
            return out

        return f

    return arrow_map(df.select(key, text), make, f"{key} {dict(df.dtypes)[key]}, restored string").groupBy(key).agg(F.first("restored").alias("restored"))
