"""Personal data in text, also where it is disguised, with spans in the offsets of the source text.

A chain of transducers rewrites a text and remembers which source characters each rewritten one came from:
homoglyphs become ASCII and invisible characters go, spelled IP addresses become written ones, "at"/"dot" disguises become ``@`` and ``.``, and
spelled digits become digits. The same detectors run on the source text (base spans) and on the rewritten text;
what they find in the latter is mapped back and added unless a base span of its kind already covers it.
"""

from __future__ import annotations

import bisect
import re
import sys
import unicodedata
from functools import cache
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_columns

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A match can only start where a run of digits starts, so the lookbehind changes nothing but the time on long runs.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def detect(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, leftmost and non-overlapping within a kind, by kind and then start."""
    found: list[tuple[str, int, int]] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and _luhn(digits):
                found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


# Characters of other scripts that are drawn like an ASCII one (Cyrillic, Greek, Armenian), dashes and stops.
_LOOKALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТХУҮԌԚԜаеѕіјорсухһӏԁԛԝүΑΒΕΖΗΙΚΜΝΟΡΤΥΧαονρικυսօոհ‐‑‒–—−。",
        "ABESIJKMHOPCTXYYGQWaesijopcyxhldqwyABEZHIKMNOPTYXaovpikuuonh------.",
        strict=True,
    )
)
_INVISIBLE = "­​‌‍⁠﻿"


def _plain(c: str) -> str:
    """The ASCII character that c is drawn like; none for an invisible one; c itself otherwise.

    Beside the fixed values: decimal digits of any script, and letters, signs and blanks whose compatibility form is one
    ASCII character (wide, mathematical and the like; no superscripts).
    """
    if c in _INVISIBLE:
        return ""
    if c in _LOOKALIKES:
        return _LOOKALIKES[c]
    if (d := unicodedata.decimal(c, None)) is not None:
        return str(d)
    n = unicodedata.normalize("NFKC", c)
    return n if len(n) == 1 and n.isascii() and unicodedata.category(c) not in ("No", "Lo", "Lm") else c


@cache
def _foreign() -> re.Pattern[str]:
    """All characters beyond ASCII that _plain changes."""
    found = [i for i in range(0x80, sys.maxunicode + 1) if not 0xD800 <= i < 0xE000 and _plain(chr(i)) != chr(i)]
    cuts = [0, *(k for k in range(1, len(found)) if found[k] != found[k - 1] + 1), len(found)]
    return re.compile("[" + "".join(f"{re.escape(chr(found[a]))}-{re.escape(chr(found[b - 1]))}" for a, b in pairwise(cuts)) + "]")


def homoglyphs(text: str) -> list[tuple[int, int, str]]:
    return [] if text.isascii() else [(m.start(), m.end(), _plain(m[0])) for m in _foreign().finditer(text)]


# Words for the signs of an address.
_AT, _DOT = "at|arroba", "dot|punkt|punto"
_OPEN, _SHUT = r"[ \t]{0,3}[\[({<][ \t]{0,3}", r"[ \t]{0,3}[\])}>][ \t]{0,3}"
_LITERAL_HOST = r"[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.([A-Za-z]{2,24})(?![A-Za-z0-9-])"
_LITERAL_AT = re.compile(rf"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]{{1,64}})(?:[ \t]{{1,3}}({_AT})[ \t]{{1,3}}|[ \t]{{1,3}}@[ \t]{{0,3}}|@[ \t]{{1,3}})(?={_LITERAL_HOST})", re.I)
_SIGNS = re.compile(rf"{_OPEN}(?:{_AT}|@|{_DOT}|\.){_SHUT}|[ \t]{{1,3}}(?:{_DOT})[ \t]{{1,3}}|[ \t](?:(?:{_AT})[ \t]|@)[ \t]{{0,3}}[A-Za-z0-9-]{{1,63}}\.[A-Za-z0-9]|@[ \t]{{1,3}}[A-Za-z0-9-]{{1,63}}\.[A-Za-z0-9]", re.I)
_BOXED = re.compile(rf"(?<=[A-Za-z0-9]){_OPEN}(?:({_AT}|@)|(?:{_DOT}|\.)){_SHUT}(?=[A-Za-z0-9])", re.I)
_HOST = rf"[A-Za-z0-9-]{{1,63}}(?:(?:\.|[ \t]{{1,3}}(?:{_DOT})[ \t]{{1,3}})[A-Za-z0-9-]{{1,63}}){{0,8}}[ \t]{{1,3}}(?:{_DOT})[ \t]{{1,3}}[A-Za-z]{{2,24}}(?![A-Za-z0-9])"
_SPACED_AT = re.compile(rf"(?<=[A-Za-z0-9])[ \t]{{1,3}}(?:{_AT}|@)[ \t]{{1,3}}(?={_HOST})", re.I)
_SPACED_HOST = re.compile(rf"(?<=@){_HOST}", re.I)
_SPACED_LOCAL = re.compile(rf"(?<![A-Za-z0-9])[A-Za-z0-9_%+-]{{1,64}}(?:[ \t]{{1,3}}(?:{_DOT})[ \t]{{1,3}}[A-Za-z0-9_%+-]{{1,64}}){{1,4}}(?=@)", re.I)
_SPACED_DOT = re.compile(rf"[ \t]{{1,3}}(?:{_DOT})[ \t]{{1,3}}", re.I)


def boxed_signs(text: str) -> list[tuple[int, int, str]]:
    """``name [at] host (dot) org``; also ``<.>``, between letters or digits."""
    return [(m.start(), m.end(), "@" if m[1] else ".") for m in _BOXED.finditer(text)]


def spaced_at(text: str) -> list[tuple[int, int, str]]:
    """``name at host dot org``: the word counts only before a host whose dots are spelled too."""
    return [(m.start(), m.end(), "@") for m in _SPACED_AT.finditer(text)]


# Last labels of common hosts, and words that stand before "at" without being someone's name there.
_TOP = frozenset("com org net edu gov mil int info biz name pro io co ai app dev tech cloud online site shop blog xyz tv me eu uk ie us ca mx br ar cl pe ve uy au nz in pk jp cn tw hk kr sg my id th vn ph ru ua by pl cz sk hu ro bg rs hr si gr tr il ae sa eg ma za ng ke de at ch li fr be nl lu es pt it se no dk fi is ee lv lt".split())
_BEFORE_AT = frozenset("""a about account again all also am an and any anything anytime archive archives are around article articles as available be been book books both but by call can checked code com contact copies copy data details directly do docs documentation download downloads each email emails else every everything file files first for forum found free from full get go had has have he help her here him his home hosted how i if in info information is it items job jobs just kept later learn link links list live located look looked looking looks mail many materials me meet mirror month more most my news next no not now of off on online only or order other our out page pages paper photos please post posts prices project read release s see seen sell she shop shown sign site sites software some song sold source stay stop store stored stuff supported t team text than that the their them then there these they thing things this those time to today tool up us version video videos visit was watch we week well were what when where which who will with work works write year yet you your""".split())
_ADDRESSED = re.compile(r"(?:e-?mails?|mail|write|contact|reach|ask|message|ping|address(?: is)?)(?: to)?:?[ \t]{1,3}$", re.I)


def literal_at(text: str) -> list[tuple[int, int, str]]:
    """``name at host.org`` and ``name @ host.org``: where the name is like no word, or the host's last label is a known one.

    Before the word "at", a plain name must not be a word that prose has there.
    """
    edits = []
    for m in _LITERAL_AT.finditer(text):
        name, word, top = m[1], m[2], m[3]
        like_no_word = name[0].isalnum() and name[-1].isalnum() and not name.isalpha()
        known = top.lower() in _TOP and (top.islower() or name.isupper())
        if word and known and not like_no_word:
            low = name.lower()
            known = name.isalpha() and low not in _BEFORE_AT and (not low.endswith(("ed", "ing")) or _ADDRESSED.search(text, max(0, m.start() - 20), m.start()) is not None)
        if known or (like_no_word and (top.islower() or name.isupper()) and any(map(str.isalpha, name))):
            edits.append((m.end(1), m.end(), "@"))
    return edits


def spaced_dots(text: str) -> list[tuple[int, int, str]]:
    """Spelled dots on either side of an ``@``."""
    near = [m.span() for p in (_SPACED_LOCAL, _SPACED_HOST) for m in p.finditer(text)]
    return sorted((m.start(), m.end(), ".") for a, b in near for m in _SPACED_DOT.finditer(text, a, b))


# The digits' names in four languages, in order from 0.
_NAMES = (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)
_DIGIT = {w: str(d) for names in _NAMES for d, w in enumerate(names.split())} | {"oh": "0", "plus": "+"}
_WORD = "|".join(sorted((w for w in _DIGIT if w != "plus"), key=len, reverse=True))
#: Spelled digits count in runs of this many or more, digits included.
RUN = 7
_SPELLED = re.compile(rf"(?<!\w)(?:plus[ \t]+)?(?:{_WORD})(?:(?:[ \t,-]{{1,3}}|[ \t]*[.][ \t]*|[ \t]+(?:{_DOT})[ \t]+)(?:{_WORD}|[0-9])(?!\w)){{{RUN - 1},}}", re.I)
_PIECE = re.compile(rf"(plus|{_WORD}|[0-9])[ \t,-]*|([ \t]*(?:\.|{_DOT})[ \t]*)", re.I)
_TWO = re.compile(rf"(?<!\w)(?:{_WORD})[ \t,.-]{{1,3}}(?:{_WORD}|[0-9])(?!\w)", re.I)


def spelled_digits(text: str) -> list[tuple[int, int, str]]:
    edits: list[tuple[int, int, str]] = []
    if _TWO.search(text):
        for run in _SPELLED.finditer(text):
            for m in _PIECE.finditer(text, *run.span()):
                w = (m[1] or "").lower()
                edits.append((m.start(), m.end() if m.end() < run.end() else run.end(), "." if m[2] else _DIGIT.get(w, w)))
    return edits


_MIXED = re.compile(rf"(?<![\w+])(?:\+|plus[ \t]+)[0-9]{{1,4}}(?:[ \t().-]{{1,3}}(?:{_WORD}|[0-9]{{1,4}})(?!\w)){{2,}}", re.I)
_ONE = re.compile(rf"(?<!\w)(?:{_WORD}|plus[ \t]+)(?!\w)|plus[ \t]+", re.I)


def mixed_digits(text: str) -> list[tuple[int, int, str]]:
    """Spelled digits among written ones after a plus sign or the word, however few: ``+1 555 five five five 1234``."""
    edits: list[tuple[int, int, str]] = []
    if _TWO.search(text):
        for run in _MIXED.finditer(text):
            edits += [(m.start(), m.end(), _DIGIT[m[0].strip().lower()]) for m in _ONE.finditer(text, *run.span())]
    return edits


_NUMBER = rf"(?:[0-9]{{1,3}}(?![0-9])|(?:{_WORD}|[0-9])(?:[ \t]{{1,3}}(?:{_WORD}|[0-9])(?!\w)|-(?:{_WORD}|[0-9])(?!\w)){{0,2}})"
_IP_DOT = rf"(?:\.|{_OPEN}(?:{_DOT}|\.){_SHUT}|[ \t]{{1,3}}(?:{_DOT})[ \t]{{1,3}})"
_SPELLED_IP = re.compile(rf"(?<![\w.])({_NUMBER}){_IP_DOT}({_NUMBER}){_IP_DOT}({_NUMBER}){_IP_DOT}({_NUMBER})(?!\w)", re.I)
_IP_SIGN = re.compile(rf"{_OPEN}(?:{_DOT}|\.){_SHUT}|[ \t](?:{_DOT})[ \t]", re.I)
_NUMBER_PIECE = re.compile(rf"{_WORD}|[0-9]", re.I)


def spelled_ips(text: str) -> list[tuple[int, int, str]]:
    """Four numbers up to 255, spelled by digits or written, joined by dots of which one at least is spelled or boxed."""
    edits: list[tuple[int, int, str]] = []
    if _IP_SIGN.search(text):
        for m in _SPELLED_IP.finditer(text):
            numbers = ["".join(_DIGIT.get(w.lower(), w) for w in _NUMBER_PIECE.findall(n)) for n in m.groups()]
            if _IP_SIGN.search(m[0]) and all(int(n) <= 255 for n in numbers):
                edits.append((m.start(), m.end(), ".".join(numbers)))
    return edits


class Rewritten:
    """A text after edits, with the way back from its offsets."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        self.spans: list[tuple[int, int, int, int]] = []  # of each edit: out start, out end, source start, source end
        parts, at, n = [], 0, 0
        for a, b, new in edits:
            parts += text[at:a], new
            n += a - at
            self.spans.append((n, n + len(new), a, b))
            n += len(new)
            at = b
        self.text = "".join([*parts, text[at:]])
        self.starts = [s[0] for s in self.spans]

    def back(self, start: int, end: int) -> tuple[int, int]:
        """Source offsets of the characters start to end (not empty)."""
        return self._source(start)[0], self._source(end - 1)[1]

    def _source(self, i: int) -> tuple[int, int]:
        """What character i came from: itself, or all that its edit replaced."""
        k = bisect.bisect_right(self.starts, i) - 1
        if k < 0:
            return i, i + 1
        _, out_end, source_start, source_end = self.spans[k]
        if i < out_end:
            return source_start, source_end
        at = source_end + i - out_end
        return at, at + 1


TRANSDUCERS = (homoglyphs, spelled_ips, boxed_signs, spaced_at, literal_at, spaced_dots, spelled_digits, mixed_digits)


def find(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, added spans) of one text; null counts as empty."""
    text = text or ""
    base = detect(text)
    chain: list[Rewritten] = []
    now = text
    for step in TRANSDUCERS if not text.isascii() or _SIGNS.search(text) or _TWO.search(text) else ():
        if edits := step(now):
            chain.append(Rewritten(now, edits))
            now = chain[-1].text
    added: list[tuple[str, int, int]] = []
    if chain:
        for kind, a, b in detect(now):
            for r in reversed(chain):
                a, b = r.back(a, b)
            if not any(k == kind and s <= a and b <= e for k, s, e in base):
                added.append((kind, a, b))
    return base, added


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("disguised", pa.bool_())])


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) per row: spans is an array of (kind, start, end, disguised), by kind and then start.

    A null or empty text has no spans. Repeated rows give repeated rows; further columns are dropped, so their names
    can't clash. Offsets are code points of the whole source text, ends exclusive.
    """
    kind = {k: i for i, k in enumerate(KINDS)}

    def rows(ids: list, texts: list) -> dict[str, list]:
        spans = []
        for t in texts:
            base, added = find(t)
            spans.append([{"kind": k, "start": a, "end": b, "disguised": d} for k, a, b, d in sorted([*((*s, False) for s in base), *((*s, True) for s in added)], key=lambda s: (kind[s[0]], s[1], s[2]))])
        return {"id": ids, "spans": spans}

    id_type = df.schema[id_col].dataType
    out = map_columns(
        df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")),
        rows,
        "id long, spans array<struct<kind: string, start: long, end: long, disguised: boolean>>",
        pa.schema([("id", pa.int64()), ("spans", pa.list_(_SPAN))]),
    )
    return out.select(F.col("id").cast(id_type).alias(id_col), "spans")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with each span, base or disguised, replaced by ``[KIND]`` in text_col; overlapping spans become one.

    Null texts stay null. Columns and rows stay as they are otherwise.
    """
    from pyspark.sql.types import StringType

    from .common import bounded_batches

    bounded_batches(df.sparkSession)

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        base, added = find(t)
        parts, at = [], 0
        for k, a, b in sorted([*base, *added], key=lambda s: (s[1], -s[2])):
            if a >= at:
                parts += t[at:a], f"[{k.upper()}]"
            at = max(at, b)
        return "".join([*parts, t[at:]])

    @F.arrow_udf(StringType())
    def cleaned(texts: pa.Array) -> pa.Array:
        return pa.array(map(one, texts.to_pylist()), type=pa.string())

    return df.withColumn(text_col, cleaned(F.col(text_col)))
