"""Personal data, with offset-preserving deobfuscation.

Base patterns run on the source text.  Then transducers rewrite it step by step, each character of the result remembering its
source span: look-alike letters and digits and invisible characters, spelled digits, at/dot disguises.  Identifiers found in the
rewritten text are mapped back, and added where the rewriting took part in them.

Each transducer has a cheap test that lets all texts pass in which it would rewrite something.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from .spans import Mapped, digest, map_spans, ordered

KINDS = ("email", "ip", "card", "phone")

# The base patterns.  Possessive runs and the look-behind change no match; they keep long runs linear.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+")

# Characters that look like ASCII ones.
LOOK_ALIKE = dict(zip("АВЕКМНОРСТУХІЈЅаеорсухіјѕһԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανιυρ⁃‐‑‒–﹣－＋．。․﹒＠﹫％＿", "ABEKMHOPCTYXIJSaeopcyxijshdqwABEZHIKMNOPTYXoaviup-------+....@@%_"))
DIGIT_STARTS = "０٠۰०০𝟎𝟘𝟬𝟶"
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
# Spelled digits, and words for the plus sign and the dot in numbers.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
SIGNS = {"plus": "+", "más": "+", "dot": ".", "point": ".", "punkt": ".", "punto": "."}
#: Spelled digits are rewritten in runs with at least this many digits.
LEAST_DIGITS = 4


NUMERALS = frozenset([*SPELLED, *SIGNS])
LETTERS = re.compile(r"[^\W\d_]+")
# Letters that re.I takes for ASCII ones and lower() does not.
FOLD = {0x130: "i", 0x131: "i", 0x17F: "s"}
# Last labels that are no English words.
LAST_LABELS = frozenset("com org net edu gov info biz io co ai app dev uk de fr es eu nl ch ca au jp cn br pl se dk fi ie pt mx ar example test".split())


def _table() -> dict[int, str]:
    out = {ord(a): b for a, b in LOOK_ALIKE.items()} | {ord(c): "" for c in INVISIBLE}
    for first in DIGIT_STARTS:
        out |= {ord(first) + d: str(d) for d in range(10)}
    for a in range(26):  # full-width letters
        out |= {0xFF21 + a: chr(65 + a), 0xFF41 + a: chr(97 + a)}
    return out


TABLE = _table()
ALIKE = re.compile("[" + "".join(re.escape(chr(c)) for c in TABLE) + "]")
WORDS = "|".join(sorted(map(re.escape, {**SPELLED, **SIGNS}), key=len, reverse=True))
RUN = re.compile(rf"(?<![^\W_])(?:(?:{WORDS})|[0-9+])(?:[\x20,.-]{{0,2}}(?:(?:(?<![^\W_])(?:{WORDS})(?![^\W_]))|[0-9]))+(?![^\W_])", re.I)
ONE = re.compile(rf"{WORDS}|[0-9+]|[\x20,.-]+", re.I)
#: A disguised dot between digits.
DIGIT_DOT = re.compile(r"(?<=[0-9])(?:\x20*[\[({<]\x20*(?:dot|punkt|punto|point|\.)\x20*[\])}>]\x20*|\x20+(?:dot|punkt|punto|point)\x20+)(?=[0-9])", re.I)
AT = r"(?:\x20*[\[({<]\x20*(?:at|@|arroba|arobase)\x20*[\])}>]\x20*|\x20+(?:at|arroba|arobase)\x20+|\x20*@\x20*)"
DOT = r"(?:\x20*[\[({<]\x20*(?:dot|punkt|punto|point|\.)\x20*[\])}>]\x20*|\x20+(?:dot|punkt|punto|point)\x20+|\.)"
DISGUISED = re.compile(rf"(?<![A-Za-z0-9._%+-])([A-Za-z0-9_%+-]+(?:{DOT}[A-Za-z0-9_%+-]+)*?)({AT})([A-Za-z0-9-]+(?:{DOT}[A-Za-z0-9-]+)+)", re.I)
AT_RE, DOT_RE = re.compile(AT, re.I), re.compile(DOT, re.I)
AT_HINT = re.compile(r"[\[({<]\x20*(?:at|@|arroba|arobase)\x20*[\])}>]|\x20(?:at|arroba|arobase)\x20|@", re.I)
#: Signs of an address that counts as disguised without a disguised dot.
SPACED = re.compile(r"[\[({<]\x20*(?:at|@|arroba|arobase)\x20*[\])}>]|\x20@|@\x20", re.I)
#: "at this point in" is prose: after a bare "at" and "point" the last label must be one of LAST_LABELS.
POINT = re.compile(r"\x20point\x20", re.I)
DOT_HINT = re.compile(r"[\[({<]\x20*(?:dot|punkt|punto|point|\.)\x20*[\])}>]|\x20(?:dot|punkt|punto|point)\x20", re.I)


def emails(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of local@domain: the local part is the longest run before an at sign."""
    out, at, done = [], text.find("@"), 0
    while at >= 0:
        s = at
        while s > done and text[s - 1] in LOCAL:
            s -= 1
        m = DOMAIN.match(text, at + 1) if s < at else None
        if m:
            out.append(("email", s, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _octet(digits: str) -> bool:
    """At most 255, however many zeros lead."""
    rest = digits.lstrip("0")
    return len(rest) <= 3 and int(rest or "0") <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = emails(text)
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(_octet(p) for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def _digits(m: re.Match) -> str | None:
    """A run of spelled digits as digits; None unless words take part and it has LEAST_DIGITS digits."""
    out, words = [], 0
    for x in ONE.findall(m[0]):
        low = x.translate(FOLD).lower()
        if low in SPELLED or low in SIGNS:
            out.append(SPELLED.get(low) or SIGNS[low])
            words += low in SPELLED
        elif x.isdigit() or x == "+" or x == ".":
            out.append(x)
    made = "".join(out)
    return made if words >= 2 and sum(c.isdigit() for c in made) >= LEAST_DIGITS else None


def _address(m: re.Match) -> str | None:
    """A disguised address with plain signs; None if neither sign was disguised, or a bare "at" has no disguised dot with it."""
    at, host = m[2], m[3]
    bare = at.strip().isalpha() and not DOT_HINT.search(host)
    if bare or at == "@" and not DOT_HINT.search(m[1] + host):
        return None
    if POINT.search(host) and at.strip().isalpha() and re.split(DOT_RE, host)[-1].lower() not in LAST_LABELS:
        return None
    return DOT_RE.sub(".", m[1]) + "@" + DOT_RE.sub(".", host)


def _latin(text: str) -> bool:
    """Whether no character of the table can occur."""
    if text.isascii():
        return True
    try:
        return b"\xad" not in text.encode("latin-1")
    except UnicodeEncodeError:
        return False


def normalise(text: str) -> Mapped:
    """The text after all transducers."""
    now = Mapped(text)
    if not _latin(text) and ALIKE.search(text):
        now = now.chars(TABLE)
    # a run has two numerals or more, with digits and separators between them only
    words = LETTERS.findall((now.text if now.text.isascii() else now.text.translate(FOLD)).lower())
    if b"\1\1" in bytes([w in NUMERALS for w in words]):
        now = now.sub(RUN, _digits)
    if DOT_HINT.search(now.text):
        now = now.sub(DIGIT_DOT, lambda m: ".")
    if SPACED.search(now.text) or DOT_HINT.search(now.text) and AT_HINT.search(now.text):
        now = now.sub(DISGUISED, _address)
    return now


def find_pii(text: str) -> list[tuple]:
    """(kind, start, end, base, value): base matches of the text, and those in which a transducer took part; value is the
    normalised identifier."""
    base = base_spans(text)
    now = normalise(text)
    found: set = set()
    if now.text != text:
        for kind, s, e in base_spans(now.text):
            a, b = now.source(s, e)
            if text[a:b] != now.text[s:e]:
                found.add((kind, a, b, now.text[s:e]))
    return ordered(found, text, KINDS, base)


def scan_pii(df: DataFrame, key: str = "doc_id", text: str = "text", out: str = "pii") -> DataFrame:
    """key and out: array of struct kind, start, end, base, value of every whole text; null texts have none.

    A map over rows: repeated rows and null keys stay, other columns are left out."""
    return map_spans(df, find_pii, key, text, out)


def op8_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_<kind> and base_sha256 of the base spans, and all spans, of every row.

    Null and empty texts have no spans; texts are whole however long; repeated rows and null doc_ids stay; spans with one start are
    ordered by kind, end and value; other columns take no part, whatever their names; an empty table gives no rows."""
    return digest(scan_pii(docs), KINDS, "doc_id", "pii")
