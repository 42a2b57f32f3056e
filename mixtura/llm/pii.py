"""Personal data by offset-preserving deobfuscation.

Plain patterns find the base spans on the source text. Then small transducers rewrite disguises:
homoglyphs and other scripts' digits become ASCII, spelled digits become digits, and written-out
"at" and "dot" become their signs. Each rewritten character remembers the source range it came
from, so an identifier found in the normalised text maps back to the exact source characters. Such
a span is added when it holds a rewritten character and meets no base span of its kind.

Offsets count code points, ends are exclusive. A null or empty text has no spans. Repeated rows
give repeated results; a null id is passed on; other columns are not read; an empty table gives
none. Every pattern runs in time linear in the text.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits either matches from its start or not at all, so no other start is tried.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """What ``local@domain`` matches from left to right; each "@" is visited once."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        free = found.end() if found else at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as in KINDS, then start."""
    out = [("email", s, e) for s, e in emails(text)]
    if _DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


# Letters of other scripts that look like ASCII ones, by script.
_LOOKALIKE = dict(zip("АВЕЅІЈКМНОРСТУХҮӀԚԜаеѕіјорсухһӏԁԛԝүѡп", "ABESIJKMHOPCTYXYIQWaesijopcyxhldqwywn"))  # Cyrillic
_LOOKALIKE |= dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαγικνορυχωϲϳ", "ABEZHIKMNOPTYXayiknopuxwcj"))  # Greek
_LOOKALIKE |= dict(zip("ՍՕհոսցօզյ", "UOhnugoqj"))  # Armenian
_LOOKALIKE |= dict(zip("ꓐꓚꓓꓖꓝꓙꓗꓡꓟꓠꓳꓑꓢꓔꓴꓥꓪꓫꓬꓜ", "BCDGFJKLMNOPSTUVWXYZ"))  # Lisu
_LOOKALIKE |= dict(zip("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ"))  # Cherokee
_LOOKALIKE |= dict(zip("ⲀⲂⲎⲒⲔⲘⲚⲞⲢⲤⲦⲬⲟⲣⲥ", "ABHIKMNOPCTXopc"))  # Coptic
_LOOKALIKE |= dict(zip("ıɑɡɩƅʋɪ∗⁺。⁃․", "iagibvi*+.-."))  # other signs
_DASHES = "‐‑‒–—―−﹣"
_INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
_BLANKS = "\u00a0\u2002\u2003\u2007\u2009\u202f\u3000"
#: Letters that Unicode names as forms of an ASCII letter, without an accent.
_FORM = re.compile(r"(?:MODIFIER LETTER |LATIN )(CAPITAL |SMALL )?(?:LETTER (?:SMALL CAPITAL )?)?(?:CAPITAL |SMALL )?([A-Z])$")
_WRITTEN = re.compile(r"[A-Za-z0-9@.+()_%-]")


def _glyph(c: str) -> str | None:
    """The ASCII form of a disguised character; None leaves it."""
    if c in _LOOKALIKE:
        return _LOOKALIKE[c]
    if c in _DASHES:
        return "-"
    if c in _INVISIBLE:
        return ""
    if c in _BLANKS:
        return " "
    if (n := unicodedata.decimal(c, None)) is not None:
        return str(n)
    if (d := unicodedata.digit(c, None)) is not None:
        return str(d)
    if unicodedata.decomposition(c).startswith("<"):
        plain = unicodedata.normalize("NFKC", c)
        plain = "." if plain == "。" else plain
        return plain if _WRITTEN.fullmatch(plain) else None
    if found := _FORM.match(unicodedata.name(c, "")):
        return found[2] if (found[1] or "").startswith("CAPITAL") else found[2].lower()
    return None


def _ranges(codes: list[int]) -> str:
    """A character class of code points."""
    out: list[list[int]] = []
    for i in codes:
        if out and out[-1][1] == i - 1:
            out[-1][1] = i
        else:
            out.append([i, i])
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in out)


#: The characters that _glyph rewrites.
_GLYPHS = frozenset(chr(i) for i in [*range(0x80, 0xD800), *range(0xE000, 0x20000)] if _glyph(chr(i)) is not None)
_DISGUISE = re.compile("[" + _ranges(sorted(map(ord, _GLYPHS))) + "]")

# Number words of the languages handled here, by value.
_NUMBERS = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
# Numbers of two digits, as they are spelled; tens may be followed by a unit.
_TEENS = {
    "ten": "10", "eleven": "11", "twelve": "12", "thirteen": "13", "fourteen": "14", "fifteen": "15", "sixteen": "16", "seventeen": "17", "eighteen": "18", "nineteen": "19",
    "zehn": "10", "elf": "11", "zwölf": "12", "dreizehn": "13", "vierzehn": "14", "fünfzehn": "15", "sechzehn": "16", "siebzehn": "17", "achtzehn": "18", "neunzehn": "19",
    "dix": "10", "onze": "11", "douze": "12", "treize": "13", "quatorze": "14", "quinze": "15", "seize": "16",
    "diez": "10", "doce": "12", "trece": "13", "catorce": "14", "quince": "15", "dieciséis": "16", "diecisiete": "17", "dieciocho": "18", "diecinueve": "19",
}
_TENS = {"twenty": "2", "thirty": "3", "forty": "4", "fifty": "5", "sixty": "6", "seventy": "7", "eighty": "8", "ninety": "9"}
_TIMES = {"double": 2, "triple": 3, "doppel": 2, "doble": 2}
_UNIT = "one|two|three|four|five|six|seven|eight|nine"
_NUMBER = "|".join(sorted(_NUMBERS, key=len, reverse=True))
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_DOTS = "dot|punkt|punto|point"
_AT_SIGN = rf"\x20?{_OPEN}\x20?(?:at|ät|arroba|arobase|@)\x20?{_CLOSE}\x20?"
_DOT_SIGN = rf"\x20?{_OPEN}\x20?(?:{_DOTS}|\.)\x20?{_CLOSE}\x20?"
#: Number words and digits in a row; dots between them may be spelled or bracketed.
_LONGER = rf"(?:{'|'.join(_TIMES)})\x20(?:{_NUMBER})(?!\w)|(?:{'|'.join(_TENS)})(?:[\x20-](?:{_UNIT})(?!\w))?+(?!\w)|(?:{'|'.join(_TEENS)})(?!\w)"
_ELEMENT = rf"(?:{_LONGER}|(?:{_NUMBER})(?!\w)|[0-9]++)"
_GAP = r"[\x20\t\r\n,;:/-]{1,8}+"
_STEP = rf"(?:{_DOT_SIGN}|\x20(?:{_DOTS})\x20|{_GAP}|\.)"
_RUN = re.compile(rf"(?i)(?<!\w){_ELEMENT}(?:{_STEP}{_ELEMENT})++")
_PART = re.compile(rf"(?i)(?P<long>{_LONGER})|(?P<word>(?:{_NUMBER})(?!\w))|(?P<digits>[0-9]++)|(?P<dot>{_DOT_SIGN}|\x20(?:{_DOTS})\x20)|(?P<gap>{_GAP}|\.)")
_PLUS = re.compile(rf"(?i)(?<!\w)plus\x20(?=[0-9]|(?:{_NUMBER})(?!\w)|{_LONGER})")
#: Where what stands for the sign of an address may begin.
_SIGNS = ("@", "[", "(", "{", "<", " at ", " ät ", " arroba ", " arobase ", "_at_")
#: What can stand for the sign of an address; the words say how its dots may be spelled.
_WHITE = r"[\x20\t\r\n]"
_AT = re.compile(rf"(?i)(?P<sign>{_AT_SIGN})|{_WHITE}(?P<word>at|ät|arroba|arobase){_WHITE}|(?P<joint>_at_)|\x20?@\x20?")
_SPOKEN = {"at": "dot", "ät": "punkt|dot", "arroba": "punto|dot", "arobase": "point|dot", None: _DOTS}
_JOINT = re.compile(r"(?i)[a-z0-9-]++(?:_dot_[a-z0-9-]++)++(?![\w.])")
_LABEL = r"[a-z0-9-]++"
_AFTER = {at: re.compile(rf"(?i){_LABEL}(?:(?:{_DOT_SIGN}|{_WHITE}(?:{dots}){_WHITE}|\x20\.\x20|\.)(?={_LABEL}(?!\w)){_LABEL})++") for at, dots in _SPOKEN.items()}
_DOT = re.compile(rf"(?i){_DOT_SIGN}|{_WHITE}(?:{_DOTS}){_WHITE}|_dot_|\x20\.\x20")
_BEFORE = re.compile(rf"(?i)(?:{_DOT_SIGN}|\x20(?:{_DOTS})\x20|\x20\.\x20)\Z")
#: A spelled dot with its signs is so long at most.
_LONGEST = 12
#: Last labels of domains that are no English words.
_TOP = frozenset(
    "com org net edu gov mil int info biz name dev app io co uk de fr es pt nl be ch at eu ca au nz jp cn kr ru pl cz se dk fi ie gr tr br mx ar cl za lu li hu ro bg hr si sk lt lv ee ua il sg hk tw th vn ph id my pk ae sa eg ng ke pe ve uy "
    "berlin hamburg koeln bayern wien tirol paris bzh alsace madrid barcelona cat eus gal london scot wales nyc online shop store tech cloud blog email xyz club site website web agency digital media network solutions systems jobs mobi tel travel asia museum aero coop".split())
#: Words before "at" that begin no address.
_PLAIN = frozenset("a an and are arrive arrived at available back be been being both buy call came come developed do everyone find found free get go going good had hard has have he her here him hosted i is it join just later live lives living located look looked looking looks made me meet more not now of off on one only or order out people posted published read see seen she shop sold stand started stay still stop that the them then there they this those time today tomorrow up us visit was we were work worked working works you".split())


class Normalised:
    """A text under rewriting. Each pass is a transducer from the text of the pass before: it keeps
    its edits only, so a place maps back through the passes by search, whatever the text's length."""

    def __init__(self, text: str):
        self.text = text
        self.passes: list[tuple[list[int], list[int], list[int], list[int]]] = []

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Put a string in place of each (start, end) of the current text, in order."""
        if not edits:
            return
        parts, at, size = [], 0, 0
        new, new_end, old, old_end = [], [], [], []
        for s, e, put in edits:
            parts += [self.text[at:s], put]
            size += s - at
            new.append(size)
            size += len(put)
            new_end.append(size)
            old.append(s)
            old_end.append(e)
            at = e
        self.text = "".join([*parts, self.text[at:]])
        self.passes.append((new, new_end, old, old_end))

    def source(self, start: int, end: int) -> tuple[int, int, bool]:
        """The range of the first text that a range comes from, and whether any of it was rewritten."""
        changed = False
        for new, new_end, old, old_end in reversed(self.passes):
            i, j = bisect_right(new, start) - 1, bisect_left(new, end) - 1
            # Edits that put nothing count where they stand inside the range.
            changed |= j > i or (i >= 0 and start < new_end[i])
            start = start if i < 0 else old[i] if start < new_end[i] else old_end[i] + start - new_end[i]
            end = end if j < 0 else old_end[j] if end <= new_end[j] else old_end[j] + end - new_end[j]
        return start, end, changed


def _glyph_edits(text: str) -> list[tuple[int, int, str]]:
    # Ordinary accented text, which has none of them, is passed over by its few different characters.
    return [] if text.isascii() or _GLYPHS.isdisjoint(set(text)) else [(m.start(), m.end(), _glyph(m[0]) or "") for m in _DISGUISE.finditer(text)]


def _long_number(low: str) -> str:
    """The digits of a doubled digit, of a number from ten to nineteen, or of tens with or without a unit."""
    if low in _TEENS:
        return _TEENS[low]
    first, last = re.split(r"[\x20-]", low)[0], re.split(r"[\x20-]", low)[-1]
    if first in _TIMES:
        return str(_NUMBERS[last]) * _TIMES[first]
    return _TENS[first] + ("0" if last == first else str(_NUMBERS[last]))


def _number_edits(text: str) -> list[tuple[int, int, str]]:
    """Spelled digits in runs of numbers become digits that stand together; spelled dots between
    numbers become dots; a spelled plus before a number becomes its sign."""
    edits = [(m.start(), m.end(), "+") for m in _PLUS.finditer(text)]
    for run in _RUN.finditer(text):
        parts = list(_PART.finditer(text, run.start(), run.end()))
        for k, m in enumerate(parts):
            if m["long"]:
                edits.append((m.start(), m.end(), _long_number(m[0].lower())))
            elif m["word"]:
                edits.append((m.start(), m.end(), str(_NUMBERS[m[0].lower()])))
            elif m["dot"]:
                edits.append((m.start(), m.end(), "."))
            elif m["gap"] and m[0] != ".":
                beside = (parts[k - 1], parts[k + 1])
                # After a number like ten a comma begins another one.
                if not any(p["word"] or p["long"] for p in beside) or (any(p["long"] for p in beside) and m[0].strip(" -")):
                    continue
                edits.append((m.start(), m.end(), ""))
    return sorted(edits)


#: Character references of ASCII characters.
_REFERENCE = re.compile(r"(?i)&(?:#0*+([0-9]{2,3})|#x0*+([0-9a-f]{2})|(commat|period|plus|lowbar|hyphen));")
_NAMED = {"commat": "@", "period": ".", "plus": "+", "lowbar": "_", "hyphen": "-"}


def _reference_edits(text: str) -> list[tuple[int, int, str]]:
    if "&" not in text:
        return []
    found = [(m, _NAMED[m[3].lower()] if m[3] else chr(int(m[1]) if m[1] else int(m[2], 16))) for m in _REFERENCE.finditer(text)]
    return [(m.start(), m.end(), c) for m, c in found if _WRITTEN.fullmatch(c) or c == " "]


def _address_edits(text: str) -> list[tuple[int, int, str]]:
    """Disguised signs and dots of addresses. An "at" that is a word needs a dot that is spelled, or
    a name before it and a domain after it that only an address has."""
    edits, free = [], 0
    # Line breaks and tabs stand for a space around a written sign.
    low = _lower(text).replace("\n", " ").replace("\t", " ").replace("\r", " ")
    for sign in _found(low, _SIGNS):
        # A space before it is part of it.
        m = (_AT.match(text, sign - 1) if text[max(0, sign - 1) : sign] == " " else None) or _AT.match(text, sign)
        if not m or m.end() <= sign:
            continue
        at, end = m.start(), m.end()
        word = m["word"].lower() if m["word"] else None
        found = _JOINT.match(text, end) if m["joint"] else _AFTER[word].match(text, end)
        if not found or at < free:
            continue
        start, dots = _local(text, at, free)
        if start == at:
            continue
        inner = [(d.start(), d.end(), ".") for d in _DOT.finditer(text, end, found.end())]
        if word and not dots:
            local, top = text[start:at].lower(), re.split(r"[^a-z0-9-]+", found[0].lower())[-1]
            if not (top in _TOP or any(c in "._+" for c in local)) or (local in _PLAIN and not inner):
                continue
        if m[0] != "@":
            dots.append((at, end, "@"))
        edits += dots + inner
        free = found.end()
    return edits


def _lower(text: str) -> str:
    """In small letters, place by place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text)


def _found(text: str, parts: tuple[str, ...]) -> list[int]:
    """All places of some strings, in order."""
    out = []
    for part in parts:
        at = text.find(part)
        while at >= 0:
            out.append(at)
            at = text.find(part, at + 1)
    return sorted(out)


def _local(text: str, at: int, free: int) -> tuple[int, list[tuple[int, int, str]]]:
    """Where the name before an address's sign starts, and its spelled dots."""
    dots: list[tuple[int, int, str]] = []
    start = at
    while True:
        begin = start
        while begin > free and text[begin - 1] in _LOCAL_CHARS:
            begin -= 1
        if begin == start:  # a dot that nothing stands before is no part of the name
            return (dots.pop(0)[1] if dots else at), dots
        start = begin
        low = max(free, begin - _LONGEST)
        dot = _BEFORE.search(text[low:begin])
        if not dot:
            return start, dots
        dots.insert(0, (low + dot.start(), begin, "."))
        start = low + dot.start()


def normalise(text: str) -> Normalised:
    n = Normalised(text)
    n.replace(_reference_edits(text))
    n.replace(_glyph_edits(n.text))
    if _has_numbers(n.text):
        n.replace(_number_edits(n.text))
    n.replace(_address_edits(n.text))
    return n


_WORDS_OF_NUMBERS = frozenset(_NUMBERS) | frozenset(_TEENS) | frozenset(_TENS) | frozenset(_TIMES) | frozenset(_DOTS.split("|")) | {"plus"}
_BRACKETED_DOT = re.compile(r"[\[({<]\x20?\.")
_APART = ",-.;:/[](){}<>"


def _has_numbers(text: str) -> bool:
    """Whether a word that the number pass reads stands next to another or to digits; a plain pass over
    the words for most texts."""
    low = text.lower()
    if _BRACKETED_DOT.search(text):
        return True
    for c in _APART:
        if c in low:
            low = low.replace(c, " ")
    words = low.split()
    if _WORDS_OF_NUMBERS.isdisjoint(words):
        return False
    at = [i for i, w in enumerate(words) if w in _WORDS_OF_NUMBERS]
    near = lambda w: w in _WORDS_OF_NUMBERS or "0" <= w[0] <= "9" or "0" <= w[-1] <= "9"
    return any((i > 0 and near(words[i - 1])) or (i + 1 < len(words) and near(words[i + 1])) for i in at)


def spans_of(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The base spans, and those that only the normalised text shows."""
    base = base_spans(text)
    n = normalise(text)
    if not n.passes:
        return base, []
    taken = {k: [(s, e) for kind, s, e in base if kind == k] for k in KINDS}
    added = []
    for kind, s, e in base_spans(n.text):
        start, end, changed = n.source(s, e)
        if changed and not _meets(taken[kind], start, end):
            added.append((kind, start, end))
    return base, added


def _meets(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether a range meets one of some spans that lie in order, other than by covering it and more."""
    i = bisect_left(spans, (end, 0)) - 1
    while i >= 0 and spans[i][1] > start:
        s, e = spans[i]
        if not (start <= s and e <= end and (start, end) != (s, e)):
            return True
        i -= 1
    return False


def joined(spans: list[tuple[str, int, int]], key=None) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=key or (lambda x: (KINDS.index(x[0]), x[1], x[2]))))




def find_pii(docs: DataFrame, text_col: str = "text", span_col: str = "pii_spans") -> DataFrame:
    """``docs`` with an array of (kind, start, end, base), by kind, then start."""
    return docs.withColumn(span_col, _spans_udf()(F.col(text_col)))


def _spans_udf():
    @F.pandas_udf("array<struct<kind:string,start:int,end:int,base:boolean>>")
    def spans(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            base, added = spans_of(text or "")
            both = sorted([(KINDS.index(k), s, e, True) for k, s, e in base] + [(KINDS.index(k), s, e, False) for k, s, e in added])
            out.append([{"kind": KINDS[k], "start": s, "end": e, "base": b} for k, s, e, b in both])
        return pd.Series(out)

    return spans


def mask(text: str) -> str:
    """The text with each span replaced by its kind in angle brackets; of spans that overlap, the
    one that starts first, then the longest, gives the name of the whole stretch."""
    base, added = spans_of(text)
    merged: list[list] = []
    for kind, s, e in sorted(base + added, key=lambda x: (x[1], -x[2])):
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([kind, s, e])
    parts, at = [], 0
    for kind, s, e in merged:
        parts += [text[at:s], f"<{kind}>"]
        at = e
    return "".join([*parts, text[at:]])


def mask_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data masked; a null text stays null."""
    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else mask(t) for t in texts], dtype=object)

    return docs.withColumn(text_col, masked(F.col(text_col)))


def pii_digest(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256 and all spans as text."""
    found = find_pii(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), span_col="s").select("doc_id", "s")
    shown = lambda spans: F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    count = lambda kind: F.size(F.filter("s", lambda x: x["base"] & (x["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(shown(F.filter("s", lambda x: x["base"])).cast("binary"), 256).alias("base_sha256"), shown(F.col("s")).alias("spans"))
