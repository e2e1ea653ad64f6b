"""Personal details in free text, located in the text as stored.

A transducer reads each text once and writes a plain form of it: encoded,
escaped and look-alike characters as what they stand for, spelled digits as
digits, "at" and "dot" disguises as the signs. It keeps, for every character
written, where its source begins and ends, so that what the detectors find in
the plain form maps back to spans of the source.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.session import spread

#: name_parts beyond this size are used through the endings learned from them only.
MOST_NAMES = 100_000

# --- The transducer ------------------------------------------------------------------------------------------------

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = dict(
    zip(
        "АВЕКМНОРСТУХаеорсухіѕјԁһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧονυ",
        "ABEKMHOPCTYXaeopcyxisjdhqwABEZHIKMNOPTYXovu",
    )
)
#: Characters that show nothing.
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
#: Digits as words, in the languages of the notes.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_DIGIT_WORD = "|".join(sorted(SPELLED, key=len, reverse=True))
_AT = r"\s*[\[({<]\s*(?:at|@)\s*[\])}>]\s*|(?<=[A-Za-z0-9])\s+@\s+(?=[A-Za-z0-9-]+\.[A-Za-z])"
_DOT = r"\s*[\[({<]\s*(?:dot|punkt|punto|\.)\s*[\])}>]\s*"
_SPOKEN = r"(?<=[A-Za-z0-9])\s+at\s+(?=[A-Za-z0-9-]+\s+dot\s+[A-Za-z]{2})"
_SPOKEN_DOT = r"(?<=[A-Za-z0-9])\s+dot\s+(?=[A-Za-z]{2})"
_SPECIAL = re.compile(
    rf"(?P<percent>(?:%[0-9A-Fa-f]{{2}})+)|(?P<escape>\\u[0-9A-Fa-f]{{4}}|\\[/\"\\nrt])|(?P<entity>&(?:#\d+|#x[0-9A-Fa-f]+|[A-Za-z]+);)"
    rf"|(?P<at>{_AT}|{_SPOKEN})|(?P<dot>{_DOT}|{_SPOKEN_DOT})"
    rf"|(?P<spelled>(?<![A-Za-z])(?:(?:double\s+)?(?:{_DIGIT_WORD})[\s-]+){{4,}}(?:{_DIGIT_WORD})(?![A-Za-z]))"
    rf"|(?P<other>[^\x00-\x7f])",
    re.IGNORECASE,
)
_PLUS = re.compile(r"\+")
_QUERY = re.compile(r"[?&][A-Za-z_]+=[^\s]*")


@dataclass
class Plain:
    """The plain form of a text and the spans of the source that its characters stand for (None: the same)."""

    text: str
    starts: list[int] | None
    ends: list[int] | None

    def source(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.starts is None else (self.starts[start], self.ends[end - 1])


def _written(kind: str, raw: str) -> list[tuple[str, int, int]]:
    """What a special stretch stands for: (characters, from, to) relative to its start."""
    if kind == "percent":
        data = bytes(int(raw[i + 1 : i + 3], 16) for i in range(0, len(raw), 3))
        out, i = [], 0
        while i < len(data):
            size = 1 if data[i] < 0x80 else 2 if data[i] >> 5 == 6 else 3 if data[i] >> 4 == 14 else 4 if data[i] >> 3 == 30 else 1
            out.append((data[i : i + size].decode("utf-8", "replace")[:1], 3 * i, 3 * min(i + size, len(data))))
            i += size
        return [(HOMOGLYPHS.get(c, c), a, b) for c, a, b in out]
    if kind == "escape":
        char = chr(int(raw[2:], 16)) if raw[1] == "u" else {"n": "\n", "r": "\r", "t": "\t"}.get(raw[1], raw[1])
        return [(HOMOGLYPHS.get(char, char), 0, len(raw))]
    if kind == "entity":
        return [(c, 0, len(raw)) for c in html.unescape(raw)]
    if kind == "at":
        return [("@", 0, len(raw))]
    if kind == "dot":
        return [(".", 0, len(raw))]
    if kind == "spelled":
        out, twice = [], None
        for m in re.finditer(rf"double|{_DIGIT_WORD}", raw, re.IGNORECASE):
            if m.group().lower() == "double":
                twice = m.start()
                continue
            digit = SPELLED[m.group().lower()]
            out += [(digit, m.start() if twice is None else twice, m.end())] * (1 if twice is None else 2)
            twice = None
        return out
    if raw in INVISIBLE:
        return []
    folded = HOMOGLYPHS.get(raw) or unicodedata.normalize("NFKC", raw)
    if len(folded) == 1 and unicodedata.category(folded) == "Zs":
        folded = " "
    elif len(folded) == 1 and unicodedata.category(folded) == "Pd":
        folded = "-"
    return [(c, 0, 1) for c in folded]


def plain(text: str) -> Plain:
    """Run the transducer over ``text``."""
    found = list(_SPECIAL.finditer(text))
    plus = [p.start() for q in _QUERY.finditer(text) for p in _PLUS.finditer(text, q.start(), q.end())]  # a space, in a query
    if not found and not plus:
        return Plain(text, None, None)
    out: list[str] = []
    starts: list[int] = []
    ends: list[int] = []

    def copy(a: int, b: int) -> None:
        out.append(text[a:b])
        starts.extend(range(a, b))
        ends.extend(range(a + 1, b + 1))

    at = 0
    for m in found:
        copy(at, m.start())
        for c, a, b in _written(m.lastgroup, m.group()):
            out.append(c)
            starts.extend([m.start() + a] * len(c))
            ends.extend([m.start() + b] * len(c))
        at = m.end()
    copy(at, len(text))
    flat = "".join(out)
    if plus:
        spaces = set(plus)
        flat = "".join(" " if c == "+" and s in spaces and e == s + 1 else c for c, s, e in zip(flat, starts, ends))
    return Plain(flat, starts, ends)


# --- Names, learned from name_parts --------------------------------------------------------------------------------

#: Endings of towns, which share their beginnings with names.
PLACES = ("bury", "mora", "feld", "field", "holm", "port", "stead", "grund", "vale", "ton", "burg", "ville")
_TITLE = r"(?:mrs?|ms|miss|dr|prof|herrn?|frau|sra?|srta|don|doña|señora?|mme|mlle|m)"


def _folded(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))


class Names:
    """Whether a word is a given or a family name: listed, or built of a beginning and an ending that many listed ones have."""

    def __init__(self, parts: Iterable[tuple[str, str]]) -> None:
        parts = [(_folded(p), k) for p, k in parts if p and k]
        self.listed = {k: {p for p, kind in parts if kind == k} for k in ("given", "family")}
        begins = Counter(p[:3] for p, _ in parts)
        self.begins = {b for b, n in begins.items() if n >= 3}
        self.endings = {}
        for kind, words in self.listed.items():
            ends = Counter(w[-n:] for w in words for n in range(2, 7) if len(w) >= n + 3)
            least = max(3, 0.03 * len(words))
            self.endings[kind] = {e for e, n in ends.items() if n >= least}
        # An ending of both kinds tells nothing.
        both = self.endings["given"] & self.endings["family"]
        for kind in self.endings:
            self.endings[kind] -= both

    def is_a(self, kind: str, word: str) -> bool:
        parts = [_folded(w) for w in re.split(r"['’-]", word) if w]
        return bool(parts) and all(self._one(kind, p) for p in parts)

    def _one(self, kind: str, word: str) -> bool:
        if word in self.listed[kind]:
            return True
        if len(word) < 5 or word.endswith(PLACES) or word[:3] not in self.begins:
            return False
        return any(word[-n:] in self.endings[kind] for n in range(2, 7))


_LETTER = r"[^\W\d_]"
_WORD = rf"{_LETTER}{{3,}}(?:['’-]{_LETTER}{{3,}})*"
_INITIALS = rf"(?:{_LETTER}\.\s?)+"
_NAME_SHAPES = re.compile(
    rf"(?<![\w@.-])(?:(?P<f1>{_WORD}),[ ]?(?P<g1>{_WORD})(?:[ ]{_INITIALS}|[ ]{_LETTER}\.?(?!\w))?|(?P<i2>{_INITIALS})(?P<f2>{_WORD})|(?P<g3>{_WORD})[ ](?:{_INITIALS}[ ]?|(?P<m3>{_WORD})[ ])?(?P<f3>{_WORD}))(?![\w@])"
)
_TITLED = re.compile(rf"(?<!\w){_TITLE}\.?[ ]+(?P<f>{_WORD})(?![\w@])", re.IGNORECASE)


def _names(text: str, names: Names) -> Iterator[tuple[int, int]]:
    at = 0
    while m := _NAME_SHAPES.search(text, at):
        end = None
        if m["f1"]:
            ok = names.is_a("family", m["f1"]) and names.is_a("given", m["g1"])
        elif m["f2"]:
            ok = names.is_a("family", m["f2"])
        else:
            ok = names.is_a("given", m["g3"]) and names.is_a("family", m["f3"]) and (m["m3"] is None or names.is_a("given", m["m3"]))
            if not ok and m["m3"] and names.is_a("given", m["g3"]) and names.is_a("family", m["m3"]):
                ok, end = True, m.end("m3")
        if ok:
            yield m.start(), end or m.end()
            at = end or m.end()
        else:  # go on behind the first word
            first = re.compile(r"\W*\w+").match(text, m.start())
            at = max(first.end() if first else m.end(), m.start() + 1)
    for m in _TITLED.finditer(text):
        if names.is_a("family", m["f"]):
            yield m.start("f"), m.end("f")


# --- The other kinds -----------------------------------------------------------------------------------------------

_EMAIL = re.compile(r"(?<![A-Za-z0-9._+-])[A-Za-z0-9](?:[A-Za-z0-9._+'-]*[A-Za-z0-9_+-])?@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![A-Za-z0-9-])")
_PHONE = re.compile(
    r"(?<![\w+/.-])(?:"
    r"\+\d{1,3}(?:[ .\-/]?\(?\d{2,4}\)?){2,5}"  # +999 555 020 4777
    r"|00\d{1,3}[ .\-/]\d{2,4}(?:[ .\-/]?\d{2,6}){1,3}"
    r"|\(0?\d{2,4}\)[ ]?\d{3,4}[ .\-]\d{3,4}"
    r"|\d{3}[.]\d{3}[.]\d{4}"
    r"|\d{3}-\d{3}-\d{4}"
    r"|\d{3}(?:[ ]\d{2}){4}"
    r"|0\d{2,4}/\d{3}[ ]?\d{3,4}"
    r"|\+?\d{10,13}(?<=\+\d{10})"
    r")(?![\w/]|[.-]\w)"
)
_ID = re.compile(
    r"(?<![\w/+.-])(?:\d{4}([ -])\d{4}\1\d{4}|\d{12}|\d{3}-\d{2}-\d{4}|[A-Z]{5}\d{4}[A-Z]|[A-Z]\d{7})(?![\w/]|-\w)",
)
#: Kinds of streets, as they are written in the addresses.
_STREET = r"(?:street|st\.?|road|rd\.?|lane|ln\.?|court|ct\.?|close|avenue|ave\.?|drive|terrace|crescent)(?!\w)"
_CITY = rf"{_LETTER}+(?:[ -]{_LETTER}+)?"
_ADDRESS = re.compile(
    rf"(?<![\w/.-])(?:(?:flat|apt\.?|apartment|unit)[ ]\d+[a-z]?,[ ]?)?(?:"
    rf"\d+[a-z]?(?:/\d+)?[ ]{_LETTER}+[ ]{_STREET}(?:(?:,\s?|\s)(?P<town>{_LETTER}+[ ]\d{{5}}|\d{{5}}[ ]{_LETTER}+|{_LETTER}+))?"
    rf"|(?:calle|avenida|avda\.?|plaza|rue|via)[ ]{_LETTER}+[ ]\d+(?:,\s?(?:\d{{5}}[ ])?{_LETTER}+)?"
    rf"|{_LETTER}+(?:stra(?:ß|ss)e|str\.|weg|platz|gasse)[ ]\d+[a-z]?(?:,\s?(?:\d{{5}}[ ])?{_LETTER}+)?"
    rf")",
    re.IGNORECASE,
)
_URL_HOST = re.compile(r"https?://[^/\s?]+(?:/[^\s?]*)?", re.IGNORECASE)

#: How the layouts of codes name the fields that hold personal details.
FIELDS = {
    "n": "name", "name": "name", "holder": "name",
    "em": "email", "email": "email",
    "ph": "phone", "phone": "phone", "tel": "phone",
    "id": "id_number", "id no": "id_number", "id_no": "id_number",
    "ad": "address", "addr": "address", "adr": "address", "address": "address",
}
_KEYS = "|".join(re.escape(k) for k in sorted(FIELDS, key=len, reverse=True))
_FIELD = re.compile(
    rf"[?&](?P<k1>{_KEYS})=(?P<v1>[^&#\r\n]*)"
    rf"|\"(?P<k2>{_KEYS})\"\s*:\s*\"(?P<v2>[^\"]*)\""
    rf"|(?:^|;)\s*(?P<k3>{_KEYS})\s*:\s*(?P<v3>[^;]*)(?=;)"
    rf"|(?m:^)[ \t]*(?P<k4>{_KEYS})[ \t]*:[ \t]*(?P<v4>[^\r\n]*)",
    re.IGNORECASE,
)


def _fields(text: str) -> Iterator[tuple[str, int, int]]:
    """Fields of a code's layout that are named for a detail; a code of bars has a number, perhaps a name, and perhaps details before its last field."""
    for m in _FIELD.finditer(text):
        n = m.lastgroup[1]
        a, b = m.span(f"v{n}")
        while a < b and text[a].isspace():
            a += 1
        while a < b and text[b - 1].isspace():
            b -= 1
        if a < b:
            yield FIELDS[m[f"k{n}"].lower()], a, b
    if text.count("|") >= 4:
        spans = [m.span() for m in re.finditer(r"[^|]+", text)]
        spans = [(a + len(text[a:b]) - len(text[a:b].lstrip()), b - len(text[a:b]) + len(text[a:b].rstrip())) for a, b in spans]
        for k, (a, b) in enumerate(spans[2:-1], 2):
            value = text[a:b]
            if "@" in value:
                yield "email", a, b
            elif k == 2 and re.fullmatch(rf"{_LETTER}[^\d|]*[ ,][^\d|]+", value):
                yield "name", a, b
            elif _ADDRESS.match(value):
                yield "address", a, b


def find(text: str, names: Names, code: bool = False) -> list[tuple[str, int, int]]:
    """The details in ``text`` as ``(kind, start, end)`` of the source, in order; with ``code`` the fields of a code's layout count by their names."""
    form = plain(text)
    taken: list[tuple[str, int, int]] = []

    def take(kind: str, a: int, b: int) -> None:
        if a < b and not any(a < y and x < b for _, x, y in taken):
            taken.append((kind, a, b))

    flat = form.text
    if code:
        for kind, a, b in _fields(flat):
            take(kind, a, b)
    for m in _EMAIL.finditer(flat):
        take("email", *m.span())
    for m in _ADDRESS.finditer(flat):
        if m["town"] or any(c.isupper() for c in m.group()):  # a street in small letters needs its town
            take("address", *m.span())
    for m in _PHONE.finditer(flat):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            take("phone", *m.span())
    for m in _ID.finditer(flat):
        take("id_number", *m.span())
    hosts = [m.span() for m in _URL_HOST.finditer(flat)]
    for a, b in _names(flat, names):
        if not any(a < y and x < b for x, y in hosts):
            take("name", a, b)
    return [(kind, *form.source(a, b)) for kind, a, b in sorted(taken, key=lambda t: t[1])]


def redact(text: str, found: list[tuple[str, int, int]]) -> str:
    """``text`` with '<KIND>' in the place of each detail."""
    out, at = [], 0
    for kind, a, b in found:
        out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join([*out, text[at:]])


# --- Over tables ---------------------------------------------------------------------------------------------------


def _names_of(name_parts: DataFrame) -> Names:
    rows = name_parts.select("name_part", "kind").dropna().distinct().limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} name parts; pass a table of the most frequent ones")
    return Names((r.name_part, r.kind) for r in rows)


def located(texts: DataFrame, name_parts: DataFrame, redacted: bool = False) -> DataFrame:
    """The details in ``texts`` (origin, record_id, text, code): ``(origin, record_id, kind, start_pos, end_pos, placeholder)``.

    With ``redacted`` one row for each text instead, ``(origin, record_id,
    text)``, with placeholders. Positions count Unicode characters from 0.
    Null and empty texts have no details (and stay as they are); a null
    origin or record_id stays null; rows repeated in every column count once;
    overlapping details count as the one found first, in the order of named
    fields, e-mail, address, phone, id number, name.
    """
    names = _names_of(name_parts)
    kinds = {f.name: f.dataType.simpleString() for f in texts.schema}
    ids = f"origin {kinds['origin']}, record_id {kinds['record_id']}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stored, code = batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist()
            rows, found = [], []
            new = []
            for i, (raw, c) in enumerate(zip(stored, code)):
                text = None if raw is None else raw.decode("utf-8", "replace")
                hits = find(text, names, bool(c)) if text else []
                new.append(redact(text, hits) if text else text)
                rows += [i] * len(hits)
                found += hits
            own = batch.select([0, 1])
            if redacted:
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(new, pa.string())], ["origin", "record_id", "text"])
                continue
            own = own.take(pa.array(rows, pa.int64()))
            kind, start, end = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*own.columns, pa.array(kind, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array([f"<{k.upper()}>" for k in kind], pa.string())],
                ["origin", "record_id", "kind", "start_pos", "end_pos", "placeholder"],
            )

    given = spread(texts.select("origin", "record_id", "text", "code"))
    if redacted:
        return given.mapInArrow(run, f"{ids}, text string").distinct()
    return given.mapInArrow(run, f"{ids}, kind string, start_pos bigint, end_pos bigint, placeholder string").distinct()


def review_and_code_texts(reviews: DataFrame, qr_hits: DataFrame) -> DataFrame:
    """The texts of both tables as ``(origin, record_id, text, code)``."""
    notes = reviews.select(F.lit("reviews").alias("origin"), F.col("review_id").alias("record_id"), F.col("notes").alias("text"), F.lit(False).alias("code"))
    payloads = qr_hits.select(F.lit("qr_hits").alias("origin"), F.col("hit_id").alias("record_id"), F.col("payload").alias("text"), F.lit(True).alias("code"))
    return notes.unionByName(payloads)
