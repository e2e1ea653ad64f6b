"""Scalar text functions: Columns where Spark has the pieces, Arrow functions where it has not."""

from __future__ import annotations

import html.parser
import json
import re
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, MapType, StringType

#: Words that a question's terms leave out.
STOP_WORDS = ["about", "after", "before", "could", "document", "from", "have", "page", "that", "the", "this", "what", "when", "where", "which", "with", "would"]

#: Kinds of producing tools by the markers in their names, in the order in which they are tried.
PRODUCERS = {
    "image_editor": ["photoshop", "gimp", "imagemagick", "inkscape", "pixelmator", "affinity", "corel", "paint.net", "krita"],
    "scanner": ["scan", "canoscan", "epson", "kodak", "fujitsu", "scansnap", "xerox", "ricoh", "sharpdesk", "hp digital sending", "naps2", "vuescan", "paperport"],
    "browser_or_converter": ["skia/pdf", "cairo", "wkhtmltopdf", "img2pdf", "canva", "ilovepdf", "smallpdf", "pdf24", "sejda", "pdfsam", "microsoft: print to pdf"],
    "office_export": ["microsoft word", "microsoft excel", "microsoft powerpoint", "libreoffice", "openoffice", "pages", "google docs", "latex", "pdftex", "xetex", "quartz"],
    "pdf_library": ["itext", "reportlab", "pdfbox", "tcpdf", "fpdf", "jasperreports", "crystal reports", "pypdf", "pdflib", "acrobat distiller"],
}

#: Families of fonts that web pages bring along, and of fonts that desktops have.
WEB_FONTS = "roboto|opensans|open.sans|lato|montserrat|raleway|nunito|poppins|sourcesans|source.sans|inter|ubuntu|noto|merriweather|playfair|mulish|outfit|firasans|fira.sans"
SYSTEM_FONTS = "arial|times.new.roman|timesnewroman|verdana|calibri|cambria|nirmala|mangal|kokila|utsaah|aparajita|latha|gautami|raavi|shruti|tunga|vani|vijaya|kartika|chandas|samyak|devanagari"

#: Fixed value: the digest of an empty file, which links nothing.
EMPTY_FILE = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def digest(c: Column) -> Column:
    """A SHA-256 digest as 64 hex digits in small letters, however it was written; null for anything else and for an empty file's."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(c), r"^\s*sha-?256\s*[:=]?", ""), "[^0-9a-f]", "")
    return F.when((F.length(bare) == 64) & (bare != EMPTY_FILE), bare)


def bare_font(name: Column) -> Column:
    """A font's name without its subset tag."""
    return F.regexp_replace(name, r"^[A-Z]{6}\+", "")


def font_key(name: Column) -> Column:
    """What groups a font's spellings: no subset tag, blanks, hyphens or capitals."""
    return F.lower(F.regexp_replace(bare_font(name), r"[\s\-_]+", ""))


def key_of(label: Column) -> Column:
    """A label as a key: small letters, other characters as single underscores."""
    return F.trim(F.regexp_replace(F.lower(label), r"[^a-z0-9]+", "_"), F.lit("_"))


def title_case(s: Column) -> Column:
    return F.initcap(F.regexp_replace(s, "[_-]+", " "))


def producer_kind(s: Column) -> Column:
    """The kind of tool that a producer's and creator's names stand for: that of the first marker they hold, in order; else unknown."""
    out = F.lit("unknown")
    for kind, markers in reversed(PRODUCERS.items()):
        out = F.when(F.rlike(F.lower(s), F.lit("|".join(map(re.escape, markers)))), kind).otherwise(out)
    return out


def font_class(s: Column) -> Column:
    """web, system or unknown, by the family in a font's name."""
    low = F.lower(s)
    return F.when(F.rlike(low, F.lit(WEB_FONTS)), "web").when(F.rlike(low, F.lit(SYSTEM_FONTS)), "system").otherwise("unknown")


def fact_text(value: Column) -> Column:
    """A fact as displayed: at most 400 characters; blank is null."""
    return F.left(F.nullif(F.trim(value), F.lit("")), F.lit(400))


def clamp_int(text: Column, low: int, high: int, default: int) -> Column:
    """A setting as a whole number within bounds; the default where it is none."""
    return F.least(F.greatest(F.coalesce(text.try_cast("int"), F.lit(default)), F.lit(low)), F.lit(high))


def clamp_float(text: Column, low: float, high: float, default: float) -> Column:
    return F.least(F.greatest(F.coalesce(text.try_cast("double"), F.lit(default)), F.lit(low)), F.lit(high))


def allowed(text: Column, values: list[str], default: str) -> Column:
    """A setting as one of the words allowed, whatever its capitals; the default where it is none."""
    word = F.lower(F.trim(text))
    return F.when(word.isin(values), word).otherwise(default)


def pdf_date(s: Column) -> Column:
    """A PDF date (D:YYYYMMDD...) as 14 digits, missing parts as zeros; null if there is no year."""
    digits = F.regexp_extract(s, r"(\d{4,14})", 1)
    return F.when(digits != "", F.rpad(digits, 14, "0").cast("bigint"))


def extract_date(s: Column) -> Column:
    """The first date in a text as DD-MM-YYYY, written day first or year first; null if there is none."""
    parts = lambda pattern: [F.regexp_extract(s, pattern, i) for i in (1, 2, 3)]
    two = lambda c: F.lpad(c, 2, "0")
    d, m, y = parts(r"\b(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})\b")
    y2, m2, d2 = parts(r"\b(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})\b")
    return F.when(y != "", F.concat_ws("-", two(d), two(m), y)).when(y2 != "", F.concat_ws("-", two(d2), two(m2), y2))


def date_forms(s: Column) -> Column:
    """A value and, if its first three numbers are a date with a year of four digits first or last, the ways to write it."""
    n = F.regexp_extract_all(s, F.lit(r"(\d+)"), 1)
    a, b, c = (F.get(n, F.lit(i)) for i in range(3))
    two = lambda v: F.when(F.length(v) < 2, F.lpad(v, 2, "0")).otherwise(v)
    first, last = F.length(a) == 4, F.length(c) == 4
    y, m, d = F.when(first, a).otherwise(c), two(b), two(F.when(first, c).otherwise(a))
    bare = lambda v: F.regexp_replace(v, "^0+(?=.)", "")
    forms = F.array(s, F.concat_ws("/", d, m, y), F.concat_ws("-", d, m, y), F.concat_ws("-", y, m, d), F.concat_ws("/", bare(d), bare(m), y), F.concat_ws("-", bare(d), bare(m), y))
    return F.when((F.size(n) >= 3) & (first | last), F.array_distinct(forms)).when(s.isNotNull(), F.array(s))


def terms(question: Column) -> Column:
    """A question's terms in order: words (letters, digits, underscores, hyphens) of three characters or more that are no stop words, in small letters."""
    words = F.regexp_extract_all(F.lower(question), F.lit(r"(?U)([\w-]+)"), 1)
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS))


def occurrences(text: Column, term: Column) -> Column:
    """How often ``term`` stands in ``text``, without overlaps."""
    low = F.lower(text)
    return ((F.length(low) - F.length(F.replace(low, term, F.lit("")))) / F.greatest(F.length(term), F.lit(1))).cast("int")


def word_quality(text: Column) -> dict[str, Column]:
    """Words of a text, those that are clean, and the share of the others."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    clean = F.filter(words, lambda w: F.rlike(w, F.lit(r"^[A-Za-z]{2,}[.,;:!?]?$")))
    n, c = F.size(words), F.size(clean)
    return {"words": n, "clean": c, "garbled": F.round(F.coalesce(F.try_divide(n - c, n), F.lit(0.0)), 6)}


@pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode composed, blanks folded."""
    return s.map(lambda v: None if v is None else " ".join(unicodedata.normalize("NFC", v).split()))


def fold(v: str) -> str:
    """Small ASCII letters and digits, accents dropped, anything else as single blanks."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c)).lower()
    return " ".join(re.sub(r"[^a-z0-9]+", " ", bare).split())


@pandas_udf(StringType())
def folded(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else fold(v))


def partial(a: str, b: str) -> float:
    """The best match of the shorter text with a stretch of the longer, 0 to 100."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 0.0
    best = 0.0
    for block in SequenceMatcher(None, short, long, autojunk=False).get_matching_blocks():
        start = max(0, block.b - block.a)
        best = max(best, SequenceMatcher(None, short, long[start : start + len(short)], autojunk=False).ratio())
    return round(100 * best, 2)


@pandas_udf(DoubleType())
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else partial(x, y) for x, y in zip(a, b)], dtype="float64")


_HIDDEN = ("script", "style", "noscript", "svg")


class _Text(html.parser.HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in _HIDDEN

    def handle_endtag(self, tag: str) -> None:
        self.hidden = max(0, self.hidden - (tag in _HIDDEN))

    def handle_data(self, data: str) -> None:
        line = " ".join(data.split())
        if line and not self.hidden:
            self.parts.append(line)


def text_of_html(markup: str) -> str:
    """The visible text of a page, a line for each stretch between tags that has some."""
    parser = _Text()
    parser.feed(markup)
    parser.close()
    return "\n".join(parser.parts)


@pandas_udf(StringType())
def html_text(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else text_of_html(v))


def flat_json(text: str) -> dict[str, str]:
    """A JSON text as dotted paths, positions in lists included, and their scalars as text; nothing if it is invalid."""
    try:
        todo = [("", json.loads(text))]
    except (ValueError, RecursionError):
        return {}
    out = {}
    while todo:
        path, value = todo.pop()
        inner = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else None
        if inner is not None:
            todo += [(f"{path}.{k}" if path else str(k), v) for k, v in inner]
        elif value is not None:
            out[path or "value"] = str(value)
    return out


@pandas_udf(MapType(StringType(), StringType()))
def json_paths(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else flat_json(v))


def url_parts(url: Column) -> dict[str, Column]:
    """Scheme, host, path and query of a link; null parts where it is none."""
    return {p: F.try_parse_url(url, F.lit(n)) for p, n in (("scheme", "PROTOCOL"), ("host", "HOST"), ("path", "PATH"), ("query", "QUERY"))}


def base64_text(s: Column) -> Column:
    """Text from Base64 in the plain or the URL alphabet, padded or not; null if it is none."""
    plain = F.translate(F.trim(s), "-_", "+/")
    padded = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("="))
    ok = F.rlike(plain, F.lit(r"^[A-Za-z0-9+/]{4,}={0,2}$"))
    return F.when(ok, F.try_validate_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string")))


def fenced_json(s: Column) -> Column:
    """The JSON object in an answer: between fences, or from its first brace to its last; a VARIANT, null if there is none."""
    fenced = F.nullif(F.regexp_extract(s, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    braces = F.nullif(F.regexp_extract(s, r"(?s)(\{.*\})", 1), F.lit(""))
    return F.coalesce(F.try_parse_json(s), F.try_parse_json(fenced), F.try_parse_json(braces))
