"""Text expressions: numbers inside messy cells, and plain text out of web pages."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the catalogue cells and of the page job.
PEAK_PATTERN = r"(?i)peak:\s*([0-9.]+)"
NUMBER_PATTERN = r"-?[0-9]+\.?[0-9]*"
TITLE_PATTERN = r'"title":"(.*?)","'
ABSTRACT_PATTERN = r'"abstract":"(.*?)","'
SENTENCE_BREAK = r"(?<=[.!?]) +"
KEYWORDS = ("imput", "missing", "preprocess", "process", "KNN", "normalize", "interp")

_RANGE_DASH = r"(?<=[0-9.])\s*-\s*(?=[0-9])"
_HTML_TITLE = r"(?is)<title[^>]*>(.*?)</title\s*>"
# One markup token: comment, script or style element, tag or declaration, text run, lone "<".
_TOKEN = (
    r"(?is)<!--.*?-->"
    r"|<script\b[^>]*+>.*?</script\s*+>"
    r"|<style\b[^>]*+>.*?</style\s*+>"
    r"|</?[a-z](?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+>"
    r"|<[!?][^>]*+>"
    r"|[^<]++"
    r"|<"
)
_RAW_ELEMENT = r"(?is)^<(?:script|style)\b[^>]*+>(.*)</(?:script|style)\s*+>$"
_ENTITY_PIECE = r"&#[xX][0-9a-fA-F]+;?|&#[0-9]+;?|&[A-Za-z][A-Za-z0-9]*;?|[^&]+|&"
# Names the standard also accepts without a semicolon, in front of any letters; longest first.
_OPEN_NAMES = sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)
_OPEN_NAME = "^&(?:" + "|".join(_OPEN_NAMES) + ")"
# The references met most often are answered before the full standard table is searched.
_WINDOWS = [
    chr(c) if c in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([c]).decode("cp1252") for c in range(128, 160)
]
_COMMON = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&nbsp;": " "}


def strip(c: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def text_or(c: Column, default: str = "Unknown") -> Column:
    return F.coalesce(c, F.lit(default))


def messy_number(c: Column) -> Column:
    """Number in a cell such as ``~2000``, ``>180``, ``38-43 (peak: 41)`` or ``45-48``.

    A stated peak wins; a range without a peak gives the mean of its two ends; otherwise
    the first number counts. Cells without a number give NULL.
    """
    cell = strip(c)
    peak = F.regexp_extract(cell, PEAK_PATTERN, 1)
    has_peak = F.contains(F.lower(cell), F.lit("peak:"))
    plain = F.regexp_replace(cell, _RANGE_DASH, " ")
    numbers = F.transform(
        F.regexp_extract_all(plain, F.lit(NUMBER_PATTERN), F.lit(0)),
        lambda x: x.try_cast("double"),
    )
    # Cheap tests come first, so that most cells meet few patterns.
    is_range = ~F.startswith(cell, F.lit("-")) & ~has_peak & (F.size(numbers) >= 2)
    return (
        F.when(has_peak & (peak != ""), peak.try_cast("double"))
        .when(~F.contains(cell, F.lit("-")), F.regexp_extract(cell, NUMBER_PATTERN, 0).try_cast("double"))
        .when(is_range, (F.get(numbers, F.lit(0)) + F.get(numbers, F.lit(1))) / F.lit(2.0))
        .otherwise(F.get(numbers, F.lit(0)))
    )


def _group_or_null(c: Column, pattern: str) -> Column:
    return F.when(F.regexp_like(c, F.lit(pattern)), F.regexp_extract(c, pattern, 1))


def embedded_title(html: Column) -> Column:
    """Title in the page's embedded JSON, else its title element, else NULL."""
    return F.coalesce(_group_or_null(html, TITLE_PATTERN), _group_or_null(html, _HTML_TITLE))


def embedded_abstract(html: Column) -> Column:
    return _group_or_null(html, ABSTRACT_PATTERN)


def _code_point(digits: Column, base: int) -> Column:
    """Character of a numeric reference by the HTML standard: C1 numbers are Windows-1252
    characters, what is no character is U+FFFD, and controls and non-characters are dropped."""
    code = F.when(F.length(digits) < 10, F.conv(digits, base, 10).try_cast("long")).otherwise(F.lit(1 << 31))
    valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    control = code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127)
    nothing = control | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    windows = F.element_at(F.array(*[F.lit(c) for c in _WINDOWS]), (code - 127).cast("int"))
    return (
        F.when(code.between(128, 159), windows)
        .when(valid & nothing, F.lit(""))
        .when(valid, char)
        .otherwise(F.lit("\ufffd"))
    )


def _entity(piece: Column) -> Column:
    table = F.from_json(
        F.lit(json.dumps({"&" + name: text for name, text in html5.items()})),
        "map<string,string>",
    )
    out = F.when(~F.startswith(piece, F.lit("&")), piece)
    for name, text in _COMMON.items():
        out = out.when(piece == name, F.lit(text))
    decimal = F.regexp_extract(piece, r"^&#0*([0-9]+?);?$", 1)
    prefix = F.regexp_extract(piece, _OPEN_NAME, 0)
    hexadecimal = F.regexp_extract(piece, r"^&#[xX]0*([0-9a-fA-F]+?);?$", 1)
    return (
        out.when(decimal != "", _code_point(decimal, 10))
        .when(hexadecimal != "", _code_point(hexadecimal, 16))
        .otherwise(
            F.coalesce(
                F.try_element_at(table, piece),
                F.concat(F.try_element_at(table, prefix), F.substr(piece, F.length(prefix) + 1)),
                piece,
            )
        )
    )


def decode_entities(c: Column) -> Column:
    """Character references to characters; unknown ones stay as written."""
    pieces = F.regexp_extract_all(c, F.lit(_ENTITY_PIECE), F.lit(0))
    decoded = F.array_join(F.transform(pieces, _entity), "")
    return F.when(F.contains(c, F.lit("&")), decoded).otherwise(c)


def markup_text(html: Column) -> Column:
    """Text nodes of a page, stripped and joined by single spaces; blank nodes dropped.

    Script and style bodies are text nodes without character references.
    """

    def node(token: Column) -> Column:
        raw = F.regexp_like(token, F.lit(_RAW_ELEMENT))
        is_tag = F.startswith(token, F.lit("<")) & (F.length(token) > 1)
        text = (
            F.when(raw, F.regexp_extract(token, _RAW_ELEMENT, 1))
            .when(is_tag, F.lit(""))
            .otherwise(decode_entities(token))
        )
        return strip(text)

    tokens = F.regexp_extract_all(html, F.lit(_TOKEN), F.lit(0))
    return F.array_join(F.filter(F.transform(tokens, node), lambda t: t != ""), " ")


def sentences(c: Column) -> Column:
    return F.split(c, SENTENCE_BREAK)


def mentions(c: Column, keywords: tuple[str, ...] = KEYWORDS) -> Column:
    """True if any keyword pattern occurs, ignoring case."""
    return F.regexp_like(c, F.lit("(?i)" + "|".join(keywords)))
