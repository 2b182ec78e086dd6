"""Unicode properties, normal forms and option-driven mapping as Arrow UDFs.

The properties are those of the Python that runs (unicodedata and regex), which may be one Unicode version behind others.
UTF-8 validity and encoding stay in Spark's own functions. What a character maps to is worked out once per worker; texts go
through tables of the characters seen.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

# Option flags of mapped().
NULLTERM, STABLE, COMPAT, COMPOSE, DECOMPOSE, IGNORE, REJECTNA, NLF2LS, NLF2PS = (1 << k for k in range(9))
STRIPCC, CASEFOLD, CHARBOUND, LUMP, STRIPMARK, STRIPNA = (1 << k for k in range(9, 15))
NLF2LF = NLF2LS | NLF2PS

# Error codes and their texts.
ERRORS = {
    -1: "Memory for processing UTF-8 data could not be allocated.",
    -2: "UTF-8 string is too long to be processed.",
    -3: "Invalid UTF-8 string",
    -4: "Unassigned Unicode code point found in UTF-8 string.",
    -5: "Invalid options for UTF-8 processing chosen.",
}
UNKNOWN_ERROR = "An unknown error occurred while processing UTF-8 data."

# What LUMP puts in place of single code points.
LUMPS = {
    0x2018: "'", 0x2019: "'", 0x02BC: "'", 0x02C8: "'", 0x2212: "-", 0x2044: "/", 0x2215: "/", 0x2236: ":", 0x2039: "<", 0x2329: "<", 0x3008: "<",
    0x203A: ">", 0x232A: ">", 0x3009: ">", 0x2216: "\\", 0x02C4: "^", 0x02C6: "^", 0x2038: "^", 0x2303: "^", 0x02CD: "_", 0x02CB: "`", 0x2223: "|", 0x223C: "~",
}
LUMPED_CATEGORIES = {"Zs": " ", "Pd": "-", "Pc": "_"}

_IGNORABLE = regex.compile(r"\p{Default_Ignorable_Code_Point}")
_CLUSTER = regex.compile(r"\X")


class MappingError(ValueError):
    def __init__(self, code: int):
        super().__init__(ERRORS[code])
        self.code = code


def error_text(code: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ERRORS.items() for x in kv]), code.cast("int")), F.lit(UNKNOWN_ERROR))


VERSIONS = ("2.10.0", "16.0.0")  # fixed values: the version of the functions whose semantics these follow, and of Unicode in it


def versions() -> tuple[str, str, str]:
    """VERSIONS and the Unicode version of the data that runs here."""
    return (*VERSIONS, unicodedata.unidata_version)


def valid_code_point(c: Column) -> Column:
    return (c >= 0) & (c < 0x110000) & ~c.between(0xD800, 0xDFFF)


def sequence_length(lead: Column) -> Column:
    """Bytes of the UTF-8 sequence that a lead byte begins; 0 for bytes that begin none."""
    return F.when(lead < 0x80, 1).when(lead.between(0xC2, 0xDF), 2).when(lead.between(0xE0, 0xEF), 3).when(lead.between(0xF0, 0xF4), 4).otherwise(0)


def encode_code_point(c: Column) -> Column:
    """UTF-8 bytes of a code point; no bytes if it is none."""
    return F.when(valid_code_point(c), F.encode(F.when(c == 0, F.lit("\0")).otherwise(F.arrow_udf(_characters, "string")(c)), "UTF-8")).otherwise(F.lit(b""))


def _characters(points: pa.Array) -> pa.Array:
    return pa.array([chr(x) if x is not None and 0 <= x < 0x110000 and not 0xD800 <= x < 0xE000 else None for x in points.to_pylist()], pa.string())


def valid_utf8(data: Column) -> Column:
    """Strict: no overlong forms, surrogates or code points above 10FFFF."""
    return F.is_valid_utf8(data)


def code_points(c: Column) -> Column:
    """array<int> of a text's code points."""
    return _udf(lambda s: [*map(ord, s)], "array<int>", pa.list_(pa.int32()))(c)


def from_code_points(points: Column) -> Column:
    """The text of an array of code points; those that are none are left out."""
    return _udf(lambda p: "".join(chr(x) for x in p if x is not None and 0 <= x < 0x110000 and not 0xD800 <= x < 0xE000), "string", pa.string())(points)


def _udf(f: Callable, kind: str, arrow: pa.DataType) -> Callable[[Column], Column]:
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if x is None else f(x) for x in texts.to_pylist()], arrow)

    return lambda c: F.arrow_udf(run, kind)(c)


def normalized(c: Column, form: str) -> Column:
    """form: NFC, NFD, NFKC or NFKD."""
    return _udf(lambda s: unicodedata.normalize(form, s), "string", pa.string())(c)


def graphemes(c: Column) -> Column:
    """Extended grapheme clusters."""
    return _udf(lambda s: _CLUSTER.findall(s), "array<string>", pa.list_(pa.string()))(c)


def grapheme_count(c: Column) -> Column:
    return _udf(lambda s: len(_CLUSTER.findall(s)), "long", pa.int64())(c)


def breaks(c: Column) -> Column:
    """array<boolean>: for each character but the first, whether a grapheme cluster begins there, with all before it in mind."""
    return _udf(lambda s: [k == 0 for x in _CLUSTER.findall(s) for k in range(len(x))][1:], "array<boolean>", pa.list_(pa.bool_()))(c)


def break_between(a: Column, b: Column) -> Column:
    """Whether a grapheme cluster ends between two characters (the first of each text) with nothing before them in mind; null
    if either is null or empty."""

    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([len(_CLUSTER.findall(p[0] + q[0])) == 2 if p and q else None for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.bool_())

    return F.arrow_udf(run, "boolean")(a, b)


PROPERTIES = pa.struct([
    ("category", pa.string()), ("combining_class", pa.int32()), ("bidi_class", pa.string()), ("bidi_mirrored", pa.bool_()), ("decomposition_type", pa.string()),
    ("decomposition", pa.string()), ("uppercase", pa.string()), ("lowercase", pa.string()), ("titlecase", pa.string()), ("casefold", pa.string()), ("width", pa.int32()),
    ("ambiguous_width", pa.bool_()), ("ignorable", pa.bool_()), ("control_boundary", pa.bool_()),
])


@functools.lru_cache(maxsize=1 << 16)
def _properties(ch: str) -> dict:
    parts = unicodedata.decomposition(ch).split()
    kind = parts.pop(0)[1:-1] if parts and parts[0].startswith("<") else "canonical" if parts else None
    category_ = unicodedata.category(ch)
    return {
        "category": category_, "combining_class": unicodedata.combining(ch), "bidi_class": unicodedata.bidirectional(ch) or None, "bidi_mirrored": bool(unicodedata.mirrored(ch)),
        "decomposition_type": kind, "decomposition": "".join(chr(int(x, 16)) for x in parts) or None, "uppercase": to_upper(ch), "lowercase": to_lower(ch), "titlecase": to_title(ch),
        "casefold": ch.casefold(), "width": _width(ch), "ambiguous_width": unicodedata.east_asian_width(ch) == "A", "ignorable": bool(_IGNORABLE.match(ch)),
        "control_boundary": category_ in ("Zl", "Zp", "Cc", "Cf") and ch not in "\u200c\u200d",
    }


def properties(c: Column) -> Column:
    """The record of each text's first character; null for null and empty texts. decomposition_type is null, canonical or the
    tag of a compatibility mapping; unassigned characters have category Cn."""
    kinds = {pa.string(): "string", pa.int32(): "int", pa.bool_(): "boolean"}
    kind = "struct<" + ",".join(f"{f.name}:{kinds[f.type]}" for f in PROPERTIES) + ">"
    return _udf(lambda s: _properties(s[0]) if s else None, kind, PROPERTIES)(c)


def category(c: Column) -> Column:
    """The general category of each text's first character."""
    return _udf(lambda s: unicodedata.category(s[0]) if s else None, "string", pa.string())(c)


class _OneToOne(dict):
    """Code point to its mapping; characters whose mapping is longer stay."""

    def __init__(self, change: Callable[[str], str]):
        self.change = change

    def __missing__(self, point: int) -> str:
        ch = chr(point)
        self[point] = x if len(x := self.change(ch)) == 1 else ch
        return self[point]


def _one(change: Callable[[str], str]) -> Callable[[str], str]:
    """One-to-one case mapping."""
    seen = _OneToOne(change)
    return lambda s: s.translate(seen)


to_lower, to_upper, to_title = (_one(f) for f in (str.lower, str.upper, str.title))


def simple_lower(c: Column) -> Column:
    return _udf(to_lower, "string", pa.string())(c)


def simple_upper(c: Column) -> Column:
    return _udf(to_upper, "string", pa.string())(c)


def simple_title(c: Column) -> Column:
    """Title case of every character by itself."""
    return _udf(to_title, "string", pa.string())(c)


def is_lower(c: Column) -> Column:
    """Of the first character: it has an upper case and is not one."""
    return _udf(lambda s: bool(s) and to_lower(s[0]) == s[0] != to_upper(s[0]), "boolean", pa.bool_())(c)


def is_upper(c: Column) -> Column:
    return _udf(lambda s: bool(s) and to_upper(s[0]) == s[0] != to_lower(s[0]) and unicodedata.category(s[0]) != "Lt", "boolean", pa.bool_())(c)


@functools.lru_cache(maxsize=1 << 16)
def _width(ch: str) -> int:
    kind = unicodedata.category(ch)
    if kind in ("Mn", "Me", "Cc", "Cf", "Zl", "Zp", "Cs", "Cn") and ch != "­":
        return 0
    return 2 if unicodedata.east_asian_width(ch) in "WF" else 1


def display_width(c: Column) -> Column:
    """Columns on a terminal: 2 for wide and full-width characters, 0 for marks, controls and formats."""
    return _udf(lambda s: sum(map(_width, s)), "long", pa.int64())(c)


def ambiguous_width(c: Column) -> Column:
    """How many characters have an ambiguous East Asian width."""
    return _udf(lambda s: sum(unicodedata.east_asian_width(x) == "A" for x in s), "long", pa.int64())(c)


def _lump(ch: str, options: int) -> str:
    kind = unicodedata.category(ch)
    if options & NLF2LF == NLF2LF and kind in ("Zl", "Zp"):
        return "\n"
    return LUMPED_CATEGORIES.get(kind) or LUMPS.get(ord(ch), ch)


@functools.lru_cache(maxsize=1 << 16)
def _decomposed(ch: str, options: int) -> str:
    """One character after the filters and foldings; their result is decomposed again under the same options."""
    kind = unicodedata.category(ch)
    forms = options & (COMPOSE | DECOMPOSE)
    if forms and 0xAC00 <= ord(ch) < 0xD7A4:
        return unicodedata.normalize("NFD", ch)
    if kind == "Cn" and options & REJECTNA:
        raise MappingError(-4)
    if options & IGNORE and _IGNORABLE.match(ch) or options & STRIPNA and kind == "Cn":
        return ""
    if options & LUMP and (to := _lump(ch, options)) != ch:
        return _decomposed(to, options & ~LUMP)
    if options & STRIPMARK and kind in ("Mn", "Mc", "Me"):
        return ""
    if options & CASEFOLD and (to := ch.casefold()) != ch:
        return "".join(_decomposed(x, options) if x != ch else x for x in to)
    if forms and (to := unicodedata.normalize("NFKD" if options & COMPAT else "NFD", ch)) != ch:
        return "".join(_decomposed(x, options) for x in to)
    return ch


def _newlines(s: str, options: int) -> str:
    if not options & (NLF2LF | STRIPCC):
        return s
    line = {NLF2LF: "\n", NLF2LS: "\u2028", NLF2PS: "\u2029", 0: " "}[options & NLF2LF]
    strip = bool(options & STRIPCC)

    def one(m: regex.Match) -> str:
        x = m[0]
        if x in ("\r\n", "\n", "\r", "\x85") or strip and x in "\x0b\x0c":
            return line
        return x if not strip else " " if x == "\t" else ""

    return regex.sub("\r\n|[\x00-\x1f\x7f-\x9f]", one, s)


def map_text(s: str, options: int, custom: dict[int, int] | None = None) -> str:
    """The text after decomposition, canonical ordering, newline handling and composition, as the options say.

    custom maps code points first. CHARBOUND puts U+FFFF before each grapheme cluster. COMPOSE with DECOMPOSE, or
    STRIPMARK without either, are invalid.
    """
    if options & COMPOSE and options & DECOMPOSE or options & STRIPMARK and not options & (COMPOSE | DECOMPOSE):
        raise MappingError(-5)
    if options & NULLTERM:
        s = s.split("\0", 1)[0]
    if custom:
        s = s.translate(custom)
    s = "".join(_decomposed(x, options) for x in s)
    if options & (COMPOSE | DECOMPOSE):
        s = unicodedata.normalize("NFD", s)  # all is decomposed: this puts marks in order
    s = _newlines(s, options)
    if options & COMPOSE:
        s = unicodedata.normalize("NFC", s)
    return "".join("￿" + x for x in _CLUSTER.findall(s)) if options & CHARBOUND else s


def mapped(c: Column, options: int, custom: dict[int, int] | None = None) -> Column:
    """map_text() of each text, null where it fails."""

    def one(s: str) -> str | None:
        try:
            return map_text(s, options, custom)
        except MappingError:
            return None

    return _udf(one, "string", pa.string())(c)


def nfkc_casefold(c: Column) -> Column:
    return mapped(c, NULLTERM | STABLE | COMPOSE | COMPAT | CASEFOLD | IGNORE)
