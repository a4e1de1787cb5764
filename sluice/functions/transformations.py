"""Transformations of texts: expressions where SQL can state them, Arrow functions over batches where not.

Every transformation of a null is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..seclang.errors import UnknownTransformation
from . import python_decoders as py

BLANK = r"\p{IsWhite_Space}"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _replace(v: Column, old: str, new: str) -> Column:
    return F.replace(v, F.lit(old), F.lit(new))


def _text(binary: Column) -> Column:
    return F.make_valid_utf8(binary.cast("string"))


def _count(v: Column, part: str) -> Column:
    return F.length(v) - F.length(_replace(v, part, ""))


def url_decode(v: Column) -> Column:
    """Percent-decoding that keeps plus signs and malformed codes; if the result is no UTF-8, the input."""
    plain = _replace(F.regexp_replace(v, "%(?![0-9A-Fa-f]{2})", "%25"), "+", "%2B")
    out = F.coalesce(F.try_url_decode(plain), v)
    known = _count(v, "�") + F.regexp_count(v, F.lit("(?i)%EF%BF%BD"))
    return F.when(~F.contains(v, F.lit("%")) | (_count(out, "�") > known), v).otherwise(out)


def normalize_path(v: Column) -> Column:
    """Slashes unified and collapsed, ``.`` and ``..`` resolved; unchanged texts stay as they are, trailing slash included."""
    slashed = _replace(v, "\\", "/")
    parts = F.split(F.regexp_replace(slashed, "/+", "/"), "/", -1)
    kept = F.aggregate(
        parts, F.expr("cast(array() as array<string>)"),
        lambda acc, p: F.when((p == ".") | ((p == "") & (F.size(acc) > 0)), acc)
        .when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p)))
    touched = F.contains(v, F.lit("\\")) | F.contains(slashed, F.lit("//")) | F.exists(parts, lambda p: p.isin(".", ".."))
    return F.when(touched, F.array_join(kept, "/")).otherwise(v)


def _base64(v: Column) -> Column:
    whole = r"\A(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z"
    loose = r"(?:[A-Za-z0-9+/][BCDEFHIJKLMNOPRSTUVXYZabcdefhijklmnoprstuvxyz1-57-9+/]==|[A-Za-z0-9+/]{2}[BCDFGHJKLNOPRSTVWXZabdefhijlmnpqrtuvxyz1235679+/]=)\z"
    return F.when(v.rlike(whole) & ~v.rlike(loose), _text(F.try_to_binary(v, F.lit("base64"))))


def _url_alphabet(v: Column) -> Column:
    return F.when(~v.rlike(r"[+/]"), F.translate(v, "-_", "+/"))


def hex_decode(v: Column) -> Column:
    """Pairs of digits, of which the first may be a plus sign; anything else comes back as it was."""
    signed = F.regexp_replace(v, r"\G((?:[0-9A-Fa-f]{2})*+)\+([0-9A-Fa-f])", "$10$2")
    return F.when(signed.rlike(r"\A(?:[0-9A-Fa-f]{2})*+\z") & (F.length(v) % 2 == 0), _text(F.unhex(signed))).otherwise(v)


def url_encode(v: Column) -> Column:
    out = F.url_encode(v)
    for c, code in (("+", "%20"), ("*", "%2A"), ("-", "%2D"), (".", "%2E"), ("_", "%5F")):
        out = _replace(out, c, code)
    return out


def _same(v: Column) -> Column:
    return v


def trim_both(v: Column) -> Column:
    return F.regexp_replace(v, rf"\A{BLANK}++|{BLANK}++\z", "")


def command_line(v: Column) -> Column:
    spaced = F.translate(v, ",;'\"`" + _UPPER + "^", "     " + _LOWER)
    return trim_both(F.regexp_replace(spaced, BLANK + "+", " "))


def remove_comment_marks(v: Column) -> Column:
    for mark in ("/*", "*/", "--", "#"):
        v = _replace(v, mark, "")
    return v


@dataclass(frozen=True)
class Transformation:
    """``native`` gives an expression; ``python`` a function of one text, for those that have none. Texts without ``sign`` stay as they are."""

    name: str
    native: Callable[[Column], Column] | None = None
    python: Callable[[str], str] | None = None
    sign: str = ""


_NATIVE: dict[str, Callable[[Column], Column]] = {
    "none": _same, "utf8ToUnicode": _same, "parityEven7bit": _same, "parityOdd7bit": _same, "parityZero7bit": _same,
    "lowercase": F.lower, "uppercase": F.upper,
    "compressWhitespace": lambda v: F.regexp_replace(v, BLANK + "+", " "), "removeWhitespace": lambda v: F.regexp_replace(v, BLANK + "+", ""),
    "removeNulls": lambda v: _replace(v, "\0", ""), "replaceNulls": lambda v: _replace(v, "\0", " "),
    "trim": trim_both, "trimLeft": lambda v: F.regexp_replace(v, rf"\A{BLANK}++", ""), "trimRight": lambda v: F.regexp_replace(v, rf"{BLANK}++\z", ""),
    "normalizePath": normalize_path, "normalizePathWin": lambda v: _replace(normalize_path(v), "/", "\\"),
    "removeComments": lambda v: F.regexp_replace(v, r"(?s)/\*.*?(?:\*/|\z)", ""),
    "replaceComments": lambda v: F.regexp_replace(F.regexp_replace(v, r"(?s)/\*.*?\*/", " "), r"(?s)/\*.*\z", ""),
    "removeCommentsChar": remove_comment_marks, "cmdLine": command_line,
    "urlDecode": url_decode, "urlEncode": url_encode,
    "base64Decode": lambda v: F.coalesce(_base64(v), v),
    "base64DecodeExt": lambda v: F.coalesce(_base64(_url_alphabet(v)), _base64(v), v),
    "base64Encode": lambda v: F.regexp_replace(F.base64(v.cast("binary")), r"[\r\n]", ""),
    "hexDecode": hex_decode, "hexEncode": lambda v: F.lower(F.hex(v)),
    "md5": F.md5, "sha1": F.sha1, "sha256": lambda v: F.sha2(v, 256), "length": lambda v: F.octet_length(v).cast("string"),
}
_PYTHON: dict[str, tuple[Callable[[str], str], str]] = {
    "urlDecodeUni": (py.url_decode_uni, "%"), "jsDecode": (py.js_decode, "\\"), "cssDecode": (py.css_decode, "\\"), "escapeSeqDecode": (py.escape_seq_decode, "\\"),
    "sqlHexDecode": (py.sql_hex_decode, "0x"), "htmlEntityDecode": (py.html_entity_decode, "&"),
}
TRANSFORMATIONS = {
    **{n.lower(): Transformation(n, native=f) for n, f in _NATIVE.items()},
    **{n.lower(): Transformation(n, python=f, sign=sign) for n, (f, sign) in _PYTHON.items()},
}


def register(name: str, native: Callable[[Column], Column] | None = None, python: Callable[[str], str] | None = None) -> None:
    """Adds or replaces a transformation that rules can name: an expression, or a function of one text."""
    if (native is None) == (python is None):
        raise ValueError("give one of native and python")
    TRANSFORMATIONS[name.lower()] = Transformation(name, native, python)


def transformation(name: str) -> Transformation:
    if name.lower() not in TRANSFORMATIONS:
        raise UnknownTransformation(name)
    return TRANSFORMATIONS[name.lower()]


def pipeline(names: list[str]) -> tuple[str, ...]:
    """Names as they apply: ``none`` drops those before it; unknown names raise."""
    out: list[str] = []
    for n in names:
        t = transformation(n)
        out = [] if t.name == "none" else [*out, t.name]
    return tuple(out)


def _mapped(functions: list[Callable[[str], str]], many: bool):
    @F.pandas_udf("array<string>" if many else "string")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(t):
            if t is not None:
                for f in functions:
                    t = f(t)
            return t

        for b in batches:
            yield b.map(lambda x: None if x is None else [one(t) for t in x]) if many else b.map(one)

    return apply


def apply_transformations(v: Column, names: tuple[str, ...], many: bool = False) -> Column:
    """A text column (or, with ``many``, an array of texts) through a pipeline. Runs of Python ones are one Arrow call, which gets only what holds a sign of one."""
    at, steps = 0, [transformation(n) for n in names]
    while at < len(steps):
        run = at
        while run < len(steps) and steps[run].python:
            run += 1
        if run > at:
            signs = {s.sign for s in steps[at:run]}
            told = lambda t: reduce(lambda a, b: a | b, [F.contains(t, F.lit(x)) for x in sorted(signs)])
            send = v if "" in signs else F.when(F.exists(v, told) if many else told(v), v)
            v, at = F.coalesce(_mapped([s.python for s in steps[at:run]], many)(send), v), run
        else:
            f = steps[at].native
            v, at = F.transform(v, f) if many else f(v), at + 1
    return v


def native_only(names: tuple[str, ...]) -> bool:
    return all(transformation(n).native for n in names)
