"""Decoders that SQL expressions cannot state, as functions of one text. Each works by one regular expression."""

from __future__ import annotations

import re
from html.entities import html5

_HEX = re.compile(r"\+?[0-9A-Fa-f]+\Z")
_PLAIN = {"n": "\n", "r": "\r", "t": "\t", "\\": "\\"}
_JS = {**_PLAIN, '"': '"', "'": "'"}
_C = {**_PLAIN, "0": "\0"}


def _char(digits: str) -> str | None:
    """The character of a hexadecimal number, which may have a plus; None for anything that is no character."""
    if not _HEX.match(digits):
        return None
    n = int(digits, 16)
    return None if n > 0x10FFFF or 0xD800 <= n <= 0xDFFF else chr(n)


def url_decode_uni(text: str) -> str:
    """``%uXXXX`` and ``%XX`` (a Latin-1 character); what follows a percent sign is used up even if it is no number."""
    changed = False

    def put(m: re.Match) -> str:
        nonlocal changed
        wide = m[1] is not None
        got = _char(m[1] if wide else m[2])
        changed |= got is not None
        return got if got is not None else "%" + ("u" if wide else "") + (m[1] if wide else m[2])

    out = re.sub(r"%(?:[uU](.{0,4})|(.{0,2}))", put, text, flags=re.S)
    return out if changed else text


def js_decode(text: str) -> str:
    """Script escapes; ``\\x`` and ``\\u`` use up two and four characters, and come back as they were if those are no number."""
    def put(m: re.Match) -> str:
        for digits in (m[1], m[2]):
            if digits is not None:
                got = _char(digits)
                return m[0] if got is None else got
        return m[0] if m[3] is None else _JS.get(m[3], m[0])

    return re.sub(r"\\(?:x(.{0,2})|u(.{0,4})|(.))?", put, text, flags=re.S)


def escape_seq_decode(text: str) -> str:
    """Escapes of C; a number without digits loses its backslash, unknown escapes keep it."""
    def put(m: re.Match) -> str:
        for letter, digits in (("x", m[1]), ("u", m[2])):
            if digits is not None:
                got = _char(digits)
                return letter + digits if got is None else got
        return _C.get(m[3], m[0])

    return re.sub(r"\\(?:x([0-9A-Fa-f]{0,2})|u([0-9A-Fa-f]{0,4})|(.))", put, text, flags=re.S)


def css_decode(text: str) -> str:
    """A backslash, up to six digits and one blank; what is no character keeps backslash and digits but not the blank."""
    def put(m: re.Match) -> str:
        got = _char(m[1])
        return "\\" + m[1] if got is None else got

    return re.sub(r"\\([0-9A-Fa-f]{0,6})[ \t\n]?", put, text)


def sql_hex_decode(text: str) -> str:
    """``0x`` and digits to Latin-1 characters; an odd last digit is dropped."""
    return re.sub(r"0x([0-9A-Fa-f]*)", lambda m: bytes.fromhex(m[1][: len(m[1]) // 2 * 2]).decode("latin-1"), text)


def html_entity_decode(text: str) -> str:
    """Entities that end in a semicolon: decimal, hexadecimal and named."""
    def put(m: re.Match) -> str:
        name = m[1]
        if name[0] != "#":
            return html5.get(name + ";", m[0])
        try:
            n = int(name[2:], 16) if name[1] in "xX" else int(name[1:])
        except ValueError:
            return m[0]
        return m[0] if n > 0x10FFFF or 0xD800 <= n <= 0xDFFF else chr(n)

    return re.sub(r"&(#[xX][0-9A-Fa-f]+|#[0-9]+|[A-Za-z][A-Za-z0-9]*);", put, text)
