r"""SQL that says what decoders and detectors do, written apart from them, to compare their results with.

Each function gives an expression for one over a SQL text ``v``. Texts are cut into tokens, tokens are replaced, and the
results joined; bytes are pairs of hexadecimal digits until the end.
"""

from __future__ import annotations

from html.entities import html5

SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_VALID = (
    "[0-7][0-9A-F]|(?:C[2-9A-F]|D[0-9A-F])[89AB][0-9A-F]|E0[AB][0-9A-F][89AB][0-9A-F]|(?:E[1-9A-CEF][89AB]|ED[89])[0-9A-F][89AB][0-9A-F]"
    "|(?:F0[9AB]|F[1-3][89AB]|F48)[0-9A-F][89AB][0-9A-F][89AB][0-9A-F]")
#: What is left of characters that are cut short; one mark stands for each.
_SHORT = "(?:F0[9AB]|F[1-3][89AB]|F48)[0-9A-F][89AB][0-9A-F]|(?:F0[9AB]|F[1-3][89AB]|F48|E0[AB]|E[1-9A-CEF][89AB]|ED[89])[0-9A-F]"


def _joined(items: str) -> str:
    return f"coalesce(list_aggregate({items}, 'string_agg', ''), '')"


def lossy(hexed: str) -> str:
    """The text of bytes in upper-case hexadecimal digits, with a mark for what is no UTF-8."""
    return _joined(f"list_transform(regexp_extract_all({hexed}, '(?:{_VALID})+|{_SHORT}|..'), lambda b: CASE WHEN regexp_matches(b, '^(?:{_VALID})+$') THEN decode(unhex(b)) ELSE '�' END)")


def body(column: str) -> str:
    return f"coalesce(TRY(decode({column})), {lossy(f'hex({column})')})"


def percent_hex(v: str) -> str:
    """The bytes of a text with its percent codes resolved, in hexadecimal digits."""
    return _joined(f"list_transform(regexp_extract_all({v}, '%[0-9A-Fa-f]{{2}}|[^%]+|%'), lambda t: CASE WHEN len(t) = 3 AND regexp_matches(t, '^%[0-9A-Fa-f]{{2}}$') THEN upper(substr(t, 2)) ELSE hex(encode(t)) END)")


def percent(v: str) -> str:
    return f"CASE WHEN contains({v}, '%') THEN {lossy(percent_hex(v))} ELSE {v} END"


def _char(digits: str) -> str:
    n = f"CAST('0x' || ltrim({digits}, '+') AS INTEGER)"
    return f"(CASE WHEN regexp_matches({digits}, '^\\+?[0-9A-Fa-f]+$') THEN CASE WHEN {n} BETWEEN 55296 AND 57343 OR {n} > 1114111 THEN NULL ELSE chr({n}) END END)"


def _tokens(v: str, pattern: str, result: str) -> str:
    return _joined(f"list_transform(regexp_extract_all({v}, '(?s){pattern}'), lambda t: {result})")


def url_decode_uni(v: str) -> str:
    digits = "CASE WHEN lower(substr(t, 2, 1)) = 'u' THEN substr(t, 3) ELSE substr(t, 2) END"
    one = f"CASE WHEN substr(t, 1, 1) <> '%' THEN t ELSE coalesce({_char(f'({digits})')}, CASE WHEN lower(substr(t, 2, 1)) = 'u' THEN '%u' || substr(t, 3) ELSE t END) END"
    pattern = "%[uU].{0,4}|%.{0,2}|[^%]+"
    changed = f"len(list_filter(regexp_extract_all({v}, '(?s){pattern}'), lambda t: substr(t, 1, 1) = '%' AND {_char(f'({digits})')} IS NOT NULL)) > 0"
    return f"CASE WHEN {v} IS NULL THEN NULL WHEN {changed} THEN {_tokens(v, pattern, one)} ELSE {v} END"


def _escapes(v: str, pattern: str, numbers: str, plain: dict[str, str]) -> str:
    """Numbers as given, letters by ``plain``, other escapes as they are."""
    letters = " ".join(f"WHEN t = '\\{k}' THEN {x}" for k, x in plain.items())
    return f"CASE WHEN {v} IS NULL THEN NULL ELSE {_tokens(v, pattern, f'CASE {numbers} {letters} ELSE t END')} END"


_PLAIN = {"n": "chr(10)", "r": "chr(13)", "t": "chr(9)", "\\": "'\\'"}


def js_decode(v: str) -> str:
    numbers = f"WHEN substr(t, 1, 2) IN ('\\x', '\\u') THEN coalesce({_char('substr(t, 3)')}, t)"
    return _escapes(v, r"\\x.{0,2}|\\u.{0,4}|\\.|\\|[^\\]+", numbers, {**_PLAIN, '"': "'\"'", "''": "''''"})


def escape_seq_decode(v: str) -> str:
    numbers = f"WHEN substr(t, 1, 2) IN ('\\x', '\\u') THEN coalesce({_char('substr(t, 3)')}, substr(t, 2))"
    return _escapes(v, r"\\x[0-9A-Fa-f]{0,2}|\\u[0-9A-Fa-f]{0,4}|\\.|\\|[^\\]+", numbers, {**_PLAIN, "0": "chr(0)"})


def css_decode(v: str) -> str:
    digits = "regexp_extract(t, '[0-9A-Fa-f]+')"
    return f"CASE WHEN {v} IS NULL THEN NULL ELSE {_tokens(v, r'\\[0-9A-Fa-f]{0,6}[ \t\n]?|[^\\]+', f'CASE WHEN substr(t, 1, 1) = chr(92) THEN coalesce({_char(digits)}, chr(92) || {digits}) ELSE t END')} END"


def sql_hex_decode(v: str) -> str:
    pairs = "list_transform(regexp_extract_all(substr(t, 3), '..'), lambda h: chr(CAST('0x' || h AS INTEGER)))"
    return f"CASE WHEN {v} IS NULL THEN NULL ELSE {_tokens(v, '0x[0-9A-Fa-f]*|0|[^0]+', f'CASE WHEN starts_with(t, {chr(39)}0x{chr(39)}) THEN {_joined(pairs)} ELSE t END')} END"


def html_entity_decode(v: str) -> str:
    names = "MAP {" + ", ".join("'{}': '{}'".format(k.replace("'", "''"), x.replace("'", "''")) for k, x in sorted(html5.items()) if k.endswith(";")) + "}"
    point = lambda n: f"(CASE WHEN {n} IS NULL OR {n} > 1114111 OR {n} BETWEEN 55296 AND 57343 THEN NULL ELSE chr(CAST({n} AS INTEGER)) END)"
    one = (
        f"CASE WHEN regexp_matches(t, '^&#[xX].*;$') THEN coalesce({point(chr(40) + 'TRY_CAST(' + chr(39) + '0x' + chr(39) + ' || substr(t, 4, len(t) - 4) AS BIGINT))')}, t) "
        f"WHEN regexp_matches(t, '^&#.*;$') THEN coalesce({point('TRY_CAST(substr(t, 3, len(t) - 3) AS BIGINT)')}, t) WHEN regexp_matches(t, '^&.+;$') THEN coalesce(({names})[substr(t, 2)], t) ELSE t END")
    return f"CASE WHEN {v} IS NULL THEN NULL ELSE {_tokens(v, '&(?:#[xX][0-9A-Fa-f]+|#[0-9]+|[A-Za-z][A-Za-z0-9]*);|&|[^&]+', one)} END"


def hex_decode(v: str) -> str:
    return f"CASE WHEN regexp_matches({v}, '^(?:[+0-9A-Fa-f][0-9A-Fa-f])*$') THEN {lossy(f'upper(replace({v}, {chr(39)}+{chr(39)}, {chr(39)}0{chr(39)}))')} ELSE {v} END"


def _base64(v: str) -> str:
    """Null for what is not the encoder's own writing of some bytes."""
    return f"(CASE WHEN to_base64(TRY(from_base64({v}))) = {v} THEN {lossy(f'hex(TRY(from_base64({v})))')} END)"


def base64_decode(v: str) -> str:
    return f"coalesce({_base64(v)}, {v})"


def base64_decode_ext(v: str) -> str:
    other = _base64(f"translate({v}, '-_', '+/')")
    return f"coalesce(CASE WHEN NOT regexp_matches({v}, '[+/]') THEN {other} END, {_base64(v)}, {v})"


DECODERS = {
    "urlDecodeUni": url_decode_uni, "jsDecode": js_decode, "cssDecode": css_decode, "escapeSeqDecode": escape_seq_decode, "sqlHexDecode": sql_hex_decode,
    "htmlEntityDecode": html_entity_decode, "base64Decode": base64_decode, "base64DecodeExt": base64_decode_ext, "hexDecode": hex_decode,
}
