"""SQL that says what the injection detectors find, written apart from them; the fixed values are theirs."""

from __future__ import annotations

from ..operators import detectors
from .decoder_sql import SPACE, html_entity_decode, percent_hex

_TOKEN = (
    r"""(?s)'(?:\\.|[^'\\]|\\\z)*(?:'|\z)|"(?:\\.|[^"\\]|\\\z)*(?:"|\z)|--[^\n]*|/\*.*?\*/|/\*.*|0x[0-9A-Fa-f]*|[0-9][0-9.]*|[A-Za-z_@][A-Za-z0-9_@]*"""
    r"""|<=|<>|>=|!=|\|\||&&|[=<>!+\-*/%&|^~;]|[()]""")


def _text(t: str) -> str:
    return "'" + t.replace("'", "''") + "'"


def _list(texts) -> str:
    return "(" + ", ".join(_text(t) for t in sorted(texts)) + ")"


def _holds(v: str, texts: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({v}), {_text(t)})" for t in texts) + ")"


def _matches(v: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({v}, {_text(p)})" for p in patterns) + ")"


#: The letter of one character; of a comment that is not closed, the last character is a token of its own.
_LAST = (
    "CASE WHEN len(t) < 3 THEN '' WHEN t[-1] IN ('''', '\"') THEN 's' WHEN t[-1] BETWEEN '0' AND '9' THEN '1' WHEN regexp_matches(t[-1], '[A-Za-z_]') THEN 'U' WHEN t[-1] = '@' THEN 'v' "
    "WHEN t[-1] IN ('(', ')') THEN 'E' WHEN regexp_matches(t[-1], '[-=<>!+*/%&|^~;]') THEN 'o' ELSE '' END")
_KIND = (
    f"CASE WHEN t[1] IN ('''', '\"') THEN 's' WHEN starts_with(t, '--') OR starts_with(t, '/*') AND len(t) > 3 AND suffix(t, '*/') THEN 'c' WHEN starts_with(t, '/*') THEN 'c' || {_LAST} "
    f"WHEN t[1] BETWEEN '0' AND '9' THEN '1' WHEN t[1] = '@' THEN 'v' WHEN t[1] IN ('(', ')') THEN 'E' WHEN NOT regexp_matches(t[1], '[A-Za-z_]') THEN 'o' "
    f"WHEN upper(t) IN ('AND', 'OR', 'NOT', 'XOR') THEN '&' WHEN upper(t) IN {_list(detectors.SQL_FUNCTIONS)} THEN 'f' WHEN upper(t) IN {_list(detectors.SQL_KEYWORDS)} THEN 'k' ELSE 'U' END")
_BODY = r"""CASE WHEN t[1] IN ('''', '"') THEN regexp_replace(CASE WHEN len(t) > 1 AND t[-1] = t[1] THEN t[2:-2] ELSE t[2:] END, '(?s)\\(.)', '\1', 'g') ELSE t END"""
_PRINTS = _list(detectors.SQL_FINGERPRINTS)
_PARTS = " || ".join(f"list_filter(list_transform(range(1, len(kinds) - {n - 2}), lambda i: substr(kinds, i, {n})), lambda x: x IN {_PRINTS})" for n in (2, 3, 4, 5))
_SIMPLE = (
    "CASE WHEN contains(v, '''') OR contains(v, '\"') THEN 's' ELSE '' END || CASE WHEN contains(lower(v), 'or') OR contains(lower(v), 'and') THEN '&' ELSE '' END || "
    "CASE WHEN contains(lower(v), 'union') OR contains(lower(v), 'select') THEN 'k' ELSE '' END || CASE WHEN contains(v, '--') OR contains(v, '/*') THEN 'c' ELSE '' END || "
    "CASE WHEN regexp_matches(v, '[0-9]') THEN '1' ELSE '' END")


def sqli(source: str) -> str:
    """``source`` (with v) and the column sqli: the fingerprint of an SQL injection, or null."""
    union = "len(list_filter(range(1, len(words)), lambda i: words[i] = 'UNION' AND words[i + 1] = 'SELECT')) > 0"
    return (
        f"SELECT * EXCLUDE (kinds, words, hinted), CASE WHEN NOT hinted THEN NULL WHEN {_matches('v', detectors.SQL_PATTERNS)} THEN coalesce(nullif({_SIMPLE}, ''), 'sqli') WHEN kinds = '' THEN NULL "
        f"ELSE coalesce(({_PARTS})[1], CASE WHEN kinds IN {_PRINTS} OR {union} OR contains(kinds, 'ck') OR len(kinds) - len(replace(kinds, 'k', '')) >= 3 THEN kinds END) END AS sqli "
        f"FROM (SELECT *, {_holds('v', detectors.SQL_HINTS)} AS hinted, coalesce(list_aggregate(list_transform(regexp_extract_all(v, {_text(_TOKEN)}), lambda t: {_KIND}), 'string_agg', ''), '') AS kinds, "
        f"list_transform(regexp_extract_all(v, {_text(_TOKEN)}), lambda t: upper({_BODY})) AS words FROM ({source}))")


def _plain(v: str) -> str:
    names = [f"WHEN {_holds(v, texts)} THEN {_text(kind)}" for kind, texts in zip(detectors.XSS_KINDS[1:], (detectors.XSS_TAGS, detectors.XSS_HANDLERS, detectors.XSS_SCHEMES))]
    return f"CASE WHEN {_matches(v, detectors.XSS_PATTERNS)} THEN {_text(detectors.XSS_KINDS[0])} {' '.join(names)} END"


def xss(source: str) -> str:
    """``source`` (with v) and the column xss: the kind of a script injection, or null."""
    return (
        f"SELECT * EXCLUDE (a, b, c, e), CASE WHEN {_holds('v', detectors.XSS_HINTS)} THEN coalesce({_plain('v')}, {_plain('e')}) END AS xss FROM ("
        f"SELECT *, CASE WHEN contains(c, ' =') OR contains(c, '= ') THEN regexp_replace(c, '{SPACE}*={SPACE}*', '=', 'g') ELSE c END AS e FROM ("
        f"SELECT *, CASE WHEN contains(b, '< ') THEN regexp_replace(b, '<{SPACE}+', '<', 'g') ELSE b END AS c FROM ("
        f"SELECT *, replace(coalesce(TRY(decode(unhex({percent_hex('a')}))), a), chr(0), '') AS b FROM (SELECT *, {html_entity_decode('v')} AS a FROM ({source})))))")
