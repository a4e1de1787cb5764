"""Injection detectors. Cheap tests and patterns are expressions; only texts they leave open go to Arrow functions."""

from __future__ import annotations

import re
from urllib.parse import unquote_to_bytes

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.python_decoders import html_entity_decode
from ..functions.regex import to_java
from ..functions.transformations import url_decode

#: Texts one of which a text must hold (in lower case) to be looked at for SQL.
SQL_HINTS = [
    "'", '"', "--", "/*", "union", "select", " or ", " and ", "1=1", "'='", ";", "exec", "drop", "insert", "update", "delete", "benchmark", "sleep", "waitfor",
]
#: Patterns of SQL injection; any match decides.
SQL_PATTERNS = [
    r"(?i)'\s*(or|and)\s*'", r"(?i)'\s*(or|and)\s+\d", r"(?i)'\s*(or|and)\s+\w+\s*=", r"(?i)\d\s*(or|and)\s+\d\s*=\s*\d", r"(?i)'\s*=\s*'",
    r"(?i)\b1\s*=\s*1\b", r"(?i)\b2\s*=\s*2\b", r"(?i)\bor\s+1\s*=\s*1", r"(?i)\bor\s+'[^']*'\s*=\s*'[^']*'", r"(?i)\bor\s+true\b", r"(?i)\band\s+1\s*=\s*1",
    r"(?i)\bunion\s+(all\s+)?select\b", r"(?i)'\s*union\s+(all\s+)?select\b", r"(?i)\d\s+union\s+(all\s+)?select\b",
    r"(?i)'[^']*--", r"(?i)'[^']*/\*", r"(?i)\d\s*--", r"(?i)--\s*(select|drop|delete|update|insert|union)\b", r"/\*.*\*/",
    r"(?i)';\s*(drop|delete|update|insert|select|exec|execute)\b", r"(?i)\d;\s*(drop|delete|update|insert|select|exec|execute)\b", r"(?i);\s*(drop|delete|truncate)\s+",
    r"(?i)\b(sleep|benchmark|waitfor|delay|pg_sleep)\s*\(", r"(?i)\b(extractvalue|updatexml|xmltype)\s*\(",
    r"(?i)'\s*(select|insert|update|delete|drop|truncate|exec|execute|create|alter)\b", r"(?i)\b(information_schema|sys\.tables|sysobjects)\b",
    r"(?i)'\s*or\s*'", r"(?i)'\s*;\s*--", r"(?i)'\s*(and|or|xor)\s", r"(?i)\d\s+(or|and)\s+",
]
#: Words of SQL.
SQL_KEYWORDS = frozenset([
    "SELECT", "INSERT", "UPDATE", "DELETE", "DROP", "TRUNCATE", "ALTER", "CREATE", "UNION", "FROM", "WHERE", "INTO", "VALUES", "SET", "TABLE",
    "DATABASE", "INDEX", "EXEC", "EXECUTE", "HAVING", "GROUP", "ORDER", "BY", "LIMIT", "OFFSET", "JOIN", "LEFT", "RIGHT", "INNER", "OUTER", "CROSS",
    "NATURAL", "AS", "ON", "USING", "CASE", "WHEN", "THEN", "ELSE", "END", "IF", "WHILE", "DECLARE", "BEGIN", "COMMIT", "ROLLBACK", "GRANT", "REVOKE",
    "NULL", "ALL", "DISTINCT", "EXISTS", "BETWEEN", "IN", "IS", "LIKE", "ESCAPE", "WAITFOR", "DELAY", "SHUTDOWN", "BENCHMARK", "SLEEP", "LOAD_FILE",
    "OUTFILE", "DUMPFILE", "INFORMATION_SCHEMA", "EXTRACTVALUE", "UPDATEXML", "FLOOR", "RAND", "COUNT", "CONCAT", "CHAR", "ASCII", "SUBSTRING",
    "SUBSTR", "MID", "VERSION", "USER", "SCHEMA", "PASSWORD", "MD5", "SHA1", "SHA2", "ENCODE", "DECODE", "HEX", "UNHEX", "CONV", "CONVERT", "CAST",
])
SQL_FUNCTIONS = frozenset([
    "CONCAT", "SUBSTR", "SUBSTRING", "MID", "LENGTH", "LEN", "CHAR", "ASCII", "ORD", "CONV", "HEX", "UNHEX", "BIN", "OCT", "MD5", "SHA1", "SHA2",
    "ENCODE", "DECODE", "COMPRESS", "UNCOMPRESS", "AES_ENCRYPT", "AES_DECRYPT", "PASSWORD", "ENCRYPT", "VERSION", "USER", "DATABASE", "SCHEMA",
    "CURRENT_USER", "SESSION_USER", "SYSTEM_USER", "NOW", "CURDATE", "CURTIME", "UTC_DATE", "UTC_TIME", "SLEEP", "BENCHMARK", "LOAD_FILE",
    "EXTRACTVALUE", "UPDATEXML", "FLOOR", "RAND", "CEIL", "ROUND", "COUNT", "SUM", "AVG", "MIN", "MAX", "GROUP_CONCAT", "COALESCE", "NULLIF",
    "IFNULL", "NVL", "CASE", "IF", "IIF", "CONVERT", "CAST", "TRIM", "LTRIM", "RTRIM", "UPPER", "LOWER", "UCASE", "LCASE", "REPLACE", "REVERSE",
    "INSERT", "INSTR", "LOCATE", "POSITION", "FIND_IN_SET", "FIELD", "ELT", "MAKE_SET", "EXPORT_SET", "REPEAT", "SPACE", "LPAD", "RPAD", "LEFT",
    "RIGHT", "QUOTE", "SOUNDEX", "FORMAT",
])
#: Token fingerprints of injections.
SQL_FINGERPRINTS = frozenset([
    "1&1", "s&s", "1&s", "s&1", "sok", "1ok", "so1", "1o1", "sos", "sks", "1k1", "sk1", "1ks", "1kk", "skk", "Ek", "kk", "kkk", "kks", "kk1", "kkf",
    "kfk", "scs", "1c1", "sc", "1c", "ck", "cs", "c1", "f", "fk", "kf", "fs", "f1", "fEk", "E&E", "Eo", "oE", "EoE", "okk", "ok", "kfE", "fkf",
    "1&1o1", "s&so1", "1&sos", "so1o1", "kf1E",
])
#: Texts one of which a text must hold (ASCII case ignored) to be looked at for scripts.
XSS_HINTS = ["<", "javascript", "vbscript", "on", "eval", "innerhtml", "outerhtml", "document.", "window.", "%3c", "&lt", "\\x3c", "\\u003c"]
#: Patterns of script injection.
XSS_PATTERNS = [
    r"(?i)<script[^>]*>", r"(?i)</script>", r"(?i)\bon\w+\s*=", r"(?i)javascript\s*:", r"(?i)data\s*:\s*text/html", r"(?i)vbscript\s*:",
    r"(?i)expression\s*\(", r"(?i)behavior\s*:", r"(?i)-moz-binding\s*:", r"""(?i)url\s*\(\s*["']?\s*javascript""", r"(?i)@import", r"(?i)<iframe",
    r"(?i)<(?:object|embed|applet)", r"""(?i)<form[^>]*action\s*=\s*["']?\s*javascript""", r"""(?i)<a[^>]*href\s*=\s*["']?\s*javascript""",
    r"""(?i)<meta[^>]*http-equiv\s*=\s*["']?refresh""", r"(?i)<base[^>]*href", r"(?i)fscommand", r"(?i)\beval\s*\(",
    r"""(?i)(?:setTimeout|setInterval)\s*\(\s*["']""", r"(?i)document\s*\.\s*write", r"(?i)\.(?:innerHTML|outerHTML)\s*=",
    r"(?i)document\s*\.\s*location", r"(?i)window\s*\.\s*location", r"(?i)document\s*\.\s*cookie",
]
#: Tags, event handlers and schemes, ASCII case ignored.
XSS_TAGS = [
    "<script", "<iframe", "<object", "<embed", "<applet", "<form", "<input", "<button", "<select", "<textarea", "<link", "<style", "<meta", "<base",
    "<svg", "<math", "<video", "<audio", "<source", "<track", "<canvas", "<frame", "<frameset", "<layer", "<ilayer", "<bgsound", "<isindex",
    "<marquee", "<blink", "<plaintext", "<listing", "<xmp", "<noscript", "<template", "<slot", "<portal", "<img", "<body",
]
XSS_HANDLERS = [
    "onabort=", "onafterprint=", "onanimationend=", "onanimationiteration=", "onanimationstart=", "onbeforeprint=", "onbeforeunload=", "onblur=",
    "oncanplay=", "oncanplaythrough=", "onchange=", "onclick=", "oncontextmenu=", "oncopy=", "oncut=", "ondblclick=", "ondrag=", "ondragend=",
    "ondragenter=", "ondragleave=", "ondragover=", "ondragstart=", "ondrop=", "ondurationchange=", "onemptied=", "onended=", "onerror=", "onfocus=",
    "onfocusin=", "onfocusout=", "onhashchange=", "oninput=", "oninvalid=", "onkeydown=", "onkeypress=", "onkeyup=", "onload=", "onloadeddata=",
    "onloadedmetadata=", "onloadstart=", "onmessage=", "onmousedown=", "onmouseenter=", "onmouseleave=", "onmousemove=", "onmouseout=",
    "onmouseover=", "onmouseup=", "onmousewheel=", "onoffline=", "ononline=", "onopen=", "onpagehide=", "onpageshow=", "onpaste=", "onpause=",
    "onplay=", "onplaying=", "onpopstate=", "onprogress=", "onratechange=", "onreset=", "onresize=", "onscroll=", "onsearch=", "onseeked=",
    "onseeking=", "onselect=", "onshow=", "onstalled=", "onstorage=", "onsubmit=", "onsuspend=", "ontimeupdate=", "ontoggle=", "ontouchcancel=",
    "ontouchend=", "ontouchmove=", "ontouchstart=", "ontransitionend=", "onunload=", "onvolumechange=", "onwaiting=", "onwheel=", "onpointerdown=",
    "onpointermove=", "onpointerup=", "onpointercancel=", "onpointerenter=", "onpointerleave=", "onpointerover=", "onpointerout=",
    "ongotpointercapture=", "onlostpointercapture=", "onbeforeinput=", "onformdata=", "onsecuritypolicyviolation=", "onslotchange=",
    "onvisibilitychange=",
]
XSS_SCHEMES = ["javascript:", "vbscript:", "livescript:", "mocha:"]
#: What is reported of the four kinds of finding.
XSS_KINDS = ["XSS pattern match", "Dangerous HTML tag", "Event handler", "Dangerous URL scheme"]


def _any_of(texts: list[str], ignore_case: bool = True) -> str:
    """One alternation of literal texts for the JVM; without Unicode flags its case folding is ASCII's."""
    return ("(?i)" if ignore_case else "") + "(?:" + "|".join(r"\Q" + t + r"\E" for t in texts) + ")"


def _joined(patterns: list[str]) -> str:
    """One alternation of patterns, each translated with its own flags."""
    return "|".join(f"(?:{to_java(p)})" for p in patterns)


SQL_RX, XSS_RX = _joined(SQL_PATTERNS), _joined(XSS_PATTERNS)


def sqli_hinted(v: Column) -> Column:
    return F.lower(v).rlike(_any_of(SQL_HINTS, False))


def sqli_by_pattern(v: Column) -> Column:
    return v.rlike(SQL_RX)


_SQL_TOKEN = re.compile(
    r"""(?P<s>'(?:\\.|[^'\\]|\\\Z)*(?:'|\Z)|"(?:\\.|[^"\\]|\\\Z)*(?:"|\Z))
      | (?P<c>--[^\n]*|/\*(?:(?!\*/).)*?(?:\*/|(?=.?\Z)))
      | (?P<n>0x[0-9A-Fa-f]*|[0-9][0-9.]*)
      | (?P<w>[A-Za-z_@][A-Za-z0-9_@]*)
      | (?P<o><=|<>|>=|!=|\|\||&&|[=<>!+\-*/%&|^~;])
      | (?P<E>[()])""", re.X | re.S)


def _sql_tokens(text: str) -> list[tuple[str, str]]:
    """(fingerprint letter, value) of every token; other characters are passed over."""
    out = []
    for m in _SQL_TOKEN.finditer(text):
        kind, value = m.lastgroup, m[0]
        if kind == "s":
            body = value[1:-1] if len(value) > 1 and value[-1] == value[0] else value[1:]
            value = re.sub(r"\\(.)", r"\1", body, flags=re.S)
        elif kind == "n":
            kind = "1"
        elif kind == "w":
            up = value.upper()
            kind = "v" if value[0] == "@" else "&" if up in ("AND", "OR", "NOT", "XOR") else "f" if up in SQL_FUNCTIONS else "k" if up in SQL_KEYWORDS else "U"
        out.append((kind, value))
    return out


def sqli_by_tokens(text: str) -> str | None:
    """The fingerprint a hinted text without a pattern is reported with, or None."""
    tokens = _sql_tokens(text)
    print_ = "".join(k for k, _ in tokens)
    if not print_:
        return None
    for size in (2, 3, 4, 5):
        for i in range(len(print_) - size + 1):
            if print_[i : i + size] in SQL_FINGERPRINTS:
                return print_[i : i + size]
    if print_ in SQL_FINGERPRINTS:
        return print_
    words = [v.upper() for _, v in tokens]
    union = any(a == "UNION" and b == "SELECT" for a, b in zip(words, words[1:]))
    same = any(o == ("o", "=") and a == b and a[0] in "1s" for a, o, b in zip(tokens, tokens[1:], tokens[2:]))
    return print_ if union or "ck" in print_ or print_.count("k") >= 3 or same else None


_SQL_HINTS_RE = re.compile("|".join(map(re.escape, SQL_HINTS)))
_SQL_RE = [re.compile(p) for p in SQL_PATTERNS]
_XSS_HINTS_RE = re.compile("(?a:" + "|".join(map(re.escape, XSS_HINTS)) + ")", re.I | re.A)
_XSS_RE = [re.compile(p) for p in XSS_PATTERNS]
_XSS_LISTS = [re.compile("|".join(map(re.escape, x)), re.I | re.A) for x in (XSS_TAGS, XSS_HANDLERS, XSS_SCHEMES)]


def simple_fingerprint(text: str) -> str:
    """Letters for what a text that a pattern decided holds."""
    low = text.lower()
    marks = (("s", ("'", '"')), ("&", ("or", "and")), ("k", ("union", "select")), ("c", ("--", "/*")), ("1", "0123456789"))
    return "".join(c for c, parts in marks if any(p in low for p in parts)) or "sqli"


def sqli_fingerprint(text: str) -> str | None:
    """The fingerprint of a text that is an injection, else None."""
    if not _SQL_HINTS_RE.search(text.lower()):
        return None
    return simple_fingerprint(text) if any(p.search(text) for p in _SQL_RE) else sqli_by_tokens(text)


def is_sqli(text: str) -> bool:
    return sqli_fingerprint(text) is not None


def _xss_plain(text: str) -> str | None:
    if any(p.search(text) for p in _XSS_RE):
        return XSS_KINDS[0]
    return next((k for k, p in zip(XSS_KINDS[1:], _XSS_LISTS) if p.search(text)), None)


def xss_normal(text: str) -> str:
    """Entities and percent codes resolved (codes only if all is UTF-8 then), NULs dropped, blanks in tags and around ``=`` dropped."""
    text = html_entity_decode(text)
    try:
        text = unquote_to_bytes(text).decode("utf-8")
    except UnicodeDecodeError:
        pass
    text = text.replace("\0", "")
    text = re.sub(r"<\s+", "<", text) if "< " in text else text
    return re.sub(r"\s*=\s*", "=", text) if " =" in text or "= " in text else text


def xss_kind(text: str) -> str | None:
    """What kind of script injection a text is, else None."""
    if not _XSS_HINTS_RE.search(text):
        return None
    return _xss_plain(text) or _xss_plain(xss_normal(text))


def is_xss(text: str) -> bool:
    return xss_kind(text) is not None


def xss_hinted(v: Column) -> Column:
    return v.rlike(_any_of(XSS_HINTS))


def xss_by_pattern(v: Column) -> Column:
    return v.rlike(XSS_RX) | v.rlike(_any_of(XSS_TAGS + XSS_HANDLERS + XSS_SCHEMES))


def xss_open(v: Column) -> Column:
    """Whether resolving encodings could still change a text."""
    return v.rlike("[&%\\x00]|< | =|= ")


def _flags(decide, many: bool):
    """Arrow function: a flag for every text (or array of texts), null texts false and null arrays null. Batches of nulls cost next to nothing."""
    @F.arrow_udf(T.ArrayType(T.BooleanType()) if many else T.BooleanType())
    def flags(texts: pa.Array) -> pa.Array:
        one = lambda t: t is not None and decide(t)
        if many:
            kind = pa.list_(pa.bool_())
            return pa.nulls(len(texts), kind) if texts.null_count == len(texts) else pa.array([None if xs is None else [one(x) for x in xs] for xs in texts.to_pylist()], kind)
        return pa.array([False] * len(texts) if texts.null_count == len(texts) else [one(t) for t in texts.to_pylist()], pa.bool_())

    return flags


#: The tokens of ``_SQL_TOKEN`` for the JVM; which kind one is shows in its first characters.
_TOKENS = (
    r"(?s)'(?:\\.|[^'\\]|\\\z)*+(?:'|\z)|\"(?:\\.|[^\"\\]|\\\z)*+(?:\"|\z)|--[^\n]*+|/\*(?:(?!\*/).)*?(?:\*/|(?=.?\z))"
    r"|0x[0-9A-Fa-f]*+|[0-9][0-9.]*+|[A-Za-z_@][A-Za-z0-9_@]*+|<=|<>|>=|!=|\|\||&&|[=<>!+\-*/%&|^~;]|[()]")
#: Fingerprints within a text's, three keywords anywhere; a lone function is the one fingerprint that must be the whole.
_PRINTS = "|".join(sorted(f for f in SQL_FINGERPRINTS if len(f) > 1)) + "|k.*k.*k"


def sqli_by_token_kinds(v: Column) -> Column:
    """Whether ``sqli_by_tokens`` finds anything, as an expression. (A comment before a keyword and an equality of equals are fingerprints too.)"""
    def kind(t: Column) -> Column:
        first, up = F.substr(t, F.lit(1), F.lit(1)), F.upper(t)
        word = F.when(up.isin("AND", "OR", "NOT", "XOR"), "&").when(F.find_in_set(up, F.lit(",".join(sorted(SQL_FUNCTIONS)))) > 0, "f").when(F.find_in_set(up, F.lit(",".join(sorted(SQL_KEYWORDS)))) > 0, "k").otherwise("U")
        return (F.when(first.isin("'", '"'), "s").when(t.startswith("--") | t.startswith("/*"), "c").when(first.between("0", "9"), "1").when(first == "@", "v")
                .when(first.rlike("[A-Za-z_]"), word).when(first.isin("(", ")"), "E").otherwise("o"))

    def bare(t: Column) -> Column:
        return F.upper(F.regexp_replace(F.regexp_replace(t, r"""(?s)\A(?:'(.*?)'?|"(.*?)"?)\z""", "$1$2"), r"(?s)\\(.)", "$1"))

    def judge(tokens: Column) -> Column:
        prints = F.array_join(F.transform(tokens, kind), "")
        at = F.filter(F.transform(tokens, lambda t, i: F.when(bare(t) == "UNION", i)), lambda i: i.isNotNull())
        union = F.exists(at, lambda i: F.coalesce(bare(F.get(tokens, i + 1)) == "SELECT", F.lit(False)))
        return prints.rlike(_PRINTS) | (prints == "f") | union

    return F.exists(F.array(F.regexp_extract_all(v, F.lit(_TOKENS), F.lit(0))), judge)


def sqli_test(v: Column) -> Column:
    """Whether a text is an SQL injection; null for null."""
    return F.when(sqli_hinted(v), F.when(sqli_by_pattern(v), F.lit(True)).otherwise(sqli_by_token_kinds(v))).otherwise(F.lit(False))


def xss_normal_native(v: Column) -> Column:
    """``xss_normal`` of texts without entities."""
    v = F.replace(url_decode(v), F.lit("\0"), F.lit(""))
    v = F.when(F.contains(v, F.lit("< ")), F.regexp_replace(v, r"(?U)<\s+", "<")).otherwise(v)
    return F.when(v.rlike(" =|= "), F.regexp_replace(v, r"(?U)\s*=\s*", "=")).otherwise(v)


def xss_coded(v: Column) -> Column:
    """Whether a text may hold entities, which only Python resolves."""
    return v.rlike("&(?:#[0-9]|#[xX][0-9A-Fa-f]|[A-Za-z])[A-Za-z0-9]*;")


def xss_native(v: Column) -> Column:
    """Whether a text is a script injection as it is or, without entities, in normal form."""
    late = xss_open(v) & ~xss_coded(v)
    return F.when(xss_hinted(v), F.when(xss_by_pattern(v), F.lit(True)).when(late, xss_by_pattern(xss_normal_native(v))).otherwise(F.lit(False))).otherwise(F.lit(False))


def xss_left(v: Column) -> Column:
    """The texts whose entities Python has to resolve, else null."""
    return F.when(xss_coded(v) & xss_hinted(v) & ~xss_by_pattern(v), v)


xss_normal_flag = {m: _flags(lambda t: _xss_plain(xss_normal(t)) is not None, m) for m in (False, True)}


def detect_sqli(v: Column) -> Column:
    """Whether a text column holds SQL injections; null is none."""
    return F.coalesce(sqli_test(v), F.lit(False))


def detect_xss(v: Column) -> Column:
    """Whether a text column holds script injections; null is none."""
    return F.coalesce(xss_native(v), F.lit(False)) | xss_normal_flag[False](xss_left(v))


def detection(v: Column, kind: str) -> Column:
    """struct(is_injection, fingerprint) of a text column, kind ``sqli`` or ``xss``."""
    find = {"sqli": sqli_fingerprint, "xss": xss_kind}[kind]

    @F.pandas_udf("string")
    def fingerprint(b: pd.Series) -> pd.Series:
        return b.map(lambda t: None if t is None else find(t))

    hinted = sqli_hinted(v) if kind == "sqli" else xss_hinted(v)
    got = fingerprint(F.when(hinted, v))
    return F.struct(got.isNotNull().alias("is_injection"), got.alias("fingerprint"))
