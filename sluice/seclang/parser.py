"""Rule text to directives.

A line holds a directive and its arguments, bare or quoted; a backslash continues it. Tokens come from
one regular expression, directives from a table of their argument kinds, actions from a table of families.
"""

from __future__ import annotations

import glob
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

from .ast import Action, Directive, Operator, SetVar, Variable
from .errors import InvalidArgument, ParseError, RuleFileError, UnknownAction, UnknownOperator, UnknownVariable

#: Variables that resolve to one text, to named values, or (so far) to nothing.
SCALARS = (
    "REQUEST_URI REQUEST_URI_RAW REQUEST_METHOD REQUEST_PROTOCOL QUERY_STRING REQUEST_FILENAME REQUEST_BODY REQUEST_BODY_LENGTH "
    "RESPONSE_STATUS RESPONSE_BODY RESPONSE_CONTENT_TYPE REMOTE_ADDR REMOTE_PORT SERVER_NAME SERVER_PORT"
).split()
COLLECTIONS = "ARGS ARGS_GET ARGS_POST REQUEST_HEADERS REQUEST_COOKIES RESPONSE_HEADERS TX".split()
EMPTY = (
    "ARGS_NAMES ARGS_GET_NAMES ARGS_POST_NAMES ARGS_COMBINED_SIZE REQUEST_BASENAME REQUEST_LINE REQUEST_HEADERS_NAMES "
    "REQUEST_COOKIES_NAMES RESPONSE_PROTOCOL RESPONSE_HEADERS_NAMES RESPONSE_CONTENT_LENGTH REMOTE_HOST REMOTE_USER SERVER_ADDR "
    "SESSION ENV IP GLOBAL RESOURCE USER GEO MATCHED_VAR MATCHED_VARS MATCHED_VAR_NAME MATCHED_VARS_NAMES TIME TIME_EPOCH TIME_DAY "
    "TIME_HOUR TIME_MIN TIME_SEC TIME_WDAY TIME_MON TIME_YEAR FILES FILES_SIZES FILES_TMPNAMES FILES_COMBINED_SIZE FILES_NAMES "
    "UNIQUE_ID DURATION HIGHEST_SEVERITY STATUS_LINE FULL_REQUEST FULL_REQUEST_LENGTH AUTH_TYPE XML REQBODY_PROCESSOR REQBODY_ERROR "
    "REQBODY_ERROR_MSG REQBODY_PROCESSOR_ERROR REQBODY_PROCESSOR_ERROR_MSG MULTIPART_STRICT_ERROR"
).split()
VARIABLES = {*SCALARS, *COLLECTIONS, *EMPTY}
#: Operators.
OPERATORS = set(
    "rx pm pmfromfile pmf streq contains containsword beginswith endswith within strmatch eq ne gt ge lt le detectsqli detectxss "
    "validateurlencoding validateutf8encoding validatebyterange validatehash validatedtd validateschema verifycc verifyssn verifycpf "
    "ipmatch ipmatchfromfile ipmatchf rbl geolookup gsblookup inspectfile fuzzyhash nomatch unconditionalmatch rsub".split())
#: Names of severities, from 0.
SEVERITIES = "emergency alert critical error warning notice info debug".split()
#: Actions without effect that replace one another, and a rule's logging actions.
PLACEHOLDERS = "setsid setuid deprecatevar exec append prepend proxy pause xmlns".split()
LOGGING = "log nolog auditlog noauditlog sanitisematched sanitizematched".split()
I64, U64, U32, U16, U8 = (-(1 << 63), (1 << 63) - 1), (0, (1 << 64) - 1), (0, (1 << 32) - 1), (0, (1 << 16) - 1), (0, 255)


def whole(text: str | None, limits: tuple[int, int]) -> int | None:
    """The integer a text spells: optional sign, ASCII digits, nothing else, within ``limits``; unsigned ones take no minus."""
    if text is None or not re.fullmatch(r"[+-]?[0-9]+" if limits[0] < 0 else r"\+?[0-9]+", text):
        return None
    n = int(text)
    return n if limits[0] <= n <= limits[1] else None


@dataclass(frozen=True)
class Token:
    """``kind`` is newline, comment, quoted, word or directive."""

    kind: str
    value: str
    line: int
    start: int


_TOKEN = re.compile(
    r"""(?:[ \t]|\\\r?\n)*
    (?:(?P<newline>\n)|(?P<comment>\#[^\n]*\n?)|(?P<quoted>"(?:[^"\\]|\\.)*(?:"|\\?\Z)|'(?:[^'\\]|\\.)*(?:'|\\?\Z))
      |(?P<stray>\\\n?)|(?P<word>[^\s"'\#\\](?:\\\n|[^\s"'\#])*))""",
    re.X | re.S)
_ESCAPE = re.compile(r"\\(\r?\n[ \t]*|\r[ \t]*|.)|\\\Z", re.S)
_KNOWN = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", '"': '"', "'": "'"}


def _unquote(body: str) -> str:
    """Resolves escapes: known ones are replaced, a line end goes with the blanks after it, others keep the backslash."""
    def put(m: re.Match) -> str:
        c = m[1]
        if c is None or c[0] in "\r\n" and c != "r":
            return ""
        return _KNOWN.get(c, "\\" + c)

    return _ESCAPE.sub(put, body)


def tokens(text: str) -> Iterator[Token]:
    """Tokens up to the end, or up to a character no token starts with (such as a bare carriage return)."""
    at, counted, line = 0, 0, 1
    while m := _TOKEN.match(text, at):
        at, kind = m.end(), m.lastgroup
        if kind == "stray":
            continue
        raw, start = m[kind], m.start(kind)
        line, counted = line + text.count("\n", counted, start), start
        if kind == "quoted":
            closed = len(raw) > 1 and raw[-1] == raw[0] and not re.search(r"(?<!\\)(?:\\\\)*\\\Z", raw[1:-1])
            yield Token(kind, _unquote(raw[1:-1] if closed else raw[1:]), line, start)
        elif kind == "word":
            word = raw.replace("\\\n", "")
            first = not text[text.rfind("\n", 0, start) + 1 : start].strip()
            named = word.lower().startswith("sec") or word.lower() == "include"
            yield Token("directive" if first and named else "word", word, line, start)
        else:
            yield Token(kind, "", line, start)


def parse_variables(text: str) -> tuple[Variable, ...]:
    """``A|B:key|!C:x``: an exclusion holds for every variable of the list."""
    parts = [p.strip() for p in text.split("|")]
    excluded = tuple(p[1:] for p in parts if p.startswith("!"))
    out = []
    for p in parts:
        if not p or p[0] == "!":
            continue
        name, colon, selection = p.removeprefix("&").partition(":")
        if name.upper() not in VARIABLES:
            raise UnknownVariable(name)
        is_pattern = len(selection) > 2 and selection[0] == selection[-1] == "/"
        out.append(Variable(name.upper(), selection if colon and not is_pattern else None, selection[1:-1] if is_pattern else None, p[0] == "&", excluded))
    return tuple(out)


def parse_operator(text: str) -> Operator:
    """``!@name argument``; without ``@`` the whole is a regular expression."""
    text = text.strip()
    negated = text.startswith("!")
    text = text[1:].lstrip() if negated else text
    if not text.startswith("@"):
        return Operator("rx", text, negated)
    name, *rest = re.split(r"[ \t\n\f\r]", text[1:], maxsplit=1)
    if name.lower() not in OPERATORS:
        raise UnknownOperator(name)
    return Operator(name.lower(), rest[0].lstrip() if rest else "", negated)


def _setvar(text: str) -> SetVar:
    text = text.strip()

    def named(var: str) -> tuple[str, str]:
        collection, dot, key = var.partition(".")
        return (collection.lower(), key) if dot else ("tx", var)

    if text.startswith("!"):
        return SetVar(*named(text[1:]), "delete")
    var, given, value = text.partition("=")
    if not given:
        return SetVar(*named(var), "set", "1")
    if value[:1] in ("+", "-"):
        n = whole(value[1:], I64)
        n = 1 if n is None else n
        return SetVar(*named(var), "add", n if value[0] == "+" else -n)
    n = whole(value, I64)
    return SetVar(*named(var), "set", value if n is None else str(n))


def _need(name: str, value: object) -> object:
    if value is None:
        raise InvalidArgument(f"{name}: missing or invalid argument")
    return value


def _bare(text: str | None) -> str:
    return (text or "").strip("'\"")


def _severity(text: str | None) -> int | None:
    text = None if text is None else _bare(text)
    n = whole(text, U8)
    return SEVERITIES.index(text.lower()) if n is None and text and text.lower() in SEVERITIES else n


_pair = lambda a: (lambda p: (p[0], p[2]))((a or "").partition("="))
#: Family and reading of the argument, by action.
_ACTIONS = {
    **{n: ("disruptive", lambda a: None) for n in ("deny", "block", "pass", "allow", "drop")},
    "redirect": ("disruptive", lambda a: _need("redirect", a)),
    "chain": ("flow", lambda a: None), "multimatch": ("flow", lambda a: None),
    "skip": ("flow", lambda a: _need("skip", whole(a, U32))), "skipafter": ("flow", lambda a: _need("skipAfter", a)),
    "id": ("metadata", lambda a: str(_need("id", whole(a, U64)))), "phase": ("metadata", lambda a: _need("phase", whole(a, U8))),
    "severity": ("metadata", lambda a: _need("severity", _severity(a))), "status": ("metadata", lambda a: _need("status", whole(a, U16))),
    **{n: ("metadata", lambda a, n=n: _need(n, whole(a, U8))) for n in ("maturity", "accuracy")},
    **{n: ("metadata", _bare) for n in ("msg", "tag", "rev", "ver", "logdata")},
    "setvar": ("data", lambda a: _setvar(_need("setvar", a))), "capture": ("data", lambda a: None),
    "initcol": ("data", lambda a: _pair(_need("initcol", a))), "expirevar": ("data", _pair),
    **{n: ("logging", lambda a: None) for n in (*LOGGING, *PLACEHOLDERS)},
    "ctl": ("control", lambda a: _pair(_need("ctl", a))),
}
_PIECE = re.compile(r"""(?P<quoted>"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))|(?P<open>\()|(?P<close>\))|(?P<comma>,)|[^"'(),]+""", re.S)


def parse_actions(text: str) -> tuple[Action, ...]:
    """A list of ``name`` or ``name:argument``, cut at commas outside quotes and parentheses."""
    text = re.sub(r"\\\r?\n[ \t]*", "", text)
    items, depth = [""], 0
    for m in _PIECE.finditer(text):
        depth = max(0, depth + (m.lastgroup == "open") - (m.lastgroup == "close"))
        if m.lastgroup == "comma" and not depth:
            items.append("")
        else:
            items[-1] += m[0]
    return tuple(_action(i.strip()) for i in items if i.strip())


def _action(text: str) -> Action:
    if text.startswith("t:"):
        return Action("transformation", "t", text[2:])
    name, colon, argument = text.partition(":")
    name = name.lower()
    if name not in _ACTIONS:
        raise UnknownAction(name)
    family, read = _ACTIONS[name]
    return Action(family, name, read(argument if colon else None))


def merge_actions(defaults: tuple[Action, ...], own: tuple[Action, ...]) -> tuple[Action, ...]:
    """Defaults and a rule's own actions, of each slot only the last. Defaults no own action replaces all stay."""
    last = {a.slot: i for i, a in enumerate(own)}
    return tuple(a for a in defaults if a.slot not in last) + tuple(a for i, a in enumerate(own) if last[a.slot] == i)


class Parser:
    """Collects directives of texts and files. Default actions last across files."""

    def __init__(self) -> None:
        self.directives: list[Directive] = []
        self._defaults: tuple[Action, ...] = ()
        self._file: str | None = None

    def text(self, text: str, file: str | None = None) -> Parser:
        self._file = file
        stream = tokens(text)
        for t in stream:
            if t.kind == "directive":
                self.directives.append(self._directive(t, stream, text))
            elif t.kind not in ("comment", "newline"):
                raise ParseError(f"unexpected {t.kind} {t.value!r}", self._file, t.line)
        return self

    def file(self, path: str) -> Parser:
        try:
            with open(path, encoding="utf-8", newline="") as f:
                content = f.read()
        except (OSError, UnicodeDecodeError) as e:
            raise RuleFileError(f"{path}: {e}") from e
        return self.text(content, path)

    def glob(self, pattern: str) -> Parser:
        """All files of a pattern in alphabetical order; none is no error."""
        for path in sorted(glob.glob(pattern, recursive=True)):
            if os.path.isfile(path):
                self.file(path)
        return self

    def _directive(self, at: Token, stream: Iterator[Token], text: str) -> Directive:
        kind, file, line = at.value.lower(), self._file, at.line

        def take(*kinds: str) -> str:
            t = next(stream, None)
            if t is None or t.kind not in kinds:
                raise ParseError(f"{at.value}: expected {' or '.join(kinds)}, got {t.kind if t else 'end of input'}", file, t.line if t else line)
            self._end = t
            return t.value

        if kind == "secrule":
            variables = parse_variables(take("word", "quoted"))
            operator = parse_operator(take("quoted"))
            actions = self._defaults
            if quoted_next(text, self._end):
                actions = merge_actions(self._defaults, parse_actions(take("quoted")))
            return Directive(kind, None, variables, operator, actions, file, line)
        if kind in ("secaction", "secdefaultaction"):
            actions = parse_actions(take("quoted"))
            if kind == "secdefaultaction":
                self._defaults = actions
            return Directive(kind, actions=actions, file=file, line=line)
        if kind in _ARGUMENT:
            return Directive(kind, _ARGUMENT[kind](take("word", "quoted"), file, line), file=file, line=line)
        if kind == "include":
            path = take("word", "quoted")
            beside = os.path.join(os.path.dirname(file), path) if file else path
            path = beside if os.path.exists(beside) else path
            self.glob(path)
            return Directive(kind, path, file=file, line=line)
        for t in stream:  # another Sec line: skipped with its arguments
            if t.kind == "newline":
                break
        return Directive("unknown", at.value, file=file, line=line)


def quoted_next(text: str, after: Token) -> bool:
    """Whether a quoted string follows a quoted token on its (continued) line."""
    m = _TOKEN.match(text, after.start)
    return bool(re.compile(r"(?:[ \t]|\\\r?\n)*[\"']").match(text, m.end()))


def _choice(options: dict[str, object]):
    def read(value: str, file: str | None, line: int) -> object:
        if value.lower() not in options:
            raise ParseError(f"invalid value {value!r}", file, line)
        return options[value.lower()]

    return read


_switch = _choice({"on": True, "off": False})
_ARGUMENT = {
    "secmarker": lambda v, f, n: v,
    "secruleengine": _choice({"on": "On", "off": "Off", "detectiononly": "DetectionOnly"}),
    "secruleremovebyid": lambda v, f, n: tuple(i for i in (whole(x, U64) for x in v.split()) if i is not None),
    "secrequestbodyaccess": _switch, "secresponsebodyaccess": _switch,
}
