"""Patterns of a linear-time dialect (Unicode classes, no look-around, ``$`` only at the end) as patterns of the JVM's."""

from __future__ import annotations

import re
import warnings
from re import _constants as sre
from re import _parser

#: ASCII classes in brackets.
CLASSES = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": "!-~",
    "lower": "a-z", "print": " -~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r ", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
_PART = re.compile(r"""
    (?P<code>\\(?:x\{[0-9A-Fa-f]+\}|x[0-9A-Fa-f]{2}|u\{[0-9A-Fa-f]+\}|u[0-9A-Fa-f]{4}|U\{[0-9A-Fa-f]+\}|U[0-9A-Fa-f]{8}))
  | (?P<prop>\\[pP](?:\{\^?[^}]*\}|[A-Za-z]))
  | (?P<escape>\\.)
  | (?P<posix>\[:\^?[a-z]+:\])
  | (?P<group>\((?:\?(?:P?<[A-Za-z_][\w.\[\]]*>|[a-zA-Z]*(?:-[a-zA-Z]+)?[:)]|.{0,2}))?)
  | (?P<repeat>(?:[*+?]|\{[0-9]+(?:,[0-9]*)?\})[?+]?)
  | (?P<other>.)""", re.X | re.S)
_ESCAPES = set("dDwWsSbBAztnrfav")


class BadPattern(ValueError):
    """The dialect has no such pattern."""


def to_java(pattern: str) -> str:
    """The same pattern for java.util.regex. Raises BadPattern for what the dialect refuses."""
    if pattern == "":
        raise BadPattern("empty")
    out, depth, names = ["(?dU)"], 0, 0
    swap, multi, stack = False, False, []
    for m in _PART.finditer(pattern):
        kind, s = m.lastgroup, m[0]
        if kind == "code":
            s = r"\x{" + re.sub(r"[^0-9A-Fa-f]", "", s[2:]) + "}"
        elif kind == "prop":
            s = s.replace("{^", "{") if "{^" not in s else ("\\P" if s[1] == "p" else "\\p") + s[2:].replace("{^", "{")
            s = re.sub(r"\{(?:(?:gc|General_Category)=)?([A-Za-z_]+)\}", lambda g: "{" + _property(g[1]) + "}", s)
        elif kind == "escape":
            c = s[1]
            if c.isalnum() and c not in _ESCAPES or c == "\n":
                raise BadPattern(s)
            s = r"\x0B" if c == "v" else s
        elif kind == "posix" and depth:
            name = s[2:-2].lstrip("^")
            if name not in CLASSES:
                raise BadPattern(s)
            s = f"[^{CLASSES[name]}]" if s[2] == "^" else CLASSES[name]
        elif kind == "posix":  # outside a class it is a class of these letters
            s = "[" + re.sub(r"([\[\]])", r"\\\1", s[1:-1]) + "]"
        elif depth:
            s, depth = _in_class(s, depth, pattern, m.start(), out)
        elif kind == "group":
            if re.match(r"\(\?P?<[A-Za-z_]", s):
                names += 1
                stack.append((swap, multi))
                s = f"(?<g{names}x>"
            elif s == "(":
                stack.append((swap, multi))
            elif f := re.fullmatch(r"\(\?([a-zA-Z]*)(?:-([a-zA-Z]+))?([:)])", s):
                if set(f[1] + (f[2] or "")) - set("imsxuU"):
                    raise BadPattern(s)
                if f[3] == ":":
                    stack.append((swap, multi))
                for flags, on in ((f[1], True), (f[2] or "", False)):
                    swap = on if "U" in flags else swap
                    multi = on if "m" in flags else multi
                java = lambda fs: fs.replace("U", "").replace("u", "U")
                plus, minus = java(f[1]), java(f[2] or "")
                s = f"(?{plus}{'-' + minus if minus else ''}{f[3]}" if plus or minus else "(?:" if f[3] == ":" else ""
            else:
                raise BadPattern(s)
        elif kind == "repeat":
            if s.endswith("+") and len(s) > 1:
                raise BadPattern(s)
            if swap:
                s = s[:-1] if s.endswith("?") and len(s) > 1 else s + "?"
        elif s == ")":
            swap, multi = stack.pop() if stack else (swap, multi)
        elif s == "[":
            depth = 1
        elif s == "$" and not multi:
            s = r"\z"
        out.append(s)
    if depth:
        raise BadPattern("open class")
    return "".join(out)


def _property(name: str) -> str:
    """Script and binary properties need a prefix in Java; one- and two-letter categories don't."""
    return name if len(name) <= 2 else "Is" + name


def _in_class(s: str, depth: int, pattern: str, at: int, out: list[str]) -> tuple[str, int]:
    """A part of a character class; parts may be several characters, such as a group opener, that mean themselves here."""
    res = ""
    for i, c in enumerate(s):
        first = i == 0 and (pattern[at - 1] == "[" or pattern[at - 2 : at] == "[^") and out[-1] in ("[", "^")
        if c == "]" and not first:
            depth -= 1
            res += c
        elif c == "[":
            depth += 1
            res += c
        elif c == "]" or c in "#" or (c == " "):
            res += "\\" + c
        else:
            if pattern[at + i : at + i + 2] in ("--", "~~") and pattern[at + i - 1] not in "[^":
                raise BadPattern("class operator")
            res += c
    return res, depth


def compiles(java: str) -> bool:
    """Whether the JVM takes a pattern."""
    from pyspark.errors import IllegalArgumentException
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    try:
        spark._jvm.java.util.regex.Pattern.compile(java)
    except IllegalArgumentException:  # what PatternSyntaxException comes as
        return False
    return True


#: Branches a trie may nest before it ends in a plain alternation, and texts of which an alternation is not divided.
_DEEP, _FEW = 100, 4


def _quoted(text: str) -> str:
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E" if text else ""


def any_of(texts, flags: str = "(?i)") -> str:
    """A pattern of the JVM for texts that hold one of ``texts``, whose ASCII case ``flags`` must ignore.

    It is a trie: at each position a text is compared by halves of the possible next characters, so the
    time hardly grows with the number of texts. What begins with another one is not needed.
    """
    root: dict = {}
    for t in sorted(set(x.translate(_FOLD) for x in texts), key=len):
        node = root
        for c in t:
            if "" in node:
                break
            node = node.setdefault(c, {})
        else:
            node.clear()
            node[""] = {}
    return flags + _branches(root, 0)


_FOLD = {c: c + 32 for c in range(65, 91)}


def _rest(node: dict) -> list[str]:
    """All texts below a node."""
    out, todo = [], [("", node)]
    while todo:
        t, n = todo.pop()
        out += [t] if "" in n else []
        todo += [(t + c, x) for c, x in n.items() if c]
    return out


def _branches(node: dict, deep: int) -> str:
    head = ""
    while len(node) == 1 and "" not in node:
        (c, node), = node.items()
        head += c
    if "" in node:
        return _quoted(head)
    if deep >= _DEEP:
        return _quoted(head) + "(?:" + "|".join(map(_quoted, _rest(node))) + ")"
    return _quoted(head) + _halves(sorted(node.items()), deep)


def _halves(pairs: list[tuple[str, dict]], deep: int) -> str:
    if len(pairs) <= _FEW:
        return "(?:" + "|".join(_branches({c: n}, deep + 1) for c, n in pairs) + ")"
    parts = [pairs[: len(pairs) // 2], pairs[len(pairs) // 2 :]]
    return "(?:" + "|".join(f"(?=[{''.join(rf'\x{{{ord(c):X}}}' for c, _ in p)}]){_halves(p, deep)}" for p in parts) + ")"


#: Shortest text that narrows a search, and most texts of one pattern.
_SHORT, _MANY = 3, 60


def needed(pattern: str) -> frozenset[str] | None:
    """Texts one of which every match of a pattern of the dialect holds, case aside; None if none are known.

    Only patterns that Python reads as the dialect does are looked at: classes within classes and their
    operators, and escapes of other forms, are not.
    """
    if re.search(r"\[[^\]]*\[|&&|~~|--|\\[pPxuUQEzCkKGRXN0-9]|\\[^\x00-\x7F]|\(\?(?:[a-zA-Z-]*[xUuR]|<|P=|P>|#|\(|[=!>|])|\{,", pattern):
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            got = _needed(_parser.parse(pattern))
    except (re.error, Warning, RecursionError, OverflowError):
        return None
    return got if got and len(got) <= _MANY and min(map(len, got)) >= _SHORT else None


def _better(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
    rank = lambda s: (min(map(len, s)), -len(s)) if s else (0, 0)
    return a if rank(a) >= rank(b) else b


def _exact(op, arg) -> frozenset[str] | None:
    """All texts a part matches, if they are few."""
    if op is sre.LITERAL:
        return frozenset([chr(arg)])
    if op is sre.SUBPATTERN:
        return _product(arg[3])
    if op is sre.BRANCH:
        sides = [_product(x) for x in arg[1]]
        return frozenset().union(*sides) if None not in sides and sum(map(len, sides)) <= _MANY else None
    return None


def _product(parts) -> frozenset[str] | None:
    out = frozenset([""])
    for op, arg in parts:
        got = _exact(op, arg)
        if got is None or len(out) * len(got) > _MANY:
            return None
        out = frozenset(a + b for a in out for b in got)
    return out


def _needed(parts) -> frozenset[str] | None:
    best, run = None, frozenset([""])
    for op, arg in parts:
        got = _exact(op, arg)
        if got is not None and len(run) * len(got) <= _MANY:
            run = frozenset(a + b for a in run for b in got)
            continue
        best, run = _better(best, run), got or frozenset([""])
        if op is sre.SUBPATTERN:
            best = _better(best, _needed(arg[3]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
            best = _better(best, _needed(arg[2]))
        elif op is sre.BRANCH:
            sides = [_needed(x) for x in arg[1]]
            if all(sides):
                best = _better(best, frozenset().union(*sides))
    return _better(best, run)
