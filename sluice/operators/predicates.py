"""Operators of rules as predicates over one text.

``Predicate.test`` is an expression and may stand in a lambda. Operators that need Python for some texts
also have ``many``, which gives the flags of an array of texts outside of lambdas, and ``python``.
"""

from __future__ import annotations

import ipaddress
import json
import os
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.regex import BadPattern, any_of, compiles, needed, to_java
from ..seclang.ast import Operator
from ..seclang.errors import InvalidArgument, RuleFileError, UnknownOperator
from ..seclang.parser import I64, U8, whole
from . import detectors

#: Operators that match nothing (yet); aliases; where phrase files are looked for.
STUBS = "nomatch verifycc verifyssn verifycpf validatehash validatedtd validateschema rbl geolookup gsblookup inspectfile fuzzyhash rsub".split()
ALIASES = {"pmf": "pm", "containsword": "contains", "strmatch": "contains", "ipmatchf": "ipmatch"}
PHRASE_PLACES = ("", "test-rules/crs/rules/", "rules/")


@dataclass(frozen=True)
class Predicate:
    """Never null for texts that aren't. ``constant`` is set where every text gets the same answer.

    ``needs`` are texts one of which any text that satisfies the predicate holds, case aside, if such are known;
    then ``sql`` is the test as SQL text, given the SQL text of what is tested.
    """

    test: Callable[[Column], Column] | None = None
    many: Callable[[Column], Column] | None = None
    single: Callable[[Column], Column] | None = None
    python: Callable[[str], bool] | None = None
    constant: bool | None = None
    needs: frozenset[str] | None = None
    sql: Callable[[str], str] | None = None


def quoted(text: str) -> str:
    """A text as a SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _always(value: bool) -> Predicate:
    return Predicate(lambda v: F.lit(value), constant=value)


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def integer(v: Column) -> Column:
    """The 64-bit integer a text spells (sign and ASCII digits only), else null."""
    return F.when(v.rlike(r"\A[+-]?[0-9]+\z"), v.try_cast("bigint"))


def _lines(path: str, places: tuple[str, ...] = ("",)) -> list[str]:
    for at in places:
        if os.path.isfile(at + path):
            with open(at + path, encoding="utf-8") as f:
                return [x.strip() for x in f if x.strip() and not x.strip().startswith("#")]
    raise RuleFileError(f"{path}: no such file")


def _rx(arg: str) -> Predicate:
    if arg == "":
        raise InvalidArgument("rx: empty pattern")
    try:
        java = to_java(arg)
    except BadPattern:
        return _always(False)
    return Predicate(lambda v: _sure(v.rlike(java)), needs=needed(arg), sql=lambda v: f"{v} RLIKE {quoted(java)}") if compiles(java) else _always(False)


def rx_groups(v: Column, pattern: str) -> Column:
    """Groups of the first match, those that took part; empty without a match or for a pattern the dialect refuses."""
    import re

    none = F.expr("cast(array() as array<string>)")
    try:
        java = to_java(pattern)
    except BadPattern:
        return none
    n = len(re.findall(r"(?<!\\)\((?!\?)|\(\?<g\d+x>", re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]", "", java)))
    if not n:
        return none
    part = lambda i: F.when(v.rlike(java), F.regexp_extract(v, java, i))
    return F.filter(F.array(*[part(i) for i in range(1, n + 1)]), lambda g: g.isNotNull() & (g != ""))


def _phrases(phrases: list[str]) -> Predicate:
    if not phrases:
        raise InvalidArgument("pm: no phrases")
    pattern = any_of(phrases)
    return Predicate(lambda v: _sure(v.rlike(pattern)), needs=frozenset(phrases), sql=lambda v: f"{v} RLIKE {quoted(pattern)}")


def _literal(test: Callable[[Column], Column], texts: list[str], sql: Callable[[str, str], str]) -> Predicate:
    given = ", ".join(map(quoted, texts))
    return Predicate(test, needs=frozenset(texts) if all(texts) else None, sql=lambda v: sql(v, given))


def _compare(arg: str, by: Callable[[Column, int], Column]) -> Predicate:
    n = whole(arg, I64)
    return _always(False) if n is None else Predicate(lambda v: _sure(by(integer(v), n)))


def _differs(arg: str) -> Predicate:
    n = whole(arg, I64)
    if n is None:
        return Predicate(lambda v: v != arg)
    return Predicate(lambda v: F.coalesce(integer(v) != n, v != arg))


def _byte_range(arg: str) -> Predicate:
    ok = set()
    for part in map(str.strip, arg.split(",")):
        ends = [whole(x, U8) for x in part.split("-")]
        if len(ends) <= 2 and None not in ends:
            ok.update(range(ends[0], ends[-1] + 1))
    bad = "[^" + "".join(f"\\x{b:02X}" for b in sorted(ok)) + "]" if ok else r"(?s)."
    return Predicate(lambda v: _sure(F.decode(v.cast("binary"), "ISO-8859-1").rlike(bad)))


def _networks(items: list[str]) -> list:
    try:
        return [ipaddress.ip_network(x, strict=False) for x in items]
    except ValueError as e:
        raise InvalidArgument(f"ipMatch: {e}") from e


def ipv4(v: Column) -> Column:
    """The number of a dotted-quad address without leading zeros, else null."""
    octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    part = lambda i: F.get(F.split(v, r"\."), F.lit(i)).try_cast("bigint")
    return F.when(v.rlike(rf"\A{octet}(?:\.{octet}){{3}}\z"), ((part(0) * 256 + part(1)) * 256 + part(2)) * 256 + part(3))


#: Ranges that are compared one after another; more are searched by halves.
FEW_RANGES = 8


def in_ranges(a: Column, ranges: list[tuple[int, int]]) -> Column:
    """Whether a number lies in one of disjoint, sorted ranges; null for null. The plan holds two literal arrays, however many ranges there are."""
    if len(ranges) <= FEW_RANGES:
        return reduce(lambda x, r: x | a.between(*r), ranges, F.lit(False))
    first, last = (F.from_json(F.lit(json.dumps([r[i] for r in ranges])), "array<bigint>") for i in (0, 1))
    steps = F.array(*[F.lit(i) for i in range(len(ranges).bit_length())])

    def half(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        right = F.get(first, mid) <= a
        return F.struct(F.when(right & (s["lo"] < s["hi"]), mid + 1).otherwise(s["lo"]).alias("lo"), F.when(right, s["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(ranges)).alias("hi"))
    return F.when(a.isNotNull(), F.aggregate(steps, start, half, lambda s: F.coalesce(F.get(last, s["lo"] - 1) >= a, F.lit(False))))


def _ip(items: list[str]) -> Predicate:
    nets = _networks(items)
    # Ranges of each version, sorted and disjoint.
    ranges = {v: [(int(n.network_address), int(n.broadcast_address)) for n in ipaddress.collapse_addresses(n for n in nets if n.version == v)] for v in (4, 6)}
    if not ranges[6]:
        return Predicate(lambda v: _sure(F.exists(F.array(ipv4(v)), lambda a: _sure(in_ranges(a, ranges[4]))))) if ranges[4] else _always(False)
    starts = {v: [r[0] for r in own] for v, own in ranges.items()}

    def python(text: str) -> bool:
        try:
            a = ipaddress.ip_address(text)
        except ValueError:
            return False
        at = bisect_right(starts[a.version], int(a)) - 1
        return "%" not in text and at >= 0 and int(a) <= ranges[a.version][at][1]

    flags = {m: detectors._flags(python, m) for m in (False, True)}
    return Predicate(single=lambda v: flags[False](v), many=lambda vs: flags[True](vs), python=python)


def _xss() -> Predicate:
    """Over arrays, Python is asked only where a text with entities is left, and gets the other texts as null."""
    def many(vs: Column) -> Column:
        left = F.transform(vs, detectors.xss_left)
        late = detectors.xss_normal_flag[True](F.when(F.exists(left, lambda v: v.isNotNull()), left))
        return F.zip_with(vs, F.coalesce(late, F.transform(vs, lambda v: F.lit(False))), lambda v, f: detectors.xss_native(v) | F.coalesce(f, F.lit(False)))

    return Predicate(single=detectors.detect_xss, many=many, python=detectors.is_xss)


_SQLI, _XSS = Predicate(lambda v: _sure(detectors.sqli_test(v)), python=detectors.is_sqli), _xss()

_BUILD: dict[str, Callable[[str], Predicate]] = {
    "rx": _rx, "pm": lambda a: _phrases(a.split()), "pmfromfile": lambda a: _phrases(_lines(a, PHRASE_PLACES)),
    "contains": lambda a: _literal(lambda v: F.contains(v, F.lit(a)), [a], "contains({}, {})".format), "beginswith": lambda a: _literal(lambda v: v.startswith(a), [a], "startswith({}, {})".format),
    "endswith": lambda a: _literal(lambda v: v.endswith(a), [a], "endswith({}, {})".format), "streq": lambda a: _literal(lambda v: v == a, [a], "{} = {}".format),
    "within": lambda a: _literal(lambda v: v.isin(a.split()), a.split(), "{} IN ({})".format) if a.split() else _always(False),
    "eq": lambda a: _compare(a, lambda v, n: v == n), "gt": lambda a: _compare(a, lambda v, n: v > n), "lt": lambda a: _compare(a, lambda v, n: v < n),
    "ge": lambda a: _compare(a, lambda v, n: v >= n), "le": lambda a: _compare(a, lambda v, n: v <= n), "ne": _differs,
    "detectsqli": lambda a: _SQLI, "detectxss": lambda a: _XSS,
    "validateurlencoding": lambda a: Predicate(lambda v: v.rlike("%(?![0-9A-Fa-f]{2})")),
    "validateutf8encoding": lambda a: Predicate(lambda v: F.contains(v, F.lit("\0"))),
    "validatebyterange": _byte_range, "ipmatch": lambda a: _ip(a.split()), "ipmatchfromfile": lambda a: _ip(_lines(a)),
    "unconditionalmatch": lambda a: _always(True), **{s: lambda a: _always(False) for s in STUBS},
}


def register(name: str, build: Callable[[str], Predicate]) -> None:
    """Adds or replaces an operator rules can name: ``build`` makes a predicate of its argument."""
    from ..seclang import parser

    parser.OPERATORS.add(name.lower())
    _BUILD[name.lower()] = build
    _built.cache_clear()


@lru_cache(maxsize=10_000)
def _built(name: str, argument: str) -> Predicate:
    return _BUILD[name](argument)


def predicate(op: Operator) -> Predicate:
    """The predicate of an operator, negation aside. Raises for unusable arguments. Those of files are read again each time."""
    name = ALIASES.get(op.name, op.name)
    if name not in _BUILD:
        raise UnknownOperator(op.name)
    return _BUILD[name](op.argument) if name.endswith("fromfile") else _built(name, op.argument)


def check(op: Operator) -> None:
    """Raises if an operator's argument can't be used; patterns the dialect refuses are usable and never match."""
    if op.name == "rx":
        if op.argument == "":
            raise InvalidArgument("rx: empty pattern")
    else:
        predicate(op)


def test(op: Operator, v: Column) -> Column:
    """Whether a text column satisfies an operator, negation included; null satisfies none."""
    p = predicate(op)
    hit = p.test(v) if p.test else p.single(v)
    return F.coalesce(v.isNotNull() & (~hit if op.negated else hit), F.lit(False))
