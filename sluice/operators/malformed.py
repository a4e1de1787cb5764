"""Loading delimited records strictly and telling why the others fail.

Record offsets (ids) are kept, only conforming rows are loaded, the loaded offsets are subtracted from
the raw ones by an anti-join, and only the remainder is diagnosed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut

#: Separators by name, and the directives a source location may carry.
SEPARATORS = {"comma": ",", "semicolon": ";", "tab": "\t", "pipe": "|"}
DIRECTIVES = ["SecRule", "SecAction", "SecMarker", "SecRuleEngine", "SecDefaultAction", "SecRuleRemoveById", "Include"]


@dataclass(frozen=True)
class Layout:
    """Columns of the raw table."""

    offset: str = "record_id"
    sep: str = "sep"
    text: str = "line_text"


def _field_pattern(sep: str) -> str:
    """One field and its separator, anchored where the last one ended. All loops are possessive: linear, and no deep recursion on long texts."""
    s, blank = re.escape(sep), " " if sep == "\t" else r" \t"
    quoted = rf'[{blank}]*+"(?:[^"]++|"")*+"[{blank}]*+'
    return rf'\G({quoted}(?={s})|[^{s}"]*+){s}'


def _line(text: Column) -> Column:
    """The text without one carriage return at its end; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\z", "")


def _raw_fields(text: Column, sep: Column) -> Column:
    """Fields as written. Shorter than the line if its quoting breaks; one field if the separator is unknown or null."""
    found = None
    for name, char in SEPARATORS.items():
        got = F.regexp_extract_all(F.concat(text, F.lit(char)), F.lit(_field_pattern(char)), F.lit(1))
        found = F.when(sep == name, got) if found is None else found.when(sep == name, got)
    return found.otherwise(F.array(text))


def _covered(fields: Column) -> Column:
    return F.aggregate(fields, F.lit(0), lambda n, f: n + F.length(f) + 1)


def _clean(field: Column) -> Column:
    bare = F.trim(field, F.lit(" \t"))
    return F.when(bare.startswith('"') & (F.length(bare) >= 2), F.replace(F.substr(bare, F.lit(2), F.length(bare) - 2), F.lit('""'), F.lit('"'))).otherwise(bare)


def _whole(field: Column) -> Column:
    """The integer in 1..2147483647 written in digits 0-9, else null."""
    digits = F.regexp_replace(field, r"\A0+(?=[0-9])", "")
    n = F.when(field.rlike(r"\A[0-9]+\z") & (F.length(digits) <= 10), digits.try_cast("bigint"))
    return F.when(n.between(1, 2147483647), n.cast("int"))


def _part(f: Column, i: int) -> Column:
    return F.get(f, F.lit(i))


def _values_ok(f: Column) -> Column:
    file, rule = _part(f, 0), _part(f, 4)
    return F.coalesce(
        ((file == "") | file.endswith(".conf")) & _whole(_part(f, 1)).isNotNull() & _whole(_part(f, 2)).isNotNull()
        & F.lower(_part(f, 3)).isin([d.lower() for d in DIRECTIVES]) & rule.rlike(r"\A[0-9]*\z"),
        F.lit(False),
    )


def _judged(df: DataFrame, at: Layout) -> Column:
    """One-element array of struct(f, reason). Steps are bound by lambdas and the caller explodes it, so each runs once a row."""
    line = _line(df[at.text])
    cut = F.transform(F.array(_raw_fields(line, df[at.sep])), lambda raw: F.struct(
        (_covered(raw) == F.length(line) + 1).alias("whole"), F.transform(raw, _clean).alias("f")))
    return F.transform(cut, lambda p: F.struct(
        p["f"].alias("f"),
        F.when(~p["whole"], "quoting").when(F.size(p["f"]) != 6, "column_count").when(~_values_ok(p["f"]), "value").alias("reason")))


def strict_load(df: DataFrame, at: Layout = Layout()) -> DataFrame:
    """Only the conforming rows, typed: (record offset, file, line, col, directive, rule_id, note); '' is read as null for file and rule id.

    Rows of any other kind, null texts and unknown separators included, are not loaded.
    """
    good = df.select(F.col(at.offset), F.explode(F.filter(_judged(df, at), lambda p: p["reason"].isNull())).alias("p"))
    part = lambda i: _part(F.col("p.f"), i)
    empty = lambda c: F.when(c != "", c)
    return good.select(
        at.offset, empty(part(0)).alias("file"), _whole(part(1)).alias("line"), _whole(part(2)).alias("col"),
        part(3).alias("directive"), empty(part(4)).alias("rule_id"), part(5).alias("note"),
    )


#: Most rejected offsets that are broadcast to fetch their texts (8 bytes each); more meet their texts by shuffle.
BROADCAST_REJECTED = 2_000_000


def rejected(df: DataFrame, at: Layout = Layout()) -> DataFrame:
    """(record offset, reason) of every row that ``strict_load`` leaves out: ``quoting``, ``column_count`` or ``value``, the first that applies.

    Offsets must be unique. A null offset matches no loaded row, so such rows are diagnosed themselves
    and left out if they turn out good. A null or empty text, and an unknown separator, is ``column_count``.
    Only offsets are shuffled for the anti-join; texts are read again for the rejected ones.
    """
    offset = F.col(at.offset)
    rows = df.select(at.offset, at.sep, at.text)
    left = cut(rows.select(at.offset).where(offset.isNotNull()).join(strict_load(df, at).select(at.offset), at.offset, "left_anti"))
    few = left.count() <= BROADCAST_REJECTED
    rest = rows.join(F.broadcast(left) if few else left, at.offset, "left_semi").unionByName(rows.where(offset.isNull()))
    return rest.select(at.offset, F.explode(F.filter(_judged(rest, at), lambda p: p["reason"].isNotNull())).alias("p")).select(at.offset, "p.reason")
