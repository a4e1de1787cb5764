r"""Splitting fields that pack several values.

A field is a lattice over its atoms, the pieces between punctuation marks outside quotes; a quoted span
is one atom. Every atom may be a value, and so may a span of atoms with the marks between them, if the
column knows it as one. Expectation-maximisation over the whole column learns how often each value
occurs and how often each mark separates; the Viterbi path then gives a field's values.

Which spans a column can know as values follows from counts. A pair of neighbouring atoms is tied if it
has support, occurs more often than its parts would meet by chance, and is more than what its mark does
to any atoms (see ``_tied``). A stretch of tied atoms is a run; runs with support are the spans that get
an edge, of any number of atoms. Outside of runs a lattice has one path, whose posterior is 1, so its
expectations are plain counts, and only runs go through forward-backward, each distinct one once with its
weight. All learnt tables have a size that the support bounds: at most ``1 / SHARE`` pairs, twice as many
atoms, and as many spans.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut as _cut

#: Characters that never separate besides letters, digits and blanks.
NEVER = "-_.:/"
#: Least weight of a pair or span, and least share of the column's pairs. A field that occurs n times weighs the square root of n.
SUPPORT, SHARE = 16.0, 1e-5
#: How many times oftener than by chance a tied pair occurs, and the share of its rarer atom's or its mark's occurrences that ties without more.
TIED, MOST = 2.0, 0.5
#: EM ends when a round changes the log likelihood by less than this share of it.
TOLERANCE = 1e-6
#: Spans of less expected weight than this after EM are no values.
GONE = 1e-3
#: Occurrences a mark is given beforehand on either side.
PRIOR = 0.5

_M = r"[[\p{P}\p{S}\x00-\x08\x0E-\x1B\x7F]&&[^\-_.:/\"'\\]]"
_Q = r"""(?:"(?:[^"\\]++|\\.|"")*+"|'(?:[^'\\]++|\\.|'')*+')"""
#: One atom and the mark after it; loops are possessive, so texts of any length take linear time.
_TOKEN = rf"(?sU)\G(?:\s*+{_Q}\s*+(?={_M})|(?:(?!{_M}).)*+){_M}"
_BLANK = r"(?U)\A\s++|\s++\z"


def _trim(text: Column) -> Column:
    return F.when(text.rlike(r"(?U)\A\s|\s\z"), F.regexp_replace(text, _BLANK, "")).otherwise(text)


def atoms(text: Column) -> Column:
    """array<struct<raw, quoted, val, mark>>: every atom as written, whether it is a quoted span, its value, and the mark after it (the last one's is '').

    Null has null, an empty text one empty atom.
    """
    tokens = F.regexp_extract_all(F.concat(text, F.lit(",")), F.lit(_TOKEN), F.lit(0))
    # Each step is a transform of its own, so that the next uses its result without working it out again.
    cut = F.transform(tokens, lambda t: F.struct(F.substr(t, F.lit(1), F.length(t) - 1).alias("raw"), F.substr(t, F.length(t), F.lit(1)).alias("mark")))
    bare = F.transform(cut, lambda p: F.struct(p["raw"], p["mark"], _trim(p["raw"]).alias("val")))
    first = lambda p: F.substr(p["val"], F.lit(1), F.lit(1))
    known = F.transform(bare, lambda p: F.struct(p["raw"], (first(p).isin("'", '"') & p["val"].rlike(rf"(?s)\A{_Q}\z")).alias("quoted"), p["val"], p["mark"]))

    def inner(p: Column) -> Column:
        body = F.substr(p["val"], F.lit(2), F.length(p["val"]) - 2)
        return F.replace(F.replace(body, F.concat(first(p), first(p)), first(p)), F.concat(F.lit("\\"), first(p)), first(p))

    read = F.transform(known, lambda p: F.struct(p["raw"], p["quoted"], F.when(p["quoted"], inner(p)).otherwise(p["val"]).alias("val"), p["mark"]))
    last = F.transform(F.array(read), lambda ps: F.transform(ps, lambda p, i: F.struct(p["raw"], p["quoted"], p["val"], F.when(i < F.size(ps) - 1, p["mark"]).otherwise("").alias("mark"))))
    return F.get(last, F.lit(0))


@dataclass
class Model:
    """What EM learnt: weights of ``values`` (spans, and the atoms in them), ``total`` of all values, for each mark how often it separated and did not, ``spans`` by their number of atoms."""

    values: dict[str, float] = field(default_factory=dict)
    total: float = 1.0
    apart: dict[str, tuple[float, float]] = field(default_factory=dict)
    spans: dict[int, frozenset[str]] = field(default_factory=dict)
    rounds: int = 0

    def value(self, text: str) -> float:
        return math.log(max(self.values.get(text, 1.0), 1e-300) / self.total)

    def mark(self, char: str) -> tuple[float, float]:
        """Log probabilities that the mark separates and that it belongs to a value."""
        yes, no = self.apart.get(char, (0.0, 0.0))
        p = (yes + PRIOR) / (yes + no + 2 * PRIOR)
        return math.log(p), math.log(1 - p)


Atom = tuple[str, bool, str, str]


def _edges(parts: list[Atom], model: Model, even: bool = False) -> list[list[tuple[int, float, str]]]:
    """edges[j]: (first atom, score, value) of every value that ends with atom j. Its score holds the mark before it; ``even`` scores all paths alike."""
    marks = [(0.0, 0.0) if even else model.mark(p[3]) for p in parts]
    score = (lambda v: 0.0) if even else model.value
    edges = []
    for j, (raw, quoted, val, _) in enumerate(parts):
        before = marks[j - 1][0] if j else 0.0
        own = [(j, score(val) + before, val)]
        if not quoted:
            for n, known in model.spans.items():
                i = j - n + 1
                if i < 0 or any(p[1] for p in parts[i:j]):
                    continue
                text = ("".join(p[0] + p[3] for p in parts[i:j]) + raw).strip()
                if text in known:
                    own.append((i, score(text) + sum(marks[k][1] for k in range(i, j)) + (marks[i - 1][0] if i else 0.0), text))
        edges.append(own)
    return edges


def best(parts: list[Atom], model: Model) -> list[str]:
    """The values of the likeliest split (the Viterbi path), empty ones left out."""
    score, back = [0.0], []
    for own in _edges(parts, model):
        s, i, v = max((score[i] + s, i, v) for i, s, v in own)
        score.append(s)
        back.append((i, v))
    out, j = [], len(parts) - 1
    while j >= 0:
        i, v = back[j]
        if v:
            out.append(v)
        j = i - 1
    return out[::-1]


def expect(parts: list[Atom], weight: float, model: Model, values: dict[str, float], apart: dict[str, list[float]], even: bool = False) -> float:
    """Adds a lattice's expected counts by forward-backward; its weighted log likelihood. ``even`` takes all paths for equally likely."""
    edges, n = _edges(parts, model, even), len(parts)
    fwd = [0.0] * (n + 1)
    for j, own in enumerate(edges):
        terms = [fwd[i] + s for i, s, _ in own]
        top = max(terms)
        fwd[j + 1] = top + math.log(sum(math.exp(t - top) for t in terms))
    bwd = [-math.inf] * n + [0.0]
    for j in range(n - 1, -1, -1):
        for i, s, _ in edges[j]:
            bwd[i] = float(np.logaddexp(bwd[i], bwd[j + 1] + s))
    split = [0.0] * (n - 1)
    for j, own in enumerate(edges):
        for i, s, v in own:
            p = math.exp(min(0.0, fwd[i] + s + bwd[j + 1] - fwd[n]))
            values[v] = values.get(v, 0.0) + weight * p
            if i:
                split[i - 1] += p
    for (_, _, _, m), p in zip(parts, split):
        t = apart.setdefault(m, [0.0, 0.0])
        t[0] += weight * p
        t[1] += weight * max(0.0, 1.0 - p)
    return weight * fwd[n]


_ATOM = "struct<raw:string,quoted:boolean,val:string,mark:string>"


def _tuples(parts) -> list[Atom]:
    return [(p["raw"], p["quoted"], p["val"], p["mark"]) for p in parts]


def _tied(n: float, x: float, y: float, size: float, left: float, right: float, mark: float) -> bool:
    """Whether a pair of weight ``n`` is tied; the others are the weights of its atoms, of all atoms, of its first and its second atom at this mark, and of the mark.

    A pair must occur TIED times as often as its atoms would be neighbours at this mark by their frequency. As
    that holds for any value beside a long one, it must also stand out among the uses of its mark, or make
    up MOST of its rarer atom or of its mark.
    """
    return n >= TIED * x * y * mark / size / size and (n >= TIED * left * right / mark or n >= MOST * min(x, y) or n >= MOST * mark)


def _runs(tied: DataFrame) -> DataFrame:
    """(run, parts, w): every maximal stretch of tied atoms, from (parts, w, at: positions of the first atoms of tied pairs)."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for parts, w, at in zip(b["parts"], b["w"], b["at"]):
                at, start = sorted(at), 0
                for k in range(1, len(at) + 1):
                    if k == len(at) or at[k] != at[k - 1] + 1:
                        own = parts[at[start] : at[k - 1] + 2]
                        text = "".join(p["raw"] + p["mark"] for p in own[:-1]) + own[-1]["raw"]
                        own = [{**p, "mark": p["mark"] if i < len(own) - 1 else ""} for i, p in enumerate(own)]
                        out.append((text.strip(), own, w))
                        start = k
            yield pd.DataFrame(out, columns=["run", "parts", "w"])

    return tied.mapInPandas(cut, f"run string, parts array<{_ATOM}>, w double").groupBy("run").agg(F.any_value("parts").alias("parts"), F.sum("w").alias("w"))


def fit(df: DataFrame, column: str, support: float = SUPPORT, share: float = SHARE) -> Model:
    """Runs EM over all non-null values of ``column`` until the likelihood stays.

    The driver receives marks, at most ``1 / share`` pairs and spans and the atoms in them. An empty
    column, or one without tied pairs, gives a model without spans, in which every mark separates.
    """
    texts = df.select(F.col(column).alias("v")).where(F.col("v").isNotNull()).groupBy("v").count()
    texts = _cut(texts.select(F.sqrt("count").alias("w"), F.explode(F.array(atoms(F.col("v")))).alias("parts")).where(F.size("parts") > 1))
    each = texts.select("w", F.posexplode("parts").alias("at", "p"))
    marks = {r[0]: r[1] for r in each.groupBy("p.mark").agg(F.sum("w")).collect()}
    size = sum(marks.values())
    apart = {m: n for m, n in marks.items() if m}
    total = sum(apart.values())
    if not total:
        return Model()

    def pair(i: Column) -> Column:
        a, b = F.get("parts", i), F.get("parts", i + 1)
        return F.when(~a["quoted"] & ~b["quoted"], F.struct(i.alias("at"), a["val"].alias("x"), a["mark"].alias("m"), b["val"].alias("y"), _trim(F.concat(a["raw"], a["mark"], b["raw"])).alias("pair")))

    pairs = F.array_compact(F.transform(F.sequence(F.lit(0), F.size("parts") - 2), pair))
    least = max(support, share * total)
    paired = texts.select("parts", "w", F.explode(pairs).alias("q")).select("parts", "w", "q.*")
    frequent = paired.groupBy("pair", "x", "m", "y").agg(F.sum("w").alias("n")).where(F.col("n") >= least).collect()
    if not frequent:
        return Model(apart={m: (n, 0.0) for m, n in apart.items()})
    spark = df.sparkSession

    def weigh(rows: DataFrame, wanted: set[tuple[str, str, str]]) -> dict[tuple[str, str, str], float]:
        """Weights of the wanted (kind, a, b) in ``rows``; they are few, as frequent pairs are."""
        few = F.broadcast(spark.createDataFrame(sorted(wanted), "kind string, a string, b string"))
        return {(r.kind, r.a, r.b): r.n for r in rows.join(few, few.columns, "left_semi").groupBy(*few.columns).agg(F.sum("w").alias("n")).collect()}

    def key(kind: str, a: Column, b: Column | None = None) -> Column:
        return F.struct(F.lit(kind).alias("kind"), a.alias("a"), (F.lit("") if b is None else b).alias("b"))

    atom = texts.select("w", F.explode(F.transform("parts", lambda p: key("atom", p["val"]))).alias("k")).select("w", "k.*")
    sides = texts.select("w", F.explode(F.flatten(F.transform(pairs, lambda q: F.array(key("left", q["x"], q["m"]), key("right", q["m"], q["y"]), key("mark", q["m"]))))).alias("k")).select("w", "k.*")
    wanted = {k for r in frequent for k in (("atom", r.x, ""), ("atom", r.y, ""), ("left", r.x, r.m), ("right", r.m, r.y), ("mark", r.m, ""))}
    known = weigh(atom.unionByName(sides), wanted)
    tied = [(r.pair,) for r in frequent if _tied(
        r.n, known["atom", r.x, ""], known["atom", r.y, ""], size, known["left", r.x, r.m], known["right", r.m, r.y], known["mark", r.m, ""])]
    if not tied:
        return Model(apart={m: (n, 0.0) for m, n in apart.items()})
    hit = paired.join(F.broadcast(spark.createDataFrame(tied, "pair string")), "pair", "left_semi")
    runs = _cut(_runs(hit.groupBy("parts", "w").agg(F.collect_set("at").alias("at"))))
    found: dict[int, set[str]] = {}
    for r in runs.where(F.col("w") >= least).select("run", F.size("parts").alias("n")).collect():
        found.setdefault(r.n, set()).add(r.run)
    spans = {n: frozenset(s) for n, s in found.items()}
    if not spans:
        return Model(apart={m: (n, 0.0) for m, n in apart.items()})
    whole = {a: n for (kind, a, _), n in (known | weigh(atom, {("atom", t, "") for s in spans.values() for t in s})).items() if kind == "atom"}
    fixed = fixed_apart = None
    outside, model, last = 0.0, Model(spans=spans), None
    while True:
        got = _expectations(runs, model, even=last is None)
        if fixed is None:  # what lies outside of runs never changes
            fixed = {t: max(0.0, n - got["inside"].get(t, (0.0,))[0]) for t, n in whole.items()}
            fixed_apart = {m: max(0.0, n - sum(got["mark"].get(m, (0.0,)))) for m, n in apart.items()}
            outside = max(0.0, size - sum(n for n, _ in got["inside"].values()))
        values = {t: n for t, (n, _) in got["value"].items()}
        model = Model(
            {t: fixed.get(t, 0.0) + values.get(t, 0.0) for t in fixed.keys() | values.keys()}, outside + sum(values.values()),
            {m: (n + got["mark"].get(m, (0.0, 0.0))[0], got["mark"].get(m, (0.0, 0.0))[1]) for m, n in fixed_apart.items()}, spans, model.rounds + 1)
        likely = got["likely"][""][0]
        if model.rounds > 2 and abs(likely - last) <= TOLERANCE * abs(likely):
            break
        last = likely
    left = {n: frozenset(t for t in s if model.values.get(t, 0.0) - fixed.get(t, 0.0) > GONE) for n, s in spans.items()}
    return Model(model.values, model.total, model.apart, {n: s for n, s in left.items() if s}, model.rounds)


def _expectations(runs: DataFrame, model: Model, even: bool) -> dict[str, dict[str, tuple[float, float]]]:
    """One E-step over all runs: expected weights of ``value`` and ``mark`` (apart, within), the log likelihood ``likely``; with ``even`` also the weights of all atoms ``inside`` runs."""
    shared = runs.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, values, apart, inside, likely = shared.value, {}, {}, {}, 0.0
        for b in batches:
            for parts, w in zip(b["parts"], b["w"]):
                parts = _tuples(parts)
                likely += expect(parts, w, now, values, apart, even)
                for p in parts if even else ():
                    inside[p[2]] = inside.get(p[2], 0.0) + w
        rows = [("value", t, n, 0.0) for t, n in values.items()] + [("mark", m, *n) for m, n in apart.items()] + [("inside", t, n, 0.0) for t, n in inside.items()]
        yield pd.DataFrame([*rows, ("likely", "", likely, 0.0)], columns=["kind", "t", "yes", "no"])

    got = runs.select("parts", "w").mapInPandas(count, "kind string, t string, yes double, no double").groupBy("kind", "t").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).collect()
    shared.unpersist()
    out: dict = {"value": {}, "mark": {}, "inside": {}, "likely": {}}
    for r in got:
        out[r.kind][r.t] = (r.yes, r.no)
    return out


def split_packed(df: DataFrame, column: str, model: Model | None = None, pos: str = "pos", val: str = "val") -> DataFrame:
    """``df`` with one row per value of ``column``: its position from 0 and the value; ``column`` itself is dropped.

    Null, empty and blank fields give no row. Names ``pos`` and ``val`` replace columns of that name.
    Fields without a span the model knows have one path and stay in the JVM.
    """
    model = model or fit(df, column)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<string>")
    def likeliest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        now = shared.value
        for b in batches:
            yield pd.Series([None if parts is None else best(_tuples(parts), now) for parts in b], dtype=object)

    keep = [F.col(f"`{c}`") for c in df.columns if c not in (column, pos, val)]
    rows = df.select(*keep, F.explode(F.array(atoms(F.col(f"`{column}`")))).alias("__parts"))
    values = F.filter(F.transform("__parts", lambda p: p["val"]), lambda v: v != "")
    if model.spans:
        inner = sorted({m for s in model.spans.values() for t in s for m in re.findall(r"[^\w\s]", t)})
        branching = F.exists("__parts", lambda p: p["mark"].isin(inner) & ~p["quoted"])
        rows = rows.withColumn("__best", likeliest(F.when(branching, F.col("__parts"))))
        values = F.coalesce("__best", values)
    return rows.select(*keep, F.posexplode(values).alias(pos, val))


def percent_decode(text: Column) -> Column:
    """Percent-decoding that keeps ``+`` and malformed codes; bytes that are no UTF-8 become U+FFFD."""
    plain = F.replace(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.when(F.contains(text, F.lit("%")), F.coalesce(F.try_url_decode(plain), text)).otherwise(text)


def packed_fields(tx: DataFrame, arguments: list[str], headers: list[str]) -> DataFrame:
    """(tx_id, field, name, packed) of the named query arguments (percent-decoded) and headers (name in lower case)."""
    # Only texts that name an argument are cut at all.
    named = F.col("query_string").rlike("(?:^|&)(?:" + "|".join(map(re.escape, arguments)) + ")=")
    pairs = F.when(named, F.filter(F.split("query_string", "&"), lambda p: F.substring_index(p, "=", 1).isin(arguments) & F.contains(p, F.lit("="))))
    args = F.transform(pairs, lambda p: F.struct(
        F.lit("query_string").alias("field"), F.substring_index(p, "=", 1).alias("name"), percent_decode(F.substr(p, F.instr(p, "=") + 1)).alias("packed")))
    heads = F.transform(
        F.filter("request_headers", lambda h: F.lower(h["name"]).isin(headers)),
        lambda h: F.struct(F.lit("headers").alias("field"), F.lower(h["name"]).alias("name"), h["value"].alias("packed")))
    none = F.expr("cast(array() as array<struct<field:string,name:string,packed:string>>)")
    both = F.concat(F.coalesce(args, none), F.coalesce(heads, none))
    return tx.select("tx_id", F.explode(both).alias("p")).select("tx_id", "p.*").where(F.col("packed").isNotNull())
