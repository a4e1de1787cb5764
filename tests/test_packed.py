import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.operators import packed
from sluice.operators.packed import Model, atoms, best, fit, packed_fields, percent_decode, split_packed


def read(spark, texts):
    """[(values of atoms, marks, quoted)] of texts."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
    rows = {r.i: r.p for r in df.select("i", atoms(F.col("v")).alias("p")).collect()}
    return [None if rows[i] is None else ([p.raw for p in rows[i]], [p.val for p in rows[i]], "".join(p.mark for p in rows[i])) for i in range(len(texts))]


def slow(text):
    """Values and marks read by a character loop."""
    mark = lambda c: not (c.isalnum() or c.isspace() or c in "_-.:/\"'\\") and unicodedata.category(c)[0] in "PS"
    vals, marks, at = [], "", 0
    while True:
        start = at
        while start < len(text) and text[start].isspace():
            start += 1
        end = None
        if start < len(text) and text[start] in "\"'":
            q, k, body = text[start], start + 1, ""
            while k < len(text):
                if text[k] == "\\" and k + 1 < len(text):
                    body, k = body + text[k : k + 2], k + 2
                elif text[k : k + 2] == q * 2:
                    body, k = body + q * 2, k + 2
                elif text[k] == q:
                    k += 1
                    while k < len(text) and text[k].isspace():
                        k += 1
                    if k == len(text) or mark(text[k]):
                        end = k
                    break
                else:
                    body, k = body + text[k], k + 1
        if end is not None:
            vals.append(body.replace(q * 2, q).replace("\\" + q, q))
            at = end
        else:
            while at < len(text) and not mark(text[at]):
                at += 1
            vals.append(text[start:at].strip())
        if at >= len(text):
            return vals, marks
        marks += text[at]
        at += 1


def test_atoms(spark):
    cases = [("a,b", ["a", "b"], ","), ("a , 'b,c' ;d", ["a", "b,c", "d"], ",;"), ('"x ""y"""|z', ['x "y"', "z"], "|"), ("pine's, x", ["pine's", "x"], ","), ("a-b_c.d:e/f", ["a-b_c.d:e/f"], ""), ("", [""], ""),
             ("'open,b", ["'open", "b"], ","), ('"a"b,c', ['"a"b', "c"], ","), ("é؛b", ["é", "b"], "؛"), ("á,b", ["á", "b"], ","), ("a,", ["a", ""], ","), (" ,", ["", ""], ",")]
    got = read(spark, [c[0] for c in cases])
    assert [(v, m) for _, v, m in got] == [(v, m) for _, v, m in cases]
    assert read(spark, [None]) == [None]


def test_atoms_as_a_character_loop_reads_them(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab'\"\\,; &é٪") for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    for t, (raw, vals, marks) in zip(texts, read(spark, texts)):
        assert (vals, marks) == slow(t), t
        assert "".join(r + m for r, m in zip(raw, marks)) + raw[-1] == t


def split(spark, texts, model):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
    got = {}
    for r in split_packed(df, "v", model).collect():
        got.setdefault(r.i, []).append((r.pos, r.val))
    return [[v for _, v in sorted(got.get(i, []))] for i in range(len(texts))]


def test_best_without_training(spark):
    cases = [("a,b;c", ["a", "b", "c"]), (" a , , b,", ["a", "b"]), ('"x, ""y""",z', ['x, "y"', "z"]), ("'it''s; ok'|\"p's\"", ["it's; ok", "p's"]), ('"a \\"b\\" c"', ['a "b" c']), ("", []), ("  ", []),
             ("one", ["one"]), ('"one, two"', ["one, two"]), ("a b:1/2,c", ["a b:1/2", "c"]), ('""', []), ("'\\' ;'", ["' ;"])]
    assert split(spark, [c[0] for c in cases], Model()) == [c[1] for c in cases]


WORDS = ["amber", "basalt", "cobalt", "dune"]


@pytest.mark.parametrize("words, single", [
    ([*WORDS, "r&d", "q&a", "onyx"], False), (["x", "y", "z", "a+b"], False), (["x", "y", "z", "a+b"], True), (["x", "y", "z", "c++", "x+y"], False), ([*WORDS, "a+b+c+d+e"], False), ([*WORDS, "a+b + c+d+e+f"], False), (["x", "y"], False)])
def test_marks_inside_values_are_learnt(spark, words, single):
    """A mark that only stands between parts of the same values stays inside them, however many; real separators are found. All by default parameters."""
    rng = np.random.default_rng(3)
    truth = [list(map(str, rng.choice(words, 1 if single else rng.integers(1, 6)))) for _ in range(3000)]
    rows = [(i, ",;|"[i % 3].join(t)) for i, t in enumerate(truth)]
    df = spark.createDataFrame(rows, "tx_id int, v string").repartition(3)
    model = fit(df, "v")
    assert {t for s in model.spans.values() for t in s} == {w for w in words if re.search(r"[&+]", w)}
    assert split(spark, [t for _, t in rows], model) == truth
    if words[-1] == "onyx":
        assert model.rounds > 2 and model.mark("&")[1] > model.mark("&")[0] and model.mark(",")[0] > -0.1
        again = fit(df.repartition(5), "v")
        assert again.spans == model.spans and all(again.apart[m] == pytest.approx(model.apart[m]) for m in model.apart)


def test_quoted_values_with_marks_stay_and_rare_spans_do_not(spark):
    texts = [f'"r&d",{a}' if a == b else f"{a};{b}" for a in WORDS for b in WORDS] * 40 + ["r&d"] * 3
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
    model = fit(df, "v")
    assert model.spans == {} and split(spark, texts[-1:] + texts[:1], model) == [["r", "d"], ["r&d", "amber"]]


def test_nulls_names_and_long_texts(spark):
    df = spark.createDataFrame([(1, None, "p", 0), (2, "", "q", 0), (3, "a,b", "r", 0), (3, "a,b", "r", 0), (4, "x," * 20_000, "s", 0)], "tx_id int, v string, val string, pos int")
    got = split_packed(df, "v")
    assert got.columns == ["tx_id", "pos", "val"]
    rows = got.collect()
    assert sorted((r.pos, r.val) for r in rows if r.tx_id == 3) == [(0, "a"), (0, "a"), (1, "b"), (1, "b")]
    assert [r.pos for r in rows if r.tx_id == 4] == list(range(20_000)) and {r.tx_id for r in rows} == {3, 4}
    assert split_packed(df.limit(0), "v").count() == 0
    assert fit(df.limit(0), "v").apart == {}
    quoted = spark.createDataFrame([(1, '"' + "a,\\\" " * 20_000 + '",z')], "tx_id int, v string")
    assert split_packed(quoted, "v").count() == 2


def test_fields(spark):
    pair = "array<struct<name:string,value:string>>"
    df = spark.createDataFrame(
        [(1, "a=1&tags=x%2Cy+z&xtags=no&tags=", [("X-Labels", "p;q"), ("Other", "n"), (None, "n"), ("x-labels", None)]), (2, None, None), (3, "tags", [])],
        f"tx_id int, query_string string, request_headers {pair}")
    got = sorted(tuple(r) for r in packed_fields(df, ["tags"], ["x-labels"]).collect())
    assert got == [(1, "headers", "x-labels", "p;q"), (1, "query_string", "tags", ""), (1, "query_string", "tags", "x,y+z")]
    text = spark.createDataFrame([("%41%zz+%e9",), (None,)], "v string")
    assert [r[0] for r in text.select(percent_decode(text.v)).collect()] == ["A%zz+�", None]


def atom(text, mark=""):
    return text, False, text, mark


def test_expected_counts():
    parts = [atom("a", "+"), atom("b", "+"), atom("c")]
    values, apart = {}, {}
    model = Model({"a": 4.0, "b": 4.0, "c": 4.0, "a+b": 8.0}, 40.0, {}, {2: frozenset(["a+b"])})
    packed.expect(parts, 2.0, model, values, apart)
    one, two = 0.1 * 0.5 * 0.1 * 0.5 * 0.1, 0.2 * 0.5 * 0.5 * 0.1
    assert values["a+b"] == pytest.approx(2 * two / (one + two)) and values["a"] == values["b"] == pytest.approx(2 * one / (one + two)) and values["c"] == pytest.approx(2)
    assert sum(apart["+"]) == pytest.approx(4) and best(parts, model) == ["a+b", "c"]
    values = {}
    packed.expect(parts, 1.0, model, values, {}, even=True)
    assert values["a+b"] == pytest.approx(0.5)
