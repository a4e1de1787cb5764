import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.operators.malformed import DIRECTIVES, SEPARATORS, Layout, rejected, strict_load

GOOD = 'a/b.conf,1,2,SecRule,3,note'


def fields(text, sep):
    """A reader written as a loop over characters; None for broken quoting."""
    out, at, blank = [], 0, " " if sep == "\t" else " \t"
    while True:
        start = at
        while at < len(text) and text[at] in blank:
            at += 1
        if text[at : at + 1] == '"':
            value, at = "", at + 1
            while True:
                if at >= len(text):
                    return None
                if text[at] == '"':
                    if text[at + 1 : at + 2] != '"':
                        break
                    at += 1
                value, at = value + text[at], at + 1
            at += 1
            while at < len(text) and text[at] in blank:
                at += 1
            if at < len(text) and text[at] != sep:
                return None
            out.append(value)
        else:
            at = start
            while at < len(text) and text[at] != sep:
                if text[at] == '"':
                    return None
                at += 1
            out.append(text[start:at].strip(" \t"))
        if at >= len(text):
            return out
        at += 1


def reason(sep, text):
    if text is None or sep not in SEPARATORS:
        return "column_count"
    f = fields(text[:-1] if text.endswith("\r") else text, SEPARATORS[sep])
    if f is None:
        return "quoting"
    if len(f) != 6:
        return "column_count"
    ok = (not f[0] or f[0].endswith(".conf")) and all(re.fullmatch("[0-9]+", x) and 1 <= int(x) <= 2147483647 for x in f[1:3])
    return None if ok and f[3].lower() in [d.lower() for d in DIRECTIVES] and re.fullmatch("[0-9]*", f[4]) else "value"


CASES = [
    GOOD, GOOD + "\r", GOOD + "\r\r", " a.conf ,\"1\",2, secrule ,,", ",1,1,Include,,", '"a,b.conf",1,1,SecRule,,"x ""y"" z"', '"a.conf",1,1,SecRule,,"x\ny"', "", None, ",,,,,",
    'a.conf,1,1,SecRule,,"open', 'a.conf,1,1,SecRule,,"a"b', 'a.conf,1,1,SecRule,,a"b', "a.conf,1,1,SecRule,", GOOD + ",", "a.CONF,1,1,SecRule,,", "a.conf,0,1,SecRule,,",
    "a.conf,2147483647,1,SecRule,,", "a.conf,2147483648,1,SecRule,,", "a.conf,007,1,SecRule,,", "a.conf,٤,1,SecRule,,", "a.conf,１,1,SecRule,,", "a.conf,+1,1,SecRule,,", "a.conf,1.0,1,SecRule,,",
    "a.conf,99999999999999999999999999,1,SecRule,,", "a.conf,1,1,SecRules,,", "a.conf,1,1,SecRule,12a,", "a.conf,1,1,SecRule,,x\r", 'a.conf,1,1,SecRule,,""', '"",1,1,SecRule,"",""""', ' "a.conf" , 1,1,SecRule,,',
]


def check(spark, rows):
    df = spark.createDataFrame(rows, "record_id long, sep string, line_text string, note string")
    want = {i: reason(s, t) for i, s, t, _ in rows}
    assert {r.record_id: r.reason for r in rejected(df).collect()} == {i: r for i, r in want.items() if r}
    assert {r.record_id for r in strict_load(df).collect()} == {i for i, r in want.items() if r is None}


def test_cases(spark):
    rows = [(i, "comma", t, "clash") for i, t in enumerate(CASES)]
    for k, (name, char) in enumerate(SEPARATORS.items()):
        rows += [(1000 * (k + 1) + i, name, t and t.replace(",", char), None) for i, t in enumerate(CASES)]
    rows += [(9000, None, GOOD, None), (9001, "colon", GOOD, None), (9002, "tab", "a.conf\t \t1\tSecRule\t\t", None), (9003, "tab", " a.conf \t1\t1\tSecRule\t\t", None)]
    check(spark, rows)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text('",;\t| \r\na1.', max_size=14), min_size=30, max_size=30), st.sampled_from(sorted(SEPARATORS)))
def test_random_lines(spark, texts, sep):
    tails = ["", GOOD.replace(",", SEPARATORS[sep])]
    check(spark, [(2 * i + j, sep, t + tail, None) for i, t in enumerate(texts) for j, tail in enumerate(tails)])


def test_typed_rows(spark):
    df = spark.createDataFrame([(7, "comma", ' "a.conf" ,012,3,SECRULE,, "x, ""y""" \r')], "record_id long, sep string, line_text string")
    assert tuple(strict_load(df).first()) == (7, "a.conf", 12, 3, "SECRULE", None, 'x, "y"')


def test_null_offsets_long_lines_and_names(spark):
    long = 'a.conf,1,1,SecRule,,"' + "x,\"\"" * 200_000 + '"'
    df = spark.createDataFrame([(None, "comma", GOOD), (None, "comma", "x"), (1, "comma", long), (2, "comma", "a," * 300_000)], "i long, s string, t string")
    at = Layout("i", "s", "t")
    assert sorted((r.i or 0, r.reason) for r in rejected(df, at).collect()) == [(0, "column_count"), (2, "column_count")]
    assert sorted(r.i or 0 for r in strict_load(df, at).collect()) == [0, 1]
    assert rejected(df.limit(0), at).count() == strict_load(df.limit(0), at).count() == 0


@pytest.mark.parametrize("name", sorted(SEPARATORS))
def test_reader_knows_itself(name):
    assert reason(name, GOOD.replace(",", SEPARATORS[name])) is None
