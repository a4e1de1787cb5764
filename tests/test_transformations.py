import hashlib

import pytest
from pyspark.sql import functions as F

from sluice.functions.transformations import apply_transformations, pipeline, register
from sluice.seclang.errors import UnknownTransformation

CASES = [
    ("urlDecode", "hello%20world", "hello world"), ("urlDecode", "test%2Fpath", "test/path"), ("urlDecode", "a+b%zz%4", "a+b%zz%4"), ("urlDecode", "%FFa", "%FFa"),
    ("urlDecode", "%C3%A9", "é"), ("urlDecode", "\ufffd%41%EF%BF%BD", "\ufffdA\ufffd"),
    ("base64Decode", "aGVsbG8=", "hello"), ("base64Decode", "aGVsbG8", "aGVsbG8"), ("base64Decode", "aGVs bG8=", "aGVs bG8="), ("base64Decode", "aGVsbG9=", "aGVsbG9="), ("base64Decode", "", ""),
    ("base64Decode", "/w==", "\ufffd"), ("base64DecodeExt", "_w==", "\ufffd"), ("base64DecodeExt", "aGVsbG8=", "hello"), ("base64DecodeExt", "-/==", "-/=="),
    ("htmlEntityDecode", "&lt;script&gt;", "<script>"), ("htmlEntityDecode", "&#60;&#x3C;", "<<"), ("htmlEntityDecode", "&lt &bogus; &#xD800; &", "&lt &bogus; &#xD800; &"),
    ("jsDecode", "\\x3cscript\\x3e", "<script>"), ("jsDecode", "\\u003c", "<"), ("jsDecode", "\\n\\t\\\"\\'\\q\\", "\n\t\"'\\q\\"), ("jsDecode", "\\xzz\\x4", "\\xzz\x04"),
    ("jsDecode", "\\xe9\\ud800\\x+f", "é\\ud800\x0f"),
    ("cssDecode", "\\3c x", "<x"), ("cssDecode", "\\000062c", "bc"), ("cssDecode", "\\ x\\zz", "\\x\\zz"), ("cssDecode", "\\110000 x", "\\110000x"),
    ("escapeSeqDecode", "\\n\\0\\x41\\u42\\xg\\q\\", "\n\0ABxg\\q\\"), ("escapeSeqDecode", "\\ud800", "ud800"),
    ("sqlHexDecode", "0x41424344", "ABCD"), ("sqlHexDecode", "a0x414b0x", "aAKx"), ("sqlHexDecode", "0xe", ""), ("sqlHexDecode", "0Xff 0xff", "0Xff ÿ"),
    ("urlDecodeUni", "%u0041%42%e9", "ABé"), ("urlDecodeUni", "%4", "\x04"), ("urlDecodeUni", "%+f", "\x0f"), ("urlDecodeUni", "%U00zz", "%U00zz"), ("urlDecodeUni", "%U00zz%41", "%u00zzA"),
    ("urlDecodeUni", "%%41", "%%41"), ("urlDecodeUni", "%ud800", "%ud800"),
    ("base64Encode", "hello", "aGVsbG8="), ("base64Encode", "x" * 100, __import__("base64").b64encode(b"x" * 100).decode()), ("hexEncode", "AB", "4142"),
    ("hexDecode", "4142", "AB"), ("hexDecode", "+f", "\x0f"), ("hexDecode", "4", "4"), ("hexDecode", "zz", "zz"), ("hexDecode", "", ""), ("hexDecode", "ff", "\ufffd"),
    ("md5", "hello", "5d41402abc4b2a76b9719d911017c592"), ("sha1", "hello", "aaf4c61ddcc5e8a2dabede0f3b482cd9aea9434d"), ("sha256", "hello", hashlib.sha256(b"hello").hexdigest()),
    ("lowercase", "Hello World", "hello world"), ("lowercase", "already lower", "already lower"), ("uppercase", "straße", "STRASSE"),
    ("compressWhitespace", "hello   world", "hello world"), ("compressWhitespace", "a\t\nb", "a b"), ("compressWhitespace", " a\u2003\u00a0b ", " a b "),
    ("removeWhitespace", "hello world\u2003", "helloworld"), ("trim", "\u00a0 a b\n", "a b"), ("trimLeft", "  a ", "a "), ("trimRight", "  a ", "  a"),
    ("removeNulls", "a\0b", "ab"), ("replaceNulls", "a\0b", "a b"),
    ("normalizePath", "/a/b/../c", "/a/c"), ("normalizePath", "/a//b/./c", "/a/b/c"), ("normalizePath", "a\\b\\c", "a/b/c"), ("normalizePath", "/../a", "a"), ("normalizePath", "/a/", "/a/"),
    ("normalizePath", "/a//", "/a"), ("normalizePath", "../../a", "a"), ("normalizePath", "", ""), ("normalizePathWin", "/a/b", "\\a\\b"),
    ("cmdLine", "CMD;/C", "cmd /c"), ("cmdLine", "echo^hello", "echohello"), ("cmdLine", "CMD,/C;DIR", "cmd /c dir"), ("cmdLine", " \"É\" ", "É"),
    ("removeComments", "a/*b*/c/*d", "ac"), ("replaceComments", "a/*b*/c/*d", "a c"), ("removeComments", "a/*b\nc*/d", "ad"), ("removeCommentsChar", "a/*b*/--#c", "abc"), ("removeCommentsChar", "/-*-", "/-*-"),
    ("urlEncode", "a b-._~*é", "a%20b%2D%2E%5F%7E%2A%C3%A9"), ("length", "é", "2"), ("none", "x", "x"), ("utf8ToUnicode", "é", "é"),
    ("parityEven7bit", "x", "x"), ("parityOdd7bit", "x", "x"), ("parityZero7bit", "x", "x"),
]


def test_each(spark):
    df = spark.createDataFrame([(i, v) for i, (_, v, _) in enumerate(CASES)], "i int, v string")
    got = {}
    for name in sorted({n for n, _, _ in CASES}):
        got[name] = {r[0]: r[1] for r in df.select("i", apply_transformations(F.col("v"), (name,)).alias("o")).collect()}
    wrong = [(n, v, e, got[n][i]) for i, (n, v, e) in enumerate(CASES) if got[n][i] != e]
    assert not wrong


def test_nulls_long_texts_and_arrays(spark):
    names = sorted({n for n, _, _ in CASES})
    df = spark.createDataFrame([(None, ["A", None]), ("/a" * 50_000, [])], "v string, a array<string>")
    rows = df.select(*[apply_transformations(F.col("v"), (n,)).alias(n) for n in names], *[apply_transformations(F.col("a"), (n,), many=True).alias("m_" + n) for n in names]).collect()
    assert all(rows[0][n] is None and rows[0]["m_" + n][1] is None and rows[1]["m_" + n] == [] for n in names)
    assert all(rows[1][n] is not None for n in names)


@pytest.mark.parametrize("names, value, out", [
    ([], "hello", "hello"), (["lowercase"], "HELLO", "hello"), (["urlDecode", "lowercase"], "HELLO%20WORLD", "hello world"),
    (["lowercase", "none", "uppercase"], "hello", "HELLO"), (["jsDecode", "lowercase", "cssDecode"], "\\x41\\3c", "a<"),
])
def test_pipelines(spark, names, value, out):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(apply_transformations(F.col("v"), pipeline(names))).first()[0] == out


def test_names():
    assert pipeline(["LowerCase", "NONE"]) == ()
    with pytest.raises(UnknownTransformation):
        pipeline(["nope"])


def test_registered(spark):
    register("reversed", native=F.reverse)
    register("shouted", python=lambda t: t + "!")
    df = spark.createDataFrame([("ab",)], "v string")
    assert df.select(apply_transformations(F.col("v"), pipeline(["reversed", "shouted"]))).first()[0] == "ba!"
    with pytest.raises(ValueError):
        register("x")
