import ipaddress
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluice.functions.regex import BadPattern, needed, to_java
from sluice.operators import detectors, predicates
from sluice.operators.predicates import Predicate, register, rx_groups, test as satisfies
from sluice.seclang.parser import parse_operator

MATCH = [
    ("@rx ^admin", ["admin"], ["user"]), (r"@rx user=(\w+)", ["user=john"], []), ("@rx a$", ["a"], ["a\n"]), ("@rx ^.$", ["é", "\r"], ["\n", "ab"]), (r"@rx ^\w$", ["é"], ["-"]),
    ("@rx (?=a)", [], ["a"]), ("@rx [[:alpha:]]{2}", ["ab"], ["é9"]), (r"@rx \x{41}", ["A"], ["x"]), ("@rx (?i)É", ["é"], ["e"]), ("@rx (?m)^a$", ["b\na\n"], ["ab"]),
    (r"@rx (?P<n_1>a)\.", ["a."], ["ab"]), ("@rx [^]a]", ["b"], ["]", "a"]), ("@rx (", [], ["("]), ("!@rx (", ["x"], []), ("@rx (?U)^a+$", ["aa"], ["b"]),
    ("@pm admin root user", ["the admin user"], ["guest"]), ("@pm ADMIN", ["admin", "Admin"], ["ádmin"]), ("@pm k", ["K"], ["\u212a"]), ("@pm a.b \\E", ["a.b", "x\\Ey"], ["axb"]),
    ("@contains admin", ["/admin/users"], ["/users", "/ADMIN"]), ("@beginsWith /admin", ["/admin/users"], ["/users/admin"]), ("@endsWith .php", ["index.php"], ["index.html"]),
    ("@streq admin", ["admin"], ["Admin"]), ("@within a b", ["a", "b"], ["", "ab"]), ("@within ", [], ["", "a"]),
    ("@eq 10", ["10", "+10", "010"], ["11", " 10", "x", "", "99999999999999999999"]), ("@gt 10", ["11"], ["10", "x"]), ("@lt 10", ["9", "-1"], ["10"]), ("@ge 10", ["10"], ["9"]), ("@le 10", ["10"], ["11"]),
    ("@ne 10", ["11", "x"], ["10", "+10"]), ("@ne x", ["10", "y"], ["x"]), ("@eq %{TX.x}", [], ["1"]),
    ("@ipMatch 192.168.1.1", ["192.168.1.1"], ["192.168.1.2", "192.168.001.1", "x", ""]), ("@ipMatch 192.168.1.0/24", ["192.168.1.1", "192.168.1.255"], ["192.168.2.1"]),
    ("@ipMatch 10.0.0.0/8 192.168.0.0/16", ["10.1.2.3", "192.168.1.1"], ["172.16.0.1", "::1"]), ("@ipMatch 2001:db8::/32 10.0.0.1", ["2001:db8::5", "10.0.0.1"], ["2001:db9::5", "10.0.0.2", "x"]),
    ("@ipMatch 0.0.0.0/0", ["255.255.255.255"], ["256.1.1.1", "1.2.3.4\n"]),
    ("@validateUrlEncoding", ["hello%2", "hello%GG", "%"], ["hello%20world", "test%2Fpath"]), ("@validateUtf8Encoding", ["a\0"], ["é"]),
    ("@validateByteRange 32-126", ["é", "\n"], ["abc", ""]), ("@validateByteRange 9,x,200-201,1-2-3", ["a"], ["\t"]), ("@validateByteRange", ["a"], [""]),
    ("@unconditionalMatch", ["", "x"], []), ("@noMatch", [], ["x"]), ("!@noMatch", ["x"], []), ("@verifyCC x", [], ["4111111111111111"]), ("@containsWord a", ["cat"], []), ("@strmatch A", [], ["a"]),
    ("@rx ^[a&&a]$", ["a"], ["b"]), (r"@rx \v", ["\x0b"], ["\n"]), (r"@rx [\w.-]+@", ["a.b@"], ["@"]), ("@rx a{2}", ["aa"], ["a"]), (r"@rx \pL\p{Greek}", ["aα"], ["ab"]),
]


def test_each(spark):
    for text, yes, no in MATCH:
        op = parse_operator(text)
        rows = spark.createDataFrame([(v, w) for v, w in [*[(v, True) for v in yes], *[(v, False) for v in no], (None, False)]], "v string, want boolean")
        wrong = rows.select("v", "want", satisfies(op, F.col("v")).alias("hit")).where(F.col("hit") != F.col("want")).collect()
        assert not wrong, (text, wrong)


def test_captures(spark):
    df = spark.createDataFrame([("user=john",), ("x",), (None,)], "v string")
    got = [r[0] for r in df.select(rx_groups(F.col("v"), r"user=(\w+)(x)?")).collect()]
    assert got[0] == ["john"] and got[1] == [] and got[2] in ([], None)
    assert df.select(rx_groups(F.col("v"), "(?=a)")).first()[0] == []


@pytest.mark.parametrize("bad", ["", "(?=a)", "(?!a)", "(?<=a)b", "(?<!a)b", "(?>a)", r"(a)\1", "a++", "a*+", r"\Z", r"\G", r"\h", r"\R", r"\Qa\E", r"\y", "[a", "[a--b]", r"\k<n>"])
def test_refused_patterns(bad):
    with pytest.raises(BadPattern):
        to_java(bad)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", ".", "[ab]", "[^a]", "(a|b)", "a?", "b*", "^", "$", r"\d", r"\w", r"\s", "(?:ab)+", "a{1,2}"]), min_size=1, max_size=6), st.text("ab1 \n", max_size=6))
def test_patterns_mean_the_same(spark, parts, text):
    pattern = "".join(parts)
    if re.search(r"[*+?}$^][*+?{]", pattern):
        return
    java = spark._jvm.java.util.regex.Pattern.compile(to_java(pattern))
    assert java.matcher(text).find() == bool(re.search(pattern.replace("$", r"\Z"), text))


def test_registered(spark):
    register("longerThan", lambda arg: Predicate(lambda v: F.length(v) > int(arg)))
    df = spark.createDataFrame([("abc",), ("a",)], "v string")
    assert [r[0] for r in df.select(satisfies(parse_operator("@longerThan 2"), F.col("v"))).collect()] == [True, False]


SQLI = [
    "1' OR '1'='1", "' OR 1=1--", "admin'--", "1 OR 1=1", "1 UNION SELECT * FROM users", "' UNION SELECT username, password FROM users--", "1' UNION SELECT NULL,NULL,NULL--", "admin'/*", "1--",
    "'/* comment */", "1; DROP TABLE users", "'; DELETE FROM users--", "1; DROP TABLE users--", "sleep", "exec sleep", "update set where x"]
NOT_SQLI = ["hello world", "normal search query", "normal query string", "user@example.com", "John O'Brien", "", "drop"]
XSS = [
    "<script>alert(1)</script>", "<SCRIPT>alert(1)</SCRIPT>", "<script src=evil.js>", "<script/src=evil.js>", "<img src=x onerror=alert(1)>", "<body onload=alert(1)>", "<svg onload=alert(1)>",
    "<input onfocus=alert(1) autofocus>", "<a href=javascript:alert(1)>click</a>", '<a href="javascript:alert(1)">click</a>', "javascript:alert(document.cookie)", "javascript:alert(1)",
    "%3Cscript%3Ealert(1)%3C/script%3E", "&lt;script&gt;alert(1)&lt;/script&gt;", "<svg><script>alert(1)</script></svg>", "<iframe src=javascript:alert(1)>", '<iframe src="evil.com">',
    "document.write('<script>')", "element.innerHTML = userInput", "eval('malicious code')", "<scr\0ipt>", "< script>", "x onclick = y"]
NOT_XSS = ["hello world", "This is normal text without any special characters", "12345", "user@example.com", "just some text", "numbers 12345", "<p>Normal paragraph</p>", ""]


def test_detectors(spark):
    rows = [(t, "q", True) for t in SQLI] + [(t, "q", False) for t in NOT_SQLI] + [(t, "x", True) for t in XSS] + [(t, "x", False) for t in NOT_XSS] + [(None, "q", False), (None, "x", False)]
    df = spark.createDataFrame(rows, "v string, kind string, want boolean")
    one = F.when(F.col("kind") == "q", detectors.detect_sqli(F.col("v"))).otherwise(detectors.detect_xss(F.col("v")))
    assert not df.select("v", "kind", "want", one.alias("hit")).where("hit <> want").collect()
    for text, kind, want in rows:
        if text is not None:
            assert (detectors.is_sqli if kind == "q" else detectors.is_xss)(text) is want, text


def test_token_kinds_agree_with_tokens(spark):
    """The expression and the tokeniser on random texts of SQL's pieces."""
    rng = random.Random(2)
    pieces = ["'", '"', "\\", "--", "/*", "*/", "\n", " ", " ", "0x1F", "12", "1.", "@a", "or", "AND", "select", "union", "sleep", "count", "abc", "<=", "=", "&&", "(", ")", ";", "#", "'a'", "'UNION'", "é"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 9))) for _ in range(4000)] + ["", "'", "\"a\\", "/*", "/*a", "'union' select", "'a' = 'a'", "f", "sleep"]
    df = spark.createDataFrame([(t, detectors.sqli_by_tokens(t) is not None, detectors.is_sqli(t)) for t in texts], "v string, tokens boolean, sqli boolean")
    wrong = df.select("v", "tokens", "sqli", detectors.sqli_by_token_kinds(F.col("v")).alias("t"), detectors.detect_sqli(F.col("v")).alias("s")).where("t <> tokens or s <> sqli")
    assert not wrong.take(5)


def test_scripts_agree_with_python(spark):
    rng = random.Random(4)
    pieces = ["<", " ", "script", ">", "%3C", "%3c", "&lt;", "&#x3c;", "&bogus;", "on", "click", " =", "= ", "=", "java", "javascript", ":", "%00", "\0", "%FF", "img", "eval", "(", "é", "&", "/"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 7))) for _ in range(4000)]
    df = spark.createDataFrame([(t, detectors.is_xss(t)) for t in texts], "v string, want boolean")
    assert not df.select("v", "want", detectors.detect_xss(F.col("v")).alias("hit")).where("hit <> want").take(5)


def test_fingerprints(spark):
    df = spark.createDataFrame([("1' OR '1'='1",), ("sleep",), ("hello",)], "v string")
    assert [r[0] for r in df.select(detectors.detection(F.col("v"), "sqli")["fingerprint"]).collect()] == ["s&1", "f", None]
    assert detectors.xss_kind("<script>") == "XSS pattern match" and detectors.xss_kind("<p onclick=x") == "XSS pattern match" and detectors.xss_kind("<img x") == "Dangerous HTML tag"
    assert detectors.xss_kind("on mocha:x") == "Dangerous URL scheme"
    assert detectors.sqli_fingerprint("a ; select") == "ok"
    assert detectors._sql_tokens("/* open") == [("c", "/* ope"), ("U", "n")]  # the last character of an open comment is a token of its own
    assert [k for k, _ in detectors._sql_tokens("@a:=0x1F + b(-- c\n)'x\\'' #")] == ["v", "o", "1", "o", "U", "E", "c", "E", "s"]


def test_addresses_of_many_networks(spark):
    rng = random.Random(6)
    four = [f"{rng.randint(1, 223)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}/{rng.randint(9, 32)}" for _ in range(3000)]
    six = [f"2001:db8:{rng.randint(0, 65535):x}::/{rng.randint(33, 64)}" for _ in range(500)]
    texts = [str(ipaddress.ip_network(n, strict=False)[0]) for n in four[:50] + six[:50]] + [f"{rng.randint(1, 223)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.9" for _ in range(400)] + [f"2001:db8:{rng.randint(0, 65535):x}::1" for _ in range(99)] + ["", "x", "1.2.3", "01.2.3.4", "::", None]
    df = spark.createDataFrame([(t,) for t in texts], "v string")

    def brute(text, nets):
        try:
            a = ipaddress.ip_address(text or "")
        except ValueError:
            return False
        return any(a in n for n in nets if n.version == a.version)

    for items in (four, four + six, four[:3], six[:1]):
        nets = [ipaddress.ip_network(n, strict=False) for n in items]
        got = [r[0] for r in df.select(predicates.test(parse_operator("@ipMatch " + " ".join(items)), F.col("v"))).collect()]
        assert got == [brute(t, nets) for t in texts]
    huge = "@ipMatch " + " ".join(f"{a}.{b}.{c}.0/25" for a in range(10, 14) for b in range(125) for c in range(200))
    assert [r[0] for r in spark.createDataFrame([("13.124.199.127",), ("13.124.199.128",), ("9.9.9.9",)], "v string").select(predicates.test(parse_operator(huge), F.col("v"))).collect()] == [True, False, False]


def test_phrases_are_searched_as_a_trie(spark):
    rng = random.Random(7)
    phrases = ["".join(rng.choice("abAB.\\*é") for _ in range(rng.randint(1, 6))) for _ in range(150)] + ["a" * n + "b" for n in range(6, 300)]
    texts = ["".join(rng.choice("abcAB.\\*éxyz") for _ in range(rng.randint(0, 12))) for _ in range(2000)] + ["a" * 299, "a" * 250 + "B", "", "\\E"]
    low = lambda t: t.translate({c: c + 32 for c in range(65, 91)})
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    for some in (phrases, phrases[:1], phrases[:9], [p for p in phrases if len(p) > 4]):
        got = [r[0] for r in df.select(predicates.test(parse_operator("@pm " + " ".join(some)), F.col("v"))).collect()]
        assert got == [any(low(p) in low(t) for p in some) for t in texts]


def test_needed_texts():
    """Whatever a pattern matches holds one of the texts it is said to need, case aside."""
    rng = random.Random(3)
    atoms = ["abc", "de", "x", "[a-c]", "(?:abc|def)", "(abcd)", "a?", "(?:ab)+", "[^x]", "\\w", ".", "(?i:Abc)", "b{2,3}", "(?:a|bc)?", "^", "z*", "\\.", "\\[", "()"]
    checked = 0
    for _ in range(3000):
        p = "".join(rng.choice(atoms) for _ in range(rng.randint(1, 5))) + rng.choice(["", "", "|abcd", "|"])
        need = needed(p)
        if not need:
            continue
        for _ in range(10):
            t = "".join(rng.choice(["abc", "abcd", "def", "de", "x", "a", "ab", "bb", ".", "[", "Abc", "bc"]) for _ in range(rng.randint(1, 6)))
            if re.search(p, t):
                checked += 1
                assert any(n.lower() in t.lower() for n in need), (p, t, need)
    assert checked > 500 and needed("[[:alpha:]]abcdef") is None and needed("(?x)ab cd ef") is None and needed("a|b") is None
