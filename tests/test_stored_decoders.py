"""Decoders over texts as they are stored, against decoders that go character by character."""

import random
from collections import Counter
from html.entities import html5

import pytest

from sluice.plans.rule_queries import QUERIES

DIGITS = set("0123456789abcdefABCDEF")


def number(digits, limit):
    """A hexadecimal number below limit, or None. One plus may stand before its digits."""
    bare = digits[1:] if digits[:1] == "+" else digits
    if not bare or not set(bare) <= DIGITS:
        return None
    n = int(bare, 16)
    return n if n < limit and not 0xD800 <= n <= 0xDFFF else None


def digits_at(t, i, most):
    n = i
    while n < len(t) and n - i < most and t[n] in DIGITS:
        n += 1
    return t[i:n]


def url_uni(t):
    out, i, changed = "", 0, False
    while i < len(t):
        if t[i] != "%":
            out, i = out + t[i], i + 1
            continue
        wide = t[i + 1 : i + 2] in ("u", "U")
        at, size = (i + 2, 4) if wide else (i + 1, 2)
        n = number(t[at : at + size], 0x110000 if wide else 256)
        out += ("%u" if wide else "%") + t[at : at + size] if n is None else chr(n)
        changed, i = changed or n is not None, at + size
    return out if changed else t


def js(t):
    out, i = "", 0
    plain = {"n": "\n", "r": "\r", "t": "\t", "\\": "\\", '"': '"', "'": "'"}
    while i < len(t):
        c = t[i + 1 : i + 2]
        if t[i] != "\\" or not c:
            out, i = out + t[i], i + 1
        elif c in "xu":
            size = 2 if c == "x" else 4
            n = number(t[i + 2 : i + 2 + size], 256 if c == "x" else 0x110000)
            out += t[i : i + 2 + size] if n is None else chr(n)
            i += 2 + size
        else:
            out, i = out + plain.get(c, "\\" + c), i + 2
    return out


def escape_seq(t):
    out, i = "", 0
    plain = {"n": "\n", "r": "\r", "t": "\t", "\\": "\\", "0": "\0"}
    while i < len(t):
        c = t[i + 1 : i + 2]
        if t[i] != "\\" or not c:
            out, i = out + t[i], i + 1
        elif c in "xu":
            d = digits_at(t, i + 2, 2 if c == "x" else 4)
            n = number(d, 0x110000)
            out, i = out + (c + d if n is None else chr(n)), i + 2 + len(d)
        else:
            out, i = out + plain.get(c, "\\" + c), i + 2
    return out


def css(t):
    out, i = "", 0
    while i < len(t):
        if t[i] != "\\":
            out, i = out + t[i], i + 1
            continue
        d = digits_at(t, i + 1, 6)
        i += 1 + len(d)
        i += t[i : i + 1] in (" ", "\t", "\n")
        n = number(d, 0x110000)
        out += "\\" + d if n is None else chr(n)
    return out


def sql_hex(t):
    out, i = "", 0
    while i < len(t):
        if t[i : i + 2] != "0x":
            out, i = out + t[i], i + 1
            continue
        d = digits_at(t, i + 2, len(t))
        out += "".join(chr(int(d[k : k + 2], 16)) for k in range(0, len(d) - 1, 2))
        i += 2 + len(d)
    return out


def html(t):
    out, i = "", 0
    while i < len(t):
        end = t.find(";", i) if t[i] == "&" else -1
        name, got = t[i + 1 : max(end, 0)], None
        if end > 0 and name[:2] in ("#x", "#X") and name[2:3] != "+":
            n = number(name[2:], 0x110000)
            got = None if n is None else chr(n)
        elif end > 0 and name[:1] == "#" and name[1:].isascii() and name[1:].isdigit():
            n = int(name[1:])
            got = chr(n) if n < 0x110000 and not 0xD800 <= n <= 0xDFFF else None
        elif end > 0 and name.isascii() and name.isalnum() and name[0].isalpha():
            got = html5.get(name + ";")
        out, i = (out + t[i], i + 1) if got is None else (out + got, end + 1)
    return out


ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def sixes(t, alphabet):
    """The bytes of padded base64 without stray last bits, or None."""
    bare = t.rstrip("=")
    pad = len(t) - len(bare)
    if len(t) % 4 or pad > 2 or not set(bare) <= set(alphabet):
        return None
    bits = "".join(f"{alphabet.index(c):06b}" for c in bare)
    whole = len(bits) // 8 * 8
    return None if "1" in bits[whole:] else bytes(int(bits[k : k + 8], 2) for k in range(0, whole, 8))


def base64(t):
    got = sixes(t, ALPHABET)
    return t if got is None else got.decode(errors="replace")


def base64_ext(t):
    got = sixes(t, ALPHABET[:-2] + "-_")
    return base64(t) if got is None else got.decode(errors="replace")


def hexes(t):
    got = [number(t[k : k + 2], 256) if len(t) % 2 == 0 else None for k in range(0, len(t), 2)]
    return t if None in got else bytes(got).decode(errors="replace")


BRUTE = {"urlDecodeUni": url_uni, "jsDecode": js, "escapeSeqDecode": escape_seq, "cssDecode": css, "sqlHexDecode": sql_hex, "htmlEntityDecode": html}
PIECES = ["\\", "\\x", "\\u", "\\u00e9", "\\x41", "\\n", "\\0", '\\"', "\\3c ", "\\000062", "\\110000", "\\ud800", "%", "%u", "%U0041", "%41", "%C3%A9", "%zz", "%+f", "%ud800", "0x", "0x41", "0X4", "&", "&lt;", "&#39;",
          "&#xe9;", "&#X3C;", "&#xD800;", "&bogus;", "&amp", ";", "#", "+", " ", "\n", "\t", "4", "a", "F", "g", "é", "😀", '"', "'", "=", "q=1"]


@pytest.fixture(scope="session")
def stored(spark, tmp_path_factory):
    """A folder with a small http_transactions, and its texts by (tx_id, field, pos)."""
    at, r = str(tmp_path_factory.mktemp("stored")), random.Random(3)
    text = lambda: "".join(r.choice(PIECES) for _ in range(r.randrange(9)))
    rows = [(i, text(), [("a", text()) for _ in range(i % 4)], None if i % 7 == 0 else bytearray(text().encode() + (b"\xff" if i % 5 == 0 else b""))) for i in range(300)]
    rows += [rows[1], (300, None, None, None), (301, "", [("a", None), (None, "\\x41%41")], bytearray())]
    spark.createDataFrame(rows, "tx_id long, query_string string, args_get array<struct<name string, value string>>, request_body binary").write.parquet(at + "/http_transactions.parquet")
    texts = []
    for tx, query, args, body in rows:
        texts += [(tx, "query_string", 0, query), *((tx, "args_get", k, v) for k, (_, v) in enumerate(args or [])), (tx, "request_body", 0, None if body is None else body.decode(errors="replace"))]
    return at, texts


@pytest.mark.parametrize("name", BRUTE)
def test_stored_texts(spark, stored, name):
    at, texts = stored
    got = Counter((r.tx_id, r.field, r.pos, r.out) for r in QUERIES[f"t_{name}_stored"](spark, at).collect())
    want = Counter((tx, field, pos, None if v is None else BRUTE[name](v)) for tx, field, pos, v in texts)
    assert got == want
    assert sum(v is not None and BRUTE[name](v) != v for *_, v in texts) > 50


BRUTE_WHOLE = {"base64Decode": base64, "base64DecodeExt": base64_ext, "hexDecode": hexes}
WHOLE = ["aGVsbG8=", "aGVsbG8", "aGVsbG9=", "aGVs bG8=", "_w==", "/w==", "-/==", "-_-_", "+/+/", "a-_b", "aa==", "ag==", "=", "====", "a===", "ab=c", "QUJD", "4142", "+f4a", "4+f4", "414", "zz", "FFfe", "c3a9", "++", "é", "", "aGVsbG8=\n"]


@pytest.mark.parametrize("name", BRUTE_WHOLE)
def test_stored_texts_decoded_whole(spark, tmp_path, name):
    r = random.Random(4)
    texts = WHOLE + ["".join(r.choice("Aag4Q+/-_=fF") for _ in range(r.randrange(9))) for _ in range(2000)]
    rows = [(i, t, [("a", t)], bytearray(t.encode())) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "tx_id long, query_string string, args_get array<struct<name string, value string>>, request_body binary").write.parquet(str(tmp_path / "http_transactions.parquet"))
    got = [(r.field, r.tx_id, r.out) for r in QUERIES[f"t_{name}_stored"](spark, str(tmp_path)).collect()]
    wrong = [(texts[i], out, BRUTE_WHOLE[name](texts[i])) for _, i, out in got if out != BRUTE_WHOLE[name](texts[i])]
    assert not wrong and len(got) == 3 * len(texts)
    assert sum(BRUTE_WHOLE[name](t) != t for t in texts) > 20
    assert any(base64(t) != base64_ext(t) for t in texts)
