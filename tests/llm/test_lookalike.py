import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from sluice.llm import lookalike as la

TERMS = la.Terms((1, 2, 3, 4, 5, 6), ("office-coupon", "Partner_Profile", "корзина-товаров", "préférences", "счёта", "réglages d'accès"))
CLEAN = [*TERMS.texts, "the quick brown office fox", "новые товары в корзине и проверка счёта", "les préférences de réglages"]


def reader():
    pairs = {}
    for t in CLEAN:
        base = "".join(c if c.isalpha() else " " for c in unicodedata.normalize("NFD", t) if unicodedata.category(c)[0] != "M")
        base = f" {' '.join(base.split())} "
        for i in range(len(base) - 1):
            pairs[base[i : i + 2]] = pairs.get(base[i : i + 2], 0) + 1
    return la.Reader(pairs)


R = reader()
TREE = TERMS.matcher(R)


def found(text):
    return la.disguised_terms(text, TREE, R)


@pytest.mark.parametrize("text, ids", [
    ("office-coupon", []), ("оffiсе-соuроn", [1]), ("o​ffice-coupon", [1]), ("oﬃce‐coupon", [1]), ("ｏｆｆｉｃｅ－ｃｏｕｐｏｎ", [1]), ("xoffice-cоupony", [1]), ("office-coupon office-cоupon", [1]),
    ("Рartner＿Profile", [2]), ("partner_prоfile", []), ("Partner_Profi1e", []), ("кopзинa-товаров", [3]), ("корзина-товаров", []), ("КОРЗИНА-ТОВАРОВ", []),
    ("préférences", []), ("préférences", [4]), ("prefеrences", []), ("préférencеs", [4]), ("préférenceś", []), ("счëта", [5]), ("счëта", [5]), ("счета", []),
    ("réglages d'accès", [6]), ("réglages d’accès", [6]), ("réglages d'accѐs", [6]), ("naïve zero​width ＷＩＤＥ", []), ("", []), ("оffice-cоüpon", []), ("Οffice-coupon", []),
    ("­office-coupon‍", []), ("partner_ofﬁcе-coupon", [1]), ("oꬃice-coupon", []),
])
def test_cases(text, ids):
    assert found(text) == ids


def test_disguises_found_by_brute_force():
    """Any mixture of look-alikes, wide forms, decomposed accents and unseen characters reads as the term."""
    rng = random.Random(5)
    for k, term in zip(TERMS.ids, TERMS.texts):
        for _ in range(60):
            out, changed = [], False
            for c in unicodedata.normalize("NFD", term) if rng.random() < 0.3 else term:
                others = list(la.ALIKE.get(c, "")) if c.isascii() else [a for a, o in la.ALIKE.items() if c in o]
                wide = [chr(ord(c) + 0xFEE0)] if "!" <= c <= "~" else []
                signs = list(la.SIGNS.get(c, ""))[:3]
                new = rng.choice(others + wide + signs) if rng.random() < 0.3 and others + wide + signs else c
                out.append(new + (rng.choice("​⁠­") if rng.random() < 0.1 else ""))
            text = "".join(out)
            inner = text.rstrip("​⁠­")
            changed = inner != term
            assert found(text) == ([k] if changed else []), (term, text)


def test_forms_are_stable():
    for t in CLEAN + ["оffiсе", "Ⅻ ﬁ", "á", "日本", "𝐀𝐛"]:
        once = unicodedata.normalize("NFC", R.read(t)[0])
        assert unicodedata.normalize("NFC", R.read(once)[0]) == once
    assert R.read("оffiсе")[0] == "office" and len(R.read("a" * 100_000 + "а")[0]) == 100_001


def test_queries_on_tables(spark):
    pair = "array<struct<name:string,value:string>>"
    rows = [
        (1, "/x/%D0%BEffice-coupon?q=%D0%BEffice-coupon", [("q", "оffice-coupon"), ("r", None)], bytearray("m=préférencеs".encode())),
        (1, "/x/%D0%BEffice-coupon?q=%D0%BEffice-coupon", None, None), (2, None, [], bytearray(b"\xff\xfe")), (None, "/оffice-coupon+", None, bytearray()), (3, "/office-coupon/%zz%D0", None, None),
    ]
    tx = spark.createDataFrame(rows, f"tx_id long, uri string, args_get {pair}, request_body binary")
    got = sorted((r.tx_id or 0, r.field, r.term_id) for r in la.find_terms(la.request_texts(tx), TERMS, R).collect())
    assert got == [(0, "uri", 1), (1, "args_get", 1), (1, "body", 4), (1, "uri", 1)]
    assert la.find_terms(la.request_texts(tx.limit(0)), TERMS, R).count() == 0
    assert la.find_terms(la.request_texts(tx), la.Terms((), ()), R).count() == 0
    texts = spark.createDataFrame([("оffice",), ("plain",), (None,), ("",)], "t string")
    assert [r[0] for r in texts.select(la.canonical(F.col("t"), R)).collect()] == ["office", "plain", None, ""]


def test_training(spark):
    a = spark.createDataFrame([("ab é",), (None,), ("",)], "t string")
    got = la.fit_reader(F.col("t"), frames=[a]).pairs
    assert got == {" a": 1, "ab": 1, "b ": 1, " e": 1, "e ": 1}


def test_terms_that_ascii_can_show():
    assert not la.ascii_readable(TERMS) and la.ascii_readable(la.Terms((1,), ("сосо",)))
