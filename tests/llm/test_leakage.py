import random
import re
import unicodedata

from sluice.llm import leakage

SCHEMA_D, SCHEMA_I = "doc_id long, text string, item_id string", "item_id long, text string, note string"
ITEM = "The mill at Pelemund turns only when Droozor opens the gate of Ostanetavo at dawn. It sends 13 sacks to Skaogrim and 86 kg to Straße, l'été."


def words(text):
    flat = "".join(c for c in unicodedata.normalize("NFD", (text or "").lower()) if unicodedata.category(c)[0] != "M").replace("ß", "ss")
    return re.findall(r"[^\W_]+", flat)


def brute(docs, items, n):
    grams = {}
    for i, t in items:
        w = words(t)
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    return {(d, i) for d, t in docs for w in [words(t)] for k in range(len(w) - n + 1) for i in grams.get(tuple(w[k : k + n]), ())}


def tables(spark, docs, items):
    return spark.createDataFrame([(*d, "clash") for d in docs], SCHEMA_D), spark.createDataFrame([(*i, None) for i in items], SCHEMA_I)


def run(spark, docs, items, **options):
    d, i = tables(spark, docs, items)
    return {tuple(r) for r in leakage.leaked(d.drop("item_id"), i, **options).collect()}


def test_variants(spark):
    part = " ".join(ITEM.split()[3:16])
    docs = [
        (1, "x " + part + " y"), (2, part.upper()), (3, unicodedata.normalize("NFD", ITEM)), (4, part.replace(" ", "\n ")), (5, part.replace("opens", "shuts")), (6, " ".join(ITEM.split()[3:14])),
        (7, None), (8, ""), (9, ITEM.replace("ß", "SS")), (10, ITEM.replace("é", "e").replace("'", " ")), (11, ITEM + " " + ITEM), (1, "x " + part + " y"), (12, part.replace(" ", ", ")), (None, part),
    ]
    items = [(1, ITEM), (2, "short one"), (3, None), (4, ITEM.replace("Pelemund", "Other"))]
    got = run(spark, docs, items)
    assert got == brute(docs, items, 12)
    assert {d for d, i in got if i == 1} == {1, 2, 3, 4, 9, 10, 11, 12, None}


def test_random_texts(spark):
    rng = random.Random(1)
    word = lambda: rng.choice(["a", "b", "C", "d1", "7", "kg", "É", "éé", "Zed"])
    items = [(i, " ".join(word() for _ in range(rng.randint(0, 30)))) for i in range(20)]
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(200)]
    docs += [(1000 + i, docs[i][1] + ", " + " ".join(items[i][1].split()[rng.randint(0, 3):])) for i in range(20)]
    for n in (3, 5):
        assert run(spark, docs, items, size=n) == brute(docs, items, n)


def test_join_without_broadcast_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BROADCAST_WINDOWS", 1)
    docs = [(1, ITEM), (2, "nothing of it")]
    assert run(spark, docs, [(1, ITEM)]) == {(1, 1)}
    d, i = tables(spark, docs, [(1, ITEM)])
    d = d.drop("item_id")
    assert leakage.leaked(d.limit(0), i).count() == 0 and leakage.leaked(d, i.limit(0)).count() == 0


def test_long_text(spark):
    assert run(spark, [(1, "filler words " * 50_000 + ITEM)], [(1, ITEM)]) == {(1, 1)}


def test_reparameterised(spark):
    other = ITEM.replace("Pelemund", "Velora").replace("Droozor", "Kelimar").replace("13", "40").replace("Ostanetavo", "Brion")
    twisted = other.replace("Brion", "Velora")  # two names became one
    d, i = tables(spark, [(1, ITEM), (2, other), (3, twisted), (4, "Some quite other text about a mill and a gate at dawn that goes on and on for long.")], [(1, ITEM)])
    got = {r.doc_id: (r.windows, r.changed) for r in leakage.reparameterised(d.drop("item_id"), i).collect()}
    assert set(got) == {2, 3} and got[2][0] > got[3][0] and got[2][1] >= 2, got


def pairs(spark, docs, items):
    d, i = tables(spark, docs, items)
    return {(r.doc_id, r.item_id): (r.windows, r.changed) for r in leakage.reparameterised(d.drop("item_id"), i).collect()}


def test_placeholders_only_bring_no_pairs(spark):
    """Number tables, lists of names and texts in a script without case match nothing that isn't shared."""
    rng = random.Random(5)
    numbers = lambda: " ".join(str(rng.randint(0, 10**9)) for _ in range(2000))
    names = lambda: " ".join(rng.choice("BCDFG") + "".join(rng.choice("aeiou") for _ in range(9)) for _ in range(500))
    arabic = lambda a: " ".join("".join(chr(rng.randint(a, a + 9)) for _ in range(6)) for _ in range(300))
    docs, items = [(1, numbers()), (2, names()), (3, arabic(0x627))], [(1, numbers()), (2, names()), (3, arabic(0x633))]
    assert run(spark, docs, items) == set() and pairs(spark, docs, items) == {}
    words_ = arabic(0x627).split()
    assert run(spark, [(1, " ".join(words_[50:70]))], [(1, " ".join(words_))]) == {(1, 1)}
    assert "ا" in "".join(leakage.own_vocabulary(tables(spark, [], [(1, "ابب Zed low")])[1])) and leakage.own_vocabulary(tables(spark, [], [(1, "Zed low kg 7")])[1]) == ["low"]


def test_slots_of_other_length(spark):
    """Names of several words and numbers with a point are one slot each."""
    docs = [(1, ITEM.replace("Pelemund", "Bad Velora am Krane").replace("13", "3.5")), (2, ITEM.replace("Droozor", "Anna").replace("Skaogrim", "Anna"))]
    got = pairs(spark, docs, [(1, ITEM)])
    assert got[1, 1][1] >= 1 and got[1, 1][0] == max(w for w, _ in got.values())
    assert got[2, 1][0] < got[1, 1][0]


def test_renaming_holds_over_the_whole_pair(spark):
    a = "in the long winter the old miller X waited for the cold wind to turn the mill. "
    b = "at last the young baker Y came down from the hills with the empty sacks again. "
    c = "so in the end X and the others sold the flour at the market by the river. "
    item = (a + b + c).replace("X", "Droozor").replace("Y", "Sela")
    right = (a + b + c).replace("X", "Kelim").replace("Y", "Oruna")
    wrong = a.replace("X", "Kelim") + b.replace("Y", "Oruna") + c.replace("X", "Zubor")
    got = pairs(spark, [(1, right), (2, wrong)], [(1, item)])
    assert got[1, 1][0] > got[2, 1][0] > 0


def test_planted_reparameterisations(spark):
    """Of items whose names and numbers were all replaced, all documents are found, and no others."""
    rng = random.Random(9)
    low = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) for _ in range(300)]
    low = [w for w in low if w not in leakage.UNITS]
    name = lambda: "".join(rng.choice("BDGKLMNPRSTVZ") + rng.choice("aeiou") + rng.choice("xqwy") for _ in range(1)) + str(rng.choice("aeiou")) + "zz"
    items, docs = [], []
    for i in range(40):
        shape = [rng.choice("wwwwwwnd") for _ in range(40)]
        fixed = [rng.choice(low) for _ in shape]
        fill = lambda: " ".join(w if s == "w" else name() if s == "n" else str(rng.randint(0, 999)) for s, w in zip(shape, fixed))
        items.append((i, fill()))
        docs.append((i, "Zz " + fill() + "."))
        docs.append((1000 + i, " ".join(rng.choice(low) for _ in range(40))))
    found = set(pairs(spark, docs, items))
    assert len({(i, i) for i in range(40)} & found) >= 0.9 * 40 and all(d == i for d, i in found)


def test_filter_before_the_shuffle_and_small_vocabulary(spark, monkeypatch):
    docs = [(1, ITEM), (2, ITEM.replace("Pelemund", "Velora")), (3, "nothing of it " * 9)]
    want = pairs(spark, docs, [(1, ITEM)])
    monkeypatch.setattr(leakage, "BROADCAST_WINDOWS", 1)
    assert pairs(spark, docs, [(1, ITEM)]) == want and (2, 1) in want
    monkeypatch.setattr(leakage, "VOCABULARY", 3)
    assert run(spark, docs, [(1, ITEM)]) == brute(docs, [(1, ITEM)], 12)
