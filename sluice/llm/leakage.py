"""Finding held-out texts inside a corpus.

Every text becomes a template: words of the held-out items' own vocabulary stay, numbers, units and all
other words (names) become typed placeholders. Windows of consecutive template words are hashed and
joined, and their slots compared. Copies have the same fillings, so the hash of the fillings is part of
the join and a template that many texts share, such as one of numbers only, brings no pairs. For
re-parameterised copies neighbouring placeholders of one type are one slot, windows need some own words,
and names must be renamed one to one over the whole pair of texts; numbers and units may change freely.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut as _cut

WINDOW = 12
#: Most windows of held-out items that are broadcast. Beyond, corpus windows are filtered by FILTER hash buckets of them, which are broadcast, and the rest is joined by shuffle.
BROADCAST_WINDOWS, FILTER = 200_000, 1 << 22
#: Most words of held-out items that stay in templates, the most frequent ones; rarer words are placeholders.
VOCABULARY = 50_000
#: Own words a window must keep for a re-parameterised match.
LEAST_FIXED = 6
#: Units that may be exchanged for one another.
UNITS = ["mm", "cm", "m", "km", "g", "kg", "mg", "t", "l", "ml", "h", "min", "s", "eur", "usd", "gbp", "c", "f"]
#: Marks of placeholders, which no word holds.
NAME, NUMBER, UNIT = "~", "=", "%"
#: Blocks whose letters with accents are mapped to their base letter.
ACCENTED = [(0xC0, 0x250), (0x370, 0x530), (0x1E00, 0x2000)]


def _base_letters() -> tuple[str, str]:
    src, dst = [], []
    for a, b in ACCENTED:
        for c in map(chr, range(a, b)):
            base = unicodedata.normalize("NFD", c)[0]
            if base != c and c == c.lower():
                src.append(c)
                dst.append(base.lower())
    return "".join(src), "".join(dst)


def plain(text: Column) -> Column:
    """Lower case without accents; null becomes empty. Upper-case sharp s and ss read alike."""
    src, dst = _base_letters()
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.replace(F.translate(F.regexp_replace(low, r"\p{M}+", ""), src, dst), F.lit("ß"), F.lit("ss"))


def words(text: Column) -> Column:
    """The words of a text, runs of letters and digits, in plain form."""
    return F.filter(F.split(plain(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _typed(w: Column, vocabulary: list[str]) -> Column:
    """The placeholder of a word, or null for an own one."""
    return F.when(w.isin(vocabulary), F.lit(None)).when(w.isin(UNITS), UNIT).when(w.rlike(r"\A\p{N}+\z"), NUMBER).otherwise(NAME)


def own_vocabulary(items: DataFrame, text: str = "text") -> list[str]:
    """Plain words that occur uncapitalised, or in a script without case, in the held-out texts: the VOCABULARY most frequent. Others are names."""
    raw = F.explode(F.split(F.coalesce(F.col(text), F.lit("")), r"[^\p{L}\p{N}\p{M}]+"))
    low = items.select(raw.alias("w")).where(F.col("w").rlike(r"\A[\p{Ll}\p{Lo}]")).select(F.explode(words(F.col("w"))).alias("w"))
    most = low.where(~F.col("w").isin(UNITS)).groupBy("w").count().orderBy(F.desc("count"), "w").limit(VOCABULARY)
    return sorted(r[0] for r in most.collect())


def windows(df: DataFrame, key: str, text: str, vocabulary: list[str], size: int = WINDOW) -> DataFrame:
    """(key, h, f): for every window of ``size`` words the hash of its template and the hash of its words. Shorter texts have none."""
    typed = F.transform(F.array(words(F.col(text))), lambda ws: F.struct(ws.alias("w"), F.transform(ws, lambda w: F.coalesce(_typed(w, vocabulary), w)).alias("t")))
    one = df.select(F.col(key), F.explode(typed).alias("x")).where(F.size("x.w") >= size)
    at = F.sequence(F.lit(1), F.size("x.w") - size + 1)
    each = F.transform(at, lambda i: F.struct(F.xxhash64(F.slice(F.col("x.t"), i, size)).alias("h"), F.xxhash64(F.lit(1), F.slice(F.col("x.w"), i, size)).alias("f")))
    return one.select(F.col(key), F.explode(each).alias("y")).select(key, "y.h", "y.f")


def slot_windows(df: DataFrame, key: str, text: str, vocabulary: list[str], size: int = WINDOW) -> DataFrame:
    """(key, h, slots): windows of ``size`` template words, neighbouring placeholders of one type being one, that keep LEAST_FIXED own words; with the slots' fillings, placeholder first."""
    marked = F.transform(words(F.col(text)), lambda w: F.concat(F.coalesce(_typed(w, vocabulary), F.lit("")), w))
    # Marked words hold no blanks, so a run of one type is one match.
    runs = "|".join(f"{m}\\S+(?: {m}\\S+)*+" for m in (NAME, NUMBER, UNIT))
    tokens = F.regexp_extract_all(F.array_join(marked, " "), F.lit(rf"{runs}|\S+"), F.lit(0))
    is_slot = lambda t: F.substr(t, F.lit(1), F.lit(1)).isin(NAME, NUMBER, UNIT)
    both = F.transform(F.array(tokens), lambda ts: F.struct(ts.alias("w"), F.transform(ts, lambda t: F.when(is_slot(t), F.substr(t, F.lit(1), F.lit(1))).otherwise(t)).alias("t")))
    one = df.select(F.col(key), F.explode(both).alias("x")).where(F.size("x.w") >= size)
    at = F.sequence(F.lit(1), F.size("x.w") - size + 1)
    each = F.transform(at, lambda i: F.struct(F.xxhash64(F.slice(F.col("x.t"), i, size)).alias("h"), F.filter(F.slice(F.col("x.w"), i, size), is_slot).alias("slots")))
    return one.select(F.col(key), F.explode(F.filter(each, lambda y: F.size(y["slots"]) <= size - LEAST_FIXED)).alias("y")).select(key, "y.h", "y.slots")


def _join(ours: DataFrame, theirs: DataFrame, on: list[str]) -> DataFrame:
    """Corpus windows with held-out windows; corpus windows that no held-out hash meets are gone before any shuffle."""
    theirs = theirs.distinct()
    if theirs.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS:
        return ours.join(F.broadcast(theirs), on)
    bucket = F.pmod(F.col("h"), F.lit(FILTER))
    return ours.withColumn("b", bucket).join(F.broadcast(theirs.select(bucket.alias("b")).distinct()), "b", "left_semi").drop("b").join(theirs, on)


def leaked(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """(doc id, item id) once for each pair of texts that share ``size`` consecutive words, slots filled alike.

    Case, accents, punctuation and blanks do not count. Null, empty and short texts match nothing;
    repeated rows of one id are one document. Every shared run is found: equal words have equal
    templates, whatever the vocabulary holds. Two hashes of 64 bits stand for a window.
    """
    vocabulary = own_vocabulary(items, text)
    ours, theirs = windows(docs.select(doc_id, text), doc_id, text, vocabulary, size), windows(items.select(item_id, text), item_id, text, vocabulary, size)
    return _join(ours, theirs, ["h", "f"]).select(doc_id, item_id).distinct()


def reparameterised(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """(doc id, item id, windows, changed): texts that repeat an item's wording with other names or numbers.

    Names are renamed one to one over the pair: of the fillings a name slot pairs, those count that are each
    other's most frequent partner (ties by text). ``windows`` is the number of the item's windows without any other
    pairing, ``changed`` the largest number of changed slots in one; pairs in which nothing changed are left out.
    """
    vocabulary = own_vocabulary(items, text)
    ours = slot_windows(docs.select(doc_id, text), doc_id, text, vocabulary, size).withColumnRenamed("slots", "d")
    theirs = slot_windows(items.select(item_id, text), item_id, text, vocabulary, size).withColumnRenamed("slots", "i")
    ids = [doc_id, item_id]
    met = _cut(_join(ours, theirs, ["h"]).select(*ids, "h", F.arrays_zip("i", "d").alias("z")).distinct())
    names = met.select(*ids, "h", "z", F.explode("z").alias("p")).where(F.col("p.i").startswith(NAME)).select(*ids, "h", "z", "p.i", "p.d").distinct()
    n = names.groupBy(*ids, "i", "d").agg(F.count("*").alias("n"))
    rank = lambda by, other: F.row_number().over(Window.partitionBy(*ids, by).orderBy(F.desc("n"), other))
    other = n.withColumn("a", rank("i", "d")).withColumn("b", rank("d", "i")).where((F.col("a") > 1) | (F.col("b") > 1)).select(*ids, "i", "d")
    x, y = names.alias("x"), other.alias("y")
    broken = x.join(y, [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in (*ids, "i", "d")], "left_semi").select(*ids, "h", "z").distinct()
    x, y = met.alias("x"), broken.alias("y")
    kept = x.join(y, [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in (*ids, "h", "z")], "left_anti")
    changed = F.size(F.filter("z", lambda p: p["i"] != p["d"]))
    return kept.groupBy(*ids).agg(F.count_distinct("h", F.transform("z", lambda p: p["i"])).alias("windows"), F.max(changed).alias("changed")).where(F.col("changed") > 0)
