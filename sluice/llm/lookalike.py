"""One consistent form for texts that look alike but differ in their characters.

Ignorable characters are deleted and compatibility forms resolved. Every remaining word is a lattice of
the letters its characters may stand for; the Viterbi path under character bigrams, with a cost for a
change of script, is its consistent form. Accents stay as they are (in decomposed order while searching).
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of other scripts that look like an ASCII letter.
ALIKE = {
    "a": "аαɑ", "c": "сϲᴄⲥ", "d": "ԁ", "e": "еҽ", "g": "ɡ", "h": "һհ", "i": "іιı", "j": "јϳ", "k": "κ",
    "l": "ӏ", "n": "ո", "o": "оοօⲟ", "p": "рρⲣ", "q": "ԛ", "s": "ѕꜱ", "u": "υս", "v": "νѵᴠ", "w": "ԝѡᴡ",
    "x": "хχ", "y": "уүγ", "z": "ᴢ",
    "A": "АΑᎪ", "B": "ВΒᏴ", "C": "СϹⲤᏟ", "D": "Ꭰ", "E": "ЕΕᎬ", "F": "Ϝ", "G": "ԌᏀ", "H": "НΗᎻ", "I": "ІΙӀⲒ",
    "J": "ЈͿᎫ", "K": "КΚᏦ", "L": "Ꮮ", "M": "МΜᎷ", "N": "ΝⲚ", "O": "ОΟՕⲞ", "P": "РΡⲢᏢ", "Q": "Ԛ", "S": "ЅՏᏚ",
    "T": "ТΤᎢ", "U": "Ս", "V": "ѴᏙ", "W": "ԜᎳ", "X": "ХΧ", "Y": "ΥҮ", "Z": "ΖᏃ",
}
#: Signs that look like an ASCII sign.
SIGNS = {"-": "‐‑‒–﹘⁃˗−➖", "'": "‘’‛′ʹʻʼʽ՚׳", "_": "﹍﹎﹏"}
#: Further characters that are not seen, besides those of category Cf.
UNSEEN = "͏ᅟᅠ឴឵ㅤﾠ" + "".join(map(chr, [*range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]))
#: Log costs of a change of script within a word and of reading a character as another.
SCRIPT_CHANGE, OTHER = -8.0, -0.5
#: Words whose form a worker keeps.
CACHED = 100_000


def _tables() -> tuple[dict[str, tuple[str, ...]], dict[str, str]]:
    """Candidates of each letter: itself if it is of a plain alphabet, and the plain letters of its class; and the signs."""
    plain = lambda c: c.isascii() or "Α" <= c <= "ω" or "А" <= c <= "я"
    to: dict[str, tuple[str, ...]] = {}
    for a, others in ALIKE.items():
        members = a + others
        for c in members:
            to[c] = tuple(dict.fromkeys([*to.get(c, ()), *[c] * plain(c), *filter(plain, members)]))
    return to, {c: a for a, cs in SIGNS.items() for c in cs}


LETTERS, SIGN = _tables()


def _script(c: str) -> int:
    if c.isascii() or c < "ɐ":
        return 0
    return 2 if "Ͱ" <= c < "Ѐ" else 1 if c < "԰" else 3


@lru_cache(maxsize=65536)
def _shape(c: str) -> tuple[str, ...]:
    """What one character contributes: nothing if it isn't seen, itself if it is a look-alike, else its compatibility decomposition."""
    if c in LETTERS or (c.isascii() and c.isprintable()):
        return (c,)
    if c in UNSEEN or unicodedata.category(c) == "Cf":
        return ()
    if c in SIGN:
        return (SIGN[c],)
    if unicodedata.category(c) == "Zs":
        return (" ",)
    return tuple(SIGN.get(x, x) for x in unicodedata.normalize("NFKD", c))


@dataclass
class Reader:
    """Character bigrams and the search. An empty table makes only scripts count."""

    pairs: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        first: dict[str, int] = {}
        for p, n in self.pairs.items():
            first[p[0]] = first.get(p[0], 0) + n
        self._log = {p: math.log((n + 0.1) / (first[p[0]] + 10.0)) for p, n in self.pairs.items()}
        self._new = {c: math.log(0.1 / (n + 10.0)) for c, n in first.items()}
        self._never = math.log(0.01)
        self.word = lru_cache(maxsize=CACHED)(self._word)

    def _step(self, a: str, b: str) -> float:
        s = self._log.get(a + b)
        if s is None:
            s = self._new.get(a, self._never)
        return s + (SCRIPT_CHANGE if a != " " and _script(a) != _script(b) else 0.0)

    def _word(self, word: str) -> str:
        """The likeliest reading of a word's letters; marks are left in place and don't take part."""
        at = [i for i, c in enumerate(word) if unicodedata.category(c)[0] != "M"]
        front: dict[str, tuple[float, tuple | None]] = {" ": (0.0, None)}
        for i in at:
            c = word[i]
            new: dict[str, tuple[float, tuple | None]] = {}
            for r in LETTERS.get(c, (c,)):
                own = 0.0 if r == c else OTHER
                s, back = max(((s + self._step(p, r), p) for p, (s, _) in front.items()), key=lambda x: x[0])
                new[r] = (s + own, (back, front[back][1]))
            front = new
        last, (_, back) = max(front.items(), key=lambda x: x[1][0])
        read = [last]
        while back is not None:
            read.append(back[0])
            back = back[1]
        out = list(word)
        for i, r in zip(at, read[-2::-1]):
            out[i] = r
        return "".join(out)

    def read(self, text: str) -> tuple[str, list[int]]:
        """The consistent form, decomposed, and for each of its characters the place in ``text`` it comes from."""
        out: list[str] = []
        where: list[int] = []
        for i, c in enumerate(text):
            for x in _shape(c):
                out.append(x)
                where.append(i)
        i, n = 0, len(out)
        while i < n:
            if not out[i].isalpha():
                i += 1
                continue
            j = i + 1
            while j < n and (out[j].isalpha() or (not out[j].isascii() and unicodedata.category(out[j])[0] == "M")):
                j += 1
            word = "".join(out[i:j])
            if not word.isascii():
                out[i:j] = self.word(word)
            i = j
        return "".join(out), where


def fit_reader(*texts: Column, frames: list[DataFrame]) -> Reader:
    """Counts the letter bigrams of all rows of clean texts: one column for each frame. What is collected is bounded by the alphabets."""
    counted: dict[str, int] = {}
    for df, text in zip(frames, texts):
        for p, n in df.select(F.explode(_bigrams(text)).alias("p")).groupBy("p").count().collect():
            counted[p] = counted.get(p, 0) + n
    return Reader(counted)


def _bigrams(text: Column) -> Column:
    """Pairs of neighbouring base letters, a blank standing for the ends of words."""

    @F.pandas_udf("array<string>")
    def pairs(b: pd.Series) -> pd.Series:
        def one(t):
            base = "".join(c if c.isalpha() else " " for c in unicodedata.normalize("NFD", t or "") if unicodedata.category(c)[0] != "M")
            base = f" {' '.join(base.split())} " if base.strip() else ""
            return [base[i : i + 2] for i in range(len(base) - 1)]

        return b.map(one)

    return pairs(text)


def canonical(text: Column, reader: Reader) -> Column:
    """The consistent form of each text, composed. ASCII texts are their own and don't leave the JVM; null stays null."""
    pairs = reader.pairs

    @F.pandas_udf("string")
    def form(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        now = Reader(pairs)
        for b in batches:
            yield b.map(lambda t: None if t is None else unicodedata.normalize("NFC", now.read(t)[0]))

    return F.coalesce(form(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


@dataclass(frozen=True)
class Terms:
    """Terms to look for, and their consistent forms."""

    ids: tuple[int, ...]
    texts: tuple[str, ...]

    def matcher(self, reader: Reader):
        import ahocorasick

        tree, by_form = ahocorasick.Automaton(), {}
        for k, t in zip(self.ids, self.texts):
            if form := reader.read(t)[0]:
                by_form.setdefault(form, []).append((k, t))
        for form, owners in by_form.items():
            tree.add_word(form, (len(form), owners))
        tree.make_automaton()
        return tree if by_form else None


def disguised_terms(text: str, tree, reader: Reader) -> list[int]:
    """Ids of the terms a text shows in other characters. The search finds equal forms; the check is on the characters."""
    form, where = reader.read(text)
    found = set()
    for end, (size, owners) in tree.iter(form):
        a = end - size + 1
        after = end + 1 < len(form)
        if after and (unicodedata.category(form[end + 1])[0] == "M" or where[end + 1] == where[end]) or a and where[a - 1] == where[a]:
            continue  # an accent more, or part of a ligature
        stretch = text[where[a] : where[end] + 1]
        for k, t in owners:
            if stretch != t:
                found.add(k)
    return sorted(found)


def ascii_readable(terms: Terms) -> bool:
    """Whether a term that isn't ASCII could be written in ASCII alone."""
    shown = lambda t: all(any(r.isascii() for r in LETTERS.get(c, (c,))) for x in t for c in _shape(x))
    return any(not t.isascii() and shown(t) for t in terms.texts)


def request_texts(tx: DataFrame) -> DataFrame:
    """(tx_id, field, text, coded): path, argument values and body as texts; ``coded`` ones are still percent-encoded."""
    body = F.make_valid_utf8(F.col("request_body").cast("string"))
    row = lambda f, t, c: F.struct(F.lit(f).alias("field"), t.alias("text"), F.lit(c).alias("coded"))
    args = F.transform(F.coalesce("args_get", F.expr("cast(array() as array<struct<name:string,value:string>>)")), lambda a: row("args_get", a["value"], False))
    texts = F.concat(F.array(row("uri", F.substring_index("uri", "?", 1), True), row("body", body, True)), args)
    return tx.select("tx_id", F.explode(F.filter(texts, lambda t: t["text"].isNotNull() & (t["text"] != ""))).alias("t")).select("tx_id", "t.*")


def find_terms(texts: DataFrame, terms: Terms, reader: Reader) -> DataFrame:
    """(tx_id, field, term_id), once each, of texts (tx_id, field, text, coded) that show a term in other characters.

    Texts that are ASCII even when decoded can't, unless a term of another script could be written in
    ASCII; they are dropped before Python sees them. Null and empty texts show nothing.
    """
    pairs = reader.pairs

    @F.pandas_udf("array<long>")
    def search(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        now = Reader(pairs)
        tree = terms.matcher(now)
        for text, coded in batches:
            yield pd.Series([disguised_terms(unquote(t) if c else t, tree, now) if tree else [] for t, c in zip(text, coded)], dtype=object)

    rows = texts.where(F.col("text").isNotNull())
    if not ascii_readable(terms):
        rows = rows.where(F.col("text").rlike(r"[^\x00-\x7F]") | (F.col("coded") & F.col("text").rlike("%[89A-Fa-f][0-9A-Fa-f]")))
    return rows.select("tx_id", "field", F.explode(search("text", "coded")).alias("term_id")).distinct()
