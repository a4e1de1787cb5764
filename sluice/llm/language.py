"""Languages of texts and of the one-language stretches of mixed texts, with calibrated confidence.

A sparse multinomial logistic regression on TF-IDF weights of hashed character n-grams, trained by
follow-the-regularised-leader with elastic-net penalties; a temperature fitted on held-out rows calibrates it.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_LANGUAGE = "und"
#: Dimensions n-grams are hashed to, and their lengths.
DIMENSIONS, LENGTHS = 1 << 16, (1, 2, 3, 4)
#: Most labelled documents used for training besides the clean samples, sentences of each, and most sentences in all.
TRAINING_DOCUMENTS, SENTENCES_EACH, TRAINING_SENTENCES = 2000, 3, 6000
#: Log cost of a change of language between neighbouring sentences.
CHANGE = 1.0
#: Characters from which a sentence counts fully as evidence; shorter ones count in proportion.
ENOUGH = 40
#: Share of held-out labels taken to be wrong, so that the temperature of a faultless model stays bounded.
DOUBT = 0.005
#: Other spellings of some languages. Languages are those of the samples' labels, whether they stand here or not.
NAMES = {
    "en": ["en", "eng", "english"], "de": ["de", "deu", "ger", "german"], "fr": ["fr", "fra", "fre", "french"],
    "es": ["es", "spa", "spanish", "castilian"], "pt": ["pt", "por", "portuguese"], "ru": ["ru", "rus", "russian"], NO_LANGUAGE: [NO_LANGUAGE],
}
SENTENCE = re.compile(r"(?<=[.!?…])[\"'»”’)\]]*\s+")
WORD = re.compile(r"[^\W\d_]")


def _bare(label: Column) -> Column:
    """A label in lower case without its region, '' if it is no code or name."""
    return F.regexp_extract(F.lower(F.trim(label)), r"\A([a-z]+)(?:[-_][a-z0-9]+)*\z", 1)


def label_language(label: Column, languages: tuple[str, ...] = ()) -> Column:
    """The language a label names (code, three-letter code or English name, any case, with or without a region), else null. ``languages`` are codes besides those of NAMES."""
    bare, out = _bare(label), None
    for lang, names in {**{x: [x] for x in languages}, **NAMES}.items():
        out = F.when(bare.isin(names), lang) if out is None else out.when(bare.isin(names), lang)
    return out


def normal(text: str) -> str:
    return " " + re.sub(r"[\W\d_]+", " ", unicodedata.normalize("NFC", text).lower()).strip() + " "


def without_accents(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, count) of all texts' hashed n-grams, sorted by row."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    ends = np.repeat(np.cumsum(lengths), lengths)
    at = np.arange(len(flat))
    # Row and slot in one number, a short one if it fits, as they are sorted.
    kind = np.uint32 if len(texts) <= (1 << 32) // DIMENSIONS else np.int64
    owner = (owner * DIMENSIONS).astype(kind)
    keys = []
    h = np.zeros(len(flat), dtype=np.uint64)
    for n in range(1, max(LENGTHS) + 1):
        if len(flat) < n:
            break
        m = len(flat) - n + 1
        h = (h[:m] * np.uint64(0x9E3779B97F4A7C15) + flat[n - 1 :] + np.uint64(1)) & np.uint64(0xFFFFFFFFFFFFFFFF)
        if n in LENGTHS:
            mixed = h * np.uint64(0xD6E8FEB86659FD93)
            slot = (mixed ^ (mixed >> np.uint64(32))) % np.uint64(DIMENSIONS)
            keys.append((owner[:m] + slot.astype(kind))[at[:m] + n <= ends[:m]])
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    pair = np.sort(np.concatenate(keys))
    first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    n = np.diff(np.append(first, len(pair)))
    pair = pair[first].astype(np.int64)
    return pair // DIMENSIONS, pair % DIMENSIONS, n.astype(np.float64)


#: Weights of small term frequencies.
_TF = 1.0 + np.log(np.arange(1, 65))


def _tf(n: np.ndarray) -> np.ndarray:
    out = _TF[np.minimum(n, 64).astype(np.int64) - 1]
    if len(n) and n.max() > 64:
        out = np.where(n > 64, 1.0 + np.log(n), out)
    return out


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """One row a text, one column a language. ``texts`` are in normal form; one without n-grams gets even odds."""
        size = np.array([max(1, len(t.strip())) for t in texts])
        z = self.logits(texts) * np.minimum(1.0, size / ENOUGH)[:, None] / self.temperature
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        return p / p.sum(axis=1, keepdims=True)

    @cached_property
    def _table(self) -> np.ndarray:
        """For each slot the IDF weight times each language's weight, and by itself."""
        return np.column_stack([self.weights * self.idf[:, None], self.idf]).astype("float32")

    def logits(self, texts: list[str]) -> np.ndarray:
        row, slot, n = ngrams(texts)
        out = np.zeros((len(texts), len(self.languages)))
        if len(row):
            terms = self._table[slot] * _tf(n).astype("float32")[:, None]
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            terms[:, -1] **= 2
            sums = np.add.reduceat(terms, first, axis=0)
            out[row[first]] = sums[:, :-1] / np.sqrt(np.maximum(sums[:, -1:], 1e-24))
        return out


def tf_idf(texts: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    row, slot, n = ngrams(texts)
    x = _tf(n) * idf[slot] if len(n) else n
    norm = np.sqrt(np.bincount(row, weights=x * x, minlength=len(texts)))
    return row, slot, x / np.maximum(norm[row], 1e-12) if len(n) else x


def hash_text(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def document_frequencies(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """In how many texts of ``docs`` each slot occurs, and how many texts there are; each task counts in DIMENSIONS numbers."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(DIMENSIONS, dtype=np.int64), 0
        for b in batches:
            for texts in _pieces(b.column(0).to_pylist()):
                seen += np.bincount(ngrams([normal(t) for t in texts])[1], minlength=DIMENSIONS)
                n += len(texts)
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(seen[used], n))], ["slot", "n"])

    rows = docs.select(F.col(text).alias("t")).where(F.length("t") > 0).mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n")).collect()
    out, n = np.zeros(DIMENSIONS), 0
    for slot, k in rows:
        if slot < 0:
            n = k
        else:
            out[slot] = k
    return out, n


def _pieces(texts: list[str | None], most: int = 1 << 15) -> Iterator[list[str | None]]:
    """Texts in groups of about ``most`` characters, so that what numpy holds at once is bounded by that or one text."""
    piece, size = [], 0
    for t in texts:
        piece.append(t)
        size += len(t) if t else 0
        if size >= most:
            yield piece
            piece, size = [], 0
    if piece:
        yield piece


def train(texts: list[str], labels: list[str], epochs: int = 4, alpha: float = 0.8, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, seed: int = 7, frequencies: tuple[np.ndarray, int] | None = None) -> LanguageModel:
    """FTRL-proximal with L1 and L2 on normal-form texts; a fifth is held out for the temperature, with its copies.

    ``frequencies`` are those of a corpus, of which the IDF weights are made; without them they are the texts' own.
    """
    languages = tuple(sorted(set(labels)))
    y = np.array([languages.index(v) for v in labels])
    row, slot, _ = ngrams(texts)
    df, size = frequencies or (np.bincount(slot, minlength=DIMENSIONS), len(texts))
    idf = np.log((1.0 + size) / (1.0 + df)) + 1.0
    row, slot, x = tf_idf(texts, idf)
    start = np.searchsorted(row, np.arange(len(texts) + 1))
    z, n = np.zeros((DIMENSIONS, len(languages))), np.zeros((DIMENSIONS, len(languages)))

    def weights(at):
        zz = z[at]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    order = np.random.default_rng(seed)
    part = np.array([hash_text(without_accents(t)) % 5 for t in texts])
    held = part == 4 if len(texts) >= 50 else np.zeros(len(texts), bool)
    for _ in range(epochs):
        for i in order.permutation(np.flatnonzero(~held)):
            at, v = slot[start[i] : start[i + 1]], x[start[i] : start[i + 1]]
            w = weights(at)
            s = v @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1.0
            g = v[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    model = LanguageModel(languages, idf, weights(slice(None)), 1.0)
    test = np.flatnonzero(held) if held.any() else np.arange(len(texts))
    logits = model.logits([texts[i] for i in test])

    def loss(t):
        q = logits / t
        q = q - q.max(axis=1, keepdims=True)
        q = q - np.log(np.exp(q).sum(axis=1, keepdims=True))
        return -np.mean((1 - DOUBT) * q[np.arange(len(test)), y[test]] + DOUBT * q.mean(axis=1))

    best = min(np.geomspace(0.05, 5.0, 60), key=loss)
    return LanguageModel(languages, idf.astype("float32"), model.weights.astype("float32"), float(best))


def sentences(text: str) -> list[str]:
    """Sentences with a word; those without are left to their neighbours."""
    return [s for s in SENTENCE.split(text) if s and WORD.search(s)]


def _with_accents_lost(texts: list[str], labels: list[str]) -> tuple[list[str], list[str]]:
    return [normal(t) for t in texts] + [normal(without_accents(t)) for t in texts], labels * 2


def fit(samples: DataFrame, docs: DataFrame | None = None, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> LanguageModel:
    """Trains on clean samples, then once more with sentences of labelled documents on which label and first model agree.

    At most TRAINING_SENTENCES samples and SENTENCES_EACH sentences of TRAINING_DOCUMENTS documents, those of
    the smallest hashed ids, reach the driver; the IDF weights come from all of ``docs``. Every label of the samples
    is a language. Without any usable sample this raises.
    """
    usable = samples.select(F.col(text).alias("t"), F.coalesce(label_language(F.col(lang)), _bare(F.col(lang))).alias("l")).where(F.col("t").isNotNull() & (F.col("l") != "") & (F.col("l") != NO_LANGUAGE))
    rows = usable.orderBy(F.xxhash64("t"), "t").limit(TRAINING_SENTENCES).collect()
    if not rows:
        raise ValueError("no labelled samples")
    texts, labels = [r[0] for r in rows], [r[1] for r in rows]
    model = train(*_with_accents_lost(texts, labels))
    if docs is None:
        return model
    frequencies = document_frequencies(docs, text)
    labelled = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"), label_language(F.col(lang), model.languages).alias("l")).where(F.col("t").isNotNull() & F.col("l").isin(list(model.languages)))
    more = labelled.orderBy(F.xxhash64("i"), "i").limit(TRAINING_DOCUMENTS).select(F.slice(F.split("t", SENTENCE.pattern), 1, SENTENCES_EACH), "l").collect()
    cand = [(s, l) for ts, l in more for s in ts if WORD.search(s)][:TRAINING_SENTENCES]
    if cand:
        p = model.probabilities([normal(s) for s, _ in cand])
        agree = [(s, l) for (s, l), k in zip(cand, p.argmax(axis=1)) if model.languages[k] == l]
        texts, labels = texts + [s for s, _ in agree], labels + [l for _, l in agree]
    return train(*_with_accents_lost(texts, labels), frequencies=frequencies)


def _path(logp: np.ndarray) -> list[int]:
    """The likeliest languages of a text's sentences, a change costing CHANGE."""
    score, back = logp[0], []
    for row in logp[1:]:
        jump = score.max() - CHANGE
        back.append(np.where(score >= jump, np.arange(len(score)), score.argmax()))
        score = np.maximum(score, jump) + row
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def _runs_of(texts: list[str | None], model: LanguageModel) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs in each text, and of all runs in order the language's number (-1: none), the confidence and the sentences."""
    parts = [sentences(t) if t else [] for t in texts]
    flat = [normal(s) for p in parts for s in p]
    counts = np.array([len(p) for p in parts], dtype=np.int64)
    size = np.array([len(s) for p in parts for s in p], dtype=float)
    prob = model.probabilities(flat) if flat else np.zeros((0, len(model.languages)))
    lang = prob.argmax(axis=1)
    ends = np.cumsum(counts)
    starts = ends - counts
    some = counts > 0
    # Where every sentence is likeliest in one language, so is the text: a change would only cost.
    if some.any():
        differ = np.maximum.reduceat(lang, starts[some]) != np.minimum.reduceat(lang, starts[some])
        for i in np.flatnonzero(some)[differ]:
            lang[starts[i] : ends[i]] = _path(np.log(np.maximum(prob[starts[i] : ends[i]], 1e-12)))
    owner = np.repeat(np.arange(len(texts)), counts)
    new = np.ones(len(flat), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (lang[1:] != lang[:-1])
    first = np.flatnonzero(new)
    weighted = prob[np.arange(len(flat)), lang] * size
    confidence = np.add.reduceat(weighted, first) / np.add.reduceat(size, first) if len(first) else np.zeros(0)
    # A text without words is one run of no language.
    of = np.append(owner[first], np.flatnonzero(~some))
    order = np.argsort(of, kind="stable")
    none = np.zeros(len(of) - len(first))
    return (np.maximum(np.bincount(owner[first], minlength=len(texts)), 1), np.append(lang[first], none - 1)[order].astype(np.int64), np.append(confidence, none + 1)[order],
            np.append(np.diff(np.append(first, len(flat))), none)[order].astype(np.int64))


def runs_of(texts: list[str | None], model: LanguageModel) -> list[list[tuple[int, str, float, int]]]:
    """For each text its runs: (number, language, confidence, sentences). Confidence is the probability averaged over characters."""
    names, at, out = [*model.languages, NO_LANGUAGE], 0, []
    each, lang, confidence, n = _runs_of(texts, model)
    for k in each:
        out.append([(i, names[lang[at + i]], float(confidence[at + i]), int(n[at + i])) for i in range(k)])
        at += k
    return out


def _runs(docs: DataFrame, model: LanguageModel, text: str) -> Column:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("run_no", pa.int32()), ("run_lang", pa.string()), ("confidence", pa.float64()), ("n_sentences", pa.int32())])

    @F.arrow_udf("array<struct<run_no:int,run_lang:string,confidence:double,n_sentences:int>>")
    def runs(texts: pa.Array) -> pa.Array:
        now, names, out = shared.value, pa.array([*shared.value.languages, NO_LANGUAGE]), []
        for piece in _pieces(texts.to_pylist()):
            each, lang, confidence, n = _runs_of(piece, now)
            ends = np.cumsum(each)
            number = np.arange(ends[-1]) - np.repeat(ends - each, each)
            columns = [pa.array(number.astype("int32")), names.take(pa.array(np.where(lang < 0, len(names) - 1, lang))), pa.array(confidence), pa.array(n.astype("int32"))]
            out.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype("int32")), pa.StructArray.from_arrays(columns, fields=list(kind))))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(kind))

    return runs(docs[text])


NEW = ("run_no", "run_lang", "confidence", "n_sentences")


def language_runs(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, one row a run: run_no, run_lang, confidence, n_sentences.

    A text without words, an empty and a null one is one run of language ``und`` with confidence 1.
    Columns of these names in ``docs`` are replaced.
    """
    keep = [F.col(f"`{c}`") for c in docs.columns if c != text and c not in NEW]
    return docs.select(*keep, F.explode(_runs(docs, model, text)).alias("__run")).select(*keep, "__run.*")


def wrong_labels(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc id, run_no, lang, confidence): all runs of texts with several languages or a missing or wrong label.

    A label is missing if it names no language; ``und`` is right for a text without words only. Equal
    rows give equal runs once.
    """
    rows = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t"), label_language(F.col(lang), model.languages).alias("l"))
    runs = _runs(rows, model, "t")
    right = (F.size(runs) == 1) & F.coalesce(rows["l"] == F.get(runs, F.lit(0))["run_lang"], F.lit(False))
    bad = rows.select("d", F.explode(F.when(~right, runs)).alias("r"))
    return bad.select(F.col("d").alias(doc_id), "r.run_no", F.col("r.run_lang").alias("lang"), "r.confidence").distinct()
