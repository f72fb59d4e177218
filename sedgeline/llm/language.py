"""Language identification with string kernels.

The kernel of two texts is the blended-spectrum presence kernel: the number of distinct character n-grams (n = 1 to
``N_MAX``) that both hold, divided by the root of the product of both texts' own numbers.  ``LANDMARKS`` training texts
for each language span a Nyström approximation, in which one kernel ridge regression for each language (one versus the
rest) is fitted to at most ``TRAIN_PER_LANG`` texts a language.  Scoring is batched: an n-gram presence matrix of the
batch times that of the landmarks gives the kernel values, these times the coefficients the scores of all languages.

Training rows have a language and are not held out; they are chosen by a hash of the id with a chance set by the
language's count, so the sample is bounded and each language is found however rare.  Executors turn the chosen texts,
whole, into their distinct n-grams; only these, which grow with the alphabet instead of the text, come to the driver.
Predictions see the text alone.

Texts are lower-cased; runs of white space count as one space; whole texts are used.  Characters that no landmark has share one code.

Defined results: a text that is null or has no letter is ``und`` with score 0; with no training row at all, every text
is.  Null ids are never training rows and count as not held out.  Rows that repeat are predicted each.  An empty table
gives an empty table.  Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgeline.llm.scratch import small_batches

N_MAX = 3
LANDMARKS = 24
TRAIN_PER_LANG = 150
RIDGE = 1e-3
SHARPNESS = 8.0
FOLDS = 5
UNKNOWN = "und"
BATCH_DOCS = 256

_SPACE = re.compile(r"\s+")


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(FOLDS)) == 0, F.lit(False))


class Alphabet:
    """Codes of characters: 1 for any that is not known, then the known ones."""

    def __init__(self, samples: list[list[str]]):
        known = sorted({g for grams in samples for g in grams if len(g) == 1})
        self.table = np.ones(max(map(ord, known), default=0) + 2, np.uint32)
        self.table[[ord(c) for c in known]] = np.arange(2, len(known) + 2)
        self.bits = np.uint64(max(1, (len(known) + 2).bit_length()))  # at most 21, so three codes fit a number

    def _codes(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return self.table[np.minimum(points, len(self.table) - 1)].astype(np.uint32 if 3 * self.bits <= 32 else np.uint64)

    def grams(self, text: str) -> np.ndarray:
        """The distinct n-grams of a text, as sorted numbers.  Shorter ones have zeros in front."""
        codes = self._codes(_clean(text))
        bits, grams, parts = codes.dtype.type(self.bits), codes, [_distinct(codes)]
        for n in range(2, N_MAX + 1):
            grams = (grams[:-1] << bits) | codes[n - 1 :]
            parts.append(_distinct(grams))
        return np.concatenate(parts).astype(np.uint64)

    def coded(self, grams: list[str]) -> np.ndarray:
        """The same numbers from a text's n-grams."""
        parts = []
        for n in range(1, N_MAX + 1):
            codes = self._codes("".join(g for g in grams if len(g) == n)).reshape(-1, n)
            number = codes[:, 0]
            for k in range(1, n):
                number = (number << codes.dtype.type(self.bits)) | codes[:, k]
            parts.append(_distinct(number))
        return np.concatenate(parts).astype(np.uint64)


def distinct_grams(text: str) -> list[str]:
    """The distinct n-grams of a text, n from 1 to ``N_MAX``."""
    t = _clean(text)
    return sorted({t[i : i + n] for n in range(1, N_MAX + 1) for i in range(len(t) - n + 1)})


def _clean(text: str) -> str:
    return _SPACE.sub(" ", text.lower())


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate((np.ones(min(1, len(x)), bool), x[1:] != x[:-1]))]


class Model:
    """Alphabet, landmark n-grams and coefficients; small enough to be sent with the tasks."""

    def __init__(self, samples: list[list[str]], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE):
        """``samples``: the distinct n-grams of training texts."""
        self.langs = sorted(set(langs))
        if not self.langs:
            return
        by_lang = {g: [s for s, h in zip(samples, langs, strict=True) if h == g] for g in self.langs}
        marks = [s for g in self.langs for s in by_lang[g][:landmarks]]
        self.alphabet = Alphabet(marks)
        coded = [self.alphabet.coded(s) for s in marks]
        self.vocab = np.unique(np.concatenate(coded))
        self.marks = np.zeros((len(self.vocab), len(marks)), np.float32)
        for i, g in enumerate(coded):
            self.marks[np.searchsorted(self.vocab, g), i] = 1 / np.sqrt(max(1, len(g)))
        # Nyström features are the kernel values with the landmarks times the inverse root of the landmarks' own kernel
        values, vectors = np.linalg.eigh(self._kernel(coded).astype(np.float64))
        good = values > 1e-6 * values.max()
        root = vectors[:, good] / np.sqrt(values[good])
        f = self._kernel([self.alphabet.coded(s) for s in samples]).astype(np.float64) @ root
        y = np.array([[1.0 if h == g else -1.0 for g in self.langs] for h in langs])
        weight = np.array([1 / len(by_lang[h]) for h in langs])[:, None]  # languages count alike
        bias = np.ones((len(f), 1))
        f1 = np.hstack([f, bias])
        solved = np.linalg.solve(f1.T @ (weight * f1) + ridge * np.eye(f1.shape[1]), f1.T @ (weight * y))
        self.coefficients, self.bias = (root @ solved[:-1]).astype(np.float32), solved[-1].astype(np.float32)

    def kernel(self, texts: list[str]) -> np.ndarray:
        """Kernel values of texts with the landmarks."""
        return self._kernel([self.alphabet.grams(t) for t in texts])

    def _kernel(self, coded: list[np.ndarray]) -> np.ndarray:
        present = np.zeros((len(coded), len(self.vocab)), np.float32)
        for i, g in enumerate(coded):
            at = np.minimum(np.searchsorted(self.vocab, g), len(self.vocab) - 1)
            present[i, at[self.vocab[at] == g]] = 1 / np.sqrt(max(1, len(g)))
        return present @ self.marks

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        some = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if self.langs else []
        if some:
            raw = self.kernel([texts[i] for i in some]) @ self.coefficients + self.bias
            soft = np.exp(SHARPNESS * (raw - raw.max(axis=1, keepdims=True)) / 2)
            best, sure = raw.argmax(axis=1), 1 / soft.sum(axis=1)
            for i, b, s in zip(some, best.tolist(), sure.tolist(), strict=True):
                lang[i], score[i] = self.langs[b], min(1.0, s)
        return lang, score


def _grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small_batches(batches, BATCH_DOCS):
        grams = pa.array([distinct_grams(t.as_py()) for t in b.column(3)], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([*b.columns[:3], grams], names=["lang", "h", "doc_id", "grams"])


def training_sample(rows: DataFrame, per_lang: int = TRAIN_PER_LANG) -> tuple[list[list[str]], list[str]]:
    """Distinct n-grams of at most ``per_lang`` texts of each language from the rows ``doc_id, text, lang`` that are not
    held out."""
    usable = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = usable.groupBy("lang").count().collect()  # a row for each language
    # three times as many as needed are let through, so that more than enough come by chance
    chance = [(r["lang"], min(1.0, 3 * per_lang / r["count"])) for r in counts]
    if not chance:
        return [], []
    u = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = usable.join(F.broadcast(rows.sparkSession.createDataFrame(chance, "lang string, chance double")), "lang").where(u < F.col("chance"))
    drawn = drawn.select("lang", F.xxhash64("doc_id", F.lit(11)).alias("h"), F.col("doc_id").cast("string").alias("doc_id"), "text")
    out = sorted(drawn.mapInArrow(_grams_of, "lang string, h long, doc_id string, grams array<string>").collect())
    samples, langs, seen = [], [], {}
    for r in out:
        seen[r["lang"]] = seen.get(r["lang"], 0) + 1
        if seen[r["lang"]] <= per_lang:
            samples.append(r["grams"])
            langs.append(r["lang"])
    return samples, langs


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = TRAIN_PER_LANG) -> Model:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return Model(*training_sample(rows, per_lang))


def languages(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: ``doc_id, held_out, lang_pred, score``."""
    sent = docs.sparkSession.sparkContext.broadcast(model or learn(docs, id_col, text_col, lang_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, BATCH_DOCS):
            lang, score = sent.value.predict(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
