"""Quality rules by line labelling: a linear-chain conditional random field marks lines as content or boilerplate.

A text's lines are a chain with two labels.  Each line has ``FEATURES``; the Viterbi path of the field's weights gives
the labels, and the share of a text's characters on content lines decides whether it is kept.  The weights are fitted
by gradient ascent on the conditional likelihood, from a sample of at most ``SAMPLE_DOCS`` labelled documents of up to
``SAMPLE_CHARS`` characters, whose lines take the document's quality as a weak label; where there are no labels of both
kinds, ``DEFAULT`` serves.  Texts that are judged are whole, whatever their length.

Before the field's verdict come fixed rules (``base_failed``): fewer than ``MIN_WORDS`` words, or more than half of the
words in repeated three-word windows.

All counts are vectorised over the characters of a batch of documents, which is bounded by bytes; lines that only one
document of the batch still has are labelled in one plain loop.  An id that occurs in several rows or labels gives one
sample, the smallest by text digest and label.  Defined results: a null or empty text has no
words and fails; lines are split at line feeds only; repeated rows and null ids are judged like any other; an empty
table gives an empty table.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgeline.llm.scratch import small_batches

SAMPLE_DOCS, SAMPLE_CHARS = 1500, 200_000
MIN_WORDS = 50
MIN_CONTENT = 0.5
BATCH_DOCS = 256
KEEP_COST = 8.0

SYMBOLS = "#*$%&|<>"
FEATURES = ("bias", "capitals", "symbols", "bars", "bangs", "digits", "repeated", "short", "blank")
#: Weights for content against boilerplate, and the reward for keeping the label of the line before.
DEFAULT = np.array([1.5, -4.0, -8.0, -8.0, -4.0, -2.0, -2.5, -0.3, 0.0, 1.0])

_UPPER, _SYMBOL, _BAR, _BANG, _DIGIT, _SPACE, _LETTER = (1 << k for k in range(7))
_CLASS = np.zeros(129, np.uint8)  # by ASCII code; 128 stands for all others, which count as letters
_CLASS[ord("A") : ord("Z") + 1] = _UPPER | _LETTER
_CLASS[ord("a") : ord("z") + 1] = _LETTER
_CLASS[128] = _LETTER
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
for _c in SYMBOLS:
    _CLASS[ord(_c)] = _SYMBOL
_CLASS[ord("|")] |= _BAR
_CLASS[ord("!")] = _BANG
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE


def word_counts(text: str) -> tuple[int, int, int]:
    """Words, their characters, and the words in three-word windows that occur twice or more."""
    words = text.encode("utf-8", "replace").split()
    spaces = sum(map(text.count, " \t\n\x0b\x0c\r"))
    if len(words) < 4:
        return len(words), len(text) - spaces, 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    if len(number) < 1 << 21:
        windows = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    else:
        pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
        windows = pairs[:-1] * len(number) + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    hit = np.zeros(len(words) + 2, bool)
    at = np.concatenate((order[1:][same], order[:-1][same]))
    hit[at] = hit[at + 1] = hit[at + 2] = True
    return len(words), len(text) - spaces, int(hit.sum())


class Lines:
    """Features of all lines of a batch of texts, as arrays over lines."""

    def __init__(self, texts: list[str]):
        self.per_doc = np.array([t.count("\n") + 1 for t in texts], np.int64)
        self.doc = np.repeat(np.arange(len(texts)), self.per_doc)
        joined = "\n".join(texts) + "\n" if texts else ""
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = _CLASS[np.minimum(codes, 128)]
        ends = np.flatnonzero(codes == 10)
        starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends

        def count(mask: int) -> np.ndarray:
            return np.add.reduceat((kinds & mask) != 0, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)

        self.chars = ends - starts
        self.visible = self.chars + 1 - count(_SPACE)  # each line's feed is white space too
        symbols, bars, bangs, digits, letters = map(count, (_SYMBOL, _BAR, _BANG, _DIGIT, _LETTER))
        self.repeated = self._repeats(texts)
        self.symbols = np.bincount(self.doc, symbols, len(texts)).astype(np.int64)
        self.dup_lines = np.bincount(self.doc, self.repeated & (self.visible > 0), len(texts)).astype(np.int64)
        some = np.maximum(self.visible, 1)
        self.features = np.stack(
            [
                np.ones(len(ends)), np.minimum(1, 2 * count(_UPPER) / np.maximum(letters, 8)), np.minimum(1, 8 * (symbols - bars) / some),
                np.minimum(1, 8 * bars / some), np.minimum(1, 16 * bangs / some), np.minimum(1, 2 * digits / some), self.repeated & (self.visible > 0),
                self.visible < 15, self.visible == 0,
            ], axis=1,
        ).astype(np.float64)

    @staticmethod
    def _repeats(texts: list[str]) -> np.ndarray:
        out = []
        for t in texts:
            seen: set[str] = set()
            for line in t.split("\n"):
                out.append(line in seen)
                seen.add(line)
        return np.array(out, bool)

    def chains(self, shared: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each line number: the chains that are that long, and their lines; if asked, only as far as two are."""
        first = np.cumsum(self.per_doc) - self.per_doc
        order = np.argsort(-self.per_doc, kind="stable")
        sizes = -self.per_doc[order]
        most = -int(sizes[1]) if shared and len(sizes) > 1 else int(self.per_doc.max(initial=0)) if not shared else min(1, len(sizes))
        for k in range(most):
            alive = order[: np.searchsorted(sizes, -k, side="left")]
            yield alive, first[alive] + k


def _viterbi_alone(score: np.ndarray, stay: float, best: tuple[float, float]) -> tuple[np.ndarray, tuple[float, float]]:
    """Back pointers of one chain's further lines, and the scores of its paths at the end."""
    junk, content = best
    back = np.zeros((len(score), 2), np.int8)
    for k, s in enumerate(score.tolist()):
        from_junk, from_content = junk + stay >= content, content + stay >= junk
        back[k, 0], back[k, 1] = 0 if from_junk else 1, 1 if from_content else 0
        junk, content = (junk + stay if from_junk else content), (content + stay if from_content else junk) + s
    return back, (junk, content)


def viterbi(lines: Lines, weights: np.ndarray) -> np.ndarray:
    """Best labels of all lines: true for content."""
    score, stay = lines.features @ weights[:-1], weights[-1]
    best = np.zeros((len(lines.per_doc), 2))  # of paths that end in boilerplate, in content
    back = np.zeros((len(score), 2), np.int8)
    steps = list(lines.chains(shared=True))
    for k, (docs, at) in enumerate(steps):
        if k:
            from_other = best[docs][:, ::-1]
            same = best[docs] + stay
            back[at] = np.where(same >= from_other, [0, 1], [1, 0])
            best[docs] = np.maximum(same, from_other)
        best[docs, 1] += score[at]
    label = np.zeros(len(score), bool)
    longest = int(np.argmax(lines.per_doc)) if len(lines.per_doc) else 0
    first = int(lines.per_doc[:longest].sum())
    a, b = first + len(steps), first + int(lines.per_doc[longest]) if len(lines.per_doc) else 0
    if a < b:
        back[a:b], best[longest] = _viterbi_alone(score[a:b], float(stay), tuple(best[longest].tolist()))
    now = np.argmax(best + [0, 1e-12], axis=1)  # a tie is content
    if a < b:
        state, pointers = int(now[longest]), back[a:b].tolist()
        path = [0] * (b - a)
        for k in range(b - a - 1, -1, -1):
            path[k] = state
            state = pointers[k][state]
        label[a:b], now[longest] = np.array(path, bool), state
    for k in range(len(steps) - 1, -1, -1):
        docs, at = steps[k]
        state = now[docs]
        label[at] = state == 1
        now[docs] = back[at, state]
    return label


def fit(texts: list[str], quality: list[int], steps: int = 150, rate: float = 0.2, ridge: float = 1e-3) -> np.ndarray:
    """Weights that maximise the conditional likelihood of the weak line labels (Adam, forward-backward)."""
    if len(set(quality)) < 2:
        return DEFAULT
    lines = Lines(texts)
    x, chains = lines.features, list(lines.chains())
    y = np.repeat(np.array(quality) == 1, lines.per_doc).astype(float)
    # each document weighs as one; those of good quality more, as losing one is the worse mistake
    total = {q: quality.count(q) for q in (0, 1)}
    share = np.array([(KEEP_COST if q == 1 else 1.0) / total[q] for q in quality])
    weight = np.repeat(share / lines.per_doc, lines.per_doc)
    doc_weight = share / lines.per_doc
    same = [(y[at] == y[chains[k - 1][1][: len(at)]]).astype(float) if k else None for k, (_, at) in enumerate(chains)]
    w, m, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for t in range(1, steps + 1):
        score, stay = x @ w[:-1], w[-1]
        node = np.stack([np.zeros_like(score), score], axis=1)
        ahead, behind = np.zeros_like(node), np.zeros_like(node)
        for k, (_, at) in enumerate(chains):
            if k:
                a = ahead[chains[k - 1][1][: len(at)]]
                ahead[at] = np.logaddexp(a + stay, a[:, ::-1])
            ahead[at] += node[at]
        stay_gradient = 0.0
        for k in range(len(chains) - 1, 0, -1):
            docs, at = chains[k]
            prev = chains[k - 1][1][: len(at)]
            b = behind[at] + node[at]
            behind[prev] = np.logaddexp(b + stay, b[:, ::-1])
            total = np.logaddexp.reduce(ahead[prev] + behind[prev], axis=1)
            kept = np.exp(np.logaddexp.reduce(ahead[prev] + b + stay, axis=1) - total)
            stay_gradient += float(((same[k] - kept) * doc_weight[docs]).sum())
        p = np.exp(ahead[:, 1] + behind[:, 1] - np.logaddexp.reduce(ahead + behind, axis=1))
        g = np.append(x.T @ ((y - p) * weight), stay_gradient) - ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[str], list[int]]:
    """At most ``sample_docs`` labelled documents of at most ``SAMPLE_CHARS``, half of each quality, chosen by a hash of the id."""
    usable = labels.select(F.col("doc_id").alias("__sedgeline_id"), F.col("quality").alias("__sedgeline_q")).where("__sedgeline_id is not null and __sedgeline_q in (0, 1)")
    picked = None
    for q in (0, 1):
        some = usable.where(F.col("__sedgeline_q") == q).orderBy(F.xxhash64("__sedgeline_id"), "__sedgeline_id").limit(sample_docs // 2)
        picked = some if picked is None else picked.unionByName(some)
    # at most sample_docs rows are broadcast, and come back with their texts
    rows = docs.join(F.broadcast(picked), F.col(id_col) == F.col("__sedgeline_id")).where(F.length(text_col) <= SAMPLE_CHARS)
    rows = rows.groupBy("__sedgeline_id").agg(F.min(F.struct(F.sha2(F.col(text_col), 256).alias("h"), F.col("__sedgeline_q").alias("q"), F.col(text_col).alias("t"))).alias("r"))
    rows = sorted(rows.select("__sedgeline_id", "r.t", "r.q").collect())
    return [r[1] for r in rows], [int(r[2]) for r in rows]


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


def judge(texts: list[str], weights: np.ndarray) -> list[np.ndarray]:
    """The columns of ``COLUMNS`` for some texts."""
    lines = Lines(texts)
    content = viterbi(lines, weights)
    words = np.array([word_counts(t) for t in texts], np.int64).reshape(-1, 3)
    n_words, word_chars, n_repeat = words.T
    marked = np.bincount(lines.doc, lines.visible * content, len(texts))
    share = marked / np.maximum(1, np.bincount(lines.doc, lines.visible, len(texts)))
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > 50 * n_words)
    # counted over words: a symbol is never white space, so every symbol of the text lies in a word
    return [n_words, word_chars, lines.symbols, lines.dup_lines, n_repeat, failed, ~failed & (share >= MIN_CONTENT), share]


def judged(docs: DataFrame, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns of ``COLUMNS`` in a struct column ``__sedgeline_quality``."""
    schema = docs.schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [c.split()[0] for c in COLUMNS.split(", ")]
        for b in small_batches(batches, BATCH_DOCS):
            texts = [t.as_py() or "" for t in b.column(names.index(text_col))]
            struct = pa.StructArray.from_arrays([pa.array(c) for c in judge(texts, weights)], names=fields)
            yield pa.RecordBatch.from_arrays([*b.columns, struct], names=[*names, "__sedgeline_quality"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return docs.mapInArrow(run, f"{columns}, __sedgeline_quality struct<{COLUMNS.replace(' ', ': ').replace(',:', ',')}>")


def learned_weights(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> np.ndarray:
    return fit(*labelled_sample(docs, labels, sample_docs))


def quality_report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its id and the columns of ``COLUMNS``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return judged(rows, learned_weights(rows, labels)).select("doc_id", "__sedgeline_quality.*")


def keep_quality(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    weights = learned_weights(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels)
    return judged(docs, weights, text_col).where("__sedgeline_quality.kept").select(*docs.columns)
