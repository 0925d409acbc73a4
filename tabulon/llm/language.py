"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities over a fixed public vocabulary of pieces. The probability of a
word is the sum over all its segmentations into pieces (a forward algorithm), and that of a text
is the product over its words. Pieces' probabilities are learned by expectation maximisation over
the distinct words of a bounded sample of labelled documents; a character outside every piece is
one unknown piece.

Texts are lower-cased; words are letters with the marks and letters that follow them, a marker
before each. Pieces of any length count, and words of any length are scored in one go. Whole texts
are scored; only the training sample takes a bounded window of each text, so a label with long texts
alone is learned too.

Null texts and texts without a letter get ``und`` and score 0. Without any labelled rows all texts
get ``und``; an empty table gives an empty result. Equal languages' scores go to the first label in
order. Repeated rows each give a row; all columns pass through, whatever their names.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.common import released, slices

UNKNOWN = "und"
MARK = "▁"
#: In training, words are taken in parts of so many characters at most; in scoring, longer ones are scaled on the way.
PART = 48
#: Training sample: so many documents of each label at most, those of smallest hash of text and id, and of each a window of so many characters, at a place that its hash gives.
SAMPLE_DOCS, SAMPLE_CHARS = 400, 16_384
#: Words times their longest that are scored at once.
CELLS = 60_000
ROUNDS, PRIOR = 3, 0.05
#: Words that a worker keeps the scores of; about 200 bytes each.
TABLE_ENTRIES = 100_000

_BASE = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def _patterns() -> tuple[re.Pattern, re.Pattern]:
    """Any mark; and words where there are marks."""
    marks = [c for c in range(0x300, 0x1F000) if unicodedata.category(chr(c))[0] == "M"]
    marks = "".join(map(chr, marks))
    return re.compile(f"[{marks}]"), re.compile(f"[^\\W\\d_](?:[^\\W\\d_]|[{marks}])*")


_LETTERS = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    text = text.lower()
    if text.isascii() or max(text) < "\u0300":  # before the first mark
        return _LETTERS.findall(text)
    mark, both = _patterns()
    return (both if mark.search(text) else _LETTERS).findall(text)


def parts(word: str) -> list[str]:
    word = MARK + word
    return [word[k : k + PART] for k in range(0, len(word), PART)]


def vocabulary(model: str) -> list[str]:
    """The pieces of a SentencePiece model that lower-cased words can be made of."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)))
    return sorted({p for p in pieces if p == MARK or p == p.lower() and p.lstrip(MARK) and all(unicodedata.category(c)[0] in "LM" for c in p.lstrip(MARK))})


def blocks(order: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of words, sorted longest first, of about CELLS characters' room each."""
    at = 0
    while at < len(order):
        n = max(1, CELLS // max(1, len(order[at])))
        yield at, min(at + n, len(order))
        at += n


class Lattice:
    """The places of pieces in words."""

    def __init__(self, pieces: list[str]):
        self.n, self.longest = len(pieces), max(map(len, pieces), default=1)
        by_length: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            by_length.setdefault(len(p), []).append(i)
        self.tables = {}
        for n, ids in by_length.items():
            h = self._hashes(pieces[i] for i in ids)
            order = np.argsort(h)
            self.tables[n] = (h[order], np.array(ids, np.int32)[order])

    @staticmethod
    def _hashes(pieces) -> np.ndarray:
        out = []
        for p in pieces:
            h = 0
            for c in p:
                h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
            out.append(h)
        return np.array(out, np.uint64)

    def places(self, part: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths, and ids[length - 1, word, start]: the piece there, ``n`` for an unknown character, ``n + 1`` for none. Parts are sorted, longest first."""
        lengths = np.array([len(w) for w in part])
        width = int(lengths.max())
        codes = np.zeros((len(part), width), np.uint64)
        flat = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        inside = np.arange(width) < lengths[:, None]
        codes[inside] = flat + np.uint64(1)
        ids = np.full((min(self.longest, width), len(part), width), self.n + 1, np.int32)
        h = np.zeros_like(codes)
        for n in range(1, len(ids) + 1):
            h = h[:, : width - n + 1] * _BASE + codes[:, n - 1 :]
            ok = inside[:, n - 1 :]
            if n == 1:
                ids[0][ok] = self.n
            if n in self.tables:
                keys, values = self.tables[n]
                at = np.minimum(np.searchsorted(keys, h[ok]), len(keys) - 1)
                hit = keys[at] == h[ok]
                rows, cols = np.nonzero(ok)
                ids[n - 1, rows[hit], cols[hit]] = values[at[hit]]
        return lengths, ids


def forward(lengths: np.ndarray, ids: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Sums over segmentations. p[piece, language], its last row 0; alpha[end, word, language]."""
    width = ids.shape[2]
    alpha = np.zeros((width + 1, len(lengths), p.shape[1]))
    alpha[0] = 1
    for end in range(1, width + 1):
        m = int(np.searchsorted(-lengths, -end, side="right"))  # words that long come first
        for n in range(1, min(end, len(ids)) + 1):
            x = ids[n - 1, :m, end - n]
            rows = np.flatnonzero(x <= len(p) - 2)
            if len(rows):
                alpha[end, rows] += alpha[end - n, rows] * p[x[rows]]
    return alpha


def log_forward(lengths: np.ndarray, ids: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Logarithms of the sums over segmentations of whole words, of any length: what lies within reach of a piece is kept, and scaled on the way."""
    width, reach = ids.shape[2], len(ids)
    shape = (len(lengths), p.shape[1])
    if width <= PART:  # nothing underflows
        return np.log(np.maximum(forward(lengths, ids, p)[lengths, np.arange(len(lengths))], 1e-300))
    near, scale, out = [np.ones(shape)], np.zeros(shape), np.zeros(shape)
    for end in range(1, width + 1):
        m = int(np.searchsorted(-lengths, -end, side="right"))  # words that long come first
        now = np.zeros(shape)
        for n in range(1, min(end, reach) + 1):
            x = ids[n - 1, :m, end - n]
            rows = np.flatnonzero(x <= len(p) - 2)
            if len(rows):
                now[rows] += near[-n][rows] * p[x[rows]]
        near = [*near[1 - reach :], now] if reach > 1 else [now]
        done = slice(int(np.searchsorted(-lengths, -end, side="left")), m)
        out[done] = np.log(np.maximum(now[done], 1e-300)) + scale[done]
        if end % 8 == 0:
            most = np.maximum(np.max(near, axis=0), 1e-300)
            scale[:m] += np.log(most[:m])
            near = [x / most for x in near]
    return out


def expected(lengths: np.ndarray, ids: np.ndarray, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected uses of each piece by each language; weight[word, language]."""
    alpha, width, rows_all = forward(lengths, ids, p), ids.shape[2], np.arange(len(lengths))
    total = alpha[lengths, rows_all]
    beta = np.zeros_like(alpha)
    beta[lengths, rows_all] = weight / np.maximum(total, 1e-300)
    out = np.zeros_like(p)
    for start in range(width - 1, -1, -1):
        for n in range(1, min(len(ids), width - start) + 1):
            x = ids[n - 1, :, start]
            rows = np.flatnonzero(x <= len(p) - 2)
            if len(rows):
                b = p[x[rows]] * beta[start + n, rows]
                beta[start, rows] += b
                np.add.at(out, x[rows], alpha[start, rows] * b)
    return out


@dataclass
class Model:
    pieces: list[str]
    languages: list[str]
    p: np.ndarray  # [piece, then unknown, then none; language]


def train(counts: dict[str, Counter], pieces: list[str], rounds: int = ROUNDS) -> Model:
    """counts: words of each language."""
    languages, lattice = sorted(counts), Lattice(pieces)
    weights: dict[str, np.ndarray] = {}
    for k, lang in enumerate(languages):
        for w, n in counts[lang].items():
            for x in parts(w):
                weights.setdefault(x, np.zeros(len(languages)))[k] += n
    order = sorted(weights, key=lambda w: (-len(w), w))
    parted = [(lattice.places(order[a:b]), np.array([weights[w] for w in order[a:b]])) for a, b in blocks(order)]
    size = np.array([len(x) for x in pieces] + [1, 1], float)
    p = np.repeat((size * 1e-4)[:, None], len(languages), 1)  # longer pieces are tried first
    p[-2], p[-1] = 1e-6, 0
    p /= p.sum(0)
    for _ in range(rounds if languages else 0):
        c = sum(expected(*places, p, w) for places, w in parted)
        c[:-1] += PRIOR
        c[-1] = 0
        p = c / c.sum(0)
    return Model(pieces, languages, p)


class Scorer:
    """Log probabilities of texts by language, with a table of the words seen."""

    def __init__(self, model: Model, entries: int = TABLE_ENTRIES):
        self.model, self.lattice, self.entries = model, Lattice(model.pieces), entries
        self._clear()

    def _clear(self) -> None:
        self.row: dict[str, int] = {}
        self.logp = np.zeros((1024, len(self.model.languages)))

    def score_words(self, new: list[str]) -> np.ndarray:
        """Log probabilities; 0 for words without a letter."""
        out = np.zeros((len(new), len(self.model.languages)))
        order = sorted((k for k, w in enumerate(new) if any(map(str.isalpha, w))), key=lambda k: -len(new[k]))
        marked = [MARK + new[k] for k in order]
        for a, b in blocks(marked):
            out[order[a:b]] = log_forward(*self.lattice.places(marked[a:b]), self.model.p)
        return out

    def learn(self, seen: set[str]) -> None:
        new = [w for w in seen if w not in self.row]
        if len(self.row) + len(new) > self.entries:
            self._clear()
            new = list(seen)
        if new:
            at = len(self.row)
            if at + len(new) > len(self.logp):
                self.logp = np.concatenate([self.logp[:at], np.zeros((max(at + len(new), 2 * len(self.logp)) - at, self.logp.shape[1]))])
            self.row.update((w, at + k) for k, w in enumerate(new))
            self.logp[at : at + len(new)] = self.score_words(new)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.model.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        cut = [words(t or "") for t in texts]
        self.learn(set().union(*cut))
        out = []
        for w in cut:
            total = self.logp[np.fromiter(map(self.row.__getitem__, w), np.int64, len(w))].sum(0) if w else np.zeros(len(self.model.languages))
            if not total.any():
                out.append((UNKNOWN, 0.0))
                continue
            k = int(np.argmax(total))
            out.append((self.model.languages[k], float(1 / np.exp(total - total[k]).sum())))
        return out


def sample(docs: DataFrame, train_on: Column, id_col: str, text_col: str, label_col: str) -> dict[str, Counter]:
    """Word counts of the training sample; ``SAMPLE_DOCS * SAMPLE_CHARS`` characters a label at most come to the driver.

    Labels are counted first, a row a label, so that only about four times the sample is shuffled.
    """
    rows = docs.where(train_on & F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("h"))
    # A window at a place of its own, all of a shorter text.
    start = F.pmod("h", F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS + 1)).cast("int") + 1
    rows = rows.withColumn("u", F.pmod("h", F.lit(1 << 30))).withColumn("text", F.substring("text", start, F.lit(SAMPLE_CHARS)))
    few = F.lit(False)
    for label, n in rows.groupBy("label").count().collect():
        few = few | ((F.col("label") == label) & (F.col("u") < -(-(1 << 32) * SAMPLE_DOCS // n)))
    rank = F.row_number().over(Window.partitionBy("label").orderBy("u", "h", "text"))
    counts: dict[str, Counter] = {}
    for r in rows.where(few).withColumn("rank", rank).where(F.col("rank") <= SAMPLE_DOCS).select("label", "text").collect():
        counts.setdefault(r["label"], Counter()).update(w for w in words(r["text"]) if any(map(str.isalpha, w)))
    return {k: v for k, v in counts.items() if v}


def fit(docs: DataFrame, model: str, train_on: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Model:
    return train(sample(docs, F.lit(True) if train_on is None else train_on, id_col, text_col, label_col), vocabulary(model))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All rows: row struct (all columns as they came), lang_pred, score. One pass, without a shuffle; the model's size is that of the vocabulary."""
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in slices(batches):
            found = scorer.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["row", "lang_pred", "score"])

    return rows.mapInArrow(run, schema)
