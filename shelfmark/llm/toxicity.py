"""Toxicity by multiple-instance learning over sentences.

Only documents are labelled. A sentence's score is a logistic function of its
words' weights; a document is toxic if any sentence is: noisy-or,
``1 - prod(1 - sentence score)``. Weights are trained from document labels
through the noisy-or, so that the gradient finds the offending sentences.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import begin, held_out

#: Labelled documents of each label that the weights are fitted on, about, at most.
DOCS_PER_LABEL = 2_000
#: Bytes of a word's beginnings that have weights besides the word.
BEGINNINGS = (4, 5, 6)
#: A word has a weight if so many training documents hold it, and if the shares
#: of toxic and clean documents that hold it differ by so many standard errors.
LEAST_DOCUMENTS = 4
LEAST_Z = 4.0
#: Full-batch Adam steps, step size, and L2 weight per word.
STEPS, RATE, DECAY = 120, 0.15, 2e-4
#: Log-odds of a sentence without weighted words, at first.
BIAS = -7.0
PREDICT_AT = 0.7
_STRIP = b".,;:!?\"'()[]{}*#$%&|<>-_"
_ENDS = (b".", b"!", b"?", b";", b"|")
#: Words that a worker remembers before it starts afresh, and words of a text that are summed at once.
WORDS_KEPT, PIECE = 100_000, 50_000


def sentence_starts(words: list[bytes], ends: np.ndarray) -> np.ndarray:
    """Number of the sentence of each word: a new one after a word with an end mark."""
    return np.cumsum(np.r_[0, ends[:-1]]) if len(words) else np.zeros(0, np.int64)


def plain(word: bytes) -> bytes:
    """The word as weighed: lower case (A-Z), without marks around it."""
    return word.lower().strip(_STRIP)


def features(word: bytes) -> list[bytes]:
    """The word and its beginnings: what is weighed of it."""
    bare = plain(word)
    return [bare, *(b"^" + bare[:k] for k in BEGINNINGS if len(bare) > k)] if bare else []


class Weights:
    """Trained weights of words and beginnings, and the bias, in log-odds."""

    def __init__(self, words: dict[bytes, float], bias: float):
        self.words, self.bias = words, bias


def fit(texts: list[str], labels: list[int]) -> Weights:
    """Full-batch gradient descent through the noisy-or over a bounded sample."""
    known: dict[bytes, list[bytes]] = {}
    split = [[known.get(w) or known.setdefault(w, features(w)) for w in t.encode().split()] for t in texts]
    held = (Counter(), Counter())
    for words, label in zip(split, labels, strict=True):
        held[label].update(set().union(*words))
    sizes = [max(1, labels.count(0)), max(1, labels.count(1))]

    def tells(word: bytes) -> bool:
        both = held[0][word] + held[1][word]
        share = both / sum(sizes)
        error = (share * (1 - share) * (1 / sizes[0] + 1 / sizes[1])) ** 0.5
        gap = held[1][word] / sizes[1] - held[0][word] / sizes[0]
        return both >= LEAST_DOCUMENTS and abs(gap) >= LEAST_Z * error > 0

    vocabulary = {w: i for i, w in enumerate(sorted(w for w in held[0].keys() | held[1].keys() if tells(w)))}
    columns, sentences, documents, first = [], [], [], 0
    for d, (text, words) in enumerate(zip(texts, split, strict=True)):
        raw = text.encode().split()
        number = sentence_starts(raw, np.fromiter((w.endswith(_ENDS) for w in raw), np.int64, len(raw)))
        pairs = {
            (s, vocabulary[f]) for s, word in zip(number.tolist(), words, strict=True) for f in word if f in vocabulary
        }
        for s, column in sorted(pairs):
            sentences.append(first + s)
            columns.append(column)
        total = int(number[-1]) + 1 if len(number) else 1
        documents.extend([d] * total)
        first += total
    col, sen, doc = (np.array(x, np.int64) for x in (columns, sentences, documents))
    y, n_words = np.array(labels, float), len(vocabulary)
    balance = np.where(y > 0, len(y) / max(1.0, 2 * y.sum()), len(y) / max(1.0, 2 * (1 - y).sum()))
    theta, m, v = np.zeros(n_words + 1), np.zeros(n_words + 1), np.zeros(n_words + 1)
    theta[-1] = BIAS
    for step in range(1, STEPS + 1):
        z = np.bincount(sen, theta[col], first) + theta[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        clean = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y))
        toxic = np.maximum(-np.expm1(clean), 1e-9)
        # d(-log likelihood)/dz of a sentence: p for clean, -p (1 - P) / P for toxic documents.
        slope = balance[doc] * np.where(y[doc] > 0, -p * np.exp(clean)[doc] / toxic[doc], p) / len(y)
        grad = np.r_[np.bincount(col, slope[sen], n_words), slope.sum()]
        grad[:-1] += DECAY * theta[:-1]
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        theta -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
    weights = {w: float(theta[i]) for w, i in vocabulary.items() if abs(theta[i]) > 1e-3}
    return Weights(weights, float(theta[-1]))


def train(docs: DataFrame, labels: DataFrame, per_label: int = DOCS_PER_LABEL) -> Weights:
    """Fit on labelled rows that are not held out: a bounded sample by a hash of the id.

    About ``per_label`` documents of each label at most are fitted. Null
    texts and null labels teach nothing. Without both labels nothing is
    weighed, and every score is the bias's.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", "toxic").distinct()
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chance = F.lit(0.0)
    for label, n in counts.items():
        chance = F.when(F.col("toxic") == label, min(1.0, per_label / n)).otherwise(chance)
    drawn = known.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("mil")), F.lit(1 << 20)) < chance * (1 << 20))
    # At most about 2 * per_label rows: the bound that the broadcast rests on.
    sample = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    rows = sorted(map(tuple, sample.select("doc_id", "toxic", "text").collect()))
    if len({toxic for _, toxic, _ in rows}) < 2:
        return Weights({}, BIAS)
    return fit([text for _, _, text in rows], [toxic for _, toxic, _ in rows])


class _Lookup(dict):
    """Word to its place in two arrays: its weight, and whether it ends a sentence."""

    def __init__(self, weights: Weights):
        self.weights, self.values = weights.words, np.zeros((2, WORDS_KEPT))

    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self)
        self.values[0, i] = sum(self.weights.get(f, 0.0) for f in features(word))
        self.values[1, i] = word.endswith(_ENDS)
        return i

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Weights and sentence ends of WORDS_KEPT words at most."""
        if len(self) + len(words) > WORDS_KEPT:
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.values[0, at], self.values[1, at].astype(np.int64)


def score_text(text: str | None, weights: Weights, look: _Lookup) -> tuple[float, int, float]:
    """Noisy-or score, the worst sentence's number (-1: no words) and its own score.

    Long texts are summed piece by piece; a sentence over the end of a piece
    stays open. All sums run in the order of the text, so that no number
    depends on where a piece ends.
    """
    words = (text or "").encode().split()
    if not words:
        return 1 / (1 + np.exp(-weights.bias)), -1, 0.0
    clean, done, begun, worst, most = 0.0, 0, 0.0, -1, -1.0
    for low in range(0, len(words), PIECE):
        weighed, ends = look.of(words[low : low + PIECE])
        number = sentence_starts(words, ends)
        z = np.bincount(np.r_[0, number], np.r_[begun, weighed])
        open_ = not ends[-1] and low + PIECE < len(words)
        begun = z[-1] if open_ else 0.0
        z = (z[:-1] if open_ else z) + weights.bias
        if len(z):
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            clean = np.cumsum(np.r_[clean, np.log1p(-np.minimum(p, 1 - 1e-12))])[-1]
            if p.max() > most:
                worst, most = done + int(p.argmax()), float(p.max())
        done += len(z)
    return float(-np.expm1(clean)), worst, most


def score(docs: DataFrame, weights: Weights) -> DataFrame:
    """doc_id, score, predicted, worst_sentence, sentence_score of every row.

    A null or empty text has the score of one sentence without words. Rows
    are scored on their text alone, repeated rows alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("toxicity")
        weights = shared.value
        look = _Lookup(weights)
        for batch in batches:
            for low in range(0, len(batch), 500):
                part = batch.slice(low, 500)
                found = [score_text(t, weights, look) for t in part.column(1).to_pylist()]
                yield pa.record_batch(
                    [
                        part.column(0),
                        pa.array([f[0] for f in found], pa.float64()),
                        pa.array([int(f[0] >= PREDICT_AT) for f in found], pa.int32()),
                        pa.array([f[1] for f in found], pa.int32()),
                        pa.array([f[2] for f in found], pa.float64()),
                    ],
                    names=["doc_id", "score", "predicted", "worst_sentence", "sentence_score"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(
        predict, "doc_id long, score double, predicted int, worst_sentence int, sentence_score double"
    )
