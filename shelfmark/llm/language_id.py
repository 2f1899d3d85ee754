"""Language identification by prediction by partial matching (PPM).

Per language, a tree of byte contexts of up to ORDER bytes counts which byte
follows. A byte that a context has seen costs its share of count / (count sum
+ kinds); else the escape kinds / (sum + kinds) is paid and the next shorter
context is asked, down to a uniform byte. Statistics are frozen after
training, so a byte's code length depends on it and the ORDER bytes before it
alone: each batch looks up its distinct runs of ORDER + 1 bytes and sums. A
text is coded as its words with single spaces, after ORDER spaces; contexts
reach over words. A text gets the language with the shortest code.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import begin, fresh, held_out

#: Longest context in bytes (a run, the context and its byte, is a 64-bit key; 7 at most).
ORDER = 4
#: Labelled documents per language that statistics are learned from, about, at most.
DOCS_PER_LANGUAGE = 1_000
#: Bytes coded at once; longer texts go piece by piece.
PIECE = 1 << 18
UNKNOWN = "und"
_LETTER = r"\p{L}"
_START = b" " * ORDER


def coded(text: str) -> bytes:
    """The bytes that stand for a text: ORDER spaces, then words, each with a space after it."""
    words = text.encode().split()
    return _START + b" ".join(words) + b" " if words else _START


def runs(raw: np.ndarray) -> np.ndarray:
    """The key of each byte from the ORDER-th on: the bytes before it and it, as one number."""
    keys = np.zeros(max(0, len(raw) - ORDER), np.uint64)
    for j in range(ORDER + 1):
        keys = keys << np.uint64(8) | raw[j : len(keys) + j]
    return keys


def count_runs(texts: DataFrame) -> DataFrame:
    """(lang, text) to (lang, key, n): how often each run of ORDER + 1 bytes is in a language's texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("language_id")
        for batch in batches:
            for low in range(0, len(batch), 64):
                part = batch.slice(low, 64)
                langs = part.column(0).to_pylist()
                bytes_of = [coded(t) for t in part.column(1).to_pylist()]
                for lang in sorted(set(langs)):
                    keys = [runs(np.frombuffer(b, np.uint8)) for b, x in zip(bytes_of, langs, strict=True) if x == lang]
                    found, n = np.unique(np.concatenate(keys), return_counts=True)
                    yield pa.record_batch(
                        [pa.array([lang] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))],
                        names=["lang", "key", "n"],
                    )

    found = texts.select("lang", "text").mapInArrow(count, "lang string, key long, n long")
    return found.groupBy("lang", "key").agg(F.sum("n").alias("n"))


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in a sorted table, and which of them are there."""
    at = np.minimum(np.searchsorted(table, keys), max(0, len(table) - 1))
    return at, table[at] == keys if len(table) else np.zeros(len(keys), bool)


class Model:
    """Frozen statistics: by order, sorted runs with code lengths and sorted contexts with escapes (bits by language)."""

    def __init__(self, langs: list[str], counts: list[tuple[np.ndarray, np.ndarray]]):
        self.langs, size = langs, len(langs)
        longest = np.unique(np.concatenate([k for k, _ in counts])) if size else np.zeros(0, np.uint64)
        table = np.zeros((len(longest), size))
        for j, (keys, n) in enumerate(counts):
            table[np.searchsorted(longest, keys), j] = n
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for k in range(ORDER + 1):
            # Every byte has a full context, so shorter runs count what the longest ones with their end count.
            keys, of = np.unique(longest & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
            seen = np.zeros((len(keys), size))
            np.add.at(seen, of, table)
            contexts, owner = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, kinds = np.zeros((len(contexts), size)), np.zeros((len(contexts), size))
            np.add.at(total, owner, seen)
            np.add.at(kinds, owner, seen > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                own = -np.log2(seen / (total + kinds)[owner])
            shorter = self.bits(keys & np.uint64((1 << 8 * k) - 1), k - 1)
            self.levels.append((keys, np.where(seen > 0, own, escape[owner] + shorter), contexts, escape))

    def bits(self, keys: np.ndarray, k: int = ORDER) -> np.ndarray:
        """Code lengths by language of the last byte of runs of k + 1 bytes."""
        if k < 0:
            return np.full((len(keys), len(self.langs)), 8.0)
        known, cost, contexts, escape = self.levels[k]
        at, hit = _find(known, keys)
        out = np.zeros((len(keys), len(self.langs)))
        out[hit] = cost[at[hit]]
        if len(missed := np.flatnonzero(~hit)):
            place, seen = _find(contexts, keys[missed] >> np.uint64(8))
            out[missed[seen]] = escape[place[seen]]
            out[missed] += self.bits(keys[missed] & np.uint64((1 << 8 * k) - 1), k - 1)
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text (as :func:`coded`) under each language."""
        raw = np.frombuffer(b"".join(texts), np.uint8)
        starts = np.r_[0, np.cumsum([len(t) for t in texts])]
        out = np.zeros((len(texts), len(self.langs)))
        for low in range(0, len(raw) - ORDER, PIECE):
            keys = runs(raw[low : low + PIECE + ORDER])
            at = np.arange(low + ORDER, low + ORDER + len(keys))
            text = np.searchsorted(starts, at, "right") - 1
            inside = at - starts[text] >= ORDER  # not among the spaces that a text starts with
            found, which = np.unique(keys[inside], return_inverse=True)
            bits = self.bits(found)
            for j in range(len(self.langs)):
                out[:, j] += np.bincount(text[inside], bits[which, j], len(texts))
        return out


def train(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE) -> Model:
    """Learn from rows with text and lang that are not held out.

    At most about ``per_language`` documents of a language, chosen by a hash
    of their id, are read; the counts are summed on the executors, and only
    counts of distinct runs (bounded with the sample) reach the driver.
    """
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    # One number per language, a column of few values.
    chances = {r["lang"]: min(1.0, per_language / r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    chance = F.lit(0.0)
    for lang, share in chances.items():
        chance = F.when(F.col("lang") == lang, share).otherwise(chance)
    drawn = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("lid")), F.lit(1 << 20)) < chance * (1 << 20)
    return model_of(count_runs(rows.where(drawn)))


def model_of(counted: DataFrame) -> Model:
    """The model of counted runs, gathered as columns."""
    found = counted.select("lang", "key", "n").toArrow()
    lang = found["lang"].combine_chunks().dictionary_encode()
    keys, n = found["key"].to_numpy().view(np.uint64), found["n"].to_numpy()
    names, of = lang.dictionary.to_pylist(), lang.indices.to_numpy()
    del found
    langs, counts = sorted(names), []
    for name in langs:
        mine = np.flatnonzero(of == names.index(name))
        mine = mine[np.argsort(keys[mine])]
        counts.append((keys[mine], n[mine]))
    return Model(langs, counts)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Adds lang_pred, score and bits_per_byte to every row of (doc_id, text, ...).

    ``lang_pred`` is ``und`` with score 0 for a null text, a text without any
    letter, or where nothing was learned; ties go to the first language by
    name. ``score`` is the chosen language's share if all were as likely
    before. Other columns (but those of the added names), repeated rows and
    empty tables pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = "lang_pred string, score double, bits_per_byte double"

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("language_id")
        model = shared.value
        for batch in batches:
            for low in range(0, len(batch), 256):
                part = batch.slice(low, 256)
                texts, letters = part.column(place).to_pylist(), part.column(lettered).to_pylist()
                langs, scores, rates = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
                mine = [i for i, yes in enumerate(letters) if yes and model.langs]
                bytes_of = [coded(texts[i]) for i in mine]
                for i, code, bits in zip(mine, bytes_of, model.code_lengths(bytes_of), strict=True):
                    best = int(np.argmin(bits))
                    langs[i] = model.langs[best]
                    scores[i] = float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum())
                    rates[i] = float(bits[best] / (len(code) - ORDER))
                kept = [part.column(c) for c in names]
                yield pa.record_batch(
                    [*kept, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())],
                    names=[*names, "lang_pred", "score", "bits_per_byte"],
                )

    names = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "bits_per_byte")]
    docs = docs.select(*[F.col(f"`{c}`") for c in names])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    lettered, place = fresh(docs, "_letter"), [c.lower() for c in names].index("text")
    letter = F.coalesce(F.col("text").rlike(_LETTER), F.lit(False))
    return docs.select("*", letter.alias(lettered)).mapInArrow(predict, f"{kinds}, {fields}")
