"""Substring dedup by level-wise doubling.

A window of ``length`` words can repeat only if the windows of half that
length inside it repeat. The half level keeps, of every run of
``length - half + 1`` consecutive half windows, the one with the smallest hash
(leftmost of equals): every full window holds a kept half window, and equal
full windows keep the same one. Kept half windows found in one document alone
end there; only around those that repeat are windows of twice the length
formed, and those that also start in a document with a smaller id mark their
words. ``repeated_lengths`` goes on doubling until no candidates survive.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Powers, begin, materialise, word_hashes

#: Odd multipliers of the two rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Windows hashed at once; longer texts go piece by piece.
PIECE = 1 << 15


class Rolling(Powers):
    """Hashes of all windows of a sequence of word hashes."""

    def windows(self, words: np.ndarray, length: int) -> np.ndarray:
        out = [self._piece(words[low : low + PIECE + length - 1], length) for low in range(0, len(words) - length + 1, PIECE)]
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    def _piece(self, words: np.ndarray, length: int) -> np.ndarray:
        n = len(words)
        self.reach(n + 1)
        sums = np.r_[np.uint64(0), np.cumsum(words * self.up[:n])]
        out = (sums[length:] - sums[:-length]) * self.down[: n - length + 1]
        # Spread the bits: low bits of such sums depend on low bits only.
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        return out ^ out >> np.uint64(32)


_ROLL = tuple(Rolling(b) for b in BASES)


def anchors(words: np.ndarray, half: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of kept half windows: the least of each ``span`` consecutive ones."""
    hashes = _ROLL[0].windows(words, half)
    if len(hashes) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = sliding_window_view(hashes, span).argmin(axis=1) + np.arange(len(hashes) - span + 1)
    at = np.unique(least)
    return at, hashes[at]


def _text_key(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def _batches(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, len(batch), rows):
            yield batch.slice(low, rows)


def _scan(docs: DataFrame, length: int, half: int) -> DataFrame:
    """Per row: doc_id, a digest of its words, their number, a digest of them joined, kept half windows."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("substring_dedup")
        for batch in _batches(batches, 1_000):
            keys, counts, joined, kept = [], [], [], []
            for text in batch.column(1).to_pylist():
                words = (text or "").encode().split()
                whole = b" ".join(words)
                keys.append(xxhash.xxh3_128_digest(whole))
                counts.append(len(words))
                joined.append(hashlib.sha256(whole).hexdigest())
                found = anchors(word_hashes(whole), half, length - half + 1)[1] if len(words) >= length else ()
                kept.append(np.unique(found).view(np.int64) if len(found) else np.zeros(0, np.int64))
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array(keys, pa.binary()),
                    pa.array(counts, pa.int64()),
                    pa.array(joined, pa.string()),
                    pa.array(kept, pa.list_(pa.int64())),
                ],
                names=["doc_id", "key", "n_words", "joined", "kept"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(scan, "doc_id long, key binary, n_words long, joined string, kept array<long>")


WINDOWS = "doc_id long, h long, g int, pos int"


def _windows(candidates: DataFrame, length: int, half: int) -> DataFrame:
    """Windows of full length that hold one of the repeated half windows (column ``kept``)."""

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("substring_dedup")
        for batch in _batches(batches, 100):
            ids, hs, gs, ps = [], [], [], []
            rows = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
            for doc_id, text, kept in rows:
                words = word_hashes(text.encode())
                at, hashes = anchors(words, half, length - half + 1)
                at = at[np.isin(hashes.view(np.int64), np.array(kept, np.int64))]
                n = len(words) - length + 1
                change = np.zeros(n + 1, np.int64)
                np.add.at(change, np.maximum(at - (length - half), 0), 1)
                np.add.at(change, np.minimum(at + 1, n), -1)
                pos = np.flatnonzero(np.cumsum(change[:-1]))
                hs.append(_ROLL[0].windows(words, length)[pos].view(np.int64))
                gs.append(_ROLL[1].windows(words, length)[pos].astype(np.uint32).view(np.int32))
                ps.append(pos.astype(np.int32))
                ids.append(np.full(len(pos), doc_id, np.int64))
            yield pa.record_batch(
                [pa.array(np.concatenate(c)) for c in (ids, hs, gs, ps)], names=["doc_id", "h", "g", "pos"]
            )

    return candidates.select("doc_id", "text", "kept").mapInArrow(form, WINDOWS)


def remove_repeats(docs: DataFrame, length: int = 50, with_text: bool = True) -> DataFrame:
    """Remove words covered by a window that also starts in a document with a smaller id.

    Windows are ``length`` consecutive words of the input. Returns per row of
    ``docs``: doc_id, n_words, n_removed, kept_sha256 (of the kept words
    joined by one space) and, ``with_text``, kept_text (null where nothing was
    removed, whose words all stay). Null, empty and short texts have no window and lose
    nothing. Rows of one doc_id do not remove each other's words, unless an
    earlier id has them. Documents of equal words are looked at once: all
    but the smallest id lose every word if they have a window at all. A null
    id counts as smaller than all others. An empty table gives no rows.
    """
    half = (length + 1) // 2
    source = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.col("text")
    )
    scanned = materialise(_scan(source, length, half), "scan")
    with_window = scanned.where(F.col("n_words") >= length)
    firsts = with_window.groupBy("key").agg(F.min("doc_id").alias("first_id"))
    # Half level: kept windows by how many documents hold them; least and greatest id say so.
    held = with_window.select("doc_id", F.explode("kept").alias("anchor"))
    repeated = (
        held.groupBy("anchor")
        .agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        .where("low <> high")
        .select("anchor")
    )
    surviving = held.distinct().join(repeated, "anchor").groupBy("doc_id").agg(F.collect_list("anchor").alias("kept"))
    unique_texts = (
        with_window.select("doc_id", "key").distinct().join(firsts, "key").where("doc_id = first_id").select("doc_id", "key")
    )
    wanted = unique_texts.join(surviving, "doc_id")
    keyed = source.where(F.col("text").isNotNull())
    candidates = materialise(keyed.join(wanted, "doc_id").select("doc_id", "text", "kept"), "candidates")
    # Full level: a window's words go from all documents but the one with the smallest id.
    windows = _windows(candidates, length, half)
    windows = materialise(windows, "windows")
    owners = windows.groupBy("h", "g").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low <> high")
    marks = (
        windows.join(owners.select("h", "g", "low"), ["h", "g"])
        .where("doc_id > low")
        .groupBy("doc_id")
        .agg(F.collect_set("pos").alias("marks"))
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("substring_dedup")
        for batch in _batches(batches, 200):
            keys, removed, digests, texts = [], [], [], []
            for text, marked in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = text.encode().split()
                change = np.zeros(len(words) + 1, np.int64)
                at = np.array(marked, np.int64)
                at = at[at + length <= len(words)]
                np.add.at(change, at, 1)
                np.add.at(change, at + length, -1)
                stays = np.cumsum(change[:-1]) == 0
                kept = b" ".join([w for w, yes in zip(words, stays.tolist(), strict=True) if yes])
                keys.append(_text_key(words))
                removed.append(int(len(words) - stays.sum()))
                digests.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode() if with_text else None)
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array(keys, pa.binary()),
                    pa.array(removed, pa.int64()),
                    pa.array(digests, pa.string()),
                    pa.array(texts, pa.string()),
                ],
                names=["doc_id", "key", "removed", "digest", "kept_text"],
            )

    edited = candidates.join(marks, "doc_id").select("doc_id", "text", "marks")
    edits = edited.mapInArrow(cut, "doc_id long, key binary, removed long, digest string, kept_text string")
    edits = (edits if with_text else edits.drop("kept_text")).dropDuplicates(["doc_id", "key"])
    rows = scanned.select("doc_id", "key", "n_words", "joined").join(firsts, "key", "left")
    rows = rows.join(edits, ["doc_id", "key"], "left")
    copy = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    nothing = hashlib.sha256(b"").hexdigest()
    back = F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id"))
    whole = [F.when(copy, "").otherwise(F.col("kept_text")).alias("kept_text")] if with_text else []
    return rows.select(
        back.alias("doc_id"),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(copy, nothing).otherwise(F.coalesce("digest", "joined")).alias("kept_sha256"),
        *whole,
    )


def repeated_lengths(docs: DataFrame, start: int = 50) -> DataFrame:
    """The longest doubled length (start, 2 * start, ...) at which each document shares a window.

    Level by level: windows of a length that occur in one document alone end;
    a window of twice the length is formed only where both its halves
    repeat. Stops when no candidates survive. Returns doc_id, longest; rows of
    one doc_id count together and do not repeat each other. Documents without
    a repeat, and null ids, have no row; other columns do not matter.
    """
    level, length, found = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text"), start, None
    while True:
        half = (length + 1) // 2
        kept = materialise(_scan(level, length, half).select("doc_id", F.explode("kept").alias("anchor")).distinct(), "anchors")
        shared = kept.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low <> high")
        halves = kept.join(shared.select("anchor"), "anchor").groupBy("doc_id").agg(F.collect_list("anchor").alias("kept"))
        windows = materialise(_windows(level.join(halves, "doc_id").select("doc_id", "text", "kept"), length, half), "windows")
        both = windows.groupBy("h", "g").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low <> high")
        reached = materialise(windows.join(both, ["h", "g"]).select("doc_id").distinct(), f"level-{length}")
        if reached.isEmpty():
            break
        marked = reached.select("doc_id", F.lit(length).alias("longest"))
        found = marked if found is None else found.union(marked)
        level, length = level.join(reached, "doc_id", "left_semi"), 2 * length
    if found is None:
        return docs.select("doc_id", F.lit(0).alias("longest")).limit(0)
    return found.groupBy("doc_id").agg(F.max("longest").alias("longest"))
