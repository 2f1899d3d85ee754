"""Spelling variants by forward and reversed sorted dictionaries.

Words are near if one inserted, deleted or replaced character makes one the
other. Let m be the length of the shorter. One edit leaves a half intact: the
words begin with the same m // 2 characters, or end with the same rest of m.
So the dictionary is sorted forward and reversed, each once for a word as the
shorter and once as the longer of a pair, and range-scanned: words of one
block (side, m, shared half) follow each other. In a block, words are verified
position by position: without the character at p they are equal, and differ
there first. A pair is found on one side and at one position only.

A block with too many words for one task is subdivided by the next characters.
Pairs that share them are in the parts; pairs that differ among them are equal
without one of them, which a grouped shuffle finds (a group holds at most a
word per character of the alphabet). Parts that are still too large go on,
with twice as many characters.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import begin, materialise

LETTERS = "a-zÀ-ÿ"
_PIECE = 1 << 20
#: Distinct words that a task counts before it passes them on.
FLUSH = 100_000
#: Words of a block that one task scans.
BLOCK = 5_000


def count_words(text: str, doc_id: object, least_length: int, drop_each: int | None) -> Counter[str]:
    """Words of a whole text with at least so many characters, after the planted drops."""
    found: Counter[str] = Counter()
    runs, inside = re.compile(f"[{LETTERS}]{{{least_length},}}"), re.compile(f"[{LETTERS}]*")
    lowered, low = text.encode().lower().decode(), 0  # bytes lower A-Z alone
    while low < len(lowered):
        high = inside.match(lowered, min(low + _PIECE, len(lowered))).end()
        found.update(runs.findall(lowered, low, high))
        low = high
    if not drop_each:
        return found
    out: Counter[str] = Counter()
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in found.items():
        h = zlib.crc32(run.encode(), start)
        if h % drop_each == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < least_length:
                continue
        out[run] += n
    return out


def word_counts(docs: DataFrame, least_length: int = 7, least_count: int = 2, drop_each: int | None = None) -> DataFrame:
    """word and n (occurrences in all documents) of the words with at least ``least_count``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("spelling")
        found: Counter[str] = Counter()

        def flushed() -> pa.RecordBatch:
            batch = pa.record_batch([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"])
            found.clear()
            return batch

        for batch in batches:
            for low in range(0, len(batch), 500):
                part = batch.slice(low, 500)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found.update(count_words(text or "", doc_id, least_length, drop_each))
                    if len(found) >= FLUSH:
                        yield flushed()
        yield flushed()

    counted = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def block_pairs(words: list[str], m: int, depth: int) -> Iterator[tuple[str, str]]:
    """Near words among those of lengths m and m + 1 that share ``depth`` characters; the shorter has m."""
    same = [w for w in words if len(w) == m]
    longer = [w for w in words if len(w) > m]
    known = set(same) if longer else ()
    if not same:
        return
    for p in range(depth, m + 1):
        if p < m and len(same) > 1:
            without = defaultdict(list)
            for w in same:
                without[w[:p] + w[p + 1 :]].append(w)
            for group in without.values():
                for i in range(1, len(group)):
                    for j in range(i):
                        yield group[i], group[j]
        for x in longer:
            w = x[:p] + x[p + 1 :]
            if w in known and (p == m or w[p] != x[p]):
                yield w, x


def _other_side(a: str, b: str, m: int, side: int) -> bool:
    """Whether the pair, given as its side has it, is the other side's: reversed words that begin alike forward."""
    if side == 0:
        return False
    half = m // 2
    return a[::-1][:half] == b[::-1][:half]


_PAIRS = "word string, near string, near_n long"


def _scan(blocks: DataFrame) -> DataFrame:
    """Pairs, in both directions, of blocks that are sorted and not parted by tasks."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("spelling")
        rows = (
            row
            for batch in batches
            for low in range(0, len(batch), 5000)
            for row in zip(*(c.to_pylist() for c in batch.slice(low, 5000).columns), strict=True)
        )
        out: list[tuple[str, str, int]] = []
        for (side, m, shared), block in groupby(rows, lambda r: r[:3]):
            counts = {word: n for _, _, _, word, n in block}
            if len(counts) < 2:
                continue
            for a, b in block_pairs(list(counts), m, len(shared)):
                if not _other_side(a, b, m, side):
                    x, y = (a[::-1], b[::-1]) if side else (a, b)
                    out += [(x, y, counts[b]), (y, x, counts[a])]
            if len(out) >= 20_000:
                yield _batch(out)
                out = []
        yield _batch(out)

    # The two dictionaries in order; a block's words have one range key.
    ranged = blocks.repartitionByRange("side", "m", "shared").sortWithinPartitions("side", "m", "shared", "word")
    return ranged.select("side", "m", "shared", "word", "n").mapInArrow(scan, _PAIRS)


def _batch(rows: list[tuple[str, str, int]]) -> pa.RecordBatch:
    a, b, n = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.record_batch([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(n, pa.int64())], names=["word", "near", "near_n"])


def _differing(blocks: DataFrame, step: int) -> DataFrame:
    """Pairs of large blocks that differ first in one of the ``step`` characters after the shared ones."""
    at = F.explode(F.expr(f"sequence(length(shared), least(length(shared) + {step - 1}, m))")).alias("p")
    placed = blocks.select("side", "m", "word", "n", at)
    without = F.expr("concat(substring(word, 1, p), substring(word, p + 2))")
    short, long_ = placed.where("length(word) = m"), placed.where("length(word) > m")
    replaced = short.where("p < m").select("side", "m", "p", without.alias("rest"), "word", "n")
    inserted = long_.select("side", "m", "p", without.alias("rest"), "word", "n")
    whole = short.select("side", "m", "p", F.col("word").alias("rest"), "word", "n")
    # A rest of m - 1 characters joins words that replace p, one of m a word and those that insert at p.
    groups = replaced.unionByName(inserted).unionByName(whole).groupBy("side", "m", "p", "rest")
    members = groups.agg(F.collect_list(F.struct("word", "n")).alias("w")).where("size(w) > 1")

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("spelling")
        for batch in batches:
            for low in range(0, len(batch), 2000):
                out: list[tuple[str, str, int]] = []
                for side, m, p, group in zip(*(c.to_pylist() for c in batch.slice(low, 2000).columns), strict=True):
                    for i in range(1, len(group)):
                        for j in range(i):
                            a, b = group[i]["word"], group[j]["word"]
                            if len(a) > m and len(b) > m or (p < m and a[p] == b[p]) or _other_side(a, b, m, side):
                                continue
                            x, y = (a[::-1], b[::-1]) if side else (a, b)
                            out += [(x, y, group[j]["n"]), (y, x, group[i]["n"])]
                yield _batch(out)

    return members.select("side", "m", "p", "w").mapInArrow(pair, _PAIRS)


def near_words(words: DataFrame, least_length: int = 7, block: int = BLOCK) -> DataFrame:
    """word, near and near_n: every pair of near words of a table of distinct ``word`` and ``n``, in both directions.

    Words shorter than ``least_length`` are left out.
    """
    words = words.where(F.length("word") >= least_length)
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.lit(k).alias("k")) for s in (0, 1) for k in (0, 1)]))
    rows = words.select("word", "n", sides.alias("s")).select(
        "s.side",
        (F.length("word") - F.col("s.k")).alias("m"),
        F.when(F.col("s.side") == 1, F.reverse("word")).otherwise(F.col("word")).alias("word"),
        "n",
    )
    half = F.expr("CASE side WHEN 0 THEN m div 2 ELSE m - m div 2 END")
    rows = rows.where(F.col("m") >= least_length).withColumn("half", half)
    blocks = rows.select("side", "m", F.expr("substring(word, 1, half)").alias("shared"), "word", "n")
    found, step = None, 1
    while True:
        large = blocks.groupBy("side", "m", "shared").count().where(F.col("count") > block).drop("count")
        large = materialise(large, "large")
        if large.isEmpty():
            pairs = _scan(blocks)
            return pairs if found is None else found.unionByName(pairs)
        keys = ["side", "m", "shared"]
        small = _scan(blocks.join(large, keys, "left_anti"))
        hot = materialise(blocks.join(large, keys, "left_semi"), "blocks")
        part = small.unionByName(_differing(hot, step))
        found = materialise(part if found is None else found.unionByName(part), "pairs")
        # What is shorter than the longer prefix has been paired at every position.
        blocks = hot.where(F.expr(f"length(shared) + {step} <= m")).select(
            "side", "m", F.expr(f"substring(word, 1, length(shared) + {step})").alias("shared"), "word", "n"
        )
        step *= 2


def _roots(forms: DataFrame) -> DataFrame:
    """word and root of words with a form: links are followed, twice as far each round.

    A form has many times its word's n, so there are no circles and few rounds.
    """
    roots = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        hopped = materialise(roots.join(further, "root", "left").select("word", "root", "further"), "roots")
        roots = hopped.select("word", F.coalesce("further", "root").alias("root"))
        if hopped.where("further IS NOT NULL").isEmpty():
            return roots


def spelling_variants(
    docs: DataFrame, least_length: int = 7, least_count: int = 2, ratio: int = 10, drop_each: int | None = None, block: int = BLOCK
) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the documents.

    Words are maximal runs of ``A-Z a-z`` and U+00C0 to U+00FF, of which A-Z
    are lowered, with at least ``least_length`` characters and
    ``least_count`` occurrences (n). ``form`` is the near word of the largest
    n (ties: the smallest in code-point order) if that is at least ``ratio``
    times the word's, else null, and ``form_n`` its n; ``root`` is where forms
    lead in the end, the word itself if it has none; ``n_near`` counts near
    words. With ``drop_each``, runs whose crc32 with the doc_id it divides
    lose a character first (a null doc_id counts as empty).

    Null and empty texts have no words; every row counts, repeated ones too;
    a run of any length is one word; an empty table gives no rows.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2, or forms could lead in circles")
    words = materialise(word_counts(docs, least_length, least_count, drop_each), "words")
    near = near_words(words, least_length, block).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")
    )
    kept = -F.col("best.less") >= ratio * F.col("n")
    formed = words.join(near, "word", "left").select(
        "word",
        F.when(kept, F.col("best.near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(kept, -F.col("best.less")).alias("form_n"),
    )
    formed = materialise(formed, "formed")
    roots = _roots(formed.where("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
