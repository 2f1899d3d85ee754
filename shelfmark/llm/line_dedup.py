"""Line dedup by pairwise alignment.

Documents overlap if they share a line, and more so if they share runs of
lines. Every line, and every run of two or three adjacent lines that are all
shared, has two owners: the document of the smallest id that holds it, and one
by a hash. A document is paired with the earlier owners of its lines and runs,
so a block meets the first document that holds the block, not only those that
hold one of its lines, and a block shared by k documents makes at most 2 k
pairs, not k squared.
Each pair is aligned by patience diff (lines unique in both, in the longest
common order, fix the alignment; between them it goes on, and equal heads and
tails are matched). Aligned blocks are deleted from the later document.

Against the alignment of all pairs nothing else is deleted, and tests measure
what is missed: where blocks of a document lie in several earlier ones in
another order than in the owners of their runs.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import begin, fresh, materialise

#: Lines of the runs that have owners of their own.
RUNS = (2, 3)
#: Bits of the filter that tells which texts may lose lines: so many for each that does, in powers of two, at
#: least and at most (8 KB to 8 MB). Beyond, more texts that lose none pass the filter, too.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 26


def line_hashes(text: str) -> list[int]:
    """A signed 64-bit hash per line, without white space around it; 0 for a blank line."""
    out = []
    for line in text.split("\n"):
        bare = line.strip()
        h = xxhash.xxh3_64_intdigest(bare) if bare else 0
        out.append(h - (1 << 64) if h >= 1 << 63 else h)
    return out


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs (sorted by the first) with increasing second: patience piles."""
    tops: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        back.append(ends[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(j)
            ends.append(k)
        else:
            tops[pile], ends[pile] = j, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions (i, j), increasing in both, with a[i] == b[j]."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        low_a, high_a, low_b, high_b = todo.pop()
        while low_a < high_a and low_b < high_b and a[low_a] == b[low_b]:
            out.append((low_a, low_b))
            low_a, low_b = low_a + 1, low_b + 1
        while low_a < high_a and low_b < high_b and a[high_a - 1] == b[high_b - 1]:
            high_a, high_b = high_a - 1, high_b - 1
            out.append((high_a, high_b))
        if low_a == high_a or low_b == high_b:
            continue
        once_a, once_b = Counter(a[low_a:high_a]), Counter(b[low_b:high_b])
        at_b = {x: j for j, x in enumerate(b[low_b:high_b], low_b) if once_b[x] == 1}
        pairs = [(i, at_b[x]) for i, x in enumerate(a[low_a:high_a], low_a) if once_a[x] == 1 and x in at_b]
        fixed = _increasing(pairs)
        if not fixed:
            continue
        before_a, before_b = low_a, low_b
        for i, j in fixed:
            todo.append((before_a, i, before_b, j))
            out.append((i, j))
            before_a, before_b = i + 1, j + 1
        todo.append((before_a, high_a, before_b, high_b))
    return sorted(out)


def common_lines(earlier: list[int], later: list[int]) -> list[int]:
    """Lines of ``later`` in aligned runs that hold more than blank lines."""
    out: list[int] = []
    run: list[int] = []
    last = (-2, -2)
    for i, j in [*patience(earlier, later), (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if any(later[x] for x in run):
                out.extend(run)
            run = []
        run.append(j)
        last = (i, j)
    return out


ROWS = "doc_id long, key long, lines array<long>"


def _lines(docs: DataFrame) -> DataFrame:
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("line_dedup")
        for batch in batches:
            for low in range(0, len(batch), 500):
                part = batch.slice(low, 500)
                texts = part.column(1).to_pylist()
                keys = np.array([xxhash.xxh3_64_intdigest(t) for t in texts], np.uint64).view(np.int64)
                yield pa.record_batch(
                    [part.column(0), pa.array(keys), pa.array([line_hashes(t) for t in texts], pa.list_(pa.int64()))],
                    names=["doc_id", "key", "lines"],
                )

    return docs.select("doc_id", "text").mapInArrow(hashes, ROWS)


def _owned(held: DataFrame, mark: str) -> DataFrame:
    """``held`` (doc_id, key, a mark, others) with the owners of each mark that several rows have.

    The first is the document of the smallest id, the second one by a hash,
    which tells documents apart that the first ones hold in another order.
    """
    drawn = F.min(F.struct(F.xxhash64("doc_id", "key").alias("draw"), "doc_id", "key"))
    owners = held.groupBy(mark).agg(
        F.count("*").alias("n"), F.min(F.struct("doc_id", "key")).alias("first"), F.struct(drawn["doc_id"].alias("doc_id"), drawn["key"].alias("key")).alias("drawn")
    )
    return held.join(owners.where("n > 1").select(mark, F.array_distinct(F.array("first", "drawn")).alias("owners")), mark)


def _pairs(lined: DataFrame) -> DataFrame:
    """doc_id, key, first_id, first_key: each document with the owners of its lines and runs."""
    filled = lined.select("doc_id", "key", F.filter("lines", lambda x: x != 0).alias("lines"))
    shared = _owned(filled.select("doc_id", "key", F.posexplode("lines").alias("pos", "line")), "line")
    shared = materialise(shared, "shared")
    # Runs of adjacent shared lines: no other run can be shared.
    s = F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("s")
    rows = shared.groupBy("doc_id", "key").agg(s).where(F.size("s") > 1)

    def runs(length: int):
        ends = F.slice("s", length, F.greatest(F.size("s") - (length - 1), F.lit(0)))
        at = lambda i, k: F.get("s", i + k)
        mark = lambda e, i: F.when(
            e["pos"] - at(i, 0)["pos"] == length - 1, F.xxhash64(*[at(i, k)["line"] for k in range(length)])
        )
        return F.transform(ends, mark)

    marks = F.array_distinct(F.array_compact(F.concat(*map(runs, RUNS))))
    run_owners = _owned(rows.select("doc_id", "key", F.explode(marks).alias("run")), "run")
    both = shared.select("doc_id", "key", "owners").unionByName(run_owners.select("doc_id", "key", "owners"))
    each = both.select("doc_id", "key", F.explode("owners").alias("owner")).where("owner.doc_id < doc_id")
    return each.select("doc_id", "key", F.col("owner.doc_id").alias("first_id"), F.col("owner.key").alias("first_key")).distinct()


def deletions(docs: DataFrame) -> DataFrame:
    """(doc_id, key, gone): numbers of the lines to delete from the document of that id and text.

    A null doc_id stands as the least number, a null text as empty; equal
    rows are one document. Documents without deletions have no row.
    """
    texts = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    lined = materialise(_lines(texts).dropDuplicates(["doc_id", "key"]), "lines")
    pairs = _pairs(lined).join(lined.withColumnRenamed("lines", "later"), ["doc_id", "key"]).join(
        lined.select(F.col("doc_id").alias("first_id"), F.col("key").alias("first_key"), F.col("lines").alias("earlier")),
        ["first_id", "first_key"],
    )

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("line_dedup")
        for batch in batches:
            for low in range(0, len(batch), 500):
                part = batch.slice(low, 500)
                gone = list(map(common_lines, part.column(3).to_pylist(), part.column(2).to_pylist()))
                yield pa.record_batch(
                    [part.column(0), part.column(1), pa.array(gone, pa.list_(pa.int32()))], names=["doc_id", "key", "gone"]
                )

    aligned = pairs.select("doc_id", "key", "later", "earlier").mapInArrow(
        align, "doc_id long, key long, gone array<int>"
    )
    gone = F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone")
    return aligned.where(F.size("gone") > 0).groupBy("doc_id", "key").agg(gone)


def _filter(gone: DataFrame) -> np.ndarray:
    """Bits at two places for each text that loses lines, in 64-bit words: ``MOST_BITS`` at most."""
    bits = LEAST_BITS
    while bits < min(MOST_BITS, BITS_EACH * gone.count()):
        bits *= 2
    places = F.array(F.col("key").bitwiseAND(bits - 1), F.shiftright("key", 32).bitwiseAND(bits - 1))
    words = (
        gone.select(F.explode(places).alias("p"))
        .select(F.shiftright("p", 6).alias("word"), F.expr("shiftleft(1L, cast(p & 63 AS int))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
    )
    found = words.toArrow()
    out = np.zeros(bits >> 6, np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out


def _may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    found, last = np.ones(len(keys), bool), 64 * len(bits) - 1
    for place in (keys & last, keys >> 32 & last):
        found &= bits[place >> 6] >> (place & 63) & 1 == 1
    return found


def dedup_lines(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` with aligned common blocks deleted from the later document.

    All columns are kept; ``text`` is what stays, and n_lines and n_removed
    (long) are added, in place of columns of these names. Lines end at ``\\n`` and are compared without white
    space around them; blank lines are common to all and go only inside a
    common block. Documents are judged on the input: a block goes if an owner
    has it, whatever the owner loses itself and however many documents share
    it. A null text has no lines and stays null; a text that loses all lines
    becomes empty; rows of one doc_id never shorten each other; a null id
    counts as smaller than all others. An empty table gives no rows.

    Only texts that may lose lines are shuffled: a filter of bounded size
    tells which.
    """
    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    id_, key, gone_, may = (fresh(docs, c) for c in ("_id", "_key", "_gone", "_may"))
    found = materialise(deletions(docs), "gone")
    gone = found.select(F.col("doc_id").alias(id_), F.col("key").alias(key), F.col("gone").alias(gone_))
    place = [c.lower() for c in kept].index("text")
    shared = docs.sparkSession.sparkContext.broadcast(_filter(found))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("line_dedup")
        bits = shared.value
        for batch in batches:
            for low in range(0, len(batch), 500):
                part = batch.slice(low, 500)
                digests = [xxhash.xxh3_64_intdigest(t or "") for t in part.column(place).to_pylist()]
                digests = np.array(digests, np.uint64).view(np.int64)
                yield pa.record_batch(
                    [*part.columns, pa.array(digests), pa.array(_may_hold(bits, digests))], names=[*part.schema.names, key, may]
                )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    keyed = docs.mapInArrow(keys, f"{fields}, {key} long, {may} boolean")
    # Deletions grow with the documents, so they are joined by a shuffle at any size.
    touched = keyed.where(may).withColumn(id_, F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))
    rows = touched.join(gone.hint("merge"), [id_, key], "left")
    text = F.col(f"`{kept[place]}`")
    lines = F.split(text, "\n", -1)
    stays = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains(F.col(gone_), i)), "\n")
    none = F.col(gone_).isNull()

    def shown(frame: DataFrame, edited, removed) -> DataFrame:
        return frame.select(
            *[edited.alias(c) if i == place else F.col(f"`{c}`") for i, c in enumerate(kept)],
            F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
            removed.cast("long").alias("n_removed"),
        )

    changed = shown(rows, F.when(none, text).otherwise(stays), F.when(none, 0).otherwise(F.size(gone_)))
    return shown(keyed.where(~F.col(may)), text, F.lit(0)).unionByName(changed)
