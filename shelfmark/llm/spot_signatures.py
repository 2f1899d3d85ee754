"""Document fingerprints: spot signatures.

Wherever a common word (an anchor) stands, the chain of the next CHAIN content
words forms a signature with it. Words whose hash falls into one of
SPARE_CLASSES classes are anchors too, so that texts in any language or
without common words have signatures. A fingerprint is the sorted set of the
signatures' 32-bit hashes in hex; likeness is the Jaccard similarity of the
sets. ``near_pairs`` partitions sets by length and compares through indexed
prefixes, pruned by length.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import begin, materialise, worker_table

#: Content words after an anchor.
CHAIN = 2
SPARE_CLASSES = 32
#: Common words of four languages that serve as anchors.
COMMON = frozenset(
    (
        "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their"
        " they this to was we were which with you"
        " au aux avec ce ces dans de des du elle en est et il je la le les mais ne nous ou par pas pour que qui se son"
        " sur un une vous"
        " aber als am auch auf aus bei das dem den der die ein eine er es für ich im ist mit nicht sich sie sind und"
        " von war wie wir zu"
        " como con del el ella lo los más no o para pero por su sus una y"
    )
    .split()
)
_STRIP = b".,;:!?\"'()[]{}*#$%&|<>-_"
WORDS_KEPT = 150_000
#: Rows of a task, about; ranges of doc_id that each task gets, and ranges at most.
ROWS_PER_TASK, RANGES_PER_TASK, MOST_RANGES = 20_000, 4, 50_000


class _Kinds(dict):
    """Word to its hash; the lowest bit says whether it is an anchor."""

    common = frozenset(w.encode() for w in COMMON)

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        bare = word.lower().strip(_STRIP) or word
        h = xxhash.xxh3_64_intdigest(bare)
        anchor = bare in self.common or (h >> 1) % SPARE_CLASSES == 0
        value = self[word] = h & ~1 | int(anchor)
        return value


def signatures(text: str) -> np.ndarray:
    """The sorted set of 32-bit signature hashes of a text.

    A text with words but no signature has one: the hash of its words.
    """
    words = text.encode().split()
    if not words:
        return np.zeros(0, np.uint32)
    kinds = worker_table("spot_signatures", _Kinds)
    h = np.fromiter(map(kinds.__getitem__, words), np.uint64, len(words))
    anchor = (h & np.uint64(1)).astype(bool)
    content, spots = np.flatnonzero(~anchor), np.flatnonzero(anchor)
    after = np.searchsorted(content, spots)
    spots, after = spots[after + CHAIN <= len(content)], after[after + CHAIN <= len(content)]
    if not len(spots):
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words)) >> 32], np.uint32)
    mixed = h[spots] * np.uint64(0x9E3779B97F4A7C15)
    for k in range(CHAIN):
        mixed = (mixed ^ h[content[after + k]]) * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> np.uint64(29)
    return np.unique((mixed >> np.uint64(32)).astype(np.uint32))


def as_text(signed: np.ndarray) -> str:
    return signed.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity; two empty sets are alike."""
    if not len(a) and not len(b):
        return 1.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as many first code points of the next."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _ranges(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows dealt into ranges of doc_id; the first row of each range also ends the range before."""
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.count() // ROWS_PER_TASK + 1)
    ranges = min(RANGES_PER_TASK * parts, MOST_RANGES)
    shares = [i / ranges for i in range(1, ranges)] or [0.5]
    cuts = sorted(set(docs.agg(F.percentile_approx("id", shares, max(10_000, 10 * ranges))).first()[0] or []))
    # The range of an id by a coarse and a fine step over the sorted cuts.
    step = max(1, int(len(cuts) ** 0.5))
    literal = lambda values: F.from_json(F.lit(json.dumps(values)), "array<bigint>")
    reached = lambda edges: F.size(F.filter(edges, lambda c: c <= F.col("id")))
    whole = reached(literal(cuts[step - 1 :: step])) * step
    part = whole + reached(F.slice(literal(cuts), whole + 1, step))
    dealt = docs.select("id", "tie", "text", part.alias("part"))
    rows = docs.select("id", "tie", part.alias("part")).groupBy("part").agg(F.min(F.struct("id", "tie")).alias("f")).collect()
    firsts = sorted((r["part"], r["f"]["id"], r["f"]["tie"]) for r in rows)
    # One row per range at most: that bounds the broadcast.
    ends = docs.sparkSession.createDataFrame(
        [(i, t, firsts[k - 1][0]) for k, (_, i, t) in enumerate(firsts)], "id long, tie long, before int"
    )
    dealt = dealt.join(F.broadcast(ends), ["id", "tie"], "left")
    own = F.struct(F.col("part"), F.lit(False).alias("ahead"))
    ahead = F.struct(F.col("before").alias("part"), F.lit(True).alias("ahead"))
    places = F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, ahead))
    return dealt.withColumn("place", F.explode(places)).select("place.part", "place.ahead", "id", "tie", "text"), parts


OUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double"
)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses.

    The edited text has its last floor(n_chars / 4) code points replaced by
    the first as many of the next document by doc_id (after the last: the
    first). A null text is empty; a null id comes first and stays null; rows
    of one id follow by a hash of their text. An empty text has the empty
    fingerprint, and two empty ones are alike (1.0). A lone document is its
    own next. An empty table gives no rows.
    """
    lowest = F.lit(-(1 << 63)).cast("long")
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), lowest).alias("id"),
        F.xxhash64("text").alias("tie"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    dealt, parts = _ranges(rows)
    # Rows that only look ahead come last in their range; the wrapped first row, too.
    dealt = dealt.repartition(parts, "part").sortWithinPartitions("part", "ahead", "id", "tie")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("spot_signatures")
        held, ahead_seen = None, None
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for low in range(0, len(batch), 100):
                part = batch.slice(low, 100)
                for place, ahead, doc_id, text in zip(*(part.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                    if ahead and ahead_seen == place:
                        continue  # equal first rows: one is enough
                    signed = signatures(text)
                    if held is not None:
                        past_id, past, past_signed = held
                        changed = edited(past, text)
                        changed_signed = signatures(changed)
                        values = (
                            past_id if past_id != -(1 << 63) else None,
                            len(past),
                            hashlib.sha256(changed.encode()).hexdigest(),
                            as_text(past_signed),
                            as_text(changed_signed),
                            likeness(past_signed, changed_signed),
                            likeness(past_signed, signed),
                        )
                        for column, value in zip(out, values, strict=True):
                            column.append(value)
                    held = None if ahead else (doc_id, text, signed)
                    ahead_seen = place if ahead else None
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            names = [c.split()[0] for c in OUT.split(", ")]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    return dealt.mapInArrow(sign, OUT)


def near_pairs(prints: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs of different fingerprints with likeness of ``threshold`` or more.

    prints: doc_id, fingerprint. Equal fingerprints are one class (its
    smallest id); pairs (low, high, likeness) are between classes. Sets are
    partitioned by length so that only neighbours in length can reach the
    threshold, and meet through the rarest signatures alone.
    Null and empty fingerprints are near nothing.
    """
    size = (F.length("fingerprint") / 8).cast("int")
    classes = prints.where(F.length("fingerprint") > 0).groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"))
    step = F.lit(float(np.log(1 / threshold)))
    sets = materialise(
        classes.select(
            "doc_id",
            F.transform(
                F.sequence(F.lit(0), size - 1), lambda i: F.substr(F.col("fingerprint"), i * 8 + 1, F.lit(8))
            ).alias("signs"),
            size.alias("n"),
            F.floor(F.log(size.cast("double")) / step).cast("int").alias("part"),
        ),
        "spots",
    )
    seen = sets.select("doc_id", "n", "part", F.explode("signs").alias("sign"))
    counts = seen.groupBy("sign").agg(F.count("*").alias("held")).where("held > 1")
    ranked = seen.join(counts, "sign").groupBy("doc_id", "n", "part").agg(
        F.array_sort(F.collect_list(F.struct("held", "sign"))).alias("order"), F.count("*").alias("common")
    )
    # Signs that one set alone holds come first in the order and meet nothing.
    prefix = F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1 - (F.col("n") - F.col("common"))
    firsts = ranked.where(prefix > 0).select(
        "doc_id", "n", "part", F.explode(F.slice("order", F.lit(1), prefix.cast("int"))).alias("o")
    ).select("doc_id", "n", "part", "o.sign")
    left = firsts.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("sign"), F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    right = firsts.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), "sign", "part")
    near_size = (F.col("na") >= F.lit(threshold) * F.col("nb")) & (F.col("nb") >= F.lit(threshold) * F.col("na"))
    once = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    found = left.join(right, ["sign", "part"]).where(near_size & once).select("a", "b").distinct()
    x = sets.select(F.col("doc_id").alias("a"), F.col("signs").alias("sa"))
    y = sets.select(F.col("doc_id").alias("b"), F.col("signs").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    value = shared / (F.size("sa") + F.size("sb") - shared)
    checked = found.join(x, "a").join(y, "b").withColumn("likeness", value).where(F.col("likeness") >= threshold)
    return checked.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"), "likeness")
