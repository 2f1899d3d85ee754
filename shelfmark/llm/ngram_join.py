"""N-gram Jaccard join with token-combination prefixes.

A document's set has the 64-bit hashes of its distinct word shingles. Two
sets can only be similar enough if they share part of their prefixes under one
order of all tokens. The order is by frequency: a table of counts by token
class (the hash's top bits), summed over all documents, puts rare classes
first. Rare tokens of a prefix are indexed alone. Tokens of frequent classes
are indexed in pairs within subclasses: the first of a subclass adds nothing
to the bound, each further one adds one, so prefixes are extended until the
bound holds again (at least one pair, or one rare token, must be shared).

Candidates are verified on the whole sets. Before that, a parity sketch of each
set (one bit per residue, flipped by every token) rules out pairs: bits that
differ cannot outnumber the tokens that differ, so no similar pair is lost and
few dissimilar ones have their sets shuffled. Only components are wanted, so
lists are not expanded into all pairs: each list is first compared with one
of its members; lists that still hold several components are then dealt into
random blocks of growing size, and pairs across components are compared within
blocks, until every such list was one block. That leaves out no pair across
components, whatever the length of a list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import begin, fresh, materialise, word_hashes
from .components import connected

#: Bits of the class table, and rows that a task writes it in.
CLASS_BITS = 21
CHUNKS = 1024
#: A class is frequent from so many times the mean count, plus a constant.
FREQUENT_TIMES, FREQUENT_PLUS = 4, 16
#: Smallest block of a list, and its growth by round.
BLOCK, GROWTH = 16, 4
#: Words of the brief sketch that members of lists longer than a smallest block carry.
BRIEF = 8
#: Live sets are found by a broadcast of ids up to so many, and by a shuffle beyond.
BROADCAST_IDS = 500_000
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def shingle_set(text: str | None, words_each: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles (A-Z lower-cased).

    With fewer words the whole sequence is one shingle; without words, none.
    """
    h = word_hashes((text or "").encode().lower())
    if not len(h):
        return h
    k = min(words_each, len(h))
    mixed = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        mixed = (mixed ^ h[j : len(h) - k + 1 + j]) * _A
        mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed * _B)


def node_of(tokens: np.ndarray) -> int:
    """A signed 64-bit digest of a set: equal sets are one node."""
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def _need(n: int, percent: int) -> int:
    """How many tokens must be indexed: one more than may be missing in a similar set."""
    return n - (percent * n + 99) // 100 + 1


def _least_size(percent: int) -> int:
    """Sets below this size are similar to equal sets only."""
    n = 1
    while percent * (n + 1) > 100 * n:
        n += 1
    return n


class Prefixes:
    """Keys under which a set is indexed."""

    def __init__(self, counts: np.ndarray, percent: int):
        self.counts, self.percent, self.least = counts, percent, _least_size(percent)
        self.frequent = FREQUENT_TIMES * float(counts.mean()) + FREQUENT_PLUS

    def keys(self, tokens: np.ndarray) -> np.ndarray:
        n = len(tokens)
        if n < self.least:
            return np.zeros(0, np.uint64)
        # Bands of sizes; near a band's lower end a set may be similar to sets of the band below.
        band = int(np.log2(n / self.least))
        lower = self.least * 2**band
        bands = [band, band - 1] if band and self.percent * n < 100 * lower else [band]
        seen = self.counts[(tokens >> np.uint64(64 - CLASS_BITS)).astype(np.int64)]
        order = np.lexsort((tokens, seen))
        ordered, common = tokens[order], seen[order] >= self.frequent
        need = _need(n, self.percent)
        rare = ordered[: min(need, int(n - common.sum()))]
        rest = ordered[len(rare) :]
        out = []
        for b in bands:
            salt = np.uint64((b + 1) * int(_C) & (1 << 64) - 1)
            out.append((rare ^ salt) * _A)
            if len(rare) < need:
                out.append(self._pairs(rest, need - len(rare), self.least * 2**b) ^ salt)
        return np.unique(np.concatenate(out))

    @staticmethod
    def _pairs(tokens: np.ndarray, need: int, lower: int) -> np.ndarray:
        """Keys of token pairs within subclasses over the shortest prefix that meets ``need``."""
        subclasses = max(1, min(lower // 2, max(4, lower // 30)))
        sub = (tokens * _C >> np.uint64(40)).astype(np.int64) % subclasses
        met = np.zeros(subclasses, bool)
        used = 0
        for s in sub.tolist():
            need -= int(met[s])
            met[s] = True
            used += 1
            if not need:
                break
        if need:  # too few tokens for pairs alone: each is indexed alone, for all sets of the band alike
            raise AssertionError("the prefix cannot meet the bound")
        out = []
        for s in range(subclasses):
            own = np.sort(tokens[:used][sub[:used] == s])
            i, j = np.triu_indices(len(own), 1)
            out.append((own[i] * _A ^ own[j]) * _B)
        return np.concatenate(out)


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, len(batch), rows):
            yield batch.slice(low, rows)


def _scan(docs: DataFrame, words_each: int) -> DataFrame:
    """Per row (doc_id, tie, node, n), and per task its counts by token class in chunks."""
    width = (1 << CLASS_BITS) // CHUNKS

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("ngram_join")
        counts = np.zeros(1 << CLASS_BITS, np.uint32)
        for part in _slices(batches, 2_000):
            nodes, sizes = [], []
            classes = []
            for text in part.column(1).to_pylist():
                tokens = shingle_set(text, words_each)
                nodes.append(node_of(tokens))
                sizes.append(len(tokens))
                classes.append((tokens >> np.uint64(64 - CLASS_BITS)).astype(np.int64))
            counts += np.bincount(np.concatenate(classes), minlength=len(counts)).astype(np.uint32)
            empty = pa.nulls(len(part))
            yield pa.record_batch(
                [
                    part.column(0),
                    part.column(2),
                    pa.array(nodes, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    empty.cast(pa.int32()),
                    empty.cast(pa.binary()),
                ],
                names=["doc_id", "tie", "node", "n", "chunk", "counts"],
            )
        # A class counted 255 times in one task is frequent anyway.
        packed = np.minimum(counts, 255).astype(np.uint8).reshape(CHUNKS, width)
        some = np.flatnonzero(packed.any(axis=1))
        yield pa.record_batch(
            [
                *[pa.nulls(len(some), pa.int64())] * 4,
                pa.array(some.astype(np.int32)),
                pa.array([packed[i].tobytes() for i in some], pa.binary()),
            ],
            names=["doc_id", "tie", "node", "n", "chunk", "counts"],
        )

    return docs.mapInArrow(scan, "doc_id long, tie long, node long, n long, chunk int, counts binary")


def _class_counts(scanned: DataFrame) -> np.ndarray:
    """The class table: 2**CLASS_BITS counts over all documents, summed on the executors."""
    width = (1 << CLASS_BITS) // CHUNKS

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("ngram_join")
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if chunk not in sums:
                    sums[chunk] = np.zeros(width, np.int64)
                sums[chunk] += np.frombuffer(packed, np.uint8)
        yield pa.record_batch(
            [
                pa.array(list(sums), pa.int32()),
                pa.array([np.minimum(x, 2**32 - 1).astype("<u4").tobytes() for x in sums.values()], pa.binary()),
            ],
            names=["chunk", "counts"],
        )

    parts = scanned.where("chunk IS NOT NULL").select("chunk", "counts").repartition("chunk")
    out = np.zeros((CHUNKS, width), np.uint32)
    for row in parts.mapInArrow(add, "chunk int, counts binary").collect():
        out[row["chunk"]] = np.frombuffer(row["counts"], "<u4")
    return out.ravel()


def sketch_of(tokens: np.ndarray, words: int = 0) -> np.ndarray:
    """The parity of the tokens in each residue class, as 64-bit words; by default at least a bit per token."""
    words = words or 1 << max(0, int(np.ceil(np.log2(max(1, len(tokens)) / 64))))
    bits = np.bincount((tokens & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<i8")


def _index(docs: DataFrame, counts: np.ndarray, words_each: int, percent: int) -> DataFrame:
    """(node, n, keys, sketch, brief) of every row whose set can have partners."""
    shared = docs.sparkSession.sparkContext.broadcast(Prefixes(counts, percent))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("ngram_join")
        prefixes = shared.value
        for part in _slices(batches, 500):
            rows: list[tuple] = []
            for text in part.column(0).to_pylist():
                tokens = shingle_set(text, words_each)
                found = prefixes.keys(tokens)
                if len(found):
                    rows.append((node_of(tokens), len(tokens), found.view(np.int64), sketch_of(tokens), sketch_of(tokens, BRIEF)))
            nodes, sizes, *lists = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.record_batch(
                [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in lists)],
                names=["node", "n", "keys", "sketch", "brief"],
            )

    return docs.select("text").mapInArrow(index, "node long, n long, keys array<long>, sketch array<long>, brief array<long>")


def _sets(docs: DataFrame, owners: DataFrame, words_each: int) -> DataFrame:
    """(node, tokens) of the wanted nodes, read from the text of one document id each.

    Equal rows give a node twice, and so its pairs, which are made distinct later.
    """
    few = owners.count() <= BROADCAST_IDS
    wanted = docs.join(F.broadcast(owners) if few else owners, "doc_id").select("node", "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("ngram_join")
        for part in _slices(batches, 500):
            nodes, sets = [], []
            for node, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                found = shingle_set(text, words_each)
                if node_of(found) == node:  # rows of one doc_id can have several texts
                    nodes.append(node)
                    sets.append(found.view(np.int64))
            yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "tokens"])

    return wanted.mapInArrow(read, "node long, tokens array<long>")


def _possible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of (a, na, b, nb) that their sketches do not rule out."""
    first = sketches.select(F.col("node").alias("a"), F.col("sketch").alias("sa"))
    second = sketches.select(F.col("node").alias("b"), F.col("sketch").alias("sb"))

    def folded(mine: str, other: str):
        half = (F.size(mine) / 2).cast("int")
        halves = F.zip_with(F.slice(mine, 1, half), F.slice(mine, half + 1, half), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(mine) > F.size(other), halves).otherwise(F.col(mine))

    # Of n and m tokens with d others, (n + m - d) / 2 are shared at most.
    flips = F.zip_with(folded("sa", "sb"), folded("sb", "sa"), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    differ = F.aggregate(flips, F.lit(0), lambda total, x: total + x)
    total = F.col("na") + F.col("nb")
    return (
        pairs.join(first, "a")
        .join(second, "b")
        .where((total - differ) * (100 + percent) >= total * (2 * percent))
        .select("a", "b")
        .distinct()
    )


def _across(dealt: DataFrame, percent: int, sketched: bool) -> DataFrame:
    """Pairs (a, na, b, nb) across components within blocks, that sizes (and brief sketches) do not rule out."""
    carried = [f"s{i}" for i in range(BRIEF)] if sketched else []
    x, y = (
        dealt.select("key", "part", *[F.col(c).alias(c + side) for c in ("node", "n", "root", *carried)])
        for side in ("_a", "_b")
    )
    na, nb = F.col("n_a"), F.col("n_b")
    near = (na * 100 >= nb * percent) & (nb * 100 >= na * percent)
    if sketched:
        flips = [F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in carried]
        near &= (na + nb - sum(flips[1:], flips[0])) * (100 + percent) >= (na + nb) * (2 * percent)
    pairs = x.join(y, ["key", "part"]).where((F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b")) & near)
    return pairs.select(F.col("node_a").alias("a"), na.alias("na"), F.col("node_b").alias("b"), nb.alias("nb"))


def _links(pairs: DataFrame, docs: DataFrame, owners: DataFrame, words_each: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough; only sets of these pairs are read and shuffled."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = _sets(docs, materialise(owners.join(nodes, "node", "left_semi"), "wanted"), words_each)
    first = sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta"))
    second = sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb"))
    shared = F.size(F.array_intersect("ta", "tb")).cast("long")
    checked = pairs.join(first, "a").join(second, "b").select(
        "a", "b", shared.alias("both"), (F.size("ta") + F.size("tb")).cast("long").alias("total")
    )
    return checked.where(F.col("both") * 100 >= (F.col("total") - F.col("both")) * percent).select("a", "b")


def _joined(comps: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """Components (node, root) after more links between roots."""
    more = connected(links)
    if comps is None:
        return more
    known = comps.select("node", F.col("root").alias("old"))
    onward = more.select(F.col("node").alias("old"), F.col("root").alias("new"))
    moved = known.join(onward, "old", "left").select("node", F.coalesce("new", "old").alias("root"))
    return materialise(moved.unionByName(more.join(known, "node", "left_anti").select("node", "root")), "comps")


def _rooted(docs: DataFrame, words_each: int, percent: int) -> DataFrame:
    """(doc_id, tie, n, root) of every row: a hash of its text, its set's size, and its component's least node."""
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50 and at most 100")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    scanned = materialise(_scan(rows, words_each), "scan")
    documents = scanned.where("chunk IS NULL").select("doc_id", "tie", "node", "n")
    indexed = materialise(_index(rows, _class_counts(scanned), words_each, percent), "index")
    postings = indexed.select("node", "n", F.explode("keys").alias("key"))
    lists = postings.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    shared = materialise(postings.join(lists.select("key"), "key").dropDuplicates(["key", "node"]), "shared")
    # Lists by size band: sets in the same or the next band alone can be similar enough.
    step = float(np.log(100 / min(percent, 99.9))) * 1.0001
    band = F.floor(F.log("n") / F.lit(step))
    banded = shared.select("key", "node", "n", F.explode(F.array(band, band + 1)).alias("band")).select(
        F.xxhash64("key", "band").alias("key"), "node", "n"
    )
    lists = banded.groupBy("key").agg(F.min(F.struct("node", "n")).alias("low"), F.max("node").alias("high"))
    lists = lists.where("low.node <> high").select("key", F.col("low.node").alias("hub"), F.col("low.n").alias("hub_n"))
    live = materialise(banded.join(lists, "key"), "live")
    nodes = materialise(live.select("node").distinct(), "nodes")
    owners = materialise(documents.join(nodes, "node").groupBy("node").agg(F.min("doc_id").alias("doc_id")), "owners")
    sketches = indexed.select("node", "sketch", "brief").join(nodes, "node", "left_semi").dropDuplicates(["node"])
    sketches = materialise(sketches, "sketches")

    def fits(x: str, y: str):
        return (F.col(x) * 100 >= F.col(y) * percent) & (F.col(y) * 100 >= F.col(x) * percent)

    # First each list with one of its members, then lists of several components in growing blocks.
    pairs = live.where("node <> hub").where(fits("n", "hub_n")).select(
        F.col("hub").alias("a"), F.col("hub_n").alias("na"), F.col("node").alias("b"), F.col("n").alias("nb")
    ).distinct()
    pairs = materialise(_possible(pairs, sketches, percent), "pairs")
    links = materialise(_links(pairs, rows, owners, words_each, percent), "links")
    comps = None if links.isEmpty() else _joined(None, links)
    # A list that is one component stays so: each round goes on with the members of open lists alone.
    block, members = BLOCK, live.select("key", "node", "n")
    brief = sketches.select("node", *[F.get("brief", F.lit(i)).alias(f"s{i}") for i in range(BRIEF)])
    while True:
        rooted = members if comps is None else members.join(comps, "node", "left")
        rooted = rooted.withColumn("root", F.col("node") if comps is None else F.coalesce("root", "node"))
        open_lists = (
            rooted.groupBy("key")
            .agg(F.count("*").alias("held"), F.min("root").alias("r0"), F.max("root").alias("r1"))
            .where((F.col("r0") != F.col("r1")) & (F.col("held") > (1 if block == BLOCK else block // GROWTH)))
            .select("key", "held")
        )
        dealt = rooted.join(open_lists, "key").withColumn(
            "part", F.pmod(F.xxhash64("node", F.lit(block)), F.ceil(F.col("held") / block))
        )
        dealt = materialise(dealt, "dealt")
        if dealt.isEmpty():
            break
        if block == BLOCK:
            # Short lists have a bounded number of pairs for each member; members of long ones carry a brief sketch.
            long = materialise(dealt.where(F.col("held") > BLOCK).join(brief, "node"), "long")
            near = _across(dealt.where(F.col("held") <= BLOCK), percent, False).union(_across(long, percent, True))
        else:
            long = dealt
            near = _across(long, percent, True)
        members = long.drop("root", "held", "part")
        pairs = materialise(_possible(near.distinct(), sketches, percent), "pairs")
        found = _links(pairs, rows, owners, words_each, percent)
        roots = dealt.select("node", "root").distinct()
        lifted = (
            found.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
            .join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
            .select(F.col("ra").alias("a"), F.col("rb").alias("b"))
            .distinct()
        )
        links = materialise(lifted, "links")
        if not links.isEmpty():
            comps = _joined(comps, links)
        block *= GROWTH
    if comps is None:
        rooted = documents.withColumn("root", F.col("node"))
    else:
        rooted = documents.join(comps, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return rooted.select("doc_id", "tie", "n", "root")


def components(docs: DataFrame, words_each: int = 5, percent: int = 80) -> DataFrame:
    """Documents linked by Jaccard similarity of their shingle sets, by component.

    Two documents link if 100 * intersection >= percent * union. Returns per
    row of ``docs``: doc_id, n_shingles and component_id, the smallest doc_id
    reachable by links. Null and empty texts, and texts of white space, have
    no shingles, link with nothing and are their own component. Equal sets
    are linked; repeated rows and rows of one doc_id are told apart by their
    sets. A null doc_id never names a component of others (null if it is
    alone). An empty table gives no rows. ``percent`` is over 50.
    """
    rooted = _rooted(docs, words_each, percent)
    names = rooted.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    empty = rooted.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return (
        rooted.where("n > 0")
        .join(names, "root")
        .select("doc_id", F.col("n").alias("n_shingles"), "component_id")
        .unionByName(empty)
    )


def without_copies(docs: DataFrame, words_each: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay where of each component one document stays: the smallest doc_id.

    Of rows of that id, the one with the least hash of its text stays, and of
    equal rows one. A null id stays only if its component has no other.
    Texts without words all stay. All columns are kept.
    """
    low, high = -(1 << 63), (1 << 63) - 1
    id_, tie = fresh(docs, "_id"), fresh(docs, "_tie")
    # Null ids come last among those of a component.
    rooted = materialise(_rooted(docs, words_each, percent).where("n > 0"), "rooted")
    order = F.struct(F.coalesce("doc_id", F.lit(high)).alias("doc_id"), "tie")
    first = rooted.groupBy("root").agg(F.min(order).alias("first"))
    lost = rooted.join(first, "root").where(order != F.col("first")).select("doc_id", "tie").distinct()
    again = rooted.groupBy("doc_id", "tie").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "tie")

    def named(keys: DataFrame) -> DataFrame:
        return keys.select(F.coalesce("doc_id", F.lit(low)).alias(id_), F.col("tie").alias(tie))

    rows = docs.withColumn(id_, F.coalesce(F.col("doc_id").cast("long"), F.lit(low))).withColumn(tie, F.xxhash64("text"))
    kept = rows.join(named(lost), [id_, tie], "left_anti")
    again = materialise(named(again), "again")
    if not again.isEmpty():
        once = kept.join(again, [id_, tie], "left_semi").dropDuplicates([id_, tie])
        kept = kept.join(again, [id_, tie], "left_anti").unionByName(once)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def oracle(words_each: int, percent: int) -> str:
    """The components in DuckDB's SQL, by counting shared shingles of all pairs that share one."""
    return rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < {words_each} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {words_each - 2}), lambda i: array_to_string(w[i:i + {words_each - 1}], ' ')) END) AS s
  FROM words),
firsts AS (SELECT min(doc_id) AS doc_id, list_sort(s) AS s FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM firsts),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM tokens x JOIN tokens y ON x.t = y.t AND x.doc_id < y.doc_id
    AND x.n * 100 >= y.n * {percent} AND y.n * 100 >= x.n * {percent}
  GROUP BY x.doc_id, y.doc_id
  HAVING count(*) * 100 >= (any_value(x.n) + any_value(y.n) - count(*)) * {percent}),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(a, b) AS (SELECT doc_id, doc_id FROM firsts UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a),
rep AS (SELECT s.doc_id, f.doc_id AS rep FROM sets s JOIN firsts f ON list_sort(s.s) = f.s)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(l.component_id, s.doc_id) AS component_id
FROM sets s LEFT JOIN rep r ON r.doc_id = s.doc_id LEFT JOIN least l ON l.doc_id = r.rep"""
