"""Ranked lexical search over inverted treaps.

The documents stay where they are: a first pass counts the query terms of each
document and the totals that scores need, a second pass reads these short rows
block by block. Within a block every term has a treap of its postings, with
doc_id as search order and the posting's impact (its part of a score) as heap
order. All terms of an item are traversed at the same time: a range of
documents has one treap node per term, the best of that term there, and their
impacts' sum bounds every score in the range. Ranges whose bound cannot enter
the item's best k go; the others are split at the document of the strongest
node, whose score is summed. Blocks of a task hand on what the best k need.

Only the best k of a task and item are shuffled. Items are broadcast in groups
of a bounded number of terms, each group with passes of its own.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import begin, materialise

#: A term: a run of ASCII letters and digits and of bytes of other characters; A-Z are lowered before.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_PIECE = 1 << 20
#: Terms of a group of items, about, each counted once per item; a single item's terms are never parted.
GROUP_TERMS = 200_000
#: Documents and postings of a block at most (a document with more postings is a block).
BLOCK_DOCS = 1 << 14
BLOCK_POSTINGS = 1 << 20
#: Entries of the ranges that are split at a time.
_TOGETHER = 1 << 18
_MIX = np.uint64(0x9E3779B97F4A7C15)


def count_terms(text: str | None) -> Counter[bytes]:
    """Terms of a whole text with their occurrences; a null text has none. Long texts are cut between terms."""
    data, counts, low = (text or "").encode().lower(), Counter(), 0
    while low < len(data):
        high = min(low + _PIECE, len(data))
        if high < len(data) and (last := TERM.match(data, high)):
            high = last.end()
        counts.update(TERM.findall(data, low, high))
        low = high
    return counts


def _items(items: DataFrame) -> DataFrame:
    """row (its number), item_id and terms: the distinct terms of each item."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("treap_search")
        for batch in batches:
            found = [sorted(count_terms(t)) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.list_(pa.binary()))], names=["item_id", "terms"])

    kind = items.schema["item_id"].dataType.simpleString()
    made = items.select("item_id", "text").mapInArrow(terms, f"item_id {kind}, terms array<binary>")
    return made.withColumn("row", F.monotonically_increasing_id())


def term_postings(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms, with repeats), terms (numbers of query terms, ascending) and tf of every row."""
    known = docs.sparkSession.sparkContext.broadcast(number)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("treap_search")
        number = known.value
        for batch in batches:
            for low in range(0, len(batch), 1000):
                part = batch.slice(low, 1000)
                totals, terms, tfs = [], [], []
                for text in part.column(1).to_pylist():
                    counts = count_terms(text)
                    own = sorted((number[t], counts[t]) for t in counts.keys() & number.keys())
                    totals.append(counts.total())
                    terms.append([t for t, _ in own])
                    tfs.append([c for _, c in own])
                yield pa.record_batch(
                    [part.column(0).cast(pa.int64()), pa.array(totals, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))],
                    names=["doc_id", "n", "terms", "tf"],
                )

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n long, terms array<int>, tf array<long>")


class Treaps:
    """The treaps of all terms of a block: flat arrays of nodes, ``-1`` where there is none.

    Documents are the block's positions 0, 1, ... by ascending doc_id. Equal
    impacts are ordered by a hash of the position, so that treaps of copies
    stay flat.
    """

    def __init__(self, terms: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n_terms: int):
        order = np.lexsort((docs, terms))
        terms, self.doc = terms[order], docs[order]
        self.impact = np.append(impacts[order], 0)  # the last stands for no node
        self.root = np.full(n_terms, -1, np.int64)
        n = len(terms)
        left, right = [-1] * n, [-1] * n
        mixed = ((self.doc.astype(np.uint64) + np.uint64(1)) * _MIX >> np.uint64(44)).astype(np.int64)
        heap = ((self.impact[:-1] << 20) + mixed).tolist()
        edges = np.flatnonzero(np.diff(terms)) + 1
        for low, high in zip([0, *edges.tolist()], [*edges.tolist(), n], strict=True):
            spine: list[int] = []
            for k in range(low, high):
                under, h = -1, heap[k]
                while spine and heap[spine[-1]] < h:
                    under = spine.pop()
                left[k] = under
                if spine:
                    right[spine[-1]] = k
                spine.append(k)
            if spine:
                self.root[terms[low]] = spine[0]
        self.left, self.right = np.array([*left, -1]), np.array([*right, -1])
        self.doc = np.append(self.doc, -1)


def _within(treaps: Treaps, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The top node of each subtree that lies between ``low`` and ``high`` (both outside); -1 where none does."""
    node = node.copy()
    todo = np.flatnonzero(node >= 0)
    while len(todo):
        doc = treaps.doc[node[todo]]
        under, over = doc <= low[todo], doc >= high[todo]
        todo, under = todo[under | over], under[under | over]
        at = node[todo]
        node[todo] = np.where(under, treaps.right[at], treaps.left[at])
        todo = todo[node[todo] >= 0]
    return node


def _split(treaps: Treaps, nodes: np.ndarray, low: np.ndarray, at: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each range's nodes on either side of the document ``at``, and the impacts of its own postings.

    The search for the document in a treap goes down from the range's node;
    the first node that it passes on a side is the top node of that side.
    """
    width = nodes.shape[1]
    before, after = np.full(nodes.size, -1), np.full(nodes.size, -1)
    own = np.zeros(nodes.size, np.int64)
    flat = nodes.ravel()
    slot = np.flatnonzero(flat >= 0)
    node, row = flat[slot], slot // width
    while len(slot):
        doc, wanted = treaps.doc[node], at[row]
        less, more = doc < wanted, doc > wanted
        side = less & (doc > low[row]) & (before[slot] < 0)
        before[slot[side]] = node[side]
        side = more & (doc < high[row]) & (after[slot] < 0)
        after[slot[side]] = node[side]
        here = ~(less | more)
        if here.any():
            k, n, r = slot[here], node[here], row[here]
            own[k] = treaps.impact[n]
            # A side that the way down did not meet begins under the document's own node.
            open_ = before[k] < 0
            before[k[open_]] = _within(treaps, treaps.left[n[open_]], low[r[open_]], at[r[open_]])
            open_ = after[k] < 0
            after[k[open_]] = _within(treaps, treaps.right[n[open_]], at[r[open_]], high[r[open_]])
        node = np.where(less, treaps.right[node], np.where(more, treaps.left[node], -1))
        on = node >= 0
        slot, node, row = slot[on], node[on], row[on]
    return before.reshape(nodes.shape), after.reshape(nodes.shape), own.reshape(nodes.shape)


class Best:
    """The best k documents of each item so far: score, then smallest doc_id (null first)."""

    def __init__(self, n_items: int, k: int):
        self.k, self.least = k, np.ones(n_items, np.int64)  # a score below this cannot enter
        self.item = self.score = self.doc = np.zeros(0, np.int64)

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        fit = score >= self.least[item]
        if not fit.any():
            return
        item = np.concatenate([self.item, item[fit]])
        score, doc = np.concatenate([self.score, score[fit]]), np.concatenate([self.doc, doc[fit]])
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        starts = np.flatnonzero(np.append(True, item[1:] != item[:-1]))
        rank = np.arange(len(item)) - np.repeat(starts, np.diff(np.append(starts, len(item))))
        kept = rank < self.k
        self.item, self.score, self.doc = item[kept], score[kept], doc[kept]
        full = rank == self.k - 1
        self.least[item[full]] = score[full]


def search_block(treaps: Treaps, doc_ids: np.ndarray, item_terms: list[np.ndarray], best: Best) -> None:
    """Traverse the treaps for every item, least terms first, and add to ``best``."""
    order = sorted(range(len(item_terms)), key=lambda q: len(item_terms[q]))
    groups: list[list[int]] = []
    for q in order:
        if len(item_terms[q]):
            if not groups or len(item_terms[q]) * (len(groups[-1]) + 1) > _TOGETHER // 8:
                groups.append([])
            groups[-1].append(q)
    for group in groups:
        width = len(item_terms[group[-1]])
        nodes = np.full((len(group), width), -1)
        for i, q in enumerate(group):
            nodes[i, : len(item_terms[q])] = treaps.root[item_terms[q]]
        # A stack of parts: of what is split, all is done before the parts below.
        ends = np.full(len(group), -1), np.full(len(group), len(doc_ids))
        stack = [(np.array(group), nodes, *ends)]
        while stack:
            item, nodes, low, high = stack.pop()
            most = max(1, _TOGETHER // nodes.shape[1])
            if len(item) > most:
                stack.append((item[most:], nodes[most:], low[most:], high[most:]))
                item, nodes, low, high = item[:most], nodes[:most], low[:most], high[:most]
            impacts = treaps.impact[nodes]
            hope = impacts.sum(1)
            stays = (hope >= best.least[item]) & (hope > 0)
            if not stays.any():
                continue
            item, nodes, impacts, low, high = item[stays], nodes[stays], impacts[stays], low[stays], high[stays]
            at = treaps.doc[nodes[np.arange(len(item)), impacts.argmax(1)]]
            before, after, own = _split(treaps, nodes, low, at, high)
            best.add(item, own.sum(1), doc_ids[at])
            item, nodes = np.concatenate([item, item]), np.concatenate([before, after])
            low, high = np.concatenate([low, at]), np.concatenate([at, high])
            some = (nodes >= 0).any(1)
            if some.any():
                item, nodes, low, high = item[some], nodes[some], low[some], high[some]
                # Columns that no range has any more go.
                stack.append((item, nodes[:, (nodes >= 0).any(0)], low, high))


#: Stands for a null doc_id, which comes first.
_NULL = -(1 << 63)


def _search_group(docs: DataFrame, rows: list, kind: str, k: int) -> DataFrame:
    """row, rank, doc_id and score of a group of items."""
    spark = docs.sparkSession
    terms = sorted(set().union(*(r["terms"] for r in rows)))
    number = {bytes(t): i for i, t in enumerate(terms)}
    postings = materialise(term_postings(docs, number), "postings")
    totals = postings.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    held = postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # at most a group's terms
    df = np.zeros(len(terms), np.int64)
    for term, count in held:
        df[term] = count
    n_docs, length = totals
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    item_terms = [np.array([number[bytes(t)] for t in r["terms"]], np.int64) for r in rows]
    item_terms = [t[weight[t] > 0] for t in item_terms]
    shared = spark.sparkContext.broadcast((weight, item_terms))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("treap_search")
        weight, item_terms = shared.value
        best = Best(len(item_terms), k)
        for ids, n, counts, terms, tfs in _blocks(batches):
            order = np.argsort(ids, kind="stable")
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            norm = 100 - 90 + 90 * n * n_docs // max(length, 1)
            doc = np.repeat(np.arange(len(ids)), counts)
            impact = weight[terms] * (1_000_000_000 * tfs // (1000 * tfs + 8 * norm[doc]))
            used = impact > 0
            treaps = Treaps(terms[used], place[doc[used]], impact[used], len(weight))
            search_block(treaps, ids[order], item_terms, best)
        yield pa.record_batch([pa.array(best.item), pa.array(best.doc), pa.array(best.score)], names=["item", "doc_id", "score"])

    found = postings.where(F.size("terms") > 0).mapInArrow(search, "item long, doc_id long, score long")
    ranked = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
    top = found.withColumn("rank", ranked).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item long, item_id {kind}")
    return top.join(F.broadcast(names), "item").select(  # a group's items: bounded by GROUP_TERMS
        "item_id", "rank", F.when(F.col("doc_id") != _NULL, F.col("doc_id")).alias("doc_id"), "score"
    )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """doc_id, n and number of postings of each document, and all their terms and counts, for blocks of a task's rows."""
    ids, n, counts, terms, tfs, size = [], [], [], [], [], 0

    def block() -> tuple[np.ndarray, ...]:
        return tuple(np.concatenate(x) for x in (ids, n, counts, terms, tfs))

    for batch in batches:
        for low in range(0, len(batch), 1024):
            part = batch.slice(low, 1024)
            ids.append(part.column(0).fill_null(_NULL).to_numpy(zero_copy_only=False))
            n.append(part.column(1).to_numpy(zero_copy_only=False))
            counts.append(part.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            terms.append(part.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            tfs.append(part.column(3).flatten().to_numpy(zero_copy_only=False))
            size += len(terms[-1])
            if sum(map(len, ids)) >= BLOCK_DOCS or size >= BLOCK_POSTINGS:
                yield block()
                ids, n, counts, terms, tfs, size = [], [], [], [], [], 0
    if ids:
        yield block()


def search_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` highest-scoring rows of ``docs`` for each row of ``items``.

    Scores above 0 only; equal scores by ascending doc_id (null first). Every
    row is a document: repeated rows take ranks of their own, and rows of
    ``items`` with one item_id are answered each. Null and empty texts, and
    texts without a term, match nothing; terms that no document holds add
    nothing. Empty tables give no rows. A text may have any length and any
    number of terms.
    """
    if k < 1:
        raise ValueError("k must be positive")
    kind = items.schema["item_id"].dataType.simpleString()
    wanted = materialise(_items(items), "items").where(F.size("terms") > 0)
    # Items by hash, in as many groups as keep a group's terms near the limit.
    total = wanted.agg(F.sum(F.size("terms"))).first()[0] or 0
    groups = total // GROUP_TERMS + 1
    out = None
    for g in range(groups):
        rows = wanted.where(F.pmod(F.xxhash64("row"), F.lit(groups)) == g).select("item_id", "terms").collect()
        if rows:
            part = _search_group(docs, rows, kind, k)
            out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return out


def oracle() -> str:
    """The same search in DuckDB's SQL."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    terms = f"regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '{pattern}')"
    return f"""
WITH items AS (SELECT item_id, unnest(list_distinct({terms})) AS term FROM benchmark),
split AS (SELECT doc_id, {terms} AS ts FROM documents WHERE text IS NOT NULL),
sized AS (SELECT doc_id, len(ts) AS n, ts FROM split WHERE len(ts) > 0),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM sized),
tf AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(ts) AS term FROM sized)
  WHERE term IN (SELECT term FROM items) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
weighed AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM df, totals),
parts AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // length)))) AS part
  FROM tf JOIN weighed USING (term), totals),
scores AS (
  SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM items JOIN parts USING (term) GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM ranked WHERE rank <= 10"""
