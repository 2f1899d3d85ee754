"""Packing: concatenate all documents' token ids and cut every ``seq_len`` ids.

Two passes. The first range-partitions by document id, tokenises each
partition in order and writes, per document, its ids and its start within the
partition. The partition totals (one row per partition) are prefix-summed into
global offsets. The second pass adds its partition's offset to each document
and cuts it at multiples of ``seq_len``; a document over a boundary yields one
record per sequence it touches. No text or id is shuffled in the second pass,
and the layout depends on the rows alone, not on the partitioning.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import begin, materialise, without_clash, worker_table

#: The separator id after each document.
END_ID = 0
#: Chunks whose ids a worker remembers before it starts afresh (about 30 MB).
CHUNK_LIMIT = 150_000
#: Rows per partition of the first pass are broadcast up to so many, and joined by a shuffle beyond.
BROADCAST_BLOCKS = 200_000
#: Fixed by the vocabulary: its pre-tokenisation pattern.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ChunkIds:
    """Ids of texts, chunk by chunk (a chunk is what follows a single space).

    Where no white space is beside a space, no pre-token reaches over it from
    the left, so the ids of " chunk" do not depend on the neighbours and are
    remembered. Other texts, and those that name a special token of the
    vocabulary (one id, as the tokenizer is loaded), are encoded whole.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Most time goes into words that are met once. The same vocabulary as
        # ranks gives the same ids (ids follow the order of merges) for less.
        shown = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
        rest = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.special = tuple(special)
        ranks = {
            bytes(byte[c] for c in token): i
            for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items()
            if token not in special
        }
        self.words = tiktoken.Encoding("words", pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.width[i] = len(token)
        self.known: dict[str, bytes] = {}

    def learn(self, chunks: list[str]) -> None:
        """Encode chunks in one call and remember each one's ids."""
        ids = np.array(self.words.encode_ordinary(" " + " ".join(chunks)), dtype="<u4")
        ends = np.cumsum([1 + len(c.encode()) for c in chunks])
        cuts = np.searchsorted(np.cumsum(self.width[ids]), ends) + 1
        packed, start = ids.tobytes(), 0
        for chunk, end in zip(chunks, (4 * cuts).tolist(), strict=True):
            self.known[chunk] = packed[start:end]
            start = end

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts, packed."""
        if len(self.known) >= CHUNK_LIMIT:
            self.known.clear()
        split = [text.split(" ") for text in texts]
        new = set().union(*(parts[1:] for parts in split)).difference(self.known)
        odd = {c for c in new if not c or c[0].isspace() or c[-1].isspace()}
        if new := list(new - odd):
            self.learn(new)
        known = self.known.__getitem__
        out = []
        for text, (first, *rest) in zip(texts, split, strict=True):
            if first[-1:].isspace() or odd and not odd.isdisjoint(rest) or any(token in text for token in self.special):
                out.append(pack_ids(self.tokenizer.encode(text, add_special_tokens=False).ids))
            else:
                out.append(pack_ids(self.words.encode_ordinary(first)) + b"".join(map(known, rest)))
        return out


def pack_ids(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


def encoder(path: str) -> ChunkIds:
    made = worker_table("packing", dict)
    if path not in made:
        made[path] = ChunkIds(path)
    return made[path]


TOKENS = "doc_id long, block int, local_start long, n_tokens long, ids binary"
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long,"
    " sequence_id long, offset long"
)


def token_table(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """First pass: ids of every document with its start inside its partition."""
    path = tokenizer_path or default_tokenizer_path()
    end = pack_ids([END_ID])

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("packing")
        encode, block, at = encoder(path).encode, TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column(1)
            for low in range(0, len(batch), 128):
                starts, counts, packed = [], [], []
                for ids in encode([text or "" for text in texts.slice(low, 128).to_pylist()]):
                    ids += end
                    starts.append(at)
                    counts.append(len(ids) // 4)
                    packed.append(ids)
                    at += len(ids) // 4
                yield pa.record_batch(
                    [
                        batch.column(0).slice(low, 128).cast(pa.int64()),
                        pa.array([block] * len(packed), pa.int32()),
                        pa.array(starts, pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array(packed, pa.binary()),
                    ],
                    names=["doc_id", "block", "local_start", "n_tokens", "ids"],
                )

    ordered = without_clash(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tie")
    )
    ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return ordered.select("doc_id", "text").mapInArrow(tokenise, TOKENS)


def pack_documents(docs: DataFrame, seq_len: int = 1024, tokenizer_path: str | None = None) -> DataFrame:
    """Pack all documents into sequences of ``seq_len`` ids by concatenate and cut.

    Documents follow each other by ascending doc_id (null first; rows of one
    id by a hash of their text; equal rows are interchangeable). A null or
    empty text is the end id alone; every row of a repeated id is packed.
    Only the last sequence can be short. An empty table gives no pieces.
    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset and ids (the piece's ids, little-endian unsigned 32-bit).
    """
    if seq_len < 1:
        raise ValueError("seq_len must be positive")
    tokens = materialise(token_table(docs, tokenizer_path), "tokens")
    # One row per partition of the first pass.
    totals = tokens.groupBy("block").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("packing")
        for batch in batches:
            rows: list[list] = [[] for _ in range(8)]
            for doc_id, at, count, ids in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                start = 0
                while start < count:
                    sequence, offset = divmod(at + start, seq_len)
                    length = min(count - start, seq_len - offset)
                    piece = ids[4 * start : 4 * (start + length)]
                    row = (doc_id, start, length, zlib.crc32(piece), count, sequence, offset, piece)
                    for column, value in zip(rows, row, strict=True):
                        column.append(value)
                    start += length
            kinds = [pa.int64()] * 7 + [pa.binary()]
            names = [c.split()[0] for c in (PIECES + ", ids binary").split(", ")]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=names)

    bases = materialise(bases, "bases")
    few = bases.count() <= BROADCAST_BLOCKS
    placed = tokens.join(F.broadcast(bases) if few else bases, "block").select(
        "doc_id", (F.col("base") + F.col("local_start")).alias("at"), "n_tokens", "ids"
    )
    return placed.mapInArrow(cut, PIECES + ", ids binary")


def unpack_sequences(pieces: DataFrame) -> DataFrame:
    """The ids of every sequence, its pieces put together in order."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(
        F.aggregate(ordered, F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids")
    )
