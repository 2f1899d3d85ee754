"""Helpers that the training-data operators share.

Words here are maximal runs of bytes other than space and ``\\t\\n\\v\\f\\r``; on
UTF-8 text this is exactly what ``bytes.split()`` returns.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as a regular expression class.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only in local mode (tests, a notebook on one machine) a temporary folder
    is chosen where that is unset, and kept in the session's configuration; a
    cluster without the setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("shelfmark.scratch", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="shelfmark-")
        spark.conf.set("shelfmark.scratch", root)
    return root.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back.

    This cuts the lineage: a lost executor repeats no work from before this
    point. The table stays until :func:`drop_scratch` is called.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/shelfmark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete every table that :func:`materialise` wrote in this application.

    Results that are still lazy read those tables: write them first.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(
        f"{scratch_root(spark)}/shelfmark/{spark.sparkContext.applicationId}"
    )
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Fixed multiplier of the word hash, its inverse mod 2**64, and a value for each byte.
_BASE = 0x9E3779B97F4A7C15
_BYTES = np.array([xxhash.xxh3_64_intdigest(bytes([b])) for b in range(256)], np.uint64)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Bytes hashed at once; longer texts go piece by piece, cut at white space.
_PIECE = 1 << 17


class Powers:
    """Powers of an odd base mod 2**64 and of its inverse, as far as they were asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(n, self.base, np.uint64)])
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(n, self.inverse, np.uint64)])


_POWERS = Powers(_BASE)


def _piece_hashes(raw: np.ndarray) -> np.ndarray:
    inside = np.r_[False, ~_BLANK[raw], False]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    _POWERS.reach(max(len(raw), _PIECE) + 1)
    sums = np.r_[np.uint64(0), np.cumsum(_BYTES[raw] * _POWERS.up[: len(raw)])]
    h = (sums[ends] - sums[starts]) * _POWERS.down[starts]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(29)


_KEPT: dict[str, object] = {}
_DOING = ""


def begin(name: str) -> None:
    """Called where a task's Python begins: a worker that comes from another operator gives back what it holds.

    Spark hands Python workers on from one operator's tasks to another's. So
    an executor never holds what several operators have gathered.
    """
    global _DOING
    if name != _DOING:
        _DOING = name
        _KEPT.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


def worker_table(name: str, make: Callable[[], object]) -> object:
    """What a Python worker remembers from task to task while it works for one operator."""
    begin(name)
    if name not in _KEPT:
        _KEPT[name] = make()
    return _KEPT[name]


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text's bytes, in order, without a Python object per word."""
    if len(data) <= _PIECE:
        return _piece_hashes(np.frombuffer(data, np.uint8))
    raw, found, low = np.frombuffer(data, np.uint8), [], 0
    while low < len(raw):
        high = min(low + _PIECE, len(raw))
        while high < len(raw) and not _BLANK[raw[high]]:
            high += 1
        found.append(_piece_hashes(raw[low:high]))
        low = high
    return np.concatenate(found)


def held_out(doc_id):
    """True where crc32(doc_id as text) mod 3 is 1: rows never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def without_clash(df: DataFrame, *wanted: str) -> DataFrame:
    """Only the named columns, so that an operator's own columns cannot meet the caller's others."""
    return df.select(*[F.col(f"`{c}`") for c in wanted])


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
