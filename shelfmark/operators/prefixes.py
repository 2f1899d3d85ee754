"""Which URLs begin with a prefix of a policy, for policies of any size.

In byte order all strings that begin with a prefix follow it at once. Of a
policy without redundant prefixes (none begins with another) the last prefix
before a URL is therefore the only one that can match. A policy of a checked
size is searched by bisection where the URLs are; a larger one is sorted into
the URLs, and each task carries the last prefix along.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .steps import settle

#: Prefixes, and characters of them, that are broadcast at most.
BROADCAST_ROWS, BROADCAST_CHARS = 500_000, 1 << 25


def without_redundant(prefixes: list[str]) -> list[str]:
    """The prefixes in order, without those that begin with another one."""
    kept: list[str] = []
    for p in sorted(set(prefixes)):
        if not kept or not p.startswith(kept[-1]):
            kept.append(p)
    return kept


def _by_bisection(urls: DataFrame, policy: list[str]) -> DataFrame:
    shared = urls.sparkSession.sparkContext.broadcast(without_redundant(policy))

    @F.pandas_udf("boolean")
    def begins(values: pd.Series) -> pd.Series:
        known = shared.value

        def one(url: str | None) -> bool:
            at = bisect_right(known, url) if url is not None else 0
            return at > 0 and url.startswith(known[at - 1])

        return values.map(one).astype(bool)

    return urls.where(begins("url"))


def _sorted_in(urls: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The distinct URLs that match, from one sort of URLs and prefixes together."""

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None
        kinds = [pa.string(), pa.int32(), pa.bool_(), pa.bool_()]
        for batch in batches:
            out: list[tuple[str, int, bool, bool]] = []
            for text, is_url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                inside = last is not None and text.startswith(last)
                if is_url:
                    out.append((text, part, inside, False))
                elif not inside:
                    last = text
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 4, kinds, strict=True)], names=["url", "part", "match", "last"])
        if last is not None:
            yield pa.record_batch([pa.array([v], k) for v, k in zip((last, part, False, True), kinds, strict=True)], names=["url", "part", "match", "last"])

    both = prefixes.select(F.col("prefix").alias("s"), F.lit(False).alias("u")).unionByName(urls.select(F.col("url").alias("s"), F.lit(True).alias("u")))
    both = both.where("s IS NOT NULL").distinct()
    ranged = both.repartitionByRange("s").sortWithinPartitions("s", "u")
    walked = settle(ranged.mapInArrow(carry, "url string, part int, match boolean, last boolean"))
    # One row a task: what each carries into the next.
    carried, rows, before = {}, sorted(walked.where("last").select("part", "url").collect()), None
    for part, last in rows:
        carried[part] = before
        before = before if before is not None and last.startswith(before) else last
    ends = [p for p, _ in rows]
    frame = walked.where("NOT last")
    told = [(a + 1, b, carried.get(b)) for a, b in zip([-1, *ends], ends, strict=False)] + [((ends[-1] if ends else -1) + 1, 1 << 30, before)]
    spans = frame.sparkSession.createDataFrame(told, "low int, high int, before string")
    reached = F.col("match") | F.coalesce(F.col("url").startswith(F.col("before")), F.lit(False))
    # As many spans as tasks, without overlap: each row meets one.
    joined = frame.join(F.broadcast(spans), (F.col("part") >= F.col("low")) & (F.col("part") <= F.col("high")))
    return joined.where(reached).select("url")


def beginning_with(urls: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Rows of ``urls`` whose url equals or begins with a prefix.

    Null URLs and prefixes match nothing, an empty prefix matches all; rows
    keep their number. An empty policy gives no rows.
    """
    policy = prefixes.select("prefix").where("prefix IS NOT NULL").distinct()
    size = policy.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("prefix")), F.lit(0)).alias("chars")).first()
    if not size["n"]:
        return urls.limit(0)
    if size["n"] <= BROADCAST_ROWS and size["chars"] <= BROADCAST_CHARS:
        return _by_bisection(urls, [r["prefix"] for r in policy.collect()])
    return urls.join(_sorted_in(urls.select("url"), policy), "url", "left_semi")
