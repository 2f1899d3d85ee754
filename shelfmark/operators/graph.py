"""Reachability over capture references, and what a sweep of the unreachable would take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import keys
from ..sources.tree import fresh_root

#: Tables of marks of one tier that are put together into one of the next.
FAN = 16


class _Marks:
    """Marked keys with their depth as tables: a level is written once, and tables are put together in tiers.

    So each key is written a few times however many levels follow, and a
    lookup reads a few tables.
    """

    def __init__(self, roots: DataFrame):
        self.spark, self.schema = roots.sparkSession, f"key {roots.schema['key'].dataType.simpleString()}, depth int"
        self.folder, self.made = fresh_root(self.spark, "marks"), 0
        self.tiers: list[list[str]] = []

    def read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths)

    def written(self, rows: DataFrame) -> tuple[str, int]:
        """A new table's path and how many rows it has, counted as they are written."""
        self.made += 1
        path, seen = f"{self.folder}/{self.made}", Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
        return path, seen.get["n"]

    def add(self, path: str) -> None:
        tier = 0
        while True:
            if tier == len(self.tiers):
                self.tiers.append([])
            self.tiers[tier].append(path)
            if len(self.tiers[tier]) < FAN:
                return
            path, _ = self.written(self.read(self.tiers[tier]).coalesce(self.spark.sparkContext.defaultParallelism))
            self.tiers[tier] = []
            tier += 1

    def all(self) -> DataFrame:
        return self.read([p for tier in self.tiers for p in tier])


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Keys reachable from the roots with their depth: (key, depth).

    Breadth first until a level is empty, at any depth; every level is a
    table, so that lost executors repeat one level at most. A level's
    candidates look for themselves among the marked keys, and those that they
    find, never more than the candidates, go: thin levels are broadcast, and
    marked keys are not written again. Null keys are nothing.
    """
    marks = _Marks(roots)
    level, n = marks.written(roots.select("key").where("key IS NOT NULL").distinct().select("key", F.lit(0).alias("depth")))
    first, depth = level, 0
    while n:
        marks.add(level)
        depth += 1
        front = marks.read([level]).select(F.col("key").alias("parent"))
        step = edges.join(front, "parent").select(F.col("child").alias("key")).where("key IS NOT NULL").distinct()
        known = marks.all().join(step, "key", "left_semi").select("key").distinct()
        level, n = marks.written(step.join(known, "key", "left_anti").select("key", F.lit(depth).alias("depth")))
    return marks.all() if marks.tiers else marks.read([first])


def sweep_plan(inventory: DataFrame, marked: DataFrame) -> DataFrame:
    """What a sweep would move: objects (path, key, length) whose key is not marked. A plan only, nothing is deleted."""
    return inventory.join(marked.select("key").distinct(), "key", "left_anti").select("path", "key", "length")


def sweep_manifest(sidecars: DataFrame, marked: DataFrame, before: Column, generation: str) -> DataFrame:
    """A manifest of captures that no root reaches, for review: generation, hash, key, meta_object, cap_object, reason.

    sidecars: key, status, fetched_at (ISO). Only captures fetched before a
    time are listed (a null time is none). A capture goes as a pair of
    objects; one without a body has its sidecar alone. It is re-pointed if a
    marked capture has its original at another time, else de-waybacked.
    """
    gone = sidecars.join(marked.select("key").distinct(), "key", "left_anti").where(F.col("fetched_at") < before)
    held = marked.select(keys.key_original(F.col("key")).alias("original"), F.lit(True).alias("held")).where("original IS NOT NULL").distinct()
    rows = gone.withColumn("original", keys.key_original(F.col("key"))).join(held, "original", "left")
    key = F.col("key")
    return rows.select(
        F.lit(generation).alias("generation"),
        keys.capture_hash(key).alias("hash"),
        "key",
        keys.meta_path(key).alias("meta_object"),
        F.when(F.col("status") == "body", keys.capture_path(key)).alias("cap_object"),
        F.when(F.col("held"), "re-pointed").otherwise("de-waybacked").alias("reason"),
    ).orderBy("hash")


def sweep_actions(manifest: DataFrame, generation: str, marked: DataFrame) -> DataFrame:
    """The objects (object, hash) that executing a reviewed manifest removes, sidecar and body of a capture alike.

    A manifest of another generation is an error, and so is one that lists a
    key that is marked by now.
    """
    moved = F.raise_error(F.concat(F.lit("the manifest is of generation "), F.coalesce("generation", F.lit("(none)"))))
    live = F.raise_error(F.concat(F.col("key"), F.lit(" is reachable")))
    rows = manifest.join(marked.select("key", F.lit(True).alias("_live")).distinct(), "key", "left")
    sure = (
        F.when(~F.col("generation").eqNullSafe(F.lit(generation)), moved).when(F.col("_live"), live).otherwise(F.col("hash"))
    )
    both = F.array_compact(F.array("meta_object", "cap_object"))
    return rows.select(sure.alias("hash"), both.alias("objects")).select(F.explode("objects").alias("object"), "hash")
