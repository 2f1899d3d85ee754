"""Body verification that goes on where it stopped.

A run lists the bodies in tasks and appends those that no run has listed to
the state, as lists of some paths each. The lists are a stream, whose driver
knows a list and not its bodies. What was hashed is in the stream's
checkpoint, so a run that is stopped, or whose driver is lost, goes on with
the lists that are left. The checkpoint belongs to one root signature and one
target: under another of either nothing that was verified holds.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import keys
from ..operators.steps import settle
from ..sources import tree

#: Lists that one task writes at most.
_LISTS = 100


@dataclass(frozen=True)
class Bodies:
    """The bodies below ``root/cap``, and how many of them a micro-batch takes."""

    spark: SparkSession
    root: str
    files_at_once: int


def state_folder(base: str, signature: str, endpoint: str, bucket: str, prefix: str) -> str:
    """Where a verification keeps its state: one folder per root signature and target."""
    target = [endpoint.rstrip("/"), bucket, prefix.strip("/")]
    return f"{base.rstrip('/')}/{hashlib.sha256(json.dumps([signature, target]).encode()).hexdigest()[:32]}"


def stream_bodies(spark: SparkSession, root: str, files_at_once: int = 1000) -> Bodies:
    """The bodies below ``root/cap`` as a stream; a run of :func:`verify_bodies` takes what is there when it starts."""
    return Bodies(spark, root.rstrip("/"), files_at_once)


def _listed(bodies: Bodies, state: str) -> str:
    """The folder of the state's lists, with those of new bodies; a body that was modified is a new one."""
    spark, folder = bodies.spark, f"{state}/lists"
    files = tree.list_tree(spark, f"{bodies.root}/cap")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    begun = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    if begun:
        files = files.join(spark.read.schema(tree.LISTED).parquet(folder), ["path", "length", "modified"], "left_anti")
    new = settle(files)
    count = new.count()
    if count or not begun:
        lists = new.repartition(1 + count // (_LISTS * bodies.files_at_once))
        lists.write.option("maxRecordsPerFile", bodies.files_at_once).mode("append").parquet(folder)
    return folder


def verify_bodies(bodies: Bodies, state: str) -> StreamingQuery:
    """Hash the bodies that no earlier run of this state has hashed, batch by batch, and keep what was found.

    A body is sound if it lies at its own digest. A batch that is replayed
    after a failure writes its rows to the same place.
    """
    spark, cap = bodies.spark, f"{bodies.root}/cap"
    tasks = spark.sparkContext.defaultParallelism

    def keep(batch: DataFrame, number: int) -> None:
        read = tree.with_content(batch.select("path", "length"), cap, tasks)
        hashed = read.select(F.concat(F.lit("cap/"), "path").alias("path"), "length", keys.sri(F.col("content")).alias("digest"))
        sound = keys.body_path(F.col("digest")) == F.col("path")
        hashed.withColumn("sound", sound).write.mode("overwrite").parquet(f"{state}/found/batch={number}")

    lists = spark.readStream.schema(tree.LISTED).option("maxFilesPerTrigger", 1).parquet(_listed(bodies, state))
    return lists.writeStream.foreachBatch(keep).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start()


def found_bodies(spark: SparkSession, state: str) -> DataFrame:
    """(path, length, digest, sound) of all that the state's runs have hashed."""
    return spark.read.parquet(f"{state}/found").drop("batch")


def valid_layers(passed: DataFrame, sample: float, kept_sample: float | None, serving: float = 4.0) -> DataFrame:
    """Layers of a checkpoint of the same root and target that still hold: under another sample all but serving."""
    return passed.where("pass").where(F.lit(sample == kept_sample) | (F.col("layer") != serving)).select("layer")
