"""Append-only ledgers as streams.

A ledger's latest row of each key lives in keyed state; what a micro-batch
changes is written as a small table of its own. Reading puts the changes
together, and :func:`compact` folds old ones into one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.relations import latest_rows

#: A row of the ledger of verified documents. Without ``verified`` it is a stamp, with false it takes the key's stamp back.
STAMP = "key string, seq long, ruleVersion long, verified boolean, at string"
#: Keeps state on the executors' disks instead of in their heaps.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_jsonl(spark: SparkSession, folder: str, schema: str = STAMP) -> DataFrame:
    """A stream of the JSON lines files that arrive in a folder; torn lines become null rows and are dropped."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(folder)


def changes(rows: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """Of a stream of ledger rows, those that became their key's latest; rows without key or seq are dropped.

    Of rows with one seq that of the later batch (by the driver's clock)
    stays, and of one batch the last that a task reads, unless its sort
    spills. Tasks pass on one row of each key, so a key may have any number
    of rows.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    # In a stream this is the batch's own time, which is logged with it: a replayed batch has the same.
    batch = F.current_timestamp()
    sound = rows.where(rows[key].isNotNull() & rows[seq].isNotNull())
    placed = sound.select(F.struct("*").alias("row"), batch.alias("batch"))
    last = F.max_by(F.struct("row", "batch"), F.struct(f"row.{seq}", "batch"))
    latest = placed.groupBy(f"row.{key}").agg(last.alias("latest"))
    return latest.where(F.col("latest.batch") == batch).select("latest.row.*")


def keep_latest(rows: DataFrame, folder: str, checkpoint: str, key: str = "key", seq: str = "seq") -> StreamingQuery:
    """Write what each micro-batch changes into ``folder``; a batch that is replayed after a failure writes the same again.

    A batch costs what it changes: the table is not rewritten.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    changed = changes(rows, key, seq)
    return changed.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark: SparkSession, folder: str, key: str = "key", seq: str = "seq") -> DataFrame:
    """The latest row of each key from the changes of all batches."""
    rows = spark.read.parquet(folder)
    return latest_rows(rows.withColumn("_at", F.struct(seq, "batch")), key, "_at").drop("_at", "batch")


def compact(spark: SparkSession, folder: str, target: str, key: str = "key", seq: str = "seq") -> DataFrame:
    """The latest rows as one table in ``target`` (as batch -1, so that later batches can be laid beside it)."""
    read_latest(spark, folder, key, seq).write.mode("overwrite").parquet(f"{target}/batch=-1")
    return spark.read.parquet(target)


def verified_keys(ledger: DataFrame, rule_version: int) -> DataFrame:
    """Keys whose latest row is a stamp under the live rules: (key).

    A later row with ``verified`` false takes a stamp back, and stamps of
    other rule versions are void. Works on a whole ledger and on latest rows.
    """
    latest = latest_rows(ledger.where("key IS NOT NULL"))
    return latest.where(F.coalesce("verified", F.lit(True)) & F.col("ruleVersion").eqNullSafe(F.lit(rule_version))).select("key")


def append_rows(rows: DataFrame, folder: str) -> None:
    """Append ledger rows as JSON lines in files of their own; earlier rows are never touched."""
    rows.write.mode("append").json(folder)
