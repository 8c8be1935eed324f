"""Incremental curation and live progress over a growing folder of parquet shards."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from figmill.functions.hashing import fingerprint
from figmill.operators.quality import valid_candidates
from figmill.sources.staging import folders, removed


def shard_stream(
    spark: SparkSession, folder: str, schema: T.StructType, glob: str = "*.parquet"
) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)


def curated_stream(
    rows: DataFrame, code: str, event_time: str | None = None, delay: str = "7 days"
) -> DataFrame:
    """Gates and deduplication by block fingerprint.

    Without an event time the dedup is exact and its state keeps every fingerprint. With
    one, copies that arrive within ``delay`` are dropped and older state is released.
    """
    gated = valid_candidates(rows, code).withColumn("fingerprint", fingerprint(F.col("markup")))
    if event_time is None:
        return gated.dropDuplicates(["fingerprint"])
    return gated.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["fingerprint"])


#: State store of ``first_seen_stream``: it lives on disk and checkpoints only its changes.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
_SEEN = "print string"


class _FirstSeen(StatefulProcessor):
    """Passes the rows whose fingerprint its part of the seen set does not hold yet."""

    def __init__(self, ttl_ms: int | None, columns: list[str]):
        self.ttl_ms, self.columns = ttl_ms, columns

    def init(self, handle) -> None:
        self.seen = handle.getMapState("seen", _SEEN, "there boolean", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        for batch in rows:
            fresh = batch.drop_duplicates("fingerprint")
            known = [self.seen.containsKey((p,)) for p in fresh["fingerprint"]]
            fresh = fresh[[not k for k in known]]
            for print_ in fresh["fingerprint"]:
                self.seen.updateValue((print_,), (True,))
            yield fresh[self.columns]

    def close(self) -> None:
        pass


def first_seen_stream(
    rows: DataFrame, code: str, ttl_hours: float | None = None, prefix: int = 3
) -> DataFrame:
    """Gates and exact deduplication with a managed seen set.

    The set is a map per fingerprint prefix of ``prefix`` hex digits, held by RocksDB (the session
    needs ``STATE_SETTINGS``), so neither memory nor a checkpoint holds all of it. With
    ``ttl_hours`` an entry is forgotten that long after it was written; without, never.
    """
    if prefix < 1:
        raise ValueError(f"prefix must be at least 1. Got {prefix}.")
    if ttl_hours is not None and ttl_hours <= 0:
        raise ValueError(f"ttl_hours must be positive. Got {ttl_hours}.")
    gated = valid_candidates(rows, code).withColumn("fingerprint", fingerprint(F.col("markup")))
    ttl = None if ttl_hours is None else int(ttl_hours * 3_600_000)
    parts = gated.withColumn("_part", F.substring("fingerprint", 1, prefix)).groupBy("_part")
    return parts.transformWithStateInPandas(
        _FirstSeen(ttl, gated.columns), gated.schema, "append",
        "none" if ttl is None else "ProcessingTime",
    )


def state_sizes(query) -> list[dict]:
    """Per micro-batch of a stopped or running query: its number, rows held as state, rows updated
    and bytes of state."""
    out = []
    for progress in query.recentProgress:
        held = progress["stateOperators"]
        out.append(
            {
                "batch": progress["batchId"],
                "rows": sum(s["numRowsTotal"] for s in held),
                "updated": sum(s["numRowsUpdated"] for s in held),
                "bytes": sum(s["memoryUsedBytes"] for s in held),
            }
        )
    return out


def append_stream(rows: DataFrame, path: str, checkpoint: str, available_now: bool = False):
    """Append to a parquet table; ``available_now`` stops once the backlog is done."""
    writer = rows.writeStream.format("parquet").option("path", path).option(
        "checkpointLocation", checkpoint
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def family_progress_stream(
    samples: DataFrame, target: int, path: str, checkpoint: str, available_now: bool = False
):
    """Keep a table of collected samples per family against the quota.

    Every micro-batch writes the whole table, one row per family, as its own version and then
    removes the versions before the previous one. A replayed batch starts from the version
    before it and overwrites itself.
    """
    counts = samples.groupBy("family").agg(F.count(F.lit(1)).alias("collected"))

    def upsert(changed: DataFrame, version: int) -> None:
        spark = changed.sparkSession
        rows = changed.withColumns(
            {"target": F.lit(target).cast("long"), "done": F.col("collected") >= target}
        )
        older = [v for v in _versions(spark, path) if v < version]
        if older:
            kept = spark.read.parquet(f"{path}/version={older[-1]}")
            rows = kept.join(changed, "family", "left_anti").unionByName(rows)
        rows.write.mode("overwrite").parquet(f"{path}/version={version}")
        for old in older[:-1]:
            removed(spark, f"{path}/version={old}")

    writer = counts.writeStream.outputMode("update").foreachBatch(upsert).option(
        "checkpointLocation", checkpoint
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Versions of a progress table, ascending."""
    names = [n for n in folders(spark, path) if n.startswith("version=")]
    return sorted(int(n.removeprefix("version=")) for n in names)


def latest_progress(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/version={_versions(spark, path)[-1]}")
