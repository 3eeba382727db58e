"""Streams of snapshots and findings: differences against the last state of a target, counts by window of time."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from codeloam.operators.snapshot_diff import content_digest, plain_target
from codeloam.session import shared_dir

CHANGE = "target string, delivery_no int, loaded_at timestamp, change_kind string"
STATE = "delivery_no int, loaded_at timestamp, d1 bigint, d2 bigint, places int"


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data directory as a stream of its files."""
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if os.path.isfile(path):  # a stream reads folders; a table that is one file is picked from its folder
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return reader.parquet(path)


def digests(snapshots: DataFrame) -> DataFrame:
    return snapshots.where("target is not null").select(plain_target("target").alias("target"), "delivery_no", F.col("loaded_at").cast("timestamp").alias("loaded_at"), *content_digest())


def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows of a target in the order of delivery and load; emits how each differs from the one before, across batches."""
    last = state.get if state.exists else None
    rows = pd.concat(list(batches)).drop_duplicates().sort_values(["delivery_no", "loaded_at", "d1", "d2"])
    out = []
    for r in rows.itertuples(index=False):
        if last is not None and (r.delivery_no, r.loaded_at) < (last[0], last[1]):
            continue  # older than what is known of this target
        kind = "added" if last is None else "same" if (r.d1, r.d2) == (last[2], last[3]) else "changed"
        if kind != "same":
            out.append((key[0], r.delivery_no, r.loaded_at, kind))
        last = (r.delivery_no, r.loaded_at, r.d1, r.d2, (last[4] if last else 0) + 1)
    if last is not None:
        state.update(last)
    yield pd.DataFrame(out, columns=["target", "delivery_no", "loaded_at", "change_kind"])


def changes(stream: DataFrame) -> DataFrame:
    """(target, delivery_no, loaded_at, change_kind): each record of a target that is new or differs from the one before.

    The state of a target is the digest of its last record, so it stays small however long the stream runs. Records
    older than the state are ignored; equal ones say nothing. Without input nothing is emitted.
    """
    return digests(stream).groupBy("target").applyInPandasWithState(follow, CHANGE, STATE, "append", GroupStateTimeout.NoTimeout)


def windows(findings: DataFrame, length: str = "1 day", late: str = "180 days") -> DataFrame:
    """Findings by detector and window of ``found_at``; rows later than ``late`` are dropped and their state freed."""
    f = findings.where("found_at is not null").withColumn("found_at", F.col("found_at").cast("timestamp")).withWatermark("found_at", late)
    return f.groupBy(F.window("found_at", length), "detector").agg(F.count("*").alias("findings"), F.max("loaded_at").alias("last_loaded"))


def drained(stream: DataFrame, mode: str, schema_of: DataFrame | None = None) -> DataFrame:
    """Run ``stream`` over all that is there and return what it wrote, as a table in the shared folder."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/codeloam-stream-{uuid.uuid4().hex}"
    out = f"{base}/out"

    def write(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/epoch={epoch}" if mode == "append" else out)

    q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    df = spark.read.schema(stream.schema).parquet(f"{out}/epoch=*" if mode == "append" else out)
    return df.select(*stream.columns)
