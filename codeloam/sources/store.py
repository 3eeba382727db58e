"""A store of snapshots as JSON lines with a bounded history per target, and sinks of reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloam.functions import rules

SNAPSHOT = (
    "target string, timestamp string, shape string, structural string, complexity string, enriched map<string,double>, composite map<string,double>, "
    "algorithms array<string>, patterns array<string>, vuln_types array<string>, type_profile map<string,double>, type_flow struct<propagations:int,type_errors:int>"
)


def save(snapshots: DataFrame, path: str) -> None:
    """Append snapshots; old ones stay until :func:`compact`."""
    snapshots.write.mode("append").json(path)


def load_all(spark: SparkSession, path: str) -> DataFrame:
    """All snapshots; lines that are no JSON are dropped."""
    return spark.read.schema(SNAPSHOT).option("mode", "DROPMALFORMED").json(path).where("target is not null")


def load_latest(spark: SparkSession, path: str) -> DataFrame:
    """The latest snapshot of each target by timestamp."""
    df = load_all(spark, path)
    return df.groupBy("target").agg(F.max_by(F.struct(*df.columns), "timestamp").alias("s")).select("s.*")


def targets(spark: SparkSession, path: str) -> DataFrame:
    return load_all(spark, path).select("target").distinct()


def compact(spark: SparkSession, path: str, to: str, most: int = rules.HISTORY) -> None:
    """Write the last ``most`` snapshots of each target to ``to``, oldest first within a target."""
    w = Window.partitionBy("target").orderBy(F.desc("timestamp"))
    load_all(spark, path).withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).sortWithinPartitions("target", F.desc("n")).drop("n").write.mode("overwrite").json(to)


def save_reports(reports: DataFrame, path: str) -> None:
    """Reports (date, analysis_type, ...) as JSON below ``date=/analysis_type=`` folders."""
    reports.write.mode("append").partitionBy("date", "analysis_type").json(path)
