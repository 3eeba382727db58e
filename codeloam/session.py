"""Session helpers: table access, lineage cuts in the shared folder, partition sizing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(app: str = "codeloam", cores: str = "8") -> SparkSession:
    """A local session with the settings the engine expects (UTC, adaptive execution, Arrow)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table ``name`` of the data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session, else one of our own (local runs)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="codeloam-"))
    return sc.getCheckpointDir().rstrip("/")


def cut(df: DataFrame, file_rows: int = 0) -> DataFrame:
    """Cut the lineage: write ``df`` once into the shared folder and read it back.

    Unlike a checkpoint the last stage runs once, the copy is columnar, and it outlives lost executors. ``file_rows`` is
    the most rows that a file may have, 0 any number. Shuffle files of the step are deleted when the copy stands.
    """
    path = _new_path(df.sparkSession)
    with _own_shuffles(df.sparkSession):
        df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def _own_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is run inside has its shuffle files deleted at its end, not when the driver happens to collect its garbage."""
    was = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN, was) if was is not None else spark.conf.unset(CLEAN)


def drop(*tables: DataFrame) -> None:
    """Delete the files of tables that ``cut`` gave and that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for df in tables for f in df.inputFiles()}:
        fs, at = pafs.FileSystem.from_uri(path)
        fs.delete_dir(at)


def row_blocks(df: DataFrame, rows: int) -> list[list[tuple[str, int, int]]]:
    """The rows of a table that ``cut`` gave in blocks of ``rows``: its files, with the first row and that after the last.

    Tasks read a block by ``read_rows`` where it lies, so no copy of it is made for any of them.
    """
    out: list[list[tuple[str, int, int]]] = []
    room = 0
    for name in sorted(df.inputFiles()):
        fs, path = pafs.FileSystem.from_uri(name)
        with fs.open_input_file(path) as f:
            n = pq.ParquetFile(f).metadata.num_rows
        at = 0
        while at < n:
            if not room:
                out.append([])
                room = rows
            end = min(n, at + room)
            out[-1].append((name, at, end))
            room -= end - at
            at = end
    return out


def read_rows(block: list[tuple[str, int, int]]) -> pd.DataFrame:
    """The rows of a block."""
    parts = []
    for name, begin, end in block:
        fs, path = pafs.FileSystem.from_uri(name)
        with fs.open_input_file(path) as f:
            parts.append(pq.ParquetFile(f).read().slice(begin, end - begin))
    return pa.concat_tables(parts).to_pandas()


def _new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/codeloam-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def write_parts(df: DataFrame, key: str) -> str:
    """Write ``df`` into a new folder of the shared one, a part for each value of ``key``; tasks read it by ``read_part``.

    What many tasks need is so written once, where a shuffle would write a copy for each of them.
    """
    path = _new_path(df.sparkSession)
    with _own_shuffles(df.sparkSession):
        df.write.partitionBy(key).parquet(path)
    return path


def part_table(folder: str, key: str, value: int) -> pa.Table | None:
    """Rows of one part, without the key, if there is such a part."""
    fs, path = pafs.FileSystem.from_uri(folder)
    files = [f.path for f in fs.get_file_info(pafs.FileSelector(f"{path}/{key}={value}", allow_not_found=True)) if f.path.endswith(".parquet")]
    return pa.concat_tables([pq.ParquetFile(fs.open_input_file(f)).read() for f in sorted(files)]) if files else None


def read_part(folder: str, key: str, value: int) -> pd.DataFrame:
    """Rows of one part, without the key; no part is an empty table without columns."""
    part = part_table(folder, key, value)
    return pd.DataFrame() if part is None else part.to_pandas()


def width(spark: SparkSession) -> int:
    """Partitions for CPU-bound stages: what the session sets for shuffles, at least three per core."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread the rows of a scan over all cores by the hash of ``keys`` if the scan has too few tasks for them.

    A scan that has enough tasks, as any large one, is left alone and shuffles nothing.
    """
    n = width(df.sparkSession)
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n, *[F.col(k) for k in keys])


def salt_width(spark: SparkSession) -> int:
    """Parts into which one hot key is split before a second aggregation."""
    return max(8, spark.sparkContext.defaultParallelism)


def bounded(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """``df`` marked for broadcast if a count proves it has at most ``max_rows`` rows, else as it is (a shuffle join)."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def without_repeats(df: DataFrame, key: str) -> DataFrame:
    """The distinct rows of ``df``, whose rows with equal ``key`` are mostly equal, without moving the others.

    A small scan is spread over the cores anyway, and the same exchange drops the repeats. Of a large one only the keys
    that stand more than once are counted; their rows alone are compared whole, all others pass where they are, as long
    as the list of repeated keys is small enough for every executor.
    """
    if df.rdd.getNumPartitions() < width(df.sparkSession):
        return df.distinct()
    repeated = bounded(df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(F.col(key).alias("_k")), 1_000_000)
    same = F.col(key).eqNullSafe(F.col("_k"))
    return df.join(repeated, same, "left_anti").union(df.join(repeated, same, "left_semi").distinct())
