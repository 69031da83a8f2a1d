"""Tables that are read more than once, and the spread of rows over cores."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_KEPT: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a temporary one only where none is set and Spark is local."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named is None:
        if sc.getCheckpointDir() is not None:
            return sc.getCheckpointDir()
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="lexforge-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keep(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back; it stays until :func:`release` or the driver's end."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df))


def written(df: DataFrame) -> str:
    """As :func:`keep`; the folder of the table, for tasks that read it themselves."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lexforge-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _KEPT:
        atexit.register(release, spark)
    _KEPT.append(path)
    return path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete kept tables that nothing reads any more, and the shuffle files of plans that are gone, which else stay until the driver happens to collect its garbage."""
    for path in paths:
        _delete(spark, path)
        _KEPT.remove(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stream(path: str, rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` of a table that :func:`written` made, always in the same order; nothing of it is copied."""
    where, root = fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))
    for name in sorted(f.path for f in where.get_file_info(fs.FileSelector(root)) if f.path.endswith(".parquet")):
        with where.open_input_file(name) as f:
            yield from pq.ParquetFile(f).iter_batches(rows)


def release(spark: SparkSession) -> int:
    """Drop all kept tables, once no result that reads them is needed any more; their number."""
    n = len(_KEPT)
    try:
        for path in _KEPT:
            _delete(spark, path)
    except Exception:  # noqa: BLE001 - the session may be gone by then
        pass
    _KEPT.clear()
    return n


def spread(df: DataFrame, per_core: int = 1) -> DataFrame:
    """``df`` as it is if its scan has a split for each core; only fewer splits are dealt out anew. For tables, not for results of shuffles."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(per_core * cores)
