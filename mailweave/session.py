"""Spark session helpers.

The library never hard-codes a storage location: derived tables, stream
checkpoints and export folders live under ``spark.checkpoint.dir`` as set
by the cluster. Only when that setting is absent (local tests) do we pick a
fresh scratch folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "mailweave", extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_utc(spark)
    return spark


def ensure_utc(spark: SparkSession) -> None:
    """All time logic in this library is UTC wall-clock."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def work_dir(spark: SparkSession) -> str:
    """Shared folder for derived tables: ``spark.checkpoint.dir``.

    Read from the session. Where it is unset, a fresh folder of this machine
    serves a local session (tests); a cluster has to name one, because its
    executors would not see each other's files.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="mailweave-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A fresh, never-reused path under the shared work folder."""
    return "/".join([work_dir(spark), "mailweave", *parts, uuid.uuid4().hex])


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies directly in a folder (none if it isn't there)."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [st.getPath().getName() for st in fs.listStatus(hpath)] if fs.exists(hpath) else []


def exchange(spark: SparkSession, beside: str, path: str, names: list[str]) -> None:
    """Put the folders ``names`` of ``beside`` in place of those of ``path``; what was there is
    kept under ``beside`` until all are exchanged, then ``beside`` is deleted."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    old = hpath(f"{beside}/_old")
    fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(old)
    for name in names:
        was, new = hpath(f"{path}/{name}"), hpath(f"{beside}/{name}")
        for a, b in ([(was, hpath(f"{beside}/_old/{name}"))] if fs.exists(was) else []) + ([(new, was)] if fs.exists(new) else []):
            if not fs.rename(a, b):
                raise OSError(f"could not move {a} to {b}; nothing is lost, old and new rows are in {beside}")
    fs.delete(hpath(beside), True)


def stamp(spark: SparkSession, path: str) -> tuple:
    """What changes when the files of a table change: their number, bytes and latest
    modification time."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    size = fs.getContentSummary(hpath)
    times = [st.getModificationTime() for st in fs.listStatus(hpath)]
    return int(size.getFileCount()), int(size.getLength()), max([fs.getFileStatus(hpath).getModificationTime(), *times])


def landed(df, *parts: str):
    """(frame, bytes): ``df`` written as Parquet into the shared folder and read
    back, and the size of its files, for choices that hang on a measured size."""
    spark = df.sparkSession
    path = scratch_path(spark, *parts)
    df.write.parquet(path)
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.schema(df.schema).parquet(path), int(fs.getContentSummary(hpath).getLength())


def dealt(df, *keys: str):
    """Deal rows over the session's shuffle partitions by ``keys``: a small file is
    one row group and so one task, however much work a row is."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


__all__ = ["build_session", "dealt", "ensure_utc", "exchange", "exists", "folders", "landed", "scratch_path", "stamp", "work_dir"]
