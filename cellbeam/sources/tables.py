"""Intermediate tables in the shared folder, and checkpoints that are whole or not there."""

from __future__ import annotations

import json
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Name of the marker that is written last into a version of a checkpoint.
MARKER = "_COMMITTED"


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset and all tasks run in this process, a new temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="cellbeam-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """The same rows, written below the shared folder and read back: what builds on them does not compute them again."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def versions(spark: SparkSession, path: str) -> list[str]:
    """Whole versions of a checkpoint, oldest first."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())
    return [f"{path}/{n}" for n in names if fs.exists(_path(spark, f"{path}/{n}/{MARKER}")[0])]


def write_checkpoint(tables: dict[str, DataFrame], path: str, keep: int = 2) -> str:
    """Write one Parquet table per name as a new version below ``path`` and give its folder.

    The marker is written after all tables, so a version without it does not count: a write that fails, or a driver
    that is lost, leaves the version before as it was. Afterwards whole versions beyond the newest ``keep`` and
    older unfinished ones are deleted. Tables may be made from the version that they replace. One writer at a time.
    """
    if not tables:
        raise ValueError("a checkpoint needs a table")
    if keep < 1:
        raise ValueError("the new version is kept at least")
    spark = next(iter(tables.values())).sparkSession
    own = f"{path}/v{time.time_ns():020d}"
    for name, df in tables.items():
        df.write.parquet(f"{own}/{name}")
    rows = [(name, df.schema.json()) for name, df in tables.items()]
    marked = spark.createDataFrame(rows, "name string, columns string").coalesce(1)
    marked.write.parquet(f"{own}/{MARKER}.part")
    _, fs = _path(spark, own)
    if not fs.rename(_path(spark, f"{own}/{MARKER}.part")[0], _path(spark, f"{own}/{MARKER}")[0]):
        raise OSError(f"{own} could not be committed")
    whole = versions(spark, path)
    for s in fs.listStatus(_path(spark, path)[0]):
        name = s.getPath().getName()
        if s.isDirectory() and re.fullmatch(r"v\d{20}", name) and name < own.rpartition("/")[2] and f"{path}/{name}" not in whole[-keep:]:
            fs.delete(s.getPath(), True)
    return own


def read_checkpoint(spark: SparkSession, path: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Tables of the newest whole version, all or those of ``names`` that it holds; none where there is no version."""
    whole = versions(spark, path)
    if not whole:
        return {}
    held = spark.read.parquet(f"{whole[-1]}/{MARKER}").collect()
    return {r["name"]: spark.read.schema(T.StructType.fromJson(json.loads(r["columns"]))).parquet(f"{whole[-1]}/{r['name']}") for r in held if names is None or r["name"] in names}
