"""Session plumbing shared by all operators: code shipping, table access, checkpoints, input spreading."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_ZIP: list[str] = []


def ready(spark: SparkSession) -> SparkSession:
    """Make the package importable in Python workers and give checkpoints a home.

    The checkpoint folder is the one named in ``spark.checkpoint.dir``. Where it is unset a folder of this machine is
    chosen in local mode (tests) only; on a cluster that would lose data, so it is refused.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        if not _ZIP:
            root = Path(__file__).resolve().parent
            target = os.path.join(tempfile.mkdtemp(prefix="sestante-code-"), "sestante_code.zip")
            with zipfile.ZipFile(target, "w") as z:
                for p in sorted(root.rglob("*.py")):
                    z.write(p, Path("sestante") / p.relative_to(root))
            _ZIP.append(target)
        sc.addPyFile(_ZIP[0])
        _SHIPPED.add(sc.applicationId)
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="sestante-checkpoint-"))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``folder``."""
    return ready(spark).read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Enough partitions for the cluster where a small input arrives in fewer splits than there are cores.

    Inputs that already have a split per core are left alone, so no shuffle is added at scale. Only for plans without a
    shuffle, such as scans and checkpoints: adaptive execution would run a shuffle just to count its partitions.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    ready(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage as ``cut`` does, in compressed Parquet files of the same folder: for wide rows such as texts."""
    spark = ready(df.sparkSession)
    folder = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4()}"
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def release(spark: SparkSession) -> None:
    """Give up the shuffle files of plans that nothing holds any more, which otherwise stay until the driver's heap is full."""
    for _ in range(2):  # Python's handles are given back by a thread of their own, and Spark's cleaner is another
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


__all__ = ["StorageLevel", "cut", "ready", "release", "spread", "stored", "table"]
