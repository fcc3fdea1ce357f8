"""Session helpers shared by every operator."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shuffle_partitions(spark: SparkSession) -> int:
    """Partitions for stages that run Python code and so must not be coalesced."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows over all cores, where a scan has fewer partitions than there are cores (a small file with one row group)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """Folder of this application's tables, inside ``spark.checkpoint.dir``; removed when the application ends.

    Where the setting is unset, a temporary folder serves a local master, whose tasks all run on this machine; on a
    cluster that is an error, since the machines would each write to a disk of their own.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="terazi-")
        sc.setCheckpointDir(folder)
        atexit.register(shutil.rmtree, folder, True)
    own = f"{folder.rstrip('/')}/terazi-{sc.applicationId}"
    if own not in _OWN:
        path = sc._jvm.org.apache.hadoop.fs.Path(own)
        files = path.getFileSystem(sc._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _OWN.add(own)
    return own


#: Folders that are removed at the end.
_OWN: set[str] = set()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    The lineage ends there: every executor can read the table, and losing one loses nothing.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Let Python workers find this package wherever the driver was started, on machines that share its folder.

    Each worker's linear algebra runs on one thread: a core has a task of its own.
    """
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS"):
        env.setdefault(name, "1")
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if here not in paths:
        env["PYTHONPATH"] = os.pathsep.join([here, *paths])
