"""Session, table and lineage helpers shared by every operator."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, driver_memory: str = "4g") -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller passes its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("docgauge")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.files.openCostInBytes", "262144")  # small local files are split over all cores
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    reach(spark)
    return spark


def reach(spark: SparkSession) -> None:
    """Let Python workers import this package from where it lies, also when only the driver's path was extended."""
    home = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    paths = [x for x in env.get("PYTHONPATH", "").split(os.pathsep) if x]
    if home not in paths:
        env["PYTHONPATH"] = os.pathsep.join([home, *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables as Parquet."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Where that setting is absent, a local session
    gets a temporary folder that goes with the process, and any other is refused: its executors share no such folder.
    Files are removed as soon as nothing refers to them where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, which all executors share; set as ``cut`` says where it is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="docgauge-ckpt-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()
