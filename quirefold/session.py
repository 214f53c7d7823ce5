"""Session defaults, table access and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "quirefold", cpus: int | None = None, partitions: int | None = None) -> SparkSession:
    """A local session with the settings that the library is written for.

    On a cluster the caller brings its own session; nothing here is needed then.
    """
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions or n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; ``name`` is a Parquet file or folder."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table to the shared checkpoint folder and return it
    read back.

    The folder is the session's ``spark.checkpoint.dir``. Only where that is
    unset (tests, a single machine) a temporary folder is taken. The table
    lies in the shared file system, so it survives the loss of executors; and
    unlike ``checkpoint()``, which counts the rows first and then computes
    them again to save them, it is computed once.
    """
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or _own_folder(spark)
    path = f"{shared.rstrip('/')}/quirefold-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _own_folder(spark: SparkSession) -> str:
    """The context's checkpoint folder; a temporary one only where driver and
    executors are one machine, and removed when the driver ends."""
    set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_dir.isDefined():
        return set_dir.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="quirefold-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir("file://" + folder)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def spread(scan: DataFrame) -> DataFrame:
    """Repartition a scan that gives fewer tasks than there are cores.

    Small files with heavy per-row work are read as one task; this evens the
    rows out over the cores. It decides on the plan only, never on the result,
    and only for scans (counting the tasks of a join would run it); with as
    many tasks as cores, as at scale, no shuffle is added.
    """
    want = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= want else scan.repartition(want)
