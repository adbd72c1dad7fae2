"""Session helper and durable intermediate results."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", name: str = "salestide") -> SparkSession:
    """A session for tests and benches on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", os.environ.get("SALESTIDE_CHECKPOINTS", "/tmp/salestide-checkpoints"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_base(spark: SparkSession) -> str:
    """The folder below which driver and executors share files: ``spark.checkpoint.dir``; without it an error.

    A master on one machine alone has a folder of its own, as nothing else
    reads the files.
    """
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found is None and sc.master.startswith("local["):
        found = "/tmp/salestide-checkpoints"
    if found is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return found.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_base(df.sparkSession))
    return df.checkpoint(eager=True)


def stored_by(df: DataFrame, *keys: str) -> DataFrame:
    """Write ``df`` as Parquet bucketed by key in the shared folder and read it back.

    A lineage cut that is smaller than a checkpoint; windows, groups and joins
    over the keys find the rows of a key together, without another shuffle.
    """
    spark = df.sparkSession
    name = f"stored_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, *keys).write.format("parquet").option("path", f"{shared_base(spark)}/{name}").bucketBy(n, *keys).saveAsTable(name)
    return spark.table(name)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by key ahead of a grouped Python kernel.

    A fixed partition count keeps the adaptive planner from merging small (in
    bytes) but expensive (in Python time) partitions into one task.  It is
    twice the shuffle setting, because a repartition equal to the partitioning
    already at hand would be optimised away, and merged again.
    """
    n = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)
