"""Session helpers: a tuned local session for tests and lineage cuts that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def local_session(cores: int = 8, partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller's own session is used as it is."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("plumbline")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder for tables that cut lineage: the one that the cluster names in ``spark.checkpoint.dir``.

    Only where none is set (tests) a temporary one is made, and only for a local master, whose executors are the driver.
    """
    sc = spark.sparkContext
    named = sc._jsc.sc().getCheckpointDir()
    if not named.isEmpty():
        return named.get()
    folder = sc.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="plumbline-")
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame, **counts: Column) -> DataFrame:
    """``df`` as a table written to the shared folder: its lineage ends there, and its size is known to later plans.

    ``counts`` are aggregates that the writing itself takes; the result has them as ``counts``, without a job of their own.

    Unlike a checkpoint the table carries no constraints of the plan it came from, which multiply from round to round of
    an iteration.
    """
    folder = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    seen = Observation() if counts else None
    (df.observe(seen, *[c.alias(n) for n, c in counts.items()]) if seen else df).write.parquet(folder)
    done = df.sparkSession.read.schema(df.schema).parquet(folder)
    done.cut_folder = folder
    done.counts = seen.get if seen else {}
    return done


def forget(df: DataFrame) -> None:
    """Remove the table of a frame that ``cut`` gave; call it when nothing reads it any more."""
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(df.cut_folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, *key: str) -> DataFrame:
    """``df``, a plain scan, in as many partitions as the cluster has cores, if the files give fewer.

    Large tables have more splits than cores and stay as they are; a table in one small file would keep one core busy.
    The hash of ``key`` places rows, so that a task that runs again gets the same ones.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *key) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
