"""Session, table and checkpoint helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[8]", app: str = "recordloom", **conf: str) -> SparkSession:
    """A session with the settings the engine expects; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame, estimates: bool = True) -> DataFrame:
    """Cut the lineage into the shared folder that the cluster names.

    The folder is ``spark.checkpoint.dir`` of the session; only where that is unset (tests on one
    machine) a folder of our own is made.  Never ``localCheckpoint``: its blocks die with an executor.

    A checkpoint keeps the size that was estimated of its plan.  Joins multiply sizes, so in a loop of joins the
    number's digits at least double in each round until they fill the driver; without ``estimates`` it is forgotten.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
            where = tempfile.mkdtemp(prefix=f"recordloom-{os.getpid()}-")
        sc.setCheckpointDir(where)
    kept = df.checkpoint(eager=True)
    if estimates:
        return kept
    plain = kept._jdf.queryExecution().toRdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(plain, kept._jdf.schema(), False), spark)
