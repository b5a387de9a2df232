"""Session helpers shared by every part of the library."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_LOCAL_DIRS: dict[str, str] = {}


def local_session(cores: int | str = "*", partitions: int = 8, driver_memory: str = "8g", **more: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own. more: further settings, with _ for the dots."""
    return (
        SparkSession.builder.config(map={k.replace("_", "."): v for k, v in more.items()})
        .master(f"local[{cores}]")
        .appName("tempora")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", driver_memory)
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir where it is set, else a folder for local runs."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        folder = _LOCAL_DIRS.setdefault(app, "") or f"file://{tempfile.mkdtemp(prefix='spark-')}"
        _LOCAL_DIRS[app] = folder
    return folder.rstrip("/")


def settled(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder, for what several parts of a plan read: computed once, and there after an executor is lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
