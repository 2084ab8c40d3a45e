"""Table access, and lineage cut in the shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shaped(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """A SELECT over named tables, each written ``{name}``."""
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in tables})


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where that is unset, a folder of this machine if all tasks run on it, else an error."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="marlstone-"))
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the reliable checkpoint folder, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
