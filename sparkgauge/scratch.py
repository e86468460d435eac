"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a local session gets a folder of its own; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="sparkgauge-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def path(spark: SparkSession, name: str) -> str:
    """A new place in the folder; those of a job stand under the folder that ``run`` named, if it did."""
    job = spark.conf.get("sparkgauge.run", None)
    return "/".join([root(spark), *([job] if job else []), f"{name}-{uuid.uuid4().hex}"])


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once, read back: cuts lineage between the steps of a chain, and survives lost executors."""
    spark, to = df.sparkSession, path(df.sparkSession, name)
    df.write.parquet(to)
    return spark.read.schema(df.schema).parquet(to)


class run:
    """A job whose tables are removed at its end: ``with scratch.run(spark): ...``; results must be written inside."""

    def __init__(self, spark: SparkSession):
        self.spark, self.name = spark, f"run-{uuid.uuid4().hex}"

    def __enter__(self) -> run:
        self.before = self.spark.conf.get("sparkgauge.run", None)
        self.spark.conf.set("sparkgauge.run", self.name)
        return self

    def __exit__(self, *error) -> None:
        if self.before is None:
            self.spark.conf.unset("sparkgauge.run")
        else:
            self.spark.conf.set("sparkgauge.run", self.before)
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{root(self.spark)}/{self.name}")
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
