"""Table access and shared scratch space of the pipeline operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark alone so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only a local session without that setting gets a temporary folder; on a
    cluster a missing setting is an error, as a local folder would lose files.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if path is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="rillstone-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def scratch(spark: SparkSession, tag: str, owner: str = "") -> str:
    """A new path in the shared folder; `release(spark, owner)` deletes it, and else the
    end of the application does (see `keep_until_exit`)."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _made.setdefault(owner, []).append(path)
    return path


def release(spark: SparkSession, owner: str = "") -> None:
    """Delete the scratch tables of an owner whose results are no longer read."""
    for path in _made.pop(owner, []):
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def keep_until_exit(spark: SparkSession, path: str) -> None:
    """What is written there goes when the driver ends: a result that is still to be
    read may rest on it until then."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)


def settle(df: DataFrame, tag: str, owner: str = "") -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = scratch(spark, tag, owner)
    df.write.parquet(path)
    keep_until_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(name: str, taken: list[str]) -> str:
    """The name, with marks behind it until no column has it."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name
