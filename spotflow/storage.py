"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; one in the warehouse where a local session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = spark.conf.get("spark.sql.warehouse.dir", "spark-warehouse").rstrip("/") + "/_spotflow"
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: computed once, cuts the lineage, survives lost executors.

    The files go when the driver's Python ends, or with forget().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spotflow-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    _pending[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._spotflow_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete the files of stored() tables that nothing will read again."""
    for t in tables:
        if (path := getattr(t, "_spotflow_path", None)) is not None:
            _pending.pop(path, None)
            _drop(t.sparkSession, path)


_pending: dict[str, SparkSession] = {}


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target.getParent(), True)
    except Exception:  # the JVM may be gone already
        pass


@atexit.register
def _drop_all() -> None:
    for path, spark in _pending.items():
        _drop(spark, path)
