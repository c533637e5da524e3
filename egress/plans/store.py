"""Where intermediate tables go: the folder that the cluster names, shared by all executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where it is unset and the master is local (tests, a laptop), a fresh local folder is
    set and returned. On a cluster an unset folder is an error, since a machine-local
    folder would not be seen by the other executors.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not getattr(shared_dir, "own", None):
        shared_dir.own = tempfile.mkdtemp(prefix="egress-", dir="/tmp")
    return shared_dir.own


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/egress/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written once to the shared folder as Parquet and read back: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


def released(*tables: DataFrame) -> None:
    """Deletes the files of tables that :func:`written` returned and no later plan reads, as a loop's finished rounds."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table._written_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
