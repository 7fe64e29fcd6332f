"""Tables that a job writes for itself, in the folder that all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder of this application in spark.checkpoint.dir; a folder of our own
    only where none is set and the session runs on one machine."""
    app = spark.sparkContext.applicationId
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named.rstrip('/')}/kinetrail-tables-{app}"
    if app not in _own_dirs:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors see")
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="kinetrail-tables-")
    return _own_dirs[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table of its own, read back: what reads it twice computes
    it once, and a lost executor costs no more than its tasks."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cleanup(spark: SparkSession) -> None:
    """Removes all tables that this application has written so. To be called when
    no DataFrame of it is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
