"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts spell it: space and U+0009..U+000D.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder of this application that the driver and all executors see, in
    spark.checkpoint.dir.

    Where the session names none and runs on one machine (tests), a folder of our
    own is made once per application and also becomes the checkpoint folder.
    """
    app = spark.sparkContext.applicationId
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named.rstrip('/')}/kinetrail-{app}"
    if app not in _own_dirs:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors see")
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="kinetrail-")
        spark.sparkContext.setCheckpointDir(_own_dirs[app])
    return _own_dirs[app]


def cleanup(spark: SparkSession) -> None:
    """Removes all tables that this application has written in the shared folder.
    To be called when no DataFrame of it is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage
    in a form that outlives any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def bounded_batches(spark: SparkSession, megabytes: int = 8) -> Iterator[None]:
    """While a job runs, Arrow batches that go to Python hold about so many MB at
    most, whatever the length of their rows. For eager writes only."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, megabytes << 20)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_row_id(docs: DataFrame) -> DataFrame:
    """docs with _uid, a number of the row that is the same in every scan: from
    file and position where docs is a plain scan, else written with the rows."""
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):  # these repeat no row
        node = node.children().head()
    if node.nodeName() == "LogicalRelation":
        try:
            return docs.select("*", F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("_uid"))
        except AnalysisException:  # not Parquet
            pass
    return materialise(docs.withColumn("_uid", F.monotonically_increasing_id()), "rows")


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text column with null as the empty string."""
    return F.coalesce(df[column], F.lit(""))


def shard_count(rows: int, per_shard: int, least: int = 64) -> int:
    """Shards such that each holds about per_shard keys."""
    return max(least, -(-rows // per_shard))


def dealt_anew(key: str) -> Column:
    """The value of a long column under a new name for the planner: a join on it
    gets an exchange of its own, and with one on either side AQE can split a hot
    key. A table that an aggregate has dealt out already would get none."""
    return F.bitwise_not(F.bitwise_not(F.col(key))).alias(key)
