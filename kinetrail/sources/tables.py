"""Readers with explicit schemas and contract checks, and the sinks."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.constants import BEHAVIORS, KEYPOINTS, SESSION_BEHAVIORS, UNSCORABLE

FEATURES = T.StructType(
    [T.StructField("frame", T.LongType())]
    + [
        T.StructField(c, T.DoubleType())
        for c in (
            "move_nose", "move_body", "bp_sum", "bp_mean", "bp_min", "bp_max",
            *(f"roll{w}s_{s}" for w in ("2", "5", "6", "7_5", "15") for s in ("mean", "sum")),
            "prob_sum", "prob_mean", "low_prob_01", "low_prob_05", "low_prob_075",
        )
    ]
    + [T.StructField("rule_label", T.IntegerType())]
)
_TYPES = {"string": T.StringType, "int": T.IntegerType, "long": T.LongType, "double": T.DoubleType, "boolean": T.BooleanType}


def struct(columns: str) -> T.StructType:
    """A schema of "name type" pairs; needs no session."""
    pairs = [c.split() for c in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]()) for name, kind in pairs])


LABELS = struct("session_id string, animal_id string, field int, behavior string, start_frame long, end_frame long, annotator string")
MANIFEST = struct("session_id string, animal_id string, apparatus string, fps double, pose_model string, lighting string")
OBJECTS = struct("session_id string, object_id int, center_x double, center_y double, radius double")
FLOORS = struct("arena string, corner int, x double, y double, sessions int")
PROGRESS = struct("session_id string, annotator string, watched_until long, n_frames long, behaviors string, assisted boolean, mode string, seen string")


def pose_schema(keypoints: Sequence[str] = KEYPOINTS) -> T.StructType:
    fields = [T.StructField("frame", T.LongType()), T.StructField("time_ms", T.DoubleType()), T.StructField("field", T.IntegerType())]
    return T.StructType(fields + [T.StructField(f"{k}_{a}", T.DoubleType()) for k in keypoints for a in "xyp"])


def without_nan(df: DataFrame) -> DataFrame:
    """NaN becomes null in every floating column: Spark orders NaN above all."""
    return df.withColumns({f.name: F.nanvl(F.col(f.name), F.lit(None)) for f in df.schema if isinstance(f.dataType, T.DoubleType | T.FloatType)})


def require_columns(df: DataFrame, schema: T.StructType) -> None:
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """CSV with a header; columns by name, typed by schema."""
    raw = spark.read.csv(path, header=True)
    require_columns(raw, schema)
    return without_nan(raw.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema)))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def refused(df: DataFrame, bad: Column, why: str) -> DataFrame:
    """df; the job that reads it fails at a row where bad holds. The check is part
    of the plan, so that nothing is read for it alone, and no column list drops it."""
    return df.filter(F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit(why))).otherwise(F.lit(True)))


def checked_features(df: DataFrame, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """df, or a ValueError at once if a frame occurs twice: a job of its own."""
    if not duplicate_keys(df, keys).isEmpty():
        raise ValueError("duplicate frames")
    return df


def unique_frames(df: DataFrame, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """df; an error where it is read if a frame occurs twice."""
    twice = F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1
    return refused(df.withColumn("_twice", twice), F.col("_twice"), "duplicate frames").drop("_twice")


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return unique_frames(read_csv(spark, path, FEATURES)).orderBy("frame")


def _violation(behaviors: Sequence[str]) -> Column:
    known = F.coalesce(F.col("behavior").isin(*behaviors), F.lit(False))
    return ~known | F.coalesce(F.col("start_frame") > F.col("end_frame"), F.lit(False))


VOCABULARY = (*BEHAVIORS, *SESSION_BEHAVIORS, UNSCORABLE)


def label_violations(df: DataFrame, behaviors: Sequence[str] = VOCABULARY) -> DataFrame:
    """Rows with an unknown behaviour or an end before the start."""
    return df.filter(_violation(behaviors))


def checked_labels(df: DataFrame, behaviors: Sequence[str] = VOCABULARY) -> DataFrame:
    """df; an error where it is read if a behaviour is unknown or an interval ends
    before it starts."""
    return refused(df, _violation(behaviors), "unknown behaviours or intervals that end before they start")


def read_labels(spark: SparkSession, path: str, behaviors: Sequence[str] = VOCABULARY) -> DataFrame:
    return checked_labels(read_csv(spark, path, LABELS), behaviors)


def _plain(name: Column) -> Column:
    """An escaped name as it was; most names hold nothing to decode."""
    return F.when(name.contains("%"), F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))).otherwise(name)


@contextmanager
def _few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Folders are listed by some tasks a core: by default each folder, up to 10,000,
    is a task of its own, which takes far longer to start than to list it."""
    asked = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(asked)
    spark.conf.set(asked, str(min(int(before), max(32, 4 * spark.sparkContext.defaultParallelism))))
    try:
        yield
    finally:
        spark.conf.set(asked, before)


def read_sessions(spark: SparkSession, path: str, schema: T.StructType, objects: DataFrame | None = None) -> DataFrame:
    """CSV by session; the session id is the name of a session_id=... folder, else
    the file's stem; folders below path are searched. With objects only sessions that
    have some."""
    parent = F.substring_index(F.substring_index(F.col("_metadata.file_path"), "/", -2), "/", 1)
    folder = F.when(parent.startswith("session_id="), F.substring(parent, len("session_id=") + 1, 1 << 30)).otherwise("")
    name = F.col("_metadata.file_name")
    stem = F.when(name.endswith(".csv"), F.expr("left(_metadata.file_name, length(_metadata.file_name) - 4)")).otherwise("")
    with _few_listing_tasks(spark):
        # what Spark does to find columns in the folders' names grows with the square of their number
        listed = spark.read.csv(path, header=True, recursiveFileLookup=True)
        if any(f.name not in listed.columns for f in schema):
            listed = spark.read.csv(path, header=True)
    # a folder's name is escaped once as a partition's name, once as a path
    raw = listed.withColumn("session_id", F.when(folder != "", _plain(_plain(folder))).otherwise(stem))
    require_columns(raw, schema)
    df = without_nan(raw.select("session_id", *(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema)))
    return df if objects is None else df.join(objects.select("session_id"), "session_id", "left_semi")


def write_sessions(df: DataFrame, path: str) -> None:
    """A session_id=... folder with one CSV per session, as partitionBy() gives.

    On a local or mounted file system Spark's writer starts a process for every folder
    and file that it makes, to set its mode; there the tasks write the lines
    that Spark has formatted themselves. A file appears under its name when it is whole,
    so that a task may be repeated.
    """
    spark, columns = df.sparkSession, [c for c in df.columns if c != "session_id"]
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    dealt = df.repartition("session_id")
    if system.getUri().getScheme() != "file":
        dealt.write.partitionBy("session_id").csv(path, header=True)
        return
    home, header = system.makeQualified(target).toUri().getPath(), ",".join(columns)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, file = None, None

        def finish() -> None:
            file.close()
            os.replace(file.name, os.path.join(os.path.dirname(file.name), "part.csv"))

        for batch in batches:
            for own, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if file is None or own != session:
                    if file is not None:
                        finish()
                    session, folder = own, os.path.join(home, "session_id=" + (quote(own, safe="") if own else "__HIVE_DEFAULT_PARTITION__"))
                    os.makedirs(folder, exist_ok=True)
                    file = open(os.path.join(folder, f".{uuid.uuid4().hex}"), "w", encoding="utf-8", newline="")  # noqa: SIM115 closed by finish()
                    file.write(header + "\n")
                file.write(line + "\n")
            yield batch.slice(0, 0)
        if file is not None:
            finish()

    lines = dealt.select("session_id", F.to_csv(F.struct(*columns)).alias("line")).sortWithinPartitions("session_id")
    lines.mapInArrow(write, lines.schema).write.format("noop").mode("overwrite").save()


def load_floors(corners: DataFrame) -> DataFrame:
    """(arena, polygon): corners in order."""
    listed = F.sort_array(F.collect_list(F.struct("corner", "x", "y")))
    return corners.groupBy("arena").agg(F.transform(listed, lambda c: F.struct(c.x.alias("x"), c.y.alias("y"))).alias("polygon"))


def order_corners(corners: DataFrame, key: str = "arena") -> DataFrame:
    """Corners by angle round their centre, first the one with the least x + y:
    (key, x, y, corner from 0)."""
    w = Window.partitionBy(key)
    turned = corners.withColumn("_a", F.atan2(F.col("y") - F.avg("y").over(w), F.col("x") - F.avg("x").over(w)))
    placed = turned.withColumn("_i", F.row_number().over(w.orderBy("_a")) - 1)
    first = F.min(F.struct((F.col("x") + F.col("y")).alias("s"), "_i")).over(w)["_i"]
    n = F.count(F.lit(1)).over(w)
    return placed.withColumn("corner", F.pmod(F.col("_i") - first, n).cast("int")).select(key, "x", "y", "corner")


def floor_for(sessions: DataFrame, floors: DataFrame, pose: DataFrame, threshold: float = 0.25) -> DataFrame:
    """(session_id, polygon): the arena's floor, else the rectangle of the 1st and
    99th percentiles of confident body positions. sessions: session_id, arena."""
    ok = pose.filter(F.col("body_p") >= threshold)
    cut = lambda c: F.percentile(c, F.array(F.lit(0.01), F.lit(0.99)))
    box = ok.groupBy("session_id").agg(cut("body_x").alias("_x"), cut("body_y").alias("_y"))
    corner = lambda i, j: F.struct(F.col("_x")[i].alias("x"), F.col("_y")[j].alias("y"))
    own = F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1))
    joined = sessions.join(floors, "arena", "left").join(box, "session_id", "left")
    return joined.select("session_id", F.coalesce("polygon", F.when(F.col("_x").isNotNull(), own)).alias("polygon"))


def import_counts(lines: DataFrame, prefix: str = "F") -> DataFrame:
    """Rows of a spreadsheet export without header to reference counts.

    lines: line (order, a whole number), c0 ... c12. A "Dia n" in the first column
    holds for the rows below; numbers have a decimal comma. Headers are carried
    down within blocks of 100,000 numbers, and into a block from those before it.
    """
    day = F.when(F.col("c0").startswith("Dia"), F.split("c0", " +")[1].cast("int"))
    lines = lines.withColumn("_day", day).withColumn("_block", F.expr("line div 100000"))
    last = lines.groupBy("_block").agg(F.max_by("_day", F.when(F.col("_day").isNotNull(), F.col("line"))).alias("_last"))
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    before = last.select("_block", F.last("_last", ignorenulls=True).over(earlier).alias("_before"))
    within = Window.partitionBy("_block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("_own", F.last("_day", ignorenulls=True).over(within)).join(before, "_block")
    carried = F.coalesce("_own", "_before")
    number = lambda c: F.regexp_replace(F.regexp_replace(F.trim(c), r"\.", ""), ",", ".").try_cast("double")
    rows = lines.withColumn("day", carried).filter(F.col("day").isNotNull() & F.trim("c1").rlike("^[0-9]+$"))
    rat = F.trim("c1").cast("int")
    field = F.regexp_extract(F.trim("c2"), "^([0-9]+)", 1).cast("int")
    return rows.select(
        F.format_string("HD%d_%s%d_cam%d", "day", F.lit(prefix), rat, field).alias("session_id"), "day",
        F.concat(F.lit(prefix), rat.cast("string")).alias("rat"), F.trim("c2").alias("box"),
        number("c5").alias("rearings_20min"), number("c12").alias("rearings_5min"), number("c3").alias("distance_20min_m"), number("c11").alias("distance_5min_m"),
    )


def list_videos(spark: SparkSession, path: str) -> DataFrame:
    """(name, digest) of files under 2 GB; larger ones need a listing with a
    digest column."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.md5("content").alias("digest"))


def build_manifest(files: DataFrame, prefix: str = "") -> DataFrame:
    """One row per occupied camera of every distinct video, the first name of
    equal digests: session, animal, phase, camera, field, source.

    Names are "PHASE a-b-c" or "Dia n - a-b-c"; X is an empty camera.
    """
    first = files.withColumn("_r", F.row_number().over(Window.partitionBy("digest").orderBy("name"))).filter("_r = 1")
    stem = F.trim(F.regexp_replace("name", r"\.[^.]*$", ""))
    day = F.regexp_extract(stem, r"(?i)^dia\s*(\d+)\s*-\s*([0-9Xx-]+)", 1)
    phase = F.when(day != "", F.concat(F.lit("HD"), day)).otherwise(F.upper(F.regexp_extract(stem, r"^([A-Za-z]+)[ _]+([0-9Xx-]+)", 1)))
    ids = F.when(day != "", F.regexp_extract(stem, r"(?i)^dia\s*\d+\s*-\s*([0-9Xx-]+)", 1)).otherwise(F.regexp_extract(stem, r"^[A-Za-z]+[ _]+([0-9Xx-]+)", 1))
    named = first.withColumn("phase", phase).withColumn("_ids", ids).filter("phase <> '' and _ids <> ''")
    each = named.select("name", "phase", F.posexplode(F.slice(F.split("_ids", "-"), 1, 3)).alias("_i", "_a")).filter("upper(_a) <> 'X'")
    animal = F.concat(F.lit(prefix), F.col("_a"))
    camera = F.col("_i") + 1
    return each.select(
        F.concat(F.col("phase"), F.lit("_"), animal, F.lit("_cam"), camera.cast("string")).alias("session_id"), animal.alias("animal_id"), "phase",
        camera.alias("camera"), F.col("_i").alias("field"), F.col("name").alias("source_video"),
    )


def replace_rows(old: DataFrame, fresh: DataFrame, keys: Sequence[str] = ("session_id", "annotator")) -> DataFrame:
    """old without the keys of fresh, and fresh."""
    return old.join(fresh.select(*keys).distinct(), list(keys), "left_anti").unionByName(fresh)


def keep_last(df: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """The row with the highest version of every key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(version))
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def write_layers(layer: DataFrame, summary: DataFrame, path: str) -> None:
    """Frames partitioned by session, and one summary table."""
    layer.write.mode("overwrite").partitionBy("session_id").parquet(f"{path}/layers")
    summary.write.mode("overwrite").parquet(f"{path}/summary")


def input_digest(parts: Sequence[DataFrame], key: str = "session_id", digest: str = "digest") -> DataFrame:
    """(key, cache_key): one hash over the digests of all inputs of a session."""
    named = None
    for i, p in enumerate(parts):
        one = p.select(key, F.lit(i).alias("_i"), digest)
        named = one if named is None else named.unionByName(one)
    text = F.concat_ws("|", F.transform(F.sort_array(F.collect_list(F.struct("_i", digest))), lambda s: F.concat_ws(":", s["_i"].cast("string"), s[digest])))
    return named.groupBy(key).agg(F.sha2(text, 256).alias("cache_key"))


def stale_sessions(current: DataFrame, stored: DataFrame, key: str = "session_id") -> DataFrame:
    """Sessions whose inputs are not those of the stored features."""
    return current.join(stored, [key, "cache_key"], "left_anti")


def label_completeness(images: DataFrame, points: DataFrame, coordinates: Sequence[str], keypoints: int) -> DataFrame:
    """Per folder: images, complete, partial, empty. images: folder, image;
    points: folder, image and one column per coordinate."""
    marked = sum((F.col(c).isNotNull().cast("int") for c in coordinates), F.lit(0))
    counted = points.select("folder", "image", F.floor(marked / 2).cast("int").alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    return images.join(counted, ["folder", "image"], "left").groupBy("folder").agg(
        F.count(F.lit(1)).alias("images"), F.count_if(n == keypoints).alias("complete"),
        F.count_if((n > 0) & (n < keypoints)).alias("partial"), F.count_if(n == 0).alias("empty"),
    )


def blind_sessions(progress: DataFrame, behavior: str, trained: DataFrame | None = None) -> DataFrame:
    """Progress rows labelled without help for a behaviour (no list: all),
    without the sessions a model was trained on."""
    covers = F.coalesce(F.array_contains(F.split("behaviors", ";"), behavior), F.lit(True))
    rows = progress.filter(covers & ~F.coalesce("assisted", F.lit(False)))
    return rows if trained is None else rows.join(trained.select("session_id"), "session_id", "left_anti")
