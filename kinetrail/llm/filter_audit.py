"""How filters interact: what each order of five filters removes, step by step.

The documents are read as a stream of files in available-now micro-batches. Every
row becomes a mask of the filters that it fails. Four of them look at the text
alone; the fifth fails a row whose text a smaller id has, which a later batch can
bring. A state per text, keyed by digest, holds the smallest id so far and the
rows that have it. When a smaller id arrives, the earlier rows are retracted from
the counters of their part (-1 as first, +1 as copy). The counters are the only
thing that the report reads: 32 masks a part, whatever the number of documents.

The keyed state is laid out in shards of digests: one state row holds some
TEXTS_PER_SHARD of them, since a call per key costs more than its work. Rows of a
text are summed up in their task first, so that a hot text reaches its shard once
per task. Counters of a micro-batch lie in a folder of its number: a batch that
is run again replaces them. A stream that is called again with new files under
the same folder goes on from its state.

Defined results: null text and source are empty; a row without id is no copy and
makes no other row one; rows that repeat the smallest id of a text are all first;
a document's labels count as their largest, and none is 0; an empty table gives
no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import permutations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .common import bounded_batches, scratch_path, shard_count, text_of

#: The filters, in the order of their bits; COPY needs the whole table.
FILTERS = "ABCDE"
COPY = 16
#: Bits beside the filters of the text: labels of the row.
GOOD, TOXIC = 32, 64
ORDERS = ["".join(p) for p in permutations(FILTERS)]
TEXTS_PER_SHARD = 256
#: A micro-batch takes files of about so many bytes.
BATCH_BYTES = 2 << 40
#: Distinct texts that a task sums up before it hands them on.
HELD = 50_000

STATE = "digests array<binary>, ids array<long>, parts array<string>, flags array<int>, counts array<long>"
MOVES = "part string, flags int, n long"

_UPPER = bytes(range(65, 91))
_SIGNS = b"#$%&*|"
_TAILS = bytes(range(128, 192))  # bytes of a UTF-8 character after its first


def text_mask(raw: bytes) -> int:
    """Bits of the filters A to D that a text (UTF-8) fails."""
    words = raw.split()  # of bytes: exactly space and U+0009..U+000D
    points = len(raw.translate(None, _TAILS))
    upper = len(raw) - len(raw.translate(None, _UPPER))
    signs = len(raw) - len(raw.translate(None, _SIGNS))
    return (
        (len(words) < 50)
        | (100 * len(set(words)) < 65 * len(words)) << 1
        | (100 * upper > 5 * points) << 2
        | (signs > 0) << 3
    )


def _masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t.as_buffer() for t in batch.column(2)]
        digests = pa.array([hashlib.sha256(t).digest() for t in texts], type=pa.binary())
        masks = pa.array([text_mask(t.to_pybytes()) for t in texts], type=pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), digests, masks], names=["doc_id", "part", "digest", "flags"])


def _summed(shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (doc_id, part, digest, flags) of a task, summed by (digest, part,
    flags): rows in all, the smallest id and the rows that have it."""

    def flush(held: dict) -> pa.RecordBatch:
        keys = list(held)
        first, n, at_first = zip(*held.values(), strict=True)
        columns = {
            "shard": pa.array([int.from_bytes(k[0][:7], "big") % shards for k in keys], type=pa.int64()),
            "digest": pa.array([k[0] for k in keys], type=pa.binary()),
            "part": pa.array([k[1] for k in keys], type=pa.string()),
            "flags": pa.array([k[2] for k in keys], type=pa.int32()),
            "known": pa.array([k[3] for k in keys], type=pa.bool_()),
            "first": pa.array(first, type=pa.int64()),
            "n": pa.array(n, type=pa.int64()),
            "at_first": pa.array(at_first, type=pa.int64()),
        }
        return pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[int]] = {}
        for batch in batches:
            for doc, part, digest, flags in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key, doc = (digest, part, flags, doc is not None), doc or 0
                known = held.get(key)
                if known is None:
                    held[key] = [doc, 1, 1]
                    continue
                known[1] += 1
                if doc < known[0]:
                    known[0], known[2] = doc, 1
                elif doc == known[0]:
                    known[2] += 1
            if len(held) >= HELD:
                yield flush(held)
                held = {}
        if held:
            yield flush(held)

    return run


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Moves of the counters that a shard's new rows cause."""
    held: dict[bytes, tuple[int, dict]] = {}  # digest: smallest id, rows that have it by (part, flags)
    if state.exists:
        for digest, doc, part, flags, n in zip(*state.get, strict=True):
            held.setdefault(bytes(digest), (doc, {}))[1][part, flags] = n
    moves: Counter = Counter()
    for frame in frames:
        columns = (frame[c].tolist() for c in ("digest", "part", "flags", "known", "first", "n", "at_first"))
        for digest, part, flags, known, first, n, at_first in zip(*columns, strict=True):
            if not known:
                moves[part, flags] += n
                continue
            moves[part, flags | COPY] += n
            digest = bytes(digest)
            if digest not in held or first < held[digest][0]:
                for (p, f), k in held.get(digest, (0, {}))[1].items():  # what was first is a copy from now on
                    moves[p, f] -= k
                    moves[p, f | COPY] += k
                held[digest] = (first, {})
            if first == held[digest][0]:
                rows = held[digest][1]
                rows[part, flags] = rows.get((part, flags), 0) + at_first
                moves[part, flags | COPY] -= at_first
                moves[part, flags] += at_first
    flat = [(d, i, p, f, k) for d, (i, rows) in held.items() for (p, f), k in rows.items()]
    if flat:
        state.update(tuple(map(list, zip(*flat, strict=True))))
    rows = [(p, f, k) for (p, f), k in moves.items() if k]
    yield pd.DataFrame(rows, columns=["part", "flags", "n"])


@contextmanager
def _rocks_db(spark: SparkSession) -> Iterator[None]:
    """States of streams that start here lie in RocksDB: on disk, not in the heap,
    and without files that are laid out larger than their content."""
    store = "spark.sql.streaming.stateStore"
    wanted = {
        f"{store}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        f"{store}.rocksdb.allowFAllocate": "false",
        f"{store}.rocksdb.changelogCheckpointing.enabled": "true",
    }
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def update_counters(
    spark: SparkSession, path: str, labels: DataFrame, folder: str, shards: int | None = None, batch_bytes: int = BATCH_BYTES,
    files_per_batch: int | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
) -> None:
    """Takes the files under path that folder has not seen yet into its state and
    counters.

    labels: doc_id, quality, toxic. shards: keys of the state, fixed by the first
    call (the table's rows over TEXTS_PER_SHARD).
    """
    table = spark.read.parquet(path)
    kept = spark.read.schema("shards long").json(f"{folder}/settings") if _found(spark, f"{folder}/settings")[0] else None
    if kept is not None:
        shards = kept.first()["shards"]
    else:
        shards = shards or shard_count(table.count(), TEXTS_PER_SHARD)
        spark.range(1).select(F.lit(shards).cast("long").alias("shards")).coalesce(1).write.json(f"{folder}/settings")
        spark.createDataFrame([], MOVES).coalesce(1).write.parquet(f"{folder}/counters/batch=-1")
    limit = {"maxFilesPerTrigger": files_per_batch} if files_per_batch else {"maxBytesPerTrigger": batch_bytes}
    # a stream takes a folder or a pattern: a single file is named by a pattern that only it fits
    source = f"{path[:-1]}[{path[-1]}]" if _found(spark, path)[1] else path
    files = spark.readStream.schema(table.schema).options(**limit).parquet(source)
    slim = files.select(
        files[id_col].cast("long").alias("doc_id"),
        F.coalesce(files[part_col].cast("string"), F.lit("")).alias("part"),
        text_of(files, text_col).cast("binary").alias("text"),
    )
    masked = slim.mapInArrow(_masked, "doc_id long, part string, digest binary, flags int")
    # a row without id gets a key of its own, so that such rows are spread; it meets no label
    masked = masked.withColumn("_key", F.coalesce("doc_id", F.xxhash64("digest")))
    own = labels.groupBy(labels["doc_id"].cast("long").alias("_id")).agg(
        (F.when(F.max("quality") == 1, GOOD).otherwise(0) + F.when(F.max("toxic") == 1, TOXIC).otherwise(0)).alias("_labels")
    )
    rows = masked.join(own, (F.col("_key") == F.col("_id")) & F.col("doc_id").isNotNull(), "left")
    rows = rows.select("doc_id", "part", "digest", (F.col("flags") + F.coalesce("_labels", F.lit(0))).cast("int").alias("flags"))
    summed = rows.mapInArrow(
        _summed(shards), "shard long, digest binary, part string, flags int, known boolean, first long, n long, at_first long"
    )
    moves = summed.groupBy("shard").applyInPandasWithState(_advance, MOVES, STATE, "update", GroupStateTimeout.NoTimeout)

    def store(batch: DataFrame, number: int) -> None:
        counters = batch.groupBy("part", "flags").agg(F.sum("n").alias("n"))
        counters.write.mode("overwrite").parquet(f"{folder}/counters/batch={number}")

    with _rocks_db(spark), bounded_batches(spark):
        stream = moves.writeStream.foreachBatch(store).outputMode("update").option("checkpointLocation", f"{folder}/state")
        stream.trigger(availableNow=True).start().awaitTermination()


def _found(spark: SparkSession, path: str) -> tuple[bool, bool]:
    """Does the path exist, and is it a file?"""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return store.exists(at), store.exists(at) and store.getFileStatus(at).isFile()


def report(spark: SparkSession, folder: str) -> DataFrame:
    """Per part, order and step: kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley, from the counters of folder."""
    moves = spark.read.schema(MOVES).parquet(f"{folder}/counters")
    mask, n = F.col("flags").bitwiseAND(31), F.col("n")
    masks = moves.groupBy("part", mask.alias("mask")).agg(
        F.sum(n).alias("n"),
        F.sum(F.when(F.col("flags").bitwiseAND(GOOD) != 0, n).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("flags").bitwiseAND(TOXIC) != 0, n).otherwise(0)).alias("toxic"),
    )
    # 32 masks a part at most
    parts = masks.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("_masks"))
    orders = parts.withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS))))
    steps = orders.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit = lambda text: sum((F.when(F.contains(text, F.lit(c)), 1 << i).otherwise(0) for i, c in enumerate(FILTERS)), F.lit(0))
    steps = steps.withColumn("_own", bit(F.substring("filter_order", F.col("step"), F.lit(1))))
    steps = steps.withColumn("_before", bit(F.substring("filter_order", F.lit(1), F.col("step") - 1)))
    fails = lambda m: m["mask"].bitwiseAND(F.col("_own")) != 0
    gone = lambda m: m["mask"].bitwiseAND(F.col("_before")) != 0

    def total(which: Callable, value: Callable = lambda m: m["n"]):
        return F.aggregate(F.filter("_masks", which), F.lit(0).cast("long"), lambda a, m: a + value(m))

    removed = lambda m: fails(m) & ~gone(m)
    return steps.select(
        "part", "filter_order", "step",
        total(lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        total(removed).alias("removed"),
        total(lambda m: fails(m) & gone(m)).alias("redundant"),
        total(lambda m: m["mask"] == F.col("_own")).alias("unique_fails"),
        total(removed, lambda m: m["good"]).alias("good_lost"),
        total(removed, lambda m: m["toxic"]).alias("toxic_lost"),
        # a row that fails k filters is removed by each of them in 120 / k orders
        total(fails, lambda m: m["n"] * (F.lit(len(ORDERS)) / F.bit_count(m["mask"])).cast("long")).alias("shapley"),
    )


def audit(spark: SparkSession, path: str, labels: DataFrame, **settings) -> DataFrame:
    """The report over all files under path; settings: of update_counters()."""
    folder = scratch_path(spark, "filter-audit")
    update_counters(spark, path, labels, folder, **settings)
    return report(spark, folder)
