"""Training-order output of token ids as fixed-stride binary shards.

Sequences have dense numbers 0..n-1. A keyed Feistel network over the next even
power of two, walked until the value falls below n, permutes them: every
sequence computes its own global slot, no sort or random column is needed, and
the inverse tells which sequence lies in a slot. Shard k holds the slots
[k * per_shard, (k + 1) * per_shard) in order, as one file of records of one
length: a 4-byte little-endian token count, the ids padded with 0, one byte
"\n". A reader that stopped at slot s goes on at shard s // per_shard, byte
(s % per_shard) * stride: read_shards(from_slot=s).

Slots are dealt by range: since they are dense, the ranges' borders are known
without sampling, and a range is a number of whole shards. What crosses the
shuffle are compressed blocks of records of one range; sequences that two tasks
hold in part are put together in their range.

Spark's text writer writes the bytes, so that any store that Spark reaches will
do; its line separator is the record's last byte.

Defined results: null and empty texts are a separator each; repeated rows are
written as often as they occur; an empty table gives no shard; other columns are
not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, scratch_path
from .packing import LENGTH, stretches
from .tokens import VOCABULARY, id_type, token_table

SEED = 77_003
ROUNDS = 6
#: Records of a shard: 134 MB at 1,024 ids of 2 bytes; fewer where the corpus would not give FEW_SHARDS.
PER_SHARD, FEW_SHARDS = 65_536, 128
#: Ranges that the slots are dealt to at most; beyond, a range holds several shards.
MOST_RANGES = 20_000
#: Bytes of records that a task gathers before it deals them, and records of a block.
GATHERED, BLOCK = 32 << 20, 64
END = b"\n"


def _round(half: np.ndarray, key: int, turn: int, mask: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = half + np.uint64((key * 0x9E3779B97F4A7C15 + turn * 0xC2B2AE3D27D4EB4F) % 2**64)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x & np.uint64(mask)


def permute(values: np.ndarray, n: int, key: int = SEED, inverse: bool = False) -> np.ndarray:
    """The permutation of 0..n-1 (or its inverse) at values."""
    bits = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = (1 << bits) - 1, np.uint64(bits)
    out = np.asarray(values, dtype=np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & np.uint64(mask)
        for turn in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
            if inverse:
                left, right = right ^ _round(left, key, turn, mask), left
            else:
                left, right = right, left ^ _round(right, key, turn, mask)
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= n]  # cycle-walking
    return out.astype(np.int64)


def stride(length: int = LENGTH, vocabulary: str = VOCABULARY) -> int:
    return 4 + length * id_type(vocabulary).itemsize + len(END)


def shard_size(n: int) -> int:
    """Records of a shard in a corpus of n sequences."""
    return max(1, min(PER_SHARD, -(-n // FEW_SHARDS)))


def write_shards(
    parts: DataFrame,
    path: str,
    n: int,
    length: int = LENGTH,
    per_shard: int | None = None,
    key: int = SEED,
    vocabulary: str = VOCABULARY,
) -> int:
    """Write the n sequences that parts (sequence_id dense from 0, at, ids) hold
    under path, one file in path/shard=k for each shard; returns the records of
    a shard. A sequence may be one row or several without a gap or overlap.
    """
    per_shard = per_shard or shard_size(n)
    width = id_type(vocabulary).itemsize
    body = length * width
    step = 4 + body
    shards = max(1, -(-n // per_shard))
    ranges = min(shards, MOST_RANGES)
    per_range = -(-shards // ranges) * per_shard

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of records of one range; a part of a sequence is a record too."""
        press = zstandard.ZstdCompressor(level=4)

        def blocks(gathered: list[pa.RecordBatch]) -> pa.RecordBatch:
            slots = permute(np.concatenate([b.column(0).to_numpy() for b in gathered]), n, key)
            places = np.concatenate([b.column(1).to_numpy() for b in gathered]).astype("<u4")
            ids = [x.as_buffer() for b in gathered for x in b.column(2)]
            counts = np.array([x.size for x in ids]) // width
            whole = counts == length
            rows = np.zeros((len(ids), step), dtype=np.uint8)
            rows[:, :4] = counts.astype("<u4").view(np.uint8).reshape(-1, 4)
            rows[whole, 4:] = np.frombuffer(b"".join(ids[i] for i in np.flatnonzero(whole)), np.uint8).reshape(-1, body)
            for i in np.flatnonzero(~whole):
                rows[i, 4 : 4 + ids[i].size] = np.frombuffer(ids[i], np.uint8)
            order = np.argsort(slots, kind="stable")
            lanes = slots[order] // per_range
            borders = np.flatnonzero(np.diff(lanes, prepend=-1, append=-1))
            cuts = [order[at : min(at + BLOCK, end)] for begin, end in pairwise(borders) for at in range(begin, end, BLOCK)]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([int(slots[c[0]] // per_range) for c in cuts], type=pa.int32()),
                    pa.array([slots[c].astype("<i8").tobytes() for c in cuts], type=pa.binary()),
                    pa.array([places[c].tobytes() for c in cuts], type=pa.binary()),
                    pa.array([press.compress(rows[c].tobytes()) for c in cuts], type=pa.binary()),
                ],
                names=["range", "slots", "places", "block"],
            )

        gathered, held = [], 0
        for batch in batches:
            gathered.append(batch)
            held += batch.num_rows * step
            if held >= GATHERED:
                yield blocks(gathered)
                gathered, held = [], 0
        if held:
            yield blocks(gathered)

    def records(slots: np.ndarray, data: bytes) -> pa.RecordBatch:
        at = pa.py_buffer(np.arange(0, len(data) + 1, step, dtype=np.int32))
        values = pa.Array.from_buffers(pa.binary(), len(slots), [None, at, pa.py_buffer(data)])
        return pa.RecordBatch.from_arrays([pa.array(slots // per_shard), pa.array(slots), values], names=["shard", "slot", "value"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress, parts = zstandard.ZstdDecompressor(), {}
        for batch in batches:
            for slots, places, block in zip(*(batch.column(c) for c in ("slots", "places", "block")), strict=True):
                slots = np.frombuffer(slots.as_buffer(), "<i8")
                data = unpress.decompress(block.as_buffer())
                rows = np.frombuffer(data, np.uint8).reshape(-1, step)
                counts = np.ascontiguousarray(rows[:, :4]).view("<u4")[:, 0]
                whole = counts == length
                for i in np.flatnonzero(~whole):  # two at most for each task that made token rows
                    at, count = 4 + width * int(np.frombuffer(places.as_buffer(), "<u4")[i]), int(counts[i])
                    record, had = parts.get(int(slots[i]), (bytearray(step), 0))
                    record[at : at + count * width] = data[i * step + 4 : i * step + 4 + count * width]
                    parts[int(slots[i])] = record, had + count
                if whole.all():
                    yield records(slots, data)
                elif whole.any():
                    yield records(slots[whole], rows[whole].tobytes())
        for slot, (record, count) in parts.items():
            record[:4] = count.to_bytes(4, "little")
            yield records(np.array([slot]), bytes(record))

    blocks = parts.select("sequence_id", "at", "ids").mapInArrow(deal, "range int, slots binary, places binary, block binary")
    with bounded_batches(parts.sparkSession):
        (
            blocks.repartitionById(ranges, "range")
            .select("slots", "places", "block")
            .mapInArrow(unpack, "shard long, slot long, value binary")
            .sortWithinPartitions("shard", "slot")
            .select("shard", F.col("value").cast("string").alias("value"))
            .write.partitionBy("shard")
            .option("lineSep", END.decode())
            .text(path)
        )
    return per_shard


def read_shards(
    spark: SparkSession,
    path: str,
    n: int,
    length: int = LENGTH,
    per_shard: int | None = None,
    key: int = SEED,
    vocabulary: str = VOCABULARY,
    with_ids: bool = True,
    from_slot: int = 0,
) -> DataFrame:
    """sequence_id, slot, shard, byte_offset, n_tokens, ids_crc32 (over the ids
    as little-endian unsigned 32 bits) and, if wanted, ids of the records from
    from_slot on; earlier shards are not opened."""
    kind, step, per_shard = id_type(vocabulary), stride(length, vocabulary), per_shard or shard_size(n)
    schema = "sequence_id long, slot long, shard long, byte_offset long, n_tokens long, ids_crc32 long, ids binary"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, blob in zip(batch.column("shard").to_pylist(), batch.column("content"), strict=True):
                data = memoryview(blob.as_buffer())
                if len(data) % step:
                    raise ValueError(f"shard {shard} is no whole number of records")
                for low in range(max(0, from_slot - shard * per_shard) * step, len(data), 512 * step):
                    at = np.arange(low, min(len(data), low + 512 * step), step)
                    slots = shard * per_shard + at // step
                    sizes = [int.from_bytes(data[i : i + 4], "little") for i in at]
                    ids = [np.frombuffer(data[i + 4 : i + 4 + k * kind.itemsize], kind) for i, k in zip(at, sizes, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(permute(slots, n, key, inverse=True)),
                            pa.array(slots),
                            pa.array(np.full(len(at), shard, dtype=np.int64)),
                            pa.array(at.astype(np.int64)),
                            pa.array(sizes, type=pa.int64()),
                            pa.array([zlib.crc32(x.astype("<u4").data) for x in ids], type=pa.int64()),
                            pa.array([x.tobytes() if with_ids else None for x in ids], type=pa.binary()),
                        ],
                        names=[c.split()[0] for c in schema.split(", ")],
                    )

    # the folder's name is a column of its own: earlier shards are pruned
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    shards = files.select(F.col("shard").cast("long").alias("shard"), "content").filter(F.col("shard") >= from_slot // per_shard)
    return shards.mapInArrow(parse, schema)


def training_order(
    docs: DataFrame, length: int = LENGTH, per_shard: int | None = None, key: int = SEED, vocabulary: str = VOCABULARY
) -> DataFrame:
    """Writes the shards of docs in the shared folder and reports what lies in
    them: sequence_id, slot, shard, byte_offset, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    tokens = token_table(docs, vocabulary)
    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    path, n = scratch_path(spark, "shards"), -(-total // length)
    if not n:
        return spark.createDataFrame([], "sequence_id long, slot long, shard long, byte_offset long, n_tokens long, ids_crc32 long")
    per_shard = write_shards(stretches(tokens, length, vocabulary), path, n, length, per_shard, key, vocabulary)
    return read_shards(spark, path, n, length, per_shard, key, vocabulary, with_ids=False).drop("ids")
