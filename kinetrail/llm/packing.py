"""Packing by concatenate and cut.

Every document's ids, separator included, are laid end to end; the result is cut
into windows of a fixed length. Two passes of prefix sums (totals per partition,
then starts within a partition) give each document its global offset without
moving any text; windows that lie within one task are finished there and the
records of those that cross tasks meet in a group of at most one window.

Only the last sequence can be short. It is padded to the full length, except
where its length is a power of two.

Defined results: null or empty text is the separator alone; a null id stays
null; repeated rows are packed as often as they occur; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import VOCABULARY, id_type, token_table, with_global_starts

LENGTH = 1024
PIECE_SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
)


def cut(global_start: int, n_tokens: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document that begins at global_start."""
    first = min(n_tokens, length - global_start % length)
    return [(0, first)] + [(at, min(length, n_tokens - at)) for at in range(first, n_tokens, length)]


def pieces(tokens: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """One row per piece of a written token table."""

    kind = id_type(vocabulary)  # here, so that tasks need not load the vocabulary

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                docs, out = batch.column("doc_id"), {k: [] for k in ("row", "start", "n", "crc", "of", "seq", "at", "ids")}
                starts = batch.column("global_start").to_pylist()
                for row, (begin, blob) in enumerate(zip(starts, batch.column("ids"), strict=True)):
                    ids = np.frombuffer(blob.as_buffer(), dtype=kind)
                    wide = ids.astype("<u4")
                    for start, n in cut(begin, len(ids), length):
                        out["row"].append(row)
                        out["start"].append(start)
                        out["n"].append(n)
                        out["crc"].append(zlib.crc32(wide[start : start + n].data))
                        out["of"].append(len(ids))
                        out["seq"].append((begin + start) // length)
                        out["at"].append((begin + start) % length)
                        out["ids"].append(ids[start : start + n].tobytes() if with_ids else None)
                yield pa.RecordBatch.from_arrays(
                    [docs.take(pa.array(out["row"], type=pa.int64()))]
                    + [pa.array(out[k], type=pa.int64()) for k in ("start", "n", "crc", "of", "seq", "at")]
                    + [pa.array(out["ids"], type=pa.binary())],
                    names=[x.split()[0] for x in PIECE_SCHEMA.split(", ")],
                )

    placed = with_global_starts(tokens).select("doc_id", "ids", "global_start")
    return placed.mapInArrow(split, PIECE_SCHEMA)


def pack(docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY) -> DataFrame:
    """The packing as one row per piece: doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset."""
    return pieces(token_table(docs, vocabulary), length, vocabulary).drop("ids")


def stretches(tokens: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY) -> DataFrame:
    """(sequence_id, at, ids): what one task holds of a sequence without a gap,
    all of it where no other task began or ends the window."""
    width = id_type(vocabulary).itemsize
    body = length * width

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, begin, parts, end = -1, 0, [], -1
        done: tuple[list[int], list[int], list[bytes]] = ([], [], [])

        def close() -> None:
            if parts:
                for column, value in zip(done, (seq, begin, b"".join(parts)), strict=True):
                    column.append(value)

        def batch_of() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.binary())
            out = [pa.array(c, type=k) for c, k in zip(done, kinds, strict=True)]
            for column in done:
                column.clear()
            return pa.RecordBatch.from_arrays(out, names=["sequence_id", "at", "ids"])

        for batch in batches:
            for start, blob in zip(batch.column(1).to_pylist(), batch.column(0), strict=True):
                ids, read, start = blob.as_buffer().to_pybytes(), 0, start * width
                while read < len(ids):
                    s, at = divmod(start + read, body)
                    n = min(body - at, len(ids) - read)
                    if s != seq or at != end:
                        close()
                        seq, begin, parts = s, at // width, []
                    parts.append(ids[read : read + n])
                    read, end = read + n, at + n
                if len(done[0]) >= 1024:
                    yield batch_of()
        close()
        yield batch_of()

    return with_global_starts(tokens).select("ids", "global_start").mapInArrow(join, "sequence_id long, at long, ids binary")


def sequences(tokens: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY) -> DataFrame:
    """(sequence_id, n_tokens, ids): the unpadded sequences of a token table.
    Only stretches shorter than a window are shuffled."""
    width = id_type(vocabulary).itemsize
    records = stretches(tokens, length, vocabulary)
    whole = F.octet_length("ids") == length * width
    crossing = (
        records.filter(~whole)
        .groupBy("sequence_id")
        .agg(F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("parts"))
        .select("sequence_id", F.expr("aggregate(parts, cast('' as binary), (a, p) -> a || p.ids)").alias("ids"))
    )
    return records.filter(whole).select("sequence_id", "ids").unionByName(crossing).select(
        "sequence_id", (F.octet_length("ids") / F.lit(width)).cast("long").alias("n_tokens"), "ids"
    )


def padded_length(n: int, length: int = LENGTH) -> int:
    """Length after padding: full, except at a power of two."""
    return n if n & (n - 1) == 0 else length
