"""Approximate nearest neighbours by an adaptive dimension scan over lists.

Centroids, fitted on a bounded sample by k-means, deal every vector into a cell;
a second set of centroids, fitted on what is left after the first, splits the
cells of a large table, so that a list does not grow with it. Lists are stored in
blocks of a bounded number of vectors. A block holds its vectors turned by a
random rotation, dimension by dimension, so that a scan reads a few dimensions of
all vectors at a time. After each group of dimensions a hypothesis test compares
the scaled partial distance with the k-th best distance so far: a vector is given
up once its true distance exceeds that with high probability. Who is left gets
the exact distance on the original vectors. A query's nearest list is scanned
first; the k-th best of it bounds the scans of all others.

Queries are dealt in blocks as well, so that one list with a third of all rows
becomes many pairs of blocks and no task holds more than one pair.

Defined results: null ids, null and zero vectors, vectors with null or
non-finite components and vectors of another length than the most frequent one
take no part; equal distances are ordered by the smaller vec_id; equal vectors
are candidates like others; rows that repeat a vec_id count once per vector;
fewer than k candidates give fewer rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

K = 10
#: Rows that the centroids are fitted on, about; twice as many at most.
TRAINING_ROWS = 16_384
#: Centroids of either level are shipped with the tasks: at most this many (1 MB at 64 dimensions).
MOST_CENTROIDS = 4_096
#: Mean rows of a list from which on the second level splits it.
LIST_ROWS = 4_096
#: Lists that a query probes: the fewest with this recall on the sample, where
#: neighbours lie further apart than in the whole table.
RECALL, FIRST_RECALL, CALIBRATION_QUERIES = 0.96, 0.98, 256
BLOCK_ROWS, QUERY_ROWS = 1_024, 512
#: Rows of the list of lists up to which it is broadcast.
BROADCAST_ROWS = 1_000_000
#: Dimensions read between two tests, and the test's width.
STEP, EPSILON = 16, 2.1
SEED = 5


def valid_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vector) of the rows that take part; components stay float where
    they are, else they are double."""
    kind = "array<float>" if table.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = table.select(table[id_col].cast("long").alias("vec_id"), table[vector_col].cast(kind).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
    return rows.filter(finite & F.exists("vector", lambda x: x != 0))


def of_width(rows: DataFrame, width: int) -> DataFrame:
    return rows.filter(F.size("vector") == width)


def rotation(width: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = SEED) -> np.ndarray:
    """K-means over a bounded sample; empty clusters start again at far points."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(sample, axis=0)
    lists = max(1, min(lists, len(distinct)))
    centroids = distinct[rng.choice(len(distinct), lists, replace=False)].copy()
    for _ in range(rounds):
        near = nearest_lists(sample, centroids, 1)[:, 0]
        counts = np.bincount(near, minlength=lists)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        full = counts > 0
        centroids[full] = sums[full] / counts[full, None]
        if not full.all():
            centroids[~full] = distinct[rng.choice(len(distinct), int((~full).sum()))]
    return centroids


def nearest_lists(vectors: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    n = min(n, len(centroids))
    out = np.empty((len(vectors), n), dtype=np.int32)
    norms = (centroids**2).sum(axis=1)
    for at in range(0, len(vectors), 2048):
        d = norms - 2 * vectors[at : at + 2048] @ centroids.T
        part = np.argpartition(d, n - 1, axis=1)[:, :n] if n < len(centroids) else np.argsort(d, axis=1)
        out[at : at + 2048] = part
    return out


class Cells:
    """The centroids of both levels and how many cells a query looks at."""

    def __init__(self, sample: np.ndarray, rows: int, k: int = K, probes: int | None = None) -> None:
        self.first = fit_centroids(sample, min(MOST_CENTROIDS, max(1, int(rows**0.5))))
        rest = sample - self.first[nearest_lists(sample, self.first, 1)[:, 0]]
        split = min(MOST_CENTROIDS, -(-rows // (len(self.first) * LIST_ROWS)))
        self.second = fit_centroids(rest, split) if split > 1 else np.zeros((1, sample.shape[1]), dtype=sample.dtype)
        self.near, self.probes = self._calibrate(sample, k)
        if probes is not None:
            self.near, self.probes = max(self.near, -(-probes // len(self.second))), probes

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """The cell of each vector."""
        first = nearest_lists(vectors, self.first, 1)[:, 0]
        return first.astype(np.int64) * len(self.second) + nearest_lists(vectors - self.first[first], self.second, 1)[:, 0]

    def around(self, vector: np.ndarray, near: int, probes: int) -> np.ndarray:
        """The nearest cells of a query, nearest first."""
        first = np.argsort(((self.first - vector) ** 2).sum(axis=1), kind="stable")[:near]
        gap = vector - self.first[first]
        d = (gap**2).sum(axis=1)[:, None] - 2 * gap @ self.second.T + (self.second**2).sum(axis=1)
        cells = first[:, None].astype(np.int64) * len(self.second) + np.arange(len(self.second))
        return cells.ravel()[np.argsort(d.ravel(), kind="stable")[:probes]]

    def _calibrate(self, sample: np.ndarray, k: int) -> tuple[int, int]:
        """First centroids and cells that hold a share RECALL of the k nearest of
        sampled queries within the sample."""
        if len(sample) <= k:
            return len(self.first), len(self.first) * len(self.second)
        own, norms, nearest, ranks = self.of(sample), (sample**2).sum(axis=1), {}, []
        for i in range(0, len(sample), max(1, len(sample) // CALIBRATION_QUERIES)):
            d = norms - 2 * (sample @ sample[i])
            d[i] = np.inf
            nearest[i] = own[np.argpartition(d, k)[:k]]
            order = np.argsort(((self.first - sample[i]) ** 2).sum(axis=1), kind="stable")
            rank = np.empty(len(order), dtype=np.int64)
            rank[order] = np.arange(len(order))
            ranks.append(rank[nearest[i] // len(self.second)])
        near = int(np.quantile(np.concatenate(ranks), FIRST_RECALL, method="higher")) + 1
        ranks = []
        for i, cells in nearest.items():
            order = self.around(sample[i], near, near * len(self.second))
            place = {int(c): at for at, c in enumerate(order)}
            ranks.append([place.get(int(c), len(order)) for c in cells])
        return near, int(np.quantile(np.concatenate(ranks), RECALL, method="higher")) + 1


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, also where squares would leave it."""
    with np.errstate(over="ignore", under="ignore"):
        gap = vectors - query
        plain = (gap**2).sum(axis=1)
        out = np.sqrt(plain)
        odd = np.flatnonzero(~((plain > 1e-280) & (plain < np.inf)))
        if len(odd):  # zero, or beyond the range of squares: scaled by a power of two, which is exact
            half = vectors[odd] / 2 - query / 2
            most = np.abs(half).max(axis=1)
            scale = np.ldexp(1.0, np.frexp(np.where(most > 0, most, 1.0))[1] - 1)[:, None]
            out[odd] = np.sqrt(((half / scale) ** 2).sum(axis=1)) * scale[:, 0] * 2
    return out


def scan(
    query: np.ndarray, turned: np.ndarray, bound: float, columns: np.ndarray, vectors: np.ndarray, ids: np.ndarray, own: int, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact distances of the k nearest to a query in one block.

    query, vectors: original; turned, columns: rotated, columns by dimension;
    bound: what the k-th best is at most, squared, in the measure of columns.
    """
    width, n = columns.shape
    live = np.flatnonzero(ids != own)
    if not len(live):
        return ids[:0], np.zeros(0)
    first = live[: max(4 * k, 32)]  # the first few in full, for a threshold
    if len(first) >= k:
        whole = ((columns[:, first] - turned[:, None]) ** 2).sum(axis=0)
        bound = min(bound, np.partition(whole, k - 1)[k - 1])
    partial = np.zeros(len(live), dtype=np.float32)
    for at in range(0, width, STEP):
        end = min(at + STEP, width)
        part = columns[at:end] if len(live) == n else columns[at:end, live]
        partial += ((part - turned[at:end, None]) ** 2).sum(axis=0)
        if end == width:
            if len(live) > k:
                bound = min(bound, np.partition(partial, k - 1)[k - 1])
            live = live[partial <= bound * (1 + 1e-4) + 1e-12]
        elif np.isfinite(bound):
            stays = partial <= bound * (end / width) * (1 + EPSILON / np.sqrt(end)) ** 2 + 1e-12
            live, partial = live[stays], partial[stays]
        if not len(live):
            return ids[:0], np.zeros(0)
    exact = distances(vectors[live], query)
    order = np.lexsort((ids[live], exact))[:k]
    return ids[live][order], exact[order]


def search(
    table: DataFrame,
    queries: DataFrame | None = None,
    k: int = K,
    probes: int | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    every: int = 100,
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest among all rows but
    its own. queries: a table like table; without it, the rows of table whose
    id is divisible by every. probes: lists per query; without it calibrated."""
    spark = table.sparkSession
    valid = valid_vectors(table, id_col, vector_col)
    largest = F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double"))))
    # one row per width
    widths = valid.groupBy(F.size("vector").alias("width")).agg(F.count(F.lit(1)).alias("n"), F.max(largest).alias("largest"))
    told = widths.orderBy(F.desc("n"), "width").first()
    if told is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    total, width = told["n"], told["width"]
    rows = of_width(valid, width)
    asked = rows.filter(F.col("vec_id") % every == 0) if queries is None else of_width(valid_vectors(queries, id_col, vector_col), width)
    # single precision works on vectors scaled to below 2, whatever their size
    scale = float(np.ldexp(1.0, int(np.frexp(told["largest"])[1]) - 1))
    share = min(1.0, TRAINING_ROWS / total)
    picked = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).limit(2 * TRAINING_ROWS)
    sample = [r["vector"] for r in picked.select("vector").toLocalIterator()] or [rows.first()["vector"]]
    cells = Cells((np.array(sample, dtype=float) / scale).astype(np.float32), total, k, probes)
    turn = rotation(width)
    kind = "<f4" if "float" in rows.schema["vector"].dataType.simpleString() else "<f8"

    def deal(times: int):
        """A vector's cell, or a query's nearest cells with their rank."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                vectors = _matrix(batch.column(1)).astype(kind)
                small = (vectors.astype(float) / scale).astype(np.float32)
                lists = cells.of(small)[:, None] if times == 1 else np.array([cells.around(v, cells.near, times) for v in small])
                blobs = pa.array([v.tobytes() for v in vectors], type=pa.binary())
                index = pa.array(np.repeat(np.arange(len(vectors)), lists.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(index), pa.array(lists.ravel()), blobs.take(index),
                     pa.array(np.tile(np.arange(lists.shape[1], dtype=np.int32), len(vectors)))],
                    names=["vec_id", "list", "vector", "place"],
                )

        return run

    dealt = "vec_id long, list long, vector binary, place int"
    listed = materialise(rows.mapInArrow(deal(1), dealt).drop("place"), "listed")
    lists = listed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    lists = materialise(lists, "lists")
    lists = F.broadcast(lists) if lists.count() <= BROADCAST_ROWS else lists

    def pack_block(frame: pd.DataFrame) -> pd.DataFrame:
        vectors = np.frombuffer(b"".join(frame["vector"]), dtype=kind).reshape(-1, width)
        columns = np.ascontiguousarray(((vectors.astype(float) / scale).astype(np.float32) @ turn).T)
        row = (frame["list"].iloc[0], frame["block"].iloc[0], frame["vec_id"].to_numpy("<i8").tobytes(), vectors.tobytes(), columns.tobytes())
        return pd.DataFrame([row], columns=["list", "block", "ids", "vectors", "columns"])

    index = (
        listed.join(lists, "list")
        .withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
        .groupBy("list", "block")
        .applyInPandas(pack_block, "list long, block int, ids binary, vectors binary, columns binary")
    )
    index = materialise(index, "blocks")
    probing = materialise(asked.mapInArrow(deal(min(cells.probes, len(cells.first) * len(cells.second))), dealt), "probes")

    def pack_queries(frame: pd.DataFrame) -> pd.DataFrame:
        columns = (frame["vec_id"].to_numpy("<i8").tobytes(), b"".join(frame["vector"]), frame["bound"].to_numpy("<f8").tobytes())
        return pd.DataFrame([(frame["list"].iloc[0], *columns)], columns=["list", "query_ids", "queries", "bounds"])

    def scan_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = ("<i8", kind, "<f8", "<i8", kind, "<f4")
        for batch in batches:
            for i in range(batch.num_rows):
                query_ids, queries, bounds, ids, vectors, columns = (
                    np.frombuffer(batch.column(c)[i].as_buffer(), dtype=t) for c, t in enumerate(kinds)
                )
                queries, vectors = queries.reshape(-1, width).astype(float), vectors.reshape(-1, width).astype(float)
                turned, columns = (queries / scale).astype(np.float32) @ turn, columns.reshape(width, -1)
                limits = (bounds / scale) ** 2 * (1 + 1e-4) + 1e-12
                found = [scan(q, t, b, columns, vectors, ids, own, k) for q, t, b, own in zip(queries, turned, limits, query_ids, strict=True)]
                sizes = [len(f[0]) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(query_ids, sizes)), pa.array(np.concatenate([f[0] for f in found])),
                     pa.array(np.concatenate([f[1] for f in found]))],
                    names=["query_id", "vec_id", "score"],
                )

    def scanned(probing: DataFrame) -> DataFrame:
        """query_id, vec_id, score of the lists in probing (with bound)."""
        groups = probing.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("parts"))
        packed = (
            probing.join(groups, "list")
            .withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
            .groupBy("list", "part")
            .applyInPandas(pack_queries, "list long, query_ids binary, queries binary, bounds binary")
        )
        pairs = (
            packed.join(lists, "list")
            .withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
            .join(index, ["list", "block"])
            .select("query_ids", "queries", "bounds", "ids", "vectors", "columns")
        )
        return pairs.mapInArrow(scan_pairs, "query_id long, vec_id long, score double")

    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    near = scanned(probing.filter("place = 0").withColumn("bound", F.lit(float("inf"))))
    near = materialise(near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), "nearest-lists")
    bounds = near.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
    others = probing.filter("place > 0").join(bounds, "vec_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    return (
        near.drop("rank")
        .unionByName(scanned(others))
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
