"""Exact dedup with a minimal perfect hash over historical distinct digests.

The history is pre-aggregated to one winner per digest, cut into shards by
digest and stored as one row per shard: the level bits of a minimal perfect
hash and, per slot, the full 32-byte digest and the winner's locator. Incoming
texts are pre-aggregated the same way, so that a digest reaches the lookup once
however many rows carry it. A lookup compares all 32 bytes, since a perfect
hash sends strangers to some slot too. Members update the slot's winner,
nonmembers stay groups of their own.

Defined results: null text counts as empty, and all empty texts form a group. A
null id loses every tie against a number. Of rows that repeat the winner's id and
length one is kept, so that one row of every group stays. An empty table gives no
rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, materialise, shard_count, text_of, with_row_id

#: Mean number of digests in a shard; bounds the memory of a build or lookup task.
DIGESTS_PER_SHARD = 50_000
#: Bits in a level for each key that is still unplaced.
GAMMA = 2.0
MAX_LEVELS = 200
#: Orders a null id after all others.
NO_ID = -(2**63)

INDEX_SCHEMA = (
    "shard int, keys long, level_sizes array<long>, bits binary, "
    "digests binary, ids binary, id_known binary, uids binary, lengths binary, counts binary"
)
GROUP_SCHEMA = "digest binary, keep_id long, keep_uid long, group_size long"


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", uid: Column | None = None) -> DataFrame:
    """(doc_id, length, digest): code points of the original text and SHA-256
    of the text without white space; uid too, if there is one."""
    text = text_of(docs, text_col)
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.length(text).cast("long").alias("length"),
        F.unhex(F.sha2(F.regexp_replace(text, SPACE, ""), 256)).alias("digest"),
        *([] if uid is None else [uid.alias("uid")]),
    )


def group_winners(rows: DataFrame) -> DataFrame:
    """One row per digest; the partial aggregate runs before the shuffle.

    pandas has no null long: a null id is 0 with known = false.
    """
    # -1 - id falls as the id grows and cannot overflow
    rank = F.struct("length", F.coalesce(-1 - F.col("doc_id"), F.lit(NO_ID)).alias("order"), "doc_id", "uid")
    return (
        rows.groupBy("digest")
        .agg(F.max(rank).alias("best"), F.count(F.lit(1)).alias("copies"))
        .select(
            "digest",
            "best.length",
            F.coalesce("best.doc_id", F.lit(0)).alias("doc_id"),
            F.col("best.doc_id").isNotNull().alias("known"),
            "best.uid",
            "copies",
        )
    )


def _lanes(digests: np.ndarray) -> np.ndarray:
    return np.frombuffer(digests.tobytes(), dtype="<u8").reshape(-1, 4)


def _place(lanes: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = lanes[:, level % 4] ^ (lanes[:, (level + 1) % 4] * np.uint64(2 * level + 0x9E3779B97F4A7C15))
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return (x % np.uint64(size)).astype(np.int64)


def build_mph(digests: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Level sizes, level bits and each key's slot, for n distinct 32-byte rows.

    In each level the keys that hash to a bit of their own are placed there; the
    others go on to the next level. A key's slot is the number of set bits
    before its own, so that the slots are exactly 0..n-1.
    """
    lanes = _lanes(digests)
    sizes: list[int] = []
    bits: list[np.ndarray] = []
    where = np.full(len(lanes), -1, dtype=np.int64)
    left, start = np.arange(len(lanes)), 0
    while len(left):
        if len(sizes) >= MAX_LEVELS:
            raise ValueError("digests of a shard are not distinct")
        size = max(64, int(GAMMA * len(left)))
        at = _place(lanes[left], len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        bits.append(alone)
        sizes.append(size)
        placed = alone[at]
        where[left[placed]] = start + at[placed]
        left, start = left[~placed], start + size
    flat = np.concatenate(bits) if bits else np.zeros(0, dtype=bool)
    return sizes, flat, (np.cumsum(flat) - 1)[where] if len(where) else where


def find_slots(digests: np.ndarray, sizes: list[int], flat: np.ndarray, slot_digests: np.ndarray) -> np.ndarray:
    """Slot of each digest, -1 for nonmembers; all bytes are compared."""
    lanes, rank = _lanes(digests), np.cumsum(flat) - 1
    slot = np.full(len(lanes), -1, dtype=np.int64)
    left, start = np.arange(len(lanes)), 0
    for level, size in enumerate(sizes):
        if not len(left):
            break
        at = start + _place(lanes[left], level, size)
        hit = flat[at]
        slot[left[hit]] = rank[at[hit]]
        left, start = left[~hit], start + size
    found = np.flatnonzero(slot >= 0)
    same = (slot_digests[slot[found]] == digests[found]).all(axis=1)
    slot[found[~same]] = -1
    return slot


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint8).reshape(-1, 32)


def _build_shard(frame: pd.DataFrame) -> pd.DataFrame:
    digests = _matrix(frame["digest"])
    sizes, flat, slot = build_mph(digests)
    order = np.argsort(slot)
    row = {
        "shard": int(frame["shard"].iloc[0]),
        "keys": len(frame),
        "level_sizes": sizes,
        "bits": np.packbits(flat).tobytes(),
        "digests": digests[order].tobytes(),
        "ids": frame["doc_id"].to_numpy(dtype="<i8")[order].tobytes(),
        "id_known": frame["known"].to_numpy(dtype=bool)[order].tobytes(),
        "uids": frame["uid"].to_numpy(dtype="<i8")[order].tobytes(),
        "lengths": frame["length"].to_numpy(dtype="<i8")[order].tobytes(),
        "counts": frame["copies"].to_numpy(dtype="<i8")[order].tobytes(),
    }
    return pd.DataFrame([row])


def _with_shard(groups: DataFrame, shards: int) -> DataFrame:
    return groups.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """Index over the distinct digests of history: one row per shard.

    history: groups as group_winners() gives them.
    """
    return _with_shard(history, shards).groupBy("shard").applyInPandas(_build_shard, INDEX_SCHEMA)


def _answers(digests: list[bytes], ids: np.ndarray, known: np.ndarray, uids: np.ndarray, sizes: np.ndarray) -> pd.DataFrame:
    keep = pd.array(ids, dtype="Int64")
    keep[~known] = pd.NA
    return pd.DataFrame({"digest": digests, "keep_id": keep, "keep_uid": uids, "group_size": sizes})


def _look_up(incoming: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    new_ids = incoming["doc_id"].to_numpy(dtype=np.int64)
    new_known = incoming["known"].to_numpy(dtype=bool)
    new_uids = incoming["uid"].to_numpy(dtype=np.int64)
    new_len = incoming["length"].to_numpy(dtype=np.int64)
    new_n = incoming["copies"].to_numpy(dtype=np.int64)
    if not len(index):
        return _answers(list(incoming["digest"]), new_ids, new_known, new_uids, new_n)
    shard = index.iloc[0]
    stored = np.frombuffer(shard["digests"], dtype=np.uint8).reshape(-1, 32)
    ids = np.frombuffer(shard["ids"], dtype="<i8").copy()
    known = np.frombuffer(shard["id_known"], dtype=bool).copy()
    uids = np.frombuffer(shard["uids"], dtype="<i8").copy()
    lengths = np.frombuffer(shard["lengths"], dtype="<i8")
    counts = np.frombuffer(shard["counts"], dtype="<i8").copy()
    answers = []
    if len(incoming):
        sizes = [int(x) for x in shard["level_sizes"]]
        flat = np.unpackbits(np.frombuffer(shard["bits"], dtype=np.uint8))[: sum(sizes)].astype(bool)
        slot = find_slots(_matrix(incoming["digest"]), sizes, flat, stored)
        hit = np.flatnonzero(slot >= 0)
        at = slot[hit]
        earlier = new_known[hit] & (~known[at] | (new_ids[hit] < ids[at]))
        better = (new_len[hit] > lengths[at]) | ((new_len[hit] == lengths[at]) & earlier)
        ids[at[better]] = new_ids[hit[better]]
        known[at[better]] = new_known[hit[better]]
        uids[at[better]] = new_uids[hit[better]]
        counts[at] += new_n[hit]
        own = np.flatnonzero(slot < 0)
        answers.append(
            _answers([incoming["digest"].iloc[i] for i in own], new_ids[own], new_known[own], new_uids[own], new_n[own])
        )
    answers.append(_answers([x.tobytes() for x in stored], ids, known, uids, counts))
    return pd.concat(answers)


def look_up(incoming: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """Final groups (digest, keep_id, keep_uid, group_size) of history and incoming.

    Shards are dealt to tasks by cogroup; a shard holds a bounded number of
    distinct digests whatever the number of copies.
    """
    keyed = _with_shard(incoming, shards)
    return keyed.groupBy("shard").cogroup(index.groupBy("shard")).applyInPandas(_look_up, GROUP_SCHEMA)


def exact_dedup(
    docs: DataFrame, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of docs (and of history): doc_id, keep_id, group_size,
    kept, text_sha256.

    history: documents that were indexed before; without it, the half of docs
    whose hashed id is even takes that part.
    """
    new = digest_rows(docs, id_col, text_col)
    if history is None:
        rows = new.withColumn("old", _in_old_half())
    else:
        rows = digest_rows(history, id_col, text_col).withColumn("old", F.lit(True)).unionByName(
            new.withColumn("old", F.lit(False))
        )
    return _grouped(rows.withColumn("uid", F.monotonically_increasing_id())).drop("uid")


def _in_old_half() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0


def _grouped(rows: DataFrame) -> DataFrame:
    """The result for rows (doc_id, length, digest, old, uid), with uid."""
    rows = materialise(rows, "digests")
    shards = shard_count(rows.count(), DIGESTS_PER_SHARD)
    index = materialise(build_index(group_winners(rows.filter("old")), shards), "mph-index")
    groups = look_up(group_winners(rows.filter("not old")), index, shards)
    # one row per digest on the right: AQE splits the partition of a hot digest on the left
    return rows.join(groups, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("uid") == F.col("keep_uid"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "uid",
    )


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one of each group, with all their columns."""
    own = with_row_id(docs)
    rows = digest_rows(own, id_col, text_col, own["_uid"]).withColumn("old", _in_old_half())
    kept = _grouped(rows).filter("kept").select(F.col("doc_id").alias("__id"), F.col("uid").alias("__uid"))
    same = own[id_col].cast("long").eqNullSafe(kept["__id"]) & (own["_uid"] == kept["__uid"])
    return own.join(kept, same, "left_semi").select([own[c] for c in docs.columns])
