"""Token ids of documents, written once so that later passes can't disagree.

The ids are those of the byte-level BPE in `byte_bpe_50k.json`; the same
vocabulary as ranks gives the same ids about four times as fast, which the tests
hold against the `tokenizers` library. The string of the vocabulary's added
token in a text is that token. A document's ids end with SEPARATOR.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, bounded_batches, text_of

SEPARATOR = 0
#: A vocabulary file of the public_tokenizers package, or a path to one.
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the added token of byte_bpe_50k.json, which its ranks leave free.
ADDED = {"<|endoftext|>": 50256}
TOKEN_SCHEMA = "doc_id long, part int, local_start long, n_tokens long, ids binary"


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    """The encoder, loaded once per Python worker."""
    import base64
    import os

    import public_tokenizers
    import tiktoken

    path = vocabulary if os.path.exists(vocabulary) else public_tokenizers.path(vocabulary)
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    added = {word: i for word, i in ADDED.items() if i not in ranks.values()}
    return tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def encode(text: str, vocabulary: str = VOCABULARY) -> np.ndarray:
    """Ids of a whole text with the separator, as little-endian unsigned 16 bits
    (32 where the vocabulary is larger)."""
    enc = encoder(vocabulary)
    kind = "<u2" if enc.n_vocab <= 65_536 else "<u4"
    # the plain call is a third faster
    ids = enc.encode(text, allowed_special="all") if any(w in text for w in enc.special_tokens_set) else enc.encode_ordinary(text)
    return np.array([*ids, SEPARATOR], dtype=kind)


def id_type(vocabulary: str = VOCABULARY) -> np.dtype:
    return np.dtype("<u2" if encoder(vocabulary).n_vocab <= 65_536 else "<u4")


def token_rows(
    docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, part, local_start, n_tokens, ids): part is the task that made
    the row, local_start the tokens before it in that task. Not stable until it
    is written; see token_table()."""

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in range(0, batch.num_rows, 512):  # bounds what one output batch holds
                rows = batch.slice(piece, 512)
                ids = [encode(text.as_py(), vocabulary) for text in rows.column(1)]
                sizes = np.array([len(x) for x in ids], dtype=np.int64)
                starts = start + np.cumsum(sizes) - sizes
                start += int(sizes.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0),
                        pa.array(np.full(len(ids), part, dtype=np.int32)),
                        pa.array(starts),
                        pa.array(sizes),
                        pa.array([x.tobytes() for x in ids], type=pa.binary()),
                    ],
                    names=["doc_id", "part", "local_start", "n_tokens", "ids"],
                )

    slim = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    return slim.mapInArrow(tokenise, TOKEN_SCHEMA)


def token_table(docs: DataFrame, vocabulary: str = VOCABULARY, **columns: str) -> DataFrame:
    """token_rows() as a written table: from here on parts and starts are fixed,
    also when a task runs again."""
    options = {"compression": "zstd", "parquet.compression.codec.zstd.level": "5"}
    with bounded_batches(docs.sparkSession):
        return materialise(token_rows(docs, vocabulary, **columns), "tokens", **options)


def with_global_starts(tokens: DataFrame) -> DataFrame:
    """Adds global_start: the tokens before the document in the whole corpus.

    Two-pass prefix sums: totals per part, then a running sum over the parts.
    There is one row per task of the tokenising stage, so that the window and
    the join's right side hold some MB for a million tasks; up to that number
    they are broadcast, beyond it joined by part.
    """
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    parts = totals.count()
    bases = totals.selectExpr(
        "part", "coalesce(sum(total) over (order by part rows between unbounded preceding and 1 preceding), 0) as base"
    )
    bases = F.broadcast(bases) if parts <= 1_000_000 else bases
    return tokens.join(bases, "part").withColumn("global_start", F.col("base") + F.col("local_start")).drop("base")
