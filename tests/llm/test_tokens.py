import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinetrail.llm import common, packing, token_output, tokens
from kinetrail.llm.common import scratch_path, table

from . import helpers as H


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")


def test_ids_are_the_tokenizers(spark, reference):
    texts = [r["text"] for r in table(spark, H.SF, "documents").limit(120).collect()] + H.edge_texts()
    for text in texts:
        assert (tokens.encode(text or "") == reference(text)).all()


def check(rows, want):
    """Every id of every document lies in exactly one piece; no gaps."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(want)
    for doc, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(want[doc])
            assert r["ids_crc32"] == zlib.crc32(want[doc][at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(want[doc])
    sizes = []
    for seq in sorted(by_seq):
        at = 0
        for r in sorted(by_seq[seq], key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        sizes.append(at)
    assert sorted(by_seq) == list(range(len(sizes)))
    assert all(s == 1024 for s in sizes[:-1]) and sizes[-1] <= 1024


def test_packing(spark, reference):
    docs = table(spark, H.SF, "documents")
    want = {r["doc_id"]: reference(r["text"]) for r in docs.collect()}
    check(packing.pack(docs).collect(), want)


def test_packing_edges(spark, reference):
    texts = H.edge_texts()
    check(packing.pack(H.documents(spark, texts).repartition(3)).collect(), {i: reference(t) for i, t in enumerate(texts)})
    assert packing.pack(H.documents(spark, ["x"]).limit(0)).count() == 0


def test_sequences_and_padding(spark):
    table_ = tokens.token_table(table(spark, H.SF, "documents").repartition(5))
    pieces = packing.pieces(table_, with_ids=True).collect()
    by_seq = {}
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        by_seq[r["sequence_id"]] = by_seq.get(r["sequence_id"], b"") + bytes(r["ids"])
    got = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(table_).collect()}
    assert got == by_seq
    assert packing.padded_length(512) == 512 and packing.padded_length(513) == 1024 and packing.padded_length(1) == 1


def test_cleanup_removes_what_was_written(spark, tmp_path, monkeypatch):
    run = tmp_path / "run"
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{run}")
    tokens.token_table(table(spark, H.SF, "documents").limit(3))
    assert any(run.iterdir())
    common.cleanup(spark)
    assert not run.exists()


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation(n):
    slots = token_output.permute(np.arange(n), n)
    assert sorted(slots) == list(range(n))
    assert (token_output.permute(slots, n, inverse=True) == np.arange(n)).all()
    if n > 100:
        assert (slots != token_output.permute(np.arange(n), n, key=1)).any()


def test_added_token(reference):
    for text in ("<|endoftext|>", "a <|endoftext|> b", "  <|endoftext|>\n", "<|endoftext|><|endoftext|>", "x<|endoftext|", "Ü\xa0<|endoftext|>é"):
        assert list(tokens.encode(text)) == list(reference(text))
    assert list(tokens.encode("<|endoftext|>")) == [50256, 0]


def test_shards_round_trip(spark):
    ids = [np.arange(i, i + 8).astype("<u2").tobytes() for i in range(249)] + [b"\x07\x00"]
    rows = []
    for i, x in enumerate(ids):  # every fifth sequence comes in two or three stretches
        cuts = [0, 2, 6, len(x)] if i % 5 == 0 and len(x) == 16 else [0, 8, 16] if i % 7 == 0 and len(x) == 16 else [0, len(x)]
        rows += [(i, a // 2, x[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    stretches = spark.createDataFrame(rows, "sequence_id long, at long, ids binary").selectExpr("*", "1 as shard").repartition(4)
    path = scratch_path(spark, "test-shards")
    assert token_output.write_shards(stretches, path, len(ids), length=8, per_shard=32) == 32
    read = lambda **more: token_output.read_shards(spark, path, len(ids), length=8, per_shard=32, **more).collect()
    got = read()
    assert {r["sequence_id"]: bytes(r["ids"]) for r in got} == dict(enumerate(ids)) and len(got) == len(ids)
    assert all(r["n_tokens"] * 2 == len(r["ids"]) for r in got)
    step = token_output.stride(8)
    assert all(r["byte_offset"] == r["slot"] % 32 * step and r["shard"] == r["slot"] // 32 for r in got)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).collect()
    assert len(files) == 8 and sum(f["length"] for f in files) == 250 * step
    # a reader that stopped goes on at any slot
    for slot in (0, 31, 32, 77, 249, 250):
        assert {r["slot"] for r in read(from_slot=slot)} == set(range(slot, 250))


def test_several_shards_in_a_range(spark, monkeypatch):
    monkeypatch.setattr(token_output, "MOST_RANGES", 3)
    ids = [np.full(4, i, dtype="<u2").tobytes() for i in range(100)]
    path = scratch_path(spark, "test-ranges")
    token_output.write_shards(spark.createDataFrame([(i, 0, x) for i, x in enumerate(ids)], "sequence_id long, at long, ids binary"), path, 100, length=4, per_shard=7)
    got = token_output.read_shards(spark, path, 100, length=4, per_shard=7).collect()
    assert {r["sequence_id"]: bytes(r["ids"]) for r in got} == dict(enumerate(ids)) and len(got) == 100


def test_training_order_is_the_corpus_end_to_end(spark, reference):
    """Every slot holds what plain concatenation and cutting gives."""
    docs = table(spark, H.SF, "documents")
    edges = H.documents(spark, H.edge_texts() + ["same", "same"], extra=False).withColumn("slot", F.lit("x")).withColumn("n_tokens", F.lit(1))
    for df, parts in ((docs, 3), (edges, 4)):
        df = df.repartition(parts).persist()
        order = [r["text"] for r in tokens.token_table(df).join(df, "doc_id").select("part", "local_start", "text").orderBy("part", "local_start").collect()]
        assert len(order) == df.count()
        flat = np.concatenate([reference(t) for t in order])
        got = token_output.training_order(df).collect()
        n = -(-len(flat) // 1024)
        assert sorted(r["slot"] for r in got) == list(range(n)) == sorted(r["sequence_id"] for r in got)
        for r in got:
            part = flat[r["sequence_id"] * 1024 : (r["sequence_id"] + 1) * 1024]
            assert (r["n_tokens"], r["ids_crc32"]) == (len(part), zlib.crc32(part.tobytes()))
            assert r["slot"] == token_output.permute(np.array([r["sequence_id"]]), n)[0]
        df.unpersist()
    assert token_output.training_order(docs.limit(0)).count() == 0
