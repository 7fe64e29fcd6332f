"""Draws by hash: many at a time, in many tasks, and the same ones."""

import hashlib
import random
from itertools import chain

import numpy as np

from kinetrail.functions.hashes import md5_numbers
from kinetrail.operators import clips


def number(text: bytes) -> int:
    return int(hashlib.md5(text).hexdigest()[:12], 16)


def test_numbers_are_those_of_md5():
    heads = [b"", b"a|", "é|".encode(), *(f"{i}_{40 * i}|".encode() for i in range(0, 3000, 7)), *(b"x" * n for n in (50, 53, 54, 55, 56, 61, 64, 130))]
    tails = [f"{rep}|0".encode() for rep in (1, 9, 10, 99, 100, 2000)]
    got = np.zeros((len(heads), len(tails)), "u8")
    for rows, columns, numbers in md5_numbers(heads, tails):
        got[np.ix_(rows, columns)] = numbers
    assert got.tolist() == [[number(h + t) for t in tails] for h in heads]


def test_draws_are_spread_over_tasks(spark, monkeypatch):
    """The clips are one small partition; their draws are not one task."""
    monkeypatch.setattr(clips, "DRAWING", 16)
    tasks, drawn = spark.sparkContext.accumulator(0), clips._drawn

    def watched(*args):
        count = drawn(*args)

        def own(frames):
            first = next(frames, None)
            if first is not None:
                tasks.add(1)
                yield from count(chain([first], frames))

        return own

    monkeypatch.setattr(clips, "_drawn", watched)
    rng = random.Random(4)
    rows = [(f"{i}_{40 * i}", rng.choice("ab"), rng.random() < 0.5, rng.random() < 0.5) for i in range(200)]
    df = spark.createDataFrame(rows, "clip_id string, stratum string, notable boolean, surfaced boolean").coalesce(1)
    shares = {"a": 0.7, "b": 0.3}
    got = clips.bootstrap_escape(df, spark.createDataFrame(list(shares.items()), "stratum string, weight double"), reps=120).first()
    values = []
    for rep in range(1, 121):
        t = e = 0
        for stratum, weight in shares.items():
            own = [r for r in rows if r[1] == stratum]
            notable, missed = sum(r[2] for r in own), sum(r[2] and not r[3] for r in own)
            places = [number(f"{r[0]}|{rep}|0".encode()) % len(own) for r in own]
            t += weight * sum(p < notable for p in places) / len(own)
            e += weight * sum(p < missed for p in places) / len(own)
        values.append(e / t)
    assert np.allclose([got.p5, got.p95], np.quantile(values, [0.05, 0.95]))
    assert tasks.value == 13
