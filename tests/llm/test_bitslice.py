import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import as_sf
from textloom.llm import bitslice

SCHEMA = "vec_id long, embedding array<float>, label int, row string, score int"


def brute(rows, k=5):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, a) in enumerate(ok):
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for m, (i, b) in enumerate(ok) if m != n)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def vectors(n, dims, seed):
    r = random.Random(seed)
    rows = [(k, [r.gauss(0, 0.3) for _ in range(dims)], 0, "x", 1) for k in range(n)]
    same = rows[3][1]
    rows += [(n + k, same, 0, "x", 1) for k in range(300)]
    return rows


def test_against_brute_force(spark, tmp_path):
    rows = [*vectors(700, 9, 1), (5000, None, 0, "x", 1), (5050, [1.0, None], 0, "x", 1), (5100, [float("nan")], 0, "x", 1), (5150, [float("inf"), 1.0], 0, "x", 1), (5200, [], 0, "x", 1), (5250, [0.5, -900.0], 0, "x", 1), (5251, [0.1] * 12, 0, "x", 1), (None, [1.0], 0, "x", 1)]
    sf = as_sf(spark.createDataFrame(rows, SCHEMA).repartition(3), tmp_path, "embeddings")
    assert sorted(tuple(r) for r in bitslice.op7_bit_sliced(spark, sf).collect()) == brute(rows)
    small = bitslice.top_k(spark.read.parquet(f"{sf}/embeddings.parquet"), F.col("vec_id") % 50 == 0, block=100, group=7)
    assert sorted(tuple(r) for r in small.collect()) == brute(rows)


def test_fewer_rows_than_k_repeats_and_empty(spark):
    rows = [(0, [1.0, 2.0], 0, "x", 1), (0, [1.0, 2.0], 0, "x", 1), (7, [-1.0, 0.0], 0, "x", 1)]
    ask = F.col("vec_id") % 50 == 0
    assert sorted(tuple(r) for r in bitslice.top_k(spark.createDataFrame(rows, SCHEMA), ask).collect()) == brute(rows)
    assert bitslice.top_k(spark.createDataFrame(rows[:1], SCHEMA), ask).count() == 0
    assert bitslice.top_k(spark.createDataFrame([], SCHEMA), ask).count() == 0


@pytest.mark.parametrize("bits", [1, 9, 40])
def test_index_adds_slices_exactly(bits):
    r = np.random.default_rng(bits)
    values = r.integers(-(1 << bits), 1 << bits, (130, 5))
    query = r.integers(-300, 300, 5)
    index = bitslice.Index(values)
    total = sum(np.unpackbits(s.view(np.uint8), bitorder="little")[:130].astype(object) * (1 << w) for w, s in enumerate(index.scores(query)))
    want = (values.astype(object) * query.astype(object)).sum(axis=1)
    assert len({*(total - want)}) == 1
