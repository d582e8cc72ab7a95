import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.helpers import as_sf, docs, odd_rows, prose
from textloom.llm import simhash

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))
    found = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in found]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    """(doc_id, fingerprint, component) of each row, by comparing every two fingerprints."""
    prints = [brute_print(r[1]) for r in rows]
    distinct = sorted(set(prints))
    root = {x: x for x in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(distinct):
        for y in distinct[i + 1 :]:
            if (x ^ y).bit_count() <= 4:
                root[find(y)] = find(x)
    least = {}
    for r, x in zip(rows, prints):
        if r[0] is not None:
            least[find(x)] = min(least.get(find(x), r[0]), r[0])
    return Counter((r[0], f"{x:016x}", least.get(find(x))) for r, x in zip(rows, prints))


def crowd(seed=5):
    """Random texts, chains of texts that differ in a word each, copies, and the odd rows."""
    r, rows = random.Random(seed), []
    for k in range(60):
        words = prose(r.choice([3, 40, 150, 400]), k).split()
        for _ in range(r.choice([1, 2, 6])):
            rows.append((" ".join(words), "en", "s", 1))
            words[r.randrange(len(words))] = f"new{r.randrange(99)}"
    rows += [rows[7]] * 40
    r.shuffle(rows)
    return [(100 + k, *row) for k, row in enumerate(rows)] + odd_rows()


def result(found):
    return Counter((r.doc_id, r.fingerprint, r.component_id) for r in found.collect())


@pytest.mark.parametrize("blocks, groups", [(1, None), (2, 7)])
def test_against_brute_force(spark, blocks, groups):
    rows = crowd()
    found = simhash.near_duplicates(docs(spark, rows).repartition(3), blocks=blocks, groups=groups)
    expected = brute(rows)
    assert result(found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")) == expected
    assert len({c for _, _, c in expected}) < len({f for _, f, _ in expected})  # some links are between different fingerprints


def test_query_over_the_whole_table(spark, tmp_path):
    found = simhash.op13_simhash(spark, as_sf(docs(spark, crowd(9)), tmp_path))
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    assert result(found) == brute(crowd(9))


@pytest.mark.parametrize("blocks", [1, 2])
def test_every_near_pair_meets_at_the_home_of_either(blocks):
    r = np.random.default_rng(3)
    x = r.integers(0, 1 << 64, 1500, np.uint64)
    y = x.copy()
    for k in range(4):
        y ^= np.uint64(1) << r.integers(0, 64, len(x)).astype(np.uint64)
    for a, b in ((x, y), (y, x)):
        _, at, numbers = simhash.anchored(a, blocks)
        home, _, _ = simhash.anchored(b, blocks)
        assert set(enumerate(home.tolist())) <= set(zip(at.tolist(), numbers.tolist()))


def test_the_code_is_perfect():
    _, _, patterns, weights = simhash.golay()
    assert ((weights <= 3).sum(axis=1) == 1).all() and (weights[:, 0] <= 3).all()
    assert len(set(patterns[:, 0].tolist())) == 2048


def test_large_group_of_near_copies(spark, monkeypatch):
    """4000 fingerprints within four bits of one centre, split into parts and blocks; links stay near the members."""
    monkeypatch.setattr(simhash, "BATCH", 500)
    r = random.Random(1)
    prints = {sum({1 << r.randrange(64) for _ in range(2)}) for _ in range(4000)} | {(1 << 63) + 7}
    rows = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in prints], "fp long").repartition(3)
    edges = simhash.near_links(rows, groups=3)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    found = edges.collect()
    for e in found:
        assert ((e.u ^ e.v) & (1 << 64) - 1).bit_count() <= 8  # a forest's edge may join the ends of a path of links
        root[find(e.u)] = find(e.v)
    assert len({find(x - (1 << 64) if x >> 63 else x) for x in prints}) == 1
    assert len(found) < 200 * len(prints)


def test_empty_and_clashing(spark):
    assert simhash.near_duplicates(docs(spark, [])).collect() == []
    more = docs(spark).withColumns({"fp": F.lit(1), "at": F.lit(2), "a.b": F.lit(3), "component_id": F.lit(None).cast("long")})
    found = simhash.near_duplicates(more).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
    assert result(found) == brute(odd_rows())


def test_very_long_text():
    text = prose(60_000, 4)
    hashes = simhash.shingle_hashes(text)
    assert simhash.majority(simhash.counted(hashes)[None, :], np.array([len(hashes)]))[0] == brute_print(text)
