import random
import re

import pytest

from pyspark.sql import functions as F

from tests.llm.helpers import as_sf, docs, odd_rows, prose
from textloom.llm import components, minhash


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """Every pair compared; the least id reachable."""
    sets = [(r[0], shingles(r[1])) for r in rows]
    root = {id_: id_ for id_, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[k + 1 :]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return sorted((a, len(x), find(a), find(a) == a) for a, x in sets)


def edited(text, n, seed):
    r, words = random.Random(seed), text.split()
    for _ in range(n):
        words[r.randrange(len(words))] = f"e{r.random()}"
    return " ".join(words)


def corpus():
    rows, k = [(r[0] + 1000, *r[1:]) for r in odd_rows() if r[0] is not None], 0
    for group in range(12):
        base = prose(150 + 40 * group, 100 + group)
        for copy in range(group + 2):
            k += 1
            rows.append((k * 3, edited(base, copy * (group % 4), k), "en", "a", 1))
    chain = prose(200, 7)
    for step in range(8):
        k += 1
        rows.append((k * 3, chain, "en", "a", 1))
        chain = edited(chain, 4, step)
    rows += [(5000 + j, t, "en", "a", 1) for j, t in enumerate(["a b c", "A  B\tC", "a b", "a b c d e", "a b c d E", "É é", "é é"])]
    return rows


def test_against_brute_force(spark, tmp_path):
    rows = corpus()
    got = minhash.op3_minhash(spark, as_sf(docs(spark, rows).repartition(3), tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == brute({r[:2]: r for r in rows}.values()) or sorted({tuple(r) for r in got}) == sorted(set(brute(list({r[0]: r for r in rows}.values()))))


def test_members_that_miss_the_pivot_are_still_linked(spark, monkeypatch):
    """A large group whose least member is far from many others, with small blocks and parts of pivots."""
    monkeypatch.setattr(minhash, "MINORS", 3)
    monkeypatch.setattr(minhash, "STREAM", 8)
    monkeypatch.setattr(minhash, "MEMBERS", 4)
    base = prose(300, 3)
    rows = [(k, edited(base, 9 if k else 17, k), "en", "a", 1) for k in range(40)]
    got = minhash.near_duplicates(docs(spark, rows)).drop("ref").collect()
    assert sorted(tuple(r) for r in got) == brute(rows)


def test_rows_without_id_and_empty_tables(spark):
    rows = [(None, prose(40, 1), "en", "a", 1), (None, prose(40, 1), "en", "a", 1), (7, prose(40, 1), "en", "a", 1), (None, prose(40, 2), "en", "a", 1), (None, "", "en", "a", 1)]
    got = [tuple(r) for r in minhash.near_duplicates(docs(spark, rows)).drop("ref").collect()]
    assert sorted(got, key=repr) == sorted([(None, 36, 7, False), (None, 36, 7, False), (7, 36, 7, True), (None, 36, None, True), (None, 0, None, True)], key=repr)
    assert minhash.near_duplicates(docs(spark, [])).count() == 0


@pytest.mark.parametrize("edges", [[(1, 2), (2, 3), (9, 8), (3, 1)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 50)], [(5, 5)], []])
def test_components(spark, edges):
    want = {}
    for a, b in edges:
        group = want.get(a, {a}) | want.get(b, {b})
        for x in group:
            want[x] = group
    got = {r.u: r.v for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: min(g) for x, g in want.items() if x != min(g)}


def test_deduplicated_rows_keep_their_columns(spark):
    rows = [*odd_rows(), (50, prose(200, 9), "en", "a", 1), (51, prose(200, 9), "en", "b", 1)]
    frame = docs(spark, rows)
    left = minhash.deduplicated(frame)
    assert left.columns == frame.columns
    want = {r[0] for r in brute([r for r in rows if r[0] is not None]) if r[3]} | {None}
    assert sorted(map(repr, (r.doc_id for r in left.collect()))) == sorted(map(repr, want))


def test_deduplicated_keeps_clashing_columns(spark):
    frame = docs(spark).withColumns({c: F.lit("mine") for c in ("tl_ref", "REF", "ident", "tl_kept", "tl_id")})
    out = minhash.deduplicated(frame)
    assert out.columns == frame.columns and all(r["tl_ref"] == r["REF"] == "mine" for r in out.collect())
    assert out.count() == minhash.deduplicated(docs(spark)).count()


def test_links_near_the_threshold_are_found(spark):
    """Pairs of 0.75 to 0.80: links found against those of brute force."""
    r, rows = random.Random(11), []
    for k in range(400):
        words = [f"v{r.randrange(5000)}" for _ in range(104)]
        other = list(words)
        for at in r.sample(range(20, 80), r.choice([2, 2, 3])):
            other[at] = "zz"
        rows += [(2 * k, " ".join(words), "en", "a", 1), (2 * k + 1, " ".join(other), "en", "a", 1)]
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(100)} for i, t, *_ in rows}
    want = {2 * k for k in range(400) if 100 * len(sets[2 * k] & sets[2 * k + 1]) >= 75 * len(sets[2 * k] | sets[2 * k + 1])}
    close = {k for k in want if 100 * len(sets[k] & sets[k + 1]) < 80 * len(sets[k] | sets[k + 1])}
    got = {x.component_id for x in minhash.near_duplicates(docs(spark, rows)).collect() if x.doc_id != x.component_id}
    assert len(close) > 20 and got == want
