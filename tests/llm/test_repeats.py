import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import as_sf, docs, odd_rows, prose
from textloom.llm import repeats
from textloom.llm.suffixes import permuted_common_prefixes, suffix_array


def brute(rows):
    """Every 100-byte string in order of doc_id and start; rows that repeat an id and text are one document."""
    seen, gone = set(), {}
    unique = sorted({(r[0], (r[1] or "").encode()) for r in rows if r[0] is not None})
    for ident, raw in unique:
        mask = gone[ident, raw] = bytearray(len(raw))
        for k in range(len(raw) - 99):
            s = raw[k : k + 100]
            if s in seen:
                mask[k : k + 100] = b"\1" * 100
            seen.add(s)
    out = []
    for r in rows:
        if r[0] is not None:
            raw = (r[1] or "").encode()
            mask = gone[r[0], raw]
            runs = sum(1 for k, m in enumerate(mask) if m and (not k or not mask[k - 1]))
            out.append((r[0], len(raw), sum(mask), runs, hashlib.sha256(bytes(b for b, m in zip(raw, mask) if not m)).hexdigest()))
    return sorted(out)


def corpus():
    r = random.Random(4)
    shared = [prose(60, 900 + k) for k in range(6)]
    rows = [x for x in odd_rows() if x[0] is not None]
    for k in range(60):
        parts = [prose(r.randint(1, 80), 2000 + k)]
        for _ in range(r.randint(0, 3)):
            s = r.choice(shared)
            a = r.randint(0, 100)
            parts.insert(r.randint(0, len(parts)), s[a : a + r.choice([80, 99, 100, 101, 150, 400])])
        if k % 9 == 0:
            parts.append("ab" * 150 + parts[0] * 2 + "é" * 120)
        rows.append((100 + (k * 17) % 61, "".join(parts), "en", "a", 1))
    return rows


def test_against_brute_force(spark, tmp_path):
    rows = corpus()
    got = repeats.op6_repeats(spark, as_sf(docs(spark, rows).repartition(3), tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)


@pytest.mark.parametrize("group", [2, 3, 7])
def test_hot_anchors_go_through_further_rounds(spark, monkeypatch, group):
    rows = corpus()
    monkeypatch.setattr(repeats, "GROUP", group)
    out = repeats.without_repeats(docs(spark, rows).repartition(2)).collect()
    assert {(r.doc_id, r.n_bytes, hashlib.sha256(r.kept).hexdigest()) for r in out} == {(r[0], r[1], r[4]) for r in brute(rows)}


@pytest.mark.parametrize("batch", [700, 1 << 16])
def test_segments_hold_every_string(monkeypatch, batch):
    monkeypatch.setattr(repeats, "BATCH", batch)
    texts = [(False, r[0], 7, r[1] or "") for r in corpus()]
    table = pa.RecordBatch.from_arrays([pa.array([t[k] for t in texts], kind) for k, kind in enumerate((pa.bool_(), pa.int64(), pa.int64(), pa.string()))], [*repeats.ROW, "text"])
    found = [x for b in repeats.scanned(iter([table])) for x in b.to_pylist()]
    starts = {}
    for x in found:
        starts.setdefault(x["d"], []).extend(range(x["start"], x["stop"] - 99))
        assert 100 <= x["stop"] - x["start"] <= 176
    for _, d, _, text in texts:
        assert set(starts.get(d, [])) == set(range(len(text.encode()) - 99))


def test_shards_remove_what_their_suffix_array_finds(monkeypatch):
    """Copies and shifted strings alike; without the common prefixes nothing but whole copies of a content goes."""
    text = prose(60, 5).encode()
    rows = [(7, 0, True, False, d, 1, s, text[s:e]) for d, s, e in ((1, 0, 150), (2, 0, 150), (3, 20, 170), (4, 200, 330))]
    columns = [pa.array([r[k] for r in rows], repeats.KINDS[n.split()[0]]) for k, n in enumerate(repeats.SHIPPED.split(", "))]
    batch = pa.RecordBatch.from_arrays(columns, [n.split()[0] for n in repeats.SHIPPED.split(", ")])
    out = [x for b in repeats.sorted_shards(iter([batch])) for x in b.to_pylist()]
    assert {(x["d"], x["start"], x["stop"]) for x in out if x["bytes"] is None} == {(2, 0, 150), (3, 20, 150)}
    assert {(x["d"], x["start"], x["bytes"]) for x in out if x["bytes"]} == {(1, 0, text[:150]), (3, 20, text[20:170]), (4, 200, text[200:330])}


def test_rows_are_told_apart_by_more_than_their_id(spark):
    many = [(None, prose(30, 5000 + k), "en", "a", 1) for k in range(300)] + [(5, prose(30, 6000 + k), "en", "a", 1) for k in range(300)]
    assert all(len(r.spans) == 0 for r in repeats.without_repeats(docs(spark, many)).collect())
    twice = [(None, prose(30, 1) + " " + prose(30, 2), "en", "a", 1), (None, prose(30, 3) + " " + prose(30, 2), "en", "a", 1)]
    assert sorted(len(r.spans) for r in repeats.without_repeats(docs(spark, twice)).collect()) == [0, 1]


def test_a_text_over_a_batch(spark, tmp_path):
    part, long = prose(200, 71), prose(400_000, 70)
    rows = [(1, long[: (1 << 20) - 300] + part + long[1 << 20 :], "en", "a", 1), (2, "x " + part, "en", "a", 1), (3, long[(1 << 20) + 5000 : (1 << 20) + 5400], "en", "a", 1)]
    got = {r.doc_id: r.n_removed for r in repeats.op6_repeats(spark, as_sf(docs(spark, rows), tmp_path)).collect()}
    assert got == {r[0]: r[2] for r in brute(rows)}


def test_rows_without_id_come_last_and_empty(spark):
    text = prose(50, 1)
    got = {(r.doc_id, len(r.kept)) for r in repeats.without_repeats(docs(spark, [(None, text, "en", "a", 1), (9, text, "en", "a", 1), (9, text, "en", "a", 1)])).collect()}
    assert got == {(None, 0), (9, len(text))}
    assert repeats.without_repeats(docs(spark, [])).count() == 0


def test_suffix_arrays_and_prefixes():
    r = np.random.default_rng(1)
    for t in range(1500):
        n, letters = int(r.integers(0, 60 if t % 10 else 900)), int(r.integers(1, 8))
        x = r.integers(0, letters, n)
        if t % 7 == 0:
            x = np.tile(x[:9], 1 + n // 9)
        a = suffix_array(x, letters)
        assert a.tolist() == sorted(range(len(x)), key=lambda i: x[i:].tolist())
        p = permuted_common_prefixes(x, a, 50)
        for i, j in list(zip(a[1:], a[:-1]))[:40]:
            k = 0
            while max(i, j) + k < len(x) and x[i + k] == x[j + k]:
                k += 1
            assert p[i] == min(k, 50)
