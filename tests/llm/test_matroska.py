import hashlib
import struct
import zlib

import pytest

from tests.llm.helpers import as_sf, docs, odd_rows
from textloom.llm import matroska as mk


def test_round_trip_and_digest(spark, tmp_path):
    got = mk.op4_matroska(spark, as_sf(docs(spark), tmp_path)).collect()
    want = []
    for ident, text, *_ in odd_rows():
        raw = (text or "").encode()
        data = raw + b" " * (-len(raw) % 192 if raw else 192)
        want.append((ident, len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:])))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:5]) for r in got)
    by_text = {}
    for r in got:
        assert by_text.setdefault(r.payload_sha256, tuple(r)[5:]) == tuple(r)[5:]


@pytest.mark.parametrize("how", [mk.NO_LACE, mk.XIPH, mk.FIXED, mk.EBML_LACE])
def test_lacing(how):
    frames = [b"a" * 300] if how == mk.NO_LACE else [b"a" * 40, b"b" * 40, b"c" * 40] if how == mk.FIXED else [b"a" * 300, b"", b"c" * 255, b"d" * 9]
    body = mk.laced(frames, how)
    sizes, at = mk.lace_sizes(body, 0, len(body), how)
    assert sizes == [len(f) for f in frames] and body[at:] == b"".join(frames)


def test_unknown_sizes_block_groups_void_and_cues():
    group = mk.element(mk.BLOCK_GROUP, mk.element(mk.BLOCK, mk.vint(1) + struct.pack(">hB", 5, 0) + b"xyz") + mk.element(mk.REFERENCE_BLOCK, b"\xff"))
    head = lambda ident: ident.to_bytes((ident.bit_length() + 7) // 8, "big") + b"\x01" + b"\xff" * 7
    data = mk.HEADER + head(mk.SEGMENT) + mk.TRACK + head(mk.CLUSTER) + mk.number(mk.TIMESTAMP, 100) + mk.element(mk.VOID, b"\0" * 9) + group + mk.element(mk.CLUSTER, mk.number(mk.TIMESTAMP, 200) + mk.element(mk.SIMPLE_BLOCK, mk.vint(1) + struct.pack(">hB", -7, 0x80) + b"pq"))
    found = mk.demux(data)
    assert not found.error
    assert [(p[1] // 1_000_000, p[2], data[p[3] : p[3] + p[4]]) for p in found.packets] == [(105, False, b"xyz"), (193, True, b"pq")]
    made = mk.mux(bytes(range(256)) * 150)
    read = mk.demux(made)
    assert [c[2] for c in read.cues] == read.clusters and len(read.clusters) > 1
    assert [p[1] for p in read.packets] == [k * 24_000_000 for k in range(len(read.packets))]


def test_damage_is_reported_not_raised(spark):
    good = mk.mux(b"z" * 1920)
    for cut in range(0, len(good), 7):
        mk.demux(good[:cut])
    media = spark.createDataFrame([(1, good), (2, None), (3, b""), (4, b"RIFF...."), (5, good[:-300])], "doc_id long, media binary")
    rows = mk.packet_table(media).collect()
    assert {r.doc_id for r in rows if r.error} == {2, 3, 4, 5}
    assert sum(r.doc_id == 1 for r in rows) == 10
    assert mk.packet_table(media.limit(0)).count() == 0


def test_damage_is_an_error_text_and_never_an_exception(spark):
    el = lambda ident, body: ident.to_bytes((ident.bit_length() + 7) // 8, "big") + mk.vint(len(body)) + body
    head = el(mk.EBML, el(mk.DOC_TYPE, b"matroska"))
    nested = b""
    for _ in range(3000):
        nested = el(mk.CLUSTER, nested)
    cases = [
        head + el(mk.SEGMENT, el(mk.AUDIO, el(mk.SAMPLING_FREQUENCY, b"\x45\xfa\x00\x00"))),
        head + el(mk.SEGMENT, el(mk.INFO, el(mk.DURATION, b"\x7f\x80\x00\x00"))),
        head + el(mk.SEGMENT, nested),
        head + el(mk.SEGMENT, el(mk.CLUSTER, el(mk.TIMESTAMP, b"\xff" * 8) + el(mk.SIMPLE_BLOCK, b"\x81\x00\x00\x80x"))),
        head + el(mk.SEGMENT, el(mk.CLUSTER, el(mk.SIMPLE_BLOCK, b"\x08" + b"\xff" * 4 + b"\x00\x00\x80x"))),
        head + el(mk.SEGMENT, el(mk.CUE_TIME, b"\x01") + el(mk.BLOCK_GROUP, el(mk.REFERENCE_BLOCK, b"\x01"))),
    ]
    whole = mk.mux(b"abc" * 64, 192)
    cases += [whole[:k] for k in range(0, len(whole), 7)] + [whole[:k] + b"\xff" * 9 + whole[k + 9 :] for k in range(0, len(whole), 11)]
    frame = spark.createDataFrame([(k, bytearray(c)) for k, c in enumerate(cases)], "doc_id long, media binary")
    found = mk.packet_table(frame).collect()
    assert {r.doc_id for r in found if r.error} >= {1, 2, 3, 4}
