"""Matroska: EBML elements, clusters, lacing and cues into packet tables.

``mux`` stores bytes as 8-bit PCM frames in a Matroska file; ``demux`` reads any Matroska file into tracks,
packets (timestamp, track, byte range) and cues. The bytes of a packet are ``data[offset:offset + size]``.

Defined results: a null text is empty; an empty text is one frame of spaces; null, empty, truncated or foreign
media give no packets and an ``error`` text, never an exception; repeated rows give repeated results; only the
named columns are read, so further columns cannot clash.
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import slices, table

# Element numbers of the Matroska container.
EBML, DOC_TYPE, SEGMENT, VOID, CRC32 = 0x1A45DFA3, 0x4282, 0x18538067, 0xEC, 0xBF
INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83
FLAG_LACING, DEFAULT_DURATION, CODEC_ID, AUDIO = 0x9C, 0x23E383, 0x86, 0xE1
SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK = 0x1F43B675, 0xE7, 0xA3
BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0xA0, 0xA1, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS = 0x1C53BB6B, 0xBB, 0xB3, 0xB7
CUE_TRACK, CUE_CLUSTER_POSITION = 0xF7, 0xF1
MASTERS = {SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS}
#: Elements that end a cluster (or segment child) of unknown size.
TOP = {CLUSTER, CUES, INFO, TRACKS, 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469}
NO_LACE, XIPH, FIXED, EBML_LACE = 0, 1, 2, 3

UNIT = 192
#: Levels of elements; a sound file has six.
DEEPEST = 64
RATE = 8000


def vint(value: int, width: int = 0) -> bytes:
    """An EBML number of the least width, or of ``width``."""
    width = width or next(w for w in range(1, 9) if value < (1 << 7 * w) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def read_vint(data: bytes, at: int, end: int, keep_marker: bool = False) -> tuple[int, int]:
    """(value, next position); a value of all ones (an unknown size) reads as -1."""
    if at >= end or not data[at]:
        raise ValueError(f"no EBML number at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise ValueError(f"EBML number cut off at byte {at}")
    raw = int.from_bytes(data[at : at + width], "big")
    if keep_marker:
        return raw, at + width
    value = raw - (1 << 7 * width)
    return (-1 if value == (1 << 7 * width) - 1 else value), at + width


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def laced(frames: list[bytes], how: int) -> bytes:
    """The lace header and the frames of one block."""
    if how == NO_LACE:
        return frames[0]
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if how == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif how == EBML_LACE:
        head += vint(sizes[0])
        for before, now in zip(sizes, sizes[1:-1]):
            step = now - before
            width = next(w for w in range(1, 9) if abs(step) < (1 << 7 * w - 1))
            head += vint(step + (1 << 7 * width - 1) - 1, width)
    elif len(set(sizes)) > 1:
        raise ValueError("fixed lacing needs frames of one size")
    return head + b"".join(frames)


HEADER = element(EBML, number(0x4286, 1) + number(0x42F7, 1) + number(0x42F2, 4) + number(0x42F3, 8) + element(DOC_TYPE, b"matroska") + number(0x4287, 4) + number(0x4285, 2))
TRACK = element(TRACKS, element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + number(FLAG_LACING, 1) + number(DEFAULT_DURATION, UNIT * 1_000_000_000 // RATE) + element(CODEC_ID, b"A_PCM/INT/LIT") + element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))))


def mux(payload: bytes, frame_bytes: int = UNIT, frames_a_block: int = 8, blocks_a_cluster: int = 16) -> bytes:
    """``payload`` as frames of 8-bit samples; the blocks use the three kinds of lacing in turn."""
    frames = [payload[i : i + frame_bytes] for i in range(0, len(payload), frame_bytes)]
    ms = frame_bytes * 1000 // RATE
    info = element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(frames) * ms)) + element(MUXING_APP, b"textloom") + element(WRITING_APP, b"textloom"))
    body, at, cues = [info, TRACK], len(info) + len(TRACK), []
    blocks = [frames[i : i + frames_a_block] for i in range(0, len(frames), frames_a_block)]
    for c in range(0, len(blocks), blocks_a_cluster):
        start = c * frames_a_block * ms
        parts = [number(TIMESTAMP, start)]
        for b in range(c, min(c + blocks_a_cluster, len(blocks))):
            some = blocks[b]
            how = NO_LACE if len(some) == 1 else FIXED if b % 3 == 0 and len({*map(len, some)}) == 1 else EBML_LACE if b % 3 == 1 else XIPH
            parts.append(element(SIMPLE_BLOCK, vint(1) + struct.pack(">hB", (b - c) * frames_a_block * ms, 0x80 | how << 1) + laced(some, how)))
        cluster = element(CLUSTER, b"".join(parts))
        cues.append(element(CUE_POINT, number(CUE_TIME, start) + element(CUE_TRACK_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER_POSITION, at))))
        body.append(cluster)
        at += len(cluster)
    return HEADER + element(SEGMENT, b"".join([*body, element(CUES, b"".join(cues))]))


@dataclass
class Media:
    """What a file holds. tracks: number to {type, codec, frame_ns, rate}; packets: (track, timestamp_ns, keyframe,
    offset, size, lacing, lace); cues: (timestamp_ns, track, cluster offset in the file)."""

    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple[int, int, bool, int, int, int, int]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    duration_ns: int = 0
    error: str = ""


def lace_sizes(data: bytes, at: int, end: int, how: int) -> tuple[list[int], int]:
    """The sizes of the frames of a block, and where the first frame starts."""
    if how == NO_LACE:
        return [end - at], at
    if at >= end:
        raise ValueError(f"lace cut off at byte {at}")
    n, at = data[at] + 1, at + 1
    if how == FIXED:
        if (end - at) % n:
            raise ValueError(f"uneven fixed lace at byte {at}")
        return [(end - at) // n] * n, at
    sizes: list[int] = []
    for k in range(n - 1):
        if how == XIPH:
            size = 0
            while True:
                if at >= end:
                    raise ValueError(f"lace cut off at byte {at}")
                size, at = size + data[at], at + 1
                if data[at - 1] != 255:
                    break
        else:
            raw, after = read_vint(data, at, end)
            size = raw if not k else sizes[-1] + raw - ((1 << 7 * (after - at) - 1) - 1)
            at = after
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError(f"lace sizes beyond the block at byte {at}")
    return sizes, at


def demux(data: bytes | None) -> Media:
    """Reads a whole file; on damage, what came before it and ``error``."""
    out = Media()
    state = {"scale": 1_000_000, "cluster": 0, "segment": 0}
    try:
        if not data:
            raise ValueError("no bytes")
        ident, at = read_vint(data, 0, len(data), True)
        if ident != EBML:
            raise ValueError("not an EBML file")
        size, at = read_vint(data, at, len(data))
        walk(data, at + max(0, size), len(data), out, state, 0, 0)
    except (ValueError, struct.error, IndexError) as e:
        out.error = str(e)
    return out


def unsigned(data: bytes, at: int, end: int) -> int:
    if end - at > 8:
        raise ValueError(f"whole number of {end - at} bytes at byte {at}")
    return int.from_bytes(data[at:end], "big")


def floating(data: bytes, at: int, end: int) -> float:
    value = struct.unpack(">d" if end - at == 8 else ">f", data[at:end])[0] if end > at else 0.0
    if not math.isfinite(value):
        raise ValueError(f"no finite number at byte {at}")
    return value


def walk(data: bytes, at: int, end: int, out: Media, state: dict, parent: int, depth: int) -> int:
    """Reads the elements in [at, end); returns where it stopped (before ``end`` only after an unknown size)."""
    if depth > DEEPEST:
        raise ValueError(f"elements nested too deep at byte {at}")
    while at < end:
        head = at
        ident, at = read_vint(data, at, end, True)
        if parent == CLUSTER and state.get("open") and ident in TOP:
            return head
        size, at = read_vint(data, at, end)
        stop = end if size < 0 else at + size
        if stop > end:
            raise ValueError(f"element {ident:X} at byte {head} goes beyond its parent")
        if ident in MASTERS:
            if ident == SEGMENT:
                state["segment"] = at
            elif ident == CLUSTER:
                out.clusters.append(head)
                state["open"], state["cluster"] = size < 0, 0
            elif ident == TRACK_ENTRY:
                state["track"] = {"number": 0, "type": 0, "codec": "", "frame_ns": 0, "rate": 8000}
            elif ident == CUE_POINT:
                state["cue"] = [0, 0, 0]
            elif ident == BLOCK_GROUP:
                state["group"], state["reference"] = None, False
            stop = walk(data, at, stop, out, state, ident, depth + 1)
            if ident == TRACK_ENTRY:
                track = state.pop("track", None)
                if track:
                    out.tracks[track["number"]] = track
            elif ident == CUE_POINT and "cue" in state:
                out.cues.append((state["cue"][0] * state["scale"], state["cue"][1], state["cue"][2] + state["segment"]))
            elif ident == BLOCK_GROUP and state.get("group"):
                packets(data, *state["group"], out, state, not state.get("reference"))
        elif ident == SIMPLE_BLOCK:
            packets(data, at, stop, out, state, None)
        elif ident == BLOCK:
            state["group"] = (at, stop)
        elif ident == REFERENCE_BLOCK:
            state["reference"] = True
        elif ident == TIMESTAMP:
            state["cluster"] = unsigned(data, at, stop)
        elif ident == TIMESTAMP_SCALE:
            state["scale"] = unsigned(data, at, stop)
        elif ident == DURATION:
            out.duration_ns = round(floating(data, at, stop) * state["scale"])
        elif parent in (TRACK_ENTRY, AUDIO) and "track" in state:
            track = state["track"]
            if ident == CODEC_ID:
                track["codec"] = data[at:stop].decode("ascii", "replace")
            elif ident == SAMPLING_FREQUENCY:
                track["rate"] = floating(data, at, stop)
            elif ident in (TRACK_NUMBER, TRACK_TYPE, DEFAULT_DURATION):
                track[{TRACK_NUMBER: "number", TRACK_TYPE: "type", DEFAULT_DURATION: "frame_ns"}[ident]] = unsigned(data, at, stop)
        elif ident in (CUE_TIME, CUE_TRACK, CUE_CLUSTER_POSITION) and "cue" in state:
            state["cue"][(CUE_TIME, CUE_TRACK, CUE_CLUSTER_POSITION).index(ident)] = unsigned(data, at, stop)
        at = stop
    return at


def packets(data: bytes, at: int, end: int, out: Media, state: dict, key: bool | None) -> None:
    track, at = read_vint(data, at, end)
    relative, flags = struct.unpack_from(">hB", data, at)
    how = flags >> 1 & 3
    sizes, at = lace_sizes(data, at + 3, end, how)
    step = out.tracks.get(track, {}).get("frame_ns", 0)
    start = (state["cluster"] + relative) * state["scale"]
    if track >= 1 << 31 or max(abs(start), abs(start + len(sizes) * step)) >= 1 << 63:
        raise ValueError(f"track or timestamp out of range before byte {at}")
    for lace, size in enumerate(sizes):
        out.packets.append((track, start + lace * step, bool(flags & 0x80) if key is None else key, at, size, how, lace))
        at += size


PACKETS = "doc_id long, packet int, track int, timestamp_ns long, keyframe boolean, offset long, size long, lacing int, lace int, error string"


def packet_table(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row for each packet of each file, in order; a file that can't be read ends in a row with ``error``."""

    def run(it):
        for batch in slices(it, 256, 8 << 20, "media"):
            rows = []
            for ident, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = demux(data)
                rows += [(ident, k, *p, None) for k, p in enumerate(found.packets)]
                if found.error:
                    rows.append((ident, len(found.packets), None, None, None, None, None, None, None, found.error))
            yield batch_of(rows)

    names = [x.split()[0] for x in PACKETS.split(", ")]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}[x.split()[1]] for x in PACKETS.split(", ")]

    def batch_of(rows):
        columns = list(zip(*rows)) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    return media.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media")).mapInArrow(run, PACKETS)


MEDIA = "doc_id long, n_bytes long, media binary, payload binary, feature string"


def features(found: Media, payload: bytes) -> str:
    """Whole numbers of the packets and of the samples (about the middle, 128)."""
    x = np.frombuffer(payload, np.uint8).astype(np.int32) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    laced_n = sum(p[5] != NO_LACE for p in found.packets)
    last = found.packets[-1][1] if found.packets else 0
    return f"packets={len(found.packets)};keys={sum(p[2] for p in found.packets)};laced={laced_n};clusters={len(found.clusters)};cues={len(found.cues)};last_ns={last};duration_ns={found.duration_ns};sum={int(x.sum())};energy={int((x * x).sum(dtype=np.int64))};min={int(x.min())};max={int(x.max())};crossings={crossings}"


def media_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frame_bytes: int = UNIT) -> DataFrame:
    """Each text as a Matroska file (``media``), and the samples and features read back out of that file."""

    def run(it):
        for batch in slices(it, 256, 4 << 20):
            ids, sizes, files, back, found_all = batch.column(0), [], [], [], []
            for text in batch.column(1).to_pylist():
                raw = (text or "").encode()
                padded = raw + b" " * (-len(raw) % frame_bytes if raw else frame_bytes)
                data = mux(padded, frame_bytes)
                found = demux(data)
                read = b"".join([data[p[3] : p[3] + p[4]] for p in found.packets])
                if found.error or read != padded:
                    raise RuntimeError(f"the file does not read back: {found.error}")
                sizes.append(len(raw))
                files.append(data)
                back.append(read)
                found_all.append(features(found, read))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(files, pa.binary()), pa.array(back, pa.binary()), pa.array(found_all, pa.string())], ["doc_id", "n_bytes", "media", "payload", "feature"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, MEDIA)


def op4_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = media_of(table(spark, sf_dir, "documents"))
    tail = F.expr("substring(payload, greatest(length(payload) - 15, 1), 16)")
    return made.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
