"""Removal of repeated passages with suffix arrays of shards.

Every byte that a LENGTH-byte string covers goes, if that string also starts earlier (in a smaller doc_id, or earlier
in the same document). Strings are judged on the input; matches never cross documents.

1. A string's anchor is its least K-byte piece by hash (the leftmost, if equal), so equal strings have equal anchors
   at equal places. A scan cuts each text into segments, the runs of strings with one anchor (176 bytes at most).
2. Segments whose anchor occurs once hold no repeated string. The bytes of all others are cut from their texts and
   dealt to shards by anchor.
3. A shard's suffix array, over its different segments, is built by induced sorting. Where the permuted common prefix
   reaches LENGTH, strings are equal: all occurrences but the first are removals. Every removal comes from here.
4. An anchor of more than GROUP segments is dealt to several cells. What a cell keeps (a segment of each content, its
   first) goes into a further round, by anchors of longer pieces and in the end by the strings themselves, until an
   anchor's segments fit one cell. So no task ever holds a hot anchor, and no string escapes the comparison.
5. Each document's removals are joined to its text.

Defined results: null and empty texts are 0 bytes and lose nothing, as do texts of fewer than LENGTH bytes; rows
without doc_id come after all others, in an order fixed by their text; rows that repeat a doc_id and its text are one
document and get equal results, other texts under one doc_id are other documents (a row is known by its id and 64 bits
of its text's hash, without an id by 128); an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import dropped, slices, stored, table
from textloom.llm.suffixes import permuted_common_prefixes, suffix_array

LENGTH = 100
#: Bytes of the pieces that are anchors in each round; the last serves all further rounds.
PIECES = (24, 48, LENGTH)
#: Bytes hashed at once, bytes of a suffix array (about), and segments of an anchor in one cell.
BATCH, SHARD, GROUP = 1 << 20, 1 << 17, 4096
#: Hot anchors that are broadcast, at most.
HOT = 200_000
PLACE = np.uint64((1 << 22) - 1)
SEPARATOR = 256

RANDOM = np.random.default_rng(20240607)
LETTER = RANDOM.integers(0, 1 << 64, 256, np.uint64)
BASE = int(RANDOM.integers(0, 1 << 62)) | 1
INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Hashes of any piece of a text, by prefix sums of letter times power."""

    def __init__(self, data: np.ndarray, up: np.ndarray, down: np.ndarray):
        self.up = up
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(LETTER[data] * down[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.up[start] + (stop - start).astype(np.uint64))


def segments(data: np.ndarray, hashes: Hashes, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, start, stop) of the runs of strings with one anchor of ``k`` bytes. ends: of the texts in data."""
    n, reach = len(data), LENGTH - k + 1
    empty = np.empty(0, np.int64)
    if n < LENGTH:
        return empty.astype(np.uint64), empty, empty
    at = np.arange(n - k + 1)
    pieces = hashes.of(at, at + k)
    least = (pieces & ~PLACE) | at.astype(np.uint64)
    width = 1
    while width * 2 <= reach:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < reach:
        least = np.minimum(least[: len(least) - (reach - width)], least[reach - width :])
    inside = np.ones(n - LENGTH + 1, bool)  # strings that end within their text
    for end in ends[:-1]:
        inside[max(0, end - LENGTH + 1) : end] = False
    starts = np.flatnonzero(inside)
    if not len(starts):
        return empty.astype(np.uint64), empty, empty
    anchor = (least[starts] & PLACE).astype(np.int64)
    first = np.flatnonzero(np.diff(anchor, prepend=-1))
    last = np.append(first[1:], len(starts)) - 1
    return pieces[anchor[first]], starts[first], starts[last] + LENGTH


def chunks(raw: bytes):
    """(offset, bytes) of a text, cut so that every string is whole in one chunk."""
    step = BATCH - LENGTH
    for a in range(0, max(1, len(raw) - LENGTH + 1), step):
        yield a, raw[a : a + step + LENGTH - 1]


#: A row of the input: its id, or its text's second hash and ``late``, and its text's hash.
ROW = ["late", "d", "t"]
KINDS = {"anchor": pa.int64(), "cell": pa.int32(), "more": pa.bool_(), "late": pa.bool_(), "d": pa.int64(), "t": pa.int64(), "start": pa.int32(), "stop": pa.int32(), "bytes": pa.binary()}
FOUND = "anchor long, late boolean, d long, t long, start int, stop int"
SHIPPED = "anchor long, cell int, more boolean, late boolean, d long, t long, start int, bytes binary"
OUT = "late boolean, d long, t long, start int, stop int, bytes binary"


def batch_of(schema: str, columns) -> pa.RecordBatch:
    names = [f.split()[0] for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, KINDS[n]) for n, c in zip(names, columns)], names)


def merged(start: np.ndarray, stop: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of ranges that overlap or touch, by owner; they come in order of owner and start."""
    if not len(start):
        return start, stop, owner
    new = np.ones(len(start), bool)
    high = np.maximum.accumulate(stop + owner * (1 << 40)) - owner * (1 << 40)
    new[1:] = (owner[1:] != owner[:-1]) | (start[1:] > high[:-1])
    first = np.flatnonzero(new)
    return start[first], np.maximum.reduceat(stop, first), owner[first]


def scanned(it):
    """Rows (late, d, t, text) to their segments."""
    up, down = powers(BASE, BATCH + 1), powers(INVERSE, BATCH + 1)

    def flush(parts):
        data = np.frombuffer(b"".join(p[4] for p in parts), np.uint8)
        ends = np.cumsum([len(p[4]) for p in parts])
        anchor, start, stop = segments(data, Hashes(data, up, down), ends, PIECES[0])
        owner = np.searchsorted(ends, start, "right")
        move = np.array([p[3] - (end - len(p[4])) for p, end in zip(parts, ends.tolist())], np.int64)[owner]
        late, d, t = (np.array([p[k] for p in parts], kind)[owner] for k, kind in enumerate((bool, np.int64, np.int64)))
        yield batch_of(FOUND, [np.ascontiguousarray(anchor).view(np.int64), late, d, t, start + move, stop + move])

    parts, size = [], 0
    for batch in slices(it, 512, 1 << 20):
        for late, d, t, text in zip(*(c.to_pylist() for c in batch.columns)):
            for offset, some in chunks(text.encode()):
                if len(some) < LENGTH:
                    continue
                if size + len(some) > BATCH:
                    yield from flush(parts)
                    parts, size = [], 0
                parts.append((late, d, t, offset, some))
                size += len(some)
    if parts:
        yield from flush(parts)


def numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def cut_out(it):
    """Rows (late, d, t, text, wanted segments) to the segments with their bytes."""
    for batch in slices(it, 64, 1 << 20):
        lists, wanted = batch.column(4), batch.column(4).flatten()
        counts = numbers(pc.list_value_length(lists))
        owner, ends = pa.array(np.repeat(np.arange(len(counts)), counts)), np.cumsum(counts)
        anchor, cell, more, start, stop = (wanted.field(k) for k in range(5))
        keys, starts, stops, data = [batch.column(k).take(owner) for k in range(3)], numbers(start).tolist(), numbers(stop).tolist(), []
        for text, a, b in zip(batch.column(3).to_pylist(), (ends - counts).tolist(), ends.tolist()):
            raw = text.encode()
            data += [raw[x:y] for x, y in zip(starts[a:b], stops[a:b])]
        whole = batch_of(SHIPPED, [anchor, cell, more, *keys, start, pa.array(data, pa.binary())])
        for a in range(0, whole.num_rows, 8192):
            yield whole.slice(a, 8192)


def cut_again(k: int):
    """Rows (late, d, t, start, bytes) to the segments of their anchors of ``k`` bytes."""

    def run(it):
        up, down = powers(BASE, BATCH + 1), powers(INVERSE, BATCH + 1)
        for batch in slices(it, 4096, 1 << 19, "bytes"):
            raw = batch.column(4).to_pylist()
            data, ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(x) for x in raw])
            anchor, start, stop = segments(data, Hashes(data, up, down), ends, k)
            owner = np.searchsorted(ends, start, "right")
            keys = [batch.column(c).take(pa.array(owner)) for c in range(3)]
            at = batch.column(3).to_numpy()[owner] + start - (ends - [len(x) for x in raw])[owner]
            yield batch_of("anchor, late, d, t, start, bytes", [np.ascontiguousarray(anchor).view(np.int64), *keys, at, [data[a:b].tobytes() for a, b in zip(start.tolist(), stop.tolist())]])

    return run


def repeated(pieces: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, start, stop) of the ranges of ``pieces`` (bytes), in order, whose strings start earlier in one of them."""
    text = np.concatenate([x for p in pieces for x in (np.frombuffer(p, np.uint8).astype(np.int64), [SEPARATOR])])
    begins = np.cumsum([0] + [len(p) + 1 for p in pieces])[:-1]
    array = suffix_array(text, SEPARATOR + 1)
    long = permuted_common_prefixes(text, array, LENGTH)[array] >= LENGTH
    run = np.cumsum(~long)  # equal strings stand together
    earliest = np.minimum.reduceat(array, np.flatnonzero(~long)) if len(array) else array
    again = np.sort(array[array != earliest[run - 1]])
    owner = np.searchsorted(begins, again, "right") - 1
    start, stop, owner = merged(again - begins[owner], again - begins[owner] + LENGTH, owner)
    return owner, start, stop


def sorted_shards(it):
    """Rows of SHIPPED by anchor and cell to removals (bytes null) and, of anchors with further cells, what is kept.
    Cells share a suffix array. A segment's copies are one content, in the place of the first of them."""

    def flush(parts, contents):
        code, more, late, d, t, start = (np.concatenate(x) for x in zip(*parts))
        contents = list(contents)
        by = np.lexsort((start, t, d, late))
        seen, at = np.unique(code[by], return_index=True)  # all codes, and their first rows
        first = np.empty(len(contents), np.int64)
        first[seen] = by[at]
        order = seen[np.argsort(at)]
        piece, a, b = repeated([contents[k] for k in order.tolist()])
        own = first[order[piece]]
        lead = first[code]
        other = np.flatnonzero((late != late[lead]) | (d != d[lead]) | (t != t[lead]) | (start != start[lead]))  # rows given twice are one
        size = np.array([len(x) for x in contents], np.int64)
        kept = order[more[first[order]]]
        rows = np.concatenate([own, other, first[kept]])
        begin = np.concatenate([start[own] + a, start[other], start[first[kept]]])
        end = np.concatenate([start[own] + b, start[other] + size[code[other]], start[first[kept]] + size[kept]])
        data = pa.concat_arrays([pa.nulls(len(own) + len(other), pa.binary()), pa.array([contents[k] for k in kept.tolist()], pa.binary())])
        whole = batch_of(OUT, [late[rows], d[rows], t[rows], begin, end, data])
        for k in range(0, whole.num_rows, 16384):
            yield whole.slice(k, 16384)

    parts, contents, at, size = [], {}, None, 0
    for batch in slices(it, 4096, 1 << 20, "bytes"):
        keys = np.stack([numbers(batch.column(0)), numbers(batch.column(1)).astype(np.int64)])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        data = batch.column(7).to_pylist()
        columns = [numbers(batch.column(k)) for k in (2, 3, 4, 5, 6)]
        begun = 0  # rows from here on are not in ``parts`` yet
        codes = np.empty(batch.num_rows, np.int64)
        for a, b in zip(cuts[:-1], cuts[1:]):
            if size >= SHARD and tuple(keys[:, a]) != at:
                if a > begun:
                    parts.append([codes[begun:a], *(c[begun:a] for c in columns)])
                yield from flush(parts, contents)
                parts, contents, size, begun = [], {}, 0, a
                codes = codes.copy()
            at = tuple(keys[:, a])
            for k in range(a, b):
                held = len(contents)
                codes[k] = contents.setdefault(data[k], held)
                if codes[k] == held:
                    size += len(data[k])
        parts.append([codes[begun:], *(c[begun:] for c in columns)])
    if parts:
        yield from flush(parts, contents)


REMOVED = "doc_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary"


def removed(it):
    """Rows (doc_id, text, ranges) to what is left."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in slices(it, 512, 4 << 20):
        lists, ranges = batch.column(2), batch.column(2).flatten()
        counts = numbers(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
        owner, start, stop = np.repeat(np.arange(len(counts)), counts), *(numbers(ranges.field(k)).astype(np.int64) for k in range(2))
        by = np.lexsort((start, owner))
        start, stop, owner = merged(start[by], stop[by], owner[by])
        ends = np.searchsorted(owner, np.arange(len(counts)), "right")
        sizes, kept, a = [], [], 0
        for text, b in zip(batch.column(1).to_pylist(), ends.tolist()):
            raw = text.encode()
            cuts = [0, *np.stack([start[a:b], stop[a:b]], 1).ravel().tolist(), len(raw)]
            sizes.append(len(raw))
            kept.append(raw if a == b else b"".join(raw[x:y] for x, y in zip(cuts[::2], cuts[1::2])))
            a = b
        items = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(stop, pa.int32())], ["start", "end"])
        spans = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), items)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), spans.cast(kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])


def celled(segments: DataFrame, salt: int) -> DataFrame:
    """Of a stored table of segments those whose anchor occurs again, with their cell and whether the anchor has more than
    one. Anchors of more than one in HOT of all segments are fewer than HOT, and are broadcast, so that their segments
    need no shuffle; the others are dealt by anchor."""
    counts = stored(segments.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1"), "anchors")
    most = max(GROUP, segments.count() // HOT)
    hot = F.broadcast(counts.filter(F.col("n") > most))
    rest = segments.join(F.broadcast(counts.filter(F.col("n") > most).select("anchor")), "anchor", "left_anti").join(counts.filter(F.col("n") <= most).hint("shuffle_hash"), "anchor")
    cell = F.pmod(F.xxhash64(F.lit(salt), *ROW, "start"), F.ceil(F.col("n") / GROUP)).cast("int")
    return segments.join(hot, "anchor").unionByName(rest).withColumn("cell", cell).withColumn("more", F.col("n") > GROUP).drop("n")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, the removed spans (byte offsets, end exclusive) and the bytes that are kept, of every row."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    source = source.select("doc_id", F.col("doc_id").isNull().alias("late"), F.coalesce("doc_id", F.xxhash64(F.lit("order"), "text")).alias("d"), F.xxhash64("text").alias("t"), "text")

    segments_ = stored(source.select(*ROW, "text").mapInArrow(scanned, FOUND), "segments")
    # Every step is a stored table, so a lost executor repeats a step at most, and no step holds the shuffles of another.
    listed = F.collect_list(F.struct("anchor", "cell", "more", "start", "stop")).alias("wanted")
    wanted = stored(celled(segments_, 0), "wanted")
    dropped(segments_)
    pieces = stored(source.select(*ROW, "text").join(wanted.groupBy(*ROW).agg(listed).hint("shuffle_hash"), ROW).mapInArrow(cut_out, SHIPPED), "pieces")
    dropped(wanted)
    gone, rounds = [], 0
    while True:
        found = stored(pieces.repartition(n, "anchor", "cell").sortWithinPartitions("anchor", "cell").mapInArrow(sorted_shards, OUT), "repeats")
        dropped(pieces)
        gone.append(found.filter("bytes IS NULL").select(*ROW, "start", "stop"))
        rounds += 1
        left = found.filter("bytes IS NOT NULL").select(*ROW, "start", "bytes")
        if left.isEmpty():
            break
        segments_ = stored(left.mapInArrow(cut_again(PIECES[min(rounds, len(PIECES) - 1)]), "anchor long, late boolean, d long, t long, start int, bytes binary"), "segments")
        pieces = stored(celled(segments_, rounds).select(*[f.split()[0] for f in SHIPPED.split(", ")]), "pieces")
        dropped(segments_)

    ranges = reduce(DataFrame.union, gone)
    listed = ranges.groupBy(*ROW).agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    whole = source.join(listed.hint("shuffle_hash"), ROW, "left").select("doc_id", "text", "ranges")
    return whole.mapInArrow(removed, REMOVED)


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = without_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
