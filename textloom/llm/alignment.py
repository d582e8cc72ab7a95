"""Alignment of two tokenizers over a corpus: which of their tokens cover the same bytes.

1. Each scan task encodes its texts with both tokenizers and packs them in blocks of documents. A text falls apart at
   every space that stands between two solid characters, as neither tokenizer has a token across it; each distinct
   piece is encoded and aligned once while it stays in the task's memory.
2. Postings: for every pair of ids (A, B) that overlap, the documents of the block and how often. They are shuffled by
   their B id, in buckets, as rows of one block and one bucket that Spark sorts and spills.
3. The counts of a bucket's pairs are summed by block, then by part, then whole, and with them the highest count of
   each B id. In the postings' cogroup they come first; postings stream past them and each row of postings becomes the
   contributions of its documents, packed as one row. A bucket of more than CELL postings is dealt into parts by block,
   each of which gets the bucket's counts, whose size the two vocabularies bound.
4. Contributions meet their block again and are summed by document.

Defined results: a text that is null, empty, or that either tokenizer doesn't give back byte by byte has no tokens, so
zeros and an empty list of groups; special tokens' strings are plain text; repeated rows count once each; an empty
table gives an empty one; a null doc_id stays null; columns of any name may stand beside these.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
from itertools import pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.bpe import packed, unpacked
from textloom.llm.common import quoted, released, slices, stored, table

#: Text bytes and documents of a block; pieces kept in a task's memory.
BLOCK_BYTES, BLOCK_DOCS, KEPT = 6 << 20, 4096, 300_000
#: Pieces that are encoded as one text.
TOGETHER = 64
#: Buckets of B ids for an input up to BUCKETS_FROM bytes (more by its square root, MOST at most); postings of a cell;
#: blocks whose counts are summed in a first step.
BUCKETS, BUCKETS_FROM, MOST, CELL, SUMMED = 64, 8 << 30, 4096, 1 << 20, 256
#: The character that stands for a space in pieces of B.
SPACE = "▁"
#: Characters beside white space at which no text is cut.
LOOSE = "\u180e\u200b\ufeff" + SPACE
ROWS = "block long, kind int, bucket int, size long, data binary, doc_ids array<long>, numbers array<long>, hashes array<string>"
SUMS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def byte_values() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable Latin-1 stands for itself, the others follow
    from 256 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Solid(dict):
    """Whether a piece may be cut off at both of its ends."""

    def __missing__(self, piece: str) -> bool:
        found = bool(piece) and not (piece[0].isspace() or piece[-1].isspace() or piece[0] in LOOSE or piece[-1] in LOOSE)
        if len(self) < KEPT:
            self[piece] = found
        return found


class Aligner:
    """Both tokenizers, and the groups and links of every piece seen of late."""

    def __init__(self, definition: str, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(definition)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        values = byte_values()
        entries = [self.a.id_to_token(k) for k in range(self.a.get_vocab_size(with_added_tokens=True))]
        self.bytes_a = [bytes(values[c] for c in e) if all(c in values for c in e) else e.encode() for e in entries]
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(SPACE, " ").encode() for k, p in enumerate(pieces)]
        self.lens_a, self.lens_b = (np.array(list(map(len, x))) for x in (self.bytes_a, self.bytes_b))
        self.names = [np.array([f"{k}{mark}" for k in range(max(len(entries), len(pieces)))], object) for mark in ",|;"]
        parts = json.loads(definition)
        own = parts["pre_tokenizer"] or {}
        across = any(x != SPACE and y == SPACE for p in pieces for x, y in pairwise(p))
        same = self.b.encode("aa bb") == self.b.encode("aa") + self.b.encode("bb")
        self.cuts = parts["normalizer"] is None and own.get("type") == "ByteLevel" and own.get("use_regex", True) and same and not across
        self.solid = Solid()
        self.forget()

    def forget(self) -> None:
        self.known, self.shown = {}, []
        self.sizes, self.links = [np.empty((0, 4), np.int64)], [np.empty(0, np.uint64)]

    def pieces(self, text: str) -> list[str]:
        if not self.cuts:
            return [text]
        parts = text.split(" ")
        solid = list(map(self.solid.__getitem__, parts))
        if all(solid):
            return parts
        out, now = [], parts[0]
        ends = lambda p: bool(p) and not p[-1].isspace() and p[-1] not in LOOSE
        starts = lambda p: bool(p) and not p[0].isspace() and p[0] not in LOOSE
        joined = [now]
        for part in parts[1:]:
            if ends(now) and starts(part):
                out.append(" ".join(joined))
                joined = []
            joined.append(part)
            now = part
        return [*out, " ".join(joined)]

    def learn(self, fresh: list[str]) -> None:
        """Encodes and aligns pieces; each stands after a space. Solid ones are encoded as texts of some."""
        solid = [p for p in fresh if self.cuts and self.solid[p]]
        rest = [] if len(solid) == len(fresh) else [p for p in fresh if not (self.cuts and self.solid[p])]
        for k in range(0, len(solid), TOGETHER * 64):
            some = solid[k : k + TOGETHER * 64]
            if not self.together(some):
                rest += some
        for piece, one, two in zip(rest, self.a.encode_batch_fast([" " + p for p in rest], add_special_tokens=False), self.b.encode(rest)):
            self.known[piece] = len(self.shown)
            shown, sizes, pairs = self.aligned(piece, one.ids, two)
            self.shown.append(shown)
            self.sizes.append(np.array([sizes], np.int64))
            self.links.append(np.array(pairs, np.uint64))

    def together(self, some: list[str]) -> bool:
        """Encodes and aligns solid pieces at once; False, and nothing done, if the bytes of any differ."""
        texts = [" ".join(some[k : k + TOGETHER]) for k in range(0, len(some), TOGETHER)]
        one = [i for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False) for i in e.ids]
        two = [i for ids in self.b.encode(texts) for i in ids]
        raw = (" " + " ".join(texts)).encode()
        if b"".join([self.bytes_a[i] for i in one]) != raw or b"".join([self.bytes_b[i] for i in two]) != raw:
            return False
        one, two = np.array(one), np.array(two)
        lens_a, lens_b = self.lens_a[one], self.lens_b[two]
        ends_a, ends_b = np.cumsum(lens_a), np.cumsum(lens_b)
        stops = np.cumsum([len(p.encode()) + 1 for p in some])
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        if not (lens_a.all() and lens_b.all() and np.isin(stops, both).all()):
            return False
        every = np.union1d(ends_a, ends_b)  # a link ends at each
        group_a, group_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
        parts = np.empty(len(one) + len(two), object)
        at_a, at_b = np.arange(len(one)) + np.searchsorted(group_b, group_a), np.arange(len(two)) + np.searchsorted(group_a, group_b, "right")
        parts[at_a] = np.where(both[group_a] == ends_a, self.names[1][one], self.names[0][one])
        parts[at_b] = np.where(both[group_b] == ends_b, self.names[2][two], self.names[0][two])
        reach = [np.searchsorted(x, stops, "right") for x in (ends_a, ends_b, both, every)]
        cuts = (reach[0] + reach[1]).tolist()
        parts = parts.tolist()
        self.known.update(zip(some, range(len(self.shown), len(self.shown) + len(some))))
        self.shown += ["".join(parts[a:b])[:-1] for a, b in zip([0, *cuts], cuts)]
        self.sizes.append(np.diff(np.stack(reach, axis=1), axis=0, prepend=0))
        self.links.append(two[np.searchsorted(ends_b, every)].astype(np.uint64) << np.uint64(32) | one[np.searchsorted(ends_a, every)].astype(np.uint64))
        return True

    def aligned(self, piece: str, one: list[int], two: list[int]) -> tuple[str | None, tuple, list[int]]:
        """The groups as text (None if the bytes differ), the numbers of tokens, groups and links, the links' ids."""
        raw = (" " + piece).encode()
        bytes_a, bytes_b = self.bytes_a, self.bytes_b
        if b"".join([bytes_a[i] for i in one]) != raw or b"".join([bytes_b[i] for i in two]) != raw:
            return None, (0, 0, 0, 0), []
        groups, pairs, i, j, from_i, from_j = [], [], 0, 0, 0, 0
        end_a, end_b = len(bytes_a[one[0]]), len(bytes_b[two[0]])
        while True:
            pairs.append(two[j] << 32 | one[i])
            if end_a == end_b:
                groups.append(",".join(map(str, one[from_i : i + 1])) + "|" + ",".join(map(str, two[from_j : j + 1])))
                i, j = i + 1, j + 1
                from_i, from_j = i, j
                if i == len(one):
                    return ";".join(groups), (len(one), len(two), len(groups), len(pairs)), pairs
                end_a, end_b = end_a + len(bytes_a[one[i]]), end_b + len(bytes_b[two[j]])
            elif end_a < end_b:
                i += 1
                end_a += len(bytes_a[one[i]])
            else:
                j += 1
                end_b += len(bytes_b[two[j]])

    def codes(self, texts: list[str | None]) -> list[list[int]]:
        """The numbers of each text's pieces, none where it has no tokens."""
        found = [self.pieces(t) if t else [] for t in texts]
        known = self.known
        self.learn([p for p in dict.fromkeys(p for some in found for p in some) if p not in known])
        out = [list(map(known.__getitem__, some)) for some in found]
        bad = {k for k, s in enumerate(self.shown) if s is None} if None in self.shown else set()
        return [[] if bad and not bad.isdisjoint(some) else some for some in out] if bad else out


def batch_of(**columns) -> pa.RecordBatch:
    """A batch of the ROWS schema; columns that are left out are null."""
    n = len(columns["block"])
    kinds = {"block": pa.int64(), "kind": pa.int32(), "bucket": pa.int32(), "size": pa.int64(), "data": pa.binary(), "doc_ids": pa.list_(pa.int64()), "numbers": pa.list_(pa.int64()), "hashes": pa.list_(pa.string())}
    return pa.RecordBatch.from_arrays([pa.array(columns.get(k, [None] * n), t) for k, t in kinds.items()], list(kinds))


def framed(parts: list[bytes]) -> bytes:
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def unframed(data: bytes) -> list[bytes]:
    out, k = [], 0
    while k < len(data):
        n = int.from_bytes(data[k : k + 4], "little")
        out.append(data[k + 4 : k + 4 + n])
        k += 4 + n
    return out


def keys_in(pairs: np.ndarray) -> list[bytes]:
    """Sorted pairs of ids, as the steps between B ids and the A ids."""
    return [packed(np.diff((pairs >> np.uint64(32)).astype(np.int64), prepend=0)), packed(pairs & np.uint64(0xFFFFFFFF))]


def keys_of(steps: bytes, ids: bytes) -> np.ndarray:
    return np.cumsum(unpacked(steps).astype(np.uint64)) << np.uint64(32) | unpacked(ids).astype(np.uint64)


def long_packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.astype("<i8").tobytes())


def long_unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<i8")


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values start and how long they are."""
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, np.int64)
    return starts, np.diff(np.append(starts, len(values)))


def posted(definition: str, model: bytes, buckets: int):
    """Texts to rows of ROWS: a block's documents (kind 2), and for each bucket its pairs' counts (0) and postings (1)."""

    def flush(aligner, block, ids, codes, hashes):
        sizes, keys = np.concatenate(aligner.sizes), np.concatenate(aligner.links)
        aligner.sizes, aligner.links = [sizes], [keys]
        lens = np.array([len(c) for c in codes])
        flat = np.fromiter((c for some in codes for c in some), np.int64, lens.sum())
        docs = np.repeat(np.arange(len(codes)), lens)
        sums = np.zeros((len(codes), 4), np.int64)
        for k in range(4):
            sums[:, k] = np.bincount(docs, sizes[flat, k], len(codes)).astype(np.int64) if len(flat) else 0
        yield batch_of(block=[block], kind=[2], bucket=[-1], doc_ids=[ids], numbers=[sums.ravel()], hashes=[hashes])
        if not len(flat):
            return
        # each piece of a document once, then its links
        piece = np.sort(docs * len(sizes) + flat)
        starts, times = runs(piece)
        docs, flat = np.divmod(piece[starts], len(sizes))
        used, place = np.unique(flat, return_inverse=True)
        many = sizes[used, 3]
        stops = np.cumsum(many)
        every, number = np.unique(keys[np.repeat((np.cumsum(sizes[:, 3]) - sizes[:, 3])[used] - (stops - many), many) + np.arange(stops[-1])], return_inverse=True)
        n = many[place]
        ends = np.cumsum(n)
        at = np.repeat((np.cumsum(many) - many)[place] - (ends - n), n) + np.arange(ends[-1])
        posting = number[at].astype(np.int64) * len(codes) + np.repeat(docs, n)
        order = np.argsort(posting, kind="stable")
        posting, weights = posting[order], np.repeat(times, n)[order]
        starts, _ = runs(posting)
        pair, doc = np.divmod(posting[starts], len(codes))
        times = np.add.reduceat(weights, starts)
        firsts, spans = runs(pair)  # every pair is used
        counts = np.add.reduceat(times, firsts)
        bucket = ((every >> np.uint64(32)) * np.uint64(0x9E3779B1) >> np.uint64(7)) % np.uint64(buckets)
        for b in np.unique(bucket).tolist():
            own = np.flatnonzero(bucket == b)
            rows = np.concatenate([np.arange(firsts[k], firsts[k] + spans[k]) for k in own.tolist()])
            keys = keys_in(every[own])
            yield batch_of(
                block=[block, block], kind=[0, 1], bucket=[b, b], size=[len(own), len(rows)],
                data=[framed([*keys, long_packed(counts[own])]), framed([*keys, packed(spans[own]), packed(doc[rows]), packed(times[rows])])],
            )

    def run(it):
        aligner, block, done, ids, codes, hashes, size = Aligner(definition, model), None, 0, [], [], [], 0
        for batch in slices(it, 256, 1 << 20):
            texts = batch.column(1).to_pylist()
            block = block or xxhash.xxh64(f"{batch.column(2)[0]}:{done}".encode()).intdigest() >> 1
            found = aligner.codes(texts)
            ids += batch.column(0).to_pylist()
            codes += found
            for some in found:
                hashes.append(hashlib.sha256(";".join([aligner.shown[c] for c in some]).encode()).hexdigest() if some else "")
            size += sum(len(t or "") for t in texts)
            if size >= BLOCK_BYTES or len(ids) >= BLOCK_DOCS:
                yield from flush(aligner, block, ids, codes, hashes)
                block, done, ids, codes, hashes, size = None, done + 1, [], [], [], 0
                if len(aligner.known) > KEPT:
                    aligner.forget()
        if ids:
            yield from flush(aligner, block, ids, codes, hashes)
        aligner.forget()
        released()

    return run


def summed(best: bool):
    """Rows (bucket, part, data) of pairs and counts, in that order, to one row a part; with ``best`` also whether each
    count is the highest of its B id."""

    def run(it):
        def row():
            pairs, counts = added(held)
            data = [*keys_in(pairs), long_packed(counts)]
            if best:
                side = pairs >> np.uint64(32)
                starts, spans = runs(side)
                data.append(packed(counts == np.repeat(np.maximum.reduceat(counts, starts), spans)))
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([framed(data)], pa.binary())], ["bucket", "part", "data"])

        at, held, n = None, [], 0
        for batch in slices(it, 256, 4 << 20, "data"):
            for *key, data in zip(*(c.to_pylist() for c in batch.columns)):
                if key != at and held:
                    yield row()
                    held, n = [], 0
                at = key
                steps, ids, counts = unframed(data)
                held.append((keys_of(steps, ids), long_unpacked(counts)))
                n += len(held[-1][0])
                if n > 1 << 20 and n > 2 * len(held[0][0]):
                    held = [added(held)]
                    n = len(held[0][0])
        if held:
            yield row()

    return run


def added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    pairs, counts = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(pairs, kind="stable")
    pairs, counts = pairs[order], counts[order]
    starts, _ = runs(pairs)
    return pairs[starts], np.add.reduceat(counts, starts)


def contributed(it):
    """Rows (bucket, part, kind, block, data), a cell's counts before its postings, to the contributions (block, data):
    documents, links of highest count and sums of counts."""
    at = pairs = counts = top = None
    for batch in slices(it, 64, 4 << 20, "data"):
        blocks, out = [], []
        for bucket, part, kind, block, data in zip(*(c.to_pylist() for c in batch.columns)):
            if not kind:
                steps, ids, numbers, flags = unframed(data)
                at, pairs, counts, top = (bucket, part), keys_of(steps, ids), long_unpacked(numbers), unpacked(flags).astype(np.int64)
                continue
            if at != (bucket, part):
                raise RuntimeError("postings without counts")
            steps, ids, spans, docs, times = unframed(data)
            place = np.repeat(np.searchsorted(pairs, keys_of(steps, ids)), unpacked(spans))
            docs, times = unpacked(docs).astype(np.int64), unpacked(times).astype(np.int64)
            order = np.argsort(docs, kind="stable")
            starts, _ = runs(docs[order])
            place, times = place[order], times[order]
            blocks.append(block)
            out.append(framed([packed(docs[order][starts]), packed(np.add.reduceat(times * top[place], starts)), long_packed(np.add.reduceat(times * counts[place], starts))]))
        if blocks:
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(out, pa.binary())], ["block", "data"])


def by_document(it):
    """Rows (block, kind, data, doc_ids, numbers, hashes), a block's documents first, to a row for each document."""

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(np.ascontiguousarray(sums[:, k])) for k in range(6)), pa.array(hashes, pa.string())], ["doc_id", *SUMS, "groups_sha256"])

    ids = sums = hashes = None
    for batch in slices(it, 64, 4 << 20, "data"):
        for _, kind, data, some, numbers, shas in zip(*(c.to_pylist() for c in batch.columns)):
            if kind == 2:
                if ids is not None:
                    yield rows()
                ids, hashes, sums = some, shas, np.zeros((len(some), 6), np.int64)
                sums[:, :4] = np.array(numbers, np.int64).reshape(-1, 4)
                continue
            docs, best, totals = unframed(data)
            place = unpacked(docs).astype(np.int64)  # each once
            sums[place, 4] += unpacked(best).astype(np.int64)
            sums[place, 5] += long_unpacked(totals)
    if ids is not None:
        yield rows()


def grouped(definition: str, model: bytes):
    def run(it):
        aligner = Aligner(definition, model)
        for batch in slices(it, 256, 1 << 20):
            found = aligner.codes(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([";".join(aligner.shown[c] for c in some) for some in found], pa.string())], ["doc_id", "groups"])
            if len(aligner.known) > KEPT:
                aligner.forget()

    return run


def sources(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).alias("text"))


def groups(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the groups of every row of ``docs``, as A ids | B ids of each, in order."""
    return sources(docs, id_col, text_col).mapInArrow(grouped(Path(path_a).read_text(), Path(path_b).read_bytes()), "doc_id long, groups string")


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None, cell: int = CELL) -> DataFrame:
    """doc_id, SUMS and the hash of the groups for every row of ``docs``. The driver reads the tokenizers' files."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    source = sources(docs, id_col, text_col)
    size = int(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    buckets = buckets or min(MOST, BUCKETS * max(1, math.ceil(math.sqrt(min(size, 1 << 60) / BUCKETS_FROM))))
    made = posted(Path(path_a).read_text(), Path(path_b).read_bytes(), buckets)
    rows = stored(source.withColumn("part", F.spark_partition_id()).mapInArrow(made, ROWS), "postings")

    parts = F.ceil(F.count("*") / SUMMED).cast("int").alias("parts")
    sizes = rows.filter("kind = 1").groupBy("bucket").agg(parts, F.ceil(F.sum("size") / cell).cast("int").alias("cells"))
    own = rows.filter("kind = 0").join(F.broadcast(sizes), "bucket")  # a row for each of MOST buckets at most
    merged = lambda x, best: x.select("bucket", "part", "data").repartition(n, "bucket", "part").sortWithinPartitions("bucket", "part").mapInArrow(summed(best), "bucket int, part int, data binary")
    some = merged(own.withColumn("part", F.pmod(F.xxhash64("block"), F.col("parts")).cast("int")), False)
    counts = merged(some.withColumn("part", F.lit(0)), True)

    every = F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("part")
    heads = counts.drop("part").join(F.broadcast(sizes), "bucket").select("bucket", every, F.lit(0).alias("kind"), F.lit(None).cast("long").alias("block"), "data")
    posts = rows.filter("kind = 1").join(F.broadcast(sizes), "bucket").select("bucket", F.pmod(F.xxhash64("block"), F.col("cells")).cast("int").alias("part"), "kind", "block", "data")
    cells = heads.union(posts).repartition(n, "bucket", "part").sortWithinPartitions("bucket", "part", "kind")
    shares = cells.mapInArrow(contributed, "block long, data binary")

    empty = [F.lit(None).cast(t).alias(c) for c, t in (("doc_ids", "array<long>"), ("numbers", "array<long>"), ("hashes", "array<string>"))]
    heads = rows.filter("kind = 2").select("block", "kind", "data", "doc_ids", "numbers", "hashes")
    met = heads.union(shares.select("block", F.lit(3).alias("kind"), "data", *empty)).repartition(n, "block").sortWithinPartitions("block", "kind")
    return met.mapInArrow(by_document, ", ".join(["doc_id long", *(f"{c} long" for c in SUMS), "groups_sha256 string"]))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return aligned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
