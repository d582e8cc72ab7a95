"""BPE encoding and decoding through a table of distinct words.

1. Each scan task splits its texts at ASCII white space into blocks of documents: a block is a list of its distinct
   words, dealt into buckets by a hash of the word, and for each document the positions' word numbers.
2. The words of a bucket meet from all blocks; each distinct word is encoded once and its ids go back to every block
   that has it. A word comes once for each block, so no frequent word is hot.
3. Blocks join the ids of their words back by position, and decode them by a lookup of id to piece (a table as
   large as the vocabulary).

The table is scanned twice, for the words and for the positions, so that neither is written but to the one shuffle
that needs it. A block is named by a hash of its texts; one that reads differently the second time has no words
and fails the job. A frame that is not a plain table of files is written to the shared folder first.

It needs a tokenizer that drops white space and has no decoder, so that texts fall apart at white space and decoded
pieces are joined by spaces; others are refused.

Defined results: null and empty texts, and texts of white space, have no tokens and decode to an empty text;
repeated rows give repeated results; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import json
import math
import os
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import released, slices, stored, table

#: Text bytes of a block, least buckets of words, and documents a row.
BLOCK_BYTES, BUCKETS, ROW_DOCS = 12 << 20, 512, 32
#: Bytes of input from which there are more buckets, by its square root, as distinct words grow no faster.
BUCKETS_FROM = 1 << 30
PACKED = "block long, kind int, bucket int, doc_ids array<long>, lens binary, data binary"
ENCODED = "doc_id long, n_tokens long, ids array<int>, decoded string"


def packed(x: np.ndarray) -> bytes:
    """32-bit numbers as planes of bytes, as many as the largest needs, compressed."""
    width = 1 if x.max(initial=0) < 1 << 8 else 2 if x.max() < 1 << 16 else 3 if x.max() < 1 << 24 else 4
    planes = np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T[:width])
    return bytes([width]) + zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 4), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<u4").ravel()


def list_column(values: pa.Array, offsets: list[int] | np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def rows(**columns) -> pa.RecordBatch:
    """A batch of the PACKED schema; columns that are left out are null."""
    n = len(columns["block"])
    kinds = {"block": pa.int64(), "kind": pa.int32(), "bucket": pa.int32(), "doc_ids": pa.list_(pa.int64()), "lens": pa.binary(), "data": pa.binary()}
    made = {k: v if isinstance(v := columns.get(k, [None] * n), pa.Array) else pa.array(v, t) for k, t in kinds.items()}
    return pa.RecordBatch.from_arrays(list(made.values()), list(made))


def split_blocks(block_bytes: int, buckets: int, kind: int):
    """Texts into blocks: for kind 1 a row for each bucket of distinct words, for kind 0 rows of some documents."""

    def flush(name, known, ids, codes):
        block = name.intdigest() >> 1
        words = list(known)
        bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
        order = np.argsort(bucket, kind="stable")
        if kind:
            used, starts = np.unique(bucket[order], return_index=True)
            ordered, pack = [words[k] for k in order], zstandard.ZstdCompressor(level=3).compress
            data = [pack(b"\n".join(ordered[a:b])) for a, b in zip(starts, [*starts[1:], len(words)])]
            for a in range(0, len(used), 64):
                yield rows(block=[block] * len(used[a : a + 64]), kind=[1] * len(used[a : a + 64]), bucket=used[a : a + 64].tolist(), data=data[a : a + 64])
            return
        number = np.empty(len(words), np.uint32)
        number[order] = np.arange(len(words), dtype=np.uint32)
        for a in range(0, len(ids), 8 * ROW_DOCS):
            groups = [(ids[k : k + ROW_DOCS], codes[k : k + ROW_DOCS]) for k in range(a, min(a + 8 * ROW_DOCS, len(ids)), ROW_DOCS)]
            yield rows(
                block=[block] * len(groups),
                kind=[0] * len(groups),
                bucket=[-1] * len(groups),
                doc_ids=[g for g, _ in groups],
                lens=[packed(np.array([len(c) for c in cs])) for _, cs in groups],
                data=[packed(number[np.concatenate(cs)] if len(words) else np.empty(0, np.uint32)) for _, cs in groups],
            )

    def run(it):
        done, name, known, ids, codes, size = 0, None, {}, [], [], 0
        for batch in slices(it):
            # The number of the table's partition keeps equal blocks of different tasks apart.
            name = name or xxhash.xxh64(f"{batch.column(2)[0]}:{done}".encode())
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = (text or "").encode()
                name.update(raw + b"\0")
                words = raw.split()
                ids.append(ident)
                if kind:
                    known.update(zip(words, words))
                else:
                    codes.append(np.array([known.setdefault(w, len(known)) for w in words], np.uint32))
                size += len(raw)
            if size >= block_bytes:
                yield from flush(name, known, ids, codes)
                done, name, known, ids, codes, size = done + 1, None, {}, [], [], 0
        if ids:
            yield from flush(name, known, ids, codes)
        del known, ids, codes
        released()

    return run


def load(definition: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(definition)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def encode_words(definition: str):
    """Rows of words, in order of bucket, to rows with the number of ids of each word and the ids."""

    def run(it):
        tokenizer, bucket, known = load(definition), None, {}
        for batch in slices(it, 128, 1 << 20, "data"):
            blocks, numbers = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            words = [zstandard.ZstdDecompressor().decompress(x).decode().split("\n") for x in batch.column(5).to_pylist()]
            known = known if numbers[0] == bucket else {}
            fresh = list(dict.fromkeys(w for some in words for w in some if w not in known))
            known |= zip(fresh, (e.ids for e in tokenizer.encode_batch(fresh, add_special_tokens=False)))
            lens = [packed(np.array([len(known[w]) for w in some])) for some in words]
            data = [packed(np.array([i for w in some for i in known[w]], np.uint32)) for some in words]
            yield rows(block=blocks, kind=[1] * len(blocks), bucket=numbers, lens=lens, data=data)
            bucket = numbers[-1]  # the next batch may go on with it
            known = {w: known[w] for number, some in zip(numbers, words) if number == bucket for w in some} if numbers[0] != bucket else known

    return run


def join_back(definition: str):
    """Rows in order of block, words (by bucket) before documents, to the ids and the decoded text of each document."""

    def run(it):
        tokenizer = load(definition)
        pieces = [tokenizer.id_to_token(k) for k in range(tokenizer.get_vocab_size(with_added_tokens=True))]
        block, lens, data, table_ = None, [], [], None
        for batch in slices(it, 16, 8 << 20, "data"):
            for number, kind, ids, some_lens, some in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5))):
                if number != block:
                    block, lens, data, table_ = number, [], [], None
                if kind:
                    lens.append(unpacked(some_lens))
                    data.append(unpacked(some))
                    continue
                if table_ is None:
                    if not lens and any(map(len, map(unpacked, [some]))):
                        raise RuntimeError("the documents read differently the second time; write them to a table first")
                    sizes = np.concatenate(lens) if lens else np.empty(0, np.uint32)
                    flat = np.concatenate(data).astype(np.int32) if data else np.empty(0, np.int32)
                    ends = np.cumsum(sizes, dtype=np.int64)
                    shown = [pieces[i] for i in flat]
                    joined = [" ".join(shown[a:b]) for a, b in zip((ends - sizes).tolist(), ends.tolist())]
                    table_, lens, data = (sizes.astype(np.int64), flat, ends - sizes, joined, bool(len(sizes)) and not sizes.all()), [], []
                sizes, flat, starts, joined, gaps = table_
                codes = unpacked(some)
                n = sizes[codes]
                reach = np.cumsum(n)
                ids_flat = flat[np.repeat(starts[codes] - (reach - n), n) + np.arange(reach[-1] if len(reach) else 0)]
                doc_ends = np.cumsum(unpacked(some_lens), dtype=np.int64)
                cuts = np.concatenate([[0], np.concatenate([[0], reach])[doc_ends]])
                listed, texts, a = codes.tolist(), [], 0
                for b in doc_ends.tolist():
                    texts.append(" ".join([s for c in listed[a:b] if (s := joined[c])] if gaps else [joined[c] for c in listed[a:b]]))
                    a = b
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.diff(cuts), pa.int64()), list_column(pa.array(ids_flat, pa.int32()), cuts), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])
        lens = data = table_ = joined = listed = texts = None
        released()

    return run


def plain_table(df: DataFrame) -> bool:
    """Whether ``df`` is no more than columns of files, which read the same each time."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return all(line.strip(" :+-").split(" ")[0] in ("Project", "Relation") for line in plan.splitlines() if line.strip())


def buckets_for(size: int) -> int:
    """Buckets for an input of ``size`` bytes, so that the words of one fit a worker."""
    return BUCKETS * max(1, math.ceil(math.sqrt(size / BUCKETS_FROM)))


def encoded(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, buckets: int | None = None) -> DataFrame:
    """doc_id, n_tokens, ids and the decoded text of every row of ``docs``. The driver reads the tokenizer's file."""
    definition = Path(tokenizer_path).read_text()
    parts = json.loads(definition)
    if parts["decoder"] is not None or "\\s+" not in json.dumps(parts["normalizer"]).replace("\\\\", "\\"):
        raise ValueError("the tokenizer must drop white space and join pieces by spaces")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if not plain_table(docs):
        source = stored(source, "bpe")
    buckets = buckets or buckets_for(int(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    source = source.withColumn("part", F.spark_partition_id())
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = source.mapInArrow(split_blocks(block_bytes, buckets, 1), PACKED).repartition(n, "bucket").sortWithinPartitions("bucket")
    both = source.mapInArrow(split_blocks(block_bytes, buckets, 0), PACKED).union(words.mapInArrow(encode_words(definition), PACKED))
    whole = both.repartition(n, "block").sortWithinPartitions("block", F.col("kind").desc(), "bucket")
    return whole.mapInArrow(join_back(definition), ENCODED)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", "n_tokens", F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
