import hashlib

import pytest
from tokenizers import Tokenizer

from tests.llm.helpers import as_sf, docs, odd_rows
from textloom.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["It's <|endoftext|>x\tWORLD'S ÉTÉ 12", "<|startoftext|><|endoftext|>", "  　", "a b é \x1c\x1f\x85 c", "ΣΑΣ İstanbul 'll don't!!", "x" * 3000, "́ ́a"]


def want(rows):
    t = Tokenizer.from_file(PATH)
    out = []
    for r in rows:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((r[0], len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    return sorted(map(repr, out))


def test_query_against_the_library(spark, tmp_path):
    rows = [*odd_rows(), *((100 + k, t, "en", "a", 0) for k, t in enumerate(ODD))]
    got = bpe.op10_bpe(spark, as_sf(docs(spark, rows).repartition(3), tmp_path)).collect()
    assert sorted(repr(tuple(r)) for r in got) == want(rows)


def test_many_blocks_and_buckets(spark):
    rows = [*odd_rows(), *((100 + k, t * 3, "en", "a", 0) for k, t in enumerate(ODD))]
    t = Tokenizer.from_file(PATH)
    for blocks, buckets in ((1, 1), (3000, 7), (1 << 30, 50_000)):
        got = bpe.encoded(docs(spark, rows).repartition(2), PATH, block_bytes=blocks, buckets=buckets).collect()
        by_id = sorted((repr(r.doc_id), r.ids) for r in got)
        assert by_id == sorted((repr(r[0]), t.encode(r[1] or "", add_special_tokens=False).ids) for r in rows)


def test_equal_files_are_apart(spark, tmp_path):
    """Tasks with equal texts, each a block of its own, read from a plain table."""
    for _ in range(3):
        docs(spark).coalesce(1).write.mode("append").parquet(f"{tmp_path}/t")
    frame = spark.read.option("pathGlobFilter", "*.parquet").parquet(f"{tmp_path}/t")
    assert bpe.plain_table(frame)
    got = bpe.encoded(frame, PATH).collect()
    t = Tokenizer.from_file(PATH)
    assert sorted((repr(r.doc_id), r.ids) for r in got) == sorted((repr(r[0]), t.encode(r[1] or "", add_special_tokens=False).ids) for r in odd_rows() * 3)


def test_empty_and_refused(spark, tmp_path):
    assert bpe.encoded(docs(spark, []), PATH).count() == 0
    with pytest.raises(ValueError, match="white space"):
        bpe.encoded(docs(spark), public_tokenizers.path("byte_bpe_50k.json"))


def test_buckets_follow_the_input():
    assert [bpe.buckets_for(n) for n in (0, 1 << 29, 1 << 30, 1 << 32, 100 << 40)] == [512, 512, 512, 1024, 512 * 320]
