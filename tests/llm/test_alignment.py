import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.decoders import ByteLevel

from tests.llm.helpers import as_sf, docs, odd_rows, prose
from textloom.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def spans(pieces):
    ends, at = [], 0
    for p in pieces:
        ends.append((at, at + len(p)))
        at += len(p)
    return ends


def unicode_bytes():
    keep = [b for b in range(256) if chr(b).isprintable() and b not in (32, 173) and not 127 <= b <= 160]
    return {chr(b): b for b in keep} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in keep)}


def brute(rows):
    """Whole texts through both tokenizers, all pairs of tokens compared by their bytes."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    values = unicode_bytes()
    found = []
    for r in rows:
        text = r[1] or ""
        one = a.encode(" " + text, add_special_tokens=False).ids if text else []
        two = b.encode(text) if text else []
        left = [bytes(values[c] for c in a.id_to_token(k)) for k in one]
        right = [bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode() for k in two for p in [b.id_to_piece(k)]]
        if not text or b"".join(left) != b"".join(right) or b"".join(left) != (" " + text).encode():
            one, two, left, right = [], [], [], []
        x, y = spans(left), spans(right)
        cuts = sorted({e for _, e in x} & {e for _, e in y})
        groups, start = [], 0
        for cut in cuts:
            groups.append(",".join(str(k) for k, (s, e) in zip(one, x) if start <= s and e <= cut) + "|" + ",".join(str(k) for k, (s, e) in zip(two, y) if start <= s and e <= cut))
            start = cut
        links = [(i, j) for i, (s, e) in zip(one, x) for j, (t, u) in zip(two, y) if s < u and t < e]
        found.append((r[0], len(one), len(two), groups, links))
    counts = Counter(link for f in found for link in f[4])
    best = defaultdict(int)
    for (_, j), c in counts.items():
        best[j] = max(best[j], c)
    return Counter((d, n, m, len(g), len(l), sum(counts[p] == best[p[1]] for p in l), sum(counts[p] for p in l), hashlib.sha256(";".join(g).encode()).hexdigest() if n else "") for d, n, m, g, l in found)


def texts(seed=2):
    r = random.Random(seed)
    marks = ["it's", "don't", "<|endoftext|>", "<s>", "</s>", "  ", " \n", "\n", "\t", "\r\n", "naïve", "日本語", "\U0001F600", "123456", "…", " ", "　x", "x​", "▁", "a\x00b", "(x){y}", "ﬁ", "é", "'s", "--", "\x1c", " ", "﻿"]
    rows = []
    for k in range(120):
        words = [r.choice(marks) if r.random() < 0.3 else r.choice(["The", "token", "and", "internationalization", "of", "xyzzyq"]) for _ in range(r.choice([1, 4, 25]))]
        rows.append((k + 100, r.choice([" ", " ", "", "  "]).join(words), "en", "s", 1))
    return rows + [(900 + k, t, "en", "s", 1) for k, t in enumerate([" ", "   ", " lead", "trail ", "trail  ", "\n", "a \n b", "x" * 300, " " * 40 + "a", "<|endoftext|>", "<|endoftext|> <s> a"])] + [x for x in odd_rows() if len(x[1] or "") < 3000]


def result(found):
    return Counter(tuple(r) for r in found.select("doc_id", *alignment.SUMS, "groups_sha256").collect())


@pytest.mark.parametrize("buckets, cell, block", [(3, 1, 400), (None, 1 << 20, 1 << 20)])
def test_against_brute_force(spark, monkeypatch, buckets, cell, block):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    monkeypatch.setattr(alignment, "SUMMED", 2)
    rows = texts()
    found = alignment.aligned(docs(spark, rows).repartition(3), A, B, buckets=buckets, cell=cell)
    expected = brute(rows)
    assert result(found) == expected
    assert sum(1 for r in expected if not r[1]) > 3 and sum(1 for r in expected if r[5] < r[4]) > 20


def test_query_and_long_text(spark, tmp_path):
    rows = [*texts(4)[:30], (1, prose(4000, 1), "en", "a", 1), (1, prose(4000, 1), "en", "a", 1)]
    found = alignment.op12_alignment(spark, as_sf(docs(spark, rows), tmp_path))
    assert found.columns == ["doc_id", *alignment.SUMS, "groups_sha256"]
    got = {r[0]: r for r in found.collect()}
    assert got[1]["n_a"] == len(Tokenizer.from_file(A).encode(" " + prose(4000, 1)).ids)
    assert got[1]["n_b"] == len(sentencepiece.SentencePieceProcessor(model_file=B).encode(prose(4000, 1)))
    assert found.count() == len(rows)


def test_groups_are_the_hashed_texts(spark):
    rows = texts(7)[:40]
    shown = alignment.groups(docs(spark, rows), A, B).withColumn("h", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)))
    assert {r.doc_id: r.h for r in shown.collect()} == {r.doc_id: r.groups_sha256 for r in alignment.aligned(docs(spark, rows), A, B).collect()}


def test_pieces_are_cut_only_where_both_tokenizers_cut():
    aligner = alignment.Aligner(open(A).read(), open(B, "rb").read())
    assert aligner.cuts
    for row in texts(11):
        text = row[1] or ""
        pieces = aligner.pieces(text)
        assert " ".join(pieces) == text
        assert [i for p in pieces for i in aligner.a.encode(" " + p, add_special_tokens=False).ids] == aligner.a.encode(" " + text, add_special_tokens=False).ids
        if text and "▁" not in text:
            assert [i for p in pieces for i in aligner.b.encode(p)] == aligner.b.encode(text)


def test_byte_values():
    decoder = ByteLevel()
    assert all(decoder.decode([c]) == chr(b) for c, b in alignment.byte_values().items() if b < 128)
    assert alignment.byte_values() == unicode_bytes()


def test_empty_and_clashing(spark):
    assert alignment.aligned(docs(spark, []), A, B).collect() == []
    rows = [x for x in odd_rows() if len(x[1] or "") < 3000]
    more = docs(spark, rows).withColumns({"part": F.lit(1), "block": F.lit(2), "a.b": F.lit(3), "n_a": F.lit(None).cast("long")})
    assert result(alignment.aligned(more, A, B)) == brute(rows)
