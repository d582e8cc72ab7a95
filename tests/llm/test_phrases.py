import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import as_sf, docs, odd_rows, prose
from textloom.llm import phrases

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for r in rows:
        lang = "und" if r[2] is None else r[2]
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (r[1] or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in (1, 2, 3, 4):
                f[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, counts in f.items():
        wanted = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        hidden = {p[i : i + m] for p, a in wanted.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= 80 * counts[p[i : i + m]]}
        found = []
        for p, a in wanted.items():
            cuts = [(2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            if p not in hidden:
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def result(found):
    return sorted(tuple(r) for r in found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus(seed=1):
    """Few words, many marks and blanks, set phrases, three languages and none."""
    r = random.Random(seed)
    marks = [" ", " ", " ", " ", "  ", "\t", ", ", ".", "\n", " ; ", " ", "\r\n", "!? "]
    vocabulary = ["New", "york", "city", "the", "of", "é", "É", "日本", "x y", "a-b", "\U0001F600", "rare"] + [f"w{k}" for k in range(30)]
    rows = []
    for k in range(150):
        words = [r.choice(["new york city hall", "New York", "united states of america"]) if r.random() < 0.1 else r.choice(vocabulary) for _ in range(r.choice([0, 1, 5, 60]))]
        rows.append((k, "".join(w + r.choice(marks) for w in words), r.choice(["en", "en", "de", None, "und"]), "s", 1))
    return rows + odd_rows()


@pytest.mark.parametrize("least, top, block, size", [(3, 2000, 300, 20), (5, 7, 1 << 23, 1 << 20), (30, 2000, 2000, 500)])
def test_against_brute_force(spark, least, top, block, size):
    rows = corpus()
    found = phrases.collocations(docs(spark, rows).repartition(3), least=least, top=top, block_bytes=block, size=size)
    assert result(found) == brute(rows, least, top)


def test_query_and_sql(spark, tmp_path):
    rows = [(k, t, lang, s, n) for j in range(4) for k, t, lang, s, n in corpus(j)]
    sf = as_sf(docs(spark, rows), tmp_path)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet/*.parquet')")
    found = phrases.op11_phrases(spark, sf)
    assert dict(found.dtypes) | {"lang": "bigint", "phrase": "bigint"} == dict.fromkeys(found.columns, "bigint")
    got = result(found)
    assert got == sorted(db.execute(phrases.OP11_SQL).fetchall()) == brute(rows, 30, 2000)
    assert len(got) >= 10 and max(len(r[2].split()) for r in got) == 4


def test_scores_pass_64_bits(spark):
    """Counts of 10 ** 15: the product with the factor is beyond 64 bits."""
    big = 10**15 + 7
    grams = spark.createDataFrame([((1 << 32) + 2, 0, big)], "hi long, lo long, a long")
    words = spark.createDataFrame([(1, "en", "a", 3 * big), (2, "en", "b", big + 1)], "id long, lang string, word string, f long")
    row = phrases.scored(grams, words).first()
    assert (row.l, row.r, row.score) == (3 * big, big + 1, 2_000_000 * big // (4 * big + 1))


def test_radix_order():
    r = np.random.default_rng(1)
    hi, lo = r.integers(0, 9, 5000).astype(np.uint64) << np.uint64(40), r.integers(0, 1 << 63, 5000).astype(np.uint64)
    order = phrases.radix_order([hi, lo])
    assert (order == np.lexsort((lo, hi))).all()
    assert phrases.radix_order([hi[:0], lo[:0]]).tolist() == []
    assert phrases.radix_order([hi[:1], lo[:1]]).tolist() == [0]


def test_empty_long_and_clashing(spark):
    assert phrases.collocations(docs(spark, [])).collect() == []
    assert phrases.collocations(docs(spark, [(1, None, None, None, None), (2, " .,", "en", None, 1)])).collect() == []
    rows = [(1, prose(40_000, 3), "en", "a", 1)]
    more = docs(spark, rows).withColumns({"block": F.lit(1), "word": F.lit("x"), "a.b": F.lit(3), "part": F.lit(None).cast("long")})
    assert result(phrases.collocations(more, least=4)) == brute(rows, 4, 2000)
