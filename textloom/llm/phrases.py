"""Phrases (collocations) of two to four words, by language.

1. Texts are cut into pieces and words by Arrow batches; a block holds the words of some documents of one language as
   numbers, beside its own list of words and their counts.
2. The counts are summed by language and word. Words that occur LEAST times get a number of 32 bits; the blocks' lists
   are joined with them, and each block is written again in these numbers, with 0 wherever a piece ends or a rarer word
   stands. No phrase that is wanted goes across a 0.
3. Phrases are packed into fixed-width keys of two 64-bit halves, four words of 32 bits, 0 beyond the end. A block's
   keys are sorted by radix and run-length counted, then cut by range; the bounds of the ranges come from the keys of
   at most SAMPLED blocks and bear on balance alone. A range sorts and counts what all blocks sent. A key comes once
   from each block, so no frequent phrase is hot.
4. That happens twice. First for two words: the range answers every block with a bit for each key that it sent, set if
   LEAST is reached. Then for three and four words, where all pairs of neighbours in them have that bit.
5. Parts of the phrases (for the cuts), longer phrases around them and the words behind the numbers are joined by
   salted keys, as a frequent word is part of many phrases. The first TOP of a language are found by salt, then whole.

Defined results: a null or empty text has no words; a null language is ``und``, one with that code among them; repeated
rows count each; ties are broken by the phrase's UTF-8 bytes; an empty table gives an empty one; columns of any name
may stand beside these.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.bpe import packed, unpacked
from textloom.llm.common import dropped, quoted, released, slices, stored, table
from textloom.llm.components import SALTS, looked_up

#: Least occurrences of a phrase; words of the longest; share (in hundredths) at which a longer phrase hides one in it;
#: phrases a language; factor of the score.
LEAST, LONGEST, HIDES, TOP, FACTOR = 30, 4, 80, 2000, 2_000_000
#: Text bytes of a block, and of all blocks that a task holds.
BLOCK_BYTES, TASK_BYTES = 8 << 20, 32 << 20
#: Blocks that the bounds of ranges come from and keys from each; keys of a range; least number of ranges.
SAMPLED, DRAWN, RANGE, RANGES = 32, 4096, 1 << 20, 64
#: Characters at which texts are cut into pieces, and the break and the blank that stand for them (fixed values).
CUTS = b".,;:!?\n\v\f\r"
TO_BREAKS = bytes.maketrans(CUTS + b"\t", b"\n" * len(CUTS) + b" ")
BLOCKS = "block long, lang string, n_words long, codes binary, words array<string>, counts array<long>"
KEYS = "range int, block long, n long, data binary"
FOUND = "kind int, block long, range int, bits binary, hi long, lo long, a long"


class Numbers(dict):
    """Numbers of words from 1 on; a break is 0 and the gap between two blanks -1."""

    def __init__(self):
        super().__init__({b"\n": 0, b"": -1})

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self) - 1
        return found


def parsed(block_bytes: int):
    """Texts to rows of BLOCKS."""

    def row(block, lang, numbers, codes):
        flat = np.concatenate(codes)
        counts = np.bincount(flat, minlength=len(numbers) - 1)[1:]
        words = list(numbers)[2:]
        listed = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        return pa.RecordBatch.from_arrays(
            [pa.array([block]), pa.array([lang], pa.string()), pa.array([int(counts.sum())]), pa.array([packed(flat)], pa.binary()), listed(pa.array(words, pa.binary()).cast(pa.string())), listed(pa.array(counts, pa.int64()))],
            ["block", "lang", "n_words", "codes", "words", "counts"],
        )

    def run(it):
        held, sizes, done = {}, {}, 0

        def flush(langs, part):
            nonlocal done
            for lang in langs:
                done += 1
                yield row(xxhash.xxh64_intdigest(f"{part}:{done}") >> 1, lang, *held.pop(lang))
                del sizes[lang]

        part = None
        for batch in slices(it, 512, 2 << 20):
            part = batch.column(2)[0].as_py()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = (text or "").encode().lower().translate(TO_BREAKS)
                numbers, codes = held.setdefault(lang, (Numbers(), []))
                parts = raw.replace(b"\n", b" \n ").split(b" ")
                found = np.fromiter(map(numbers.__getitem__, parts), np.int64, len(parts))
                codes.append(np.append(found[found >= 0], 0).astype(np.uint32))
                sizes[lang] = sizes.get(lang, 0) + len(raw)
            full = [k for k, n in sizes.items() if n >= block_bytes]
            yield from flush(full if sum(sizes.values()) < TASK_BYTES else list(sizes), part)
        yield from flush(list(sizes), part)
        released()

    return run


def dictionary(blocks: DataFrame, least: int) -> DataFrame:
    """id (from 1 on, without gaps), lang, word and f of the words that occur ``least`` times."""
    each = blocks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w"))
    counts = each.groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("f")).filter(F.col("f") >= least)
    rows = stored(counts.select("*", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("k")), "words")
    sizes = dict(rows.groupBy("p").agg(F.max("k") + 1).collect())  # a row for each shuffle partition
    starts, at = [(0, 1)][: not sizes], 1
    for p in sorted(sizes):
        starts.append((p, at))
        at += sizes[p]
    if at > 1 << 31:
        raise ValueError("more frequent words than fixed-width keys can name")
    offsets = F.broadcast(rows.sparkSession.createDataFrame(starts, "p int, start long"))
    return rows.join(offsets, "p").select((F.col("k") + F.col("start")).alias("id"), "lang", "word", "f")


def renumbered(it):
    """Rows (block, codes, pairs of a word's number in the block and its id) to (block, ids)."""
    for batch in slices(it, 4, 8 << 20, "codes"):
        blocks, codes, pairs = batch.columns
        out = []
        for data, some in zip(codes.to_pylist(), pairs):
            flat = unpacked(data)
            ids = np.zeros(int(flat.max(initial=0)) + 1, np.uint32)
            if some.values is not None:
                ids[some.values.field("pos").to_numpy() + 1] = some.values.field("id").to_numpy()
            out.append(packed(ids[flat]))
        yield pa.RecordBatch.from_arrays([blocks, pa.array(out, pa.binary())], ["block", "ids"])
    released()


def coded(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """The ``blocks`` as (block, ids): ids of frequent words, 0 for anything else."""
    each = blocks.select("block", "lang", F.posexplode("words").alias("pos", "word"))
    known = each.join(words.select("lang", "word", "id"), ["lang", "word"]).groupBy("block").agg(F.collect_list(F.struct("pos", "id")).alias("pairs"))
    return blocks.select("block", "codes").join(known, "block").mapInArrow(renumbered, "block long, ids binary")


def radix_order(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows by 64-bit ``columns``, the first the highest: a stable pass for every 16 bits that differ.
    (numpy sorts 16-bit integers by radix.)"""
    order = None
    for column in reversed(columns):
        for shift in (0, 16, 32, 48):
            digit = (column >> np.uint64(shift)).astype(np.uint16)
            if len(digit) and (digit == digit[0]).all():
                continue
            order = np.argsort(digit, kind="stable") if order is None else order[np.argsort(digit[order], kind="stable")]
    return np.arange(len(columns[0])) if order is None else order


def run_lengths(columns: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, their counts, and the order and starts that they come from."""
    order = radix_order(columns)
    columns = [c[order] for c in columns]
    n = len(order)
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    starts = np.flatnonzero(new)
    totals = np.diff(np.append(starts, n)) if counts is None else np.add.reduceat(counts[order], starts) if n else np.empty(0, np.int64)
    return [c[starts] for c in columns], totals, order, starts


def halves(ids: np.ndarray, k: int, m: int) -> list[np.ndarray]:
    """The keys' halves of the phrases of ``m`` words; ``ids`` are 64-bit, ``k`` their first words' places."""
    none = np.uint64(0)
    word = lambda j: ids[k + j] if j < m else none
    return [word(0) << np.uint64(32) | word(1), (word(2) << np.uint64(32) | word(3)) + np.zeros(len(k), np.uint64)]


def pairs_of(ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Where two frequent words stand together, and the run lengths of these pairs."""
    places = np.flatnonzero((ids[:-1] != 0) & (ids[1:] != 0))
    return places, *run_lengths(halves(ids, places, 2))


def longer_of(ids: np.ndarray, flags: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """Keys and counts of the phrases of three and more words whose pairs all have their flag set."""
    places, keys, _, order, starts = pairs_of(ids)
    bits = np.concatenate([np.empty(0, bool), *(np.unpackbits(np.frombuffer(f[8:], np.uint8), count=int.from_bytes(f[:8], "little")).astype(bool) for f in flags)])
    if len(bits) != len(keys[0]):
        raise RuntimeError("a block's pairs and its answers differ")
    number = np.zeros(len(places), np.int64)
    number[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
    frequent = np.zeros(len(ids) + LONGEST, bool)
    frequent[places] = bits[number] if len(places) else False
    found, run = [[], []], frequent
    for m in range(3, LONGEST + 1):
        run = run & np.append(frequent[m - 2 :], np.zeros(m - 2, bool))
        for side, half in zip(found, halves(ids, np.flatnonzero(run), m)):
            side.append(half)
    keys, counts, _, _ = run_lengths([np.concatenate(side) for side in found])
    return keys, counts


def keys_of(batch_row, level: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Keys and counts of a block for the pairs (level 2) or the longer phrases (3)."""
    ids = unpacked(batch_row["ids"]).astype(np.uint64)
    if level == 2:
        _, keys, counts, _, _ = pairs_of(ids)
        return keys, counts
    return longer_of(ids, [f["bits"] for f in sorted(batch_row["flags"] or [], key=lambda f: f["range"])])


def by_block(it):
    for batch in slices(it, 4, 8 << 20, "ids"):
        yield from batch.to_pylist()


def drawn(level: int):
    """Of each block the number of keys and some of them, evenly placed."""

    def run(it):
        for row in by_block(it):
            keys, _ = keys_of(row, level)
            n = len(keys[0])
            some = np.linspace(0, n - 1, min(n, DRAWN)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([n]), *(pa.array([k[some].tobytes()], pa.binary()) for k in keys)], ["n", "hi", "lo"])

    return run


def bounds(blocks: DataFrame, level: int, size: int) -> list[np.ndarray]:
    """The first keys of the second and further ranges, from at most some SAMPLED blocks."""
    count = blocks.count()
    some = blocks.filter(F.pmod(F.xxhash64("block"), F.lit(max(1, count // SAMPLED))) == 0)
    rows = some.mapInArrow(drawn(level), "n long, hi binary, lo binary").collect()
    keys = [np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(r[c], np.uint64) for r in rows)]) for c in (1, 2)]
    weights = np.concatenate([np.empty(0), *(np.full(len(r.hi) // 8, r.n / max(1, len(r.hi) // 8)) for r in rows)])
    order = radix_order(keys)
    total = weights.sum() * count / max(1, len(rows))
    ranges = max(RANGES, int(total // size))
    reach = np.cumsum(weights[order])
    cuts = np.searchsorted(reach, reach[-1] * np.arange(1, ranges) / ranges) if len(reach) else np.empty(0, np.int64)
    found = np.unique(np.stack([k[order][cuts] for k in keys], axis=1), axis=0)
    return [found[:, 0], found[:, 1]]


def place(keys: list[np.ndarray], cuts: list[np.ndarray]) -> np.ndarray:
    """Where in sorted ``keys`` each range begins."""
    lows, highs = np.searchsorted(keys[0], cuts[0], "left"), np.searchsorted(keys[0], cuts[0], "right")
    return np.array([a + np.searchsorted(keys[1][a:b], c) for a, b, c in zip(lows.tolist(), highs.tolist(), cuts[1])], np.int64)


def dealt(level: int, cuts: list[np.ndarray]):
    """Blocks to rows of KEYS, a row for each range, even an empty one, which is answered too."""

    def run(it):
        for row in by_block(it):
            keys, counts = keys_of(row, level)
            ends = [0, *place(keys, cuts).tolist(), len(counts)]
            ranges = range(len(ends) - 1)
            some = [k for k in ranges if ends[k + 1] > ends[k]]
            data = [framed([packed32(half[ends[k] : ends[k + 1]]) for half in keys[: level - 1]] + [packed(counts[ends[k] : ends[k + 1]])]) for k in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([row["block"]] * len(some), pa.int64()), pa.array([ends[k + 1] - ends[k] for k in some], pa.int64()), pa.array(data, pa.binary())], ["range", "block", "n", "data"])
        released()

    return run


def packed32(half: np.ndarray) -> bytes:
    """Sorted 64-bit halves of keys as two words each."""
    first, second = half >> np.uint64(32), half & np.uint64(0xFFFFFFFF)
    return framed([packed(first), packed(second)])


def unpacked32(data: bytes) -> np.ndarray:
    first, second = unframed(data)
    return unpacked(first).astype(np.uint64) << np.uint64(32) | unpacked(second).astype(np.uint64)


def framed(parts: list[bytes]) -> bytes:
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def unframed(data: bytes) -> list[bytes]:
    out, k = [], 0
    while k < len(data):
        n = int.from_bytes(data[k : k + 4], "little")
        out.append(data[k + 4 : k + 4 + n])
        k += 4 + n
    return out


def tallied(level: int, least: int):
    """Rows of KEYS, in order of range, to the phrases that occur ``least`` times (kind 0), and for pairs the answers to
    the blocks (kind 1): a bit for each key."""

    def flush(number, blocks, sent):
        halves_of = [[unpacked32(x) for x in some[: level - 1]] for some in sent]
        counts = [unpacked(some[-1]).astype(np.int64) for some in sent]
        sizes = [len(c) for c in counts]
        keys = [np.concatenate(x) for x in zip(*halves_of)]
        keys += [np.zeros(len(keys[0]), np.uint64)] * (level == 2)
        found, totals, order, starts = run_lengths(keys, np.concatenate(counts))
        frequent = totals >= least
        n, rows = int(frequent.sum()), [k[frequent].view(np.int64) for k in found]
        none = lambda n, kind: pa.nulls(n, kind)
        names = ["kind", "block", "range", "bits", "hi", "lo", "a"]
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n), pa.int32()), none(n, pa.int64()), pa.array(np.full(n, number), pa.int32()), none(n, pa.binary()), *map(pa.array, rows), pa.array(totals[frequent], pa.int64())], names)
        if level == 2:
            flags = np.zeros(len(order), bool)
            flags[order] = np.repeat(frequent, np.diff(np.append(starts, len(order))))
            ends = np.cumsum(sizes).tolist()
            bits = [size.to_bytes(8, "little") + np.packbits(flags[end - size : end]).tobytes() for size, end in zip(sizes, ends)]
            k = len(blocks)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(k), pa.int32()), pa.array(blocks, pa.int64()), pa.array(np.full(k, number), pa.int32()), pa.array(bits, pa.binary()), *(none(k, pa.int64()) for _ in range(3))], names)

    def run(it):
        at, blocks, sent = None, [], []
        for batch in slices(it, 512, 8 << 20, "data"):
            for number, block, _, data in zip(*(c.to_pylist() for c in batch.columns)):
                if number != at and blocks:
                    yield from flush(at, blocks, sent)
                    blocks, sent = [], []
                at = number
                blocks.append(block)
                sent.append(unframed(data))
        if blocks:
            yield from flush(at, blocks, sent)
        released()

    return run


def counted(blocks: DataFrame, level: int, least: int, size: int) -> DataFrame:
    """FOUND for the phrases of ``blocks`` (block, ids and, for level 3, flags)."""
    n = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = blocks.mapInArrow(dealt(level, bounds(blocks, level, size)), KEYS)
    return stored(rows.repartition(n, "range").sortWithinPartitions("range").mapInArrow(tallied(level, least), FOUND), "phrases")


def word_at(j: int) -> Column:
    """The id of the word number ``j`` (from 0) of a phrase, 0 beyond its end."""
    half = F.col("hi" if j < 2 else "lo")
    return F.shiftrightunsigned(half, 32) if j % 2 == 0 else half.bitwiseAND(F.lit(0xFFFFFFFF))


def part(first: int, stop: int) -> Column:
    """The key of the words ``first`` to ``stop`` - 1 of a phrase."""
    word = lambda j: word_at(first + j) if first + j < stop else F.lit(0).cast("long")
    return F.struct(F.shiftleft(word(0), 32).bitwiseOR(word(1)).alias("hi"), F.shiftleft(word(2), 32).bitwiseOR(word(3)).alias("lo"))


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """``phrases`` (hi, lo, a) with l, r and score of their lowest cut; those that a longer one hides are gone."""
    length = F.lit(2) + (word_at(2) > 0).cast("int") + (word_at(3) > 0).cast("int")
    rows = phrases.select("hi", "lo", "a", length.alias("m"), F.struct("hi", "lo").alias("phrase"))
    values = phrases.select(F.struct("hi", "lo").alias("part"), F.col("a").alias("f")).union(words.select(F.struct(F.shiftleft("id", 32).alias("hi"), F.lit(0).cast("long").alias("lo")), "f"))
    sides = [F.when(F.col("m") == m, F.array(*(F.struct(F.lit(k).alias("k"), F.lit(s).alias("side"), x.alias("part")) for k in range(1, m) for s, x in ((0, part(0, k)), (1, part(k, m)))))) for m in range(2, LONGEST + 1)]
    each = rows.select("phrase", "a", F.explode(F.coalesce(*sides)).alias("c")).select("phrase", "a", "c.*")
    found = looked_up(each, values, "part", "phrase")
    of = lambda k, s: F.max(F.when((F.col("k") == k) & (F.col("side") == s), F.col("f")))
    cuts = range(1, LONGEST)
    wide = found.groupBy("phrase", "a").agg(*(of(k, 0).alias(f"l{k}") for k in cuts), *(of(k, 1).alias(f"r{k}") for k in cuts))
    score = lambda k: F.expr(f"CAST({FACTOR} AS DECIMAL(18,0)) * CAST(a AS DECIMAL(19,0)) DIV CAST(l{k} + r{k} AS DECIMAL(19,0))")
    best = F.array_min(F.array(*(F.when(F.col(f"l{k}").isNotNull(), F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in cuts)))
    inner = [F.when(F.col("m") == m, F.array(*(part(i, i + n) for n in range(2, m) for i in range(m - n + 1)))) for m in range(3, LONGEST + 1)]
    around = rows.filter("m > 2").select(F.explode(F.coalesce(*inner)).alias("inner"), "a").groupBy("inner").agg(F.max("a").alias("longest"))
    out = wide.select("phrase", "a", best.alias("b")).join(around, F.col("phrase") == F.col("inner"), "left")
    return out.filter(F.col("longest").isNull() | (F.col("longest") * 100 < F.col("a") * HIDES)).select("phrase", "a", "b.l", "b.r", "b.score")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, top: int = TOP, block_bytes: int = BLOCK_BYTES, size: int = RANGE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the first ``top`` phrases of each language."""
    source = docs.select(F.coalesce(quoted(lang_col), F.lit("und")).alias("lang"), quoted(text_col).alias("text"), F.spark_partition_id().alias("part"))
    blocks = stored(source.mapInArrow(parsed(block_bytes), BLOCKS), "blocks")
    words = stored(dictionary(blocks, least), "dictionary")
    ids = stored(coded(blocks, words), "coded")
    pairs = counted(ids, 2, least, size)
    flags = pairs.filter("kind = 1").groupBy("block").agg(F.collect_list(F.struct("range", "bits")).alias("flags"))
    flagged = stored(ids.join(flags, "block", "left"), "flagged")
    dropped(ids)
    more = counted(flagged, 3, least, size)
    dropped(flagged)
    phrases = pairs.filter("kind = 0").union(more.filter("kind = 0")).select("hi", "lo", "a")

    result = stored(scored(phrases, words), "scored")
    dropped(pairs)
    dropped(more)
    rows = result.withColumns({"hi": F.col("phrase.hi"), "lo": F.col("phrase.lo")})
    listed = rows.select("phrase", "a", "l", "r", "score", F.posexplode(F.array(*map(word_at, range(LONGEST)))).alias("at", "id")).filter("id > 0")
    named = looked_up(listed, words.select("id", "lang", "word"), "id", "phrase")
    spelt = named.groupBy("phrase", "a", "l", "r", "score", "lang").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ").alias("spelt"))
    order = [F.desc("score"), F.desc("a"), "spelt"]
    first = spelt.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    totals = blocks.groupBy("lang").agg(F.sum("n_words").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", F.col("spelt").alias("phrase"), "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents")).withColumn("rank", F.col("rank").cast("long"))


OP11_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
  FROM documents),
words AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (
  SELECT lang, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase
  FROM places, (SELECT unnest(range(1, {LONGEST + 1})) AS m) WHERE i + m - 1 <= len(w)),
f AS (SELECT lang, m, phrase, count(*) AS a FROM grams GROUP BY lang, m, phrase HAVING count(*) >= {LEAST}),
candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, (CAST({FACTOR} AS HUGEINT) * c.a) // (x.a + y.a) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(list_slice(c.w, 1, k), ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(list_slice(c.w, k + 1, c.m), ' ')),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM cuts),
starts AS (SELECT *, unnest(range(1, m + 1)) AS i FROM candidates),
inner_parts AS (
  SELECT lang, a, array_to_string(list_slice(w, i, i + n - 1), ' ') AS phrase
  FROM starts, (SELECT unnest(range(2, {LONGEST})) AS n) WHERE n < m AND i + n - 1 <= m),
around AS (SELECT lang, phrase, max(a) AS longest FROM inner_parts GROUP BY lang, phrase),
ranked AS (
  SELECT c.*, row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, a DESC, c.phrase) AS rank
  FROM lowest c LEFT JOIN around x ON x.lang = c.lang AND x.phrase = c.phrase
  WHERE place = 1 AND (longest IS NULL OR 100 * longest < {HIDES} * a))
SELECT r.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked r JOIN totals t ON t.lang = r.lang WHERE rank <= {TOP}
"""
