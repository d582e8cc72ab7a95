"""Near duplicates by MinHash.

1. Every text's set of five-word shingles (64-bit hashes), its signature of universal hash minima and its band keys.
   Equal sets become one class, so a large group of copies costs one row from here on.
2. Classes that share a band key are candidates. In each bucket all are compared with one pivot, the least id; a
   candidate pair must agree in enough minima, then its full sets are rebuilt from the texts and compared exactly.
3. Components of the links, by alternating large-star and small-star.
4. Texts that candidates connect form a cluster. In a cluster of several components, those outside the largest are
   minor: blocks of minor members meet streams of all members, and every candidate pair of different components is
   put to the same tests there. Only links leave the task, so no link between candidates is lost and no pairs are
   written out.

At the threshold, bands of four minima of 128 miss a link with a probability of (1 - 0.75 ** 4) ** 32 = 5e-6, and
the least agreement (72 of 128) with one of 1e-6; both are for a single pair, and a document of a larger group has
many.

Defined results: texts without words have no set and are linked with nothing; a doc_id names one
document (repeated rows are fine; different texts under one id are linked through it); a row without doc_id may be linked, has the least doc_id of its component (or null), and is kept only if
that is null; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import dropped, quoted, released, slices, stored, table, unused
from textloom.llm.components import components, looked_up

SHINGLE, HASHES, BANDS = 5, 128, 32
#: A link: PARTS * intersection >= OF * union, in hundredths.
PARTS, OF = 100, 75
#: Least agreement of two sketches, of HASHES.
AGREE = 72
#: Members that are compared with one copy of a pivot; minor members of a block and members of a stream in step 4.
MEMBERS, MINORS, STREAM = 256, 128, 1024
#: Up to so many rows are looked up by broadcast (some 20 MB), more by shuffle.
BROADCAST_ROWS = 250_000
#: Node numbers of classes without a doc_id start here.
NAMELESS = 1 << 62

RANDOM = np.random.default_rng(20240229)
MULTIPLY = RANDOM.integers(0, 1 << 64, SHINGLE, np.uint64) | np.uint64(1)
A = RANDOM.integers(0, 1 << 32, HASHES, np.uint32) | np.uint32(1)
B = RANDOM.integers(0, 1 << 32, HASHES, np.uint32)
BAND = RANDOM.integers(0, 1 << 64, (HASHES // BANDS, BANDS), np.uint64) | np.uint64(1)
BAND_START = RANDOM.integers(0, 1 << 64, BANDS, np.uint64)


class WordHashes(dict):
    """Hashes of words, kept while there are few."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, known: WordHashes) -> np.ndarray:
    """The hashes of the shingles of a text, in order of the text, repeats included."""
    words = (text or "").encode().lower().split()
    h = np.array(list(map(known.__getitem__, words)), np.uint64)
    if not len(h):
        return h
    if len(h) < SHINGLE:
        return mixed((h * MULTIPLY[: len(h)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(h)))
    total = h[: len(h) - SHINGLE + 1] * MULTIPLY[0]
    for k in range(1, SHINGLE):
        total += h[k : len(h) - SHINGLE + 1 + k] * MULTIPLY[k]
    return mixed(total)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of HASHES minima for each set; none may be empty. Hashes are a * x + b modulo 2 ** 32, a odd."""
    out = np.empty((len(sets), HASHES), np.uint32)
    at = 0
    while at < len(sets):
        stop, n = at, 0
        while stop < len(sets) and (stop == at or n + len(sets[stop]) <= 1 << 16):
            n, stop = n + len(sets[stop]), stop + 1
        x = np.concatenate(sets[at:stop]).astype(np.uint32)
        starts = np.cumsum([0] + [len(s) for s in sets[at : stop - 1]])
        work = np.empty_like(x)
        for k in range(HASHES):
            np.multiply(x, A[k], out=work)
            np.add(work, B[k], out=work)
            out[at:stop, k] = np.minimum.reduceat(work, starts)
        at = stop
    return out


SIGNED = "doc_id long, ref long, n_shingles long, key string, bands array<long>, sketch binary"


def signed(it):
    known = WordHashes()
    for batch in slices(it):
        ids, texts, refs = batch.columns
        sets = [np.unique(shingles(t, known)) for t in texts.to_pylist()]
        full = [k for k, s in enumerate(sets) if len(s)]
        minima = signatures([sets[k] for k in full]) if full else np.empty((0, HASHES), np.uint32)
        grouped = minima.reshape(-1, BANDS, HASHES // BANDS).astype(np.uint64)
        bands = np.tile(BAND_START, (len(full), 1))
        for k in range(HASHES // BANDS):
            bands = mixed(bands + grouped[:, :, k] * BAND[k])
        keys, listed, sketches = [None] * len(sets), [None] * len(sets), [None] * len(sets)
        for row, k in enumerate(full):
            keys[k] = xxhash.xxh3_128_hexdigest(sets[k].tobytes())
            listed[k] = bands[row].view(np.int64)
            sketches[k] = minima[row].astype(np.uint8).tobytes()
        yield pa.RecordBatch.from_arrays(
            [ids, refs, pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.string()), pa.array(listed, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
            ["doc_id", "ref", "n_shingles", "key", "bands", "sketch"],
        )
    known.clear()
    released()


def agreement(a: bytes, b: bytes) -> int:
    return int(np.count_nonzero(np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets meet the threshold."""
    if PARTS * min(len(a), len(b)) < OF * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return PARTS * both >= OF * (len(a) + len(b) - both)


def confirmed(it):
    """Rows (pivot, part, member or null, text, sketch) with the pivot's own row first, to links (u, v)."""
    known, pivot, own, sketch = WordHashes(), None, None, b""
    for batch in slices(it, 256, 4 << 20):
        us, vs = [], []
        for number, member, text, mark in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4))):
            if member is None:
                pivot, own, sketch = number, np.unique(shingles(text, known)), mark
            elif number == pivot and agreement(sketch, mark) >= AGREE and linked(own, np.unique(shingles(text, known))):
                us.append(member)
                vs.append(number)
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])


def verified(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The (pivot, member) ``pairs`` that are links. A pivot of many members is copied for every MEMBERS of them, so
    no task holds more than a stream of texts beside one pivot."""
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts"))
    texts = classes.select("node", "text", "sketch")
    own = counts.join(texts, F.col("pivot") == F.col("node")).select("pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("member"), "text", "sketch")
    split = looked_up(pairs, counts, "pivot", "member").withColumn("part", F.pmod(F.xxhash64("member"), F.col("parts")).cast("int"))
    rest = split.join(texts, F.col("member") == F.col("node")).select("pivot", "part", "member", "text", "sketch")
    rows = own.union(rest).repartition(n, "pivot", "part").sortWithinPartitions("pivot", "part", F.col("member").asc_nulls_first())
    return rows.mapInArrow(confirmed, "u long, v long")


CROSS = "cluster long, block int, stream int, minor boolean, node long, root long, n long, sketch binary, bands array<long>, text string"


def crossing(it):
    """Rows of CROSS, a block's minor members before its stream, to links between different components."""
    known, at, minors = WordHashes(), None, []
    sets = marks = bands = roots = nodes = sizes = None
    for batch in slices(it, 128, 4 << 20):
        us, vs = [], []
        for cluster, block, stream, minor, node, root, n, sketch, keys, text in zip(*(c.to_pylist() for c in batch.columns)):
            if at != (cluster, block, stream):
                at, minors, sets = (cluster, block, stream), [], None
            if minor:
                minors.append((node, root, n, sketch, keys, text))
                continue
            if sets is None:
                sets = [np.unique(shingles(m[5], known)) for m in minors]
                nodes, roots, sizes = (np.array([m[k] for m in minors], np.int64) for k in range(3))
                marks = np.frombuffer(b"".join(m[3] for m in minors), np.uint8).reshape(-1, HASHES)
                bands = np.array([m[4] for m in minors], np.int64).reshape(-1, BANDS)
            fits = (roots != root) & (PARTS * np.minimum(sizes, n) >= OF * np.maximum(sizes, n))
            if fits.any():
                fits &= (bands == np.array(keys, np.int64)).any(axis=1)
            if fits.any():
                fits &= (marks == np.frombuffer(sketch, np.uint8)).sum(axis=1) >= AGREE
            if fits.any():
                own = np.unique(shingles(text, known))
                for k in np.flatnonzero(fits):
                    if linked(sets[k], own):
                        us.append(max(node, int(nodes[k])))
                        vs.append(min(node, int(nodes[k])))
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])


def labelled(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``nodes`` (with node) and the root of their component."""
    found = roots.select(F.col("u").alias("of"), F.col("v").alias("root"))
    return nodes.join(found, F.col("node") == F.col("of"), "left").withColumn("root", F.coalesce("root", "node")).drop("of")


def cross_links(stars: DataFrame, roots: DataFrame, candidates: DataFrame) -> DataFrame:
    """Links between members of a cluster that are in different components so far."""
    n = int(stars.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    clusters = components(stars).select(F.col("u").alias("in"), F.col("v").alias("cluster"))
    rows = labelled(candidates, roots).join(clusters, F.col("node") == F.col("in"), "left").withColumn("cluster", F.coalesce("cluster", "node")).drop("in")
    rows = stored(rows, "clustered")
    counts = rows.groupBy("cluster", "root").agg(F.count("*").alias("n_root")).groupBy("cluster").agg(F.sum("n_root").alias("n_all"), F.max(F.struct("n_root", "root")).alias("major"), F.count("*").alias("n_roots"))
    several = counts.filter("n_roots > 1 AND n_all > 2").select("cluster", F.col("major.root").alias("major"), F.ceil((F.col("n_all") - F.col("major.n_root")) / MINORS).cast("int").alias("blocks"), F.ceil(F.col("n_all") / STREAM).cast("int").alias("streams"))
    found = looked_up(rows, several, "cluster", "node")
    deal = lambda many, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(many)).cast("int")
    each = lambda many: F.explode(F.sequence(F.lit(0), F.col(many) - 1))
    columns = ["node", "root", F.col("n_shingles").alias("n"), "sketch", "bands", "text"]
    minor = found.filter("root <> major").withColumns({"block": deal("blocks", 1), "stream": each("streams")}).select("cluster", "block", "stream", F.lit(True).alias("minor"), *columns)
    every = found.withColumns({"stream": deal("streams", 2), "block": each("blocks")}).select("cluster", "block", "stream", F.lit(False).alias("minor"), *columns)
    met = minor.union(every).repartition(n, "cluster", "block", "stream").sortWithinPartitions("cluster", "block", "stream", F.desc("minor"))
    return met.mapInArrow(crossing, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``, and ref, a hash of its id and text."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("ref", F.xxhash64("doc_id", "text"))
    rows = stored(source.mapInArrow(signed, SIGNED), "signed")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "ref", "n_shingles", "bands", "sketch")).alias("one")
    nameless = F.shiftrightunsigned(F.xxhash64("key"), 3).bitwiseOR(F.lit(NAMELESS))
    classes = rows.filter("key IS NOT NULL").groupBy("key").agg(one).select("key", F.coalesce("one.doc_id", nameless).alias("node"), F.col("one.doc_id").alias("id"), "one.ref", "one.n_shingles", "one.bands", "one.sketch")
    classes = stored(classes, "classes")

    bands = classes.select(F.explode("bands").alias("bucket"), "node")
    sizes = bands.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count("*").alias("n_members")).filter("n_members > 1").select("bucket", "pivot")
    stars = bands.join(sizes.hint("shuffle_hash"), "bucket").filter("node <> pivot").select("pivot", F.col("node").alias("member")).distinct()
    stars = stored(stars, "stars")
    ends = stars.select(F.explode(F.array("pivot", "member")).alias("of")).distinct()
    wanted = stored(classes.join(ends, F.col("node") == F.col("of"), "left_semi").select(F.col("ref").alias("at"), "id", "node", "n_shingles", "bands", "sketch"), "wanted")
    refs = wanted.select("at", "id", "node")
    side = F.broadcast(refs) if wanted.count() <= BROADCAST_ROWS else refs.hint("shuffle_hash")
    texts = source.join(side, (F.col("ref") == F.col("at")) & F.col("doc_id").eqNullSafe(F.col("id"))).select(F.col("node").alias("of"), "text").dropDuplicates(["of"])
    candidates = stored(wanted.join(texts, F.col("node") == F.col("of")).drop("of", "at", "id"), "candidates")

    first = stored(verified(stars, candidates), "links")
    roots = components(first)
    more = stored(cross_links(stars.select(F.col("member").alias("u"), F.col("pivot").alias("v")), roots, candidates), "links")
    if not more.isEmpty():
        roots = components(roots.union(more))
    for done in (stars, wanted, candidates, first, more):
        dropped(done)
    found = labelled(classes.select("key", "node"), roots).select(F.col("key").alias("of"), F.when(F.col("root") < NAMELESS, F.col("root")).alias("root"))
    out = rows.select("doc_id", "n_shingles", "key", "ref").join(found, F.col("key") == F.col("of"), "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("root")).alias("component_id"), "ref")
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "ref")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one of each group, and repeated rows once. Columns may have any names."""
    found = near_duplicates(docs, id_col, text_col).filter("kept").groupBy("doc_id", "ref").agg(F.count("*").alias("times"))
    kept = stored(found, "kept")
    n, most = kept.agg(F.count("*"), F.max("times")).first()
    ref, ident = unused("ref", docs.columns), unused("ident", docs.columns)
    refs = kept.select(F.col("ref").alias("tl_ref"), F.col("doc_id").alias("tl_id"))
    side = F.broadcast(refs) if n <= BROADCAST_ROWS else refs.hint("shuffle_hash")
    named = docs.select(*map(quoted, docs.columns), quoted(id_col).cast("long").alias(ident), F.xxhash64(quoted(id_col).cast("long"), quoted(text_col)).alias(ref))
    side = side.toDF(unused("tl_ref", docs.columns), unused("tl_id", docs.columns))
    rows = named.join(side, (named[ref] == side[side.columns[0]]) & named[ident].eqNullSafe(side[side.columns[1]]), "left_semi")
    return (rows.dropDuplicates([ref, ident]) if (most or 1) > 1 else rows).select(*map(quoted, docs.columns))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("ref")
