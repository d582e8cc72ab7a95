"""Near duplicates by SimHash fingerprints, found through the anchors of a covering code.

1. Every text's fingerprint: of its four-word shingles, repeats included, each of the 64 bits that is set in more than
   half of the XXH64 hashes. Equal fingerprints become one node, so a group of copies costs one row from here on.
2. Anchors are the words of a covering code. Inside, bits vote in threes (and some alone); outside, every 23 votes are
   a word of the perfect Golay code, whose covering radius is 3. So each fingerprint has one home, the anchor that its
   votes decode to, and an anchor is within covering radius plus threshold of it if LIMIT flipped bits can bring the
   votes to within 3 of the anchor's. A fingerprint is copied to all of those, its home included: if two fingerprints
   differ in LIMIT bits at most, the home of either has a copy of the other.
3. At each anchor the fingerprints at home there are compared with the copies. Of the links a task finds at an anchor
   only a spanning forest leaves it, so a large group of near copies makes no more links than it has members.
4. Components of the links, by alternating large-star and small-star; the least doc_id of each.

One Golay word (4096 anchors, some 185 copies) serves up to LARGE fingerprints, two (16.8 million anchors, some 1235 copies) serve more;
both find every link. Anchors are dealt into groups of some 65,000 fingerprints; a group of more is dealt into parts of
its copies and blocks of its homes that meet in a cell of bounded size.

Defined results: a text that is null, empty or without words has fingerprint zero, linked like any other; a doc_id names
one row or more (repeated rows are fine); a row without doc_id is linked but gives no name, so a component of such rows
alone has a null component_id; an empty table gives an empty one; columns of any name may stand beside these.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import dropped, quoted, released, slices, stored, table
from textloom.llm.components import components, looked_up

SHINGLE, SEED, LIMIT = 4, 42, 4
#: The Golay code: length, covering radius, bits of a word's number, and generator polynomial (fixed values).
LENGTH, RADIUS, WORD_BITS, GENERATOR = 23, 3, 12, 0b110001110101
#: Fingerprints from which two code words make an anchor instead of one.
LARGE = 1 << 23
#: Fingerprints of a group of anchors, on average, and the least number of groups.
GROUP, GROUPS = 1 << 16, 256
#: Fingerprints that are copied together; homes and copies that meet in a cell; cells of a comparison at once.
BATCH, HOMES, COPIES, AT_ONCE = 1 << 12, 1 << 17, 1 << 21, 1 << 20
SIGNED = "doc_id long, at long, fp long"
COPIED = "anchors int, kind int, n int, place long, number binary, fps binary"


def shingle_hashes(text: str | None) -> np.ndarray:
    """The hashes of a text's shingles in order, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    whole, sizes = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes + 1) - sizes - 1
    reach = min(SHINGLE, len(words)) - 1
    stops = (starts + sizes)[reach:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(whole[a:b], SEED) for a, b in zip(starts.tolist(), stops.tolist())), np.uint64, len(stops))


def bits(numbers: np.ndarray) -> np.ndarray:
    """A row of 64 bits, the lowest first, for each 64-bit number."""
    return np.unpackbits(np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def counted(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit set; a long text is counted in pieces."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 15):
        total += bits(hashes[k : k + (1 << 15)]).sum(axis=0, dtype=np.int64)
    return total


def majority(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def signed(it):
    done = 0
    for batch in slices(it, 256, 2 << 20):
        ids, texts = batch.columns
        hashes = [shingle_hashes(t) for t in texts.to_pylist()]
        sizes = np.array([len(h) for h in hashes])
        counts = np.zeros((len(hashes), 64), np.int64)
        if sizes.sum() <= 1 << 17:
            full = np.flatnonzero(sizes)
            if len(full):
                counts[full] = np.add.reduceat(bits(np.concatenate([hashes[k] for k in full])), np.cumsum(sizes[full]) - sizes[full], axis=0, dtype=np.int64)
        else:
            for k, h in enumerate(hashes):
                counts[k] = counted(h)
        fps = majority(counts, sizes)
        yield pa.RecordBatch.from_arrays([ids, pa.array(np.arange(done, done + len(fps))), pa.array(fps.view(np.int64))], ["doc_id", "at", "fp"])
        done += len(fps)
    released()


@functools.lru_cache(maxsize=1)
def golay():
    """Syndromes of the low and high halves of a 23-bit word; for each syndrome the error patterns to the code words
    within RADIUS + LIMIT, padded, the home's first; and their weights (99 for padding)."""
    words = np.zeros(1, np.uint32)
    for k in range(WORD_BITS):
        words = np.concatenate([words, words ^ np.uint32(GENERATOR << k)])
    left = LENGTH - WORD_BITS

    def remainder(x: int) -> int:
        for k in range(LENGTH - 1, left - 1, -1):
            if x >> k & 1:
                x ^= GENERATOR << (k - left)
        return x

    unit = [remainder(1 << k) for k in range(LENGTH)]
    tables = []
    for low, high in ((0, WORD_BITS), (WORD_BITS, LENGTH)):
        found = np.zeros(1, np.uint32)
        for k in range(low, high):
            found = np.concatenate([found, found ^ np.uint32(unit[k])])
        tables.append(found)
    # the syndrome of a number below 2 ** 11 is itself, so it is a member of its own coset
    errors = []
    for syndrome in range(1 << left):
        coset = words ^ np.uint32(syndrome)
        weights = np.bitwise_count(coset)
        near = coset[weights <= RADIUS + LIMIT]
        errors.append(near[np.argsort(np.bitwise_count(near), kind="stable")])
    wide = max(map(len, errors))
    patterns = np.zeros((len(errors), wide), np.uint32)
    weights = np.full((len(errors), wide), 99, np.int8)
    for k, some in enumerate(errors):
        patterns[k, : len(some)] = some
        weights[k, : len(some)] = np.bitwise_count(some)
    return *tables, patterns, weights


def votes(fps: np.ndarray, blocks: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The 23-bit words that the bits vote for, and for each the mask of votes that one flipped bit turns."""
    n, threes = LENGTH * blocks, (64 - LENGTH * blocks) // 2
    own = bits(fps)
    sums = own[:, : 3 * threes].reshape(-1, threes, 3).sum(axis=2)
    single = own[:, 3 * threes : 3 * threes + n - threes]
    vote = np.concatenate([sums >= 2, single == 1], axis=1)
    loose = np.concatenate([(sums == 1) | (sums == 2), np.ones_like(single, bool)], axis=1)
    scale = np.uint32(1) << np.arange(LENGTH, dtype=np.uint32)
    packed = lambda x, k: x[:, k::blocks] @ scale
    return [packed(vote, k).astype(np.uint32) for k in range(blocks)], [packed(loose, k).astype(np.uint32) for k in range(blocks)]


def reached(words: np.ndarray, loose: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word of votes the numbers of the code words around it, the home's first, and the bits to flip before
    the votes are within RADIUS of them."""
    low, high, patterns, weights = golay()
    syndrome = low[words & np.uint32((1 << WORD_BITS) - 1)] ^ high[words >> np.uint32(WORD_BITS)]
    errors = patterns[syndrome]
    turns = np.maximum(weights[syndrome].astype(np.int16) - RADIUS, 0)
    cheap = np.bitwise_count(errors & loose[:, None]).astype(np.int16)
    flips = np.minimum(turns, cheap) + 2 * np.maximum(turns - cheap, 0)
    return (words[:, None] ^ errors) >> np.uint32(LENGTH - WORD_BITS), flips


def anchored(fps: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The home of each fingerprint; the row of each copy and its anchor, the home's among them."""
    found = [reached(w, m) for w, m in zip(*votes(fps, blocks))]
    home = found[0][0][:, 0].copy()
    if blocks == 1:
        at, k = np.nonzero(found[0][1] <= LIMIT)
        return home, at, found[0][0][at, k]
    (one, cost), (two, more) = found
    home |= two[:, 0] << np.uint32(WORD_BITS)
    rows, numbers = [], []
    for k in range(len(fps)):
        a, b = np.flatnonzero(cost[k] <= LIMIT), np.flatnonzero(more[k] <= LIMIT)
        i, j = np.nonzero(cost[k][a][:, None] + more[k][b][None, :] <= LIMIT)
        numbers.append(one[k][a[i]] | two[k][b[j]] << np.uint32(WORD_BITS))
        rows.append(np.full(len(i), k))
    return home, np.concatenate(rows), np.concatenate(numbers)


def group_of(anchors: np.ndarray, groups: int) -> np.ndarray:
    return ((anchors.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(groups)


def copied(blocks: int, groups: int):
    """Fingerprints to rows of COPIED: for a group of anchors the homes (kind 0) and the copies (kind 1)."""

    def rows(fps):
        home, at, anchors = anchored(fps, blocks)
        for kind, numbers, values in ((0, home, fps), (1, anchors, fps[at])):
            groups_of = group_of(numbers, groups).astype(np.int32)
            order = np.argsort(groups_of, kind="stable")
            used, starts = np.unique(groups_of[order], return_index=True)
            cuts = [*starts.tolist(), len(order)]
            numbers, values = numbers[order], values[order]
            data = [(numbers[a:b].tobytes(), values[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])]
            places = np.random.default_rng(int(fps[0])).integers(0, 1 << 62, len(used))
            yield pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int32()), pa.array([kind] * len(used), pa.int32()), pa.array(np.diff(cuts), pa.int32()), pa.array(places), pa.array([x for x, _ in data], pa.binary()), pa.array([x for _, x in data], pa.binary())],
                ["anchors", "kind", "n", "place", "number", "fps"],
            )

    def run(it):
        held, n = [], 0
        for batch in it:
            held.append(batch.column(0).to_numpy().view(np.uint64))
            n += len(held[-1])
            if n >= BATCH:
                whole, held, n = np.concatenate(held), [], 0
                for k in range(0, len(whole), BATCH):
                    yield from rows(whole[k : k + BATCH])
        if n:
            yield from rows(np.concatenate(held))
        released()

    return run


def joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``labels`` (of nodes, each the least node known of its component) with the links a-b in them."""
    while True:
        x, y = labels[a], labels[b]
        if (x == y).all():
            return labels
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while not ((further := labels[labels]) == labels).all():
            labels = further


def links(homes: tuple[np.ndarray, np.ndarray], copies: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, anchor by anchor, of the links between (anchors, fingerprints) at home and copies."""
    us, vs = [], []
    order = [np.argsort(x[0], kind="stable") for x in (homes, copies)]
    (at, own), (around, others) = ((x[0][k], x[1][k]) for x, k in zip((homes, copies), order))
    used, starts = np.unique(at, return_index=True)
    stops = [*starts[1:].tolist(), len(at)]
    lows, highs = np.searchsorted(around, used, "left").tolist(), np.searchsorted(around, used, "right").tolist()
    for a, b, low, high in zip(starts.tolist(), stops, lows, highs):
        xs, ys = own[a:b], others[low:high]
        nodes = labels = None
        step = max(1, AT_ONCE // max(1, len(ys)))
        for k in range(0, len(xs), step):
            some = xs[k : k + step]
            i, j = np.nonzero((np.bitwise_count(some[:, None] ^ ys[None, :]) <= LIMIT) & (ys[None, :] > some[:, None]))
            if not len(i):
                continue
            if nodes is None:
                nodes = np.unique(np.concatenate([xs, ys]))
                labels = np.arange(len(nodes))
            labels = joined(labels, np.searchsorted(nodes, some[i]), np.searchsorted(nodes, ys[j]))
        if nodes is not None:
            moved = np.flatnonzero(labels != np.arange(len(nodes)))
            us.append(nodes[moved])
            vs.append(nodes[labels[moved]])
    none = np.empty(0, np.uint64)
    return np.concatenate([none, *us]), np.concatenate([none, *vs])


def compared(it):
    """Rows (anchors, part, block, kind, number, fps) in that order to links (u, v) between fingerprints."""
    at, homes, held, n = None, [], [], 0

    def met():
        whole = [tuple(np.concatenate(x) for x in zip(*some)) for some in (homes, held)]
        u, v = links(*whole)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    for batch in slices(it, 256, 4 << 20, "fps"):
        for *cell, kind, number, fps in zip(*(c.to_pylist() for c in batch.columns)):
            if cell != at or n >= COPIES:
                if homes and held:
                    yield met()
                at, homes, held, n = cell, homes if cell == at else [], [], 0
            pair = np.frombuffer(number, np.uint32), np.frombuffer(fps, np.uint64)
            if kind:
                held.append(pair)
                n += len(pair[1])
            else:
                homes.append(pair)
    if homes and held:
        yield met()
    released()


def near_links(prints: DataFrame, blocks: int | None = None, groups: int | None = None) -> DataFrame:
    """Links (u, v) between the distinct fingerprints ``prints`` (fp) that connect all that differ in LIMIT bits at
    most, directly or through others."""
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = prints.count()
    blocks = blocks or (1 if count <= LARGE else 2)
    groups = groups or max(GROUPS, count // GROUP)
    rows = stored(prints.select("fp").mapInArrow(copied(blocks, groups), COPIED), "copies")
    size = lambda kind, most: F.greatest(F.lit(1), F.ceil(F.sum(F.when(F.col("kind") == kind, F.col("n"))) / most)).cast("int")
    sizes = rows.groupBy("anchors").agg(size(1, COPIES).alias("parts"), size(0, HOMES).alias("blocks")).withColumns({"parts": F.coalesce("parts", F.lit(1)), "blocks": F.coalesce("blocks", F.lit(1))})
    dealt = rows.join(sizes, "anchors")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.col(many) - 1))
    one = lambda many: F.pmod(F.col("place"), F.col(many)).cast("int")
    columns = ["anchors", "part", "block", "kind", "number", "fps"]
    homes = dealt.filter("kind = 0").withColumns({"part": every("parts"), "block": one("blocks")}).select(columns)
    copies = dealt.filter("kind = 1").withColumns({"part": one("parts"), "block": every("blocks")}).select(columns)
    cells = homes.union(copies).repartition(n, "anchors", "part", "block").sortWithinPartitions("anchors", "part", "block", "kind")
    found = stored(cells.mapInArrow(compared, "u long, v long").distinct(), "near")
    dropped(rows)
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", blocks: int | None = None, groups: int | None = None) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed number) and component_id for every row of ``docs``."""
    source = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).alias("text"))
    rows = stored(source.mapInArrow(signed, SIGNED), "prints")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    edges = near_links(nodes, blocks, groups)
    roots = components(edges)
    dropped(edges)
    rooted = nodes.join(roots.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = looked_up(rooted.select("fp", "root"), names, "root", "fp").select("fp", "component_id")
    return looked_up(rows, named, "fp", "at").select("doc_id", "fp", "component_id")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
