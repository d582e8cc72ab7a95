"""Joins of names by similarity: all pairs of a block are held against bounds, and few are compared in full.

The ratio is Ratcliff and Obershelp's, 2 * M / S: M characters in matching blocks, S the length of both names. Bounds
that no pair at or above a ratio t can break:

* M is at most the shorter length, so the lengths are within t / (2 - t) of each other;
* the names share M characters, counted with repeats;
* between two blocks stands an unmatched character of either name, so there are at most S - 2 * M + 1 blocks; a block of
  n characters shares n - 1 pairs of neighbours, hence the names share 3 * M - S - 1 such pairs, counted with repeats;
* the blocks stand in one order in both names, so M is at most the length of their longest common subsequence.

At usual ratios these bounds leave most pairs of neighbours in the prefix that a join on tokens would need, so that pairs
met several times each. Instead the names of a block are dealt into cells of bounded size, and a task holds the pairs of
a cell against the bounds as products of matrices. Their number grows with the square of a block, but only pairs that
have the ratio leave the task: what is kept and shuffled grows with the names (and, for blocks beyond CELL, with the
cells that they are sent to).
"""

from __future__ import annotations

import difflib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.sources.tables import let_go, settled

#: Names of either side in a cell, blocks whose sizes are broadcast, and names whose pairs are bounded at once.
CELL, BROADCAST_BLOCKS, STRIPE, STRIP = 16_384, 200_000, 512, 8_192
#: Classes that characters and pairs of neighbours are counted in; more in a class only loosen the bounds.
CLASSES, PAIR_CLASSES = 64, 512
#: Pairs that are held against the later bounds at once, and the longest names that are one number of an array.
SLICE, WORD = 1 << 14, 64


def codes(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all names, and the number of the name of each."""
    found = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return found, np.repeat(np.arange(len(names)), list(map(len, names)))


def character_counts(names: list[str]) -> np.ndarray:
    """A row for each name: how often each class of characters occurs."""
    found, owner = codes(names)
    mixed = (found.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(58)).astype(np.int64)
    return np.bincount(owner * CLASSES + mixed, minlength=len(names) * CLASSES).reshape(-1, CLASSES).astype(np.int32)


def neighbours(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Each pair of neighbours, numbered among equal ones of its name, and the number of the name."""
    found, owner = codes(names)
    own = owner[:-1] == owner[1:]
    pairs, owner = (found[:-1] << 21 | found[1:])[own], owner[:-1][own]
    order = np.lexsort((pairs, owner))
    pairs, owner = pairs[order], owner[order]
    first = np.ones(len(pairs), bool)
    first[1:] = (pairs[1:] != pairs[:-1]) | (owner[1:] != owner[:-1])
    place = np.arange(len(pairs))
    return pairs << 20 | np.minimum(place - np.maximum.accumulate(np.where(first, place, 0)), (1 << 20) - 1), owner


def features(tokens: np.ndarray, owner: np.ndarray, n: int, width: int) -> np.ndarray:
    """A row for each of ``n`` names: how many of its tokens are in each class. The product of two rows is at least the
    number of tokens that they share."""
    out = np.empty((n, width), np.float32)
    for k in range(0, n, 2048):
        a, b = np.searchsorted(owner, (k, k + 2048))
        rows = min(2048, n - k)
        out[k : k + rows] = np.bincount((owner[a:b] - k) * width + tokens[a:b] % width, minlength=rows * width).reshape(rows, width)
    return out


def subsequences(names: list[str], others: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The length of the longest common subsequence of each pair of names of up to WORD characters, a bit a character."""
    (a, a_owner), (b, b_owner) = codes(names), codes(others)
    known, at = np.unique(a, return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(list(map(len, names)))])
    masks = np.zeros((len(names), len(known) + 1), np.uint64)  # the last column is of characters that the names lack
    np.bitwise_or.at(masks, (a_owner, at), np.uint64(1) << (np.arange(len(a)) - starts[a_owner]).astype(np.uint64))
    lengths = np.array(list(map(len, others)), np.int64)
    text = np.full((len(others), lengths.max(initial=0)), len(known))
    found = np.minimum(np.searchsorted(known, b), len(known) - 1)
    text[b_owner, np.arange(len(b)) - np.concatenate([[0], np.cumsum(lengths)])[b_owner]] = np.where(known[found] == b, found, len(known))
    rows = np.full(len(i), ~np.uint64(0))
    for k in range(text.shape[1]):
        mask = masks[i, text[j, k]]
        rows = (rows + (rows & mask)) | (rows & ~mask)
    return np.bitwise_count(~rows).astype(np.int64)  # bits beyond a name stay set


def long_subsequences(names: list[str], others: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The same for names of any length, a pair at a time."""
    found, at, masks, whole = [], None, {}, 0
    for x, y in zip(i.tolist(), j.tolist()):
        if at != x:
            at, masks, whole = x, {}, (1 << len(names[x])) - 1
            for k, c in enumerate(names[x]):
                masks[c] = masks.get(c, 0) | 1 << k
        rows = whole
        for c in others[y]:
            mask = masks.get(c, 0)
            rows = ((rows + (rows & mask)) | (rows & ~mask)) & whole
        found.append(len(names[x]) - rows.bit_count())
    return np.array(found, np.int64)


def near(names: list[str], others: list[str], least: float):
    """Numbers (i, j) of pairs that the bounds leave, in arrays of some thousands."""
    names_by = sorted(range(len(names)), key=lambda k: len(names[k]))
    others_by = sorted(range(len(others)), key=lambda k: len(others[k]))
    a, b = [names[k] for k in names_by], [others[k] for k in others_by]
    names_by, others_by = np.array(names_by), np.array(others_by)
    (ta, owner_a), (tb, owner_b) = neighbours(a), neighbours(b)
    _, numbered = np.unique(np.concatenate([ta, tb]), return_inverse=True)
    width = int(min(PAIR_CLASSES, numbered.max(initial=0) + 1))
    fa, fb = features(numbered[: len(ta)], owner_a, len(a), width), features(numbered[len(ta) :], owner_b, len(b), width)
    ca, cb = character_counts(a), character_counts(b)
    la, lb = np.array(list(map(len, a)), np.int64), np.array(list(map(len, b)), np.int64)
    least_matched = lambda size: np.ceil((least * size - 1e-9) / 2).astype(np.int64)
    runs = np.flatnonzero(np.concatenate([[True], la[1:] != la[:-1]])).tolist() + [len(la)]
    for first, last in zip(runs, runs[1:]):
        size = la[first] + lb
        matched = least_matched(size)
        fits = np.flatnonzero(np.minimum(la[first], lb) >= matched)
        if not len(fits):
            continue
        shared = ((3 * matched - size - 1) * 0.999 - 0.5).astype(np.float32)  # products beyond 24 bits are rounded
        for k in range(first, last, STRIPE):
            for m in range(fits[0], fits[-1] + 1, STRIP):
                end, stop = min(k + STRIPE, last), min(m + STRIP, fits[-1] + 1)
                i, j = np.nonzero(fa[k:end] @ fb[m:stop].T >= shared[m:stop])
                for cut in range(0, len(i), SLICE):
                    x, y = i[cut : cut + SLICE] + k, j[cut : cut + SLICE] + m
                    good = np.minimum(ca[x], cb[y]).sum(axis=1) >= matched[y]
                    x, y = x[good], y[good]
                    if len(x):
                        some_x, at_x = np.unique(x, return_inverse=True)
                        some_y, at_y = np.unique(y, return_inverse=True)
                        common = subsequences if la[first] <= WORD else long_subsequences
                        good = common([a[q] for q in some_x], [b[q] for q in some_y], at_x, at_y) >= matched[y]
                        x, y = x[good], y[good]
                    if len(x):
                        yield names_by[x], others_by[y]


def compared(least: float):
    """Rows (block, i, j, side, name), a cell's together and the names of side 0 first, to (block, name, other, ratio) of
    the pairs of either side that have at least the ratio ``least``."""

    def pairs(block, names, others):
        for x, y in near(names, others, least) if names and others else ():
            out, at, matcher = [], None, difflib.SequenceMatcher(None)
            for k in np.argsort(y, kind="stable").tolist():
                # the second name is the one that the matcher keeps an index of
                if at != y[k]:
                    at = y[k]
                    matcher.set_seq2(others[at])
                matcher.set_seq1(names[x[k]])
                ratio = matcher.ratio()
                if ratio >= least:
                    out.append((block, names[x[k]], others[at], ratio))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.string(), pa.float64()))], ["block", "name", "other", "ratio"])

    def run(it):
        cell, names = None, ([], [])
        for batch in it:
            for block, i, j, side, name in zip(*(c.to_pylist() for c in batch.columns)):
                if (block, i, j) != cell:
                    if cell is not None:
                        yield from pairs(cell[0], *names)
                    cell, names = (block, i, j), ([], [])
                names[side].append(name)
        if cell is not None:
            yield from pairs(cell[0], *names)

    return run


def similar_names(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """block, name, other and ratio of all names of ``left`` and ``right`` (block, name) that are in the same block and
    have at least the ratio ``least`` (above 2 / 3). Null and empty names and null blocks take no part.

    Distinct names alone are compared. A block whose names are more than a cell holds is dealt by a hash of the name.
    """
    if not 2 / 3 < least <= 1:
        raise ValueError("pairs of neighbours say nothing about ratios up to 2 / 3")
    usable = lambda x: settled(x.select("block", "name").filter("name <> '' AND block IS NOT NULL").distinct())
    ours, theirs = usable(left), usable(right)
    parts = lambda x, n: x.groupBy("block").agg(F.ceil(F.count("*") / CELL).cast("int").alias(n))
    sizes = settled(parts(ours, "ours").join(parts(theirs, "theirs"), "block"))
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_BLOCKS else sizes
    own = lambda n: F.pmod(F.xxhash64("name"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = ours.join(sizes, "block").select("block", own("ours").alias("i"), every("theirs").alias("j"), F.lit(0).alias("side"), "name")
    b = theirs.join(sizes, "block").select("block", every("ours").alias("i"), own("theirs").alias("j"), F.lit(1).alias("side"), "name")
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = a.union(b).repartition(n, "block", "i", "j").sortWithinPartitions("block", "i", "j", "side")
    found = settled(dealt.mapInArrow(compared(least), "block string, name string, other string, ratio double"))
    let_go(ours)
    let_go(theirs)
    return found
