"""Suffix arrays by induced sorting, and permuted common prefixes.

``suffix_array``: suffixes are classified as larger or smaller than the next. The leftmost smaller ones are sorted by
their substrings, a machine word of letters at a time, and named by rank. Those whose names repeat are sorted as
suffixes of the text of names by recursion, and the whole array is induced in two scans. A name that occurs once ends
every comparison, so only runs of names that repeat, each with the name after it, go into the recursion. A scan goes
bucket by bucket (the suffixes that start with one letter), with numpy over a bucket; where letters are many for the
text (in the recursion) it goes suffix by suffix.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray, letters: int) -> np.ndarray:
    """The suffix array of ``text`` (whole numbers from 0 below ``letters``). The empty suffix is not listed."""
    text = np.asarray(text, np.int64)
    n = len(text)
    if n < 2:
        return np.arange(n)
    smaller = classes(text)
    left = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    return induced(text, left[sorted_left(text, left)], smaller, np.bincount(text, minlength=letters))


def sorted_left(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The order of the suffixes at ``left``, the leftmost smaller ones."""
    if len(left) < 2:
        return np.arange(len(left))
    order, ties = by_substrings(text, left)
    names = np.empty(len(left), np.int64)
    names[order] = np.cumsum(~ties) - 1
    again = np.bincount(names)[names] > 1
    if not again.any():
        return order
    # Runs of names that repeat, and the name that ends each run.
    kept = again.copy()
    kept[1:] |= again[:-1]
    at = np.flatnonzero(kept)
    there = np.zeros(int(names.max()) + 1, np.int64)
    there[names[at]] = 1
    dense = np.cumsum(there) - 1
    array = suffix_array(dense[names[at]], int(dense[-1]) + 1)
    # The repeated names' places in the order are filled in the order of the recursion.
    deeper = at[array]
    deeper = deeper[again[deeper]]
    out = order.copy()
    out[again[order]] = deeper
    return out


def by_substrings(text: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the places ``left`` by what stands there, at least as far as the next of them, and whether each place
    ties with the one before it."""
    n, most = len(text), int(text.max()) + 1  # 0 is the end
    lane = np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32
    step = 8 // lane().itemsize
    size = np.append(left[1:] - left[:-1] + 1, n - left[-1] + 1)
    far = -(-int(size.max()) // step) * step + 4 * step
    padded = np.zeros(n + far + step, lane)
    padded[:n] = text + 1
    big = padded.astype(padded.dtype.newbyteorder(">"))
    word = lambda at: big[at[:, None] + np.arange(step)].view(">u8").ravel().astype(np.uint64)
    key = word(left)
    order = np.argsort(key, kind="stable")
    ties = np.zeros(len(left), bool)
    ties[1:] = key[order[1:]] == key[order[:-1]]
    done = step
    while ties.any():
        # Groups of ties, each sorted by the next word; the groups stay where they are.
        inside = ties.copy()
        inside[:-1] |= ties[1:]
        at = np.flatnonzero(inside)
        if done >= 2 * step and int(size[order[at]].max()) <= done:
            break
        group = np.cumsum(~ties[at])
        key = word(np.minimum(left[order[at]] + done, n + far - step))
        by = np.lexsort((key, group))
        order[at] = order[at[by]]
        ties[at[1:]] = (group[1:] == group[:-1]) & (key[by][1:] == key[by][:-1])
        done += step
    return order, ties


def classes(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one. The last is larger than the empty suffix."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:] - text[:-1])
    # A run of equal letters has the class of its end.
    ends = np.flatnonzero(step != 0)
    ends = np.append(ends, n - 1) if not len(ends) or ends[-1] != n - 1 else ends
    return np.repeat(step[ends] > 0, np.diff(ends, prepend=-1))


def induced(text: np.ndarray, order: np.ndarray, smaller: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The array induced from the leftmost smaller suffixes in ``order``."""
    if len(sizes) * 16 > len(text) or len(sizes) > 1 << 16:
        return induced_singly(text, order, smaller, sizes)
    n, ends = len(text), np.cumsum(sizes)
    starts = ends - sizes
    out = np.full(n, -1, np.int64)
    n_left = np.bincount(text[order], minlength=len(sizes))
    left_ends = np.cumsum(n_left)
    head = starts.copy()

    def put(found: np.ndarray, letter_of: np.ndarray) -> None:
        """Larger suffixes to the heads of their buckets, in order."""
        by = np.argsort(letter_of.astype(np.uint16), kind="stable")  # a radix sort
        count = np.bincount(letter_of, minlength=len(head))
        out[np.repeat(head - (np.cumsum(count) - count), count) + np.arange(len(by))] = found[by]
        np.add(head, count, out=head)

    put(np.array([n - 1]), text[n - 1 :])  # the suffix before the empty one
    for c in np.flatnonzero(sizes):
        done = starts[c]
        while done < head[c]:  # larger ones may induce more of their own bucket
            some, done = out[done : head[c]], head[c]
            before = some[some > 0] - 1
            before = before[~smaller[before]]
            put(before, text[before])
        some = order[left_ends[c] - n_left[c] : left_ends[c]]
        before = some[some > 0] - 1
        put(before, text[before])  # before a leftmost smaller suffix there is a larger one
    larger_ends = head.copy()
    tail = ends.copy()

    def put_back(found: np.ndarray, letter_of: np.ndarray) -> None:
        """Smaller suffixes to the tails of their buckets; ``found`` is in falling order."""
        by = np.argsort(letter_of.astype(np.uint16), kind="stable")
        count = np.bincount(letter_of, minlength=len(tail))
        out[np.repeat(tail - 1 + (np.cumsum(count) - count), count) - np.arange(len(by))] = found[by]
        np.subtract(tail, count, out=tail)

    for c in np.flatnonzero(sizes)[::-1]:
        done = ends[c]
        while done > tail[c]:
            some, done = out[tail[c] : done][::-1], tail[c]
            before = some[some > 0] - 1
            before = before[smaller[before]]
            put_back(before, text[before])
        some = out[starts[c] : larger_ends[c]][::-1]
        before = some[some > 0] - 1
        before = before[smaller[before]]
        put_back(before, text[before])
    return out


def induced_singly(text: np.ndarray, order: np.ndarray, smaller: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The same, a suffix at a time, for texts of many letters."""
    n = len(text)
    ends = np.cumsum(sizes)
    # The letter before each suffix where that makes a larger (or smaller) one, else -1; the last entry serves the
    # empty places, which hold -1.
    before = np.full(n + 1, -1, np.int64)
    before[1:n] = text[:-1]
    smaller_before = np.zeros(n + 1, bool)
    smaller_before[1:n] = smaller[:-1]
    larger, small = np.where(smaller_before, -1, before).tolist(), np.where(smaller_before, before, -1).tolist()
    first = text[order]
    out_array = np.full(n, -1, np.int64)
    n_left = np.bincount(first, minlength=len(sizes))
    out_array[ends[first] - n_left[first] + np.arange(len(order)) - (np.cumsum(n_left) - n_left)[first]] = order
    out = out_array.tolist()
    head = (ends - sizes).tolist()
    c = int(text[n - 1])
    out[head[c]] = n - 1
    head[c] += 1
    for k in out:  # the list grows ahead of the scan
        c = larger[k]
        if c >= 0:
            at = head[c]
            out[at] = k - 1
            head[c] = at + 1
    tail = ends.tolist()
    for k in reversed(out):
        c = small[k]
        if c >= 0:
            tail[c] = at = tail[c] - 1
            out[at] = k - 1
    return np.array(out, np.int64)


def permuted_common_prefixes(text: np.ndarray, array: np.ndarray, most: int) -> np.ndarray:
    """For each position of the text, the common prefix of its suffix with the one before it in the array, up to
    ``most`` letters (bytes; numbers of 256 and more are separators and never equal)."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[array[1:]] = array[:-1]
    # How far it is to the next separator or the end: no prefix goes beyond.
    stops = np.append(np.flatnonzero(text > 255), n)
    room = stops[np.searchsorted(stops, np.arange(n))] - np.arange(n)
    # The eight bytes from each place as one number, the first lowest.
    padded = np.zeros(n + most + 16, np.uint8)
    padded[:n] = text
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)).view("<u8").ravel()
    out = np.zeros(n, np.int64)
    live = np.flatnonzero(before >= 0)
    own, other, at = live, before[live], 0
    while len(own) and at < most:
        differ = words[own + at] ^ words[other + at]
        ended = np.flatnonzero(differ)
        low = differ[ended]
        size = at + (np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1)) >> 3)
        out[own[ended]] = np.minimum(size, np.minimum(room[own[ended]], room[other[ended]]))
        go = differ == 0
        own, other, at = own[go], other[go], at + 8
    out[own] = np.minimum(at, np.minimum(room[own], room[other]))
    return np.minimum(out, most)
