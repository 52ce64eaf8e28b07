"""Suffix arrays by induced sorting, in numpy, and permuted common prefixes.

Suffixes are classified as smaller or larger than their successor; the leftmost
smaller ones (LMS) are sorted by sorting their substrings and, where these
repeat, by recursion on the string of their names; all others follow in two
linear passes. The passes work on runs of finished entries at once: everything
up to the first empty slot is final and induces its predecessors together.
"""

from __future__ import annotations

import numpy as np


def _types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor; the last one is larger (an end sign follows)."""
    n = len(text)
    small = np.zeros(n, bool)
    if n < 2:
        return small
    differs = np.flatnonzero(text[1:] != text[:-1])
    # the comparison at the next change decides for the whole run before it
    ends = np.r_[differs, n - 1]
    value = np.r_[text[differs] < text[differs + 1], False]
    return np.repeat(value, np.diff(np.r_[-1, ends]))


def _rank_in_batch(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stable order by key, and the distinct keys with their starts and counts in that order."""
    order = keys.argsort(kind="stable")
    ordered = keys[order]
    new = np.empty(len(ordered) + 1, bool)
    new[0] = new[-1] = True
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:-1])
    bound = new.nonzero()[0]
    first = bound[:-1]
    return order, ordered[first], first, bound[1:] - first


def _fill(seed_slots, seed_values, n_slots, heads, text, take, window):
    """Fill slots upwards: finished runs induce predecessors for which take() holds, at their key's head."""
    slots = np.full(n_slots + 1, -1, np.int32 if len(text) < 1 << 31 else np.int64)
    slots[seed_slots] = seed_values
    done, ramp = 0, np.arange(1 << 12)
    while done < n_slots:
        stop = min(n_slots, done + window)
        part = slots[done:stop]
        empty = part < 0
        gap = int(empty.argmax())
        if not gap:
            if empty[0]:
                raise AssertionError("an empty slot was reached")
            gap = len(part)
        before = part[:gap] - 1
        done += gap
        window = min(max(64, 4 * gap), 1 << 18)
        # position 0 has no predecessor: its -1 reads the last entry of take, which never holds for what is induced there
        before = before[take[before] & (before >= 0)]
        n = len(before)
        if n == 0:
            continue
        if n <= 12:  # a few entries: plain loops cost less than array calls
            for b, k in zip(before.tolist(), text[before].tolist(), strict=True):
                slots[heads[k]] = b
                heads[k] += 1
            continue
        order, keys, first, count = _rank_in_batch(text[before])
        at = heads[keys]
        heads[keys] = at + count
        target = np.repeat(at - first, count)
        target += ramp[:n] if n <= len(ramp) else np.arange(n)
        slots[target] = before[order]
    return slots[:n_slots]


def _induce(text: np.ndarray, small: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """The suffix order that follows from the given order of LMS positions."""
    n = len(text)
    n_large = np.bincount(text[~small], minlength=size)
    n_small = np.bincount(text[small], minlength=size)
    n_lms = np.bincount(text[lms], minlength=size)
    # larger suffixes, upwards; each key's slots: its larger suffixes, then its LMS seeds; the end sign precedes the last one
    width = n_large + n_lms
    start = np.cumsum(width) - width
    seed = np.repeat(start + n_large - (np.cumsum(n_lms) - n_lms), n_lms) + np.arange(len(lms))
    heads = start.copy()
    # the suffix before the end sign is induced first
    last = n - 1
    seeds_slot, seeds_value = seed, lms
    first_slot = heads[text[last]]
    heads[text[last]] += 1
    slots = _fill(np.r_[seeds_slot, first_slot], np.r_[seeds_value, last], int(width.sum()), heads, text, ~small, 1024)
    is_large = np.ones(len(slots), bool)
    is_large[seed] = False
    large = slots[is_large]
    # smaller suffixes, downwards, as the same upward fill over mirrored keys
    flip = text.dtype.type(size - 1) - text
    width = (n_large + n_small)[::-1]
    start = np.cumsum(width) - width
    mirrored = n_large[::-1]
    mirror_small = n_small[::-1]
    seed = np.repeat(start + mirror_small - (np.cumsum(mirrored) - mirrored), mirrored) + np.arange(len(large))
    down = _fill(seed, large[::-1], n, start.copy(), flip, small, 1024)
    return down[::-1]


def suffix_array(text: np.ndarray, size: int | None = None) -> np.ndarray:
    """Start positions of all suffixes of a string of small non-negative integers, in order."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    if n == 1:
        return np.zeros(1, np.int64)
    if size is None:
        size = int(text.max()) + 1
    # the narrowest type: stable sorts of one or two bytes are radix sorts
    text = text.astype(np.uint8 if size <= 1 << 8 else np.uint16 if size <= 1 << 16 else np.int32, copy=False)
    small = _types(text)
    is_lms = np.zeros(n, bool)
    is_lms[1:] = small[1:] & ~small[:-1]
    lms = np.flatnonzero(is_lms)
    if len(lms) == 0:
        return _induce(text, small, lms, size)
    # one pass over LMS positions in any order inside a key sorts the LMS substrings
    rough = _induce(text, small, lms[np.argsort(text[lms], kind="stable")], size)
    ordered = rough[is_lms[rough]]
    names = _name(text, lms, ordered, n)
    of = np.empty(n, np.int32)
    of[ordered] = names
    reduced = of[lms]
    if names[-1] + 1 < len(lms):
        ordered = lms[suffix_array(reduced, int(names[-1]) + 1)]
    return _induce(text, small, ordered, size)


def _name(text: np.ndarray, lms: np.ndarray, ordered: np.ndarray, n: int) -> np.ndarray:
    """Names of LMS substrings in sorted order: equal substrings, equal names."""
    length = np.empty(len(lms), np.int64)
    length[:-1] = np.diff(lms) + 1
    length[-1] = n + 1  # runs into the end sign: unlike any other
    place = np.empty(n, np.int32)
    place[lms] = np.arange(len(lms), dtype=np.int32)
    span = length[place[ordered]]
    same = np.zeros(len(ordered), bool)
    same[1:] = (span[1:] == span[:-1]) & (span[1:] <= n)
    check = np.flatnonzero(same)
    at = 0
    while len(check):
        live = check[span[check] > at]
        if not len(live):
            break
        equal = text[ordered[live] + at] == text[ordered[live - 1] + at]
        same[live[~equal]] = False
        check = live[equal]
        at += 1
    return np.cumsum(~same) - 1


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int, lanes: int) -> np.ndarray:
    """Permuted common prefixes: for each position, how far its suffix equals the one before it in order.

    Counted up to `most`. Positions are walked in text order, in `lanes` strands
    at once; each step starts from the last value less one, so the work is linear.
    """
    n = len(text)
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    out = np.zeros(n, np.int32)
    step = -(-n // lanes)
    starts = np.arange(0, n, step)
    value = np.zeros(len(starts), np.int64)
    padded = np.r_[text, text[-1:]]
    for k in range(step):
        at = starts + k
        at = at[at < n]
        value = np.maximum(value[: len(at)] - 1, 0)
        other = before[at]
        live = np.flatnonzero((other >= 0) & (value < most))
        value[other < 0] = 0
        while len(live):
            # beyond either end nothing matches
            x, y = at[live] + value[live], other[live] + value[live]
            equal = (np.maximum(x, y) < n) & (padded[np.minimum(x, n)] == padded[np.minimum(y, n)])
            live = live[equal]
            value[live] += 1
            live = live[value[live] < most]
        out[at] = value
    return out
