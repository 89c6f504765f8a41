"""Suffix arrays by induced sorting, on arrays.

Suffixes are classified as smaller (S) or larger (L) than their right neighbour; the leftmost smaller of each run (LMS)
split the text into substrings. These are sorted by one round of induction, named in order, and the suffixes that begin
at them are sorted from the names of what follows; from that order a second round of induction sorts all suffixes. A
round goes through the buckets of first bytes: a bucket's suffixes, taken together, hand their left neighbours on to the
ends of those neighbours' buckets, in order. So each suffix moves once in a round, and a step of the round is a few
array operations on a whole bucket (again for each repetition in a run of one byte).

Names are sorted by doubling: ranks of 1, 2, 4, ... names in a row, until all differ or equal ones span `depth` bytes. The
order is then by the first `depth` bytes, which is all that prefixes of that length need.

Common prefixes are computed in text order (permuted): where a suffix and its predecessor in the array are the right
neighbours of the suffix and predecessor one place to the left, their common prefix is one shorter, so only the end of
each such chain is compared byte for byte.
"""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = base
        np.multiply.accumulate(out, out=out)
    return out


def is_smaller(text: np.ndarray) -> np.ndarray:
    """True where a suffix is of type S; the last one is L, for what ends sooner is smaller."""
    step = np.diff(text.astype(np.int16), append=-1)
    at = np.where(step != 0, np.arange(len(text)), len(text) - 1)
    return step[np.minimum.accumulate(at[::-1])[::-1]] > 0


class Buckets:
    """A list of arrays for each byte, in order of arrival."""

    def __init__(self):
        self.parts: list[list[np.ndarray]] = [[] for _ in range(256)]

    def add(self, suffixes: np.ndarray, heads: np.ndarray) -> None:
        if not len(suffixes):
            return
        suffixes = suffixes[np.argsort(heads, kind="stable")]
        counts = np.bincount(heads, minlength=256)
        ends = np.cumsum(counts)
        for c in np.flatnonzero(counts):
            self.parts[c].append(suffixes[ends[c] - counts[c] : ends[c]])

    def take(self, c: int) -> np.ndarray:
        parts, self.parts[c] = self.parts[c], []
        return np.concatenate(parts) if len(parts) > 1 else parts[0] if parts else np.zeros(0, np.int32)


def induce(text: np.ndarray, smaller: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes (but for the LMS seeds' own places) from LMS suffixes in order."""
    heads = text[lms]
    seeds = Buckets()
    seeds.add(lms, heads)
    larger, by_bucket = Buckets(), []
    larger.add(np.array([len(text) - 1], np.int32), text[-1:])
    for c in range(256):
        done, new = [], larger.take(c)
        while len(new):
            done.append(new)
            left = new[new > 0] - 1
            left = left[~smaller[left]]
            head = text[left]
            own = head == c
            larger.add(left[~own], head[~own])
            new = left[own]
        left = seeds.take(c)
        left = left[left > 0] - 1
        larger.add(left, text[left])
        by_bucket.append(np.concatenate(done) if done else np.zeros(0, np.int32))
    less, out = Buckets(), [np.zeros(0, np.int32)] * 512
    for c in range(255, -1, -1):
        done, new = [], less.take(c)
        while len(new):
            done.append(new)
            left = new[new > 0] - 1
            left = left[smaller[left]]
            head = text[left]
            own = head == c
            less.add(left[~own], head[~own])
            new = left[own]
        left = by_bucket[c][::-1]
        left = left[left > 0] - 1
        left = left[smaller[left]]
        less.add(left, text[left])
        out[2 * c] = by_bucket[c]
        out[2 * c + 1] = np.concatenate(done)[::-1] if done else np.zeros(0, np.int32)
    return np.concatenate(out)


def names(text: np.ndarray, order: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Ranks, from 0, of the LMS substrings in text order; order: their starts as sorted. Equality by a 64-bit hash."""
    weight = powers(BASE, len(text) + 1)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum((text.astype(np.uint64) + np.uint64(1)) * weight[:-1], dtype=np.uint64)])
    del weight
    end = np.minimum(np.append(lms[1:] + 1, len(text)), len(text))
    value = (prefix[end] - prefix[lms]) * powers(INVERSE, len(text))[lms]
    del prefix
    place = np.zeros(len(text), np.int32)
    place[lms] = np.arange(len(lms), dtype=np.int32)
    place = place[order]
    value, length = value[place], (end - lms)[place]
    new = np.concatenate([[False], (value[1:] != value[:-1]) | (length[1:] != length[:-1])])
    out = np.empty(len(lms), np.int64)
    out[place] = np.cumsum(new)
    return out


def sorted_lms(ranks: np.ndarray, lms: np.ndarray, n: int, depth: int) -> np.ndarray:
    """The LMS suffixes in order of their first `depth` bytes at least, from the ranks of the LMS substrings."""
    ranks, width = ranks.copy(), 1
    order = np.argsort(ranks, kind="stable")
    ordered = ranks[order]
    while True:
        tied = np.concatenate([[False], ordered[1:] == ordered[:-1]])
        tied[:-1] |= tied[1:]
        open_ = order[tied]
        end = np.where(open_ + width < len(lms), lms[np.minimum(open_ + width, len(lms) - 1)], n)
        if not len(open_) or (np.where(open_ + width < len(lms), end - lms[open_], n) >= depth).all():
            return lms[order]
        # Only ties are sorted again; a tie keeps its place among the ranks, which are places in the order.
        following = np.where(open_ + width < len(lms), ranks[np.minimum(open_ + width, len(lms) - 1)] + 1, 0)
        again = np.argsort(ordered[tied] * np.int64(len(lms) + 2) + following, kind="stable")
        key = (ordered[tied] * np.int64(len(lms) + 2) + following)[again]
        spots = np.flatnonzero(tied)
        order[spots] = open_[again]
        first = np.concatenate([[True], key[1:] != key[:-1]])
        fresh = spots[np.maximum.accumulate(np.where(first, np.arange(len(spots)), 0))]
        ordered[~tied] = np.flatnonzero(~tied)
        ordered[spots] = fresh
        ranks = np.empty(len(lms), np.int64)
        ranks[order] = ordered
        width *= 2


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes of text (bytes), sorted by their first `depth` bytes at least."""
    if not len(text):
        return np.zeros(0, np.int32)
    smaller = is_smaller(text)
    lms = (np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1).astype(np.int32)
    if len(lms):
        mask = np.zeros(len(text), bool)
        mask[lms] = True
        first = induce(text, smaller, lms)
        lms = sorted_lms(names(text, first[mask[first]], lms), lms, len(text), depth)
    return induce(text, smaller, lms)


def prefix_at_least(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """By position, whether the suffix there and its predecessor in order (a choice of suffixes, sorted) share `length` bytes."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.flatnonzero(before >= 0)
    if not len(at):
        return np.zeros(n, bool)
    j = before[at]
    chained = np.append((at[1:] == at[:-1] + 1) & (j[1:] == j[:-1] + 1), False)
    # Common prefixes of chain ends, eight bytes at a time while they go on.
    padded = np.concatenate([text, np.zeros(length + 16, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))  # the eight bytes from each byte on
    tails = np.flatnonzero(~chained)
    common, going = np.zeros(len(tails), np.int64), np.arange(len(tails))
    while len(going):
        a = eight[at[tails[going]] + common[going]]
        b = eight[j[tails[going]] + common[going]]
        same = a == b
        stop = going[~same]
        if len(stop):
            diff = (a ^ b)[~same]
            common[stop] += np.bitwise_count((diff & (~diff + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3
        going = going[same]
        common[going] += 8
        going = going[common[going] < length]
    # Within a chain a prefix is as long as the way to the next unequal byte, or to the end and on.
    reach = np.full(len(at), np.iinfo(np.int64).max)
    reach[tails] = at[tails] + common
    unequal = text[at] != text[j]
    reach[unequal] = at[unequal]
    reach = next_reach(reach)
    out = np.zeros(n, bool)
    out[at] = reach - at >= length
    return out


def next_reach(reach: np.ndarray) -> np.ndarray:
    """Each unset (greatest) value replaced by the next set one to the right."""
    known = np.flatnonzero(reach != np.iinfo(np.int64).max)
    return reach[known[np.searchsorted(known, np.arange(len(reach)))]]
