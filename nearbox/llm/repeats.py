"""Suffix-array deduplication of repeated byte strings.

Each byte is removed that lies in a string of `length` bytes which starts anywhere else too, in the same text or another.

A suffix array over all texts would have to fit somewhere; here each shard has one over a part of them that misses no
match. Every window of `length` bytes is owned by the least hash among its strings of `GRAM` bytes (the leftmost of
equals): equal windows have the same owner, wherever they are. So:

1. The owners' hashes are counted over all texts. Those met once own no repeated window.
2. For each owner met again, the run of windows it owns goes, as one segment of text, to the shard of its hash. Equal
   segments of a shard are stored once. The shard sorts its suffixes by induced sorting (see induced.py), computes the
   permuted common prefixes, and so finds which windows share `length` bytes with another.
3. What these windows cover is sent back by text and merged; workers memory-map it and cut the texts.

An owner with more than `crowd` segments would make one shard large. Its windows don't go through a suffix array but are
counted by hash: counts are summed within batches first, so a window met everywhere is one number a batch; the hashes met
again are stored as sorted arrays, and a scan looks its windows up in them. No occurrence moves. The result is the same
up to the collisions of two independent 64-bit hashes, in both of which a window must be met again.

Texts are known by a 128-bit hash of their bytes, so equal texts are cut alike; each counts for the other. Long texts
are worked on in pieces of `PIECE` windows.

Defined cases: a null text is empty; texts shorter than `length` are never cut, nor is anything in an empty table;
repeated rows are copies and repeat; other columns are ignored by `cuts` and kept by `without_repeats`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearbox.llm.induced import BASE, INVERSE, powers, prefix_at_least, suffix_array
from nearbox.llm.perplexity import Gathered, emitted, slices
from nearbox.llm.shared_arrays import opened, put, shards_for, unpacked
from nearbox.session import new_shared_path, written

LENGTH, GRAM, PIECE, BATCH = 400, 128, 1 << 20, 2_000_000
PLACE_BITS = 24  #: of a place in a batch, beside a hash
SHARD_BYTES = 4_000_000
CROWD = 10_000


def stirred(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Rolling:
    """Hashes of all strings of one length in a text, by a polynomial over 64 bits."""

    def __init__(self, text: np.ndarray):
        self.n = len(text)
        self.prefix = np.zeros(self.n + 1, np.uint64)
        np.cumsum((text.astype(np.uint64) + np.uint64(1)) * POWERS.of(self.n)[0], out=self.prefix[1:])

    def of(self, length: int) -> np.ndarray:
        k = self.n - length + 1
        return stirred((self.prefix[length:] - self.prefix[:k]) * POWERS.of(self.n)[1][:k])


class Powers:
    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            self.up, self.down = powers(BASE, n), powers(INVERSE, n)
        return self.up[:n], self.down[:n]


POWERS = Powers()


def sliding_least(v: np.ndarray, w: int) -> np.ndarray:
    """The least of each w values in a row."""
    x = np.concatenate([v, np.full(-len(v) % w, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(x, 1).ravel()
    behind = np.minimum.accumulate(x[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: len(v) - w + 1], ahead[w - 1 : len(v)])


def segments(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """For texts laid end to end: owner's hash, first and last window, and owners joined, of each run of windows.

    starts, ends: of the texts. Neighbouring runs of equal owners (in a periodic text) are one.
    """
    none = tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    if len(text) < length:
        return none
    h = Rolling(text).of(gram)
    least = sliding_least(h >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
    edge = np.zeros(len(text) + 1, np.int32)
    long = ends - starts >= length
    np.add.at(edge, starts[long], 1)
    np.add.at(edge, ends[long] - length + 1, -1)
    s = np.flatnonzero(np.cumsum(edge[: len(least)]) > 0)
    if not len(s):
        return none
    owner = least[s]
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    lo, hi = s[first], s[np.append(first[1:], len(s)) - 1]
    h = h[(owner[first] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (lo[1:] != hi[:-1] + 1)]))
    last = np.append(first[1:], len(h)) - 1
    return h[first], lo[first], hi[last], last - first + 1


@dataclass
class Laid:
    """Distinct texts of a batch, in pieces, laid end to end."""

    text: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    key: np.ndarray  #: of each piece's text, two columns
    offset: np.ndarray  #: of each piece in its text
    times: np.ndarray  #: rows that have the text


def key_of(raw: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(raw)
    return d >> 64, d & (1 << 64) - 1


def laid(texts: pa.Array, length: int) -> Iterator[Laid]:
    seen: dict[tuple[int, int], list] = {}
    for t in texts:
        raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
        if len(raw) >= length:
            seen.setdefault(key_of(raw), [raw, 0])[1] += 1
    parts, rows, size = [], [], 0

    def out() -> Laid:
        sizes = np.array([len(p) for p in parts], np.int64)
        ends = np.cumsum(sizes)
        return Laid(np.frombuffer(b"".join(parts), np.uint8), ends - sizes, ends, np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64))

    for key, (raw, times) in seen.items():
        for at in range(0, len(raw) - length + 1, PIECE):
            parts.append(raw[at : at + PIECE + length - 1])
            rows.append((key, at, times))
            size += len(parts[-1])
            if size >= BATCH:
                yield out()
                parts, rows, size = [], [], 0
    if parts:
        yield out()


def packed(regions: list[bytes], occurrences: np.ndarray) -> tuple[bytes, bytes]:
    """Segments and where they are (columns: segment, key, key, offset, times)."""
    sizes = np.array([len(r) for r in regions], "<u8")
    return zstandard.compress(b"".join(regions), 1), zstandard.compress(np.uint64(len(regions)).tobytes() + sizes.tobytes() + np.ascontiguousarray(occurrences.astype("<u8").T).tobytes(), 1)


def read_packed(text: bytes, about: bytes) -> tuple[list[bytes], np.ndarray]:
    raw, text = np.frombuffer(zstandard.decompress(about), "<u8"), zstandard.decompress(text)
    n = int(raw[0])
    ends = np.cumsum(raw[1 : n + 1].astype(np.int64))
    return [text[e - int(s) : e] for s, e in zip(raw[1 : n + 1], ends, strict=True)], raw[n + 1 :].reshape(5, -1).T


def covered(starts: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted window starts by group as intervals: group, start, end."""
    if not len(starts):
        return group, starts, starts
    first = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (starts[1:] > starts[:-1] + length)]))
    last = np.append(first[1:], len(starts)) - 1
    return group[first], starts[first], starts[last] + length


def repeated_in(regions: list[bytes], times: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """region, start, end (within the region) of what repeated windows cover, among distinct regions met `times` times."""
    sizes = np.array([len(r) for r in regions], np.int64)
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(regions)), sizes - length + 1)
    starts = np.repeat(begin - (np.cumsum(sizes - length + 1) - (sizes - length + 1)), sizes - length + 1) + np.arange(len(owner))
    repeated = np.zeros(int(sizes.sum()), bool)
    if len(regions) > 1 or sizes.max(initial=0) > length:
        text = np.frombuffer(b"".join(regions), np.uint8)
        valid = np.zeros(len(text), bool)
        valid[starts] = True
        order = suffix_array(text, length)
        order = order[valid[order]]
        shared = prefix_at_least(text, order, length)[order]
        repeated[order] = shared | np.append(shared[1:], False)
    hit = repeated[starts] | (times > 1)[owner]
    region, lo, hi = covered(starts[hit], owner[hit], length)
    return region, lo - begin[region], hi - begin[region]


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return (h & np.uint64(shards - 1)).astype(np.int64)


def held_in(folder: str, kind: str, held: frozenset, shards: int, keys: np.ndarray) -> np.ndarray:
    """Which keys are in the sorted arrays of a kind, sharded by leading bits."""
    out = np.zeros(len(keys), bool)
    shard = (keys >> np.uint64(64 - shards.bit_length() + 1)).astype(np.int64) if shards > 1 else np.zeros(len(keys), np.int64)
    for s in np.unique(shard):
        if (kind, int(s)) in held:
            a, own = opened(f"{folder}/{kind}-{s}", "<u8"), shard == s
            p = np.minimum(np.searchsorted(a, keys[own]), len(a) - 1)
            out[own] = a[p] == keys[own]
    return out


def joined_intervals(rows: np.ndarray) -> np.ndarray:
    """Rows (key, key, start, end) with overlapping and touching intervals of a key made one; sorted."""
    if not len(rows):
        return rows.reshape(0, 4)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new_key = np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1)])
    group = np.cumsum(new_key).astype(np.uint64) - np.uint64(1)
    if group[-1] >= 1 << 23:  # so that a group's number and an offset in a text share 64 bits
        half = int(np.searchsorted(group, group[-1] // np.uint64(2)))
        return np.concatenate([joined_intervals(rows[:half]), joined_intervals(rows[half:])])
    reach = np.maximum.accumulate(rows[:, 3] + (group << np.uint64(40))) - (group << np.uint64(40))
    first = np.flatnonzero(new_key | np.concatenate([[True], rows[1:, 2] > reach[:-1]]))
    last = np.append(first[1:], len(rows)) - 1
    return np.stack([rows[first, 0], rows[first, 1], rows[first, 2], reach[last]], 1)


def sent(rows: np.ndarray, shards: int) -> list[tuple[int, bytes]]:
    """Intervals by the shard of their key's leading bits."""
    rows = joined_intervals(rows)
    shard = rows[:, 0] >> np.uint64(64 - shards.bit_length() + 1) if shards > 1 else np.zeros(len(rows), np.uint64)
    bounds = np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))
    return [(s, zstandard.compress(np.ascontiguousarray(rows[bounds[s] : bounds[s + 1]].T).astype("<u8").tobytes(), 1)) for s in range(shards) if bounds[s] < bounds[s + 1]]


INTERVALS = "shard int, intervals binary"
SEGMENTS = "shard int, segments binary, about binary"


@dataclass(frozen=True)
class Cuts:
    """What to remove, as arrays in the shared folder."""

    folder: str
    shards: int
    held: frozenset

    def of(self, keys: np.ndarray) -> list[np.ndarray]:
        """For texts by key, their intervals (start, end)."""
        none = np.zeros((0, 2), np.int64)
        out = [none] * len(keys)
        for i, (a, b) in enumerate(keys):
            s = int(a) >> 64 - self.shards.bit_length() + 1 if self.shards > 1 else 0
            if ("cut", s) in self.held:
                rows = opened(f"{self.folder}/cut-{s}", "<u8").reshape(4, -1)
                lo, hi = np.searchsorted(rows[0], a), np.searchsorted(rows[0], a, "right")
                if lo < hi:
                    own = rows[1, lo:hi] == b
                    out[i] = np.stack([rows[2, lo:hi][own], rows[3, lo:hi][own]], 1).astype(np.int64)
        return out


def find(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD, shards: int | None = None) -> Cuts:
    """texts: one column, text."""
    spark = texts.sparkSession
    if shards is None:
        shards = shards_for(texts)
    folder = new_shared_path(spark, "repeats")

    def count_owners(batches):
        g = Gathered()
        for b in slices(batches, 0, BATCH):
            for x in laid(b.column(0), length):
                h, lo, _, joined = segments(x.text, x.starts, x.ends, length, gram)
                # A run of joined owners repeats by itself; so does a text that is met again.
                times = x.times[np.searchsorted(x.ends, lo, "right")]
                keys, inverse = np.unique(h, return_inverse=True)
                if g.add(keys, np.bincount(inverse, weights=np.where(joined > 1, 2, 1) * times, minlength=len(keys))):
                    yield emitted(shards, 64, *g.take())
        if g.size:
            yield emitted(shards, 64, *g.take())

    def store_owners(table: pa.Table) -> pa.Table:
        s = table.column("shard")[0].as_py()
        keys, counts = unpacked(table.column("packed").to_pylist(), 1)
        counts = counts[:, 0]
        again, crowded = keys[counts > 1], keys[counts > crowd]
        put(f"{folder}/again-{s}", again.astype("<u8").tobytes())
        put(f"{folder}/crowded-{s}", crowded.astype("<u8").tobytes())
        return pa.table({"shard": pa.array([s], pa.int32()), "again": pa.array([len(again)], pa.int64()), "crowded": pa.array([len(crowded)], pa.int64()), "segments": pa.array([int(counts[(counts > 1) & (counts <= crowd)].sum())], pa.int64())})

    owners = texts.mapInArrow(count_owners, "shard int, packed binary").groupBy("shard").applyInArrow(store_owners, "shard int, again long, crowded long, segments long").collect()
    held = frozenset({("again", r["shard"]) for r in owners if r["again"]} | {("crowded", r["shard"]) for r in owners if r["crowded"]})
    arrays = 1 << min(24, max(0, int(sum(r["segments"] for r in owners) * (length + gram) // SHARD_BYTES).bit_length()))

    def send_segments(batches):
        regions: dict[bytes, tuple[int, int]] = {}
        places: list[np.ndarray] = []
        size = 0

        def out():
            nonlocal regions, places, size
            shard = np.array([s for s, _ in regions.values()], np.int64)
            where, names = np.concatenate(places), list(regions)
            order = np.argsort(shard[where[:, 0].astype(np.int64)], kind="stable")
            where = where[order]
            by = shard[where[:, 0].astype(np.int64)]
            bounds = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1], [True]]))
            rows = []
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                ids, new = np.unique(where[lo:hi, 0], return_inverse=True)
                block = where[lo:hi].copy()
                block[:, 0] = new
                rows.append((int(by[lo]), *packed([names[int(i)] for i in ids], block)))
            regions, places, size = {}, [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["shard", "segments", "about"])

        for b in slices(batches, 0, BATCH):
            for x in laid(b.column(0), length):
                h, lo, hi, _ = segments(x.text, x.starts, x.ends, length, gram)
                some = held_in(folder, "again", held, shards, h) & ~held_in(folder, "crowded", held, shards, h)
                h, lo, hi = h[some], lo[some], hi[some]
                if not len(h):
                    continue
                raw, shard = x.text.tobytes(), shard_of(h, arrays)
                ids = np.empty(len(h), np.uint64)
                for i, (s, a, z) in enumerate(zip(shard.tolist(), lo.tolist(), (hi + length).tolist(), strict=True)):
                    region = raw[a:z]
                    if region not in regions:
                        regions[region] = (s, len(regions))
                        size += z - a
                    ids[i] = regions[region][1]
                piece = np.searchsorted(x.ends, lo, "right")
                places.append(np.stack([ids, x.key[piece, 0], x.key[piece, 1], (x.offset[piece] + lo - x.starts[piece]).astype(np.uint64), x.times[piece].astype(np.uint64)], 1))
                if size > 4 * SHARD_BYTES:
                    yield out()
        if places:
            yield out()

    def sort_shard(table: pa.Table) -> pa.Table:
        ids: dict[bytes, int] = {}
        places = []
        for text, about in zip(table.column("segments").to_pylist(), table.column("about").to_pylist(), strict=True):
            regions, where = read_packed(text, about)
            own = np.array([ids.setdefault(r, len(ids)) for r in regions], np.uint64)
            where = where.copy()
            where[:, 0] = own[where[:, 0].astype(np.int64)]
            places.append(where)
        where = np.concatenate(places)
        del places
        which = where[:, 0].astype(np.int64)
        region, lo, hi = repeated_in(list(ids), np.bincount(which, weights=where[:, 4], minlength=len(ids)), length)
        where, which = (a[first] for first in [np.unique(where[:, :4], axis=0, return_index=True)[1]] for a in (where, which))
        # Each place of a region gets the region's intervals.
        count = np.bincount(region, minlength=len(ids))[which]
        first = np.searchsorted(region, which)
        i = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        where = where[np.repeat(np.arange(len(which)), count)]
        rows = sent(np.stack([where[:, 1], where[:, 2], where[:, 3] + lo[i].astype(np.uint64), where[:, 3] + hi[i].astype(np.uint64)], 1), shards)
        return pa.table({"shard": pa.array([r[0] for r in rows], pa.int32()), "intervals": pa.array([r[1] for r in rows], pa.binary())})

    def crowded_windows(x: Laid) -> tuple[np.ndarray, ...]:
        """Of the windows of crowded owners: where they are, and two hashes."""
        h, lo, hi, _ = segments(x.text, x.starts, x.ends, length, gram)
        some = held_in(folder, "crowded", held, shards, h)
        lo, n = lo[some], (hi - lo + 1)[some]
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        if not len(at):
            return at, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        roll = Rolling(x.text)
        return at, roll.of(length)[at], stirred(roll.of(length // 2)[at] + np.uint64(3) * roll.of(length - length // 2)[at + length // 2])

    def count_windows(batches):
        """Counts of window hashes by shard; those of the second hash go to as many shards more."""
        gathered = (Gathered(), Gathered())

        def out(k):
            b = emitted(shards, 64, *gathered[k].take())
            return pa.RecordBatch.from_arrays([pa.array([s + k * shards for s in b.column(0).to_pylist()], pa.int32()), b.column(1)], names=["shard", "packed"])

        for b in slices(batches, 0, BATCH):
            for x in laid(b.column(0), length):
                at, *hashes = crowded_windows(x)
                times = x.times[np.searchsorted(x.ends, at, "right")]
                for k, h in enumerate(hashes):
                    keys, inverse = np.unique(h, return_inverse=True)
                    if len(keys) and gathered[k].add(keys, np.bincount(inverse, weights=times, minlength=len(keys))):
                        yield out(k)
        for k in range(2):
            if gathered[k].size:
                yield out(k)

    def store_windows(table: pa.Table) -> pa.Table:
        s = table.column("shard")[0].as_py()
        keys, counts = unpacked(table.column("packed").to_pylist(), 1)
        kind, again = ("window", "other")[s // shards], keys[counts[:, 0] > 1]
        put(f"{folder}/{kind}-{s % shards}", again.astype("<u8").tobytes())
        return pa.table({"kind": pa.array([kind]), "shard": pa.array([s % shards], pa.int32()), "again": pa.array([len(again)], pa.int64())})

    def mark_windows(batches):
        """What the repeated windows of crowded owners cover, by text."""
        for b in slices(batches, 0, BATCH):
            rows = []
            for x in laid(b.column(0), length):
                at, first, second = crowded_windows(x)
                hit = held_in(folder, "window", met_again, shards, first)
                hit[hit] = held_in(folder, "other", met_again, shards, second[hit])
                at = at[hit]
                piece = np.searchsorted(x.ends, at, "right")
                piece, lo, hi = covered(at, piece, length)
                offset = x.offset[piece] - x.starts[piece]
                rows.append(np.stack([x.key[piece, 0], x.key[piece, 1], (lo + offset).astype(np.uint64), (hi + offset).astype(np.uint64)], 1))
            if rows and (found := sent(np.concatenate(rows), shards)):
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], pa.int32()), pa.array([r[1] for r in found], pa.binary())], names=["shard", "intervals"])

    def store_cuts(table: pa.Table) -> pa.Table:
        s = table.column("shard")[0].as_py()
        rows = joined_intervals(np.concatenate([np.frombuffer(zstandard.decompress(x), "<u8").reshape(4, -1).T for x in table.column("intervals").to_pylist()]))
        put(f"{folder}/cut-{s}", np.ascontiguousarray(rows.T).astype("<u8").tobytes())
        return pa.table({"shard": pa.array([s], pa.int32())})

    if not any(kind == "again" for kind, _ in held):
        return Cuts(folder, shards, frozenset())
    found = texts.mapInArrow(send_segments, SEGMENTS).groupBy("shard").applyInArrow(sort_shard, INTERVALS)
    if any(kind == "crowded" for kind, _ in held):
        windows = texts.mapInArrow(count_windows, "shard int, packed binary").groupBy("shard").applyInArrow(store_windows, "kind string, shard int, again long").collect()
        met_again = frozenset((r["kind"], r["shard"]) for r in windows if r["again"])
        found = found.unionByName(texts.mapInArrow(mark_windows, INTERVALS))
    stored = found.groupBy("shard").applyInArrow(store_cuts, "shard int").collect()
    return Cuts(folder, shards, frozenset(("cut", r["shard"]) for r in stored))


def cut(raw: bytes, spans: np.ndarray) -> bytes:
    parts, at = [], 0
    for a, z in spans.tolist():
        parts.append(raw[at:a])
        at = z
    return b"".join([*parts, raw[at:]])


def repeats_result(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cuts = find(own.select("text"), length, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            raws = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in b.column(1)]
            spans = cuts.of(np.array([key_of(r) for r in raws], np.uint64).reshape(-1, 2))
            columns = [
                b.column(0), pa.array([len(r) for r in raws], pa.int64()), pa.array([int((s[:, 1] - s[:, 0]).sum()) for s in spans], pa.int64()),
                pa.array([len(s) for s in spans], pa.int64()), pa.array([hashlib.sha256(cut(r, s)).hexdigest() for r, s in zip(raws, spans, strict=True)], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return own.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """docs with the repeated bytes cut out of text; a character cut in two is dropped. All columns."""
    cuts = find(docs.select("text"), length, **options)

    @F.pandas_udf("string")
    def kept(texts):
        def one(t):
            if t is None:
                return None
            raw = t.encode("utf-8", "surrogatepass")
            return cut(raw, cuts.of(np.array([key_of(raw)], np.uint64))[0]).decode("utf-8", "ignore")

        return texts.map(one)

    return docs.withColumn("text", kept("text"))
