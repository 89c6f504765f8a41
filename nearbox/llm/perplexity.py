"""Language-model scoring: an interpolated modified Kneser-Ney model counted in Spark, stored as sorted hash arrays.

Three passes over the texts, none of which moves single tokens:

1. Words are counted within a batch; the batch's distinct hashes and counts go to the shard of the hash's leading bits,
   packed. Each shard is merged to a sorted array of hashes with counts; a word's place over all shards is its id.
2. Pairs of ids are counted the same way. A pair becomes one number, stirred by a bijection, so a shard holds a fair
   share of any word's pairs: no word, however common, makes a large shard. Shards return the counts of counts and, by
   word, what they add to its totals as a context and to the number of contexts it follows.
3. Workers memory-map the arrays and score each batch's distinct pairs.

The arrays lie in the session's shared folder. Counts are exact at any size (a shard with a count beyond 32 bits stores 64),
and a vocabulary whose pairs don't fit 64 bits (over four billion words) is refused. The model has order 2: with p(w) the continuation probability, discounted
and interpolated with the uniform one over the known words and one unknown,
p(w | u) = max(c(u,w) - D(c(u,w)), 0) / c(u) + gamma(u) p(w), with modified Kneser-Ney's three discounts at either level.

Defined cases: a null text is empty and has only its end; texts are whole whatever their length; with no training text
every probability is that of one unknown word; repeated rows count each time; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearbox.llm.common import remainder
from nearbox.llm.shared_arrays import forget, merged, opened, pack, put, shards_for, unpacked
from nearbox.session import new_shared_path, written

#: No word can be this: it has white space.
END = xxhash.xxh64_intdigest(b"\n", 1)
ROOM = 2_000_000
#: Counts from here on are stored in 64 bits.
NARROW = 1 << 32


def coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words; then for each word in the texts its number in them, and its text."""
    # Built anew: Arrow's string functions misread the offsets of a slice that is cast.
    texts = pa.array([t or "" for t in texts.to_pylist()], pa.large_string())
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    d = split.flatten().dictionary_encode()
    names = d.dictionary.cast(pa.large_binary()).to_pylist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in names), np.uint64, len(names))
    index, owner = d.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    if b"" in names:
        some = index != names.index(b"")
        index, owner = index[some], owner[some]
    return hashes, index, owner


def with_ends(ids: np.ndarray, owner: np.ndarray, n: int, begin: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """previous, current, text of each token: the words of n texts, each text with its end."""
    at = np.arange(len(ids)) + owner
    size = np.bincount(owner, minlength=n) + 1
    ends = np.cumsum(size) - 1
    current = np.empty(len(ids) + n, np.int64)
    current[at], current[ends] = ids, end
    previous = np.empty_like(current)
    previous[1:] = current[:-1]
    previous[ends - size + 1] = begin
    return previous, current, np.repeat(np.arange(n), size)


@dataclass(frozen=True)
class Stir:
    """A bijection on numbers below 2**bits."""

    bits: int

    def of(self, x: np.ndarray) -> np.ndarray:
        mask, half = np.uint64((1 << self.bits) - 1), np.uint64(self.bits // 2)
        x = x ^ (x >> half)
        x = (x * np.uint64(0x9E3779B97F4A7C15)) & mask
        return x ^ (x >> half)

    def back(self, x: np.ndarray) -> np.ndarray:
        mask, half = np.uint64((1 << self.bits) - 1), np.uint64(self.bits // 2)
        undo = lambda y: y ^ (y >> half) ^ (y >> (half + half))
        x = undo(x)
        x = (x * np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))) & mask
        return undo(x)


@dataclass(frozen=True)
class Model:
    folder: str
    shards: int
    starts: tuple[int, ...]  #: of each vocabulary shard, the first id
    total: int  #: training tokens, ends among them
    distinct: int
    pair_discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    word_discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    word_kinds: tuple[int, int, int] = (0, 0, 0)  #: words that follow 1, 2, 3 or more contexts
    pairs: int = 0
    held: frozenset[tuple[str, int]] = frozenset()  #: kinds of array and the shards that have one
    wide: frozenset[tuple[str, int]] = frozenset()  #: those whose numbers take 64 bits where others take 32

    @property
    def begin(self) -> int:
        return self.distinct

    @property
    def unknown(self) -> int:
        return self.distinct + 1

    @property
    def base(self) -> int:
        return self.distinct + 2

    @property
    def stir(self) -> Stir:
        if (bits := (self.base**2).bit_length()) > 64:
            raise OverflowError(f"pairs of {self.base} words don't fit 64 bits")
        return Stir(max(16, bits))

    def find(self, kind: str, keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """For sorted keys, the place in its shard of each, or -1; and the shard."""
        shard = (keys >> np.uint64(bits - self.shards.bit_length() + 1)).astype(np.int64)
        bounds = np.searchsorted(shard, np.arange(self.shards + 1))
        place = np.full(len(keys), -1, np.int64)
        for s in np.flatnonzero(np.diff(bounds)).tolist():
            lo, hi = bounds[s], bounds[s + 1]
            held = opened(f"{self.folder}/{kind}-{s}", "<u8") if lo < hi and (kind, s) in self.held else ()
            if len(held):
                p = np.minimum(np.searchsorted(held, keys[lo:hi]), len(held) - 1)
                place[lo:hi] = np.where(held[p] == keys[lo:hi], p, -1)
        return place, shard

    def gather(self, name: str, dtype: str, place: np.ndarray, shard: np.ndarray) -> np.ndarray:
        """Values at places, 0 where the place is -1; shard is in order."""
        out = np.zeros(len(place), np.int64)
        bounds = np.searchsorted(shard, np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(bounds)).tolist():
            lo, hi = bounds[s], bounds[s + 1]
            if (known := place[lo:hi] >= 0).any():
                out[lo:hi][known] = opened(f"{self.folder}/{name}-{s}", "<u8" if (name, s) in self.wide else dtype)[place[lo:hi][known]]
        return out

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and training counts of words by hash; unknown ones have the id `unknown` and count 0."""
        order = np.argsort(hashes)
        place, shard = self.find("word", hashes[order], 64)
        ids, counts = np.empty(len(hashes), np.int64), np.empty(len(hashes), np.int64)
        ids[order] = np.where(place >= 0, np.array(self.starts, np.int64)[shard] + place, self.unknown)
        counts[order] = self.gather("count", "<u8", place, shard)
        return ids, counts

    def by_id(self, ids: np.ndarray) -> np.ndarray:
        """Five columns for each id in order: total, kinds 1, 2, 3+, contexts. Unknown words have zeros."""
        out = np.zeros((len(ids), 5), np.int64)
        known = ids <= self.begin
        span = -(-(self.distinct + 1) // self.shards)
        shard = ids[known] // span
        bounds, rows = np.searchsorted(shard, np.arange(self.shards + 1)), np.flatnonzero(known)
        for s in np.flatnonzero(np.diff(bounds)).tolist():
            lo, hi = bounds[s], bounds[s + 1]
            if ("context", s) in self.held:
                table = opened(f"{self.folder}/context-{s}", "<u8").reshape(-1, 5)
                out[rows[lo:hi]] = table[ids[known][lo:hi] - s * span]
        return out

    def log10(self, previous: np.ndarray, current: np.ndarray) -> np.ndarray:
        """log10 p(current | previous) by ids."""
        pair, inverse = np.unique(previous.astype(np.uint64) * np.uint64(self.base) + current.astype(np.uint64), return_inverse=True)
        u, w = (pair // np.uint64(self.base)).astype(np.int64), (pair % np.uint64(self.base)).astype(np.int64)
        stirred = self.stir.of(pair)
        order = np.argsort(stirred)
        place, shard = self.find("pair", stirred[order], self.stir.bits)
        count = np.empty(len(pair), np.int64)
        count[order] = self.gather("pairs", "<u4", place, shard)
        # u is in order already; w by its own distinct values.
        context = self.by_id(u)
        ws, back = np.unique(w, return_inverse=True)
        follows = self.by_id(ws)[:, 4][back]
        p = self.continuation(follows)
        d = np.array((0.0, *self.pair_discounts))
        total, kinds = context[:, 0], context[:, 1:4]
        gamma = kinds @ d[1:]
        seen = total > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            p = np.where(seen, (np.maximum(count - d[np.minimum(count, 3)], 0) + gamma * p) / total, p)
        return np.log10(p)[inverse]

    def continuation(self, follows: np.ndarray) -> np.ndarray:
        if not self.pairs:
            return np.full(len(follows), 1.0 / (self.distinct + 1))
        d = np.array((0.0, *self.word_discounts))
        gamma = np.dot(self.word_discounts, self.word_kinds) / self.pairs
        return np.maximum(follows - d[np.minimum(follows, 3)], 0) / self.pairs + gamma / (self.distinct + 1)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Of counts of counts n1 to n4 (Chen and Goodman 1999); where one is zero, a half of the count at most."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    raw = (1 - 2 * y * n2 / n1 if n1 and n2 else 0.5, 2 - 3 * y * n3 / n2 if n2 and n3 else 1.0, 3 - 4 * y * n4 / n3 if n3 and n4 else 1.5)
    return tuple(float(min(max(d, 0.05), k + 0.95)) for k, d in enumerate(raw))


def emitted(shards: int, bits: int, keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    shard = keys >> np.uint64(bits - shards.bit_length() + 1)
    bounds = np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))
    some = [s for s in range(shards) if bounds[s] < bounds[s + 1]]
    blobs = [pack(keys[bounds[s] : bounds[s + 1]], values[bounds[s] : bounds[s + 1]]) for s in some]
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(blobs, pa.binary())], names=["shard", "packed"])


class Gathered:
    """Keys and counts of batches, merged when there are many."""

    def __init__(self):
        self.keys, self.counts, self.size = [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> bool:
        self.keys.append(keys)
        self.counts.append(counts.astype(np.uint64))
        self.size += len(keys)
        return self.size > ROOM

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = merged(np.concatenate(self.keys), np.concatenate(self.counts)[:, None]) if self.keys else (np.zeros(0, np.uint64), np.zeros((0, 1), np.uint64))
        self.__init__()
        return out


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Batches of about `most` bytes of text."""
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).cumsum()
        cuts = np.flatnonzero(np.diff(size // most)) + 1 if len(size) else []
        for lo, hi in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
            yield b.slice(lo, hi - lo)


def train(texts: DataFrame, shards: int | None = None) -> Model:
    """texts: one column, text, of the training rows."""
    spark = texts.sparkSession
    if shards is None:
        shards = shards_for(texts)
    folder = new_shared_path(spark, "lm")

    def count_words(batches):
        forget(folder)
        g = Gathered()
        for b in slices(batches, 0):
            hashes, index, _ = coded(b.column(0))
            counts = np.bincount(index, minlength=len(hashes))
            hashes, counts = np.append(hashes[counts > 0], np.uint64(END)), np.append(counts[counts > 0], b.num_rows)
            if g.add(hashes, counts):
                yield emitted(shards, 64, *g.take())
        if g.size:
            yield emitted(shards, 64, *g.take())

    def store_words(table: pa.Table) -> pa.Table:
        s = table.column("shard")[0].as_py()
        keys, counts = unpacked(table.column("packed").to_pylist(), 1)
        put(f"{folder}/word-{s}", keys.astype("<u8").tobytes())
        put(f"{folder}/count-{s}", counts.astype("<u8").tobytes())
        return pa.table({"shard": pa.array([s], pa.int32()), "n": pa.array([len(keys)], pa.int64()), "total": pa.array([int(counts.sum())], pa.int64())})

    found = {r["shard"]: r for r in texts.mapInArrow(count_words, "shard int, packed binary").groupBy("shard").applyInArrow(store_words, "shard int, n long, total long").collect()}
    sizes = [found[s]["n"] if s in found else 0 for s in range(shards)]
    starts = tuple(int(x) for x in np.concatenate([[0], np.cumsum(sizes)[:-1]]))
    model = Model(folder, shards, starts, sum(r["total"] for r in found.values()), sum(sizes), held=frozenset(("word", s) for s in found))
    if not found:
        return model

    def count_pairs(batches):
        g, end, stir = Gathered(), int(model.ids(np.array([END], np.uint64))[0][0]), model.stir
        for b in slices(batches, 0):
            hashes, index, owner = coded(b.column(0))
            previous, current, _ = with_ends(model.ids(hashes)[0][index], owner, b.num_rows, model.begin, end)
            pair, n = np.unique(previous.astype(np.uint64) * np.uint64(model.base) + current.astype(np.uint64), return_counts=True)
            if g.add(stir.of(pair), n):
                yield emitted(shards, stir.bits, *g.take())
        if g.size:
            yield emitted(shards, stir.bits, *g.take())

    span = -(-(model.distinct + 1) // shards)

    def store_pairs(table: pa.Table) -> pa.Table:
        forget(folder)
        s = table.column("shard")[0].as_py()
        keys, counts = unpacked(table.column("packed").to_pylist(), 1)
        counts = counts[:, 0]
        put(f"{folder}/pair-{s}", keys.astype("<u8").tobytes())
        wide = counts.max(initial=0) >= NARROW
        put(f"{folder}/pairs-{s}", counts.astype("<u8" if wide else "<u4").tobytes())
        pair = model.stir.back(keys)
        u, w = pair // np.uint64(model.base), pair % np.uint64(model.base)
        zero, one = np.zeros(len(keys), np.uint64), np.ones(len(keys), np.uint64)
        as_context = np.stack([counts, counts == 1, counts == 2, counts > 2, zero], 1).astype(np.uint64)
        as_word = np.stack([zero, zero, zero, zero, one], 1)
        ids, values = merged(np.concatenate([u, w]), np.concatenate([as_context, as_word]))
        bounds = np.searchsorted(ids, np.arange(shards + 1, dtype=np.uint64) * np.uint64(span))
        rows = [(t, pack(ids[bounds[t] : bounds[t + 1]], values[bounds[t] : bounds[t + 1]]), None) for t in range(shards) if bounds[t] < bounds[t + 1]]
        rows.append((-1 - s, None, [int((counts == k).sum()) for k in (1, 2, 3, 4)] + [len(keys), int(wide)]))
        return pa.table({"shard": pa.array([r[0] for r in rows], pa.int32()), "packed": pa.array([r[1] for r in rows], pa.binary()), "kinds": pa.array([r[2] for r in rows], pa.list_(pa.int64()))})

    parts = written(texts.mapInArrow(count_pairs, "shard int, packed binary").groupBy("shard").applyInArrow(store_pairs, "shard int, packed binary, kinds array<long>"), "lm-contexts")
    of_pairs = parts.filter("shard < 0").select("shard", "kinds").collect()
    kinds = np.array([r["kinds"] for r in of_pairs], np.int64).sum(0)

    def store_contexts(table: pa.Table) -> pa.Table:
        s = table.column("shard")[0].as_py()
        ids, values = unpacked(table.column("packed").to_pylist(), 5)
        rows = np.zeros((min(span, model.distinct + 1 - s * span), 5), "<u8")
        rows[(ids - np.uint64(s * span)).astype(np.int64)] = values
        put(f"{folder}/context-{s}", rows.tobytes())
        n = rows[:, 4]
        return pa.table({"shard": pa.array([s], pa.int32()), "kinds": pa.array([[int((n == k).sum()) for k in (1, 2, 3, 4)] + [int((n > 2).sum())]], pa.list_(pa.int64()))})

    stored = parts.filter("shard >= 0").select("shard", "packed").groupBy("shard").applyInArrow(store_contexts, "shard int, kinds array<long>").collect()
    words = np.array([r["kinds"] for r in stored], np.int64).sum(0)
    return Model(
        folder, shards, starts, model.total, model.distinct, discounts(kinds[:4].tolist()), discounts(words[:4].tolist()), (int(words[0]), int(words[1]), int(words[4])), int(kinds[4]),
        model.held | {("pair", -1 - r["shard"]) for r in of_pairs} | {("context", r["shard"]) for r in stored},
        frozenset(("pairs", -1 - r["shard"]) for r in of_pairs if r["kinds"][5]),
    )


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, ... for each row of docs (doc_id, held_out, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, end_count = (int(x[0]) for x in model.ids(np.array([END], np.uint64)))
        for b in slices(batches, 2):
            n = b.num_rows
            hashes, index, owner = coded(b.column(2))
            ids, counts = model.ids(hashes)
            previous, current, text = with_ends(ids[index], owner, n, model.begin, end)
            _, times, _ = with_ends(counts[index], owner, n, 0, end_count)
            base = np.log10((times + 1.0) / (model.total + model.distinct + 1.0))
            by_text = lambda x, text=text, n=n: np.bincount(text, weights=x, minlength=n)
            size, own = np.bincount(text, minlength=n), by_text(model.log10(previous, current))
            columns = [b.column(0), b.column(1), pa.array(size, pa.int64()), pa.array(by_text(times > 0).astype(np.int64)), pa.array(np.full(n, model.total), pa.int64()), pa.array(by_text(base)), pa.array(own), pa.array(10.0 ** (-own / np.maximum(size, 1)))]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, SCHEMA)


def perplexity_result(docs: DataFrame) -> DataFrame:
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(F.col("doc_id"), 7) == 2).alias("held_out"), "text")
    return score(own, train(own.filter(~F.col("held_out")).select("text")))
