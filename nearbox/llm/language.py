"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of its labelled text. A new text is parsed from the
left into phrases, each the longest match from there on in the language's sample; the automaton gives match lengths one
character at a time. The more a text resembles a language, the fewer phrases it needs: phrases * log2(sample) / length is
an estimate of the cross entropy, and the language with the least wins.

Every letter of the samples has a code of its own. Transitions by the commonest letters are dense arrays, those by rarer
ones (most of a large alphabet) a sorted list; whatever stands between words counts as one gap. Texts are cut into pieces of
`PIECE` characters, all of them parsed, and all pieces of a batch step through the automata of all languages together,
so a step is a few array operations whatever the texts.

The sample is bounded by `docs_per_lang` documents (those with the least hashes of doc_id) and `sample_chars` characters
per language, parameters of `train`; it does not grow with the corpus.

`keep_known` rejects what is in no learned language: texts without a letter, and those whose cheapest parse costs more bits
than writing their letters out plainly would (a byte a letter, two where the samples hold over 200 letters). Random
letters cost more than that, text of a learned language about a third. Texts of under LEAST_LETTERS letters are too short
to tell and stay. Where a row has no lang the prediction is filled in.

Defined cases: a text that is null or has no letter is `und` with score 0, as is every text where no labelled text
exists (`keep_known` then keeps every text with a letter); ties go to the language first in order; repeated rows repeat;
other columns are ignored by `identify` and kept by `keep_known`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearbox.llm.common import remainder
from nearbox.llm.perplexity import slices

WIDTH, PIECE, BATCH = 64, 1024, 2_000_000
#: Codes: 0 ends a sample text, 1 is any letter that no sample has, 2 is a run of anything but letters; those from WIDTH on
#: have sparse transitions.
SEPARATOR, OTHER, GAP = 0, 1, 2
LEAST_LETTERS = 20


@dataclass(frozen=True)
class Model:
    """What workers need: the sample itself, from which each worker process builds its automata once."""

    samples: tuple[tuple[str, tuple[str, ...]], ...]


def suffix_automaton(codes: np.ndarray) -> tuple[np.ndarray, int]:
    """Transitions as rows (state, code, to), and the number of states; state 0 is the start."""
    link, length, edges, last = [-1], [0], [{}], 0
    for c in codes.tolist():
        cur = len(link)
        length.append(length[last] + 1)
        link.append(0)
        edges.append({})
        p = last
        while p != -1 and c not in edges[p]:
            edges[p][c] = cur
            p = link[p]
        if p != -1:
            q = edges[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(link)
                length.append(length[p] + 1)
                link.append(link[q])
                edges.append(dict(edges[q]))
                while p != -1 and edges[p].get(c) == q:
                    edges[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    rows = [(state, c, to) for state, out in enumerate(edges) for c, to in out.items()]
    return np.array(rows, np.int32).reshape(-1, 3), len(edges)


class Parser:
    def __init__(self, model: Model):
        counts = Counter()
        for _, texts in model.samples:
            for t in texts:
                counts.update(t.lower())
        self.codes = np.fromiter((OTHER if chr(c).isalpha() else GAP for c in range(0x110000)), np.int32, 0x110000)
        letters = [(c, n) for c, n in counts.items() if c.isalpha()]
        for n, (c, _) in enumerate(sorted(letters, key=lambda x: (-x[1], x[0]))):
            self.codes[ord(c)] = n + 3
        self.size = len(letters) + 3
        self.plain = 8.0 if len(letters) <= 200 else 16.0  #: bits of a letter written out
        self.langs = [lang for lang, _ in model.samples]
        if not self.langs:
            return
        self.width = min(WIDTH, self.size)
        parts, self.roots, sizes, at = [], [], [], 0
        for _, texts in model.samples:
            sample = np.concatenate([x for t in texts for x in (self.encoded(t.lower()), np.array([SEPARATOR], np.int32))])
            rows, states = suffix_automaton(sample)
            parts.append(rows.astype(np.int64) + np.array([at, 0, at]))
            self.roots.append(at)
            sizes.append(max(2, len(sample)))
            at += states
        rows = np.concatenate(parts)
        self.roots = np.array(self.roots, np.int64)
        dense = rows[:, 1] < self.width
        self.table = np.full(at * self.width, -1, np.int32)
        self.table[rows[dense, 0] * self.width + rows[dense, 1]] = rows[dense, 2]
        rare = rows[~dense]
        keys = rare[:, 0] * self.size + rare[:, 1]
        order = np.argsort(keys)
        #: The sparse transitions, closed by a key that no state has.
        self.keys, self.targets = np.append(keys[order], np.iinfo(np.int64).max), np.append(rare[order, 2], -1).astype(np.int32)
        first = self.step(np.repeat(self.roots[:, None], self.size, 1), np.arange(self.size))
        #: Where a phrase that begins with a character leads; a character that the sample lacks is a phrase of its own.
        self.first = np.where(first >= 0, first, self.roots[:, None]).astype(np.int32)
        self.log_sizes = np.log2(np.array(sizes, float))

    def step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Where codes lead from states (languages by codes), -1 for nowhere."""
        to = self.table[state * np.int64(self.width) + np.minimum(c, self.width - 1)]
        rare = np.flatnonzero(c >= self.width) if len(self.keys) > 1 else ()
        if len(rare):
            wanted = state[:, rare] * np.int64(self.size) + c[rare]
            at = np.searchsorted(self.keys, wanted)
            to[:, rare] = np.where(self.keys[at] == wanted, self.targets[at], -1)
        return to

    def encoded(self, text: str) -> np.ndarray:
        c = self.codes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        return c[np.concatenate([[True], (c[1:] != GAP) | (c[:-1] != GAP)])] if len(c) else c

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases by text and language."""
        parts = [self.encoded(t) for t in texts]
        sizes = np.array([len(p) for p in parts], np.int64)
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        if not sizes.sum():
            return out
        flat = np.concatenate(parts)
        pieces = -(-sizes // PIECE)
        owner = np.repeat(np.arange(len(texts)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = np.repeat(np.cumsum(sizes) - sizes, pieces) + nth * PIECE
        length = np.minimum(PIECE, np.repeat(sizes, pieces) - nth * PIECE)
        order = np.argsort(-length, kind="stable")
        owner, start, length = owner[order], start[order], length[order]
        state = np.repeat(self.roots[:, None], len(owner), 1).astype(np.int32)
        count = np.ones(state.shape, np.int64)
        active = np.searchsorted(-length, -np.arange(int(length[0])), side="left")
        for t, n in enumerate(active.tolist()):
            c = flat[start[:n] + t]
            to = self.step(state[:, :n], c)
            end = to < 0
            count[:, :n] += end
            state[:, :n] = np.where(end, self.first[:, c], to)
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(owner, weights=count[k], minlength=len(texts))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores, _ = self.judged(texts)
        return langs, scores

    def judged(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language and score of each text, and whether it reads as text of a learned language at all."""
        langs, scores, reads = ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts)
        lettered = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        if not self.langs:
            for i in lettered:
                reads[i] = True
            return langs, scores, reads
        for lo in self.batches(texts, lettered):
            lowered = [texts[i].lower() for i in lo]
            cost = self.phrases(lowered) * self.log_sizes
            entropy = cost / np.array([max(1, len(t)) for t in lowered])[:, None]
            best = entropy.argmin(1)
            ranked = np.sort(entropy, 1)
            other = ranked[:, 1] if len(self.langs) > 1 else np.full(len(lo), np.inf)
            for k, i in enumerate(lo):
                langs[i] = self.langs[best[k]]
                # From a half (undecided) to 1 as the runner-up needs more.
                scores[i] = 1.0 if np.isinf(other[k]) else float(other[k] / (other[k] + ranked[k, 0]))
                letters = int((self.encoded(lowered[k]) != GAP).sum())
                reads[i] = letters < LEAST_LETTERS or bool(cost[k].min() <= self.plain * letters)
        return langs, scores, reads

    @staticmethod
    def batches(texts: list[str | None], which: list[int]) -> Iterator[list[int]]:
        batch, size = [], 0
        for i in which:
            batch.append(i)
            size += len(texts[i])
            if size >= BATCH:
                yield batch
                batch, size = [], 0
        if batch:
            yield batch


PARSERS: dict[Model, Parser] = {}


def parser(model: Model) -> Parser:
    """This process's parser for a model."""
    if model not in PARSERS:
        PARSERS.clear()
        PARSERS[model] = Parser(model)
    return PARSERS[model]


def train(docs: DataFrame, docs_per_lang: int = 40, sample_chars: int = 24_000) -> Model:
    """The sample of each language among the labelled rows of docs (doc_id, text, lang)."""
    own = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id"), 4) != 2))
    h = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    counts = own.groupBy("lang").count()
    # Four times as many as wanted by chance, then exactly the first of them: no task sorts a whole language. The counts
    # have a row for each language, less than the samples gathered below, so they are broadcast and no text is shuffled.
    few = own.withColumn("h", h).join(F.broadcast(counts), "lang").filter(F.col("h") * F.col("count") <= 4.0 * docs_per_lang)
    few = few.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).filter(F.col("n") <= docs_per_lang)
    rows = few.select("lang", "n", F.substring("text", 1, sample_chars).alias("text")).collect()
    samples: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["n"])):
        samples.setdefault(r["lang"], []).append(r["text"])
    chosen = []
    for lang, texts in samples.items():
        share, room, taken = max(1, sample_chars // min(len(texts), docs_per_lang // 2)), sample_chars, []
        for t in texts:
            taken.append(t[: min(share, room)])
            room -= len(taken[-1])
            if room <= 0:
                break
        chosen.append((lang, tuple(taken)))
    return Model(tuple(chosen))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs."""
    schema = "doc_id long, held_out boolean, lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = parser(model)
        for b in slices(batches, 2, BATCH):
            langs, scores = p.predict(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "text").mapInArrow(run, schema)


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose text reads as some learned language, all columns; a null lang is filled by the prediction."""
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = parser(model)
        for b in slices(batches, at, BATCH):
            found, _, reads = p.judged(b.column(at).to_pylist())
            if "lang" in names and model.samples:
                k = names.index("lang")
                b = b.set_column(k, b.schema.field(k), pc.coalesce(b.column(k), pa.array(found, pa.string()).cast(b.column(k).type)))
            yield b.filter(pa.array(reads, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def language_result(docs: DataFrame) -> DataFrame:
    return identify(docs, train(docs))
