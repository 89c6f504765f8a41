"""Toxicity by a support vector machine on a subsequence string kernel with Nyström landmarks.

The kernel of two letter windows counts their common subsequences of ORDER letters, each weighted down by the gaps in it
(Lodhi et al. 2002); `idxiot` and `id-iot` so stay near `idiot`. Its POWER-th power, a kernel as well, lets near matches
stand out from many faint ones. A window is up to WIDTH letters of a word, the word's start counting as a letter; longer
words have one window for each letter more, so no word is too long and no text is cut. Letters that stand apart
(`i d i o t`) are read together as well, digits and @ as the letters they look like, and other signs are passed over.

Landmarks are fragments (FRAGMENTS letters) of the labelled sample's words, of either class and whatever language the texts
are in. A fragment is a candidate if it is in significantly more texts of one class than of the other, by a test corrected
for the number of fragments. Among candidates, pivoted Cholesky steps on the kernel matrix choose: each takes the one of the
largest residual (leverage), weighed by its significance, until residuals are under RESIDUAL or `most` are chosen.

A word's value for a landmark is the largest kernel value of its windows; a text is the sum of its words' values over the
root of their number, mapped by the inverse root of the landmarks' kernel matrix (Nyström). A linear machine with squared
hinge loss judges it. Its decisions on texts that it was not fitted to (folds of the sample), together with the number of
words, are calibrated to probabilities. As the machine is linear, scoring needs one number a word.

The labelled sample is bounded: `per_class` documents of each class (those with the least hashes of doc_id) of `chars`
characters together, whole texts each, and at most `most` landmarks; all are parameters of `train`. Every text is scored
whole.

Defined cases: null and empty texts have no words and get the score of a text without evidence; a document with several
labels is toxic if one says so; without labelled texts of both classes every score is 0; repeated rows repeat; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearbox.llm.common import remainder

ORDER, DECAY, WIDTH, POWER = 3, 0.8, 8, 4
FRAGMENTS = range(4, WIDTH + 1)
RISK, RESIDUAL, COST = 0.01, 0.5, 10.0
THRESHOLD = 0.7
FOLDS = 5
PARTS = 8
#: Windows whose values are held at a time.
SLICE = 1 << 14
#: Symbols: not a letter, the start of a word, a letter that no landmark holds; the landmarks' letters follow.
NONE, START, OTHER = 0, 1, 2
START_MARK = "\n"
LOOKS = dict(zip("013457@", "oieasta", strict=True))
TRIPLES = list(combinations(range(WIDTH), ORDER))


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point what it is read as, 0 for what is passed over."""
    read = np.zeros(0x110000, np.uint32)
    own = np.array([k for k in range(0x110000) if chr(k).isalpha()], np.uint32)
    read[own] = own
    for sign, letter in LOOKS.items():
        read[ord(sign)] = ord(letter)
    read[ord(START_MARK)] = ord(START_MARK)
    return read


def points(words: list[str]) -> np.ndarray:
    """The letters of words as code points, a mark before each word."""
    raw = np.frombuffer((START_MARK + START_MARK.join(words)).encode("utf-32-le", "surrogatepass"), np.uint32) if words else np.zeros(0, np.uint32)
    read = letters()[raw]
    return read[read > 0]


def windows(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For words of these sizes (marks counted), written one after another: where windows start, and the first window of each word."""
    starts = np.cumsum(size) - size
    many = np.maximum(1, size - WIDTH + 1)
    first = np.cumsum(many) - many
    return np.repeat(starts - first, many) + np.arange(many.sum()), first


def explicit(fragment: str, ids: dict[str, int]) -> dict[int, float]:
    """The fragment's weighted subsequences, by code."""
    out: dict[int, float] = {}
    base = len(ids) + 3
    for t in combinations(range(len(fragment)), ORDER):
        code = 0
        for k in t:
            code = code * base + ids[fragment[k]]
        out[code] = out.get(code, 0.0) + DECAY ** (t[-1] - t[0] + 1)
    return out


class Kernel:
    """Values of words with landmarks, which are fragments (START_MARK stands for a word's start)."""

    def __init__(self, landmarks: tuple[str, ...]):
        self.landmarks = landmarks
        self.ids = {c: k + 3 for k, c in enumerate(sorted(set("".join(landmarks)) - {START_MARK}))} | {START_MARK: START}
        self.base = len(self.ids) + 3
        self.symbol = np.where(letters() > 0, OTHER, NONE).astype(np.int64)
        for c, k in self.ids.items():
            self.symbol[ord(c)] = k
        held = [explicit(f, self.ids) for f in landmarks]
        self.codes = np.array(sorted({c for h in held for c in h}), np.int64)
        at = {c: k for k, c in enumerate(self.codes.tolist())}
        self.weights = np.zeros((len(self.codes), len(landmarks)), np.float32)
        for k, h in enumerate(held):
            own = sum(v * v for v in h.values())
            for c, v in h.items():
                self.weights[at[c], k] = v / own
        self.table = None
        if self.base**ORDER <= 1 << 24:
            self.table = np.full(self.base**ORDER, -1, np.int32)
            self.table[self.codes] = np.arange(len(self.codes))
        self.gram = self.values(list(landmarks), marked=True)

    def find(self, codes: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table[codes]
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, at, -1)

    def values(self, words: list[str], marked: bool = False, onto: np.ndarray | None = None) -> np.ndarray:
        """Kernel values of words (rows) with landmarks, or their products with onto; marked: words bring their own marks."""
        out = np.zeros((len(words), len(self.landmarks)) if onto is None else len(words), np.float32)
        if not words or not self.landmarks:
            return out
        if marked:
            s, size = np.array([self.ids[c] for w in words for c in w], np.int64), np.array([len(w) for w in words])
        else:
            s = self.symbol[points(words)]
            size = np.diff(np.append(np.flatnonzero(s == START), len(s)))
        starts, first = windows(size)
        left = np.repeat(np.cumsum(size), np.diff(np.append(first, len(starts)))) - starts
        s = np.concatenate([s, np.zeros(WIDTH, np.int64)])
        carry = np.zeros(len(self.landmarks), np.float32)
        for part in range(0, len(starts), SLICE):
            to = min(len(starts), part + SLICE)
            i, j = np.searchsorted(first, part, "right") - 1, np.searchsorted(first, to)
            top = np.maximum.reduceat(self.of_windows(s, starts[part:to], left[part:to]), np.maximum(first[i:j] - part, 0), axis=0)
            if first[i] < part:  # the word began in the part before
                top[0] = np.maximum(top[0], carry)
            carry = top[-1]
            out[i:j] = top**POWER if onto is None else top**POWER @ onto
        return out

    def of_windows(self, s: np.ndarray, starts: np.ndarray, left: np.ndarray) -> np.ndarray:
        v = np.zeros((len(starts), len(self.landmarks)), np.float32)
        column = [np.where(left > k, s[starts + k], 0) for k in range(WIDTH)]
        for a, b, c in TRIPLES:
            at = self.find((column[a] * self.base + column[b]) * self.base + column[c])
            hit = np.flatnonzero(at >= 0)
            if len(hit):
                v[hit] += self.weights[at[hit]] * np.float32(DECAY ** (c - a + 1))
        return v


@dataclass(frozen=True)
class Model:
    landmarks: tuple[str, ...] = ()
    weights: tuple[float, ...] = ()
    calibration: tuple[float, ...] = (0.0, 0.0, 0.0)
    trained: bool = False

    def score(self, evidence: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Probabilities of texts by the sum of their words' evidence and the number of words."""
        if not self.trained:
            return np.zeros(len(evidence))
        return 1 / (1 + np.exp(-np.clip(described(evidence / scale(count), count) @ np.array(self.calibration), -50, 50)))


def scale(count: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(count, 1))


def described(decisions: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.stack([decisions, np.log1p(count), np.ones(len(decisions))], axis=1)


KERNELS: dict[tuple[str, ...], Kernel] = {}


def kernel(landmarks: tuple[str, ...]) -> Kernel:
    if landmarks not in KERNELS:
        KERNELS.clear()
        KERNELS[landmarks] = Kernel(landmarks)
    return KERNELS[landmarks]


def split(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of texts; for each occurrence its text and its word. Runs of three or more single letters count as a word too."""
    lowered = pc.utf8_lower(pa.array([t or "" for t in texts.to_pylist()], pa.large_string()))
    parts = pc.ascii_split_whitespace(lowered)
    coded = parts.flatten().dictionary_encode()
    names, index = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
    p = points(names)
    size = np.diff(np.append(np.flatnonzero(p == ord(START_MARK)), len(p))) - 1
    some = size[index] > 0 if len(index) else np.zeros(0, bool)
    index, owner = index[some], owner[some]
    single = np.concatenate([[False], size[index] == 1, [False]]) if len(index) else np.zeros(2, bool)
    begins, ends = np.flatnonzero(~single[:-1] & single[1:]), np.flatnonzero(single[:-1] & ~single[1:])
    runs, whose = [], []
    for i, j in zip(begins, ends, strict=True):
        for k in np.split(np.arange(i, j), np.flatnonzero(np.diff(owner[i:j])) + 1) if j - i >= 3 else []:
            if len(k) >= 3:
                runs.append("".join(names[index[m]] for m in k))
                whose.append(owner[k[0]])
    if runs:
        index, owner = np.concatenate([index, len(names) + np.arange(len(runs))]), np.concatenate([owner, np.array(whose, np.int64)])
    return names + runs, owner, index


def evidence(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """For each text the sum of its words' evidence, and their number."""
    names, owner, index = split(texts)
    count = np.bincount(owner, minlength=len(texts)).astype(float)
    if not model.landmarks or not len(index):
        return np.zeros(len(texts)), count
    own = kernel(model.landmarks).values(names, onto=np.array(model.weights, np.float32))
    return np.bincount(owner, own[index].astype(float), len(texts)), count


def fragments(names: list[str], owner: np.ndarray, index: np.ndarray, toxic: np.ndarray, risk: float) -> dict[str, float]:
    """Fragments that are in significantly more texts of one class, and how strongly (z)."""
    p = points(names)
    begins = np.flatnonzero(p == ord(START_MARK))
    word = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(p))))
    pairs = np.unique(owner * len(names) + index)  # each word once a text
    texts_of, words_of = pairs // len(names), pairs % len(names)
    order = np.argsort(words_of, kind="stable")
    texts_of, ends = texts_of[order], np.append(np.searchsorted(words_of[order], np.arange(len(names))), len(order))
    found: list[tuple[str, float]] = []
    tested = 0
    n, n1 = len(toxic), int(toxic.sum())
    with np.errstate(over="ignore"):
        for m in FRAGMENTS:
            at = np.arange(max(0, len(p) - m + 1))
            at = at[word[at] == word[at + m - 1]] if len(at) else at
            h = np.zeros(len(at), np.uint64)
            for k in range(m):
                h = (h ^ p[at + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            for part in range(PARTS):  # by hash, so that a part's occurrences fit the driver's memory
                own = at[h % np.uint64(PARTS) == part]
                keys, first, of = np.unique(h[h % np.uint64(PARTS) == part], return_index=True, return_inverse=True)
                many = ends[word[own] + 1] - ends[word[own]]
                run = np.repeat(ends[word[own]] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                both = np.unique(np.repeat(of, many) * n + texts_of[run])
                del run
                total = np.bincount(both // n, minlength=len(keys))
                bad = np.bincount(both // n, toxic[both % n], len(keys))
                tested += int((total > 1).sum())
                share = n1 / n
                z = (np.abs(bad - total * share) - 0.5) / np.sqrt(np.maximum(total * share * (1 - share) * (n - total) / max(n - 1, 1), 1e-9))
                for k in np.flatnonzero((z > 4) & (total > 3)):
                    found.append(("".join(map(chr, p[own[first[k]] : own[first[k]] + m])), float(z[k])))
    level = np.sqrt(2 * np.log(max(tested, 1) / risk))  # a bound on the normal quantile at risk / tested
    return {f: z for f, z in found if z > level}


def choose_landmarks(strength: dict[str, float], most: int, pool: int = 4096) -> tuple[str, ...]:
    """By pivoted Cholesky steps on the kernel matrix of the (strongest) candidates, weighed by their strength."""
    names = sorted(strength, key=lambda f: (-strength[f], f))[:pool]
    if not names:
        return ()
    weigh = np.array([strength[f] for f in names])
    own = Kernel(tuple(names))
    # The kernel itself, not its power, which would call all but equal fragments unlike; values are by the landmark's own one, so the normalised form is the geometric mean.
    gram = np.sqrt(own.gram * own.gram.T).astype(float) ** (1 / POWER)
    left, chosen, factors = np.ones(len(names)), [], np.zeros((len(names), 0))
    while len(chosen) < min(most, len(names)):
        k = int(np.argmax(np.where(left > RESIDUAL, left * weigh, -1)))
        if left[k] <= RESIDUAL:
            break
        f = (gram[:, k] - factors @ factors[k]) / np.sqrt(left[k])
        factors = np.column_stack([factors, f])
        left = left - f * f
        left[k] = 0
        chosen.append(names[k])
    return tuple(chosen)


def distinct(texts: list[str], toxic: np.ndarray) -> list[int]:
    """One text of each family of copies and class: families share the least hash of three words."""
    first = {}
    for i, text in enumerate(texts):
        w = text.lower().encode("utf-8", "surrogatepass").split()
        first.setdefault((min((zlib.crc32(b" ".join(w[k : k + 3])) for k in range(max(1, len(w) - 2))), default=0), bool(toxic[i])), i)
    return sorted(first.values())


def machine(x: np.ndarray, y: np.ndarray, cost: float = COST, rounds: int = 50) -> np.ndarray:
    """Weights of the linear machine with squared hinge loss (the last one is the bias), by Newton steps on the active rows."""
    x = np.column_stack([x, np.ones(len(x))])
    weight = cost * np.where(y > 0, (y < 0).sum() / max(1, (y > 0).sum()), 1.0) ** 0.5
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    active = np.ones(len(x), bool)
    for _ in range(rounds):
        a = x[active] * weight[active, None]
        w = np.linalg.solve(ridge + a.T @ x[active], a.T @ y[active])
        now = y * (x @ w) < 1
        if (now == active).all():
            break
        active = now
    return w


def logistic(x: np.ndarray, t: np.ndarray, share: np.ndarray, ridge: float = 1e-6) -> np.ndarray:
    """Weighted logistic regression with a small ridge, by Newton steps that are halved until the loss falls."""
    unit = np.where(x.std(0) > 1e-9, x.std(0), 1.0)
    x = x / unit

    def loss(w: np.ndarray) -> float:
        return float((share * np.logaddexp(0, np.where(t > 0, -1, 1) * (x @ w))).sum() + ridge * (w @ w) / 2)

    w, now = np.zeros(x.shape[1]), loss(np.zeros(x.shape[1]))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p) * share)[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ ((p - t) * share) + ridge * w)
        rate = 1.0
        while rate > 1e-6 and (to := loss(w - rate * step)) > now:
            rate /= 2
        if rate <= 1e-6 or now - to < 1e-12:
            break
        w, now = w - rate * step, to
    return w / unit


def fit(texts: list[str], toxic: np.ndarray, totals: tuple[int, int], most: int = 256, risk: float = RISK) -> Model:
    """totals: labelled documents of class 0 and 1, for the calibration."""
    own_texts = distinct(texts, toxic)
    texts, toxic = [texts[i] for i in own_texts], toxic[own_texts]
    if not toxic.any() or toxic.all():
        return Model()
    names, owner, index = split(pa.array(texts, pa.string()))
    count = np.bincount(owner, minlength=len(texts)).astype(float)
    landmarks = choose_landmarks(fragments(names, owner, index, toxic, risk), most) if names else ()
    y = np.where(toxic, 1.0, -1.0)
    # Each class weighs what it weighs among all labelled rows.
    share = np.where(toxic, totals[1] / toxic.sum(), totals[0] / (~toxic).sum()) / sum(totals)
    if not landmarks:
        return Model((), (), tuple(logistic(described(np.zeros(len(texts)), count), toxic.astype(float), share).tolist()), True)
    own = kernel(landmarks)
    values, sums = own.values(names), np.zeros((len(texts), len(landmarks)))
    for k in range(len(landmarks)):
        sums[:, k] = np.bincount(owner, values[index, k], len(texts))
    gram = (own.gram + own.gram.T).astype(float) / 2
    size, vectors = np.linalg.eigh(gram)
    root = vectors @ np.diag(np.maximum(size, 1e-2) ** -0.5) @ vectors.T
    x = (sums / scale(count)[:, None]) @ root
    spread = x.std() * np.sqrt(x.shape[1]) or 1.0
    fold = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) % FOLDS for t in texts])
    unseen = np.zeros(len(texts))
    for k in range(FOLDS):
        if toxic[fold != k].any() and not toxic[fold != k].all():
            w = machine(x[fold != k] / spread, y[fold != k])
            unseen[fold == k] = x[fold == k] / spread @ w[:-1]
    w = machine(x / spread, y)
    calibration = logistic(described(unseen, count), toxic.astype(float), share)
    return Model(landmarks, tuple((root @ (w[:-1] / spread)).tolist()), tuple(calibration.tolist()), True)


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1500, most: int = 256, chars: int = 16_000_000) -> Model:
    """Learns from the labelled rows whose crc32 remainder by 3 isn't 1; the sample is per_class documents a class."""
    own = (
        labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).filter("id is not null and toxic is not null").filter(remainder(F.col("id"), 3) != 1)
        .groupBy("id").agg(F.max("toxic").alias("toxic"))
    )
    totals = {int(r["toxic"]): r["count"] for r in own.groupBy("toxic").count().collect()}
    if not totals.get(0) or not totals.get(1):
        return Model()
    h = F.pmod(F.xxhash64(F.lit("toxic"), "id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rate = F.when(F.col("toxic") == 1, F.lit(4.0 * per_class / totals[1])).otherwise(F.lit(4.0 * per_class / totals[0]))
    few = own.withColumn("h", h).filter(F.col("h") <= rate)
    few = few.withColumn("n", F.row_number().over(Window.partitionBy("toxic").orderBy("h", "id"))).filter(F.col("n") <= per_class)
    # At most 2 * per_class rows are broadcast, so no text but theirs is moved.
    texts = docs.select("doc_id", "text").join(F.broadcast(few), F.col("doc_id") == F.col("id")).groupBy("id", "toxic", "h").agg(F.min("text").alias("text"))
    upto = F.sum(F.coalesce(F.length("text"), F.lit(0))).over(Window.partitionBy("toxic").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, 0))
    rows = texts.withColumn("upto", upto - F.coalesce(F.length("text"), F.lit(0))).filter(F.col("upto") < chars).orderBy("id").select("toxic", "text").collect()
    return fit([r["text"] or "" for r in rows], np.array([r["toxic"] == 1 for r in rows], bool), (totals[0], totals[1]), most)


def assess(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    schema = "doc_id long, held_out boolean, score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(*evidence(b.column(2), model))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "text").mapInArrow(run, schema)


def toxicity_result(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return assess(docs, train(docs, labels))
