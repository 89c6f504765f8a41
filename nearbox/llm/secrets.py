"""Secret scans by assignment-aware lexing.

Three base patterns (assignments to a few well-known names, access key ids, long hex runs) are found in every text. On
top of them a text is lexed into name-literal pairs, by families of syntax:

* assignments of code and configuration: a name, an operator (= : := => +=) and an expression, whose terms are strings
  (plain, triple, backticks, prefixed), bare words and names, joined by + . .. & or by standing side by side, over lines
  where an operator or an open bracket says so; a type between name and value (`name: str = "x"`) is passed over;
* YAML block scalars (`name: |` and the lines indented below);
* XML elements (`<name>literal</name>`) and key-value attributes (`key="name" value="literal"`);
* command lines (`--name literal`) and headers (`Authorization: Bearer literal`);
* names and literals side by side as arguments (`set("name", "literal")`).

Pairs are taken in the order of the text. A term that is a name stands for what that name holds there: its latest
assignment before, or its first one after where there is none before. So constants are propagated through copies and
joins, and a later value of the same name is not mistaken for the one that was copied. The joined value is scored by the
words of its name (db_password, clientSecret, auth-token) times how random it looks; placeholders, references to
variables, paths and prose score 0. A value that scores gives a span for each literal it is made of, of any length.

Kinds, in the order used for spans that begin together: assign, access, hex (base), literal (a scored literal at its own
name), constant (a literal that a sensitive name reaches through other names). Positions are code points, end exclusive.

Defined cases: a null text is empty and has no spans; rows are independent, so repeated rows repeat; other columns are
kept by `redact` and ignored by `scan`.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearbox.llm.perplexity import slices

#: Bytes of text that a worker has in hand at a time.
BATCH = 2_000_000
KINDS = ("assign", "access", "hex", "literal", "constant")

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
#: Greedy runs with a least length, so each is the whole run.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")

OPERATOR = re.compile(r"(?<![:=!<>*/%^|&-])(?::=|=>|\+=|=|:)(?![:=/~])")
NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-")
STRING = re.compile(
    r"[rRbBuUfF]{0,2}(?:\"{3}((?:[^\"\\]|\\.|\"(?!\"\"))*+)\"{3}|'{3}((?:[^'\\]|\\.|'(?!''))*+)'{3}|\"((?:[^\"\\\n]|\\.)++)\"|'((?:[^'\\\n]|\\.)++)'|`((?:[^`\\]|\\.)++)`)", re.DOTALL
)
BARE = re.compile(r"[^\s,;\"'`(){}\[\]<>]+")
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*")
BLANK = re.compile(r"(?:[\x20\t]|\\\r?\n)*")
BLANK_LINES = re.compile(r"\s*")
JOIN = re.compile(r"(?:[\x20\t]|\\\r?\n)*(?:\r?\n[\x20\t]*)?(\+(?![+=])|\.{1,2}(?=\s*[\"'])|&(?!&))\s*")
ANNOTATED = re.compile(r"[\x20\t]*=(?![=>~])")
SCHEMES = frozenset({"bearer", "basic", "token"})
BLOCK = re.compile(r"[\x20\t]*[|>][+-]?[1-9]?[+-]?[\x20\t]*(?:#[^\n]*)?\r?\n")
ELEMENT = re.compile(r"<([A-Za-z_][A-Za-z0-9_.:-]*)(?:\s[^<>]*+)?>([^<>]*+)</\1\s*>")
KEYED = re.compile(r"<[A-Za-z][^<>]*?\s(?:key|name)\s*=\s*[\"']([^\"'<>]+)[\"'][^<>]*?\svalue\s*=\s*(?:\"([^\"<>]*)\"|'([^'<>]*)')")
OPTION = re.compile(r"(?<!\S)--?([A-Za-z][A-Za-z0-9_-]*)[\x20\t]+(?=[^\s-])")
ARGUMENTS = re.compile(r"[\"']([A-Za-z_][A-Za-z0-9_.-]*)[\"'][\x20\t]*,[\x20\t]*(?=[rRbBuUfF]{0,2}[\"'`])")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")

#: How sure a word of a name makes us that its literal is a secret.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9,
    "bearer": 0.9, "auth": 0.7, "authorization": 0.8, "pat": 0.6, "jwt": 0.8, "sas": 0.6, "dsn": 0.5,
}
SENSITIVE_PAIRS = {("api", "key"), ("access", "key"), ("private", "key"), ("secret", "key"), ("signing", "key"), ("encryption", "key"), ("session", "key"), ("account", "key"), ("connection", "string")}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|changeme|change_me|example|placeholder|dummy|none|null|true|false|todo|test(?:ing)?|your[_-].*|<.*>|\$\{?.*|%.*%|\{\{.*)$")


@lru_cache(maxsize=1 << 16)
def name_score(name: str) -> float:
    parts = [w.lower() for w in WORDS.findall(name)]
    best = max([SENSITIVE.get(w, 0.0) for w in parts], default=0.0)
    return max([best, *(1.0 for pair in zip(parts, parts[1:], strict=False) if pair in SENSITIVE_PAIRS)])


def literal_score(value: str, quoted: bool) -> float:
    """0 to 1: how much a literal looks like a chosen or random secret."""
    if len(value) < 8 or PLACEHOLDER.match(value) or "://" in value or value.count(" ") > 2:
        return 0.0
    if not quoted and not any(c.isdigit() for c in value):
        return 0.0
    counts = {c: value.count(c) for c in set(value)}
    bits = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())
    return min(1.0, bits / 3.0)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end), unsorted."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


@dataclass(frozen=True)
class Term:
    """A term of a value: a literal at text[start:end], or a name that may stand for another value."""

    start: int
    end: int
    quoted: bool


@dataclass(frozen=True)
class Pair:
    """A name and the terms of the value that it gets at a place; more: they are added to what it holds."""

    at: int
    name: str
    terms: tuple[Term, ...]
    more: bool = False


def name_before(text: str, end: int) -> str | None:
    """The name that ends before an operator; quotes and a bracket may close it."""
    k = end
    while k and text[k - 1] in " \t":
        k -= 1
    for _ in range(2):
        if k and text[k - 1] in "\"']":
            k -= 1
    stop = k
    while k and text[k - 1] in NAME_CHARS:
        k -= 1
    while k < stop and not (text[k].isalpha() or text[k] == "_"):
        k += 1
    return text[k:stop] or None


def value_at(text: str, at: int, run: list[int]) -> tuple[list[Term], int]:
    """The terms of the expression that begins at a place, and where it ends.

    run: the bare word read last; what begins inside it ends with it, so a long word full of operators is read once.
    """

    def bare(k: int) -> tuple[int, int] | None:
        if not run[0] <= k < run[1]:
            if not (m := BARE.match(text, k)):
                return None
            run[:] = m.span()
        return k, run[1]

    terms, depth = [], 0
    while True:
        at = (BLANK_LINES if depth or terms else BLANK).match(text, at).end()
        while text.startswith(("(", "["), at):
            depth, at = depth + 1, BLANK_LINES.match(text, at + 1).end()
        if m := STRING.match(text, at):
            terms.append(Term(*next(m.span(k) for k in range(1, 6) if m[k] is not None), True))
            at = m.end()
        elif w := bare(at):
            if not terms and w[1] - w[0] < 8 and text[w[0] : w[1]].lower() in SCHEMES and (n := bare(BLANK.match(text, w[1]).end())):
                w = n
            terms.append(Term(*w, False))
            at = w[1]
        else:
            return terms, at
        if j := JOIN.match(text, at):
            at = j.end()
            continue
        # Strings side by side are one value, on one line or within brackets; so are a word and a string that touch.
        ahead = (BLANK_LINES if depth else BLANK).match(text, at).end()
        if STRING.match(text, ahead) and (terms[-1].quoted or ahead == at):
            at = ahead
            continue
        return terms, at


def block_below(text: str, op: int, at: int) -> list[Term]:
    """The lines of a YAML block scalar whose key is on op's line; at: the start of the line below."""
    line = text.rfind("\n", 0, op) + 1
    indent = len(text[line:op]) - len(text[line:op].lstrip(" -"))
    terms = []
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        row = text[at:end]
        if row.strip():
            first = at + len(row) - len(row.lstrip())
            if first - at <= indent:
                break
            terms.append(Term(first, at + len(row.rstrip()), True))
        at = end + 1
    return terms


def lexed(text: str) -> list[Pair]:
    """The name-literal pairs of a text, in order."""
    pairs, annotated, run = [], -1, [0, 0]
    for op in OPERATOR.finditer(text):
        if op.start() == annotated or not (name := name_before(text, op.start())):
            continue
        if op[0] == ":" and (m := BLOCK.match(text, op.end())):
            pairs.append(Pair(op.start(), name, tuple(block_below(text, op.start(), m.end()))))
            continue
        terms, end = value_at(text, op.end(), run)
        if op[0] == ":" and len(terms) == 1 and not terms[0].quoted and (m := ANNOTATED.match(text, end)):
            annotated = m.end() - 1
            terms, end = value_at(text, m.end(), run)
        if terms:
            pairs.append(Pair(op.start(), name, tuple(terms), op[0] == "+="))
    if "</" in text:
        for m in ELEMENT.finditer(text):
            if inner := m[2].strip():
                first = m.start(2) + m[2].index(inner)
                pairs.append(Pair(m.start(), m[1], (Term(first, first + len(inner), True),)))
    if "value" in text and "<" in text:
        pairs += [Pair(m.start(), m[1], (Term(*m.span(2 if m[2] is not None else 3), True),)) for m in KEYED.finditer(text)]
    for pattern in [OPTION] * (" -" in text or text.startswith("-") or "\n-" in text) + [ARGUMENTS] * ("," in text):
        for m in pattern.finditer(text):
            if name_score(m[1]) > 0 and (terms := value_at(text, m.end(), run)[0]):
                pairs.append(Pair(m.start(), m[1], tuple(terms)))
    return sorted(pairs, key=lambda x: x.at)


def method_spans(text: str, least: float = 0.5) -> list[tuple[int, int, int]]:
    if not any(sign in text for sign in "=:<-,"):
        return []
    pairs = lexed(text)
    if not any(name_score(x.name) > 0 for x in pairs):
        return []
    later: dict[str, Pair] = {}
    for x in reversed(pairs):
        later[x.name] = x
    held: dict[str, dict[Term, None]] = {}  # the literals that each name holds, in order
    secret_at = {t for x in pairs if name_score(x.name) > 0 for t in x.terms}

    def literals(terms: tuple[Term, ...], seen: tuple[str, ...]) -> dict[Term, None]:
        out: dict[Term, None] = {}
        for t in terms:
            if t.quoted or not IDENTIFIER.fullmatch(text, t.start, t.end) or (word := text[t.start : t.end]) in seen:
                out[t] = None
            elif word in held:
                out |= held[word]
            elif word in later:
                out |= literals(later[word].terms, (*seen, word))
            else:
                out[t] = None
        return out

    found = set()
    for x in pairs:
        value = literals(x.terms, (x.name,))
        if x.more:
            held.setdefault(x.name, {}).update(value)
        else:
            held[x.name] = value
        own = name_score(x.name)
        if own <= 0:
            continue
        value = held[x.name]
        whole = "".join(text[t.start : t.end] for t in value)
        if own * literal_score(whole, any(t.quoted for t in value)) >= least:
            found |= {(t.start, 3 if t in secret_at else 4, t.end) for t in value}
    return list(found)


def spans_of(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans, each sorted by start and kind."""
    base = sorted(base_spans(text))
    return base, sorted({*base, *method_spans(text)})


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_literal long, n_constant long, base_sha256 string, spans string"


def scan(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: counts by kind, the digest of the base spans, all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                base, every = spans_of(text.as_py() or "")
                n = [0] * len(KINDS)
                for _, k, _ in every:
                    n[k] += 1
                rows.append((doc_id, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 6 + [pa.string()] * 2, strict=True)] if rows else [pa.array([], t) for t in [pa.int64()] * 6 + [pa.string()] * 2], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span in text replaced by mark; overlapping spans become one mark. n_chars, if there, is counted anew."""
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, at, BATCH):
            texts = pa.array([None if t is None else without(t, mark) for t in b.column(at).to_pylist()], pa.string())
            out = b.set_column(at, b.schema.field(at), texts.cast(b.schema.field(at).type))
            if "n_chars" in names:
                k = names.index("n_chars")
                out = out.set_column(k, b.schema.field(k), pc.utf8_length(texts).cast(b.schema.field(k).type))
            yield out

    return docs.mapInArrow(run, docs.schema)


def without(text: str, mark: str) -> str:
    parts, at = [], 0
    for s, _, e in spans_of(text)[1]:
        if s >= at:
            parts += [text[at:s], mark]
        at = max(at, e)
    return "".join([*parts, text[at:]])
