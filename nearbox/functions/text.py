"""Token sets as native expressions: words, character shingles, list literals, Jaccard."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What tokens drop: everything but letters, digits, underscores and white space.
DROPPED = r"(?U)[^\p{L}\p{N}_\s]"
MERSENNE = (1 << 61) - 1


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), DROPPED, "")


def shingles(text: Column, k: int = 3) -> Column:
    """Distinct substrings of k characters; a shorter text is one shingle, an empty or null one has none."""
    # The text is normalised and taken apart once; a lambda that held the expression would do so for each window.
    def windows(chars: Column) -> Column:
        joined = lambda i: F.concat(*[F.element_at(chars, i + j) for j in range(k)])
        return F.when(F.size(chars) < k, F.array(F.array_join(chars, ""))).otherwise(F.sort_array(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(chars) - k + 1, F.lit(1))), joined))))

    chars = F.array_remove(F.split(normalised(text), ""), "")
    found = F.element_at(F.transform(F.array(chars), windows), 1)
    return F.when(text.isNull() | (text == ""), F.array().cast("array<string>")).otherwise(found)


def shingles_of(text: str | None, k: int = 3) -> list[str]:
    """shingles() of one text in Python, for Arrow batches."""
    if not text:
        return []
    s = re.sub(r"[^\w\s]", "", text.lower())
    return [s] if len(s) < k else sorted({s[i : i + k] for i in range(len(s) - k + 1)})


def words(text: Column) -> Column:
    """Distinct words."""
    return F.sort_array(F.array_distinct(F.array_remove(F.split(normalised(F.coalesce(text, F.lit(""))), r"\s+"), "")))


def list_items(text: Column) -> Column:
    """The strings of a list literal such as "['a', 'b']"; any other text is one item, null has none."""
    literal = F.trim(text).like("[%]")
    parsed = F.from_json(F.regexp_replace(text, r"(?<=[\[,\s])None(?=[\],\s])", "null"), "array<string>")
    items = F.when(literal, F.coalesce(parsed, F.array(text))).otherwise(F.array(text))
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.filter(items, lambda x: x.isNotNull()))


def tokens(text: Column, use_shingles: bool, k: int = 3) -> Column:
    """Distinct tokens of all items of a list literal or text, sorted."""
    one = (lambda x: shingles(x, k)) if use_shingles else words
    return F.sort_array(F.array_distinct(F.flatten(F.transform(list_items(text), one))))


def has_text(text: Column) -> Column:
    return text.isNotNull() & (text != "") & (text != "Unknown")


def countries(text: Column) -> Column:
    """Entries of a list literal of short codes, whatever its quotes."""
    bare = F.regexp_replace(text, r"^[\[\]'\"]+|[\[\]'\"]+$", "")
    return F.transform(F.split(bare, ","), lambda x: F.regexp_replace(F.trim(x), r"^['\"]+|['\"]+$", ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of distinct token arrays; two empty ones are equal (1), one empty one shares nothing (0)."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def token_hash(token: Column) -> Column:
    """The SHA-1 digest as a number, modulo 2**61 - 1: 160 bits in three parts of 60, for 2**61 is 1."""
    digest = F.sha1(token.cast("binary"))
    part = lambda at, n: F.conv(F.substring(digest, at, n), 16, 10).cast("decimal(38,0)")
    p = F.lit(MERSENNE).cast("decimal(38,0)")
    high = (part(1, 10) * F.lit(1 << 59).cast("decimal(20,0)")).cast("decimal(38,0)") % p
    middle = (part(11, 15) * F.lit(1 << 60).cast("decimal(20,0)")).cast("decimal(38,0)") % p
    return ((high + middle + part(26, 15)) % p).cast("long")
