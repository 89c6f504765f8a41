"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def remainder(key: Column, of: int) -> Column:
    """crc32 of the key's decimal text, modulo `of`; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(of))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores after it as it takes to be no column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def rows_named(docs: DataFrame, named: DataFrame) -> DataFrame:
    """The rows of docs that named (doc_id, hash: xxhash64 of the text) tells, rows equal in both once, all columns.

    Two hashes of doc_id and text name a row: 96 bits, and equality on them is all that the join and the last step need,
    so texts are shuffled once.
    """
    hashes = lambda doc, text: (F.xxhash64(F.coalesce(doc, F.lit(0)), doc.isNull(), text), F.hash(text, doc.isNull(), F.coalesce(doc, F.lit(0))))
    first, second, one, two = fresh(docs, "first", "second", "one", "two")
    a, b = hashes(F.col("doc_id"), F.col("hash"))
    kept = named.select(a.alias(one), b.alias(two)).distinct()
    a, b = hashes(F.col("doc_id").cast("long"), F.xxhash64("text"))
    own = docs.withColumns({first: a, second: b})
    return own.join(kept, (F.col(first) == F.col(one)) & (F.col(second) == F.col(two)), "left_semi").dropDuplicates([first, second]).drop(first, second)
