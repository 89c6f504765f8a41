"""Chat formatting by cumulative-snapshot collapse.

A chat log often holds one conversation many times: after each turn, all turns so far. Such a snapshot is a proper
prefix of a longer logged conversation. Every turn is hashed together with its position, role and text; the running
XOR of two such 64-bit hashes names the prefix that ends there (positions are part of the hash, so XOR keeps order). A
conversation whose whole hash is another's proper-prefix hash is dropped by an anti-join; of equal conversations the
smallest conv_id stays. What is left is rendered.

Nothing gathers a whole conversation in one task, whatever its turn numbers: all turns are sorted in range partitions, a
turn's position is its place in its partition after the partitions before; hashes are summed up in chunks of CHUNK
positions, the chunks in a window with a row per chunk, and the rendered text comes in segments of `segment` turns,
which read in order are the transcript.

Defined cases: turns go in order of (turn, role, text), nulls first; identical rows of a conversation count once; a
null role or text counts as empty, a null conv_id is a conversation of its own; no turns, no rows. Other columns of the
input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearbox.session import written

CHUNK = 256


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>\n"))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), n_turns, role, text, p1, p2: each turn with the hashes of the prefix that it ends."""
    t = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).distinct()
    order = ("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    t = written(t.orderBy(*order).withColumn("at", F.monotonically_increasing_id()), "chat-turns")
    # The upper bits of the number are the partition, the lower ones the place in it; a row per partition goes to the driver.
    t = t.withColumn("part", F.shiftright("at", 33)).withColumn("place", F.col("at").bitwiseAND((1 << 33) - 1))
    before, rows = [], 0
    for part, n in sorted((r["part"], r["count"]) for r in t.groupBy("part").count().collect()):
        before.append((part, rows))
        rows += n
    offsets = t.sparkSession.createDataFrame(before, "part long, offset long")
    t = t.join(F.broadcast(offsets), "part").withColumn("nth", F.col("offset") + F.col("place")).select("conv_id", "turn", "role", "text", "part", "nth")
    # By conversation and partition, so that a conversation of very many turns is spread as its rows are.
    whole = Window.partitionBy("conv_id")
    parts = t.groupBy("conv_id", "part").agg(F.min("nth").alias("first"), F.count("*").alias("n"))
    parts = parts.select("conv_id", "part", F.min("first").over(whole).alias("start"), F.sum("n").over(whole).alias("n_turns"))
    same_part = F.col("t.conv_id").eqNullSafe(F.col("c.conv_id")) & (F.col("t.part") == F.col("c.part"))
    t = t.alias("t").join(parts.alias("c"), same_part).select("t.conv_id", "turn", "role", "text", "n_turns", (F.col("nth") - F.col("start") + 1).alias("pos"))
    t = t.withColumn("chunk", F.floor((F.col("pos") - 1) / CHUNK))
    by_chunk = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    same_chunk = lambda a, b: F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id")) & (F.col(f"{a}.chunk") == F.col(f"{b}.chunk"))
    t = t.withColumn("h1", F.xxhash64(F.lit(1), "pos", "role", "text")).withColumn("h2", F.xxhash64(F.lit(2), "text", "role", "pos"))
    inside = Window.partitionBy("conv_id", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("x1", F.bit_xor("h1").over(inside)).withColumn("x2", F.bit_xor("h2").over(inside))
    sums = (
        t.groupBy("conv_id", "chunk").agg(F.bit_xor("h1").alias("s1"), F.bit_xor("h2").alias("s2"))
        .withColumn("b1", F.coalesce(F.bit_xor("s1").over(by_chunk), F.lit(0)))
        .withColumn("b2", F.coalesce(F.bit_xor("s2").over(by_chunk), F.lit(0)))
    )
    return t.alias("t").join(sums.alias("s"), same_chunk("t", "s")).select(
        "t.conv_id", "pos", "n_turns", "role", "text", F.col("x1").bitwiseXOR(F.col("b1")).alias("p1"), F.col("x2").bitwiseXOR(F.col("b2")).alias("p2")
    )


def maximal(p: DataFrame) -> DataFrame:
    """conv_id, n_copies of the conversations that no other one extends; p: of prefixes()."""
    whole = (
        p.filter(F.col("pos") == F.col("n_turns"))
        .groupBy("pos", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    )
    proper = p.filter(F.col("pos") < F.col("n_turns")).select("pos", "p1", "p2").distinct()
    return whole.join(proper, ["pos", "p1", "p2"], "left_anti").select("conv_id", "n_copies")


def format_chats(turns: DataFrame, segment: int = CHUNK, template=render) -> DataFrame:
    """conv_id, n_copies, n_turns, segment, text for each maximal conversation."""
    p = written(prefixes(turns), "chat-prefixes")
    keep = maximal(p).withColumnRenamed("conv_id", "kept")
    lines = p.join(keep, F.col("conv_id").eqNullSafe(F.col("kept"))).withColumn("segment", F.floor((F.col("pos") - 1) / segment))
    ordered = F.array_sort(F.collect_list(F.struct("pos", template(F.col("role"), F.col("text")).alias("line"))))
    return lines.groupBy("conv_id", "n_copies", "n_turns", "segment").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "").alias("text"))


ORACLE = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM t),
c AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY pos) AS turns, count(*) AS n FROM o GROUP BY conv_id),
u AS (SELECT min(conv_id) AS conv_id, count(*) AS n_copies, turns, n FROM c GROUP BY turns, n),
m AS (SELECT u.* FROM u WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.n > u.n AND c.turns[1] = u.turns[1] AND list_slice(c.turns, 1, u.n) = u.turns))
SELECT m.conv_id, m.n_copies, m.n AS n_turns, CAST((o.pos - 1) // 256 AS BIGINT) AS segment,
       string_agg('<|im_start|>' || o.role || chr(10) || o.text || '<|im_end|>' || chr(10), '' ORDER BY o.pos) AS text
FROM m JOIN o ON o.conv_id IS NOT DISTINCT FROM m.conv_id GROUP BY ALL
"""
