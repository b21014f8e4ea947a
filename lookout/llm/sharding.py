"""Operator 9: contiguous shards of near-equal bytes from global prefix sums.

DataFrame functions only. Documents are ordered by the first document that has
their text, then by their own id, so equal texts stand together. Byte sizes are
summed along that order from per-partition totals, and the order is cut at
equal byte targets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lookout.llm.common import global_prefix, prepared

#: A group of equal texts up to this share of a shard's target stays whole.
WHOLE_GROUP = 0.02


def shard_by_bytes(docs: DataFrame, shards: int = 24, overhead: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): one row for each input row.

    ``size`` is the text's UTF-8 bytes plus ``overhead``. ``shard`` counts from
    0; ``slot`` counts the rows of a shard from 0 without gaps, in the global
    order. A document goes to the shard in which it begins; a group of equal
    texts of at most ``WHOLE_GROUP`` of the target goes to the shard in which
    the group begins, a larger one may be cut between documents. Thus a shard
    misses the target by less than one document or small group at each end.

    Null texts count as empty ones, null ids sort first, repeated rows are rows
    of their own, an empty table gives no rows. Other columns aren't read."""
    prepared(docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
                       F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
                       F.xxhash64(text).alias("h")).checkpoint()
    same = ["h", "text_crc32", "size"]
    first = rows.groupBy(same).agg(F.min("doc_id").alias("first_id"))
    order = ["first_id", *same, "doc_id"]
    placed = global_prefix(rows.join(first, same).withColumn("one", F.lit(1).cast("long")),
                           order, ["size", "one"]).checkpoint()
    # one row: the bytes of all documents
    total = placed.agg(F.max(F.col("p_size") + F.col("size")).alias("total"))
    groups = placed.groupBy(same).agg(F.min("p_size").alias("g_start"), F.sum("size").alias("g_bytes"))
    cut = (placed.join(groups, same).crossJoin(F.broadcast(total))
           .withColumn("at", F.when(F.col("g_bytes") * shards <= F.col("total") * WHOLE_GROUP, F.col("g_start"))
                       .otherwise(F.col("p_size")))
           .withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"`at` * {int(shards)} div total")).cast("int")))
    # one row per shard
    base = cut.groupBy("shard").agg(F.min("p_one").alias("base"))
    return (cut.join(F.broadcast(base), "shard")
            .select("doc_id", "size", "text_crc32", "shard", (F.col("p_one") - F.col("base")).alias("slot")))


def sharded(docs: DataFrame, shards: int = 24) -> DataFrame:
    """``shard_by_bytes`` with the digest columns of the op9 query: the law that
    holds and a null ``grown_shard`` (it applies to the key law only)."""
    return shard_by_bytes(docs, shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


#: The same shards in DuckDB SQL (ids unique). The checksum is computed from
#: half-bytes, low one first, with a table of 16 entries made by rule.
ORACLE = """
WITH tab AS (
  SELECT list_transform(range(16), lambda c: list_reduce([c::BIGINT, 0, 0, 0, 0],
         lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crc),
d AS (
  SELECT doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, '')))::BIGINT + 8 AS size,
         list_transform(string_split(hex(encode(coalesce(text, ''))), ''),
                        lambda c: instr('0123456789ABCDEF', c)::BIGINT - 1) AS nibbles
  FROM documents),
c AS (
  SELECT doc_id, text, size, CASE WHEN size = 8 THEN 0 ELSE xor(list_reduce(
           list_concat([4294967295::BIGINT], list_transform(range(len(nibbles)), lambda i: nibbles[xor(i, 1) + 1])),
           lambda a, x: xor(tab.crc[(xor(a, x) & 15) + 1], a >> 4)), 4294967295) END AS text_crc32
  FROM d, tab),
o AS (SELECT *, min(doc_id) OVER (PARTITION BY text) AS first_id, sum(size) OVER (PARTITION BY text) AS bytes,
             (SELECT sum(size) FROM c) AS total FROM c),
p AS (SELECT *, sum(size) OVER (ORDER BY first_id, doc_id) - size AS pos FROM o),
s AS (SELECT *, least(23, CASE WHEN bytes * 24 <= total * 0.02 THEN min(pos) OVER (PARTITION BY text) ELSE pos END
                      * 24 // total)::INTEGER AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY pos, doc_id) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM s"""
