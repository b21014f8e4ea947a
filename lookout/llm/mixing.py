"""Operator 7: mix sources to target weights by cutting a hash-random order.

Every document gets a random key from a hash. Documents are range-sorted by
(source, key); distributed prefix sums of word counts give each one its place
among its source's words; the order is cut at the source's exact budget, after
as many whole epochs as the budget holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lookout.llm.common import WORD, fingerprint, global_prefix, packed, prepared

EPOCHS = 3      # fixed by the contract: no document is taken more often
WEIGHTS = 3     # fixed by the contract: sources weigh 1, 2, 3, repeating
SEED = 7


def source_targets(sizes: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size) -> plus ``target``: each source's words in the mix.

    Sources in code point order, null last, weigh 1, 2, 3, repeating, and share
    all words by weight; no target exceeds ``epochs`` times its source's size,
    and what is above is shared by weight among the others until none is above.
    That is a water level L with target = min(epochs * size, L * weight): going
    up by size / weight, the sources below the level are the ones for which the
    words left over a fair share still reach their bound. One row per source
    meets in one task."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("weight", ((F.row_number().over(by_name) - 1) % WEIGHTS + 1).cast("long"))
    by_ratio = Window.orderBy((F.col("source_size") * 6 / F.col("weight")), F.col("source").asc_nulls_last())
    up_to = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    from_here = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    cap = F.lit(epochs) * F.col("source_size")
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(up_to), F.lit(0))
    steps = (weighed.withColumn("cap", cap).withColumn("left", left)
             .withColumn("rest", F.sum("weight").over(from_here))
             .withColumn("full", F.col("left") * F.col("weight") >= F.col("cap") * F.col("rest")))
    open_left = F.max(F.when(~F.col("full"), F.struct("rest", "left"))).over(everything)
    return (steps.withColumn("open", open_left)
            .select("source", "source_size", "weight",
                    F.when(F.col("full"), F.col("cap").cast("double"))
                    .otherwise((F.col("open.left") * F.col("weight")).cast("double")
                               / F.col("open.rest").cast("double")).alias("target")))


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, k1, k2): one row for
    each input row; ``k1``, ``k2`` are the fingerprint of all its columns.

    ``taken`` is the words the mix takes of the document: as many whole epochs
    as the budget (the target, rounded down) holds, then one more pass over the
    hash-random order up to the exact word. Reruns agree: the order depends on
    the rows and ``seed`` alone (the key is the start of md5("seed:doc_id")).

    Null texts have no words and null sources form one source, last; repeated
    rows are taken row by row; an empty table gives no rows."""
    prepared(docs)
    rows = docs.select("doc_id", "source",
                       F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                       F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))),
                                   1, 16).alias("key"),
                       *fingerprint(*[F.col(f"`{c}`") for c in docs.columns]))
    order = ["source", "key", "doc_id", "size", "k1", "k2"]
    placed = global_prefix(rows, order, ["size"]).checkpoint()
    per_source = placed.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("p_size").alias("start"))
    targets = source_targets(per_source.select("source", "source_size"))
    plan = (targets.join(per_source.select(F.col("source").alias("s"), "start"), F.col("source").eqNullSafe(F.col("s")))
            .select(F.col("source").alias("s"), "source_size", "target", "start",
                    F.floor("target").cast("long").alias("budget")))
    at = F.col("p_size") - F.col("start")
    whole = F.expr("CASE WHEN source_size > 0 THEN budget div source_size ELSE 0 END")
    rest = F.col("budget") - whole * F.col("source_size")
    return (placed.join(plan, F.col("source").eqNullSafe(F.col("s")))
            .select("doc_id", "source", "size", "source_size", "target",
                    (whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - at)))
                    .cast("long").alias("taken"), "k1", "k2"))


def mixed(docs: DataFrame) -> DataFrame:
    """The op7 query's columns."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a document appears once for
    every epoch that takes words of it, always with its whole text (the one
    document per source that the budget cuts isn't shortened); documents of
    which nothing is taken are gone."""
    copies = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(F.lit(0))
    # rows equal in every column share a fingerprint; their copies are added up
    # into partial sums first, so the join has one row for each fingerprint
    times = (mix(docs).groupBy("k1", "k2").agg(F.sum(copies).cast("int").alias("times"))
             .filter("times > 0"))
    rows = packed(docs, *fingerprint(*[F.col(f"`{c}`") for c in docs.columns])).dropDuplicates(["k1", "k2"])
    return (rows.join(times, ["k1", "k2"])
            .select("row", F.explode(F.sequence(F.lit(1), "times")).alias("time")).select("row.*"))


#: The same mix in DuckDB SQL (ids unique): the level of the targets is found by
#: trying every source as the first one that stays below its bound.
ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 16) AS key
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {WEIGHTS} + 1 AS weight
  FROM d GROUP BY source),
level AS (
  SELECT a.source, ((SELECT sum(source_size) FROM s) - coalesce(sum(b.source_size * {EPOCHS})
           FILTER (WHERE b.source_size * a.weight < a.source_size * b.weight), 0)) AS words,
         sum(b.weight) FILTER (WHERE b.source_size * a.weight >= a.source_size * b.weight) AS rest,
         a.weight AS w, a.source_size * {EPOCHS} AS cap
  FROM s a, s b GROUP BY ALL),
open AS (SELECT words, rest FROM level WHERE words * w < cap * rest ORDER BY cap / w LIMIT 1),
t AS (
  SELECT source, source_size,
         CASE WHEN words * weight >= source_size * {EPOCHS} * rest OR words IS NULL
              THEN (source_size * {EPOCHS})::DOUBLE
              ELSE (words * weight)::DOUBLE / rest::DOUBLE END AS target
  FROM s LEFT JOIN open ON true),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY key, d.doc_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0
             THEN budget // source_size * size + greatest(0, least(size, budget % source_size - before))
             ELSE 0 END)::BIGINT AS taken
FROM r"""
