"""Mixing sources to target weights by hash-threshold histograms.

Every document gets a hash; a source's extra copies go to its documents of the smallest hashes. Where the
threshold lies is found without sorting: token sums by source and hash bucket, the bucket in which the
running sum passes the budget, then the same inside that bucket alone, until the hash is used up.

Defined cases: null text has size 0; a null source is a source of its own, last in order; rows that agree
in id and text share one hash and divide what is left at the threshold; very long texts count whole; an empty table
gives no rows; columns other than doc_id, text and source are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from inkveil.llm.common import table, written

WORD = r"[^\x20\x09-\x0D]+"
#: Hash bits, and bits of one histogram: 4096 buckets a source, whatever the input.
HASH_BITS, LEVEL_BITS = 60, 12


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def doc_hash() -> Column:
    """60 bits of an MD5 over id and text: the same in any engine and on any rerun."""
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col("text"), F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, share: float, most: float, weights: tuple[int, ...]) -> DataFrame:
    """source, source_size, target: share of all sizes, dealt by weight, no source above most times its size.

    target = min(cap, level * weight); the level is closed-form once sources are ordered by cap / weight.
    One row a source passes through the unpartitioned windows, never documents.
    """
    every = Window.partitionBy(F.lit(0))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    w = sizes.withColumn("place", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())))
    w = w.withColumn("weight", F.element_at(cycle, F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1)).withColumn("cap", F.lit(most) * F.col("source_size"))
    order = every.orderBy(F.col("cap") / F.col("weight"), "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("all", F.lit(share) * F.sum("source_size").over(every)).withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    w = w.withColumn("free", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    w = w.withColumn("level", (F.col("all") - F.col("capped")) / F.col("free"))
    w = w.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(every))
    return w.select("source", "source_size", F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("weight")), F.col("cap")).alias("target"))


def take(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """doc_id, source, h, size, source_size, target, taken for every row of docs."""
    base = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), doc_hash().alias("h")), "mix-sizes")
    plan = targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), share, most, weights)
    plan = plan.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    plan = written(plan.withColumn("budget", F.round("target").cast("long") - F.col("copies") * F.col("source_size")).withColumn("budget", F.greatest("budget", F.lit(0))), "mix-plan")
    edge = plan.select(F.col("source").alias("s"), F.col("budget").alias("rest"), F.lit(0).cast("long").alias("prefix"))
    for done in range(0, HASH_BITS, LEVEL_BITS):
        shift = HASH_BITS - done - LEVEL_BITS
        inside = base.join(edge, base.source.eqNullSafe(edge.s) & (F.shiftright("h", shift + LEVEL_BITS) == F.col("prefix")))
        sums = inside.groupBy("s", "rest", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("tokens"), F.count("*").alias("rows"))
        upto = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("upto", F.sum("tokens").over(upto))
        edge = sums.filter(F.col("upto") > F.col("rest")).groupBy("s").agg(F.min_by(F.struct((F.col("rest") - (F.col("upto") - F.col("tokens"))).alias("rest"), F.col("bucket").alias("prefix"), "rows"), "bucket").alias("x")).select("s", "x.*")
    edge = edge.select("s", F.col("prefix").alias("edge_h"), F.col("rest").alias("edge_rest"), F.col("rows").alias("edge_rows"))
    out = base.join(plan.withColumnRenamed("source", "p"), base.source.eqNullSafe(F.col("p"))).join(edge, F.col("source").eqNullSafe(F.col("s")), "left")
    extra = F.when(F.col("edge_h").isNull() | (F.col("h") < F.col("edge_h")), F.when(F.col("budget") > 0, F.col("size")).otherwise(F.lit(0))).when(F.col("h") == F.col("edge_h"), F.least("size", F.floor(F.col("edge_rest") / F.col("edge_rows")))).otherwise(F.lit(0))
    return out.select("doc_id", "source", "h", "size", "source_size", "target", (F.col("copies") * F.col("size") + extra).cast("long").alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mixed corpus itself: each document's whole copies, then its first words where a copy is partial."""
    t = take(docs).select(F.col("doc_id").alias("i"), F.col("h").alias("k"), F.col("source").alias("s"), "size", "taken").distinct()
    d = docs.select("doc_id", "text", "lang", "source", "n_chars").withColumn("h", doc_hash())
    d = d.join(t, d.doc_id.eqNullSafe(t.i) & (d.h == t.k) & d.source.eqNullSafe(t.s)).filter(F.col("taken") > 0)
    whole, part = F.floor(F.col("taken") / F.col("size")), F.col("taken") % F.col("size")
    words = F.concat_ws(" ", F.slice(F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD), 0), 1, part.cast("int")))
    texts = F.concat(F.array_repeat("text", whole.cast("int")), F.when(part > 0, F.array(words)).otherwise(F.array().cast("array<string>")))
    return d.withColumn("text", F.explode(texts)).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return take(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = rf"""
WITH base AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s),
c AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap FROM w),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS lv FROM c
    WINDOW o AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, coalesce(least(cap, weight * max(CASE WHEN lv * weight <= cap THEN lv END) OVER ()), cap) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM t),
r AS (SELECT b.*, p.source_size, p.target, p.copies, greatest(round(p.target)::BIGINT - p.copies * p.source_size, 0) AS budget,
    sum(size) OVER (PARTITION BY b.source ORDER BY h) AS upto, sum(size) OVER (PARTITION BY b.source, h) AS same, count(*) OVER (PARTITION BY b.source, h) AS n
    FROM base b JOIN p ON b.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (copies * size + CASE WHEN budget <= 0 THEN 0 WHEN upto <= budget THEN size
    WHEN upto - same <= budget THEN least(size, floor((budget - (upto - same)) / n)) ELSE 0 END)::BIGINT AS taken FROM r
"""
QUERIES, ORACLES = {"op10_mixing": op10_mixing}, {"op10_mixing": SQL}
