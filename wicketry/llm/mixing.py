"""Mixing sources to target weights by hash-random keys, distributed prefix sums and exact budgets.

Each document gets a hash-random key; inside its source, documents are ordered by key. A source's prefix sums are
computed in two steps: sums by key range (``bins`` ranges a source, pre-aggregated), then sums inside a range; so no
task holds a source, however large it is. A source's target is cut exactly: whole epochs, then the documents below the
rest of the budget, the last of them in part.

Defined results: a null text has size 0; the null source is a source of its own, after the others; a row without a doc_id is
ordered by its text; rows of one doc_id are ordered by size, then text; a source without words has target 0; an empty table
gives an empty result; repeated rows are ordered next to each other and each is taken for itself; columns of the names that
are added are replaced, others pass as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, table, text_or_empty

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
#: Hexadecimal digits of the key that name its range: 4096 ranges a source.
BIN_DIGITS = 3


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = 1.0, cap: float = CAP) -> DataFrame:
    """``source``, ``source_size`` -> also ``target``; one row per source.

    The weights share ``share`` of all sizes; a target stops at ``cap`` times its source's size and the excess goes to
    the others by weight. Sources sorted by cap / weight fill up in that order, so running sums give the final level.
    """
    every = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    index = (F.row_number().over(by_name) - 1) % len(weights)
    s = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (index + 1).cast("int")))
    s = s.withColumn("most", F.col("source_size") * F.lit(cap)).withColumn("total", F.sum("source_size").over(every) * F.lit(share))
    fill = Window.orderBy((F.col("most") / F.col("w")), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("below", F.coalesce(F.sum("most").over(fill), F.lit(0.0))).withColumn(
        "rest_w", F.sum("w").over(every) - F.coalesce(F.sum("w").over(fill), F.lit(0.0)))
    level = (F.col("total") - F.col("below")) / F.col("rest_w")
    s = s.withColumn("level", level).withColumn("full", F.col("most") <= F.col("w") * F.col("level"))
    # the first source that isn't filled sets the level of all after it
    s = s.withColumn("level", F.min(F.when(~F.col("full"), F.struct(F.col("most") / F.col("w"), F.col("level")))).over(every).getField("level"))
    return s.select("source", "source_size", F.when(F.col("full"), F.col("most")).otherwise(F.col("w") * F.col("level")).alias("target"))


def sized(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """``_row`` (all columns of a row) and what the mix needs of it: source, size, hash-random key, range of the key, tie-break."""
    ident = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(text_or_empty())))
    rows = docs.select(F.struct("*").alias("_row"), "source", "doc_id", n_words(text_or_empty()).alias("size"), F.md5(F.concat(F.lit(f"{seed}:"), ident)).alias("key"), F.xxhash64(text_or_empty()).alias("tie"))
    return rows.withColumn("bin", F.substring("key", 1, BIN_DIGITS))


def mixed(rows: DataFrame, weights: tuple = WEIGHTS, share: float = 1.0, cap: float = CAP) -> DataFrame:
    """``_row``, size, source_size, target and taken, from rows as ``sized`` gives them."""
    ranges = rows.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    plan = targets(ranges.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights, share, cap)
    before = F.coalesce(F.sum("bin_size").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = ranges.withColumn("before", before)
    offsets = offsets.join(plan, offsets.source.eqNullSafe(plan.source)).select(
        offsets.source.alias("_source"), F.col("bin").alias("_bin"), "before", "source_size", "target")
    order = Window.partitionBy("source", "bin").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("_own", F.coalesce(F.sum("size").over(order), F.lit(0)))
    joined = inside.join(offsets, inside.source.eqNullSafe(offsets._source) & (inside.bin == offsets._bin))
    budget = F.floor(F.col("target")).cast("bigint")
    some = F.col("source_size") > 0
    epochs = F.when(some, F.expr("floor(target) div source_size")).otherwise(F.lit(0))
    rest = F.when(some, budget % F.col("source_size")).otherwise(F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before") - F.col("_own")))
    return joined.select("_row", "size", "source_size", "target", (epochs * F.col("size") + part).cast("bigint").alias("taken"))


ADDED = ("size", "source_size", "target", "taken")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = 1.0, cap: float = CAP, seed: str = "mix") -> DataFrame:
    """``docs`` with size, source_size, target and taken; needs doc_id, text, source."""
    return mixed(sized(docs.drop(*ADDED), seed), weights, share, cap).select("_row.*", *ADDED)


def op7_mixing(spark, sf_dir):
    rows = sized(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    rows = cut(rows.withColumn("_row", F.struct("doc_id")), "sizes")  # texts are read once
    return mixed(rows).select("_row.doc_id", *ADDED)


OP7_SQL = r"""
WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))) AS key FROM documents),
g AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
n AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w, source_size * 3.0::DOUBLE AS most FROM g),
f AS (SELECT *, sum(source_size) OVER () AS total,
             coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
             sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_w FROM n),
l AS (SELECT *, (total - below) / rest_w AS level, most <= w * ((total - below) / rest_w) AS filled FROM f),
t AS (SELECT source, source_size,
             CASE WHEN filled THEN most ELSE w * (SELECT level FROM l x WHERE NOT x.filled ORDER BY most / w LIMIT 1) END AS target FROM l),
p AS (SELECT s.*, t.source_size, t.target,
             coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (CAST(floor(target) AS BIGINT) // source_size) * size
            + greatest(0, least(size, CAST(floor(target) AS BIGINT) % source_size - before)) END AS BIGINT) AS taken
FROM p
"""
