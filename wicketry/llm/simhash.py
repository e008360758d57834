"""Document fingerprints by SimHash, with permuted block tables for Hamming-radius search.

Every overlapping run of ``n_words`` words is a term; a term votes once per occurrence on each of 64 signed
bits, so its weight is its frequency. All of it is DataFrame functions: the votes for bits k and k+32 share one
64-bit sum (32-bit lanes), so a term costs 32 additions inside generated code and counts stay exact up to
2**31 terms a text.

The order of documents is found in blocks of neighbouring ids; a block's next one comes from a range-partitioned sort of the
block numbers, of which only each partition's first is carried further, so no task sees all blocks.

Defined results: a null text counts as empty; a text without words has fingerprint 0; a text with fewer words
than ``n_words`` gets the shorter runs it has; equal texts get equal fingerprints; rows without a doc_id come after all
others; ties of doc_id (few rows of one id are expected) and rows without one are ordered by text hash, descending; repeated
rows are fingerprinted each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, cut, drop_cut, table, text_or_empty

#: A block of the order of documents has 2**BLOCK_BITS neighbouring ids.
BLOCK_BITS = 8
#: Searched radius, in bits, and blocks that must agree in a table.
RADIUS, KEY_BLOCKS = 3, 3
#: Documents whose id is divisible by this are the queries of the radius search.
EVERY = 100
LANES = 0x0000000100000001


def terms(text: Column, n_words: int) -> Column:
    """The runs of ``n_words`` words of a text, as an array of structs (shorter runs at its end)."""
    words = F.array_remove(F.split(F.lower(text), SPACE), "")
    return F.arrays_zip(words, *(F.slice(words, k + 1, F.greatest(F.size(words), F.lit(1))) for k in range(1, n_words)))


def fingerprint(df: DataFrame, keys: list[str], text: str = "text", n_words: int = 3) -> DataFrame:
    """``keys`` and the 64-bit fingerprint ``fp`` of each row's text; ``keys`` must be unique for a row."""
    parts = df.select(*keys, F.explode_outer(terms(F.col(text), n_words)).alias("_t"))
    fields = [F.col("_t").getField(f.name) for f in parts.schema["_t"].dataType.fields]
    votes = parts.select(*keys, F.when(F.col("_t").isNotNull(), F.xxhash64(*fields)).alias("_h"))
    sums = votes.groupBy(*keys).agg(
        F.count("_h").alias("_n"),
        *(F.coalesce(F.sum(F.shiftright("_h", k).bitwiseAND(LANES)), F.lit(0)).alias(f"_s{k}") for k in range(32)),
    )
    bits = F.lit(0).cast("bigint")
    for k in range(32):
        low, high = F.col(f"_s{k}").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(F.col(f"_s{k}"), 32)
        for count, bit in ((low, k), (high, k + 32)):
            value = (1 << bit) - (1 << 64 if bit == 63 else 0)
            bits = bits.bitwiseOR(F.when(2 * count > F.col("_n"), F.lit(value)).otherwise(F.lit(0)).cast("bigint"))
    return sums.select(*keys, bits.alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits of two fingerprints, 0 to 1."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def hexed(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def block_links(blocks: DataFrame) -> DataFrame:
    """``blk`` and ``below``: each block's next lower block; the lowest is followed by the highest."""
    ordered = cut(blocks.distinct().repartitionByRange(F.desc("blk")).withColumn("part", F.spark_partition_id()), "blocks")
    inside = ordered.withColumn("below", F.lead("blk").over(Window.partitionBy("part").orderBy(F.desc("blk"))))
    # one row for each partition
    tops = ordered.groupBy("part").agg(F.max("blk").alias("top")).withColumns(
        {"next_top": F.coalesce(F.lead("top").over(Window.orderBy("part")), F.max("top").over(Window.partitionBy()))}).select("part", "next_top")
    links = cut(inside.join(tops, "part").select("blk", F.coalesce("below", "next_top").alias("below")), "links")
    drop_cut(ordered)
    return links


def with_next(rows: DataFrame, links: DataFrame, value: str, order: list[Column]) -> DataFrame:
    """Adds ``rn`` (place in its block) and ``next_value``: ``value`` (never null) of the next row, descending; after the last, the first."""
    window = Window.partitionBy("blk").orderBy(*order)
    own = rows.withColumn("rn", F.row_number().over(window)).withColumn("_lead", F.lead(value).over(window))
    heads = (own.filter("rn = 1").select(F.col("blk").alias("below"), F.col(value).alias("_head"))
             .join(links, "below").select(F.col("blk").alias("_blk"), "_head"))
    return (own.join(heads, (own.blk == heads._blk) & own._lead.isNull(), "left")
            .withColumn("next_value", F.coalesce("_lead", "_head")).drop("_lead", "_head", "_blk"))


def edited_fingerprints(docs: DataFrame, n_words: int = 3) -> DataFrame:
    """Fingerprints of each text and of its edited text (its second half replaced by the next document's beginning)."""
    number = F.when(F.col("doc_id").isNotNull(), F.shiftright("doc_id", BLOCK_BITS)).otherwise(F.lit(-(1 << 61)) + F.shiftright("h", 4))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")).withColumn("h", F.xxhash64("text")).withColumn("blk", number)
    links = block_links(rows.select("blk"))
    own = with_next(rows, links, "text", [F.desc_nulls_last("doc_id"), F.desc("h"), F.desc("text")])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_value"), F.lit(1), half))
    both = own.select("blk", "rn", "doc_id", n.cast("bigint").alias("n_chars"), "text", edited.alias("edited")).select(
        "blk", "rn", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))).alias("side"),
    ).select("blk", "rn", "doc_id", "n_chars", "edited_sha256", "side.kind", "side.text")
    keys = ["blk", "rn", "doc_id", "n_chars", "edited_sha256", "kind"]
    marks = fingerprint(both, keys, n_words=n_words)
    wide = marks.groupBy(*keys[:-1]).agg(
        F.max(F.when(F.col("kind") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("kind") == 1, F.col("fp"))).alias("edited_fp"))
    wide = cut(wide.withColumnRenamed("rn", "place"), "simhash")
    asked = F.coalesce(F.col("doc_id") % EVERY == 0, F.lit(False))
    near = within_radius(wide.filter(asked), wide).filter("distance > 0").groupBy("query_fp").agg(F.count("*").alias("n"))
    queries = wide.filter(asked).join(near, F.col("fp") == F.col("query_fp"), "left").select(*wide.columns, F.coalesce("n", F.lit(0)).alias("n_within"))
    wide = queries.unionByName(wide.filter(~asked).withColumn("n_within", F.lit(None).cast("bigint")))
    seq = with_next(wide, links, "fp", [F.col("place")])
    return seq.select(
        "doc_id", "n_chars", "edited_sha256", hexed(F.col("fp")).alias("fingerprint"), hexed(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_value")).alias("near_next"), "n_within")


def block_masks(radius: int, key_blocks: int) -> list[int]:
    """Bits that must agree, for each permuted table: of ``radius + key_blocks`` blocks, every choice of ``key_blocks`` leads once.

    Two fingerprints within ``radius`` differ in at most ``radius`` blocks, so they agree on some choice.
    """
    n = radius + key_blocks
    edges = [64 * i // n for i in range(n + 1)]
    masks = (sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen) for chosen in combinations(range(n), key_blocks))
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def within_radius(queries: DataFrame, index: DataFrame, radius: int = RADIUS, key_blocks: int = KEY_BLOCKS) -> DataFrame:
    """Distinct fingerprints of ``index`` within ``radius`` of each distinct fingerprint of ``queries`` (column ``fp``).

    Returns query_fp, fp, distance: pairs of distinct fingerprints, so copies never multiply; members are found by
    joining on the fingerprint. A pair is told by the first table in which it agrees. Null fingerprints take no part.
    """
    masks = block_masks(radius, key_blocks)

    def tables(df: DataFrame, name: str, number: str) -> DataFrame:
        one = df.filter(F.col("fp").isNotNull()).select(F.col("fp").alias(name)).distinct()
        keys = F.array(*(F.struct(F.lit(t).alias("t"), F.col(name).bitwiseAND(F.lit(m)).alias("bits")) for t, m in enumerate(masks)))
        return one.select(name, F.explode(keys).alias("k")).select(name, F.col("k.t").alias(number), F.xxhash64("k.t", "k.bits").alias("key"))

    q, i = tables(queries, "query_fp", "t"), tables(index, "fp", "index_t")
    differ = F.col("query_fp").bitwiseXOR(F.col("fp"))
    distance = F.bit_count(differ)
    first = F.coalesce(*(F.when(differ.bitwiseAND(F.lit(m)) == 0, t) for t, m in enumerate(masks)))
    return q.join(i, (q.key == i.key) & (distance <= radius) & (F.col("t") == F.col("index_t")) & (first == F.col("t"))).select("query_fp", "fp", distance.cast("int").alias("distance"))


def op1_fingerprints(spark, sf_dir):
    return edited_fingerprints(table(spark, sf_dir, "documents"))
