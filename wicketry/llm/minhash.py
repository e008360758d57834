"""Near-duplicate documents by min-max hashing, banding, exact verification and connected components.

Each permutation of the shingle hashes gives two signature values, its minimum and its maximum, so the signature needs
half the hash evaluations. Bands of signature values propose candidates; a link counts only if
``100 * intersection >= percent * union`` holds on the full shingle sets.

Groups are never expanded into all pairs. Equal shingle sets are one class. In a bucket, the class that shares the
most buckets with others (the original of a family of copies, as a rule) is compared with the rest, as far as the number
of shingles that any other candidate has allows a link at all. After links are joined into components, buckets whose
classes are still in several components go another round with another such class among those not yet compared, and after
``ROUNDS`` rounds the classes outside a bucket's largest component are compared with all classes of other components in
the bucket, in blocks, which leaves no pair of a bucket unchecked that could join two components.

Defined results: documents without words (null, empty or white space) have no shingles, are linked with nothing and
kept; with fewer words than a shingle, the whole sequence is the only one; a repeated doc_id is one document, whose texts
(if they differ) are linked; a row without a doc_id has no component and is kept; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, small_batches, table
from .components import components
from .words import Words, buffer_of, groups, mixed, shingle_hashes

#: Signature: BANDS bands of ROWS values, half of them minima and half maxima. At similarity 0.8 a pair shares no band with chance (1 - 0.8**4)**32 < 1e-7.
BANDS, ROWS = 32, 4
ROUNDS = 2
#: Sets, and shingles of all of them, in a block when the rest of a bucket is compared (at least one set).
BLOCK, CELLS = 128, 1 << 17

_rng = np.random.RandomState(20240607)
MULT = _rng.randint(0, 2**31, BANDS * ROWS // 2, dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
ADD = _rng.randint(0, 2**32, BANDS * ROWS // 2, dtype=np.int64).astype(np.uint32)
BAND_MULT = _rng.randint(0, 2**63, (BANDS, ROWS), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def text_sets(column: pa.Array, n_words: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word shingles; with fewer words, of the whole sequence."""
    data, offsets = buffer_of(column)
    for i, j in groups(offsets):
        w = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        s = shingle_hashes(w.hash, n_words)
        for a, z in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            if z - a >= n_words:
                yield np.unique(s[a : z - n_words + 1])
            else:
                yield shingle_hashes(w.hash[a:z], z - a)[: z > a]


def signature(s: np.ndarray) -> np.ndarray:
    """Minimum and maximum under each permutation, interleaved so that a band mixes permutations."""
    low = high = np.empty(0, np.uint32)
    s = (s >> np.uint64(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(s), 1024):  # long texts in steps that fit the cache
            h = s[at : at + 1024, None] * MULT
            h += ADD
            h ^= h >> np.uint32(15)
            a, b = h.min(axis=0), h.max(axis=0)
            low, high = (np.minimum(low, a), np.maximum(high, b)) if at else (a, b)
    return np.concatenate([low, high]).astype(np.uint64).reshape(ROWS, BANDS).T  # a band's values come from ROWS different permutations or ends


def bands(s: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        keys = mixed((signature(s) * BAND_MULT).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
    return keys.view(np.int64)


def set_key(s: np.ndarray) -> str | None:
    """128 bits of a set; none for the empty one."""
    import xxhash

    return xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None


def features(docs: DataFrame, n_words: int) -> DataFrame:
    """doc_id, n_shingles, set_key and the band keys of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            out = [(len(s), set_key(s), bands(s) if len(s) else None) for s in text_sets(batch.column("text"), n_words)]
            n, key, keys = zip(*out, strict=True) if out else ((),) * 3
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(key, pa.string()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_key", "bands"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, set_key string, bands array<bigint>")


def sets(docs: DataFrame, n_words: int) -> DataFrame:
    """doc_id, set_key and the full shingle set (64-bit hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = list(text_sets(batch.column("text"), n_words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(set_key, found), pa.string()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], ["doc_id", "set_key", "shingles"])

    return docs.mapInArrow(run, "doc_id bigint, set_key string, shingles array<bigint>")


def unresolved(members: DataFrame, label: DataFrame | None) -> DataFrame:
    """Members of the buckets whose members are in more than one component, with their component ``c``."""
    if label is None:
        now = members.withColumn("c", F.col("id"))
    else:
        now = members.join(label.select(F.col("node").alias("id"), F.col("component")), "id", "left").select(
            *members.columns, F.coalesce("component", "id").alias("c"))
    open_ = now.groupBy("key").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).filter("c1 < c2").select("key")
    return now.join(open_, "key")


def incidence(sets: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
    """0/1 matrix: which of the sorted ``columns`` each sorted set holds."""
    out = np.zeros((len(sets), len(columns)), np.float32)
    for i, x in enumerate(sets):
        x = x[np.searchsorted(x, columns[0]) : np.searchsorted(x, columns[-1], "right")]
        p = np.searchsorted(columns, x)
        out[i, p[columns[p] == x]] = 1
    return out


def in_blocks(open_: DataFrame, asked: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The exact rest: classes outside a bucket's largest component against all classes of other components in the bucket.

    Both sides of a bucket are dealt into blocks of about BLOCK sets and CELLS shingles. A pair of blocks is one group of its own,
    wherever the bucket's other pairs are, so the work of a hot bucket is spread; ids are dealt first, sets fetched after.
    Intersections are counted at once by a product of 0/1 matrices, and only true links come out.
    """
    count = open_.groupBy("key", "c").agg(F.count("*").alias("k"))
    largest = count.groupBy("key").agg(F.max(F.struct("k", "c")).getField("c").alias("big"))
    mates = open_.join(largest, "key").join(asked.withColumn("told", F.lit(True)), ["key", "id"], "left").select("key", "id", "c", "n", ((F.col("c") != F.col("big")) & F.col("told").isNull()).alias("outside"))
    some = F.col("outside")
    sizes = mates.groupBy("key").agg(
        *(F.ceil(F.greatest(F.sum(F.when(w, 1).otherwise(0)) / BLOCK, F.sum(F.when(w, F.col("n")).otherwise(0)) / CELLS)).cast("int").alias(b) for w, b in ((some, "lefts"), (F.lit(True), "rights")))).filter("lefts > 0")
    mates = cut(mates.join(sizes, "key"), "mates")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")

    def blocks(df: DataFrame, name: str, place: str, number: str, others: str, other: str) -> DataFrame:
        """One row for each block of a side and each block of the other side that it meets."""
        full = df.withColumn(place, own(number)).join(sets, "id").withColumn("x", F.struct("c", "id", "shingles"))
        full = full.groupBy("key", place).agg(F.collect_list("x").alias(name), F.first(others).alias(others))  # bounded by BLOCK and CELLS
        return full.select("key", place, name, F.explode(F.sequence(F.lit(0), F.col(others) - 1)).alias(other))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})]
            for left, right in zip(pdf["left"], pdf["right"], strict=True):
                (s, ids, c), (t, others, e) = (([np.sort(np.asarray(x["shingles"], np.int64)) for x in side], *(np.array([x[k] for x in side], np.int64) for k in ("id", "c"))) for side in (left, right))
                both = np.intersect1d(np.concatenate(s), np.concatenate(t))
                shared = np.zeros((len(s), len(t)), np.float32)
                for at in range(0, len(both), 8192):
                    part = both[at : at + 8192]
                    shared += incidence(s, part) @ incidence(t, part).T
                size = np.array([len(x) for x in s])[:, None] + np.array([len(x) for x in t])[None, :]
                x, y = np.nonzero((shared * (100 + percent) >= percent * size) & (c[:, None] != e[None, :]))
                found.append(pd.DataFrame({"a": ids[x], "b": others[y]}))
            yield pd.concat(found).drop_duplicates()

    pairs = blocks(mates.filter("outside"), "left", "i", "lefts", "rights", "j").join(blocks(mates, "right", "j", "rights", "lefts", "i"), ["key", "i", "j"])
    out = cut(pairs.select("left", "right").mapInPandas(compare, "a bigint, b bigint").distinct(), "links")
    drop_cut(mates)
    return out


def linked(members: DataFrame, fetch, percent: int) -> DataFrame | None:
    """Links (a, b) that join all members which any chain of verified pairs of bucket mates joins; None without any.

    ``members``: key, id; ``fetch`` turns a table of ids into (id, shingles). A shingle that no other member has can't be
    shared, so the number of the others bounds every intersection; pairs below the bound are never made. That is exact,
    and keeps families of copies just below the similarity from being compared all with all.
    """
    shared = members.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    member = cut(members.join(shared, "key").select("key", "id", "m"), "members")
    # a class that shares many buckets with many others is compared first
    central = cut(member.groupBy("id").agg(F.sum("m").alias("central")), "central")
    sets = cut(fetch(central.select("id")), "sets")
    alone = sets.select("id", F.explode("shingles").alias("g")).groupBy("g").agg(F.count("*").alias("df"), F.min("id").alias("id")).filter("df = 1")
    alone = alone.groupBy("id").agg(F.count("*").alias("alone"))
    n = F.size("shingles").cast("bigint")
    sizes = sets.select("id", n.alias("n")).join(alone, "id", "left").select("id", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("common"))
    sizes = sizes.filter(F.col("common") * 100 >= percent * F.col("n")).join(central, "id")
    members = cut(member.join(sizes, "id").select("key", "id", "n", "common", "central"), "members")
    drop_cut(member)
    possible = (F.least("common", "p_common") * (100 + percent) >= percent * (F.col("n") + F.col("p_n"))) & (
        F.least("n", "p_n") * 100 >= percent * F.greatest("n", "p_n"))
    drop_cut(central)
    links, label = [], None
    scratch = []
    asked = None  # (key, id) of the classes that were compared with their whole bucket
    for step in range(ROUNDS + 1):
        open_ = cut(unresolved(members, label), "open")
        scratch.append(open_)
        if open_.isEmpty():
            break
        chosen = [F.col("id").alias("pivot"), F.col("n").alias("p_n"), F.col("common").alias("p_common"), F.col("c").alias("p_c")]
        if step < ROUNDS:
            left = open_ if asked is None else open_.join(asked, ["key", "id"], "left_anti")
            best = left.groupBy("key").agg(F.max(F.struct("central", (-F.col("id")).alias("neg"), "id", "n", "common", "c")).alias("p"))
            pivot = cut(best.select("key", "p.*").select("key", *chosen), "pivots")
            scratch.append(pivot)
            done = pivot.select("key", F.col("pivot").alias("id"))
            asked = done if asked is None else asked.unionByName(done)
            pairs = open_.join(pivot, (open_.key == pivot.key) & (F.col("c") != F.col("p_c")) & possible)
        else:
            links.append(in_blocks(open_, asked, sets, percent))
            break
        pairs = cut(pairs.select("pivot", "id").distinct(), "pairs")
        one = pairs.join(sets.select(F.col("id").alias("pivot"), F.col("shingles").alias("s")), "pivot")  # equal sets stay together and compress
        two = one.join(sets.select("id", F.col("shingles").alias("t")), "id")
        common = F.size(F.array_intersect("s", "t"))
        found = cut(two.filter(common * 100 >= percent * (F.size("s") + F.size("t") - common)).select(F.col("id").alias("a"), F.col("pivot").alias("b")), "links")
        drop_cut(pairs, label)
        links.append(found)
        label = cut(components(reduce(DataFrame.unionByName, links)), "labels")
    out = cut(reduce(DataFrame.unionByName, links), "links") if links else None
    drop_cut(sets, members, label, *scratch, *links)
    return out


def near_components(docs: DataFrame, n_words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable), kept."""
    feats = cut(features(docs, n_words), "features")
    known = feats.filter("doc_id is not null and n_shingles > 0")
    repeated = known.groupBy("doc_id").agg(F.min("set_key").alias("k1"), F.max("set_key").alias("k2")).filter("k1 != k2")
    one_text = repeated.isEmpty()
    # a node is a document; where a doc_id has several texts, it is a text, and a doc_id links its texts
    node = F.col("doc_id") if one_text else F.xxhash64("doc_id", "set_key")
    known = known.withColumn("node", node)
    classes = known.groupBy("set_key").agg(F.min("node").alias("id"), F.first("bands").alias("bands"))
    member = classes.select("id", F.explode("bands").alias("key"))

    def fetch(ids: DataFrame) -> DataFrame:
        """One shingle set of each class asked for, from the text of one of its documents."""
        of = known.select("doc_id", "set_key", F.col("node").alias("id")).join(ids, "id", "left_semi").distinct()
        some = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(of.select("doc_id").distinct(), "doc_id", "left_semi")
        return sets(some, n_words).join(of, ["doc_id", "set_key"]).select("id", "shingles").dropDuplicates(["id"])

    links = linked(member, fetch, percent)
    # all documents of a class belong together, and all texts of a doc_id
    edges = known.join(classes.select("set_key", "id"), "set_key").filter("node != id").select(F.col("node").alias("a"), F.col("id").alias("b"))
    edges = edges if links is None else links.unionByName(edges)
    if not one_text:
        first = known.groupBy("doc_id").agg(F.min("node").alias("b"))
        edges = edges.unionByName(known.join(first, "doc_id").select(F.col("node").alias("a"), "b"))
    label = components(edges)
    if not one_text:  # components are named by their smallest doc_id
        of = known.join(label, "node").select("doc_id", "component")
        label = of.join(of.groupBy("component").agg(F.min("doc_id").alias("low")), "component").select(F.col("doc_id").alias("node"), F.col("low").alias("component")).distinct()
    out = feats.select("doc_id", "n_shingles").join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    out = cut(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "near")
    drop_cut(feats, links)
    return out


def deduplicate(docs: DataFrame, n_words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose document stays: of each component the one with the smallest doc_id."""
    gone = near_components(docs, n_words, percent).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op2_near_dedup(spark, sf_dir):
    return near_components(table(spark, sf_dir, "documents"), n_words=2, percent=80)


OP2_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) END AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb, count(*) AS k FROM t x JOIN t y ON x.g = y.g AND x.doc_id < y.doc_id
      AND least(x.n, y.n) * 100 >= 80 * greatest(x.n, y.n) GROUP BY ALL HAVING 100 * k >= 80 * (na + nb - k)),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id AS node, doc_id AS c FROM s UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.node WHERE r.c < e.b),
m AS (SELECT node, min(c) AS c FROM r GROUP BY node)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c AS component_id, doc_id = c AS kept FROM s JOIN m ON m.node = s.doc_id
"""
