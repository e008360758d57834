"""Benchmark decontamination by winnowing: minimum k-gram hashes of sliding windows, joined and extended.

A window is ``window`` consecutive words of an item (an item of fewer is one window). Of every run of as many document or item words, the
least of its k-gram hashes is kept, so equal runs keep equal fingerprints: whatever span of that many words two
texts share, they share a fingerprint in it. Fingerprints are joined, and each hit is extended word by word to both
sides; it counts if the run reaches the length of the window. Items shorter than a window have runs, and k, of their
own length; only lengths that occur are computed.

Texts are read once. A document's fingerprints leave that pass only if their bit is set in a table of the items'
fingerprints, of a fixed size (``BITS``) whatever the number of items: few others pass, and the join drops them. Equal
surroundings of several items are one row of the join. A fingerprint that many documents share meets the items' rows
in a plain equi-join without an aggregate on its key, which adaptive execution may split or broadcast by size.

Defined results: null, empty and wordless texts have no words and no hits; items without words are never found; a
repeated item_id is found if any of its texts is, and counts once; an item without an id is found but named nowhere
(n_items and items_sha256 leave it out, n_hit counts its words); repeated rows and a doc_id with several texts get a
row each, for their own text; rows without a doc_id too; texts of any length are read whole; an empty table of items
leaves every document clean; an empty table of documents gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, doc_id, keyed, table
from .words import Words, buffer_of, groups, mixed, shingle_hashes, sliding_min

WINDOW = 10
#: The table of the items' fingerprints has 2**BITS bits (8 MB), whatever the number of items.
BITS = 26

#: Bytes outside words: words are runs of digits, letters and all code points beyond ASCII.
OUTSIDE = np.ones(256, bool)
OUTSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def plan(length: int) -> tuple[int, int]:
    """k, and the number of k-grams in a run of ``length`` words."""
    k = (length + 1) // 2
    return k, length - k + 1


def kept(h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint of each run of ``length`` words, and all k-gram hashes; lengths don't share hashes."""
    k, w = plan(length)
    with np.errstate(over="ignore"):
        grams = mixed(shingle_hashes(h, k) + np.uint64(length))
    return (sliding_min(grams, w) if len(grams) >= w else grams[:0]), grams


class Text:
    """The words of some texts, at once."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        self.words = Words(data, offsets, OUTSIDE)

    def runs(self, length: int) -> np.ndarray:
        """Which runs of ``length`` words lie in one text."""
        n = len(self.words.hash) - length + 1
        if n <= 0:
            return np.empty(0, bool)
        inside = np.ones(n, bool)
        for edge in self.words.first[1:-1]:
            inside[max(0, edge - length + 1) : edge] = False
        return inside

    def word(self, i: int) -> str:
        return self.data[self.words.start[i] : self.words.end[i]].tobytes().decode().translate(LOWER)

    def around(self, p: int, first: int, last: int, window: int) -> list[str | None]:
        """The words that a run through the k-gram at ``p`` may reach, none outside its text."""
        before = plan(window)[1] - 1
        return [self.word(i) if first <= i < last else None for i in range(p - before, p + window)]


LOWER = {i: i + 32 for i in range(65, 91)}


def chosen(grams: np.ndarray, runs: np.ndarray, w: int) -> np.ndarray:
    """Where the fingerprints of these runs stand (the last of equal ones)."""
    places = np.empty(len(runs), np.int64)
    for at in range(0, len(runs), 1 << 16):
        some = runs[at : at + (1 << 16)]
        places[at : at + (1 << 16)] = some + w - 1 - np.argmin(grams[some[:, None] + np.arange(w - 1, -1, -1)], axis=1)
    return np.unique(places)


PRINT = "struct<length:int,print:bigint,at:bigint,around:array<string>>"


def prints(column: pa.Array, lengths: list[int], window: int, bits: np.ndarray | None) -> Iterator[tuple[int, list]]:
    """Of each text, the number of words and its fingerprints (those whose bit is set, where ``bits`` are given).

    Without ``bits``, the texts are items: each has runs of the window's length, or of its own if it is shorter.
    """
    data, offsets = buffer_of(column)
    for i, j in groups(offsets):
        t = Text(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        first, out = t.words.first, [[] for _ in range(j - i)]
        counts = t.words.counts
        for length in lengths:
            low, grams = kept(t.words.hash, length)
            good = t.runs(length)
            if bits is not None:
                place = (low >> np.uint64(64 - BITS)).astype(np.int64)
                good &= (bits[place >> 3] >> (place & 7)) & 1 > 0
            for p in chosen(grams, np.flatnonzero(good), plan(length)[1]).tolist():
                k = int(np.searchsorted(first, p, "right")) - 1
                if bits is not None or length == min(window, counts[k]):
                    out[k].append({"length": length, "print": int(grams[p : p + 1].view(np.int64)[0]), "at": p - int(first[k]), "around": t.around(p, first[k], first[k + 1], window)})
        yield from zip(counts.tolist(), out, strict=True)


def printed(texts: DataFrame, keys: list[str], lengths: list[int], window: int, bits=None) -> DataFrame:
    """``keys``, n_words and the fingerprints of each text; ``bits``: a broadcast table of bits."""
    kinds = ", ".join(f"{k} {t}" for k, t in texts.select(*keys).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("length", pa.int32()), ("print", pa.int64()), ("at", pa.int64()), ("around", pa.list_(pa.string()))]))
        for batch in batches:
            found = list(prints(batch.column("text"), lengths, window, None if bits is None else bits.value))
            n, p = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(n, pa.int64()), pa.array(p, kind)], [*keys, "n_words", "prints"])

    return texts.select(*keys, "text").mapInArrow(run, f"{kinds}, n_words bigint, prints array<{PRINT}>")


def bit_table(spark: SparkSession, prints_: DataFrame):
    """A table of bits, of fixed size, with one set for each fingerprint; made by groups of bits, broadcast."""
    place = F.shiftrightunsigned("print", 64 - BITS) + 1  # buckets count from 1
    parts = prints_.select(F.bitmap_bucket_number(place).alias("b"), F.bitmap_bit_position(place).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits"))
    out = np.zeros((1 << (BITS - 15), 4096), np.uint8)
    for row in parts.collect():  # at most 2**(BITS - 15) rows of 4 KB
        out[row.b - 1] = np.frombuffer(bytes(row.bits), np.uint8)
    return spark.sparkContext.broadcast(out.reshape(-1))


def reach(same: Column, window: int) -> tuple[Column, Column]:
    """Of an array of agreeing words, how far the run through the k-gram goes to the left and (from its first word) to the right."""
    before = plan(window)[1] - 1
    right = F.array_position(F.slice(same, before + 1, window), F.lit(False))
    left = F.array_position(F.reverse(F.slice(same, 1, before)), F.lit(False)) if before else F.lit(1)
    return F.when(left > 0, left - 1).otherwise(before), F.when(right > 0, right - 1).otherwise(window)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents as ``d``, ``h`` (of common.keyed) and n_words; the hits: d, h, first and last word (end exclusive), kind, theirs; the kinds' item_id.

    A hit is a longest run around one fingerprint; the runs of a document may overlap. Items of equal surroundings are one kind.
    """
    spark = docs.sparkSession
    texts = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    made = cut(printed(texts, ["item_id"], list(range(1, window + 1)), window), "items")
    item_prints = made.select("item_id", F.explode("prints").alias("p")).select("item_id", "p.*")
    lengths = sorted(r.length for r in item_prints.select("length").distinct().collect())  # at most ``window`` rows
    here = cut(printed(keyed(docs), ["d", "h"], lengths, window, bit_table(spark, item_prints)), "prints")
    item_prints = item_prints.withColumn("kind", F.xxhash64("length", "print", "around"))
    kinds = item_prints.select("kind", "length", "print", F.col("around").alias("theirs")).dropDuplicates(["kind", "theirs"])
    own = here.select("d", "h", F.explode("prints").alias("p")).select("d", "h", "p.*")
    same = F.zip_with("around", "theirs", lambda x, y: F.coalesce(x == y, F.lit(False)))
    left, right = reach(F.col("same"), window)
    hits = own.join(kinds, ["length", "print"]).withColumn("same", same).withColumn("left", left).withColumn("right", right).filter(F.col("left") + F.col("right") >= F.col("length"))
    hits = hits.select("d", "h", (F.col("at") - F.col("left")).alias("first"), (F.col("at") + F.col("right")).alias("last"), "kind", "theirs")
    members = item_prints.filter("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), "kind", F.col("around").alias("theirs")).distinct()
    return here.select("d", "h", "n_words"), cut(hits, "hits"), members


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted as strings) of every document."""
    here, hits, members = contamination(docs, items, window)
    before = Window.partitionBy("d", "h").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.select("d", "h", "first", "last").distinct().withColumn("_to", F.coalesce(F.max("last").over(before), F.lit(0)))
    n = spans.groupBy("d", "h").agg(F.sum(F.greatest(F.lit(0), F.col("last") - F.greatest("first", "_to"))).alias("n_hit"))
    named = hits.select("d", "h", "kind", "theirs").distinct().join(members, ["kind", "theirs"]).groupBy("d", "h").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    return here.join(n, ["d", "h"], "left").join(named, ["d", "h"], "left").select(
        doc_id(), "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def op13_decontamination(spark, sf_dir):
    found = decontaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words, row_number() OVER () AS r FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(words), 10) AS n, array_to_string(words[i:i + 9], ' ') AS run FROM b, unnest(range(1, greatest(len(words) - 10, 0) + 2)) AS t(i) WHERE len(words) > 0),
dw AS (SELECT r, i, n, array_to_string(words[i:i + n - 1], ' ') AS run FROM d, (SELECT DISTINCT n FROM bw) AS k, unnest(range(1, len(words) - n + 2)) AS t(i)),
hit AS (SELECT dw.r, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.run = bw.run),
w AS (SELECT r, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) AS t(p) GROUP BY r),
m AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(w.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(m.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(m.names, '')) AS items_sha256, coalesce(w.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN w ON d.r = w.r LEFT JOIN m ON d.r = m.r
"""
