"""Repeated paragraphs: MinHash banding, exact verification, removal by components.

A paragraph is a stretch of words between borders that depend on the words around them only, so a passage gives the same
paragraphs after any lead: a word begins one if its hash, taken with the next word, is the least among ``REACH`` words before
and after (11 words a paragraph on average, 6 at least). Equal paragraphs are one class (128 bits of their shingles) before
anything is compared. Minimum and maximum of a permutation of the five-word shingles make one band, ``BANDS`` permutations
as many bands: at similarity 0.8 a pair shares none with chance (1 - 0.8**2)**4 = 0.017, at 7/8 (one shingle of an average
paragraph) with 0.003, and copies always share all. Classes that collide are joined and their exact Jaccard similarity
verified on full sets. Of each connected component the first paragraph (smallest doc_id, then place) stays, all others are
repeated. Repeated paragraphs that follow each other are a passage. Its ends are then extended word by word as far as the text
around the first paragraph agrees, up to two paragraphs on each side, as borders near the ends of a passage depend on what surrounds
it. Passages with ``LEAST`` words in repeated paragraphs, or ``LONG`` words with what was added, go; shorter ones (a licence
line, a greeting) stay. A text below ``LEAST`` words is one paragraph, which goes if it repeats another such text as a whole.

Defined results: null and empty texts have no paragraphs; words are compared in lower case (A-Z); rows that repeat a doc_id are
one document and keep their common paragraphs; rows without a doc_id come after all others, each a document of its own, in order
of their text's hash, and of equal ones one stays; ties can't occur, as places are distinct; texts are handled whole at any
length, one at a time beyond a mebibyte; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, cut, doc_id, drop_cut, keyed, salt, salted, salts_of, table
from .components import components
from .minhash import linked
from .words import Words, buffer_of, groups, mixed, shingle_hashes, sliding_min

N_WORDS, PERCENT = 5, 80
#: Words on both sides that a border depends on.
REACH = 5
#: Words of the shortest passage that goes.
LEAST = 15
#: Words of a passage that goes although fewer than LEAST of them are in repeated paragraphs.
LONG = 20
#: Paragraphs on each side that an end may be extended by.
AROUND = 2
BANDS = 4
SEEDS = np.random.RandomState(3).randint(0, 2**63, 2 * BANDS + 2, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
#: Orders documents by doc_id, those without one behind by the hash of their text, at any size of either; then paragraphs by place.
ORDER = f"CASE WHEN d = {NO_ID} THEN cast(h as decimal(38,0)) + {3 << 63} ELSE cast(d as decimal(38,0)) + {1 << 63} END"
PLACE = f"({ORDER}) * {1 << 32} + idx"


class Units:
    """The paragraphs of some texts: ``row``, ``idx`` in the text, first and end word; ``whole`` texts below LEAST words; ``shingles`` by first word."""

    def __init__(self, b: np.ndarray, offsets: np.ndarray):
        w = Words(b, offsets)
        n, counts = len(w.hash), w.counts
        row = np.repeat(np.arange(len(counts)), counts)
        first, last = w.first[:-1][row], w.first[1:][row]
        begins = np.arange(n) == first
        if n > 2 * REACH + 1:
            with np.errstate(over="ignore"):
                v = mixed(w.hash[:-1] * np.uint64(3) + w.hash[1:])
            low = sliding_min(v, REACH)
            p = np.arange(REACH, len(v) - REACH)
            least = (v[p] < low[p - REACH]) & (v[p] <= low[p + 1])
            begins[p] |= least & (p - first[p] >= REACH) & (p <= last[p] - 2 - REACH) & (counts[row[p]] >= LEAST)
        self.start = np.flatnonzero(begins)
        self.end = np.append(self.start[1:], n)[: len(self.start)]
        self.row = row[self.start]
        self.whole = counts[self.row] < LEAST
        self.words, self.first = w.hash, w.first
        new = np.ones(len(self.row), bool)
        new[1:] = self.row[1:] != self.row[:-1]
        at = np.arange(len(self.row))
        self.idx = at - np.maximum.accumulate(np.where(new, at, 0)) if len(at) else at
        self.shingles = shingle_hashes(w.hash, N_WORDS)

    def folded(self, how: np.ufunc, values: np.ndarray) -> np.ndarray:
        """``how`` over each paragraph's shingles; without a meaning for whole texts."""
        at = np.empty(2 * len(self.start), np.int64)
        at[::2], at[1::2] = self.start, np.maximum(self.end - N_WORDS, self.start) + 1
        return how.reduceat(np.append(values, np.zeros(N_WORDS, np.uint64)), at)[::2] if len(at) else np.empty(0, np.uint64)

    def classes(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit sums over the shingles: equal for equal paragraphs. Over words and their places where a text is whole."""
        out = []
        with np.errstate(over="ignore"):
            place = (np.arange(len(self.words)) - np.repeat(self.first[:-1], np.diff(self.first))).astype(np.uint64)
            for k in (1, 2):
                c = self.folded(np.add, mixed(self.shingles * SEEDS[-k]))
                if self.whole.any():
                    of_words = mixed(self.words * SEEDS[-k] + mixed(place + np.uint64(k)))
                    c[self.whole] = mixed(np.add.reduceat(of_words, self.start)[self.whole] + SEEDS[k])
                out.append(c)
        return tuple(out)

    def bands(self) -> list[np.ndarray]:
        out = []
        with np.errstate(over="ignore"):
            for j in range(BANDS):
                p = mixed(self.shingles * SEEDS[2 * j] + SEEDS[2 * j + 1])
                out.append(mixed(self.folded(np.minimum, p) * np.uint64(3) + self.folded(np.maximum, p) + np.uint64(j)))
        return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, int, Units]]:
    for batch in batches:
        data, offsets = buffer_of(batch.column("text"))
        for i, j in groups(offsets):
            yield batch, i, j, Units(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def signed_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class, place and band keys of every paragraph."""
    for batch, i, j, u in _units(batches):
        c1, c2 = u.classes()
        d, h = (batch.column(c).slice(i, j - i).take(pa.array(u.row)) for c in ("d", "h"))
        keys = [pa.array(k.view(np.int64), mask=u.whole) for k in u.bands()]
        yield pa.RecordBatch.from_arrays([_signed(c1), _signed(c2), d, h, pa.array(u.idx.astype(np.int32)), *keys], ["c1", "c2", "d", "h", "idx", *(f"k{k}" for k in range(BANDS))])


def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class and place of every paragraph, with its first word and number of words."""
    for batch, i, j, u in _units(batches):
        c1, c2 = u.classes()
        d, h = (batch.column(c).slice(i, j - i).take(pa.array(u.row)) for c in ("d", "h"))
        ints = [pa.array(x.astype(np.int32)) for x in (u.idx, u.start - u.first[u.row], np.where(u.whole, LEAST, u.end - u.start))]
        yield pa.RecordBatch.from_arrays([_signed(c1), _signed(c2), d, h, *ints], ["c1", "c2", "d", "h", "idx", "s", "n"])


def shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The full shingle sets of the classes that are asked of each text."""
    for batch, i, j, u in _units(batches):
        asked = batch.column("asked")
        c1, ids, sets = u.classes()[0].view(np.int64), [], []
        at = np.searchsorted(u.row, np.arange(j - i + 1))
        for k in range(i, j):
            own = {int(c): int(x) for c, x in zip(c1[at[k - i] : at[k - i + 1]], range(at[k - i], at[k - i + 1]), strict=True)}
            for x in asked[k].as_py():
                if x["c1"] in own:
                    q = own[x["c1"]]
                    ids.append(x["id"])
                    sets.append(np.unique(u.shingles[u.start[q] : u.end[q] - N_WORDS + 1].view(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"])


def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the words before and after the paragraphs that are asked of each text, nearest first."""
    for batch, i, j, u in _units(batches):
        asked, rows = batch.column("asked"), []
        at = np.searchsorted(u.row, np.arange(j - i + 1))
        for k in range(i, j):
            low, high = int(at[k - i]), int(at[k - i + 1])
            for x in asked[k].as_py():
                q = low + x["idx"]
                if q < high:
                    before = u.words[u.start[max(q - AROUND, low)] : u.start[q]][::-1]
                    after = u.words[u.end[q] : u.end[min(q + AROUND, high - 1)]]
                    rows.append((x["first"], x["_salts"], batch.column("h")[k].as_py(), before.view(np.int64), after.view(np.int64)))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.decimal128(38, 0), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)], ["first", "_salts", "h", "before", "after"])


def repeated_paragraphs(docs: DataFrame) -> DataFrame:
    """v, h, idx, s (first word), n (words) and the first place of every paragraph that repeats an earlier one; ``docs`` as ``ordered`` gives them."""
    keys = [f"k{k}" for k in range(BANDS)]
    found = docs.select("d", "h", "text").mapInArrow(signed_bands, f"c1 bigint, c2 bigint, d bigint, h bigint, idx int, {', '.join(f'{k} bigint' for k in keys)}")
    each = found.withColumn("place", F.expr(PLACE)).withColumn("_s", salt("d", "h"))
    classes = each.groupBy("c1", "c2").agg(F.min("place").alias("place"), F.count("*").alias("copies"), salts_of(), *(F.min(k).alias(k) for k in keys))
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()), "classes")  # ids are fixed once written
    members = classes.select("id", F.explode(F.array(*keys)).alias("key")).filter("key is not null")

    def fetch(ids: DataFrame) -> DataFrame:
        """One set of each class, from the text where it stands first."""
        wanted = classes.select("id", "c1", "place").join(ids, "id", "left_semi")
        asked = wanted.select(_document("place").alias("v"), F.struct("c1", "id").alias("x")).groupBy("v").agg(F.collect_list("x").alias("asked"))
        return docs.join(asked, "v").select("text", "asked").mapInArrow(shingle_sets, "id bigint, shingles array<bigint>").dropDuplicates(["id"])

    links = linked(members, fetch, PERCENT)
    several = classes.filter("copies > 1").select("id", "c1", "c2", "_salts", "place")
    label = None
    if links is None:
        first = several.withColumn("first", F.col("place"))
    else:
        label = cut(components(links), "labels")
        near = classes.join(label.withColumnRenamed("node", "id"), "id").select("id", "c1", "c2", "_salts", "place", "component")
        low = near.groupBy("component").agg(F.min("place").alias("first"))
        first = near.join(low, "component").select(*several.columns, "first").unionByName(several.join(label, several.id == label.node, "left_anti").withColumn("first", F.col("place")))
    first = cut(salted(first.select("c1", "c2", "_salts", "first")), "firsts")
    every = docs.select("d", "h", "text").mapInArrow(places, "c1 bigint, c2 bigint, d bigint, h bigint, idx int, s int, n int").withColumn("_s", salt("d", "h"))
    gone = every.join(first, ["c1", "c2", "_s"]).withColumn("first", F.col("first").cast("decimal(38,0)")).filter(F.expr(PLACE) != F.col("first"))
    out = cut(gone.select(F.expr(ORDER).cast("decimal(38,0)").alias("v"), "h", "idx", "s", "n", "first"), "repeated")
    drop_cut(classes, first, links, label)
    return out


def _document(place: str):
    return F.floor(F.col(place) / F.lit(1 << 32)).cast("decimal(38,0)")


def ordered(docs: DataFrame) -> DataFrame:
    """v (order of documents), d, h, text and times; rows without a doc_id are one for each text, ``times`` of them."""
    none = keyed(docs.filter("doc_id is null")).groupBy("d", "h").agg(F.first("text").alias("text"), F.count("*").alias("times"))
    every = keyed(docs.filter("doc_id is not null")).withColumn("times", F.lit(1).cast("bigint")).unionByName(none)
    return every.select(F.expr(ORDER).cast("decimal(38,0)").alias("v"), "d", "h", "text", "times")


def _same(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the common beginning."""
    n = min(len(x), len(y))
    other = np.flatnonzero(x[:n] != y[:n])
    return int(other[0]) if len(other) else n


def _passages(found: list[dict], near: dict, words: np.ndarray) -> list[tuple[int, int]]:
    """First and end word of what goes: runs of neighbouring paragraphs, extended as far as the first places' surroundings agree."""
    runs, out = [], []
    for x in found:
        if runs and x["idx"] == runs[-1][-1]["idx"] + 1:
            runs[-1].append(x)
        else:
            runs.append([x])
    ends = [0, *(min(r[-1]["s"] + r[-1]["n"], len(words)) for r in runs)]
    starts = [*(r[0]["s"] for r in runs), len(words)]
    for k, run in enumerate(runs):
        a, z = starts[k], ends[k + 1]
        before, _ = near.get(run[0]["first"], ((), ()))
        _, after = near.get(run[-1]["first"], ((), ()))
        a -= _same(words[ends[k] : a][::-1], np.array(before, np.int64))
        z += _same(words[z : starts[k + 1]], np.array(after, np.int64))
        if sum(x["n"] for x in run) >= LEAST or z - a >= LONG:
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], z)
            else:
                out.append((a, z))
    return out


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffer_of(batch.column("text"))
        whole, gone, around_, copy, rows = data.tobytes(), batch.column("gone"), batch.column("near"), batch.column("copy").to_pylist(), []
        has = gone.is_valid().to_numpy(zero_copy_only=False)
        for k in range(len(batch)):
            text = whole[offsets[k] : offsets[k + 1]]
            spans = []
            if has[k] or copy[k] > 1:
                b = np.frombuffer(text, np.uint8)
                w = Words(b, np.array([0, len(b)]))
                near = {x["first"]: (x["before"], x["after"]) for x in around_[k].as_py() or ()}
                cuts = [(0, len(w.hash))] * bool(len(w.hash)) if copy[k] > 1 else _passages(gone[k].as_py(), near, w.hash.view(np.int64))
                spans = [(int(w.start[a]), int(w.end[z - 1])) for a, z in cuts]
            if not spans:
                rows.append((0, 0, hashlib.sha256(text).hexdigest(), "", text))
                continue
            at = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)  # characters up to each byte
            chars = [(int(at[a - 1]) if a else 0, int(at[z - 1])) for a, z in spans]
            kept = b"".join(text[a:z] for (_, a), (z, _) in zip([(0, 0), *spans], [*spans, (len(text), 0)], strict=True))
            rows.append((len(spans), sum(z - a for a, z in chars), hashlib.sha256(kept).hexdigest(), ",".join(f"{a}:{z}" for a, z in chars), kept))
        n, size, digest, spans, kept = zip(*rows, strict=True) if rows else ((),) * 5
        texts = pa.array(kept, pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array(n, pa.int64()), pa.array(size, pa.int64()), pa.array(digest, pa.string()), pa.array(spans, pa.string()), texts], ["d", "n_removed", "removed_chars", "kept_sha256", "spans", "kept"])


def substring_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_removed (passages), removed_chars, kept_sha256, spans (characters, end exclusive) and the kept text."""
    whole = ordered(docs)
    gone = repeated_paragraphs(whole)
    runs = cut(gone.groupBy("v", "h").agg(F.sort_array(F.collect_list(F.struct("idx", "s", "n", "first"))).alias("gone")), "runs")
    drop_cut(gone)
    last = "size(gone) - 1"
    ends = F.expr(f"filter(gone, (x, i) -> i = 0 OR i = {last} OR gone[i - 1].idx + 1 < x.idx OR gone[i + 1].idx - 1 > x.idx)")
    ends = runs.select("v", "h", F.explode(F.array_distinct(F.transform(ends, lambda x: x["first"]))).alias("first")).withColumn("_s", salt("v", "h"))
    asked = ends.groupBy("first").agg(salts_of()).select(_document("first").alias("v"), F.struct(F.expr(f"cast(first % {1 << 32} as bigint)").alias("idx"), "first", "_salts").alias("x"))
    asked = asked.groupBy("v").agg(F.collect_list("x").alias("asked"))
    near = whole.join(asked, "v").select("h", "text", "asked").mapInArrow(around, "first decimal(38,0), _salts bigint, h bigint, before array<bigint>, after array<bigint>")
    near = near.groupBy("first", "_salts").agg(F.min_by(F.struct("before", "after"), "h").alias("x")).select("first", "_salts", "x.*")
    near = ends.join(salted(near), ["first", "_s"]).groupBy("v", "h").agg(F.collect_list(F.struct("first", "before", "after")).alias("near"))
    found = runs.join(near, ["v", "h"], "left").withColumnRenamed("h", "_h").withColumnRenamed("v", "_v")
    every = whole.join(found, (F.col("v") == F.col("_v")) & (F.col("h") - F.col("_h") == 0), "left")
    each = every.select("d", "text", "gone", "near", F.explode(F.sequence(F.lit(1).cast("bigint"), "times")).alias("copy"))
    out = each.mapInArrow(_kept, "d bigint, n_removed bigint, removed_chars bigint, kept_sha256 string, spans string, kept string")
    return out.select(doc_id(), "n_removed", "removed_chars", "kept_sha256", "spans", "kept")


def op4_substring_dedup(spark, sf_dir):
    return substring_dedup(table(spark, sf_dir, "documents")).drop("kept")
