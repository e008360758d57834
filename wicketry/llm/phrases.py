"""Repeated 100-byte strings across a corpus, by prefix-free parsing.

A rolling hash over ``GRAM`` bytes sets triggers: the smallest value of each run of 69 neighbouring grams. Every 100-byte
string therefore holds a trigger, equal strings hold the same one at the same place, and triggers cut the texts into
overlapping phrases: the start positions whose strings share a trigger, with all bytes these strings span. The
dictionary is the set of distinct phrases, the parse is where they occur.

* The parse: occurrences are range-sorted by trigger and content. A phrase that occurred before repeats each of its
  strings: all its bytes go.
* The dictionary: only phrases that share their trigger with a different phrase can share a part of their strings. Suffixes
  of these phrases are put in order of their first 100 bytes by prefix doubling (ranks of 8, 16, 32 and 100 bytes, exact on
  bytes); suffixes of equal rank are equal strings, of which all but the first place go.

As phrases overlap by 99 bytes, each string lies in one phrase, so the parse needs no order beyond first places. Phrases of a
hot trigger are spread over ranges by their content. What a batch repeats is told at once and merged into stretches; what is
left of a trigger's phrases is dealt into parts of about ``PART`` bytes by the content of each string.

Defined results: null and empty texts have no bytes; texts below 100 bytes lose nothing; rows of equal doc_id and text are one
document (a string isn't earlier than itself); texts of one doc_id that differ are ordered by hash; rows without a doc_id
come after all others, ordered by hash; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, doc_id, drop_cut, keyed, salt, salted, salts_of, table
from .words import buffer_of, mixed, sliding_min

LENGTH, GRAM = 100, 32
#: Bytes handled at once: bounds memory for texts of any length.
CHUNK = 1 << 19
#: Bytes of a trigger's phrases that one task orders at once, about.
PART = 1 << 18
LOW = np.uint64((1 << 20) - 1)

_rng = np.random.RandomState(77)
TABLE = _rng.randint(0, 2**63, (2, 256), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x5851F42D4C957F2D)
POWER = np.uint64(0xD1342543DE82EF95)
_powers: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """Powers of POWER and of its inverse modulo 2**64, for hashes of any stretch of ``n`` bytes."""
    if not _powers or len(_powers[0]) <= n:
        _powers.clear()
        for base in (POWER, np.uint64(pow(int(POWER), -1, 1 << 64))):
            with np.errstate(over="ignore"):
                _powers.append(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, CHUNK + LENGTH), base))]))
    return _powers


def gram_hashes(b: np.ndarray, size: int) -> np.ndarray:
    """Rolling hash of each run of ``size`` bytes (a power of two)."""
    h, base, have = TABLE[0][b], BASE, 1
    with np.errstate(over="ignore"):
        while have < size:
            h = h[:-have] * base + h[have:]
            base = base * base
            have *= 2
    return mixed(h)


def stretch_hashes(b: np.ndarray):
    """A function that hashes stretches [start, end) of ``b``."""
    up, down = powers(len(b))
    with np.errstate(over="ignore"):
        p = np.concatenate([np.zeros(1, np.uint64), np.cumsum(TABLE[1][b] * up[: len(b)])])

    def of(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((p[end] - p[start]) * down[start] + (end - start).astype(np.uint64))

    return of


def pieces(offsets: np.ndarray) -> Iterator[list[tuple[int, int, int]]]:
    """Chunks of at most CHUNK bytes: stretches of texts as (row, offset in the text, bytes)."""
    held, size = [], 0
    for row, n in enumerate(np.diff(offsets).tolist()):
        for at in range(0, max(1, n - LENGTH + 1), CHUNK // 2):
            part = min(CHUNK // 2 + LENGTH - 1, n - at)
            if part < LENGTH:
                continue
            if size + part > CHUNK:
                yield held
                held, size = [], 0
            held.append((row, at, part))
            size += part
    if held:
        yield held


def phrases(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """The phrases of texts, chunk by chunk: trigger, content hash, row, first start, number of starts."""
    for held in pieces(offsets):
        row, at, sizes = (np.array(x, np.int64) for x in zip(*held, strict=True))
        b = np.concatenate([data[offsets[r] + a : offsets[r] + a + n] for r, a, n in held])
        ends = np.cumsum(sizes)
        g = gram_hashes(b, GRAM)
        marked = (g & ~LOW) | np.arange(len(g), dtype=np.uint64)
        trigger = (sliding_min(marked, LENGTH - GRAM + 1) & LOW).astype(np.int64)
        valid = np.zeros(len(trigger) + 1, bool)
        for s, e in zip(ends - sizes, ends, strict=True):
            valid[s : e - LENGTH + 1] = True
        valid = valid[:-1]
        fresh = np.ones(len(trigger), bool)
        fresh[1:] = (trigger[1:] != trigger[:-1]) | ~valid[:-1]
        stop = np.ones(len(trigger), bool)
        stop[:-1] = fresh[1:] | ~valid[1:]
        first, last = np.flatnonzero(fresh & valid), np.flatnonzero(stop & valid)
        k = np.searchsorted(ends, first, side="right")
        yield g[trigger[first]].view(np.int64), stretch_hashes(b)(first, last + LENGTH).view(np.int64), row[k], first - (ends - sizes)[k] + at[k], last - first + 1


def later(keys: list[np.ndarray], place: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order by keys, then place; and, in that order, which rows have a smaller place of the same keys before them."""
    order = np.lexsort([*place[::-1], *keys[::-1]])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    again = np.zeros(len(order), bool)
    for x in place:
        again |= x[order] != x[order][first]
    return order, again


def merged(d: np.ndarray, h: np.ndarray, p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches of starts of each document, joined where they touch."""
    if not len(d):
        return d, h, p, n
    order = np.lexsort([p, h, d])
    d, h, p, n = d[order], h[order], p[order], n[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    # running end inside a document
    shift = np.cumsum(new) * np.int64(1 << 40)
    end = np.maximum.accumulate(p + n + shift)
    new[1:] |= (p + shift)[1:] > end[:-1]
    starts = np.flatnonzero(new)
    return d[starts], h[starts], p[starts], (end - shift)[np.append(starts[1:], len(d)) - 1] - p[starts]


NAMES = ["trigger", "content", "d", "h", "p", "n", "kind"]


def _rows(kind: int, trigger, content, d, h, p, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (trigger, content, d, h)), *(pa.array(x.astype(np.int32)) for x in (p, n)), pa.array(np.full(len(d), kind, np.int8))], NAMES)


def _numbers(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False) for c in names]


def _gone(d, h, p, n) -> pa.RecordBatch:
    """What goes (kind 1), dealt out by document."""
    d, h, p, n = merged(d, h, p, n)
    return _rows(1, mixed(d.view(np.uint64)).view(np.int64), h, d, h, p, n)


def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases of each batch, the first of equal ones only (kind 0); the others go (kind 1)."""
    for batch in batches:
        data, offsets = buffer_of(batch.column("text"))
        d, h = _numbers(batch, "d", "h")
        found = list(phrases(data, offsets))
        if found:
            t, c, row, p, n = (np.concatenate(x) for x in zip(*found, strict=True))
            order, again = later([t, c], [d[row], h[row], p])
            x = [v[order] for v in (t, c, d[row], h[row], p, n)]
            yield _gone(*(v[again] for v in x[2:]))
            yield _rows(0, *(v[~again] for v in x))


def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted phrases of one range, as a stream: repeats (kind 1), and phrases whose trigger has another phrase too (kind 2).

    A trigger at a border of the range may go on beyond it: it is told (kind 4), with its only phrase if it has one here (kind 3).
    """
    head: list | None = None  # first row of the trigger at hand, first row of the phrase at hand
    several, first_open = False, True  # whether that trigger has several phrases; whether it is the range's first

    def border(row: list, alone: bool) -> Iterator[pa.RecordBatch]:
        one = [np.array([v]) for v in row]
        yield _rows(4, *one)
        if alone:
            yield _rows(3, *one)

    for batch in batches:
        x = _numbers(batch, *NAMES)
        gone = x[6] == 1
        if gone.any():
            yield _rows(1, *(v[gone] for v in x[:6]))
        x = [v[~gone] for v in x[:6]]
        if not len(x[0]):
            continue
        carried = head is not None
        if carried:
            x = [np.concatenate([[a, b], v]) for a, b, v in zip(*head, x, strict=True)]
        t, c = x[:2]
        new_t = np.ones(len(t), bool)
        new_t[1:] = t[1:] != t[:-1]
        new_c = new_t.copy()
        new_c[1:] |= c[1:] != c[:-1]
        starts, group = np.flatnonzero(new_t), np.cumsum(new_t) - 1
        held = np.maximum.accumulate(np.where(new_c, np.arange(len(t)), 0))
        again = np.zeros(len(t), bool)
        for v in x[2:5]:
            again |= v != v[held]
        again[: 2 * carried] = False
        second = new_c & ~new_t
        has = np.zeros(len(starts), bool)
        has[group[second]] = True
        pick = second.copy()
        pick[starts[has]] = True
        if carried:
            pick[0] &= not several
            pick[1] = False
            has[0] |= several
        if again.any():
            yield _gone(*(v[again] for v in x[2:]))
        if pick.any():
            yield _rows(2, *(v[pick] for v in x))
        if first_open and len(starts) > 1:
            yield from border([v[0] for v in x], not has[0])
            first_open = False
        several = bool(has[-1])
        head = [[v[starts[-1]] for v in x], [v[held[-1]] for v in x]]
    if head is not None:
        yield from border(head[0], not several)


def ranks(b: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Keys of the 100 bytes at each start, in the order of the suffixes of ``b`` and equal for equal bytes, by prefix doubling.

    As in suffix sorting, what the first 32 bytes tell apart is settled and not sorted further.
    """
    n = np.int64(len(b) + 1)
    v = np.zeros(len(b), np.uint64)
    padded = np.concatenate([b, np.zeros(8, np.uint8)]).astype(np.uint64)
    for k in range(8):
        v = (v << np.uint64(8)) | padded[k : k + len(b)]
    r, have = np.unique(v, return_inverse=True)[1].astype(np.int64), 8
    while have < 32:
        ahead = np.concatenate([r[have:], np.zeros(have, np.int64)])
        r, have = np.unique(r * n + ahead, return_inverse=True)[1].astype(np.int64), have * 2
    key = r[starts]
    open_ = np.bincount(key)[key] > 1
    s = starts[open_]
    more = np.unique(r[s + 32] * n + r[s + 64], return_inverse=True)[1].astype(np.int64)
    more = np.unique(more * n + r[s + LENGTH - 32], return_inverse=True)[1].astype(np.int64)
    key = key * n
    key[open_] += more
    return key


class Dictionary:
    """Phrases held together: their bytes, places and the starts asked of each."""

    def __init__(self):
        self.parts, self.rows, self.size = [], [], 0

    def add(self, row: tuple, b: np.ndarray, starts: np.ndarray) -> None:
        """``row``: (trigger, parts or part, d, h, p)."""
        self.rows.append((*row, len(starts), self.size))
        self.parts.append((b, starts + self.size))
        self.size += len(b)

    def sifted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes; the starts there; the phrase of each; which of them repeat a string with an earlier place."""
        b, starts = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        info = np.array([r[2:] for r in self.rows], np.int64)
        phrase = np.repeat(np.arange(len(info)), info[:, 3])
        place = [info[phrase, 0], info[phrase, 1], info[phrase, 2] + starts - info[phrase, 4]]
        order, again = later([ranks(b, starts)], place)
        out = np.empty(len(order), bool)
        out[order] = again
        self.place = place
        return b, starts, phrase, out

    def gone(self, again: np.ndarray) -> pa.RecordBatch:
        return _gone(*(x[again] for x in self.place), np.ones(int(again.sum()), np.int64))


STRINGS = "trigger bigint, part int, d bigint, h bigint, p int, n int, bytes binary, starts binary"
STRING_NAMES = ["trigger", "part", "d", "h", "p", "n", "bytes", "starts"]


def _string_rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types], STRING_NAMES)


def _told(gone: pa.RecordBatch) -> pa.RecordBatch:
    """Rows that go, in the form of strings: without bytes, dealt out by document."""
    t, d, h, p, n = _numbers(gone, "trigger", "d", "h", "p", "n")
    none = pa.nulls(len(d), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(t), pa.array(np.full(len(d), -1, np.int32)), pa.array(d), pa.array(h), pa.array(p), pa.array(n), none, none], STRING_NAMES)


def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases asked for, with the starts that no earlier phrase of the chunk repeats; the others go."""

    def told(held: Dictionary) -> Iterator[pa.RecordBatch]:
        b, starts, phrase, again = held.sifted()
        yield _told(held.gone(again))
        left, rows = np.flatnonzero(~again), []
        part = None
        if any(r[1] > 1 for r in held.rows):
            parts = np.array([r[1] for r in held.rows], np.uint64)[phrase[left]]
            part = (stretch_hashes(b)(starts[left], starts[left] + LENGTH) % parts).astype(np.int64)
        at = np.searchsorted(phrase[left], np.arange(len(held.rows) + 1))
        for k, (t, parts, d, h, p, n, begin) in enumerate(held.rows):
            own = starts[left[at[k] : at[k + 1]]]
            mine = part[at[k] : at[k + 1]] if parts > 1 else np.zeros(len(own), np.int64)
            for q in np.unique(mine):
                s = own[mine == q]
                rows.append((t, int(q), d, h, p + int(s[0]) - begin, 0, b[s[0] : s[-1] + LENGTH].tobytes(), (s - s[0]).astype(np.int32).tobytes()))
        yield _string_rows(rows)

    for batch in batches:
        data, offsets = buffer_of(batch.column("text"))
        d, h = _numbers(batch, "d", "h")
        held = Dictionary()
        asked = batch.column("asked")
        for k in range(len(batch)):
            for a in asked[k].as_py():
                p, n = a["p"], a["n"]
                if offsets[k] + p + n + LENGTH - 1 > offsets[k + 1]:
                    continue
                held.add((a["trigger"], a["parts"], int(d[k]), int(h[k]), p), data[offsets[k] + p : offsets[k] + p + n + LENGTH - 1], np.arange(n))
                if held.size > CHUNK:
                    yield from told(held)
                    held = Dictionary()
        if held.rows:
            yield from told(held)


def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Complete groups (trigger, part) of a sorted partition, many at once: places of strings that repeat an earlier one."""
    held, key = Dictionary(), None

    def told() -> Iterator[pa.RecordBatch]:
        *_, again = held.sifted()
        yield held.gone(again).select(["d", "h", "p", "n"])

    for batch in batches:
        t, part, d, h, p, n = _numbers(batch, "trigger", "part", "d", "h", "p", "n")
        gone = part < 0
        if gone.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[gone]) for x in (d, h, p, n)], ["d", "h", "p", "n"])
        texts, starts = batch.column("bytes"), batch.column("starts")
        for k in np.flatnonzero(~gone).tolist():
            now = (t[k], part[k])
            if held.size > CHUNK and now != key:
                yield from told()
                held = Dictionary()
            key = now
            held.add((int(t[k]), int(part[k]), int(d[k]), int(h[k]), int(p[k])), np.frombuffer(texts[k].as_py(), np.uint8), np.frombuffer(starts[k].as_py(), np.int32).astype(np.int64))
    if held.rows:
        yield from told()


def spans_of(asked) -> list[tuple[int, int]]:
    """Maximal removed stretches from (p, n) pairs of string starts."""
    if asked is None or not len(asked):
        return []
    p = np.array([a["p"] for a in asked], np.int64)
    n = np.array([a["n"] for a in asked], np.int64)
    order = np.argsort(p, kind="stable")
    p, end = p[order], np.maximum.accumulate((p + n + LENGTH - 1)[order])
    new = np.ones(len(p), bool)
    new[1:] = p[1:] > end[:-1]
    starts = np.flatnonzero(new)
    return list(zip(p[starts].tolist(), end[np.append(starts[1:], len(p)) - 1].tolist(), strict=True))


def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffer_of(batch.column("text"))
        gone, rows = batch.column("gone"), []
        has = gone.is_valid().to_numpy(zero_copy_only=False)
        for k in range(len(batch)):
            text = data[offsets[k] : offsets[k + 1]]
            spans, at, digest = spans_of(gone[k].as_py() if has[k] else None), 0, hashlib.sha256()
            for a, b in spans:
                digest.update(text[at:a])
                at = b
            digest.update(text[at:])
            rows.append((len(text), sum(b - a for a, b in spans), len(spans), digest.hexdigest(), [list(s) for s in spans]))
        n, removed, count, digests, spans = zip(*rows, strict=True) if rows else ((),) * 5
        yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(digests, pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int64())))], ["d", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed byte spans (end exclusive)."""
    docs = keyed(docs)
    one_text = docs.groupBy("d").agg(F.min("h").alias("a"), F.max("h").alias("b")).filter("a != b").isEmpty()
    if one_text:  # the hash tells texts of one doc_id apart; where there is nothing to tell, it isn't carried
        docs = docs.withColumn("h", F.lit(0).cast("bigint"))
    row = "trigger bigint, content bigint, d bigint, h bigint, p int, n int, kind tinyint"
    found = docs.mapInArrow(parse, row)
    sifted = cut(found.repartitionByRange("trigger", "content").sortWithinPartitions("trigger", "content", "d", "h", "p").mapInArrow(sift, row), "phrases")
    # triggers that go on beyond a range: two rows for each range
    beyond = sifted.filter("kind = 4").groupBy("trigger").count().filter("count > 1").select("trigger")
    shared = sifted.filter("kind = 2").unionByName(sifted.filter("kind = 3").join(beyond, "trigger", "left_semi").select(*NAMES)).withColumn("_s", salt("d", "p"))
    sizes = shared.groupBy("trigger", "_s").agg(F.sum(F.col("n") + LENGTH - 1).alias("size"))
    hot = sizes.groupBy("trigger").agg(F.sum("size").alias("size"), salts_of()).filter(F.col("size") > PART)
    shared = shared.join(salted(hot), ["trigger", "_s"], "left").withColumn("parts", F.coalesce(F.ceil(F.col("size") / PART), F.lit(1)).cast("int"))
    asked = shared.groupBy("d", "h").agg(F.collect_list(F.struct("trigger", "parts", "p", "n")).alias("asked"))
    each = docs.join(asked, ["d", "h"]).mapInArrow(strings, STRINGS)
    more = each.repartition("trigger", "part").sortWithinPartitions("trigger", "part").mapInArrow(ordered, "d bigint, h bigint, p int, n int")
    gone = cut(sifted.filter("kind = 1").select("d", "h", "p", "n").unionByName(more), "gone")
    drop_cut(sifted)
    stretches = gone.groupBy("d", "h").agg(F.collect_list(F.struct("p", "n")).alias("gone"))
    out = docs.join(stretches, ["d", "h"], "left").select("d", "text", "gone").mapInArrow(kept, "d bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<array<bigint>>")
    return out.select(doc_id(), "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")


def op8_suffix_dedup(spark, sf_dir):
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("spans")
