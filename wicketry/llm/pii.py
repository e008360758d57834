"""Personal data: fixed patterns as seeds, and contextual patterns bootstrapped from them.

Seeds are emails, IP addresses, payment cards and phone numbers found by fixed patterns. Every identifier-like stretch of
a text, seed or not, is an instance: a run between white space with a digit or an @, or a group of neighbouring runs of digits
and their punctuation (7 to 19 digits together). The words around it (two before; one before and one after) are its lexical
patterns; a word is what stands between white space, and what is glued to the instance's left up to a digit or an @. Spark scores the graph of patterns and instances round by round: a pattern's confidence for
a kind is the summed score of its instances over their number, an instance's score is the noisy-or of its accepted
patterns; patterns with enough support and confidence are accepted, and what they find supports others in the next
round. Instances of accepted patterns that no seed covers are the spans that the method adds.

Texts are read once, by a small per-text helper; only occurrences (not texts) are joined and shuffled.

Defined results: a null text counts as empty; repeated rows get equal results; rows without a doc_id are searched too; a
found stretch that overlaps a seed is left out; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import cut, drop_cut, table, text_or_empty

KINDS = ("email", "ip", "card", "phone")
MIN_SUPPORT, MIN_CONFIDENCE, ROUNDS = 3.0, 0.6, 3
_LOCAL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
EMAIL_HERE = re.compile(_LOCAL)
EMAIL_NEXT = re.compile(r"(?<![A-Za-z0-9._%+-])" + _LOCAL)
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
MARK = re.compile(r"[0-9@]")
CHUNK = re.compile(r"\S+")
DIGITS = re.compile(r"[+(]*[0-9][0-9().,-]*")
EDGES = "\"'.,;:!?()[]{}<>#$%&*"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches that don't overlap, each run of address characters tried once."""
    at = 0
    while m := EMAIL_HERE.match(text, at) or EMAIL_NEXT.search(text, at):
        yield m.span()
        at = m.end()


def seeds(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end) of the fixed patterns, sorted."""
    found = []
    if "@" in text:
        found += [(a, 0, b) for a, b in emails(text)]
    if DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split(".")))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found)


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def stretches(text: str, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Identifier-like stretches without the seeds: chunks between white space, or groups of digit chunks, without outer punctuation."""
    out, chunks = [], []
    for m in CHUNK.finditer(text):
        if MARK.search(m[0]):
            chunks.append(m.span())
    groups, k = [], 0
    while k < len(chunks):
        last = k
        if DIGITS.fullmatch(text, *chunks[k]):
            while last + 1 < len(chunks) and chunks[last + 1][0] == chunks[last][1] + 1 and DIGITS.fullmatch(text, *chunks[last + 1]):
                last += 1
            n = sum(c.isdigit() for a, b in chunks[k : last + 1] for c in text[a:b])
            if last > k and 7 <= n <= 19:
                groups.append((chunks[k][0], chunks[last][1]))
            else:
                groups += chunks[k : last + 1]
        else:
            groups.append(chunks[k])
        k = last + 1
    starts, ends = [a for a, _, _ in found], list(accumulate((b for _, _, b in found), max))
    for start, end in groups:
        while start < end and text[start] in EDGES:
            start += 1
        while end > start and text[end - 1] in EDGES:
            end -= 1
        below = bisect_left(starts, end)  # seeds that start before the stretch ends
        if end - start >= 5 and not (below and ends[below - 1] > start):
            out.append((start, -1, end))
    return out


def token(word: str) -> str:
    """A context word; long ones by their hash."""
    word = word.lower()
    return word if len(word) <= 64 else f"#{number(word):x}"


def number(text: str) -> int:
    """A signed 64-bit hash."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


class Contexts:
    """Context words of stretches of one text."""

    def __init__(self, text: str):
        self.text = text
        self.spans = [m.span() for m in CHUNK.finditer(text)]
        self.starts = [a for a, _ in self.spans]

    def of(self, start: int, end: int) -> list[str]:
        text, k = self.text, bisect_left(self.starts, start + 1) - 1  # the chunk that holds the start
        at = start
        while at > self.starts[k] and text[at - 1] not in "0123456789@":
            at -= 1
        before = [token(text[at:start])] if at < start else []
        for a, b in reversed(self.spans[max(0, k - 2) : k]):
            before.append(token(text[a:b]))
        last = bisect_left(self.starts, end) - 1  # the chunk that holds the end
        after = [token(text[a:b]) for a, b in self.spans[last + 1 : last + 2]]
        left, right = before[0] if before else "^", after[0] if after else "$"
        return [f"2 {before[1] if len(before) > 1 else '^'} {left}", f"1 {left} | {right}"]


def occurrences(docs: DataFrame) -> DataFrame:
    """Of each row: doc_id, a hash of the text, the seeds as text, counts, and all instances with their patterns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                found = seeds(text)
                all_ = sorted(found + stretches(text, found)) if MARK.search(text) else []
                around = Contexts(text) if all_ else None
                near = [{"start": a, "end": b, "kind": k, "instance": number(text[a:b].lower()), "patterns": around.of(a, b)} for a, k, b in all_]
                kinds = [k for _, k, _ in found]
                rows.append((shown(found), *map(kinds.count, range(4)), near))
            out = pd.DataFrame(rows, columns=["base", *(f"n_{k}" for k in KINDS), "near"])
            out.insert(0, "hash", pdf["hash"].values)
            out.insert(0, "doc_id", pdf["doc_id"].values)
            yield out

    rows = docs.select("doc_id", text_or_empty().alias("text")).withColumn("hash", F.xxhash64("text"))
    near = "array<struct<start:int,end:int,kind:int,instance:bigint,patterns:array<string>>>"
    return rows.mapInPandas(run, f"doc_id bigint, hash bigint, base string, {', '.join(f'n_{k} bigint' for k in KINDS)}, near {near}")


def accepted_patterns(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """pattern, kind, confidence, from edges (pattern, instance, kind; kind -1: not a seed).

    Every round is an aggregation and a join on patterns or instances; hot patterns are pre-aggregated.
    """
    edges = cut(edges.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")), "edges")
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("size"))
    seeded = edges.filter("kind >= 0").select("instance", "kind", F.lit(1.0).alias("score")).distinct()
    # only patterns that could reach the support at all
    known, found, scratch = seeded, None, [edges]
    links = edges.select("pattern", "instance")
    for _ in range(rounds):
        votes = links.join(known, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("support")).filter(F.col("support") >= MIN_SUPPORT)
        conf = F.col("support") / (F.col("size") + 1)
        found = cut(votes.join(sizes, "pattern").select("pattern", "kind", conf.alias("confidence")).filter(conf >= MIN_CONFIDENCE), "patterns")
        new = links.join(found, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("score"))
        known = cut(seeded.unionByName(new).groupBy("instance", "kind").agg(F.max("score").alias("score")), "instances")
        scratch += [found, known]
    drop_cut(*(x for x in scratch if x is not found))
    return found


def find(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Occurrences by row, and the added spans (doc_id, hash, start, end, kind)."""
    rows = cut(occurrences(docs), "occurrences")
    flat = rows.select("doc_id", "hash", F.explode("near").alias("o")).select("doc_id", "hash", "o.start", "o.end", "o.kind", "o.instance", F.explode("o.patterns").alias("pattern"))
    found = accepted_patterns(flat.select("pattern", "instance", "kind"))
    new = flat.filter("kind < 0").drop("kind").join(found, "pattern")
    best = new.groupBy("doc_id", "hash", "start", "end").agg(F.max(F.struct("confidence", (-F.col("kind")).alias("k"))).alias("b"))
    return rows, best.select("doc_id", "hash", "start", "end", (-F.col("b.k")).alias("kind"))


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        spans = []
        for base, added in zip(pdf["base"], pdf["added"], strict=True):
            more = [(int(x["start"]), int(x["kind"]), int(x["end"])) for x in added] if added is not None else []
            spans.append(shown(sorted(parsed(base) + more)))
        pdf["base_sha256"] = [hashlib.sha256(b.encode()).hexdigest() for b in pdf["base"]]
        yield pdf.assign(spans=spans)[["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]]


def parsed(spans: str) -> list[tuple[int, int, int]]:
    out = []
    for s in spans.split(",") if spans else ():
        kind, a, b = s.split(":")
        out.append((int(a), KINDS.index(kind), int(b)))
    return out


def joined(rows: DataFrame, added: DataFrame) -> DataFrame:
    each = added.groupBy(F.col("doc_id").alias("_doc"), F.col("hash").alias("_hash")).agg(F.collect_list(F.struct("start", "end", "kind")).alias("added"))
    return rows.join(each, rows.doc_id.eqNullSafe(each._doc) & (rows.hash == each._hash), "left").drop("_doc", "_hash")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the seeds by kind, their digest, and all spans."""
    rows, added = find(docs)
    wide = joined(rows.drop("near"), added)
    return wide.mapInPandas(_digests, f"doc_id bigint, {', '.join(f'n_{k} bigint' for k in KINDS)}, base_sha256 string, spans string")


def masked(text: str | None, added) -> str | None:
    if not text:
        return text
    spans = seeds(text) + [(int(x["start"]), int(x["kind"]), int(x["end"])) for x in added or ()]
    parts, at = [], 0
    for a, k, b in sorted(spans):
        if b > at:
            parts += [text[at : max(a, at)], f"[{KINDS[k].upper()}]"]
            at = b
    return "".join(parts) + text[at:] if spans else text


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of a text replaced by its kind in brackets; texts without spans stay as they are.

    Further columns pass as they are, whatever their names.
    """
    _, added = find(docs.select("doc_id", "text"))
    each = added.groupBy(F.col("doc_id").alias("_doc"), F.col("hash").alias("_hash")).agg(F.collect_list(F.struct("start", "end", "kind")).alias("_added"))
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), F.col("text").alias("_text"), F.xxhash64(text_or_empty()).alias("_h"))
    wide = rows.join(each, rows._id.eqNullSafe(each._doc) & (rows._h == each._hash), "left").select("_row", "_text", "_added")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [masked(t, x) for t, x in zip(batch.column("_text").to_pylist(), batch.column("_added").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(text, pa.string())], ["_row", "_text"])

    new = wide.mapInArrow(run, StructType([rows.schema["_row"], rows.schema["_text"]]))
    return new.select(*(F.col("_text").alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns))


def op3_pii(spark, sf_dir):
    return personal_data(table(spark, sf_dir, "documents"))
