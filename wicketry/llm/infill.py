"""Fill-in-the-middle examples, cut at line ends through a piecewise-linear learned rank index.

A text is a sequence of lines; its boundary offsets (in code points) grow nearly linearly with their rank. An index fits
segments to all of them, each within ``ERROR`` of every boundary it covers, and stores the residuals in a byte each. A cut
at rank r is predicted by r's segment and corrected exactly by r's residual. Two ranks drawn by hash of the doc_id cut a text
into prefix, middle and suffix, which are put together in one of two orders.

Defined results: a null text counts as empty; the empty text, and a text that holds a mark itself, stays plain, so that
``restored`` always gives the text back; a row without a doc_id draws as if its id were the empty text; rows of one doc_id
draw alike, each for its own text; texts of any length are cut whole, one text at a time in memory; equal draws give an
empty middle; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table
from .words import buffer_of, groups

#: Prefix, suffix and middle begin with these.
MARKS = ("<P>", "<S>", "<M>")
#: A segment's prediction is at most this many code points (and rounding) away; residuals fit a byte.
ERROR = 120
#: Boundaries that a segment tries to cover first; it tries twice as many as long as it covers all.
STEP = 128


class RankIndex:
    """Rank to offset, by segments (first rank, offset there, slope) and one residual for each rank."""

    def __init__(self, offsets: np.ndarray):
        self.first, self.base, self.slope = [], [], []
        self.residual = np.zeros(len(offsets), np.int8)
        at = 0
        while at < len(offsets):
            to, slope = self.covered(offsets, at)
            self.first.append(at)
            self.base.append(int(offsets[at]))
            self.slope.append(slope)
            self.residual[at:to] = offsets[at:to] - self.on_line(len(self.first) - 1, np.arange(at, to))
            at = to

    @staticmethod
    def covered(offsets: np.ndarray, at: int) -> tuple[int, float]:
        """The longest segment from ``at``: its end, and a slope that keeps all its boundaries within ERROR (a cone that narrows)."""
        low, high, to, step = -np.inf, np.inf, at + 1, STEP
        while to < len(offsets):
            y = offsets[to : to + step] - offsets[at]
            x = np.arange(to - at, to - at + len(y))
            lows = np.maximum(np.maximum.accumulate((y - ERROR) / x), low)
            highs = np.minimum(np.minimum.accumulate((y + ERROR) / x), high)
            bad = np.flatnonzero(lows > highs)
            fit = int(bad[0]) if len(bad) else len(y)
            if fit:
                low, high = lows[fit - 1], highs[fit - 1]
            to += fit
            if len(bad):
                break
            step *= 2
        return to, float((low + high) / 2) if to > at + 1 else 0.0

    def on_line(self, segment: int, rank):
        return self.base[segment] + np.floor(self.slope[segment] * (rank - self.first[segment]) + 0.5).astype(np.int64)

    def offset(self, rank: int) -> int:
        segment = int(np.searchsorted(self.first, rank, "right")) - 1
        return int(self.on_line(segment, rank)) + int(self.residual[rank])


def boundaries(column: pa.Array) -> Iterator[np.ndarray]:
    """Of each text, where its lines begin and the last ends, in code points."""
    data, offsets = buffer_of(column)
    for i, j in groups(offsets):
        b = data[offsets[i] : offsets[j]]
        points = np.concatenate([np.zeros(1, np.int64), np.cumsum((b & 0xC0) != 0x80)])
        ends = np.flatnonzero(b == 10) + 1
        edges = offsets[i : j + 1] - offsets[i]
        which = np.searchsorted(ends, edges, "right")
        for k in range(j - i):
            inner = ends[which[k] : which[k + 1]]
            last = edges[k + 1 : k + 2] if edges[k + 1] > max(edges[k], inner[-1] if len(inner) else 0) else edges[:0]
            yield points[np.concatenate([edges[k : k + 1], inner, last])] - points[edges[k]]


def draws(seed: int, n: int = 4) -> list[Column]:
    """The first 8-digit groups of the digest of seed and doc_id, as integers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint").alias(f"h{k + 1}") for k in range(n)]


SCHEMA = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """doc_id, n (lines), form (plain, psm or spm), prefix_chars, middle_chars and the whole ``output``.

    ``rate`` per cent of the documents are cut, ``spm_rate`` per cent of these with the suffix first.
    """
    p, s, m = marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            h = [batch.column(f"h{k}").to_pylist() for k in range(1, 5)]
            rows = []
            for k, at in enumerate(boundaries(texts)):
                text, n = texts[k].as_py(), len(at) - 1
                if not n or any(x in text for x in marks) or h[2][k] % 100 >= rate:
                    rows.append((n, "plain", None, None, text))
                    continue
                index = RankIndex(at)
                a, b = sorted((index.offset(h[0][k] % (n + 1)), index.offset(h[1][k] % (n + 1))))
                prefix, middle, suffix = text[:a], text[a:b], text[b:]
                if h[3][k] % 100 < spm_rate:
                    rows.append((n, "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"))
                else:
                    rows.append((n, "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"))
            n, form, a, b, out = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(out, pa.string())],
                                             ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *draws(seed))
    return given.mapInArrow(run, SCHEMA)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text again, from an output and its form: the marks stand in no text that was cut, so each is found once."""
    parts = F.split(output, "|".join(rf"\Q{x}\E" for x in marks))
    psm, spm = (F.concat(*(F.try_element_at(parts, F.lit(k)) for k in order)) for order in ((2, 4, 3), (3, 4, 2)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_infill(spark, sf_dir):
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS lines, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2,
             CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, CAST(len(lines) AS BIGINT) AS n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS a, greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, coalesce(array_to_string(lines[1:a], ''), '') AS prefix, coalesce(array_to_string(lines[a + 1:b], ''), '') AS middle, coalesce(array_to_string(lines[b + 1:n], ''), '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
