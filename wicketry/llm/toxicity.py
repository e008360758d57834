"""Toxicity scores by a factorization machine over hashed terms.

A text's terms are its distinct words (letters only, lower case) and their beginnings, hashed to ``BUCKETS``. The
``FEATURES`` buckets that tell the labels apart best (G statistic over the sample's documents) enter the machine: a
weight each, and a vector of ``RANK`` factors whose inner products score every pair of terms present, so a pair such
as an insult with a mention of a group can count for more than its parts.

The model is fitted on a bounded sample of the labelled training rows (``SAMPLE`` expected, chosen by hash of the id), which
is written once and read from there; scoring reads every whole text and needs no shuffle. Rows whose
``crc32(doc_id as text) mod 5`` is 0 are held out: neither terms nor weights nor the settings below come from them. The
settings, the lengths of word beginnings among them, were chosen by ``cross_validated`` on folds of the training rows.

Defined results: null and empty texts have no terms and get the score of the bias; rows without a doc_id are scored too
(held_out null); repeated rows get equal scores; without labels of both kinds the score is the share of label 1 (0.0
without any); an empty table gives an empty result; further columns are ignored; a label is a doc_id's largest; a doc_id with several texts is
learned from by the first of them; texts of any length are read whole; scores tie only for equal sets of selected terms.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import cut, drop_cut, small_batches, table, text_or_empty

LETTERS = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6, 7, 8)
BUCKETS = 1 << 20
FEATURES = 1024
RANK = 8
EPOCHS, DECAY = 25, 4e-4
#: Steps of each part of the fit, at least.
STEPS = 200
#: Labelled rows that the model is fitted on, at most in expectation.
SAMPLE = 20_000
REMEMBERED = 100_000


def word_terms(word: str) -> list[int]:
    b = [zlib.crc32(word.encode())]
    b += [zlib.crc32(f"{word[:k]}*".encode()) for k in PREFIXES if len(word) > k]
    return [x & (BUCKETS - 1) for x in b]


def text_terms(text: str | None) -> set[int]:
    return {t for w in set(LETTERS.findall((text or "").lower())) for t in word_terms(w)}


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def training_sample(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """text and toxic of about ``sample`` training rows."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    share = min(1.0, sample / max(n, 1))
    some = known.filter(F.xxhash64("doc_id") <= int(share * (1 << 64)) - (1 << 63) - 1)
    # at most the sample's rows are broadcast; of a doc_id's texts the first counts, so ids bound the rows
    found = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(some), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def selected_terms(sample: DataFrame, features: int = FEATURES) -> np.ndarray:
    """The buckets with the largest G statistic between term and label."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen = np.zeros((2, BUCKETS), np.int32)
            for text, toxic in zip(pdf["text"], pdf["toxic"], strict=True):
                seen[int(toxic > 0), list(text_terms(text))] += 1
            term = np.flatnonzero(seen.any(0))
            yield pd.DataFrame({"term": term, "neg": seen[0, term], "pos": seen[1, term]})

    totals = sample.groupBy((F.col("toxic") > 0).alias("t")).count().collect()
    n = {bool(r["t"]): r["count"] for r in totals}
    pos, neg = float(n.get(True, 0)), float(n.get(False, 0))
    if not pos or not neg:
        return np.empty(0, np.int64)
    counts = sample.mapInPandas(count, "term bigint, neg bigint, pos bigint").groupBy("term").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    p, q = F.col("pos") + 0.0, F.col("neg") + 0.0
    share = (p + q) / (pos + neg)
    g = F.when(p > 0, p * F.log(p / (share * pos))).otherwise(0.0) + F.when(q > 0, q * F.log(q / (share * neg))).otherwise(0.0)
    g += F.when(p < pos, (pos - p) * F.log((pos - p) / ((1 - share) * pos))).otherwise(0.0) + F.when(q < neg, (neg - q) * F.log((neg - q) / ((1 - share) * neg))).otherwise(0.0)
    best = counts.filter(p + q >= 4).select("term", g.alias("g")).orderBy(F.desc("g"), "term").limit(features).collect()
    return np.array(sorted(r["term"] for r in best), np.int64)


class Model:
    """Bias, weights and factors of the selected terms."""

    def __init__(self, terms: np.ndarray, bias: float, rank: int = RANK):
        rng = np.random.RandomState(5)
        self.terms, self.bias = terms, bias
        self.w = np.zeros(len(terms))
        self.v = rng.normal(0, 0.02, (len(terms), rank))
        self.place = {int(t): i for i, t in enumerate(terms)}
        self._words: dict[str, tuple[int, ...]] = {}

    def __getstate__(self):
        return self.__dict__ | {"_words": {}}

    def features(self, text: str | None) -> np.ndarray:
        """Sorted places of the text's selected terms."""
        found, known, place = set(), self._words, self.place
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(LETTERS.findall((text or "").lower())):
            f = known.get(w)
            if f is None:
                f = tuple(place[t] for t in word_terms(w) if t in place)
                if len(w) <= 64:
                    known[w] = f
            if f:
                found.update(f)
        return np.array(sorted(found), np.int64)

    def raw(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of rows given by their features in a row, and each row's factor sum."""
        row = np.repeat(np.arange(len(sizes)), sizes)
        linear = np.bincount(row, self.w[flat], len(sizes))
        v = self.v[flat]
        total = np.zeros((len(sizes), v.shape[1]))
        for k in range(v.shape[1]):
            total[:, k] = np.bincount(row, v[:, k], len(sizes))
        square = np.bincount(row, (v * v).sum(1), len(sizes))
        return self.bias + linear + 0.5 * ((total * total).sum(1) - square), total

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([len(r) for r in rows], np.int64)
        flat = np.concatenate(rows) if len(rows) and sizes.sum() else np.empty(0, np.int64)
        return 1 / (1 + np.exp(-np.clip(self.raw(flat, sizes)[0], -30, 30)))

    def fit(self, rows: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, batch: int = 512, rate: float = 0.03, decay: float = DECAY) -> None:
        """Adam on the logistic loss with L2 decay: bias and weights first, then the factors on what these leave unexplained.

        So a term that tells by itself has a weight of its own, whatever it comes with. Each part takes ``epochs``
        passes, and at least ``STEPS`` steps, so that few rows are fitted as far as many.
        """
        rng = np.random.RandomState(11)
        epochs = max(epochs, -(-STEPS // max(1, -(-len(rows) // batch))))
        for pairs in (False, True)[: 1 + (self.v.shape[1] > 0)]:
            params = [self.v] if pairs else [self.w, np.array([self.bias])]
            state = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
            step = 0
            for _ in range(epochs):
                order = rng.permutation(len(rows))
                for at in range(0, len(rows), batch):
                    pick = order[at : at + batch]
                    some = [rows[i] for i in pick]
                    sizes = np.array([len(r) for r in some])
                    flat = np.concatenate(some) if sizes.sum() else np.empty(0, np.int64)
                    row = np.repeat(np.arange(len(sizes)), sizes)
                    if pairs:
                        raw, total = self.raw(flat, sizes)
                    else:
                        raw = self.bias + np.bincount(row, self.w[flat], len(sizes))
                    err = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[pick]) / len(pick)
                    if pairs:
                        each = err[row, None] * (total[row] - self.v[flat])
                        grads = [decay * self.v + np.column_stack([np.bincount(flat, each[:, k], len(self.w)) for k in range(self.v.shape[1])])]
                    else:
                        grads = [np.bincount(flat, err[row], len(self.w)) + decay * self.w, np.array([err.sum()])]
                    step += 1
                    for p, g, (m, s) in zip(params, grads, state, strict=True):
                        m += 0.1 * (g - m)
                        s += 0.001 * (g * g - s)
                        p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
                    if not pairs:
                        self.bias = float(params[1][0])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    rows = cut(training_sample(docs, labels, sample), "sample")
    try:
        terms = selected_terms(rows)
        if not len(terms):
            share = rows.agg(F.avg((F.col("toxic") > 0).cast("double"))).first()[0] or 0.0
            return Model(terms, float(np.log(max(share, 1e-12) / max(1 - share, 1e-12))))
        model = Model(terms, 0.0)

        def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pd.DataFrame({"f": [model.features(t) for t in pdf["text"]], "y": (pdf["toxic"] > 0).astype(int).values})

        got = rows.mapInPandas(find, "f array<bigint>, y int").toPandas()  # the bounded sample's selected terms
    finally:
        drop_cut(rows)
    got["k"] = [tuple(f) for f in got["f"]]
    got = got.sort_values(["y", "k"], ignore_index=True)  # the same model whatever order the rows come in
    y = got["y"].to_numpy(float)
    share = y.mean()
    model.bias = float(np.log(share / (1 - share)))
    model.fit([np.array(f, np.int64) for f in got["k"]], y)
    return model


def cross_validated(texts: list[str], y: np.ndarray, settings: list[dict], folds: int = 4) -> list[tuple[dict, float, float]]:
    """Of each setting (features, rank, decay): log loss and area under the curve on folds of the given training rows.

    Terms are selected and the model is fitted without the fold at hand; ``rank`` 0 is the linear model on the same terms.
    """
    y, found = np.asarray(y, float), [sorted(text_terms(t)) for t in texts]
    fold = np.array([zlib.crc32(t.encode()) % folds for t in texts])  # copies of a text stay together
    out = []
    for s in settings:
        scores = np.zeros(len(y))
        for k in range(folds):
            inside = fold != k
            seen = np.zeros((2, BUCKETS), np.int32)
            for f, label in zip((found[i] for i in np.flatnonzero(inside)), y[inside], strict=True):
                seen[int(label), f] += 1
            neg, pos = seen.astype(float)
            n1 = y[inside].sum()
            n0 = inside.sum() - n1
            share = (pos + neg) / (n0 + n1)
            with np.errstate(divide="ignore", invalid="ignore"):
                g = sum(np.nan_to_num(a * np.log(a / b), nan=0.0, neginf=0.0) for a, b in ((pos, share * n1), (neg, share * n0), (n1 - pos, (1 - share) * n1), (n0 - neg, (1 - share) * n0)))
            g[pos + neg < 4] = 0
            terms = np.sort(np.argsort(-g, kind="stable")[: s.get("features", FEATURES)])
            place = {int(t): i for i, t in enumerate(terms)}
            rows = [np.array([place[t] for t in f if t in place], np.int64) for f in found]
            model = Model(terms, float(np.log(n1 / n0)), s.get("rank", RANK))
            model.fit([rows[i] for i in np.flatnonzero(inside)], y[inside], decay=s.get("decay", DECAY))
            scores[~inside] = model.scores([rows[i] for i in np.flatnonzero(~inside)])
        p = np.clip(scores, 1e-9, 1 - 1e-9)
        order = scores.argsort(kind="stable").argsort(kind="stable") + 1
        area = (order[y > 0].sum() - (y > 0).sum() * ((y > 0).sum() + 1) / 2) / ((y > 0).sum() * (y == 0).sum())
        out.append((s, float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()), float(area)))
    return out


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``_row`` (all columns of a row), ``_score`` and ``_predicted`` (1 if the score is 0.5 or more); columns of any name pass as they are."""
    rows = docs.select(F.struct("*").alias("_row"), text_or_empty().alias("_text"))
    schema = StructType([rows.schema["_row"], StructField("_score", DoubleType()), StructField("_predicted", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            s = model.scores([model.features(t) for t in batch.column("_text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["_row", "_score", "_predicted"])

    return rows.mapInArrow(run, schema)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` and ``score``, ``predicted``, which replace columns of these names."""
    return scored(docs.drop("score", "predicted"), model).select("_row.*", F.col("_score").alias("score"), F.col("_predicted").alias("predicted"))


def op9_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
