"""Hard-negative mining with a multiway hyperplane tree whose split points know the distance ranges of their siblings.

Vectors become integers, floor(256 x), so inner products are exact. One more coordinate makes all of them equally long, so
that a larger inner product is a smaller distance, and a window of scores is an annulus of distances around the anchor.

The tree: a node has at most ``WAYS`` split points; a vector belongs to the nearest (the regions between hyperplanes). For each
split point the node keeps the least and largest distance to the vectors of every sibling's subtree. A search of an
annulus measures the distance to a split point and drops each sibling whose range doesn't meet the annulus widened by that
distance, on both sides. Leaves hold all their vectors and are searched exactly.

Split points come from a sample of at most ``SAMPLE`` vectors, chosen by hash; every vector is routed through the tree, and
the ranges are taken over all of them, so results are exact whatever the sample is. Leaves are packed in blocks of at most
about ``BLOCK`` vectors; a leaf that holds any share of all vectors (copies of one) has as many blocks as it needs. Anchors
are packed in blocks too, by leaf, and a block of anchors meets a block of vectors only where one of its annuli reaches it, as
one row; what a task finds is merged, so that an anchor leaves at most its best few rows in a task, and then over tasks.

Positives are found first: the anchor's own leaf bounds the distance of its ``positives`` best, which the others must beat.
Then each (anchor, positive) searches the annulus of its window in the same two steps.

Defined results: rows without a vec_id, label or vector, or with a null or non-finite component take no part, nor do empty
vectors; vectors of another dimension than the anchor's aren't its candidates; of rows that repeat a vec_id the first
(by label, then vector) takes part; ties go to the smaller vec_id; no window is open below a score of 0; anchors without
positives, and positives without negatives, have no rows; components beyond 2**20 are compared by exact integers of any
size and their scores are held within 64 bits in the output; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Split points of a node, vectors of the sample, and vectors a leaf should hold.
WAYS, SAMPLE, LEAF = 8, 16384, 2048
#: Vectors and anchors in a packed block, about.
BLOCK, ANCHORS = 4096, 2048
#: Tasks of a search, at most.
TASKS = 4096
#: Anchors compared at once in a task.
AT_ONCE = 256
#: Components up to this are multiplied as doubles without rounding (64 products of 2**40 stay below 2**53 for up to 8192 dimensions).
EXACT = 1 << 20
LIMIT = (1 << 63) - 1


class Tree:
    """Split points and ranges. Nodes are numbered; ``child[node]`` holds child nodes, or is None at a leaf."""

    def __init__(self, sample: np.ndarray, top: float, leaves: int):
        self.top, self.points, self.child = top, [], []
        rng = np.random.RandomState(7)
        open_, made = [(self.node(), self.lifted(sample))], 1
        while open_ and made < leaves:  # the fullest node is split next
            open_.sort(key=lambda x: len(x[1]))
            node, own = open_.pop()
            some = np.unique(own, axis=0)
            if len(some) < 2 * WAYS:
                break
            points = spread(some, WAYS, rng)
            self.points[node] = points
            self.child[node] = [self.node() for _ in points]
            near = distances(own, points).argmin(1)
            open_ += [(c, own[near == k]) for k, c in enumerate(self.child[node])]
            made += WAYS - 1
        self.leaves = [n for n, c in enumerate(self.child) if c is None]
        self.low = [None if c is None else np.full((len(c), len(c)), np.inf) for c in self.child]
        self.high = [None if c is None else np.full((len(c), len(c)), -np.inf) for c in self.child]

    def node(self) -> int:
        self.points.append(None)
        self.child.append(None)
        return len(self.child) - 1

    def lifted(self, v: np.ndarray) -> np.ndarray:
        """One more coordinate, so that all have the length of the longest."""
        return np.column_stack([v, np.sqrt(np.maximum(self.top - (v * v).sum(1), 0))])

    def route(self, v: np.ndarray) -> tuple[np.ndarray, dict]:
        """Leaf of each vector, and the ranges they give: (node, sibling) to least and largest distance to each split point."""
        leaf, ranges, open_ = np.zeros(len(v), np.int64), {}, [(0, np.arange(len(v)), self.lifted(v))]
        while open_:
            node, rows, own = open_.pop()
            if self.child[node] is None:
                leaf[rows] = node
                continue
            d = distances(own, self.points[node])
            near = d.argmin(1)
            for k, c in enumerate(self.child[node]):
                mine = near == k
                if mine.any():
                    ranges[node, k] = (d[mine].min(0), d[mine].max(0))
                    open_.append((c, rows[mine], own[mine]))
        return leaf, ranges

    def widen(self, node: int, k: int, low: list[float], high: list[float]) -> None:
        self.low[node][:, k] = np.minimum(self.low[node][:, k], low)
        self.high[node][:, k] = np.maximum(self.high[node][:, k], high)

    def reached(self, anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> dict[int, np.ndarray]:
        """Of each leaf, which anchors may find a vector between their distances ``low`` and ``high`` in it."""
        q = np.column_stack([anchors, np.zeros(len(anchors))])
        slack = 1e-9 * (1 + np.sqrt(self.top) + np.sqrt((q * q).sum(1)))
        out, open_ = {}, [(0, np.arange(len(q)))]
        while open_:
            node, rows = open_.pop()
            if not len(rows):
                continue
            if self.child[node] is None:
                out[node] = rows
                continue
            d = distances(q[rows], self.points[node])[:, :, None]
            lo, hi, s = low[rows, None, None], high[rows, None, None], slack[rows, None, None]
            nearest = np.maximum(np.maximum(lo - d, d - hi), 0) - s  # of a split point to the annulus
            meets = ((self.low[node][None] <= hi + d + s) & (self.high[node][None] >= nearest)).all(1)
            for k, c in enumerate(self.child[node]):
                open_.append((c, rows[meets[:, k]]))
        return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T), 0))


def spread(v: np.ndarray, k: int, rng: np.random.RandomState) -> np.ndarray:
    """``k`` vectors far from each other, out of at most 64 k."""
    v = v[rng.choice(len(v), min(len(v), 64 * k), replace=False)]
    chosen = [0]
    far = distances(v, v[:1])[:, 0]
    while len(chosen) < k:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, distances(v, v[chosen[-1:]])[:, 0])
    return v[chosen]


def integers(vec) -> np.ndarray:
    """floor(256 x), as doubles: exact, since a product with 256 only moves the exponent."""
    return np.floor(256.0 * np.stack([np.asarray(v, float) for v in vec]))


def products(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products, anchors by vectors; beyond EXACT as Python's integers."""
    if max(np.abs(v).max(initial=0), np.abs(q).max(initial=0)) <= EXACT:
        return (q @ v.T).astype(np.int64)
    whole = [np.array([[int(x) for x in row] for row in a.tolist()], object).reshape(a.shape) for a in (q, v)]
    return whole[0] @ whole[1].T


def held(x) -> int:
    return max(-LIMIT, min(LIMIT, int(x)))


def packed(x: np.ndarray) -> bytes:
    """Integers as two bytes where they fit, else as doubles."""
    small = x.size == 0 or np.abs(x).max() < 1 << 15
    return (b"s" if small else b"d") + x.astype(np.int16 if small else float).tobytes()


def unpacked(b: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(b, np.int16 if b[:1] == b"s" else float, offset=1).reshape(rows, -1).astype(float)


def usable(df: DataFrame) -> DataFrame:
    v = F.col("vec")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fine = df.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite)
    return fine.groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("x")).select("vec_id", "x.label", "x.vec", F.size("x.vec").alias("dim"))


class Index:
    """The tree over all vectors of one dimension, and the packed blocks of its leaves."""

    def __init__(self, rows: DataFrame):
        """``rows``: vec_id, label, vec, of one dimension, at least one."""
        spark = rows.sparkSession
        square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + F.pow(F.abs(x) * 256.0 + 1.0, F.lit(2.0)))  # no shorter than the longest
        stats = rows.agg(F.count("*").alias("n"), F.max(square).alias("top")).first()
        share = min(1.0, min(SAMPLE, max(256, stats.n // 4)) / stats.n)
        some = rows.filter(F.xxhash64("vec_id") <= int(share * (1 << 64)) - (1 << 63) - 1).select("vec").toPandas()  # SAMPLE rows in expectation, as ids are unique
        self.tree = tree = Tree(integers(some["vec"]) if len(some) else np.empty((0, 0)), stats.top, max(1, stats.n // LEAF))
        shared = spark.sparkContext.broadcast(tree)  # at most as many split points as the sample has vectors

        def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                leaf, _ = shared.value.route(integers(b["vec"]))
                yield pd.DataFrame({"vec_id": b["vec_id"], "label": b["label"], "vec": b["vec"], "leaf": leaf})

        def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                _, found = shared.value.route(integers(b["vec"]))
                yield pd.DataFrame([(n, k, i, a, z) for (n, k), (lo, hi) in found.items() for i, (a, z) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True))], columns=["node", "k", "i", "low", "high"])

        wide = rows.mapInPandas(ranges, "node bigint, k int, i int, low double, high double").groupBy("node", "k", "i").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        for r in wide.groupBy("node", "k").agg(F.array_sort(F.collect_list(F.struct("i", "low", "high"))).alias("x")).collect():  # WAYS**2 numbers a node
            tree.widen(r.node, r.k, [x.low for x in r.x], [x.high for x in r.x])
        self.shared = spark.sparkContext.broadcast(tree)
        routed = rows.mapInPandas(route, "vec_id bigint, label bigint, vec array<double>, leaf bigint")
        self.routed = cut(routed, "routed")
        counts = self.routed.groupBy("leaf").count().collect()  # one row a leaf
        self.blocks = {r.leaf: -(-r["count"] // BLOCK) for r in counts}
        sizes = F.create_map(*(F.lit(x) for kv in self.blocks.items() for x in kv))
        dealt = self.routed.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.try_element_at(sizes, F.col("leaf"))).cast("int"))
        self.packed = cut(dealt.groupBy("leaf", "part").applyInPandas(pack, "leaf bigint, part int, n int, ids binary, labels binary, data binary"), "leaves")

def pack(b: pd.DataFrame) -> pd.DataFrame:
    b = b.sort_values("vec_id")
    return pd.DataFrame([(b["leaf"].iloc[0], b["part"].iloc[0], len(b), b["vec_id"].to_numpy(np.int64).tobytes(), b["label"].to_numpy(np.int64).tobytes(), packed(integers(b["vec"])))], columns=["leaf", "part", "n", "ids", "labels", "data"])


ASKED = ["vec_id", "label", "leaf", "slot", "low", "high"]
FOUND = "anchor_id bigint, slot bigint, label bigint, vec_id bigint, score bigint"


def asked(b: pd.DataFrame) -> pd.DataFrame:
    """Anchors of one block as one row."""
    return pd.DataFrame([(len(b), packed(integers(b["vec"])), *(b[c].to_numpy(np.int64).tobytes() for c in ASKED))], columns=["n", "data", *ASKED])


def search(index: Index, anchors: DataFrame, k: int, same: bool) -> DataFrame:
    """The first ``k`` vectors in each anchor's window (rows of vec_id, label, vec, leaf, slot, low, high), of its own label or of others.

    ``slot`` tells an anchor's windows apart; scores lie in [low, high].
    """
    first = cut(found(index, anchors, k, same, own=True), "first")
    worst = first.groupBy("anchor_id", "slot").agg(F.count("*").alias("n"), F.min("score").alias("worst")).filter(F.col("n") >= k)
    worst = worst.select(F.col("anchor_id").alias("vec_id"), "slot", "worst")
    rest = anchors.join(worst, ["vec_id", "slot"], "left").withColumn("low", F.greatest("low", "worst")).drop("worst")
    more = found(index, rest, k, same, own=False)
    best = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    return first.unionByName(more).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def block_of(index: Index, anchors: DataFrame) -> DataFrame:
    """Anchors with their block: neighbouring leaves together, as far as ANCHORS allows; a leaf with more has several."""
    at, room, first = 0, ANCHORS, []
    counts = {r.leaf: r["count"] for r in anchors.groupBy("leaf").count().collect()}  # one row a leaf
    for leaf in (x for x in index.tree.leaves if x in counts):
        n = counts[leaf]
        if n > room:
            at, room = at + 1, ANCHORS
        parts = -(-n // ANCHORS)
        first += [(leaf, (at, parts))]
        at, room = at + parts - 1, room - n if parts == 1 else 0
    begin, parts = (F.create_map(*(F.lit(x) for leaf, v in first for x in (leaf, v[i]))) if first else F.create_map().cast("map<bigint,int>") for i in (0, 1))
    leaf = F.col("leaf")
    return anchors.withColumn("block", F.try_element_at(begin, leaf) + F.pmod(F.xxhash64("vec_id", "slot"), F.try_element_at(parts, leaf)))


SENT = "leaf bigint, part int, q_n int, q_data binary, " + ", ".join(f"q_{c} binary" for c in ASKED)


def found(index: Index, anchors: DataFrame, k: int, same: bool, own: bool) -> DataFrame:
    """One step of a search: the anchors' own leaves, or all others that their annuli reach."""
    shared, blocks = index.shared, index.blocks
    made = block_of(index, anchors).groupBy("block").applyInPandas(asked, "n int, data binary, " + ", ".join(f"{c} binary" for c in ASKED))

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                home = whole(r.leaf)
                reach = {int(x): np.flatnonzero(home == x) for x in np.unique(home)} if own else {x: rows[home[rows] != x] for x, rows in annuli(shared.value, r).items()}
                out = [(leaf, part, *some) for leaf, rows in reach.items() if len(rows) for some in [subset(r, rows)] for part in range(blocks.get(leaf, 0))]
                yield pd.DataFrame(out, columns=[x.split()[0] for x in SENT.split(", ")])

    tasks = min(sum(blocks.values()), TASKS)
    sent = made.mapInPandas(visits, SENT).repartition(tasks, "leaf", "part")
    met = index.packed.repartition(tasks, "leaf", "part").join(sent, ["leaf", "part"])

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[tuple[int, int], list] = {}
        for b in batches:
            for r in b.itertuples():
                inside(r, k, same, best)
                if len(best) > 4 * ANCHORS:
                    yield rows_of(best)
                    best = {}
        yield rows_of(best)

    return met.mapInPandas(answer, FOUND)


def whole(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.int64)


def annuli(tree: Tree, r) -> dict[int, np.ndarray]:
    """Leaves that the annuli of a block's anchors reach; a score s is a distance of sqrt(|q|^2 + top - 2 s)."""
    q = unpacked(r.data, r.n)
    square = (q * q).sum(1) + tree.top
    return tree.reached(q, *(np.sqrt(np.maximum(square - 2 * whole(s).astype(float), 0)) for s in (r.high, r.low)))


def subset(r, rows: np.ndarray) -> tuple:
    return len(rows), packed(unpacked(r.data, r.n)[rows]), *(whole(getattr(r, c))[rows].tobytes() for c in ASKED)


def inside(r, k: int, same: bool, best: dict) -> None:
    """Add to ``best`` what a block of vectors holds for some anchors; each keeps its first ``k``."""
    v, ids, labels = unpacked(r.data, r.n), whole(r.ids), whole(r.labels)
    q, (q_ids, q_labels, _, slots, lows, highs) = unpacked(r.q_data, r.q_n), (whole(getattr(r, f"q_{c}")) for c in ASKED)
    for at in range(0, r.q_n, AT_ONCE):
        s = slice(at, at + AT_ONCE)
        score = products(v, q[s])
        fits = (score >= lows[s, None]) & (score <= highs[s, None]) & (ids[None] != q_ids[s, None]) & ((labels[None] == q_labels[s, None]) == same)
        fits = fits.astype(bool)
        for i in np.flatnonzero(fits.any(1)):
            c = np.flatnonzero(fits[i])
            own = score[i, c]
            if len(c) > k:
                edge = np.partition(own, len(own) - k)[len(own) - k] if own.dtype != object else sorted(own)[-k]
                c = c[own >= edge]
                own = score[i, c]
            key = (int(q_ids[at + i]), int(slots[at + i]))
            have = best.setdefault(key, [])
            have += [(-int(x), int(y), int(z)) for x, y, z in zip(own, ids[c], labels[c], strict=True)]
            have.sort()
            del have[k:]


def rows_of(best: dict) -> pd.DataFrame:
    return pd.DataFrame([(a, slot, label, i, held(-x)) for (a, slot), have in best.items() for x, i, label in have], columns=["anchor_id", "slot", "label", "vec_id", "score"])


def mine(vectors: DataFrame, anchors, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, for the rows that ``anchors`` (a condition) selects.

    ``vectors``: vec_id, label, vec. A negative's score lies between ``least`` and ``most`` per cent of the positive's.
    """
    rows = cut(usable(vectors.select("vec_id", F.col("label").cast("bigint").alias("label"), F.col("vec").cast("array<double>").alias("vec"))), "vectors")
    spark, parts = vectors.sparkSession, []
    for dim in sorted(r.dim for r in rows.select("dim").distinct().collect()):
        index = Index(rows.filter(F.col("dim") == dim).select("vec_id", "label", "vec"))
        asking = index.routed.filter(anchors).withColumns({"slot": F.lit(0).cast("bigint"), "low": F.lit(-LIMIT).cast("bigint"), "high": F.lit(LIMIT).cast("bigint")})
        best = cut(search(index, asking, positives, same=True).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
        # 100 n >= least p and 100 n <= most p, for integers n
        low, high = F.expr(f"(positive_score div 100) * {least} + ceil((positive_score % 100) * {least} / 100)"), F.expr(f"(positive_score div 100) * {most} + floor((positive_score % 100) * {most} / 100)")
        windows = index.routed.join(best, F.col("vec_id") == F.col("anchor_id")).select("vec_id", "label", "vec", "leaf", F.col("positive_id").alias("slot"), low.cast("bigint").alias("low"), high.cast("bigint").alias("high")).filter("low <= high")
        bad = search(index, windows, negatives, same=False)
        parts.append(bad.withColumnRenamed("slot", "positive_id").join(best, ["anchor_id", "positive_id"]).select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    if not parts:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def op11_hard_negatives(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(v.select("vec_id", label.alias("label"), F.col("embedding").alias("vec")), F.col("vec_id") % 50 == 0)


OP11_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_sum([x[1] * x[2] FOR x IN list_zip(a.q, c.q)]) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id <> c.vec_id AND a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON p.anchor_id = n.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) <= 3
"""
