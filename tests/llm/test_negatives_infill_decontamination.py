"""Hard negatives, fill-in-the-middle and decontamination against brute force, with odd rows among them."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from wicketry.llm import common, decontaminate, infill, negatives

WORDS = "alpha bravo carol delta echo fox golf hotel india julia kilo lima mike nora oscar papa queen romeo sierra tango".split()


# hard negatives


def brute_negatives(rows, every, positives=5, most=3):
    """rows: vec_id, label, vec; the first row of an id takes part."""
    own = {}
    for i, label, v in sorted((r for r in rows if None not in r and r[2] and all(x is not None and math.isfinite(x) for x in r[2])), key=lambda r: (r[0], r[1], r[2])):
        own.setdefault(i, (label, [math.floor(256 * x) for x in v]))
    out = []
    for a in (i for i in own if i % every == 0):
        label, q = own[a]
        scored = sorted((-sum(x * y for x, y in zip(q, v)), i, la) for i, (la, v) in own.items() if i != a and len(v) == len(q))
        for p, i, _ in [x for x in scored if x[2] == label][:positives]:
            fits = [(n, j) for n, j, la in scored if la != label and 50 * -p <= 100 * -n <= 95 * -p][:most]
            out += [(a, i, rank + 1, j, -p, -n) for rank, (n, j) in enumerate(fits)]
    return sorted(out)


def mined(df, every, **kw):
    from pyspark.sql import functions as F

    return sorted(map(tuple, negatives.mine(df, F.col("vec_id") % every == 0, **kw).collect()))


VECTORS = "vec_id long, label int, vec array<double>, leaf string, block string, score int"


@pytest.fixture
def tight(monkeypatch):
    """Small nodes, leaves and blocks, so that a few hundred vectors make a deep tree and hot leaves have several blocks."""
    for name, value in {"WAYS": 3, "LEAF": 12, "BLOCK": 16, "ANCHORS": 8}.items():
        monkeypatch.setattr(negatives, name, value)


def clustered(rng, n, dim=6):
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(8)]
    return [(i, rng.randrange(3), [c + rng.gauss(0, 0.05) for c in rng.choice(centres)]) for i in range(n)]


def test_negatives_equal_brute_force(spark, tight):
    """Clusters, a hot vector, ties, repeated rows and ids, nulls, another dimension, clashing columns."""
    common.ship(spark)
    rng = random.Random(2)
    rows = clustered(rng, 300)
    rows += [(1000 + i, i % 2, rows[4][2]) for i in range(120)]  # a third of all are copies of one
    rows += [(5, 1, [9.0] * 6), (5, 1, [9.0] * 6), (7, 0, rows[7][2]), (-10, 1, rows[3][2]), (-20, 0, [0.0] * 6)]
    rows += [(None, 1, rows[0][2]), (2000, None, rows[0][2]), (2010, 1, None), (2020, 1, []), (2030, 0, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2040, 0, [math.nan] * 6), (2050, 0, [math.inf] * 6)]
    rows += [(3000 + i, i % 2, [1.0 + i / 7, 2.0]) for i in range(20)]
    df = spark.createDataFrame([(*r, "x", "y", 3) for r in rows], VECTORS)
    got = mined(df, 10)
    assert got == brute_negatives(rows, 10) and len(got) > 200
    assert mined(df.repartition(7), 10) == got


def test_few_rows_and_empty_tables(spark):
    common.ship(spark)
    none = spark.createDataFrame([], VECTORS)
    assert mined(none, 10) == []
    one = [(0, 1, [1.0, 2.0])]
    for rows in (one, [*one, (1, 1, [1.0, 1.0])], [*one, (1, 1, [1.0, 2.0]), (2, 0, [0.9, 1.5])], [(0, 1, [-1.0]), (1, 1, [1.0]), (2, 2, [1.0])]):
        assert mined(spark.createDataFrame([(*r, "x", "y", 3) for r in rows], VECTORS), 10) == brute_negatives(rows, 10)


def test_components_of_any_size_are_exact(spark):
    common.ship(spark)
    rows = [(i, i % 2, [2.0**21 + i / 3, -(2.0**19) * (i % 5), float(i)]) for i in range(40)]
    assert mined(spark.createDataFrame([(*r, "x", "y", 3) for r in rows], VECTORS), 4) == brute_negatives(rows, 4)


def test_ranges_drop_siblings_and_lose_nothing(tight):
    """On clusters an annulus reaches few leaves; whatever lies in it is in a leaf that is reached."""
    rng = random.Random(4)
    v = negatives.integers([x for _, _, x in clustered(rng, 600)])
    top = float((v * v).sum(1).max())
    tree = negatives.Tree(v[::3], top, 40)
    leaf, ranges = tree.route(v)
    for (node, k), (low, high) in ranges.items():
        tree.widen(node, k, low, high)
    q, scores = v[::20], v[::20] @ v.T
    high = np.sort(scores, 1)[:, -2]
    low = np.sort(scores, 1)[:, -12]
    square = (q * q).sum(1) + top
    reached = tree.reached(q, np.sqrt(square - 2 * high), np.sqrt(square - 2 * low))
    visits = np.zeros((len(q), len(tree.child)), bool)
    for node, rows in reached.items():
        visits[rows, node] = True
    for i in range(len(q)):
        assert all(visits[i, leaf[j]] for j in np.flatnonzero((scores[i] >= low[i]) & (scores[i] <= high[i])))
    assert len(tree.leaves) > 20 and visits[:, tree.leaves].mean() < 0.4


# fill in the middle


def brute_infill(i, text, rate=100, spm=50, marks=infill.MARKS):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    x = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in marks) or h[2] % 100 >= rate:
        return i, len(lines), "plain", None, None, text
    a, b = sorted(v % (len(lines) + 1) for v in h[:2])
    p, m, s = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    if h[3] % 100 < spm:
        return i, len(lines), "spm", len(p), len(m), f"{marks[1]}{s}{marks[0]}{p}{marks[2]}{m}"
    return i, len(lines), "psm", len(p), len(m), f"{marks[0]}{p}{marks[1]}{s}{marks[2]}{m}"


@pytest.fixture(scope="module")
def texts(spark):
    common.ship(spark)
    rng = random.Random(8)
    rows = [(1, None), (2, ""), (3, "\n"), (4, "\n\n\n"), (5, "one"), (6, "one\n"), (7, "a\r\nb\r\n"), (8, "has <S> in it\nand more\n"), (9, "ends with <\n<"), (10, "é\n" * 50), (None, "no id\nat all\n"), (None, None)]
    rows += [(11, "".join("x" * int(rng.paretovariate(0.5) % 5000) + "\n" for _ in range(2000))), (12, "y" * 300_000), (12, "another text\nof this id"), (12, "another text\nof this id"), (13, "日本\n\n語" * 3000)]
    rows += [(100 + i, "\n".join(" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 12)))) for i in range(150)]
    return rows, spark.createDataFrame([(i, t, "f", 5) for i, t in rows], "doc_id long, text string, form string, n int")


@pytest.mark.parametrize("rate,spm", [(100, 50), (40, 0), (70, 100)])
def test_infill_equals_brute_force_and_restores(texts, rate, spm):
    from pyspark.sql import functions as F

    rows, df = texts
    made = infill.fill_in_middle(df, rate=rate, spm_rate=spm)
    got = made.withColumn("restored", infill.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: str(r)
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted((brute_infill(i, t, rate, spm) for i, t in rows), key=key)
    assert sorted(((r.doc_id, r.restored) for r in got), key=key) == sorted(((i, t or "") for i, t in rows), key=key)
    assert infill.fill_in_middle(df.limit(0)).count() == 0


def test_other_marks_are_found_literally(texts):
    from pyspark.sql import functions as F

    marks = ("[a.]", "(b|", "$c^")
    rows, df = texts
    got = infill.fill_in_middle(df, marks=marks).withColumn("restored", infill.restored(F.col("output"), F.col("form"), marks)).collect()
    assert sorted(map(str, (r.restored for r in got))) == sorted(str(t or "") for _, t in rows) and {r.form for r in got} == {"plain", "psm", "spm"}


def test_rank_index_is_exact_and_short():
    rng = np.random.RandomState(3)
    for gaps in (rng.poisson(40, 20_000), (rng.pareto(0.4, 5000) % 1e6).astype(int), np.repeat([1, 900], 3000), np.array([], int), np.array([7])):
        offsets = np.concatenate([[0], np.cumsum(gaps + 1)])
        index = infill.RankIndex(offsets)
        assert [index.offset(r) for r in range(len(offsets))] == offsets.tolist()
        assert np.abs(index.residual.astype(int)).max() <= infill.ERROR + 1
    assert len(infill.RankIndex(np.cumsum(rng.poisson(40, 20_000))).first) < 400
    assert len(infill.RankIndex(np.arange(0, 10**6, 50)).first) == 1


# decontamination


def brute_hits(text, items, window=10):
    """n_words, n_hit and the item ids found, from all windows of all items."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    words, hit, found = split(text), set(), set()
    for i, t in items:
        w = split(t)
        n = min(len(w), window)
        for run in {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else ():
            for k in range(len(words) - n + 1):
                if tuple(words[k : k + n]) == run:
                    hit |= set(range(k, k + n))
                    found |= {str(i)} if i is not None else set()
    return len(words), len(hit), tuple(sorted(found))


@pytest.mark.parametrize("window", [10, 4])
def test_contamination_equals_brute_force(spark, window):
    """Spans in every place, short and overlapping items, items that share windows, a hot passage, few different words, odd rows."""
    common.ship(spark)
    rng = random.Random(6)
    said = lambda n, words=WORDS: " ".join(rng.choice(words) for _ in range(n))
    long = [said(rng.randint(10, 40)) for _ in range(12)]
    hot = said(14)
    items = [(i, t) for i, t in enumerate(long)] + [(20, hot), (21, "Ünd " + hot.upper() + "!"), (22, said(3)), (23, "kilo"), (24, said(9)), (25, said(2, "ab")), (26, "a a a a a a a a a a a a"), (27, ""), (28, None), (29, "?!"), (None, said(11)), (3, "tango 日本 7é éÉ"), (5, long[5])]
    docs = [(1, None), (2, ""), (3, " .,; "), (4, "kilo"), (5, "A" * 20_000), (6, "a " * 3000), (7, items[16][1]), (8, "x tango 日本 7é éÉ y"), (9, "tango 日本 7é éé"), (None, long[0]), (None, long[0]), (None, long[1])]
    for i in range(60):
        w = rng.choice([t for _, t in items if t]).split()
        a = rng.randrange(len(w))
        docs.append((100 + i, f"{said(rng.randint(0, 30))}{rng.choice([' ', ', ', chr(10)])}{' '.join(w[a : a + rng.choice([5, 9, 10, 11, 40])])} {said(rng.randint(0, 5))}"))
    docs += [(200 + i, f"{said(i % 7)} {hot} {said(i % 5)}") for i in range(60)] + [(300, " ".join(long)), (300, "another text"), (300, "another text")]
    df = spark.createDataFrame([(i, t, "x", 1.5) for i, t in docs], "doc_id long, text string, items string, n_hit double")
    it = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, d string")
    got = [(r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate.decontaminated(df, it, window).collect()]
    want = [(i, *brute_hits(t, items, window)) for i, t in docs]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(x[2] > 0 for x in want) > 100
    clean = decontaminate.decontaminated(df, it.limit(0), window).collect()
    assert len(clean) == len(docs) and all(r.n_hit == 0 and r["items"] == [] for r in clean)
    assert decontaminate.decontaminated(df.limit(0), it, window).count() == 0


def test_equal_runs_keep_equal_fingerprints():
    """The guarantee: of every run of a window's words, wherever it stands, the same place is kept."""
    rng = np.random.RandomState(5)
    for length in range(1, 11):
        run = rng.randint(0, 4, length).astype(np.uint64)
        k, w = decontaminate.plan(length)
        assert k + w - 1 == length
        at = []
        for _ in range(20):
            h = np.concatenate([rng.randint(0, 4, rng.randint(0, 9)).astype(np.uint64), run, rng.randint(0, 4, 5).astype(np.uint64)])
            start = next(i for i in range(len(h)) if (h[i : i + length] == run).all())
            low, grams = decontaminate.kept(h, length)
            place = int(decontaminate.chosen(grams, np.array([start]), w)[0])
            assert grams[place] == low[start]
            at.append(place - start)
        assert len(set(at)) == 1
