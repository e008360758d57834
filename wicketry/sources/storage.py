"""The star schema on shared storage: batches, a pointer that names the live ones, buckets by match, kept grains.

A write is one batch below ``<table>/batch=<id>``. What readers see is what the newest pointer file names: ``_pointer/v<n>.json`` lists the live
batches, and comes into being by one rename after all tables are written. So there is no moment without a table, a
failed write leaves only files that no pointer names (the next write removes them), and a reader that has begun keeps
its batches until ``vacuum`` drops the versions that named them. One writer at a time is assumed; two that meet don't both commit.

Matches, innings, deliveries and the innings grains are bucketed by match and sorted inside a bucket, with the same
number of buckets everywhere, so joins and roll-ups by match need no exchange, over several batches too. ``compact``
rewrites the live batches as one. The grains (batting and bowling innings, one row per player and innings) are made from each
batch's own deliveries: a match lies in one batch, so they are exact, and an update adds its share only. So are the index of names (``names``)
and the checks; a table that nobody asks for these can be written without them, which its pointer says and later batches follow.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.measures import batting, bowling
from .checks import match_checks, repeated_players, violations as found_by
from .names import INDEX, appearances, grams

STAR = ("players", "innings", "deliveries", "matches")
GRAINS = ("batting", "bowling")
CHECKS = "checks"
#: What a table may be written without: the index of names, the grain of checks and its counts.
INDEXED = "index"
QUARANTINE = "quarantine"
POINTER = "_pointer"
#: Buckets of a new table, if none are asked for; a table keeps its number until it is rebuilt or compacted.
BUCKETS = 8
#: Deliveries of a bucket, so that what a task sorts or adds up doesn't grow with the table.
BUCKET_ROWS = 250_000
INNINGS = ("match_id", "innings_number")
SORTED = {"matches": ("match_id",), "innings": INNINGS, "deliveries": (*INNINGS, "over_number", "ball_number"), "batting": INNINGS, "bowling": INNINGS, CHECKS: ("match_id",)}


def buckets_for(deliveries: int) -> int:
    """Buckets of a table with so many deliveries: more with more of them, so that a task's share stays the same."""
    return max(BUCKETS, -(-deliveries // BUCKET_ROWS))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir; where that is unset, in a folder of our own, in local mode (tests) only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _file_system(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def versions(spark: SparkSession, path: str) -> list[dict]:
    """All pointers that are whole, newest first."""
    out = []
    for name in reversed([n for n in _names(spark, f"{path}/{POINTER}") if n.startswith("v")]):
        try:
            state = json.loads(read_text(spark, f"{path}/{POINTER}/{name}"))
        except ValueError:  # a store without atomic renames may leave a part of one
            continue
        out.append(state)
    return out


def current(spark: SparkSession, path: str) -> dict | None:
    """The newest pointer: version, buckets, batches (id, counts, and the columns of each of its tables), streams (last batch of each)."""
    return next(iter(versions(spark, path)), None)


def commit(spark: SparkSession, path: str, state: dict) -> None:
    """Make ``state`` the newest pointer, by one rename; fails if its version exists."""
    fs, made = _file_system(spark, f"{path}/{POINTER}/_new-{uuid.uuid4().hex}")
    out = fs.create(made, False)
    out.write(bytearray(json.dumps(state), "utf-8"))
    out.close()
    _, target = _file_system(spark, f"{path}/{POINTER}/v{state['version']:09d}.json")
    if fs.exists(target) or not fs.rename(made, target):
        fs.delete(made, False)
        raise OSError(f"version {state['version']} of {path} was committed by another writer")


def remove_unnamed(spark: SparkSession, path: str, keep: list[dict]) -> None:
    """Delete batches that none of these pointers names."""
    ids = {b["id"] for state in keep for b in state["batches"]}
    for name in (*STAR, *GRAINS, *INDEX, CHECKS, QUARANTINE):
        for folder in _names(spark, f"{path}/{name}"):
            if folder.startswith("batch=") and folder[6:] not in ids:
                remove(spark, f"{path}/{name}/{folder}")


def live_rows(spark: SparkSession, path: str, name: str) -> int:
    """Rows of a live table, as counted when they were written."""
    state = current(spark, path)
    return sum(b["counts"].get(name, 0) for b in state["batches"]) if state else 0


def violations(spark: SparkSession, path: str) -> dict[str, int]:
    """Violations by check in the live batches, as counted when they were written (A13): only the pointer is read."""
    state, found = current(spark, path), {}
    for batch in state["batches"] if state else ():
        for name, n in batch.get("violations", {}).items():
            found[name] = found.get(name, 0) + n
    return found


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Forget all but the newest ``keep`` versions and delete what only the others named."""
    found = versions(spark, path)
    for state in found[keep:]:
        remove(spark, f"{path}/{POINTER}/v{state['version']:09d}.json")
    remove_unnamed(spark, path, found[:keep])


def _read(spark: SparkSession, path: str, name: str, batch: dict, buckets: int) -> DataFrame:
    """One table of one batch; its buckets are declared by a catalog entry that is dropped once the plan holds them."""
    at, columns = f"{path}/{name}/batch={batch['id']}", batch["columns"][name]
    if name not in SORTED:
        return spark.read.schema(columns).parquet(at)
    entry = f"read_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {entry} ({columns}) USING parquet CLUSTERED BY (match_id) SORTED BY ({', '.join(SORTED[name])}) INTO {buckets} BUCKETS LOCATION '{at}'")
    try:
        return spark.table(entry)
    finally:
        spark.sql(f"DROP TABLE {entry}")


def scan(spark: SparkSession, path: str, version: int | None = None) -> dict[str, DataFrame]:
    """The live tables below ``path``, or those of a version (A2): the star, its grains and name index, quarantine and, where there is one, player_enrichment."""
    state = current(spark, path) if version is None else next((s for s in versions(spark, path) if s["version"] == version), None)
    if state is None:
        raise FileNotFoundError(f"no table at {path}")
    found = {}
    for name in (*STAR, *GRAINS, *INDEX, CHECKS, QUARANTINE):
        for batch in state["batches"]:
            if name in batch["columns"]:
                part = _read(spark, path, name, batch, state["buckets"])
                found[name] = found[name].unionByName(part) if name in found else part
    found.setdefault(QUARANTINE, spark.createDataFrame([], "match_id string, _corrupt_record string"))
    if _names(spark, f"{path}/player_enrichment"):
        found["player_enrichment"] = spark.read.parquet(f"{path}/player_enrichment")
    return found


def grains(deliveries: DataFrame) -> dict[str, DataFrame]:
    """Batting and bowling innings, one row per player; maidens are overs without runs conceded, as in D3. Bowling is added up by over first, so each reads the balls once."""
    keys = (*INNINGS, "bowler", "bowler_id")
    overs = deliveries.groupBy(*keys, "over_number").agg(*bowling())
    sums = [F.sum(c).alias(c) for c in overs.columns[len(keys) + 1 :]]
    return {"batting": deliveries.groupBy(*INNINGS, "batter", "batter_id").agg(*batting()), "bowling": overs.groupBy(*keys).agg(*sums, F.count_if(F.col("conceded") == 0).alias("maidens"))}


def at_once(spark: SparkSession, *jobs: Callable[[], object]) -> list:
    """Run jobs that don't need each other side by side, so that the last tasks of one don't leave cores idle; the first error counts, after all have ended."""
    with ThreadPoolExecutor(max(1, len(jobs))) as pool:
        done = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
    return [d.result() for d in done]


def write_batch(tables: dict[str, DataFrame], path: str, buckets: int, without: tuple[str, ...] = ()) -> dict:
    """Write the tables as one batch, which no pointer names yet; its entry for one, with rows and violations counted during the write."""
    spark = next(iter(tables.values())).sparkSession
    batch = {"id": f"b{uuid.uuid4().hex}", "columns": {}, "counts": {}}

    def write(name: str, df: DataFrame, *more: Column) -> dict:
        at, seen = f"{path}/{name}/batch={batch['id']}", Observation()
        batch["columns"][name] = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        df = df.observe(seen, F.count(F.lit(1)).alias("n"), *more)
        if name in SORTED:
            entry = f"write_{uuid.uuid4().hex}"
            try:
                df.repartition(buckets, "match_id").write.format("parquet").bucketBy(buckets, "match_id").sortBy(*SORTED[name]).option("path", at).saveAsTable(entry)
            finally:
                spark.sql(f"DROP TABLE IF EXISTS {entry}")  # the files stay
        else:
            df.write.parquet(at)
        batch["counts"][name] = seen.get["n"]
        return {k: v for k, v in seen.get.items() if k != "n"}

    def index(written: DataFrame) -> None:
        write("appearances", appearances(written))
        write("grams", grams(_read(spark, path, "appearances", batch, buckets)))

    def check(mine: dict[str, DataFrame]) -> None:
        batch["violations"] = write(CHECKS, match_checks(mine), *found_by()) | repeated_players(mine["players"]).first().asDict()

    at_once(spark, *(partial(write, name, tables[name]) for name in (*STAR, QUARANTINE) if name in tables))
    more = []
    if "deliveries" in tables:
        written = _read(spark, path, "deliveries", batch, buckets)
        more += [*(partial(write, name, df) for name, df in grains(written).items()), *([] if INDEXED in without else [partial(index, written)])]
    if CHECKS not in without and all(name in tables for name in STAR):
        more.append(partial(check, {name: _read(spark, path, name, batch, buckets) for name in STAR}))
    at_once(spark, *more)
    return batch


def write_star(tables: dict[str, DataFrame], path: str, mode: str = "append", buckets: int | None = None, stream: tuple[str, int] | None = None, without: tuple[str, ...] | None = None) -> dict:
    """Write the tables as one batch and commit it (A3): beside the live ones, or in their place. ``stream``: name and batch to remember; ``without``: what a new table isn't to keep (INDEXED, CHECKS). Returns the rows written."""
    spark = next(iter(tables.values())).sparkSession
    known = versions(spark, path)
    old = known[0] if known else {"version": 0, "buckets": buckets or BUCKETS, "batches": [], "streams": {}}
    remove_unnamed(spark, path, known)
    n = old["buckets"] if mode == "append" else buckets or old["buckets"]
    without = old.get("without", []) if without is None or (mode == "append" and known) else list(without)
    batch = write_batch(tables, path, n, tuple(without))
    streams = old["streams"] | ({stream[0]: stream[1]} if stream else {})
    commit(spark, path, {"version": old["version"] + 1, "buckets": n, "batches": [*(old["batches"] if mode == "append" else ()), batch], "streams": streams} | ({"without": without} if without else {}))
    return batch["counts"]


def rebuild(spark: SparkSession, tables: dict[str, DataFrame], path: str, buckets: int | None = None, without: tuple[str, ...] | None = None) -> None:
    """Put a fresh copy in place of all batches (A4); until it is committed readers see the old ones, which go with the next but one version."""
    write_star(tables, path, "overwrite", buckets, without=without)
    vacuum(spark, path, keep=2)


def compact(spark: SparkSession, path: str, buckets: int | None = None) -> None:
    """Rewrite the live batches as one; the rows stay as they are. Files afterwards: at most one a table and bucket.

    Unless given, the number of buckets stays, or grows to that of all deliveries.
    """
    live = scan(spark, path)
    buckets = buckets or max(current(spark, path)["buckets"], buckets_for(live_rows(spark, path, "deliveries")))
    write_star({name: live[name] for name in (*STAR, QUARANTINE) if name in live}, path, "overwrite", buckets)
    vacuum(spark, path, keep=2)
