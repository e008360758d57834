"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Stands for a missing doc_id, which comes after all others.
NO_ID = (1 << 63) - 1
#: Parts that a hot group is dealt into when its rows meet a value of the group.
SALTS = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a folder of our own where that is unset, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: the result survives lost executors and is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop_cut(*dfs: DataFrame | None) -> None:
    """Delete the files that ``cut`` wrote, once nothing reads them any more."""
    for df in dfs:
        if df is not None and getattr(df, "_cut_path", None):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._cut_path)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def keyed(docs: DataFrame) -> DataFrame:
    """``d`` (doc_id, NO_ID where it is missing), ``h`` (hash of the text) and ``text`` (never null): rows of equal d and h are one document."""
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("d"), F.xxhash64(text_or_empty()).alias("h"), text_or_empty().alias("text"))


def doc_id(d: str = "d") -> Column:
    """The doc_id that ``keyed`` replaced."""
    return F.when(F.col(d) != NO_ID, F.col(d)).alias("doc_id")


def salt(*by: str) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")


def salted(groups: DataFrame, mask: str = "_salts", name: str = "_s") -> DataFrame:
    """One row for each salt that a group's rows have: ``mask`` is their salts_of()."""
    bits = F.expr(f"filter(sequence(0, {SALTS - 1}), x -> shiftright({mask}, x) & 1L = 1L)")
    return groups.withColumn(name, F.explode(bits)).drop(mask)


def salts_of(s: str = "_s") -> Column:
    """Aggregate: which salts the rows of a group have, as bits."""
    return F.bit_or(F.expr(f"shiftleft(1L, {s})")).alias("_salts")


def with_minimum(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """``rows`` and the least ``value`` of their ``key``; no task needs all rows of a key."""
    s = rows.withColumn("_s", salt(value))
    parts = s.groupBy(key, "_s").agg(F.min(value).alias(name))
    low = parts.groupBy(key).agg(F.min(name).alias(name), salts_of())
    return s.join(salted(low), [key, "_s"]).drop("_s")


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that what a worker makes of a batch stays small; freed memory goes back at the end."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def ship(spark: SparkSession) -> None:
    """Give the executors this package's code, once per application, wherever the driver imported it from."""
    context = spark.sparkContext
    if getattr(context, "_corpus_code", None):
        return
    top = Path(__file__).resolve().parent.parent
    path = Path(tempfile.mkdtemp(prefix="code-")) / "corpus_code.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted([top / "__init__.py", *(top / "llm").glob("*.py")]):
            z.write(f, f.relative_to(top.parent))
    context.addPyFile(str(path))
    context._corpus_code = str(path)
