"""Player metadata: CSV scan, enrichment, bowling style groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The names an id column can have, and the metadata columns.
ID_COLUMNS = ("cricsheet_id", "player_id", "identifier")
META_COLUMNS = ("batting_style", "bowling_style", "playing_role", "country")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """player_id and the metadata columns present, all text; an error without an id or any metadata column."""
    csv = spark.read.csv(path, header=True, inferSchema=False)
    key = next((c for c in ID_COLUMNS if c in csv.columns), None)
    meta = [c for c in META_COLUMNS if c in csv.columns]
    if key is None:
        raise ValueError(f"none of {', '.join(ID_COLUMNS)} is a column")
    if not meta:
        raise ValueError(f"none of {', '.join(META_COLUMNS)} is a column")
    return csv.select(F.col(key).alias("player_id"), *meta)


def enrich(players: DataFrame, metadata: DataFrame) -> DataFrame:
    """Players with the metadata of their id: matched rows take it even where it is null; one row per id counts, the smallest."""
    meta = [c for c in metadata.columns if c in META_COLUMNS]
    order = Window.partitionBy("player_id").orderBy(*(F.col(c).asc_nulls_last() for c in meta))
    one = metadata.filter("player_id is not null").withColumn("_n", F.row_number().over(order)).filter("_n = 1")
    one = one.select("player_id", F.lit(True).alias("_hit"), *(F.col(c).alias(f"_{c}") for c in meta))
    wide = players.join(one, "player_id", "left")
    return wide.select(*(F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in meta else F.col(c) for c in players.columns))


def _has(style: Column, *words: str) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | style.contains(w)
    return out


def derive_style_groups(players: DataFrame) -> DataFrame:
    """Adds or replaces bowling_style_broad and bowling_style_arm; rows without a style stay null."""
    style = F.lower("bowling_style")
    turning = _has(style, "orthodox", "spin", "break")
    pace = _has(style, "fast") | (_has(style, "medium") & ~turning)
    spin = _has(style, "spin", "orthodox", "break", "chinaman")
    broad = F.when(style.isNull(), None).when(pace, "Pace").when(spin, "Spin").otherwise("Unknown")
    arm = F.when(_has(style, "left"), "Left-arm ").otherwise("Right-arm ")
    full = F.when(style.isNull(), None).when(pace, F.concat(arm, F.lit("Pace"))).when(spin, F.concat(arm, F.lit("Spin"))).otherwise("Unknown")
    return players.withColumns({"bowling_style_broad": broad, "bowling_style_arm": full})


def enriched_or_same(spark: SparkSession, players: DataFrame, path: str) -> tuple[DataFrame, str | None]:
    """Enriched players, or the players as they are and what was wrong: a bad file never fails a load."""
    try:
        return derive_style_groups(enrich(players, read_metadata(spark, path))), None
    except Exception as e:  # noqa: BLE001  any failure of the optional file
        return players, f"{type(e).__name__}: {e}"
