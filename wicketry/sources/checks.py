"""Checks of the star schema (A13), as a grain by match that is kept beside each batch and adds up.

Every step holds the match, so the facts of a batch, bucketed by match, need no exchange; only the rows by match meet through one. What a write finds in its own
batch is observed while the grain is written and stands in the pointer, so that an update reports violations without reading
anything again (``storage.violations``). A match lies in one batch, which ``ingest.add`` sees to; a match that another writer
put into two shows as repeated once the grains of the batches are added up (``integrity_kept``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTS = ("matches", "short", "innings", "repeated_innings", "deliveries", "without_innings", "repeated_deliveries", "outside")


def match_checks(tables: dict[str, DataFrame]) -> DataFrame:
    """One row for each match id that any table holds: rows, repeated keys, balls without innings or outside overs 0 to 19.

    A missing match_id or innings_number matches nothing. ``short`` is positive for twenty-over matches.
    """
    m, i, d = (tables[n] for n in ("matches", "innings", "deliveries"))
    n, again = F.sum("n"), F.count_if(F.col("n") > 1)
    by_match = m.groupBy("match_id").agg(F.count("*").alias("matches"), F.count_if(F.col("match_type").isin("T20", "IT20")).alias("short"))
    by_innings = i.groupBy("match_id", "innings_number").agg(F.count("*").alias("n"))
    played = by_innings.select(F.col("match_id").alias("_of"), F.col("innings_number").alias("_innings"))
    balls = d.groupBy("match_id", "innings_number", "over_number", "ball_number").agg(F.count("*").alias("n")).groupBy("match_id", "innings_number").agg(
        n.alias("balls"), again.alias("repeated"), F.sum(F.when(~F.col("over_number").between(0, 19), F.col("n"))).alias("outside"))
    # joined by match, the innings only a condition, as elsewhere
    balls = balls.join(played, (F.col("match_id") == F.col("_of")) & (F.col("innings_number") - F.col("_innings") == 0), "left")
    parts = (by_match, by_innings.groupBy("match_id").agg(n.alias("innings"), again.alias("repeated_innings")),
             balls.groupBy("match_id").agg(F.sum("balls").alias("deliveries"), F.sum(F.when(F.col("_of").isNull(), F.col("balls"))).alias("without_innings"), F.sum("repeated").alias("repeated_deliveries"), F.sum("outside").alias("outside")))
    return _added([p.select("match_id", *(F.coalesce(F.col(c), F.lit(0)).alias(c) if c in p.columns else F.lit(0).cast("bigint").alias(c) for c in COUNTS)) for p in parts])


def _added(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts).groupBy("match_id").agg(*(F.sum(c).alias(c) for c in COUNTS))


def violations() -> list[Column]:
    """Aggregates over a grain of checks: violations by check."""
    known = F.col("match_id").isNotNull() & (F.col("matches") > 0)
    total = lambda c, where=None: F.coalesce(F.sum(c if where is None else F.when(where, F.col(c))), F.lit(0))
    return [total("deliveries", ~known).alias("orphan_deliveries"), total("without_innings").alias("deliveries_without_innings"), total("repeated_deliveries").alias("repeated_deliveries"),
            total("outside", known & (F.col("short") > 0)).alias("overs_outside_phases"), total("innings", ~known).alias("orphan_innings"), total("repeated_innings").alias("repeated_innings"),
            F.count_if(F.col("matches") > 1).alias("repeated_matches")]


def repeated_players(players: DataFrame) -> DataFrame:
    return players.groupBy("player_id").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated_players"))


def integrity(tables: dict[str, DataFrame]) -> DataFrame:
    """Violations by check, counted anew: orphans, repeated keys, overs of no phase in twenty-over matches (A13). Reads deliveries once."""
    return _listed(match_checks(tables), tables["players"])


def integrity_kept(have: dict[str, DataFrame]) -> DataFrame:
    """The same from the kept grain and the registry, as ``storage.scan`` gives them, without reading the facts."""
    return _listed(_added([have["checks"]]), have["players"])


def _listed(checks: DataFrame, players: DataFrame) -> DataFrame:
    one = checks.agg(*violations()).crossJoin(repeated_players(players))  # one row each
    return one.select(F.stack(F.lit(len(one.columns)), *(x for c in one.columns for x in (F.lit(c), F.col(c)))).alias("check", "violations"))
