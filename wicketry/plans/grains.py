"""Shared intermediate grains: every career operator is a roll-up of one of these."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.filters import match_filter
from ..functions.measures import batting, bowling, legal
from ..sources.names import within
from .fixture import Tables


def balls(t: Tables, where: Column | None = None, context: tuple = (), names: tuple[str | None, ...] = (), **filters) -> DataFrame:
    """Deliveries of the matches that pass the filters, with the match columns asked for.

    The filter acts on the matches before the join; the optimizer picks the join by size. ``names`` are parts of names that ``where`` asks
    for, each in any role: on large tables the index of names then says which matches to read.
    """
    m = t.matches.filter(match_filter(**filters)).select("match_id", *context)
    d = t.deliveries if where is None else t.deliveries.filter(where)
    few = within(t, names)
    if few is not None:
        m, d = m.filter(few), d.filter(few)
    return d.join(m, "match_id")


def batting_innings(b: DataFrame, *keys: str) -> DataFrame:
    """One row per batter and innings."""
    return b.groupBy("match_id", "innings_number", "batter", "batter_id", *keys).agg(*batting())


def bowling_innings(b: DataFrame, *keys: str) -> DataFrame:
    """One row per bowler and innings."""
    return b.groupBy("match_id", "innings_number", "bowler", "bowler_id", *keys).agg(*bowling())


def batting_of(t: Tables, where: Column | None = None, context: tuple = (), names: tuple[str | None, ...] = (), **filters) -> DataFrame:
    """Batting innings of the matches that pass the filters, from the kept grain where there is one; ``where`` may test the batter only.

    Filters and names are constant in an innings of a player, so they commute with the roll-up.
    """
    if t.batting is None:
        return batting_innings(balls(t, where, context, names, **filters), *context)
    return _kept(t, t.batting, where, context, names, filters)


def bowling_of(t: Tables, where: Column | None = None, context: tuple = (), names: tuple[str | None, ...] = (), **filters) -> DataFrame:
    """Bowling innings, with maidens where they come from the kept grain; ``where`` may test the bowler only."""
    if t.bowling is None:
        return bowling_innings(balls(t, where, context, names, **filters), *context)
    return _kept(t, t.bowling, where, context, names, filters)


def _kept(t: Tables, grain: DataFrame, where: Column | None, context: tuple, names: tuple, filters: dict) -> DataFrame:
    m = t.matches.filter(match_filter(**filters)).select("match_id", *context)
    few = within(t, names)
    if few is not None:
        m, grain = m.filter(few), grain.filter(few)
    return (grain if where is None else grain.filter(where)).join(m, "match_id")


def participation(t: Tables, **filters) -> DataFrame:
    """One row per match and player id with bat or ball; a match's two dozen ids meet inside the match, so tables bucketed by match need no exchange."""
    ids = t.matches.filter(match_filter(**filters)).groupBy("match_id").agg(F.lit(1).alias("_one")).drop("_one")
    sides = [(t.deliveries, "batter_id"), (t.deliveries, "bowler_id")] if t.batting is None or t.bowling is None else [(t.batting, "batter_id"), (t.bowling, "bowler_id")]
    for grain, column in sides:
        ids = ids.join(grain.groupBy("match_id").agg(F.collect_set(column).alias(column)), "match_id", "left")
    none = F.array().cast("array<string>")
    return ids.select("match_id", F.explode(F.array_union(F.coalesce("batter_id", none), F.coalesce("bowler_id", none))).alias("player_id"))


def innings_totals(t: Tables, super_overs: bool = True) -> DataFrame:
    """One row per innings: teams, runs, wickets, legal balls."""
    i = t.innings if super_overs else t.innings.filter(~F.col("is_super_over"))
    sums = t.deliveries.groupBy("match_id", F.col("innings_number").alias("_n")).agg(
        F.sum("runs_total").alias("total"), F.count_if("is_wicket").alias("wickets"), F.count_if(legal()).alias("balls"))
    # joined by match, the innings only a condition, so that tables bucketed by match meet without an exchange
    return i.join(sums, "match_id").filter(F.col("_n") - F.col("innings_number") == 0).drop("_n")


def team_matches(t: Tables, **filters) -> DataFrame:
    """One row per team and match."""
    return t.matches.filter(match_filter(**filters)).withColumn("team", F.explode(F.array("team1", "team2")))


def top(df: DataFrame, limit: int, *order: Column) -> DataFrame:
    """The first rows; every order ends with a unique key, nulls last."""
    return df.orderBy(*order).limit(limit)


def down(name: str) -> Column:
    return F.col(name).desc_nulls_last()


def up(name: str) -> Column:
    return F.col(name).asc_nulls_last()
