"""Predicates on matches and deliveries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PHASES = {"powerplay": (0, 5), "middle": (6, 14), "death": (15, 19)}


def like(column: Column | str, part: str) -> Column:
    """Case-insensitive substring; % and _ of the input are wildcards (B2)."""
    column = F.col(column) if isinstance(column, str) else column
    return column.ilike(f"%{part}%")


def match_filter(match_type=None, gender=None, team=None, opposition=None, venue=None, city=None, event_name=None, season=None, date_from=None, date_to=None) -> Column:
    """The ten match filters; an empty value counts as absent. Match-level: never which side a player was on (B1)."""
    parts = []
    for name, value in (("match_type", match_type), ("gender", gender), ("season", season)):
        if value:
            parts.append(F.col(name) == value)
    for value in (team, opposition):
        if value:
            parts.append((F.col("team1") == value) | (F.col("team2") == value))
    for name, value in (("venue", venue), ("city", city), ("event_name", event_name)):
        if value:
            parts.append(like(name, value))
    if date_from:
        parts.append(F.col("date_start") >= F.lit(date_from).cast("date"))
    if date_to:
        parts.append(F.col("date_start") <= F.lit(date_to).cast("date"))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def phase(name: str | None) -> Column:
    """Overs of a phase."""
    return F.col("over_number").between(*PHASES[name]) if name else F.lit(True)


def stage_bucket(stage: Column | str = "event_stage") -> Column:
    """league, knockout, final or placement."""
    s = F.lower(F.col(stage) if isinstance(stage, str) else stage)
    final = s.contains("final")
    early = s.contains("semi") | s.contains("quarter") | s.contains("preliminary")
    knockout = final | s.contains("eliminator") | s.contains("qualifier") | s.contains("knockout") | s.rlike("play.*off") | s.contains("challenger")
    return F.when(s.isNull(), "league").when(s.contains("place"), "placement").when(final & ~early, "final").when(knockout, "knockout").otherwise("league")


def took_part(deliveries: DataFrame, player: str) -> DataFrame:
    """match_id, player and player_id of everyone of that name who batted or bowled in a match (B8); fielding alone doesn't count.

    One scan and one exchange, by match, which the result keeps.
    """
    sides = F.array(*(F.struct(F.col(c).alias("player"), F.col(f"{c}_id").alias("player_id")) for c in ("batter", "bowler")))
    people = deliveries.filter(like("batter", player) | like("bowler", player)).select("match_id", F.explode(sides).alias("p")).filter(like(F.col("p.player"), player))
    return people.groupBy("match_id").agg(F.collect_set("p").alias("p")).select("match_id", F.inline("p"))
