"""Scoring measures as aggregate Columns over deliveries, and exact rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The kinds of dismissal credited to the bowler.
BOWLER_KINDS = ("bowled", "caught", "caught and bowled", "lbw", "stumped", "hit wicket")


def legal() -> Column:
    return (F.col("extras_wides") == 0) & (F.col("extras_noballs") == 0)


def faced() -> Column:
    return F.col("extras_wides") == 0


def bowler_wicket() -> Column:
    return F.col("is_wicket") & F.col("wicket_kind").isin(*BOWLER_KINDS)


def striker_out() -> Column:
    return F.col("is_wicket") & (F.col("wicket_player_out") == F.col("batter"))


def four() -> Column:
    return (F.col("runs_batter") == 4) & ~F.coalesce("runs_non_boundary", F.lit(False))


def six() -> Column:
    return (F.col("runs_batter") == 6) & ~F.coalesce("runs_non_boundary", F.lit(False))


def conceded() -> Column:
    return F.col("runs_total") - F.col("extras_byes") - F.col("extras_legbyes")


def batting() -> list[Column]:
    """Batting measures of a group of deliveries."""
    return [F.sum("runs_batter").alias("runs"), F.count_if(faced()).alias("balls"), F.count_if(four()).alias("fours"), F.count_if(six()).alias("sixes"),
            F.count_if(faced() & (F.col("runs_batter") == 0)).alias("bat_dots"), F.max(F.when(striker_out(), 1).otherwise(0)).cast("bigint").alias("out")]


def bowling() -> list[Column]:
    """Bowling measures of a group of deliveries."""
    return [F.count_if(legal()).alias("balls"), F.sum(conceded()).alias("conceded"), F.count_if(bowler_wicket()).alias("wickets"), F.count_if(legal() & (F.col("runs_total") == 0)).alias("dots"),
            F.count_if(legal() & (F.col("runs_batter") == 0)).alias("bat_dots"), F.count_if(four()).alias("fours"), F.count_if(six()).alias("sixes")]


def rounded(x: Column, digits: int = 2) -> Column:
    """Half away from zero on the double as it is, which both engines agree on."""
    f = F.lit(float(10**digits))
    return F.signum(x) * F.floor(F.abs(x) * f + 0.5) / f


def half_up(x: Column, digits: int = 2) -> Column:
    """Half towards plus infinity."""
    f = F.lit(float(10**digits))
    return F.floor(x * f + 0.5) / f


def ratio(n: Column | str, d: Column | str, times: float = 1.0, digits: int = 2) -> Column:
    """Rounded n / d * times; null where d is 0."""
    n, d = (F.col(x) if isinstance(x, str) else x for x in (n, d))
    return rounded(F.try_divide(n.cast("double"), d.cast("double")) * F.lit(times), digits)


def overs_text(balls: Column) -> Column:
    """Whole overs, a dot, balls over; always six balls."""
    return F.concat(F.floor(balls / 6).cast("string"), F.lit("."), (balls % 6).cast("string"))


def economy(conceded_: Column | str, balls: Column | str) -> Column:
    c, b = (F.col(x) if isinstance(x, str) else x for x in (conceded_, balls))
    return rounded(F.try_divide(c.cast("double"), b.cast("double") / 6.0))
