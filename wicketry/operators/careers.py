"""Career tables and leaderboards over batting and bowling innings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.filters import like, phase
from ..functions.measures import conceded, economy, overs_text, ratio, rounded
from ..plans.fixture import Tables
from ..plans.grains import balls, batting_innings, batting_of, bowling_innings, bowling_of, down, participation, top, up

BATTER = ["batter", "batter_id"]
BOWLER = ["bowler", "bowler_id"]


def batting_table(innings: DataFrame, *keys: str) -> DataFrame:
    """Measures of batting careers (D2): one row per key."""
    sums = innings.groupBy(*keys).agg(
        F.countDistinct("match_id").alias("matches"), F.count("*").alias("innings"), F.sum("out").alias("outs"), F.sum("runs").alias("runs"),
        F.max("runs").alias("highest_score"), F.sum("balls").alias("balls_faced"), F.sum("fours").alias("fours"), F.sum("sixes").alias("sixes"), F.sum("bat_dots").alias("dots"),
        F.count_if(F.col("runs") >= 100).alias("centuries"), F.count_if(F.col("runs").between(50, 99)).alias("fifties"), F.count_if((F.col("runs") == 0) & (F.col("out") == 1)).alias("ducks"))
    return sums.select(
        *keys, "matches", "innings", (F.col("innings") - F.col("outs")).alias("not_outs"), "runs", "highest_score", ratio("runs", "outs").alias("average"),
        ratio("runs", "balls_faced", 100.0).alias("strike_rate"), "balls_faced", "fours", "sixes", "centuries", "fifties", "ducks", "dots", "outs")


def bowling_table(innings: DataFrame, *keys: str, more: tuple[Column, ...] = ()) -> DataFrame:
    """Measures of bowling careers (D3), one row per key, and ``more`` aggregates (maidens, where the grain has them)."""
    best = F.max_by(F.struct("wickets", "conceded"), F.struct("wickets", -F.col("conceded"))).alias("b")
    sums = innings.groupBy(*keys).agg(
        F.countDistinct("match_id").alias("matches"), F.count("*").alias("innings"), F.sum("balls").alias("balls"), F.sum("conceded").alias("runs_conceded"), F.sum("wickets").alias("wickets"), best,
        F.sum("dots").alias("dots"), F.sum("fours").alias("fours"), F.sum("sixes").alias("sixes"),
        F.count_if(F.col("wickets") >= 5).alias("five_wicket_hauls"), F.count_if(F.col("wickets") >= 4).alias("four_wicket_hauls"), *more)
    extra = [c for c in sums.columns if c == "maidens"]
    return sums.select(
        *keys, *extra, "matches", "innings", "balls", overs_text(F.col("balls")).alias("overs"), "runs_conceded", "wickets", F.concat("b.wickets", F.lit("/"), "b.conceded").alias("best_figures"),
        ratio("runs_conceded", "wickets").alias("average"), economy("runs_conceded", "balls").alias("economy"), ratio("balls", "wickets").alias("strike_rate"), "dots", "fours", "sixes", "five_wicket_hauls", "four_wicket_hauls")


BAT_OUT = ["matches", "innings", "not_outs", "runs", "highest_score", "average", "strike_rate", "balls_faced", "fours", "sixes", "centuries", "fifties", "ducks"]
BOWL_OUT = ["matches", "innings", "overs", "runs_conceded", "wickets", "best_figures", "average", "economy", "strike_rate", "dots", "five_wicket_hauls", "four_wicket_hauls"]


def player_batting(t: Tables, player: str, **f) -> DataFrame:
    """D2."""
    return batting_table(batting_of(t, like("batter", player), names=(player,), **f), *BATTER).select(*BATTER, *BAT_OUT)


def player_bowling(t: Tables, player: str, **f) -> DataFrame:
    """D3: maidens are overs without runs conceded; best figures and maidens belong to (name, id)."""
    if t.bowling is not None:
        return bowling_table(bowling_of(t, like("bowler", player), names=(player,), **f), *BOWLER, more=(F.sum("maidens").alias("maidens"),)).select(*BOWLER, *BOWL_OUT, "maidens")
    b = balls(t, like("bowler", player), names=(player,), **f)
    overs = b.groupBy(*BOWLER, "match_id", "innings_number", "over_number").agg(F.sum(conceded()).alias("r"))
    maidens = overs.groupBy(*BOWLER).agg(F.count_if(F.col("r") == 0).alias("maidens"))
    return bowling_table(bowling_innings(b), *BOWLER).join(maidens, BOWLER).select(*BOWLER, *BOWL_OUT, "maidens")


BATTING_ORDERS = {"most_runs": "runs", "highest_average": "average", "highest_strike_rate": "strike_rate", "most_centuries": "centuries", "most_fifties": "fifties",
                  "most_sixes": "sixes", "most_fours": "fours", "highest_score": "highest_score"}


def batting_records(t: Tables, record_type: str = "most_runs", min_innings: int = 10, limit: int = 10, **f) -> DataFrame:
    """An unknown type means most_runs."""
    table = batting_table(batting_of(t, **f), *BATTER).filter(F.col("innings") >= min_innings).select(*BATTER, *BAT_OUT)
    return top(table, limit, down(BATTING_ORDERS.get(record_type, "runs")), *map(up, BATTER))


BOWLING_ORDERS = {"most_wickets": (down, "wickets"), "best_average": (up, "average"), "best_economy": (up, "economy"), "best_strike_rate": (up, "strike_rate"), "most_five_wicket_hauls": (down, "five_wicket_hauls")}


def bowling_records(t: Tables, record_type: str = "most_wickets", min_innings: int = 10, limit: int = 10, **f) -> DataFrame:
    """D8."""
    table = bowling_table(bowling_of(t, **f), *BOWLER).filter(F.col("innings") >= min_innings).select(*BOWLER, *BOWL_OUT)
    order, column = BOWLING_ORDERS[record_type]
    return top(table, limit, order(column), *map(up, BOWLER))


def phase_batting(t: Tables, phase_name: str, player: str | None = None, sort_by: str = "runs", min_balls: int = 50, limit: int = 10, **f) -> DataFrame:
    """D15."""
    where = phase(phase_name) & (like("batter", player) if player else F.lit(True))
    table = batting_table(batting_innings(balls(t, where, names=(player,), **f)), *BATTER).filter(F.col("balls_faced") >= min_balls)
    table = table.select(*BATTER, "matches", "innings", "not_outs", "runs", "average", "strike_rate", "balls_faced", "fours", "sixes", "dots",
                         ratio("dots", "balls_faced", 100.0).alias("dot_pct"), ratio(F.col("fours") + F.col("sixes"), F.col("balls_faced"), 100.0).alias("boundary_pct"))
    order = {"strike_rate": down("strike_rate"), "average": down("average"), "dot_pct": up("dot_pct")}.get(sort_by, down("runs"))
    return top(table, limit, order, *map(up, BATTER))


def phase_bowling(t: Tables, phase_name: str, player: str | None = None, sort_by: str = "wickets", min_balls: int = 50, limit: int = 10, **f) -> DataFrame:
    """D16."""
    where = phase(phase_name) & (like("bowler", player) if player else F.lit(True))
    table = bowling_table(bowling_innings(balls(t, where, names=(player,), **f)), *BOWLER).filter(F.col("balls") >= min_balls)
    table = table.select(*BOWLER, "matches", "innings", "balls", "overs", "runs_conceded", "wickets", "dots", "fours", "sixes", "average", "economy", "strike_rate",
                         ratio("dots", "balls", 100.0).alias("dot_pct"), ratio(F.col("fours") + F.col("sixes"), F.col("balls"), 100.0).alias("boundary_pct"))
    order = {"strike_rate": up("strike_rate"), "average": up("average"), "economy": up("economy"), "dot_pct": down("dot_pct")}.get(sort_by, down("wickets"))
    return top(table, limit, order, *map(up, BOWLER))


def situational(t: Tables, situation: str, position: int | None = None, player: str | None = None, min_innings: int = 5, sort_by: str = "runs", limit: int = 10, **f) -> DataFrame:
    """Chasing, setting, pressure or batting_position; the last needs a position."""
    b = balls(t, context=("match_type",), names=(player,), **f)
    n, test = F.col("innings_number"), F.col("match_type") == "Test"
    if situation == "chasing":
        b = b.filter(F.when(test, n == 4).otherwise(n == 2))
    elif situation == "setting":
        b = b.filter(F.when(test, n.isin(1, 2)).otherwise(n == 1))
    elif situation == "pressure":
        hard = b.filter(F.col("over_number") <= 9).groupBy("match_id", "innings_number").agg(F.count_if("is_wicket").alias("w")).filter("w >= 3").select("match_id", "innings_number")
        b = b.join(hard, ["match_id", "innings_number"], "left_semi")
    elif position is None:
        raise ValueError("batting_position needs a position")
    else:
        place = F.min(F.col("over_number") * 1000 + F.col("ball_number")).alias("first")
        w = Window.partitionBy("match_id", "innings_number").orderBy("first")
        at = b.groupBy("match_id", "innings_number", *BATTER).agg(place).withColumn("pos", F.dense_rank().over(w)).filter(F.col("pos") == position).drop("pos", "first")
        b = b.join(at, ["match_id", "innings_number", *BATTER], "left_semi")
    if player:
        b = b.filter(like("batter", player))
    table = batting_table(batting_innings(b), *BATTER).filter(F.col("innings") >= min_innings).select(*BATTER, *BAT_OUT)
    return top(table, limit, down(sort_by if sort_by in ("average", "strike_rate", "centuries") else "runs"), *map(up, BATTER))


def tournament_batters(t: Tables, event: str, limit: int = 10, **f) -> DataFrame:
    """By name."""
    table = batting_table(batting_of(t, event_name=event, **f), "batter")
    return top(table.select("batter", "matches", "innings", "runs", "average", "strike_rate", "highest_score"), limit, down("runs"), up("batter"))


def tournament_bowlers(t: Tables, event: str, limit: int = 10, **f) -> DataFrame:
    """By name."""
    table = bowling_table(bowling_of(t, event_name=event, **f), "bowler")
    return top(table.select("bowler", "matches", "innings", "wickets", "runs_conceded", "average", "economy"), limit, down("wickets"), up("bowler"))


def milestone(t: Tables, kind: str, threshold: int, proximity: int | None = None, limit: int = 20, **f) -> DataFrame:
    """Players near or past a threshold; proximity defaults to a tenth, rounded up."""
    near = proximity if proximity is not None else -(-threshold // 10)
    if kind in ("runs", "centuries", "fifties"):
        table = batting_table(batting_of(t, **f), *BATTER).selectExpr("batter AS player", "batter_id AS player_id", f"{kind} AS value")
    elif kind in ("wickets", "five_wicket_hauls"):
        table = bowling_table(bowling_of(t, **f), *BOWLER).selectExpr("bowler AS player", "bowler_id AS player_id", f"{kind} AS value")
    else:
        table = participation(t, **f).groupBy("player_id").agg(F.count("*").alias("value")).join(t.players, "player_id").select(F.col("player_name").alias("player"), "player_id", "value")
    table = table.filter(F.col("value") >= threshold - near).select(
        "player", "player_id", "value", F.greatest(F.lit(threshold) - F.col("value"), F.lit(0)).cast("bigint").alias("remaining"), (F.col("value") >= threshold).alias("reached"))
    return top(table, limit, down("value"), up("player"), up("player_id"))


def emerging(t: Tables, side: str, metric: str, recent: str | None = None, min_recent: int = 5, min_career: int = 20, threshold: float = 20.0, limit: int = 10, **f) -> DataFrame:
    """Career against the recent season in one pass; the default season is the largest text over all matches."""
    inn = (batting_of if side == "batting" else bowling_of)(t, context=("season",), **f)
    last = t.matches.agg(F.max("season").alias("last")) if recent is None else None
    inn = inn.crossJoin(last) if last is not None else inn.withColumn("last", F.lit(recent))  # one row
    now = F.col("season") == F.col("last")
    keys = BATTER if side == "batting" else BOWLER
    fields = ("runs", "balls", "out") if side == "batting" else ("conceded", "balls", "wickets")
    # the season is constant in a match, so match rows are counted where distinct matches are asked for
    per = inn.groupBy("match_id", *keys).agg(F.count("*").alias("n"), F.max(now).alias("now"), *(F.sum(x).alias(x) for x in fields))
    fresh_of = lambda x: F.sum(F.when(F.col("now"), F.col(x)).otherwise(0))
    sums = per.groupBy(*keys).agg(
        F.sum("n").alias("innings"), fresh_of("n").alias("recent_innings"), F.count("*").alias("m"), F.count_if("now").alias("rm"),
        *(F.sum(x).alias(x) for x in fields), *(fresh_of(x).alias(f"r_{x}") for x in fields))
    if side == "batting":
        pick = {"average": ("runs", "out", 1.0), "strike_rate": ("runs", "balls", 100.0)}[metric]
        career, fresh = ratio(pick[0], pick[1], pick[2]), ratio(f"r_{pick[0]}", f"r_{pick[1]}", pick[2])
        better = (F.col("recent") - F.col("career")) / F.col("career") * 100.0
    elif metric == "average":
        career, fresh = ratio("conceded", "wickets"), ratio("r_conceded", "r_wickets")
        better = (F.col("career") - F.col("recent")) / F.col("career") * 100.0
    elif metric == "wickets_per_match":
        career, fresh = ratio("wickets", "m"), ratio("r_wickets", "rm")
        better = (F.col("recent") - F.col("career")) / F.col("career") * 100.0
    else:  # economy, and strike_rate, which means economy
        career, fresh = economy("conceded", "balls"), economy("r_conceded", "r_balls")
        better = (F.col("career") - F.col("recent")) / F.col("career") * 100.0
    table = sums.filter((F.col("recent_innings") >= min_recent) & (F.col("innings") >= min_career)).select(*keys, "innings", "recent_innings", career.alias("career"), fresh.alias("recent"))
    table = table.filter(F.col("career") > 0).withColumn("gain", better).filter(F.col("gain") >= threshold)
    return top(table.select(*keys, "innings", "recent_innings", F.col("career").alias("career_value"), F.col("recent").alias("recent_value"), rounded(F.col("gain")).alias("improvement_pct")), limit, down("improvement_pct"), *map(up, keys))


def _kept(exclude: dict[str, str], player_column: str) -> Column:
    """Balls outside the exclusions; a null venue or event drops the ball, as in SQL."""
    keep = F.lit(True)
    for name, value in exclude.items():
        if name == "opposition":
            keep = keep & ~((F.col("team1") == value) | (F.col("team2") == value))
        elif name in ("venue", "event"):
            keep = keep & ~like("venue" if name == "venue" else "event_name", value)
        else:
            keep = keep & ~like(player_column, value)
    return keep


def _both_careers(b: DataFrame, keep: Column, innings, table, keys: list[str], columns: tuple) -> DataFrame:
    """Original (o_) and modified (m_) table side by side, in one pass: a kept ball counts for both."""
    each = b.withColumn("version", F.explode(F.when(F.coalesce(keep, F.lit(False)), F.array(F.lit("o"), F.lit("m"))).otherwise(F.array(F.lit("o")))))
    t = table(innings(each, "version"), "version", *keys)
    return t.groupBy(*keys).agg(*(F.max(F.when(F.col("version") == v, F.col(c))).alias(f"{v}_{c}") for v in ("o", "m") for c in columns))


def what_if_batting(t: Tables, player: str, exclude: dict[str, str], **f) -> DataFrame:
    """Original and modified career side by side; missing ratios count as 0 in deltas."""
    b = balls(t, like("batter", player), ("team1", "team2", "venue", "event_name"), (player,), **f)
    wide = _both_careers(b, _kept(exclude, "bowler"), batting_innings, batting_table, BATTER, ("matches", "innings", "runs", "average", "strike_rate"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return wide.select(
        *BATTER, "o_matches", "o_innings", "o_runs", "o_average", "o_strike_rate", "m_matches", "m_innings", "m_runs", "m_average", "m_strike_rate",
        (F.col("o_innings") - zero("m_innings")).alias("excluded_innings"), (zero("m_runs") - F.col("o_runs")).alias("runs_delta"),
        rounded(F.coalesce("m_average", F.lit(0.0)) - F.coalesce("o_average", F.lit(0.0))).alias("average_delta"),
        rounded(F.coalesce("m_strike_rate", F.lit(0.0)) - F.coalesce("o_strike_rate", F.lit(0.0))).alias("strike_rate_delta"))


def what_if_bowling(t: Tables, player: str, exclude: dict[str, str], **f) -> DataFrame:
    """D32."""
    b = balls(t, like("bowler", player), ("team1", "team2", "venue", "event_name"), (player,), **f)
    wide = _both_careers(b, _kept(exclude, "batter"), bowling_innings, bowling_table, BOWLER, ("matches", "innings", "wickets", "runs_conceded", "average", "economy"))
    return wide.select(
        *BOWLER, "o_matches", "o_innings", "o_wickets", "o_runs_conceded", "o_average", "o_economy", "m_matches", "m_innings", "m_wickets", "m_runs_conceded", "m_average", "m_economy",
        (F.col("o_innings") - F.coalesce("m_innings", F.lit(0))).alias("excluded_innings"), (F.coalesce("m_wickets", F.lit(0)) - F.col("o_wickets")).alias("wickets_delta"),
        rounded(F.coalesce("m_average", F.lit(0.0)) - F.coalesce("o_average", F.lit(0.0))).alias("average_delta"),
        rounded(F.coalesce("m_economy", F.lit(0.0)) - F.coalesce("o_economy", F.lit(0.0))).alias("economy_delta"))


def season_batting(t: Tables, player: str, sort_by: str = "season", **f) -> DataFrame:
    """D35."""
    table = batting_table(batting_of(t, like("batter", player), ("season",), (player,), **f), "season", *BATTER).select("season", *BATTER, *BAT_OUT)
    return table.orderBy({"season": up("season"), "average": down("average")}.get(sort_by, down("runs")), up("season"), *map(up, BATTER))


def season_bowling(t: Tables, player: str, sort_by: str = "season", **f) -> DataFrame:
    """D35."""
    table = bowling_table(bowling_of(t, like("bowler", player), ("season",), (player,), **f), "season", *BOWLER).select("season", *BOWLER, *BOWL_OUT)
    return table.orderBy({"season": up("season"), "average": up("average")}.get(sort_by, down("wickets")), up("season"), *map(up, BOWLER))


def comparison(t: Tables, side: str, player1: str, player2: str, **f) -> DataFrame:
    """Either name, in name order."""
    keys, name = (BATTER, "batter") if side == "batting" else (BOWLER, "bowler")
    either = like(name, player1) | like(name, player2)
    table = batting_table(batting_of(t, either, **f), *keys).select(*keys, *BAT_OUT) if side == "batting" else bowling_table(bowling_of(t, either, **f), *keys).select(*keys, *BOWL_OUT)
    return table.orderBy(*map(up, keys))
