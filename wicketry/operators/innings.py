"""Scorecards, single-innings and over records, partnerships, progression, batter streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.filters import like, match_filter
from ..functions.measures import bowler_wicket, conceded, economy, faced, four, legal, overs_text, ratio, rounded, six
from ..plans.fixture import Tables
from ..plans.grains import balls, batting_innings, batting_of, bowling_innings, down, top, up
from .streaks import streaks

WHERE = ["match_id", "innings_number"]
CONTEXT = ["match_type", "date_start", "venue"]


def place() -> Column:
    return F.col("over_number") * 1000 + F.col("ball_number")


def _main(t: Tables) -> DataFrame:
    return t.innings.filter(~F.col("is_super_over")).select(*WHERE, F.col("batting_team").alias("team"), F.col("bowling_team").alias("opposition"))


def scorecard_batting(t: Tables, match_id: str | None = None) -> DataFrame:
    """Batting cards of one match or of all, in batting order; dismissal, fielder and bowler come from the same last ball."""
    d = t.deliveries if match_id is None else t.deliveries.filter(F.col("match_id") == match_id)
    out = F.col("is_wicket") & (F.col("wicket_player_out") == F.col("batter"))
    last = F.max_by(F.struct(F.col("wicket_kind").alias("kind"), F.col("wicket_fielder1").alias("fielder"), F.col("bowler").alias("by")), F.when(out, place()))
    card = d.groupBy(*WHERE, "batter", "batter_id").agg(
        F.min(place()).alias("first"), F.sum("runs_batter").alias("runs"), F.count_if(faced()).alias("balls"), F.count_if(four()).alias("fours"), F.count_if(six()).alias("sixes"), F.count_if(out).alias("outs"), last.alias("w"))
    order = F.row_number().over(Window.partitionBy(*WHERE).orderBy("first", "batter_id"))
    rate = F.when(F.col("balls") == 0, F.lit(0.0)).otherwise(ratio("runs", "balls", 100.0))
    w = lambda f: F.when(F.col("outs") > 0, F.col(f"w.{f}"))
    return card.select(*WHERE, order.alias("position"), "batter", "batter_id", "runs", "balls", "fours", "sixes", rate.alias("strike_rate"), w("kind").alias("dismissal"), w("fielder").alias("fielder"), w("by").alias("bowler"))


def scorecard_bowling(t: Tables, match_id: str | None = None) -> DataFrame:
    """Bowling cards in order of the first over; a maiden needs six legal balls."""
    d = t.deliveries if match_id is None else t.deliveries.filter(F.col("match_id") == match_id)
    overs = d.groupBy(*WHERE, "bowler", "bowler_id", "over_number").agg(
        F.sum(conceded()).alias("c"), F.count_if(legal()).alias("l"), F.count_if(bowler_wicket()).alias("w"), F.sum("extras_wides").alias("wd"), F.sum("extras_noballs").alias("nb"))
    card = overs.groupBy(*WHERE, "bowler", "bowler_id").agg(
        F.min("over_number").alias("first"), F.sum("l").alias("balls"), F.sum("c").alias("runs_conceded"), F.sum("w").alias("wickets"),
        F.count_if((F.col("c") == 0) & (F.col("l") >= 6)).alias("maidens"), F.sum("wd").alias("wides"), F.sum("nb").alias("noballs"))
    order = F.row_number().over(Window.partitionBy(*WHERE).orderBy("first", "bowler_id"))
    return card.select(*WHERE, order.alias("position"), "bowler", "bowler_id", overs_text(F.col("balls")).alias("overs"), "maidens", "runs_conceded", "wickets", economy("runs_conceded", "balls").alias("economy"), "wides", "noballs")


def scorecard_totals(t: Tables, match_id: str | None = None) -> DataFrame:
    """Totals with extras split."""
    d = t.deliveries if match_id is None else t.deliveries.filter(F.col("match_id") == match_id)
    sums = d.groupBy(*WHERE).agg(
        F.sum("runs_total").alias("total"), F.count_if("is_wicket").alias("wickets"), F.sum("runs_extras").alias("extras"),
        *(F.sum(f"extras_{x}").alias(x) for x in ("wides", "noballs", "byes", "legbyes", "penalty")), F.count_if(legal()).alias("l"))
    return t.innings.select(*WHERE, "batting_team").join(sums, WHERE).withColumn("overs", overs_text(F.col("l"))).drop("l")


def innings_progression(t: Tables, match_id: str, innings: int = 1) -> DataFrame:
    """Over by over, with running sums and the names of those out."""
    d = t.deliveries.filter((F.col("match_id") == match_id) & (F.col("innings_number") == innings))
    names = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("is_wicket"), F.struct("ball_number", "wicket_player_out")))), lambda x: x.wicket_player_out), ", ")
    o = d.groupBy("over_number").agg(F.sum("runs_total").alias("runs"), F.count_if("is_wicket").alias("wickets"), F.count_if(legal()).alias("l"), names.alias("out"))
    w = Window.orderBy("over_number").rowsBetween(Window.unboundedPreceding, 0)  # one innings
    o = o.withColumn("cumulative_runs", F.sum("runs").over(w)).withColumn("cumulative_wickets", F.sum("wickets").over(w)).withColumn("cl", F.sum("l").over(w))
    return o.select("over_number", "runs", "cumulative_runs", "wickets", "cumulative_wickets", economy("runs", "l").alias("run_rate"), economy("cumulative_runs", "cl").alias("cumulative_run_rate"), F.nullif("out", F.lit("")).alias("dismissed"))


def innings_records(t: Tables, record_type: str = "highest_score", player: str | None = None, limit: int = 10, **f) -> DataFrame:
    """Super overs left out."""
    b = balls(t, like("batter", player) if player else None, tuple(CONTEXT), (player,), **f)
    x = batting_innings(b, *CONTEXT).join(_main(t), WHERE).select(
        "batter", "batter_id", *WHERE, "runs", "balls", ratio("runs", "balls", 100.0).alias("strike_rate"), "fours", "sixes", (F.col("out") == 0).alias("not_out"), "team", "opposition", *CONTEXT)
    order = {"most_sixes": [down("sixes"), down("runs")], "most_fours": [down("fours"), down("runs")]}.get(record_type, [down("runs"), up("balls")])
    return top(x, limit, *order, *map(up, WHERE), up("batter_id"))


def fastest(t: Tables, threshold: int = 50, player: str | None = None, limit: int = 10, **f) -> DataFrame:
    """Balls faced when the running score first reaches the threshold."""
    b = balls(t, like("batter", player) if player else None, ("match_type", "date_start"), (player,), **f).join(_main(t), WHERE)
    keys = [*WHERE, "batter", "batter_id"]
    w = Window.partitionBy(*keys).orderBy("over_number", "ball_number").rowsBetween(Window.unboundedPreceding, 0)
    run = b.withColumn("cr", F.sum("runs_batter").over(w)).withColumn("cb", F.sum(faced().cast("int")).over(w))
    x = run.groupBy(*keys, "team", "opposition", "match_type", "date_start").agg(
        F.min(F.when(F.col("cr") >= threshold, F.col("cb"))).alias("balls_to_reach"), F.sum("runs_batter").alias("final_runs"), F.count_if(faced()).alias("final_balls")).filter("balls_to_reach is not null")
    return top(x, limit, up("balls_to_reach"), down("final_runs"), *map(up, WHERE), up("batter_id"))


def best_bowling_figures(t: Tables, player: str | None = None, limit: int = 10, **f) -> DataFrame:
    """D46."""
    b = balls(t, like("bowler", player) if player else None, tuple(CONTEXT), (player,), **f)
    x = bowling_innings(b, *CONTEXT).join(_main(t), WHERE).select(
        "bowler", "bowler_id", *WHERE, F.concat(F.col("wickets").cast("string"), F.lit("/"), F.col("conceded").cast("string")).alias("figures"), "wickets", F.col("conceded").alias("runs_conceded"),
        overs_text(F.col("balls")).alias("overs"), economy("conceded", "balls").alias("economy"), F.col("opposition").alias("team"), F.col("team").alias("against"), *CONTEXT)
    return top(x, limit, down("wickets"), up("runs_conceded"), *map(up, WHERE), up("bowler_id"))


def over_records(t: Tables, side: str = "batting", player: str | None = None, limit: int = 10, **f) -> DataFrame:
    """Most runs off the bat by one batter in an over, or most runs conceded in one."""
    name, runs = ("batter", F.col("runs_batter")) if side == "batting" else ("bowler", conceded())
    b = balls(t, like(name, player) if player else None, ("match_type", "date_start"), (player,), **f)
    x = b.groupBy(name, f"{name}_id", *WHERE, "over_number", "match_type", "date_start").agg(F.sum(runs).alias("runs"), F.count_if(six()).alias("sixes"), F.count_if(four()).alias("fours")).join(_main(t), WHERE)
    return top(x, limit, down("runs"), down("sixes"), *map(up, WHERE), up("over_number"), up(f"{name}_id"))


def stands(t: Tables, player: str | None = None, player2: str | None = None, **f) -> DataFrame:
    """Runs of each unordered pair in each innings."""
    pair = F.lit(True)
    for p in (player, player2):
        if p:
            pair = pair & (like("batter", p) | like("non_striker", p))
    b = balls(t, pair, tuple(CONTEXT), (player, player2), **f)
    return b.groupBy(*WHERE, F.least("batter", "non_striker").alias("player_a"), F.greatest("batter", "non_striker").alias("player_b"), *CONTEXT).agg(
        F.sum("runs_total").alias("partnership_runs"), F.count_if(faced()).alias("balls"))


def partnerships(t: Tables, player: str | None = None, player2: str | None = None, min_runs: int = 50, limit: int = 10, **f) -> DataFrame:
    """D10."""
    x = stands(t, player, player2, **f).filter(F.col("partnership_runs") >= min_runs)
    return top(x, limit, down("partnership_runs"), up("player_a"), up("player_b"), *map(up, WHERE))


def partnership_pairs(t: Tables, player: str | None = None, player2: str | None = None, limit: int = 10, **f) -> DataFrame:
    """D11."""
    r = F.col("partnership_runs")
    x = stands(t, player, player2, **f).groupBy("player_a", "player_b").agg(
        F.count("*").alias("stands"), F.sum(r).alias("total_runs"), rounded(F.avg(r)).alias("average"), F.max(r).alias("highest"), F.count_if(r >= 50).alias("fifty_plus"), F.count_if(r >= 100).alias("hundred_plus"))
    return top(x, limit, down("total_runs"), up("player_a"), up("player_b"))


def batter_streaks(t: Tables, kind: str = "fifty_plus", threshold: int = 50, player: str | None = None, min_length: int = 2, limit: int = 10, **f) -> DataFrame:
    """Consecutive innings of fifty or more, or ducks."""
    inn = batting_of(t, like("batter", player) if player else None, ("date_start",), (player,), **f)
    hit = F.col("runs") >= threshold if kind == "fifty_plus" else (F.col("runs") == 0) & (F.col("out") == 1)
    x = streaks(inn.withColumn("highest_score", F.col("runs")), ["batter", "batter_id"], hit, ["date_start", *WHERE], ("runs",), ("highest_score",))
    return top(x.filter(F.col("length") >= min_length), limit, down("length"), down("runs"), up("batter"), up("batter_id"), up("start_date"))


def _form(inn: DataFrame, last_n: int, key: str) -> DataFrame:
    return top(inn, last_n, down("date_start"), down("match_id"), down("innings_number"), up(key))


def form_batting(t: Tables, player: str, last_n: int = 10, **f) -> DataFrame:
    """The last innings, newest first, with dismissal and bowler of the last dismissal ball."""
    b = balls(t, like("batter", player), ("date_start", "match_type"), (player,), **f)
    out = F.col("is_wicket") & (F.col("wicket_player_out") == F.col("batter"))
    how = b.groupBy(*WHERE, "batter_id").agg(F.max_by(F.struct("wicket_kind", "bowler"), F.when(out, place())).alias("w"), F.count_if(out).alias("o"))
    inn = batting_innings(b, "date_start", "match_type").join(how, [*WHERE, "batter_id"]).join(t.innings.select(*WHERE, F.col("bowling_team").alias("opposition")), WHERE)
    x = inn.select("batter", "batter_id", *WHERE, "date_start", "match_type", "opposition", "runs", "balls", "fours", "sixes", ratio("runs", "balls", 100.0).alias("strike_rate"),
                   F.when(F.col("o") > 0, F.col("w.wicket_kind")).alias("dismissal"), F.when(F.col("o") > 0, F.col("w.bowler")).alias("bowler"), "out")
    return _form(x, last_n, "batter_id")


def form_batting_summary(t: Tables, player: str, last_n: int = 10, **f) -> DataFrame:
    """D40."""
    s = form_batting(t, player, last_n, **f).agg(F.count("*").alias("innings"), F.sum("runs").alias("runs"), F.sum("out").alias("dismissals"), F.sum("balls").alias("balls"), F.max("runs").alias("highest"), F.min("runs").alias("lowest"))
    return s.select("innings", "runs", "dismissals", ratio("runs", "dismissals").alias("average"), ratio("runs", "balls", 100.0).alias("strike_rate"), "highest", "lowest")


def form_bowling(t: Tables, player: str, last_n: int = 10, **f) -> DataFrame:
    """Dots are legal balls without runs off the bat."""
    b = balls(t, like("bowler", player), ("date_start", "match_type"), (player,), **f)
    x = bowling_innings(b, "date_start", "match_type").join(t.innings.select(*WHERE, F.col("batting_team").alias("opposition")), WHERE)
    x = x.select("bowler", "bowler_id", *WHERE, "date_start", "match_type", "opposition", overs_text(F.col("balls")).alias("overs"), "balls", F.col("conceded").alias("runs_conceded"), "wickets", F.col("bat_dots").alias("dots"),
                 economy("conceded", "balls").alias("economy"), F.concat(F.col("wickets").cast("string"), F.lit("/"), F.col("conceded").cast("string")).alias("figures"))
    return _form(x, last_n, "bowler_id")


def form_bowling_summary(t: Tables, player: str, last_n: int = 10, **f) -> DataFrame:
    """Economy from balls, not from the overs text."""
    s = form_bowling(t, player, last_n, **f).agg(
        F.count("*").alias("innings"), F.sum("balls").alias("balls"), F.sum("runs_conceded").alias("runs_conceded"), F.sum("wickets").alias("wickets"),
        F.max_by("figures", F.struct("wickets", -F.col("runs_conceded"))).alias("best_figures"))
    return s.select("innings", overs_text(F.col("balls")).alias("overs"), "runs_conceded", "wickets", ratio("runs_conceded", "wickets").alias("average"), economy("runs_conceded", "balls").alias("economy"), "best_figures")
