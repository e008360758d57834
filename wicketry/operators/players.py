"""Player search, matchups, fielding, dismissals, styles, discipline and clutch splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.filters import like, phase, stage_bucket
from ..functions.measures import BOWLER_KINDS, bowler_wicket, conceded, economy, faced, four, legal, ratio, six
from ..plans.fixture import Tables
from ..plans.grains import balls, batting_innings, bowling_innings, down, top, up
from .careers import batting_table, bowling_table

PAIR = ["batter", "batter_id", "bowler", "bowler_id"]


def credited() -> Column:
    """Dismissals of the striker that count for the bowler."""
    return bowler_wicket() & (F.col("wicket_player_out") == F.col("batter"))


def bat_dot() -> Column:
    return faced() & (F.col("runs_batter") == 0)


def search_players(t: Tables, query: str, limit: int = 10) -> DataFrame:
    """At least two characters."""
    if len(query) < 2:
        raise ValueError("a query needs at least two characters")
    x = t.players.filter(like("player_name", query)).select("player_id", "player_name", "batting_style", "bowling_style", "playing_role", "country")
    return top(x, limit, up("player_name"), up("player_id"))


def _matchup(b: DataFrame, *keys: str) -> DataFrame:
    """Balls are added up by innings, then by match, then by key; the first two need no exchange, and what is distinct is counted as rows."""
    names = ("balls", "runs", "runs_conceded", "dismissals", "dots", "fours", "sixes")
    level = b.groupBy("match_id", "innings_number", *keys).agg(
        F.count_if(faced()).alias("balls"), F.sum("runs_batter").alias("runs"), F.sum(conceded()).alias("runs_conceded"),
        F.count_if(credited()).alias("dismissals"), F.count_if(bat_dot()).alias("dots"), F.count_if(four()).alias("fours"), F.count_if(six()).alias("sixes"),
        F.collect_list(F.when(credited(), F.col("wicket_kind"))).alias("kinds"))
    more = [F.sum(c).alias(c) for c in names]
    level = level.groupBy("match_id", *keys).agg(F.count("innings_number").alias("innings"), *more, F.flatten(F.collect_list("kinds")).alias("kinds"))
    sums = level.groupBy(*keys).agg(F.count("match_id").alias("matches"), F.sum("innings").alias("innings"), *more, F.array_join(F.sort_array(F.flatten(F.collect_list("kinds"))), ", ").alias("kinds"))
    return sums.select(
        *keys, "matches", "innings", "balls", "runs", "runs_conceded", "dismissals", "dots", "fours", "sixes", "kinds", ratio("runs", "dismissals").alias("average"), ratio("runs", "balls", 100.0).alias("strike_rate"),
        economy("runs_conceded", "balls").alias("economy"), ratio("balls", "dismissals").alias("bowling_strike_rate"), ratio("dots", "balls", 100.0).alias("dot_pct"), ratio(F.col("fours") + F.col("sixes"), F.col("balls"), 100.0).alias("boundary_pct"))


def matchup_pair(t: Tables, batter: str, bowler: str, perspective: str = "batting", limit: int = 10, **f) -> DataFrame:
    """Economy on balls faced; kinds sorted."""
    x = _matchup(balls(t, like("batter", batter) & like("bowler", bowler), names=(batter, bowler), **f), *PAIR)
    order = [down("runs")] if perspective == "batting" else [down("dismissals"), up("runs_conceded")]
    return top(x, limit, *order, *map(up, PAIR))


def matchup_vs_team(t: Tables, batter: str, opposition: str, sort_by: str = "balls", min_balls: int = 6, limit: int = 10, **f) -> DataFrame:
    """By bowler, in matches that involve the opposition; filtered, then cut."""
    x = _matchup(balls(t, like("batter", batter), names=(batter,), opposition=opposition, **f), *PAIR).filter(F.col("balls") >= min_balls)
    order = {"dismissals": [down("dismissals"), down("balls")], "average": [up("average")], "strike_rate": [up("strike_rate")]}.get(sort_by, [down("balls")])
    return top(x, limit, *order, *map(up, PAIR))


def matchup_leaderboard(t: Tables, batter: str | None = None, bowler: str | None = None, record_type: str = "most_dismissals", min_balls: int = 12, min_innings: int = 3, limit: int = 10, **f) -> DataFrame:
    """One fixed name, grouped by the other side."""
    where = like("batter", batter) if batter else like("bowler", bowler)
    keys = ["bowler", "bowler_id"] if batter else ["batter", "batter_id"]
    x = _matchup(balls(t, where, names=(batter or bowler,), **f), *keys).filter((F.col("balls") >= min_balls) & (F.col("innings") >= min_innings))
    most = [down("dismissals"), down("balls")]
    orders = {"best_average": [up("average")], "best_strike_rate": [up("strike_rate")], "most_dots": [down("dot_pct")]} if batter else {
        "most_runs": [down("runs_conceded")], "highest_strike_rate": [down("strike_rate")], "best_average": [up("average")]}
    return top(x, limit, *orders.get(record_type, most), *map(up, keys))


def discipline_bowling(t: Tables, player: str | None = None, phase_name: str | None = None, sort_by: str = "dot_pct", min_balls: int = 100, limit: int = 10, **f) -> DataFrame:
    """Wide and no-ball percentages count runs over deliveries."""
    b = balls(t, phase(phase_name) & (like("bowler", player) if player else F.lit(True)), names=(player,), **f)
    s = b.groupBy("bowler", "bowler_id").agg(
        F.count("*").alias("deliveries"), F.count_if(legal()).alias("legal_balls"), F.count_if(legal() & (F.col("runs_total") == 0)).alias("dots"), F.sum("extras_wides").alias("wides"), F.sum("extras_noballs").alias("noballs"),
        F.count_if(four() | six()).alias("boundaries")).filter(F.col("legal_balls") >= min_balls)
    x = s.select("bowler", "bowler_id", "deliveries", "legal_balls", "dots", "wides", "noballs", "boundaries", ratio("dots", "legal_balls", 100.0).alias("dot_pct"), ratio("wides", "deliveries", 100.0).alias("wide_pct"),
                 ratio("noballs", "deliveries", 100.0).alias("noball_pct"), economy(F.col("wides") + F.col("noballs"), F.col("legal_balls")).alias("extras_per_over"), ratio("boundaries", "legal_balls", 100.0).alias("boundary_pct"))
    order = {"extras_per_over": up("extras_per_over"), "boundary_pct": up("boundary_pct"), "wide_pct": up("wide_pct")}.get(sort_by, down("dot_pct"))
    return top(x, limit, order, up("bowler"), up("bowler_id"))


def discipline_batting(t: Tables, player: str | None = None, phase_name: str | None = None, sort_by: str = "dot_pct", min_balls: int = 100, limit: int = 10, **f) -> DataFrame:
    """D28."""
    b = balls(t, phase(phase_name) & (like("batter", player) if player else F.lit(True)), names=(player,), **f)
    s = b.groupBy("batter", "batter_id").agg(F.count_if(faced()).alias("balls"), F.sum("runs_batter").alias("runs"), F.count_if(bat_dot()).alias("dots"), F.count_if(four() | six()).alias("boundaries")).filter(F.col("balls") >= min_balls)
    x = s.select("batter", "batter_id", "balls", "runs", "dots", "boundaries", ratio("dots", "balls", 100.0).alias("dot_pct"), ratio("boundaries", "balls", 100.0).alias("boundary_pct"), ratio("runs", "balls", 100.0).alias("strike_rate"))
    return top(x, limit, down("boundary_pct") if sort_by == "boundary_pct" else up("dot_pct"), up("batter"), up("batter_id"))


def fielding(t: Tables, player: str | None = None, sort_by: str = "total", min_matches: int = 10, limit: int = 10, **f) -> DataFrame:
    """Both fielders count; matches are those with a dismissal."""
    kind = F.col("wicket_kind")
    x = balls(t, F.col("is_wicket"), names=(player,), **f).select("match_id", "wicket_kind", F.explode(F.array("wicket_fielder1", "wicket_fielder2")).alias("fielder")).filter("fielder is not null")
    if player:
        x = x.filter(like("fielder", player))
    s = x.groupBy("fielder").agg(F.countDistinct("match_id").alias("matches"), F.count_if(kind.isin("caught", "caught and bowled")).alias("catches"), F.count_if(kind == "run out").alias("run_outs"), F.count_if(kind == "stumped").alias("stumpings"), F.count("*").alias("total"))
    return top(s.filter(F.col("matches") >= min_matches), limit, down(sort_by), up("fielder"))


def dismissals(t: Tables, player: str, perspective: str = "batting", vs_player: str | None = None, **f) -> DataFrame:
    """Kinds, counts, shares. Batting counts all ways out of the player; bowling those credited."""
    where = F.col("is_wicket") & (like("wicket_player_out", player) if perspective == "batting" else like("bowler", player) & F.col("wicket_kind").isin(*BOWLER_KINDS))
    if vs_player:
        where = where & like("bowler" if perspective == "batting" else "batter", vs_player)
    x = balls(t, where, names=(player, vs_player), **f).groupBy(F.col("wicket_kind").alias("kind")).agg(F.count("*").alias("count"))
    x = x.withColumn("total", F.sum("count").over(Window.partitionBy()))  # a dozen kinds at most
    return x.select("kind", "count", ratio("count", "total", 100.0, 1).alias("pct"), "total").orderBy(down("count"), up("kind"))


def style_matchup(t: Tables, player: str, side: str = "batting", grouping: str = "arm", phase_name: str | None = None, min_balls: int = 30, limit: int = 10, **f) -> DataFrame:
    """By the other side's style; missing styles are Unknown."""
    name, other = ("batter", "bowler_id") if side == "batting" else ("bowler", "batter_id")
    column = "batting_style" if side == "bowling" else {"broad": "bowling_style_broad", "arm": "bowling_style_arm"}.get(grouping, "bowling_style")
    styles = t.players.select(F.col("player_id").alias(other), F.col(column).alias("style"))
    b = balls(t, like(name, player) & phase(phase_name), names=(player,), **f).join(styles, other, "left").withColumn("style", F.coalesce("style", F.lit("Unknown")))
    s = _matchup(b, "style")
    x = s.filter(F.col("balls") >= min_balls).select("style", "innings", "balls", "runs", "dismissals", "dots", "fours", "sixes", ratio("runs", "dismissals").alias("average"), ratio("runs", "balls", 100.0).alias("strike_rate"),
                                                     ratio("dots", "balls", 100.0).alias("dot_pct"), ratio(F.col("fours") + F.col("sixes"), F.col("balls"), 100.0).alias("boundary_pct"))
    return top(x, limit, down("balls"), up("style"))


SPLITS = {"overall": ("league", "knockout", "final", "placement"), "league": ("league",), "knockouts": ("knockout", "final"), "knockout": ("knockout",), "final": ("final",), "placement": ("placement",)}


def _stage_innings(t: Tables, player: str, side: str, **f) -> DataFrame:
    name = "batter" if side == "batting" else "bowler"
    b = balls(t, like(name, player), ("event_stage",), (player,), **f).withColumn("stage", stage_bucket())
    return batting_innings(b, "stage") if side == "batting" else bowling_innings(b, "stage")


def _clutch_columns(side: str) -> list[str]:
    return ["matches", "innings", "runs", "average", "strike_rate", "fifties", "centuries"] if side == "batting" else ["matches", "innings", "wickets", "runs_conceded", "average", "economy", "best_figures"]


def clutch_stage(t: Tables, player: str, side: str = "batting", **f) -> DataFrame:
    """The raw stage table."""
    table = (batting_table if side == "batting" else bowling_table)(_stage_innings(t, player, side, **f), "stage")
    return table.select("stage", *_clutch_columns(side)).orderBy("stage")


def clutch(t: Tables, player: str, side: str = "batting", **f) -> DataFrame:
    """Splits recomputed from summed counts; each innings counts for every split of its stage."""
    names = F.filter(F.array(*(F.when(F.col("stage").isin(*stages), F.lit(k)) for k, stages in SPLITS.items())), lambda x: x.isNotNull())
    inn = _stage_innings(t, player, side, **f).withColumn("split", F.explode(names))
    return (batting_table if side == "batting" else bowling_table)(inn, "split").select("split", *_clutch_columns(side)).orderBy("split")


def clutch_delta(t: Tables, player: str, side: str = "batting", **f) -> DataFrame:
    """Knockouts (with finals) less league, from the rounded averages."""
    x = clutch(t, player, side, **f)
    rate = "strike_rate" if side == "batting" else "economy"
    pick = lambda c, s: F.max(F.when(F.col("split") == s, F.col(c)))
    s = x.agg(*(pick(c, k).alias(f"{k}_{c}") for c in ("average", rate) for k in ("league", "knockouts")))
    d = lambda c: F.floor((F.col(f"knockouts_{c}") - F.col(f"league_{c}")) * 100.0 + 0.5) / 100.0
    return s.select(d("average").alias("average_delta"), d(rate).alias(f"{rate}_delta"))
