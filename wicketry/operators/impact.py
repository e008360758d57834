"""Context-weighted impact of every player in every match (D42), and over careers.

One pass serves all matches. Deliveries are exchanged once, by match, and sorted once, by ball; windows inside an innings
give wickets down and stands. Each ball then becomes rows of roles (batter, bowler, dismissed), which
are added up to one row for each player, role and innings; whatever else the formulas need (a match's scoring level, an innings'
total, batting positions, the dismissed batter's runs) are windows over these few rows, so no fact is joined to another. ``formula`` is
"full" for single matches or "simple" for careers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.filters import like, match_filter, took_part
from ..functions.measures import BOWLER_KINDS, conceded, faced, half_up, legal, rounded, striker_out
from ..plans.fixture import Tables
from ..plans.grains import down, up

# Fixed values of the scoring rules.
STAGE_WEIGHTS = {"Final": 1.5, "Semi Final": 1.3, "Quarter Final": 1.2, "Qualifier": 1.2, "Qualifier 1": 1.2, "Qualifier 2": 1.2, "Eliminator": 1.2, "Playoff": 1.15, "Super Eight": 1.1, "Super Six": 1.1, "Super 12": 1.05}
PROXIES = {"pp": 0.95, "mid": 0.85, "death": 1.35}
INN = ["match_id", "innings_number"]


def phases() -> list[tuple[str, Column, float]]:
    """Name, overs, and the economy proxy of the simple formula."""
    over = F.col("over_number")
    return [("pp", over <= 5, PROXIES["pp"]), ("mid", over.between(6, 14), PROXIES["mid"]), ("death", over >= 15, PROXIES["death"])]


def _per(a: str, b: str, times: float = 1.0) -> Column:
    return F.try_divide(F.col(a).cast("double") * times, F.col(b).cast("double"))


ROLE = "role string, name string, id string, other string, other_id string, kind string, fielder string, stand bigint, r bigint, b bigint, t bigint, o int"


def roles(d: DataFrame) -> DataFrame:
    """Each ball as rows of its batter, its bowler and whoever is out, with what the innings looked like at that ball."""
    match = Window.partitionBy("match_id").orderBy("innings_number", "over_number", "ball_number").rowsBetween(Window.unboundedPreceding, 0)
    innings = Window.partitionBy(*INN).orderBy("over_number", "ball_number")
    before, upto = (innings.rowsBetween(Window.unboundedPreceding, k) for k in (-1, 0))
    d = d.withColumn("cum", F.sum("runs_total").over(match))  # first, so that the exchange is by match
    d = d.withColumns({
        "down": F.coalesce(F.sum(F.col("is_wicket").cast("int")).over(before), F.lit(0)),
        "since": F.coalesce(F.last(F.when(F.col("is_wicket"), F.col("cum")), True).over(before), F.first(F.col("cum") - F.col("runs_total")).over(upto))})
    none = F.lit(None)
    kinds = {"bat": (F.col("batter"), F.col("batter_id"), none, none, none, none, none, F.col("runs_batter"), faced().cast("int"), F.col("runs_total"), F.when(striker_out(), 1).otherwise(0)),
             "bowl": (F.col("bowler"), F.col("bowler_id"), none, none, none, none, none, conceded(), legal().cast("int"), F.lit(0), F.lit(0)),
             "out": (F.col("wicket_player_out"), none, F.col("bowler"), F.col("bowler_id"), F.col("wicket_kind"), F.col("wicket_fielder1"), F.col("cum") - F.col("since"), F.lit(0), F.lit(0), F.lit(0), F.lit(0))}
    fields = [x.split() for x in ROLE.split(", ")]
    rows = {k: F.struct(*(c.cast(kind).alias(n) for c, (n, kind) in zip((F.lit(k), *v), fields, strict=True))) for k, v in kinds.items()}
    return d.select(*INN, "asked", "over_number", (F.col("over_number") * 1000 + F.col("ball_number")).alias("place"), "down", F.inline(F.array_compact(F.array(rows["bat"], rows["bowl"], F.when(F.col("is_wicket"), rows["out"])))))


def players_of_innings(d: DataFrame) -> DataFrame:
    """One row for each role of a player in an innings, with the levels of its match and innings."""
    keys = ["asked", "role", "name", "id", "other", "other_id", "kind", "fielder", "stand"]  # asked is one value a match: as a key it needs no sort
    x = roles(d).groupBy(*INN, *keys).agg(
        F.sum("r").alias("runs"), F.sum("b").alias("balls"), F.sum("t").alias("total"), F.max("o").alias("out"), F.min("down").alias("entry"), F.min("place").alias("place"), F.count("*").alias("n"),
        *(F.sum(F.when(at, F.col(c)).otherwise(0)).alias(f"{n}_{m}") for n, at, _ in phases() for c, m in (("r", "runs"), ("b", "balls"))))
    person, innings, match = Window.partitionBy(*INN, "name"), Window.partitionBy(*INN), Window.partitionBy("match_id")
    bat, bowl, named = F.col("role") == "bat", F.col("role") == "bowl", F.col("name").isNotNull()
    x = x.withColumn("position", F.dense_rank().over(Window.partitionBy(*INN, "role").orderBy("place")))
    x = x.withColumns({"out_runs": F.coalesce(F.sum(F.when(bat & named, F.col("runs"))).over(person), F.lit(0)), "out_pos": F.coalesce(F.min(F.when(bat & named, F.col("position"))).over(person), F.lit(11))})
    x = x.withColumn("innings_total", F.sum(F.when(bat, F.col("total"))).over(innings))
    sums = {"tr": F.sum(F.when(bat, F.col("total"))), "lb": F.sum(F.when(bowl, F.col("balls")))}
    sums |= {f"{n}_{k}": F.sum(F.when(bowl, F.col(f"{n}_{m}"))) for n, _, _ in phases() for k, m in (("r", "runs"), ("b", "balls"))}
    return x.withColumns({n: c.over(match) for n, c in sums.items()})


def credited(x: DataFrame, formula: str) -> DataFrame:
    """Rows of the dismissed become points of the bowler and of the first fielder; other rows pass."""
    kind, runs, pos = F.col("kind"), F.col("out_runs"), F.col("out_pos")
    if formula == "full":
        quality = F.when((pos >= 8) & (runs < 10), 0.5).when(runs >= 40, 2.5).when(runs >= 25, 1.5).otherwise(1.0) * F.when(pos <= 3, 1.3).otherwise(1.0)
        wicket = 6.0 * quality + F.when(F.col("stand") >= 100, 6.0).when(F.col("stand") >= 50, 3.0).otherwise(0.0)
        catch = F.when(kind == "stumped", 2.0).when(kind == "run out", 3.0).otherwise(2.0) * F.when(runs >= 40, 2.0).when(runs >= 25, 1.5).otherwise(1.0)
    else:
        wicket, catch = F.lit(6.0), F.lit(2.0)
    one = lambda role, player, ident, points: F.struct(F.lit(role).alias("as"), player.alias("player"), ident.cast("string").alias("player_id"), (points * F.col("n")).alias("points"))
    bowled = F.when(kind.isin(*BOWLER_KINDS), one("bowl", F.col("other"), F.col("other_id"), wicket))
    fielded = F.when(F.col("fielder").isNotNull() & kind.isin("caught", "stumped", "run out"), one("field", F.col("fielder"), F.lit(None), catch))
    own = F.struct(F.col("role").alias("as"), F.col("name").alias("player"), F.col("id").alias("player_id"), F.lit(0.0).alias("points"))
    return x.select("*", F.inline(F.when(F.col("role") == "out", F.array_compact(F.array(bowled, fielded))).otherwise(F.array(own))))


def match_context(t: Tables, formula: str) -> DataFrame:
    """Importance of each match, and its innings as an array (a match has a bounded number)."""
    weight = F.coalesce(*(F.when(F.col("event_stage") == k, w) for k, w in STAGE_WEIGHTS.items()), F.lit(1.0))
    runs, wkts = F.coalesce("outcome_by_runs", F.lit(0)), F.coalesce("outcome_by_wickets", F.lit(0))
    level = F.col("outcome_result").isin("tie", "no result") if formula == "full" else F.col("outcome_result") == "tie"
    close = F.when(level, 0.2).when(runs > 0, F.when(runs <= 10, 0.2).when(runs <= 20, 0.1).otherwise(0.0)).when(wkts > 0, F.when(wkts <= 2, 0.2).when(wkts <= 4, 0.1).otherwise(0.0)).otherwise(0.0)
    m = t.matches.select("match_id", "date_start", "outcome_winner", runs.alias("by_runs"), (weight + close).alias("importance"))
    return m.join(t.innings.groupBy("match_id").agg(F.collect_list(F.struct("innings_number", "batting_team", "bowling_team", "is_super_over", "target_runs")).alias("innings")), "match_id", "left")


def with_levels(x: DataFrame, formula: str) -> DataFrame:
    """Scoring level and phase economies of the match."""
    x = x.withColumns({"sr": F.coalesce(_per("tr", "lb", 100.0), F.lit(100.0)), "rr": F.coalesce(F.try_divide(F.col("tr").cast("double"), F.col("lb") / 6.0), F.lit(6.0))})
    for n, _, proxy in phases():
        own = F.greatest(F.coalesce(F.try_divide(F.col(f"{n}_r").cast("double"), F.col(f"{n}_b") / 6.0), F.col("rr")), F.lit(0.5))
        x = x.withColumn(f"{n}_e", own if formula == "full" else F.col("rr") * proxy)
    return x


def batting_value(formula: str) -> Column:
    """Share of the target, pace, situation, lost chases; null where the innings doesn't count."""
    target, total, won = F.col("inn.target_runs"), F.col("innings_total"), F.col("outcome_winner")
    chase = (F.col("innings_number") == 2) & (F.coalesce(target, F.lit(0)) > 0)
    share = F.col("runs") * 100.0 / F.when(chase, F.greatest(total, target)).otherwise(total)
    pace = F.try_divide(_per("runs", "balls", 100.0), F.col("sr"))
    if formula == "full":
        for n, least, bonus in (("death", 4, 1.3), ("pp", 4, 1.1)):
            w = _per(f"{n}_balls", "balls")
            own = F.try_divide(_per(f"{n}_runs", f"{n}_balls", 100.0), F.col("sr"))
            pace = F.when((F.col(f"{n}_balls") >= least) & (F.col(f"{n}_runs") > 0), (1 - w) * pace + w * own * bonus).otherwise(pace)
    pace = F.when((F.col("balls") >= 10) & (F.col("sr") > 0), F.greatest(F.lit(0.5), F.least(F.lit(2.5 if formula == "full" else 2.0), pace))).otherwise(1.0)
    situation = F.least(F.lit(1.5), 1 + 0.1 * F.col("entry")) * F.when((F.col("out") == 0) & (F.col("innings_number") == 1), 0.9).otherwise(1.0)
    gave_up = chase & ~F.coalesce(F.col("inn.batting_team") == won, F.lit(False)) & (F.col("by_runs") > 0)
    chase_factor = F.when(gave_up, F.greatest(F.lit(0.6), 1 - F.col("by_runs") / (2.0 * target))).otherwise(1.0)
    return F.when(~F.col("inn.is_super_over") & (total > 0), rounded(share * pace * situation * 1.5 * chase_factor, 6))


def bowling_value(formula: str) -> Column:
    """Wicket values and economy against the match; null without the innings."""
    econ = F.lit(0.0)
    for n, _, _ in phases():
        o = F.col(f"{n}_balls") / 6.0
        econ = econ + F.when(F.col(f"{n}_balls") >= 6, F.col(f"{n}_e") / F.greatest(F.try_divide(F.col(f"{n}_runs").cast("double"), o), F.lit(0.5)) * o * 2.0).otherwise(0.0)
    total = F.col("points") + F.when(F.col("balls") >= 12, econ).otherwise(0.0)
    if formula == "full":
        held = (F.col("innings_number") == 2) & (F.col("inn.bowling_team") == F.col("outcome_winner")) & (F.col("by_runs") > 0)
        total = total * F.when(held, 1 + F.greatest(F.lit(0.0), 1 - F.col("by_runs") / 25.0)).otherwise(1.0)
    return F.when(F.col("inn").isNotNull(), rounded(total, 6))


def scored(t: Tables, asked: DataFrame | None, formula: str, player: str | None, filters: dict) -> DataFrame:
    """One row per match and player. ``asked``: match_id and an array of (player, player_id), to score these only."""
    keep = asked if asked is not None else t.matches.filter(match_filter(**filters)).select("match_id", F.lit(None).cast("array<struct<player:string,player_id:string>>").alias("asked"))
    x = credited(players_of_innings(t.deliveries.join(keep, "match_id")), formula)
    if player:
        x = x.filter(like("player", player))
    if asked is not None:
        x = x.filter(F.exists("asked", lambda p: p["player"] == F.col("player")))
    measures = [F.sum(F.when(F.col("role") == F.col("as"), F.col(c)).otherwise(0)).alias(c) for c in ("runs", "balls", *(f"{n}_{m}" for n, _, _ in phases() for m in ("runs", "balls")))]
    same = ["tr", "lb", "innings_total", *(f"{n}_{k}" for n, _, _ in phases() for k in "rb")]
    x = x.groupBy(*INN, "asked", "as", "player", "player_id").agg(*measures, F.sum("points").alias("points"), F.max("out").alias("out"), F.min("entry").alias("entry"), *(F.first(c).alias(c) for c in same))
    x = with_levels(x.join(match_context(t, formula), "match_id"), formula)
    x = x.withColumn("inn", F.try_element_at(F.filter("innings", lambda i: i["innings_number"] == F.col("innings_number")), F.lit(1)))
    value = F.when(F.col("as") == "bat", batting_value(formula)).when(F.col("as") == "bowl", bowling_value(formula)).otherwise(F.col("points"))
    x = x.withColumn("value", value).filter("value IS NOT NULL").select("match_id", "date_start", "importance", "asked", "player", "player_id", "as", "value")
    names = t.players.groupBy(F.col("player_name").alias("player")).agg(F.min("player_id").alias("known_id"))
    x = x.join(names, "player", "left").withColumn("player_id", F.when(F.col("as") == "field", F.col("known_id")).otherwise(F.col("player_id")))  # fielders have names only
    kinds = {"bat": "batting", "bowl": "bowling", "field": "fielding"}
    x = x.groupBy("match_id", "asked", "player", "player_id").agg(*(rounded(F.sum(F.when(F.col("as") == k, F.col("value")).otherwise(0.0)), 6).alias(v) for k, v in kinds.items()), *(F.first(c).alias(c) for c in ("date_start", "importance")))
    if asked is not None:
        x = x.filter(F.exists("asked", lambda p: (p["player"] == F.col("player")) & p["player_id"].eqNullSafe(F.col("player_id"))))
    total = rounded((F.col("batting") + F.col("bowling") + F.col("fielding")) * F.col("importance"), 6)
    return x.select("match_id", "date_start", "player", "player_id", *(half_up(F.col(k)).alias(f"{k}_impact") for k in kinds.values()), half_up(F.col("importance")).alias("importance"), half_up(total).alias("total_impact"))


def match_impact(t: Tables, match_id: str | None = None, player: str | None = None, formula: str = "full", **f) -> DataFrame:
    """One row per match and player, of one match or of all that pass the filters."""
    if match_id:
        one = F.col("match_id") == match_id
        t = Tables(t.players, t.matches.filter(one), t.innings.filter(one), t.deliveries.filter(one))
    return scored(t, None, formula, player, f)


def career_impact_matches(t: Tables, player: str, limit: int = 50, **f) -> DataFrame:
    """The latest ``limit`` matches in which each matching player batted or bowled (B8), by the simple formula.

    The matches are picked first, so only their deliveries are scored; a fielder's points count in picked matches only.
    """
    played = took_part(t.deliveries, player).join(t.matches.filter(match_filter(**f)).select("match_id", "date_start"), "match_id")
    latest = Window.partitionBy("player", "player_id").orderBy(F.desc_nulls_last("date_start"), F.asc("match_id"))
    picked = played.withColumn("n", F.row_number().over(latest)).filter(F.col("n") <= limit)
    return scored(t, picked.groupBy("match_id").agg(F.collect_list(F.struct("player", "player_id")).alias("asked")), "simple", None, {})


def career_impact(t: Tables, player: str, limit: int = 50, **f) -> DataFrame:
    """Average, total and peak of the per-match values, one row per (name, id), for every matching player; ``limit`` counts matches."""
    x = career_impact_matches(t, player, limit, **f).groupBy("player", "player_id").agg(
        F.count("*").alias("matches"), half_up(rounded(F.avg("total_impact"), 6)).alias("average_impact"), half_up(rounded(F.sum("total_impact"), 6)).alias("career_impact"), F.max("total_impact").alias("peak_impact"),
        *(half_up(rounded(F.avg(f"{k}_impact"), 6)).alias(f"average_{k}") for k in ("batting", "bowling", "fielding")))
    return x.orderBy(down("average_impact"), up("player"), up("player_id"))
