"""Match, team, venue and tournament operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.filters import match_filter
from ..functions.measures import ratio, rounded
from ..plans.fixture import Tables
from ..plans.grains import down, innings_totals, team_matches, top, up
from .streaks import streaks

MATCH_COLUMNS = ["match_id", "match_type", "gender", "season", "date_start", "team1", "team2", "venue", "city", "toss_winner", "toss_decision", "outcome_winner",
                 "outcome_by_runs", "outcome_by_wickets", "outcome_result", "player_of_match", "event_name", "event_stage"]


def won() -> Column:
    return F.col("outcome_winner") == F.col("team")


def drawn() -> Column:
    return F.col("outcome_result") == "draw"


def tied() -> Column:
    return F.col("outcome_result") == "tie"


def no_result() -> Column:
    return F.col("outcome_result") == "no result"


def lost() -> Column:
    return F.col("outcome_winner").isNotNull() & (F.col("outcome_winner") != F.col("team"))


def search_matches(t: Tables, limit: int = 20, offset: int = 0, **f) -> DataFrame:
    """Newest first, paged."""
    return t.matches.filter(match_filter(**f)).select(*MATCH_COLUMNS).orderBy(down("date_start"), up("match_id")).offset(offset).limit(limit)


def head_to_head(t: Tables, team1: str, team2: str, **f) -> DataFrame:
    """One row, zeros where the sides never met."""
    m = t.matches.filter(match_filter(team=team1, opposition=team2, **f))
    return m.agg(F.count("*").alias("total_matches"), F.count_if(F.col("outcome_winner") == team1).alias("team1_wins"), F.count_if(F.col("outcome_winner") == team2).alias("team2_wins"),
                 F.count_if(drawn()).alias("draws"), F.count_if(tied()).alias("ties"), F.count_if(no_result()).alias("no_results"))


def venue_stats(t: Tables, limit: int = 10, **f) -> DataFrame:
    """Busiest first; matches without a venue are left out."""
    m = t.matches.filter(match_filter(**f) & F.col("venue").isNotNull())
    i = innings_totals(t).select("match_id", "innings_number", "batting_team", "total")
    x = m.select("match_id", "venue", "outcome_winner").join(i, "match_id")
    first = F.col("innings_number") == 1
    second = F.col("innings_number") == 2
    won = first & (F.col("outcome_winner") == F.col("batting_team"))
    of = lambda where: (F.sum(F.when(where, F.col("total"))), F.count(F.when(where, F.col("total"))))
    # by match first, which needs no exchange, so that matches are counted as rows
    per = x.groupBy("match_id", "venue").agg(
        *(c.alias(n) for n, c in zip(("sum1", "n1", "sum2", "n2"), (*of(first), *of(second)), strict=True)), F.max("total").alias("high"), F.min("total").alias("low"), F.max(won).alias("won"))
    mean = lambda k: rounded(F.try_divide(F.sum(f"sum{k}").cast("double"), F.sum(f"n{k}").cast("double")), 1)
    table = per.groupBy("venue").agg(
        F.count("*").alias("matches"), mean(1).alias("avg_first_innings"), mean(2).alias("avg_second_innings"), F.max("high").alias("highest_total"), F.min("low").alias("lowest_total"),
        F.count_if("won").alias("bat_first_wins"))
    table = table.withColumn("bat_first_win_pct", ratio("bat_first_wins", "matches", 100.0, 1))
    return top(table, limit, down("matches"), up("venue"))


def toss_analysis(t: Tables, group_by: str | None = None, limit: int = 10, **f) -> DataFrame:
    """Decided matches only; by venue, team (the toss winner), match_type or season, or all together."""
    m = t.matches.filter(match_filter(**f) & F.col("outcome_winner").isNotNull() & F.col("toss_winner").isNotNull())
    hit, bat = F.col("toss_winner") == F.col("outcome_winner"), F.col("toss_decision") == "bat"
    first = F.when(bat, F.col("toss_winner")).otherwise(F.when(F.col("toss_winner") == F.col("team1"), F.col("team2")).otherwise(F.col("team1")))
    measures = [F.count("*").alias("total_matches"), F.count_if(hit).alias("toss_winner_won"), F.count_if(bat).alias("chose_bat"), F.count_if(~bat).alias("chose_field"),
                F.count_if(hit & bat).alias("bat_wins"), F.count_if(hit & ~bat).alias("field_wins"), F.count_if(first == F.col("outcome_winner")).alias("bat_first_won")]
    key = {"team": "toss_winner"}.get(group_by, group_by)
    sums = (m.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("group_value")) if key else m.groupBy()).agg(*measures)
    table = sums.select(
        *(["group_value"] if key else []), "total_matches", "toss_winner_won", ratio("toss_winner_won", "total_matches", 100.0, 1).alias("toss_win_pct"), "chose_bat", "chose_field",
        ratio("bat_wins", "chose_bat", 100.0, 1).alias("bat_choice_win_pct"), ratio("field_wins", "chose_field", 100.0, 1).alias("field_choice_win_pct"),
        "bat_first_won", ratio("bat_first_won", "total_matches", 100.0, 1).alias("bat_first_win_pct"))
    return top(table, limit, down("total_matches"), up("group_value")) if key else table


def _last_matches(t: Tables, team: str, last_n: int, **f) -> DataFrame:
    code = F.when(won(), "W").when(drawn(), "D").when(tied(), "T").when(no_result(), "NR").when(lost(), "L").otherwise("NR")
    mine = team_matches(t, team=team, **f).filter(F.col("team") == team)
    rows = mine.select("match_id", "date_start", "match_type", "venue", F.when(F.col("team1") == team, F.col("team2")).otherwise(F.col("team1")).alias("opponent"), code.alias("result"))
    return top(rows, last_n, down("date_start"), up("match_id"))


def team_form_results(t: Tables, team: str, last_n: int = 10, **f) -> DataFrame:
    """W, D, T, NR or L; a match with neither winner nor result is NR."""
    return _last_matches(t, team, last_n, **f)


def team_form_summary(t: Tables, team: str, last_n: int = 10, **f) -> DataFrame:
    """One row over the last matches (at most last_n, so one small partition); streak like 'W x 3'."""
    last = _last_matches(t, team, last_n, **f)
    order = [F.desc("date_start"), F.asc("match_id")]
    runs = last.withColumn("gap", F.row_number().over(Window.partitionBy().orderBy(*order)) - F.row_number().over(Window.partitionBy("result").orderBy(*order)))
    codes = (("W", "wins"), ("L", "losses"), ("D", "draws"), ("T", "ties"), ("NR", "no_results"))
    counts = runs.agg(*(F.count_if(F.col("result") == c).alias(n) for c, n in codes), F.max(F.when(F.col("gap") == 0, F.col("result"))).alias("code"), F.count_if(F.col("gap") == 0).alias("length"))
    own = innings_totals(t).filter(F.col("batting_team") == team).join(last.select("match_id"), "match_id", "left_semi")
    scores = own.agg(rounded(F.avg("total"), 1).alias("avg_score"), F.max("total").alias("highest_score"), F.min("total").alias("lowest_score"),
                     rounded(F.avg(F.try_divide(F.col("total").cast("double"), F.col("balls").cast("double") / 6.0))).alias("avg_run_rate"))
    return counts.crossJoin(scores).select(  # one row each
        "wins", "losses", "draws", "ties", "no_results", ratio(F.col("wins"), F.col("wins") + F.col("losses"), 100.0, 1).alias("win_pct"),
        "avg_score", "highest_score", "lowest_score", "avg_run_rate", F.concat("code", F.lit(" x "), F.col("length").cast("string")).alias("streak"))


def tournament_standings(t: Tables, event: str, limit: int = 10, **f) -> DataFrame:
    """Lost means another winner and no special result."""
    x = team_matches(t, event_name=event, **f).groupBy("team").agg(
        F.count("*").alias("played"), F.count_if(won()).alias("won"), F.count_if(lost() & F.col("outcome_result").isNull()).alias("lost"), F.count_if(drawn()).alias("drawn"),
        F.count_if(tied()).alias("tied"), F.count_if(no_result()).alias("no_results"))
    x = x.withColumn("win_pct", ratio(F.col("won"), F.col("won") + F.col("lost"), 100.0, 1))
    return top(x, limit, down("won"), down("win_pct"), up("team"))


def tournament_meta(t: Tables, event: str, **f) -> DataFrame:
    """D23."""
    return t.matches.filter(match_filter(event_name=event, **f)).agg(
        F.count("*").alias("matches"), F.min("date_start").alias("first_match"), F.max("date_start").alias("last_match"), F.countDistinct("season").alias("seasons"))


CONTEXT = ["match_id", "match_type", "date_start", "venue", "event_name"]


def team_totals(t: Tables, record_type: str = "highest_total", limit: int = 10, **f) -> DataFrame:
    """Super overs are left out; lowest totals need ten wickets."""
    i = innings_totals(t, super_overs=False)
    i = i if record_type == "highest_total" else i.filter("wickets >= 10")
    x = i.join(t.matches.filter(match_filter(**f)).select(*CONTEXT), "match_id").select("match_id", "innings_number", F.col("batting_team").alias("team"), F.col("bowling_team").alias("opposition"), "total", "wickets", "match_type", "date_start", "venue")
    return top(x, limit, (down if record_type == "highest_total" else up)("total"), up("match_id"), up("innings_number"))


def win_margins(t: Tables, size: str = "biggest", by: str = "runs", limit: int = 10, **f) -> DataFrame:
    """By wickets, the balls that were left in innings 2 break ties (none for Tests and multi-day matches)."""
    order = down if size == "biggest" else up
    m = t.matches.filter(match_filter(**f))
    column = f"outcome_by_{by}"
    m = m.filter(F.col(column) > 0).select("match_id", F.col("outcome_winner").alias("winner"), "team1", "team2", F.col(column).alias("margin"), "match_type", "date_start", "overs_per_side")
    if by == "runs":
        return top(m.drop("overs_per_side"), limit, order("margin"), up("match_id"))
    second = innings_totals(t, super_overs=False).filter("innings_number = 2").select("match_id", F.col("balls").alias("used"))
    left = F.when(F.col("match_type").isin("Test", "MDM"), None).otherwise((F.col("overs_per_side") * 6 - F.col("used")).cast("bigint"))
    x = m.join(second, "match_id", "left").withColumn("balls_remaining", left).drop("overs_per_side", "used")
    return top(x, limit, order("margin"), order("balls_remaining"), up("match_id"))


def highest_chase(t: Tables, limit: int = 10, **f) -> DataFrame:
    """The winner's innings that is also the match's last of all innings."""
    i = innings_totals(t).withColumn("last", F.max("innings_number").over(Window.partitionBy("match_id")))
    m = t.matches.filter(match_filter(**f)).select(*CONTEXT, "outcome_winner")
    x = i.filter((F.col("innings_number") == F.col("last")) & ~F.col("is_super_over")).join(m, "match_id").filter(F.col("outcome_winner") == F.col("batting_team"))
    x = x.select("match_id", "innings_number", F.col("batting_team").alias("team"), F.col("bowling_team").alias("opposition"), "total", "wickets", "match_type", "date_start", "venue")
    return top(x, limit, down("total"), up("match_id"), up("innings_number"))


def tied_matches(t: Tables, limit: int = 10, **f) -> DataFrame:
    """D51."""
    x = t.matches.filter(match_filter(**f) & tied()).select("match_id", "match_type", "date_start", "team1", "team2", "venue", "event_name", "outcome_winner")
    return top(x, limit, down("date_start"), up("match_id"))


def super_over_scores(t: Tables, **f) -> DataFrame:
    """D53, flat: one row per super-over innings."""
    m = t.matches.filter(match_filter(**f)).select("match_id", "date_start", "team1", "team2", "outcome_winner")
    return innings_totals(t).filter("is_super_over").join(m, "match_id").select("match_id", "date_start", "innings_number", "batting_team", F.col("total").alias("runs"), "wickets")


def super_over_matches(t: Tables, limit: int = 20, **f) -> DataFrame:
    """One row per match with its super overs in order, newest first, and the number of all of them."""
    x = super_over_scores(t, **f).groupBy("match_id", "date_start").agg(F.sort_array(F.collect_list(F.struct("innings_number", "batting_team", "runs", "wickets"))).alias("super_overs"))
    x = x.crossJoin(x.agg(F.count("*").alias("total_count")))  # one row
    x = x.withColumn("scores", F.array_join(F.transform("super_overs", lambda s: F.concat(s.innings_number.cast("string"), F.lit(" "), s.batting_team, F.lit(" "), s.runs.cast("string"), F.lit("/"), s.wickets.cast("string"))), "; "))
    return top(x.select("match_id", "date_start", "scores", "total_count"), limit, down("date_start"), up("match_id"))


def super_over_records(t: Tables, **f) -> DataFrame:
    """By team, over super-over matches with a winner."""
    m = t.matches.filter(match_filter(**f) & F.col("outcome_winner").isNotNull()).join(t.innings.filter("is_super_over").select("match_id").distinct(), "match_id", "left_semi")
    x = m.withColumn("team", F.explode(F.array("team1", "team2"))).groupBy("team").agg(F.count_if(won()).alias("won"), F.count_if(~won()).alias("lost"), F.count("*").alias("played"))
    return x.orderBy(down("won"), up("lost"), up("team"))


def team_streaks(t: Tables, kind: str = "wins", team: str | None = None, min_length: int = 2, limit: int = 10, **f) -> DataFrame:
    """Matches with neither winner, draw nor tie are skipped; draws and ties end a streak."""
    x = team_matches(t, **f).filter(F.col("outcome_winner").isNotNull() | F.col("outcome_result").isin("draw", "tie"))
    if team:
        x = x.filter(F.col("team").ilike(f"%{team}%"))
    table = streaks(x, ["team"], won() if kind == "wins" else lost(), ["date_start", "match_id"]).filter(F.col("length") >= min_length)
    return top(table, limit, down("length"), down("end_date"), up("team"))
