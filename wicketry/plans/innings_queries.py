"""Registered innings queries: name -> (operator call, SQL)."""

from ..operators import innings as i
from .oracle import BK, BW, CONCEDED, FOUR, LEGAL, OUT, SIX, WK, balls, bat, bowl, eco, has, n, ordered, overs, q, r, rat, s

AT = "over_number * 1000 + ball_number"
W = "match_id, innings_number"
MAIN = "mi AS (SELECT match_id, innings_number, batting_team AS team, bowling_team AS opposition FROM innings WHERE NOT is_super_over)"
P = "00000004"
HOW = f"count(*) FILTER (WHERE {OUT}) AS o, arg_max(coalesce(wicket_kind, ''), CASE WHEN {OUT} THEN {AT} END) AS kind, arg_max(coalesce(wicket_fielder1, ''), CASE WHEN {OUT} THEN {AT} END) AS f, arg_max(bowler, CASE WHEN {OUT} THEN {AT} END) AS wb"
ISLAND = "row_number() OVER (PARTITION BY batter, batter_id ORDER BY date_start, match_id, innings_number) - row_number() OVER (PARTITION BY batter, batter_id, hit ORDER BY date_start, match_id, innings_number) AS i"


def _streak(hit: str, length: int) -> str:
    return q(balls(), bat("date_start"), f"h AS (SELECT *, {hit} AS hit FROM bi)", f"g AS (SELECT *, {ISLAND} FROM h)",
             f"SELECT {BK}, count(*) AS length, {s('runs')} AS runs, max(runs) AS highest_score, min(date_start) AS start_date, max(date_start) AS end_date FROM g WHERE hit GROUP BY {BK}, i HAVING count(*) >= {length}" + ordered(f"{BK}, start_date", "length DESC, runs DESC", 10))


def _form_bat() -> list[str]:
    return [balls(has("batter", P)), bat("date_start, match_type"), f"hw AS (SELECT {W}, batter_id, {HOW} FROM b GROUP BY ALL)",
            f"fb AS (SELECT batter, batter_id, {W}, date_start, match_type, bowling_team AS opposition, runs, balls, fours, sixes, {rat('runs', 'balls', 100.0)} AS strike_rate, CASE WHEN o > 0 THEN kind END AS dismissal, CASE WHEN o > 0 THEN wb END AS bowler, was_out AS out "
            f"FROM bi JOIN hw USING ({W}, batter_id) JOIN innings USING ({W}) ORDER BY date_start DESC, match_id DESC, innings_number DESC, batter_id LIMIT 10)"]


def _form_bowl() -> list[str]:
    return [balls(has("bowler", P)), bowl("date_start, match_type"),
            f"fw AS (SELECT bowler, bowler_id, {W}, date_start, match_type, batting_team AS opposition, {overs('balls')} AS overs, balls, conceded AS runs_conceded, wickets, bat_dots AS dots, {eco('conceded', 'balls')} AS economy, "
            f"concat(CAST(wickets AS VARCHAR), '/', CAST(conceded AS VARCHAR)) AS figures FROM wi JOIN innings USING ({W}) ORDER BY date_start DESC, match_id DESC, innings_number DESC, bowler_id LIMIT 10)"]


def build() -> dict:
    stand = f"st AS (SELECT {W}, least(batter, non_striker) AS player_a, greatest(batter, non_striker) AS player_b, match_type, date_start, venue, {s('runs_total')} AS partnership_runs, {n('extras_wides = 0')} AS balls FROM b GROUP BY ALL)"
    rec = f"SELECT batter, batter_id, {W}, runs, balls, {rat('runs', 'balls', 100.0)} AS strike_rate, fours, sixes, was_out = 0 AS not_out, team, opposition, match_type, date_start, venue FROM bi JOIN mi USING ({W})"
    fast = (f"f AS (SELECT *, sum(runs_batter) OVER w AS cr, sum(CASE WHEN extras_wides = 0 THEN 1 ELSE 0 END) OVER w AS cb FROM b JOIN mi USING ({W}) WINDOW w AS (PARTITION BY {W}, {BK} ORDER BY over_number, ball_number ROWS UNBOUNDED PRECEDING))")
    out = {
        "scorecard_batting": (lambda t: i.scorecard_batting(t), q(
            f"c AS (SELECT {W}, {BK}, min({AT}) AS first, {s('runs_batter')} AS runs, {n('extras_wides = 0')} AS balls, {n(FOUR)} AS fours, {n(SIX)} AS sixes, {HOW} FROM deliveries GROUP BY {W}, {BK})",
            f"SELECT {W}, CAST(row_number() OVER (PARTITION BY {W} ORDER BY first, batter_id) AS INT) AS position, {BK}, runs, balls, fours, sixes, CASE WHEN balls = 0 THEN 0.0::DOUBLE ELSE {rat('runs', 'balls', 100.0)} END AS strike_rate, "
            "CASE WHEN o > 0 THEN kind END AS dismissal, CASE WHEN o > 0 THEN nullif(f, '') END AS fielder, CASE WHEN o > 0 THEN wb END AS bowler FROM c")),
        "scorecard_bowling": (lambda t: i.scorecard_bowling(t), q(
            f"ov AS (SELECT {W}, {WK}, over_number, sum({CONCEDED}) AS c, {n(LEGAL)} AS l, {n(BW)} AS w, sum(extras_wides) AS wd, sum(extras_noballs) AS nb FROM deliveries GROUP BY {W}, {WK}, over_number)",
            f"c AS (SELECT {W}, {WK}, min(over_number) AS first, {s('l')} AS balls, {s('c')} AS runs_conceded, {s('w')} AS wickets, {n('c = 0 AND l >= 6')} AS maidens, {s('wd')} AS wides, {s('nb')} AS noballs FROM ov GROUP BY {W}, {WK})",
            f"SELECT {W}, CAST(row_number() OVER (PARTITION BY {W} ORDER BY first, bowler_id) AS INT) AS position, {WK}, {overs('balls')} AS overs, maidens, runs_conceded, wickets, {eco('runs_conceded', 'balls')} AS economy, wides, noballs FROM c")),
        "scorecard_totals": (lambda t: i.scorecard_totals(t), q(
            f"c AS (SELECT {W}, {s('runs_total')} AS total, {n('is_wicket')} AS wickets, {s('runs_extras')} AS extras, " + ", ".join(f"{s('extras_' + x)} AS {x}" for x in ("wides", "noballs", "byes", "legbyes", "penalty")) + f", {n(LEGAL)} AS l FROM deliveries GROUP BY {W})",
            f"SELECT {W}, batting_team, total, wickets, extras, wides, noballs, byes, legbyes, penalty, {overs('l')} AS overs FROM innings JOIN c USING ({W})")),
        "innings_progression": (lambda t: i.innings_progression(t, "7", 1), q(
            f"o AS (SELECT over_number, {s('runs_total')} AS runs, {n('is_wicket')} AS wickets, {n(LEGAL)} AS l, string_agg(wicket_player_out, ', ' ORDER BY ball_number) FILTER (WHERE is_wicket) AS dismissed FROM deliveries WHERE match_id = '7' AND innings_number = 1 GROUP BY over_number)",
            "p AS (SELECT *, CAST(sum(runs) OVER w AS BIGINT) AS cumulative_runs, CAST(sum(wickets) OVER w AS BIGINT) AS cumulative_wickets, sum(l) OVER w AS cl FROM o WINDOW w AS (ORDER BY over_number ROWS UNBOUNDED PRECEDING))",
            f"SELECT over_number, runs, cumulative_runs, wickets, cumulative_wickets, {eco('runs', 'l')} AS run_rate, {eco('cumulative_runs', 'cl')} AS cumulative_run_rate, dismissed FROM p")),
        "innings_highest_score": (lambda t: i.innings_records(t, "highest_score"), q(balls(), bat("match_type, date_start, venue"), MAIN, rec + ordered(f"{W}, batter_id", "runs DESC, balls", 10))),
        "innings_most_sixes": (lambda t: i.innings_records(t, "most_sixes"), q(balls(), bat("match_type, date_start, venue"), MAIN, rec + ordered(f"{W}, batter_id", "sixes DESC, runs DESC", 10))),
        "innings_most_fours": (lambda t: i.innings_records(t, "most_fours"), q(balls(), bat("match_type, date_start, venue"), MAIN, rec + ordered(f"{W}, batter_id", "fours DESC, runs DESC", 10))),
        "best_bowling_figures": (lambda t: i.best_bowling_figures(t), q(
            balls(), bowl("match_type, date_start, venue"), MAIN, f"SELECT {WK}, {W}, concat(CAST(wickets AS VARCHAR), '/', CAST(conceded AS VARCHAR)) AS figures, wickets, conceded AS runs_conceded, {overs('balls')} AS overs, {eco('conceded', 'balls')} AS economy, opposition AS team, team AS against, match_type, date_start, venue FROM wi JOIN mi USING ({W})" + ordered(f"{W}, bowler_id", "wickets DESC, runs_conceded", 10))),
        "most_runs_in_over": (lambda t: i.over_records(t, "batting"), q(balls(), MAIN, f"SELECT {BK}, {W}, over_number, match_type, date_start, {s('runs_batter')} AS runs, {n(SIX)} AS sixes, {n(FOUR)} AS fours, team, opposition FROM b JOIN mi USING ({W}) GROUP BY ALL" + ordered(f"{W}, over_number, batter_id", "runs DESC, sixes DESC", 10))),
        "most_expensive_over": (lambda t: i.over_records(t, "bowling"), q(balls(), MAIN, f"SELECT {WK}, {W}, over_number, match_type, date_start, {s(CONCEDED)} AS runs, {n(SIX)} AS sixes, {n(FOUR)} AS fours, team, opposition FROM b JOIN mi USING ({W}) GROUP BY ALL" + ordered(f"{W}, over_number, bowler_id", "runs DESC, sixes DESC", 10))),
        "partnerships": (lambda t: i.partnerships(t), q(balls(), stand, "SELECT * FROM st WHERE partnership_runs >= 50" + ordered(f"player_a, player_b, {W}", "partnership_runs DESC", 10))),
        "partnership_pairs": (lambda t: i.partnership_pairs(t, player=P), q(balls(f"({has('batter', P)} OR {has('non_striker', P)})"), stand, f"SELECT player_a, player_b, count(*) AS stands, {s('partnership_runs')} AS total_runs, {r('avg(CAST(partnership_runs AS DOUBLE))')} AS average, max(partnership_runs) AS highest, "
            f"{n('partnership_runs >= 50')} AS fifty_plus, {n('partnership_runs >= 100')} AS hundred_plus FROM st GROUP BY player_a, player_b" + ordered("player_a, player_b", "total_runs DESC", 10))),
        "streak_fifty_plus": (lambda t: i.batter_streaks(t, "fifty_plus"), _streak("runs >= 50", 2)),
        "streak_ducks": (lambda t: i.batter_streaks(t, "ducks", min_length=1), _streak("runs = 0 AND was_out = 1", 1)),
        "form_batting": (lambda t: i.form_batting(t, P), q(*_form_bat(), "SELECT * FROM fb")),
        "form_batting_summary": (lambda t: i.form_batting_summary(t, P), q(*_form_bat(), f"SELECT count(*) AS innings, {s('runs')} AS runs, {s('out')} AS dismissals, {rat('sum(runs)', 'sum(out)')} AS average, {rat('sum(runs)', 'sum(balls)', 100.0)} AS strike_rate, max(runs) AS highest, min(runs) AS lowest FROM fb")),
        "form_bowling": (lambda t: i.form_bowling(t, P), q(*_form_bowl(), "SELECT * FROM fw")),
        "form_bowling_summary": (lambda t: i.form_bowling_summary(t, P), q(*_form_bowl(), f"SELECT count(*) AS innings, {overs(s('balls'))} AS overs, {s('runs_conceded')} AS runs_conceded, {s('wickets')} AS wickets, {rat('sum(runs_conceded)', 'sum(wickets)')} AS average, {eco('sum(runs_conceded)', 'sum(balls)')} AS economy, "
            "arg_max(figures, wickets * 1000000 - runs_conceded) AS best_figures FROM fw")),
    }
    for name, x in (("fastest_fifty", 50), ("fastest_hundred", 100)):
        out[name] = (lambda t, x=x: i.fastest(t, x), q(balls(), MAIN, fast, f"SELECT {W}, {BK}, team, opposition, match_type, date_start, CAST(min(cb) FILTER (WHERE cr >= {x}) AS BIGINT) AS balls_to_reach, {s('runs_batter')} AS final_runs, {n('extras_wides = 0')} AS final_balls FROM f GROUP BY ALL HAVING min(cb) FILTER (WHERE cr >= {x}) IS NOT NULL" + ordered(f"{W}, batter_id", "balls_to_reach, final_runs DESC", 10)))
    return out
