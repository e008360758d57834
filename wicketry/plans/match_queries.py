"""Registered match and team queries: name -> (operator call, SQL)."""

from ..operators import matches as m
from .oracle import LEGAL, flt, n, ordered, q, r, rat

TOT = f"tt AS (SELECT match_id, innings_number, CAST(sum(runs_total) AS BIGINT) AS total, {n('is_wicket')} AS wickets, {n(LEGAL)} AS balls FROM deliveries GROUP BY ALL), it AS (SELECT * FROM innings JOIN tt USING (match_id, innings_number))"
TEAMS = "tm AS (SELECT *, unnest([team1, team2]) AS team FROM matches WHERE {w})"
CODE = "CASE WHEN outcome_winner = team THEN 'W' WHEN outcome_result = 'draw' THEN 'D' WHEN outcome_result = 'tie' THEN 'T' WHEN outcome_result = 'no result' THEN 'NR' WHEN outcome_winner <> team THEN 'L' ELSE 'NR' END"
LAST = "lm AS (SELECT match_id, date_start, match_type, venue, CASE WHEN team1 = 'NATION_3' THEN team2 ELSE team1 END AS opponent, " + CODE + " AS result FROM tm WHERE team = 'NATION_3' ORDER BY date_start DESC, match_id LIMIT 10)"


def _toss(key: str | None) -> str:
    hit, bat = "toss_winner = outcome_winner", "toss_decision = 'bat'"
    first = "CASE WHEN toss_decision = 'bat' THEN toss_winner WHEN toss_winner = team1 THEN team2 ELSE team1 END"
    g = f"{key} AS group_value, " if key else ""
    inner = (f"x AS (SELECT {g}count(*) AS total_matches, {n(hit)} AS toss_winner_won, {n(bat)} AS chose_bat, {n(f'NOT {bat}')} AS chose_field, {n(f'{hit} AND {bat}')} AS bw, {n(f'{hit} AND NOT {bat}')} AS fw, "
             f"{n(f'{first} = outcome_winner')} AS bat_first_won FROM matches WHERE outcome_winner IS NOT NULL AND toss_winner IS NOT NULL" + (f" AND {key} IS NOT NULL GROUP BY {key}" if key else "") + ")")
    return q(inner, f"SELECT {'group_value, ' if key else ''}total_matches, toss_winner_won, {rat('toss_winner_won', 'total_matches', 100.0, 1)} AS toss_win_pct, chose_bat, chose_field, {rat('bw', 'chose_bat', 100.0, 1)} AS bat_choice_win_pct, "
             f"{rat('fw', 'chose_field', 100.0, 1)} AS field_choice_win_pct, bat_first_won, {rat('bat_first_won', 'total_matches', 100.0, 1)} AS bat_first_win_pct FROM x" + (ordered("group_value", "total_matches DESC", 10) if key else ""))


def _margin(size: str, by: str) -> str:
    d = " DESC" if size == "biggest" else ""
    c = f"outcome_by_{by}"
    base = f"SELECT match_id, outcome_winner AS winner, team1, team2, {c} AS margin, match_type, date_start"
    if by == "runs":
        return q(f"{base} FROM matches WHERE {c} > 0 ORDER BY margin{d}, match_id LIMIT 10")
    return q(TOT, f"{base}, CASE WHEN match_type IN ('Test', 'MDM') THEN NULL ELSE CAST(overs_per_side * 6 - u.balls AS BIGINT) END AS balls_remaining FROM matches LEFT JOIN (SELECT match_id, balls FROM it WHERE innings_number = 2 AND NOT is_super_over) u USING (match_id) "
             f"WHERE {c} > 0 ORDER BY margin{d}, balls_remaining{d} NULLS LAST, match_id LIMIT 10")


def _streak(kind: str) -> str:
    hit = "outcome_winner = team" if kind == "wins" else "outcome_winner <> team"
    return q(TEAMS.format(w="(outcome_winner IS NOT NULL OR outcome_result IN ('draw', 'tie'))"), f"h AS (SELECT *, coalesce({hit}, false) AS hit FROM tm)",
             "g AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY date_start, match_id) - row_number() OVER (PARTITION BY team, hit ORDER BY date_start, match_id) AS i FROM h)",
             "SELECT team, count(*) AS length, min(date_start) AS start_date, max(date_start) AS end_date FROM g WHERE hit GROUP BY team, i HAVING count(*) >= 2 ORDER BY length DESC, end_date DESC, team LIMIT 10")


def build() -> dict:
    total = "SELECT match_id, innings_number, batting_team AS team, bowling_team AS opposition, total, wickets, match_type, date_start, venue FROM it JOIN matches USING (match_id) WHERE NOT is_super_over"
    out = {
        "search_matches": (lambda t: m.search_matches(t, match_type="T20", offset=5), q(f"SELECT {', '.join(m.MATCH_COLUMNS)} FROM matches WHERE match_type = 'T20' ORDER BY date_start DESC, match_id LIMIT 20 OFFSET 5")),
        "head_to_head": (lambda t: m.head_to_head(t, "NATION_3", "NATION_4"), q(
            f"SELECT count(*) AS total_matches, {n(chr(39).join(['outcome_winner = ', 'NATION_3', '']))} AS team1_wins, {n(chr(39).join(['outcome_winner = ', 'NATION_4', '']))} AS team2_wins, "
            f"count(*) FILTER (WHERE outcome_result = 'draw') AS draws, count(*) FILTER (WHERE outcome_result = 'tie') AS ties, count(*) FILTER (WHERE outcome_result = 'no result') AS no_results FROM matches WHERE {flt(team='NATION_3', opposition='NATION_4')}")),
        "venue_stats": (lambda t: m.venue_stats(t), q(TOT, "x AS (SELECT m.venue, m.outcome_winner, it.* FROM it JOIN matches m USING (match_id) WHERE venue IS NOT NULL)",
            "y AS (SELECT venue, count(DISTINCT match_id) AS matches, avg(CAST(total AS DOUBLE)) FILTER (WHERE innings_number = 1) AS a1, avg(CAST(total AS DOUBLE)) FILTER (WHERE innings_number = 2) AS a2, max(total) AS highest_total, min(total) AS lowest_total, "
            "count(DISTINCT match_id) FILTER (WHERE innings_number = 1 AND outcome_winner = batting_team) AS bat_first_wins FROM x GROUP BY venue)",
            f"SELECT venue, matches, {r('a1', 1)} AS avg_first_innings, {r('a2', 1)} AS avg_second_innings, highest_total, lowest_total, bat_first_wins, {rat('bat_first_wins', 'matches', 100.0, 1)} AS bat_first_win_pct FROM y" + ordered("venue", "matches DESC", 10))),
        "toss_overall": (lambda t: m.toss_analysis(t), _toss(None)),
        "team_form_results": (lambda t: m.team_form_results(t, "NATION_3"), q(TEAMS.format(w=flt(team="NATION_3")), LAST, "SELECT * FROM lm")),
        "team_form_summary": (lambda t: m.team_form_summary(t, "NATION_3"), q(
            TEAMS.format(w=flt(team="NATION_3")), LAST, TOT, "g AS (SELECT *, row_number() OVER (ORDER BY date_start DESC, match_id) - row_number() OVER (PARTITION BY result ORDER BY date_start DESC, match_id) AS gap FROM lm)",
            "c AS (SELECT count(*) FILTER (WHERE result = 'W') AS wins, count(*) FILTER (WHERE result = 'L') AS losses, count(*) FILTER (WHERE result = 'D') AS draws, count(*) FILTER (WHERE result = 'T') AS ties, count(*) FILTER (WHERE result = 'NR') AS no_results, "
            "max(result) FILTER (WHERE gap = 0) AS code, count(*) FILTER (WHERE gap = 0) AS len FROM g)",
            "o AS (SELECT avg(CAST(total AS DOUBLE)) AS a, max(total) AS highest_score, min(total) AS lowest_score, avg(CAST(total AS DOUBLE) / nullif(CAST(balls AS DOUBLE) / 6.0::DOUBLE, 0)) AS rr FROM it WHERE batting_team = 'NATION_3' AND match_id IN (SELECT match_id FROM lm))",
            f"SELECT wins, losses, draws, ties, no_results, {rat('wins', '(wins + losses)', 100.0, 1)} AS win_pct, {r('a', 1)} AS avg_score, highest_score, lowest_score, {r('rr')} AS avg_run_rate, concat(code, ' x ', CAST(len AS VARCHAR)) AS streak FROM c, o")),
        "tournament_standings": (lambda t: m.tournament_standings(t, "World Cup"), q(TEAMS.format(w=flt(event_name="World Cup")),
            "y AS (SELECT team, count(*) AS played, count(*) FILTER (WHERE outcome_winner = team) AS won, count(*) FILTER (WHERE outcome_winner <> team AND outcome_result IS NULL) AS lost, count(*) FILTER (WHERE outcome_result = 'draw') AS drawn, "
            "count(*) FILTER (WHERE outcome_result = 'tie') AS tied, count(*) FILTER (WHERE outcome_result = 'no result') AS no_results FROM tm GROUP BY team)", f"SELECT *, {rat('won', '(won + lost)', 100.0, 1)} AS win_pct FROM y" + ordered("team", "won DESC, win_pct DESC", 10))),
        "tournament_meta": (lambda t: m.tournament_meta(t, "World Cup"), q(f"SELECT count(*) AS matches, min(date_start) AS first_match, max(date_start) AS last_match, count(DISTINCT season) AS seasons FROM matches WHERE {flt(event_name='World Cup')}")),
        "highest_total": (lambda t: m.team_totals(t, "highest_total"), q(TOT, total + " ORDER BY total DESC, match_id, innings_number LIMIT 10")),
        "lowest_total": (lambda t: m.team_totals(t, "lowest_total"), q(TOT, total + " AND wickets >= 10 ORDER BY total, match_id, innings_number LIMIT 10")),
        "highest_chase": (lambda t: m.highest_chase(t), q(TOT, "z AS (SELECT *, max(innings_number) OVER (PARTITION BY match_id) AS last_inn FROM it)", total.replace("FROM it", "FROM z") + " AND innings_number = last_inn AND outcome_winner = batting_team ORDER BY total DESC, match_id, innings_number LIMIT 10")),
        "tied_matches": (lambda t: m.tied_matches(t), q("SELECT match_id, match_type, date_start, team1, team2, venue, event_name, outcome_winner FROM matches WHERE outcome_result = 'tie' ORDER BY date_start DESC, match_id LIMIT 10")),
        "super_over_scores": (lambda t: m.super_over_scores(t), q(TOT, "SELECT match_id, date_start, innings_number, batting_team, total AS runs, wickets FROM it JOIN matches USING (match_id) WHERE is_super_over")),
        "super_over_matches": (lambda t: m.super_over_matches(t), q(TOT, "s AS (SELECT match_id, date_start, string_agg(concat(CAST(innings_number AS VARCHAR), ' ', batting_team, ' ', CAST(total AS VARCHAR), '/', CAST(wickets AS VARCHAR)), '; ' ORDER BY innings_number) AS scores FROM it JOIN matches USING (match_id) WHERE is_super_over GROUP BY ALL)",
            "SELECT *, count(*) OVER () AS total_count FROM s ORDER BY date_start DESC, match_id LIMIT 20")),
        "super_over_records": (lambda t: m.super_over_records(t), q(TEAMS.format(w="outcome_winner IS NOT NULL AND match_id IN (SELECT match_id FROM innings WHERE is_super_over)"),
            "SELECT team, count(*) FILTER (WHERE outcome_winner = team) AS won, count(*) FILTER (WHERE outcome_winner <> team) AS lost, count(*) AS played FROM tm GROUP BY team")),
    }
    for key, column in {"venue": "venue", "team": "toss_winner", "match_type": "match_type", "season": "season"}.items():
        out[f"toss_by_{key}"] = (lambda t, key=key: m.toss_analysis(t, key), _toss(column))
    for size in ("biggest", "narrowest"):
        for by in ("runs", "wickets"):
            out[f"win_margin_{size}_{by}"] = (lambda t, size=size, by=by: m.win_margins(t, size, by), _margin(size, by))
    for kind in ("wins", "losses"):
        out[f"streak_team_{kind}"] = (lambda t, kind=kind: m.team_streaks(t, kind), _streak(kind))
    return out
