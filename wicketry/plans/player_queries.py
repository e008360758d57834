"""Registered player queries: name -> (operator call, SQL)."""

from ..operators import players as p
from .oracle import BK, BW, CONCEDED, FOUR, KINDS, LEGAL, OUT, SIX, WK, balls, bat, bat_table, bowl, bowl_table, eco, has, n, ordered, q, rat, s, stage

P, P2 = "00000004", "00000007"
CR = f"{BW} AND wicket_player_out = batter"
PK = f"{BK}, {WK}"
DIS = "k AS (SELECT wicket_kind AS kind, count(*) AS count FROM b GROUP BY ALL)", f"SELECT kind, count, {rat('count', '(sum(count) OVER ())', 100.0, 1)} AS pct, CAST(sum(count) OVER () AS BIGINT) AS total FROM k"


def _mu(keys: str) -> str:
    return (f"mu AS (SELECT {keys}, count(DISTINCT match_id) AS matches, count(DISTINCT (match_id, innings_number)) AS innings, {n('extras_wides = 0')} AS balls, {s('runs_batter')} AS runs, {s(CONCEDED)} AS runs_conceded, {n(CR)} AS dismissals, "
            f"{n('extras_wides = 0 AND runs_batter = 0')} AS dots, {n(FOUR)} AS fours, {n(SIX)} AS sixes, coalesce(string_agg(wicket_kind, ', ' ORDER BY wicket_kind) FILTER (WHERE {CR}), '') AS kinds FROM b GROUP BY {keys})")


MU = (f"matches, innings, balls, runs, runs_conceded, dismissals, dots, fours, sixes, kinds, {rat('runs', 'dismissals')} AS average, {rat('runs', 'balls', 100.0)} AS strike_rate, {eco('runs_conceded', 'balls')} AS economy, "
      f"{rat('balls', 'dismissals')} AS bowling_strike_rate, {rat('dots', 'balls', 100.0)} AS dot_pct, {rat('(fours + sixes)', 'balls', 100.0)} AS boundary_pct FROM mu")


def _style(where: str, other: str, column: str) -> str:
    return q(balls(where), f"x AS (SELECT b.*, coalesce({column}, 'Unknown') AS style FROM b LEFT JOIN players ON player_id = {other})",
             f"y AS (SELECT style, count(DISTINCT (match_id, innings_number)) AS innings, {n('extras_wides = 0')} AS balls, {s('runs_batter')} AS runs, {n(CR)} AS dismissals, {n('extras_wides = 0 AND runs_batter = 0')} AS dots, {n(FOUR)} AS fours, {n(SIX)} AS sixes FROM x GROUP BY style)",
             f"SELECT *, {rat('runs', 'dismissals')} AS average, {rat('runs', 'balls', 100.0)} AS strike_rate, {rat('dots', 'balls', 100.0)} AS dot_pct, {rat('(fours + sixes)', 'balls', 100.0)} AS boundary_pct FROM y WHERE balls >= 30" + ordered("style", "balls DESC", 10))


def _clutch(side: str) -> tuple[str, str, str]:
    name, inn, table, src, cols = ("batter", bat, bat_table, "bi", p._clutch_columns(side)) if side == "batting" else ("bowler", bowl, bowl_table, "wi", p._clutch_columns(side))
    sb = f"sb AS (SELECT *, {stage()} AS stage FROM b)"
    parts = [balls(has(name, P)), sb, inn("stage", src="sb")]
    splits = "sp AS (SELECT *, unnest(['overall'] || CASE stage WHEN 'league' THEN ['league'] WHEN 'knockout' THEN ['knockouts', 'knockout'] WHEN 'final' THEN ['knockouts', 'final'] ELSE ['placement'] END) AS split FROM " + src + ")"
    rate = "strike_rate" if side == "batting" else "economy"
    d = lambda c: f"floor((max({c}) FILTER (WHERE split = 'knockouts') - max({c}) FILTER (WHERE split = 'league')) * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE"
    return (q(*parts, splits, table("split", src="sp", name="ct"), f"SELECT split, {', '.join(cols)} FROM ct"), q(*parts, table("stage", src=src, name="ct"), f"SELECT stage, {', '.join(cols)} FROM ct"),
            q(*parts, splits, table("split", src="sp", name="ct"), f"SELECT {d('average')} AS average_delta, {d(rate)} AS {rate}_delta FROM ct"))


def _discipline_bowl(order: str, where: str = "true") -> str:
    return q(
        balls(where), f"x AS (SELECT {WK}, count(*) AS deliveries, {n(LEGAL)} AS legal_balls, {n(LEGAL + ' AND runs_total = 0')} AS dots, {s('extras_wides')} AS wides, {s('extras_noballs')} AS noballs, {n(f'({FOUR}) OR ({SIX})')} AS boundaries FROM b GROUP BY {WK})",
        f"SELECT *, {rat('dots', 'legal_balls', 100.0)} AS dot_pct, {rat('wides', 'deliveries', 100.0)} AS wide_pct, {rat('noballs', 'deliveries', 100.0)} AS noball_pct, {eco('(wides + noballs)', 'legal_balls')} AS extras_per_over, {rat('boundaries', 'legal_balls', 100.0)} AS boundary_pct FROM x WHERE legal_balls >= 100" + ordered(WK, order, 10))


def _discipline_bat(order: str, where: str) -> str:
    return q(
        balls(where), f"x AS (SELECT {BK}, {n('extras_wides = 0')} AS balls, {s('runs_batter')} AS runs, {n('extras_wides = 0 AND runs_batter = 0')} AS dots, {n(f'({FOUR}) OR ({SIX})')} AS boundaries FROM b GROUP BY {BK})",
        f"SELECT *, {rat('dots', 'balls', 100.0)} AS dot_pct, {rat('boundaries', 'balls', 100.0)} AS boundary_pct, {rat('runs', 'balls', 100.0)} AS strike_rate FROM x WHERE balls >= 100" + ordered(BK, order, 10))


def _fielding(order: str) -> str:
    return q(
        balls("is_wicket"), "x AS (SELECT match_id, wicket_kind, unnest([wicket_fielder1, wicket_fielder2]) AS fielder FROM b)",
        "SELECT fielder, count(DISTINCT match_id) AS matches, count(*) FILTER (WHERE wicket_kind IN ('caught', 'caught and bowled')) AS catches, count(*) FILTER (WHERE wicket_kind = 'run out') AS run_outs, count(*) FILTER (WHERE wicket_kind = 'stumped') AS stumpings, count(*) AS total FROM x WHERE fielder IS NOT NULL GROUP BY fielder HAVING count(DISTINCT match_id) >= 10" + ordered("fielder", order, 10))


def _leaders(side: str, order: str) -> str:
    fixed, keys = (has("batter", P), WK) if side == "batter" else (has("bowler", P2), BK)
    return q(balls(fixed), _mu(keys), f"SELECT {keys}, {MU} WHERE balls >= 12 AND innings >= 3" + ordered(keys, order, 10))


def _variants() -> dict:
    """Every other order of D12-D14, D27, D28 and D33, and the optional arguments of D34, D38 and D39."""
    out = {"matchup_pair_bowling": (lambda t: p.matchup_pair(t, "0000000", "0000001", "bowling"), q(
        balls(f"{has('batter', '0000000')} AND {has('bowler', '0000001')}"), _mu(PK), f"SELECT {PK}, {MU}" + ordered(PK, "dismissals DESC, runs_conceded", 10)))}
    for sort_by, order in {"dismissals": "dismissals DESC, balls DESC", "average": "average", "strike_rate": "strike_rate"}.items():
        out[f"matchup_vs_team_{sort_by}"] = (lambda t, x=sort_by: p.matchup_vs_team(t, P, "NATION_3", x), q(balls(has("batter", P), opposition="NATION_3"), _mu(PK), f"SELECT {PK}, {MU} WHERE balls >= 6" + ordered(PK, order, 10)))
    for kind, order in {"best_average": "average", "best_strike_rate": "strike_rate", "most_dots": "dot_pct DESC", "most_runs": "dismissals DESC, balls DESC"}.items():
        out[f"matchup_leaderboard_batter_{kind}"] = (lambda t, x=kind: p.matchup_leaderboard(t, batter=P, record_type=x), _leaders("batter", order))
    for kind, order in {"most_dismissals": "dismissals DESC, balls DESC", "most_runs": "runs_conceded DESC", "best_average": "average", "most_dots": "dismissals DESC, balls DESC"}.items():
        out[f"matchup_leaderboard_bowler_{kind}"] = (lambda t, x=kind: p.matchup_leaderboard(t, bowler=P2, record_type=x), _leaders("bowler", order))
    for sort_by in ("extras_per_over", "boundary_pct", "wide_pct"):
        out[f"discipline_bowling_{sort_by}"] = (lambda t, x=sort_by: p.discipline_bowling(t, sort_by=x, phase_name="death"), _discipline_bowl(sort_by, "over_number BETWEEN 15 AND 19"))
    out["discipline_batting_boundary_pct"] = (lambda t: p.discipline_batting(t, phase_name="powerplay", sort_by="boundary_pct"), _discipline_bat("boundary_pct DESC", "over_number BETWEEN 0 AND 5"))
    for sort_by in ("catches", "run_outs", "stumpings"):
        out[f"fielding_{sort_by}"] = (lambda t, x=sort_by: p.fielding(t, sort_by=x), _fielding(f"{sort_by} DESC"))
    out["dismissal_batting_vs_player"] = (lambda t: p.dismissals(t, P, vs_player="0000001"), q(balls(f"is_wicket AND {has('wicket_player_out', P)} AND {has('bowler', '0000001')}"), *DIS))
    out["dismissal_bowling_vs_player"] = (lambda t: p.dismissals(t, P2, "bowling", "0000001"), q(balls(f"is_wicket AND {has('bowler', P2)} AND wicket_kind IN {KINDS} AND {has('batter', '0000001')}"), *DIS))
    out["style_batting_death"] = (lambda t: p.style_matchup(t, P, phase_name="death"), _style(f"{has('batter', P)} AND over_number BETWEEN 15 AND 19", "bowler_id", "bowling_style_arm"))
    return out


def build() -> dict:
    out = {
        "search_players": (lambda t: p.search_players(t, "0000001"), q(f"SELECT player_id, player_name, batting_style, bowling_style, playing_role, country FROM players WHERE {has('player_name', '0000001')}" + ordered("player_id", "player_name", 10))),
        "matchup_pair": (lambda t: p.matchup_pair(t, "0000000", "0000001"), q(balls(f"{has('batter', '0000000')} AND {has('bowler', '0000001')}"), _mu(PK), f"SELECT {PK}, {MU}" + ordered(PK, "runs DESC", 10))),
        "matchup_vs_team": (lambda t: p.matchup_vs_team(t, P, "NATION_3"), q(balls(has("batter", P), opposition="NATION_3"), _mu(PK), f"SELECT {PK}, {MU} WHERE balls >= 6" + ordered(PK, "balls DESC", 10))),
        "matchup_leaderboard_batter": (lambda t: p.matchup_leaderboard(t, batter=P), _leaders("batter", "dismissals DESC, balls DESC")),
        "matchup_leaderboard_bowler": (lambda t: p.matchup_leaderboard(t, bowler=P2, record_type="highest_strike_rate"), _leaders("bowler", "strike_rate DESC")),
        "discipline_bowling": (lambda t: p.discipline_bowling(t), _discipline_bowl("dot_pct DESC")),
        "discipline_batting": (lambda t: p.discipline_batting(t, phase_name="middle"), _discipline_bat("dot_pct", "over_number BETWEEN 6 AND 14")),
        "fielding": (lambda t: p.fielding(t), _fielding("total DESC")),
        "dismissal_batting": (lambda t: p.dismissals(t, P), q(balls(f"is_wicket AND {has('wicket_player_out', P)}"), *DIS)),
        "dismissal_bowling": (lambda t: p.dismissals(t, P2, "bowling"), q(balls(f"is_wicket AND {has('bowler', P2)} AND wicket_kind IN {KINDS}"), *DIS)),
        "style_bowling": (lambda t: p.style_matchup(t, P2, "bowling"), _style(has("bowler", P2), "batter_id", "batting_style")),
    }
    for g, column in {"broad": "bowling_style_broad", "arm": "bowling_style_arm", "raw": "bowling_style"}.items():
        out[f"style_batting_{g}"] = (lambda t, g=g: p.style_matchup(t, P, "batting", g), _style(has("batter", P), "bowler_id", column))
    for side in ("batting", "bowling"):
        splits, stages, delta = _clutch(side)
        out[f"clutch_{side}"] = (lambda t, side=side: p.clutch(t, P, side), splits)
        out[f"clutch_stage_{side}"] = (lambda t, side=side: p.clutch_stage(t, P, side), stages)
        out["clutch_delta" if side == "batting" else "clutch_delta_bowling"] = (lambda t, side=side: p.clutch_delta(t, P, side), delta)
    return out | _variants()
