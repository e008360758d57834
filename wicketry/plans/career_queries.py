"""Registered career queries: name -> (operator call, SQL)."""

from ..operators import careers as c
from . import oracle as o
from .oracle import BAT, BK, BOWL, WK, balls, bat, bat_table, bowl, bowl_table, eco, has, n, ordered, q, r, rat, s

P, P2 = "00000004", "00000007"


def _phase_pct(d: str, b: str) -> str:
    return f"{rat('dots', b, 100.0)} AS dot_pct, {rat('(fours + sixes)', b, 100.0)} AS boundary_pct"


def _phase_bat(lo: int, hi: int, order: str, **f: str) -> str:
    return q(balls(f"over_number BETWEEN {lo} AND {hi}", **f), bat(), bat_table(BK),
             f"SELECT {BK}, matches, innings, not_outs, runs, average, strike_rate, balls_faced, fours, sixes, dots, {_phase_pct('dots', 'balls_faced')} FROM bt WHERE balls_faced >= 50" + ordered(BK, order, 10))


def _phase_bowl(lo: int, hi: int, order: str, **f: str) -> str:
    return q(balls(f"over_number BETWEEN {lo} AND {hi}", **f), bowl(), bowl_table(WK),
             f"SELECT {WK}, matches, innings, balls, overs, runs_conceded, wickets, dots, fours, sixes, average, economy, strike_rate, {_phase_pct('dots', 'balls')} FROM wt WHERE balls >= 50" + ordered(WK, order, 10))


def _batting(order: str, where: str = "true", min_innings: int = 5, **f: str) -> str:
    return q(balls(where, **f), bat(), bat_table(BK), f"SELECT {BK}, {BAT} FROM bt WHERE innings >= {min_innings}" + ordered(BK, order, 10))


def _bowling(order: str, min_innings: int = 10, **f: str) -> str:
    return q(balls(**f), bowl(), bowl_table(WK), f"SELECT {WK}, {BOWL} FROM wt WHERE innings >= {min_innings}" + ordered(WK, order, 10))


#: One set of values for each of the ten match filters, and all of them at once.
FILTERS = {
    "match_type": {"match_type": "ODI"}, "gender": {"gender": "female"}, "team": {"team": "NATION_3"}, "opposition": {"team": "NATION_3", "opposition": "NATION_4"}, "venue": {"venue": "ground 1"}, "city": {"city": "city 2"},
    "event_name": {"event_name": "league"}, "season": {"season": "1995"}, "date_from": {"date_from": "1996-06-15"}, "dates": {"date_from": "1993-03-01", "date_to": "1995-09-30"},
    "all": {"match_type": "T20", "gender": "male", "team": "NATION_0", "opposition": "NATION_1", "venue": "Ground", "city": "City", "event_name": "", "season": "", "date_from": "1992-01-01", "date_to": "1998-12-31"},
}


def _variants() -> dict:
    """Every other order of D15-D17 and D35, every match filter of B1, and bounds other than the defaults."""
    out = {}
    for sort_by, order in {"strike_rate": "strike_rate DESC", "average": "average DESC", "dot_pct": "dot_pct", "wickets": "runs DESC"}.items():
        out[f"phase_batting_{sort_by}"] = (lambda t, s=sort_by: c.phase_batting(t, "middle", sort_by=s), _phase_bat(6, 14, order))
    for sort_by, order in {"strike_rate": "strike_rate", "average": "average", "dot_pct": "dot_pct DESC", "runs": "wickets DESC"}.items():
        out[f"phase_bowling_{sort_by}"] = (lambda t, s=sort_by: c.phase_bowling(t, "powerplay", sort_by=s), _phase_bowl(0, 5, order))
    chasing = "CASE WHEN match_type = 'Test' THEN innings_number = 4 ELSE innings_number = 2 END"
    for sort_by in ("average", "strike_rate", "centuries"):
        out[f"situational_chasing_{sort_by}"] = (lambda t, s=sort_by: c.situational(t, "chasing", sort_by=s), _batting(f"{sort_by} DESC", chasing))
    for sort_by, order in {"runs": "runs DESC", "average": "average DESC"}.items():
        out[f"season_batting_{sort_by}"] = (lambda t, s=sort_by: c.season_batting(t, P, s, match_type="T20"), q(
            balls(has("batter", P), match_type="T20"), bat("season"), bat_table(f"season, {BK}"), f"SELECT season, {BK}, {BAT} FROM bt" + ordered(f"season, {BK}", order)))
    for sort_by, order in {"wickets": "wickets DESC", "average": "average"}.items():
        out[f"season_bowling_{sort_by}"] = (lambda t, s=sort_by: c.season_bowling(t, P, s, gender="male"), q(
            balls(has("bowler", P), gender="male"), bowl("season"), bowl_table(f"season, {WK}"), f"SELECT season, {WK}, {BOWL} FROM wt" + ordered(f"season, {WK}", order)))
    for name, f in FILTERS.items():
        given = {k: v for k, v in f.items() if v}
        out[f"filter_batting_{name}"] = (lambda t, f=f: c.batting_records(t, min_innings=1, **f), _batting("runs DESC", min_innings=1, **given))
    out["filter_bowling_all"] = (lambda t: c.bowling_records(t, min_innings=1, **FILTERS["all"]), _bowling("wickets DESC", 1, **{k: v for k, v in FILTERS["all"].items() if v}))
    return out


def _emerging(side: str, metric: str, min_recent: int, min_career: int, threshold: float) -> str:
    inn, k, cols = (bat("season"), BK, ("runs", "balls", "was_out")) if side == "batting" else (bowl("season"), WK, ("conceded", "balls", "wickets"))
    src = "bi" if side == "batting" else "wi"
    now = "season = (SELECT max(season) FROM matches)"
    a = f"e AS (SELECT {k}, count(*) AS innings, {n(now)} AS recent_innings, count(DISTINCT match_id) AS m, count(DISTINCT CASE WHEN {now} THEN match_id END) AS rm, " + ", ".join(
        f"sum({x}) AS {x}, sum(CASE WHEN {now} THEN {x} ELSE 0 END) AS r_{x}" for x in cols) + f" FROM {src} GROUP BY {k})"
    pick = {("batting", "average"): (rat("runs", "was_out"), rat("r_runs", "r_was_out"), "r - c"), ("batting", "strike_rate"): (rat("runs", "balls", 100.0), rat("r_runs", "r_balls", 100.0), "r - c"),
            ("bowling", "average"): (rat("conceded", "wickets"), rat("r_conceded", "r_wickets"), "c - r"), ("bowling", "economy"): (eco("conceded", "balls"), eco("r_conceded", "r_balls"), "c - r"),
            ("bowling", "wickets_per_match"): (rat("wickets", "m"), rat("r_wickets", "rm"), "r - c")}[side, metric]
    g = f"g AS (SELECT {k}, innings, recent_innings, {pick[0]} AS c, {pick[1]} AS r FROM e WHERE recent_innings >= {min_recent} AND innings >= {min_career})"
    h = f"h AS (SELECT *, ({pick[2]}) / c * 100.0::DOUBLE AS gain FROM g WHERE c > 0)"
    return q(balls(), inn, a, g, h, f"SELECT {k}, innings, recent_innings, c AS career_value, r AS recent_value, {r('gain')} AS improvement_pct FROM h WHERE gain >= {threshold}" + ordered(k, "improvement_pct DESC", 10))


def _what_if(side: str, player: str, keep: str) -> str:
    name, k = ("batter", BK) if side == "batting" else ("bowler", WK)
    inn, table = (bat, bat_table) if side == "batting" else (bowl, bowl_table)
    i = "bi" if side == "batting" else "wi"
    parts = [balls(has(name, player)), f"kb AS (SELECT * FROM b WHERE {keep})", inn(), inn(src="kb", name="ki"), table(k, src=i, name="ot"), table(k, src="ki", name="mt")]
    cols = ("matches", "innings", "runs", "average", "strike_rate") if side == "batting" else ("matches", "innings", "wickets", "runs_conceded", "average", "economy")
    sel = ", ".join(f"ot.{x} AS o_{x}, mt.{x} AS m_{x}" for x in cols)
    main, second = ("runs", "strike_rate") if side == "batting" else ("wickets", "economy")
    d = lambda x: r(f"(coalesce(mt.{x}, 0.0) - coalesce(ot.{x}, 0.0))")
    on = " AND ".join(f"mt.{x.strip()} = ot.{x.strip()}" for x in k.split(","))
    keys = ", ".join(f"ot.{x.strip()}" for x in k.split(","))
    return q(*parts, f"SELECT {keys}, {sel}, ot.innings - coalesce(mt.innings, 0) AS excluded_innings, coalesce(mt.{main}, 0) - ot.{main} AS {main}_delta, {d('average')} AS average_delta, {d(second)} AS {second}_delta FROM ot LEFT JOIN mt ON {on}")


def build() -> dict:
    out = {
        "player_stats_batting": (lambda t: c.player_batting(t, P, match_type="T20"), q(balls(has("batter", P), match_type="T20"), bat(), bat_table(BK), f"SELECT {BK}, {BAT} FROM bt")),
        "player_stats_bowling": (lambda t: c.player_bowling(t, P), q(
            balls(has("bowler", P)), bowl(), bowl_table(WK), f"ov AS (SELECT {WK}, match_id, innings_number, over_number, sum({o.CONCEDED}) AS c FROM b GROUP BY ALL)",
            f"md AS (SELECT {WK}, {n('c = 0')} AS maidens FROM ov GROUP BY {WK})", f"SELECT {WK}, {BOWL}, maidens FROM wt JOIN md USING ({WK})")),
        "phase_batting": (lambda t: c.phase_batting(t, "powerplay", match_type="T20"), _phase_bat(0, 5, "runs DESC", match_type="T20")),
        "phase_bowling": (lambda t: c.phase_bowling(t, "death", sort_by="economy"), _phase_bowl(15, 19, "economy")),
        "tournament_batters": (lambda t: c.tournament_batters(t, "World Cup"), q(balls(event_name="World Cup"), bat(), bat_table("batter"), "SELECT batter, matches, innings, runs, average, strike_rate, highest_score FROM bt" + ordered("batter", "runs DESC", 10))),
        "tournament_bowlers": (lambda t: c.tournament_bowlers(t, "World Cup"), q(balls(event_name="World Cup"), bowl(), bowl_table("bowler"), "SELECT bowler, matches, innings, wickets, runs_conceded, average, economy FROM wt" + ordered("bowler", "wickets DESC", 10))),
        "season_batting": (lambda t: c.season_batting(t, P), q(balls(has("batter", P)), bat("season"), bat_table(f"season, {BK}"), f"SELECT season, {BK}, {BAT} FROM bt")),
        "season_bowling": (lambda t: c.season_bowling(t, P), q(balls(has("bowler", P)), bowl("season"), bowl_table(f"season, {WK}"), f"SELECT season, {WK}, {BOWL} FROM wt")),
        "comparison_batting": (lambda t: c.comparison(t, "batting", P, P2), q(balls(f"({has('batter', P)} OR {has('batter', P2)})"), bat(), bat_table(BK), f"SELECT {BK}, {BAT} FROM bt")),
        "comparison_bowling": (lambda t: c.comparison(t, "bowling", P, P2), q(balls(f"({has('bowler', P)} OR {has('bowler', P2)})"), bowl(), bowl_table(WK), f"SELECT {WK}, {BOWL} FROM wt")),
        "what_if_batting": (lambda t: c.what_if_batting(t, P, {"opposition": "NATION_3", "venue": "Ground 1"}), _what_if("batting", P, "NOT (team1 = 'NATION_3' OR team2 = 'NATION_3') AND NOT (venue ILIKE '%Ground 1%')")),
        "what_if_bowling": (lambda t: c.what_if_bowling(t, P, {"batter": "00000003", "event": "World"}), _what_if("bowling", P, "NOT (batter ILIKE '%00000003%') AND NOT (event_name ILIKE '%World%')")),
    }
    for kind, column in c.BATTING_ORDERS.items():
        out[f"batting_records_{kind}"] = (lambda t, kind=kind: c.batting_records(t, kind), _batting(f"{column} DESC", min_innings=10))
    for kind, order in {"most_wickets": "wickets DESC", "best_average": "average", "best_economy": "economy", "best_strike_rate": "strike_rate", "most_five_wicket_hauls": "five_wicket_hauls DESC"}.items():
        out[f"bowling_records_{kind}"] = (lambda t, kind=kind: c.bowling_records(t, kind), _bowling(order))
    tests = {"chasing": "CASE WHEN match_type = 'Test' THEN innings_number = 4 ELSE innings_number = 2 END", "setting": "CASE WHEN match_type = 'Test' THEN innings_number IN (1, 2) ELSE innings_number = 1 END"}
    for name, where in tests.items():
        out[f"situational_{name}"] = (lambda t, name=name: c.situational(t, name), _batting("runs DESC", where))
    hard = "SELECT match_id, innings_number FROM deliveries WHERE over_number <= 9 GROUP BY ALL HAVING count(*) FILTER (WHERE is_wicket) >= 3"
    out["situational_pressure"] = (lambda t: c.situational(t, "pressure"), _batting("runs DESC", f"(d.match_id, innings_number) IN ({hard})"))
    out["situational_position"] = (lambda t: c.situational(t, "batting_position", position=3, sort_by="average"), q(
        balls(), f"fp AS (SELECT match_id, innings_number, {BK}, dense_rank() OVER (PARTITION BY match_id, innings_number ORDER BY min(over_number * 1000 + ball_number)) AS pos FROM b GROUP BY match_id, innings_number, {BK})",
        f"b3 AS (SELECT b.* FROM b JOIN fp USING (match_id, innings_number, {BK}) WHERE pos = 3)", bat(src="b3"), bat_table(BK), f"SELECT {BK}, {BAT} FROM bt WHERE innings >= 5" + ordered(BK, "average DESC", 10)))
    mil = "SELECT {name} AS player, {name}_id AS player_id, {v} AS value, greatest({x} - {v}, 0) AS remaining, {v} >= {x} AS reached FROM {t} WHERE {v} >= {x} - {p}"
    for kind, x in {"runs": 1000, "centuries": 2, "fifties": 5}.items():
        out[f"milestone_{kind}"] = (lambda t, kind=kind, x=x: c.milestone(t, kind, x), q(balls(), bat(), bat_table(BK), mil.format(name="batter", v=kind, x=x, p=-(-x // 10), t="bt") + ordered("player, player_id", "value DESC", 20)))
    for kind, x in {"wickets": 30, "five_wicket_hauls": 2}.items():
        out[f"milestone_{kind}"] = (lambda t, kind=kind, x=x: c.milestone(t, kind, x), q(balls(), bowl(), bowl_table(WK), mil.format(name="bowler", v=kind, x=x, p=-(-x // 10), t="wt") + ordered("player, player_id", "value DESC", 20)))
    out["milestone_matches"] = (lambda t: c.milestone(t, "matches", 20), q(
        balls(), "pm AS (SELECT batter_id AS id, match_id FROM b UNION SELECT bowler_id, match_id FROM b)", "pc AS (SELECT id, count(*) AS v FROM pm GROUP BY id)",
        "SELECT player_name AS player, player_id, v AS value, greatest(20 - v, 0) AS remaining, v >= 20 AS reached FROM pc JOIN players ON player_id = id WHERE v >= 18" + ordered("player, player_id", "value DESC", 20)))
    out["emerging_batters"] = (lambda t: c.emerging(t, "batting", "average", min_recent=1, min_career=5), _emerging("batting", "average", 1, 5, 20))
    out["emerging_batters_strike_rate"] = (lambda t: c.emerging(t, "batting", "strike_rate", min_recent=1, min_career=5, threshold=5.0), _emerging("batting", "strike_rate", 1, 5, 5))
    out["emerging_bowlers"] = (lambda t: c.emerging(t, "bowling", "economy", min_recent=1, min_career=5, threshold=5.0), _emerging("bowling", "economy", 1, 5, 5))
    out["emerging_bowlers_average"] = (lambda t: c.emerging(t, "bowling", "average", min_recent=1, min_career=5), _emerging("bowling", "average", 1, 5, 20))
    out["emerging_bowlers_wickets"] = (lambda t: c.emerging(t, "bowling", "wickets_per_match", min_recent=1, min_career=5), _emerging("bowling", "wickets_per_match", 1, 5, 20))
    return out | _variants()
