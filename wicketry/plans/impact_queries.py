"""Registered impact queries: name -> (operator call, SQL)."""

from ..operators import impact as i
from .oracle import CONCEDED, KINDS, LEGAL, OUT, has, n, q, r

W, AT = "match_id, innings_number", "over_number * 1000 + ball_number"
PH = (("pp", "over_number <= 5", 0.95), ("mid", "over_number BETWEEN 6 AND 14", 0.85), ("death", "over_number >= 15", 1.35))


def up(x: str) -> str:
    return f"(floor(({x}) * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE)"


def d(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def ctes(full: bool) -> list[str]:
    stages = " ".join(f"WHEN '{k}' THEN {v}" for k, v in i.STAGE_WEIGHTS.items())
    sums = ", ".join(f"sum(CASE WHEN {w} THEN {CONCEDED} ELSE 0 END) AS {p}_r, {n(f'{w} AND {LEGAL}')} AS {p}_b" for p, w, _ in PH)
    econ = ", ".join(f"greatest(coalesce({d(p + '_r')} / nullif({p}_b / 6.0::DOUBLE, 0), rr), 0.5::DOUBLE) AS {p}_e" if full else f"rr * {x}::DOUBLE AS {p}_e" for p, _, x in PH)
    level = "outcome_result IN ('tie', 'no result')" if full else "outcome_result = 'tie'"
    pace = f"({d('runs')} * 100.0::DOUBLE / nullif({d('balls')}, 0) / nullif(sr, 0))"
    if full:
        for p, bonus in (("death", 1.3), ("pp", 1.1)):
            w = f"({d(p + '_balls')} / nullif({d('balls')}, 0))"
            pace = f"(CASE WHEN {p}_balls >= 4 AND {p}_runs > 0 THEN (1 - {w}) * {pace} + {w} * ({d(p + '_runs')} * 100.0::DOUBLE / nullif({d(p + '_balls')}, 0) / nullif(sr, 0)) * {bonus}::DOUBLE ELSE {pace} END)"
    pace = f"(CASE WHEN balls >= 10 AND sr > 0 THEN greatest(0.5::DOUBLE, least({2.5 if full else 2.0}::DOUBLE, {pace})) ELSE 1.0::DOUBLE END)"
    chase = "(innings_number = 2 AND coalesce(target_runs, 0) > 0)"
    share = f"(runs * 100.0::DOUBLE / CASE WHEN {chase} THEN greatest(total, target_runs) ELSE total END)"
    situation = "(least(1.5::DOUBLE, 1 + 0.1::DOUBLE * entry) * CASE WHEN o = 0 AND innings_number = 1 THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END)"
    lost = f"(CASE WHEN {chase} AND NOT coalesce(batting_team = outcome_winner, false) AND by_runs > 0 THEN greatest(0.6::DOUBLE, 1 - by_runs / (2.0::DOUBLE * target_runs)) ELSE 1.0::DOUBLE END)"
    value = ("6.0::DOUBLE * ((CASE WHEN pos >= 8 AND oruns < 10 THEN 0.5 WHEN oruns >= 40 THEN 2.5 WHEN oruns >= 25 THEN 1.5 ELSE 1.0 END)::DOUBLE * (CASE WHEN pos <= 3 THEN 1.3 ELSE 1.0 END)::DOUBLE) + (CASE WHEN stand >= 100 THEN 6.0 WHEN stand >= 50 THEN 3.0 ELSE 0.0 END)::DOUBLE") if full else "6.0::DOUBLE"
    fvalue = "(CASE wicket_kind WHEN 'stumped' THEN 2.0 WHEN 'run out' THEN 3.0 ELSE 2.0 END)::DOUBLE * (CASE WHEN oruns >= 40 THEN 2.0 WHEN oruns >= 25 THEN 1.5 ELSE 1.0 END)::DOUBLE" if full else "2.0::DOUBLE"
    be = " + ".join(f"(CASE WHEN {p}_balls >= 6 THEN {p}_e / greatest({d(p + '_runs')} / ({p}_balls / 6.0::DOUBLE), 0.5::DOUBLE) * ({p}_balls / 6.0::DOUBLE) * 2.0::DOUBLE ELSE 0.0::DOUBLE END)" for p, _, _ in PH)
    defence = "(CASE WHEN innings_number = 2 AND bowling_team = outcome_winner AND by_runs > 0 THEN 1 + greatest(0.0::DOUBLE, 1 - by_runs / 25.0::DOUBLE) ELSE 1.0::DOUBLE END)" if full else "1.0::DOUBLE"
    bat_phase = ", ".join(f"sum(CASE WHEN {w} THEN runs_batter ELSE 0 END) AS {p}_runs, {n(f'{w} AND extras_wides = 0')} AS {p}_balls" for p, w, _ in PH)
    bowl_phase = ", ".join(f"sum(CASE WHEN {w} THEN {CONCEDED} ELSE 0 END) AS {p}_runs, {n(f'{w} AND {LEGAL}')} AS {p}_balls" for p, w, _ in PH)
    return [
        f"ms AS (SELECT match_id, sum(runs_total) AS tr, {n(LEGAL)} AS lb, {sums} FROM deliveries GROUP BY match_id)",
        f"mr AS (SELECT *, coalesce({d('tr')} * 100.0::DOUBLE / nullif({d('lb')}, 0), 100.0) AS sr, coalesce({d('tr')} / nullif(lb / 6.0::DOUBLE, 0), 6.0) AS rr, coalesce(outcome_by_runs, 0) AS by_runs, coalesce(outcome_by_wickets, 0) AS by_w FROM matches JOIN ms USING (match_id))",
        f"cx AS (SELECT match_id, date_start, outcome_winner, by_runs, sr, rr, {econ}, CAST(CASE event_stage {stages} ELSE 1.0 END AS DOUBLE) + CAST(CASE WHEN {level} THEN 0.2 WHEN by_runs > 0 THEN CASE WHEN by_runs <= 10 THEN 0.2 WHEN by_runs <= 20 THEN 0.1 ELSE 0.0 END "
        "WHEN by_w > 0 THEN CASE WHEN by_w <= 2 THEN 0.2 WHEN by_w <= 4 THEN 0.1 ELSE 0.0 END ELSE 0.0 END AS DOUBLE) AS importance FROM mr)",
        f"dd AS (SELECT *, coalesce(sum(CAST(is_wicket AS INT)) OVER (PARTITION BY {W} ORDER BY over_number, ball_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS down FROM deliveries)",
        f"bf AS (SELECT {W}, batter, batter_id, sum(runs_batter) AS runs, {n('extras_wides = 0')} AS balls, max(CASE WHEN {OUT} THEN 1 ELSE 0 END) AS o, min({AT}) AS first, arg_min(down, {AT}) AS entry, {bat_phase}, dense_rank() OVER (PARTITION BY {W} ORDER BY min({AT})) AS pos FROM dd GROUP BY {W}, batter, batter_id)",
        f"it AS (SELECT * FROM innings JOIN (SELECT {W}, sum(runs_total) AS total FROM deliveries GROUP BY ALL) USING ({W}))",
        f"ba AS (SELECT match_id, batter AS player, batter_id AS player_id, sum({r(f'({share} * {pace} * {situation} * 1.5::DOUBLE * {lost})', 6)}) AS v FROM bf JOIN it USING ({W}) JOIN cx USING (match_id) WHERE NOT is_super_over AND total > 0 GROUP BY ALL)",
        f"st AS (SELECT *, sum(runs_total) OVER (PARTITION BY {W}, down) AS stand FROM dd)",
        f"wh AS (SELECT {W}, batter AS wicket_player_out, sum(runs) AS orr, min(pos) AS op FROM bf GROUP BY ALL)",
        f"ou AS (SELECT *, coalesce(orr, 0) AS oruns, coalesce(op, 11) AS pos FROM st LEFT JOIN wh USING ({W}, wicket_player_out) WHERE is_wicket)",
        f"wv AS (SELECT {W}, bowler, bowler_id, sum({value}) AS wv FROM ou WHERE wicket_kind IN {KINDS} GROUP BY ALL)",
        f"bo AS (SELECT {W}, bowler, bowler_id, {n(LEGAL)} AS lb, {bowl_phase} FROM deliveries GROUP BY {W}, bowler, bowler_id)",
        f"bw AS (SELECT match_id, bowler AS player, bowler_id AS player_id, sum({r(f'((coalesce(wv, 0.0::DOUBLE) + CASE WHEN lb >= 12 THEN 0.0::DOUBLE + {be} ELSE 0.0::DOUBLE END) * {defence})', 6)}) AS v FROM bo LEFT JOIN wv USING ({W}, bowler, bowler_id) JOIN cx USING (match_id) JOIN innings USING ({W}) GROUP BY ALL)",
        f"fi AS (SELECT match_id, wicket_fielder1 AS player, sum({fvalue}) AS v FROM ou WHERE wicket_fielder1 IS NOT NULL AND wicket_kind IN ('caught', 'stumped', 'run out') GROUP BY ALL)",
        "al AS (SELECT match_id, player, player_id, v AS b, 0.0::DOUBLE AS w, 0.0::DOUBLE AS f FROM ba UNION ALL SELECT match_id, player, player_id, 0.0, v, 0.0 FROM bw UNION ALL SELECT match_id, player, p.pid, 0.0, 0.0, v FROM fi LEFT JOIN (SELECT player_name, min(player_id) AS pid FROM players GROUP BY ALL) p ON player_name = player)",
        f"su AS (SELECT match_id, player, player_id, {r('sum(b)', 6)} AS b, {r('sum(w)', 6)} AS w, {r('sum(f)', 6)} AS f FROM al GROUP BY ALL)",
        f"im AS (SELECT match_id, date_start, player, player_id, {up('b')} AS batting_impact, {up('w')} AS bowling_impact, {up('f')} AS fielding_impact, {up('importance')} AS importance, {up(r('((b + w + f) * importance)', 6))} AS total_impact FROM su JOIN cx USING (match_id))"]


def build() -> dict:
    p = "00000004"
    career = (f"tp AS (SELECT match_id, batter AS player, batter_id AS player_id FROM deliveries WHERE {has('batter', p)} UNION SELECT match_id, bowler, bowler_id FROM deliveries WHERE {has('bowler', p)}), "
              "pm AS (SELECT * FROM (SELECT tp.*, row_number() OVER (PARTITION BY player, player_id ORDER BY date_start DESC, match_id) AS k FROM tp JOIN matches USING (match_id)) WHERE k <= 50), "
              "cm AS (SELECT im.* FROM im SEMI JOIN pm ON im.match_id = pm.match_id AND im.player = pm.player AND im.player_id IS NOT DISTINCT FROM pm.player_id)")
    a = lambda x: up(r(x, 6))
    return {
        "match_impact": (lambda t: i.match_impact(t), q(*ctes(True), "SELECT * FROM im")),
        "career_impact_matches": (lambda t: i.career_impact_matches(t, p), q(*ctes(False), career, "SELECT * FROM cm")),
        "career_impact": (lambda t: i.career_impact(t, p), q(*ctes(False), career, f"SELECT player, player_id, count(*) AS matches, {a('avg(total_impact)')} AS average_impact, {a('sum(total_impact)')} AS career_impact, max(total_impact) AS peak_impact, "
                          f"{a('avg(batting_impact)')} AS average_batting, {a('avg(bowling_impact)')} AS average_bowling, {a('avg(fielding_impact)')} AS average_fielding FROM cm GROUP BY player, player_id ORDER BY average_impact DESC, player, player_id")),
    }
