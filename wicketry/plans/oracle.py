"""SQL of the other engine for the registered queries, built from the same definitions."""

from __future__ import annotations

from .fixture import oracle_prefix

KINDS = "('bowled', 'caught', 'caught and bowled', 'lbw', 'stumped', 'hit wicket')"
LEGAL = "extras_wides = 0 AND extras_noballs = 0"
OUT = "is_wicket AND wicket_player_out = batter"
BW = f"is_wicket AND wicket_kind IN {KINDS}"
CONCEDED = "runs_total - extras_byes - extras_legbyes"
FOUR, SIX = "runs_batter = 4 AND NOT runs_non_boundary", "runs_batter = 6 AND NOT runs_non_boundary"


def n(where: str) -> str:
    return f"count(*) FILTER (WHERE {where})"


def s(x: str) -> str:
    return f"CAST(coalesce(sum({x}), 0) AS BIGINT)"


def r(x: str, digits: int = 2) -> str:
    f = f"{10**digits}.0::DOUBLE"
    return f"(sign({x}) * floor(abs({x}) * {f} + 0.5) / {f})"


def rat(a: str, b: str, times: float = 1.0, digits: int = 2) -> str:
    return r(f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0) * {times}::DOUBLE)", digits)


def eco(c: str, b: str) -> str:
    return r(f"(CAST({c} AS DOUBLE) / nullif(CAST({b} AS DOUBLE) / 6.0::DOUBLE, 0))")


def overs(b: str) -> str:
    return f"concat(CAST({b} // 6 AS VARCHAR), '.', CAST({b} % 6 AS VARCHAR))"


def flt(**f: str) -> str:
    parts = ["true"]
    for k, v in f.items():
        if k in ("match_type", "gender", "season"):
            parts.append(f"{k} = '{v}'")
        elif k in ("team", "opposition"):
            parts.append(f"(team1 = '{v}' OR team2 = '{v}')")
        elif k in ("venue", "city", "event_name"):
            parts.append(f"{k} ILIKE '%{v}%'")
        else:
            parts.append(f"date_start {'>=' if k == 'date_from' else '<='} DATE '{v}'")
    return " AND ".join(parts)


def has(column: str, part: str) -> str:
    return f"{column} ILIKE '%{part}%'"


def balls(where: str = "true", **f: str) -> str:
    return f"b AS (SELECT d.*, m.match_type, m.gender, m.season, m.date_start, m.team1, m.team2, m.venue, m.event_name, m.event_stage FROM deliveries d JOIN (SELECT * FROM matches WHERE {flt(**f)}) m USING (match_id) WHERE {where})"


def bat(extra: str = "", src: str = "b", name: str = "bi") -> str:
    e = f", {extra}" if extra else ""
    return (f"{name} AS (SELECT match_id, innings_number, batter, batter_id{e}, {s('runs_batter')} AS runs, {n('extras_wides = 0')} AS balls, {n(FOUR)} AS fours, {n(SIX)} AS sixes, "
            f"{n('extras_wides = 0 AND runs_batter = 0')} AS bat_dots, CAST(max(CASE WHEN {OUT} THEN 1 ELSE 0 END) AS BIGINT) AS was_out FROM {src} GROUP BY match_id, innings_number, batter, batter_id{e})")


def bowl(extra: str = "", src: str = "b", name: str = "wi") -> str:
    e = f", {extra}" if extra else ""
    return (f"{name} AS (SELECT match_id, innings_number, bowler, bowler_id{e}, {n(LEGAL)} AS balls, {s(CONCEDED)} AS conceded, {n(BW)} AS wickets, {n(LEGAL + ' AND runs_total = 0')} AS dots, "
            f"{n(LEGAL + ' AND runs_batter = 0')} AS bat_dots, {n(FOUR)} AS fours, {n(SIX)} AS sixes FROM {src} GROUP BY match_id, innings_number, bowler, bowler_id{e})")


def bat_table(keys: str, src: str = "bi", name: str = "bt") -> str:
    return (f"{name} AS (SELECT {keys}, count(DISTINCT match_id) AS matches, count(*) AS innings, count(*) - {s('was_out')} AS not_outs, {s('runs')} AS runs, max(runs) AS highest_score, "
            f"{rat('sum(runs)', 'sum(was_out)')} AS average, {rat('sum(runs)', 'sum(balls)', 100.0)} AS strike_rate, {s('balls')} AS balls_faced, {s('fours')} AS fours, {s('sixes')} AS sixes, "
            f"{n('runs >= 100')} AS centuries, {n('runs BETWEEN 50 AND 99')} AS fifties, {n('runs = 0 AND was_out = 1')} AS ducks, {s('bat_dots')} AS dots, {s('was_out')} AS outs FROM {src} GROUP BY {keys})")


def bowl_table(keys: str, src: str = "wi", name: str = "wt") -> str:
    best = "arg_max(concat(CAST(wickets AS VARCHAR), '/', CAST(conceded AS VARCHAR)), wickets * 1000000 - conceded)"
    return (f"{name} AS (SELECT {keys}, count(DISTINCT match_id) AS matches, count(*) AS innings, {s('balls')} AS balls, {overs(s('balls'))} AS overs, {s('conceded')} AS runs_conceded, {s('wickets')} AS wickets, "
            f"{best} AS best_figures, {rat('sum(conceded)', 'sum(wickets)')} AS average, {eco('sum(conceded)', 'sum(balls)')} AS economy, {rat('sum(balls)', 'sum(wickets)')} AS strike_rate, {s('dots')} AS dots, "
            f"{s('fours')} AS fours, {s('sixes')} AS sixes, {n('wickets >= 5')} AS five_wicket_hauls, {n('wickets >= 4')} AS four_wicket_hauls FROM {src} GROUP BY {keys})")


BAT = "matches, innings, not_outs, runs, highest_score, average, strike_rate, balls_faced, fours, sixes, centuries, fifties, ducks"
BOWL = "matches, innings, overs, runs_conceded, wickets, best_figures, average, economy, strike_rate, dots, five_wicket_hauls, four_wicket_hauls"
BK, WK = "batter, batter_id", "bowler, bowler_id"


def q(*parts: str) -> str:
    """Common table expressions, then the final SELECT."""
    return f"WITH {oracle_prefix()}, {', '.join(parts[:-1])} {parts[-1]}" if len(parts) > 1 else f"WITH {oracle_prefix()} {parts[0]}"


def ordered(keys: str, order: str, limit: int | None = None) -> str:
    nl = ", ".join(f"{x.strip()} NULLS LAST" for x in f"{order}, {keys}".split(",") if x.strip())
    return f" ORDER BY {nl}" + (f" LIMIT {limit}" if limit else "")


def stage(x: str = "event_stage") -> str:
    return (f"CASE WHEN {x} IS NULL THEN 'league' WHEN {x} ILIKE '%place%' THEN 'placement' WHEN {x} ILIKE '%final%' AND NOT ({x} ILIKE '%semi%' OR {x} ILIKE '%quarter%' OR {x} ILIKE '%preliminary%') THEN 'final' "
            f"WHEN {x} ILIKE '%final%' OR {x} ILIKE '%eliminator%' OR {x} ILIKE '%qualifier%' OR {x} ILIKE '%knockout%' OR {x} ILIKE '%play%off%' OR {x} ILIKE '%challenger%' THEN 'knockout' ELSE 'league' END")
