"""Registered queries of the ingest jobs over the derived tables: name -> (operator call, SQL)."""

from pyspark.sql import functions as F

from ..sources.checks import integrity
from ..sources.enrichment import derive_style_groups, enrich
from ..sources.ingest import export_documents, flatten, freshness, parse_documents, registry, split_bad, summary, unseen
from .oracle import q


def _people(t):
    d = t.deliveries.join(t.matches.select("match_id", "date_start"), "match_id")
    return d.select("match_id", "date_start", F.col("batter").alias("player_name"), F.col("batter_id").alias("player_id"))


def _documents(t):
    """Match documents of the derived tables; for each match without a venue a text that breaks off comes on top."""
    texts = export_documents(t)
    broken = t.matches.filter("venue is null").select(F.concat(F.lit("broken-"), "match_id").alias("match_id"), F.lit('{"info": {"teams": ').alias("document"))
    return split_bad(parse_documents(texts.unionByName(broken)))


def checks_sql() -> str:
    """Violations by check, as anti joins and groups."""
    twice = lambda name, table, k: f"SELECT '{name}' AS \"check\", count(*) AS violations FROM (SELECT {k} FROM {table} GROUP BY {k} HAVING count(*) > 1)"
    anti = lambda name, a, b, k: f"SELECT '{name}' AS \"check\", count(*) AS violations FROM {a} ANTI JOIN {b} USING ({k})"
    return " UNION ALL ".join([
            anti("orphan_deliveries", "deliveries", "matches", "match_id"), anti("orphan_innings", "innings", "matches", "match_id"), anti("deliveries_without_innings", "deliveries", "innings", "match_id, innings_number"),
            twice("repeated_matches", "matches", "match_id"), twice("repeated_innings", "innings", "match_id, innings_number"), twice("repeated_deliveries", "deliveries", "match_id, innings_number, over_number, ball_number"), twice("repeated_players", "players", "player_id"),
            "SELECT 'overs_outside_phases', count(*) FROM deliveries SEMI JOIN (SELECT match_id FROM matches WHERE match_type IN ('T20', 'IT20')) USING (match_id) WHERE NOT over_number BETWEEN 0 AND 19"])


def build() -> dict:
    count = lambda name, sql: f"SELECT '{name}' AS what, count(*) AS n FROM {sql}"
    return {
        "ingest_matches": (lambda t: flatten(_documents(t)[0])["matches"], q("SELECT * REPLACE (date_start AS date_end) FROM matches")),
        "ingest_innings": (lambda t: flatten(_documents(t)[0])["innings"], q("SELECT * FROM innings")),
        "ingest_deliveries": (lambda t: flatten(_documents(t)[0])["deliveries"], q("SELECT * FROM deliveries")),
        "ingest_people": (lambda t: registry(flatten(_documents(t)[0])["people"]).select("player_id", "player_name"), q(
            "SELECT DISTINCT i AS player_id, n AS player_name FROM (SELECT unnest([batter_id, bowler_id, non_striker_id, wicket_player_out_id]) AS i, unnest([batter, bowler, non_striker, wicket_player_out]) AS n FROM deliveries) WHERE i IS NOT NULL")),
        "ingest_failed": (lambda t: _documents(t)[1], q("SELECT concat('broken-', match_id) AS match_id, '{\"info\": {\"teams\": ' AS _corrupt_record FROM matches WHERE venue IS NULL")),
        "freshness": (lambda t: freshness(t.matches, "1999-01-15"), q(
            "x AS (SELECT count(*) AS matches, max(date_start) AS latest, CAST(date_diff('day', max(date_start), DATE '1999-01-15') AS INT) AS days_behind FROM matches)", "y AS (SELECT *, CAST(CASE WHEN days_behind + 1 <= 2 THEN 2 WHEN days_behind + 1 <= 7 THEN 7 WHEN days_behind + 1 <= 30 THEN 30 END AS INT) AS feed_days FROM x)",
            "SELECT *, CASE WHEN latest IS NULL OR feed_days IS NULL THEN 'needs rebuild' WHEN days_behind <= 1 THEN 'fresh' WHEN days_behind > 10 THEN 'stale' ELSE 'ok' END AS state FROM y")),
        "ingest_summary": (lambda t: summary(t.star()), q(" UNION ALL ".join([*(count(n, n) for n in ("players", "matches", "innings", "deliveries")), "SELECT 'enriched_players', count(*) FROM players WHERE batting_style IS NOT NULL OR bowling_style IS NOT NULL"]))),
        "integrity": (lambda t: integrity(t.star()), q(checks_sql())),
        "player_registry": (lambda t: registry(_people(t), t.players.filter("cast(player_id as int) < 50")).select("player_id", "player_name"), q(
            "SELECT batter_id AS player_id, arg_min(batter, (date_start, match_id, batter)) AS player_name FROM deliveries JOIN matches USING (match_id) WHERE CAST(batter_id AS INT) >= 50 GROUP BY batter_id")),
        "new_matches": (lambda t: unseen(t.matches, t.matches.filter("match_type = 'T20'")).select("match_id", "match_type", "date_start"), q("SELECT match_id, match_type, date_start FROM matches WHERE match_type <> 'T20'")),
        "enriched_players": (lambda t: derive_style_groups(enrich(t.players, t.players.filter("batting_style = 'Left hand bat'").select("player_id", F.lit("Left-arm fast").alias("bowling_style")))).select("player_id", "bowling_style", "bowling_style_broad", "bowling_style_arm"), q(
            "SELECT player_id, CASE WHEN batting_style = 'Left hand bat' THEN 'Left-arm fast' ELSE bowling_style END AS bowling_style, CASE WHEN batting_style = 'Left hand bat' THEN 'Pace' ELSE bowling_style_broad END AS bowling_style_broad, CASE WHEN batting_style = 'Left hand bat' THEN 'Left-arm Pace' ELSE bowling_style_arm END AS bowling_style_arm FROM players")),
    }
