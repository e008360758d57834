"""The index of names: the same results as testing every ball, and what is read for them."""

import random

import pytest
from pyspark.sql import functions as F

from wicketry.operators import careers, innings, players
from wicketry.plans.fixture import Tables, tables
from wicketry.sources import names, storage

PARTS = ["an", "anna", "ANNA", "Anna B", "a%b", "n_a", "__", "%", "", "zz", "İ", "ΟΔΟΣ", "straße", "o'", "\\%", "100%", "nn", "Ann\\_"]


@pytest.fixture(scope="module")
def people(spark, tmp_path_factory):
    """Two batches of matches with odd names, as kept tables."""
    rng, pool = random.Random(7), ["Anna Berg", "Hanna B", "ANNABEL", "Jo", "O'Neill", "İpek", "ΟΔΟΣ", "Straße", "50%", "x_y", "a", "", "nan", "Ann_", "100% Ann", "Zoë"]
    path = f"file://{tmp_path_factory.mktemp('names')}/star"
    for batch in range(2):
        rows = [(f"{batch}-{m}", 1, k // 6, k % 6, *rng.sample(pool[batch:], 3), rng.choice([None, *pool]), rng.choice([None, *pool]), None) for m in range(12) for k in range(12)]
        d = spark.createDataFrame(rows, "match_id string, innings_number int, over_number int, ball_number int, batter string, bowler string, non_striker string, wicket_player_out string, wicket_fielder1 string, wicket_fielder2 string")
        d = d.withColumns({f"{c}_id": F.col(c) for c in ("batter", "bowler", "non_striker", "wicket_player_out")} | {f"extras_{x}": F.lit(0) for x in ("wides", "noballs", "byes", "legbyes", "penalty")} | {
            "runs_batter": F.col("ball_number"), "runs_extras": F.lit(0), "runs_total": F.col("ball_number"), "runs_non_boundary": F.lit(False), "is_wicket": F.col("wicket_player_out").isNotNull(), "wicket_kind": F.when(F.col("wicket_player_out").isNotNull(), "caught")})
        m = d.select("match_id").distinct().selectExpr("match_id", "'T20' AS match_type", "date'2020-01-01' AS date_start", "'2020' AS season", "'S' AS team1", "'T' AS team2")
        storage.write_star({"matches": m, "deliveries": d}, path, buckets=3)
    found = storage.scan(spark, path)
    return Tables(None, found["matches"], None, found["deliveries"], found["batting"], found["bowling"], found["appearances"], found["grams"], storage.live_rows(spark, path, "deliveries"))


@pytest.mark.parametrize("part", PARTS)
def test_names_and_matches_equal_a_test_of_every_ball(people, part):
    seen = people.deliveries.select("match_id", F.explode(F.array(*names.NAMED)).alias("name")).filter(F.col("name").ilike(f"%{part}%"))
    assert sorted(r.name for r in names.named(people, part).collect()) == sorted(r.name for r in seen.select("name").distinct().collect())
    assert names.matches_of(people, (part,)) == sorted(r.match_id for r in seen.select("match_id").distinct().collect())


def test_bounds_and_sizes(people):
    assert people.rows == 288
    assert names.matches_of(people, ("ann",), bound=2) is None and names.matches_of(people, ("ann", "zz")) == []
    both = set(names.matches_of(people, ("anna b",))) & set(names.matches_of(people, ("ipek",)))
    assert names.matches_of(people, ("anna b", "ipek")) == sorted(both)
    assert names.within(people, ("ann",)) is None  # too few deliveries to gain by it


def test_operators_give_the_same_with_the_index(spark, monkeypatch):
    """Operators that take names, on the derived tables: with the index asked always and never; only the matches concerned are read."""
    t = tables(spark, "/root/testdata/sf0.001")
    assert t.rows == t.deliveries.count() > 0
    one = "00000004"
    calls = {
        "batting": lambda: careers.player_batting(t, one), "bowling": lambda: careers.player_bowling(t, "0000001"), "phase": lambda: careers.phase_batting(t, "death", one, min_balls=1), "pressure": lambda: careers.situational(t, "pressure", player=one, min_innings=1),
        "what_if": lambda: careers.what_if_batting(t, one, {"bowler": "1"}), "season": lambda: careers.season_batting(t, one), "matchup": lambda: players.matchup_pair(t, one, "00000018"), "fielding": lambda: players.fielding(t, one, min_matches=1),
        "dismissals": lambda: players.dismissals(t, one), "stands": lambda: innings.partnerships(t, one, "00000005", min_runs=1), "fastest": lambda: innings.fastest(t, 20, one), "form": lambda: innings.form_bowling(t, "00000018"),
        "streaks": lambda: innings.batter_streaks(t, player=one, min_length=1), "clutch": lambda: players.clutch(t, one), "nobody": lambda: careers.player_batting(t, "nobody")}
    want = {name: sorted(map(str, call().collect())) for name, call in calls.items()}
    monkeypatch.setattr(names, "FROM", 0)
    assert {name: sorted(map(str, call().collect())) for name, call in calls.items()} == want and sum(map(len, want.values())) > 20
    one_match = t.appearances.groupBy("name").agg(F.countDistinct("match_id").alias("n")).orderBy("n", "name").first()
    plan = careers.phase_batting(t, "death", one_match.name, min_balls=1)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "over_number" in line]
    assert one_match.n < 8 and scans and all("SelectedBucketsCount" in line and "SelectedBucketsCount: 8 out of 8" not in line for line in scans)
