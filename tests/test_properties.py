"""A hand-computed match, and invariants of the operators."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from wicketry.operators import careers, impact, innings, matches, players
from wicketry.operators.streaks import streaks
from wicketry.plans.fixture import Tables, tables
from wicketry.plans.grains import balls

D = "match_id string, innings_number int, over_number int, ball_number int, batter string, batter_id string, bowler string, bowler_id string, non_striker string, runs_batter int, runs_extras int, runs_total int, runs_non_boundary boolean, extras_wides int, extras_noballs int, extras_byes int, extras_legbyes int, extras_penalty int, is_wicket boolean, wicket_kind string, wicket_player_out string, wicket_fielder1 string, wicket_fielder2 string"


def row(inn, over, n, batter, bowler, runs=0, wide=0, noball=0, bye=0, kind=None, out=None, fielder=None, all_run=False):
    extra = wide + noball + bye
    return ("m", inn, over, n, batter, batter.lower(), bowler, None if bowler == "Q" else bowler.lower(), "N", runs, extra, runs + extra, all_run, wide, noball, bye, 0, 0, kind is not None, kind, out or (batter if kind else None), fielder, None)


@pytest.fixture(scope="module")
def mini(spark):
    first = [row(1, 0, 0, "A", "X", 4), row(1, 0, 1, "A", "X", 4, all_run=True), row(1, 0, 2, "A", "X", wide=1), row(1, 0, 3, "A", "X", 6, noball=1), row(1, 0, 4, "A", "X", bye=2), row(1, 0, 5, "A", "X"), row(1, 0, 6, "A", "X"),
             row(1, 1, 0, "C", "Q", kind="run out", out="A", fielder="X"), *(row(1, 1, k, "C", "Q") for k in range(1, 6)), row(1, 2, 0, "C", "X", kind="caught", fielder="Y")]
    second = [row(2, 0, 0, "X", "A", 1), row(2, 0, 1, "X", "A", kind="bowled")]
    d = spark.createDataFrame(first + second + [row(3, 0, 0, "X", "A", 6)], D)
    i = spark.createDataFrame([("m", 1, "S", "T", False, None), ("m", 2, "T", "S", False, 20), ("m", 3, "T", "S", True, None)], "match_id string, innings_number int, batting_team string, bowling_team string, is_super_over boolean, target_runs int")
    m = spark.createDataFrame([("m", "T20", "male", "2020", "2020-01-01", "S", "T", None, "c", "S", "S", 18, None, None, None, None, 20)], "match_id string, match_type string, gender string, season string, day string, team1 string, team2 string, venue string, city string, toss_winner string, outcome_winner string, outcome_by_runs int, outcome_by_wickets int, outcome_result string, event_name string, event_stage string, overs_per_side int")
    m = m.withColumn("date_start", F.col("day").cast("date")).drop("day")
    p = spark.createDataFrame([(x.lower(), x) for x in "ACXY"], "player_id string, player_name string")
    return Tables(p, m, i, d)


def test_batting_by_hand(mini):
    r = {x.batter: x for x in careers.player_batting(mini, "", ).collect()}
    a, c = r["A"], r["C"]
    assert (a.runs, a.balls_faced, a.fours, a.sixes, a.not_outs, a.average, a.strike_rate) == (14, 6, 1, 1, 1, None, 233.33)  # run out off the other end isn't an out here
    assert (c.runs, c.balls_faced, c.not_outs, c.ducks, c.average) == (0, 7, 0, 1, 0.0)
    assert r["X"].innings == 2 and r["X"].runs == 7  # the super over counts


def test_bowling_by_hand(mini):
    r = {x.bowler: x for x in careers.player_bowling(mini, "").collect()}
    assert "Q" not in r or r["Q"].wickets == 0  # an id that is missing
    x = r["X"]
    assert (x.overs, x.runs_conceded, x.wickets, x.best_figures, x.maidens, x.dots) == ("1.0", 16, 1, "1/16", 1, 3)


def test_scorecard_and_dismissals(mini):
    card = {(r.innings_number, r.batter): r for r in innings.scorecard_batting(mini, "m").collect()}
    assert card[1, "C"].dismissal == "caught" and card[1, "C"].fielder == "Y" and card[1, "A"].dismissal is None
    assert [(r.kind, r["count"]) for r in players.dismissals(mini, "A").collect()] == [("run out", 1)]
    total = {r.innings_number: r for r in innings.scorecard_totals(mini, "m").collect()}
    assert (total[1].total, total[1].wickets, total[1].wides, total[1].noballs, total[1].byes) == (18, 2, 1, 1, 2)


def test_impact_ignores_row_order(spark, mini):
    other = Tables(mini.players, mini.matches, mini.innings, mini.deliveries.orderBy(F.xxhash64("ball_number", "over_number")))
    a, b = (sorted(map(str, impact.match_impact(t).collect())) for t in (mini, other))
    assert a == b and len(a) >= 4


@pytest.fixture(scope="module")
def star(spark):
    return tables(spark, "/root/testdata/sf0.001")


def test_phases_and_stages_partition(star):
    b = balls(star, match_type="T20")
    parts = [balls(star, careers.phase(p), match_type="T20").count() for p in ("powerplay", "middle", "death")]
    assert sum(parts) == b.count()
    rows = {r.split: r.innings for r in players.clutch(star, "0000000").collect()}
    assert rows["overall"] == rows["league"] + rows.get("knockouts", 0) + rows.get("placement", 0)


def test_what_if_without_exclusion_changes_nothing(star):
    for r in careers.what_if_batting(star, "0000000", {}).collect():
        assert r.excluded_innings == 0 and r.runs_delta == 0 and r.average_delta == 0.0


def test_fewer_matches_with_exclusions_and_unknown_names(star):
    assert all(r.m_runs is None or r.m_runs <= r.o_runs for r in careers.what_if_batting(star, "0000000", {"opposition": "NATION_3"}).collect())
    assert careers.player_batting(star, "nobody").count() == 0
    assert innings.fastest(star, 100).first().balls_to_reach > innings.fastest(star, 50).first().balls_to_reach
    with pytest.raises(ValueError):
        careers.situational(star, "batting_position")


def test_career_impact_keeps_every_player(spark, mini):
    d = spark.createDataFrame([row(1, k // 6, k % 6, f"B{k:02}", "X", k % 7) for k in range(60)], D)
    got = impact.career_impact(Tables(mini.players, mini.matches, mini.innings, d), "B").collect()
    assert sorted(r.player for r in got) == [f"B{k:02}" for k in range(60)]
    assert [r.average_impact for r in got] == sorted((r.average_impact for r in got), reverse=True)


def test_form_and_streaks_skip_matches_without_an_outcome(spark, mini):
    """Neither winner nor result: NR in the form, skipped by streaks; a draw ends a streak."""
    rows = [("1", "2020-01-01", "S", None), ("2", "2020-01-02", None, None), ("3", "2020-01-03", "S", None), ("4", "2020-01-04", None, "draw"), ("5", "2020-01-05", "S", None), ("6", "2020-01-06", None, "no result"), ("7", "2020-01-07", "T", None)]
    m = spark.createDataFrame([(i, d, "S", "T", "T20", "Oval", w, r) for i, d, w, r in rows], "match_id string, date_start string, team1 string, team2 string, match_type string, venue string, outcome_winner string, outcome_result string")
    t = Tables(mini.players, m.withColumn("date_start", F.col("date_start").cast("date")), mini.innings, mini.deliveries)
    assert [r.result for r in matches.team_form_results(t, "S").collect()] == ["L", "NR", "W", "D", "W", "NR", "W"]
    assert [r.result for r in matches.team_form_results(t, "T").collect()] == ["W", "NR", "L", "D", "L", "NR", "L"]
    assert [(r.team, r.length) for r in matches.team_streaks(t, "wins", min_length=1).collect()] == [("S", 2), ("T", 1), ("S", 1)]
    assert [(r.team, r.length) for r in matches.team_streaks(t, "losses", min_length=1).collect()] == [("T", 2), ("S", 1), ("T", 1)]


def test_career_impact_counts_matches_with_bat_or_ball_only(spark, mini):
    """Y fields in the match but neither bats nor bowls: no row. Two matches, one asked for: the later counts."""
    assert impact.career_impact(mini, "Y").count() == 0 and impact.match_impact(mini, player="Y").count() == 1
    later = lambda df, **c: df.unionByName(df.withColumns({"match_id": F.lit("n"), **c}))
    t = Tables(mini.players, later(mini.matches, date_start=F.date_add("date_start", 1)), later(mini.innings), later(mini.deliveries))
    assert [r.match_id for r in impact.career_impact_matches(t, "X", limit=1).collect()] == ["n"]
    assert impact.career_impact(t, "X").first().matches == 2


def plain_streaks(rows):
    """(key, length, first day, last day, runs, most) of unbroken hits, from rows of (key, day, number, runs, hit)."""
    out, last = [], None
    for key, day, _, runs, hit in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2])):
        if hit and last and last[0] == key:
            last[1:] = [last[1] + 1, min(filter(None, (last[2], day)), default=None), max(filter(None, (last[3], day)), default=None), last[4] + runs, max(last[5], runs)]
        elif hit:
            last = [key, 1, day, day, runs, runs]
            out.append(last)
        else:
            last = None
    return sorted(map(tuple, out), key=str)


def test_streaks_merge_over_years_like_one_pass(spark):
    """Random histories over years: runs across several borders, years without a hit, one day with many rows, no day, a missing key, a test that is null."""
    rng, rows = random.Random(5), []
    for key in (None, "a", "b", "c", "d"):
        for n in range(150):
            day = None if rng.random() < 0.05 else datetime.date(2000 + rng.randrange(9), rng.choice((1, 12)), rng.choice((1, 31)))
            rows.append((key, day, n, rng.randrange(100), {"a": True, "b": False}.get(key, rng.choice((True, True, True, False, None)))))
    df = spark.createDataFrame(rows, "key string, date_start date, n int, runs int, good boolean")
    got = streaks(df.withColumn("most", F.col("runs")), ["key"], F.col("good"), ["date_start", "n"], ("runs",), ("most",))
    assert got.columns == ["key", "length", "start_date", "end_date", "runs", "most"]
    want = plain_streaks(rows)
    assert sorted(map(tuple, got.collect()), key=str) == want and max(r[1] for r in want) == 150
    assert streaks(df.limit(0), ["key"], F.col("good"), ["date_start", "n"]).count() == 0


def test_streaks_have_no_window_over_a_whole_history(spark):
    """Rows are exchanged by key and year; only what is rolled up meets by key."""
    df = spark.range(10).selectExpr("'k' AS key", "date_add(date'2000-01-01', cast(id as int)) AS date_start", "id % 3 = 0 AS good")
    plan = streaks(df, ["key"], F.col("good"), ["date_start"])._jdf.queryExecution().executedPlan().toString()
    keys = [line.split("hashpartitioning(")[1].split("), ")[0] for line in plan.splitlines() if "hashpartitioning(" in line]
    assert len(keys) == 2 and "_slot" in keys[0] and "_year" in keys[1]


def test_buckets_grow_with_the_table_and_documents_need_no_exchange_of_balls(spark, monkeypatch):
    """A task's share of a written table is bounded; documents are put together inside buckets, broadcasts or not."""
    from wicketry.plans import fixture
    from wicketry.sources import ingest, storage

    assert storage.buckets_for(0) == storage.BUCKETS and storage.buckets_for(100 * storage.BUCKET_ROWS + 1) == 101
    monkeypatch.setattr(storage, "BUCKET_ROWS", 300)
    monkeypatch.setattr(fixture, "_written", {})
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    t = fixture.tables(spark, "/root/testdata/sf0.001")
    assert len(t.deliveries.inputFiles()) > storage.BUCKETS and t.rows > 8 * 300
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = ingest.export_documents(t)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange" not in plan


def test_the_window_over_deliveries_has_tasks_by_rows_not_by_the_session(spark, monkeypatch, tmp_path):
    """Two shuffle partitions in the session, many tasks; one exchange, of lineitem."""
    from wicketry.plans import fixture
    from wicketry.sources import storage

    monkeypatch.setattr(storage, "BUCKET_ROWS", 300)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    plans = []
    sql = type(spark).sql
    monkeypatch.setattr(type(spark), "sql", lambda self, text, *a, **k: plans.append(sql(self, text, *a, **k)) or plans[-1])
    try:
        derived = fixture.derive(spark, "/root/testdata/sf0.001", f"file://{tmp_path}")
        plan = plans[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    tasks = re.findall(r"Exchange hashpartitioning\(\(l_orderkey#\d+L div 60\), (\d+)\)", plan)
    assert plan.count("Exchange") == 1 and tasks == [str(storage.buckets_for(6000))]
    assert derived.rows > 300 * storage.BUCKETS
