"""Source documents: defaults, bad files, updates, stream, metadata."""

import json
import os

import pytest
from pyspark.sql import functions as F

from wicketry.operators import careers, matches
from wicketry.plans.fixture import Tables
from wicketry.plans.grains import participation
from wicketry.sources import checks, enrichment, ingest, storage
from wicketry.streaming.feed import follow


def ball(batter="A", bowler="X", runs=0, **more):
    return {"batter": batter, "bowler": bowler, "non_striker": "B", "runs": {"batter": runs, "extras": 0, "total": runs}, **more}


def document(**info):
    return {"meta": {"data_version": "1", "created": "2020-01-01", "revision": 1},
            "info": {"balls_per_over": 6, "dates": ["2020-01-02", "2020-01-03"], "gender": "male", "match_type": "T20", "outcome": {"winner": "S", "by": {"runs": 3}}, "season": "2020", "teams": ["S", "T"],
                     "registry": {"people": {"A": "a1", "B": "b1", "X": "x1"}}, **info},
            "innings": [{"team": "S", "overs": [{"over": 0, "deliveries": [ball(runs=4), ball(extras={"wides": 1}), ball(wickets=[{"player_out": "A", "kind": "caught", "fielders": [{"name": "X"}, {"name": "Y"}]}, {"player_out": "B", "kind": "run out"}])]}]},
                        {"team": "T", "super_over": True, "target": {"runs": 5, "overs": 1}, "overs": [{"over": 0, "deliveries": [ball("Z", "A", 6)]}]}]}


@pytest.fixture
def feed(tmp_path):
    d = tmp_path / "feed"
    d.mkdir()
    (d / "1.json").write_text(json.dumps(document()))
    (d / "2.json").write_text(json.dumps(document(season=2021, venue="Oval", toss={"decision": "bat", "winner": "T"}, event={"name": "Cup", "stage": "Final"}, player_of_match=["A", "B"])))
    no_people = document()
    del no_people["info"]["registry"], no_people["innings"]
    (d / "3.json").write_text(json.dumps(no_people))
    (d / "4.json").write_text('{"info": {"teams": ')
    return str(d)


def test_flatten_and_bad_files(spark, feed):
    good, bad = ingest.split_bad(ingest.read_documents(spark, feed))
    assert [r.match_id for r in bad.collect()] == ["4"]
    t = ingest.load(good)
    m = {r.match_id: r for r in t["matches"].collect()}
    assert set(m) == {"1", "2", "3"} and m["2"].season == "2021" and m["2"].player_of_match == "A" and m["1"].venue is None
    assert str(m["1"].date_start) == "2020-01-02" and str(m["1"].date_end) == "2020-01-03" and m["1"].outcome_by_runs == 3
    d = t["deliveries"].filter("match_id = '1'").orderBy("innings_number", "ball_number").collect()
    assert len(d) == 4 and d[0].runs_batter == 4 and d[0].extras_wides == 0 and d[1].extras_wides == 1 and not d[0].is_wicket
    assert (d[2].wicket_player_out, d[2].wicket_kind, d[2].wicket_fielder1, d[2].wicket_fielder2, d[2].wicket_player_out_id) == ("A", "caught", "X", "Y", "a1")
    assert d[3].batter == "Z" and d[3].batter_id is None
    i = t["innings"].filter("match_id = '1'").orderBy("innings_number").collect()
    assert i[0].bowling_team == "T" and not i[0].is_super_over and i[1].is_super_over and i[1].target_runs == 5 and i[1].bowling_team == "S"
    assert sorted(r.player_id for r in t["players"].collect()) == ["a1", "b1", "x1"]
    assert {r.check: r.violations for r in checks.integrity(t).collect()}["orphan_deliveries"] == 0


def test_update_and_stream_add_only_what_is_new(spark, feed, tmp_path):
    base, other = f"file://{tmp_path}/star", f"file://{tmp_path}/star2"
    good, _ = ingest.split_bad(ingest.read_documents(spark, feed))
    for path in (base, other):
        storage.rebuild(spark, ingest.load(good.filter("match_id = '1'")), path)
    assert ingest.update(spark, feed, base) == {"added": 2, "skipped": 1, "failed": 1}
    assert ingest.update(spark, feed, base) == {"added": 0, "skipped": 3, "failed": 1}
    follow(spark, f"file://{feed}", other, f"file://{tmp_path}/cp").awaitTermination(120)
    for name in storage.STAR:
        a, b = (storage.scan(spark, p)[name] for p in (base, other))
        cols = sorted(a.columns)
        assert sorted(map(str, a.select(*cols).collect())) == sorted(map(str, b.select(*cols).collect())), name
    storage.rebuild(spark, ingest.load(good), other)
    assert storage.scan(spark, other)["matches"].count() == 3


@pytest.mark.parametrize("table", ["deliveries", "matches"])
def test_a_failed_write_is_made_good_by_the_next(spark, feed, tmp_path, table):
    base = f"file://{tmp_path}/star"
    good, _ = ingest.split_bad(ingest.read_documents(spark, feed))
    storage.rebuild(spark, ingest.load(good.filter("match_id = '1'")), base)
    new = ingest.load(good.filter("match_id != '1'"))
    new[table] = new[table].withColumn("match_id", F.when(F.length("match_id") > 0, F.raise_error(F.lit("lost"))).cast("string"))
    with pytest.raises(Exception, match="lost"):
        storage.write_star(new, base)
    seen = storage.scan(spark, base)
    assert all([r.match_id for r in seen[t].select("match_id").distinct().collect()] == ["1"] for t in ("matches", "innings", "deliveries"))
    assert ingest.update(spark, feed, base) == {"added": 2, "skipped": 1, "failed": 1}
    got, want = storage.scan(spark, base), ingest.load(good)
    for name in ("matches", "innings", "deliveries"):
        cols = sorted(want[name].columns)
        assert sorted(map(str, got[name].select(*cols).collect())) == sorted(map(str, want[name].select(*cols).collect())), name
    assert len(list((tmp_path / "star" / "innings").glob("batch=*"))) == 2


def grown(spark, tmp_path, n=3):
    """A table of one match a batch, and the matches."""
    base = f"file://{tmp_path}/grown"
    for i in range(n):
        d = tmp_path / f"f{i}"
        d.mkdir()
        (d / f"{i}.json").write_text(json.dumps(document(season=2000 + i)))
        good, _ = ingest.split_bad(ingest.read_documents(spark, str(d)))
        if i:
            assert ingest.update(spark, str(d), base)["added"] == 1
        else:
            storage.rebuild(spark, ingest.load(good), base, buckets=4)
    return base


def rows(tables):
    return {n: sorted(map(str, tables[n].select(*sorted(tables[n].columns)).collect())) for n in (*storage.STAR, *storage.GRAINS)}


def test_small_updates_are_compacted_into_few_files(spark, tmp_path):
    base = grown(spark, tmp_path)
    before, old = rows(storage.scan(spark, base)), storage.scan(spark, base)
    assert len(storage.current(spark, base)["batches"]) == 3
    storage.compact(spark, base, buckets=2)
    assert rows(old) == before  # a reader that has begun keeps its batches
    after = storage.scan(spark, base)
    assert rows(after) == before and len(storage.current(spark, base)["batches"]) == 1
    storage.vacuum(spark, base)
    for name in ("matches", "innings", "deliveries"):
        assert len([f for f in (tmp_path / "grown" / name).rglob("*.parquet")]) <= 2 and len(list((tmp_path / "grown" / name).glob("batch=*"))) == 1
    assert rows(storage.scan(spark, base)) == before


def test_kept_grains_equal_a_recomputation(spark, tmp_path):
    have = storage.scan(spark, grown(spark, tmp_path, 2))
    for name, want in storage.grains(have["deliveries"]).items():
        assert sorted(map(str, have[name].select(*want.columns).collect())) == sorted(map(str, want.collect())), name


def test_joins_and_grains_by_match_need_no_exchange(spark, tmp_path):
    """Over several batches too."""
    base = grown(spark, tmp_path, 2)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        have = storage.scan(spark, base)
        for df in (storage.grains(have["deliveries"])["batting"], have["batting"].groupBy("match_id").count()):
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        storage.compact(spark, base)
        have = storage.scan(spark, base)
        plan = have["deliveries"].join(have["matches"], "match_id").groupBy("match_id", "innings_number", "batter").count()._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("step", ["deliveries", "batting", "commit", "half a pointer"])
def test_a_crash_at_any_step_leaves_the_old_table(spark, tmp_path, monkeypatch, step):
    base = grown(spark, tmp_path, 2)
    before = rows(storage.scan(spark, base))
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "9.json").write_text(json.dumps(document(season=2030)))
    good, _ = ingest.split_bad(ingest.read_documents(spark, str(tmp_path / "more")))
    acts = [lambda: ingest.update(spark, str(tmp_path / "more"), base), lambda: storage.compact(spark, base), lambda: storage.rebuild(spark, ingest.load(good), base)]
    for act in acts if step == "commit" else acts[:1]:
        with monkeypatch.context() as m:
            if step == "commit":
                m.setattr(storage, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
            elif step == "half a pointer":
                n = storage.current(spark, base)["version"]
                m.setattr(storage, "commit", lambda *a: (tmp_path / "grown" / "_pointer" / f"v{n + 1:09d}.json").write_text('{"version": ') and (_ for _ in ()).throw(OSError("lost")))
            else:
                sort = dict(storage.SORTED) | {step: ("no_such_column",)}
                m.setattr(storage, "SORTED", sort)
            with pytest.raises(Exception):  # noqa: B017
                act()
        assert rows(storage.scan(spark, base)) == before
        for f in (tmp_path / "grown" / "_pointer").glob("v*.json"):
            if f.read_text() == '{"version": ':
                f.unlink()
    assert ingest.update(spark, str(tmp_path / "more"), base)["added"] == 1
    live = {b["id"] for v in storage.versions(spark, base) for b in v["batches"]}
    assert {p.name[6:] for n in storage.STAR for p in (tmp_path / "grown" / n).glob("batch=*")} <= live


def test_two_writers_do_not_both_commit(spark, tmp_path):
    base = grown(spark, tmp_path, 1)
    state = storage.current(spark, base)
    with pytest.raises(OSError, match="another writer"):
        storage.commit(spark, base, state)
    assert storage.current(spark, base) == state


def test_stream_quarantines_bad_documents_once(spark, feed, tmp_path, monkeypatch):
    """A batch that fails after its commit is repeated and adds nothing; a bad file is seen after a restart, once."""
    base, cp = f"file://{tmp_path}/star", f"file://{tmp_path}/cp"
    good, _ = ingest.split_bad(ingest.read_documents(spark, feed))
    storage.rebuild(spark, ingest.load(good.filter("match_id = '1'")), base)
    commit = storage.commit
    with monkeypatch.context() as m:
        m.setattr(storage, "commit", lambda *a: (commit(*a), (_ for _ in ()).throw(OSError("driver lost"))))
        with pytest.raises(Exception, match="driver lost"):
            follow(spark, f"file://{feed}", base, cp).awaitTermination(120)
    version = storage.current(spark, base)["version"]
    follow(spark, f"file://{feed}", base, cp).awaitTermination(120)
    have = storage.scan(spark, base)
    assert storage.current(spark, base)["version"] == version
    assert [r.match_id for r in have["quarantine"].collect()] == ["4"] and sorted(r.match_id for r in have["matches"].collect()) == ["1", "2", "3"]
    (tmp_path / "feed" / "5.json").write_text("{broken")
    follow(spark, f"file://{feed}", base, cp).awaitTermination(120)
    assert ingest.update(spark, feed, base) == {"added": 0, "skipped": 3, "failed": 2}
    storage.compact(spark, base)
    have = storage.scan(spark, base)
    assert sorted(r.match_id for r in have["quarantine"].collect()) == ["4", "5"] and have["deliveries"].count() == 8


def test_metadata(spark, tmp_path):
    players = spark.createDataFrame([(str(i), f"P{i}", "old", None) for i in range(9)], "player_id string, player_name string, batting_style string, bowling_style string")
    (tmp_path / "m.csv").write_text("identifier,batting_style,bowling_style\n1,Left,Right-arm fast\n1,Left,Right-arm fast\n2,,Legbreak\n3,x,Slow left-arm chinaman\n4,x,Right-arm medium\n5,x,Left-arm orthodox medium\n6,x,Underarm\n,y,z\n")
    got = {r.player_id: r for r in enrichment.derive_style_groups(enrichment.enrich(players, enrichment.read_metadata(spark, f"file://{tmp_path}/m.csv"))).collect()}
    assert len(got) == 9 and got["1"].batting_style == "Left" and got["2"].batting_style is None and got["7"].batting_style == "old"
    groups = {k: (r.bowling_style_broad, r.bowling_style_arm) for k, r in got.items()}
    assert groups["1"] == ("Pace", "Right-arm Pace") and groups["2"] == ("Spin", "Right-arm Spin") and groups["3"] == ("Spin", "Left-arm Spin")
    assert groups["4"] == ("Pace", "Right-arm Pace") and groups["5"] == ("Spin", "Left-arm Spin") and groups["6"] == ("Unknown", "Unknown") and groups["7"] == (None, None)
    (tmp_path / "n.csv").write_text("name,batting_style\na,b\n")
    (tmp_path / "o.csv").write_text("player_id,shoe\n1,b\n")
    for bad in ("n.csv", "o.csv"):
        with pytest.raises(ValueError):
            enrichment.read_metadata(spark, f"file://{tmp_path}/{bad}")
    same, why = enrichment.enriched_or_same(spark, players, f"file://{tmp_path}/absent.csv")
    assert why and same.count() == 9


def test_freshness_states(spark):
    for day, state in (("2020-01-02", "fresh"), ("2020-01-06", "ok"), ("2020-01-20", "stale"), ("2020-05-01", "needs rebuild")):
        m = spark.createDataFrame([("1", "2020-01-01")], "match_id string, d string").select("match_id", F.col("d").cast("date").alias("date_start"))
        assert ingest.freshness(m, day).first().state == state
    assert ingest.freshness(spark.createDataFrame([], "match_id string, date_start date"), "2020-01-01").first().state == "needs rebuild"


def test_integrity_counts_what_joins_count(spark):
    """Orphans, repeats, missing keys and overs of no phase, planted; equal to anti joins and groups counted one by one."""
    m = spark.createDataFrame([("1", "T20"), ("1", "T20"), ("2", "ODI"), (None, "T20"), (None, "IT20"), ("5", "IT20"), ("6", None)], "match_id string, match_type string")
    i = spark.createDataFrame([("1", 1), ("1", 1), ("2", 1), ("9", 1), (None, 1), ("5", None), ("5", None)], "match_id string, innings_number int")
    d = spark.createDataFrame([("1", 1, 0, 1), ("1", 1, 0, 1), ("1", 1, 0, 1), ("1", 1, 20, 1), ("1", 2, None, 1), ("2", 1, 30, 1), ("9", 1, 25, 0), ("8", 1, 0, 0), (None, 1, 40, 1), (None, 1, 40, 1), ("5", None, 19, 1), ("5", 1, -1, 1), ("5", 1, -1, 1), ("6", 1, 77, 1)],
                              "match_id string, innings_number int, over_number int, ball_number int")
    p = spark.createDataFrame([("a",), ("a",), (None,), (None,), ("b",)], "player_id string")
    got = {r.check: r.violations for r in checks.integrity({"matches": m, "innings": i, "deliveries": d, "players": p}).collect()}
    twice = lambda df, *k: df.groupBy(*k).count().filter("count > 1").count()
    t20 = d.join(m.filter("match_type IN ('T20', 'IT20')"), "match_id", "left_semi")
    assert got == {"orphan_deliveries": d.join(m, "match_id", "left_anti").count(), "orphan_innings": i.join(m, "match_id", "left_anti").count(), "deliveries_without_innings": d.join(i, ["match_id", "innings_number"], "left_anti").count(),
                   "repeated_matches": twice(m, "match_id"), "repeated_innings": twice(i, "match_id", "innings_number"), "repeated_deliveries": twice(d, "match_id", "innings_number", "over_number", "ball_number"),
                   "repeated_players": twice(p, "player_id"), "overs_outside_phases": t20.filter("NOT over_number BETWEEN 0 AND 19").count()}
    assert min(got.values()) > 0
    assert all(r.violations == 0 for r in checks.integrity({k: v.limit(0) for k, v in {"matches": m, "innings": i, "deliveries": d, "players": p}.items()}).collect())


def listed(df):
    return {r.check: r.violations for r in df.collect()}


def test_kept_checks_equal_a_recount(spark, tmp_path):
    """Planted violations in one batch, a clean update beside it: the pointer, the kept grain and a recount agree, also once compacted."""
    have = storage.scan(spark, grown(spark, tmp_path, 1))
    d, i, m, p = (have[n] for n in ("deliveries", "innings", "matches", "players"))
    planted = {"deliveries": d.union(d.limit(2)).union(d.limit(1).withColumn("match_id", F.lit("nowhere"))).union(d.limit(1).withColumn("innings_number", F.lit(7))).union(d.limit(1).withColumn("over_number", F.lit(31))).union(d.limit(1).withColumn("match_id", F.lit(None).cast("string"))),
               "innings": i.union(i.limit(1)).union(i.limit(1).withColumn("match_id", F.lit("elsewhere"))), "matches": m.union(m.limit(1)), "players": p.union(p.limit(1))}
    base = str(tmp_path / "planted")
    storage.write_star(planted, base, buckets=2)
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "9.json").write_text(json.dumps(document(season=2030)))
    assert ingest.update(spark, str(tmp_path / "more"), base)["added"] == 1
    for _ in range(2):
        tables = storage.scan(spark, base)
        want = listed(checks.integrity(tables))
        assert want == listed(checks.integrity_kept(tables)) == storage.violations(spark, base) and min(want.values()) > 0
        storage.compact(spark, base)
    storage.write_star({"matches": m}, base)  # a match in a second batch, by a writer that doesn't look
    assert listed(checks.integrity_kept(storage.scan(spark, base)))["repeated_matches"] == want["repeated_matches"] == m.count()


def test_checks_and_distinct_matches_need_no_exchange_by_match(spark, tmp_path):
    """Distinct matches by player have none, careers, venues and milestones one, for the roll-up; checks one, of rows by match."""
    base = grown(spark, tmp_path, 2)
    storage.compact(spark, base)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        have = storage.scan(spark, base)
        t = Tables(**{n: have[n] for n in (*storage.STAR, *storage.GRAINS)})
        exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        assert exchanges(checks.match_checks(have)) == 1 and exchanges(participation(t)) == 0
        for df in (careers.batting_records(t), careers.emerging(t, "batting", "average", recent="2020"), matches.venue_stats(t), participation(t).groupBy("player_id").count()):
            assert exchanges(df) == 1
        assert sorted(map(tuple, participation(t).collect())) == sorted(map(tuple, participation(Tables(*(have[n] for n in ("players", "matches", "innings", "deliveries")))).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_packed_documents_give_what_files_of_their_own_give(spark, feed, tmp_path):
    """Many documents a file, a match that comes twice and a bad one included: same counts and tables, by update and by stream."""
    texts = spark.read.option("wholetext", True).text(feed).select(F.regexp_replace(F.input_file_name(), r".*/(\w+)\.json$", "$1").alias("match_id"), F.col("value").alias("document"))
    packed = f"file://{tmp_path}/packed"
    ingest.pack_documents(texts.unionByName(texts.filter("match_id = '2'")).coalesce(1), packed)
    assert len(list((tmp_path / "packed").glob("*.parquet"))) == 1
    good, _ = ingest.split_bad(ingest.read_packed(spark, packed))
    found = {}
    for name in ("own", "update", "stream"):
        path = f"file://{tmp_path}/{name}"
        ingest.rebuild(good.filter("match_id = '1'"), path)
        if name == "stream":
            follow(spark, packed, path, f"file://{tmp_path}/cp-packed", packed=True).awaitTermination(120)
        else:
            assert ingest.update(spark, packed if name == "update" else feed, path, packed=name == "update") == {"added": 2, "skipped": 1, "failed": 1}
        found[name] = {k: sorted(map(str, df.collect())) for k, df in storage.scan(spark, path).items()}
        assert not list((tmp_path / name).glob("_parsed-*"))
    assert found["own"] == found["update"] == found["stream"] and len(found["own"]["matches"]) == 3


def test_jobs_through_files_write_no_file_for_each_match(spark):
    """The registered queries pack their documents, and only do the steps they need."""
    from wicketry.plans import file_queries
    from wicketry.plans.fixture import tables

    jobs = file_queries.Jobs(tables(spark, "/root/testdata/sf0.001"))
    assert len(spark.read.parquet(jobs.feed).inputFiles()) < jobs.t.matches.count()
    assert "updated" not in jobs.__dict__ and "streamed" not in jobs.__dict__


def test_a_document_is_parsed_once_and_innings_leave_balls_unread(spark, feed, tmp_path):
    """The plan of the good documents holds one parser; innings read no overs of parsed files; balls and people keep their order and ids."""
    texts = spark.createDataFrame([("1", json.dumps(document())), ("2", "{broken"), ("3", None)], ingest.PACKED)
    good, bad = ingest.split_bad(ingest.parse_documents(texts.repartition(2)))
    parsers = [df._jdf.queryExecution().optimizedPlan().toString().count("from_json(") for df in (good, bad, good.select("info.season"))]
    assert parsers == [1, 1, 1]
    assert [r.match_id for r in good.collect()] == ["1"] and sorted((r.match_id, r._corrupt_record) for r in bad.collect()) == [("2", "{broken"), ("3", None)]
    packed, parsed = f"file://{tmp_path}/packed", f"file://{tmp_path}/parsed"
    ingest.pack_documents(texts, packed)
    assert [r.match_id for r in ingest.read_packed(spark, packed, spark.createDataFrame([("2",)], "match_id string")).collect()] == ["2"]
    good.write.parquet(parsed)
    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)
    try:
        plan = ingest.flatten(spark.read.schema(good.schema).parquet(parsed))["innings"]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "target:" in plan.split("ReadSchema:")[1] and "overs:array" not in plan.split("ReadSchema:")[1]
    t = ingest.load(good)
    again = ingest.load(ingest.parse_documents(ingest.export_documents(Tables(*(t[n] for n in ("players", "matches", "innings", "deliveries"))))))
    for name in ("matches", "innings", "deliveries"):
        assert sorted(map(str, again[name].collect())) == sorted(map(str, t[name].collect())), name


def test_a_known_match_is_skipped_before_it_is_parsed(spark, feed, tmp_path):
    """Whatever its text holds, by update and by stream, as in the reference; other bad texts are quarantined."""
    texts = spark.createDataFrame([("1", "{broken"), ("1", "{broken again"), ("2", json.dumps(document())), ("4", "{broken")], ingest.PACKED)
    packed = f"file://{tmp_path}/packed"
    ingest.pack_documents(texts, packed)
    good, _ = ingest.split_bad(ingest.read_documents(spark, feed))
    for name in ("update", "stream"):
        path = f"file://{tmp_path}/{name}"
        ingest.rebuild(good.filter("match_id = '1'"), path)
        if name == "stream":
            follow(spark, packed, path, f"file://{tmp_path}/cp-known", packed=True).awaitTermination(120)
        else:
            assert ingest.update(spark, packed, path, packed=True) == {"added": 1, "skipped": 1, "failed": 1}
        have = storage.scan(spark, path)
        assert sorted(r.match_id for r in have["matches"].collect()) == ["1", "2"] and [r.match_id for r in have["quarantine"].collect()] == ["4"]


def test_bowling_grain_reads_the_balls_once(spark, tmp_path):
    have = storage.scan(spark, grown(spark, tmp_path, 1))
    plan = storage.grains(have["deliveries"])["bowling"]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan


def test_a_table_keeps_only_what_is_asked_of_it(spark, tmp_path):
    """Below the size from which operators ask the index, none is written, in later batches neither; the derived tables have it as a plan. Other tables keep all."""
    from wicketry.plans import file_queries
    from wicketry.plans.fixture import tables
    from wicketry.sources import names, storage

    t = tables(spark, "/root/testdata/sf0.001")
    assert t.appearances.count() > 0 and t.grams.count() > 0
    assert not [f for f in t.deliveries.inputFiles() if os.path.exists(f.split("/deliveries/")[0].removeprefix("file://") + "/appearances")]
    path = file_queries.Jobs(t).updated[0]
    state = storage.current(spark, path)
    assert len(state["batches"]) == 2 and all("appearances" not in b["columns"] and "checks" in b["columns"] and "violations" in b for b in state["batches"])
    assert names.unasked(names.FROM) == () and state["without"] == ["index"]
    storage.compact(spark, path)
    assert "appearances" not in storage.scan(spark, path) and "checks" in storage.scan(spark, path)
    kept = f"file://{tmp_path}/kept"
    storage.write_star(t.star(), kept)
    assert {"appearances", "grams", "checks"} <= set(storage.scan(spark, kept)) and "without" not in storage.current(spark, kept)
