"""Match documents (JSON) to the star schema, updates, checks and reports."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = """
meta struct<data_version:string,created:string,revision:int>,
info struct<balls_per_over:int,city:string,dates:array<string>,event:struct<name:string,match_number:int,`group`:string,stage:string>,gender:string,match_type:string,
  outcome:struct<winner:string,`by`:struct<runs:int,wickets:int,innings:int>,result:string,method:string>,overs:int,player_of_match:array<string>,registry:struct<people:map<string,string>>,
  season:string,team_type:string,teams:array<string>,toss:struct<decision:string,winner:string>,venue:string>,
innings array<struct<team:string,declared:boolean,forfeited:boolean,super_over:boolean,target:struct<runs:int,overs:int>,
  overs:array<struct<`over`:int,deliveries:array<struct<batter:string,bowler:string,non_striker:string,runs:struct<batter:int,extras:int,total:int,non_boundary:boolean>,
    extras:struct<wides:int,noballs:int,byes:int,legbyes:int,penalty:int>,wickets:array<struct<player_out:string,kind:string,fielders:array<struct<name:string>>>>>>>>>>,
_corrupt_record string
"""


#: Columns of packed documents.
PACKED = "match_id string, document string"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per file, with match_id from the file's name or folder; files that can't be parsed keep their text in _corrupt_record."""
    docs = spark.read.schema(DOCUMENT).option("recursiveFileLookup", True).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return with_match_id(docs)


def with_match_id(docs: DataFrame) -> DataFrame:
    """The match is the stem of the file's name, or what a folder ``match_id=...`` says."""
    folder = F.nullif(F.regexp_extract(F.col("_metadata.file_path"), "/match_id=([^/]+)/", 1), F.lit(""))
    return docs.select("*", F.coalesce(folder, F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")).alias("match_id"))


def write_documents(texts: DataFrame, path: str) -> None:
    """One file per match below ``path``, from rows of match_id and document."""
    texts.select("match_id", "document").write.mode("append").partitionBy("match_id").text(path)


def pack_documents(texts: DataFrame, path: str) -> None:
    """Many documents a file below ``path``, as Parquet rows of match_id and document (what a file of its own would hold)."""
    texts.select("match_id", "document").write.mode("append").parquet(path)


def read_packed(spark: SparkSession, path: str, only: DataFrame | None = None) -> DataFrame:
    """The documents of packed files, as ``read_documents`` gives those of files of their own; of the matches ``only``, if given, others aren't parsed."""
    texts = spark.read.schema(PACKED).parquet(path)
    return parse_documents(texts if only is None else texts.join(only.select("match_id"), "match_id", "left_semi"))


def parse_documents(texts: DataFrame) -> DataFrame:
    """Documents from rows of match_id and document (JSON text), by the same schema; bad texts stay in _corrupt_record. Further columns stay."""
    parsed = F.from_json("document", DOCUMENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    # inlined, as filters move below a projection and would parse each text a second time
    others = [c for c in texts.columns if c != "document"]
    docs = texts.select(*others, F.inline(F.array(parsed)))
    return docs.select(*docs.columns[len(others) :], *others)


def export_documents(t) -> DataFrame:
    """match_id and document: the star schema as match documents again, so that ``flatten`` gives the same rows back.

    Each grouping key is at most a match, whose size has a bound by the rules of the game.
    """
    d, m = t.deliveries, t.matches
    named = lambda c, n: F.col(c).alias(n)
    fielders = F.filter(F.array(F.struct(named("wicket_fielder1", "name")), F.struct(named("wicket_fielder2", "name"))), lambda x: x["name"].isNotNull())
    wickets = F.when(F.col("is_wicket"), F.array(F.struct(named("wicket_player_out", "player_out"), named("wicket_kind", "kind"), fielders.alias("fielders"))))
    ball = F.struct(
        "batter", "bowler", "non_striker", F.struct(*(named(f"runs_{x}", x) for x in ("batter", "extras", "total", "non_boundary"))).alias("runs"),
        F.struct(*(named(f"extras_{x}", x) for x in ("wides", "noballs", "byes", "legbyes", "penalty"))).alias("extras"), wickets.alias("wickets"))
    in_order = lambda n, x, name: F.sort_array(F.collect_list(F.struct(n, x.alias("x"))))["x"].alias(name)
    people = F.array(*(F.struct(named(c, "key"), named(f"{c}_id", "value")) for c in ("batter", "bowler", "non_striker", "wicket_player_out")))
    people = d.select("match_id", F.inline(people)).filter("key IS NOT NULL AND value IS NOT NULL").distinct().groupBy("match_id").agg(F.collect_list(F.struct("key", "value")).alias("people"))
    overs = d.groupBy("match_id", "innings_number", "over_number").agg(in_order("ball_number", ball, "deliveries"))
    played = overs.groupBy("match_id", "innings_number").agg(in_order("over_number", F.struct(named("over_number", "over"), F.col("deliveries")), "overs"))
    # joined by match, the innings only a condition, so that tables bucketed by match meet without an exchange of the balls
    played = played.select(F.col("match_id").alias("_of"), F.col("innings_number").alias("_innings"), "overs")
    innings = t.innings.join(played, (F.col("match_id") == F.col("_of")) & (F.col("innings_number") - F.col("_innings") == 0), "left")
    one = F.struct(named("batting_team", "team"), F.col("declared"), F.col("forfeited"), named("is_super_over", "super_over"), F.struct(named("target_runs", "runs"), named("target_overs", "overs")).alias("target"), F.col("overs"))
    whole = innings.groupBy("match_id").agg(in_order("innings_number", one, "innings"))
    known = F.map_from_entries("people")
    info = F.struct(
        "balls_per_over", "city", F.array_compact(F.array("date_start", "date_end")).cast("array<string>").alias("dates"),
        F.struct(named("event_name", "name"), named("event_match_number", "match_number"), named("event_group", "group"), named("event_stage", "stage")).alias("event"), "gender", "match_type",
        F.struct(named("outcome_winner", "winner"), F.struct(*(named(f"outcome_by_{x}", x) for x in ("runs", "wickets", "innings"))).alias("by"), named("outcome_result", "result"), named("outcome_method", "method")).alias("outcome"),
        named("overs_per_side", "overs"), F.array_compact(F.array("player_of_match")).alias("player_of_match"), F.struct(known.alias("people")).alias("registry"), "season", "team_type", F.array("team1", "team2").alias("teams"),
        F.struct(named("toss_decision", "decision"), named("toss_winner", "winner")).alias("toss"), "venue")
    return m.join(whole, "match_id", "left").join(people, "match_id", "left").select("match_id", F.to_json(F.struct(info.alias("info"), "innings")).alias("document"))


def _good() -> Column:
    good = F.col("_corrupt_record").isNull() & F.col("info").isNotNull() & (F.size("info.teams") >= 2) & (F.size("info.dates") >= 1)
    return F.coalesce(good, F.lit(False))


def split_bad(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents that parsed and have what a match needs, and the quarantine of the others."""
    return docs.filter(_good()), docs.filter(~_good()).select("match_id", "_corrupt_record")


def _person(name: Column) -> Column:
    return F.try_element_at(F.col("people"), name)


def flatten(docs: DataFrame) -> dict[str, DataFrame]:
    """matches, innings, deliveries, and the (id, name) pairs of the registries (A1)."""
    i = lambda c: F.col(f"info.{c}")
    day = lambda c: F.to_date(c)
    at = lambda c, n: F.try_element_at(c, F.lit(n))
    matches = docs.select(
        "match_id", i("match_type").alias("match_type"), i("gender").alias("gender"), i("season").alias("season"), day(at(i("dates"), 1)).alias("date_start"), day(at(i("dates"), -1)).alias("date_end"),
        at(i("teams"), 1).alias("team1"), at(i("teams"), 2).alias("team2"), i("venue").alias("venue"), i("city").alias("city"), i("toss.winner").alias("toss_winner"), i("toss.decision").alias("toss_decision"),
        i("outcome.winner").alias("outcome_winner"), i("outcome.by.runs").alias("outcome_by_runs"), i("outcome.by.wickets").alias("outcome_by_wickets"), i("outcome.by.innings").alias("outcome_by_innings"),
        i("outcome.result").alias("outcome_result"), i("outcome.method").alias("outcome_method"), at(i("player_of_match"), 1).alias("player_of_match"), i("event.name").alias("event_name"),
        i("event.match_number").alias("event_match_number"), i("event.group").alias("event_group"), i("event.stage").alias("event_stage"), i("overs").alias("overs_per_side"), i("balls_per_over").alias("balls_per_over"), i("team_type").alias("team_type"))
    inn = docs.select("match_id", i("registry.people").alias("people"), F.posexplode("innings.overs").alias("pos", "overs")).withColumn("innings_number", F.col("pos") + 1)
    # without the overs, which needn't be read for these
    heads = F.arrays_zip(*(f"innings.{c}" for c in ("team", "declared", "forfeited", "super_over", "target")))
    head = docs.select("match_id", i("teams").alias("teams"), F.posexplode(heads).alias("pos", "x")).withColumn("innings_number", F.col("pos") + 1)
    others = F.filter("teams", lambda t: t != F.col("x.team"))
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    innings = head.select(
        "match_id", "innings_number", F.col("x.team").alias("batting_team"), F.coalesce(at(others, 1), at(F.col("teams"), 2)).alias("bowling_team"), no("x.super_over").alias("is_super_over"),
        no("x.declared").alias("declared"), no("x.forfeited").alias("forfeited"), F.col("x.target.runs").alias("target_runs"), F.col("x.target.overs").alias("target_overs"))
    overs = inn.select("match_id", "innings_number", "people", F.explode("overs").alias("o"))
    d = overs.select("match_id", "innings_number", "people", F.col("o.over").alias("over_number"), F.posexplode("o.deliveries").alias("ball_number", "d"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    wicket = at(F.col("d.wickets"), 1)  # the first wicket of a ball only
    deliveries = d.select(
        "match_id", "innings_number", "over_number", "ball_number", F.col("d.batter").alias("batter"), _person(F.col("d.batter")).alias("batter_id"), F.col("d.bowler").alias("bowler"), _person(F.col("d.bowler")).alias("bowler_id"),
        F.col("d.non_striker").alias("non_striker"), _person(F.col("d.non_striker")).alias("non_striker_id"), zero("d.runs.batter").alias("runs_batter"), zero("d.runs.extras").alias("runs_extras"), zero("d.runs.total").alias("runs_total"),
        no("d.runs.non_boundary").alias("runs_non_boundary"), *(zero(f"d.extras.{x}").alias(f"extras_{x}") for x in ("wides", "noballs", "byes", "legbyes", "penalty")), wicket.isNotNull().alias("is_wicket"),
        wicket.getField("kind").alias("wicket_kind"), wicket.getField("player_out").alias("wicket_player_out"), _person(wicket.getField("player_out")).alias("wicket_player_out_id"),
        at(wicket.getField("fielders"), 1).getField("name").alias("wicket_fielder1"), at(wicket.getField("fielders"), 2).getField("name").alias("wicket_fielder2"))
    people = docs.select("match_id", F.to_date(at(i("dates"), 1)).alias("date_start"), F.explode(i("registry.people")).alias("player_name", "player_id"))
    return {"matches": matches, "innings": innings, "deliveries": deliveries, "people": people}


def registry(people: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row per id with the name seen first (by date, match, name); ids already known are left out."""
    one = people.groupBy("player_id").agg(F.min_by("player_name", F.struct("date_start", "match_id", "player_name")).alias("player_name"))
    if known is not None:
        one = one.join(known.select("player_id"), "player_id", "left_anti")
    empty = F.lit(None).cast("string")
    return one.select("player_id", "player_name", *(empty.alias(c) for c in ("batting_style", "bowling_style", "bowling_style_broad", "bowling_style_arm", "playing_role", "country")))


@contextmanager
def parsed_once(docs: DataFrame, path: str) -> Iterator[DataFrame]:
    """``docs`` written below the table's ``path`` and read again, so that each table reads the parsed fields it needs; they go at the end."""
    from .storage import remove

    spark, at = docs.sparkSession, f"{path}/_parsed-{uuid.uuid4().hex}"
    try:
        docs.write.parquet(at)
        yield spark.read.schema(docs.schema).parquet(at)
    finally:
        remove(spark, at)


def rebuild(docs: DataFrame, path: str, buckets: int | None = None, without: tuple[str, ...] | None = None) -> None:
    """Put the tables of some good documents in place of all batches (A4)."""
    from . import storage

    with parsed_once(docs, path) as once:
        storage.rebuild(docs.sparkSession, load(once), path, buckets, without)


def unseen(docs: DataFrame, matches: DataFrame) -> DataFrame:
    """Documents whose match isn't there yet; a match that comes twice counts once (A5)."""
    return docs.dropDuplicates(["match_id"]).join(matches.select("match_id"), "match_id", "left_anti")


def load(docs: DataFrame, known_players: DataFrame | None = None) -> dict[str, DataFrame]:
    """The four tables of a set of documents."""
    t = flatten(docs)
    return {"players": registry(t.pop("people"), known_players), **t}


def _marked(docs: DataFrame, matches: DataFrame) -> DataFrame:
    """Documents with ``_known`` (the match is there; its text isn't parsed) and ``_good`` (to be added)."""
    known = matches.select("match_id", F.lit(True).alias("_known")).distinct()
    docs = docs.join(known, "match_id", "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    if "document" in docs.columns:
        docs = parse_documents(docs.withColumn("document", F.when(~F.col("_known"), F.col("document"))))
    return docs.withColumn("_good", ~F.col("_known") & _good())


def add(docs: DataFrame, path: str, stream: tuple[str, int] | None = None) -> dict[str, int]:
    """Append the unseen matches of some documents, and quarantine the bad ones, as one batch; counts of added, skipped, failed.

    ``docs`` are parsed documents or rows of match_id and document. As in the reference, a document whose match is there is skipped
    before it is parsed, whatever it holds.

    Tables and quarantine become visible at once, or none, so after a failure the same documents can be read again: matches
    that are there are skipped, and a bad document is quarantined once. ``stream`` is the name and number of a stream's batch;
    a number that was committed before adds nothing.
    """
    from .storage import QUARANTINE, current, scan, write_star

    spark = docs.sparkSession
    state = current(spark, path)
    if stream and state["streams"].get(stream[0], -1) >= stream[1]:
        return {"added": 0, "skipped": 0, "failed": 0}
    have = scan(spark, path, state["version"])
    with parsed_once(_marked(docs, have["matches"]), path) as once:
        by_match = once.groupBy("match_id").agg(F.max("_known").alias("known"), F.count_if("_good").alias("good"), F.count_if(~F.col("_known") & ~F.col("_good")).alias("bad"))
        added, skipped, rows, failed = by_match.agg(F.count_if(F.col("good") > 0), F.count_if("known"), *(F.coalesce(F.sum(c), F.lit(0)) for c in ("good", "bad"))).first()
        new = once.filter("_good")
        if added < rows:  # documents are dealt by match only if some match comes twice
            new = new.dropDuplicates(["match_id"])
        bad = once.filter("NOT _known AND NOT _good").select("match_id", "_corrupt_record")
        held = have[QUARANTINE].select("match_id", F.col("_corrupt_record").alias("_held"))
        fresh = bad.join(held, (bad.match_id == held.match_id) & bad._corrupt_record.eqNullSafe(held._held), "left_anti").distinct()
        tables = (load(new, have["players"]) if added else {}) | ({QUARANTINE: fresh} if failed and not fresh.isEmpty() else {})
        if tables:
            write_star(tables, path, stream=stream)
        return {"added": added, "skipped": skipped, "failed": failed}


def update(spark: SparkSession, feed: str, path: str, packed: bool = False) -> dict[str, int]:
    """Append the unseen matches of a feed folder (of packed files, if so said) to the tables below ``path``; counts of added, skipped, failed (A5)."""
    return add(spark.read.schema(PACKED).parquet(feed) if packed else read_documents(spark, feed), path)


FEEDS = (2, 7, 30)


def freshness(matches: DataFrame, today: str) -> DataFrame:
    """Days behind, the smallest feed that covers them, and the state (A10)."""
    x = matches.agg(F.count("*").alias("matches"), F.max("date_start").alias("latest")).withColumn("days_behind", F.date_diff(F.lit(today).cast("date"), "latest"))
    feed = F.coalesce(*(F.when(F.col("days_behind") + 1 <= d, d) for d in FEEDS))
    x = x.withColumn("feed_days", feed)
    state = F.when(F.col("latest").isNull() | F.col("feed_days").isNull(), "needs rebuild").when(F.col("days_behind") <= 1, "fresh").when(F.col("days_behind") > 10, "stale").otherwise("ok")
    return x.withColumn("state", state)


def summary(tables: dict[str, DataFrame], bad: DataFrame | None = None) -> DataFrame:
    """Row counts by table, failed files, enriched players."""
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n") for name, df in tables.items()]
    counts.append(tables["players"].agg(F.count_if(F.col("batting_style").isNotNull() | F.col("bowling_style").isNotNull()).alias("n")).select(F.lit("enriched_players").alias("what"), "n"))
    if bad is not None:
        counts.append(bad.agg(F.count("*").alias("n")).select(F.lit("failed_files").alias("what"), "n"))
    return reduce(DataFrame.unionByName, counts)
