"""The cricket star schema derived from the supplied order tables by integer arithmetic.

One text serves both engines; ``DIV`` stands for integer division. Spark writes the four tables once per application
and folder, so that every query scans bucketed columnar files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.names import appearances, grams, unasked
from ..sources.storage import CHECKS, GRAINS, INDEX, STAR, buckets_for, live_rows, remove, scan, shared_path, write_star

STEPS = """
l0 AS (SELECT *, l_orderkey DIV 60 AS mk, row_number() OVER (PARTITION BY l_orderkey DIV 60
         ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS seq FROM lineitem),
l1 AS (SELECT *, mk % 5 = 3 AS is_test, CASE WHEN mk % 5 = 3 THEN 60 ELSE 120 END AS ilen, seq < 240 AS main FROM l0
       WHERE seq < 240 OR (seq < 252 AND mk % 8 = 0 AND mk % 5 <> 3)),
l2 AS (SELECT *, CASE WHEN main THEN seq DIV ilen + 1 ELSE 3 + (seq - 240) DIV 6 END AS inn,
         CASE WHEN main THEN seq % ilen ELSE (seq - 240) % 6 END AS bi, mk % 10 AS t1, (mk + 1 + (mk DIV 10) % 9) % 10 AS t2 FROM l1),
l3 AS (SELECT *, CASE (mk + inn) % 3 WHEN 0 THEN 10 WHEN 1 THEN 5 ELSE 2 END AS ns, bi DIV 6 AS ov,
         CASE WHEN (inn % 2 = 1) = (mk % 2 = 0) THEN t1 ELSE t2 END AS bt, CASE WHEN (inn % 2 = 1) = (mk % 2 = 0) THEN t2 ELSE t1 END AS ot,
         CAST(floor(l_quantity) AS BIGINT) % 13 AS q, l_partkey % 8 AS k, l_partkey % 40 AS x FROM l2),
l4 AS (SELECT *, CASE WHEN main THEN (bi * ns) DIV ilen ELSE 0 END AS seg, main AND ((bi + 1) * ns) DIV ilen > (bi * ns) DIV ilen AS seg_end FROM l3),
l5 AS (SELECT *, seg_end AND (mk % 4 = 0 OR l_returnflag IN ('A', 'R')) AS wkt FROM l4),
l6 AS (SELECT *, CASE WHEN wkt THEN CASE WHEN k = 3 AND l_suppkey % 2 = 0 THEN seg + 1 ELSE seg END
                      WHEN l_linenumber <= 4 THEN seg ELSE seg + 1 END AS sp,
         CASE WHEN wkt OR x IN (0, 2, 3) OR q < 5 THEN 0 WHEN q < 9 THEN 1 WHEN q = 9 THEN 2 WHEN q < 12 THEN 4 ELSE 6 END AS rb,
         CASE WHEN NOT wkt AND x < 4 THEN 1 ELSE 0 END AS rx FROM l5),
l7 AS (SELECT *, bt * 11 + sp AS bat_key, bt * 11 + 2 * seg + 1 - sp AS ns_key,
         ot * 11 + CASE WHEN ov % 2 = 0 THEN 6 + (ov DIV 2) % 3 ELSE 9 + (mk + ov DIV 10) % 2 END AS bowl_key,
         CASE WHEN wkt THEN bt * 11 + seg END AS out_key,
         CASE WHEN wkt AND k IN (2, 3, 6, 7) THEN ot * 11 + l_suppkey % 11 END AS f1_key,
         CASE WHEN wkt AND k = 3 AND l_suppkey % 3 = 0 THEN ot * 11 + (l_suppkey + 1) % 11 END AS f2_key FROM l6),
names AS (SELECT CAST(c_custkey AS BIGINT) AS pk, c_name AS pn, c_mktsegment AS seg_name FROM customer WHERE c_custkey < 110),
deliveries AS (SELECT CAST(mk AS STRING) AS match_id, CAST(inn AS INT) AS innings_number, CAST(ov AS INT) AS over_number, CAST(bi % 6 AS INT) AS ball_number,
    b.pn AS batter, CAST(bat_key AS STRING) AS batter_id, w.pn AS bowler, CAST(bowl_key AS STRING) AS bowler_id, n.pn AS non_striker, CAST(ns_key AS STRING) AS non_striker_id,
    CAST(rb AS INT) AS runs_batter, CAST(rx AS INT) AS runs_extras, CAST(rb + rx AS INT) AS runs_total, l_suppkey % 20 = 0 AS runs_non_boundary,
    CAST(CASE WHEN rx = 1 AND x = 0 THEN 1 ELSE 0 END AS INT) AS extras_wides, CAST(CASE WHEN rx = 1 AND x = 1 THEN 1 ELSE 0 END AS INT) AS extras_noballs,
    CAST(CASE WHEN rx = 1 AND x = 2 THEN 1 ELSE 0 END AS INT) AS extras_byes, CAST(CASE WHEN rx = 1 AND x = 3 THEN 1 ELSE 0 END AS INT) AS extras_legbyes, CAST(0 AS INT) AS extras_penalty,
    wkt AS is_wicket, CASE WHEN wkt THEN CASE k WHEN 0 THEN 'bowled' WHEN 1 THEN 'lbw' WHEN 2 THEN 'stumped' WHEN 3 THEN 'run out'
        WHEN 4 THEN 'caught and bowled' WHEN 5 THEN 'hit wicket' ELSE 'caught' END END AS wicket_kind,
    o.pn AS wicket_player_out, CAST(out_key AS STRING) AS wicket_player_out_id, f1.pn AS wicket_fielder1, f2.pn AS wicket_fielder2
  FROM l7 JOIN names b ON b.pk = bat_key JOIN names w ON w.pk = bowl_key JOIN names n ON n.pk = ns_key
    LEFT JOIN names o ON o.pk = out_key LEFT JOIN names f1 ON f1.pk = f1_key LEFT JOIN names f2 ON f2.pk = f2_key),
tot AS (SELECT mk, inn, min(bt) AS bt, min(ot) AS ot, min(is_test) AS is_test, min(main) AS main, CAST(sum(rb + rx) AS BIGINT) AS runs,
    CAST(sum(CASE WHEN wkt THEN 1 ELSE 0 END) AS BIGINT) AS wkts FROM l7 GROUP BY mk, inn),
innings AS (SELECT CAST(a.mk AS STRING) AS match_id, CAST(a.inn AS INT) AS innings_number, concat('NATION_', CAST(a.bt AS STRING)) AS batting_team,
    concat('NATION_', CAST(a.ot AS STRING)) AS bowling_team, NOT a.main AS is_super_over, a.is_test AND a.inn = 1 AND a.mk % 4 = 3 AS declared, false AS forfeited,
    CAST(CASE WHEN a.inn = 2 AND NOT a.is_test THEN coalesce(f.runs, 0) + 1 END AS INT) AS target_runs, CAST(CASE WHEN a.inn = 2 AND NOT a.is_test THEN 20 END AS INT) AS target_overs
  FROM tot a LEFT JOIN tot f ON f.mk = a.mk AND f.inn = 1),
sides AS (SELECT mk, min(is_test) AS is_test, CAST(sum(CASE WHEN main AND inn % 2 = 1 THEN runs ELSE 0 END) AS BIGINT) AS odd_runs,
    CAST(sum(CASE WHEN main AND inn % 2 = 0 THEN runs ELSE 0 END) AS BIGINT) AS even_runs, max(CASE WHEN NOT main AND inn % 2 = 1 THEN runs END) AS odd_so,
    max(CASE WHEN NOT main AND inn % 2 = 0 THEN runs END) AS even_so, max(CASE WHEN main AND inn % 2 = 0 THEN inn * 100 + wkts END) % 100 AS last_wkts FROM tot GROUP BY mk),
res AS (SELECT *, CASE WHEN mk % 2 = 0 THEN mk % 10 ELSE (mk + 1 + (mk DIV 10) % 9) % 10 END AS first_side, CASE WHEN mk % 2 = 0 THEN (mk + 1 + (mk DIV 10) % 9) % 10 ELSE mk % 10 END AS second_side,
    CASE WHEN mk % 37 = 5 THEN 'no result' WHEN is_test AND mk % 3 = 0 THEN 'draw' WHEN (mk % 8 = 0 AND NOT is_test) OR odd_runs = even_runs THEN 'tie' END AS result FROM sides),
matches AS (SELECT CAST(mk AS STRING) AS match_id, CASE mk % 5 WHEN 2 THEN 'ODI' WHEN 3 THEN 'Test' WHEN 4 THEN 'IT20' ELSE 'T20' END AS match_type,
    CASE WHEN mk % 4 = 1 THEN 'female' ELSE 'male' END AS gender, CAST(year(o_orderdate) AS STRING) AS season, CAST(o_orderdate AS DATE) AS date_start, CAST(NULL AS DATE) AS date_end,
    concat('NATION_', CAST(mk % 10 AS STRING)) AS team1, concat('NATION_', CAST((mk + 1 + (mk DIV 10) % 9) % 10 AS STRING)) AS team2,
    CASE WHEN mk % 29 <> 0 THEN concat('Ground ', CAST(mk % 12 AS STRING)) END AS venue, concat('City ', CAST(mk % 6 AS STRING)) AS city,
    concat('NATION_', CAST(CASE WHEN mk % 3 <> 0 THEN first_side ELSE second_side END AS STRING)) AS toss_winner, CASE WHEN mk % 3 <> 0 THEN 'bat' ELSE 'field' END AS toss_decision,
    CASE WHEN result = 'tie' THEN CASE WHEN odd_so > even_so THEN concat('NATION_', CAST(first_side AS STRING)) WHEN even_so > odd_so THEN concat('NATION_', CAST(second_side AS STRING)) END
         WHEN result IS NULL THEN concat('NATION_', CAST(CASE WHEN odd_runs > even_runs THEN first_side ELSE second_side END AS STRING)) END AS outcome_winner,
    CAST(CASE WHEN result IS NULL AND odd_runs > even_runs THEN odd_runs - even_runs END AS INT) AS outcome_by_runs,
    CAST(CASE WHEN result IS NULL AND odd_runs < even_runs THEN CASE WHEN last_wkts >= 10 THEN 1 ELSE 10 - last_wkts END END AS INT) AS outcome_by_wickets,
    CAST(NULL AS INT) AS outcome_by_innings, result AS outcome_result, CAST(NULL AS STRING) AS outcome_method, CAST(NULL AS STRING) AS player_of_match,
    CASE mk % 4 WHEN 0 THEN 'Premier League' WHEN 1 THEN 'World Cup' WHEN 2 THEN 'Tri Series' END AS event_name, CAST(NULL AS INT) AS event_match_number, CAST(NULL AS STRING) AS event_group,
    CASE (mk DIV 4) % 10 WHEN 0 THEN 'Final' WHEN 1 THEN 'Semi-final' WHEN 2 THEN 'Qualifier 1' WHEN 3 THEN '3rd Place Play-Off' WHEN 4 THEN 'Group' END AS event_stage,
    CAST(CASE WHEN NOT is_test THEN 20 END AS INT) AS overs_per_side, CAST(6 AS INT) AS balls_per_over, CAST(NULL AS STRING) AS team_type
  FROM res JOIN orders ON o_orderkey = mk * 60),
styled AS (SELECT CAST(pk AS STRING) AS player_id, pn AS player_name, CASE WHEN pk % 17 = 0 THEN NULL WHEN pk % 3 = 0 THEN 'Left hand bat' ELSE 'Right hand bat' END AS batting_style,
    CASE WHEN pk % 13 = 0 THEN NULL WHEN seg_name = 'MACHINERY' THEN 'Right-arm fast-medium' WHEN seg_name = 'BUILDING' THEN 'Slow left-arm orthodox'
         WHEN seg_name = 'AUTOMOBILE' THEN 'Left-arm fast' WHEN seg_name = 'FURNITURE' THEN 'Legbreak googly' ELSE 'Right-arm medium' END AS bowling_style FROM names)"""

#: For the other engine only; in Spark the style groups come from the enrichment job.
STYLES = """
players AS (SELECT player_id, player_name, batting_style, bowling_style,
    CASE bowling_style WHEN 'Right-arm fast-medium' THEN 'Pace' WHEN 'Left-arm fast' THEN 'Pace' WHEN 'Right-arm medium' THEN 'Pace' WHEN 'Slow left-arm orthodox' THEN 'Spin' WHEN 'Legbreak googly' THEN 'Spin' END AS bowling_style_broad,
    CASE bowling_style WHEN 'Right-arm fast-medium' THEN 'Right-arm Pace' WHEN 'Left-arm fast' THEN 'Left-arm Pace' WHEN 'Right-arm medium' THEN 'Right-arm Pace'
         WHEN 'Slow left-arm orthodox' THEN 'Left-arm Spin' WHEN 'Legbreak googly' THEN 'Right-arm Spin' END AS bowling_style_arm,
    CAST(NULL AS VARCHAR) AS playing_role, CAST(NULL AS VARCHAR) AS country FROM styled)"""


@dataclass(frozen=True)
class Tables:
    """The star schema and, where they are kept, its innings grains and index of names; ``rows``: deliveries, as far as known."""

    players: DataFrame
    matches: DataFrame
    innings: DataFrame
    deliveries: DataFrame
    batting: DataFrame | None = None
    bowling: DataFrame | None = None
    appearances: DataFrame | None = None
    grams: DataFrame | None = None
    rows: int = 0

    def star(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in ("players", "matches", "innings", "deliveries")}


#: Columns of step l7 that the later steps read.
L7 = "mk, inn, ov, bi, bt, ot, is_test, main, rb, rx, x, k, wkt, l_suppkey, bat_key, ns_key, bowl_key, out_key, f1_key, f2_key"


def derive(spark: SparkSession, sf_dir: str, path: str) -> Tables:
    """The four tables as lazy DataFrames over the supplied files.

    The window over all deliveries runs once: its result (step l7) is written below ``path``, and the tables are made from that.
    Its tasks are as many as the rows ask for, whatever the session's number of shuffle partitions. ``rows`` is the number of rows of that step.
    """
    from ..sources.enrichment import derive_style_groups

    head, rest = STEPS.replace("DIV", "div").split("names AS", 1)
    rest = "names AS" + rest
    sources = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("lineitem", "orders", "customer")}
    n = buckets_for(sources["lineitem"].count())  # from the files' footers
    sources["lineitem"] = sources["lineitem"].repartition(n, F.expr("l_orderkey div 60"))
    sources["orders"] = sources["orders"].filter("o_orderkey % 60 = 0")  # no others meet a match
    for name, df in sources.items():
        df.createOrReplaceTempView(f"fixture_{name}")
        head, rest = (x.replace(f"FROM {name}", f"FROM fixture_{name}").replace(f"JOIN {name}", f"JOIN fixture_{name}") for x in (head, rest))
    spark.sql(f"WITH {head.rstrip().rstrip(',')} SELECT {L7} FROM l7").write.parquet(f"{path}/l7")
    l7 = spark.read.parquet(f"{path}/l7")
    l7.createOrReplaceTempView("fixture_l7")
    rest = rest.replace("FROM l7", "FROM fixture_l7")
    matches, innings, deliveries, styled = (spark.sql(f"WITH {rest} SELECT * FROM {t}") for t in ("matches", "innings", "deliveries", "styled"))
    players = derive_style_groups(styled).selectExpr("*", "CAST(NULL AS STRING) AS playing_role", "CAST(NULL AS STRING) AS country")
    return Tables(players, matches, innings, deliveries, rows=l7.count())  # from the files' footers


_written: dict[tuple[str, str], Tables] = {}


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The four tables and the grains, written once per application and folder; without checks, which ``integrity`` counts anew.

    The index of names is written where operators ask it; on smaller tables it is there as a plan.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _written:
        path = shared_path(spark, "star")
        derived = derive(spark, sf_dir, path)
        write_star(derived.star(), path, buckets=buckets_for(derived.rows), without=(CHECKS, *unasked(derived.rows)))
        remove(spark, f"{path}/l7")
        found = {name: df for name, df in scan(spark, path).items() if name in (*STAR, *GRAINS, *INDEX)}
        if INDEX[0] not in found:
            seen = appearances(found["deliveries"])
            found |= {INDEX[0]: seen, INDEX[1]: grams(seen)}
        _written[key] = Tables(**found, rows=live_rows(spark, path, "deliveries"))
    return _written[key]


def oracle_prefix() -> str:
    """The same tables as common table expressions of the other engine."""
    return STEPS.replace("DIV", "//").replace("AS STRING)", "AS VARCHAR)") + "," + STYLES
