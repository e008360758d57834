"""Index of names: from a part of a name to the matches concerned, without reading deliveries (B2).

Two small tables are kept beside each batch of the star: ``appearances``, one row per name and match, sorted by name, and ``grams``, one row
per name and piece of three letters of it (in lower case), sorted by piece. A part is looked up by its own pieces; names that have
all of them are tested by the filter itself, so the result equals that of testing every ball, wildcards included. The matches found
are given to the scans of matches and deliveries as constants, which prune buckets, row groups and pages.
"""

from __future__ import annotations

import re
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from ..plans.fixture import Tables

INDEX = ("appearances", "grams")
NAMED = ("batter", "bowler", "non_striker", "wicket_player_out", "wicket_fielder1", "wicket_fielder2")
SIZE = 3
#: Names, and matches, that a part may stand for; beyond, it is so common that the deliveries are read as a whole.
BOUND = 2_000
#: Deliveries from which a look-up (two small jobs) costs less than it saves.
FROM = 100_000_000


def unasked(deliveries: int) -> tuple[str, ...]:
    """What a table of so many deliveries is written without: below FROM no operator asks the index."""
    return () if deliveries >= FROM else ("index",)


def pieces(text: Column) -> Column:
    """All stretches of three characters."""
    n = F.length(text)
    return F.when(n >= SIZE, F.array_distinct(F.transform(F.sequence(F.lit(1), n - SIZE + 1), lambda i: text.substr(i, F.lit(SIZE)))))


def appearances(deliveries: DataFrame) -> DataFrame:
    """Who takes part in which match; distinct by match, so deliveries bucketed by match meet without an exchange."""
    seen = deliveries.select("match_id", F.explode(F.array(*NAMED)).alias("name")).filter("name IS NOT NULL").distinct()
    return seen.repartition("name").sortWithinPartitions("name", "match_id")


def grams(seen: DataFrame) -> DataFrame:
    names = seen.select("name").distinct()
    return names.select(F.explode(pieces(F.lower("name"))).alias("gram"), "name").repartition("gram").sortWithinPartitions("gram", "name")


def named(t: Tables, part: str) -> DataFrame:
    """The distinct names that hold a part, as ``filters.like`` tests it."""
    lowered = t.grams.sparkSession.sql("SELECT lower(:p) AS p", args={"p": f"%{part}%"}).first().p
    # runs between wildcards must stand in a name as they are; an escape may change what a wildcard is
    asked = {run[k : k + SIZE] for run in re.split("[%_]", lowered) for k in range(len(run) - SIZE + 1)} if "\\" not in part else set()
    if asked:
        names = t.grams.filter(F.col("gram").isin(sorted(asked))).groupBy("name").agg(F.countDistinct("gram").alias("n")).filter(F.col("n") == len(asked)).select("name")
    else:
        names = t.appearances.select("name").distinct()
    return names.filter(F.col("name").ilike(f"%{part}%"))


def matches_of(t: Tables, parts: tuple[str, ...], bound: int = BOUND) -> list[str] | None:
    """The matches in which each part names somebody; None beyond ``bound`` names or matches. At most ``bound`` + 1 rows come to the driver."""
    ids = None
    for part in parts:
        names = [r.name for r in named(t, part).limit(bound + 1).collect()]
        if len(names) > bound:
            return None
        some = t.appearances.filter(F.col("name").isin(names)).select("match_id").distinct()
        ids = some if ids is None else ids.join(some, "match_id", "left_semi")
    found = [r.match_id for r in ids.limit(bound + 1).collect()]
    return None if len(found) > bound else sorted(found)


def within(t: Tables, parts: tuple[str | None, ...]) -> Column | None:
    """A filter on match_id for deliveries of these names, where the tables are large enough and the names rare enough to gain by one."""
    parts = tuple(p for p in parts if p)
    if not parts or t.appearances is None or t.rows < FROM:
        return None
    ids = matches_of(t, parts)
    return None if ids is None else F.col("match_id").isin(ids)
