"""Ratings that follow matches in order."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ship import ship

#: First rating, step, the home side's advantage, matches of the recent change.
INITIAL, STEP, HOME, RECENT = 1500.0, 20.0, 60.0, 5
#: What the fold adds to a match.
ADDED = ("home_pre", "away_pre", "home_post", "away_post", "home_expected", "home_actual")


def expectation(own: float, other: float) -> float:
    return 1 / (1 + 10 ** ((other - own) / 400))


def expected(own: Column, other: Column) -> Column:
    """expectation() of columns."""
    return 1 / (1 + F.pow(F.lit(10.0), (other - own) / F.lit(400.0)))


def _fold(context: Sequence[str], initial: float, step: float, home: float):
    """Reads matches ordered by context, kickoff and match_id, and adds the ratings before and after each; its state is one context's ratings."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ratings = None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            out: dict[str, list] = {c: [] for c in ADDED}
            keys = zip(*(batch.column(c).to_pylist() for c in context), strict=True) if context else repeat(())
            for key, h, a, hs, as_ in zip(keys, *(batch.column(c).to_pylist() for c in ("home_team", "away_team", "home_score", "away_score")), strict=bool(context)):
                if key != at:
                    at, ratings = key, {}
                x, y = ratings.get(h, initial), ratings.get(a, initial)
                e = expectation(x + home, y)
                s = 0.5 if hs == as_ else float(hs > as_)
                d = step * (s - e)
                ratings[h], ratings[a] = x + d, y - d
                for name, v in zip(ADDED, (x, y, x + d, y - d, e, s), strict=True):
                    out[name].append(v)
            for name, v in out.items():
                batch = batch.append_column(name, pa.array(v, pa.float64()))
            yield batch

    return run


def played(matches: DataFrame) -> DataFrame:
    """Matches that count: with both scores, of two teams."""
    return matches.where("home_score is not null and away_score is not null and home_team <> away_team")


def elo_history(matches: DataFrame, context: Sequence[str], initial: float = INITIAL, step: float = STEP, home: float = HOME) -> DataFrame:
    """Two rows a match: context, match_id, kickoff, is_home, team, opponent, expected, actual, pre, post.

    matches: context columns, match_id, kickoff, home_team, away_team,
    home_score, away_score. A context (a competition's season) is one sequence
    by definition: its matches are sorted by kickoff and match_id and streamed
    past the ratings so far, unrounded, which is all that a task holds. Contexts
    run in parallel. Ratings show 4 decimals, expectations 6. Matches without
    both scores, or of a team against itself, don't count.
    """
    ship(matches.sparkSession)
    ready = played(matches).select(*context, "match_id", "kickoff", "home_team", "away_team", "home_score", "away_score")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ready.schema.fields) + "".join(f", {c} double" for c in ADDED)
    ordered = (ready.repartition(*context) if context else ready.repartition(1)).sortWithinPartitions(*context, "kickoff", "match_id")
    rows = ordered.mapInArrow(_fold(context, initial, step, home), schema)
    sides = F.inline(F.array(
        F.struct(F.lit(True).alias("is_home"), F.col("home_team").alias("team"), F.col("away_team").alias("opponent"), F.round("home_expected", 6).alias("expected"), F.col("home_actual").alias("actual"), F.round("home_pre", 4).alias("pre"), F.round("home_post", 4).alias("post")),
        F.struct(F.lit(False).alias("is_home"), F.col("away_team").alias("team"), F.col("home_team").alias("opponent"), F.round(1 - F.col("home_expected"), 6).alias("expected"), (1 - F.col("home_actual")).alias("actual"), F.round("away_pre", 4).alias("pre"), F.round("away_post", 4).alias("post"))))
    return rows.select(*context, "match_id", "kickoff", sides)


def elo_summary(history: DataFrame, context: Sequence[str], recent: int = RECENT) -> DataFrame:
    """Each team's current rating and its change over its last matches, from the shown history."""
    ranked = history.withColumn("r", F.row_number().over(W.partitionBy(*context, "team").orderBy(F.desc("kickoff"), F.desc("match_id"))))
    last = ranked.where(F.col("r") <= recent).groupBy(*context, "team").agg(F.min_by("post", "r").alias("elo"), F.max_by("pre", "r").alias("_first"))
    return last.select(*context, "team", "elo", F.round(F.col("elo") - F.col("_first"), 4).alias("elo_change"))
