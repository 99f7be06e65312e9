"""Windows of an entity's most recent rows, and weights that fall with age."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The windows and how many rows each takes (None: all).
WINDOWS: tuple[tuple[str, int | None], ...] = (("last_3", 3), ("last_5", 5), ("last_10", 10), ("season", None))
#: Fixed value: appearances after which a weight has halved.
HALF_LIFE = 3.0


def recency_weight(rank: Column, half_life: float = HALF_LIFE) -> Column:
    """0.5 ** ((rank - 1) / half_life); the newest row has rank 1."""
    return F.pow(F.lit(0.5), (rank - 1) / F.lit(half_life))


def recent_windows(df: DataFrame, entity: Sequence[str], newest: Sequence[Column], windows: Sequence[tuple[str, int | None]] = WINDOWS, half_life: float = HALF_LIFE, rank_all: bool = False) -> DataFrame:
    """df's rows with recency_rank, window_key and weight: one row for each window that takes the row.

    Rows are ranked once, by `newest`, which should break every tie; each is
    then repeated for its windows in the same task. In a window without bound
    all rows weigh 1 and have no rank, so that only the newest few rows of an
    entity need sorting: each task keeps no more of them before they meet,
    however many rows a hot entity has. With rank_all those rows are ranked too.
    """
    w = W.partitionBy(*entity).orderBy(*newest)
    bounded, open_ = [(k, n) for k, n in windows if n is not None], [k for k, n in windows if n is None]

    def taken(ranked: DataFrame, keys: Sequence[tuple[str, int | None]]) -> DataFrame:
        rank = F.col("recency_rank")
        of = [F.when(F.lit(n is None) | (rank <= (n or 0)), F.struct(F.lit(k).alias("window_key"), (F.lit(1.0) if n is None else recency_weight(rank, half_life)).alias("weight"))) for k, n in keys]
        return ranked.select("*", F.explode(F.array_compact(F.array(*of))).alias("_w")).select(*ranked.columns, "_w.window_key", "_w.weight")

    ranked = df.withColumn("recency_rank", F.row_number().over(w))
    if rank_all or not bounded:
        return taken(ranked, windows)
    out = taken(ranked.where(F.col("recency_rank") <= max(n for _, n in bounded)), bounded)
    for key in open_:
        out = out.unionByName(df.select("*", F.lit(None).cast("int").alias("recency_rank"), F.lit(key).alias("window_key"), F.lit(1.0).alias("weight")))
    return out


def latest(df: DataFrame, keys: Sequence[str], newest: Sequence[Column]) -> DataFrame:
    """The newest row of each key."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*newest))).where("_r = 1").drop("_r")
