"""One ranking from several differently scaled scores: reciprocal rank fusion over distributed places."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.session import materialize

#: The constant added to each rank before it is inverted.
RRF_K = 60.0


def places(values: DataFrame, keys: list[str], partitions: int | None = None) -> DataFrame:
    """The place of each distinct value within its group: 1 = highest, equal values share the mean, nulls last.

    ``values(*keys, value)`` to ``(*keys, value, n, place)``, one row per distinct value. NaN counts as null; nulls
    of a group are equal to each other. No group is collected into one task: values are pre-aggregated, range
    partitioned by (keys, value), so that a group of any size spreads over tasks, and each range only adds the
    row counts of the ranges before it (one number per range and group).
    """
    spark = values.sparkSession
    counts = values.select(*keys, F.nanvl("value", F.lit(None).cast("double")).alias("value"))
    counts = counts.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    order = [F.col("value").desc_nulls_last()]
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(
        counts.repartitionByRange(n, *[F.col(k) for k in keys], *order).withColumn("_range", F.spark_partition_id())
    )
    inside = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_range", *keys).agg(F.sum("n").alias("_m"))
    offsets = offsets.withColumn("_before", F.coalesce(F.sum("_m").over(before), F.lit(0))).drop("_m")
    cum = F.sum("n").over(inside)
    done = ranged.withColumn("_upto", cum).join(offsets, ["_range", *keys])
    return done.select(*keys, "value", "n", (F.col("_before") + F.col("_upto") - (F.col("n") - 1) / 2.0).alias("place"))


def fuse_ranks(df: DataFrame, group: str, item: str, scores: list[str], k: float = RRF_K) -> DataFrame:
    """Rank the items of each group by every score, then fuse.

    Output: group, item, place_<score>..., ``rrf`` = sum of 1 / (k + place), ``mean_place``. Higher ``rrf`` is better;
    equal sums go to the smaller item (see :func:`leaders`). Places share the mean on ties; null and NaN scores share
    the last places. Rows with a null group or item are kept as a group or item of their own. ``(group, item)`` must
    be unique; other columns are ignored. An empty table gives an empty result.
    """
    base = df.select(F.col(group).alias("_g"), F.col(item).alias("_i"), *[F.col(s).cast("double").alias(s) for s in scores])
    long = base.select(
        "_g", "_i", F.explode(F.array(*[F.struct(F.lit(s).alias("score"), F.col(s).alias("value")) for s in scores])).alias("_s")
    ).select("_g", "_i", "_s.score", F.nanvl("_s.value", F.lit(None).cast("double")).alias("value"))
    at = places(long, ["_g", "score"]).select(
        F.col("_g").alias("_h"), F.col("score").alias("_k"), F.col("value").alias("_v"), "place"
    )
    joined = long.join(
        at, long["_g"].eqNullSafe(at["_h"]) & (long["score"] == at["_k"]) & long["value"].eqNullSafe(at["_v"])
    )
    return (
        joined.groupBy("_g", "_i")
        .agg(
            *[F.max(F.when(F.col("score") == s, F.col("place"))).alias(f"place_{s}") for s in scores],
            (F.sum("place") / len(scores)).alias("mean_place"),
        )
        .select(
            F.col("_g").alias(group),
            F.col("_i").alias(item),
            *[f"place_{s}" for s in scores],
            sum((F.lit(1.0) / (F.lit(k) + F.col(f"place_{s}")) for s in scores), F.lit(0.0)).alias("rrf"),
            "mean_place",
        )
    )


def leaders(ranked: DataFrame, group: str, item: str, order: list, top: int) -> DataFrame:
    """The ``top`` leading items of each group, ties going to the smaller item.

    The limit is pushed below the shuffle (a partial limit per task), so a group of any size sends ``top`` rows a task.
    """
    w = Window.partitionBy(group).orderBy(*order, F.col(item).asc())
    return ranked.withColumn("position", F.row_number().over(w)).where(F.col("position") <= top)
