"""Session helpers: table loading, lineage cuts, latest rows and global positions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table of a scale-factor directory (a file or a folder of files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Only a local-mode session may fall back to a temporary folder of this machine.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="rankloom-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialize(df: DataFrame, tidy: bool = False, codec: str | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    The files outlive a lost executor; they are deleted when the driver's JVM ends, or by ``discard``. If ``tidy``, the shuffle files of the
    write are deleted as soon as it ends, not when the driver happens to collect its garbage. ``codec`` compresses in another way than the session's.
    """
    spark = df.sparkSession
    target = f"{shared_dir(spark)}/rankloom-{uuid.uuid4().hex}"
    before = spark.conf.get(_TIDY, "false")
    spark.conf.set(_TIDY, "true" if tidy else before)
    try:
        df.write.mode("error").parquet(target, compression=codec)
    finally:
        spark.conf.set(_TIDY, before)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    kept = spark.read.schema(df.schema).parquet(target)
    kept.kept_at = target
    return kept


def discard(kept: DataFrame) -> None:
    """Delete the files of a frame that ``materialize`` gave and that nothing reads any more."""
    path = kept.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(kept.kept_at)
    path.getFileSystem(kept.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """A scan spread over all cores before heavy Python work, if it has fewer splits than there are cores.

    Only for frames without a shuffle behind them. A large input has splits enough and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def bounded_broadcast(df: DataFrame, rows: int = 500_000, letters: int = 50_000_000) -> DataFrame:
    """``df``, a materialised table, marked for broadcast if it has at most ``rows`` rows and ``letters`` bytes in its strings; else as it
    is, to be shuffled."""
    strings = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema if f.dataType.simpleString() == "string"]
    size = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(sum(strings, F.lit(0))), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if size["n"] <= rows and size["b"] <= letters else df


def latest(df: DataFrame, keys: list[str], columns: list[str], order: str | None = "ingested_at") -> DataFrame:
    """One row per key: that with the greatest ``order``, then the greatest values.

    Partial aggregation runs before the shuffle, so a key repeated without end stays cheap.
    Rows in which a key is null are kept, as one row per combination of the other keys.
    """
    rest = [c for c in columns if c not in keys]
    rank = [order] if order and order in df.columns else []
    best = F.max(F.struct(*rank, *[c for c in rest if c not in rank])).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col("_best")[c].alias(c) for c in rest])


def places_in_groups(df: DataFrame, groups: list[str], order: list, name: str, kept: bool = False) -> DataFrame:
    """``df`` with the place (from 1) of each row in its group by ``order``, whose last column tells rows of a group apart.

    No group is held by one task, however large: rows are range partitioned by (groups, order), sorted and numbered as they lie, and
    each range adds the rows that its group has in the ranges before it (one number per range and group). The numbered rows
    are not shuffled again. Nulls of a group column are a group. The bounds of the ranges are drawn from a pass of their own, so ``df`` is
    written first unless it is ``kept`` (cheap to read twice).
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*[F.col(g) for g in groups], *order]
    lying = (df if kept else materialize(df)).repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id())
    lying = materialize(lying).withColumn("_range", F.shiftright("_id", 33))
    sizes = lying.groupBy("_range", *groups).agg(F.count(F.lit(1)).alias("_m"), F.min("_id").alias("_first"))
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = (F.coalesce(F.sum("_m").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift")
    offsets = sizes.select(F.col("_range").alias("_r"), *[F.col(g).alias(f"_g{k}") for k, g in enumerate(groups)], shift)
    same = F.col("_range") == F.col("_r")
    for k, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{k}"))
    numbered = lying.join(offsets, same).withColumn(name, (F.col("_id") + F.col("_shift")).cast("int"))
    return numbered.drop("_range", "_id", "_shift", "_r", *[f"_g{k}" for k in range(len(groups))])


def positions(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with the place (from 1) of each row in the order of ``column``, whose values are distinct."""
    return places_in_groups(df, [], [F.col(column)], name)
