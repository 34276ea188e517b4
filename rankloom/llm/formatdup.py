"""Duplicates hidden by formatting differences: canonical records, range sort, adjacent runs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.session import bounded_broadcast, materialize

_OTHER = r"[^\p{L}\p{N}]+"


def reduced(text: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.regexp_replace(F.lower(text), _OTHER, "")


def canonical(name: Column, text: Column) -> Column:
    """A record's full key: its reduced name, then its reduced non-empty lines in sorted order."""
    lines = F.array_sort(F.filter(F.transform(F.split(text, "\n", -1), reduced), lambda x: x != ""))
    return F.concat_ws("\n", F.array(reduced(F.coalesce(name, F.lit("")))), lines)


def word_count(text: Column) -> Column:
    """Number of lower-cased runs of letters and digits."""
    return F.size(F.filter(F.split(F.lower(text), _OTHER), lambda x: x != ""))


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Give each row of a sorted range the first id of its run of equal full keys; a repeated id counts once."""
    last, first, seen = None, None, None
    for pdf in batches:
        keep, firsts = [], []
        for key, rid in zip(pdf["key"], pdf["id"]):
            if key != last:
                last, first, seen = key, rid, None
            keep.append(rid != seen)
            firsts.append(first)
            seen = rid
        yield pdf[["range", "digest", "key_hash", "id"]].assign(first=firsts)[keep]


def representatives(df: DataFrame, id_col: str, name_col: str, text_col: str, min_words: int = 20) -> DataFrame:
    """``(id, keep_id)`` of each record, keep_id being the smallest id of its group of copies.

    Two records are copies if name and text agree once reduced to letters and digits, line order aside. Records
    whose text is null or has fewer than ``min_words`` words are alone. A null name equals an empty one. Rows with a
    null id are left out; equal ids with equal content count once. Other columns are ignored.

    Plan: canonical records are kept once, as the bounds of the ranges are drawn from a pass of their own that then reads digests
    and ids only. They are range partitioned by (digest of the full key, id) and sorted there by (digest, full key, id)
    (Spark's external sort); a scan compares full keys of neighbours. As the id is part of the range, a group holding
    a third of all rows spreads over many tasks. Only a run at the edge of a range can go on in another range: the
    table of those runs has about two rows per range, whatever the input, and is joined by broadcast.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.when(word_count(text) >= min_words, canonical(F.col(name_col), text)).alias("key")
    )
    rows = materialize(rows.withColumn("digest", F.coalesce(F.md5("key"), F.lit(""))))
    ordered = (
        rows.repartitionByRange(n, "digest", "id")
        .withColumn("range", F.spark_partition_id())
        # a record without a key is alone: its id is its key
        .withColumn("key", F.coalesce("key", F.concat(F.lit("\x00"), F.col("id").cast("string"))))
        .withColumn("key_hash", F.sha2("key", 256))
        .sortWithinPartitions("digest", "key", "id")
    )
    kind = df.schema[id_col].dataType.simpleString()
    scanned = materialize(
        ordered.select("range", "digest", "key_hash", "key", "id").mapInPandas(
            _scan, f"range int, digest string, key_hash string, id {kind}, first {kind}"
        )
    )
    edges = scanned.groupBy("range").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi"))
    at_edge = (
        scanned.join(F.broadcast(edges), "range")
        .where(((F.col("digest") == F.col("lo")) | (F.col("digest") == F.col("hi"))) & (F.col("digest") != ""))
        .groupBy("digest", "key_hash")
        .agg(F.min("first").alias("_first"))
    )
    return scanned.join(F.broadcast(at_edge), ["digest", "key_hash"], "left").select("id", F.coalesce("_first", "first").alias("keep_id"))


def copy_counts(kept: DataFrame) -> DataFrame:
    """``(keep_id, copies)``: one row per group of :func:`representatives` with the number of its records. Counted before the shuffle."""
    return kept.groupBy("keep_id").agg(F.count(F.lit(1)).alias("copies"))


def collapse(df: DataFrame, id_col: str, name_col: str, text_col: str, min_words: int = 20) -> DataFrame:
    """One row per record: id, keep_id and copies (records of the group); see :func:`representatives`."""
    kept = materialize(representatives(df, id_col, name_col, text_col, min_words))
    many = materialize(copy_counts(kept).where("copies > 1"))
    return kept.join(bounded_broadcast(many), "keep_id", "left").select("id", "keep_id", F.coalesce("copies", F.lit(1)).alias("copies"))
