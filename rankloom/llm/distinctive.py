"""How distinctive a term is per record: probabilistic relevance weights over a whole collection.

weight(t, r) = ln((N - df + 0.5) / (df + 0.5) + 1) * tf (k1 + 1) / (tf + k1 (1 - b + b dl / avgdl))

``N``, ``df``, ``dl`` and ``avgdl`` come from all records of the same kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1 = 1.5
B = 0.75
#: A term of more than N / HOT_SHARE records is hot. There are at most HOT_SHARE * (mean distinct terms per record) of
#: them however large the collection is, so their statistics may be broadcast; the others never make a large join group.
HOT_SHARE = 1_000


def normalise_terms(text: Column) -> Column:
    """Lower case, everything but ``a-z 0-9 . + # / -`` made blank."""
    return F.regexp_replace(F.lower(text), r"[^a-z0-9.+#/\s-]", " ")


def term_weights(units: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """``units(record_kind, record_id, text)`` to one row per kind, record and term with its weight.

    Output: record_kind, record_id, term, tf, df, dl, weight. A record may have many units. Null text counts as
    empty; a unit with a null record_id or record_kind is in no record and is left out of all counts; a record
    without terms has no row, but counts in N and avgdl with length 0. Repeated units count each time (deduplicate
    keys before). Other columns are ignored. An empty table gives an empty result.

    Plan: terms are counted per unit partition before the one shuffle by (record, term); df and the record lengths
    are partial aggregates over those counts. The skewed side of the df join is taken out: hot terms, whose number is
    bounded by HOT_SHARE, are joined by broadcast, so no shuffle key holds more than N / HOT_SHARE rows.
    """
    keys = ["record_kind", "record_id"]
    toks = units.where(F.col("record_id").isNotNull() & F.col("record_kind").isNotNull()).select(
        *keys, F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda t: t != "").alias("_t")
    )
    lengths = toks.groupBy(*keys).agg(F.sum(F.size("_t")).alias("dl"))
    stats = lengths.groupBy("record_kind").agg(F.count(F.lit(1)).alias("_n"), F.avg("dl").alias("_avgdl"))
    tf = toks.select(*keys, F.explode("_t").alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))
    df = (
        tf.groupBy("record_kind", "term")
        # reads tf, so that Spark reuses the one shuffle of the counts instead of making a second without them
        .agg(F.sum(F.when(F.col("tf") > 0, 1)).alias("df"))
        .join(F.broadcast(stats), "record_kind")
    )
    is_hot = F.col("df") * HOT_SHARE > F.col("_n")
    hot = F.broadcast(df.where(is_hot).select("record_kind", "term", F.col("df").alias("_hot"), "_n", "_avgdl"))
    marked = tf.join(hot, ["record_kind", "term"], "left")
    common = marked.where(F.col("_hot").isNotNull()).select(*keys, "term", "tf", F.col("_hot").alias("df"), "_n", "_avgdl")
    rare = (
        marked.where(F.col("_hot").isNull())
        .select(*keys, "term", "tf")
        .join(df.where(~is_hot), ["record_kind", "term"])
        .select(*keys, "term", "tf", "df", "_n", "_avgdl")
    )
    idf = F.log((F.col("_n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    norm = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("dl") / F.col("_avgdl"))
    return (
        common.unionByName(rare)
        .join(lengths, keys)
        .select(*keys, "term", "tf", "df", "dl", (idf * F.col("tf") * (k1 + 1) / (F.col("tf") + norm)).alias("weight"))
    )
