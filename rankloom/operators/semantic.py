"""Vector search: a stated set of queries against all rows, in blocks; and the embedding cache."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.numbers import stable_np

QUERY_BLOCK = 2_000


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def top_k(vectors: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int) -> DataFrame:
    """The ``k`` rows of greatest cosine per query, itself left out: query_id, id, score, position.

    Queries are taken in blocks of QUERY_BLOCK; each batch of rows is scored against a block at once and reduced to its
    ``k`` best per query, so at most k rows per query and batch are shuffled. Ties go to the smaller id. Null
    vectors and zero vectors score 0; vectors of another length than the query's are left out.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    stated = queries.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).orderBy("id")

    def scorer(ids: list, q: np.ndarray):
        names = np.array(ids)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                pdf = pdf[pdf["v"].map(len) == q.shape[1]].sort_values("id", ignore_index=True)
                if not len(pdf):
                    continue
                own = pdf["id"].to_numpy()
                s = stable_np(_unit(np.stack(pdf["v"].to_numpy())) @ q.T)
                s[own[:, None] == names[None, :]] = -np.inf
                top = np.argsort(-s, axis=0, kind="stable")[:k]
                out = pd.DataFrame({"query_id": np.tile(names, len(top)), "id": own[top].ravel(), "score": np.take_along_axis(s, top, 0).ravel()})
                yield out[np.isfinite(out["score"])]

        return run

    out = None
    block: list = []

    def flush() -> None:
        nonlocal out, block
        q = _unit(np.array([r["v"] for r in block], dtype=float))
        part = rows.mapInPandas(scorer([r["id"] for r in block], q), f"query_id {kind}, id {kind}, score double")
        out = part if out is None else out.unionByName(part)
        block = []

    for r in stated.toLocalIterator():
        block.append(r)
        if len(block) == QUERY_BLOCK:
            flush()
    if block or out is None:
        if not block:
            return rows.limit(0).select(F.col("id").alias("query_id"), "id", F.lit(0.0).alias("score"), F.lit(0).alias("position"))
        flush()
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return out.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def cache_key(model: str, text) -> object:
    """The key of a text's vector: a digest of the model's name, a null character and the text."""
    return F.sha1(F.concat(F.lit(model + "\0"), text))


def cache_misses(texts: DataFrame, text_col: str, cache: DataFrame, model: str) -> DataFrame:
    """Distinct texts without a vector in ``cache(key, vector)``: what has still to be embedded."""
    wanted = texts.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text")).distinct()
    return wanted.withColumn("key", cache_key(model, F.col("text"))).join(cache.select("key"), "key", "left_anti")


def embed_texts(misses: DataFrame, embed) -> DataFrame:
    """``(key, vector)`` of each missing text; the embedder is called once per Arrow batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "vector": list(embed(list(pdf["text"])).astype("float32"))})

    return misses.select("key", "text").mapInPandas(run, "key string, vector array<float>")


def update_cache(texts: DataFrame, text_col: str, path: str, model: str, embed) -> DataFrame:
    """Embed what the Parquet cache at ``path`` lacks, append it, and give the whole cache.

    Only a path that does not exist is a fresh start; a cache that cannot be read is an error, and is never written over.
    """
    spark = texts.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    schema = "key string, vector array<float>"
    cache = spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)
    embed_texts(cache_misses(texts, text_col, cache, model), embed).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def cached_embedder(vectors: DataFrame, texts: DataFrame, text_col: str, model: str) -> DataFrame:
    """``texts`` with the ``vector`` of each from the cache, joined by key; null where the cache lacks it."""
    keyed = texts.withColumn("key", cache_key(model, F.col(text_col)))
    return keyed.join(vectors, "key", "left").drop("key")
