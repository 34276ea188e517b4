"""Filling windows of fixed capacity: vector bin packing by the dot-product heuristic."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.session import materialize

#: Limits of a window: tokens, segments (documents or pieces) and loss-bearing tokens. A loss limit of the window's size
#: has no effect; a lower one cuts documents that bear more loss, though they are no longer than a window.
CAPACITY = 2048
SEGMENTS = 64
LOSS_TOKENS = 2048
#: Pieces packed together. Shards are drawn by hash, so their number follows the input and their size does not.
SHARD_PIECES = 4000


def pack(sizes: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The window of each item; ``sizes`` is (items, dimensions), every item fits an empty window.

    One window is open at a time. It takes the item whose demand has the greatest weighted dot product with the room
    left, among those that fit, until none fits. Demands are in shares of the limits, and a dimension weighs as
    much as its total demand. Ties go to the first item.
    """
    n = len(sizes)
    share = sizes / limits
    weight = share.sum(axis=0)
    weight = weight / weight.sum() if weight.sum() else weight
    demand = share * weight
    out = np.full(n, -1, dtype=np.int64)
    order = np.lexsort(tuple(-sizes[:, k] for k in range(sizes.shape[1] - 1, -1, -1)))
    share, demand, left_idx = share[order], demand[order], order
    window = 0
    while len(left_idx):
        room = np.ones(sizes.shape[1])
        alive = np.ones(len(left_idx), dtype=bool)
        fits = alive.copy()
        while fits.any():
            score = np.where(fits, demand @ room, -1.0)
            k = int(score.argmax())
            out[left_idx[k]] = window
            alive[k] = False
            room = room - share[k]
            fits = alive & (share <= room + 1e-9).all(axis=1)
        share, demand, left_idx = share[alive], demand[alive], left_idx[alive]
        window += 1
    return out


def _pack_shard(limits: np.ndarray):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece"], ignore_index=True)
        sizes = np.column_stack([pdf["tokens"], np.ones(len(pdf)), pdf["loss_tokens"]]).astype(float)
        pdf["window"] = pack(sizes, limits)
        pdf["slot"] = (pdf.groupby("window").cumcount() + 1).astype("int32")
        return pdf[["shard", "window", "slot", "doc_id", "piece", "start_token", "tokens", "loss_tokens"]]

    return run


def pack_documents(
    sized: DataFrame, id_col: str, capacity: int = CAPACITY, segments: int = SEGMENTS, loss_limit: int = LOSS_TOKENS, shard_pieces: int = SHARD_PIECES
) -> DataFrame:
    """``sized(id, tokens, head_tokens)`` to placed pieces.

    Output: window_id, slot, id, piece, start_token, tokens, loss_tokens. A document that no empty window holds, by its
    tokens or its loss-bearing tokens, is cut into the fewest pieces, each as long as a window holds; no other is cut. The tokens after the first line bear loss. A
    document without tokens takes no room and is not placed. ``id`` must be unique; other columns are ignored.

    Plan: pieces are drawn into shards of about ``shard_pieces`` by a hash of document and piece, and each shard is
    packed by one task in bounded memory; a shard wastes at most its last windows. The rows shuffled are sizes only.
    """
    loss = min(capacity, loss_limit)
    head = F.greatest(F.lit(0).cast("long"), F.col("head_tokens"))
    # pieces of full size while they end in the head or within the loss limit after it; then one up to that limit; then as much loss each
    full = F.floor((head + loss) / capacity)
    turn = F.greatest(full * capacity, head) + loss
    after = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("tokens") - turn) / loss))
    n_pieces = F.when(F.col("tokens") <= full * capacity, F.ceil(F.col("tokens") / capacity)).otherwise(full + 1 + after)
    pieces = sized.where(F.col(id_col).isNotNull() & (F.col("tokens") > 0)).select(
        F.col(id_col).alias("doc_id"),
        "tokens",
        "head_tokens",
        full.alias("full"),
        turn.alias("turn"),
        F.explode(F.sequence(F.lit(0), n_pieces.cast("int") - 1)).alias("p"),
    )
    start = F.when(F.col("p") <= F.col("full"), F.col("p") * F.lit(capacity)).otherwise(F.col("turn") + (F.col("p") - F.col("full") - 1) * loss).cast("long")
    room = F.when(F.col("p") < F.col("full"), F.lit(capacity)).when(F.col("p") == F.col("full"), F.col("turn") - F.col("full") * capacity).otherwise(F.lit(loss))
    length = F.least(room.cast("long"), F.col("tokens") - start)
    pieces = materialize(
        pieces.select(
            "doc_id",
            (F.col("p") + 1).cast("int").alias("piece"),
            (start + 1).cast("long").alias("start_token"),
            length.alias("tokens"),
            F.greatest(F.lit(0).cast("long"), length - F.greatest(F.lit(0).cast("long"), F.col("head_tokens") - start)).alias("loss_tokens"),
        )
    )
    n = max(1, math.ceil(pieces.count() / shard_pieces))
    sharded = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n)).cast("int"))
    kind = sized.schema[id_col].dataType.simpleString()
    # as many partitions as there are shards to fill, which small rows would else be merged into one
    session = sized.sparkSession
    parts = min(n, max(int(session.conf.get("spark.sql.shuffle.partitions")), 3 * session.sparkContext.defaultParallelism))
    packed = sharded.repartition(parts, "shard").groupBy("shard").applyInPandas(
        _pack_shard(np.array([capacity, segments, loss_limit], dtype=float)),
        f"shard int, window long, slot int, doc_id {kind}, piece int, start_token long, tokens long, loss_tokens long",
    )
    return packed.select(
        F.concat_ws(":", "shard", "window").alias("window_id"), "slot", F.col("doc_id").alias(id_col), "piece", "start_token", "tokens", "loss_tokens"
    )


def fill_report(placed: DataFrame, capacity: int = CAPACITY, segments: int = SEGMENTS, loss_limit: int = LOSS_TOKENS) -> DataFrame:
    """One row: windows used, the least number that any limit needs, their ratio less 1, the room filled, and the greatest use of each limit."""
    w = placed.groupBy("window_id").agg(F.sum("tokens").alias("t"), F.max("slot").alias("s"), F.sum("loss_tokens").alias("l"))
    least = F.greatest(F.ceil(F.sum("t") / capacity), F.ceil(F.sum("s") / segments), F.ceil(F.sum("l") / loss_limit))
    n = F.count(F.lit(1))
    return w.agg(
        n.alias("windows"), least.alias("least_windows"), F.round(n / least - 1, 4).alias("over_least"), F.round(F.sum("t") / (n * capacity), 4).alias("filled"),
        F.max("t").alias("most_tokens"), F.max("s").alias("most_segments"), F.max("l").alias("most_loss_tokens"),
    )


def kept_whole(placed: DataFrame, sized: DataFrame, id_col: str, capacity: int = CAPACITY, segments: int = SEGMENTS, loss_limit: int = LOSS_TOKENS) -> DataFrame:
    """``(id, kept)`` of each document with tokens: whether its pieces give it whole and in order, uncut if a window holds it, in windows within all limits."""
    inside = Window.partitionBy("window_id")
    fits = (F.sum("tokens").over(inside) <= capacity) & (F.count(F.lit(1)).over(inside) <= segments) & (F.sum("loss_tokens").over(inside) <= loss_limit)
    follows = F.col("start_token") == 1 + F.coalesce(F.sum("tokens").over(Window.partitionBy(id_col).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by = placed.select(id_col, "piece", "tokens", "loss_tokens", fits.alias("fits"), follows.alias("follows"))
    got = by.groupBy(id_col).agg(F.sum("tokens").alias("got"), F.count(F.lit(1)).alias("pieces"), F.min(F.col("fits") & F.col("follows")).alias("ok"))
    held = (F.col("tokens") <= capacity) & (F.col("tokens") - F.least("head_tokens", "tokens") <= loss_limit)
    kept = F.col("ok") & (F.col("got") == F.col("tokens")) & (~held | (F.col("pieces") == 1))
    return sized.where("tokens > 0").join(got, id_col, "left").select(id_col, F.coalesce(kept, F.lit(False)).alias("kept"))
