"""Mixing sources to target weights: iterative proportional fitting, then calibrated sampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.session import materialize

#: The cells (target source, language, topic) are raked on the driver. More of them are an error: name coarser topics.
MAX_CELLS = 500_000
#: Natural shares of languages and topics to this power are their marginal targets: below 1, rare ones gain.
FLATTEN = 0.7
ROUNDS = 200
#: The sampling threshold of each source is searched in rounds of this many buckets.
BUCKETS = 2048
SEARCH_ROUNDS = 4


def rake(cells: np.ndarray, dims: list[np.ndarray], targets: list[np.ndarray], rounds: int = ROUNDS, tol: float = 1e-9) -> np.ndarray:
    """Cell totals raked to the marginal shares ``targets`` (each sums to 1), the first marginal last and exactly.

    ``cells`` are positive token totals; ``dims[k]`` gives each cell's index in marginal k. A marginal value without
    a cell is left out and its share spread over the others in proportion.
    """
    w = cells.astype(float) / cells.sum()
    goals = []
    for d, t in zip(dims, targets):
        seen = np.bincount(d, weights=w, minlength=len(t)) > 0
        g = np.where(seen, t, 0.0)
        goals.append(g / g.sum() if g.sum() else g)
    for _ in range(rounds):
        worst = 0.0
        for k in [*range(1, len(dims)), 0]:
            now = np.bincount(dims[k], weights=w, minlength=len(goals[k]))
            worst = max(worst, float(np.abs(now - goals[k]).max()))
            w = w * np.divide(goals[k], now, out=np.zeros_like(now), where=now > 0)[dims[k]]
        if worst < tol:
            break
    return w


def cap_within(total: np.ndarray, limit: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Totals cut to their limits, the excess going to the other cells of the same group in proportion."""
    x = total.copy()
    for _ in range(len(x) + 1):
        over = x > limit * (1 + 1e-12)
        if not over.any():
            break
        excess = np.bincount(group, weights=np.where(over, x - limit, 0.0))
        x = np.where(over, limit, x)
        room = np.where(x < limit, x, 0.0)
        base = np.bincount(group, weights=room, minlength=len(excess))
        if not (base[excess > 0] > 0).all():
            break
        x = x + room * np.divide(excess, base, out=np.zeros_like(base), where=base > 0)[group]
    return np.minimum(x, limit)


def plan_cells(sized: DataFrame, targets: list[dict], flatten: float = FLATTEN) -> pd.DataFrame:
    """The expected repeats of each (source, lang, topic) cell, for sources that have a target and tokens."""
    counted = sized.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    cells = counted.limit(MAX_CELLS + 1).toPandas().sort_values(["source", "lang", "topic"], ignore_index=True)
    if len(cells) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells of source, language and topic")
    if cells.empty:
        return cells.assign(repeats=pd.Series(dtype=float))
    share = {t["source"]: float(t["target_share"]) for t in targets}
    # no document may come more often than max_repeats, so a cap above 1 counts in whole copies; one below 1 is a share of the source
    most = {t["source"]: max(np.floor(t["max_repeats"]), min(float(t["max_repeats"]), 1.0)) for t in targets}
    dims, goals = [], []
    for col in ("source", "lang", "topic"):
        names, idx = np.unique(cells[col].to_numpy(dtype=str), return_inverse=True)
        natural = np.bincount(idx, weights=cells["tokens"])
        g = np.array([share[s] for s in names]) if col == "source" else natural**flatten
        dims.append(idx)
        goals.append(g / g.sum())
    tokens = cells["tokens"].to_numpy(dtype=float)
    w = rake(tokens, dims, goals)
    have = np.bincount(dims[0], weights=tokens)
    limit = np.array([most[s] for s in np.unique(cells["source"].to_numpy(dtype=str))])
    total = float((limit * have / goals[0]).min())  # the largest mixture in which no source is repeated too often
    cells["repeats"] = cap_within(w * total, limit[dims[0]] * tokens, dims[0]) / tokens
    return cells


def mix(sized: DataFrame, targets: DataFrame, seed: int = 1, flatten: float = FLATTEN) -> DataFrame:
    """``sized(doc_id, source, lang, topic, tokens)`` to ``(doc_id, source, tokens, copies)``, copies > 0.

    ``targets(source, target_share, max_repeats)`` is a small list with one row per source, read whole.
    Sources without a target, documents with a null source and documents without tokens are left out; the
    share of a target source without documents is spread over the others in proportion. Each source's total is as
    near to its share as whole documents allow, and no document is repeated more than max_repeats times. A null
    language or topic is a value of its own. Other columns are ignored; doc_id must be unique.

    Plan: cells are a partial aggregate, all of them counted, at most MAX_CELLS. Whole repeats come from the cell, the
    fraction by order sampling: the documents with the least u / fraction are taken, u being a hash of the id.
    The threshold per source is found from histograms (BUCKETS rows per source and round), so no source is sorted
    or collected, however large it is.
    """
    spark: SparkSession = sized.sparkSession
    goal = [r.asDict() for r in targets.where("source is not null and target_share > 0 and max_repeats > 0").collect()]
    named = sized.where(F.col("source").isin([g["source"] for g in goal]) & (F.col("tokens") > 0)).select(
        "doc_id", "source", F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("topic", F.lit("none")).alias("topic"), "tokens"
    )
    named = materialize(named)
    cells = plan_cells(named, goal, flatten)
    out = "doc_id, source, tokens, copies"
    if cells.empty:
        return named.select("doc_id", "source", "tokens", F.lit(0).alias("copies")).where("copies > 0")
    table = spark.createDataFrame(cells[["source", "lang", "topic", "repeats"]])
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    fraction = F.col("repeats") - F.floor("repeats")
    drawn = named.join(F.broadcast(table), ["source", "lang", "topic"]).select(
        "doc_id", "source", "tokens", F.floor("repeats").cast("int").alias("whole"), F.when(fraction > 1e-12, u / fraction).alias("_k")
    )
    drawn = drawn.withColumn("v", F.col("_k") / (F.col("_k") + 1)).drop("_k")
    want = (cells["repeats"] * cells["tokens"]).groupby(cells["source"]).sum()
    base = {r["source"]: float(r["t"]) for r in drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("whole")).alias("t")).collect()}
    left = {s: want[s] - base.get(s, 0.0) for s in want.index}
    lo, hi = {s: 0.0 for s in left}, {s: 1.0 for s in left}
    for _ in range(SEARCH_ROUNDS):
        bounds = spark.createDataFrame([(s, lo[s], hi[s]) for s in left], "source string, lo double, hi double")
        inside = drawn.where("v is not null").join(F.broadcast(bounds), "source").where("v >= lo and v < hi")
        bucket = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BUCKETS), F.lit(BUCKETS - 1))
        rows = inside.groupBy("source", bucket.alias("b")).agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()
        for s in left:
            mine = sorted((r["b"], r["t"], r["n"]) for r in rows if r["source"] == s)
            width = (hi[s] - lo[s]) / BUCKETS
            start = lo[s]
            for b, t, n in mine:
                if left[s] < t:
                    if n == 1:  # one document: in or out, whichever is nearer
                        lo[s] = hi[s] = start + width * (b + (1 if left[s] > t / 2 else 0))
                        left[s] -= t if left[s] > t / 2 else 0
                    else:
                        lo[s], hi[s] = start + width * b, start + width * (b + 1)
                    break
                left[s] -= t
            else:
                lo[s] = hi[s]
        if all(lo[s] >= hi[s] for s in left):
            break
    cut = spark.createDataFrame([(s, lo[s]) for s in left], "source string, cut double")
    copies = F.col("whole") + F.when(F.col("v") < F.col("cut"), 1).otherwise(0)
    return drawn.join(F.broadcast(cut), "source").select("doc_id", "source", "tokens", copies.alias("copies")).where("copies > 0").select(*out.split(", "))


def share_report(sized: DataFrame, targets: DataFrame, mixed: DataFrame) -> DataFrame:
    """Per source: documents, tokens, target and reached share, repeats reached and allowed. Sources of either side."""
    have = sized.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"))
    got = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("drawn_tokens"), F.max("copies").alias("most_copies"))
    total = mixed.agg(F.sum(F.col("tokens") * F.col("copies")).alias("_total"))
    goal = targets.select(F.col("source").alias("_s"), "target_share", "max_repeats")
    both = have.join(goal, have["source"].eqNullSafe(goal["_s"]), "full").select(
        F.coalesce("source", "_s").alias("source"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("target_share", F.lit(0.0)).alias("target_share"), "max_repeats",
    )
    drawn = F.coalesce("drawn_tokens", F.lit(0))
    return both.join(got, "source", "left").crossJoin(F.broadcast(total)).select(
        "source", "documents", "tokens", "target_share", "max_repeats", drawn.alias("drawn_tokens"),
        F.round(F.try_divide(drawn, F.col("_total")), 6).alias("actual_share"), F.round(F.try_divide(drawn, F.col("tokens")), 4).alias("repeats"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
    )
