"""Quality of rankings against role labels, parameter sweeps, counterfactual audit, ablation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.config import Config
from rankloom.operators import match

# Role classes by file name, first pattern that fits.
ROLE_CLASS = (
    ("RELEVANT", r"\bsde\b|software.?dev|web.?dev|webdev|full.?stack|app.?dev|python|backend|frontend|mern|javascript"),
    ("ADJACENT", r"ai.?dev|ml.?eng|machine.?learning|data.?scien|\bds\b|devops|cyber.?sec|it.?support|cloud|blockchain|\bqa\b|test"),
    ("IRRELEVANT", r"sales|\bhr\b|human.?resource|market|content|video|social.?media|design|founder|business|operations|customer"),
)
CONFIGS = (("literal", 1.0, "normalized"), ("lexical", 1.0, "expanded"), ("semantic", 0.0, "expanded"), ("hybrid", 0.5, "expanded"))
SWAPS = {"elite": "Indian Institute of Technology Bombay", "unranked": "Shri Venkateshwara Degree College"}
NOISE_FLOOR = 1.0


def role_of(file: Column) -> Column:
    """The role in a file name: what stands before "resume", separators made blanks; else the whole base name."""
    base = F.regexp_replace(file, r"(?i)\.[a-z]+$", "")
    cut = F.regexp_replace(base, r"(?s)_?(resume|Resume).*$", "")
    role = F.lower(F.trim(F.regexp_replace(F.regexp_replace(cut, r"[_-]+", " "), r"\s+", " ")))
    return F.when(role != "", role).otherwise(F.lower(base))


def class_of(role: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, pattern in ROLE_CLASS:
        out = out.when(role.rlike(pattern), name)
    return out.otherwise("UNKNOWN")


def labelled(ranked: DataFrame, candidates: DataFrame) -> DataFrame:
    """Ranked rows with role, class, pool size and percentile (rank over pool size)."""
    role = role_of(F.coalesce("source_file", F.lit("")))
    labels = candidates.select("candidate_id", role.alias("role"), class_of(role).alias("cls"))
    sizes = ranked.groupBy("jd_id").agg(F.count(F.lit(1)).alias("pool"))
    return ranked.join(labels, "candidate_id").join(F.broadcast(sizes), "jd_id").withColumn("percentile", F.col("rank") / F.col("pool"))


def class_summary(rows: DataFrame, keys: tuple[str, ...] = ("jd_id",)) -> DataFrame:
    return rows.groupBy(*keys, "cls").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("rank"), 6).alias("mean_rank"), F.round(F.avg("final_score"), 6).alias("mean_score"),
        F.count_if(F.col("percentile") <= 0.25).alias("in_top"), F.count_if(F.col("percentile") > 0.75).alias("in_bottom"),
    )


def precision_purity(rows: DataFrame, keys: tuple[str, ...] = ("jd_id",)) -> DataFrame:
    """Relevant share of the top quarter, irrelevant share of the bottom quarter, and the gap of their mean ranks."""
    top, bottom = F.col("percentile") <= 0.25, F.col("percentile") > 0.75
    share = lambda where, cls: F.count_if(where & (F.col("cls") == cls)) / F.greatest(F.count_if(where), F.lit(1))
    mean = lambda cls: F.coalesce(F.avg(F.when(F.col("cls") == cls, F.col("rank"))), F.lit(0.0))
    return rows.groupBy(*keys).agg(
        F.round(share(top, "RELEVANT"), 6).alias("precision_top"), F.round(share(bottom, "IRRELEVANT"), 6).alias("purity_bottom"),
        F.round(mean("IRRELEVANT") - mean("RELEVANT"), 6).alias("separation"),
    )


def role_means(rows: DataFrame, keys: tuple[str, ...] = ("jd_id",)) -> DataFrame:
    return rows.groupBy(*keys, "role", "cls").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("rank"), 6).alias("mean_rank"))


def misplaced(rows: DataFrame) -> DataFrame:
    """Irrelevant roles in the top quarter and relevant ones in the bottom quarter."""
    bad = ((F.col("cls") == "IRRELEVANT") & (F.col("percentile") <= 0.25)) | ((F.col("cls") == "RELEVANT") & (F.col("percentile") > 0.75))
    return rows.where(bad).select("jd_id", "candidate_id", "role", "cls", "rank", "final_score")


def score_distribution(ranked: DataFrame, keys: tuple[str, ...] = ("jd_id",)) -> DataFrame:
    """Spread of the final scores of each pool. Scores have one decimal, so a histogram of them is at most a thousand rows a
    pool; quantiles are read off its running counts."""
    bins = ranked.groupBy(*keys, "final_score").agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy(*keys).orderBy("final_score").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumn("_upto", F.sum("c").over(upto)).withColumn("_n", F.sum("c").over(Window.partitionBy(*keys)))
    q = lambda x: F.min(F.when(F.col("_upto") > F.least(F.floor(F.col("_n") * x), F.col("_n") - 1), F.col("final_score")))
    at = lambda v: F.sum(F.when(F.col("final_score") == v, F.col("c")).otherwise(0))
    total = bins.groupBy(*keys).agg(
        F.min("final_score").alias("min"), q(0.25).alias("p25"), q(0.5).alias("median"), q(0.75).alias("p75"), F.max("final_score").alias("max"),
        F.round(F.try_divide(F.sum(F.col("final_score") * F.col("c")), F.sum("c")), 6).alias("mean"), at(0).alias("zeros"), at(100).alias("hundreds"),
    )
    sd = ranked.groupBy(*keys).agg(F.round(F.stddev_pop("final_score"), 6).alias("sd"))
    return total.join(F.broadcast(sd), list(keys)).select(*keys, "min", "p25", "median", "p75", "max", "mean", "sd", "zeros", "hundreds")


def ablation(raw: DataFrame, requirements: DataFrame, candidates: DataFrame, cfg: Config) -> DataFrame:
    """Ranks under the four configurations, and how far the hybrid moves each candidate. One pass over one raw matrix."""
    scores = match.setting_scores(raw, requirements, cfg, [(name, alpha, field, cfg.gate_threshold) for name, alpha, field in CONFIGS])
    ranked = match.rank_candidates(scores, candidates, cfg, ("setting",))
    wide = ranked.groupBy("jd_id", "candidate_id").agg(*[F.max(F.when(F.col("setting") == n, F.col("rank"))).alias(f"{n}_rank") for n, _, _ in CONFIGS])
    return wide.select("*", *[(F.col(f"{n}_rank") - F.col("hybrid_rank")).alias(f"{n}_to_hybrid") for n in ("literal", "lexical", "semantic")])


def sweep(raw: DataFrame, requirements: DataFrame, candidates: DataFrame, cfg: Config, name: str, values: tuple[float, ...]) -> DataFrame:
    """Quality per brief for each value of ``alpha`` or ``gate_threshold``."""
    if name not in ("alpha", "gate_threshold"):
        raise ValueError(f"no sweep over {name}")
    gated = name == "gate_threshold"
    settings = [(float(v), cfg.alpha if gated else v, cfg.lexical_field, v if gated else cfg.gate_threshold) for v in values]
    ranked = match.rank_candidates(match.setting_scores(raw, requirements, cfg, settings), candidates, cfg, ("setting",))
    labels = candidates.select("candidate_id", class_of(role_of(F.coalesce("source_file", F.lit("")))).alias("cls"))
    sizes = ranked.groupBy("setting", "jd_id").agg(F.count(F.lit(1)).alias("pool"))
    rows = ranked.join(labels, "candidate_id").join(F.broadcast(sizes), ["setting", "jd_id"]).withColumn("percentile", F.col("rank") / F.col("pool"))
    return precision_purity(rows, ("setting", "jd_id"))


def first_candidates(candidates: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` candidates by id, for a quick look at a pool; all of them without a limit."""
    return candidates if limit is None else candidates.orderBy("candidate_id").limit(limit)


def best_setting(swept: DataFrame) -> DataFrame:
    """Per brief the setting with the greatest precision, then separation, then the smallest value."""
    best = F.max(F.struct("precision_top", "separation", (-F.col("setting")).alias("s"), "purity_bottom"))
    return swept.groupBy("jd_id").agg(best.alias("b")).select("jd_id", (-F.col("b.s")).alias("setting"), "b.precision_top", "b.purity_bottom", "b.separation")
