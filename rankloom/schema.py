"""Schema rules. Violations are rows to look at, not exceptions, and never drop data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.config import MODES, SECTIONS


def _violations(df: DataFrame, key: str, rules: dict[str, object]) -> DataFrame:
    hits = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(True)), F.lit(name)) for name, cond in rules.items()]))
    return df.select(F.col(key).cast("string").alias("key"), F.explode(hits).alias("violation"))


def candidate_violations(candidates: DataFrame) -> DataFrame:
    return _violations(candidates, "candidate_id", {"id missing": F.col("candidate_id").isNull(), "name missing": F.col("name").isNull()})


def unit_violations(units: DataFrame) -> DataFrame:
    text = F.trim(F.coalesce("text", F.lit("")))
    return _violations(units, "evidence_id", {"empty text": text == "", "unknown section": ~F.coalesce("section", F.lit("")).isin(*SECTIONS)})


def requirement_violations(requirements: DataFrame) -> DataFrame:
    text = F.trim(F.coalesce("text", F.lit("")))
    return _violations(
        requirements, "req_key", {"empty text": text == "", "unknown kind": ~F.coalesce("kind", F.lit("")).isin("MUST", "NICE"), "aliases missing": F.col("aliases").isNull()}
    )


def ranking_violations(ranked: DataFrame, mode: str) -> DataFrame:
    """Scores that are no numbers, ranks that are not 1..n in order of score within a brief, an unknown mode."""
    w = Window.partitionBy("jd_id").orderBy("rank")
    checked = ranked.withColumn("_k", F.row_number().over(w)).withColumn("_before", F.lag("raw").over(w))
    return _violations(
        checked,
        "candidate_id",
        {
            "score is no number": F.col("final_score").isNull() | F.isnan("final_score"),
            "rank out of place": F.col("rank") != F.col("_k"),
            "rank against score": F.coalesce(F.col("_before") < F.col("raw"), F.lit(False)),
            "unknown mode": F.lit(mode not in MODES),
        },
    )
