"""Ranking kept up to date as evidence arrives. Scores are relative to the pool, so each batch re-ranks the pool."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rankloom.config import Config
from rankloom.operators import match


def rerank_stream(
    evidence: DataFrame, candidates: DataFrame, requirements: DataFrame, store: str, target: str, checkpoint: str, cfg: Config | None = None, available_now: bool = True
) -> StreamingQuery:
    """Append each micro-batch of evidence to ``store`` and write the ranking of the whole pool to ``target``.

    A batch replayed after a failure overwrites its own part of the store (``batch`` is a partition), so nothing counts
    twice; repeated ids keep the latest row. ``evidence`` has the columns of the evidence table.
    """
    c = cfg or Config()
    columns = ["id", "candidate_id", "section", "text", "normalized", "expanded", "negated", "ingested_at"]

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.select(*columns).write.mode("overwrite").parquet(f"{store}/batch={batch_id}")
        rest = [x for x in columns if x not in ("id", "ingested_at")]
        latest = spark.read.parquet(store).groupBy("id").agg(F.max_by(F.struct(*rest), "ingested_at").alias("r")).select("id", "r.*")
        units = match.prepare_units(latest)
        best = match.best_units(units, requirements, c, fields=(c.lexical_field,))
        raw = match.raw_matrix(best, candidates, requirements)
        cells = match.matrix(raw, c)
        ranked = match.rank_candidates(match.candidate_scores(cells, requirements, c), candidates, c)
        ranked.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(target)

    writer = evidence.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def evidence_rate(evidence: DataFrame, delay: str = "7 days", window: str = "1 day") -> DataFrame:
    """Units per window and section of event time, late rows up to ``delay`` included, repeated ids counted once."""
    once = evidence.withWatermark("parsed_at", delay).dropDuplicatesWithinWatermark(["id"])
    return once.groupBy(F.window("parsed_at", window), "section").agg(F.count(F.lit(1)).alias("units"))
