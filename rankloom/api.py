"""The engine as a library: rank, explain, ask, compare settings, tune.

Results are DataFrames; only :meth:`Ranking.page` brings rows to the driver, and no more than asked for.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.config import MODES, Config, preset
from rankloom.operators import evaluate, explain, match
from rankloom.operators.bias import flag_brief
from rankloom.operators.chat import Answer, Shortlist
from rankloom.operators.requirements import decompose
from rankloom.session import materialize

_REQUIREMENT = "jd_id string, req_key string, req_pos int, text string, kind string, aliases array<string>, weight double"


def brief_key(brief: dict) -> str:
    """A short digest of a brief, for keeping results by brief."""
    return hashlib.sha1(json.dumps(brief, sort_keys=True, default=str).encode()).hexdigest()[:12]  # noqa: S324


@dataclass
class Ranking:
    """One brief's ranking under one configuration."""

    brief: dict
    cfg: Config
    requirements: DataFrame
    cells: DataFrame
    ranked: DataFrame
    units: DataFrame
    tuned: dict

    @cached_property
    def matched(self) -> DataFrame:
        return explain.matched_requirements(self.cells, self.units, self.requirements)

    @cached_property
    def missing(self) -> DataFrame:
        return explain.missing_requirements(self.cells, self.units, self.requirements, self.cfg.gate_threshold)

    @cached_property
    def summaries(self) -> DataFrame:
        return explain.summaries(self.ranked, self.matched, self.missing)

    @cached_property
    def why_not(self) -> DataFrame:
        return match.why_not_top(self.cells, self.ranked, self.requirements)

    def shortlist(self) -> Shortlist:
        return Shortlist(self.ranked, self.cells, self.units, self.requirements)

    def page(self, first: int = 1, last: int = 20) -> dict:
        """Ranks ``first`` to ``last`` as a nested document with explanations, flags and the configuration in effect."""
        rows = self.ranked.where(F.col("rank").between(first, last))
        keys = ["jd_id", "candidate_id"]
        own = rows.select(*keys)
        nest = lambda df, *by: df.join(own, keys, "left_semi").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*by, *[c for c in df.columns if c not in (*keys, *by)]))).alias("x"))
        full = (
            rows.join(nest(self.matched, "position").withColumnRenamed("x", "matched"), keys, "left")
            .join(nest(self.missing, "kind", "req_pos").withColumnRenamed("x", "missing"), keys, "left")
            .join(self.summaries.select(*keys, "summary"), keys, "left")
            .join(self.why_not.select(*keys, F.struct("req_key", "gap", "score", "top_score").alias("why_not_top")), keys, "left")
        )
        return {
            "jd": self.brief,
            "mode": self.cfg.mode,
            "bias_flags": flag_brief(self.brief.get("raw_text")),
            "candidates": [r.asDict(recursive=True) for r in full.orderBy("rank").collect()],
            "meta": {"config": self.cfg.__dict__, "tuned": self.tuned, "generated_at": datetime.now(UTC).isoformat()},
        }


class Engine:
    """A pool of candidates with their units, and briefs by id."""

    def __init__(self, spark: SparkSession, candidates: DataFrame, units: DataFrame, briefs: dict[str, dict] | None = None, default: dict | None = None):
        """``candidates``: candidate_id, name, ... ``units`` as :func:`match.prepare_units` gives them."""
        self.spark, self.candidates, self.units = spark, candidates, units
        self.briefs, self.default = dict(briefs or {}), default
        self.overrides: dict = {}
        self._raw: dict[str, DataFrame] = {}

    def brief_ids(self) -> list[dict]:
        return [{"id": k, "title": b.get("title"), "company": b.get("company"), "requirements": len(b.get("requirements", []))} for k, b in self.briefs.items()]

    def resolve(self, jd: dict | str | None = None, jd_id: str | None = None) -> dict:
        """A brief as given, else by id, else a text taken apart, else the default."""
        if isinstance(jd, dict):
            return jd
        if jd_id is not None:
            if jd_id not in self.briefs:
                raise KeyError(f"unknown brief {jd_id}")
            return self.briefs[jd_id]
        if isinstance(jd, str) and jd.strip():
            return {**decompose(self.spark, jd), "raw_text": jd}
        if self.default is None:
            raise ValueError("no brief given and no default")
        return self.default

    def tune(self, **changes: object) -> Config:
        """Change tunables for later rankings; with an empty or wrong change nothing is changed."""
        if not changes:
            raise ValueError("nothing to tune")
        cfg = Config().tuned(**{**self.overrides, **changes})
        self.overrides |= changes
        return cfg

    def reset(self) -> None:
        """Forget tuned values and kept matrices."""
        self.overrides.clear()
        self._raw.clear()

    def health(self) -> dict:
        return {"ok": True, "candidates": self.candidates.count(), "units": self.units.count(), "modes": sorted(MODES), "briefs": len(self.briefs)}

    def _requirements(self, brief: dict) -> DataFrame:
        key = brief_key(brief)
        rows = [(key, r["id"], k, r["text"], r["kind"], list(r.get("aliases") or []), float(r["weight"]) if r.get("weight") is not None else None) for k, r in enumerate(brief["requirements"], 1)]
        return self.spark.createDataFrame(rows, _REQUIREMENT)

    def _matrix(self, brief: dict, requirements: DataFrame) -> DataFrame:
        """The raw matrix of a brief: no tunable changes it, so one copy serves all modes."""
        key = brief_key(brief)
        if key not in self._raw:
            self._raw[key] = materialize(match.raw_matrix(match.best_units(self.units, requirements, Config()), self.candidates, requirements))
        return self._raw[key]

    def rank(self, jd: dict | str | None = None, jd_id: str | None = None, mode: str = "hybrid", **overrides: object) -> Ranking:
        """Rank the pool for a brief. Overrides hold for this call, over tuned values, over the mode's preset."""
        changes = {**self.overrides, **overrides}
        cfg = preset(mode).tuned(**changes)
        brief = self.resolve(jd, jd_id)
        requirements = self._requirements(brief)
        cells = match.matrix(self._matrix(brief, requirements), cfg)
        ranked = match.rank_candidates(match.candidate_scores(cells, requirements, cfg), self.candidates, cfg)
        return Ranking(brief, cfg, requirements, cells, ranked, self.units, changes)

    def trace(self, jd: dict | str | None = None, jd_id: str | None = None) -> DataFrame:
        """The best five units of each side for every cell."""
        return match.best_units(self.units, self._requirements(self.resolve(jd, jd_id)), Config(), fields=("expanded",), trace=match.TRACE)

    def ablation(self, jd: dict | str | None = None, jd_id: str | None = None) -> DataFrame:
        brief = self.resolve(jd, jd_id)
        requirements = self._requirements(brief)
        return evaluate.ablation(self._matrix(brief, requirements), requirements, self.candidates, Config())

    def ask(self, question: str, ranking: Ranking | None = None) -> Answer:
        """Answer a question about a ranking, the default brief's if none is given."""
        if not (question or "").strip():
            raise ValueError("empty question")
        return (ranking or self.rank()).shortlist().ask(question)
