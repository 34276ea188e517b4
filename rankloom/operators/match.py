"""Requirement x candidate scoring: best unit per pair, pool normalisation, fusion, gate, ranking.

Key columns: ``jd_id`` (one pool of candidates is ranked per brief), ``req_key``, ``candidate_id``. All briefs are scored
in one job. The pair matrix is never joined out of unit pairs: requirements are a stated query set, taken in blocks,
against which each batch of units is scored and at once reduced to its best unit per candidate.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.config import Config
from rankloom.functions.numbers import half_up, sigmoid, stable, stable_np, z_score
from rankloom.functions.text import TOKEN_RE, filled, is_negated, tokenize
from rankloom.session import materialize, places_in_groups

#: Requirements scored together; more are taken in further blocks.
REQUIREMENT_BLOCK = 1_000
#: Units scored together inside a batch.
UNIT_BLOCK = 512
#: Units of one candidate kept together; a candidate with more is scored in several tasks.
CANDIDATE_UNITS = 4_096
DIMENSIONS = 64
TRACE = 5


class Embedder(Protocol):
    """Anything that turns texts into rows of unit length (or zero rows)."""

    def __call__(self, texts: list[str]) -> np.ndarray: ...


@lru_cache(maxsize=200_000)
def _places(word: str) -> tuple[tuple[int, int], ...]:
    """Dimension and sign of a word and of its stem."""
    out = []
    for feature in (word, word[:4] + "*")[: 1 + (len(word) > 4)]:
        h = hashlib.md5(feature.encode()).hexdigest()  # noqa: S324 - a spread, not a secret
        out.append((int(h[:2], 16) % DIMENSIONS, 1 if h[2] < "8" else -1))
    return tuple(out)


def hashed_counts(texts: list[str]) -> list[list[int]]:
    """Sums of the signs that words and their four-letter stems have in each dimension."""
    out = [[0] * DIMENSIONS for _ in texts]
    for row, text in zip(out, texts):
        for w in TOKEN_RE.findall((text or "").lower()):
            for d, s in _places(w):
                row[d] += s
    return out


def unit_rows(out: np.ndarray) -> np.ndarray:
    """Rows brought to unit length in place; zero rows stay."""
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=out, where=norm > 0)


def hashed(texts: list[str]) -> np.ndarray:
    """The default embedder: signed hashes of words and of their four-letter stems, of unit length.

    It needs no model files and gives the same vectors on every worker. A trained model can take its place.
    """
    return unit_rows(np.array(hashed_counts(texts), dtype=float).reshape(len(texts), DIMENSIONS))


def requirement_text(text: Column, aliases: Column) -> Column:
    """What is embedded of a requirement: its text, a bar, its aliases."""
    return F.concat_ws(" ", F.concat_ws(" | ", text, F.concat_ws(" ", aliases)))


def query_columns() -> tuple[Column, Column]:
    """What is scored of a requirement: ``e``, the text that is embedded, and ``q``, the words of its text and aliases."""
    words = F.concat(tokenize(F.col("text")), F.flatten(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), tokenize)))
    return requirement_text(F.col("text"), F.col("aliases")).alias("e"), words.alias("q")


def corpus_stats(units: DataFrame, field: str) -> DataFrame:
    """One row: number of units N and mean token count avgdl. Disclaimers and units without tokens count too."""
    return units.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size(tokenize(F.col(field)))).alias("avgdl"))


def term_frequencies(units: DataFrame, field: str) -> DataFrame:
    """``(evidence_id, term, tf)``."""
    return units.select("evidence_id", F.explode(tokenize(F.col(field))).alias("term")).groupBy("evidence_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(units: DataFrame, field: str) -> DataFrame:
    """``(term, df)``: the units that hold each term. A term counts once per unit, so no pair table is needed."""
    return units.select(F.explode(F.array_distinct(tokenize(F.col(field)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


class _Lexicon:
    """What one lexical field needs on the workers: weights of the query terms and the block's query matrix."""

    def __init__(self, queries: list[list[str]], df: dict[str, int], n: int, avgdl: float, cfg: Config):
        words = sorted({w for q in queries for w in q if w in df})
        self.index = {w: k for k, w in enumerate(words)}
        self.idf = np.array([np.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) for w in words]) if words else np.zeros(0)
        self.query = np.zeros((len(words), len(queries)))
        for j, q in enumerate(queries):
            for w, c in Counter(q).items():
                if w in self.index:
                    self.query[self.index[w], j] = c
        self.avgdl, self.k1, self.b = avgdl or 1.0, cfg.k1, cfg.b

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.query.shape[1]))
        for k, text in enumerate(texts):
            tokens = TOKEN_RE.findall((text or "").lower())
            tf = Counter(self.index[t] for t in tokens if t in self.index)
            if tf:
                at = np.fromiter(tf.keys(), dtype=np.int64)
                f = np.fromiter(tf.values(), dtype=float)
                w = self.idf[at] * f * (self.k1 + 1) / (f + self.k1 * (1 - self.b + self.b * len(tokens) / self.avgdl))
                out[k] = w @ self.query[at]
        return stable_np(out)


def _given(vectors: pd.Series, width: int) -> np.ndarray:
    """Kept vectors as rows of unit length; a missing one, or one of another width, is a zero row."""
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors):
        if v is not None and len(v) == width:
            row[:] = v
    return unit_rows(out)


def _best_runner(lexicons: dict[str, _Lexicon], vectors: np.ndarray, keys: list[str], embed: Embedder, trace: int):
    names = np.array(keys, dtype=object)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.sort_values(["candidate_id", "ev_pos", "evidence_id"], kind="stable", ignore_index=True)
            cand = pdf["candidate_id"].to_numpy()
            starts = np.flatnonzero(np.r_[True, cand[1:] != cand[:-1]]) if len(cand) else np.array([], dtype=int)
            ends = np.r_[starts[1:], len(cand)]
            # whole candidates, about UNIT_BLOCK units at a time
            k = 0
            while k < len(starts):
                j = k + 1
                while j < len(starts) and ends[j] - starts[k] <= UNIT_BLOCK:
                    j += 1
                a, b = starts[k], ends[j - 1]
                part = pdf.iloc[a:b]
                sides = {f: lex.scores(list(part[f])) for f, lex in lexicons.items()}
                sides["semantic"] = stable_np(_given(part["vector"], vectors.shape[1]) @ vectors.T if "vector" in part else embed(list(part["embedded"])) @ vectors.T)
                pos, ids = part["ev_pos"].to_numpy(), part["evidence_id"].to_numpy()
                spans = list(zip(starts[k:j] - a, ends[k:j] - a))
                cols = {"candidate_id": np.repeat(cand[starts[k:j]], len(names)), "req_key": np.tile(names, len(spans))}
                for side, sc in sides.items():
                    if trace:
                        cols[side] = [
                            [{"score": float(sc[s + i, r]), "pos": int(-pos[s + i]), "id": ids[s + i]} for i in idx]
                            for s, e in spans
                            for r, idx in enumerate(np.argsort(-sc[s:e], axis=0, kind="stable")[:trace].T)
                        ]
                    else:
                        at = np.concatenate([s + sc[s:e].argmax(axis=0) for s, e in spans])
                        cols |= {f"{side}_s": sc[at, np.tile(np.arange(len(names)), len(spans))], f"{side}_p": -pos[at].astype(np.int32), f"{side}_i": ids[at]}
                yield pd.DataFrame(cols)
                k = j

    return run


def best_units(
    units: DataFrame, requirements: DataFrame, cfg: Config, fields: tuple[str, ...] = ("expanded", "normalized"), embed: Embedder = hashed, trace: int = 0
) -> DataFrame:
    """Per candidate and requirement the best usable unit on each side.

    ``units``: candidate_id, evidence_id, ev_pos, text, embedded, negated and the lexical fields. ``requirements``:
    req_key, text, aliases. Output: candidate_id, req_key and per side (the fields and ``semantic``) a struct (score,
    pos, id); the first unit wins ties, so a candidate whose units all score 0 cites the first. With ``trace`` each
    side is an array of the best ``trace`` units. If ``units`` have a column ``vector`` (:func:`semantic.cached_embedder`), it is read
    and only the requirements are embedded. Disclaimers count in the corpus statistics but are never matched.

    Plan: statistics of the query terms only are collected (bounded by the requirements' words); units are
    partitioned by candidate (a candidate of very many units over several tasks) and reduced batch by batch, so that
    what is shuffled after scoring is one row per candidate and requirement and task at most.
    """
    rows = requirements.select("req_key", *query_columns()).orderBy("req_key").collect()
    terms = units.sparkSession.createDataFrame([(w,) for w in sorted({w for r in rows for w in r["q"]})], "term string")
    total = units.agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.size(tokenize(F.col(f)))).alias(f) for f in fields]).first()
    held = F.array(*[F.struct(F.lit(f).alias("field"), F.array_distinct(tokenize(F.col(f))).alias("terms")) for f in fields])
    each = units.select(F.explode(held).alias("h")).select("h.field", F.explode("h.terms").alias("term"))
    counts = each.join(F.broadcast(terms), "term").groupBy("field", "term").agg(F.count(F.lit(1)).alias("df")).collect()
    stats = {f: ({r["term"]: r["df"] for r in counts if r["field"] == f}, total["n"], total[f]) for f in fields}
    usable = units.where(~F.coalesce("negated", F.lit(False))).select("candidate_id", "evidence_id", F.col("ev_pos").cast("int").alias("ev_pos"), "embedded", *fields, *(["vector"] if "vector" in units.columns else []))
    parts = max(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), units.sparkSession.sparkContext.defaultParallelism)
    part_of = F.when(F.col("ev_pos") > 0, F.floor(F.col("ev_pos") / CANDIDATE_UNITS)).otherwise(F.pmod(F.xxhash64("evidence_id"), F.lit(8)))
    usable = usable.repartition(parts, "candidate_id", part_of)
    sides = (*fields, "semantic")
    if trace:
        schema = "candidate_id string, req_key string, " + ", ".join(f"`{s}` array<struct<score:double,pos:int,id:string>>" for s in sides)
    else:
        schema = "candidate_id string, req_key string, " + ", ".join(f"{s}_s double, {s}_p int, {s}_i string" for s in sides)
    blocks = []
    for k in range(0, max(len(rows), 1), REQUIREMENT_BLOCK):
        some = rows[k : k + REQUIREMENT_BLOCK]
        lexicons = {f: _Lexicon([list(r["q"]) for r in some], *stats[f], cfg) for f in fields}
        run = _best_runner(lexicons, embed([r["e"] for r in some]), [r["req_key"] for r in some], embed, trace)
        blocks.append(usable.mapInPandas(run, schema))
    out = blocks[0]
    for b in blocks[1:]:
        out = out.unionByName(b)
    if trace:
        merged = [F.slice(F.sort_array(F.flatten(F.collect_list(s)), asc=False), 1, trace).alias(s) for s in sides]
    else:
        merged = [F.max(F.struct(F.col(f"{s}_s").alias("score"), F.col(f"{s}_p").alias("pos"), F.col(f"{s}_i").alias("id"))).alias(s) for s in sides]
    return out.groupBy("candidate_id", "req_key").agg(*merged)


def raw_matrix(best: DataFrame, candidates: DataFrame, requirements: DataFrame) -> DataFrame:
    """The dense matrix: every candidate against every requirement, 0 and no citation where a candidate has no usable unit.

    Columns: jd_id, req_key, candidate_id, expanded_raw, expanded_id, normalized_raw, normalized_id, semantic_raw, semantic_id.
    """
    sides = [c for c in best.columns if c not in ("candidate_id", "req_key")]
    grid = candidates.select("candidate_id").join(F.broadcast(requirements.select("jd_id", "req_key")))
    full = grid.join(best, ["candidate_id", "req_key"], "left")
    picked = [c for s in sides for c in (F.coalesce(F.col(s)["score"], F.lit(0.0)).alias(f"{s}_raw"), F.col(s)["id"].alias(f"{s}_id"))]
    return full.select("jd_id", "req_key", "candidate_id", *picked)


def normalised(raw: DataFrame, sides: tuple[str, ...]) -> DataFrame:
    """``raw`` with ``{side}_norm``: the z-score of each side over its pool; 0 where a requirement's scores do not vary.

    Mean and sample deviation are an aggregate of one row a requirement, joined back, not a window over the pool.
    """
    stats = raw.groupBy("jd_id", "req_key").agg(*[x for s in sides for x in (F.avg(f"{s}_raw").alias(f"_m_{s}"), F.stddev_samp(f"{s}_raw").alias(f"_d_{s}"))])
    both = raw.join(F.broadcast(stats), ["jd_id", "req_key"])
    z = [stable(z_score(F.col(f"{s}_raw"), F.col(f"_m_{s}"), F.col(f"_d_{s}"))).alias(f"{s}_norm") for s in sides]
    return both.select(*raw.columns, *z)


def fuse(alpha: Column, lexical_norm: Column, semantic_norm: Column) -> Column:
    return stable(sigmoid(alpha * lexical_norm + (1 - alpha) * semantic_norm))


def matrix(raw: DataFrame, cfg: Config) -> DataFrame:
    """Every cell normalised over its pool, fused and labelled.

    Adds lexical_norm, semantic_norm, fused, satisfied, matched_by and evidence_id. Where a requirement's scores do not
    vary, its z-scores are 0 and ``fused`` is 0.5.
    """
    lexical = cfg.lexical_field
    keys = ["jd_id", "req_key"]
    cells = normalised(raw, (lexical, "semantic")).select(
        *keys, "candidate_id", F.col(f"{lexical}_raw").alias("lexical_raw"), "semantic_raw", F.col(f"{lexical}_id").alias("_lid"), F.col("semantic_id").alias("_sid"),
        F.col(f"{lexical}_norm").alias("lexical_norm"), "semantic_norm", F.lit(cfg.alpha).alias("_a"),
    )
    cells = cells.withColumn("fused", fuse(F.col("_a"), F.col("lexical_norm"), F.col("semantic_norm")))
    lexical_hit, semantic_hit = F.col("lexical_norm") > cfg.both_threshold, F.col("semantic_norm") > cfg.both_threshold
    return cells.select(
        *keys, "candidate_id", "lexical_raw", "semantic_raw", "lexical_norm", "semantic_norm", "fused",
        (F.col("fused") >= cfg.satisfy_threshold).alias("satisfied"),
        F.when(lexical_hit & semantic_hit, "both").when(semantic_hit, "semantic").when(lexical_hit, "lexical").otherwise("none").alias("matched_by"),
        F.when(F.col("_a") >= 0.999, F.col("_lid")).when(F.col("_a") <= 0.001, F.col("_sid")).when(F.col("semantic_norm") >= F.col("lexical_norm"), F.col("_sid")).otherwise(F.col("_lid")).alias("evidence_id"),
    )


def candidate_scores(cells: DataFrame, requirements: DataFrame, cfg: Config) -> DataFrame:
    """Weighted mean times the gate per candidate, with the missing must-haves in requirement order."""
    w = F.when(F.col("weight").isNull() | (F.col("weight") == 0), F.lit(1.0)).otherwise(F.col("weight"))
    reqs = F.broadcast(requirements.select("req_key", "req_pos", "kind", w.alias("_w")))
    both = cells.join(reqs, "req_key").withColumn("_missing", (F.col("kind") == "MUST") & (F.col("fused") < cfg.gate_threshold))
    grouped = both.groupBy("jd_id", "candidate_id").agg(
        F.coalesce(F.try_divide(F.sum(F.col("fused") * F.col("_w")), F.sum("_w")), F.lit(0.0)).alias("base"),
        F.array_sort(F.collect_list(F.when(F.col("_missing"), F.struct("req_pos", "req_key")))).alias("_m"),
        F.count_if("satisfied").alias("requirements_met"),
        F.count(F.lit(1)).alias("requirements_total"),
        F.count_if(F.col("kind") == "MUST").alias("musts_total"),
    )
    penalty = F.pow(F.lit(cfg.gate_penalty), F.size("_m"))
    return grouped.select(
        "jd_id", "candidate_id", stable(F.col("base")).alias("base"), F.transform("_m", lambda x: x["req_key"]).alias("missing_must_haves"),
        stable(penalty).alias("gate_penalty"), stable(F.col("base") * penalty).alias("raw"), "requirements_met", "requirements_total",
        (F.col("musts_total") - F.size("_m")).alias("musts_met"), "musts_total",
    )


def scaled(raw: Column, lo: Column, hi: Column, cfg: Config) -> Column:
    """A score on the scale, by its place in the pool's span; the middle of the scale where the pool has none."""
    part = F.when(hi - lo < 1e-9, F.lit(0.5)).otherwise((raw - lo) / (hi - lo))
    return half_up(stable(F.lit(cfg.score_min) + part * (cfg.score_max - cfg.score_min)), 1)


def rank_candidates(scores: DataFrame, candidates: DataFrame, cfg: Config, extra: tuple[str, ...] = ()) -> DataFrame:
    """Scaled to the pool's span (the middle of the scale where it has none) and ranked 1..n by the unrounded score.

    Ties go by name in Unicode collation, then by candidate. Places come from ranges of (pool, score, name, candidate), so a
    pool of any size spreads over tasks.
    """
    keys = [*extra, "jd_id"]
    scores = materialize(scores)
    span = scores.groupBy(*keys).agg(F.min("raw").alias("_lo"), F.max("raw").alias("_hi"))
    final = scaled(F.col("raw"), F.col("_lo"), F.col("_hi"), cfg)
    named = scores.join(F.broadcast(span), keys).join(candidates.select("candidate_id", "name"), "candidate_id").withColumn("final_score", final).drop("_lo", "_hi")
    order = [F.col("raw").desc(), F.collate(F.coalesce("name", F.lit("")), "UNICODE"), F.col("candidate_id")]
    return places_in_groups(named, keys, order, "rank", kept=True)


def setting_scores(raw: DataFrame, requirements: DataFrame, cfg: Config, settings: list[tuple[object, float, str, float]]) -> DataFrame:
    """``(setting, jd_id, candidate_id, raw)``: gated scores under many settings ``(name, alpha, lexical field, gate)``.

    One pass over the normalised matrix: a candidate's totals under all settings are columns of one aggregate, and become
    rows only afterwards, so the matrix is never multiplied by the settings.
    """
    w = F.when(F.col("weight").isNull() | (F.col("weight") == 0), F.lit(1.0)).otherwise(F.col("weight"))
    fields = tuple(dict.fromkeys(field for _, _, field, _ in settings))
    cells = normalised(raw, (*fields, "semantic")).join(F.broadcast(requirements.select("req_key", "kind", w.alias("_w"))), "req_key")
    totals, rows = [], []
    for k, (name, alpha, field, gate) in enumerate(settings):
        fused = fuse(F.lit(float(alpha)), F.col(f"{field}_norm"), F.col("semantic_norm"))
        totals += [F.sum(fused * F.col("_w")).alias(f"s{k}"), F.count_if((F.col("kind") == "MUST") & (fused < gate)).alias(f"m{k}")]
        base = F.coalesce(F.try_divide(F.col(f"s{k}"), F.col("_ws")), F.lit(0.0))
        rows.append(F.struct(F.lit(name).alias("setting"), stable(base * F.pow(F.lit(cfg.gate_penalty), F.col(f"m{k}"))).alias("raw")))
    summed = cells.groupBy("jd_id", "candidate_id").agg(F.sum("_w").alias("_ws"), *totals)
    return summed.select("jd_id", "candidate_id", F.inline(F.array(*rows)))


def why_not_top(cells: DataFrame, ranked: DataFrame, requirements: DataFrame) -> DataFrame:
    """For every candidate but the first of its pool, the requirement with the greatest gap to the first, if above 0."""
    top = ranked.where("rank = 1").select("jd_id", F.col("candidate_id").alias("top_id"))
    pos = requirements.select("req_key", "req_pos")
    best = cells.join(F.broadcast(top), "jd_id").where("candidate_id = top_id").select("req_key", "top_id", F.col("fused").alias("top_fused"))
    both = cells.join(F.broadcast(best), "req_key").join(F.broadcast(pos), "req_key").where("candidate_id <> top_id")
    gap = F.struct(stable(F.col("top_fused") - F.col("fused")).alias("gap"), (-F.col("req_pos")).alias("p"), "req_key", "fused", "top_fused")
    most = both.groupBy("jd_id", "candidate_id", "top_id").agg(F.max(gap).alias("g")).where("g.gap > 0")
    return most.select(
        "jd_id", "candidate_id", "top_id", F.col("g.req_key").alias("req_key"), half_up(F.col("g.gap"), 2).alias("gap"), half_up(F.col("g.fused"), 2).alias("score"),
        half_up(F.col("g.top_fused"), 2).alias("top_score"),
    )


def prepare_units(evidence: DataFrame) -> DataFrame:
    """Evidence rows to what scoring reads: position from the id's ending, fallbacks for empty fields, negation."""
    scored = filled(F.col("scored_text"), F.col("text")) if "scored_text" in evidence.columns else F.col("text")
    normalized = filled(F.col("normalized"), F.col("text"))
    return evidence.select(
        F.coalesce("candidate_id", F.split("id", "::")[0]).alias("candidate_id"), F.col("id").alias("evidence_id"),
        F.coalesce(F.regexp_extract("id", r"(\d+)$", 1).try_cast("int"), F.lit(0)).alias("ev_pos"), "section", "text", scored.alias("embedded"),
        normalized.alias("normalized"), filled(F.col("expanded"), normalized).alias("expanded"), F.coalesce("negated", is_negated(F.col("text"))).alias("negated"),
    )
