"""The queries of the engine's own operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.config import ALPHA_SWEEP, GATE_SWEEP, Config, preset
from rankloom.functions import text as T
from rankloom.functions.numbers import shown, stable
from rankloom.functions.aliases import detect_skills, expand_exact, expand_repaired, fuzzy_table
from rankloom.operators import bias, evaluate, explain, match, requirements, semantic, split
from rankloom.operators.packed import label_lines, unpack_values
from rankloom.plans.pool import Pool, pool
from rankloom.plans.sql import SQL  # noqa: F401 - registered with the queries
from rankloom.session import latest, load

FLAGSHIP = "final_rank"
CFG = Config()


def _packed_values(spark: SparkSession, d: str) -> DataFrame:
    packed = load(spark, d, "evidence").where(F.col("unit_kind") == "packed")
    units = latest(packed, ["id"], ["text"]).select(
        F.lit("evidence.text").alias("field"), F.col("id").alias("record_id"), F.lit(1).alias("line_no"), F.col("text").alias("line")
    )
    lines = label_lines(load(spark, d, "candidates"), "id", "raw_text", "candidates.raw_text")
    return unpack_values(lines.unionByName(units))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per value of each label line of the resumes and of each packed evidence unit."""
    return _packed_values(spark, d).drop("flag")


def p7_plain(spark: SparkSession, d: str) -> DataFrame:
    """The values of the packed evidence units that have neither quotes nor brackets."""
    plain = latest(load(spark, d, "evidence").where(F.col("unit_kind") == "packed"), ["id"], ["text"]).where(~F.col("text").rlike("[\"'“”‘’«»()]"))
    return p7_found(spark, d).where("field = 'evidence.text'").join(plain.select(F.col("id").alias("record_id")), "record_id", "left_semi").select("record_id", "item_pos", "item")


def p7_flags(spark: SparkSession, d: str) -> DataFrame:
    """The values with a malformed quote or bracket, and which it is."""
    return _packed_values(spark, d).where("flag <> ''")


# --- text functions and corpus statistics -------------------------------------------------------------------------


def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return pool(spark, d).units.select("evidence_id", T.normalize(F.col("text")).alias("normalized_text"))


def tokenize_stats(spark: SparkSession, d: str) -> DataFrame:
    t = T.tokenize(F.col("text"))
    return pool(spark, d).units.select("evidence_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"))


def term_freq(spark: SparkSession, d: str) -> DataFrame:
    return match.term_frequencies(pool(spark, d).units, "expanded")


def doc_freq(spark: SparkSession, d: str) -> DataFrame:
    return match.document_frequencies(pool(spark, d).units, "expanded")


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return match.corpus_stats(pool(spark, d).units, "expanded").select("n_docs", F.round("avgdl", 6).alias("avgdl"))


def negation_flag(spark: SparkSession, d: str) -> DataFrame:
    return pool(spark, d).units.select("evidence_id", T.is_negated(F.col("text")).alias("negated"))


def noise_filter(spark: SparkSession, d: str) -> DataFrame:
    return pool(spark, d).units.select("evidence_id", T.is_noise(F.col("text"), F.col("section")).alias("noise"))


def section_classify(spark: SparkSession, d: str) -> DataFrame:
    """Heading lines of all resumes with the section they open."""
    lines = pool(spark, d).candidates.where("raw_text is not null").select("candidate_id", F.posexplode(F.split("raw_text", "\n", -1)).alias("line_no", "line"))
    return lines.select("candidate_id", "line_no", T.section_of(F.col("line")).alias("section")).where("section is not null")


def alias_expand_exact(spark: SparkSession, d: str) -> DataFrame:
    return pool(spark, d).units.select("evidence_id", expand_exact(F.col("text")).alias("expanded_text"))


def detect_skills_all(spark: SparkSession, d: str) -> DataFrame:
    return pool(spark, d).candidates.select("candidate_id", F.array_join(detect_skills(F.col("raw_text")), ",").alias("skills"))


def fuzzy_alias(spark: SparkSession, d: str) -> DataFrame:
    return fuzzy_table(pool(spark, d).units, "text").select("token", "alias", F.array_join("canonical", ",").alias("canonical"))


def section_pivot(spark: SparkSession, d: str) -> DataFrame:
    names = ["experience", "projects", "skills", "education", "other"]
    return pool(spark, d).units.groupBy("candidate_id").pivot("section", names).count().na.fill(0, names)


def parse_quality(spark: SparkSession, d: str) -> DataFrame:
    p = pool(spark, d)
    r = split.parse_report(p.candidates, p.units, "candidate_id", "raw_text", "skills_declared")
    return r.select("candidate_id", "units", F.array_join("flags", ",").alias("flags"))


def split_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Resumes split anew into evidence units."""
    return split.split_documents(pool(spark, d).candidates, "candidate_id", "raw_text")


def brief_header(spark: SparkSession, d: str) -> DataFrame:
    """Title and company read from each brief's first lines."""
    return requirements.brief_headers(load(spark, d, "jds"), "id", "raw_text")


def rank_percentile(spark: SparkSession, d: str) -> DataFrame:
    """Role, class and percentile of every ranked candidate."""
    return _labelled(pool(spark, d)).select("jd_id", "candidate_id", "role", "cls", "rank", shown(F.col("percentile")).alias("percentile"))


def alias_expand(spark: SparkSession, d: str) -> DataFrame:
    """Expansion with typo repair, over the whole column."""
    return expand_repaired(pool(spark, d).units, "evidence_id", "text").select("evidence_id", "expanded_text")


def decompose_jd(spark: SparkSession, d: str) -> DataFrame:
    return requirements.decompose_briefs(load(spark, d, "jds"), "id", "raw_text")


# --- the matrix and the ranking --------------------------------------------------------------------------------------


def _side(spark: SparkSession, d: str, side: str) -> DataFrame:
    return pool(spark, d).raw.select("req_key", "candidate_id", shown(F.col(f"{side}_raw")).alias("raw"), F.col(f"{side}_id").alias("evidence_id"))


def bm25_argmax(spark: SparkSession, d: str) -> DataFrame:
    """Best unit of each candidate for each requirement by term relevance."""
    return _side(spark, d, "expanded")


def cosine_argmax(spark: SparkSession, d: str) -> DataFrame:
    return _side(spark, d, "semantic")


def trace_top5(spark: SparkSession, d: str) -> DataFrame:
    """The five best units of each side per requirement and candidate, in order."""
    p = pool(spark, d)
    best = match.best_units(p.units, p.requirements, p.cfg, fields=("expanded",), trace=match.TRACE)
    ids = [F.array_join(F.transform(s, lambda x: x["id"]), ",").alias(f"{s}_ids") for s in ("expanded", "semantic")]
    return best.select("req_key", "candidate_id", *ids)


def semantic_search_top5(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 20."""
    v = load(spark, d, "embeddings")
    return semantic.top_k(v, v.where(F.col("vec_id") % 20 == 0), "vec_id", "embedding", 5).select("query_id", F.col("id").alias("vec_id"), shown(F.col("score")).alias("score"), "position")


def pool_zscore(spark: SparkSession, d: str) -> DataFrame:
    c = pool(spark, d).cells()
    return c.select("req_key", "candidate_id", shown(F.col("lexical_norm")).alias("lexical_norm"), shown(F.col("semantic_norm")).alias("semantic_norm"))


def fuse_matrix(spark: SparkSession, d: str) -> DataFrame:
    c = pool(spark, d).cells()
    return c.select("req_key", "candidate_id", shown(F.col("fused")).alias("fused"), "satisfied", "matched_by", "evidence_id")


def must_have_gate(spark: SparkSession, d: str) -> DataFrame:
    s = pool(spark, d).scores()
    return s.select("jd_id", "candidate_id", F.array_join("missing_must_haves", ",").alias("missing"), shown(F.col("gate_penalty")).alias("gate_penalty"))


def weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    s = pool(spark, d).scores()
    return s.select("jd_id", "candidate_id", shown(F.col("base")).alias("base"), shown(F.col("raw")).alias("raw"), "requirements_met", "musts_met")


def _ranking(ranked: DataFrame) -> DataFrame:
    return ranked.select("jd_id", "candidate_id", "rank", F.round("final_score", 1).alias("final_score"))


def final_rank(spark: SparkSession, d: str) -> DataFrame:
    """The whole pipeline: every candidate ranked for every brief."""
    return _ranking(pool(spark, d).ranked())


def lexical_only_rank(spark: SparkSession, d: str) -> DataFrame:
    return _ranking(pool(spark, d).ranked(preset("lexical_only")))


def ablation_ranks(spark: SparkSession, d: str) -> DataFrame:
    p = pool(spark, d)
    return evaluate.ablation(p.raw, p.requirements, p.candidates, CFG)


def why_not_top(spark: SparkSession, d: str) -> DataFrame:
    p = pool(spark, d)
    return match.why_not_top(p.cells(), p.ranked(), p.requirements)


# --- explanations and questions --------------------------------------------------------------------------------------


def explanation_matched(spark: SparkSession, d: str) -> DataFrame:
    p = pool(spark, d)
    return explain.matched_requirements(p.cells(), p.units, p.requirements)


def explanation_missing(spark: SparkSession, d: str) -> DataFrame:
    p = pool(spark, d)
    return explain.missing_requirements(p.cells(), p.units, p.requirements, CFG.gate_threshold).drop("requirement_text", "req_pos")


def disclaimers(spark: SparkSession, d: str) -> DataFrame:
    p = pool(spark, d)
    return explain.disclaimers(p.units, p.requirements).join(p.candidates.select("candidate_id"), "candidate_id", "left_semi").select("req_key", "candidate_id", "disclaimed_by")


def explanation_summary(spark: SparkSession, d: str) -> DataFrame:
    """The summary of every ranked candidate."""
    p = pool(spark, d)
    cells = p.cells()
    matched = explain.matched_requirements(cells, p.units, p.requirements)
    missing = explain.missing_requirements(cells, p.units, p.requirements, CFG.gate_threshold)
    return explain.summaries(p.ranked(), matched, missing)


def who_has(spark: SparkSession, d: str) -> DataFrame:
    """For every catalogue skill, each candidate's first unit that mentions it (disclaimers aside)."""
    skills = load(spark, d, "skill_catalog").select("skill_id", T.normalize(F.col("canonical")).alias("needle")).where("needle <> ''")
    units = pool(spark, d).units.where("not negated").select("candidate_id", "evidence_id", "ev_pos", "expanded")
    hits = units.join(F.broadcast(skills), F.col("expanded").contains(F.col("needle")))
    return hits.groupBy("skill_id", "candidate_id").agg(F.min(F.struct("ev_pos", "evidence_id")).alias("b")).select("skill_id", "candidate_id", F.col("b.evidence_id").alias("evidence_id"))


def _gaps(p: Pool, high: int, low: int) -> DataFrame:
    """Requirement gaps between two places of each brief's ranking."""
    ranked = p.ranked().where(F.col("rank").isin(high, low)).select("jd_id", "candidate_id", "rank")
    cells = p.cells().join(F.broadcast(ranked), ["jd_id", "candidate_id"])
    both = cells.groupBy("jd_id", "req_key").agg(F.max(F.when(F.col("rank") == high, F.col("fused"))).alias("hi"), F.max(F.when(F.col("rank") == low, F.col("fused"))).alias("lo"))
    pos = p.requirements.select("req_key", "req_pos")
    return both.join(F.broadcast(pos), "req_key").withColumn("gap", stable(F.coalesce("hi", F.lit(0.0)) - F.coalesce("lo", F.lit(0.0))))


def compare_pair(spark: SparkSession, d: str) -> DataFrame:
    """Why the first of each brief is above the second: the three greatest gaps over 0.02."""
    w = Window.partitionBy("jd_id").orderBy(F.col("gap").desc(), "req_pos")
    g = _gaps(pool(spark, d), 1, 2).where("gap > 0.02").withColumn("position", F.row_number().over(w)).where("position <= 3")
    return g.select("jd_id", "req_key", shown(F.col("gap")).alias("gap"), "position")


def why_not_candidate(spark: SparkSession, d: str) -> DataFrame:
    """Why the fourth of each brief is not among the first three: its three greatest gaps to the first."""
    w = Window.partitionBy("jd_id").orderBy(F.col("gap").desc(), "req_pos")
    g = _gaps(pool(spark, d), 1, 4).where("lo is not null").withColumn("position", F.row_number().over(w)).where("position <= 3")
    return g.select("jd_id", "req_key", shown(F.col("gap")).alias("gap"), "position")


def bias_flags(spark: SparkSession, d: str) -> DataFrame:
    return bias.flag_phrases(load(spark, d, "documents"), "doc_id", "text")


def seniority_overreach(spark: SparkSession, d: str) -> DataFrame:
    return bias.flag_overreach(load(spark, d, "documents"), "doc_id", "text")


# --- evaluation ------------------------------------------------------------------------------------------------------


def _labelled(p: Pool) -> DataFrame:
    return evaluate.labelled(p.ranked(), p.candidates)


def role_class(spark: SparkSession, d: str) -> DataFrame:
    role = evaluate.role_of(F.coalesce("source_file", F.lit("")))
    return pool(spark, d).candidates.select("candidate_id", role.alias("role"), evaluate.class_of(role).alias("cls"))


def class_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.class_summary(_labelled(pool(spark, d)))


def precision_purity(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.precision_purity(_labelled(pool(spark, d)))


def role_means(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.role_means(_labelled(pool(spark, d)))


def misplaced(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.misplaced(_labelled(pool(spark, d)))


def score_distribution(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.score_distribution(pool(spark, d).ranked())


def alpha_sweep(spark: SparkSession, d: str) -> DataFrame:
    p = pool(spark, d)
    return evaluate.sweep(p.raw, p.requirements, p.candidates, CFG, "alpha", ALPHA_SWEEP)


def best_alpha(spark: SparkSession, d: str) -> DataFrame:
    """The best alpha of each brief by precision, then separation, then the smaller value."""
    return evaluate.best_setting(alpha_sweep(spark, d))


def best_gate(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.best_setting(gate_sweep(spark, d))


def gate_sweep(spark: SparkSession, d: str) -> DataFrame:
    p = pool(spark, d)
    return evaluate.sweep(p.raw, p.requirements, p.candidates, CFG, "gate_threshold", GATE_SWEEP)


def institution_audit(spark: SparkSession, d: str) -> DataFrame:
    """How far each candidate's score moves per brief when only the institution in the resume changes."""
    p = pool(spark, d)
    return evaluate_audit(p)


def evaluate_audit(p: Pool) -> DataFrame:
    from rankloom.operators.audit import institution_spread

    return institution_spread(p.candidates, p.requirements, p.cfg)


def embedding_cache_misses(spark: SparkSession, d: str) -> DataFrame:
    """Keys of the texts that a cache of the requirement texts lacks."""
    p = pool(spark, d)
    have = p.requirements.select(semantic.cache_key("hashed-64", F.col("text")).alias("key")).distinct()
    return semantic.cache_misses(p.units, "embedded", have, "hashed-64").select("key")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p7_found, p7_flags, p7_plain, normalize_text, tokenize_stats, term_freq, doc_freq, corpus_stats, negation_flag, noise_filter, section_classify, alias_expand_exact,
        detect_skills_all, fuzzy_alias, section_pivot, parse_quality, split_evidence, alias_expand, decompose_jd, brief_header, bm25_argmax, cosine_argmax, trace_top5, semantic_search_top5,
        pool_zscore, fuse_matrix, must_have_gate, weighted_mean, final_rank, lexical_only_rank, ablation_ranks, why_not_top, explanation_matched, explanation_missing,
        disclaimers, explanation_summary, who_has, compare_pair, why_not_candidate, bias_flags, seniority_overreach, role_class, rank_percentile, class_summary, precision_purity,
        role_means, misplaced, score_distribution, alpha_sweep, gate_sweep, best_alpha, best_gate, institution_audit, embedding_cache_misses,
    )
}
