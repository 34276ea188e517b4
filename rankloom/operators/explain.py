"""Extractive explanations of a ranking: matched and missing requirements with citations, disclaimers, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.numbers import half_up
from rankloom.functions.text import informative_terms, short_requirement

MAX_MATCHED = 4
SHORT_CITATION, LONG_CITATION = 40, 260


def requirement_words(text: Column, aliases: Column) -> Column:
    return F.concat_ws(" ", F.array(text), F.coalesce(aliases, F.array().cast("array<string>")))


def vocabulary_gap(terms: Column, evidence: Column) -> Column:
    """True if no term stands in the evidence with a blank on at least one side; false for no evidence."""
    hay = F.concat(F.lit(" "), F.lower(evidence), F.lit(" "))
    named = F.exists(terms, lambda t: hay.contains(F.concat(t, F.lit(" "))) | hay.contains(F.concat(F.lit(" "), t)))
    return F.coalesce((evidence != "") & ~named, F.lit(False))


def how_matched(matched_by: Column, gap: Column) -> Column:
    return (
        F.when((matched_by == "semantic") & gap, "found by meaning; the evidence never uses the requirement's wording")
        .when(matched_by == "semantic", "matched on meaning")
        .when(matched_by == "both", "matched on both the exact term and its meaning")
        .when(matched_by == "lexical", "matched on the exact term")
        .otherwise("no supporting evidence found")
    )


def _unit_terms(cells: DataFrame, units: DataFrame, requirements: DataFrame, least: int) -> DataFrame:
    """Cells with their requirement's terms, joined to all units of their candidate."""
    terms = informative_terms(requirement_words(F.col("text"), F.col("aliases")), least)
    reqs = requirements.select("req_key", terms.alias("terms"))
    return cells.join(F.broadcast(reqs), "req_key").join(units, "candidate_id")


def best_citations(cited: DataFrame, units: DataFrame, requirements: DataFrame) -> DataFrame:
    """A better quote for cells whose citation is short: ``(jd_id, req_key, candidate_id, quote)``.

    ``cited``: jd_id, req_key, candidate_id, evidence_text. A citation of SHORT_CITATION letters stays. Otherwise the
    unit with the greatest 2 * hits + 2 (experience or projects) - length / 500 is quoted, the first on ties, from
    units of middle length that are no disclaimers; if none has a hit, the citation stays.
    """
    keys = ["jd_id", "req_key", "candidate_id"]
    short = cited.where(F.length(F.coalesce("evidence_text", F.lit(""))) < SHORT_CITATION).select(*keys)
    usable = units.where(~F.col("negated") & F.length("text").between(SHORT_CITATION, LONG_CITATION)).select("candidate_id", "ev_pos", "text", "section")
    pairs = _unit_terms(short, usable, requirements, 3)
    low = F.lower("text")
    hits = F.size(F.filter("terms", lambda t: low.contains(t)))
    bonus = F.when(F.col("section").isin("experience", "projects"), 2).otherwise(0)
    scored = pairs.withColumn("_h", hits).where("_h > 0")
    score = F.col("_h") * 2 + bonus - F.length("text") / 500.0
    best = scored.groupBy(*keys).agg(F.max(F.struct(F.round(score, 9).alias("s"), (-F.col("ev_pos")).alias("p"), "text")).alias("b"))
    quote = F.coalesce("b.text", "evidence_text", F.lit(""))
    return cited.join(best, keys, "left").select(*keys, quote.alias("quote"))


def disclaimers(units: DataFrame, requirements: DataFrame) -> DataFrame:
    """The first disclaimer of a candidate that names a requirement: ``(req_key, candidate_id, disclaimed_by)``.

    The requirements' terms, a stated query set, are looked for in the distinct texts of all disclaimers; only what is found is joined back to
    the candidates who said so.
    """
    negated = units.where("negated").select("candidate_id", "ev_pos", "text")
    terms = informative_terms(requirement_words(F.col("text"), F.col("aliases")), 4)
    asked = requirements.select(F.explode(terms).alias("term"), "req_key").groupBy("term").agg(F.collect_set("req_key").alias("keys"))
    said = negated.select("text", F.lower("text").alias("low")).distinct()
    named = said.join(F.broadcast(asked), F.col("low").contains(F.col("term"))).select("text", F.explode("keys").alias("req_key")).distinct()
    return negated.join(named, "text").groupBy("req_key", "candidate_id").agg(F.min_by("text", F.struct("ev_pos", "text")).alias("disclaimed_by"))


def matched_requirements(cells: DataFrame, units: DataFrame, requirements: DataFrame) -> DataFrame:
    """The best MAX_MATCHED satisfied requirements of each candidate and brief, by fused score, with quotes.

    Only the kept cells meet the units, so the quote search is bounded by MAX_MATCHED per candidate.
    """
    w = Window.partitionBy("jd_id", "candidate_id").orderBy(F.col("fused").desc(), "req_pos")
    reqs = requirements.select("req_key", "req_pos", "kind")
    kept = cells.where("satisfied and evidence_id is not null").join(F.broadcast(reqs), "req_key").withColumn("position", F.row_number().over(w)).where(F.col("position") <= MAX_MATCHED)
    text = units.select("evidence_id", F.col("text").alias("evidence_text"))
    cited = kept.join(text, "evidence_id").where("evidence_text <> ''")
    quotes = best_citations(cited.select("jd_id", "req_key", "candidate_id", "evidence_text"), units, requirements)
    terms = informative_terms(requirement_words(F.col("text"), F.col("aliases")), 3)
    named = requirements.select("req_key", F.col("text").alias("requirement_text"), terms.alias("_t"))
    full = cited.join(quotes, ["jd_id", "req_key", "candidate_id"]).join(F.broadcast(named), "req_key")
    gap = vocabulary_gap(F.col("_t"), F.col("quote"))
    return full.select(
        "jd_id", "candidate_id", "position", "req_key", "requirement_text", "kind", F.col("quote").alias("evidence_text"), half_up(F.col("fused"), 2).alias("score"), "matched_by",
        how_matched(F.col("matched_by"), gap).alias("how"), ((F.col("matched_by") == "semantic") & gap).alias("vocabulary_gap"),
    )


def missing_requirements(cells: DataFrame, units: DataFrame, requirements: DataFrame, gate: float) -> DataFrame:
    """Must-haves below the gate, then nice-to-haves not satisfied, each with a disclaimer if the candidate made one."""
    reqs = requirements.select("req_key", "req_pos", "kind", F.col("text").alias("requirement_text"))
    lacking = F.when(F.col("kind") == "MUST", F.col("fused") < gate).otherwise(~F.col("satisfied"))
    open_ = cells.join(F.broadcast(reqs), "req_key").where(lacking)
    said = disclaimers(units, requirements)
    return open_.join(said, ["req_key", "candidate_id"], "left").select(
        "jd_id", "candidate_id", "req_key", "req_pos", "requirement_text", "kind", half_up(F.col("fused"), 2).alias("score"), "disclaimed_by"
    )


def _plural(n: Column, one: str, many: str) -> Column:
    return F.when(n == 1, one).otherwise(many)


def summaries(ranked: DataFrame, matched: DataFrame, missing: DataFrame) -> DataFrame:
    """A readable summary per ranked row, put together from its figures and quotes; the same every time."""
    keys = ["jd_id", "candidate_id"]
    head = matched.groupBy(*keys).agg(
        F.min_by(F.struct("requirement_text", "evidence_text", "how"), "position").alias("h"), F.count_if("vocabulary_gap").alias("gaps")
    )
    musts = missing.where("kind = 'MUST'").groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("req_pos", short_requirement(F.col("requirement_text")).alias("t"), "disclaimed_by"))).alias("m")
    )
    pool = ranked.groupBy("jd_id").agg(F.count(F.lit(1)).alias("pool"))
    full = ranked.join(F.broadcast(pool), "jd_id").join(head, keys, "left").join(musts, keys, "left")
    n = F.coalesce(F.size("m"), F.lit(0))
    said = F.element_at(F.filter(F.col("m"), lambda x: x["disclaimed_by"].isNotNull()), 1)
    parts = [
        F.format_string(
            "Ranked #%d of %d with a score of %s. Meets %d of %d requirements, including %d of %d must-haves.",
            "rank", "pool", F.col("final_score").cast("string"), "requirements_met", "requirements_total", "musts_met", "musts_total",
        ),
        F.when(F.col("h").isNotNull(), F.concat(F.lit('Strongest match: "'), short_requirement(F.col("h.requirement_text")), F.lit('": "'), F.col("h.evidence_text"), F.lit('" ('), F.col("h.how"), F.lit(")."))),
        F.when(F.col("gaps") > 0, F.concat(_plural(F.col("gaps"), "One requirement was", "Several requirements were"), F.lit(" matched by meaning alone; a keyword search would have missed "), _plural(F.col("gaps"), "it.", "them."))),
        F.when(n > 0, F.concat(F.lit("Missing "), n.cast("string"), _plural(n, " must-have: ", " must-haves: "), F.array_join(F.transform("m", lambda x: x["t"]), "; "), F.lit("."))).otherwise("No must-have requirements are missing."),
        F.when(F.size(F.filter(F.coalesce("m", F.array().cast("array<struct<req_pos:int,t:string,disclaimed_by:string>>")), lambda x: x["disclaimed_by"].isNotNull())) > 0, F.concat(F.lit('The candidate states this directly: "'), said["disclaimed_by"], F.lit('"'))),
    ]
    return full.select(*keys, "rank", F.concat_ws(" ", *parts).alias("summary"))
