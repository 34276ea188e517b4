"""Stated outcomes on texts written for them: constants, edge cases, planted phrases, a small ranking, answers and summaries."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom import config
from rankloom.functions import text as T
from rankloom.functions.aliases import ALIASES, fuzzy_alias, reverse
from rankloom.operators import audit, bias, chat, evaluate, explain, match, requirements, split
from tests.conftest import rows

CFG = config.Config()


def test_constants():
    assert (CFG.k1, CFG.b, CFG.alpha, CFG.gate_threshold, CFG.gate_penalty, CFG.satisfy_threshold, CFG.both_threshold) == (1.5, 0.75, 0.5, 0.45, 0.75, 0.5, 0.0)
    assert config.MODES == {"hybrid": 0.5, "lexical_only": 1.0, "semantic_only": 0.0} and (CFG.score_min, CFG.score_max) == (0.0, 100.0)
    assert config.ALPHA_SWEEP == (0.0, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 1.0) and config.GATE_SWEEP == tuple(round(0.3 + 0.05 * k, 2) for k in range(9))
    assert {c: w for c, (w, _) in requirements.CATEGORIES.items()} == {"education": 0.6, "soft": 0.3, "experience": 0.8, "skill": 1.0, "location": 0.8}
    assert (requirements.CORE_WEIGHT, requirements.NICE_CAP, set(requirements.CORE)) == (1.2, 0.5, {"node.js", "react", "javascript", "python", "java"})
    assert T.MIN_LENGTH == {"skills": 2, "experience": 12, "projects": 12, "education": 8, "other": 12} and (split.MAX_CLAIM, split.LONG_PROSE) == (300, 200)
    assert len(ALIASES) == 18 and len(T.STOPWORDS) == 30 and reverse()["mongodb"] == ("mongodb", "database") or reverse()["mongo"] == ("mongodb", "database")
    assert [len(bias.RULES), [m for _, _, m in bias.SENIORITY]] == [12, [0, 1, 4, 99]] and (chat.LEAST_GAP, chat.SHOWN_GAPS, chat.SHOWN_HITS, chat.SHOWN_PICKS, chat.LEAST_COSINE) == (0.02, 3, 6, 5, 0.25)
    assert (explain.MAX_MATCHED, explain.SHORT_CITATION, explain.LONG_CITATION, evaluate.NOISE_FLOOR) == (4, 40, 260, 1.0)


def test_lines():
    for line, want in [("Languages: Python, SQL, C++", None), ("Bachelor of Technology", None), ("PROFESSIONAL SUMMARY", "other"), ("Academic Projects", "projects"), ("Things I did", "projects"), ("Tech Stack", "skills"), ("Career History:", "experience")]:
        assert T.section_of_py(line) == want
    assert fuzzy_alias("pyhton") == "python" and reverse()[fuzzy_alias("string")] == ("java",) and fuzzy_alias("python") is None
    assert split.looks_like_heading("Things Done At Home") and not split.looks_like_heading("Habit Tracker -- Jan 2023") and not split.looks_like_heading("things done")
    assert split.unknown_section(["Built a weather app for farmers"]) == "projects" and split.unknown_section(["Sold shoes"]) == "experience" and split.unknown_section([" "]) == "other"
    long = "I ran the shop for years and kept the books of three branches in good order. " * 3
    assert len(split.split_claims(long, "experience")) == 3 and len(split.split_claims(long[:150], "experience")) == 1
    assert split.strip_institution("B.Tech Physics, VIT Vellore (2019-2023), CGPA 8") == "B.Tech Physics, (2019-2023), CGPA 8" and split.strip_institution("B.Tech Physics") is None
    assert split.strip_institution("Ran a shop, kept the books") is None
    assert split.identity_place("Asha Rao | a@b.co | Pune", "Asha Rao") == "Pune" and split.identity_place("98765 43210", "") is None
    assert split.extract_name("CV 2020\nAsha Rao\nSKILLS", "x") == "Asha Rao" and split.extract_name(None, "file") == "file"


def test_documents_of_unusual_shape():
    assert split.evidence_units("SKILLS\n" + "\n".join(f"- tool{k}" for k in range(3_000)))[-1]["text"] == "tool2999"
    unit = split.evidence_units("EXPERIENCE\n" + "word " * 20_000)[0]["text"]
    assert len(unit) <= 301 and unit.endswith("…")
    assert split.evidence_units("\n\n \n") == [] and split.evidence_units("SKILLS") == []


PLANTED = [
    ("gendered", "He/She will lead", "he/she"), ("gendered", "plan the man-hours", "man-hours"), ("gendered", "a Rockstar of code", "rockstar"), ("gendered", "be fearless", "fearless"), ("age", "an energetic team", "energetic"),
    ("age", "born after 1999", "born after"), ("age", "under 30 years old", "under 30 years old"), ("elitism", "from a Tier-1 school", "tier-1"), ("elitism", "CGPA above 8.5", "cgpa above 8.5"), ("elitism", "distinction only", "distinction only"),
    ("elitism", "from a reputed college", "from a reputed college"), ("vague", "good culture fit", "culture fit"), ("vague", "must be able to work weekends", "must be able to work weekends"), ("vague", "native English speaker", "native english"),
]
CLEAN = ["They will lead the team", "a plan for people", "the nitrogen tank", "Knows English well", "grades matter little", None, ""]


def test_planted_phrases(spark):
    data = [(k, t) for k, (_, t, _) in enumerate(PLANTED)] + [(100 + k, t) for k, t in enumerate(CLEAN)]
    docs = spark.createDataFrame(data, "id int, body string")
    assert set(rows(bias.flag_phrases(docs, "id", "body"))) == {(k, c, p) for k, (c, _, p) in enumerate(PLANTED)}
    for c, t, p in PLANTED:
        assert [(f["category"], f["phrase"].lower(), f["note"]) for f in bias.flag_brief(t)] == [(c, p, bias.ADVICE[c])]


def test_planted_overreach(spark):
    said = [(1, "Trainee with 2+ years of work experience"), (2, "Junior clerk, 1 year experience"), (3, "Junior clerk, 3 years of sales experience"), (4, "Mid-level, 6 yrs exp"), (5, "Senior, 20 years experience"), (6, "12 years of experience"), (7, "Intern and Senior: 1 year of experience")]
    docs = spark.createDataFrame(said, "id int, body string")
    assert rows(bias.flag_overreach(docs, "id", "body"), "id", "label", "max_years", "years") == [(1, "intern", 0, 2), (3, "junior", 1, 3), (4, "mid-level", 4, 6), (7, "intern", 0, 1)]


# --- a small ranking with an embedder that knows a few meanings

MEANINGS = {
    0: "react component interface browser pages", 1: "node server backend requests", 2: "mongodb document records", 3: "git versioning branches", 4: "html css markup styled", 5: "paint mural gallery", 6: "garden soil",
}
_DIM = {w: d for d, ws in MEANINGS.items() for w in ws.split()}


def meanings(texts):
    out = np.zeros((len(texts), 8))
    for row, t in zip(out, texts):
        for w in (t or "").lower().replace(",", " ").replace(".", " ").split():
            row[_DIM.get(w, 7)] += 1.0 if w in _DIM else 0.15
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=out, where=norm > 0)


POOL = {
    "named": ["Wrote React screens for a shop", "Kept a Node service running", "Stored orders in MongoDB", "Used git every day", "Wrote html and css for a club"],
    "meant": ["Made interface pages for a browser game", "Answered requests on the backend server", "Saved records as a document each", "Merged branches with versioning", "Styled markup for a choir"],
    "front": ["Wrote React screens and html", "Wrote css for many pages", "Painted the shop window", "Sang in a choir"],
    "other": ["Paint a mural in the gallery", "Turned soil in the garden", "Sang in a choir"],
}
ASKED = [("r1", "React", "MUST"), ("r2", "Node", "MUST"), ("r3", "MongoDB", "MUST"), ("r4", "git", "MUST"), ("r5", "html css", "NICE")]


@pytest.fixture(scope="module")
def shop(spark):
    ev = [(f"{c}::ev_{k:03d}", c, "experience", t, T.normalize_py(t), None, False) for c, ts in POOL.items() for k, t in enumerate(ts, 1)]
    units = match.prepare_units(spark.createDataFrame(ev, "id string, candidate_id string, section string, text string, normalized string, expanded string, negated boolean")).cache()
    reqs = spark.createDataFrame([("j", k, i, t, kind, [], 1.0) for i, (k, t, kind) in enumerate(ASKED, 1)], "jd_id string, req_key string, req_pos int, text string, kind string, aliases array<string>, weight double").cache()
    cands = spark.createDataFrame([(c, c.title(), f"{c}.txt") for c in POOL], "candidate_id string, name string, source_file string").cache()
    raw = match.raw_matrix(match.best_units(units, reqs, CFG, embed=meanings), cands, reqs).cache()
    return units, reqs, cands, raw


def test_meaning_rescues_who_words_bury(shop):
    _, reqs, cands, raw = shop
    places = {}
    for mode in config.MODES:
        cfg = config.preset(mode)
        ranked = match.rank_candidates(match.candidate_scores(match.matrix(raw, cfg), reqs, cfg), cands, cfg)
        places[mode] = {r["candidate_id"]: r["rank"] for r in ranked.collect()}
        assert places[mode]["named"] <= 2 and sorted(places[mode].values()) == [1, 2, 3, 4]
    assert places["hybrid"]["meant"] < places["lexical_only"]["meant"] and places["semantic_only"]["meant"] <= 2
    assert places["hybrid"]["other"] == 4 and places["hybrid"]["front"] == 3  # the gate keeps who lacks must-haves below
    table = {r["candidate_id"]: r for r in evaluate.ablation(raw, reqs, cands, CFG).collect()}
    assert {c: r["hybrid_rank"] for c, r in table.items()} == places["hybrid"] and table["meant"]["lexical_to_hybrid"] > 0


def test_places_do_not_hang_on_partitions(spark, shop):
    _, reqs, cands, raw = shop
    scores = match.candidate_scores(match.matrix(raw, CFG), reqs, CFG)
    many = scores.crossJoin(spark.range(40).withColumnRenamed("id", "k")).select(F.concat("candidate_id", F.col("k").cast("string")).alias("candidate_id"), F.lit("j").alias("jd_id"), F.round("raw", 1).alias("raw"))
    names = many.select("candidate_id", F.substring("candidate_id", 1, 4).alias("name"))
    got = [(r["candidate_id"], r["rank"]) for r in match.rank_candidates(many, names, CFG).orderBy("rank").collect()]
    want = sorted(((-r["raw"], r["candidate_id"][:4], r["candidate_id"]) for r in many.collect()))
    assert got == [(w[2], k) for k, w in enumerate(want, 1)]


def test_one_candidate_and_equal_scores(spark, shop):
    units, reqs, cands, _ = shop
    alone = cands.where("candidate_id = 'named'")
    raw = match.raw_matrix(match.best_units(units.where("candidate_id = 'named'"), reqs, CFG, embed=meanings), alone, reqs)
    cells = match.matrix(raw, CFG)
    assert {(r["fused"], r["satisfied"]) for r in cells.collect()} == {(0.5, True)}  # nothing varies: the middle, and met
    ranked = match.rank_candidates(match.candidate_scores(cells, reqs, CFG), alone, CFG)
    assert [(r["final_score"], r["rank"], r["missing_must_haves"]) for r in ranked.collect()] == [(50.0, 1, [])]
    assert match.why_not_top(cells, ranked, reqs).count() == 0


def test_a_summary_and_answers(spark, shop):
    units, reqs, cands, raw = shop
    cells = match.matrix(raw, CFG)
    ranked = match.rank_candidates(match.candidate_scores(cells, reqs, CFG), cands, CFG)
    matched, missing = explain.matched_requirements(cells, units, reqs), explain.missing_requirements(cells, units, reqs, CFG.gate_threshold)
    said = {r["candidate_id"]: r["summary"] for r in explain.summaries(ranked, matched, missing).collect()}
    assert said["other"].startswith("Ranked #4 of 4 with a score of 0.0. Meets 0 of 5 requirements, including 0 of 4 must-haves.") and said["other"].endswith("Missing 4 must-haves: react; node; mongoDB; git.")
    assert "No must-have requirements are missing." in said["named"] and 'Strongest match: "' in said["named"]
    s = chat.Shortlist(ranked, cells, units, reqs)
    answer = s.ask("Why is Named above Other?")
    assert answer.intent == "compare" and answer.cited == ["named", "other"] and "Requirements that make the gap: 3." in answer.text and "also misses 4 must-have(s)" in answer.text
    assert s.ask("why isn't Front in the top 2?").intent == "whyNot" and s.ask("who has used git?").cited == ["named"] and "Nothing in these" in s.search("zzz", embed=lambda ts: np.zeros((len(ts), 8))).text
    assert s.ask("compare Named and Nobody").text == '"Nobody" is not in this shortlist.'


def test_many_mentions_are_counted_and_few_are_shown(spark):
    n = 40
    units = spark.createDataFrame([(f"c{k:02d}::ev_001", f"c{k:02d}", 1, "Knows knitting", "knows knitting", False) for k in range(n)], "evidence_id string, candidate_id string, ev_pos int, text string, expanded string, negated boolean")
    ranked = spark.createDataFrame([(f"c{k:02d}", f"Name{k}", k + 1) for k in range(n)], "candidate_id string, name string, rank int")
    got = chat.Shortlist(ranked, None, units, None).who_has("knitting?")
    assert got.cited == [f"c{k:02d}" for k in range(6)] and got.text.startswith("40 candidate(s)") and got.text.endswith("... and 34 more.")


def test_an_institution_moves_nobody(spark):
    brief = spark.createDataFrame([("j", "j::r1", 1, "Python", "MUST", ["python"], 1.0), ("j", "j::r2", 2, "degree in physics", "NICE", [], 0.6)], "jd_id string, req_key string, req_pos int, text string, kind string, aliases array<string>, weight double")
    texts = {"a": "Asha Rao\nSKILLS\nPython, Go\nEDUCATION\nB.Tech Physics, Some College, 2020 to 2024", "b": "Ben Oak\nSKILLS\nRust\nEDUCATION\nB.Sc Physics, Hill University, 2019 to 2022", "c": "Cy Elm\nSKILLS\nCooking, Sewing"}
    cands = spark.createDataFrame([(k, t.split("\n")[0], t) for k, t in texts.items()], "candidate_id string, name string, raw_text string")
    got = audit.institution_spread(cands, brief, CFG)
    assert {(r["candidate_id"], r["spread"], r["moved"], r["swapped"]) for r in got.collect()} == {("a", 0.0, False, True), ("b", 0.0, False, True), ("c", 0.0, False, False)}
    assert tuple(audit.verdict(got).select("tested", "moved", "tier_blind").first()) == (2, 0, True)


def test_places_in_groups(spark):
    from rankloom.session import places_in_groups, positions

    data = [("big" if k % 3 else None if k % 2 else "small", k % 7, k) for k in range(500)]
    df = spark.createDataFrame(data, "g string, v int, k int")
    got = {r["k"]: r["place"] for r in places_in_groups(df, ["g"], [F.col("v").desc(), F.col("k")], "place").collect()}
    for g in ("big", "small", None):
        own = sorted((-v, k) for x, v, k in data if x == g)
        assert [got[k] for _, k in own] == list(range(1, len(own) + 1))
    assert sorted(r["p"] for r in positions(df, "k", "p").collect()) == list(range(1, 501)) and places_in_groups(df.limit(0), ["g"], [F.col("k")], "place").count() == 0
