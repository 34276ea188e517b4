import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.config import Config, preset
from rankloom.operators import bias, chat, evaluate, explain, match, semantic
from rankloom.schema import ranking_violations, requirement_violations, unit_violations
from tests.conftest import rows

CFG = Config()
UNITS = [
    ("a::ev_001", "a", "skills", "Python and Docker in production", False),
    ("a::ev_002", "a", "experience", "Built the billing service with python for a clinic", False),
    ("b::ev_001", "b", "experience", "Never used docker at all", True),
    ("b::ev_002", "b", "projects", "Painted walls and fences for neighbours in summer", False),
    ("c::ev_001", "c", "experience", "No python experience", True),
    ("d::ev_001", "d", "skills", "python", False),
    ("d::ev_002", "d", "skills", "python", False),
]
REQS = [
    ("j", "j::req_01", 1, "Experience with Python", "MUST", ["python", "py"], 1.0),
    ("j", "j::req_02", 2, "Docker", "NICE", None, 0.0),
    ("j", "j::req_03", 3, "Underwater basket weaving", "NICE", [], None),
]


@pytest.fixture(scope="module")
def shop(spark):
    raw = [(i, c, s, t, t.lower(), None, n, "clash") for i, c, s, t, n in UNITS]
    ev = spark.createDataFrame(raw, "id string, candidate_id string, section string, text string, normalized string, expanded string, negated boolean, fused string")
    units = match.prepare_units(ev).cache()
    reqs = spark.createDataFrame(REQS, "jd_id string, req_key string, req_pos int, text string, kind string, aliases array<string>, weight double").cache()
    cands = spark.createDataFrame([(c, n, f"Sales_Resume_{c}.pdf") for c, n in zip("abcd", ["Zoe Lee", "Ann Oak", None, "Bob Elm"])], "candidate_id string, name string, source_file string").cache()
    return units, reqs, cands


@pytest.fixture(scope="module")
def raw(shop):
    units, reqs, cands = shop
    return match.raw_matrix(match.best_units(units, reqs, CFG), cands, reqs).cache()


def brute(reqs):
    """Relevance of every usable unit by plain loops."""
    tok = lambda s: re.findall(r"[a-z0-9+#.]+", s.lower())
    docs = {i: tok(t) for i, _, _, t, _ in UNITS}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(w for d in docs.values() for w in set(d))
    best = {}
    for _, key, _, text, _, al, _ in reqs:
        q = tok(text) + [w for a in al or [] for w in tok(a)]
        for i, c, _, _, neg in UNITS:
            if neg:
                continue
            tf = Counter(docs[i])
            s = sum(math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(docs[i]) / avg)) for w in q if tf[w])
            if (key, c) not in best or s > best[key, c][0] + 1e-12:
                best[key, c] = (s, i)
    return best


def test_best_units_agree_with_loops(raw):
    want = brute(REQS)
    for r in raw.collect():
        s, i = want.get((r["req_key"], r["candidate_id"]), (0.0, None))
        assert abs(r["expanded_raw"] - s) < 1e-8 and r["expanded_id"] == i, r


def test_blocks_and_traces_give_the_same(shop, raw, monkeypatch):
    units, reqs, cands = shop
    monkeypatch.setattr(match, "REQUIREMENT_BLOCK", 1)
    monkeypatch.setattr(match, "UNIT_BLOCK", 1)
    again = match.raw_matrix(match.best_units(units, reqs, CFG), cands, reqs)
    assert rows(again) == rows(raw)
    top = match.best_units(units, reqs, CFG, fields=("expanded",), trace=5).where("candidate_id = 'd' and req_key = 'j::req_01'").first()
    assert [x["id"] for x in top["expanded"]] == ["d::ev_001", "d::ev_002"]


def test_matrix_edges(raw, shop):
    cells = {(r["req_key"], r["candidate_id"]): r for r in match.matrix(raw, CFG).collect()}
    assert all(cells["j::req_03", c]["lexical_norm"] == 0 for c in "abcd")  # nobody has it
    assert cells["j::req_01", "c"]["evidence_id"] is None  # all units are disclaimers
    assert not any(r["evidence_id"] in ("b::ev_001", "c::ev_001") for r in cells.values())
    values = np.array([cells["j::req_01", c]["lexical_raw"] for c in "abcd"])
    z = (values - values.mean()) / values.std(ddof=1)
    assert np.allclose([cells["j::req_01", c]["lexical_norm"] for c in "abcd"], z, atol=1e-8)


def test_ranking_properties(raw, shop):
    units, reqs, cands = shop
    cells = match.matrix(raw, CFG)
    ranked = match.rank_candidates(match.candidate_scores(cells, reqs, CFG), cands, CFG)
    got = ranked.orderBy("rank").collect()
    assert [r["rank"] for r in got] == [1, 2, 3, 4]
    assert got[0]["final_score"] == 100.0 and got[-1]["final_score"] == 0.0
    assert ranking_violations(ranked, "hybrid").count() == 0 and ranking_violations(ranked, "toString").count() == 4
    for r in got:
        own = [c for c in cells.where(F.col("candidate_id") == r["candidate_id"]).collect()]
        base = sum(c["fused"] for c in own) / 3  # weights 1, 0 and null all count 1
        assert abs(r["base"] - base) < 1e-8
        assert r["missing_must_haves"] == [c["req_key"] for c in own if c["req_key"] == "j::req_01" and c["fused"] < 0.45]
    gaps = match.why_not_top(cells, ranked, reqs)
    assert got[0]["candidate_id"] not in {r["candidate_id"] for r in gaps.collect()} and gaps.where("gap <= 0").count() == 0


def test_one_candidate_scores_the_middle(raw, shop):
    units, reqs, cands = shop
    one = raw.where("candidate_id = 'a'")
    ranked = match.rank_candidates(match.candidate_scores(match.matrix(one, CFG), reqs, CFG), cands, CFG)
    assert [(r["final_score"], r["rank"]) for r in ranked.collect()] == [(50.0, 1)]
    assert match.why_not_top(match.matrix(one, CFG), ranked, reqs).count() == 0
    none = raw.limit(0)
    assert match.rank_candidates(match.candidate_scores(match.matrix(none, CFG), reqs, CFG), cands, CFG).count() == 0


def test_lexical_mode_does_not_see_vectors(raw, shop):
    _, reqs, cands = shop
    cfg = preset("lexical_only")
    other = raw.withColumn("semantic_raw", F.rand(3))
    pick = lambda m: rows(match.rank_candidates(match.candidate_scores(match.matrix(m, cfg), reqs, cfg), cands, cfg), "candidate_id", "rank", "final_score")
    assert pick(raw) == pick(other)
    with pytest.raises(ValueError):
        preset("toString")
    with pytest.raises(ValueError):
        CFG.tuned(alpha="high")


def test_explanations(raw, shop):
    units, reqs, cands = shop
    cells = match.matrix(raw, CFG)
    matched = explain.matched_requirements(cells, units, reqs)
    short = matched.where("candidate_id = 'a' and req_key = 'j::req_01'").first()
    assert short["evidence_text"] == "Built the billing service with python for a clinic"  # the short citation is upgraded
    said = explain.disclaimers(units, reqs)
    assert ("j::req_02", "b", "Never used docker at all") in rows(said)
    missing = explain.missing_requirements(cells, units, reqs, CFG.gate_threshold)
    ranked = match.rank_candidates(match.candidate_scores(cells, reqs, CFG), cands, CFG)
    text = {r["candidate_id"]: r["summary"] for r in explain.summaries(ranked, matched, missing).collect()}
    assert text["a"].startswith("Ranked #1 of 4 with a score of 100.0.") and "No must-have requirements are missing." in text["a"]
    assert 'states this directly: "No python experience"' in text["c"]


def test_questions(raw, shop):
    units, reqs, cands = shop
    cells = match.matrix(raw, CFG)
    ranked = match.rank_candidates(match.candidate_scores(cells, reqs, CFG), cands, CFG)
    short = chat.Shortlist(ranked, cells, units, reqs)
    assert short.ask(" ").text.startswith("Ask") and short.ask("Who knows Docker?").cited == ["a"]
    assert "Never used docker" not in short.ask("who has python").text
    assert 'Ann Oak says' in short.ask("who has used docker at all").text
    a = short.ask("Why is Zoe above Ann?")
    assert a.intent == "compare" and a.cited == ["a", "b"]
    assert short.ask("why isn't Ann in the top 3").intent == "whyNot" and "not in this shortlist" in short.ask("compare Zoe and Quentin").text
    assert short.ask("zzzz qqqq").intent == "search" and short.ask("billing service clinic").cited[0] == "a"


def test_evaluation(raw, shop):
    units, reqs, cands = shop
    spark = raw.sparkSession
    files = spark.createDataFrame([("SDE_Resume_1_A_B.txt",), ("Resume.pdf",), ("HR_Resume_2.pdf",)], "f string")
    role = evaluate.role_of(F.col("f"))
    assert [tuple(r) for r in files.select(role, evaluate.class_of(role)).collect()] == [("sde", "RELEVANT"), ("resume", "UNKNOWN"), ("hr", "IRRELEVANT")]
    swept = evaluate.sweep(raw, reqs, cands, CFG, "alpha", (0.0, 0.5, 1.0))
    assert swept.count() == 3 and evaluate.best_setting(swept).count() == 1
    one = match.rank_candidates(match.candidate_scores(match.matrix(raw, CFG.tuned(alpha=1.0)), reqs, CFG), cands, CFG)
    table = evaluate.ablation(raw, reqs, cands, CFG)
    assert rows(table, "candidate_id", "lexical_rank") == rows(one, "candidate_id", "rank")
    dist = evaluate.score_distribution(one).first()
    assert (dist["min"], dist["max"], dist["zeros"] >= 1, dist["hundreds"] >= 1) == (0.0, 100.0, True, True)


def test_bias(spark):
    text = "He/She must be a rockstar Rockstar intern with 3+ years of experience; native English."
    docs = spark.createDataFrame([(1, text, "x"), (2, None, "y"), (3, "Plain.", "z")], "id int, body string, phrase string")
    assert rows(bias.flag_phrases(docs, "id", "body")) == [(1, "gendered", "he/she"), (1, "gendered", "rockstar"), (1, "vague", "native english")]
    assert rows(bias.flag_overreach(docs, "id", "body"), "id", "label", "years") == [(1, "intern", 3)]
    flags = bias.flag_brief(text)
    assert {f["category"] for f in flags} == {"gendered", "vague", "overreach"} and bias.flag_brief(None) == []


def test_vector_search_and_cache(spark, tmp_path, monkeypatch):
    r = np.random.default_rng(1)
    v = r.normal(size=(60, 8))
    v[7] = v[3]
    df = spark.createDataFrame([(k, [float(x) for x in row]) for k, row in enumerate(v)] + [(99, None), (98, [1.0])], "id int, e array<double>")
    monkeypatch.setattr(semantic, "QUERY_BLOCK", 2)
    got = {(x["query_id"], x["position"]): x["id"] for x in semantic.top_k(df, df.where("id % 20 = 0"), "id", "e", 3).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in (0, 20, 40):
        s = u @ u[q]
        s[q] = -9
        assert [got[q, p] for p in (1, 2, 3)] == list(np.argsort(-s, kind="stable")[:3])
    texts = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "t string")
    path = str(tmp_path / "cache")
    assert semantic.update_cache(texts, "t", path, "m", match.hashed).count() == 2
    assert semantic.update_cache(texts.union(spark.createDataFrame([("c",)], "t string")), "t", path, "m", match.hashed).count() == 3


def test_violations_are_rows(spark, shop):
    units, reqs, _ = shop
    bad = units.withColumn("section", F.when(F.col("evidence_id") == "a::ev_001", "hobby").otherwise(F.col("section")))
    assert rows(unit_violations(bad)) == [("a::ev_001", "unknown section")]
    assert rows(requirement_violations(reqs)) == [("j::req_02", "aliases missing")]
