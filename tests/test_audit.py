import random

from pyspark.sql import functions as F

from rankloom.config import Config
from rankloom.functions.aliases import expand_py, reverse
from rankloom.functions import text as T
from rankloom.operators import audit, match, split
from rankloom.operators.evaluate import SWAPS
from tests.conftest import rows

CAND = "candidate_id string, name string, raw_text string"
REQ = "jd_id string, req_key string, req_pos int, text string, kind string, aliases array<string>, weight double"
WORDS = ["python", "docker", "physics", "ledger", "technology", "indian", "college", "sewing", "node.js", "mongo"]


def _resumes(n, seed=7):
    r = random.Random(seed)
    out = []
    for k in range(n):
        said = "\n".join(f"- Built the {r.choice(WORDS)} {r.choice(WORDS)} tool for {r.choice(WORDS)}" for _ in range(r.randint(0, 4)))
        school = r.choice(["B.Tech Physics, Hill University, 2019", "Diploma in Sewing, RV College (2020), grade 8", "Read a lot at home in 2019"])
        out.append((f"c{k:03d}", f"N{k % 5}", f"N Oak\n{r.choice(['EDUCATION', 'EXPERIENCE', 'Know how'])}\n{school}\nPROJECTS\n{said}\nSKILLS\n{r.choice(WORDS)}, Go. No docker experience"))
    return [*out, ("x1", "X", None), ("x2", "Y", " "), ("x3", None, "SKILLS\nNo docker experience")]


def _pair_by_pair(cands, reqs, cfg):
    """Each variant ranked by the operators of the ranking, from the text on."""
    out = {}
    for name, other in (("baseline", None), *SWAPS.items()):
        swapped = [(c, n, split.swap_institution(t, other)[0] if other and t else t) for c, n, t in cands.select("candidate_id", "name", "raw_text").collect()]
        docs = cands.sparkSession.createDataFrame(swapped, CAND)
        units = match.prepare_units(split.split_documents(docs, "candidate_id", "raw_text").withColumnRenamed("evidence_id", "id"))
        raw = match.raw_matrix(match.best_units(units, reqs, cfg, fields=(cfg.lexical_field,)), docs, reqs)
        ranked = match.rank_candidates(match.candidate_scores(match.matrix(raw, cfg), reqs, cfg), docs, cfg)
        for r in ranked.select("jd_id", "candidate_id", "final_score").collect():
            out.setdefault((r[0], r[1]), []).append(r[2])
    return sorted((*k, *v) for k, v in out.items())


def _requirements(spark, n):
    r = random.Random(3)
    some = [(f"j{k % 3}", f"j{k % 3}::{k}", k, f"{r.choice(WORDS)} and {r.choice(WORDS)}", r.choice(["MUST", "NICE", None]), r.choice([None, [], ["py", None, "college"]]), r.choice([None, 0.0, 0.6, 1.2])) for k in range(n)]
    return spark.createDataFrame(some, REQ)


def test_audit_keeps_no_row_per_candidate_and_requirement(spark, monkeypatch):
    cands, reqs, kept = spark.createDataFrame(_resumes(200), CAND), _requirements(spark, 60), []

    def counted(df, *rest, **more):
        out = materialize(df, *rest, **more)
        kept.append(out.count())
        return out

    materialize = audit.materialize
    monkeypatch.setattr(audit, "materialize", counted)
    assert audit.institution_spread(cands, reqs, Config()).count() == 203 * 3
    assert sum(kept) < 203 * 60


def test_audit_agrees_with_the_ranking_of_each_variant(spark, monkeypatch):
    cands, reqs = spark.createDataFrame(_resumes(90), CAND), _requirements(spark, 9)
    twice = spark.createDataFrame([("j0", "j0::0", 0, "ledger", "MUST", [], 1.5), ("j1", "j0::0", 0, "sewing", "NICE", ["go"], 0.3), ("j1", None, 1, "go", "MUST", [], 1.0), ("j2", "j2::z", 9, "zzz", "MUST", None, 1.0)], REQ)
    for field, some, block in (("expanded", reqs, 1_000), ("normalized", reqs.unionByName(twice), 2)):
        cfg = Config(lexical_field=field)
        want = _pair_by_pair(cands, some, cfg)
        monkeypatch.setattr(match, "REQUIREMENT_BLOCK", block)
        monkeypatch.setattr(match, "UNIT_BLOCK", 5 if block == 2 else 512)
        got = audit.institution_spread(cands, some, cfg)
        assert rows(got, "jd_id", "candidate_id", *audit.NAMES) == sorted(want, key=repr)
        assert any(len(set(x[2:])) > 1 for x in want) and {r["swapped"] for r in got.collect()} == {True, False}
        monkeypatch.undo()
    assert audit.institution_spread(cands, reqs.limit(0), Config()).count() == 0 == audit.institution_spread(cands.limit(0), reqs, Config()).count()
    lost = audit.institution_spread(cands.withColumn("candidate_id", F.when(F.col("candidate_id") != "c000", F.col("candidate_id"))), reqs, Config())
    assert lost.count() == 92 * 3


def test_expansion_looks_for_every_phrase():
    def plain(base):
        padded, slashed = f" {base} ", f" {base.replace('/', ' ')} "
        found = dict.fromkeys(c for p, cs in reverse().items() if f" {p} " in padded or f" {p} " in slashed for c in cs if f" {c} " not in padded)
        return " ".join([base, *found])

    for p in reverse():
        for text in (p, f"used {p} daily", p.replace(" ", "/"), f"html/{p}", p.replace(" ", " / ")):
            assert set(plain(T.normalize_py(text)).split()) <= set(expand_py(text).split()) and expand_py(text).startswith(plain(T.normalize_py(text)))


def test_disclaimers_are_told_as_by_the_patterns_alone():
    r = random.Random(2)
    words = "no not none never without lacking zero nil n't nor but though although however limited minimal little only basic some i have had real experience used hands-on any X_ 9 NO Never - \u212a".split()
    said = [r.choice([" ", "  ", "_", "", "-"]).join(r.choice(words) for _ in range(r.randint(1, 5))) for _ in range(20_000)]
    assert [T.is_negated_py(x) for x in said] == [any(T.ci(p).search(x.strip()) for p in T.NEGATIONS) for x in said]
    assert T.is_negated_py("\u212anever used") and T.heading_py("Skills : :") == "Skills" and T.is_noise_py("x" * 20 + " a@b.co", "other")


def test_long_lines_are_not_kept():
    asked = []
    f = T.kept(lambda line: asked.append(line) or len(line))
    assert [f("a"), f("a"), f("b" * 500), f("b" * 500)] == [1, 1, 500, 500] and len(asked) == 3
