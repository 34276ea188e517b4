import pytest

from rankloom.api import Engine
from rankloom.operators.match import prepare_units
from rankloom.operators.split import split_documents


@pytest.fixture(scope="module")
def engine(spark):
    texts = [
        ("a", "Zoe Lee", "Zoe Lee\nSKILLS\n- Python, Docker\nEXPERIENCE\n- Built a billing service in Python for a clinic"),
        ("b", "Ann Oak", "Ann Oak\nSKILLS\n- Painting, Fences. No Python experience.\nEXPERIENCE\n- Painted fences and walls for the town"),
        ("c", "Bob Elm", None),
    ]
    docs = spark.createDataFrame(texts, "candidate_id string, name string, raw_text string")
    units = prepare_units(split_documents(docs, "candidate_id", "raw_text").withColumnRenamed("evidence_id", "id")).cache()
    brief = {"title": "T", "raw_text": "A rockstar", "requirements": [{"id": "req_01", "text": "Python", "kind": "MUST", "aliases": ["py"], "weight": 1.0}, {"id": "req_02", "text": "Docker", "kind": "NICE", "aliases": [], "weight": 0.5}]}
    return Engine(spark, docs, units, {"t": brief}, brief)


def test_page(engine):
    page = engine.rank(jd_id="t").page(1, 2)
    assert [c["name"] for c in page["candidates"]] == ["Zoe Lee", page["candidates"][1]["name"]] and page["candidates"][0]["final_score"] == 100.0
    assert page["candidates"][0]["why_not_top"] is None and page["candidates"][1]["why_not_top"]["gap"] > 0
    assert [f["phrase"] for f in page["bias_flags"]] == ["rockstar"] and page["candidates"][0]["matched"]
    ann = engine.rank().page(1, 3)["candidates"]
    assert any(m["disclaimed_by"] == "No Python experience" for c in ann if c["name"] == "Ann Oak" for m in c["missing"])


def test_resolution_and_errors(engine):
    assert engine.resolve("Requirements\n- Python and Docker")["requirements"][0]["text"] == "Python"
    with pytest.raises(KeyError):
        engine.resolve(jd_id="none")
    for wrong in (lambda: engine.rank(mode="toString"), lambda: engine.tune(), lambda: engine.tune(alpha="x"), lambda: engine.ask(" ")):
        with pytest.raises(ValueError):
            wrong()


def test_tuning_reaches_rankings_until_reset(engine):
    engine.tune(alpha=1.0)
    assert engine.rank().cfg.alpha == 1.0 and engine.rank(alpha=0.2).cfg.alpha == 0.2
    engine.reset()
    assert engine.rank().cfg.alpha == 0.5 and engine.health()["candidates"] == 3
    assert engine.ablation().count() == 3 and engine.brief_ids()[0]["requirements"] == 2
    assert engine.ask("who knows docker").cited == ["a"] and engine.trace().count() == 4


def test_reports(engine):
    from rankloom.operators.split import parse_report
    from rankloom.plans import report

    page = engine.rank().page(1, 3)
    text = "\n".join(report.explanation(c) for c in page["candidates"])
    assert "MATCHED" in text and "MISSING (required)" in text and "No Python experience" in text
    assert "hybrid_rank" in report.ablation(engine.ablation()) and "1 flag(s)" in report.bias("a rockstar")
    quality = parse_report(engine.candidates.selectExpr("*", "array('python') AS known"), engine.units, "candidate_id", "raw_text", "known")
    assert "3 documents" in report.parse_quality(quality)


def test_command_line(spark, tmp_path, capsys):
    from rankloom.__main__ import main

    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "a.txt").write_text("Zoe Lee\nSKILLS\n- Python, Docker\nEXPERIENCE\n- Built a billing service in Python for a clinic")
    (folder / "b.txt").write_text("Ann Oak\nSKILLS\n- Painting, Fences. No Python experience.\nEXPERIENCE\n- Painted fences and walls for the town")
    brief = tmp_path / "brief.txt"
    brief.write_text("Backend Engineer at Acme\nRequirements\n- Python and Docker\nA rockstar")
    said = {}
    for command in (["quality", str(folder)], ["rank", str(folder), str(brief), "--mode", "lexical_only"], ["ablation", str(folder), str(brief)], ["ask", str(folder), str(brief), "who knows docker?"], ["bias", str(brief)],
                    ["tune", "/root/testdata/sf0.001", "--limit", "12", "--rows", "2"], ["validate", "/root/testdata/sf0.001", "--limit", "12", "--rows", "3"]):
        main(command)
        said[command[0]] = capsys.readouterr().out
    assert "2 documents" in said["quality"] and said["rank"].startswith("#1  Zoe Lee") and "MISSING (required)" in said["rank"] and "hybrid_rank" in said["ablation"]
    assert "1 candidate(s)" in said["ask"] and "1 flag(s)" in said["bias"] and "best by brief" in said["tune"] and "precision_top" in said["validate"] and said["validate"].count("\n") == 5
