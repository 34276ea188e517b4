import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.config import Config
from rankloom.operators.audit import institution_spread, verdict
from rankloom.operators.split import split_documents
from rankloom.sources import documents as D
from rankloom.streaming.rerank import evidence_rate, rerank_stream
from tests.conftest import rows


def docx(paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_folder(spark, tmp_path):
    (tmp_path / "b.xml").write_text("<resume><summary>Hi &amp; bye</summary><applicant><name>Ann Oak</name></applicant><experience><bullet>Built  it</bullet></experience></resume>")
    (tmp_path / "a.txt").write_text("Zoe Lee\nSKILLS\n- Python")
    (tmp_path / "c.docx").write_bytes(docx(["Bob Elm", "Skills: GoTools: Perl"]))
    (tmp_path / "d.pdf").write_bytes(b"not a pdf")
    (tmp_path / "Sample_JD.txt").write_text("We hire")
    (tmp_path / "note.md").write_text("no")
    got = D.load_candidates(spark, str(tmp_path)).orderBy("candidate_id").collect()
    assert [(r["candidate_id"], r["name"], r["ok"]) for r in got] == [("cand_01", "Zoe Lee", True), ("cand_02", "Ann Oak", True), ("cand_03", "Bob Elm", True), ("cand_04", "d", False)]
    assert got[1]["raw_text"] == "Ann Oak\n\nSummary\nHi & bye\n\nExperience\n• Built it" and got[0]["skills_declared"] == ["python"] and got[3]["error"]
    assert "Go\nTools: Perl" in got[2]["raw_text"]
    assert split_documents(D.load_candidates(spark, str(tmp_path)), "candidate_id", "raw_text").where("candidate_id = 'cand_01'").count() == 1


def test_furniture():
    assert D.strip_furniture("a\n-- 1 of 3 --\nPage 2 of 3\n3 | Page\nb") == "a\nb"


def test_json_sources_and_sinks(spark, tmp_path):
    (tmp_path / "briefs").mkdir()
    (tmp_path / "briefs" / "x.json").write_text(json.dumps({"id": "x", "title": "T", "requirements": [{"id": "req_01", "text": "Go", "kind": "MUST", "aliases": [], "weight": 1}]}))
    (tmp_path / "briefs" / "bad.json").write_text("{nope")
    assert [r["id"] for r in D.read_briefs(spark, str(tmp_path / "briefs")).collect()] == ["x"]
    (tmp_path / "c.json").write_text(json.dumps([{"id": "c1", "name": "A", "evidence": [{"id": "c1::ev_01", "text": "Go", "section": "skills"}]}]))
    cands, units = D.read_candidate_fixture(spark, str(tmp_path / "c.json"))
    assert rows(units, "candidate_id", "scored_text", "negated") == [("c1", "Go", False)]
    table = spark.createDataFrame([("c1", 1)], "candidate_id string, hybrid_rank int")
    D.write_ablation(table, str(tmp_path / "abl"), "k1")
    assert D.read_ablation(spark, str(tmp_path / "abl"), "k1").count() == 1 and D.read_ablation(spark, str(tmp_path / "abl"), "k2").count() == 0


EV = "id string, candidate_id string, section string, text string, normalized string, expanded string, negated boolean, parsed_at timestamp, ingested_at timestamp"
REQ = "jd_id string, req_key string, req_pos int, text string, kind string, aliases array<string>, weight double"


def test_stream_reranks_the_pool(spark, tmp_path):
    from datetime import datetime as dt

    day = dt(2025, 1, 1)
    row = lambda i, c, t: (i, c, "skills", t, t, t, False, day, day)
    src = tmp_path / "in"
    spark.createDataFrame([row("a::ev_1", "a", "python"), row("b::ev_1", "b", "paint")], EV).coalesce(1).write.parquet(str(src / "1"))
    cands = spark.createDataFrame([("a", "A"), ("b", "B")], "candidate_id string, name string")
    reqs = spark.createDataFrame([("j", "j::1", 1, "paint", "MUST", [], 1.0)], REQ)
    run = lambda: rerank_stream(
        spark.readStream.schema(EV).parquet(str(src / "*")), cands, reqs, str(tmp_path / "store"), str(tmp_path / "out"), str(tmp_path / "ck")
    ).awaitTermination(120)
    run()
    assert rows(spark.read.parquet(str(tmp_path / "out")), "candidate_id", "rank") == [("a", 2), ("b", 1)]
    spark.createDataFrame([row("a::ev_2", "a", "paint paint paint"), row("b::ev_1", "b", "dust")], EV).coalesce(1).write.parquet(str(src / "2"))
    run()
    assert spark.read.parquet(str(tmp_path / "store")).count() == 4
    rate = evidence_rate(spark.readStream.schema(EV).parquet(str(src / "*")))
    q = rate.writeStream.format("memory").queryName("rate").outputMode("update").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("rate").agg({"units": "max"}).first()[0] == 3


def test_institution_does_not_move_scores(spark):
    text = "Zoe Lee\nEDUCATION\nB.Tech Physics, {}, 2019 to 2023\nSKILLS\n- Python, Docker, {}"
    cands = spark.createDataFrame([("a", "A", text.format("Some College", "Go")), ("b", "B", text.format("Big University", "Perl")), ("c", "C", None)], "candidate_id string, name string, raw_text string")
    reqs = spark.createDataFrame([("j", "j::1", 1, "Python and Go", "MUST", [], 1.0), ("j", "j::2", 2, "Physics degree", "NICE", [], 0.6)], REQ)
    spread = institution_spread(cands, reqs, Config())
    assert verdict(spread).first()["tier_blind"] and rows(spread, "candidate_id", "swapped") == [("a", True), ("b", True), ("c", False)]


def test_pool_is_made_anew_when_a_table_changes(spark, tmp_path):
    from rankloom.plans.pool import pool

    columns = "id string, name string, source_file string, raw_text string, skills_declared array<string>, fit_label string"
    write = lambda names: spark.createDataFrame([(str(k), n, "f", "x", [], None) for k, n in enumerate(names)], columns).write.mode("overwrite").parquet(f"{tmp_path}/candidates.parquet")
    write(["Zoe Lee"])
    first = pool(spark, str(tmp_path))
    assert pool(spark, str(tmp_path)) is first and rows(first.candidates, "name") == [("Zoe Lee",)]
    write(["Ann Oak", "Bob Elm"])
    assert rows(pool(spark, str(tmp_path)).candidates, "name") == [("Ann Oak",), ("Bob Elm",)]


def _pdf(streams, deflate):
    """A small document with one content stream per page."""
    import zlib

    out = b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n"
    for k, s in enumerate(streams, 3):
        body = zlib.compress(s) if deflate else s
        out += b"%d 0 obj\n<< /Length %d %s>>\nstream\n%s\nendstream\nendobj\n" % (k, len(body), b"/Filter /FlateDecode " if deflate else b"", body)
    return out + b"%%EOF"


def test_simple_pdf():
    page = b"BT /F1 12 Tf 72 720 Td (Asha Rao) Tj 0 -14 Td (asha@x.co \\(home\\)) Tj T* [(Py) 20 (thon) -300 (and) -250 <476F>] TJ 0 -14 Td (caf\\351 \\\\ \\101) Tj ET"
    for deflate in (False, True):
        got = D.simple_pdf_text(_pdf([page, b"BT (Page 2) Tj ET", b"BT 1 0 0 1 0 0 Tm (Skills) Tj 30 0 Td (Go) Tj ET"], deflate))
        assert got == "Asha Rao\nasha@x.co (home)\nPython and Go\ncafé \\ A\nPage 2\nSkills Go"
        assert "Page 2" not in D.pdf_text(_pdf([page, b"BT (Page 2) Tj ET"], deflate))  # furniture
    for bad in (b"not a pdf", _pdf([b"0 0 m 10 10 l S"], True), b"%PDF stream\n" + b"(" * 20_000):
        assert D.read_any(bad, "pdf")[1] is False


def test_given_vectors_are_read(spark):
    from rankloom.config import Config
    from rankloom.operators import match, semantic
    from tests.test_truth import meanings

    ev = [("a::ev_001", "a", "x", "Kept a Node service running"), ("a::ev_002", "a", "x", "Sang in a choir"), ("b::ev_001", "b", "x", "Answered requests on the backend server")]
    units = match.prepare_units(spark.createDataFrame([(*e, e[3].lower(), None, False) for e in ev], "id string, candidate_id string, section string, text string, normalized string, expanded string, negated boolean"))
    reqs = spark.createDataFrame([("j", "r", 1, "Node", "MUST", [], 1.0)], "jd_id string, req_key string, req_pos int, text string, kind string, aliases array<string>, weight double")
    misses = semantic.cache_misses(units, "embedded", spark.createDataFrame([], "key string, vector array<float>"), "m")
    kept = semantic.cached_embedder(semantic.embed_texts(misses, meanings), units, "embedded", "m")
    one = {r["candidate_id"]: (round(r["semantic"]["score"], 5), r["semantic"]["id"]) for r in match.best_units(kept, reqs, Config(), embed=meanings).collect()}
    two = {r["candidate_id"]: (round(r["semantic"]["score"], 5), r["semantic"]["id"]) for r in match.best_units(units, reqs, Config(), embed=meanings).collect()}
    assert one == two and one["b"][0] > 0.9
    lost = match.best_units(kept.withColumn("vector", F.when(F.col("candidate_id") == "a", F.col("vector"))), reqs, Config(), embed=meanings)
    assert {r["candidate_id"]: r["semantic"]["score"] for r in lost.collect()}["b"] == 0.0


def test_a_limited_pool(spark):
    from rankloom.plans.pool import Pool

    p = Pool(spark, "/root/testdata/sf0.001", limit=5)
    assert p.candidates.count() == 5 and p.ranked().where("rank <= 5").select("candidate_id").distinct().count() == 5


def test_cache_is_never_written_over(spark, tmp_path):
    import pytest as pt
    from rankloom.operators import semantic

    path = str(tmp_path / "cache")
    embed = lambda ts: np.ones((len(ts), 4))
    texts = spark.createDataFrame([("a",), ("b",), (None,)], "t string")
    assert semantic.update_cache(texts, "t", path, "m", embed).count() == 2
    assert semantic.update_cache(texts.unionAll(spark.createDataFrame([("c",)], "t string")), "t", path, "m", embed).count() == 3
    part = next((tmp_path / "cache").glob("*.parquet"))
    part.write_bytes(b"broken")
    (tmp_path / "cache" / f".{part.name}.crc").unlink(missing_ok=True)
    before = sorted(x.name for x in (tmp_path / "cache").iterdir())
    with pytest.raises(Exception):  # noqa: B017
        semantic.update_cache(spark.createDataFrame([("d",)], "t string"), "t", path, "m", embed)
    assert set(before) - {x.name for x in (tmp_path / "cache").iterdir()} == set()


def test_ablations_of_other_briefs_stay(spark, tmp_path):
    path = str(tmp_path / "ab")
    one = spark.createDataFrame([("c1", 1)], "candidate_id string, hybrid_rank int")
    D.write_ablation(one, path, "k1")
    D.write_ablation(one, path, "k2")
    D.write_ablation(one.unionAll(one), path, "k2")
    assert D.read_ablation(spark, path, "k1").count() == 1 and D.read_ablation(spark, path, "k2").count() == 2


def test_briefs_without_an_id_are_left_out(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "a", "title": "T", "requirements": [{"id": "r", "text": "x"}]}')
    (tmp_path / "b.json").write_text('{"title": "T", "requirements": [{"id": "r", "text": "x"}]}')
    assert [r["id"] for r in D.read_briefs(spark, str(tmp_path)).collect()] == ["a"]
