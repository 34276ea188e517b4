"""Personal values, window packing, mixing and residue."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import mixing, packing, pii, pii_training, residue
from rankloom.llm.tokens import encoding, token_sizes, PATTERN, RANKS
from tests.conftest import rows

# --- personal values


@pytest.fixture(scope="module")
def weights():
    return dict(pii.default_weights())


GIVEN, FAMILY = frozenset({"zoe", "lucjan"}), frozenset({"lee", "delugo"})


def found(text, weights, field=False):
    return [(text[s:e], t) for s, e, t in pii.find(text, weights, GIVEN, FAMILY, field)]


def scored(lines, weights, given, family):
    """Recall and precision per type on labelled lines."""
    want, got, both = Counter(), Counter(), Counter()
    for text, gold, first, field in lines:
        spans = pii._candidates(text, 0, len(text), given, family, first, field, 15)
        w, g = {(s, t) for s, _, t in gold}, {(s, t) for s, _, t, _ in pii.decode(spans, weights)}
        want.update(t for _, t in w), got.update(t for _, t in g), both.update(t for _, t in w & g)
    return {t: (both[t] / want[t], both[t] / max(got[t], 1)) for t in want}


def test_other_fillers_of_the_templates(weights):
    for t, (recall, precision) in scored(pii_training.lines(repeats=10, seed=99), weights, pii_training.GIVEN, pii_training.FAMILY).items():
        assert recall >= 0.98 and precision >= 0.98, t


def test_carriers_held_out_whole(weights):
    assert not set(pii_training.OTHER_CARRIERS) & {*pii_training.LABELLED, *pii_training.PLAIN}
    lines = pii_training.other_lines(repeats=20, seed=99)
    for t, (recall, precision) in scored(lines, weights, pii_training.GIVEN, pii_training.FAMILY).items():
        assert recall >= 0.95 and precision >= 0.95, t
    unknown = scored(lines, weights, frozenset(), frozenset())["NAME"]  # names that no dictionary has: told by cues only
    assert unknown[0] >= 0.3 and unknown[1] >= 0.9


def test_probabilities_are_those_of_all_segmentations():
    r = random.Random(8)
    for _ in range(40):
        spans = sorted((s := r.randrange(20), s + r.randrange(1, 9), r.choice(pii.TYPES)) for _ in range(6))
        scores, w = [r.uniform(-2, 2) for _ in spans], {f"{a}>{b}": r.uniform(-1, 1) for a in ("", *pii.TYPES) for b in pii.TYPES}
        z, prob, changes = pii.lattice(spans, scores, lambda p, t: w[f"{p}>{t}"])
        legal = [c for k in range(7) for c in itertools.combinations(range(6), k) if all(spans[a][1] <= spans[b][0] for a, b in itertools.pairwise(c))]
        total = lambda c: math.exp(sum(scores[k] + w[f"{spans[c[i - 1]][2] if i else ''}>{spans[k][2]}"] for i, k in enumerate(c)))
        assert abs(math.log(sum(map(total, legal))) - z) < 1e-9
        for k in range(6):
            assert abs(sum(total(c) for c in legal if k in c) / math.exp(z) - prob[k]) < 1e-9
        assert abs(sum(v for (p, _), v in changes.items() if p == "") - (1 - 1 / math.exp(z))) < 1e-9


def test_forms_of_other_places_and_typings(weights):
    for text, value in [
        ("Calle de Alcala 45, 28014 Madrid", "Calle"), ("Via Roma 12, 00184 Roma", "Via"), ("12 Hauptmarkt, 90403 Nuremberg", "12"), ("Address: Mühlenstraße 4, 04103 Brunnthal", "Mühlen"),
    ]:
        assert [(t, v[: len(value)]) for v, t in found(text, weights)] == [("ADDRESS", value)], text
    assert found("Write to zoe.lee ( at ) example.org please", weights) == [("zoe.lee ( at ) example.org", "EMAIL")]
    assert found("Reported to Dr. Ingrid Solberg on the map", weights) == [("Ingrid Solberg", "NAME")]


def test_each_type(weights):
    text = "Zoe Lee\nNI number: QQ 12 34 56 C\n+1 (220) 555-0108 / Flat 9A, 78 Elm Street, Vessby / zoe.lee+jobs [at] mail [dot] example [dot] net\nReported to Dr. Lucjan Delugo on the map"
    assert [t for _, t in found(text, weights)] == ["NAME", "ID_NUMBER", "PHONE", "ADDRESS", "EMAIL", "NAME"]
    values = dict(zip([t for _, t in found(text, weights)][1:5], [v for v, _ in found(text, weights)][1:5]))
    assert values["ID_NUMBER"] == "QQ 12 34 56 C" and values["PHONE"] == "+1 (220) 555-0108" and values["ADDRESS"].startswith("Flat 9A")
    assert found(text, weights)[-1] == ("Lucjan Delugo", "NAME")
    assert found("On-call contact (01 99 00 79 65) of the map", weights) == [("01 99 00 79 65", "PHONE")]
    assert found("Lee, Zoe", weights, True) == [("Lee, Zoe", "NAME")]


def test_a_grammar_is_left_out_only_where_it_has_no_candidate(weights):
    extra = [("Reported to Dr. Łukasz Żakowski on the map", [], False, False), ("Απόστολος Νικολάου wrote it", [], False, False), ("a.b ( at ) c.example and X. Ýr, Ål", [], False, False), ("12 Άλφα, 12345 Βήτα", [], False, False), ("o'Neil O'Hara, J. O’Dea", [], False, False)]
    for text, _, first, field in pii_training.lines(repeats=6, seed=11) + pii_training.other_lines(repeats=6, seed=11) + extra:
        for given, family in ((pii_training.GIVEN, pii_training.FAMILY), (frozenset(), frozenset())):
            all_ = [(s, e, t) for s, e, t, _ in pii.decode(pii._candidates(text, 0, len(text), given, family, field, field, 15), weights)]
            assert pii.find(text, weights, given, family, field) == all_, text
    assert ("Łukasz Żakowski", "NAME") in found(extra[0][0], weights)


def test_look_alikes(weights):
    for text in ["Closed ticket 2024360155 on the ledger", "Lit 74 lanes of the Lantern Street tunnel", "Patched @core/leaf@3.2.18 in the map", "Traced fault code ERR-39-7701",
                 "Read 1212 pages of council minutes from 2019-2023", "ISO 9001, C++", "folio.example/zoe12", "CURRICULUM VITAE", "At Blue Heron Studio, built it"]:
        assert found(text, weights) == []


def test_masking_keeps_the_rest(weights):
    text = "Mail zoe@example.org or call 07700 900 123 today"
    assert pii.mask(text, pii.find(text, weights, GIVEN, FAMILY)) == "Mail [EMAIL] or call [PHONE] today"
    assert pii.mask(None, []) is None and pii.find(None, weights, GIVEN, FAMILY) == [] and pii.find("", weights, GIVEN, FAMILY) == []
    long = "word " * 200_000 + "zoe@example.org"
    assert found(long, weights) == [("zoe@example.org", "EMAIL")]


def test_tables(spark, weights):
    data = [("c.raw_text", "1", "x\nEmail: a@b.example"), ("c.raw_text", "1", "x\nEmail: a@b.example"), ("c.name", "2", "Zoe Lee"), ("c.name", "3", None), ("c.name", None, " "), (None, None, None), (None, "4", "Zoe Lee and I ran it")]
    df = spark.createDataFrame([(*x, "clash") for x in data], "field string, record_id string, text string, pii_type string")
    got = pii.personal_values(df, GIVEN, FAMILY, weights).select("field", "record_id", "pii_type", "start_pos").distinct()
    assert rows(got.where("field is not null")) == [("c.name", "2", "NAME", 1), ("c.raw_text", "1", "EMAIL", 10)] and got.where("field is null").count() == 1
    assert pii.personal_values(df.limit(0), GIVEN, FAMILY, weights).count() == 0
    assert [r["text"] for r in pii.redacted(df.where("record_id >= '2'"), GIVEN, FAMILY, weights).collect()] == ["[NAME]", None, "[NAME] and I ran it"]
    names = spark.createDataFrame([("Zoe Lee",), ("Zoe Ash",), ("ZOE",), (None,), ("Resume Final",), ("Resume Final",)], "name string")
    assert pii.name_dictionary(names, "name") == (frozenset({"zoe"}), frozenset({"lee", "ash"}))


def test_names_beyond_the_dictionary(spark, weights):
    people = ["Zoe Lee", "Zoe Lee", "Lucjan Delugo", "Ansuya Brinovska", "Resume Final"]
    names = spark.createDataFrame([(n,) for n in people], "name string")
    texts = ["the map, which ansuya brinovska drew in May", "we thank Lucjan Delugo and zoe lee for it", "", None, "no one here", "Ansuya Brinovska\nkept it with Zoe Lee"]
    df = spark.createDataFrame([("c.raw_text", str(k), t) for k, t in enumerate(texts)], "field string, record_id string, text string")
    given, family, rest = pii.name_lookup(names, "name")
    assert rest is None and given == {"zoe", "lucjan", "ansuya"} and family == {"lee", "delugo", "brinovska"}
    g1, f1, rest = pii.name_lookup(names, "name", limit=1)
    assert (g1, f1) == ({"zoe"}, {"lee"}) and rest.count() == 4
    whole = rows(pii.personal_values(df, given, family, weights))
    assert rows(pii.personal_values(df, g1, f1, weights, rest)) == whole and {x[1] for x in whole} == {"0", "1", "5"}
    assert rows(pii.redacted(df, g1, f1, weights, rest)) == rows(pii.redacted(df, given, family, weights))
    assert len(rows(pii.personal_values(df, g1, f1, weights))) < len(whole)  # what a bound alone would lose


def test_decoder_is_exact(weights):
    """The running-maximum program against every subset of spans."""
    r = random.Random(5)
    for _ in range(60):
        spans = [(s := r.randrange(20), s + r.randrange(1, 8), r.choice(pii.TYPES), [f"f{r.randrange(9)}"]) for _ in range(6)]
        w = {f"f{k}": r.uniform(-2, 3) for k in range(9)} | {f"{a}>{b}": r.uniform(-1, 1) for a in ("", *pii.TYPES) for b in pii.TYPES}

        def total(path):
            return sum(w[f] for x in path for f in x[3]) + sum(w[f"{a}>{b[2]}"] for a, b in zip(["", *[x[2] for x in path]], path, strict=False))

        legal = [c for k in range(7) for c in itertools.combinations(sorted(spans, key=lambda x: x[:2]), k) if all(a[1] <= b[0] for a, b in itertools.pairwise(c))]
        assert abs(total(pii.decode(spans, w)) - max(map(total, legal))) < 1e-9


# --- windows


def test_packing_limits_and_cutting(spark):
    data = [(k, int(n), int(min(h, n))) for k, (n, h) in enumerate(zip(np.random.default_rng(3).integers(0, 260, 400), np.random.default_rng(4).integers(0, 40, 400)))] + [(900, 1_000, 10), (901, 0, 0)]
    df = spark.createDataFrame([(*x, 7) for x in data], "id int, tokens long, head_tokens long, window long")
    placed = packing.pack_documents(df, "id", capacity=256, segments=6, loss_limit=256, shard_pieces=150)
    got = placed.toPandas()
    w = got.groupby("window_id").agg(t=("tokens", "sum"), s=("slot", "max"), l=("loss_tokens", "sum"), n=("id", "size"))
    assert (w.t <= 256).all() and (w.s <= 6).all() and (w.l <= 256).all() and (w.s == w.n).all()
    assert got.groupby("id").tokens.sum().to_dict() == {k: n for k, n, _ in data if n}
    assert got[got.id == 900].sort_values("piece").tokens.tolist() == [256, 256, 256, 232] and got[got.id != 900].groupby("id").size().max() <= 2
    assert got[(got.id < 900)].merge(df.toPandas()[["id", "tokens"]].rename(columns={"tokens": "whole"}), on="id").query("whole <= 256").groupby("id").size().max() == 1
    assert packing.fill_report(placed, 256).first()["filled"] > 0.9
    assert packing.pack_documents(df.limit(0), "id").count() == 0


def test_binding_loss_limit():
    sizes = np.array([[10, 1, 10], [10, 1, 0], [10, 1, 10], [10, 1, 0]], dtype=float)
    got = packing.pack(sizes, np.array([20.0, 2.0, 10.0]))
    assert sorted(np.bincount(got)) == [2, 2] and all(sizes[got == k, 2].sum() <= 10 for k in set(got))


def test_cut_only_what_no_window_holds(spark):
    r = np.random.default_rng(6)
    data = [(0, 200, 180), (1, 256, 156), (2, 256, 150), (3, 600, 590), (4, 900, 10), (5, 101, 1)] + [(10 + k, int(n), int(min(h, n))) for k, (n, h) in enumerate(zip(r.integers(1, 900, 200), r.integers(0, 500, 200)))]
    df = spark.createDataFrame(data, "id int, tokens long, head_tokens long")
    got = packing.pack_documents(df, "id", capacity=256, segments=6, loss_limit=100, shard_pieces=80).toPandas()
    w = got.groupby("window_id").agg(t=("tokens", "sum"), l=("loss_tokens", "sum"))
    assert (w.t <= 256).all() and (w.l <= 100).all() and (w.l == 100).any()
    for k, n, h in data:
        d = got[got.id == k].sort_values("piece")
        at, ends = 0, []  # the longest piece that a window holds, token by token
        while at < n:
            e = at
            while e < n and e - at < 256 and max(0, e + 1 - max(at, h)) <= 100:
                e += 1
            ends.append(e - at)
            at = e
        assert d.tokens.tolist() == ends and d.start_token.tolist() == [1 + sum(ends[:i]) for i in range(len(ends))] and d.loss_tokens.sum() == max(0, n - h)
    assert all((got.id == k).sum() == 1 for k in (0, 1, 5))


def test_waste_and_wholeness(spark):
    r = np.random.default_rng(7)
    df = spark.createDataFrame([(k, int(n), int(n) // 3) for k, n in enumerate(r.integers(1, 700, 600))] + [(900, 5_000, 0), (901, 0, 0)], "id int, tokens long, head_tokens long")
    for loss in (512, 340):
        placed = packing.pack_documents(df, "id", capacity=512, segments=16, loss_limit=loss, shard_pieces=300)
        kept = packing.kept_whole(placed, df, "id", 512, 16, loss).collect()
        assert len(kept) == 601 and all(x["kept"] for x in kept)
        assert packing.fill_report(placed, 512, 16, loss).first()["over_least"] <= 0.05
    broken = placed.where("piece = 1")
    assert {x["id"] for x in packing.kept_whole(broken, df, "id", 512, 16, 340).where("not kept").collect()} >= {900}


def test_tokens_round_trip(spark):
    texts = ["Hello wörld  \n\n x", None, "", "<|endoftext|> is text"]
    df = spark.createDataFrame([(k, t, 5) for k, t in enumerate(texts)], "id int, body string, tokens int")
    got = {r["id"]: (r["tokens"], r["head_tokens"]) for r in token_sizes(df, "body", ["id"]).collect()}
    enc = encoding(RANKS, PATTERN)
    for k, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        assert got[k] == (len(ids), len(enc.encode_ordinary((t or "").split("\n")[0]))) and enc.decode(ids) == (t or "")


# --- mixing


def test_rake_meets_marginals():
    r = np.random.default_rng(1)
    cells = r.integers(1, 100, 24).astype(float)
    dims = [np.repeat([0, 1], 12), np.tile(np.repeat([0, 1, 2], 4), 2), np.tile([0, 1, 2, 3], 6)]
    goals = [np.array([0.7, 0.3]), np.array([0.5, 0.3, 0.2]), np.full(4, 0.25)]
    w = mixing.rake(cells, dims, goals)
    for d, g in zip(dims, goals):
        assert np.allclose(np.bincount(d, weights=w), g, atol=1e-6)


def test_shares_and_caps(spark):
    r = np.random.default_rng(2)
    data = [(k, s, ["en", None, "de"][k % 3], ["a", "b"][k % 2], int(r.integers(0, 200))) for k, s in enumerate(["big"] * 1_500 + ["mid"] * 300 + ["small"] * 60 + ["extra"] * 40 + [None] * 10)]
    sized = spark.createDataFrame([(*x, 3) for x in data], "doc_id long, source string, lang string, topic string, tokens long, copies int")
    targets = spark.createDataFrame([("big", 0.5, 1.0), ("mid", 0.3, 2.0), ("small", 0.1, 3.0), ("absent", 0.1, 2.0)], "source string, target_share double, max_repeats double")
    mixed = mixing.mix(sized, targets)
    got = {x["source"]: x for x in mixing.share_report(sized, targets, mixed).collect()}
    for s, share in (("big", 5 / 9), ("mid", 3 / 9), ("small", 1 / 9)):
        assert abs(got[s]["actual_share"] - share) < 0.005 and got[s]["repeats"] <= got[s]["max_repeats"] + 1e-9 and got[s]["most_copies"] <= got[s]["max_repeats"]
    assert got["absent"]["documents"] == 0 and got["extra"]["drawn_tokens"] == 0 and got[None]["drawn_tokens"] == 0
    assert rows(mixed) == rows(mixing.mix(sized.repartition(7), targets))  # the same whatever the layout
    assert mixing.mix(sized.limit(0), targets).count() == 0 and mixing.mix(sized, targets.limit(0)).count() == 0


def test_many_sources_languages_and_topics(spark):
    sized = spark.createDataFrame([(k, f"s{k % 90:02}", f"l{k % 100}", f"t{k % 81}", 10) for k in range(8_100)], "doc_id long, source string, lang string, topic string, tokens long")
    targets = spark.createDataFrame([(f"s{k:02}", 1 / 90, 1.0) for k in range(90)], "source string, target_share double, max_repeats double")
    assert mixing.mix(sized, targets).count() == 8_100


def test_too_many_cells_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_CELLS", 50)
    sized = spark.createDataFrame([(k, "s", "en", f"t{k}", 10) for k in range(60)], "doc_id long, source string, lang string, topic string, tokens long")
    with pytest.raises(ValueError):
        mixing.mix(sized, spark.createDataFrame([("s", 1.0, 1.0)], "source string, target_share double, max_repeats double"))


def test_fractional_caps(spark):
    sized = spark.createDataFrame([(k, "ab"[k % 2], "en", "x", 10) for k in range(1_000)], "doc_id long, source string, lang string, topic string, tokens long")
    for cap, most in ((2.5, 2), (0.4, 1)):
        targets = spark.createDataFrame([("a", 0.8, cap), ("b", 0.2, 9.0)], "source string, target_share double, max_repeats double")
        got = {r["source"]: r for r in mixing.share_report(sized, targets, mixing.mix(sized, targets)).collect()}
        assert got["a"]["most_copies"] <= most and got["a"]["repeats"] <= cap + 0.01 and abs(got["a"]["actual_share"] - 0.8) < 0.01


# --- residue

BAD = {
    "field": ["Dear {{first_name}},", "Salary: [YOUR SALARY RANGE HERE]", "Start date XX/XX/XXXX, notice", "Hello undefined, welcome", "We at <%= company %> wait", "runs %CITY% daily", "so <start date> it surfaces"],
    "filler": ["Lorem ipsum dolor sit amet, consectetur", "Your text here.", "Heading goes here.", "Felis ipsum mollis augue odio vitae.", "Hier steht ein Blindtext, bitte ersetzen."],
    "error": ["404 Not Found.", "Access denied.", "Sorry, the requested resume could not be found.", "Traceback (most recent call last):", "Your session has expired.", "Seite nicht gefunden."],
    "script": ["Please enable JavaScript to view this job posting.", "This site needs scripts to run.", "JavaScript seems to be turned off.", "Bitte aktivieren Sie JavaScript, um die Stelle anzuzeigen."],
}
GOOD = [
    "Wrote the mail merge that swaps {{first_name}} for the applicant's own name.", "Removed leftover [Company Name] tags from 26 old letters.", "Designed form templates with fields like <start date> for a clinic.",
    "Replaced ${HOME} paths in the deploy scripts with settings.", "Works part time [Noor Bagh], open to travel.", "Access denied was the title of my thesis play.", "Built the page not found screen that they liked.",
    "Cut the share of 404 pages on the site from 46 to 2 percent.", "JavaScript is required for this post; scala is a plus.", "Taught a class on JavaScript and why pages should work with scripts disabled.",
    "Typeset a specimen sheet with lorem ipsum for the design school.", "Our style guide bans filler text such as sample text in live pages.", "The database returned error 502 every night until I packaged the proxy.", "Used shell scripting for it.",
]


def test_residue(spark):
    data = [(100 + k, kind, t) for k, (kind, t) in enumerate((kind, t) for kind, ts in BAD.items() for t in ts)]
    docs = [(k, "s", f"A plain start. {t} A plain end.") for k, _, t in data] + [(k, None, f"- {t}\nmore") for k, t in enumerate(GOOD)] + [(900, "s", None), (901, "s", ""), (902, "s", "plain " * 200_000), (903, "s", "A short line. And more of it.\n" * 60_000), (None, "s", "404 Not Found.")]
    df = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, source string, text string, kind string")
    got = {(r["doc_id"], r["kind"]) for r in residue.residue_documents(df, "doc_id", "text", "source").collect()}
    assert got == {(k, kind) for k, kind, _ in data}
    assert residue.without_residue(df, "doc_id", "text", "source").count() == len(GOOD) + 5
    assert residue.residue_documents(df.limit(0), "doc_id", "text", "source").count() == 0


def test_recurring_messages_are_grouped(spark):
    docs = [(k, f"s{k % 2}", f"Incident {k}-{k + 1}. Fine words.\nHMM!") for k in range(4)] + [(9, "s0", "Oops! I did it once.")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    m = {r["message"]: (r["docs"], r["sources"]) for r in residue.residue_messages(df, "doc_id", "text", "source").collect()}
    assert m == {"Incident 9-9.": (4, 2), "HMM!": (4, 2)}  # an interjection inside other text is content


def _corpus(n: int, planted: str) -> list:
    """Documents of five kinds, two languages and five sources, each kind with sentences of its own; ``planted`` in some of all kinds."""
    own = {f"k{j}": [f"The {w} of the {f} ward {v} for the spring." for w in ("rota", "ledger") for f in ("north", "south") for v in ("waits", "turns")] for j in range(5)}
    for j, k in enumerate(sorted(own)):
        own[k] = [x.replace("spring", ["spring", "autumn", "winter", "summer", "harvest"][j]) for x in own[k]]
    out = []
    for k in range(n):
        kind, lang = f"k{k % 5}", "de" if k % 7 == 0 else "en"
        text = " ".join(own[kind][(k + j) % 8] for j in range(3)) + (" Der Dienst der Woche liegt beim alten Haus." if lang == "de" else "")
        mine = [" - Mended the upper lantern with care.", " I like the quiet of the lower hall.", ""][k % 3]  # reports recur as widely, but are no notice
        out.append((k, f"s{(k * 7 // 5) % 5}", kind, lang, text + mine + (" " + planted.format(k) if k % 19 == 3 and k < 570 else "")))
    return out


def test_a_message_without_a_listed_word_is_found_by_its_spread(spark):
    planted = "Yonder lantern {} sleeps until dawn, kindly wander elsewhere."
    schema = "doc_id long, source string, doc_type string, lang string, text string"
    whole = spark.createDataFrame(_corpus(600, planted), schema)
    found = lambda df: sorted(x[0] for x in rows(residue.residue_documents(df, "doc_id", "text", "source", ("doc_type", "lang")).where("kind = 'recurring'")))
    want = [k for k in range(570) if k % 19 == 3]
    assert len(want) == 30 and found(whole) == want
    assert found(whole.where("doc_id < 300")) == [k for k in want if k < 300]  # half the corpus says the same
    assert found(spark.createDataFrame([(*r[:2], "k1", *r[3:]) for r in _corpus(600, planted)], schema)) == []  # one kind only: spread cannot be told
    m = {r["message"]: (r["docs"], r["sources"]) for r in residue.residue_messages(whole, "doc_id", "text", "source", ("doc_type", "lang")).collect()}
    assert list(m.values()) == [(30, 5)]
    dirty = whole.unionByName(whole).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang"))).withColumn("h", F.lit(1))
    assert found(dirty) == want  # repeated rows, null dimensions, clashing names


def test_unlisted_messages_that_recur_widely(spark):
    lead = ["Notice: the file viewer", "Sorry, our candidate search", "the posting", "Whoops, this vacancy", "That link"]
    gone = [(k, f"s{k % 3}", f"Menu\n{lead[k % 5]} went sideways for now{[' (code 503)!', '.'][k % 2]}") for k in range(10)]
    plain = [(20 + k, f"s{k % 3}", "Our office is close to the ferry.") for k in range(9)]
    one_source = [(40 + k, "s1", "Sorry, the kettle is empty.") for k in range(5)]
    mine = [(60 + k, f"s{k % 3}", "Sorry, I like long letters.") for k in range(5)]
    alone = [(80, "s1", "Sorry, the ferry ran late.")]
    df = spark.createDataFrame(gone + plain + one_source + mine + alone, "doc_id long, source string, text string")
    assert rows(residue.residue_documents(df, "doc_id", "text", "source")) == [(k, "error") for k in range(10)]


def test_wording_missing_from_the_rules(spark):
    bad = ["Notice: the application form returned an empty reply (code 503)!", "- Put your job history in place of this line.", "Add a catchy headline (max. 300 characters).", "Paste the duties of the post and delete this hint.",
           "Test test test please ignore this posting test", "Enter a short profile here."]
    good = ["Put in place a new rota for this line of trams.", "Write to us and enter the draw held here in May.", "Test plans and test benches for the test team.", "Added a headline in this space at the museum."]
    df = spark.createDataFrame([(k, "s", t) for k, t in enumerate(bad)] + [(100 + k, "s", t) for k, t in enumerate(good)], "doc_id long, source string, text string")
    assert rows(residue.residue_documents(df, "doc_id", "text", "source").select("doc_id")) == [(k,) for k in range(len(bad))]


def _written(tree, r):
    """A random text of a parsed pattern; anchors and look-arounds are passed over."""
    from re import _constants as c

    out = ""
    for op, arg in tree:
        if op is c.LITERAL:
            out += chr(arg)
        elif op is c.BRANCH:
            out += _written(r.choice(arg[1]), r)
        elif op is c.SUBPATTERN:
            out += _written(arg[3], r)
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT):
            out += "".join(_written(arg[2], r) for _ in range(r.randint(arg[0], min(arg[1], arg[0] + 2))))
        elif op is c.IN:
            k, v = r.choice(arg)
            out += {c.LITERAL: lambda: chr(v), c.RANGE: lambda: chr(r.randint(*v)), c.NEGATE: lambda: " "}.get(k, lambda: {"SPACE": " ", "NOT_WORD": " "}.get(str(v)[9:], "a"))()
    return out


def test_every_rule_passes_the_hint(spark):
    import random
    import re

    def passes(low):
        tokens = re.sub(r"[\W_]+", " ", low).strip().split(" ")
        words = any(w in residue._HINT_WORDS or w.startswith("asdf") for w in tokens)
        return bool(re.search(residue._HINT_MARKS, low) or words or tokens[0] in residue._HINT_FIRST or sum(w in residue._LATIN_WORDS for w in tokens) >= 5)

    r, tried = random.Random(4), 0
    for rule in (residue._UNDEFINED, residue._FILLER, residue._SCRIPT, residue._ERROR, residue._WEAK):
        tree = re._parser.parse(rule)
        for _ in range(1_500):
            text = _written(tree, r)
            if re.search(rule, text):
                tried += 1
                for x in (text, text.replace(" ", "  ")):
                    assert passes(x.lower()), (rule[:30], x)
    assert tried > 4_000
    lost = ["Dear None,", "Hello NaN", "Salary: None", "This is a sample paragraph.", "Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum", "Page not  found"]
    df = spark.createDataFrame([(k, "s", t) for k, t in enumerate(lost)], "doc_id long, source string, text string")
    assert rows(residue.residue_documents(df, "doc_id", "text", "source").select("doc_id")) == [(k,) for k in range(len(lost))]


def test_weak_phrases_do_not_hang_on_the_size_of_the_corpus(spark):
    typed = ["HMM. It ran late.", "- Hmm. It ran early.", "Hmm! It ran."]
    df = spark.createDataFrame([(k, "s", t) for k, t in enumerate(typed * 20)], "doc_id long, source string, text string")
    assert residue.residue_documents(df, "doc_id", "text", "source").count() == 0
    alone = [(0, "Oops!"), (1, "Menu\n- HMM. Please go back and try again."), (2, "x\nIncident 4-77.\ny"), (3, "Oops! I did it once."), (4, "Hmm, that rota again.")]
    df = spark.createDataFrame([(k, None, t) for k, t in alone], "doc_id long, source string, text string")
    assert rows(residue.residue_documents(df, "doc_id", "text", "source")) == [(0, "error"), (1, "error"), (2, "error")]


def test_common_notices(spark):
    bad = ["Permission denied.", "Page expired.", "Please enable JS to continue.", "Diese Seite existiert nicht.", "TODO: add company background", "Unable to load the page.", "You are not authorized to view this page.",
           "Internal server error", "Zugriff verweigert.", "Esta página no existe.", "Cette page n'existe plus.", "Session expired", "The server is not available.", "Please try again later.", "An unexpected error occurred.",
           "Verify that you are human.", "Dear [Customer Name],", "The requested file has been deleted.", "TBD"]
    good = ["Denied permission to two suppliers and found better ones.", "Expired stock was cleared in a week.", "We enable teams to write.", "Taught people to load a page of type.", "He was not available on Monday.", "Verified that people are paid."]
    df = spark.createDataFrame([(k, "s", t) for k, t in enumerate(bad)] + [(100 + k, "s", t) for k, t in enumerate(good)], "doc_id long, source string, text string")
    assert sorted(r["doc_id"] for r in residue.residue_documents(df, "doc_id", "text", "source").collect()) == list(range(len(bad)))
