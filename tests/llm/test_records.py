"""Distinctive terms, fused ranks, duplicates and value mapping against plain loops."""

import itertools
import math
import random
import time
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import functions as F

from rankloom import session
from rankloom.llm import canonical, distinctive, formatdup, fusion, neardup
from tests.conftest import rows

# --- distinctive terms


def weights_by_loops(units):
    records = defaultdict(list)
    for kind, rid, text in units:
        if kind is not None and rid is not None:
            records[kind, rid] += (text or "").split()
    out = {}
    for kind in {k for k, _ in records}:
        own = {r: Counter(t) for (k, r), t in records.items() if k == kind}
        n, avg = len(own), sum(sum(c.values()) for c in own.values()) / len(own)
        df = Counter(t for c in own.values() for t in c)
        for r, c in own.items():
            dl = sum(c.values())
            for t, f in c.items():
                out[kind, r, t] = math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / avg))
    return out


def test_weights(spark, monkeypatch):
    r = random.Random(1)
    units = [(r.choice("ab"), f"r{r.randrange(9)}", " ".join(r.choice("t u v w x y z".split()) for _ in range(r.randrange(8)))) for _ in range(60)]
    units += [("a", "empty", None), ("a", None, "lost"), (None, "r1", "lost"), ("a", "long", "word " * 50_000)]
    df = spark.createDataFrame([(*u, 1, 2) for u in units], "record_kind string, record_id string, text string, tf int, df int")
    for hot in (1_000, 2):  # 2: terms of more than half of all records go the broadcast way
        monkeypatch.setattr(distinctive, "HOT_SHARE", hot)
        got = {(x["record_kind"], x["record_id"], x["term"]): x["weight"] for x in distinctive.term_weights(df).collect()}
        want = weights_by_loops(units)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert distinctive.term_weights(df.limit(0)).count() == 0


# --- fused ranks


def test_places_and_fusion(spark):
    r = random.Random(2)
    data = [("big" if k % 3 else f"g{k % 5}", f"i{k:03d}", r.choice([None, 1.0, 2.0, r.random()]), r.choice([None, float("nan"), 5.0, r.random()])) for k in range(150)]
    df = spark.createDataFrame([(*x, "clash") for x in data], "g string, i string, s double, t double, place string")
    got = fusion.fuse_ranks(df, "g", "i", ["s", "t"]).toPandas().set_index(["g", "i"])
    pdf = pd.DataFrame(data, columns=["g", "i", "s", "t"])
    for s in "st":
        pdf[f"place_{s}"] = pdf.groupby("g")[s].rank(ascending=False, method="average", na_option="bottom")
    pdf = pdf.set_index(["g", "i"])
    for k, row in pdf.iterrows():
        assert got.loc[k, "place_s"] == row["place_s"] and got.loc[k, "place_t"] == row["place_t"]
        assert abs(got.loc[k, "rrf"] - (1 / (60 + row["place_s"]) + 1 / (60 + row["place_t"]))) < 1e-12
    top = fusion.leaders(fusion.fuse_ranks(df, "g", "i", ["s", "t"]), "g", "i", [F.col("mean_place").asc()], 3)
    for g, own in pdf.assign(m=(pdf.place_s + pdf.place_t) / 2).reset_index().sort_values(["m", "i"]).groupby("g"):
        assert set(own["i"][:3]) == {x["i"] for x in top.where(F.col("g") == g).collect()}
    assert fusion.fuse_ranks(df.limit(0), "g", "i", ["s", "t"]).count() == 0


def test_scale_of_a_score_does_not_matter(spark):
    df = spark.createDataFrame([("g", k, float(k % 4), float(k % 7)) for k in range(20)], "g string, i int, s double, t double")
    big = df.withColumn("s", F.col("s") * 1e9 + 5)
    assert rows(fusion.fuse_ranks(df, "g", "i", ["s", "t"])) == rows(fusion.fuse_ranks(big, "g", "i", ["s", "t"]))


# --- near duplicates


def shingle_set(text, width):
    import re

    w = re.findall(r"[^\W_]+", text.lower())
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def corpus(seed, n=60):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    base = [[r.choice(words) for _ in range(r.randrange(20, 70))] for _ in range(n // 4)]
    out = []
    for k in range(n):
        t = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 4, 8])):
            at = r.randrange(len(t))
            r.choice([lambda: t.pop(at) if len(t) > 20 else None, lambda: t.insert(at, r.choice(words)), lambda: t.__setitem__(at, r.choice(words))])()
        if r.random() < 0.2:
            t = [x.upper() + "," for x in t]
        out.append((f"d{k:03d}", " ".join(t)))
    return out


def test_pairs_against_all_with_all(spark):
    for width, threshold, seed in [(3, 0.6, 1), (3, 0.6, 2), (5, 0.8, 3), (1, 0.5, 4)]:
        docs = corpus(seed)
        docs += [("none", None), ("blank", " "), ("short", "only a few words"), (docs[0][0], docs[0][1])]
        df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "id string, body string, rep string, n int")
        pairs, members = neardup.near_duplicates(df, "id", "body", width, threshold)
        got = set(map(tuple, neardup.expand_pairs(pairs, members).collect()))
        sets = {i: shingle_set(t, width) for i, t in docs if t and len(t.split()) >= 20}
        want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}
        assert got == want and len(want) > 20
    pairs, members = neardup.near_duplicates(df.limit(0), "id", "body", 3, 0.6)
    assert neardup.expand_pairs(pairs, members).count() == 0


def test_bands_cover_every_size():
    for t in (0.5, 0.6, 0.8):
        for n in range(1, 5_000):
            band = int(neardup.band_of(n, t))
            hi = neardup.band_limit(band, t)
            assert n <= hi and neardup.band_of(hi, t) == band and (band == 0 or n > neardup.band_limit(band - 1, t))
            assert neardup.segments_of(band, t) > neardup._budget(hi, math.ceil(hi / t), t)


def test_many_short_texts(spark):
    """Texts of twenty words over a small vocabulary, and sizes around the bound of short sets: nothing is lost and no key is shared by all."""
    r = random.Random(9)
    base = [[f"w{r.randrange(300)}" for _ in range(r.choice([20, 21, 24, 40, 43, 46, 60, 70]))] for _ in range(150)]
    docs = []
    for k in range(700):
        t = list(r.choice(base))
        for _ in range(r.choice([0, 1, 2])):
            t[r.randrange(len(t))] = f"w{r.randrange(300)}"
        docs.append((f"d{k:03d}", " ".join(t)))
    sets = {i: shingle_set(t, 3) for i, t in docs}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}
    df = spark.createDataFrame(docs, "id string, body string")
    pairs, members = neardup.near_duplicates(df, "id", "body", 3, 0.6)
    assert set(map(tuple, neardup.expand_pairs(pairs, members).collect())) == want and len(want) > 300
    rows_ = {x["id"]: x for x in neardup.linked_members(pairs, members).collect()}
    for i in sets:
        same = [j for j in sets if sets[j] == sets[i]]
        linked = {frozenset(map(tuple, sets[j])) for a, b in want if i in (a, b) for j in ((b,) if a == i else (a,)) if sets[j] != sets[i]}
        assert rows_[i]["rep"] == min(same) and rows_[i]["copies"] == len(same) and rows_[i]["links"] == len(linked)
    emitted = next(neardup._emit(0.6, False)(iter([pd.DataFrame({"id": [1, 2], "n": [18, 18], "hs": [list(range(18)), list(range(50, 68))], "df": [[2] * 18] * 2})])))
    assert len(emitted) == 2 * (18 - 11 + 1) and emitted["key"].is_unique


def test_passes_find_all_on_little_disk(spark, tmp_path, monkeypatch):
    """Texts of shared sentences, in several passes: all pairs, and never more on disk than four times the texts, shuffle files included."""
    r = random.Random(5)
    words = [f"word{k}" for k in range(2_000)]
    pool = [[r.choice(words) for _ in range(10)] for _ in range(400)]
    base = [[w for x in r.sample(pool, r.randrange(5, 30)) for w in x] for _ in range(700)]
    docs = []
    for k in range(1_000):
        t = list(base[k] if k < 700 else r.choice(base))
        for _ in range(len(t) // r.choice([8, 16, 40])):
            t[r.randrange(len(t))] = r.choice(words)
        docs.append((f"d{k:04d}", " ".join(t)))
    path = str(tmp_path / "in")
    spark.createDataFrame(docs, "id string, body string").coalesce(1).write.parquet(path)
    size = lambda at: sum(x.stat().st_size for x in at.rglob("*.parquet"))
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        each = files.getAllFiles()
        return {x.getName(): x.length() for x in (each.apply(i) for i in range(each.size())) if x.getName().startswith("shuffle_")}

    kept, used, old = neardup.materialize, [], shuffled()

    def watched(df, *args, **more):
        out = kept(df, *args, **more)
        deadline = time.time() + 5  # files are deleted in the background
        while (own := sum(v for k, v in shuffled().items() if k not in old)) > 50_000 and time.time() < deadline:
            time.sleep(0.1)
        used.append(own + size(tmp_path / "shared"))
        return out

    (tmp_path / "shared").mkdir()
    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path / "shared"))
    monkeypatch.setattr(neardup, "materialize", watched)
    for name, value in (("KEYS_A_PASS", 15_000), ("PAIRS_A_PASS", 100)):
        monkeypatch.setattr(neardup, name, value, raising=False)
    pairs, members = neardup.near_duplicates(spark.read.parquet(path), "id", "body", 3, 0.6)
    got = set(map(tuple, neardup.expand_pairs(pairs, members).collect()))
    sets = {i: shingle_set(t, 3) for i, t in docs}
    assert got == {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])} and len(got) > 100
    assert max(used) <= 4 * size(tmp_path / "in"), [x / size(tmp_path / "in") for x in used]


# --- copies in other typing


def test_copies(spark):
    long = "\n".join(f"Line {k} of the resume has words" for k in range(8))
    turned = "\n".join(reversed(long.upper().replace(" ", "  ").split("\n"))) + "\n\n"
    data = [
        ("b", "Re_sume-1.PDF", long), ("a", "resume 1.pdf", turned), ("c", "resume2.pdf", long), ("d", "resume1pdf", long + "\n!!"), ("d", "resume1pdf", long + "\n!!"),
        ("e", None, long), ("f", "", long), ("g", "x", None), ("h", "x", None), ("i", "x", "too short"), ("j", "x", "too short"), (None, "resume1.pdf", long),
    ]
    df = spark.createDataFrame([(*x, "clash", 1) for x in data], "id string, name string, body string, key string, first int")
    assert rows(formatdup.collapse(df, "id", "name", "body")) == [
        ("a", "a", 3), ("b", "a", 3), ("c", "c", 1), ("d", "a", 3), ("e", "e", 2), ("f", "e", 2), ("g", "g", 1), ("h", "h", 1), ("i", "i", 1), ("j", "j", 1),
    ]
    assert formatdup.collapse(df.limit(0), "id", "name", "body").count() == 0


def test_a_hot_group_spreads_over_ranges(spark):
    text = " ".join(f"w{k}" for k in range(30))
    df = spark.range(600).select(F.format_string("i%04d", "id").alias("id"), F.lit("n").alias("name"), F.when(F.col("id") % 3 == 0, F.lit(text)).otherwise(F.concat(F.lit(text + " x"), F.col("id").cast("string"))).alias("body"))
    got = formatdup.collapse(df, "id", "name", "body")
    assert got.where("copies > 1").count() == 200 and got.where("copies = 200").select("keep_id").distinct().count() == 1
    assert got.where("copies > 1").first()["keep_id"] == "i0000" and got.count() == 600


# --- canonical values

ENTRIES = [(1, "python", ["py3"]), (2, "load balancing", ["lb tuning"]), (3, "c++", ["cpp"]), (4, "a/b testing", None), (5, "scala", []), (6, "web accessibility", ["a11y"]), (7, "search engine optimisation", ["seo"])]


def mapped(spark, values):
    ref = spark.createDataFrame([(*e, "clash") for e in ENTRIES], "skill_id int, canonical string, also_known array<string>, value string")
    df = spark.createDataFrame([(v, 1) for v in values], "value string, entry int")
    return {r["value"]: r["entry"] for r in canonical.map_values(df, ref, "skill_id", "canonical", "also_known").collect()}


def test_spellings(spark):
    want = {
        "Python": 1, "PYHTON": 1, "pythons": 1, "* py3": 1, "working knowledge of python": 1, "python 3.10": 1, "python (5+ years)": 1, "Grundkenntnisse in Python": 1, "python, 5 Jahre": 1, "conocimientos de python": 1, "Python (avancé)": 1, "expérience avec python 3 ans": 1, "pythn - intermediate": 1,
        "balancing, load": 2, "load_balancing": 2, "loadbalancing": 2, "lod balancin": 2, "adv. LB tuning": 2, "load & balancing.": 2,
        "C++": 3, "cpp": 3, "c#": 0, "c": 0, "A/B Testing, 4 yrs": 4, "a b tesitng": 4, "scala": 5, "scalar fields": 0, "Pythons And Boas": 0, "load carrying": 0,
        "wbe accessibility": 6, "search engine optimization": 7, "seo": 7, "sea": 0, "advanced": 0, "!!": 0, "python load balancing": 0, "web": 0,
    }
    got = mapped(spark, [*want, *want, None, "", "  "])
    assert got == want


def test_every_single_edit_of_a_long_word_is_repaired(spark):
    word = "balancing"
    edits = {word[:k] + word[k + 1 :] for k in range(9)} | {word[:k] + "q" + word[k:] for k in range(10)} | {word[:k] + word[k + 1] + word[k] + word[k + 2 :] for k in range(8)}
    got = mapped(spark, [f"load {e}" for e in edits])
    assert set(got.values()) == {2} and len(got) == len(edits)


def test_cover_of_entries_and_values(spark):
    names = "amber birch cobalt dune ember fjord grove heath".split()
    ref = spark.createDataFrame([(k, f"{n} tools", None) for k, n in enumerate(names, 1)] + [(20, "river gate keeping", None)], "skill_id int, canonical string, also_known array<string>")
    want = {"amber": 1, "Tools amber": 1, "ambre toolz": 1, "tools": 0, "amber birch tools": 0, "amber lantern": 0, "river gate": 0, "gate river keeping": 20, "amber " * 3_000: 1}
    df = spark.createDataFrame([(v,) for v in [*want, "q" * 60_000, "amber " + "x" * 60_000, " ".join(f"w{k}" for k in range(5_000))]], "value string")
    got = {r["value"]: r["entry"] for r in canonical.map_values(df, ref, "skill_id", "canonical", "also_known").collect()}
    assert {v: got[v] for v in want} == want and sum(got.values()) == sum(want.values())  # a common word may be missing, a rare one not; long words match none
    rows_ = spark.createDataFrame([(k, "amber" if k % 3 else "Tools amber") for k in range(90)], "id int, value string")
    assert {r["entry"] for r in canonical.mapped_rows(rows_, canonical.map_values(rows_, ref, "skill_id", "canonical", "also_known")).collect()} == {1}


def test_no_reference(spark):
    ref = spark.createDataFrame([], "skill_id int, canonical string, also_known array<string>")
    df = spark.createDataFrame([("x",)], "value string")
    assert [r["entry"] for r in canonical.map_values(df, ref, "skill_id", "canonical", "also_known").collect()] == [0]
    assert canonical.map_values(df.limit(0), ref, "skill_id", "canonical", "also_known").count() == 0
