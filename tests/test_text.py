from pyspark.sql import functions as F

from rankloom.functions import aliases, numbers
from rankloom.functions import text as T
from rankloom.operators import split
from rankloom.operators.requirements import decompose, single_asks


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column).first()[0]


def test_normalise_tokens_and_twins(spark):
    x = F.col("x")
    for s in ["Node.JS — CI/CD, C++!", "", "  a\tb ", "É1"]:
        assert one(spark, T.normalize(x), s) == T.normalize_py(s)
    assert one(spark, T.tokenize(x), "node.js. ci/cd C#") == ["node.js.", "ci", "cd", "c#"]
    assert one(spark, T.tokenize(x), None) == []


def test_negation_and_sections(spark):
    x = F.col("x")
    for s, want in [("have never built anything with Node.js", True), ("haven't used React", False), ("No coding, web development", True), ("Built a tool", False)]:
        assert one(spark, T.is_negated(x), s) is want and T.is_negated_py(s) is want
    for s, want in [("Languages: Python, SQL, C++", None), ("Bachelor of Technology", None), ("Technical Skills:", "skills"), ("PROJECTS", "projects"), ("Work history", "experience")]:
        assert one(spark, T.section_of(x), s) == want and T.section_of_py(s) == want


def test_noise(spark):
    for s, section, want in [("2019 - 2021", "other", True), ("Go", "skills", False), ("Go", "other", True), ("mail me: a@b.co", "other", True), ("Wrote the billing service", "experience", False)]:
        got = spark.createDataFrame([(s, section)], "x string, s string").select(T.is_noise(F.col("x"), F.col("s"))).first()[0]
        assert got is want and T.is_noise_py(s, section) is want


def test_aliases(spark):
    x = F.col("x")
    assert one(spark, aliases.detect_skills(x), "HTML/CSS and Mongo") == ["css", "database", "html", "mongodb"]
    assert one(spark, aliases.expand_exact(x), "Built with Mongo") == "built with mongo mongodb database"
    assert one(spark, aliases.expand_exact(x), "plain words") == "plain words"
    assert aliases.fuzzy_alias("pyhton") == "python" and aliases.fuzzy_alias("string") == "spring" and aliases.fuzzy_alias("jaba") is None
    assert aliases.expand_py("Pyhton") == "pyhton python" and aliases.reverse()["typescript"] == ("typescript",)
    assert aliases.edit_distance("pyhton", "python", 2) == 1 and aliases.edit_distance("abc", "xyz", 1) == 2


def test_numbers(spark):
    x = F.col("x")
    assert one(spark, numbers.half_up(x, 1), -0.25, "double") == -0.2 and one(spark, numbers.half_up(x, 1), 0.25, "double") == 0.3
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0], [1.0])], "a array<double>, b array<double>, c array<double>")
    assert tuple(df.select(numbers.dot(F.col("a"), F.col("b")), numbers.dot(F.col("a"), F.col("c")), numbers.quantile(F.col("b"), 0.5)).first()) == (11.0, 0.0, 4.0)


def test_splitter_cases():
    assert split.split_claims("AWS (EC2, S3, Lambda), Go; SQL", "skills") == ["AWS (EC2, S3, Lambda)", "Go", "SQL"]
    assert split.split_claims("No coding, web development, or technical background.", "skills") == ["No coding, web development, or technical background"]
    line = "B.E. Computer Science, RV College of Engineering, Bengaluru (2023-2027), CGPA: 8.7/10"
    assert split.strip_institution(line) == "B.E. Computer Science, Bengaluru (2023-2027), CGPA: 8.7/10"
    assert split.swap_institution(line, "X")[0] == "B.E. Computer Science, X, Bengaluru (2023-2027), CGPA: 8.7/10"
    assert split.merge_wrapped(["Built a thing that", "works well", "• next", "EXPERIENCE", "small start"]) == ["Built a thing that works well", "• next", "EXPERIENCE", "small start"]


def test_units_of_a_document(spark):
    text = "ASHA RAO\nasha@x.co | Pune | 98765 43210\nSKILLS\nPython, Mongo. No Kubernetes experience.\nEDUCATION\nB.Tech Physics, Some College, 2020 to 2024\nEXPERIENCE\n- Built the billing service for a\nclinic network"
    docs = spark.createDataFrame([("c1", text, 1), ("c2", None, 2), ("c3", "  ", 3)], "id string, body string, section int")
    got = split.split_documents(docs, "id", "body").orderBy("ev_pos").collect()
    assert [r["text"] for r in got] == ["Based in Pune", "Python", "Mongo", "No Kubernetes experience", "B.Tech Physics, Some College, 2020 to 2024", "Built the billing service for a clinic network"]
    assert [r["negated"] for r in got] == [False, False, False, True, False, False]
    assert got[4]["scored_text"] == "B.Tech Physics, 2020 to 2024" and got[2]["expanded"] == "mongo mongodb database"
    assert got[0]["evidence_id"] == "c1::ev_001" and got[0]["scored_text"] is None


def test_decompose(spark):
    asks = {
        "SQL or NoSQL (MySQL, PostgreSQL, MongoDB)": ["SQL or NoSQL (MySQL, PostgreSQL, MongoDB)"], "JavaScript and React": ["JavaScript", "React"], "Express and Koa": ["Express and Koa"],
        "React (hooks, redux), git and a great attitude": ["React (hooks, redux)", "git", "a great attitude"], "Experience with React and a will to learn": ["Experience with React and a will to learn"],
    }
    df = spark.createDataFrame([(x,) for x in asks], "x string")
    assert {r["x"]: r["y"] for r in df.select("x", single_asks(F.col("x")).alias("y")).collect()} == asks
    brief = "Backend Engineer at Acme Works, est. 1990\nPune, Hybrid | 2026\nRequirements\n- Python and Docker\n- Strong communication\nPreferred qualifications\n- React\nBenefits\n- Free Java"
    got = decompose(spark, brief)
    assert got["title"] == "Backend Engineer" and got["company"] == "Acme Works"
    assert [(r["text"], r["kind"], r["category"], r["weight"]) for r in got["requirements"]] == [
        ("Python", "MUST", "skill", 1.2), ("Docker", "MUST", "skill", 1.0), ("Strong communication", "MUST", "soft", 0.3), ("React", "NICE", "skill", 0.5),
        ("Based in or able to work from Pune (Hybrid)", "MUST", "location", 0.8),
    ]
    assert decompose(spark, None)["requirements"] == []


def test_expansion_with_typo_repair_over_a_column(spark):
    texts = ["Built with Pyhton and mongo", "Pyhton, python", "string theory", "kuberntes/dokcer on AWS", "", None, "no terms here", "djagno djagno flask", "node.js. Reactjs"]
    df = spark.createDataFrame([(str(k), t, 7) for k, t in enumerate(texts)], "id string, body string, token int")
    got = {int(r["id"]): r["expanded_text"] for r in aliases.expand_repaired(df, "id", "body").collect()}
    assert {k: got[k] or "" for k in got} == {k: aliases.expand_py(t) for k, t in enumerate(texts)}
    assert aliases.expand_repaired(df.limit(0), "id", "body").count() == 0
