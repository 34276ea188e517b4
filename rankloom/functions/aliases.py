"""The alias dictionary: expansion, detection and bounded typo repair."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.text import normalize, normalize_py, tokenize

# Canonical terms and the phrases that imply them.
ALIASES: dict[str, tuple[str, ...]] = {
    "node.js": (
        "node", "nodejs", "node js", "express", "expressjs", "express.js", "nestjs", "nest.js", "fastify", "koa", "server-side javascript",
        "server side javascript", "backend javascript",
    ),
    "react": (
        "reactjs", "react.js", "react js", "jsx", "react hooks", "usestate", "useeffect", "redux", "next.js", "nextjs", "component-based ui",
        "single page application", "spa",
    ),
    "mongodb": ("mongo", "mongoose", "mongo db", "nosql", "document database"),
    "sql": ("postgres", "postgresql", "mysql", "sqlite", "mariadb", "relational database", "rdbms", "joins", "stored procedure"),
    "database": (
        "mongodb", "mongo", "sql", "postgres", "postgresql", "mysql", "sqlite", "supabase", "firebase", "dynamodb", "redis", "persistence",
        "schema design",
    ),
    "rest api": ("rest", "restful", "rest apis", "api endpoint", "endpoints", "crud", "http api", "graphql", "json api", "web services"),
    "git": ("github", "gitlab", "bitbucket", "version control", "pull request", "pull requests", "merge request", "branching", "code review"),
    "javascript": ("js", "es6", "es2015", "ecmascript", "typescript", "vanilla js", "async/await", "promises", "node.js", "react"),
    "typescript": ("ts", "typed javascript", "tsx"),
    "html": ("html5", "markup", "semantic html"),
    "css": ("css3", "scss", "sass", "tailwind", "bootstrap", "styled-components", "responsive design"),
    "cloud": (
        "aws", "ec2", "s3", "lambda", "gcp", "google cloud", "azure", "vercel", "render", "heroku", "netlify", "digitalocean", "docker", "kubernetes",
        "ci/cd", "github actions", "deployed", "deployment",
    ),
    "testing": (
        "jest", "mocha", "chai", "vitest", "cypress", "playwright", "pytest", "junit", "automated tests", "automated testing", "tests",
        "test automation", "qa", "unit test", "unit tests", "integration test", "test coverage", "tdd",
    ),
    "python": ("py", "django", "flask", "fastapi", "pandas", "numpy"),
    "java": ("spring", "spring boot", "jvm"),
    "computer science": (
        "cse", "cs", "information technology", "b.tech", "btech", "bachelor of technology", "bachelor of engineering", "b.e.", "software engineering",
    ),
    "machine learning": ("ml", "deep learning", "tensorflow", "pytorch", "scikit-learn", "sklearn", "neural network", "cnn", "nlp"),
    "agile": ("scrum", "sprint", "kanban", "standup", "jira"),
}
FUZZY_LENGTH = 5
LONG_TOKEN = 8


@lru_cache(maxsize=1)
def reverse() -> dict[str, tuple[str, ...]]:
    """Phrase to the canonical terms it implies, longest phrase first.

    A canonical term stands for itself alone when it is entered; entries after it may add to it.
    """
    table: dict[str, list[str]] = {}
    for canonical, phrases in ALIASES.items():
        for p in phrases:
            table.setdefault(p, []).append(canonical)
        table[canonical] = [canonical]
    order = sorted(table, key=len, reverse=True)
    return {p: tuple(table[p]) for p in order}


@lru_cache(maxsize=1)
def _phrases_by_word() -> dict[str, list[tuple[int, str, tuple[str, ...]]]]:
    """The dictionary's places, phrases and terms by the phrases' first words."""
    out: dict[str, list] = {}
    for k, (p, canonicals) in enumerate(reverse().items()):
        out.setdefault(p.split()[0], []).append((k, p, canonicals))
    return out


def _literal_pairs() -> Column:
    """The dictionary as a constant array: the phrase between blanks and the terms it implies."""
    return F.array(*[F.struct(F.lit(f" {p} ").alias("p"), F.array(*[F.lit(c) for c in cs]).alias("c")) for p, cs in reverse().items()])


def _bound(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, not again for each element that ``body`` goes through."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _implied_by(base: Column) -> Column:
    """Terms implied by a normalised text; it is searched as it is and with slashes made blanks."""
    hay = F.concat(F.lit(" "), base, F.lit(" \n "), F.regexp_replace(F.replace(base, F.lit("/"), F.lit(" ")), r"\s+", " "), F.lit(" "))
    return _bound(hay, lambda h: F.array_distinct(F.flatten(F.transform(F.filter(_literal_pairs(), lambda e: h.contains(e["p"])), lambda e: e["c"]))))


def implied(x: Column) -> Column:
    """Canonical terms that the phrases of a text imply, in dictionary order, each once."""
    return _implied_by(normalize(x))


def expand_exact(x: Column) -> Column:
    """The normalised text followed by the implied terms that it does not hold as words (no typo repair)."""

    def whole(base: Column) -> Column:
        padded = F.concat(F.lit(" "), base, F.lit(" "))
        return F.concat_ws(" ", base, F.array_join(F.filter(_implied_by(base), lambda c: ~padded.contains(F.concat(F.lit(" "), c, F.lit(" ")))), " "))

    return F.rtrim(_bound(normalize(x), whole))


def detect_skills(x: Column) -> Column:
    """The implied canonical terms, sorted."""
    return F.array_sort(implied(x))


def edit_distance(a: str, b: str, most: int) -> int:
    """Optimal string alignment distance (an adjacent swap is one edit); ``most + 1`` beyond ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a):
        row = [i + 1]
        for j, y in enumerate(b):
            best = min(rows[-1][j + 1] + 1, row[j] + 1, rows[-1][j] + (x != y))
            if i and j and x == b[j - 1] and y == a[i - 1]:
                best = min(best, rows[-2][j - 1] + 1)
            row.append(best)
        if min(row) > most:
            return most + 1
        rows.append(row)
    return min(rows[-1][-1], most + 1)


@lru_cache(maxsize=100_000)
def fuzzy_alias(token: str) -> str | None:
    """The dictionary word meant by a misspelt one: same first letter, one edit (two from eight letters), nearest first."""
    if len(token) < FUZZY_LENGTH or token in reverse():
        return None
    budget = 2 if len(token) >= LONG_TOKEN else 1
    near = [
        (edit_distance(token, p, budget), k, p)
        for k, p in enumerate(reverse())
        if " " not in p and len(p) >= FUZZY_LENGTH and p[0] == token[0] and abs(len(p) - len(token)) <= budget
    ]
    best = min(near, default=None)
    return best[2] if best and best[0] <= budget else None


def expand_py(text: str | None) -> str:
    """Expansion with typo repair, for the splitter."""
    return expand_normalized(normalize_py(text))


def expand_normalized(base: str) -> str:
    """The same of a text that is normalised already."""
    padded, slashed = f" {base} ", f" {base.replace('/', ' ')} "
    found: dict[str, None] = {}
    words, phrases = slashed.split(), _phrases_by_word()
    # a phrase is looked for only where its first word stands
    for _, p, canonicals in sorted({x for w in {*words, *base.split()} if w in phrases for x in phrases[w]}):
        if f" {p} " in padded or f" {p} " in slashed:
            for c in canonicals:
                if f" {c} " not in padded:
                    found[c] = None
    for t in words:
        hit = fuzzy_alias(t)
        for c in reverse()[hit] if hit else ():
            if f" {c} " not in padded:
                found[c] = None
    return " ".join([base, *found]) if found else base


def repaired_words(words: DataFrame) -> DataFrame:
    """``words(token)``, distinct, to the misspelt ones with the dictionary word and the canonical terms meant."""

    def repair(batches):
        for pdf in batches:
            hits = [(t, fuzzy_alias(t)) for t in pdf["token"]]
            yield pd.DataFrame([(t, h, list(reverse()[h])) for t, h in hits if h], columns=["token", "alias", "canonical"])

    return words.where(F.length("token") >= FUZZY_LENGTH).mapInPandas(repair, "token string, alias string, canonical array<string>")


def fuzzy_table(texts: DataFrame, column: str) -> DataFrame:
    """Distinct misspelt tokens of a column with the dictionary word and canonical terms meant.

    Runs over the distinct vocabulary, blocked by first letter and length, never over the texts.
    """
    return repaired_words(texts.select(F.explode(F.array_distinct(tokenize(F.col(column)))).alias("token")).distinct())


def expand_repaired(texts: DataFrame, id_col: str, column: str) -> DataFrame:
    """``texts`` with ``expanded_text``: the normalised text, the terms its phrases imply, then those its misspelt words mean.

    Misspelt words are repaired once per distinct word of the column (:func:`repaired_words`) and joined back by word; a text that has none is
    expanded where it stands. ``id_col`` is unique.
    """
    base = texts.select(id_col, normalize(F.col(column)).alias("_base"))
    words = base.select(id_col, F.posexplode(F.split(F.replace("_base", F.lit("/"), F.lit(" ")), r"\s+")).alias("_at", "token"))
    fixed = repaired_words(words.select("token").distinct()).select("token", "canonical")
    hits = words.join(fixed, "token").groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("_at", "canonical"))).alias("_h"))
    both = texts.join(hits.select(id_col, F.flatten(F.transform("_h", lambda h: h["canonical"])).alias("_meant")), id_col, "left")
    padded = F.concat(F.lit(" "), normalize(F.col(column)), F.lit(" "))
    terms = F.array_distinct(F.concat(implied(F.col(column)), F.coalesce("_meant", F.array().cast("array<string>"))))
    extra = _bound(padded, lambda p: F.filter(terms, lambda c: ~p.contains(F.concat(F.lit(" "), c, F.lit(" ")))))
    return both.select(*texts.columns, F.rtrim(F.concat_ws(" ", normalize(F.col(column)), F.array_join(extra, " "))).alias("expanded_text"))


def alias_table(spark: SparkSession) -> DataFrame:
    """The dictionary as rows ``(alias, canonical, ord)``; under 200 rows."""
    rows = [(p, c, k) for k, (p, cs) in enumerate(reverse().items()) for c in cs]
    return spark.createDataFrame(rows, "alias string, canonical string, ord int")
