"""Phrasing-bias flags of briefs and experience asked beyond a role's seniority."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import context_around

# Patterns by category that must agree with published behaviour for equal flags.
RULES: tuple[tuple[str, str], ...] = (
    ("gendered", r"\b(he|him|his)\s*/\s*(she|her|hers)\b|\b(s?he)\b(?!\s*/)|\bhis/her\b"),
    ("gendered", r"\b(manpower|man[- ]hours|chairman|salesman|craftsman|workmanlike)\b"),
    ("gendered", r"\b(rockstar|ninja|guru|wizard|superstar|hacker|jedi|beast)\b"),
    ("gendered", r"\b(aggressive|dominant|fearless|relentless|cutthroat|killer instinct)\b"),
    ("age", r"\b(young|youthful|energetic|digital native|recent grad(uate)?s? only|fresh(er)?s? only|new blood)\b"),
    ("age", r"\b(born after|under\s+\d{2}\s*(years old|yrs))\b"),
    ("elitism", r"\b(tier[- ]?1|tier[- ]?one|iit|nit|bits|ivy league|top[- ](tier|ranked)\s+(college|university|institute)|premier institute)\b"),
    ("elitism", r"\b(cgpa|gpa)\s*(of\s*)?(above|over|minimum|min\.?|at least)?\s*[89](\.\d)?\b|\b(first class|distinction)\s+(only|mandatory|required)\b"),
    ("elitism", r"\b(from|of)\s+(a\s+)?(reputed|reputable|prestigious|well[- ]known)\s+(college|university|institute|company)\b"),
    ("vague", r"\b(culture[- ]fit|cultural fit|work hard,? play hard|like a family|wear many hats|thrive under pressure|no[- ]excuses)\b"),
    ("vague", r"\b(must be able to|should be willing to)\s+work\s+(long hours|weekends|nights|overtime|24/7)\b"),
    ("vague", r"\b(native|mother[- ]tongue)\s+(english|speaker)\b"),
)
#: What a flag of a category means, for whoever edits the brief.
ADVICE = {
    "gendered": "May read as meant for one gender; name the work or the skill.",
    "age": "May read as meant for one age group; name the experience needed.",
    "elitism": "Selects by where or how well someone studied; name what they must be able to do.",
    "vague": "Cannot be checked in a resume and may put people off; name the duty or drop it.",
    "overreach": "Asks for more years than the role's level explains.",
}
SENIORITY: tuple[tuple[str, str, int], ...] = (
    ("intern", r"\b(intern|internship|trainee|apprentice)\b", 0),
    ("junior", r"\b(junior|entry[- ]level|graduate|fresher|associate|jr\.?)\b", 1),
    ("mid-level", r"\b(mid[- ]level|intermediate)\b", 4),
    ("senior", r"\b(senior|lead|principal|staff|head of|manager|architect)\b", 99),
)
YEARS = r"(\d+)\s*\+?\s*(?:-\s*\d+\s*)?(?:years?|yrs?)\b[^.]{0,40}?(?:experience|exp\b)"


def seniority(text: Column) -> Column:
    """The first tier a text names, interns first: struct (label, max_years); null if none."""
    low = F.lower(text)
    out = F.when(F.lit(False), F.struct(F.lit("").alias("label"), F.lit(0).alias("max_years")))
    for label, pattern, most in SENIORITY:
        out = out.when(low.rlike(pattern), F.struct(F.lit(label).alias("label"), F.lit(most).alias("max_years")))
    return out


def flag_phrases(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document, category and lower-cased phrase. All rules are array expressions over one scan, no join."""
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))

    def found(category: str, pattern: str) -> Column:
        phrases = F.regexp_extract_all(low, F.lit(pattern), F.lit(0))
        return F.transform(phrases, lambda x: F.struct(F.lit(category).alias("category"), F.trim(x).alias("phrase")))

    hits = F.flatten(F.array(*[found(c, p) for c, p in RULES]))
    flat = docs.select(F.col(id_col), F.explode(F.array_distinct(hits)).alias("h"))
    return flat.select(id_col, "h.category", "h.phrase").distinct()


def flag_overreach(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Years of experience asked beyond what the named seniority can justify."""
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    tier = docs.select(F.col(id_col), seniority(low).alias("t"), F.explode(F.array_distinct(F.regexp_extract_all(low, F.lit(YEARS), F.lit(0)))).alias("phrase"))
    years = F.regexp_extract("phrase", r"^(\d+)", 1).try_cast("int")
    asked = tier.where(F.col("t").isNotNull()).select(id_col, F.col("t.label").alias("label"), F.col("t.max_years").alias("max_years"), F.trim("phrase").alias("phrase"), years.alias("years"))
    return asked.where("years > max_years").distinct()


def flag_brief(text: str | None) -> list[dict]:
    """The flags of one brief with notes and a snippet each, for display."""
    text = text or ""
    out, seen = [], set()

    def add(category: str, m: re.Match) -> None:
        phrase = m.group().strip()
        if (category, phrase.lower()) not in seen:
            seen.add((category, phrase.lower()))
            out.append({"phrase": phrase, "category": category, "note": ADVICE[category], "context": context_around(text, m.start(), len(phrase))})

    for category, pattern in RULES:
        for m in re.finditer(pattern, text, re.I | re.A):
            add(category, m)
    tier = next(((label, most) for label, p, most in SENIORITY if re.search(p, text, re.I | re.A)), None)
    if tier:
        for m in re.finditer(YEARS, text, re.I | re.A):
            if int(m.group(1)) > tier[1]:
                add("overreach", m)
    return out
