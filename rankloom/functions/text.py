"""Text column functions: normalisation, tokens, sections, negation, noise.

Patterns are safe for Java, Python and RE2 alike. ``Column`` functions stay inside whole-stage code generation; the
plain Python twins serve the line splitter, where one line's reading depends on the lines before it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache, wraps

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns that must agree with published behaviour for equal results.
TOKEN = r"[a-z0-9+#.]+"
TOKEN_RE = re.compile(TOKEN)
SECTION_RULES = (
    (r"summary|objective|profile|^about|introduction|overview", "other"),
    (r"^(technical\s+|core\s+|key\s+|relevant\s+)?skills?|^technolog|competenc|expertise|proficienc|^tools|tech\s+stack", "skills"),
    (r"projects?|portfolio|personal\s+(work|project)|side\s+project|things\s+i\s+(did|built|made)|what\s+i\s+built|builds?", "projects"),
    (r"experience|employment|work\s+(history|background)|internships?|professional|career|positions?\s+held|journey|roles?", "experience"),
    (r"education|academic|qualification|schooling|coursework|degrees?", "education"),
    (r"certification|awards?|achievement|publication|activities|extracurricular|interests?|hobbies|languages|references|volunteer", "other"),
)
LABELLED = r":\s*\S+(\s+|,)\S+"
DEGREE = r"\b(b\.?\s?tech|b\.?\s?sc|b\.?\s?e\b|b\.?\s?a\b|m\.?\s?tech|m\.?\s?sc|m\.?\s?a\b|mba|bachelor|master|diploma|ph\.?\s?d)\b"
BULLET = r"^[\s]*[•▪●○◦‣∙*−–—-]+\s*"
NEGATIONS = (
    r"^(no|not|none|never|without|lacking|zero)\b|^(no|limited|minimal)\s+(coding|technical|programming|software|development|professional)\b",
    r"\b(no|not|never|without|lacking|zero|nil)\s+(formal\s+|any\s+|prior\s+|professional\s+|hands[- ]on\s+|real\s+|direct\s+)?"
    r"(experience|exposure|background|knowledge|training|familiarity|tooling|coding|programming|technical|software|development|source\s+control|version\s+control)\b",
    r"\b(never|not|n't|nor)\s+(really\s+|actually\s+|formally\s+|yet\s+|ever\s+)?"
    r"(built|build|used|use|worked|work|written|write|wrote|touched|coded|code|developed|develop|implemented|implement|shipped|deployed|studied|learned)\b",
    r"\b(but|though|although|however)\s+(i\s+)?(have\s+|has\s+|had\s+)?(never|not|no)\b",
    r"\b(limited|minimal|little|only\s+basic|basic|some|no\s+real)\s+(hands[- ]on\s+|practical\s+|professional\s+|formal\s+|direct\s+)?"
    r"(experience|exposure|knowledge|familiarity|understanding|background)\b",
)
_MONTH = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+"
DATE_ONLY = (
    r"^\(?\s*(\d{4}|\d{4}\s*[–—-]\s*(\d{4}|present|current|now|ongoing)|" + _MONTH + r"\d{4}(\s*[–—-]\s*(" + _MONTH + r")?(\d{4}|present|current|now))?"
    r"|\d{1,2}/\d{4}(\s*[–—-]\s*(\d{1,2}/\d{4}|present))?)\s*\)?$"
)
MIN_LENGTH = {"skills": 2, "experience": 12, "projects": 12, "education": 8, "other": 12}
CONTACT_LABEL = r"^(phone|tel|telephone|mobile|mail|e-?mail|location|address|linked\s?in|github|gitlab|portfolio|website|dob|date of birth)\s*[:–-]"
CONTACT_MARKER = r"@|https?://|(github|linkedin|gitlab)\.com|\+?\d[\d\s()-]{8,}"
EMAIL = r"[\w.+-]+@[\w.-]+\.\w{2,}"
PROFILE = r"\b(github|gitlab|linkedin|leetcode|behance|dribbble)\.com/[\w.-]+"
BARE_PHONE = r"^(\+?\d[\d\s()-]{7,})$"
STOPWORDS = (
    "with", "and", "the", "for", "experience", "building", "familiarity", "ability", "comfortable", "understanding", "exposure", "such", "solid", "currently",
    "pursuing", "degree", "related", "field", "design", "consume", "writing", "applications", "platform", "automated", "collaborative", "user", "interfaces",
    "services", "databases", "fundamentals",
)
REQ_LEAD = r"^(Experience|Ability to|Familiarity with|Comfortable with|Solid understanding of)\s+"


#: Lines up to this length have their last answers kept, so many for each function.
KEPT_LENGTH, KEPT = 400, 5_000


def kept(f: Callable) -> Callable:
    """``f`` of a line with its last answers on short lines kept: lines recur in a text's variants, and headings everywhere."""
    short = lru_cache(maxsize=KEPT)(f)
    return wraps(f)(lambda line, *rest: short(line, *rest) if len(line) <= KEPT_LENGTH else f(line, *rest))


def ci(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.IGNORECASE | re.ASCII)


def normalize(x: Column) -> Column:
    """Lower case; all but ``a-z 0-9 . + # / -`` and blanks made blank; blanks collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), r"[^a-z0-9.+#/\s-]", " "), r"\s+", " "))


_FOREIGN, _BLANKS = re.compile(r"[^a-z0-9.+#/\s-]+"), re.compile(r"\s+")


def normalize_py(x: str | None) -> str:
    return _BLANKS.sub(" ", _FOREIGN.sub(" ", (x or "").lower())).strip()


def tokenize(x: Column) -> Column:
    """All runs of ``a-z 0-9 + # .`` of the lower-cased text; null gives none."""
    return F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(TOKEN), F.lit(0))


def filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def is_negated(x: Column) -> Column:
    """Whether a claim is a disclaimer; null is not."""
    low = F.lower(F.trim(F.coalesce(x, F.lit(""))))
    out = F.lit(False)
    for p in NEGATIONS:
        out = out | low.rlike(p)
    return out


_NEG = [ci(p) for p in NEGATIONS]
#: Words of which every disclaimer has one.
_NEG_WORDS = frozenset("no not none never without lacking zero nil n nor but though although however limited minimal little only basic some".split())
_LETTERS = re.compile("[a-z]+")


def is_negated_py(x: str) -> bool:
    t = x.strip()
    # a capital beyond ASCII may become a letter of a word that it bounds
    if t.isascii() and _NEG_WORDS.isdisjoint(_LETTERS.findall(t.lower())):
        return False
    return any(p.search(t) for p in _NEG)


def _heading(x: Column) -> Column:
    return F.regexp_replace(F.trim(x), r"[:\s]+$", "")


def section_of(x: Column) -> Column:
    """The section that a heading line opens, by the first rule that fits; null if the line is no heading."""
    t = _heading(x)
    words = F.size(F.split(t, r"\s+"))
    low = F.lower(t)
    fits = (
        (t != "") & (F.length(t) <= 45) & ~x.rlike(BULLET) & ~t.rlike(r"[.!?,]$") & (words <= 5) & ~x.rlike(LABELLED) & ~low.rlike(DEGREE)
    )
    out = F.when(~fits, F.lit(None).cast("string"))
    for pattern, name in SECTION_RULES:
        out = out.when(low.rlike(pattern), name)
    return out


_SECTION = [(ci(p), s) for p, s in SECTION_RULES]
_BULLET, _LABELLED, _DEGREE, _DATE = re.compile(BULLET), re.compile(LABELLED), ci(DEGREE), ci(DATE_ONLY)


def heading_py(line: str, longest: int = 45) -> str | None:
    """The words of a line that has the shape of a heading: few, without an end mark, a bullet, a filled label or a degree."""
    t = line.strip()
    while t.endswith(":"):
        t = t.rstrip(":").rstrip()
    shaped = t and len(t) <= longest and len(t.split()) <= 5 and t[-1] not in ".!?,"
    return t if shaped and not any(p.search(x) for p, x in ((_BULLET, line), (_LABELLED, line), (_DEGREE, t))) else None


@kept
def section_of_py(line: str) -> str | None:
    t = heading_py(line)
    return next((s for p, s in _SECTION if p.search(t)), None) if t else None


def is_noise(x: Column, section: Column) -> Column:
    """Whether a claim carries nothing to match: dates, contacts, links, no letters, too short for its section."""
    low = F.lower(F.coalesce(x, F.lit("")))
    least = F.lit(12)
    for name, n in MIN_LENGTH.items():
        least = F.when(section == name, F.lit(n)).otherwise(least)
    return (
        (low == "")
        | low.rlike(DATE_ONLY)
        | ~low.rlike("[a-z]")
        | (F.length(low) < least)
        | low.rlike(CONTACT_LABEL)
        | low.rlike(EMAIL)
        | (low.rlike(PROFILE) & low.rlike(r"[|·•]|\+?\d{6,}"))
        | low.rlike(BARE_PHONE)
        | low.rlike(r"^https?://")
    )


#: These begin at the start of a text.
_NOISE = [ci(p) for p in (DATE_ONLY, CONTACT_LABEL, BARE_PHONE, r"^https?://")]
_EMAIL, _PROFILE, _LETTER, _SEPARATED = ci(EMAIL), ci(PROFILE), re.compile("[A-Za-z]"), re.compile(r"[|·•]|\+?\d{6,}")


def is_noise_py(x: str, section: str) -> bool:
    if not x or len(x) < MIN_LENGTH.get(section, 12) or not _LETTER.search(x):
        return True
    return any(p.match(x) for p in _NOISE) or bool("@" in x and _EMAIL.search(x)) or bool(_SEPARATED.search(x) and _PROFILE.search(x))


def informative_terms(x: Column, least: int) -> Column:
    """Distinct words of a requirement of at least ``least`` letters that are not stop words."""
    words = F.split(F.lower(x), r"[^a-z0-9.+#]+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(*STOPWORDS)))


def short_requirement(x: Column) -> Column:
    """A requirement without its lead-in, first letter small, for use inside a sentence."""
    body = F.regexp_replace(x, "(?i)" + REQ_LEAD, "")
    return F.concat(F.lower(F.substring(body, 1, 1)), body.substr(F.lit(2), F.length(body)))


def context_around(text: str, at: int, length: int, pad: int = 45) -> str:
    """A snippet around a phrase, an ellipsis on each cut side, blanks collapsed."""
    if at < 0:
        return ""
    a, b = max(0, at - pad), min(len(text), at + length + pad)
    return ("…" if a else "") + " ".join(text[a:b].split()) + ("…" if b < len(text) else "")
