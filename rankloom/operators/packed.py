"""Several values packed in one field: a parsing expression grammar over label lines.

Grammar (ordered choice, the first alternative that parses wins)::

    line    <- blank* (label mark)? item (delim item)* blank* end
    mark    <- blank* (':' / '–' / '—' / '-' !letter) / blank+ '-'
    item    <- quoted / bare / empty
    quoted  <- '"' ('""' / !'"' .)* '"' &stop / '“' (!'”' .)* '”' &stop / "'" (!("'" stop) .)* "'" &stop
    bare    <- (bracket / !delim .)+
    bracket <- '(' (bracket / !')' .)* ')'
    delim   <- [,;|•·，；、\\t] / blank{3,} / blank+ [/&–—-] blank+
    stop    <- blank* (delim / end)

A quote that never closes before a ``stop`` makes ``quoted`` fail; the parser backtracks and reads the
mark as an ordinary letter of a bare value, which is then flagged ``bad_quote``. A bracket without its
partner is likewise an ordinary letter, flagged ``bad_bracket``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that make the text before a colon or dash a skills, tools or languages label, in English, German, Spanish and French; a label
#: in other words can be named by the caller. Words of a compound language count by their ending.
LABEL_WORDS = (
    "skill", "skills", "skillset", "skillsets", "tool", "tools", "toolset", "toolbox", "language", "languages", "platforms", "software", "technologies", "technology",
    "tech", "competencies", "competences", "competency", "proficiencies", "proficiency", "proficient", "expertise", "stack", "frameworks", "libraries", "programming", "know-how", "abilities", "capabilities",
    "qualifikationen", "sprachen", "werkzeuge", "technologien", "programme", "habilidades", "competencias", "destrezas", "aptitudes", "idiomas", "lenguajes", "herramientas", "tecnologías", "conocimientos",
    "compétences", "savoir-faire", "aptitudes", "langues", "langages", "outils", "logiciels", "connaissances",
)
LABEL_ENDINGS = ("kenntnisse", "fähigkeiten", "kompetenzen", "sprachen", "werkzeuge")
#: A label is the text of at most this many letters before the first mark, with at most four words before its label word and three after.
LABEL_LENGTH = 120
_BEFORE, _AFTER = 4, 3


def _label_patterns(letter: str) -> tuple[str, str, str]:
    """Patterns of a line's head, of joining words in it, and of a label once those are blanks; bounded, so that no line is read twice."""
    head = rf"^(?:[-*>•·][  \t]{{0,20}})?([^:–—\n]{{1,{LABEL_LENGTH}}}?)(?::|–|—|(?<=[  \t])-|-(?!{letter}))"
    word = rf"(?:{letter}|['’.()+-])+"
    named = "|".join(sorted({re.escape(w).replace(r"\-", "-") for w in LABEL_WORDS}, key=len, reverse=True))
    return head, r"[&/,  \t]+(?:(?:and|und|et|y)[  \t]+)?", rf"^ ?(?:{word} ){{0,{_BEFORE}}}(?:{letter}{{1,20}}-)?(?:{named}|(?:{letter})*(?:{'|'.join(LABEL_ENDINGS)}))(?: {word}){{0,{_AFTER}}} ?$"


_JAVA_HEAD, _JAVA_JOIN, _JAVA_LABEL = _label_patterns(r"\p{L}")
_HEAD, _JOIN, _LABEL = map(re.compile, _label_patterns(r"[^\W\d_]"))
#: The first letters of all label words: tried first, as they are found or ruled out fast; a line without any of them has no label.
_STEMS = "|".join(sorted({w[:4] for w in LABEL_WORDS}))
_STEM = rf"(?:^|[^\p{{L}}])(?:{_STEMS})|{'|'.join(LABEL_ENDINGS)}"
_LEADING = "  \t\r"
_ANY_LABEL = re.compile(r"^[  \t\r]*[^\W\d_][\w&/  ]{0,40}?[  \t]*(?::|–|—|-(?=[  \t]))")
_DELIM = re.compile(r"[,;|•·，；、\t]|[  ]{3,}|[  ]+[/&–—-][  ]+")
_STOP = re.compile(r"[  \r]*(?:[,;|•·，；、\t]|$)|[  ]{3,}|[  ]+[/&–—-][  ]+")
_PLAIN = re.compile(r"[^,;|•·，；、\t(\"“'  ]+")
_QUOTES = {'"': '"', "“": "”", "'": "'", "‘": "’", "«": "»"}
_TRIM = "  \t\r\n﻿"


def _quoted(text: str, at: int) -> tuple[str, int] | None:
    """Parse a quoted value at ``at``; None if no closing mark stands before a stop."""
    close = _QUOTES[text[at]]
    k = at + 1
    while True:
        k = text.find(close, k)
        if k < 0:
            return None
        if close == text[at] and text[k + 1 : k + 2] == close:
            k += 2
            continue
        if _STOP.match(text, k + 1):
            value = text[at + 1 : k]
            return (value.replace(close * 2, close) if close == text[at] else value), k + 1
        k += 1


def _bracket(text: str, at: int) -> int:
    """The position after the bracket that opens at ``at``, or -1."""
    depth = 0
    for k in range(at, len(text)):
        if text[k] == "(":
            depth += 1
        elif text[k] == ")":
            depth -= 1
            if not depth:
                return k + 1
    return -1


def label_end(text: str) -> int:
    """Where the values of a line start: after its skills, tools or languages label, else after any short label; 0 without one."""
    blank = len(text) - len(text.lstrip(_LEADING))
    if (m := _HEAD.match(text[blank : blank + LABEL_LENGTH + 40])) and _LABEL.match(_JOIN.sub(" ", m.group(1).lower())):
        return blank + m.end()
    m = _ANY_LABEL.match(text)
    return m.end() if m else 0


def is_label_line(line: Column) -> Column:
    """Whether a line starts with a skills, tools or languages label and a mark."""
    start = F.substring(F.regexp_replace(line, rf"^[{_LEADING}]+", ""), 1, LABEL_LENGTH + 40)
    head = F.lower(F.regexp_extract(start, _JAVA_HEAD, 1))
    return F.lower(start).rlike(_STEM) & F.regexp_replace(head, _JAVA_JOIN, " ").rlike(_JAVA_LABEL)


def parse_values(text: str | None, label: bool = True) -> list[tuple[int, str, str]]:
    """``(position, value, flag)`` of each value of a line; flag is ``""``, ``bad_quote`` or ``bad_bracket``.

    None, an empty line and a line of delimiters only give no value. With ``label`` a leading label is skipped.
    """
    if not text:
        return []
    at = 0
    if label:
        at = label_end(text)
    out: list[tuple[int, str, str]] = []
    n = len(text)
    unclosed = False  # a bracket without a partner: none after it closes either
    while at <= n:
        while at < n and text[at] in _TRIM and not _DELIM.match(text, at):
            at += 1
        value, flag, start = None, "", at
        if at < n and text[at] in _QUOTES:
            if got := _quoted(text, at):
                value, at = got
            else:
                flag = "bad_quote"
        if value is None:
            while at < n:
                if m := _PLAIN.match(text, at):
                    at = m.end()
                elif text[at] == "(" and not unclosed:
                    end = _bracket(text, at)
                    if end > 0:
                        at = end
                    else:
                        unclosed, flag, at = True, flag or "bad_bracket", at + 1
                elif _DELIM.match(text, at):
                    break
                else:
                    at += 1
            value = text[start:at]
        value = value.strip(_TRIM)
        if value:
            out.append((len(out) + 1, value, flag))
        m = _STOP.match(text, at) if at < n else None
        if at >= n:
            break
        d = _DELIM.match(text, at)
        at = d.end() if d else (m.end() if m else at + 1)
    return out


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [
            (f, r, n, p, v, e)
            for f, r, n, t in zip(pdf["field"], pdf["record_id"], pdf["line_no"], pdf["line"])
            for p, v, e in parse_values(t)
        ]
        yield pd.DataFrame(rows, columns=["field", "record_id", "line_no", "item_pos", "item", "flag"])


def unpack_values(lines: DataFrame) -> DataFrame:
    """``lines(field, record_id, line_no, line)`` to one row per value, with position and error flag.

    A narrow transformation: no shuffle, Arrow batches in and out. Null or empty lines give no row; other columns
    are ignored; repeated input rows give repeated output rows.
    """
    schema = "field string, record_id string, line_no int, item_pos int, item string, flag string"
    return lines.select("field", "record_id", "line_no", "line").mapInPandas(_parse_batches, schema)


def label_lines(df: DataFrame, id_col: str, text_col: str, field: str) -> DataFrame:
    """The lines of a text that start with a skills, tools or languages label, numbered from 1.

    Splitting and filtering stay in the JVM, so only label lines reach Python.
    """
    lines = df.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("record_id"), F.posexplode(F.split(text_col, "\n", -1)).alias("_p", "line")
    )
    return lines.where(is_label_line(F.col("line"))).select(
        F.lit(field).alias("field"), "record_id", (F.col("_p") + 1).cast("int").alias("line_no"), "line"
    )
