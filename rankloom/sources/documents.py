"""Reading folders of documents: text, XML, DOCX and PDF to one row per file, errors being data."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.aliases import detect_skills
from rankloom.operators.split import extract_name
from rankloom.session import positions

# Formats, XML containers and page furniture that must agree with published behaviour.
FORMATS = ("pdf", "docx", "txt", "xml")
XML_HEADINGS = {
    "summary": "Summary", "education": "Education", "technicalskills": "Skills", "skills": "Skills", "experience": "Experience", "work": "Experience",
    "projects": "Projects", "certifications": "Certifications", "achievements": "Achievements", "activities": "Activities",
}
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))
_FURNITURE = re.compile(r"^\s*(--\s*\d+\s+of\s+\d+\s*--|page\s+\d+(\s+of\s+\d+)?|\d+\s*\|\s*page)\s*$", re.I)
_RUN_TOGETHER = (
    (r"([A-Za-z0-9.)\]])([A-Z][a-z][a-zA-Z&/ ]{0,20}:)", r"\1\n\2"), (r"([a-z]{3,})([A-Z]{2,}[a-zA-Z]*:)", r"\1\n\2"), (r"(\))([A-Z])", r"\1\n\2"),
    (r"([^\n])(•)", r"\1\n\2"), (r"\n{3,}", "\n\n"),
)
#: Briefs lying among the resumes are left out by name.
BRIEF_NAME = r"(?i)sample[_\s-]?jd"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def strip_furniture(text: str) -> str:
    """A text without page numbers and footers."""
    return "\n".join(x for x in text.split("\n") if not _FURNITURE.match(x))


def repair_run_together(text: str) -> str:
    """Line ends put back where a converter lost them."""
    for pattern, to in _RUN_TOGETHER:
        text = re.sub(pattern, to, text)
    return text


def xml_text(raw: str) -> str:
    """A flat walk over the tags: headings for known containers, bullets marked, the name first, attributes ignored."""
    out: list[str] = []
    for m in re.finditer(r"<(/?)([a-zA-Z]+)[^>]*>([^<]*)", raw):
        tag, text = m.group(2).lower(), " ".join(m.group(3).split())
        for entity, plain in _ENTITIES:
            text = text.replace(entity, plain)
        if not m.group(1) and tag in XML_HEADINGS:
            out += ["", XML_HEADINGS[tag]]
        if text and tag == "name":
            out.insert(0, text)
        elif text:
            out.append(f"• {text}" if tag == "bullet" else text)
    return "\n".join(out)


def docx_text(content: bytes) -> str:
    """The paragraphs of a word-processing file, a blank line between them, run-together lines repaired."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))  # noqa: S314
    marks = {f"{_W}t": lambda e: e.text or "", f"{_W}tab": lambda e: "\t", f"{_W}br": lambda e: "\n"}
    paragraphs = ["".join(marks[e.tag](e) for e in p.iter() if e.tag in marks) for p in root.iter(f"{_W}p")]
    return repair_run_together("\n\n".join(paragraphs))


_PDF_STREAM = re.compile(rb"<<(?P<head>(?:[^<>]|<<[^<>]*>>|<[^<>]*>)*)>>\s*stream\r?\n(?P<body>.*?)\r?\n?endstream", re.S)
#: A string, an array of strings, or an operator of a content stream.
_PDF_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|-?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
_PDF_ESCAPE = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b""}
#: A move between strings of an array by more than this (thousandths of the letter size) stands for a blank.
_PDF_GAP = -200


def _pdf_string(token: bytes) -> str:
    if token[:1] == b"<":
        return bytes.fromhex(re.sub(rb"\s", b"", token[1:-1]).decode() + "0" * (len(re.sub(rb"\s", b"", token[1:-1])) % 2)).decode("cp1252", "replace")
    plain = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1] in (b"\n", b"\r\n") else _PDF_ESCAPE.get(m[1], m[1]), token[1:-1], flags=re.S)
    return plain.decode("cp1252", "replace")


def _pdf_page(content: bytes) -> str:
    """The shown strings of a content stream; a move to another line is a line end."""
    out, line, inside, numbers = [], "", False, []
    for t in _PDF_TOKEN.findall(content):
        if t[:1] in b"(<":
            line += _pdf_string(t)
        elif t in (b"[", b"]"):
            inside = t == b"["
        elif re.fullmatch(rb"-?\d*\.?\d+", t):
            numbers.append(float(t))
            if inside and numbers[-1] < _PDF_GAP:
                line += " "
        else:
            down = t in (b"T*", b"'", b'"', b"ET", b"Tm") or (t in (b"Td", b"TD") and len(numbers) >= 2 and numbers[-1] != 0)
            if down and line.strip():
                out.append(line.strip())
            line = "" if down else line + (" " if t in (b"Td", b"TD") and line else "")
            numbers = []
    return "\n".join([*out, line.strip()] if line.strip() else out)


def simple_pdf_text(content: bytes) -> str:
    """The text of a PDF whose streams are plain or deflated and whose fonts have single-byte codes; an error if none is found."""
    pages = []
    for m in _PDF_STREAM.finditer(content):
        body = m["body"]
        if b"/FlateDecode" in m["head"]:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue
        elif b"/Filter" in m["head"]:
            continue
        if re.search(rb"\bBT\b.*?\bE?T[jJ]?\b", body, re.S):
            pages.append(_pdf_page(body))
    if not any(p.strip() for p in pages):
        raise ValueError("no text that can be read in this PDF")
    return "\n".join(pages)


def pdf_text(content: bytes) -> str:
    """The text of a PDF by an installed reader, else by :func:`simple_pdf_text`; page furniture is left out."""
    try:
        from pypdf import PdfReader
    except ImportError:
        return strip_furniture(simple_pdf_text(content))
    return strip_furniture("\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages))


_READERS = {"txt": lambda b: b.decode("utf-8", "replace"), "xml": lambda b: xml_text(b.decode("utf-8", "replace")), "docx": docx_text, "pdf": pdf_text}


def read_any(content: bytes, extension: str) -> tuple[str, bool, str | None, str]:
    """``(text, ok, error, format)`` of one file; never raises."""
    kind = extension.lower().lstrip(".")
    if kind not in _READERS:
        return "", False, f"unsupported extension .{kind}", kind
    try:
        return _READERS[kind](content), True, None, kind
    except Exception as e:  # noqa: BLE001 - errors are data
        return "", False, f"{type(e).__name__}: {e}", kind


def list_files(spark: SparkSession, path: str, formats: tuple[str, ...] = FORMATS) -> DataFrame:
    """``(file_name, path, content)`` of the files of known formats in a folder. Unread content is pruned."""
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_name").alias("file_name"), "path", "content")
    return files.where(F.lower(F.regexp_extract("file_name", r"\.([^.]+)$", 1)).isin(*formats))


def scan(spark: SparkSession, path: str, formats: tuple[str, ...] = FORMATS) -> DataFrame:
    """``(source_file, source_format, text, ok, error)``: one row per file, unreadable ones with ok = false."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(n, *read_any(bytes(c), n.rsplit(".", 1)[-1])) for n, c in zip(pdf["file_name"], pdf["content"])]
            yield pd.DataFrame(rows, columns=["source_file", "text", "ok", "error", "source_format"])

    files = list_files(spark, path, formats).select("file_name", "content")
    return files.mapInPandas(run, "source_file string, text string, ok boolean, error string, source_format string")


def load_candidates(spark: SparkSession, path: str, formats: tuple[str, ...] = FORMATS) -> DataFrame:
    """The candidates of a folder: ids by file name order over all files, name, text, declared skills.

    A file that cannot be read keeps its row, named after the file. Briefs among the files are left out.
    """
    files = scan(spark, path, formats).where(~F.col("source_file").rlike(BRIEF_NAME))
    numbered = positions(files, "source_file", "_k")
    width = F.lit(max(len(str(numbered.count())), 2))
    number = F.col("_k").cast("string")
    padded = F.concat(F.repeat(F.lit("0"), F.greatest(width - F.length(number), F.lit(0))), number)

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            base = pdf["source_file"].str.replace(r"\.[^.]+$", "", regex=True)
            pdf["name"] = [extract_name(t, b) if ok else b for t, b, ok in zip(pdf["raw_text"], base, pdf["ok"])]
            yield pdf[["candidate_id", "name", "source_file", "source_format", "raw_text", "ok", "error"]]

    rows = numbered.select(F.concat(F.lit("cand_"), padded).alias("candidate_id"), "source_file", "source_format", F.col("text").alias("raw_text"), "ok", "error")
    out = rows.mapInPandas(named, "candidate_id string, name string, source_file string, source_format string, raw_text string, ok boolean, error string")
    return out.withColumn("skills_declared", detect_skills(F.col("raw_text")))


def read_briefs(spark: SparkSession, path: str) -> DataFrame:
    """Brief templates from JSON files; files that do not parse or have no id and requirements are left out."""
    schema = "id string, title string, company string, rawText string, requirements array<struct<id:string,text:string,kind:string,category:string,aliases:array<string>,weight:double>>"
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path, multiLine=True).where("requirements is not null and id is not null and trim(id) <> ''")


def read_candidate_fixture(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Candidates and their evidence from nested JSON; missing ``negated`` is false, missing ``scoredText`` the text."""
    unit = "struct<id:string,candidateId:string,section:string,text:string,scoredText:string,normalized:string,expanded:string,negated:boolean>"
    schema = f"id string, name string, sourceFile string, rawText string, skillsDeclared array<string>, _fitLabel string, evidence array<{unit}>"
    raw = spark.read.schema(schema).json(path, multiLine=True)
    candidates = raw.select(F.col("id").alias("candidate_id"), "name", F.col("sourceFile").alias("source_file"), F.col("rawText").alias("raw_text"), F.col("skillsDeclared").alias("skills_declared"), F.col("_fitLabel").alias("fit_label"))
    e = raw.select("id", F.explode("evidence").alias("e"))
    units = e.select(
        F.col("e.id").alias("id"), F.coalesce("e.candidateId", F.col("id")).alias("candidate_id"), "e.section", "e.text", F.coalesce("e.scoredText", "e.text").alias("scored_text"),
        "e.normalized", "e.expanded", F.coalesce("e.negated", F.lit(False)).alias("negated"),
    )
    return candidates, units


def write_candidates(candidates: DataFrame, units: DataFrame, path: str) -> None:
    """Candidates with their units nested, as JSON lines."""
    nested = units.groupBy("candidate_id").agg(F.array_sort(F.collect_list(F.struct("ev_pos", *[c for c in units.columns if c not in ("candidate_id", "ev_pos")]))).alias("evidence"))
    candidates.join(nested, "candidate_id", "left").write.mode("overwrite").json(path)


def write_ablation(rows: DataFrame, path: str, key: str) -> None:
    """An ablation table kept for reuse, partitioned by the key of the brief it was made for; other briefs' tables stay."""
    rows.withColumn("jd_key", F.lit(key)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("jd_key").parquet(path)


def read_ablation(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The kept ablation of a brief; empty if it was made for another."""
    return spark.read.parquet(path).where(F.col("jd_key") == key).drop("jd_key")
