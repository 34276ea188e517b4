"""Plain-text reports for a terminal. Each shows at most ``limit`` rows: a report is a page, not an export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators.bias import flag_brief


def table(df: DataFrame, columns: list[str], limit: int = 40) -> str:
    """The first rows in aligned columns."""
    rows = [[("" if v is None else str(v)) for v in r] for r in df.select(*columns).limit(limit).collect()]
    widths = [max(len(c), *(len(r[k]) for r in rows)) if rows else len(c) for k, c in enumerate(columns)]
    line = lambda cells: "  ".join(x.ljust(w) for x, w in zip(cells, widths)).rstrip()
    return "\n".join([line(columns), line(["-" * w for w in widths]), *map(line, rows)])


def parse_quality(report: DataFrame, limit: int = 40) -> str:
    """Units per section and flags, worst first, with the mean number of units."""
    total = report.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("units"), 1).alias("mean"), F.count_if(F.size("flags") > 0).alias("bad")).first()
    shown = report.orderBy(F.desc(F.size("flags")), "candidate_id").withColumn("flags", F.array_join("flags", ", "))
    names = ["candidate_id", "units", "experience", "projects", "skills", "education", "other", "flags"]
    note = "" if total["mean"] is None or 12 <= total["mean"] <= 70 else "\nThe mean number of units is out of the usual 12 to 70."
    return f"{table(shown, names, limit)}\n{total['n']} documents, {total['mean']} units each, {total['bad']} to look at.{note}"


def ablation(rows: DataFrame, limit: int = 40) -> str:
    """Ranks under each configuration by hybrid rank, with what the hybrid rescued from the literal one."""
    moved = F.when(F.col("literal_to_hybrid") > 0, F.format_string("+%d rescued", "literal_to_hybrid")).otherwise("")
    shown = rows.orderBy("jd_id", "hybrid_rank").withColumn("moved", moved)
    return table(shown, ["candidate_id", "literal_rank", "lexical_rank", "semantic_rank", "hybrid_rank", "moved"], limit)


def explanation(ranked_row: dict) -> str:
    """One row of a ranking page as text."""
    lines = [f"#{ranked_row['rank']}  {ranked_row['name']}  {ranked_row['final_score']}", "", ranked_row.get("summary") or "", "", "  MATCHED"]
    for m in ranked_row.get("matched") or []:
        lines += [f"    {m['requirement_text']}  [{m['kind']}, {m['score']}]", f"      \"{m['evidence_text']}\" - {m['how']}"]
    musts = [m for m in ranked_row.get("missing") or [] if m["kind"] == "MUST"]
    if musts:
        lines.append("  MISSING (required)")
        for m in musts:
            lines.append(f"    {m['requirement_text']}  [{m['score']}]" + (f"  candidate states: \"{m['disclaimed_by']}\"" if m["disclaimed_by"] else ""))
    return "\n".join(lines)


def bias(text: str) -> str:
    flags = flag_brief(text)
    return "\n".join([f"{len(flags)} flag(s)", *[f"  [{f['category']}] {f['phrase']}: {f['note']} ({f['context']})" for f in flags]])


def sweep(rows: DataFrame) -> str:
    """Quality by setting, averaged over briefs."""
    mean = rows.groupBy("setting").agg(*[F.round(F.avg(c), 4).alias(c) for c in ("precision_top", "purity_bottom", "separation")])
    return table(mean.orderBy("setting"), ["setting", "precision_top", "purity_bottom", "separation"])
