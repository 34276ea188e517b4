"""The command line: ``python -m rankloom COMMAND ...``.

    quality FOLDER                 how well the documents of a folder were parsed
    rank FOLDER BRIEF              the first candidates of a folder for a brief (a text or JSON file), explained
    ablation FOLDER BRIEF          ranks under each configuration
    ask FOLDER BRIEF QUESTION      an answer about that ranking
    tune TABLES [--over gate]      quality by alpha (or gate) over the briefs of a table folder, and the best setting
    validate TABLES [--limit N]    classes of roles by rank over the briefs of a table folder
    bias FILE                      phrases of a brief to look at
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from rankloom.api import Engine
from rankloom.config import ALPHA_SWEEP, GATE_SWEEP, MODES, Config
from rankloom.operators import evaluate, match, split
from rankloom.plans import report
from rankloom.plans.pool import Pool
from rankloom.session import materialize
from rankloom.sources.documents import load_candidates


def _folder(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The candidates of a folder and their units, read once."""
    candidates = materialize(load_candidates(spark, path))
    units = split.split_documents(candidates, "candidate_id", "raw_text").withColumnRenamed("evidence_id", "id")
    return candidates, materialize(match.prepare_units(units))


def _brief(path: str) -> dict | str:
    text = Path(path).read_text(encoding="utf-8")
    return json.loads(text) if path.endswith(".json") else text


def run(spark: SparkSession, args: argparse.Namespace) -> str:
    """The text that a command prints."""
    if args.command == "bias":
        return report.bias(Path(args.path).read_text(encoding="utf-8"))
    if args.command in ("tune", "validate"):
        p = Pool(spark, args.path, limit=args.limit)
        if args.command == "validate":
            rows = evaluate.labelled(p.ranked(), p.candidates)
            shown = evaluate.class_summary(rows).join(evaluate.precision_purity(rows), "jd_id").orderBy("jd_id", "mean_rank")
            return report.table(shown, ["jd_id", "cls", "n", "mean_rank", "mean_score", "in_top", "in_bottom", "precision_top", "purity_bottom", "separation"], args.rows)
        name, values = ("gate_threshold", GATE_SWEEP) if args.over == "gate" else ("alpha", ALPHA_SWEEP)
        swept = materialize(evaluate.sweep(p.raw, p.requirements, p.candidates, Config(), name, values))
        return report.sweep(swept) + "\n\nbest by brief\n" + report.table(evaluate.best_setting(swept).orderBy("jd_id"), ["jd_id", "setting", "precision_top", "separation"], args.rows)
    candidates, units = _folder(spark, args.path)
    if args.command == "quality":
        counted = split.parse_report(candidates, units, "candidate_id", "raw_text", "skills_declared")
        return report.parse_quality(counted, args.rows)
    engine = Engine(spark, candidates, units)
    brief = engine.resolve(_brief(args.brief))
    if args.command == "ablation":
        return report.ablation(engine.ablation(brief), args.rows)
    ranking = engine.rank(brief, mode=args.mode)
    if args.command == "ask":
        return engine.ask(args.question, ranking).text
    return "\n\n".join(report.explanation(c) for c in ranking.page(1, args.rows)["candidates"])


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rankloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = p.add_subparsers(dest="command", required=True)
    for name, more in (("quality", ()), ("rank", ("brief",)), ("ablation", ("brief",)), ("ask", ("brief", "question")), ("tune", ()), ("validate", ()), ("bias", ())):
        c = commands.add_parser(name)
        c.add_argument("path")
        for m in more:
            c.add_argument(m)
        c.add_argument("--rows", type=int, default=20, help="rows to show")
        c.add_argument("--limit", type=int, help="the first so many candidates only")
        c.add_argument("--mode", choices=sorted(MODES), default="hybrid")
        c.add_argument("--over", choices=("alpha", "gate"), default="alpha")
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("rankloom").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    print(run(spark, args))


if __name__ == "__main__":
    main(sys.argv[1:])
