"""Questions about a ranking, answered from its rows only: compare, why not, who has, search."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.numbers import stable
from rankloom.functions.text import normalize_py
from rankloom.operators import match

# Question forms and limits that must agree with published behaviour for equal routing.
_COMPARE = (
    re.compile(r"why\s+(?:is|was)\s+(.+?)\s+(?:ranked\s+)?(?:above|higher than|better than|over|ahead of|before)\s+(.+?)[?.!]*$", re.I),
    re.compile(r"compare\s+(.+?)\s+(?:and|with|to|vs\.?)\s+(.+?)[?.!]*$", re.I),
)
_WHY_NOT = re.compile(r"why\s+(?:isn'?t|is\s+not|aren'?t)\s+(.+?)\s+(?:in\s+the\s+top|ranked|higher|#?\d)", re.I)
_WHO = re.compile(
    r"^(?:who|which candidates?)\s+(?:(?:knows?|has|have|had|used?|worked\s+with|is\s+familiar\s+with|familiar\s+with|mentions?|tried|done)\s+)+(.+?)[?.!]*$", re.I
)
LEAST_GAP, SHOWN_GAPS, SHOWN_HITS, SHOWN_PICKS, LEAST_COSINE = 0.02, 3, 6, 5, 0.25


@dataclass(frozen=True)
class Answer:
    text: str
    cited: list[str] = field(default_factory=list)
    intent: str = ""


@dataclass(frozen=True)
class Shortlist:
    """One brief's ranking: ``ranked``, ``cells``, ``units`` and ``requirements`` of that brief."""

    ranked: DataFrame
    cells: DataFrame
    units: DataFrame
    requirements: DataFrame

    def find(self, fragment: str):
        """The candidate a loosely typed name means: the name itself, else the best-ranked that holds it or whose first name it holds."""
        f = re.sub(r"[?.!,]+$", "", fragment.lower().strip())
        low = F.lower("name")
        near = low.contains(f) | F.instr(F.lit(f), F.split(low, " ")[0]).cast("boolean")
        rows = self.ranked.where(near).withColumn("_same", low == f).orderBy(F.desc("_same"), "rank").limit(1).collect()
        return rows[0] if rows and f else None

    def gaps(self, above: str, below: str) -> DataFrame:
        """Requirements by how far ``above`` leads ``below``, greatest first."""
        text = self.units.select("evidence_id", F.col("text").alias("quote"))
        own = lambda who, p: self.cells.where(F.col("candidate_id") == who).join(text, "evidence_id", "left").select(
            "req_key", F.col("fused").alias(f"{p}_fused"), F.col("quote").alias(f"{p}_quote"), F.col("satisfied").alias(f"{p}_satisfied")
        )
        req = self.requirements.select("req_key", "req_pos", F.col("text").alias("requirement"))
        both = own(above, "a").join(own(below, "b"), "req_key", "left").join(req, "req_key")
        return both.withColumn("gap", stable(F.col("a_fused") - F.coalesce("b_fused", F.lit(0.0)))).orderBy(F.desc("gap"), "req_pos")

    def missing_of(self, row) -> list[str]:
        names = {r["req_key"]: r["text"] for r in self.requirements.select("req_key", "text").collect()}
        return [names.get(k, k) for k in row["missing_must_haves"]]

    def compare(self, first: str, second: str) -> Answer:
        a, b = self.find(first), self.find(second)
        if not a or not b:
            return Answer(f'"{second if a else first}" is not in this shortlist.', intent="compare")
        if a["candidate_id"] == b["candidate_id"]:
            return Answer(f"Both names mean {a['name']}, ranked #{a['rank']}.", [a["candidate_id"]], "compare")
        hi, lo = sorted((a, b), key=lambda r: r["rank"])
        rows = self.gaps(hi["candidate_id"], lo["candidate_id"]).where(F.col("gap") > LEAST_GAP).limit(SHOWN_GAPS).collect()
        lines = [f"{hi['name']} is ranked #{hi['rank']} ({hi['final_score']}), {lo['name']} #{lo['rank']} ({lo['final_score']}). Requirements that make the gap: {len(rows)}."]
        for r in rows:
            lines.append(f"- {r['requirement']}")
            if r["a_quote"]:
                lines.append(f'    {hi["name"]}: "{r["a_quote"]}"')
            if not r["b_satisfied"]:
                lines.append(f"    {lo['name']}: no supporting evidence found")
            elif r["b_quote"]:
                lines.append(f'    {lo["name"]}: "{r["b_quote"]}"')
        if lacking := self.missing_of(lo):
            lines.append(f"{lo['name']} also misses {len(lacking)} must-have(s): {'; '.join(lacking)}.")
        return Answer("\n".join(lines), [hi["candidate_id"], lo["candidate_id"]], "compare")

    def why_not(self, name: str) -> Answer:
        c = self.find(name)
        if not c:
            return Answer(f'"{name}" is not in this shortlist.', intent="whyNot")
        top = self.ranked.where("rank = 1").first()
        lines = [f"{c['name']} is ranked #{c['rank']} of {self.ranked.count()} with a score of {c['final_score']}."]
        if lacking := self.missing_of(c):
            lines.append(f"Missing must-haves: {'; '.join(lacking)}.")
        lines.append(f"Greatest gaps to #1 ({top['name']}):")
        for r in self.gaps(top["candidate_id"], c["candidate_id"]).limit(SHOWN_GAPS).collect():
            lines.append(f"- {r['requirement']}: {r['b_fused'] or 0:.2f} against {r['a_fused']:.2f}" + (f', best evidence "{r["b_quote"]}"' if r["b_quote"] else ""))
        return Answer("\n".join(lines), [c["candidate_id"], top["candidate_id"]], "whyNot")

    def who_has(self, skill: str) -> Answer:
        needle = re.sub(r"[?.!]", "", normalize_py(skill)).strip()
        if not needle:
            return Answer("Which skill is meant?", intent="whoHas")
        named = self.units.join(self.ranked.select("candidate_id", "name", "rank"), "candidate_id")
        first = F.min_by(F.struct("text", "name", "rank"), F.struct("ev_pos", "evidence_id")).alias("b")
        def firsts(mentions: DataFrame) -> tuple[int, list]:
            """How many candidates mention it, and the first of them by rank: no more than are shown reach the driver."""
            by = mentions.groupBy("candidate_id").agg(first).persist()
            n, shown = by.count(), by.orderBy("b.rank").limit(SHOWN_HITS).collect()
            by.unpersist()
            return n, shown

        n, hits = firsts(named.where(~F.col("negated") & F.col("expanded").contains(needle)))
        if n:
            lines = [f'{n} candidate(s) mention "{skill.strip()}":'] + [f'- #{h["b"]["rank"]} {h["b"]["name"]}: "{h["b"]["text"]}"' for h in hits]
            if n > len(hits):
                lines.append(f"... and {n - len(hits)} more.")
            return Answer("\n".join(lines), [h["candidate_id"] for h in hits], "whoHas")
        n, said = firsts(named.where(F.col("negated") & F.lower("text").contains(needle)))
        lines = [f'No candidate in this shortlist mentions "{skill.strip()}".'] + [f'{h["b"]["name"]} says: "{h["b"]["text"]}"' for h in said]
        if n > len(said):
            lines.append(f"... and {n - len(said)} more say so.")
        return Answer("\n".join(lines), intent="whoHas")

    def search(self, question: str, embed: match.Embedder = match.hashed) -> Answer:
        """The nearest units to the question, the best of each candidate; nothing if even the best is far."""
        q = embed([question])[0]

        def score(batches):
            for pdf in batches:
                yield pdf[["candidate_id", "ev_pos", "text"]].assign(score=embed(list(pdf["text"])) @ q)

        units = self.units.where(~F.col("negated")).select("candidate_id", "ev_pos", "text")
        scored = units.mapInPandas(score, "candidate_id string, ev_pos int, text string, score double")
        best = scored.groupBy("candidate_id").agg(F.max(F.struct(stable(F.col("score")).alias("s"), (-F.col("ev_pos")).alias("p"), "text")).alias("b"))
        picks = best.join(self.ranked.select("candidate_id", "name", "rank"), "candidate_id").orderBy(F.desc("b.s"), "rank").limit(SHOWN_PICKS).collect()
        if not picks or picks[0]["b"]["s"] < LEAST_COSINE:
            return Answer("Nothing in these resumes closely matches that; name a skill, or compare two candidates.", intent="search")
        lines = ["Closest matches:"] + [f'- #{p["rank"]} {p["name"]}: "{p["b"]["text"]}"' for p in picks]
        return Answer("\n".join(lines), [p["candidate_id"] for p in picks], "search")

    def ask(self, question: str | None) -> Answer:
        """Route a question: compare, then why not, then who has, then search."""
        q = (question or "").strip()
        if not q:
            return Answer("Ask something about this shortlist.")
        for form in _COMPARE:
            if m := form.search(q):
                return self.compare(m.group(1), m.group(2))
        if m := _WHY_NOT.search(q):
            return self.why_not(m.group(1))
        if m := _WHO.search(q):
            return self.who_has(m.group(1))
        return self.search(q)
