"""Counterfactual audit: the same resume with another institution must keep its score.

A score needs the best value of each side only, not the unit that it comes from, so no row per candidate and requirement is
made: a candidate is one row that holds its units under all variants, each once, and every batch of candidates is scored
against the requirements in memory. What is written is those rows and one score a brief, what is shuffled is statistics.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from rankloom.config import Config
from rankloom.functions.numbers import stable_np
from rankloom.functions.text import TOKEN_RE
from rankloom.operators import match
from rankloom.operators.evaluate import NOISE_FLOOR, SWAPS
from rankloom.operators.split import evidence_units, swap_institution
from rankloom.session import discard, materialize, spread

NAMES = ("baseline", *SWAPS)
#: Candidates scored together inside a batch, and given back together.
CANDIDATES, GIVEN = 32, 1_024
#: Places in a unit's record: how often each variant has it, whether it may be matched, tokens, query terms, its vector's counts.
USABLE, LENGTH, TERMS, VECTOR = (len(NAMES) + k for k in range(4))
WIDTH = VECTOR + match.DIMENSIONS


def _records(candidate: str | None, variants: list[list[dict]], index: dict[str, int], field: str) -> tuple[bytes, bytes]:
    """The units of a candidate's variants, equal ones once, and ``(query term, count)`` of each, as runs of 32-bit numbers.

    Disclaimers, and units of a candidate without an id, count in the corpus statistics but are never matched.
    """
    held: dict[tuple, list[int]] = {}
    for v, units in enumerate(variants):
        for u in units:
            normalized = u["normalized"] or u["text"]
            key = (u["scored_text"] or u["text"], (u["expanded"] or normalized) if field == "expanded" else normalized, u["negated"])
            held.setdefault(key, [0] * len(variants))[v] += 1
    records, terms = array("i"), array("i")
    for ((embedded, lexical, negated), times), vector in zip(held.items(), match.hashed_counts([k[0] for k in held])):
        tokens = TOKEN_RE.findall((lexical or "").lower())
        tf: dict[int, int] = {}
        for t in tokens:
            if (k := index.get(t)) is not None:
                tf[k] = tf.get(k, 0) + 1
        records.extend([*times, not negated and candidate is not None, len(tokens), len(tf), *vector])
        terms.extend([x for pair in tf.items() for x in pair])
    return records.tobytes(), terms.tobytes()


def _prepared(candidates: DataFrame, words: list[str], cfg: Config) -> DataFrame:
    """``(candidate_id, swapped, units, terms)``: the units of each candidate's text as it is and under each substitute."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = {w: k for k, w in enumerate(words)}
        for pdf in batches:
            for a in range(0, len(pdf), GIVEN):
                rows = []
                for candidate, text in zip(pdf["id"][a : a + GIVEN], pdf["text"][a : a + GIVEN]):
                    done = [swap_institution(text, x) if text else (text, 0) for x in SWAPS.values()]
                    base = evidence_units(text)
                    variants = [base, *[evidence_units(t) if t != text else base for t, _ in done]]
                    rows.append((candidate, done[0][1] > 0, *_records(candidate, variants, index, cfg.lexical_field)))
                yield pd.DataFrame(rows, columns=["candidate_id", "swapped", "units", "terms"])

    texts = candidates.select(F.col("candidate_id").cast("string").alias("id"), F.col("raw_text").alias("text"))
    return spread(texts).mapInPandas(run, "candidate_id string, swapped boolean, units binary, terms binary")


def _numbers(blobs: pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.int32).reshape(-1, width)


@dataclass
class _Corpus:
    """Per variant the units, their mean token count and the units that hold each query term."""

    n: np.ndarray
    avgdl: np.ndarray
    df: np.ndarray


def _corpus(prepared: DataFrame, n_words: int) -> _Corpus:
    variants = len(NAMES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # the last two places of a variant: its units and their tokens
        counts = np.zeros((variants, n_words + 2), np.int64)
        for pdf in batches:
            for a in range(0, len(pdf), GIVEN):
                units, terms = _numbers(pdf["units"][a : a + GIVEN], WIDTH), _numbers(pdf["terms"][a : a + GIVEN], 2)
                held = np.repeat(units[:, :variants], units[:, TERMS], axis=0)
                for v in range(variants):
                    counts[v, :n_words] += np.bincount(terms[held[:, v] > 0, 0], held[held[:, v] > 0, v], n_words).astype(np.int64)
                    times = units[:, v].astype(np.int64)
                    counts[v, n_words:] += times.sum(), times @ units[:, LENGTH]
        at = np.flatnonzero(counts)
        yield pd.DataFrame({"place": at, "count": counts.ravel()[at]})

    counts = np.zeros(variants * (n_words + 2))
    for r in prepared.mapInPandas(run, "place long, count long").groupBy("place").agg(F.sum("count").alias("n")).collect():
        counts[r["place"]] = r["n"]
    counts = counts.reshape(variants, -1)
    n, tokens = counts[:, n_words], counts[:, n_words + 1]
    avgdl = np.divide(tokens, n, out=np.zeros(variants), where=n > 0)
    return _Corpus(n, np.where(avgdl > 0, avgdl, 1.0), counts[:, :n_words])


def _blocks(asked: list[Row]) -> Iterator[list[tuple[tuple, list[Row]]]]:
    """``((brief, key), requirements)`` in blocks of whole briefs, each of about ``REQUIREMENT_BLOCK`` requirements.

    As in :func:`match.raw_matrix`, a requirement without brief or key is no column, and a key means all requirements of that key.
    """
    by_key: dict = {}
    for r in asked:
        by_key.setdefault(r["req_key"], []).append(r)
    cells = sorted({(r["jd_id"], r["req_key"]) for r in asked if r["jd_id"] is not None and r["req_key"] is not None})
    block: list = []
    for k, cell in enumerate(cells):
        if block and cell[0] != cells[k - 1][0] and len(block) >= match.REQUIREMENT_BLOCK:
            yield block
            block = []
        block.append((cell, by_key[cell[1]]))
    if block:
        yield block


class _Block:
    """The requirements of some briefs as the workers score against them; ``briefs`` are in the order of the scores."""

    def __init__(self, cells: list[tuple[tuple, list[Row]]], index: dict[str, int], corpus: _Corpus, cfg: Config):
        rows = [r for _, rs in cells for r in rs]
        self.cfg, self.corpus, self.columns = cfg, corpus, len(rows)
        self.vectors = match.hashed([r["e"] for r in rows])
        used = sorted({index[w] for r in rows for w in r["q"]})
        self.local = np.full(len(index), len(used))  # the last row of the query matrix is that of all other terms
        self.local[used] = np.arange(len(used))
        self.query = np.zeros((len(used) + 1, len(rows)))
        for j, r in enumerate(rows):
            for w, c in Counter(r["q"]).items():
                self.query[self.local[index[w]], j] = c
        self.idf = np.log((corpus.n[:, None] - corpus.df + 0.5) / (corpus.df + 0.5) + 1)
        sizes = [len(rs) for _, rs in cells]
        self.cell_starts = np.r_[0, np.cumsum(sizes)[:-1]] if max(sizes) > 1 else None
        # as often as a key stands in its brief, so often do its rows count
        self.times = np.array([sum(r["jd_id"] == jd for r in rs) for (jd, _), rs in cells])
        self.weights = self.times * np.array([sum(r["weight"] or 1.0 for r in rs) for _, rs in cells])
        self.musts = self.times * np.array([sum(r["kind"] == "MUST" for r in rs) for _, rs in cells])
        self.briefs = list(dict.fromkeys(jd for (jd, _), _ in cells))
        self.brief_starts = np.array([k for k, (c, _) in enumerate(cells) if not k or c[0] != cells[k - 1][0][0]])

    def best(self, pdf: pd.DataFrame) -> np.ndarray:
        """The best score by (side, variant, candidate, requirement), lexical side first; 0 without a usable unit."""
        variants, c = len(NAMES), self.cfg
        units, terms = _numbers(pdf["units"], WIDTH), _numbers(pdf["terms"], 2)
        owner = np.repeat(np.arange(len(pdf)), [len(x) // (4 * WIDTH) for x in pdf["units"]])
        ends = np.cumsum(units[:, TERMS])
        f, length = terms[:, 1].astype(float), np.repeat(units[:, LENGTH], units[:, TERMS])
        weight = np.stack([self.idf[v][terms[:, 0]] * f * (c.k1 + 1) / (f + c.k1 * (1 - c.b + c.b * length / self.corpus.avgdl[v])) for v in range(variants)])
        places = self.local[terms[:, 0]]
        out = np.full((2, variants, len(pdf), self.columns), -np.inf)
        usable = np.flatnonzero(units[:, USABLE])
        for k in range(0, len(usable), match.UNIT_BLOCK):
            rows = usable[k : k + match.UNIT_BLOCK]
            shared = (units[rows, :variants] > 0).all(axis=1)
            rows, n_shared = np.r_[rows[shared], rows[~shared]], np.count_nonzero(shared)
            semantic = match.unit_rows(units[rows, VECTOR:].astype(float)) @ self.vectors.T
            lexical = np.zeros((variants, len(rows), self.columns))
            for i, (end, n) in enumerate(zip(ends[rows], units[rows, TERMS])):
                if n:
                    lexical[:, i] = weight[:, end - n : end] @ self.query[places[end - n : end]]
            if n_shared:
                own = owner[rows[:n_shared]]
                first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                at = own[first]
                out[0][:, at] = np.maximum(out[0][:, at], np.maximum.reduceat(lexical[:, :n_shared], first, axis=1))
                out[1][:, at] = np.maximum(out[1][:, at], np.maximum.reduceat(semantic[:n_shared], first, axis=0))
            for i in range(n_shared, len(rows)):
                for v in np.flatnonzero(units[rows[i], :variants]):
                    for side, scores in enumerate((lexical[v, i], semantic[i])):
                        kept = out[side, v, owner[rows[i]]]
                        np.maximum(kept, scores, out=kept)
        if self.cell_starts is not None:
            out = np.maximum.reduceat(out, self.cell_starts, axis=-1)
        return stable_np(np.where(np.isneginf(out), 0.0, out))

    def moments(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Per cell of (side, variant, requirement) the candidates of a task, their mean and sum of squared deviations."""
        n, mean, squares = 0, 0.0, 0.0
        for pdf in batches:
            for a in range(0, len(pdf), CANDIDATES):
                x = self.best(pdf[a : a + CANDIDATES])
                more, own = x.shape[2], x.mean(axis=2)
                step = own - mean
                squares = squares + ((x - own[:, :, None]) ** 2).sum(axis=2) + step**2 * (n * more / (n + more))
                mean, n = mean + step * (more / (n + more)), n + more
        if n:
            yield pd.DataFrame({"cell": np.arange(mean.size), "n": n, "mean": mean.ravel(), "squares": squares.ravel()})

    def scores(self, mean: np.ndarray, deviation: np.ndarray):
        """A function from batches of candidates to their gated scores: per variant an array in the order of ``briefs``."""
        c, flat = self.cfg, deviation < 1e-9

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.add.reduceat(self.weights, self.brief_starts)
            for pdf in batches:
                for a in range(0, len(pdf), GIVEN):
                    part, raw = pdf[a : a + GIVEN], []
                    for b in range(0, len(part), CANDIDATES):
                        x = self.best(part[b : b + CANDIDATES])
                        z = stable_np(np.where(flat[:, :, None], 0.0, (x - mean[:, :, None]) / np.where(flat, 1.0, deviation)[:, :, None]))
                        with np.errstate(over="ignore"):
                            fused = stable_np(1.0 / (1 + np.exp(-(c.alpha * z[0] + (1 - c.alpha) * z[1]))))
                        summed = np.add.reduceat(fused * self.weights, self.brief_starts, axis=-1)
                        base = np.divide(summed, total, out=np.zeros_like(summed), where=total != 0)
                        missing = np.add.reduceat((fused < c.gate_threshold) * self.musts, self.brief_starts, axis=-1)
                        raw.append(stable_np(base * np.power(c.gate_penalty, missing)))
                    each = np.concatenate(raw, axis=1)
                    yield pd.DataFrame({"candidate_id": part["candidate_id"].to_numpy(), "swapped": part["swapped"].to_numpy()} | {x: list(each[v]) for v, x in enumerate(NAMES)})

        return run


def _pool_moments(prepared: DataFrame, block: _Block) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample deviation over all candidates by (side, variant, requirement)."""
    shape = (2, len(NAMES), len(block.times))
    parts = materialize(prepared.mapInPandas(block.moments, "cell int, n long, mean double, squares double"))
    total = parts.groupBy("cell").agg(F.sum("n").alias("_n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_mean"))
    apart = F.sum(F.col("squares") + F.col("n") * (F.col("mean") - F.col("_mean")) * (F.col("mean") - F.col("_mean")))
    n, mean, squares = np.zeros(shape), np.zeros(shape), np.zeros(shape)
    for r in parts.join(F.broadcast(total), "cell").groupBy("cell", "_n", "_mean").agg(apart.alias("squares")).collect():
        n.flat[r["cell"]], mean.flat[r["cell"]], squares.flat[r["cell"]] = r["_n"], r["_mean"], r["squares"]
    discard(parts)
    n = n * block.times
    return mean, np.sqrt(np.divide(squares * block.times, n - 1, out=np.zeros(shape), where=n > 1))


def institution_spread(candidates: DataFrame, requirements: DataFrame, cfg: Config) -> DataFrame:
    """Per brief and candidate the score as it is and under each substitute, the spread, and whether it moved beyond the
    noise floor. Each variant is ranked as a pool of its own, corpus statistics included; every row of ``candidates`` is one of the pool.
    ``swapped`` tells whether an institution was found at all: a row without one was not tested.
    """
    spark = candidates.sparkSession
    asked = requirements.select("jd_id", "req_key", "kind", F.col("weight").cast("double").alias("weight"), *match.query_columns()).orderBy("req_key", "e").collect()
    index = {w: k for k, w in enumerate(sorted({w for r in asked for w in r["q"]}))}
    prepared = materialize(_prepared(candidates, list(index), cfg), codec="zstd")
    corpus = _corpus(prepared, len(index))
    jd = requirements.schema["jd_id"].dataType.simpleString()
    scored = spark.createDataFrame([], f"jd_id {jd}, candidate_id string, swapped boolean, {', '.join(f'{x} double' for x in NAMES)}")
    for cells in _blocks(asked):
        block = _Block(cells, index, corpus, cfg)
        arrays = ", ".join(f"{x} array<double>" for x in NAMES)
        raw = materialize(prepared.mapInPandas(block.scores(*_pool_moments(prepared, block)), f"candidate_id string, swapped boolean, {arrays}"), codec="zstd")
        each = raw.select("candidate_id", "swapped", F.posexplode(F.arrays_zip(*NAMES)).alias("_at", "_s")).select("candidate_id", "swapped", "_at", "_s.*")
        briefs = spark.createDataFrame(list(enumerate(block.briefs)), f"_at int, jd_id {jd}")
        spans = each.groupBy("_at").agg(*[x for n in NAMES for x in (F.min(n).alias(f"_lo_{n}"), F.max(n).alias(f"_hi_{n}"))])
        final = [match.scaled(F.col(n), F.col(f"_lo_{n}"), F.col(f"_hi_{n}"), cfg).alias(n) for n in NAMES]
        scored = scored.unionByName(each.join(F.broadcast(spans.join(F.broadcast(briefs), "_at")), "_at").where("candidate_id is not null").select("jd_id", "candidate_id", "swapped", *final))
    discard(prepared)
    spread_of = F.round(F.greatest(*[F.abs(F.col(a) - F.col(b)) for i, a in enumerate(NAMES) for b in NAMES[i + 1 :]]), 6)
    return scored.select("jd_id", "candidate_id", *NAMES, spread_of.alias("spread"), (spread_of > NOISE_FLOOR).alias("moved"), "swapped")


def verdict(spread: DataFrame) -> DataFrame:
    """One row: rows tested and moved, the largest swing, and whether the ranking is blind to the institution."""
    tested = F.count_if("swapped")
    return spread.agg(
        F.count(F.lit(1)).alias("n_rows"), tested.alias("tested"), F.count_if("moved").alias("moved"), F.max("spread").alias("worst"),
        (F.coalesce(F.max("spread"), F.lit(0.0)) <= NOISE_FLOOR).alias("tier_blind"),
    )
