"""Near-duplicate records: exact set-similarity join by rarest elements, parity sketches and verification, in passes.

Records are sets of shingle hashes. For two sets of sizes n and s with Jaccard similarity of at least t, the shared part
is at least o = t / (1 + t) * (n + s). All elements have one order, rarest first. Of two such sets the first c shared elements
have places of at most n - o + c - 1 in the one and s - o + c - 1 in the other, so each set is keyed by its leading elements only, and two
sets that meet in fewer than c of them, or at later places, are no candidate. The order needs no exact frequencies: it is drawn from
counters by hash, of bounded number, and any order gives the same pairs. The symmetric difference is at most n + s - 2 * o; a sketch
that has the parity of the elements of each of its cells differs in at most so many cells, which is seen where two keys
meet, before a candidate is written. Candidates are verified on whole sets, so no pair is lost and none is wrong.

What lies on disk at a time is small beside the texts: words are kept as hashes (a column of few different values) and sets are made of
them when needed, and keys are joined, and candidates verified, in passes whose shuffle files end with the pass.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.session import bounded_broadcast, discard, materialize

#: A pair must meet in keys of this total weight to be a candidate. Chance matches come singly; similar pairs match in many keys.
LEAST_WEIGHT = 4
#: In sets whose partners may have at most this many shingles, a single key is enough.
SHORT = 40
#: Elements worked on together in a task.
BLOCK_ELEMENTS = 200_000
#: Counters of the elements' frequencies, and the parts in which tasks add them up.
COUNTERS, PARTS = 1 << 22, 64
#: 64-bit words of a sketch.
SKETCH = 6
#: Passes at most, and the keys or candidates from which on there is one more.
PASSES, KEYS_A_PASS, PAIRS_A_PASS = 8, 100_000, 1_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(df: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """``(id, w)`` of each record with at least ``least`` words; ``w`` has the hash of each word, as they follow."""
    words = F.filter(F.split(F.lower(F.col(text_col)), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    w = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), words.alias("w"))
    return w.where(F.size("w") >= least).select("id", F.transform("w", lambda x: F.xxhash64(x)).alias("w"))


def shingle_set(w: Column, width: int) -> Column:
    """The set of shingle hashes of a column of word hashes."""
    hs = F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(width)]))
    return F.array_distinct(hs)


# Bands and segments belong to the former universe partition; the join doesn't use them, a test does.


def band_ratio(t: float) -> float:
    """The sizes of a band differ by at most this factor, so that a set has partners in two bands or three."""
    return max(1.25, 1 / t)


def band_of(size, t: float):
    """The band of a size, or of an array of sizes."""
    return np.floor(np.log(np.maximum(size, 1)) / math.log(band_ratio(t)) + 1e-9).astype(np.int64)


def band_limit(band: int, t: float) -> int:
    """The greatest size of a band."""
    hi = math.floor(band_ratio(t) ** (band + 1)) + 2
    while band_of(hi, t) > band:
        hi -= 1
    return hi


def _budget(n, s, t: float):
    """Greatest symmetric difference of sets of sizes n and s with similarity t."""
    return np.floor((1 - t) / (1 + t) * (n + s) + 1e-9).astype(np.int64)


def segments_of(band: int, t: float) -> int:
    """How many segments a band's universe has: more than the greatest budget, by band and threshold only."""
    hi = band_limit(band, t)
    return 9 * int(_budget(hi, math.ceil(hi / t), t)) // 8 + 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _blocks(batches: Iterator[pd.DataFrame], column: str) -> Iterator[pd.DataFrame]:
    """The rows of batches, so many at a time that their arrays have about BLOCK_ELEMENTS elements."""
    for pdf in batches:
        block = (pdf[column].map(len).cumsum() // BLOCK_ELEMENTS).to_numpy()
        for at in np.split(np.arange(len(pdf)), np.flatnonzero(np.diff(block)) + 1):
            if len(at):
                yield pdf.iloc[at]


def _shingles(w: pd.Series, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Record and hash of the different shingles of arrays of word hashes, by record and hash, and their number in each record."""
    size = w.map(len).to_numpy(dtype=np.int64)
    words = np.concatenate([np.asarray(x, dtype=np.int64) for x in w]).view(np.uint64)
    runs = size - (width - 1)
    rec = np.repeat(np.arange(len(size)), runs)
    at = np.arange(len(rec)) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(np.cumsum(size) - size, runs)
    h = words[at]
    for k in range(1, width):
        h = _mix(h * _MIX + words[at + k])
    order = np.lexsort((h, rec))
    rec, h = rec[order], h[order]
    new = np.r_[True, (rec[1:] != rec[:-1]) | (h[1:] != h[:-1])]
    rec, h = rec[new], h[new]
    return rec, h, np.bincount(rec, minlength=len(size))


def _digests(width: int):
    """Rows (id, n, x, y, w): the size of the shingle set and two hashes of it, which don't depend on an order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _blocks(batches, "w"):
            _, h, n = _shingles(pdf["w"], width)
            start = np.cumsum(n) - n
            sums = [np.add.reduceat(_mix(h * _MIX + np.uint64(k)), start).view(np.int64) for k in (1, 2)]
            yield pd.DataFrame({"id": pdf["id"].to_numpy(), "n": n.astype(np.int32), "x": sums[0], "y": sums[1], "w": pdf["w"].to_numpy()})

    return run


def _counters(sets: DataFrame, width: int) -> np.ndarray:
    """How often elements come whose hash ends in the same bits: 0 for once or never, else 16 times the binary logarithm, 255 at most."""
    per = COUNTERS // PARTS

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = np.zeros(COUNTERS, dtype=np.int64)
        for pdf in _blocks(batches, "w"):
            np.add.at(c, (_shingles(pdf["w"], width)[1] % np.uint64(COUNTERS)).astype(np.int64), 1)
        own = [k for k in range(PARTS) if c[k * per : (k + 1) * per].any()]
        yield pd.DataFrame({"part": own, "c": [zlib.compress(c[k * per : (k + 1) * per].tobytes(), 1) for k in own]}).astype({"part": "int32"})

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        c = np.zeros(per, dtype=np.int64)
        for x in pdf["c"]:
            c += np.frombuffer(zlib.decompress(x), dtype=np.int64)
        q = np.minimum(255, np.round(16 * np.log2(np.maximum(c, 1)))).astype(np.uint8)
        return pd.DataFrame({"part": pdf["part"].to_numpy()[:1], "c": [q.tobytes()]})

    out = np.zeros(COUNTERS, dtype=np.uint8)
    for x in sets.select("w").mapInPandas(tally, "part int, c binary").groupBy("part").applyInPandas(total, "part int, c binary").collect():
        out[x["part"] * per : (x["part"] + 1) * per] = np.frombuffer(x["c"], dtype=np.uint8)
    return out


def _ranked(width: int, counters):
    """Rows (id, n, hs, df) of (id, w): the set without the elements that no other set has, and the counter of each element."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _blocks(batches, "w"):
            rec, h, n = _shingles(pdf["w"], width)
            d = counters.value[(h % np.uint64(COUNTERS)).astype(np.int64)].astype(np.int64)
            rec, h, d = rec[d > 0], h[d > 0].view(np.int64), d[d > 0]
            cuts = np.searchsorted(rec, np.arange(1, len(n)))
            yield pd.DataFrame({"id": pdf["id"].to_numpy(), "n": n, "hs": np.split(h, cuts), "df": np.split(d, cuts)}, index=range(len(n)))

    return run


def _flat(pdf: pd.DataFrame):
    n = pdf["n"].to_numpy(dtype=np.int64)
    size = pdf["hs"].map(len).to_numpy(dtype=np.int64)
    h = np.concatenate([np.asarray(x, dtype=np.int64) for x in pdf["hs"]])
    d = np.concatenate([np.asarray(x, dtype=np.int64) for x in pdf["df"]])
    return n, size, np.repeat(np.arange(len(n)), size), h, d


def _shared(total, t: float):
    """Least number of elements that two sets of so many elements together and similarity t share."""
    return np.ceil(t / (1 + t) * total - 1e-9).astype(np.int64)


def _sketches(n_rec: int, rec: np.ndarray, h: np.ndarray, words: int) -> np.ndarray:
    """The parity of the elements in each of 64 * words cells, a row of words for each set."""
    cell = (_mix(h.view(np.uint64) * _MIX) % np.uint64(64 * words)).astype(np.int64)
    odd = np.bincount(rec * 64 * words + cell, minlength=n_rec * 64 * words) & 1
    return np.packbits(odd.reshape(n_rec, 64 * words).astype(np.uint8), axis=1).view(np.int64)


def _emit(t: float, words: int):
    """Rows (key, id, n, m, r, s0...) of sets (id, n, hs, df): the leading elements of each set, rarest first.

    m is the number of elements that no other set has, which come before all others and are no keys, r the place of the
    key among all elements. The sketch, of so many words, covers the elements of ``hs``. A set that has no partner has no row.
    """

    def some(pdf: pd.DataFrame) -> pd.DataFrame:
        n, size, rec, h, d = _flat(pdf)
        lone = n - size
        order = np.lexsort((h, d, rec))
        rec, h = rec[order], h[order]
        rank = np.arange(len(rec)) - (np.cumsum(size) - size)[rec] + lone[rec]
        least = np.ceil(t * n - 1e-9).astype(np.int64)
        # as the greater set of a pair, and as the smaller one of a pair that must meet in several keys
        last = n - least + np.where(least > SHORT, LEAST_WEIGHT - 1, 0)
        last = np.where(n > SHORT, np.maximum(last, n - _shared(2 * n, t) + LEAST_WEIGHT - 1), last)
        keep = (rank <= last[rec]) & (size >= least)[rec]
        at = rec[keep]
        rows = {"key": h[keep], "id": pdf["id"].to_numpy()[at], "n": n[at].astype(np.int32), "m": lone[at].astype(np.int32), "r": rank[keep].astype(np.int32)}
        if words:
            sketch = _sketches(len(n), rec, h, words)[at]
            rows |= {f"s{k}": sketch[:, k] for k in range(words)}
        return pd.DataFrame(rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _blocks(batches, "hs"):
            yield some(pdf)

    return run


def _passes(rows: int, each: int) -> int:
    return min(PASSES, 1 + rows // each)


def representatives(words: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """``(number, id, n, w)`` of one record per distinct shingle set (the smallest id), n being its size, and the membership ``(id, rep)``.

    Sets are told apart by two 64-bit hashes and their size; only digests and ids are shuffled.
    """
    kind, digest = words.schema["id"].dataType.simpleString(), ["n", "x", "y"]
    marked = materialize(words.mapInPandas(_digests(width), f"id {kind}, n int, x bigint, y bigint, w array<bigint>"), tidy=True)
    shared = materialize(marked.groupBy(*digest).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies"), tidy=True)
    alone = marked.join(bounded_broadcast(shared), digest, "left")
    members = materialize(alone.select("id", F.coalesce("rep", F.col("id")).alias("rep")).distinct(), tidy=True)
    chosen = alone.where(F.col("rep").isNull() | (F.col("id") == F.col("rep"))).select("id", "n", "w", F.col("rep").isNotNull().alias("_r"))
    once = chosen.where("not _r").drop("_r").unionByName(chosen.where("_r").drop("_r").dropDuplicates(["id"]))
    reps = materialize(once.select(F.monotonically_increasing_id().alias("number"), "id", "n", "w"), tidy=True)
    discard(marked)
    discard(shared)
    return reps, members


def _candidates(sets: DataFrame, width: int, t: float) -> DataFrame:
    """Pairs ``(p, s)`` of sets that meet in enough keys; p is the greater one. No partner or candidate is capped."""
    counters = sets.sparkSession.sparkContext.broadcast(_counters(sets, width))
    ranked, emit = _ranked(width, counters), _emit(t, SKETCH)
    kind = sets.schema["id"].dataType.simpleString()
    schema = f"key bigint, id {kind}, n int, m int, r int, " + ", ".join(f"s{k} bigint" for k in range(SKETCH))
    keys = materialize(sets.select("id", "w").mapInPandas(lambda x: emit(ranked(x)), schema), tidy=True)
    p, s = (lambda c: F.col(f"p.{c}")), (lambda c: F.col(f"s.{c}"))
    total = p("n") + s("n")
    share = F.ceil(total * F.lit(t / (1 + t)) - 1e-9)
    single = (F.ceil(p("n") * F.lit(t) - 1e-9) <= SHORT) | (share < LEAST_WEIGHT)
    weight = F.when(single, LEAST_WEIGHT).otherwise(1)
    more = F.when(single, 0).otherwise(LEAST_WEIGHT - 1)
    differ = reduce(lambda a, b: a + b, [F.bit_count(p(f"s{k}").bitwiseXOR(s(f"s{k}"))) for k in range(SKETCH)])
    # every condition is on both sides at once, so that one shuffle serves both
    meet = (
        (p("key") == s("key"))
        & ((s("n") < p("n")) | ((s("n") == p("n")) & (s("id") < p("id"))))
        & (s("n") >= F.ceil(p("n") * F.lit(t) - 1e-9))
        & (s("r") <= s("n") - share + more)
        & (p("r") <= p("n") - share + more)
        & (differ <= total - 2 * share - p("m") - s("m"))
    )
    passes, found = _passes(keys.count(), KEYS_A_PASS), []
    for k in range(passes):
        own = keys.where(F.pmod("key", F.lit(passes)) == k)
        met = own.alias("p").join(own.alias("s"), meet).select(p("id").alias("p"), s("id").alias("s"), weight.alias("w"))
        found.append(materialize(met.groupBy("p", "s").agg(F.sum("w").alias("w")), tidy=True))
    discard(keys)
    every = reduce(DataFrame.unionByName, found).groupBy("p", "s").agg(F.sum("w").alias("w")).where(F.col("w") >= LEAST_WEIGHT)
    out = materialize(every.select("p", "s"), tidy=True)
    for x in found:
        discard(x)
    counters.unpersist()
    return out


def similar_sets(sets: DataFrame, width: int, t: float) -> DataFrame:
    """All pairs of distinct sets ``(a, b, similarity)`` with a Jaccard similarity of at least ``t``.

    ``sets(id, n, w)`` has the sizes of the sets and the word hashes they are made of, unique ids and no two equal sets. Empty input
    gives an empty result.
    """
    found = _candidates(sets, width, t)
    passes, out = _passes(found.count(), PAIRS_A_PASS), []
    for k in range(passes):
        # only the sets of candidates are shuffled to be compared, in the form of their words
        own = found.where(F.pmod(F.xxhash64("p"), F.lit(passes)) == k)
        ids = materialize(own.select(F.explode(F.array("p", "s")).alias("id")).distinct(), tidy=True)
        wanted = sets.join(bounded_broadcast(ids), "id")
        left = wanted.select(F.col("id").alias("p"), F.col("n").alias("pn"), F.col("w").alias("pw"))
        right = wanted.select(F.col("id").alias("s"), F.col("n").alias("sn"), F.col("w").alias("sw"))
        shared = F.size(F.array_intersect(shingle_set(F.col("pw"), width), shingle_set(F.col("sw"), width)))
        both = own.join(left, "p").join(right, "s").select("p", "s", "pn", "sn", shared.alias("_o"))
        sim = F.col("_o") / (F.col("pn") + F.col("sn") - F.col("_o"))
        pairs = both.select(F.least("p", "s").alias("a"), F.greatest("p", "s").alias("b"), sim.alias("similarity"))
        out.append(materialize(pairs.where(F.col("similarity") >= t), tidy=True))
        discard(ids)
    discard(found)
    return reduce(DataFrame.unionByName, out)


def near_duplicates(
    df: DataFrame, id_col: str, text_col: str, width: int = 5, threshold: float = 0.8, min_words: int = 20
) -> tuple[DataFrame, DataFrame]:
    """Pairs of representatives ``(a, b, similarity)``, a < b, and the membership ``(id, rep)``.

    Records with equal shingle sets share a representative; every pair of different sets that is similar enough is
    in the pairs. Records with null text, null id or fewer than ``min_words`` words are in neither result. Repeated
    rows count once. Other columns are ignored.
    """
    reps, members = representatives(word_hashes(df, id_col, text_col, max(min_words, width)), width)
    pairs = similar_sets(reps.select(F.col("number").alias("id"), "n", "w"), width, threshold)
    names = reps.select("number", "id")
    named = pairs.join(names.select(F.col("number").alias("a"), F.col("id").alias("x")), "a").join(names.select(F.col("number").alias("b"), F.col("id").alias("y")), "b")
    named = materialize(named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity"), tidy=True)
    discard(reps)
    return named, members


def expand_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs of records ``(cand_a, cand_b)``, cand_a < cand_b: across similar sets and within equal ones."""
    a = members.select(F.col("id").alias("x"), F.col("rep").alias("a"))
    b = members.select(F.col("id").alias("y"), F.col("rep").alias("b"))
    across = pairs.select("a", "b").join(a, "a").join(b, "b").select("x", "y")
    within = a.join(b, a["a"] == b["b"]).where("x < y").select("x", "y")
    both = across.unionByName(within)
    return both.select(F.least("x", "y").alias("cand_a"), F.greatest("x", "y").alias("cand_b"))


def linked_members(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """One row per record: ``(id, rep, copies, links)``, its class, the records of that class, and the similar other classes."""
    copies = members.groupBy("rep").agg(F.count(F.lit(1)).alias("copies"))
    links = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    return members.join(copies, "rep").join(links, "rep", "left").select("id", "rep", "copies", F.coalesce("links", F.lit(0)).alias("links"))
