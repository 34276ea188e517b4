"""Free-typed values mapped to a reference list: token repair by edit distance, then soft TF-IDF over whole entries."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.aliases import edit_distance
from rankloom.session import bounded_broadcast, materialize

#: Words and numbers that tell level, years or version and not which entry is meant.
_LEVEL = (
    r"(?:^|(?<=[\s(,-]))(?:(?:good |basic |some |solid |strong )?(?:working )?knowledge of|(?:certified|experienced|proficient|fluent|skilled|expert) in|experience (?:with|in)|familiar with|"
    r"(?:gute |sehr gute )?(?:grund)?kenntnisse in|erfahrung (?:mit|in)|(?:buenos )?conocimientos? de|experiencia (?:con|en)|(?:bonnes )?connaissances? (?:de|en)|maîtrise de|exp[ée]rience (?:en|avec)|"
    r"grundkenntnisse|fortgeschritten|anfänger|sehr gut|b[áa]sico|intermedio|avanzado|experto|d[ée]butant|interm[ée]diaire|avanc[ée]|confirm[ée]|courant|"
    r"basics? of|basic|basics|beginner|elementary|intermediate|advanced|adv\.?|expert|proficient|certified|senior|junior|v(?:er(?:sion)?)?\.? ?\d+(?:\.\d+)*|"
    r"\d+(?:\.\d+)? ?\+? ?(?:years?|yrs?|y|jahre?n?|años?|ans?)\.?(?: (?:of )?experience)?|\d+(?:\.\d+)+|\d+\+?)(?=$|[\s),;-])"
)
#: Edits allowed in a token: none up to EXACT_LENGTH letters alone in a value, one below LONG_LENGTH, else two.
EXACT_LENGTH = 3
LONG_LENGTH = 6
#: All tokens of a value together may differ by at most this many edits.
MAX_EDITS = 2
#: The least cover of a match: the cosine of value and entry over inverse-frequency weights of repaired tokens. A word that only one of them has is missing
#: from it, one that no entry has at the greatest weight.
LEAST_COVER = 0.9


def value_key(value: Column) -> Column:
    """A value without case, level, years, version, punctuation and word separators; tokens parted by one blank."""
    v = F.regexp_replace(F.lower(value), r"[_\s\x{00a0}]+", " ")
    v = F.regexp_replace(F.trim(v), _LEVEL, " ")
    v = F.regexp_replace(F.trim(F.regexp_replace(v, r"\s+", " ")), _LEVEL, " ")  # a level before a number
    v = F.regexp_replace(v, r"[^\p{L}\p{N}+#]+", " ")
    return F.trim(v)


def allowed(token: str) -> int:
    return 0 if len(token) < 3 else 1 if len(token) < LONG_LENGTH else 2


def deletions(token: str, depth: int) -> set[str]:
    """The token with up to ``depth`` letters left out: tokens within ``depth`` edits share one of these."""
    out = {token}
    for k in range(1, min(depth, len(token) - 1) + 1):
        out |= {"".join(c) for c in combinations(token, len(token) - k)}
    return out


def _neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(t, d) for t in pdf["token"] for d in deletions(t, MAX_EDITS if len(t) >= LONG_LENGTH - 1 else 1)]
        yield pd.DataFrame(rows, columns=["token", "part"])


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for t, w in zip(pdf["token"], pdf["word"]):
            most = min(allowed(t) if len(t) >= LONG_LENGTH else max(allowed(t), min(allowed(w), 1)), MAX_EDITS)
            d = edit_distance(t, w, most)
            if d <= most:
                rows.append((t, w, d))
        yield pd.DataFrame(rows, columns=["token", "word", "edits"])


def repairs(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(token, word, edits)``: every vocabulary word within the edits allowed for a token.

    ``tokens(token)`` and ``vocabulary(word)`` are distinct. An equi-join on deletion neighbourhoods, so neither
    side is broadcast by hint and none is compared with all of the other.
    """
    # a token longer than every word by more than the edits allowed is near none of them: it is left out before its letters are
    longest = vocabulary.agg(F.coalesce(F.max(F.length("word")), F.lit(0)).alias("_l"))
    tokens = tokens.crossJoin(F.broadcast(longest)).where(F.length("token") <= F.col("_l") + MAX_EDITS).select("token")
    # words need one deletion more than short tokens allow, so that a lengthened token still meets them
    words = vocabulary.select(F.col("word").alias("token"))
    parts = tokens.mapInPandas(_neighbours, "token string, part string")
    of_words = words.mapInPandas(_neighbours, "token string, part string").select(F.col("token").alias("word"), "part")
    pairs = parts.join(of_words, "part").select("token", "word").distinct()
    return pairs.mapInPandas(_verify, "token string, word string, edits int")


def _entries(reference: DataFrame, id_col: str, name_col: str, also_col: str) -> DataFrame:
    """The spellings of each entry: ``(entry, variant, word, n)``, a word per row; also each spelling run together."""
    names = reference.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("int").alias("entry"),
        F.explode(F.array_distinct(F.concat(F.array(F.col(name_col)), F.coalesce(F.col(also_col), F.array().cast("array<string>"))))).alias("name"),
    )
    keyed = names.select("entry", F.trim(F.regexp_replace(F.lower("name"), r"[^\p{L}\p{N}+#]+", " ")).alias("key")).where("key <> ''").distinct()
    split = F.array_distinct(F.split("key", " "))
    apart = keyed.select("entry", F.col("key").alias("variant"), F.size(split).alias("n"), F.explode(split).alias("word"))
    glued = keyed.where(F.col("key").contains(" ")).select(
        "entry", F.concat(F.lit("="), F.col("key")).alias("variant"), F.lit(1).alias("n"), F.replace("key", F.lit(" "), F.lit("")).alias("word")
    )
    return apart.unionByName(glued)


def map_values(values: DataFrame, reference: DataFrame, id_col: str, name_col: str, also_col: str) -> DataFrame:
    """The reference entry of each distinct value: ``(value, entry, score, edits)``; entry 0 if it means none.

    ``values(value)`` may repeat; null and blank values have no row. An entry is meant if the words of the value, repaired,
    cover its words and are covered by them to LEAST_COVER, in any order, all edits together being at most MAX_EDITS;
    run-together spellings are matched alike. Among such entries the greatest soft TF-IDF wins, then the fewest edits, then the
    smallest id. An empty reference maps everything to 0. A value of any length is read; a word longer than all words of
    the reference matches none.

    Plan: values are reduced to distinct ones before anything else (partial aggregation, so a value that a third of all
    rows have costs nothing), and these are kept, as several steps read them; distinct tokens meet the vocabulary by an equi-join;
    no side is collected.
    """
    keys = values.where(F.trim(F.regexp_replace("value", r"[\s\x{00a0}]+", " ")) != "").select("value").distinct()
    keys = materialize(keys.withColumn("key", value_key(F.col("value"))))
    distinct = keys.select("key").where("key <> ''").distinct()
    split = F.array_distinct(F.split("key", " "))
    apart = distinct.select("key", F.lit("apart").alias("form"), F.explode(split).alias("token"))
    glued = distinct.where(F.col("key").contains(" ")).select("key", F.lit("glued").alias("form"), F.replace("key", F.lit(" "), F.lit("")).alias("token"))
    tokens = materialize(apart.unionByName(glued))
    entries = materialize(_entries(reference, id_col, name_col, also_col))
    total = entries.agg(F.count_distinct("entry", "variant").alias("total"))
    weights = entries.groupBy("word").agg(F.count(F.lit(1)).alias("_df")).crossJoin(F.broadcast(total)).select("word", F.log(1 + F.col("total") / F.col("_df")).alias("idf"))
    size = entries.join(weights, "word").groupBy("entry", "variant").agg(F.sum(F.col("idf") * F.col("idf")).alias("esize"))
    words = entries.select("entry", "variant", "word").join(weights, "word").join(size, ["entry", "variant"])
    fixed = materialize(repairs(tokens.select("token").distinct(), weights.select("word")))
    # a token's weight is that of the nearest word it can be; without one, that of a word of one entry only
    near = fixed.join(weights, "word").groupBy("token").agg(F.min(F.struct("edits", "idf")).alias("n")).select("token", F.col("n.idf").alias("tidf"))
    weighed = tokens.join(near, "token", "left").crossJoin(F.broadcast(total)).select("key", "form", "token", F.coalesce("tidf", F.log(1 + F.col("total"))).alias("tidf"))
    sizes = weighed.groupBy("key", "form").agg(F.sum(F.col("tidf") * F.col("tidf")).alias("vsize"), F.count(F.lit(1)).alias("m"))
    met = tokens.join(fixed, "token").join(words, "word").groupBy("key", "form", "entry", "variant", "esize", "token").agg(F.min(F.struct("edits", "word", "idf")).alias("b"))
    longer = F.greatest(F.length("token"), F.length("b.word"))
    square = F.col("b.idf") * F.col("b.idf")
    paired = met.groupBy("key", "form", "entry", "variant", "esize").agg(
        F.sum("b.edits").alias("edits"), F.sum(square).alias("both"), F.sum(square * (1 - F.col("b.edits") / longer)).alias("soft"), F.count(F.lit(1)).alias("met"),
        F.count_distinct("b.word").alias("words"), F.max(F.when(F.length("token") <= EXACT_LENGTH, F.col("b.edits"))).alias("short"),
    )
    root = F.sqrt(F.col("esize") * F.col("vsize"))
    alone = (F.col("m") == 1) & (F.coalesce("short", F.lit(0)) > 0)  # a short value of one word must be met exactly
    scored = paired.join(sizes, ["key", "form"]).where((F.col("edits") <= MAX_EDITS) & ~alone & (F.col("words") == F.col("met")) & (F.col("both") / root >= LEAST_COVER - 1e-9))
    best = scored.groupBy("key").agg(F.max(F.struct((F.col("soft") / root).alias("score"), (-F.col("edits")).alias("e"), (-F.col("entry")).alias("i"))).alias("b"))
    best = best.select("key", (-F.col("b.i")).alias("entry"), F.col("b.score").alias("score"), (-F.col("b.e")).alias("edits"))
    return keys.join(best, "key", "left").select("value", F.coalesce("entry", F.lit(0)).cast("int").alias("entry"), "score", F.col("edits").cast("int").alias("edits"))


def mapped_rows(values: DataFrame, entries: DataFrame) -> DataFrame:
    """``values`` with the ``entry`` of each row's value. Joined by two hashes of the value, so that what is broadcast, if the
    distinct values are few, is numbers of a known size, and a value of a third of all rows is no hot key; else by the value."""
    kept = materialize(entries.select("value", "entry"))
    h = lambda c: (F.xxhash64(c).alias("_h"), F.xxhash64(F.reverse(c), F.lit(1)).alias("_g"))
    small = bounded_broadcast(kept.select(*h(F.col("value")), "entry"))
    return values.select("*", *h(F.col("value"))).join(small, ["_h", "_g"]).drop("_h", "_g")
