"""The queries of the text and record operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.llm import canonical, distinctive, formatdup, fusion, mixing, neardup, packing, pii, residue
from rankloom.llm.tokens import token_sizes
from rankloom.session import latest, load, materialize

#: The limit of loss-bearing tokens of the packing in which it binds.
LOSS_LIMIT = 1536
#: Other ways to write an at-sign.
_OTHER_AT = r"＠|[(\[{] *at *[)\]}]|\bat\b[^\n]*\bdot\b"
#: Messages that are residue wherever they are a sentence of their own.
_KNOWN = (
    r"(?i)(^|\n|[.!?] )(- )?(404 Not Found|Access denied|Bad gateway|Page not found|Your session has expired|Too many requests|Body copy goes here|Heading goes here|Your text here|"
    r"JavaScript seems to be turned off|If nothing happens, allow scripts for this page|Please enable JavaScript to view this job posting|This site needs scripts to run|Our engineers have been told|"
    r"Seite nicht gefunden|P[áa]gina no encontrada|We are down for planned maintenance|Please go back and try again|Unsupported or damaged file)\.( |\n|$)"
)
RUN_SCORES = ["fused", "final_score", "lexical_total", "semantic_mean", "weight_met"]


def _term_units(spark: SparkSession, d: str) -> DataFrame:
    evidence = latest(load(spark, d, "evidence"), ["id"], ["candidate_id", "expanded"])
    requirements = load(spark, d, "requirements").select("req_key", "jd_id", "text").distinct()
    return evidence.select(
        F.lit("candidate").alias("record_kind"), F.col("candidate_id").alias("record_id"), F.col("expanded").alias("text")
    ).unionByName(
        requirements.select(
            F.lit("jd").alias("record_kind"), F.col("jd_id").alias("record_id"), distinctive.normalise_terms(F.col("text")).alias("text")
        )
    )


def _personal_texts(spark: SparkSession, d: str, once: bool = False) -> DataFrame:
    """The three fields; ``once``: repeated rows of evidence taken out (candidates have none), which shuffles its texts."""
    candidates = load(spark, d, "candidates")
    evidence = load(spark, d, "evidence")
    evidence = latest(evidence, ["id"], ["text"]) if once else evidence
    columns = lambda df, field, text: df.select(F.lit(field).alias("field"), F.col("id").alias("record_id"), F.col(text).alias("text"))
    return (
        columns(candidates, "candidates.raw_text", "raw_text")
        .unionByName(columns(candidates, "candidates.name", "name"))
        .unionByName(columns(evidence, "evidence.text", "text"))
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    given, family, rest = pii.name_lookup(load(spark, d, "candidates"), "name")
    values = pii.personal_values(_personal_texts(spark, d), given, family, rest=rest)
    return values.select("field", "record_id", "pii_type", "start_pos").distinct()


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    """All texts with each personal value replaced by its type."""
    given, family, rest = pii.name_lookup(load(spark, d, "candidates"), "name")
    return pii.redacted(_personal_texts(spark, d, once=True), given, family, rest=rest)


def p1_mails(spark: SparkSession, d: str) -> DataFrame:
    """The e-mails found in texts with one plain at-sign between letters or digits."""
    plain = _personal_texts(spark, d).where(F.col("text").rlike("[A-Za-z0-9]@[A-Za-z0-9]") & (F.length("text") - F.length(F.replace("text", F.lit("@"), F.lit(""))) == 1) & ~F.lower("text").rlike(_OTHER_AT))
    return p1_found(spark, d).where("pii_type = 'EMAIL'").join(plain.select("field", "record_id").distinct(), ["field", "record_id"], "left_semi").select("field", "record_id", "start_pos")


def p2_weights(spark: SparkSession, d: str) -> DataFrame:
    """Every term of every record with its relevance weight, rounded."""
    w = distinctive.term_weights(_term_units(spark, d))
    return w.select("record_kind", "record_id", "term", "tf", "df", "dl", F.round("weight", 6).alias("weight"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    w = distinctive.term_weights(_term_units(spark, d))
    return w.where((F.col("tf") >= 3) & F.col("df").between(2, 6)).select("record_kind", "record_id", "term")


def _run_scores(spark: SparkSession, d: str) -> DataFrame:
    return latest(load(spark, d, "candidate_scores"), ["run_id", "candidate_id"], RUN_SCORES)


def p3_fused(spark: SparkSession, d: str) -> DataFrame:
    """The fused ranking of every run: reciprocal rank sums and positions' mean."""
    r = fusion.fuse_ranks(_run_scores(spark, d), "run_id", "candidate_id", RUN_SCORES)
    return r.select("run_id", "candidate_id", F.round("rrf", 9).alias("rrf"), F.round("mean_place", 6).alias("mean_place"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    r = fusion.fuse_ranks(_run_scores(spark, d), "run_id", "candidate_id", RUN_SCORES)
    return fusion.leaders(r, "run_id", "candidate_id", [F.col("mean_place").asc()], 3).select("run_id", "candidate_id")


def _near(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return neardup.near_duplicates(load(spark, d, "candidates"), "id", "raw_text", width=3, threshold=0.6)


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Similar pairs of classes of equal texts, each named by its smallest id."""
    return _near(spark, d)[0].select("a", "b", F.round("similarity", 9).alias("similarity"))


def p4_members(spark: SparkSession, d: str) -> DataFrame:
    """Every resume with its class, the size of the class and its number of links to other classes."""
    return neardup.linked_members(*_near(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.expand_pairs(*_near(spark, d))


def _copies(spark: SparkSession, d: str) -> DataFrame:
    return formatdup.representatives(load(spark, d, "candidates"), "id", "source_file", "raw_text")


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """One record per group of copies with its number of copies."""
    return formatdup.copy_counts(_copies(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _copies(spark, d).where(F.col("id") != F.col("keep_id")).select("keep_id", F.col("id").alias("copy_id"))


def _typed_values(spark: SparkSession, d: str) -> DataFrame:
    def rows(df: DataFrame, field: str, key: str, array: str) -> DataFrame:
        return df.select(
            F.lit(field).alias("field"), F.col(key).alias("record_id"), F.posexplode(array).alias("_p", "value")
        ).select("field", "record_id", (F.col("_p") + 1).cast("int").alias("value_pos"), "value")

    claims = load(spark, d, "evidence").where(F.col("unit_kind") == "claim")
    every = (
        rows(load(spark, d, "candidates"), "candidates.skills_declared", "id", "skills_declared")
        .unionByName(rows(load(spark, d, "requirements"), "requirements.aliases", "req_key", "aliases"))
        .unionByName(
            latest(claims, ["id"], ["normalized"]).select(
                F.lit("evidence.normalized").alias("field"), F.col("id").alias("record_id"), F.lit(1).alias("value_pos"), F.col("normalized").alias("value")
            )
        )
    )
    return every.where(F.col("value").isNotNull())


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    values = _typed_values(spark, d)
    entries = canonical.map_values(values, load(spark, d, "skill_catalog"), "skill_id", "canonical", "also_known")
    return canonical.mapped_rows(values, entries).select("field", "record_id", "value_pos", F.col("entry").alias("skill_id"))


def p6_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """The values that mean no entry, with the number of their rows."""
    values = _typed_values(spark, d)
    entries = canonical.map_values(values, load(spark, d, "skill_catalog"), "skill_id", "canonical", "also_known")
    none = entries.where("entry = 0").select("value")
    return values.groupBy("value").agg(F.count(F.lit(1)).alias("n_rows")).join(none, "value")


def _doc_sizes(spark: SparkSession, d: str) -> DataFrame:
    return token_sizes(load(spark, d, "documents"), "text", ["doc_id"])


def p8_windows(spark: SparkSession, d: str) -> DataFrame:
    """Every document placed in a window of 2,048 tokens."""
    return packing.pack_documents(_doc_sizes(spark, d), "doc_id")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How many windows are used against the least number that the limits need."""
    return packing.fill_report(p8_windows(spark, d))


def p8_loss_windows(spark: SparkSession, d: str) -> DataFrame:
    """The same under a limit of loss-bearing tokens that binds: at most 1,536 a window."""
    return packing.pack_documents(_doc_sizes(spark, d), "doc_id", loss_limit=LOSS_LIMIT)


def p8_kept(spark: SparkSession, d: str) -> DataFrame:
    """Each document with tokens, and whether it is whole, in order and within all limits in both packings."""
    sized = materialize(_doc_sizes(spark, d))
    one = packing.kept_whole(packing.pack_documents(sized, "doc_id"), sized, "doc_id")
    two = packing.kept_whole(packing.pack_documents(sized, "doc_id", loss_limit=LOSS_LIMIT), sized, "doc_id", loss_limit=LOSS_LIMIT)
    return one.join(two.withColumnRenamed("kept", "kept_too"), "doc_id").select("doc_id", (F.col("kept") & F.col("kept_too")).alias("kept"))


def _mix_sizes(spark: SparkSession, d: str) -> DataFrame:
    sized = token_sizes(load(spark, d, "documents"), "text", ["doc_id", "source", "lang", "doc_type"])
    return sized.select("doc_id", "source", F.lower(F.trim("lang")).alias("lang"), F.col("doc_type").alias("topic"), "tokens")


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mixture with the number of copies of each."""
    return mixing.mix(_mix_sizes(spark, d), load(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of every source."""
    sized = materialize(_mix_sizes(spark, d))
    targets = load(spark, d, "mix_targets")
    return mixing.share_report(sized, targets, mixing.mix(sized, targets))


def p9_kept(spark: SparkSession, d: str) -> DataFrame:
    """Each target source that has documents with tokens: whether no document comes more often than allowed, and whether its share is within a hundredth of its target."""
    r = p9_shares(spark, d).where("target_share > 0 and tokens > 0")
    goal = F.col("target_share") / F.sum("target_share").over(Window.partitionBy())
    capped = F.col("most_copies") <= F.ceil(F.least("max_repeats", F.greatest(F.floor("max_repeats"), F.lit(1))))
    return r.select("source", capped.alias("within_cap"), (F.abs(F.col("actual_share") - goal) < 0.01).alias("on_target"))


def p6_exact(spark: SparkSession, d: str) -> DataFrame:
    """The mapped rows whose value is, letter case aside, a name or other name of the catalogue."""
    c = load(spark, d, "skill_catalog")
    names = c.select(F.explode(F.concat(F.array("canonical"), F.coalesce("also_known", F.array().cast("array<string>")))).alias("n")).select(F.lower(F.trim("n")).alias("n")).distinct()
    plain = _typed_values(spark, d).withColumn("n", F.lower(F.trim("value"))).join(F.broadcast(names), "n", "left_semi").select("field", "record_id", "value_pos")
    return p6_found(spark, d).join(plain, ["field", "record_id", "value_pos"], "left_semi")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_documents(load(spark, d, "documents"), "doc_id", "text", "source", ("doc_type", "lang")).select("doc_id").distinct()


def p10_known(spark: SparkSession, d: str) -> DataFrame:
    """The found documents that have one of a few fixed messages as a sentence of its own."""
    said = load(spark, d, "documents").where(F.col("text").rlike(_KNOWN)).select("doc_id").distinct()
    return p10_found(spark, d).join(said, "doc_id", "left_semi")


def p10_messages(spark: SparkSession, d: str) -> DataFrame:
    """The residue messages of the corpus, with their kind and spread."""
    return residue.residue_messages(load(spark, d, "documents"), "doc_id", "text", "source", ("doc_type", "lang"))


def p10_clean(spark: SparkSession, d: str) -> DataFrame:
    """The corpus without residue documents."""
    return residue.without_residue(load(spark, d, "documents"), "doc_id", "text", "source", ("doc_type", "lang")).select("doc_id", "source", "n_chars")


_P2_UNITS = """
WITH ev AS (SELECT id, any_value(candidate_id) AS candidate_id, any_value(expanded) AS expanded FROM evidence GROUP BY id),
units AS (
  SELECT 'candidate' AS record_kind, candidate_id AS record_id, coalesce(expanded, '') AS text FROM ev
  UNION ALL
  SELECT 'jd', jd_id, regexp_replace(lower(text), '[^a-z0-9.+#/\\s-]', ' ', 'g') FROM (SELECT DISTINCT req_key, jd_id, text FROM requirements)
),
toks AS (SELECT record_kind, record_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS t FROM units WHERE record_id IS NOT NULL),
dl AS (SELECT record_kind, record_id, sum(len(t)) AS dl FROM toks GROUP BY ALL),
st AS (SELECT record_kind, count(*) AS n, avg(dl) AS avgdl FROM dl GROUP BY ALL),
tf AS (SELECT record_kind, record_id, term, count(*) AS tf FROM (SELECT record_kind, record_id, unnest(t) AS term FROM toks) GROUP BY ALL),
df AS (SELECT record_kind, term, count(*) AS df FROM tf GROUP BY ALL)
"""
_P3_PLACES = """
WITH cs AS (
  SELECT run_id, candidate_id, any_value(fused) AS fused, any_value(final_score) AS final_score,
         any_value(lexical_total) AS lexical_total, any_value(semantic_mean) AS semantic_mean, any_value(weight_met) AS weight_met
  FROM candidate_scores GROUP BY run_id, candidate_id),
long AS (
  SELECT run_id, candidate_id, 'a' AS s, fused AS v FROM cs UNION ALL SELECT run_id, candidate_id, 'b', final_score FROM cs
  UNION ALL SELECT run_id, candidate_id, 'c', lexical_total FROM cs UNION ALL SELECT run_id, candidate_id, 'd', semantic_mean FROM cs
  UNION ALL SELECT run_id, candidate_id, 'e', weight_met FROM cs),
pl AS (
  SELECT run_id, candidate_id, rank() OVER (PARTITION BY run_id, s ORDER BY v DESC NULLS LAST)
         + (count(*) OVER (PARTITION BY run_id, s, v) - 1) / 2.0 AS place FROM long),
m AS (SELECT run_id, candidate_id, sum(1.0 / (60 + place)) AS rrf, avg(place) AS mean_place FROM pl GROUP BY ALL)
"""
_WORDS = "list_filter(regexp_split_to_array(lower(raw_text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
_P4_CLASSES = f"""
WITH w AS (SELECT id, {_WORDS} AS w FROM candidates WHERE raw_text IS NOT NULL),
s AS (SELECT id, list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS s FROM w WHERE len(w) >= 20),
m AS (SELECT id, s, min(id) OVER (PARTITION BY s) AS r, count(*) OVER (PARTITION BY s) AS copies FROM s),
e AS (SELECT id, len(s) AS n, unnest(s) AS h FROM m WHERE id = r),
p AS (SELECT a.id AS ra, b.id AS rb, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM e a JOIN e b ON a.h = b.h AND a.id < b.id GROUP BY a.id, b.id),
o AS (SELECT * FROM p WHERE c / (na + nb - c) >= 0.6)
"""
_VALUES = """
WITH v AS (
  SELECT 'candidates.skills_declared' AS field, id AS record_id, CAST(generate_subscripts(skills_declared, 1) AS INTEGER) AS value_pos, unnest(skills_declared) AS value FROM candidates
  UNION ALL SELECT 'requirements.aliases', req_key, CAST(generate_subscripts(aliases, 1) AS INTEGER), unnest(aliases) FROM requirements
  UNION ALL SELECT 'evidence.normalized', id, 1, any_value(normalized) FROM evidence WHERE unit_kind = 'claim' GROUP BY id),
n AS (SELECT DISTINCT skill_id, lower(trim(unnest(list_concat([canonical], coalesce(also_known, []))))) AS n FROM skill_catalog)
"""
_P5_KEYS = f"""
WITH c AS (
  SELECT id, regexp_replace(lower(coalesce(source_file, '')), '[^\\p{{L}}\\p{{N}}]+', '', 'g') || chr(10) ||
    array_to_string(list_sort(list_filter(list_transform(string_split(raw_text, chr(10)),
      lambda x: regexp_replace(lower(x), '[^\\p{{L}}\\p{{N}}]+', '', 'g')), lambda x: x <> '')), chr(10)) AS k
  FROM candidates WHERE raw_text IS NOT NULL AND len({_WORDS}) >= 20),
g AS (SELECT id, min(id) OVER (PARTITION BY k) AS keep_id, count(*) OVER (PARTITION BY k) AS copies FROM c)
"""

SQL: dict[str, str] = {
    "p1_mails": f"""
WITH t AS (
  SELECT 'candidates.raw_text' AS field, id AS record_id, raw_text AS text FROM candidates UNION SELECT 'candidates.name', id, name FROM candidates UNION SELECT 'evidence.text', id, text FROM evidence),
m AS (SELECT *, regexp_extract(text, '[\\p{{L}}\\p{{N}}_][\\p{{L}}\\p{{N}}_.+%-]*@[A-Za-z0-9][A-Za-z0-9_-]*([.][A-Za-z][A-Za-z0-9_-]*)+') AS mail FROM t
      WHERE regexp_matches(text, '[A-Za-z0-9]@[A-Za-z0-9]') AND len(text) - len(replace(text, '@', '')) = 1 AND NOT regexp_matches(lower(text), '{_OTHER_AT}'))
SELECT field, record_id, CAST(strpos(text, mail) AS INTEGER) AS start_pos FROM m WHERE mail <> ''""",
    "p10_known": f"SELECT DISTINCT doc_id FROM documents WHERE regexp_matches(text, '{_KNOWN}')",
    "p2_weights": _P2_UNITS
    + """SELECT record_kind, record_id, term, tf, df, CAST(dl AS BIGINT) AS dl,
    round(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)), 6) AS weight
    FROM tf JOIN df USING (record_kind, term) JOIN dl USING (record_kind, record_id) JOIN st USING (record_kind)""",
    "p2_found": _P2_UNITS
    + "SELECT record_kind, record_id, term FROM tf JOIN df USING (record_kind, term) WHERE tf >= 3 AND df BETWEEN 2 AND 6",
    "p3_fused": _P3_PLACES + "SELECT run_id, candidate_id, round(rrf, 9) AS rrf, round(mean_place, 6) AS mean_place FROM m",
    "p3_found": _P3_PLACES
    + """SELECT run_id, candidate_id FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY mean_place, candidate_id) AS p FROM m)
    WHERE p <= 3""",
    "p4_found": f"""
WITH w AS (SELECT id, {_WORDS} AS w FROM candidates WHERE raw_text IS NOT NULL),
s AS (SELECT id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s
      FROM w WHERE len(w) >= 20),
e AS (SELECT id, len(s) AS n, unnest(s) AS h FROM s),
o AS (SELECT a.id AS cand_a, b.id AS cand_b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
      FROM e a JOIN e b ON a.h = b.h AND a.id < b.id GROUP BY a.id, b.id)
SELECT cand_a, cand_b FROM o WHERE c / (na + nb - c) >= 0.6""",
    "p4_pairs": _P4_CLASSES + "SELECT ra AS a, rb AS b, round(c / (na + nb - c), 9) AS similarity FROM o",
    "p4_members": _P4_CLASSES
    + """, k AS (SELECT r, count(*) AS links FROM (SELECT ra AS r FROM o UNION ALL SELECT rb FROM o) GROUP BY r)
SELECT id, r AS rep, copies, coalesce(links, 0) AS links FROM m LEFT JOIN k USING (r)""",
    "p6_exact": _VALUES
    + """SELECT field, record_id, value_pos, min(skill_id) AS skill_id FROM v JOIN n ON n.n = lower(trim(value, ' ')) GROUP BY ALL""",
    "p8_kept": "SELECT doc_id, true AS kept FROM documents WHERE text IS NOT NULL AND text <> ''",
    "p9_kept": """SELECT source, true AS within_cap, true AS on_target FROM mix_targets
    WHERE target_share > 0 AND max_repeats > 0 AND source IN (SELECT source FROM documents WHERE text IS NOT NULL AND text <> '')""",
    "p5_groups": _P5_KEYS
    + """SELECT keep_id, copies FROM g WHERE id = keep_id
    UNION ALL SELECT id, 1 FROM candidates WHERE id NOT IN (SELECT id FROM c)""",
    "p5_found": _P5_KEYS + "SELECT keep_id, id AS copy_id FROM g WHERE id <> keep_id",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_mails, p1_redacted, p6_found, p6_exact, p6_unmatched, p8_windows, p8_fill, p8_loss_windows, p8_kept, p9_mixture, p9_shares, p9_kept, p10_found, p10_known, p10_messages, p10_clean, p2_found, p2_weights, p3_found, p3_fused, p4_found, p4_pairs, p4_members, p5_found, p5_groups)
}
