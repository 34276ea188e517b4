"""SQL that says the same as the queries, for a second engine to check them."""

from __future__ import annotations

from rankloom.config import ALPHA_SWEEP, GATE_SWEEP
from rankloom.functions import text as T
from rankloom.functions.aliases import reverse
from rankloom.operators.bias import RULES, SENIORITY, YEARS
from rankloom.operators.evaluate import ROLE_CLASS


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _like(x: str, *patterns: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, {_q(p)})" for p in patterns) + ")"


TOK = f"regexp_extract_all(lower(coalesce({{0}}, '')), '{T.TOKEN}')"
NORM = r"trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9.+#/\s-]', ' ', 'g'), '\s+', ' ', 'g'))"
NEG = _like("lower(trim(coalesce({0}, '')))", *T.NEGATIONS)

UNITS = f"""
ev AS (SELECT id, any_value(candidate_id) AS candidate_id, any_value(section) AS section, any_value(text) AS text, any_value(normalized) AS normalized,
              any_value(expanded) AS expanded, any_value(negated) AS negated FROM evidence GROUP BY id),
u AS (SELECT id AS evidence_id, coalesce(candidate_id, split_part(id, '::', 1)) AS candidate_id, coalesce(TRY_CAST(regexp_extract(id, '(\\d+)$', 1) AS INTEGER), 0) AS ev_pos,
             section, text, coalesce(nullif(normalized, ''), nullif(text, '')) AS normalized,
             coalesce(nullif(expanded, ''), nullif(normalized, ''), nullif(text, '')) AS expanded, coalesce(negated, {NEG.replace("{0}", "text")}) AS negated FROM ev)"""
REQS = """
r AS (SELECT jd_id, req_key, coalesce(TRY_CAST(regexp_extract(id, '(\\d+)$', 1) AS INTEGER), 0) AS req_pos, text, kind, aliases, weight FROM requirements),
c AS (SELECT id AS candidate_id, name, source_file, raw_text, skills_declared FROM candidates)"""


def _lexical(name: str, field: str) -> str:
    """Best unit per requirement and candidate by term relevance, as CTE ``name(req_key, candidate_id, b)``."""
    return f"""
{name}_t AS (SELECT evidence_id, candidate_id, ev_pos, negated, {TOK.format(field)} AS t FROM u),
{name}_s AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM {name}_t),
{name}_f AS (SELECT evidence_id, any_value(dl) AS dl, term, count(*) AS tf FROM (SELECT evidence_id, len(t) AS dl, unnest(t) AS term FROM {name}_t) GROUP BY evidence_id, term),
{name}_d AS (SELECT term, count(*) AS df FROM {name}_f GROUP BY term),
{name}_q AS (SELECT req_key, term, count(*) AS m FROM (SELECT req_key, unnest(list_concat({TOK.format("text")},
   flatten(list_transform(coalesce(aliases, []), lambda a: {TOK.format("a")})))) AS term FROM r) GROUP BY req_key, term),
{name}_w AS (SELECT f.evidence_id, q.req_key, sum(q.m * (ln((s.n - d.df + 0.5) / (d.df + 0.5) + 1) * f.tf * 2.5 / (f.tf + 1.5 * (0.25 + 0.75 * f.dl / s.avgdl)))) AS score
   FROM {name}_f f JOIN {name}_q q USING (term) JOIN {name}_d d USING (term), {name}_s s GROUP BY f.evidence_id, q.req_key),
{name} AS (SELECT r.req_key, t.candidate_id, max({{'score': round(coalesce(w.score, 0.0), 9), 'pos': -t.ev_pos, 'id': t.evidence_id}}) AS b
   FROM {name}_t t CROSS JOIN r LEFT JOIN {name}_w w ON w.evidence_id = t.evidence_id AND w.req_key = r.req_key WHERE NOT t.negated GROUP BY r.req_key, t.candidate_id)"""


def _features(source: str, key: str, text: str) -> str:
    return f"""SELECT {key}, (16 * (strpos('0123456789abcdef', h[1]) - 1) + strpos('0123456789abcdef', h[2]) - 1) % 64 AS dim, sum(CASE WHEN h[3] < '8' THEN 1 ELSE -1 END) AS v
 FROM (SELECT {key}, md5(unnest(list_concat(t, list_transform(list_filter(t, lambda x: len(x) > 4), lambda x: x[1:4] || '*')))) AS h FROM (SELECT {key}, {TOK.format(text)} AS t FROM {source})) GROUP BY ALL"""


SEMANTIC = f"""
su AS ({_features("(SELECT * FROM u WHERE NOT negated)", "evidence_id", "text")}),
sn AS (SELECT evidence_id, sqrt(sum(v * v)) AS norm FROM su GROUP BY evidence_id),
sr AS ({_features("(SELECT req_key, text || ' | ' || array_to_string(list_filter(coalesce(aliases, []), lambda x: x IS NOT NULL), ' ') AS e FROM r)", "req_key", "e")}),
srn AS (SELECT req_key, sqrt(sum(v * v)) AS norm FROM sr GROUP BY req_key),
sd AS (SELECT su.evidence_id, sr.req_key, sum(su.v * sr.v) AS dot FROM su JOIN sr USING (dim) GROUP BY ALL),
sem AS (SELECT r.req_key, u.candidate_id, max({{'score': round(coalesce(CASE WHEN sn.norm > 0 AND srn.norm > 0 THEN sd.dot / (sn.norm * srn.norm) END, 0.0), 9), 'pos': -u.ev_pos, 'id': u.evidence_id}}) AS b
   FROM u CROSS JOIN r LEFT JOIN sd ON sd.evidence_id = u.evidence_id AND sd.req_key = r.req_key LEFT JOIN sn ON sn.evidence_id = u.evidence_id LEFT JOIN srn ON srn.req_key = r.req_key
   WHERE NOT u.negated GROUP BY r.req_key, u.candidate_id)"""


def _raw(field: str = "expanded") -> str:
    return f"""
raw AS (SELECT r.jd_id, r.req_key, c.candidate_id, coalesce(l.b.score, 0.0) AS lexical_raw, l.b.id AS lid, coalesce(s.b.score, 0.0) AS semantic_raw, s.b.id AS sid
   FROM c CROSS JOIN r LEFT JOIN lex_{field} l USING (req_key, candidate_id) LEFT JOIN sem s USING (req_key, candidate_id))"""


BASE = UNITS + "," + REQS + "," + _lexical("lex_expanded", "expanded") + "," + SEMANTIC + "," + _raw()


def _cells(alpha: str = "0.5", raw: str = "raw", out: str = "cells", extra: str = "") -> str:
    """Normalised and fused cells. ``extra`` is a leading key column list, each ending in a comma."""
    keys = f"{extra}req_key"
    return f"""
{out}_p AS (SELECT {keys}, avg(lexical_raw) AS lm, stddev_samp(lexical_raw) AS ls, avg(semantic_raw) AS sm, stddev_samp(semantic_raw) AS ss FROM {raw} GROUP BY ALL),
{out}_z AS (SELECT {raw}.*, round(CASE WHEN coalesce(ls, 0.0) < 1e-9 THEN 0.0 ELSE (lexical_raw - lm) / ls END, 9) AS lexical_norm,
   round(CASE WHEN coalesce(ss, 0.0) < 1e-9 THEN 0.0 ELSE (semantic_raw - sm) / ss END, 9) AS semantic_norm, {alpha} AS alpha FROM {raw} JOIN {out}_p USING ({keys})),
{out} AS (SELECT *, fused >= 0.5 AS satisfied, CASE WHEN lexical_norm > 0 AND semantic_norm > 0 THEN 'both' WHEN semantic_norm > 0 THEN 'semantic' WHEN lexical_norm > 0 THEN 'lexical' ELSE 'none' END AS matched_by,
   CASE WHEN alpha >= 0.999 THEN lid WHEN alpha <= 0.001 THEN sid WHEN semantic_norm >= lexical_norm THEN sid ELSE lid END AS evidence_id
   FROM (SELECT *, round(1.0 / (1 + exp(-(alpha * lexical_norm + (1 - alpha) * semantic_norm))), 9) AS fused FROM {out}_z))"""


def _ranked(cells: str = "cells", out: str = "ranked", extra: str = "", gate: str = "0.45") -> str:
    keys = f"{extra}jd_id"
    return f"""
{out}_c AS (SELECT {", ".join(f"x.{k.strip()}" for k in extra.split(",") if k.strip())}{"," if extra else ""} x.jd_id, x.candidate_id,
   round(coalesce(sum(fused * w) / sum(w), 0.0), 9) AS base, list(r2.req_key ORDER BY r2.req_pos) FILTER (WHERE kind = 'MUST' AND fused < {gate}) AS missing,
   count(*) FILTER (WHERE satisfied) AS requirements_met, count(*) AS requirements_total, count(*) FILTER (WHERE kind = 'MUST') AS musts_total, sum(fused * w) / sum(w) AS b0
   FROM {cells} x JOIN (SELECT *, CASE WHEN weight IS NULL OR weight = 0 THEN 1.0 ELSE weight END AS w FROM r) r2 ON r2.req_key = x.req_key GROUP BY ALL),
{out}_s AS (SELECT *, round(pow(0.75, coalesce(len(missing), 0)), 9) AS gate_penalty, round(b0 * pow(0.75, coalesce(len(missing), 0)), 9) AS raw, musts_total - coalesce(len(missing), 0) AS musts_met FROM {out}_c),
{out} AS (SELECT s.*, c.name, floor(round(CASE WHEN hi - lo < 1e-9 THEN 0.5 ELSE (raw - lo) / (hi - lo) END * 100.0, 9) * 10 + 0.5) / 10 AS final_score,
   row_number() OVER (PARTITION BY {", ".join("s." + k.strip() for k in keys.split(","))} ORDER BY raw DESC, coalesce(c.name, '') COLLATE en, s.candidate_id) AS rank
   FROM {out}_s s JOIN (SELECT {keys}, min(raw) AS lo, max(raw) AS hi FROM {out}_s GROUP BY ALL) USING ({keys}) JOIN c USING (candidate_id))"""


FULL = BASE + "," + _cells() + "," + _ranked()
ROLE = r"""CASE WHEN trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(source_file, ''), '\.[a-zA-Z]+$', ''), '(?s)_?(resume|Resume).*$', ''), '[_-]+', ' ', 'g'), '\s+', ' ', 'g')) <> ''
 THEN lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(source_file, ''), '\.[a-zA-Z]+$', ''), '(?s)_?(resume|Resume).*$', ''), '[_-]+', ' ', 'g'), '\s+', ' ', 'g')))
 ELSE lower(regexp_replace(coalesce(source_file, ''), '\.[a-zA-Z]+$', '')) END"""
CLASS = "CASE " + " ".join(f"WHEN regexp_matches(role, {_q(p)}) THEN '{n}'" for n, p in ROLE_CLASS) + " ELSE 'UNKNOWN' END"
LABELS = f"labels AS (SELECT candidate_id, role, {CLASS} AS cls FROM (SELECT candidate_id, {ROLE} AS role FROM c))"
LABELLED = FULL + "," + LABELS + ", rows_ AS (SELECT ranked.*, role, cls, count(*) OVER (PARTITION BY jd_id) AS pool FROM ranked JOIN labels USING (candidate_id))"
_PP = """round(count(*) FILTER (WHERE rank <= pool / 4 AND cls = 'RELEVANT') / greatest(count(*) FILTER (WHERE rank <= pool / 4), 1), 6) AS precision_top,
 round(count(*) FILTER (WHERE rank > pool * 3 / 4 AND cls = 'IRRELEVANT') / greatest(count(*) FILTER (WHERE rank > pool * 3 / 4), 1), 6) AS purity_bottom,
 round(coalesce(avg(rank) FILTER (WHERE cls = 'IRRELEVANT'), 0.0) - coalesce(avg(rank) FILTER (WHERE cls = 'RELEVANT'), 0.0), 6) AS separation"""


def _sweep(name: str, values: tuple[float, ...]) -> str:
    table = "st AS (SELECT unnest([" + ", ".join(f"{v!r}::DOUBLE" for v in values) + "]) AS setting)"
    if name == "alpha":
        body = "many AS (SELECT st.setting, raw.* FROM raw CROSS JOIN st)," + _cells("setting", "many", "cells", "setting, ") + "," + _ranked(extra="setting, ")
    else:
        body = _cells(out="cells0") + ", cells AS (SELECT st.setting, cells0.* FROM cells0 CROSS JOIN st)," + _ranked(extra="setting, ", gate="x.setting")
    return f"WITH {BASE}, {table}, {body}, {LABELS}, rows_ AS (SELECT ranked.*, cls, count(*) OVER (PARTITION BY setting, jd_id) AS pool FROM ranked JOIN labels USING (candidate_id)) SELECT setting, jd_id, {_PP} FROM rows_ GROUP BY setting, jd_id"


def _ablation() -> str:
    out = BASE + "," + _lexical("lex_normalized", "normalized") + "," + _raw("normalized").replace("raw AS", "raw_n AS")
    for name, alpha, raw in (("literal", "1.0", "raw_n"), ("lexical", "1.0", "raw"), ("semantic", "0.0", "raw"), ("hybrid", "0.5", "raw")):
        out += "," + _cells(alpha, raw, f"cells_{name}") + "," + _ranked(f"cells_{name}", f"ranked_{name}")
    return f"""WITH {out} SELECT h.jd_id, h.candidate_id, a.rank AS literal_rank, b.rank AS lexical_rank, s.rank AS semantic_rank, h.rank AS hybrid_rank,
 a.rank - h.rank AS literal_to_hybrid, b.rank - h.rank AS lexical_to_hybrid, s.rank - h.rank AS semantic_to_hybrid
 FROM ranked_hybrid h JOIN ranked_literal a USING (jd_id, candidate_id) JOIN ranked_lexical b USING (jd_id, candidate_id) JOIN ranked_semantic s USING (jd_id, candidate_id)"""


_STOP = ", ".join(_q(w) for w in T.STOPWORDS)


def _terms(least: int) -> str:
    return f"""SELECT req_key, list_distinct(list_filter(regexp_split_to_array(lower(array_to_string(list_concat([text], list_filter(coalesce(aliases, []), lambda a: a IS NOT NULL)), ' ')), '[^a-z0-9.+#]+'),
 lambda w: len(w) >= {least} AND w NOT IN ({_STOP}))) AS terms FROM r"""


_GAPS = """, pick AS (SELECT jd_id, candidate_id, rank FROM ranked WHERE rank IN ({0}, {1})),
g AS (SELECT jd_id, cells.req_key, round(coalesce(max(fused) FILTER (WHERE rank = {0}), 0.0) - coalesce(max(fused) FILTER (WHERE rank = {1}), 0.0), 9) AS gap, max(fused) FILTER (WHERE rank = {1}) AS lo,
 any_value(req_pos) AS req_pos FROM cells JOIN pick USING (jd_id, candidate_id) JOIN (SELECT req_key, req_pos FROM r) USING (req_key) GROUP BY jd_id, cells.req_key),
o AS (SELECT *, row_number() OVER (PARTITION BY jd_id ORDER BY gap DESC, req_pos) AS position FROM g WHERE {2})
SELECT jd_id, req_key, floor(gap * 1e6 + 0.5001) / 1e6 AS gap, position FROM o WHERE position <= 3"""
_HEAD = "regexp_replace(trim(line), '[:\\s]+$', '')"
_SECTION = (
    f"CASE WHEN {_HEAD} = '' OR len({_HEAD}) > 45 OR regexp_matches(line, {_q(T.BULLET)}) OR regexp_matches({_HEAD}, '[.!?,]$') OR len(regexp_split_to_array({_HEAD}, '\\s+')) > 5"
    f" OR regexp_matches(line, {_q(T.LABELLED)}) OR regexp_matches(lower({_HEAD}), {_q(T.DEGREE)}) THEN NULL "
    + " ".join(f"WHEN regexp_matches(lower({_HEAD}), {_q(p)}) THEN '{s}'" for p, s in T.SECTION_RULES)
    + " END"
)
_LOW = "lower(coalesce(text, ''))"
_LEAST = "CASE section " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in T.MIN_LENGTH.items()) + " ELSE 12 END"
_NOISE = (
    f"({_LOW} = '' OR NOT regexp_matches({_LOW}, '[a-z]') OR len({_LOW}) < {_LEAST} OR {_like(_LOW, T.DATE_ONLY, T.CONTACT_LABEL, T.EMAIL, T.BARE_PHONE, '^https?://')}"
    f" OR (regexp_matches({_LOW}, {_q(T.PROFILE)}) AND regexp_matches({_LOW}, {_q('[|·•]|' + chr(92) + '+?' + chr(92) + 'd{6,}')})))"
)
_PAIRS = "[" + ", ".join("{'p': " + _q(p) + ", 'c': [" + ", ".join(_q(c) for c in cs) + "]}" for p, cs in reverse().items()) + "]"


def _implied(text: str) -> str:
    """Implied canonical terms of ``text`` in dictionary order, with the normalised text as ``base``."""
    return f"""SELECT *, list_reduce(list_transform(list_filter(pairs, lambda e: contains(hay, ' ' || e.p || ' ')), lambda e: e.c), lambda a, b: list_concat(a, b), []::VARCHAR[]) AS hits
 FROM (SELECT *, ' ' || base || ' ' || chr(10) || ' ' || regexp_replace(replace(base, '/', ' '), '\\s+', ' ', 'g') || ' ' AS hay FROM (SELECT *, {NORM.format(text)} AS base, {_PAIRS} AS pairs FROM src))"""


def _keep_first(xs: str) -> str:
    return f"list_filter({xs}, lambda x, i: list_position({xs}, x) = i)"


_PHRASES = " UNION ALL ".join(
    f"SELECT doc_id, '{c}' AS category, trim(unnest(regexp_extract_all(low, {_q(p.replace('(?!' + chr(92) + 's*/)', ''))}))) AS phrase FROM low" for c, p in RULES
)
_TIER = "CASE " + " ".join(f"WHEN regexp_matches(low, {_q(p)}) THEN '{n}'" for n, p, _ in SENIORITY) + " END"
_MOST = "CASE label " + " ".join(f"WHEN '{n}' THEN {m}" for n, _, m in SENIORITY) + " END"

SQL: dict[str, str] = {
    "normalize_text": f"WITH {UNITS} SELECT evidence_id, {NORM.format('text')} AS normalized_text FROM u",
    "tokenize_stats": f"WITH {UNITS} SELECT evidence_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM (SELECT evidence_id, {TOK.format('text')} AS t FROM u)",
    "term_freq": f"WITH {UNITS} SELECT evidence_id, term, count(*) AS tf FROM (SELECT evidence_id, unnest({TOK.format('expanded')}) AS term FROM u) GROUP BY ALL",
    "doc_freq": f"WITH {UNITS} SELECT term, count(DISTINCT evidence_id) AS df FROM (SELECT evidence_id, unnest({TOK.format('expanded')}) AS term FROM u) GROUP BY ALL",
    "corpus_stats": f"WITH {UNITS} SELECT count(*) AS n_docs, round(avg(len({TOK.format('expanded')})), 6) AS avgdl FROM u",
    "negation_flag": f"WITH {UNITS} SELECT evidence_id, {NEG.replace('{0}', 'text')} AS negated FROM u",
    "noise_filter": f"WITH {UNITS} SELECT evidence_id, {_NOISE} AS noise FROM u",
    "section_classify": f"""SELECT candidate_id, CAST(line_no AS INTEGER) AS line_no, section FROM (SELECT candidate_id, line_no, {_SECTION} AS section FROM (SELECT id AS candidate_id,
 unnest(string_split(raw_text, chr(10))) AS line, generate_subscripts(string_split(raw_text, chr(10)), 1) - 1 AS line_no FROM candidates WHERE raw_text IS NOT NULL)) WHERE section IS NOT NULL""",
    "alias_expand_exact": f"""WITH {UNITS}, src AS (SELECT evidence_id, text FROM u), h AS ({_implied("text")})
 SELECT evidence_id, CASE WHEN len(extra) > 0 THEN base || ' ' || array_to_string(extra, ' ') ELSE base END AS expanded_text
 FROM (SELECT *, list_filter({_keep_first("hits")}, lambda c: NOT contains(' ' || base || ' ', ' ' || c || ' ')) AS extra FROM h)""",
    "detect_skills_all": f"WITH src AS (SELECT id AS candidate_id, raw_text FROM candidates), h AS ({_implied('raw_text')}) SELECT candidate_id, array_to_string(list_sort(list_distinct(hits)), ',') AS skills FROM h",
    "section_pivot": f"""WITH {UNITS} SELECT candidate_id, {", ".join(f"count(*) FILTER (WHERE section = '{s}') AS {s}" for s in T.MIN_LENGTH)} FROM u GROUP BY candidate_id""",
    "parse_quality": f"""WITH {UNITS}, {REQS}, n AS (SELECT candidate_id, {", ".join(f"count(*) FILTER (WHERE section = '{s}') AS {s}" for s in T.MIN_LENGTH)} FROM u GROUP BY candidate_id),
 f AS (SELECT c.candidate_id, trim(coalesce(raw_text, ''), ' ') AS rt, coalesce(len(skills_declared), 0) AS known, {", ".join(f"coalesce({s}, 0) AS {s}" for s in T.MIN_LENGTH)} FROM c LEFT JOIN n USING (candidate_id)),
 g AS (SELECT *, skills + experience + projects + education + other AS units FROM f)
 SELECT candidate_id, units, concat_ws(',', CASE WHEN len(rt) < 200 THEN 'NO_TEXT' END, CASE WHEN units < 8 THEN 'FEW_UNITS' END, CASE WHEN skills = 0 THEN 'NO_SKILLS_SECTION' END,
 CASE WHEN experience = 0 AND projects = 0 THEN 'NO_EXP_OR_PROJECTS' END, CASE WHEN other / greatest(units, 1) > 0.6 THEN 'MOSTLY_UNSECTIONED' END, CASE WHEN known = 0 THEN 'NO_KNOWN_SKILLS' END) AS flags FROM g""",
    "bm25_argmax": f"WITH {UNITS}, {REQS}, {_lexical('lex_expanded', 'expanded')} SELECT r.req_key, c.candidate_id, floor(coalesce(l.b.score, 0.0) * 1e6 + 0.5001) / 1e6 AS raw, l.b.id AS evidence_id FROM c CROSS JOIN r LEFT JOIN lex_expanded l USING (req_key, candidate_id)",
    "cosine_argmax": f"WITH {UNITS}, {REQS}, {SEMANTIC} SELECT r.req_key, c.candidate_id, floor(coalesce(l.b.score, 0.0) * 1e6 + 0.5001) / 1e6 AS raw, l.b.id AS evidence_id FROM c CROSS JOIN r LEFT JOIN sem l USING (req_key, candidate_id)",
    "semantic_search_top5": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS n FROM embeddings),
 s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(q.e, v.e) / (q.n * v.n), 9) AS score FROM v JOIN v q ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id),
 o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS position FROM s) SELECT query_id, vec_id, floor(score * 1e6 + 0.5001) / 1e6 AS score, position FROM o WHERE position <= 5""",
    "pool_zscore": f"WITH {BASE}, {_cells()} SELECT req_key, candidate_id, floor(lexical_norm * 1e6 + 0.5001) / 1e6 AS lexical_norm, floor(semantic_norm * 1e6 + 0.5001) / 1e6 AS semantic_norm FROM cells",
    "fuse_matrix": f"WITH {BASE}, {_cells()} SELECT req_key, candidate_id, floor(fused * 1e6 + 0.5001) / 1e6 AS fused, satisfied, matched_by, evidence_id FROM cells",
    "must_have_gate": f"WITH {FULL} SELECT jd_id, candidate_id, coalesce(array_to_string(missing, ','), '') AS missing, floor(gate_penalty * 1e6 + 0.5001) / 1e6 AS gate_penalty FROM ranked",
    "weighted_mean": f"WITH {FULL} SELECT jd_id, candidate_id, floor(base * 1e6 + 0.5001) / 1e6 AS base, floor(raw * 1e6 + 0.5001) / 1e6 AS raw, requirements_met, musts_met FROM ranked",
    "final_rank": f"WITH {FULL} SELECT jd_id, candidate_id, CAST(rank AS INTEGER) AS rank, round(final_score, 1) AS final_score FROM ranked",
    "lexical_only_rank": f"WITH {BASE}, {_cells('1.0')}, {_ranked()} SELECT jd_id, candidate_id, CAST(rank AS INTEGER) AS rank, round(final_score, 1) AS final_score FROM ranked",
    "ablation_ranks": _ablation(),
    "why_not_top": f"""WITH {FULL}, top AS (SELECT jd_id, candidate_id AS top_id FROM ranked WHERE rank = 1), bt AS (SELECT cells.req_key, top_id, fused AS top_fused FROM cells JOIN top ON top.jd_id = cells.jd_id AND top_id = candidate_id),
 g AS (SELECT cells.jd_id, candidate_id, top_id, max({{'gap': round(top_fused - fused, 9), 'p': -req_pos, 'req_key': cells.req_key, 'fused': fused, 'top_fused': top_fused}}) AS g FROM cells JOIN bt USING (req_key) JOIN (SELECT req_key, req_pos FROM r) USING (req_key) WHERE candidate_id <> top_id GROUP BY ALL)
 SELECT jd_id, candidate_id, top_id, g.req_key AS req_key, floor(g.gap * 100 + 0.5) / 100 AS gap, floor(g.fused * 100 + 0.5) / 100 AS score, floor(g.top_fused * 100 + 0.5) / 100 AS top_score FROM g WHERE g.gap > 0""",
    "explanation_missing": f"""WITH {BASE}, {_cells()}, tm AS ({_terms(4)}),
 op AS (SELECT jd_id, candidate_id, cells.req_key, kind, floor(fused * 100 + 0.5) / 100 AS score FROM cells JOIN (SELECT req_key, kind FROM r) USING (req_key) WHERE CASE WHEN kind = 'MUST' THEN fused < 0.45 ELSE NOT satisfied END),
 di AS (SELECT req_key, candidate_id, min({{'p': ev_pos, 't': text}}) AS b FROM tm JOIN u ON negated AND len(list_filter(terms, lambda w: contains(lower(text), w))) > 0 GROUP BY ALL)
 SELECT jd_id, candidate_id, req_key, kind, score, di.b.t AS disclaimed_by FROM op LEFT JOIN di USING (req_key, candidate_id)""",
    "disclaimers": f"""WITH {UNITS}, {REQS}, tm AS ({_terms(4)}) SELECT req_key, candidate_id, min({{'p': ev_pos, 't': text}}).t AS disclaimed_by
 FROM tm JOIN u ON negated AND len(list_filter(terms, lambda w: contains(lower(text), w))) > 0 WHERE candidate_id IN (SELECT candidate_id FROM c) GROUP BY ALL""",
    "who_has": f"""WITH {UNITS}, sk AS (SELECT skill_id, {NORM.format("canonical")} AS needle FROM skill_catalog)
 SELECT skill_id, candidate_id, min({{'p': ev_pos, 'i': evidence_id}}).i AS evidence_id FROM u JOIN sk ON needle <> '' AND contains(expanded, needle) WHERE NOT negated GROUP BY skill_id, candidate_id""",
    "compare_pair": f"WITH {FULL}" + _GAPS.format(1, 2, "gap > 0.02"),
    "why_not_candidate": f"WITH {FULL}" + _GAPS.format(1, 4, "lo IS NOT NULL"),
    "bias_flags": f"WITH low AS (SELECT doc_id, {_LOW} AS low FROM documents) SELECT DISTINCT doc_id, category, phrase FROM ({_PHRASES})",
    "seniority_overreach": f"""WITH low AS (SELECT doc_id, {_LOW} AS low FROM documents), t AS (SELECT doc_id, {_TIER} AS label, trim(unnest(regexp_extract_all(low, {_q(YEARS)}))) AS phrase FROM low),
 y AS (SELECT doc_id, label, {_MOST} AS max_years, phrase, CAST(regexp_extract(phrase, '^(\\d+)', 1) AS INTEGER) AS years FROM t WHERE label IS NOT NULL) SELECT DISTINCT doc_id, label, max_years, phrase, years FROM y WHERE years > max_years""",
    "role_class": f"WITH {UNITS}, {REQS}, {LABELS} SELECT candidate_id, role, cls FROM labels",
    "class_summary": f"""WITH {LABELLED} SELECT jd_id, cls, count(*) AS n, round(avg(rank), 6) AS mean_rank, round(avg(final_score), 6) AS mean_score, count(*) FILTER (WHERE rank <= pool / 4) AS in_top,
 count(*) FILTER (WHERE rank > pool * 3 / 4) AS in_bottom FROM rows_ GROUP BY jd_id, cls""",
    "precision_purity": f"WITH {LABELLED} SELECT jd_id, {_PP} FROM rows_ GROUP BY jd_id",
    "role_means": f"WITH {LABELLED} SELECT jd_id, role, cls, count(*) AS n, round(avg(rank), 6) AS mean_rank FROM rows_ GROUP BY jd_id, role, cls",
    "misplaced": f"WITH {LABELLED} SELECT jd_id, candidate_id, role, cls, CAST(rank AS INTEGER) AS rank, final_score FROM rows_ WHERE (cls = 'IRRELEVANT' AND rank <= pool / 4) OR (cls = 'RELEVANT' AND rank > pool * 3 / 4)",
    "score_distribution": f"""WITH {FULL}, v AS (SELECT jd_id, list_sort(list(final_score)) AS v, round(avg(final_score), 6) AS mean, round(stddev_pop(final_score), 6) AS sd, count(*) FILTER (WHERE final_score = 0) AS zeros,
 count(*) FILTER (WHERE final_score = 100) AS hundreds FROM ranked GROUP BY jd_id) SELECT jd_id, list_min(v) AS min, v[1 + CAST(floor(len(v) * 0.25) AS INTEGER)] AS p25, v[1 + CAST(floor(len(v) * 0.5) AS INTEGER)] AS median,
 v[1 + CAST(floor(len(v) * 0.75) AS INTEGER)] AS p75, list_max(v) AS max, mean, sd, zeros, hundreds FROM v""",
    "alpha_sweep": _sweep("alpha", ALPHA_SWEEP),
    "gate_sweep": _sweep("gate", GATE_SWEEP),
    "embedding_cache_misses": f"""WITH {UNITS}, {REQS} SELECT DISTINCT sha1('hashed-64' || chr(0) || text) AS key FROM u WHERE text <> '' AND text IS NOT NULL AND sha1('hashed-64' || chr(0) || text) NOT IN (SELECT sha1('hashed-64' || chr(0) || text) FROM r)""",
}


_MATCHED = f"""WITH {BASE}, {_cells()}, tm AS ({_terms(3)}),
 kept AS (SELECT * FROM (SELECT cells.*, kind, req_pos, requirement_text, terms, row_number() OVER (PARTITION BY cells.jd_id, cells.candidate_id ORDER BY fused DESC, req_pos) AS position
   FROM cells JOIN (SELECT req_key, req_pos, kind, text AS requirement_text FROM r) USING (req_key) JOIN tm USING (req_key) WHERE satisfied AND evidence_id IS NOT NULL) WHERE position <= 4),
 ct AS (SELECT kept.*, u.text AS cited FROM kept JOIN (SELECT evidence_id, text FROM u) u USING (evidence_id) WHERE u.text <> ''),
 hit AS (SELECT req_key, ct.candidate_id, u.text, u.ev_pos, len(list_filter(terms, lambda w: contains(lower(u.text), w))) * 2 + CASE WHEN u.section IN ('experience', 'projects') THEN 2 ELSE 0 END - len(u.text) / 500.0 AS s,
   len(list_filter(terms, lambda w: contains(lower(u.text), w))) AS n FROM ct JOIN u ON u.candidate_id = ct.candidate_id AND NOT u.negated AND len(u.text) BETWEEN 40 AND 260 WHERE len(cited) < 40),
 bst AS (SELECT req_key, candidate_id, max({{'s': round(s, 9), 'p': -ev_pos, 't': text}}).t AS quote FROM hit WHERE n > 0 GROUP BY ALL),
 qt AS (SELECT ct.*, coalesce(CASE WHEN len(cited) < 40 THEN bst.quote END, cited) AS evidence_text FROM ct LEFT JOIN bst USING (req_key, candidate_id)),
 gp AS (SELECT *, len(list_filter(terms, lambda t: contains(' ' || lower(evidence_text) || ' ', t || ' ') OR contains(' ' || lower(evidence_text) || ' ', ' ' || t))) = 0 AS gap FROM qt)
 SELECT jd_id, candidate_id, CAST(position AS INTEGER) AS position, req_key, requirement_text, kind, evidence_text, floor(fused * 100 + 0.5) / 100 AS score, matched_by,
 CASE WHEN matched_by = 'semantic' AND gap THEN 'found by meaning; the evidence never uses the requirement''s wording' WHEN matched_by = 'semantic' THEN 'matched on meaning'
 WHEN matched_by = 'both' THEN 'matched on both the exact term and its meaning' WHEN matched_by = 'lexical' THEN 'matched on the exact term' ELSE 'no supporting evidence found' END AS how,
 matched_by = 'semantic' AND gap AS vocabulary_gap FROM gp"""
_TRACE = f"""WITH {UNITS}, {REQS}, {_lexical("lex_expanded", "expanded")}, {SEMANTIC},
 lt AS (SELECT t.candidate_id, r.req_key, array_to_string(list(t.evidence_id ORDER BY round(coalesce(w.score, 0.0), 9) DESC, t.ev_pos)[1:5], ',') AS expanded_ids
   FROM lex_expanded_t t CROSS JOIN r LEFT JOIN lex_expanded_w w ON w.evidence_id = t.evidence_id AND w.req_key = r.req_key WHERE NOT t.negated GROUP BY ALL),
 mt AS (SELECT u.candidate_id, r.req_key, array_to_string(list(u.evidence_id ORDER BY round(coalesce(CASE WHEN sn.norm > 0 AND srn.norm > 0 THEN sd.dot / (sn.norm * srn.norm) END, 0.0), 9) DESC, u.ev_pos)[1:5], ',') AS semantic_ids
   FROM u CROSS JOIN r LEFT JOIN sd ON sd.evidence_id = u.evidence_id AND sd.req_key = r.req_key LEFT JOIN sn ON sn.evidence_id = u.evidence_id LEFT JOIN srn ON srn.req_key = r.req_key WHERE NOT u.negated GROUP BY ALL)
 SELECT req_key, candidate_id, expanded_ids, semantic_ids FROM lt JOIN mt USING (req_key, candidate_id)"""
_SINGLE = [(k, p, cs) for k, (p, cs) in enumerate(reverse().items()) if " " not in p and len(p) >= 5]
_FUZZY = f"""WITH {UNITS}, al AS (SELECT * FROM (VALUES {", ".join(f"({k}, {_q(p)}, {_q(','.join(cs))})" for k, p, cs in _SINGLE)}) t(ord, alias, canonical)),
 tk AS (SELECT DISTINCT token FROM (SELECT unnest({TOK.format("text")}) AS token FROM u) WHERE len(token) >= 5 AND token NOT IN ({", ".join(_q(p) for p in reverse())})),
 nr AS (SELECT token, min({{'d': damerau_levenshtein(token, alias), 'o': ord, 'a': alias, 'c': canonical}}) AS b FROM tk JOIN al ON token[1] = alias[1] AND abs(len(token) - len(alias)) <= 2 GROUP BY token)
 SELECT token, b.a AS alias, b.c AS canonical FROM nr WHERE b.d <= CASE WHEN len(token) >= 8 THEN 2 ELSE 1 END"""
_SHORT = "concat(lower(regexp_replace({0}, " + _q(T.REQ_LEAD) + ", '', 'i')[1]), regexp_replace({0}, " + _q(T.REQ_LEAD) + ", '', 'i')[2:])"
_CITED = _MATCHED[_MATCHED.index(" kept AS (") : _MATCHED.rindex(" SELECT jd_id, candidate_id, CAST(position")]
_SUMMARY = f"""WITH {FULL}, tm AS ({_terms(3)}), {_CITED},
 mt AS (SELECT jd_id, candidate_id, min_by(requirement_text, position) AS req, min_by(evidence_text, position) AS quote, min_by(CASE WHEN matched_by = 'semantic' AND gap THEN 'found by meaning; the evidence never uses the requirement''s wording'
   WHEN matched_by = 'semantic' THEN 'matched on meaning' WHEN matched_by = 'both' THEN 'matched on both the exact term and its meaning' WHEN matched_by = 'lexical' THEN 'matched on the exact term' ELSE 'no supporting evidence found' END, position) AS how,
   count(*) FILTER (WHERE matched_by = 'semantic' AND gap) AS gaps FROM gp GROUP BY ALL),
 tn AS ({_terms(4)}),
 di AS (SELECT req_key, candidate_id, min({{'p': ev_pos, 't': text}}).t AS d FROM tn JOIN u ON negated AND len(list_filter(terms, lambda w: contains(lower(text), w))) > 0 GROUP BY ALL),
 ms AS (SELECT jd_id, candidate_id, count(*) AS n, string_agg({_SHORT.replace("{0}", "text")}, '; ' ORDER BY req_pos) AS list, arg_min(d, req_pos) FILTER (WHERE d IS NOT NULL) AS said
   FROM (SELECT cells.jd_id, cells.candidate_id, req_pos, text, d FROM cells JOIN (SELECT req_key, req_pos, kind, text FROM r) USING (req_key) LEFT JOIN di ON di.req_key = cells.req_key AND di.candidate_id = cells.candidate_id WHERE kind = 'MUST' AND fused < 0.45) GROUP BY ALL),
 pl AS (SELECT jd_id, count(*) AS pool FROM ranked GROUP BY jd_id)
 SELECT jd_id, candidate_id, CAST(rank AS INTEGER) AS rank, concat_ws(' ', 'Ranked #' || rank || ' of ' || pool || ' with a score of ' || CAST(round(final_score, 1) AS VARCHAR) || '. Meets ' || requirements_met || ' of ' || requirements_total
   || ' requirements, including ' || musts_met || ' of ' || musts_total || ' must-haves.',
  CASE WHEN req IS NOT NULL THEN 'Strongest match: "' || {_SHORT.replace("{0}", "req")} || '": "' || quote || '" (' || how || ').' END,
  CASE WHEN gaps = 1 THEN 'One requirement was matched by meaning alone; a keyword search would have missed it.' WHEN gaps > 1 THEN 'Several requirements were matched by meaning alone; a keyword search would have missed them.' END,
  CASE WHEN n = 1 THEN 'Missing 1 must-have: ' || list || '.' WHEN n > 1 THEN 'Missing ' || n || ' must-haves: ' || list || '.' ELSE 'No must-have requirements are missing.' END,
  CASE WHEN said IS NOT NULL THEN 'The candidate states this directly: "' || said || '"' END) AS summary
 FROM ranked JOIN pl USING (jd_id) LEFT JOIN mt USING (jd_id, candidate_id) LEFT JOIN ms USING (jd_id, candidate_id)"""
_EXPAND = f"""WITH {UNITS}, src AS (SELECT evidence_id, text FROM u), h AS ({_implied("text")}),
 al AS (SELECT * FROM (VALUES {", ".join(f"({k}, {_q(p)}, {_q(','.join(cs))})" for k, p, cs in _SINGLE)}) t(ord, alias, canonical)),
 wd AS (SELECT evidence_id, unnest(w) AS token, generate_subscripts(w, 1) AS nth FROM (SELECT evidence_id, string_split_regex(replace(base, '/', ' '), '\\s+') AS w FROM h)),
 nr AS (SELECT token, min({{'d': damerau_levenshtein(token, alias), 'o': ord, 'c': canonical}}) AS b FROM (SELECT DISTINCT token FROM wd WHERE len(token) >= 5 AND token NOT IN ({", ".join(_q(p) for p in reverse())})) tk
   JOIN al ON token[1] = alias[1] AND abs(len(token) - len(alias)) <= 2 GROUP BY token),
 fz AS (SELECT evidence_id, flatten(list(string_split(b.c, ',') ORDER BY nth)) AS meant FROM wd JOIN nr USING (token) WHERE b.d <= CASE WHEN len(token) >= 8 THEN 2 ELSE 1 END GROUP BY evidence_id),
 al2 AS (SELECT evidence_id, base, list_concat(hits, coalesce(meant, [])) AS every FROM h LEFT JOIN fz USING (evidence_id))
 SELECT evidence_id, CASE WHEN len(extra) > 0 THEN base || ' ' || array_to_string(extra, ' ') ELSE base END AS expanded_text
 FROM (SELECT *, list_filter({_keep_first("every")}, lambda c: NOT contains(' ' || base || ' ', ' ' || c || ' ')) AS extra FROM al2)"""
_BEST = "SELECT jd_id, -b.s AS setting, b.precision_top AS precision_top, b.purity_bottom AS purity_bottom, b.separation AS separation FROM (SELECT jd_id, max({{'precision_top': precision_top, 'separation': separation, 's': -setting, 'purity_bottom': purity_bottom}}) AS b FROM ({0}) GROUP BY jd_id)"
_PACKED = r"""WITH p AS (SELECT id, any_value(text) AS text FROM evidence WHERE unit_kind = 'packed' GROUP BY id),
 s AS (SELECT id, string_split_regex(regexp_replace(text, '^[  	
]*[\p{L}][\p{L}\p{N}_&/  ]{0,40}?[  	]*(:|–|—|-[  	])', ''), '[,;|•·，；、	]|[  ]{3,}|[  ]+[/&–—-][  ]+') AS x FROM p WHERE NOT regexp_matches(text, '["''“”‘’«»()]')),
 t AS (SELECT id, list_filter(list_transform(x, lambda v: trim(v, E'  	
')), lambda v: v <> '') AS x FROM s)
 SELECT id AS record_id, CAST(generate_subscripts(x, 1) AS INTEGER) AS item_pos, unnest(x) AS item FROM t"""
SQL |= {
    "explanation_matched": _MATCHED, "trace_top5": _TRACE, "fuzzy_alias": _FUZZY, "explanation_summary": _SUMMARY, "alias_expand": _EXPAND, "p7_plain": _PACKED,
    "best_alpha": _BEST.format(_sweep("alpha", ALPHA_SWEEP)), "best_gate": _BEST.format(_sweep("gate", GATE_SWEEP)),
    "rank_percentile": f"WITH {LABELLED} SELECT jd_id, candidate_id, role, cls, CAST(rank AS INTEGER) AS rank, floor(rank / pool * 1e6 + 0.5001) / 1e6 AS percentile FROM rows_",
}


def _tie_safe(sql: str) -> str:
    """``round(x, 9)`` as the engine rounds: a half in decimals goes up whatever its binary form."""
    at = 0
    while (k := sql.find("round(", at)) >= 0:
        depth, j = 1, k + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            j += 1
        body = sql[k + 6 : j - 1]
        if body.endswith(", 9)") or body.endswith(", 9"):
            sql = sql[:k] + f"(floor(({body[:-3]}) * 1e9 + 0.5001) / 1e9)" + sql[j:]
            at = k
        else:
            at = k + 6
    return sql


SQL = {name: _tie_safe(text) for name, text in SQL.items()}
