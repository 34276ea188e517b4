"""Personal values in free text: a semi-Markov conditional random field over whole candidate spans.

A line is segmented into spans of the types EMAIL, PHONE, ID_NUMBER, ADDRESS and NAME and single characters of no type.
Grammars propose every span that could be a value, with alternative boundaries and types; a span's score is the sum of
the weights of features of the whole span (its shape, its length, the cue words to its left, dictionary hits) and of
the type before it. The probability of a segmentation is its exponential over the sum of all (:func:`lattice`, forward and
backward); a dynamic program over span ends finds the most probable one, boundaries and types jointly. The support of
the model is what the grammars propose: a value of a form that no grammar knows is not found.

The weights are fitted here (:func:`fit`, maximum likelihood) on invented labelled lines (``pii_training``); the dictionary
of given names and surnames is counted over the whole name column of the collection (:func:`name_lookup`).
"""

from __future__ import annotations

import heapq
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.session import materialize, spread

TYPES = ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME")
#: No span is longer than this many characters (the semi-Markov segment bound).
MAX_SPAN = 160
#: At most this many given names and surnames each are sent to every task, the most frequent; the rest are joined.
MAX_DICTIONARY = 50_000

_S = r"[^\S\n]"  # a blank within a line
_I = re.IGNORECASE

_EMAIL = re.compile(
    rf"(?<![\w.+])\w[\w.+%-]*{_S}*(?:[@＠]|[(\[{{]{_S}*at{_S}*[)\]}}]){_S}*[^\W_][\w-]*"
    rf"(?:{_S}*(?:\.|[(\[{{]{_S}*dot{_S}*[)\]}}]){_S}*[^\W\d_][\w-]*)+"
    rf"|(?<![\w.+])\w[\w.+%-]*{_S}+at{_S}+[^\W_][\w-]*(?:{_S}+dot{_S}+[^\W\d_][\w-]*)+",
    _I,
)
_NUMBER = re.compile(
    rf"(?<![\w.@+/-])(?:\+|\(\+?)?\d(?:(?:{_S}+|{_S}?[().-]{_S}?){{0,3}}\d)+(?:{_S}*\bext\.?{_S}*\d{{1,5}})?(?![\w@])"
)
_CODE = re.compile(
    rf"(?<![\w.@+/-])(?:[A-Z]{{2}}{_S}?\d\d{_S}?\d\d{_S}?\d\d{_S}?[A-D]|[A-Z]{{5}}\d{{4}}[A-Z]|[A-Z]{{1,5}}[.-]?\d[\d.-]*\d[A-Z]?)(?![\w@-])", _I
)
_WORDS3 = rf"(?:[^\W\d_][\w'’-]*\.?{_S}+){{1,3}}?"
_STREET = (
    r"(?:street|st|road|rd|avenue|ave|lane|ln|row|close|crescent|cres|terrace|way|drive|boulevard|blvd|court|place|square|"
    r"grove|gardens|mews|walk|quay|parade)\b\.?"
)
_UNIT = rf"(?:(?:apt|apartment|flat|unit|suite|room|no|plot|door)\b\.?{_S}*\d+[A-Z]?{_S}*,?{_S}*)"
#: A letter that is no small Latin one: every capital, in any script.
_CAPITAL = r"[^\W\d_a-zß-öø-ÿ]"
_UPPER = rf"(?-i:{_CAPITAL})"
#: After a street: a comma and a postal code and town, or a town, which starts with a capital or ends its part of the line.
_TAIL = (
    rf"(?:{_S}*,{_S}*\d{{4,6}}{_S}+[^\W\d_]\w*(?:{_S}+{_UPPER}[^\W\d_]+)?"
    rf"|{_S}*,{_S}*(?:{_UPPER}\w*(?:{_S}+{_UPPER}[^\W\d_]+)?|[^\W\d_]\w*(?:{_S}+[^\W\d_]+)?(?={_S}*(?:$|[,;|/•(\n-]|\d))|[^\W\d_]\w*(?={_S}*(?:$|[,;|/•(\n-]|\d)))(?:{_S}*-)?(?:{_S}+\d{{4,6}})?)?"
)
_CAP = rf"{_UPPER}[\w'’-]*"
_ADDRESS = {
    "street": rf"(?P<unit>{_UNIT})?\b\d+[A-Z]?(?:[-/]\d+[A-Z]?)?,?{_S}+{_WORDS3}{_STREET}",
    "house": rf"(?P<unit>{_UNIT}){_WORDS3}house\b",
    "layout": rf"(?P<unit>{_UNIT})(?:\d+(?:st|nd|rd|th){_S}+(?:cross|main|floor|block){_S}*,{_S}*)*{_WORDS3}(?:layout|nagar|colony|enclave|extension)\b",
    "sector": rf"\b\d+(?:/\d+)?{_S}*,{_S}*sector{_S}+\d+{_S}*,{_S}*{_WORDS3}{_STREET}",
    "weg": rf"\b[^\W\d_][\w-]*(?:weg|stra(?:ß|ss)e|gasse|allee|platz|markt|damm|ufer|chaussee|steig)\b{_S}+\d+[a-z]?\b",
    "calle": rf"\b(?:calle|c/|avenida|avda\.?|paseo|plaza|via|viale|piazza|corso|rua|ulica|ul\.){_S}*(?:(?:de{_S}+la|de{_S}+los|del|de|da|do|dei|della){_S}+)?[^\W\d_][\w'’.-]*(?:{_S}+[^\W\d_][\w'’.-]*)?{_S}*,?{_S}+(?:n[.º°o]{_S}*)?\d+[a-z]?\b",
    "code": rf"(?:\b\d{{1,4}}[A-Z]?{_S}+{_CAP}(?:{_S}+{_CAP}){{0,2}}|\b{_CAP}(?:{_S}+{_CAP}){{0,2}}{_S}+\d{{1,4}}[a-z]?)(?={_S}*,{_S}*\d{{4,6}}{_S}+{_UPPER})",
    "box": rf"\b(?:p\.?{_S}?o\.?{_S}?box|post(?:fach|box)|apartado)\b{_S}+\d+",
}
_ADDRESS = {k: re.compile(v + _TAIL, _I) for k, v in _ADDRESS.items()}
_ADDRESS["rue"] = re.compile(
    rf"(?P<unit>{_UNIT})?\b\d+(?:{_S}+(?:bis|ter))?{_S}*,?{_S}+(?:rue|avenue|boulevard|place|chemin|all[ée]e|impasse)"
    rf"{_S}+(?:de{_S}+la|du|des|de|d['’]){_S}*[^\W\d_][\w'’-]*(?:{_S}+[^\W\d_][\w'’-]*)?" + _TAIL, _I
)
_ADDRESS_WORDS = frozenset(
    """street st road rd avenue ave lane ln row close crescent cres terrace way drive boulevard blvd court place square grove gardens mews walk
    quay parade house layout nagar colony enclave extension rue chemin impasse box postfach postbox apartado calle c avenida avda paseo plaza via viale piazza corso rua ulica ul""".split()
)
_ADDRESS_ENDS = ("weg", "straße", "strasse", "gasse", "allee", "platz", "markt", "damm", "ufer", "chaussee", "steig")
_ADDRESS_CODE = re.compile(rf",\s*\d{{4,6}}\s+{_CAPITAL}")
#: Two words that may be a name: both with a capital, the first perhaps an initial.
_CAP_PAIR = re.compile(rf"{_CAPITAL}(?:[^\W\d_]|['’])*\.?,?\s+(?:[^\W\d_]\.\s+)?{_CAPITAL}")
_SOME_DIGIT = re.compile(r"\d")
_DIGITS = re.compile(r"\d(?:[^\S\n]*[().-]{0,2}[^\S\n]*\d){5}|[A-Za-z]{1,5}[-.]?\d[\d.-]{3}", re.ASCII)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
#: Words that a person's name does not contain.
NOT_NAMES = frozenset(
    """a an and the of for to in on at by with from or as is was curriculum vitae resume cv profile scan applicant
    candidate unknown final name email mail phone mobile tel address residence papers experience project education
    skills tools languages references reference target role aspiring analyst developer engineer planner editor trainee
    technician clerk associate researcher manager designer partners studio labs works foundry trust collective
    cooperative institute gmbh ltd pvt college university polytechnic street road avenue lane row close crescent
    terrace way house council group team desk i we he she they his her my our v""".split()
)
_CUES = {
    "mail": "email e-mail mail write mailbox inbox",
    "phone": "phone mobile tel telephone call cell fax hotline dial ring text reach contact on",
    "id": "ssn social security ni n.i insurance passport national id identity card personalausweis dl driving licence license aadhaar uid pan tax nif dni",
    "number": "no number nr as",
    "address": "address residence postal home living lives live at to in",
    "name": "name reference references referee guarantor person author coauthor co-author",
    "by": "by with from under and beside followed shadowed mentored coached reported answered",
    "title": "dr mr mrs ms prof miss herr frau",
    "thing": "ticket parcel claim receipt build code fault alarm norm standard version model page pages letters rows lines read order invoice error iso part item firmware",
}
_AFTER_NAME = frozenset("and for on at in of about is was while who to had has used".split())
_CUE_OF = {w: k for k, ws in _CUES.items() for w in ws.split()}
_LEFT = re.compile(r"[\w.'-]*\w")
_PART = re.compile(r"[,;|•·()\[\]\"“”«»，；、]|['’](?!\w)|\s{3,}")


def _left_cues(text: str, start: int, bol: int) -> list[str]:
    """Cue classes of the three words before a span in its part of the line, with their distance."""
    words = _LEFT.findall(_PART.split(text[max(bol, start - 40) : start].lower())[-1])[-3:]
    out = []
    for k, w in enumerate(reversed(words)):
        c = _CUE_OF.get(w)
        if c:
            out.append(f"{c}{k}")
    return out or ["none"]


def _shape(value: str) -> str:
    v = re.sub(r"\s+", " ", value.upper())
    return re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", v))


def _groups(value: str) -> str:
    return "-".join(str(len(g)) for g in re.findall(r"\d+", re.sub(r"ext.*", "", value, flags=_I)))


def _case(a: str) -> str:
    return "up" if a.isupper() else "low" if a.islower() else "cap" if a[0].isupper() else "mix"


def _name_spans(text: str, bol: int, eol: int, given: frozenset, family: frozenset, first: bool, field: bool):
    """Candidate names of a line: given + family, with middle initial, initial + family, family, given."""
    toks = [(m.start(), m.end()) for m in _WORD.finditer(text, bol, eol)]
    words = [text[a:b] for a, b in toks]
    low = [w.lower() for w in words]
    n = len(toks)
    for i in range(n):
        w = low[i]
        if w in NOT_NAMES and not (len(w) == 1):
            continue
        s, e = toks[i]
        j = i + 1
        mid = False
        # a middle initial: one letter and a point
        if j < n and len(words[j]) == 1 and text[toks[j][1] : toks[j][1] + 1] == "." and text[e : toks[j][0]].isspace():
            mid, last_end, j = True, toks[j][1] + 1, j + 1
        else:
            last_end = e
        if len(w) == 1:
            if text[e : e + 1] != "." or mid:
                continue
            last_end = e + 1
        if j >= n or len(words[j]) < 2 or low[j] in NOT_NAMES:
            continue
        gap = text[last_end : toks[j][0]]
        tail = toks[j][1]
        if gap.isspace():
            swapped = False
        elif gap.strip() == "," and not mid and len(w) > 1:
            swapped = True
        else:
            continue
        if text[tail : tail + 1] in ("-", "_", "@", "＠") or (s > bol and text[s - 1] in "-_.@/+＠"):
            continue
        if text[tail : tail + 1] in (".", "+") and text[tail + 1 : tail + 2].isalnum():
            continue
        g, f = (low[j], w) if swapped else (w, low[j])
        kg, kf = g in given, f in family
        if swapped and not kg:
            continue
        cg, cf = _case(words[i]), _case(words[j])
        if not (kg or kf) and (cg == "low" or cf == "low" or cg == "mix"):
            continue
        feats = [
            f"g{int(kg)}f{int(kf)}", f"case={cg if len(w) > 1 else cf}/{cf}", f"swap{int(swapped)}g{int(kg)}f{int(kf)}", f"mid{int(mid)}",
            f"init{int(len(w) == 1)}f{int(kf)}",
        ]
        if i and low[i - 1] in given and text[toks[i - 1][1] : s].isspace():
            feats.append("prev=given")
        start_of_line = not text[bol:s].strip()
        rest = text[tail:eol].strip()
        feats.append(f"whole{int(start_of_line and not rest)}first{int(first)}field{int(field)}g{int(kg)}")
        if start_of_line and first:
            feats.append(f"head{int(field)}g{int(kg)}f{int(kf)}")
        # the run of capitalised words that the pair stands in: firms and titles run on, names mostly do not
        a = i
        while a and _case(words[a - 1]) != "low" and text[toks[a - 1][1] : toks[a][0]].isspace():
            a -= 1
        z = j
        while z + 1 < n and _case(words[z + 1]) != "low" and text[toks[z][1] : toks[z + 1][0]].isspace():
            z += 1
        if not (a == 0 and z == n - 1):
            feats.append(f"run{min(i - a, 2)}{min(z - j, 2)}g{int(kg)}f{int(kf)}")
        nxt = low[j + 1] if j + 1 < n else ""
        mark = text[tail : tail + 1].strip()
        feats.append(f"right={nxt if nxt in _AFTER_NAME and not mark else ('digit' if mark.isalnum() else mark) if mark else 'word' if rest else 'end'}")
        if j + 1 < n and text[tail : toks[j + 1][0]].isspace():
            if nxt in NOT_NAMES and nxt not in ("and", "on", "at", "while", "i", "to", "for", "with"):
                feats.append("next=notname")
            if _case(words[j + 1]) == "cap":
                feats.append("next=cap")
        yield s, tail, "NAME", feats


def _candidates(text: str, bol: int, eol: int, given: frozenset, family: frozenset, first: bool, field: bool, hints: int):
    """All candidate spans of one line with the features of the whole span."""
    out = []
    if hints & 1:
        for m in _EMAIL.finditer(text, bol, eol):
            v = m.group()
            form = "sign" if re.search("[@＠]", v) else "bracket" if re.search(r"[(\[{]", v) else "word"
            out.append((m.start(), m.end(), "EMAIL", [f"form={form}"]))
    if hints & 2:
        for m in _NUMBER.finditer(text, bol, eol):
            v, s, e = m.group(), m.start(), m.end()
            if v[0] == "(" and not re.match(r"\(\+?\d+\)", v):
                s, v = s + 1, v[1:]
            if v.count(")") > v.count("("):
                v = v[: v.rindex(")")].rstrip()
                e = s + len(v)
            digits = sum(c.isdigit() for c in v)
            if digits < 6:
                continue
            base = [f"groups={_groups(v)}", f"digits={min(digits, 16)}", f"plus{int(v[0] == '+')}paren{int('(' in v)}ext{int('ext' in v.lower())}"]
            if v.startswith("00") or v.startswith("0"):
                base.append("zero")
            base.append("range" if re.fullmatch(r"(?:19|20)\d\d\s*-\s*(?:19|20)\d\d", v) else "norange")
            out.append((s, e, "PHONE", base))
            out.append((s, e, "ID_NUMBER", base[:2]))
        for m in _CODE.finditer(text, bol, eol):
            if sum(c.isdigit() for c in m.group()) >= 4:
                out.append((m.start(), m.end(), "ID_NUMBER", [f"shape={_shape(m.group())}", "code"]))
    if hints & 4:
        for kind, rx in _ADDRESS.items():
            for m in rx.finditer(text, bol, eol):
                unit = m.group("unit") if "unit" in rx.groupindex else None
                feats = [f"kind={kind}", f"unit{int(bool(unit))}", f"tail{int(',' in m.group()[(len(unit) if unit else 0):])}"]
                body = [w for w in _WORD.findall(m.group().lower())]
                if any(w in ("of", "the", "for", "in", "on", "with", "and", "a") for w in body):
                    feats.append("function-word")
                out.append((m.start(), m.end(), "ADDRESS", feats))
                if unit and kind in ("street", "rue"):
                    out.append((m.start() + len(unit), m.end(), "ADDRESS", [f"kind={kind}", "unit-cut"]))
    if hints & 8:
        out.extend(_name_spans(text, bol, eol, given, family, first, field))
    return [
        (s, e, t, [f"{t}:{f}" for f in fs] + [f"{t}:bias"] + [f"{t}:left={c}" for c in _left_cues(text, s, bol)])
        for s, e, t, fs in out
        if e - s <= MAX_SPAN
    ]


def decode(spans: list, weights: dict[str, float]) -> list[tuple[int, int, str, list[str]]]:
    """The most probable segmentation of a line: spans in order, no two overlapping.

    ``best(end, type)`` is kept as a running maximum per last type while spans are taken in order of their start, so
    the cost is that of sorting.
    """
    if not spans:
        return []
    scored = []
    for k, (s, e, t, fs) in enumerate(spans):
        sc = sum(weights.get(f, 0.0) for f in fs)
        scored.append((s, e, t, sc, k))
    by_start = sorted(scored, key=lambda x: (x[0], x[1]))
    pending: list = []  # finished spans not yet passed, by end
    best: dict[str, tuple[float, tuple | None]] = {"": (0.0, None)}
    top = (0.0, None)
    for s, e, t, sc, k in by_start:
        while pending and pending[0][0] <= s:
            _, _, ty, total, chain = heapq.heappop(pending)
            if ty not in best or total > best[ty][0]:
                best[ty] = (total, chain)
            if total > top[0]:
                top = (total, chain)
        total, chain = max(
            ((v + weights.get(f"{p}>{t}", 0.0), c) for p, (v, c) in best.items()), key=lambda x: x[0]
        )
        heapq.heappush(pending, (e, k, t, total + sc, (k, chain)))
    for _, _, _, total, chain in pending:
        if total > top[0]:
            top = (total, chain)
    out, chain = [], top[1]
    while chain:
        out.append(spans[chain[0]])
        chain = chain[1]
    return out[::-1]


def _lse(xs: list[float]) -> float:
    m = max(xs)
    return m + math.log(sum(math.exp(x - m) for x in xs))


def lattice(spans: list[tuple[int, int, str]], scores: list[float], trans) -> tuple[float, list[float], dict[tuple[str, str], float]]:
    """Forward and backward over all segmentations: log of their sum, the probability of each span, expected type changes.

    ``trans(p, t)`` is the weight of type ``t`` after ``p`` ("" at the start). Text of no type scores 0.
    """
    n = len(spans)
    order = sorted(range(n), key=lambda k: spans[k][:2])
    fwd, bwd = [0.0] * n, [0.0] * n
    ins: list[list[tuple[str, float]]] = [[] for _ in range(n)]
    for k in order:
        s, _, t = spans[k]
        ins[k] = [("", trans("", t))] + [(spans[j][2], fwd[j] + trans(spans[j][2], t)) for j in order if spans[j][1] <= s]
        fwd[k] = scores[k] + _lse([x for _, x in ins[k]])
    for k in reversed(order):
        _, e, t = spans[k]
        bwd[k] = _lse([0.0] + [trans(t, spans[j][2]) + scores[j] + bwd[j] for j in order if spans[j][0] >= e])
    z = _lse([0.0] + fwd)
    changes: dict[tuple[str, str], float] = defaultdict(float)
    for k in range(n):
        for p, x in ins[k]:
            changes[p, spans[k][2]] += math.exp(x + scores[k] + bwd[k] - z)
    return z, [math.exp(fwd[k] + bwd[k] - z) for k in range(n)], changes


def _gold_path(spans: list, gold: list[tuple[int, int, str]]) -> list[int]:
    """Of the spans with the right start and type, the longest is the value."""
    want = {(s, t) for s, _, t in gold}
    chosen: dict = {}
    for k, (s, e, t, _) in enumerate(spans):
        if (s, t) in want and ((s, t) not in chosen or e > spans[chosen[s, t]][1]):
            chosen[s, t] = k
    path = sorted(chosen.values(), key=lambda k: spans[k][0])
    return [k for i, k in enumerate(path) if not i or spans[path[i - 1]][1] <= spans[k][0]]


def fit(lines: list[tuple[str, list[tuple[int, int, str]], bool, bool]], given: frozenset, family: frozenset, rounds: int = 10, ridge: float = 2e-3, rate: float = 0.5) -> dict[str, float]:
    """Weights of greatest conditional likelihood, with a ridge, on lines ``(text, [(start, end, type)], first line?, name field?)``.

    Stochastic gradient with a step per weight: what is seen of each feature less what the model expects of it.
    """
    data = []
    for k, (text, gold, first, field) in enumerate(lines):
        # every third line is read without a dictionary, so that cues and shapes carry weight of their own
        g, f = (given, family) if k % 3 else (frozenset(), frozenset())
        spans = _candidates(text, 0, len(text), g, f, first, field, 15)
        if spans:
            data.append(([x[:3] for x in spans], [x[3] for x in spans], _gold_path(spans, gold)))
    w: dict[str, float] = defaultdict(float)
    seen: dict[str, float] = defaultdict(lambda: 1e-6)
    for _ in range(rounds):
        for spans, feats, path in data:
            _, prob, changes = lattice(spans, [sum(w[x] for x in fs) for fs in feats], lambda p, t: w[f"{p}>{t}"])
            up: dict[str, float] = defaultdict(float)
            for k, fs in enumerate(feats):
                d = (k in path) - prob[k]
                if abs(d) > 1e-6:
                    for x in fs:
                        up[x] += d
            for (p, t), v in changes.items():
                up[f"{p}>{t}"] -= v
            for i, k in enumerate(path):
                up[f"{spans[path[i - 1]][2] if i else ''}>{spans[k][2]}"] += 1
            for x, d in up.items():
                d -= ridge * w[x]
                seen[x] += d * d
                w[x] += rate * d / math.sqrt(seen[x])
    return {k: v for k, v in w.items() if v}


@lru_cache(maxsize=1)
def default_weights() -> tuple[tuple[str, float], ...]:
    """Weights fitted on the invented lines; a few seconds, once per driver."""
    from rankloom.llm import pii_training as t

    return tuple(sorted(fit(t.lines(), t.GIVEN, t.FAMILY).items()))


def find(text: str | None, weights: dict[str, float], given: frozenset, family: frozenset, name_field: bool = False) -> list[tuple[int, int, str]]:
    """``(start, end, type)`` of every personal value of a text, 0-based. None and empty texts have none."""
    if not text:
        return []
    out = []
    # only a text of several lines, or a name field, has a head line that may be a bare name
    bol, end, first = 0, len(text), name_field or "\n" in text
    while bol <= end:
        eol = text.find("\n", bol)
        if eol < 0:
            eol = end
        low = text[bol:eol].lower()
        if low and not low.isspace():
            words = set(_WORD.findall(low))
            # what a grammar needs is looked for before it is tried; a line that lacks it has no candidate of that grammar
            hints = 1 if "@" in low or "＠" in low or ("at" in words and ("dot" in words or "(" in low or "[" in low or "{" in low)) else 0
            if _SOME_DIGIT.search(low):
                if _DIGITS.search(low):
                    hints |= 2
                if not words.isdisjoint(_ADDRESS_WORDS) or any(w.endswith(_ADDRESS_ENDS) for w in words) or _ADDRESS_CODE.search(text, bol, eol):
                    hints |= 4
            if name_field or first or not (words.isdisjoint(given) and words.isdisjoint(family)) or _CAP_PAIR.search(text, bol, eol):
                hints |= 8
            if hints:
                spans = _candidates(text, bol, eol, given, family, first, name_field, hints)
                if spans:
                    out.extend((s, e, t) for s, e, t, _ in decode(spans, weights))
            first = False
        bol = eol + 1
    return out


def name_lookup(names: DataFrame, column: str, min_count: int = 1, limit: int = MAX_DICTIONARY) -> tuple[frozenset, frozenset, DataFrame | None]:
    """Given names and surnames counted over the whole name column: the most frequent of each, and the table of the rest.

    Only values of two capitalised words, neither in NOT_NAMES, are counted. At most ``limit`` words of each kind reach
    the driver; the others, if any, are ``(word, given, family)``, one row per word.
    """
    ok = names.select(F.lower(F.trim(column)).alias("n"), F.trim(column).alias("o")).where(
        F.col("o").rlike(r"^\p{Lu}[\p{L}'’]+ \p{Lu}[\p{L}'’]+$")
    )
    parts = ok.select(F.split("n", " ").alias("p"))
    out, rest = [], None
    for k in (0, 1):
        c = parts.select(F.col("p")[k].alias("w")).groupBy("w").count().where(F.col("count") >= (min_count if k == 0 else 1))
        rows = c.orderBy(F.desc("count"), "w").limit(limit + 1).collect()
        if len(rows) > limit:
            last = rows[limit - 1]
            after = (F.col("count") < last["count"]) | ((F.col("count") == last["count"]) & (F.col("w") > last["w"]))
            tail = c.where(after & ~F.col("w").isin(sorted(NOT_NAMES))).select(F.col("w").alias("word"), F.lit(k == 0).alias("given"), F.lit(k == 1).alias("family"))
            rest = tail if rest is None else rest.unionByName(tail)
        out.append(frozenset(r["w"] for r in rows[:limit] if r["w"] not in NOT_NAMES))
    if rest is not None:
        rest = rest.groupBy("word").agg(F.max("given").alias("given"), F.max("family").alias("family"))
    return out[0], out[1], rest


def name_dictionary(names: DataFrame, column: str, min_count: int = 1) -> tuple[frozenset, frozenset]:
    """The words of :func:`name_lookup` that are sent to every task."""
    return name_lookup(names, column, min_count)[:2]


def _row_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(r, w) for r, t in zip(pdf["row"], pdf["text"]) if t for w in {x.lower() for x in _WORD.findall(t)} | set(_WORD.findall(t.lower()))]
        yield pd.DataFrame(rows, columns=["row", "word"])


def _with_rest(texts: DataFrame, rest: DataFrame | None) -> DataFrame:
    """``texts``, and if there is a rest, the words of each row that are in it: arrays ``rest_given``, ``rest_family``."""
    if rest is None:
        return texts
    texts = materialize(texts.withColumn("row", F.monotonically_increasing_id()))
    hits = texts.select("row", "text").mapInPandas(_row_words, "row long, word string").join(rest, "word").groupBy("row")
    hits = hits.agg(*(F.collect_list(F.when(F.col(k), F.col("word"))).alias(f"rest_{k}") for k in ("given", "family")))
    return texts.join(hits, "row", "left").drop("row")


def _runner(weights: dict, given: frozenset, family: frozenset, redact: bool):
    def known(text: str | None, words: frozenset, more) -> frozenset:
        """The dictionary for one text: as it is, or its words in the text with those found by the join."""
        if not text or more is None or not len(more):
            return words
        return frozenset(w for w in {x.lower() for x in _WORD.findall(text)} | set(_WORD.findall(text.lower())) if w in words).union(more)

    def values(pdf: pd.DataFrame) -> Iterator[list]:
        none = [None] * len(pdf)
        for f, x, g, n in zip(pdf["field"], pdf["text"], pdf.get("rest_given", none), pdf.get("rest_family", none)):
            yield find(x, weights, known(x, given, g), known(x, family, n), (f or "").endswith(".name"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if redact:
                yield pdf[["field", "record_id"]].assign(text=[mask(t, v) for t, v in zip(pdf["text"], values(pdf))])
            else:
                rows = [(f, r, t, s + 1, e) for f, r, v in zip(pdf["field"], pdf["record_id"], values(pdf)) for s, e, t in v]
                yield pd.DataFrame(rows, columns=["field", "record_id", "pii_type", "start_pos", "end_pos"])

    return run


def mask(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """The text with each span replaced by ``[TYPE]``, all else as it was."""
    if not text:
        return text
    out, at = [], 0
    for s, e, t in spans:
        out += [text[at:s], f"[{t}]"]
        at = e
    return "".join(out) + text[at:]


def personal_values(texts: DataFrame, given: frozenset, family: frozenset, weights: dict | None = None, rest: DataFrame | None = None) -> DataFrame:
    """``texts(field, record_id, text)`` to one row per value: field, record_id, pii_type, start_pos, end_pos (1-based).

    Narrow: no shuffle (scans of few splits are spread first), unless the collection has names beyond the dictionary
    (``rest``), which are joined to the words of the texts. A field name ending in ``.name`` marks a name field. Null, empty and blank texts have no
    value; a repeated row gives repeated values; other columns are ignored; very long texts are read whole, line by line.
    """
    w = dict(default_weights()) if weights is None else weights
    schema = "field string, record_id string, pii_type string, start_pos int, end_pos int"
    return _with_rest(spread(texts.select("field", "record_id", "text")), rest).mapInPandas(_runner(w, given, family, False), schema)


def redacted(texts: DataFrame, given: frozenset, family: frozenset, weights: dict | None = None, rest: DataFrame | None = None) -> DataFrame:
    """``texts(field, record_id, text)`` with each personal value replaced by its type; null stays null."""
    w = dict(default_weights()) if weights is None else weights
    return _with_rest(texts.select("field", "record_id", "text"), rest).mapInPandas(
        _runner(w, given, family, True), "field string, record_id string, text string"
    )
