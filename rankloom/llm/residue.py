"""Template residue, filler, error pages and script notices in documents.

Every sentence of every document is masked (template fields, mail and web addresses, dates, numbers), reduced to a key
without letter case, punctuation, lead-in, subject and code, and hashed; equal hashes are grouped over all documents,
sources, kinds of document and languages. Groups are classified in two ways. Placeholder and phrase rules name the kind
of a message whatever its number. A message in wording that no rule lists is boilerplate if its group recurs widely:
in enough documents to tell, spread over sources, kinds and languages as the corpus itself is. What documents say
themselves is bound to their kind or language; notices, navigation and error text of a site are not. A sentence that
reports on such things (first person, or opened by a verb of work) is no residue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.session import bounded_broadcast, materialize, spread

#: Documents that a group needs before its spread says anything.
LEAST_DOCS = 8
#: Divergence (nats, less its bias for small groups) between a group's documents and the corpus in each dimension, at most.
MOST_BOUND = 0.4
#: A group whose messages bear an apology or a code, in at least this share of its documents, needs fewer documents and two sources.
SIGNED_SHARE = 0.05
SIGNED_DOCS = 3
#: Lines of a document that are worked on together; a longer document is taken in blocks.
BLOCK_LINES = 2_000
FIELD = "⟦field⟧"

_FIELD_WORDS = (
    "first|last|middle|full|given|family|name|surname|company|employer|organi[sz]ation|firm|department|city|town|manager|role|title|position|salary|range|start|"
    "date|candidate|applicant|recipient|sender|address|phone|email|job|insert|your|here|ihr|ihre|vorname|nachname|firma|firmenname|anrede|kandidatenname|abteilung|ort|stadt|datum|gehalt|stelle|"
    "ansprechpartner|ansprechpartnerin|nombre|apellido|empresa|puesto|ciudad|fecha|salario|departamento|responsable|nom|pr[ée]nom|entreprise|soci[ée]t[ée]|ville|poste|"
    "salaire|service"
)
#: Marks that only a template has, whatever stands between them.
_MARKS = (
    r"\{\{[^{}\n]{0,60}\}\}|\$\{[^{}\n]{0,60}\}|\[\[[^\[\]\n]{0,60}\]\]|<<[^<>\n]{0,60}>>|<%[^%\n]{0,60}%>|@@\w+@@|\$\$\w+\$\$|%%?[A-Za-z][A-Za-z_]+%%?|"
    r"\*\|\w+\|\*|__[A-Za-z][A-Za-z_]*[A-Za-z]__|\{[A-Za-z_]\w*\}|\{\d+\}|#(?i:REF|NAME|VALUE|N/A)[!?]|\b(?i:XX/XX/XX(?:XX)?)\b"
)
#: Brackets that are template fields only around the name of a field.
_BRACKETS = (
    r"\[(?i:[^\[\]\n]{0,40}\b(?:" + _FIELD_WORDS + r")\b[^\[\]\n]{0,40})\]|<(?i:[\p{L} ._-]{0,40}\b(?:" + _FIELD_WORDS + r")\b[\p{L} ._-]{0,40})>|"
    r"«(?i:[\p{L} ._-]{0,40}\b(?:" + _FIELD_WORDS + r")\b[\p{L} ._-]{0,40})»|"
    r"\((?i:[\p{L} ._-]{1,40} (?:goes|comes) here)\)|\((?i:insert [\p{L} ._-]{1,40})\)"
)
_UNDEFINED = r"\b(?i:undefined)\b(?! (?:behaviou?r|terms?|variables?|values?|references?|symbols?))|\b(?:Hello|Dear|Hi|in|to|at|with|for|regards,|date|Salary:) (?:undefined|null|NaN|None)\b"
PLACEHOLDER = f"(?:{_MARKS}|{_BRACKETS})"
#: A field that is spoken of: fields like X, swaps X for, leftover X tags, X paths in scripts.
_MENTION = (
    r"(?i)\b(?:fields?|tags?|placeholders?|variables?|tokens?|markers?|templates?)\b[^.]{0,20}?\b(?:like|such as|named|called)\s+⟦field⟧"
    r"|\b(?:swaps?|swapped|swapping|replac\w+|remov\w+|stripp?\w*|delet\w+|clean\w+|fill\w*|turn\w*|render\w*|pars\w+)\s+(?:\w+\s+){0,2}?⟦field⟧(?=\s+(?:for|with|by|paths?|tags?|fields?|markers?|placeholders?|variables?|into)\b)"
)

_LATIN = (
    "lorem|ipsum|dolor|sit|amet|consectetur|adipiscing|elit|sed|do|eiusmod|tempor|incididunt|ut|labore|et|dolore|magna|aliqua|enim|minim|veniam|quis|nostrud|"
    "exercitation|ullamco|laboris|nisi|aliquip|ex|ea|commodo|consequat|duis|aute|irure|in|reprehenderit|voluptate|velit|esse|cillum|eu|fugiat|nulla|pariatur|excepteur|"
    "sint|occaecat|cupidatat|non|proident|sunt|culpa|qui|officia|deserunt|mollit|anim|id|est|laborum|felis|mollis|augue|odio|vitae|massa|netus|lectus|risus|porta|"
    "vestibulum|praesent|mauris|pellentesque|curabitur|vivamus|fusce|donec|integer|nunc|orci|urna|turpis|tellus|justo|ligula|metus|nibh|quam|sapien|sem|tortor|ultrices|"
    "viverra|volutpat|ac|at|ante|arcu|bibendum|blandit|congue|cras|cursus|diam|dictum|dui|egestas|eget|eros|erat|etiam|facilisis|faucibus|gravida|habitant|hendrerit|"
    "iaculis|imperdiet|interdum|lacinia|lacus|leo|libero|lobortis|luctus|maecenas|malesuada|mattis|mi|morbi|neque|nec|pharetra|placerat|posuere|pretium|proin|pulvinar|"
    "purus|quisque|rhoncus|rutrum|sagittis|scelerisque|semper|senectus|sodales|sollicitudin|suscipit|suspendisse|tempus|tincidunt|tristique|ultricies|varius|vehicula|vel"
)
_FILLER = (
    r"(?:\b(?:" + _LATIN + r")\b[\s,.;]*){5,}|(?:\b(?:sample|dummy|example) text\b\W*){2,}|\byour (?:text|content|title|summary) (?:goes )?here\b|"
    r"\b(?:heading|headline|subheading|body copy|body text|caption|title|text|copy|content) goes here\b|\bthis is (?:a |some )?(?:placeholder|dummy|filler|sample) (?:paragraph|text|copy)\b|"
    r"^\W*(?:add|enter|write|paste|put|insert|type|describe) (?:[\w'’-]+ ){1,6}(?:here\W*$|in (?:place of )?this (?:line|space|box|field|block)\b|and delete this (?:hint|line|note|text)\b|\(max\b)|"
    r"(?:\btest\b\W*){3,}|\bplease ignore this (?:test )?(?:posting|page|document|entry)\b|"
    r"\breplace this (?:block|text|paragraph|section|line)\b|\bedit it before you publish\b|\bdescribe your (?:\w+ ){1,4}here\b|\btype your (?:\w+ ){1,4}in(?:to)? this (?:box|field)\b|"
    r"^\W*(?:todo|tbd|fixme)\b ?(?:[:–-]|\W*$)|^\W*to be (?:determined|completed|added)\W*$|"
    r"\bblindtext\b|\btexto de (?:ejemplo|relleno)\b|\bsustituya este\b|\btexte (?:factice|d'exemple)\b|^\W*bullet (?:one|two|three|four|five)\b|(?:\basdf\w*\b\W*){2,}|(?:\bblah\b\W*){2,}|^\W*use action words\W*$"
)
_SCRIPT_WORD = r"(?:java ?scripts?|(?:client-side |browser )?script(?:s|ing)|active content|js)"
_SCRIPT = (
    r"(?:^\W*|\b(?:please|need to|have to|must|then|and|or|nothing happens,|veuillez|bitte|por favor,?|you can) )(?:enable|activate|turn on|switch on|allow|activez|activer|active|aktivieren sie|aktivieren|habilite) "
    r"(?:\w+ )?" + _SCRIPT_WORD + r"\b|\b(?:site|page|viewer|form|application|portal|app) (?:needs|requires|uses|relies on|works best with) " + _SCRIPT_WORD + r"\b|"
    r"\bmust have " + _SCRIPT_WORD + r" (?:switched|turned) on\b|\b" + _SCRIPT_WORD + r" (?:seems? to be|appears? to be|is|are|has been) (?:turned off|switched off|disabled|blocked)\b|"
    r"\bbrowser (?:does not|doesn't|cannot|can't) (?:support|run) " + _SCRIPT_WORD + r"\b|\bturn (?:them|it) on in your browser\b|\bcookies and scripts\b[^.]{0,60}\bblocked\b"
)
_THING = (
    r"(?:page|pages|site|server|posting|vacancy|resume|profile|document|file viewer|file|application form|form|candidate search|search|offer|oferta|seite|p[áa]gina|link|job)"
)
_FAILED = (
    r"(?:(?:could not|cannot|can't) be (?:found|shown|converted|loaded|opened|reached|displayed)|does not exist|do(?:es)? not exist on this server|is no longer available|ya no est[áa] disponible|has expired|does(?:n't| not) exist|"
    r"(?:is|was|are) not (?:available|accessible|reachable)|(?:was|has been) (?:removed|deleted)|existiert nicht|ist nicht (?:mehr )?verf[üu]gbar|wurde (?:entfernt|gel[öo]scht)|no existe|n'existe (?:pas|plus)|"
    r"no est[áa] disponible|n'est (?:pas|plus) disponible|est indisponible|expired|"
    r"(?:was|has been) moved or deleted|has wandered off|is (?:currently |temporarily )?unavailable|is blocked from|failed with an? (?:unexpected|internal|unknown) error|timed out|"
    r"stopped responding|returned an empty (?:reply|response)|not found|no encontrada|nicht gefunden|(?:est )?introuvable)\b"
)
_ERROR = (
    r"^\W*(?:http )?(?:status |error |erreur |fehler )?9\W{1,3}(?:not found|bad gateway|forbidden|unauthori[sz]ed|internal|service unavailable|gateway time-?out|too many requests|gone)\b|"
    r"^\W*(?:http status|error|erreur|fatal|fehler)\b ?(?:9\w*)? ?[:–-]|^\W*(?:fatal|error) ?:?\W*$|"
    r"\b" + _THING + r"\b[^.]{0,60}?\b" + _FAILED + r"|^\W*(?:access|permission|zugriff|acceso|acc[èe]s) (?:denied|forbidden|verweigert|denegado|refus[ée])\W*$|"
    r"^\W*(?:page|session|link|token) (?:has )?expired\W*$|^\W*(?:bad request|method not allowed|precondition failed|service unavailable|internal server error|gateway time-?out|not found|unauthori[sz]ed|forbidden)\W*$|"
    r"\b(?:you are|you're) not (?:authori[sz]ed|allowed|permitted) to (?:open|view|access)\b|\bunable to (?:load|open|connect|retrieve|process|display)\b[^.]{0,40}\b(?:page|request|file|content|data|resource|server|database)\b|"
    r"^\W*(?:an )?(?:unexpected|unknown|internal|fatal) (?:error|exception)\b|\betwas ist schief\s?gelaufen\b|\balgo (?:ha salido|sali[óo]) mal\b|\b(?:site|page|server) is under maintenance\b|"
    r"^\W*please (?:go back and )?try again(?: later)?\W*$|^\W*our engineers have been (?:told|notified)\W*$|^\W*try reloading\W*$|^\W*incident 9-9\W*$|\bin your browser(?: settings)?,? (?:and|then) (?:reload|refresh)\b|"
    r"\byou do not have permission to (?:open|view|access)\b|^\W*request blocked\W*$|^\W*too many requests\W*$|"
    r"\bslow down and try again\b|\byour session has (?:expired|timed out)\b|^\W*bad gateway\W*$|\bproxy got an invalid reply\b|\bdown for (?:planned |scheduled )?maintenance\b|"
    r"^\W*traceback \(most recent call last\)|^\W*file \"?\w+\"?, line 9, in |^\W*(?:key|value|type|index|attribute|name|runtime)error\b|\bunsupported or damaged file\b|"
    r"\b(?:prove|verify|confirm) that you are (?:not a robot|human)\b|\bsomething went wrong\b|\bcontact (?:support|the site owner) (?:and quote|with request)\b"
)
#: Interjections count where they are a line of their own: inside other text they are too common.
_WEAK = r"^\W*(?:whoops|oops|hmm|uh-oh)\W*$"
#: Reports of work: an action verb in the past first, or talk of such things; "was the title of", "every night until I".
_TALK = (
    r"^\W*(?:(?:experience|project) 9 ?: )?(?!(?:unsupported|blocked|denied|failed|disabled|damaged|expired|need|required|unexpected)\b)(?:\w+ed|built|cut|wrote|led|taught|typeset|kept|ran|made|set|gave|rewrote)\b|"
    r"\bwas the (?:title|name|subject)\b|\b(?:until|when|while) i\b|\bbans?\b|\b(?:is|are) required for this post\b|\bmy (?:thesis|first|last)\b|\bnot found (?:screen|page that)\b"
)
#: Past forms of common English verbs that do not end in -ed (fixed values), for messages in unlisted wording.
_IRREGULAR = (
    "became began bent bought bound brought built came caught chose cut did drew drove fed fell felt fought found gave grew had heard held hid hit kept knew laid led left lent let lit lost made meant met "
    "paid put ran read rode rose said sat saw sent set shot shut sold sought spent split spoke spread stood stuck swept taught thought threw told took tore typeset understood went withdrew woke won wore wove wrote"
)
#: Opened by a verb of work (past, or third person); or by someone speaking of themselves.
_REPORT = r"^(?:9 )?(?:\w+ed|\w+[^s\W]s|" + _IRREGULAR.replace(" ", "|") + r")\b"
_SPEAKER = ("i", "my", "me", "mine", "we", "our", "us", "he", "his", "she", "her")
_SPOKEN = r"\b(?:" + "|".join(_SPEAKER) + r")\b"
#: At least two words of three letters.
_WORDY = r"^(?:\S{1,2} )*\S{3,} (?:\S{1,2} )*\S{3,}"
#: Words before a message that are no part of it, and those of them that only an apology has.
_SORRY = r"(?:sorry|whoops|oops|hmm|uh-oh|désolée?|lo sentimos|lo siento|entschuldigung)"
_LEAD = r"^\W*(?:(?:notice|note|warning|attention|alert|hinweis|achtung|aviso|" + _SORRY + r")\W*[:,.!–-]\W*)+"
_CODE = r"\W*\((?:error |status )?(?:code|error|status|ref|reference|incident|fehler|erreur) ?[:#]? ?[\w-]*9[\w-]*\)\W*$"
_SIGNED = r"^\W*(?:(?:notice|note|warning|attention|alert)\W+)?" + _SORRY + r"\W*[:,.!–-]|" + _CODE
_SUBJECT = r"^(?:(?:the|our|this|that|your|requested) ){0,2}" + _THING + r"(?: you \w+(?: for)?)?\b"
_HINT_MARKS = r"[\[\](){}<>%$@#_*«]"
#: Words one of which every message of a phrase rule has, unless it has a mark, opens with one of _HINT_FIRST or holds five words of the filler's
#: list. They only save trying the rules: a message with none of these is masked, grouped and classified by its spread like all else.
_HINT_WORDS = tuple(
    """xx undefined null nan none here goes sample dummy example placeholder filler test ignore replace publish todo tbd fixme determined completed added blindtext ejemplo exemple relleno sustituya factice bullet blah action
    content java javascript javascripts script scripts scripting js browser found gateway forbidden unauthorized unauthorised internal unavailable requests gone status http error erreur fehler fatal exception
    shown converted loaded opened reached displayed exist disponible moved deleted removed wandered blocked failed timed responding empty available accessible reachable expired existiert verfügbar verfugbar entfernt gelöscht geloscht
    existe indisponible encontrada gefunden introuvable denied verweigert denegado refusé refuse request allowed authorized authorised permitted unable schief schiefgelaufen mal maintenance again engineers reloading incident
    permission proxy traceback keyerror valueerror typeerror indexerror attributeerror nameerror runtimeerror damaged robot human wrong quote whoops oops hmm uh sorry désolé désolée sentimos siento entschuldigung""".split()
)
_HINT_FIRST = ("file", "add", "enter", "write", "paste", "put", "insert", "type", "describe", "asdf")
_LATIN_WORDS = tuple(_LATIN.split("|"))


def worded(tokens: Column) -> Column:
    """Whether a phrase rule can match a sentence, told by its words."""
    some = F.exists(tokens, lambda w: w.isin(*_HINT_WORDS) | w.startswith("asdf"))
    return some | F.get(tokens, F.lit(0)).isin(*_HINT_FIRST) | (F.size(F.filter(tokens, lambda w: w.isin(*_LATIN_WORDS))) >= 5)


_NUMBER = r"\b[0-9a-f]*\d[0-9a-f]*\b"


def sentences(text: Column) -> Column:
    """The sentences of a line: cut after a full stop, exclamation or question mark and a blank."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])[ \t]+"), F.trim), lambda s: s != "")


def masked(sentence: Column) -> Column:
    """Template fields, mail and web addresses, dates and numbers made equal; blanks collapsed. What a sentence cannot hold is not looked for."""
    fields = F.when(sentence.rlike(_HINT_MARKS + "|(?i:XX/)"), F.regexp_replace(sentence, PLACEHOLDER, FIELD)).otherwise(sentence)
    named = _once(fields, lambda s: F.when(s.rlike("(?i:undefined|null|nan|none)"), F.regexp_replace(s, _UNDEFINED, FIELD)).otherwise(s))
    mailed = _once(named, lambda s: F.when(s.contains("@"), F.regexp_replace(s, r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", "‹mail›")).otherwise(s))
    return _once(mailed, lambda s: F.trim(F.regexp_replace(_numbered(s), r"\s+", " ")))


def _once(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _numbered(s: Column) -> Column:
    """Web addresses, dates and numbers made equal."""
    linked = F.when(s.contains("://") | s.contains("www."), F.regexp_replace(s, r"(?:https?://|www\.)\S+", "‹url›")).otherwise(s)
    dated = F.regexp_replace(linked, r"\b\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}\b", "‹date›")
    return F.when(s.rlike(r"\d"), F.regexp_replace(dated, _NUMBER, "9")).otherwise(linked)


def classify(message: Column, low: Column, words: Column, alone: Column) -> Column:
    """``field``, ``filler``, ``script`` or ``error``; null if no rule names the message.

    ``low``: it in lower case; ``words``: a phrase rule can match it; ``alone``: it is its whole line.
    """
    by_word = F.when(~words | low.rlike(_TALK), F.lit(None).cast("string")).when(low.rlike(_FILLER), "filler").when(low.rlike(_SCRIPT), "script").when(low.rlike(_ERROR), "error")
    named = F.when(message.contains(FIELD) & F.regexp_replace(message, _MENTION, "").contains(FIELD), "field").otherwise(by_word)
    return F.coalesce(named, F.when(words & alone & low.rlike(_WEAK), "error"))


def _steps(sents: Column, part: Column) -> Column:
    """The array of ``(s, alone)`` taken step by step to ``(h, h2, kind, signed, plain, message)``.

    ``plain``: several words, no report, and not all that its document says (``part``).

    Each step is a pass over the array, so that its result is worked out once and not again wherever it is used.
    """
    words = lambda c: F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " "))
    x = F.transform(sents, lambda e: F.struct(e["s"].alias("s"), e["alone"].alias("alone"), F.lower(e["s"]).alias("low")))
    x = F.transform(x, lambda e: e.withField("norm", words(e["low"])))
    x = F.transform(x, lambda e: e.withField("told", _once(F.split(e["norm"], " "), lambda ts: F.struct(worded(ts).alias("words"), F.exists(ts, lambda w: w.isin(*_SPEAKER)).alias("speaker")))))
    x = F.transform(x, lambda e: e.withField("message", F.when(e["told"]["words"] | e["low"].rlike(_HINT_MARKS), masked(e["s"]))))
    x = F.transform(x, lambda e: e.withField("text", F.coalesce(F.lower(e["message"]), _numbered(e["low"]))))
    x = F.transform(x, lambda e: e.withField("kind", F.when(e["message"].isNotNull(), classify(e["message"], e["text"], e["told"]["words"], e["alone"]))).withField("led", F.regexp_replace(e["text"], _LEAD, "")))
    # most sentences are already bare
    x = F.transform(x, lambda e: e.withField("bare", F.when(e["led"] == e["low"], e["norm"]).otherwise(words(F.when(e["led"].contains("("), F.regexp_replace(e["led"], _CODE, "")).otherwise(e["led"])))))
    x = F.transform(x, lambda e: e.withField("key", F.when(e["bare"] == "", words(e["text"])).otherwise(F.regexp_replace(e["bare"], _SUBJECT, "‹thing›"))))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.transform(
        x,
        lambda e: F.struct(
            F.xxhash64(e["key"]).alias("h"), F.crc32(e["key"]).alias("h2"), e["kind"].alias("kind"), yes(F.when(e["message"].isNotNull(), e["text"].rlike(_SIGNED))).alias("signed"),
            (part & ~(e["told"]["speaker"] & e["key"].rlike(_SPOKEN)) & e["key"].rlike(_WORDY) & ~e["key"].rlike(_REPORT) & ~yes(F.when(e["message"].isNotNull(), e["text"].rlike(_TALK)))).alias("plain"),
            F.coalesce(e["message"], e["key"]).alias("message"),
        ),
    )


def _sentences(docs: DataFrame, id_col: str, text_col: str, dims: dict[str, str], with_text: bool) -> DataFrame:
    """One row per sentence of each document: its hashes, its kind by rule, and the document's dimensions."""
    named = docs.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), *[F.coalesce(F.lower(F.trim(F.col(c).cast("string"))), F.lit("")).alias(k) for k, c in dims.items()], F.col(text_col).alias("_text")
    )
    whole = spread(named).select("doc_id", *dims, F.filter(F.split("_text", r"\n+"), lambda x: x != "").alias("lines"))
    part = (F.size("lines") > 1) | (F.size(sentences(F.get("lines", F.lit(0)))) > 1)
    last = F.greatest(F.ceil(F.size("lines") / BLOCK_LINES).cast("int") - 1, F.lit(0))
    blocks = whole.select("doc_id", *dims, "lines", part.alias("part"), F.explode(F.sequence(F.lit(0), last)).alias("block"))
    parted = F.transform(F.slice("lines", F.col("block") * BLOCK_LINES + 1, BLOCK_LINES), lambda x: F.struct(sentences(x).alias("ss")))
    flat = F.flatten(F.transform(parted, lambda p: F.transform(p["ss"], lambda s: F.struct(s.alias("s"), (F.size(p["ss"]) == 1).alias("alone")))))
    every = blocks.select("doc_id", *dims, F.inline(_steps(flat, F.col("part"))))
    return every if with_text else every.drop("message")


def _told(said: DataFrame, dims: list[str]) -> DataFrame:
    """The groups that are residue by their recurrence: ``(h, h2, told)``.

    Groups are reduced to counts per combination of their dimensions before anything else, so a message that a third of all
    documents bear is a few rows. Only groups of enough documents are then compared with the corpus.
    """
    counts = said.where("plain").groupBy("h", "h2", *dims).agg(F.count_distinct("doc_id").alias("n"), F.sum(F.col("signed").cast("int")).alias("signed"))
    counts = materialize(counts)
    sources = F.count_distinct(F.when(F.col("source") != "", F.col("source")))
    groups = counts.groupBy("h", "h2").agg(F.sum("n").alias("docs"), F.sum("signed").alias("signed"), sources.alias("sources"))
    groups = materialize(groups.where(F.col("docs") >= SIGNED_DOCS))
    signed = groups.where((F.col("sources") >= 2) & (F.col("signed") >= F.greatest(F.lit(1.0), F.col("docs") * SIGNED_SHARE))).select("h", "h2", F.lit("error").alias("told"))
    if len(dims) < 2:
        return signed
    parts = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("value")) for d in dims]))
    totals = said.select("doc_id", *dims).distinct().select(parts.alias("p")).groupBy("p.dim", "p.value").agg(F.count(F.lit(1)).alias("m"))
    totals = totals.join(totals.groupBy("dim").agg(F.sum("m").alias("of"), F.count(F.lit(1)).alias("values")), "dim").where("values > 1")
    many = groups.where(F.col("docs") >= LEAST_DOCS).select("h", "h2", "docs")
    cells = counts.join(many, ["h", "h2"]).select("h", "h2", "docs", "n", parts.alias("p")).groupBy("h", "h2", "docs", "p.dim", "p.value").agg(F.sum("n").alias("n"))
    share = F.col("n") / F.col("docs")
    bound = cells.join(totals, ["dim", "value"]).groupBy("h", "h2", "docs", "dim").agg(
        (F.sum(share * F.log(share * F.col("of") / F.col("m"))) - (F.count(F.lit(1)) - 1) / (2 * F.first("docs"))).alias("bound")
    )
    spread = bound.groupBy("h", "h2").agg(F.max("bound").alias("bound"), F.count(F.lit(1)).alias("d")).where((F.col("bound") <= MOST_BOUND) & (F.col("d") == len(dims)))
    return spread.select("h", "h2", F.lit("recurring").alias("told")).unionByName(signed).groupBy("h", "h2").agg(F.min("told").alias("told"))


def _hits(said: DataFrame, dims: list[str]) -> DataFrame:
    """The rows of ``said`` that are residue, with their kind."""
    told = bounded_broadcast(materialize(_told(said, dims)))
    by_rule = said.where(F.col("kind").isNotNull())
    by_group = said.where(F.col("kind").isNull() & F.col("plain")).drop("kind").join(told, ["h", "h2"]).withColumnRenamed("told", "kind")
    return by_rule.unionByName(by_group)


def _dims(source_col: str, bound_cols: tuple[str, ...]) -> dict[str, str]:
    return {"source": source_col} | {f"dim{k}": c for k, c in enumerate(bound_cols)}


def residue_messages(docs: DataFrame, id_col: str, text_col: str, source_col: str, bound_cols: tuple[str, ...] = ()) -> DataFrame:
    """Each group of residue messages (as worded in one of them) with its kind and the number of its documents and sources."""
    dims = _dims(source_col, bound_cols)
    hits = _hits(materialize(_sentences(docs, id_col, text_col, dims, True)), list(dims))
    one = hits.groupBy("h", "h2", "kind", "source", "doc_id").agg(F.min("message").alias("message"))
    by_source = one.groupBy("h", "h2", "kind", "source").agg(F.min("message").alias("message"), F.count(F.lit(1)).alias("docs"))
    groups = by_source.groupBy("h", "h2", "kind").agg(F.min("message").alias("message"), F.sum("docs").alias("docs"), F.count_if(F.col("source") != "").alias("sources"))
    return groups.select("message", "docs", "sources", "kind")


def residue_documents(docs: DataFrame, id_col: str, text_col: str, source_col: str, bound_cols: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, kind)`` of each document with a residue message, one row per kind found in it.

    ``bound_cols`` are columns that what documents say is bound to (kind of document, language); without them recurrence tells
    only messages with an apology or a code. Null and empty texts have no message, rows with a null id are left out; a null
    dimension is a value of its own, but a null source is no source; repeated rows count once; sentences of any length are
    read; other columns are ignored; an empty table gives an empty result.

    Plan: splitting, masking, rules and keys stay in the JVM and run once, as passes over one array a block of lines. Rows of
    hashes, without text, are written to the shared folder and shuffled once by hash, dimensions and document with partial
    aggregation, then once by hash as counts; the residue groups join back by broadcast if they are few.
    """
    dims = _dims(source_col, bound_cols)
    return _hits(materialize(_sentences(docs, id_col, text_col, dims, False)), list(dims)).select("doc_id", "kind").distinct()


def without_residue(docs: DataFrame, id_col: str, text_col: str, source_col: str, bound_cols: tuple[str, ...] = ()) -> DataFrame:
    """The corpus without the documents that have residue."""
    bad = residue_documents(docs, id_col, text_col, source_col, bound_cols).select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(bad, id_col, "left_anti")
