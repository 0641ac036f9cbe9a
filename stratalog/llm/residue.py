"""Records that hold template residue, filler, or an error or script notice in place of content."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.llm.literals import cover
from stratalog.session import staged
from stratalog.sources.tables import small, spread

# The grammar of notices, by kind: who says of itself what it can't do, or tells the reader to. These are
# the seeds; how the sites of a corpus word the rest of their notices is learnt from its counts (see ``residue``).
# Each is matched in one lower-cased sentence or line.

#: A page or entry that could not be had. The subject must be the page itself, at the start of the sentence.
_MISSING = (
    r"(?:sorry,? |oops[!,.]? |error:? )?(?:the|this|that|your|requested|die|la|el|cette|diese) ?(?:requested |angeforderte )?"
    r"(?:page|view|file|entry|snapshot|comparison|document|site|resource|url|link|address|record|result|item|report|branch|content|seite|datei|página|pagina|fichier)"
    r"(?: you (?:asked for|requested|are looking for))?(?: [/\w.-]+)?(?: on [\w.-]+)? "
    r"(?:could not|couldn't|cannot|can't|can not|was not|wasn't|is not able to|isn't able to|is not|isn't|has not been|failed to|is unable to|was unable to|does not|doesn't) "
    r"(?:be )?(?:found|shown|displayed|loaded|opened|reached|available|exist|load|open|accessible|accessed)\b"
)
ERROR = (
    _MISSING,
    r"/[\w./-]+ (?:could not|couldn't|cannot|can't|was not|is not able to|is not|wasn't) (?:be )?(?:found|shown|displayed|loaded|opened|reached|available)",
    r"(?:the )?(?:link|page|entry|file|address) (?:may|might) (?:be|have been|have) (?:broken|missing|moved|removed|deleted|renamed|expired)",
    r"the requested (?:document|page|file|resource|url|entry|item|record)\b.*\b(?:has been|was|is) (?:removed|moved|deleted|no longer)",
    r"(?:can'?t|cannot|could not|couldn't) find (?:what you|the page|that page|the file you)",
    r"(?:please )?(?:go back|return) to the (?:start|home|[\w-]+ home) page",
    r"(?:http )?[45]\d\d:? (?:not found|forbidden|unauthorized|bad (?:request|gateway)|internal server error|gateway time-?out|service unavailable|too many requests|gone|error)\b",
    r"^(?:error|http|code|status)(?: code)?:? [45]\d\d\b",
    r"<title>\s*[45]\d\d\b|<h1>\s*[45]\d\d\b",
    r"""\{\s*["'](?:error|status|code|message)["']\s*:.*["']?(?:code|status|message|error)["']?\s*:""",
    r"(?:oops!? ?)?something went wrong\b(?! when| if)",
    r"an (?:unexpected |internal |unknown )?error (?:has )?occurred",
    r"^(?:the|this) (?:application|service|server|site|program|process)\b.*\b(?:stopped|failed|closed|crashed|ended|terminated)\b.*\b(?=[0-9a-f]*\d)[0-9a-f]{6,}\W*$",
    r"\b(?:the|this) (?:site|server|service) (?:seems|appears) to be (?:offline|down|unavailable)",
    r"(?:the )?(?:\w+ )?service did not (?:answer|respond)",
    r"^(?:ray|request|reference|incident|trace)(?: id)?:? \(?[0-9a-f]{8,}\)?\.?$",
    r"fatal error: uncaught|^traceback \(most recent call last\)|exception in thread |^segmentation fault|stack trace:$",
    r"(?:you|users) must be (?:logged|signed) in to|(?:please )?(?:sign|log) in (?:again )?to (?:open|see|view|continue)|you (?:need|have) to (?:sign|log) in",
    r"your session (?:has |is )?(?:expired|timed out|ended)|^session expired",
    r"^access (?:is |was )?(?:denied|forbidden)|you (?:do not|don'?t) have (?:permission|access) to|you are not (?:allowed|authorized|authorised) to",
    r"^too many requests|rate limit (?:exceeded|reached)\.?$|^you have (?:made|sent) too many requests|wait \d+ seconds and (?:reload|retry|try)",
    r"\bwe are down for maintenance|(?:site|server|service|page) is (?:down|closed|offline|unavailable) for maintenance|under maintenance[.,;!]|will be back (?:soon|shortly|in \d)",
    r"^(?:try again (?:later|in)|go back or try again)|please try again (?:later|in \d)",
    r"es ist ein (?:\w+ )?fehler aufgetreten|seite (?:wurde )?nicht gefunden|die adresse /?\S+ existiert nicht|zugriff verweigert|ihre sitzung ist abgelaufen|sie sind (?:für .* )?nicht angemeldet|bitte melden sie sich|zu viele anfragen|wegen wartung|interner serverfehler|bitte laden sie \S+ neu",
    r"une erreur (?:\w+ )?(?:est survenue|s'est produite)|page introuvable|n'existe pas sur ce serveur|accès (?:refusé|interdit)|votre session a expiré|trop de requêtes|en maintenance|erreur interne du serveur|reconnectez-vous|n'a pas pu être (?:chargée?|affichée?|trouvée?)",
    r"no se encontró la página|página no encontrada|ha ocurrido un error|se ha producido un error|se produjo un error|acceso denegado|su sesión ha (?:caducado|expirado)|demasiadas solicitudes|error interno del servidor|en mantenimiento|vuelva al inicio|no se pudo (?:cargar|mostrar|abrir)",
)
#: A notice that scripts (or a newer browser) are required.
SCRIPT = (
    r"(?:please )?(?:enable|activate|allow|turn on|switch on|use)\b.{0,30}\b(?:javascript|scripts?|scripting|cookies)\b.{0,40}\b(?:to|and|before|in your browser|reload|continue)\b",
    r"you (?:need|have) to (?:turn on|enable|allow|activate|switch on) (?:javascript|scripts|scripting)",
    r"(?:this|our|the) (?:application|site|page|app|website) (?:requires|needs|does not work without|doesn't work without) (?:javascript|scripts)",
    r"your browser (?:is not supported|does not support|(?:or )?has (?:javascript|scripts|scripting) (?:disabled|switched off|turned off))|(?:javascript|scripts|scripting) (?:is|are|may be|seems|appears) (?:to be )?(?:disabled|switched off|turned off|blocked)",
    r"checking your browser before",
    r"(?:bitte )?(?:aktivieren|schalten) sie (?:bitte )?(?:javascript|skripte)|javascript (?:muss|ist) (?:aktiviert|erforderlich|deaktiviert)",
    r"(?:veuillez )?(?:activer|activez) (?:le )?javascript|javascript (?:est|doit être) (?:désactivé|activé|requis)",
    r"(?:active|habilite|activar|habilitar) (?:el )?javascript|javascript (?:está|debe estar) (?:desactivado|activado|habilitado)",
)
#: Text that stands in for text still to be written.
FILLER = (
    r"lorem ipsum dolor",
    r"this is (?:a )?(?:placeholder|dummy|filler|sample|example) (?:copy|text|content)|(?:placeholder|dummy|filler) (?:copy|text) (?:for|goes|here)|^(?:your |some )?(?:text|content) goes here|replace this (?:paragraph|text|line|section) with",
    r"blindtext|hier steht (?:später|bald) der text|platzhaltertext|beispieltext,? (?:bitte|für)|mustertext",
    r"texto de (?:ejemplo|relleno|prueba)\b.*(?:sustituir|reemplazar|cambiar|publicar)|^texto de (?:ejemplo|relleno)",
    r"texte (?:d'exemple|de remplissage|factice|provisoire|à remplacer)|(?:ce|le) texte (?:sera|est à) rempla|faux texte",
)
#: Values that never arrived: an absent value where a name or a number belongs.
_NOTHING = r"(?:undefined|null|none|nan|\[object object\])"
ABSENT = (
    r"\[object object\]",
    rf"^(?:dear|hello|hi|hallo|bonjour|hola|by|from|author|title|name|score|branch|total|date|status|reason|files?|lines?)[ :,]+{_NOTHING}\b",
    rf"\b(?:by|on branch|from snapshot|snapshot|compared|with|in|of) {_NOTHING}(?![\w'])(?! (?:check|value|guard|pointer|byte|object|safe|or|and the|as|is|are)).*(?<![\w'\"]){_NOTHING}(?![\w'])",
    rf"(?<![\w'\"`]){_NOTHING} (?:files?|lines?|differences|changes|deleted|added|results|hits|snapshots|items|entries|minutes|seconds|bytes|times)\b.*(?<![\w'\"]){_NOTHING}(?![\w'])",
    rf"^{_NOTHING}(?: {_NOTHING})+$|^{_NOTHING}, {_NOTHING}",
)
#: Unfilled blanks, matched in the line as written. Names hold letters, digits and ``_``.
BLANK = (
    r"\{\{[-#/ ]?\s*[\w.]+(?:\s*\|[^{}]{0,60})?\s*\}\}",
    r"\{%-?\s*[\w. ]{1,60}-?%\}",
    r"<%[=-]?\s*[\w.]{1,60}\s*-?%>",
    r"\$\{[\w.]{1,60}\}",
    r"#\{[\w.]{1,60}\}",
    r"@@[\w.]{1,60}@@",
    r"(?<![\w$])\$[A-Z][A-Z0-9_]{1,40}\$(?![\w$])",
    r"(?<![\w%])%[A-Z][A-Z0-9_]{1,40}%(?![\w%])",
    r"(?<!\w)__[A-Z][A-Z0-9_]{1,40}__(?!\w)",
    r"\[[A-Z][A-Z0-9_ ]{1,40} HERE\]",
    r"\[(?:insert|enter|add|your|fill in|replace)\b[\w ,'-]{1,60}\]",
    r"(?<![\w-])TBD-[A-Z][A-Z0-9_]*\b|(?:^|[:,#]\s*|\b(?:by|see|on|of|the|branch|before|from)\s+)TBD\b",
    r"(?:^|[:,#]\s*|\b(?:by|see|on|of|the|branch|before|from|Hello|Release|Fixes|Dear)\s+)TODO: (?:add|insert|fill in|write|name)\b",
    r"(?<![\wX-])X{3,}(?![\wX-])",
    r"(?<![\w)\]$%'\"])\{\d{1,2}\}(?![\w(\[])",
    r"(?<![\w<>)\]])<(?!(?:a|b|i|p|br|hr|li|ul|ol|td|tr|th|h\d|em|tt|pre|div|img|body|html|head|code|span|table|title|strong|script|style|details|summary>.*</summary|sub|sup|kbd|https?|int|str|string|void|t|k|v)\b)[a-z][a-z_]*(?: [a-z]+){0,3}>(?!\s*[(;{=])",
)
#: A sentence that by its grammar speaks of notices or filler, or reports a change to them, is no evidence of those: a
#: change and its object, a condition in front, a report, an example, a rule how a thing is shown. Blanks and absent
#: values are no words to speak with; where they are examples they stand in code or quotation marks.
_SPEAKS = re.compile(
    r"^\W*(?:(?:we|i|they|(?:this|the|a|one) (?:change|commit|patch|release|test|review|user)s?) (?:also |now )?)?(?:fix|remove|replace|add|move|rename|report|raise|update|use|document|improve|handle|test)(?:e?s|e?d)?\s+(?:the|an?|all|some|every|its|lorem|`|\d)"
    r"|^\W*when(?:ever)?\b|\b(?:users? reported|report(?:s|ed) that|(?:answer|respond)(?:s|ed) with|for example|e\.g\.|such as|(?:is|are) (?:stored|shown|expanded|replaced|treated) as|(?:page|handler)s? now (?:logs?|shows?)|works without|retr(?:y|ies|ied) on \d)\b",
    re.I,
)
#: Stretches of lower-cased text of which every match of the patterns above has at least one; a line without any is not
#: read further.
TRIGGERS = tuple(sorted(set().union(*(cover(x) for x in (*ERROR, *SCRIPT, *FILLER, *ABSENT, *BLANK)))))
_FENCE = re.compile(r"```|~~~")
_INLINE = re.compile(r"`[^`\n]*`")
_QUOTED = re.compile(r"[\"“”„«»][^\"“”„«»\n]{1,120}[\"“”„«»]")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[^\s])")
_WORD = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"\d+")
_KINDS = {"error": re.compile("|".join(f"(?:{x})" for x in ERROR)), "script": re.compile("|".join(f"(?:{x})" for x in SCRIPT)), "filler": re.compile("|".join(f"(?:{x})" for x in FILLER)), "absent": re.compile("|".join(f"(?:{x})" for x in ABSENT))}
_BLANKS = re.compile("|".join(f"(?:{x})" for x in BLANK))
#: Words of the Latin-like filler that the known opening words lead into are learnt from the corpus (at most FILLER_MOST,
#: those of most texts); of these words a text must have so many, making up so much of a line, to be filler without the opening.
_OPENING, FILLER_WORDS, FILLER_SHARE, FILLER_MOST = "lorem ipsum dolor", 6, 0.8, 5000
#: Words to an end of a sentence; texts and hosts with evidence that have a learnt end, and their share of all texts that have it.
END, LEARN_TEXTS, LEARN_HOSTS, LEARN_SHARE = 5, 5, 3, 0.9


def host(source: Column) -> Column:
    """One spelling for a source name."""
    return F.regexp_replace(F.lower(F.trim(source)), "-", "_")


def normal_line(line: str) -> str:
    """A line as it is counted: lower case, one blank between words, digits alike, outer blanks off."""
    return " ".join(_DIGITS.sub("0", line.lower()).split())


def _named(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def ends(prose: str) -> list[int]:
    """Names of the first and last END words of each sentence of a line, or of the whole sentence if it has no more.
    What is no plain word (numbers, paths, names of hosts) is alike; sentences of fewer than three words tell nothing."""
    out = []
    for sentence in _SENTENCE.split(_QUOTED.sub(" ", prose.lower())):
        words = [w if w.isalpha() else "#" for w in (x.strip(".,;:!?()[]'*>-") for x in sentence.split()) if w]
        if len(words) > END:
            out += [_named(" ".join(["<", *words[:END]])), _named(" ".join([*words[-END:], ">"]))]
        elif len(words) >= 3:
            out.append(_named(" ".join(words)))
    return out


def filler_words(docs: DataFrame, min_docs: int = 3, min_lift: float = 20.0, most: int = FILLER_MOST) -> list[str]:
    """Words that texts with the known opening of filler have and the rest of the corpus hardly has: those in at least
    ``min_docs`` such texts whose share of such texts is ``min_lift`` times their share of the others. The list is a
    model of at most ``most`` words, those of most texts."""
    texts = docs.select(F.lower("text").alias("t")).withColumn("opened", F.contains("t", F.lit(_OPENING)))
    words = F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(r"\p{L}{2,}"), 0))).alias("w")
    opened = staged(texts.filter("opened").select("t").distinct().select(words).groupBy("w").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs))
    if opened.isEmpty():
        return []
    a, b = texts.agg(F.count_if("opened"), F.count_if(~F.col("opened"))).first()
    others = texts.filter("not opened").select(words).join(small(opened.select("w")), "w").groupBy("w").agg(F.count("*").alias("m"))
    kept = opened.join(others, "w", "left").filter(F.col("n") / a >= min_lift * F.coalesce("m", F.lit(0)) / max(b, 1))
    return [r.w for r in kept.orderBy(F.col("n").desc(), "w").limit(most).collect()]


def residue(docs: DataFrame, min_docs: int = 20, min_share: float = 0.2, learn: bool = True) -> DataFrame:
    """(doc_id, kinds) of the records whose text, less the recurrent lines of their host, holds evidence of residue.

    ``docs`` has doc_id, text, source. ``kinds`` are among blank, absent, filler, error, script.

    1. Every text is read once where it lies, line by line and sentence by sentence, code blocks, inline code and
       quotations aside; a row for each line has its name, the seeds of evidence in it and, if its text has any, the
       ends of its sentences. Texts are never shuffled.
    2. Lines are counted by host, over different texts. One in at least ``min_docs`` texts and ``min_share`` of the texts
       of its host is boilerplate and subtracted with its evidence, be it navigation or a notice on every page.
    3. In what is left the ends of sentences are counted by host too. An end that LEARN_TEXTS texts with evidence in
       LEARN_HOSTS hosts have, and few others (LEARN_SHARE), is the wording of a notice: texts that have it are found as
       well, by the kind most of those texts are of. ``learn`` turns this off.

    A sentence that speaks of such things is no evidence. Null, empty and short texts without evidence are not found.
    """
    own = spread(docs.select("doc_id", "text", host(F.coalesce("source", F.lit(""))).alias("host")).filter("text is not null")).withColumn("key", F.xxhash64("text"))
    words = filler_words(own)
    lines = staged(own.mapInArrow(_lines(frozenset(words)), "doc_id long, host string, key long, line long, kinds array<string>, ends array<long>"))
    texts = small(lines.select("host", "key").distinct().groupBy("host").agg(F.count("*").alias("texts")))
    counts = lines.select("host", "line", "key").distinct().groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs)
    boilerplate = staged(counts.join(texts, "host").filter(F.col("n") >= min_share * F.col("texts")).select("host", "line"))
    less = lambda rows: rows.join(small(boilerplate), ["host", "line"], "left_anti")
    seeds = less(lines.filter("size(kinds) > 0")).select("doc_id", F.explode("kinds").alias("kind")).distinct()
    if not learn:
        return seeds.groupBy("doc_id").agg(F.sort_array(F.collect_set("kind")).alias("kinds"))
    seeds = staged(seeds)
    near = less(lines.filter("size(ends) > 0")).select("doc_id", "host", "key", F.explode("ends").alias("end")).distinct().join(seeds, "doc_id")
    near = near.groupBy("end", "kind").agg(F.count_distinct("key").alias("n"), F.collect_set("host").alias("hosts"))
    near = near.groupBy("end").agg(F.max_by("kind", F.struct("n", "kind")).alias("kind"), F.max("n").alias("n"), F.size(F.array_distinct(F.flatten(F.collect_list("hosts")))).alias("hosts"))
    near = staged(near.filter((F.col("n") >= LEARN_TEXTS) & (F.col("hosts") >= LEARN_HOSTS)).select("end", "kind", "n"))
    found = own.mapInArrow(_ends, "doc_id long, host string, key long, line long, end long").join(small(near.select("end")), "end")
    found = staged(less(found).select("doc_id", "key", "end").distinct())
    learnt = found.groupBy("end").agg(F.count_distinct("key").alias("all")).join(near, "end").filter(F.col("n") >= LEARN_SHARE * F.col("all")).select("end", "kind")
    more = found.join(small(learnt), "end").select("doc_id", "kind")
    return seeds.unionByName(more).groupBy("doc_id").agg(F.sort_array(F.collect_set("kind")).alias("kinds"))


def _lines(latin: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trigger = _trigger(latin)
        for batch in batches:
            rows = []
            for i, text, h, key in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "host", "key")], strict=True):
                kinds, prose = by_line(text, latin, trigger)
                for n, line in enumerate(text.replace("\r\n", "\n").split("\n")):
                    if line and (name := normal_line(line)):
                        rows.append((i, h, key, _named(name), sorted(kinds.get(n, ())), ends(prose[n]) if kinds else []))
            if rows:
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "host", "key", "line", "kinds", "ends"])

    return run


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i, text, h, key in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "host", "key")], strict=True):
            for line, prose in zip(text.replace("\r\n", "\n").split("\n"), prose_lines(text), strict=True):
                if prose and (found := ends(prose)):
                    name = _named(normal_line(line))
                    rows += [(i, h, key, name, x) for x in found]
        if rows:
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "host", "key", "line", "end"])


def _trigger(latin: frozenset[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for w in (*TRIGGERS, *latin):
        found.add_word(w, len(w))
    found.make_automaton()
    return found


_PLAIN = _trigger(frozenset())


def prose_lines(text: str) -> list[str]:
    """The lines of a text less what lies between fences of code or in inline code."""
    parts = _FENCE.split(text.replace("\r\n", "\n"))
    if len(parts) % 2:  # between a pair of fences lies code
        parts = [x if n % 2 == 0 else "\n" * x.count("\n") for n, x in enumerate(parts)]
    return _INLINE.sub(" ", "".join(parts)).split("\n")


def by_line(text: str, latin: frozenset[str] = frozenset(), trigger: ahocorasick.Automaton = _PLAIN) -> tuple[dict[int, set[str]], list[str]]:
    """(kinds of evidence of each line that has any, prose of all lines)."""
    found: dict[int, set[str]] = {}
    for n, line in enumerate(text.replace("\r\n", "\n").split("\n")):
        if _mashed(line):
            found.setdefault(n, set()).add("filler")
    lines = prose_lines(text)
    for n, line in enumerate(lines):
        if line and next(trigger.iter(line.lower()), None) is not None and (kinds := _line_evidence(line, latin)):
            found.setdefault(n, set()).update(kinds)
    return found, lines


def evidence(text: str, latin: frozenset[str] = frozenset(), trigger: ahocorasick.Automaton = _PLAIN) -> set[str]:
    """Kinds of the seeds of evidence in ``text``; ``latin``: words of filler in an invented language, known to ``trigger``."""
    return set().union(*by_line(text, latin, trigger)[0].values())


def _line_evidence(line: str, latin: frozenset[str]) -> set[str]:
    found: set[str] = set()
    if latin:
        words = [w.lower() for w in _WORD.findall(line)]
        if len(words) >= FILLER_WORDS and sum(w in latin for w in words) >= FILLER_SHARE * len(words):
            found.add("filler")
    for sentence in _SENTENCE.split(line):
        if next(_PLAIN.iter(sentence.lower()), None) is None:
            continue
        if _BLANKS.search(sentence):
            found.add("blank")
        speaks = _SPEAKS.search(sentence) is not None
        whole = sentence.lower().strip(" \t-*#>|")
        low = whole if "{" in whole else _QUOTED.sub(" ", whole)
        for kind, pattern in _KINDS.items():
            if kind not in found and not (speaks and kind != "absent") and pattern.search(low):
                found.add(kind)
    return found


def _mashed(line: str) -> bool:
    """A line is a few words over and over: keyboard rows, test words, or one sentence repeated."""
    words = line.lower().split(maxsplit=6)
    if len(words) < 6:
        return False
    if words[0].strip(".,") in _MASH and words[1].strip(".,") in _MASH:
        kinds = {w.lower() for w in _WORD.findall(line)}
        if kinds <= _MASH:
            return True
    if line.count(words[0].title()) + line.count(words[0]) < 3:
        return False
    sentences = [s.strip().lower() for s in _SENTENCE.split(line) if s.strip()]
    return len(sentences) >= 3 and len(set(sentences)) == 1


#: Words typed to fill a field.
_MASH = frozenset("foo bar baz qux blah test testing asdf qwer qwerty jkl hjkl zxcv asd qwe abc xyz yxcv lkj dfg fgh sdf hello world text sample".split())
