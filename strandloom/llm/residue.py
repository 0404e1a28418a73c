"""Template residue, filler text, error pages and script notices that stand where a commit's content should be.

Records are cut into units (lines and sentences of what precedes the diff), each in the message or out of place
(where the diff or a whole commit should be). What is residue is induced from all records:

- slots: units of different records that agree but for one token are aligned on it. A slot that keeps a variable's
  name, a default or a blank is unfilled where it comes in several notations, where other records fill it, or where
  the unit holds hardly anything else.
- pages: words, word pairs and lines that stand out of place far more often than the message's own words do, by a
  likelihood ratio. A unit made of these is a line of an error page, notice or filler, in whatever record.
- gibberish: units whose words no other record has, measured against how often that happens by chance.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import lookup_join, semi_join
from ..session import cut_lineage

# Notations of an unfilled place.
PLACEHOLDERS = [
    r"\$\{[^{}\n]*\}",  # ${name}
    r"\{\{[^{}\n]*\}\}",  # {{ name }}
    r"<%[^%<>\n]*%>",  # <%= name %>
    r"\{%[^%{}\n]*%\}",  # {% name %}
    r"~~\w+~~",  # ~~name~~
    r"#\{[^{}\n]*\}",  # #{name}
    r"\{[A-Za-z0-9_.]*\}",  # {name}, {0}
    r"<<[^<>\n]+>>",  # <<name>>
    r"\[\[[^\[\]\n]+\]\]",  # [[name]]
    r"<(?!/|!|(?:html|head|title|body|pre|hr|h[1-6]|p|b|br|div|noscript|a|i|li|ul|table|tr|td|span)\b)[^<>@/=\n]{2,}>",  # <a name>
    r"\[(?!PATCH|RFC|skip |ci )[^\[\]\n]*[^\[\]\n ] [^\[\]\n]+\]",  # [your name]
    r"\[object Object\]",
    r"【[^】\n]+】",
    r"@@\w+@@",  # @@NAME@@
    r"(?<![\w@])@[A-Za-z_]+@(?![\w@])",  # @NAME@
    r"__[A-Za-z][A-Za-z_]*[A-Za-z]__",  # __NAME__
    r"%\([^)\n]+\)[sdSD]",  # %(name)s
    r"%[A-Za-z]\w{2,}%",  # %NAME%
    r"%[sd]\b",
    r"\$\([A-Za-z_]\w*\)",  # $(NAME)
    r"\$[A-Za-z_]\w*\$?",  # $NAME, $name$
    r"\bXXX(?:-\w+-XXX)?\b",
]
# What a tool prints for a variable without a value, after a label.
DEFAULTS = r"(?i)^[\p{L}][\p{L} _-]{0,30}\s*[:：]\s*(?:undefined|null|none|nan|nil|n/a|tbd|todo|\[object Object\]|-+|\?+|_+|\.{3}|…)$"
# What such values look like where a slot is known from its fillings: any letters between signs that
# aren't quotes or brackets of prose, a name in capitals, a default, a blank.
UNFILLED = [
    r"⟂",
    r"[^\p{L}\p{N}\s\"'`«»„“”‘’「」『』()\[\]<>*_.,:;/\\\\#!?+-]{1,3}[\p{L}][\p{L}\p{N}_.-]*[^\p{L}\p{N}\s\"'`«»„“”‘’「」『』()\[\]<>*_.,:;/\\\\#!?+-]{1,3}",
    r"[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+",
    r"undefined|null|None|NaN|nil|N/A|TBD|TODO",
    r"_{2,}|\.{3}|…|\?{2,}|-{3,}|\[\]|\{\}|<>",
]
# Left-over instructions of a message template, as whole units.
INSTRUCTIONS = [
    r"^#\s*(?:please (?:write|enter)|lines starting with)\b.*",
    r"^<!--.*-->$",
    r"^\W*(?:your|ihr|ihre|votre|su|seu)\b.{0,60}\b(?:here|hier|ici|aquí|aqui)\W*$",
    r"^(?:summary|subject|title|description|body|text|details?|message)\b.{0,40}\bgoes? here\b.*",
    r"^type\(scope\): subject$",
    r"^explain the why\b.{0,30}\bin this paragraph\W*$",
    r"^(?:please )?(?:describe|replace|delete|remove|fill in)\b.{0,30}\b(?:this (?:line|paragraph|text)|your changes? here)\b.*",
]
# Filler, server errors, exporter errors and script notices, as whole units.
PAGES = [
    r"^lorem ipsum\b.*",
    r"^(?:this is )?(?:sample|dummy|filler|placeholder) (?:text|words|paragraph|content)\b.{0,60}",
    r"^hier steht ein blindtext\b.*",
    r'^\{"error": ?\{.*\}\}$',
    r"^(?:fatal: bad object|error: could not export|error: connection to)\b.*",
    r"^(?:please )?(?:enable|turn on|activate|allow) (?:java ?scripts?|scripts)\b.*",
    r"^(?:java ?scripts?|scripts) (?:is|are|must be) (?:required|disabled|turned off|allowed)\b.*",
    r"^.{0,40}\b(?:need to|please) enable javascript\b.*",
    r"^javascript required\b.*",
]
# The server error that begins a unit; a word in small letters after it makes it a sentence about the error.
HTTP_ERROR = r"^(?i:(?:[45]0\d|4[1-2]\d) (?:bad request|unauthorized|forbidden|not found|method not allowed|request timeout|gone|too many requests|internal server error|not implemented|bad gateway|service unavailable|gateway timeout))\b(?! ?\p{Ll}).*"
# Titles of such pages, alone in a unit or before a sentence that begins with a capital.
TITLES = [
    "page not found", "access denied", "session expired", "gateway timeout", "bad gateway", "service unavailable", "internal server error",
    "repository unavailable", "unsupported browser", "checking your browser", "one more step", "verify that you are human", "loading",
    "something went wrong", "oops", "we can't show this right now", "your browser has scripting turned off", "this app needs js", "javascript required",
    "página no encontrada", "acceso denegado", "se necesita javascript", "error interno del servidor", "página não encontrada", "acesso negado",
    "seite nicht gefunden", "zugriff verweigert", "interner serverfehler", "javascript ist ausgeschaltet", "page introuvable", "accès refusé",
    "erreur interne du serveur", "javascript requis", "页面不存在", "拒绝访问", "请启用 javascript", "ページが見つかりません", "アクセスが拒否されました", "javascript を有効にしてください",
]
# Sentences of such pages, and filler, as whole units.
SENTENCES = [
    r"^if nothing appears, allow scripts\b.*",
    r"^diff not rendered\b.*",
    r"^the diff took too long\b.*",
    r"^- item \w+$",
    r"^(?:filler words only|some words to fill)\b.*",
    r"^(?:the revision you asked for does not exist|you don['’]t have permission to view this repository|la révision demandée n['’]existe pas|die angeforderte änderung gibt es nicht mehr)\b.*",
    r"^(?:este es un|ceci est un) (?:texto de relleno|faux texte)\b.*",
    r"^(?:active los scripts|activez javascript|bitte aktivieren sie javascript|ative o javascript)\b.*",
]

_PLACE = "(?:" + "|".join(PLACEHOLDERS) + ")"
_DIFF = r"(?:diff --git |Index: |@@ -\d)"
_HEAD = r"(?m)^(?:commit [0-9a-f]{7,}|Author: |Tagger: |From: .*@|Date: |r\d+ \| )"
_HEAD_LINE = (
    r"(?m)^[ \t]*(?:commit [0-9a-f]{7,}[^\n]*|tag v?[0-9][^\n]*|r\d+ \| [^\n]*|---|-- |\d+\.\d+\.\d+"
    r"|(?:Author|Tagger|From|Commit|Committer|[A-Z][a-z]+(?:-[a-z]+)*-by): ?[^\n]*[\w.]@[\w-]+\.\w[^\n]*|(?:Date|AuthorDate|CommitDate): ?[^\n]*\d:\d[^\n]*)$"
)
_TAG = r"(?i)<!doctype[^<>]*>|(?<!<)</?(?:html|head|title|body|pre|hr|h[1-6]|p|b|br|div|noscript|a|i|li|ul|table|tr|td|span)(?:\s[^<>]*)?/?>(?!>)"


_GIT = r"(?m)^commit [0-9a-f]{7,}"
_MAIL = r"(?m)^From: .*@"
_WORD = r"[\p{L}\p{N}_]+(?:['’]\p{L}+)?"


@dataclass(frozen=True)
class ResidueParameters:
    """``few_words``: ordinary words beside a place in a unit that can't be a sentence about it; ``notations``: notations
    in one slot that make its unit a template; ``fillings``: different ordinary values in one slot that make a name,
    default or blank in it an unfilled one.

    ``ordinary_share`` and ``page_share``: how often an ordinary and a page's word, word pair or line stands out of place;
    ``evidence``: log of the likelihood ratio from which it is a page's, the record at hand not counted; ``cover``: share
    of a unit's words that must be; ``hint``: ratio from which words count that make a page's unit only together, with
    twice the evidence in four words or more. ``chance``: of a unit of words that no other record has.

    ``slots``, ``pages``, ``gibberish`` switch what is induced, ``instructions`` what matches ``INSTRUCTIONS``. ``known``
    adds the phrases of known pages, for tables too small to induce any.
    """

    few_words: int = 3
    notations: int = 2
    fillings: int = 3
    ordinary_share: float = 0.03
    page_share: float = 0.4
    evidence: float = 4.0
    hint: float = 1.0
    cover: float = 0.8
    chance: float = 1e-5
    slots: bool = True
    pages: bool = True
    gibberish: bool = True
    instructions: bool = True
    known: bool = True


def records(docs: DataFrame, doc: str, text: str, origin: str | None = None, marks: Sequence[str] = ()) -> DataFrame:
    """(doc, same, message, off): what a record says before its diff, in the message and out of place.

    Out of place is all of a record with neither head nor diff and, in a record without a diff, what follows the
    message: lines that aren't indented where messages are, and what comes after the mail's separator.
    ``same`` is one for records of equal text and origin: copies of one record, which must not look like a
    repeated page. A bare text doesn't tell copies from a repeated page: with ``marks`` (columns such as author and time),
    bare records are copies only if they agree in these too; where all of them are NULL each stands for itself. Without an
    origin every record stands for itself. Head lines, trailers and tags are taken away. NULL texts are left out.
    """
    same = F.xxhash64(doc) if origin is None else F.xxhash64(origin, text)
    unmarked = F.when(F.coalesce(*[F.col(m).cast("string") for m in marks]).isNull(), F.col(doc)) if marks else None
    bare_same = F.xxhash64(origin, text, *marks, unmarked) if origin is not None and marks else same
    rows = docs.filter(F.col(text).isNotNull() & F.col(doc).isNotNull())
    cut = F.get(F.split(text, r"(?<![^\n\r])" + _DIFF, 2), 0)
    rows = rows.select(F.col(doc).alias("doc"), same.alias("same"), bare_same.alias("bare_same"), (F.length(text) > F.length(cut)).alias("diff"), F.regexp_replace(cut, r"\r\n?", "\n").alias("front"))
    bare = ~F.col("diff") & ~F.col("front").rlike(_HEAD)
    told = F.regexp_replace(F.regexp_replace("front", _HEAD_LINE.replace("|---|", "|"), ""), _TAG, "\n")
    told = F.regexp_replace(told, r"(?m)^Subject: (?:\[[^\]\n]*\] ?)?", "")
    git, mail = F.col("front").rlike(_GIT), F.col("front").rlike(_MAIL)
    rows = rows.select("doc", F.when(bare, F.col("bare_same")).otherwise(F.col("same")).alias("same"), bare.alias("bare"), "diff", git.alias("git"), mail.alias("mail"), told.alias("told"))
    after = r"(?s)\n--- *(?:\n.*|\z)"
    message = F.when(F.col("bare"), "").when(F.col("diff"), F.col("told")).when(F.col("git"), F.regexp_replace("told", r"(?m)^(?! {4}|\t).*$", "")).when(F.col("mail"), F.regexp_replace("told", after, "")).otherwise(F.col("told"))
    rest = F.when(F.col("git"), F.regexp_replace("told", r"(?m)^(?: {4}|\t).*$", "")).when(F.col("mail"), F.regexp_extract("told", after, 0))
    off = F.when(F.col("bare"), F.col("told")).when(~F.col("diff"), F.coalesce(rest, F.lit(""))).otherwise("")
    return rows.select("doc", "same", message.alias("message"), off.alias("off"))


def _units(told: DataFrame) -> DataFrame:
    """(same, no, off, unit, words): lines and sentences with their words, numbers and hashes made equal. Copies count once."""

    def lines(c: str, off: bool) -> Column:
        parts = F.transform(F.split(c, r"\n|(?<=[.!?。])\s+"), lambda x: F.trim(F.regexp_replace(x, r"[\t ]+", " ")))
        parts = F.array_distinct(F.filter(parts, lambda x: (F.length(x) > 0) & ~x.rlike("^--- ?$")))
        return F.transform(parts, lambda x: F.struct(F.lit(off).alias("off"), x.alias("unit")))

    u = told.select("same", "message", "off").dropDuplicates(["same"]).select("same", F.posexplode(F.concat(lines("message", False), lines("off", True))).alias("no", "u"))
    plain = F.regexp_replace(F.regexp_replace(F.lower("u.unit"), r"\b(?=[a-f]*\d)[0-9a-f]{6,}\b", "h"), r"\d+", "0")
    return u.select("same", "no", "u.off", "u.unit", F.regexp_extract_all(plain, F.lit(_WORD), F.lit(0)).alias("words"))


def _own_signs(unit: Column, words: Column, p: ResidueParameters) -> Column:
    """Residue that a unit shows by itself: a default after a label, one or two words over and over, an instruction."""
    kinds = F.size(F.array_distinct(words))
    signs = unit.rlike(DEFAULTS) | ((F.size(words) >= 3) & (kinds == 1) & F.lower(unit).rlike(r"^\p{L}")) | ((F.size(words) >= 6) & (kinds == 2))
    if p.instructions:
        signs |= F.lower(unit).rlike("|".join(f"(?:{x})" for x in INSTRUCTIONS))
    if p.known:
        signs |= F.lower(unit).rlike("|".join(f"(?:{x})" for x in PAGES + SENTENCES)) | unit.rlike(HTTP_ERROR)
        signs |= unit.rlike("^(?:[45]\\d\\d )?(?i:" + "|".join(TITLES) + r")[.!…]*(?:$|\s+\p{Lu}.*[.!]$)")
    return signs


def _paged(u: DataFrame, p: ResidueParameters) -> DataFrame:
    """``same`` of records with a unit made of words, word pairs or lines of pages, or of words that nobody else has."""
    n = F.size("words")
    first, last = F.array(F.lit("^")), F.array(F.lit("$"))
    grams = F.concat(F.transform("words", lambda w: F.xxhash64(w)), F.zip_with(F.concat(first, "words"), F.concat("words", last), lambda a, b: F.xxhash64(a, b)), F.array(F.xxhash64(F.lit("line"), "words")))
    g = u.filter(n > 0).select("same", "no", "off", n.alias("n"), F.posexplode(grams).alias("at", "gram"))
    per = g.groupBy("gram", "same").agg(F.max("off").alias("off"), F.min(F.struct("no", "n")).alias("unit"), F.bool_or(F.col("at") < F.col("n")).alias("word"))
    per = per.groupBy("gram").agg(F.count(F.lit(1)).alias("records"), F.count_if("off").alias("out"), F.bool_or("word").alias("word"), F.min(F.struct("same", "unit")).alias("one"))
    stats = cut_lineage(per.select("gram", "records", "out", "word", F.when(F.col("records") == 1, F.col("one")).alias("one")))
    more, less = math.log(p.page_share / p.ordinary_share), math.log((1 - p.page_share) / (1 - p.ordinary_share))
    ratio = lambda k, m: k * more + (m - k) * less
    key = lambda off: F.xxhash64("gram", F.lit(off))
    # a unit out of place is judged by the other records only
    inside = F.struct(key(False).alias("key"), ratio(F.col("out"), F.col("records")).cast("float").alias("w"))
    outside = F.struct(key(True).alias("key"), ratio(F.col("out") - 1, F.col("records") - 1).cast("float").alias("w"))
    keys = stats.filter("out >= 1").select(F.inline(F.array(inside, outside))).filter(F.col("w") >= p.hint)
    hits = lookup_join(g.withColumn("key", F.xxhash64("gram", "off")), keys, "key")
    word = F.when(F.col("at") < F.col("n"), F.struct(F.col("at"), "w"))
    pair = F.when((F.col("at") >= F.col("n")) & (F.col("at") <= 2 * F.col("n")), F.struct((F.col("at") - F.col("n")).alias("at"), "w"))
    hits = hits.groupBy("same", "no").agg(F.max("n").alias("n"), F.map_from_entries(F.collect_list(word)).alias("alone"), F.map_from_entries(F.collect_list(pair)).alias("pairs"), F.max(F.when(F.col("at") > 2 * F.col("n"), F.col("w"))).alias("line"))
    at = lambda m, i: F.coalesce(F.try_element_at(m, i), F.lit(0.0))
    # a word by itself or by the pairs on both sides
    weights = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.least(F.greatest(at("alone", i), F.least(at("pairs", i), at("pairs", i + 1))), F.lit(p.evidence).cast("float")))
    hits = hits.select("same", "n", "line", weights.alias("x"))
    many = lambda least, cover=p.cover: F.size(F.filter("x", lambda w: w >= least)) >= cover * F.col("n")
    # few sightings of a line need words that don't speak against it
    line = F.coalesce("line", F.lit(0.0))
    repeated = (line >= p.evidence) & ((line >= 3 * p.evidence) | (F.col("n") < 3) | many(p.hint, 0.75 * p.cover))
    total = F.aggregate("x", F.lit(0.0).cast("float"), lambda s, w: (s + w).cast("float"))
    strong, together = (F.col("n") >= 2) & many(p.evidence), (F.col("n") >= 4) & many(p.hint) & (total >= 2 * p.evidence)
    found = hits.filter(repeated | strong | together).select("same")
    if not p.pages:
        found = found.limit(0)
    if p.gibberish:
        words = stats.filter("word")
        rare = words.agg(F.coalesce(F.count_if(F.col("records") == 1) / F.sum("records"), F.lit(1.0)).alias("r")).scalar()
        alone = words.filter("records = 1").groupBy("one.same", "one.unit").agg(F.count(F.lit(1)).alias("rare")).select("same", "unit.n", "rare")
        alone = alone.filter((F.col("n") >= 4) & (F.col("rare") >= p.cover * F.col("n"))).withColumn("r", rare)
        found = found.unionByName(alone.filter(F.pow("r", "rare") <= p.chance).select("same"))
    return found


def _places(token: Column) -> Column:
    """(place, token) for every token of a unit. ``place``: the hash of what is constant about it: the number of tokens,
    its position, the first token and the tokens beside it (two at the start), so that records meet whatever their other slots hold."""
    none, end = F.array(F.lit("^")), F.array(F.lit("$"))
    n = F.size(token)
    before = F.slice(F.concat(none, token), F.lit(1), n)
    after = F.slice(F.concat(token, end), F.lit(2), n)
    leading = F.concat(F.array(F.coalesce(F.get(token, F.lit(2)), F.lit(""))), F.array_repeat(F.get(token, F.lit(0)), n - 1))
    return F.arrays_zip(token.alias("token"), before.alias("before"), after.alias("after"), leading.alias("leading"))


def _slotted(u: DataFrame, p: ResidueParameters) -> DataFrame:
    """``same`` of records with an unfilled slot."""
    skeleton = F.regexp_replace("unit", _PLACE, "⟂")
    held = F.regexp_extract("unit", "(" + _PLACE + ")", 1)
    s = u.select("same", "unit", skeleton.alias("skeleton"), held.alias("held")).withColumn("placed", F.col("skeleton") != F.col("unit"))
    # an identifier is one word
    rest = F.regexp_replace(F.regexp_replace("skeleton", r"(?<=[\p{L}\p{N}])[_./-]+(?=[\p{L}\p{N}])", ""), r"[⟂\p{N}\p{P}\p{S}]+", " ")
    own = F.col("skeleton").rlike(r"^\W*⟂\W*:") | F.col("skeleton").rlike(r"^[\p{L}][\p{L} _-]*\s*[:：#]\s*⟂\W*$")
    words = F.size(F.filter(F.split(F.trim(rest), " +"), lambda x: F.length(x) > 0))
    placed = s.filter("placed").select("same", F.xxhash64(F.regexp_replace("skeleton", r"\d+", "0")).alias("template"), F.regexp_replace("held", r"[\p{L}\p{N}_.]+(?: [\p{L}\p{N}_.]+)*", "a").alias("notation"), (own | (words <= p.few_words)).alias("alone"))
    templates = placed.select("template", "notation").distinct().groupBy("template").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= p.notations).select("template")
    found = placed.filter("alone").select("same").unionByName(semi_join(placed.select("same", "template"), templates, "template").select("same"))
    tokens = s.select("same", F.split(F.regexp_replace("skeleton", r"[.,;!?]+$", ""), " ").alias("t")).filter(F.size("t") >= 3)
    tokens = tokens.select("same", F.size("t").alias("n"), F.posexplode(_places(F.col("t"))).alias("at", "x"))
    place = F.xxhash64("n", "at", F.col("x.leading"), F.col("x.before"), F.col("x.after")).alias("place")
    blank = F.col("x.token").rlike("^[\"'`(]*(?:" + "|".join(UNFILLED) + ")[\"'`),:;]*$")
    odd = F.col("x.token").rlike(r"[^\p{Ll}\p{N}]|^un|^nu|^nil")  # cheaper than the whole pattern, and never false where that is true
    unfilled = cut_lineage(tokens.filter(odd).filter(blank).select("same", place))
    filled = semi_join(tokens.select(place, F.col("x.token").alias("token")), unfilled.select("place").distinct(), "place")
    filled = filled.filter(~F.col("token").rlike("^[\"'`(]*(?:" + "|".join(UNFILLED) + ")[\"'`),:;]*$"))
    known = filled.select("place", F.xxhash64("token").alias("value")).distinct().groupBy("place").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= p.fillings).select("place")
    return found.unionByName(semi_join(unfilled, known, "place").select("same"))


def find_residue(docs: DataFrame, doc: str, text: str, origin: str | None = None, parameters: ResidueParameters = ResidueParameters(), marks: Sequence[str] = ()) -> DataFrame:
    """Ids of the records that hold residue, each once, as column ``doc``.

    What stands in diff hunks doesn't count, nor does a sentence about placeholders, errors or notices. NULL and
    blank texts are no cases; equal records share their fate; an empty table gives no rows. Statistics are over
    all records. Rows with a NULL id are left out. ``origin`` and ``marks`` tell copies of a record from repeated pages
    (see ``records``).
    """
    p = parameters
    told = cut_lineage(records(docs, doc, text, origin, marks))
    u = cut_lineage(_units(told))
    found = u.filter(_own_signs(F.col("unit"), F.col("words"), p)).select("same")
    if p.slots:
        found = found.unionByName(_slotted(u, p))
    if p.pages or p.gibberish:
        found = found.unionByName(_paged(u, p))
    found = cut_lineage(found.distinct())
    return semi_join(told.select("doc", "same"), found, "same").select("doc").distinct()
