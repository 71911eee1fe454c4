"""Lexical screening: rules matched in one pass over a text, told apart into proposals and mentions.

Rules are a small table, held by every Python worker, never joined with texts. Patterns of communities run under a
time limit in the worker; a rule that exceeds it is skipped and named. The order of rules decides which hit comes
first, then the order in the text.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.functions.text import Sentences, normal

LIMIT_S = 0.05


class RuleTimeout(Exception):
    """A rule ran out of time."""


@dataclass(frozen=True)
class Rule:
    """A code, a pattern over normalised text, a phrase that excuses a hit in the same sentence, and a time limit if any."""

    code: str
    pattern: str
    reason: str = ""
    unless: str | None = None
    tier: int = 2
    context: str | None = None  # only texts of this cultural context
    limit_s: float | None = None
    _compiled: list = field(default_factory=list, repr=False, compare=False, hash=False)

    def compiled(self) -> tuple:
        if not self._compiled:
            self._compiled.extend(regex.compile(p, regex.I) if p else None for p in (self.pattern, self.unless))
        return self._compiled[0], self._compiled[1]

    def hits(self, text: str, sentences: Sentences | None = None) -> list[tuple[int, int]]:
        """Places of all hits that nothing excuses; :class:`RuleTimeout` if the limit is passed."""
        pattern, unless = self.compiled()
        try:
            found = [m.span() for m in pattern.finditer(text, timeout=self.limit_s)]
            if unless is None or not found:
                return found
            sentences = sentences or Sentences(text)
            return [s for s in found if not self._excused(unless, text, *sentences.around(s[0]))]
        except TimeoutError as e:
            raise RuleTimeout(self.code) from e

    def _excused(self, unless: regex.Pattern, text: str, a: int, b: int) -> bool:
        return any(not _DENIED.search(text, a, m.start()) for m in unless.finditer(text, a, b, timeout=self.limit_s))


_DENIED = regex.compile(r"\b(?:no|not|never|without|lacking|absent|refus\w+|ignor\w+|n[o']t)\b[^.!?;,]{0,20}$", regex.I)
# Fixed classes of a sentence in which a harm is named but not proposed; the guard cancels them all.
_GUARD = regex.compile(r"\b(?:we|you|they|let us|let's|i)\s+(?:\w+\s+)?(?:should|must|will|need to|ought to|propose|recommend)\b|\b(?:the plan|step one|first step|proposal) (?:is|will)\b|^\s*(?:draft|write|order)\b", regex.I)
_BEFORE = regex.compile(r"\b(?:not|never|cannot|can't|don't|do not|must not|no one|nobody|refuse to|against)\b[^.!?;]{0,60}$", regex.I)
_CLASSES = {
    "condemned": regex.compile(r"\b(?:wrong|evil|crime|criminal|atrocit\w+|illegal|unlawful|unacceptable|condemn\w*|abhorrent|violat\w+)\b", regex.I),
    "question": regex.compile(r"\?\s*$|\b(?:what|why|how|who|when|is it|should)\b[^.!;]*\?", regex.I),
    "reported": regex.compile(r"\b(?:report\w*|accord\w+|histor\w+|document\w*|article|testif\w+|survivor\w*|witness\w*|alleg\w+|stud(?:y|ies))\b", regex.I),
    "safeguarding": regex.compile(r"\b(?:protect\w*|prevent\w*|safeguard\w*|hotline|helpline|warning signs?|keep \w+ safe)\b", regex.I),
    "rights_advice": regex.compile(r"\b(?:your rights?|appeal|complain\w*|ombuds\w+|regulator|legal (?:aid|advice)|you (?:can|may) (?:ask|refuse|object))\b", regex.I),
}


def mitigations(text: str, start: int, a: int, b: int) -> list[str]:
    """Why a hit is only a mention: the classes of its sentence (from ``a`` to ``b``), or none if the sentence proposes the act."""
    sentence = text[a:b]
    if _GUARD.search(sentence):
        return []
    return (["negated"] if _BEFORE.search(text[a:start]) else []) + [name for name, p in _CLASSES.items() if p.search(sentence)]


class Screened(NamedTuple):
    """Hits as (code, start, end, mitigations), and the codes of rules that ran out of time."""

    proposals: list[tuple]
    mentions: list[tuple]
    timed_out: list[str]


def screen(rules: Iterable[Rule], text: str | None) -> Screened:
    """All rules over one text; null and empty texts have no hits."""
    return _screen(rules, normal(text))


def _screen(rules: Iterable[Rule], form: str | None, sentences: Sentences | None = None) -> Screened:
    """:func:`screen` of a text in normal form, whose sentences may be cut already."""
    out = Screened([], [], [])
    if not form:
        return out
    sentences = sentences or Sentences(form)
    for rule in rules:
        try:
            for start, end in rule.hits(form, sentences):
                why = mitigations(form, start, *sentences.around(start))
                (out.mentions if why else out.proposals).append((rule.code, start, end, why))
        except RuleTimeout:
            out.timed_out.append(rule.code)
    return out


def rules_for(context: str | None, rules: Sequence[Rule], custom: Sequence[Rule] = ()) -> list[Rule]:
    """Rules of every context, those of this one, then a community's own, under a time limit."""
    own = [r if r.limit_s else Rule(r.code, r.pattern, r.reason, r.unless, r.tier, r.context, LIMIT_S) for r in custom]
    return [r for r in rules if r.context in (None, context)] + own


_HIT = "array<struct<code: string, start: int, stop: int, mitigations: array<string>>>"
SCREENED = f"struct<proposals: {_HIT}, mentions: {_HIT}, timed_out: array<string>>"
_HITS = pa.list_(pa.struct([("code", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("mitigations", pa.list_(pa.string()))]))
_FOUND = pa.struct([("proposals", _HITS), ("mentions", _HITS), ("timed_out", pa.list_(pa.string()))])


def _rows(found: Screened) -> dict:
    named = lambda hits: [dict(zip(("code", "start", "stop", "mitigations"), h)) for h in hits]
    return {"proposals": named(found.proposals), "mentions": named(found.mentions), "timed_out": found.timed_out}


def screened(text: Column, rules: Sequence[Rule], context: Column | None = None, custom: Sequence[Rule] = ()) -> Column:
    """:func:`screen` of a column, with the rules of each row's ``context``, in Arrow batches."""
    by: dict = {}

    @F.arrow_udf(SCREENED)
    def run(texts: pa.Array, contexts: pa.Array) -> pa.Array:
        out = []
        for t, c in zip(texts.to_pylist(), contexts.to_pylist()):
            if c not in by:
                by[c] = rules_for(c, rules, custom)
            out.append(_rows(screen(by[c], t)))
        return pa.array(out, _FOUND)

    return run(text, context if context is not None else F.lit(None).cast("string"))


READ = f"struct<norm: string, t3: {SCREENED}, t2: {SCREENED}, structural: array<string>, policy_like: boolean, error: string>"


def read(text: Column, context: Column, rules: Sequence[Rule], custom: Sequence[Rule] = (), structural: Sequence[Rule] = ()) -> Column:
    """Everything that screening asks of a text, from one normal form and one cut into sentences.

    Struct :data:`READ`: the form, hits of tier-3 rules, hits of the rules of the row's context and of a community's own,
    codes of structural rules, whether the text reads like policy, and the name of an exception if one was raised.
    """
    three = [r for r in rules if r.tier == 3]
    two = [r for r in rules if r.tier != 3]
    by: dict = {}
    kind = pa.struct([("norm", pa.string()), ("t3", _FOUND), ("t2", _FOUND), ("structural", pa.list_(pa.string())), ("policy_like", pa.bool_()), ("error", pa.string())])

    def one(t: str | None, c: str | None) -> dict:
        if c not in by:
            by[c] = rules_for(c, two, custom)
        form = normal(t)
        cut = Sentences(form) if form else None
        flagged = [r.code for r in structural if form and r.hits(form, cut)]
        return {"norm": form, "t3": _rows(_screen(three, form, cut)), "t2": _rows(_screen(by[c], form, cut)), "structural": flagged, "policy_like": _like_policy(form or ""), "error": None}

    @F.arrow_udf(READ)
    def run(texts: pa.Array, contexts: pa.Array) -> pa.Array:
        out = []
        for t, c in zip(texts.to_pylist(), contexts.to_pylist()):
            try:
                out.append(one(t, c))
            except Exception as e:  # a failing check is a result of its row, never of the job
                none = _rows(Screened([], [], []))
                out.append({"norm": None, "t3": none, "t2": none, "structural": [], "policy_like": False, "error": type(e).__name__})
        return pa.array(out, kind)

    return run(text, context)


def mentioned(text: Column, patterns: dict[str, str]) -> Column:
    """Codes of plain patterns that occur, wholly in the JVM: for patterns in the dialect of all engines."""
    return F.filter(F.array(*[F.when(F.regexp_like(text, F.lit("(?i)" + p)), F.lit(c)) for c, p in patterns.items()]), lambda x: x.isNotNull())


def confusion(labelled: DataFrame, label: str, verdict: Column) -> DataFrame:
    """(label, verdict, n) over a labelled corpus."""
    return labelled.groupBy(F.col(label).alias("label"), verdict.alias("verdict")).agg(F.count("*").alias("n"))


# --- our own lexicon, one or more rules for each code ---
_GROUP = r"(?:people|community|communities|population|villages?|families|residents|citizens|minorit\w+|tribes?|groups?|workers|elders|children)"
_FILL = r"(?:\s+\w+){0,2}\s+"
LEXICON: tuple[Rule, ...] = (
    Rule("POPULATION_HARM", rf"\b(?:kill|eliminate|exterminate|eradicate|starve|wipe out|sterili[sz]e){_FILL}{_GROUP}\b", "harm to a population", tier=3),
    Rule("POPULATION_HARM", r"\b(?:depopulation|ethnic cleansing|mass (?:killing|deportation)) (?:programme|program|plan|campaign)\b", "a programme of atrocity", tier=3),
    Rule("HUMAN_WORTH_RANKING", rf"\b{_GROUP}{_FILL}?(?:are|is) (?:vermin|parasites|worthless|sub-?human|less than human)\b", "dehumanising words", tier=3),
    Rule("HUMAN_WORTH_RANKING", rf"\b(?:god|nature|destiny|history|the nation|the market|the planet) (?:requires?|demands?|commands?|wills?)\b[^.!?;]{{0,60}}\b(?:kill\w*|remov\w+|purg\w+|sacrific\w+|extermin\w+|enslav\w+)\b", "a higher authority made to require harm", tier=3),
    Rule("HUMAN_WORTH_RANKING", r"\b(?:life|lives|people)\b[^.!?;]{0,40}\b(?:worth (?:less|\d+)|counts? for (?:less|\d+))\b", "lives ranked", tier=3),
    Rule("RIGHTS_OVERRIDE", r"\b(?:suspend|override|ignore|waive)\b[^.!?;]{0,30}\brights?\b[^.!?;]{0,40}\b(?:efficien\w+|optimi[sz]\w+|output|profit|stability)\b", "rights set aside for a goal", tier=3),
    Rule("ARBITRARY_CONFINEMENT_OR_FORCED_LABOUR", r"\bforced labou?r\b|\b(?:detain|confine|jail)\b[^.!?;]{0,30}\bwithout (?:trial|charge|process)\b", "confinement or forced labour", tier=3),
    Rule("COERCIVE_SURVEILLANCE", r"\b(?:surveil|monitor|threaten|track)\b[^.!?;]{0,80}\b(?:to (?:force|compel)|until they comply|into compliance)\b", "surveillance to coerce", tier=3),
    Rule("RELATIONAL_SCORING", r"\b(?:social|genetic|carbon|loyalty) scores?\b[^.!?;]{0,60}\b(?:den(?:y|ied)|restrict\w*|refus\w+)\b", "scores that deny", tier=3),
    Rule("DISSENT_SUPPRESSION", r"\b(?:suppress|silence|track|blacklist)\b[^.!?;]{0,30}\b(?:dissent\w*|protest\w*|critics|journalists|petition\w*)\b", "dissent suppressed", tier=3),
    Rule("COGNITIVE_MANIPULATION", r"\b(?:deceive|trick|mislead)\b[^.!?;]{0,30}\binto\b|\bsow (?:division|discord)\b|\bexploit\b[^.!?;]{0,30}\b(?:fears?|loneliness|vulnerab\w+)\b", "manipulation", tier=3),
    Rule("CHILD_OR_MATERNAL_ENDANGERMENT", r"\bchild (?:labou?r|soldiers?)\b|\bwithhold\b[^.!?;]{0,40}\b(?:maternal|children|infants?|pregnan\w+)\b", "children or mothers endangered", tier=3),
    Rule("CHILD_OR_MATERNAL_ENDANGERMENT", r"\b(?:withhold|den(?:y|ying)|cut)\b[^.!?;]{0,40}\b(?:midwi\w+|antenatal|maternity|vaccin\w+|school meals?)\b", "care withheld", tier=3),
    Rule("CHILD_OR_MATERNAL_ENDANGERMENT", r"\b(?:sell|buy|trade|rent|traffic)\b[^.!?;]{0,20}\b(?:children|babies|infants|girls|surrogates)\b", "children or mothers as goods", tier=3),
    Rule("CHILD_OR_MATERNAL_ENDANGERMENT", r"\bsexuali[sz]\w+\b[^.!?;]{0,30}\b(?:child\w*|minors?|girls?|boys?|teenagers?)\b", "children sexualised", tier=3),
    Rule("SEED_STOCK_EXTRACTION", r"\b(?:trade|swap|give up|relax)\b[^.!?;]{0,20}\bsafety\b[^.!?;]{0,40}\b(?:money|profits?|returns?|revenue|savings)\b", "safety traded for money", tier=3),
    Rule("SEED_STOCK_EXTRACTION", r"\b(?:deplete|exhaust|clear-?cut|drain|overfish)\b[^.!?;]{0,40}\b(?:stocks?|aquifers?|forests?|soils?|fisher\w+)\b[^.!?;]{0,40}\b(?:returns?|profits?|yield|dividends?)\b", "an ecological stock depleted for return", tier=3),
    Rule("SEED_STOCK_EXTRACTION", r"\b(?:sell|consume|burn)\b[^.!?;]{0,20}\bseed stock\b|\bquarterly profits?\b[^.!?;]{0,40}\bover\b[^.!?;]{0,20}\b(?:life|lives|safety)\b", "the seed stock consumed", tier=3),
    Rule("RELATIONAL_SEVERANCE", r"\bcut (?:off )?(?:all )?(?:ties|contact)\b[^.!?;]{0,30}\b(?:family|friends|community)\b", "ties cut"),
    Rule("HUMAN_BOND_SUBSTITUTION", r"\byou (?:only need|don't need anyone but) me\b|\breplace\b[^.!?;]{0,20}\b(?:friends|family)\b[^.!?;]{0,20}\b(?:ai|assistant|machine)\b", "bonds replaced"),
    Rule("COMMAND_NOT_CONSTRAINT", r"\b(?:obey|comply with) (?:the|this) (?:system|algorithm|model)\b", "command instead of constraint"),
    Rule("MONOCULTURAL_IMPOSITION", r"\b(?:ban|forbid|phase out)\b[^.!?;]{0,30}\b(?:languages?|customs|traditions|ceremon\w+)\b", "one culture imposed"),
    Rule("DATA_SOVEREIGNTY_BREACH", r"\b(?:collect|harvest|share|sell)\b[^.!?;]{0,30}\bcommunity(?:'s)? data\b", "community data taken", unless=r"\bwith (?:\w+ ){0,2}consent\b|\bwith the agreement of\b"),
    Rule("COMMUNAL_DELIBERATION_BYPASS", r"\b(?:bypass|skip)\b[^.!?;]{0,30}\b(?:council|assembly|elders)\b", "deliberation bypassed", context="UBUNTU"),
    Rule("TRUST_REPLACED_BY_SURVEILLANCE", r"\breplace trust with\b[^.!?;]{0,30}\b(?:cameras?|monitoring|surveillance)\b", "trust replaced", context="TILLIT"),
    Rule("PRESUMED_GUILT", r"\b(?:treat|regard)\b[^.!?;]{0,30}\bas (?:suspects|guilty)\b", "guilt presumed", context="TILLIT"),
    Rule("INFORMANT_NETWORK", r"\b(?:recruit|reward)\b[^.!?;]{0,20}\binform(?:ants|ers)\b", "informants", context="TILLIT"),
    Rule("TEK_APPROPRIATION", r"\b(?:patent|commerciali[sz]e)\b[^.!?;]{0,30}\b(?:traditional|indigenous) (?:knowledge|remed\w+|seeds?)\b", "knowledge appropriated", unless=r"\bwith (?:\w+ ){0,2}consent\b", context="INDIGENOUS_CARE"),
    Rule("COMMONS_ENCLOSURE", r"\b(?:fence|privati[sz]e|enclose)\b[^.!?;]{0,30}\b(?:commons|common land|pasture|well|water)\b", "commons enclosed", unless=r"\b(?:agreed|approved) by the (?:commoners|assembly)\b", context="RELATIONAL_COMMONWEALTH"),
)
STRUCTURAL: tuple[Rule, ...] = (
    Rule("UNBUFFERED_RISK", r"\bwithout (?:any )?(?:reserve|buffer|fallback|contingency)\b", "no buffer", tier=2),
    Rule("IRREVERSIBLE_WITHOUT_MITIGATION", r"\b(?:irreversibl[ey]|permanent(?:ly)?|cannot be undone)\b", "not reversible", unless=r"\b(?:mitigat\w+|rollback|compensat\w+)\b"),
    Rule("SAFETY_NET_REMOVAL", r"\b(?:abolish|end|cut|remove)\b[^.!?;]{0,20}\b(?:benefits|pensions?|food aid|relief|safety net)\b", "safety net removed", unless=r"\b(?:replac\w+|phased?|transition)\b"),
    Rule("POPULATION_SCALE_WITHOUT_PILOT", r"\b(?:nationwide|everyone|entire population|all citizens)\b", "no pilot", unless=r"\b(?:pilot|trial|staged)\b"),
)
_POLICY = regex.compile(r"\b(?:policy|regulation|ordinance|mandate|subsid\w+|tax|levy|quota|budget|programme|all (?:citizens|households|residents))\b", regex.I)


def _like_policy(form: str) -> bool:
    return len(_POLICY.findall(form)) >= 2


def looks_like_policy(text: str | None) -> bool:
    """Whether a text uses the vocabulary of policy at least twice."""
    return _like_policy(normal(text) or "")
