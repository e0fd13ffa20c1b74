"""Compound claims: clauses, cues, the categories they make a claim compound by, and its split into statements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Auxiliary verbs, and base forms of the verbs that make a clause (their third person follows by rule).
AUXILIARY = ("is", "are", "was", "were", "be", "been", "being", "am", "has", "have", "had", "do", "does", "did", "will", "would", "shall", "should", "can", "could", "may", "might", "must", "ought")
BASES = (
    "write check use provide require cause lead result become remain include contain enable produce improve reduce increase decrease support outperform exceed define map split flag catch adopt "
    "run process return reach cache detect handle generate ingest compile lint verify cover show report make take give work help allow prevent ensure track store load build add remove update "
    "occur exist apply drive meet fail pass count measure rise grow fall"
).split()
#: Separators of clauses, words of time, of comparison, of cause and of advice.
SEPARATOR = r"(?i)\s*;\s*|\s*,?\s+(?:and|but|while|whereas|yet)\s+"
TIMES = "now|currently|today|yesterday|tomorrow|previously|formerly|recently|then|later|earlier|ago|nowadays|historically|initially|originally|subsequently|since|january|february|march|april|may|june|july|august|september|october|november|december"
COMPARES = r"(?i)\b(?:more|less|fewer|greater|higher|lower|faster|slower|better|worse|larger|smaller|stronger|weaker|cheaper|costlier|bigger|wider|narrower)\b|\bcompared (?:to|with)\b|\brelative to\b|\bversus\b|\bvs\.?\b|\boutperforms?\b|\boutpaces?\b|\bexceeds?\b"
ER_THAN, NOT_ER = r"(?i)\b(\w+er)\s+than\b", ("other", "rather", "further", "another", "either", "neither")
CAUSES = r"(?i)\bbecause(?:\s+of)?\b|\bdue to\b|\bowing to\b|\bas a result(?:\s+of)?\b|\btherefore\b|\bthus\b|\bhence\b|\bconsequently\b|\bleads? to\b|\bresults? in\b|\bcaused by\b|\bso that\b|\bresulting in\b"
ADVICE = r"(?i)\bshould\b|\bmust\b|\bought to\b|\bshall\b|\brecommend(?:s|ed)?\b|\badvise[sd]?\b|\bsuggest(?:s|ed)?\b|\bbest practice\b"
CAUSE_SPLIT = r"(?i)\s+(?:because(?:\s+of)?|due to|owing to|as a result of)\s+"
LEADING = r"(?i)^(?:and|but|while|whereas|yet|because|so)\s+"


def third_person(verb: str) -> str:
    if verb.endswith("y") and verb[-2] not in "aeiou":
        return verb[:-1] + "ies"
    return verb + ("es" if verb.endswith(("s", "sh", "ch", "x", "z")) else "s")


VERBS = (*AUXILIARY, *BASES, *map(third_person, BASES))


def tokens(c: Column) -> Column:
    """Words between blanks in lower case, without punctuation."""
    return F.filter(F.transform(F.split(c, r"\s+"), lambda w: F.lower(F.regexp_replace(w, r"[^\w%$-]", ""))), lambda w: w != "")


def clauses(c: Column) -> Column:
    """The parts of a text between clause separators if there are several and each has a verb behind its first word; else none."""
    parts = F.filter(F.transform(F.split(c, SEPARATOR), lambda p: F.btrim(p)), lambda p: p != "")
    stands = lambda p: F.exists(F.slice(F.concat(tokens(p), F.array(F.lit(""))), 2, 10_000), lambda w: w.isin(*VERBS))
    return F.when((F.size(parts) >= 2) & F.forall(parts, stands), parts).otherwise(F.array().cast("array<string>"))


def cue_flags(c: Column) -> dict[str, Column]:
    """Which cues a text holds: two times or more, a comparison, a cause, advice."""
    times = F.array_distinct(F.concat(F.regexp_extract_all(c, F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1)), F.regexp_extract_all(F.lower(c), F.lit(rf"\b({TIMES})\b"), F.lit(1))))
    er = F.exists(F.regexp_extract_all(c, F.lit(ER_THAN), F.lit(1)), lambda w: ~F.lower(w).isin(*NOT_ER))
    return {"times": F.size(times) >= 2, "comparison": c.rlike(COMPARES) | er, "cause": c.rlike(CAUSES), "advice": c.rlike(ADVICE)}


def categories(text: Column) -> Column:
    """Why a claim is compound, in order; empty for an atomic one, null for a null text."""
    c = F.btrim(text)
    cue, several = cue_flags(c), F.size(clauses(c)) > 0
    found = [("multi-predicate", several), ("mixed-temporal", cue["times"]), ("comparison-causal", cue["comparison"] & cue["cause"]), ("recommendation-fact", cue["advice"] & (cue["cause"] | several))]
    return F.when(text.isNotNull(), F.filter(F.array(*(F.when(ok, F.lit(n)) for n, ok in found)), lambda x: x.isNotNull()))


def statements(text: Column) -> Column:
    """The statements a compound claim splits into, each a sentence; empty where a part has no verb or fewer than two words."""
    c, why = F.btrim(text), categories(text)
    cause = F.filter(F.transform(F.split(c, CAUSE_SPLIT, 2), lambda p: F.btrim(p)), lambda p: p != "")
    by_cause = F.arrays_overlap(why, F.array(F.lit("comparison-causal"), F.lit("recommendation-fact"))) & (F.size(cause) == 2)
    parts = F.when(F.size(clauses(c)) > 0, clauses(c)).when(by_cause, cause).otherwise(F.array().cast("array<string>"))
    bare = F.transform(parts, lambda p: F.btrim(F.regexp_replace(F.regexp_replace(p, r"^[\s,;:]+|[\s,;:]+$", ""), LEADING, "")))
    good = F.forall(bare, lambda p: (F.size(tokens(p)) >= 2) & F.arrays_overlap(tokens(p), F.array(*map(F.lit, VERBS))))
    shown = F.transform(bare, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1_000_000), F.when(p.rlike(r"[.!?]$"), "").otherwise(".")))
    return F.when(good, shown).otherwise(F.array().cast("array<string>"))
