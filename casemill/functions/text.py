"""Text extraction and audit as JVM column expressions.

The inline flag ``U`` makes word boundaries and spaces Unicode-aware, ``d`` keeps
the newline as the only line end, as the patterns expect.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from casemill import constants as K


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def strip(text: Column) -> Column:
    """Trim every kind of white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def canonical_verdict(word: Column) -> Column:
    upper = F.upper(word)
    out = upper
    for foreign, own in K.VERDICT_TRANSLATION.items():
        out = F.when(upper == foreign, own).otherwise(out)
    return out


def verdict_pairs(text: Column) -> Column:
    """Array of (case_no, verdict) in text order; a case may repeat."""
    pattern = "(?isUd)" + K.VERDICT_PATTERN
    pairs = F.arrays_zip(
        _all(text, pattern, 1).alias("no"), _all(text, pattern, 3).alias("word")
    )
    return F.transform(
        pairs,
        lambda p: F.struct(
            p["no"].try_cast("long").alias("case_no"), canonical_verdict(p["word"]).alias("verdict")
        ),
    )


def single_verdict(text: Column) -> Column:
    word = F.upper(F.regexp_extract(text, "(?isUd)" + K.SINGLE_VERDICT_PATTERN, 1))
    return F.when(word == "", K.NO_VERDICT).otherwise(word)


def trim_at_verdict(text: Column) -> Column:
    """Text up to the end of its first verdict, so a dangling header pairs with nothing."""
    end = "(?iU)" + K.VERDICT_END_PATTERN
    return F.when(
        text.rlike(end), F.regexp_extract(text, f"(?isUd)^(.*?{K.VERDICT_END_PATTERN})", 1)
    ).otherwise(text)


def prose_of(text: Column) -> Column:
    """The part before the verdict mark."""
    mark = "(?iU)" + K.VERDICT_MARK_PATTERN
    return F.when(text.rlike(mark), strip(F.split(text, mark, 2)[0])).otherwise(text)


def cited_ids(text: Column) -> Column:
    """Sorted distinct ids cited in an id context; bare numbers do not count."""
    none = F.array().cast("array<string>")
    found = [
        F.when(text.contains(stem), _all(text, "(?mUd)" + p, 1)).otherwise(none)
        for p, stem in zip(K.ID_PATTERNS, K.ID_STEMS)
    ]
    ids = F.transform(F.flatten(F.array(*found)), lambda s: s.try_cast("long"))
    return F.sort_array(F.array_distinct(F.array_compact(ids)))


def mentions_test_charge(text: Column) -> Column:
    """Both pattern families occur before the verdict."""
    body = F.split(text, "(?iU)" + K.VERDICT_CUT_PATTERN, 2)[0]
    return body.rlike("(?iU)" + K.PROBE_PATTERN) & body.rlike("(?iU)" + K.LATER_CHARGE_PATTERN)


def marker_counts(text: Column) -> tuple[Column, Column]:
    """Spanish and English marker words, counted over the words of the lowered text."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}_]+")
    es = F.size(F.filter(words, lambda w: w.isin(K.SPANISH_WORDS)))
    en = F.size(F.filter(words, lambda w: w.isin(K.ENGLISH_WORDS)))
    return es, en


def drifts_to_english(text: Column) -> Column:
    es, en = marker_counts(text)
    return en > es


def mentions_dollars(text: Column) -> Column:
    return text.contains("$") | F.lower(text).contains("dolar")


def first_affirmative_hit(
    lowered: Column, pattern: str, negation: str = K.NEGATION_PATTERN, window: int = K.NEGATION_WINDOW
) -> Column:
    """First match of ``pattern`` with no negation in the ``window`` characters before it.

    Offsets are rebuilt from the pieces between matches; the piecewise work runs only
    on texts that match at all.
    """
    flagged = "(?U)" + pattern
    hits = _all(lowered, flagged, 0)
    pieces = F.split(lowered, flagged, -1)
    steps = F.arrays_zip(F.slice(pieces, 1, F.size(hits)).alias("piece"), hits.alias("hit"))

    def advance(acc: Column, step: Column) -> Column:
        start = acc["pos"] + F.length(step["piece"])
        head = F.substring(
            lowered,
            F.greatest(start - window, F.lit(0)) + 1,
            F.least(start, F.lit(window)),
        )
        denied = head.rlike("(?iU)" + negation)
        found = F.coalesce(acc["hit"], F.when(~denied, step["hit"]))
        return F.struct((start + F.length(step["hit"])).alias("pos"), found.alias("hit"))

    seed = F.struct(F.lit(0).alias("pos"), F.lit(None).cast("string").alias("hit"))
    return F.when(lowered.rlike(flagged), F.aggregate(steps, seed, advance, lambda a: a["hit"]))


def invented_concepts(
    lowered: Column,
    rules: Sequence[tuple[str, str]] = tuple(K.CONCEPT_RULES),
    stems: Sequence[Sequence[str]] | None = tuple(K.CONCEPT_STEMS),
) -> Column:
    """Array of (rule, term, topic): the first undenied hit of every rule that has one.

    ``stems`` gives literal parts of each rule; the pattern runs only on texts that hold
    one.  Pass None with rules of your own that have no such parts.
    """

    def term(i: int, pattern: str) -> Column:
        hit = first_affirmative_hit(lowered, pattern)
        if stems is None:
            return hit
        return F.when(reduce(or_, [lowered.contains(s) for s in stems[i]]), hit)

    hits = [
        F.struct(F.lit(i).alias("rule"), term(i, pattern).alias("term"), F.lit(topic).alias("topic"))
        for i, (pattern, topic) in enumerate(rules)
    ]
    return F.filter(F.array(*hits), lambda h: h["term"].isNotNull())


def is_short(text: Column, limit: int = K.SHORT_OUTPUT_CHARS) -> Column:
    return F.length(strip(text)) < limit


