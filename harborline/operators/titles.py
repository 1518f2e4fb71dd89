"""How well a title explains itself, and how near it is to a role; word lists are parameters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from harborline.operators.roles import array_of, title_words


def met(words: Column, listed: Column) -> Column:
    return F.size(F.array_intersect(words, listed)) > 0


def telling(words: Column, skills: Column, ambiguous: Column) -> Column:
    """Words that are skills of three letters and more, and not ambiguous."""
    return F.filter(F.array_except(F.array_intersect(words, skills), ambiguous), lambda w: F.length(w) >= 3)


def title_quality(words: Column, bad: Column, context: list[str], skills: list[str], ambiguous: list[str], weak: Column) -> Column:
    """From 0 for a bad title, .1 for one without words or of digits only, to 1: .3, .4 for a word of context, .3 for a skill; a
    weak site takes .7 of it."""
    score = 0.3 + F.when(met(words, array_of(context)), 0.4).otherwise(0.0)
    score = score + F.when(F.size(telling(words, array_of(skills), array_of(ambiguous))) > 0, 0.3).otherwise(0.0)
    digits = F.forall(words, lambda w: F.rlike(w, F.lit("^[0-9]+$")))
    out = F.when(bad, 0.0).when(digits, 0.1).otherwise(F.least(F.lit(1.0), score * F.when(weak, 0.7).otherwise(1.0)))
    return F.round(out, 6)


def role_anchors(name: Column, aliases: Column, generic: list[str], expansions: dict[str, list[str]]) -> Column:
    """Words of two letters and more of a role's name and aliases but generic ones, and the expansions of its parts."""
    words = title_words(name, generic)
    other = F.flatten(F.transform(F.coalesce(aliases, array_of([])), lambda a: title_words(a, generic)))
    for part, more in expansions.items():
        there = F.contains(F.lower(name), F.lit(part)) | F.array_contains(words, part)
        other = F.concat(other, F.when(there, array_of(more)).otherwise(array_of([])))
    return F.filter(F.array_union(words, other), lambda w: F.length(w) >= 2)


def title_affinity(
    words: Column, bad: Column, anchors: Column, required: list[Column], context: list[str], skills: list[str], ambiguous: list[str], hard: list[str]
) -> Column:
    """From 0 to 1 how near a title is to a role: .55 for an anchor, .2 for a second one, .15 for context, .1 for a skill.

    0 without an anchor, without a word of each required list that is not empty, or where all anchors found are
    ambiguous and no hard word and no skill stands by.
    """
    hit = F.array_intersect(words, anchors)
    known = F.size(telling(words, array_of(skills), array_of(ambiguous))) > 0
    needed = reduce(lambda a, r: a & ((F.size(r) == 0) | met(words, r)), required, F.lit(True))
    doubtful = (F.size(F.array_except(hit, array_of(ambiguous))) == 0) & ~met(words, array_of(hard)) & ~known
    score = 0.55 + F.when(F.size(hit) >= 2, 0.2).otherwise(0.0) + F.when(met(words, array_of(context)), 0.15).otherwise(0.0) + F.when(known, 0.1).otherwise(0.0)
    return F.round(F.when(bad | (F.size(hit) == 0) | ~needed | doubtful, 0.0).otherwise(F.least(F.lit(1.0), score)), 6)
