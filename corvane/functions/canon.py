"""Canonical labels for names, by rule tables held as data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import COUNTRY_LABEL, DOMAIN_VILLAGE, GENERIC, JUNK, KEEP_UPPER, NOT_TEAMS, OLD_TRACK, REGION_LABEL, RULES, SECTION_LABEL, VILLAGES
from .text import let, normal_name, slug, text_of

TAIL_KINDS = ("molecule", "technique", "part", "chassis")
LEAST_RECORDS = 10
LONGEST_NAME = 90


def lookup(col: Column, table: dict[str, str], default: Column) -> Column:
    found = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(found, col), default)


def first_rule(col: Column, rules: list[tuple[str, str]]) -> Column:
    """The label of the first pattern that occurs, or null."""
    result = None
    for label, pattern in rules:
        result = F.when(col.rlike(pattern), label) if result is None else result.when(col.rlike(pattern), label)
    return F.lit(None).cast("string") if result is None else result


def titled(col: Column) -> Column:
    """Known acronyms in capitals and a capital first; the other letters stay."""
    words = F.transform(F.split(col, " "), lambda w: F.when(w.isin(*sorted(KEEP_UPPER)), F.upper(w)).otherwise(w))
    joined = F.array_join(words, " ")
    return F.concat(F.upper(F.substring(joined, 1, 1)), F.expr("''"), F.substring(joined, F.lit(2), F.length(joined)))


def canonical(kind: str, raw: Column) -> Column:
    """A name's label: null for junk, the first rule's label, or else the name tidied."""

    def label(name: Column) -> Column:
        junk = (name == "") | (F.length(name) > LONGEST_NAME) | name.rlike(JUNK) | name.isin(*sorted(GENERIC.get(kind, {""})))
        return F.when(~junk, F.coalesce(first_rule(name, RULES.get(kind, [])), titled(name)))

    return let(normal_name(raw), label)


def curated(kind: Column, label: Column) -> Column:
    return F.array_contains(lookup_array(kind), label)


def lookup_array(kind: Column) -> Column:
    result = F.array().cast("array<string>")
    for name, rules in RULES.items():
        result = F.when(kind == name, F.array(*[F.lit(label) for label, _ in rules])).otherwise(result)
    return result


def keeps_value(kind: Column, label: Column, n: Column) -> Column:
    """Whether a facet value is kept: always outside the long-tailed kinds, inside if curated or frequent."""
    return ~kind.isin(*TAIL_KINDS) | curated(kind, label) | (n >= LEAST_RECORDS)


def region_label(col: Column) -> Column:
    v = F.trim(text_of(col))
    return lookup(F.lower(v), REGION_LABEL, F.initcap(F.translate(v, "-", " ")))


def section_label(col: Column) -> Column:
    v = F.trim(text_of(col))
    spaced = F.lower(F.translate(v, "-", " "))
    return lookup(F.lower(v), SECTION_LABEL, F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, F.lit(2), F.length(spaced))))


def country_label(col: Column) -> Column:
    v = F.trim(text_of(col))
    return lookup(F.upper(v), COUNTRY_LABEL, v)


def village(raw: Column, domain: Column) -> Column:
    """Today's topic of a record: as stated, by what an old track became, by its domain, or empty."""
    v = F.trim(text_of(raw))
    return F.when(v.isin(*sorted(VILLAGES)), v).otherwise(lookup(v, OLD_TRACK, lookup(text_of(domain), DOMAIN_VILLAGE, F.lit(""))))


def is_junk_name(name: Column) -> Column:
    """Page names that are no record's name."""
    return slug(name).isin(*sorted(NOT_TEAMS)) | text_of(name).rlike(r"(?i)[\[\]{}<>]|^(your|insert|enter)\b|^tbd$")
