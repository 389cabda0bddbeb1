"""Search text to groups (OR) of units (AND) of spellings (alternatives); plain Python on the driver."""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from ..functions.fixed import ABBREVIATIONS, COMMON_WORDS, SYNONYMS

TOKEN = re.compile("[a-z0-9]{2,32}")
PIECE = re.compile("[a-z0-9]+(?:[-_][a-z0-9]+)+|[a-z0-9]+")
ABBREVIATED = re.compile(r"\b([a-z])\.\s*([a-z]{3,})\b", re.ASCII)
FOLD_WEIGHT = 0.35
LONGEST_FORM = 4


@dataclass(frozen=True)
class Spelling:
    """Words that must all occur, and the weight of their score."""

    words: tuple[str, ...]
    weight: float = 1.0


@dataclass(frozen=True)
class Unit:
    """Alternatives of which one must match."""

    spellings: tuple[Spelling, ...]
    label: str


@dataclass
class Vocabulary:
    """Synonym groups by form, and other grammatical numbers of words (as from operators.index.folds).

    fallbacks: for typed words that the index doesn't have, their stems that it has (as from operators.index.fallbacks).
    """

    groups: dict[str, tuple[str, ...]] = field(default_factory=dict)
    folds: dict[str, tuple[str, ...]] = field(default_factory=dict)
    fallbacks: dict[str, str] = field(default_factory=dict)

    def numbers(self, word: str) -> tuple[str, ...]:
        return self.folds.get(word) or tuple(filter(None, [self.fallbacks.get(word)]))


def synonym_groups(synonyms=SYNONYMS, abbreviations=ABBREVIATIONS) -> dict[str, tuple[str, ...]]:
    """Form -> all forms. Written groups answer to any form, abbreviations only to the short one.

    Left out: short forms of under three letters, common words, and those known already.
    """
    written = {form: tuple(forms) for forms in synonyms for form in forms}
    explained = {short: long for long, short in reversed(abbreviations) if len(short) > 2}  # the first of a short form stays
    wanted = explained.keys() - written.keys() - set(COMMON_WORDS)
    return written | {short: (*written.get(explained[short], (explained[short],)), short) for short in wanted}


class Forms:
    """The known forms as a tree of words, in which the longest one at a place is found by a walk."""

    def __init__(self, forms):
        self.root: dict = {}
        for form in forms:
            words = form.split(" ")
            if len(words) <= LONGEST_FORM:
                functools.reduce(lambda node, word: node.setdefault(word, {}), words, self.root)[None] = form

    def longest(self, words: list[str]) -> str | None:
        """The longest form that the words begin with."""
        walk = itertools.accumulate(words, lambda node, word: (node or {}).get(word), initial=self.root)
        ends = [node[None] for node in itertools.takewhile(lambda node: node is not None, walk) if None in node]
        return ends[-1] if ends else None


def _pieces(text: str) -> Iterator[tuple[str, str]]:
    """(kind, text) of a search text's parts: compounds, words, and last the initials joined to names."""
    for match in PIECE.finditer(text):
        piece = match[0]
        yield from [("compound", piece)] if {"-", "_"} & set(piece) else (("word", w) for w in TOKEN.findall(piece))
    yield from (("word", "".join(m.groups())) for m in ABBREVIATED.finditer(text))


def _compound(piece: str) -> Iterator[Unit]:
    """A piece with hyphens or underscores: its parts together, or all of it joined."""
    ways = (tuple(TOKEN.findall(piece)), tuple(w for w in [re.sub("[-_]", "", piece)] if len(w) > 1))
    spellings = tuple(Spelling(words) for words in ways if words)
    yield from [Unit(spellings, piece)] if spellings else []


def _run(words: list[str], vocabulary: Vocabulary, forms: Forms) -> Iterator[Unit]:
    """Units of words that no compound divides: known forms as long as they go, other words with their other number."""
    while words:
        form = forms.longest(words)
        if form:
            yield Unit(tuple(Spelling(tuple(other.split(" "))) for other in vocabulary.groups[form]), form)
        elif len(words[0]) > 1:
            yield Unit((Spelling((words[0],)), *(Spelling((w,), FOLD_WEIGHT) for w in vocabulary.numbers(words[0]))), words[0])
        words = words[form.count(" ") + 1 if form else 1 :]


def parse_units(text: str | None, vocabulary: Vocabulary) -> list[Unit]:
    """Units in order. Initials joined to a name ("e. coli") come in addition, after the other words."""
    forms, units = Forms(vocabulary.groups), []
    for kind, group in itertools.groupby(_pieces((text or "").lower().strip()), key=lambda piece: piece[0]):
        parts = [part for _, part in group]
        units += _run(parts, vocabulary, forms) if kind == "word" else itertools.chain.from_iterable(map(_compound, parts))
    return units


def parse(text: str | None, vocabulary: Vocabulary | None = None) -> list[list[Unit]]:
    """Groups split at "or"; "and" only separates. Leading and trailing operators and empty groups don't count."""
    vocabulary = vocabulary or Vocabulary(synonym_groups())
    raw = (text or "").strip()
    raw = re.sub(r"^(?:(?:and|or)(?:\s+|$))+", "", raw, flags=re.I)
    raw = re.sub(r"(?:(?:^|\s+)(?:and|or))+$", "", raw, flags=re.I).strip()
    if not raw:
        return []
    groups = (parse_units(re.sub(r"\s+and\s+", " ", part, flags=re.I), vocabulary) for part in re.split(r"\s+or\s+", raw, flags=re.I))
    return [g for g in groups if g]


def words_of(groups: list[list[Unit]]) -> list[str]:
    """Every word of every spelling, each once."""
    return list(dict.fromkeys(w for units in groups for u in units for s in u.spellings for w in s.words))


@dataclass
class SearchState:
    """What an address says about a search."""

    text: str = ""
    mode: str = "lexical"
    page: int = 1
    view: str = "list"
    filters: dict[str, list[str]] = field(default_factory=dict)

    def has_query(self) -> bool:
        return bool(self.text.strip() or any(self.filters.values()))

    def encode(self) -> str:
        from urllib.parse import urlencode

        pairs = [("q", self.text)] if self.text else []
        pairs += [("mode", self.mode)] if self.mode != "lexical" else []
        pairs += [("page", str(self.page))] if self.page > 1 else []
        pairs += [("view", self.view)] if self.view != "list" else []
        return urlencode(pairs + [(kind, key) for kind in sorted(self.filters) for key in self.filters[kind]])

    @classmethod
    def decode(cls, query: str, kinds: list[str]) -> SearchState:
        from urllib.parse import parse_qs

        given = parse_qs(query.lstrip("?"))
        one = lambda k, default: given.get(k, [default])[0]
        page = one("page", "1")
        mode = one("mode", "lexical")
        filters = {k: [v.lower() for v in given[k]] for k in kinds if k in given}
        return cls(one("q", ""), mode if mode in ("lexical", "hybrid") else "lexical", max(1, int(page)) if page.isdigit() else 1, one("view", "list"), filters)
