"""Text-quality scores: keyword, number, structure and pattern heuristics, and their weighted composites."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import text as X

ADVICE = ("recommend", "should", "suggest", "consider", "advise", "action", "implement", "improve", "optimize", "prioritize", "next step", "immediate", "critical", "important")
MORE_ADVICE = (*ADVICE, "propose")
MARKERS = ("##", "###", "**", "- ", "1.", "2.", "3.")
MORE_MARKERS = ("##", "###", "**", "- ", "* ", "1.", "2.", "3.", "```", "|", "---")
WEIGHTS = {"completeness": 0.25, "relevance": 0.25, "coherence": 0.20, "factual_accuracy": 0.20, "actionability": 0.10}


@dataclass(frozen=True)
class Element:
    """What an answer should have: a description in words and, perhaps, a pattern."""

    kind: str
    description: str
    pattern: str | None = None

    def keywords(self, most: int | None = None) -> list[str]:
        return [w.lower() for w in self.description.split() if len(w.encode()) > 3][:most]

    def valid(self) -> bool:
        if self.pattern is None:
            return False
        try:
            re.compile(self.pattern)
        except re.error:
            return False
        return True


def ones(markers: Sequence[str], s: Column) -> Column:
    """How many of the markers occur, in this case of letters."""
    return sum((F.contains(s, F.lit(m)).cast("int") for m in markers), F.lit(0))


def capped(n: Column, whole: float) -> Column:
    return F.least(n / F.lit(float(whole)), F.lit(1.0))


def actionability(s: Column) -> Column:
    return capped(X.contained(s, ADVICE), 3)


def recommendations(s: Column) -> Column:
    return capped(X.contained(s, MORE_ADVICE), 4)


def structure(s: Column) -> Column:
    return capped(ones(MORE_MARKERS, s), 5)


def coherence(s: Column) -> Column:
    """A half, and more for markers, for three paragraphs and for 100 to 2000 words; 1 at most."""
    marks = ones(MARKERS, s) / F.lit(float(len(MARKERS))) * 0.2
    score = F.lit(0.5) + marks + F.when(X.paragraph_count(s) >= 3, 0.15).otherwise(0.0) + F.when(X.word_count(s).between(100, 2000), 0.15).otherwise(0.0)
    return F.least(score, F.lit(1.0))


def keyword_share(s: Column, keywords: Sequence[str], threshold: float) -> Column:
    if not keywords:
        return F.lit(1.0)
    share = X.contained(s, [k.lower() for k in keywords]) / F.lit(float(len(keywords)))
    return F.when(share >= threshold, 1.0).otherwise(share / threshold)


def numbers(s: Column, least: int) -> Column:
    return capped(X.number_count(s), least) if least > 0 else F.lit(1.0)


def pattern(s: Column, regex: str) -> Column:
    """1 where the pattern is found; 0 elsewhere and for a pattern that is none."""
    return F.when(s.rlike(regex), 1.0).otherwise(0.0) if Element("", "", regex).valid() else F.lit(0.0)


CUSTOM = {
    "length_check": lambda s: F.when(X.word_count(s).between(100, 2000), 1.0).otherwise(0.5),
    "paragraph_structure": lambda s: capped(X.paragraph_count(s), 3),
}


def custom(s: Column, name: str) -> Column:
    """A registered evaluator; of an unknown name, a half."""
    return CUSTOM[name](s) if name in CUSTOM else F.lit(0.5)


def detected(s: Column, e: Element) -> Column:
    """By its pattern if that is valid, else by any of the first five words of its description that are longer than three bytes."""
    if e.valid():
        return s.rlike(e.pattern)
    words = e.keywords(5)
    return X.contained(s, words) > 0 if words else F.lit(False)


def completeness(s: Column, elements: Sequence[Element]) -> Column:
    return sum((detected(s, e).cast("int") for e in elements), F.lit(0)) / F.lit(float(len(elements))) if elements else F.lit(1.0)


def relevance(s: Column, elements: Sequence[Element]) -> Column:
    words = [w for e in elements for w in e.keywords()]
    return X.contained(s, words) / F.lit(float(len(words))) if words else F.lit(1.0)


def facts(s: Column, elements: Sequence[Element]) -> Column:
    known = [e for e in elements if e.pattern is not None]
    return sum((pattern(s, e.pattern) for e in known), F.lit(0.0)) / F.lit(float(len(known))) if known else F.lit(1.0)


def element_quality(s: Column, e: Element) -> Column:
    """0.95 for a pattern found, 0.8 for keywords alone, 0.7 for keywords in the stead of a broken pattern, 0 for none."""
    return F.when(~detected(s, e), 0.0).otherwise(0.95 if e.valid() else 0.7 if e.pattern is not None else 0.8)


def metrics(s: Column, elements: Sequence[Element], kind: str = "") -> dict[str, Column]:
    return {
        "completeness": completeness(s, elements),
        "relevance": relevance(s, elements),
        "coherence": coherence(s),
        "factual_accuracy": facts(s, elements),
        "actionability": actionability(s) if kind == "recommendation" else F.lit(1.0),
    }


def weighted(values: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """The weighted mean; 0 if the weights sum to 0. They need not sum to 1."""
    weights = WEIGHTS if weights is None else weights
    total = sum(weights.values())
    return sum((values[k] * F.lit(float(w)) for k, w in weights.items()), F.lit(0.0)) / F.lit(float(total)) if total else F.lit(0.0)


@dataclass(frozen=True)
class Criterion:
    """One line of a rubric: an evaluator by name, with its options."""

    name: str
    weight: float
    evaluator: str
    options: dict = field(default_factory=dict)

    def column(self, s: Column) -> Column:
        made = {"keywords": keyword_share, "numbers": numbers, "structure": structure, "recommendations": recommendations, "pattern": pattern, "custom": custom}[self.evaluator]
        return made(s, **self.options)


def rubric(s: Column, criteria: Sequence[Criterion]) -> Column:
    return weighted({c.name: c.column(s) for c in criteria}, {c.name: c.weight for c in criteria})


def with_data(template: Column, data: Column, name: str, hint: str | None = None, marks: Sequence[str] = ("{data}",)) -> Column:
    """A prompt with its data and the name of their format put in, after a hint if there is one."""
    for mark in marks:
        template = F.replace(template, F.lit(mark), data)
    made = F.replace(template, F.lit("{format_name}"), F.lit(name))
    return F.concat(F.lit(hint + "\n\n"), made) if hint else made
