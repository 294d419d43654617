"""What rules ask of a text: terms that it holds, how many, how often, and patterns.

Rules are written against :class:`Signals`. Over a plain column every question is an expression of its own. :func:`decided`
collects the questions of a whole set of rules first and answers each once: all terms of all lists by one automaton
(Aho-Corasick) in one pass over the text, each pattern once on the JVM; the rules then read booleans and counts. The
automaton is built once in a Python worker from the lists, which are a few KB; texts of any length pass in Arrow batches.
A pattern is tried only on texts that hold one of the strings without which it can't match (:func:`needed`); the same
automaton finds these, so rules over many patterns cost little where most of them have nothing to match.

A null text holds nothing. Terms are compared as they stand, so texts and terms are brought to one case before.
"""

from __future__ import annotations

import re
import re._constants as kinds
import re._parser as parser
from collections import Counter
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: A word bound by ASCII letters, digits and the underscore alone; the JVM's own goes by Unicode letters.
_BOUND = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def ascii_bounds(pattern: str) -> str:
    """A pattern whose word bounds follow ASCII. A bound that it begins with is tried where a word begins with a right letter only."""
    begins = _begins(pattern)
    if begins:
        pattern = rf"(?=[{begins}])(?<!\w){pattern[2:]}"
    return pattern.replace(r"\b", _BOUND)


#: Strings that a pattern is taken apart into at most.
MOST_STRINGS = 256


@lru_cache(1024)
def needed(pattern: str) -> list[str] | None:
    """Strings of which every match of a pattern holds one as it stands; null where none can be told."""
    try:
        tree = parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):  # the JVM's own syntax
        return None
    if tree.state.flags & (re.IGNORECASE | re.VERBOSE):
        return None
    whole, some = _strings(tree, {""})
    found = _better(whole, some)
    return sorted(found) if found else None


@lru_cache(1024)
def _begins(pattern: str) -> str:
    """Letters and digits that a match begins with, if the pattern starts with a word bound and nothing else can follow it; else empty."""
    try:
        tree = parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return ""
    if not pattern.startswith(r"\b") or not len(tree) or tree[0] != (kinds.AT, kinds.AT_BOUNDARY) or tree.state.flags & (re.IGNORECASE | re.VERBOSE):
        return ""
    first = _first_of(list(tree)[1:])
    return "".join(sorted(first)) if first and all(c.isascii() and (c.isalnum() or c == "_") for c in first) else ""


def _first_of(items) -> set[str] | None:
    """Characters that a match of ``items`` may begin with, the empty string where it may be empty; null if they can't be told."""
    out: set[str] = set()
    for kind, of in items:
        if kind in (kinds.AT, kinds.ASSERT, kinds.ASSERT_NOT):
            continue
        if kind is kinds.LITERAL:
            return out | {chr(of)}
        if kind is kinds.IN and all(k is kinds.LITERAL for k, _ in of):
            return out | {chr(c) for _, c in of}
        if kind is kinds.IN and of == [(kinds.CATEGORY, kinds.CATEGORY_DIGIT)]:
            return out | set("0123456789")
        if kind is kinds.SUBPATTERN and not (of[1] or of[2]):
            part = _first_of(of[3])
        elif kind is kinds.BRANCH:
            each = [_first_of(branch) for branch in of[1]]
            part = None if any(x is None for x in each) else set().union(*each)
        elif kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT):
            part = _first_of(of[2])
            part = part | {""} if part is not None and not of[0] else part
        else:
            return None
        if part is None:
            return None
        out |= part - {""}
        if "" not in part:
            return out
    return out | {""}


def _better(a: set[str] | None, b: set[str] | None) -> set[str] | None:
    """The choice that texts hold more seldom: its shortest string is longer, marks count twice; single letters don't do."""
    size = lambda s: min((sum(1 if c.isalnum() or c == " " else 2 for c in x) for x in s), default=0)
    usable = [{x for x in s if not any(y != x and y in x for y in s)} for s in (a, b) if s and size(s) > 1]
    return max(usable, key=lambda s: (min(size(s), 4), -len(s)), default=None)


def _strings(items, before: set[str]) -> tuple[set[str] | None, set[str] | None]:
    """(all strings that ``items`` behind one of ``before`` match, or null if they aren't few; strings of which each match holds one)."""
    run, best, whole = before, None, True
    for kind, of in items:
        exact, some = _part(kind, of)
        if exact is not None and len(exact) * len(run) <= MOST_STRINGS:
            run = {x + y for x in run for y in exact}
            continue
        branches = of[1] if kind is kinds.BRANCH else [of[3]] if kind is kinds.SUBPATTERN and not (of[1] or of[2]) else []
        if kind is kinds.SUBPATTERN and len(of[3]) == 1 and of[3][0][0] is kinds.BRANCH:
            branches = of[3][0][1][1]
        if exact is None and branches:  # what stands before goes with each branch: the parser takes common beginnings out
            parts = [_better(*_strings(branch, run)) for branch in branches]
            some = set().union(*parts) if all(parts) else some
        best, whole = _better(_better(best, run), _better(exact, some)), False
        run = {""}
    return (run, best) if whole else (None, _better(best, run))


def _part(kind, of) -> tuple[set[str] | None, set[str] | None]:
    """The same for one part of a pattern."""
    if kind is kinds.LITERAL:
        return {chr(of)}, None
    if kind in (kinds.AT, kinds.ASSERT, kinds.ASSERT_NOT):  # of no width
        return {""}, None
    if kind is kinds.IN and all(k is kinds.LITERAL for k, _ in of):
        return {chr(c) for _, c in of}, None
    if kind is kinds.SUBPATTERN and not (of[1] or of[2]):
        return _strings(of[3], {""})
    if kind is kinds.BRANCH:
        parts = [_strings(branch, {""}) for branch in of[1]]
        if all(exact is not None for exact, _ in parts) and sum(len(exact) for exact, _ in parts) <= MOST_STRINGS:
            return set().union(*(exact for exact, _ in parts)), None
        each = [_better(*p) for p in parts]
        return None, set().union(*each) if all(each) else None
    if kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT):
        exact, some = _strings(of[2], {""})
        if of[1] == 1 and exact is not None:
            return exact if of[0] else exact | {""}, None
        return None, _better(exact, some) if of[0] else None
    return None, None


class Signals:
    """Questions to one text, each answered where it stands."""

    def __init__(self, text: Column) -> None:
        self.text = F.coalesce(text, F.lit(""))

    def any(self, terms: list[str]) -> Column:
        """Whether the text holds one of the terms."""
        return self.text.rlike("|".join("\\Q" + t + "\\E" for t in terms)) if terms else F.lit(False)

    def count(self, terms: list[str]) -> Column:
        """How many of the terms the text holds; a term that is listed twice counts twice."""
        return sum((F.contains(self.text, F.lit(t)).cast("int") for t in terms), F.lit(0))

    def occurrences(self, terms: list[str]) -> Column:
        """How often the terms stand in the text, each counted without overlaps with itself."""
        n = lambda t: ((F.length(self.text) - F.length(F.replace(self.text, F.lit(t), F.lit("")))) / len(t)).cast("int")
        return sum((n(t) for t in terms), F.lit(0))

    def matches(self, pattern: str) -> Column:
        """Whether the text matches a pattern somewhere."""
        return self.text.rlike(ascii_bounds(pattern))

    def once(self, name: str, of: Callable[[Signals], Column]) -> Column:
        """A value that several rules use."""
        return of(self)

    @staticmethod
    def of(text: Column | Signals) -> Signals:
        """Questions to a text in lower case; questions already collected stay what they are."""
        return text if isinstance(text, Signals) else Signals(F.lower(text))


class Collected(Signals):
    """Questions to one text that :func:`decided` answers by columns."""

    def __init__(self, name: str) -> None:
        self.name, self.text = name, F.col(f"_{name}_text")
        self.lists: dict[tuple[str, tuple[str, ...]], int] = {}
        self.patterns: dict[str, str] = {}
        self.needed: dict[str, Column] = {}
        self.values: dict[str, Column] = {}

    def _asked(self, kind: str, terms: list[str]) -> Column:
        place = self.lists.setdefault((kind, tuple(terms)), len(self.lists))
        return F.col(f"_{self.name}_hits.h{place}")

    def any(self, terms: list[str]) -> Column:
        return self._asked("count", terms) > 0

    def count(self, terms: list[str]) -> Column:
        return self._asked("count", terms)

    def occurrences(self, terms: list[str]) -> Column:
        return self._asked("occurrences", terms)

    def matches(self, pattern: str) -> Column:
        if pattern not in self.patterns:
            self.patterns[pattern] = f"_{self.name}_p{len(self.patterns)}"
            if needed(pattern):
                self.needed[pattern] = self._asked("count", needed(pattern)) > 0
        return F.col(self.patterns[pattern])

    def matched(self, pattern: str) -> Column:
        """Whether the text matches, tried where it holds what a match needs."""
        tried = self.text.rlike(ascii_bounds(pattern))
        return F.when(self.needed[pattern], tried).otherwise(F.lit(False)) if pattern in self.needed else tried

    def once(self, name: str, of: Callable[[Signals], Column]) -> Column:
        if name not in self.values:
            self.values[name] = of(self)  # values within it come first
        return F.col(f"_{self.name}_v_{name}")


class Automaton:
    """All lists as one automaton."""

    def __init__(self, lists: list[tuple[str, tuple[str, ...]]]) -> None:
        import ahocorasick

        self.size, self.repeated = len(lists), any(kind == "occurrences" for kind, _ in lists)
        slots: dict[str, tuple[list[tuple[int, int]], list[tuple[int, int]]]] = {}
        for place, (kind, terms) in enumerate(lists):
            for term, times in Counter(terms).items():
                slots.setdefault(term, ([], []))[kind == "occurrences"].append((place, times))
        slots.pop("", None)
        self.machine = ahocorasick.Automaton()
        for k, (term, (held, often)) in enumerate(slots.items()):
            self.machine.add_word(term, (k, len(term), held, often))
        if slots:
            self.machine.make_automaton()
        self.empty = not slots

    def hits(self, text: str) -> list[int]:
        """For each list the number of its terms in the text, or of their occurrences."""
        out = [0] * self.size
        if self.empty:
            return out
        ends: dict[int, int] = {}  # where the last counted occurrence of a term ends
        for end, (k, size, held, often) in self.machine.iter(text):
            last = ends.get(k)
            if last is None:
                ends[k] = end
                for place, times in held:
                    out[place] += times
                for place, times in often:
                    out[place] += times
            elif often and end - size >= last:
                ends[k] = end
                for place, times in often:
                    out[place] += times
        return out


_built: dict[int, Automaton] = {}


def _hits(text: Column, lists: list[tuple[str, tuple[str, ...]]]) -> Column:
    key = hash(tuple(lists))

    @F.pandas_udf(", ".join(f"h{k} int" for k in range(len(lists))))
    def hits(texts: pd.Series) -> pd.DataFrame:
        if key not in _built:
            if len(_built) > 8:
                _built.clear()
            _built[key] = Automaton(lists)
        machine = _built[key]
        return pd.DataFrame(np.array([machine.hits(t) for t in texts], np.int32).reshape(-1, machine.size), columns=[f"h{k}" for k in range(machine.size)])

    return hits(text)


def decided(df: DataFrame, texts: dict[str, Column], rules: Callable[..., dict[str, Column]]) -> DataFrame:
    """``df`` with the columns that ``rules`` returns; it is called with the questions to each of ``texts``, by name."""
    asked = {name: Collected(name) for name in texts}
    out = rules(**asked)
    held = df.withColumns({f"_{name}_text": F.coalesce(text, F.lit("")) for name, text in texts.items()})
    own = [f"_{name}_text" for name in texts]
    for name, s in asked.items():
        if s.lists:
            held = held.withColumn(f"_{name}_hits", _hits(s.text, list(s.lists)))
            own.append(f"_{name}_hits")
    held = held.withColumns({column: s.matched(pattern) for s in asked.values() for pattern, column in s.patterns.items()})
    own += [column for s in asked.values() for column in s.patterns.values()]
    for name, s in asked.items():
        for value, column in s.values.items():
            held = held.withColumn(f"_{name}_v_{value}", column)
            own.append(f"_{name}_v_{value}")
    return held.withColumns(out).drop(*own)
