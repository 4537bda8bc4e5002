"""Search by trigrams: which texts can match a pattern, from an index of the groups of three characters that they hold.

A clause says that one of several sets of trigrams lies in a text whole; a text that lacks a clause of a pattern can't match
it. Trigrams are of lower-case A-Z, so they serve patterns of either case, and never hold a line end.
"""

from __future__ import annotations

import re
import string
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Strings that a part of a pattern may stand for, and still be told one by one.
EXPANSIONS = 16
#: What Java and Python mean the same by; a pattern with anything else has no clauses, so all texts are searched.
_ESCAPES = set("dDwWsSbBnrtf.^$|?*+()[]{}\\/-_ ,:;=<>!@#%&~'\"`")

Clause = list[frozenset[str]]


def _lower(text: str) -> str:
    return text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def grams(text: Column) -> Column:
    """The distinct trigrams of a text."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_distinct(F.regexp_extract_all(low, F.lit(r"(?=([^\n]{3}))"), F.lit(1)))


def _of(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2) if "\n" not in text[i : i + 3])


class _Part:
    """What a part of a pattern says: the strings it may be, if they are few, and else the clauses that it needs."""

    def __init__(self, strings: set[str] | None, clauses: list[Clause]):
        self.strings, self.clauses = strings, clauses

    def needed(self) -> list[Clause]:
        if self.strings is None:
            return self.clauses
        sets = [_of(_lower(s)) for s in self.strings]
        return [sets] if sets and all(sets) else []


def _sequence(nodes: list) -> _Part:
    run, clauses, exact = {""}, [], True

    def flush() -> None:
        nonlocal run, exact
        clauses.extend(_Part(run, []).needed())
        run, exact = {""}, False

    for node in nodes:
        part = _node(*node)
        if part is None:  # of no width
            continue
        if part.strings is not None and len(run) * len(part.strings) <= EXPANSIONS:
            run = {a + b for a, b in product(run, part.strings)}
        elif part.strings is not None:
            flush()
            run = set(part.strings)
        else:
            flush()
            clauses.extend(part.clauses)
    if exact:
        return _Part(run, [])
    flush()
    return _Part(None, clauses)


def _node(op: object, value: object) -> _Part | None:
    match str(op):
        case "LITERAL":
            return _Part({chr(value)}, [])
        case "IN" if len(value) <= 4 and all(str(kind) == "LITERAL" for kind, _ in value):
            return _Part({chr(c) for _, c in value}, [])
        case "SUBPATTERN":
            return _sequence(list(value[3]))
        case "ATOMIC_GROUP":
            return _sequence(list(value))
        case "BRANCH":
            parts = [_sequence(list(branch)) for branch in value[1]]
            if all(p.strings is not None for p in parts) and len(strings := set().union(*(p.strings for p in parts))) <= EXPANSIONS:
                return _Part(strings, [])
            needed = [p.needed() for p in parts]  # one clause of each branch will do
            return _Part(None, [sum((min(n, key=len) for n in needed), [])] if all(needed) else [])
        case "MAX_REPEAT" | "MIN_REPEAT" | "POSSESSIVE_REPEAT":
            least, most, inner = value
            part = _sequence(list(inner))
            if least == most == 1:
                return part
            return _Part(None, part.needed() if least else [])
        case "AT" | "ASSERT" | "ASSERT_NOT":
            return None
    return _Part(None, [])


def clauses(pattern: str) -> list[Clause]:
    """What every text that matches a regular expression holds; none if nothing is known of it."""
    escaped = re.findall(r"\\(.)", pattern, re.DOTALL)
    bare = re.sub(r"\\.", "", pattern, flags=re.DOTALL)
    if not _ESCAPES.issuperset(escaped) or "&&" in bare or re.search(r"\[\^?\]?[^\]]*\[|\(\?[^:=!<>i)]|\(\?i.*\(\?|.\(\?i|\(\?i[^)]", bare):
        return []
    try:
        tree = re._parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return []
    return _sequence(list(tree)).needed()


def candidates(postings: DataFrame, id_col: str, needed: list[Clause]) -> DataFrame:
    """(id_col) of the texts that hold all clauses, from (gram, id_col); only rows of their trigrams are read."""
    wanted = sorted(set().union(*(alternative for clause in needed for alternative in clause)))
    have = postings.where(F.col("gram").isin(*wanted)).groupBy(id_col).agg(F.collect_set("gram").alias("have"))  # a part of a query's few
    holds = lambda some: reduce(lambda a, b: a & b, (F.array_contains("have", g) for g in sorted(some)))
    return have.where(reduce(lambda a, b: a & b, (reduce(lambda a, b: a | b, map(holds, clause)) for clause in needed))).select(id_col)
