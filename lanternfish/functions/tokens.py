"""Token, line and slice functions over text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of Unicode, for a character class; the same to Java and to RE2.
SPACE = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\p{Z}"
#: A token is a run of letters, digits and underscores, or one other character that isn't white space.
TOKEN = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{SPACE}]"
#: Tokens kept of a body.
MAX_TOKENS = 510


def tokens(text: Column) -> Column:
    """Lower-case tokens in order, repeats included."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def query_terms(query: Column) -> Column:
    """Distinct tokens of a query, in order of first use; words that start with an operator sign are left out."""
    words = F.filter(F.split(F.coalesce(query, F.lit("")), f"[{SPACE}]+"), lambda w: ~F.rlike(w, F.lit(r'^[-+^"*]')))
    return F.array_distinct(tokens(F.array_join(words, " ")))


def truncate(text: Column, n: int = MAX_TOKENS) -> Column:
    """The text up to the end of its n-th token; possessive repeats keep it linear."""
    if n <= 0:
        return F.lit("")
    head = rf"^(?:[{SPACE}]*+(?:[\p{{L}}\p{{N}}_]++|[^\p{{L}}\p{{N}}_{SPACE}])){{0,{n}}}+"
    return F.regexp_extract(F.coalesce(text, F.lit("")), head, 0)


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def line_count(text: Column) -> Column:
    return F.size(lines(text))


def source_slice(text: Column, first: Column, last: Column) -> Column:
    """Lines first to last (from 1, both included) as they are; null for bounds that hold no line."""
    rows = lines(text)
    end = F.least(F.coalesce(last, first), F.size(rows))
    return F.when((first >= 1) & (first <= end), F.array_join(F.slice(rows, first, end - first + 1), "\n"))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def body_slice(text: Column, first: Column, last: Column, n: int = MAX_TOKENS) -> Column:
    """source_slice, stripped and cut to n tokens."""
    return truncate(stripped(source_slice(text, first, last)), n)


def embed_text(rel_path: Column, language: Column, parent: Column, name: Column, signature: Column, body: Column, n: int = MAX_TOKENS) -> Column:
    """What of a symbol is embedded: `path [language] > parent > name`, a line with its signature, and its body, of which
    alone n tokens are kept. Parts that are null or empty are left out."""
    some = lambda c: F.nullif(c, F.lit(""))
    head = F.concat_ws(" > ", F.concat(F.coalesce(rel_path, F.lit("")), F.lit(" ["), F.coalesce(language, F.lit("")), F.lit("]")), some(parent), name)
    return F.concat_ws("\n", head, F.concat(F.lit("signature: "), some(signature)), some(truncate(stripped(body), n)))
