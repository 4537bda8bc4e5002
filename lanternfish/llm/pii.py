"""Personal data by patterns, checksums and context, in SQL functions only.

Patterns propose spans; validators confirm them: digits and Luhn for cards, parts for addresses, digits for phones,
mod-97 for account numbers. Words near a span adjust its score: a kind's own words raise it, words of look-alikes
(orders, versions and so on) lower it. Base kinds stay whatever their score; added kinds stay from `min_score` on.

How spans get positions without Python: splitting at a pattern gives the text between its matches, extracting gives the
matches; running sums of both lengths are the positions. The sums go in blocks, so a text of very many matches costs
about its length. Patterns use possessive repeats and may begin inside a run only right after a match (\\G): no text makes
them take quadratic time or deep recursion, and matches are those of the plain patterns.

Defined results: a null text counts as empty and gives no spans. Offsets count code points, end exclusive. Whole texts of
any length are scanned. Repeated rows give repeated results; other columns of the input aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in their listed order (base kinds first), with patterns that match as the plain ones do.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?:\x20[A-Z0-9]{4}){2,7}+(?:\x20[A-Z0-9]{1,3})?+)(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
KINDS = tuple(PATTERNS)
BASE_KINDS = KINDS[:4]
#: What a text must hold for a kind's pattern to be tried.
HINTS = {"email": "@", "phone": "+"}
DIGITS = {"ip": r"[0-9]\.[0-9]", "card": r"[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "ssn": r"[0-9]-[0-9]"}

#: Score of a confirmed span without context, and words within CONTEXT_CHARS on either side that adjust it.
SCORES = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.4}
RAISE = {
    "email": "mail|contact|write",
    "ip": "ip|addr|host|server|login",
    "card": "card|visa|mastercard|amex|credit|debit|pay",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank|transfer",
    "ssn": "ssn|social security|tax",
}
LOWER = "version|order no|invoice|isbn|serial|example|test"
CONTEXT_CHARS, ADJUST, MIN_SCORE = 40, 0.2, 0.5

_BLOCK = 256


def _sum(part: Column) -> Column:
    return F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)


def _luhn(digits: Column) -> Column:
    """From the right, every second digit is doubled, less 9 where that exceeds 9."""
    value = lambda i: F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
    weigh = lambda i: F.when(i % 2 == 0, value(i)).otherwise(value(i) * 2 - F.when(value(i) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + weigh(i)) % 10 == 0


def _mod97(number: Column) -> Column:
    """The first four characters go last, letters count as 10 to 35, and the remainder by 97 must be 1."""
    turned = F.concat(F.substr(number, F.lit(5)), F.substr(number, F.lit(1), F.lit(4)))
    code = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).when(code(c) > 9, (a * 100 + code(c)) % 97).otherwise((a * 10 + code(c)) % 97)) == 1


def _confirmed(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda part: F.length(F.ltrim(part, F.lit("0"))).between(0, 3) & (F.coalesce(F.substr(F.ltrim(part, F.lit("0")), F.lit(1), F.lit(4)).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        number = F.replace(match, F.lit(" "), F.lit(""))
        return F.when(F.length(number).between(15, 34), _mod97(number)).otherwise(False)
    if kind == "ssn":
        area = F.substr(digits, F.lit(1), F.lit(3))
        return ~area.isin("000", "666") & (area < "900") & (F.substr(digits, F.lit(4), F.lit(2)) != "00") & (F.substr(digits, F.lit(6)) != "0000")
    return F.lit(True)


def _propose(rows: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Adds a column of (start, place, end, kind, match) for each kind. Each step is a projection of its own, as what it
    makes is used more than once in the next."""
    text = F.col("__text")
    each = lambda make: {name: column for kind in kinds for name, column in make(kind).items()}
    hinted = lambda kind: F.contains(text, F.lit(HINTS[kind])) if kind in HINTS else F.rlike(text, F.lit(DIGITS[kind]))
    none = F.array().cast("array<string>")
    rows = rows.withColumns(
        each(
            lambda kind: {
                f"__match_{kind}": F.when(hinted(kind), F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))).otherwise(none),
                f"__between_{kind}": F.when(hinted(kind), F.split(text, PATTERNS[kind], -1)).otherwise(none),
            }
        )
    )
    # a match and the text before it; what follows the last match isn't needed
    rows = rows.withColumns(each(lambda kind: {f"__size_{kind}": F.zip_with(f"__match_{kind}", F.slice(f"__between_{kind}", F.lit(1), F.size(f"__match_{kind}")), lambda m, b: F.length(m) + F.length(b))}))
    blocks = lambda kind: F.when(F.size(f"__size_{kind}") > 0, F.sequence(F.lit(0), F.ceil(F.size(f"__size_{kind}") / _BLOCK).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumns(each(lambda kind: {f"__part_{kind}": F.transform(blocks(kind), lambda b: F.slice(f"__size_{kind}", b * _BLOCK + 1, F.lit(_BLOCK)))}))
    rows = rows.withColumns(each(lambda kind: {f"__sums_{kind}": F.transform(f"__part_{kind}", _sum)}))
    # ends[i]: all sizes up to and with match i
    rows = rows.withColumns(each(lambda kind: {f"__before_{kind}": F.transform(f"__sums_{kind}", lambda _, b: _sum(F.slice(f"__sums_{kind}", F.lit(1), b)))}))
    rows = rows.withColumns(each(lambda kind: {f"__end_{kind}": F.flatten(F.zip_with(f"__part_{kind}", f"__before_{kind}", lambda part, before: F.transform(part, lambda _, i: before + _sum(F.slice(part, F.lit(1), i + 1)))))}))
    span = lambda kind, m, e: F.struct((e - F.length(m)).alias("start"), F.lit(KINDS.index(kind)).alias("place"), e.alias("end"), F.lit(kind).alias("kind"), m.alias("match"))
    return rows.withColumns(each(lambda kind: {f"__found_{kind}": F.filter(F.zip_with(f"__match_{kind}", f"__end_{kind}", lambda m, e: span(kind, m, e)), lambda x: _confirmed(kind, x["match"]))}))


def _score(text: Column, span: Column) -> Column:
    around = F.lower(F.concat_ws(" ", F.substr(text, F.greatest(span["start"] - CONTEXT_CHARS, F.lit(0)).cast("int") + 1, F.least(span["start"], F.lit(CONTEXT_CHARS)).cast("int")), F.substr(text, span["end"].cast("int") + 1, F.lit(CONTEXT_CHARS))))
    own = F.coalesce(*(F.when(span["kind"] == k, F.rlike(around, F.lit(rf"\b(?:{words})"))) for k, words in RAISE.items()))
    base = F.coalesce(*(F.when(span["kind"] == k, F.lit(v)) for k, v in SCORES.items()))
    return F.round(F.least(F.greatest(base + F.when(own, ADJUST).otherwise(0.0) - F.when(F.rlike(around, F.lit(rf"\b(?:{LOWER})")), ADJUST).otherwise(0.0), F.lit(0.0)), F.lit(1.0)), 2)


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """Returns id_col and spans: an array of (start, end, place, kind, match, score), by start, then by kind."""
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    rows = _propose(rows).select(id_col, "__text", F.array_sort(F.concat(*(F.col(f"__found_{kind}") for kind in KINDS))).alias("__found"))
    scored = F.transform("__found", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["place"].alias("place"), x["kind"].alias("kind"), x["match"].alias("match"), _score(F.col("__text"), x).alias("score")))
    return rows.select(id_col, F.filter(scored, lambda x: (x["place"] < len(BASE_KINDS)) | (x["score"] >= min_score)).alias("spans"))
