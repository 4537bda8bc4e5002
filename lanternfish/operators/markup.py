"""Start tags and symbols of HTML, as column expressions: no Python runs.

Each `<` is given the number of its line first, so that a tag found by a pattern knows where it stands without a running sum
over what comes before. One pattern then walks over comments, the insides of script and style, and tags. All its loops are
possessive and a tag that never ends is consumed as far as it goes, so the work is linear in the text.

Null is a text without tags. Characters U+0000 are dropped. Attribute values are as written: entities stay. Tags that end in
`/>` aren't start tags. An attribute without a value, or with an empty one, isn't listed; of equal names the last counts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TAG = "struct<tag:string,line:int,end_line:int,attributes:array<struct<name:string,value:string>>>"

_MARK = r"\x00\d++\x00"
_VALUE = r"\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'<>\x00][^\s<>\x00]*+)"
_ATTRIBUTE = rf"[^\s\"'<>/=\x00]++(?:{_VALUE})?+"
_INSIDE = rf"(?:{_ATTRIBUTE}|[^<>\x00])*+"
_PIECE = rf"(?is){_MARK}<(?:!--.*?(?:-->|\z)|(script|style)(?=[\s/>]){_INSIDE}(?<!/)>.*?(?={_MARK}</\1|\z)|[a-z][^\s/<>\x00]*+{_INSIDE}>?)"
_START = rf"(?is)^{_MARK}<[a-z][^\s/<>\x00]*+{_INSIDE}(?<!/)>"
#: Elements whose name makes a form field.
FIELDS = ("input", "select", "textarea")


def lines(text: Column) -> Column:
    """The rows of a text, whose ends may be \\r\\n, \\r or \\n."""
    return F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n", -1)


def _newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def _attribute(written: Column) -> Column:
    value = F.regexp_replace(written, r"(?s)^[^=]*+=\s*+", "")
    quoted = F.substring(value, 1, 1).isin('"', "'")
    return F.struct(
        F.lower(F.regexp_extract(written, r"^[^\s=]++", 0)).alias("name"),
        F.when(F.contains(written, F.lit("=")), F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)).alias("value"),
    )


def _tag(piece: Column) -> Column:
    line = F.regexp_extract(piece, r"^\x00(\d++)", 1).cast("int")
    written = F.regexp_replace(F.regexp_extract(piece, _START, 0), _MARK, "")
    rest = F.regexp_replace(written, r"^<[^\s/<>]++", "")
    attributes = F.filter(F.transform(F.regexp_extract_all(rest, F.lit(f"(?is){_ATTRIBUTE}"), F.lit(0)), _attribute), lambda a: a["value"] != "")
    return F.struct(F.lower(F.regexp_extract(written, r"^<([^\s/<>]++)", 1)).alias("tag"), line.alias("line"), (line + _newlines(written)).alias("end_line"), attributes.alias("attributes"))


def start_tags(text: Column) -> Column:
    """The start tags of a text in order: tag and attribute names in lower case, first and last line from 1."""
    mark = lambda row, i: F.replace(row, F.lit("<"), F.concat(F.lit("\0"), (i + 1).cast("string"), F.lit("\0<")))
    marked = F.array_join(F.transform(lines(F.replace(text, F.lit("\0"), F.lit(""))), mark), "\n")
    pieces = F.filter(F.regexp_extract_all(marked, F.lit(_PIECE), F.lit(0)), lambda p: F.regexp_like(p, F.lit(_START)))
    return F.coalesce(F.transform(pieces, _tag), F.array().cast(f"array<{TAG}>"))


def _quoted(text: Column) -> Column:
    """As a Python literal shows it: in single quotes, or in double ones if only single ones are inside."""
    plain = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for sign, shown in (("\n", "\\n"), ("\t", "\\t")):
        plain = F.replace(plain, F.lit(sign), F.lit(shown))
    double = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'")))


def symbols_of(tags: Column, rel_path: Column) -> Column:
    """The symbols of start tags: every id, sources of scripts, targets of links, form fields by name or else id."""

    def of(tag: Column) -> Column:
        def value(name: str) -> Column:
            return F.try_element_at(F.filter(tag["attributes"], lambda a: a["name"] == name), F.lit(-1))["value"]

        def symbol(wanted: Column, kind: str, name: Column, mark: str, signature: Column) -> Column:
            row = F.struct(
                F.lit(kind).alias("type"), name.alias("name"), F.concat(F.replace(rel_path, F.lit("\\"), F.lit("/")), F.lit(f"::{mark}"), name).alias("symbol_id"),
                F.lit(None).cast("string").alias("parent"), tag["line"].alias("line"), tag["end_line"].alias("end_line"), signature.alias("signature"),
            )
            return F.when(wanted & name.isNotNull(), row)

        def written(name: str) -> Column:
            return F.concat(F.lit(f'{name}="'), value(name), F.lit('"'))

        field = F.coalesce(value("name"), value("id"))
        return F.array(
            symbol(F.lit(True), "element_id", value("id"), "#", written("id")),
            symbol(tag["tag"] == "script", "script_ref", value("src"), "script:", written("src")),
            symbol(tag["tag"] == "link", "style_ref", value("href"), "link:", written("href")),
            symbol(tag["tag"].isin(*FIELDS), "form_field", field, "field:", F.concat(F.lit("<"), tag["tag"], F.lit(" name="), _quoted(field), F.lit(">"))),
        )

    return F.array_compact(F.flatten(F.transform(tags, of)))


def symbols(text: Column, rel_path: Column) -> Column:
    return symbols_of(start_tags(text), rel_path)
