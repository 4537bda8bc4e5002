"""Files to symbols: one row in, one row out, with the symbols as an array. Spark deals the files out; each is parsed alone."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import tokens as T
from . import languages, markup

SYMBOL = "struct<type:string,name:string,symbol_id:string,parent:string,line:int,end_line:int,signature:string>"
SCHEMA = f"path string, rel_path string, language string, line_count int, imports array<string>, exports array<string>, symbols array<{SYMBOL}>, error string, text string"

#: Characters at the start in which a NUL means that a file is binary.
SNIFFED = 8000


def decode(content: object) -> str:
    """Bytes as UTF-8 without what is invalid, line ends as \\n; text stays."""
    text = content if isinstance(content, str) else bytes(content or b"").decode("utf-8", "ignore")
    return text.replace("\r\n", "\n").replace("\r", "\n")


def text_of(content: Column) -> Column:
    """decode() of a column: what parsers see, so lines of a slice are those that they number."""

    @F.pandas_udf("string")
    def decoded(column: pd.Series) -> pd.Series:
        return column.map(lambda x: None if x is None else decode(x))

    return decoded(content)


def parse_file(path: str, rel_path: str, language: str, content: object) -> dict:
    text = decode(content)
    row = {"path": path, "rel_path": rel_path, "language": language, "line_count": 0, "imports": [], "exports": [], "symbols": [], "error": None, "text": None}
    if "\0" in text:
        return row | {"error": "binary file"}
    try:
        found = languages.PARSERS[language](text) if language in languages.PARSERS else languages.Parsed([], [], [])
    except Exception as why:  # a file that can't be parsed is a row with its error, not a failed job
        return row | {"error": f"{type(why).__name__}: {why}"}
    rel = rel_path.replace("\\", "/")
    symbols = [{"type": s.type, "name": s.name, "symbol_id": f"{rel}::{s.qualified}", "parent": s.parent, "line": s.line, "end_line": s.end_line, "signature": s.signature} for s in found.symbols]
    return row | {"line_count": text.count("\n") + 1, "imports": found.imports, "exports": found.exports, "symbols": symbols, "text": text}


def parse(files: DataFrame) -> DataFrame:
    """From (path, content[, rel_path]) of any files: those in a known language that aren't binary from the start. Ids of
    symbols begin with rel_path, or with path. text is what was parsed. Symbols of HTML are found by column expressions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [parse_file(*row) for row in batch[["path", "rel_path", "language", "content"]].itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["path", "rel_path", "language", "line_count", "imports", "exports", "symbols", "error", "text"])

    rel_path = F.col("rel_path" if "rel_path" in files.columns else "path")
    known = files.select("path", rel_path.alias("rel_path"), P.language(F.col("path")).alias("language"), "content").where("language is not null and content is not null")
    text = F.col("content") if dict(files.dtypes)["content"] == "string" else F.decode(F.substring("content", 1, SNIFFED), "ISO-8859-1")
    parsed = known.where(F.instr(F.substring(text, 1, SNIFFED), "\0") == 0).mapInPandas(run, SCHEMA)
    marked_up = (F.col("language") == "html") & F.col("error").isNull()
    return parsed.withColumn("symbols", F.when(marked_up, markup.symbols(F.col("text"), F.col("rel_path"))).otherwise(F.col("symbols"))).drop("rel_path")


def totals(parsed: DataFrame) -> DataFrame:
    """One row: files, symbols and errors. A file with an error counts as both."""
    return parsed.agg(F.count("*").alias("files"), F.coalesce(F.sum(F.size("symbols")), F.lit(0)).alias("symbols"), F.count("error").alias("errors"))


def symbols(parsed: DataFrame) -> DataFrame:
    """A row a symbol, with its body; of equal ids in a file the last stays."""
    rows = parsed.select("path", "language", "text", F.posexplode("symbols").alias("at", "s")).select("path", "language", "text", "at", "s.*")
    rows = rows.withColumn("body_text", T.body_slice(F.col("text"), F.col("line"), F.col("end_line")))
    return rows.groupBy("path", "language", "symbol_id").agg(F.max_by(F.struct("type", "name", "parent", "line", "end_line", "signature", "body_text"), "at").alias("s")).select("path", "language", "symbol_id", "s.*")
