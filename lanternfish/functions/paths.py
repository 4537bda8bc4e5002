"""Path functions: extensions, languages, pruning, globs, keys."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions by language.
LANGUAGES = {
    ".cs": "csharp",
    ".js": "javascript",
    ".jsx": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".html": "html",
    ".htm": "html",
    ".py": "python",
    ".pyw": "python",
    ".dart": "dart",
}

#: Names of directories that are never read.
EXCLUDED = (
    ".git",
    ".hg",
    ".svn",
    "node_modules",
    "__pycache__",
    ".venv",
    "venv",
    ".env",
    "dist",
    "build",
    "out",
    "bin",
    "obj",
    ".vs",
    ".idea",
    ".vscode",
    "coverage",
    ".nyc_output",
    "Migrations",
)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def language(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return table[extension(path)]


def supported(path: Column) -> Column:
    return extension(path).isin(*LANGUAGES)


def directories(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def pruned_in_scan(rel_path: Column) -> Column:
    """Whether a directory on the way is excluded or hidden. For paths relative to the root."""
    return F.exists(directories(rel_path), lambda d: d.isin(*EXCLUDED) | F.startswith(d, F.lit(".")))


def pruned_in_stream(path: Column) -> Column:
    """Whether any part of an absolute path is excluded; hidden directories as such aren't."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, EXCLUDED)))


def glob_pattern(glob: str) -> str:
    """A regular expression for a shell pattern in which * and ? also match /."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        close = glob.find("]", i + 2 + (glob[i + 1 : i + 2] in ("!", "^"))) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif close > 0:
            inside = glob[i + 1 : close]
            negated = inside[:1] in ("!", "^")
            out.append("[" + "^" * negated + inside[negated:].replace("\\", "\\\\").replace("[", "\\[") + "]")
            i = close
        else:
            out.append(c if c.isalnum() or c in "_/" else "\\" + c)
        i += 1
    return "(?s)^" + "".join(out) + "$"


def matches_glob(path: Column, glob: str) -> Column:
    return F.rlike(path, F.lit(glob_pattern(glob))) if glob not in ("", "*") else F.lit(True)


def project_key(path: Column) -> Column:
    """The name of a project's folder: the first 12 hex digits of the md5 of its path."""
    return F.substring(F.md5(path.cast("binary")), 1, 12)


def symbol_id(rel_path: Column, qualified: Column) -> Column:
    return F.concat(F.replace(rel_path, F.lit("\\"), F.lit("/")), F.lit("::"), qualified)


def normalised(path: str, root: str) -> str:
    """The absolute path that a user means: ~ expanded, relative to the root, without . and .. parts."""
    return os.path.normpath(os.path.join(root, os.path.expanduser(path)))
