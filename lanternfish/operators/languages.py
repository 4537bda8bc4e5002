"""Small parsers, one a language: source text to symbols, imports and exports.

A symbol is (type, name, qualified, parent, line, end_line, signature). Parsers know declarations only. Limits: Python that
doesn't parse gives what its lines show; the languages with braces are read by a scanner that masks comments, strings and
regular expression literals (those after a sign or `return`). HTML is read by column expressions, see markup.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
from typing import NamedTuple


class Symbol(NamedTuple):
    type: str
    name: str
    qualified: str
    parent: str | None
    line: int
    end_line: int
    signature: str | None = None


class Parsed(NamedTuple):
    symbols: list[Symbol]
    imports: list[str]
    exports: list[str]


# ---- Python


def python(text: str) -> Parsed:
    """Classes with their stack of classes, functions and methods without what is inside them, modules imported."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return _python_lines(text)
    symbols: list[Symbol] = []
    imports: list[str] = []
    source = [f"{row}\n" for row in text.split("\n")]  # as the parser counts lines

    def parameters(node: ast.AST) -> str:
        """The raw parameter list, from its opening bracket to the closing one."""
        body = "".join(source[node.lineno - 1 : node.end_lineno])
        at = body.index("(", body.index("def"))
        return body[at : _closing(mask(body, "#", ""), at) + 1]

    def walk(nodes: list, stack: list[str]) -> None:
        for node in nodes:
            if isinstance(node, ast.Import):
                imports.extend(alias.name for alias in node.names)
            elif isinstance(node, ast.ImportFrom):
                imports.append("." * node.level + (node.module or ""))
            elif isinstance(node, ast.ClassDef):
                symbols.append(Symbol("class", node.name, ".".join([*stack, node.name]), stack[-1] if stack else None, node.lineno, node.end_lineno))
                walk(node.body, [*stack, node.name])
            elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                name = f"{stack[-1]}.{node.name}" if stack else node.name
                symbols.append(Symbol("method" if stack else "function", name, name, stack[-1] if stack else None, node.lineno, node.end_lineno, name + parameters(node)))
            else:
                for field in ("body", "orelse", "handlers", "finalbody", "cases"):
                    walk(getattr(node, field, None) or [], stack)

    walk(tree.body, [])
    return Parsed(symbols, imports, [])


def _block_ends(rows: list[str]) -> list[int]:
    """Of each row that isn't blank the number of the last row of its block: the rows up to the next that is no deeper."""
    ends, open_rows, last = [0] * len(rows), [], 0
    for i, row in enumerate(rows):
        if not row.strip():
            continue
        depth = len(row) - len(row.lstrip())
        while open_rows and open_rows[-1][0] >= depth:
            ends[open_rows.pop()[1]] = last
        open_rows.append((depth, i))
        last = i + 1
    for _, i in open_rows:
        ends[i] = last
    return ends


def _python_lines(text: str) -> Parsed:
    """By indentation, for text that doesn't parse."""
    symbols: list[Symbol] = []
    imports: list[str] = []
    stack: list[tuple[int, str]] = []
    rows = text.split("\n")
    ends = _block_ends(rows)
    hidden = -1  # indentation of the function at hand: what is deeper isn't seen
    for i, row in enumerate(rows):
        if not row.strip() or row.lstrip().startswith("#"):
            continue
        depth = len(row) - len(row.lstrip())
        if 0 <= hidden < depth:
            continue
        hidden = -1
        while stack and depth <= stack[-1][0]:
            stack.pop()
        end = ends[i]
        parent = stack[-1][1] if stack else None
        if m := re.match(r"\s*class\s+(\w+)", row):
            symbols.append(Symbol("class", m[1], ".".join([*(n for _, n in stack), m[1]]), parent, i + 1, end))
            stack.append((depth, m[1]))
        elif m := re.match(r"\s*(?:async\s+)?def\s+(\w+)\s*(\(.*\))?", row):
            name = f"{parent}.{m[1]}" if parent else m[1]
            symbols.append(Symbol("method" if parent else "function", name, name, parent, i + 1, end, name + (m[2] or "")))
            hidden = depth
        elif m := re.match(r"\s*from\s+([.\w]+)\s+import\b", row):
            imports.append(m[1])
        elif m := re.match(r"\s*import\s+(.+)", row):
            imports.extend(part.split()[0] for part in m[1].split(",") if part.strip())
    return Parsed(symbols, imports, [])


# ---- languages with braces


#: A regular expression literal: after what can't end a value.
_LITERAL = r"(?:(?<=[=(,:!&|?;{}\[\n])|(?<==>)|(?<=\breturn))[ \t]*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*"


def mask(text: str, line_mark: str = "//", quotes: str = "\"'`", literals: bool = False) -> str:
    """Text of the same length in which comments, insides of strings and, if asked for, regular expressions are blank."""
    comment = rf"{re.escape(line_mark)}[^\n]*" + (r"|/\*.*?(?:\*/|\Z)" if line_mark == "//" else "")
    strings = "|".join(rf"{q}(?:\\.|[^\\{q}\n])*{q}" if q != "`" else r"`(?:\\.|[^\\`])*`" for q in quotes or "\"'")
    blank = lambda m: re.sub(r"[^\n]", " ", m[0]) if m[0][:1] not in "\"'`" else m[0][0] + re.sub(r"[^\n]", " ", m[0][1:-1]) + m[0][-1]
    return re.sub(f"(?s:{comment}|{strings}{'|' + _LITERAL if literals else ''})", blank, text)


def _closing(masked: str, at: int) -> int:
    """Where the bracket opened at a place closes, or the end."""
    depth = 0
    for m in re.compile(r"[(){}\[\]]").finditer(masked, at):
        depth += 1 if m[0] in "([{" else -1
        if not depth:
            return m.start()
    return len(masked) - 1


class _Scan:
    def __init__(self, text: str, literals: bool = False):
        self.text, self.masked = text, mask(text, literals=literals)
        self.line_ends = [m.start() for m in re.finditer("\n", text)]
        self.marks = [m.start() for m in re.finditer("[{};]", self.masked)]

    def line(self, at: int) -> int:
        return bisect_left(self.line_ends, at) + 1

    def statement(self, start: int, at: int) -> str:
        """What stands before a place, from the last brace or semicolon on."""
        i = bisect_left(self.marks, at)
        return self.masked[max(start, self.marks[i - 1] + 1 if i else 0) : at]

    def block(self, at: int, limit: int) -> tuple[int, int] | None:
        """The braces that follow a place before a semicolon does."""
        m = re.compile(r"[{;]").search(self.masked, at, limit)
        return (m.start(), _closing(self.masked, m.start())) if m and m[0] == "{" else None


_PLAIN_WORDS = {"if", "for", "foreach", "while", "switch", "catch", "return", "using", "lock", "function", "new", "await", "else", "do", "throw", "super", "this", "assert", "typeof", "sizeof", "when"}


def csharp(text: str) -> Parsed:
    scan = _Scan(text)
    masked = scan.masked
    imports = [m[1] for m in re.finditer(r"(?m)^\s*(?:global\s+)?using\s+(?:static\s+)?([\w.]+)\s*[=;]", masked)]
    symbols: list[Symbol] = []
    kinds = re.compile(r"\b(class|struct|record(?:\s+(?:class|struct))?|interface|enum)\s+(\w+)|(?<=[\w>\]?])\s+(\w+)\s*(?:<[^<>()]*>)?\s*(\()|\b(namespace)\s+[\w.]+\s*\{")

    def types(parameters: str) -> str:
        """One part a parameter that isn't of a plain named type: built-in, generic, array, nullable or dotted."""
        found = []
        for p in _parts(parameters):
            p = re.sub(r"\[[^\]]*\]\s*(?=\w)|\b(?:this|ref|out|in|params)\s+|=.*", "", p).strip()
            kind = p.rsplit(None, 1)[0] if " " in p else ""
            if kind and (re.search(r"[<>\[\]?.]", kind) or kind in ("bool", "byte", "char", "decimal", "double", "dynamic", "float", "int", "long", "object", "sbyte", "short", "string", "uint", "ulong", "ushort", "void")):
                found.append(kind)
        return ",".join(found)

    def walk(start: int, end: int, stack: list[str]) -> None:
        at = start
        while m := kinds.search(masked, at, end):
            at = m.end()
            if m[5]:
                continue
            if m[1]:
                block = scan.block(at, end)
                close = block[1] if block else (semicolon if (semicolon := masked.find(";", at, end)) >= 0 else end)
                kind = m[1] if m[1] in ("interface", "enum") else "class"
                symbols.append(Symbol(kind, m[2], ".".join([*stack, m[2]]), stack[-1] if stack else None, scan.line(m.start()), scan.line(close)))
                if block and kind != "enum":
                    walk(block[0] + 1, block[1], [*stack, m[2]])
                at = close + 1
            elif stack and m[3] not in (*_PLAIN_WORDS, stack[-1]):  # a constructor has the name of its class
                close = _closing(masked, m.start(4))
                tail = re.compile(r"\s*(?:where[^{;]*)?(\{|=>|;)").match(masked, close + 1)
                before = scan.statement(start, m.start(3))
                if tail and "=" not in before and not re.search(r"\b(?:new|return|delegate|event)\b", before):
                    finish = _closing(masked, tail.start(1)) if tail[1] == "{" else masked.find(";", tail.start(1))
                    finish = finish if finish >= 0 else end
                    name = f"{stack[-1]}.{m[3]}"
                    signature = f"{name}({types(scan.text[m.end(4):close])})"
                    symbols.append(Symbol("method", name, signature, stack[-1], scan.line(m.start(3)), scan.line(finish), signature))
                    at = finish + 1
                elif tail and tail[1] == "{":
                    at = _closing(masked, tail.start(1)) + 1
                else:
                    at = close + 1

    walk(0, len(masked), [])
    return Parsed(symbols, imports, [])


def _parts(text: str) -> list[str]:
    """Split at commas that aren't inside brackets."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "<([{") - (c in ">)]}")
        if c == "," and not depth:
            out.append(text[start:i])
            start = i + 1
    return [p for p in [*out, text[start:]] if p.strip()]


#: Calls whose string argument names what their callback defines.
REGISTRATIONS = ("controller", "service", "factory", "directive", "component", "filter", "provider", "config", "run")
_ALIASES = ("$scope", "vm", "self", "this")
_FUNCTION = r"(?:async\s+)?(?:function\b|\([^()]*\)\s*=>|\w+\s*=>)"


def javascript(text: str, typed: bool = False) -> Parsed:
    scan = _Scan(text, literals=True)
    masked, raw = scan.masked, scan.text
    symbols: list[Symbol] = []
    imports = [raw[m.start(1) + 1 : m.end(1) - 1] for m in re.finditer(r"(?m)^\s*import\b[^;\n]*?(['\"][^'\"\n]*['\"])", masked)]
    exports: list[str] = []
    if typed:
        exports += re.findall(r"\bexport\s+(?:declare\s+)?(?:const\s+)?(?:interface|type|enum)\s+(\w+)", masked)
    for m in re.finditer(r"\bexport\s+(?:default\s+)?(?:(?:async\s+)?function\s*\*?\s*(\w+)|(?:abstract\s+)?class\s+(\w+)|(?:const|let|var)\s+(\w+)|\{([^}]*)\})", masked):
        exports += [x.split()[0] for x in m[4].split(",") if x.strip()] if m[4] is not None else [m[1] or m[2] or m[3]]

    def add(kind: str, name: str, container: str | None, at: int, end: int) -> None:
        symbols.append(Symbol(kind, name, f"{container}.{name}" if container else name, container, scan.line(at), scan.line(end)))

    declared = re.compile(
        rf"\b(?:async\s+)?function\s*\*?\s*(?P<function>[\w$]+)\s*\(|\bclass\s+(?P<class>[\w$]+)|\b(?:const|let|var)\s+(?P<var>[\w$]+)[^=;\n]*=\s*(?P<value>{_FUNCTION}|\{{)"
        rf"|(?P<target>[\w$]+(?:\??\.[\w$]+)+)\s*=\s*{_FUNCTION}|\.(?P<call>{'|'.join(REGISTRATIONS)})\s*\(\s*(?P<arg>['\"])" + (r"|\b(?P<typed>interface|type|enum)\s+(?P<name>\w+)" if typed else "")
    )
    member = re.compile(rf"(?:^|[,{{;}}\n])\s*(?:(?:static|async|get|set|public|private|protected|readonly|override)\s+)*\*?\s*(?P<name>[\w$]+|['\"][^'\"]*['\"])\s*(?:(?P<call>\()|:\s*(?:(?P<value>{_FUNCTION})|(?P<nested>\{{)))")

    def end_of(at: int, limit: int) -> int:
        """The end of a function's or an expression's body that begins after a place."""
        block = scan.block(at, limit)
        end = masked.find(";", at, limit)
        return block[1] if block else end if end >= 0 else min(limit, len(masked) - 1)

    def body_end(value: re.Match, limit: int) -> int:
        """The end of a function given as a value: its block, or for a short arrow the end of its expression."""
        at = value.end("value")
        if not value["value"].endswith("=>") or re.compile(r"\s*\{").match(masked, at):
            return end_of(at, limit)
        depth = 0
        for m in re.compile(r"[(){}\[\],;\n]").finditer(masked, at, limit):
            if not depth and m[0] in ",;\n)}]" and masked[at : m.start()].strip():
                return m.start() - 1
            depth += (m[0] in "([{") - (m[0] in ")}]")
        return limit - 1

    def members(start: int, end: int, container: str) -> None:
        at = start
        while m := member.search(masked, at, end):
            name = raw[m.start("name") : m.end("name")].strip("'\"")
            if m["nested"]:
                close = _closing(masked, m.start("nested"))
                members(m.start("nested"), close, name)
                at = close
            elif name in _PLAIN_WORDS:
                at = m.end()
            else:
                close = _closing(masked, m.start("call")) if m["call"] else m.start("value")
                block = scan.block(close, end)
                if m["value"] or block and re.fullmatch(r"\)\s*(?::[^{};]*)?", masked[close : block[0]]):
                    finish = body_end(m, end) if m["value"] else block[1]
                    add("method", name, container, m.start("name"), finish)
                    at = finish + 1
                else:
                    at = close + 1

    def walk(start: int, end: int, container: str | None) -> None:
        at = start
        while m := declared.search(masked, at, end):
            at = m.end()
            if m["function"]:
                finish = end_of(_closing(masked, m.end() - 1), end)
                add("function", m["function"], container, m.start(), finish)
                at = finish + 1
            elif m["class"]:
                if block := scan.block(at, end):
                    add("class", m["class"], container, m.start(), block[1])
                    members(block[0], block[1], m["class"])
                    at = block[1] + 1
            elif m["var"]:
                if m["value"] == "{":
                    close = _closing(masked, m.start("value"))
                    members(m.start("value"), close, m["var"])
                    at = close + 1
                else:
                    finish = body_end(m, end)
                    if "=>" in m["value"]:
                        add("function", m["var"], container, m.start(), finish)
                    at = finish + 1
            elif m["target"]:
                chain = [x for x in m["target"].replace("?.", ".").split(".") if x]
                owner = chain[chain.index("prototype") - 1] if "prototype" in chain[1:] else container if chain[0] in _ALIASES and container else chain[-2]
                finish = end_of(m.end("target"), end)
                add("method", chain[-1], owner, m.start(), finish)
                at = finish + 1
            elif m["call"]:
                open_at = masked.index("(", m.start("call"))
                close = _closing(masked, open_at)
                name = re.compile(r"[^'\"]*").match(raw, m.end("arg"))[0]
                after = m.end("arg") + len(name) + 1
                direct = re.compile(r"\s*,\s*" + _FUNCTION).match(masked, after)
                if block := scan.block(after, close):
                    walk(block[0] + 1, block[1], name if direct else container)
                at = close + 1
            elif typed and m["typed"]:
                kind = {"type": "type_alias"}.get(m["typed"], m["typed"])
                block = scan.block(at, end)
                finish = block[1] if block else end_of(at, end)
                add(kind, m["name"], container, m.start(), finish)
                at = finish + 1

    walk(0, len(masked), None)
    return Parsed(symbols, imports, exports)


def typescript(text: str) -> Parsed:
    return javascript(text, typed=True)


def dart(text: str) -> Parsed:
    scan = _Scan(text)
    masked, raw = scan.masked, scan.text
    imports = [raw[m.start(1) + 1 : m.end(1) - 1] for m in re.finditer(r"(?m)^\s*import\s+(['\"][^'\"\n]*['\"])", masked)]
    symbols: list[Symbol] = []
    found = re.compile(r"\b(class|mixin|enum)\s+(\w+)|(?<=[\w>\]?])\s+(\w+)\s*(\()")

    def walk(start: int, end: int, container: str | None) -> None:
        at = start
        while m := found.search(masked, at, end):
            at = m.end()
            if m[1]:
                if block := scan.block(at, end):
                    symbols.append(Symbol("class", m[2], m[2], container, scan.line(m.start()), scan.line(block[1])))
                    if m[1] != "enum":
                        walk(block[0] + 1, block[1], m[2])
                    at = block[1] + 1
            elif m[3] not in _PLAIN_WORDS:
                close = _closing(masked, m.start(4))
                tail = re.compile(r"\s*(?:async\*?|sync\*)?\s*(\{|=>|;)").match(masked, close + 1)
                if tail and "=" not in scan.statement(start, m.start(3)):
                    name = f"{container}.{m[3]}" if container else m[3]
                    last = close if container else _closing(masked, tail.start(1)) if tail[1] == "{" else max(masked.find(";", close), close)
                    symbols.append(Symbol("method" if container else "function", name, name, container, scan.line(m.start(3)), scan.line(last), name + raw[m.start(4) : close + 1]))
                    at = (_closing(masked, tail.start(1)) if tail[1] == "{" else max(masked.find(";", close), close)) + 1
                else:
                    at = close + 1

    walk(0, len(masked), None)
    return Parsed(symbols, imports, [])


PARSERS = {"python": python, "csharp": csharp, "javascript": javascript, "typescript": typescript, "dart": dart}
