"""Declarations of Java sources as a table: classes with their annotations, fields, methods and calls.

A small reader goes over a file's tokens once. It knows declarations, not expressions: of a body it
keeps the text and the method calls, each with the expression that it is called on and the loops
around it. What the resolvers make of that is DataFrame logic.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ANNOTATION = "struct<name:string,args:array<struct<key:string,value:string>>>"
PARAM = f"struct<name:string,type:string,annotations:array<{ANNOTATION}>>"
CALL = "struct<scope:string,name:string,args:array<string>,text:string,loops:array<struct<n:int,type:string>>>"
CLASSES = (
    "array<struct<package:string,name:string,fqn:string,kind:string,at:int,extends:array<string>,implements:array<string>,"
    f"annotations:array<{ANNOTATION}>,fields:array<{PARAM}>,constructors:array<struct<params:array<{PARAM}>>>,"
    f"methods:array<struct<name:string,type:string,params:array<{PARAM}>,annotations:array<{ANNOTATION}>,body:string,calls:array<{CALL}>,"
    f"locals:array<struct<name:string,type:string>>>>,calls:array<{CALL}>,imports:array<string>>>"
)
TOKEN = re.compile(
    r"//[^\n]*|/\*.*?\*/|\"\"\".*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|[\w$]+(?:\.\d+)?|->|::|\.\.\.|\S", re.DOTALL
)
# Words of the language.
MODIFIERS = frozenset(
    "public protected private static final abstract synchronized native transient volatile strictfp default sealed non".split()
)
TYPES = frozenset("class interface enum record".split())
NO_CALLS = frozenset(
    "if for while switch catch synchronized return throw assert else do try new super this instanceof case yield".split()
)
CLOSES = {"(": ")", "[": "]", "{": "}", "<": ">"}
NAME = re.compile(r"[A-Za-z_$][\w$]*")


def pieces(tokens: list[str]) -> list[str]:
    """Each token as it stands in a text: a space between words and after commas only."""
    out, last = [], ""
    for t in tokens:
        wide = last and (last.isalnum() or last in "_$?\"'") and (t[0].isalnum() or t[0] in "_$@")
        out.append((" " if wide else "") + t + (" " if t == "," else ""))
        last = out[-1][-1]
    return out


def words(tokens: list[str]) -> str:
    """Tokens as text."""
    return "".join(pieces(tokens)).strip()


def matches(tokens: list[str]) -> list[int]:
    """For each bracket the place of its partner; its own place where it has none. Kinds of brackets count alike, as in close()."""
    out, opened = list(range(len(tokens))), []
    for at, t in enumerate(tokens):
        if t in ("(", "[", "{"):
            opened.append(at)
        elif t in (")", "]", "}") and opened:
            start = opened.pop()
            out[at], out[start] = start, at
    return out


class Reader:
    """Reads the declarations of one file."""

    def __init__(self, text: str) -> None:
        self.tokens = [t for t in TOKEN.findall(text) if not t.startswith(("//", "/*"))]
        self.at, self.package, self.found, self.imports = 0, "", [], []

    def peek(self, ahead: int = 0) -> str:
        at = self.at + ahead
        return self.tokens[at] if at < len(self.tokens) else ""

    def take(self) -> str:
        self.at += 1
        return self.peek(-1)

    def close(self, at: int) -> int:
        """Place after the bracket that closes the one at a place; angles count only among types."""
        kind, depth = self.tokens[at], 0
        pairs = {kind: 1, CLOSES[kind]: -1} if kind == "<" else {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}
        while at < len(self.tokens):
            depth += pairs.get(self.tokens[at], 0)
            at += 1
            if depth <= 0:
                break
        return at

    def group(self) -> list[str]:
        """The tokens inside the bracket that starts here; goes on after it."""
        start, self.at = self.at, self.close(self.at)
        return self.tokens[start + 1 : self.at - 1]

    def file(self) -> list[dict]:
        while self.at < len(self.tokens):
            if self.peek() in ("package", "import"):
                first, name = self.take(), []
                while self.peek() not in (";", ""):
                    name.append(self.take())
                if first == "package":
                    self.package = "".join(name)
                elif name:
                    # `static` stays in front: what follows may be a member as well as a type
                    self.imports.append(words(name))
            elif not self.declaration([]):
                self.take()
        return self.found

    def marks(self) -> list[dict]:
        """Annotations and modifiers, which are passed over."""
        out = []
        while True:
            if self.peek() == "@" and self.peek(1) != "interface":
                self.take()
                name = self.take()
                while self.peek() == ".":
                    self.take()
                    name = self.take()
                out.append({"name": name, "args": pairs(self.group()) if self.peek() == "(" else []})
            elif self.peek() in MODIFIERS and self.peek(1) not in ("(", "=", ";", ",", "."):
                self.take()
                if self.peek() == "-":
                    self.take()
                    self.take()
            else:
                return out

    def type(self) -> str:
        """A type with its arguments and dimensions."""
        out = []
        while self.peek():
            if self.peek() == "@" and self.peek(1) != "interface":
                self.marks()
                continue
            out.append(self.take())
            if self.peek() == "<":
                start, self.at = self.at, self.close(self.at)
                out += self.tokens[start : self.at]
            while self.peek() == "[" and self.peek(1) == "]":
                out += [self.take(), self.take()]
            if self.peek() != ".":
                break
            out.append(self.take())
        return words(out)

    def declaration(self, outer: list[str]) -> bool:
        """A type's declaration, if one starts here."""
        start = self.at
        marks = self.marks()
        annotation = self.peek() == "@" and self.peek(1) == "interface"
        self.at += annotation
        kind = self.peek()
        if kind not in TYPES or not re.match(r"[\w$]", self.peek(1)) or (kind == "record" and self.peek(2) not in ("(", "<")):
            self.at = start
            return False
        self.take()
        name = self.take()
        made = {
            "package": self.package, "name": name, "fqn": ".".join([*filter(None, [self.package]), *outer, name]), "kind": "annotation" if annotation else kind,
            "at": len(self.found), "extends": [], "implements": [], "annotations": marks, "fields": [], "constructors": [],
            "methods": [], "calls": [], "imports": self.imports,
        }
        self.found.append(made)
        where = None
        while self.peek() not in ("{", ""):
            if self.peek() == "<":
                self.at = self.close(self.at)
            elif self.peek() == "(":
                self.group()
            elif self.peek() in ("extends", "implements", "permits"):
                where = self.take()
            elif self.peek() == ",":
                self.take()
            else:
                made.get(where, []).append(self.type())
        end = self.close(self.at) if self.peek() else self.at
        self.take()
        if kind == "enum":
            depth = 0
            while self.at < end - 1 and not (self.peek() == ";" and depth == 0):
                depth += (self.peek() in "([{") - (self.peek() in ")]}")
                self.take()
        while self.at < end - 1:
            before = self.at
            self.member(made, [*outer, name], end)
            # whatever cannot be read is passed over
            self.at = max(self.at, before + 1)
        self.at = end
        return True

    def member(self, made: dict, outer: list[str], end: int) -> None:
        if self.peek() == ";":
            self.take()
        elif self.peek() == "{" or self.peek() == "static" and self.peek(1) == "{":
            self.at += self.peek() == "static"
            made["calls"] += calls(self.group())
        elif not self.declaration(outer):
            marks = self.marks()
            if self.peek() == "<":
                self.at = self.close(self.at)
            built = self.peek() == outer[-1] and self.peek(1) == "("
            kind = "" if built else self.type()
            name = self.take()
            if self.peek() == "(":
                method = {"name": name, "type": kind, "params": params(self.group()), "annotations": marks, "body": None, "calls": [], "locals": []}
                while self.peek() not in ("{", ";", "") and self.at < end:
                    self.take()
                if self.peek() == "{":
                    inside = self.group()
                    method |= {"body": lines(inside), "calls": calls(inside), "locals": variables(inside)}
                else:
                    self.take()
                made["constructors" if built else "methods"].append(method)
                made["calls"] += method["calls"]
                return
            while self.at < end:
                dims = ""
                while self.peek() == "[":
                    self.group()
                    dims += "[]"
                made["fields"].append({"name": name, "type": kind + dims, "annotations": marks})
                start = self.at
                while self.peek() not in (",", ";", "") and self.at < end:
                    self.at = self.close(self.at) if self.peek() in "([{" else self.at + 1
                made["calls"] += calls(self.tokens[start : self.at])
                if self.take() != ",":
                    break
                name = self.take()


def split(tokens: list[str]) -> list[list[str]]:
    """Tokens between commas that no bracket holds."""
    out, depth = [[]], 0
    for n, t in enumerate(tokens):
        depth += (t in ("(", "[", "{")) - (t in (")", "]", "}"))
        depth += (t == "<" and n and tokens[n - 1][:1].isupper()) - (t == ">" and depth > 0 and "<" in out[-1] and tokens[n - 1] != "-")
        if t == "," and depth == 0:
            out.append([])
        else:
            out[-1].append(t)
    return [x for x in out if x]


def pairs(tokens: list[str]) -> list[dict]:
    """An annotation's arguments; the key of a single value is empty."""
    parts = split(tokens)
    named = [p for p in parts if len(p) > 2 and p[1] == "="]
    if len(named) == len(parts):
        return [{"key": p[0], "value": words(p[2:])} for p in named]
    return [{"key": "", "value": words(tokens)}]


def params(tokens: list[str]) -> list[dict]:
    out = []
    for part in split(tokens):
        reader = Reader("")
        reader.tokens = part
        marks = reader.marks()
        kind = reader.type()
        if reader.peek() == "...":
            kind += reader.take()
        out.append({"name": reader.take(), "type": kind, "annotations": marks})
    return out


def lines(tokens: list[str]) -> str:
    """A body's text, a line for each statement."""
    out, line = [], []
    for t in tokens:
        line.append(t)
        if t in (";", "{", "}"):
            out.append(words(line))
            line = []
    return "\n".join([*out, words(line)]).strip()


def loops(tokens: list[str]) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the bodies of loops in the order of their starts."""
    reader, out = Reader(""), []
    reader.tokens = tokens
    for at, t in enumerate(tokens):
        if t in ("for", "while") and tokens[at + 1 : at + 2] == ["("]:
            start = reader.close(at + 1)
            head = tokens[at + 1 : start]
            kind = t if t == "while" else "for" if ";" in head else "foreach"
        elif t == "do":
            start, kind = at + 1, "do-while"
        else:
            continue
        end = start
        if tokens[start : start + 1] == ["{"]:
            end = reader.close(start)
        else:
            while end < len(tokens) and tokens[end] != ";":
                end = reader.close(end) if tokens[end] in "([{" else end + 1
        out.append((kind, start, end))
    return out


def starts(tokens: list[str], match: list[int]) -> list[int]:
    """For each place the start of the expression that ends before it, in one pass: each looks at shorter ones."""
    out = [0] * (len(tokens) + 1)
    for end in range(1, len(tokens) + 1):
        t, at = tokens[end - 1], end
        if t in (")", "]"):
            at = match[end - 1]
            before = tokens[at - 1] if at else ""
            if at and re.match(r"[\w$]+$", before) and before not in NO_CALLS - {"this", "super"}:
                out[end] = out[at]
                continue
        elif re.match(r"[\w$\"']", t):
            at = end - 1
        if at < end and at > 1 and tokens[at - 1] == ".":
            at = out[at - 1]
        if at and tokens[at - 1] == "new":
            at -= 1
        out[end] = at
    return out


def calls(tokens: list[str]) -> list[dict]:
    """The method calls of a body in order."""
    around, out, match = loops(tokens), [], matches(tokens)
    begins, parts = starts(tokens, match), pieces(tokens)
    text, ends = "".join(parts), [0]
    for p in parts:
        ends.append(ends[-1] + len(p))
    for at, t in enumerate(tokens):
        if tokens[at + 1 : at + 2] != ["("] or not re.match(r"[A-Za-z_$][\w$]*$", t) or t in NO_CALLS:
            continue
        end = match[at + 1] + 1 if match[at + 1] > at + 1 else len(tokens)
        start = begins[at - 1] if at and tokens[at - 1] == "." else at
        if start == at and at and (tokens[at - 1] == "new" or re.match(r"[\w$>\]]", tokens[at - 1]) and tokens[at - 1] not in NO_CALLS):
            continue  # a constructor's call or a local declaration
        if tokens[start] == "new" and all(x == "." or NAME.fullmatch(x) for x in tokens[start + 1 : at]):
            continue  # a constructor's call by a longer name
        out.append({
            "scope": text[ends[start] : ends[at - 1]].strip() if start < at else None, "name": t,
            "args": [words(a) for a in split(tokens[at + 2 : end - 1])], "text": text[ends[start] : ends[end]].strip(),
            "loops": [{"n": n, "type": kind} for n, (kind, a, b) in enumerate(around) if a <= at < b],
        })
    return out


def variables(tokens: list[str]) -> list[dict]:
    """The local variables of a body with their types; `var` has the type that it is made of, if it is made here."""
    out = []
    for at, t in enumerate(tokens):
        if at == 0 or tokens[at + 1 : at + 2] not in (["="], [";"], [":"]) or not NAME.fullmatch(t) or t in NO_CALLS:
            continue
        start = at
        while start and tokens[start - 1] in ("[", "]"):
            start -= 1
        if start and tokens[start - 1] == ">":
            depth = 0
            while start:
                start -= 1
                depth += (tokens[start] == ">") - (tokens[start] == "<")
                if depth == 0 or tokens[start] in (";", "{", "}", "("):
                    break
        begin = start
        while begin and NAME.fullmatch(tokens[begin - 1]) and tokens[begin - 1] not in NO_CALLS and tokens[begin - 1] not in MODIFIERS:
            begin -= 1
            if begin and tokens[begin - 1] == ".":
                begin -= 1
            else:
                break
        kind = words(tokens[begin:at])
        if begin == at or begin == start or tokens[begin : begin + 1] == ["."]:
            continue
        if kind == "var":
            made = tokens[at + 2 : at + 3] == ["new"]
            kind = re.match(r"[\w$.]*", words(tokens[at + 3 : at + 12])).group() if made else ""
        if kind:
            out.append({"name": t, "type": kind})
    return out


def declarations(text: str | None) -> list[dict] | None:
    """The types that a file declares; None where it cannot be read."""
    try:
        return Reader(text or "").file()
    except (IndexError, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def _declared(texts: pd.Series) -> pd.Series:
    return pd.Series([None if (d := declarations(t)) is None else json.dumps(d) for t in texts], dtype=object)


# else a filter on its result is moved before a shuffle of the files, and all are read twice
_declared = _declared.asNondeterministic()


def parsed(files: DataFrame) -> DataFrame:
    """(file, status, types) of files of (file, text): status is `parsed` or `failed`."""
    rows = files.where(F.col("file").endswith(".java")).select("file", F.from_json(_declared("text"), CLASSES).alias("types"))
    return rows.select("file", F.when(F.col("types").isNull(), "failed").otherwise("parsed").alias("status"), "types")


def types(files: DataFrame) -> DataFrame:
    """One row for each declared type: file, package, name, fqn, kind, annotations, fields, methods, calls, imports ..."""
    return parsed(files).select("file", F.inline("types"))


def classes(files: DataFrame) -> DataFrame:
    """The classes and interfaces among types()."""
    return types(files).where("kind in ('class', 'interface')")
