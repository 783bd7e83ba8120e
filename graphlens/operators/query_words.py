"""The words of a search: terms, phrases, prefixes and near terms, fields, boosts, and how they are combined."""

from __future__ import annotations

import re
from dataclasses import dataclass

LEXEME = re.compile(r'\s*(?:(&&|\|\||[()!+\-:])|"((?:[^"\\]|\\.)*)"|((?:[^\s()":^~*\\]|\\.)+)|(\^\d+(?:\.\d+)?)|(~\d*)|(\*))')
WORD = re.compile(r"[^\W]+")


class BadQuery(ValueError):
    """A text that is no query."""


@dataclass
class Leaf:
    """Words in a field (None: all fields); kind is term, phrase, prefix or near."""

    kind: str
    words: list[str]
    field: str | None = None
    boost: float = 1.0
    edits: int = 0


@dataclass
class Group:
    """Parts with their role: + must, - must not, and a blank for may."""

    parts: list[tuple[str, Leaf | Group]]
    boost: float = 1.0


def _lexemes(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while text[at:].strip():
        m = LEXEME.match(text, at)
        if not m:
            raise BadQuery(text)
        kind = ("sign", "phrase", "word", "boost", "near", "star")[m.lastindex - 1]
        word = m.group(m.lastindex)
        if kind == "word" and word in ("AND", "OR", "NOT"):
            kind = "sign"
        # only what touches the word before belongs to it
        if kind in ("boost", "near", "star") and (m.start(m.lastindex) != at or not out):
            raise BadQuery(text)
        out.append((kind, word))
        at = m.end()
    return out


class _Reader:
    def __init__(self, text: str, fields: tuple[str, ...]) -> None:
        self.rest, self.fields = _lexemes(text), fields

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.rest[ahead] if ahead < len(self.rest) else ("", "")

    def take(self) -> tuple[str, str]:
        if not self.rest:
            raise BadQuery("unfinished")
        return self.rest.pop(0)

    def group(self, field: str | None) -> Group:
        parts: list[tuple[str, Leaf | Group]] = []
        while self.rest and self.peek() != ("sign", ")"):
            joined = self.take()[1] if self.peek() in (("sign", "AND"), ("sign", "OR"), ("sign", "&&"), ("sign", "||")) else ""
            if joined and not parts:
                raise BadQuery(joined)
            role = " "
            while self.peek() in (("sign", "+"), ("sign", "-"), ("sign", "NOT"), ("sign", "!")):
                role = "+" if self.take()[1] == "+" else "-"
            both = joined in ("AND", "&&")
            if both and parts[-1][0] == " ":
                parts[-1] = ("+", parts[-1][1])
            parts.append(("+" if both and role == " " else role, self.clause(field)))
        return Group(parts)

    def clause(self, field: str | None) -> Leaf | Group:
        if self.peek()[0] == "word" and self.peek(1) == ("sign", ":"):
            field = self.take()[1]
            self.take()
            if field not in self.fields:
                raise BadQuery(field)
        kind, word = self.take()
        if (kind, word) == ("sign", "("):
            out: Leaf | Group = self.group(field)
            if self.take() != ("sign", ")") or not out.parts:
                raise BadQuery("brackets")
        elif kind in ("word", "phrase"):
            words = WORD.findall(re.sub(r"\\(.)", r"\1", word).lower())
            out = Leaf("phrase" if len(words) != 1 else "term", words, field)
            if self.peek()[0] == "star" and kind == "word" and len(words) == 1:
                self.take()
                out.kind = "prefix"
            elif self.peek()[0] == "near" and kind == "word" and len(words) == 1:
                out.kind, out.edits = "near", min(int(self.take()[1][1:] or 2), 2)
        else:
            raise BadQuery(word)
        if self.peek()[0] == "boost":
            out.boost = float(self.take()[1][1:])
        return out


def parse(text: str, fields: tuple[str, ...]) -> Group:
    """The query that a text says; BadQuery where it says none."""
    reader = _Reader(text, fields)
    found = reader.group(None)
    if reader.rest or not found.parts:
        raise BadQuery(text)
    return found


def leaves(node: Leaf | Group) -> list[Leaf]:
    return [node] if isinstance(node, Leaf) else [x for _, p in node.parts for x in leaves(p)]
