"""The query-string language: a recursive-descent parser to query trees.

    query   := branch+                      side by side: any of them
    branch  := chain (OR chain)*            OR, ||
    chain   := signed (AND signed)*         AND, &&; binds tighter than OR
    signed  := [+ | - | ! | NOT] clause
    clause  := [field (: | > | >= | < | <=)] value [^boost]
    value   := ( query ) | "phrase"[~n] | /regexp/ | [a TO b] | {a TO b} | word[~n]

A backslash takes any character as it is; * and ? in a word are wildcards.
"""

from __future__ import annotations

import re

from docsail.errors import bad_request
from docsail.plans.nodes import MUST, MUST_NOT, SHOULD, Boolean, Boost, Everything, Fuzzy, Node, Pattern, Range, Term

MAX_CLAUSES = 1024
_STOP = set(' \t\r\n()[]{}"^~:/<>=\u3000')
_META = re.compile(r"([\\.\[\]{}()+*?^$|])")


class Parser:
    def __init__(self, text: str):
        self.text, self.at, self.clauses = text, 0, 0

    def fail(self) -> None:
        raise bad_request(f"Invalid query string at character {self.at}: {self.text[:200]}")

    def space(self) -> None:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1

    def eat(self, *words: str) -> str | None:
        self.space()
        for w in words:
            if self.text.startswith(w, self.at) and not (w.isalpha() and self.text[self.at + len(w) : self.at + len(w) + 1].strip(" \t\r\n()\"+-")):
                self.at += len(w)
                return w
        return None

    def done(self) -> bool:
        self.space()
        return self.at >= len(self.text)

    def parse(self) -> Node:
        node = self.query()
        if not self.done():
            self.fail()
        return node

    def query(self) -> Node:
        parts: list[tuple[str, Node]] = []
        while not self.done() and self.text[self.at] != ")":
            parts.append(self.branch())
        if not parts:
            self.fail()
        return self._joined(parts)

    def branch(self) -> tuple[str, Node]:
        parts = [self.chain()]
        while self.eat("OR", "||"):
            parts.append(self.chain())
        return parts[0] if len(parts) == 1 else (SHOULD, Boolean(tuple(parts)))

    def chain(self) -> tuple[str, Node]:
        parts = [self.signed()]
        while self.eat("AND", "&&"):
            parts.append(self.signed())
        if len(parts) == 1:
            return parts[0]
        return SHOULD, Boolean(tuple((MUST if occur == SHOULD else occur, node) for occur, node in parts))

    def signed(self) -> tuple[str, Node]:
        if self.eat("+"):
            return MUST, self.clause(None)
        if self.eat("-", "!", "NOT"):
            return MUST_NOT, self.clause(None)
        return SHOULD, self.clause(None)

    def _joined(self, parts: list[tuple[str, Node]]) -> Node:
        return parts[0][1] if len(parts) == 1 and parts[0][0] != MUST_NOT else Boolean(tuple(parts))

    def clause(self, field: str | None) -> Node:
        self.clauses += 1
        if self.clauses > MAX_CLAUSES:
            raise bad_request(f"more than {MAX_CLAUSES} clauses")
        self.space()
        if self.text.startswith("*:*", self.at):
            self.at += 3
            return self._boosted(Everything())
        if field is None:
            start = self.at
            name, _, wild = self.word()
            if name and not wild:
                sign = self.eat(":", ">=", "<=", ">", "<", "=")
                if sign in (":", "="):
                    return self.clause(name)
                if sign:
                    bound = self.literal()
                    low, high = (bound, None) if sign[0] == ">" else (None, bound)
                    return self._boosted(Range(name, low, high, sign == ">=", sign == "<="))
            self.at = start
        else:
            sign = self.eat(">=", "<=", ">", "<")
            if sign:
                bound = self.literal()
                low, high = (bound, None) if sign[0] == ">" else (None, bound)
                return self._boosted(Range(field, low, high, sign == ">=", sign == "<="))
        return self._boosted(self.value(field))

    def _boosted(self, node: Node) -> Node:
        if self.text.startswith("^", self.at):
            self.at += 1
            return Boost(node, self.number())
        return node

    def number(self) -> float:
        found = re.compile(r"\d+(\.\d+)?").match(self.text, self.at)
        if not found:
            self.fail()
        self.at = found.end()
        return float(found[0])

    def value(self, field: str | None) -> Node:
        self.space()
        c = self.text[self.at : self.at + 1]
        if c == "(":
            self.at += 1
            node = self.query()
            if not self.eat(")"):
                self.fail()
            return with_field(node, field)
        if c == '"':
            text = self.quoted('"')
            if self.text.startswith("~", self.at):
                self.at += 1
                self.number()
            return Term(field, text)
        if c == "/":
            expression = self.quoted("/", keep=True)
            if re.search(r"(?<!\\)[@#&<>~]", expression):
                raise bad_request("regular expressions can't use @ # & < > ~")
            return Pattern(field, expression)
        if c and c in "[{":
            self.at += 1
            low = self.bound()
            if not self.eat("TO"):
                self.fail()
            high = self.bound()
            end = self.eat("]", "}")
            if not end:
                self.fail()
            return Range(field, low, high, c == "[", end == "]")
        start = self.at
        text, expression, wild = self.word()
        if not text or self.text[start : self.at] in ("AND", "OR", "NOT"):
            self.fail()
        if self.text.startswith("~", self.at):
            self.at += 1
            found = re.compile(r"\d+(\.\d+)?").match(self.text, self.at)
            edits = 2.0
            if found:
                self.at, edits = found.end(), float(found[0])
            if 0 < edits < 1:
                edits = min(2, int((1 - edits) * len(text)))
            return Fuzzy(field, text, min(2, int(edits)))
        if wild:
            if text == "*":
                return Pattern(field, ".*", "", "*")
            head = text[:-1]
            only_tail = wild == 1 and text.endswith("*") and expression.endswith(".*")
            return Pattern(field, expression, head if only_tail else None, text)
        return Term(field, text)

    def word(self) -> tuple[str, str, int]:
        """(text, regular expression, wildcards) of the characters up to a space or a sign."""
        text, expression, wild = [], [], 0
        while self.at < len(self.text):
            c = self.text[self.at]
            if c == "\\":
                if self.at + 1 >= len(self.text):
                    self.fail()
                c = self.text[self.at + 1]
                text.append(c)
                expression.append(_META.sub(r"\\\1", c))
                self.at += 2
                continue
            if c in _STOP:
                break
            text.append(c)
            wild += c in "*?"
            expression.append({"*": ".*", "?": "."}.get(c) or _META.sub(r"\\\1", c))
            self.at += 1
        return "".join(text), "".join(expression), wild

    def quoted(self, mark: str, keep: bool = False) -> str:
        self.at += 1
        out = []
        while self.at < len(self.text) and self.text[self.at] != mark:
            if self.text[self.at] == "\\" and self.at + 1 < len(self.text):
                if keep and self.text[self.at + 1] != mark:
                    out.append("\\")
                self.at += 1
            out.append(self.text[self.at])
            self.at += 1
        if self.at >= len(self.text):
            self.fail()
        self.at += 1
        return "".join(out)

    def literal(self) -> str:
        self.space()
        if self.text.startswith('"', self.at):
            return self.quoted('"')
        found = re.compile(r"[^\s()\[\]{}^]+").match(self.text, self.at)
        if not found:
            self.fail()
        self.at = found.end()
        return re.sub(r"\\(.)", r"\1", found[0])

    def bound(self) -> str | None:
        text = self.literal()
        return None if text == "*" else text


def with_field(node: Node, field: str | None) -> Node:
    """The tree with a field for every leaf that names none."""
    if field is None:
        return node
    if isinstance(node, Boolean):
        return Boolean(tuple((o, with_field(n, field)) for o, n in node.clauses))
    if isinstance(node, Boost):
        return Boost(with_field(node.node, field), node.factor)
    if isinstance(node, (Term, Pattern, Fuzzy, Range)) and node.field is None:
        return type(node)(field, *[getattr(node, k) for k in list(node.__dataclass_fields__)[1:]])
    return node


def parse(text: str) -> Node:
    if not text or not text.strip():
        raise bad_request("query must not be empty")
    return Parser(text).parse()
