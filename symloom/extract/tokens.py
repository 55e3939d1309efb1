"""Tokens of brace languages, with places and matching brackets. Texts are bytes seen as latin-1: one character a byte."""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass

from .model import Place, Span

NAME = r"[A-Za-z_$\x80-\xff][\w$\x80-\xff]*"
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


@dataclass
class Token:
    kind: str  # name, var, string, number, op, regex
    text: str
    start: int
    end: int
    match: int = -1  # index of the other bracket


def plain(text: str) -> str:
    """A token's text as it is written."""
    return text.encode("latin-1").decode("utf-8", "replace")


class Source:
    def __init__(self, source: bytes):
        self.text = source.decode("latin-1")
        self.starts = [0, *(m.end() for m in re.finditer("\n", self.text))]
        self.lines = [plain(x).rstrip("\r") for x in self.text.split("\n")]
        self.tokens: list[Token] = []
        self.comments: list[tuple[int, int]] = []
        self.errors = 0

    def place(self, offset: int) -> Place:
        line = bisect.bisect_right(self.starts, offset) - 1
        return line, offset - self.starts[line]

    def span(self, start: int, end: int) -> Span:
        return self.place(start), self.place(end)

    def at(self, i: int) -> Span:
        return self.span(self.tokens[i].start, self.tokens[i].end)

    def pair(self) -> None:
        """Match brackets; what has no partner counts as an error and is matched to the end."""
        open_: list[int] = []
        for i, t in enumerate(self.tokens):
            if t.kind != "op":
                continue
            if t.text in _OPEN:
                open_.append(i)
            elif t.text in _CLOSE:
                while open_ and _OPEN[self.tokens[open_[-1]].text] != t.text:
                    self.tokens[open_.pop()].match = i
                    self.errors += 1
                if open_:
                    j = open_.pop()
                    self.tokens[j].match, t.match = i, j
                else:
                    self.errors += 1
        for j in open_:
            self.tokens[j].match = len(self.tokens) - 1
            self.errors += 1

    def doc_before(self, offset: int) -> str | None:
        """The /** comment that ends on the line above an offset, or on its own."""
        k = bisect.bisect_right(self.comments, (offset, 0)) - 1
        if k < 0:
            return None
        a, b = self.comments[k]
        if not self.text.startswith("/**", a) or self.place(b)[0] < self.place(offset)[0] - 1 or self.text[b:offset].strip(" \t\r\n") not in _MODIFIERS_ONLY:
            return None
        return plain(self.text[a:b])


class _Blank:
    def __contains__(self, text: str) -> bool:
        return not re.search(r"[;{}()=]", text)


_MODIFIERS_ONLY = _Blank()
_BEFORE_REGEX = {"(", ",", "=", ":", "[", "!", "&", "|", "?", "{", "}", ";", "=>", "&&", "||", "??", "+", "-", "*", "%", "<", ">", "~", "^", "return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "do", "else"}
_SCRIPT = re.compile(rf"(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)|(?P<tick>`)|(?P<name>#?{NAME})|(?P<number>\d[\w.]*)|(?P<op>=>|\?\.(?!\d)|\?\?|\.\.\.|&&|\|\||[=!]==?|[^\s])", re.S)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[A-Za-z]*")


def script_tokens(source: bytes) -> Source:
    """Tokens of TypeScript and JavaScript; the expressions in template strings are tokens as well."""
    s = Source(source)
    text, at, ticks = s.text, 0, []
    depth = 0

    def template(start: int) -> int:
        """The end of a template string, or of its part before an expression."""
        i = start
        while i < len(text):
            if text[i] == "\\":
                i += 2
                continue
            if text[i] == "`":
                return i + 1
            if text.startswith("${", i):
                ticks.append(depth)
                return i + 2
            i += 1
        s.errors += 1
        return len(text)

    while at < len(text):
        m = _SCRIPT.match(text, at)
        kind, body = m.lastgroup, m[0]
        end = m.end()
        if kind == "comment":
            s.comments.append((at, end))
        elif kind == "tick":
            end = template(end)
            s.tokens.append(Token("string", "`", at, end))
        elif kind == "op" and body == "/" and (not s.tokens or (s.tokens[-1].text in _BEFORE_REGEX and s.tokens[-1].kind in ("op", "name"))) and (r := _REGEX.match(text, at)):
            end = r.end()
            s.tokens.append(Token("regex", r[0], at, end))
        elif kind == "op" and body == "}" and ticks and ticks[-1] == depth:
            ticks.pop()
            end = template(end)
        elif kind != "space":
            depth += body == "{"
            depth -= body == "}"
            s.tokens.append(Token(kind, body, at, end))
        at = end
    s.pair()
    return s


_PHP = re.compile(
    rf"(?P<space>\s+)|(?P<close>\?>)|(?P<comment>//(?:(?!\?>)[^\n])*|\#(?!\[)(?:(?!\?>)[^\n])*|/\*.*?(?:\*/|\Z))|(?P<heredoc><<<[ \t]*(['\"]?)([A-Za-z_]\w*)\5\n)|(?P<string>\"(?:\\.|[^\"\\])*\"?|'(?:\\.|[^'\\])*'?)|(?P<var>\$+[A-Za-z_\x80-\xff][\w\x80-\xff]*)"
    r"|(?P<name>\\?[A-Za-z_\x80-\xff][\w\x80-\xff]*(?:\\[A-Za-z_\x80-\xff][\w\x80-\xff]*)*)|(?P<number>\d[\w.]*)|(?P<op>\?->|->|=>|::|\?\?|\.\.\.|&&|\|\||\#\[|[=!]==?|.)",
    re.S,
)


def php_tokens(source: bytes) -> Source:
    """Tokens of the PHP parts of a file."""
    s = Source(source)
    text, at = s.text, 0
    while True:
        opened = re.compile(r"<\?(?:php\b|=)?").search(text, at)
        if opened is None:
            break
        at = opened.end()
        while at < len(text):
            m = _PHP.match(text, at)
            kind, end = m.lastgroup, m.end()
            if kind == "close":
                at = end
                break
            if m["comment"] is not None:
                s.comments.append((at, end))
            elif m["heredoc"] is not None:
                stop = re.compile(rf"^[ \t]*{m[6]}\b", re.M).search(text, end)
                end = stop.end() if stop else len(text)
                s.tokens.append(Token("string", text[at:end], at, end))
            elif m["space"] is None:
                kind = next(k for k in ("string", "var", "name", "number", "op") if m[k] is not None)
                s.tokens.append(Token(kind, "[" if m[0] == "#[" else m[0], at, end))
                if m[0] == "#[":
                    s.tokens[-1].kind = "op"
            at = end
        else:
            break
    s.pair()
    return s
