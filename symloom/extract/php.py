"""PHP from tokens: declarations by their keywords, uses by their neighbours. Variables lose their sigil."""

from __future__ import annotations

import re

from ..functions.names import EXPRESSION
from .model import Binding, Definition, Finds, Import, Span, clean_doc, signature_of
from .tokens import Source, php_tokens, plain

_WORDS = frozenset("abstract and array as break callable case catch class clone const continue declare default do echo else elseif empty enddeclare endfor endforeach endif endswitch endwhile enum extends final finally fn for foreach function global goto if implements include include_once instanceof insteadof interface isset list match namespace new or print private protected public readonly require require_once return static switch throw trait try unset use var while xor yield true false null self parent".split())
_SCALARS = frozenset("int float string bool array callable iterable object mixed void never null false true self static parent".split())
_MODIFIERS = ("public", "protected", "private", "static", "abstract", "final", "readonly", "var")
_RELATIVE = ("self", "static", "parent")
_ARROWS = ("->", "?->")


def tail(name: str) -> str:
    return plain(name.rsplit("\\", 1)[-1])


class _Scanner:
    def __init__(self, source: Source):
        self.s, self.t = source, source.tokens
        self.finds = Finds(errors=source.errors)
        self.scopes: list[Span] = []
        self.classes: list[Span] = []

    def text(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) else ""

    def low(self, i: int) -> str:
        return self.text(i).lower()

    def kind(self, i: int) -> str:
        return self.t[i].kind if 0 <= i < len(self.t) else ""

    def close(self, i: int) -> int:
        m = self.t[i].match
        return m if m > i else len(self.t) - 1

    def is_name(self, i: int) -> bool:
        return self.kind(i) == "name" and self.low(i) not in _WORDS

    def whole(self, i: int, j: int) -> Span:
        return self.s.span(self.t[i].start, self.t[min(j, len(self.t) - 1)].end)

    def end_of(self, i: int) -> Span:
        """Where the last name of a qualified one stands; a variable without its sigil."""
        x = self.t[i]
        start = x.end - len(x.text.rsplit("\\", 1)[-1].lstrip("$"))
        return self.s.span(start, x.end)

    def use(self, i: int, kind: str, receiver: str | None = None) -> None:
        self.finds.use(tail(self.text(i)).lstrip("$"), kind, self.end_of(i), receiver)

    def define(self, at: Span, name: str, kind: str, first: int, last: int, head: int | None, attributes: list[str], hoisted: bool = False) -> str | None:
        line, stop, cut = at[0][0], at[0][0], None
        if head is not None:
            stop = max(line, self.s.place(self.t[head - 1].end)[0])
            row, column = self.s.place(self.t[head].start)
            if row == stop:
                cut = len(plain(self.s.text[self.s.starts[row] : self.s.starts[row] + column])) + 1
        doc = self.s.doc_before(self.t[first].start)
        found = clean_doc(doc, True) if doc else None
        self.finds.definitions.append(Definition(name, kind, at, self.whole(first, last), signature_of(self.s.lines, line, stop, cut, attributes), found, hoisted))
        return found

    def attributes(self, i: int) -> tuple[int, list[str]]:
        names = []
        while self.text(i) == "[" and self.s.text[self.t[i].start] == "#":
            end = self.close(i)
            j = i + 1
            while j < end:
                if self.kind(j) == "name":
                    names.append(f"#[{tail(self.text(j))}]")
                    if self.text(j + 1) == "(":
                        self.expressions(j + 2, self.close(j + 1))
                        j = self.close(j + 1)
                j += 1
            i = end + 1
        return i, names

    # declarations

    def statements(self, i: int, end: int) -> None:
        while i < end:
            i = max(i + 1, self.statement(i, end))

    def statement(self, i: int, end: int) -> int:
        first = i
        i, attributes = self.attributes(i)
        start = i
        while self.low(i) in ("abstract", "final", "readonly") and self.kind(i) == "name" and self.low(i + 1) in ("abstract", "final", "readonly", "class"):
            i += 1
        x = self.low(i) if self.kind(i) == "name" and self.text(i - 1) not in (*_ARROWS, "::") else ""
        if x == "namespace" and self.kind(i + 1) == "name":
            name = i + 1
            self.finds.namespace = plain(self.text(name)).strip("\\")
            last = self.close(name + 1) if self.text(name + 1) == "{" else name + 1
            self.define(self.s.at(name), self.finds.namespace, "module", i, last, None, [])
            return name + 1
        if x == "use" and not self.classes:
            return self.imports(i, end)
        if x in ("class", "interface", "trait") and self.is_name(i + 1) or x == "enum" and self.is_name(i + 1) and self.text(i + 2) in ("{", ":", "implements"):
            return self.type_(i, x, start if not attributes else first, attributes)
        if x == "function" and (self.is_name(i + 1) or self.text(i + 1) == "&" and self.is_name(i + 2)):
            name = i + 1 + (self.text(i + 1) == "&")
            return self.function(name, name + 1, "function", start if not attributes else first, attributes)
        if x == "const":
            return self.constants(i, i, attributes)
        return self.expression(i, end)

    def type_(self, i: int, word: str, first: int, attributes: list[str]) -> int:
        body = i + 1
        while body < len(self.t) and self.text(body) != "{":
            body += 1
        last = self.close(min(body, len(self.t) - 1))
        self.define(self.s.at(i + 1), plain(self.text(i + 1)), word, first, last, body, attributes)
        self.bases(i + 2, body)
        self.members(body, last)
        return last + 1

    def bases(self, i: int, body: int) -> None:
        clause = False
        for j in range(i, body):
            if self.low(j) in ("extends", "implements"):
                clause = True
            elif clause and self.is_name(j):
                self.use(j, "class")

    def members(self, body: int, last: int) -> None:
        self.classes.append(self.whole(body, last))
        held, self.scopes = self.scopes, []
        i = body + 1
        while i < last:
            first = i
            i, attributes = self.attributes(i)
            start = i
            while self.low(i) in _MODIFIERS:
                i += 1
            if i >= last:
                break
            x, at = self.low(i), start if not attributes else first
            if x == "function":
                name = i + 1 + (self.text(i + 1) == "&")
                i = self.function(name, name + 1, "method", at, attributes)
            elif x == "const":
                i = self.constants(i, at, attributes)
            elif x == "case":
                self.define(self.s.at(i + 1), plain(self.text(i + 1)), "constant", at, i + 1, None, attributes)
                i += 2
            elif x == "use":
                j = i + 1
                while j < last and self.text(j) not in (";", "{"):
                    if self.is_name(j):
                        self.use(j, "class")
                    j += 1
                i = (self.close(j) if self.text(j) == "{" else j) + 1
            elif i > start or self.kind(i) == "var":
                i = self.properties(i, at, last, attributes)
            else:
                i += 1
        self.scopes = held
        self.classes.pop()

    def constants(self, i: int, first: int, attributes: list[str]) -> int:
        j = i + 1
        while j < len(self.t) and self.text(j) != ";":
            if self.kind(j) == "name" and self.text(j + 1) == "=":
                stop = self.until(j + 2, (",", ";"))
                self.define(self.s.at(j), plain(self.text(j)), "constant", first, stop, None, attributes)
                self.expressions(j + 2, stop)
                j = stop
                if self.text(j) == ";":
                    break
            j += 1
        return j + 1

    def until(self, i: int, marks: tuple[str, ...]) -> int:
        while i < len(self.t) and self.text(i) not in marks and self.text(i) not in (")", "]", "}"):
            i = self.close(i) + 1 if self.text(i) in ("(", "[", "{") else i + 1
        return min(i, len(self.t) - 1)

    def types(self, i: int) -> tuple[int, str | None]:
        """After a type, and its name if it is a plain class."""
        names = []
        while self.kind(i) == "name" or self.text(i) in ("?", "|", "&", "(", ")") and not (self.text(i) == "&" and self.kind(i + 1) == "var"):
            if self.kind(i) == "name":
                names.append(i)
                if self.low(i) not in _SCALARS or self.low(i) in ("self", "static"):
                    self.use(i, "type")
            if self.text(i) == ")" and self.t[i].match < 0:
                break
            i += 1
            if self.text(i) in ("{", ";", ",", "="):
                break
        one = len(names) == 1 and self.low(names[0]) not in _SCALARS
        return i, tail(self.text(names[0])) if one else None

    def properties(self, i: int, first: int, last: int, attributes: list[str]) -> int:
        i, kind = self.types(i)
        while i < last and self.kind(i) == "var":
            name, stop = i, i
            if self.text(i + 1) == "=":
                stop = self.until(i + 2, (",", ";"))
                self.expressions(i + 2, stop)
                i = stop - 1
            word = tail(self.text(name)).lstrip("$")
            doc = self.define(self.end_of(name), word, "field", first, max(name, stop), None, attributes)
            declared = re.search(r"@var\s+\\?([\w\\|]+)", doc or "")
            told = next((p.rsplit("\\", 1)[-1] for p in declared[1].split("|") if p.lower() not in _SCALARS), None) if declared else None
            if kind or told:
                self.finds.types.append((f"this.{word}", kind or told, self.classes[-1]))
            i += 1
            if self.text(i) == "{":  # hooks
                self.expressions(i + 1, self.close(i))
                return self.close(i) + 1
            if self.text(i) != ",":
                break
            i += 1
        return max(i, first + 1)

    def function(self, name: int | None, i: int, kind: str, first: int, attributes: list[str]) -> int:
        if self.text(i) != "(":
            return i
        close = self.close(i)
        j = close + 1
        if self.low(j) == "use" and self.text(j + 1) == "(":
            j = self.close(j + 1) + 1
        result = None
        if self.text(j) == ":":
            result = j + 1
            while j < len(self.t) and self.text(j) not in ("{", ";", "=>"):
                j += 1
        last = self.close(j) if self.text(j) == "{" else self.until(j + 1, (",", ";")) - 1 if self.text(j) == "=>" else j
        scope = self.whole(first, last)
        self.scopes.append(scope)
        if name is not None:
            self.define(self.s.at(name), plain(self.text(name)), kind, first, last, j if self.text(j) == "{" else None, attributes)
        self.parameters(i + 1, close, scope)
        if result is not None:
            self.types(result)
        if self.text(j) == "{":
            self.statements(j + 1, last)
        elif self.text(j) == "=>":
            self.expressions(j + 1, last + 1)
        self.scopes.pop()
        return last + 1

    def parameters(self, i: int, end: int, scope: Span) -> None:
        while i < end:
            first = i
            i, attributes = self.attributes(i)
            start, promoted = i, False
            while self.low(i) in _MODIFIERS:
                promoted, i = True, i + 1
            i, kind = self.types(i)
            while self.text(i) in ("&", "..."):
                i += 1
            if self.kind(i) != "var":
                i += 1
                continue
            word = tail(self.text(i)).lstrip("$")
            self.finds.locals.append((word, scope))
            if kind:
                self.finds.types.append((word, kind, scope))
            if promoted:
                self.define(self.end_of(i), word, "field", start if not attributes else first, i, None, attributes, hoisted=True)
                if kind:
                    self.finds.types.append((f"this.{word}", kind, self.classes[-1] if self.classes else None))
            i += 1
            if self.text(i) == "=":
                stop = self.until(i + 1, (",",))
                self.expressions(i + 1, min(stop, end))
                i = stop
            i += 1

    def imports(self, i: int, end: int) -> int:
        j = i + 1
        j += self.low(j) in ("function", "const") and self.kind(j) == "name"
        prefix = ""
        while j < end and self.text(j) != ";":
            if self.kind(j) == "name" and self.low(j) not in ("as", "function", "const"):
                name = j
                if self.text(j + 1) == "\\" and self.text(j + 2) == "{" or self.text(j + 1) == "{":
                    prefix = plain(self.text(j)).strip("\\") + "\\"
                    j += 2
                    continue
                local = name
                if self.low(j + 1) == "as":
                    local = j + 2
                module = prefix + plain(self.text(name)).strip("\\")
                self.use(name, "import")
                self.finds.imports.append(Import(module, 0, self.whole(name, local), [Binding(tail(self.text(local)), tail(self.text(name)), self.whole(name, local))]))
                j = local
            j += 1
        return j + 1

    # expressions

    def expressions(self, i: int, end: int) -> None:
        while i < end:
            i = max(i + 1, self.expression(i, end))

    def scope(self) -> Span | None:
        return self.scopes[-1] if self.scopes else None

    def expression(self, i: int, end: int) -> int:
        x, prev, nxt = self.text(i), self.text(i - 1), self.text(i + 1)
        if self.kind(i) == "var":
            return self.variable(i)
        if x == "[" and self.kind(i) == "op":
            self.callable_array(i)
            return i + 1
        if self.kind(i) != "name":
            return i + 1
        low = self.low(i)
        if prev in _ARROWS:
            self.member(i, nxt == "(", self.object(i - 2))
            return i + 1
        if prev == "::":
            scope = tail(self.text(i - 2)) if self.kind(i - 2) == "name" else EXPRESSION if self.text(i - 2) in (")", "]") else None
            if low != "class":
                self.member(i, nxt == "(", scope)
            else:
                self.use(i, "member")
            return i + 1
        if low == "function" and nxt == "(" or low == "function" and nxt == "&":
            return self.function(None, i + 1 + (nxt == "&"), "function", i, [])
        if low == "fn":
            return self.function(None, i + 1 + (nxt == "&"), "function", i, [])
        if low == "new":
            return self.created(i)
        if nxt == "::":
            self.use(i, "scope" if low in _RELATIVE else "type")
            return i + 2 if self.kind(i + 2) != "var" else self.static_property(i)
        if low == "instanceof" and self.kind(i + 1) == "name":
            if self.low(i + 1) not in _RELATIVE:
                self.use(i + 1, "type")
            return i + 2
        if low == "catch" and nxt == "(":
            j, _ = self.types(i + 2)
            return j
        if low in _WORDS:
            return i + 1
        if nxt == "(":
            self.use(i, "call")
            if low in ("view", "route") and self.kind(i + 2) == "string":
                a, b = self.t[i + 2].start, self.t[i + 2].end
                self.finds.use(plain(self.s.text[a + 1 : b - 1]), low, self.s.span(a, b))
            return i + 1
        if prev in ("(", ",") and nxt in (")", ","):
            self.use(i, "value")
        return i + 1

    def static_property(self, i: int) -> int:
        self.use(i + 2, "member", tail(self.text(i)))
        return i + 3

    def member(self, i: int, called: bool, receiver: str | None) -> None:
        self.use(i, "call" if called else "member", receiver if receiver or not called else EXPRESSION)

    def object(self, i: int) -> str | None:
        """The receiver before an arrow: a variable, or a property of this."""
        if self.kind(i) == "var":
            return tail(self.text(i)).lstrip("$")
        if self.kind(i) == "name" and self.text(i - 1) in _ARROWS and self.text(i - 2) == "$this":
            return f"this.{plain(self.text(i))}"
        return None

    def variable(self, i: int) -> int:
        word, j = tail(self.text(i)).lstrip("$"), i + 2
        if self.text(i + 1) == "=" and self.text(i) != "$this":
            stop = self.until(j, (";", ","))
            at = self.whole(i, max(i, stop - 1))
            if self.low(j) == "new" and self.is_name(j + 1):
                self.finds.types.append((word, tail(self.text(j + 1)), self.scope()))
            elif self.is_name(j) and self.text(j + 1) == "(":
                self.finds.from_calls.append((word, tail(self.text(j)), "", self.scope(), at))
            elif self.kind(j) == "var" and self.text(j + 1) in _ARROWS and self.text(j + 3) == "(":
                self.finds.from_calls.append((word, plain(self.text(j + 2)), tail(self.text(j)).lstrip("$"), self.scope(), at))
            elif self.kind(j) == "name" and self.text(j + 1) == "::" and self.text(j + 3) == "(":
                self.finds.from_calls.append((word, plain(self.text(j + 2)), tail(self.text(j)), self.scope(), at))
        if self.text(i) == "$this" and self.text(i + 1) == "->" and self.text(i + 3) == "=" and self.kind(i + 4) == "var" and self.text(i + 5) == ";":
            self.finds.from_names.append((plain(self.text(i + 2)), tail(self.text(i + 4)).lstrip("$"), self.classes[-1] if self.classes else None, self.whole(i, i + 4)))
        return i + 1

    def created(self, i: int) -> int:
        if self.low(i + 1) == "class":
            j = i + 2
            if self.text(j) == "(":
                self.expressions(j + 1, self.close(j))
                j = self.close(j) + 1
            body = j
            while body < len(self.t) and self.text(body) != "{":
                body += 1
            last = self.close(min(body, len(self.t) - 1))
            self.define(self.s.at(i + 1), "class@anonymous", "class", i + 1, last, body, [])
            self.bases(j, body)
            self.members(body, last)
            return last + 1
        if self.kind(i + 1) == "name":
            if self.low(i + 1) in ("self", "static"):
                self.use(i + 1, "type")
            elif self.low(i + 1) != "parent":
                self.use(i + 1, "construct")
            return i + 2
        return i + 1

    def callable_array(self, i: int) -> None:
        """[Type::class, 'method'] calls the method."""
        if self.kind(i + 1) == "name" and self.text(i + 2) == "::" and self.low(i + 3) == "class" and self.text(i + 4) == "," and self.kind(i + 5) == "string" and self.text(i + 6) == "]":
            a, b = self.t[i + 5].start + 1, self.t[i + 5].end - 1
            self.finds.use(plain(self.s.text[a:b]), "call", self.s.span(a, b), tail(self.text(i + 1)))


def find(path: str, source: bytes) -> Finds:
    s = php_tokens(source)
    scanner = _Scanner(s)
    scanner.statements(0, len(s.tokens))
    return scanner.finds
