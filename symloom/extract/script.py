"""TypeScript and JavaScript from tokens: declarations by their keywords, uses by their neighbours."""

from __future__ import annotations

from ..functions.names import EXPRESSION
from .model import Binding, Definition, Finds, Import, Span, clean_doc, signature_of
from .tokens import Source, Token, plain, script_tokens

_WORDS = frozenset(
    "abstract any as async await boolean break case catch class const continue debugger declare default delete do else enum export extends finally for from function get if implements import in infer instanceof interface is keyof let module namespace never new null number object of override package private protected public readonly require return satisfies set static string super switch symbol this throw true false try type typeof undefined unknown unique var void while with yield".split()
)
#: Words that are names where they stand as one: `type`, `of`, `get` and the like.
_SOFT = frozenset("abstract any as async boolean declare from get infer is module namespace never number object of override package readonly require satisfies set string symbol type undefined unknown unique".split())
_MODIFIERS = frozenset("public private protected static readonly abstract override declare async get set accessor".split())
_VISIBLE = frozenset("public private protected readonly".split())


class _Scanner:
    def __init__(self, source: Source, typed: bool):
        self.s, self.t, self.typed = source, source.tokens, typed
        self.finds = Finds(errors=source.errors)
        self.scopes: list[Span] = []
        self.classes: list[Span] = []

    # tokens

    def text(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind == "name" and (self.t[i].text not in _WORDS or self.t[i].text in _SOFT)

    def close(self, i: int) -> int:
        """Index of the partner of a bracket."""
        m = self.t[i].match
        return m if m > i else len(self.t) - 1

    def angle(self, i: int) -> int:
        """After the type parameters that begin at i, or i itself."""
        if self.text(i) != "<":
            return i
        depth, j = 0, i
        while j < len(self.t):
            x = self.t[j].text
            depth += (x == "<") - (x == ">")
            if x in "([{":
                j = self.close(j)
            if depth == 0:
                return j + 1
            if x == ";":
                return i
            j += 1
        return i

    def whole(self, i: int, j: int) -> Span:
        return self.s.span(self.t[i].start, self.t[min(j, len(self.t) - 1)].end)

    def scope(self) -> Span | None:
        return self.scopes[-1] if self.scopes else None

    def define(self, name: int, kind: str, first: int, last: int, head: int | None = None, decorators: list[int] = (), hoisted: bool = False) -> None:
        """head: the token with which the body begins."""
        line = self.s.at(name)[0][0]
        stop, cut = line, None
        if head is not None:
            before = self.s.place(self.t[head - 1].end)[0]
            stop = max(line, before)
            (row, column) = self.s.place(self.t[head].start)
            if row == stop:
                cut = len(plain(self.s.text[self.s.starts[row] : self.s.starts[row] + column])) + 1
        start = min([first, *decorators])
        names = ["@" + plain(self.text(d + 1)) for d in decorators]
        doc = self.s.doc_before(self.t[start].start)
        sig = signature_of(self.s.lines, line, stop, cut, names)
        self.finds.definitions.append(Definition(plain(self.text(name)), kind, self.s.at(name), self.whole(start, last), sig, clean_doc(doc, True) if doc else None, hoisted))

    # statements

    def program(self, i: int, end: int, top: bool) -> None:
        """Statements from token i up to end; top: declarations are the file's."""
        while i < end:
            i = max(i + 1, self.statement(i, end, top))

    def statement(self, i: int, end: int, top: bool) -> int:
        decorators = []
        while self.text(i) == "@" and i < end:
            decorators.append(i)
            j = i + 2
            while self.text(j) == ".":
                j += 2
            self.finds.use(plain(self.text(j - 1)), "call", self.s.at(j - 1))
            if self.text(j) == "(":
                self.expression(j + 1, self.close(j))
                j = self.close(j) + 1
            i = j
        x, nxt = self.text(i), self.text(i + 1)
        if x == "import" and nxt not in ("(", "."):
            return self.imports(i, end)
        if x == "export":
            j = i + 1
            while self.text(j) in ("default", "declare"):
                j += 1
            if self.text(j) in ("{", "*") and self.text(j - 1) != "default":
                return self.reexport(j, end)
            if self.text(j) in ("class", "abstract", "interface", "type", "enum", "function", "async", "const", "let", "var", "@", "declare"):
                return self.declaration(j, end, top, decorators, i)
            return j
        return self.declaration(i, end, top, decorators, i)

    def declaration(self, i: int, end: int, top: bool, decorators: list[int], first: int) -> int:
        x, nxt = self.text(i), self.text(i + 1)
        if x == "@":
            return self.statement(i, end, top)
        if x == "declare" and self.t[i].kind == "name":
            return self.declaration(i + 1, end, top, decorators, first)
        if x == "abstract" and nxt == "class":
            return self.class_(i + 1, i, decorators)
        if x == "class" and self.text(i - 1) != ".":
            return self.class_(i, i, decorators)
        if self.typed and x == "interface" and self.is_name(i + 1):
            return self.interface(i)
        if self.typed and x == "enum" and self.is_name(i + 1) or self.typed and x == "const" and nxt == "enum":
            i += x == "const"
            j = self.find(i, "{", end)
            self.define(i + 1, "enum", i, self.close(j), j)
            self.expression(j + 1, self.close(j))
            return self.close(j) + 1
        if self.typed and x == "type" and self.is_name(i + 1) and self.text(self.angle(i + 2)) == "=":
            j = self.type_end(self.angle(i + 2) + 1, end)
            self.define(i + 1, "type_alias", i, j - 1)
            self.types(self.angle(i + 2) + 1, j)
            return j
        if x == "async" and nxt == "function":
            return self.function(i + 1, i, top)
        if x == "function":
            return self.function(i, i, top)
        if x in ("const", "let", "var") and self.text(i - 1) != ".":
            return self.variables(i + 1, end, top)
        if x == "{":
            self.program(i + 1, self.close(i), False)
            return self.close(i) + 1
        return self.expression(i, end, once=True)

    def find(self, i: int, what: str, end: int) -> int:
        """The next such token outside of brackets."""
        while i < end and self.text(i) != what:
            i = self.close(i) + 1 if self.text(i) in ("(", "[", "{") else i + 1
        return min(i, len(self.t) - 1)

    def class_(self, i: int, first: int, decorators: list[int] = (), named: bool = True) -> int:
        j = i + 1
        name = j if self.is_name(j) and self.text(j) not in ("extends", "implements") else None
        if name is not None:
            j = self.angle(name + 1)
        body = self.find(j, "{", len(self.t))
        clause = None
        while j < body:
            if self.text(j) in ("extends", "implements"):
                clause = self.text(j)
            elif self.is_name(j) and clause and self.text(j - 1) in (clause, ","):
                if self.text(j + 1) == ".":
                    j = self.expression(j, body, once=True)
                    continue
                self.finds.use(plain(self.text(j)), "class", self.s.at(j))
                after = self.angle(j + 1)
                if after > j + 1:
                    self.types(j + 2, after - 1)
                if self.text(after) == "(":
                    self.expression(after + 1, self.close(after))
                    after = self.close(after) + 1
                j = after
                continue
            j += 1
        last = self.close(body)
        if name is not None:
            self.define(name, "class", first, last, body, decorators)
        self.classes.append(self.whole(first, last))
        self.members(body + 1, last)
        self.classes.pop()
        return last + 1

    def members(self, i: int, end: int) -> None:
        while i < end:
            decorators, start = [], i
            while self.text(i) == "@" and i < end:
                decorators.append(i)
                i = self.statement_decorator(i)
            start = i
            while self.text(i) in _MODIFIERS and self.text(i + 1) not in ("(", "=", ":", ";", "?", "<", "}"):
                i += 1
            if self.text(i) == "*":
                i += 1
            if i >= end:
                return
            if self.text(i) in (";", ","):
                i += 1
                continue
            if self.text(i) == "{":  # a static block
                self.body(i, i)
                i = self.close(i) + 1
                continue
            if self.text(i) == "[":
                name, j = None, self.close(i) + 1
            else:
                name, j = i, i + 1
            if self.text(j) in ("?", "!"):
                j += 1
            j = self.angle(j)
            if self.text(j) == "(":
                last = self.callable(j, end)
                body = last if self.text(last) == "}" else None
                if name is not None and self.t[name].kind == "name":
                    self.define(name, "method", start, last, self.t[last].match if body is not None else None, decorators)
                i = last + 1
                continue
            i = self.field(name, start, j, end, decorators)

    def statement_decorator(self, i: int) -> int:
        j = i + 2
        while self.text(j) == ".":
            j += 2
        self.finds.use(plain(self.text(j - 1)), "call", self.s.at(j - 1))
        if self.text(j) == "(":
            self.expression(j + 1, self.close(j))
            j = self.close(j) + 1
        return j

    def field(self, name: int | None, start: int, j: int, end: int, decorators: list[int]) -> int:
        kind = None
        if self.text(j) == ":":
            after = self.type_end(j + 1, end)
            kind = self.types(j + 1, after)
            j = after
        stop = j
        if self.text(j) == "=":
            stop = self.value_end(j + 1, end)
            self.expression(j + 1, stop)
        if name is not None and self.t[name].kind == "name":
            self.define(name, "field", start, max(stop - 1, name), None, decorators)
            if kind:
                self.finds.types.append((f"this.{plain(self.text(name))}", kind, self.classes[-1] if self.classes else None))
        return max(stop, (name if name is not None else j) + 1)

    def value_end(self, i: int, end: int) -> int:
        """Where a value without a closing mark ends: at ; or , or before a line that cannot go on."""
        line = self.s.place(self.t[i].start)[0] if i < end else 0
        while i < end:
            x = self.t[i]
            if x.text in (";", ",") or x.text in (")", "]", "}"):
                return i
            here = self.s.place(x.start)[0]
            if here > line and x.kind == "name" and self.t[i - 1].kind in ("name", "string", "number", "regex") and self.text(i - 1) not in _WORDS - _SOFT or here > line and self.text(i - 1) in (")", "]", "}") and (x.kind == "name" or x.text in ("@", "[", "#")) and x.text not in ("as", "in", "instanceof", "of", "satisfies"):
                return i
            if x.text in ("(", "[", "{"):
                i = self.close(i)
            line = self.s.place(self.t[i].end)[0]
            i += 1
        return end

    def interface(self, i: int) -> int:
        body = self.find(i + 1, "{", len(self.t))
        clause = self.find(i + 1, "extends", body)
        if clause < body:
            j = clause + 1
            while j < body:
                if self.is_name(j) and self.text(j - 1) in ("extends", ","):
                    self.finds.use(plain(self.text(j)), "class", self.s.at(j))
                    after = self.angle(j + 1)
                    self.types(j + 2, after - 1)
                    j = after
                    continue
                j += 1
        last = self.close(body)
        self.define(i + 1, "interface", i, last, body)
        j = body + 1
        while j < last:
            start = j
            while self.text(j) in ("readonly", "get", "set") and self.t[j + 1].kind == "name":
                j += 1
            name = j if self.t[j].kind == "name" else None
            k = self.close(j) + 1 if self.text(j) in ("[", "(") else j + 1
            k += self.text(k) == "?"
            k = self.angle(k)
            method = self.text(k) == "("
            if method:
                self.parameters(k, None)
                k = self.close(k) + 1
            if self.text(k) == ":":
                stop = self.type_end(k + 1, last)
                self.types(k + 1, stop)
                k = stop
            if name is not None:
                self.define(name, "method" if method else "field", start, max(k - 1, name))
            j = max(k, j + 1)
            while self.text(j) in (";", ",") and j < last:
                j += 1
        return last + 1

    def function(self, i: int, first: int, top: bool, value: bool = False) -> int:
        j = i + 1
        j += self.text(j) == "*"
        name = j if self.is_name(j) else None
        if name is not None:
            j = self.angle(name + 1)
        if self.text(j) != "(":
            return j
        last = self.callable(j, len(self.t), first)
        if name is not None and not value:
            if top:
                self.define(name, "function", first, last, self.t[last].match if self.text(last) == "}" else None)
            elif self.scope():
                self.finds.locals.append((plain(self.text(name)), self.scope()))
        return last + 1

    def callable(self, i: int, end: int, first: int | None = None) -> int:
        """Parameters at i, a return type, a body; the index of the last token."""
        close = self.close(i)
        j, kind = close + 1, None
        if self.text(j) == ":":
            kind = (j + 1, self.type_end(j + 1, end, body=True))
            j = kind[1]
        has_body = self.text(j) == "{"
        last = self.close(j) if has_body else j - 1
        self.scopes.append(self.whole(first if first is not None else i, last))
        self.parameters(i, self.scopes[-1])
        if kind:
            self.types(*kind)
        if has_body:
            self.program(j + 1, last, False)
        self.scopes.pop()
        return max(last, close)

    def body(self, i: int, first: int) -> None:
        self.scopes.append(self.whole(first, self.close(i)))
        self.program(i + 1, self.close(i), False)
        self.scopes.pop()

    def parameters(self, i: int, scope: Span | None) -> None:
        end, j = self.close(i), i + 1
        while j < end:
            promoted = False
            while self.text(j) == "@":
                j = self.statement_decorator(j)
            while self.text(j) in _MODIFIERS and self.is_or_name(j + 1):
                promoted |= self.text(j) in _VISIBLE
                j += 1
            j += self.text(j) == "..."
            name = j if self.is_name(j) else None
            if self.text(j) in ("{", "["):
                self.pattern(j, scope)
                j = self.close(j)
            j += 1
            j += self.text(j) == "?"
            if self.text(j) == ":":
                stop = self.type_end(j + 1, end)
                kind = self.types(j + 1, stop)
                if name is not None and kind and scope:
                    self.finds.types.append((plain(self.text(name)), kind, scope))
                    if promoted:
                        self.finds.types.append((f"this.{plain(self.text(name))}", kind, self.classes[-1] if self.classes else None))
                j = stop
            if name is not None and scope:
                self.finds.locals.append((plain(self.text(name)), scope))
            if self.text(j) == "=":
                stop = self.comma(j + 1, end)
                self.expression(j + 1, stop)
                j = stop
            j = self.comma(j, end) + 1

    def is_or_name(self, i: int) -> bool:
        return self.is_name(i) or self.text(i) in ("{", "[", *_MODIFIERS)

    def comma(self, i: int, end: int) -> int:
        while i < end and self.text(i) != ",":
            i = self.close(i) + 1 if self.text(i) in ("(", "[", "{") else i + 1
        return min(i, end)

    def pattern(self, i: int, scope: Span | None) -> None:
        """Names that a destructuring binds, and the values of its defaults."""
        j, end = i + 1, self.close(i)
        while j < end:
            if self.text(j) in ("{", "["):
                self.pattern(j, scope)
                j = self.close(j) + 1
            elif self.text(j) == "=":
                stop = self.comma(j + 1, end)
                self.expression(j + 1, stop)
                j = stop
            elif self.is_name(j) and self.text(j + 1) != ":":
                if scope:
                    self.finds.locals.append((plain(self.text(j)), scope))
                j += 1
            else:
                j += 1

    def variables(self, i: int, end: int, top: bool) -> int:
        while i < end:
            if self.text(i) in ("{", "["):
                self.pattern(i, self.scope())
                i = self.close(i) + 1
                name = None
            elif self.is_name(i):
                name = i
                i += 1
            else:
                return i
            i += self.text(i) == "!"
            kind = None
            if self.text(i) == ":":
                stop = self.type_end(i + 1, end)
                kind = self.types(i + 1, stop)
                i = stop
            if self.text(i) in ("of", "in"):
                if name is not None and self.scope():
                    self.finds.locals.append((plain(self.text(name)), self.scope()))
                return i + 1
            start = i + 1
            if self.text(i) == "=":
                i = self.value_end(start, end)
            if name is not None:
                self.variable(name, start, i, top, kind)
            if i > start:
                self.expression(start, i)
            if self.text(i) != ",":
                return i + (self.text(i) == ";")
            i += 1
        return i

    def variable(self, name: int, start: int, stop: int, top: bool, kind: str | None) -> None:
        word, scope = plain(self.text(name)), self.scope()
        if scope:
            self.finds.locals.append((word, scope))
        if kind:
            self.finds.types.append((word, kind, scope))
        head = None
        if stop > start:
            j = start + (self.text(start) == "async")
            arrow = self.find_arrow(j, stop)
            if self.text(j) == "function" or arrow is not None:
                after = self.find(j + 1, "{", stop) if arrow is None else arrow + 1
                head = after if self.text(after) == "{" and after < stop else arrow
            k = start + (self.text(start) == "await")
            if self.text(k) == "new" and self.is_name(k + 1):
                self.finds.types.append((word, plain(self.text(k + 1)), scope))
            elif self.is_name(k) and self.text(k + 1) == "(":
                self.finds.from_calls.append((word, plain(self.text(k)), "", scope, self.whole(name, stop - 1)))
            elif (self.is_name(k) or self.text(k) == "this") and self.text(k + 1) in (".", "?.") and self.text(k + 3) == "(":
                self.finds.from_calls.append((word, plain(self.text(k + 2)), plain(self.text(k)), scope, self.whole(name, stop - 1)))
            if top and head is not None:
                self.define(name, "function", name, stop - 1, head)
                return
        if top and not scope:
            self.define(name, "constant", name, max(stop - 1, name) if stop > start else name)

    def find_arrow(self, i: int, stop: int) -> int | None:
        """The arrow of an arrow function that begins at i."""
        j = self.angle(i)
        if self.text(j) == "(":
            j = self.close(j) + 1
            if self.text(j) == ":":
                j = self.type_end(j + 1, stop, body=True)
        elif self.is_name(j):
            j += 1
        else:
            return None
        return j if self.text(j) == "=>" and j < stop else None

    # types

    def type_end(self, i: int, end: int, body: bool = False) -> int:
        """Where a type that begins at i ends. body: a brace may begin a body."""
        j, wants = i, True
        while j < end:
            x = self.text(j)
            if x in ("(", "["):
                j = self.close(j) + 1
                wants = False
                if self.text(j) == "=>":
                    j, wants = j + 1, True
                continue
            if x == "{":
                if body and not wants:
                    return j
                j, wants = self.close(j) + 1, False
                continue
            if x == "<":
                after = self.angle(j)
                j, wants = (after if after > j else j + 1), False
                continue
            if x in ("|", "&", ".", "?", ":"):
                if x in ("?", ":") and not wants and not self.conditional(i, j):
                    return j
                j, wants = j + 1, True
                continue
            if x in ("keyof", "typeof", "readonly", "infer", "extends", "is", "unique", "asserts", "new"):
                j, wants = j + 1, True
                continue
            if self.t[j].kind in ("name", "string", "number") and wants:
                j, wants = j + 1, False
                continue
            return j
        return end

    def conditional(self, i: int, j: int) -> bool:
        return any(self.text(k) == "extends" for k in range(i, j))

    def types(self, i: int, end: int) -> str | None:
        """Uses of the names in a type; the type's own name if it is a plain one."""
        first = None
        for j in range(i, end):
            x = self.t[j]
            if x.kind == "name" and (x.text not in _WORDS or x.text in ("symbol",)) and self.text(j + 1) not in (":", "?") and self.text(j - 1) != "typeof":
                if self.text(j + 1) == ".":
                    continue
                self.finds.use(plain(x.text), "type", self.s.at(j))
                if first is None and j == i:
                    first = plain(x.text)
        return first if first and end - i == 1 else None

    # imports

    def imports(self, i: int, end: int) -> int:
        j = i + 1
        j += self.text(j) == "type" and self.text(j + 1) not in (",", "from")
        found: list[Binding] = []
        while j < end and self.t[j].kind != "string" and self.text(j) not in (";", "="):
            if self.text(j) == "{":
                stop, k = self.close(j), j + 1
                while k < stop:
                    k += self.text(k) == "type" and self.text(k + 1) not in (",", "as", "}")
                    name = k
                    if self.t[k].kind == "name":
                        self.finds.use(plain(self.text(k)), "import", self.s.at(k))
                        local = k + 2 if self.text(k + 1) == "as" else k
                        found.append(Binding(plain(self.text(local)), plain(self.text(name)), self.whole(name, local)))
                        k = local
                    k = self.comma(k, stop) + 1
                j = stop
            elif self.text(j) == "*":
                j += 2
                self.finds.use(plain(self.text(j)), "import", self.s.at(j))
                found.append(Binding(plain(self.text(j)), None, self.s.at(j)))
            elif self.is_name(j) and self.text(j) != "from":
                self.finds.use(plain(self.text(j)), "import", self.s.at(j))
                found.append(Binding(plain(self.text(j)), None, self.s.at(j)))
            j += 1
        if j < len(self.t) and self.t[j].kind == "string":
            self.finds.imports.append(Import(plain(self.text(j))[1:-1], 0, self.whole(i, j), found))
            j += 1
        return j

    def reexport(self, j: int, end: int) -> int:
        stop = self.close(j) + 1 if self.text(j) == "{" else j + 1
        if self.text(stop) == "as":
            stop += 2
        if self.text(stop) == "from":
            return stop + 2
        self.expression(j + 1, stop - 1)
        return stop

    # expressions

    def expression(self, i: int, end: int, once: bool = False) -> int:
        """Uses between i and end; once: one token or the construct that begins there."""
        while i < end:
            i = max(i + 1, self.one(i, end))
            if once:
                return i
        return i

    def one(self, i: int, end: int) -> int:
        x, prev, nxt = self.t[i], self.text(i - 1), self.text(i + 1)
        if x.kind != "name":
            if x.text == "(" and (arrow := self.find_arrow(i, end)) is not None:
                return self.arrow(i, i, arrow, end)
            if x.text == "{" and prev not in (")", "=>", "else", "try", "finally", "do", ";", "{", "}"):
                return self.literal(i)
            return i + 1
        if prev not in (".", "?."):
            if x.text == "class" and prev != "import":
                return self.class_(i, i)
            if x.text in ("const", "let", "var"):
                return self.variables(i + 1, end, False)
            if x.text == "function" or x.text == "async" and nxt == "function":
                return self.function(i + (x.text == "async"), i, False, value=True)
            if x.text == "async" and (arrow := self.find_arrow(i + 1, end)) is not None:
                return self.arrow(i + 1, i, arrow, end)
            if self.is_name(i) and nxt == "=>":
                return self.arrow(i, i, i + 1, end)
            if x.text == "catch" and nxt == "(":
                if self.scope() and self.is_name(i + 2):
                    self.finds.locals.append((plain(self.text(i + 2)), self.scope()))
                return self.close(i + 1) + 1
            if x.text in ("import", "require") and nxt == "(" and i + 2 < end and self.t[i + 2].kind == "string" and self.text(i + 2) != "`":
                a, b = self.t[i + 2].start + 1, self.t[i + 2].end - 1
                self.finds.use(plain(self.s.text[a:b]), "module", self.s.span(a, b))
                if x.text == "require":
                    self.finds.use("require", "call", self.s.at(i))
                return i + 3
            if x.text in ("as", "satisfies") and self.typed and (prev in (")", "]", "}") or self.t[i - 1].kind in ("name", "string", "number")):
                stop = self.type_end(i + 1, end)
                self.types(i + 1, stop)
                return max(stop, i + 1)
            if x.text == "this" and nxt == "." and self.text(i + 3) == "=" and self.is_name(i + 4) and self.text(i + 5) not in (".", "(", "?.", "["):
                self.finds.from_names.append((plain(self.text(i + 2)), plain(self.text(i + 4)), self.classes[-1] if self.classes else None, self.whole(i, i + 4)))
            if not self.is_name(i):
                return i + 1
            if nxt == ":" and prev in ("{", ",") or nxt == ":" and prev == "case":
                return i + 1
            after = self.angle(i + 1) if self.typed and nxt == "<" else i + 1
            called = self.text(after) == "("
            kind = "construct" if prev == "new" and nxt != "." else "call" if called else "value"
            self.finds.use(plain(x.text), kind, self.s.at(i))
            if after > i + 1 and called:
                self.types(i + 2, after - 1)
                return after
            return i + 1
        after = self.angle(i + 1) if self.typed and nxt == "<" else i + 1
        kind = "call" if self.text(after) == "(" else "member"
        receiver = self.receiver(i - 2)
        self.finds.use(plain(x.text).lstrip("#"), kind, self.s.at(i), receiver if receiver or kind == "member" else EXPRESSION)
        return i + 1

    def receiver(self, i: int) -> str | None:
        if self.t[i].kind != "name" or self.text(i) in _WORDS - _SOFT - {"this", "super"}:
            return None
        if self.text(i - 1) not in (".", "?."):
            return plain(self.text(i))
        if self.text(i - 2) == "this" and self.text(i - 3) not in (".", "?."):
            return f"this.{plain(self.text(i))}"
        return None

    def arrow(self, i: int, first: int, arrow: int, end: int) -> int:
        body = arrow + 1
        last = self.close(body) if self.text(body) == "{" else max(self.comma_value(body, end) - 1, body)
        self.scopes.append(self.whole(first, last))
        j = self.angle(i)
        if self.text(j) == "(":
            self.parameters(j, self.scopes[-1])
            after = self.close(j) + 1
            if self.text(after) == ":":
                self.types(after + 1, arrow)
        else:
            self.finds.locals.append((plain(self.text(j)), self.scopes[-1]))
        if self.text(body) == "{":
            self.program(body + 1, last, False)
        else:
            self.expression(body, last + 1)
        self.scopes.pop()
        return last + 1

    def comma_value(self, i: int, end: int) -> int:
        return min(self.value_end(i, end), end)

    def literal(self, i: int) -> int:
        """An object literal: its methods are functions, its keys no uses."""
        end, j = self.close(i), i + 1
        while j < end:
            k = j
            while self.text(k) in ("async", "get", "set", "*") and self.text(k + 1) not in ("(", ":", ",", "}"):
                k += 1
            after = self.close(k) + 1 if self.text(k) == "[" else k + 1
            if self.text(after) == "(" and self.t[k].kind in ("name", "string") and self.text(self.close(after) + 1) in ("{", ":"):
                j = self.callable(after, end, k) + 1
            elif self.text(after) == ":":
                stop = self.comma(after + 1, end)
                self.expression(after + 1, stop)
                j = stop
            else:
                stop = self.comma(j, end)
                self.expression(j, stop)
                j = stop
            j += self.text(j) == ","
        return end + 1


def _find(source: bytes, typed: bool) -> Finds:
    s = script_tokens(source)
    if not s.tokens:
        return Finds(errors=s.errors)
    scanner = _Scanner(s, typed)
    scanner.program(0, len(s.tokens), True)
    scanner.finds.definitions.extend(stores(scanner))
    return scanner.finds


def entries(scanner: _Scanner, brace: int) -> list[tuple[int, int, int]]:
    """(key, first token of the value, end) of an object literal."""
    out, j, end = [], brace + 1, scanner.close(brace)
    while j < end:
        stop = scanner.comma(j, end)
        key = j + (scanner.text(j) == "async")
        if scanner.t[key].kind in ("name", "string"):
            out.append((key, key + 2 if scanner.text(key + 1) == ":" else key + 1, stop))
        j = stop + 1
    return out


def returned(scanner: _Scanner, first: int, end: int) -> int | None:
    """The brace of the object that a function in tokens first..end gives back."""
    arrow = scanner.find_arrow(first, end)
    if arrow is not None and scanner.text(arrow + 1) == "(" and scanner.text(arrow + 2) == "{":
        return arrow + 2
    for k in range(first, end - 1):
        if scanner.text(k) == "return" and scanner.text(k + 1) == "{":
            return k + 1
    return first if scanner.text(first) == "{" and scanner.text(first - 1) == ":" else None


def stores(scanner: _Scanner) -> list[Definition]:
    """Keys of the state of stores, which are fields of the store."""
    out = []
    for i in range(len(scanner.t) - 2):
        if scanner.text(i) == "defineStore" and scanner.text(i + 1) == "(":
            for k in range(i + 2, scanner.close(i + 1)):
                if scanner.text(k) == "{":
                    for key, first, end in entries(scanner, k):
                        if scanner.text(key) == "state" and (brace := returned(scanner, first, end)) is not None:
                            out += [field_of(scanner, a, c) for a, _, c in entries(scanner, brace)]
                    break
    return out


def field_of(scanner: _Scanner, key: int, end: int) -> Definition:
    line = scanner.s.at(key)[0][0]
    name = plain(scanner.text(key)).strip("\"'")
    return Definition(name, "field", scanner.s.at(key), scanner.whole(key, max(key, end - 1)), signature_of(scanner.s.lines, line, line, None, []), hoisted=True)


def typescript(path: str, source: bytes) -> Finds:
    return _find(source, True)


def javascript(path: str, source: bytes) -> Finds:
    return _find(source, False)


__all__ = ["Token", "entries", "field_of", "javascript", "returned", "typescript"]
