"""Python by its own parser; lines that don't parse are left out one by one, and counted."""

from __future__ import annotations

import ast
import re

from ..functions.names import EXPRESSION
from .model import Binding, Definition, Finds, Import, Span, clean_doc, signature_of

_MOST_ERRORS = 50


def parse(source: bytes) -> tuple[ast.Module, list[bytes], int]:
    """(tree, lines, errors): a line at which parsing fails is blanked, and the rest is tried again."""
    lines = source.replace(b"\r\n", b"\n").replace(b"\r", b"\n").split(b"\n")
    work, errors = list(lines), 0
    while True:
        try:
            return ast.parse(b"\n".join(work)), lines, errors
        except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
            at = getattr(e, "lineno", None)
            errors += 1
            if not at or at > len(work) or errors > _MOST_ERRORS:
                return ast.Module([], []), lines, errors
            bad = work[at - 1]
            indent = bad[: len(bad) - len(bad.lstrip())]
            work[at - 1] = indent + b"pass" if bad.strip() not in (b"", b"pass") else b""
            if bad == work[at - 1]:
                return ast.Module([], []), lines, errors


def _span(node: ast.AST) -> Span:
    return (node.lineno - 1, node.col_offset), (node.end_lineno - 1, node.end_col_offset)


class _Visitor(ast.NodeVisitor):
    def __init__(self, lines: list[bytes]):
        self.lines, self.finds = lines, Finds()
        self.text = [x.decode("utf-8", "replace") for x in lines]
        self.functions: list[Span] = []
        self.classes: list[Span] = []

    # places

    def _after(self, node: ast.AST, words: str, name: str) -> Span:
        """Where the name of a declaration stands: after its keyword."""
        line, raw = node.lineno - 1, self.lines[node.lineno - 1]
        found = re.compile(rb"(?:%s)\s+" % words.encode()).search(raw, node.col_offset)
        start = found.end() if found else raw.find(name.encode(), node.col_offset)
        return (line, start), (line, start + len(name.encode()))

    @staticmethod
    def _tail(node: ast.Attribute) -> Span:
        line, end = node.end_lineno - 1, node.end_col_offset
        return (line, end - len(node.attr.encode())), (line, end)

    def _name(self, node: ast.expr, kind: str) -> None:
        """A use by name or by the last name of a dotted one."""
        if isinstance(node, ast.Name):
            self.finds.use(node.id, kind, _span(node))
        elif isinstance(node, ast.Attribute):
            self.finds.use(node.attr, kind, self._tail(node))

    # declarations

    def _declare(self, node, kind: str, words: str) -> Definition:
        at = self._after(node, words, node.name)
        whole = _span(node)
        if node.decorator_list:
            first = node.decorator_list[0]
            line = first.lineno - 1
            whole = ((line, max(0, self.lines[line].rfind(b"@", 0, first.col_offset))), whole[1])
        names = ["@" + ast.unparse(d.func if isinstance(d, ast.Call) else d) for d in node.decorator_list]
        body = node.body[0]
        ends = [x.end_lineno for x in ast.walk(node.args) if hasattr(x, "end_lineno")] + ([node.returns.end_lineno] if node.returns else []) if hasattr(node, "args") else [x.end_lineno for x in [*node.bases, *node.keywords]]
        last = max([node.lineno, *ends]) - 1
        while last < body.lineno - 1 and not self.text[last].split("#")[0].rstrip().endswith(":") and last - at[0][0] < 12:
            last += 1
        cut = None
        if last == body.lineno - 1 and last > at[0][0]:
            cut = len(self.lines[last][: body.col_offset].decode("utf-8", "replace"))
        doc = ast.get_docstring(node, clean=False)
        found = Definition(node.name, kind, at, whole, signature_of(self.text, at[0][0], last, cut, names), clean_doc(doc) if doc else None)
        self.finds.definitions.append(found)
        return found

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        found = self._declare(node, "class", "class")
        for base in node.bases:
            self._name(base, "class")
        self._decorators(node)
        for x in [*node.bases, *node.keywords]:
            self.visit(x)
        self.classes.append(found.whole)
        for x in node.body:
            for name in self._targets(x):
                self.finds.definitions.append(self._assigned(name, x, "field"))
            self.visit(x)
        self.classes.pop()

    def _function(self, node) -> None:
        self._declare(node, "function", "def")
        self._decorators(node)
        scope = _span(node)
        self._parameters(node.args, scope)
        if node.returns is not None:
            self._type(node.returns)
        self.functions.append(scope)
        for x in node.body:
            for name in self._targets(x):
                self.finds.locals.append((name.id, scope))
            self.visit(x)
        self.functions.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def visit_Lambda(self, node: ast.Lambda) -> None:
        scope = _span(node)
        self._parameters(node.args, scope)
        self.functions.append(scope)
        self.visit(node.body)
        self.functions.pop()

    def _parameters(self, args: ast.arguments, scope: Span) -> None:
        plain = [*args.posonlyargs, *args.args, *args.kwonlyargs]
        for a in [*plain, *filter(None, (args.vararg, args.kwarg))]:
            self.finds.locals.append((a.arg, scope))
            if a.annotation is not None:
                self._type(a.annotation)
                if a in plain and isinstance(a.annotation, ast.Name):
                    self.finds.types.append((a.arg, a.annotation.id, scope))
        for value in [*args.defaults, *filter(None, args.kw_defaults)]:
            self._name(value, "value") if isinstance(value, ast.Name) else None
            self.visit(value)

    def _decorators(self, node) -> None:
        for d in node.decorator_list:
            if isinstance(d, ast.Name):
                self.finds.use(d.id, "call", _span(d))
            self.visit(d)

    @staticmethod
    def _targets(node: ast.stmt) -> list[ast.Name]:
        targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AnnAssign) else []
        return [t for t in targets if isinstance(t, ast.Name)]

    def _assigned(self, name: ast.Name, node: ast.stmt, kind: str) -> Definition:
        line = node.lineno - 1
        return Definition(name.id, kind, _span(name), _span(node), signature_of(self.text, line, line, None, []))

    def visit_Module(self, node: ast.Module) -> None:
        for x in node.body:
            for name in self._targets(x):
                self.finds.definitions.append(self._assigned(name, x, "constant"))
            self.visit(x)

    # assignments: attributes of the instance, and what names hold

    def _assign(self, node) -> None:
        targets = node.targets if isinstance(node, ast.Assign) else [node.target]
        scope = self.functions[-1] if self.functions else None
        for t in targets:
            if isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == "self":
                line = node.lineno - 1
                self.finds.definitions.append(Definition(t.attr, "field", self._tail(t), _span(node), signature_of(self.text, line, line, None, []), hoisted=True))
                if isinstance(node.value, ast.Name):
                    self.finds.from_names.append((t.attr, node.value.id, self.classes[-1] if self.classes else None, _span(node)))
            if isinstance(t, ast.Name) and isinstance(node.value, ast.Call):
                f = node.value.func
                if isinstance(f, ast.Name):
                    self.finds.from_calls.append((t.id, f.id, "", scope, _span(node)))
                elif isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name):
                    self.finds.from_calls.append((t.id, f.attr, f.value.id, scope, _span(node)))
        if isinstance(node, ast.AnnAssign):
            self._type(node.annotation)
        for x in [*targets, *filter(None, [node.value])]:
            self.visit(x)

    visit_Assign = visit_AnnAssign = _assign

    # uses

    def _receiver(self, value: ast.expr) -> str | None:
        if isinstance(value, ast.Name):
            return value.id
        if isinstance(value, ast.Attribute) and isinstance(value.value, ast.Name) and value.value.id == "self":
            return f"this.{value.attr}"
        return None

    def visit_Call(self, node: ast.Call) -> None:
        f = node.func
        if isinstance(f, ast.Name):
            self.finds.use(f.id, "call", _span(f))
        elif isinstance(f, ast.Attribute):
            self.finds.use(f.attr, "call", self._tail(f), self._receiver(f.value) or EXPRESSION)
        for a in node.args:
            if isinstance(a, ast.Name):
                self.finds.use(a.id, "value", _span(a))
        self.generic_visit(node)

    def visit_Attribute(self, node: ast.Attribute) -> None:
        self.finds.use(node.attr, "member", self._tail(node), self._receiver(node.value))
        self.visit(node.value)

    def visit_Return(self, node: ast.Return) -> None:
        if isinstance(node.value, ast.Name):
            self.finds.use(node.value.id, "value", _span(node.value))
        self.generic_visit(node)

    def _type(self, node: ast.expr) -> None:
        """Names that an annotation is made of, those of unions and of type arguments too."""
        if isinstance(node, (ast.Name, ast.Attribute)):
            self._name(node, "type")
        elif isinstance(node, ast.BinOp):
            self._type(node.left)
            self._type(node.right)
        elif isinstance(node, ast.Subscript):
            parts = node.slice.elts if isinstance(node.slice, ast.Tuple) else [node.slice]
            for x in [node.value, *parts]:
                self._type(x)

    # imports

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            at = _span(a)
            if a.asname:
                self._alias(a, at)
                binding = Binding(a.asname, a.name, at)
            else:
                binding = Binding(a.name.split(".")[0], None, at)
                self._dotted(a.name, at[0])
            self.finds.imports.append(Import(a.name, 0, at, [binding]))

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        out = Import(node.module or "", node.level, _span(node))
        for a in node.names:
            if a.name == "*":
                continue
            at = _span(a)
            if a.asname:
                self._alias(a, at)
            else:
                self.finds.use(a.name, "import", at)
            out.bindings.append(Binding(a.asname or a.name, a.name, at))
        self.finds.imports.append(out)

    def _alias(self, a: ast.alias, at: Span) -> None:
        line, end = at[1]
        self.finds.use(a.asname, "import", ((line, end - len(a.asname.encode())), (line, end)))

    def _dotted(self, name: str, start) -> None:
        line, at = start
        for part in name.split("."):
            self.finds.use(part, "import", ((line, at), (line, at + len(part.encode()))))
            at += len(part.encode()) + 1


def find(path: str, source: bytes) -> Finds:
    tree, lines, errors = parse(source)
    visitor = _Visitor(lines)
    visitor.visit(tree)
    visitor.finds.errors = errors
    return visitor.finds
