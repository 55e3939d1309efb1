"""Templates with islands of another language: Vue components, and Blade views."""

from __future__ import annotations

import re

from .model import Definition, Finds, Place
from .php import find as find_php
from .script import _Scanner, entries, field_of, returned, stores
from .tokens import Source, plain, script_tokens

_SCRIPT = re.compile(r"<script\b([^>]*)>(.*?)</script\s*>", re.S | re.I)
_TEMPLATE = re.compile(r"<template\b[^>]*>(.*)</template\s*>", re.S | re.I)
_STYLE = re.compile(r"<(style|script)\b.*?</\1\s*>", re.S | re.I)
_TAG = re.compile(r"<([A-Za-z][\w.:-]*)")
_DIRECTIVE = re.compile(r"@(extends|include|includeIf|each|component|livewire)\s*\(\s*('[^']*'|\"[^\"]*\")")
#: What each directive refers to.
DIRECTIVES = {"extends": "extends", "include": "include", "includeIf": "include", "each": "include", "component": "include", "livewire": "component"}
_ECHO = re.compile(r"\{\{--.*?--\}\}|\{\{(.*?)\}\}|\{!!(.*?)!!\}|@php\b(?!\s*\()(.*?)@endphp", re.S)


def is_component_name(name: str) -> bool:
    return "-" in name or name[:1].isupper()


def vue(path: str, source: bytes) -> Finds:
    """The script as it stands in the file, the component that the file is, and the components in its template."""
    host, out = Source(source), Finds()
    for block in _SCRIPT.finditer(host.text):
        typed = re.search(r"lang\s*=\s*[\"']?(ts|tsx)\b", block[1]) is not None
        # Blanked up to the script, so that places are the file's own.
        before = re.sub(r"[^\n]", " ", host.text[: block.start(2)])
        scanner = _Scanner(script_tokens((before + block[2]).encode("latin-1")), typed)
        scanner.program(0, len(scanner.t), True)
        found = scanner.finds
        found.definitions.extend(stores(scanner))
        found.definitions.extend(_component(path, host, block, scanner))
        out.add(found)
    shown = _TEMPLATE.search(host.text)
    if shown:
        for m in _TAG.finditer(host.text, shown.start(1), shown.end(1)):
            if is_component_name(m[1]):
                out.use(plain(m[1]), "component", host.span(m.start(1), m.end(1)))
    return out


def _component(path: str, host: Source, block: re.Match, scanner: _Scanner) -> list[Definition]:
    name = re.sub(r"\.vue$", "", path.rsplit("/", 1)[-1])
    setup = re.search(r"\bsetup\b", block[1]) is not None
    exported = next((i for i in range(len(scanner.t) - 1) if scanner.text(i) == "export" and scanner.text(i + 1) == "default"), None)
    if not setup and exported is None:
        return []
    whole = host.span(block.start(), block.end())
    line, column = whole[0]
    out = [Definition(name, "component", (whole[0], (line, column + len("<script"))), whole, plain(host.text[block.start() : block.start(2)]).strip())]
    if setup:
        for i in range(len(scanner.t) - 1):
            if scanner.text(i) == "defineProps":
                j = i + 1
                if scanner.text(j) == "<" and scanner.text(j + 1) == "{":
                    out += [field_of(scanner, k, e) for k, _, e in _members(scanner, j + 1)]
                elif scanner.text(j) == "(" and scanner.text(j + 1) in ("{", "["):
                    out += _props(scanner, j + 1)
        return out
    brace = next((k for k in range(exported, min(exported + 6, len(scanner.t))) if scanner.text(k) == "{"), None)
    for key, first, end in entries(scanner, brace) if brace is not None else ():
        what = scanner.text(key).strip("\"'")
        if what == "props" and scanner.text(first) in ("{", "["):
            out += _props(scanner, first)
        elif what == "data" and (held := returned(scanner, first, end)) is not None:
            out += [field_of(scanner, k, e) for k, _, e in entries(scanner, held)]
        elif what in ("methods", "computed") and scanner.text(first) == "{":
            for k, _, e in entries(scanner, first):
                d = field_of(scanner, k, e)
                out.append(Definition(d.name, "method", d.at, d.whole, d.signature))
    return out


def _members(scanner: _Scanner, brace: int) -> list[tuple[int, int, int]]:
    out, j, end = [], brace + 1, scanner.close(brace)
    while j < end:
        stop = j
        while stop < end and scanner.text(stop) not in (";", ","):
            stop = scanner.close(stop) + 1 if scanner.text(stop) in ("(", "[", "{") else stop + 1
            if stop < end and scanner.s.place(scanner.t[stop].start)[0] > scanner.s.place(scanner.t[stop - 1].end)[0]:
                break
        if scanner.t[j].kind == "name":
            out.append((j, j + 1, stop))
        j = stop + (scanner.text(stop) in (";", ","))
    return out


def _props(scanner: _Scanner, i: int) -> list[Definition]:
    if scanner.text(i) == "{":
        return [field_of(scanner, k, e) for k, _, e in entries(scanner, i)]
    return [field_of(scanner, k, k + 1) for k in range(i + 1, scanner.close(i)) if scanner.t[k].kind == "string"]


def blade(path: str, source: bytes) -> Finds:
    """Views and components that directives and tags name, and the PHP between marks."""
    host, out = Source(source), Finds()
    for m in _DIRECTIVE.finditer(host.text):
        a, b = m.span(2)
        out.use(("livewire:" if m[1] == "livewire" else "") + plain(host.text[a + 1 : b - 1]), DIRECTIVES[m[1]], host.span(a, b))
    for m in _TAG.finditer(_STYLE.sub(lambda x: re.sub(r"[^\n]", " ", x[0]), host.text)):
        if is_component_name(m[1]):
            out.use(plain(m[1]), "component", host.span(m.start(1), m.end(1)))
    for m in _ECHO.finditer(host.text):
        k = next((g for g in (1, 2, 3) if m[g] is not None), None)
        if k is None:
            continue
        start = host.place(m.start(k))

        def shift(at: Place, start=start) -> Place:
            """From the island, which begins after a mark of its own, to the file."""
            return (start[0] + at[0], at[1] + (start[1] - len("<?php ") if at[0] == 0 else 0))

        found = find_php(path, b"<?php " + m[k].encode("latin-1") + b";")
        found.definitions = [d for d in found.definitions if d.name]
        for d in found.definitions:
            d.signature = d.signature.removeprefix("<?php").strip()
        out.add(found.moved(shift))
    return out
