"""Extraction of each language, by what hand-written files hold."""

from __future__ import annotations

import pytest

from symloom.extract import extract_source, language_for_path

PY = b'''import os.path
import numpy as np
from .models import User, Admin as Boss
LIMIT: int = 3

@deco
@app.route("/x")
class Service(Boss, metaclass=M):
    """A service.

    More.
    """
    size = LIMIT

    def __init__(self, client: Client, *, n: int = LIMIT) -> None:
        self.client = client
        x = build()
        x.go(LIMIT)
        self.client.fetch(client)

    def run(
        self,
        user: User | None,
    ) -> list[User]:
        def helper(a):
            return a
        return helper(user)
'''
TS = b'''import { User, type Role as R } from "./user";
import def, * as ns from "pkg";
/** Greets. */
export class Greeter extends Base implements Named {
  private readonly svc: Svc;
  constructor(private client: Client, name: string = DEFAULT) { this.name = name; }
  async greet<T>(user: User): Promise<Result> {
    const g = makeGreeter(user);
    this.client.send(g.run(), user);
    return rest.map((r) => format(r)).join(",");
  }
}
export interface Named { name: string; hello(who: User): void }
export type Id = string | User;
export const makeGreeter = (u: User): Greeter => new Greeter(u);
function helper(n = 3) { return import("./lazy"); }
'''
PHP = b'''<?php
namespace Demo\\Sub;
use Demo\\Greeter;
use Demo\\{A as B, C};
/** An app. */
#[Route("/x")]
final class App extends Base implements \\Countable {
    use Loggable;
    public const LIMIT = 3, MORE = self::LIMIT;
    /** @var Greeter|null */
    protected $greeter;
    public function __construct(private Greeter $svc) { parent::__construct(); $this->greeter = $svc; }
    public function run(User $user): ?Result {
        $h = Ad::find(1);
        $this->svc->greet($h->name, self::LIMIT);
        return view('users.index', [App::class, 'run']);
    }
}
'''


def found(path, source):
    x = extract_source(path, source)
    symbols = {s["id"].split("#")[1]: s for s in x.symbols}
    refs = {(r["name"], r["kind"], (r["container_id"] or "#").split("#")[1], r["receiver"], r["receiver_type"]) for r in x.refs}
    return x, symbols, refs


def test_python():
    x, symbols, refs = found("a/b.py", PY)
    assert {k: s["kind"] for k, s in symbols.items()} == {"LIMIT": "constant", "Service": "class", "Service.size": "field", "Service.__init__": "constructor", "Service.client": "field", "Service.run": "method", "Service.run.helper": "function"}
    assert symbols["Service"]["signature"] == "@deco @app.route class Service(Boss, metaclass=M):" and symbols["Service"]["documentation"] == "A service.\n\nMore."
    assert symbols["Service.run"]["signature"] == "def run(self, user: User | None) -> list[User]:"
    assert [s["name"] for s in x.symbols if s["is_local"]] == ["helper"]
    assert (symbols["Service"]["name_start_line"], symbols["Service"]["name_start_char"], symbols["Service"]["full_start_line"]) == (7, 6, 5)
    assert {("Boss", "class", "Service", None, None), ("go", "call", "Service.__init__", "x", "call:build||"), ("fetch", "call", "Service.__init__", "this.client", "assigned:Client"), ("User", "type", "Service.run", None, None), ("np", "import", "", None, None), ("LIMIT", "value", "Service.__init__", None, None)} <= refs
    assert not any(r[0] == "client" and r[1] == "value" for r in refs)  # a parameter shadows
    assert [(i["module"], i["relative_level"], [(b["local"], b["original"]) for b in i["bindings"]]) for i in x.imports] == [("os.path", 0, [("os", None)]), ("numpy", 0, [("np", "numpy")]), ("models", 1, [("User", "User"), ("Boss", "Admin")])]
    assert x.errors == 0


def test_python_that_does_not_parse_is_read_around():
    x, symbols, _ = found("x.py", b"def good():\n    return 1\n\ndef bad(:\n    pass\n\nclass A:\n    def g(self):\n        return good()\n")
    assert x.errors >= 1 and {"good", "A", "A.g"} <= set(symbols)


def test_repeated_names_are_numbered():
    _, symbols, _ = found("x.py", b"def f(): pass\ndef f(): pass\n")
    assert set(symbols) == {"f", "f$2"}


def test_typescript():
    x, symbols, refs = found("src/a.ts", TS)
    kinds = {k: s["kind"] for k, s in symbols.items()}
    assert kinds == {"Greeter": "class", "Greeter.svc": "field", "Greeter.constructor": "constructor", "Greeter.greet": "method", "Named": "interface", "Named.name": "field", "Named.hello": "method", "Id": "type_alias", "makeGreeter": "function", "helper": "function"}
    assert symbols["Greeter"]["documentation"] == "Greets." and symbols["makeGreeter"]["signature"].startswith("export const makeGreeter = (u: User): Greeter")
    assert {("Base", "class", "Greeter", None, None), ("Named", "class", "Greeter", None, None), ("send", "call", "Greeter.greet", "this.client", "Client"), ("run", "call", "Greeter.greet", "g", "call:makeGreeter||"), ("Greeter", "construct", "makeGreeter", None, None), ("./lazy", "module", "helper", None, None), ("join", "call", "Greeter.greet", "(expression)", None), ("User", "type", "Id", None, None)} <= refs
    assert [(i["module"], [(b["local"], b["original"]) for b in i["bindings"]]) for i in x.imports] == [("./user", [("User", "User"), ("R", "Role")]), ("pkg", [("def", None), ("ns", None)])]


def test_php():
    x, symbols, refs = found("src/App.php", PHP)
    assert {k: s["kind"] for k, s in symbols.items() if k.startswith("App")} == {"App": "class", "App.LIMIT": "constant", "App.MORE": "constant", "App.greeter": "field", "App.__construct": "constructor", "App.svc": "field", "App.run": "method"}
    assert x.namespace == "Demo\\Sub" and symbols["App"]["signature"].startswith("#[Route] final class App extends Base") and symbols["App"]["documentation"] == "An app."
    assert {("Base", "class", "App", None, None), ("Loggable", "class", "App", None, None), ("greet", "call", "App.run", "this.svc", "Greeter"), ("name", "member", "App.run", "h", "call:find|Ad|"), ("LIMIT", "member", "App.run", "self", None), ("users.index", "view", "App.run", None, None), ("run", "call", "App.run", "App", None), ("parent", "scope", "App.__construct", None, None)} <= refs
    assert [(i["module"], i["bindings"][0]["local"]) for i in x.imports] == [("Demo\\Greeter", "Greeter"), ("Demo\\A", "B"), ("Demo\\C", "C")]


def test_vue_and_blade():
    _, symbols, refs = found("a/My.vue", b'<template>\n  <div><MyButton/><my-input></my-input><p>x</p></div>\n</template>\n<script lang="ts">\nimport MyButton from "./MyButton.vue";\nexport default {\n  props: { size: Number },\n  data() { return { count: 0 }; },\n  methods: { go(n: number) { this.count = n; } },\n};\n</script>\n')
    assert {k: s["kind"] for k, s in symbols.items()} == {"My": "component", "My.size": "field", "My.count": "field", "My.go": "method"}
    assert {("MyButton", "component", "", None, None), ("my-input", "component", "", None, None), ("count", "member", "My.go", "this", None)} <= refs and not any(r[0] == "div" for r in refs)
    _, _, refs = found("v/x.blade.php", b"@extends('layouts.app')\n<x-alert/> @include(\"part.one\")\n{{ $user->name }} {!! App\\Models\\Ad::find(1) !!}\n<p>@livewire('counter')</p>\n")
    assert {(r[0], r[1]) for r in refs} == {("layouts.app", "extends"), ("x-alert", "component"), ("part.one", "include"), ("name", "member"), ("Ad", "type"), ("find", "call"), ("livewire:counter", "component")}
    x = extract_source("v/x.blade.php", b"a\nbb {{ $user->name }}")
    assert [(r["start_line"], r["start_char"]) for r in x.refs] == [(1, 13)]


def test_state_of_a_store_is_fields():
    _, symbols, _ = found("s.js", b'export const useS = defineStore("s", { state: () => ({ a: 1, b: [] }), actions: { hit() { this.a++; } } });\n')
    assert {"useS", "useS.a", "useS.b"} <= set(symbols)


@pytest.mark.parametrize("path,language", [("A.PY", "python"), ("x.phtml", "php"), ("v/y.blade.php", "blade"), ("a.d.ts", "typescript"), ("a.TSX", "tsx"), ("README.md", None)])
def test_language_by_name(path, language):
    assert language_for_path(path) == language


@pytest.mark.parametrize("name", ["a.py", "a.ts", "a.js", "a.php", "a.vue", "a.blade.php"])
@pytest.mark.parametrize("body", [b"", b"\xff\xfe\x00garbage {{{ ((( <?php class { function ( <script>", b"}" * 50 + b"class A extends {", b"'unclosed \n`tick ${ a", "class Ä { ünï() { return 'é' } }".encode()])
def test_anything_is_read(name, body):
    extract_source(name, body)
