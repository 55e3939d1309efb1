"""Building an index from files and from a git revision, keeping it up, and asking it."""

from __future__ import annotations

import os
import subprocess

import pytest
from pyspark.sql import functions as F

from symloom.index import detect_changes, update_store
from symloom.sources import GitRevision, WorkingTree
from symloom.sources.tree import resolve_revision, sorted_out, walk_stats
from symloom.store import IndexStore, StoreError
from symloom.tools import ToolError, Tools

FILES = {
    "lib/core.py": "class Base:\n    def run(self):\n        return helper()\n\nclass Engine(Base):\n    def __init__(self, n):\n        self.n = n\n    def go(self) -> 'Engine':\n        return self.run()\n\ndef helper():\n    return LIMIT\n\nLIMIT = 3\n",
    "lib/util.py": "from .core import Engine\n\ndef make() -> Engine:\n    return Engine(1)\n",
    "app/main.py": "from lib.util import make\nimport lib.core\n\ndef main():\n    e = make()\n    e.go()\n    e.run()\n    return e.n\n",
    "app/late.py": "from lib.soon import later\n\ndef f():\n    return later()\n",
    "web/user.ts": "export interface Named { name: string }\nexport class User implements Named {\n  name = 'x';\n  greet(): string { return this.name; }\n}\nexport function makeUser(): User { return new User(); }\n",
    "web/app.ts": "import { makeUser, User } from '@/user';\nclass Admin extends User { hi() { return this.greet(); } }\nconst u = makeUser();\nu.greet();\nimport React from 'react';\nReact.go();\n",
    "tsconfig.json": '{ // settings\n "compilerOptions": { "baseUrl": ".", "paths": { "@/*": ["web/*"], }, }, }',
    "composer.json": '{"require": {"laravel/framework": "^11"}, "autoload": {"psr-4": {"App\\\\": "app/"}}}',
    "app/Models/Ad.php": "<?php\nnamespace App\\Models;\nclass Ad extends Model {\n    public function save(): static { return $this; }\n}\n",
    "app/Http/C.php": "<?php\nnamespace App\\Http;\nuse App\\Models\\Ad;\nclass C {\n    public function show(Ad $ad) {\n        $b = Ad::find(1);\n        $b->save();\n        $ad->save();\n        return view('ads.show');\n    }\n}\n",
    "resources/views/ads/show.blade.php": "@extends('layout')\n{{ $x }}\n",
    "resources/views/layout.blade.php": "<x-alert/>\n",
    "notes.txt": "not source",
    "node_modules/x/a.py": "def no(): pass\n",
}


def write(root, files):
    for path, text in files.items():
        at = os.path.join(root, path)
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(at, "w") as f:
            f.write(text)


def edges(store):
    rows = store.edges.filter("kind <> 'contains'").collect()
    return {(r["site_path"], r["site_start_line"], r["site_start_char"], r["src_id"], r["dst_id"], r["kind"], r["tier"]) for r in rows}


def told(store):
    return {(e[3].split("#")[1], e[4].split("#")[1], e[5], e[6]) for e in edges(store)}


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("project"))
    write(root, FILES)
    store = IndexStore(spark, str(tmp_path_factory.mktemp("store")), 8)
    result = update_store(store, WorkingTree(spark, root))
    return root, store, result


def test_what_a_build_resolves(project):
    _, store, result = project
    assert result.changes["added"] == 10 and not result.scoped and not result.failures
    got = told(store)
    assert {
        ("main", "make", "calls", "import_map"), ("main", "Engine.go", "calls", "import_map"), ("main", "Base.run", "calls", "import_map"), ("main", "Engine.n", "references", "import_map"),
        ("Engine", "Base", "inherits", "same_module"), ("Engine.go", "Base.run", "calls", "same_module"), ("Base.run", "helper", "calls", "same_module"), ("make", "Engine", "uses_type", "import_map"),
        ("<module>", "makeUser", "imports", "import_map"), ("Admin", "User", "inherits", "import_map"), ("Admin.hi", "User.greet", "calls", "same_module"), ("User", "Named", "inherits", "same_module"), ("User.greet", "User.name", "references", "same_module"),
        ("u", "makeUser", "calls", "import_map"), ("<module>", "User.greet", "calls", "same_module"),
        ("C.show", "Ad", "uses_type", "import_map"), ("C.show", "Ad.save", "calls", "import_map"), ("C.show", "Ad.save", "calls", "unique_name"), ("C.show", "<module>", "imports", "import_map"), ("<module>", "<module>", "inherits", "import_map"),
        ("Admin", "Named", "implements", "same_module"),  # the weaker of two links
    } - got == set()
    assert not any("React" in e[1] or e[1] == "later" for e in got)
    assert result.resolution["external"] >= 1
    assert {r["path"] for r in store.files.collect()} == {p for p in FILES if p.endswith((".py", ".ts", ".php")) and "node_modules" not in p}
    assert store.edges.filter("kind = 'contains' and tier = 'oracle'").count() > 5
    total = store.ranks.agg(F.sum("score")).first()[0]
    assert abs(total - 1) < 1e-6
    assert {r["relation"]: r["rows"] for r in store.counts().collect()}["files"] == 10


def test_an_update_equals_a_build(spark, project, tmp_path):
    """After every edit, edges and ranks are those of a build from nothing."""
    root = str(tmp_path / "work")
    write(root, FILES)
    store = IndexStore(spark, str(tmp_path / "store"), 8)
    update_store(store, WorkingTree(spark, root))
    assert edges(store) == edges(project[1])
    assert update_store(store, WorkingTree(spark, root)).generation == 1  # nothing to do
    write(root, {"lib/soon.py": "def later():\n    return 1\n", "lib/core.py": FILES["lib/core.py"].replace("class Engine(Base)", "class Other:\n    def run(self): pass\n\nclass Engine(Other)")})
    os.remove(os.path.join(root, "web/user.ts"))
    result = update_store(store, WorkingTree(spark, root))
    assert result.scoped and (result.changes["added"], result.changes["modified"], result.changes["removed"]) == (1, 1, 1)
    whole = IndexStore(spark, str(tmp_path / "whole"), 4)
    update_store(whole, WorkingTree(spark, root))
    assert edges(store) == edges(whole)
    assert ("f", "later", "calls", "import_map") in told(store) and ("main", "Other.run", "calls", "import_map") in told(store)
    ranks = lambda s: {r["symbol_id"]: (round(r["score"], 8), r["in_degree"]) for r in s.ranks.collect()}
    assert ranks(store) == ranks(whole)


def test_a_revision_reads_like_its_files(spark, project, tmp_path):
    root = str(tmp_path / "repo")
    write(root, {k: v for k, v in FILES.items() if k.startswith(("lib", "app/main", "node"))})
    run = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", "-A", "-f")
    run("commit", "-qm", "one")
    tree = GitRevision(spark, root)
    assert tree.commit == resolve_revision(root) and {r["path"] for r in tree.files().collect()} == {"lib/core.py", "lib/util.py", "app/main.py"}
    files = {r["path"]: bytes(r["content"]).decode() for r in tree.contents(tree.files()).collect()}
    assert files["lib/util.py"] == FILES["lib/util.py"]
    stats = walk_stats(sorted_out(tree.listing())).first()
    assert (stats["considered"], stats["selected"], stats["excluded"]) == (4, 3, 1)
    write(root, {"untracked.py": "x = 1\n", "ignored.py": "y = 1\n", ".gitignore": "ignored.py\n"})
    assert {r["path"] for r in WorkingTree(spark, root).files().collect()} == {"lib/core.py", "lib/util.py", "app/main.py", "untracked.py"}
    store = IndexStore(spark, str(tmp_path / "s"), 4)
    changes, _ = detect_changes(store, tree)
    assert {r["status"] for r in changes.collect()} == {"added"}


def test_transactions_are_whole_or_nothing(spark, project, tmp_path):
    _, source, _ = project
    store = IndexStore(spark, str(tmp_path / "s"), 4)
    with store.transaction() as t:
        t.put_files({n: source.table(n) for n in ("files", "symbols", "refs", "imports", "import_bindings")}, source.files)
        t.replace_edges(source.edges)
    before = (store.generation, store.edges.count(), store.symbols.count())
    with pytest.raises(ZeroDivisionError), store.transaction() as t:
        t.replace_edges(store.edges.limit(0))
        raise ZeroDivisionError
    again = IndexStore(spark, str(tmp_path / "s"))
    assert (again.generation, again.edges.count(), again.symbols.count()) == before
    one = spark.createDataFrame([("lib/core.py",)], "path string")
    with again.transaction() as t:
        t.remove_files(one)
    assert again.symbols.filter("path = 'lib/core.py'").count() == 0 and again.edges.filter("site_path = 'lib/core.py'").count() == 0
    assert again.symbols.filter("path = 'lib/util.py'").count() == source.symbols.filter("path = 'lib/util.py'").count()
    with pytest.raises(StoreError):
        store.set_meta("late", "writer")
    with again.transaction() as t:
        t.delete_derived_edges()
        t.delete_edges_at(again.edges.filter("kind = 'calls'").select(F.col("site_path").alias("path"), F.col("site_start_line").alias("start_line"), F.col("site_start_char").alias("start_char")))
    assert again.edges.filter("kind = 'calls' or (kind = 'implements' and site_path is null)").count() == 0
    with again.transaction() as t:
        t.add_edges(source.edges.filter("kind = 'calls'"))
    assert again.edges.filter("kind = 'calls'").count() == source.edges.filter("kind = 'calls'").count()
    assert again.vacuum() > 0 and again.edges.count() > 0
    again.set_meta("k", "v")
    assert IndexStore(spark, str(tmp_path / "s")).meta("k") == "v"
    again.reset()
    assert again.is_empty and again.symbols.count() == 0


def test_tools(project):
    root, store, _ = project
    t = Tools(store)
    assert t.resolve_symbol("lib/core.py#Engine.go")["name"] == "go"
    assert t.resolve_symbol("Engine/go")["id"] == t.resolve_symbol("Engine.go")["id"] == t.resolve_symbol("Engine::go")["id"] == "lib/core.py#Engine.go"
    assert t.resolve_symbol("lib/core.py:9")["id"] == "lib/core.py#Engine.go" and t.resolve_symbol("lib:Base/run")["id"] == "lib/core.py#Base.run"
    assert t.resolve_symbol("makeUs")["name"] == "makeUser"
    for text, part in (("Engine/stop", "declares: __init__, n, go"), ("name", "pass one of"), ("zzz", "search_symbols"), ("", "give a symbol"), ("lib/core.py:99", "file_outline")):
        with pytest.raises(ToolError, match=part):
            t.resolve_symbol(text)
    assert t.resolve_symbol("name[1]")["name"] == "name"
    said = t.search_symbols("greet")
    assert said.startswith("1 match(es) for 'greet':\nweb/user.ts:4  method User/greet  (") and "use" in said
    assert "pass cursor=1 for more" in t.search_symbols("run", limit=1) or "1 match" in t.search_symbols("run", limit=1)
    assert t.search_symbols("nothing here") == "nothing matches 'nothing here'\n"
    with pytest.raises(ToolError, match="valid"):
        t.search_symbols("x", kinds=("bogus",))
    whole = t.get_symbol("Engine", "skeleton", include_body=True)
    assert "class Engine" in whole and "contains 3 definition(s)" in whole and "def go(self) -> 'Engine':" in whole and "used by:" in whole
    refs = t.find_references("Base/run")
    assert refs.startswith("2 use(s) of Base/run") and "app/main.py:\n  7  calls from main" in refs
    assert t.find_references("LIMIT", 0.99).startswith("nothing uses LIMIT above")
    tree = t.neighbours("main", "out", 2)
    assert "calls make  lib/util.py:3" in tree and "    calls Engine  lib/core.py:5" in tree
    with pytest.raises(ToolError, match="1 to 3"):
        t.neighbours("main", depth=4)
    assert t.file_outline("./web/user.ts").splitlines()[:3] == ["web/user.ts:", "    1  export interface Named { name: string }", "      1  export interface Named { name: string }"]
    with pytest.raises(ToolError, match="not in the index"):
        t.file_outline("no.py")
    assert len(t.file_outline("lib/core.py", budget=30)) < len(t.file_outline("lib/core.py"))
    a, b = t.repo_map(), t.repo_map(mention=("engine", "nosuch"), focus=("gone.py",), budget=300)
    assert "lib/core.py:" in a and a == t.repo_map() and "focus not in the index: gone.py" in b and "mentioned but not found: nosuch" in b and "class Engine" in b
    status = t.index_status()
    assert "files:     10" in status and "python 4" in status and root in status
    assert t.calibrate(lambda text: len(text) // 3 + text.count("\n"), "m") > 1 and "calibrated for m" in t.index_status()


def test_command_line(spark, project, tmp_path):
    import io

    from symloom.cli import main

    root, store, _ = project
    at = store.root.removeprefix("file://")

    def said(*args):
        out = io.StringIO()
        return main(list(args), spark, out), out.getvalue()

    assert said("search", "--store", at, "greet")[1].startswith("1 match(es)")
    assert said("outline", "--store", at, "no.py")[0] == 2
    assert said("tokens", "--store", at, "--max-total", "1")[0] == 1 and "app" in said("tokens", "--store", at)[1]
    doc = tmp_path / "d.md"
    doc.write_text("see `core.py:1-4` and `web/user.ts:900` and `gone.py`\n")
    code, text = said("check-docs", "--store", at, str(doc))
    assert code == 1 and "stale:" in text and "unindexed:" in text
    assert said("index", "--store", at, root, "--max-error-rate", "0.5")[0] == 0
