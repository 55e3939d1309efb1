"""Operators against plain Python, and their cases of nulls, ties and nothing."""

from __future__ import annotations

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from symloom.functions import names as N
from symloom.operators import compare as C
from symloom.operators import conventions as V
from symloom.operators import docs as D
from symloom.operators import enrich as X
from symloom.operators import facts as E
from symloom.operators import graph as G
from symloom.operators import lookup as L
from symloom.operators import metrics as M
from symloom.operators import modules as R
from symloom.operators import replay as P
from symloom.operators import select as S
from symloom.schema import EDGES, SYMBOLS
from symloom.sources import facts as sources
from symloom.sources import scip, wire


def symbol(i, path="a.py", name=None, kind="function", line=0, end=None, up=None, **more):
    row = dict.fromkeys(SYMBOLS.names)
    row |= {"id": i, "path": path, "name": name or i, "kind": kind, "qualified_name": name or i, "container_id": up, "is_local": False, "is_synthetic": False}
    row |= {"name_start_line": line, "name_start_char": 4, "name_end_line": line, "name_end_char": 9, "full_start_line": line, "full_start_char": 0, "full_end_line": line if end is None else end, "full_end_char": 0}
    return tuple((row | more)[n] for n in SYMBOLS.names)


def edge(src, dst, kind="calls", path="a.py", line=0, char=0, tier="same_module", confidence=0.9):
    return (path, src, dst, kind, tier, confidence, line, char, line, char + 1) if path else (None, src, dst, kind, tier, confidence, None, None, None, None)


# matching


def test_matching_is_maximum():
    r = random.Random(3)
    for _ in range(200):
        n, m = r.randint(0, 5), r.randint(0, 5)
        near = [[j for j in range(m) if r.random() < 0.4] for _ in range(n)]
        got = E.maximum_matching(near, m)
        used = [j for j in got if j >= 0]
        assert len(used) == len(set(used)) and all(j < 0 or j in near[i] for i, j in enumerate(got))
        best = max((sum(p[i] in near[i] for i in range(n)) for p in itertools.permutations([*range(m), *range(-1, -n - 1, -1)], n)), default=0) if n else 0
        assert len(used) == best


def test_overlap_gives_up_exact_pairs_for_more(spark):
    kinds = "path string, start_line int, start_char int, end_line int, end_char int, kind string"
    c = spark.createDataFrame([("a", 1, 0, 1, 10, None), ("a", 1, 5, 1, 12, None), ("b", 1, 0, 1, 3, "class"), (None, 1, 0, 1, 2, None)], kinds)
    o = spark.createDataFrame([("a", 1, 0, 1, 10, None), ("a", 1, 0, 1, 4, None), ("b", 1, 0, 1, 3, "function")], kinds)
    count = lambda policy: tuple(M.pooled(E.by_path(E.match_facts(c, o, policy))).first()[:3])
    assert count("exact") == (1, 3, 2) and count("overlap") == (2, 2, 1) and count("line")[0] == 2
    empty = c.limit(0)
    assert M.pooled(E.by_path(E.match_facts(empty, empty))).first()[:3] == (0, 0, 0)


def test_slack_and_curves(spark):
    kinds = "task string, path string, line int"
    said = spark.createDataFrame([("t", "a", 4), ("t", "a", 4), ("t", "a", 5), ("t", "b", 9)], kinds)
    sites = spark.createDataFrame([("t", "a", 5), ("t", "a", 6), ("u", "a", 1)], kinds)
    assert {r["task"]: tuple(r)[1:] for r in E.slack_matches(said, sites).collect()} == {"t": (1, 2, 1), "u": (0, 0, 1)}
    wrong = spark.createDataFrame([(1.5, True)], "confidence double, correct boolean")
    with pytest.raises(Exception, match="outside 0 to 1"):
        M.calibration_bins(wrong).collect()
    bins = M.calibration_bins(spark.createDataFrame([(0.98, False)] * 6 + [(1.0, True)], "confidence double, correct boolean"))
    assert M.worst_bin(bins).first()["bin"] == 6 and M.overconfident_bins(bins).count() == 1


def test_intervals():
    assert M.bootstrap_interval([]).method == "empty" and M.bootstrap_interval([(1, 1, 0)]).method == "degenerate"
    assert M.bootstrap_interval([(3, 0, 0)] * 4) == M.Interval(1.0, 1.0, 1.0, "percentile")
    got = M.bootstrap_interval([(8, 2, 1), (5, 5, 5), (10, 0, 0), (0, 3, 4), (6, 1, 2)], resamples=500)
    assert got.method == "bca" and got.low < got.point < got.high and got == M.bootstrap_interval([(8, 2, 1), (5, 5, 5), (10, 0, 0), (0, 3, 4), (6, 1, 2)], resamples=500)
    assert M.percentile([1, 2, 4], 0.75) == 3 and M.percentile([], 0.5) == 0
    assert M.paired_interval([]).method == "empty" and M.paired_interval([1.0, 3.0]).point == 2


def test_resampled_scores_center_on_the_score(spark):
    counts = spark.createDataFrame([(f"f{i}", 8, 2, i % 3) for i in range(40)], "path string, tp long, fp long, fn long")
    f1 = [r["f1"] for r in M.bootstrap_table(counts, 100).collect()]
    assert len(f1) == 100 and abs(sum(f1) / 100 - M.pooled(counts).first()["f1"]) < 0.02


# names, modules, conventions


def test_words(spark):
    row = spark.createDataFrame([("Please fix the clearReport_page of HTTPServer id", ["src/reportPage.vue"])], "t string, a array<string>")
    got = row.select(N.words_of(F.col("t")), N.subject_words(F.col("t")), N.identifiers_of(F.col("a")), P.classify(F.col("t"), F.col("a"), F.array()), P.classify(F.lit("the table"), F.col("a"), F.array(F.lit("tableRow")))).first()
    assert got[0] == ["clear", "clearreport_page", "http", "httpserver", "page", "report", "server"]
    assert got[1] == ["Please", "clearReport_page", "HTTPServer"] and "page" in got[2] and got[3] == "precise" and got[4] == "domain"


def test_settings_of_modules():
    files = {
        "tsconfig.json": '{ /* c */ "extends": "./base", "compilerOptions": { "paths": { "@/*": ["src/*"], }, } } // end',
        "base.json": '{"compilerOptions": {"baseUrl": "web", "paths": {"@/*": ["old/*"], "~/*": ["lib/*"], "s//x": ["y"]}}}',
        "app/composer.json": '{"autoload": {"psr-4": {"App\\\\": "src/", "App\\\\Deep\\\\": ["d"]}}, "autoload-dev": {"psr-0": {"Old_": "o"}}}',
        "bad/tsconfig.json": "{",
    }
    got = R.read_settings(files)
    assert dict(got.aliases) == {"@/*": ("web/src/*",), "~/*": ("web/lib/*",), "s//x": ("web/y",)} and got.bases == ("web",)
    assert got.prefixes[0] == ("App\\Deep\\", ("app/d",)) and dict(got.prefixes)["App\\"] == ("app/src",)
    assert json.loads(R.strip_json_comments('{"a": "//x", /* , */ "b": [1,],}')) == {"a": "//x", "b": [1]}


def test_modules_to_files(spark):
    known = ["a/x.ts", "a/y/index.ts", "web/src/z.vue", "pkg/__init__.py", "pkg/m.py", "src/top.py", "app/src/M/U.php", "a/built.tsx"]
    files = spark.createDataFrame([(p, "php" if p.endswith("php") else "python" if p.endswith("py") else "typescript") for p in known], "path string, language string")
    settings = R.ModuleSettings((("@/*", ("web/src/*",)),), ("web",), (("App\\", ("app/src",)),))
    asked = [("a/x.ts", "./y", 0), ("a/x.ts", "@/z", 0), ("a/x.ts", "src/z", 0), ("a/x.ts", "react", 0), ("a/x.ts", "./built.js", 0), ("pkg/m.py", "", 1), ("pkg/m.py", "m", 1), ("pkg/m.py", "top", 0), ("pkg/m.py", "os", 0), ("app/src/M/U.php", "App\\M\\U", 0), ("app/src/M/U.php", "\\Other\\U", 0)]
    got = {(r["path"], r["module"]): r["target_path"] for r in R.resolve_modules(spark.createDataFrame(asked, "path string, module string, relative_level int"), files, settings).collect()}
    assert got == {("a/x.ts", "./y"): "a/y/index.ts", ("a/x.ts", "@/z"): "web/src/z.vue", ("a/x.ts", "src/z"): "web/src/z.vue", ("a/x.ts", "./built.js"): "a/built.tsx", ("pkg/m.py", ""): "pkg/__init__.py", ("pkg/m.py", "m"): "pkg/m.py", ("pkg/m.py", "top"): "src/top.py", ("app/src/M/U.php", "App\\M\\U"): "app/src/M/U.php"}


def test_conventions(spark):
    laravel, vue = V.registered_plugins()
    assert (laravel.name, vue.name) == ("laravel", "vue") and laravel.kinds[0] in ("extends", "include", "view")
    manifests = {"back/composer.json": '{"require": {"laravel/framework": "1"}}', "package.json": '{"dependencies": {"Vue": "3"}}', "x/package.json": "{broken"}
    active = V.active_plugins(manifests)
    assert [(p.name, roots) for p, roots in active] == [("laravel", ["back"]), ("vue", [""])]
    files = spark.createDataFrame([("back/resources/views/users/index.blade.php",), ("back/app/View/Components/Forms/InputGroup.php",), ("src/components/deep/UserCard.vue",), ("src/pages/UserCard.vue",)], "path string")
    asked = [("back/a.php", "users.index", "view", "php"), ("back/b.blade.php", "x-forms.input-group", "component", "blade"), ("src/App.vue", "user-card", "component", "vue"), ("src/App.vue", "q-btn", "component", "vue"), ("back/a.php", "pkg::x", "view", "php"), ("back/a.php", "gone", "view", "php")]
    got = {r["name"]: r["target_path"] for r in V.convention_targets(spark.createDataFrame(asked, "path string, name string, kind string, language string"), files, active).collect()}
    assert got == {"users.index": "back/resources/views/users/index.blade.php", "x-forms.input-group": "back/app/View/Components/Forms/InputGroup.php", "user-card": "src/components/deep/UserCard.vue"}
    for bad in ("{", "[]", '{"name": ""}', '{"name": "x", "rules": [{"kinds": ["a"]}]}', '{"name": "x", "detect": [{"file": "f"}]}', '{"name": "x", "rules": [{"kinds": ["a"], "candidates": [{"under": "u"}]}]}'):
        with pytest.raises(V.ConventionError):
            V.load_framework(bad)
    assert V.dig({"a": {"b": 1}}, "a.b") == 1 and V.dig({"a": 1}, "a.b") is None


# selection and graph


def test_greedy_choice_equals_trying_everything():
    r = random.Random(9)
    for _ in range(60):
        n = r.randint(1, 14)
        entries = sorted((S.Entry(f"s{i}", f"f{r.randint(0, 2)}", i, "x" * r.randint(1, 40), r.random(), f"s{r.randrange(i)}" if i and r.random() < 0.4 else None) for i in range(n)), key=lambda e: -e.score)
        held = {e.id: e for e in entries}
        budget = r.randint(5, 120)
        line = lambda e: S.estimate_text(f"{e.line + 1:>5}  {e.signature}\n")
        taken, files, left = {}, {}, budget
        passed: set[str] = set()
        while True:
            options = []
            for i, e in enumerate(entries):
                if e.id in taken or e.id in passed:
                    continue
                need, at = [e], e.container_id
                while at in held and at not in taken:
                    need.append(held[at])
                    at = held[at].container_id
                cost = sum(map(line, need)) + (0 if e.path in files else S.estimate_text(f"{e.path}:\n") + 1)
                options.append((-e.score / (files.get(e.path, 0) + 1) ** 0.5 / cost, i, e, need, cost))
            if not options or left <= 0:
                break
            _, _, e, need, cost = min(options, key=lambda x: x[:2])
            if cost > left:
                passed.add(e.id)
                continue
            taken |= {x.id: x for x in need}
            files[e.path] = files.get(e.path, 0) + 1
            left -= cost
        got = {e.id for e in S.choose(entries, held, budget)}
        worth = lambda ids: sum(held[i].score for i in ids)
        # Costs fall when a container is shown, so that keys are not always bounds: the choice is as good, if not the same.
        assert got == set(taken) or worth(got) >= 0.8 * worth(taken)


def test_walks_in_arrays_and_by_joins_agree(spark):
    r = random.Random(2)
    syms = spark.createDataFrame([symbol(f"n{i}", line=i, kind=r.choice(["class", "method", "field"])) for i in range(40)], SYMBOLS)
    edges = spark.createDataFrame([edge(f"n{r.randrange(40)}", f"n{r.randrange(40)}", r.choice(["calls", "contains"])) for _ in range(90)], EDGES)
    w = G.graph_weights(syms, edges)
    a = {x["id"]: x["score"] for x in G.pagerank(syms, w, ["n3"], iterations=6).collect()}
    b = {x["id"]: x["score"] for x in G.pagerank(syms, w, ["n3"], iterations=6, most_local=0).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a) and abs(sum(a.values()) - 1) < 1e-9
    c = {x["id"]: x["score"] for x in G.pagerank(syms, w).collect()}
    d = {x["id"]: x["score"] for x in G.pagerank(syms, w, most_local=0).collect()}
    assert all(abs(c[k] - d[k]) < 1e-9 for k in c)


def test_spans(spark):
    r = random.Random(5)
    rows = [(f"s{i}", lo := r.randrange(300), lo + r.randrange(1, 200)) for i in range(60)]
    scopes = spark.createDataFrame([("p", *x) for x in rows], "path string, id string, lo int, hi int")
    points = spark.createDataFrame([("p", i, r.randrange(320), f"s{i}") for i in range(80)], "path string, point int, at int, own string")
    for exclude in (None, "own"):
        got = {x["point"]: x["id"] for x in L.innermost(scopes, points, exclude=exclude).collect()}
        for x in points.collect():
            near = [(-lo, hi, i) for i, lo, hi in rows if lo <= x["at"] < hi and not (exclude and i == x["own"])]
            assert got.get(x["point"]) == (min(near)[2] if near else None)
    reach = [x["reach"] for x in L.reach(scopes).orderBy("lo", F.desc("hi")).collect()]
    assert reach == sorted(reach)


def test_chains_of_many_levels(spark):
    syms = spark.createDataFrame([symbol(f"n{i}", line=i, up=f"n{i - 1}" if i else None, kind="class" if i == 0 else "method") for i in range(25)], SYMBOLS)
    assert [(x["id"], x["depth"]) for x in G.descendants(syms, "n0").collect()] == [(f"n{i}", i) for i in range(1, 25)]
    assert [x["depth"] for x in L.file_outline(syms, "a.py").collect()] == list(range(25))


# documents, facts, indexes of others


def test_documents(spark):
    syms = spark.createDataFrame([symbol("a", "lib/core.py", line=2, end=9), symbol("b", "lib/core.py", line=20, end=30), symbol("c", "web/core.ts")], SYMBOLS)
    files = spark.createDataFrame([("lib/core.py",), ("web/core.ts",), ("x/util.py",), ("y/util.py",)], "path string")
    text = "`lib/core.py` `core.py:3-9` `core.py:12-18`\r\n`core.py:900` `util.py` `gone.py:1` core.py:5 `core.ts:1`"
    found = D.check_claims(D.claims(spark.createDataFrame([("d", text)], "document string, text string")), files, syms)
    got = [(r["line"], r["path"], r["start"], r["status"]) for r in found.orderBy("line", "ordinal").collect()]
    assert got == [(1, "lib/core.py", None, "ok"), (1, "core.py", 3, "ok"), (1, "core.py", 12, "stale"), (2, "core.py", 900, "stale"), (2, "util.py", None, "ambiguous"), (2, "gone.py", 1, "unindexed"), (2, "core.ts", 1, "ok")]
    assert D.claim_report(found).first().asDict() == {"claims": 7, "ok": 3, "stale": 2, "unindexed": 1, "ambiguous": 1}


def test_type_facts(spark, tmp_path):
    source = b"<?php\nclass A {\n  function f() { $this->g(); }\n  function g() {}\n}\n"
    at = lambda word, n=0: [i for i in range(len(source)) if source.startswith(word, i)][n]
    root = "/src"
    rows = [
        {"kind": "def", "path": "/src/a.php", "line": 1, "start": at(b"A {"), "end": at(b"A {") + 1, "name": "A", "fqn": "A", "symbol_kind": "class"},
        {"kind": "def", "path": "/src/a.php", "line": 3, "start": at(b"g()", 1), "end": at(b"g()", 1) + 1, "name": "g", "fqn": "A::g", "symbol_kind": "method"},
        {"kind": "call", "path": "/src/a.php", "line": 2, "start": at(b"g()"), "end": at(b"g()") + 1, "name": "g", "resolved": True, "class": "A", "file": "/src/a.php"},
        {"kind": "call", "path": "/src/a.php", "line": 2, "start": 0, "name": "zz", "resolved": False},
        {"kind": "new", "path": "/src/a.php", "line": 2, "start": at(b"$this"), "name": "A", "resolved": True, "class": "A"},
        {"kind": "call", "path": "/src/a.php", "line": 2, "name": "x", "resolved": True, "class": "Vendor", "file": "/vendor/v.php"},
        {"kind": "call", "path": "/elsewhere/b.php", "line": 2, "name": "x", "resolved": True},
    ]
    p = tmp_path / "f.jsonl"
    p.write_text("\n".join(map(json.dumps, rows)) + "\n\n[1]\n")
    facts = sources.read_facts(spark, str(p))
    contents = spark.createDataFrame([("a.php", source)], "path string, content binary")
    syms = spark.createDataFrame([symbol("a.php#A", "a.php", "A", "class", 1, 4), symbol("a.php#A.f", "a.php", "f", "method", 2, up="a.php#A"), symbol("a.php#A.g", "a.php", "g", "method", 3, up="a.php#A")], SYMBOLS)
    none = spark.createDataFrame([], EDGES)
    sites = X.enrich(facts, contents, syms, none, root)
    said = X.enrichment_report(sites).first().asDict()
    assert said["sites"] == 4 and said["added"] == 2 and said["unresolved"] == 1 and said["outside_index"] == 1
    new = X.enriched_edges(sites)
    assert {(r["src_id"], r["dst_id"], r["kind"], r["site_start_line"]) for r in new.collect()} == {("a.php#A.f", "a.php#A.g", "calls", 2), ("a.php#A.f", "a.php#A", "calls", 2)}
    assert X.enrichment_report(X.enrich(facts, contents, syms, new, root)).first()["already_known"] == 2
    assert [tuple(r) for r in X.unresolved_names(facts).collect()] == [("zz", 1)] and X.top_files(sites).first()["added"] == 2
    s, e = X.facts_snapshot(facts, contents, root)
    assert {r["name"] for r in s.filter("not is_synthetic").collect()} == {"A", "g"} and e.count() == 2
    p.write_text("{broken\n")
    with pytest.raises(Exception, match="not JSON"):
        sources.read_facts(spark, str(p)).collect()


INDEX = {
    "metadata": {"toolInfo": {"name": "t", "version": "1"}, "projectRoot": "file:///p"},
    "documents": [
        {"relativePath": "a.py", "language": "python", "positionEncoding": "UTF8CodeUnitOffsetFromLineStart", "occurrences": [{"range": [0, 6, 9], "symbol": "s m p v A#", "symbolRoles": 1, "enclosingRange": [0, 0, 5, 0]}, {"range": [1, 8, 11], "symbol": "s m p v A#run().", "symbolRoles": 1, "enclosingRange": [1, 4, 3, 0]}, {"range": [2, 8, 9], "symbol": "s m p v `b x`/f().", "symbolRoles": 8}, {"range": [2, 20, 21], "symbol": "local 1", "symbolRoles": 1}],
         "symbols": [{"symbol": "s m p v A#", "displayName": "A", "documentation": ["Doc."], "relationships": [{"symbol": "s m p v `b x`/f().", "isImplementation": True}]}]},
        {"relativePath": "b.py", "language": "python", "occurrences": [{"range": [0, 4, 5], "symbol": "s m p v `b x`/f().", "symbolRoles": 1}, {"range": [5, 0, 5, 1], "symbol": "s m p v A#", "symbolRoles": 2}, {"range": [6, 0, 1], "symbol": "s m p v gone/f().", "symbolRoles": 0}], "symbols": []},
    ],
}


def encoded(index) -> bytes:
    f, p, m = wire.write_field, wire.write_packed, wire.write_message
    docs = []
    for d in index["documents"]:
        occurrences = [m(p(1, o["range"]), f(2, o["symbol"]), f(3, o["symbolRoles"]), p(7, o["enclosingRange"]) if "enclosingRange" in o else b"") for o in d["occurrences"]]
        symbols = [m(f(1, s["symbol"]), f(6, s["displayName"]), *(f(3, x) for x in s["documentation"]), *(f(4, m(f(1, r["symbol"]), f(3, 1))) for r in s["relationships"])) for s in d["symbols"]]
        docs.append(m(f(1, d["relativePath"]), *(f(2, o) for o in occurrences), *(f(3, s) for s in symbols), f(4, d["language"]), f(6, 1) if "positionEncoding" in d else b""))
    return m(f(1, m(f(2, m(f(1, "t"), f(2, "1"))), f(3, "file:///p"))), *(f(2, d) for d in docs))


def test_scip(spark, tmp_path):
    (tmp_path / "i.scip").write_bytes(encoded(INDEX))
    (tmp_path / "i.json").write_bytes(b"\xff\xfe" + json.dumps(INDEX).encode("utf-16-le"))
    one, two = (scip.read_scip(spark, str(tmp_path / n)) for n in ("i.scip", "i.json"))
    assert scip.cross_check(one, two).collect() == []
    symbols = {r["id"]: r for r in one[0].collect()}
    assert symbols["s m p v A#run()."]["kind"] == "method" and symbols["s m p v A#"]["documentation"] == "Doc." and symbols["local 1"]["is_local"]
    edges = {(r["src_id"], r["dst_id"], r["kind"], r["site_path"]) for r in one[1].collect()}
    assert edges == {("s m p v A#run().", "s m p v `b x`/f().", "references", "a.py"), ("module b.py", "s m p v A#", "imports", "b.py"), ("s m p v A#", "s m p v `b x`/f().", "implements", None)}
    assert scip.encoding_of_index(scip.read_documents(spark, str(tmp_path / "i.scip"))) == "utf-8"
    report = C.compare_snapshots(one, two, options=C.CompareOptions(resamples=50))
    assert report.definitions["f1"] == 1 and report.references["f1"] == 1 and "definitions" in report.to_markdown() and json.loads(report.to_json())["compared_paths"] == 2
    assert C.failing(report, {"definitions": 0.9}) == []
    fewer = (two[0], two[1].filter("kind <> 'imports'"))
    worse = C.compare_snapshots(one, fewer, options=C.CompareOptions(resamples=50))
    assert worse.references["fp"] == 1 and C.failing(worse, {"references": 0.99})


def test_scip_names():
    n = scip.parse_symbol("scip-ts npm pkg  name 1.0 src/`a``b.ts`/C#`<constructor>`().")
    assert (n.scheme, n.package, n.version, n.kind, n.name) == ("scip-ts", "pkg name", "1.0", "constructor", "<constructor>")
    assert n.descriptors == ("src/", "`a``b.ts`/", "C#", "`<constructor>`().") and scip.parse_symbol("s m p v A#f(+1).").kind == "method"
    assert [scip.parse_symbol(f"s m p v {d}").kind for d in ("x.", "A#x.", "m!", "A#[T]", "A#f().(p)", "k:")] == ["variable", "field", "macro", "parameter", "parameter", "unknown"]
    assert scip.roles_of("Definition, Import") == 3 and scip.roles_of(["import", 8]) == 10 and scip.roles_of(True) == 1
    with pytest.raises(scip.ScipError):
        scip.parse_symbol("")
    for bad in (b"\x80", b"\x0a\xff", b"\x00\x01"):
        with pytest.raises(scip.ScipError):
            list(scip.binary_documents(bad))
    assert wire.read_varint(wire.write_varint(300), 0) == (300, 2)


# replays


def test_replay(spark, tmp_path):
    assert P.parse_locations('Sure: ["./a/b.py:3", "c.py", "a/b.py:3"]') == [("a/b.py", 3), ("c.py", None)]
    assert P.parse_locations("1. `a/b.py:7`\n- no location\n") == [("a/b.py", 7)]
    assert P.map_entries("a.py:\n    3  def f\n\nb.py:\n   12  x\n") == ({("a.py", 3), ("b.py", 12)}, {"a.py", "b.py"})
    assert P.printed_hits("a/b.py:3: x\nc/d.ts\n") == ({("a/b.py", 3)}, {"a/b.py", "c/d.ts"})
    diff = spark.createDataFrame([("a.py", "@@ -3 +3,2 @@ x\n-a\n@@ -10,2 +12 @@\n@@ -20,0 +21 @@\n")], "path string, text string")
    assert sorted(r["line"] for r in P.changed_lines(diff).collect()) == [3, 10, 11]
    assert P.diff_of("a\nb\nc", "f", 2, 1).splitlines()[3:] == ["@@ -1,3 +1,3 @@", " a", "-b", "+b", " c"]
    assert P.parse_hook({"tool_name": "Grep", "tool_input": {"pattern": "run"}, "tool_response": None}) == {"pattern": "run", "response": ""}
    assert P.parse_hook({"tool_name": "Grep", "tool_input": {"pattern": "a b"}}) is None and P.run_hook("nonsense", None) == ""
    syms = spark.createDataFrame([symbol("f", "a.py", "go", line=1, end=3), symbol("g", "b.py", "go", line=1), symbol("h", "a.py", "clearReport", line=9)], SYMBOLS)
    uses = spark.createDataFrame([("c.py", i, "a.py", 1) for i in range(4)] + [("a.py", 1, "a.py", 1)], "site_path string, site_start_line int, target_path string, target_start_line int")
    texts = spark.createDataFrame([("c.py", "go go gone go"), ("d.py", "go")], "path string, text string")
    task = P.select_tasks(syms, uses, texts, min_external=1).collect()
    assert [(r["id"], r["sites"], r["collisions"], r["grep_lines"]) for r in task] == [("f", 4, 2, 4)]
    assert {(r["word"], r["n"]) for r in P.word_selectivity(syms).collect()} == {("report", 1), ("clear", 1), ("clearreport", 1)}
    prompts = spark.createDataFrame([("p", "clear the report page", ["clearReport"])], "key string, text string, answer array<string>")
    assert {r["word"] for r in P.revealing(prompts, P.word_selectivity(syms)).collect()} == {"clear", "report"}
    (tmp_path / "run.jsonl").write_text('{"type":"assistant","message":{"content":[{"type":"tool_use","name":"Grep"}]}}\nnot json\n{"type":"result","result":"done","num_turns":3,"total_cost_usd":0.5,"is_error":false,"usage":{"input_tokens":7}}\n')
    run = sources.read_transcripts(spark, str(tmp_path / "run.jsonl")).first()
    assert (run["turns"], run["ok"], run["bad_lines"], run["input_tokens"], run["tool_calls"]) == (3, True, 1, 7, {"Grep": 1})
    assert sources.load_prompts('[{"sha": "a", "text": "t", "stratum": "domain"}]')[0]["note"] == ""
    for bad in ("{", "{}", '[{"sha": "a", "text": "t", "stratum": "x"}]', '[{"sha": "", "text": "t", "stratum": "domain"}]'):
        with pytest.raises(sources.FormatError):
            sources.load_prompts(bad)
    files = sources.synthetic_repository(spark, 30).collect()
    assert len({r["path"] for r in files}) == 30 and {r["language"] for r in files} == {"python", "typescript", "php"}


def test_scip_ranges(spark):
    from symloom.functions import spans

    row = spark.createDataFrame([([1, 2, 3],), ([1, 2, 3, 4],), ([1],)], "r array<int>").select(spans.from_scip(F.col("r")).alias("s"))
    got = [tuple(r["s"]) if r["s"] else None for r in row.collect()]
    assert got == [(1, 2, 1, 3), (1, 2, 3, 4), None]
    flat = row.filter("s is not null").select("s.*").select(spans.to_scip().alias("r"))
    assert [list(r["r"]) for r in flat.collect()] == [[1, 2, 3], [1, 2, 3, 4]]
    assert [r[0] for r in spark.createDataFrame([("UTF-16",), ("utf_8",), ("2",), ("x",)], "e string").select(N.encoding_of(F.col("e"))).collect()] == ["utf-16", "utf-8", "utf-16", None]
