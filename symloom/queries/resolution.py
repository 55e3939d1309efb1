"""Queries of resolution: parts as definitions, line items as references, imports made of part numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import compare as C
from ..operators import conventions as V
from ..operators import docs as D
from ..operators import modules as M
from ..operators import replay as P
from ..operators import resolve as R
from ..operators import upkeep as U
from ..schema import CALLABLE, TYPE_LIKE
from ..session import apart
from .base import query

_TYPES, _CALLS = (", ".join(f"'{k}'" for k in ks) for ks in (TYPE_LIKE, CALLABLE))

#: References: every edge names its target from the file of its source; imports: every third part imports another.
REFS = """n AS (SELECT count(*) AS parts FROM part),
refs AS (SELECT DISTINCT s.path, d.name, CASE edge.kind WHEN 'calls' THEN 'call' WHEN 'inherits' THEN 'class' WHEN 'uses_type' THEN 'type' WHEN 'imports' THEN 'import' WHEN 'contains' THEN 'construct' ELSE 'value' END AS kind FROM edge JOIN sym s ON s.id = src_id JOIN sym d ON d.id = dst_id),
imports AS (SELECT CAST(s.id AS BIGINT) AS import_id, s.path, d.name AS local, CASE WHEN CAST(s.id AS BIGINT) % 5 = 0 THEN NULL ELSE d.name END AS original,
  CASE WHEN CAST(s.id AS BIGINT) % 7 = 0 THEN 'pkg.missing' ELSE replace(replace(d.path, '.py', ''), '/', '.') END AS module FROM sym s, n, sym d WHERE CAST(s.id AS BIGINT) % 3 = 0 AND CAST(d.id AS BIGINT) = CAST(s.id AS BIGINT) * 7 % n.parts + 1),
files AS (SELECT DISTINCT path FROM sym),
bound AS (SELECT i.*, f.path AS target_path FROM (SELECT *, row_number() OVER (PARTITION BY path, local ORDER BY import_id) AS k FROM imports) i LEFT JOIN files f ON f.path = concat(replace(module, '.', '/'), '.py') WHERE k = 1)"""

_BEST = f"""pub AS (SELECT *, kind NOT IN ({_TYPES}) AS no_type, kind NOT IN ({_CALLS}) AS no_call, kind IN ('method', 'field') AND name_start_line = full_end_line AS shown, kind = 'function' OR kind IN ({_TYPES}) AS bare FROM sym WHERE NOT is_local AND NOT is_synthetic)"""


def _row(a: str, b: str = "false") -> str:
    return f"struct_pack(a := {a}, b := {b}, p := path, l := name_start_line, i := id)"


def _best(keys: str) -> str:
    return f"""SELECT {keys}, arg_min(id, {_row("no_type")}) AS best_type, arg_min(id, {_row("no_call", "shown")}) AS best_call, arg_min(id, {_row("shown")}) AS best_member, arg_min(id, {_row("false")}) AS best_other,
arg_min(id, {_row("no_call", "shown")}) FILTER (WHERE bare) AS best_bare, count(*) AS n, count(*) FILTER (WHERE bare) AS n_bare FROM pub GROUP BY {keys}"""


@query(f"WITH {_BEST} {_best('name')}")
def prefer_by_name(t):
    return R.preferred(t.symbols, ["name"])


@query(f"WITH {_BEST} {_best('path, name')}")
def prefer_in_file(t):
    return R.preferred(t.symbols, ["path", "name"])


def _tables(t):
    s = t.symbols
    key = F.col("id").cast("long")
    parts = s.count()
    kinds = {"calls": "call", "inherits": "class", "uses_type": "type", "imports": "import", "contains": "construct"}
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("kind")), F.lit("value"))
    src, dst = s.select(F.col("id").alias("src_id"), "path"), s.select(F.col("id").alias("dst_id"), "name")
    refs = t.edges.withColumn("kind", kind).join(apart(src), "src_id").join(apart(dst), "dst_id").select("path", "name", "kind").distinct()
    other = s.select(key.alias("_k"), F.col("name").alias("local"), F.replace(F.replace("path", F.lit(".py"), F.lit("")), F.lit("/"), F.lit(".")).alias("_m"))
    own = s.filter(key % 3 == 0).select(key.alias("id"), "path", (key * 7 % parts + 1).alias("_k")).join(apart(other), "_k")
    module = F.when(F.col("id") % 7 == 0, "pkg.missing").otherwise(F.col("_m"))
    imports = own.select("id", "path", module.alias("module"), F.lit(0).alias("relative_level"))
    bindings = own.select(F.col("id").alias("import_id"), "path", F.lit(0).alias("ordinal"), "local", F.when(F.col("id") % 5 != 0, F.col("local")).alias("original"))
    files = s.select("path").distinct().withColumn("language", F.lit("python"))
    symbols = s.withColumn("full_start_char", F.lit(0)).withColumn("documentation", F.lit(None).cast("string"))
    return refs, symbols, files, imports, bindings


@query(f"WITH {REFS} SELECT DISTINCT path, module, target_path FROM (SELECT DISTINCT i.path, module, f.path AS target_path FROM imports i JOIN files f ON f.path = concat(replace(module, '.', '/'), '.py'))")
def module_probe(t):
    _, _, files, imports, _ = _tables(t)
    return M.resolve_modules(imports, files).select("path", "module", "target_path")


@query(f"WITH {REFS} SELECT path, local AS name, module, original, coalesce(original, local) AS source_name, target_path FROM bound")
def first_bindings(t):
    _, _, files, imports, bindings = _tables(t)
    return R.first_bindings(imports, bindings, M.resolve_modules(imports, files))


_PICK = "CASE WHEN kind IN ('class', 'type') THEN {0}best_type WHEN kind = 'call' THEN {0}best_call ELSE {0}best_other END"
LADDER = f"""{REFS}, {_BEST}, by_name AS ({_best("name")}), in_file AS ({_best("path, name")}),
q AS (SELECT r.path, r.name, r.kind, r.kind = 'call' AS bare, b.module, b.original, b.target_path, {_PICK.format("t.")} AS via, {_PICK.format("a.")} AS any_, {_PICK.format("h.")} AS here,
  CASE WHEN r.kind = 'call' THEN n.best_bare ELSE {_PICK.format("n.")} END AS rest, coalesce(CASE WHEN r.kind = 'call' THEN n.n_bare ELSE n.n END, 0) AS cnt
  FROM (SELECT path, name, kind FROM refs) r LEFT JOIN bound b ON b.path = r.path AND b.local = r.name LEFT JOIN in_file t ON t.path = b.target_path AND t.name = coalesce(b.original, b.local)
  LEFT JOIN by_name a ON a.name = coalesce(b.original, b.local) LEFT JOIN in_file h ON h.path = r.path AND h.name = r.name LEFT JOIN by_name n ON n.name = r.name),
led AS (SELECT *, CASE WHEN target_path IS NOT NULL THEN coalesce(via, CASE WHEN original IS NULL THEN concat(target_path, '#') END, any_) END AS imp FROM q),
rung AS (SELECT *, CASE WHEN imp IS NOT NULL THEN CASE WHEN via IS NULL AND original IS NOT NULL THEN 'import_suffix' ELSE 'import_map' END WHEN (module IS NOT NULL AND target_path IS NULL) OR kind = 'import' THEN 'external'
  WHEN here IS NOT NULL THEN 'same_module' WHEN cnt = 1 THEN 'unique_name' WHEN cnt > 1 THEN 'suffix' ELSE 'unresolved' END AS rung FROM led)"""


def _answers(t):
    refs, symbols, files, imports, bindings = _tables(t)
    mods = files.select(F.concat("path", F.lit("#")).alias("id"), "path", F.lit("module").alias("kind"), F.lit(True).alias("is_synthetic"))
    ix, _ = R.build_index(symbols, files, imports, bindings)
    ix.modules = mods.select(F.col("path").alias("module_path"), F.col("id").alias("module_id"))
    return R.answer(refs.withColumn("bare", F.col("kind") == "call"), ix)


@query(f"""WITH {LADDER} SELECT path, name, kind, CASE WHEN rung LIKE 'import%' THEN imp WHEN rung = 'same_module' THEN here WHEN rung IN ('unique_name', 'suffix') THEN rest END AS target,
CASE WHEN rung IN ('external', 'unresolved') THEN NULL ELSE rung END AS tier, CASE WHEN rung = 'suffix' THEN 'ambiguous' WHEN rung IN ('external', 'unresolved') THEN rung ELSE 'resolved' END AS outcome FROM rung""")
def cascade(t):
    """The ladder of rungs, over every name that a file mentions."""
    return _answers(t).select("path", "name", "kind", "target", "tier", "outcome")


@query(f"""WITH {LADDER} SELECT CASE WHEN rung = 'suffix' THEN 'ambiguous' WHEN rung IN ('external', 'unresolved') THEN rung ELSE 'resolved' END AS outcome, CASE WHEN rung IN ('external', 'unresolved') THEN NULL ELSE rung END AS tier, count(*) AS n FROM rung GROUP BY 1, 2""")
def resolution_stats(t):
    return R.resolution_stats(_answers(t))


@query("""WITH r AS (SELECT DISTINCT src_id, d.name FROM edge JOIN sym d ON d.id = dst_id) SELECT DISTINCT src_id, sym.id AS dst_id FROM r JOIN sym USING (name) WHERE NOT is_local AND NOT is_synthetic AND src_id <> sym.id AND CAST(src_id AS BIGINT) <= 40""")
def name_matched(t):
    names = t.symbols.select(F.col("id").alias("dst_id"), "name")
    refs = t.edges.join(names, "dst_id").select(F.lit("f").alias("path"), "name", F.col("src_id").alias("container_id"))
    found = R.name_matched(refs.filter("cast(container_id as long) <= 40"), t.symbols, t.spark.createDataFrame([], "module_path string, module_id string"))
    return found.select("src_id", "dst_id")


@query("SELECT path AS site_path, container_id AS src_id, id AS dst_id, 'contains' AS kind, 1.0::DOUBLE AS confidence, name_start_line AS site_start_line FROM sym WHERE container_id IN (SELECT id FROM sym)")
def contains_edges(t):
    s = t.symbols.withColumn("name_end_line", F.col("name_start_line"))
    return R.contains_edges(s).select("site_path", "src_id", "dst_id", "kind", "confidence", "site_start_line")


@query("""WITH x AS (SELECT id, CASE CAST(id AS BIGINT) % 4 WHEN 0 THEN 'call' WHEN 1 THEN 'member' WHEN 2 THEN 'value' ELSE 'call' END AS kind,
CASE CAST(id AS BIGINT) % 7 WHEN 0 THEN NULL WHEN 1 THEN '(expression)' WHEN 2 THEN 'self' WHEN 3 THEN 'this.x' WHEN 4 THEN 'User' ELSE 'user' END AS receiver,
CASE CAST(id AS BIGINT) % 5 WHEN 0 THEN 'Type' WHEN 1 THEN 'call:make||' WHEN 2 THEN 'assigned:Type' END AS receiver_type FROM sym)
SELECT id, CASE WHEN kind = 'value' OR receiver IS NULL THEN CASE WHEN kind = 'member' THEN 'expression' ELSE 'none' END WHEN receiver = '(expression)' THEN 'expression' WHEN receiver = 'self' THEN 'self'
WHEN receiver = 'this.x' THEN CASE WHEN receiver_type IS NULL THEN 'property of self (untyped)' WHEN starts_with(receiver_type, 'assigned:') THEN 'property of self (typed by assignment)' ELSE 'property of self (typed)' END
WHEN receiver_type IS NULL THEN CASE WHEN receiver = 'User' THEN 'type' ELSE 'variable (untyped)' END WHEN starts_with(receiver_type, 'call:') THEN 'variable (typed by call)' ELSE 'variable (typed)' END AS shape FROM x""")
def receiver_shapes(t):
    k = F.col("id").cast("long")
    kind = F.when(k % 4 == 1, "member").when(k % 4 == 2, "value").otherwise("call")
    receiver = F.when(k % 7 == 0, None).when(k % 7 == 1, "(expression)").when(k % 7 == 2, "self").when(k % 7 == 3, "this.x").when(k % 7 == 4, "User").otherwise("user")
    typed = F.when(k % 5 == 0, "Type").when(k % 5 == 1, "call:make||").when(k % 5 == 2, "assigned:Type")
    return t.symbols.select("id", N.receiver_shape(kind, receiver, typed).alias("shape"))


@query("""SELECT id, CASE CAST(id AS BIGINT) % 6 WHEN 0 THEN kind WHEN 1 THEN kind WHEN 2 THEN kind WHEN 3 THEN concat('T', name) WHEN 4 THEN 'static' END AS type FROM sym""")
def return_types(t):
    k, kind = F.col("id").cast("long"), F.col("kind")
    said = F.when(k % 6 == 0, F.concat(F.lit("def f(x) -> a."), kind, F.lit(":"))).when(k % 6 == 1, F.concat(F.lit("public function f(int $x): ?\\App\\"), kind)).when(k % 6 == 2, F.concat(F.lit("f(a): Promise<"), kind, F.lit("> {"))).otherwise("def f(x):")
    doc = F.when(k % 6 == 3, F.concat(F.lit("Does.\n@return null|\\App\\T"), F.col("name"), F.lit(" or so"))).when(k % 6 == 4, "@return $this").when(k % 6 == 5, "@return int|null")
    return t.symbols.select("id", N.return_type(said, doc).alias("type"))


@query("""WITH x AS (SELECT id, concat('src/', name, CASE CAST(id AS BIGINT) % 8 WHEN 0 THEN '.PY' WHEN 1 THEN '.tsx' WHEN 2 THEN '.blade.php' WHEN 3 THEN '.phtml' WHEN 4 THEN '.d.ts' WHEN 5 THEN '.Vue' WHEN 6 THEN '.md' ELSE '.mjs' END) AS path FROM sym)
SELECT id, CASE CAST(id AS BIGINT) % 8 WHEN 0 THEN 'python' WHEN 1 THEN 'tsx' WHEN 2 THEN 'blade' WHEN 3 THEN 'php' WHEN 4 THEN 'typescript' WHEN 5 THEN 'vue' WHEN 7 THEN 'javascript' END AS language FROM x""")
def languages_of(t):
    endings = F.array(*map(F.lit, (".PY", ".tsx", ".blade.php", ".phtml", ".d.ts", ".Vue", ".md", ".mjs")))
    path = F.concat(F.lit("src/"), "name", F.get(endings, (F.col("id").cast("long") % 8).cast("int")))
    return t.symbols.select("id", N.language_of(path).alias("language"))


@query("""WITH p(prefix, folder) AS (VALUES ('Brand#1/', 'a'), ('Brand#1/PROMO.', 'b'), ('Brand#2/', 'c'), ('Brand#', 'd')), names AS (SELECT DISTINCT path AS name FROM sym)
SELECT name, arg_max(folder, length(prefix)) AS folder FROM names JOIN p ON starts_with(name, prefix) GROUP BY name""")
def longest_prefixes(t):
    p = t.spark.createDataFrame([("Brand#1/", "a"), ("Brand#1/PROMO.", "b"), ("Brand#2/", "c"), ("Brand#", "d")], "prefix string, folder string")
    return M.longest_prefix(t.symbols.select(F.col("path").alias("name")).distinct(), p)


@query("""SELECT DISTINCT path, CASE WHEN starts_with(path, 'Brand#') AND ends_with(path, '/PROMO.py') THEN substr(path, 7, length(path) - 6 - 9) END AS captured, CASE WHEN path = 'Brand#2/LARGE.py' THEN '' END AS exact FROM sym""")
def alias_match(t):
    p = F.col("path")
    return t.symbols.select("path", N.alias_capture(F.lit("Brand#*/PROMO.py"), p).alias("captured"), N.alias_capture(F.lit("Brand#2/LARGE.py"), p).alias("exact")).distinct()


@query("""WITH p AS (SELECT DISTINCT string_split(path, '/') AS s FROM sym) SELECT DISTINCT array_to_string(s[1:d], '/') AS folder, d AS depth FROM (SELECT s, unnest(range(0, least(len(s) - 1, 2) + 1)) AS d FROM p)""")
def project_folders(t):
    return V.project_folders(t.symbols.select("path")).select("folder", F.col("depth").cast("long").alias("depth"))


@query("""WITH v AS (SELECT path, name FROM sym WHERE CAST(id AS BIGINT) % 2 = 0), f AS (SELECT DISTINCT concat('resources/views/', name, '.blade.php') AS path FROM sym WHERE CAST(id AS BIGINT) % 3 = 0)
SELECT DISTINCT v.path, name, f.path AS target_path FROM v JOIN f ON f.path = concat('resources/views/', name, '.blade.php')""")
def convention_views(t):
    k = F.col("id").cast("long")
    asked = t.symbols.filter(k % 2 == 0).select("path", "name", F.lit("view").alias("kind"), F.lit("php").alias("language"))
    files = t.symbols.filter(k % 3 == 0).select(F.concat(F.lit("resources/views/"), "name", F.lit(".blade.php")).alias("path")).distinct()
    return V.convention_targets(asked, files, [(V.registered_plugins()[0], [""])]).select("path", "name", "target_path")


@query("SELECT DISTINCT name, array_to_string(list_transform(string_split(name, '_'), lambda w: concat(upper(left(w, 1)), substr(w, 2))), '') AS studly FROM sym")
def studly_names(t):
    return t.symbols.select("name", N.studly(F.col("name")).alias("studly")).distinct()


@query("SELECT DISTINCT path, string_split(path, '/')[1] AS up, regexp_replace(concat(path, '/../x/./y'), '[^/]+/[.][.]/x/[.]/y$', 'x/y') AS flat FROM sym")
def path_steps(t):
    p = F.col("path")
    return t.symbols.select("path", N.parent(p).alias("up"), N.collapse_path(F.concat(p, F.lit("/../x/./y"))).alias("flat")).distinct()


_STOP = ", ".join(f"'{w}'" for w in N.SUBJECT_STOP_WORDS)


@query(f"""SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{{2,}}'), lambda w: lower(w) NOT IN ({_STOP})))), ' ') AS words FROM conversations WHERE text IS NOT NULL""", prelude=None)
def subject_words(t):
    return t["conversations"].filter("text is not null").select("conv_id", "turn", F.array_join(F.array_sort(N.subject_words(F.col("text"))), " ").alias("words"))


_CLAIMS = """docs AS (SELECT path AS document, concat('see `', path, ':', name_start_line + 1, '-', full_end_line + 1, '` and', chr(10), '`nothing.py` or `Brand#2`') AS text FROM sym)"""


@query(f"""WITH {_CLAIMS} SELECT document, 1 AS line, regexp_extract(text, '`([A-Za-z0-9_./+-]+[.]py):', 1) AS path FROM docs WHERE regexp_matches(text, '`[A-Za-z0-9_./+-]+[.]py:') UNION ALL SELECT document, 2, 'nothing.py' FROM docs""")
def doc_claims(t):
    text = F.concat(F.lit("see `"), "path", F.lit(":"), F.col("name_start_line") + 1, F.lit("-"), F.col("full_end_line") + 1, F.lit("` and\n`nothing.py` or `Brand#2`"))
    return D.claims(t.symbols.select(F.col("path").alias("document"), text.alias("text"))).select("document", "line", "path")


@query("""WITH c AS (SELECT DISTINCT string_split(path, '/')[-1] AS path FROM sym UNION SELECT 'Brand#2/PROMO.py' UNION SELECT 'gone.py'), f AS (SELECT DISTINCT path AS file FROM sym)
SELECT c.path, CAST(count(*) AS INTEGER) AS n, min(file) AS first FROM c JOIN f ON file = c.path OR ends_with(file, concat('/', c.path)) GROUP BY 1""")
def claim_targets(t):
    claimed = t.symbols.select(N.basename(F.col("path")).alias("path")).distinct().unionByName(t.spark.createDataFrame([("Brand#2/PROMO.py",), ("gone.py",)], "path string"))
    return D.claimed_files(claimed, t.symbols.select("path").distinct()).select("path", F.size("matches").alias("n"), F.col("matches")[0].alias("first"))


@query("""WITH hunk AS (SELECT path, name_start_line + 2 AS line FROM sym WHERE CAST(id AS BIGINT) % 13 = 0) SELECT DISTINCT s.id FROM sym s JOIN hunk l ON l.path = s.path AND l.line - 1 BETWEEN name_start_line AND full_end_line WHERE NOT is_local AND NOT is_synthetic""")
def touched_symbols(t):
    return P.touched_symbols(t.symbols, t.symbols.filter("cast(id as long) % 13 = 0").select("path", (F.col("name_start_line") + 2).alias("line")))


@query("""SELECT DISTINCT kind FROM edge WHERE kind NOT IN (SELECT kind FROM edge WHERE confidence >= 0.99 AND kind <> 'calls')""")
def edge_kinds_unseen(t):
    return C.edge_kind_difference(t.edges, t.edges.filter("confidence >= 0.99 and kind <> 'calls'"))


@query(f"""SELECT s.path, s.name_start_line AS start_line, CASE WHEN s.kind NOT IN ('method', 'field', 'property') THEN 'declaration' WHEN u.kind IS NOT NULL AND u.kind NOT IN ({_TYPES}) THEN 'member of an object literal' ELSE 'member of a type' END AS shape
FROM sym s LEFT JOIN sym u ON u.id = s.container_id WHERE NOT s.is_synthetic""")
def definition_shapes(t):
    own = t.symbols.withColumn("path", F.concat_ws("|", "path", "id"))
    return C.definition_shapes(own).select(F.substring_index("path", "|", 1).alias("path"), "start_line", "shape")


@query("""WITH new AS (SELECT id, name, path, kind, container_id, CASE WHEN CAST(id AS BIGINT) % 17 = 0 THEN concat(signature, '!') ELSE signature END AS signature, is_local FROM sym WHERE NOT is_synthetic AND CAST(id AS BIGINT) % 19 <> 0),
d AS (SELECT DISTINCT name, 0 AS side, concat_ws('|', id, kind, path, coalesce(container_id, ''), signature, is_local) AS r FROM sym WHERE NOT is_synthetic UNION SELECT DISTINCT name, 1, concat_ws('|', id, kind, path, coalesce(container_id, ''), signature, is_local) FROM new),
s AS (SELECT name, r, count(DISTINCT side) AS n FROM d GROUP BY 1, 2) SELECT DISTINCT name FROM s WHERE n = 1""")
def changed_names(t):
    k = F.col("id").cast("long")
    return U.changed_names(t.symbols, t.symbols.filter(k % 19 != 0).withColumn("signature", F.when(k % 17 == 0, F.concat("signature", F.lit("!"))).otherwise(F.col("signature"))))


def _placed(t):
    refs = t.edges.filter("site_path is not null").select(F.col("site_path").alias("path"), F.col("dst_id").alias("name"), "kind", F.col("site_start_line").alias("start_line"), F.col("site_start_char").alias("start_char"))
    return refs.distinct()


_PLACED = "r AS (SELECT DISTINCT site_path AS path, dst_id AS name, kind, site_start_line AS start_line, site_start_char AS start_char FROM edge WHERE site_path IS NOT NULL)"


@query(f"WITH {_PLACED} SELECT DISTINCT path, start_line, start_char FROM r WHERE path IN ('f3.py', 'f4.py') OR name IN ('7', '8', '9') OR kind = 'inherits'")
def union_of_lookups(t):
    make = lambda rows, c: t.spark.createDataFrame([(x,) for x in rows], f"{c} string")
    return U.union_of_lookups(_placed(t), make(["f3.py", "f4.py"], "path"), make(["7", "8", "9"], "name"), ["inherits"]).select("path", "start_line", "start_char")


@query(f"WITH {_PLACED} SELECT DISTINCT path, start_line, start_char, kind, name FROM r WHERE path IN ('f3.py', 'f4.py') OR name IN ('7', '8', '9')")
def scoped_refs(t):
    make = lambda rows, c: t.spark.createDataFrame([(x,) for x in rows], f"{c} string")
    return U.scoped_refs(_placed(t), make(["f3.py", "f4.py"], "path"), make(["7", "8", "9"], "name"), make([], "path")).select("path", "start_line", "start_char", "kind", "name")


@query("SELECT site_path, src_id, dst_id, kind, confidence FROM edge WHERE site_path IS NULL AND kind = 'inherits'")
def derived_edges(t):
    kind = F.col("kind")
    seen = t.edges.withColumn("kind", F.when(kind == "inherits", "implements").otherwise(kind))
    return U.is_derived(seen).select("site_path", "src_id", "dst_id", F.lit("inherits").alias("kind"), "confidence")


@query("SELECT id, contains(name, '-') OR regexp_matches(path, '^[A-Z]') AS component, NOT starts_with(path, '.') AS outer_ FROM sym")
def name_tests(t):
    return t.symbols.select("id", N.is_component_name(F.concat("path", F.when(F.col("name").contains("-"), "-").otherwise(""))).alias("component"), N.is_external(F.col("path")).alias("outer_"))
