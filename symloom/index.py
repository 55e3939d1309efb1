"""Building an index and keeping it up: list, read what changed, extract, resolve what that touches, rank, publish."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .extract import LANGUAGES
from .extract.stage import digest_udf, extract, language_stats, relations
from .operators import conventions, upkeep
from .operators.graph import derive_inheritance, graph_weights, pagerank, ranked
from .operators.modules import read_settings
from .operators.resolve import contains_edges, edges_of, resolution_rate, resolve
from .schema import CONVENTION_KINDS, EDGES, SCHEMA_VERSION
from .session import cut
from .sources.tree import Tree
from .store import IndexStore, Transaction

#: Above this many bytes a file is read by its own, whatever the batch size is.
RANK_DIGITS = 12


def toolchain() -> str:
    """Changes with whatever decides what an index holds: the layout, the parsers, the rules of frameworks."""
    here = Path(__file__).parent
    h = hashlib.blake2b(digest_size=16)
    h.update(str(SCHEMA_VERSION).encode())
    for p in sorted([*(here / "extract").glob("*.py"), here / "schema.py", *(here / "operators").glob("re*.py"), here / "operators" / "modules.py"]):
        h.update(p.read_bytes())
    for plugin in conventions.registered_plugins():
        h.update(repr((plugin.name, plugin.rules, plugin.returns_receiver)).encode())
    h.update(" ".join(sorted(LANGUAGES)).encode())
    return h.hexdigest()


@dataclass
class UpdateResult:
    """What an update did."""

    changes: dict[str, int] = field(default_factory=dict)
    failures: dict[str, str] = field(default_factory=dict)
    scoped: bool = False
    revisited: int = 0
    resolution: dict = field(default_factory=dict)
    generation: int = 0


def _modules(symbols: DataFrame) -> DataFrame:
    return symbols.filter("is_synthetic and kind = 'module'").select(F.col("path").alias("module_path"), F.col("id").alias("module_id"))


def rank_rows(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows of the ranks relation; rounded, so that two builds of one index agree."""
    weights = cut(graph_weights(symbols, edges))
    scores = pagerank(symbols, weights)
    return ranked(symbols, weights, scores).select("symbol_id", F.round("score", RANK_DIGITS).alias("score"), "in_degree")


def detect_changes(store: IndexStore, tree: Tree, full: bool = False) -> tuple[DataFrame, DataFrame]:
    """((path, status), listing): sizes and times first; files that these do not settle are read for their digest."""
    listing = cut(tree.files())
    known = store.table("files").select("path", "digest", "size", "mtime_ns")
    o = known.select("path", F.col("size").alias("_s"), F.col("mtime_ns").alias("_t"))
    unsettled = listing.join(o, "path").filter(~F.coalesce((F.col("size") == F.col("_s")) & (F.col("mtime_ns") == F.col("_t")), F.lit(False))).select("path")
    digests = tree.contents(unsettled).select("path", digest_udf("content").alias("digest"))
    now = listing.join(digests, "path", "left").select("path", "digest", "size", "mtime_ns")
    return cut(upkeep.change_set(known, now, full)), listing


def update_store(store: IndexStore, tree: Tree, full: bool = False) -> UpdateResult:
    """Bring the store to the state of the tree; what did not change is neither read nor resolved again."""
    result = UpdateResult()
    version = toolchain()
    full = full or store.meta("toolchain") != version
    changes, listing = detect_changes(store, tree, full)
    result.changes = upkeep.change_report(changes).first().asDict()
    touched = changes.filter("status in ('added', 'modified')").select("path")
    moved = changes.filter("status in ('added', 'removed')").select("path")
    removed = changes.filter("status = 'removed'").select("path")
    manifests = tree.manifests()
    active = conventions.active_plugins(manifests)
    plugins = ",".join(sorted(p.name for p, _ in active))
    layout = hashlib.blake2b(json.dumps(sorted(manifests.items())).encode(), digest_size=16).hexdigest()
    moved_any = any(result.changes[k] for k in ("added", "modified", "removed"))
    if not moved_any and store.meta("plugins") == plugins and store.meta("layout") == layout:
        result.generation = store.generation
        return result

    was_empty = store.is_empty
    extracted = cut(extract(tree.contents(touched).join(listing.select("path", "language"), "path")))
    result.failures = {r["path"]: r["failure"] for r in extracted.filter("failure is not null").select("path", "failure").limit(1000).collect()}
    fresh = relations(extracted, listing)
    stale = cut(touched.unionByName(removed))
    before = store.table("symbols")
    with store.transaction() as t:
        t.put_files({n: cut(df) for n, df in fresh.items()}, stale)
        result.scoped = not (full or was_empty or store.meta("plugins") != plugins or store.meta("layout") != layout)
        settings = read_settings(manifests)
        if result.scoped:
            names = cut(upkeep.changed_names(before, t.read("symbols")))
            _resolve_scoped(t, stale, names, moved, settings, active, result)
        else:
            _resolve_all(t, settings, active, result)
        t.replace_ranks(rank_rows(t.read("symbols"), t.read("edges")))
        t.meta |= {"toolchain": version, "plugins": plugins, "layout": layout, **tree.provenance()}
    result.generation = store.generation
    return result


def _resolved(t: Transaction, refs: DataFrame, settings, active, result: UpdateResult, base_refs: DataFrame | None = None) -> DataFrame:
    done = resolve(refs, t.read("symbols"), t.read("files"), t.read("imports"), t.read("import_bindings"), settings, active, base_refs)
    result.resolution = resolution_rate(done).first().asDict()
    result.revisited = sum(result.resolution[k] for k in ("resolved", "external", "unresolved"))
    return edges_of(done, _modules(t.read("symbols")))


def _derived(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Derived edges as rows of the relation: they have no site."""
    found = derive_inheritance(symbols, edges)
    null = {f.name: F.lit(None).cast(f.dataType) for f in EDGES.fields if f.name.startswith("site_")}
    return found.withColumns(null).select(*EDGES.names)


def _resolve_all(t: Transaction, settings, active, result: UpdateResult) -> None:
    symbols = t.read("symbols")
    edges = cut(_resolved(t, t.read("refs"), settings, active, result).unionByName(contains_edges(symbols)).select(*EDGES.names))
    t.replace_edges(edges.unionByName(_derived(symbols, edges)))


def _resolve_scoped(t: Transaction, stale: DataFrame, names: DataFrame, moved: DataFrame, settings, active, result: UpdateResult) -> None:
    """Resolve what a change can touch: references in changed files, of changed names, those that a moved file may answer, and those whose receiver may have another type now."""
    refs, symbols = t.read("refs"), t.read("symbols")
    asked = cut(_touched_refs(refs, t, stale, names, moved))
    edges = _resolved(t, asked, settings, active, result, refs.filter("kind = 'class'"))
    ours = contains_edges(symbols.join(stale, "path", "left_semi"))
    new = cut(edges.unionByName(ours).select(*EDGES.names))
    t.delete_edges_in(stale)
    places = asked.join(stale, "path", "left_anti").select("path", "start_line", "start_char")
    kept = t.read("edges")
    at = places.select(F.col("path").alias("site_path"), F.col("start_line").alias("site_start_line"), F.col("start_char").alias("site_start_char")).distinct()
    # Containment has its site at a name, which no reference shares; only what references made goes.
    rest = kept.filter("kind = 'contains'").unionByName(kept.filter("kind <> 'contains'").join(at, at.columns, "left_anti").select(*kept.columns))
    rest = upkeep.without_derived(rest).select(*EDGES.names).unionByName(new)
    whole = cut(rest)
    t.replace_edges(whole.unionByName(_derived(symbols, whole)))


def _touched_refs(refs: DataFrame, t: Transaction, stale: DataFrame, names: DataFrame, moved: DataFrame) -> DataFrame:
    out = upkeep.scoped_refs(refs, stale, names, moved, t.read("edges"))
    # A member depends on the names that its receiver's type was told by, and on what those types extend.
    word = F.regexp_extract_all(F.concat_ws(" ", "receiver", "receiver_type"), F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))
    members = refs.filter("kind in ('call', 'member') and receiver is not null")
    by_type = members.withColumn("_w", F.explode(F.array_distinct(word))).join(names.select(F.col("name").alias("_w")).distinct(), "_w", "left_semi").select(*refs.columns)
    # A file's bases or its imports may lead elsewhere: members reached through types or names are looked up again.
    parts = out.unionByName(by_type)
    if not moved.isEmpty() or not refs.filter("kind = 'class'").join(stale, "path", "left_semi").isEmpty():
        parts = parts.unionByName(members.select(*refs.columns)).unionByName(refs.filter(F.col("kind").isin("scope", *CONVENTION_KINDS)).select(*refs.columns))
    if not moved.isEmpty():
        stems = moved.select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\..*$", "").alias("_m")).distinct()
        parent = moved.select(F.element_at(F.split("path", "/"), -2).alias("_m")).filter("_m is not null")
        bound = t.read("import_bindings").select("path", "import_id", F.col("local").alias("name")).join(t.read("imports").select("path", F.col("id").alias("import_id"), "module"), ["path", "import_id"])
        pieces = bound.select("path", "name", F.explode(F.split("module", r"[./\\]+")).alias("_m")).join(stems.unionByName(parent).distinct(), "_m", "left_semi")
        relative = bound.filter("module = '' or module in ('.', '..')").select("path", "name")
        here = pieces.select("path", "name").unionByName(relative).distinct()
        by_name = refs.join(here, ["path", "name"], "left_semi").select(*refs.columns)
        by_receiver = refs.join(here.withColumnRenamed("name", "receiver"), ["path", "receiver"], "left_semi").select(*refs.columns)
        parts = parts.unionByName(by_name).unionByName(by_receiver)
    return parts.dropDuplicates(["path", "start_line", "start_char", "kind", "name"])


def build_snapshot(tree: Tree) -> tuple[dict[str, DataFrame], DataFrame, dict[str, str]]:
    """All relations of a tree without a store, (language statistics), and the files that failed."""
    listing = cut(tree.files())
    extracted = cut(extract(tree.contents(listing).join(listing.select("path", "language"), "path")))
    out = {n: cut(df) for n, df in relations(extracted, listing).items()}
    manifests = tree.manifests()
    done = resolve(out["refs"], out["symbols"], out["files"], out["imports"], out["import_bindings"], read_settings(manifests), conventions.active_plugins(manifests))
    edges = cut(edges_of(done, _modules(out["symbols"])).unionByName(contains_edges(out["symbols"])).select(*EDGES.names))
    out["edges"] = cut(edges.unionByName(_derived(out["symbols"], edges)))
    out["resolved"] = done
    failures = {r["path"]: r["failure"] for r in extracted.filter("failure is not null").select("path", "failure").limit(1000).collect()}
    return out, language_stats(out["files"], out["symbols"], out["refs"]), failures


__all__ = ["UpdateResult", "build_snapshot", "detect_changes", "rank_rows", "toolchain", "update_store"]
