"""Modules to files: which file of the index an import names, as joins of candidate paths with the known files.

Every resolver makes an ordered array of candidate paths; exploded with their ordinals, they meet the
files in one equi-join, and the first that exists is taken. Settings (aliases, base folders, namespace
prefixes) are read on the driver from manifests, of which a repository has few.
"""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import alias_capture, collapse_path, node_probes, parent, python_probes

NODE_LANGUAGES, PHP_LANGUAGES = ("typescript", "tsx", "javascript", "vue"), ("php", "blade")
PYTHON_ROOTS = ("", "src", "lib")
MOST_PARENTS = 5


@dataclass(frozen=True)
class ModuleSettings:
    """aliases: (pattern, targets) in order; base folders; (prefix, folders), the longest prefix first."""

    aliases: tuple[tuple[str, tuple[str, ...]], ...] = ()
    bases: tuple[str, ...] = ()
    prefixes: tuple[tuple[str, tuple[str, ...]], ...] = ()
    python_roots: tuple[str, ...] = PYTHON_ROOTS


def strip_json_comments(text: str) -> str:
    """JSON with comments and trailing commas -> JSON; what looks like one inside a string stays."""
    kept = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    return re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or "", kept, flags=re.S)


def _json(text: str | None) -> dict:
    try:
        found = json.loads(strip_json_comments(text or ""))
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def _clean(path: str) -> str:
    out = posixpath.normpath(path)
    return "" if out == "." else out.lstrip("/")


def compiler_options(path: str, manifests: Mapping[str, str], depth: int = 0) -> dict:
    """The compiler options of a project file, over those of the files that it extends by a relative path.

    Aliases are joined one by one, the nearer file's win; folders are counted from the file that names them.
    """
    data, folder = _json(manifests.get(path)), posixpath.dirname(path)
    own = data.get("compilerOptions") if isinstance(data.get("compilerOptions"), dict) else {}
    out: dict = {"paths": {}}
    above = data.get("extends")
    for up in [above] if isinstance(above, str) else above if isinstance(above, list) else []:
        if isinstance(up, str) and up.startswith(".") and depth < MOST_PARENTS:
            at = _clean(posixpath.join(folder, up))
            at = at if at.endswith(".json") else f"{at}.json"
            more = compiler_options(at, manifests, depth + 1)
            out["paths"] |= more.pop("paths")
            out |= more
    if isinstance(own.get("baseUrl"), str):
        out["base"] = _clean(posixpath.join(folder, own["baseUrl"]))
    counted = out.get("base", folder) if "baseUrl" in own or "base" in out else folder
    paths = own.get("paths") if isinstance(own.get("paths"), dict) else {}
    for pattern, targets in paths.items():
        if isinstance(targets, list):
            out["paths"][pattern] = tuple(_clean(posixpath.join(counted, t)) for t in targets if isinstance(t, str))
    return out


def read_composer(path: str, manifests: Mapping[str, str]) -> dict[str, tuple[str, ...]]:
    """Namespace prefixes of a composer manifest (psr-4 and psr-0, development ones too) -> folders."""
    data, folder, out = _json(manifests.get(path)), posixpath.dirname(path), {}
    for section in ("autoload", "autoload-dev"):
        for kind in ("psr-4", "psr-0"):
            table = data.get(section, {}).get(kind, {}) if isinstance(data.get(section), dict) else {}
            for prefix, dirs in (table.items() if isinstance(table, dict) else ()):
                dirs = [dirs] if isinstance(dirs, str) else dirs if isinstance(dirs, list) else []
                # A psr-0 folder holds the whole namespace, so that the prefix is a folder below it.
                below = prefix.strip("\\").replace("\\", "/") if kind == "psr-0" else ""
                out[prefix] = out.get(prefix, ()) + tuple(_clean(posixpath.join(folder, d, below)) for d in dirs if isinstance(d, str))
    return out


def read_settings(manifests: Mapping[str, str]) -> ModuleSettings:
    """manifests: path -> text of the project files (tsconfig, jsconfig, composer) of a repository."""
    aliases: dict[str, tuple[str, ...]] = {}
    bases, prefixes = [], {}
    for path in sorted(manifests, key=lambda p: (p.count("/"), p)):
        name = posixpath.basename(path)
        if name in ("tsconfig.json", "jsconfig.json"):
            found = compiler_options(path, manifests)
            for pattern, targets in found["paths"].items():
                aliases[pattern] = tuple(dict.fromkeys(aliases.get(pattern, ()) + targets))
            if "base" in found and found["base"] not in bases:
                bases.append(found["base"])
        elif name == "composer.json":
            for prefix, dirs in read_composer(path, manifests).items():
                prefixes[prefix] = tuple(dict.fromkeys(prefixes.get(prefix, ()) + dirs))
    longest = tuple(sorted(prefixes.items(), key=lambda x: (-len(x[0]), x[0])))
    return ModuleSettings(tuple(aliases.items()), tuple(bases), longest)


def _joined(folder: Column | str, rest: Column) -> Column:
    folder = F.lit(folder) if isinstance(folder, str) else folder
    return collapse_path(F.concat_ws("/", folder, rest))


def node_candidates(module: Column, path: Column, settings: ModuleSettings = ModuleSettings()) -> Column:
    """Relative to the file; else by aliases, then from the base folders."""
    named = [F.array().cast("array<string>")]
    for pattern, targets in settings.aliases:
        got = alias_capture(F.lit(pattern), module)
        for target in targets:
            to = collapse_path(F.replace(F.lit(target), F.lit("*"), F.coalesce(got, F.lit(""))))
            named.append(F.when(got.isNotNull(), node_probes(to)).otherwise(named[0]))
    for base in settings.bases:
        named.append(node_probes(_joined(base, module) if base else module))
    relative = node_probes(_joined(parent(path), module))
    return F.when(F.coalesce(module, F.lit("")) == "", named[0]).when(module.startswith("."), relative).otherwise(F.flatten(F.array(*named)))


def python_candidates(module: Column, path: Column, level: Column, settings: ModuleSettings = ModuleSettings()) -> Column:
    """Leading dots count folders up from the file; without them the module is sought in each root."""
    tail = F.replace(F.coalesce(module, F.lit("")), F.lit("."), F.lit("/"))
    parts = F.split(path, "/")
    base = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - level, F.lit(0))), "/")
    relative = python_probes(collapse_path(F.when(tail == "", base).otherwise(F.concat_ws("/", base, tail))))
    rooted = F.flatten(F.array(*[python_probes(_joined(r, tail) if r else tail) for r in settings.python_roots]))
    return F.when(level > 0, relative).otherwise(rooted)


def php_candidates(module: Column, settings: ModuleSettings = ModuleSettings()) -> Column:
    """By namespace prefixes, the longest first."""
    name = F.regexp_replace(module, r"^\\+|\\+$", "")
    out = [F.array().cast("array<string>")]
    for prefix, folders in settings.prefixes:
        rest = F.replace(F.regexp_replace(F.substring(name, len(prefix) + 1, 1 << 30), r"^\\+|\\+$", ""), F.lit("\\"), F.lit("/"))
        for folder in folders:
            out.append(F.when(name.startswith(prefix) & (rest != ""), F.array(_joined(folder, F.concat(rest, F.lit(".php"))))).otherwise(out[0]))
    return F.flatten(F.array(*out))


def candidates_for(settings: ModuleSettings, language: str = "language", module: str = "module", path: str = "path", level: str = "relative_level") -> Column:
    """Candidates by the language of the file that asks; none for a language without modules."""
    m, p, lang = F.col(module), F.col(path), F.col(language)
    out = F.when(lang == "python", python_candidates(m, p, F.col(level), settings))
    out = out.when(lang.isin(*NODE_LANGUAGES), node_candidates(m, p, settings))
    out = out.when(lang.isin(*PHP_LANGUAGES), php_candidates(m, settings))
    return out.otherwise(F.array().cast("array<string>"))


def first_existing(asked: DataFrame, candidates: Column, files: DataFrame, keys: list[str], out: str = "target_path") -> DataFrame:
    """(keys, target_path) of rows of which a candidate exists: the first that does."""
    tried = asked.select(*keys, F.posexplode(candidates).alias("_n", "_path"))
    known = files.select(F.col("path").alias("_path")).distinct()
    return tried.join(known, "_path", "left_semi").groupBy(*keys).agg(F.min_by("_path", "_n").alias(out))


def resolve_modules(asked: DataFrame, files: DataFrame, settings: ModuleSettings = ModuleSettings()) -> DataFrame:
    """asked(path, module, relative_level) -> (path, module, relative_level, target_path) of modules that are files here."""
    keys = ["path", "module", "relative_level"]
    with_language = asked.select(*keys).distinct().join(files.select("path", "language"), "path")
    return first_existing(with_language, candidates_for(settings), files, keys)


def longest_prefix(asked: DataFrame, prefixes: DataFrame) -> DataFrame:
    """asked(name), prefixes(prefix, folder) -> (name, folder) of the longest prefix of a name; an equi-join on every prefix that a name has at a separator."""
    ends = F.filter(F.sequence(F.lit(1), F.length("name")), lambda i: F.substr("name", i, F.lit(1)).isin("\\", ".", "/", "#"))
    cut = F.transform(F.concat(ends, F.array(F.length("name"))), lambda i: F.substr("name", F.lit(1), i))
    tried = asked.select("name").distinct().select("name", F.explode(F.array_distinct(cut)).alias("prefix"))
    return tried.join(prefixes, "prefix").groupBy("name").agg(F.max_by("folder", F.struct(F.length("prefix"), "folder")).alias("folder"))


__all__ = ["ModuleSettings", "candidates_for", "compiler_options", "first_existing", "longest_prefix", "node_candidates", "php_candidates", "python_candidates", "read_composer", "read_settings", "resolve_modules", "strip_json_comments"]
