"""The command line: build and refresh indexes, ask them, hold them against others. Gates end with code 1."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import index as I
from .extract.stage import language_stats
from .operators import compare as C
from .operators import docs as D
from .operators import enrich as N
from .operators import replay as R
from .operators.select import token_tree
from .session import cut
from .sources import GitRevision, WorkingTree
from .sources import facts as facts_source
from .sources import scip
from .store import IndexStore
from .tools import ToolError, Tools


def session() -> SparkSession:
    return SparkSession.builder.appName("symloom").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="symloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, text: str, store: bool = True) -> argparse.ArgumentParser:
        own = sub.add_parser(name, help=text)
        if store:
            own.add_argument("--store", required=True, help="folder of the stored index")
        return own

    a = add("index", "build or refresh an index")
    a.add_argument("root")
    a.add_argument("--revision", help="index this git revision instead of the files")
    a.add_argument("--full", action="store_true")
    a.add_argument("--max-error-rate", type=float, help="fail if more files than this share do not parse")
    a = add("search", "symbols by a part of their name")
    a.add_argument("query")
    a.add_argument("--kind", action="append", default=[])
    a.add_argument("--limit", type=int, default=20)
    a.add_argument("--cursor")
    a = add("symbol", "one symbol")
    a.add_argument("symbol")
    a.add_argument("--detail", default="detailed", choices=("concise", "detailed", "skeleton"))
    a.add_argument("--body", action="store_true")
    a = add("references", "where a symbol is used")
    a.add_argument("symbol")
    a.add_argument("--min-confidence", type=float, default=0.0)
    a.add_argument("--limit", type=int, default=50)
    a.add_argument("--cursor")
    a = add("neighbours", "what a symbol is connected to")
    a.add_argument("symbol")
    a.add_argument("--direction", default="out", choices=("out", "in", "both"))
    a.add_argument("--depth", type=int, default=1)
    a.add_argument("--kind", action="append", default=[])
    a.add_argument("--min-confidence", type=float, default=0.0)
    a = add("outline", "what a file defines")
    a.add_argument("path")
    a = add("map", "what a repository is built around")
    a.add_argument("--focus", action="append", default=[])
    a.add_argument("--mention", action="append", default=[])
    a.add_argument("--budget", type=int)
    add("status", "what an index covers")
    a = add("tokens", "tokens by folder")
    a.add_argument("--depth", type=int, default=2)
    a.add_argument("--max-total", type=int, help="fail if all files have more tokens")
    a = add("check-docs", "claims of documents about files")
    a.add_argument("documents", nargs="+")
    a = add("compare", "hold an index against one in the SCIP format")
    a.add_argument("oracle")
    a.add_argument("--policy", default="overlap", choices=("exact", "overlap", "line"))
    a.add_argument("--min-f1", type=float, help="fail if definitions or references score lower")
    a.add_argument("--json", action="store_true")
    a = add("verify-oracle", "hold both forms of one SCIP index against each other", store=False)
    a.add_argument("binary")
    a.add_argument("json_dump")
    a = add("enrich", "add edges of a type engine")
    a.add_argument("dump")
    a.add_argument("--root", required=True)
    a.add_argument("--prefix", default="")
    a.add_argument("--dry-run", action="store_true")
    a = add("inspect", "languages, symbols and errors of a folder", store=False)
    a.add_argument("root")
    add("hook", "add resolved uses to a search, from stdin to stdout")
    a = add("bench", "time the index and its tools over a synthetic repository")
    a.add_argument("--files", type=int, default=300)
    a = add("localize", "replay commits and score what maps show")
    a.add_argument("root")
    a.add_argument("--commits", type=int, default=20)
    a = add("calibrate", "set the characters of a token from a table of counted texts")
    a.add_argument("--model", default="")
    a.add_argument("--chars-per-token", type=float)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout) -> int:
    args = parser().parse_args(argv)
    spark = spark or session()
    try:
        text, code = run(args, spark)
    except ToolError as e:
        text, code = f"{e}\n", 2
    out.write(text)
    return code


def run(args: argparse.Namespace, spark: SparkSession) -> tuple[str, int]:
    command = args.command
    if command == "verify-oracle":
        rows = scip.cross_check(scip.read_scip(spark, args.binary), scip.read_scip(spark, args.json_dump)).limit(50).collect()
        return "".join(f"{r['what']} only in the {r['side']}: {r['row']}\n" for r in rows) or "both agree\n", int(bool(rows))
    if command == "inspect":
        _, stats, failures = I.build_snapshot(WorkingTree(spark, args.root))
        lines = [f"{r['language']}: {r['files']} files, {r['symbols']} symbols, {r['refs']} references, {r['error_files']} with errors" for r in stats.orderBy("language").collect()]
        return "\n".join([*lines, *(f"failed: {p}: {e}" for p, e in failures.items())]) + "\n", 0
    store = IndexStore(spark, args.store)
    tools = Tools(store)
    if command == "index":
        tree = GitRevision(spark, args.root, args.revision) if args.revision else WorkingTree(spark, args.root)
        done = I.update_store(store, tree, args.full)
        rates = language_stats(store.files, store.symbols, store.refs).agg(F.sum("error_files").alias("e"), F.sum("files").alias("n")).first()
        rate = (rates["e"] or 0) / max(rates["n"] or 0, 1)
        too_many = args.max_error_rate is not None and rate > args.max_error_rate
        return json.dumps({"changes": done.changes, "scoped": done.scoped, "revisited": done.revisited, "resolution": done.resolution, "generation": done.generation, "error_rate": round(rate, 4), "failures": done.failures}) + "\n", int(too_many)
    if command == "search":
        return tools.search_symbols(args.query, tuple(args.kind), args.limit, args.cursor), 0
    if command == "symbol":
        return tools.get_symbol(args.symbol, args.detail, args.body), 0
    if command == "references":
        return tools.find_references(args.symbol, args.min_confidence, args.limit, args.cursor), 0
    if command == "neighbours":
        return tools.neighbours(args.symbol, args.direction, args.depth, tuple(args.kind), args.min_confidence), 0
    if command == "outline":
        return tools.file_outline(args.path), 0
    if command == "map":
        return tools.repo_map(tuple(args.focus), tuple(args.mention), args.budget), 0
    if command == "status":
        return tools.index_status(), 0
    if command == "tokens":
        n = store.symbols.filter("not is_synthetic").groupBy("path").agg(F.count("*").alias("symbols"))
        files = store.files.join(n, "path", "left").select("path", F.ceil(F.col("size") / tools.chars_per_token).alias("tokens"), F.coalesce("symbols", F.lit(0)).alias("symbols"))
        rows = token_tree(files, args.depth).collect()
        total = rows[0]["tokens"] if rows else 0
        return "".join(f"{'  ' * r['level']}{r['path'] or '.'}  {r['tokens']} tokens, {r['files']} files, {r['symbols']} symbols\n" for r in sorted(rows, key=lambda r: (r["path"].split("/"), r["level"]))), int(args.max_total is not None and total > args.max_total)
    if command == "check-docs":
        texts = [(d, open(d, encoding="utf-8", errors="replace").read()) for d in args.documents]
        checked = cut(D.check_claims(D.claims(spark.createDataFrame(texts, "document string, text string")), store.files, store.symbols))
        said = D.claim_report(checked).first().asDict()
        bad = checked.filter("status <> 'ok'").orderBy("status", "document", "line", "ordinal").limit(200).collect()
        return json.dumps(said) + "\n" + "".join(f"{r['status']}: {r['document']}:{r['line']}  {r['path']}: {r['why']}\n" for r in bad), int(said["stale"] + said["unindexed"] > 0)
    if command == "compare":
        report = C.compare_snapshots((store.symbols, store.edges), scip.read_scip(spark, args.oracle), None, C.CompareOptions(policy=args.policy))
        low = C.failing(report, {"definitions": args.min_f1, "references": args.min_f1}) if args.min_f1 is not None else []
        return (report.to_json() if args.json else report.to_markdown()) + "".join(f"{x}\n" for x in low), int(bool(low))
    if command == "enrich":
        facts = facts_source.read_facts(spark, args.dump)
        contents = WorkingTree(spark, args.root)
        read = contents.contents(contents.listing()).withColumn("path", F.concat(F.lit(f"{args.prefix.strip('/')}/" if args.prefix.strip("/") else ""), F.col("path")))
        sites = cut(N.enrich(facts, read, store.symbols, store.edges, contents.root, args.prefix))
        if not args.dry_run:
            with store.transaction() as t:
                t.add_edges(N.enriched_edges(sites))
                t.replace_ranks(I.rank_rows(t.read("symbols"), t.read("edges")))
        return json.dumps(N.enrichment_report(sites).first().asDict()) + "\n", 0
    if command == "hook":
        return R.run_hook(sys.stdin.read(), tools), 0
    if command == "bench":
        return json.dumps(bench(spark, store, args.files)) + "\n", 0
    if command == "localize":

        def build(revision: str) -> Tools:
            at = IndexStore(spark, f"{args.store}/{revision}")
            I.update_store(at, GitRevision(spark, args.root, revision))
            return Tools(at)

        arms = {"plain": lambda t, w: t.repo_map(budget=2000), "steered": lambda t, w: t.repo_map(mention=w, budget=2000)}
        rows = R.run_localize(spark, args.root, build, arms, args.commits)
        means = rows.groupBy("arm").agg(F.avg("symbol_recall").alias("symbol_recall"), F.avg("file_recall").alias("file_recall"), F.count("*").alias("commits")).orderBy("arm").collect()
        return "".join(f"{r['arm']}: symbols {r['symbol_recall']:.3f}, files {r['file_recall']:.3f}, {r['commits']} commits\n" for r in means), 0
    if args.chars_per_token is None:
        raise ToolError("give --chars-per-token, or call Tools.calibrate with a function that counts a model's tokens")
    with store.transaction() as t:
        t.meta |= {"chars_per_token": str(args.chars_per_token), "chars_per_token_model": args.model}
    return f"{args.chars_per_token} characters a token\n", 0


class SyntheticTree(WorkingTree):
    """A synthetic repository as a tree, with one file touched if asked for."""

    def __init__(self, spark: SparkSession, n: int, touched: bool = False):
        rows = facts_source.synthetic_repository(spark, n).withColumn("content", F.concat("content", F.when(F.lit(touched) & F.col("path").endswith("mod0.py"), "\n# touched\n").otherwise("")))
        self.spark, self.rows = spark, cut(rows)

    def listing(self):
        return self.rows.select("path", F.octet_length("content").cast("long").alias("size"), F.lit(None).cast("long").alias("mtime_ns"))

    def contents(self, paths):
        return self.rows.select("path", F.col("content").cast("binary").alias("content")).join(paths.select("path").distinct(), "path", "left_semi")

    def provenance(self) -> dict[str, str]:
        return {"source": "synthetic"}


def bench(spark: SparkSession, store: IndexStore, n: int) -> dict:
    """Seconds of a cold build, a refresh without and with one changed file, and of every tool, first and again."""
    out: dict[str, float] = {}

    def timed(name: str, call):
        start = time.perf_counter()
        got = call()
        out[name] = round(time.perf_counter() - start, 3)
        return got

    timed("cold", lambda: I.update_store(store, SyntheticTree(spark, n), True))
    timed("unchanged", lambda: I.update_store(store, SyntheticTree(spark, n)))
    timed("touched", lambda: I.update_store(store, SyntheticTree(spark, n, True)))
    tools = Tools(store)
    best = store.ranks.orderBy(F.desc("in_degree"), "symbol_id").first()["symbol_id"]
    path = best.split("#")[0]
    for again in ("", "_again"):
        for name, call in (("repo_map", lambda: tools.repo_map(budget=2000)), ("search_symbols", lambda: tools.search_symbols("er")), ("get_symbol", lambda: tools.get_symbol(best)), ("find_references", lambda: tools.find_references(best)), ("neighbours", lambda: tools.neighbours(best, "both")), ("file_outline", lambda: tools.file_outline(path)), ("index_status", tools.index_status)):
            timed(name + again, call)
    return {"files": n, "seconds": out}


if __name__ == "__main__":
    sys.exit(main())
