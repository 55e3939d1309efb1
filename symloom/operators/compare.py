"""An index held against another, such as a compiler's: what both tell of the same places, scored and explained."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import normalise_path
from ..schema import NAVIGABLE, TYPE_LIKE
from ..session import cut
from . import facts as E
from . import metrics as M

LEAST_SHAPE, BLIND_SHARE = 30, 0.01


@dataclass(frozen=True)
class CompareOptions:
    policy: str = "overlap"
    casefold: bool = False
    compare_kinds: bool = False
    only_oracle_paths: bool = True
    only_oracle_edge_kinds: bool = True
    kinds: tuple[str, ...] = NAVIGABLE
    level: float = 0.95
    resamples: int = 2000
    seed: int = 20260903


@dataclass
class Comparison:
    """The scores, and how much of either side they leave out and why."""

    definitions: dict = field(default_factory=dict)
    references: dict = field(default_factory=dict)
    by_kind: dict[str, dict] = field(default_factory=dict)
    definition_interval: M.Interval | None = None
    reference_interval: M.Interval | None = None
    definition_shapes: list[dict] = field(default_factory=list)
    reference_shapes: list[dict] = field(default_factory=list)
    left_out: dict[str, int] = field(default_factory=dict)
    unscored_edge_kinds: list[str] = field(default_factory=list)
    compared_paths: int = 0
    skipped_paths: int = 0
    calibration: list[dict] = field(default_factory=list)
    calibration_error: dict = field(default_factory=dict)

    def to_json(self) -> str:
        plain = lambda x: vars(x) if isinstance(x, M.Interval) else x
        return json.dumps({k: plain(v) for k, v in vars(self).items()}, indent=2, sort_keys=True)

    def to_markdown(self) -> str:
        """The report as a person reads it."""
        out = ["# Comparison", "", f"{self.compared_paths} files compared, {self.skipped_paths} outside of the other index.", "", "| Facts | tp | fp | fn | precision | recall | F1 | interval |", "| --- | --- | --- | --- | --- | --- | --- | --- |"]
        rows = [("definitions", self.definitions, self.definition_interval), ("references", self.references, self.reference_interval), *((f"- {k}", s, None) for k, s in sorted(self.by_kind.items()))]
        for name, s, interval in rows:
            told = f"{interval.low:.3f} to {interval.high:.3f} ({interval.method})" if interval else ""
            out.append(f"| {name} | {s['tp']} | {s['fp']} | {s['fn']} | {s['precision']:.3f} | {s['recall']:.3f} | {s['f1']:.3f} | {told} |")
        if any(self.left_out.values()) or self.unscored_edge_kinds:
            out += ["", "Not scored:", "", *(f"* {k.replace('_', ' ')}: {n}" for k, n in sorted(self.left_out.items()) if n)]
            out += [f"* kinds of edges that the other index never has: {', '.join(self.unscored_edge_kinds)}"] if self.unscored_edge_kinds else []
        for title, shapes in (("Definitions by shape", self.definition_shapes), ("References by shape of the receiver", self.reference_shapes)):
            if shapes:
                out += ["", f"## {title}", "", "| Shape | here | seen there | scored |", "| --- | --- | --- | --- |", *(f"| {s['shape']} | {s['candidates']} | {s['seen']} | {'no' if s['blind'] else 'yes'} |" for s in shapes)]
        if self.calibration:
            out += ["", "## Calibration", "", f"Expected error {self.calibration_error['ece']:.3f}, largest {self.calibration_error['max_gap']:.3f}, over {self.calibration_error['n']} edges.", "", "| From | to | edges | right | confidence |", "| --- | --- | --- | --- | --- |"]
            out += [f"| {b['low']:g} | {b['high']:g} | {b['count']} | {b['precision']:.3f} | {b['mean_confidence']:.3f} |" for b in self.calibration if b["count"]]
        return "\n".join(out) + "\n"


def definition_shapes(symbols: DataFrame) -> DataFrame:
    """(path, start_line, start_char, shape): whether a member belongs to a type or to something looser."""
    up = symbols.select(F.col("id").alias("container_id"), F.col("kind").alias("_up"))
    loose = F.col("kind").isin("method", "field", "property") & F.col("_up").isNotNull() & ~F.col("_up").isin(*TYPE_LIKE)
    member = F.when(F.col("kind").isin("method", "field", "property"), F.when(loose, "member of an object literal").otherwise("member of a type")).otherwise("declaration")
    own = symbols.filter(~F.col("is_synthetic")).join(up, "container_id", "left")
    return own.select(normalise_path(F.col("path")).alias("path"), F.col("name_start_line").alias("start_line"), F.col("name_start_char").alias("start_char"), member.alias("shape")).dropDuplicates(["path", "start_line", "start_char"])


def without_blind_shapes(facts: DataFrame, shapes: DataFrame, seen: DataFrame, keys: list[str], other: str, always: bool) -> tuple[DataFrame, list[dict]]:
    """Facts but those of shapes that the other index hardly ever has anything for; a shape of few facts is judged. always: judge one shape alone too."""
    labelled = cut(facts.join(shapes, keys, "left").withColumn("shape", F.coalesce("shape", F.lit(other))))
    table = [r.asDict() for r in E.shape_coverage(labelled, seen, keys, LEAST_SHAPE, BLIND_SHARE).orderBy(F.desc("candidates"), "shape").collect()]
    if not always and len(table) < 2:
        return facts, []
    blind = [r["shape"] for r in table if r["blind"]]
    return (labelled.filter(~F.col("shape").isin(blind)) if blind else labelled).drop("shape"), table


def _score(matched: DataFrame, key: str, options: CompareOptions) -> tuple[dict, M.Interval | None]:
    counts = cut(E.by_path(matched, key))
    pooled = M.pooled(counts).first().asDict()
    units = [(r["tp"], r["fp"], r["fn"]) for r in counts.orderBy("path").collect()]  # a row a file, for the report's interval
    return pooled, M.bootstrap_interval(units, M.f1_of, options.resamples, options.seed, options.level) if len(units) > 1 else None


def compare_snapshots(candidate: tuple[DataFrame, DataFrame], oracle: tuple[DataFrame, DataFrame], site_shapes: DataFrame | None = None, options: CompareOptions = CompareOptions()) -> Comparison:
    """candidate and oracle: (symbols, edges); site_shapes(path, start_line, start_char, shape) of the candidate's references."""
    report = Comparison()
    at = lambda df: df.filter("not is_synthetic").select(normalise_path(F.col("path"), options.casefold).alias("path")).distinct()
    theirs, ours = cut(at(oracle[0])), cut(at(candidate[0]))
    both = ours.join(theirs, "path", "left_semi").count()
    scope = theirs if options.only_oracle_paths else None
    report.compared_paths = both if scope is not None else ours.unionByName(theirs).distinct().count()
    report.skipped_paths = ours.count() - both if scope is not None else 0
    fold = lambda df, *columns: df.withColumns({c: F.lower(c) for c in columns}) if options.casefold else df

    def definitions(symbols: DataFrame) -> DataFrame:
        found = fold(E.definition_facts(symbols, options.kinds), "path")
        found = found if options.compare_kinds else found.withColumn("kind", F.lit(None).cast("string")).distinct()
        return found.join(scope, "path", "left_semi") if scope is not None else found

    c_defs, o_defs = cut(definitions(candidate[0])), cut(definitions(oracle[0]))
    place = ["path", "start_line", "start_char"]
    hidden = fold(oracle[0].filter("is_local").select(normalise_path(F.col("path")).alias("path"), F.col("name_start_line").alias("start_line"), F.col("name_start_char").alias("start_char")).distinct(), "path")
    hidden = cut(hidden)
    judged = cut(E.outside(c_defs, hidden, place))
    report.left_out["definitions_that_the_other_calls_local"] = c_defs.count() - judged.count()
    kept, report.definition_shapes = without_blind_shapes(judged, fold(definition_shapes(candidate[0]), "path"), o_defs, place, "declaration", False)
    report.left_out["definitions_of_shapes_unseen_there"] = judged.count() - kept.count()
    report.definitions, report.definition_interval = _score(cut(E.match_facts(kept, o_defs, options.policy)), "path", options)

    def references(pair: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
        found, dropped = E.reference_facts(pair[0], pair[1], options.kinds)
        found = fold(found, "site_path", "target_path")
        return (found.join(scope.withColumnRenamed("path", "site_path"), "site_path", "left_semi") if scope is not None else found), dropped

    c_refs, unfit = references(candidate)
    o_refs, _ = references(oracle)
    claim = [c for c in c_refs.columns if c != "confidence"]
    # An edge stated twice is one claim; it has the greater confidence.
    c_refs = cut(c_refs.groupBy(*claim).agg(F.max("confidence").alias("confidence")))
    o_refs = cut(o_refs.select(*claim).distinct())
    known = candidate[0].select(F.col("id").alias("dst_id"))
    report.left_out["edges_to_nothing"] = unfit.join(known, "dst_id", "left_anti").count()
    report.left_out["edges_without_a_place"] = unfit.join(known, "dst_id", "left_semi").count()

    def narrowed(facts: DataFrame, name: str, smaller: DataFrame) -> DataFrame:
        smaller = cut(smaller)
        report.left_out[name] = facts.count() - smaller.count()
        return smaller

    if scope is not None:
        c_refs = narrowed(c_refs, "edges_into_files_unseen_there", E.inside(c_refs, scope.withColumnRenamed("path", "target_path"), ["target_path"]))
    target = ["target_path", "target_start_line", "target_start_char"]
    c_refs = narrowed(c_refs, "edges_to_what_the_other_calls_local", E.outside(c_refs, hidden.toDF(*target), target))
    site = ["site_path", "site_start_line", "site_start_char"]
    if site_shapes is not None:
        shapes = fold(site_shapes.select(normalise_path(F.col("path")).alias("site_path"), F.col("start_line").alias("site_start_line"), F.col("start_char").alias("site_start_char"), "shape").dropDuplicates(site), "site_path")
        smaller, report.reference_shapes = without_blind_shapes(c_refs, shapes, o_refs, site, "none", True)
        c_refs = narrowed(c_refs, "edges_of_shapes_unseen_there", smaller)
    if options.only_oracle_edge_kinds:
        report.unscored_edge_kinds = [r["kind"] for r in edge_kind_difference(c_refs, o_refs).orderBy("kind").collect()]
        c_refs = narrowed(c_refs, "edges_of_kinds_unseen_there", E.inside(c_refs, o_refs, ["kind"]))
    matched = cut(E.match_facts(c_refs, o_refs, options.policy, "site_"))
    report.references, report.reference_interval = _score(matched, "site_path", options)
    kinds = sorted({r["kind"] for r in c_refs.select("kind").unionByName(o_refs.select("kind")).distinct().collect()})
    for kind in kinds:  # a claim of one kind must not stand for one of another
        own = E.match_facts(c_refs.filter(F.col("kind") == kind), o_refs.filter(F.col("kind") == kind), options.policy, "site_")
        report.by_kind[kind] = M.pooled(E.by_path(own, "site_path")).first().asDict()
    outcomes = cut(E.calibration_pairs(matched, c_refs))
    if not outcomes.isEmpty():
        bins = cut(M.calibration_bins(outcomes))
        report.calibration = [r.asDict() for r in bins.orderBy("bin").collect()]
        report.calibration_error = M.calibration_error(bins).first().asDict()
    return report


def edge_kind_difference(candidate: DataFrame, oracle: DataFrame) -> DataFrame:
    """Kinds that the other side never has."""
    return candidate.select("kind").distinct().join(oracle.select("kind").distinct(), "kind", "left_anti")


def failing(report: Comparison, least: dict[str, float]) -> list[str]:
    """Which floors are not reached; least: definitions or references -> F1."""
    return [f"{k}: F1 {getattr(report, k)['f1']:.3f} is below {floor:g}" for k, floor in sorted(least.items()) if getattr(report, k)["f1"] < floor]

