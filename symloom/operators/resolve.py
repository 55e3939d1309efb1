"""Resolution: references to definitions, by a ladder of joins with a tier of confidence for each rung.

Whatever a reference needs comes down to one kind of question: what does a name mean in a file, for a
reference of some kind? All questions (of bare names, of the types of receivers, of what calls give
back) are asked once, as distinct rows, and answered by equi-joins with tables of the best definition
by name, by file and name, and by container and name. Members are looked up in the answers: in the
type of their receiver and what that extends, breadth first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import ASSIGNED_TYPE, CALL_TYPE, PARENT_RECEIVERS, SELF_RECEIVERS, declared_in_interface, is_external, receiver_shape, return_type
from ..schema import CALLABLE, CONVENTION_KINDS, EDGE_OF_REFERENCE, TIERS, TYPE_LIKE
from ..session import cut
from .conventions import FrameworkPlugin, convention_targets
from .graph import enclosing_types
from .modules import ModuleSettings, resolve_modules

SCOPE_SELF, CONSTRUCTOR_NAMES = ("self", "static"), ("constructor", "__init__", "__construct")
IDENTIFIER = r"^[A-Za-z_$][A-Za-z0-9_$]*$"
TYPED = ("variable (typed)", "property of self (typed)", "property of self (typed by assignment)", "variable (typed by call)")
#: Kinds of references that choose differently among definitions; all others are alike.
CHOICES = ("type", "call", "member", "other", "bare")
_QUESTION = ["path", "name", "kind", "bare"]


def choice_of(kind: Column, bare: Column | None = None) -> Column:
    out = F.when(kind.isin("class", "type"), "type").when(kind == "call", "call").when(kind == "member", "member").otherwise("other")
    return out if bare is None else F.when(bare & (kind == "call"), "bare").otherwise(out)


def preferred(symbols: DataFrame, keys: list[str]) -> DataFrame:
    """keys -> by choice, the definition that is preferred among those of the keys (best), and how many a bare or any name has.

    Locals and stand-ins for files take no part. Types are preferred for references to types, callables
    for calls, bodies over what an interface declares for members; then the order of path and place.
    """
    real = symbols.filter(~F.col("is_synthetic") & ~F.col("is_local"))
    kind = F.col("kind")
    shown = declared_in_interface(F.col("qualified_name"), kind, F.col("full_start_line"), F.col("full_end_line"))
    no_type, no_call = ~kind.isin(*TYPE_LIKE), ~kind.isin(*CALLABLE)
    no = F.lit(False)
    flags = {"type": (no_type, no), "call": (no_call, shown), "member": (shown, no), "other": (no, no), "bare": (no_call, shown)}
    bare = (kind == "function") | kind.isin(*TYPE_LIKE)

    def best(choice: str) -> Column:
        a, b = flags[choice]
        row = F.struct(a.alias("a"), F.coalesce(b, no).alias("b"), "path", F.col("name_start_line").alias("line"), F.col("name_start_char").alias("char"), "id")
        return F.min(F.when(bare, row) if choice == "bare" else row)["id"].alias(f"best_{choice}")

    counts = [F.count("*").alias("n"), F.count(F.when(bare, 1)).alias("n_bare")]
    return real.groupBy(*keys).agg(*[best(c) for c in CHOICES], *counts)


def chosen(choice: Column, prefix: str = "best_") -> Column:
    out = F.lit(None).cast("string")
    for c in CHOICES:
        out = F.when(choice == c, F.col(f"{prefix}{c}")).otherwise(out)
    return out


@dataclass
class Index:
    """What questions are answered from."""

    symbols: DataFrame
    files: DataFrame
    bound: DataFrame  # (path, name, module, original, source_name, target_path): the first binding of a name in a file
    modules: DataFrame  # (module_path, module_id): the stand-in of each file
    in_file: DataFrame
    by_name: DataFrame
    members: DataFrame
    around: DataFrame  # (id, type_id): the type around each symbol
    returns: tuple[str, ...] = ()


def first_bindings(imports: DataFrame, bindings: DataFrame, modules: DataFrame) -> DataFrame:
    """(path, name, module, original, source_name, target_path): of each name, the first import that binds it."""
    own = bindings.join(imports.select("path", F.col("id").alias("import_id"), "module", "relative_level"), ["path", "import_id"])
    row = F.struct("import_id", "ordinal", "module", "relative_level", "original")
    first = own.groupBy("path", F.col("local").alias("name")).agg(F.min(row).alias("x"))
    flat = first.select("path", "name", "x.module", "x.relative_level", "x.original", F.coalesce("x.original", "name").alias("source_name"))
    return flat.join(modules, ["path", "module", "relative_level"], "left").drop("relative_level")


def build_index(symbols: DataFrame, files: DataFrame, imports: DataFrame, bindings: DataFrame, extra_modules: DataFrame | None = None, settings: ModuleSettings = ModuleSettings(), returns: tuple[str, ...] = ()) -> tuple[Index, DataFrame]:
    """The index, and (path, module, relative_level, target_path) of every module asked for."""
    asked = imports.select("path", "module", "relative_level")
    asked = asked.unionByName(extra_modules) if extra_modules is not None else asked
    modules = cut(resolve_modules(asked, files, settings))
    stand_ins = symbols.filter((F.col("kind") == "module") & F.col("is_synthetic")).select(F.col("path").alias("module_path"), F.col("id").alias("module_id"))
    bound = cut(first_bindings(imports, bindings, modules))
    real = symbols.filter(F.col("container_id").isNotNull())
    index = Index(symbols, files, bound, stand_ins, cut(preferred(symbols, ["path", "name"])), cut(preferred(symbols, ["name"])), cut(preferred(real, ["container_id", "name"])), cut(enclosing_types(symbols)), returns)
    return index, modules


def answer(questions: DataFrame, ix: Index) -> DataFrame:
    """questions(path, name, kind, bare) -> with target, tier and outcome (resolved, ambiguous, external or unresolved)."""
    pick = choice_of(F.col("kind"))
    q = questions.select(*_QUESTION).distinct().join(ix.bound, ["path", "name"], "left")
    best = [f"best_{c}" for c in CHOICES]
    there = ix.in_file.select(F.col("path").alias("target_path"), F.col("name").alias("source_name"), *[F.col(b).alias(f"t_{b}") for b in best])
    any_ = ix.by_name.select(F.col("name").alias("source_name"), *[F.col(b).alias(f"a_{b}") for b in best])
    here = ix.in_file.select("path", "name", *[F.col(b).alias(f"h_{b}") for b in best])
    named = ix.by_name.select("name", *[F.col(b).alias(f"n_{b}") for b in best], "n", "n_bare")
    q = q.join(there, ["target_path", "source_name"], "left").join(any_, "source_name", "left")
    q = q.join(ix.modules, F.col("target_path") == F.col("module_path"), "left").join(here, ["path", "name"], "left").join(named, "name", "left")
    leads = F.col("target_path").isNotNull()
    by_file, by_module = chosen(pick, "t_best_"), F.when(F.col("original").isNull(), F.col("module_id"))
    by_import = F.when(leads, F.coalesce(by_file, by_module, chosen(pick, "a_best_")))
    weak = by_file.isNull() & by_module.isNull()
    gone = F.col("module").isNotNull() & ~leads & is_external(F.col("module"))
    bare_call = F.col("bare") & (F.col("kind") == "call")
    count = F.coalesce(F.when(bare_call, F.col("n_bare")).otherwise(F.col("n")), F.lit(0))
    rest = F.when(bare_call, F.col("n_best_bare")).otherwise(chosen(pick, "n_best_"))
    own = chosen(pick, "h_best_")
    # The ladder: the first rung that answers, or that says that nothing can.
    rung = (
        F.when(by_import.isNotNull(), F.when(weak, "import_suffix").otherwise("import_map"))
        .when(gone | (F.col("kind") == "import"), "external")
        .when(own.isNotNull(), "same_module")
        .when(count == 1, "unique_name")
        .when(count > 1, "suffix")
        .otherwise("unresolved")
    )
    found = q.select(*_QUESTION, rung.alias("rung"), by_import.alias("i"), own.alias("h"), rest.alias("r"))
    rung = F.col("rung")
    target = F.when(rung.startswith("import_"), F.col("i")).when(rung == "same_module", F.col("h")).when(rung.isin("unique_name", "suffix"), F.col("r"))
    outcome = F.when(rung == "suffix", "ambiguous").when(rung.isin("external", "unresolved"), rung).otherwise("resolved")
    return found.select(*_QUESTION, target.alias("target"), F.when(target.isNotNull(), rung).alias("tier"), outcome.alias("outcome"))


def learn_bases(refs: DataFrame, answers: DataFrame, ix: Index) -> DataFrame:
    """(owner, target, ordinal): what each type extends, implements or uses, in the order written."""
    base = refs.filter("kind = 'class'").select("path", "name", "kind", F.lit(False).alias("bare"), "container_id", "start_line", "start_char")
    types = ix.symbols.filter(F.col("kind").isin(*TYPE_LIKE)).select(F.col("id").alias("target"))
    led = base.join(answers, _QUESTION).join(types, "target").join(ix.around.withColumnRenamed("id", "container_id"), "container_id")
    led = led.filter(F.col("type_id") != F.col("target")).groupBy(F.col("type_id").alias("owner"), "target").agg(F.min(F.struct("path", "start_line", "start_char")).alias("at"))
    listed = led.groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("at", "target"))).alias("x"))
    return listed.select("owner", F.posexplode("x").alias("ordinal", "y")).select("owner", F.col("y.target").alias("target"), "ordinal")


def hierarchy(bases: DataFrame, symbols: DataFrame) -> DataFrame:
    """(owner, type, trail): each symbol and what it extends; trails in order of length and value go breadth first."""
    empty = F.array().cast("array<int>")
    seen = symbols.select(F.col("id").alias("owner"), F.col("id").alias("type"), empty.alias("trail"))
    step = cut(bases.select(F.col("owner").alias("type"), F.col("target").alias("up"), "ordinal"))
    frontier, known, parts = bases.select("owner", F.col("target").alias("type"), F.array("ordinal").alias("trail")), bases.select("owner", F.col("target").alias("type")).distinct(), []
    while True:
        frontier = cut(frontier.filter("owner <> type").groupBy("owner", "type").agg(F.min("trail").alias("trail")))
        if frontier.isEmpty():
            break
        parts.append(frontier)
        more = frontier.join(step, "type").select("owner", F.col("up").alias("type"), F.concat("trail", F.array("ordinal")).alias("trail"))
        frontier = more.join(known, ["owner", "type"], "left_anti")
        known = cut(known.unionByName(more.select("owner", "type")).distinct())
    for p in parts:
        seen = seen.unionByName(p)
    return cut(seen)


def main_base(bases: DataFrame, symbols: DataFrame) -> DataFrame:
    """(owner, base): the first class that a type extends."""
    classes = symbols.filter("kind = 'class'").select(F.col("id").alias("target"))
    return bases.join(classes, "target").groupBy("owner").agg(F.min_by("target", "ordinal").alias("base"))


def in_hierarchy(asked: DataFrame, tree: DataFrame, ix: Index) -> DataFrame:
    """asked(key, owner, name, kind, skip_own) -> (key, member): as the nearest type declares it."""
    near = asked.join(tree, "owner").filter(~F.col("skip_own") | (F.size("trail") > 0))
    held = near.join(ix.members.withColumnRenamed("container_id", "type"), ["type", "name"])
    member = chosen(choice_of(F.col("kind")))
    return held.filter(member.isNotNull()).groupBy("key").agg(F.min_by(member, F.struct(F.size("trail"), "trail")).alias("member"))


def _marker(column: Column) -> tuple[Column, Column, Column]:
    """callee, receiver and type of the receiver of `call:callee|receiver|type`."""
    parts = F.split(F.substring(column, len(CALL_TYPE) + 1, 1 << 30), r"\|", 3)
    return tuple(F.get(parts, F.lit(i)) for i in range(3))


def call_markers(refs: DataFrame) -> list[DataFrame]:
    """(path, container_id, marker) by depth: markers of receivers, then of the receivers in those, until there are none."""
    at = refs.select("path", "container_id", F.col("receiver_type").alias("marker")).filter(F.startswith("marker", F.lit(CALL_TYPE))).distinct()
    out = []
    while not (level := cut(at)).isEmpty():
        out.append(level)
        at = level.withColumn("marker", _marker(F.col("marker"))[2]).filter(F.startswith("marker", F.lit(CALL_TYPE))).distinct()
    return out


def _marker_refs(level: DataFrame) -> DataFrame:
    """Markers as the calls that they stand for."""
    callee, receiver, kind = _marker(F.col("marker"))
    blank = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    return level.select("path", "container_id", "marker", callee.alias("name"), F.lit("call").alias("kind"), blank(receiver).alias("receiver"), blank(kind).alias("receiver_type"))


def _shaped(rows: DataFrame) -> DataFrame:
    """With the shape of the receiver and the name of its type where it has one."""
    shape = receiver_shape(F.col("kind"), F.col("receiver"), F.col("receiver_type"))
    plain = F.regexp_replace("receiver_type", f"^{ASSIGNED_TYPE}", "")
    rows = rows.withColumn("shape", shape)
    called = F.startswith(plain, F.lit(CALL_TYPE))
    type_name = F.when(F.col("shape").isin(*TYPED) & ~called, plain).when(F.col("shape") == "type", F.col("receiver"))
    return rows.withColumn("type_name", type_name).withColumn("marker_type", F.when(F.col("shape").isin(*TYPED) & called, plain))


def _bare(shape: Column) -> Column:
    return shape == "none"


def _type_questions(rows: DataFrame) -> DataFrame:
    """What the types of receivers are called, and (for what frameworks give back) receivers that look like types."""
    named = rows.select("path", F.col("type_name").alias("name")).filter("name is not null")
    return named.select("path", "name", F.lit("type").alias("kind"), F.lit(False).alias("bare"))


def type_owner(rows: DataFrame, name: str, answers: DataFrame, ix: Index) -> DataFrame:
    """rows (path, container_id, a type's name) with owner and owner_tier; self and static mean the type around."""
    a = answers.filter("kind = 'type'").select("path", F.col("name").alias(name), F.col("target").alias("_t"), F.col("tier").alias("_tier"))
    out = rows.join(a, ["path", name], "left").join(ix.around.select(F.col("id").alias("container_id"), F.col("type_id").alias("_around")), "container_id", "left")
    here = F.col(name).isin(*SCOPE_SELF)
    return out.withColumn("owner", F.when(here, F.col("_around")).otherwise(F.col("_t"))).withColumn("owner_tier", F.when(here, F.when(F.col("_around").isNotNull(), "same_module")).otherwise(F.col("_tier"))).drop("_t", "_tier", "_around")


def members_of(rows: DataFrame, answers: DataFrame, owners: DataFrame, tree: DataFrame, ix: Index) -> DataFrame:
    """Shaped rows (key, path, name, kind, container_id, receiver, ...) of members -> (key, target, tier).

    owners: (path, container_id, marker, owner, tier) of the calls that type receivers.
    """
    info = ix.symbols.select(F.col("id").alias("owner"), F.col("kind").alias("owner_kind"), F.col("path").alias("owner_path"))
    holders = ix.symbols.filter("container_id is not null").select(F.col("container_id").alias("owner")).distinct().withColumn("holds", F.lit(True))
    own = ["key", "path", "name", "kind", "container_id", "receiver"]
    inner = rows.filter("shape = 'self'").select(*own).join(ix.around.select(F.col("id").alias("container_id"), F.col("type_id").alias("owner")), "container_id", "left")
    typed = type_owner(rows.filter("type_name is not null").select(*own, "type_name"), "type_name", answers, ix).select(*own, "owner", "owner_tier")
    told = rows.filter("marker_type is not null").select(*own, F.col("marker_type").alias("marker"))
    same = owners.select("path", F.col("container_id").alias("_c"), "marker", "owner", F.col("tier").alias("owner_tier"))
    called = told.join(same, (told["path"] == same["path"]) & told["container_id"].eqNullSafe(same["_c"]) & (told["marker"] == same["marker"])).select(*[told[c] for c in own], "owner", "owner_tier")
    # An untyped receiver: a type or a module that was imported under its name.
    loose = rows.filter("shape <> 'self' and type_name is null and marker_type is null").select(*own)
    types = ix.symbols.filter(F.col("kind").isin(*TYPE_LIKE, "module") & ~F.col("is_synthetic")).groupBy(F.col("path").alias("target_path"), F.col("name").alias("source_name")).agg(F.min(F.struct("name_start_line", "name_start_char", "id"))["id"].alias("type"))
    via = loose.join(ix.bound.withColumnRenamed("name", "receiver"), ["path", "receiver"]).filter("target_path is not null").join(types, ["target_path", "source_name"], "left").join(ix.modules, F.col("target_path") == F.col("module_path"), "left")
    via = via.select(*own, F.coalesce("type", F.when(F.col("original").isNull(), F.col("module_id"))).alias("owner"), F.lit("import_map").alias("owner_tier"))
    outer = typed.unionByName(called).unionByName(via).filter("owner is not null").join(info, "owner").join(holders, "owner", "left")
    from_module = outer.filter("owner_kind = 'module'").join(ix.in_file.select(F.col("path").alias("owner_path"), "name", *[f"best_{c}" for c in CHOICES]), ["owner_path", "name"])
    from_module = from_module.select("key", chosen(choice_of(F.col("kind"))).alias("target"), F.col("owner_tier").alias("tier")).filter("target is not null")
    fit = outer.filter(F.col("owner_kind").isin(*TYPE_LIKE) | F.coalesce("holds", F.lit(False))).filter("owner_kind <> 'module'")
    asked = fit.select("key", "owner", "name", "kind", F.lit(False).alias("skip_own"), F.col("owner_tier").alias("tier"))
    asked = cut(asked.unionByName(inner.filter("owner is not null").select("key", "owner", "name", "kind", F.col("receiver").isin(*PARENT_RECEIVERS).alias("skip_own"), F.lit("same_module").alias("tier"))))
    from_types = in_hierarchy(asked, tree, ix).join(asked.select("key", "tier"), "key").select("key", F.col("member").alias("target"), "tier")
    # Outside of any type, self is the file: its callables and fields.
    free = inner.filter("owner is null").join(ix.in_file.select("path", "name", *[f"best_{c}" for c in CHOICES]), ["path", "name"]).select("key", chosen(choice_of(F.col("kind"))).alias("target"))
    fields = ix.symbols.filter(F.col("kind").isin(*CALLABLE, "field")).select(F.col("id").alias("target"))
    free = free.join(fields, "target", "left_semi").select("key", "target", F.lit("same_module").alias("tier"))
    return from_types.unionByName(from_module).unionByName(free)


def weaker(a: Column, b: Column) -> Column:
    order = F.create_map(*[x for t, c in TIERS.items() for x in (F.lit(t), F.lit(c))])
    return F.when(F.try_element_at(order, b) < F.try_element_at(order, a), b).otherwise(a)


def types_of_calls(levels: list[DataFrame], answers: DataFrame, tree: DataFrame, ix: Index) -> DataFrame:
    """(path, container_id, marker, owner, tier): the type that each call gives back; the innermost calls first."""
    empty = levels[0].sparkSession.createDataFrame([], "path string, container_id string, marker string, owner string, tier string") if levels else None
    if empty is None:
        return None
    declared = return_type(F.coalesce("signature", F.lit("")), F.col("documentation"))
    held = ix.symbols.filter("container_id is not null").select(F.col("container_id").alias("target")).distinct().withColumn("holds", F.lit(True))
    info = ix.symbols.select(F.col("id").alias("target"), F.col("kind").alias("t_kind"), F.col("path").alias("t_path"), F.col("container_id").alias("t_container"), declared.alias("declared"))
    likes = ix.symbols.filter(F.col("kind").isin(*TYPE_LIKE)).select(F.col("id").alias("owner"))
    done = empty
    for level in reversed(levels):
        rows = cut(_shaped(_marker_refs(level)).withColumn("key", F.monotonically_increasing_id()))
        plain = rows.filter(_bare(F.col("shape"))).withColumn("bare", F.lit(True)).join(answers, _QUESTION).select("key", "target", "tier").filter("target is not null")
        found = cut(plain.unionByName(members_of(rows.filter(~_bare(F.col("shape"))), answers, done, tree, ix)))
        led = rows.select("key", "path", "container_id", "marker").join(found, "key").join(info, "target").join(held, "target", "left")
        up = ix.around.select(F.col("id").alias("t_container"), F.col("type_id").alias("t_type"))
        led = led.join(up, "t_container", "left")
        back = answers.filter("kind = 'type'").select(F.col("path").alias("t_path"), F.col("name").alias("declared"), F.col("target").alias("b_target"), F.col("tier").alias("b_tier"))
        led = led.join(back, ["t_path", "declared"], "left")
        kind, told = F.col("t_kind"), F.col("declared")
        owner = (
            F.when(kind.isin(*TYPE_LIKE), F.col("target"))
            .when(kind == "constructor", F.col("t_type"))
            .when(told.isNull(), F.when(F.coalesce("holds", F.lit(False)), F.col("target")))
            .when(told.isin(*SCOPE_SELF), F.col("t_type"))
            .otherwise(F.col("b_target"))
        )
        through = ~kind.isin(*TYPE_LIKE, "constructor") & told.isNotNull() & ~told.isin(*SCOPE_SELF)
        result = led.select("path", "container_id", "marker", owner.alias("owner"), F.when(through, weaker(F.col("tier"), F.col("b_tier"))).otherwise(F.col("tier")).alias("tier"))
        if ix.returns:
            lost = rows.filter(F.col("name").isin(*ix.returns)).join(found.select("key"), "key", "left_anti")
            guess = F.coalesce("type_name", F.when(F.col("receiver").rlike(r"^\p{Lu}"), F.col("receiver")))
            by_name = type_owner(lost.filter("marker_type is null").withColumn("guess", guess), "guess", answers, ix).select("path", "container_id", "marker", "owner")
            deep = done.select("path", F.col("container_id").alias("_c"), F.col("marker").alias("marker_type"), "owner")
            nested = lost.join(deep, (lost["path"] == deep["path"]) & lost["container_id"].eqNullSafe(deep["_c"]) & (lost["marker_type"] == deep["marker_type"])).select(lost["path"], "container_id", "marker", "owner")
            given = by_name.unionByName(nested).join(likes, "owner", "left_semi").withColumn("tier", F.lit("unique_name"))
            result = result.unionByName(given.select("path", "container_id", "marker", "owner", "tier"))
        done = cut(done.unionByName(result.filter("owner is not null")))
    return done


def as_identifier(name: Column) -> Column:
    """The identifier that a component's tag also is: as it stands, or in Pascal case."""
    pascal = F.array_join(F.transform(F.filter(F.split(name, "-"), lambda p: p != ""), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))), "")
    tag = ~name.startswith("x-") & ~name.contains(".") & name.contains("-") & pascal.rlike(IDENTIFIER)
    return F.when(name.rlike(IDENTIFIER), name).when(tag, pascal)


def constructors(symbols: DataFrame) -> DataFrame:
    """(type, constructor) of types that declare one."""
    rank = F.create_map(*[x for i, n in enumerate(CONSTRUCTOR_NAMES) for x in (F.lit(n), F.lit(i))])
    own = symbols.filter((F.col("kind") == "constructor") & F.col("name").isin(*CONSTRUCTOR_NAMES) & F.col("container_id").isNotNull())
    return own.groupBy(F.col("container_id").alias("type")).agg(F.min_by("id", F.struct(F.element_at(rank, F.col("name")), "name_start_line", "name_start_char", "id")).alias("constructor"))


def resolve(refs: DataFrame, symbols: DataFrame, files: DataFrame, imports: DataFrame, bindings: DataFrame, settings: ModuleSettings = ModuleSettings(), active: list[tuple[FrameworkPlugin, list[str]]] = (), base_refs: DataFrame | None = None) -> DataFrame:
    """Every reference with target, tier and outcome (resolved, ambiguous, external or unresolved).

    base_refs: references that name what types extend, if refs are only some of all.
    """
    returns = tuple(dict.fromkeys(c for p, _ in active for c in p.returns_receiver))
    refs = cut(refs.withColumn("key", F.xxhash64("path", "start_line", "start_char", "end_line", "end_char", "kind", "name")).dropDuplicates(["key"]))
    level_of = F.lit(0)
    modules_named = refs.filter("kind = 'module'").select("path", F.col("name").alias("module"), level_of.alias("relative_level"))
    ix, modules = build_index(symbols, files, imports, bindings, modules_named, settings, returns)
    bases_from = refs if base_refs is None else base_refs

    shaped = cut(_shaped(refs))
    kind, shape = F.col("kind"), F.col("shape")
    markers = call_markers(refs)
    inner = [_shaped(_marker_refs(m)) for m in markers]
    member = kind.isin("call", "member") & ~_bare(shape)
    convention = kind.isin(*CONVENTION_KINDS)
    special = convention | kind.isin("scope", "module") | ((kind == "type") & F.col("name").isin(*SCOPE_SELF))
    direct = shaped.filter(~member & ~special)
    tags = shaped.filter(kind == "component").withColumn("tag", as_identifier(F.col("name"))).filter("tag is not null")

    # All questions at once.
    no = F.lit(False).alias("bare")
    asked = direct.select("path", "name", "kind", _bare(shape).alias("bare")).unionByName(_type_questions(shaped)).unionByName(tags.select("path", F.col("tag").alias("name"), "kind", no))
    asked = asked.unionByName(bases_from.filter("kind = 'class'").select("path", "name", "kind", no))
    for rows in inner:
        looks = F.coalesce("type_name", F.when(F.col("receiver").rlike(r"^\p{Lu}"), F.col("receiver")))
        asked = asked.unionByName(rows.filter(_bare(F.col("shape"))).select("path", "name", "kind", F.lit(True).alias("bare"))).unionByName(_type_questions(rows.withColumn("type_name", looks)))
    if markers:
        told = return_type(F.coalesce("signature", F.lit("")), F.col("documentation"))
        asked = asked.unionByName(symbols.filter(F.col("kind").isin(*CALLABLE)).select("path", told.alias("name"), F.lit("type").alias("kind"), no).filter("name is not null"))
    asked = asked.withColumn("bare", F.when(kind == "call", F.col("bare")).otherwise(F.lit(False)))
    answers = cut(answer(asked, ix))

    bases = cut(learn_bases(bases_from, answers, ix))
    tree = hierarchy(bases, symbols)
    owners = types_of_calls(markers, answers, tree, ix)
    if owners is None:
        owners = refs.sparkSession.createDataFrame([], "path string, container_id string, marker string, owner string, tier string")

    plain = direct.withColumn("bare", _bare(shape) & (kind == "call")).join(answers, _QUESTION, "left").select("key", "target", "tier", "outcome")
    through = members_of(shaped.filter(member & ~special), answers, owners, tree, ix).withColumn("outcome", F.lit("resolved"))
    around = ix.around.select(F.col("id").alias("container_id"), F.col("type_id").alias("owner"))
    first = main_base(bases, symbols)
    scopes = shaped.filter((kind == "scope") | (kind == "type") & F.col("name").isin(*SCOPE_SELF)).join(around, "container_id").join(first, "owner", "left")
    scope_target = F.when(F.col("name").isin(*SCOPE_SELF), F.col("owner")).when(F.col("name") == "parent", F.col("base"))
    scopes = scopes.select("key", scope_target.alias("target"), F.lit("same_module").alias("tier"), F.lit("resolved").alias("outcome")).filter("target is not null")
    by_path = shaped.filter(kind == "module").join(modules.select("path", F.col("module").alias("name"), "target_path"), ["path", "name"], "left").join(ix.modules, F.col("target_path") == F.col("module_path"), "left")
    by_path = by_path.select("key", F.col("module_id").alias("target"), F.when(F.col("module_id").isNotNull(), "import_map").alias("tier"), F.when(F.col("module_id").isNotNull(), "resolved").otherwise("external").alias("outcome"))
    parts = [plain, through, scopes, by_path]
    if not shaped.filter(convention).isEmpty():
        parts.append(_by_convention(shaped.filter(convention), tags, answers, ix, list(active)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p.select("key", "target", "tier", "outcome"))
    out = refs.join(out, "key", "left").withColumn("outcome", F.coalesce("outcome", F.lit("unresolved")))
    made = constructors(symbols)
    out = out.join(made, F.col("target") == F.col("type"), "left").withColumn("target", F.when(kind == "construct", F.coalesce("constructor", "target")).otherwise(F.col("target")))
    return cut(out.drop("type", "constructor"))


def _by_convention(rows: DataFrame, tags: DataFrame, answers: DataFrame, ix: Index, active: list) -> DataFrame:
    """Names of views and components: an import that leads to a file, a convention, then (tags) the ladder."""
    asked = rows.join(ix.files.select("path", "language"), "path", "left")
    named = convention_targets(asked, ix.files, active).join(ix.modules, F.col("target_path") == F.col("module_path")).select("path", "name", "kind", F.col("module_id").alias("c_target"))
    leads = ix.bound.filter("target_path is not null").select("path", F.col("name").alias("tag"), F.lit(True).alias("leads"))
    tagged = tags.select("key", "tag").join(rows.select("key", "path", "kind"), "key").join(leads, ["path", "tag"], "left")
    told = answers.filter("not bare").select("path", F.col("name").alias("tag"), "kind", F.col("target").alias("l_target"), F.col("tier").alias("l_tier"), F.col("outcome").alias("l_outcome"))
    tagged = tagged.join(told, ["path", "tag", "kind"], "left").select("key", F.coalesce("leads", F.lit(False)).alias("leads"), "l_target", "l_tier", "l_outcome")
    out = rows.select("key", "path", "name", "kind").join(named, ["path", "name", "kind"], "left").join(tagged, "key", "left")
    use = F.col("c_target").isNotNull() & ~F.coalesce("leads", F.lit(False))
    target = F.when(use, F.col("c_target")).otherwise(F.col("l_target"))
    return out.select("key", target.alias("target"), F.when(use, "import_map").otherwise(F.col("l_tier")).alias("tier"), F.when(use, "resolved").otherwise(F.coalesce("l_outcome", F.lit("unresolved"))).alias("outcome"))


def edges_of(resolved: DataFrame, modules: DataFrame) -> DataFrame:
    """Edges of resolved references; a reference outside of any symbol comes from its file. modules: (module_path, module_id)."""
    table = F.create_map(*[x for k, e in EDGE_OF_REFERENCE.items() for x in (F.lit(k), F.lit(e))])
    order = F.create_map(*[x for t, c in TIERS.items() for x in (F.lit(t), F.lit(c))])
    led = resolved.filter("target is not null").join(modules, F.col("path") == F.col("module_path"), "left").withColumn("src_id", F.coalesce("container_id", "module_id"))
    led = led.filter(F.col("src_id").isNotNull() & ((F.col("src_id") != F.col("target")) | F.col("kind").isin("call", "member")))
    place = [F.col(f"{end}_{axis}").alias(f"site_{end}_{axis}") for end in ("start", "end") for axis in ("line", "char")]
    return led.select(F.col("path").alias("site_path"), "src_id", F.col("target").alias("dst_id"), F.coalesce(F.try_element_at(table, F.col("kind")), F.lit("references")).alias("kind"), "tier", F.element_at(order, F.col("tier")).alias("confidence"), *place)


def contains_edges(symbols: DataFrame) -> DataFrame:
    """An edge from each known container to what it holds, at the name of what it holds."""
    ups = symbols.select(F.col("id").alias("container_id"))
    own = symbols.filter("container_id is not null").join(ups, "container_id", "left_semi")
    place = [F.col(f"name_{end}_{axis}").alias(f"site_{end}_{axis}") for end in ("start", "end") for axis in ("line", "char")]
    return own.select(F.col("path").alias("site_path"), F.col("container_id").alias("src_id"), F.col("id").alias("dst_id"), F.lit("contains").alias("kind"), F.lit("oracle").alias("tier"), F.lit(TIERS["oracle"]).alias("confidence"), *place)


def resolution_stats(resolved: DataFrame) -> DataFrame:
    """By outcome and tier, how many references; ambiguous ones are resolved, by the last rung."""
    return resolved.groupBy("outcome", "tier").agg(F.count("*").alias("n"))


def resolution_rate(resolved: DataFrame) -> DataFrame:
    done, n = F.count("target"), F.count("*")
    return resolved.agg(done.alias("resolved"), F.count(F.when(F.col("outcome") == "external", 1)).alias("external"), F.count(F.when(F.col("outcome") == "unresolved", 1)).alias("unresolved"), F.count(F.when(F.col("outcome") == "ambiguous", 1)).alias("ambiguous"), F.coalesce(F.try_divide(done, n), F.lit(0.0)).alias("rate"))


def name_matched(refs: DataFrame, symbols: DataFrame, modules: DataFrame) -> DataFrame:
    """The control: each reference leads to every definition of its name, once for each pair."""
    real = symbols.filter(~F.col("is_synthetic") & ~F.col("is_local")).groupBy(F.col("id").alias("dst_id")).agg(F.collect_set("name").alias("names"))
    own = refs.join(modules, F.col("path") == F.col("module_path"), "left").select("name", F.coalesce("container_id", "module_id").alias("src_id"))
    own = own.filter("src_id is not null").distinct()

    def led(to: DataFrame) -> DataFrame:
        return to.select("dst_id", F.explode("names").alias("name")).join(own, "name").filter("src_id <> dst_id").select("src_id", "dst_id")

    # Pairs can repeat only where an id has several names; all others are not gathered to be compared.
    pairs = led(real.filter(F.size("names") == 1)).unionByName(led(real.filter(F.size("names") > 1)).distinct())
    return pairs.select("src_id", "dst_id", F.lit("references").alias("kind"), F.lit("fuzzy").alias("tier"), F.lit(TIERS["fuzzy"]).alias("confidence"))


__all__ = ["SELF_RECEIVERS", "Index", "answer", "as_identifier", "build_index", "chosen", "constructors", "contains_edges", "edges_of", "first_bindings", "hierarchy", "learn_bases", "name_matched", "preferred", "resolution_rate", "resolution_stats", "resolve"]
