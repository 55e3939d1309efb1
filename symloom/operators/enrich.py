"""Edges that a type engine resolved and the cascade could not, from its facts; and its facts as an index of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import EDGES, SYMBOLS, TIERS
from ..session import cut
from .lookup import symbols_at

# What a site's kind becomes, and a declaration's.
SITE_EDGES = {"call": "calls", "static_call": "calls", "function_call": "calls", "new": "calls", "property": "references", "static_property": "references", "constant": "references"}
DECLARED = {"class": "class", "interface": "interface", "trait": "trait", "enum": "enum", "method": "method", "constructor": "constructor", "function": "function", "property": "field", "constant": "constant", "enum_case": "constant"}
STATUSES = ("unresolved", "already_known", "outside_index", "no_target", "no_source", "self", "repeated", "added")


def _choice(column: Column, table: dict[str, str], other: str) -> Column:
    held = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(held, column), F.lit(other))


def relative_path(path: Column, root: str, prefix: str = "") -> Column:
    """A path of the analysed folder as one of the index; null outside of the folder."""
    top = root.rstrip("/") + "/"
    inner = F.substring(path, len(top) + 1, 1 << 30)
    return F.when(F.startswith(path, F.lit(top)), F.concat(F.lit(f"{prefix.strip('/')}/"), inner) if prefix.strip("/") else inner)


def line_starts(contents: DataFrame) -> DataFrame:
    """contents(path, content) -> (path, starts): the byte offset at which each line begins."""
    sizes = F.transform(F.split(F.decode("content", "ISO-8859-1"), "\n"), lambda x: F.length(x) + 1)
    grown = F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    return contents.select("path", F.slice(grown, 1, F.size(grown) - 1).alias("starts"))


def at_offset(starts: Column, offset: Column) -> Column:
    """(line, char) of a byte offset: the last line that begins at it or before."""
    line = F.size(F.filter(starts, lambda s: s <= offset)) - 1
    return F.struct(line.alias("line"), (offset - F.get(starts, line)).cast("int").alias("char"))


def placed(facts: DataFrame, contents: DataFrame, root: str, prefix: str = "") -> DataFrame:
    """Facts with the index's path, and the column at which each begins (0 where its line is another)."""
    own = facts.withColumn("at_path", relative_path(F.col("path"), root, prefix)).filter("at_path is not null").withColumn("owner_path", relative_path(F.coalesce("file", F.lit("")), root, prefix))
    lines = line_starts(contents).withColumnRenamed("path", "at_path")
    begin = at_offset(F.col("starts"), F.col("start"))
    end = at_offset(F.col("starts"), F.col("end"))
    out = own.join(lines, "at_path", "left").withColumns({"b": begin, "e": end})
    on_line = F.col("start").isNotNull() & F.col("starts").isNotNull() & (F.col("b.line") == F.col("line"))
    return out.withColumn("char", F.when(on_line, F.col("b.char")).otherwise(0)).drop("starts")


def declarations(facts: DataFrame) -> DataFrame:
    """(fqn, d_path, d_line): of each full name the first declaration."""
    own = facts.filter("kind = 'def' and coalesce(fqn, '') <> ''")
    return own.groupBy("fqn").agg(F.min(F.struct("at_path", "line", "char")).alias("x")).select("fqn", F.col("x.at_path").alias("d_path"), F.col("x.line").alias("d_line"))


def target_names(kind: Column, owner: Column, name: Column, magic: Column) -> Column:
    """The full names under which a site's target may be declared, in order."""
    member = F.concat_ws("::", owner, name)
    out = F.when(kind == "new", F.array(owner)).when(F.coalesce(magic, F.lit(False)), F.array(member, owner)).otherwise(F.array(member))
    return F.when(F.coalesce(owner, F.lit("")) == "", F.array().cast("array<string>")).otherwise(out)


def by_full_name(sites: DataFrame, declared: DataFrame) -> DataFrame:
    """(key, d_path, d_line) of the sites whose target has a declaration: the first name that is declared."""
    tried = sites.select("key", F.posexplode(target_names(F.col("kind"), F.col("class"), F.col("name"), F.col("magic"))).alias("n", "fqn"))
    return tried.join(declared, "fqn").groupBy("key").agg(F.min_by(F.struct("d_path", "d_line"), "n").alias("x")).select("key", "x.*")


def by_file_and_name(sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """(key, target): what a file declares under a name; of several the one whose container is the class named, else the first."""
    ups = symbols.select(F.col("id").alias("container_id"), F.col("name").alias("_up"))
    real = symbols.filter("not is_synthetic").join(ups, "container_id", "left").select(F.col("path").alias("owner_path"), "name", "id", "_up", "name_start_line", "name_start_char")
    owner = F.element_at(F.split(F.coalesce("class", F.lit("")), r"\\"), -1)
    asked = sites.filter("owner_path is not null and not coalesce(magic, false)").select("key", "owner_path", "name", owner.alias("_owner"))
    order = F.struct(~F.coalesce(F.col("_up") == F.col("_owner"), F.lit(False)), "name_start_line", "name_start_char", "id")
    return asked.join(real, ["owner_path", "name"]).groupBy("key").agg(F.min_by("id", order).alias("target"))


def enrich(facts: DataFrame, contents: DataFrame, symbols: DataFrame, edges: DataFrame, root: str, prefix: str = "") -> DataFrame:
    """Every site of a use with its status and, where it adds one, its edge.

    A site adds an edge if the engine resolved it, no edge of the index is there yet, and both of its
    ends are symbols of the index: the target by the file and name that the engine gives, else by the
    declaration of its full name; the source by what is around it.
    """
    own = cut(placed(facts, contents, root, prefix).withColumn("key", F.monotonically_increasing_id()))
    sites = own.filter("kind <> 'def'")
    told = F.coalesce("resolved", F.lit(False))
    declared = by_full_name(sites.filter(told), declarations(own))
    point = declared.select(F.col("d_path").alias("path"), F.col("d_line").alias("line")).unionByName(sites.select(F.col("at_path").alias("path"), "line"))
    around = cut(symbols_at(symbols, point))
    direct = by_file_and_name(sites.filter(told), symbols).withColumnRenamed("target", "t1")
    behind = declared.join(around.select(F.col("path").alias("d_path"), F.col("line").alias("d_line"), F.col("id").alias("t2")), ["d_path", "d_line"], "left").select("key", "t2", F.lit(True).alias("declared"))
    known = edges.filter("site_path is not null").select(F.col("site_path").alias("at_path"), F.col("site_start_line").alias("line"), F.col("site_start_char").alias("char"), F.lit(True).alias("known")).distinct()
    out = sites.join(direct, "key", "left").join(behind, "key", "left").join(known, ["at_path", "line", "char"], "left")
    out = out.join(around.select(F.col("path").alias("at_path"), "line", F.col("id").alias("src_id")), ["at_path", "line"], "left").withColumn("dst_id", F.coalesce("t1", "t2"))
    status = (
        F.when(~told, "unresolved")
        .when(F.col("known"), "already_known")
        .when(F.col("dst_id").isNull(), F.when(F.col("declared").isNull() & F.col("owner_path").isNull(), "outside_index").otherwise("no_target"))
        .when(F.col("src_id").isNull(), "no_source")
        .when(F.col("src_id") == F.col("dst_id"), "self")
        .otherwise("added")
    )
    out = out.withColumn("status", status)
    first = out.filter("status = 'added'").groupBy("at_path", "line", "char", "dst_id").agg(F.min("key").alias("_first"))
    out = out.join(first, ["at_path", "line", "char", "dst_id"], "left").withColumn("status", F.when((F.col("status") == "added") & (F.col("key") != F.col("_first")), "repeated").otherwise(F.col("status")))
    return out.select("at_path", "line", "char", "kind", "name", "magic", "status", "src_id", "dst_id")


def enriched_edges(sites: DataFrame) -> DataFrame:
    added = sites.filter("status = 'added'")
    line, char = F.col("line").cast("int"), F.col("char").cast("int")
    return added.select(
        F.col("at_path").alias("site_path"), "src_id", "dst_id", _choice(F.col("kind"), SITE_EDGES, "references").alias("kind"), F.lit("type_engine").alias("tier"), F.lit(TIERS["type_engine"]).alias("confidence"),
        line.alias("site_start_line"), char.alias("site_start_char"), line.alias("site_end_line"), char.alias("site_end_char"),
    ).select(*EDGES.names)


def enrichment_report(sites: DataFrame) -> DataFrame:
    n = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    return sites.agg(F.count("*").alias("sites"), *[n(s) for s in STATUSES], F.count(F.when((F.col("status") == "added") & F.coalesce("magic", F.lit(False)), 1)).alias("magic_added"))


def top_files(sites: DataFrame, limit: int = 15) -> DataFrame:
    """Files by how many edges they gain."""
    return sites.filter("status = 'added'").groupBy("at_path").agg(F.count("*").alias("added")).orderBy(F.desc("added"), "at_path").limit(limit)


def unresolved_names(facts: DataFrame, limit: int = 20) -> DataFrame:
    """Names that the engine could not resolve most often."""
    return facts.filter("kind <> 'def' and not coalesce(resolved, false)").groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(limit)


def facts_snapshot(facts: DataFrame, contents: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """(symbols, edges) of the facts by themselves: declarations by place, resolved sites by full name, each file a source."""
    own = cut(placed(facts, contents, root).filter("b.line is not null").withColumn("key", F.monotonically_increasing_id()))
    null = F.lit(None).cast("string")
    ident = F.concat_ws("", F.col("at_path"), F.lit("#"), F.col("b.line"), F.lit(":"), F.col("b.char"))
    defs = own.filter("kind = 'def'").withColumn("id", ident)
    spans = [F.col(f"{end}.{axis}").cast("int").alias(f"{p}{name}_{axis}") for p in ("name_", "full_") for end, name in (("b", "start"), ("e", "end")) for axis in ("line", "char")]
    symbols = defs.dropDuplicates(["id"]).select("id", F.col("at_path").alias("path"), "name", _choice(F.col("symbol_kind"), DECLARED, "unknown").alias("kind"), null.alias("qualified_name"), null.alias("container_id"), F.lit("php").alias("language"), null.alias("signature"), null.alias("documentation"), F.lit(False).alias("is_local"), F.lit(False).alias("is_synthetic"), *spans)
    named = defs.filter("coalesce(fqn, '') <> ''").groupBy("fqn").agg(F.min("id").alias("dst_id"))
    sites = own.filter("kind <> 'def' and resolved")
    tried = sites.withColumn("fqn", F.when(F.col("kind") == "new", F.col("class")).otherwise(F.concat_ws("::", "class", "name"))).join(named, "fqn")
    stand_in = F.concat(F.lit("module "), F.col("at_path"))
    place = [F.col(f"{end}.{axis}").cast("int").alias(f"site_{name}_{axis}") for end, name in (("b", "start"), ("e", "end")) for axis in ("line", "char")]
    edges = tried.select(F.col("at_path").alias("site_path"), stand_in.alias("src_id"), "dst_id", _choice(F.col("kind"), SITE_EDGES, "references").alias("kind"), F.lit("oracle").alias("tier"), F.lit(TIERS["oracle"]).alias("confidence"), *place)
    zero = [F.lit(0).alias(f"{p}{e}_{a}") for p in ("name_", "full_") for e in ("start", "end") for a in ("line", "char")]
    files = tried.select("at_path").distinct().select(stand_in.alias("id"), F.col("at_path").alias("path"), F.element_at(F.split("at_path", "/"), -1).alias("name"), F.lit("module").alias("kind"), null.alias("qualified_name"), null.alias("container_id"), F.lit("php").alias("language"), null.alias("signature"), null.alias("documentation"), F.lit(False).alias("is_local"), F.lit(True).alias("is_synthetic"), *zero)
    return symbols.select(*SYMBOLS.names).unionByName(files.select(*SYMBOLS.names)), edges.select(*EDGES.names)
