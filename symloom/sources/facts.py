"""Facts of a type engine (JSON lines), prompt sets, transcripts of agents, synthetic repositories."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FACTS = "kind string, path string, line int, start long, end long, name string, receiver string, resolved boolean, class string, file string, magic boolean, fqn string, symbol_kind string, container string"
PROMPT_STRATA = ("precise", "domain", "unanchored", "diffuse")


class FormatError(ValueError):
    """A file that does not hold what it should."""


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """Records of a type engine, one a line. Blank lines and values that are no objects are passed over; a line that is no JSON is an error that gives the line."""
    lines = spark.read.text(path).withColumn("file_", F.input_file_name()).filter("trim(value) <> ''")
    parsed = F.from_json("value", FACTS, {"mode": "PERMISSIVE"})
    is_object = F.startswith(F.trim("value"), F.lit("{"))
    good = F.try_parse_json("value").isNotNull()
    wrong = F.raise_error(F.concat(F.lit("not JSON: "), F.substring("value", 1, 200))).cast("boolean")
    return lines.filter(F.when(good, is_object).otherwise(wrong)).select(parsed.alias("x")).select("x.*").filter("kind is not null")


def load_prompts(text: str) -> list[dict]:
    """A prompt set: {prompts: [{sha, text, stratum, note}]}, or the list itself; anything amiss is an error."""
    try:
        data = json.loads(text)
    except ValueError as e:
        raise FormatError(f"not JSON: {e}") from e
    rows = data.get("prompts") if isinstance(data, dict) else data
    if not isinstance(rows, list):
        raise FormatError("a prompt set is a list of prompts")
    out, seen = [], set()
    for k, r in enumerate(rows):
        if not isinstance(r, dict) or not all(isinstance(r.get(f), str) and r[f].strip() for f in ("sha", "text")):
            raise FormatError(f"prompt {k} needs a sha and a text")
        if r.get("stratum") not in PROMPT_STRATA:
            raise FormatError(f"prompt {k}: the stratum is one of {', '.join(PROMPT_STRATA)}")
        if r["sha"] in seen:
            raise FormatError(f"prompt {k}: {r['sha']} has one already")
        seen.add(r["sha"])
        out.append({"sha": r["sha"], "text": r["text"], "stratum": r["stratum"], "note": r.get("note") or ""})
    return out


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """One row a file of an agent's run (a JSON event a line): turns, tokens, cost, calls of tools, the last answer. Lines that are no events are counted and passed over."""
    event = "type string, subtype string, result string, num_turns int, total_cost_usd double, duration_ms long, is_error boolean, usage struct<input_tokens:long,output_tokens:long,cache_read_input_tokens:long,cache_creation_input_tokens:long>, message struct<content:array<struct<type:string,name:string,text:string>>>"
    lines = spark.read.text(path).filter("trim(value) <> ''").withColumn("run", F.input_file_name())
    parsed = lines.select("run", F.from_json("value", event).alias("e"))
    tools = F.filter(F.coalesce("e.message.content", F.array().cast("array<struct<type:string,name:string,text:string>>")), lambda c: c["type"] == "tool_use")
    calls = parsed.filter("e.type = 'assistant'").select("run", F.explode(F.transform(tools, lambda c: c["name"])).alias("tool")).groupBy("run", "tool").agg(F.count("*").alias("n"))
    called = calls.groupBy("run").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool", "n")))).alias("tool_calls"))
    last = lambda c: F.max(F.when(F.col("e.type") == "result", F.col(c)))
    usage = lambda c: F.coalesce(last(f"e.usage.{c}"), F.lit(0)).alias(c)
    runs = parsed.groupBy("run").agg(
        F.coalesce(last("e.num_turns"), F.lit(0)).alias("turns"), F.coalesce(last("e.total_cost_usd"), F.lit(0.0)).alias("cost"), F.coalesce(last("e.duration_ms"), F.lit(0)).alias("duration_ms"),
        last("e.result").alias("answer"), (F.coalesce(last("e.is_error"), F.lit(True)) == F.lit(False)).alias("ok"), F.count(F.when(F.col("e.type").isNull(), 1)).alias("bad_lines"),
        *[usage(c) for c in ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")],
    )
    return runs.join(called, "run", "left")


def synthetic_repository(spark: SparkSession, n: int) -> DataFrame:
    """(path, language, content) of n small files in three languages; file i uses files (7 i + 1) mod n and (11 i + 3) mod n."""
    i = F.col("i")
    rows = spark.range(n).select(F.col("id").alias("i"), F.pmod(F.col("id") * 7 + 1, F.lit(n)).alias("a"), F.pmod(F.col("id") * 11 + 3, F.lit(n)).alias("b"))
    # A dependency is on the file of the same language next to the one named, so that every import leads somewhere.
    same = lambda c: F.least(F.col(c) - F.pmod(F.col(c), F.lit(3)) + F.pmod(i, F.lit(3)), F.lit((n - 1) // 3 * 3) - 3 + F.pmod(i, F.lit(3)))
    rows = rows.withColumn("a", F.greatest(same("a"), F.pmod(i, F.lit(3)))).withColumn("b", F.greatest(same("b"), F.pmod(i, F.lit(3))))
    folder = F.format_string("pkg%02d", F.pmod(i, F.lit(37)))
    at = lambda c: F.format_string("pkg%02d", F.pmod(F.col(c), F.lit(37)))
    py = F.format_string("from %s.mod%d import Service%d\nfrom %s.mod%d import helper%d\n\nLIMIT%d = %d\n\n\nclass Service%d(Service%d):\n    def run%d(self):\n        return helper%d(LIMIT%d)\n\n\ndef helper%d(value):\n    return Service%d().run%d()\n", at("a"), F.col("a"), F.col("a"), at("b"), F.col("b"), F.col("b"), i, i, i, F.col("a"), i, F.col("b"), i, i, i, i)
    ts = F.format_string('import { Service%d } from "../%s/mod%d";\nimport { helper%d } from "../%s/mod%d";\n\nexport const LIMIT%d = %d;\n\nexport class Service%d extends Service%d {\n  run%d(): number {\n    return helper%d(LIMIT%d);\n  }\n}\n\nexport function helper%d(value: number): number {\n  return new Service%d().run%d();\n}\n', F.col("a"), at("a"), F.col("a"), F.col("b"), at("b"), F.col("b"), i, i, i, F.col("a"), i, F.col("b"), i, i, i, i)
    php = F.format_string("<?php\n\nclass Service%d extends Service%d\n{\n    public const LIMIT = %d;\n\n    public function run%d(): int\n    {\n        return helper%d(self::LIMIT);\n    }\n}\n\nfunction helper%d(int $value): int\n{\n    return (new Service%d())->run%d();\n}\n", i, F.col("a"), i, i, F.col("b"), i, i, i)
    kind = F.pmod(i, F.lit(3))
    suffix = F.when(kind == 0, ".py").when(kind == 1, ".ts").otherwise(".php")
    language = F.when(kind == 0, "python").when(kind == 1, "typescript").otherwise("php")
    content = F.when(kind == 0, py).when(kind == 1, ts).otherwise(php)
    return rows.select(F.concat(folder, F.format_string("/mod%d", i), suffix).alias("path"), language.alias("language"), content.alias("content"))
