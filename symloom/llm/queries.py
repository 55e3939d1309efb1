"""The queries of this subpackage, for the entry module: one per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, knn, licenses, mixing, ppm, quality, secrets, simhash, suffixes, toxicity
from ._common import read_table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_matches(read_table(spark, sf_dir, "documents"), overlapping=False)
    told = F.transform("matches", lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string"), F.round(x["coverage"], 4).cast("string")))
    return found.select(
        "doc_id",
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct("matches.license")), ",").alias("licenses"),
        F.array_join(told, ",").alias("spans"),
    )


def op3_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        "contaminated",
    )


def op5_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.scores(read_table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.without_repeats(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(read_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["rank"] < len(secrets.BASE))
    return found.select(
        "doc_id",
        *[F.size(r.kind).cast("long").alias(f"n_{r.kind}") for r in secrets.BASE],
        F.sha2(secrets.as_text(base), 256).alias("base_sha256"),
        secrets.as_text(F.col("spans")).alias("spans"),
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_licenses, op3_knn, op4_decontaminate, op5_ppm, op6_simhash, op7_suffixes, op8_mixing, op9_secrets, op10_quality)}
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ORACLES: dict[str, str] = {}
ORACLES["op3_knn"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.e, d.e) AS BIGINT) AS score FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
ORACLES["op4_decontaminate"] = rf"""
WITH items AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOW}, '{_WORD}') AS w FROM benchmark WHERE item_id IS NOT NULL),
pats AS (SELECT DISTINCT item, least(len(w), 8) AS k, array_to_string(w[i : i + least(len(w), 8) - 1], ' ') AS s
         FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 8) + 2)) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOW}, '{_WORD}') AS w FROM documents),
wins AS (SELECT r, i, k, array_to_string(w[i : i + k - 1], ' ') AS s
         FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM pats) WHERE len(w) >= k)),
occ AS (SELECT r, i, wins.k, item FROM wins JOIN pats USING (k, s)),
hits AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + k)) AS j FROM occ) GROUP BY r),
own AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM occ) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hits.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(own.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(own.n, 0) >= 2 AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN own USING (r)
"""


def _spans_sql() -> str:
    parts = []
    for i, r in enumerate(secrets.RULES):
        p = r.pattern.replace("'", "''")
        good = f"length(regexp_extract_all(t, '{p}', {r.group})[i]) >= {r.least}"
        parts.append(
            f"SELECT r, {i} AS rank, '{r.kind}' AS kind, a AS s, a + length(m[i]) AS e FROM (SELECT r, t, m, i, "
            f"list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a "
            f"FROM (SELECT r, t, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT r, t, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS g FROM docs))) WHERE {good}"
        )
    return " UNION ALL ".join(parts)


ORACLES["op9_secrets"] = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({_spans_sql()}),
own AS (SELECT r, count(*) FILTER (WHERE rank = 0) AS n0, count(*) FILTER (WHERE rank = 1) AS n1, count(*) FILTER (WHERE rank = 2) AS n2,
  string_agg(concat(kind, ':', CAST(s AS BIGINT), ':', CAST(e AS BIGINT)), ',' ORDER BY s, rank) FILTER (WHERE rank < 3) AS base,
  string_agg(concat(kind, ':', CAST(s AS BIGINT), ':', CAST(e AS BIGINT)), ',' ORDER BY s, rank) AS every FROM spans GROUP BY r)
SELECT doc_id, CAST(coalesce(n0, 0) AS BIGINT) AS n_assign, CAST(coalesce(n1, 0) AS BIGINT) AS n_access, CAST(coalesce(n2, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
FROM docs LEFT JOIN own USING (r)
"""

_MIX = mixing.MixParams()
ORACLES["op8_mixing"] = f"""
WITH RECURSIVE counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
par AS (SELECT greatest({_MIX.slots}, count(*)) AS slots, sum(sqrt(n)) AS total FROM counts),
exact AS (SELECT source, n, sqrt(n) / total * slots AS x, slots FROM counts, par),
base AS (SELECT source, n, x, slots, greatest(1, CAST(floor(x) AS BIGINT)) AS q0 FROM exact),
quota AS (SELECT source, n, slots, q0 + CASE WHEN row_number() OVER (ORDER BY floor(x) - x, source NULLS FIRST) <= slots - sum(q0) OVER () THEN 1 ELSE 0 END AS q FROM base),
named AS (SELECT source, n, slots, q, row_number() OVER (ORDER BY source NULLS FIRST) AS i FROM quota),
lists AS (SELECT list(q ORDER BY i) AS qs, any_value(slots) AS slots FROM named),
run AS (
  SELECT 0 AS t, 0 AS i, 0 AS k, list_transform(qs, lambda x: 0) AS done FROM lists
  UNION ALL
  SELECT t + 1, pick, done[pick] + 1, list_transform(done, lambda x, j: CASE WHEN j = pick THEN x + 1 ELSE x END)
  FROM (SELECT t, done, list_min(list_filter(list_transform(range(1, len(qs) + 1), lambda j: CASE WHEN done[j] < qs[j] AND (done[j] * slots) // qs[j] <= t
        THEN ((done[j] + 1) * slots + qs[j] - 1) // qs[j] * 100000 + j END), lambda x: x IS NOT NULL)) % 100000 AS pick, slots FROM run, lists WHERE t < slots)),
slot AS (SELECT i, k - 1 AS j, t - 1 AS slot FROM run WHERE t > 0),
ends AS (SELECT min((n // {_MIX.block}) // q * slots + slot) AS e FROM named JOIN slot USING (i) WHERE j = (n // {_MIX.block}) % q),
ranked AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id NULLS FIRST) - 1 AS k FROM documents)
SELECT doc_id, r.source, k // {_MIX.block} AS mix_block, (k // {_MIX.block}) * slots // q AS mix_release,
  ((k // {_MIX.block} + 1) * slots + q - 1) // q AS mix_deadline, CAST((k // {_MIX.block}) // q * slots + slot AS BIGINT) AS mix_slot,
  CAST(k % {_MIX.block} AS INTEGER) AS mix_place, (k // {_MIX.block}) // q * slots + slot < e AS in_mix
FROM ranked r JOIN named d ON r.source IS NOT DISTINCT FROM d.source JOIN slot ON slot.i = d.i AND slot.j = (k // {_MIX.block}) % q, ends
"""
