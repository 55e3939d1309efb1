"""Queries of fact matching and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facts as E
from ..operators import metrics as M
from .base import query, rounded

#: The lines of parts as candidates' definitions, moved by a line for every seventh in the oracle.
_FACTS = """nav AS (SELECT * FROM sym WHERE NOT is_local AND NOT is_synthetic AND kind <> 'unknown'),
c AS (SELECT DISTINCT path, name_start_line AS line, kind FROM nav),
o AS (SELECT DISTINCT path, name_start_line AS line, CASE WHEN CAST(id AS BIGINT) % 7 = 0 THEN 'macro' ELSE kind END AS kind FROM nav WHERE CAST(id AS BIGINT) % 11 <> 0)"""


def _sides(t):
    c = E.definition_facts(t.symbols)
    key = F.col("id").cast("long")
    moved = t.symbols.filter(key % 11 != 0).withColumn("kind", F.when((key % 7 == 0) & (F.col("kind") != "unknown"), "macro").otherwise(F.col("kind")))
    return c, E.definition_facts(moved)


def _counts(t):
    return E.by_path(E.match_facts(*_sides(t), policy="exact"))


_BY_PATH = f"""WITH {_FACTS}, hit AS (SELECT path, line, kind FROM c INTERSECT SELECT path, line, kind FROM o),
ever AS (SELECT path FROM c UNION SELECT path FROM o),
counts AS (SELECT e.path, CAST((SELECT count(*) FROM hit h WHERE h.path = e.path) AS BIGINT) AS tp, CAST((SELECT count(*) FROM c WHERE c.path = e.path) AS BIGINT) AS n_c, CAST((SELECT count(*) FROM o WHERE o.path = e.path) AS BIGINT) AS n_o FROM ever e)"""


@query(f"{_BY_PATH} SELECT path, tp, n_c - tp AS fp, n_o - tp AS fn FROM counts")
def match_definitions(t):
    return _counts(t).select("path", *[F.col(x).cast("long").alias(x) for x in ("tp", "fp", "fn")])


@query(f"""{_BY_PATH}, s AS (SELECT sum(tp) AS tp, sum(n_c) AS n_c, sum(n_o) AS n_o FROM counts)
SELECT CAST(tp AS BIGINT) AS tp, CAST(n_c - tp AS BIGINT) AS fp, CAST(n_o - tp AS BIGINT) AS fn, round(tp / n_c, 9) AS precision, round(tp / n_o, 9) AS recall, round(2 * tp / (n_c + n_o), 9) AS f1 FROM s""")
def pooled_score(t):
    return M.pooled(_counts(t)).select("tp", "fp", "fn", rounded("precision"), rounded("recall"), rounded("f1"))


@query(f"""{_BY_PATH}, s AS (SELECT sum(tp) AS tp, sum(n_c) AS n_c, sum(n_o) AS n_o FROM counts)
SELECT path, round((s.tp - c.tp) / nullif(s.n_c - c.n_c, 0), 9) AS precision, round((s.tp - c.tp) / nullif(s.n_o - c.n_o, 0), 9) AS recall FROM counts c, s""")
def leave_one_out(t):
    return M.jackknife(_counts(t)).select("path", rounded("precision"), rounded("recall"))


_OUT = "WITH out AS (SELECT l_discount * 10 AS confidence, l_returnflag = 'R' OR l_discount > 0.05 AS correct FROM lineitem WHERE l_discount <= 0.1)"


def _outcomes(t):
    d = F.col("l_discount")
    return t["lineitem"].filter(d <= 0.1).select(F.least(d * 10, F.lit(1.0)).alias("confidence"), ((F.col("l_returnflag") == "R") | (d > 0.05)).alias("correct"))


_BINS = """edges(bin, low, high) AS (VALUES (0, 0.0, 0.45), (1, 0.45, 0.65), (2, 0.65, 0.8), (3, 0.8, 0.875), (4, 0.875, 0.925), (5, 0.925, 0.975), (6, 0.975, 1.0001)),
bins AS (SELECT bin, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high, count(confidence) AS "count", count(*) FILTER (WHERE correct) AS correct, avg(confidence) AS mean_confidence FROM edges LEFT JOIN out ON confidence >= low AND confidence < high GROUP BY 1, 2, 3)"""


@query(f"""{_OUT}, {_BINS} SELECT bin, low, high, "count", correct, round(mean_confidence, 9) AS mean_confidence, round(correct / nullif("count", 0), 9) AS precision FROM bins""", prelude=None)
def calibration(t):
    return M.calibration_bins(_outcomes(t)).select("bin", "low", "high", "count", "correct", rounded("mean_confidence"), rounded("precision"))


@query(f"""{_OUT}, {_BINS} SELECT round(sum("count" * abs(mean_confidence - correct / "count")) / sum("count"), 9) AS ece, round(max(abs(mean_confidence - correct / "count")), 9) AS max_gap, CAST(sum("count") AS BIGINT) AS n FROM bins WHERE "count" > 0""", prelude=None)
def calibration_error(t):
    return M.calibration_error(M.calibration_bins(_outcomes(t))).select(rounded("ece"), rounded("max_gap"), "n")


@query(f"""{_OUT}, per AS (SELECT round(confidence, 6) AS threshold, count(*) FILTER (WHERE correct) AS tp, count(*) AS n FROM out GROUP BY 1),
run AS (SELECT threshold, CAST(sum(tp) OVER (ORDER BY threshold DESC) AS BIGINT) AS tp, CAST(sum(n) OVER (ORDER BY threshold DESC) AS BIGINT) AS n FROM per)
SELECT threshold, tp, n - tp AS fp, round(tp / n, 9) AS precision FROM run""", prelude=None)
def precision_recall(t):
    out = _outcomes(t).withColumn("confidence", F.round("confidence", 6))
    total = out.agg(F.count(F.when(F.col("correct"), 1)).alias("total"))
    return M.pr_curve(out, total).select("threshold", "tp", "fp", rounded("precision"))


_RUNS = "WITH runs AS (SELECT o_custkey AS task, CASE o_orderkey % 2 WHEN 0 THEN 'grep' ELSE 'index' END AS arm, o_orderstatus <> 'P' AS ok, o_totalprice AS metric FROM orders)"


def _runs(t):
    return t["orders"].select(F.col("o_custkey").alias("task"), F.when(F.col("o_orderkey") % 2 == 0, "grep").otherwise("index").alias("arm"), (F.col("o_orderstatus") != "P").alias("ok"), F.col("o_totalprice").alias("metric"))


@query(f"{_RUNS} SELECT arm, round(avg(metric), 4) AS mean, count(*) AS runs FROM runs WHERE ok GROUP BY arm", prelude=None)
def arm_means(t):
    return M.arm_means(_runs(t)).select("arm", rounded("mean", 4), "runs")


@query(f"""{_RUNS}, m AS (SELECT task, avg(metric) FILTER (WHERE arm = 'grep') AS a, avg(metric) FILTER (WHERE arm = 'index') AS b FROM runs WHERE ok GROUP BY task)
SELECT task, round(b - a, 4) AS delta FROM m WHERE a IS NOT NULL AND b IS NOT NULL""", prelude=None)
def paired_delta(t):
    return M.paired(_runs(t), "grep", "index").select("task", rounded("delta", 4))


@query("""WITH a AS (SELECT src_id, dst_id, kind FROM edge WHERE confidence > 0.95), b AS (SELECT src_id, dst_id, kind FROM edge WHERE confidence < 0.97)
SELECT *, 'first' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'second' AS side FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def cross_check(t):
    e = t.edges.select("src_id", "dst_id", "kind", "confidence")
    return E.differences(e.filter("confidence > 0.95").drop("confidence"), e.filter("confidence < 0.97").drop("confidence"))


@query("""WITH s AS (SELECT kind AS shape, count(*) AS candidates, count(*) FILTER (WHERE id IN (SELECT dst_id FROM edge WHERE kind = 'calls')) AS seen FROM sym GROUP BY 1)
SELECT shape, candidates, seen, candidates >= 30 AND seen < candidates * 0.5 AS blind FROM s""")
def shape_coverage(t):
    seen = t.edges.filter("kind = 'calls'").select(F.col("dst_id").alias("id"))
    return E.shape_coverage(t.symbols.select(F.col("kind").alias("shape"), "id"), seen, ["id"], 30, 0.5)


def _reference_sides(t):
    """Edges as facts: the site's line stands for the place, the target's line for what is meant."""
    s = t.symbols.withColumns({"name_end_line": F.col("name_start_line"), "path": F.concat("path", F.lit("|"), "id")})
    spans = {"site_end_line": F.col("site_start_line"), "site_end_char": F.col("site_start_char") + 1}
    edges = t.edges.withColumns(spans).withColumn("site_path", F.concat("site_path", F.lit("|"), "src_id"))
    facts, dropped = E.reference_facts(s, edges)
    return facts, dropped


@query("""SELECT group_ AS kind, count(*) AS n FROM (SELECT CASE WHEN e.kind IN ('calls', 'references', 'uses_type', 'imports', 'inherits') THEN 'reference-like' ELSE e.kind END AS group_ FROM edge e JOIN sym d ON d.id = dst_id WHERE e.kind <> 'contains' AND site_path IS NOT NULL AND NOT d.is_synthetic AND NOT d.is_local AND d.kind <> 'unknown'
UNION ALL SELECT 'inheritance-like' FROM edge e JOIN sym d ON d.id = dst_id JOIN sym s ON s.id = src_id WHERE e.kind = 'inherits' AND NOT d.is_synthetic AND NOT s.is_synthetic AND NOT d.is_local AND d.kind <> 'unknown') GROUP BY 1""")
def reference_facts(t):
    return _reference_sides(t)[0].groupBy("kind").agg(F.count("*").alias("n"))


@query("""SELECT count(*) AS n FROM edge e LEFT JOIN sym d ON d.id = dst_id AND NOT d.is_synthetic WHERE e.kind <> 'contains' AND (d.id IS NULL OR (site_path IS NULL AND e.kind <> 'inherits'))""")
def edges_without_facts(t):
    return _reference_sides(t)[1].agg(F.count("*").alias("n"))


_CLAIMS = """c AS (SELECT DISTINCT concat(site_path, '|', src_id) AS p, site_start_line AS l, site_start_char AS ch, CASE WHEN e.kind IN ('calls', 'references', 'uses_type', 'imports', 'inherits') THEN 'reference-like' ELSE e.kind END AS k, dst_id FROM edge e JOIN sym d ON d.id = dst_id
 WHERE e.kind <> 'contains' AND site_path IS NOT NULL AND NOT d.is_synthetic AND NOT d.is_local AND d.kind <> 'unknown' UNION SELECT DISTINCT concat(s.path, '|', s.id), s.name_start_line, 0, 'inheritance-like', dst_id FROM edge e JOIN sym d ON d.id = dst_id JOIN sym s ON s.id = src_id WHERE e.kind = 'inherits' AND NOT d.is_synthetic AND NOT s.is_synthetic AND NOT d.is_local AND d.kind <> 'unknown'),
o AS (SELECT * FROM c WHERE CAST(dst_id AS BIGINT) % 11 <> 0)"""


@query(f"""WITH {_CLAIMS} SELECT CAST(count(*) FILTER (WHERE CAST(dst_id AS BIGINT) % 11 <> 0) AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE CAST(dst_id AS BIGINT) % 11 = 0) AS BIGINT) AS fp, CAST(0 AS BIGINT) AS fn FROM c""")
def match_references(t):
    facts = _reference_sides(t)[0].drop("confidence").distinct()
    oracle = facts.filter(F.substring_index("target_path", "|", -1).cast("long") % 11 != 0)
    return M.pooled(E.by_path(E.match_facts(facts, oracle, "exact", "site_"), "site_path")).select("tp", "fp", "fn")


_ANSWERS = """a AS (SELECT o_custkey AS task, CAST(o_orderkey % 40 AS INTEGER) AS line, CONCAT('f', o_orderkey % 3) AS path, o_orderkey FROM orders), truth AS (SELECT DISTINCT task, path, line AS id FROM a WHERE o_orderkey % 2 = 0), said AS (SELECT DISTINCT task, path, line AS id FROM a WHERE o_orderkey % 4 < 3)"""


@query(f"""WITH {_ANSWERS}, sr AS (SELECT task, avg(CASE WHEN id IN (SELECT id FROM said s WHERE s.task = t.task) THEN 1 ELSE 0 END) AS r FROM (SELECT DISTINCT task, id FROM truth) t GROUP BY task),
f AS (SELECT coalesce(t.task, s.task) AS task, count(*) FILTER (WHERE t.path IS NOT NULL AND s.path IS NOT NULL) AS b, count(t.path) AS tn, count(s.path) AS sn FROM (SELECT DISTINCT task, path FROM truth) t FULL JOIN (SELECT DISTINCT task, path FROM said) s ON s.task = t.task AND s.path = t.path GROUP BY 1)
SELECT task, round(r, 9) AS symbol_recall, round(CASE WHEN tn > 0 THEN b / tn ELSE 0 END, 9) AS file_recall, round(CASE WHEN sn > 0 THEN b / sn ELSE 0 END, 9) AS file_precision FROM sr JOIN f USING (task)""", prelude=None)
def location_scores(t):
    k = F.col("o_orderkey")
    own = t["orders"].select(F.col("o_custkey").alias("task"), (k % 40).cast("int").alias("id"), F.concat(F.lit("f"), k % 3).alias("path"), k.alias("k"))
    said = own.filter("k % 4 < 3").withColumn("ordinal", F.lit(0))
    return M.score_locations(said, own.filter("k % 2 = 0")).select("task", rounded("symbol_recall"), rounded("file_recall"), rounded("file_precision"))


@query("""WITH d AS (SELECT o_custkey AS task, o_orderkey // 7 AS line, o_orderkey FROM orders), a AS (SELECT DISTINCT task, line FROM d WHERE o_orderkey % 2 = 0), s AS (SELECT DISTINCT task, line FROM d WHERE o_orderkey % 3 = 0)
SELECT task, CAST(count(*) FILTER (WHERE b) AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE x AND NOT b) AS BIGINT) AS fp, CAST(count(*) FILTER (WHERE NOT x AND NOT b) AS BIGINT) AS fn FROM (SELECT coalesce(a.task, s.task) AS task, a.line IS NOT NULL AS x, a.line IS NOT NULL AND s.line IS NOT NULL AS b FROM a FULL JOIN s USING (task, line)) GROUP BY 1""", prelude=None)
def site_matches(t):
    """Exact lines only, which SQL can say; the slack is tested on a fixture."""
    k = F.col("o_orderkey")
    own = t["orders"].select(F.col("o_custkey").alias("task"), F.lit("p").alias("path"), F.floor(k / 7).cast("int").alias("line"), k.alias("k"))
    return E.slack_matches(own.filter("k % 2 = 0"), own.filter("k % 3 = 0"), 0)


@query("""WITH out AS (SELECT confidence, kind = 'calls' AS correct FROM edge WHERE confidence >= 0.9), b AS (SELECT avg(confidence) AS m, avg(CAST(correct AS INTEGER)) AS p, count(*) AS n, CASE WHEN confidence < 0.925 THEN 4 WHEN confidence < 0.975 THEN 5 ELSE 6 END AS bin FROM out GROUP BY 4)
SELECT bin, n AS "count" FROM b WHERE n >= 5 AND m - p > 0.1""")
def overconfident(t):
    out = t.edges.filter("confidence >= 0.9").select("confidence", (F.col("kind") == "calls").alias("correct"))
    return M.overconfident_bins(M.calibration_bins(out)).select("bin", "count")
