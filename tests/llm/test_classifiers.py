from __future__ import annotations

import os

import pytest

from symloom.llm import queries, quality, toxicity

from .texts import DOCS

SF = "/root/testdata/sf0.1"  # the smaller tables hold too few labelled texts to learn from


def held_out_auc(scored, labels, name):
    rows = scored.filter("held_out").join(labels.filter(f"{name} is not null"), "doc_id").select("score", name).collect()
    pos, neg = ([r[0] for r in rows if r[1] == y] for y in (1, 0))
    assert pos and neg
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("query,name,least", [(queries.op1_toxicity, "toxic", 0.95), (queries.op10_quality, "quality", 0.95)])
def test_held_out(spark, query, name, least):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = query(spark, SF)
    assert scored.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert held_out_auc(scored, labels, name) >= least
    assert scored.filter("score < 0 or score > 1 or score is null or predicted <> cast(score >= 0.3 as int)").count() == 0


@pytest.mark.parametrize("run", [toxicity.toxicity_scores, quality.quality_scores])
def test_defined_cases(spark, run):
    labels = spark.createDataFrame([(1, None, None), (2, 1, 1), (2, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, None, "s", "x", 9.0), (1, "", "s", "x", 9.0), (None, "a b", "s", "x", 9.0), (2, "a b " * 5000, "s", "x", 9.0)], DOCS)
    got = run(docs, labels).collect()
    assert len(got) == 4 and all(0 <= r["score"] <= 1 for r in got)
    assert run(docs, labels.limit(0)).count() == 4
    assert run(docs.limit(0), labels).count() == 0
