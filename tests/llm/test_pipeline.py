"""The pipeline and each of its stages: brute force on the smallest tables, and the defined cases."""

from __future__ import annotations

import os

import pytest

from symloom.llm import decontaminate, mixing, secrets, simhash, toxicity

from .test_scans import base_spans, words
from .test_similar import shingles
from .texts import DOCS

SF = "/root/testdata/sf0.001"
corpus_pipeline = pytest.importorskip("corpus_pipeline")


def components(texts: dict[int, str]) -> list[list[int]]:
    """Ids joined by a similarity of 0.8 or more between sets of 5-word shingles."""
    sets = {i: shingles(t) for i, t in texts.items()}
    ids, root = sorted(sets), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [[i for i in ids if find(i) == r] for r in ids if find(r) == r]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    scores = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity_scores(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    left = {r["doc_id"]: r["text"] for r in docs.collect() if not scores[r["doc_id"]]}
    left = {min(g): left[min(g)] for g in components(left)}
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r["text"])
        windows |= {tuple(w[k : k + 8]) for k in range(len(w) - 7)}
    left = {i: t for i, t in left.items() if not any(tuple((w := words(t))[k : k + 8]) in windows for k in range(len(words(t)) - 7))}
    assert set(got) == set(left)
    for i, t in left.items():
        assert ("[REDACTED]" in got[i]["text"]) >= bool(base_spans(t))
        if not base_spans(got[i]["text"]) and "[REDACTED]" not in got[i]["text"]:
            assert got[i]["text"] == t
    quota, at, end = mixing._plan(spark.createDataFrame([(i, r["source"]) for i, r in got.items()], "doc_id long, source string"), mixing.MixParams())
    block = mixing.MixParams().block
    for s in quota:
        own = sorted(((r["mix_block"], r["mix_place"]) for r in got.values() if r["source"] == s))
        assert own == [(k // block, k % block) for k in range(len(own))]
    period = sum(quota.values())
    for r in got.values():
        n, k = quota[r["source"]], r["mix_block"]
        assert r["mix_slot"] == k // n * period + at[r["source"]][k % n] and r["in_mix"] == (r["mix_slot"] < end)


CLASH = "_score double, _mark string, _kept_id long, _kept_of long, _spans int, _span_low string, _span_hex int, _hit boolean, _hash string, _bucket string, _rank int, _b int, _before int, _i int, _k int, _n int, _source string, row int, id string, of int, key int, mask int, body string, spans int, n int, k int, `a.b` int, score float, mark string, hash string, rank int, before int, none int, name string, bucket int, features int, sid int"
LONG = " ".join(f"word{i % 9973}" for i in range(60_000))


def stage_docs(spark):
    rows = [(1, "alpha beta gamma delta epsilon zeta", "s"), (2, None, "s"), (3, "", None), (4, LONG, "s"), (5, "my password = hunter22 is here to stay", "t"), (1, "alpha beta gamma delta epsilon zeta", "s"), (None, "no id at all but some words", "t"), (7, LONG + " one more", "t"), (8, " \t\n", "s"), (9, "the quick brown fox jumps over the lazy dog today", "s")]
    clash = [c.strip().split(" ")[0].strip("`") for c in CLASH.split(",")]
    kinds = [c.strip().split(" ")[1] for c in CLASH.split(",")]
    value = {"double": 0.5, "float": 0.25, "string": "kept", "long": 7, "int": 8, "boolean": True}
    docs = spark.createDataFrame([(*r, len(r[1] or ""), *[value[k] for k in kinds]) for r in rows], f"doc_id long, text string, source string, n_chars long, {CLASH}")
    return docs, clash


@pytest.fixture
def sf_dir(spark, tmp_path):
    spark.createDataFrame([(1, 0, 0), (5, 1, 1), (5, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    items = [(1, "quick brown fox jumps over the lazy dog today maybe"), (2, None), (3, "epsilon zeta"), (None, "alpha beta"), (4, "gamma"), (5, "here to")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


#: What each stage keeps of stage_docs: ids in order, null last.
KEPT = {
    "near_duplicates": [1, 2, 4, 5, 9, None],  # 3 and 8 are as empty as 2; 7 is like 4; the repeated row goes
    "decontaminate": [2, 3, 4, 5, 7, 8, None],  # 1 holds two short items, 9 a whole window; 5 holds one short item
    "secrets": [1, 1, 2, 3, 4, 5, 7, 8, 9, None],
    "mix": [1, 1, 2, 3, 4, 5, 7, 8, 9, None],
}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage(spark, sf_dir, name):
    docs, clash = stage_docs(spark)
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, sf_dir)
    assert out.columns[: len(docs.columns)] == docs.columns and (name == "mix" or out.columns == docs.columns)
    rows = out.collect()
    if name in KEPT:
        assert sorted((r["doc_id"] for r in rows), key=lambda i: (i is None, i or 0)) == KEPT[name]
    before = {(r["doc_id"], r["text"]): r for r in docs.collect()}
    for r in rows:
        was = before.get((r["doc_id"], r["text"]))
        if name == "secrets" and r["doc_id"] == 5:
            was = next(x for x in before.values() if x["doc_id"] == 5)
            assert r["text"] == "my [REDACTED] is here to stay" and r["n_chars"] == len(r["text"])
        else:
            assert r["text"] == was["text"] and r["n_chars"] == was["n_chars"]
        assert [r[c] for c in clash] == [was[c] for c in clash] and r["source"] == was["source"]
    empty = stage(spark, docs.limit(0), sf_dir)
    assert empty.columns == out.columns and empty.collect() == []


def test_mix_replaces_its_own_columns(spark):
    docs = spark.createDataFrame([(i, "t", "s", "old", 3) for i in range(5)], "doc_id long, text string, source string, mix_slot string, in_mix int")
    out = mixing.mixed(docs)
    assert out.columns == ["doc_id", "text", "source", *mixing.MIX] and dict(out.dtypes)["mix_slot"] == "bigint"


def test_operators_ignore_clashing_columns(spark, sf_dir):
    docs, _ = stage_docs(spark)
    bench, labels = spark.read.parquet(f"{sf_dir}/benchmark.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    for run in (simhash.near_duplicates, secrets.find_secrets, mixing.mix, lambda d: decontaminate.contamination(d, bench), lambda d: toxicity.toxicity_scores(d, labels)):
        assert run(docs).count() == docs.count()


def test_decontaminate_needs_a_whole_window(spark, sf_dir):
    """An item of few words that stands twice has as many hit words as a window, and is none."""
    docs = spark.createDataFrame([(1, "epsilon zeta and epsilon zeta and epsilon zeta and epsilon zeta", "s", "x", 0.0), (2, "x quick brown fox jumps over the lazy dog y", "s", "x", 0.0)], DOCS)
    assert [r["doc_id"] for r in dict(corpus_pipeline.STAGES)["decontaminate"](spark, docs, sf_dir).collect()] == [1]
