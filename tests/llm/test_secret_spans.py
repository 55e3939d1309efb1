"""Spans of keys and of passwords in URLs are whole."""

from __future__ import annotations

from symloom.llm import secrets

from .texts import DOCS

BODY = "\n".join("aB3+" * 16 for _ in range(30))
KEY = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A\n\n{BODY}\nqQ==\n"
END = "-----END RSA PRIVATE KEY-----"
TEXTS = [f"a {KEY}{END} b", f"a {KEY}", "x https://me:" + "tK" * 60 + "@host y", "x redis://:password@host y"]


def test_whole_secrets_are_replaced(spark):
    docs = spark.createDataFrame([(i, t, "s", "x", 0.0) for i, t in enumerate(TEXTS)], DOCS)
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert clean == {0: "a [REDACTED] b", 1: "a [REDACTED]", 2: "x [REDACTED]host y", 3: "x [REDACTED]host y"}
