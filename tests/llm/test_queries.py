"""Every registered query over the smallest tables: against its SQL, or against a plain version."""

import collections
import hashlib
import os
import zlib

import corpus_pipeline
import duckdb
import pytest

from readingforge.llm import queries

from .test_text_models import plain_findings

SF = "/root/testdata/sf0.001"
TABLES = "documents benchmark labels".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows_of(duck, sql):
    got = duck.execute(sql)
    names = [d[0] for d in got.description]
    return [dict(zip(names, r)) for r in got.fetchall()]


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", [*sorted(queries.ORACLE_SQL), "pipeline"])
def test_against_sql(spark, duck, name):
    query, sql = (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL) if name == "pipeline" else (queries.QUERIES[name], queries.ORACLE_SQL[name])
    out, want = query(spark, SF), rows_of(duck, sql)
    assert sorted(out.columns) == sorted(want[0])
    same = lambda rows: sorted([plain(r[c]) for c in sorted(out.columns)] for r in rows)
    assert same(out.collect()) == same(want)


@pytest.fixture(scope="module")
def docs(duck):
    return {r["doc_id"]: r for r in rows_of(duck, "SELECT * FROM documents")}


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_languages(spark, docs):
    got = {r.doc_id: r for r in queries.op1_language_id(spark, SF).collect()}
    assert set(got) == set(docs) and all(r.held_out == held_out(i) and 0 <= r.score <= 1 for i, r in got.items())
    langs = {d["lang"] for d in docs.values() if d["lang"]}
    for i, r in got.items():
        assert r.lang_pred in (langs if any(c.isalpha() for c in docs[i]["text"] or "") else {"und"})
    known = [i for i in got if held_out(i) and docs[i]["lang"] and len(docs[i]["text"] or "") > 50]
    assert known and sum(got[i].lang_pred == docs[i]["lang"] for i in known) >= 0.95 * len(known)


def test_quality(spark, duck, docs):
    got = {r.doc_id: r for r in queries.op3_quality(spark, SF).collect()}
    assert set(got) == set(docs) and all(r.held_out == held_out(i) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in got.items())
    labels = {r["doc_id"]: r["quality"] for r in rows_of(duck, "SELECT * FROM labels") if held_out(r["doc_id"]) and r["doc_id"] in got}
    good, bad = ([got[i].score for i, y in labels.items() if y == k] for k in (1, 0))
    assert sum(a > b for a in good for b in bad) >= 0.9 * len(good) * len(bad)


def test_token_counts(spark, docs, monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op4_token_counts(spark, SF).collect()}
    n = {i: len(t.encode(d["text"] or "", add_special_tokens=False).ids) for i, d in docs.items()}
    assert got == {i: (len((d["text"] or "").encode()), n[i], n[i] > 512) for i, d in docs.items()}


def test_pseudonyms(spark, docs):
    got = {r.doc_id: r for r in queries.op6_pseudonyms(spark, SF).collect()}
    assert set(got) == set(docs)
    kinds = [c for c in got[next(iter(got))].asDict() if c.startswith("n_")]
    shape = lambda t: "".join("0" if c in "0123456789" else "a" if c in "abcdefghijklmnopqrstuvwxyz" else "A" if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in t)
    for i, r in got.items():
        text = docs[i]["text"]
        assert (text is None) == (r.text is None)
        if not sum(r[k] for k in kinds):
            assert r.text == text
        elif not r.n_ip:  # an address may have shorter numbers
            assert r.text != text and shape(r.text) == shape(text)


def test_secrets(spark, docs):
    got = collections.defaultdict(list)
    for r in sorted(queries.op7_secret_scan(spark, SF).collect(), key=lambda r: (r.doc_id, r.n)):
        got[r.doc_id].append((r.candidate_sha256, r.length, r.before))
        assert 0 <= r.score <= 1 and r.is_secret == (r.score >= 0.5)
    want = {i: [(hashlib.sha256(c.encode()).hexdigest(), len(c), b) for c, b, _ in plain_findings(d["text"] or "")] for i, d in docs.items()}
    assert got == {i: found for i, found in want.items() if found}


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11)) and set(queries.ORACLE_SQL) <= set(queries.QUERIES)
