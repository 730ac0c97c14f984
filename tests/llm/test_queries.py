"""Queries against their SQL and against what labels say; the pipeline against its stages one by one."""

import re
import zlib

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from acctpulse.llm import secret_scan
from acctpulse.llm.queries import QUERIES
from acctpulse.llm.sql import all_sql
from acctpulse.session import materialize
from tools.compare import key, plain

duckdb = pytest.importorskip("duckdb")
SMALL = "/root/testdata/sf0.01"


def connection(directory):
    con = duckdb.connect()
    for t in "documents benchmark labels".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{directory}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", all_sql())
def test_query_equals_sql(spark, data, name):
    result = connection(data).execute(all_sql()[name])
    columns = sorted(d[0] for d in result.description)
    at = [[d[0] for d in result.description].index(c) for c in columns]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=key)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in QUERIES[name](spark, data).collect()), key=key)
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs):
        assert all(x == y or (isinstance(x, float) and x == pytest.approx(y, rel=1e-9)) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize(("name", "label", "least"), [("op5_quality_model", "quality", 0.95), ("op8_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, data, name, label, least):
    rows = {r.doc_id: r for r in QUERIES[name](spark, SMALL).collect()}
    known = connection(SMALL).execute(f"SELECT doc_id, {label} FROM labels WHERE {label} IS NOT NULL").fetchall()
    held = [(rows[d].predicted, y) for d, y in known if d in rows and rows[d].held_out]
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 for d, r in rows.items())
    assert len(held) > 30 and sum(p == y for p, y in held) >= least * len(held)


def test_secrets_of_a_document_by_plain_patterns(spark, data):
    """Base spans by one pattern at a time, without the operator's worklist."""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in QUERIES["op3_secret_scan"](spark, data).collect():
        t = texts[r.doc_id]
        assert r.n_assign == sum(len(m[2]) >= 8 for m in assign.finditer(t))
        assert r.n_access == sum(len(m[0]) >= 20 for m in re.finditer("AKIA[A-Z0-9]+", t))
        assert r.n_hex == sum(len(m[0]) >= 32 for m in re.finditer("[0-9a-f]+", t))


def test_pipeline(spark, data):
    """Each stage's decisions follow from its input, and take effect."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    con = connection(data)
    stages = dict(corpus_pipeline.STAGES)
    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({all_sql()['op9_quality_rules']}) WHERE kept").fetchall()}
    ruled = materialize(stages["quality rules"](spark, docs, data), "ruled")
    assert {r.doc_id for r in ruled.collect()} == kept
    single = materialize(stages["near duplicates"](spark, ruled, data), "single")
    texts = [r.text for r in single.collect()]
    assert len(texts) == len(set(texts)) and 0 < len(texts) < len(kept)
    clean = materialize(stages["decontamination"](spark, single, data), "clean")
    con.register("single_rows", single.toPandas())
    leaky = all_sql()["op7_decontamination"].replace("FROM documents", "FROM single_rows")
    gone = {r[0] for r in con.execute(f"SELECT DISTINCT doc_id FROM ({leaky})").fetchall()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()} - gone
    safe = {r.doc_id: r for r in materialize(stages["secret scans"](spark, clean, data), "safe").collect()}
    for r in clean.collect():
        assert (safe[r.doc_id].text == r.text) == (not secret_scan.find(r.text) and not secret_scan.scan(r.text)[1])
        assert not secret_scan.find(safe[r.doc_id].text)
    mixed = entry.queries()["pipeline"](spark, data).collect()
    assert mixed and {r.doc_id for r in mixed} <= set(safe)
    assert all(r.text == safe[r.doc_id].text and 0 <= r.epoch < 3 for r in mixed)
    assert [r.due for r in mixed] == sorted(r.due for r in mixed) or len({(r.doc_id, r.epoch) for r in mixed}) == len(mixed)
