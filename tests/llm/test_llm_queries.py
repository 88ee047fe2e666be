"""The registered queries and the pipeline, on the smallest tables and on odd rows."""

import glob
import hashlib
import os
import zlib

import duckdb
import public_tokenizers
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from check import rows_of
from lacuna.llm import sentence_pieces, toxicity
from lacuna.llm.queries import ORACLES, QUERIES

from llm_support import given_labels, no_docs, odd, odd_rows  # noqa: F401
from test_llm_decontaminate import brute as brute_hits
from test_llm_dedup import bare, brute_components, brute_print

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries())
    assert set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, db, name):
    df = QUERIES[name](spark, SF_DIR)
    cur = db.execute(ORACLES[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"op7_chat"}))
def test_one_row_per_document(spark, db, name):
    rows = QUERIES[name](spark, SF_DIR).collect()
    assert sorted(r.doc_id for r in rows) == sorted(i for (i,) in db.execute("SELECT doc_id FROM documents").fetchall())


# Functions of texts in the final plan of each query or stage: none stands there twice for one scan.
TEXT_FUNCTIONS = {"op10_sentence_pieces": 2, "op2_exact_dedup": 0, "op1_simhash": 0}


@pytest.mark.parametrize("name", sorted(TEXT_FUNCTIONS))
def test_a_text_is_encoded_once(spark, name):
    """Encoding and decoding are a step each; fingerprints and digests are read from where they were written."""
    text = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    steps = [line for line in text.splitlines() if "ArrowEvalPython" in line and "run(" in line]
    assert len(steps) == TEXT_FUNCTIONS[name] and not any("run(run(" in line for line in steps)


def test_stages_look_at_a_text_once(spark, tmp_path):
    """No filter repeats the function that a stage takes of a text."""
    docs = spark.createDataFrame([(k, f"text number {k % 7} of some words", None) for k in range(40)], "doc_id bigint, text string, lang string")
    docs.write.parquet(f"{tmp_path}/docs.parquet")
    docs = spark.read.parquet(f"{tmp_path}/docs.parquet")
    for name, step in corpus_pipeline.STAGES:
        if name in ("simhash", "exact_dedup", "sentence_pieces"):
            text = step(spark, docs, SF_DIR)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
            for one in text.split("FileScan")[:-1]:
                calls = [c for c in ("prints(text", "flagged(text", "run(text") for _ in range(one.count(c))]
                assert len(calls) <= 2 * len(set(calls)) and "isnotnull(prints" not in one, name


def test_simhash(spark, db):
    docs = db.execute("SELECT doc_id, text FROM documents").fetchall()
    prints = {i: brute_print(t) for i, t in docs}
    root = brute_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op1_simhash"](spark, SF_DIR).collect()}
    assert got == {i: (f"{prints[i]:016x}", root[i]) for i in prints}


def test_pipeline(spark, db):
    """Every stage against brute force, on what the stage before it keeps; the model is the stage's own."""
    docs = dict(db.execute("SELECT doc_id, text FROM documents").fetchall())
    learn = db.execute("SELECT doc_id, text, toxic FROM documents JOIN labels USING (doc_id)").fetchall()
    sample = sorted((i, t, y) for i, t, y in learn if zlib.crc32(str(i).encode()) % 3 != 1 and len(t) <= toxicity.MAX_CHARS)
    ends, p, offsets = toxicity.fit([(t, y) for _, t, y in sample]).sentences(list(docs.values()))
    for i, e, o in zip(list(docs), ends, offsets):
        quiet = 1.0
        for x in p[o : o + len(e)]:
            quiet *= 1 - x
        if 1 - quiet >= toxicity.REJECT:
            del docs[i]
    groups = {}
    for i, t in docs.items():
        groups.setdefault(bare(t), []).append((-len(t), i))
    docs = {i: docs[i] for i in sorted(min(g)[1] for g in groups.values())}
    root = brute_components({i: brute_print(t) for i, t in docs.items()})
    docs = {i: docs[i] for i in sorted(set(root.values()))}
    items = db.execute("SELECT item_id, text FROM benchmark").fetchall()
    docs = {i: docs[i] for i, *_, dirty in brute_hits(docs.items(), items) if not dirty}

    got = contract.queries()["pipeline"](spark, SF_DIR).collect()
    assert {r.doc_id: r.text_sha256 for r in got} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in docs.items()}
    pieces = sentence_pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    for r in got:
        assert all(0 <= k < pieces.size for k in r.ids)


def test_stages_on_odd_rows(spark, odd, no_docs, given_labels, tmp_path):
    given_labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "a b"), (2, "no such words here")], "item_id bigint, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet"
    )
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        for docs in (odd, no_docs):
            out = step(spark, docs, str(tmp_path))
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns, name
            rows = out.collect()
            assert len(rows) <= docs.count() and (rows or not docs.count()), name
