"""The pipeline against its stages done one by one in Python, and the registered queries over the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from stringloom.llm import decontam, simhash

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")


def test_pipeline(spark):
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by doc_id").fetchall()
    bench = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    found = corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    left = {r.doc_id for r in found.select("doc_id").collect()}
    assert len(left) == len(docs)  # these are all in some language
    groups: dict = {}
    for i, t in docs:
        groups.setdefault("".join(t.split()), []).append((-len(t), i, t))
    kept = sorted((min(g)[1], min(g)[2]) for g in groups.values())
    prints = [simhash.fingerprint(t, corpus_pipeline.SHINGLE) for _, t in kept]
    root = list(range(len(kept)))
    for a in range(len(kept)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= 4:
                low, high = sorted((root[a], root[b]))
                root = [low if x == high else x for x in root]
    kept = [x for i, x in enumerate(kept) if root[i] == i]
    items = [decontam.words_of(t) for _, t in bench]
    holds = lambda words: any(words[i : i + len(w)] == w for w in items for i in range(len(words) - len(w) + 1))
    expected = {i for i, t in kept if not holds(decontam.words_of(t))}
    result = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in result} == expected and len(result) == len(expected)
    assert all(r.n_tokens * 4 == len(r.ids) for r in result)


def test_operators_are_registered(spark):
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names


@pytest.mark.parametrize("name", ["op6_url_filter", "op7_decontamination", "op9_simhash"])
def test_queries_run(spark, name):
    df = entry.queries()[name](spark, SF)
    assert df.count() > 0


@pytest.mark.parametrize("name", ["op3_exact_dedup", "op11_vector_codes", "op13_filter_audit"])
def test_queries_equal_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "embeddings", "labels"):
        db.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    sql = sorted(map(str, db.sql(entry.oracle_sql()[name]).fetchall()))
    assert sql == sorted(str(tuple(r)) for r in entry.queries()[name](spark, SF).collect())
