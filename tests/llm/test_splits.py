"""Rows stay whole when an input is split otherwise from one job to the next, as when executors come and go; and the pipeline's
stages on odd rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stringloom import tables
from stringloom.llm import exact_dedup, pii

SPLIT = "spark.sql.files.minPartitionNum"


@pytest.fixture
def resplit(spark, monkeypatch):
    """After each written table the next scans are cut into another number of splits."""
    made, before = [], spark.conf.get("spark.sql.files.openCostInBytes")

    def stash(df, name="table"):
        out = tables.stash(df, name)
        made.append(name)
        spark.conf.set(SPLIT, str((1, 5, 9)[len(made) % 3]))
        return out

    for module in (exact_dedup, pii, corpus_pipeline):
        monkeypatch.setattr(module, "stash", stash)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield made
    spark.conf.set("spark.sql.files.openCostInBytes", before)
    spark.conf.unset(SPLIT)


def docs(spark, path):
    rng = random.Random(3)
    words = [f"word{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(40)), "en", "web", 0) for i in range(400)]
    rows += [(1000 + i, f"alpha{i} zanzibar contact me@here.org now", "en", "web", 0) for i in range(8)]
    rows += rows[:50] + [(2000 + i, rows[i][1], "en", "web", 0) for i in range(50)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(12).write.parquet(str(path))
    return spark.read.parquet(str(path)), rows


def test_operators(spark, resplit, tmp_path):
    df, rows = docs(spark, tmp_path / "docs")
    found = exact_dedup.duplicates(df).collect()
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in rows) and sum(r.kept for r in found) == len({r[1] for r in rows})
    spans = pii.find(df).collect()
    assert Counter(r.doc_id for r in spans) == Counter(r[0] for r in rows)
    assert all((len(r.base), any(x.kind == 5 for x in r.spans)) == ((1, True) if 1000 <= r.doc_id < 1010 else (0, False)) for r in spans)
    assert len(resplit) > 5


def test_stages(spark, resplit, tmp_path):
    df, rows = docs(spark, tmp_path / "docs")
    for stage in (corpus_pipeline.exact_duplicates, corpus_pipeline.near_duplicates):
        kept = stage(spark, df, "").collect()
        assert len({r.text for r in kept}) == len(kept) and {r.text for r in kept} <= {r[1] for r in rows}
        assert all(r.doc_id < 2000 for r in kept)
    assert len(corpus_pipeline.exact_duplicates(spark, df, "").collect()) == len({r[1] for r in rows})


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, repeated rows and ids, ties, a very long text, a column with a clashing name, and an empty table."""
    kind = "doc_id long, text string, lang string, source string, n_chars long, row long, key string"
    rng = random.Random(4)
    # Each stage on its own: long words only, so that texts differ in many shingles.
    text = {i: " ".join("".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(60)) for i in range(30)}
    rows = [(i, t, "en" if i % 2 else None, None, None, 1, "x") for i, t in text.items()]
    rows += [(None, None, None, None, None, None, None), (70, None, "en", "a", 0, 1, "x"), (71, "", "en", "a", 0, 1, "x"), rows[3], (3, text[4], "en", "b", 1, 1, "y")]
    rows += [(80, text[5] + " ", "en", "b", 1, 1, "y"), (81, "long words " * 100_000, "en", "b", 1, 1, "y"), (82, "12 34", "en", "b", 1, 1, "y")]
    spark.createDataFrame([(1, "benchmark item of words that nobody else has written down here")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = spark.createDataFrame(rows, kind)
    exact = corpus_pipeline.exact_duplicates(spark, df, "").collect()
    normal = lambda t: "".join((t or "").split())
    assert Counter(normal(r.text) for r in exact) == Counter({normal(r[1]) for r in rows}) and exact[0].asDict().keys() == set(df.columns)
    assert {r.doc_id for r in exact if normal(r.text) == text[5].replace(" ", "")} == {80} and {r.doc_id for r in exact if r.text == text[4]} == {3}
    near = corpus_pipeline.near_duplicates(spark, df, "").collect()
    assert Counter(normal(r.text) for r in near) == Counter({normal(r[1]) for r in rows})
    clean = corpus_pipeline.decontamination(spark, df, str(tmp_path)).collect()
    assert Counter(map(tuple, clean)) == Counter(rows)
    languages = corpus_pipeline.language_id(spark, df, "").collect()
    assert Counter(r.doc_id for r in languages) == Counter(r[0] for r in rows if normal(r[1]) not in ("", "1234"))
    tokens = corpus_pipeline.bpe_tokens(spark, df, "").collect()
    assert len(tokens) == len(rows) and {r.n_tokens for r in tokens if r.doc_id in (70, 71, None)} == {0}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0
