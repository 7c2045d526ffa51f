"""Scores and tags."""

import math

import pytest
from pyspark.sql import functions as F

from stringloom.functions import capabilities
from stringloom.functions.text import BEGIN, END, quality, tags, trigram_scores
from stringloom.sources.inputs import trigram_model


def test_quality(spark):
    expected = {"": 0, "Hello, world!": 0.724260, "kernel32.dll": 0.779167, "InitializeCriticalSection": 0.712, "AAAAAAAA": 0.125, "////////": 0.05, "++++++++++": 0.04, "AWAVAUATSH": 0.82, "HTTP": 0.95}
    df = spark.createDataFrame([(k,) for k in expected], "v string")
    assert {r.v: round(r.q, 6) for r in df.select("v", quality(F.col("v")).alias("q")).collect()} == {k: pytest.approx(v, abs=1e-6) for k, v in expected.items()}


def test_tags(spark):
    expected = {
        "HTTP://a": ["url"], "httpx://a": [], "1.2.3.4": ["ip_address"], "01.2.3.4": [], "1.2.3.256": [], "::1": ["ip_address"], "1:2:3:4:5:6:7:8": ["ip_address"], "1::2::3": [], ":1": [], "::": ["ip_address"],
        "::ffff:1.2.3.4": ["ip_address"], "1:2": [], "fe80::1%eth0": [], "a@b.c": ["email"], "a@b": [], "a@b@c.d": [], "a b@c.d": [], "a@.c": [], "/etc": ["path"], "C:\\x": ["path"], "C:": [], "hklm\\x": ["registry"], "HKEY_X": ["registry"],
    }
    df = spark.createDataFrame([(k,) for k in expected], "v string")
    assert {r.v: r.t for r in df.select("v", tags(F.col("v")).alias("t")).collect()} == expected


def test_trigrams(spark):
    lines = ["# Model Type: lowercase", "[^]\th\te\t100", "h\te\tl\t100", "e\tl\tl\t100", "l\tl\to\t100", "l\to\t[$]\t100", "x\ty\tz\t1", "x\ty\tz\t0"]
    model = trigram_model(spark.createDataFrame([(x,) for x in lines], "value string")).cache()
    assert {r.lowercase for r in model.collect()} == {True} and {r.gram: r.n for r in model.collect()}[BEGIN + "he"] == 100 and {r.gram: r.n for r in model.collect()}["xyz"] == 2
    values = spark.createDataFrame([(x,) for x in ("hello", "HELLO", "qzxvk", "hi", "你好世界")], "value string")
    got = {r.value: r.trigram_score for r in trigram_scores(values, model).collect()}
    cased = trigram_model(spark.createDataFrame([(x,) for x in lines[1:]], "value string"))
    other = {r.value: r.trigram_score for r in trigram_scores(values, cased).collect()}
    assert other["hello"] == pytest.approx(got["hello"]) and other["HELLO"] < other["hello"]
    assert got["hello"] == got["HELLO"] > got["qzxvk"] and got["hi"] is None and got["你好世界"] is None
    assert got["hello"] == pytest.approx(math.log10(101 / (502 + 130**3))) and END not in "hello"
    with pytest.raises(Exception, match="malformed model line"):
        trigram_model(spark.createDataFrame([("oops",)], "value string")).collect()


def test_capabilities():
    known = dict(capabilities.rows())
    for name, tag in {"HeapAlloc": "alloc", "memcpy": "memcpy", "WSAStartup": "network", "CreateFileA": "filesystem", "RegOpenKeyExA": "registry", "CreateRemoteThread": "process", "BCryptDecrypt": "crypto", "LoadLibraryA": "loader", "IsDebuggerPresent": "debug", "VirtualAllocEx": "alloc"}.items():
        assert known[name.lower()] == f"calls_{tag}"
    assert len(known) == 222


def test_quality_of_the_scan_equals_the_expression(spark):
    """Any text, also beyond ASCII and in slices of a column."""
    import random

    import pyarrow as pa

    from stringloom.operators.runs import qualities

    rng = random.Random(8)
    values = ["".join(rng.choice(["a", "Z", "7", " ", "é", "€", "😀", "\t", "."]) * rng.choice([1, 1, 1, 9]) for _ in range(rng.randrange(1, 20))) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "v string").select(quality(F.col("v")).alias("q"))
    expected = [r.q for r in df.collect()]
    assert qualities(pa.array(values)).tolist() == expected
    assert qualities(pa.array(values).slice(50, 30)).tolist() == expected[50:80]
    assert qualities(pa.array([], pa.string())).tolist() == [] and qualities(pa.array(["", ""])).tolist() == [0.0, 0.0]
