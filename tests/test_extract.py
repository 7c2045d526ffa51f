"""Byte literals and the strings in them."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from stringloom import catalogue
from stringloom.operators import runs
from stringloom.operators import strings as operators
from stringloom.operators.strings import located as strings_of
from stringloom.plans import sinks
from stringloom.plans.extract import examined, extract
from stringloom.schema import STATIC, Bounds, Options, address_of, selection, tag_of
from stringloom.sources.containers import FALLBACK, parse
from stringloom.sources.inputs import files
from stringloom.tables import stash

MIXED = "Привет 世界 😀"


def result(spark, data: bytes, **options):
    more = {k: options.pop(k) for k in ("library", "model") if k in options}
    return extract(spark.createDataFrame([("a", bytearray(data))], "input_id string, content binary"), Options(**options), **more)


def strings(spark, data: bytes, **options) -> list[tuple]:
    return sorted((x.value, x.kind, x.location.offset) for x in result(spark, data, **options).strings.collect())


def test_ascii(spark):
    assert strings(spark, b"\0\0hello world\0\0ab\0xyz!\0", enabled=("static_ascii",)) == [("hello world", "static_ascii", 2), ("xyz!", "static_ascii", 18)]
    assert strings(spark, b"abc\0abcd\0abcde", enabled=("static_ascii",)) == [("abcd", "static_ascii", 4), ("abcde", "static_ascii", 9)]
    assert strings(spark, b"") == [] and strings(spark, b"hello", min_length=0, enabled=STATIC) == []


def test_utf8(spark):
    assert strings(spark, b"\xff\xfe" + MIXED.encode() + b"\0\xf0\x9f", enabled=("static_utf8",)) == [(MIXED, "static_utf8", 2)]
    assert strings(spark, b"hello", enabled=("static_utf8",)) == [("hello", "static_utf8", 0)]
    assert strings(spark, "你好".encode(), enabled=("static_utf8",)) == []
    for p in (0xFFFE, 0xFFFF, 0xFDD0, 0xFDEF, 0x1FFFE, 0x10FFFF):
        assert strings(spark, chr(p).encode() + b"hello", enabled=("static_utf8",)) == [("hello", "static_utf8", len(chr(p).encode()))]


def test_mixed_runs_overlap(spark):
    """A mixed run is one UTF-8 string, and its ASCII part a string of its own."""
    found = strings(spark, "héllo wörld".encode(), enabled=("static_ascii", "static_utf8"))
    assert ("héllo wörld", "static_utf8", 0) in found and ("llo w", "static_ascii", 3) in found


@pytest.mark.parametrize("end", ["le", "be"])
def test_utf16(spark, end):
    kind = f"static_utf16_{end}"
    assert (MIXED, kind, 1) in strings(spark, b"\xff" + MIXED.encode(f"utf-16-{end}") + b"\0\0", enabled=(kind,))


def test_utf16_surrogates_and_order(spark):
    lone = b"".join(x.to_bytes(2, "little") for x in (0xD800, *map(ord, "hello"), 0xDC00))
    assert ("hello", "static_utf16_le", 2) in strings(spark, lone, enabled=("static_utf16_le",))
    found = strings(spark, "hello world".encode("utf-16-be"))
    assert ("hello world", "static_utf16_be", 0) in found and not any(v == "hello worl" for v, *_ in found)


def test_mirrored_rows_by_scan_and_by_join(spark):
    rng = random.Random(5)
    data = [b"".join(rng.choice(("hello world", "x\n", "abcd")).encode(rng.choice(("utf-16-le", "utf-16-be"))) + b"\0" * rng.randrange(3) for _ in range(5)) for _ in range(40)]
    parsed = parse(spark.createDataFrame([(str(i), bytearray(x)) for i, x in enumerate(data)], "input_id string, content binary"))
    options = Options(enabled=("static_utf16_le", "static_utf16_be"))
    key = lambda df: sorted((r.input_id, r.kind, r.offset, r.length) for r in df.collect())
    whole = strings_of(runs.scan(parsed, options, mirrored=True))
    assert key(runs.without_mirrored(whole)) == key(strings_of(runs.scan(parsed, options))) != key(whole)


def test_base64(spark):
    (row,) = [x for x in result(spark, b"\0aGVsbG8gd29ybGQ=\0", enabled=("static_ascii", "base64"), decode_base64=True).strings.collect() if x.kind == "base64"]
    assert (row.value, row.location.offset, row.analysis.decoded_offset, row.analysis.source_length) == ("hello world", 1, 0, 16)
    assert runs.decoded(b"aGVsbG8_") == b"hello?" and runs.decoded(b"YUdWc2JHOD0=") == b"aGVsbG8="
    assert runs.decoded(b"====") is None and runs.decoded(b"aGVsbG9=") is None and runs.decoded(b"ab+/ab-_") is None and runs.decoded(b"abcde") is None
    assert strings(spark, b"A" * ((1 << 20) + 1), enabled=("static_ascii", "base64"), decode_base64=True)[0][1] == "static_ascii"


def test_runs_are_in_bounds():
    """Any bytes: offsets lie within, and the bytes there are the value."""
    rng = random.Random(1)
    names = {"ascii": "ascii", "utf8": "utf-8", "utf16_le": "utf-16-le", "utf16_be": "utf-16-be"}
    for size in range(0, 200):
        data = bytes(rng.choice((rng.randrange(256), rng.randrange(32, 127), 0)) for _ in range(size))
        for least in (0, 1, 4):
            for r in runs.static_runs(data, least, STATIC):
                assert data[r.offset : r.offset + r.length] == r.value.encode(names[r.encoding])


def test_native_scan_equals_batches(spark):
    rng = random.Random(2)
    rows = [(str(i), bytearray(rng.choice((9, 10, 65, 66, 200, 0)) for _ in range(rng.randrange(80)))) for i in range(60)]
    df = spark.createDataFrame(rows, "input_id string, content binary")
    native = {tuple(r) for r in runs.ascii_runs_native(df, 3).collect()}
    assert native == {(i, m[0].decode(), m.start()) for i, b in rows for m in re.finditer(rb"[\x09\x20-\x7e]{3,}", bytes(b))}


def test_tags_filters_and_duplicates(spark):
    twice = b"https://example.com\0https://example.com\0"
    (row,) = result(spark, twice, annotate=True, dedupe=True, required_tags=("url",), enabled=("static_ascii",), format="sc64").strings.collect()
    assert row.analysis.tags == ["code", "url"] and row.location.section == "shellcode"
    (row,) = result(spark, b"hello world\0hello world\0", required_tags=("duplicate",), dedupe=True, enabled=("static_ascii",)).strings.collect()
    assert row.location.offset == 12
    assert strings(spark, b"\0hello world\0", format="sc64", skip_code_sections=True, enabled=("static_ascii",)) == []
    library = spark.createDataFrame([("kernel32.dll",)], "value string")
    assert [x.value for x in result(spark, b"\0kernel32.dll\0myprogram.exe\0", skip_library_strings=True, library=library, enabled=("static_ascii",)).strings.collect()] == ["myprogram.exe"]
    assert [v for v, *_ in strings(spark, b"\0AAAAAAAA\0Hello, world!\0////////\0", min_quality=0.4, enabled=("static_ascii",))] == ["Hello, world!"]


def test_tags_of_the_library_and_of_base64(spark):
    library = spark.createDataFrame([("hello world",)], "value string")
    rows = result(spark, b"\0aGVsbG8gd29ybGQ=\0hello world\0", library=library, annotate=True, enabled=("static_ascii", "base64"), decode_base64=True).strings.collect()
    assert {(r.kind, r.value): r.analysis.tags for r in rows if r.value == "hello world"} == {("base64", "hello world"): ["library", "base64", "duplicate"], ("static_ascii", "hello world"): ["library"]}


def test_unknown_format_is_scanned(spark):
    r = result(spark, b"\0hello world\0", enabled=("static_ascii",))
    assert r.inputs.collect()[0].format == "unknown" and r.warnings.count() == 1 and r.strings.count() == 1


def test_options():
    for bad in ({"min_quality": float("nan")}, {"min_quality": 2}, {"min_trigram_score": float("inf")}, {"enabled": ("no",)}, {"required_tags": ("no",)}):
        with pytest.raises(ValueError):
            Options(**bad)
    assert selection(["static"], encodings=["utf8"]) == ("static_utf8",) and selection(["base64"], ["base64"]) == ()
    assert tag_of("#URL") == "url" and address_of("0x10") == 16 and address_of("10") == 10


def test_score_needs_model(spark):
    with pytest.raises(ValueError):
        result(spark, b"x", min_trigram_score=0.0)


def test_low_scores_go_and_null_scores_stay(spark):
    model = spark.createDataFrame([("\u0080he", 100), ("hel", 100), ("ell", 100), ("llo", 100)], "gram string, n long")
    data = "hello\0你好世界".encode()
    rows = result(spark, data, model=model, min_trigram_score=0.0, enabled=("static_ascii", "static_utf8")).strings.collect()
    assert [(r.value, r.analysis.trigram_score) for r in rows] == [("你好世界", None)]
    rows = result(spark, data, model=model, enabled=("static_ascii",)).strings.collect()
    assert [r.value for r in rows] == ["hello"] and rows[0].analysis.trigram_score < 0


def test_json(spark):
    r = result(spark, b"https://example.com/\0noise text", annotate=True, enabled=("static_ascii",))
    lines = [json.loads(x.line) for x in sinks.json_lines(r).collect()]
    assert {x["value"] for x in lines} == {"https://example.com/", "noise text"}
    assert [x.get("analysis") for x in lines if x["value"] == "noise text"] == [None]
    (document,) = sinks.json_documents(r).collect()
    assert [x["location"]["offset"] for x in json.loads(document.document)["strings"]] == [0, 21]
    lines = [x.line for x in sinks.report(r).orderBy(*sinks.REPORT_ORDER).collect()]
    assert lines == ["stringloom: format=unknown, size=31 bytes", "=== static strings (2) ===", "0x0000000000000000  https://example.com/ #url", "0x0000000000000015  noise text", "warnings:", f"  - {FALLBACK}"]
    assert [x.line for x in sinks.report(r, quiet=True).orderBy(*sinks.REPORT_ORDER).collect()] == lines[2:4] and sinks.report(r, quiet=True, brief=True).count() == 0


def test_stream(spark, tmp_path):
    from stringloom.streaming import files

    (tmp_path / "a.bin").write_bytes(b"\0hello\0world!\0")
    q = files.static_strings(files.new_files(spark, str(tmp_path)), Options(enabled=("static_ascii",))).writeStream.format("memory").queryName("streamed").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.value for r in spark.sql("select value from streamed").collect()) == ["hello", "world!"]


def test_one_pass(spark, tmp_path):
    """The inputs are read once, by one Python stage, and nothing after it goes back to them; also with a model."""
    (tmp_path / "a.bin").write_bytes(b"\0hello\0world!\0")
    options = Options(annotate=True, dedupe=True, min_quality=0.1)
    plan = examined(files(spark, str(tmp_path)), options)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("FileScan binaryFile") == 1
    model = spark.createDataFrame([("hel", 5)], "gram string, n long")
    for more in ({}, {"model": model}):
        r = extract(files(spark, str(tmp_path)), options, **more)
        for df in (r.strings, r.inputs, r.warnings):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "MapInArrow" not in plan and "binaryFile" not in plan
        assert {x.value for x in r.strings.collect()} >= {"hello", "world!"}
    assert {x.input_id.split("/")[-1] for x in r.inputs.collect()} == {"a.bin"}


def test_places():
    """The smallest section that holds an offset, against trying all."""
    rng = random.Random(3)
    for _ in range(60):
        sections = [{"idx": i, "file_offset": rng.randrange(50), "file_size": rng.randrange(1, 30)} for i in range(rng.randrange(12))]
        offsets = [rng.randrange(90) for _ in range(40)]
        for at, got in zip(offsets, runs.places(offsets, sections)):
            inside = [(s["file_size"], s["idx"]) for s in sections if s["file_offset"] <= at < s["file_offset"] + s["file_size"]]
            assert got == (min(inside)[1] if inside else None)


def test_bounds_warn(spark):
    tokens = b"\0" + b"A" * 64 + b"\0aGVsbG8gd29ybGQ=\0"
    r = result(spark, tokens, enabled=("base64",), decode_base64=True, bounds=Bounds(base64_token=32))
    assert "hello world" in {x.value for x in r.strings.collect()} and any("1 tokens of more than 32 bytes" in x.warning for x in r.warnings.collect())
    r = result(spark, tokens, enabled=("base64",), decode_base64=True, bounds=Bounds(base64_total=4))
    assert r.strings.count() == 0 and any("no more than 4 bytes" in x.warning for x in r.warnings.collect())
    assert result(spark, b"A" * ((1 << 20) + 4), enabled=("base64",), decode_base64=True, bounds=Bounds(base64_token=None)).warnings.count() == 1


def test_kinds_that_nothing_finds(spark):
    with pytest.raises(ValueError):
        result(spark, b"x", enabled=("decoded",))
    r = result(spark, b"hello", enabled=("decoded", "static_ascii"))
    assert r.strings.count() == 1 and any("decoded" in x.warning for x in r.warnings.collect())


def test_ordered_lines(spark, tmp_path):
    data = b"\0" + b"\0".join(b"text %d" % (i * 7 % 50) for i in range(50))
    sinks.write_lines(result(spark, data, enabled=("static_ascii", "static_utf8")), str(tmp_path / "lines"))
    parts = sorted((tmp_path / "lines").glob("part-*"))
    offsets = [json.loads(line)["location"]["offset"] for p in parts for line in p.read_text().splitlines()]
    assert offsets == sorted(offsets) and len(offsets) == 50
    sinks.write_report(result(spark, data, enabled=("static_ascii",)), str(tmp_path / "report"))
    sinks.write_documents(result(spark, data, enabled=("static_ascii",)), str(tmp_path / "documents"))
    assert len([p for d in ("report", "documents") for p in (tmp_path / d).glob("part-*")]) >= 2


def test_table_function(spark):
    from stringloom.functions import table

    table.register(spark)
    spark.createDataFrame([("a", bytearray(b"\0hello world\0")), ("b", None)], "input_id string, content binary").createOrReplaceTempView("inputs_of_test")
    rows = spark.sql("SELECT input_id, t.* FROM inputs_of_test, LATERAL extract_strings(content, 'static_ascii', 5) t").collect()
    assert [(r.input_id, r.value, r.offset, r.address, r.section) for r in rows] == [("a", "hello world", 1, 1, "raw")]


def test_firsts_are_told_in_the_scan(spark):
    """The first of each value, kind and encoding, against the aggregate over all rows; only rows of inputs with several rows are sorted."""
    rng = random.Random(5)
    word = lambda: rng.choice(["aaaa", "bbbbb", "http://x.yz/", "QUFBQUFBQUE=", "YWFhYSBhYWFhIGFhYWE="])
    text = lambda: "\n".join(word() for _ in range(12)).encode()
    wide = lambda: text() + b"\0" + "\n".join(word() for _ in range(5)).encode("utf-16-le") + b"\0\0\n" + "aaaa".encode("utf-16-le")
    df = spark.createDataFrame([(str(i), bytearray(wide())) for i in range(40)], "input_id string, content binary")
    found = stash(strings_of(examined(df, Options(decode_base64=True))))
    assert found.where("alone").count() and found.where("nth = 2").count()
    key = ["input_id", "value", "kind", "encoding", "offset", "seq"]
    rows = lambda x: sorted(map(str, x.select(*key).collect()))
    assert rows(operators.first_of_each(found)) == rows(operators._first_of_each(found))
    own = lambda x: sorted(map(str, x.select(*key, "in_code", "is_duplicate", "tags").collect()))
    marked = stash(found.withColumn("in_library", F.lit(False)))
    assert own(operators.annotated_firsts(marked)) == own(operators._annotated_firsts(marked))
    plan = catalogue.QUERIES["dedupe_first"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "NOT alone" in plan and "(nth#" in plan and "MapInArrow" not in plan
