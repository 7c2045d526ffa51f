"""Containers that are put together here, and code in bytes."""

import json
import re
import struct
from dataclasses import replace

import pytest

from stringloom import binaries
from stringloom.operators import code, language, runs
from stringloom.plans import sinks
from stringloom.plans.extract import extract
from stringloom.schema import Bounds, Options
from stringloom.sources.containers import FALLBACK, read

H = bytes.fromhex


def found(spark, data: bytes, kind: str, **options):
    return [(x.value, x.location.section) for x in extract(spark.createDataFrame([("a", bytearray(data))], "input_id string, content binary"), Options(enabled=(kind,), **options)).strings.collect()]


@pytest.mark.parametrize(
    ("data", "form", "values"),
    [
        ("4883EC08 C6042453 C644240154 C644240241 C644240343 C64424044B 4883C408 C3", "sc64", ["STACK"]),
        ("4883EC08 C7042448656C6C C74424046F212100 4883C408 C3", "sc64", ["Hello!!"]),
        ("C745E0496E7661 C745E46C696420 C745E864617461 C3", "sc32", ["Invalid data"]),
        ("66C704244142 66C744240A5859 C3", "sc64", ["AB", "XY"]),
        ("4883EC08 B848656C6C 890424 B86F212100 89442404 4883C408 C3", "sc64", ["Hello!!"]),
        ("48B848656C6C6F212121 48890424 C3", "sc64", ["Hello!!!"]),
        ("686F000000 6848656C6C C3", "sc32", ["Hello"]),
        ("31C0 48894424 08 B841424344 890424 C3", "sc64", ["ABCD"]),
        ("F30F6F0518000000 F30F7F0424 C3 " + "90" * 18 + b"Hello, World!\0\0\0".hex(), "sc64", ["Hello, World!"]),
    ],
)
def test_stack(spark, data, form, values):
    assert sorted(v for v, _ in found(spark, H(data), "stack", format=form, min_length=2)) == values


def test_stack_aarch64(spark):
    words = [0xD10043FF]
    for i, c in enumerate(b"STACK"):
        words += [0x52800000 | c << 5 | 1, 0x39000000 | i << 10 | 31 << 5 | 1]
    assert found(spark, b"".join(struct.pack("<I", w) for w in [*words, 0x910043FF, 0xD65F03C0]), "stack", format="sc64_arm64") == [("STACK", "stack")]


def test_stack_aarch64_wide(spark):
    """movz and movk, then str, strh and stp."""
    mov = lambda r, text: [0xD2800000 | int.from_bytes(text[:2], "little") << 5 | r] + [0xF2800000 | k << 21 | int.from_bytes(text[2 * k : 2 * k + 2], "little") << 5 | r for k in range(1, 4)]
    words = [*mov(1, b"wide str"), 0xF90003E1, 0xD65F03C0, *mov(2, b"one pair"), *mov(3, b" of them"), 0xA9000FE2, 0xD65F03C0, *mov(4, b"hhxxxxxx"), 0x790003E4, 0xD65F03C0]
    assert sorted(v for v, _ in found(spark, b"".join(struct.pack("<I", w) for w in words), "stack", format="sc64_arm64", min_length=2)) == ["hh", "one pair of them", "wide str"]


def test_text_is_no_push(spark):
    assert found(spark, b"the house of words that begin with h, and jam", "stack", format="sc64") == []


def test_functions_by_symbols():
    """Where the input names functions, a return within one does not end it."""
    body = H("C6042441 C3 C644240142 C3 C6042443")
    section = [{"file_offset": 0, "file_size": len(body), "virtual_address": 0x1000, "executable": True}]
    regions = lambda symbols: [x["region"] for x in code.writes_of("x86_64", section, symbols, body)]
    assert regions([0x1000, 0x100B]) == [0x1000, 0x1000, 0x100B] and regions([]) == [0x1000, 0x1005, 0x100B]


def test_two_strings_of_one_function_and_a_model(spark):
    """Each has its own place in the order, and its own score; much code takes seconds."""
    model = spark.createDataFrame([("abc", 9, True)], "gram string, n long, lowercase boolean")
    one = H("C7042441424344 C744241058595A57 C3")
    rows = extract(spark.createDataFrame([("a", bytearray(one * 200_000))], "input_id string, content binary"), Options(format="sc64", enabled=("stack",), annotate=True), model=model).strings
    few = extract(spark.createDataFrame([("a", bytearray(one))], "input_id string, content binary"), Options(format="sc64", enabled=("stack",), annotate=True), model=model).strings.collect()
    assert sorted(r.value for r in few) == ["ABCD", "XYZW"] and len({r.seq for r in few}) == 2 and len({r.analysis.trigram_score for r in few}) == 2
    assert rows.count() == 400_000


def test_references(spark):
    data = H("488D0502000000C390") + b"hello\0"  # lea rax, [rip + 2]: the string
    (row,) = extract(spark.createDataFrame([("a", bytearray(data))], "input_id string, content binary"), Options(format="sc64", enabled=("static_ascii",))).strings.collect()
    assert row.value == "hello" and row.location.address == 9 and row.location.xrefs == 1


def elf() -> bytes:
    names, text = b"\0.text\0.rodata\0.names\0", b"\x90" * 16
    body = text + b"go and read me\0\0"
    at = 64 + len(body)
    head = b"\x7fELF\x02\x01\x01" + b"\0" * 9 + struct.pack("<HHIQQQIHHHHHH", 2, 0x3E, 1, 0x1000, 0, at + len(names), 0, 64, 0, 0, 64, 4, 3)
    section = lambda n, kind, flags, va, off, size: struct.pack("<IIQQQQIIQQ", n, kind, flags, va, off, size, 0, 0, 1, 0)
    table = section(0, 0, 0, 0, 0, 0) + section(1, 1, 6, 0x1000, 64, 16) + section(7, 1, 2, 0x2000, 80, 16) + section(15, 3, 0, 0, at, len(names))
    return head + body + names + table


def test_elf(spark):
    (x,) = read(elf())
    assert (x["format"], x["arch"], x["bits"], x["entry"]) == ("elf", "x86_64", 64, 0x1000)
    assert [(s["name"], s["executable"], s["virtual_address"]) for s in x["sections"]][:2] == [(".text", True, 0x1000), (".rodata", False, 0x2000)]
    rows = extract(spark.createDataFrame([("a", bytearray(elf()))], "input_id string, content binary"), Options(enabled=("static_ascii",))).strings.where("value = 'go and read me'").collect()
    assert [(r.location.section, r.location.address) for r in rows] == [(".rodata", 0x2000)]


def test_pe():
    optional = struct.pack("<HBBIIIIIQ", 0x20B, 0, 0, 0, 0, 0, 0x1000, 0, 0x140000000) + b"\0" * 80 + struct.pack("<II", 0, 0) * 16
    pe = b"PE\0\0" + struct.pack("<HHIIIHH", 0x8664, 1, 0, 0, 0, len(optional), 0) + optional
    pe += struct.pack("<8sIIIIIIHHI", b".text", 16, 0x1000, 16, 0x400, 0, 0, 0, 0, 0x60000020)
    (x,) = read(b"MZ" + b"\0" * 58 + struct.pack("<I", 64) + pe + b"\0" * 0x400)
    assert (x["format"], x["arch"], x["bits"], x["sections"][0]["name"], x["sections"][0]["executable"]) == ("pe", "x86_64", 64, ".text", True)
    assert x["sections"][0]["virtual_address"] == 0x140001000


def mach(cpu=0x0100000C) -> bytes:
    segment = struct.pack("<II16sQQQQIIII", 0x19, 72, b"__TEXT", 0x1000, 64, 0, 64, 7, 5, 0, 0)
    return struct.pack("<IIIIIIII", 0xFEEDFACF, cpu, 0, 2, 1, len(segment), 0, 0) + segment + b"\0" * 64


def test_mach_o():
    (x,) = read(mach())
    assert (x["arch"], x["sections"][0]["name"], x["sections"][0]["executable"], x["entry"]) == ("aarch64", "__TEXT", True, None)
    one, two = mach(), mach(0x01000007)
    fat = struct.pack(">II", 0xCAFEBABE, 2) + struct.pack(">5I", 0, 0, 64, len(one), 0) + struct.pack(">5I", 0, 0, 64 + len(one), len(two), 0)
    both = read(fat.ljust(64, b"\0") + one + two)
    assert [x["arch"] for x in both] == ["aarch64", "x86_64"] and both[1]["sections"][0]["name"] == "[x86_64] __TEXT" and "2 architectures" in both[0]["warnings"][0]
    assert both[1]["scan_start"] == 64 + len(one)


def test_bad_containers():
    assert read(b"\x7fELF\x02")[0]["error"] and read(b"MZ")[0]["error"] and read(b"hello")[0]["warnings"] == [FALLBACK]
    assert read(b"hello", "pe")[0]["error"]


def test_rust_symbols(spark):
    df = spark.createDataFrame([("_RNvCs1",), ("_R",), ("_ZN4core3fmt17h0E",), ("_ZN3foo3barE",), ("main",)], "n string")
    assert [r.n for r in df.where(language.is_rust_symbol(df.n)).collect()] == ["_RNvCs1", "_ZN4core3fmt17h0E"]


def test_go_names():
    names = b"main.main\0runtime/x\0plain\0"
    table = b"\xf1\xff\xff\xff\0\0\x01\x08" + struct.pack("<QQQQ", 0, 0, 0, 40) + names
    section = {"file_offset": 0, "file_size": len(table) + 100, "name": ".gopclntab"}  # as far as it lies within the input
    assert [x.value for x in language.go_names(table, section)] == ["main.main", "runtime/x"]
    said: list = []
    assert len(language.go_names(table, section, 9)) == 2 and language.go_names(table, section, 10) == []
    assert [x.value for x in language.go_names(table, section, 1, 0, Bounds(names=1), said)] == ["main.main"] and "no more than 1" in said[0]
    assert [x.value for x in language.go_names(table, section, 1, 0, Bounds(name=7), said)] == ["main.ma", "runtime"][:1] and "cut" in said[-1]


def test_rust_metadata_bounds():
    body = b"rust\0\0\0\x08rustc 1.80.0 (x)\0some_crate\0abc\0some_crate\0other_crate\0"
    section, said = {"file_offset": 0, "file_size": len(body), "name": ".rustc"}, []
    assert [x.value for x in language.rust_metadata(body, section)] == ["rustc 1.80.0 (x)", "rust", "rustc", "some_crate", "other_crate"]
    assert [x.value for x in language.rust_metadata(body, section, 6)] == ["rustc 1.80.0 (x)", "some_crate", "other_crate"]
    assert [x.value for x in language.rust_metadata(body, section, 6, 0, Bounds(crates=36), said)] == ["rustc 1.80.0 (x)", "some_crate"] and said


def test_graph(spark):
    calls = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "caller long, callee long")
    entries = spark.createDataFrame([(1,)], "function long")
    assert sorted(r.function for r in code.reachable(calls, entries, lambda df: df.cache()).collect()) == [1, 2, 3]
    blocks = spark.createDataFrame([(1, 0, 4), (1, 4, 8)], "function long, start long, end long")
    edges = spark.createDataFrame([(1, 4, 0), (1, 0, 4)], "function long, src long, dst long")
    assert code.back_edges(blocks, edges).collect()[0].loops == 1
    assert sorted(r.start for r in code.loop_blocks(blocks, edges).collect()) == [0, 4]


def test_call_sites(spark):
    calls = spark.createDataFrame([(c, 9) for c in (1, 2, 3, 9)] + [(1, 8)], "caller long, callee long")
    sites = spark.createDataFrame([(c, b, b + i, 9) for c in (1, 2, 3, 4, 9) for b in (10, 20) for i in (1, 2)] + [(1, 30, 31, 8)], "caller long, block long, ip long, target long")
    got = sorted((r.target, r.caller, r.block, r.ip) for r in code.call_sites(calls, sites).collect())
    assert got == [(8, 1, 30, 31)] + [(9, c, b, b + i) for c in (1, 2) for b in (10, 20) for i in (1, 2)][:6]


def test_candidates_in_reports(spark):
    r = extract(spark.createDataFrame([("a", bytearray(H("C7042441424344 C3 C7042458595A57 C3") + b"\0plain text\0"))], "input_id string, content binary"), Options(format="sc64", enabled=("stack", "static_ascii")))
    own = spark.createDataFrame([("a", 0, "decode", 0.75, 1, ["calls_crypto"])], "input_id string, va long, name string, score double, recovered_strings long, tags array<string>")
    both = replace(r, candidates=own)
    assert {x.value for x in both.only_candidates().strings.collect()} == {"ABCD", "plain text", "$ABCD", "$XYZW"}
    lines = [x.line for x in sinks.report(both, by_function=True, brief=True).orderBy(*sinks.REPORT_ORDER).collect()]
    assert lines[2:] == ["=== decoder candidates (1) ===", "  0x0000000000000000  score=0.75  recovered=1  decode  [calls_crypto]", "=== stack strings (2) ===", "  function 0x0000000000000000  decode  [calls_crypto]  (1 strings)", "    ABCD", "  function 0x0000000000000008  (1 strings)", "    XYZW"]
    assert json.loads(sinks.json_documents(both).collect()[0].document)["candidates"][0]["name"] == "decode"


def test_language_strings_come_by_columns():
    """A section's strings are one chunk, so that no string is brought to its columns alone; places are those of a plain search."""
    for body in (b"caf\xc3\xa9 one\0x\0\xf0\x9f\x98\x80 two\n", b"a\xffb\xc3\xa9 three\0four", b"", b"9abcd _x9 abcd abc 12_long_name"):
        section = dict(idx=0, name=".rustc", file_offset=2, file_size=len(body), virtual_address=64, executable=False, writable=False)
        found = language.text_chunk("rust", b"--" + body, section, 2)
        valid = [body[a : a + n] for a, n in zip([x - 2 for x in found.offset], found.length)]
        assert [x.decode() for x in valid] == found.value and all(len(x) >= 2 for x in valid)
        names = language.metadata_chunk(b"--" + body, section)
        plain = {}
        for m in re.finditer(rb"[a-z_][a-z0-9_]*", body):
            if 4 <= len(m[0]) <= 32:
                plain.setdefault(m[0].decode(), m.start() + 2)
        assert dict(zip(names.value, names.offset)) == plain and len(names.value) == len(plain)
        out = runs.Strings()
        calls = []
        out._extend = lambda *args, own=out._extend: (calls.append(1), own(*args))
        language.scanned(out, b"--" + body, [section], "rust", Options(enabled=("rust",)))
        out.close()
        assert len(calls) <= 1 and out.columns["address"] == [62 + x for x in out.columns["offset"]]


def test_files_are_made_without_joins_and_branches(spark, monkeypatch):
    """The files of input_labels: texts are not joined, and no part of a file stands in a branch that makes it again for each use."""
    seen = []
    monkeypatch.setattr(binaries, "extract", lambda files, options: seen.append(files) or extract(files, options))
    labels = binaries.QUERIES["input_labels"](spark, "/root/testdata/sf0.001")
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "CASE WHEN" not in plan
    assert labels.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
