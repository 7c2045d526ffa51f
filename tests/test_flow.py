"""Intervals, control flow, function starts and import calls against plain loops; damaged headers."""

import random
import struct
import threading
import time

import pytest
from pyspark.sql import functions as F

from stringloom import programs
from stringloom.binaries import DIRECTORIES
from stringloom.functions import extractors
from stringloom.operators import code, entries, flow, intervals
from stringloom.plans.extract import extract
from stringloom.schema import WRITES, Options
from stringloom.sources.containers import architectures
from stringloom.tables import settled, stash


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()


def test_points_in_intervals(spark):
    rng = random.Random(1)
    spans = [(i % 3, a := rng.randint(-(1 << 62), 1 << 62) if i % 7 == 0 else rng.randint(-300, 300), a + rng.choice([0, 1, 2, 7, 64, 65, 500, 1 << 40]), i) for i in range(200)]
    points = [(rng.randint(0, 3), rng.choice([rng.randint(-400, 900), rng.choice(spans)[1], rng.choice(spans)[2]])) for _ in range(300)] + [(1, None)]
    held = spark.createDataFrame(spans, "k int, start long, end long, which int")
    df = intervals.containing(spark.createDataFrame(points, "k int, at long"), held, ["k"])
    expected = sorted((k, p, i) for k, p in points if p is not None for own, a, b, i in spans if own == k and a <= p < b)
    assert sorted((r.k, r["at"], r.which) for r in df.collect()) == expected and expected
    assert "CartesianProduct" not in plan_of(df) and "BroadcastNestedLoopJoin" not in plan_of(df)
    first = intervals.first_containing(spark.createDataFrame(points, "k int, at long"), held, ["k"], ["which"]).collect()
    assert {(r.k, r["at"]): r["first"].which for r in first} == {(k, p): min(i for kk, pp, i in expected if (kk, pp) == (k, p)) for k, p, _ in expected}
    assert intervals.containing(spark.createDataFrame(points, "k int, at long"), held.limit(0), ["k"]).collect() == []


def test_permissions_of_pages(spark):
    rng = random.Random(2)
    sections = [(rng.choice("ab"), rng.randint(0, 40) * 1000, rng.choice([0, 1, 4096, 9000, 30000]), rng.random() < 0.3, rng.random() < 0.3) for _ in range(60)] + [("c", (1 << 63) - 5000, 90000, True, False), ("d", -5000, 100, False, True)]
    df = spark.createDataFrame(sections, "input_id string, virtual_address long, file_size long, executable boolean, writable boolean")
    found = {(r.input_id, page): (r.executable, r.writable) for r in intervals.permission_map(df.where("input_id in ('a', 'b')"), ["input_id"]).collect() for page in range(r.start // 4096, r.end // 4096)}
    expected = {}
    for who, a, n, x, w in sections[:-2]:
        for page in range(a // 4096, -(-(a + n) // 4096)) if n else ():
            own = expected.get((who, page), (False, False))
            expected[who, page] = (own[0] or x, own[1] or w)
    assert found == expected
    ends = {r.input_id: (r.start, r.end) for r in intervals.permission_map(df.where("input_id in ('c', 'd')"), ["input_id"]).collect()}
    assert ends["d"] == (-8192, -4096) and ends["c"][0] == (1 << 63) - 8192 and ends["c"][1] > ends["c"][0]


def test_blocks_are_split_once(spark):
    blocks = [(1, 0, 100), (1, 40, 100), (1, 200, 210), (2, 0, 10)]
    edges = [(1, 0, 200), (1, 40, 70), (1, 40, 5), (1, 200, 999), (2, 0, 0), (1, 777, 0)]
    first = flow.split_blocks(spark.createDataFrame(blocks, "function int, start long, end long"), spark.createDataFrame(edges, "function int, src long, dst long"), [])
    found = [sorted(map(tuple, x.collect())) for x in first]
    # 0-100 is cut at 5, 40 and 70; at 40 a block stands already, which is cut at 70.
    assert found[0] == [(1, 0, 5), (1, 5, 40), (1, 40, 70), (1, 70, 100), (1, 200, 210), (2, 0, 10)]
    assert found[1] == [(1, 0, 5), (1, 5, 40), (1, 40, 70), (1, 70, 5), (1, 70, 70), (1, 70, 200), (1, 200, 999), (1, 777, 0), (2, 0, 0)]
    again = [sorted(map(tuple, x.collect())) for x in flow.split_blocks(stash(first[0]), stash(first[1]), [])]
    assert again == found


def plain_states(own, edges, entries_, blocks):
    """Optimistic rounds over everything until nothing changes."""
    reached, out, found = set(entries_), {}, {}
    for b in entries_:
        found[b] = {}
    while True:
        new_out = {b: {**{r: v for r, v in found[b].items() if r not in own.get(b, {})}, **{r: v for r, v in own.get(b, {}).items() if v is not None}} for b in reached}
        grown = reached | {d for s, d in edges if s in reached}
        new_found = {}
        for b in grown:
            into = [new_out[s] for s, d in edges if d == b and s in reached]
            agree = {} if b in entries_ or not into else {r: v for r, v in into[0].items() if all(x.get(r) == v for x in into)}
            new_found[b] = agree
        if (new_found, grown) == (found, reached):
            return found
        found, reached, out = new_found, grown, new_out


def test_states_reach_their_fixpoint(spark):
    rng = random.Random(7)
    for n in (6, 25):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(2 * n)] + [(i, i + 1) for i in range(0, n - 1, 2)]
        own = {b: {r: rng.choice([1, 1, 1, 2, None]) for r in rng.sample(["a", "b", "c"], rng.randint(0, 2))} for b in range(n)}
        rows = [(1, b, r, v) for b, x in own.items() for r, v in x.items()]
        found = flow.state_meet(spark.createDataFrame(rows, "f int, block int, register string, value long"), spark.createDataFrame([(1, *e) for e in edges], "f int, src int, dst int"), spark.createDataFrame([(1, 0)], "f int, block int"), ["f"], stash)
        expected = {(b, r, v) for b, x in plain_states(own, edges, {0}, range(n)).items() for r, v in x.items()}
        assert {(r.block, r.register, r.value) for r in found.collect()} == expected


def test_loops_keep_what_they_leave_alone(spark):
    own = spark.createDataFrame([(0, "a", 5), (0, "b", 1), (2, "b", 2)], "block int, register string, value long")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 1)], "src int, dst int")
    found = flow.state_meet(own, edges, spark.createDataFrame([(0,)], "block int"), [], stash).collect()
    assert sorted((r.block, r.register, r.value) for r in found) == [(1, "a", 5), (2, "a", 5)]


def test_states_of_many_functions_go_one_way(spark):
    """A chain of 60 blocks in each function: one shuffle and one table are written, however many rounds a chain takes."""
    chain = spark.range(50).select(F.col("id").alias("f"), F.explode(F.sequence(F.lit(0), F.lit(58))).alias("src"))
    edges = chain.select("f", "src", (F.col("src") + 1).alias("dst"))
    own = spark.range(50).select(F.col("id").alias("f"), F.lit(0).alias("block"), F.lit("a").alias("register"), F.col("id").alias("value"))
    written = []

    def counted(df):
        written.append(df)
        return stash(df)

    found = flow.state_meet(own, edges, spark.range(60).select(F.col("id").alias("f"), F.lit(0).alias("block")), ["f"], counted)
    assert {(r.f, r.block, r.register, r.value) for r in found.collect()} == {(f, b, "a", f) for f in range(50) for b in range(1, 60)}
    assert len(written) == 1


def test_starts_and_regions(spark):
    body = bytes.fromhex("554889e5 4883ec08 90 c3 53 4883ec10 c3 4154 90 48 81ec00010000 c3")
    assert entries.prologues("x86_64", body) == [(0, 4), (4, 4), (10, 5), (11, 4), (16, 2), (19, 7)]
    assert entries.prologues("x86", bytes.fromhex("5589e5 83ec08 c3")) == [(0, 3), (3, 3)]
    assert entries.prologues("aarch64", struct.pack("<4I", 0xA9BF7BFD, 0xD65F03C0, 0xD10043FF, 0xD503201F)) == [(0, 4), (8, 4)]
    assert entries.prologues("x86_64", b"\x48") == entries.prologues("arm", body) == entries.prologues(None, b"") == []
    rows = [("a", 0, at, n, ".text", 27) for at, n in entries.prologues("x86_64", body)]
    starts = spark.createDataFrame(rows, "input_id string, arch_idx int, place long, size int, section string, section_end long")
    assert sorted((r.start, r.end) for r in entries.regions(starts).collect()) == [(0, 10), (10, 16), (16, 19), (19, 27)]
    named = spark.createDataFrame([("a", 0, 13), ("a", 0, 900), ("b", 0, 1)], "input_id string, arch_idx int, place long")
    assert sorted((r.start, r.end) for r in entries.regions(starts, named).collect()) == [(0, 10), (10, 13), (13, 16), (16, 19), (19, 27)]


def section(body: bytes, at: int, executable: bool = True) -> dict:
    return dict(idx=0, name=".text", file_offset=0, file_size=len(body), virtual_address=at, executable=executable, writable=False)


def test_import_calls_of_each_architecture():
    calls = lambda arch, body, at, slots: entries.import_calls_of(arch, [section(body, at)], [dict(iat_va=x, name="n", library="") for x in slots], body)
    absolute = b"\xff\x15" + struct.pack("<I", 0x5000) + b"\xe8" + struct.pack("<i", 1) + b"\xc3\xff\x25" + struct.pack("<I", 0x5004)
    assert calls("x86", absolute, 0x1000, [0x5000, 0x5004]) == [(0x1000, 0x5000, "slot"), (0x1006, 0x5004, "stub"), (0x100C, 0x5004, "jump")]
    marked = b"\xe8" + struct.pack("<i", 0) + b"\xf3\x0f\x1e\xfa\xf2\xff\x25" + struct.pack("<i", 0x1000)
    assert calls("x86_64", marked, 0x1000, [0x1010 + 0x1000]) == [(0x1000, 0x2010, "stub"), (0x100A, 0x2010, "jump")]
    # adrp x16, page; ldr x17, [x16, #16]; add x16, x16, #16; br x17, then bl to that; adrp x8; ldr x8; blr x8; a page before.
    word = lambda imm21, rd: 0x90000000 | (imm21 & 3) << 29 | (imm21 >> 2 & 0x7FFFF) << 5 | rd
    arm = struct.pack("<8I", word(2, 16), 0xF9400000 | 2 << 10 | 16 << 5 | 17, 0x91004210, 0xD61F0220, 0x94000000 | (-4 & 0x3FFFFFF), word(-1 & 0x1FFFFF, 8), 0xF9400108, 0xD63F0100)
    assert calls("aarch64", arm, 0x4000, [0x6010, 0x3000]) == [(0x4000, 0x6010, "jump"), (0x4010, 0x6010, "stub"), (0x4014, 0x3000, "slot")]
    assert calls("x86_64", b"", 0, [1]) == calls("x86_64", marked, 0x1000, []) == calls("riscv", marked, 0, [1]) == []


def test_functions_of_a_file(spark):
    """Two functions that call each other, one of them itself, too; a symbol between them names a third without a frame."""
    call = lambda at, to: b"\xe8" + struct.pack("<i", to - at - 5)
    body = bytes.fromhex("4883ec08") + call(4, 32) + call(9, 0) + call(14, 20) + b"\xc3" + call(20, 32) + b"\xc3" + bytes(6) + bytes.fromhex("4883ec08") + call(36, 0) + b"\xc3"
    parsed = dict(arch="x86_64", sections=[section(body, 0x1000)], symbols=[(0x1014, "middle")], entry=None, imports=[])
    direct = [("a", 0, *x) for x in entries.direct_calls_of("x86_64", parsed["sections"], parsed["symbols"], None, body)]
    assert [(p - 0x1000, t - 0x1000) for _, _, p, t in direct] == [(4, 32), (9, 0), (14, 20), (20, 32), (36, 0)]
    by = "input_id string, arch_idx int, "
    starts = spark.createDataFrame([("a", 0, *x) for x in entries.starts_of("x86_64", parsed["sections"], body)], by + "place long, size int, section string, section_end long")
    whole = spark.createDataFrame([("a", 0, {0x1014: "middle"}, [])], by + "symbols map<long,string>, imports array<struct<library:string,name:string,iat_va:long>>")
    none = spark.createDataFrame([], by + "place long, iat_va long, through string")
    found = entries.functions(starts, none, spark.createDataFrame(direct, by + "place long, target long"), whole, spark.createDataFrame([], "name string, tag string")).collect()
    assert sorted((r.va - 0x1000, r.name, r.byte_size, r.callers, r.callees, r.imports) for r in found) == [(0, None, 20, 1, 2, 0), (20, "middle", 12, 1, 1, 0), (32, None, 10, 2, 1, 0)]


def test_functions_go_over_the_facts_once_a_step(spark):
    """The last plan reads what was written, not the starts and calls of all inputs again for each of its columns."""
    by = "input_id string, arch_idx int, "
    starts = spark.createDataFrame([("a", 0, 0, 4, ".text", 90)], by + "place long, size int, section string, section_end long")
    whole = spark.createDataFrame([("a", 0, {}, [("", "socket", 7)])], by + "symbols map<long,string>, imports array<struct<library:string,name:string,iat_va:long>>")
    calls = spark.createDataFrame([("a", 0, 5, 7, "slot")], by + "place long, iat_va long, through string")
    found = entries.functions(starts, calls, spark.createDataFrame([("a", 0, 9, 0)], by + "place long, target long"), whole, spark.createDataFrame([("socket", "net")], "name string, tag string"))
    assert [(r.va, r.imports, list(r.tags), r.callers) for r in found.collect()] == [(0, 1, ["net"], 0)]
    optimized = plan_of(found).split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert "Window" not in optimized and "parquet" in optimized


def executed(df) -> str:
    """The plan as it ran, with what the sizes of its stages changed."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def plans_written(monkeypatch, *modules) -> list[str]:
    """The plans of all tables that `modules` will write, as they ran."""
    plans = []

    def kept(df, *name):
        plans.append(executed(df))
        return stash(df, *name)

    for module in modules:
        monkeypatch.setattr(module, "stash", kept)
    return plans


def test_import_calls_broadcast_nothing(spark, monkeypatch, tmp_path):
    """Small files can hold millions of equal names and slots; no table that grows with the inputs goes through the driver."""
    plans = plans_written(monkeypatch, programs, entries)
    spark.range(40).selectExpr("id AS doc_id", "'a.bin' AS source", "'some text' AS text").write.parquet(str(tmp_path / "documents.parquet"))
    found = programs.import_calls(spark, str(tmp_path))
    plans.append(executed(found))
    assert found.count() == 2 * 2 * (1 + 2 + 3 + 4) * 10 and len(plans) == 3
    assert sum(p.count("SortMergeJoin") for p in plans) and not any("Broadcast" in p for p in plans)


def test_function_table_broadcasts_names_only(spark, monkeypatch, tmp_path):
    """Of all tables only the given capabilities, which do not grow with the inputs, go through the driver."""
    plans = plans_written(monkeypatch, entries)
    spark.range(40).selectExpr("id AS doc_id", "'a.bin' AS source", "'some text' AS text").write.parquet(str(tmp_path / "documents.parquet"))
    found = programs.function_table(spark, str(tmp_path))
    plans.append(executed(found))
    # A function of its own begins at the symbol of each PE file.
    assert found.count() == 2 * (1 + 2 + 3 + 4) * 10 + 40 and {r.tags for r in found.collect()} == {"", "calls_filesystem", "calls_filesystem calls_network"}
    last = plans[-1].split("== Initial Plan ==")[0]
    joins = [x for x in last.splitlines() if "BroadcastHashJoin" in x]
    assert len(plans) == 5 and len(joins) == last.count("BroadcastExchange") == 1 and "Inner, BuildRight" in joins[0]
    assert sum(p.count("SortMergeJoin") for p in plans) and not any("Broadcast" in p for p in plans[:-1])


def test_tight_strings_choose_the_first_function(spark):
    written = [("a", p, t, b) for p, t, b in [(0, 0, 65), (1, 1, 66), (2, 2, 67), (10, 0, 88), (11, 1, 89), (99, 0, 90)]]
    blocks = [("a", 0, 0, 5), ("a", 0, 5, 20), ("a", 1, 0, 20)]
    edges = [("a", 0, 0, 5), ("a", 0, 5, 5)]
    df = spark.createDataFrame(written, "input_id string, place long, target long, byte int")
    found = flow.tight_strings(df, spark.createDataFrame(blocks, "input_id string, function long, start long, end long"), spark.createDataFrame(edges, "input_id string, function long, src long, dst long"), ["input_id"], 2)
    assert sorted((r.function, r.block, r.value, r.tight) for r in found.collect()) == [(0, 0, "ABC", False), (0, 5, "XY", True)]
    assert "CartesianProduct" not in plan_of(found) and "BroadcastNestedLoopJoin" not in plan_of(found)


def test_writes_become_strings_where_they_are(spark):
    """The strings of whole rows of writes are those of a row for each byte; no byte becomes a row, with or without blocks."""
    rng = random.Random(5)
    writes = [("ab"[i % 2], i, [(rng.randrange(60), rng.randrange(3), rng.randrange(-20, 20), bytearray(rng.choices(b"abc\0", k=rng.randint(0, 4)))) for _ in range(80)]) for i in range(6)]
    writes = [(a, i, sorted({w[0]: w for w in ws}.values())) for a, i, ws in writes] + [("c", 9, [])]
    df = spark.createDataFrame(writes, f"input_id string, arch_idx int, writes {WRITES}")
    by = ["input_id", "arch_idx"]
    each = [(a, i, r, p, t + k, b) for a, i, ws in writes for p, r, t, bs in ws for k, b in enumerate(bs)]
    plain = spark.createDataFrame(each, "input_id string, arch_idx int, region long, place long, target long, byte int")
    got = code.written_strings(df, by, 2, most=3)
    assert {(*r[:3], r.target, r.value) for r in got.collect()} == {(*r[:3], r.target, r.value) for r in code.stack_strings(plain, [*by, "region"], 2).collect()}
    for r in got.collect():
        last = {}
        for *_, p, t, _ in sorted((x for x in each if x[:3] == r[:3]), key=lambda x: x[3]):
            last[t] = p
        assert r.writers == list(dict.fromkeys(last[r.target + k] for k in range(len(r.value))))[:3]
    blocks = [("a", i, f, s, s + n) for i in range(6) for f, s, n in [(0, 0, 9), (0, 4, 20), (1, 2, 40), (1, 50, 0)]]
    spans = spark.createDataFrame(blocks, "input_id string, arch_idx int, function long, start long, end long")
    place = lambda a, i, p: min(((f, s) for x, j, f, s, e in blocks if (x, j) == (a, i) and s <= p < e), default=None)
    keyed = [(a, i, *(place(a, i, p) or (None, None)), None if place(a, i, p) else r, p, t, b) for a, i, r, p, t, b in each]
    wide = spark.createDataFrame(keyed, "input_id string, arch_idx int, function long, block long, region long, place long, target long, byte int")
    placed = code.written_strings(df, by, 2, spans)
    keys = [*by, "region", "function", "block", "target", "value"]
    expected = {tuple(r) for part, own in (("function is not null", ["function", "block"]), ("function is null", ["region"])) for r in code.stack_strings(wide.where(part), [*by, *own], 2).select(*by, *(c if c in own else F.lit(None).cast("long").alias(c) for c in keys[2:5]), "target", "value").collect()}
    assert {tuple(r) for r in placed.select(*keys).collect()} == expected and len(expected) > 20
    for found in (got, placed):
        assert "Generate" not in plan_of(found) and "Window" not in plan_of(found)
    bytewise = b"".join(b"\xc6\x44\x24" + bytes([i, 97 + i]) for i in range(6)) + b"\xc6\x45\xf0z" * 5 + b"\xc3"
    assert code.x86_writes(bytewise, True) == [(5 * i, i, bytes([97 + i])) for i in range(6)] + [(30 + 4 * i, -16, b"z") for i in range(5)]


def test_writers_are_partial_aggregates(spark):
    written = spark.createDataFrame([("a", 100 - i, i, 65) for i in range(20)] + [("a", 5, 3, 66)], "input_id string, place long, target long, byte int")
    strings = stash(code.stack_strings(written, ["input_id"], 4))
    df = flow.string_writers(strings, stash(written), ["input_id"])
    assert [r.writers for r in df.collect()] == [[100, 99, 98, 97, 96, 95, 94, 93]]
    assert plan_of(df).count("WindowGroupLimit") >= 2 and "partial_min" in plan_of(df)


def built(kind: str) -> bytes:
    if kind == "pe":
        head = b"MZ".ljust(0x3C, b"\0") + struct.pack("<I", 64) + b"PE\0\0" + struct.pack("<HHIIIHH", 0x8664, 1, 0, 0, 0, 240, 0)
        optional = struct.pack("<HBBIIIIIQ", 0x20B, 0, 0, 0, 0, 0, 0x1000, 0x1000, 0x140000000).ljust(112, b"\0") + struct.pack("<4I", 0x1028, 40, 0x1000, 40).ljust(128, b"\0")
        return (head + optional + struct.pack("<8sIIIIIIHHI", b".text", 512, 0x1000, 512, 400, 0, 0, 0, 0, 0x60000020)).ljust(400, b"\0") + DIRECTORIES + b"body of the file\0" * 20
    if kind == "elf":
        names = b"\0.text\0.symtab\0.strtab\0"
        body, symbols = b"some text here\0", b"\0" * 24 + struct.pack("<IBBHQQ", 1, 0x12, 0, 1, 0x401000, 0)
        at = [64, 64 + len(body), 64 + len(body) + len(symbols)]
        row = lambda name, t, f, va, where, size, link: struct.pack("<IIQQQQIIQQ", name, t, f, va, where, size, link, 0, 1, 0)
        table = row(0, 0, 0, 0, 0, 0, 0) + row(1, 1, 6, 0x401000, at[0], len(body), 0) + row(7, 2, 0, 0, at[1], len(symbols), 3) + row(15, 3, 0, 0, at[2], len(names), 0)
        return b"\x7fELF\x02\x01\x01" + b"\0" * 9 + struct.pack("<HHIQQQIHHHHHH", 2, 0x3E, 1, 0x401000, 0, at[2] + len(names), 0, 64, 0, 0, 64, 4, 3) + body + symbols + names + table
    commands = struct.pack("<II16sQQQQIIII", 0x19, 152, b"__TEXT", 0x1000, 0x1000, 0, 400, 5, 5, 1, 0) + struct.pack("<16s16sQQIIIIIIII", b"__text", b"__TEXT", 0x1000, 60, 300, 0, 0, 0, 0, 0, 0, 0)
    commands += struct.pack("<12I", 0x22, 48, 0, 0, 240, 12, 0, 0, 0, 0, 0, 0) + struct.pack("<6I", 2, 24, 260, 2, 300, 20)
    return (struct.pack("<IIIIIIII", 0xFEEDFACF, 0x01000007, 0, 2, 3, len(commands), 0, 0) + commands).ljust(240, b"\0") + b"\x40_x\0\x70\x08\x90\x90\xb0\x90\0\0" + b"text of the slice\0" * 10


@pytest.mark.parametrize("kind", ["pe", "elf", "mach_o"])
def test_damaged_headers_end(kind):
    """Random changes of all three headers: every row can be written, and none takes long."""
    rng, whole = random.Random(kind), built(kind)
    assert architectures("a", whole)[0]["error"] is None
    long = range(-(1 << 63), 1 << 63)
    began = time.time()
    for _ in range(1500):
        data = bytearray(whole)
        for _ in range(rng.randint(1, 6)):
            at = rng.randrange(4 if kind != "pe" else 2, min(len(data), 640))
            n = rng.choice([1, 2, 4, 8])
            data[at : at + n] = rng.choice([b"\xff", b"\0", b"\x7f", rng.randbytes(1)]) * n
        data = bytes(data[: rng.choice([len(data), len(data), rng.randrange(len(data) + 1)])])
        for x in architectures("a", data):
            numbers = [x["size"], x["scan_start"], x["scan_end"], x["entry"] or 0, *(n for s in x["sections"] for n in (s["file_offset"], s["file_size"], s["virtual_address"], s["file_offset"] + s["file_size"]))]
            assert all(n in long for n in [*numbers, *(i["iat_va"] for i in x["imports"]), *(va for va, _ in x["symbols"])])
            for extractor in extractors.REGISTRY.values():
                if not x["error"]:
                    list(extractor.rows(x, data, Options()))
    assert time.time() - began < 60


def test_endless_tables_are_errors(spark):
    endless = bytearray(built("mach_o"))
    endless[240:252] = b"\x40x\0\x70\0\xc0\xff\xff\xff\xff\x0f\0"
    far = bytearray(built("elf"))
    table = struct.unpack_from("<Q", far, 40)[0]
    struct.pack_into("<QQ", far, table + 64 + 16, (1 << 63) - 4, (1 << 64) - 1)
    rows = [("endless", bytearray(bytes(endless))), ("far", far), ("good", bytearray(b"\0a good input\0"))]
    result = extract(spark.createDataFrame(rows, "input_id string, content binary"), Options(enabled=("static_ascii",)))
    assert {r.input_id: r.error is not None for r in result.inputs.collect()} == {"endless": True, "far": False, "good": False}
    assert result.strings.where("value = 'a good input'").count() == 1


def test_registry_in_sql_and_in_extract(spark):
    own = extractors.Extractor("lines", "n:bigint,first:string", lambda x, data, options: [(data.count(b"\n"), data[:3].decode("ascii"))])
    df = spark.createDataFrame([("a", bytearray(b"abc\n\n")), ("b", bytearray(bytes.fromhex("4883ec08c3")))], "input_id string, content binary")
    result = extract(df, Options(enabled=("static_ascii",), format="sc64"), extractors=["function_starts", own])
    assert sorted((r.input_id, r.n) for r in result.more["lines"].collect()) == [("a", 2)]
    assert [(r.input_id, r.warning[:23]) for r in result.warnings.where("warning like 'extractor%'").collect()] == [("b", "extractor lines: 'ascii")]
    assert [(r.input_id, r.place, r.section) for r in result.more["function_starts"].collect()] == [("b", 0, "shellcode")]
    extractors.register(spark, "function_starts", own, prefix="find_")
    df.createOrReplaceTempView("files_here")
    assert [r.place for r in spark.sql("SELECT place FROM files_here, LATERAL find_function_starts(content, null, 4, 'sc64')").collect()] == [0]
    assert sorted(r.n for r in spark.sql("SELECT n FROM (SELECT content FROM files_here WHERE input_id = 'a'), LATERAL find_lines(content)").collect()) == [2]
    for wrong in (["nothing"], ["strings", "strings"]):
        with pytest.raises(ValueError):
            extract(df, extractors=wrong)
    from stringloom.plans.extract import examined

    assert plan_of(examined(df, Options(), extractors=["strings", "references"])).split("== Physical Plan ==")[1].count("MapInArrow") == 1


def test_tight_needs_a_graph(spark):
    df = spark.createDataFrame([("a", bytearray(b"x"))], "input_id string, content binary")
    with pytest.raises(ValueError):
        extract(df, Options(enabled=("tight",)))
    assert "tight" in " ".join(r.warning for r in extract(df, Options(enabled=("tight", "stack"))).warnings.collect())


def test_settled_leaves_other_threads_tables(spark):
    """A table that another thread writes meanwhile stays."""
    inside, done, theirs = threading.Event(), threading.Event(), []

    def other():
        inside.wait(60)
        theirs.append(stash(spark.range(7).select(F.col("id").alias("x"))))
        done.set()

    thread = threading.Thread(target=other)
    thread.start()

    def make():
        mine = stash(spark.range(3))
        inside.set()
        done.wait(60)
        return mine.select((F.col("id") + 1).alias("id"))

    assert settled(make, "outer").count() == 3
    thread.join()
    assert theirs[0].count() == 7


def plain_split(blocks, edges):
    """What `split_blocks` says, block by block, of one function."""
    starts = {a for a, _ in blocks}
    points = starts | {d for _, d in edges}
    parts, outs = {}, {}
    for a, b in sorted(set(blocks)):
        borders = [a, *sorted(p for p in points if a < p < b), b]
        for i, (x, y) in enumerate(zip(borders, borders[1:])):
            last = i + 2 == len(borders)
            parts.setdefault(x, []).append((i > 0, y, a, last))
            if last and not (i and x in starts):
                outs.setdefault(a, set()).add(x)
    kept = {x: min(own) for x, own in parts.items()}  # of equal parts, one that goes on
    new = {(x, y) for x, (_, y, _, _) in kept.items()}
    falls = {(x, y) for x, (_, y, _, last) in kept.items() if not last}
    moved = {(o, d) for s, d in edges for o in (outs.get(s, ()) if s in starts else (s,))}
    return new, moved | falls


def test_graphs_are_split_along_their_places(spark):
    """Against a plain loop, over blocks that overlap, share starts and ends, or are empty; a plan of one shuffle of graphs without joins."""
    rng = random.Random(7)
    graphs = {}
    for f in range(400):
        span = rng.choice([6, 12, 40])
        blocks = [(a, a + rng.choice([0, 1, 3, 5, 9])) for a in (rng.randrange(span) for _ in range(rng.randint(0, 7)))]
        graphs[f] = (blocks, [(rng.choice([a for a, _ in blocks] or [3]) if rng.random() < 0.8 else rng.randrange(span), rng.randrange(span + 4)) for _ in range(rng.randint(0, 8))])
    blocks = spark.createDataFrame([(f, *x) for f, (b, _) in graphs.items() for x in b], "function int, start long, end long")
    edges = spark.createDataFrame([(f, *x) for f, (_, e) in graphs.items() for x in e], "function int, src long, dst long")
    found = flow.split_graph(blocks, edges, [])
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows))
    for f, graph in graphs.items():
        own = tuple({(a, b) for g, a, b, edge in rows if g == f and edge == kind} for kind in (False, True))
        assert own == plain_split(*graph), (f, graph)
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_graphs_with_rows_without_places(spark):
    """What has no place or no function stays as it is; a function of more rows than a batch is split as one."""
    blocks = [(1, 0, 9), (None, 0, 9), (1, None, 4), (2, 0, 30_000)] + [(2, i, 30_000) for i in range(1, 25_000, 7)]
    edges = [(1, None, 5), (1, None, 5), (1, 0, None), (None, 3, 4), (1, 0, 3)]
    blocks, edges = spark.createDataFrame(blocks, "function int, start long, end long"), spark.createDataFrame(edges, "function int, src long, dst long")
    new, ways = (sorted(map(tuple, x.collect()), key=str) for x in flow.split_blocks(blocks, edges, []))
    assert [x for x in new if x[0] != 2] == sorted([(1, 0, 3), (1, 3, 5), (1, 5, 9), (1, None, 4), (None, 0, 9)], key=str)
    assert [x for x in ways if x[0] != 2] == sorted([(1, 0, 3), (1, 3, 5), (1, 5, 3), (1, None, 5), (1, 0, None), (None, 3, 4)], key=str)
    starts = [0, *range(1, 25_000, 7)]
    assert {x[1:] for x in new if x[0] == 2} == set(zip(starts, [*starts[1:], 30_000])) and {x[1:] for x in ways if x[0] == 2} == set(zip(starts, starts[1:]))


def test_function_starts_make_no_call_a_place(monkeypatch):
    """Addresses of a section are made at once, also where they pass the end of a long."""
    code_ = bytes.fromhex("FF4300D1 1F2003D5") * 500
    section = dict(idx=0, name="x", file_offset=0, file_size=len(code_), virtual_address=(1 << 63) - 8, executable=True, writable=False)
    calls, own = [], entries._signed
    monkeypatch.setattr(entries, "_signed", lambda x: (calls.append(1), own(x))[1])
    found = entries.starts_of("aarch64", [section], code_)
    assert found == [(own((1 << 63) - 8 + 8 * i), 4, "x", own((1 << 63) - 8 + 4000)) for i in range(500)]
    assert sum(calls) < 10
