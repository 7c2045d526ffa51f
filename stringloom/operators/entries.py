"""Where functions begin and which imports they call, from bytes of executable sections: masks over all places at once.

Both go by the bytes wherever they stand, so bytes within another instruction or within data can look like a function's first
ones; calls count only if they lead to an import that the input lists."""

from __future__ import annotations

from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stringloom.operators.intervals import first_containing
from stringloom.tables import stash

# First bytes of functions; ?? is any byte, a-b a range.
PROLOGUES = {
    "x86_64": ("55 48 89 e5", "53 48 83 ec ??", "48 83 ec ??", "48 81 ec ?? ?? ?? ??", "41 54-57"),
    "x86": ("55 89 e5", "83 ec ??"),
}
# Of AArch64, mask and value of a word: stp x29, x30, [sp, #-n]! and sub sp, sp, #n.
ARM_PROLOGUES = ((0xFFC07FFF, 0xA9807BFD), (0xFF0003FF, 0xD10003FF))

#: Rows of the extractors below.
START = "place:bigint,size:int,section:string,section_end:bigint"
CALL = "place:bigint,iat_va:bigint,through:string"


def _body(s: dict, data: bytes) -> bytes:
    return data[s["file_offset"] : s["file_offset"] + s["file_size"]]


def _has(b: np.ndarray, at: np.ndarray, pattern: str) -> np.ndarray:
    """Whether the bytes at each place are those of a pattern."""
    parts = pattern.split()
    fits = at + len(parts) <= len(b)
    inside = np.where(fits, at, 0)
    for i, part in enumerate(parts):
        if part != "??":
            low, high = (int(x, 16) for x in (part.split("-") if "-" in part else (part, part)))
            own = b[inside + i] if len(b) >= len(parts) else np.zeros(len(at), np.uint8)
            fits &= (own >= low) & (own <= high)
    return fits


def _prologues(arch: str | None, body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and sizes of all first bytes of functions, overlapping ones too, in order; at one place the longest."""
    if arch == "aarch64":
        words = np.frombuffer(body, "<u4", len(body) // 4)
        hit = np.zeros(len(words), bool)
        for mask, value in ARM_PROLOGUES:
            hit |= (words & np.uint32(mask)) == value
        at = 4 * np.flatnonzero(hit)
        return at, np.full(len(at), 4)
    b = np.frombuffer(body, np.uint8)
    size = np.zeros(len(b), np.int64)
    for pattern in PROLOGUES.get(arch or "", ()):
        at = np.flatnonzero(b == int(pattern[:2], 16))
        at = at[_has(b, at, pattern)]
        size[at] = np.maximum(size[at], len(pattern.split()))
    at = np.flatnonzero(size)
    return at, size[at]


def prologues(arch: str | None, body: bytes) -> list[tuple[int, int]]:
    """The same as pairs."""
    return list(zip(*(x.tolist() for x in _prologues(arch, body))))


def starts_of(arch: str | None, sections: list[dict], data: bytes) -> list[tuple[int, int, str, int]]:
    """START for each prologue of the executable sections that lie within the input; addresses are made for all places at once."""
    out = []
    for s in sections:
        if s["executable"] and s["file_offset"] + s["file_size"] <= len(data):
            at, size = _prologues(arch, _body(s, data))
            places = (at.astype(np.uint64) + np.uint64(s["virtual_address"] & (1 << 64) - 1)).view(np.int64)
            out += zip(places.tolist(), size.tolist(), repeat(s["name"]), repeat(_signed(s["virtual_address"] + s["file_size"])))
    return out


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def _at(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The signed 32-bit numbers at these places, as 64 bits."""
    raw = b[at].astype(np.uint32) | b[at + 1].astype(np.uint32) << 8 | b[at + 2].astype(np.uint32) << 16 | b[at + 3].astype(np.uint32) << 24
    return raw.view(np.int32).astype(np.int64)


def _pairs(b: np.ndarray, first: int, second: int, size: int) -> np.ndarray:
    """Places of two bytes that `size` bytes begin with."""
    n = len(b) - size + 1
    return np.flatnonzero((b[:n] == first) & (b[1 : n + 1] == second)) if n > 0 else np.zeros(0, np.int64)


def _x86_calls(b: np.ndarray, base: int, wide: bool, slots: np.ndarray):
    """(calls, jumps) through slots of imports, each (offset, slot)."""
    for second in (0x15, 0x25):
        at = _pairs(b, 0xFF, second, 6)
        held = _at(b, at + 2)
        target = np.int64(base) + at + 6 + held if wide else held & 0xFFFFFFFF
        hit = np.isin(target, slots)
        yield at[hit], target[hit]


def _arm_calls(b: np.ndarray, base: int, slots: np.ndarray):
    """Likewise of AArch64: adrp, ldr from that page, then blr or br of what was read; an add may stand between."""
    w = np.frombuffer(b.tobytes(), "<u4", len(b) // 4).astype(np.int64)
    n = len(w) - 2
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2, (np.zeros(0, np.int64),) * 2
    load = (w[1 : n + 1] & 0xFFC00000) == 0xF9400000
    first = np.flatnonzero(((w[:n] & 0x9F000000) == 0x90000000) & load & ((w[1 : n + 1] >> 5 & 31) == (w[:n] & 31)))
    imm = (w[first] >> 5 & 0x7FFFF) << 2 | w[first] >> 29 & 3
    page = ((np.int64(base) + 4 * first) & ~np.int64(0xFFF)) + ((imm ^ 1 << 20) - (1 << 20) << 12)
    target = page + (w[first + 1] >> 10 & 0xFFF) * 8
    read = w[first + 1] & 31
    later = np.minimum(first + 3, len(w) - 1)
    found = []
    for kind in (0xD63F0000, 0xD61F0000):
        goes = lambda x: ((x & 0xFFFFFC1F) == kind) & ((x >> 5 & 31) == read)  # noqa: B023, E731
        add = ((w[first + 2] & 0xFF800000) == 0x91000000) & (first + 3 < len(w))
        hit = (goes(w[first + 2]) | add & goes(w[later])) & np.isin(target, slots)
        found.append((4 * first[hit], target[hit]))
    return tuple(found)


def _calls(arch: str, base: int, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offset, target) of what looks like a direct call."""
    if arch == "aarch64":
        w = np.frombuffer(b.tobytes(), "<u4", len(b) // 4).astype(np.int64)
        at = np.flatnonzero((w & 0xFC000000) == 0x94000000)
        far = ((w[at] & 0x3FFFFFF) ^ 1 << 25) - (1 << 25)
        return 4 * at, np.int64(base) + 4 * at + 4 * far
    at = np.flatnonzero(b[: max(0, len(b) - 4)] == 0xE8)
    target = np.int64(base) + at + 5 + _at(b, at + 1)
    return at, target if arch == "x86_64" else target & 0xFFFFFFFF


def import_calls_of(arch: str | None, sections: list[dict], imports: list[dict], data: bytes) -> list[tuple[int, int, str]]:
    """CALL for each place that calls an import: through its slot (`slot`), or by a stub that jumps through it (`stub`). Jumps through
    slots, which are the stubs themselves, are `jump`."""
    slots = np.unique(np.array([x["iat_va"] for x in imports], np.int64))
    bodies = [(s["virtual_address"], np.frombuffer(_body(s, data), np.uint8)) for s in sections if s["executable"]]
    if not len(slots) or arch not in ("x86", "x86_64", "aarch64"):
        return []
    out, stubs = [], {}
    with np.errstate(over="ignore"):
        for base, b in bodies:
            (calls, called), (jumps, through) = _arm_calls(b, base, slots) if arch == "aarch64" else _x86_calls(b, base, arch == "x86_64", slots)
            out += [(_signed(base + at), slot, "slot") for at, slot in zip(calls.tolist(), called.tolist())]
            for at, slot in zip(jumps.tolist(), through.tolist()):
                out.append((_signed(base + at), slot, "jump"))
                # A stub can begin with a prefix, and with a mark for targets of indirect branches before that.
                for begin in {at, at - 1 if at and b[at - 1] in (0xF2, 0x48) else at}:
                    marked = b[begin - 4 : begin].tobytes() == b"\xf3\x0f\x1e\xfa" and begin >= 4
                    stubs |= {_signed(base + x): slot for x in ((begin, begin - 4) if marked else (begin,))}
        known = np.array(sorted(stubs), np.int64)
        for base, b in bodies if stubs else []:
            at, target = _calls(arch, base, b)
            hit = np.isin(target, known)
            out += [(_signed(base + x), stubs[t], "stub") for x, t in zip(at[hit].tolist(), target[hit].tolist())]
    return sorted(out)


def direct_calls_of(arch: str | None, sections: list[dict], symbols, entry: int | None, data: bytes) -> list[tuple[int, int]]:
    """(place, target) of each direct call that leads to where a function begins: first bytes, a symbol, or the input's entry."""
    if arch not in ("x86", "x86_64", "aarch64"):
        return []
    known = {at for at, *_ in starts_of(arch, sections, data)} | {va for va, _ in symbols} | ({entry} if entry is not None else set())
    starts, out = np.array(sorted(known), np.int64), []
    with np.errstate(over="ignore"):
        for s in (s for s in sections if s["executable"]):
            at, target = _calls(arch, s["virtual_address"], np.frombuffer(_body(s, data), np.uint8))
            hit = np.isin(target, starts)
            out += [(_signed(s["virtual_address"] + x), t) for x, t in zip(at[hit].tolist(), target[hit].tolist())]
    return out


def regions(starts: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """(input_id, arch_idx, function, start, end): functions from where they begin to where the next one of their section does or the
    section ends. `starts` are rows of START by input and architecture; `named` (input_id, arch_idx, place) are other known
    beginnings, such as symbols; those within a section of `starts` count. Bytes that follow first bytes at once, as a frame's
    size follows a saved register, begin no function of their own. A window over one section's starts, which lie in one input."""
    part = ["input_id", "arch_idx", "section_end"]
    along = Window.partitionBy(*part).orderBy("place")
    own = starts.select(*part, "place", "size").distinct()
    head = own.withColumn("met", F.lag(F.col("place") + F.col("size")).over(along)).where(F.col("met").isNull() | (F.col("place") > F.col("met"))).select(*part, "place")
    if named is not None:
        ends = own.groupBy(*part).agg(F.min("place").alias("first"))
        others = named.join(ends.hint("shuffle_merge"), part[:2]).where((F.col("place") >= F.col("first")) & (F.col("place") < F.col("section_end"))).select(*part, "place")
        head = head.union(others).distinct()
    return head.select("input_id", "arch_idx", F.col("place").alias("function"), F.col("place").alias("start"), F.coalesce(F.lead("place").over(along), "section_end").alias("end"))


def import_calls(calls: DataFrame, imports: DataFrame, functions: DataFrame | None = None) -> DataFrame:
    """(input_id, arch_idx, function, place, iat_va, name, library, through): calls (rows of CALL by input and architecture) with what
    they call, by equality of the slot, and with the function, of `functions` as `regions` gives them, that does it. All sides
    grow with the inputs, so all are shuffled at every size: Spark goes by the size of their files, and a few MB of Parquet of equal
    names and slots are millions of rows, which it would broadcast."""
    by = ["input_id", "arch_idx"]
    named = calls.where("through <> 'jump'").join(imports.select(*by, "iat_va", "name", "library").hint("shuffle_merge"), [*by, "iat_va"])
    if functions is None:
        named = named.withColumn("function", F.lit(None).cast("long"))
    else:
        named = stash(named)
        held = first_containing(named, functions, by, ["start"], "place").select(*by, "place", F.col("first.function").alias("function"))
        named = named.join(held.hint("shuffle_merge"), [*by, "place"], "left")
    return named.select(*by, "function", "place", "iat_va", "name", "library", "through")


def functions(starts: DataFrame, calls: DataFrame, direct: DataFrame, parsed: DataFrame, capabilities: DataFrame) -> DataFrame:
    """(input_id, arch_idx, va, end, name, byte_size, callers, callees, imports, tags): each function that begins at first bytes or at a
    symbol behind some, with how many functions call it and are called by it, how many imports it calls and what these can do.
    `starts`, `calls` and `direct` are the rows of the extractors, `parsed` is PARSED, `capabilities` is (name, tag) in lower case,
    a list of names that each task holds whole. A call in no function counts for none; one of a function by itself does not count.

    Functions, what they call and whom they call are written, as each is read several times: one plan of all would go over the
    inputs' facts many times, and the driver would hold all of its stages. Nothing but `capabilities` is broadcast."""
    by = ["input_id", "arch_idx"]
    symbols = parsed.select(*by, F.explode("symbols").alias("va", "name"))
    spans = stash(regions(starts, symbols.select(*by, F.col("va").alias("place"))))
    imports = parsed.select(*by, F.explode("imports").alias("i")).select(*by, "i.*")
    called = import_calls(calls, imports, spans).where("function is not null").select(*by, "function", "iat_va", F.lower("name").alias("name")).distinct()
    called = stash(called)
    use = called.groupBy(*by, "function").agg(F.countDistinct("iat_va").alias("imports"))
    able = called.where(F.col("name").rlike("^[a-z_]")).join(F.broadcast(capabilities), "name").groupBy(*by, "function").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    held = first_containing(direct, spans, by, ["start"], "place").select(*by, "place", F.col("first.function").alias("function"))
    pairs = stash(direct.join(held.hint("shuffle_merge"), [*by, "place"]).select(*by, "function", "target").where("function <> target").distinct())
    out = pairs.groupBy(*by, "function").agg(F.count("*").alias("callees"))
    into = pairs.groupBy(*by, F.col("target").alias("function")).agg(F.count("*").alias("callers"))
    found = spans
    for side in (use, able, out, into, symbols.withColumnRenamed("va", "function")):
        found = found.join(side.hint("shuffle_merge"), [*by, "function"], "left")
    number = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return found.select(
        *by, F.col("function").alias("va"), "end", "name", (F.col("end") - F.col("start")).alias("byte_size"), number("callers"), number("callees"), number("imports"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags")
    )
