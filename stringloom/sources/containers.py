"""Container headers: sections, imports and symbols of executables, as columns beside the content.

Each reader is a small function over the bytes of one input; Spark runs it over Arrow batches. A container that cannot be
read gives a row with `error`, never a failed job."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from stringloom.schema import PARSED, signed

# The architectures' names.
ELF_ARCH = {0x3E: "x86_64", 3: "x86", 40: "arm", 183: "aarch64", 243: "riscv"}
MACH_ARCH = {7: "x86", 0x01000007: "x86_64", 12: "arm", 0x0100000C: "aarch64"}
RAW_ARCH = {"sc32": ("x86", 32), "sc64": ("x86_64", 64), "sc32_arm": ("arm", 32), "sc64_arm64": ("aarch64", 64)}
FALLBACK = "format not recognized; scanning input as raw bytes"


class Left:
    """What an input may still have: entries of tables, each of which takes some bytes of it, and bytes of names, which tables can
    share. Headers that point to the same bytes over and over come to an end here."""

    def __init__(self, data: bytes):
        self.entries = len(data) // 4 + 4096
        self.bytes = 16 * len(data) + (1 << 16)

    def entry(self) -> None:
        self.entries -= 1
        if self.entries < 0:
            raise ValueError("more entries than the input has room for")

    def name(self, data: bytes, at: int) -> str:
        if at < 0:
            raise ValueError("a name before the input")
        stop = data.find(b"\0", at)
        out = data[at : stop if stop >= 0 else None]
        self.bytes -= len(out)
        if self.bytes < 0:
            raise ValueError("more names than the input has room for")
        return out.decode("utf-8", "replace")


def _section(idx, name, offset, size, address, executable, writable) -> dict:
    """Offsets and sizes that no file reaches end at the greatest one that a long can hold."""
    most = (1 << 63) - 1
    offset = min(offset, most)
    return dict(idx=idx, name=name, file_offset=offset, file_size=min(size, most - offset), virtual_address=signed(address), executable=bool(executable), writable=bool(writable))


def read_pe(data: bytes, left: Left) -> list[dict]:
    pe = struct.unpack_from("<I", data, 0x3C)[0]
    if data[pe : pe + 4] != b"PE\0\0":
        raise ValueError("no PE header")
    count, optional = struct.unpack_from("<H", data, pe + 6)[0], pe + 24
    wide = struct.unpack_from("<H", data, optional)[0] == 0x20B
    entry = struct.unpack_from("<I", data, optional + 16)[0]
    base = struct.unpack_from("<Q" if wide else "<I", data, optional + (24 if wide else 28))[0]
    table = optional + struct.unpack_from("<H", data, pe + 20)[0]
    raw = [struct.unpack_from("<8sIIIIIIHHI", data, table + 40 * i) for i in range(count)]
    sections = [_section(i, s[0].rstrip(b"\0").decode("utf-8", "replace"), s[4], s[3], base + s[2], s[9] & 0x20000000, s[9] & 0x80000000) for i, s in enumerate(raw)]

    def place(rva: int) -> int:
        for s in raw:
            if s[2] <= rva < s[2] + max(s[1], s[3]):
                return rva - s[2] + s[4]
        return rva

    directories = optional + (112 if wide else 96)
    exports_at, imports_at = struct.unpack_from("<I", data, directories)[0], struct.unpack_from("<I", data, directories + 8)[0]
    imports, symbols = [], {}
    at = place(imports_at) if imports_at else None
    while at is not None:
        lookup, _, _, library, thunk = struct.unpack_from("<5I", data, at)
        if not library:
            break
        left.entry()
        source = left.name(data, place(library))
        size, kind, by_number = (8, "<Q", 1 << 63) if wide else (4, "<I", 1 << 31)
        for i in range((len(data) - place(lookup or thunk)) // size):
            own = struct.unpack_from(kind, data, place(lookup or thunk) + i * size)[0]
            if not own:
                break
            left.entry()
            name = f"ordinal {own & 0xFFFF}" if own & by_number else left.name(data, place(own) + 2)
            imports.append(dict(library=source, name=name, iat_va=signed(base + thunk + i * size)))
        at += 20
    if exports_at:
        e = place(exports_at)
        number, functions, names, ordinals = *struct.unpack_from("<I", data, e + 24), *struct.unpack_from("<3I", data, e + 28)
        for i in range(number):
            left.entry()
            which = struct.unpack_from("<H", data, place(ordinals) + 2 * i)[0]
            rva = struct.unpack_from("<I", data, place(functions) + 4 * which)[0]
            symbols.setdefault(signed(base + rva), left.name(data, place(struct.unpack_from("<I", data, place(names) + 4 * i)[0])))
    return [dict(format="pe", arch="x86_64" if wide else "x86", bits=64 if wide else 32, entry=signed(base + entry), sections=sections, imports=imports, symbols=symbols)]


def read_elf(data: bytes, left: Left) -> list[dict]:
    wide, end = data[4] == 2, "<" if data[5] == 1 else ">"
    machine = struct.unpack_from(end + "H", data, 18)[0]
    entry, _, table = struct.unpack_from(end + ("QQQ" if wide else "III"), data, 24)
    size, count, names_at = struct.unpack_from(end + "HHH", data, 58 if wide else 46)
    raw = [struct.unpack_from(end + ("IIQQQQIIQQ" if wide else "IIIIIIIIII"), data, table + size * i) for i in range(count)]
    label = lambda s: left.name(data, raw[names_at][4] + s[0]) if names_at < len(raw) else ""
    # A section without bytes in the file (type 8) says nothing about the file's offsets.
    kept = [s for s in raw if s[5] and s[1] not in (0, 8)]
    sections = [_section(i, label(s), s[4], s[5], s[3], s[2] & 4, s[2] & 1) for i, s in enumerate(kept)]

    def entries(s):
        step = 24 if wide else 16
        for at in range(s[4], min(s[4] + s[5], len(data) - step + 1), step):
            left.entry()
            if wide:
                name, info, _, _, value, _ = struct.unpack_from(end + "IBBHQQ", data, at)
            else:
                name, value, _, info, _, _ = struct.unpack_from(end + "IIIBBH", data, at)
            yield left.name(data, raw[s[6]][4] + name) if s[6] < len(raw) else "", info, value

    symbols, imports = {}, {}
    for kind in (2, 11):  # the full table before the dynamic one
        for s in (x for x in raw if x[1] == kind):
            for name, info, value in entries(s):
                if info & 15 == 2 and value and name:
                    symbols.setdefault(signed(value), name)
    dynamic = next((list(entries(s)) for s in raw if s[1] == 11), [])
    for s in sorted((x for x in raw if x[1] in (4, 9)), key=lambda x: (".plt" not in label(x), x[1] == 9)):
        step = {(4, True): 24, (9, True): 16, (4, False): 12, (9, False): 8}[s[1], wide]
        for at in range(s[4], min(s[4] + s[5], len(data) - step + 1), step):
            left.entry()
            where, info = struct.unpack_from(end + ("QQ" if wide else "II"), data, at)
            i = info >> (32 if wide else 8)
            if i < len(dynamic) and dynamic[i][0]:
                imports.setdefault(signed(where), dynamic[i][0])
    found = [dict(library="", name=n, iat_va=va) for va, n in imports.items()]
    return [dict(format="elf", arch=ELF_ARCH.get(machine, "unknown"), bits=64 if wide else 32, entry=signed(entry), sections=sections, imports=found, symbols=symbols)]


def read_mach_o(data: bytes, left: Left) -> list[dict]:
    if data[:4] in (b"\xca\xfe\xba\xbe", b"\xca\xfe\xba\xbf"):
        kind, step = (">5I", 20) if data[3] == 0xBE else (">2I2Q2I", 32)
        parts = [struct.unpack_from(kind, data, 8 + step * i) for i in range(struct.unpack_from(">I", data, 4)[0])]
        inside = lambda x: min(x, len(data))
        out = [_mach_slice(data, p[2], p[3], left) | dict(scan_start=inside(p[2]), scan_end=inside(p[2] + p[3])) for p in parts if data[p[2] : p[2] + 8] != b"!<arch>\n"]
        if not out:
            raise ValueError("no readable architecture")
        if len(out) > 1:
            for x in out:  # sections of several architectures are told apart by name
                x["sections"] = [s | {"name": f"[{x['arch']}] {s['name']}"} for s in x["sections"]]
            out[0]["warnings"] = [f"fat Mach-O: analyzing all {len(out)} architectures"]
        return out
    return [_mach_slice(data, 0, len(data), left)]


def _mach_slice(data: bytes, base: int, size: int, left: Left) -> dict:
    body = data[base : base + size]
    end = "<" if body[:4] in (b"\xce\xfa\xed\xfe", b"\xcf\xfa\xed\xfe") else ">"
    magic, cpu = struct.unpack_from(end + "II", body)
    if magic not in (0xFEEDFACE, 0xFEEDFACF):
        raise ValueError("no Mach-O header")
    wide = magic == 0xFEEDFACF
    at, sections, segments, symbols, binds = 32 if wide else 28, [], [], {}, []
    for _ in range(struct.unpack_from(end + "I", body, 16)[0]):
        command, length = struct.unpack_from(end + "II", body, at)
        left.entry()
        if length < 8:
            raise ValueError("a command shorter than its head")
        if command in (1, 0x19):
            name = body[at + 8 : at + 24].rstrip(b"\0").decode("utf-8", "replace")
            address, many, offset, in_file, _, rights, count, _ = struct.unpack_from(end + ("QQQQIIII" if wide else "IIIIIIII"), body, at + 24)
            segments.append((address, many))
            if in_file:
                sections.append(_section(len(sections), name, base + offset, in_file, address, rights & 4, rights & 2))
            for i in range(count):
                left.entry()
                s = at + (72 + 80 * i if wide else 56 + 68 * i)
                own = body[s : s + 16].rstrip(b"\0").decode("utf-8", "replace")
                where, many, start = struct.unpack_from(end + ("QQI" if wide else "III"), body, s + 32)
                kind = struct.unpack_from(end + "I", body, s + (64 if wide else 56))[0] & 0xFF
                if many and kind not in (1, 12, 18):  # filled with zeros: nothing in the file
                    sections.append(_section(len(sections), f"{name},{own}", base + start, many, where, rights & 4, rights & 2))
        elif command == 2:
            start, number, strings, _ = struct.unpack_from(end + "4I", body, at + 8)
            for i in range(number):
                left.entry()
                name_at, kind, _, _, value = struct.unpack_from(end + ("IBBHQ" if wide else "IBBHI"), body, start + (16 if wide else 12) * i)
                if not kind & 0xE0 and kind & 14 == 14 and value and (name := left.name(body, strings + name_at)):
                    symbols.setdefault(signed(value), name.removeprefix("_"))
        elif command in (0x22, 0x80000022):
            lazy = struct.unpack_from(end + "10I", body, at + 8)
            binds += [body[lazy[k] : lazy[k] + lazy[k + 1]] for k in (2, 4, 6)]
        at += length
    imports = {}
    for code in binds:
        for where, name in _bound(code, segments, 8 if wide else 4, left):
            imports.setdefault(signed(where), name.removeprefix("_"))
    found = [dict(library="", name=n, iat_va=va) for va, n in imports.items()]
    return dict(format="mach_o", arch=MACH_ARCH.get(cpu, "unknown"), bits=64 if wide else 32, entry=None, sections=sections, imports=found, symbols=symbols)


def _bound(code: bytes, segments: list[tuple[int, int]], pointer: int, left: Left):
    """(address, name) of a table of bindings. An address beyond the segment that it was set in is an error."""
    at, name, where, within = 0, "", 0, (0, 0)

    def number() -> int:
        nonlocal at
        out = shift = 0
        while at < len(code):
            b = code[at]
            at += 1
            out |= (b & 0x7F) << shift
            shift += 7
            if shift > 70:
                raise ValueError("a number of more than 64 bits")
            if b < 0x80:
                break
        return out

    def placed() -> int:
        left.entry()
        if within[1] and not within[0] <= where < within[0] + within[1]:
            raise ValueError("a binding outside its segment")
        return where

    while at < len(code):
        op, low = code[at] & 0xF0, code[at] & 0x0F
        at += 1
        if op == 0x40:
            name = left.name(code, at)
            at = code.find(b"\0", at) + 1 or len(code)
        elif op == 0x70:
            within = segments[low] if low < len(segments) else (0, 1 << 64)
            where = within[0] + number()
        elif op in (0x20, 0x60):
            number()
        elif op == 0x80:
            where = (where + number()) & (1 << 64) - 1
        elif op in (0x90, 0xA0, 0xB0):
            yield placed(), name
            where = (where + pointer + (number() if op == 0xA0 else low * pointer if op == 0xB0 else 0)) & (1 << 64) - 1
        elif op == 0xC0:
            times, skip = number(), number()
            for _ in range(times):
                yield placed(), name
                where += pointer + skip


def read_raw(data: bytes, kind: str) -> list[dict]:
    arch, bits = RAW_ARCH[kind]
    whole = _section(0, "shellcode", 0, len(data), 0, True, True)
    return [dict(format="sc64" if kind == "sc64_arm64" else "sc32" if kind == "sc32_arm" else kind, arch=arch, bits=bits, entry=0, sections=[whole], imports=[], symbols={})]


def kind_of(data: bytes) -> str | None:
    head = data[:4]
    if head[:2] == b"MZ":
        return "pe"
    if head == b"\x7fELF":
        return "elf"
    return "mach_o" if head in (b"\xca\xfe\xba\xbe", b"\xca\xfe\xba\xbf", b"\xce\xfa\xed\xfe", b"\xcf\xfa\xed\xfe", b"\xfe\xed\xfa\xce", b"\xfe\xed\xfa\xcf") else None


def read(data: bytes, hint: str = "auto") -> list[dict]:
    """A dict for each architecture of an input. Unknown content is one raw section; what a hint or a magic number promises
    and the bytes do not hold is an error."""
    kind = kind_of(data) if hint == "auto" else hint
    try:
        if kind is None:
            raw = _section(0, "raw", 0, len(data), 0, False, False)
            return [dict(format="unknown", arch=None, bits=None, entry=None, sections=[raw], imports=[], symbols={}, warnings=[FALLBACK])]
        if kind in RAW_ARCH:
            return read_raw(data, kind)
        return {"pe": read_pe, "elf": read_elf, "mach_o": read_mach_o}[kind](data, Left(data))
    except (ValueError, LookupError, ArithmeticError, TypeError, MemoryError, struct.error) as e:
        return [dict(format=kind, arch=None, bits=None, entry=None, sections=[], imports=[], symbols={}, error=f"malformed {kind}: {e}")]


def architectures(input_id: str, data: bytes, hint: str = "auto") -> list[dict]:
    """A row of PARSED for each architecture of an input."""
    out = []
    for i, x in enumerate(read(data, hint)):
        end = 0 if x.get("error") else len(data)
        out.append(dict(scan_start=0, scan_end=end, warnings=[], error=None) | x | dict(input_id=input_id, arch_idx=i, size=len(data), symbols=list(x["symbols"].items())))
    return out


def parse(inputs: DataFrame, hint: str = "auto") -> DataFrame:
    """One row per input and architecture: PARSED and `content`. No shuffle; an input with an error has one row that says so
    and nothing to scan."""
    schema = T.StructType([*T._parse_datatype_string(PARSED).fields, T.StructField("content", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                input_id, data = batch.column(0)[at].as_py(), batch.column(1)[at].as_py() or b""
                yield pa.RecordBatch.from_pylist([x | {"content": data} for x in architectures(input_id, data, hint)], schema=arrow)

    return inputs.select("input_id", "content").mapInArrow(run, schema)
