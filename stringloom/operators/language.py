"""Strings of language runtimes: the toolchain of an input, and what its read-only sections, tables and symbols hold."""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stringloom.operators.runs import Chunk, Run, Strings, run_type, sliced
from stringloom.schema import Bounds, Options

# Names of sections and marks in the bytes.
GO_TEXT = (".rodata", ".rdata", "__rodata", "__TEXT,__rodata", "__TEXT,__cstring")
RUST_TEXT = (".rodata", ".rdata", "__rodata", "__TEXT,__const", "__TEXT,__rodata", "__TEXT,__cstring")
GO_TABLES = (".gopclntab", "__gopclntab", "runtime.pclntab")
RUST_METADATA = (".rustc", "__rustc", "__DATA_CONST,__rustc")
RUST_MARKS = ("rustc", "library/std/src/panicking.rs", "library/core/src/panicking.rs", "called `Result::unwrap()`", "called `Option::unwrap()`")
RUST_TOKENS = ("$LT$", "4core", "3std", "5alloc", "11collections", "17h")

#: Characters that separate text in these sections: controls but tab, and bytes that are no UTF-8.
BREAKS = "\x00-\x08\x0a-\x1f\x7f-\x9f\ud800-\udfff"
TEXT = re.compile(f"[^{BREAKS}]+")
#: Bytes that names of crates have, and those that begin none.
WORD = np.array([b in b"abcdefghijklmnopqrstuvwxyz0123456789_" for b in range(256)])
DIGIT = np.array([b in b"0123456789" for b in range(256)])


def toolchain_of(sections: list[dict], data: bytes) -> str | None:
    """go, rust or None, by section names and by marks anywhere in the input; go first."""
    if any(s["name"].endswith("gopclntab") or "go.buildinfo" in s["name"] for s in sections) or b"\xff Go buildinf:" in data:
        return "go"
    return "rust" if any(mark.encode() in data for mark in RUST_MARKS) else None


def toolchain(sections: Column, content: Column) -> Column:
    """The same as an expression."""
    text = F.decode(content, "ISO-8859-1")
    go = F.exists(sections, lambda s: s["name"].endswith("gopclntab") | s["name"].contains("go.buildinfo")) | F.contains(text, F.lit("ÿ Go buildinf:"))
    rust = F.lit(False)
    for mark in RUST_MARKS:
        rust = rust | F.contains(text, F.lit(mark))
    return F.when(go, "go").when(rust, "rust")


def is_rust_symbol(name: Column) -> Column:
    legacy = F.lit(False)
    for token in RUST_TOKENS:
        legacy = legacy | F.contains(name, F.lit(token))
    return name.rlike(r"^_R[A-Za-z0-9_$]{3,}$") | (name.startswith("_ZN") & name.endswith("E") & legacy)


def _part(data: bytes, s: dict) -> bytes:
    """The bytes of a section; none if it does not lie within the input."""
    end = s["file_offset"] + s["file_size"]
    return data[s["file_offset"] : end] if end <= len(data) else b""


def _run(kind: str, at: int, raw: bytes, place: int) -> Run:
    return Run(kind, "utf8", at, len(raw), raw.decode("utf-8", "replace"), place=place)


def text_chunk(kind: str, data: bytes, s: dict, least: int, place: int = 0) -> Chunk:
    """Runs of at least `least` bytes. Where each character begins is told once for the whole section."""
    body, base = _part(data, s), s["file_offset"]
    try:
        text, valid = body.decode(), True
    except UnicodeDecodeError:
        text, valid = body.decode("utf-8", "surrogateescape"), False
    spans = [m.span() for m in TEXT.finditer(text)]
    begin, end = np.array(spans, np.int64).reshape(-1, 2).T
    if len(text) != len(body):
        if valid:
            at = np.append(np.flatnonzero(np.frombuffer(body, np.int8) >= -64), len(body))  # all bytes but those that go on with a character
        else:
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            loose = (points >= 0xDC80) & (points <= 0xDCFF)  # bytes that are no UTF-8
            at = np.concatenate(([0], np.cumsum(np.where(loose, 1, 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)))))
        begin, end = at[begin], at[end]
    kept = end - begin >= max(1, least)
    values = [text[a:b] for (a, b), k in zip(spans, kept.tolist()) if k]
    return Chunk(kind, "utf8", 0, (base + begin[kept]).tolist(), (end - begin)[kept].tolist(), values, place)


def go_names(data: bytes, s: dict, least: int = 1, place: int = 0, bounds: Bounds = Bounds(), warnings: list[str] | None = None) -> list[Run]:
    """Function names of the line table, as far as it lies within the input: the header gives where they begin; they end with
    NUL. Names of at least `least` bytes count, up to the bounds."""
    body = data[s["file_offset"] : s["file_offset"] + s["file_size"]]
    if len(body) < 8:
        return []
    magic, width = struct.unpack_from("<I", body)[0], body[7]
    if magic not in (0xFFFFFFFA, 0xFFFFFFF0, 0xFFFFFFF1) or body[4:6] != b"\0\0" or width not in (4, 8):
        return []
    field = 8 + (2 if magic == 0xFFFFFFFA else 3) * width
    if field + width > len(body):
        return []
    at, out, cut = struct.unpack_from("<Q" if width == 8 else "<I", body, field)[0], [], 0
    for m in re.finditer(rb"[^\0]+", body[at:]):
        # A longer name goes on as a name of its own after the byte at which it is cut.
        step = len(m[0]) if bounds.name is None else bounds.name + 1
        cut += len(m[0]) >= step
        for begin in range(0, len(m[0]), step):
            raw = m[0][begin : begin + (step if bounds.name is None else bounds.name)]
            if len(raw) >= max(1, least) and _is_name(raw):
                if bounds.names is not None and len(out) >= bounds.names:
                    if warnings is not None:
                        warnings.append(f"Go: no more than {bounds.names} names are taken")
                    return out
                out.append(_run("go", s["file_offset"] + at + m.start() + begin, raw, place))
    if cut and bounds.name is not None and warnings is not None:
        warnings.append(f"Go: {cut} names are cut after {bounds.name} bytes")
    return out


def _is_name(raw: bytes) -> bool:
    if not re.search(rb"[./]", raw):
        return False
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return not re.search(r"[\x00-\x1f\x7f-\x9f]", text) and all(c.isascii() or c.isalnum() for c in text)


def _words(body: bytes, least: int) -> tuple[list[str], list[int]]:
    """Names of at least `least` characters, of small letters, digits and underscores without a digit first, and where they begin."""
    b = np.frombuffer(body, np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate(([False], WORD[b], [False]))))
    begin, end = edges[::2], edges[1::2]
    letters = np.append(np.flatnonzero(WORD[b] & ~DIGIT[b]), len(b))
    begin = letters[np.searchsorted(letters, begin)]
    # What is shorter is skipped by the pattern, so that it is no match of its own.
    return re.findall("[a-z_][a-z0-9_]{%d,}" % (least - 1), body.decode("latin-1")), begin[end - begin >= least].tolist()


def metadata_chunk(data: bytes, s: dict, least: int = 1, place: int = 0, bounds: Bounds = Bounds(), warnings: list[str] | None = None) -> Chunk:
    """The compiler's version and the distinct crate names of a metadata section, of at least `least` bytes, up to the bounds."""
    body, base, stamp = _part(data, s), s["file_offset"], []
    if (m := re.search(rb"rustc [\x20-\x7e]*", body[: bounds.stamp])) is None and bounds.stamp is not None and len(body) > bounds.stamp and warnings is not None:
        warnings.append(f"Rust: the first {bounds.stamp} bytes of {s['name']} are searched for the compiler's version")
    if m and len(m[0]) >= least:
        stamp.append((base + m.start(), m[0].decode()))
    names, places = _words(body[: bounds.crates], max(4, least))
    first = dict(zip(reversed(names), reversed(places)))
    kept = [name for name in dict.fromkeys(names) if len(name) <= 32]
    if bounds.crates is not None and len(body) > bounds.crates and warnings is not None:
        warnings.append(f"Rust: the first {bounds.crates} bytes of {s['name']} are searched for names")
    values = [v for _, v in stamp] + kept
    return Chunk("rust", "utf8", 0, [at for at, _ in stamp] + [base + first[name] for name in kept], list(map(len, values)), values, place)


def rust_metadata(data: bytes, s: dict, least: int = 1, place: int = 0, bounds: Bounds = Bounds(), warnings: list[str] | None = None) -> list[Run]:
    """The same as rows."""
    return metadata_chunk(data, s, least, place, bounds, warnings).rows()


def scanned(out: Strings, data: bytes, sections: list[dict], language: str | None, options: Options, warnings: list[str] | None = None) -> None:
    """Into `out`, the strings of the language that one input was built with."""
    if not language or not options.wants(language):
        return
    least, rest = options.min_length, (options.bounds, warnings)
    own = [(i, s) for i, s in enumerate(sections)]
    named = lambda known: [(i, s) for i, s in own if any(k in s["name"] for k in known)]
    if language == "go":
        for i, s in named(GO_TABLES)[:1]:
            out.add_runs(sections, go_names(data, s, least, i, *rest))
    for i, s in named(GO_TEXT if language == "go" else RUST_TEXT):
        out.add(sections, text_chunk(language, data, s, least, i))
    if language == "rust":
        for i, s in named(RUST_METADATA):
            out.add(sections, metadata_chunk(data, s, least, i, *rest))


def scan(parsed: DataFrame, options: Options) -> DataFrame:
    """All columns of `parsed` with `language` and `runs`: the strings of the language that the input was built with."""
    kept = [f for f in parsed.schema.fields if f.name not in ("content", "language")]
    schema, names = T.StructType([*kept, T.StructField("language", T.StringType()), T.StructField("runs", run_type())]), parsed.columns

    def run(batches):
        for batch in sliced(batches):
            column = {n: batch.column(i) for i, n in enumerate(names)}
            rows = list(zip(column["content"].to_pylist(), column["sections"].to_pylist()))
            languages = [toolchain_of(sections, data) for data, sections in rows]
            out = Strings()
            for (data, sections), language in zip(rows, languages):
                scanned(out, data, sections, language, options)
                out.close()
            yield pa.RecordBatch.from_arrays([*(column[f.name] for f in kept), pa.array(languages, pa.string()), out.arrow(options)], schema.names)

    return parsed.mapInArrow(run, schema)


def rust_symbols(parsed: DataFrame, least: int = 1) -> DataFrame:
    """(input_id, arch_idx, value, address) of mangled symbols of at least `least` bytes."""
    exploded = parsed.select("input_id", "arch_idx", F.explode("symbols").alias("address", "value"))
    return exploded.where(is_rust_symbol(F.col("value")) & (F.octet_length("value") >= least)).select("input_id", "arch_idx", "value", "address")
