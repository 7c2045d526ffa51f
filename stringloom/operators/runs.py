"""Scans: one pass over each input finds its printable runs, in Arrow batches; nothing is shuffled."""

from __future__ import annotations

import base64
import heapq
import re
from itertools import compress
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from stringloom.schema import RUN, STATIC, Options

#: Characters that separate text: controls but tab, surrogates, U+FFFD, U+FEFF and non-characters.
BREAKS = "\x00-\x08\x0a-\x1f\x7f-\x9f\ud800-\udfff\ufffd\ufeff\ufdd0-\ufdef" + "".join(chr(p << 16 | x) for p in range(17) for x in (0xFFFE, 0xFFFF))
#: Inputs of a batch that goes back to Spark.
INPUTS = 64
#: The least length of a Base64 token.
TOKEN = 8


class Run(NamedTuple):
    """A string in an input; `place` is the position of its section among the input's."""

    kind: str
    encoding: str
    offset: int
    length: int
    value: str
    align: int = 0
    decoded_offset: int | None = None
    source_length: int | None = None
    place: int | None = None


class Chunk(NamedTuple):
    """Strings of one kind and alignment, column by column; `place` is their section's, where all are known to be in one."""

    kind: str
    encoding: str
    align: int
    offset: list[int]
    length: list[int]
    value: list[str]
    place: int | None = None

    def rows(self) -> list[Run]:
        return [Run(self.kind, self.encoding, o, n, v, self.align, place=self.place) for o, n, v in zip(self.offset, self.length, self.value)]


def run_type() -> T.DataType:
    """array<RUN>, also where no session is, as in a task."""
    kinds = {"double": T.DoubleType(), "string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType()}
    fields = (x.split(":") for x in RUN.removeprefix("struct<").removesuffix(">").split(","))
    return T.ArrayType(T.StructType([T.StructField(name, kinds[kind]) for name, kind in fields]))


class Strings:
    """Strings of several inputs as the columns of RUN, so that no string becomes an object of its own on the way."""

    NAMES = tuple(x.split(":")[0] for x in RUN.removeprefix("struct<").removesuffix(">").split(","))

    def __init__(self):
        self.columns: dict[str, list] = {name: [] for name in self.NAMES if name != "quality"}
        self.ends = [0]

    def add(self, sections: list[dict], chunk: Chunk, shift: int = 0, targets: dict[int, int] | None = None) -> None:
        """A chunk's strings with their sections and addresses and, if `targets` gives how often code takes each address, with their
        references."""
        offset = [x + shift for x in chunk.offset] if shift else chunk.offset
        n = len(offset)
        own = places(offset, sections) if chunk.place is None else [chunk.place] * n
        self._extend([chunk.kind] * n, [chunk.encoding] * n, [chunk.align] * n, offset, chunk.length, chunk.value, own, sections, targets)
        self.columns["decoded_offset"] += [None] * n
        self.columns["source_length"] += [None] * n

    def add_runs(self, sections: list[dict], found: list[Run]) -> None:
        """Strings that know their section, column by column."""
        if found:
            kind, encoding, offset, length, value, align, decoded, source, place = zip(*found)
            self._extend(kind, encoding, align, list(offset), length, value, place, sections, None)
            self.columns["decoded_offset"] += decoded
            self.columns["source_length"] += source

    def _extend(self, kind, encoding, align, offset, length, value, place, sections, targets) -> None:
        c, n = self.columns, len(offset)
        for name, own in (("kind", kind), ("encoding", encoding), ("align", align), ("offset", offset), ("length", length), ("value", value)):
            c[name] += own
        if n and place[0] is not None and place.count(place[0]) == n:
            s = sections[place[0]]
            base, last = s["virtual_address"] - s["file_offset"], max(offset, default=0)
            address = [base + x for x in offset] if base + last < 1 << 63 else [base + x if base + x < 1 << 63 else None for x in offset]
            c["section"] += [s["name"]] * n
            c["in_code"] += [s["executable"]] * n
        else:
            known = [None if p is None else sections[p] for p in place]
            address = [None if s is None else _address(s, x) for s, x in zip(known, offset)]
            c["section"] += [None if s is None else s["name"] for s in known]
            c["in_code"] += [s is not None and s["executable"] for s in known]
        c["address"] += address
        c["xrefs"] += [targets.get(x, 0) for x in address] if targets else [0] * n

    def close(self) -> None:
        """The strings of the next input follow. Strings come in the order of extraction."""
        values = self.columns["value"][self.ends[-1] :]
        seen: set[str] = set()
        if len(set(values)) == len(values):
            self.columns["again"] += [False] * len(values)
        else:
            for value in values:
                self.columns["again"].append(value in seen)
                seen.add(value)
        self.columns["nth"] += self._nth(values) if len(seen) else [0] * len(values)
        self.ends.append(len(self.columns["kind"]))

    def _nth(self, values: list[str]) -> list[int]:
        """RUN's `nth` of the last strings. Of equal offsets the one that is extracted first comes first."""
        kind, encoding, offset, code = (self.columns[name][self.ends[-1] :] for name in ("kind", "encoding", "offset", "in_code"))
        out, first, other = [2] * len(values), {}, {}
        for i in sorted(range(len(values)), key=offset.__getitem__):
            key = (values[i], kind[i], encoding[i])
            if key not in first:
                first[key], out[i] = code[i], 0
            elif code[i] != first[key] and key not in other:
                other[key], out[i] = True, 1
        return out

    def arrow(self, options: Options) -> pa.ListArray:
        """A column of lists. Strings that are scored too low are left out at once: what comes later sees values alone, so it drops
        all rows of a value or none."""
        kind = to_arrow_type(run_type())
        fields = {f.name: f for f in kind.value_type}
        columns = {name: pa.array(own, fields[name].type) for name, own in self.columns.items() if name != "quality"}
        n, ends = len(columns["value"]), np.array(self.ends, np.int32)
        scores = qualities(columns["value"]) if options.wants_quality else None
        columns["quality"] = pa.nulls(n, pa.float64()) if scores is None else pa.array(scores)
        rows = pa.StructArray.from_arrays([columns[name] for name in fields], fields=list(fields.values()))
        if options.min_quality > 0:
            good = scores >= options.min_quality
            rows, ends = rows.filter(pa.array(good)), np.concatenate(([0], np.cumsum(good)))[ends].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), rows, type=kind)


#: Bytes of letters and digits.
ALNUM = np.array([chr(b).isalnum() and b < 128 for b in range(256)])


def qualities(values: pa.StringArray) -> np.ndarray:
    """`functions.text.quality` of all values at once, from their UTF-8 bytes."""
    ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    if not len(values) or ends[-1] == ends[0]:
        return np.zeros(len(values))
    data = np.frombuffer(values.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    size = np.diff(ends)
    row = np.repeat(np.arange(len(size)), size)
    good = np.concatenate(([0], np.cumsum(ALNUM[data])))
    there = np.zeros((len(size), 256), bool)
    there[row, data] = True
    begins = np.flatnonzero(np.concatenate(([True], (data[1:] != data[:-1]) | (row[1:] != row[:-1]))))
    lengths, owner = np.diff(np.append(begins, len(data))), row[begins]
    longest = np.ones(len(size), np.int64)
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    longest[owner[first]] = np.maximum.reduceat(lengths, first)
    n = np.maximum(size, 1).astype(np.float64)
    score = 0.6 * (((good[ends[1:]] - good[ends[:-1]]) / n) * (there.sum(axis=1) / n)) + 0.4 * (1.0 - (longest - 1) / n) + np.where(size <= 6, 0.2, 0.0)
    return np.where(size == 0, 0.0, np.clip(score, 0.0, 1.0))


def _address(s: dict, offset: int) -> int | None:
    """The address of a place in a section; none if it is beyond those that a long can hold."""
    at = s["virtual_address"] + offset - s["file_offset"]
    return at if at < 1 << 63 else None


def ascii_chunk(data: bytes, least: int) -> Chunk:
    text = data.decode("latin-1")
    spans = [m.span() for m in re.finditer(f"[\\x09\\x20-\\x7e]{{{least},}}", text)]
    return Chunk("static_ascii", "ascii", 0, [a for a, _ in spans], [b - a for a, b in spans], [text[a:b] for a, b in spans])


def utf8_chunk(data: bytes, least: int, with_ascii: bool) -> Chunk:
    """Runs of at least `least` characters; pure ASCII ones only if the ASCII scan is off. Bytes that are no UTF-8 separate."""
    out = Chunk("static_utf8", "utf8", 0, [], [], [])
    if with_ascii and data.isascii():
        return out
    text, seen, at = data.decode("utf-8", "surrogateescape"), 0, 0
    for m in re.finditer(f"[^{BREAKS}]{{{least},}}", text):
        at += len(text[seen : m.start()].encode("utf-8", "surrogateescape"))
        size = len(m[0].encode())
        if not (with_ascii and m[0].isascii()):
            out.offset.append(at)
            out.length.append(size)
            out.value.append(m[0])
        seen, at = m.end(), at + size
    return out


def utf16_chunks(data: bytes, least: int, end: str) -> list[Chunk]:
    """Both alignments; a lone surrogate separates."""
    chunks = []
    for align in (0, 1):
        body = data[align : align + (len(data) - align) // 2 * 2]
        text = body.decode(f"utf-16-{end}", "surrogatepass")
        spans = [m.span() for m in re.finditer(f"[^{BREAKS}]{{{least},}}", text)]
        values = [text[a:b] for a, b in spans]
        if 2 * len(text) == len(body):  # each character is one unit
            offsets, sizes = [align + 2 * a for a, _ in spans], [2 * (b - a) for a, b in spans]
        else:
            offsets, sizes, seen, at = [], [], 0, align
            for (a, b), value in zip(spans, values):
                at += 2 * sum(1 + (c > "\uffff") for c in text[seen:a])
                offsets.append(at)
                sizes.append(len(value.encode(f"utf-16-{end}")))
                seen, at = b, at + sizes[-1]
        chunks.append(Chunk(f"static_utf16_{end}", f"utf16_{end}", align, offsets, sizes, values))
    return chunks


def base64_runs(data: bytes, options: Options, warnings: list[str] | None = None) -> list[Run]:
    """Text within Base64 tokens, one layer deep, with the token's place and the place in what it decodes to. Tokens beyond
    the bounds are left out, and `warnings` says so."""
    kinds = [k for k in STATIC if options.wants(k)] or list(STATIC)
    longest, left, out, beyond = options.bounds.base64_token, options.bounds.base64_total, [], 0
    for m in re.finditer(rb"[A-Za-z0-9+/\-_=]{%d,}" % TOKEN, data):
        if longest is not None and len(m[0]) > longest:
            beyond += 1
            continue
        if (body := decoded(m[0])) is None:
            continue
        if left is not None:
            if len(body) > left:
                if warnings is not None:
                    warnings.append(f"Base64: no more than {options.bounds.base64_total} bytes are decoded")
                break
            left -= len(body)
        out += [x._replace(kind="base64", offset=m.start(), decoded_offset=x.offset, source_length=len(m[0])) for x in static_runs(body, options.min_length, kinds)]
    if beyond and warnings is not None:
        warnings.append(f"Base64: {beyond} tokens of more than {longest} bytes are left out")
    return out


def decoded(token: bytes) -> bytes | None:
    """Strict: one alphabet, padding only at the end and not too long, no bits beyond the last byte."""
    body = token.rstrip(b"=")
    over, pad = len(body) % 4, len(token) - len(body)
    for pattern, extra in ((rb"[A-Za-z0-9+/]+", b"+/"), (rb"[A-Za-z0-9\-_]+", b"-_")):
        if re.fullmatch(pattern, body) and over != 1 and pad <= -len(body) % 4:
            out = base64.b64decode(body + b"=" * (-len(body) % 4), altchars=extra)
            if base64.b64encode(out, extra).rstrip(b"=") == body:
                return out
    return None


def static_chunks(data: bytes, least: int, kinds, mirrored: bool = False) -> list[Chunk]:
    """The scans in their order. Without `mirrored`, UTF-16 strings that only the wrong byte order sees are left out at once; see
    `without_mirrored`."""
    if least == 0:
        return []
    out = [ascii_chunk(data, least)] if "static_ascii" in kinds else []
    if "static_utf8" in kinds:
        out.append(utf8_chunk(data, least, "static_ascii" in kinds))
    wide = [x for end in ("le", "be") if f"static_utf16_{end}" in kinds for x in utf16_chunks(data, least, end)]
    if mirrored or not {"static_utf16_le", "static_utf16_be"} <= set(kinds):
        return out + wide
    plain = {(x.kind, o, n) for x in wide for o, n, v in zip(x.offset, x.length, x.value) if v.isascii()}
    other = {"static_utf16_le": "static_utf16_be", "static_utf16_be": "static_utf16_le"}
    for x in wide:
        kept = [(x.kind, o, n) not in plain or (other[x.kind], o - 1, n + 2) not in plain for o, n in zip(x.offset, x.length)]
        out.append(x if all(kept) else x._replace(**{name: list(compress(getattr(x, name), kept)) for name in ("offset", "length", "value")}))
    return out


def static_runs(data: bytes, least: int, kinds, mirrored: bool = False) -> list[Run]:
    return [r for x in static_chunks(data, least, kinds, mirrored) for r in x.rows()]


def places(offsets: list[int], sections: list[dict]) -> list[int | None]:
    """For each offset the position of the smallest section that holds it, the first of equals. Offsets and sections are
    gone through once, in order, with the open sections in a heap."""
    if len(sections) == 1:  # raw inputs
        begin, end = sections[0]["file_offset"], sections[0]["file_offset"] + sections[0]["file_size"]
        return [0 if begin <= x < end else None for x in offsets]
    out: list[int | None] = [None] * len(offsets)
    begins = sorted(range(len(sections)), key=lambda i: sections[i]["file_offset"])
    open_: list[tuple[int, int, int]] = []
    ahead = 0
    for i in sorted(range(len(offsets)), key=offsets.__getitem__):
        while ahead < len(begins) and sections[begins[ahead]]["file_offset"] <= offsets[i]:
            s = sections[begins[ahead]]
            heapq.heappush(open_, (s["file_size"], s["idx"], begins[ahead]))
            ahead += 1
        while open_ and sections[open_[0][2]]["file_offset"] + open_[0][0] <= offsets[i]:
            heapq.heappop(open_)
        if open_:
            out[i] = open_[0][2]
    return out


def scanned(out: Strings, data: bytes, start: int, end: int, sections: list[dict], options: Options, mirrored: bool = False, targets: dict[int, int] | None = None) -> None:
    """Into `out`, what one input holds between `start` and `end`, each string with its section and, if `targets` gives how often code
    takes each address, with its references."""
    kinds = [k for k in STATIC if options.wants(k)]
    for chunk in static_chunks(data[start:end], options.min_length, kinds, mirrored):
        out.add(sections, chunk, start, targets)


def decoded_into(out: Strings, data: bytes, arch: int, sections: list[dict], options: Options, warnings: list[str] | None = None) -> None:
    """Base64 tokens are sought in the whole input, with its first architecture; their text has no section."""
    if options.decode_base64 and options.wants("base64") and arch == 0:
        out.add_runs(sections, base64_runs(data, options, warnings))


def sliced(batches, rows: int = INPUTS):
    """Batches of a few inputs each: inputs can be large, and so can what is found in them."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def scan(parsed: DataFrame, options: Options, mirrored: bool = False) -> DataFrame:
    """All columns of `parsed` (with `content`, `scan_start` and `scan_end`) but the content, and `runs`. Offsets count from
    the beginning of the input. No shuffle and no join: a row says all that its scan needs."""
    kept = [f for f in parsed.schema.fields if f.name != "content"]
    schema, names = T.StructType([*kept, T.StructField("runs", run_type())]), parsed.columns

    def run(batches):
        for batch in sliced(batches):
            column = {n: batch.column(i) for i, n in enumerate(names)}
            rows = zip(*(column[x].to_pylist() for x in ("content", "scan_start", "scan_end", "arch_idx", "sections")))
            out = Strings()
            for data, start, end, arch, sections in rows:
                scanned(out, data, start, end, sections, options, mirrored)
                decoded_into(out, data, arch, sections, options)
                out.close()
            yield pa.RecordBatch.from_arrays([*(column[f.name] for f in kept), out.arrow(options)], schema.names)

    return parsed.mapInArrow(run, schema)


def without_mirrored(strings: DataFrame) -> DataFrame:
    """Without UTF-16 rows that are an artefact of the other byte order: all ASCII, at offset o with 2n bytes, while the
    other order has an all-ASCII row at o - 1 with 2n + 2 bytes. For tables of strings that are there already; `scan` does the
    same within each input. Only UTF-16 rows take part in the join."""
    wide = strings.where(F.col("kind").isin("static_utf16_le", "static_utf16_be"))
    plain = F.col("value").rlike(r"^\p{ASCII}*$")
    other = wide.where(plain).select(
        "input_id", "arch_idx", F.when(F.col("kind") == "static_utf16_le", "static_utf16_be").otherwise("static_utf16_le").alias("kind"), (F.col("offset") + 1).alias("offset"), (F.col("length") - 2).alias("length")
    )
    mirrored = wide.where(plain).join(other.distinct(), ["input_id", "arch_idx", "kind", "offset", "length"], "left_semi")
    kept = wide.join(mirrored.select("input_id", "arch_idx", "kind", "offset", "length"), ["input_id", "arch_idx", "kind", "offset", "length"], "left_anti")
    return strings.where(~F.col("kind").isin("static_utf16_le", "static_utf16_be")).unionByName(kept)


def ascii_runs_native(inputs: DataFrame, least: int) -> DataFrame:
    """(input_id, value, offset) of ASCII runs with built-in expressions alone: the content as Latin-1 is split at all other
    bytes, and the pieces before a run give its offset. It needs a window for each input; `scan` does not."""
    from pyspark.sql import Window

    pieces = inputs.select("input_id", F.posexplode(F.split(F.decode("content", "ISO-8859-1"), r"[^\x09\x20-\x7E]", -1)).alias("i", "value"))
    before = Window.partitionBy("input_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("offset", F.coalesce(F.sum(F.length("value") + 1).over(before), F.lit(0)).cast("long"))
    return placed.where((F.length("value") >= max(1, least))).select("input_id", "value", "offset")
