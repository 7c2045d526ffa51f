"""Registered queries over executables: Spark expressions put the texts of the given tables into ELF, PE and Mach-O files and into
code, and the extraction finds them again. SQL says where they must be."""

from __future__ import annotations

import struct
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stringloom.catalogue import ORACLES as ORACLES
from stringloom.catalogue import QUERIES as QUERIES
from stringloom.catalogue import TAGS_SQL, ascii_sql, query, read, turns
from stringloom.functions import table as table_function
from stringloom.operators import strings
from stringloom.plans import sinks
from stringloom.plans.extract import examined, extract
from stringloom.schema import Options
from stringloom.sources import inputs
from stringloom.sources.containers import parse

ASCII = Options(enabled=("static_ascii",))


def number(n: Column | int, width: int, little: bool = True) -> Column:
    """A non-negative number as bytes."""
    digits = F.lpad(F.hex(F.lit(n).cast("long") if isinstance(n, int) else n.cast("long")), 2 * width, "0")
    return F.unhex(F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in reversed(range(width)))) if little else digits)


def raw(b: bytes) -> Column:
    return F.lit(b)


def joined(*parts: Column | bytes) -> Column:
    return F.concat(*(raw(p) if isinstance(p, bytes) else p for p in parts))


def elf(sections: list[tuple], entry: int = 0x1000) -> Column:
    """A 64-bit ELF of (name, type, flags, address, body[, link]), the first at byte 64."""
    names = [b"", *(s[0] for s in sections), b".shstrtab"]
    table = b"\0".join(names) + b"\0"
    where = [0]
    for n in names:
        where.append(where[-1] + len(n) + 1)
    at, placed = F.lit(64).cast("long"), []
    for s in [*sections, (b".shstrtab", 3, 0, 0, raw(table))]:
        size = F.octet_length(s[4])
        placed.append((at, size))
        at = at + size
    ident = b"\x7fELF\x02\x01\x01" + b"\0" * 9 + struct.pack("<HHIQQ", 2, 0x3E, 1, entry, 0)
    head = joined(ident, number(at, 8), struct.pack("<IHHHHHH", 0, 64, 0, 0, 64, len(sections) + 2, len(sections) + 1))
    rows = [raw(b"\0" * 64)]
    for i, (s, (begin, size)) in enumerate(zip([*sections, (b".shstrtab", 3, 0, 0, None)], placed)):
        rows.append(joined(struct.pack("<IIQQ", where[i + 1], s[1], s[2], s[3]), number(begin, 8), number(size, 8), struct.pack("<IIQQ", s[5] if len(s) > 5 else 0, 0, 1, 0)))
    return joined(head, *(s[4] for s in sections), table, *rows)


def between(c: str) -> Column:
    """A text between NULs."""
    return joined(b"\0", F.encode(F.coalesce(F.col(c), F.lit("")), "UTF-8"), b"\0")


def texts(spark, sf_dir) -> DataFrame:
    """(id, code, body): of each document its source and its text between NULs."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), between("source").alias("code"), between("text").alias("body"))


def found_in(df: DataFrame, content: Column, options: Options = ASCII) -> DataFrame:
    return strings.located(examined(inputs.table(df.select("id", content.alias("content")), "id", "content"), options))


# Runs of sources and texts by their parts of the file: `code` begins at `at`, the text right after it.
def two_parts(at: int, code: str, body: str, code_va: int, body_va: int) -> str:
    return rf"""
        WITH {ascii_sql()}, coded AS (SELECT CAST(doc_id AS VARCHAR) AS input_id, coalesce(source, '') AS source FROM documents)
        SELECT input_id, value, {at} + strlen(source) + 3 + "offset" AS "offset", '{body}' AS section, {body_va} + 1 + "offset" AS address, false AS in_code FROM runs JOIN coded USING (input_id)
        UNION ALL SELECT input_id, source, {at + 1}, '{code}', {code_va + 1}, true FROM coded WHERE strlen(source) >= 4"""


@query(two_parts(64, ".text", ".rodata", 0x401000, 0x402000))
def elf_sections(spark, sf_dir):
    """Documents as ELF files: sources in the code, texts in the read-only data."""
    content = elf([(b".text", 1, 6, 0x401000, F.col("code")), (b".rodata", 1, 2, 0x402000, F.col("body"))])
    rows = found_in(texts(spark, sf_dir), content).where(F.col("section").isin(".text", ".rodata"))
    return rows.select("input_id", "value", "offset", "section", "address", "in_code")


@query("""
    SELECT CAST(doc_id AS VARCHAR) AS input_id, 'symbol' AS kind, 'fn_' || doc_id AS name, 4198400 + doc_id AS address FROM documents
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 'import', 'get_' || doc_id, 4206592 + 8 * doc_id FROM documents""")
def elf_symbols(spark, sf_dir):
    """A function and an import of each document's ELF file, from its symbol table and its relocations."""
    df = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    symbol = lambda info, value: joined(struct.pack("<IBBH", 1, info, 0, 1), value, b"\0" * 8)
    name = lambda prefix: joined(b"\0", F.encode(F.concat(F.lit(prefix), F.col("id")), "UTF-8"), b"\0")
    content = elf([
        (b".symtab", 2, 0, 0, joined(b"\0" * 24, symbol(0x12, number(F.col("id") + 0x401000, 8))), 2), (b".strtab", 3, 0, 0, name("fn_")),
        (b".dynsym", 11, 0, 0, joined(b"\0" * 24, symbol(0x12, raw(b"\0" * 8))), 4), (b".dynstr", 3, 0, 0, name("get_")),
        (b".rela.plt", 4, 0, 0, joined(number(F.col("id") * 8 + 0x403000, 8), struct.pack("<QQ", 1 << 32 | 7, 0))),
    ])
    parsed = parse(inputs.table(df.select("id", content.alias("content")), "id", "content"))
    symbols = parsed.select("input_id", F.lit("symbol").alias("kind"), F.explode("symbols").alias("address", "name"))
    imports = parsed.select("input_id", F.lit("import").alias("kind"), F.explode("imports").alias("i")).select("input_id", "kind", F.col("i.iat_va").alias("address"), F.col("i.name").alias("name"))
    return symbols.unionByName(imports).select("input_id", "kind", "name", "address")


#: Imports and exports at 0x1000 behind the image base: one library with a name and a number, one exported function.
DIRECTORIES = (
    struct.pack("<5I", 0x1060, 0, 0, 0x10A0, 0x1080) + b"\0" * 20  # imports
    + struct.pack("<10I", 0, 0, 0, 0, 1, 1, 1, 0x10E0, 0x10E4, 0x10E8)[:40].ljust(0x38, b"\0")  # exports, at 0x1028
    + struct.pack("<QQQ", 0x10C0, 1 << 63 | 7, 0).ljust(0x20, b"\0")  # 0x1060: what is imported
    + struct.pack("<QQQ", 0x10C0, 1 << 63 | 7, 0).ljust(0x20, b"\0")  # 0x1080: the same, where addresses go
    + b"KERNEL32.dll\0".ljust(0x20, b"\0") + b"\0\0CreateFileA\0".ljust(0x20, b"\0")  # 0x10a0, 0x10c0
    + struct.pack("<IIHH", 0x2001, 0x10F0, 0, 0).ljust(0x10, b"\0") + b"Exported\0".ljust(0x10, b"\0")  # 0x10e0: address, name, place
)


def pe() -> Column:
    """A 64-bit PE with its directories at byte 512 and `code` and `body` behind them."""
    optional = struct.pack("<HBBIIIIIQ", 0x20B, 0, 0, 0, 0, 0, 0x2000, 0x2000, 0x140000000).ljust(112, b"\0")
    optional += struct.pack("<4I", 0x1028, 40, 0x1000, 40).ljust(128, b"\0")
    head = b"MZ".ljust(0x3C, b"\0") + struct.pack("<I", 64) + b"PE\0\0" + struct.pack("<HHIIIHH", 0x8664, 3, 0, 0, 0, len(optional), 0) + optional
    section = lambda name, va, size, at, flags: joined(name.ljust(8, b"\0"), number(size, 4), struct.pack("<I", va), number(size, 4), number(at, 4), struct.pack("<IIHHI", 0, 0, 0, 0, flags))
    code, begin = F.octet_length("code"), F.lit(512 + len(DIRECTORIES))
    rows = [section(b".idata", 0x1000, F.lit(len(DIRECTORIES)), F.lit(512), 0xC0000040), section(b".text", 0x2000, code, begin, 0x60000020), section(b".rdata", 0x900000, F.octet_length("body"), begin + code, 0x40000040)]
    return joined(head, *rows, b"\0" * (512 - len(head) - 120), DIRECTORIES, F.col("code"), F.col("body"))


@query(two_parts(512 + len(DIRECTORIES), ".text", ".rdata", 0x140002000, 0x140900000))
def pe_sections(spark, sf_dir):
    """Documents as PE files."""
    rows = found_in(texts(spark, sf_dir), pe()).where(F.col("section").isin(".text", ".rdata"))
    return rows.select("input_id", "value", "offset", "section", "address", "in_code")


@query("""
    SELECT CAST(doc_id AS VARCHAR) AS input_id, 'CreateFileA' AS name, 'KERNEL32.dll' AS library, 5368713344 AS address FROM documents
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 'ordinal 7', 'KERNEL32.dll', 5368713352 FROM documents
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 'Exported', NULL, 5368717313 FROM documents""")
def pe_names(spark, sf_dir):
    """Imports by name and by number, and exports, of the same files."""
    parsed = parse(inputs.table(texts(spark, sf_dir).select("id", pe().alias("content")), "id", "content"))
    imports = parsed.select("input_id", F.explode("imports").alias("i")).select("input_id", "i.name", "i.library", F.col("i.iat_va").alias("address"))
    exports = parsed.select("input_id", F.explode("symbols").alias("address", "name")).select("input_id", "name", F.lit(None).cast("string").alias("library"), "address")
    return imports.unionByName(exports)


def mach_slice(cpu: int, body: Column) -> Column:
    """A 64-bit Mach-O whose one section holds the body, at byte 184."""
    size = F.octet_length(body)
    segment = joined(struct.pack("<II16sQ", 0x19, 152, b"__TEXT", 0x1000), number(size, 8), struct.pack("<Q", 0), number(F.lit(0), 8), struct.pack("<IIII", 5, 5, 1, 0))
    section = joined(struct.pack("<16s16sQ", b"__cstring", b"__TEXT", 0x10B8), number(size, 8), struct.pack("<IIIIIIII", 184, 0, 0, 0, 2, 0, 0, 0))
    return joined(struct.pack("<IIIIIIII", 0xFEEDFACF, cpu, 0, 2, 1, 152, 0, 0), segment, section, body)


@query(rf"""
    WITH {ascii_sql()}, coded AS (SELECT CAST(doc_id AS VARCHAR) AS input_id, coalesce(source, '') AS source FROM documents)
    SELECT input_id, 0 AS arch_idx, source AS value, 64 + 184 + 1 AS "offset", '[x86_64] __TEXT,__cstring' AS section, 4280 + 1 AS address FROM coded WHERE strlen(source) >= 4
    UNION ALL SELECT input_id, 1, value, 64 + 184 + strlen(source) + 2 + 184 + 1 + "offset", '[aarch64] __TEXT,__cstring', 4280 + 1 + "offset" FROM runs JOIN coded USING (input_id)""")
def mach_slices(spark, sf_dir):
    """Documents as Mach-O files for two architectures: sources in one, texts in the other."""
    df = texts(spark, sf_dir).select("id", mach_slice(0x01000007, F.col("code")).alias("one"), mach_slice(0x0100000C, F.col("body")).alias("two"))
    one, two = F.octet_length("one"), F.octet_length("two")
    arch = lambda cpu, at, size: joined(struct.pack(">II", cpu, 0), number(at, 4, False), number(size, 4, False), b"\0" * 4)
    fat = joined(struct.pack(">II", 0xCAFEBABE, 2), arch(0x01000007, F.lit(64), one), arch(0x0100000C, one + 64, two), b"\0" * 16, F.col("one"), F.col("two"))
    return found_in(df, fat).where(F.col("section").contains("__cstring")).select("input_id", "arch_idx", "value", "offset", "section", "address")


GO_HEAD = b"\xf1\xff\xff\xff\0\0\x01\x08" + struct.pack("<QQQQ", 0, 0, 0, 40)


def go(df: DataFrame) -> Column:
    """An ELF whose line table has the words of the text as names, and whose read-only data is the source."""
    names = F.encode(F.regexp_replace(F.coalesce("text", F.lit("")), "[ \\n]", "\0"), "UTF-8")
    return elf([(b".gopclntab", 1, 2, 0x500000, joined(GO_HEAD, names, b"\0")), (b".rodata", 1, 2, 0x402000, F.encode(F.coalesce("source", F.lit("")), "UTF-8"))])


def documents(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source")


@query(rf"""
    WITH segments AS (SELECT doc_id, unnest(regexp_extract_all(text, '[ \n]*[^ \n]+')) AS seg, generate_subscripts(regexp_extract_all(text, '[ \n]*[^ \n]+'), 1) AS i FROM documents),
    words AS (SELECT doc_id, regexp_extract(seg, '[^ \n]+$') AS value, sum(strlen(seg)) OVER (PARTITION BY doc_id ORDER BY i) AS ends FROM segments)
    SELECT CAST(doc_id AS VARCHAR) AS input_id, value, CAST(64 + {len(GO_HEAD)} + ends - strlen(value) AS BIGINT) AS "offset", '.gopclntab' AS section, CAST(5242880 + {len(GO_HEAD)} + ends - strlen(value) AS BIGINT) AS address FROM words
    WHERE strlen(value) >= 4 AND regexp_matches(value, '[./]') AND regexp_full_match(value, '[\x20-\x7E\p{{L}}\p{{N}}]+')
    UNION ALL SELECT CAST(doc_id AS VARCHAR), source, CAST(64 + {len(GO_HEAD)} + strlen(text) + 1 AS BIGINT), '.rodata', 4202496 FROM documents WHERE strlen(source) >= 4""")
def go_names(spark, sf_dir):
    """Documents as Go programs: words with a dot or a slash are names of functions."""
    df = documents(spark, sf_dir)
    return found_in(df, go(df), Options(enabled=("go",))).select("input_id", "value", "offset", "section", "address")


RUST_MARK, RUST_STAMP = b"library/std/src/panicking.rs\0", b"rust\0\0\0\x08rustc 1.80.0 (051478957 2024-07-21)\0"


def rust() -> Column:
    """An ELF with the text as read-only data and as metadata."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return elf([(b".rodata", 1, 2, 0x402000, joined(RUST_MARK, text)), (b".rustc", 1, 0, 0, joined(RUST_STAMP, text))])


LOOSE = r"\x00-\x08\x0a-\x1f\x7f-\x9f"


@query(rf"""
    WITH segments AS (SELECT doc_id, text, unnest(regexp_extract_all(text, '[{LOOSE}]*[^{LOOSE}]+')) AS seg, generate_subscripts(regexp_extract_all(text, '[{LOOSE}]*[^{LOOSE}]+'), 1) AS i FROM documents),
    pieces AS (SELECT doc_id, text, regexp_extract(seg, '[^{LOOSE}]+$') AS value, sum(strlen(seg)) OVER (PARTITION BY doc_id ORDER BY i) AS ends FROM segments),
    bytes AS (SELECT doc_id, strlen(text) AS size, substr(regexp_replace(regexp_replace(regexp_replace(text, '[\x{{10000}}-\x{{10FFFF}}]', '????', 'g'), '[\x{{800}}-\x{{FFFF}}]', '???', 'g'), '[\x{{80}}-\x{{7FF}}]', '??', 'g'), 1, 8192 - {len(RUST_STAMP)}) AS b FROM documents),
    marks AS (SELECT doc_id, size, unnest(regexp_extract_all(b, '[^a-z_]*[a-z_][a-z0-9_]*')) AS seg, generate_subscripts(regexp_extract_all(b, '[^a-z_]*[a-z_][a-z0-9_]*'), 1) AS i FROM bytes),
    crates AS (SELECT doc_id, size, regexp_extract(seg, '[a-z_][a-z0-9_]*$') AS value, sum(strlen(seg)) OVER (PARTITION BY doc_id ORDER BY i) AS ends FROM marks),
    firsts AS (SELECT doc_id, size, value, min(ends - strlen(value)) AS place FROM crates WHERE strlen(value) BETWEEN 4 AND 32 AND value NOT IN ('rust', 'rustc') GROUP BY ALL)
    SELECT CAST(doc_id AS VARCHAR) AS input_id, value, CAST(64 + {len(RUST_MARK)} + ends - strlen(value) AS BIGINT) AS "offset", '.rodata' AS section FROM pieces WHERE strlen(value) >= 4
    UNION ALL SELECT CAST(doc_id AS VARCHAR), '{RUST_MARK[:-1].decode()}', 64, '.rodata' FROM documents
    UNION ALL SELECT CAST(doc_id AS VARCHAR), '{RUST_STAMP[8:-1].decode()}', CAST(64 + {len(RUST_MARK)} + strlen(text) + 8 AS BIGINT), '.rustc' FROM documents
    UNION ALL SELECT CAST(doc_id AS VARCHAR), unnest(['rust', 'rustc']), CAST(64 + {len(RUST_MARK)} + strlen(text) + unnest([0, 8]) AS BIGINT), '.rustc' FROM documents
    UNION ALL SELECT CAST(doc_id AS VARCHAR), value, CAST(64 + {len(RUST_MARK)} + size + {len(RUST_STAMP)} + place AS BIGINT), '.rustc' FROM firsts""")
def rust_text(spark, sf_dir):
    """Documents as Rust programs: read-only text, the compiler's stamp, and names in the first part of the metadata."""
    return found_in(documents(spark, sf_dir), rust(), Options(enabled=("rust",))).select("input_id", "value", "offset", "section")


@query("""
    SELECT CAST(doc_id AS VARCHAR) AS input_id, '_ZN4core' || doc_id || 'E' AS value, 4198400 + doc_id AS address FROM documents""")
def rust_symbols(spark, sf_dir):
    """Mangled names of a Rust program's symbols; others are left out."""
    df = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    name = F.encode(F.concat(F.lit("_ZN4core"), F.col("id"), F.lit("E")), "UTF-8")
    entry = lambda at, value: joined(number(at, 4), struct.pack("<BBH", 0x12, 0, 1), number(value, 8), b"\0" * 8)
    own = joined(b"\0main\0", name, b"\0")
    content = elf([(b".symtab", 2, 0, 0, joined(b"\0" * 24, entry(F.lit(6), F.col("id") + 0x401000), entry(F.lit(1), F.lit(0x301000))), 2), (b".strtab", 3, 0, 0, own), (b".note", 1, 2, 0, raw(RUST_MARK))])
    found = extract(inputs.table(df.select("id", content.alias("content")), "id", "content"), Options(enabled=("rust",))).strings
    return found.where("location.section is null").select("input_id", "value", "location.address")


@query("""
    SELECT CAST(doc_id AS VARCHAR) AS input_id, CASE doc_id % 4 WHEN 0 THEN 'elf' WHEN 1 THEN 'elf' WHEN 2 THEN 'pe' ELSE 'unknown' END AS format,
        CASE WHEN doc_id % 4 < 3 THEN 'x86_64' END AS arch, CASE WHEN doc_id % 4 < 3 THEN 64 ELSE 0 END AS bits, CASE doc_id % 4 WHEN 0 THEN 'go' WHEN 1 THEN 'rust' END AS language,
        CASE WHEN doc_id % 4 = 3 THEN 'format not recognized; scanning input as raw bytes' END AS warning FROM documents""")
def input_labels(spark, sf_dir):
    """What each input is: Go and Rust programs, PE files and plain texts."""
    # A branch of a condition makes each part of a file anew for every use of it; a projection of its own makes it once.
    df = documents(spark, sf_dir).withColumns({"code": between("source"), "body": between("text")})
    plain = df.select("id", F.encode(F.lit("plain"), "UTF-8").alias("content"))
    files = [df.where(F.col("id") % 4 == kind).select("id", make().alias("content")) for kind, make in enumerate((lambda: go(df), rust, pe))]
    whole = reduce(DataFrame.union, files, plain.where("not (id % 4 <=> 0 or id % 4 <=> 1 or id % 4 <=> 2)"))
    result = extract(inputs.table(whole, "id", "content"), ASCII)
    return result.inputs.join(result.warnings, "input_id", "left").select("input_id", "format", "arch", F.coalesce("bits", F.lit(0)).alias("bits"), "language", "warning")


CHUNK = 100


def stack_code(digits: DataFrame) -> DataFrame:
    """(id, content): code that writes bytes, given in hexadecimal digits as `h`, to the stack, with a return after each CHUNK."""
    head = F.array(*(F.lit(f"C64424{i:02X}") for i in range(CHUNK)))
    one = lambda x, i: F.concat(F.get(head, i % CHUNK), x, F.when(i % CHUNK == CHUNK - 1, "C3").otherwise(""))
    written = F.transform(F.split("h", r"(?<=\G..)(?!$)"), one)
    return digits.where("h <> ''").select("id", F.unhex(F.array_join(written, "")).alias("content"))


@query(rf"""
    WITH plain AS (SELECT conv_id || '/' || turn AS input_id, regexp_replace(text, '[^\x00-\x7F]', '?', 'g') AS t FROM conversations),
    chunks AS (SELECT input_id, k, substr(t, k * {CHUNK} + 1, {CHUNK}) AS c FROM (SELECT input_id, t, unnest(range(0, (length(t) + {CHUNK - 1}) // {CHUNK})) AS k FROM plain))
    SELECT input_id, unnest(regexp_extract_all(c, '[\t\x20-\x7E]{{4,}}')) AS value, k * {5 * CHUNK + 1} AS function_va FROM chunks""")
def code_stack(spark, sf_dir):
    """Turns as code that writes each of their characters to the stack, a function for every hundred."""
    digits = turns(spark, sf_dir).select("id", F.hex(F.encode(F.regexp_replace("text", r"[^\x00-\x7F]", "?"), "UTF-8")).alias("h"))
    found = extract(inputs.table(stack_code(digits), "id", "content"), Options(enabled=("stack",), format="sc64")).strings
    return found.select("input_id", "value", "location.function_va")


@query(f"""
    WITH {ascii_sql("conversations", "(conv_id * 1000 + turn)")}
    SELECT input_id, value, "offset" + CAST(input_id AS BIGINT) % 1000 % 5 * 7 + 9 AS address, CASE WHEN "offset" = 0 THEN CAST(CAST(input_id AS BIGINT) % 1000 % 5 + 1 AS INTEGER) ELSE 0 END AS xrefs FROM runs""")
def code_references(spark, sf_dir):
    """Turns behind code that takes their address, once or several times."""
    df = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", (F.col("turn") % 5 + 1).cast("int").alias("n"))
    lea = lambda i: F.concat(F.lit("488D05"), F.hex(number((F.col("n") - i - 1) * 7 + 2, 4)))
    code = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lea), ""))
    content = joined(code, b"\xc3\0", F.encode("text", "UTF-8"))
    return found_in(df, content, Options(enabled=("static_ascii",), format="sc64")).select("input_id", "value", "address", "xrefs")


@query(rf"""
    WITH {ascii_sql("conversations", "(conv_id * 1000 + turn)")}
    SELECT input_id, '{{"value":' || to_json(value) || ',"kind":"static_ascii","encoding":"ascii","location":{{"offset":' || "offset" || ',"address":' || "offset" || ',"section":"raw"}}}}' AS line FROM runs""")
def json_lines(spark, sf_dir):
    df = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return sinks.json_lines(extract(inputs.table(df, "id", "text"), ASCII))


@query(rf"""
    WITH {ascii_sql("conversations", "(conv_id * 1000 + turn)")}, sizes AS (SELECT CAST(conv_id * 1000 + turn AS VARCHAR) AS input_id, strlen(text) AS size FROM conversations)
    SELECT input_id, 0 AS part, 'stringloom: format=unknown, size=' || size || ' bytes' AS line FROM sizes
    UNION ALL SELECT input_id, 2, '=== static strings (' || count(*) || ') ===' FROM runs GROUP BY input_id
    UNION ALL SELECT input_id, 2, format('0x{{:016x}}  ', "offset") || value FROM runs
    UNION ALL SELECT input_id, 9, 'warnings:' FROM sizes UNION ALL SELECT input_id, 9, '  - format not recognized; scanning input as raw bytes' FROM sizes""")
def report_lines(spark, sf_dir):
    df = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return sinks.report(extract(inputs.table(df, "id", "text"), ASCII)).select("input_id", "part", "line")


@query(f"WITH {ascii_sql()} SELECT * FROM runs")
def sql_function(spark, sf_dir):
    """The scan as a table function in SQL."""
    table_function.register(spark)
    inputs.table(read(spark, sf_dir, "documents"), "doc_id", "text").createOrReplaceTempView("stringloom_inputs")
    return spark.sql("SELECT input_id, t.value, t.offset FROM stringloom_inputs, LATERAL extract_strings(content, 'static_ascii') t")


@query(f"""
    WITH {ascii_sql("conversations", "(conv_id * 1000 + turn)")}, tokens AS (SELECT DISTINCT value AS token FROM runs), {TAGS_SQL},
    twice AS (SELECT input_id, value, "offset", row_number() OVER (PARTITION BY input_id, value ORDER BY "offset") > 1 AS again FROM runs)
    SELECT input_id, value, "offset", concat_ws(' ', 'code', nullif(tags, ''), CASE WHEN again THEN 'duplicate' END) AS tags FROM twice JOIN tagged ON value = token""")
def code_tags(spark, sf_dir):
    """Turns as raw code: every string of theirs is in a section that can be executed."""
    df = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    found = extract(inputs.table(df, "id", "text"), Options(enabled=("static_ascii",), format="sc64", annotate=True)).strings
    return found.select("input_id", "value", "location.offset", F.array_join("analysis.tags", " ").alias("tags"))


@query(rf"""
    WITH plain AS (SELECT conv_id || '/' || turn AS input_id, regexp_replace(text, '[^\x00-\x7F]', '?', 'g') AS t FROM conversations WHERE role = 'user')
    SELECT input_id, unnest(regexp_extract_all(substr(t, 1, {CHUNK}), '[\t\x20-\x7E]{{4,}}')) AS value FROM plain""")
def only_candidates(spark, sf_dir):
    """Strings of the same code whose functions are candidates: here the first function of what a user says."""
    digits = turns(spark, sf_dir).select("id", F.hex(F.encode(F.regexp_replace("text", r"[^\x00-\x7F]", "?"), "UTF-8")).alias("h"))
    found = extract(inputs.table(stack_code(digits), "id", "content"), Options(enabled=("stack",), format="sc64"))
    users = read(spark, sf_dir, "conversations").where("role = 'user'")
    candidates = users.select(F.concat_ws("/", "conv_id", "turn").alias("input_id"), F.lit(0).cast("long").alias("va"))
    return replace(found, candidates=candidates).only_candidates().strings.select("input_id", "value")
