"""Registered queries over code: Spark expressions build functions, calls, references and damaged files around the texts of the given
tables, and the operators on code find them again. SQL says what must be found."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stringloom.binaries import CHUNK, documents, elf, joined, number, pe, raw, stack_code
from stringloom.binaries import ORACLES as ORACLES
from stringloom.binaries import QUERIES as QUERIES
from stringloom.catalogue import GRAPH, graph, query, read, turns
from stringloom.functions import capabilities, extractors
from stringloom.operators import code, entries, flow, intervals
from stringloom.plans.extract import extract
from stringloom.schema import Options
from stringloom.sources import inputs
from stringloom.sources.containers import parse
from stringloom.tables import stash

BY = ["input_id", "arch_idx"]
#: A stack-string extraction of raw 64-bit code.
STACK = Options(enabled=("stack",), format="sc64")


def plain_turns(spark, sf_dir) -> DataFrame:
    """(id, h): the characters of each turn, one byte each, in hexadecimal digits."""
    return turns(spark, sf_dir).select("id", F.hex(F.encode(F.regexp_replace("text", r"[^\x00-\x7F]", "?"), "UTF-8")).alias("h"))


# Code that writes CHUNK characters of a turn in each function, one in five bytes; the first half of them in one block, the rest in
# another, which every second function repeats. A function that begins a byte later claims the same bytes.
PLAIN = f"""plain AS (SELECT conv_id || '/' || turn AS input_id, regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g') AS t FROM conversations),
    chunks AS (SELECT input_id, k, substr(t, k * {CHUNK} + 1, {CHUNK}) AS c FROM (SELECT input_id, t, unnest(range(0, (length(t) + {CHUNK - 1}) // {CHUNK})) AS k FROM plain))"""
EACH, HALF = 5 * CHUNK + 1, 5 * CHUNK // 2


def stack_graph(digits: DataFrame) -> tuple[DataFrame, DataFrame]:
    chunk = F.explode(F.sequence(F.lit(0), ((F.length("h") / 2 - 1) / CHUNK).cast("int"))).alias("k")
    functions = digits.where("h <> ''").select(F.col("id").alias("input_id"), F.lit(0).alias("arch_idx"), chunk).withColumn("function", F.col("k").cast("long") * EACH)
    f = F.col("function")
    block = lambda function, start, end: F.struct(function.alias("function"), start.alias("start"), end.alias("end"))
    blocks = functions.select(*BY, F.explode(F.array(block(f, f, f + HALF), block(f, f + HALF, f + EACH), block(f + 1, f + 1, f + EACH))).alias("b")).select(*BY, "b.*")
    edges = functions.select(*BY, "function", f.alias("src"), (f + HALF).alias("dst")).union(functions.where("k % 2 = 1").select(*BY, "function", f + HALF, f + HALF))
    return blocks, edges


@query(rf"""
    WITH {PLAIN}, halves AS (SELECT input_id, k, half, substr(c, half * {CHUNK // 2} + 1, {CHUNK // 2}) AS c FROM chunks, (SELECT unnest([0, 1]) AS half))
    SELECT input_id, unnest(regexp_extract_all(c, '[\t\x20-\x7E]{{4,}}')) AS value, CASE WHEN half = 1 AND k % 2 = 1 THEN 'tight' ELSE 'stack' END AS kind, k * {EACH} AS function_va FROM halves""")
def tight_strings(spark, sf_dir):
    """Strings of turns by the blocks of the code that writes them: tight where the block repeats."""
    digits = plain_turns(spark, sf_dir)
    options = Options(enabled=("stack", "tight"), format="sc64")
    found = extract(inputs.table(stack_code(digits), "id", "content"), options, graph=stack_graph(digits)).strings
    return found.select("input_id", "value", "kind", "location.function_va")


@query(rf"""
    WITH {PLAIN}, segments AS (SELECT input_id, k, unnest(regexp_extract_all(c, '[^\t\x20-\x7E]*[\t\x20-\x7E]+')) AS seg, generate_subscripts(regexp_extract_all(c, '[^\t\x20-\x7E]*[\t\x20-\x7E]+'), 1) AS i FROM chunks),
    pieces AS (SELECT input_id, k, regexp_extract(seg, '[\t\x20-\x7E]+$') AS value, CAST(sum(length(seg)) OVER (PARTITION BY input_id, k ORDER BY i) AS BIGINT) AS ends FROM segments)
    SELECT input_id, value, array_to_string(list_transform(range(0, least(8, length(value))), lambda j: k * {EACH} + 5 * (ends - length(value) + j)), ',') AS writers FROM pieces WHERE length(value) >= 4""")
def string_writers(spark, sf_dir):
    """Where the code is that writes the first characters of each string."""
    facts = extract(inputs.table(stack_code(plain_turns(spark, sf_dir)), "id", "content"), STACK).facts
    found = code.written_strings(facts, BY, 4, most=8)
    return found.select("input_id", "value", F.array_join("writers", ",").alias("writers"))


#: Where code and the slots of two imports are, in the ELF and PE files below, and the imports' names.
ELF_CODE, ELF_SLOTS, ELF_NAMES = 0x401000, 0x403000, ("socket", "fopen")
PE_CODE, PE_SLOTS, PE_NAMES = 0x140002000, 0x140001080, ("CreateFileA", "ordinal 7")
#: Bytes of a function: a frame, a call through a slot, a call of a stub, the end of the frame, a return.
SIZE = 20


def calling(n: Column, base: int, slots: int) -> Column:
    """Code of `n` functions, of which each calls one import through its slot and the other by its stub; the stubs follow."""
    rel = lambda x: F.hex(number(F.pmod(x, F.lit(1 << 32)), 4))
    slot = lambda j: slots + 8 * j
    one = lambda i: F.concat(F.lit("4883EC08FF15"), rel(slot(i % 2) - (base + SIZE * i + 10)), F.lit("E8"), rel(SIZE * n + 6 * (1 - i % 2) - (SIZE * i + 15)), F.lit("4883C408C3"))
    functions = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), one), "")
    stubs = [F.concat(F.lit("FF25"), rel(slot(F.lit(j)) - (base + SIZE * n + 6 * j + 6))) for j in (0, 1)]
    return F.unhex(F.concat(functions, *stubs))


def calling_files(spark, sf_dir) -> DataFrame:
    """Each document as an ELF and as a PE file with one to four functions; its source stands behind the code, its text in data."""
    n = (1 + F.col("id") % 4).cast("long")
    text = lambda c: joined(b"\0", F.encode(F.coalesce(F.col(c), F.lit("")), "UTF-8"), b"\0")
    symbol = joined(struct.pack("<IBBHQQ", 1, 0x12, 0, 0, 0, 0), struct.pack("<IBBHQQ", 2 + len(ELF_NAMES[0]), 0x12, 0, 0, 0, 0))
    strings = b"\0" + b"\0".join(x.encode() for x in ELF_NAMES) + b"\0"
    slots = b"".join(struct.pack("<QQQ", ELF_SLOTS + 8 * j, (j + 1) << 32 | 7, 0) for j in (0, 1))
    program = elf([
        (b".text", 1, 6, ELF_CODE, joined(calling(n, ELF_CODE, ELF_SLOTS), text("source"))), (b".rodata", 1, 2, 0x500000, text("text")),
        (b".dynsym", 11, 0, 0, joined(b"\0" * 24, symbol), 4), (b".dynstr", 3, 0, 0, raw(strings)), (b".rela.plt", 4, 0, 0, raw(slots)),
    ])
    df = documents(spark, sf_dir)
    with_code = df.select("id", joined(calling(n, PE_CODE, PE_SLOTS), text("source")).alias("code"), text("text").alias("body"))
    name = lambda kind: F.concat(F.lit(kind), F.col("id"))
    return df.select(name("elf ").alias("input_id"), program.alias("content")).union(with_code.select(name("pe "), pe()))


def calling_sql(rows: str) -> str:
    """Rows of each function: `i` its number, `f` where it begins, `names` of the imports."""
    names = lambda x: "[" + ", ".join(f"'{n}'" for n in x) + "]"
    return f"""
    WITH files AS (SELECT 'elf ' || doc_id AS input_id, doc_id, {ELF_CODE} AS base, {ELF_SLOTS} AS slots, {names(ELF_NAMES)} AS names FROM documents
        UNION ALL SELECT 'pe ' || doc_id, doc_id, {PE_CODE}, {PE_SLOTS}, {names(PE_NAMES)} FROM documents),
    functions AS (SELECT *, base + {SIZE} * i AS f FROM (SELECT *, unnest(range(0, 1 + doc_id % 4)) AS i FROM files)) {rows}"""


def calls_of(spark, sf_dir) -> DataFrame:
    found = extract(calling_files(spark, sf_dir), Options(enabled=("stack",)), extractors=["function_starts", "import_calls"])
    imports = found.parsed.select(*BY, F.explode("imports").alias("i")).select(*BY, "i.*")
    return entries.import_calls(found.more["import_calls"], imports, stash(entries.regions(found.more["function_starts"])))


@query(calling_sql("""
    SELECT input_id, f AS function_va, f + 4 AS place, slots + 8 * (i % 2) AS iat_va, names[i % 2 + 1] AS name, 'slot' AS through FROM functions
    UNION ALL SELECT input_id, f, f + 10, slots + 8 * (1 - i % 2), names[2 - i % 2], 'stub' FROM functions"""))
def import_calls(spark, sf_dir):
    """Which function of a file calls which import from where."""
    return calls_of(spark, sf_dir).select("input_id", F.col("function").alias("function_va"), "place", "iat_va", "name", "through")


# The one symbol of the PE files is a byte behind the first function's beginning and begins a function of its own.
@query(calling_sql(f""", starts AS (SELECT *, CASE WHEN input_id LIKE 'pe%' AND i = 0 THEN 1 ELSE 0 END AS behind FROM functions)
    SELECT s.input_id, f + behind AS va, CASE WHEN i < doc_id % 4 THEN {SIZE} ELSE {SIZE} + 12 + strlen(coalesce(source, '')) + 2 END::BIGINT - behind AS byte_size, 2::BIGINT AS imports,
        CASE WHEN s.input_id LIKE 'elf%' THEN 'calls_filesystem calls_network' ELSE 'calls_filesystem' END AS tags FROM starts s JOIN documents USING (doc_id)
    UNION ALL SELECT input_id, f, 1, 0, '' FROM starts WHERE behind = 1"""))
def function_table(spark, sf_dir):
    """The functions of a file: how long they are, and from the imports that they call, what they can do."""
    found = extract(calling_files(spark, sf_dir), Options(enabled=("stack",)), extractors=["function_starts", "import_calls", "direct_calls"])
    more = found.more
    rows = entries.functions(more["function_starts"], more["import_calls"], more["direct_calls"], found.parsed, capabilities.table(spark))
    return rows.select("input_id", "va", "byte_size", "imports", F.array_join("tags", " ").alias("tags"))


@query(calling_sql("""
    SELECT input_id, f AS place, 4 AS size FROM functions
    UNION ALL SELECT 'arm ' || conv_id || '/' || turn, unnest(range(0, 4 * length(text), 12)), 4 FROM conversations WHERE text <> ''"""))
def function_starts(spark, sf_dir):
    """First bytes of functions, from the files above in the pass of the extraction, and from AArch64 code, a word for each character
    of a turn and a frame at every third of them, by the table function."""
    extractors.register(spark)
    word = lambda i: F.when(i % 3 == 0, "FF4300D1").when(i % 3 == 1, "1F2003D5").otherwise("C0035FD6")
    arm = turns(spark, sf_dir).where("text <> ''").select(F.concat(F.lit("arm "), F.col("id")).alias("input_id"), F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.length("text") - 1), word), "")).alias("content"))
    arm.createOrReplaceTempView("stringloom_arm")
    by_sql = spark.sql("SELECT input_id, place, size FROM stringloom_arm, LATERAL extract_function_starts(content, null, 4, 'sc64_arm64')")
    found = extract(calling_files(spark, sf_dir), Options(enabled=("stack",)), extractors=["function_starts"]).more["function_starts"]
    return found.select("input_id", "place", "size").union(by_sql)


@query(f"""
    WITH {GRAPH}, cuts AS (SELECT function, start AS at FROM blocks UNION SELECT function, dst FROM edges),
    cut AS (SELECT b.*, c.at AS cut, s.start IS NOT NULL AS stands FROM blocks b LEFT JOIN cuts c ON b.function = c.function AND b.start < c.at AND c.at < b."end" LEFT JOIN blocks s ON s.function = c.function AND s.start = c.at)
    SELECT DISTINCT function, start, coalesce(cut, "end") AS "end", 'block' AS what FROM cut UNION SELECT function, cut, "end", 'block' FROM cut WHERE cut IS NOT NULL AND NOT stands
    UNION SELECT function, start, cut, 'edge' FROM cut WHERE cut IS NOT NULL
    UNION SELECT e.function, coalesce(c.cut, e.src), e.dst, 'edge' FROM edges e JOIN cut c ON e.function = c.function AND e.src = c.start WHERE NOT c.stands OR c.cut IS NULL""")
def split_blocks(spark, sf_dir):
    """An order's lines as blocks that overlap, cut where edges lead into them."""
    found = flow.split_graph(*graph(spark, sf_dir), [])
    return found.select("function", "start", "end", F.when(F.col("edge"), "edge").otherwise("block").alias("what"))


@query(f"""
    WITH {GRAPH}, outs AS (SELECT l_orderkey AS function, CAST(l_linenumber * 10 AS BIGINT) AS src, 'r' || l_suppkey % 3 AS register, CAST(min(l_partkey % 2) AS BIGINT) AS value FROM lineitem GROUP BY ALL),
    into_ AS (SELECT DISTINCT e.function, e.src, e.dst FROM edges e JOIN blocks b ON e.function = b.function AND e.dst = b.start),
    many AS (SELECT function, dst, count(*) AS n FROM into_ GROUP BY ALL)
    SELECT i.function, i.dst AS block, o.register, min(o.value) AS value FROM into_ i JOIN outs o USING (function, src) JOIN many m USING (function, dst) GROUP BY i.function, i.dst, o.register, m.n HAVING count(*) = m.n AND min(o.value) = max(o.value)""")
def state_meet(spark, sf_dir):
    """What all lines that lead to a line of an order agree on."""
    blocks, edges = graph(spark, sf_dir)
    start = (F.col("l_linenumber") * 10).cast("long")
    outs = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("function"), start.alias("block"), F.concat(F.lit("r"), F.col("l_suppkey") % 3).alias("register")).agg(F.min(F.col("l_partkey") % 2).cast("long").alias("value"))
    return flow.meet(outs, edges, blocks.select("function", F.col("start").alias("block")), ["function"])


#: Rounds that the SQL goes; the query goes on until nothing changes.
STATE_ROUNDS = 24


def fixpoint_sql() -> str:
    """Rounds over all blocks, one after the other: what those reached so far agree on."""
    rounds = ""
    for k in range(STATE_ROUNDS):
        rounds += f"""
        outs{k} AS MATERIALIZED (SELECT o.* FROM own o JOIN reach{k} USING (function, block) UNION ALL SELECT n.* FROM known{k} n WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.function = n.function AND o.block = n.block AND o.register = n.register)),
        into{k} AS MATERIALIZED (SELECT s.function, s.src, s.dst FROM steps s JOIN reach{k} r ON s.function = r.function AND s.src = r.block),
        reach{k + 1} AS MATERIALIZED (SELECT function, block FROM reach{k} UNION SELECT function, dst FROM into{k}),
        known{k + 1} AS MATERIALIZED (SELECT i.function, i.dst AS block, o.register, min(o.value) AS value FROM into{k} i JOIN outs{k} o ON i.function = o.function AND i.src = o.block
            JOIN (SELECT function, dst, count(*) AS n FROM into{k} GROUP BY ALL) m ON m.function = i.function AND m.dst = i.dst WHERE (i.function, i.dst) NOT IN (SELECT (function, block) FROM reach0)
            GROUP BY i.function, i.dst, o.register, m.n HAVING count(*) = m.n AND min(o.value) = max(o.value)),"""
    return f"""WITH {GRAPH}, own AS MATERIALIZED (SELECT l_orderkey AS function, CAST(l_linenumber * 10 AS BIGINT) AS block, 'r' || l_suppkey % 3 AS register, CAST(min(l_partkey % 2) AS BIGINT) AS value FROM lineitem GROUP BY ALL),
        steps AS MATERIALIZED (SELECT DISTINCT e.function, e.src, e.dst FROM edges e JOIN blocks b ON e.function = b.function AND e.dst = b.start),
        reach0 AS MATERIALIZED (SELECT function, min(start) AS block FROM blocks GROUP BY function), known0 AS MATERIALIZED (SELECT * FROM own WHERE false), {rounds}
        result AS (SELECT * FROM known{STATE_ROUNDS}) SELECT * FROM result"""


@query(fixpoint_sql())
def state_fixpoint(spark, sf_dir):
    """What holds on entry to each line of an order, over all paths from its first one."""
    blocks, edges = graph(spark, sf_dir)
    start = (F.col("l_linenumber") * 10).cast("long")
    own = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("function"), start.alias("block"), F.concat(F.lit("r"), F.col("l_suppkey") % 3).alias("register")).agg(F.min(F.col("l_partkey") % 2).cast("long").alias("value"))
    led = edges.join(blocks.select("function", F.col("start").alias("dst")), ["function", "dst"], "left_semi")
    return flow.state_meet(own, led, blocks.groupBy("function").agg(F.min("start").alias("block")), ["function"], stash)


#: Sections of the files below: name, flags, address; the first holds the source, the others the text.
MAPPED = ((".text", 6, 0x401000), (".data", 3, 0x401800), (".rodata", 2, 0x405000), (".init", 6, 0x40A800))


@query(f"""
    WITH sections AS (SELECT CAST(doc_id AS VARCHAR) AS input_id, a, x, w, CASE WHEN i = 0 THEN strlen(coalesce(source, '')) ELSE strlen(coalesce(text, '')) END + 2 AS size
        FROM documents, (VALUES {", ".join(f"({i}, {a}, {bool(f & 4)}, {bool(f & 1)})" for i, (_, f, a) in enumerate(MAPPED))}) m(i, a, x, w)),
    pages AS (SELECT input_id, page, bool_or(x) AS x, bool_or(w) AS w FROM (SELECT input_id, x, w, unnest(range(a // 4096, (a + size + 4095) // 4096)) AS page FROM sections) GROUP BY ALL),
    islands AS (SELECT *, page - row_number() OVER (PARTITION BY input_id, x, w ORDER BY page) AS island FROM pages)
    SELECT input_id, min(page) * 4096 AS start, (max(page) + 1) * 4096 AS "end", x AS executable, w AS writable FROM islands GROUP BY input_id, x, w, island""")
def permission_map(spark, sf_dir):
    """Rights of the pages of documents' ELF files, whose sections overlap."""
    text = lambda c: joined(b"\0", F.encode(F.coalesce(F.col(c), F.lit("")), "UTF-8"), b"\0")
    content = elf([(name.encode(), 1, flags, address, text("source" if i == 0 else "text")) for i, (name, flags, address) in enumerate(MAPPED)])
    parsed = parse(inputs.table(documents(spark, sf_dir).select("id", content.alias("content")), "id", "content"))
    sections = parsed.select(*BY, F.explode("sections").alias("s")).select(*BY, "s.*").where("virtual_address > 0")
    return intervals.permission_map(sections, BY).drop("arch_idx")


#: Where the code and the data of the files below are, and how many bytes of data are shown.
SITE_CODE, SITE_DATA, SHOWN = 0x401000, 0x600000, 16


@query(f"""
    WITH texts AS (SELECT conv_id || '/' || turn AS input_id, turn, hex(encode(text)) AS h FROM conversations),
    taken AS (SELECT input_id, h, unnest(CASE WHEN turn % 2 = 0 THEN [0, 8] ELSE [8] END) AS n FROM texts)
    SELECT input_id, ({SITE_CODE} + 14)::BIGINT AS ip, ({SITE_DATA} + n)::BIGINT AS address, substr(h, 2 * n + 1, {2 * SHOWN}) AS bytes FROM taken WHERE length(h) > 2 * n""")
def site_data(spark, sf_dir):
    """Turns behind the addresses that code takes before a call: in the block of the call, in the one that leads there, not after."""
    df = read(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("input_id"), "turn", F.encode("text", "UTF-8").alias("body"))
    lea = lambda at, to: b"\x48\x8d\x05" + struct.pack("<i", SITE_DATA + to - (SITE_CODE + at + 7))
    own = lea(0, 0) + lea(7, 8) + b"\xe8\0\0\0\0" + lea(19, 16) + b"\xc3"
    files = df.select("input_id", "turn", elf([(b".text", 1, 6, SITE_CODE, raw(own)), (b".rodata", 1, 2, SITE_DATA, F.col("body"))]).alias("content"))
    found = extract(files, Options(enabled=("stack",)), extractors=["references"])
    place = lambda n: F.lit(SITE_CODE + n).cast("long")
    whole = files.select("input_id", F.lit(0).alias("arch_idx"), "turn", place(0).alias("function"))
    block = lambda a, b: F.struct(place(a).alias("start"), place(b).alias("end"))
    blocks = whole.select(*BY, "function", F.explode(F.array(block(0, 7), block(7, 27))).alias("b")).select(*BY, "function", "b.*")
    edges = whole.where("turn % 2 = 0").select(*BY, "function", place(0).alias("src"), place(7).alias("dst"))
    sites = whole.select(*BY, "function", place(7).alias("block"), place(14).alias("ip"), place(19).alias("next_ip"))
    sections = stash(found.parsed.select(*BY, F.explode("sections").alias("s")).select(*BY, "s.*").where("virtual_address > 0"))
    targets = stash(flow.site_targets(sites, found.more["references"], blocks, edges, sections, BY))
    shown = intervals.bytes_at(targets, sections, files, SHOWN, BY)
    return targets.join(shown, [*BY, "address"]).select("input_id", "ip", "address", F.hex("bytes").alias("bytes"))


@query("""
    SELECT CAST(doc_id AS VARCHAR) AS input_id, CASE doc_id % 8 WHEN 0 THEN 'elf' WHEN 1 THEN 'pe' WHEN 2 THEN 'elf' WHEN 3 THEN 'pe' ELSE 'mach_o' END AS format, doc_id % 8 > 1 AS failed,
        CASE WHEN doc_id % 8 < 2 THEN 1 ELSE 0 END::BIGINT AS found FROM documents""")
def bad_containers(spark, sf_dir):
    """Documents as files of three formats, most of them damaged: texts behind a magic number, sections beyond any file, commands of
    no length, slices beyond the file, bindings without end. Each is a row that says whether it failed and how often the intact
    part shows its mark."""
    df = documents(spark, sf_dir)
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    mark = joined(b"\0", F.encode(F.concat(F.lit("mark of "), F.col("id")), "UTF-8"), b"\0")
    endless = struct.pack("<II16sQQQQIIII", 0x19, 72, b"__DATA", 0x1000, 1 << 62, 0, 0, 3, 3, 0, 0) + struct.pack("<12I", 0x22, 48, 0, 0, 152, 16, 0, 0, 0, 0, 0, 0)
    mach = lambda commands, n: struct.pack("<IIIIIIII", 0xFEEDFACF, 0x01000007, 0, 2, n, len(commands), 0, 0) + commands
    bind = b"\x40x\0\x70\0\xc0" + b"\xff" * 8 + b"\x01\0"
    content = (
        F.when(F.col("id") % 8 == 0, elf([(b".rodata", 1, 2, (1 << 63) - 4, mark), (b".far", 1, 2, 0x1000, raw(b""))]))
        .when(F.col("id") % 8 == 1, F.lit(None).cast("binary"))
        .when(F.col("id") % 8 == 2, joined(b"\x7fELF\x02\x01\x01", text))
        .when(F.col("id") % 8 == 3, joined(b"MZ", text))
        .when(F.col("id") % 8 == 4, joined(b"\xcf\xfa\xed\xfe", text))
        .when(F.col("id") % 8 == 5, joined(mach(b"\0" * 64, 1 << 31), text))
        .when(F.col("id") % 8 == 6, joined(struct.pack(">IIIIQQII", 0xCAFEBABF, 1, 7, 0, (1 << 64) - 8, (1 << 64) - 1, 0, 0), text))
        .otherwise(joined(mach(endless, 2).ljust(152, b"\0"), bind.ljust(16, b"\0"), text))
    )
    whole = documents(spark, sf_dir).select("id", joined(mark, raw(b"")).alias("body"), raw(b"\0").alias("code")).select("id", pe().alias("pe"))
    files = df.select("id", content.alias("content")).join(whole, "id").select("id", F.coalesce("content", "pe").alias("content"))
    result = extract(inputs.table(files, "id", "content"), Options(enabled=("static_ascii",)))
    marks = result.strings.where("value like 'mark of %'").groupBy("input_id").agg(F.count("*").alias("found"))
    return result.inputs.join(marks, "input_id", "left").select("input_id", "format", F.col("error").isNotNull().alias("failed"), F.coalesce("found", F.lit(0)).alias("found"))
